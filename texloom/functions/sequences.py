"""Column functions on token sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<int>")


def parse_tokens(c: Column) -> Column:
    """Integers written one after the other with white space between them; empty parts are passed over."""
    return F.transform(F.filter(F.split(c, r"\s+"), lambda x: x != ""), lambda x: x.cast("int"))


def with_special_tokens(seq: Column, prefix: list[int], suffix: list[int], max_len: int | None = None) -> Column:
    """``prefix`` + sequence + ``suffix``, the sequence cut so that the whole has at most ``max_len`` (never below the special ones)."""
    body = seq if max_len is None else F.slice(seq, 1, max(0, max_len - len(prefix) - len(suffix)))
    return F.concat(_ints(prefix), body, _ints(suffix))


def token_count(seqs: Column, special: int, max_len: int) -> Column:
    """Tokens of several sequences, each with its special tokens and cut at ``max_len``."""
    return F.aggregate(seqs, F.lit(0), lambda acc, s: acc + F.least(F.size(s) + special, F.lit(max_len)))


def round_up(n: Column, multiple: int) -> Column:
    return (F.ceil(n / F.lit(multiple)) * multiple).cast("int")


def pad(seq: Column, length: Column, value: int = 0, left: bool = False) -> Column:
    """The sequence filled up to ``length``; a longer one stays as it is."""
    fill = F.array_repeat(F.lit(value), F.greatest(length - F.size(seq), F.lit(0)))
    return F.concat(fill, seq) if left else F.concat(seq, fill)


def or_pad(seq: Column, value: int = 0) -> Column:
    """An empty sequence becomes one padding token."""
    return F.when(F.size(seq) == 0, F.array(F.lit(value))).otherwise(seq)


def fragment_lengths(n: Column, size: int) -> Column:
    """Lengths of the fragments of ``size`` that ``n`` items fall into, the last one with what is left."""
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.least(n - s, F.lit(size)))


def pad_all(seqs: Column, value: int = 0, multiple: int = 1) -> Column:
    """The sequences of a document, each filled up to the longest one, rounded up to a multiple."""
    longest = F.aggregate(seqs, F.lit(0), lambda n, s: F.greatest(n, F.size(s)))
    return F.transform(seqs, lambda s: pad(s, round_up(longest, multiple), value))
