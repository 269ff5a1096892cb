"""Tokenizers as plug-ins: from texts to token ids, batch by batch.

A tokenizer is made by name in each process, once; others are added with ``register``. The libraries
behind ``sentencepiece`` and ``tokenizers`` are only needed where those names are used.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_batches


class Tokenizer(Protocol):
    def encode(self, texts: Sequence[str]) -> list[list[int]]: ...


@dataclass(frozen=True)
class TokenizerConf:
    """Which tokenizer, its file, and the special ids put before and behind each text."""

    kind: str = "pretokenized"
    path: str | None = None
    prefix: tuple[int, ...] = ()
    suffix: tuple[int, ...] = ()
    pad: int = 0
    max_length: int | None = None
    #: SentencePiece's sampling of segmentations, for training only; 0 is none
    alpha: float = 0.0
    nbest: int = -1


class Pretokenized:
    """Integers with white space between them."""

    def __init__(self, conf: TokenizerConf):
        pass

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [[int(x) for x in t.split()] for t in texts]


class Words:
    """A number below 2 ** 30 for each word, the same in every process."""

    def __init__(self, conf: TokenizerConf):
        import zlib

        self.number = lru_cache(maxsize=1 << 16)(lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")) & ((1 << 30) - 1))

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [[self.number(w) for w in t.split()] for t in texts]


class SentencePiece:
    """A SentencePiece model."""

    def __init__(self, conf: TokenizerConf):
        import sentencepiece

        self.model, self.conf = sentencepiece.SentencePieceProcessor(model_file=conf.path), conf

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        if self.conf.alpha:
            return [self.model.encode(t, enable_sampling=True, alpha=self.conf.alpha, nbest_size=self.conf.nbest) for t in texts]
        return self.model.encode(list(texts), num_threads=1)


class Fast:
    """A tokenizer file of the ``tokenizers`` library; the strings of its special tokens are ordinary text."""

    def __init__(self, conf: TokenizerConf):
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(conf.path)
        self.model.encode_special_tokens = True

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch(list(texts), add_special_tokens=False)]


FACTORIES: dict[str, Callable[[TokenizerConf], Tokenizer]] = {"pretokenized": Pretokenized, "words": Words, "sentencepiece": SentencePiece, "tokenizers": Fast}


def register(kind: str, factory: Callable[[TokenizerConf], Tokenizer]) -> None:
    FACTORIES[kind] = factory


@lru_cache(maxsize=8)
def _made(factory: Callable[[TokenizerConf], Tokenizer], conf: TokenizerConf) -> Tokenizer:
    return factory(conf)


def tokenized(docs: DataFrame, conf: TokenizerConf, text: str = "text", out: str = "tokens", pad_empty: bool = False) -> DataFrame:
    """The other columns and ``out``: the token ids of each text with its special ones, cut so that the whole has ``conf.max_length`` at most.

    A null text has none; with ``pad_empty`` what would have none is one padding token.
    """
    if conf.kind not in FACTORIES:
        raise ValueError(f"no such tokenizer: {conf.kind}")
    factory = FACTORIES[conf.kind]  # goes with the function, so that registered ones are known everywhere
    rest = [c for c in docs.columns if c != text]
    room = None if conf.max_length is None else max(0, conf.max_length - len(conf.prefix) - len(conf.suffix))
    before, behind = list(conf.prefix), list(conf.suffix)
    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def encode(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(text).to_pylist()
        ids = iter(_made(factory, conf).encode([t for t in texts if t is not None]))
        rows = [before + next(ids)[:room] + behind if t is not None else [] for t in texts]
        if pad_empty:
            rows = [x or [conf.pad] for x in rows]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(rows, pa.list_(pa.int32()))], names=[*rest, out])

    return map_batches(docs, schema, encode)


def token_totals(seqs: DataFrame, special: int = 0, tokens: str = "tokens") -> DataFrame:
    """One row: texts, empty ones, tokens without the ``special`` ones of each text, and the most of one text."""
    n = F.greatest(F.size(tokens) - special, F.lit(0))
    return seqs.agg(F.count("*").alias("texts"), F.count_if(n == 0).alias("empty"), F.coalesce(F.sum(n), F.lit(0)).alias("tokens"), F.max(n).alias("longest"))
