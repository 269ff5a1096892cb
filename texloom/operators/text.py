"""Documents as lines, sentences, fragments and token sequences."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequences as S
from ..functions import text as X
from .arrow import keep_rows, map_batches


def sentence_lines(docs: DataFrame) -> DataFrame:
    """doc_id, sent_no (from 0), sentence: the lines that aren't blank. A null text has none."""
    return docs.select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("sent_no", "sentence"))


def filter_sentences(sents: DataFrame, min_words: int = 3, max_ratio: float = 0.5) -> DataFrame:
    """Sentences with at least ``min_words`` words and no more numbers than ``max_ratio`` for each word (0 or less: no such limit). One pass over each sentence."""
    keeps = sentence_rule(min_words, max_ratio)
    return keep_rows(sents, lambda b: [s is not None and keeps(s, len(s.split())) for s in b.column("sentence").to_pylist()])


#: A number, or a word.
NUMBER_OR_WORD = re.compile(r"(\d+[-–.]?\d*)|(\w+)")


def sentence_rule(min_words: int, max_ratio: float) -> Callable[[str, int], bool]:
    """Whether a sentence of so many tokens is kept."""

    def keeps(sentence: str, tokens: int) -> bool:
        if tokens < min_words:
            return False
        if max_ratio <= 0:
            return True
        numbers = words = 0
        for m in NUMBER_OR_WORD.finditer(sentence):
            if m.lastindex == 1:
                numbers += 1
            else:
                words += 1
        return words > 0 and numbers <= words * max_ratio

    return keeps


def document_info(docs: DataFrame, count: Callable[[str], int] | None = None) -> DataFrame:
    """doc_id, n_lines, n_words, fingerprint: the MD5 of the lines that aren't blank, with their line breaks. Texts without a line that isn't blank are left out.

    ``count``: tokens of a text, in place of its words. One pass over each text, where it lies.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_lines", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("fingerprint", T.StringType())])

    def info(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, lines, words, marks = [], [], [], []
        for k, t in enumerate(b.column("text").to_pylist()):
            kept = [x for x in RAW_LINES.findall(t or "") if not x.isspace()]
            if kept:
                rows.append(k)
                lines.append(len(kept))
                words.append(count(t) if count else len(t.split()))
                marks.append(hashlib.md5("".join(kept).encode("utf-8", "surrogatepass")).hexdigest())
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(lines, pa.int32()), pa.array(words, pa.int32()), pa.array(marks, pa.string())], names=["doc_id", "n_lines", "n_words", "fingerprint"])

    return map_batches(docs.select("doc_id", "text"), schema, info)


def token_fingerprint(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """doc_id, fingerprint: the MD5 of a document's token ids, four bytes each, lowest first; null for a null list."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fingerprint", T.StringType())])

    def mark(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [None if x is None else hashlib.md5(struct.pack(f"<{len(x)}i", *x)).hexdigest() for x in b.column(tokens).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return map_batches(docs.select("doc_id", tokens), schema, mark)


#: Lines with their line breaks.
RAW_LINES = re.compile("[^\n]*\n|[^\n]+")
PREPARED = "lengths array<int>, segments array<int>, truncated boolean"


def prepared_texts(
    docs: DataFrame, mode: str = "sents", max_tokens: int | None = None, max_seqs: int | None = None, fragment: int = 16, min_words: int = 3, max_ratio: float = 0.0, count: Callable[[str], int] | None = None
) -> DataFrame:
    """doc_id, lengths (tokens of each sequence), segments (how many sequences each segment has) and truncated, of each text that isn't null.

    ``mode``: sents (a sequence per sentence that the filter keeps; one segment), fragments of sents
    (segments of ``fragment`` sentences), frags (a sequence per ``fragment`` lines) or tokens (one sequence). Sequences are cut at what is left of
    ``max_tokens``; a text ends with the one that uses it up, or is the ``max_seqs``-th, and counts as truncated even if nothing follows. In the sentence
    modes it also ends where no more than twice ``min_words`` tokens are left; sentences the filter drops use nothing up. ``count``: tokens of a string, else its words.
    """
    if mode not in ("sents", "sents_frags", "frags", "tokens"):
        raise ValueError(f"no such mode: {mode}")
    keeps = sentence_rule(min_words, max_ratio)
    size = count or (lambda s: len(s.split()))

    def prepare(text: str) -> tuple[list[int], list[int], bool]:
        if mode == "tokens":
            n = size(text)
            n = n if max_tokens is None else min(n, max_tokens)
            return [n], [1], n == max_tokens
        lines = text.split("\n")
        if mode == "frags":
            parts = ["\n".join(lines[k : k + fragment]) for k in range(0, len(lines), fragment)]
        else:
            parts = [x for x in lines if x.strip()]
        out, used, cut = [], 0, False
        for part in parts:
            left = None if max_tokens is None else max_tokens - used
            if mode != "frags" and left is not None and left <= 2 * min_words:
                cut = True
                break
            n = size(part)
            n = n if left is None else min(n, left)
            if mode != "frags" and not keeps(part, n):
                continue
            out.append(n)
            used += n
            if max_seqs and len(out) >= max_seqs or max_tokens is not None and used == max_tokens:
                cut = True
                break
        if mode == "sents_frags":
            return out, [min(fragment, len(out) - k) for k in range(0, len(out), fragment)], cut
        return out, [len(out)], cut

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(PREPARED).fields])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return _prepared(b.column("doc_id"), [prepare(t) for t in b.column("text").to_pylist()])

    return map_batches(docs.select("doc_id", "text").where(F.col("text").isNotNull()), schema, run)


def _prepared(ids: pa.Array, rows: list[tuple[list[int], list[int], bool]]) -> pa.RecordBatch:
    ints = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays([ids, pa.array([x[0] for x in rows], ints), pa.array([x[1] for x in rows], ints), pa.array([x[2] for x in rows], pa.bool_())], names=["doc_id", "lengths", "segments", "truncated"])


def retruncated(prepared: DataFrame, max_tokens: int | None = None, max_seqs: int | None = None, fragment: int | None = None, min_words: int = 3) -> DataFrame:
    """Prepared texts (doc_id, lengths, segments, truncated) cut once more, as in ``prepared_texts``; segmented anew, by ``fragment`` if given, only where sequences fell away."""

    def again(lengths: list[int], segments: list[int]) -> tuple[list[int], list[int], bool]:
        out, used, cut = [], 0, False
        for n in lengths:
            left = None if max_tokens is None else max_tokens - used
            if left is not None and left <= 2 * min_words:
                cut = True
                break
            n = n if left is None else min(n, left)
            out.append(n)
            used += n
            if max_seqs and len(out) >= max_seqs or max_tokens is not None and used == max_tokens:
                cut = True
                break
        if len(out) == len(lengths):
            return out, segments, cut
        return out, [min(fragment, len(out) - k) for k in range(0, len(out), fragment)] if fragment else [len(out)], cut

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return _prepared(b.column("doc_id"), [again(x, y) for x, y in zip(b.column("lengths").to_pylist(), b.column("segments").to_pylist())])

    return map_batches(prepared.select("doc_id", "lengths", "segments", "truncated"), prepared.select("doc_id", "lengths", "segments", "truncated").schema, run)


def preparation_statistics(prepared: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """One row: texts, empty ones, sequences, tokens, truncated texts, and of those the mean share of tokens kept, by ``lengths`` (doc_id, n_words). Counts and sums, so parts can be added."""
    rows = prepared.withColumn("t", F.aggregate("lengths", F.lit(0), lambda a, x: a + x))
    kept = F.lit(None).cast("double")
    if lengths is not None:
        rows = rows.join(lengths.select("doc_id", "n_words"), "doc_id", "left")
        kept = F.round(F.avg(F.when(F.col("truncated"), F.col("t") / F.greatest(F.col("n_words"), F.lit(1)))), 6)
    return rows.agg(
        F.count("*").alias("texts"), F.count_if(F.col("t") == 0).alias("empty"), F.coalesce(F.sum(F.size("lengths")), F.lit(0)).alias("sequences"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.count_if("truncated").alias("truncated"), kept.alias("kept_share"),
    )


def duplicate_groups(info: DataFrame) -> DataFrame:
    """fingerprint, copies, first_doc of each text that stands in more than one document."""
    return info.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


def with_class(info: DataFrame) -> DataFrame:
    """doc_id and class_id, the least doc_id with the same fingerprint; copies aren't expanded into pairs."""
    firsts = info.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return info.join(firsts, "fingerprint").select("doc_id", "class_id", "class_size")


def fragments(info: DataFrame, size: int = 16) -> DataFrame:
    """doc_id, frag_no (from 0), n_sents: fragments of ``size`` sentences, the last one shorter."""
    return info.select("doc_id", F.posexplode(S.fragment_lengths(F.col("n_lines"), size)).alias("frag_no", "n_sents"))


def hierarchy(sents: DataFrame, size: int = 16) -> DataFrame:
    """doc_id, frag_no, n_sents, n_tokens: the levels tokens, sentences and fragments of each document."""
    frag = F.floor(F.col("sent_no") / size).cast("int")
    return sents.groupBy("doc_id", frag.alias("frag_no")).agg(
        F.count("*").alias("n_sents"), F.sum(F.size(X.words(F.col("sentence")))).alias("n_tokens")
    )


def capped_segments(docs: DataFrame, max_tokens: int, min_words: int = 3) -> DataFrame:
    """doc_id, n_sents, n_tokens and truncated of each text cut to ``max_tokens``, sentence by sentence; see ``prepared_texts``."""
    rows = prepared_texts(docs, "sents", max_tokens, min_words=min_words)
    return rows.select("doc_id", F.size("lengths").alias("n_sents"), F.aggregate("lengths", F.lit(0), lambda a, x: a + x).alias("n_tokens"), "truncated")


def encode_statistics(info: DataFrame, sents: DataFrame) -> DataFrame:
    """One row: documents, sentences, tokens, the longest document and the mean number of sentences."""
    per = sents.groupBy("doc_id").agg(F.count("*").alias("s"), F.sum(F.size(X.words(F.col("sentence")))).alias("t"))
    return info.join(per, "doc_id", "left").agg(
        F.count("*").alias("documents"), F.sum("s").alias("sentences"), F.sum("t").alias("tokens"), F.max("t").alias("longest"),
        F.round(F.avg("s"), 6).alias("mean_sentences"),
    )
