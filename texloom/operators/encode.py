"""Vectors of sequences, sentences, fragments and documents; encoders plug in as Arrow functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import lists, matrix

#: From lists of token ids to a matrix with a row for each.
Encoder = Callable[[list[list[int]]], np.ndarray]


def token_vector(token: Column, dim: int) -> Column:
    """A vector of ``dim`` numbers in [0, 1) for a token id, made by arithmetic any engine can repeat."""
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda d: F.pmod(token * 7919 + d * 104729, F.lit(1009)) / F.lit(1009.0))


def pool(rows: DataFrame, by: list[str], how: str = "mean", vec: str = "vec", order: str | None = None) -> DataFrame:
    """One vector per group, number by number: mean or max of the group's, or its first or last by ``order``.

    Each batch is reduced where it lies, so a group with many rows sends few; the parts are then merged in the order of the groups.
    """
    if how in ("first", "last"):
        pick = F.min_by if how == "first" else F.max_by
        return rows.groupBy(*by).agg(pick(vec, order).alias(vec))
    keys = rows.select(*by).schema.fields
    part = T.StructType([*keys, T.StructField(vec, T.ArrayType(T.DoubleType())), T.StructField("_n", T.LongType())])
    reduce = np.add if how == "mean" else np.maximum

    def reduced(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        """The first row of each group in the batch, and its reduced vectors and counts."""
        group = b.select(by).to_pandas().groupby(by, sort=False, dropna=False).ngroup().to_numpy()
        _, first = np.unique(group, return_index=True)
        m = matrix(b.column(vec))
        out = np.full((len(first), m.shape[1]), 0.0 if how == "mean" else -np.inf)
        reduce.at(out, group, m)
        n = np.bincount(group, b.column("_n").to_numpy() if "_n" in b.schema.names else None).astype(np.int64)
        return b.select(by).take(pa.array(first)), out, n

    def batch(keys_: pa.RecordBatch, m: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*keys_.columns, lists(m), pa.array(n)], names=[*by, vec, "_n"])

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield batch(*reduced(b))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for b in batches:
            if not b.num_rows:
                continue
            both = b
            if held is not None:
                both = pa.RecordBatch.from_arrays([pa.concat_arrays([held.column(c).cast(b.column(c).type), b.column(c)]) for c in b.schema.names], names=b.schema.names)
            done = batch(*reduced(both))
            # rows come by group: only the last one may go on
            held = done.slice(done.num_rows - 1)
            if done.num_rows > 1:
                yield done.slice(0, done.num_rows - 1)
        if held is not None:
            yield held

    parts = rows.where(F.col(vec).isNotNull()).select(*by, F.col(vec).cast("array<double>").alias(vec)).mapInArrow(here, part)
    merged = parts.repartition(*by).sortWithinPartitions(*by).mapInArrow(merge, part)
    return merged.select(*by, (F.transform(vec, lambda x: x / F.col("_n")) if how == "mean" else F.col(vec)).alias(vec))


#: What a document is a sequence of, and the levels its tokens are averaged by.
LAYOUTS = {"sents_frags": (["frag_no", "sent_no"], ["frag_no"]), "sents": (["sent_no"],), "frags": (["frag_no"],), "tokens": ()}


def average_hierarchy(tokens: DataFrame, dim: int = 8, fragment: int = 4, layout: str = "sents_frags") -> DataFrame:
    """doc_id, vec: tokens averaged level by level: to sentences, to fragments of ``fragment`` sentences, to documents.

    ``layout``: sents_frags, sents, frags or tokens, what lies between tokens and documents. ``tokens``: doc_id, sent_no, token. A document without tokens has no row.
    """
    rows = tokens.select("doc_id", "sent_no", F.floor(F.col("sent_no") / fragment).alias("frag_no"), token_vector(F.col("token"), dim).alias("vec"))
    for level in LAYOUTS[layout]:
        rows = pool(rows, ["doc_id", *level])
    return pool(rows, ["doc_id"])


def encode_with(seqs: DataFrame, encoder: Encoder, max_tokens: int = 96_000, normalise: bool = True) -> DataFrame:
    """id, vec: each sequence by ``encoder``. ``seqs``: id (bigint), tokens; an empty or null sequence is one padding token.

    In each Arrow batch sequences are encoded from the longest on in chunks of at most ``max_tokens``
    with padding, and come out in their own order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq = [x or [0] for x in b.column("tokens").to_pylist()]
            order = sorted(range(len(seq)), key=lambda k: -len(seq[k]))
            out: dict[int, np.ndarray] = {}
            at = 0
            while at < len(order):
                n = max(1, max_tokens // len(seq[order[at]]))
                part = order[at : at + n]
                for k, v in zip(part, encoder([seq[k] for k in part])):
                    out[k] = v
                at += n
            m = np.array([out[k] for k in range(len(seq))], np.float64)
            if normalise and len(m):
                m = m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(m), pa.list_(pa.float64()))], names=["id", "vec"])

    return seqs.select("id", "tokens").mapInArrow(run, "id bigint, vec array<double>")


def hits_and_misses(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Cached rows of the wanted keys, and the wanted rows that aren't cached."""
    return cache.join(wanted.select(key).distinct(), key, "left_semi"), wanted.join(cache.select(key), key, "left_anti")


def encode_cached(seqs: DataFrame, cache: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All vectors wanted, and those that are new; ``cache``: id, vec. Cached vectors of another type or length than the new ones are an error, found by one small job on either side."""
    there, missing = hits_and_misses(seqs, cache, "id")
    new = encode(missing)
    if there.schema["vec"].dataType != new.schema["vec"].dataType:
        raise ValueError(f"cached vectors are {there.schema['vec'].dataType.simpleString()}, new ones {new.schema['vec'].dataType.simpleString()}")
    sizes = there.agg(F.min(F.size("vec")).alias("a"), F.max(F.size("vec")).alias("b")).first()
    one = new.select(F.size("vec").alias("n")).first()
    found = {x for x in (sizes["a"], sizes["b"], one and one["n"]) if x is not None}
    if len(found) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(found)}")
    return there.select("id", "vec").unionByName(new), new


def weighted_merge(rows: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """pos, value: the sum of each position's values by model, weighted (equally, if not said). ``rows``: model, pos, value."""
    if weights is None:
        return rows.groupBy("pos").agg((F.sum("value") / F.countDistinct("model")).alias("value"))
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("model"))
    return rows.groupBy("pos").agg(F.sum(w * F.col("value")).alias("value"))
