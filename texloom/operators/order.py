"""Numbering rows in a total order without gathering them in one task, and sampling by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows that are taken from the top of an order by a heap in each task; more are numbered instead.
HEAP_ROWS = 100_000
#: Hex digits of a hash by which a sample's end is looked for at a time, and how often.
DIGITS, ROUNDS = 3, 3


def _dealt(df: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """Rows dealt to tasks by ranges of the order, with the range in ``_range``; written once, so that all jobs see the same ranges."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())), n


def ranked(df: DataFrame, *order: Column, name: str = "row_no") -> DataFrame:
    """Adds the place of each row, from 1, in the given total order.

    Rows are dealt to tasks by ranges of the order and numbered there; the numbers of rows of the
    ranges before are added. Rows the order doesn't tell apart get different places, in no certain order.
    """
    if not order:
        raise ValueError("an order is needed")
    dealt, n = _dealt(df, *order)
    counts = {r["_range"]: r["n"] for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # one row per range
    before, offsets = 0, []
    for k in range(max([n, *counts]) + 1):
        offsets.append(before)
        before += counts.get(k, 0)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    first = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in offsets]), F.col("_range") + 1)
    return dealt.withColumn(name, (place + first).cast("bigint")).drop("_range")


def ranked_within(df: DataFrame, keys: list[str], *order: Column, name: str = "place") -> DataFrame:
    """Adds the place of each row, from 1, among those of the same ``keys``, however many they are.

    As a window by the keys would, but rows are dealt to tasks by ranges of keys and order together,
    so a group may lie in several; the first group of a range goes on from those before.
    """
    dealt, _ = _dealt(df, *[F.col(k) for k in keys], *order)
    key = F.struct(*keys)
    # only the first group of a range may have begun before, and only the last may go on: two groups a range
    ends = dealt.groupBy("_range").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    at_ends = dealt.select("_range", key.alias("_key")).join(F.broadcast(ends), "_range").where(F.col("_key").eqNullSafe(F.col("_lo")) | F.col("_key").eqNullSafe(F.col("_hi")))
    rows = at_ends.groupBy("_range", "_key").agg(F.count("*").alias("n"), F.first("_lo").alias("_lo")).orderBy("_range").collect()
    held: dict[tuple, int] = {}
    offsets: dict[int, int] = {}
    for r in rows:
        k = tuple(r["_key"])
        if k == tuple(r["_lo"]):
            offsets[r["_range"]] = held.get(k, 0)
        # what the ranges before have of each group: rows come by range
        held[k] = held.get(k, 0) + r["n"]
    first = F.element_at(F.array(*[F.lit(offsets.get(x, 0)).cast("bigint") for x in range(max(offsets, default=0) + 1)]), F.least(F.col("_range"), F.lit(max(offsets, default=0))) + 1)
    lo = ends.select("_range", "_lo")
    place = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    out = dealt.withColumn("_in_range", place).join(F.broadcast(lo), "_range")  # a row per range
    out = out.withColumn(name, (F.col("_in_range") + F.when(key.eqNullSafe(F.col("_lo")), first).otherwise(0)).cast("int"))
    return out.drop("_range", "_in_range", "_lo")


def first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of an order; more than HEAP_ROWS of them are found by their places."""
    if n <= HEAP_ROWS:
        return df.orderBy(*order).limit(n)
    return ranked(df, *order, name="_place").where(F.col("_place") <= n).drop("_place")


def seeded_hash(seed: int, *cols: Column) -> Column:
    """A hash any engine can repeat: MD5 of the seed and the columns, joined by ``:``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def sample_exact(df: DataFrame, share: float, seed: int, *key: Column) -> DataFrame:
    """Exactly floor(n * share) rows, those with the least seeded hashes; ``key`` must be unique.

    The hash at which the sample ends is found from counts by its first digits, then by the next
    ones of those that begin alike; only the rows that begin with all of them are ordered.
    """
    h = seeded_hash(seed, *key)
    wanted, prefix = int(df.count() * share), ""
    for _ in range(ROUNDS):
        digits = F.substring(h, len(prefix) + 1, DIGITS)
        # 16 ** DIGITS rows at most
        counts = sorted(((r["d"], r["n"]) for r in df.where(h.startswith(prefix)).groupBy(digits.alias("d")).agg(F.count("*").alias("n")).collect()))
        for d, n in counts:
            if n > wanted:
                prefix += d
                break
            wanted -= n
        else:  # all that begin alike are wanted
            return df.where(F.substring(h, 1, len(prefix)) <= prefix) if prefix else df
    start = F.substring(h, 1, len(prefix))
    return df.where(start < prefix).unionByName(df.where(start == prefix).orderBy(h, *key).limit(wanted))


def latest_rows(df: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """One row per key: the last one by ``at`` (nulls first), then by the least of ``ties``."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), *[F.col(t).asc_nulls_first() for t in ties])
    return df.withColumn("_no", F.row_number().over(w)).where("_no = 1").drop("_no")
