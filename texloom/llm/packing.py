"""Problem 5: items of varying length packed into containers of fixed capacity."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Items packed together in one task; a larger dataset is dealt into several blocks.
BLOCK_ITEMS = 20_000
#: A container with more room than this share of its capacity is opened again in the second round.
LOOSE = 0.01
MAX_CONFS = 10_000


class Stock:
    """Lengths at hand with their counts, and an index of the sums of one, two and three of them.

    Counts only fall. So the combinations of a sum are listed once, when the sum is first asked for,
    and a mark in the list moves past those of which a length has run out; it never goes back.
    """

    def __init__(self, lengths: np.ndarray):
        top = int(lengths.max()) if len(lengths) else 0
        self.count = np.bincount(lengths, minlength=top + 1).tolist()
        self.there = np.array(self.count) > 0
        self.present = np.flatnonzero(self.there).tolist()  # ascending; lengths without items leave it
        self.left = len(lengths)
        self.falling = self.present[::-1]
        #: sum -> [the shorter lengths of its pairs, ascending; how many of them have run out]
        self.pairs: dict[int, list] = {}
        #: sum -> how many of ``falling`` give no triple of it any more
        self.triples: dict[int, int] = {}

    def take(self, n: int) -> int:
        self.count[n] -= 1
        self.left -= 1
        if not self.count[n]:
            self.there[n] = False
            del self.present[bisect_right(self.present, n) - 1]
        return n

    def largest(self, most: int) -> int | None:
        k = bisect_right(self.present, most)
        return self.present[k - 1] if k else None

    def _listed(self, total: int) -> list:
        top = len(self.there) - 1
        low = max(1, total - top)
        if total < 2 or low > total // 2:
            return [[], 0]
        short = self.there[low : total // 2 + 1]
        long = self.there[total - total // 2 : total - low + 1][::-1]
        return [(np.flatnonzero(short & long) + low).tolist(), 0]

    def pair(self, total: int, spent: int = 0) -> tuple[int, int] | None:
        """Two items of exactly this sum, the longer one as long as may be; one item of length ``spent`` is already used."""
        entry = self.pairs.get(total)
        if entry is None:
            entry = self.pairs[total] = self._listed(total)
        shorts, count = entry[0], self.count
        for k in range(entry[1], len(shorts)):
            b = shorts[k]
            a = total - b
            if a != b and count[a] and count[b] or a == b and count[a] > 1:
                if a != b and count[a] > (a == spent) and count[b] > (b == spent) or a == b and count[a] > 1 + (a == spent):
                    return a, b
            elif k == entry[1]:
                entry[1] += 1
        return None

    def exact(self, total: int) -> list[int] | None:
        """One, two or three items that fill ``total`` exactly, as the counts allow."""
        if 0 < total < len(self.count) and self.count[total]:
            return [total]
        if p := self.pair(total):
            return list(p)
        for k in range(self.triples.get(total, 0), len(self.falling)):
            a = self.falling[k]
            if 3 * a < total:
                break
            if a and a < total and self.count[a] and (p := self.pair(total - a, a)):
                self.triples[total] = k
                return [a, *p]
        else:
            k = len(self.falling)
        self.triples[total] = k
        return None


def pack_lengths(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers, each a list of lengths (at most ``capacity`` together).

    Each container starts with the longest item left. While the gap is beyond three of the longest
    items, the longest goes in; then an exact complement of one, two or three items is consumed if
    there is one; otherwise the best fit goes in and the smaller gap is tried.
    """
    stock = Stock(np.asarray(lengths, np.int64))
    nothing = int(stock.count[0]) if len(stock.count) else 0
    for _ in range(nothing):
        stock.take(0)
    out: list[list[int]] = []
    while stock.left:
        first = stock.take(stock.present[-1])
        held, gap = [first], capacity - first
        while gap > 0 and stock.left:
            if gap <= 3 * stock.present[-1] and (found := stock.exact(gap)):
                held += [stock.take(n) for n in found]
                gap = 0
                break
            best = stock.largest(gap)
            if best is None:
                break
            held.append(stock.take(best))
            gap -= best
        out.append(held)
    if nothing:  # empty items take no room
        out = out or [[]]
        out[-1] += [0] * nothing
    return out


def assign(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The number of each item's container."""
    order = np.argsort(lengths, kind="stable")
    first = {int(n): int(k) for n, k in zip(*np.unique(lengths[order], return_index=True))}
    bins = np.empty(len(lengths), np.int64)
    for no, held in enumerate(pack_lengths(lengths, capacity)):
        for n in held:
            bins[order[first[n]]] = no
            first[n] += 1
    return bins


def _pack_blocks(parts: DataFrame, round_no: int, block_items: int) -> DataFrame:
    """Give each part of each block a container: adds batch_no (unique within conf_id)."""
    blocks = parts.groupBy("conf_id").agg(F.ceil(F.count("*") / block_items).alias("_blocks"))
    dealt = parts.join(blocks, "conf_id").withColumn("_block", F.pmod(F.xxhash64("item", "part"), "_blocks")).drop("_blocks")

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        sizes = t.column("tokens").to_numpy()
        cap = t.column("capacity")[0].as_py()
        bins = assign(sizes, cap) + (round_no << 60 | key[1].as_py() << 24)
        fill = dict(zip(*(x.tolist() for x in _sums(bins, sizes))))
        return t.drop_columns(["_block"]).append_column("batch_no", pa.array(bins)).append_column("filled", pa.array([fill[b] for b in bins.tolist()], pa.int64()))

    schema = parts.select("*", F.lit(0).cast("long").alias("batch_no"), F.lit(0).cast("long").alias("filled")).schema
    return dealt.select(*parts.columns, "_block").groupBy("conf_id", "_block").applyInArrow(pack, schema)


def packing_faults(items: DataFrame, confs: DataFrame, packed: DataFrame, default_capacity: int = 96_000) -> DataFrame:
    """Per conf_id: items, tokens, and what must be 0: overfull containers, items with lost or repeated tokens, needless splits, and parts of wrong size.

    ``packed``: as from ``pack_items`` for the same ``items`` and ``confs``.
    """
    due = items.join(confs.select("conf_id", "grp", F.greatest(F.coalesce("capacity", F.lit(default_capacity)), F.lit(1)).alias("_cap")), "grp")
    due = due.select("conf_id", "item", F.greatest(F.coalesce(F.col("tokens").cast("long"), F.lit(0)), F.lit(0)).alias("_n"), "_cap")
    got = packed.groupBy("conf_id", "item").agg(F.sum("tokens").alias("_held"), F.count("*").alias("_parts"), F.countDistinct("part").alias("_kinds"))
    per = due.join(got, ["conf_id", "item"], "full").groupBy("conf_id").agg(
        F.count("_n").alias("items"), F.sum("_n").alias("tokens"),
        F.count_if(~F.coalesce((F.col("_held") == F.col("_n")) & (F.col("_parts") == F.col("_kinds")), F.lit(False))).alias("lost"),
        F.count_if(F.col("_parts") > F.greatest(F.ceil(F.col("_n") / F.col("_cap")), F.lit(1))).alias("needless_splits"),
    )
    bins = packed.groupBy("conf_id", "batch_no").agg(F.sum("tokens").alias("_s"), F.max("capacity").alias("_cap"), F.max("filled").alias("_filled"))
    faults = bins.groupBy("conf_id").agg(F.count_if(F.col("_s") > F.col("_cap")).alias("overfull"), F.count_if(F.col("_s") != F.col("_filled")).alias("miscounted"))
    return per.join(faults, "conf_id", "left").na.fill(0, ["overfull", "miscounted"])


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(keys, return_inverse=True)
    return names, np.bincount(at, weights=values).astype(np.int64)


def pack_items(items: DataFrame, confs: DataFrame, default_capacity: int = 96_000, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Parts of all items with the container each went to.

    ``items``: item (bigint, unique), grp, tokens (null or negative: 0). ``confs``: conf_id, grp and
    capacity (null: ``default_capacity``; under 1: 1). Returns conf_id, batch_no (a name, unique within conf_id), item, part, parts,
    tokens, capacity, filled. An item within the capacity has one part; a longer one has full parts,
    each a container of its own, and a rest that is packed like an item. Items whose group has no
    configuration, or none at all, have no row; a group with two configurations is packed for each.
    A group is dealt into blocks of about ``block_items`` by a hash of the item, so that no task
    holds an unbounded group; the containers left loose are packed once more, across the blocks.
    """
    rows = confs.select("conf_id", "grp", "capacity").limit(MAX_CONFS + 1).collect()
    if len(rows) > MAX_CONFS:
        raise ValueError(f"more than {MAX_CONFS} configurations")
    caps = confs.select("conf_id", "grp", F.greatest(F.coalesce("capacity", F.lit(default_capacity)).cast("long"), F.lit(1).cast("long")).alias("capacity"))
    size = F.greatest(F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    # at most MAX_CONFS rows, as checked above
    sized = items.select("item", "grp", size.alias("tokens")).join(F.broadcast(caps), "grp").drop("grp")
    n = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1).cast("long")).cast("int")
    parts = sized.withColumn("parts", n).withColumn("part", F.explode(F.sequence(F.lit(1), "parts")))
    parts = parts.withColumn("tokens", F.least("capacity", F.col("tokens") - (F.col("part") - 1) * F.col("capacity")))
    parts = parts.select("conf_id", "item", "part", "parts", "tokens", "capacity")
    full = parts.where("parts > 1 AND tokens = capacity")
    # a full part is a container of its own, named by item and part; those of the blocks go by number
    alone = full.select("*", F.concat_ws("-", F.lit("own"), "item", "part").alias("batch_no"), F.col("tokens").alias("filled"))
    # read twice below: what is loose, and what isn't
    packed = cut(_pack_blocks(parts.where("NOT (parts > 1 AND tokens = capacity)"), 0, block_items))
    loose = F.col("filled") < F.col("capacity") * (1 - LOOSE)
    again = _pack_blocks(packed.where(loose).drop("batch_no", "filled"), 1, block_items)
    out = packed.where(~loose).unionByName(again).withColumn("batch_no", F.col("batch_no").cast("string")).unionByName(alone)
    return out.select("conf_id", "batch_no", "item", "part", "parts", "tokens", "capacity", "filled")
