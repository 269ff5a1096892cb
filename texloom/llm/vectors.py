"""Problem 2: the most similar vectors of every vector, by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Vectors the two codebooks are fitted on at most (those with the least hashes); every vector is indexed.
FIT_VECTORS = 20_000
#: Entries a query looks at, at least: its cells are opened until they hold so many.
LOOK_AT = 1_500
#: Entries of one block of cells, about; a larger cell is split.
BLOCK_ENTRIES = 16_384
#: Queries from other blocks that meet a block's entries in one task, about; the entries are copied for more.
BLOCK_QUERIES = 65_536
MAX_CENTROIDS = 1_024


def usable(df: DataFrame, dim: int, id_col: str = "ids", vec_col: str = "embs") -> DataFrame:
    """id and vec of the rows with a vector of ``dim`` finite numbers that aren't all zero; an id may have several."""
    v = F.col("vec")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kind = dict(df.dtypes)[vec_col]
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("vec"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) == dim)).where(finite & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel()))


def _marks(m: np.ndarray) -> np.ndarray:
    """128 bits for each row, equal for equal rows."""
    m = np.ascontiguousarray(m + m.dtype.type(0))  # no negative zeros
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(r) for r in m), np.int64).reshape(-1, 2)


def _least_of_each(marks: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows with the ``most`` least ids of each mark, sorted by mark and id, and the number of each row among those of its mark."""
    order = np.lexsort((ids, marks[:, 1], marks[:, 0]))
    m = marks[order]
    first = np.concatenate([[True], (m[1:] != m[:-1]).any(axis=1)]) if len(m) else np.empty(0, bool)
    at = np.arange(len(m))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    return order[nth < most], nth[nth < most]


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that tiny and huge numbers survive being squared."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def fit_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means over the rows of ``x``."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    c = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(1)


class MultiIndex:
    """Codebooks of the two halves, the entries of each cell, and the blocks the cells lie in."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        cells = len(first) * len(second)
        self.count = np.zeros(cells, np.int64)
        #: the first block of each cell, and how many it has
        self.block, self.parts = np.zeros(cells, np.int64), np.ones(cells, np.int64)

    @classmethod
    def fit(cls, sample: np.ndarray, total: int, per_cell: int = 48) -> MultiIndex:
        k = int(min(MAX_CENTROIDS, max(2, round((total / per_cell) ** 0.5))))
        half = sample.shape[1] // 2
        return cls(fit_centroids(sample[:, :half], k), fit_centroids(sample[:, half:], k))

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to their centroids."""
        half = self.first.shape[1]
        return distances(unit[:, :half], self.first), distances(unit[:, half:], self.second)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        d1, d2 = self.halves(unit)
        return d1.argmin(1) * len(self.second) + d2.argmin(1)

    def block_of(self, cells: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The block of each entry: equal vectors lie in one."""
        spread = np.ascontiguousarray(marks[:, 0]).view(np.uint64) % self.parts[cells].astype(np.uint64)
        return self.block[cells] + spread.astype(np.int64)

    def lay_out(self, counts: dict[int, int], block_entries: int = BLOCK_ENTRIES) -> None:
        """Deal the cells into blocks of at most about ``block_entries``, cells near each other into one; a larger cell gets several of its own.

        Cells are halved by their weight along the direction in which their centroids spread most,
        again and again, until a half fits into a block.
        """
        for cell, n in counts.items():
            self.count[cell] = n
        there = np.flatnonzero(self.count)
        todo, block = [there], 0
        while todo:
            group = todo.pop()
            n = self.count[group]
            if len(group) <= 1 or n.sum() <= block_entries:
                if len(group):
                    self.block[group] = block
                    parts = -(-int(n.sum()) // block_entries) if len(group) == 1 else 1
                    self.parts[group] = parts
                    block += parts
                continue
            along = self._spread(group, n)
            order = np.argsort(along, kind="stable")
            upto = np.cumsum(n[order])
            at = int(np.clip(np.searchsorted(upto, upto[-1] / 2) + 1, 1, len(group) - 1))
            todo += [group[order[at:]], group[order[:at]]]

    def _spread(self, group: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The place of each cell along the direction of greatest spread, found by a few power iterations over the codebooks alone."""
        i, j = np.divmod(group, len(self.second))
        w1, w2 = np.bincount(i, weight, len(self.first)), np.bincount(j, weight, len(self.second))
        a, b = self.first - w1 @ self.first / w1.sum(), self.second - w2 @ self.second / w2.sum()
        rng = np.random.default_rng(3)
        u, v = rng.standard_normal(a.shape[1]), rng.standard_normal(b.shape[1])
        for _ in range(6):
            along = ((a @ u)[i] + (b @ v)[j]) * weight
            u, v = np.bincount(i, along, len(a)) @ a, np.bincount(j, along, len(b)) @ b
            norm = np.sqrt(u @ u + v @ v)
            if not norm:
                break
            u, v = u / norm, v / norm
        return (a @ u)[i] + (b @ v)[j]

    def visit(self, d1: np.ndarray, d2: np.ndarray, look_at: int) -> tuple[list[int], float]:
        """Cells by ascending sum of both distances, from a heap, until they hold ``look_at`` entries, and the last one's sum."""
        o1, o2 = d1.argsort(), d2.argsort()
        s1, s2 = d1[o1].tolist(), d2[o2].tolist()
        o1, o2 = o1.tolist(), o2.tolist()
        count, width, n1, n2 = self.count, len(self.second), len(s1), len(s2)
        heap = [(s1[0] + s2[0], 0, 0)]
        held, out, reach = 0, [], 0.0
        while heap and held < look_at:
            far, i, j = heapq.heappop(heap)
            cell = o1[i] * width + o2[j]
            if n := count[cell]:
                out.append(cell)
                held += n
                reach = far
            # each pair is pushed by one neighbour only: (i, j) by (i, j-1), and (i, 0) by (i-1, 0)
            if j + 1 < n2:
                heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
            if j == 0 and i + 1 < n1:
                heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
        return out, reach


def best_of(q: np.ndarray, ids: np.ndarray, entries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and cosines of its k best entries; equal cosines go to the smaller id."""
    wide = min(len(ids), k + 6)
    for at in range(0, len(q), 512):
        part = q[at : at + 512]
        scores = part @ entries.T
        near = np.argpartition(scores, len(ids) - wide, axis=1)[:, len(ids) - wide :]
        rough = np.take_along_axis(scores, near, axis=1)
        # summed alike for each entry, so that equal vectors get equal cosines
        exact = (entries[near] * part[:, None, :]).sum(axis=2)
        order = np.lexsort((ids[near], -exact), axis=1)[:, :k]
        best, cosines = np.take_along_axis(ids[near], order, axis=1), np.take_along_axis(exact, order, axis=1)
        # where more entries tie with the last one than were taken, within rounding, all that do are looked at
        least = rough.min(axis=1)
        tied = (wide < len(ids)) & (cosines[:, -1] <= least + 1e-12)
        for row in range(len(part)):
            if tied[row]:
                all_ = np.flatnonzero(scores[row] >= least[row] - 1e-12)
                e = (entries[all_] * part[row]).sum(axis=1)
                o = np.lexsort((ids[all_], -e))[:k]
                yield ids[all_][o], e[o]
            else:
                yield best[row], cosines[row]


FOUND = "h1 bigint, h2 bigint, found array<struct<n:double,id:bigint>>"


def _meet_block(index: MultiIndex, dim: int, k: int, own: bool, asks: pa.Table, held: pa.Table) -> pa.Table:
    """The best entries of a block for its own vectors, if ``own``, and for those sent from other blocks; a query sees the cells within its reach."""
    out_type = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("found", pa.list_(pa.struct([("n", pa.float64()), ("id", pa.int64())])))])
    if not held.num_rows:
        return out_type.empty_table()
    both = lambda t: np.stack([t.column("h1").to_numpy(), t.column("h2").to_numpy()], axis=1)
    keep, nth = _least_of_each(both(held), held.column("id").to_numpy(), k)
    ids, marks, cells = held.column("id").to_numpy()[keep], both(held)[keep], held.column("cell").to_numpy()[keep]
    entries, reach = unit_rows(_matrix(held.column("vec"), dim)[keep].astype(np.float64)), held.column("reach").to_numpy()[keep]
    q, r, m, home = [], [], [], []
    if own:
        one = nth == 0
        q, r, m, home = [entries[one]], [reach[one]], [marks[one]], [cells[one]]
    if asks.num_rows:
        some, _ = _least_of_each(both(asks), np.zeros(asks.num_rows), 1)
        q.append(unit_rows(_matrix(asks.column("vec"), dim)[some].astype(np.float64)))
        r.append(asks.column("reach").to_numpy()[some])
        m.append(both(asks)[some])
        home.append(asks.column("cell").to_numpy()[some])
    if not q:
        return out_type.empty_table()
    q, r, m, home = (np.concatenate(x) for x in (q, r, m, home))
    # entries by cell; queries of one cell look at nearly the same cells, and go together
    order = np.argsort(cells, kind="stable")
    ids, entries = ids[order], entries[order]
    there, start = np.unique(cells[order], return_index=True)
    end = np.append(start[1:], len(order))
    c1, c2 = np.divmod(there, len(index.second))
    by_home = np.argsort(home, kind="stable")
    q, r, m, home = q[by_home], r[by_home], m[by_home], home[by_home]
    borders = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]]))
    sizes, all_ids, all_cos, met = [0], [], [], []
    for a, b in zip(borders[:-1], borders[1:]):
        d1, d2 = index.halves(q[a:b])
        seen = (d1[:, c1] + d2[:, c2] <= r[a:b, None] * (1 + 1e-9) + 1e-12).any(axis=0)
        rows = np.concatenate([np.arange(x, y) for x, y in zip(start[seen], end[seen])]) if seen.any() else np.empty(0, np.int64)
        if not len(rows):
            continue
        for i, c in best_of(q[a:b], ids[rows], entries[rows], k):
            sizes.append(sizes[-1] + len(i))
            all_ids.append(i)
            all_cos.append(c)
        met.append(m[a:b])
    if not met:
        return out_type.empty_table()
    m = np.concatenate(met)
    lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(-np.concatenate(all_cos)), pa.array(np.concatenate(all_ids))], names=["n", "id"]))
    return pa.Table.from_arrays([pa.array(m[:, 0]), pa.array(m[:, 1]), lists], schema=out_type)


def most_similar(vectors: DataFrame, dim: int = 96, k: int = 10, look_at: int = LOOK_AT, block_entries: int = BLOCK_ENTRIES, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """id, rank (from 1), neighbor and cosine: the ``k`` most similar vectors of other ids.

    ``vectors``: as from ``usable``; of an id with several vectors the greatest one, number by number, counts.
    Equal cosines go to the smaller id. Fewer than k rows come out only where there are fewer other
    ids. Equal vectors lie in one block, which keeps the k+1 least of their ids (no other can be
    among the k best) and searches for them once.
    The halves of the vectors, made unit length, are quantised by two codebooks fitted on at most
    FIT_VECTORS of them; every vector is an entry of the cell of its two centroids, and cells near each other share a block. A query takes
    cells from a heap by the sum of both distances until they hold ``look_at`` entries. It meets the
    entries of these cells in its own block, where it lies as an entry anyway, and is sent as it was
    stored to each other block they lie in; there the cells within the same sum are looked at, in one
    matrix product for all queries of a cell, and the best of all blocks are merged.
    Cells that hold more than a block are split, and a block that many
    queries are sent to is copied, so the work of a task is bounded. Approximate: recall against brute
    force is measured in the tests and the README.
    """
    if dim % 2:
        raise ValueError("an even number of dimensions is needed")
    spark = vectors.sparkSession
    total = vectors.count()
    if total == 0:
        return spark.createDataFrame([], "id bigint, rank int, neighbor bigint, cosine double")
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(FIT_VECTORS).select("vec").toArrow()
    fitted = MultiIndex.fit(unit_rows(_matrix(sample.column("vec"), dim).astype(np.float64)), total)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column("vec"), dim)
                kept, _ = _least_of_each(_marks(m), b.column("id").to_numpy(), k + 1)
                cell, n = np.unique(fitted.cells(unit_rows(m[kept].astype(np.float64))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    # at most MAX_CENTROIDS squared sums
    counted = vectors.select("id", "vec").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    fitted.lay_out({r["cell"]: r["n"] for r in counted.collect()}, block_entries)
    shared = spark.sparkContext.broadcast(fitted)  # two codebooks of MAX_CENTROIDS, and three numbers for each of their pairs

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column("vec"), dim)
            marks = _marks(m)
            unit = unit_rows(m.astype(np.float64))
            d1, d2 = index.halves(unit)
            cell = d1.argmin(1) * len(index.second) + d2.argmin(1)
            block = index.block_of(cell, marks)
            one, _ = _least_of_each(marks, b.column("id").to_numpy(), 1)
            reach, others = np.zeros(len(m)), [None] * len(m)
            first = {}
            for r in one.tolist():
                cells, reach[r] = index.visit(d1[r], d2[r], look_at)
                first[marks[r].tobytes()] = r
                near = {int(x) for c in cells for x in range(index.block[c], index.block[c] + index.parts[c])}
                others[r] = sorted(near - {int(block[r])})
            for r in range(len(m)):  # copies reach as far as the first of them
                reach[r] = reach[first[marks[r].tobytes()]]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(cell), pa.array(block), pa.array(reach), pa.array(others, pa.list_(pa.int64())), b.column("vec")],
                names=["id", "h1", "h2", "cell", "block", "reach", "others", "vec"],
            )

    kind = dict(vectors.dtypes)["vec"]
    one_each = vectors.groupBy("id").agg(F.max("vec").alias("vec"))
    placed = stored(one_each.mapInArrow(place, f"id bigint, h1 bigint, h2 bigint, cell bigint, block bigint, reach double, others array<bigint>, vec {kind}"))
    load = placed.select(F.explode("others").alias("block")).groupBy("block").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("copies"))
    asks = placed.select(F.explode("others").alias("block"), "h1", "h2", "cell", "reach", "vec")
    # a row for each block that is asked by more than block_queries; small or not, AQE sees its size
    busy = stored(load.where("copies > 1"))
    copies = F.coalesce("copies", F.lit(1)).cast("bigint")
    asks = asks.join(busy, "block", "left").select("block", F.pmod(F.col("h1"), copies).alias("copy"), "h1", "h2", "cell", "reach", "vec")

    def limit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                kept, _ = _least_of_each(np.stack([b.column("h1").to_numpy(), b.column("h2").to_numpy()], axis=1), b.column("id").to_numpy(), k + 1)
                yield b.take(pa.array(kept))

    entry = placed.select("id", "h1", "h2", "cell", "block", "reach", "vec")
    entry = entry.mapInArrow(limit, entry.schema).join(busy, "block", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1))).drop("copies")

    def meet(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return _meet_block(shared.value, dim, k + 1, key[1].as_py() == 0, left, right)

    met = asks.groupBy("block", "copy").cogroup(entry.groupBy("block", "copy")).applyInArrow(meet, FOUND)
    # negated cosines, so that the natural order of the pairs is the wanted one
    top = met.groupBy("h1", "h2").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
    # every id of a vector has the list of its equals, without itself
    mine = placed.select("id", "h1", "h2").join(top, ["h1", "h2"])
    mine = mine.select("id", F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k).alias("found"))
    return mine.select("id", F.posexplode("found").alias("rank", "f")).select(
        "id", (F.col("rank") + 1).alias("rank"), F.col("f.id").alias("neighbor"), (-F.col("f.n")).alias("cosine")
    )


def similar_pairs(neighbors: DataFrame) -> DataFrame:
    """id_a < id_b: each pair of which at least one is among the most similar of the other."""
    return neighbors.select(F.least("id", "neighbor").alias("id_a"), F.greatest("id", "neighbor").alias("id_b")).distinct()
