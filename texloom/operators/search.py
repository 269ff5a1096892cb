"""Similarity search: exact, by margin, and through inverted lists, of whole vectors or of product codes of their residuals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..session import cut
from .arrow import lists, map_batches, matrix

#: Vectors of either side that meet in one task, about.
QUERY_BLOCK, TARGET_BLOCK = 4_096, 65_536
#: Numbers of a codebook that is sent to all executors; a larger one is met in blocks, as vectors are.
BOOK_NUMBERS = 1 << 23


def normalised(df: DataFrame, vec: str, out: str = "vec", *keep: str) -> DataFrame:
    """``keep`` and ``out``: the vector over its length. Null vectors are left out, zero vectors stay."""
    rows = df.where(F.col(vec).isNotNull()).select(*keep, F.col(vec).cast("array<double>").alias("_v"))
    return rows.withColumn("_n", V.norm(F.col("_v"))).select(*keep, V.scaled(F.col("_v"), F.col("_n")).alias(out))


def exact_knn(queries: DataFrame, targets: DataFrame, k: int, query_block: int = QUERY_BLOCK, target_block: int = TARGET_BLOCK) -> DataFrame:
    """q, t, sim and rank of the ``k`` targets with the greatest inner product; equal ones by the least t.

    ``queries``: q (bigint), vec. ``targets``: t (bigint), vec; vectors of equal length. Both sides are dealt into blocks by a hash,
    each block of queries meets each block of targets in a matrix product, and the best of all
    blocks are merged. Nothing is broadcast, and no task holds more than a block of either side.
    """
    nq = max(1, -(-queries.count() // query_block))
    nt = max(1, -(-targets.count() // target_block))

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own)
        return df.select(F.col(key).alias(key), F.col("vec").alias(f"{key}vec"), block, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    q, t = dealt(queries, "q", "qb", nq, "tb", nt), dealt(targets, "t", "tb", nt, "qb", nq)
    empty = pa.schema([("q", pa.int64()), ("t", pa.int64()), ("sim", pa.float64())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty.empty_table()
        sims = matrix(left.column("qvec")) @ matrix(right.column("tvec")).T
        ids = right.column("t").to_numpy()
        if len(ids) > k:  # with all that tie with the last one, within rounding
            least = np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k]
            rows, cols = np.nonzero(sims >= least[:, None] - 1e-9)
        else:
            rows, cols = np.indices(sims.shape).reshape(2, -1)
        return pa.Table.from_arrays([pa.array(left.column("q").to_numpy()[rows]), pa.array(ids[cols]), pa.array(sims[rows, cols])], schema=empty)

    met = q.groupBy("qb", "tb").cogroup(t.groupBy("qb", "tb")).applyInArrow(meet, "q bigint, t bigint, sim double")
    return top(met, k)


def top(scores: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The ``k`` best t of each q, with their rank. Similarities are compared as rounded, so that engines agree on ties."""
    best = Window.partitionBy("q").orderBy(F.col("sim").desc(), F.col("t"))
    return scores.withColumn("sim", F.round("sim", digits)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def without_self(knn: DataFrame, k: int) -> DataFrame:
    """``k`` of k+1 neighbours: rank 1 is dropped where it is the query itself, otherwise the last one; ranked anew."""
    own = F.max(F.when((F.col("rank") == 1) & (F.col("q") == F.col("t")), 1).otherwise(0)).over(Window.partitionBy("q"))
    rows = knn.withColumn("_own", own).withColumn("rank", F.col("rank") - F.col("_own"))
    return rows.where((F.col("rank") >= 1) & (F.col("rank") <= k)).drop("_own")


def margin_knn(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """q, t, sim (cosine over the mean of both neighbourhoods' mean cosines) and rank of the ``k`` nearest targets.

    The means are over the k neighbours of the query among the targets and of the target among the queries.
    """
    forth = exact_knn(queries, targets, k)
    back = exact_knn(targets.select(F.col("t").alias("q"), "vec"), queries.select(F.col("q").alias("t"), "vec"), k)
    mean_q = forth.groupBy("q").agg(F.avg("sim").alias("_a"))
    mean_t = back.groupBy(F.col("q").alias("t")).agg(F.avg("sim").alias("_b"))
    scored = forth.join(mean_q, "q").join(mean_t, "t").select("q", "t", V.ratio(F.col("sim"), (F.col("_a") + F.col("_b")) / 2).alias("sim"))
    return top(scored, k)


def _book(df: DataFrame, *names: str) -> pa.Table | None:
    """A codebook as a table, in the order of ``names``; None if it is larger than BOOK_NUMBERS."""
    rows = df.select(*names, "vec").limit(BOOK_NUMBERS // 8 + 1)
    if (rows.agg(F.sum(F.size("vec"))).first()[0] or 0) > BOOK_NUMBERS:
        return None
    return rows.toArrow().sort_by([(n, "ascending") for n in names])


def assigned(vectors: DataFrame, centers: DataFrame, probes: int = 1) -> DataFrame:
    """id, vec, center and place of the ``probes`` centers with the greatest inner product; equal ones by the least center.

    ``vectors``: id, vec. ``centers``: center (bigint), vec. A codebook of up to BOOK_NUMBERS numbers is sent to all
    executors, and the vectors stay where they are; a larger one meets them in blocks.
    """
    book = _book(centers, "center")
    if book is None:
        near = exact_knn(vectors.select(F.col("id").alias("q"), "vec"), centers.select(F.col("center").alias("t"), "vec"), probes)
        return vectors.join(near.select(F.col("q").alias("id"), F.col("t").alias("center"), F.col("rank").alias("place")), "id")
    schema = T.StructType([*vectors.select("id", "vec").schema.fields, T.StructField("center", T.LongType()), T.StructField("place", T.IntegerType())])
    if not book.num_rows:
        return vectors.sparkSession.createDataFrame([], schema)
    names, c = book.column("center").to_numpy(), matrix(book.column("vec"))
    k = min(probes, len(names))

    def near(b: pa.RecordBatch) -> pa.RecordBatch:
        sims = np.round(matrix(b.column("vec")) @ c.T, 9)
        best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        rows = pa.array(np.repeat(np.arange(b.num_rows), k))
        place = np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)
        return pa.RecordBatch.from_arrays([b.column("id").take(rows), b.column("vec").take(rows), pa.array(names[best.ravel()]), pa.array(place)], names=["id", "vec", "center", "place"])

    return map_batches(vectors.select("id", "vec"), schema, near)


def _k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    c = np.unique(x, axis=0)
    c = c[np.random.default_rng(seed).choice(len(c), min(k, len(c)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


CENTERS = T.StructType([T.StructField("center", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])
BOOKS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("code", T.IntegerType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])


def fit_centers(vectors: DataFrame, k: int, sample: int = 20_000, rounds: int = 10, seed: int = 11) -> DataFrame:
    """center, vec: k-means centers of at most ``sample`` vectors, those with the least hashes of their ids."""
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow()
    spark = vectors.sparkSession
    if not some.num_rows:
        return spark.createDataFrame([], CENTERS)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(_k_means(matrix(some.column("vec")), k, rounds, seed))], CENTERS)


def fit_books(residuals: DataFrame, parts: int, codes: int, sample: int = 20_000, rounds: int = 10, seed: int = 13) -> DataFrame:
    """part, code, vec: k-means codebooks of the parts of at most ``sample`` residuals, those with the least hashes of their ids."""
    some = residuals.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow()
    spark = residuals.sparkSession
    if not some.num_rows:
        return spark.createDataFrame([], BOOKS)
    x = matrix(some.column("vec"))
    size = x.shape[1] // parts
    rows = [(p, i, v.tolist()) for p in range(parts) for i, v in enumerate(_k_means(x[:, p * size : (p + 1) * size], codes, rounds, seed + p))]
    return spark.createDataFrame(rows, BOOKS)


def numbered_centers(batch: DataFrame) -> DataFrame:
    """Adds number: the centers of each batch, from 0. ``batch``: batch, center; a batch is what is trained on at once."""
    once = batch.select("batch", "center").distinct()
    number = (F.dense_rank().over(Window.partitionBy("batch").orderBy("center")) - 1).alias("number")
    return batch.join(once.select("batch", "center", number), ["batch", "center"])


def center_statistics(postings: DataFrame) -> DataFrame:
    """One row: centers in use, and least, greatest and mean number of vectors."""
    n = postings.groupBy("center").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("centers"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


def _in_lists(probed: DataFrame, postings: DataFrame, columns: list[str], k: int, score, list_block: int) -> DataFrame:
    """q, t, sim and rank of the ``k`` best of the lists each query probes; ``score``: from tables of the queries and entries of a list to a matrix.

    A list of more than ``list_block`` entries is cut, and its queries meet each piece; many queries of a list are dealt over several tasks alike.
    """
    sizes = postings.groupBy("center").agg(F.ceil(F.count("*") / list_block).cast("int").alias("_n"))
    asks = probed.groupBy("center").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("_m"))
    both = sizes.join(asks, "center")  # a row per list that is asked
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n).cast("bigint")).cast("int")
    q = probed.join(both, "center").select("*", dealt("q", "_m").alias("_qb"), each("_n").alias("_tb"))
    t = postings.withColumnRenamed("id", "t").join(both, "center").select("*", dealt("t", "_n").alias("_tb"), each("_m").alias("_qb")).select("center", "_qb", "_tb", "t", *columns)
    empty = pa.schema([("q", pa.int64()), ("t", pa.int64()), ("sim", pa.float64())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty.empty_table()
        sims, ids = score(left, right), right.column("t").to_numpy()
        if len(ids) > k:  # with all that tie with the last one, within rounding
            least = np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k]
            rows, cols = np.nonzero(sims >= least[:, None] - 1e-9)
        else:
            rows, cols = np.indices(sims.shape).reshape(2, -1)
        return pa.Table.from_arrays([pa.array(left.column("q").to_numpy()[rows]), pa.array(ids[cols]), pa.array(sims[rows, cols])], schema=empty)

    key = ["center", "_qb", "_tb"]
    return top(q.groupBy(*key).cogroup(t.groupBy(*key)).applyInArrow(meet, "q bigint, t bigint, sim double"), k)


def ivf_search(queries: DataFrame, postings: DataFrame, centers: DataFrame, k: int, probes: int, list_block: int = TARGET_BLOCK) -> DataFrame:
    """q, t, sim and rank of the ``k`` best among the vectors whose center is one of the query's ``probes`` nearest.

    ``postings``: id, vec, center. Queries and entries of a list meet in a matrix product.
    """
    probed = assigned(queries.select(F.col("q").alias("id"), "vec"), centers, probes).select(F.col("id").alias("q"), F.col("vec").alias("qvec"), "center")
    return _in_lists(probed, postings.select("id", "vec", "center"), ["vec"], k, lambda a, b: matrix(a.column("qvec")) @ matrix(b.column("vec")).T, list_block)


def index_recall(found: DataFrame, exact: DataFrame, levels: list[int], gold: int = 1) -> DataFrame:
    """level and recall: of the ``gold`` exact nearest neighbours of each query, the share that stands among the first ``level`` found."""
    wanted = exact.where(F.col("rank") <= gold).select("q", "t")
    hits = wanted.join(found.select("q", "t", F.col("rank").alias("hit")), ["q", "t"], "left").select("hit", F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"))
    return hits.groupBy("level").agg(F.round(F.avg(F.when(F.col("hit") <= F.col("level"), 1.0).otherwise(0.0)), 6).alias("recall"))


def mapped_recall(found: DataFrame, mapping: DataFrame, levels: list[int]) -> DataFrame:
    """level and recall: of all targets a mapping (q, t) has for its queries, the share that stands among the first ``level`` found."""
    hits = mapping.select("q", "t").distinct().join(found.select("q", "t", F.col("rank").alias("hit")), ["q", "t"], "left").select("hit", F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"))
    return hits.groupBy("level").agg(F.round(F.avg(F.when(F.col("hit") <= F.col("level"), 1.0).otherwise(0.0)), 6).alias("recall"))


def residuals(posted: DataFrame, centers: DataFrame) -> DataFrame:
    """The columns of ``posted`` (id, vec, center) with vec less its center."""
    book = centers.select("center", F.col("vec").alias("_c"))
    return posted.join(book, "center").withColumn("vec", F.zip_with("vec", "_c", lambda x, y: x - y)).drop("_c")


def _books(books: DataFrame) -> np.ndarray:
    """Codebooks of fixed size as parts x codes x numbers, codes without an entry at infinity."""
    rows = books.limit(BOOK_NUMBERS // 8 + 1).toArrow()
    if rows.num_rows * (len(rows.column("vec")[0]) if rows.num_rows else 0) > BOOK_NUMBERS:
        raise ValueError("codebooks of more than BOOK_NUMBERS numbers")
    part, code, v = rows.column("part").to_numpy(), rows.column("code").to_numpy(), matrix(rows.column("vec"))
    out = np.full((part.max(initial=-1) + 1, code.max(initial=-1) + 1, v.shape[1]), np.inf)
    out[part, code] = v
    return out


def quantised(vectors: DataFrame, books: DataFrame) -> DataFrame:
    """The columns of ``vectors`` but vec, and codes: for each part of vec the nearest entry of that part's codebook (the least code of equals).

    ``books``: part, code, vec; parts of equal length, from 0, at most BOOK_NUMBERS numbers, sent to all executors.
    """
    book = _books(books)
    rest = [c for c in vectors.columns if c != "vec"]
    schema = T.StructType([*vectors.select(*rest).schema.fields, T.StructField("codes", T.ArrayType(T.IntegerType()))])

    def nearest(b: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(b.column("vec")).reshape(b.num_rows, len(book), -1)
        there = np.isfinite(book[:, :, 0])
        codes = np.empty((b.num_rows, len(book)), np.int32)
        for p in range(len(book)):
            far = ((x[:, p, None, :] - np.where(there[p, :, None], book[p], 0)[None]) ** 2).sum(axis=2)
            codes[:, p] = np.where(there[p], np.round(far, 9), np.inf).argmin(axis=1)
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), lists(codes)], names=[*rest, "codes"])

    return map_batches(vectors, schema, nearest)


def soft_codes(vectors: DataFrame, books: DataFrame, temperature: float = 1.0) -> DataFrame:
    """The columns of ``vectors`` but vec, and vec: each part as the mean of its codebook's entries, weighted by the softmax of their negative squared distance over ``temperature``."""
    book = _books(books)
    rest = [c for c in vectors.columns if c != "vec"]

    def soften(b: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(b.column("vec")).reshape(b.num_rows, len(book), -1)
        out = np.empty_like(x)
        for p in range(len(book)):
            entries = book[p][np.isfinite(book[p, :, 0])]
            far = ((x[:, p, None, :] - entries[None]) ** 2).sum(axis=2) / temperature
            w = np.exp(far.min(axis=1, keepdims=True) - far)
            out[:, p] = (w / w.sum(axis=1, keepdims=True)) @ entries
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), lists(out.reshape(b.num_rows, -1))], names=[*rest, "vec"])

    return map_batches(vectors, T.StructType([*vectors.select(*rest).schema.fields, T.StructField("vec", T.ArrayType(T.DoubleType()))]), soften)


def reconstructed(coded: DataFrame, books: DataFrame) -> DataFrame:
    """The columns of ``coded`` but codes, and vec: what the codes stand for."""
    book = _books(books)
    rest = [c for c in coded.columns if c != "codes"]

    def build(b: pa.RecordBatch) -> pa.RecordBatch:
        codes = b.column("codes").flatten().to_numpy().reshape(b.num_rows, len(book))
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), lists(book[np.arange(len(book)), codes].reshape(b.num_rows, -1))], names=[*rest, "vec"])

    return map_batches(coded, T.StructType([*coded.select(*rest).schema.fields, T.StructField("vec", T.ArrayType(T.DoubleType()))]), build)


def product_codes(vectors: DataFrame, books: DataFrame) -> DataFrame:
    """id, part, code: the codes of each vector, a row per part."""
    return quantised(vectors.select("id", "vec"), books).select("id", F.posexplode("codes").alias("part", "code"))


def build_index(vectors: DataFrame, n_centers: int, parts: int, codes: int, sample: int = 20_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Centers, codebooks and postings (id, center, codes) of an index: each vector goes to the list of its best center, as the product code of what is left of it.

    Both are fitted on at most ``sample`` vectors; every vector is indexed.
    """
    centers = cut(fit_centers(vectors, n_centers, sample))
    left = residuals(assigned(vectors, centers, 1).select("id", "vec", "center"), centers)
    books = cut(fit_books(left, parts, codes, sample))
    return centers, books, quantised(left.select("id", "center", "vec"), books)


def index_postings(vectors: DataFrame, centers: DataFrame, books: DataFrame) -> DataFrame:
    """id, center, codes of vectors for an index that is there: appended to its postings, or in place of them."""
    return quantised(residuals(assigned(vectors, centers, 1).select("id", "vec", "center"), centers).select("id", "center", "vec"), books)


def ivfpq_search(queries: DataFrame, postings: DataFrame, centers: DataFrame, books: DataFrame, k: int, probes: int, list_block: int = TARGET_BLOCK) -> DataFrame:
    """q, t, sim and rank of the ``k`` best codes in the lists of the query's ``probes`` nearest centers.

    A code's similarity is the query's product with its center and, from a table of the query, those with the
    entries its residual's codes stand for. ``postings``: id, center, codes.
    """
    book = np.where(np.isfinite(_books(books)), _books(books), 0)
    probed = assigned(queries.select(F.col("q").alias("id"), "vec"), centers, probes).join(centers.select("center", F.col("vec").alias("_c")), "center")
    probed = probed.select(F.col("id").alias("q"), F.col("vec").alias("qvec"), "center", V.dot(F.col("vec"), F.col("_c")).alias("near"))

    def score(left: pa.Table, right: pa.Table) -> np.ndarray:
        x = matrix(left.column("qvec")).reshape(left.num_rows, len(book), -1)
        codes = right.column("codes").combine_chunks().flatten().to_numpy().reshape(right.num_rows, len(book))
        sims = np.repeat(left.column("near").to_numpy()[:, None], right.num_rows, axis=1)
        for p in range(len(book)):
            sims += (x[:, p] @ book[p].T)[:, codes[:, p]]
        return sims

    return _in_lists(probed, postings.select("id", "center", "codes"), ["codes"], k, score, list_block)
