"""Queries on vectors: search, pooling, indices and retrieval metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import classify as C
from ..operators import documents as D
from ..operators import encode as N
from ..operators import metrics as M
from ..operators import search as S
from ..session import cut, place
from ..sources import readers as R
from ..sources import sinks as K
from .tables import PAIRS, QUERY_STEP, SENTS, doc_vectors, pairs, sentences, table

LEVELS = [1, 3, 5, 10]
DIM, PARTS = 64, 8


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """id, label, vec of unit length."""
    return S.normalised(table(spark, d, "embeddings").withColumnRenamed("vec_id", "id"), "embedding", "vec", "id", "label")


def _queries(v: DataFrame) -> DataFrame:
    return v.where(F.col("id") % QUERY_STEP == 0).select(F.col("id").alias("q"), "vec")


def _targets(v: DataFrame) -> DataFrame:
    return v.select(F.col("id").alias("t"), "vec")


def _labels(v: DataFrame) -> DataFrame:
    return v.select("id", "label")


def _counts(v: DataFrame) -> DataFrame:
    """q, n: how many others have the label of each query."""
    return M.label_counts(_queries(v), _labels(v))


def _centers(v: DataFrame) -> DataFrame:
    """A center per label: the mean of its vectors."""
    return N.pool(v.select(F.col("label").cast("bigint").alias("center"), "vec"), ["center"]).select("center", F.transform("vec", lambda x: F.round(x, 9)).alias("vec"))


def _books(v: DataFrame) -> DataFrame:
    size = DIM // PARTS
    part = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.slice("vec", p * size + 1, size).alias("v")) for p in range(PARTS)])).alias("x")
    return _centers(v).select("center", part).select("x.part", F.col("center").alias("code"), F.col("x.v").alias("vec"))


def _shown(knn: DataFrame) -> DataFrame:
    return knn.select("q", "t", F.round("sim", 6).alias("sim"), "rank")


def normalised_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("id", V.rounded(F.col("vec"), 6).alias("vec"))


def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return _shown(S.exact_knn(_queries(v), _targets(v), 10))


def knn_drop_self(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return _shown(S.without_self(S.exact_knn(_queries(v), _targets(v), 6), 5))


def knn_margin(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return _shown(S.margin_knn(_queries(v), _targets(v), 5))


def _ten(v: DataFrame) -> DataFrame:
    return S.without_self(S.exact_knn(_queries(v), _targets(v), 11), 10)


def retrieval_rec_map(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return M.retrieval_at(M.marked_by_label(_ten(v), _labels(v)), _counts(v), LEVELS)


def retrieval_by_group(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return M.retrieval_at(M.marked_by_label(_ten(v), _labels(v)), _counts(v), LEVELS, v.select(F.col("id").alias("q"), F.col("label").alias("grp")))


def sent_retrieval_grid(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return M.prediction_grid(M.marked_by_label(_ten(v), _labels(v)), _counts(v), [1, 5, 10], [0.0, 0.2, 0.4])


def sent_retrieval_map(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return M.mean_average_precision(M.marked_by_label(_ten(v).where("sim > 0.2"), _labels(v)), _counts(v))


def matching_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    v = doc_vectors(spark, d).withColumn("n", V.norm(F.col("vec")))
    a, b = v.select(F.col("id").alias("src"), F.col("vec").alias("a"), F.col("n").alias("na")), v.select(F.col("id").alias("tgt"), F.col("vec").alias("b"), F.col("n").alias("nb"))
    both = pairs(spark, d).select("src", "tgt", "label").join(a, "src").join(b, "tgt")
    return M.threshold_sweep(both.select("label", F.round(V.cosine(F.col("a"), F.col("b"), F.col("na"), F.col("nb")), 9).alias("sim")), [x / 10 for x in range(2, 10)])


def matching_misses(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of which a vector is missing, by label."""
    _, misses = M.with_vectors(pairs(spark, d).select("src", "tgt", "label"), doc_vectors(spark, d))
    return misses.groupBy("label").agg(F.count("*").alias("pairs"))


def batch_center_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Centers of vectors in batches of 50 ids, numbered from 0 in each batch."""
    v = _vectors(spark, d)
    batch = _postings(v).select("id", "center", F.floor(F.col("id") / 50).alias("batch"))
    return S.numbered_centers(batch).select("id", "batch", "center", "number")


def pool_union_distractors(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return M.pooled_distinct(p.where("split = 'test'").select("src"), p.where("split = 'test'").select("tgt"), table(spark, d, "documents").where("source = 'manuals'").select("doc_id"))


def _pooled(spark: SparkSession, d: str, how: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return N.pool(rows, ["label"], how, order="vec_id").select("label", V.rounded(F.col("vec"), 6).alias("vec"))


def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    return _pooled(spark, d, "mean")


def max_pool(spark: SparkSession, d: str) -> DataFrame:
    return _pooled(spark, d, "max")


def first_last_pool(spark: SparkSession, d: str) -> DataFrame:
    return _pooled(spark, d, "first").withColumnRenamed("vec", "first").join(_pooled(spark, d, "last").withColumnRenamed("vec", "last"), "label")


def weighted_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("label").alias("model"), F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))
    return N.weighted_merge(rows, {k: (k + 1) / 55 for k in range(10)}).select("pos", F.round("value", 6).alias("value"))


def index_assignment(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return S.assigned(v.select("id", "vec"), _centers(v), 2).select("id", "center", "place")


def _postings(v: DataFrame) -> DataFrame:
    return S.assigned(v.select("id", "vec"), _centers(v), 1).select("id", "vec", "center")


def index_center_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.center_statistics(_postings(_vectors(spark, d)))


def ivf_search(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return _shown(S.ivf_search(_queries(v), _postings(v), _centers(v), 10, 3))


def _nearest(v: DataFrame, k: int) -> DataFrame:
    return S.without_self(S.exact_knn(_queries(v), _targets(v), k + 1), k)


def index_recall(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    found = S.without_self(S.ivf_search(_queries(v), _postings(v), _centers(v), 31, 3), 30)
    return S.index_recall(found, _nearest(v, 1), [1, 5, 30])


def index_mapped_recall(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    found = S.without_self(S.ivf_search(_queries(v), _postings(v), _centers(v), 31, 3), 30)
    return S.mapped_recall(found, _nearest(v, 3).select("q", "t"), [1, 5, 30])


def product_codes(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return S.product_codes(v.select("id", "vec"), _books(v))


def _left(v: DataFrame) -> DataFrame:
    return S.residuals(_postings(v), _centers(v)).select("id", "center", "vec")


def _left_books(v: DataFrame) -> DataFrame:
    """The residuals of the first 16 vectors as codebooks."""
    size = DIM // PARTS
    part = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.slice("vec", p * size + 1, size).alias("v")) for p in range(PARTS)])).alias("x")
    first = _left(v).where("id < 16").select(F.col("id").cast("int").alias("code"), part).select("x.part", "code", F.transform("x.v", lambda x: F.round(x, 9)).alias("vec"))
    return cut(first)


def ivfpq_search(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    books = _left_books(v)
    return _shown(S.ivfpq_search(_queries(v), S.quantised(_left(v), books), _centers(v), books, 10, 3))


def reconstruction_error(spark: SparkSession, d: str) -> DataFrame:
    """The mean squared distance of residuals from what their codes stand for."""
    v = _vectors(spark, d)
    books = _left_books(v)
    back = S.reconstructed(S.quantised(_left(v), books), books).select("id", F.col("vec").alias("b"))
    far = F.aggregate(F.zip_with("vec", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return _left(v).join(back, "id").agg(F.count("*").alias("vectors"), F.round(F.avg(far), 6).alias("error"))


def fitted_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of an index that is fitted, written, added to and read back, against exact search."""
    v = _vectors(spark, d)
    one, two = v.where("id % 2 = 0").select("id", "vec"), v.where("id % 2 = 1").select("id", "vec")
    path = place(spark)
    centers, books, postings = S.build_index(v.select("id", "vec"), 16, 16, 64)
    K.write_index(centers, postings.join(one.select("id"), "id", "left_semi"), path, books)
    centers, books, _ = R.read_index(spark, path)
    K.append_postings(S.index_postings(two, centers, books), path)
    centers, books, postings = R.read_index(spark, path)
    found = S.without_self(S.ivfpq_search(_queries(v), postings, centers, books, 31, 8), 30)
    return S.index_recall(found, _nearest(v, 1), [1, 5, 30])


def _label_scores(v: DataFrame) -> DataFrame:
    """q, t (a label), sim for every vector and label."""
    centers = _centers(v).select(F.col("center").alias("t"), "vec")
    c = S.exact_knn(v.select(F.col("id").alias("q"), "vec"), centers, max(1, centers.count()))
    return c.select("q", "t", "sim")


def classification_loss(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return M.cross_entropy(_label_scores(v), v.select(F.col("id").alias("q"), F.col("label").cast("bigint").alias("t")), margin=0.1, scale=20.0)


def bidirectional_loss(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    gold = v.select(F.col("id").alias("q"), F.col("label").cast("bigint").alias("t"))
    return M.cross_entropy(_label_scores(v), gold, scale=20.0).unionByName(M.cross_entropy(_label_scores(v), gold, scale=20.0, by="t"))


def distilled_loss(spark: SparkSession, d: str) -> DataFrame:
    """The loss of scores of one scale against those of another, and a weighted sum of it with the loss on labels."""
    v = _vectors(spark, d)
    scores = _label_scores(v)
    one = M.distillation_loss(scores.withColumn("sim", F.col("sim") * 20), scores.withColumn("sim", F.col("sim") * 8))
    two = M.cross_entropy(scores, v.select(F.col("id").alias("q"), F.col("label").cast("bigint").alias("t")), scale=20.0)
    return M.weighted_loss([(one, 0.5), (two, 2.0)])


def merged_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Metrics from the sums of two parts of the queries."""
    v = _vectors(spark, d)
    rows, n = M.marked_by_label(_ten(v), _labels(v)), _counts(v)
    return M.merged_metrics(*[M.retrieval_sums(rows.where(f"q % 100 = {x}"), n.where(f"q % 100 = {x}"), 10) for x in (0, 50)])


def head_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """The softmax of a head whose weights are the labels' centers, twelve times."""
    v = _vectors(spark, d)
    c = _centers(v).orderBy("center").collect()  # a row per label
    w = np.array([r["vec"] for r in c]).T * 12
    scores = D.head_scores(v.select(F.col("id").alias("doc_id"), "vec"), w, np.zeros(w.shape[1]), [int(r["center"]) for r in c])
    return scores.select("doc_id", "label", F.round("p", 6).alias("p"))


def fitted_head(spark: SparkSession, d: str) -> DataFrame:
    """Held-out accuracy of a head fitted on four fifths of the vectors."""
    v = _vectors(spark, d).select(F.col("id").alias("doc_id"), F.col("label").cast("int").alias("label"), "vec")
    w, b, labels = D.fit_head(v.where("doc_id % 5 <> 0"))
    best = C.by_rank(D.head_scores(v.where("doc_id % 5 = 0"), w, b, labels), 1)
    return best.select("doc_id", F.col("label").alias("said")).join(v, "doc_id").agg(F.count("*").alias("vectors"), F.round(F.avg((F.col("said") == F.col("label")).cast("double")), 6).alias("accuracy"))


def first_is_own(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    q = _pooled(spark, d, "max").select(F.col("label").cast("bigint").alias("q"), "vec")
    return M.first_is_own(S.exact_knn(q, _centers(v).select(F.col("center").alias("t"), "vec"), 10))


def recall_with_ties(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return M.recall_with_ties(_label_scores(v), v.select(F.col("id").alias("q"), F.col("label").cast("bigint").alias("t")), 3)


def doc_average_encode(spark: SparkSession, d: str) -> DataFrame:
    s = sentences(spark, d)
    tokens = s.select(F.floor(F.col("sent_id") / 1000).alias("doc_id"), F.floor(F.col("sent_id") % 1000 / 5).alias("sent_no"), F.explode("src").alias("token"))
    return N.average_hierarchy(tokens).select("doc_id", V.rounded(F.col("vec"), 6).alias("vec"))


def doc_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Document vectors by each layout, with its name."""
    s = sentences(spark, d)
    tokens = s.select(F.floor(F.col("sent_id") / 1000).alias("doc_id"), F.floor(F.col("sent_id") % 1000 / 5).alias("sent_no"), F.explode("src").alias("token"))
    out = None
    for layout in ("sents", "frags", "tokens"):
        one = N.average_hierarchy(tokens, layout=layout).select("doc_id", F.lit(layout).alias("layout"), V.rounded(F.col("vec"), 6).alias("vec"))
        out = one if out is None else out.unionByName(one)
    return out


def cache_hit_miss(spark: SparkSession, d: str) -> DataFrame:
    cache = doc_vectors(spark, d).withColumnRenamed("id", "doc_id")
    hit, miss = N.hits_and_misses(table(spark, d, "documents").select("doc_id"), cache, "doc_id")
    return hit.select("doc_id", F.lit(True).alias("cached")).unionByName(miss.select("doc_id", F.lit(False).alias("cached")))


QUERIES = [
    normalised_vectors, knn_cosine, knn_drop_self, knn_margin, retrieval_rec_map, retrieval_by_group, sent_retrieval_grid, sent_retrieval_map, matching_threshold_sweep, matching_misses, batch_center_numbers,
    pool_union_distractors, mean_pool, max_pool, first_last_pool, weighted_merge, index_assignment, index_center_stats, ivf_search, index_recall, index_mapped_recall, product_codes, ivfpq_search, reconstruction_error,
    fitted_index_recall, classification_loss, bidirectional_loss, distilled_loss, merged_retrieval, head_probabilities, fitted_head, first_is_own, recall_with_ties, doc_average_encode, doc_layouts, cache_hit_miss,
]

VEC = "raw AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), v AS (SELECT id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS vec FROM raw)"
SCORES = "q AS (SELECT id AS q, vec FROM v WHERE id % 50 = 0), s AS (SELECT q, id AS t, round(list_inner_product(q.vec, v.vec), 9) AS sim FROM q, v)"
KNN = VEC + ", " + SCORES + ", knn AS (SELECT q, t, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, t)::INT AS rank FROM s QUALIFY rank <= {k})"
LESS = (
    ", own AS (SELECT *, max(CASE WHEN rank = 1 AND q = t THEN 1 ELSE 0 END) OVER (PARTITION BY q) AS o FROM knn),"
    " less AS (SELECT q, t, sim, (rank - o)::INT AS rank FROM own WHERE rank - o BETWEEN 1 AND {n})"
)
GOLD = ", gold AS (SELECT a.id AS q, b.id AS t FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE a.id % 50 = 0), n AS (SELECT q, count(*) AS n FROM gold GROUP BY 1)"
REL = (
    ", rel AS (SELECT l.*, (g.t IS NOT NULL)::INT AS rel FROM less l LEFT JOIN gold g ON l.q = g.q AND l.t = g.t),"
    " hits AS (SELECT *, sum(rel) OVER (PARTITION BY q ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM rel)"
)
TEN = KNN.replace("{k}", "11") + LESS.replace("{n}", "10") + GOLD + REL
AT = (
    ", per AS (SELECT q, k, sum(rel) AS found, sum(rel * hits / rank) AS ap FROM hits, (SELECT unnest([1, 3, 5, 10]) AS k) WHERE rank <= k GROUP BY 1, 2),"
    " every AS (SELECT n.q, k, n, coalesce(found, 0) AS found, coalesce(ap, 0) AS ap, label AS grp FROM n CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS k) LEFT JOIN per USING (q, k) JOIN v ON v.id = n.q)"
)
AGG = "count(*) AS queries, round(sum(found) / sum(least(k, n)), 6) AS rec, round(sum(ap / least(k, n)) / count(*), 6) AS map"
MEANS = ", m AS (SELECT label AS center, i, round(avg(x), 9) AS x FROM (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v) GROUP BY 1, 2), c AS (SELECT center::BIGINT AS center, list(x ORDER BY i) AS vec FROM m GROUP BY 1)"
NEAR = ", near AS (SELECT id, vec, label, center, row_number() OVER (PARTITION BY id ORDER BY sim DESC, center)::INT AS place FROM (SELECT v.id, v.vec, v.label, c.center, round(list_inner_product(v.vec, c.vec), 9) AS sim FROM v, c))"
IVF = (
    ", probed AS (SELECT a.id AS q, a.vec, a.center FROM near a WHERE a.id % 50 = 0 AND place <= 3), ivf AS (SELECT q, t, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, t)::INT AS rank"
    " FROM (SELECT p.q, n.id AS t, round(list_inner_product(p.vec, n.vec), 9) AS sim FROM probed p JOIN near n ON n.center = p.center AND n.place = 1) QUALIFY rank <= {k})"
)
CODES = (
    ", books AS (SELECT p::INT AS part, center AS code, vec[p * 8 + 1 : p * 8 + 8] AS b FROM c, (SELECT unnest(range(8)) AS p)),"
    " codes AS (SELECT id, part, code FROM (SELECT id, part, code, row_number() OVER (PARTITION BY id, part ORDER BY round(d, 9), code) AS r FROM (SELECT v.id, part, code,"
    " list_sum(list_transform(list_zip(vec[part * 8 + 1 : part * 8 + 8], b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, books)) WHERE r = 1)"
)
PQ = (
    ", left_ AS (SELECT n.id, n.center, list_transform(list_zip(n.vec, c.vec), lambda z: z[1] - z[2]) AS r FROM near n JOIN c ON c.center = n.center WHERE place = 1),"
    " lbooks AS (SELECT p::INT AS part, id::INT AS code, list_transform(r[p * 8 + 1 : p * 8 + 8], lambda x: round(x, 9)) AS b FROM left_, (SELECT unnest(range(8)) AS p) WHERE id < 16),"
    " lcodes AS (SELECT id, center, part, code, d FROM (SELECT l.id, center, part, code,"
    " list_sum(list_transform(list_zip(r[part * 8 + 1 : part * 8 + 8], b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM left_ l, lbooks) QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY round(d, 9), code) = 1)"
)
LOSS = ", sc AS (SELECT v.id AS q, c.center AS t, round(list_inner_product(v.vec, c.vec), 9) AS sim, (v.label = c.center)::INT AS g FROM v, c)"


def _pool_sql(agg: str) -> str:
    return f"""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), p AS (SELECT label, i, {agg}(x) AS x FROM x GROUP BY 1, 2)
        SELECT label, list(round(x, 6) ORDER BY i) AS vec FROM p GROUP BY 1"""


def _loss_sql(margin: float, by: str) -> str:
    return f"""SELECT count(*) AS pairs, round(avg(l - s), 6) AS loss FROM (SELECT g, s, ln(sum(exp(s - m)) OVER (PARTITION BY {by})) + m AS l FROM
        (SELECT *, max(s) OVER (PARTITION BY {by}) AS m FROM (SELECT q, t, g, (sim - {margin} * g) * 20.0 AS s FROM sc))) WHERE g = 1"""


SQL = {
    "normalised_vectors": f"WITH {VEC} SELECT id, list_transform(vec, lambda x: round(x, 6)) AS vec FROM v",
    "knn_cosine": f"WITH {KNN.replace('{k}', '10')} SELECT q, t, round(sim, 6) AS sim, rank FROM knn",
    "knn_drop_self": f"WITH {KNN.replace('{k}', '6')}{LESS.replace('{n}', '5')} SELECT q, t, round(sim, 6) AS sim, rank FROM less",
    "knn_margin": f"""WITH {KNN.replace('{k}', '5')}, back AS (SELECT q, t, sim FROM s QUALIFY row_number() OVER (PARTITION BY t ORDER BY sim DESC, q) <= 5),
        a AS (SELECT q, avg(sim) AS a FROM knn GROUP BY 1), b AS (SELECT t, avg(sim) AS b FROM back GROUP BY 1),
        m AS (SELECT q, t, round(CASE WHEN a + b = 0 THEN 0 ELSE sim / ((a + b) / 2) END, 9) AS sim FROM knn JOIN a USING (q) JOIN b USING (t))
        SELECT q, t, round(sim, 6) AS sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, t)::INT AS rank FROM m""",
    "retrieval_rec_map": f"WITH {TEN}{AT} SELECT k, {AGG} FROM every GROUP BY k",
    "retrieval_by_group": f"WITH {TEN}{AT} SELECT k, grp, {AGG} FROM every GROUP BY GROUPING SETS ((k), (k, grp))",
    "sent_retrieval_grid": f"""WITH {TEN}, g AS (SELECT k, threshold, count(*) FILTER (WHERE rank <= k AND sim > threshold) AS predicted, sum(CASE WHEN rank <= k AND sim > threshold THEN rel ELSE 0 END) AS found
        FROM hits, (SELECT unnest([1, 5, 10]) AS k), (SELECT unnest([0.0::DOUBLE, 0.2, 0.4]) AS threshold) GROUP BY 1, 2),
        pr AS (SELECT k, threshold::DOUBLE AS threshold, predicted, found / (SELECT count(*) FROM gold) AS r, CASE WHEN predicted = 0 THEN 0 ELSE found / predicted END AS p FROM g)
        SELECT k, threshold, predicted, round(r, 6) AS rec, round(p, 6) AS prec, round(CASE WHEN r + p = 0 THEN 0 ELSE 2 * r * p / (r + p) END, 6) AS f1 FROM pr""",
    "sent_retrieval_map": f"""WITH {TEN}, f AS (SELECT q, rank, rel, sum(rel) OVER (PARTITION BY q ORDER BY rank ROWS UNBOUNDED PRECEDING) AS h FROM rel WHERE sim > 0.2),
        a AS (SELECT q, sum(rel * h / rank) AS ap FROM f GROUP BY 1) SELECT count(*) AS sources, round(avg(coalesce(ap, 0) / n), 6) AS map FROM n LEFT JOIN a USING (q)""",
    "matching_threshold_sweep": f"""WITH {PAIRS}, good AS (SELECT ids AS id, max(embs::DOUBLE[]) AS vec FROM doc_vectors WHERE len(embs) = 96 AND len(list_filter(embs, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embs, lambda x: x <> 0)) > 0 GROUP BY 1),
        sc AS (SELECT label, round(list_inner_product(a.vec, b.vec) / (sqrt(list_inner_product(a.vec, a.vec)) * sqrt(list_inner_product(b.vec, b.vec))), 9) AS sim FROM pairs p JOIN good a ON a.id = p.src JOIN good b ON b.id = p.tgt),
        t AS (SELECT threshold, count(*) AS pairs, sum(CASE WHEN sim > threshold THEN label ELSE 0 END) AS tp, sum(CASE WHEN sim > threshold THEN 1 - label ELSE 0 END) AS fp, sum(CASE WHEN sim > threshold THEN 0 ELSE label END) AS fn
        FROM sc, (SELECT unnest([0.2::DOUBLE, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS threshold) GROUP BY 1),
        pr AS (SELECT threshold::DOUBLE AS threshold, pairs, (pairs - fp - fn) / pairs AS a, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM t)
        SELECT threshold, pairs, round(a, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM pr""",
    "matching_misses": f"""WITH {PAIRS}, good AS (SELECT DISTINCT ids FROM doc_vectors WHERE len(embs) = 96 AND len(list_filter(embs, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embs, lambda x: x <> 0)) > 0)
        SELECT label, count(*) AS pairs FROM pairs WHERE src NOT IN (SELECT ids FROM good) OR tgt NOT IN (SELECT ids FROM good) GROUP BY 1""",
    "batch_center_numbers": f"WITH {VEC}{MEANS}{NEAR} SELECT id, id // 50 AS batch, center, (dense_rank() OVER (PARTITION BY id // 50 ORDER BY center) - 1)::INT AS number FROM near WHERE place = 1",
    "pool_union_distractors": f"WITH {PAIRS} SELECT src AS id FROM pairs WHERE split = 'test' UNION SELECT tgt FROM pairs WHERE split = 'test' UNION SELECT doc_id FROM documents WHERE source = 'manuals'",
    "mean_pool": _pool_sql("avg"),
    "max_pool": _pool_sql("max"),
    "first_last_pool": """SELECT label, list_transform(arg_min(embedding, vec_id)::DOUBLE[], lambda x: round(x, 6)) AS first, list_transform(arg_max(embedding, vec_id)::DOUBLE[], lambda x: round(x, 6)) AS last FROM embeddings GROUP BY 1""",
    "weighted_merge": """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
        SELECT i::INT AS pos, round(sum(((label + 1) / 55) * x), 6) AS value FROM x GROUP BY 1""",
    "index_assignment": f"WITH {VEC}{MEANS}{NEAR} SELECT id, center, place FROM near WHERE place <= 2",
    "index_center_stats": f"WITH {VEC}{MEANS}{NEAR}, k AS (SELECT center, count(*) AS n FROM near WHERE place = 1 GROUP BY 1) SELECT count(*) AS centers, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM k",
    "ivf_search": f"WITH {VEC}{MEANS}{NEAR}{IVF.replace('{k}', '10')} SELECT q, t, round(sim, 6) AS sim, rank FROM ivf",
    "index_recall": f"""WITH {KNN.replace('{k}', '2')}{LESS.replace('{n}', '1')}{MEANS}{NEAR}{IVF.replace('{k}', '31')},
        o AS (SELECT *, max(CASE WHEN rank = 1 AND q = t THEN 1 ELSE 0 END) OVER (PARTITION BY q) AS o FROM ivf), f AS (SELECT q, t, rank - o AS rank FROM o WHERE rank - o BETWEEN 1 AND 30),
        h AS (SELECT l.q, min(CASE WHEN f.t = l.t THEN f.rank END) AS hit FROM less l LEFT JOIN f ON f.q = l.q GROUP BY 1)
        SELECT level, round(avg(CASE WHEN hit <= level THEN 1.0 ELSE 0.0 END), 6) AS recall FROM h, (SELECT unnest([1, 5, 30]) AS level) GROUP BY 1""",
    "product_codes": f"WITH {VEC}{MEANS}{CODES} SELECT id, part, code FROM codes",
    "ivfpq_search": f"""WITH {VEC}{MEANS}{NEAR}{PQ}, probed AS (SELECT a.id AS q, a.vec, a.center, c.vec AS cv FROM near a JOIN c ON c.center = a.center WHERE a.id % 50 = 0 AND place <= 3),
        table_ AS (SELECT q, center, vec, part, code, list_inner_product(vec[part * 8 + 1 : part * 8 + 8], b) AS s FROM probed, lbooks),
        sc AS (SELECT p.q, k.id AS t, round(any_value(list_inner_product(p.vec, p.cv)) + sum(x.s), 9) AS sim FROM probed p JOIN lcodes k ON k.center = p.center
        JOIN table_ x ON x.q = p.q AND x.center = p.center AND x.part = k.part AND x.code = k.code GROUP BY 1, 2)
        SELECT q, t, round(sim, 6) AS sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, t)::INT AS rank FROM sc QUALIFY rank <= 10""",
    "reconstruction_error": f"""WITH {VEC}{MEANS}{NEAR}{PQ} SELECT count(DISTINCT id) AS vectors, round(sum(d) / count(DISTINCT id), 6) AS error FROM lcodes""",
    "index_mapped_recall": f"""WITH {KNN.replace('{k}', '4')}{LESS.replace('{n}', '3')}{MEANS}{NEAR}{IVF.replace('{k}', '31')},
        o AS (SELECT *, max(CASE WHEN rank = 1 AND q = t THEN 1 ELSE 0 END) OVER (PARTITION BY q) AS o FROM ivf), f AS (SELECT q, t, rank - o AS rank FROM o WHERE rank - o BETWEEN 1 AND 30)
        SELECT level, round(avg(CASE WHEN f.rank <= level THEN 1.0 ELSE 0.0 END), 6) AS recall FROM less l LEFT JOIN f ON f.q = l.q AND f.t = l.t, (SELECT unnest([1, 5, 30]) AS level) GROUP BY 1""",
    "classification_loss": f"WITH {VEC}{MEANS}{LOSS} {_loss_sql(0.1, 'q')}",
    "bidirectional_loss": f"WITH {VEC}{MEANS}{LOSS} {_loss_sql(0.0, 'q')} UNION ALL {_loss_sql(0.0, 't')}",
    "distilled_loss": f"""WITH {VEC}{MEANS}{LOSS}, mx AS (SELECT *, max(sim) OVER (PARTITION BY q) AS m FROM sc),
        z AS (SELECT q, ln(sum(exp(20 * (sim - m)))) AS ls, sum(exp(8 * (sim - m)) * 20 * (sim - m)) / sum(exp(8 * (sim - m))) AS x FROM mx GROUP BY 1),
        a AS (SELECT round(avg(ls - x), 6) AS loss FROM z), b AS ({_loss_sql(0.0, 'q')}) SELECT round(0.5 * (SELECT loss FROM a) + 2.0 * (SELECT loss FROM b), 6) AS loss""",
    "merged_retrieval": f"""WITH {TEN}{AT}, one AS (SELECT q, rel FROM hits WHERE rank = 1) SELECT count(*) AS queries, round(sum(found) / sum(least(k, n)), 6) AS rec, round(sum(ap / least(k, n)) / count(*), 6) AS map,
        round(sum(coalesce(rel, 0)) / count(*), 6) AS rec1 FROM every LEFT JOIN one USING (q) WHERE k = 10""",
    "head_probabilities": f"WITH {VEC}{MEANS}, z AS (SELECT v.id AS doc_id, c.center::INT AS label, 12 * list_inner_product(v.vec, c.vec) AS z FROM v, c) SELECT doc_id, label, round(exp(z) / sum(exp(z)) OVER (PARTITION BY doc_id), 6) AS p FROM z",
    "first_is_own": f"""WITH {VEC}{MEANS}, mp AS ({_pool_sql('max')}), f AS (SELECT mp.label AS q, c.center AS t, round(list_inner_product(mp.vec, c.vec), 9) AS sim FROM mp, c),
        b AS (SELECT q, t FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, t) = 1) SELECT count(*) AS queries, round(avg((q = t)::INT), 6) AS rec1 FROM b""",
    "recall_with_ties": f"""WITH {VEC}{MEANS}{LOSS}, r AS (SELECT *, rank() OVER (PARTITION BY q ORDER BY sim DESC) AS r FROM sc)
        SELECT count(*) AS relevant, count(*) FILTER (WHERE r <= 3) AS found, round(count(*) FILTER (WHERE r <= 3) / count(*), 6) AS recall FROM r WHERE g = 1""",
    "doc_average_encode": f"""WITH {SENTS}, tok AS (SELECT sent_id // 1000 AS doc_id, (sent_id % 1000) // 5 AS sent_no, unnest(src) AS token FROM sents),
        x AS (SELECT doc_id, sent_no // 4 AS frag_no, sent_no, d, ((token * 7919 + d * 104729) % 1009) / 1009.0::DOUBLE AS x FROM tok, (SELECT unnest(range(1, 9)) AS d)),
        a AS (SELECT doc_id, frag_no, sent_no, d, avg(x) AS x FROM x GROUP BY ALL), b AS (SELECT doc_id, frag_no, d, avg(x) AS x FROM a GROUP BY ALL), c AS (SELECT doc_id, d, avg(x) AS x FROM b GROUP BY ALL)
        SELECT doc_id, list(round(x, 6) ORDER BY d) AS vec FROM c GROUP BY 1""",
    "doc_layouts": f"""WITH {SENTS}, tok AS (SELECT sent_id // 1000 AS doc_id, (sent_id % 1000) // 5 AS sent_no, unnest(src) AS token FROM sents),
        x AS (SELECT doc_id, sent_no // 4 AS frag_no, sent_no, d, ((token * 7919 + d * 104729) % 1009) / 1009.0::DOUBLE AS x FROM tok, (SELECT unnest(range(1, 9)) AS d)),
        s AS (SELECT doc_id, d, avg(x) AS x FROM (SELECT doc_id, sent_no, d, avg(x) AS x FROM x GROUP BY ALL) GROUP BY ALL), f AS (SELECT doc_id, d, avg(x) AS x FROM (SELECT doc_id, frag_no, d, avg(x) AS x FROM x GROUP BY ALL) GROUP BY ALL),
        t AS (SELECT doc_id, d, avg(x) AS x FROM x GROUP BY ALL), a AS (SELECT doc_id, 'sents' AS layout, d, x FROM s UNION ALL SELECT doc_id, 'frags', d, x FROM f UNION ALL SELECT doc_id, 'tokens', d, x FROM t)
        SELECT doc_id, layout, list(round(x, 6) ORDER BY d) AS vec FROM a GROUP BY 1, 2""",
    "cache_hit_miss": """WITH good AS (SELECT DISTINCT ids FROM doc_vectors WHERE len(embs) = 96 AND len(list_filter(embs, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embs, lambda x: x <> 0)) > 0)
        SELECT ids AS doc_id, true AS cached FROM good WHERE ids IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, false FROM documents WHERE doc_id NOT IN (SELECT ids FROM good)""",
}
