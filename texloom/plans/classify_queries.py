"""Queries on label decisions and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import classify as C
from .tables import table
from .vector_queries import LOSS, MEANS, VEC, _label_scores, _vectors

THRESHOLDS = C.grid(0.5, 0.8, 0.05)
KS, STEPS = [1, 2, 3], [0.5, 0.6, 0.7]


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, label, p: the sigmoid of twelve times the product with each label's center."""
    s = _label_scores(_vectors(spark, d))
    return s.select(F.col("q").alias("doc_id"), F.col("t").cast("int").alias("label"), F.round(V.sigmoid(12 * F.col("sim")), 6).alias("p"))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("int").alias("label"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "label", "p")


def predict_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _shown(C.by_threshold(_scores(spark, d), 0.65))


def predict_class_threshold(spark: SparkSession, d: str) -> DataFrame:
    t = _gold(spark, d).select("label").distinct().withColumn("threshold", 0.5 + F.col("label") / 40)
    return _shown(C.by_threshold(_scores(spark, d), t))


def predict_topk(spark: SparkSession, d: str) -> DataFrame:
    return C.by_rank(_scores(spark, d), 2)


def predict_topk_threshold(spark: SparkSession, d: str) -> DataFrame:
    return C.by_rank(_scores(spark, d), 3, 0.6)


def predict_gap(spark: SparkSession, d: str) -> DataFrame:
    return _shown(C.by_gap(_scores(spark, d), 0.04))


def kept_variants(spark: SparkSession, d: str) -> DataFrame:
    return C.kept_variants(tune_thresholds(spark, d), most=3)


def weighted_labels(spark: SparkSession, d: str) -> DataFrame:
    return C.weighted_labels(C.by_rank(_scores(spark, d), 3)).select("doc_id", F.transform("labels", lambda x: x["label"]).alias("labels"), F.transform("labels", lambda x: x["weight"]).alias("weights"))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    return C.threshold_variants(_scores(spark, d), THRESHOLDS)


def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return C.class_metrics(_variants(spark, d), _gold(spark, d), list(range(len(THRESHOLDS))))


def tune_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return C.variant_metrics(_variants(spark, d), _gold(spark, d), list(range(len(THRESHOLDS))))


def tune_ranks(spark: SparkSession, d: str) -> DataFrame:
    return C.variant_metrics(C.rank_variants(_scores(spark, d), KS, STEPS), _gold(spark, d), list(range(len(KS) * len(STEPS))))


def best_variant(spark: SparkSession, d: str) -> DataFrame:
    return C.best_variant(tune_ranks(spark, d))


def per_class_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return C.class_thresholds(_scores(spark, d), _gold(spark, d), THRESHOLDS)


def multilabel_map(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    return C.average_precision(s, C.by_rank(s, 3), _gold(spark, d))


def multiclass_report(spark: SparkSession, d: str) -> DataFrame:
    return C.multiclass_report(C.by_rank(_scores(spark, d), 1), _gold(spark, d))


def multilabel_match_modes(spark: SparkSession, d: str) -> DataFrame:
    return C.match_modes(C.by_threshold(_scores(spark, d), 0.65), _gold(spark, d))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_no"), F.col("dir_key").alias("doc_id"), F.col("lang").alias("label"))


def label_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return C.label_dictionary(_labelled(spark, d))


def label_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.label_statistics(_labelled(spark, d).where("label IS NOT NULL"))


def labels_per_file(spark: SparkSession, d: str) -> DataFrame:
    return C.labels_per_file(_labelled(spark, d).where("label IS NOT NULL"))


QUERIES = [
    kept_variants,
    predict_threshold, predict_class_threshold, predict_topk, predict_topk_threshold, predict_gap, weighted_labels, class_metrics, tune_thresholds, tune_ranks,
    best_variant, per_class_thresholds, multilabel_map, multiclass_report, multilabel_match_modes, label_dictionary, label_stats, labels_per_file,
]

SC = VEC + MEANS + LOSS + ", p AS (SELECT q AS doc_id, t::INT AS label, round(1 / (1 + exp(-12 * sim)), 6) AS p FROM sc), pl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, label)::INT AS place FROM p), gold AS (SELECT id AS doc_id, label::INT AS label FROM v)"
VARIANTS = ", vs AS (SELECT unnest([" + ", ".join(f"{{'variant': {i}, 't': {t}}}" for i, t in enumerate(THRESHOLDS)) + "]) AS x), d AS (SELECT x.variant AS variant, doc_id, label FROM p, vs WHERE p >= x.t::DOUBLE)"
RANKS = ", vs AS (SELECT unnest([" + ", ".join(f"{{'variant': {i * len(STEPS) + j}, 'k': {k}, 't': {t}}}" for i, k in enumerate(KS) for j, t in enumerate(STEPS)) + "]) AS x), d AS (SELECT x.variant AS variant, doc_id, label FROM pl, vs WHERE place <= x.k AND p >= x.t::DOUBLE)"
PER_CLASS = (
    ", cm AS (SELECT v.variant, t.label, t.total, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted FROM (SELECT x.variant FROM vs) v, (SELECT label, count(*) AS total FROM gold GROUP BY 1) t"
    " LEFT JOIN (SELECT variant, d.label, count(g.label) AS tp, count(*) AS predicted FROM d LEFT JOIN gold g ON g.doc_id = d.doc_id AND g.label = d.label GROUP BY 1, 2) s ON s.variant = v.variant AND s.label = t.label),"
    " cp AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE tp / total END AS r, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS p FROM cm),"
    " cf AS (SELECT variant::INT AS variant, label, tp, predicted, total, round(r, 6) AS rec, round(p, 6) AS prec, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM cp)"
)
BY_VARIANT = (
    PER_CLASS
    + ", bd AS (SELECT v.variant, g.doc_id, g.gold, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted FROM (SELECT x.variant FROM vs) v, (SELECT doc_id, count(*) AS gold FROM gold GROUP BY 1) g"
    " LEFT JOIN (SELECT variant, d.doc_id, count(g.label) AS tp, count(*) AS predicted FROM d LEFT JOIN gold g ON g.doc_id = d.doc_id AND g.label = d.label GROUP BY 1, 2) s ON s.variant = v.variant AND s.doc_id = g.doc_id),"
    " sm AS (SELECT variant, sum(tp) AS tp, sum(predicted) AS predicted, sum(gold) AS gold, avg(CASE WHEN gold = 0 THEN 0 ELSE tp / gold END) AS mr, avg(CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END) AS mp FROM bd GROUP BY 1),"
    " mi AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS p, CASE WHEN gold = 0 THEN 0 ELSE tp / gold END AS r FROM sm),"
    " vm AS (SELECT mi.variant::INT AS variant, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS micro_f1, macro_f1, round(mr, 6) AS mean_rec, round(mp, 6) AS mean_prec,"
    " round(CASE WHEN mp + mr = 0 THEN 0 ELSE 2 * mp * mr / (mp + mr) END, 6) AS mean_f1 FROM mi JOIN (SELECT variant, round(avg(f1), 6) AS macro_f1 FROM cf GROUP BY 1) ma ON ma.variant = mi.variant)"
)
FILES = "rows AS (SELECT doc_id AS row_no, dir_key AS doc_id, lang AS label FROM documents)"

SQL = {
    "predict_threshold": f"WITH {SC} SELECT doc_id, label, p FROM p WHERE p >= 0.65",
    "predict_class_threshold": f"WITH {SC} SELECT doc_id, label, p FROM p WHERE p >= 0.5 + label / 40",
    "predict_topk": f"WITH {SC} SELECT doc_id, label, p, place FROM pl WHERE place <= 2",
    "predict_topk_threshold": f"WITH {SC} SELECT doc_id, label, p, place FROM pl WHERE place <= 3 AND p >= 0.6",
    "predict_gap": f"""WITH {SC}, f AS (SELECT *, (coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p DESC, label) - p, 0) > 0.04)::INT AS f FROM p)
        SELECT doc_id, label, p FROM (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY p DESC, label ROWS UNBOUNDED PRECEDING) AS n FROM f) WHERE n = 0""",
    "weighted_labels": f"WITH {SC} SELECT doc_id, list(label ORDER BY p DESC, label) AS labels, list(p ORDER BY p DESC, label) AS weights FROM pl WHERE place <= 3 GROUP BY 1",
    "class_metrics": f"WITH {SC}{VARIANTS}{PER_CLASS} SELECT * FROM cf",
    "tune_thresholds": f"WITH {SC}{VARIANTS}{BY_VARIANT} SELECT * FROM vm",
    "tune_ranks": f"WITH {SC}{RANKS}{BY_VARIANT} SELECT * FROM vm",
    "kept_variants": f"WITH {SC}{VARIANTS}{BY_VARIANT} SELECT * FROM vm ORDER BY micro_f1 DESC, variant LIMIT 3",
    "best_variant": f"WITH {SC}{RANKS}{BY_VARIANT} SELECT * FROM vm ORDER BY micro_f1 DESC, variant LIMIT 1",
    "per_class_thresholds": f"""WITH {SC}{VARIANTS}{PER_CLASS}, b AS (SELECT label, variant, f1 FROM cf QUALIFY row_number() OVER (PARTITION BY label ORDER BY f1 DESC, variant) = 1)
        SELECT label, CASE WHEN f1 < 0.05 THEN 1.0::DOUBLE ELSE x.t::DOUBLE END AS threshold, f1 FROM b JOIN vs ON vs.x.variant = b.variant""",
    "multilabel_map": f"""WITH {SC}, h AS (SELECT pl.*, (g.label IS NOT NULL)::INT AS g, (g.label IS NOT NULL AND place <= 3)::INT AS h FROM pl LEFT JOIN gold g ON g.doc_id = pl.doc_id AND g.label = pl.label),
        n AS (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS n FROM h), a AS (SELECT doc_id, sum(h * n / place) AS ap, sum(g) AS g FROM n GROUP BY 1)
        SELECT count(*) AS documents, round(avg(CASE WHEN g = 0 THEN 0 ELSE ap / g END), 6) AS map FROM a""",
    "multiclass_report": f"""WITH {SC}, r AS (SELECT g.label AS g, pl.label AS p FROM gold g JOIN pl ON pl.doc_id = g.doc_id WHERE place = 1),
        a AS (SELECT g AS label, count(*) AS total, sum((g = p)::INT)::BIGINT AS tp FROM r GROUP BY 1), b AS (SELECT p AS label, count(*) AS predicted FROM r GROUP BY 1),
        mm AS (SELECT label, total, tp, coalesce(predicted, 0) AS predicted FROM a LEFT JOIN b USING (label))
        SELECT label, total, tp, predicted, round(tp / total, 6) AS rec, round(CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END, 6) AS prec,
        round(predicted / sum(total) OVER (), 6) AS share, round(sum(tp) OVER () / sum(total) OVER (), 6) AS accuracy FROM mm""",
    "multilabel_match_modes": f"""WITH {SC}, s AS (SELECT g.doc_id, list(DISTINCT g.label) AS g, list(DISTINCT p.label) FILTER (WHERE p.label IS NOT NULL) AS d FROM gold g LEFT JOIN p ON p.doc_id = g.doc_id AND p.p >= 0.65 GROUP BY 1),
        mm AS (SELECT len(list_filter(g, lambda x: NOT list_contains(coalesce(d, []), x))) = 0 AS a, len(list_filter(coalesce(d, []), lambda x: NOT list_contains(g, x))) = 0 AS b FROM s)
        SELECT count(*) AS documents, count(*) FILTER (WHERE a AND b) AS exact, count(*) FILTER (WHERE a) AS contain, count(*) FILTER (WHERE b) AS belong FROM mm""",
    "label_dictionary": f"""WITH {FILES}, f AS (SELECT label, min(row_no) AS r FROM rows WHERE label IS NOT NULL GROUP BY 1) SELECT label, (row_number() OVER (ORDER BY r) - 1)::INT AS index FROM f""",
    "label_stats": f"""WITH {FILES}, n AS (SELECT count(DISTINCT doc_id) AS a FROM rows WHERE label IS NOT NULL), f AS (SELECT label, count(DISTINCT doc_id) AS files FROM rows WHERE label IS NOT NULL GROUP BY 1)
        SELECT label, files, round(files / a, 6) AS share, round(CASE WHEN a = files THEN 1.0 ELSE (a - files) / files END, 6) AS weight FROM f, n""",
    "labels_per_file": f"""WITH {FILES}, f AS (SELECT doc_id, count(DISTINCT label) AS n FROM rows WHERE label IS NOT NULL GROUP BY 1) SELECT count(*) AS files, max(n) AS most, round(avg(n), 6) AS mean FROM f""",
}
