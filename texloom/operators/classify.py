"""Label decisions, their tuning, and classification metrics.

Scores are rows doc_id, label, p; gold is rows doc_id, label. A decision keeps some of the score
rows. Variants of a rule are rows too, so a whole grid is judged in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import f1, ratio


def label_dictionary(rows: DataFrame) -> DataFrame:
    """label and index: labels in the order in which they first appear. ``rows``: row_no, label."""
    first = rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("row_no").alias("first_row"))
    # one row per label
    return first.select("label", (F.row_number().over(Window.orderBy("first_row")) - 1).alias("index"))


def label_statistics(rows: DataFrame) -> DataFrame:
    """label, files, share of all files, and the weight (all - positives) / positives of the class."""
    n = rows.select("doc_id").distinct().agg(F.count("*").alias("all"))
    per = rows.groupBy("label").agg(F.countDistinct("doc_id").alias("files"))
    # one row, joined on a constant
    both = per.withColumn("_k", F.lit(0)).join(F.broadcast(n.withColumn("_k", F.lit(0))), "_k")
    weight = ratio(F.col("all") - F.col("files"), F.col("files"))
    return both.select("label", "files", F.round(F.col("files") / F.col("all"), 6).alias("share"), F.round(F.when(weight == 0, 1.0).otherwise(weight), 6).alias("weight"))


def labels_per_file(rows: DataFrame) -> DataFrame:
    """One row: files, and the most and mean number of labels of one."""
    per = rows.groupBy("doc_id").agg(F.countDistinct("label").alias("n"))
    return per.agg(F.count("*").alias("files"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


def _place() -> Column:
    return F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("p").desc(), "label"))


def by_threshold(scores: DataFrame, threshold: float | DataFrame) -> DataFrame:
    """Labels whose score reaches the threshold: one for all, or label, threshold rows (no row: never)."""
    if isinstance(threshold, DataFrame):
        return scores.join(threshold.select("label", "threshold"), "label").where("p >= threshold").drop("threshold")
    return scores.where(F.col("p") >= threshold)


def by_rank(scores: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """The ``k`` best labels of each document, if a threshold is given only those that reach it."""
    out = scores.withColumn("place", _place()).where(F.col("place") <= k)
    return out if threshold is None else out.where(F.col("p") >= threshold)


def by_gap(scores: DataFrame, gap: float) -> DataFrame:
    """Labels ranked before the first fall by more than ``gap`` between neighbours; the best one always stays."""
    order = Window.partitionBy("doc_id").orderBy(F.col("p").desc(), "label")
    fall = F.coalesce(F.lag("p").over(order) - F.col("p"), F.lit(0.0))
    falls = scores.withColumn("_f", (fall > gap).cast("int"))
    return falls.withColumn("_n", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_n = 0").drop("_f", "_n")


def grid(start: float, end: float, step: float) -> list[float]:
    """start, start + step, ... up to and including ``end``; on a scale of millionths, so that nothing drifts."""
    a, b, s = round(start * 1e6), round(end * 1e6), round(step * 1e6)
    return [x / 1e6 for x in range(a, b + 1, max(1, s))]


def threshold_variants(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """variant (from 0) and the rows each threshold keeps."""
    v = F.explode(F.array(*[F.struct(F.lit(i).alias("variant"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds)])).alias("v")
    return scores.select("doc_id", "label", "p", v).select("doc_id", "label", "p", "v.*").where("p >= threshold").drop("threshold")


def rank_variants(scores: DataFrame, ks: list[int], thresholds: list[float]) -> DataFrame:
    """variant i * len(thresholds) + j: the rows kept by the i-th k and the j-th threshold."""
    v = F.explode(F.array(*[F.struct(F.lit(i * len(thresholds) + j).alias("variant"), F.lit(k).alias("k"), F.lit(t).alias("threshold")) for i, k in enumerate(ks) for j, t in enumerate(thresholds)])).alias("v")
    rows = scores.withColumn("place", _place()).select("doc_id", "label", "p", "place", v).select("doc_id", "label", "p", "place", "v.*")
    return rows.where("place <= k AND p >= threshold").select("variant", "doc_id", "label", "p")


def class_metrics(decided: DataFrame, gold: DataFrame, variants: list[int]) -> DataFrame:
    """variant, label, tp, predicted, total, rec, prec, f1 for every variant and gold label."""
    total = gold.distinct().groupBy("label").agg(F.count("*").alias("total"))
    seen = decided.select("variant", "doc_id", "label").join(gold.select("doc_id", "label").distinct().withColumn("_g", F.lit(1)), ["doc_id", "label"], "left")
    per = seen.groupBy("variant", "label").agg(F.count("_g").alias("tp"), F.count("*").alias("predicted"))
    base = total.select("label", "total", F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"))
    rows = base.join(per, ["variant", "label"], "left").na.fill(0, ["tp", "predicted"])
    r, p = ratio(F.col("tp"), F.col("total")), ratio(F.col("tp"), F.col("predicted"))
    return rows.select("variant", "label", "tp", "predicted", "total", F.round(r, 6).alias("rec"), F.round(p, 6).alias("prec"), F.round(f1(p, r), 6).alias("f1"))


def variant_metrics(decided: DataFrame, gold: DataFrame, variants: list[int]) -> DataFrame:
    """variant, micro_f1, macro_f1 (over all gold labels), mean_rec and mean_prec (over all gold documents) and their f1."""
    g = gold.select("doc_id", "label").distinct()
    docs = g.groupBy("doc_id").agg(F.count("*").alias("gold")).select("doc_id", "gold", F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"))
    seen = decided.select("variant", "doc_id", "label").join(g.withColumn("_g", F.lit(1)), ["doc_id", "label"], "left")
    per = seen.groupBy("variant", "doc_id").agg(F.count("_g").alias("tp"), F.count("*").alias("predicted"))
    by_doc = docs.join(per, ["variant", "doc_id"], "left").na.fill(0, ["tp", "predicted"])
    sums = by_doc.groupBy("variant").agg(
        F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("gold").alias("gold"),
        F.avg(ratio(F.col("tp"), F.col("gold"))).alias("mr"), F.avg(ratio(F.col("tp"), F.col("predicted"))).alias("mp"),
    )
    macro = class_metrics(decided, gold, variants).groupBy("variant").agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("gold"))
    return sums.join(macro, "variant").select(
        "variant", F.round(f1(p, r), 6).alias("micro_f1"), "macro_f1", F.round("mr", 6).alias("mean_rec"), F.round("mp", 6).alias("mean_prec"),
        F.round(f1(F.col("mp"), F.col("mr")), 6).alias("mean_f1"),
    )


def best_variant(metrics: DataFrame, by: str = "micro_f1") -> DataFrame:
    """The variant with the greatest value, the first of equal ones."""
    return metrics.orderBy(F.col(by).desc(), "variant").limit(1)


def kept_variants(metrics: DataFrame, by: str = "micro_f1", most: int = 30) -> DataFrame:
    """The variants that are carried to the next evaluation: the best ``most``, the first of equal ones first."""
    return metrics.orderBy(F.col(by).desc(), "variant").limit(most)


def class_thresholds(scores: DataFrame, gold: DataFrame, thresholds: list[float], least_f1: float = 0.05) -> DataFrame:
    """label, threshold, f1: the first threshold of greatest f1 per label; 1.0 where none reaches ``least_f1``."""
    per = class_metrics(threshold_variants(scores, thresholds), gold, list(range(len(thresholds))))
    best = per.groupBy("label").agg(F.min_by("variant", F.struct(-F.col("f1"), "variant")).alias("variant"), F.max("f1").alias("f1"))
    value = F.element_at(F.array(*[F.lit(t) for t in thresholds]), F.col("variant") + 1)
    return best.select("label", F.when(F.col("f1") < least_f1, 1.0).otherwise(value).alias("threshold"), "f1")


def average_precision(scores: DataFrame, decided: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: documents and MAP over all their labels by score; a hit is a decided gold label, its rank that among all labels. Documents without gold count 0."""
    rows = scores.withColumn("place", _place())
    g = gold.select("doc_id", "label").distinct().withColumn("_g", F.lit(1))
    d = decided.select("doc_id", "label").distinct().withColumn("_d", F.lit(1))
    rows = rows.join(g, ["doc_id", "label"], "left").join(d, ["doc_id", "label"], "left").withColumn("_h", (F.col("_g") * F.col("_d")).isNotNull().cast("int"))
    upto = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.sum("_h").over(upto))
    per = rows.groupBy("doc_id").agg(F.sum(F.col("_h") * F.col("_n") / F.col("place")).alias("ap"), F.count("_g").alias("n"))
    return per.agg(F.count("*").alias("documents"), F.round(F.avg(ratio(F.col("ap"), F.col("n"))), 6).alias("map"))


def multiclass_report(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """label, total, tp, rec, prec, share of predictions, and the accuracy over all. One label per document on either side."""
    rows = gold.select("doc_id", F.col("label").alias("g")).join(predicted.select("doc_id", F.col("label").alias("p")), "doc_id")
    counts = rows.groupBy("g", "p").agg(F.count("*").alias("n"))
    true, said = F.sum("n").over(Window.partitionBy("g")), F.sum("n").over(Window.partitionBy("p"))
    # a row per pair of labels
    own = counts.withColumn("total", true).withColumn("said", said)
    per = own.groupBy(F.col("g").alias("label")).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    preds = counts.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    both = per.join(preds, "label", "left").na.fill(0, ["predicted"]).withColumn("_k", F.lit(0))
    whole = both.groupBy("_k").agg(F.sum("tp").alias("right"), F.sum("total").alias("all"))
    r, p = ratio(F.col("tp"), F.col("total")), ratio(F.col("tp"), F.col("predicted"))
    return both.join(F.broadcast(whole), "_k").select(
        "label", "total", "tp", "predicted", F.round(r, 6).alias("rec"), F.round(p, 6).alias("prec"),
        F.round(F.col("predicted") / F.col("all"), 6).alias("share"), F.round(F.col("right") / F.col("all"), 6).alias("accuracy"),
    )


def match_modes(decided: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: documents whose labels are exactly the gold ones, contain them all, or are all among them."""
    d = decided.groupBy("doc_id").agg(F.collect_set("label").alias("d"))
    g = gold.groupBy("doc_id").agg(F.collect_set("label").alias("g"))
    rows = g.join(d, "doc_id", "left").withColumn("d", F.coalesce("d", F.array().cast("array<int>"))).withColumn("g", F.col("g").cast("array<int>"))
    rows = rows.select((F.size(F.array_except("g", "d")) == 0).alias("all_in"), (F.size(F.array_except("d", "g")) == 0).alias("none_else"))
    return rows.agg(F.count("*").alias("documents"), F.count_if(F.col("all_in") & F.col("none_else")).alias("exact"), F.count_if("all_in").alias("contain"), F.count_if("none_else").alias("belong"))


def weighted_labels(decided: DataFrame) -> DataFrame:
    """doc_id and labels: an array of (label, weight), the greatest weight first."""
    pair = F.struct((-F.round("p", 6)).alias("w"), "label")
    return decided.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.struct(x["label"].alias("label"), (-x["w"]).alias("weight"))).alias("labels"))
