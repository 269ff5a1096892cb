"""Retrieval, matching and training metrics as relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import f1, ratio
from .order import first_rows


def marked(knn: DataFrame, gold: DataFrame) -> DataFrame:
    """knn with rel: 1 where the pair is in ``gold`` (q, t)."""
    rows = knn.join(gold.select("q", "t").distinct().withColumn("_g", F.lit(1)), ["q", "t"], "left")
    return rows.withColumn("rel", F.coalesce("_g", F.lit(0))).drop("_g")


def gold_counts(gold: DataFrame) -> DataFrame:
    """q and n, the relevant targets of each query."""
    return gold.select("q", "t").distinct().groupBy("q").agg(F.count("*").alias("n"))


def marked_by_label(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """knn with rel: 1 where query and target (another one) have the same label. ``labels``: id, label. The relevant pairs themselves are never made."""
    q, t = labels.select(F.col("id").alias("q"), F.col("label").alias("_q")), labels.select(F.col("id").alias("t"), F.col("label").alias("_t"))
    return knn.join(q, "q", "left").join(t, "t", "left").withColumn("rel", F.coalesce((F.col("_q") == F.col("_t")) & (F.col("q") != F.col("t")), F.lit(False)).cast("int")).drop("_q", "_t")


def label_counts(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """q and n, the other rows of ``labels`` (id, label) with the query's label; queries without any are left out. ``queries``: q."""
    n = labels.groupBy("label").agg((F.count("*") - 1).alias("n"))
    own = queries.select("q").join(labels.select(F.col("id").alias("q"), "label"), "q")
    return own.join(n, "label").where("n > 0").select("q", "n")


def _hits(rows: DataFrame) -> DataFrame:
    """Adds hits: the relevant ones up to each rank."""
    return rows.withColumn("hits", F.sum("rel").over(Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))


def retrieval_at(rows: DataFrame, n: DataFrame, levels: list[int], groups: DataFrame | None = None) -> DataFrame:
    """k, queries, rec and map at each level.

    ``rows``: q, rank, rel. ``n``: q, n. rec = found relevant over sum of min(k, relevant); map = mean over all queries of ``n`` of the average
    precision over min(k, relevant). ``groups``: q, grp[, weight columns to average]; then the metrics are per grp, and overall
    where grp is null, with the mean of each further column.
    """
    at = F.explode(F.array(*[F.lit(x) for x in levels])).alias("k")
    each = _hits(rows).select("q", "rank", "rel", "hits", at).where("rank <= k")
    per = each.groupBy("q", "k").agg(F.sum("rel").alias("found"), F.sum(F.col("rel") * F.col("hits") / F.col("rank")).alias("ap"))
    all_ = n.select("q", "n", at).join(per, ["q", "k"], "left").na.fill(0, ["found", "ap"])
    most = F.least("k", "n")
    what = [
        F.count("*").alias("queries"),
        F.round(ratio(F.sum("found"), F.sum(most)), 6).alias("rec"),
        F.round(F.sum(F.col("ap") / most) / F.count("*"), 6).alias("map"),
    ]
    if groups is None:
        return all_.groupBy("k").agg(*what)
    what += [F.round(F.avg(c), 6).alias(c) for c in groups.columns if c not in ("q", "grp")]
    return all_.join(groups, "q").groupingSets([["k"], ["k", "grp"]], "k", "grp").agg(*what)


def with_vectors(pairs: DataFrame, vectors: DataFrame, key: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Pairs with the vectors of both sides (a, b), and the pairs of which one is missing. ``vectors``: id, vec[, the columns ``key``, such as a folder]; then pairs have each of them as src_ and tgt_."""
    out = pairs
    for side, vec in (("src", "a"), ("tgt", "b")):
        on = [F.col("id").alias(side), *[F.col(k).alias(f"{side}_{k}") for k in key]]
        out = out.join(vectors.select(*on, F.col("vec").alias(vec)), [side, *[f"{side}_{k}" for k in key]], "left")
    return out.where("a IS NOT NULL AND b IS NOT NULL"), out.where("a IS NULL OR b IS NULL").drop("a", "b")


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, accuracy, precision, recall and f1 of ``sim`` > threshold against ``label``; 0 where undefined. ``scored``: sim, label."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    rows = scored.select(t, "label", F.col("sim")).withColumn("yes", (F.col("sim") > F.col("threshold")).cast("int"))
    tp, fp, fn = F.sum(F.col("yes") * F.col("label")), F.sum(F.col("yes") * (1 - F.col("label"))), F.sum((1 - F.col("yes")) * F.col("label"))
    per = rows.groupBy("threshold").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count("*").alias("pairs"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    right = F.col("pairs") - F.col("fp") - F.col("fn")
    return per.select("threshold", "pairs", F.round(right / F.col("pairs"), 6).alias("accuracy"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def prediction_grid(rows: DataFrame, n: DataFrame, levels: list[int], thresholds: list[float]) -> DataFrame:
    """k, threshold, predicted, rec, prec and f1 of the pairs up to rank k whose sim exceeds the threshold. ``rows``: rank, sim, rel; ``n``: q, n."""
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("threshold")) for k in levels for t in thresholds])).alias("g")
    each = rows.select("rank", "sim", "rel", grid).select("*", "g.k", "g.threshold")
    yes = (F.col("rank") <= F.col("k")) & (F.col("sim") > F.col("threshold"))
    per = each.groupBy("k", "threshold").agg(F.count_if(yes).alias("predicted"), F.sum(F.when(yes, F.col("rel")).otherwise(0)).alias("found"))
    total = n.agg(F.sum("n").alias("gold"))
    # one row, joined on a constant
    both = per.withColumn("_k", F.lit(0)).join(F.broadcast(total.withColumn("_k", F.lit(0))), "_k")
    p, r = ratio(F.col("found"), F.col("predicted")), ratio(F.col("found"), F.col("gold"))
    return both.select("k", "threshold", "predicted", F.round(r, 6).alias("rec"), F.round(p, 6).alias("prec"), F.round(f1(p, r), 6).alias("f1"))


def mean_average_precision(rows: DataFrame, n: DataFrame) -> DataFrame:
    """One row: gold sources and MAP; each source's precisions over its own gold count, sources without a prediction count 0. ``rows``: q, rank, rel; ``n``: q, n."""
    ap = _hits(rows).groupBy("q").agg(F.sum(F.col("rel") * F.col("hits") / F.col("rank")).alias("ap"))
    return n.join(ap, "q", "left").agg(F.count("*").alias("sources"), F.round(F.avg(F.coalesce("ap", F.lit(0.0)) / F.col("n")), 6).alias("map"))


def first_is_own(scores: DataFrame) -> DataFrame:
    """One row: queries, and the share whose best target (the least of equals) has the query's own number. ``scores``: q, t, sim."""
    best = scores.groupBy("q").agg(F.min_by("t", F.struct(-F.col("sim"), "t")).alias("t"))
    return best.agg(F.count("*").alias("queries"), F.round(F.avg((F.col("q") == F.col("t")).cast("double")), 6).alias("rec1"))


def recall_with_ties(scores: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """One row: relevant pairs, those whose score reaches the k-th best of their query (ties all count), and the recall."""
    ranked = scores.withColumn("_r", F.rank().over(Window.partitionBy("q").orderBy(F.col("sim").desc())))
    rows = ranked.join(gold.select("q", "t").distinct(), ["q", "t"])
    return rows.agg(F.count("*").alias("relevant"), F.count_if(F.col("_r") <= k).alias("found"), F.round(ratio(F.count_if(F.col("_r") <= k), F.count("*")), 6).alias("recall"))


def cross_entropy(scores: DataFrame, gold: DataFrame, margin: float = 0.0, scale: float = 1.0, by: str = "q") -> DataFrame:
    """One row: pairs and the mean of -log softmax of the gold pairs' scores, over all t of a q (or all q of a t).

    Scores are (sim - margin for gold pairs) * scale; the greatest is taken off first, so that nothing overflows.
    Sums are made by aggregation and joined to the gold pairs alone, so a target with many queries is no task of its own.
    """
    rows = scores.join(gold.select("q", "t").distinct().withColumn("_g", F.lit(1)), ["q", "t"], "left").withColumn("_g", F.coalesce("_g", F.lit(0)))
    rows = rows.select("q", "t", "_g", ((F.col("sim") - margin * F.col("_g")) * scale).alias("_s"))
    most = rows.groupBy(by).agg(F.max("_s").alias("_m"))
    sums = rows.join(most, by).groupBy(by).agg(F.sum(F.exp(F.col("_s") - F.col("_m"))).alias("_e"), F.max("_m").alias("_m"))
    own = rows.where("_g = 1").join(sums, by)
    return own.agg(F.count("*").alias("pairs"), F.round(F.avg(F.log("_e") + F.col("_m") - F.col("_s")), 6).alias("loss"))


def pooled_distinct(*ids: DataFrame) -> DataFrame:
    """All ids of the given tables (one column each), each once."""
    out = ids[0].toDF("id")
    for d in ids[1:]:
        out = out.unionByName(d.toDF("id"))
    return out.distinct()


def distractors(pool: DataFrame, used: DataFrame, limit: int | None = None, order: str = "path") -> DataFrame:
    """Rows of ``pool`` that aren't ``used`` (id), at most ``limit`` of them: the first by ``order``."""
    left = pool.join(used.select("id"), "id", "left_anti")
    return left if limit is None else first_rows(left, limit, F.col(order), F.col("id"))


def retrieval_sums(rows: DataFrame, n: DataFrame, k: int) -> DataFrame:
    """One row of sums that can be added over parts of a set: queries, relevant (at most k each), found, ap (of average precisions), first (queries with a hit at rank 1)."""
    per = _hits(rows.where(F.col("rank") <= k)).groupBy("q").agg(F.sum("rel").alias("f"), F.sum(F.col("rel") * F.col("hits") / F.col("rank")).alias("a"), F.max(F.when(F.col("rank") == 1, F.col("rel"))).alias("one"))
    all_ = n.join(per, "q", "left").na.fill(0, ["f", "a", "one"])
    most = F.least(F.lit(k), F.col("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return all_.agg(F.count("*").alias("queries"), total(most).alias("relevant"), total("f").alias("found"), total(F.col("a") / most).cast("double").alias("ap"), total("one").alias("first"))


def merged_metrics(*parts: DataFrame) -> DataFrame:
    """One row: queries, rec, map and rec1 from sums of parts, as if they were one set."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    s = out.agg(*[F.sum(c).alias(c) for c in ("queries", "relevant", "found", "ap", "first")])
    r = lambda a, b: F.round(ratio(F.col(a), F.col(b)), 6)
    return s.select("queries", r("found", "relevant").alias("rec"), r("ap", "queries").alias("map"), r("first", "queries").alias("rec1"))


def best_checkpoint(scores: DataFrame) -> DataFrame:
    """The checkpoint with the greatest mean of its tasks' metrics, the first of equal ones. ``scores``: checkpoint, task, value."""
    per = scores.groupBy("checkpoint").agg(F.round(F.avg("value"), 6).alias("mean"))
    return per.orderBy(F.col("mean").desc(), "checkpoint").limit(1)


def distillation_loss(student: DataFrame, teacher: DataFrame) -> DataFrame:
    """One row: queries and the mean cross-entropy of the student's softmax against the teacher's. Both: q, t, sim."""
    both = student.join(teacher.select("q", "t", F.col("sim").alias("goal")), ["q", "t"])
    m = both.groupBy("q").agg(F.max("sim").alias("ms"), F.max("goal").alias("mg"))
    z = both.join(m, "q").groupBy("q").agg(
        F.log(F.sum(F.exp(F.col("sim") - F.col("ms")))).alias("ls"), F.sum(F.exp(F.col("goal") - F.col("mg"))).alias("zg"),
        F.sum(F.exp(F.col("goal") - F.col("mg")) * (F.col("sim") - F.col("ms"))).alias("x"),
    )
    return z.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("ls") - F.col("x") / F.col("zg")), 6).alias("loss"))


def weighted_loss(losses: list[tuple[DataFrame, float]]) -> DataFrame:
    """One row: the weighted sum of losses (one row each)."""
    out = None
    for df, w in losses:
        one = df.select((F.col("loss") * w).alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.round(F.sum("loss"), 6).alias("loss"))
