"""Problem 7: a mix of sources at target shares of the tokens."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import clean_name
from .encoding import count_tokens

#: Targets a call takes at most; they are settings and are held in memory.
MAX_TARGETS = 10_000
#: Sums that come to the driver at most: per source, by steps of the weight and of the rank.
MAX_SUMS = 1 << 20
#: Steps of the weight for each doubling, and of the rank, at most.
WEIGHT_STEPS, STEPS = 8, 4096


def measured(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source (as it should be spelled) and tokens of each document, written once."""
    return cut(count_tokens(docs.select("doc_id", "text", clean_name(F.col("source")).alias("source")), "text", ["doc_id", "source"], path))


def plan_mix(targets: list[tuple[str, float, int]], sizes: dict[str, int], total: float | None = None) -> dict[str, dict]:
    """Whole copies and the rest in tokens of each source.

    Sources without tokens reach nothing; the others share in proportion to their targets. Without
    ``total`` the mix is the largest one in which every such target is met; with it, a source that
    can't fill its share even at ``max_repeats`` gives all it may.
    """
    live = [(s, w, r) for s, w, r in targets if sizes.get(s, 0) > 0 and w > 0 and r > 0]
    whole = sum(w for _, w, _ in live)
    if total is None:
        total = min((sizes[s] * r * whole / w for s, w, r in live), default=0)
    plan = {}
    for s, w, r in targets:
        n = sizes.get(s, 0)
        here = n > 0 and w > 0 and r > 0
        due = min(total * w / whole, n * r) if here else 0.0
        copies = min(r, math.floor(due / n + 1e-9)) if here else 0
        rest = max(0.0, due - copies * n) if copies < r else 0.0
        plan[s] = {"target_share": w, "attainable_share": w / whole if here else 0.0, "copies": copies, "rest": rest, "inclusion": rest / n if here else 0.0, "max_repeats": r}
    return plan


def inclusion_odds(sums: list[tuple[int, float, float]], rest: float) -> tuple[float, float]:
    """c and the weight from which documents are certain, so that the others, taken with probability c times their weight, give the ``rest``.

    ``sums``: step of the weight, tokens, and weight times tokens of the documents of one source.
    Where c times the weight would be 1 or more a document is certain: the heaviest steps are taken out until
    no other would be.
    """
    left, tokens, weighted = rest, [t for _, t, _ in sorted(sums)], [w for _, _, w in sorted(sums)]
    steps = sorted(s for s, _, _ in sums)
    total = sum(weighted)
    at = len(steps)
    while at and total > 0:
        c = left / total
        top = 2.0 ** ((steps[at - 1] + 1) / WEIGHT_STEPS)  # above all weights of the step
        if c * top < 1 or tokens[at - 1] > left:
            return c, 2.0 ** (steps[at] / WEIGHT_STEPS) if at < len(steps) else math.inf
        at -= 1
        left -= tokens[at]
        total -= weighted[at]
    return 0.0, 2.0 ** (steps[at] / WEIGHT_STEPS) if at < len(steps) else math.inf


def mix(sized: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, weight: str | None = "tokens") -> DataFrame:
    """doc_id, source, tokens, copies and expected (copies on average) of each document that is in the mix.

    ``sized``: doc_id, source, tokens[, weight]. ``targets``: source, target_share, max_repeats (null
    or negative: 0; of a source named twice the shares add up and the least repeats hold). Each
    document of a source first gets the certain whole copies; the rest of the source's tokens is a
    Pareto sample: documents are ranked by their random odds u/(1-u) over their inclusion odds
    p/(1-p), and taken from the least rank on until the size is reached as nearly as whole documents
    allow. p is in proportion to ``weight`` (the tokens, so that long documents aren't cut down to the share of short ones; a
    column; None: equal), null and weights under a billionth count as that; documents for which it would reach 1 are certain, and the others share what they leave.
    u is a hash of doc_id and ``seed``, so a lost task gives the same sample again. Null sources and
    those without a target, and documents without tokens, aren't used. Ties of the rank go to the
    smaller doc_id. No source is ever in one task: the size is found from sums by steps of the
    rank, then by steps of the step in which it is reached, and only the last such step is ordered row by row.
    """
    return _mixed(sized, targets, total_tokens, seed, weight).where("copies > 0")


def _mixed(sized: DataFrame, targets: DataFrame, total_tokens: float | None, seed: int, weight: str | None) -> DataFrame:
    """As ``mix``, with the documents that got no copy."""
    spark = sized.sparkSession
    t = targets.groupBy(clean_name(F.col("source")).alias("source")).agg(
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("w"), F.min(F.coalesce(F.col("max_repeats"), F.lit(0))).alias("r")
    )
    rows = t.where("source IS NOT NULL").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    steps = max(64, min(STEPS, MAX_SUMS // max(1, len(rows))))
    weights = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(1e-9)), F.lit(1e-9)) if weight else F.lit(1.0)
    docs = sized.select("doc_id", "source", "tokens", weights.alias("_w")).where("tokens > 0 AND source IS NOT NULL")
    names = spark.createDataFrame([(r["source"],) for r in rows] or [("",)], "source string")
    docs = docs.join(F.broadcast(names), "source")  # at most MAX_TARGETS rows
    # weights span some 100 doublings at most, in WEIGHT_STEPS each
    by_weight: dict[str, list[tuple[int, float, float]]] = {}
    step = F.floor(F.log2(F.least("_w", F.lit(1e18))) * WEIGHT_STEPS).cast("int")
    for r in docs.groupBy("source", step.alias("s")).agg(F.sum("tokens").alias("n"), F.sum(F.col("_w") * F.col("tokens")).alias("w")).collect():
        by_weight.setdefault(r["source"], []).append((r["s"], float(r["n"]), float(r["w"])))
    plan = plan_mix([(r["source"], r["w"], r["r"]) for r in rows], {s: int(sum(n for _, n, _ in x)) for s, x in by_weight.items()}, total_tokens)
    odds = {s: inclusion_odds(by_weight[s], p["rest"]) for s, p in plan.items() if s in by_weight}
    settings = spark.createDataFrame(
        [(s, p["copies"], float(p["rest"]), *map(float, odds[s])) for s, p in plan.items() if s in odds] or [("", 0, 0.0, 0.0, math.inf)],
        "source string, _copies int, _rest double, _c double, _sure double",
    )
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    p = F.least(F.greatest(F.col("_c") * F.col("_w"), F.lit(1e-12)), F.lit(1 - 1e-12))
    ranked = docs.join(F.broadcast(settings), "source").withColumn("_certain", (F.col("_w") >= F.col("_sure")) & (F.col("_rest") > 0))
    ranked = ranked.withColumn("_p", F.when(F.col("_rest") <= 0, 0.0).when(F.col("_certain"), 1.0).otherwise(p))
    ranked = ranked.withColumn("_q", (u / (1 - u)) / (p / (1 - p)))
    # certain documents come before all others
    ranked = ranked.withColumn("_s", F.when(F.col("_certain"), -1.0).otherwise(F.col("_q") / (1 + F.col("_q"))))
    ranked = ranked.withColumn("_step", F.when(F.col("_certain"), -1).otherwise(F.floor(F.col("_s") * steps)).cast("int"))
    ranked = ranked.withColumn("_fine", F.floor((F.col("_s") * steps - F.col("_step")) * steps).cast("int"))
    due = {s: p["rest"] for s, p in plan.items() if p["rest"] > 0 and s in odds}

    def reached(sums: list, before: dict[str, float]) -> dict[str, tuple[int, float]]:
        """The step of each source in which its rest is reached, and the tokens before it."""
        by: dict[str, list[tuple[int, int]]] = {}
        for r in sums:
            by.setdefault(r["source"], []).append((r["step"], r["n"]))
        out = {}
        for s, x in by.items():
            held = before.get(s, 0.0)
            for k, n in sorted(x):
                if held + n > due[s]:
                    out[s] = (k, held)
                    break
                held += n
        return out

    # sums of the sources with a rest, at most MAX_SUMS of them or 64 a source
    coarse = reached(ranked.where("_rest > 0").groupBy("source", F.col("_step").alias("step")).agg(F.sum("tokens").alias("n")).collect(), {})
    edge = spark.createDataFrame([(s, k) for s, (k, _) in coarse.items()] or [("", 0)], "source string, _edge int")
    within = ranked.where("_rest > 0").join(F.broadcast(edge), "source").where("_step = _edge")
    fine = reached(within.groupBy("source", F.col("_fine").alias("step")).agg(F.sum("tokens").alias("n")).collect(), {s: n for s, (_, n) in coarse.items()})
    # a source that never reaches its rest takes all
    ends = [(s, *((coarse[s][0], fine[s][0], float(fine[s][1])) if s in fine else (steps + 1, 0, 0.0))) for s in odds if s in due] or [("", 0, 0, 0.0)]
    placed = ranked.join(F.broadcast(spark.createDataFrame(ends, "source string, _edge int, _in int, _before double")), "source", "left")
    at = (F.col("_step") == F.col("_edge")) & (F.col("_fine") == F.col("_in"))
    less = (F.col("_step") < F.col("_edge")) | (F.col("_step") == F.col("_edge")) & (F.col("_fine") < F.col("_in"))
    at, less = F.coalesce(at, F.lit(False)), F.coalesce(less, F.lit(False))
    cols = ["doc_id", "source", "tokens", "_copies", "_p"]
    last = placed.where(at)
    run = Window.partitionBy("source").orderBy("_s", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_had", F.col("_before") + F.coalesce(F.sum("tokens").over(run), F.lit(0)))
    last = last.select(*cols, (F.col("_had") + F.col("tokens") / 2 <= F.col("_rest")).cast("int").alias("_more"))
    out = placed.where(~at).select(*cols, less.cast("int").alias("_more")).unionByName(last)
    return out.select("doc_id", "source", "tokens", (F.col("_copies") + F.col("_more")).alias("copies"), (F.col("_copies") + F.col("_p")).alias("expected"))


def inclusion_report(sized: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, weight: str | None = "tokens") -> DataFrame:
    """Per source and tenth of the expected copies beyond whole ones: documents, and copies expected and drawn for them."""
    every = _mixed(sized, targets, total_tokens, seed, weight)
    tenth = F.least(F.floor((F.col("expected") - F.floor("expected")) * 10), F.lit(9)).cast("int")
    return every.groupBy("source", F.floor("expected").cast("int").alias("whole"), tenth.alias("tenth")).agg(
        F.count("*").alias("documents"), F.round(F.sum("expected"), 3).alias("expected"), F.sum("copies").alias("drawn")
    )


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: its share, the tokens and documents in the mix, the most repeats, and the share reached."""
    used = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies")
    )
    t = targets.groupBy(clean_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    both = t.join(used, "source", "left").na.fill(0, ["mix_tokens", "documents", "most_copies"])
    whole = F.sum("mix_tokens").over(Window.partitionBy(F.lit(0)))  # over one row per target
    return both.select(
        "source", "target_share", "max_repeats", "mix_tokens", "documents", "most_copies",
        F.coalesce(F.try_divide("mix_tokens", whole), F.lit(0.0)).alias("actual_share"),
    )
