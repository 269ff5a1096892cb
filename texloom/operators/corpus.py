"""Pairs of documents: joined with their lengths, filtered, ordered, sampled and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import ranked, ranked_within, seeded_hash


def pair_lengths(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs of which both documents are at hand, with lengths (slen, tlen) and fingerprints (shash, thash).

    ``pairs``: ex_id, ds, src, tgt, label. A pair with a missing document is dropped; see ``missing_sides``.
    """
    one = info.select(F.col("doc_id").alias("src"), F.col("n_words").alias("slen"), F.col("fingerprint").alias("shash"))
    two = info.select(F.col("doc_id").alias("tgt"), F.col("n_words").alias("tlen"), F.col("fingerprint").alias("thash"))
    return pairs.select("ex_id", "ds", "src", "tgt", "label").join(one, "src").join(two, "tgt")


def missing_sides(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """doc_id and n_pairs of each document that pairs name and that isn't at hand."""
    named = pairs.select(F.explode(F.array("src", "tgt")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n_pairs"))
    return named.join(info.select("doc_id"), "doc_id", "left_anti")


def within(lengths: DataFrame, low: int, high: int, *cols: str) -> DataFrame:
    """Rows of which every length is at least ``low`` and below ``high``."""
    keep = F.lit(True)
    for c in cols:
        keep = keep & (F.col(c) >= low) & (F.col(c) < high)
    return lengths.where(keep)


def sentences_between(info: DataFrame, low: int, high: int) -> DataFrame:
    """Documents of ``low`` to ``high`` lines, both included."""
    return info.where(F.col("n_lines").between(low, high))


def only(df: DataFrame, col: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Rows whose ``col`` is included (all if the list is empty) and not excluded; exclusion goes first."""
    out = df.where(~F.col(col).isin(exclude)) if exclude else df
    return out.where(F.col(col).isin(include)) if include else out


def training_order(lengths: DataFrame, by_length: bool = True) -> DataFrame:
    """Adds row_no: sources by length (longest first) and hash, their positives before their negatives."""
    order = [F.col("slen").desc()] if by_length else []
    return ranked(lengths, *order, F.col("shash"), F.col("label").desc(), F.col("ds"), F.col("ex_id"))


def source_buckets(lengths: DataFrame, per_bucket: int = 1000) -> DataFrame:
    """Adds bucket: sources, in the order of their hashes, in groups of ``per_bucket``."""
    numbered = ranked(lengths.select("shash").distinct(), F.col("shash"), name="_no")
    return lengths.join(numbered.select("shash", F.floor((F.col("_no") - 1) / per_bucket).alias("bucket")), "shash")


def corpus_statistics(pairs: DataFrame, lengths: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per dataset: pairs, pairs with both texts, pairs kept, and mean and longest length of the distinct sources."""
    a = pairs.groupBy("ds").agg(F.count("*").alias("pairs"))
    b = lengths.groupBy("ds").agg(F.count("*").alias("with_texts"))
    c = kept.groupBy("ds").agg(F.count("*").alias("kept"))
    d = lengths.select("ds", "src", "slen").distinct().groupBy("ds").agg(F.count("*").alias("sources"), F.round(F.avg("slen"), 6).alias("mean_len"), F.max("slen").alias("max_len"))
    return a.join(b, "ds", "left").join(c, "ds", "left").join(d, "ds", "left").na.fill(0, ["with_texts", "kept", "sources"])


def _place(key: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*key).orderBy(*order))


def balanced(pairs: DataFrame, seed: int = 1) -> DataFrame:
    """As many positives as negatives of each source, chosen by a seeded hash; sources with only one kind are left out.

    A source may have any number of pairs: places are counted by ranges, never in one task for a source.
    """
    h = seeded_hash(seed, F.col("src"), F.col("tgt"), F.col("ex_id"))
    n = pairs.groupBy("src").agg(F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_n")).where("_p > 0 AND _n > 0")
    own = ranked_within(pairs.withColumn("_h", h), ["src", "label"], F.col("_h"), F.col("ex_id"), name="_no").join(n, "src")
    return own.where(F.col("_no") <= F.least("_p", "_n")).drop("_no", "_p", "_n", "_h")


def extremes(rated: DataFrame, k: int = 5, max_sources: int | None = None) -> DataFrame:
    """The ``k`` best positives and the ``k`` worst negatives of each source that has both; of the first ``max_sources`` such sources only, if said.

    ``rated``: src, tgt, label, rating. Each task keeps k rows of a source before any are shuffled.
    """
    both = rated.groupBy("src").agg(F.max("label").alias("_a"), F.min("label").alias("_b")).where("_a = 1 AND _b = 0").select("src")
    if max_sources is not None:
        both = ranked(both, F.col("src"), name="_s").where(F.col("_s") <= max_sources).drop("_s")
    signed = F.when(F.col("label") == 1, -F.col("rating")).otherwise(F.col("rating"))
    return rated.withColumn("place", _place(["src", "label"], signed.asc(), F.col("tgt"))).where(F.col("place") <= k).join(both, "src")


def interleaved(pairs: DataFrame) -> DataFrame:
    """Adds place (from 1): positives and negatives of a source in turn, by ex_id; what one kind has more comes at the end."""
    turn = ranked_within(pairs, ["src", "label"], F.col("ex_id"), name="_turn")
    return ranked_within(turn, ["src"], F.col("_turn"), F.col("label").desc(), F.col("ex_id")).drop("_turn")


def sampled_targets(pairs: DataFrame, low: int, high: int, seed: int = 3) -> DataFrame:
    """``low`` to ``high`` targets per source and label, how many and which by seeded hashes. Each task keeps ``high`` of them before any are shuffled."""
    h = seeded_hash(seed, F.col("src"), F.col("tgt"), F.col("ex_id"))
    digit = F.conv(F.substring(seeded_hash(seed, F.col("src")), 1, 4), 16, 10).cast("bigint")
    most = low + F.pmod(digit, F.lit(high - low + 1))
    return pairs.withColumn("_no", _place(["src", "label"], h, F.col("ex_id"))).where(F.col("_no") <= high).where(F.col("_no") <= most).drop("_no")


def truncated_targets(lengths: DataFrame, budget: int, acceptable: float = 0.5, max_sents: int | None = None) -> DataFrame:
    """Targets of a source cut in proportion where they exceed ``budget`` tokens, or ``max_sents`` sentences, together.

    Adds new_len = floor(budget * tlen / total) and mean_lost, the mean share of a target's tokens that
    is cut off; with ``max_sents`` (which needs the column tsents) new_sents and mean_sents_lost alike. Sources of which more than
    ``acceptable`` would be lost on average, of either, are left out; nothing is lost where the budget is kept.
    """
    out = lengths
    for col, new, lost, most in [("tlen", "new_len", "mean_lost", budget)] + ([("tsents", "new_sents", "mean_sents_lost", max_sents)] if max_sents is not None else []):
        total = lengths.groupBy("src").agg(F.sum(col).alias("_total"))
        each = out.join(total, "src").withColumn(new, F.when(F.col("_total") > most, F.floor(F.lit(most) * F.col(col) / F.col("_total"))).otherwise(F.col(col)).cast("bigint"))
        share = each.groupBy("src").agg(F.round(F.avg(1 - F.col(new) / F.greatest(F.col(col), F.lit(1))), 6).alias("_lost"), F.max("_total").alias("_all"))
        share = share.select("src", F.when(F.col("_all") > most, F.col("_lost")).otherwise(0.0).alias(lost)).where(F.col(lost) <= acceptable)
        out = each.drop("_total").join(share, "src")
    return out


def distinct_targets(batch: DataFrame) -> DataFrame:
    """Targets of equal text once per batch, and the positives of each source with reference to them.

    ``batch``: batch_id, src, tgt, label, thash. Returns batch_id, src, target (the least tgt with that
    text in the batch), n_links.
    """
    first = batch.groupBy("batch_id", "thash").agg(F.min("tgt").alias("target"))
    return batch.where("label = 1").join(first, ["batch_id", "thash"]).groupBy("batch_id", "src", "target").agg(F.count("*").alias("n_links"))


def linked_duplicates(batch: DataFrame, dups: DataFrame) -> DataFrame:
    """As ``distinct_targets``, and a source is linked as well to each target of its batch that is a duplicate of one of its positives.

    ``dups``: thash, dup_hash: texts that stand for each other. All sources of a text are linked, not only the last.
    """
    own = batch.where("label = 1").select("batch_id", "src", "thash")
    also = own.join(dups, "thash").select("batch_id", "src", F.col("dup_hash").alias("thash"))
    first = batch.groupBy("batch_id", "thash").agg(F.min("tgt").alias("target"))
    return own.unionByName(also).distinct().join(first, ["batch_id", "thash"]).groupBy("batch_id", "src", "target").agg(F.count("*").alias("n_links"))


def useful_batches(batch: DataFrame) -> DataFrame:
    """batch_id, n_src, n_tgt, n_pos of the batches that aren't one source with nothing but positives."""
    per = batch.groupBy("batch_id").agg(
        F.countDistinct("src").alias("n_src"), F.countDistinct("tgt").alias("n_tgt"), F.countDistinct(F.when(F.col("label") == 1, F.col("tgt"))).alias("n_pos")
    )
    return per.where(~((F.col("n_src") == 1) & (F.col("n_pos") == F.col("n_tgt"))))


def united(datasets: dict[str, DataFrame]) -> DataFrame:
    """Pairs of several datasets (src, tgt, label) with their name (ds) and number (ds_no, by name)."""
    out = None
    for k, name in enumerate(sorted(datasets)):
        one = datasets[name].select(F.lit(name).alias("ds"), F.lit(k).alias("ds_no"), "src", "tgt", "label")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no dataset")
    return out


def combined_splits(pairs: DataFrame, info: DataFrame, low: int, high: int, splits: tuple[str, ...] = ("train", "dev")) -> dict[str, DataFrame]:
    """Each split's pairs with both texts of ``low`` to ``high`` words, in training order: what training starts from. ``pairs``: ex_id, split, ds, src, tgt, label."""
    out = {}
    for s in splits:
        own = pairs.where(F.lower(F.trim("split")) == s)
        out[s] = training_order(within(pair_lengths(own, info), low, high, "slen", "tlen"))
    return out
