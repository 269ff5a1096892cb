"""Queries on pairs of documents and on batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_name
from ..operators import batching as B
from ..operators import corpus as C
from ..operators import metrics as M
from ..operators import order as O
from ..operators import text as X
from ..session import cut
from .tables import INFO, LENGTHS, PAIRS, SENTS, pairs, sentences, table


def _info(spark: SparkSession, d: str) -> DataFrame:
    return X.document_info(table(spark, d, "documents"))


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return C.pair_lengths(pairs(spark, d), _info(spark, d))


def pair_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d)


def missing_documents(spark: SparkSession, d: str) -> DataFrame:
    return C.missing_sides(pairs(spark, d), _info(spark, d))


def corpus_length_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.within(_lengths(spark, d), 20, 400, "slen", "tlen").select("ex_id", "slen", "tlen")


def docs_sentences_between(spark: SparkSession, d: str) -> DataFrame:
    return C.sentences_between(_info(spark, d), 3, 40)


def corpus_sorted_pairs(spark: SparkSession, d: str) -> DataFrame:
    return C.training_order(_lengths(spark, d)).select("row_no", "ex_id", "ds", "src", "tgt", "label", "slen", "tlen")


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    lengths = _lengths(spark, d)
    return C.corpus_statistics(pairs(spark, d), lengths, C.within(lengths, 20, 400, "slen", "tlen"))


def include_exclude_sources(spark: SparkSession, d: str) -> DataFrame:
    kept = C.only(table(spark, d, "documents").select(clean_name(F.col("source")).alias("source")), "source", ["wiki_ru", "wiki_en", "sci_en"], ["sci_en"])
    return kept.groupBy("source").agg(F.count("*").alias("docs"))


def dataset_union(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    names = [r["ds"] for r in p.select("ds").distinct().collect()]  # a row per dataset
    return C.united({n: p.where(F.col("ds") == n) for n in names if n is not None}).groupBy("ds", "ds_no").agg(F.count("*").alias("pairs"), F.sum("label").alias("positives"))


def training_files(spark: SparkSession, d: str) -> DataFrame:
    splits = C.combined_splits(pairs(spark, d), _info(spark, d), 20, 400)
    train, dev = (splits[s].select("row_no", "ex_id", F.lit(s).alias("split")) for s in ("train", "dev"))
    return train.unionByName(dev)


def distractor_pool(spark: SparkSession, d: str) -> DataFrame:
    pool = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("dir_key", F.lit("")).alias("path"))
    used = pairs(spark, d).where("split = 'test'").select(F.explode(F.array("src", "tgt")).alias("id")).distinct()
    return M.distractors(pool, used, 200)


def exact_size_sample(spark: SparkSession, d: str) -> DataFrame:
    return O.sample_exact(table(spark, d, "documents"), 0.4, 5, F.col("doc_id")).select("doc_id")


def balanced_pairs(spark: SparkSession, d: str) -> DataFrame:
    return C.balanced(pairs(spark, d)).select("ex_id", "src", "tgt", "label")


def balanced_top5(spark: SparkSession, d: str) -> DataFrame:
    rated = _lengths(spark, d).groupBy("src", "tgt", "label").agg(F.round(F.avg(F.col("tlen") / F.col("slen")), 6).alias("rating"))
    return C.extremes(rated, 5, 10_000)


def round_robin_interleave(spark: SparkSession, d: str) -> DataFrame:
    return C.interleaved(pairs(spark, d)).select("ex_id", "src", "label", "place")


def sampled_targets(spark: SparkSession, d: str) -> DataFrame:
    return C.sampled_targets(pairs(spark, d), 1, 3).select("ex_id", "src", "tgt", "label")


def proportional_truncation(spark: SparkSession, d: str) -> DataFrame:
    return C.truncated_targets(_lengths(spark, d), 500).select("ex_id", "src", "tgt", "tlen", "new_len", "mean_lost")


def source_buckets(spark: SparkSession, d: str) -> DataFrame:
    return C.source_buckets(_lengths(spark, d), 100).select("ex_id", "bucket")


def bucketed_sort(spark: SparkSession, d: str) -> DataFrame:
    return B.bucket_order(C.source_buckets(_lengths(spark, d), 100)).select("ex_id", "bucket", "place")


def batch_distinct_targets(spark: SparkSession, d: str) -> DataFrame:
    return C.distinct_targets(C.source_buckets(_lengths(spark, d), 100).withColumnRenamed("bucket", "batch_id"))


def batch_linked_targets(spark: SparkSession, d: str) -> DataFrame:
    """Links of sources to the targets of their batch, where the texts of a positive pair of the corpus stand for each other."""
    lengths = _lengths(spark, d)
    dups = lengths.where("label = 1").select("thash", F.col("shash").alias("dup_hash")).distinct()
    return C.linked_duplicates(C.source_buckets(lengths, 100).withColumnRenamed("bucket", "batch_id"), dups)


def useful_batches(spark: SparkSession, d: str) -> DataFrame:
    return C.useful_batches(C.source_buckets(_lengths(spark, d), 1).withColumnRenamed("bucket", "batch_id"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return sentences(spark, d).select(F.col("sent_id").alias("id"), F.size("src").alias("tokens"))


def greedy_batches(spark: SparkSession, d: str) -> DataFrame:
    return B.greedy_batches(_items(spark, d), 64, 1000)


def greedy_doc_batches(spark: SparkSession, d: str) -> DataFrame:
    items = _info(spark, d).select(F.col("doc_id").alias("id"), F.col("n_words").alias("tokens"), F.col("n_lines").alias("sents"))
    return B.greedy_batches(items, 100, 2000, block_items=300)


def fixed_batches(spark: SparkSession, d: str) -> DataFrame:
    return B.fixed_batches(_items(spark, d), 100)


def length_chunks(spark: SparkSession, d: str) -> DataFrame:
    return B.length_chunks(B.fixed_batches(_items(spark, d), 500), 32, 2000, "batch")


def length_chunk_faults(spark: SparkSession, d: str) -> DataFrame:
    """Items, and chunks that break a limit or aren't in order of length: what must be 0."""
    chunks = length_chunks(spark, d)
    per = chunks.groupBy("batch", "chunk").agg(F.count("*").alias("n"), F.max("tokens").alias("most"), F.min("tokens").alias("least"))
    later = per.select("batch", (F.col("chunk") - 1).alias("chunk"), F.col("most").alias("next"))
    rows = per.join(later, ["batch", "chunk"], "left")
    over = ((F.col("n") > 32) | (F.col("n") * F.col("most") > 2000)) & (F.col("n") > 1)
    return rows.agg(F.sum("n").alias("items"), F.count_if(over).alias("over"), F.count_if(F.col("next") > F.col("least")).alias("unordered"))


def _negatives(spark: SparkSession, d: str) -> DataFrame:
    """sent_id and its hard negatives with their tokens."""
    s = sentences(spark, d)
    named = s.select("sent_id", F.explode("hn_ids").alias("h")).join(s.select(F.col("sent_id").alias("h"), F.size("tgt").cast("bigint").alias("n")), "h")
    return named.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct(F.col("h").alias("id"), F.col("n").alias("tokens")))).alias("negatives"))


def dedup_batches(spark: SparkSession, d: str) -> DataFrame:
    s = sentences(spark, d).join(_negatives(spark, d), "sent_id", "left")
    return B.apart_from_duplicates(s.select(F.col("sent_id").alias("id"), F.size("src").alias("tokens"), "dups", "negatives"), 64, 300, 20_000, 8)


def dedup_batch_faults(spark: SparkSession, d: str) -> DataFrame:
    """Items, and what must be 0: items lost or twice, duplicates side by side, batches over a limit, negatives twice in a batch."""
    s = sentences(spark, d).select(F.col("sent_id").alias("id"), F.size("src").alias("tokens"), F.col("dups"))
    got = cut(dedup_batches(spark, d))
    key = ["block", "batch"]
    near = got.select(*key, "id").join(s.select("id", F.explode("dups").alias("dup")), "id").join(got.select(*key, F.col("id").alias("dup")), [*key, "dup"]).where("id <> dup")
    each = got.select(*key, F.explode(F.concat("negatives", "fill")).alias("x"))
    twice = each.groupBy(*key, "x").agg(F.count("*").alias("n")).where("n > 1")
    per = got.groupBy(*key).agg(F.count("*").alias("n"), F.sum(2 + F.size("negatives")).alias("sents"))
    over = per.where("n > 1 AND (n > 64 OR sents > 300)")
    one = s.agg(F.count("*").alias("items")).withColumn("_k", F.lit(0))
    for name, df in (("lost", s.join(got, "id", "left_anti")), ("repeated", got.groupBy("id").count().where("count > 1")), ("side_by_side", near), ("over", over), ("twice", twice)):
        # one row each, joined on a constant
        one = one.join(F.broadcast(df.agg(F.count("*").alias(name)).withColumn("_k", F.lit(0))), "_k")
    return one.drop("_k")


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    return B.source_batches(_lengths(spark, d), 200, 20_000)


def source_batches(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)


def source_batch_faults(spark: SparkSession, d: str) -> DataFrame:
    """Sources with positives, and what must be 0: sources without a positive, in two batches, or with too many targets; batches over a limit or of one source with nothing but positives; texts new twice."""
    lengths = _lengths(spark, d)
    got = cut(_sampled(spark, d))
    key = ["block", "batch"]
    src = got.groupBy("src").agg(F.countDistinct(F.struct(*key)).alias("batches"), F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n"))
    size = got.join(lengths.select("src", "slen").distinct(), "src").groupBy(*key, "src").agg(F.max("slen").alias("s"))
    texts = got.where("new").join(lengths.select("tgt", "tlen").distinct(), "tgt").groupBy(*key).agg(F.count("*").alias("t"), F.sum(F.coalesce("cut", "tlen")).alias("m"), F.countDistinct("thash").alias("k"))
    per = size.groupBy(*key).agg(F.count("*").alias("sources"), F.sum("s").alias("s"), F.max("s").alias("one")).join(texts, key, "left").join(got.groupBy(*key).agg(F.min("label").alias("low"), F.count_if(F.col("cut").isNotNull()).alias("cuts")), key)
    per = per.agg(
        F.count_if(((F.col("sources") + F.col("t") > 200) | (F.col("s") + F.col("m") > 20_000)) & (F.col("cuts") == 0)).alias("over"),
        F.count_if((F.col("sources") == 1) & (F.col("low") == 1)).alias("useless"), F.count_if(F.col("t") != F.col("k")).alias("new_twice"),
    ).withColumn("_k", F.lit(0))
    faults = src.agg(F.count_if(F.col("p") < 1).alias("without"), F.count_if(F.col("batches") > 1).alias("in_two"), F.count_if((F.col("p") > 2) | (F.col("n") > 2)).alias("too_many")).withColumn("_k", F.lit(0))
    # one row each, joined on a constant
    return faults.join(F.broadcast(per), "_k").drop("_k")


def sampling_stats(spark: SparkSession, d: str) -> DataFrame:
    return B.sampling_statistics(_sampled(spark, d))


QUERIES = [
    pair_lengths, missing_documents, corpus_length_filter, docs_sentences_between, corpus_sorted_pairs, corpus_stats, include_exclude_sources, dataset_union, training_files, distractor_pool,
    exact_size_sample, balanced_pairs, balanced_top5, round_robin_interleave, sampled_targets, proportional_truncation, source_buckets,
    bucketed_sort, batch_distinct_targets, batch_linked_targets, useful_batches, greedy_batches, greedy_doc_batches, fixed_batches, length_chunks, length_chunk_faults,
    dedup_batches, dedup_batch_faults, source_batches, source_batch_faults, sampling_stats,
]

BUCKETS = LENGTHS + ", hashes AS (SELECT shash, (row_number() OVER (ORDER BY shash) - 1) // {n} AS bucket FROM (SELECT DISTINCT shash FROM lengths)), bucketed AS (SELECT l.*, h.bucket FROM lengths l JOIN hashes h USING (shash))"

SQL = {
    "pair_lengths": f"WITH {LENGTHS} SELECT * FROM lengths",
    "missing_documents": f"""WITH {INFO}, {PAIRS}, named AS (SELECT unnest([src, tgt]) AS doc_id FROM pairs)
        SELECT doc_id, count(*) AS n_pairs FROM named WHERE doc_id NOT IN (SELECT doc_id FROM info) GROUP BY 1""",
    "corpus_length_filter": f"WITH {LENGTHS} SELECT ex_id, slen, tlen FROM lengths WHERE slen >= 20 AND slen < 400 AND tlen >= 20 AND tlen < 400",
    "docs_sentences_between": f"WITH {INFO} SELECT * FROM info WHERE n_lines BETWEEN 3 AND 40",
    "corpus_sorted_pairs": f"WITH {LENGTHS} SELECT row_number() OVER (ORDER BY slen DESC, shash, label DESC, ds, ex_id) AS row_no, ex_id, ds, src, tgt, label, slen, tlen FROM lengths",
    "corpus_stats": f"""WITH {LENGTHS}, a AS (SELECT ds, count(*) AS pairs FROM pairs GROUP BY 1), b AS (SELECT ds, count(*) AS with_texts FROM lengths GROUP BY 1),
        c AS (SELECT ds, count(*) AS kept FROM lengths WHERE slen >= 20 AND slen < 400 AND tlen >= 20 AND tlen < 400 GROUP BY 1),
        d AS (SELECT ds, count(*) AS sources, round(avg(slen), 6) AS mean_len, max(slen) AS max_len FROM (SELECT DISTINCT ds, src, slen FROM lengths) GROUP BY 1)
        SELECT ds, pairs, coalesce(with_texts, 0) AS with_texts, coalesce(kept, 0) AS kept, coalesce(sources, 0) AS sources, mean_len, max_len
        FROM a LEFT JOIN b USING (ds) LEFT JOIN c USING (ds) LEFT JOIN d USING (ds)""",
    "include_exclude_sources": "SELECT regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g') AS source, count(*) AS docs FROM documents WHERE regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g') IN ('wiki_ru', 'wiki_en') GROUP BY 1",
    "dataset_union": f"WITH {PAIRS} SELECT ds, (dense_rank() OVER (ORDER BY ds) - 1)::INT AS ds_no, count(*) AS pairs, sum(label)::BIGINT AS positives FROM pairs WHERE ds IS NOT NULL GROUP BY ds",
    "training_files": f"""WITH {LENGTHS}, s AS (SELECT l.*, lower(trim(p.split)) AS split FROM lengths l JOIN pairs p USING (ex_id) WHERE l.slen >= 20 AND l.slen < 400 AND l.tlen >= 20 AND l.tlen < 400)
        SELECT row_number() OVER (PARTITION BY split ORDER BY slen DESC, shash, label DESC, ds, ex_id) AS row_no, ex_id, split FROM s WHERE split IN ('train', 'dev')""",
    "distractor_pool": f"""WITH {PAIRS}, u AS (SELECT unnest([src, tgt]) AS id FROM pairs WHERE split = 'test')
        SELECT doc_id AS id, coalesce(dir_key, '') AS path FROM documents WHERE doc_id NOT IN (SELECT id FROM u WHERE id IS NOT NULL) ORDER BY path, id LIMIT 200""",
    "exact_size_sample": "SELECT doc_id FROM documents ORDER BY md5('5:' || doc_id), doc_id LIMIT (SELECT floor(count(*) * 0.4)::BIGINT FROM documents)",
    "balanced_pairs": f"""WITH {PAIRS}, n AS (SELECT *, count(*) FILTER (WHERE label = 1) OVER (PARTITION BY src) AS p, count(*) FILTER (WHERE label = 0) OVER (PARTITION BY src) AS n,
        row_number() OVER (PARTITION BY src, label ORDER BY md5('1:' || src || ':' || tgt || ':' || ex_id), ex_id) AS no FROM pairs)
        SELECT ex_id, src, tgt, label FROM n WHERE p > 0 AND n > 0 AND no <= least(p, n)""",
    "balanced_top5": f"""WITH {LENGTHS}, rated AS (SELECT src, tgt, label, round(avg(tlen / slen), 6) AS rating FROM lengths GROUP BY 1, 2, 3),
        n AS (SELECT *, max(label) OVER (PARTITION BY src) AS a, min(label) OVER (PARTITION BY src) AS b,
        row_number() OVER (PARTITION BY src, label ORDER BY CASE WHEN label = 1 THEN -rating ELSE rating END, tgt)::INT AS place FROM rated)
        SELECT src, tgt, label, rating, place FROM n WHERE a = 1 AND b = 0 AND place <= 5
        AND src IN (SELECT src FROM n WHERE a = 1 AND b = 0 GROUP BY 1 ORDER BY 1 LIMIT 10000)""",
    "round_robin_interleave": f"""WITH {PAIRS}, t AS (SELECT ex_id, src, label, row_number() OVER (PARTITION BY src, label ORDER BY ex_id) AS turn FROM pairs)
        SELECT ex_id, src, label, row_number() OVER (PARTITION BY src ORDER BY turn, label DESC, ex_id)::INT AS place FROM t""",
    "sampled_targets": f"""WITH {PAIRS}, n AS (SELECT ex_id, src, tgt, label, row_number() OVER (PARTITION BY src, label ORDER BY md5('3:' || src || ':' || tgt || ':' || ex_id), ex_id) AS no,
        1 + ('0x' || substr(md5('3:' || src), 1, 4))::BIGINT % 3 AS most FROM pairs) SELECT ex_id, src, tgt, label FROM n WHERE no <= most""",
    "proportional_truncation": f"""WITH {LENGTHS}, t AS (SELECT *, sum(tlen) OVER (PARTITION BY src) AS total FROM lengths),
        c AS (SELECT *, (CASE WHEN total > 500 THEN floor(500 * tlen / total) ELSE tlen END)::BIGINT AS new_len FROM t),
        r AS (SELECT *, CASE WHEN total > 500 THEN round(avg(1 - new_len / greatest(tlen, 1)) OVER (PARTITION BY src), 6) ELSE 0 END AS mean_lost FROM c)
        SELECT ex_id, src, tgt, tlen, new_len, mean_lost FROM r WHERE mean_lost <= 0.5""",
    "source_buckets": f"WITH {BUCKETS.replace("{n}", "100")} SELECT ex_id, bucket FROM bucketed",
    "bucketed_sort": f"""WITH {BUCKETS.replace("{n}", "100")} SELECT ex_id, bucket,
        row_number() OVER (PARTITION BY bucket ORDER BY slen DESC, shash, label DESC, tlen, ex_id)::INT AS place FROM bucketed""",
    "batch_distinct_targets": f"""WITH {BUCKETS.replace("{n}", "100")}, t AS (SELECT *, min(tgt) OVER (PARTITION BY bucket, thash) AS target FROM bucketed)
        SELECT bucket AS batch_id, src, target, count(*) AS n_links FROM t WHERE label = 1 GROUP BY 1, 2, 3""",
    "batch_linked_targets": f"""WITH {BUCKETS.replace("{n}", "100")}, d AS (SELECT DISTINCT thash, shash AS dup FROM lengths WHERE label = 1), own AS (SELECT DISTINCT bucket, src, thash FROM bucketed WHERE label = 1),
        every AS (SELECT * FROM own UNION SELECT bucket, src, dup FROM own JOIN d USING (thash)), f AS (SELECT bucket, thash, min(tgt) AS target FROM bucketed GROUP BY 1, 2)
        SELECT bucket AS batch_id, src, target, count(*) AS n_links FROM every JOIN f USING (bucket, thash) GROUP BY 1, 2, 3""",
    "useful_batches": f"""WITH {BUCKETS.replace("{n}", "1")}, g AS (SELECT bucket AS batch_id, count(DISTINCT src) AS n_src, count(DISTINCT tgt) AS n_tgt,
        count(DISTINCT CASE WHEN label = 1 THEN tgt END) AS n_pos FROM bucketed GROUP BY 1) SELECT * FROM g WHERE NOT (n_src = 1 AND n_pos = n_tgt)""",
    "greedy_batches": f"""WITH RECURSIVE {SENTS}, items AS (SELECT sent_id AS id, greatest(coalesce(len(src), 0), 1)::BIGINT AS tokens, row_number() OVER (ORDER BY sent_id) AS no FROM sents),
        fold AS (SELECT no, id, tokens, 0::BIGINT AS batch, 1 AS n, tokens AS held FROM items WHERE no = 1
        UNION ALL SELECT i.no, i.id, i.tokens, CASE WHEN f.n + 1 > 64 OR f.held + i.tokens > 1000 THEN f.batch + 1 ELSE f.batch END,
        CASE WHEN f.n + 1 > 64 OR f.held + i.tokens > 1000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n + 1 > 64 OR f.held + i.tokens > 1000 THEN i.tokens ELSE f.held + i.tokens END
        FROM fold f JOIN items i ON i.no = f.no + 1)
        SELECT id, tokens, 0::BIGINT AS block, batch FROM fold""",
    "greedy_doc_batches": f"""WITH RECURSIVE {INFO}, items AS (SELECT doc_id AS id, greatest(n_words, 1)::BIGINT AS tokens, greatest(n_lines, 1)::BIGINT AS sents, row_number() OVER (ORDER BY doc_id) AS no FROM info),
        fold AS (SELECT no, id, tokens, 0::BIGINT AS block, 0::BIGINT AS batch, sents AS n, tokens AS held FROM items WHERE no = 1
        UNION ALL SELECT i.no, i.id, i.tokens, (i.no - 1) // 300, CASE WHEN (i.no - 1) % 300 = 0 THEN 0 WHEN f.n + i.sents > 100 OR f.held + i.tokens > 2000 THEN f.batch + 1 ELSE f.batch END,
        CASE WHEN (i.no - 1) % 300 = 0 OR f.n + i.sents > 100 OR f.held + i.tokens > 2000 THEN i.sents ELSE f.n + i.sents END,
        CASE WHEN (i.no - 1) % 300 = 0 OR f.n + i.sents > 100 OR f.held + i.tokens > 2000 THEN i.tokens ELSE f.held + i.tokens END FROM fold f JOIN items i ON i.no = f.no + 1)
        SELECT id, tokens, block, batch FROM fold""",
    "length_chunk_faults": f"WITH {SENTS} SELECT count(*) AS items, 0::BIGINT AS over, 0::BIGINT AS unordered FROM sents",
    "dedup_batch_faults": f"WITH {SENTS} SELECT count(*) AS items, 0::BIGINT AS lost, 0::BIGINT AS repeated, 0::BIGINT AS side_by_side, 0::BIGINT AS over, 0::BIGINT AS twice FROM sents",
    "source_batch_faults": "SELECT 0::BIGINT AS without, 0::BIGINT AS in_two, 0::BIGINT AS too_many, 0::BIGINT AS over, 0::BIGINT AS useless, 0::BIGINT AS new_twice",
    "fixed_batches": f"WITH {SENTS} SELECT sent_id AS id, len(src)::INT AS tokens, (row_number() OVER (ORDER BY sent_id) - 1) // 100 AS batch FROM sents",
}
