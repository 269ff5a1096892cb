"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import chunking, encoding, mixing, mojibake, overlap, packing, sentences, vectors
from .common import clean_name, latest, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return sentences.split_sentences(docs, _judge(docs))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_pairs(vectors.most_similar(vectors.usable(table(spark, d, "doc_vectors"), 96)))


def p2_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return vectors.most_similar(vectors.usable(table(spark, d, "doc_vectors"), 96))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    split = chunking.split_oversized(table(spark, d, "documents"), table(spark, d, "model_confs"))
    return split.where(F.size("pieces") > 1).select("doc_id", "conf_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pieces_of(chunking.split_oversized(table(spark, d, "documents"), table(spark, d, "model_confs"), with_text=True))


def p3_faults(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return chunking.splitting_faults(docs, table(spark, d, "model_confs"), p3_pieces(spark, d))


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_overlaps(overlap.records(table(spark, d, "combined_pairs")), table(spark, d, "documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("eval_id", "train_id").alias("ex_id_a"), F.greatest("eval_id", "train_id").alias("ex_id_b"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(overlap.records(table(spark, d, "combined_pairs"), "ds"), table(spark, d, "documents"))


def p4_containment(spark: SparkSession, d: str) -> DataFrame:
    return overlap.near_classes(overlap.records(table(spark, d, "combined_pairs")), table(spark, d, "documents"))


def _to_pack(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sents = latest(table(spark, d, "sent_pairs").select("sent_id", "ds", "loaded_at", F.coalesce("src_len", F.size("src")).alias("tokens")), "sent_id")
    confs = table(spark, d, "batch_confs").select("conf_id", clean_name(F.col("ds")).alias("grp"), F.col("max_tokens").alias("capacity"))
    return sents.select(F.col("sent_id").alias("item"), clean_name(F.col("ds")).alias("grp"), "tokens"), confs


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_items(*_to_pack(spark, d)).where("parts > 1 AND part = 1").select(F.col("item").alias("sent_id"), "conf_id")


def p5_batches(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_items(*_to_pack(spark, d)).withColumnRenamed("item", "sent_id")


def p5_faults(spark: SparkSession, d: str) -> DataFrame:
    items, confs = _to_pack(spark, d)
    return packing.packing_faults(items, confs, cut(packing.pack_items(items, confs)))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.measured(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.mix_report(mixing.mix(mixing.measured(table(spark, d, "documents")), targets), targets)


def p7_inclusion(spark: SparkSession, d: str) -> DataFrame:
    return mixing.inclusion_report(mixing.measured(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def _judge(docs: DataFrame) -> mojibake.Judge:
    return mojibake.fit(docs)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return mojibake.garbled(docs, _judge(docs), with_text=False)


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return mojibake.garbled(docs, _judge(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    """What SQL can express on whole tables; the rest is tested against brute force and round trips."""
    good = """good AS (SELECT ids AS id, max(embs::DOUBLE[]) AS v FROM doc_vectors WHERE len(embs) = 96
        AND len(list_filter(embs, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embs, lambda x: x <> 0)) > 0 GROUP BY 1)"""
    return {
        "p2_found": f"""WITH {good}, n AS (SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM good),
            s AS (SELECT a.id AS x, b.id AS y, list_inner_product(a.v, b.v) / (a.n * b.n) AS c FROM n a, n b WHERE a.id <> b.id),
            k AS (SELECT x, y FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY c DESC, y) <= 10)
            SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM k""",
        "p3_found": "SELECT doc_id, conf_id FROM documents, model_confs WHERE split_input AND length(text) > coalesce(max_chunk_size, 512)",
        "p3_faults": """SELECT conf_id, count(*) AS texts, 0::BIGINT AS missing, 0::BIGINT AS too_long, 0::BIGINT AS overlap_wrong, 0::BIGINT AS text_wrong
            FROM documents, model_confs WHERE split_input AND length(text) > coalesce(max_chunk_size, 512) GROUP BY 1""",
        "p5_found": """WITH s AS (SELECT sent_id, arg_max({'ds': ds, 'n': coalesce(src_len, len(src))}, loaded_at) AS r FROM sent_pairs GROUP BY 1)
            SELECT sent_id, conf_id FROM s JOIN batch_confs b ON b.ds = s.r.ds WHERE s.r.n > coalesce(max_tokens, 96000)""",
        "p5_faults": """WITH s AS (SELECT sent_id, arg_max({'ds': ds, 'n': coalesce(src_len, len(src))}, loaded_at) AS r FROM sent_pairs GROUP BY 1)
            SELECT conf_id, count(*) AS items, sum(s.r.n)::BIGINT AS tokens, 0::BIGINT AS lost, 0::BIGINT AS needless_splits, 0::BIGINT AS overfull, 0::BIGINT AS miscounted
            FROM s JOIN batch_confs b ON b.ds = s.r.ds GROUP BY 1""",
    }
