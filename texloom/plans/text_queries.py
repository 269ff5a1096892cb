"""Queries on texts and token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.text import WHITE
from ..operators import documents as D
from ..operators import layers as L
from ..operators import text as X
from ..operators import tokenize as K
from ..session import cut
from .tables import INFO, SENTENCES, SENTS, WORDS, sentences, table


def _info(spark: SparkSession, d: str) -> DataFrame:
    return X.document_info(table(spark, d, "documents"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return X.sentence_lines(table(spark, d, "documents"))


def sentence_filter(spark: SparkSession, d: str) -> DataFrame:
    return X.filter_sentences(sentence_split(spark, d), 3, 0.5)


def doc_length_hash(spark: SparkSession, d: str) -> DataFrame:
    return _info(spark, d)


def exact_duplicate_docs(spark: SparkSession, d: str) -> DataFrame:
    return X.duplicate_groups(_info(spark, d))


def duplicate_classes(spark: SparkSession, d: str) -> DataFrame:
    return X.with_class(_info(spark, d))


def fragment_lengths(spark: SparkSession, d: str) -> DataFrame:
    return X.fragments(_info(spark, d), 16)


def text_hierarchy_lengths(spark: SparkSession, d: str) -> DataFrame:
    return X.hierarchy(sentence_split(spark, d), 16)


def capped_segments(spark: SparkSession, d: str) -> DataFrame:
    return X.capped_segments(table(spark, d, "documents"), 100, 3)


def prepared_fragments(spark: SparkSession, d: str) -> DataFrame:
    return X.prepared_texts(table(spark, d, "documents"), "frags", 120, 6, fragment=4)


def prepared_tokens(spark: SparkSession, d: str) -> DataFrame:
    return X.prepared_texts(table(spark, d, "documents"), "tokens", 150)


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    return X.prepared_texts(table(spark, d, "documents"), "sents_frags", 200, 12, fragment=4, max_ratio=0.5)


def prepared_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _prepared(spark, d)


def retruncated_texts(spark: SparkSession, d: str) -> DataFrame:
    return X.retruncated(_prepared(spark, d), 90, 8, 4)


def preparation_stats(spark: SparkSession, d: str) -> DataFrame:
    return X.preparation_statistics(X.prepared_texts(table(spark, d, "documents"), "sents", 100), _info(spark, d))


def token_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return X.token_fingerprint(sentences(spark, d).select(F.col("sent_id").alias("doc_id"), F.col("src").alias("tokens")))


def encode_statistics(spark: SparkSession, d: str) -> DataFrame:
    return X.encode_statistics(_info(spark, d), sentence_split(spark, d))


def truncate_special_tokens(spark: SparkSession, d: str) -> DataFrame:
    s = sentences(spark, d)
    return s.select("sent_id", S.with_special_tokens(F.col("src"), [1], [2], 16).alias("tokens"), S.token_count(F.array("src", "tgt"), 2, 16).alias("n_tokens"))


def padded_sequences(spark: SparkSession, d: str) -> DataFrame:
    s = sentences(spark, d).withColumn("length", S.round_up(F.size("src"), 8))
    return s.select("sent_id", "length", S.pad(F.col("src"), F.col("length")).alias("right_padded"), S.pad(F.col("src"), F.col("length"), left=True).alias("left_padded"))


def padded_documents(spark: SparkSession, d: str) -> DataFrame:
    s = sentences(spark, d)
    return s.select("sent_id", S.pad_all(F.array("src", "tgt"), 0, 4).alias("both"))


def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    """How many tokens each document has by words, between two special ones, cut at 64."""
    conf = K.TokenizerConf("words", prefix=(1,), suffix=(2,), max_length=64)
    seqs = K.tokenized(table(spark, d, "documents").select("doc_id", "text"), conf)
    return seqs.select("doc_id", F.size("tokens").alias("n_tokens"), F.try_element_at("tokens", F.lit(1)).alias("first"), F.try_element_at("tokens", F.lit(-1)).alias("last"))


def encoded_documents(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all documents by attention over words and averages over sentences and fragments."""
    sentence = L.SequenceEncoder(4096, 16, "transformer", layers=1, heads=2, positions="sinusoidal", pool="mean")
    encoder = L.HierarchicalEncoder(sentence, L.SequenceEncoder(8, 16), L.SequenceEncoder(8, 16), fragment=8)
    return D.encode_documents(table(spark, d, "documents").select("doc_id", "text"), encoder, K.TokenizerConf("words", max_length=128))


def encoded_document_faults(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and what must be 0: vectors not of unit length, and texts that got different vectors in different rows."""
    v = cut(encoded_documents(spark, d))
    far = v.where(F.abs(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x) - 1) > 1e-9)
    same = v.join(table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h")), "doc_id")
    apart = same.groupBy("h").agg(F.countDistinct(F.transform("vec", lambda x: F.round(x, 6))).alias("n")).where("n > 1")
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("_k", F.lit(0))
    # one row each, joined on a constant
    return one(v, "documents").join(F.broadcast(one(far, "not_unit")), "_k").join(F.broadcast(one(apart, "apart")), "_k").drop("_k")


def parsed_tokens(spark: SparkSession, d: str) -> DataFrame:
    s = sentences(spark, d).select("sent_id", F.array_join("src", " ").alias("line"))
    return s.select("sent_id", S.or_pad(S.parse_tokens(F.col("line"))).alias("tokens"))


QUERIES = [
    sentence_split, sentence_filter, doc_length_hash, exact_duplicate_docs, duplicate_classes, fragment_lengths, text_hierarchy_lengths,
    capped_segments, prepared_sentences, prepared_fragments, prepared_tokens, retruncated_texts, preparation_stats, token_fingerprints, encode_statistics, truncate_special_tokens, padded_sequences, padded_documents, word_tokens, encoded_documents, encoded_document_faults, parsed_tokens,
]



def _kept_sql(budget: int, least: int, kept: str, most: int = 1 << 30) -> str:
    """Sentences with what the kept ones before them use of a budget."""
    return f""", w AS (SELECT doc_id, sent_no, sentence, {WORDS} AS words, len(list_filter(regexp_extract_all(sentence, '(\\p{{Nd}}+[-–.]?\\p{{Nd}}*)|([\\p{{L}}\\p{{N}}_]+)', 1), lambda x: x <> '')) AS numbers,
        len(list_filter(regexp_extract_all(sentence, '(\\p{{Nd}}+[-–.]?\\p{{Nd}}*)|([\\p{{L}}\\p{{N}}_]+)', 2), lambda x: x <> '')) AS others FROM lined),
        z AS (SELECT *, ({kept}) AS kept FROM w), y AS (SELECT *, coalesce(sum(CASE WHEN kept THEN words ELSE 0 END) OVER r, 0) AS before, coalesce(sum(kept::INT) OVER r, 0) AS had FROM z
        WINDOW r AS (PARTITION BY doc_id ORDER BY sent_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        u AS (SELECT *, before < {budget} - 2 * {least} AND had < {most} AS used FROM y)"""


def _segments_sql(c: str) -> str:
    return f"list_transform(range(0, len({c}), 4), lambda s: least(4, len({c}) - s)::INT)"


PREPARED = (
    SENTENCES + _kept_sql(200, 3, "words >= 3 AND others > 0 AND numbers <= others * 0.5", 12) + ", t AS (SELECT doc_id FROM documents WHERE text IS NOT NULL),"
    " g AS (SELECT doc_id, list(least(words, 200 - before)::INT ORDER BY sent_no) FILTER (WHERE used AND kept) AS l, bool_or(NOT used) AS cut FROM u GROUP BY 1),"
    " prepared AS (SELECT doc_id, coalesce(l, []) AS lengths, coalesce(cut OR len(l) >= 12 OR list_sum(l) = 200, false) AS truncated FROM t LEFT JOIN g USING (doc_id))"
)

SQL = {
    "sentence_split": f"WITH {SENTENCES} SELECT doc_id, sent_no, sentence FROM lined",
    "sentence_filter": f"""WITH {SENTENCES}, n AS (SELECT doc_id, sent_no, sentence, {WORDS} AS words,
        len(list_filter(regexp_extract_all(sentence, '(\\p{{Nd}}+[-–.]?\\p{{Nd}}*)|([\\p{{L}}\\p{{N}}_]+)', 1), lambda x: x <> '')) AS numbers,
        len(list_filter(regexp_extract_all(sentence, '(\\p{{Nd}}+[-–.]?\\p{{Nd}}*)|([\\p{{L}}\\p{{N}}_]+)', 2), lambda x: x <> '')) AS others FROM lined)
        SELECT doc_id, sent_no, sentence FROM n WHERE words >= 3 AND others > 0 AND numbers <= others * 0.5""",
    "doc_length_hash": f"WITH {INFO} SELECT * FROM info",
    "exact_duplicate_docs": f"WITH {INFO} SELECT fingerprint, count(*) AS copies, min(doc_id) AS first_doc FROM info GROUP BY 1 HAVING count(*) > 1",
    "duplicate_classes": f"WITH {INFO} SELECT doc_id, min(doc_id) OVER (PARTITION BY fingerprint) AS class_id, count(*) OVER (PARTITION BY fingerprint) AS class_size FROM info",
    "fragment_lengths": f"""WITH {INFO}, f AS (SELECT doc_id, n_lines, unnest(range(0, n_lines, 16)) AS s FROM info)
        SELECT doc_id, (s // 16)::INT AS frag_no, least(n_lines - s, 16)::INT AS n_sents FROM f""",
    "text_hierarchy_lengths": f"WITH {SENTENCES} SELECT doc_id, (sent_no // 16)::INT AS frag_no, count(*) AS n_sents, sum({WORDS})::BIGINT AS n_tokens FROM lined GROUP BY 1, 2",
    "capped_segments": f"""WITH {SENTENCES}{_kept_sql(100, 3, "words >= 3")}, t AS (SELECT doc_id FROM documents WHERE text IS NOT NULL),
        g AS (SELECT doc_id, count(*) FILTER (WHERE used AND kept)::INT AS n_sents, coalesce(sum(CASE WHEN used AND kept THEN words END), 0) AS n, bool_or(NOT used) AS cut FROM u GROUP BY 1)
        SELECT doc_id, coalesce(n_sents, 0) AS n_sents, least(coalesce(n, 0), 100)::INT AS n_tokens, coalesce(cut OR n >= 100, false) AS truncated FROM t LEFT JOIN g USING (doc_id)""",
    "prepared_sentences": f"WITH {PREPARED} SELECT doc_id, lengths, {_segments_sql('lengths')} AS segments, truncated FROM prepared",
    "prepared_fragments": f"""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
        f AS (SELECT doc_id, unnest(range(0, len(l), 4)) AS s, l FROM l), n AS (SELECT doc_id, (s // 4)::INT AS no, list_sum(list_transform(l[s + 1 : s + 4], lambda x: len(list_filter(regexp_split_to_array(x, '[{WHITE}]+'), lambda y: y <> ''))))::INT AS n FROM f),
        b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
        u AS (SELECT doc_id, no, least(n, 120 - before)::INT AS n, before FROM b WHERE before < 120 AND no < 6)
        SELECT doc_id, list(n ORDER BY no) AS lengths, [count(*)::INT] AS segments, (count(*) >= 6 OR max(before + n) = 120) AS truncated FROM u GROUP BY 1""",
    "prepared_tokens": f"""WITH n AS (SELECT doc_id, least(len(list_filter(regexp_split_to_array(text, '[{WHITE}]+'), lambda x: x <> '')), 150)::INT AS n FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, [n] AS lengths, [1::INT] AS segments, n = 150 AS truncated FROM n""",
    "retruncated_texts": f"""WITH {PREPARED}, s AS (SELECT doc_id, unnest(lengths) AS n, generate_subscripts(lengths, 1) AS no FROM prepared),
        b2 AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
        k AS (SELECT doc_id, list(least(n, 90 - before)::INT ORDER BY no) FILTER (WHERE before < 84 AND no <= 8) AS l, bool_or(NOT (before < 84 AND no <= 8)) AS more FROM b2 GROUP BY 1),
        r AS (SELECT p.doc_id, p.lengths AS old, coalesce(l, []) AS lengths, coalesce(more OR len(l) >= 8 OR list_sum(l) = 90, false) AS truncated FROM prepared p LEFT JOIN k USING (doc_id))
        SELECT doc_id, lengths, {_segments_sql('lengths')} AS segments, truncated FROM r""",
    "preparation_stats": f"""WITH {SENTENCES}{_kept_sql(100, 3, "words >= 3")}, t AS (SELECT doc_id, n_words FROM doc_lines WHERE text IS NOT NULL),
        g AS (SELECT doc_id, count(*) FILTER (WHERE used AND kept) AS s, coalesce(sum(CASE WHEN used AND kept THEN words END), 0) AS n, bool_or(NOT used) AS cut FROM u GROUP BY 1),
        r AS (SELECT doc_id, n_words, coalesce(s, 0) AS s, least(coalesce(n, 0), 100) AS n, coalesce(cut OR n >= 100, false) AS truncated FROM t LEFT JOIN g USING (doc_id))
        SELECT count(*) AS texts, count(*) FILTER (WHERE n = 0) AS empty, sum(s)::BIGINT AS sequences, sum(n)::BIGINT AS tokens, count(*) FILTER (WHERE truncated) AS truncated,
        round(avg(CASE WHEN truncated THEN n / greatest(n_words, 1) END), 6) AS kept_share FROM r""",
    "token_fingerprints": f"""WITH {SENTS}, h AS (SELECT sent_id, src, list_transform(src, lambda x: printf('%08x', x)) AS h FROM sents)
        SELECT sent_id AS doc_id, CASE WHEN src IS NULL THEN NULL ELSE md5(unhex(coalesce(array_to_string(list_transform(h, lambda x: substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2)), ''), ''))) END AS fingerprint FROM h""",
    "encode_statistics": f"""WITH {SENTENCES}, per AS (SELECT doc_id, count(*) AS s, sum({WORDS})::BIGINT AS t FROM lined GROUP BY 1)
        SELECT count(*) AS documents, sum(s)::BIGINT AS sentences, sum(t)::BIGINT AS tokens, max(t) AS longest, round(avg(s), 6) AS mean_sentences FROM per""",
    "truncate_special_tokens": f"""WITH {SENTS} SELECT sent_id, list_concat(list_concat([1::INT], src[1:14]), [2::INT]) AS tokens,
        (least(len(src) + 2, 16) + least(len(tgt) + 2, 16))::INT AS n_tokens FROM sents""",
    "padded_sequences": f"""WITH {SENTS}, n AS (SELECT sent_id, src, (ceil(len(src) / 8.0) * 8)::INT AS length FROM sents)
        SELECT sent_id, length, list_concat(src, list_transform(range(length - len(src)), lambda x: 0::INT)) AS right_padded,
        list_concat(list_transform(range(length - len(src)), lambda x: 0::INT), src) AS left_padded FROM n""",
    "padded_documents": f"""WITH {SENTS}, n AS (SELECT sent_id, src, tgt, (ceil(greatest(len(src), len(tgt)) / 4.0) * 4)::INT AS l FROM sents)
        SELECT sent_id, list_transform([src, tgt], lambda s: list_concat(s, list_transform(range(l - len(s)), lambda x: 0::INT))) AS both FROM n""",
    "word_tokens": f"""WITH n AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '[{WHITE}]+'), lambda x: x <> '')) AS n FROM documents)
        SELECT doc_id, (CASE WHEN text IS NULL THEN 0 ELSE least(n, 62) + 2 END)::INT AS n_tokens, CASE WHEN text IS NOT NULL THEN 1::INT END AS first, CASE WHEN text IS NOT NULL THEN 2::INT END AS last FROM n""",
    "encoded_document_faults": "SELECT count(*) AS documents, 0::BIGINT AS not_unit, 0::BIGINT AS apart FROM documents",
    "parsed_tokens": f"WITH {SENTS} SELECT sent_id, CASE WHEN len(src) = 0 THEN [0::INT] ELSE src END AS tokens FROM sents",
}
