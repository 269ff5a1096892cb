"""The driver's tables as inputs of the registered queries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE
from ..operators.order import latest_rows

#: Searches take as queries every row whose id is divisible by this, against all rows.
QUERY_STEP = 50


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(d, f"{name}.parquet"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return latest_rows(table(spark, d, "combined_pairs"), "ex_id", "loaded_at", "split")


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return latest_rows(table(spark, d, "sent_pairs"), "sent_id", "loaded_at", "split")


def doc_vectors(spark: SparkSession, d: str) -> DataFrame:
    """id, vec of usable vectors, each id once."""
    v = table(spark, d, "doc_vectors").select(F.col("ids").alias("id"), F.col("embs").cast("array<double>").alias("vec")).where("size(vec) = 96")
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    return v.where(good).groupBy("id").agg(F.max("vec").alias("vec"))


# The same in SQL
PAIRS = "pairs AS (SELECT * FROM combined_pairs QUALIFY row_number() OVER (PARTITION BY ex_id ORDER BY loaded_at DESC NULLS LAST, split NULLS FIRST) = 1)"
SENTS = "sents AS (SELECT * FROM sent_pairs QUALIFY row_number() OVER (PARTITION BY sent_id ORDER BY loaded_at DESC NULLS LAST, split NULLS FIRST) = 1)"
LINES = (
    f"doc_lines AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')), lambda x: x <> '') AS l,"
    f" len(list_filter(regexp_split_to_array(text, '[{WHITE}]+'), lambda x: x <> ''))::INT AS n_words,"
    f" md5(array_to_string(list_filter(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+'), lambda x: NOT regexp_full_match(x, '[{WHITE}]*')), '')) AS fingerprint FROM documents)"
)
INFO = LINES + ", info AS (SELECT doc_id, len(l)::INT AS n_lines, n_words, fingerprint FROM doc_lines WHERE len(l) > 0)"
SENTENCES = LINES + ", lined AS (SELECT doc_id, unnest(l) AS sentence, (generate_subscripts(l, 1) - 1)::INT AS sent_no FROM doc_lines)"
WORDS = f"len(list_filter(regexp_split_to_array(sentence, '[{WHITE}]+'), lambda x: x <> ''))::INT"
LENGTHS = (
    INFO + ", " + PAIRS + ", lengths AS (SELECT p.ex_id, p.ds, p.src, p.tgt, p.label, a.n_words AS slen, a.fingerprint AS shash, b.n_words AS tlen, b.fingerprint AS thash"
    " FROM pairs p JOIN info a ON a.doc_id = p.src JOIN info b ON b.doc_id = p.tgt)"
)
