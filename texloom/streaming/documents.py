"""Structured Streaming forms of the document operators (an extension: batch operators are the rule)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, dir_key string, loaded_at timestamp"


def read_stream(spark: SparkSession, folder: str, pattern: str = "documents*.parquet", schema: str = SCHEMA) -> DataFrame:
    """Documents of the files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def document_info(stream: DataFrame) -> DataFrame:
    """The lines, words and fingerprint of each document, as in the batch operator; stateless."""
    return stream.select(
        "doc_id", F.size(X.lines(F.col("text"))).alias("n_lines"), F.size(X.words(F.col("text"))).alias("n_words"), X.fingerprint(F.col("text")).alias("fingerprint")
    ).where("n_lines > 0")


def windowed_statistics(stream: DataFrame, late: str = "7 days", window: str = "1 day") -> DataFrame:
    """Documents and words per window of ``loaded_at`` and language; what is later than ``late`` is dropped."""
    words = stream.withColumn("words", F.coalesce(F.size(X.words(F.col("text"))), F.lit(0)))
    return words.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", window), "lang").agg(F.count("*").alias("docs"), F.sum("words").alias("words"))


def first_copies(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """The first document of each fingerprint among those no more than ``late`` apart."""
    return stream.withColumn("fingerprint", X.fingerprint(F.col("text"))).withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["fingerprint"])


def append_missing(stream: DataFrame, cache: str, encode: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "id") -> StreamingQuery:
    """Encodes what isn't in the cache yet, batch by batch, and appends it; a batch that is run again adds nothing."""

    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(cache).select(key)
            batch = batch.join(known, key, "left_anti")
        except Exception as e:  # nothing cached so far
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        encode(batch.dropDuplicates([key])).write.mode("append").parquet(cache)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
