"""Queries on streams: the table read file by file, run to its end, gives what the batch operators give."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import place
from ..streaming import documents as D
from .tables import INFO


def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = os.path.join(d, "documents.parquet")
    return D.read_stream(spark, path, "*") if os.path.isdir(path) else D.read_stream(spark, d, "documents.parquet")


def stream_document_info(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    D.document_info(_stream(spark, d)).writeStream.format("parquet").option("checkpointLocation", place(spark)).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.parquet(path)


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Documents and words per day and language, as of the last batch."""
    path = place(spark)

    def keep(batch: DataFrame, _: int) -> None:
        batch.select(F.col("window.start").alias("day"), "lang", "docs", "words").write.mode("overwrite").parquet(path)

    D.windowed_statistics(_stream(spark, d)).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", place(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select(F.col("day").cast("string").alias("day"), "lang", "docs", "words")


def stream_cache(spark: SparkSession, d: str) -> DataFrame:
    """Ids in a cache that a stream of documents has filled twice: each stands there once."""
    path = place(spark)
    for _ in range(2):
        stream = D.document_info(_stream(spark, d)).withColumnRenamed("doc_id", "id")
        D.append_missing(stream, path, lambda b: b.select("id", F.array(F.col("n_words").cast("double")).alias("vec")), place(spark)).awaitTermination()
    return spark.read.parquet(path).groupBy("id").agg(F.count("*").alias("n"))


QUERIES = [stream_document_info, stream_windows, stream_cache]

SQL = {
    "stream_document_info": f"WITH {INFO} SELECT * FROM info",
    "stream_windows": f"""WITH {INFO} SELECT strftime(date_trunc('day', loaded_at), '%Y-%m-%d %H:%M:%S') AS day, lang, count(*) AS docs, sum(coalesce(l.n_words, 0))::BIGINT AS words
        FROM documents d JOIN doc_lines l USING (doc_id) WHERE loaded_at IS NOT NULL GROUP BY 1, 2""",
    "stream_cache": f"WITH {INFO} SELECT doc_id AS id, count(*) AS n FROM info GROUP BY 1",
}
