"""Sinks: vectors, predictions, pairs and reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_vectors(df: DataFrame, path: str, rows_per_file: int = 1000, half: bool = False) -> None:
    """Shards of at most ``rows_per_file`` rows; with ``half``, numbers are rounded to what half precision keeps (11 bits)."""
    out = df
    if half:
        # the place of the last bit kept: 2 ** (exponent - 10)
        step = lambda x: F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - 10)
        out = df.withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, x.cast("double")).otherwise(F.rint(x / step(x)) * step(x))))
    out.withColumn("vec", F.col("vec").cast("array<float>")).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_labels(decided: DataFrame, path: str) -> None:
    """path, label, weight separated by tabs, the heaviest label of each document first."""
    rows = decided.select(F.col("doc_id"), F.col("label"), F.format_string("%.6f", "p").alias("weight"), "p")
    rows.repartition("doc_id").sortWithinPartitions("doc_id", F.col("p").desc(), "label").drop("p").write.mode("overwrite").option("sep", "\t").csv(path)


def write_predictions(knn: DataFrame, path: str, least: float | None = None) -> None:
    """rank, src, tgt, sim with a header, by source and rank; with ``least``, pairs of that similarity or more."""
    rows = knn if least is None else knn.where(F.col("sim") >= least)
    rows.select("rank", F.col("q").alias("src"), F.col("t").alias("tgt"), F.format_string("%.5f", "sim").alias("sim")).orderBy("src", "rank").write.mode("overwrite").option("header", True).csv(path)


def write_combined(pairs: DataFrame, path: str) -> None:
    """The eight columns of a combined pair file, in the order of row_no, without a header."""
    pairs.orderBy("row_no").select("ds", "src", "tgt", "label", "slen", "tlen", "shash", "thash").write.mode("overwrite").csv(path)


def write_report(df: DataFrame, path: str, digits: int = 5) -> None:
    """A table with a header; floating-point numbers with ``digits`` digits."""
    cols = [F.format_string(f"%.{digits}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_index(centers: DataFrame, postings: DataFrame, path: str, books: DataFrame | None = None) -> None:
    """The tables of an inverted index below ``path``; postings are partitioned for a search by center."""
    centers.write.mode("overwrite").parquet(f"{path}/centers")
    postings.repartition("center").sortWithinPartitions("center", "id").write.mode("overwrite").parquet(f"{path}/postings")
    if books is not None:
        books.write.mode("overwrite").parquet(f"{path}/books")


def append_postings(postings: DataFrame, path: str) -> None:
    """Further postings into the index below ``path``."""
    postings.repartition("center").sortWithinPartitions("center", "id").write.mode("append").parquet(f"{path}/postings")


def append_cache(df: DataFrame, path: str, model: str) -> None:
    """New vectors into the cache, partitioned by model."""
    df.withColumn("model", F.lit(model)).write.mode("append").partitionBy("model").parquet(path)


def write_balanced(rated: DataFrame, path: str) -> None:
    """Pairs of sources with their ratings (src, tgt, label, rating) as six columns with a header, by source, positives first, the best of each first."""
    rows = rated.orderBy("src", F.col("label").desc(), F.when(F.col("label") == 1, -F.col("rating")).otherwise(F.col("rating")), "tgt")
    none = F.lit("").alias
    rows.select("src", none("t1"), "tgt", none("t2"), "label", F.format_string("%.6f", "rating").alias("rating")).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_scores(reports: list[tuple[str, str, DataFrame]], path: str, digits: int = 3) -> None:
    """Metric tables of models and datasets, one below the other, with the columns model and ds before theirs; columns a table lacks are empty."""
    out = None
    for model, ds, df in reports:
        one = df.select(F.lit(model).alias("model"), F.lit(ds).alias("ds"), *[F.format_string(f"%.{digits}f", c).alias(c) if t in ("double", "float") else F.col(c).cast("string").alias(c) for c, t in df.dtypes])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no report")
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_hits(queries: DataFrame, found: DataFrame, path: str, k: int = 5) -> None:
    """A JSON line per query (the columns of ``queries``: q and others) with its ``k`` best hits (t, sim) of ``found``: q, t, sim, rank."""
    hits = found.where(F.col("rank") <= k).groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t", "sim"))), lambda x: F.struct(x["t"].alias("t"), x["sim"].alias("sim"))).alias("hits"))
    write_json_lines(queries.join(hits, "q", "left"), path)


def save_weights(weights: dict, path: str) -> None:
    """Arrays by name in one file of the driver: a model's weights, which are never larger than its memory."""
    import numpy as np

    np.savez(path, **weights)


def load_weights(path: str) -> dict:
    import numpy as np

    with np.load(path if path.endswith(".npz") else f"{path}.npz") as f:
        return dict(f)


def tag_cache(df_or_spark, path: str) -> None:
    """Mark a folder as a cache that may be deleted."""
    spark = df_or_spark if not isinstance(df_or_spark, DataFrame) else df_or_spark.sparkSession
    tag = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_CACHEDIR.TAG")
    out = tag.getFileSystem(spark._jsc.hadoopConfiguration()).create(tag, True)
    out.write(bytearray(b"Signature: 8a477f597d28d172789f06886806bc55\n"))
    out.close()
