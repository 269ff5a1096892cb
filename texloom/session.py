"""Session defaults and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, app: str = "texloom", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session is the cluster's own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    base = {
        "spark.master": f"local[{n}]",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Tables written by ``stored`` and ``place``, by application.
_WRITTEN: dict[str, list[str]] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. A private one is made only for a local session that names none; elsewhere that is an error, as executors wouldn't share it."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir()
    if there:
        return there
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        named = tempfile.mkdtemp(prefix="texloom-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage. Runs at once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def place(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark)}/texloom-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back: like ``cut``, but compressed and by column. Runs at once."""
    path = place(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what ``stored`` and ``place`` have written so far; results that still read it must have been written."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
