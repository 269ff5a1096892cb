"""Sources: texts, pair files, gold files and indices as DataFrames with explicit schemas.

Compressed files are read by their suffix; where a plain file and its ``.gz`` both exist, the
compressed one is taken. Lines are numbered from 0 within each file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import id_from_path
from ..operators.order import ranked


def _path() -> Column:
    return F.col("_metadata.file_path")


#: Files that are read by one scan, about, where they are named one by one.
GROUP_FILES = 10_000


def _plain(c: Column) -> Column:
    """A local path as it is written by hand."""
    return F.regexp_replace(c, "^file:/+", "/")


def _twins(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    """path of each file beside which there is the same name with ``.gz``. Names are listed, no content is read."""
    names = spark.read.format("binaryFile").load(list(paths)).select("path")
    packed = names.where(F.col("path").endswith(".gz")).select(F.regexp_replace("path", r"\.gz$", "").alias("path"))
    return names.join(packed, "path", "left_semi")


def read_documents(spark: SparkSession, *paths: str, suffixes: tuple[str, ...] = (".txt", ".gz")) -> DataFrame:
    """id (the file's name without folders and suffixes), path, text: a row per file with one of the ``suffixes``, whole.

    Other files aren't opened, nor are those beside which there is a compressed one of the same name.
    """
    pattern = "{" + ",".join(f"*{x}" for x in suffixes) + "}"
    files = spark.read.option("pathGlobFilter", pattern).text(list(paths), wholetext=True).select(_path().alias("path"), F.col("value").alias("text"))
    # few or none, as a rule: AQE sees how many
    twins = _twins(spark, paths).select(_plain(F.col("path")).alias("_p"))
    kept = files.join(twins, _plain(F.col("path")) == F.col("_p"), "left_anti")
    return kept.select(id_from_path(F.col("path")).alias("id"), "path", "text")


def read_paths(spark: SparkSession, paths: list[str], first_id: int = 0) -> DataFrame:
    """id (the place of the path, from ``first_id``), path (as given), text of files named one by one, a compressed one where there is one; the text of a missing one is null."""
    rows = []
    for k, p in enumerate(paths):
        there = p + ".gz" if not p.endswith(".gz") and _exists(spark, p + ".gz") else p if _exists(spark, p) else None
        rows.append((first_id + k, p, there))
    wanted = spark.createDataFrame(rows, "id long, path string, _at string") if rows else spark.createDataFrame([], "id long, path string, _at string")
    files, at = None, sorted({r[2] for r in rows if r[2]})
    for k in range(0, len(at), GROUP_FILES):
        one = spark.read.text(at[k : k + GROUP_FILES], wholetext=True).select(_plain(_path()).alias("_at"), F.col("value").alias("text"))
        files = one if files is None else files.unionByName(one)
    if files is None:
        return wanted.select("id", "path", F.lit(None).cast("string").alias("text"))
    return wanted.withColumn("_at", _plain(F.col("_at"))).join(files, "_at", "left").select("id", "path", "text")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """value and no (from 0): the lines of one file, numbered where they lie: by the lines of the file's blocks before, and the place in the block."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    before, first = 0, []
    for r in sorted(lines.groupBy("_b").agg(F.min("_m").alias("m"), F.count("*").alias("n")).collect(), key=lambda r: r["_b"]):  # a row per block
        first.append((r["_b"], before - r["m"]))
        before += r["n"]
    offsets = spark.createDataFrame(first, "_b long, _o long") if first else spark.createDataFrame([], "_b long, _o long")
    return lines.join(F.broadcast(offsets), "_b").select("value", (F.col("_m") + F.col("_o")).alias("no"))


def read_lines(spark: SparkSession, path: str, offset: int = 0, limit: int = -1, has_id: bool = False, sep: str = "\t", strict: bool = False) -> DataFrame:
    """id, text of the lines ``offset`` .. ``offset`` + ``limit`` (-1: to the end) of one file.

    The id is what stands before the first ``sep``, or the line's number in the file. A file of several blocks is read by
    as many tasks. With ``strict``, an offset beyond the end is an error.
    """
    lines = _numbered(spark, path)
    if strict and offset > 0 and lines.count() < offset:
        raise ValueError(f"{path} ends before line {offset}")
    kept = lines.where(F.col("no") >= offset)
    if limit >= 0:
        kept = kept.where(F.col("no") < offset + limit)
    if has_id:
        part = F.split("value", sep, 2)
        return kept.select(part[0].alias("id"), F.try_element_at(part, F.lit(2)).alias("text"))
    return kept.select(F.col("no").cast("string").alias("id"), F.col("value").alias("text"))


def read_queries(spark: SparkSession, path: str, instruction: str = "", sep: str = "\t") -> DataFrame:
    """id, text of a file of queries, each text after ``instruction``."""
    return read_lines(spark, path, has_id=True, sep=sep).select("id", F.concat(F.lit(instruction), F.coalesce("text", F.lit(""))).alias("text"))


def split_lines(spark: SparkSession, path: str, parts: int) -> DataFrame:
    """part (from 0), no, text: the lines of a file in ``parts`` runs of equal length, the last ones shorter or empty."""
    lines = _numbered(spark, path)
    size = max(1, -(-lines.count() // parts))
    return lines.select(F.floor(F.col("no") / size).cast("int").alias("part"), "no", F.col("value").alias("text"))


def split_ids(ids: DataFrame, parts: int, key: str = "id") -> DataFrame:
    """Adds part (from 0): ids, in their order, in ``parts`` runs of equal length."""
    size = max(1, -(-ids.count() // parts))
    return ranked(ids, F.col(key), name="_no").withColumn("part", F.floor((F.col("_no") - 1) / size).cast("int")).drop("_no")


def read_listed(spark: SparkSession, listing: str, offset: int = 0, limit: int = -1) -> DataFrame:
    """id (line number), path, text of the files a file lists; missing ones have a null text. Relative paths are taken from the listing's folder.

    Only the named files are opened, GROUP_FILES by one scan.
    """
    folder = listing.rsplit("/", 1)[0] if "/" in listing else "."
    names = read_lines(spark, listing, offset, limit).where(F.trim("text") != "")
    full = F.when(F.col("text").startswith("/"), F.col("text")).otherwise(F.concat(F.lit(folder + "/"), F.col("text")))
    wanted = names.select("id", F.regexp_replace(full, r"\s+$", "").alias("path"))
    out, group = None, []

    def read(paths: list[str]) -> DataFrame:
        return read_paths(spark, paths).select("path", "text")

    for r in wanted.select("path").distinct().toLocalIterator():
        group.append(r["path"])
        if len(group) == GROUP_FILES:
            out = read(group) if out is None else out.unionByName(read(group))
            group = []
    if group or out is None:
        out = read(group) if out is None else out.unionByName(read(group))
    return wanted.join(out, "path", "left").select("id", "path", "text")


def text_folders(spark: SparkSession, root: str) -> tuple[str, str]:
    """The folders sources and targets lie in: ``texts`` for both, or ``texts_1`` and ``texts_2``."""
    if _exists(spark, f"{root}/texts"):
        return f"{root}/texts", f"{root}/texts"
    if _exists(spark, f"{root}/texts_1") and _exists(spark, f"{root}/texts_2"):
        return f"{root}/texts_1", f"{root}/texts_2"
    raise FileNotFoundError(f"no texts below {root}")


def present(spark: SparkSession, paths: list[str], optional: bool = False) -> bool:
    """Whether all files of a dataset are there; an error if not, unless it is optional."""
    missing = [p for p in paths if not _exists(spark, p)]
    if missing and not optional:
        raise FileNotFoundError(f"missing: {', '.join(missing)}")
    return not missing


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


PAIR_FILE = T.StructType([T.StructField(n, T.StringType()) for n in ("src", "_a", "tgt", "_b", "label")])
COMBINED = T.StructType([
    T.StructField("ds", T.StringType()), T.StructField("src", T.LongType()), T.StructField("tgt", T.LongType()), T.StructField("label", T.IntegerType()),
    T.StructField("slen", T.IntegerType()), T.StructField("tlen", T.IntegerType()), T.StructField("shash", T.StringType()), T.StructField("thash", T.StringType()),
])


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """src, tgt, label of a pair file with a header: columns 1, 3 and 5; further columns are ignored."""
    rows = spark.read.option("header", True).option("enforceSchema", True).schema(PAIR_FILE).csv(path)
    return rows.select("src", "tgt", F.col("label").cast("int").alias("label"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """q and its targets (an array) from the positives of a pair file; grouped wherever the rows stand."""
    return read_pairs(spark, path).where("label = 1").groupBy(F.col("src").alias("q")).agg(F.array_sort(F.collect_set("tgt")).alias("targets"))


def read_positives_negatives(spark: SparkSession, path: str) -> DataFrame:
    """q, positives, negatives of a pair file."""
    p = F.array_sort(F.collect_set(F.when(F.col("label") == 1, F.col("tgt"))))
    n = F.array_sort(F.collect_set(F.when(F.col("label") != 1, F.col("tgt"))))
    return read_pairs(spark, path).groupBy(F.col("src").alias("q")).agg(p.alias("positives"), n.alias("negatives"))


def read_combined(spark: SparkSession, path: str, offset: int = 0, limit: int = -1) -> DataFrame:
    """The eight columns of a combined pair file without a header; of one file, the lines ``offset`` .. ``offset`` + ``limit`` if said."""
    if not offset and limit < 0:
        return spark.read.schema(COMBINED).csv(path)
    lines = read_lines(spark, path, offset, limit)
    return lines.select(F.from_csv("text", COMBINED.simpleString()[7:-1].replace(":", " ")).alias("r")).select("r.*")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """q and its targets (an array) from a file of src,tgt with a header; grouped wherever the rows stand."""
    rows = spark.read.option("header", True).schema("src bigint, tgt bigint").csv(path)
    return rows.groupBy(F.col("src").alias("q")).agg(F.array_sort(F.collect_set("tgt")).alias("targets"))


def read_hard_negatives(spark: SparkSession, path: str, last: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """id, text of the hard negatives of a file (source, id, text separated by tabs) up to the source ``last``, each once and none of the ``known`` (id); of several texts of an id the one with the least source."""
    rows = spark.read.schema("src bigint, id bigint, text string").option("sep", "\t").option("quote", "").csv(path).where("id IS NOT NULL AND text IS NOT NULL")
    rows = rows if last is None else rows.where(F.col("src") <= last)
    rows = rows if known is None else rows.join(known.select("id"), "id", "left_anti")
    return rows.groupBy("id").agg(F.min_by("text", F.struct("src", "text")).alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """q, t of the rows with score 1. Another header than query-id, corpus-id, score is an error."""
    head = spark.read.option("header", True).csv(path)
    if [c.strip() for c in head.columns] != ["query-id", "corpus-id", "score"]:
        raise ValueError(f"not a relevance file: {head.columns}")
    return head.where(F.col("score").cast("double") == 1).select(F.col("query-id").alias("q"), F.col("corpus-id").alias("t"))


def read_id_text(spark: SparkSession, path: str, instruction: str = "") -> DataFrame:
    """id, text of a CSV file by the names in its header, each text after ``instruction``."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select("id", F.concat(F.lit(instruction), F.coalesce("text", F.lit(""))).alias("text"))


def read_sentence_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("q string, t string").option("sep", "\t").option("quote", "").csv(path)


def read_sentence_pairs(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """id, src, tgt (token ids), dups (ids) and negatives (id, tokens) from the files split.src, .tgt, .dups and .hn.

    Ids missing from one of the first two files are left out; a negative without tokens counts as none.
    """

    def tsv(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(f"{folder}/{split}.{name}*")

    ints = lambda c, kind: F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda x: x != ""), lambda x: x.cast(kind))
    src = tsv("src", "id bigint, s string").select("id", ints(F.col("s"), "int").alias("src"))
    tgt = tsv("tgt", "id bigint, s string").select("id", ints(F.col("s"), "int").alias("tgt"))
    dups = tsv("dups", "id bigint, s string").select("id", ints(F.col("s"), "bigint").alias("dups"))
    hard = tsv("hn", "id bigint, hn bigint, s string").where("hn IS NOT NULL AND s IS NOT NULL").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("hn").alias("id"), ints(F.col("s"), "int").alias("tokens")))).alias("negatives")
    )
    return src.join(tgt, "id").join(dups, "id", "left").join(hard, "id", "left")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """row_no (from 1), doc_id, label of a file of names and labels without a header."""
    rows = spark.read.schema("doc_id string, label string").csv(path).withColumn("_n", F.monotonically_increasing_id())
    return ranked(rows, F.col("_n")).drop("_n")


def known_labels(rows: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row_no, doc_id, label) with a label of the dictionary (label, index), each document's labels once, with the index; and one row of what was left out: unknown, repeated."""
    seen = rows.join(dictionary.select("label", "index"), "label", "left")
    kept = seen.where("index IS NOT NULL").groupBy("doc_id", "label", "index").agg(F.min("row_no").alias("row_no"), F.count("*").alias("_n"))
    unknown = seen.agg(F.count_if(F.col("index").isNull()).alias("unknown")).withColumn("_k", F.lit(0))
    repeated = kept.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated")).withColumn("_k", F.lit(0))
    # one row each, joined on a constant
    return kept.select("row_no", "doc_id", "label", "index"), unknown.join(F.broadcast(repeated), "_k").drop("_k")


def named_ids(pairs: DataFrame) -> DataFrame:
    """id: all sources and targets of pairs, each once."""
    return pairs.select(F.explode(F.array("src", "tgt")).alias("id")).distinct()


def located(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """id, path of each id, the compressed file where there are two; a null path where there is no such document."""
    one = documents.groupBy("id").agg(F.min_by("path", F.struct(~F.col("path").endswith(".gz"), "path")).alias("path"))
    return ids.join(one, "id", "left")


def line_count(spark: SparkSession, path: str, limit: int = -1) -> int:
    lines = spark.read.text(path)
    return (lines.limit(limit) if limit >= 0 else lines).count()


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The centers, codebooks (None where there are none) and postings of an index that was written."""
    books = spark.read.parquet(f"{path}/books") if _exists(spark, f"{path}/books") else None
    return spark.read.parquet(f"{path}/centers"), books, spark.read.parquet(f"{path}/postings")


def read_cache(spark: SparkSession, path: str, model: str) -> DataFrame | None:
    """The cached vectors of one model; None where nothing is cached."""
    return spark.read.parquet(path).where(F.col("model") == model).drop("model") if _exists(spark, path) else None
