"""Queries that go through files: what is written comes back as it was."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import classify as C
from ..operators import corpus
from ..operators import search as S
from ..operators import text as X
from ..session import place
from ..sources import readers as R
from ..sources import sinks as K
from .tables import LENGTHS, PAIRS, SENTS, doc_vectors, pairs, sentences, table
from .vector_queries import KNN, _queries, _targets, _vectors


def _file(spark: SparkSession, df: DataFrame, name: str = "text", **options) -> str:
    """The path of one file with the rows of ``df`` (one task writes it: such files are no larger than a dataset's list)."""
    path = place(spark)
    df.coalesce(1).write.options(**options).format(name).save(path)
    return next(r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").collect()).replace("file:", "", 1)


def combined_file_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    lengths = corpus.pair_lengths(pairs(spark, d), X.document_info(table(spark, d, "documents")))
    K.write_combined(corpus.training_order(lengths), path)
    return R.read_combined(spark, path)


def _pair_file(spark: SparkSession, d: str) -> str:
    path = place(spark)
    pairs(spark, d).select("src", F.lit("x").alias("a"), "tgt", F.lit("x").alias("b"), "label").write.option("header", True).csv(path)
    return path


def pair_file_gold(spark: SparkSession, d: str) -> DataFrame:
    return R.read_gold(spark, _pair_file(spark, d)).select(F.col("q").cast("bigint").alias("q"), F.size("targets").alias("targets"))


def pair_file_sides(spark: SparkSession, d: str) -> DataFrame:
    return R.read_positives_negatives(spark, _pair_file(spark, d)).select(F.col("q").cast("bigint").alias("q"), F.size("positives").alias("positives"), F.size("negatives").alias("negatives"))


def named_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.located(R.named_ids(pairs(spark, d)), table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "dir_key", F.col("doc_id")).alias("path")))


def _one_line(spark: SparkSession, d: str) -> DataFrame:
    """Documents with each text on one line, in the order of their ids."""
    return table(spark, d, "documents").select("doc_id", F.translate(F.coalesce("text", F.lit("")), "\n\r\t", "   ").alias("text")).orderBy("doc_id")


def lines_file(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark, _one_line(spark, d).select(F.concat_ws("\t", "doc_id", "text").alias("value")))
    return R.read_lines(spark, path, has_id=True).select(F.col("id").cast("bigint").alias("doc_id"), F.md5("text").alias("hash"))


def lines_slice(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark, _one_line(spark, d).select("text"))
    return R.read_lines(spark, path, 10, 50).select(F.col("id").cast("bigint").alias("no"), F.md5("text").alias("hash"))


def lines_in_parts(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark, _one_line(spark, d).select("text"))
    return R.split_lines(spark, path, 7).groupBy("part").agg(F.count("*").alias("lines"), F.min("no").alias("first"), F.md5(F.min_by("text", "no")).alias("hash"))


def ids_in_parts(spark: SparkSession, d: str) -> DataFrame:
    return R.split_ids(table(spark, d, "documents").select(F.col("doc_id").alias("id")), 9)


def _folders(spark: SparkSession, d: str) -> str:
    """A folder per dir_key with one file of its documents' texts, by id."""
    path = place(spark)
    rows = table(spark, d, "documents").select("dir_key", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows.repartition("dir_key").sortWithinPartitions("dir_key", "doc_id").select("dir_key", "text").write.partitionBy("dir_key").text(path)
    return path


def _by_folder(files: DataFrame) -> DataFrame:
    key = F.regexp_extract("path", r"dir_key=([^/]*)/", 1)
    return files.select(key.alias("dir_key"), F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("hash"))


def folder_documents(spark: SparkSession, d: str) -> DataFrame:
    return _by_folder(R.read_documents(spark, _folders(spark, d) + "/*"))


def listed_documents(spark: SparkSession, d: str) -> DataFrame:
    path = _folders(spark, d)
    names = R.read_documents(spark, path + "/*").select(F.regexp_replace("path", "^file:/+", "/").alias("path")).orderBy("path")
    return _by_folder(R.read_listed(spark, _file(spark, names)))


def relevance_file(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    pairs(spark, d).select(F.col("src").alias("query-id"), F.col("tgt").alias("corpus-id"), F.col("label").alias("score")).write.option("header", True).csv(path)
    return R.read_qrels(spark, path).select(F.col("q").cast("bigint").alias("q"), F.col("t").cast("bigint").alias("t"))


def text_file_with_instruction(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.translate("text", "\r", " ").alias("text"))
    docs.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return R.read_id_text(spark, path, "query: ").select(F.col("id").cast("bigint").alias("id"), F.md5("text").alias("hash"))


def queries_with_instruction(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark, _one_line(spark, d).select(F.concat_ws("\t", "doc_id", "text").alias("value")))
    return R.read_queries(spark, path, "query: ").select(F.col("id").cast("bigint").alias("id"), F.md5("text").alias("hash"))


def sentence_gold_file(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    sentences(spark, d).select("sent_id", F.explode("dups").alias("t")).write.option("sep", "\t").csv(path)
    return R.read_sentence_gold(spark, path).select(F.col("q").cast("bigint").alias("q"), F.col("t").cast("bigint").alias("t"))


def sentence_pair_files(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    s = sentences(spark, d)
    ids = lambda c: F.array_join(F.coalesce(F.col(c), F.array()), " ")
    for name in ("src", "tgt", "dups"):
        s.select("sent_id", ids(name)).write.option("sep", "\t").option("quote", "").option("emptyValue", "").csv(f"{path}/train.{name}")
    hard = s.select("sent_id", F.explode("hn_ids").alias("h")).join(s.select(F.col("sent_id").alias("h"), ids("tgt").alias("t")), "h").select("sent_id", "h", "t")
    hard.write.option("sep", "\t").option("quote", "").option("emptyValue", "").csv(f"{path}/train.hn")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return R.read_sentence_pairs(spark, path, "train").select("id", F.size("src").alias("src"), F.size("tgt").alias("tgt"), F.size("dups").alias("dups"), F.greatest(size("negatives"), F.lit(0)).alias("negatives"))


def hard_negative_file(spark: SparkSession, d: str) -> DataFrame:
    s = sentences(spark, d)
    path = place(spark)
    hard = s.select("sent_id", F.explode("hn_ids").alias("h")).select("sent_id", "h", F.concat(F.lit("text "), "h").alias("t"))
    hard.write.option("sep", "\t").csv(path)
    return R.read_hard_negatives(spark, path, known=s.where("split = 'dev'").select(F.col("sent_id").alias("id")))


def mapping_file(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    pairs(spark, d).where("label = 1").select("src", "tgt").write.option("header", True).csv(path)
    return R.read_mapping(spark, path).select("q", F.size("targets").alias("targets"))


def label_file(spark: SparkSession, d: str) -> DataFrame:
    """Documents per label, by its index: labels of a file that a dictionary of the ``wiki`` ones knows."""
    path = _file(spark, table(spark, d, "documents").where("source IS NOT NULL").orderBy("doc_id").select("doc_id", "source"), "csv", quoteAll="true")
    rows = R.read_labels(spark, path)
    dictionary = C.label_dictionary(rows.where(F.col("label").startswith("wiki")))
    kept, left = R.known_labels(rows, dictionary)
    per = kept.groupBy("label", "index").agg(F.count("*").alias("docs"))
    return per.unionByName(left.select(F.lit("unknown").alias("label"), F.lit(-1).alias("index"), F.col("unknown").alias("docs")))


def vector_files(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    K.write_vectors(doc_vectors(spark, d), path, 1000)
    return spark.read.parquet(path).select("id", V.rounded(F.col("vec"), 5).alias("vec"))


def cached_vectors(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    v = doc_vectors(spark, d)
    K.append_cache(v.where("id % 2 = 0"), path, "one")
    K.append_cache(v.where("id % 2 = 1"), path, "one")
    K.append_cache(v, path, "two")
    K.tag_cache(spark, path)
    return R.read_cache(spark, path, "one").select("id", F.size("vec").alias("n"))


def prediction_file(spark: SparkSession, d: str) -> DataFrame:
    v, path = _vectors(spark, d), place(spark)
    K.write_predictions(S.exact_knn(_queries(v), _targets(v), 10), path)
    return spark.read.option("header", True).csv(path).select(F.col("rank").cast("int").alias("rank"), F.col("src").cast("bigint").alias("src"), F.col("tgt").cast("bigint").alias("tgt"), "sim")


def hits_file(spark: SparkSession, d: str) -> DataFrame:
    v, path = _vectors(spark, d), place(spark)
    q = _queries(v)
    K.write_hits(q.select("q"), S.exact_knn(q, _targets(v), 5), path)
    return spark.read.schema("q bigint, hits array<struct<t:bigint,sim:double>>").json(path).select("q", F.col("hits.t").alias("hits"))


def label_weights_file(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", (F.element_at("embedding", 1).cast("double")).alias("p"))
    K.write_labels(rows, path)
    return spark.read.schema("doc_id bigint, label int, weight string").option("sep", "\t").csv(path)


def report_file(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    rows = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_discount").alias("discount"))
    K.write_scores([("a", "one", rows), ("b", "two", rows.select("l_returnflag", "n"))], path)
    return spark.read.option("header", True).csv(path).select("model", "ds", "l_returnflag", F.col("n").cast("bigint").alias("n"), "discount")


def balanced_file(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    lengths = corpus.pair_lengths(pairs(spark, d), X.document_info(table(spark, d, "documents")))
    rated = lengths.groupBy("src", "tgt", "label").agg(F.round(F.avg(F.col("tlen") / F.col("slen")), 6).alias("rating"))
    K.write_balanced(corpus.extremes(rated, 5), path)
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col("src").cast("bigint").alias("src"), F.col("tgt").cast("bigint").alias("tgt"), F.col("label").cast("int").alias("label"), "rating")


QUERIES = [
    combined_file_round_trip, pair_file_gold, pair_file_sides, named_ids, lines_file, lines_slice, lines_in_parts, ids_in_parts, folder_documents, listed_documents, relevance_file,
    text_file_with_instruction, queries_with_instruction, sentence_gold_file, sentence_pair_files, hard_negative_file, mapping_file, label_file, vector_files, cached_vectors, prediction_file, hits_file,
    label_weights_file, report_file, balanced_file,
]

LINE = "one_line AS (SELECT doc_id, translate(coalesce(text, ''), chr(10) || chr(13) || chr(9), '   ') AS text FROM documents)"
FOLDERS = """SELECT dir_key, length(t)::BIGINT AS chars, md5(t) AS hash FROM (SELECT coalesce(dir_key, '__HIVE_DEFAULT_PARTITION__') AS dir_key,
    string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY 1)"""

SQL = {
    "combined_file_round_trip": f"WITH {LENGTHS} SELECT ds, src, tgt, label, slen, tlen, shash, thash FROM lengths",
    "pair_file_gold": f"WITH {PAIRS} SELECT src AS q, count(DISTINCT tgt)::INT AS targets FROM pairs WHERE label = 1 GROUP BY 1",
    "pair_file_sides": f"WITH {PAIRS} SELECT src AS q, count(DISTINCT CASE WHEN label = 1 THEN tgt END)::INT AS positives, count(DISTINCT CASE WHEN label <> 1 THEN tgt END)::INT AS negatives FROM pairs GROUP BY 1",
    "named_ids": f"WITH {PAIRS}, n AS (SELECT src AS id FROM pairs UNION SELECT tgt FROM pairs) SELECT id, CASE WHEN doc_id IS NULL THEN NULL ELSE concat_ws('/', dir_key, doc_id) END AS path FROM n LEFT JOIN documents ON doc_id = id",
    "lines_file": f"WITH {LINE} SELECT doc_id, md5(text) AS hash FROM one_line",
    "lines_slice": f"WITH {LINE}, n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS no, text FROM one_line) SELECT no, md5(text) AS hash FROM n WHERE no >= 10 AND no < 60",
    "lines_in_parts": f"""WITH {LINE}, n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS no, text, count(*) OVER () AS c FROM one_line)
        SELECT (no // ((c + 6) // 7))::INT AS part, count(*) AS lines, min(no) AS first, md5(arg_min(text, no)) AS hash FROM n GROUP BY 1""",
    "ids_in_parts": "SELECT id, ((no - 1) // ((c + 8) // 9))::INT AS part FROM (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS no, count(*) OVER () AS c FROM documents)",
    "folder_documents": FOLDERS,
    "listed_documents": FOLDERS,
    "relevance_file": f"WITH {PAIRS} SELECT src AS q, tgt AS t FROM pairs WHERE label = 1",
    "text_file_with_instruction": "SELECT doc_id AS id, md5('query: ' || translate(coalesce(text, ''), chr(13), ' ')) AS hash FROM documents",
    "queries_with_instruction": f"WITH {LINE} SELECT doc_id AS id, md5('query: ' || text) AS hash FROM one_line",
    "sentence_gold_file": f"WITH {SENTS} SELECT sent_id AS q, unnest(dups) AS t FROM sents",
    "sentence_pair_files": f"""WITH {SENTS}, h AS (SELECT sent_id, unnest(hn_ids) AS h FROM sents), k AS (SELECT h.sent_id, count(*) AS n FROM h JOIN sents s ON s.sent_id = h.h AND len(s.tgt) > 0 GROUP BY 1)
        SELECT sent_id AS id, len(src)::INT AS src, len(tgt)::INT AS tgt, coalesce(len(dups), 0)::INT AS dups, coalesce(n, 0)::INT AS negatives FROM sents LEFT JOIN k USING (sent_id)""",
    "hard_negative_file": f"WITH {SENTS}, h AS (SELECT DISTINCT unnest(hn_ids) AS id FROM sents) SELECT id, 'text ' || id AS text FROM h WHERE id NOT IN (SELECT sent_id FROM sents WHERE split = 'dev')",
    "mapping_file": f"WITH {PAIRS} SELECT src AS q, count(DISTINCT tgt)::INT AS targets FROM pairs WHERE label = 1 GROUP BY 1",
    "label_file": """WITH r AS (SELECT doc_id, source FROM documents WHERE source IS NOT NULL), f AS (SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS i FROM r WHERE source LIKE 'wiki%' GROUP BY 1)
        SELECT source AS label, i::INT AS index, count(*) AS docs FROM r JOIN f USING (source) GROUP BY 1, 2 UNION ALL SELECT 'unknown', -1, count(*) FROM r WHERE source NOT LIKE 'wiki%'""",
    "vector_files": """SELECT ids AS id, list_transform(max(embs::DOUBLE[]), lambda x: round(x, 5)) AS vec FROM doc_vectors WHERE len(embs) = 96 AND len(list_filter(embs, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embs, lambda x: x <> 0)) > 0 GROUP BY 1""",
    "cached_vectors": """SELECT DISTINCT ids AS id, 96::INT AS n FROM doc_vectors WHERE len(embs) = 96 AND len(list_filter(embs, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embs, lambda x: x <> 0)) > 0""",
    "prediction_file": f"WITH {KNN.replace('{k}', '10')} SELECT rank, q AS src, t AS tgt, printf('%.5f', sim) AS sim FROM knn",
    "hits_file": f"WITH {KNN.replace('{k}', '5')} SELECT q, list(t ORDER BY rank) AS hits FROM knn GROUP BY 1",
    "label_weights_file": "SELECT vec_id AS doc_id, label, printf('%.6f', embedding[1]::DOUBLE) AS weight FROM embeddings",
    "report_file": """WITH r AS (SELECT l_returnflag, count(*) AS n, printf('%.3f', avg(l_discount)) AS discount FROM lineitem GROUP BY 1)
        SELECT 'a' AS model, 'one' AS ds, l_returnflag, n, discount FROM r UNION ALL SELECT 'b', 'two', l_returnflag, n, NULL FROM r""",
    "balanced_file": f"""WITH {LENGTHS}, rated AS (SELECT src, tgt, label, round(avg(tlen / slen), 6) AS rating FROM lengths GROUP BY 1, 2, 3),
        n AS (SELECT *, max(label) OVER (PARTITION BY src) AS a, min(label) OVER (PARTITION BY src) AS b,
        row_number() OVER (PARTITION BY src, label ORDER BY CASE WHEN label = 1 THEN -rating ELSE rating END, tgt)::INT AS place FROM rated)
        SELECT src, tgt, label, printf('%.6f', rating) AS rating FROM n WHERE a = 1 AND b = 0 AND place <= 5""",
}
