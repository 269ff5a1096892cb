import gzip

import duckdb
from pyspark.sql import functions as F

from texloom.functions import vectors as V
from texloom.plans import catalogue
from texloom.sources import readers as R
from texloom.sources import sinks as K
from texloom.streaming import documents as D


def test_documents_prefer_compressed_files(spark, tmp_path):
    (tmp_path / "1.txt").write_text("plain")
    with gzip.open(tmp_path / "1.txt.gz", "wt") as f:
        f.write("packed\nlines")
    (tmp_path / "2.txt").write_text("two")
    (tmp_path / "3.md").write_text("no")
    assert {(r.id, r.text) for r in R.read_documents(spark, str(tmp_path)).collect()} == {("1", "packed\nlines"), ("2", "two")}


def test_lines_with_offset_limit_and_ids(spark, tmp_path):
    p = tmp_path / "s.tsv"
    p.write_text("a\tx y\nb\tz\tw\nc\n")
    assert [tuple(r) for r in R.read_lines(spark, str(p), 1, 1).collect()] == [("1", "b\tz\tw")]
    assert [tuple(r) for r in R.read_lines(spark, str(p), has_id=True).collect()] == [("a", "x y"), ("b", "z\tw"), ("c", None)]
    assert R.line_count(spark, str(p)) == 3 and R.line_count(spark, str(p), 2) == 2


def test_listed_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.txt").write_text("one")
    (tmp_path / "list").write_text("d/1.txt\nd/gone.txt\n")
    assert [(r.id, r.text) for r in R.read_listed(spark, str(tmp_path / "list")).orderBy("id").collect()] == [("0", "one"), ("1", None)]


def test_paths_by_position_prefer_compressed_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    with gzip.open(tmp_path / "a.txt.gz", "wt") as f:
        f.write("packed")
    (tmp_path / "b.txt").write_text("b")
    paths = [str(tmp_path / x) for x in ("b.txt", "a.txt", "none.txt", "b.txt")]
    assert [(r.id, r.text) for r in R.read_paths(spark, paths, 5).orderBy("id").collect()] == [(5, "b"), (6, "packed"), (7, None), (8, "b")]
    assert R.read_paths(spark, []).count() == 0


def test_lines_of_several_blocks_are_numbered_in_order(spark, tmp_path):
    p = tmp_path / "big.txt"
    p.write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = R.read_lines(spark, str(p))
        assert got.rdd.getNumPartitions() > 3
        assert all(r.text.startswith(f"line {r.id} ") for r in got.collect())
        parts = R.split_lines(spark, str(p), 7).groupBy("part").count().collect()
        assert sorted(r["count"] for r in parts) == [710, *[715] * 6]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    try:
        R.read_lines(spark, str(p), 6000, strict=True)
        raise AssertionError
    except ValueError:
        pass


def test_layouts_and_presence(spark, tmp_path):
    for bad in ("one", "two"):
        (tmp_path / bad).mkdir()
    (tmp_path / "one" / "texts").mkdir()
    (tmp_path / "two" / "texts_1").mkdir()
    assert R.text_folders(spark, str(tmp_path / "one"))[0].endswith("/texts")
    for f in (lambda: R.text_folders(spark, str(tmp_path / "two")), lambda: R.present(spark, [str(tmp_path / "x")])):
        try:
            f()
            raise AssertionError
        except FileNotFoundError:
            pass
    assert not R.present(spark, [str(tmp_path / "x")], optional=True) and R.present(spark, [str(tmp_path / "one")])


def test_hard_negatives_labels_and_slices(spark, tmp_path):
    (tmp_path / "hn").write_text("1\t10\tten\n1\t11\televen\n2\t10\tother\n3\t12\ttwelve\n2\t13\n")
    known = spark.createDataFrame([(11,)], "id bigint")
    assert {tuple(r) for r in R.read_hard_negatives(spark, str(tmp_path / "hn"), 2, known).collect()} == {(10, "ten")}
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "z"), (4, "c", "y")], "row_no int, doc_id string, label string")
    names = spark.createDataFrame([("x", 0), ("y", 1)], "label string, index int")
    kept, left = R.known_labels(rows, names)
    assert {(r.doc_id, r["index"], r.row_no) for r in kept.collect()} == {("a", 0, 1), ("c", 1, 4)} and tuple(left.first()) == (1, 1)
    (tmp_path / "c.csv").write_text("".join(f"d,{i},{i + 1},1,3,4,a,b\n" for i in range(9)))
    assert [r.src for r in R.read_combined(spark, str(tmp_path / "c.csv"), 2, 3).orderBy("src").collect()] == [2, 3, 4]
    (tmp_path / "m.csv").write_text("src,tgt\n1,5\n2,6\n1,4\n")
    assert {(r.q, tuple(r.targets)) for r in R.read_mapping(spark, str(tmp_path / "m.csv")).collect()} == {(1, (4, 5)), (2, (6,))}
    docs = spark.createDataFrame([(1, "/d/1.txt"), (1, "/d/1.txt.gz"), (2, "/d/2.txt")], "id int, path string")
    assert {(r.id, r.path) for r in R.located(spark.createDataFrame([(1,), (2,), (3,)], "id int"), docs).collect()} == {(1, "/d/1.txt.gz"), (2, "/d/2.txt"), (3, None)}


def test_weights_and_caches(spark, tmp_path):
    import numpy as np
    import pytest

    from texloom.operators import encode
    from texloom.session import release, stored

    K.save_weights({"a": np.eye(2)}, str(tmp_path / "w"))
    assert (K.load_weights(str(tmp_path / "w"))["a"] == np.eye(2)).all()
    assert R.read_cache(spark, str(tmp_path / "none"), "m") is None
    cache = spark.createDataFrame([(1, [1.0, 2.0])], "id bigint, vec array<double>")
    seqs = spark.createDataFrame([(1, [1]), (2, [2])], "id bigint, tokens array<int>")
    as_ = lambda kind, n: lambda df: df.select("id", F.array_repeat(F.lit(0), n).cast(f"array<{kind}>").alias("vec"))
    assert encode.encode_cached(seqs, cache, as_("double", 2))[0].count() == 2
    for kind, n in (("float", 2), ("double", 3)):
        with pytest.raises(ValueError):
            encode.encode_cached(seqs, cache, as_(kind, n))
    stored(cache)
    release(spark)


def test_pairs_gold_and_relevance(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("id1,t1,id2,t2,l\n3,a,1001,b,1\n15,a,1,b,1\n3,a,1501,b,0\n3,a,7,b,1\n")
    assert {(r.q, tuple(r.targets)) for r in R.read_gold(spark, str(p)).collect()} == {("3", ("1001", "7")), ("15", ("1",))}
    assert {(r.q, tuple(r.positives), tuple(r.negatives)) for r in R.read_positives_negatives(spark, str(p)).collect()} == {("3", ("1001", "7"), ("1501",)), ("15", ("1",), ())}
    q = tmp_path / "q.csv"
    q.write_text("query-id,corpus-id,score\n1,2,1\n1,3,0\n1,4,2\n")
    assert [tuple(r) for r in R.read_qrels(spark, str(q)).collect()] == [("1", "2")]
    try:
        R.read_qrels(spark, str(p))
        raise AssertionError
    except ValueError:
        pass


def test_sentence_pair_files(spark, tmp_path):
    (tmp_path / "train.src").write_text("1\t1 2 3\n2\t5 6\n")
    (tmp_path / "train.tgt").write_text("1\t1 2\n2\t5\n")
    (tmp_path / "train.dups").write_text("1\t6 9\n2\t\n")
    (tmp_path / "train.hn").write_text("1\t10\t1 2\n1\t11\t2 3\n2\t30\n")
    rows = {r.id: r for r in R.read_sentence_pairs(spark, str(tmp_path), "train").collect()}
    assert rows[1].src == [1, 2, 3] and rows[1].dups == [6, 9] and [(n.id, n.tokens) for n in rows[1].negatives] == [(10, [1, 2]), (11, [2, 3])]
    assert rows[2].dups == [] and rows[2].negatives is None


def test_labels_keep_their_order(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("a,x\nb,y\na,z\n")
    assert [tuple(r) for r in R.read_labels(spark, str(p)).orderBy("row_no").select("row_no", "doc_id", "label").collect()] == [(1, "a", "x"), (2, "b", "y"), (3, "a", "z")]


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([(i, [0.1, 2048.7, 0.0]) for i in range(5)], "id bigint, vec array<double>")
    K.write_vectors(v.coalesce(1), str(tmp_path / "v"), 2, half=True)
    assert len(list((tmp_path / "v").glob("*.parquet"))) == 3
    assert spark.read.parquet(str(tmp_path / "v")).first().vec == [0.0999755859375, 2048.0, 0.0]
    K.write_report(spark.createDataFrame([(1, 0.123456)], "a int, b double"), str(tmp_path / "r"))
    assert next((tmp_path / "r").glob("*.csv")).read_text().split() == ["a,b", "1,0.12346"]
    K.write_labels(spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.7)], "doc_id int, label string, p double"), str(tmp_path / "l"))
    assert "".join(p.read_text() for p in (tmp_path / "l").glob("*.csv")).split("\n")[0] == "1\tb\t0.700000"


def test_stream_appends_what_is_missing(spark, sf, tmp_path):
    cache = str(tmp_path / "cache")
    for turn in range(2):
        stream = D.document_info(D.read_stream(spark, sf))
        q = stream.withColumn("id", F.col("doc_id"))
        D.append_missing(q, cache, lambda b: b.select("id", F.array(F.col("n_words").cast("double")).alias("vec")), str(tmp_path / f"c{turn}")).awaitTermination()
    got = spark.read.parquet(cache)
    assert got.count() == got.select("id").distinct().count() > 0


def test_stream_statistics(spark, sf, tmp_path):
    q = D.windowed_statistics(D.read_stream(spark, sf)).writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(docs) FROM stats").first()[0] > 0


def test_vectors_from_files_keep_the_sign_of_zero(spark, sf):
    """Compared by what is written, as -0.0 equals 0.0; the smallest tables have one such number."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW doc_vectors AS SELECT * FROM '{sf}/doc_vectors.parquet'")
    want = {i: repr(v) for i, v in con.execute(catalogue.oracle_sql()["vector_files"]).fetchall()}
    assert any("-0.0," in v for v in want.values())
    assert {r.id: repr(r.vec) for r in catalogue.queries()["vector_files"](spark, sf).collect()} == want


def test_rounded_vectors(spark):
    rows = spark.createDataFrame([([-1e-6, 1e-6, -0.0, 0.0, -0.015625, 0.015625, float("nan"), None, float("-inf")],)], "v array<double>")
    got = rows.select(V.rounded(F.col("v"), 5).alias("r")).first().r
    assert repr(got) == "[-0.0, 0.0, -0.0, 0.0, -0.01563, 0.01563, nan, None, -inf]"
