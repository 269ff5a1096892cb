import numpy as np
import pytest
from pyspark.sql import functions as F

from texloom.operators import batching, classify, corpus, encode, metrics, order, search, text


def test_ranked_is_a_total_order(spark):
    df = order.ranked(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")), F.col("x").desc())
    rows = df.orderBy("row_no").collect()
    assert [r.row_no for r in rows] == list(range(1, 1001)) and [r.x for r in rows] == sorted((r.x for r in rows), reverse=True)
    assert order.ranked(spark.range(0), F.col("id")).count() == 0


def test_sample_is_exact(spark):
    a = {r.id for r in order.sample_exact(spark.range(101), 0.4, 3, F.col("id")).collect()}
    assert len(a) == 40 and a == {r.id for r in order.sample_exact(spark.range(101).repartition(7), 0.4, 3, F.col("id")).collect()}


def test_proportional_truncation(spark):
    rows = spark.createDataFrame([(1, 1, 120), (1, 2, 40), (1, 3, 10), (2, 4, 5)], "src int, tgt int, tlen int")
    got = {r.tgt: r.new_len for r in corpus.truncated_targets(rows, 90, 0.49).collect()}
    assert got == {1: 63, 2: 21, 3: 5, 4: 5}
    assert {r.tgt for r in corpus.truncated_targets(rows, 80, 0.49).collect()} == {4}
    both = corpus.truncated_targets(rows.withColumn("tsents", F.col("tlen")), 1000, 0.49, 90).orderBy("tgt").collect()
    assert [(r.new_len, r.new_sents) for r in both] == [(120, 63), (40, 21), (10, 5), (5, 5)]


def test_training_order_puts_positives_first(spark):
    rows = [(1, "ds1", 3, 600, 0, 3, "h3"), (2, "ds1", 3, 1001, 1, 3, "h3"), (3, "ds1", 15, 500, 1, 15, "h15"), (4, "ds1", 16, 1, 1, 15, "h1")]
    df = spark.createDataFrame(rows, "ex_id int, ds string, src int, tgt int, label int, slen int, shash string")
    assert [r.ex_id for r in corpus.training_order(df).orderBy("row_no").collect()] == [4, 3, 2, 1]


def test_interleaving_and_balance(spark):
    rows = [(i, 1, 100 + i, int(i < 3)) for i in range(8)] + [(9, 2, 5, 1)]
    df = spark.createDataFrame(rows, "ex_id int, src int, tgt int, label int")
    got = [r.label for r in corpus.interleaved(df).where("src = 1").orderBy("place").collect()]
    assert got == [1, 0, 1, 0, 1, 0, 0, 0]
    b = corpus.balanced(df)
    assert b.where("src = 1 AND label = 0").count() == 3 and b.where("src = 2").count() == 0


def test_equal_targets_stand_once_in_a_batch(spark):
    df = spark.createDataFrame([(0, 1, 10, 1, "a"), (0, 1, 11, 1, "b"), (0, 2, 12, 1, "a")], "batch_id int, src int, tgt int, label int, thash string")
    assert {(r.src, r.target) for r in corpus.distinct_targets(df).collect()} == {(1, 10), (1, 11), (2, 10)}


def test_greedy_batches(spark):
    items = spark.createDataFrame([(1, 5), (2, 5), (3, 1), (4, 20), (5, None), (6, 0)], "id bigint, tokens int")
    got = {r.id: r.batch for r in batching.greedy_batches(items, 3, 10).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 2, 5: 3, 6: 3}
    assert batching.greedy_batches(items.where("id < 0"), 3, 10).count() == 0


def test_duplicates_never_share_a_batch(spark):
    rows = [(1, 4, [6, 9]), (2, 3, []), (3, 3, [5]), (4, 3, None), (5, 4, [3, 7]), (6, 2, [1]), (7, 3, [5])]
    df = spark.createDataFrame(rows, "id bigint, tokens int, dups array<bigint>")
    got = {r.id: (r.block, r.batch) for r in batching.apart_from_duplicates(df, 4).collect()}
    assert set(got) == set(range(1, 8))
    for i, _, dups in rows:
        assert all(got[i] != got[d] for d in dups or [] if d in got)
    assert max(list(got.values()).count(x) for x in got.values()) <= 4


def test_batches_with_hard_negatives_keep_their_limits(spark):
    rows = [(i, 5, [], [(100 + i // 2, 3), (200 + i, 4)]) for i in range(40)] + [(99, 500, [], [])]
    df = spark.createDataFrame(rows, "id bigint, tokens int, dups array<bigint>, negatives array<struct<id:bigint,tokens:bigint>>")
    got = batching.apart_from_duplicates(df, 16, 30, 200, 8).collect()
    batches = {}
    for r in got:
        batches.setdefault((r.block, r.batch), []).append(r)
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows)
    for b in batches.values():
        named = [x for r in b for x in [*r.negatives, *r.fill]]
        assert len(named) == len(set(named)) and (len(b) == 1 or sum(2 + len(r.negatives) for r in b) <= 30)
        assert len(b) == 1 or sum(10 + sum(3 if x < 200 else 4 for x in r.negatives) for r in b) <= 200


def test_places_in_groups_of_any_size(spark):
    df = spark.createDataFrame([(0 if i < 700 else i % 5, (i * 7919) % 1009, i) for i in range(1000)], "g int, x int, i int")
    got = order.ranked_within(df, ["g"], F.col("x"), F.col("i")).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.x, r.i, r.place))
    assert all([p for *_, p in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values()) and len(got) == 1000
    assert order.ranked_within(df.where("false"), ["g"], F.col("x")).count() == 0 and order.ranked(df.where("false"), F.col("x")).count() == 0


def test_product_codes_in_lists_find_what_lies_near(spark):
    rng = np.random.default_rng(3)
    at = rng.standard_normal((20, 16))
    rows = [(i, (at[i % 20] + rng.standard_normal(16) * 0.2).tolist()) for i in range(600)]
    v = search.normalised(spark.createDataFrame(rows, "id bigint, e array<double>"), "e", "vec", "id")
    centers, books, postings = search.build_index(v, 8, 8, 32)
    q = v.where("id < 40").select(F.col("id").alias("q"), "vec")
    exact = search.exact_knn(q, v.select(F.col("id").alias("t"), "vec"), 5)
    found = search.ivfpq_search(q, postings, centers, books, 30, 4)
    cut = search.ivfpq_search(q, postings, centers, books, 30, 4, list_block=25)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in cut.collect()}
    recall = {r.level: r.recall for r in search.index_recall(found, exact, [5, 30], gold=5).collect()}
    assert recall[30] > 0.8 and recall[30] >= recall[5]
    soft = search.soft_codes(search.residuals(search.assigned(v, centers), centers).select("id", "vec"), books, 1e-9).orderBy("id").first().vec
    hard = search.reconstructed(postings.select("id", "codes"), books).orderBy("id").first().vec
    assert np.allclose(soft, hard)


def test_pooling_of_groups_that_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i % 3 if i < 90 else None, [float(i), -float(i)]) for i in range(100)] + [(5, None)]
        df = spark.createDataFrame(rows, "g int, vec array<double>")
        got = {r.g: r.vec for r in encode.pool(df, ["g"]).collect()}
        assert got == {g: [np.mean([i for i in range(90) if i % 3 == g]), -np.mean([i for i in range(90) if i % 3 == g])] for g in range(3)} | {None: [94.5, -94.5]}
        assert {r.g: r.vec[0] for r in encode.pool(df, ["g"], "max").collect()} == {0: 87.0, 1: 88.0, 2: 89.0, None: 99.0}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sampled_sources_reuse_texts_and_are_cut(spark):
    rows = [(k, s, 100 * s + k, int(k % 2 == 0), 10, 20, f"s{s}", f"t{k % 3}") for s in range(1, 6) for k in range(6)] + [(99, 9, 900, 1, 10, 5000, "s9", "big")]
    df = spark.createDataFrame(rows, "ex_id int, src bigint, tgt bigint, label int, slen int, tlen int, shash string, thash string")
    got = batching.source_batches(df, 50, 300, acceptable=0.99).collect()
    one = [r for r in got if r.src < 6]
    assert {r.src for r in one} == {1, 2, 3, 4, 5} and sum(r.new for r in one if r.batch == one[0].batch) <= 3
    assert not [r for r in got if r.src == 9]  # nothing but one positive, alone in its batch
    stats = batching.sampling_statistics(batching.source_batches(df, 50, 300)).first()
    assert stats.sources == 5 and stats.in_batch > 0

def test_length_chunks_count_padding(spark):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate([3, 5, 1, 4, 2])], "block int, id int, tokens int")
    chunks = {}
    for r in batching.length_chunks(df, 10, 10).collect():
        chunks.setdefault(r.chunk, []).append(r.tokens)
    assert [sorted(c) for _, c in sorted(chunks.items())] == [[4, 5], [1, 2, 3]]


def test_knn_in_blocks_equals_one_block(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-2, 3, (60, 4)))]
    t = spark.createDataFrame(rows, "t bigint, vec array<double>")
    q = t.where("t < 20").withColumnRenamed("t", "q")
    a = search.exact_knn(q, t, 5).orderBy("q", "rank").collect()
    assert a == search.exact_knn(q, t, 5, 7, 11).orderBy("q", "rank").collect()
    m = np.array([v for _, v in rows])
    for r in a:
        s = m @ m[r.q]
        assert r.t == np.lexsort((np.arange(60), -s))[r["rank"] - 1]


def test_own_vector_is_dropped_only_from_the_first_place(spark):
    knn = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.8, 2), (1, 3, 0.7, 3), (2, 5, 0.9, 1), (2, 2, 0.9, 2), (2, 3, 0.1, 3)], "q int, t int, sim double, rank int")
    got = {(r.q, r.t, r["rank"]) for r in search.without_self(knn, 2).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (2, 5, 1), (2, 2, 2)}


def test_metrics_count_queries_without_hits(spark):
    knn = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (2, 30, 0.5, 1)], "q int, t int, sim double, rank int")
    gold = spark.createDataFrame([(1, 11), (1, 12), (2, 20), (3, 7)], "q int, t int")
    rows, n = metrics.marked(knn, gold), metrics.gold_counts(gold)
    r = metrics.retrieval_at(rows, n, [2]).first()
    assert (r.queries, r.rec, r.map) == (3, round(1 / 4, 6), round((0.5 / 2) / 3, 6))
    assert metrics.mean_average_precision(rows, n).first().map == round((0.5 / 2) / 3, 6)
    none = metrics.threshold_sweep(spark.createDataFrame([(0.1, 0)], "sim double, label int"), [0.5]).first()
    assert (none.precision, none.recall, none.f1, none.accuracy) == (0, 0, 0, 1)


def test_gap_rule(spark):
    s = spark.createDataFrame([(1, i, p) for i, p in enumerate([0.9, 0.85, 0.5, 0.45])], "doc_id int, label int, p double")
    assert {r.label for r in classify.by_gap(s, 0.1).collect()} == {0, 1}
    assert {r.label for r in classify.by_gap(s, 1.0).collect()} == {0, 1, 2, 3}


def test_grid_has_both_ends():
    assert classify.grid(0.1, 0.5, 0.1) == [0.1, 0.2, 0.3, 0.4, 0.5]


def test_match_modes(spark):
    g = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 3)], "doc_id int, label int")
    d = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 4)], "doc_id int, label int")
    assert tuple(classify.match_modes(d, g).first()) == (3, 1, 2, 2)


def test_pooling(spark):
    rows = [(0, 0, [1.0, 2.0]), (0, 1, [5.0, 0.0]), (1, 0, [3.0, 8.0])]
    df = spark.createDataFrame(rows, "g int, i int, vec array<double>")
    get = lambda how: {r.g: r.vec for r in encode.pool(df, ["g"], how, order="i").collect()}
    assert get("max") == {0: [5.0, 2.0], 1: [3.0, 8.0]} and get("mean") == {0: [3.0, 1.0], 1: [3.0, 8.0]}
    assert get("first")[0] == [1.0, 2.0] and get("last")[0] == [5.0, 0.0]


def test_encoder_keeps_the_order_and_pads_empty_sequences(spark):
    sums = lambda seqs: np.array([[sum(s), len(s)] for s in seqs], float)
    df = spark.createDataFrame([(1, [3, 4]), (2, []), (3, None), (4, [1] * 9)], "id bigint, tokens array<int>")
    got = {r.id: r.vec for r in encode.encode_with(df, sums, 4, normalise=False).collect()}
    assert got == {1: [7.0, 2.0], 2: [0.0, 1.0], 3: [0.0, 1.0], 4: [9.0, 9.0]}
    everything, new = encode.encode_cached(df, spark.createDataFrame([(1, [0.0, 0.0])], "id bigint, vec array<double>"), lambda x: encode.encode_with(x, sums, 4, normalise=False))
    assert {r.id for r in new.collect()} == {2, 3, 4} and everything.count() == 4


def test_merge_of_models(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (2, 0, 4.0)], "model int, pos int, value double")
    assert encode.weighted_merge(df).first().value == 3.0 and encode.weighted_merge(df, {1: 1.0, 2: 0.0}).first().value == 2.0


def test_fitted_index_finds_most(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vec array<double>")
    centers = search.fit_centers(df, 8)
    postings = search.assigned(df, centers).select("id", "vec", "center")
    q, t = df.withColumnRenamed("id", "q").where("q % 10 = 0"), df.withColumnRenamed("id", "t")
    exact = search.without_self(search.exact_knn(q, t, 2), 1)
    found = search.without_self(search.ivf_search(q, postings, centers, 6, 6), 5)
    assert search.index_recall(found, exact, [5]).first().recall >= 0.9


@pytest.mark.parametrize("value", ["", None, " \n 　"])
def test_texts_without_lines(spark, value):
    docs = spark.createDataFrame([(1, value), (2, "a b c\nd")], "doc_id bigint, text string")
    assert [r.doc_id for r in text.document_info(docs).collect()] == [2]
    assert text.sentence_lines(docs).count() == 2


def test_every_label_has_a_score(spark):
    from texloom.plans import vector_queries

    rows = [(k, k % 12, [float(k % 12 == j) for j in range(12)]) for k in range(24)]
    v = spark.createDataFrame(rows, "id bigint, label int, vec array<double>")
    assert vector_queries._label_scores(v).groupBy("q").agg(F.countDistinct("t").alias("n")).where("n = 12").count() == 24
