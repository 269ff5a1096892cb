import numpy as np
import pytest
from pyspark.sql import functions as F

from texloom.operators import documents as D
from texloom.operators import layers as L
from texloom.operators import tokenize as K


def encoder(**how):
    return L.SequenceEncoder(50, 16, **how)


KINDS = [dict(kind="average"), dict(kind="transformer", layers=2, heads=4, positions="sinusoidal"), dict(kind="transformer", heads=2, positions="learned", norm_first=True, begin=True, normalised=True, scaled=True),
         dict(kind="transformer", heads=2, full=False, pool="first"), dict(kind="lstm", bidirectional=True, pool="max"), dict(kind="gru", layers=2, pool="last", dense=8, activation="tanh")]


@pytest.mark.parametrize("how", KINDS)
def test_padding_changes_nothing(how):
    e = encoder(**how)
    seqs = [[1, 2, 3], [4], [5, 6, 7, 8, 9, 10, 11], [], [1, 2, 3]]
    together = e(seqs)
    assert together.shape == (5, how.get("dense", 16)) and np.allclose(together[0], together[4])
    for k, s in enumerate(seqs):
        assert np.allclose(e([s])[0], together[k], atol=1e-9)


def test_widths_are_checked():
    with pytest.raises(ValueError):
        encoder(kind="transformer", heads=3)
    with pytest.raises(ValueError):
        L.HierarchicalEncoder(encoder(), L.SequenceEncoder(8, 8))
    with pytest.raises(ValueError):
        encoder(weights={"tokens": np.zeros((2, 2))})
    with pytest.raises(ValueError):
        encoder(kind="fourier")
    assert encoder().weights["tokens"].shape == (56, 16)


def test_pooling_finds_the_last_token_on_either_side():
    x = np.arange(12.0).reshape(1, 6, 2)
    for mask, first, last in (([1, 1, 1, 0, 0, 0], 0, 4), ([0, 0, 1, 1, 1, 1], 4, 10)):
        m = np.array([mask], bool)
        assert L.pooled(x, m, "first")[0, 0] == first and L.pooled(x, m, "last")[0, 0] == last
    none = np.zeros((1, 6), bool)
    assert all((L.pooled(x, none, how) == 0).all() for how in ("mean", "max", "first", "last"))


def test_lstm_equals_its_formulas():
    e = encoder(kind="lstm")
    w, h, c = e.weights, np.zeros(16), np.zeros(16)
    s = lambda z: 1 / (1 + np.exp(-z))
    for t in (3, 9):
        i, f, g, o = np.split(w["tokens"][t] @ w["0.f.wi"] + h @ w["0.f.wh"], 4)
        c = s(f) * c + s(i) * np.tanh(g)
        h = s(o) * np.tanh(c)
    x, mask = L.padded([[3, 9]])
    assert np.allclose(L.recurrent(w["tokens"][x], mask, e._part("0.f."), "lstm")[0, -1], h)


def test_positions_and_padding():
    p = L.sinusoidal_positions(3, 4)
    assert np.allclose(p[2], [np.sin(2), np.cos(2), np.sin(2 / 100), np.cos(2 / 100)])
    ids, mask = L.padded([[1, 2], [3]], pad=9, multiple=4, left=True)
    assert ids.tolist() == [[9, 9, 1, 2], [9, 9, 9, 3]] and mask.sum() == 3


def test_levels_of_a_document():
    e = L.HierarchicalEncoder(encoder(), encoder(), encoder(), fragment=2)
    docs = [[[1, 2], [3]], [[4]], [[1], [2], [3], [4], [5]], []]
    whole = e(docs)
    w = encoder().weights["tokens"]
    means = [w[[t]].mean(0) for t in (1, 2, 3, 4, 5)]
    assert np.allclose(whole[2], np.mean([np.mean(means[:2], 0), np.mean(means[2:4], 0), means[4]], 0))
    assert np.allclose(e(docs[:1])[0], whole[0]) and np.allclose(whole[3], w[0])
    assert np.allclose(L.HierarchicalEncoder(encoder())(docs)[0], w[[1, 2, 3]].mean(0))


def test_memory_is_bounded_however_uneven_the_sequences_are():
    import tracemalloc

    e = L.SequenceEncoder(64, 16, "transformer", heads=2)
    levels = L.HierarchicalEncoder(e, encoder(), encoder(), fragment=1)
    for one, what in ((e, [[1] * 128] * 1000), (e, [[1] * 2000]), (levels, [[[1]] * 4000] + [[[2]]] * 1000)):
        tracemalloc.start()
        got = one(what)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 100e6 and len(got) == len(what)


def test_parts_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 50, n).tolist() for n in rng.integers(0, 40, 60)]
    docs = [seqs[k : k + n] for k, n in enumerate(rng.integers(0, 9, 50))]
    for how in KINDS:
        levels = L.HierarchicalEncoder(encoder(), encoder(**how), encoder(**how | {"dense": None}), fragment=3) if not how.get("dense") else None
        whole = [e(x) for e, x in ((encoder(**how), seqs), (levels, docs)) if e]
        with monkeypatch.context() as m:
            m.setattr(L, "NUMBERS", 500)
            parts = [e(x) for e, x in ((encoder(**how), seqs), (levels, docs)) if e]
        assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(whole, parts)) and encoder(**how)([]).shape == (0, how.get("dense", 16))


def test_texts_are_tokenized_in_portions(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "é b\nc " * (k % 4)) for k in range(40)], "doc_id long, text string").coalesce(1)
    e, conf = L.HierarchicalEncoder(encoder(), encoder()), K.TokenizerConf("words")
    whole = {r.doc_id: r.vec for r in D.encode_documents(docs, e, conf).collect()}
    monkeypatch.setattr(D, "CHUNK_BYTES", 10)
    assert whole == {r.doc_id: r.vec for r in D.encode_documents(docs, e, conf).collect()} and len(whole) == 40


def test_documents_are_encoded_alike_in_every_chunk(spark):
    docs = spark.createDataFrame([(1, "a b\nc"), (2, ""), (3, None), (4, "a b\n\nc"), (5, "d " * 500)], "doc_id long, text string")
    e = L.HierarchicalEncoder(L.SequenceEncoder(64, 16, "transformer", heads=2), encoder())
    conf = K.TokenizerConf("words")
    got = {r.doc_id: r.vec for r in D.encode_documents(docs, e, conf).collect()}
    small = {r.doc_id: r.vec for r in D.encode_documents(docs, e, conf, chunk_tokens=2).collect()}
    assert all(np.allclose(got[k], small[k]) for k in got) and got[1] == got[4] and got[2] == got[3]
    assert all(abs(np.dot(v, v) - 1) < 1e-9 for v in got.values())


def test_tokenizers_are_plug_ins(spark):
    docs = spark.createDataFrame([(1, "3 4 5"), (2, ""), (3, None)], "doc_id long, text string")
    conf = K.TokenizerConf(prefix=(101,), suffix=(102,), max_length=4)
    assert {r.doc_id: r.tokens for r in K.tokenized(docs, conf).collect()} == {1: [101, 3, 4, 102], 2: [101, 102], 3: []}
    assert {r.doc_id: r.tokens for r in K.tokenized(docs, K.TokenizerConf(), pad_empty=True).collect()} == {1: [3, 4, 5], 2: [0], 3: [0]}
    K.register("letters", lambda conf: type("T", (), {"encode": lambda self, texts: [[ord(c) for c in t] for t in texts]})())
    assert K.tokenized(docs, K.TokenizerConf("letters")).where("doc_id = 1").first().tokens == [ord(c) for c in "3 4 5"]
    assert tuple(K.token_totals(K.tokenized(docs, conf), 2).first()) == (3, 2, 2, 2)
    with pytest.raises(ValueError):
        K.tokenized(docs, K.TokenizerConf("none"))


@pytest.mark.parametrize(("kind", "name"), [("sentencepiece", "piece_bpe_32k.model"), ("tokenizers", "byte_bpe_50k.json")])
def test_public_tokenizers(spark, kind, name):
    import os

    path = f"/opt/tokenizers/{name}"
    if not os.path.exists(path):
        pytest.skip("no tokenizer file")
    docs = spark.createDataFrame([(1, "one two"), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in K.tokenized(docs, K.TokenizerConf(kind, path)).collect()}
    assert len(got[1]) > 1 and got[2] == []


def test_a_head_learns_and_a_classifier_labels(spark, tmp_path):
    rng = np.random.default_rng(2)
    at = rng.standard_normal((4, 6)) * 3
    rows = [(i, i % 4, (at[i % 4] + rng.standard_normal(6) * 0.5).tolist()) for i in range(400)]
    v = spark.createDataFrame(rows, "doc_id long, label int, vec array<double>")
    w, b, labels = D.fit_head(v.where("doc_id < 300"))
    scores = D.head_scores(v.where("doc_id >= 300"), w, b, labels)
    best = D.Predictor("topk", k=1).decide(scores).join(v.select("doc_id", F.col("label").alias("gold")), "doc_id")
    assert best.where("label = gold").count() >= 97
    assert D.Predictor.chosen(None, {1: 0.4}, None).kind == "per_label" and D.Predictor.chosen(None, None, {"kind": "gap", "gap": 0.2}).gap == 0.2
    for p in (D.Predictor("gap"), D.Predictor("topk_threshold", k=2, threshold=0.3), D.Predictor("per_label", thresholds={0: 0.5}), D.Predictor()):
        assert p.decide(scores).count() > 0
    e = L.HierarchicalEncoder(L.SequenceEncoder(64, 6))
    c = D.DocumentClassifier(e, K.TokenizerConf("words"), w, b, labels, D.Predictor("topk", k=2))
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: len(r.labels) for r in c.classify(docs).collect()} == {1: 2, 2: 2}
    (tmp_path / "x.txt").write_text("a b")
    paths = c.classify_paths(spark, [str(tmp_path / "x.txt"), str(tmp_path / "gone.txt")]).orderBy("doc_id").collect()
    assert paths[0].labels == c.classify(docs).where("doc_id = 1").first().labels and len(paths) == 2
    assert c.classify_folder(spark, str(tmp_path)).first().doc_id == "x"
    assert [r.id for r in D.encode_folder(spark, str(tmp_path), e, K.TokenizerConf("words")).collect()] == ["x"]
    assert [r.id for r in D.encode_paths(spark, [str(tmp_path / "x.txt")], e, K.TokenizerConf("words"), 7).collect()] == [7]
