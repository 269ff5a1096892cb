from pyspark.sql import functions as F

from texloom.functions import sequences as S
from texloom.functions import text as X
from texloom.functions import vectors as V


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_white_space_of_every_kind_is_stripped(spark):
    odd = "  \t a b 　 \u0085"
    assert one(spark, X.strip(F.lit(odd)))[0] == odd.strip() == "a b"
    assert one(spark, X.is_blank(F.lit("  \n")), X.is_blank(F.lit(" x"))) == (True, False)


def test_lines_and_fingerprint(spark):
    import hashlib

    text = "one\n\n \n two \nthree"
    lines, mark = one(spark, X.lines(F.lit(text)), X.fingerprint(F.lit(text)))
    assert lines == ["one", "two", "three"]
    assert mark == hashlib.md5("one\n two \nthree".encode()).hexdigest()
    assert one(spark, X.lines(F.lit(None).cast("string")))[0] is None


def test_sentence_filter(spark):
    keep = lambda s: one(spark, X.keeps_sentence(F.lit(s), 3, 0.5))[0]
    assert keep("a fine long sentence 7") and not keep("too short") and not keep("1 2 3 a") and not keep("1 2 3")


def test_id_from_path(spark):
    ids = [one(spark, X.id_from_path(F.lit(p)))[0] for p in ("/a/b/12.txt.gz", "12.txt", "x/y", "/a.b/7")]
    assert ids == ["12", "12", "y", "7"]


def test_special_tokens_are_kept_whole(spark):
    seq = F.array(*[F.lit(i) for i in range(10)])
    assert one(spark, S.with_special_tokens(seq, [101], [102], 5))[0] == [101, 0, 1, 2, 102]
    assert one(spark, S.with_special_tokens(seq, [101], [102], 1))[0] == [101, 102]


def test_fragments_and_padding(spark):
    assert one(spark, S.fragment_lengths(F.lit(50), 16))[0] == [16, 16, 16, 2]
    assert one(spark, S.fragment_lengths(F.lit(40), 16))[0] == [16, 16, 8]
    assert one(spark, S.fragment_lengths(F.lit(0), 16))[0] == []
    a = F.array(F.lit(1), F.lit(2))
    assert one(spark, S.pad(a, F.lit(4)), S.pad(a, F.lit(4), left=True), S.pad(a, F.lit(1))) == ([1, 2, 0, 0], [0, 0, 1, 2], [1, 2])
    assert one(spark, S.round_up(F.lit(9), 8), S.round_up(F.lit(8), 8)) == (16, 8)
    assert one(spark, S.or_pad(F.array().cast("array<int>")))[0] == [0]


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.norm(a), V.dot(a, a)) == (5.0, 25.0)
    assert one(spark, V.scaled(a, V.norm(a)), V.scaled(b, V.norm(b))) == ([0.6, 0.8], [0.0, 0.0])
    assert one(spark, V.cosine(a, b, V.norm(a), V.norm(b)))[0] is None
    assert one(spark, V.ratio(F.lit(1.0), F.lit(0.0)), V.f1(F.lit(0.0), F.lit(0.0))) == (0.0, 0.0)
