import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import ensemble, fusion
from tests.test_speech import out, texts


@pytest.mark.parametrize("raw, want", [("[SIGN] TOKYO", "TOKYO"), ("미나미어머니*지금까지", "지금까지"), ("ZENA#hello", "hello"), ("hi: there", "there"), ("plain", "plain")])
def test_labels(spark, raw, want):
    assert spark.range(1).select(T.strip_label(F.lit(raw))).first()[0] == want


def test_similarity(spark):
    val = lambda c: spark.range(1).select(c).first()[0]
    assert val(T.similarity(F.lit("안녕 하세요"), F.lit("안녕하세요"))) == 1.0
    assert val(T.label_free_similarity(F.lit("지금까지"), F.lit("미나미어머니*지금까지"))) == 1.0
    assert val(T.similarity(F.lit("tide"), F.lit("diet"))) == 0.25
    assert val(T.similarity(F.lit("diet"), F.lit("tide"))) == 0.5
    assert val(T.similarity(F.lit(""), F.lit(" 　"))) == 1.0
    assert val(T.strip(F.lit("　 a b\x1c\n"))) == "a b"


def fused(spark, spoken, shown, **kw):
    return out(fusion.fuse(texts(spark, spoken), texts(spark, shown), **kw).orderBy("ord"), "start", "text", "source_hint")


def test_fuse_hint(spark):
    assert fused(spark, [(1, 3, "오늘은 좋은 날이네요")], [(1, 3, "오늘은 좋은 날이에요")], agree=0.95) == [(1, "오늘은 좋은 날이네요", "오늘은 좋은 날이에요")]
    assert fused(spark, [(1, 3, "안녕하세요")], [(1, 3, "TOKYO")]) == [(1, "안녕하세요", "TOKYO")]


def test_fuse_gap(spark):
    assert [r[1] for r in fused(spark, [(1, 2, "first"), (5, 6, "second")], [(3, 4, "caption")])] == ["first", "caption", "second"]
    assert [r[1] for r in fused(spark, [(1, 2, "first")], [(3, 4, "caption")], fill_gaps=False)] == ["first"]


def test_fuse_similarity_breaks_ties(spark):
    assert fused(spark, [(1, 5, "whisper text")], [(1, 3, "wsp text"), (1, 5, "whisper text")]) == [(1, "whisper text", None)]


def test_fuse_sides_alone(spark):
    assert fused(spark, [], [(1, 1.2, "short"), (1, 3, "TOKYO")], prefix="[SIGN] ") == [(1, "[SIGN] TOKYO", None)]
    assert [r[1] for r in fused(spark, [(5, 6, "b"), (1, 2, "a")], [])] == ["b", "a"]
    assert fused(spark, [], []) == []


def test_claims_are_one_to_one(spark):
    rows = out(fusion.greedy_matches(texts(spark, [(0, 4, "a"), (1, 5, "a")]), texts(spark, [(0, 5, "a"), (1, 4, "b")])).orderBy("a_ord"), "a_ord", "b_ord")
    assert rows == [(0, 0), (1, 1)]


def decided(spark, primary, secondary):
    return ensemble.reconcile(texts(spark, primary), texts(spark, secondary)).orderBy("ord").collect()


def test_reconcile(spark):
    assert decided(spark, [(0, 2, "안녕하세요")], [(0, 2, "안녕하세요")])[0].decision == "agreed"
    row = decided(spark, [(0, 2, "안녕하세요 반갑습니다")], [(0.1, 2, "안녕하세여 반가워요")])[0]
    assert (row.decision, row.start, row.text) == ("secondary", 0, "안녕하세여 반가워요")
    rows = decided(spark, [(0, 1, "before"), (1, 3, "안녕하세요"), (3, 4, "after"), (4, 5, "later")], [(1, 3, "완전히 다른 말")])
    assert [r.decision for r in rows] == ["primary", "pending", "primary", "primary"]
    assert (rows[1].primary_text, rows[1].secondary_text, rows[1].context_before, rows[1].context_after) == ("안녕하세요", "완전히 다른 말", "before", "after later")


def test_junk(spark):
    rows = texts(spark, [(0, 0.2, "."), (0, 1, "."), (0, 0.3, "안녕")])
    assert [r[0] for r in out(rows.filter(~ensemble.is_junk()), "ord")] == [1, 2]


def test_split():
    text = "안녕 비쥬얼즈의 정답은 짜란"
    pieces = T.split_in_proportion(text, [5, 5, 5])
    assert len(pieces) == 3 and "".join(pieces).replace(" ", "") == text.replace(" ", "")
    assert T.split_in_proportion("응", [3, 3]) == ["응", ""]
    assert T.split_in_proportion("whole", [9]) == ["whole"]


def test_resolutions(spark):
    cues = texts(spark, [(0, 1, "a"), (1, 2, "b"), (2, 3, "c")])
    new = spark.createDataFrame([(0, 1, "B"), (0, 2, "")], "video_id long, ord long, resolved string")
    assert [r[0] for r in out(ensemble.apply_resolutions(cues, new).orderBy("ord"), "text")] == ["a", "B", "c"]
