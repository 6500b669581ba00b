import pytest
from pyspark.sql import functions as F

from cuelake.functions.timing import boxes_adjacent
from cuelake.operators import screen
from tests.test_speech import out

DET = "video_id long, ord long, frame_time double, box struct<x1:int,y1:int,x2:int,y2:int>, text string, angle double, confidence double"
EVENT = "video_id long, ord long, start double, end double, box struct<x1:int,y1:int,x2:int,y2:int>, text string, frame_count long, confidence double"


def dets(spark, rows):
    return spark.createDataFrame([(0, i, float(t), b, x, 0.0, float(c)) for i, (t, b, x, c) in enumerate(rows)], DET)


def events(spark, rows):
    return spark.createDataFrame([(0, i, 1.0, 3.0, (100, 800, 500, y2), x, 5, c) for i, (x, y2, c) in enumerate(rows)], EVENT)


BOX, FAR = (100, 200, 300, 240), (600, 600, 700, 640)


def test_detection_events(spark):
    group = lambda rows, **kw: out(screen.group_detections(dets(spark, rows), **kw).orderBy("start"), "start", "end", "text", "frame_count")
    assert group([(t, BOX, "same", 0.9) for t in (0, 0.5, 1)]) == [(0, 1, "same", 3)]
    assert group([(0, BOX, "AA", 1), (100, BOX, "AA", 1)]) == [(0, 100, "AA", 2)]
    assert len(group([(0, BOX, "AA", 1), (100, BOX, "AA", 1)], strict_gap=True)) == 2
    assert len(group([(0, BOX, "AA", 1), (50, BOX, "bb", 1), (100, BOX, "AA", 1)])) == 3
    assert len(group([(0, BOX, "AA", 1), (0.5, FAR, "AA", 1)])) == 2
    assert len(group([(0, BOX, "hello", 1), (0.5, BOX, "other", 1)])) == 2
    assert group([]) == []
    first = group([(0, BOX, "hello there", 1), (0.5, BOX, "hello thera", 1)])
    assert first == [(0, 0.5, "hello there", 2)]


@pytest.mark.parametrize("b, want", [((310, 200, 500, 240), True), ((100, 260, 300, 300), True), ((800, 200, 900, 240), False), ((100, 240, 300, 240), False)])
def test_adjacent(spark, b, want):
    box = lambda x: F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), x)])
    assert spark.range(1).select(boxes_adjacent(box(BOX), box(b))).first()[0] is want
    assert screen._near(dict(zip(("x1", "y1", "x2", "y2"), BOX)), dict(zip(("x1", "y1", "x2", "y2"), b))) is want


def test_frames(spark):
    rows = out(screen.merge_frames(dets(spark, [(0, (100, 200, 200, 240), "short", 0.8), (0, (210, 200, 500, 240), "this is the anchor", 1.0), (0, (900, 900, 950, 940), "far", 1)])), "text", "box", "confidence", "merged")
    assert [(r[0], tuple(r[1]), round(r[2], 6), r[3]) for r in rows] == [("short this is the anchor", (100, 200, 500, 240), 0.9, 2)]
    stacked = out(screen.merge_frames(dets(spark, [(1, (100, 200, 300, 240), "top", 1), (1, (100, 260, 300, 300), "bottom", 1)])), "text")
    assert stacked == [("top\nbottom",)]
    chain = out(screen.merge_frames(dets(spark, [(2, (0, 0, 100, 40), "aaa", 1), (2, (110, 0, 200, 40), "bb", 1), (2, (210, 0, 300, 40), "c", 1)])), "text")
    assert chain == [("aaa bb c",)]


def test_reasons(spark):
    rows = [("fine words", 860, 0.5), ("fine words", 810, 0.9), ("fine words", 1000, 0.9), ("X", 860, 0.9), ("logo text", 860, 0.9), ("!!!", 860, 0.9), ("fine words, long", 860, 0.9)]
    kept = out(events(spark, rows).select("ord", screen.reject_reason(F.lit(1080), 0.75, 0.02, 0.15, texts=("Logo Text",)).alias("r")).orderBy("ord"), "r")
    assert [r[0] for r in kept] == ["low_confidence", "box_too_small", "box_too_large", "text_too_short", "blocklisted", "pattern_match", None]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            screen.filter_events(events(spark, rows), bad)


def test_padding(spark):
    one = lambda a, b: spark.createDataFrame([(float(a), float(b))], "start double, end double")
    assert out(screen.pad_events(one(1, 2)), "start", "end") == [(0.75, 2.25)]
    assert out(screen.pad_events(one(0.1, 1)), "start") == [(0,)]
    assert out(screen.pad_events(one(1, 2), -0.5), "start", "end") == [(1, 2)]


def test_repeats(spark):
    rows = events(spark, [("often", 860, 0.9)] * 10 + [("Some", 860, 0.9)] * 8 + [("so me", 860, 0.9)])
    left = lambda **kw: {r[0] for r in out(screen.drop_repeated(rows, rows, **kw), "text")}
    assert left(most=8) == {"Some", "so me"}
    assert left(most=8, folded=True) == set()
    assert left(most=0) == {"often", "Some", "so me"}


def test_kernels(spark):
    one = spark.range(1)
    steps = F.expr("array(array(0.1D, 0.8D, 0.1D), array(0.2D, 0.6D, 0.2D), array(0.9D, 0.1D, 0.0D), array(0.1D, 0.7D, 0.2D), array(0.1D, 0.1D, 0.8D))")
    r = one.select(screen.ctc_decode(steps, F.array(F.lit(""), F.lit("a"), F.lit("b"))).alias("r")).first().r
    assert r.text == "aab" and abs(r.confidence - (0.8 + 0.7 + 0.8) / 3) < 1e-9
    assert [one.select(screen.folded_angle(F.lit(float(a)))).first()[0] for a in (-80, 80, 10)] == [10, -10, 10]
    assert tuple(one.select(screen.crop_box(F.lit(100), F.lit(200), 0.4, 0.05, 0.15, 0.15)).first()[0]) == (15, 80, 85, 190)
    with pytest.raises(Exception, match="nothing is left"):
        one.select(screen.crop_box(F.lit(10), F.lit(10), 0.6, 0.6)).first()
    frames = spark.range(10).select(F.col("id").alias("frame_no"))
    assert [r[0] for r in out(screen.sampled(frames, F.lit(5.0), 2.0), "frame_no")] == [0, 2, 4, 6, 8]  # 2.5 rounds to 2
    boxes = spark.createDataFrame([(0, 0.0, 0, (0, 0, 4, 90)), (0, 0.0, 1, (0, 0, 20, 20)), (0, 0.0, 2, (0, 0, 9, 9)), (0, 0.0, 3, (0, 0, 30, 30))], "video_id long, frame_time double, ord long, box struct<x1:int,y1:int,x2:int,y2:int>")
    assert [r[0] for r in out(screen.boxes_by_area(boxes).orderBy("rank"), "ord")] == [3, 1]
