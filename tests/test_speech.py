import pytest
from pyspark.sql import functions as F

from cuelake.functions import timing as M
from cuelake.operators import diagnostics, speech as S
from cuelake.operators.common import interval_pairs

SEG = "video_id long, ord long, start double, end double"


def segs(spark, rows):
    return spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(rows)], SEG)


def texts(spark, rows):
    return spark.createDataFrame([(0, i, float(a), float(b), t) for i, (a, b, t) in enumerate(rows)], SEG + ", text string")


def out(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


@pytest.mark.parametrize("speech, asr, most, want", [
    ([(0, 2)], [(0.1, 0.9, "안녕"), (1.0, 1.9, "하세요")], 5, [(0, 2, "안녕 하세요")]),
    ([(2, 5)], [(1, 6, "x")], 1, [(2, 5, "x")]),
    ([(2, 4), (4, 6)], [(3, 5, "once")], 5, [(2, 4, "once")]),
    ([(10, 12)], [(0, 1, "lost")], 5, []),
    ([(0, 2)], [(0.5, 1, "  ")], 5, []),
    ([], [(0, 1, "x")], 5, []),
])
def test_speech_cues(spark, speech, asr, most, want):
    assert out(S.speech_cues(segs(spark, speech), texts(spark, asr), most).orderBy("ord"), "start", "end", "text") == want


def test_interval_pairs_meet_once_across_bins(spark):
    a, b = segs(spark, [(0, 100), (29, 31), (5, 5), (9, 2)]), segs(spark, [(10, 95), (30, 60), (100, 101)])
    assert sorted(out(interval_pairs(a, b), "a.ord", "b.ord")) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_merge_close_and_ranges(spark):
    assert out(S.merge_close(segs(spark, [(1, 2), (2.3, 3.5), (3.7, 4.5)]), 0.5), "ord", "start", "end") == [(0, 1, 4.5)]
    assert out(S.merge_close(segs(spark, [(0, 10), (1, 2), (9, 11)])), "start", "end") == [(0, 11)]
    rounded = lambda rows: [(round(a, 6), round(b, 6)) for a, b in rows]
    ranges = lambda rows: rounded(out(S.padded_ranges(segs(spark, rows)).orderBy("ord"), "clip_start", "clip_end"))
    assert ranges([(5, 6)]) == [(4.85, 6.15)]
    assert ranges([(0.05, 1)])[0][0] == 0
    assert ranges([(1, 2), (2.1, 3)])[1][0] == 2.05
    assert ranges([(1, 2), (3, 4)])[0][1] == 2.15


@pytest.mark.parametrize("rows, most, want", [
    ([(0, 8), (10, 18), (20, 28), (30, 38)], 20, [0, 0, 1, 1]),
    ([(0, 50), (60, 62)], 30, [0, 1]),
])
def test_batches(spark, rows, most, want):
    assert [r[0] for r in out(S.speech_batches(segs(spark, rows), most, 0.2).orderBy("ord"), "batch")] == want


def test_batch_mapping_and_time(spark):
    mapping = S.batch_mapping(S.speech_batches(segs(spark, [(1, 3), (5, 7)]), 40, 0.2), 0.2)
    rows = out(mapping.orderBy("entry"), "batch_start", "batch_end", "original_start", "original_end", "is_speech")
    assert rows == [(0, 2, 1, 3, True), (2, 2.2, 3, 3, False), (2.2, 4.2, 5, 7, True)]
    # At ten frames a second, 0.35 s has 3 frames and 0.23 s has 2; the silence stands for the end that the segment has, not for its last frame.
    coarse = S.batch_mapping(S.speech_batches(segs(spark, [(0.5, 0.85), (1.05, 1.28), (2, 3)]), 40, 0.2), 0.2, rate=10)
    want = [(0.0, 0.3, 0.5, 0.8, True), (0.3, 0.5, 0.85, 0.85, False), (0.5, 0.7, 1.05, 1.25, True), (0.7, 0.9, 1.28, 1.28, False), (0.9, 1.9, 2.0, 3.0, True)]
    assert [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in out(coarse.orderBy("entry"), "batch_start", "batch_end", "original_start", "original_end", "is_speech")] == want
    own = spark.createDataFrame([(0, 0, 0, 0.0, 2.0, 10.0, 12.0), (0, 0, 1, 2.0, 2.2, 12.0, 12.0)], "video_id long, batch long, entry long, batch_start double, batch_end double, original_start double, original_end double")
    times = spark.createDataFrame([(0, 0, t) for t in (2.1, -1.0, 5.0, 1.0)], "video_id long, batch long, t double")
    assert dict(out(S.map_batch_time(times, own, "t"), "t", "t_original")) == {2.1: 12.0, -1.0: 10.0, 5.0: 12.0, 1.0: 11.0}


def test_coverage(spark):
    lengths = spark.createDataFrame([(0, 10.0), (1, 10.0), (2, 10.0)], "video_id long, duration double")
    said = spark.createDataFrame([(0, 10.0), (1, 5.0)], "video_id long, end double")
    assert dict(out(S.coverage(said, lengths, 0.9, ("video_id",)), "video_id", "covered")) == {0: True, 1: False, 2: False}


@pytest.mark.parametrize("cue, speech, want", [((1, 5), [(2, 4)], [(2, 4)]), ((1, 5), [(0.5, 2), (4, 6)], [(1, 5)]), ((1, 2), [(3, 4)], []), ((1, 2.05), [(2, 3)], [])])
def test_clip(spark, cue, speech, want):
    assert out(S.clip_to_speech(texts(spark, [(*cue, "x")]), segs(spark, speech)), "start", "end") == want


@pytest.mark.parametrize("seq, repeat, swing", [("abbbc", 3, 2), ("aaaaax", 5, 2), ("ababababab", 1, 10), ("abb", 2, 2), ("a", 1, 0), ("aaa", 3, 0), ("abacac", 1, 4)])
def test_runs(spark, seq, repeat, swing):
    rows = texts(spark, [(i, i + 1, c) for i, c in enumerate(seq)])
    assert out(diagnostics.consecutive_runs(rows), "longest_consecutive") == [(repeat,)]
    best = max((n for i in range(len(seq)) for n in range(2, len(seq) - i + 1) if seq[i] != seq[i + 1] and all(seq[i + k] == seq[i + k - 2] for k in range(2, n))), default=0)
    assert swing == best
    assert out(diagnostics.alternating_runs(rows), "longest_alternating") == [(swing,)]


@pytest.mark.parametrize("rows, duration, want", [
    ([], 600.0, "warning"),
    ([(i, i + 1, "same") for i in range(6)], 10.0, "abort"),
    ([(i, i + 1, "ab"[i % 2]) for i in range(10)], 20.0, "abort"),
    ([(0, 1, "short")], 600.0, "warning"),
    ([(0, 20, "x" * 100)], 40.0, "warning"),
    ([(i * 2, i * 2 + 1, f"text {i} long enough") for i in range(5)], 10.0, "ok"),
])
def test_verdict(spark, rows, duration, want):
    chunk = spark.createDataFrame([(0, duration)], "video_id long, duration double")
    row = diagnostics.verdict(diagnostics.metrics(texts(spark, rows), chunk)).first()
    assert row.verdict == want
    assert row.segment_count == len(rows)


def test_stamps(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    assert val(M.ms_to_timestamp(F.lit(83456))) == "00:01:23,456"
    assert val(M.seconds_to_timestamp(F.lit(1.9999))) == "00:00:02,000"
    assert val(M.seconds_to_timestamp(F.lit(0.0005))) == "00:00:00,000"
    assert val(M.ms_to_timestamp(F.lit(360_000_000))) == "100:00:00,000"
    assert val(M.timestamp_to_ms(F.lit("01:02:03,004"))) == 3723004
    for bad in (M.seconds_to_timestamp(F.lit(-1.0)), M.timestamp_to_ms(F.lit("x"))):
        with pytest.raises(Exception, match="negative|malformed"):
            val(bad)
    assert [val(M.span_text(F.lit(x))) for x in (4.2, 124.2, 3724.2)] == ["4.20s", "2m 4.20s", "1h 2m 4.20s"]


@pytest.mark.parametrize("a, b, want", [((1, 3), (2, 4), 0.5), ((5, 10), (6, 7), 1.0), ((1, 2), (2, 3), 0.0), ((1, 1), (0, 2), 0.0)])
def test_ratio(spark, a, b, want):
    assert spark.range(1).select(M.overlap_ratio(*[F.lit(float(x)) for x in (*a, *b)])).first()[0] == want
