"""One query per operator over the derived tables, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import text as T
from .functions import timing as M
from .operators import completion, diagnostics, ensemble, fusion, screen
from .operators import speech as S
from .operators.common import interval_pairs
from .plans import config, pipeline
from .sources import codecs, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH RECURSIVE {X.SQL.strip()}{', ' if sql.lstrip()[:6].upper() != 'SELECT' else ' '}{sql.strip()}"
        return f

    return keep


# DuckDB's regular expressions know ASCII white space only; the derived texts have no other.
STRIP = lambda c: f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"
STAMP = lambda ms: f"printf('%02d:%02d:%02d,%03d', ({ms}) // 3600000, ({ms}) % 3600000 // 60000, ({ms}) % 60000 // 1000, ({ms}) % 1000)"
MS = lambda c: f"CAST(round_even({c} * 1000, 0) AS BIGINT)"
OVER = lambda a, b: f'(least({a}."end", {b}."end") - greatest({a}.start, {b}.start))'
RATIO = lambda a, b: f'(CASE WHEN {OVER(a, b)} > 0 THEN {OVER(a, b)} / least({a}."end" - {a}.start, {b}."end" - {b}.start) ELSE 0 END)'

ASSIGN = f"""
pairs AS (SELECT p.video_id, p.ord, p.start, p."end", p.text, v.ord AS s_ord, v.start AS s_start, v."end" AS s_end, {OVER('p', 'v')} AS shared,
         row_number() OVER (PARTITION BY p.ord ORDER BY {OVER('p', 'v')} DESC, v.ord) AS rn
  FROM prim p JOIN speech v ON p.video_id = v.video_id AND p.start < v."end" AND v.start < p."end"),
assigned AS (SELECT * FROM pairs WHERE rn = 1),
cues AS (
  SELECT video_id, s_start AS start, s_end AS "end", {STRIP("string_agg(text, ' ' ORDER BY start, ord)")} AS text, s_ord, 0.0::DOUBLE AS a, 0 AS o FROM assigned
  WHERE s_end - s_start <= 2.0 GROUP BY video_id, s_ord, s_start, s_end HAVING {STRIP("string_agg(text, ' ' ORDER BY start, ord)")} <> ''
  UNION ALL
  SELECT video_id, greatest(start, s_start), least("end", s_end), text, s_ord, start, ord FROM assigned WHERE s_end - s_start > 2.0 AND least("end", s_end) > greatest(start, s_start)),
ranked AS (SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start, s_ord, a, o) - 1 AS BIGINT) AS ord, start, "end", text FROM cues)
"""


@query("vad_asr_assign", ASSIGN + "SELECT video_id, ord, s_ord AS speech_ord, shared FROM assigned")
def vad_asr_assign(spark: SparkSession, d: str) -> DataFrame:
    return S.assigned_spans(X.speech(spark, d), X.primary(spark, d)).select("video_id", "ord", F.col("speech.ord").alias("speech_ord"), "shared")


@query("vad_asr_cues", ASSIGN + f"""
SELECT r.video_id, r.ord, start + "offset" AS start, "end" + "offset" AS "end", text, {STAMP(MS('(start + "offset")'))} AS srt_start, {STAMP(MS('("end" + "offset")'))} AS srt_end
FROM ranked r JOIN chunk USING (video_id)""")  # fmt: skip
def vad_asr_cues(spark, d):
    cues = process_whisper(spark, d)
    return cues.select("video_id", "ord", "start", "end", "text", M.seconds_to_timestamp(F.col("start")).alias("srt_start"), M.seconds_to_timestamp(F.col("end")).alias("srt_end"))


@query("srt_render", f"""
SELECT video_id, string_agg(n || chr(10) || {STAMP(MS('start'))} || ' --> ' || {STAMP(MS('"end"'))} || chr(10) || text, chr(10) || chr(10) ORDER BY n) || chr(10) AS srt
FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ord) AS n FROM prim) GROUP BY video_id""")  # fmt: skip
def srt_render(spark, d):
    return sinks.render_srt(X.primary(spark, d))


@query("srt_timestamp_roundtrip", f"SELECT ord, {STAMP('end_ms')} AS stamp, end_ms AS ms FROM timed")
def srt_timestamp_roundtrip(spark, d):
    stamped = X.timed(spark, d).select("ord", M.ms_to_timestamp(F.col("end_ms")).alias("stamp"))
    return stamped.withColumn("ms", M.timestamp_to_ms(F.col("stamp")))


@query("timeline_shift", 'SELECT video_id, ord, start + "offset" AS start, "end" + "offset" AS "end", text FROM prim JOIN chunk USING (video_id)')
def timeline_shift(spark, d):
    return S.shift_timeline(X.primary(spark, d), X.chunks(spark, d)).select("video_id", "ord", "start", "end", "text")


@query("detection_shift", 'SELECT video_id, ord, frame_time + "offset" AS frame_time FROM det JOIN chunk USING (video_id)')
def detection_shift(spark, d):
    return screen.shift_detections(X.detections(spark, d), X.chunks(spark, d)).select("video_id", "ord", "frame_time")


def _sessions(gap: float) -> str:
    return f"""
m1 AS (SELECT *, max("end") OVER (PARTITION BY video_id ORDER BY start, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM speech),
m2 AS (SELECT *, sum(CASE WHEN start - reach <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY start, ord) AS session FROM m1),
merged AS (SELECT video_id, arg_min(ord, (start, ord)) AS ord, min(start) AS start, max("end") AS "end" FROM m2 GROUP BY video_id, session)
"""


@query("close_gap_merge", _sessions(0.5) + 'SELECT video_id, ord, start, "end" FROM merged')
def close_gap_merge(spark, d):
    return S.merge_close(X.speech(spark, d), 0.5)


@query("min_duration_filter", 'SELECT video_id, ord, start, "end" FROM speech WHERE "end" - start >= 5.0')
def min_duration_filter(spark, d):
    return S.at_least(X.speech(spark, d), 5.0)


@query("padded_ranges", _sessions(0.0) + """
SELECT video_id, ord, start, "end", CASE WHEN p IS NULL THEN greatest(0.0, start - 0.15) ELSE greatest(0.0, start - 0.15, (p + start) / 2) END AS clip_start,
       CASE WHEN n IS NULL THEN "end" + 0.15 ELSE least("end" + 0.15, ("end" + n) / 2) END AS clip_end
FROM (SELECT *, lag("end") OVER w AS p, lead(start) OVER w AS n FROM merged WINDOW w AS (PARTITION BY video_id ORDER BY start, ord))""")  # fmt: skip
def padded_ranges(spark, d):
    return S.padded_ranges(S.merge_close(X.speech(spark, d)))


BATCHES = _sessions(0.0) + """,
listed AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, ord) AS n FROM merged),
fold AS (
  SELECT video_id, ord, start, "end", n, CAST(0 AS BIGINT) AS batch, "end" - start AS used FROM listed WHERE n = 1
  UNION ALL
  SELECT l.video_id, l.ord, l.start, l."end", l.n,
         CASE WHEN f.used + (l."end" - l.start + 0.2::DOUBLE) > 40 THEN f.batch + 1 ELSE f.batch END,
         CASE WHEN f.used + (l."end" - l.start + 0.2::DOUBLE) > 40 THEN l."end" - l.start ELSE f.used + (l."end" - l.start + 0.2::DOUBLE) END
  FROM fold f JOIN listed l ON l.video_id = f.video_id AND l.n = f.n + 1)
"""


def _batched(spark, d):
    return S.speech_batches(S.merge_close(X.speech(spark, d)))


@query("speech_batches", BATCHES + 'SELECT video_id, ord, start, "end", batch FROM fold')
def speech_batches(spark, d):
    return _batched(spark, d)


MAPPING = BATCHES + """,
f1 AS (SELECT *, CAST(floor(("end" - start) * 16000) AS BIGINT) AS frames, row_number() OVER w AS k FROM fold WINDOW w AS (PARTITION BY video_id, batch ORDER BY start, ord)),
f2 AS (SELECT *, sum(frames) OVER w - frames + (k - 1) * 3200 AS pos, lag("end") OVER w AS was FROM f1 WINDOW w AS (PARTITION BY video_id, batch ORDER BY start, ord)),
mapping AS (
  SELECT video_id, batch, 2 * k - 2 AS entry, pos / 16000.0::DOUBLE AS batch_start, (pos + frames) / 16000.0::DOUBLE AS batch_end, start AS original_start, start + frames / 16000.0::DOUBLE AS original_end, true AS is_speech FROM f2
  UNION ALL SELECT video_id, batch, 2 * k - 3, (pos - 3200) / 16000.0::DOUBLE, pos / 16000.0::DOUBLE, was, was, false FROM f2 WHERE k > 1)
"""


@query("batch_mapping", MAPPING + "SELECT video_id, batch, CAST(entry AS BIGINT) AS entry, batch_start, batch_end, original_start, original_end, is_speech FROM mapping")
def batch_mapping(spark, d):
    return S.batch_mapping(_batched(spark, d)).withColumn("entry", F.col("entry").cast("long"))


TIMES = """,
times AS (SELECT video_id, batch, t, (t * 7 - 2)::DOUBLE AS time FROM (SELECT DISTINCT video_id, batch FROM mapping), (SELECT unnest(range(0, 8)) AS t)),
hits AS (SELECT x.video_id, x.batch, x.t, x.time, m.*, row_number() OVER (PARTITION BY x.video_id, x.batch, x.t ORDER BY m.entry) AS rn FROM times x JOIN mapping m ON x.video_id = m.video_id AND x.batch = m.batch AND x.time BETWEEN m.batch_start AND m.batch_end)
SELECT x.video_id, x.batch, CAST(x.t AS BIGINT) AS t, x.time,
       CASE WHEN h.entry IS NOT NULL THEN CASE WHEN h.batch_end - h.batch_start <= 0 THEN h.original_start ELSE h.original_start + (x.time - h.batch_start) / (h.batch_end - h.batch_start) * (h.original_end - h.original_start) END
            WHEN x.time < a.first_start THEN a.first_original ELSE a.last_end END AS time_original
FROM times x LEFT JOIN hits h ON h.rn = 1 AND h.video_id = x.video_id AND h.batch = x.batch AND h.t = x.t
JOIN (SELECT video_id, batch, arg_min(batch_start, entry) AS first_start, arg_min(original_start, entry) AS first_original, arg_max(original_end, entry) AS last_end FROM mapping GROUP BY 1, 2) a ON a.video_id = x.video_id AND a.batch = x.batch
"""


@query("batch_time_map", MAPPING + TIMES)
def batch_time_map(spark, d):
    mapping = S.batch_mapping(_batched(spark, d))
    times = mapping.select("video_id", "batch").distinct().withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))).withColumn("time", (F.col("t") * 7 - 2).cast("double"))
    return S.map_batch_time(times, mapping, "time").select("video_id", "batch", "t", "time", "time_original")


@query("coverage_check", """
SELECT video_id, duration, max(p."end") AS reach, coalesce(max(p."end") >= duration * 0.9, false) AS covered FROM chunk LEFT JOIN prim p USING (video_id) GROUP BY video_id, duration""")  # fmt: skip
def coverage_check(spark, d):
    return S.coverage(X.primary(spark, d), X.chunks(spark, d), keys=("video_id",)).select("video_id", "duration", "reach", "covered")


RUNS = """
g1 AS (SELECT *, lag(text, 1) OVER w AS t1, lag(text, 2) OVER w AS t2 FROM labelled WINDOW w AS (PARTITION BY video_id ORDER BY ord)),
g2 AS (SELECT *, coalesce(text <> t1, false) AS differs, coalesce(text = t1, false) AS same, coalesce(text = t2 AND text <> t1, false) AS swings FROM g1),
g3 AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER w AS run, sum(CASE WHEN swings THEN 0 ELSE 1 END) OVER w AS swing FROM g2 WINDOW w AS (PARTITION BY video_id ORDER BY ord)),
repeats AS (SELECT video_id, max(n) AS longest_consecutive FROM (SELECT video_id, run, count(*) AS n FROM g3 GROUP BY 1, 2) GROUP BY 1),
swings AS (SELECT video_id, CAST(coalesce(max(CASE WHEN n > 0 THEN n + 2 END), CASE WHEN bool_or(differs) THEN 2 END, 0) AS BIGINT) AS longest_alternating
  FROM (SELECT video_id, swing, count(*) FILTER (swings) AS n, bool_or(differs) AS differs FROM g3 GROUP BY 1, 2) GROUP BY 1)
"""


@query("consecutive_runs", RUNS + "SELECT video_id, longest_consecutive FROM repeats")
def consecutive_runs(spark, d):
    return diagnostics.consecutive_runs(X.labels(spark, d))


@query("alternating_runs", RUNS + "SELECT video_id, longest_alternating FROM swings")
def alternating_runs(spark, d):
    return diagnostics.alternating_runs(X.labels(spark, d))


METRICS = RUNS + """,
measured AS (
  SELECT c.video_id, count(l.ord) AS segment_count, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, CAST(sum(length(text)) AS BIGINT) AS total_chars, max(end_ms - start_ms) AS longest_ms,
         any_value(longest_consecutive) AS longest_consecutive_repeat, any_value(longest_alternating) AS longest_alternating_run
  FROM chunk c JOIN (SELECT video_id, ord, start_ms, end_ms, event_type AS text FROM timed) l USING (video_id) JOIN repeats USING (video_id) JOIN swings USING (video_id) GROUP BY c.video_id)
"""


@query("diagnostics_metrics", METRICS + "SELECT video_id, segment_count, speech_ms, total_chars, longest_ms, longest_consecutive_repeat, longest_alternating_run FROM measured")
def diagnostics_metrics(spark, d):
    m = diagnostics.metrics(X.labels(spark, d), X.chunks(spark, d))
    ms = lambda c: F.bround(F.col(c) * 1000, 0).cast("long")
    return m.select("video_id", "segment_count", ms("total_speech_seconds").alias("speech_ms"), "total_chars", ms("max_segment_duration").alias("longest_ms"), "longest_consecutive_repeat", "longest_alternating_run")


@query("diagnostics_verdict", METRICS + """
SELECT video_id, CASE WHEN longest_consecutive_repeat >= 5 OR longest_alternating_run >= 8 THEN 'abort'
  WHEN speech_ms / 600000.0 < 0.05 OR speech_ms / 600000.0 > 0.95 OR total_chars / (speech_ms / 60000.0) < 100 OR total_chars / (speech_ms / 60000.0) > 2000 OR longest_ms > 15000 THEN 'warning' ELSE 'ok' END AS verdict FROM measured""")  # fmt: skip
def diagnostics_verdict(spark, d):
    return diagnostics.verdict(diagnostics.metrics(X.labels(spark, d), X.chunks(spark, d))).select("video_id", "verdict")


PATTERN = r"regexp_full_match(b, '[!?.…\s\(\)\[\]\{\}]+') OR regexp_full_match(b, '[0-9\s]+') OR regexp_full_match(b, '[A-Za-z0-9\(\)\s''!?.~-]{1,15}') OR regexp_full_match(b, '[ㅋㅎㅠㅜ]+')"


@query("ocr_blocklist", f"SELECT video_id, ord, text FROM (SELECT *, {STRIP('text')} AS b FROM det) WHERE b <> '' AND lower(b) NOT IN ('scene caption view0', 'scene caption click1') AND NOT ({PATTERN})")
def ocr_blocklist(spark, d):
    return screen.drop_blocked(X.detections(spark, d), ("Scene caption View0", "scene caption click1")).select("video_id", "ord", "text")


REASON = f"""
judged AS (SELECT video_id, ord, CASE WHEN confidence < 0.84 THEN 'low_confidence' WHEN (y2 - y1) / 1080.0::DOUBLE < 0.02 THEN 'box_too_small' WHEN (y2 - y1) / 1080.0::DOUBLE > 0.05 THEN 'box_too_large'
  WHEN length(b) < 2 THEN 'text_too_short' WHEN {PATTERN} THEN 'pattern_match' END AS reason FROM (SELECT *, {STRIP('text')} AS b FROM shown))
"""


@query("ocr_reject_reason", REASON + "SELECT video_id, ord, reason FROM judged")
def ocr_reject_reason(spark, d):
    return X.shown(spark, d).select("video_id", "ord", screen.reject_reason(F.lit(1080), max_ratio=0.05).alias("reason"))


@query("ocr_filter_events", REASON + 'SELECT video_id, ord, start, "end", text FROM shown JOIN judged USING (video_id, ord) WHERE reason IS NULL')
def ocr_filter_events(spark, d):
    return screen.filter_events(X.shown(spark, d), 1080, max_ratio=0.05).select("video_id", "ord", "start", "end", "text")


@query("ocr_drop_summary", REASON + "SELECT video_id, coalesce(reason, 'kept') AS reason, count(*) AS n FROM judged GROUP BY ALL")
def ocr_drop_summary(spark, d):
    return screen.drop_summary(X.shown(spark, d), F.lit(1080), max_ratio=0.05)


@query("repeated_texts_exact", "SELECT video_id, text, count(*) AS n FROM shown GROUP BY ALL HAVING count(*) > 2")
def repeated_texts_exact(spark, d):
    return screen.repeated_texts(X.shown(spark, d), 2)


FOLD = "regexp_replace(lower(text), '\\s+', '', 'g')"


@query("repeated_texts_normalized", f"SELECT video_id, {FOLD} AS text, count(*) AS n FROM shown GROUP BY ALL HAVING count(*) > 2")
def repeated_texts_normalized(spark, d):
    return screen.repeated_texts(X.shown(spark, d), 2, folded=True)


@query("repeated_texts_dropped", "SELECT video_id, ord, text FROM (SELECT *, count(*) OVER (PARTITION BY video_id, text) AS n FROM shown) WHERE n <= 2")
def repeated_texts_dropped(spark, d):
    e = X.shown(spark, d)
    return screen.drop_repeated(e, e, 2).select("video_id", "ord", "text")


@query("pad_timestamps", 'SELECT video_id, ord, greatest(0.0, start - 0.25) AS start, "end" + 0.25 AS "end" FROM shown')
def pad_timestamps(spark, d):
    return screen.pad_events(X.shown(spark, d)).select("video_id", "ord", "start", "end")


@query("clip_to_vad", f"""
SELECT video_id, ord, greatest(start, low) AS start, least("end", high) AS "end", text FROM (
  SELECT p.video_id, p.ord, p.start, p."end", p.text, min(v.start) AS low, max(v."end") AS high FROM prim p JOIN speech v ON p.video_id = v.video_id AND p.start < v."end" AND v.start < p."end" GROUP BY ALL)
WHERE least("end", high) - greatest(start, low) >= 0.1""")  # fmt: skip
def clip_to_vad(spark, d):
    cut = S.clip_to_speech(X.primary_spans(spark, d), X.speech(spark, d))
    return X.lent(spark, d, cut).select("video_id", "ord", "start", "end", "text")


@query("gap_fill", f"""
SELECT video_id, ord, start, "end", '[SIGN] ' || text AS text FROM shown s WHERE "end" - start >= 0.5 AND NOT EXISTS (SELECT 1 FROM prim p WHERE p.video_id = s.video_id AND {RATIO('p', 's')} >= 0.3)""")  # fmt: skip
def gap_fill(spark, d):
    return fusion.gap_fills(X.primary(spark, d), X.shown(spark, d), prefix="[SIGN] ").select("video_id", "ord", "start", "end", "text")


@query("ocr_only_subtitles", 'SELECT video_id, ord, start, "end", text FROM shown WHERE "end" - start >= 0.5')
def ocr_only_subtitles(spark, d):
    return fusion.shown_cues(X.shown(spark, d)).select("video_id", "ord", "start", "end", "text")


@query("ocr_overlap_candidates", f'SELECT p.video_id, p.ord AS a_ord, s.ord AS b_ord, {RATIO("p", "s")} AS ratio FROM prim p JOIN shown s ON p.video_id = s.video_id AND {RATIO("p", "s")} >= 0.3')
def ocr_overlap_candidates(spark, d):
    return fusion.candidate_pairs(X.primary(spark, d), X.shown(spark, d), 0.3).select("a.video_id", F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), "ratio")


@query("interval_overlap_pairs", f'SELECT p.video_id, p.ord AS a_ord, v.ord AS b_ord, {OVER("p", "v")} AS shared FROM prim p JOIN speech v ON p.video_id = v.video_id AND p.start < v."end" AND v.start < p."end"')
def interval_overlap_pairs(spark, d):
    return interval_pairs(X.primary(spark, d), X.speech(spark, d)).select("a.video_id", F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), M.overlap(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end")).alias("shared"))


BOXES = "FROM det a JOIN det b ON a.video_id = b.video_id AND a.frame_time = b.frame_time AND a.ord < b.ord"
W, H = "(least(a.x2, b.x2) - greatest(a.x1, b.x1))", "(least(a.y2, b.y2) - greatest(a.y1, b.y1))"


@query("box_iou_pairs", f"SELECT a.ord AS a_ord, b.ord AS b_ord, CASE WHEN {W} > 0 AND {H} > 0 THEN {W} * {H} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {W} * {H})::DOUBLE ELSE 0.0::DOUBLE END AS iou {BOXES}")
def box_iou_pairs(spark, d):
    side = lambda n: X.detections(spark, d).select("video_id", "frame_time", F.col("ord").alias(f"{n}_ord"), F.col("box").alias(n))
    pairs = side("a").join(side("b"), ["video_id", "frame_time"]).filter("a_ord < b_ord")
    return pairs.select("a_ord", "b_ord", M.box_iou(F.col("a"), F.col("b")).alias("iou"))


ADJACENT = f"""(least(a.y2 - a.y1, b.y2 - b.y1) > 0 AND ({H} >= 0.3 * least(a.y2 - a.y1, b.y2 - b.y1) AND -{W} <= least(a.y2 - a.y1, b.y2 - b.y1)
  OR {W} >= 0.5 * least(a.x2 - a.x1, b.x2 - b.x1) AND -{H} <= least(a.y2 - a.y1, b.y2 - b.y1)))"""


@query("box_adjacency", f"SELECT a.video_id, a.ord AS a_ord, b.ord AS b_ord {BOXES} AND {ADJACENT}")
def box_adjacency(spark, d):
    return screen.adjacent_pairs(X.detections(spark, d)).select("video_id", "a_ord", "b_ord")


@query("frame_merge", f"""
adj AS (SELECT a.ord AS x, b.ord AS y {BOXES.replace('a.ord < b.ord', 'a.ord <> b.ord')} AND {ADJACENT}),
anchor AS (SELECT video_id, frame_time, arg_max(ord, (length(text), -ord)) AS ord FROM det GROUP BY 1, 2),
reached AS (SELECT video_id, frame_time, ord FROM anchor UNION SELECT r.video_id, r.frame_time, y FROM reached r JOIN adj ON r.ord = adj.x)
SELECT video_id, frame_time, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS merged FROM reached JOIN det USING (video_id, frame_time, ord) GROUP BY 1, 2""")  # fmt: skip
def frame_merge(spark, d):
    m = screen.merge_frames(X.detections(spark, d))
    return m.select("video_id", "frame_time", *[F.col(f"box.{c}").cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")], "merged")


@query("frame_merge_text")
def frame_merge_text(spark, d):
    return screen.merge_frames(X.detections(spark, d)).select("video_id", "frame_time", "text", "confidence")


@query("detection_groups")
def detection_groups(spark, d):
    return screen.group_detections(X.detections(spark, d)).select("video_id", "ord", "start", "end", "text", "frame_count", "confidence")


@query("text_similarity")
def text_similarity(spark, d):
    pairs = fusion.candidate_pairs(X.primary(spark, d), X.shown(spark, d), 0.3)
    return pairs.select("a.video_id", F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), T.label_free_similarity(F.col("a.text"), F.col("b.text")).alias("similarity"))


@query("whisper_ocr_merge")
def whisper_ocr_merge(spark, d):
    return fusion.fuse(X.primary(spark, d), X.shown(spark, d))


@query("ensemble_alignment", f"""
SELECT s.video_id, s.ord AS s_ord, count(*) AS cues FROM sec s JOIN prim p ON s.video_id = p.video_id AND {RATIO('s', 'p')} >= 0.4 GROUP BY 1, 2""")  # fmt: skip
def ensemble_alignment(spark, d):
    met = interval_pairs(X.secondary(spark, d), X.primary(spark, d)).filter(M.overlap_ratio(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end")) >= 0.4)
    return met.groupBy(F.col("a.video_id").alias("video_id"), F.col("a.ord").alias("s_ord")).agg(F.count(F.lit(1)).alias("cues"))


@query("text_split")
def text_split(spark, d):
    return ensemble.align(X.primary(spark, d), X.secondary(spark, d))


@query("ensemble_merge")
def ensemble_merge(spark, d):
    return ensemble.reconcile(X.primary(spark, d), X.secondary(spark, d))


@query("junk_cues", f'SELECT video_id, ord FROM labelled WHERE NOT ("end" - start < 0.5 AND length({STRIP("text")}) < 5)')
def junk_cues(spark, d):
    return X.labels(spark, d).filter(~ensemble.is_junk(0.5, 5)).select("video_id", "ord")


@query("strip_prefix", """
SELECT ord, regexp_replace(regexp_replace(t, '^\\s*[\\(\\[]\\s*[^\\)\\]]{1,20}\\s*[\\)\\]]\\s*', ''), '^\\s*[가-힣A-Za-z]{1,15}\\s*[*#:·]\\s*', '') AS text FROM (SELECT ord, CASE ord % 3 WHEN 0 THEN '[SIGN] ' WHEN 1 THEN 'Minami: ' ELSE '' END || text AS t FROM shown)""")  # fmt: skip
def strip_prefix(spark, d):
    t = F.concat(F.when(F.col("ord") % 3 == 0, "[SIGN] ").when(F.col("ord") % 3 == 1, "Minami: ").otherwise(""), "text")
    return X.shown(spark, d).select("ord", T.strip_label(t).alias("text"))


@query("frame_sampling", "SELECT video_id, ord, frame_no / 30.0::DOUBLE AS frame_time FROM (SELECT video_id, ord, ord % 1000 AS frame_no FROM timed) WHERE frame_no % 12 = 0")
def frame_sampling(spark, d):
    frames = X.timed(spark, d).select("video_id", "ord", (F.col("ord") % 1000).alias("frame_no"))
    return screen.sampled(frames, F.lit(30.0), 2.5).select("video_id", "ord", "frame_time")


# --- codecs: rendered from the derived tables and read back -------------------------------------


@query("codec_srt", f'SELECT video_id, {MS("start")} AS start_ms, {MS(chr(34) + "end" + chr(34))} AS end_ms, {STRIP("text")} AS text FROM prim')
def codec_srt(spark, d):
    back = codecs.parse_srt(sinks.render_srt(X.primary(spark, d)), "srt")
    return back.select("video_id", F.bround(F.col("start") * 1000).cast("long").alias("start_ms"), F.bround(F.col("end") * 1000).cast("long").alias("end_ms"), "text")


@query("codec_speech_log", 'SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY ord) - 1 AS BIGINT) AS ord, start, "end" FROM speech')
def codec_speech_log(spark, d):
    line = F.format_string("VAD segment %d: start = %.3f, end = %.3f", "ord", "start", "end")
    logs = X.speech(spark, d).groupBy("video_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n"), F.lit("\nFinal speech segments after filtering: 9\n")).alias("value"))
    return codecs.parse_speech_log(logs).select("video_id", "ord", "start", "end")


def _json(rows: DataFrame, root: str, fields) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("s")))), lambda x: x["s"])
    return rows.groupBy("video_id").agg(F.to_json(F.struct(listed.alias(root))).alias("value"))


NUMBERED = f'SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY ord) - 1 AS BIGINT) AS ord, start, "end", {STRIP("text")} AS text FROM prim'


@query("codec_offsets_json", f"SELECT * FROM ({NUMBERED}) WHERE text <> ''")
def codec_offsets_json(spark, d):
    ms = lambda c: F.bround(F.col(c) * 1000).cast("long")
    rows = _json(X.primary(spark, d), "transcription", [F.struct(ms("start").alias("from"), ms("end").alias("to")).alias("offsets"), "text"])
    return codecs.parse_offsets_json(rows)


@query("codec_seconds_json", f"SELECT * FROM ({NUMBERED}) WHERE text <> ''")
def codec_seconds_json(spark, d):
    return codecs.parse_seconds_json(_json(X.primary(spark, d), "segments", ["start", "end", "text"]))


@query("codec_events_json", "SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY ord) - 1 AS BIGINT) AS ord, start, \"end\", x1, y2, text, confidence FROM shown")
def codec_events_json(spark, d):
    rows = sinks.events_json(X.shown(spark, d), "filtered", 1080, keys=("video_id",)).withColumnRenamed("json", "value")
    return codecs.parse_events_json(rows).select("video_id", "ord", "start", "end", F.col("box.x1").cast("long").alias("x1"), F.col("box.y2").cast("long").alias("y2"), "text", "confidence")


@query("codec_manifest", 'SELECT \'video_\' || video_id || \'.mp4\' AS filename, "offset" FROM chunk')
def codec_manifest(spark, d):
    rows = X.chunks(spark, d).select(F.concat(F.lit("out/video_"), "video_id", F.lit(".mp4")).alias("filename"), F.col("offset").cast("string").alias("start"), F.lit("0").alias("end"))
    return codecs.parse_manifest(rows)


@query("transcription_json_stats", "SELECT video_id, count(*) AS segment_count FROM prim GROUP BY 1")
def transcription_json_stats(spark, d):
    j = sinks.transcription_json(X.primary(spark, d), "large", keys=("video_id",))
    return j.select("video_id", F.get_json_object("json", "$.segment_count").cast("long").alias("segment_count"))


# --- completions with deterministic stand-ins ------------------------------------------------


def _drop_even(prompt: str) -> str:
    import re

    return '```json\n{"drop": [' + ", ".join(n for n in re.findall(r"(?m)^\[(\d+)\] ", prompt) if int(n) % 2 == 0) + "]}\n```"


def _echo(prompt: str) -> str:
    import re

    marks = re.findall(r"<<<(?:SRT|SEG)_\d+>>>", prompt.partition("\n\n")[2])
    return "\n".join(f"{m}\nanswer {i}" for i, m in enumerate(dict.fromkeys(m for m in marks if "NNN" not in m)))


@query("llm_filter_stub", """
n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ord) - 1 AS k, count(*) OVER (PARTITION BY video_id) AS total FROM shown) SELECT video_id, ord, text FROM n WHERE total < 5 OR k % 100 % 2 = 1""")  # fmt: skip
def llm_filter_stub(spark, d):
    return completion.clutter_filter(X.shown(spark, d), _drop_even).select("video_id", "ord", "text")


@query("adjudicate_stub")
def adjudicate_stub(spark, d):
    cues = ensemble.reconcile(X.primary(spark, d), X.secondary(spark, d))
    resolved = completion.adjudicate(cues.filter("decision = 'pending'"), _echo)
    return ensemble.non_empty(ensemble.apply_resolutions(cues, resolved)).select("video_id", "ord", "start", "end", "text", "decision")


@query("translate_stub", 'SELECT video_id, ord, start, "end", \'answer \' || ((row_number() OVER (PARTITION BY video_id ORDER BY ord) - 1) % 100) AS text FROM prim')
def translate_stub(spark, d):
    return completion.translate(X.primary(spark, d).withColumn("source_hint", F.lit(None).cast("string")), _echo)


@query("process_whisper", ASSIGN + 'SELECT r.video_id, r.ord, start + "offset" AS start, "end" + "offset" AS "end", text FROM ranked r JOIN chunk USING (video_id)')
def process_whisper(spark, d):
    asr = X.filled(spark, d, X.primary_spans(spark, d))
    return pipeline.spoken_cues(X.speech(spark, d), asr, X.chunks(spark, d), texts=lambda rows: X.lent(spark, d, rows))


#: The profile for screen text alone: no limit on repeats, lower confidence.
SCREEN_ONLY = config.from_mapping({"ocr": {"filter": {"max_text_repeats": 0, "min_confidence": 0.6}}})


@query("process_ocr")
def process_ocr(spark, d):
    return pipeline.process(None, pipeline.screen_events(X.detections(spark, d), F.lit(1080), SCREEN_ONLY), SCREEN_ONLY)


@query("process_ensemble")
def process_ensemble(spark, d):
    return pipeline.ensemble_cues(X.primary(spark, d), X.secondary(spark, d), X.speech(spark, d), complete=_echo)


@query("process_merged")
def process_merged(spark, d):
    events = pipeline.screen_events(X.detections(spark, d), F.lit(1080), SCREEN_ONLY)
    asr = X.filled(spark, d, X.primary_spans(spark, d))
    return pipeline.process(S.speech_cues(X.speech(spark, d), asr, texts=lambda rows: X.lent(spark, d, rows)), events, SCREEN_ONLY)
