"""Signs of transcription loops and of lost speech, per chunk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

KEYS = ("video_id",)
# Limits of the verdict.
MAX_REPEAT, MAX_ALTERNATION, LOW_COVERAGE, HIGH_COVERAGE, LOW_DENSITY, HIGH_DENSITY, LONG_SEGMENT = 5, 8, 0.05, 0.95, 100.0, 2000.0, 15.0


def _runs(rows: DataFrame, same, keys: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("ord")
    return rows.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(order))


def consecutive_runs(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, longest_consecutive: the most neighbours with equal texts."""
    order = Window.partitionBy(*keys).orderBy("ord")
    marked = _runs(rows.withColumn("same", F.coalesce(F.col("text") == F.lag("text").over(order), F.lit(False))), F.col("same"), keys)
    return marked.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("longest_consecutive"))


def alternating_runs(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, longest_alternating: the longest A, B, A, B ... of two different texts; 0 if no neighbours differ."""
    order = Window.partitionBy(*keys).orderBy("ord")
    lagged = rows.withColumn("t1", F.lag("text", 1).over(order)).withColumn("t2", F.lag("text", 2).over(order)).withColumn("differs", F.coalesce(F.col("text") != F.col("t1"), F.lit(False)))
    # A run of rows that equal the row two before alternates if its neighbours differ.
    marked = _runs(lagged.withColumn("same", F.coalesce((F.col("text") == F.col("t2")) & F.col("differs"), F.lit(False))), F.col("same"), keys)
    longest = F.max(F.when(F.col("n") > 0, F.col("n") + 2))
    per_run = marked.groupBy(*keys, "run").agg(F.count_if("same").alias("n"), F.bool_or("differs").alias("differs"))
    return per_run.groupBy(*keys).agg(F.coalesce(longest, F.when(F.bool_or("differs"), 2), F.lit(0)).cast("long").alias("longest_alternating"))


def metrics(segments: DataFrame, chunks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per chunk (keys, duration), those without segments included: counts, coverage, density and longest runs."""
    length = F.col("end") - F.col("start")
    sums = segments.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("speech"), F.sum(F.length(strip(F.col("text"))).cast("long")).alias("chars"), F.max(length).alias("longest"))
    rows = chunks.select(*keys, "duration").join(sums, list(keys), "left").join(consecutive_runs(segments, keys), list(keys), "left").join(alternating_runs(segments, keys), list(keys), "left")
    speech, chars = F.coalesce("speech", F.lit(0.0)), F.coalesce("chars", F.lit(0))
    return rows.select(
        *keys, F.coalesce("n", F.lit(0)).cast("long").alias("segment_count"), F.col("duration").alias("chunk_duration"),
        F.bround(speech, 3).alias("total_speech_seconds"),
        F.bround(F.when(F.col("duration") > 0, speech / F.col("duration")).otherwise(0.0), 4).alias("coverage_ratio"),
        chars.cast("long").alias("total_chars"),
        F.bround(F.when(speech > 0, chars / (speech / 60)).otherwise(0.0), 1).alias("chars_per_minute"),
        F.bround(F.coalesce("longest", F.lit(0.0)), 3).alias("max_segment_duration"),
        F.coalesce("longest_consecutive", F.lit(0)).cast("long").alias("longest_consecutive_repeat"), F.coalesce("longest_alternating", F.lit(0)).cast("long").alias("longest_alternating_run"),
    )


def verdict(measured: DataFrame) -> DataFrame:
    """metrics with verdict (ok, warning, abort), reason and warnings."""
    m = F.col
    repeat, swing = m("longest_consecutive_repeat"), m("longest_alternating_run")
    empty, loop = m("segment_count") == 0, (repeat >= MAX_REPEAT) | (swing >= MAX_ALTERNATION)
    percent = F.concat(F.format_string("%.1f", m("coverage_ratio") * 100), F.lit("%"))
    found = F.array_compact(F.array(
        F.when(m("coverage_ratio") < LOW_COVERAGE, F.concat(F.lit("coverage is low: "), percent)),
        F.when(m("coverage_ratio") > HIGH_COVERAGE, F.concat(F.lit("coverage is high: "), percent)),
        F.when(m("chars_per_minute") < LOW_DENSITY, F.lit("few characters per minute")),
        F.when(m("chars_per_minute") > HIGH_DENSITY, F.lit("many characters per minute")),
        F.when(m("max_segment_duration") > LONG_SEGMENT, F.lit("a segment is long")),
    ))
    warnings = F.when(empty, F.array(F.lit("no transcript for this chunk"))).when(loop, F.array().cast("array<string>")).otherwise(found)
    reason = F.when(empty, "no segments").when(repeat >= MAX_REPEAT, F.concat(F.lit("loop: one text repeated "), repeat.cast("string"), F.lit(" times"))).when(loop, F.concat(F.lit("loop: two texts alternate over "), swing.cast("string")))
    return measured.withColumn("warnings", warnings).withColumn("reason", reason).withColumn("verdict", F.when(empty, "warning").when(loop, "abort").when(F.size("warnings") > 0, "warning").otherwise("ok"))
