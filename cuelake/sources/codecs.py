"""Readers of timed text: chunk manifests, logs, transcript and event JSON, subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.timing import timestamp_to_ms


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and value of whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """filename (without folders) and offset of a chunk manifest; rows with fewer than two columns are passed over, and none at all is an error."""
    rows = spark.read.schema("filename string, start string, end string").csv(path)
    out = parse_manifest(rows)
    if out.isEmpty():
        raise ValueError(f"{path} lists no chunks")
    return out


def parse_manifest(rows: DataFrame) -> DataFrame:
    kept = rows.filter(F.col("filename").isNotNull() & F.col("start").isNotNull())
    return kept.select(F.regexp_extract(F.trim("filename"), r"[^/]+$", 0).alias("filename"), F.col("start").cast("double").alias("offset"))


# The lines of a speech activity log.
LOG_SEGMENT = r"VAD segment\s+(\d+):\s+start\s*=\s*([\d.]+),\s*end\s*=\s*([\d.]+)"
LOG_DONE = r"Final speech segments after filtering:\s*\d+"


def parse_speech_log(logs: DataFrame, column: str = "value") -> DataFrame:
    """Columns of logs but `column`, with ord, index, start, end per segment in textual order; a log with neither segments nor its last line is an error."""
    log = F.col(column)
    each = F.arrays_zip(*[F.regexp_extract_all(log, F.lit(LOG_SEGMENT), F.lit(k)).alias(n) for k, n in ((1, "index"), (2, "start"), (3, "end"))])
    checked = F.when((F.size(each) == 0) & ~log.rlike(LOG_DONE), F.raise_error(F.lit("the log has no segments and no end")).cast("array<struct<index:string,start:string,end:string>>")).otherwise(each)
    others = [c for c in logs.columns if c != column]
    return logs.select(*others, F.posexplode(checked).alias("ord", "s")).select(*others, F.col("ord").cast("long").alias("ord"), F.col("s.index").cast("int").alias("index"), F.col("s.start").cast("double").alias("start"), F.col("s.end").cast("double").alias("end"))


def _must(value: Column, message: str, kind: str) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit(message)).cast(kind)).otherwise(value)


def parse_offsets_json(rows: DataFrame, column: str = "value") -> DataFrame:
    """ord, start, end, text of {"transcription": [{"offsets": {"from": ms, "to": ms}, "text"}]}.

    A null or absent list has no rows; bad JSON and missing offsets are errors; empty texts are dropped, null ones count as empty.
    """
    kind = "transcription array<struct<offsets:struct<from:bigint,to:bigint>,text:string>>, _bad string"
    data = F.from_json(F.col(column), kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    others = [c for c in rows.columns if c != column]
    parsed = rows.select(*others, data.alias("d")).select(*others, F.when(F.col("d._bad").isNotNull(), F.raise_error(F.lit("bad JSON")).cast("array<struct<offsets:struct<from:bigint,to:bigint>,text:string>>")).otherwise(F.col("d.transcription")).alias("all"))
    each = parsed.select(*others, F.posexplode("all").alias("ord", "s"))
    seconds = lambda k: _must(F.col("s.offsets")[k], "a segment has no offsets", "bigint") / 1000.0
    out = each.select(*others, F.col("ord").cast("long").alias("ord"), seconds("from").alias("start"), seconds("to").alias("end"), strip(F.coalesce("s.text", F.lit(""))).alias("text"))
    return out.filter("text <> '' AND start IS NOT NULL AND end IS NOT NULL")


def parse_seconds_json(rows: DataFrame, column: str = "value") -> DataFrame:
    """ord, start, end, text of {"segments": [{"start", "end", "text"}]} in seconds; empty texts go first, then times must be numbers."""
    data = F.from_json(F.col(column), "segments array<struct<start:string,end:string,text:string>>")
    others = [c for c in rows.columns if c != column]
    each = rows.select(*others, F.posexplode(data["segments"]).alias("ord", "s"))
    kept = each.withColumn("text", strip(F.coalesce("s.text", F.lit("")))).filter("text <> ''")
    number = lambda k: _must(F.expr(f"try_cast(s.{k} AS DOUBLE)"), "a time is not a number", "double")
    return kept.select(*others, F.col("ord").cast("long").alias("ord"), number("start").alias("start"), number("end").alias("end"), "text")


def parse_stored_transcript(rows: DataFrame, column: str = "value") -> DataFrame:
    """ord, start, end, text of a transcript that transcription_json wrote: texts come back as they are, empty ones too."""
    others = [c for c in rows.columns if c != column]
    each = rows.select(*others, F.posexplode(F.from_json(F.col(column), "segments array<struct<start:double,end:double,text:string>>")["segments"]).alias("ord", "s"))
    return each.select(*others, F.col("ord").cast("long").alias("ord"), "s.start", "s.end", "s.text")


EVENTS = "frame_height bigint, events array<struct<start:double,end:double,box:array<int>,text:string,confidence:double,frame_count:bigint>>"


def parse_events_json(rows: DataFrame, column: str = "value") -> DataFrame:
    """ord, start, end, box, text, confidence, frame_count of on-screen events."""
    others = [c for c in rows.columns if c != column]
    each = rows.select(*others, F.posexplode(F.from_json(F.col(column), EVENTS)["events"]).alias("ord", "e"))
    box = F.struct(*[F.col("e.box")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])
    return each.select(*others, F.col("ord").cast("long").alias("ord"), "e.start", "e.end", box.alias("box"), "e.text", "e.confidence", "e.frame_count")


def parse_srt(rows: DataFrame, column: str = "value") -> DataFrame:
    """ord, start, end, text of subtitle files: blocks parted by blank lines, whose second line holds the times.

    The number line is not looked at; blocks of fewer than two lines or without an arrow are passed over; malformed times are errors.
    """
    others = [c for c in rows.columns if c != column]
    body = strip(F.regexp_replace(F.col(column), r"\r\n?", "\n"))
    blocks = rows.select(*others, F.posexplode(F.split(body, r"\n\s*\n")).alias("at", "block")).withColumn("lines", F.split(strip(F.col("block")), "\n"))
    good = blocks.filter((F.size("lines") >= 2) & F.contains(F.get("lines", F.lit(1)), F.lit(" --> ")))
    times = F.split(F.get("lines", F.lit(1)), " --> ")
    text = strip(F.array_join(F.slice("lines", F.lit(3), F.greatest(F.size("lines"), F.lit(3))), "\n"))
    return good.select(*others, F.col("at").cast("long").alias("ord"), (timestamp_to_ms(times[0]) / 1000.0).alias("start"), (timestamp_to_ms(times[1]) / 1000.0).alias("end"), text.alias("text"))
