"""Timed text derived from the event and document tables with integer arithmetic, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import is_filled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, ord, event_type, start_ms, end_ms, start, end, value of every event."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value", micros.alias("us"))
    start = (F.col("event_id") % 1000) * 1200 + F.col("us") % 900
    rows = rows.select(F.expr("event_id div 1000").alias("video_id"), F.col("event_id").alias("ord"), "event_type", start.alias("start_ms"), "value")
    rows = rows.withColumn("end_ms", F.col("start_ms") + 200 + F.floor(F.col("value") * 40).cast("long"))
    return rows.select("video_id", "ord", "event_type", "start_ms", "end_ms", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"))


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(spark, sf_dir).filter("event_type = 'view'").select("video_id", "ord", "start", "end")


def texts(spark: SparkSession, sf_dir: str, event_type: str, offset: str) -> DataFrame:
    """Events of a type with the whole text of a document; events after one another share one, and all ids are dealt in turn."""
    return lent(spark, sf_dir, spans(spark, sf_dir, event_type, offset)).select("video_id", "ord", "start", "end", "text")


def spans(spark: SparkSession, sf_dir: str, event_type: str, offset: str) -> DataFrame:
    """texts with text_id in place of the text, for plans that join it last."""
    ids = (table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0) + 1
    rows = timed(spark, sf_dir).filter(F.col("event_type") == event_type).withColumn("text_id", F.expr(f"(ord div 4 + {offset}) % {ids}"))
    return rows.select("video_id", "ord", "start", "end", "text_id")


def lent(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """rows with the text of their text_id in its place; those without a document go."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    return rows.join(docs, "text_id").drop("text_id")


def primary_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir, "click", "0")


def filled(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """rows whose text_id has a document, with filled: whether its text is more than white space."""
    return rows.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), is_filled(F.col("text")).alias("filled")), "text_id")


def primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "click", "0")


def secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "signup", "1 + ord % 2")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("ord")
    x1, y1 = e * 37 % 300, e * 53 % 120
    box = F.struct(x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), (x1 + 40 + e * 7 % 200).cast("int").alias("x2"), (y1 + 20 + e * 11 % 40).cast("int").alias("y2"))
    return timed(spark, sf_dir).select("video_id", "ord", (F.expr("ord % 1000 div 4") * 0.5).cast("double").alias("frame_time"), box.alias("box"), F.concat(F.lit("scene caption "), "event_type", (e % 3).cast("string")).alias("text"), F.lit(0.0).alias("angle"), ((50 + e % 50) / 100.0).alias("confidence"))


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-screen events with box, frame_count and confidence."""
    e = F.col("ord")
    x1, y1 = e * 37 % 300, e * 53 % 120
    box = F.struct(x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), (x1 + 40 + e * 7 % 200).cast("int").alias("x2"), (y1 + 20 + e * 11 % 40).cast("int").alias("y2"))
    return texts(spark, sf_dir, "purchase", "1 + ord % 4").withColumns({"box": box, "frame_count": e % 9 + 1, "confidence": (50 + e % 50) / 100.0})


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its type as text: few texts, so that runs occur. Ordered by time."""
    rows = timed(spark, sf_dir)
    return rows.select("video_id", (F.col("start_ms") * 1_000_000 + F.col("ord") % 1000).alias("ord"), "start", "end", F.col("event_type").alias("text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(spark, sf_dir).select("video_id").distinct().withColumns({"offset": F.col("video_id") * 600.0, "duration": F.lit(600.0)})


#: The same in DuckDB.
SQL = """
timed AS (
  SELECT event_id // 1000 AS video_id, event_id AS ord, event_type,
         (event_id % 1000) * 1200 + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) % 900 AS start_ms,
         (event_id % 1000) * 1200 + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) % 900 + 200 + CAST(floor(value * 40) AS BIGINT) AS end_ms,
         start_ms / 1000.0::DOUBLE AS start, end_ms / 1000.0::DOUBLE AS "end"
  FROM events),
lent AS (SELECT doc_id AS text_id, replace(text, chr(10), ' ') AS text, (SELECT max(doc_id) + 1 FROM documents) AS ids FROM documents),
speech AS (SELECT video_id, ord, start, "end" FROM timed WHERE event_type = 'view'),
prim AS (SELECT video_id, ord, start, "end", text FROM timed JOIN lent ON text_id = (ord // 4) % ids WHERE event_type = 'click'),
sec AS (SELECT video_id, ord, start, "end", text FROM timed JOIN lent ON text_id = (ord // 4 + 1 + ord % 2) % ids WHERE event_type = 'signup'),
boxed AS (
  SELECT *, ord * 37 % 300 AS x1, ord * 53 % 120 AS y1, ord * 37 % 300 + 40 + ord * 7 % 200 AS x2, ord * 53 % 120 + 20 + ord * 11 % 40 AS y2 FROM timed),
det AS (SELECT video_id, ord, (ord % 1000 // 4) * 0.5::DOUBLE AS frame_time, x1, y1, x2, y2, 'scene caption ' || event_type || (ord % 3) AS text, (50 + ord % 50) / 100.0::DOUBLE AS confidence FROM boxed),
shown AS (
  SELECT video_id, ord, start, "end", text, x1, y1, x2, y2, (50 + ord % 50) / 100.0::DOUBLE AS confidence
  FROM boxed JOIN lent ON text_id = (ord // 4 + 1 + ord % 4) % ids WHERE event_type = 'purchase'),
labelled AS (SELECT video_id, start_ms * 1000000 + ord % 1000 AS ord, start, "end", event_type AS text FROM timed),
chunk AS (SELECT DISTINCT video_id, video_id * 600.0::DOUBLE AS "offset", 600.0::DOUBLE AS duration FROM timed)
"""
