"""Writers of timed text. Rendering gives one row per document; write_documents stores one file per row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timing import seconds_to_timestamp

KEYS = ("video_id",)


def render_srt(cues: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys and srt: numbered blocks in order of ord; nothing is sorted or mended by time. Documents are joined within the JVM."""
    block = F.concat(seconds_to_timestamp(F.col("start")), F.lit(" --> "), seconds_to_timestamp(F.col("end")), F.lit("\n"), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("ord", block.alias("block"))))
    numbered = F.transform(listed, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["block"]))
    return cues.groupBy(*keys).agg(F.concat(F.array_join(numbered, "\n\n"), F.lit("\n")).alias("srt"))


def with_empty(rendered: DataFrame, documents: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """rendered, and a lone line feed for documents without cues."""
    return documents.select(*keys).join(rendered, list(keys), "left").withColumn("srt", F.coalesce("srt", F.lit("\n")))


def transcription_json(segments: DataFrame, model: str, source: str = "whisper", keys: Sequence[str] = (*KEYS, "chunk")) -> DataFrame:
    """keys and json: {source, model, chunk, segment_count, segments}."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "start", "end", "text"))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    grouped = segments.groupBy(*keys).agg(listed.alias("segments"))
    body = F.struct(F.lit(source).alias("source"), F.lit(model).alias("model"), F.col(keys[-1]).alias("chunk"), F.size("segments").alias("segment_count"), "segments")
    return grouped.select(*keys, F.to_json(body, {"pretty": "true"}).alias("json"))


def events_json(events: DataFrame, stage: str, frame_height: int, keys: Sequence[str] = (*KEYS, "chunk")) -> DataFrame:
    """keys and json: {source, stage, chunk, frame_height, event_count, events}."""
    box = F.array("box.x1", "box.y1", "box.x2", "box.y2").alias("box")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "start", "end", box, "text", "confidence", "frame_count"))), lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "box", "text", "confidence", "frame_count")]))
    grouped = events.groupBy(*keys).agg(listed.alias("events"))
    body = F.struct(F.lit("ocr").alias("source"), F.lit(stage).alias("stage"), F.col(keys[-1]).alias("chunk"), F.lit(frame_height).alias("frame_height"), F.size("events").alias("event_count"), "events")
    return grouped.select(*keys, F.to_json(body, {"pretty": "true"}).alias("json"))


def raw_batches_json(batches: DataFrame, model: str, keys: Sequence[str] = (*KEYS, "chunk")) -> DataFrame:
    """keys and json: {source, model, chunk, batch_count, batches} of raw answers (columns batch, answer)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("batch", "answer"))), lambda x: x["answer"])
    grouped = batches.groupBy(*keys).agg(listed.alias("batches"))
    body = F.struct(F.lit("whisper").alias("source"), F.lit(model).alias("model"), F.col(keys[-1]).alias("chunk"), F.size("batches").alias("batch_count"), "batches")
    return grouped.select(*keys, F.to_json(body, {"pretty": "true"}).alias("json"))


def report_json(judged: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys and json of a diagnostics row."""
    return judged.select(*keys, F.to_json(F.struct("verdict", "reason", "warnings", F.struct(*[c for c in judged.columns if c not in (*keys, "verdict", "reason", "warnings")]).alias("metrics")), {"pretty": "true"}).alias("json"))


def with_sibling_srt(stored: DataFrame, rows: DataFrame, stem: Sequence[str], keys: Sequence[str] = (*KEYS, "chunk")) -> DataFrame:
    """(name, body): for each JSON document (keys, json) `<stem>.json`, and beside it the same rows as `<stem>.srt`."""
    name = F.concat_ws(".", *[F.col(k).cast("string") for k in keys], *map(F.lit, stem))
    srt = stored.select(*keys).join(render_srt(rows, keys), list(keys), "left").select(F.concat(name, F.lit(".srt")).alias("name"), F.coalesce("srt", F.lit("\n")).alias("body"))
    return stored.select(F.concat(name, F.lit(".json")).alias("name"), F.col("json").alias("body")).unionByName(srt)


def summary_json(judged: DataFrame, keys: Sequence[str] = KEYS, chunk: str = "chunk") -> DataFrame:
    """keys and json: {chunk_count, chunks} over the diagnostics rows of a video, by chunk."""
    listed = F.array_sort(F.collect_list(F.struct(chunk, *[c for c in judged.columns if c not in (*keys, chunk)])))
    grouped = judged.groupBy(*keys).agg(listed.alias("chunks"))
    return grouped.select(*keys, F.to_json(F.struct(F.size("chunks").alias("chunk_count"), "chunks"), {"pretty": "true"}).alias("json"))


def write_documents(documents: DataFrame, folder: str, name: str, body: str) -> DataFrame:
    """One file per row under folder, which all executors share; gives the paths. Files are renamed into place, so tasks may run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            paths = []
            for n, text in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist()):
                draft = f"{base}/.{uuid.uuid4().hex}"
                fs.create_dir(f"{base}/{n}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(draft) as out:
                    out.write((text or "").encode())
                fs.move(draft, f"{base}/{n}")
                paths.append(f"{folder}/{n}")
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string())})

    return documents.select(F.col(name).cast("string").alias("name"), F.col(body).alias("body")).mapInArrow(run, "path string")
