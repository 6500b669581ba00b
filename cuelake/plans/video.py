"""From video files to subtitles: chunks, audio, speech, transcripts and on-screen text as one plan over many videos.

A table of chunks (video_id, chunk, path, offset) is the unit of work; every step keeps its keys, so
chunks of all videos are spread over the cluster. Programs and models are handed in as functions
or factories that a task calls once; the adapters hold those that run real ones, tests
use stand-ins. Paths are on storage that all executors share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import completion
from ..operators import speech as S
from ..sources import codecs, sinks
from . import pipeline
from .adapters import PipelineError, Reader, Transcriber
from .config import Config
from .pipeline import CHUNK

KEYS = ("video_id",)


def split_videos(videos: DataFrame, split: Callable[[str], list[tuple[str, float, float]]]) -> DataFrame:
    """Chunks (video_id, chunk, path, offset, duration) of videos (video_id, path); split gives (path, start, end) of each chunk in order."""
    kind = pa.list_(pa.struct([("path", pa.string()), ("start", pa.float64()), ("end", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[dict(zip(("path", "start", "end"), c)) for c in split(p)] for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), pa.array(parts, kind)], names=["video_id", "parts"])

    id_kind = videos.schema["video_id"].dataType.simpleString()
    found = videos.select("video_id", "path").mapInArrow(run, f"video_id {id_kind}, parts array<struct<path string, start double, end double>>")
    each = found.select("video_id", F.posexplode("parts").alias("chunk", "c"))
    return each.select("video_id", F.col("chunk").cast("long").alias("chunk"), "c.path", F.col("c.start").alias("offset"), (F.col("c.end") - F.col("c.start")).alias("duration"))


def read_audio(chunks: DataFrame, extract: Callable[[str], bytes], separate: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """chunk keys, path and content (WAV) of each chunk; with separate, of its voice alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column("path").to_pylist()):  # one file in memory at a time
                wav = extract(path)
                part = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([separate(wav) if separate else wav], pa.binary())], names=[*part.schema.names, "content"])

    rows = chunks.select(*CHUNK, "path")
    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", content binary")


def detect_speech(wavs: DataFrame, activity: Callable[[bytes], str]) -> DataFrame:
    """chunk keys, path, ord, start, end of the speech in each WAV; activity gives the log of a speech activity program."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = [activity(wav) for wav in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*CHUNK, "path")), pa.array(logs, pa.string())], names=[*CHUNK, "path", "value"])

    kinds = ", ".join(f"{c} {wavs.schema[c].dataType.simpleString()}" for c in (*CHUNK, "path"))
    return codecs.parse_speech_log(wavs.mapInArrow(run, f"{kinds}, value string")).drop("index")


def transcripts(wavs: DataFrame, speech: DataFrame, make: Callable[[], Transcriber], config: Config = Config(), batched: bool | None = None) -> DataFrame:
    """chunk keys, ord, start, end, text: by segments of speech, or of whole files if the strategy says so."""
    names = wavs.select(*CHUNK, "path")
    if config.whisper.strategy == "vad_segments":
        said = pipeline.transcribe_speech(wavs.select("path", "content"), speech.select("path", "ord", "start", "end"), make, config, batched)
    else:
        done = pipeline.transcribe_clips(wavs.select("path", F.lit(0).cast("long").alias("clip"), "content"), make)
        failed = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("transcription failed: "), "error")).cast(done.schema["segments"].dataType)).otherwise(F.col("segments"))
        said = done.select("path", F.posexplode(failed).alias("ord", "s")).select("path", F.col("ord").cast("long").alias("ord"), "s.start", "s.end", "s.text")
    return said.join(names, "path").drop("path")


def spoken(chunks: DataFrame, extract: Callable[[str], bytes], activity: Callable[[bytes], str], primary: Callable[[], Transcriber], secondary: Callable[[], Transcriber] | None = None, config: Config = Config(), separate: Callable[[bytes], bytes] | None = None, complete: completion.Complete | None = None) -> DataFrame:
    """video_id, ord, start, end, text on the time of the whole video, chunk after chunk.

    With a secondary transcriber and the ensemble switched on, both hear the same speech (the
    primary the plain audio, the secondary the separated voice) and are reconciled per chunk.
    """
    plain = read_audio(chunks, extract)
    voice = read_audio(chunks, extract, separate) if separate and config.uvr.enabled else plain
    if secondary is None or not config.whisper.ensemble.enabled:
        speech = detect_speech(voice, activity)
        cues = S.speech_cues(speech.drop("path"), transcripts(voice, speech, primary, config), config.vad.max_merge_duration, CHUNK)
    else:
        speech = detect_speech(plain, activity)
        first = transcripts(plain, speech, primary, config)
        pipeline.checked(first, chunks, config, CHUNK)
        cues = pipeline.ensemble_cues(first, transcripts(voice, speech, secondary, config), speech.drop("path"), config, complete, CHUNK)
    return in_order(S.shift_timeline(cues, chunks, CHUNK))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of all chunks of a video one after the other: ord counts through, by chunk and then by the order in it."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy(*KEYS).orderBy("chunk", "ord"))
    return rows.withColumn("ord", (number - 1).cast("long")).drop("chunk")


DETECTIONS = "frame_time double, ord long, box struct<x1:int,y1:int,x2:int,y2:int>, text string, angle double, confidence double, frame_height int"


def read_frames(chunks: DataFrame, decode: Callable[[str], tuple[float, int, int, Iterable]], make: Callable[[], Reader], config: Config = Config()) -> DataFrame:
    """chunk keys, path's detections: frame_time (in the chunk), ord, box, text, angle, confidence and the height of what was read.

    decode gives (frames per second, width, height, frames); every frame that is due is cut to the
    configured region with frame[y1:y2, x1:x2] and read. What is read with less than
    the least confidence, or is empty, is dropped; boxes are relative to the region.
    """
    own = config.ocr
    names = ["frame_time", "ord", "box", "text", "angle", "confidence", "frame_height"]
    box = pa.struct([(c, pa.int32()) for c in ("x1", "y1", "x2", "y2")])
    kinds = [pa.float64(), pa.int64(), box, pa.string(), pa.float64(), pa.float64(), pa.int32()]

    def region(width: int, height: int) -> tuple[int, int, int, int]:
        x1, y1 = int(width * own.crop_left_ratio), int(height * own.crop_top_ratio)
        x2, y2 = width - int(width * own.crop_right_ratio), height - int(height * own.crop_bottom_ratio)
        if x2 <= x1 or y2 <= y1:
            raise PipelineError("nothing is left of the frame")
        return x1, y1, x2, y2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            for k, path in enumerate(batch.column("path").to_pylist()):
                reader = reader or make()
                fps, width, height, frames = decode(path)
                if fps <= 0 or width <= 0 or height <= 0:
                    raise PipelineError(f"{path} has no frame rate or size")
                x1, y1, x2, y2 = region(width, height)
                step, rows = max(1, round(fps / own.sample_fps)), []
                for number, frame in enumerate(frames):
                    if number % step == 0:
                        for d in reader.read(frame[y1:y2, x1:x2]):
                            if d["text"] and d["confidence"] >= own.rec_confidence:
                                rows.append((number / fps, len(rows), d["box"], d["text"], d.get("angle", 0.0), d["confidence"], y2 - y1))
                columns = list(zip(*rows)) or [()] * len(names)
                part = batch.slice(k, 1)
                keys = [pa.array(part.column(c).to_pylist() * len(rows), part.column(c).type) for c in CHUNK]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, kind) for c, kind in zip(columns, kinds))], names=[*CHUNK, *names])

    rows = chunks.select(*CHUNK, "path")
    return rows.mapInArrow(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in CHUNK) + ", " + DETECTIONS)


def shown(chunks: DataFrame, detections: DataFrame, config: Config = Config(), complete: completion.Complete | None = None) -> DataFrame:
    """On-screen events of whole videos; texts are counted per chunk, the rest sees the video's time."""
    height = detections.groupBy(*KEYS).agg(F.min_by("frame_height", "chunk").alias("height"))
    moved = detections.join(chunks.select(*CHUNK, "offset"), list(CHUNK)).withColumn("frame_time", F.col("frame_time") + F.col("offset"))
    from pyspark.sql import Window

    through = F.row_number().over(Window.partitionBy(*KEYS).orderBy("chunk", "ord"))
    rows = moved.withColumn("ord", (through - 1).cast("long")).drop("offset", "frame_height")
    return pipeline.screen_events(rows, F.col("height"), config, complete, height)


def subtitles(chunks: DataFrame, spoken_cues: DataFrame | None, events: DataFrame | None, folder: str, config: Config = Config(), translate: completion.Complete | None = None) -> DataFrame:
    """Paths of one subtitle file per video, and with translate of one `_translated` file beside each; videos without cues get an empty file."""
    cues = pipeline.process(spoken_cues, events, config)
    videos = chunks.select(*KEYS).distinct()
    stem = F.col("video_id").cast("string")
    files = sinks.with_empty(sinks.render_srt(cues), videos).select(F.concat(stem, F.lit(".srt")).alias("name"), "srt")
    if translate is not None:
        translated = pipeline.translated(cues, config, translate)
        files = files.unionByName(sinks.render_srt(translated).select(F.concat(stem, F.lit("_translated.srt")).alias("name"), "srt"))
    return sinks.write_documents(files, folder, "name", "srt")


def translate_files(files: DataFrame, folder: str, complete: completion.Complete, config: Config = Config()) -> DataFrame:
    """Translations of subtitle files (name without its ending, value) as `<name>_translated.srt`; a file without cues is an error."""
    cues = codecs.parse_srt(files.select(F.col("name").alias("video_id"), "value")).withColumn("source_hint", F.lit(None).cast("string"))
    if (bare := files.select(F.col("name").alias("video_id")).join(cues, "video_id", "left_anti").first()) is not None:
        raise PipelineError(f"no subtitles in {bare[0]}")
    done = sinks.render_srt(pipeline.translated(cues, config, complete)).select(F.concat("video_id", F.lit("_translated.srt")).alias("name"), "srt")
    return sinks.write_documents(done, folder, "name", "srt")


def process_videos(videos: DataFrame, folder: str, split, extract=None, activity=None, primary=None, secondary=None, decode=None, reader=None, separate=None, complete=None, translate=None, config: Config = Config()) -> DataFrame:
    """The whole run: chunks, then speech, screen text or both as the settings say, then files."""
    if not config.transcription.enabled and not config.ocr.enabled:
        raise PipelineError("both transcription and screen text are switched off")
    chunks = split_videos(videos, split)
    heard = spoken(chunks, extract, activity, primary, secondary, config, separate, complete) if config.transcription.enabled else None
    seen = shown(chunks, read_frames(chunks, decode, reader, config), config, complete) if config.ocr.enabled else None
    return subtitles(chunks, heard, seen, folder, config, translate)


def secondary_settings(config: Config) -> Config:
    """The settings that the second transcriber of an ensemble runs with."""
    own = config.whisper
    return replace(config, whisper=replace(own, model=own.ensemble.secondary_model, server_port=own.ensemble.secondary_port))
