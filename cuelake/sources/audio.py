"""WAV files: metadata, clips, and batches of clips with silence between. Only the bytes need Python."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """path and content."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def wav_info(content: bytes) -> tuple[int, int, float]:
    """(frames, rate, duration in seconds)."""
    with wave.open(io.BytesIO(content)) as w:
        return w.getnframes(), w.getframerate(), w.getnframes() / w.getframerate()


def cut_wav(content: bytes, parts: list[tuple[float, float]], silence: float = 0.0, batch: bool = False) -> bytes:
    """The parts one after the other, silence between; bounds are whole frames within the file. A part without frames is an error.

    A part ends at the frame of its end; in a batch it has int((end - start) * rate) frames, as `batch_mapping` counts them.
    """
    out = io.BytesIO()
    with wave.open(io.BytesIO(content)) as w:
        rate, size, frames = w.getframerate(), w.getsampwidth() * w.getnchannels(), w.getnframes()
        with wave.open(out, "wb") as v:
            v.setparams(w.getparams())
            for k, (start, end) in enumerate(parts):
                a = max(0, int(start * rate))
                b = min(frames, a + int((end - start) * rate) if batch else int(end * rate))
                if b <= a:
                    raise ValueError(f"no audio between {start} and {end}")
                if k:
                    v.writeframes(bytes(int(silence * rate) * size))
                w.setpos(a)
                v.writeframes(w.readframes(b - a))
    return out.getvalue()


def wav_durations(wavs: DataFrame) -> DataFrame:
    """path, frames, rate, duration."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            info = [wav_info(c) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([i[0] for i in info], pa.int64()), pa.array([i[1] for i in info], pa.int64()), pa.array([i[2] for i in info], pa.float64())], names=["path", "frames", "rate", "duration"])

    return wavs.select("path", "content").mapInArrow(run, "path string, frames long, rate long, duration double")


def wav_clips(wavs: DataFrame, clips: DataFrame, silence: float = 0.2, batch: bool = False) -> DataFrame:
    """path, clip, content, error: clips has path, clip, and parts (array of start, end). What can't be cut has an error and no content."""
    rows = clips.join(wavs, "path").select("path", "clip", "parts", "content")

    by_length = batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, errors = [], []
            for parts, data in zip(batch.column("parts").to_pylist(), batch.column("content").to_pylist()):
                try:
                    content.append(cut_wav(data, [(p["start"], p["end"]) for p in parts], silence, by_length))
                    errors.append(None)
                except (ValueError, wave.Error, EOFError) as e:
                    content.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("clip"), pa.array(content, pa.binary()), pa.array(errors, pa.string())], names=["path", "clip", "content", "error"])

    return rows.mapInArrow(run, f"path string, clip {clips.schema['clip'].dataType.simpleString()}, content binary, error string")


def batch_parts(batched: DataFrame, keys=("video_id",)) -> DataFrame:
    """keys, clip (batch) and parts of each batch's clip."""
    return batched.groupBy(*keys, F.col("batch").alias("clip")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("parts"))
