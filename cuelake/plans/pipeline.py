"""Whole runs: spoken cues, on-screen events, ensembles, and their fusion, as lazy plans over tables of many videos."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import completion, diagnostics, ensemble, fusion, screen
from ..operators import speech as S
from ..sources import audio, sinks
from .adapters import Transcriber, transcribe_clips
from .config import Config

CHUNK = ("video_id", "chunk")


def spoken_cues(speech: DataFrame, asr: DataFrame, chunks: DataFrame, max_merge: float = 2.0, keys: tuple[str, ...] = ("video_id",), texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Cues of each chunk on the time of the whole video. texts as in speech_cues."""
    return S.shift_timeline(S.speech_cues(speech, asr, max_merge, keys, texts), chunks, keys)


def transcribe_speech(wavs: DataFrame, speech: DataFrame, make: Callable[[], Transcriber], config: Config = Config(), batched: bool | None = None) -> DataFrame:
    """Transcript segments (path, ord, start, end, text) of the speech in each WAV file (wavs: path, content; speech: path, ord, start, end).

    Batches of speech with silence between are transcribed in one clip each and mapped back to
    the source's time; batches that fail or are under-covered are done again segment by
    segment, where a failing clip is left out.
    """
    own = config.whisper.vad_segments
    quiet = own.silence_ms / 1000.0
    merged = S.at_least(S.merge_close(speech, own.merge_gap, ("path",)), own.min_segment_duration)
    if not (own.max_batch_duration > 0 if batched is None else batched):
        return _by_segment(wavs, merged, make, own.padding)
    grouped = S.speech_batches(merged, own.max_batch_duration, quiet, ("path",))
    mapping = S.batch_mapping(grouped, quiet, keys=("path",))
    done = transcribe_clips(audio.wav_clips(wavs, audio.batch_parts(grouped, ("path",)), quiet, batch=True).filter("content IS NOT NULL"), make)
    said = done.select("path", F.col("clip").alias("batch"), F.explode("segments").alias("s")).select("path", "batch", "s.*")
    lengths = mapping.groupBy("path", "batch").agg(F.max("batch_end").alias("duration"))
    judged = S.coverage(said, lengths, own.min_coverage, ("path", "batch"))
    good = said.join(judged.filter("covered").select("path", "batch"), ["path", "batch"], "left_semi")
    back = S.map_batch_time(S.map_batch_time(good, mapping, "start", ("path", "batch")), mapping, "end", ("path", "batch"))
    timed = back.select("path", F.col("start_original").alias("start"), F.col("end_original").alias("end"), "text")
    again = grouped.join(judged.filter("NOT covered").select("path", "batch"), ["path", "batch"], "left_semi")
    return _ordered(timed.unionByName(_by_segment(wavs, again.drop("batch"), make, own.padding).drop("ord")))


def _by_segment(wavs: DataFrame, segments: DataFrame, make: Callable[[], Transcriber], padding: float) -> DataFrame:
    ranges = S.padded_ranges(segments, padding, ("path",)).select("path", F.col("ord").alias("clip"), "clip_start", "clip_end")
    parts = ranges.select("path", "clip", F.array(F.struct(F.col("clip_start").alias("start"), F.col("clip_end").alias("end"))).alias("parts"))
    done = transcribe_clips(audio.wav_clips(wavs, parts).filter("content IS NOT NULL"), make)
    said = done.join(ranges, ["path", "clip"]).select("path", "clip_start", F.explode("segments").alias("s"))
    return _ordered(said.select("path", (F.col("s.start") + F.col("clip_start")).alias("start"), (F.col("s.end") + F.col("clip_start")).alias("end"), "s.text"))


def _ordered(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("ord", (F.row_number().over(Window.partitionBy("path").orderBy("start", "end", "text")) - 1).cast("long"))


def ensemble_cues(primary: DataFrame, secondary: DataFrame, speech: DataFrame, config: Config = Config(), complete: completion.Complete | None = None, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """Reconciled cues, pending ones resolved if there is a completion, cut to speech."""
    own = config.whisper.ensemble
    cues = ensemble.reconcile(primary, secondary, own.overlap_threshold, own.agree_threshold, own.hint_threshold, own.min_cue_duration, own.min_cue_chars, keys)
    if complete is not None and own.llm_adjudicate:
        cues = ensemble.apply_resolutions(cues, completion.adjudicate(cues.filter("decision = 'pending'"), complete, own.llm_batch_size, keys), keys)
    return ensemble.non_empty(S.clip_to_speech(cues.select(*keys, "ord", "start", "end", "text"), speech, keys=keys))


class TranscriptLoop(Exception):
    """A transcript repeats itself."""


def checked(segments: DataFrame, chunks: DataFrame, config: Config = Config(), keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """Verdicts per chunk. With abort_on_loop, a chunk with the verdict abort is an error; only its keys reach the driver."""
    judged = diagnostics.verdict(diagnostics.metrics(segments, chunks, keys))
    if config.whisper.diagnostics.abort_on_loop and (bad := judged.filter("verdict = 'abort'").select(*keys, "reason").first()):
        raise TranscriptLoop(str(bad.asDict()))
    return judged


def screen_events(detections: DataFrame, frame_height: Column, config: Config = Config(), complete: completion.Complete | None = None, heights: DataFrame | None = None) -> DataFrame:
    """On-screen events: blocked and too frequent texts go, frames are merged, detections become events, events are filtered and padded.

    Repeats are counted over the events of each chunk where detections have one, so a text that
    spans two chunks counts twice. heights (video_id and what frame_height refers to) is joined before the filter.
    """
    own = config.ocr.filter
    clean = screen.drop_blocked(detections, own.blocklist_texts, own.blocklist_patterns)
    if own.max_text_repeats > 0:
        clean = screen.drop_repeated(clean, screen.group_detections(clean, keys=CHUNK if "chunk" in clean.columns else CHUNK[:1]), own.max_text_repeats)
    events = screen.group_detections(screen.merge_frames(clean))
    if heights is not None:
        events = events.join(heights, "video_id")
    columns = [c for c in events.columns if heights is None or c not in heights.columns or c == "video_id"]
    events = screen.filter_events(events, frame_height, min_confidence=own.min_confidence, min_ratio=own.min_box_height_ratio, max_ratio=own.max_box_height_ratio, min_length=own.min_text_length, texts=own.blocklist_texts, patterns=own.blocklist_patterns)
    events = events.select(*columns)
    if complete is not None and config.ocr.llm_filter.enabled:
        c = config.ocr.llm_filter
        events = completion.clutter_filter(events, complete, c.batch_size, c.min_events, c.source_language, c.content_type)
    return screen.pad_events(events, own.timestamp_padding)


def process(spoken: DataFrame | None, events: DataFrame | None, config: Config = Config(), translate: completion.Complete | None = None) -> DataFrame:
    """Final cues from spoken cues, on-screen events or both; translated if there is a completion.

    Events alone pass whole, as no gap is there to fill.
    """
    m = config.merge
    if spoken is None and events is None:
        raise ValueError("nothing to process")
    if events is None:
        cues = spoken.withColumn("source_hint", F.lit(None).cast("string"))
    elif spoken is None:
        cues = screen.events_to_cues(events)
    else:
        cues = fusion.fuse(spoken, events, m.overlap_threshold, m.agree_threshold, m.fill_gaps, m.gap_fill_min_duration, m.gap_fill_prefix)
    return cues if translate is None else translated(cues, config, translate)


def translated(cues: DataFrame, config: Config, complete: completion.Complete) -> DataFrame:
    t = config.translation
    return completion.translate(cues, complete, t.batch_size, t.max_retries, t.min_split_size, source=t.source_language, target=t.target_language, context=t.context)


def write_subtitles(cues: DataFrame, folder: str) -> DataFrame:
    """One subtitle file per video under a folder that all executors share."""
    return sinks.write_documents(sinks.render_srt(cues).select(F.concat(F.col("video_id").cast("string"), F.lit(".srt")).alias("name"), "srt"), folder, "name", "srt")
