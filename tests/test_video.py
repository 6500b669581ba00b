"""Whole runs over chunks of several videos, with stand-ins for programs and models."""

import dataclasses
import io
import json
import os
import re
import wave

import numpy as np
import pytest

from cuelake.plans import adapters, pipeline, video
from cuelake.plans.config import Config
from cuelake.sources import codecs, sinks


def wav(seconds):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(bytes(int(seconds * 16000) * 2))
    return out.getvalue()


LOG = "VAD segment 0: start = 1.00, end = 3.00\nVAD segment 1: start = 5.00, end = 8.00\nFinal speech segments after filtering: 2"


def split(path):
    return [(f"{path}_{k}", 10.0 * k, 10.0 * k + 10) for k in range(2)]


class Picture:
    def read(self, frame):
        assert frame.shape[:2] == (55, 70)
        box = {"x1": 2, "y1": 10, "x2": 60, "y2": 14}
        return [{"box": box, "text": f"long caption of scene {int(frame[0, 0])}", "confidence": 0.95}, {"box": box | {"y1": 40, "y2": 52}, "text": "faint", "confidence": 0.3}]


def decode(path):
    return 4.0, 100, 100, (np.full((100, 100), int(path[-1])) for _ in range(24))


def settings(**parts):
    base = Config()
    whisper = dataclasses.replace(base.whisper, ensemble=dataclasses.replace(base.whisper.ensemble, enabled=parts.get("ensemble", False)))
    switch = lambda x, name: dataclasses.replace(x, enabled=parts.get(name, True))
    return dataclasses.replace(base, whisper=whisper, transcription=switch(base.transcription, "hear"), ocr=switch(base.ocr, "see"))


@pytest.fixture()
def videos(spark):
    return spark.createDataFrame([(1, "a"), (2, "b")], "video_id long, path string")


def translator(prompt):
    marks = re.findall(r"^<<<SRT_\d+>>>$", prompt, re.MULTILINE)
    return "\n".join(f"{m}\ntranslated {k}" for k, m in enumerate(marks, 1))


def read(folder, name):
    with open(f"{folder}/{name}", encoding="utf-8") as f:
        return f.read()


def test_speech_of_all_chunks(videos, tmp_path):
    run = lambda config, **more: video.process_videos(videos, f"file://{tmp_path}", split, lambda path: wav(10), lambda audio: LOG, lambda: adapters.FixedTranscriber("one two"), config=config, **more).collect()
    assert len(run(settings(see=False), translate=translator)) == 4
    text = read(tmp_path, "1.srt")
    assert [x for x in text.split("\n") if "-->" in x][1].startswith("00:00:15,000")  # the second chunk is moved by its offset
    assert [x for x in text.split("\n") if x.isdigit()] == ["1", "2"] and read(tmp_path, "2.srt") == text
    assert "translated 2" in read(tmp_path, "1_translated.srt")
    with pytest.raises(adapters.PipelineError):
        run(settings(see=False, hear=False))


def test_two_transcribers(videos, tmp_path):
    made = video.process_videos(videos, f"file://{tmp_path}", split, lambda path: wav(10), lambda audio: LOG, lambda: adapters.FixedTranscriber("one two three"), lambda: adapters.FixedTranscriber("one two three"), config=settings(see=False, ensemble=True))
    assert made.count() == 2 and read(tmp_path, "1.srt").count("one two three") == 2


def test_screen_text(spark, videos, tmp_path):
    config = settings(hear=False)
    chunks = video.split_videos(videos, split)
    rows = video.read_frames(chunks, decode, Picture, config).collect()
    assert {r.frame_time for r in rows} == {0.5 * k for k in range(12)} and {r.text for r in rows} == {"long caption of scene 0", "long caption of scene 1"} and {r.frame_height for r in rows} == {55}
    assert video.process_videos(videos, f"file://{tmp_path}", split, decode=decode, reader=Picture, config=config).count() == 2
    assert "long caption of scene 0" in read(tmp_path, "1.srt") and "00:00:15,750" in read(tmp_path, "1.srt")
    with pytest.raises(Exception, match="frame rate"):
        video.read_frames(chunks, lambda path: (0.0, 1, 1, ()), Picture, config).collect()


def test_repeats_are_counted_per_chunk(spark):
    """A text on screen across the border of two chunks counts once in each."""
    box = {"x1": 0, "y1": 0, "x2": 50, "y2": 6}
    rows = [(1, k // 4, 0.5 * k, k, box, "banner text on the wall", 0.0, 0.95) for k in range(8)]
    found = spark.createDataFrame(rows, "video_id long, chunk long, frame_time double, ord long, box struct<x1:int,y1:int,x2:int,y2:int>, text string, angle double, confidence double")
    most = lambda n: dataclasses.replace(Config(), ocr=dataclasses.replace(Config().ocr, filter=dataclasses.replace(Config().ocr.filter, max_text_repeats=n)))
    from pyspark.sql import functions as F

    assert pipeline.screen_events(found, F.lit(100), most(1)).count() == 0 and pipeline.screen_events(found, F.lit(100), most(2)).count() == 1
    assert pipeline.screen_events(found.drop("chunk"), F.lit(100), most(1)).count() == 1


def test_translated_files(spark, tmp_path):
    files = spark.createDataFrame([("talk", "1\n00:00:01,000 --> 00:00:02,000\nhello\n")], "name string, value string")
    video.translate_files(files, f"file://{tmp_path}", translator).collect()
    assert "translated 1" in read(tmp_path, "talk_translated.srt")
    with pytest.raises(adapters.PipelineError):
        video.translate_files(spark.createDataFrame([("bare", "")], "name string, value string"), f"file://{tmp_path}", lambda prompt: "")


def test_stored_transcripts(spark):
    segments = spark.createDataFrame([(1, 0, k, float(k), k + 1.0, t) for k, t in enumerate(["a", "", " b "])], "video_id long, chunk long, ord long, start double, end double, text string")
    stored = sinks.transcription_json(segments, "m")
    back = codecs.parse_stored_transcript(stored.withColumnRenamed("json", "value"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, segments.collect()))
    files = {r.name: r.body for r in sinks.with_sibling_srt(stored, segments, ("primary",)).collect()}
    assert set(files) == {"1.0.primary.json", "1.0.primary.srt"} and files["1.0.primary.srt"].count("-->") == 3
    judged = spark.createDataFrame([(1, 1, "ok", 0.5), (1, 0, "abort", 0.1)], "video_id long, chunk long, verdict string, coverage_ratio double")
    summary = json.loads(sinks.summary_json(judged).first().json)
    assert summary["chunk_count"] == 2 and [c["verdict"] for c in summary["chunks"]] == ["abort", "ok"]


def test_cached_answers(tmp_path):
    program = tmp_path / "program"
    program.write_text("#!/bin/sh\nwhile [ $# -gt 0 ]; do [ \"$1\" = -of ] && base=$2; shift; done\necho run >> " + str(tmp_path / "runs") + "\necho '{\"transcription\": [{\"offsets\": {\"from\": 0, \"to\": 900}, \"text\": \" hi \"}]}' > $base.json\n")
    os.chmod(program, 0o755)
    for folder, runs in ((str(tmp_path / "held"), 1), (None, 3)):
        own = adapters.CliTranscriber(str(program), "model", folder=folder)
        assert own.transcribe(wav(1)) == own.transcribe(wav(1)) == [{"start": 0.0, "end": 0.9, "text": "hi"}]
        assert (tmp_path / "runs").read_text().count("run") == runs
