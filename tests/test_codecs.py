import io
import json
import wave

import pytest
from pyspark.sql import functions as F

from cuelake.operators import completion
from cuelake.plans import adapters, cli, config, pipeline
from cuelake.sources import audio, codecs, sinks
from cuelake.sources.srt import SrtDataSource
from tests.test_speech import out, segs, texts


def values(spark, *bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "video_id long, value string")


def test_srt(spark):
    body = "﻿".strip("﻿") + "1\r\n00:00:01,000 --> 00:00:02,500\r\nhello\r\nthere\r\n\r\nbroken\r\n\r\n3\r\n00:01:00,000 --> 00:01:01,000\r\nlast\r\n"
    assert out(codecs.parse_srt(values(spark, body)), "start", "end", "text") == [(1, 2.5, "hello\nthere"), (60, 61, "last")]
    with pytest.raises(Exception, match="malformed"):
        codecs.parse_srt(values(spark, "1\n00:00 --> 00:01\nx")).collect()
    assert codecs.parse_srt(values(spark, "")).count() == 0
    cues = texts(spark, [(0, 1.5, "a\nb"), (2, 3, "c")])
    srt = sinks.render_srt(cues).first().srt
    assert srt == "1\n00:00:00,000 --> 00:00:01,500\na\nb\n\n2\n00:00:02,000 --> 00:00:03,000\nc\n"
    assert out(codecs.parse_srt(sinks.render_srt(cues), "srt"), "start", "end", "text") == [(0, 1.5, "a\nb"), (2, 3, "c")]
    empty = sinks.with_empty(sinks.render_srt(cues.limit(0)), spark.createDataFrame([(7,)], "video_id long"))
    assert out(empty, "srt") == [("\n",)]


def test_srt_source_and_files(spark, tmp_path):
    paths = pipeline.write_subtitles(texts(spark, [(0, 1, "x")]), f"file://{tmp_path}/out")
    assert [r.path for r in paths.collect()] == [f"file://{tmp_path}/out/0.srt"]
    spark.dataSource.register(SrtDataSource)
    assert out(spark.read.format("srt").load(str(tmp_path / "out")), "ord", "start", "end", "text") == [(0, 0, 1, "x")]


def test_log(spark):
    log = "x VAD segment 0: start = 0.48, end = 2.34\nVAD segment 1: start = 2.88, end = 5.12\nFinal speech segments after filtering: 2"
    assert out(codecs.parse_speech_log(values(spark, log)), "ord", "index", "start", "end") == [(0, 0, 0.48, 2.34), (1, 1, 2.88, 5.12)]
    assert codecs.parse_speech_log(values(spark, "Final speech segments after filtering: 0")).count() == 0
    with pytest.raises(Exception, match="no segments"):
        codecs.parse_speech_log(values(spark, "crash")).collect()


def test_transcripts(spark):
    body = json.dumps({"transcription": [{"offsets": {"from": 0, "to": 1500}, "text": " 안녕하세요"}, {"offsets": {"from": 1, "to": 2}, "text": "  "}, {"offsets": {"from": 1, "to": 2}, "text": None}]})
    assert out(codecs.parse_offsets_json(values(spark, body)), "start", "end", "text") == [(0, 1.5, "안녕하세요")]
    assert codecs.parse_offsets_json(values(spark, '{"transcription": null}', "{}")).count() == 0
    for bad in ('{"transcription": [{"text": "x"}]}', "{"):
        with pytest.raises(Exception, match="offsets|JSON"):
            codecs.parse_offsets_json(values(spark, bad)).collect()
    body = json.dumps({"segments": [{"start": "x", "end": 1, "text": ""}, {"start": "0.5", "end": 1, "text": "a "}, {"start": 0, "end": 1, "text": None}]})
    assert out(codecs.parse_seconds_json(values(spark, body)), "start", "end", "text") == [(0.5, 1, "a")]
    with pytest.raises(Exception, match="not a number"):
        codecs.parse_seconds_json(values(spark, '{"segments": [{"start": "x", "end": 1, "text": "t"}]}')).collect()


def test_manifest(spark, tmp_path):
    (tmp_path / "c.csv").write_text("dir/v_000.mp4,0.000000,599.840000\nalone\nv_001.mp4,599.840000,1199.680000\n")
    assert out(codecs.read_manifest(spark, str(tmp_path / "c.csv")), "filename", "offset") == [("v_000.mp4", 0), ("v_001.mp4", 599.84)]
    (tmp_path / "e.csv").write_text("\n")
    with pytest.raises(ValueError):
        codecs.read_manifest(spark, str(tmp_path / "e.csv"))


def test_json_sinks(spark):
    rows = texts(spark, [(0, 1, "a"), (1, 2, "b")])
    data = json.loads(sinks.transcription_json(rows, "m", keys=("video_id",)).first().json)
    assert (data["segment_count"], data["segments"][1]) == (2, {"start": 1.0, "end": 2.0, "text": "b"})
    raw = spark.createDataFrame([(0, 1, "y"), (0, 0, "x")], "video_id long, batch long, answer string")
    assert json.loads(sinks.raw_batches_json(raw, "m", ("video_id",)).first().json)["batches"] == ["x", "y"]


def wav(seconds: float) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(b"\1\0" * int(16000 * seconds))
    return out.getvalue()


def test_audio(spark):
    wavs = spark.createDataFrame([("a.wav", bytearray(wav(10)))], "path string, content binary")
    assert out(audio.wav_durations(wavs), "frames", "rate", "duration") == [(160000, 16000, 10)]
    clips = spark.createDataFrame([("a.wav", 0, [(1.0, 3.0), (5.0, 7.0)]), ("a.wav", 1, [(9.0, 99.0)]), ("a.wav", 2, [(3.0, 2.0)])], "path string, clip long, parts array<struct<start:double,end:double>>")
    done = {r.clip: r for r in audio.wav_clips(wavs, clips).collect()}
    assert audio.wav_info(done[0].content)[2] == 4.2 and audio.wav_info(done[1].content)[2] == 1.0
    assert done[2].content is None and "no audio" in done[2].error


def test_transcribe(spark):
    class Flaky:
        """Covers half of long clips only."""

        def transcribe(self, content):
            length = audio.wav_info(content)[2]
            if 1.9 < length < 2.1:
                raise adapters.PipelineError("down")
            return [{"start": 0.5, "end": length * (0.5 if length > 4 else 1), "text": f"{length:.1f}"}]

    wavs = spark.createDataFrame([("a.wav", bytearray(wav(20)))], "path string, content binary")
    speech = segs(spark, [(2, 4), (6, 9)]).select(F.lit("a.wav").alias("path"), "ord", "start", "end")
    good = pipeline.transcribe_speech(wavs, speech, lambda: adapters.FixedTranscriber())
    assert out(good, "text") == [("speech",)]
    again = pipeline.transcribe_speech(wavs, speech, Flaky)
    assert sorted(r.text for r in again.collect()) == ["2.3", "3.3"]
    alone = config.from_mapping({"whisper": {"vad_segments": {"max_batch_duration": 0, "padding": 0.0}}})
    assert out(pipeline.transcribe_speech(wavs, speech, Flaky, alone), "start", "text") == [(6.5, "3.0")]


def test_drops():
    f = completion.parse_drops
    assert f('{"drop": [0, 99, -1]}', 3) == {0}
    assert f('```json\n{"drop": [0, "1", 2.5, 1]}\n```', 3) == {0, 1}
    assert f('{"drop": [true, false]}', 3) == f("[1, 2]", 3) == f("x", 3) == f('{"drop": 1}', 3) == set()


def test_marked():
    assert completion.parse_adjudication("<<<SEG_001>>>\na\n<<<SEG_002>>>\n", 2) == {0: "a"}
    assert completion.parse_adjudication("<<<SEG_002>>>a<<<SEG_001>>>b", 2) == completion.parse_adjudication("<<<SEG_001>>>a", 2) == {}
    assert completion.parse_translation("<<<SRT_001>>>\na\n<<<SRT_002>>>\nb", 2) == ["a", "b"]
    assert completion.parse_translation("<<<SRT_001>>>\na\n<<<SRT_002>>>\n", 2) is None
    assert "[OCR] x" in completion.translation_prompt([{"text": "a", "source_hint": "x"}]) and "[OCR]" not in completion.translation_prompt([{"text": "a"}])
    assert "(no context)" in completion.adjudication_prompt([{"primary_text": "a", "secondary_text": "b"}])


def test_translate_retries():
    calls = []

    def bad(prompt):
        calls.append(prompt)
        return "nothing"

    with pytest.raises(completion.BatchFailed):
        completion.translate_batch([{"text": "a"}], bad, retries=2)
    assert len(calls) == 2
    answers = iter(["", "<<<SRT_001>>> b"])
    assert completion.translate_batch([{"text": "a"}], lambda p: next(answers)) == ["b"]

    def small_only(prompt):
        n = prompt.count("<<<SRT_0")
        return "" if n > 2 else "\n".join(f"<<<SRT_{i:03d}>>>\nt" for i in range(1, n + 1))

    assert completion.translate_batch([{"text": str(i)} for i in range(4)], small_only, retries=1, min_split=2) == ["t"] * 4


def test_clutter(spark):
    def judge(prompt):
        return '{"drop": [1]}' if "[0] e0" in prompt else '{"drop": [0]}'

    rows = texts(spark, [(i, i + 1, f"e{i}") for i in range(6)])
    assert [r[0] for r in out(completion.clutter_filter(rows, judge, batch_size=3).orderBy("ord"), "text")] == ["e0", "e2", "e4", "e5"]
    assert completion.clutter_filter(rows.limit(3), judge, batch_size=3).count() == 3
    assert completion.clutter_filter(rows, lambda p: 1 / 0).count() == 6


def test_config(tmp_path):
    c = config.from_mapping({"merge": {"agree_threshold": 0.8, "unknown": 1}, "ocr": {"filter": {"blocklist_texts": ["x"]}}})
    assert c.agree_threshold == 0.8 and c.ocr.filter.blocklist_texts == ("x",) and c.merge.overlap_threshold == 0.3
    assert config.with_mode(c, "ocr").ocr.enabled and not config.with_mode(c, "ocr").transcription.enabled
    with pytest.raises(ValueError):
        config.with_mode(c, "x")
    (tmp_path / "c.yaml").write_text('{"chunk_length_seconds": 5}')
    assert config.load(str(tmp_path / "c.yaml"), {"TRANSLATION_API_KEY": "k"}).translation.api_key == "k"
    assert cli.span(3724.2) == "1h 2m 4.20s" and cli.main(["/nowhere", "/tmp"]) == 1


def test_adapters(tmp_path):
    with pytest.raises(adapters.PipelineError):
        adapters.run_program(["no-such-program"])
    with pytest.raises(ValueError):
        adapters.make_transcriber("x")
    assert adapters.seconds_segments({"segments": [{"start": 1, "end": 2, "text": None}, {"start": "1", "end": 2, "text": "a"}]}) == [{"start": 1.0, "end": 2.0, "text": "a"}]
    for bad in ('{"transcription": [{"text": "x"}]}', "{"):
        with pytest.raises(adapters.PipelineError):
            adapters.offsets_segments(bad)
    (tmp_path / "v_000.mp4").touch()
    with pytest.raises(adapters.PipelineError, match="no manifest"):
        adapters.split_video("v.mp4", str(tmp_path), 600)
    (tmp_path / "chunks.csv").touch()
    assert adapters.split_video("v.mp4", str(tmp_path), 600) == str(tmp_path / "chunks.csv")
    (tmp_path / "a.wav").touch()
    assert adapters.extract_audio("v.mp4", str(tmp_path / "a.wav")).endswith("a.wav")


def test_loops_abort(spark):
    rows = texts(spark, [(i, i + 1, "same") for i in range(6)])
    chunk = spark.createDataFrame([(0, 10.0)], "video_id long, duration double")
    strict = config.from_mapping({"whisper": {"diagnostics": {"abort_on_loop": True}}})
    assert pipeline.checked(rows, chunk).first().verdict == "abort"
    with pytest.raises(pipeline.TranscriptLoop):
        pipeline.checked(rows, chunk, strict)
