"""Boundaries to models and programs that live elsewhere: protocols, subprocess and HTTP clients, stand-ins for tests."""

from __future__ import annotations

import hashlib
import json
import os
import socket
import subprocess
import tempfile
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame


class PipelineError(Exception):
    """A boundary failed."""


class Transcriber(Protocol):
    """Segments (start, end, text) of a WAV file's bytes."""

    def transcribe(self, wav: bytes) -> list[dict]: ...


def transcribe_clips(clips: DataFrame, make: Callable[[], Transcriber], keys: tuple[str, ...] = ("path", "clip")) -> DataFrame:
    """keys, segments, error of clips (keys, content): one transcriber per task; a clip that fails has an error and the rest go on."""
    kind = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = None
        try:
            for batch in batches:
                backend = backend or make()
                found, errors = [], []
                for wav in batch.column("content").to_pylist():
                    try:
                        found.append(backend.transcribe(wav))
                        errors.append(None)
                    except PipelineError as e:
                        found.append(None)
                        errors.append(str(e))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(found, kind), pa.array(errors, pa.string())], names=[*keys, "segments", "error"])
        finally:
            if backend is not None and hasattr(backend, "close"):
                backend.close()

    kinds = ", ".join(f"{k} {clips.schema[k].dataType.simpleString()}" for k in keys)
    return clips.select(*keys, "content").mapInArrow(run, f"{kinds}, segments array<struct<start double, end double, text string>>, error string")


def run_program(command: list[str], timeout: float | None = None) -> tuple[str, str]:
    """(stdout, stderr); a program that is missing or fails is a PipelineError."""
    try:
        done = subprocess.run(command, capture_output=True, text=True, timeout=timeout, check=True)
    except FileNotFoundError as e:
        raise PipelineError(f"{command[0]} is not installed") from e
    except subprocess.SubprocessError as e:
        raise PipelineError(f"{command[0]} failed: {getattr(e, 'stderr', None) or e}") from e
    return done.stdout, done.stderr


def split_video(video: str, folder: str, seconds: int, program: str = "ffmpeg") -> str:
    """Path of the chunk manifest; existing chunks are used again, chunks without a manifest are an error."""
    base = Path(folder)
    base.mkdir(parents=True, exist_ok=True)
    listed, stem, suffix = base / "chunks.csv", Path(video).stem, Path(video).suffix
    chunks = sorted(base.glob(f"{stem}_*{suffix}"))
    if chunks and listed.exists():
        return str(listed)
    if chunks:
        raise PipelineError(f"{folder} has chunks but no manifest")
    run_program([program, "-y", "-i", video, "-c", "copy", "-map", "0", "-f", "segment", "-segment_time", str(seconds), "-segment_list", str(listed), "-reset_timestamps", "1", str(base / f"{stem}_%03d{suffix}")])
    return str(listed)


def extract_audio(video: str, wav: str, program: str = "ffmpeg") -> str:
    """Mono 16 kHz 16-bit WAV of a video; an existing file is used again."""
    if not os.path.exists(wav):
        run_program([program, "-y", "-i", video, "-vn", "-ac", "1", "-ar", "16000", "-c:a", "pcm_s16le", wav])
    return wav


def separate_voice(wav: str, out: str, separate: Callable[[str, str], None]) -> str:
    """The voice alone; used again while it is not older than its source."""
    if not (os.path.exists(out) and os.path.getmtime(out) >= os.path.getmtime(wav)):
        try:
            separate(wav, out)
        except Exception as e:  # noqa: BLE001 - whatever a model raises
            raise PipelineError(f"voice separation failed: {e}") from e
    return out


def speech_log(wav: str, program: str, model: str, max_speech: float = 6.0) -> str:
    """What the speech activity program reports on its error stream."""
    return run_program([program, "-vm", model, "-vmsd", str(max_speech), "-f", wav])[1]


class CliTranscriber:
    """Runs a transcription program per clip; reads its JSON. With a folder, answers are kept there by content and used again."""

    def __init__(self, program: str, model: str, options: tuple[str, ...] = (), folder: str | None = None):
        self.program, self.model, self.options, self.folder = program, model, options, folder

    def transcribe(self, wav: bytes) -> list[dict]:
        held = Path(self.folder, f"{hashlib.sha256(wav).hexdigest()}.json") if self.folder else None
        if held is not None and held.exists():
            return offsets_segments(held.read_text(encoding="utf-8"))
        with tempfile.TemporaryDirectory(prefix="cuelake-clip-") as scratch:
            base = f"{scratch}/clip"
            Path(f"{base}.wav").write_bytes(wav)
            run_program([self.program, "-m", self.model, *self.options, "-oj", "-of", base, "-f", f"{base}.wav"])
            text = Path(f"{base}.json").read_text(encoding="utf-8")
        if held is not None:
            held.parent.mkdir(parents=True, exist_ok=True)
            draft = held.with_name(f".{uuid.uuid4().hex}")
            draft.write_text(text, encoding="utf-8")
            draft.replace(held)
        return offsets_segments(text)


def offsets_segments(text: str) -> list[dict]:
    try:
        data = json.loads(text)
        out = [{"start": s["offsets"]["from"] / 1000.0, "end": s["offsets"]["to"] / 1000.0, "text": (s.get("text") or "").strip()} for s in data.get("transcription") or []]
    except (ValueError, KeyError, TypeError) as e:
        raise PipelineError(f"bad transcript: {e}") from e
    return [s for s in out if s["text"]]


def seconds_segments(payload: dict) -> list[dict]:
    out = []
    for s in payload.get("segments") or []:
        if text := (s.get("text") or "").strip():
            try:
                out.append({"start": float(s["start"]), "end": float(s["end"]), "text": text})
            except (KeyError, TypeError, ValueError) as e:
                raise PipelineError(f"bad segment times: {e}") from e
    return out


class ServerTranscriber:
    """Starts a transcription server (unless one is given) and posts clips to it."""

    def __init__(self, command: list[str] | None, host: str = "127.0.0.1", port: int = 8080, startup: float = 60.0, request: float = 300.0, fields: dict | None = None):
        self.url, self.request, self.fields = f"http://{host}:{port}/inference", request, fields or {"response_format": "verbose_json"}
        self.process = subprocess.Popen(command, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL) if command else None
        if self.process:
            self._wait(host, port, startup)

    def _wait(self, host: str, port: int, limit: float) -> None:
        until = time.monotonic() + limit
        while time.monotonic() < until:
            if self.process.poll() is not None:
                raise PipelineError("the server ended while starting")
            try:
                socket.create_connection((host, port), timeout=0.5).close()
                return
            except OSError:
                time.sleep(0.5)
        self.close()
        raise PipelineError("the server did not start in time")

    def transcribe(self, wav: bytes) -> list[dict]:
        edge = uuid.uuid4().hex
        parts = [f'--{edge}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in self.fields.items()]
        parts.append(f'--{edge}\r\nContent-Disposition: form-data; name="file"; filename="clip.wav"\r\nContent-Type: audio/wav\r\n\r\n'.encode() + wav + f"\r\n--{edge}--\r\n".encode())
        call = urllib.request.Request(self.url, b"".join(parts), {"Content-Type": f"multipart/form-data; boundary={edge}"})
        try:
            with urllib.request.urlopen(call, timeout=self.request) as answer:  # noqa: S310 - the address is the caller's own
                return seconds_segments(json.load(answer))
        except (OSError, ValueError) as e:
            raise PipelineError(f"the server failed: {e}") from e

    def close(self) -> None:
        if self.process and self.process.poll() is None:
            self.process.terminate()
            try:
                self.process.wait(5)
            except subprocess.TimeoutExpired:
                self.process.kill()


def make_transcriber(mode: str, **settings) -> Callable[[], Transcriber]:
    """A factory that each task calls once."""
    if mode == "server":
        return lambda: ServerTranscriber(**settings)
    if mode == "cli":
        return lambda: CliTranscriber(**settings)
    raise ValueError(f"unknown mode {mode}: server or cli")


class FixedTranscriber:
    """A stand-in that answers by the clip's length."""

    def __init__(self, text: str = "speech", reach: float = 1.0):
        self.text, self.reach = text, reach

    def transcribe(self, wav: bytes) -> list[dict]:
        from ..sources.audio import wav_info

        return [{"start": 0.0, "end": wav_info(wav)[2] * self.reach, "text": self.text}]


class Reader(Protocol):
    """Text on a picture: dictionaries of box, text, angle and confidence."""

    def read(self, frame: bytes) -> list[dict]: ...


def chat_completion(url: str, key: str, model: str, temperature: float = 0.0, timeout: float = 120.0) -> Callable[[str], str]:
    """A completion function over a chat service's HTTP interface."""

    def complete(prompt: str) -> str:
        body = json.dumps({"model": model, "temperature": temperature, "messages": [{"role": "user", "content": prompt}]}).encode()
        call = urllib.request.Request(f"{url.rstrip('/')}/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(call, timeout=timeout) as answer:  # noqa: S310 - the address is the caller's own
            return json.load(answer)["choices"][0]["message"]["content"] or ""

    return complete
