"""Settings of a run, with the defaults of the standard profile; from_mapping reads nested dictionaries (as YAML gives them)."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field
from typing import Any

from ..operators.screen import BLOCKLIST_PATTERNS


@dataclass(frozen=True)
class SegmentSettings:
    padding: float = 0.15
    merge_gap: float = 0.0
    min_segment_duration: float = 0.3
    max_batch_duration: float = 40.0  # 0: no batching
    silence_ms: int = 200
    min_coverage: float = 0.9


@dataclass(frozen=True)
class EnsembleSettings:
    enabled: bool = True
    secondary_model: str = ""
    secondary_port: int = 8081
    overlap_threshold: float = 0.4
    agree_threshold: float = 0.85
    hint_threshold: float = 0.5
    min_cue_duration: float = 0.5
    min_cue_chars: int = 2
    llm_adjudicate: bool = True
    llm_batch_size: int = 50


@dataclass(frozen=True)
class DiagnosticsSettings:
    enabled: bool = False
    abort_on_loop: bool = False
    save_intermediates: bool = False
    save_raw_whisper: bool = False


@dataclass(frozen=True)
class SpeechSettings:
    mode: str = "server"
    cli: str = ""
    server_exe: str = ""
    model: str = ""
    vad_model: str = ""
    language: str = "ko"
    beam_size: int = 3
    best_of: int = 3
    max_line_length: int = 30
    server_host: str = "127.0.0.1"
    server_port: int = 8080
    server_threads: int = 8
    server_startup_timeout: float = 60.0
    server_request_timeout: float = 300.0
    strategy: str = "vad_segments"
    vad_segments: SegmentSettings = field(default_factory=SegmentSettings)
    ensemble: EnsembleSettings = field(default_factory=EnsembleSettings)
    diagnostics: DiagnosticsSettings = field(default_factory=DiagnosticsSettings)


@dataclass(frozen=True)
class ActivitySettings:
    exe: str = ""
    model: str = ""
    max_merge_duration: float = 2.0
    max_speech_duration: float = 6.0


@dataclass(frozen=True)
class TranslationSettings:
    api_key: str = ""
    base_url: str = ""
    model: str = ""
    disable_thinking: bool = True
    source_language: str = "Korean"
    target_language: str = "English"
    batch_size: int = 100
    max_retries: int = 3
    min_split_size: int = 50
    context: str = ""


@dataclass(frozen=True)
class TranscriptionSettings:
    enabled: bool = True


@dataclass(frozen=True)
class ScreenFilterSettings:
    min_duration: float = 0.5  # read, but no rule uses it
    max_duration: float = 8.0  # read, but no rule uses it
    min_box_height_ratio: float = 0.02
    max_box_height_ratio: float = 1.0
    min_text_length: int = 2
    min_confidence: float = 0.84
    max_text_repeats: int = 8
    timestamp_padding: float = 0.25
    blocklist_texts: tuple[str, ...] = ()
    blocklist_patterns: tuple[str, ...] = BLOCKLIST_PATTERNS


@dataclass(frozen=True)
class ClutterSettings:
    enabled: bool = False
    model: str = ""
    batch_size: int = 100
    min_events: int = 5
    source_language: str = "Korean"
    content_type: str = "variety show"


@dataclass(frozen=True)
class ScreenSettings:
    enabled: bool = False
    det_model: str = ""
    rec_model: str = ""
    dict_file: str = ""
    providers: tuple[str, ...] = ("CPUExecutionProvider",)
    sample_fps: float = 2
    rec_confidence: float = 0.5
    llm_filter: ClutterSettings = field(default_factory=ClutterSettings)
    crop_top_ratio: float = 0.4
    crop_bottom_ratio: float = 0.05
    crop_left_ratio: float = 0.15
    crop_right_ratio: float = 0.15
    filter: ScreenFilterSettings = field(default_factory=ScreenFilterSettings)


@dataclass(frozen=True)
class MergeSettings:
    overlap_threshold: float = 0.3
    agree_threshold: float = 0.9
    hint_threshold: float = 0.5  # read, but never used
    fill_gaps: bool = True
    gap_fill_min_duration: float = 0.5
    gap_fill_prefix: str = ""
    parallel: bool = True  # read, but never used: Spark runs independent branches side by side


@dataclass(frozen=True)
class VoiceSettings:
    enabled: bool = False
    model: str = ""
    output_single_stem: str = "Vocals"
    model_dir: str = ""


@dataclass(frozen=True)
class Config:
    chunk_length_seconds: int = 600
    whisper: SpeechSettings = field(default_factory=SpeechSettings)
    vad: ActivitySettings = field(default_factory=ActivitySettings)
    translation: TranslationSettings = field(default_factory=TranslationSettings)
    transcription: TranscriptionSettings = field(default_factory=TranscriptionSettings)
    ocr: ScreenSettings = field(default_factory=ScreenSettings)
    merge: MergeSettings = field(default_factory=MergeSettings)
    uvr: VoiceSettings = field(default_factory=VoiceSettings)

    @property
    def overlap_threshold(self) -> float:
        return self.merge.overlap_threshold

    @property
    def agree_threshold(self) -> float:
        return self.merge.agree_threshold


def from_mapping(values: dict[str, Any] | None, kind: type = Config):
    """A settings object from a nested mapping; unknown names are passed over, lists become tuples."""
    out = {}
    for f in dataclasses.fields(kind):
        if values and f.name in values:
            v = values[f.name]
            default = f.default_factory() if f.default_factory is not dataclasses.MISSING else f.default
            out[f.name] = from_mapping(v, type(default)) if dataclasses.is_dataclass(default) else tuple(v or ()) if isinstance(default, tuple) else v
    return kind(**out)


def load(path: str, env: dict[str, str] | None = None) -> Config:
    """Config of a YAML file (if a YAML reader is installed) or a JSON file; the translation key may come from the environment."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        import json

        values = json.loads(text)
    else:
        values = yaml.safe_load(text)
    config = from_mapping(values)
    key = (env if env is not None else os.environ).get("TRANSLATION_API_KEY", "")
    return dataclasses.replace(config, translation=dataclasses.replace(config.translation, api_key=config.translation.api_key or key))


MODES = ("whisper", "ocr", "merged")


def with_mode(config: Config, mode: str) -> Config:
    """config with speech and screen reading switched by mode."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    return dataclasses.replace(config, transcription=TranscriptionSettings(mode != "ocr"), ocr=dataclasses.replace(config.ocr, enabled=mode != "whisper"))
