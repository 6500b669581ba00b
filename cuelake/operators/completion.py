"""Batch operators around a completion function: clutter filter, adjudication, translation.

`complete` is any picklable function from a prompt to an answer; it runs on the executors,
once per batch of neighbouring rows. Prompts and parsers are plain functions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stream_groups

KEYS = ("video_id",)
Complete = Callable[[str], str]

# Markers that answers must repeat, and the fence that may surround an answer.
SEGMENT_MARK, CUE_MARK = "<<<SEG_{:03d}>>>", "<<<SRT_{:03d}>>>"
_SEGMENT, _CUE, _FENCE = re.compile(r"<<<SEG_(\d+)>>>"), re.compile(r"<<<SRT_(\d+)>>>"), re.compile(r"^```[a-zA-Z]*\s*|\s*```$")


class BatchFailed(Exception):
    """A batch could not be completed."""


def numbered(rows: DataFrame, size: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """rows with batch and place in it, in order of ord."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("ord")) - 1
    return rows.withColumn("n", n).withColumns({"batch": F.floor(F.col("n") / size).cast("long"), "place": (F.col("n") % size).cast("long")})


def bare(answer: str) -> str:
    return _FENCE.sub("", answer.strip()).strip()


def marked_parts(answer: str, mark: re.Pattern, expected: int) -> list[str] | None:
    """The stripped texts behind markers 1 to expected in order; None if the markers are others."""
    found = list(mark.finditer(answer))
    if [int(m[1]) for m in found] != list(range(1, expected + 1)):
        return None
    ends = [m.start() for m in found[1:]] + [len(answer)]
    return [answer[m.end() : e].strip() for m, e in zip(found, ends)]


# --- clutter ---------------------------------------------------------------------------------


def clutter_prompt(texts: Sequence[str], language: str = "Korean", content: str = "variety show") -> str:
    listed = "\n".join(f"[{i}] {t}" for i, t in enumerate(texts))
    return (
        f"These texts were read from the screen of a {language} {content}. Find those that are not dialogue: lone names and name tags, "
        "watermarks and logos or parts of them, scores and bare numbers, short meaningless Latin strings, effect texts, and misread characters. "
        "Keep dialogue, narration, descriptions of action and title cards; keep whatever is in doubt.\n"
        f'Answer with nothing but {{"drop": [numbers of the texts to drop]}}.\n\n{listed}\n'
    )


def parse_drops(answer: str, n: int) -> set[int]:
    """Numbers below n of an answer {"drop": [...]}; anything that isn't a whole number is passed over, anything malformed drops nothing."""
    try:
        data = json.loads(bare(answer))
    except ValueError:
        return set()
    drops = data.get("drop") if isinstance(data, dict) else None
    return {x for x in drops if type(x) is int and 0 <= x < n} if isinstance(drops, list) else set()


def clutter_filter(events: DataFrame, complete: Complete, batch_size: int = 100, min_events: int = 5, language: str = "Korean", content: str = "variety show", keys: Sequence[str] = KEYS) -> DataFrame:
    """events without those that the completion names; lists of fewer than min_events and failed batches stay whole."""
    keyed = numbered(events, batch_size, keys).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(*keys)))

    def judge(key, rows):
        batch = list(rows)
        try:
            drops = parse_drops(complete(clutter_prompt([r["text"] for r in batch], language, content)), len(batch))
        except Exception:  # noqa: BLE001 - whatever a service raises, its batch is kept
            drops = set()
        yield from (dict(zip(keys, key)) | {"ord": batch[i]["ord"]} for i in sorted(drops))

    kinds = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    slim = keyed.filter(F.col("total") >= min_events).select(*keys, "batch", "place", "ord", "text")
    drops = stream_groups(slim, (*keys, "batch"), ("place",), judge, f"{kinds}, ord long")
    return events.join(drops, [*keys, "ord"], "left_anti")


# --- adjudication ----------------------------------------------------------------------------


def adjudication_prompt(requests: Sequence[dict]) -> str:
    parts = []
    for i, r in enumerate(requests, 1):
        around = [f"{name}: {r[key]}" for name, key in (("BEFORE", "context_before"), ("AFTER", "context_after")) if r.get(key)]
        parts.append("\n".join([SEGMENT_MARK.format(i), *(around or ["(no context)"]), f"V3:  {r['primary_text']}", f"BAT: {r['secondary_text']}"]))
    return (
        "Two transcripts of the same Korean speech disagree. For each segment choose the better reading, or write the right one if both are wrong; the context may decide. "
        "Repeat every <<<SEG_NNN>>> marker once, unchanged and in order, each followed by the Korean text alone: no comments, no markup, no translation, nothing merged or split.\n\n"
        + "\n\n".join(parts) + "\n"
    )


def parse_adjudication(answer: str, n: int) -> dict[int, str]:
    """Texts by place; empty if the markers don't match, and without places whose text is empty."""
    parts = marked_parts(bare(answer), _SEGMENT, n)
    return {i: t for i, t in enumerate(parts) if t} if parts else {}


def adjudicate(requests: DataFrame, complete: Complete, batch_size: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, ord, resolved for pending rows (keys, ord, primary_text, secondary_text, context_before, context_after)."""

    def judge(key, rows):
        batch = list(rows)
        try:
            found = parse_adjudication(complete(adjudication_prompt(batch)), len(batch))
        except Exception:  # noqa: BLE001 - whatever a service raises, the primary texts stay
            found = {}
        yield from (dict(zip(keys, key)) | {"ord": batch[i]["ord"], "resolved": t} for i, t in found.items())

    kinds = ", ".join(f"{k} {requests.schema[k].dataType.simpleString()}" for k in keys)
    slim = numbered(requests, batch_size, keys).select(*keys, "batch", "place", "ord", "primary_text", "secondary_text", "context_before", "context_after")
    return stream_groups(slim, (*keys, "batch"), ("place",), judge, f"{kinds}, ord long, resolved string")


# --- translation -----------------------------------------------------------------------------


def translation_prompt(cues: Sequence[dict], source: str = "Korean", target: str = "English", context: str = "") -> str:
    hinted = any(c.get("source_hint") for c in cues)
    body = lambda c: f"[WHISPER] {c['text']}\n[OCR] {c['source_hint']}" if c.get("source_hint") else c["text"]
    parts = [f"Translate these {source} subtitles into natural {target}."]
    if context:
        parts.append(f"Context, for understanding only and not to be translated:\n{context}")
    parts.append(
        "Every <<<SRT_NNN>>> marker stands for one subtitle. Repeat each marker once, unchanged and in order, followed by its translation alone. "
        "Never merge or split subtitles, though neighbours may complete each other's sentences. Add no comments and no markup."
    )
    if hinted:
        parts.append(
            "Some subtitles have two readings of one moment: [WHISPER] was heard, [OCR] was read from the screen. If the second has nothing to do with the first, leave it out. "
            "If one corrects or rephrases the other, give the better one only: trust what was read for names and numbers, what was heard for grammar. "
            "If what was read adds a digit or a name in Latin letters, put its translation in square brackets on a line above. In doubt, give one line without brackets."
        )
    marked = "\n\n".join(f"{CUE_MARK.format(i)}\n{body(c)}" for i, c in enumerate(cues, 1))
    return "\n\n".join([*parts, marked]) + "\n"


def parse_translation(answer: str, n: int) -> list[str] | None:
    parts = marked_parts(answer.strip(), _CUE, n)
    return parts if parts is not None and all(parts) else None


def translate_batch(cues: Sequence[dict], complete: Complete, retries: int = 3, min_split: int = 50, **prompt) -> list[str]:
    """Translations of a batch; after `retries` failures it is halved, unless it has at most min_split cues."""
    text = translation_prompt(cues, **prompt)
    for _ in range(retries):
        try:
            if (found := parse_translation(complete(text), len(cues))) is not None:
                return found
        except Exception:  # noqa: BLE001, S110 - a failed call counts as an attempt
            pass
    if len(cues) <= min_split:
        raise BatchFailed(f"{len(cues)} cues failed {retries} times")
    half = len(cues) // 2
    return [*translate_batch(cues[:half], complete, retries, min_split, **prompt), *translate_batch(cues[half:], complete, retries, min_split, **prompt)]


def translate(cues: DataFrame, complete: Complete, batch_size: int = 100, retries: int = 3, min_split: int = 50, keys: Sequence[str] = KEYS, **prompt) -> DataFrame:
    """cues with their text translated and without hints; a batch that fails ends the query."""

    def judge(key, rows):
        batch = list(rows)
        for r, t in zip(batch, translate_batch(batch, complete, retries, min_split, **prompt), strict=True):
            yield dict(zip(keys, key)) | {"ord": r["ord"], "start": r["start"], "end": r["end"], "text": t}

    kinds = ", ".join(f"{k} {cues.schema[k].dataType.simpleString()}" for k in keys)
    slim = numbered(cues, batch_size, keys).select(*keys, "batch", "place", "ord", "start", "end", "text", "source_hint")
    return stream_groups(slim, (*keys, "batch"), ("place",), judge, f"{kinds}, ord long, start double, end double, text string")
