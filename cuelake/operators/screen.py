"""On-screen text: filters on detections and events, merging within frames, events over time.

A detection has video_id, ord, frame_time, box (x1, y1, x2, y2), text, angle and confidence; an event start and end
instead of a frame time, and frame_count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_text, matches_whole, plain_similarity, strip
from ..functions.timing import ROW_CENTRE, boxes_adjacent
from .common import stream_groups

KEYS = ("video_id",)
# Texts that are never dialogue.
BLOCKLIST_PATTERNS = (r"[!?.…\s\(\)\[\]\{\}]+", r"[0-9\s]+", r"[A-Za-z0-9\(\)\s'!?.~-]{1,15}", r"[ㅋㅎㅠㅜ]+")


def blocked(text: Column, texts: Sequence[str] = (), patterns: Sequence[str] = BLOCKLIST_PATTERNS) -> Column:
    """Why a text is blocked: blocklisted, pattern_match, or null."""
    bare = strip(text)
    reason = F.when(F.lower(bare).isin([t.strip().lower() for t in texts]), "blocklisted") if texts else F.when(F.lit(False), "blocklisted")
    for p in patterns:
        reason = reason.when(matches_whole(bare, p), "pattern_match")
    return reason


def drop_blocked(detections: DataFrame, texts: Sequence[str] = (), patterns: Sequence[str] = BLOCKLIST_PATTERNS) -> DataFrame:
    """Detections with a text that isn't blocked; the text stays as it is."""
    return detections.filter((strip(F.col("text")) != "") & blocked(F.col("text"), texts, patterns).isNull())


def reject_reason(frame_height: Column, min_confidence: float = 0.84, min_ratio: float = 0.02, max_ratio: float = 1.0, min_length: int = 2, texts: Sequence[str] = (), patterns: Sequence[str] = BLOCKLIST_PATTERNS, min_duration: float | None = None, max_duration: float | None = None) -> Column:
    """The first rule that an event fails, or null. Duration limits are off unless given."""
    ratio = (F.col("box.y2") - F.col("box.y1")) / frame_height
    rules = F.when(frame_height <= 0, F.raise_error(F.lit("frame height must be positive")))
    if min_duration is not None:
        rules = rules.when(F.col("end") - F.col("start") < min_duration, "too_short")
    if max_duration is not None:
        rules = rules.when(F.col("end") - F.col("start") > max_duration, "too_long")
    rules = rules.when(F.col("confidence") < min_confidence, "low_confidence").when(ratio < min_ratio, "box_too_small").when(ratio > max_ratio, "box_too_large")
    return rules.when(F.length(strip(F.col("text"))) < min_length, "text_too_short").otherwise(blocked(F.col("text"), texts, patterns))


def filter_events(events: DataFrame, frame_height: int | Column, **limits) -> DataFrame:
    """Events that fail no rule. A frame height that isn't positive is an error, whatever there is to filter."""
    if not isinstance(frame_height, Column):
        if frame_height <= 0:
            raise ValueError("frame height must be positive")
        frame_height = F.lit(frame_height)
    return events.filter(reject_reason(frame_height, **limits).isNull())


def drop_summary(events: DataFrame, frame_height: Column, keys: Sequence[str] = KEYS, **limits) -> DataFrame:
    return events.withColumn("reason", F.coalesce(reject_reason(frame_height, **limits), F.lit("kept"))).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def repeated_texts(events: DataFrame, most: int = 8, keys: Sequence[str] = KEYS, folded: bool = False) -> DataFrame:
    """keys, text, n of texts that occur more than `most` times; none if `most` is not positive."""
    text = fold_text(F.col("text")) if folded else F.col("text")
    return events.groupBy(*keys, text.alias("text")).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > most) & F.lit(most > 0))


def drop_repeated(rows: DataFrame, events: DataFrame, most: int = 8, keys: Sequence[str] = KEYS, folded: bool = False) -> DataFrame:
    """rows without the texts that events repeat too often. The aggregated texts are few next to the rows."""
    bad = repeated_texts(events, most, keys, folded).select(*keys, F.col("text").alias("repeated"))
    key = fold_text(F.col("text")) if folded else F.col("text")
    return rows.withColumn("repeated", key).join(bad, [*keys, "repeated"], "left_anti").select(*rows.columns)


def pad_events(events: DataFrame, padding: float = 0.25) -> DataFrame:
    """Events widened on both sides, not below zero; unchanged if padding is not positive."""
    if padding <= 0:
        return events
    return events.withColumns({"start": F.greatest(F.lit(0.0), F.col("start") - padding), "end": F.col("end") + padding})


def events_to_cues(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return events.select(*keys, "ord", "start", "end", "text", F.lit(None).cast("string").alias("source_hint"))


def shift_detections(detections: DataFrame, chunks: DataFrame, on: Sequence[str] = KEYS) -> DataFrame:
    return detections.join(chunks.select(*on, "offset"), list(on)).withColumn("frame_time", F.col("frame_time") + F.col("offset")).drop("offset")


def adjacent_pairs(detections: DataFrame, keys: Sequence[str] = (*KEYS, "frame_time")) -> DataFrame:
    """Pairs (a_ord < b_ord) of neighbouring boxes in a frame."""
    side = lambda n: detections.select(*keys, F.col("ord").alias(f"{n}_ord"), F.col("box").alias(f"{n}_box"))
    pairs = side("a").join(side("b"), list(keys)).filter(F.col("a_ord") < F.col("b_ord"))
    return pairs.filter(boxes_adjacent(F.col("a_box"), F.col("b_box")))


def _near(a: dict, b: dict) -> bool:
    height = min(a["y2"] - a["y1"], b["y2"] - b["y1"])
    x = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])
    y = min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
    width = min(a["x2"] - a["x1"], b["x2"] - b["x1"])
    return height > 0 and (y >= 0.3 * height and -x <= height or x >= 0.5 * width and -y <= height)


def lines_of(group: list[dict]) -> str:
    """Texts of boxes as lines from top to bottom, each from left to right."""
    x_mid, y_mid = lambda d: (d["box"]["x1"] + d["box"]["x2"]) / 2, lambda d: (d["box"]["y1"] + d["box"]["y2"]) / 2
    height = lambda d: d["box"]["y2"] - d["box"]["y1"]
    rows: list[list[dict]] = []
    for d in sorted(group, key=lambda d: (y_mid(d), x_mid(d))):
        home = next((r for r in rows if abs(y_mid(d) - y_mid(r[0])) <= ROW_CENTRE * min(height(d), height(r[0]))), None)
        if home is None:
            rows.append([d])
        else:
            home.append(d)
    return "\n".join(" ".join(d["text"] for d in sorted(r, key=x_mid)) for r in rows)


def merge_frames(detections: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One detection per frame: the longest text (the first of equals) and all that is connected to it by neighbouring boxes."""

    def merge(key, rows):
        frame = list(rows)  # what one frame shows is bounded by its picture
        start = max(range(len(frame)), key=lambda i: (len(frame[i]["text"]), -i))
        group, edge = {start}, [start]
        while edge:
            at = edge.pop()
            new = [i for i in range(len(frame)) if i not in group and _near(frame[i]["box"], frame[at]["box"])]
            group.update(new)
            edge += new
        some = [frame[start], *(frame[i] for i in sorted(group - {start}))]
        top = min(some, key=lambda d: (d["box"]["y1"] + d["box"]["y2"], d["box"]["x1"] + d["box"]["x2"]))
        box = {c: (min if c.endswith("1") else max)(d["box"][c] for d in some) for c in ("x1", "y1", "x2", "y2")}
        ranked = sorted(some, key=lambda d: (d["box"]["y1"] + d["box"]["y2"], d["box"]["x1"] + d["box"]["x2"]))
        yield dict(zip((*keys, "frame_time"), key)) | {"ord": min(d["ord"] for d in some), "box": box, "text": lines_of(some), "angle": top["angle"], "confidence": sum(d["confidence"] for d in ranked) / len(ranked), "merged": len(some)}

    kinds = ", ".join(f"{k} {detections.schema[k].dataType.simpleString()}" for k in keys)
    return stream_groups(detections, (*keys, "frame_time"), ("ord",), merge, f"{kinds}, frame_time double, ord long, box struct<x1 int, y1 int, x2 int, y2 int>, text string, angle double, confidence double, merged long")


def plain_iou(a: dict, b: dict) -> float:
    w, h = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]), min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    return w * h / (area(a) + area(b) - w * h)


def group_detections(detections: DataFrame, least_text: float = 0.8, least_iou: float = 0.5, most_gap: float = 1.5, strict_gap: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Events: runs of detections like an open event's first one in text and place.

    A detection joins the open event of most similar text among those whose box matches, else
    opens one. Events are closed after it once their last detection is more than most_gap
    older, so the first detection after a silence may still join; strict_gap closes them
    before. Detections pass as a stream by time; only open events are held.
    Result: keys, ord (by start), start, end, box, text, frame_count, confidence.
    """

    def follow(key, rows):
        opened: list[dict] = []
        number = 0

        def close(e):
            return dict(zip(keys, key)) | {"ord": e["ord"], "start": e["start"], "end": e["end"], "box": e["box"], "text": e["text"], "frame_count": e["n"], "confidence": e["sum"] / e["n"]}

        for d in rows:
            t = d["frame_time"]
            if strict_gap:
                yield from (close(e) for e in opened if t - e["end"] > most_gap)
                opened = [e for e in opened if t - e["end"] <= most_gap]
            best, score = None, 0.0
            for e in opened:
                if plain_iou(d["box"], e["box"]) >= least_iou:
                    s = plain_similarity(d["text"], e["text"])
                    if s >= least_text and s > score:
                        best, score = e, s
            if best:
                best["end"], best["n"], best["sum"] = t, best["n"] + 1, best["sum"] + d["confidence"]
            else:
                opened.append({"ord": number, "start": t, "end": t, "box": d["box"], "text": d["text"], "n": 1, "sum": d["confidence"]})
                number += 1
            if not strict_gap:
                yield from (close(e) for e in opened if t - e["end"] > most_gap)
                opened = [e for e in opened if t - e["end"] <= most_gap]
        yield from map(close, opened)

    kinds = ", ".join(f"{k} {detections.schema[k].dataType.simpleString()}" for k in keys)
    rows = detections.withColumn("x1", F.col("box.x1"))
    return stream_groups(rows, keys, ("frame_time", "x1", "ord"), follow, f"{kinds}, ord long, start double, end double, box struct<x1 int, y1 int, x2 int, y2 int>, text string, frame_count long, confidence double")


# --- arithmetic around recognition -----------------------------------------------------------


def sampled(frames: DataFrame, fps: Column, sample_fps: float = 3.0) -> DataFrame:
    """Every n-th frame, n being fps / sample_fps rounded half to even, 1 at least; frame_time is its time."""
    step = F.greatest(F.lit(1), F.bround(fps / sample_fps, 0).cast("int"))
    return frames.filter(F.col("frame_no") % step == 0).withColumn("frame_time", F.col("frame_no") / fps)


def crop_box(width: Column, height: Column, top: float = 0.0, bottom: float = 0.0, left: float = 0.0, right: float = 0.0) -> Column:
    """The part of a frame that is read; an empty one is an error."""
    part = lambda size, share: F.floor(size * share).cast("int")
    box = F.struct(part(width, left).alias("x1"), part(height, top).alias("y1"), (width - part(width, right)).cast("int").alias("x2"), (height - part(height, bottom)).cast("int").alias("y2"))
    return F.when((box["x2"] > box["x1"]) & (box["y2"] > box["y1"]), box).otherwise(F.raise_error(F.lit("nothing is left of the frame")).cast("struct<x1:int,y1:int,x2:int,y2:int>"))


def boxes_by_area(boxes: DataFrame, keys: Sequence[str] = ("video_id", "frame_time")) -> DataFrame:
    """Boxes worth reading (5 pixels each way, 100 in area), with their rank in the frame, the largest first."""
    w, h = F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1")
    return boxes.filter((w >= 5) & (h >= 5) & (w * h >= 100)).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy((w * h).desc(), "ord")))


def folded_angle(angle: Column) -> Column:
    """A box angle brought to -45 .. 45 degrees."""
    turned = F.when(angle < -45, angle + 90).otherwise(angle)
    return F.when(turned > 45, turned - 90).otherwise(turned)


def ctc_decode(steps: Column, alphabet: Column) -> Column:
    """Text and confidence of per-step class probabilities (array of arrays; class 0 is blank).

    Equal neighbours collapse, a blank parts them; the confidence is the mean of the probabilities of what is emitted.
    """
    best = F.transform(steps, lambda p: F.struct((F.array_position(p, F.array_max(p)) - 1).cast("int").alias("c"), F.array_max(p).alias("p")))
    flagged = F.transform(best, lambda x, i: F.struct(x["c"].alias("c"), x["p"].alias("p"), F.when(i == 0, -1).otherwise(F.get(best, i - 1)["c"]).alias("before")))
    kept = F.filter(flagged, lambda x: (x["c"] != 0) & (x["c"] != x["before"]))
    text = F.array_join(F.transform(kept, lambda x: F.get(alphabet, x["c"])), "")
    mean = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["p"]) / F.size(kept)
    return F.struct(text.alias("text"), F.when(F.size(kept) > 0, mean).otherwise(0.0).alias("confidence"))
