"""Time stamps, intervals and boxes as Column expressions. Times are seconds unless named ms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp_to_ms(stamp: Column) -> Column:
    """HH:MM:SS,mmm as milliseconds; anything else raises."""
    part = lambda k: F.regexp_extract(stamp, r"\A\s*(\d+):(\d+):(\d+),(\d+)\s*\z", k)
    ms = ((part(1).cast("long") * 60 + part(2).cast("long")) * 60 + part(3).cast("long")) * 1000 + part(4).cast("long")
    return F.when(part(1) == "", F.raise_error(F.concat(F.lit("malformed time stamp: "), stamp)).cast("long")).otherwise(ms)


def ms_to_timestamp(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS,mmm with as many hours as there are; negative ones raise."""
    whole = lambda x, y: F.floor(x / y).cast("long")
    hours = F.when(ms >= 0, whole(ms, 3_600_000)).otherwise(F.raise_error(F.lit("negative time")).cast("long"))
    return F.format_string("%02d:%02d:%02d,%03d", hours, whole(ms % 3_600_000, 60_000), whole(ms % 60_000, 1000), ms % 1000)


def seconds_to_timestamp(seconds: Column) -> Column:
    """Rounded to milliseconds, halves to even."""
    return ms_to_timestamp(F.bround(seconds * 1000, 0).cast("long"))


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Shared length of [a, b] and [c, d]; negative if they are apart."""
    return F.least(b, d) - F.greatest(a, c)


def overlap_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Shared length over the shorter length; 0 where they don't share any."""
    shared, shorter = overlap(a, b, c, d), F.least(b - a, d - c)
    return F.when((shared > 0) & (shorter > 0), shared / shorter).otherwise(F.lit(0.0))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2)."""
    w, h = overlap(a["x1"], a["x2"], b["x1"], b["x2"]), overlap(a["y1"], a["y2"], b["y1"], b["y2"])
    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    both = F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


#: Shares of the smaller height or width that make boxes neighbours.
ROW_OVERLAP, STACK_OVERLAP, GAP, ROW_CENTRE = 0.3, 0.5, 1.0, 0.5


def boxes_adjacent(a: Column, b: Column) -> Column:
    """Side by side in a row, or one above the other, with a gap of at most the smaller height."""
    x, y = overlap(a["x1"], a["x2"], b["x1"], b["x2"]), overlap(a["y1"], a["y2"], b["y1"], b["y2"])
    height = F.least(a["y2"] - a["y1"], b["y2"] - b["y1"])
    width = F.least(a["x2"] - a["x1"], b["x2"] - b["x1"])
    row = (y >= height * ROW_OVERLAP) & (-x <= height * GAP)
    stack = (x >= width * STACK_OVERLAP) & (-y <= height * GAP)
    return (height > 0) & (row | stack)


def span_text(seconds: Column) -> Column:
    """A duration for people: 4.20s, 2m 4.20s, 1h 2m 4.20s."""
    h, m = F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int")
    s = F.format_string("%.2fs", seconds % 60)
    return F.when(seconds < 60, F.format_string("%.2fs", seconds)).when(seconds < 3600, F.format_string("%dm %s", m, s)).otherwise(F.format_string("%dh %dm %s", h, m, s))
