"""Speech sessions and on-screen events over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import plain_similarity
from ..operators.screen import plain_iou


def speech_sessions(segments: DataFrame, gap_seconds: float, late: str = "1 minute") -> DataFrame:
    """Sessions of a stream of segments (video_id, ts, seconds): a session lasts until no segment has begun within gap of its end.

    Each row's own length is part of its gap, so long segments hold their session open.
    """
    gap = F.concat(F.greatest(F.lit(0.001), F.col("seconds") + gap_seconds).cast("decimal(18,3)").cast("string"), F.lit(" seconds"))
    return segments.withWatermark("ts", late).groupBy("video_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("segments"), F.min("ts").alias("start"), F.max(F.col("ts") + F.make_dt_interval(secs=F.col("seconds").cast("decimal(18,6)"))).alias("end"))


STATE = "opened string"
EVENT = "video_id long, start double, end double, text string, frame_count long"


def detection_events(detections: DataFrame, least_text: float = 0.8, least_iou: float = 0.5, most_gap: float = 1.5) -> DataFrame:
    """Events of a stream of detections (video_id, frame_time, x1, y1, x2, y2, text), emitted once they can't grow.

    State is the open events of each video; micro-batches must come in order of time.
    """
    import json

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened = json.loads(state.get[0]) if state.exists else []
        closed = []
        for frame in frames:
            for d in frame.sort_values(["frame_time", "x1"]).to_dict("records"):
                best, score = None, 0.0
                for e in opened:
                    if plain_iou(d, e["box"]) >= least_iou and (s := plain_similarity(d["text"], e["text"])) >= least_text and s > score:
                        best, score = e, s
                t = float(d["frame_time"])
                if best:
                    best["end"], best["n"] = t, best["n"] + 1
                else:
                    opened.append({"start": t, "end": t, "text": d["text"], "n": 1, "box": {c: int(d[c]) for c in ("x1", "y1", "x2", "y2")}})
                closed += [e for e in opened if t - e["end"] > most_gap]
                opened = [e for e in opened if t - e["end"] <= most_gap]
        state.update((json.dumps(opened),))
        yield pd.DataFrame([{"video_id": key[0], "start": e["start"], "end": e["end"], "text": e["text"], "frame_count": e["n"]} for e in closed], columns=["video_id", "start", "end", "text", "frame_count"])

    return detections.groupBy("video_id").applyInPandasWithState(follow, EVENT, STATE, "append", GroupStateTimeout.NoTimeout)
