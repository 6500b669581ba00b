"""Spoken and on-screen text fused into one list of cues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_free_similarity
from ..functions.timing import overlap_ratio
from .common import interval_pairs, spans, stream_groups

KEYS = ("video_id",)


def _ratio():
    return overlap_ratio(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))


def candidate_pairs(spoken: DataFrame, shown: DataFrame, threshold: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Structs a (spoken) and b (shown) with ratio, where the shared time reaches threshold of the shorter.

    With a threshold of zero or less, pairs that share no time count too and all pairs of a list are met.
    """
    if threshold > 0:
        pairs = interval_pairs(spoken, shown, keys)
    else:
        x = spoken.select(*keys, F.struct(*spoken.columns).alias("a"))
        y = shown.select(*keys, F.struct(*shown.columns).alias("b"))
        pairs = x.join(y, list(keys)).select("a", "b")
    return pairs.withColumn("ratio", _ratio()).filter(F.col("ratio") >= threshold)


def greedy_matches(spoken: DataFrame, shown: DataFrame, threshold: float = 0.3, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, a_ord, b_ord, sim: each cue, in order, claims the free on-screen event of most shared time,
    then of most similar text, then the first in the list.

    Claims only touch each other within stretches of time that candidate intervals cover
    without a break, so each such stretch is its own group and passes as a stream.
    """
    pairs = candidate_pairs(spans(spoken, keys, "text"), spans(shown, keys, "text"), threshold, keys)
    scored = pairs.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), "ratio", label_free_similarity(F.col("a.text"), F.col("b.text")).alias("sim"), F.least("a.start", "b.start").alias("low"), F.greatest("a.end", "b.end").alias("high"))
    if threshold > 0:
        order = Window.partitionBy(*keys).orderBy("low", "a_ord", "b_ord")
        reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
        scored = scored.withColumn("new", F.when(F.col("low") < reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    else:
        scored = scored.withColumn("island", F.lit(0).cast("long"))

    def claim(key, rows):
        taken: set = set()
        now, options = None, []

        def settle():
            free = [r for r in options if r["b_ord"] not in taken and (r["ratio"] > 0 or r["sim"] > 0)]
            if free:
                best = max(free, key=lambda r: (r["ratio"], r["sim"], -r["b_ord"]))
                taken.add(best["b_ord"])
                yield dict(zip(keys, key)) | {"a_ord": best["a_ord"], "b_ord": best["b_ord"], "sim": best["sim"]}

        for r in rows:
            if now is not None and r["a_ord"] != now:
                yield from settle()
                options = []
            now = r["a_ord"]
            options.append(r)
        yield from settle()

    kinds = ", ".join(f"{k} {spoken.schema[k].dataType.simpleString()}" for k in keys)
    return stream_groups(scored.drop("low", "high", "new"), (*keys, "island"), ("a_ord", "b_ord"), claim, f"{kinds}, a_ord long, b_ord long, sim double")


def gap_fills(spoken: DataFrame, shown: DataFrame, threshold: float = 0.3, least: float = 0.5, prefix: str = "", keys: Sequence[str] = KEYS) -> DataFrame:
    """On-screen events of at least `least` seconds that no cue overlaps by threshold, as cues."""
    met = candidate_pairs(spans(spoken, keys), spans(shown, keys), threshold, keys).select(*[F.col(f"b.{k}").alias(k) for k in keys], F.col("b.ord").alias("ord")).distinct()
    return shown_cues(shown.join(met, [*keys, "ord"], "left_anti"), least, prefix, keys)


def shown_cues(shown: DataFrame, least: float = 0.5, prefix: str = "", keys: Sequence[str] = KEYS) -> DataFrame:
    """On-screen events of at least `least` seconds as cues."""
    return shown.filter(F.col("end") - F.col("start") >= least).select(*keys, "ord", "start", "end", F.concat(F.lit(prefix), "text").alias("text"), F.lit(None).cast("string").alias("source_hint"))


def fuse(spoken: DataFrame, shown: DataFrame, threshold: float = 0.3, agree: float = 0.9, fill_gaps: bool = True, least: float = 0.5, prefix: str = "", keys: Sequence[str] = KEYS) -> DataFrame:
    """Cues with source_hint: the on-screen text that was matched and is less similar than agree.

    Gap fills join the list, which is then ordered by start; lists without on-screen text keep their order.
    Lists without speech hold the on-screen events alone. Result: keys, ord, start, end, text, source_hint.
    """
    matched = greedy_matches(spoken, shown, threshold, keys).withColumnRenamed("a_ord", "ord")
    texts = shown.select(*keys, F.col("ord").alias("b_ord"), F.col("text").alias("shown_text"))
    hints = matched.filter(F.col("sim") < agree).join(texts, [*keys, "b_ord"]).select(*keys, "ord", F.col("shown_text").alias("source_hint"))
    cues = spoken.select(*keys, "ord", "start", "end", "text").join(hints, [*keys, "ord"], "left").withColumn("part", F.lit(0))
    voiced = spoken.select(*keys).distinct().withColumn("voiced", F.lit(True))
    if fill_gaps:
        unclaimed = shown.join(matched.select(*keys, F.col("b_ord").alias("ord")), [*keys, "ord"], "left_anti")
        cues = cues.unionByName(gap_fills(spoken, unclaimed, threshold, least, prefix, keys).withColumn("part", F.lit(1)))
    seen = shown.select(*keys).distinct().withColumn("seen", F.lit(True))
    rows = cues.join(voiced, list(keys), "left").join(seen, list(keys), "left")
    order = Window.partitionBy(*keys).orderBy(F.when(F.col("seen") | F.col("voiced").isNull(), F.col("start")), "part", "ord")
    return rows.select(*keys, (F.row_number().over(order) - 1).cast("long").alias("ord"), "start", "end", "text", "source_hint")
