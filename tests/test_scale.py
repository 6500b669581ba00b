"""Plans and functions whose cost must not grow faster than their input."""

import difflib
import random
import time

import pytest

import __spark_entry__ as entry
from cuelake.functions import matching
from cuelake.functions.text import split_in_proportion, split_texts
from cuelake.operators.common import stream_groups


def _nodes(plan):
    plan = plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    yield plan
    for k in range(plan.children().size()):
        yield from _nodes(plan.children().apply(k))


@pytest.mark.parametrize(("name", "most"), [("vad_asr_assign", 0), ("vad_asr_cues", 2), ("process_whisper", 2), ("clip_to_vad", 1), ("timeline_shift", 1)])
def test_texts_move_once(spark, name, most):
    """Texts are shuffled when documents are joined, once (or once a branch, reused), and then only for cues of several texts."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        sent = [n.schema().json() for n in _nodes(plan) if n.nodeName() == "Exchange"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    own = [s for s in sent if '"text"' in s and "video_id" in s]
    documents = [s for s in sent if '"text"' in s and "video_id" not in s]
    assert len(own) <= max(most - 1, 0) and len(documents) <= most, sent


def test_ratio_is_difflibs():
    draw = random.Random(5)
    made = lambda n, k: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz가나다라마바사😀"[:k], weights=[1 / (x + 1) for x in range(k)], k=n))
    most, few = matching.MOST_PAIRS, matching.FEW
    try:
        for _ in range(300):
            k = draw.choice([1, 2, 5, 30, 34])
            a, b = made(draw.choice([0, 1, 20, 199, 200, 400]), k), made(draw.choice([0, 1, 20, 199, 200, 400]), k)
            if draw.random() < 0.4:
                at = draw.randrange(len(a) + 1)
                b = a[:at] + made(draw.randrange(9), k) + a[at + draw.randrange(9) :]
            matching.MOST_PAIRS, matching.FEW = draw.choice([1, 60, most]), draw.choice([1, 5, few])
            assert matching.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio(), (a, b)
    finally:
        matching.MOST_PAIRS, matching.FEW = most, few


def test_long_texts_are_compared_soon():
    draw = random.Random(2)
    a, b = ("".join(draw.choices("etaoinsrhldcumfpgwybvkxjqz", weights=[1 / (x + 1) ** 2 for x in range(26)], k=n)) for n in (60_000, 50_000))
    began = time.process_time()
    matching.ratio(a, b)
    # The library takes some seconds here.
    assert time.process_time() - began < 1.5


def test_rows_leave_arrow_a_few_at_a_time(spark):
    """Of a batch of many long rows a stream holds a few as Python objects."""
    rows = spark.range(0, 4000, 1, 1).selectExpr("0 AS k", "id", "concat(id, repeat('x', 20000)) AS text")

    def each(key, stream):
        import tracemalloc

        tracemalloc.start()
        n = sum(len(r["text"]) > 0 for r in stream)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        yield {"n": n, "peak": peak}

    found = stream_groups(rows, ("k",), ("id",), each, "n long, peak long").first()
    assert found.n == 4000 and found.peak < 20e6


def test_split_by_arrow(spark):
    text = "one two, three four. " * 40
    rows = [(text, [3, 9, 1]), (None, [1, 2]), ("가나 다라 마바", [1, 2]), ("", [1])]
    found = spark.createDataFrame(rows, "text string, sizes array<bigint>").coalesce(1).select(split_texts("text", "sizes").alias("p")).collect()
    assert [r.p for r in found] == [split_in_proportion(t or "", s) for t, s in rows]
