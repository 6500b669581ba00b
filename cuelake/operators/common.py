"""Interval joins by time bins, and streaming over sorted groups."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timing import overlap

#: Seconds per bin of an interval join.
BIN = 30.0
#: Rows that leave Arrow at once, and characters of results that are held before they return to it: bounds a worker's memory.
ROWS, MOST_CHARS = 64, 1 << 20


def interval_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("video_id",), width: float = BIN) -> DataFrame:
    """Every pair of rows of a and b with equal keys whose intervals share time, as structs a and b.

    Both sides go to the time bins they touch and meet by (keys, bin), so one long video is
    spread over many tasks; a pair counts in the bin where its shared time begins, so none
    comes twice.
    """

    def binned(df: DataFrame, name: str) -> DataFrame:
        to = lambda t: F.floor(t / width).cast("long")
        some = df.filter(F.col("end") > F.col("start"))
        return some.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.struct(*df.columns).alias(name), F.explode(F.sequence(to(F.col("start")), to(F.col("end")))).alias(f"{name}_bin"))

    x, y = binned(a, "a"), binned(b, "b")
    on = F.col("a_bin") == F.col("b_bin")
    for k in keys:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    meet = (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    first = F.floor(F.greatest("a.start", "b.start") / width).cast("long") == F.col("a_bin")
    return x.join(y, on & meet & first).select("a", "b")


def maybe_broadcast(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, a slim table, marked for broadcast if it has at most so many rows; else it is joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spans(df: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """What an interval join needs of df; texts stay behind and are joined to its result by keys and ord."""
    return df.select(*keys, "ord", "start", "end", *more)


def shared_time():
    return overlap(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))


def stream_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], each: Callable[[tuple, Iterator[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """each(key, rows) over groups whose rows come in order as a stream; a group is never held as a whole."""
    spark = df.sparkSession
    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    del spark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    yield from batch.slice(at, ROWS).to_pylist()

        source = rows()
        held = next(source, None)
        out: list[dict] = []
        chars = 0
        while held is not None:
            key = tuple(held[k] for k in keys)
            state = [held]

            def group() -> Iterator[dict]:
                while state[0] is not None and tuple(state[0][k] for k in keys) == key:
                    row, state[0] = state[0], next(source, None)
                    yield row

            stream = group()
            for row in each(key, stream):
                out.append(row)
                chars += sum(len(x) for x in row.values() if isinstance(x, str))
                if len(out) >= 5000 or chars >= MOST_CHARS:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out, chars = [], 0
            for _ in stream:
                pass
            held = state[0]
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    return sorted_rows.mapInArrow(run, schema)
