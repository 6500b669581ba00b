"""Map-only operators over Arrow batches: one Python function per batch of whole rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters per slice: bounds a worker's memory; a longer text is a slice of its own.
MOST_CHARS = 4 << 20


def text_slices(batch: pa.RecordBatch, name: str, size: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch and their texts: at most `size` rows and about MOST_CHARS characters each."""
    at = 0
    while at < batch.num_rows:
        texts, chars = [], 0
        for value in batch.column(name).slice(at, size):
            text = value.as_py()
            if texts and chars + len(text or "") > MOST_CHARS:
                break
            texts.append(text)
            chars += len(text or "")
        yield batch.slice(at, len(texts)), texts
        at += len(texts)


def map_texts(docs: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[list], dict[str, list]]], fields: list[tuple[str, T.DataType]], size: int = 512, keep: Sequence[str] = ()) -> DataFrame:
    """id_col, the columns in keep, and the given fields per row of docs.

    make() runs once per task and gives a function from a list of texts (None where null) to
    the columns' lists. Texts come in slices of at most `size` rows and about MOST_CHARS characters.
    Kept columns pass as they are; the text is handed over once even if it is kept.
    """
    held = [id_col, *(c for c in keep if c != text_col)]
    names = [f"__{k}" for k in range(len(held))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(held, names)], F.col(text_col).cast("string").alias("__text"))
    out_names = names + ["__text"] * (text_col in keep)
    schema = T.StructType([*(T.StructField(n, rows.schema[n].dataType) for n in out_names), *(T.StructField(n, t) for n, t in fields)])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [(n, to_arrow_type(t)) for n, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for part, texts in text_slices(batch, "__text", size):
                out = each(texts)
                columns = [*(part.column(n) for n in out_names), *(out[k] if isinstance(out[k], pa.Array) else pa.array(out[k], kind) for k, kind in kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=[*out_names, *(k for k, _ in kinds)])

    mapped = rows.mapInArrow(run, schema)
    back = dict(zip(names, held)) | {"__text": text_col}
    return mapped.select(*[F.col(n).alias(back[n]) for n in out_names], *[n for n, _ in fields])
