"""Exact document deduplication, native DataFrame operations only.

Rows whose texts are equal once ASCII white space is deleted form a group. A 128-bit hash
keys the groups and the bytes themselves are part of the aggregation key, so two texts that
collide in the hash never share a group.

Defined results: a null text counts as empty, and all empty or white-space-only texts are
one group. Of a group the row with the most code points in its original text stays, then
the one with the smallest id; a null id counts as larger than any other. Repeated rows with
the same id and length as the row that stays are all marked kept, as nothing tells them
apart. An empty table gives an empty result. Input columns other than id and text are not
read, so their names never clash with the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, staged, table, text_of


def normalised(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct normalised text: h, norm, n, keep (struct of least, no_id, id)."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.length(text).alias("len"), normalised(text).alias("norm"))
    # The partial aggregation merges copies within each map task, so a hot group sends one row per task.
    return (
        rows.withColumn("h", F.unhex(F.md5("norm")))
        .groupBy("h", "norm")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("len")).alias("least"), F.col("id").isNull().alias("no_id"), "id")).alias("keep"))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    The groups are staged without their texts. Rows find their group by hash; only for
    hashes that several different texts share (none, in practice) rows are matched by bytes.
    """
    groups = staged(
        exact_groups(docs, id_col, text_col).select("h", "n", "keep", F.sha2("norm", 256).alias("text_sha256"), F.xxhash64("norm").alias("x")),
        "exact-groups",
    )
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.length(text).alias("len"), normalised(text).alias("norm")).withColumn("h", F.unhex(F.md5("norm")))
    collided = groups.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("h")
    if collided.isEmpty():
        found = rows.drop("norm").join(groups.drop("x"), "h")
    else:
        plain = rows.join(collided, "h", "left_anti").drop("norm").join(groups.drop("x"), "h")
        exact = exact_groups(docs, id_col, text_col).join(collided, "h", "left_semi").withColumn("text_sha256", F.sha2("norm", 256))
        found = plain.unionByName(rows.join(exact, ["h", "norm"]).drop("norm"))
    return found.select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("len") == -F.col("keep.least"))).alias("kept"),
        "text_sha256",
    )


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents),
g AS (
  SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM g
"""
