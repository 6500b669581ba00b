"""Near-duplicate documents by HyperMinHash over word shingles.

A document's set holds its distinct shingles of `words` words (A-Z in lower case, words
parted by ASCII white space). Two documents are linked if the Jaccard similarity of their
whole sets is at least `percent` / 100; the result gives each document its connected
component. Shingles are compared by 64-bit hashes, so a set is confirmed up to chance equal hashes.

1. Each document gets HyperMinHash registers and a 128-bit hash of its set. Documents with
   equal sets are one node from here on, however many there are.
2. Bands of compressed registers put nodes in buckets. In each bucket the node of the
   smallest id is paired with the others; the Jaccard estimate, corrected for chance
   collisions of registers, drops pairs that are far below the limit, and whole sets
   confirm the rest.
3. In buckets of three and more that still hold several components, links between those
   components are found by an exact prefix index: with shingles ordered from rare to
   frequent, two linked sets share one of their first few. Length and position rule out
   pairs inside the join, so that large groups emit no pairs that lie within one component
   or can't be links.

Defined results: null, empty and white-space-only texts have no shingles, are linked with
nothing and are their own component. A null id counts as larger than any other. Rows that
repeat an id and text are nodes of one set and get the same answer. An empty table gives an
empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import text_slices
from .common import maybe_broadcast, staged, table
from .components import components
from .shingles import HyperMinHash, shingle_sets

#: Bands times rows registers; a pair at similarity 0.85 shares no band with chance 5e-11, one at 0.8 with 5e-8.
BANDS, ROWS, MANTISSA = 32, 4, 10
#: Standard errors by which an estimate may lie below the limit before a pair is dropped unverified.
MARGIN = 6.0


def _signatures(words: int, id_type: T.DataType, with_sets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = HyperMinHash(BANDS * ROWS, MANTISSA)
        for batch in batches:
            for part, texts in text_slices(batch, "text", 512):
                sets = shingle_sets(texts, words)
                nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                out = {"id": part.column("id"), "text_hash": part.column("text_hash"), "n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array(nodes, pa.binary())}
                out["registers"] = pa.array([sketch.registers(s).tobytes() if len(s) else None for s in sets], pa.binary())
                if with_sets:
                    offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                    flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
                    out["shingles"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_pydict(out)

    fields = [T.StructField("id", id_type), T.StructField("text_hash", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("registers", T.BinaryType())]
    if with_sets:
        fields.append(T.StructField("shingles", T.ArrayType(T.LongType())))
    return run, T.StructType(fields)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, with_sets: bool = False) -> DataFrame:
    rows = _rows(docs, id_col, text_col)
    return rows.mapInArrow(*_signatures(words, rows.schema["id"].dataType, with_sets))


def first_id() -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")


def band_keys(registers: Column) -> Column:
    width = 2 * ROWS
    return F.array(*[F.xxhash64(F.lit(k), F.substring(registers, k * width + 1, width)) for k in range(BANDS)])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, limit = HyperMinHash(BANDS * ROWS, MANTISSA), percent / 100
        least = limit - MARGIN * (limit * (1 - limit) / sketch.buckets) ** 0.5
        for batch in batches:
            keep = []
            cols = {k: batch.column(k) for k in ("ra", "rb", "sa", "sb")}
            regs = [np.frombuffer(b"".join(cols[k].to_pylist()), np.uint16).reshape(-1, sketch.buckets) for k in ("ra", "rb")]
            guess = sketch.estimate((regs[0] == regs[1]).sum(axis=1), np.array([len(x) for x in cols["sa"]])) if batch.num_rows else np.empty(0)
            for k in range(batch.num_rows):
                ok = False
                if guess[k] >= least:
                    a, b = cols["sa"][k].values.to_numpy(), cols["sb"][k].values.to_numpy()
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    ok = 100 * both >= percent * (len(a) + len(b) - both)
                keep.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("registers").alias(f"r{k}"), F.col("shingles").alias(f"s{k}"))
    # The hint keeps arrays out of broadcasts; a hot pivot's partitions can be split.
    joined = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return joined.select("a", "b", "ra", "rb", "sa", "sb").mapInArrow(_verify(percent), "a binary, b binary")


def _prefix_pairs(sets: DataFrame, unresolved: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes in different components that can be links, by an exact prefix index.

    unresolved: node, root. For a similarity of t a set of n shingles has its probed prefix of
    n - ceil(t n) + 1 and its indexed prefix of n - ceil(2 t / (1 + t) n) + 1 shingles in an
    order from rare to frequent; a pair is met where the set that is not larger is indexed.
    """
    own = sets.join(unresolved, "node").select("node", "root", "n", "shingles")
    own = staged(own, "unresolved")
    each = own.select("node", F.explode("shingles").alias("shingle"))
    counts = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(counts, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("order"))
    n = F.col("n")
    probed = n - F.floor((n * percent + 99) / 100) + 1
    indexed = n - F.floor((2 * percent * n + 99 + percent) / (100 + percent)) + 1
    heads = staged(
        own.select("node", "root", "n").join(ranked, "node").withColumn("probed", probed.cast("int")).withColumn("indexed", indexed.cast("int"))
        .select("node", "root", "n", "indexed", F.posexplode(F.slice("order", F.lit(1), F.col("probed"))).alias("at", "s"))
        .select("node", "root", "n", "indexed", "at", F.col("s.shingle").alias("shingle")),
        "prefixes",
    )
    x = heads.select("shingle", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    y = heads.filter("at < indexed").select("shingle", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    # percent * (n_a + n_b) / (100 + percent) shingles must be shared; so many are left from here on at most.
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    can = (
        (F.col("root_a") != F.col("root_b"))
        & ((F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("a") != F.col("b"))))
        & (F.col("n_b") * 100 >= F.col("n_a") * percent)
        & (left * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
    )
    met = x.join(y.hint("merge"), (x["shingle"] == y["shingle"]) & can)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: id_col, n_shingles, component_id, kept."""
    signed = staged(signatures(docs, id_col, text_col, words), "signatures")
    nodes = staged(
        signed.filter("n > 0").groupBy("node").agg(F.min(first_id()).alias("first"), F.first("n").alias("n"), F.first("registers").alias("registers")),
        "nodes",
    )
    keyed = nodes.select("node", F.col("first").alias("first"), F.explode(band_keys(F.col("registers"))).alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("first", "node")).alias("pivot")).filter("members > 1")
    members = staged(keyed.select("key", "node").join(buckets.select("key", "members", F.col("pivot.node").alias("pivot")), "key"), "buckets")

    wanted = maybe_broadcast(nodes.join(members.select("node").distinct(), "node", "left_semi").select("first.id", "first.text_hash"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text")).alias("d")
    rows = rows.join(wanted.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.text_hash") == F.col("w.text_hash")), "left_semi")
    # Rows that repeat an id and text are one row of sets, or prefixes would count their shingles several times.
    rows = rows.groupBy("id", "text_hash").agg(F.first("text").alias("text"))
    sets = staged(signatures(rows, "id", "text", words, with_sets=True).select("node", "n", "registers", "shingles"), "sets")

    stars = members.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    links = staged(verified(stars, sets, percent), "links")
    roots = components(links)
    large = members.filter("members > 2").join(roots.withColumnsRenamed({"a": "node", "b": "root"}), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = large.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    unresolved = staged(large.join(mixed, "key", "left_semi").select("node", "root").distinct(), "mixed")
    if not unresolved.isEmpty():
        more = staged(verified(_prefix_pairs(sets, unresolved, percent), sets, percent), "more-links")
        if not more.isEmpty():
            roots = components(roots.unionByName(more))

    place = nodes.select("node", "first").join(roots.withColumnsRenamed({"a": "node", "b": "root"}), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = place.groupBy("root").agg(F.min("first").alias("least"))
    found = staged(place.join(least, "root").select("node", F.col("least.id").alias("component_id")), "placed")
    out = signed.select("id", "n", "node").join(found, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op4_near_dedup(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents"), words=3, percent=85)
