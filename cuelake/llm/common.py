"""Helpers that the corpus operators share: staged tables, column names, sizes."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, \t, \n, \v, \f, \r.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where it is unset, a local folder, but only on a local master."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        held = getattr(shared_dir, "own", None)
        if held is None:
            held = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="cuelake-")
        base = held
    path = f"{base.rstrip('/')}/cuelake-{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(_drop, spark, path)
    return path


_FOLDERS: set[str] = set()


def _drop(spark: SparkSession, path: str) -> None:
    """When the driver ends in good order, what it staged goes; results have been written by then."""
    with contextlib.suppress(Exception):
        remove(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there and outlives executors.

    Shuffle files of the finished job go once the driver has collected its garbage; free asks for
    that right away, for stages that shuffle in proportion to the input.
    """
    spark, schema, path = df.sparkSession, df.schema, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if free:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def count_within(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows: the size check before a broadcast."""
    return df.limit(most + 1).count() <= most


def maybe_broadcast(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, marked for broadcast if it has at most so many (slim) rows; else it is joined by shuffle."""
    return F.broadcast(df) if count_within(df, most) else df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table or folder, on whatever store holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete everything that this application staged; for long-lived applications, once results are written. At the driver's end it goes by itself."""
    remove(spark, shared_dir(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
