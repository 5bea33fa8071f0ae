"""Durable intermediate tables and row numbers in a global order without one large task."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_open = threading.local()


def work_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session (tests) takes a folder under its
    warehouse; on a cluster that is an error, as nothing shared can be guessed.
    The application's tables in it go when it ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{root.rstrip('/')}/durable-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if at_exit:
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    else:
        fs.delete(at, True)


def durable(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder, so that a lost executor costs rereading.

    It is deleted when the innermost scope ends, or with the application.
    """
    spark, seen = df.sparkSession, getattr(_open, "roots", set())
    root = work_dir(spark)
    if root not in seen:
        _delete(spark, root, at_exit=True)
        _open.roots = {*seen, root}
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for tables in getattr(_open, "scopes", [])[-1:]:
        tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[None]:
    """Delete at its end what was made durable inside; for work whose results are written by then."""
    _open.scopes = [*getattr(_open, "scopes", []), tables := []]
    try:
        yield
    finally:
        _open.scopes = _open.scopes[:-1]
        for spark, path in tables:
            _delete(spark, path)


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """df with ``name``: 1, 2, ... in the given (total) order.

    Rows are range-partitioned (spark.sql.shuffle.partitions, coalesced to the
    data), sorted and numbered in their partitions; only the number of rows of
    each partition reaches the driver. Where rows are wide, number their keys.
    """
    kept = durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = {r["_part"]: r["n"] for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    base, total = {}, 0
    for p in sorted(counts):
        base[p], total = total, total + counts[p]
    if not base:
        return kept.drop("_part", "_at").withColumn(name, F.lit(0).cast("bigint"))
    start = F.create_map(*[x for p, b in base.items() for x in (F.lit(p), F.lit(b).cast("bigint"))])
    return kept.withColumn(name, start[F.col("_part")] + F.col("_at") + 1).drop("_part", "_at")


def number_within(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with ``name``: 1, 2, ... within each group, whose size does not matter: rows are numbered
    over all groups, and a group's numbers begin after its least."""
    numbered = number_rows(df, [*groups, *order], "_all")
    first = numbered.groupBy(*groups).agg(F.min("_all").alias("_least"))
    same = None
    for g in groups:
        one = F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        same = one if same is None else same & one
    first = first.withColumnsRenamed({g: f"_g_{g}" for g in groups})
    return numbered.join(first, same).withColumn(name, F.col("_all") - F.col("_least") + 1).drop("_all", "_least", *[f"_g_{g}" for g in groups])
