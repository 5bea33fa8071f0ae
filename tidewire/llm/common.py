"""Helpers that several operators share: durable intermediate tables, checked
broadcasts, connected components and deterministic sampling."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when it has at most this many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


#: On local file systems a side file with a checksum, which Parquet's pages have themselves, costs one
#: of the three processes that the JVM starts to set modes for a file; elsewhere this says nothing.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: The mark of a finished write, which nothing reads here, is a file more.
UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
_scopes = threading.local()


def work_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    It is spark.checkpoint.dir; where that is unset, a local session (tests)
    sets and uses a folder under its warehouse, and a cluster is an error, as
    no path that all its machines share can be guessed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        ctx = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = ctx.get() if ctx.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the rereading of files, not
    the work before them, and what was computed stays fixed.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _folders(spark, path)
    df.write.mode("append").options(**PLAIN_FILES, **UNMARKED).parquet(path)
    for scope in getattr(_scopes, "open", [])[-1:]:
        scope.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _folders(spark: SparkSession, path: str) -> None:
    """On a local file system, make the folders in which a write begins.

    Hadoop starts a process to set the mode of each folder that it makes itself. Until
    such a process runs its own program it has all the memory of the driver's JVM, which
    whoever adds up processes then counts twice.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        spark._jvm.java.io.File(f"{at.toUri().getPath()}/_temporary/0").mkdirs()


def _paths(df: DataFrame) -> set[str]:
    """The stashed tables that a plan reads; what else it reads is nobody's to delete here."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    of = lambda leaf: leaf.relation().location().rootPaths().mkString("\n").split("\n") if leaf.getClass().getSimpleName() == "LogicalRelation" else []
    mine = f"/tables-{df.sparkSession.sparkContext.applicationId}/"
    return {p for k in range(leaves.size()) for p in of(leaves.apply(k)) if mine in p}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that, when it returns, deletes the tables it stashed, but for those its result reads."""

    @wraps(operator)
    def run(*args, **kw) -> DataFrame:
        _scopes.open = [*getattr(_scopes, "open", []), made := []]
        try:
            out = operator(*args, **kw)
        finally:
            _scopes.open = _scopes.open[:-1]
        read = {p.rsplit("/", 1)[1] for p in _paths(out)}
        for spark, path in made:
            if path.rsplit("/", 1)[1] not in read:
                _delete(spark, path)
            else:
                for scope in _scopes.open[-1:]:
                    scope.append((spark, path))
        return out

    return run


def free(*stashed: DataFrame) -> None:
    """Delete stashed tables that nothing will read again."""
    for df in stashed:
        for path in _paths(df):
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all of this application's intermediate tables; call when results are written."""
    _delete(spark, work_dir(spark))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, nbytes: int = BROADCAST_BYTES) -> bool:
    """Whether a stashed table is proven small enough to broadcast.

    Rows and text bytes are counted, not estimated.
    """
    width = F.lit(0).cast("long")
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        width = width + (F.coalesce(F.length(F.to_json(F.struct(field.name))), F.lit(0)).cast("long") if kind in ("string", "binary", "array", "map", "struct") else F.lit(8))
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and size <= nbytes


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its counted size is within the bound, else as it is."""
    return F.broadcast(df) if small(df) else df


def row_key(*cols: Column) -> Column:
    """A 64-bit key of a row's contents; equal rows get equal keys."""
    return F.xxhash64(*cols)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32(doc_id as text) mod ``mod`` is ``rest`` (false for a null id)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): returns (node, component).

    component is the smallest node that a path of edges reaches. Only nodes
    with an edge to another node appear. Alternates large-star and small-star
    steps; minima are combined before each shuffle and written out, so the
    join that follows has two plain exchanges, which adaptive execution splits
    when a node has very many neighbours. Null ends are ignored.
    """
    e = (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e = stash(e, "edges")
    for _ in range(max_rounds):
        # large star: everything above a node moves to the least of its neighbours
        low = stash(
            e.select(F.col("b").alias("u"), F.col("b").alias("m"))
            .union(e.select(F.col("a").alias("u"), F.col("b").alias("m")))
            .groupBy("u")
            .agg(F.min("m").alias("m")),
            "low",
        )
        old = e
        e = stash(e.join(low, e.b == low.u).select("a", F.col("m").alias("b")).distinct(), "edges")
        free(old, low)
        # small star: a node's lower neighbours and itself move to the least of them
        low = stash(e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        up, old = e.join(low.select(F.col("a").alias("u"), "m"), F.col("a") == F.col("u")), e
        e = stash(
            up.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct(),
            "edges",
        )
        free(old, low)
        many, total = e.groupBy("a").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
        if many <= 1 and (not total or e.join(e.select(F.col("a").alias("r")), F.col("b") == F.col("r"), "left_semi").isEmpty()):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
