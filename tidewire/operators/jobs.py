"""Snapshot jobs, leases and handshakes as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOB = ["peer_region", "table_name"]


def snapshots_needed(tables: DataFrame, cursors: DataFrame, jobs: DataFrame) -> DataFrame:
    """(peer, table) pairs without a cursor event and without a finished job, with the key to resume at."""
    c = cursors.where(F.coalesce("last_event_id", F.lit("")) != "").select(*JOB)
    j = jobs.select(*JOB, "status", F.col("last_pk").alias("resume_pk"))
    out = tables.select(*JOB).join(c, JOB, "left_anti").join(j, JOB, "left")
    return out.where(F.coalesce(F.col("status") != "finished", F.lit(True))).select(*JOB, F.coalesce("status", F.lit("pending")).alias("status"), "resume_pk")


def pending_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where("finished_at IS NULL").orderBy(*JOB)


def checkpoint(jobs: DataFrame, marks: DataFrame) -> DataFrame:
    """jobs after checkpoints (status, last_pk, watermark_at); finished jobs stay, a null watermark keeps the old."""
    m = marks.select(*JOB, F.col("status").alias("s"), F.col("last_pk").alias("k"), F.col("watermark_at").alias("w"))
    moves = F.col("finished_at").isNull() & F.col("s").isNotNull()
    pick = lambda new, old: F.when(moves, new).otherwise(F.col(old)).alias(old)
    return jobs.join(m, JOB, "left").select(*JOB, pick(F.col("s"), "status"), pick(F.col("k"), "last_pk"), pick(F.coalesce("w", "watermark_at"), "watermark_at"), "finished_at")


def lease_free(now: Column | float, owner: str) -> Column:
    """A lease can be taken when it has expired or is one's own."""
    now = now if isinstance(now, Column) else F.lit(now)
    return (F.col("expires_at") <= now) | (F.col("owner_id") == owner)


def acquire(leases: DataFrame, owner: str, now: float, ttl: float) -> DataFrame:
    """Every lease after ``owner`` tries to take it: generation rises only when the owner changes."""
    take = lease_free(now, owner)
    return leases.select(
        *[c for c in leases.columns if c not in ("owner_id", "generation", "expires_at")],
        F.when(take, F.lit(owner)).otherwise(F.col("owner_id")).alias("owner_id"),
        F.when(take & (F.col("owner_id") != owner), F.col("generation") + 1).otherwise(F.col("generation")).alias("generation"),
        F.when(take, F.lit(now + ttl)).otherwise(F.col("expires_at")).alias("expires_at"),
    )


def renew(leases: DataFrame, owner: str, generation: int, now: float, ttl: float) -> DataFrame:
    mine = (F.col("owner_id") == owner) & (F.col("generation") == generation) & (F.col("expires_at") > now)
    return leases.withColumn("expires_at", F.when(mine, F.lit(now + ttl)).otherwise(F.col("expires_at")))


def sweep(leases: DataFrame, now: float) -> DataFrame:
    return leases.where(F.col("expires_at") > now)


def handshake_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(table_name, side): the tables that only one side replicates."""
    mine = local.join(remote, "table_name", "left_anti").select("table_name", F.lit("local").alias("side"))
    return mine.unionByName(remote.join(local, "table_name", "left_anti").select("table_name", F.lit("remote").alias("side")))


def compatible(local: dict, remote: dict) -> None:
    """Raise ValueError unless both sides have the same table names and version."""
    a, b = set(local.get("tables", ())), set(remote.get("tables", ()))
    if a != b:
        raise ValueError(f"tables differ: only local {sorted(a - b)}, only remote {sorted(b - a)}")
    if local.get("version") != remote.get("version"):
        raise ValueError(f"versions differ: {local.get('version')} and {remote.get('version')}")


def admit(region: str, local: str, allowed: set[str] | None = None) -> None:
    """Raise ValueError unless a remote region may connect."""
    if not region or region == local or (allowed and region not in allowed):
        raise ValueError(f"region {region!r} may not connect")
