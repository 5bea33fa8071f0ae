"""The durable outbox: enqueue, scans, windows, acknowledgement, retention, backlog.

A row is (id, peer_region, table_name, sequence, last_event_id, tx_id, payload, created_at).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPLAY_PAGE = 256
UNIQUE = ["peer_region", "table_name", "last_event_id"]


def valid(batch: DataFrame) -> Column:
    """A batch needs a peer, a positive sequence, events and the last event's id."""
    return (F.col("peer_region") != "") & (F.col("sequence") > 0) & (F.size("events") > 0) & (F.col("last_event_id") != "")


def consistent(batch: DataFrame) -> Column:
    """The stored last event id is that of the last event."""
    return F.try_element_at("events", F.lit(-1))["event_id"] == F.col("last_event_id")


def enqueue(outbox: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming batches that are new: not in the outbox by (peer, table, last event), first of their like."""
    own = Window.partitionBy(*UNIQUE).orderBy("sequence")
    once = incoming.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
    return once.join(outbox.select(*UNIQUE), UNIQUE, "left_anti").select(*incoming.columns)


def pending(outbox: DataFrame, peer: str, limit: int = 0) -> DataFrame:
    """A peer's batches by id; a limit of 0 or less means all."""
    rows = outbox.where(F.col("peer_region") == peer).orderBy("id")
    return rows.limit(limit) if limit > 0 else rows


def window(outbox: DataFrame, peer: str, after_id: int = 0, lower: datetime | None = None, upper: datetime | None = None, limit: int = 0) -> DataFrame:
    """A page with id > after_id and created_at in (lower, upper]; None is open, limit defaults to 256."""
    rows = outbox.where((F.col("peer_region") == peer) & (F.col("id") > after_id))
    if lower is not None:
        rows = rows.where(F.col("created_at") > F.lit(lower))
    if upper is not None:
        rows = rows.where(F.col("created_at") <= F.lit(upper))
    return rows.orderBy("id").limit(limit if limit > 0 else REPLAY_PAGE)


def live_tail(outbox: DataFrame, peer: str, watermark: datetime | None) -> DataFrame:
    """What comes after the live watermark; rows without a time always pass."""
    rows = outbox.where(F.col("peer_region") == peer)
    return rows if watermark is None else rows.where(F.col("created_at").isNull() | (F.col("created_at") > F.lit(watermark)))


def acknowledge(outbox: DataFrame, acks: DataFrame) -> DataFrame:
    """The outbox without the acknowledged batches; each ack names exactly one."""
    return outbox.join(acks.select(*UNIQUE), UNIQUE, "left_anti").select(*outbox.columns)


def expire(outbox: DataFrame, now: datetime, max_age: float) -> DataFrame:
    """Without batches older than max_age seconds; 0 or less keeps all."""
    if max_age <= 0:
        return outbox
    return outbox.where(F.col("created_at") >= F.lit(now) - F.make_dt_interval(secs=F.lit(max_age)))


def newest(outbox: DataFrame, most: int) -> DataFrame:
    """The newest batches by id of each peer, unacknowledged or not; 0 or less keeps all."""
    if most <= 0:
        return outbox
    by = Window.partitionBy("peer_region").orderBy(F.col("id").desc())
    return outbox.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most).drop("_n")


def metrics(outbox: DataFrame, now: datetime) -> DataFrame:
    """pending batches and the age in seconds of the oldest, never negative."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.min("created_at").cast("timestamp"))) / 1e6
    return outbox.agg(F.count("*").alias("pending"), F.greatest(F.lit(0.0), F.coalesce(age, F.lit(0.0))).alias("oldest_age_seconds"))
