"""From changes to outbox batches: filters, event ids, fan-out, batching, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.numbering import number_rows, number_within
from ..spec import Mode, Op, PeerSpec, TableSpec


def allowed(mode: Mode | str, op: Column) -> Column:
    """Whether an operation passes a broadcast or apply mode."""
    if mode == Mode.INSERT_ONLY:
        return op == Op.INSERT.value
    return op != Op.DELETE.value if mode == Mode.UPSERT else F.lit(True)


def local_origin(df: DataFrame, spec: TableSpec, region: str) -> DataFrame:
    """Rows that the region owns; rows without an owner are dropped."""
    return df.where(F.col(spec.region_field) == region)


def to_events(changes: DataFrame, spec: TableSpec, region: str) -> DataFrame:
    """Changes (table columns, _op, _version) as events: _peer, _table, _pk and _event_id more."""
    pk = keys.pk_array(spec, changes.schema)
    out = changes.withColumns({"_peer": F.lit(region), "_table": F.lit(spec.name), "_pk": pk})
    return out.withColumn("_event_id", keys.event_id(spec.name, F.col("_pk"), F.col("_version"), F.col("_op")))


def eligible(peers: DataFrame, region: str) -> DataFrame:
    """Peers with a region and an endpoint other than this one."""
    return peers.where((F.coalesce("region", F.lit("")) != "") & (F.coalesce("endpoint", F.lit("")) != "") & (F.col("region") != region))


def eligible_peers(peers: list[PeerSpec], region: str) -> list[str]:
    return [p.region for p in peers if p.region and p.endpoint and p.region != region]


def fan_out(events: DataFrame, peers: list[str]) -> DataFrame:
    """One copy of each event per configured peer (_to): a projection, not a join."""
    return events.withColumn("_to", F.explode(F.array(*[F.lit(p) for p in peers]).cast("array<string>")))


def batches(events: DataFrame, size: int) -> DataFrame:
    """Events (_tx, _table, _ord) with _batch from 0 within a transaction, and _key.

    Polling pages (empty _tx) belong to the table of their first event,
    transactions to the key '' that all tables share. Where there are columns
    _to (events already fanned out) and _page (pages of one poll), they part
    groups as well. A transaction of any size is numbered in parallel.
    """
    by = [c for c in ("_to", "_tx", "_page") if c in events.columns]
    numbered = number_within(events, by, ["_ord"], "_at")
    first = events.where("_tx = ''").groupBy(*by).agg(F.min_by("_table", "_ord").alias("_first_table"))
    first = first.withColumnsRenamed({c: f"_k_{c}" for c in by})
    same = None
    for c in by:
        one = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        same = one if same is None else same & one
    batch = F.floor((F.col("_at") - 1) / size).cast("bigint")
    return numbered.join(first, same, "left").withColumns({"_batch": batch, "_key": F.coalesce("_first_table", F.lit(""))}).drop("_at", "_first_table", *[f"_k_{c}" for c in by])


def allocate(batch_rows: DataFrame, counters: DataFrame, start: int = 0) -> DataFrame:
    """Distinct batches (_to, _key, _tx, _batch, _first) with an id after ``start`` and the next sequences of (_to, _key).

    counters(peer_region, table_name, next_sequence) holds the next free number;
    a pair that it lacks starts at 1. The rows are sorted whole: give keys, and
    join what is wide back.
    """
    by = ["_to", "_key"]
    numbered = number_rows(batch_rows, [*by, "_first", "_batch"], "id")
    first = numbered.groupBy(*by).agg(F.min("id").alias("_least"))
    c = counters.select(F.col("peer_region").alias("_to"), F.col("table_name").alias("_key"), "next_sequence")
    at = first.join(c, by, "left").select(*by, (F.coalesce("next_sequence", F.lit(1)) - F.col("_least")).alias("_shift"))
    return numbered.join(at, by).withColumns({"sequence": F.col("id") + F.col("_shift"), "id": F.col("id") + F.lit(start)}).drop("_shift")


def sequence(batch_rows: DataFrame, counters: DataFrame) -> DataFrame:
    """Distinct batches with the next sequences of their peer and table."""
    return allocate(batch_rows, counters).drop("id")


def next_counters(sequenced: DataFrame, counters: DataFrame) -> DataFrame:
    """The counters after the sequences were given out."""
    used = sequenced.groupBy(F.col("_to").alias("peer_region"), F.col("_key").alias("table_name")).agg((F.max("sequence") + 1).alias("next_sequence"))
    return counters.unionByName(used).groupBy("peer_region", "table_name").agg(F.max("next_sequence").alias("next_sequence"))


def latest_cursors(changes: DataFrame) -> DataFrame:
    """For each table the version and key of its last change by order (not the largest version)."""
    return changes.groupBy("_table").agg(F.max_by(F.struct("_version", "_pk"), F.col("_ord")).alias("c")).select("_table", F.col("c._version").alias("last_version"), F.col("c._pk").alias("last_pk"))
