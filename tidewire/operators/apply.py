"""Applying events to a table: validity, order, staleness, last event per key, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.numbering import number_rows
from ..spec import Mode, Op, TableSpec
from .changefeed import allowed

#: Events whose prefix maxima one task takes at a time.
BLOCK = 100_000
META = ("_op", "_version", "_ord", "_peer", "_table", "_pk", "_event_id", "_changed", "_tx")


def valid(events: DataFrame) -> DataFrame:
    """events, failing if one lacks its peer, table, id or key."""
    sound = (F.coalesce("_peer", F.lit("")) != "") & (F.coalesce("_table", F.lit("")) != "") & (F.coalesce("_event_id", F.lit("")) != "") & (F.size("_pk") > 0)
    return events.where(F.when(sound, F.lit(True)).otherwise(F.raise_error(F.lit("event without peer, table, id or key")).cast("boolean")))


def passing(events: DataFrame, mode: Mode | str) -> DataFrame:
    """Events that the apply mode lets pass; an empty operation means upsert."""
    op = F.when(F.coalesce("_op", F.lit("")) == "", F.lit(Op.UPSERT.value)).otherwise(F.col("_op"))
    return events.withColumn("_op", op).where(allowed(mode, F.col("_op")))


def cursor_order(events: DataFrame) -> DataFrame:
    """events with _ord renumbered by peer, table, version, key and former order (polling batches only)."""
    return number_rows(events.withColumnRenamed("_ord", "_was"), ["_peer", "_table", "_version", "_pk", "_was"], "_ord").drop("_was")


def fresh(events: DataFrame, cursors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Events past the running cursor of their (peer, table).

    The cursor moves only forward, so it is the prefix maximum of (version,
    key) of the stored cursor and all earlier events, stale ones included.
    Maxima are taken per block of _ord, then over blocks, then within blocks:
    one large table does not need one large task.
    """
    at = F.struct(F.col("_version").alias("version"), F.col("_pk").alias("pk"))
    e = events.withColumns({"_at": at, "_block": F.floor(F.col("_ord") / block)})
    by = ["_peer", "_table"]
    per = e.groupBy(*by, "_block").agg(F.max("_at").alias("_high"))
    before = per.withColumn("_before", F.max("_high").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_high")
    stored = cursors.select(F.col("peer_region").alias("_peer"), F.col("table_name").alias("_table"), F.struct(F.col("last_version").alias("version"), F.coalesce("last_pk", keys.no_key()).alias("pk")).alias("_stored"))
    start = before.join(stored, by, "left").withColumn("_start", F.greatest(F.coalesce("_stored", F.struct(F.lit(0).cast("bigint").alias("version"), keys.no_key().alias("pk"))), F.coalesce("_before", F.struct(F.lit(None).cast("bigint").alias("version"), F.lit(None).cast(keys.PK_SCHEMA).alias("pk"))))).select(*by, "_block", "_start")
    within = F.max("_at").over(Window.partitionBy(*by, "_block").orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1))
    out = e.join(start, [*by, "_block"]).withColumn("_running", F.greatest("_start", within))
    return out.where(F.col("_at") > F.col("_running")).select(*events.columns)


def final_cursors(survivors: DataFrame) -> DataFrame:
    """(peer_region, table_name, last_event_id, last_version, last_pk) after the batch."""
    top = F.max(F.struct("_version", "_pk", "_event_id")).alias("c")
    return survivors.groupBy(F.col("_peer").alias("peer_region"), F.col("_table").alias("table_name")).agg(top).select("peer_region", "table_name", F.col("c._event_id").alias("last_event_id"), F.col("c._version").alias("last_version"), F.col("c._pk").alias("last_pk"))


def last_per_key(events: DataFrame, spec: TableSpec) -> DataFrame:
    """The last event by _ord of each (peer, table, key), combined before the shuffle."""
    by = ["_peer", "_table", *spec.primary_key]
    rest = [c for c in events.columns if c not in by]
    return events.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col("_ord")).alias("e")).select(*by, *[F.col(f"e.{c}") for c in rest]).select(*events.columns)


def last_per_batch(events: DataFrame, spec: TableSpec, batch: Column, first: bool = False) -> DataFrame:
    """One event of each (peer, table, key) that does what its batches do one after another.

    A batch counts by its last event of a key. What comes before the last
    insert or upsert is overwritten by it. After it (or without one) a delete
    ends the row, as an update never inserts; else each column is that of the
    last event that carries it. With ``first`` (rows are inserted only) the
    first batch that has the key decides. Keys are combined in windows that
    spill, so one key may have any number of events.
    """
    by = ["_peer", "_table", *spec.primary_key]
    rest = [c for c in events.columns if c not in by]
    each = events.withColumn("_batch", batch).groupBy(*by, "_batch").agg(F.max_by(F.struct(*rest), F.col("_ord")).alias("e"))
    each = each.select(*by, *[F.col(f"e.`{c}`") for c in rest])
    if first:
        one = each.groupBy(*by).agg(F.min_by(F.struct(*rest), F.col("_ord")).alias("e"))
        return one.select(*by, *[F.col(f"e.`{c}`") for c in rest]).select(*events.columns)
    own, at = Window.partitionBy(*by), F.col("_ord")
    puts, cuts = F.col("_op").isin("insert", "upsert"), F.col("_op") == "delete"
    each = each.withColumns({"_put": F.max(F.when(puts, at)).over(own), "_cut": F.max(F.when(cuts, at)).over(own)})
    each = each.where(F.col("_put").isNull() | (at >= F.col("_put")))
    # null columns of an update: all of them
    sent = lambda c: puts | (~cuts & F.coalesce(F.array_contains("_changed", c), F.lit(True)))
    meta = [c for c in rest if c in META]
    made = each.groupBy(*by).agg(
        F.max_by(F.struct(*meta), at).alias("m"),
        F.max("_put").alias("_put"),
        F.max("_cut").alias("_cut"),
        F.when(F.count_if(F.col("_changed").isNull()) == 0, F.array_distinct(F.flatten(F.collect_set("_changed")))).alias("_united"),
        *[F.max_by(F.struct(F.col(f"`{c}`").alias("v")), F.when(sent(c), at)).alias(f"_v{k}") for k, c in enumerate(rest) if c not in META],
    )
    op = F.when(F.col("_cut") > F.coalesce("_put", F.lit(-1)), F.lit("delete")).when(F.col("_put").isNotNull(), F.lit("upsert")).otherwise(F.lit("update"))
    special = {"_op": op, "_changed": F.col("_united")}
    values = [F.col(f"_v{k}.v").alias(c) for k, c in enumerate(rest) if c not in META]
    return made.select(*by, *[special.get(c, F.col(f"m.{c}")).alias(c) for c in meta], *values).select(*events.columns)


def fold_per_key(events: DataFrame, spec: TableSpec) -> DataFrame:
    """A safer reduction: updates keep what earlier events of the batch set.

    An update after an insert or upsert becomes an upsert with the newest row,
    and the changed columns of several updates are united, so that no column
    of a batch is lost. The newest event must carry the whole row.
    """
    by = ["_peer", "_table", *spec.primary_key]
    rest = [c for c in events.columns if c not in by]
    w = Window.partitionBy(*by).orderBy("_ord")
    e = events.withColumn("_made", F.max(F.when(F.col("_op").isin("insert", "upsert"), F.col("_ord"))).over(w))
    e = e.withColumn("_gone", F.max(F.when(F.col("_op") == "delete", F.col("_ord"))).over(w))
    live = F.coalesce(F.col("_made") > F.coalesce("_gone", F.lit(-1)), F.lit(False))
    e = e.withColumn("_op", F.when((F.col("_op") == "update") & live, F.lit("upsert")).otherwise(F.col("_op")))
    united = F.array_distinct(F.flatten(F.collect_list("_changed")))
    g = e.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col("_ord")).alias("e"), united.alias("u"))
    return g.select(*by, *[(F.col("u").alias(c) if c == "_changed" else F.col(f"e.{c}")) for c in rest]).select(*events.columns)


def merge(target: DataFrame, events: DataFrame, spec: TableSpec, allow_update: bool = True, updates: bool = True) -> DataFrame:
    """target after one event per key: upserts, then updates, then deletes, in one full outer join.

    Upserts and deletes need the row to be unowned or the peer's; updates need
    it to be the peer's and never insert. An upsert's owner is its peer.
    Without allow_update existing rows stay as they are (insert only).
    """
    if any(c.startswith("_e_") for c in target.columns):
        raise ValueError("column names starting with _e_ are taken")
    e = events.select(*[F.col(f"`{c}`").alias(f"_e_{c}") for c in target.columns], F.col("_op").alias("_e__op"), F.col("_peer").alias("_e__peer"), (F.col("_changed") if "_changed" in events.columns else F.lit(None).cast("array<string>")).alias("_e__changed"))
    t = target.withColumn("_e__here", F.lit(True))
    match = None
    for c in spec.primary_key:
        one = F.col(f"`{c}`") == F.col(f"`_e_{c}`")
        match = one if match is None else match & one
    j = t.join(e, match, "full_outer")
    here, op, owner, peer = F.col("_e__here").isNotNull(), F.col("_e__op"), F.col(f"`{spec.region_field}`"), F.col("_e__peer")
    gate = owner.isNull() | (owner == peer)
    puts = F.coalesce(op.isin("insert", "upsert"), F.lit(False))
    create = ~here & puts
    replace = here & puts & gate & F.lit(allow_update and bool(spec.values(target.columns)))
    patch = F.coalesce(here & (op == "update") & (owner == peer) & F.lit(updates), F.lit(False))
    drop = F.coalesce(here & (op == "delete") & gate, F.lit(False))
    out = []
    for c in target.columns:
        old, new = F.col(f"`{c}`"), peer if c == spec.region_field else F.col(f"`_e_{c}`")
        if c in spec.primary_key:
            out.append(F.coalesce(old, F.col(f"`_e_{c}`")).alias(c))
        else:
            some = patch & F.coalesce(F.array_contains("_e__changed", c), F.lit(True))
            out.append(F.when(create | F.coalesce(replace, F.lit(False)) | some, new).otherwise(old).cast(target.schema[c].dataType).alias(c))
    return j.where((here | create) & ~drop).select(*out)


def apply_batch(target: DataFrame, events: DataFrame, cursors: DataFrame, spec: TableSpec, mode: Mode | str = Mode.UPSERT, polled: bool = True, fold: bool = False) -> tuple[DataFrame, DataFrame]:
    """(target, new cursors) after one peer's batch for one table; replaying it changes nothing.

    Snapshot rows are applied with ``merge`` alone: neither mode nor cursor
    concerns them.
    """
    e = passing(valid(events), mode)
    e = fresh(cursor_order(e) if polled else e, cursors)
    return settle(target, e, spec, mode, fold), final_cursors(e)


def settle(target: DataFrame, alive: DataFrame, spec: TableSpec, mode: Mode | str = Mode.UPSERT, fold: bool = False, batch: Column | None = None) -> DataFrame:
    """target, or the part of it with the events' keys, after one peer's events that are not stale.

    They are one batch, or the batches that ``batch`` numbers, applied one after another.
    """
    only = mode == Mode.INSERT_ONLY
    last = (fold_per_key if fold else last_per_key)(alive, spec) if batch is None else last_per_batch(alive, spec, batch, only)
    return merge(target, last, spec, allow_update=not only, updates=not only)


def save_cursors(cursors: DataFrame, new: DataFrame) -> DataFrame:
    """The cursors with the new ones in place of their forerunners."""
    return new.unionByName(cursors.join(new, ["peer_region", "table_name"], "left_anti").select(*new.columns))
