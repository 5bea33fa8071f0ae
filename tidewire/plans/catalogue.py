"""The driver's query catalogue: each operator over derived tables, with DuckDB SQL for it.

Events are made of ``feed``: its event types stand for operations, users for
keys, so that keys recur and versions tie. Ties are cut by feed_id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aead, keys
from ..functions.numbering import durable, work_dir
from ..operators import apply, changefeed, jobs, outbox, transform
from ..sources import cdc, polling, snapshot
from ..spec import Config, JobStatus, Mode, PeerSpec, TableSpec, TransformerSpec, columns
from ..streaming.engine import Engine, bootstrap, deliver
from ..streaming.lease import Leases
from ..streaming.session import exchange
from ..streaming.state import StateStore
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
REGION = "EUROPE"
KEY = b"0123456789abcdef0123456789abcdef"
SINCE = datetime(1995, 6, 1)
SINCE_US = 801964800000000
NOW = datetime(2024, 1, 20)


def _query(sql: str | None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- polling and snapshots

_PAGE = "o_orderkey, o_custkey, o_totalprice, epoch_us(o_orderdate) AS version"


def _page(spark: SparkSession, d: str, cursor: polling.Cursor, limit: int = polling.PAGE) -> DataFrame:
    return polling.page(T.payments(spark, d), T.PAYMENTS, REGION, cursor, limit).select("o_orderkey", "o_custkey", "o_totalprice", F.col("_version").alias("version"))


@_query(f"{T.sql('payments')} SELECT coalesce(max(epoch_us(o_orderdate)), 0)::BIGINT AS version FROM payments WHERE owner = '{REGION}'")
def poll_max_version(spark: SparkSession, d: str) -> DataFrame:
    return polling.high_water(T.payments(spark, d), T.PAYMENTS, REGION)


@_query(f"{T.sql('payments')} SELECT {_PAGE} FROM payments WHERE owner = '{REGION}' ORDER BY version, o_orderkey LIMIT 1000")
def poll_first_page(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, polling.Cursor())


@_query(f"{T.sql('payments')} SELECT {_PAGE} FROM payments WHERE owner = '{REGION}' AND epoch_us(o_orderdate) > {SINCE_US} ORDER BY version, o_orderkey LIMIT 1000")
def poll_next_page(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, polling.Cursor(SINCE_US))


@_query(f"{T.sql('payments')} SELECT {_PAGE} FROM payments WHERE owner = '{REGION}' AND (epoch_us(o_orderdate), o_orderkey) > ({SINCE_US}, 700) ORDER BY version, o_orderkey LIMIT 300")
def poll_tie_page(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, polling.Cursor(SINCE_US, (700,)), 300)


@_query(f"{T.sql('users')} SELECT c_custkey, c_name, owner FROM users WHERE owner = '{REGION}' ORDER BY c_custkey LIMIT 100")
def snapshot_chunk(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.chunk(T.users(spark, d), T.USERS, REGION, limit=100).select("c_custkey", "c_name", "owner")


@_query(f"{T.sql('users')} SELECT c_custkey, c_name, owner FROM users WHERE owner = '{REGION}' AND c_custkey > 77 ORDER BY c_custkey LIMIT 100")
def snapshot_resume(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.chunk(T.users(spark, d), T.USERS, REGION, (77,), 100).select("c_custkey", "c_name", "owner")


@_query(f"{T.sql('payments')} SELECT o_orderkey, o_totalprice, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 250 + 1)::BIGINT AS chunk_no FROM payments WHERE owner = '{REGION}'")
def snapshot_chunks_all(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.chunks(T.payments(spark, d), T.PAYMENTS, REGION, 250).select("o_orderkey", "o_totalprice", "chunk_no")


@_query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) > (20, 3) ORDER BY conv_id, turn LIMIT 200")
def composite_pk_page(spark: SparkSession, d: str) -> DataFrame:
    turns = T.read(spark, d, "conversations").withColumn("owner", F.lit(REGION))
    return snapshot.chunk(turns, T.TURNS, REGION, (20, 3), 200).select("conv_id", "turn", "role")


# --- event ids

def _sized(x: str) -> str:
    return f"octet_length(encode({x}))::VARCHAR || ':' || {x}"


def _id_sql(table: str, parts: list[tuple[str, str, str]], version: str, op: str) -> str:
    inner = "".join(f" || {_sized(repr(c))} || {_sized(repr(t))} || {_sized(v)}" for c, t, v in parts)
    return f"sha256({_sized(repr(table))} || '{len(parts)}:'{inner} || {_sized(f'({version})::VARCHAR')} || {_sized(op)})"


@_query(f"{T.sql('feed')} SELECT feed_id, {_id_sql('feed', [('feed_id', 'integer', 'feed_id::VARCHAR')], 'epoch_us(ts)', repr('upsert'))} AS event_id FROM feed")
def event_ids_single(spark: SparkSession, d: str) -> DataFrame:
    changes = T.feed(spark, d).withColumns({"_version": keys.version_of(F.col("ts")), "_op": F.lit("upsert")})
    return changefeed.to_events(changes, T.FEED, REGION).select("feed_id", F.col("_event_id").alias("event_id"))


@_query(f"SELECT conv_id, turn, {_id_sql('turns', [('conv_id', 'integer', 'conv_id::VARCHAR'), ('role', 'string', chr(39) + chr(34) + chr(39) + ' || role || ' + chr(39) + chr(34) + chr(39)), ('turn', 'integer', 'turn::VARCHAR')], 'turn + 1', repr('insert'))} AS event_id FROM conversations")
def event_ids_composite(spark: SparkSession, d: str) -> DataFrame:
    changes = T.read(spark, d, "conversations").withColumns({"_version": F.col("turn") + 1, "_op": F.lit("insert")})
    spec = TableSpec("turns", ("conv_id", "role", "turn"), "owner")
    return changefeed.to_events(changes, spec, REGION).select("conv_id", "turn", F.col("_event_id").alias("event_id"))


# --- modes and origin

#: What an event type stands for.
_OPS = {"signup": "insert", "click": "update", "view": "upsert", "error": "delete", "purchase": "upsert"}
_OP_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _OPS.items()) + " END"


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """feed with an operation and a version that ties in groups of about 40."""
    op = F.create_map(*[F.lit(x) for kv in _OPS.items() for x in kv])[F.col("event_type")]
    return T.feed(spark, d).withColumns({"_op": op, "_version": F.floor((F.col("feed_id") * 7919 % 10007) / 40) + 1, "_ord": F.col("feed_id")})


_CHANGES = f"{T.sql('feed')}, changes AS (SELECT *, {_OP_SQL} AS op, ((feed_id * 7919 % 10007) // 40 + 1)::BIGINT AS version FROM feed)"


def _mode(name: str, mode: Mode, where: str, kind: str) -> None:
    def broadcast(spark: SparkSession, d: str) -> DataFrame:
        c = _changes(spark, d)
        return c.where(changefeed.allowed(mode, F.col("_op"))).select("feed_id", F.col("_op").alias("op"))

    def applied(spark: SparkSession, d: str) -> DataFrame:
        c = _changes(spark, d)
        blank = c.withColumn("_op", F.when(F.col("event_type") == "purchase", F.lit("")).otherwise(F.col("_op")))
        return apply.passing(blank, mode).select("feed_id", F.col("_op").alias("op"))

    f = broadcast if kind == "broadcast" else applied
    f.__name__ = name
    _query(f"{_CHANGES} SELECT feed_id, op FROM changes WHERE {where}")(f)


for _kind in ("broadcast", "apply_mode"):
    _mode(f"{_kind}_insert_only", Mode.INSERT_ONLY, "op = 'insert'", _kind)
    _mode(f"{_kind}_upsert", Mode.UPSERT, "op <> 'delete'", _kind)
    _mode(f"{_kind}_full_sync", Mode.FULL_SYNC, "true", _kind)


@_query(f"{T.sql('payments')} SELECT o_orderkey, owner FROM payments WHERE CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE owner END = '{REGION}'")
def local_origin_filter(spark: SparkSession, d: str) -> DataFrame:
    p = T.payments(spark, d).withColumn("owner", F.when(F.col("o_orderkey") % 7 != 0, F.col("owner")))
    return changefeed.local_origin(p, T.PAYMENTS, REGION).select("o_orderkey", "owner")


# --- order, staleness, reduction

_TARGET = TableSpec("accounts", ("user_id",), "owner")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """changes as events of peer = owner on table accounts, keyed by user."""
    c = _changes(spark, d).withColumn("_changed", F.when(F.col("feed_id") % 2 == 0, F.array(F.lit("value"))).otherwise(F.array(F.lit("event_type"), F.lit("value"))))
    return changefeed.to_events(c, _TARGET, REGION).withColumn("_peer", F.col("owner"))


def _cursors(spark: SparkSession, d: str, version: int) -> DataFrame:
    part = F.struct(F.lit("user_id").alias("column"), F.lit("integer").alias("type"), F.lit(50).cast("bigint").alias("int_value"), F.lit(None).cast("boolean").alias("bool_value"), F.lit(None).cast("string").alias("str_value"))
    return T.read(spark, d, "region").select(F.col("r_name").alias("peer_region"), F.lit("accounts").alias("table_name"), F.lit("e").alias("last_event_id"), F.lit(version).cast("bigint").alias("last_version"), F.array(part).alias("last_pk"))


_ORDERED = f"{_CHANGES}, ordered AS (SELECT *, (row_number() OVER (ORDER BY owner, version, user_id, feed_id))::BIGINT AS ord FROM changes)"
_RANKED = f"{_ORDERED}, ranked AS (SELECT *, version * 1000000 + user_id AS pos FROM ordered)"


@_query(f"{_ORDERED} SELECT feed_id, ord FROM ordered")
def cursor_order(spark: SparkSession, d: str) -> DataFrame:
    return apply.cursor_order(_events(spark, d)).select("feed_id", F.col("_ord").alias("ord"))


_STALE = f"{_CHANGES}, ranked AS (SELECT *, version * 1000000 + user_id AS pos FROM changes), run AS (SELECT *, max(pos) OVER (PARTITION BY owner ORDER BY feed_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ranked)"


@_query(f"{_STALE} SELECT feed_id, owner, version FROM run WHERE pos > coalesce(before, 0)")
def stale_filter(spark: SparkSession, d: str) -> DataFrame:
    none = _cursors(spark, d, 0).where("false")
    return apply.fresh(_events(spark, d), none, 1000).select("feed_id", "owner", F.col("_version").alias("version"))


@_query(f"{_RANKED}, run AS (SELECT *, max(pos) OVER (PARTITION BY owner ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ranked) SELECT feed_id, owner, version FROM run WHERE pos > greatest(coalesce(before, 0), 100 * 1000000 + 50)")
def stale_filter_with_cursor(spark: SparkSession, d: str) -> DataFrame:
    e = apply.cursor_order(_events(spark, d))
    return apply.fresh(e, _cursors(spark, d, 100)).select("feed_id", "owner", F.col("_version").alias("version"))


_LAST = ", last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner, user_id ORDER BY feed_id DESC) AS rn FROM changes) WHERE rn = 1)"


@_query(f"{_CHANGES}{_LAST} SELECT user_id, feed_id, op, owner FROM last")
def dedup_last_per_pk(spark: SparkSession, d: str) -> DataFrame:
    return apply.last_per_key(_events(spark, d), _TARGET).select("user_id", "feed_id", F.col("_op").alias("op"), "owner")


@_query(f"{_RANKED}, top AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY pos DESC, ord) AS rn FROM ranked) SELECT owner AS peer_region, version AS last_version, user_id AS last_user, {_id_sql('accounts', [('user_id', 'integer', 'user_id::VARCHAR')], 'version', 'op')} AS last_event_id FROM top WHERE rn = 1")
def cursor_advance(spark: SparkSession, d: str) -> DataFrame:
    e = apply.cursor_order(_events(spark, d))
    c = apply.final_cursors(apply.fresh(e, _cursors(spark, d, 0).where("false")))
    return c.select("peer_region", "last_version", F.col("last_pk")[0]["int_value"].alias("last_user"), "last_event_id")


@_query(f"{_CHANGES} SELECT 'accounts' AS table_name, arg_max(version, feed_id) AS last_version, arg_max(user_id, feed_id) AS last_user FROM changes")
def capture_cursor(spark: SparkSession, d: str) -> DataFrame:
    c = changefeed.latest_cursors(_events(spark, d))
    return c.select(F.col("_table").alias("table_name"), "last_version", F.col("last_pk")[0]["int_value"].alias("last_user"))


# --- merges: users are the target, one event a user

_ACCOUNTS = TableSpec("users", ("c_custkey",), "owner")
#: Two users in three exist, one in five of those without an owner; all others come in, and most of these.
_TARGET_SQL = "target AS (SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE owner END AS owner FROM users WHERE c_custkey % 3 > 0)"
_IN_SQL = f"incoming AS (SELECT c_custkey, c_name || '-new' AS c_name, c_acctbal + 1 AS c_acctbal, CASE c_custkey % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'upsert' WHEN 2 THEN 'update' ELSE 'delete' END AS op, CASE WHEN c_custkey % 7 = 0 THEN '{REGION}' ELSE owner END AS peer FROM users WHERE c_custkey % 3 = 0 OR c_custkey % 11 > 2)"
_MERGE = f"{T.sql('users')}, {_TARGET_SQL}, {_IN_SQL}"
_JOIN = "FROM target t FULL JOIN i ON t.c_custkey = i.c_custkey"


def _target(spark: SparkSession, d: str) -> DataFrame:
    u = T.users(spark, d).where("c_custkey % 3 > 0")
    return u.select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 5 != 0, F.col("owner")).alias("owner"))


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    op = F.element_at(F.array(*[F.lit(x) for x in ("insert", "upsert", "update", "delete")]), (k % 4 + 1).cast("int"))
    u = T.users(spark, d).where("c_custkey % 3 = 0 or c_custkey % 11 > 2")
    return u.select("c_custkey", F.concat("c_name", F.lit("-new")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), "owner", op.alias("_op"), F.when(k % 7 == 0, F.lit(REGION)).otherwise(F.col("owner")).alias("_peer"), F.when(k % 8 == 2, F.array(F.lit("c_acctbal"))).otherwise(F.array(F.lit("c_name"), F.lit("c_acctbal"))).alias("_changed"))


def _put_sql(ops: str, replace: bool) -> str:
    new = f"i.c_custkey IS NOT NULL AND (t.c_custkey IS NULL OR ({'true' if replace else 'false'} AND (t.owner IS NULL OR t.owner = i.peer)))"
    return f"{_MERGE}, i AS (SELECT * FROM incoming WHERE op IN ({ops})) SELECT coalesce(t.c_custkey, i.c_custkey) AS c_custkey, CASE WHEN {new} THEN i.c_name ELSE t.c_name END AS c_name, CASE WHEN {new} THEN i.c_acctbal ELSE t.c_acctbal END AS c_acctbal, CASE WHEN {new} THEN i.peer ELSE t.owner END AS owner {_JOIN}"


@_query(_put_sql("'insert', 'upsert'", True))
def upsert_gated(spark: SparkSession, d: str) -> DataFrame:
    return apply.merge(_target(spark, d), _incoming(spark, d).where("_op in ('insert', 'upsert')"), _ACCOUNTS)


@_query(_put_sql("'insert'", False))
def upsert_insert_only(spark: SparkSession, d: str) -> DataFrame:
    return apply.merge(_target(spark, d), apply.passing(_incoming(spark, d), Mode.INSERT_ONLY), _ACCOUNTS, allow_update=False, updates=False)


@_query(_put_sql("'insert', 'upsert', 'update', 'delete'", True))
def snapshot_apply(spark: SparkSession, d: str) -> DataFrame:
    return apply.merge(_target(spark, d), _incoming(spark, d).withColumn("_op", F.lit("upsert")), _ACCOUNTS)


@_query(f"{_MERGE}, i AS (SELECT * FROM incoming WHERE op = 'update') SELECT t.c_custkey, CASE WHEN t.owner = i.peer AND t.c_custkey % 8 <> 2 THEN i.c_name ELSE t.c_name END AS c_name, CASE WHEN t.owner = i.peer THEN i.c_acctbal ELSE t.c_acctbal END AS c_acctbal, t.owner FROM target t LEFT JOIN i ON t.c_custkey = i.c_custkey")
def partial_update(spark: SparkSession, d: str) -> DataFrame:
    return apply.merge(_target(spark, d), _incoming(spark, d).where("_op = 'update'"), _ACCOUNTS)


@_query(f"{_MERGE}, i AS (SELECT * FROM incoming WHERE op = 'delete') SELECT t.* FROM target t LEFT JOIN i ON t.c_custkey = i.c_custkey WHERE NOT coalesce(i.c_custkey IS NOT NULL AND (t.owner IS NULL OR t.owner = i.peer), false)")
def delete_gated(spark: SparkSession, d: str) -> DataFrame:
    return apply.merge(_target(spark, d), _incoming(spark, d).where("_op = 'delete'"), _ACCOUNTS)


@_query(f"""{T.sql('payments')}, old AS (SELECT * FROM payments WHERE owner = '{REGION}')
SELECT o_orderkey, concat_ws(',', 'o_orderkey', CASE WHEN o_orderkey % 3 = 0 THEN 'o_orderstatus' END, CASE WHEN o_orderkey % 4 = 0 THEN 'o_totalprice' END) AS changed
FROM old WHERE true""")
def update_diff(spark: SparkSession, d: str) -> DataFrame:
    p = T.payments(spark, d).drop("o_custkey", "o_orderdate")
    k = F.col("o_orderkey")
    new = F.struct("o_orderkey", F.when(k % 3 == 0, F.lit("Z")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 4 == 0, F.lit(-1.0)).otherwise(F.col("o_totalprice")).alias("o_totalprice"), "owner")
    log = p.select(F.lit("payments").alias("relation"), F.lit("update").alias("kind"), F.struct("o_orderkey", "o_orderstatus", "o_totalprice", "owner").alias("old"), new.alias("new"), F.lit(None).cast("array<string>").alias("toast"), F.lit(True).alias("committed"), F.lit("1/A").alias("tx_id"), k.alias("ord"), k.alias("version"))
    return cdc.decode(log, T.PAYMENTS, REGION, True).select("o_orderkey", F.array_join("_changed", ",").alias("changed"))


# one peer's batch end to end: order, staleness, last per key, then the merge
_E2E = f"""{_RANKED}, mine AS (SELECT * FROM ranked WHERE owner = '{REGION}'), run AS (SELECT *, max(pos) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM mine),
alive AS (SELECT * FROM run WHERE pos > greatest(coalesce(before, 0), 20 * 1000000 + 50)),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord DESC) AS rn FROM alive) WHERE rn = 1),
target AS (SELECT c_custkey AS user_id, 'none' AS event_type, 0.0::DOUBLE AS value, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'ASIA' ELSE owner END AS owner FROM users WHERE owner = '{REGION}' AND c_custkey % 3 > 0),
j AS (SELECT t.user_id AS tu, t.event_type AS te, t.value AS tv, t.owner AS too, l.user_id AS lu, l.event_type AS le, l.value AS lv, l.op, l.feed_id,
  (t.owner IS NULL OR t.owner = '{REGION}') AS gate FROM target t FULL JOIN last l ON t.user_id = l.user_id),
k AS (SELECT *, tu IS NULL AND op IN ('insert', 'upsert') AS made, tu IS NOT NULL AND lu IS NOT NULL AND gate AND op IN ('insert', 'upsert') AS put, coalesce(tu IS NOT NULL AND too = '{REGION}' AND op = 'update', false) AS patch, tu IS NOT NULL AND coalesce(gate AND op = 'delete', false) AS gone FROM j)
SELECT coalesce(tu, lu) AS user_id, CASE WHEN made OR put OR (patch AND feed_id % 2 = 1) THEN le ELSE te END AS event_type, CASE WHEN made OR put OR patch THEN lv ELSE tv END AS value, CASE WHEN made OR put THEN '{REGION}' ELSE too END AS owner FROM k WHERE (tu IS NOT NULL OR made) AND NOT gone"""


def _e2e_target(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    owner = F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, F.lit("ASIA")).otherwise(F.col("owner"))
    return T.users(spark, d).where((F.col("owner") == REGION) & (k % 3 > 0)).select(k.alias("user_id"), F.lit("none").alias("event_type"), F.lit(0.0).alias("value"), owner.alias("owner"))


@_query(_E2E)
def apply_batch_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d).where(F.col("_peer") == REGION)
    target, _ = apply.apply_batch(_e2e_target(spark, d), events, _cursors(spark, d, 20), _TARGET, Mode.FULL_SYNC)
    return target


# --- fan-out, batching, outbox

_PEERS = ["AMERICA", "ASIA"]


def _outgoing(spark: SparkSession, d: str) -> DataFrame:
    """Own changes as events for two peers: even users come in transactions of a key range."""
    c = _events(spark, d).where(F.col("_peer") == REGION).withColumn("_tx", F.when(F.col("feed_id") % 2 == 0, F.concat(F.lit("T"), F.floor(F.col("feed_id") / 500).cast("string"))).otherwise(F.lit("")))
    return changefeed.fan_out(c, _PEERS)


_OUT = f"{_CHANGES}, outgoing AS (SELECT c.*, p.peer, CASE WHEN feed_id % 2 = 0 THEN 'T' || (feed_id // 500)::VARCHAR ELSE '' END AS tx FROM changes c CROSS JOIN (VALUES ('AMERICA'), ('ASIA')) p(peer) WHERE owner = '{REGION}')"
_BATCHED = f"{_OUT}, batched AS (SELECT *, ((row_number() OVER (PARTITION BY peer, tx ORDER BY feed_id) - 1) // 100)::BIGINT AS batch, CASE WHEN tx = '' THEN 'accounts' ELSE '' END AS key FROM outgoing)"
_SEQ = f"{_BATCHED}, heads AS (SELECT peer, key, tx, batch, min(feed_id) AS first_id, max(feed_id) AS last_id, count(*) AS n FROM batched GROUP BY ALL), seq AS (SELECT *, (row_number() OVER (PARTITION BY peer, key ORDER BY first_id, batch) + CASE WHEN peer = 'ASIA' AND key = '' THEN 9 ELSE 0 END)::BIGINT AS sequence FROM heads)"


@_query(f"{_OUT} SELECT feed_id, peer FROM outgoing")
def fanout_peers(spark: SparkSession, d: str) -> DataFrame:
    return _outgoing(spark, d).select("feed_id", F.col("_to").alias("peer"))


@_query(f"{_BATCHED} SELECT feed_id, peer, tx, batch, key FROM batched")
def batch_split(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.batches(_outgoing(spark, d), 100).select("feed_id", F.col("_to").alias("peer"), F.col("_tx").alias("tx"), F.col("_batch").alias("batch"), F.col("_key").alias("key"))


def _heads(spark: SparkSession, d: str) -> DataFrame:
    b = changefeed.batches(_outgoing(spark, d), 100)
    heads = b.groupBy("_to", "_key", "_tx", "_batch").agg(F.min("_ord").alias("_first"), F.max("_ord").alias("last_id"), F.count("*").alias("n"))
    counters = spark.createDataFrame([("ASIA", "", 10)], "peer_region string, table_name string, next_sequence bigint")
    return changefeed.sequence(heads, counters)


@_query(f"{_SEQ} SELECT peer, key, tx, batch, n, sequence FROM seq")
def sequence_alloc(spark: SparkSession, d: str) -> DataFrame:
    return _heads(spark, d).select(F.col("_to").alias("peer"), F.col("_key").alias("key"), F.col("_tx").alias("tx"), F.col("_batch").alias("batch"), "n", "sequence")


def _batch_rows(spark: SparkSession, d: str) -> DataFrame:
    return _heads(spark, d).select(F.col("_to").alias("peer_region"), F.col("_key").alias("table_name"), "sequence", F.col("last_id").cast("string").alias("last_event_id"), F.col("_tx").alias("tx_id"), "n")


@_query(f"{_SEQ} SELECT peer AS peer_region, key AS table_name, sequence, last_id::VARCHAR AS last_event_id, n FROM seq WHERE last_id % 3 <> 0")
def outbox_enqueue_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _batch_rows(spark, d)
    there = rows.where("cast(last_event_id as bigint) % 3 = 0")
    # every batch comes twice, as after a lost acknowledgement
    return outbox.enqueue(there, rows.unionByName(rows)).select("peer_region", "table_name", "sequence", "last_event_id", "n")


_BOX = f"{T.sql('feed')}, box AS (SELECT feed_id + 1 AS id, owner AS peer_region, 'accounts' AS table_name, feed_id + 1 AS sequence, feed_id::VARCHAR AS last_event_id, ts AS created_at FROM feed)"


def _box(spark: SparkSession, d: str) -> DataFrame:
    f = T.feed(spark, d)
    return f.select((F.col("feed_id") + 1).alias("id"), F.col("owner").alias("peer_region"), F.lit("accounts").alias("table_name"), (F.col("feed_id") + 1).alias("sequence"), F.col("feed_id").cast("string").alias("last_event_id"), F.col("ts").alias("created_at"))


_LOW, _HIGH = datetime(2024, 1, 3), datetime(2024, 1, 12)


@_query(f"{_BOX} SELECT id, peer_region, sequence FROM box WHERE peer_region = '{REGION}' AND id > 40 AND created_at > TIMESTAMP '2024-01-03' AND created_at <= TIMESTAMP '2024-01-12' ORDER BY id LIMIT 256")
def outbox_window(spark: SparkSession, d: str) -> DataFrame:
    return outbox.window(_box(spark, d), REGION, 40, _LOW, _HIGH).select("id", "peer_region", "sequence")


@_query(f"{_BOX} SELECT id, sequence FROM box WHERE peer_region = '{REGION}' ORDER BY id LIMIT 50")
def outbox_pending(spark: SparkSession, d: str) -> DataFrame:
    return outbox.pending(_box(spark, d), REGION, 50).select("id", "sequence")


@_query(f"{_BOX} SELECT id, sequence FROM box WHERE peer_region = '{REGION}' AND created_at > TIMESTAMP '2024-01-12'")
def outbox_live_tail(spark: SparkSession, d: str) -> DataFrame:
    return outbox.live_tail(_box(spark, d), REGION, _HIGH).select("id", "sequence")


@_query(f"{_BOX} SELECT id, peer_region FROM box WHERE id % 10 <> 1")
def outbox_ack(spark: SparkSession, d: str) -> DataFrame:
    b = _box(spark, d)
    return outbox.acknowledge(b, b.where("id % 10 = 1")).select("id", "peer_region")


@_query(f"{_BOX} SELECT id, peer_region FROM box WHERE created_at >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY")
def outbox_cleanup_age(spark: SparkSession, d: str) -> DataFrame:
    return outbox.expire(_box(spark, d), NOW, 7 * 86400.0).select("id", "peer_region")


@_query(f"{_BOX} SELECT id, peer_region FROM box QUALIFY row_number() OVER (PARTITION BY peer_region ORDER BY id DESC) <= 100")
def outbox_cleanup_count(spark: SparkSession, d: str) -> DataFrame:
    return outbox.newest(_box(spark, d), 100).select("id", "peer_region")


@_query(f"{_BOX} SELECT count(*)::BIGINT AS pending, greatest(0.0, (epoch_us(TIMESTAMP '2024-01-20') - min(epoch_us(created_at))) / 1000000.0)::DOUBLE AS oldest_age_seconds FROM box")
def outbox_metrics(spark: SparkSession, d: str) -> DataFrame:
    return outbox.metrics(_box(spark, d), NOW)


# --- jobs, leases, peers, handshakes: every (region, nation) pair stands for a (peer, table) pair

_JOBS = "WITH pairs AS (SELECT r_name AS peer_region, n_name AS table_name, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey), jobs AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'finished' ELSE 'snapshotting' END AS status, k::VARCHAR AS last_pk, CASE WHEN k % 2 = 0 THEN k END AS watermark_at, CASE WHEN k % 3 = 0 THEN k END AS finished_at FROM pairs WHERE k % 4 > 0), cursors AS (SELECT peer_region, table_name, CASE WHEN k % 10 = 0 THEN '' ELSE 'e' END AS last_event_id FROM pairs WHERE k % 5 = 0)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    n, r = T.read(spark, d, "nation"), T.read(spark, d, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("peer_region"), F.col("n_name").alias("table_name"), F.col("n_nationkey").alias("k"))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return _pairs(spark, d).where(k % 4 > 0).select("peer_region", "table_name", F.when(k % 3 == 0, F.lit("finished")).otherwise(F.lit("snapshotting")).alias("status"), k.cast("string").alias("last_pk"), F.when(k % 2 == 0, k).alias("watermark_at"), F.when(k % 3 == 0, k).alias("finished_at"))


@_query(f"{_JOBS} SELECT p.peer_region, p.table_name, coalesce(j.status, 'pending') AS status, j.last_pk AS resume_pk FROM pairs p LEFT JOIN jobs j USING (peer_region, table_name) WHERE NOT EXISTS (SELECT 1 FROM cursors c WHERE c.peer_region = p.peer_region AND c.table_name = p.table_name AND last_event_id <> '') AND coalesce(j.status, '') <> 'finished'")
def snapshot_needed(spark: SparkSession, d: str) -> DataFrame:
    cursors = _pairs(spark, d).where("k % 5 = 0").select("peer_region", "table_name", F.when(F.col("k") % 10 == 0, F.lit("")).otherwise(F.lit("e")).alias("last_event_id"))
    return jobs.snapshots_needed(_pairs(spark, d), cursors, _jobs(spark, d))


@_query(f"{_JOBS} SELECT peer_region, table_name, status FROM jobs WHERE finished_at IS NULL")
def pending_jobs(spark: SparkSession, d: str) -> DataFrame:
    return jobs.pending_jobs(_jobs(spark, d)).select("peer_region", "table_name", "status")


@_query(f"{_JOBS} SELECT peer_region, table_name, CASE WHEN k % 3 > 0 AND k % 7 > 1 THEN 'catching_up' ELSE status END AS status, CASE WHEN k % 3 > 0 AND k % 7 > 1 THEN 'pk' ELSE last_pk END AS last_pk, CASE WHEN k % 3 > 0 AND k % 7 > 1 THEN coalesce(CASE WHEN k % 5 > 0 THEN 99 END, watermark_at) ELSE watermark_at END AS watermark_at FROM jobs")
def checkpoint_merge(spark: SparkSession, d: str) -> DataFrame:
    marks = _pairs(spark, d).where("k % 7 > 1").select("peer_region", "table_name", F.lit("catching_up").alias("status"), F.lit("pk").alias("last_pk"), F.when(F.col("k") % 5 > 0, F.lit(99)).alias("watermark_at"))
    return jobs.checkpoint(_jobs(spark, d), marks).drop("finished_at")


_LEASES = "WITH leases AS (SELECT s_suppkey AS lease_id, CASE WHEN s_suppkey % 3 = 0 THEN 'pod-a' ELSE 'pod-b' END AS owner_id, (s_suppkey % 5 + 1)::BIGINT AS generation, (s_suppkey % 20)::DOUBLE AS expires_at FROM supplier)"


def _leases(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return T.read(spark, d, "supplier").select(k.alias("lease_id"), F.when(k % 3 == 0, F.lit("pod-a")).otherwise(F.lit("pod-b")).alias("owner_id"), (k % 5 + 1).alias("generation"), (k % 20).cast("double").alias("expires_at"))


@_query(f"{_LEASES} SELECT lease_id, CASE WHEN expires_at <= 10 OR owner_id = 'pod-a' THEN 'pod-a' ELSE owner_id END AS owner_id, generation + CASE WHEN expires_at <= 10 AND owner_id <> 'pod-a' THEN 1 ELSE 0 END AS generation, CASE WHEN expires_at <= 10 OR owner_id = 'pod-a' THEN 15.0 ELSE expires_at END AS expires_at FROM leases")
def lease_acquire(spark: SparkSession, d: str) -> DataFrame:
    return jobs.acquire(_leases(spark, d), "pod-a", 10.0, 5.0)


@_query(f"{_LEASES} SELECT lease_id, owner_id, generation, CASE WHEN owner_id = 'pod-a' AND generation = 2 AND expires_at > 10 THEN 15.0 ELSE expires_at END AS expires_at FROM leases")
def lease_renew(spark: SparkSession, d: str) -> DataFrame:
    return jobs.renew(_leases(spark, d), "pod-a", 2, 10.0, 5.0)


@_query(f"{_LEASES} SELECT * FROM leases WHERE expires_at > 10")
def lease_sweep(spark: SparkSession, d: str) -> DataFrame:
    return jobs.sweep(_leases(spark, d), 10.0)


@_query(f"SELECT n_name AS region, CASE WHEN n_nationkey % 6 = 0 THEN '' ELSE 'h' END AS endpoint FROM nation WHERE n_nationkey % 6 > 0 AND n_name <> '{'FRANCE'}'")
def peer_eligibility(spark: SparkSession, d: str) -> DataFrame:
    peers = T.read(spark, d, "nation").select(F.col("n_name").alias("region"), F.when(F.col("n_nationkey") % 6 == 0, F.lit("")).otherwise(F.lit("h")).alias("endpoint"))
    return changefeed.eligible(peers, "FRANCE")


@_query("SELECT n_name AS table_name, CASE WHEN n_nationkey < 15 THEN 'local' ELSE 'remote' END AS side FROM nation WHERE n_nationkey < 5 OR n_nationkey >= 15")
def handshake_diff(spark: SparkSession, d: str) -> DataFrame:
    n = T.read(spark, d, "nation").select(F.col("n_name").alias("table_name"), "n_nationkey")
    return jobs.handshake_diff(n.where("n_nationkey < 15").select("table_name"), n.where("n_nationkey >= 5").select("table_name"))


# --- encryption and metadata

_ALGORITHMS = (aead.AES, aead.CHACHA, aead.XCHACHA)


@_query("SELECT c_custkey, algorithm, c_name, true AS hidden, true AS fresh_nonce, true AS whole FROM customer CROSS JOIN (VALUES " + ", ".join(f"('{a}')" for a in _ALGORITHMS) + ") v(algorithm)")
def crypto_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Twice encrypted, once decrypted: no cipher text shows the name or comes twice, and none is shorter than nonce, text and tag."""
    c = T.read(spark, d, "customer").select("c_custkey", "c_name")
    out = None
    for a in _ALGORITHMS:
        # in one plan, equal expressions would be evaluated once
        sealed = durable(durable(c.withColumn("one", aead.encrypt(F.col("c_name"), KEY, a))).withColumn("two", aead.encrypt(F.col("c_name"), KEY, a)))
        least = F.octet_length("c_name") + (24 if a == aead.XCHACHA else 12) + 16
        row = sealed.select("c_custkey", F.lit(a).alias("algorithm"), aead.decrypt(F.col("one"), KEY, a).alias("c_name"), (~F.col("one").contains(F.col("c_name")) & (F.col("one") != F.base64("c_name"))).alias("hidden"), (F.col("one") != F.col("two")).alias("fresh_nonce"), (F.octet_length(F.unbase64("one")) == least).alias("whole"))
        out = row if out is None else out.unionByName(row)
    return out


_FIELDS = [TransformerSpec("users", ("name",), "k")]


@_query("""SELECT c_custkey, '"' || c_name || '"' AS in_transit, c_custkey::VARCHAR AS id_field, 1::BIGINT AS n_fields, '"' || c_name || '"' AS restored FROM customer""")
def transit_move(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "customer")
    rows = c.select("c_custkey", F.create_map(F.lit("id"), F.col("c_custkey").cast("string"), F.lit("name"), keys.json_fragment(F.col("c_name"))).alias("fields"), F.create_map().cast("map<string,string>").alias("metadata"))
    # stored encrypted, sent in the clear as metadata, stored encrypted again
    stored = transform.encrypt_fields(rows, _FIELDS, {"k": KEY})
    sent = transform.chain(stored, transform.outbound(_FIELDS, {"k": KEY}))
    back = transform.chain(sent, transform.inbound(_FIELDS, {"k": KEY})).select("c_custkey", F.col("fields").alias("fields"))
    plain = transform.decrypt_fields(back, _FIELDS, {"k": KEY}).select(F.col("c_custkey").alias("k2"), F.col("fields")["name"].alias("restored"))
    out = sent.select("c_custkey", F.col("metadata")["transit.crypto.name"].alias("in_transit"), F.col("fields")["id"].alias("id_field"), F.size("fields").cast("bigint").alias("n_fields"))
    return out.join(plain, F.col("c_custkey") == F.col("k2")).drop("k2")


@_query("SELECT n_nationkey, 1::BIGINT AS n_left, n_name AS origin FROM nation")
def metadata_scrub(spark: SparkSession, d: str) -> DataFrame:
    n = T.read(spark, d, "nation")
    meta = F.create_map(F.lit("transit"), F.lit("1"), F.lit("transit.crypto.x"), F.lit("2"), F.lit("app.origin"), F.col("n_name"))
    out = transform.scrub(n.select("n_nationkey", meta.alias("metadata")))
    return out.select("n_nationkey", F.size("metadata").cast("bigint").alias("n_left"), F.col("metadata")["app.origin"].alias("origin"))


@_query(f"{T.sql('payments')} SELECT o_orderkey, '[{{\"column\":\"o_orderkey\",\"type\":\"integer\",\"json_value\":\"' || o_orderkey::VARCHAR || '\"}}]' AS pk_json FROM payments")
def pk_codec(spark: SparkSession, d: str) -> DataFrame:
    p = T.payments(spark, d)
    text = keys.pk_json(keys.pk_array(T.PAYMENTS, p.schema))
    return p.select("o_orderkey", keys.pk_json(keys.parse_pk(text)).alias("pk_json"))


@_query("""SELECT conv_id, turn, role, '[{"column":"conv_id","type":"integer","json_value":"' || conv_id::VARCHAR || '"},{"column":"role","type":"string","json_value":"\\"' || role || '\\""},{"column":"late","type":"boolean","json_value":"' || (turn > 2)::VARCHAR || '"}]' AS pk_json, role AS back, turn > 2 AS late_back FROM conversations""")
def pk_codec_kinds(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "conversations").withColumn("late", F.col("turn") > 2)
    text = keys.pk_json(keys.pk_array(TableSpec("turns", ("conv_id", "role", "late"), "owner"), c.schema))
    pk = keys.parse_pk(text)
    return c.select("conv_id", "turn", "role", text.alias("pk_json"), F.get_json_object(F.concat(F.lit('{"v":'), pk[1]["str_value"], F.lit("}")), "$.v").alias("back"), pk[2]["bool_value"].alias("late_back"))


@_query("""SELECT conv_id, turn, '{"conv_id":' || conv_id::VARCHAR || ',"role":"' || role || '"}' AS pk_object FROM conversations""")
def pk_as_object(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "conversations")
    pk = keys.pk_object(keys.pk_array(TableSpec("turns", ("conv_id", "role"), "owner"), c.schema))
    parts = F.transform(F.map_entries(pk), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return c.select("conv_id", "turn", F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("pk_object"))


@_query("""SELECT o_orderkey, o_orderkey::VARCHAR AS as_integer, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS as_boolean, '"' || o_orderpriority || '"' AS as_string FROM orders""")
def typed_key_text(spark: SparkSession, d: str) -> DataFrame:
    o, k = T.read(spark, d, "orders"), F.col("o_orderkey")
    flag = F.when(k % 4 == 0, F.lit("t")).when(k % 4 == 2, F.lit("1")).when(k % 4 == 1, F.lit("FALSE")).otherwise(F.lit("f"))
    return o.select("o_orderkey", keys.typed_text(k.cast("string"), "integer").alias("as_integer"), keys.typed_text(flag, "boolean").alias("as_boolean"), keys.typed_text(F.col("o_orderpriority"), "string").alias("as_string"))


@_query("SELECT event_id, upper(to_hex(event_id * 100003 + 1)) || '/' || upper(to_hex(event_id * 7919 % 4294967296)) AS text, (event_id * 100003 + 1) * 4294967296 + event_id * 7919 % 4294967296 AS position FROM events")
def lsn_codec(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    text = keys.lsn_text((k * 100003 + 1) * F.lit(1 << 32) + k * 7919 % (1 << 32))
    return T.read(spark, d, "events").select("event_id", text.alias("text"), keys.lsn_number(text).alias("position"))


_COLUMNS = [("region", "r_regionkey", "bigint"), ("region", "r_name", "string"), ("nation", "n_name", "string"), ("nation", "n_nationkey", "bigint")]


@_query("""SELECT '[{"name":"nation","columns":[{"name":"n_name","data_type":"string"},{"name":"n_nationkey","data_type":"bigint"}]},{"name":"region","columns":[{"name":"r_name","data_type":"string"},{"name":"r_regionkey","data_type":"bigint"}]}]' AS config""")
def handshake_config(spark: SparkSession, d: str) -> DataFrame:
    return keys.handshake_version(spark.createDataFrame(_COLUMNS, "table_name string, column_name string, data_type string"))


@_query("SELECT * FROM (VALUES ('turns', 'conv_id', 'bigint', 1, 'integer'), ('turns', 'turn', 'int', NULL, NULL), ('turns', 'role', 'string', 2, 'string'), ('turns', 'text', 'string', NULL, NULL)) v(table_name, column_name, data_type, key_at, key_type)")
def column_catalogue(spark: SparkSession, d: str) -> DataFrame:
    turns = TableSpec("turns", ("conv_id", "role"), "owner")
    return columns(spark, [turns], {"turns": T.read(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text").schema})


# --- a change log: each payment is inserted, updated or deleted in transactions of 50 keys, every ninth of them open

def _log(spark: SparkSession, d: str, kind: str) -> DataFrame:
    p, k = T.payments(spark, d).drop("o_custkey", "o_orderdate"), F.col("o_orderkey")
    row = F.struct("o_orderkey", "o_orderstatus", "o_totalprice", "owner")
    new = F.struct("o_orderkey", F.lit("Z").alias("o_orderstatus"), "o_totalprice", "owner")
    none = F.lit(None).cast(T.payments(spark, d).select(row.alias("r")).schema["r"].dataType)
    old = none if kind == "insert" else row
    tx = F.floor(k / 50)
    return p.select(F.when(k % 13 == 0, F.lit("elsewhere")).otherwise(F.lit("payments")).alias("relation"), F.lit(kind).alias("kind"), old.alias("old"), (none if kind == "delete" else new if kind == "update" else row).alias("new"), F.lit(None).cast("array<string>").alias("toast"), (tx % 9 > 0).alias("committed"), tx.cast("string").alias("tx_id"), k.alias("ord"), k.alias("version"))


def _decoded(kind: str, status: str, price: str, n_changed: str) -> None:
    def decode(spark: SparkSession, d: str) -> DataFrame:
        out = cdc.decode(_log(spark, d, kind), T.PAYMENTS, REGION)
        return out.select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("_op").alias("op"), F.col("_tx").alias("tx"), F.size("_changed").cast("bigint").alias("n_changed"))

    decode.__name__ = f"cdc_{kind}"
    _query(f"{T.sql('payments')} SELECT o_orderkey, {status} AS o_orderstatus, {price} AS o_totalprice, '{kind}' AS op, (o_orderkey // 50)::VARCHAR AS tx, {n_changed}::BIGINT AS n_changed FROM payments WHERE owner = '{REGION}' AND o_orderkey % 13 > 0 AND (o_orderkey // 50) % 9 > 0")(decode)


_decoded("insert", "o_orderstatus", "o_totalprice", "4")
_decoded("update", "'Z'", "o_totalprice", "4")
_decoded("delete", "NULL::VARCHAR", "NULL::DOUBLE", "1")


@_query(f"{_BOX}, made AS (SELECT id, CASE WHEN id % 5 = 0 THEN '' ELSE peer_region END AS peer_region, CASE WHEN id % 7 = 0 THEN 0 ELSE sequence END AS sequence, id % 11 <> 0 AS has_events, id % 3 <> 0 AS named FROM box) SELECT id, peer_region <> '' AND sequence > 0 AND has_events AS valid, has_events AND named AS consistent FROM made")
def batch_validity(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    events = F.when(k % 11 != 0, F.array(F.struct(F.lit("first").alias("event_id")), F.struct(F.col("last_event_id").alias("event_id")))).otherwise(F.array().cast("array<struct<event_id string>>"))
    b = _box(spark, d).withColumn("events", events)
    b = b.withColumns({"peer_region": F.when(k % 5 != 0, F.col("peer_region")).otherwise(F.lit("")), "sequence": F.when(k % 7 != 0, F.col("sequence")).otherwise(F.lit(0)), "last_event_id": F.when(k % 3 != 0, F.col("last_event_id")).otherwise(F.lit("another"))})
    return b.select("id", outbox.valid(b).alias("valid"), F.coalesce(outbox.consistent(b), F.lit(False)).alias("consistent"))


@_query(f"{_RANKED}, top AS (SELECT owner, max(version) AS version FROM ranked GROUP BY owner) SELECT r_name AS peer_region, coalesce(version, 3)::BIGINT AS last_version FROM region LEFT JOIN top ON owner = r_name AND r_name <> 'ASIA'")
def cursor_saves(spark: SparkSession, d: str) -> DataFrame:
    new = apply.final_cursors(_events(spark, d).where("_peer <> 'ASIA'"))
    return apply.save_cursors(_cursors(spark, d, 3), new).select("peer_region", "last_version")


# --- two regions: each polls its own users and the other applies them

@_query(f"""{T.sql('users')} SELECT region, count(*)::BIGINT AS n_rows, sum(c_custkey)::BIGINT AS key_sum, count(DISTINCT owner)::BIGINT AS owners
FROM users CROSS JOIN (VALUES ('EUROPE'), ('ASIA')) v(region) WHERE owner IN ('EUROPE', 'ASIA') GROUP BY region""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Both regions hold both regions' rows after one exchange; owners stay apart."""
    u = T.users(spark, d)
    out = None
    for region, other in (("EUROPE", "ASIA"), ("ASIA", "EUROPE")):
        own = changefeed.local_origin(u, T.USERS, region)
        sent = changefeed.local_origin(u, T.USERS, other).withColumns({"_op": F.lit("upsert"), "_version": F.col("c_custkey") + 1, "_ord": F.col("c_custkey")})
        events = changefeed.to_events(sent, T.USERS, other)
        none = _cursors(spark, d, 0).where("false")
        merged, _ = apply.apply_batch(own, events, none, T.USERS, Mode.UPSERT, polled=False)
        row = merged.agg(F.lit(region).alias("region"), F.count("*").alias("n_rows"), F.sum("c_custkey").alias("key_sum"), F.countDistinct("owner").alias("owners"))
        out = row if out is None else out.unionByName(row)
    return out


# --- the same through two engines: stores, sessions, transformers, metrics

_SIDES = ("EUROPE", "ASIA")
_PERSON = TableSpec("users", ("c_custkey",), "owner", "updated_at")
_KEYS = {"EUROPE": b"E" * 32, "ASIA": b"A" * 32}


def _people(spark: SparkSession, d: str) -> DataFrame:
    at = F.timestamp_seconds(F.col("c_custkey") + 1_700_000_000)
    return T.users(spark, d).select("c_custkey", "c_name", "c_acctbal", "owner", at.alias("updated_at"))


def _engines(spark: SparkSession, d: str, **more: object) -> tuple[Engine, Engine]:
    """Two regions, each with its own users, names encrypted with its own key."""
    root, people = f"{work_dir(spark)}/engines-{uuid.uuid4().hex}", _people(spark, d)
    out = []
    for region, other in (_SIDES, _SIDES[::-1]):
        secret = TransformerSpec("users", ("c_name",), "k", aead.AES)
        cfg = Config(region, [_PERSON], [PeerSpec(other, "store")], [secret], **{"source_type": "polling", "apply_mode": Mode.FULL_SYNC, "chunk_size": 100, **more})
        e = Engine(spark, cfg, StateStore(spark, f"{root}/{region}"), {"users": people.schema}, clock=lambda: NOW, ring={"k": _KEYS[region]})
        e.write("users", people.where(F.col("owner") == region).withColumn("c_name", aead.encrypt(keys.json_fragment(F.col("c_name")), _KEYS[region])))
        out.append(e)
    return out[0], out[1]


def _held(e: Engine) -> DataFrame:
    name = F.get_json_object(F.concat(F.lit('{"v":'), aead.decrypt(F.col("c_name"), _KEYS[e.config.region]), F.lit("}")), "$.v")
    return e.table("users").select(F.lit(e.config.region).alias("region"), "c_custkey", name.alias("c_name"), "c_acctbal", "owner", keys.version_of(F.col("updated_at")).alias("version"))


_BOTH = f"{T.sql('users')}, sides AS (SELECT * FROM (VALUES ('EUROPE'), ('ASIA')) v(region)), held AS (SELECT region, c_custkey, c_name, c_acctbal, owner, (c_custkey + 1700000000) * 1000000 AS version FROM users CROSS JOIN sides WHERE owner IN ('EUROPE', 'ASIA'))"


@_query(f"{_BOTH} SELECT * FROM held")
def engine_live(spark: SparkSession, d: str) -> DataFrame:
    """All users polled on both sides, staged, served, applied and acknowledged."""
    a, b = _engines(spark, d)
    for e in (a, b):
        e.capture("users", polling.Cursor())
    for source, target in ((a, b), (b, a)):
        while deliver(source, target):
            pass
    return _held(a).unionByName(_held(b))


@_query(f"{_BOTH} SELECT * FROM held")
def engine_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The same by sessions: handshake, snapshots, replay. What was staged before comes again and is stale or equal."""
    a, b = _engines(spark, d)
    b.capture("users", polling.Cursor())
    exchange(a, b, Leases(a.store), "pod")
    exchange(b, a)
    return _held(a).unionByName(_held(b))


@_query(f"{_BOTH}, n AS (SELECT count(*) FILTER (owner = 'EUROPE') AS mine FROM users) SELECT * FROM (SELECT 'changefeed_events_total' AS name, mine::DOUBLE AS value FROM n UNION ALL SELECT 'changefeed_batches_total', ceil(mine / 250.0) FROM n UNION ALL SELECT 'apply_applied_total', mine FROM n UNION ALL SELECT 'apply_stale_total', mine FROM n UNION ALL SELECT 'ack_latency_samples_total', ceil(mine / 250.0) FROM n UNION ALL SELECT 'outbox_pending_batches', 0 UNION ALL SELECT 'snapshot_chunks_sent_total', mine // 100 + 1 FROM n UNION ALL SELECT 'snapshot_rows_received_total', mine FROM n)")
def engine_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What a batch applied twice, its acknowledgement and a snapshot add to the meters. A page of a poll holds 1000 rows, a batch 250."""
    a, b = _engines(spark, d, max_batch_events=250)
    a.capture("users", polling.Cursor())
    pages = list(a.replay("ASIA", NOW))
    for _ in range(2):
        for page in pages:
            b.apply(page)
    for page in pages:
        a.ack(page)
    bootstrap(a, b, "users")
    a.metrics()
    names = {a: ("changefeed_events_total", "changefeed_batches_total", "ack_latency_samples_total", "outbox_pending_batches", "snapshot_chunks_sent_total"), b: ("apply_applied_total", "apply_stale_total", "snapshot_rows_received_total")}
    return spark.createDataFrame([(n, float(e.meters.get(n))) for e, ns in names.items() for n in ns], "name string, value double")


@_query("SELECT status, resumed, n_rows FROM (VALUES ('snapshotting', 0::BIGINT)) v(status, resumed), (SELECT count(*)::BIGINT AS n_rows FROM customer WHERE false) UNION ALL " + f"SELECT 'finished', 1, count(*) FROM ({T.sql('users')} SELECT * FROM users WHERE owner IN ('EUROPE', 'ASIA'))")
def engine_snapshot_jobs(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot that stops after its mark, and one that goes on from the key it has reached."""
    a, b = _engines(spark, d)
    b.mark("users", "EUROPE", JobStatus.SNAPSHOTTING)
    jobs_ = [(r["status"], 0, 0) for r in b.store.read("snapshot_jobs").collect()]
    parts = a.snapshot("users")
    rows, _, _ = next(parts)
    b.apply_snapshot("users", "EUROPE", rows.where(F.col("_row.c_custkey") < 400), False)
    parts.close()
    needed = b.snapshots_needed(["EUROPE"]).first()
    resume = b.key_values(needed["resume_pk"])
    bootstrap(a, b, "users", resume)
    last = b.store.read("snapshot_jobs").first()
    jobs_.append((last["status"], int(resume[0] < 400), b.table("users").count()))
    return spark.createDataFrame(jobs_, "status string, resumed bigint, n_rows bigint")


@_query(f"{T.sql('payments')} SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, owner FROM payments WHERE owner = '{REGION}' AND o_orderkey % 13 > 0 AND (o_orderkey // 50) % 9 > 0 AND o_orderkey % 3 < 2")
def engine_log(spark: SparkSession, d: str) -> DataFrame:
    """A change log staged by transaction: inserts all come, then a third is updated and a third deleted."""
    root = f"{work_dir(spark)}/engines-{uuid.uuid4().hex}"
    row = _log(spark, d, "insert").schema["new"].dataType
    spec = TableSpec("payments", ("o_orderkey",), "owner")
    a, b = (Engine(spark, Config(r, [spec], [PeerSpec(o, "store")], apply_mode=Mode.FULL_SYNC), StateStore(spark, f"{root}/{r}"), {"payments": row}, clock=lambda: NOW) for r, o in (_SIDES, _SIDES[::-1]))
    k = F.col("new.o_orderkey")
    logs = [_log(spark, d, "insert"), _log(spark, d, "update").where(k % 3 == 1), _log(spark, d, "delete").where(F.col("old.o_orderkey") % 3 == 2)]
    for n, log in enumerate(logs):
        # versions rise from log to log: what is not past the cursor is stale
        later = F.col("ord") + F.lit(n << 40)
        a.capture_log(log.withColumns({"ord": later, "version": later, "tx_id": F.concat(F.lit(f"{n}-"), F.col("tx_id"))}))
        while deliver(a, b):
            pass
    return b.table("payments").select("o_orderkey", "o_orderstatus", "o_totalprice", "owner")
