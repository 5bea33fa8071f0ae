"""Two regions end to end, state commits and leases."""

from __future__ import annotations

import json
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.functions import aead
from tidewire.sources import polling
from tidewire.spec import Config, Lease, LeaseKind, Mode, PeerSpec, TableSpec, TransformerSpec
from tidewire.streaming.engine import BadBatch, Engine, bootstrap, deliver
from tidewire.streaming.lease import Leases, PermanentError
from tidewire.streaming.session import Message, NotServed, Region, consume, exchange, serve
from tidewire.streaming.state import Conflict, StateStore

SPEC = TableSpec("users", ("id",), "owner", "updated_at")
SCHEMA = "id string, name string, updated_at timestamp, owner string"
T0 = datetime(2024, 1, 1)


def rows(*items):
    return [(i, n, T0 + timedelta(seconds=s), o) for i, n, s, o in items]


@pytest.fixture
def pair(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema

    def engine(region, other):
        cfg = Config(region, [SPEC], [PeerSpec(other, "h:1")], source_type="polling", apply_mode=Mode.FULL_SYNC, chunk_size=2, max_batch_events=2)
        return Engine(spark, cfg, StateStore(spark, str(tmp_path / region)), {"users": schema}, clock=lambda: T0)

    return engine("us", "eu"), engine("eu", "us")


def content(engine):
    return sorted((r["id"], r["name"], r["owner"]) for r in engine.table("users").collect())


def test_two_regions_converge_without_a_loop(spark, pair):
    us, eu = pair
    us.write("users", spark.createDataFrame(rows(("a", "A", 1, "us"), ("b", "B", 2, "us"), ("c", "C", 3, "us")), SCHEMA))
    eu.write("users", spark.createDataFrame(rows(("x", "X", 1, "eu")), SCHEMA))
    us.capture("users", polling.Cursor())
    eu.capture("users", polling.Cursor())
    assert us.outbox().count() == 2  # three events, two a batch
    assert deliver(us, eu) == 2 and deliver(eu, us) == 1
    assert content(us) == content(eu) == [("a", "A", "us"), ("b", "B", "us"), ("c", "C", "us"), ("x", "X", "eu")]
    assert us.outbox().count() == 0
    # rows that came from a peer are not captured again, and a stored cursor leaves nothing to do
    us.capture("users")
    assert us.outbox().count() == 0
    cursor = eu.store.read("peer_cursors").first()
    assert (cursor["peer_region"], cursor["last_version"]) == ("us", int((T0 - datetime(1970, 1, 1)).total_seconds() + 3) * 10**6)


def test_replay_is_a_no_op_and_jobs_do_not_grow(spark, pair):
    us, eu = pair
    us.write("users", spark.createDataFrame(rows(("a", "A", 1, "us"), ("b", "B", 2, "us")), SCHEMA))
    us.capture("users", polling.Cursor())
    page = us.serve("eu")
    eu.apply(page, 0)
    before, version = content(eu), eu.store.version()
    eu.apply(page, 0)
    assert eu.store.version() == version
    eu.apply(page, 1)
    assert content(eu) == before


def test_owner_gate_keeps_foreign_rows(spark, pair):
    us, eu = pair
    eu.write("users", spark.createDataFrame(rows(("a", "mine", 1, "eu"), ("n", "nobody", 1, None)), SCHEMA))
    us.write("users", spark.createDataFrame(rows(("a", "theirs", 5, "us"), ("n", "us now", 5, "us")), SCHEMA))
    us.capture("users", polling.Cursor())
    deliver(us, eu)
    assert content(eu) == [("a", "mine", "eu"), ("n", "us now", "us")]


def test_snapshot_resumes_and_ends_with_a_short_chunk(spark, pair):
    us, eu = pair
    us.write("users", spark.createDataFrame(rows(*[(f"k{i}", "v", i, "us") for i in range(4)]), SCHEMA))
    assert [(r["peer_region"], r["status"]) for r in eu.snapshots_needed(["us"]).collect()] == [("us", "pending")]
    assert bootstrap(us, eu, "users") == 3  # two full chunks and an empty one
    assert len(content(eu)) == 4 and eu.snapshots_needed(["us"]).isEmpty()
    assert bootstrap(us, eu, "users", ("k1",)) == 2
    job = eu.store.read("snapshot_jobs").first()
    assert job["status"] == "finished" and "k3" in job["last_pk"]


def test_streaming_feed(spark, pair, tmp_path):
    us, eu = pair
    us.write("users", spark.createDataFrame(rows(("a", "A", 1, "us")), SCHEMA))
    us.capture("users", polling.Cursor())
    us.outbox().write.parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(us.outbox().schema).parquet(str(tmp_path / "feed"))
    eu.follow(feed, str(tmp_path / "ck"))
    assert content(eu) == [("a", "A", "us")] and eu.store.value("applied_batch") == 0


def test_source_change_is_permanent(spark, pair):
    us, _ = pair
    us.write("users", spark.createDataFrame(rows(("a", "A", 1, "us")), SCHEMA))
    us.capture("users", polling.Cursor())
    us.config.source_type = "cdc"
    with pytest.raises(PermanentError):
        us.restore("users")


def test_cleanup_by_age_and_number(spark, pair):
    us, _ = pair
    box = [(i, "eu", "users", i, f"e{i}", "", "[]", T0 - timedelta(days=10 if i == 1 else 0)) for i in range(1, 5)]
    us.store.commit({"outbox": spark.createDataFrame(box, us.outbox().schema)})
    us.config.max_pending_per_peer = 2
    assert us.cleanup() == (1, 1)
    assert sorted(r["id"] for r in us.outbox().collect()) == [3, 4]
    assert us.metrics() == {"pending": 2, "oldest_age_seconds": 0.0}
    # two of four were gone: the outbox was written anew, without them
    assert us.store.read("outbox").count() == 2 and us.store.read("outbox_gone").isEmpty()
    assert us.cleanup() == (0, 0) and us.outbox().count() == 2


def test_store_commits_together_or_not_at_all(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    one = spark.range(3).toDF("x")
    store.commit({"a": one}, {"k": 1})
    store.commit({}, append={"a": one})
    assert store.read("a").count() == 6 and store.value("k") == 1
    with pytest.raises(Conflict):
        store.commit({"a": spark.range(1).toDF("x")}, base=store.version() - 1)
    # what others did meanwhile to other relations and values is no conflict
    base = store.version()
    store.update("leases", lambda old: {**old, "x": 1}, {})
    store.commit(append={"b": one})
    store.commit({"c": one}, {"k": 2}, append={"b": one}, base=base)
    assert store.read("b").count() == 6 and store.value("k") == 2 and store.value("leases") == {"x": 1}
    assert store.read("a").count() == 6
    store.commit({"a": spark.range(1).toDF("x")})
    there = lambda: len(list((tmp_path / "s" / "a").iterdir()))
    many = there()
    store.vacuum(1)  # what is young may be a commit under way
    assert there() == many > 1 and len(list((tmp_path / "s" / "_commit").glob("*.json"))) == 1
    store.vacuum(1, grace=-1)
    assert there() == 1 and store.read("a").count() == 1


def test_lease_life(spark, tmp_path):
    t = [100.0]
    leases = Leases(StateStore(spark, str(tmp_path / "l")), lambda: t[0])
    a, b = (Lease(LeaseKind.STREAM, "us", "eu", owner=o) for o in ("pod-a", "pod-b"))
    one = leases.acquire(a, 5)
    assert one.generation == 1 and leases.acquire(b, 5) is None and leases.acquire(a, 5).generation == 1
    t[0] += 6
    assert leases.renew(one, 5) is None
    two = leases.acquire(b, 5)
    assert two.generation == 2 and not leases.release(one) and leases.release(two)
    assert leases.acquire(a, 5).generation == 1 and leases.get(b).owner == "pod-a"
    t[0] += 6
    assert leases.sweep() == 1 and leases.get(a).owner == ""


def test_lease_run_retries_and_stops(spark, tmp_path):
    leases, stop, calls = Leases(StateStore(spark, str(tmp_path / "r"))), threading.Event(), []

    def work(lost):
        calls.append(1)
        if len(calls) == 1:
            raise ValueError("again")

    leases.run(Lease(LeaseKind.PRODUCER, "us", owner="p"), work, 5.0, 0.5, stop, 0.01)
    assert len(calls) == 2 and leases.get(Lease(LeaseKind.PRODUCER, "us")).owner == ""

    def fatal(lost):
        raise PermanentError("no")

    with pytest.raises(PermanentError):
        leases.run(Lease(LeaseKind.PRODUCER, "us", owner="p"), fatal, 5.0, 0.5, stop)


def test_capture_stages_only_what_the_mode_lets_pass(spark, pair):
    us, _ = pair
    us.config.broadcast_mode = Mode.INSERT_ONLY
    us.write("users", spark.createDataFrame(rows(("a", "A", 1, "us")), SCHEMA))
    us.capture("users", polling.Cursor())
    # polled rows are upserts: nothing passes and the stored cursor stays behind
    assert us.outbox().isEmpty() and us.store.read("changefeed_cursors").isEmpty()
    assert us.table("users").where(F.col("id") == "a").count() == 1


def test_log_transactions_span_tables_and_are_staged_once(spark, tmp_path):
    row = "struct<id string, name string, owner string>"
    log = f"tx_id string, ord bigint, version bigint, relation string, kind string, old {row}, new {row}, toast array<string>, committed boolean"
    schema = spark.createDataFrame([], "id string, name string, owner string").schema
    specs = [TableSpec("users", ("id",), "owner"), TableSpec("teams", ("id",), "owner")]

    def engine(region, other):
        cfg = Config(region, specs, [PeerSpec(other, "h")], source_type="cdc", apply_mode=Mode.FULL_SYNC, update_diff=True)
        return Engine(spark, cfg, StateStore(spark, str(tmp_path / region)), {"users": schema, "teams": schema}, clock=lambda: T0)

    us, eu = engine("us", "eu"), engine("eu", "us")
    rows_ = [
        ("0/A", 1, 10, "users", "insert", None, ("1", "a", "us"), None, True),
        ("0/A", 2, 11, "teams", "insert", None, ("t", "x", "us"), None, True),
        ("0/B", 3, 12, "users", "update", ("1", "a", "us"), ("1", "b", "us"), [], True),
        ("0/C", 4, 13, "users", "delete", ("1", "b", "us"), None, None, False),
        ("0/D", 5, 14, "other", "insert", None, ("z", "z", "us"), None, True),
    ]
    spark.createDataFrame(rows_, log).write.parquet(str(tmp_path / "log"))
    df = spark.read.parquet(str(tmp_path / "log"))
    us.follow_log(spark.readStream.schema(df.schema).parquet(str(tmp_path / "log")), str(tmp_path / "ck"))
    us.capture_log(df)  # again, as after a crash
    box = us.outbox().orderBy("id").collect()
    assert [(r["tx_id"], r["table_name"], r["sequence"]) for r in box] == [("0/A", "", 1), ("0/B", "", 2)]
    assert [p.count() for p in us.replay("eu", T0)] == [2] and sum(p.count() for p in us.replay("eu", T0, T0 - timedelta(days=1))) == 2
    # insert and update of a key in one page: only the update survives, and finds no row
    for r in box:
        eu.apply(us.outbox().where(F.col("id") == r["id"]))
    assert [(r["id"], r["name"]) for r in eu.table("users").collect()] == [("1", "b")] and eu.table("teams").count() == 1


def test_all_log_batches_move_in_one_round_as_if_one_after_another(spark, tmp_path):
    row = "struct<id string, name string, owner string>"
    log = f"tx_id string, ord bigint, version bigint, relation string, kind string, old {row}, new {row}, toast array<string>, committed boolean"
    spec, schema = TableSpec("users", ("id",), "owner"), spark.createDataFrame([], "id string, name string, owner string").schema

    def engine(region, other):
        return Engine(spark, Config(region, [spec], [PeerSpec(other, "h")], source_type="cdc", apply_mode=Mode.FULL_SYNC), StateStore(spark, str(tmp_path / region)), {"users": schema}, clock=lambda: T0)

    us, eu = engine("us", "eu"), engine("eu", "us")
    made = [(f"0/{k}", k, k, "users", "insert", None, (str(k), "a", "us"), None, True) for k in range(1, 301)]
    made += [("1/A", 301, 301, "users", "update", ("1", "a", "us"), ("1", "b", "us"), None, True), ("1/B", 302, 302, "users", "delete", ("2", "a", "us"), None, None, True)]
    made += [("1/C", 303, 303, "users", "delete", ("3", "a", "us"), None, None, True), ("1/D", 304, 304, "users", "update", ("3", "a", "us"), ("3", "c", "us"), None, True)]
    us.capture_log(spark.createDataFrame(made, log))
    # more than a replay page holds
    assert deliver(us, eu) == 304 and us.outbox().isEmpty()
    assert content(eu) == sorted([("1", "b", "us"), *((str(k), "a", "us") for k in range(4, 301))])


# --- the store


def test_of_two_racing_writers_one_wins(spark, tmp_path):
    stores = [StateStore(spark, str(tmp_path / "race")) for _ in range(2)]
    for k in range(40):
        base, won, gate = stores[0].version(), [], threading.Barrier(2)

        def write(store, who, base=base, won=won, gate=gate):
            gate.wait()
            try:
                store._publish(base, {**store.manifest(base), "values": {"who": who}})
                won.append(who)
            except Conflict:
                pass

        threads = [threading.Thread(target=write, args=(s, n)) for n, s in enumerate(stores)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert len(won) == 1 and stores[0].version() == base + 1 and stores[0].value("who") == won[0], k


def test_counters_lose_no_update(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "n"))
    threads = [threading.Thread(target=lambda: [store.update("n", lambda x: x + 1, 0, attempts=500) for _ in range(10)]) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.value("n") == 30


def test_a_store_without_exclusive_creation_is_refused(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "x"))

    class Elsewhere:
        def getUri(self):
            return self

        def getScheme(self):
            return "ftp"

        def hasPathCapability(self, *_):
            return False

    store._fs = Elsewhere()
    with pytest.raises(ValueError, match="exclusive"):
        store._exclusive()


def test_tables_by_deltas_equal_tables_rewritten(spark, tmp_path):
    import random

    from tidewire.streaming.state import Delta

    rng, store, want = random.Random(5), StateStore(spark, str(tmp_path / "d")), {}
    kind, mark = "a int, b string, v int", "a int, b string, v int, _gone boolean"
    for turn in range(20):
        rows = {(rng.randint(0, 6), rng.choice("xyz")): (turn, rng.random() < 0.3) for _ in range(5)}
        store.commit(deltas={"t": Delta(spark.createDataFrame([(*k, *v) for k, v in rows.items()], mark), ("a", "b"))})
        for k, (v, gone) in rows.items():
            want.pop(k, None) if gone else want.update({k: v})
        if turn == 8:
            assert store.compact("t", 0.0)
    got = lambda df: {(r["a"], r["b"]): r["v"] for r in df.collect()}
    assert got(store.read("t", kind)) == want
    assert len(store.manifest()["tables"]["t"]["deltas"]) == 11
    some = spark.createDataFrame([(2, "x"), (3, "y"), (99, "z")], "a int, b string")
    assert got(store.near("t", kind, some)) == {k: v for k, v in want.items() if k in ((2, "x"), (3, "y"))}
    assert not store.compact("t", 1e9) and store.compact("t", 0.0) and got(store.read("t", kind)) == want
    store.vacuum(1, grace=-1)
    assert got(store.read("t", kind)) == want
    # many small commits leave few directories
    for k in range(40):
        store.commit(append={"log": spark.createDataFrame([(k,)], "x int").coalesce(1)})
    assert len(store.manifest()["relations"]["log"]) <= 2 * 16 and store.read("log").count() == 40


def test_layouts_go_up_and_down(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "m"))
    store.commit({"a": spark.range(2).toDF("x")}, {"k": 1})
    assert store.migrate(0) == 0 and store.layout() == 0 and isinstance(store.manifest()["relations"]["a"][0], str)
    again = StateStore(spark, str(tmp_path / "m"))
    assert again.layout() == 1 and again.read("a").count() == 2 and again.value("k") == 1
    again._publish(again.version(), {**again.manifest(), "layout": 9})
    with pytest.raises(ValueError, match="layout 9"):
        StateStore(spark, str(tmp_path / "m"))


def _bytes(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_what_a_batch_writes_does_not_depend_on_the_table(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    written, acked = {}, {}
    for size in (100, 40_000):
        engines = []
        for region, other in (("us", "eu"), ("eu", "us")):
            cfg = Config(region, [SPEC], [PeerSpec(other, "h:1")], source_type="polling", apply_mode=Mode.FULL_SYNC)
            engines.append(Engine(spark, cfg, StateStore(spark, str(tmp_path / f"{region}{size}")), {"users": schema}, clock=lambda: T0))
        us, eu = engines
        old = spark.range(size).select(F.format_string("k%06d", "id").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("name"), F.lit(T0).cast("timestamp").alias("updated_at"), F.lit("us").alias("owner"))
        eu.write("users", old)
        us.write("users", spark.createDataFrame(rows(("k000003", "new", 9, "us"), ("k000050", "new", 9, "us"), ("zz", "new", 9, "us")), SCHEMA))
        us.capture("users", polling.Cursor())
        page = us.serve("eu")
        before = _bytes(tmp_path / f"eu{size}")
        acks = eu.apply(page)
        written[size] = _bytes(tmp_path / f"eu{size}") - before
        before = _bytes(tmp_path / f"us{size}")
        us.ack(acks)
        acked[size] = _bytes(tmp_path / f"us{size}") - before
        assert eu.table("users").count() == size + 1 and eu.table("users").where("name = 'new'").count() == 3
        assert us.outbox().isEmpty() and us.meters.get("ack_latency_samples_total") == 1
    assert written[40_000] < 1.1 * written[100] and acked[100] == acked[40_000] < 3000


# --- guards, transactions, transformers


def _feed(engine, **change):
    row = engine.outbox().first().asDict() | change
    return engine.spark.createDataFrame([tuple(row.values())], engine.outbox().schema)


def test_bad_batches_are_refused_and_not_acknowledged(spark, pair):
    us, eu = pair
    us.write("users", spark.createDataFrame(rows(("a", "A", 1, "us")), SCHEMA))
    us.capture("users", polling.Cursor())
    payload = us.outbox().first()["payload"]
    for change in ({"last_event_id": "other"}, {"last_event_id": ""}, {"sequence": 0}, {"peer_region": ""}, {"payload": "[]"}, {"payload": "no json"}, {"payload": payload.replace('"_table":"users"', '"_table":"unknown"')}):
        with pytest.raises(BadBatch):
            eu.apply(_feed(us, **change))
    assert eu.table("users").isEmpty() and eu.meters.get("apply_errors_total") == 7
    eu.apply(_feed(us))
    assert content(eu) == [("a", "A", "us")] and (eu.meters.get("apply_applied_total"), eu.meters.get("apply_stale_total")) == (1, 0)
    eu.apply(_feed(us))
    assert eu.meters.get("apply_stale_total") == 1


def test_a_transaction_over_two_micro_batches_is_staged_once(spark, tmp_path):
    row = "struct<id string, name string, owner string>"
    log = f"tx_id string, ord bigint, version bigint, relation string, kind string, old {row}, new {row}, toast array<string>, committed boolean, last boolean"
    schema = spark.createDataFrame([], "id string, name string, owner string").schema
    cfg = Config("us", [TableSpec("users", ("id",), "owner")], [PeerSpec("eu", "h")], source_type="cdc")
    us = Engine(spark, cfg, StateStore(spark, str(tmp_path / "us")), {"users": schema}, clock=lambda: T0)
    parts = [[("0/A", 1, 10, "users", "insert", None, ("1", "a", "us"), None, True, False)], [("0/A", 2, 10, "users", "insert", None, ("2", "b", "us"), None, True, True), ("0/B", 3, 11, "users", "insert", None, ("3", "c", "us"), None, True, False)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, log).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        us.follow_log(spark.readStream.schema(log).parquet(str(tmp_path / "log")), str(tmp_path / "ck"))
        assert us.outbox().count() == k
    box = us.outbox().first()
    assert (box["tx_id"], box["sequence"], box["payload"].count('"_op"')) == ("0/A", 1, 2)
    assert us.store.read("log_waiting").count() == 1


def test_one_large_transaction_is_split_in_order(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, name string, owner string").schema
    cfg = Config("us", [TableSpec("users", ("id",), "owner")], [PeerSpec("eu", "h"), PeerSpec("ap", "h")], source_type="cdc", max_batch_events=100)
    us = Engine(spark, cfg, StateStore(spark, str(tmp_path / "us")), {"users": schema}, clock=lambda: T0)
    changes = spark.range(2500).select(F.col("id").cast("string").alias("id"), F.lit("n").alias("name"), F.lit("us").alias("owner"), F.lit("insert").alias("_op"), F.lit(5).cast("bigint").alias("_version"), F.col("id").alias("_ord"))
    us.stage("users", changes.repartition(7), "1/A")
    for peer in ("eu", "ap"):
        box = us.outbox().where(F.col("peer_region") == peer).orderBy("id").collect()
        assert [b["sequence"] for b in box] == list(range(1, 26)) and len({b["id"] for b in box}) == 25
        ids = [e["row"]["id"] for b in box for e in json.loads(b["payload"])]
        assert ids == [str(k) for k in range(2500)]
    us.stage("users", changes, "1/A")  # known to the outbox
    assert us.outbox().count() == 50


def test_fields_are_stored_with_each_regions_key_and_travel_in_the_clear(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    ring = {"us": {"k1": b"a" * 32}, "eu": {"k2": b"b" * 32}}

    def engine(region, other, key_id, kind):
        cfg = Config(region, [SPEC], [PeerSpec(other, "h")], [TransformerSpec("users", ("name",), key_id, kind)], source_type="polling", apply_mode=Mode.FULL_SYNC, chunk_size=2)
        return Engine(spark, cfg, StateStore(spark, str(tmp_path / region)), {"users": schema}, clock=lambda: T0, ring=ring[region])

    us, eu = engine("us", "eu", "k1", "aes-gcm"), engine("eu", "us", "k2", "chacha20poly1305")
    plain = spark.createDataFrame(rows(("a", '"Ann \\u00e9"', 1, "us"), ("b", '"Bob"', 2, "us"), ("c", None, 3, "us")), SCHEMA)
    us.write("users", plain.withColumn("name", aead.encrypt(F.col("name"), b"a" * 32)))
    stored = {r["id"]: r["name"] for r in us.table("users").collect()}
    us.capture("users", polling.Cursor())
    assert "Ann" not in us.outbox().first()["payload"]
    served = us.serve("eu").first()["payload"]
    assert "Ann" in served and stored["a"] not in served and "transit.crypto.name" in served
    deliver(us, eu)
    opened = lambda: {r["id"]: r["name"] for r in eu.table("users").select("id", aead.decrypt(F.col("name"), b"b" * 32, "chacha20poly1305").alias("name")).collect()}
    assert opened()["a"] == '"Ann \\u00e9"' and opened()["b"] == '"Bob"'
    got = {r["id"]: r["name"] for r in eu.table("users").collect()}
    assert all("Ann" not in (v or "") and v != stored[k] for k, v in got.items() if v)
    # a snapshot goes the same way
    eu.write("users", eu.table("users").where("false"))
    assert bootstrap(us, eu, "users") == 2
    assert opened()["a"] == '"Ann \\u00e9"' and opened()["b"] == '"Bob"'
    with pytest.raises(ValueError, match="no key for: k1"):
        Engine(spark, us.config, us.store, {"users": schema}, ring={})


# --- sessions


def test_a_session_sends_snapshot_then_replay_then_tail(spark, pair):
    us, eu = pair
    us.write("users", spark.createDataFrame(rows(*[(f"k{i}", "v", i, "us") for i in range(3)]), SCHEMA))
    us.capture("users", polling.Cursor())
    tick = [T0]

    def later():
        tick[0] += timedelta(seconds=1)
        return tick[0]

    us.clock = later
    kinds = []

    def session(hello, asked):
        for m in serve(us, hello, asked):
            kinds.append(m.kind)
            if m.kind == "snapshot":  # staged while the snapshot is under way
                us.write("users", us.table("users").unionByName(spark.createDataFrame(rows(("late", "v", 50, "us")), SCHEMA)))
                us.capture("users")
            yield m

    assert consume(eu, "us", session, us.ack) == len(kinds)
    assert kinds[:2] == ["handshake", "snapshot"] and kinds[-1] == "snapshot_complete" and set(kinds[2:-1]) == {"batches"}
    assert len(content(eu)) == 4 and us.outbox().isEmpty()
    job = eu.store.read("snapshot_jobs").first()
    assert job["status"] == "finished" and job["watermark_at"] is not None
    kinds.clear()
    consume(eu, "us", session, us.ack)  # nothing is asked for again
    assert kinds == ["handshake"]
    assert us.meters.get("messages_total", direction="sent", type="snapshot_chunk") == 2 == eu.meters.get("snapshot_chunks_received_total")


def test_sessions_are_refused_where_sides_do_not_fit(spark, pair):
    us, eu = pair
    ok = eu.handshake()
    for hello in ({**ok, "region": ""}, {**ok, "region": "us"}, {**ok, "region": "stranger"}, {**ok, "tables": ["x"]}, {**ok, "version": "other"}):
        with pytest.raises(ValueError):
            next(serve(us, hello))
    assert next(serve(us, ok)).handshake["region"] == "us"
    with pytest.raises(ValueError, match="handshake"):
        consume(eu, "us", lambda *_: iter([Message("batches")]), us.ack)
    with pytest.raises(ValueError, match="not configured"):
        next(serve(us, ok, [("none", ())]))


def test_a_snapshot_is_sent_by_one_instance_and_resumed(spark, pair, monkeypatch):
    us, eu = pair
    monkeypatch.setattr("tidewire.streaming.engine.SNAPSHOT_ROWS", 2)
    us.write("users", spark.createDataFrame(rows(*[(f"k{i}", "v", i, "us") for i in range(40)]), SCHEMA))
    leases = Leases(us.store)
    held = leases.acquire(Lease(LeaseKind.SNAPSHOT, "us", "eu", "users", "other"), 100)
    with pytest.raises(NotServed):
        exchange(us, eu, leases, "me")
    leases.release(held)

    class Cut(Exception):
        pass

    def cut(hello, asked):
        for k, m in enumerate(serve(us, hello, asked, leases, "me")):
            if k == 3:
                raise Cut
            yield m

    with pytest.raises(Cut):
        consume(eu, "us", cut, us.ack)
    there = eu.table("users").count()
    assert 0 < there < 40
    asked = []
    consume(eu, "us", lambda hello, a: (asked.extend(a), serve(us, hello, a, leases, "me"))[1], us.ack)
    assert asked == [("users", (sorted(f"k{i}" for i in range(40))[there - 1],))] and len(content(eu)) == 40
    assert us.meters.get("snapshot_send_errors_total") == 0 and leases.get(Lease(LeaseKind.SNAPSHOT, "us", "eu", "users")).owner == ""


def test_another_instance_takes_over_the_loop(spark, pair):
    us, eu = pair
    eu.config.lease_ttl, eu.config.lease_renew, eu.config.reconnect_delay = 1.0, 0.2, 0.01
    us.write("users", spark.createDataFrame(rows(("a", "A", 1, "us")), SCHEMA))
    eu.write("users", spark.createDataFrame([], SCHEMA))
    stop, dead, ran = threading.Event(), threading.Event(), []
    first, second = (Region(eu, Leases(eu.store, meters=eu.meters), o) for o in ("pod-a", "pod-b"))

    def failing(lost):
        ran.append("a")
        dead.set()
        raise RuntimeError("connection lost")

    def working(lost):
        ran.append("b")
        exchange(us, eu)
        stop.set()
        return 0

    gone = threading.Event()
    one = threading.Thread(target=first.follow, args=("us", failing, gone))
    one.start()
    assert dead.wait(60)
    two = threading.Thread(target=second.follow, args=("us", working, stop))
    two.start()
    gone.set()
    one.join(60)
    two.join(120)
    assert not one.is_alive() and not two.is_alive() and "a" in ran and ran[-1] == "b"
    assert content(eu) == [("a", "A", "us")]
    assert eu.meters.get("reconnect_attempts_total") >= 1 and eu.meters.get("lease_acquire_ok_total") >= 2


def test_the_capture_loop_polls_all_tables(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    specs = [TableSpec(n, ("id",), "owner", "updated_at") for n in ("users", "accounts")]
    cfg = Config("us", specs, [PeerSpec("eu", "h")], source_type="polling", poll_interval=0.05)
    us = Engine(spark, cfg, StateStore(spark, str(tmp_path / "us")), {t.name: schema for t in specs}, clock=lambda: T0)
    stop, order, real = threading.Event(), [], us.capture

    def capture(name, cursor=None):
        order.append(name)
        if len(order) == 3:  # a second round: rows that came meanwhile
            us.write("users", spark.createDataFrame(rows(("a", "A", 1, "us")), SCHEMA))
        if len(order) == 6:
            stop.set()
        return real(name, cursor)

    us.capture = capture
    Region(us, Leases(us.store), "pod").capture(stop)
    assert order == ["accounts", "users"] * 3 and us.outbox().count() == 1


def test_meters_are_complete_and_in_text():
    from tidewire.streaming.metrics import FAMILIES, Meters

    m = Meters(labels={"region": 'a"b'})
    m.add("apply_stale_total", 2)
    m.set("outbox_pending_batches", 3)
    m.add("messages_total", direction="sent", type="ack")
    text = m.text()
    assert len(FAMILIES) == 28 and all(f"# TYPE tidewire_{n} " in text for n in FAMILIES)
    assert 'tidewire_apply_stale_total{region="a\\"b"} 2\n' in text and 'direction="sent",type="ack"} 1' in text
    with pytest.raises(ValueError):
        m.set("apply_stale_total", 1)
    with pytest.raises(ValueError):
        m.add("outbox_pending_batches")
