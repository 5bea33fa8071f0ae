"""Operators on small fixtures: order, staleness, merges, change logs, keys, encryption, configuration."""

from __future__ import annotations

import os
import random
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewire import config
from tidewire.functions import aead, keys, numbering
from tidewire.operators import apply, changefeed, jobs, outbox, transform
from tidewire.sources import cdc, polling
from tidewire.spec import Mode, PeerSpec, TableSpec, TransformerSpec

SPEC = TableSpec("users", ("id",), "owner")


def events(spark, rows, spec=SPEC, schema="id string, name string, owner string, _op string, _version bigint, _ord bigint, _peer string"):
    df = spark.createDataFrame(rows, schema)
    changed = F.array(F.lit("id"), F.lit("name"), F.lit("owner"))
    return changefeed.to_events(df.drop("_peer"), spec, "x").drop("_peer").join(df.select("_ord", "_peer"), "_ord").withColumn("_changed", changed)


def no_cursors(spark):
    return spark.createDataFrame([], "peer_region string, table_name string, last_event_id string, last_version bigint, last_pk " + keys.PK_SCHEMA)


def test_stale_filter_equals_a_sequential_loop(spark):
    rng = random.Random(7)
    rows = [(f"k{rng.randint(0, 9)}", "n", "eu", "upsert", rng.randint(1, 60), k, rng.choice(["eu", "us"])) for k in range(700)]
    df = events(spark, rows)
    first = df.where("_ord = 5").select(F.lit("eu").alias("peer_region"), F.lit("users").alias("table_name"), F.lit("e").alias("last_event_id"), F.lit(9).cast("bigint").alias("last_version"), F.col("_pk").alias("last_pk"))
    stored = {"eu": (9, f'"{rows[5][0]}"')}
    want = []
    for r in rows:
        here = (r[4], f'"{r[0]}"')
        if here > stored.get(r[6], (0, "")):
            stored[r[6]] = here
            want.append(r[5])
    for block in (10, 100_000):
        assert sorted(x["_ord"] for x in apply.fresh(df, first, block).collect()) == want


def test_polled_batches_are_reordered_and_logs_are_not(spark):
    df = events(spark, [("user-2", "b", "eu", "upsert", 42, 0, "eu"), ("user-1", "a", "eu", "upsert", 42, 1, "eu")])
    target = spark.createDataFrame([], "id string, name string, owner string")
    polled, _ = apply.apply_batch(target, df, no_cursors(spark), SPEC, polled=True)
    logged, cursor = apply.apply_batch(target, df, no_cursors(spark), SPEC, polled=False)
    assert sorted(r["id"] for r in polled.collect()) == ["user-1", "user-2"]
    assert [r["id"] for r in logged.collect()] == ["user-2"] and cursor.first()["last_version"] == 42


def test_last_event_wins_and_folding_keeps_an_insert(spark):
    df = events(spark, [("a", "first", "eu", "insert", 1, 0, "eu"), ("a", "second", "eu", "update", 2, 1, "eu")])
    target = spark.createDataFrame([], "id string, name string, owner string")
    assert apply.merge(target, apply.last_per_key(df, SPEC), SPEC).count() == 0
    assert [r["name"] for r in apply.merge(target, apply.fold_per_key(df, SPEC), SPEC).collect()] == ["second"]


def test_owner_gates(spark):
    target = spark.createDataFrame([("n", "old", None), ("m", "old", "eu"), ("f", "old", "us")], "id string, name string, owner string")
    for op, want in (("upsert", {"n": "new", "m": "new", "f": "old"}), ("update", {"n": "old", "m": "new", "f": "old"}), ("delete", {"f": "old"})):
        df = events(spark, [(i, "new", "eu", op, k + 1, k, "eu") for k, i in enumerate("nmf")])
        assert {r["id"]: r["name"] for r in apply.merge(target, df, SPEC).collect()} == want
    kept = apply.merge(target, events(spark, [("n", "new", "eu", "insert", 1, 0, "eu")]), SPEC, allow_update=False)
    assert {r["name"] for r in kept.collect()} == {"old"}


def test_invalid_events_fail(spark):
    df = events(spark, [("a", "x", "eu", "upsert", 1, 0, "")])
    with pytest.raises(PySparkException):
        apply.valid(df).collect()
    assert apply.passing(events(spark, [("a", "x", "eu", "", 1, 0, "eu")]), Mode.INSERT_ONLY).count() == 0
    assert [r["_op"] for r in apply.passing(events(spark, [("a", "x", "eu", "", 1, 0, "eu")]), Mode.UPSERT).collect()] == ["upsert"]


def test_key_order_and_codec(spark):
    spec = TableSpec("t", ("b", "s"), "o")
    df = spark.createDataFrame([(1, True, "a"), (2, True, "a "), (3, False, 'q"\\é'), (4, True, "")], "n int, b boolean, s string")
    pk = df.select("n", keys.pk_array(spec, df.schema).alias("pk"))
    assert [r["n"] for r in pk.orderBy("pk").collect()] == [3, 4, 2, 1]  # false first, then JSON bytes: '"a "' before '"a"'
    back = pk.select((keys.parse_pk(keys.pk_json(F.col("pk"))) == F.col("pk")).alias("same"))
    assert all(r["same"] for r in back.collect())
    assert pk.where(keys.no_key() < F.col("pk")).count() == 4


def test_event_ids_count_bytes_and_do_not_collide(spark):
    one = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("é", "x")], "t string, k string").select("t", F.array(F.struct(F.col("k").alias("column"), F.lit("string").alias("type"), F.lit(None).cast("bigint").alias("int_value"), F.lit(None).cast("boolean").alias("bool_value"), F.lit('"v"').alias("str_value"))).alias("pk"))
    ids = [r[0] for r in one.select(keys.event_id(F.col("t"), F.col("pk"), F.lit(5), F.lit("insert"))).collect()]
    import hashlib

    assert len(set(ids)) == 3 and ids[2] == hashlib.sha256('2:é1:1:x6:string3:"v"1:56:insert'.encode()).hexdigest()


def test_keyset_expansion(spark):
    df = spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "a int, b int")
    got = sorted(map(tuple, df.where(keys.after(["a", "b"], [1, 1])).collect()))
    assert got == [(1, 2), (2, 0), (2, 1), (2, 2)]


def test_typed_key_text(spark):
    df = spark.createDataFrame([("t",)], "x string")
    assert df.select(keys.typed_text(F.col("x"), "boolean")).first()[0] == "true"
    assert df.select(keys.typed_text(F.lit("12"), "integer"), keys.typed_text(F.lit('a"'), "string")).first()[:] == ("12", '"a\\""')
    with pytest.raises(PySparkException):
        df.select(keys.typed_text(F.lit("1.5"), "integer")).collect()


def test_numbering_is_global(spark):
    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1009).alias("x"), "id").repartition(7)
    got = numbering.number_rows(df, ["x", "id"], "n").orderBy("x", "id").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))
    assert numbering.number_rows(df.where("false"), ["x"], "n").count() == 0


def test_names_and_backoff():
    assert keys.table_name(" a . b ") == ("a", "b") and keys.table_name("t") == ("public", "t") and keys.quote("a`b") == "`a``b`"
    for bad in ("a.b.c", "", "a."):
        with pytest.raises(ValueError):
            keys.table_name(bad)
    waits = [keys.backoff(k, 1.0, rand=random.Random(1)) for k in range(80)]
    assert min(waits) >= 1.0 and max(waits) <= 30.0 and waits[70] >= 15.0


# --- change logs

ROW = "struct<id string, region string, name string>"
LOG = f"tx_id string, ord bigint, version bigint, relation string, kind string, old {ROW}, new {ROW}, toast array<string>, committed boolean"
LOGGED = TableSpec("users", ("id",), "region")


def log(spark, *rows):
    return spark.createDataFrame([("1/A", k, 10 + k, "users", *r, True) for k, r in enumerate(rows)], LOG)


def test_log_decoding(spark):
    a, b = ("1", "eu", "old"), ("1", "eu", "new")
    df = log(spark, ("insert", None, a, None), ("update", a, b, []), ("delete", b, None, None), ("insert", None, ("2", "us", "x"), None), ("insert", None, ("3", None, "x"), None))
    got = cdc.decode(df, LOGGED, "eu", update_diff=True).orderBy("_ord").collect()
    assert [(r["_op"], r["_changed"]) for r in got] == [("insert", ["id", "region", "name"]), ("update", ["id", "name"]), ("delete", ["id"])]
    assert got[2]["name"] is None and got[2]["id"] == "1"
    assert cdc.decode(df.withColumn("committed", F.lit(False)), LOGGED, "eu").count() == 0


@pytest.mark.parametrize(
    "row, diff",
    [
        (("update", ("1", "eu", "a"), ("1", "eu", None), ["name"]), False),
        (("update", None, ("1", "eu", "a"), []), True),
        (("delete", ("1", None, None), None, None), False),
        (("insert", None, ("", "eu", "a"), None), False),
    ],
)
def test_unsound_log_rows_fail(spark, row, diff):
    with pytest.raises(PySparkException):
        cdc.decode(log(spark, row), LOGGED, "eu", diff).collect()


def test_unsent_values_are_no_difference(spark):
    df = log(spark, ("update", ("1", "eu", "a"), ("1", "eu", None), ["name"]))
    assert cdc.decode(df, LOGGED, "eu", True).first()["_changed"] == ["id"]


# --- outbox and jobs


def test_batches_of_one_more_than_the_limit(spark):
    rows = [(f"k{k}", "n", "eu", "upsert", 1, k, "eu") for k in range(7)]
    out = changefeed.batches(changefeed.fan_out(events(spark, rows).withColumn("_tx", F.lit("")), ["us", "ap"]), 3)
    sizes = sorted(r["count"] for r in out.groupBy("_to", "_batch").count().collect())
    assert sizes == [1, 1, 3, 3, 3, 3] and {r["_key"] for r in out.collect()} == {"users"}
    assert changefeed.eligible_peers([PeerSpec("eu", "h"), PeerSpec("us", ""), PeerSpec("ap", "h")], "eu") == ["ap"]
    assert changefeed.fan_out(events(spark, rows), []).count() == 0


def test_batch_validity(spark):
    df = spark.createDataFrame([("eu", 1, [("a",), ("b",)], "b"), ("", 1, [("a",)], "a"), ("eu", 0, [("a",)], "a"), ("eu", 1, [], "a")], "peer_region string, sequence bigint, events array<struct<event_id string>>, last_event_id string")
    assert [bool(r[0]) for r in df.select(outbox.valid(df)).collect()] == [True, False, False, False]
    assert df.where(outbox.valid(df)).select(outbox.consistent(df)).first()[0]


def test_finished_jobs_take_no_checkpoint(spark):
    schema = "peer_region string, table_name string, status string, last_pk string, watermark_at timestamp, finished_at timestamp"
    t = datetime(2024, 1, 1)
    old = spark.createDataFrame([("us", "a", "snapshotting", "1", t, None), ("us", "b", "finished", "9", t, t)], schema)
    marks = spark.createDataFrame([("us", "a", "catching_up", "2", None), ("us", "b", "catching_up", "2", None)], "peer_region string, table_name string, status string, last_pk string, watermark_at timestamp")
    got = {r["table_name"]: (r["status"], r["last_pk"], r["watermark_at"]) for r in jobs.checkpoint(old, marks).collect()}
    assert got == {"a": ("catching_up", "2", t), "b": ("finished", "9", t)}


@pytest.mark.parametrize(
    "remote, ok",
    [({"tables": ["b", "a"], "version": 1}, True), ({"tables": ["a", "b"], "version": 2}, False), ({"tables": ["a"], "version": 1}, False), ({"tables": ["a", "b", "c"], "version": 1}, False), ({}, False)],
)
def test_handshakes(remote, ok):
    local = {"tables": ["a", "b"], "version": 1}
    if ok:
        jobs.compatible(local, remote)
    else:
        with pytest.raises(ValueError):
            jobs.compatible(local, remote)
    jobs.compatible({}, {})
    with pytest.raises(ValueError):
        jobs.admit("eu", "eu")


def test_handshake_config_is_sorted(spark):
    df = spark.createDataFrame([("orders", "total", "numeric"), ("orders", "id", "bigint"), ("accounts", "name", "text")], "table_name string, column_name string, data_type string")
    assert keys.handshake_version(df).first()[0].startswith('[{"name":"accounts","columns":[{"name":"name"')


def test_polling_pages_over_ties(spark):
    spec = TableSpec("t", ("id",), "owner", "ts")
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, t, "eu") for k in range(10)] + [(99, t, "us")], "id bigint, ts timestamp, owner string")
    pages = []
    end = polling.poll(df, spec, "eu", polling.Cursor(), lambda p: pages.append([r["id"] for r in p.collect()]), 4)
    assert [len(p) for p in pages] == [4, 4, 2] and sum(pages, []) == list(range(10)) and end.pk == (9,)
    assert polling.high_water(df.where("false"), spec, "eu").first()[0] == 0


# --- encryption and transformers

K1, K2 = b"e" * 32, b"p" * 32


def test_chacha_vectors():
    key = bytes(range(0x80, 0xA0))
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    # without associated data the published ciphertext (nonce 07000000 40..47) is unchanged
    sealed = aead.seal_bytes(key, bytes.fromhex("070000004041424344454647"), text)
    assert sealed.startswith(bytes.fromhex("d31a8d34648e60db7b86afbc53ef7ec2"))
    assert aead._stream(key, bytes.fromhex("070000004041424344454647"), text) == sealed[:-16]
    assert aead._tag(key, bytes.fromhex("070000004041424344454647"), sealed[:-16]) == sealed[-16:]
    # the published HChaCha20 subkey
    sub, rest = aead._subkey(bytes(range(32)), bytes.fromhex("000000090000004a0000000031415927") + b"12345678")
    assert sub.hex() == "82413b4227b27bfed30e42508a877d73a0f9e4d58a74a853c12ec41326d3ecdc" and rest == bytes(4) + b"12345678"
    with pytest.raises(ValueError):
        aead.open_bytes(key, bytes(12), sealed)


@pytest.mark.parametrize("name", ["", "AES-GCM", "chacha20poly1305", "xchacha20poly1305"])
def test_column_round_trip(spark, name):
    df = spark.createDataFrame([("héllo",), ("",), (None,), ("x" * 300,)], "v string")
    enc = df.select("v", aead.encrypt(F.col("v"), K1, name).alias("c")).persist()
    got = enc.select("v", "c", aead.decrypt(F.col("c"), K1, name).alias("d")).collect()
    assert all(r["d"] == r["v"] for r in got) and got[0]["c"] != "héllo"
    assert df.limit(1).select(aead.decrypt(F.lit("not base64!"), K1, name)).first()[0] == "not base64!"
    with pytest.raises(PySparkException):
        enc.select(aead.decrypt(F.col("c"), K2, name)).collect()
    with pytest.raises(PySparkException):
        df.select(aead.decrypt(F.lit("AAAA"), K1, name)).collect()


def test_key_sizes():
    for name, size in (("aes-gcm", 31), ("chacha20poly1305", 16)):
        with pytest.raises(ValueError):
            aead.check_key(name, bytes(size))
    with pytest.raises(ValueError):
        aead.algorithm("rot13")


def maps(spark, fields, metadata, op="upsert"):
    return spark.createDataFrame([(fields, metadata, op)], "fields map<string,string>, metadata map<string,string>, _op string")


SPECS = [TransformerSpec("users", ("email",), "e"), TransformerSpec("users", ("profile",), "p", "chacha20poly1305")]
RING = {"e": K1, "p": K2}


def test_transit_chain_restores_every_field(spark):
    plain = {"id": '"1"', "email": '"a@b"', "profile": '{"x":1}', "age": "7"}
    stored = transform.encrypt_fields(maps(spark, plain, {}), SPECS, RING).persist()
    assert stored.first()["fields"]["email"].startswith('"') and stored.first()["fields"]["age"] == "7"
    sent = transform.chain(stored, transform.outbound(SPECS, RING))
    row = sent.first()
    assert row["fields"] == {"id": '"1"', "age": "7"} and row["metadata"] == {"transit.crypto.email": '"a@b"', "transit.crypto.profile": '{"x":1}'}
    back = transform.decrypt_fields(transform.chain(sent, transform.inbound(SPECS, RING)), SPECS, RING).first()
    assert back["fields"] == plain and back["metadata"] == {}


def test_values_that_are_not_encrypted_pass(spark):
    row = transform.decrypt_fields(maps(spark, {"email": "12", "profile": '"plain text"'}, {}), SPECS, RING).first()
    assert row["fields"] == {"email": "12", "profile": "plain text"}
    hexed = '"\\\\x' + "plain?".encode().hex() + '"'
    assert transform.decrypt_fields(maps(spark, {"email": hexed}, {}), SPECS, RING).first()["fields"]["email"] == "plain?"


def test_deletes_and_bad_metadata(spark):
    row = transform.from_transit(maps(spark, {"id": "1"}, {"transit.crypto.email": '"x"'}, "delete")).first()
    assert row["fields"] == {"id": "1"}
    kept = transform.scrub(maps(spark, {}, {"transit": "1", "transit.x": "2", "transitory": "3", "a.b-c_1": "4"})).first()["metadata"]
    assert kept == {"transitory": "3", "a.b-c_1": "4"}
    for bad in ("A", "a..b", ".a", "a b", ""):
        with pytest.raises(PySparkException):
            transform.scrub(maps(spark, {}, {bad: "1"})).collect()
    df = spark.createDataFrame([("transit.crypto.ok_1",), ("transit.crypto.Bad",), ("transit.crypto.",), ("x",)], "k string")
    assert [r[0] for r in df.select(transform.transit_field(F.col("k"))).collect()] == ["ok_1", None, None, None]


def test_own_crypto_types(spark):
    transform.register("Reverse", lambda c, k: F.reverse(c), lambda c, k: F.reverse(c))
    spec = [TransformerSpec("t", ("f",), "e", "reverse")]
    row = transform.encrypt_fields(maps(spark, {"f": "abc"}, {}), spec, RING)
    assert row.first()["fields"]["f"] == '"cba"'


# --- configuration

GOOD = """
region: us
peers: [{region: eu, endpoint: "${HOST}:1"}]
tables: [{name: users, primary_key: [id], region_field: owner, updated_at_field: ts}]
transformers: [{type: crypto, table: users, crypto_type: aes-gcm, fields: [email], key_id: k}]
replication: {source: {type: polling}, apply_mode: full_sync, max_batch_events: 0}
lease: {ttl: 1m30s, renew_interval: 200ms}
"""


def test_config_defaults_and_expansion():
    c = config.parse(GOOD, {"HOST": "h"})
    assert c.peers == [PeerSpec("eu", "h:1")] and c.max_batch_events == 1000 and c.lease_ttl == 90 and c.lease_renew == 0.2
    assert c.apply_mode is Mode.FULL_SYNC and c.broadcast_mode is Mode.FULL_SYNC and c.chunk_size == 1000
    assert config.expand("$A ${B} $$ $NONE", {"A": "1", "B": "2"}) == "1 2 $ "


@pytest.mark.parametrize(
    "old, new",
    [
        ("region: us", "region: ''"),
        ("primary_key: [id]", "primary_key: []"),
        ("region_field: owner, ", ""),
        (", updated_at_field: ts", ""),
        ("full_sync", "all"),
        ("type: polling", "type: magic"),
        ("renew_interval: 200ms", "renew_interval: 2m"),
        ("table: users", "table: nobody"),
        ("fields: [email]", "fields: [Email]"),
        ("{source: {type: polling}", "{source: {type: polling, cdc: {update_diff: true}}"),
        ("peers: [", "peers: [{region: eu, endpoint: x}, "),
    ],
)
def test_config_rejects(old, new):
    assert old in GOOD
    with pytest.raises(ValueError):
        config.parse(GOOD.replace(old, new, 1), {"HOST": "h"})


@pytest.mark.parametrize("seal", [True, False])
def test_no_plan_shows_a_key(spark, seal):
    c = F.concat(F.lit("v"), F.col("id").cast("string"))
    made = spark.range(3).select((aead.encrypt if seal else aead.decrypt)(c, K1).alias("x"))
    plan = made._jdf.queryExecution().toString()
    assert K1.hex() not in plan.lower() and K1.decode("latin1") not in plan


def test_transactions_wait_for_their_end(spark):
    from tidewire.sources import cdc

    log = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 3, False), ("c", 4, None)], "tx_id string, ord bigint, last boolean")
    whole, rest = cdc.whole(log)
    assert [r["ord"] for r in whole.orderBy("ord").collect()] == [1, 2] and [r["ord"] for r in rest.orderBy("ord").collect()] == [3, 4]


def test_numbers_within_groups_of_any_size(spark):
    rows = [(g, k) for g, n in ((None, 3), ("a", 40), ("b", 1)) for k in range(n)]
    got = numbering.number_within(spark.createDataFrame(rows, "g string, k int").repartition(5), ["g"], ["k"], "n").collect()
    assert len(got) == len(rows) and all(r["n"] == r["k"] + 1 for r in got)


def test_durable_tables_go_with_their_scope(spark):
    with numbering.scope():
        kept = numbering.durable(spark.range(3))
        assert kept.count() == 3
        files = kept.inputFiles()
        with numbering.scope():
            inner = numbering.durable(spark.range(2)).inputFiles()
        assert not any(os.path.exists(f.removeprefix("file://")) for f in inner) and os.path.exists(files[0].removeprefix("file://"))
    assert not os.path.exists(files[0].removeprefix("file://"))


@pytest.mark.parametrize("mode", [Mode.FULL_SYNC, Mode.UPSERT, Mode.INSERT_ONLY])
def test_batches_in_one_go_equal_batches_one_after_another(spark, mode):
    rng = random.Random(11)
    schema = "id string, name string, note string, owner string"
    start = [(f"k{i}", "old", None, (None, "eu", "us")[i % 3]) for i in range(0, 30, 2)]
    rows = []
    for batch in range(8):
        for at in range(20):
            op = rng.choice(["insert", "update", "update", "upsert", "delete"])
            changed = rng.choice([["id", "name"], ["id", "note"], ["id"], ["id", "name", "note", "owner"], None]) if op == "update" else ["id", "name", "note", "owner"]
            rows.append((f"k{rng.randint(0, 29)}", rng.choice([None, f"n{batch}.{at}"]), f"t{batch}.{at}", "eu", op, 20 * batch + at + 1, (batch << 24) + at, changed, "eu"))
    df = spark.createDataFrame(rows, schema + ", _op string, _version bigint, _ord bigint, _changed array<string>, _ignored string").drop("_ignored")
    df = apply.passing(changefeed.to_events(df, SPEC, "eu"), mode).localCheckpoint()
    target = spark.createDataFrame(start, schema)
    batch = F.shiftright("_ord", 24)
    want = target
    for k in range(8):
        want = apply.settle(want, df.where(batch == k), SPEC, mode).localCheckpoint()
    got = apply.settle(target, df, SPEC, mode, batch=batch)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
