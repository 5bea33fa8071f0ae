"""One region's engine: capture, stage, serve, apply, snapshot, acknowledge, clean up, measure.

A region's outbox is a relation of its state store. What travels to a peer is
the outbox row: its payload is the JSON of the batch's events. Each method runs
a fixed number of Spark jobs for a batch, however many rows it has, and writes
what the batch changes, however large the tables are.

Where the configuration encrypts fields, they are stored encrypted in tables
and outbox. They are decrypted as a page is served (or a snapshot sent), travel
as metadata, and are encrypted with the receiver's keys on arrival.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from contextlib import suppress
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions import keys
from ..functions.keyring import KeyManager
from ..functions.numbering import durable, number_rows, scope
from ..operators import apply, changefeed, jobs, outbox, transform
from ..sources import cdc, polling, snapshot
from ..spec import Config, JobStatus, TableSpec, columns
from .lease import PermanentError
from .metrics import Meters
from .state import GONE, Conflict, Delta, StateStore

#: Rows of a snapshot that one commit takes at least, and commits of one snapshot at most, about.
SNAPSHOT_ROWS, SNAPSHOT_COMMITS = 1_000_000, 16
#: What an event is in a payload; the row stays text until its table is known.
EVENT = "row string, _op string, _version bigint, _ord bigint, _peer string, _table string, _event_id string, _changed array<string>, _meta map<string,string>"
_META = "map<string,string>"
#: An event's place in a feed: its batch's id, then so many bits for its place in the batch.
BATCH_BITS = 24


class BadBatch(ValueError):
    """A batch that must not be applied or acknowledged."""


class ChangeAdapter(Protocol):
    """A source of changes: what polls, follows a log, or is one's own."""

    def run(self, engine: Engine) -> None:
        """Stage everything that is there now."""


def now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


class Engine:
    """The replication engine of ``config.region`` over a state store.

    ring gives the keys of the configured transformers: a KeyManager, which
    may refresh, or a mapping from key id to key.
    """

    def __init__(self, spark: SparkSession, config: Config, store: StateStore, schemas: Mapping[str, StructType], clock: Callable[[], datetime] = now, ring: KeyManager | Mapping[str, bytes] | None = None, meters: Meters | None = None) -> None:
        self.spark, self.config, self.store, self.schemas, self.clock = spark, config, store, dict(schemas), clock
        self.ring, self.meters = ring, meters or Meters(labels={"region": config.region})
        self.tables = {t.name: t for t in config.tables}
        for t in config.tables:
            t.check(self.schemas[t.name])
        if missing := self.required_keys(config) - self.keys().keys():
            raise ValueError(f"no key for: {', '.join(sorted(missing))}")
        for x in config.transformers:
            for f in x.fields:
                if f not in self.schemas[x.table].names or not isinstance(self.schemas[x.table][f].dataType, StringType):
                    raise ValueError(f"field {f!r} of {x.table} must be a text column to be encrypted")

    @staticmethod
    def required_keys(config: Config) -> set[str]:
        return {x.key_id for x in config.transformers}

    def keys(self) -> Mapping[str, bytes]:
        """The keys as they are now: each page and snapshot asks anew."""
        return {} if self.ring is None else self.ring.keys if isinstance(self.ring, KeyManager) else self.ring

    def handshake(self) -> dict:
        """What two sides compare first: region, table names, and their columns as the version."""
        version = keys.handshake_version(columns(self.spark, self.tables.values(), self.schemas)).first()[0]
        return {"region": self.config.region, "tables": sorted(self.tables), "version": version}

    # --- tables

    def table(self, name: str) -> DataFrame:
        return self.store.read(name, self.schemas[name])

    def write(self, name: str, df: DataFrame) -> None:
        """Replace a table's rows, as its application would change them."""
        self.store.commit({name: df.select(*self.schemas[name].names)})

    def _delta(self, spec: TableSpec, old: DataFrame, new: DataFrame) -> Delta:
        """What changed between two states of the same keys' rows."""
        cols = old.columns
        o = old.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("o"), *[F.col(f"`{c}`").alias(f"_o{k}") for k, c in enumerate(spec.primary_key)])
        n = new.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("n"), *[F.col(f"`{c}`").alias(f"_n{k}") for k, c in enumerate(spec.primary_key)])
        same = None
        for k in range(len(spec.primary_key)):
            one = F.col(f"_o{k}") == F.col(f"_n{k}")
            same = one if same is None else same & one
        both = o.join(n, same, "full_outer").where(~F.col("o").eqNullSafe(F.col("n")))
        row = F.coalesce("n", "o")
        return Delta(both.select(*[row[c].alias(c) for c in cols], F.col("n").isNull().alias(GONE)), spec.primary_key)

    # --- transformers

    def _specs(self, name: str) -> list:
        return [x for x in self.config.transformers if x.table == name]

    def _secret(self, name: str) -> list[str]:
        return sorted({f for x in self._specs(name) for f in x.fields})

    def outbound(self, name: str, rows: DataFrame) -> DataFrame:
        """rows (_row struct of the table, _op, _meta) with encrypted fields moved in the clear to _meta."""
        specs, secret = self._specs(name), self._secret(name)
        if not specs:
            return rows
        text = lambda f: F.when(F.col("_row")[f].isNull(), F.lit("null")).otherwise(keys.json_fragment(F.col("_row")[f]))
        # a delete carries its key alone
        live = F.filter(F.array(*[F.struct(F.lit(f).alias("k"), text(f).alias("v")) for f in secret]), lambda _: F.col("_op") != "delete")
        out = rows.withColumns({"fields": F.map_from_entries(live), "metadata": F.coalesce("_meta", F.create_map().cast(_META))})
        out = transform.chain(out, transform.outbound(specs, self.keys()))
        emptied = F.col("_row")
        for f in secret:
            emptied = emptied.withField(f"`{f}`", F.lit(None).cast("string"))
        return out.withColumns({"_row": emptied, "_meta": F.col("metadata")}).drop("fields", "metadata")

    def inbound(self, name: str, rows: DataFrame) -> DataFrame:
        """rows with the fields of _meta back in place, encrypted with this region's keys; _meta is scrubbed."""
        specs, secret = self._specs(name), self._secret(name)
        out = rows.withColumns({"fields": F.create_map().cast(_META), "metadata": F.coalesce("_meta", F.create_map().cast(_META))})
        out = transform.chain(out, transform.inbound(specs, self.keys()))
        whole = F.col("_row")
        for f in self.schemas[name].names:
            if f in secret or isinstance(self.schemas[name][f].dataType, StringType):
                value = F.get_json_object(F.concat(F.lit('{"v":'), F.try_element_at("fields", F.lit(f)), F.lit("}")), "$.v")
                whole = whole.withField(f"`{f}`", F.when(F.map_contains_key("fields", f), value).otherwise(F.col("_row")[f]))
        return out.withColumns({"_row": whole, "_meta": F.col("metadata")}).drop("fields", "metadata")

    # --- capture and staging

    def restore(self, name: str) -> polling.Cursor:
        """The stored polling cursor; without one, polling starts at the current high-water mark."""
        row = self.store.read("changefeed_cursors").where(F.col("table_name") == name).first()
        if row is not None and row["source"] not in ("", self.config.source_type):
            raise PermanentError(f"cursor of {name} is of source {row['source']}, not {self.config.source_type}")
        if row is not None and row["last_version"]:
            return polling.Cursor(row["last_version"], self.key_values(row["last_pk"]))
        return polling.Cursor(polling.high_water(self.table(name), self.tables[name], self.config.region).first()[0])

    def key_values(self, text: str | None) -> tuple:
        """The values of a key as it is stored, () of none."""
        pk = self.spark.range(1).select(keys.parse_pk(F.lit(text)).alias("pk")).first()["pk"]
        value = lambda p: json.loads(p["str_value"]) if p["str_value"] is not None else p["bool_value"] if p["int_value"] is None else p["int_value"]
        return tuple(map(value, pk))

    def capture(self, name: str, cursor: polling.Cursor | None = None) -> polling.Cursor:
        """Stage all changes of one table since the cursor, in pages of one poll, with one scan and one commit."""
        cursor, spec = self.restore(name) if cursor is None else cursor, self.tables[name]
        with scope():
            order = ["_version", *spec.primary_key]
            changed = polling.changed(self.table(name), spec, self.config.region, cursor).withColumn("_op", F.lit("upsert"))
            rows = number_rows(changed, order, "_ord")
            last = rows.agg(F.max(F.struct(*order))).first()[0]
            if last is None:
                return cursor
            self.stage(name, rows.withColumn("_page", F.floor((F.col("_ord") - 1) / polling.PAGE)), "")
        return polling.Cursor(last[0], tuple(last[1:]))

    def stage(self, name: str, changes: DataFrame, tx_id: str) -> None:
        """Changes (columns, _op, _version, _ord) to the outbox of every peer, then the cursor, in one commit.

        When the broadcast mode lets nothing pass, nothing is stored and the
        stored cursor stays behind.
        """
        self._enqueue(self._wired(name, changes.withColumn("_tx", F.lit(tx_id))))

    def capture_log(self, log: DataFrame) -> None:
        """Stage the committed transactions of a change log (see sources.cdc), all tables of one in order."""
        wired = None
        for name, spec in self.tables.items():
            one = self._wired(name, cdc.decode(log, spec, self.config.region, self.config.update_diff))
            wired = one if wired is None else wired.unionByName(one)
        self._enqueue(wired)

    def follow_log(self, log: DataFrame, checkpoint: str) -> None:
        """Stage a streaming change log until it has no more; the checkpoint plays the slot's part.

        A log with a column ``last``, true in the row that ends a transaction,
        may have transactions that span micro-batches: these wait until they
        are whole. A repeated micro-batch gives the same batches, which the
        outbox knows.
        """

        def step(rows: DataFrame, _: int) -> None:
            if "last" not in rows.columns:
                return self.capture_log(rows)
            with scope():
                whole, waiting = (durable(x) for x in cdc.whole(rows.unionByName(self.store.read("log_waiting", rows.schema)).distinct()))
                self.capture_log(whole.drop("last"))
                self.store.commit({"log_waiting": waiting})

        log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def _wired(self, name: str, changes: DataFrame) -> DataFrame:
        """Events of one table with their JSON, in columns that all tables share."""
        spec, cols = self.tables[name], self.schemas[name].names
        passed = changes.where(changefeed.allowed(self.config.broadcast_mode, F.col("_op")))
        if "_changed" not in changes.columns:
            passed = passed.withColumn("_changed", F.array(*[F.lit(c) for c in cols]))
        if "_page" not in changes.columns:
            passed = passed.withColumn("_page", F.lit(0))
        events = changefeed.to_events(passed, spec, self.config.region)
        row = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
        payload = _payload(row, F.lit(None).cast(_META))
        return events.select(F.col("_ord").cast("bigint").alias("_ord"), F.col("_version").cast("bigint").alias("_version"), "_table", "_pk", "_event_id", "_tx", F.col("_page").cast("bigint").alias("_page"), payload.alias("_json"))

    def _enqueue(self, wired: DataFrame) -> None:
        with scope():
            base = self.store.version()
            events = durable(wired)
            n = events.count()
            if not n:
                return
            by = ["_tx", "_page", "_batch"]
            # keys alone are numbered; what is wide joins them once
            placed = durable(changefeed.batches(events.select("_tx", "_page", "_table", "_ord", "_event_id"), self.config.max_batch_events))
            heads = placed.groupBy("_key", *by).agg(F.min("_ord").alias("_first"), F.max_by("_event_id", "_ord").alias("last_event_id"))
            counters, start, at = self.store.read("outbound_sequences"), self.store.value("outbox_id", 0), F.lit(self.clock()).cast("timestamp")
            peers = changefeed.eligible_peers(self.config.peers, self.config.region)
            numbered = durable(changefeed.allocate(changefeed.fan_out(heads, peers), counters, start))
            rows = numbered.select("id", F.col("_to").alias("peer_region"), F.col("_key").alias("table_name"), F.col("sequence").cast("bigint").alias("sequence"), "last_event_id", *by)
            new = durable(outbox.enqueue(self.outbox(), rows))
            text = events.select("_tx", "_page", "_table", "_ord", "_json").join(placed.select("_tx", "_page", "_table", "_ord", "_batch"), ["_tx", "_page", "_table", "_ord"])
            text = text.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_ord", "_json"))).alias("es"))
            payload = F.concat(F.lit("["), F.array_join(F.transform("es", lambda e: e["_json"]), ","), F.lit("]"))
            box = new.join(text, by).select("id", "peer_region", "table_name", "sequence", "last_event_id", F.col("_tx").alias("tx_id"), payload.alias("payload"), at.alias("created_at"))
            last = changefeed.latest_cursors(events).select(F.col("_table").alias("table_name"), F.lit(self.config.source_type).alias("source"), "last_version", keys.pk_json(F.col("last_pk")).alias("last_pk"), at.alias("updated_at"))
            cursors = self.store.read("changefeed_cursors")
            made = new.count()
            self.store.commit(
                {
                    "outbound_sequences": changefeed.next_counters(numbered, counters),
                    "changefeed_cursors": last.unionByName(cursors.join(last, "table_name", "left_anti")),
                },
                {"outbox_id": start + numbered.count()},
                append={"outbox": box} if made else {},
                base=base,
            )
            self.meters.add("changefeed_events_total", n)
            self.meters.add("changefeed_batches_total", made)

    # --- serving

    def outbox(self) -> DataFrame:
        """The batches that are neither acknowledged nor cleaned up."""
        rows = self.store.read("outbox")
        return rows.join(self.store.read("outbox_gone"), "id", "left_anti") if self.store.exists("outbox_gone") else rows

    def serve(self, peer: str, after_id: int = 0, upper: datetime | None = None, lower: datetime | None = None, limit: int = 0) -> DataFrame:
        """A replay page of a peer's batches, encrypted fields in the clear."""
        return self._opened(outbox.window(self.outbox(), peer, after_id, lower, upper, limit))

    def pending(self, peer: str) -> DataFrame:
        """All of a peer's batches in no order (their ids give it), encrypted fields in the clear."""
        return self._opened(self.outbox().where(F.col("peer_region") == peer))

    def _opened(self, page: DataFrame) -> DataFrame:
        """Outbox rows with the outbound transformers applied to their events."""
        if not self.config.transformers:
            return page
        each = page.select("id", F.posexplode(F.from_json("payload", f"array<struct<{EVENT}>>")).alias("at", "e")).select("id", "at", "e.*")
        made = None
        for name in self.tables:
            mine = each.where(F.col("_table") == name)
            if self._specs(name):
                opened = self.outbound(name, mine.withColumn("_row", F.from_json("row", self.schemas[name])))
                mine = opened.withColumn("row", F.to_json("_row", {"ignoreNullFields": "false"})).drop("_row")
            one = mine.select("id", "at", _payload(F.col("row"), F.col("_meta")).alias("_json"))
            made = one if made is None else made.unionByName(one)
        whole = made.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "_json"))).alias("es"))
        payload = F.concat(F.lit("["), F.array_join(F.transform("es", lambda e: e["_json"]), ","), F.lit("]"))
        return page.drop("payload").join(whole.select("id", payload.alias("payload")), "id").select(*page.columns).orderBy("id")

    def replay(self, peer: str, live: datetime, snapshot_mark: datetime | None = None) -> Iterator[DataFrame]:
        """All pages up to the live watermark: what a snapshot may have seen first, then the rest."""
        spans = [(None, live)] if snapshot_mark is None else [(None, snapshot_mark), (snapshot_mark, live)]
        for lower, upper in spans:
            after, more = 0, True
            while more:
                page = self.serve(peer, after, upper, lower)
                n, last = page.agg(F.count("*"), F.max("id")).first()
                if n:
                    yield page
                after, more = last, n == outbox.REPLAY_PAGE

    def tail(self, peer: str, watermark: datetime | None) -> DataFrame:
        return self._opened(outbox.live_tail(self.outbox(), peer, watermark))

    def ack(self, acks: DataFrame) -> None:
        """Acknowledge batches (peer_region, table_name, last_event_id); what is written is their ids."""
        with scope():
            gone = durable(self.outbox().join(acks.select(*outbox.UNIQUE).distinct(), outbox.UNIQUE).select("id", "created_at"))
            n, since = gone.agg(F.count("*"), F.sum(F.unix_micros(F.lit(self.clock()).cast("timestamp")) - F.unix_micros("created_at"))).first()
            if n:
                self.store.commit(append={"outbox_gone": gone.select("id")})
                self.meters.add("ack_latency_samples_total", n)
                self.meters.add("ack_latency_total_seconds", max(0.0, (since or 0) / 1e6))

    # --- applying

    def checked(self, page: DataFrame) -> set[tuple[str, str]]:
        """The (table, peer) pairs of a page of feed rows; raises BadBatch if one must not be applied.

        A batch needs a peer, a sequence, events and the last event's id, which
        is that of its last event; its tables must be configured here.
        """
        each = page.withColumn("events", F.from_json("payload", f"array<struct<{EVENT}>>")).withColumn("events", F.transform("events", lambda e: F.struct(e["_event_id"].alias("event_id"), e["_table"].alias("table"), e["_peer"].alias("peer"))))
        sound = F.coalesce(outbox.valid(each), F.lit(False))
        right = F.coalesce(outbox.consistent(each), F.lit(False))
        pairs = F.array_distinct(F.flatten(F.collect_set(F.transform("events", lambda e: F.struct(e["table"], e["peer"])))))
        bad, wrong, found = each.agg(F.count_if(~sound), F.count_if(sound & ~right), pairs).first()
        if bad or wrong:
            raise BadBatch(f"{bad} batches lack a peer, a sequence, events or the last event's id; {wrong} name another event as their last")
        got = {(r["table"], r["peer"]) for r in found}
        if unknown := {t for t, _ in got} - self.tables.keys():
            raise BadBatch(f"events for tables that are not configured here: {', '.join(sorted(map(str, unknown)))}")
        return got

    def events_of(self, batches: DataFrame, name: str) -> DataFrame:
        """The events of one table in feed rows, in order, encrypted with this region's keys."""
        spec = self.tables[name]
        e = batches.select("id", "tx_id", F.posexplode(F.from_json("payload", f"array<struct<{EVENT}>>")).alias("at", "e")).where(F.col("e._table") == name)
        flat = e.select(F.from_json("e.row", self.schemas[name]).alias("_row"), F.col("e._meta").alias("_meta"), "e._op", "e._version", (F.col("id") * (1 << BATCH_BITS) + F.col("at")).alias("_ord"), "e._peer", "e._table", "e._event_id", "e._changed", F.col("tx_id").alias("_tx"))
        flat = self.inbound(name, flat).drop("_meta")
        flat = flat.select("_row.*", *[c for c in flat.columns if c != "_row"])
        return flat.withColumn("_pk", keys.pk_array(spec, flat.schema))

    def apply(self, batches: DataFrame, batch_id: int | None = None) -> DataFrame:
        """Apply feed rows and commit tables and cursors together; returns what to acknowledge.

        A batch id that has been applied before is skipped, and events at or
        below a cursor are dropped, so replaying is harmless. What must not be
        applied raises BadBatch, and nothing is to be acknowledged.
        """
        acks = batches.select("peer_region", "table_name", "last_event_id")
        if batch_id is not None and batch_id <= self.store.value("applied_batch", -1):
            return acks
        try:
            with scope():
                self._apply(durable(batches), batch_id)
        except Exception:
            self.meters.add("apply_errors_total")
            raise
        return acks

    def _apply(self, page: DataFrame, batch_id: int | None) -> None:
        base = self.store.version()
        pairs = self.checked(page)
        cursors, out, applied, stale = self.store.read("peer_cursors"), {}, 0, 0
        mode = self.config.apply_mode
        for name in sorted({t for t, _ in pairs}):
            spec = self.tables[name]
            passing = durable(apply.passing(apply.valid(self.events_of(page, name)), mode))
            polled = self.config.source_type == "polling"
            # log batches keep their order and are applied one after another
            left = durable(apply.fresh(apply.cursor_order(passing), cursors) if polled else apply.fresh(passing, cursors, max(1, apply.BLOCK // self.config.max_batch_events) << BATCH_BITS))
            batch = None if polled else F.shiftright("_ord", BATCH_BITS)
            n, kept = passing.count(), left.count()
            applied, stale = applied + kept, stale + n - kept
            if not kept:
                continue
            old = durable(self.store.near(name, self.schemas[name], left.select(*[F.col(f"`{c}`") for c in spec.primary_key]).distinct()))
            state, pending = old, sorted(p for t, p in pairs if t == name)
            for peer in pending:
                state = apply.settle(state, left.where(F.col("_peer") == peer), spec, mode, batch=batch)
            cursors = apply.save_cursors(cursors, apply.final_cursors(left))
            out[name] = self._delta(spec, old, state)
        if out:
            self.store.commit({"peer_cursors": durable(cursors)}, {"applied_batch": batch_id} if batch_id is not None else {}, deltas=out, base=base)
        self.meters.add("apply_applied_total", applied)
        self.meters.add("apply_stale_total", stale)

    def follow(self, feed: DataFrame, checkpoint: str) -> None:
        """Apply a streaming DataFrame of feed rows until it has no more (availableNow)."""

        def step(rows: DataFrame, batch_id: int) -> None:
            self.apply(rows.where(F.col("peer_region") == self.config.region), batch_id)

        feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    # --- snapshots

    def snapshot_chunk(self, name: str, resume: tuple = ()) -> DataFrame:
        return snapshot.chunk(self.table(name), self.tables[name], self.config.region, resume, self.config.chunk_size)

    def snapshot(self, name: str, resume: tuple = ()) -> Iterator[tuple[DataFrame, int, bool]]:
        """(rows, chunks, last): the table's own rows after a key, some chunks at a time, in key order.

        Rows are numbered once; a part holds SNAPSHOT_ROWS rows, or as many as
        make SNAPSHOT_COMMITS parts. After a whole number of full chunks an
        empty one follows. Encrypted fields are in the clear, in _meta.
        """
        with scope():
            size = self.config.chunk_size
            own = self.table(name)
            rows = durable(snapshot.chunks(own, self.tables[name], self.config.region, size, resume))
            n = rows.count()
            chunks = n // size + 1
            part = max(1, -(-max(SNAPSHOT_ROWS, -(-n // SNAPSHOT_COMMITS)) // size))
            for first in range(1, chunks + 1, part):
                last = min(chunks, first + part - 1)
                some = rows.where(F.col("chunk_no").between(first, last)).select(F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("_row"), F.lit("upsert").alias("_op"), F.lit(None).cast(_META).alias("_meta"))
                self.meters.add("snapshot_chunks_sent_total", last - first + 1)
                self.meters.add("snapshot_rows_sent_total", min(n, last * size) - (first - 1) * size)
                yield self.outbound(name, some), last - first + 1, last == chunks

    def snapshots_needed(self, peers: list[str]) -> DataFrame:
        pairs = self.spark.createDataFrame([(p, t) for p in peers for t in self.tables], "peer_region string, table_name string")
        return jobs.snapshots_needed(pairs, self.store.read("peer_cursors"), self.store.read("snapshot_jobs"))

    def apply_snapshot(self, name: str, peer: str, rows: DataFrame, last: bool, watermark: datetime | None = None, chunks: int = 1) -> None:
        """Apply a part of a snapshot (as it was sent), and its last key as where to resume, in one commit.

        Neither the apply mode nor the cursor concerns snapshot rows.
        """
        spec: TableSpec = self.tables[name]
        try:
            with scope():
                base = self.store.version()
                if "_row" not in rows.columns:
                    rows = rows.select(F.struct(*self.schemas[name].names).alias("_row"), F.lit("upsert").alias("_op"), F.lit(None).cast(_META).alias("_meta"))
                plain = self.inbound(name, rows)
                e = durable(plain.select("_row.*", "_op", F.lit(peer).alias("_peer")))
                old = durable(self.store.near(name, self.schemas[name], e.select(*[F.col(f"`{c}`") for c in spec.primary_key]).distinct()))
                n, top = e.select(keys.pk_array(spec, e.schema).alias("pk")).agg(F.count("*"), keys.pk_json(F.max("pk"))).first()
                job = self._job(name, peer, JobStatus.CATCHING_UP if last else JobStatus.SNAPSHOTTING, top, watermark)
                self.store.commit({"snapshot_jobs": durable(job)}, deltas={name: self._delta(spec, old, apply.merge(old, e, spec))} if n else {}, base=base)
        except Exception:
            self.meters.add("snapshot_apply_errors_total")
            raise
        self.meters.add("snapshot_rows_received_total", n)
        self.meters.add("snapshot_chunks_received_total", chunks)
        self.meters.add("snapshot_finished_total", int(last))

    def _job(self, name: str, peer: str, status: JobStatus, last_pk: str | None = None, watermark: datetime | None = None, finish: bool = False) -> DataFrame:
        """The snapshot jobs (one a peer and table) with one of them moved on."""
        every = self.store.read("snapshot_jobs")
        mine = (F.col("peer_region") == peer) & (F.col("table_name") == name)
        old = every.where(mine).first()
        row = (peer, name, str(status), last_pk or (old and old["last_pk"]), watermark or (old and old["watermark_at"]), self.clock() if finish else None)
        return every.where(~mine).unionByName(self.spark.createDataFrame([row], every.schema))

    def mark(self, name: str, peer: str, status: JobStatus, last_pk: str | None = None, watermark: datetime | None = None, finish: bool = False) -> None:
        """Write a snapshot job's state; a finished job is reset by new rows, a missing key or watermark keeps the old."""
        with scope():
            base = self.store.version()
            self.store.commit({"snapshot_jobs": durable(self._job(name, peer, status, last_pk, watermark, finish))}, base=base)

    # --- upkeep

    def cleanup(self) -> tuple[int, int]:
        """Retention by age, then by number per peer; returns how many batches each removed.

        The removed ids are appended; tables and the outbox are rewritten only
        when a quarter of what they hold is changes or gone.
        """
        with scope():
            box = self.outbox().drop("payload")
            young = durable(outbox.expire(box, self.clock(), self.config.max_batch_age))
            kept = durable(outbox.newest(young, self.config.max_pending_per_peer))
            gone = durable(box.select("id").join(kept.select("id"), "id", "left_anti"))
            pending, n_young, n_kept = (x.count() for x in (box, young, kept))
            if pending > n_kept:
                self.store.commit(append={"outbox_gone": gone})
            dead = self.store.read("outbox_gone").count()
            if dead and dead >= n_kept / 4:
                with suppress(Conflict):  # batches came meanwhile: next time
                    base = self.store.version()
                    self.store.commit({"outbox": self.outbox(), "outbox_gone": self.spark.createDataFrame([], "id bigint")}, base=base)
        for name in self.tables:
            with suppress(Conflict):
                self.store.compact(name)
        by_age, by_number = pending - n_young, n_young - n_kept
        for name, n in (("", by_age + by_number), ("_by_age", by_age), ("_by_count", by_number)):
            self.meters.add(f"outbox_cleanup_deleted{name}_total", n)
        return by_age, by_number

    def metrics(self) -> dict[str, float]:
        """The backlog, which is also set in the meters."""
        got = outbox.metrics(self.outbox(), self.clock()).first().asDict()
        self.meters.set("outbox_pending_batches", got["pending"])
        self.meters.set("outbox_oldest_batch_age_seconds", got["oldest_age_seconds"])
        return got


def _payload(row: Column, meta: Column) -> Column:
    """One event's JSON: its row's text and metadata as they are, the rest from the columns."""
    rest = F.to_json(F.struct("_op", "_version", "_ord", "_peer", "_table", "_event_id", "_changed", meta.alias("_meta")))
    return F.concat(F.lit('{"row":'), row, F.lit(","), F.substr(rest, F.lit(2)))


def deliver(source: Engine, target: Engine) -> int:
    """Move one round of a peer's pending batches: serve, apply, acknowledge; returns how many.

    Log batches, one a transaction or more, go all in one round, whose jobs and
    commits are as many as a page's. Polled ones go by pages, each of which the
    receiver puts in cursor order as a whole.
    """
    with scope():
        region = target.config.region
        page = durable(source.serve(region) if target.config.source_type == "polling" else source.pending(region))
        n = page.count()
        if n:
            source.ack(target.apply(page))
    return n


def bootstrap(source: Engine, target: Engine, name: str, resume: tuple = ()) -> int:
    """Send a table's snapshot from a key on; returns the number of chunks, the last short or empty."""
    sent = 0
    for rows, chunks, last in source.snapshot(name, resume):
        target.apply_snapshot(name, source.config.region, rows, last, chunks=chunks)
        sent += chunks
        if last:
            target.mark(name, source.config.region, JobStatus.FINISHED, finish=True)
    return sent
