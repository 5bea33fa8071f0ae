"""What two regions say to one another, and the loops that keep it going.

A session is what one region serves to one peer, in order: the handshake, the
snapshots that the peer asked for, the batches staged before the snapshots
began, those staged since, the end of each snapshot, and what has come after.
On a store of files "what has come after" is a page, not a subscription, so a
session ends, and the loop begins the next.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.numbering import durable, scope
from ..operators import jobs
from ..spec import JobStatus, Lease, LeaseKind
from .engine import Engine
from .lease import Leases


class NotServed(RuntimeError):
    """A snapshot that another instance is sending; try again later."""


@dataclass(frozen=True)
class Message:
    """kind: handshake, snapshot, batches or snapshot_complete."""

    kind: str
    table: str = ""
    rows: DataFrame | None = None
    handshake: dict | None = None
    chunks: int = 0
    last: bool = False
    watermark: datetime | None = None


def serve(source: Engine, hello: dict, requests: Sequence[tuple[str, tuple]] = (), leases: Leases | None = None, owner: str = "") -> Iterator[Message]:
    """A session for a peer that says hello (its handshake) and asks for snapshots (table, key to resume after).

    The watermark of the snapshots is taken before the first of them, the live
    one after the last: batches up to the first may repeat what a snapshot
    holds, and come before those of the time in between.
    """
    mine, peer, meters = source.handshake(), hello.get("region") or "", source.meters
    jobs.admit(peer, source.config.region, {p.region for p in source.config.peers})
    jobs.compatible(mine, hello)
    if unknown := [t for t, _ in requests if t not in source.tables]:
        raise ValueError(f"snapshots of tables that are not configured: {', '.join(unknown)}")
    meters.add("messages_total", direction="sent", type="handshake")
    yield Message("handshake", handshake=mine)
    mark = source.clock() if requests else None
    for table, resume in requests:
        held = None
        if leases is not None:
            held = leases.acquire(Lease(LeaseKind.SNAPSHOT, source.config.region, peer, table, owner), source.config.lease_ttl)
            if held is None:
                raise NotServed(f"the snapshot of {table} for {peer} is being sent elsewhere")
        try:
            for rows, chunks, last in source.snapshot(table, resume):
                if held is not None and (held := leases.renew(held, source.config.lease_ttl)) is None:
                    raise NotServed(f"the lease of the snapshot of {table} for {peer} is lost")
                meters.add("messages_total", chunks, direction="sent", type="snapshot_chunk")
                yield Message("snapshot", table, rows, chunks=chunks, last=last, watermark=mark)
        except Exception:
            meters.add("snapshot_send_errors_total")
            raise
        finally:
            if held is not None:
                leases.release(held)
    live = source.clock()
    for page in source.replay(peer, live, mark):
        yield _batches(source, page)
    for table, _ in requests:
        meters.add("messages_total", direction="sent", type="snapshot_complete")
        yield Message("snapshot_complete", table)
    tail = source.tail(peer, live)
    if not tail.isEmpty():
        yield _batches(source, tail)


def _batches(source: Engine, page: DataFrame) -> Message:
    tx, n = page.agg(F.count_if(F.col("tx_id") != ""), F.count("*")).first()
    source.meters.add("messages_total", tx, direction="sent", type="transaction_batch")
    source.meters.add("messages_total", n - tx, direction="sent", type="event_batch")
    return Message("batches", rows=page)


def consume(target: Engine, peer: str, open_session: Callable[[dict, list[tuple[str, tuple]]], Iterator[Message]], ack: Callable[[DataFrame], None], stop: threading.Event | None = None) -> int:
    """Run one session with a peer to its end (or until stop is set): returns the messages received.

    Asks for the snapshots that are not finished, from where they stopped.
    The first message must be a handshake that fits; batches are acknowledged
    once they are applied.
    """
    needed = target.snapshots_needed([peer]).orderBy("table_name").collect()
    requests = [(r["table_name"], target.key_values(r["resume_pk"])) for r in needed]
    mine, got = target.handshake(), 0
    received = lambda kind, n=1: target.meters.add("messages_total", n, direction="received", type=kind)
    target.meters.add("messages_total", direction="sent", type="handshake")
    for m in open_session(mine, requests):
        if stop is not None and stop.is_set():
            break
        got += 1
        if got == 1:
            if m.kind != "handshake" or not m.handshake:
                raise ValueError("a session must begin with a handshake")
            if m.handshake.get("region") != peer:
                raise ValueError(f"{m.handshake.get('region')!r} answers for {peer!r}")
            jobs.compatible(mine, m.handshake)
            received("handshake")
        elif m.kind == "snapshot":
            received("snapshot_chunk", m.chunks)
            target.apply_snapshot(m.table, peer, m.rows, m.last, m.watermark, m.chunks)
        elif m.kind == "batches":
            with scope():
                page = durable(m.rows)
                n = page.count()
                received("event_batch", n)
                ack(target.apply(page))
                target.meters.add("messages_total", n, direction="sent", type="ack")
        elif m.kind == "snapshot_complete":
            received("snapshot_complete")
            target.mark(m.table, peer, JobStatus.FINISHED, finish=True)
        else:
            raise ValueError(f"unknown message: {m.kind}")
    return got


def exchange(source: Engine, target: Engine, leases: Leases | None = None, owner: str = "") -> int:
    """One whole session between two engines in one application."""
    return consume(target, source.config.region, lambda hello, asked: serve(source, hello, asked, leases, owner), source.ack)


class Region:
    """The loops of one instance (``owner``) of a region: capture, one for each peer, upkeep.

    Each runs under a lease of its own, so of several instances one does the
    work, and another takes over when its lease runs out.
    """

    def __init__(self, engine: Engine, leases: Leases, owner: str) -> None:
        self.engine, self.leases, self.owner = engine, leases, owner

    def _lease(self, kind: LeaseKind, peer: str = "") -> Lease:
        return Lease(kind, self.engine.config.region, peer, owner=self.owner)

    def _under(self, kind: LeaseKind, peer: str, work: Callable[[threading.Event], None], stop: threading.Event) -> None:
        c = self.engine.config

        def delay(attempt: int) -> float:
            wait = keys.backoff(attempt, c.reconnect_delay)
            self.engine.meters.add("reconnect_attempts_total")
            self.engine.meters.set("last_reconnect_delay_seconds", wait)
            return wait

        self.leases.run(self._lease(kind, peer), work, c.lease_ttl, c.lease_renew, stop, delay)

    def capture(self, stop: threading.Event) -> None:
        """Poll all tables in the order of their names, again after each interval; cursors are restored once."""

        def work(lost: threading.Event) -> None:
            names = sorted(self.engine.tables)
            cursors = {n: self.engine.restore(n) for n in names}
            while not (stop.is_set() or lost.is_set()):
                for n in names:
                    if stop.is_set() or lost.is_set():
                        return
                    cursors[n] = self.engine.capture(n, cursors[n])
                _wait(self.engine.config.poll_interval, stop, lost)

        self._until(LeaseKind.PRODUCER, "", work, stop)

    def follow(self, peer: str, session: Callable[[threading.Event], int], stop: threading.Event, pause: float = 0.0) -> None:
        """Run sessions with a peer one after the other: a session that ends well is followed by the
        next (after ``pause``), one that fails by another attempt after a growing delay."""

        def work(lost: threading.Event) -> None:
            while not (stop.is_set() or lost.is_set()):
                session(lost)
                _wait(pause, stop, lost)

        self._until(LeaseKind.STREAM, peer, work, stop)

    def _until(self, kind: LeaseKind, peer: str, work: Callable[[threading.Event], None], stop: threading.Event) -> None:
        # a lost lease ends the work, not the loop: it waits for the lease again
        while not stop.is_set():
            self._under(kind, peer, work, stop)

    def upkeep(self, stop: threading.Event) -> None:
        """Retention, compaction and expired leases, again after each interval."""
        while not stop.is_set():
            self.engine.cleanup()
            self.engine.metrics()
            self.leases.sweep()
            self.engine.store.vacuum()
            stop.wait(self.engine.config.outbox_cleanup)


def _wait(seconds: float, *events: threading.Event) -> None:
    """Wait, until one of the events is set."""
    left = seconds
    while left > 0 and not any(e.is_set() for e in events):
        step = min(left, 0.1)
        events[0].wait(step)
        left -= step
