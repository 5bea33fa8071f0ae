"""Leases: compare-and-swap ownership in the state store, and a runner that works under one."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import asdict, replace

from ..spec import Lease, LeaseKind
from .metrics import Meters
from .state import StateStore


class PermanentError(RuntimeError):
    """Not worth another attempt."""


def _key(lease: Lease) -> str:
    return "|".join((lease.kind, lease.region, lease.peer, lease.table or ""))


class Leases:
    """The leases of one store; ``clock`` is the only clock for expiry and for tests of it."""

    def __init__(self, store: StateStore, clock: Callable[[], float] = time.time, meters: Meters | None = None) -> None:
        self.store, self.clock, self.meters = store, clock, meters or Meters()

    def _counted(self, what: str, act: Callable[[], Lease | None], none: str) -> Lease | None:
        try:
            got = act()
        except Exception:
            self.meters.add(f"lease_{what}_errors_total")
            raise
        self.meters.add(f"lease_{what}_{'ok' if got else none}_total")
        return got

    def _change(self, act: Callable[[dict], None]) -> dict:
        def change(old: dict | None) -> dict:
            new = dict(old or {})
            act(new)
            return new

        return self.store.update("leases", change, {})

    def acquire(self, lease: Lease, ttl: float) -> Lease | None:
        """Take a free, expired or own lease; the generation rises when the owner changes."""
        got: list[Lease | None] = [None]

        def act(all_leases: dict) -> None:
            got[0] = None
            now, old = self.clock(), all_leases.get(_key(lease))
            if old and old["expires_at"] > now and old["owner"] != lease.owner:
                return
            generation = (old["generation"] + (old["owner"] != lease.owner)) if old else 1
            got[0] = replace(lease, generation=generation, expires_at=now + ttl)
            all_leases[_key(lease)] = asdict(got[0])

        return self._counted("acquire", lambda: (self._change(act), got[0])[1], "miss")

    def renew(self, lease: Lease, ttl: float) -> Lease | None:
        """Extend a lease that is still held: same owner and generation, not expired."""
        got: list[Lease | None] = [None]

        def act(all_leases: dict) -> None:
            got[0] = None
            now, old = self.clock(), all_leases.get(_key(lease))
            if old and old["owner"] == lease.owner and old["generation"] == lease.generation and old["expires_at"] > now:
                got[0] = replace(lease, expires_at=now + ttl)
                all_leases[_key(lease)] = asdict(got[0])

        return self._counted("renew", lambda: (self._change(act), got[0])[1], "lost")

    def release(self, lease: Lease) -> bool:
        done = [False]

        def act(all_leases: dict) -> None:
            old = all_leases.get(_key(lease))
            done[0] = bool(old and old["owner"] == lease.owner and old["generation"] == lease.generation)
            if done[0]:
                del all_leases[_key(lease)]

        self._change(act)
        return done[0]

    def get(self, lease: Lease) -> Lease:
        """The stored lease, or an empty one of the same place."""
        old = self.store.value("leases", {}).get(_key(lease))
        return Lease(**{**old, "kind": LeaseKind(old["kind"])}) if old else replace(lease, owner="", generation=0, expires_at=0.0)

    def sweep(self) -> int:
        """Delete expired leases; returns how many."""
        gone = [0]

        def act(all_leases: dict) -> None:
            dead = [k for k, v in all_leases.items() if v["expires_at"] <= self.clock()]
            gone[0] = len(dead)
            for k in dead:
                del all_leases[k]

        self._change(act)
        return gone[0]

    def run(self, lease: Lease, work: Callable[[threading.Event], None], ttl: float, renew: float, stop: threading.Event, retry: float | Callable[[int], float] = 1.0) -> None:
        """Work while the lease is held: a miss waits one renewal, a lost lease sets the work's
        event, errors are retried after ``retry`` seconds (or what it says for the attempt),
        PermanentError ends it."""
        attempt = 0
        while not stop.is_set():
            try:
                held = self.acquire(lease, ttl)
            except Exception:
                held = None
            if held is None:
                stop.wait(renew)
                continue
            lost, over = threading.Event(), threading.Event()

            def keep(held: Lease = held, lost: threading.Event = lost, over: threading.Event = over) -> None:
                while not over.wait(renew):
                    try:
                        kept = None if stop.is_set() else self.renew(held, ttl)
                    except Exception:
                        kept = None
                    if kept is None:
                        lost.set()
                        return

            thread = threading.Thread(target=keep, daemon=True)
            thread.start()
            try:
                work(lost)
                return
            except PermanentError:
                raise
            except Exception:
                stop.wait(retry(attempt) if callable(retry) else retry)
                attempt += 1
            finally:
                over.set()
                thread.join()
                self.release(held)
