"""What a region counts and measures, in the text form that scrapers read."""

from __future__ import annotations

import threading
from collections.abc import Mapping

#: Kinds of message that a session sends and receives.
MESSAGES = ("handshake", "snapshot_chunk", "event_batch", "transaction_batch", "snapshot_complete", "ack")

#: Families: name -> (kind, help). All begin with the prefix; counters end in _total.
FAMILIES: dict[str, tuple[str, str]] = {
    "reconnect_attempts_total": ("counter", "Sessions that failed and were tried again."),
    "last_reconnect_delay_seconds": ("gauge", "Seconds waited before the last attempt."),
    "ack_latency_samples_total": ("counter", "Acknowledged batches whose age was taken."),
    "ack_latency_total_seconds": ("counter", "Seconds from staging to acknowledgement, summed."),
    "apply_applied_total": ("counter", "Inbound events past their cursor."),
    "apply_stale_total": ("counter", "Inbound events at or below their cursor, dropped."),
    "apply_errors_total": ("counter", "Pages of inbound batches that failed."),
    "snapshot_rows_sent_total": ("counter", "Snapshot rows sent."),
    "snapshot_chunks_sent_total": ("counter", "Snapshot chunks sent."),
    "snapshot_rows_received_total": ("counter", "Snapshot rows received."),
    "snapshot_chunks_received_total": ("counter", "Snapshot chunks received."),
    "snapshot_finished_total": ("counter", "Snapshots whose last chunk was received."),
    "snapshot_send_errors_total": ("counter", "Snapshots that failed while being sent."),
    "snapshot_apply_errors_total": ("counter", "Snapshot rows that could not be applied."),
    "messages_total": ("counter", "Messages by direction and type."),
    "lease_acquire_ok_total": ("counter", "Leases taken."),
    "lease_acquire_miss_total": ("counter", "Leases that another owner held."),
    "lease_acquire_errors_total": ("counter", "Attempts at a lease that failed."),
    "lease_renew_ok_total": ("counter", "Leases renewed."),
    "lease_renew_lost_total": ("counter", "Leases found lost at renewal."),
    "lease_renew_errors_total": ("counter", "Renewals that failed."),
    "changefeed_events_total": ("counter", "Events captured."),
    "changefeed_batches_total": ("counter", "Batches staged, one a peer."),
    "outbox_pending_batches": ("gauge", "Batches not acknowledged."),
    "outbox_oldest_batch_age_seconds": ("gauge", "Age of the oldest of these."),
    "outbox_cleanup_deleted_total": ("counter", "Batches that retention removed."),
    "outbox_cleanup_deleted_by_age_total": ("counter", "Of these, by age."),
    "outbox_cleanup_deleted_by_count_total": ("counter", "Of these, by number."),
}


class Meters:
    """Values of all families from the start on; safe to use from several threads."""

    def __init__(self, prefix: str = "tidewire_", labels: Mapping[str, str] | None = None) -> None:
        self.prefix, self.labels, self._lock = prefix, dict(labels or {}), threading.Lock()
        self._values: dict[tuple[str, tuple[tuple[str, str], ...]], float] = {(n, ()): 0.0 for n in FAMILIES if n != "messages_total"}
        self._values |= {("messages_total", (("direction", d), ("type", t))): 0.0 for d in ("sent", "received") for t in MESSAGES}

    def add(self, name: str, value: float = 1, **labels: str) -> None:
        if FAMILIES[name][0] != "counter" or value < 0:
            raise ValueError(f"{name} is no counter, or {value} is negative")
        with self._lock:
            self._values[name, tuple(sorted(labels.items()))] = self._values.get((name, tuple(sorted(labels.items()))), 0.0) + value

    def set(self, name: str, value: float) -> None:
        if FAMILIES[name][0] != "gauge":
            raise ValueError(f"{name} is no gauge")
        with self._lock:
            self._values[name, ()] = value

    def get(self, name: str, **labels: str) -> float:
        with self._lock:
            return self._values[name, tuple(sorted(labels.items()))]

    def text(self) -> str:
        """The exposition format: help, type and one line a series."""
        escaped = lambda v: v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
        out = []
        with self._lock:
            for name, (kind, about) in FAMILIES.items():
                out += [f"# HELP {self.prefix}{name} {about}", f"# TYPE {self.prefix}{name} {kind}"]
                for (n, labels), value in self._values.items():
                    if n == name:
                        every = [*self.labels.items(), *labels]
                        inside = "{" + ",".join(f'{k}="{escaped(v)}"' for k, v in every) + "}" if every else ""
                        out.append(f"{self.prefix}{name}{inside} {value:g}")
        return "\n".join(out) + "\n"
