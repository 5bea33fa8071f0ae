"""Configuration: YAML with environment expansion, defaults and validation."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from .spec import Config, Mode, PeerSpec, TableSpec, TransformerSpec

_UNIT = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def expand(text: str, env: Mapping[str, str]) -> str:
    """Replace $NAME and ${NAME}; unset names become empty and $$ a single dollar."""
    return re.sub(r"\$(?:\$|\{([^}]*)\}|([A-Za-z_]\w*))", lambda m: "$" if m[0] == "$$" else env.get(m[1] or m[2] or "", ""), text)


def seconds(value: Any, default: float) -> float:
    """A duration such as 5s, 1m30s or 200ms; missing and non-positive ones give the default."""
    if value is None or value == "":
        return default
    if isinstance(value, int | float):
        total = float(value)
    else:
        parts = re.findall(r"([\d.]+)(ns|us|µs|ms|s|m|h)", str(value))
        if "".join(a + b for a, b in parts) != str(value).lstrip("+-"):
            raise ValueError(f"not a duration: {value!r}")
        total = sum(float(a) * _UNIT[b] for a, b in parts) * (-1 if str(value).startswith("-") else 1)
    return total if total > 0 else default


def _count(value: Any, default: int) -> int:
    return int(value) if value and int(value) > 0 else default


def parse(text: str, env: Mapping[str, str] | None = None) -> Config:
    """A validated Config of YAML text."""
    import yaml

    raw = yaml.safe_load(expand(text, os.environ if env is None else env)) or {}

    def at(*path: str) -> Any:
        here: Any = raw
        for key in path:
            here = here.get(key) if isinstance(here, Mapping) else None
        return here

    base = Config(region="")
    source = at("replication", "source") or {}
    cfg = Config(
        region=str(at("region") or ""),
        tables=[TableSpec(t.get("name") or "", tuple(t.get("primary_key") or ()), t.get("region_field") or "", t.get("updated_at_field") or None) for t in at("tables") or []],
        peers=[PeerSpec(p.get("region") or "", p.get("endpoint") or "") for p in at("peers") or []],
        transformers=[TransformerSpec(t.get("table") or "", tuple(t.get("fields") or ()), t.get("key_id") or "", t.get("crypto_type") or "", t.get("type") or "") for t in at("transformers") or []],
        source_type=source.get("type") or base.source_type,
        update_diff=bool((source.get("cdc") or {}).get("update_diff")),
        poll_interval=seconds((source.get("polling") or {}).get("interval"), base.poll_interval),
        status_interval=seconds((source.get("cdc") or {}).get("status_interval"), base.status_interval),
        chunk_size=_count(at("replication", "snapshot", "chunk_size"), base.chunk_size),
        apply_mode=at("replication", "apply_mode") or base.apply_mode,
        broadcast_mode=at("replication", "broadcast_mode") or base.broadcast_mode,
        max_batch_events=_count(at("replication", "max_batch_events"), base.max_batch_events),
        lease_ttl=seconds(at("lease", "ttl"), base.lease_ttl),
        lease_renew=seconds(at("lease", "renew_interval"), base.lease_renew),
        lease_cleanup=seconds(at("lease", "cleanup_interval"), base.lease_cleanup),
        outbox_cleanup=seconds(at("outbox", "cleanup_interval"), base.outbox_cleanup),
        max_batch_age=seconds(at("outbox", "max_batch_age"), base.max_batch_age),
        max_pending_per_peer=_count(at("outbox", "max_pending_per_peer"), base.max_pending_per_peer),
        reconnect_delay=seconds(at("transport", "reconnect_delay"), base.reconnect_delay),
        key_refresh=seconds(at("crypto", "refresh_interval"), base.key_refresh),
        key_attempts=_count(at("crypto", "retry_attempts"), base.key_attempts),
        key_delay=seconds(at("crypto", "retry_delay"), base.key_delay),
        active_key_id=at("crypto", "source", "env", "active_key_id") or base.active_key_id,
        log_level=at("log_level") or base.log_level,
        log_format=at("log_format") or base.log_format,
    )
    validate(cfg)
    cfg.apply_mode, cfg.broadcast_mode = Mode(cfg.apply_mode), Mode(cfg.broadcast_mode)
    return cfg


def load(path: str | Path) -> Config:
    return parse(Path(path).read_text())


def validate(cfg: Config) -> None:
    """Raise ValueError naming everything that is wrong."""
    modes = {m.value for m in Mode}
    wrong = []
    if not cfg.region:
        wrong.append("region is required")
    if cfg.log_level not in ("debug", "info", "warn", "error"):
        wrong.append("log_level must be debug, info, warn or error")
    if cfg.log_format not in ("text", "json"):
        wrong.append("log_format must be text or json")
    if cfg.source_type not in ("cdc", "polling"):
        wrong.append("replication.source.type must be cdc or polling")
    if cfg.update_diff and cfg.source_type == "polling":
        wrong.append("update_diff needs the cdc source")
    for name, mode in (("apply_mode", cfg.apply_mode), ("broadcast_mode", cfg.broadcast_mode)):
        if mode not in modes:
            wrong.append(f"replication.{name} must be one of {', '.join(sorted(modes))}")
    if cfg.lease_renew >= cfg.lease_ttl:
        wrong.append("lease.renew_interval must be below lease.ttl")
    regions = [p.region for p in cfg.peers]
    if any(not p.region or not p.endpoint for p in cfg.peers):
        wrong.append("peers need a region and an endpoint")
    if len(set(regions)) < len(regions):
        wrong.append("peer regions must be unique")
    if not cfg.tables:
        wrong.append("a table is required")
    for t in cfg.tables:
        if not t.name or not t.primary_key or not t.region_field:
            wrong.append(f"table {t.name!r} needs a name, a primary key and a region field")
        if cfg.source_type == "polling" and not t.updated_at_field:
            wrong.append(f"table {t.name!r} needs updated_at_field to be polled")
    names = {t.name for t in cfg.tables}
    for x in cfg.transformers:
        if x.type != "crypto" or x.table not in names or not x.crypto_type or not x.fields or not x.key_id:
            wrong.append(f"transformer for {x.table!r} needs type crypto, a known table, crypto_type, fields and key_id")
        # such names would leave here and be refused by the peer
        if bad := [f for f in x.fields if not re.fullmatch(r"[a-z0-9_-]+", f)]:
            wrong.append(f"encrypted field names must match [a-z0-9_-]+: {', '.join(bad)}")
    if wrong:
        raise ValueError("; ".join(wrong))
