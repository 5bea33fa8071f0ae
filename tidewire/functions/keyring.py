"""Key rings: providers, merging, and a manager that refreshes and keeps the last good ring.

Keys stay on the driver as objects; they enter plans only as literals of the
encryption functions.
"""

from __future__ import annotations

import base64
import json
import os
import threading
import time
import urllib.request
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Protocol

#: Bytes of a provider's answer that are read at most.
MOST_BYTES = 1 << 20


@dataclass(frozen=True)
class Ring:
    """Keys by id, and the id of the one in use."""

    active: str = ""
    keys: Mapping[str, bytes] = field(default_factory=dict)


class Provider(Protocol):
    def load(self) -> Ring: ...


@dataclass
class EnvProvider:
    """Keys from variables: PREFIX + id in upper case holds base64. The active key must be there."""

    active: str = "current"
    prefix: str = "CRYPTO_KEY_"
    env: Mapping[str, str] = field(default_factory=lambda: os.environ)

    def load(self) -> Ring:
        keys = {n[len(self.prefix) :].lower(): base64.b64decode(v) for n, v in self.env.items() if n.startswith(self.prefix) and v}
        if self.active.lower() not in keys:
            raise ValueError(f"no key {self.active!r} in the environment")
        return Ring(self.active, keys)


def _fetch(url: str, headers: Mapping[str, str]) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers=dict(headers)), timeout=10) as answer:
        return answer.read(MOST_BYTES + 1)


def _ring(raw: Mapping) -> Ring:
    return Ring(raw.get("active_key_id") or "", {k: base64.b64decode(v) for k, v in (raw.get("keys") or {}).items()})


@dataclass
class HttpProvider:
    """A JSON document {active_key_id, keys: {id: base64}} of at most 1 MiB."""

    url: str
    headers: Mapping[str, str] = field(default_factory=dict)
    fetch: Callable[[str, Mapping[str, str]], bytes] = _fetch

    def load(self) -> Ring:
        body = self.fetch(self.url, self.headers)
        if len(body) > MOST_BYTES:
            raise ValueError("the key document is larger than 1 MiB")
        return _ring(json.loads(body))


@dataclass
class VaultProvider:
    """The same document as a secret of a version-2 key-value store."""

    address: str
    path: str
    token: str
    fetch: Callable[[str, Mapping[str, str]], bytes] = _fetch

    def load(self) -> Ring:
        body = self.fetch(f"{self.address.rstrip('/')}/v1/{self.path.lstrip('/')}", {"X-Vault-Token": self.token})
        return _ring(json.loads(body)["data"]["data"])


def merge(providers: Iterable[Provider]) -> Ring:
    """One ring of all; later providers win."""
    active, keys = "", {}
    for p in providers:
        ring = p.load()
        active, keys = ring.active or active, {**keys, **ring.keys}
    return Ring(active, keys)


class KeyManager:
    """Loads with retries, checks that the required keys are there, refreshes in the background."""

    def __init__(self, providers: Iterable[Provider], required: Iterable[str] = (), attempts: int = 3, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> None:
        self._providers, self._required, self._attempts, self._delay, self._sleep = list(providers), set(required), attempts, delay, sleep
        self._ring = self._load()

    def _load(self) -> Ring:
        for left in range(self._attempts - 1, -1, -1):
            try:
                ring = merge(self._providers)
                if missing := self._required - ring.keys.keys():
                    raise ValueError(f"keys are missing: {', '.join(sorted(missing))}")
                return ring
            except Exception:
                if not left:
                    raise
                self._sleep(self._delay)
        raise ValueError("no attempts")

    def refresh(self) -> bool:
        """Load anew; a failure keeps the last good ring."""
        try:
            self._ring = self._load()
            return True
        except Exception:
            return False

    def run(self, interval: float, stop: threading.Event) -> None:
        while not stop.wait(interval):
            self.refresh()

    def key(self, key_id: str) -> bytes:
        if key_id not in self._ring.keys:
            raise KeyError(f"key {key_id!r} is not configured")
        return self._ring.keys[key_id]

    @property
    def keys(self) -> Mapping[str, bytes]:
        return dict(self._ring.keys)

    @property
    def active(self) -> str:
        return self._ring.active
