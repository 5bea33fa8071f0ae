"""Key providers and the manager."""

from __future__ import annotations

import base64
import json

import pytest

from tidewire.functions.keyring import MOST_BYTES, EnvProvider, HttpProvider, KeyManager, Ring, VaultProvider, merge

DOC = {"active_key_id": "b", "keys": {"a": base64.b64encode(b"1" * 32).decode(), "b": base64.b64encode(b"2" * 32).decode()}}


class Fixed:
    def __init__(self, *rings):
        self.rings = list(rings)

    def load(self):
        ring = self.rings.pop(0) if len(self.rings) > 1 else self.rings[0]
        if isinstance(ring, Exception):
            raise ring
        return ring


def test_providers_read_their_documents():
    env = {"CRYPTO_KEY_CURRENT": base64.b64encode(b"k" * 16).decode(), "OTHER": "x"}
    assert EnvProvider(env=env).load() == Ring("current", {"current": b"k" * 16})
    with pytest.raises(ValueError):
        EnvProvider("gone", env=env).load()
    assert HttpProvider("http://k", fetch=lambda u, h: json.dumps(DOC).encode()).load().keys["a"] == b"1" * 32
    with pytest.raises(ValueError):
        HttpProvider("http://k", fetch=lambda u, h: b" " * (MOST_BYTES + 1)).load()
    seen = []
    vault = VaultProvider("http://v/", "secret/data/k", "t", lambda u, h: seen.append((u, h)) or json.dumps({"data": {"data": DOC}}).encode())
    assert vault.load().active == "b" and seen == [("http://v/v1/secret/data/k", {"X-Vault-Token": "t"})]


def test_later_providers_win():
    ring = merge([Fixed(Ring("a", {"a": b"1", "c": b"3"})), Fixed(Ring("", {"a": b"2"}))])
    assert ring == Ring("a", {"a": b"2", "c": b"3"})


def test_manager_retries_and_keeps_the_last_good_ring():
    waits = []
    good = Ring("a", {"a": b"1"})
    m = KeyManager([Fixed(OSError(), good, OSError())], ["a"], 2, 0.5, waits.append)
    assert waits == [0.5] and m.key("a") == b"1" and m.active == "a"
    assert not m.refresh() and m.keys == {"a": b"1"}
    with pytest.raises(KeyError):
        m.key("b")
    with pytest.raises(ValueError):
        KeyManager([Fixed(good)], ["b"], 1)
