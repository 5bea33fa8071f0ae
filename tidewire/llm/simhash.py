"""SimHash near-dedup by anchor-point covering.

Fingerprints within ``threshold`` bits of one another are found through a
covering code. The code is the [63, 57] Hamming code on bits 1 to 63 with bit
64 free: its covering radius R is 1. Two fingerprints at most t bits apart
have a point within ceil(t/2) of both, and an anchor within R of that point,
so replicating each fingerprint to every anchor within R + ceil(t/2) of it
brings each linked pair together at one anchor at least. This is the tight
form of "radius plus threshold" (683 anchors a fingerprint at t = 2 instead of
33); ``reach`` can be raised to R + t, with the same links.

At one anchor at most sum(C(64, i), i <= reach) distinct fingerprints can meet
(2,081 at reach 2), whatever the data: the geometry bounds the group. What an
anchor returns is a spanning forest of its links, never all pairs.

Rows: a null text has no words; documents without words have fingerprint zero
and link like any other. Equal texts, repeated rows and equal fingerprints are
one class. Very long texts are hashed in blocks; a bit that is set in exactly
half the hashes is 0. Rows with a null doc_id are kept; they never name a
component unless nothing else in it has an id. An empty table gives an empty
result. Extra columns are ignored, or kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, maybe_broadcast, stash, tidy
from .textmap import map_texts

BITS = 64
RADIUS = 1
#: Shingles that are unpacked to bits at once; bounds memory for very long texts.
BLOCK = 1 << 16


def fingerprint(text: str | None, seed: int = 42, width: int = 3) -> int:
    """64-bit SimHash: a bit is 1 if set in over half the hashes of all word shingles.

    A-Z become lower case, words are runs without white space (space, \\t to
    \\r); shingles are ``width`` words joined by one space, repeats included.
    Fewer words make one shingle, no words make zero.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(flat, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    ends, starts, h = end[width - 1 :].tolist(), (end - size)[: len(words) - width + 1].tolist(), xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(starts)
    for k in range(0, n, BLOCK):
        hashes = np.array([h(flat[a:b], seed) for a, b in zip(starts[k : k + BLOCK], ends[k : k + BLOCK], strict=True)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., fp long): the fingerprint as a signed 64-bit number."""

    def run(texts: list) -> dict[str, list]:
        return {"fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

    some = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text).alias("text"))
    schema = ", ".join(f"{c} {some.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    return map_texts(some, run, f"{schema}, fp bigint")


@lru_cache
def _flips(reach: int) -> dict[int, np.ndarray]:
    """For each syndrome, the flip masks of at most ``reach`` bits that lead to a code word."""
    from itertools import combinations

    out: dict[int, list[int]] = {s: [] for s in range(64)}
    # bit position p (0..62) has parity column p + 1; bit 63 is free
    for n in range(reach + 1):
        for some in combinations(range(BITS), n):
            s = mask = 0
            for p in some:
                s ^= p + 1 if p < 63 else 0
                mask |= 1 << p
            out[s].append(mask)
    return {s: np.array(m, np.uint64) for s, m in out.items()}


def anchors(fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor within ``reach`` bits of fps[row]."""
    syndrome = np.zeros(len(fps), np.int64)
    for p in range(63):
        syndrome ^= np.where((fps >> np.uint64(p)) & np.uint64(1), p + 1, 0)
    rows, keys = [], []
    for s in np.unique(syndrome):
        at = np.flatnonzero(syndrome == s)
        masks = _flips(reach)[int(s)]
        rows.append(np.repeat(at, len(masks)))
        keys.append((fps[at][:, None] ^ masks[None, :]).ravel())
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def forest(members: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints of one anchor."""
    x = np.unique(members)
    left = np.ones(len(x), bool)
    edges = []
    while left.any():
        queue = [int(np.argmax(left))]
        left[queue[0]] = False
        while queue:
            at = queue.pop()
            near = np.flatnonzero(left & (np.bitwise_count(x ^ x[at]) <= threshold))
            left[near] = False
            queue += near.tolist()
            edges += [(int(x[k]), int(x[at])) for k in near]
    return edges


def links(fps: DataFrame, threshold: int = 2, reach: int | None = None) -> DataFrame:
    """Edges (a, b) that span the link graph of the distinct values in fps(fp)."""
    reach = RADIUS + (threshold + 1) // 2 if reach is None else reach

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            x = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for k in range(0, len(x), 20_000):
                rows, keys = anchors(x[k : k + 20_000], reach)
                yield pd.DataFrame({"anchor": keys.view(np.int64), "fp": x[k : k + 20_000][rows].view(np.int64)})

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = {e for m in pdf["fps"] for e in forest(np.asarray(m, np.int64).view(np.uint64), threshold)}
            pairs = np.array(sorted(found), np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    met = fps.select("fp").distinct().mapInPandas(spread, "anchor bigint, fp bigint").groupBy("anchor").agg(F.collect_list("fp").alias("fps"))
    return met.where(F.size("fps") > 1).select("fps").mapInPandas(compare, "a bigint, b bigint").distinct()


@tidy
def simhash_components(docs: DataFrame, threshold: int = 2, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most ``threshold``
    differing bits reach.
    """
    fps = stash(fingerprints(docs, text, id_col), "fp")
    first = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "first")
    comp = components(links(first, threshold)).withColumnsRenamed({"node": "fp"})
    joined = stash(first.join(comp, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "comp")
    least = stash(joined.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    named = stash(joined.join(least, "component").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@tidy
def simhash_dedup(docs: DataFrame, threshold: int = 2, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each group kept: that of the smallest id (null ids last, then by text).

    A repeated row, with the id and the text of the one that stays, goes as well.
    """
    key = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    each = stash(fingerprints(key, "t", "doc_id", keep=("h",)), "fp")
    first = stash(each.select("fp").distinct(), "first")
    comp = maybe_broadcast(stash(components(links(first, threshold)).withColumnsRenamed({"node": "fp"}), "comp"))
    each = each.join(comp, "fp", "left").select("doc_id", "h", F.coalesce("component", "fp").alias("c"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    rows = each.groupBy("c", "doc_id", "h").agg(F.count("*").alias("n"))
    best = rows.groupBy("c").agg(F.min(order).alias("best"), F.sum("n").alias("all")).where(F.col("all") > 1).select("c", "best")
    marked = stash(rows.join(maybe_broadcast(stash(best, "best")), "c").select(F.col("doc_id").alias("__tw_d"), F.col("h").alias("__tw_h"), (order == F.col("best")).alias("stays"), "n"), "marked")
    same = F.col(id_col).eqNullSafe(F.col("__tw_d")) & (F.xxhash64(text) == F.col("__tw_h"))
    left = docs.join(maybe_broadcast(marked.where("not stays").select("__tw_d", "__tw_h")), same, "left_anti")
    repeated = marked.where("stays and n > 1").select("__tw_d", "__tw_h")
    if repeated.isEmpty():
        return left
    repeated = maybe_broadcast(repeated)
    once = left.join(repeated, same, "left_semi").withColumn("__tw_h", F.xxhash64(text)).dropDuplicates([id_col, "__tw_h"]).drop("__tw_h")
    return left.join(repeated, same, "left_anti").unionByName(once)
