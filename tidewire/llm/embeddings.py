"""Embedding near-dedup: one navigable small-world graph per shard.

Equal vectors are one class with a count. Classes are dealt over shards by a
hash; one task builds a shard's graph, once, and writes it in pieces to the
shared folder. Then every class queries every shard: the queries of one shard
to another, or a block of shards, are one cell, which reads that graph and
streams its queries past it, so a task holds one shard and one block of
queries. Beams widen
 - for a query, while everything in its beam links (it may have more), up to an
   exact scan of the shard, and
 - for the cell, while an audit (an exact scan for one query in AUDIT) finds a
   recall below RECALL.
Every link found is verified by cosine in double precision. A cell returns, for
each class with links, how many vectors it links to and a checksum of which
classes, as the query found them and as the graph's side was found, and a
spanning forest of its links, so groups of thousands of near copies never
become all their pairs.

A link that only one end's search found shows in the checksums: the two sides
of a class and a shard differ. Both ends then ask again, by exact scan, and so
does every class that such a scan reaches, until no new one appears. So each
link counts at both its ends, or (where neither search found it) at none.
Components of the forests are those of the links.

Rows: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing and are their own component. Vectors of different length do
not link. Repeated rows and repeated ids count each time; of equal ids one is
as good as another. An empty table gives an empty result. Extra columns are
ignored. Vectors may be as long as fit SHARD_BYTES many times over.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, maybe_broadcast, stash, tidy
from .hnsw import Graph

#: Shards at least, and classes and bytes of vectors in one at most, about: bounds a task's memory.
SHARDS, SHARD_SIZE, SHARD_BYTES = 8, 260_000, 64 << 20
#: Queries that one cell streams at most, about, and bytes of one written piece of a graph.
CELL, PIECE = 1_000_000, 4 << 20
BEAM, BLOCK, AUDIT, RECALL = 16, 2048, 32, 0.99
#: Slack of the single-precision graph similarities before the exact test.
SLACK = 1e-4


def _unit(v: np.ndarray) -> np.ndarray:
    """The unit vectors of rows, in double precision."""
    v = v.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Shard:
    """One shard's classes, their graph, and the beam its audits have led to."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, v: np.ndarray, threshold: float, graph: Graph | None = None) -> None:
        self.ids, self.counts, self.v, self.threshold, self.beam = ids, counts, v, threshold, BEAM
        # vectors stay as wide as they came; those of links are made unit ones in double precision when tested
        self.single = np.empty(v.shape, np.float32)
        for k in range(0, len(v), BLOCK):
            self.single[k : k + BLOCK] = _unit(v[k : k + BLOCK])
        self.graph = graph or Graph(self.single)

    @property
    def unit(self) -> np.ndarray:
        return _unit(self.v)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, counts=self.counts, v=self.v, **self.graph.state())
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes, threshold: float) -> Shard:
        x = dict(np.load(io.BytesIO(raw)))
        own = [x.pop(n) for n in ("ids", "counts", "v")]
        shard = cls(*own, threshold, graph=Graph.__new__(Graph))
        shard.graph.restore(shard.single, x)
        return shard

    def scan(self, q: np.ndarray) -> list[np.ndarray]:
        """For each query the rows within the slack of the threshold, by exact scan."""
        out: list[np.ndarray] = []
        step = max(1, (16 << 20) // max(1, len(self.single)))
        for k in range(0, len(q), step):
            s = q[k : k + step] @ self.single.T
            out += [np.flatnonzero(r >= self.threshold - SLACK) for r in s]
        return out

    def near(self, q: np.ndarray, beam: int) -> list[np.ndarray]:
        """The same by the graph; a query whose beam is full of links is asked again with a wider one."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        rest = np.arange(len(q))
        while len(rest):
            if 4 * beam >= len(self.single):
                for r, hit in zip(rest, self.scan(q[rest]), strict=True):
                    out[r] = hit
                break
            ids, sims = self.graph.search(q[rest], beam)
            hit = (sims >= self.threshold - SLACK) & (ids >= 0)
            full = hit.all(1)
            for r, i, h in zip(rest[~full], ids[~full], hit[~full], strict=True):
                out[r] = i[h]
            rest, beam = rest[full], 4 * beam
        return out

    def query(self, ids: np.ndarray, v: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(query row, shard row) of all verified links of a block."""
        unit = _unit(v)
        single = unit.astype(np.float32)
        audit = np.arange(len(ids)) if exact else np.flatnonzero(ids % AUDIT == 0)
        truth = self.scan(single[audit])
        while not exact:
            found = self.near(single, self.beam)
            want = sum(map(len, truth))
            got = sum(len(np.intersect1d(found[a], t, assume_unique=True)) for a, t in zip(audit, truth, strict=True))
            if got >= RECALL * want or self.beam >= len(self.ids):
                break
            self.beam *= 2
        if exact:
            found = truth
        else:
            for a, t in zip(audit, truth, strict=True):
                found[a] = t
        row = np.repeat(np.arange(len(ids)), [len(f) for f in found])
        hit = np.concatenate(found) if len(found) else np.zeros(0, np.int64)
        real = np.concatenate([np.einsum("kd,kd->k", unit[row[k : k + 65536]], _unit(self.v[hit[k : k + 65536]])) >= self.threshold for k in range(0, len(row), 65536)]) if len(row) else np.zeros(0, bool)
        real &= ids[row] != self.ids[hit]
        return row[real], hit[real]


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The edges among (a, b) that first join two trees."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _mix(ids: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers, one for each id: their exclusive or is the checksum of a set."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def graphs(classes: DataFrame, shards: int, threshold: float) -> DataFrame:
    """(shard, part, raw): every shard's classes and graph, written in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def built() -> Iterator[pa.RecordBatch]:
            raw = Shard(*(np.concatenate(p) for p in zip(*parts, strict=True)), threshold).dump()
            for k in range(0, len(raw), PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([k // PIECE], pa.int64()), pa.array([raw[k : k + PIECE]], pa.binary())], names=["shard", "part", "raw"])

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            for lo, hi in _stretches(shards):
                if parts and shards[lo] != key:
                    yield from built()
                    parts = []
                key = int(shards[lo])
                parts.append(_vectors(batch, lo, hi))
        if parts:
            yield from built()

    feed = classes.select("shard", "cid", "n", "v").repartition(4 * shards, "shard").sortWithinPartitions("shard", "cid")
    return feed.mapInArrow(run, "shard bigint, part bigint, raw binary")


def _stretches(*keys: np.ndarray) -> list[tuple[int, int]]:
    """The spans of rows in which all keys are equal."""
    if not len(keys[0]):
        return []
    turn = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    return list(zip([0, *turn.tolist()], [*turn.tolist(), len(keys[0])], strict=True))


def _vectors(batch: pa.RecordBatch, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = batch.column("v").slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False)
    return batch.column("cid").to_numpy()[lo:hi], batch.column("n").to_numpy()[lo:hi], flat.reshape(hi - lo, -1)


def _search(written: DataFrame, queries: DataFrame, shards: int, threshold: float, cells: int, exact: bool = False) -> DataFrame:
    """queries(shard, own, cid, n, v) past the graphs of their shards, to rows of one of three kinds:
    ``out`` (a, shard, n, x): what class a found in the shard, counted and checksummed;
    ``in`` (a, shard, n, x): the queries of that shard that found a; and ``edge`` (a, b)."""
    block = F.pmod(F.xxhash64("own"), F.lit(cells)).cast("int")
    none = F.lit(None)
    index = written.select("shard", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("block"), F.lit(-1).cast("long").alias("own"), F.col("part").alias("cid"), F.lit(0).cast("long").alias("n"), none.cast(queries.schema["v"].dataType).alias("v"), "raw")
    ask = queries.select("shard", block.alias("block"), "own", "cid", "n", "v", none.cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, raw, shard, source = None, [], None, None
        names = ["kind", "a", "b", "shard", "n", "x"]
        seen_n = seen_x = np.zeros(0)

        def rows(kind: str, a, b, at, n, x) -> pa.RecordBatch:
            k = len(a)
            full = [pa.array([kind] * k, pa.string()), pa.array(a, pa.int64()), pa.array([None] * k if b is None else b, pa.int64())]
            return pa.RecordBatch.from_arrays([*full, *(pa.array([None] * k if v is None else v, pa.int64()) for v in (at, n, x))], names=names)

        def flushed() -> Iterator[pa.RecordBatch]:
            if shard is not None and source is not None and not exact:
                some = np.flatnonzero(seen_n)
                yield rows("in", shard.ids[some], None, np.full(len(some), source), seen_n[some], seen_x[some].view(np.int64))
            elif shard is not None and source is not None:
                some = np.flatnonzero(seen_n)  # whom an exact scan reached
                yield rows("in", shard.ids[some], None, np.full(len(some), source), None, None)

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("shard", "block", "own")]
            for lo, hi in _stretches(*cols):
                at, own = (int(cols[0][lo]), int(cols[1][lo])), int(cols[2][lo])
                if at != cell:
                    yield from flushed()
                    cell, raw, shard, source = at, [], None, None
                if own < 0:
                    raw += batch.column("raw").slice(lo, hi - lo).to_pylist()
                    continue
                if shard is None:
                    if not raw:
                        continue
                    shard, raw = Shard.load(b"".join(raw), threshold), []
                if own != source:
                    yield from flushed()
                    source, seen_n, seen_x = own, np.zeros(len(shard.ids), np.int64), np.zeros(len(shard.ids), np.uint64)
                ids, counts, v = _vectors(batch, lo, hi)
                for k in range(0, len(ids), BLOCK):
                    mine, n = ids[k : k + BLOCK], counts[k : k + BLOCK]
                    row, hit = shard.query(mine, v[k : k + BLOCK], exact)
                    if not len(row):
                        continue
                    found = np.bincount(row, shard.counts[hit], len(mine)).astype(np.int64)
                    sums = np.zeros(len(mine), np.uint64)
                    np.bitwise_xor.at(sums, row, _mix(shard.ids[hit]))
                    np.add.at(seen_n, hit, n[row])
                    np.bitwise_xor.at(seen_x, hit, _mix(mine[row]))
                    some = np.flatnonzero(found)
                    yield rows("out", mine[some], None, np.full(len(some), at[0]), found[some], sums[some].view(np.int64))
                    tree = spanning(mine[row], shard.ids[hit])
                    yield rows("edge", [x for x, _ in tree], [y for _, y in tree], None, None, None)
        yield from flushed()

    keys = ["shard", "block"]
    # a partition holds few cells: their work, not their bytes, is what counts
    feed = index.unionByName(ask).repartition(2 * shards * cells, *keys).sortWithinPartitions(*keys, "own", "cid")
    return feed.mapInArrow(run, "kind string, a bigint, b bigint, shard bigint, n bigint, x bigint")


def links(classes: DataFrame, shards: int, threshold: float, cells: int) -> tuple[DataFrame, DataFrame]:
    """(a, n), the vectors that each class links to by the links found, and the (a, b) of forests of these links.

    classes is (cid, n, v, shard), with ``shards`` shards for each length of vectors.
    """
    written = stash(graphs(classes, shards, threshold), "graphs")
    every = classes.withColumn("own", F.col("shard"))
    per = F.lit(shards).cast("long")
    first = F.col("own") - F.pmod("own", per)
    ask = every.withColumn("shard", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), per - 1), lambda k: first + k)))
    found = stash(_search(written, ask.select("shard", "own", "cid", "n", "v"), shards, threshold, cells), "links")
    edges = found.where("kind = 'edge'").select("a", "b")
    at = ["a", "shard"]
    side = lambda kind: found.where(F.col("kind") == kind).groupBy(*at).agg(F.sum("n").alias(f"n_{kind}"), F.bit_xor("x").alias(f"x_{kind}"))
    sides = stash(side("out").join(side("in"), at, "full_outer"), "sides")
    agreed = F.col("n_out").eqNullSafe(F.col("n_in")) & F.col("x_out").eqNullSafe(F.col("x_in"))
    odd = stash(sides.where(~agreed).select(*at), "odd")
    exact, known = None, odd
    while not odd.isEmpty():
        ask = odd.withColumnRenamed("a", "cid").join(every.drop("shard"), "cid").select("shard", "own", "cid", "n", "v")
        again = stash(_search(written.join(maybe_broadcast(stash(odd.select("shard").distinct(), "shards")), "shard", "left_semi"), ask, shards, threshold, cells, exact=True), "exact")
        edges = edges.unionByName(again.where("kind = 'edge'").select("a", "b"))
        counts = again.where("kind = 'out'").select("a", "shard", "n")
        exact = counts if exact is None else exact.unionByName(counts)
        odd = stash(again.where("kind = 'in'").select(*at).distinct().join(known, at, "left_anti"), "odd")
        known = known.unionByName(odd)
    each = sides.where(agreed).select(*at, F.col("n_out").alias("n"))
    if exact is not None:
        each = each.join(known, at, "left_anti").unionByName(exact)
    return each.groupBy("a").agg(F.sum("n").alias("n")), edges


@tidy
def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, shards: int = SHARDS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & (F.size(v) > 0)
    rows = embeddings.select("vec_id", F.when(F.coalesce(finite, F.lit(False)), v).alias("v"))
    classes = rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    # the number of a row in the written files: fixed from here on
    classes = stash(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    size, longest = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    width = 4 if classes.schema["v"].dataType.elementType.typeName() == "float" else 8
    count = max(shards, math.ceil(size / min(shard_size, max(1, SHARD_BYTES // (width * longest)))))
    # cells enough for every core, and for their number of queries
    cells = min(count, max(math.ceil(4 * embeddings.sparkSession.sparkContext.defaultParallelism / count), math.ceil(size / CELL)))
    shard = F.size("v").cast("long") * count + F.pmod(F.xxhash64("cid"), F.lit(count))
    degree, edges = links(classes.select("cid", "n", "v", shard.alias("shard")), count, threshold, cells)
    comp = components(edges)
    degree = degree.select(F.col("a").alias("cid"), F.col("n").alias("more"))
    known = classes.join(degree, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
    known = stash(known.select("cid", "v", "first", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("comp")), "known")
    least = stash(known.groupBy("comp").agg(F.min("first").alias("component_id")), "least")
    named = known.join(least, "comp").select(F.xxhash64("v").alias("hv"), F.col("v").alias("_v"), "n_links", "component_id")
    named = stash(named, "named")
    out = rows.join(named, (F.xxhash64("v") == F.col("hv")) & (F.col("v") == F.col("_v")), "left")
    component = F.when(F.col("hv").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
