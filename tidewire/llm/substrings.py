"""Substring dedup: paragraph MinHash banding, and exact repeats inside paragraphs.

A paragraph is a line. Paragraphs of ``BAND_WORDS`` words or more are cut into
five-word shingles and banded by MinHash, bands tuned to a recall of 0.99 at
the threshold. Different paragraphs that collide in a band are candidates:
first against the band's first paragraph and against their predecessor in it,
two candidates a member, streamed in sorted order by ranges, so that a band may
spread over tasks. Where these leave a band
with several classes, every paragraph outside its largest class is compared
with all of the band: both are dealt into blocks of about ``CELL`` paragraphs,
and a cell compares two blocks and returns links that join classes, never all
pairs. So whatever its size no group is gathered, and no link is lost that a
band brings together. Exact Jaccard on the shingle sets (as 32-bit hashes)
verifies; components of verified links are classes of paragraphs, and equal
paragraphs are one.

Passages inside paragraphs are found by winnowing: of every ``WINNOW``
neighbouring windows of ``WINDOW`` words, the one with the least hash is
looked up. Which windows these are depends on the words alone, so they fall
alike wherever a passage is embedded, across lines too: any run of
``WINDOW + WINNOW - 1`` words that two documents share has one in common, and
all of the run but at most ``WINNOW - 1`` words at either end is covered. So
where words that occur again end, a second look-up takes every window near the
windows found there, in each document that has these, and finds the run's true
ends: all of it is covered.

Of each class, and of each repeated window, the document with the smallest
doc_id keeps its own; in every other document it occurs again. A run of words
that occur again goes if it has ``RUN_WORDS`` words or more, as every shared run
of so many does; shorter ones, such as stock lines and licenses, stay. Repeats inside one document are left
alone. Words are compared lower-cased.

Rows: a null text has no words and stays null; rows with a null doc_id are left
as they are. Repeated rows (same id) are one document. An empty table gives an
empty result. Extra columns stay; a document that repeats wholly becomes the
empty text. Whole texts count, however long.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, free, maybe_broadcast, small, stash, tidy

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.99
#: Words of a looked-up window, and neighbouring windows of which one is looked up.
WINDOW, WINNOW = 24, 24
#: Words that a paragraph needs to be banded, and a run to be removed.
BAND_WORDS, RUN_WORDS = 20, 50
#: Paragraphs of a band that one cell holds, and that stream past it, about.
CELL = 512
#: Paragraph hashes, and word hashes, that a task remembers.
REMEMBERED = 1 << 20
_WORD = re.compile(r"\S+")
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def tune(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 10) -> tuple[int, int]:
    """(bands, rows): the most selective bands that reach the recall with at most ``most`` bands."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands <= most:
            return bands, rows
    return most, 1


def word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each word; known remembers those of the task so far."""
    if len(known) > REMEMBERED:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rolled(h: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words (or of those that start at ``at``), from the words' hashes; empty for fewer words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n if at is None else len(at), np.uint64)
    for k in range(width):
        out = out * np.uint64(_BASE) + (h[k : k + n] if at is None else h[at + k])
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return out ^ (out >> np.uint64(29))


def shingles(h: np.ndarray) -> np.ndarray:
    """The sorted distinct 32-bit hashes of a paragraph's five-word shingles, from its words' hashes."""
    return np.unique((rolled(h, min(SHINGLE, len(h))) >> np.uint64(32)).astype(np.uint32))


def winnowed(h: np.ndarray, width: int = WINDOW, among: int = WINNOW) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows to look up: the least of every ``among`` neighbours.

    Of a row of equal windows, which one word repeated gives, one in ``among`` and the last stay.
    """
    keys = rolled(h, width)
    if len(keys) <= among:
        at = np.array([keys.argmin()]) if len(keys) else np.zeros(0, np.int64)
        return at, keys[at]
    at = np.unique(np.lib.stride_tricks.sliding_window_view(keys, among).argmin(1) + np.arange(len(keys) - among + 1))
    got = keys[at]
    goes_on = np.concatenate([[False], (got[1:] == got[:-1]) & (np.diff(at) == 1)])
    turn = np.arange(len(at)) - np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(at))))
    stays = (turn % among == 0) | ~np.concatenate([goes_on[1:], [False]])
    return at[stays], got[stays]


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """MinHash band keys, one row for each (non-empty) set."""
    flat = np.concatenate(sets).astype(np.uint64)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    rng = np.random.default_rng(17)
    mult = rng.integers(1, 1 << 63, bands * rows, np.uint64) | np.uint64(1)
    keys = np.zeros((len(sets), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sets), b + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(rows):
            least = np.minimum.reduceat((flat * mult[b * rows + r] + mult[b]) >> np.uint64(32), start)
            key = (key ^ least) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(29)
        keys[:, b] = key
    return keys.view(np.int64)


def passages(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, v, pos, last, p, bands, sh): windows to look up (last null) and banded paragraphs (words pos to last).

    v tells texts of one id apart, p is the hash of the words. Band keys and
    shingles come where a task first meets a paragraph.
    """
    bands, rows = tune(threshold)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        known: dict[str, int] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                size, pos, keys = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                line_at, line_pos, line_last, line_key, sets = [], [], [], [], []
                for d, text in enumerate(part.column("text").to_pylist()):
                    lines = [line.split() for line in (text or "").lower().split("\n")]
                    h = word_hashes([w for line in lines for w in line], known)
                    at, got = winnowed(h)
                    size.append(len(at)), pos.append(at), keys.append(got)
                    begun = 0
                    for line in lines:
                        if len(line) >= BAND_WORDS:
                            own = h[begun : begun + len(line)]
                            key = xxhash.xxh64_intdigest(own.tobytes())
                            if len(met) >= REMEMBERED:
                                met.clear()
                            line_at.append(d), line_pos.append(begun), line_last.append(begun + len(line) - 1), line_key.append(key)
                            sets.append(None if key in met else shingles(own))
                            met.add(key)
                        begun += len(line)
                real = [x for x in sets if x is not None]
                banded = iter(band_keys(real, bands, rows) if real else [])
                none = [None] * sum(size)
                take = pa.array(np.concatenate([np.repeat(np.arange(len(size)), size), np.array(line_at, np.int64)]).astype(np.int64))
                p = np.concatenate([*keys, np.array(line_key, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("v").take(take), pa.array(np.concatenate([*pos, np.array(line_pos, np.int64)]).astype(np.int32)), pa.array(none + line_last, pa.int32()), pa.array(p), pa.array(none + [None if x is None else next(banded) for x in sets], pa.list_(pa.int64())), pa.array(none + [None if x is None else x.tobytes() for x in sets], pa.binary())],
                    names=["doc_id", "v", "pos", "last", "p", "bands", "sh"],
                )

    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", _variant().alias("v"), "text").mapInArrow(run, f"doc_id {kind}, v int, pos int, last int, p bigint, bands array<bigint>, sh binary")


def _variant() -> Column:
    """15 bits of a hash of the text: tells apart the texts of an id that occurs with several."""
    return F.pmod(F.xxhash64("text"), F.lit(1 << 15)).cast("int")


def _shared(each: DataFrame, key: str) -> DataFrame:
    """The rows of each whose key occurs in several documents, with the first of these.

    Both sides shuffle by the key at every size; adaptive execution splits the
    keys that very many rows share.
    """
    first = each.groupBy(key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("most")).where("first < most").select(key, "first")
    return each.join(stash(first, "first"), key)


def _later(each: DataFrame, key: str) -> DataFrame:
    """The rows of each whose key occurs in a document with a smaller id."""
    return _shared(each, key).where("doc_id > first")


def ends(shared: DataFrame) -> DataFrame:
    """(p, after, before): windows of shared(p, doc_id, at, later) near whose end, or start, what occurs again ends.

    Which of them another document has in common is open near the end of a run,
    so all that start less than ``WINNOW`` words from the outermost count.
    """
    order = Window.partitionBy("doc_id", "v").orderBy("pos")
    own = shared.where("later").select("p", "doc_id", F.shiftright("at", 32).cast("int").alias("v"), (F.col("at") % (1 << 32)).cast("int").alias("pos"))
    own = own.withColumn("last", F.coalesce(F.lead("pos").over(order) > F.col("pos") + WINDOW, F.lit(True)))
    own = own.withColumn("head", F.coalesce(F.col("pos") > F.lag("pos").over(order) + WINDOW, F.lit(True)))
    own = own.select("p", F.max("last").over(order.rangeBetween(0, WINNOW - 1)).alias("after"), F.max("head").over(order.rangeBetween(1 - WINNOW, 0)).alias("before"))
    return own.where("after or before").groupBy("p").agg(F.max("after").alias("after"), F.max("before").alias("before"))


def bordering(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(p, doc_id, at): every window that starts less than ``WINNOW`` words after, or before, one of ends(shared), in all documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    where = shared.join(maybe_broadcast(stash(ends(shared), "ends")), "p")
    code = (F.col("at") % (1 << 32)) * 4 + F.col("after").cast("int") * 2 + F.col("before").cast("int")
    where = where.groupBy(F.col("doc_id").alias("d"), F.shiftright("at", 32).cast("int").alias("w")).agg(F.collect_set(code).alias("codes"))
    near = np.arange(1, WINNOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                starts, hashes, at, begun = [], [], [], 0
                for text, codes in zip(part.column("text").to_pylist(), part.column("codes").to_pylist(), strict=True):
                    h = word_hashes(text.lower().split(), known)
                    x = np.array(codes, np.int64)
                    s = np.unique(np.concatenate([np.add.outer(x[x & 2 > 0] >> 2, near).ravel(), np.subtract.outer(x[x & 1 > 0] >> 2, near).ravel()]))
                    at.append(s[(s >= 0) & (s <= len(h) - WINDOW)])
                    starts.append(at[-1] + begun), hashes.append(h)
                    begun += len(h)
                take = pa.array(np.repeat(np.arange(len(at)), [len(s) for s in at]))
                p = rolled(np.concatenate(hashes), WINDOW, np.concatenate(starts))
                yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), part.column("doc_id").take(take), part.column("v").take(take), pa.array(np.concatenate(at))], names=["p", "doc_id", "v", "pos"])

    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", _variant().alias("v"), "text")
    found = texts.join(maybe_broadcast(stash(where, "where")), (F.col("doc_id") == F.col("d")) & (F.col("v") == F.col("w"))).select("doc_id", "v", "text", "codes")
    return found.mapInArrow(run, f"p bigint, doc_id {kind}, v int, pos bigint").select("p", "doc_id", (F.col("v").cast("long") * (1 << 32) + F.col("pos")).alias("at"))


def met(banded: DataFrame) -> DataFrame:
    """(band, p, head, prev): every paragraph that is not the first of its band, with the first and its predecessor.

    Rows are dealt by ranges of (band, p), so a band of any size spreads over tasks. Where a band
    goes on in the next task, each task has a first paragraph of its own; these then meet the least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = head = last = None
        names = ["band", "p", "head", "prev"]
        for batch in batches:
            if not batch.num_rows:
                continue
            bs, ps = batch.column("band").to_numpy(), batch.column("p").to_numpy()
            same = np.concatenate([[band is not None and band == bs[0]], bs[1:] == bs[:-1]])
            prev = np.concatenate([[last if last is not None else 0], ps[:-1]])
            at = np.maximum.accumulate(np.where(same, -1, np.arange(len(bs))))
            heads = np.where(at >= 0, ps[at], head if head is not None else 0)
            use = same & (prev != ps)
            if band is None:
                use[0], prev[0] = True, ps[0]  # the task's first band may have begun before
            band, head, last = bs[-1], heads[-1], ps[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (bs, ps, heads, prev)], names=names)
        if band is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (band, head, head, head)], names=names)

    rows = banded.where("bands is not null").select(F.explode("bands").alias("band"), "p")
    each = stash(rows.repartitionByRange("band", "p").sortWithinPartitions("band", "p").mapInArrow(run, "band bigint, p bigint, head bigint, prev bigint"), "streamed")
    firsts = each.select("band", "head").distinct()
    least = firsts.groupBy("band").agg(F.min("head").alias("least"), F.max("head").alias("most")).where("least < most")
    cut = firsts.join(least, "band").where("head <> least").select("band", F.col("head").alias("p"), F.col("least").alias("head"), F.col("least").alias("prev"))
    return each.where("p <> head").unionByName(cut)


def shingle_sets(groups: DataFrame, banded: DataFrame) -> DataFrame:
    """(p, sh) of the paragraphs that met others."""
    wanted = stash(groups.select(F.explode(F.array("p", "head")).alias("p")).distinct(), "wanted")
    wanted = F.broadcast(wanted) if small(wanted, 1_000_000) else wanted
    return banded.where("sh is not null").select("p", "sh").join(wanted, "p", "left_semi").dropDuplicates(["p"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of at least the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            out = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield out

    both = pairs.join(sets.withColumnsRenamed({"p": "a", "sh": "x"}), "a").join(sets.withColumnsRenamed({"p": "b", "sh": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


class Cell:
    """Paragraphs of one band, their shingles inverted."""

    def __init__(self, p: list[int], c: list[int], sh: list[bytes]) -> None:
        sets = [np.frombuffer(x, np.uint32) for x in sh]
        self.p, self.c, self.size = np.array(p, np.int64), np.array(c, np.int64), np.array([len(x) for x in sets])
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        self.flat, self.row = flat[order], row[order]

    def links(self, c: int, sh: bytes, threshold: float) -> np.ndarray:
        """The paragraphs of other classes that are similar enough, one of each class."""
        x = np.frombuffer(sh, np.uint32)
        lo, hi = np.searchsorted(self.flat, x, "left"), np.searchsorted(self.flat, x, "right")
        n = hi - lo
        rows = self.row[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        both = np.bincount(rows, minlength=len(self.p))
        hit = np.flatnonzero((both >= threshold * (len(x) + self.size - both) - 1e-9) & (self.c != c))
        return self.p[hit[np.unique(self.c[hit], return_index=True)[1]]]


def rest(groups: DataFrame, comp: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """Links (a, b) between classes of comp(p, c) that meet in a band."""
    members = groups.select("band", "p").union(groups.select("band", "head")).distinct().join(comp, "p", "left")
    members = stash(members.select("band", "p", F.coalesce("c", "p").alias("c")), "members")
    each = members.groupBy("band", "c").agg(F.count("*").alias("n"))
    mixed = each.groupBy("band").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    mixed = stash(mixed.select("band", "main", F.ceil(F.col("n") / cell).cast("int").alias("g"), F.ceil(F.col("others") / cell).cast("int").alias("blocks")), "mixed")
    tagged = members.join(mixed, "band")
    names = ["band", "cell", "block", "query", "p", "c", "sh"]
    block = F.pmod(F.xxhash64(F.lit("block"), "p"), F.col("blocks")).cast("int")
    own = tagged.select("band", F.pmod(F.xxhash64("p"), F.col("g")).cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("query"), "p", "c")
    others = tagged.where("c <> main").select("band", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("cell"), block.alias("block"), F.lit(True).alias("query"), "p", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for batch in batches:
            a, b = [], []
            for *at, query, p, c, sh in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if key != at:
                    key, held, index = at, [], None
                if not query:
                    held.append((p, c, sh))
                    continue
                if index is None and held:
                    index, held = Cell(*zip(*held, strict=True)), []
                if index is not None:
                    near = index.links(c, sh, threshold).tolist()
                    a += [p] * len(near)
                    b += near
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    feed = own.union(others).join(sets, "p").select(*names)
    return feed.repartition("band", "cell", "block").sortWithinPartitions("band", "cell", "block", "query").mapInArrow(run, "a bigint, b bigint")


def classes(banded: DataFrame, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """(p, c): the class of every banded paragraph that links with a different one."""
    streamed = met(banded)
    groups = stash(streamed, "met")
    free(streamed)
    sets = stash(shingle_sets(groups, banded), "sets")
    pairs = groups.select("p", F.explode(F.array("head", "prev")).alias("q")).where("p <> q")
    pairs = pairs.select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct()
    near = stash(verified(pairs, sets, threshold), "near")
    comp = stash(components(near).withColumnsRenamed({"node": "p", "component": "c"}), "classes")
    more = stash(rest(groups, comp, sets, threshold, cell), "more")
    free(groups, sets, near)
    if more.isEmpty():
        return comp
    # a component's own links are kept by its members' links to its least
    links = comp.select(F.col("p").alias("a"), F.col("c").alias("b")).union(more)
    return stash(components(links).withColumnsRenamed({"node": "p", "component": "c"}), "classes")


def repeats(docs: DataFrame, threshold: float = THRESHOLD, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, v, gone, removed_words): the runs of words that go from each document that loses
    any, as the first word of each and the word after its last, in order."""
    every = stash(passages(docs, threshold), "passages")
    comp = classes(every, threshold)
    # v and pos travel as one number
    place = (F.col("v").cast("long") * (1 << 32) + F.col("pos")).alias("at")
    shared = _shared(every.where("last is null").select("p", "doc_id", place), "p")
    shared = stash(shared.select("p", "doc_id", "at", (F.col("doc_id") > F.col("first")).alias("later")), "shared")
    pos = (F.col("at") % (1 << 32)).cast("int")
    lines = every.where("last is not null").select("p", "doc_id", place, (F.col("last") - F.col("pos") + 1).alias("n")).join(comp, "p", "left")
    lines = _later(lines.select(F.coalesce("c", "p").alias("c"), "doc_id", "at", "n"), "c")
    lines = stash(lines.select("doc_id", F.shiftright("at", 32).cast("int").alias("v"), pos.alias("s"), (pos + F.col("n")).alias("e")), "lines")
    # the largest table goes before the next are made
    free(every)
    near = stash(bordering(docs, shared), "bordering")
    more = _later(near, "p")
    single = shared.where("later").select("doc_id", "at").union(more.select("doc_id", "at"))
    single = single.select("doc_id", F.shiftright("at", 32).cast("int").alias("v"), pos.alias("s"), (pos + WINDOW).alias("e"))
    again = single.unionByName(lines).groupBy("doc_id", "v", "s").agg(F.max("e").alias("e"))
    # a run ends where no earlier part of it reaches the next
    order = Window.partitionBy("doc_id", "v").orderBy("s")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = again.withColumn("new", F.coalesce((F.col("s") > before).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order))
    runs = runs.groupBy("doc_id", "v", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).where(F.col("e") - F.col("s") >= run_words)
    gone = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("s", "e"))), lambda r: F.array(r.s, r.e)))
    return runs.groupBy("doc_id", "v").agg(gone.alias("gone"), F.sum(F.col("e") - F.col("s")).cast("long").alias("removed_words"))


def without(text: str | None, gone: list[int] | None) -> str | None:
    """A text without the runs of words given by the first word of each and the word after its last.

    What follows a run moves up to it; a line end at the run's end stays one.
    """
    if text is None or not gone:
        return text
    span = [m.span() for m in _WORD.finditer(text)]
    out, done, left = "", 0, len(span)
    for s, e in zip(gone[::2], gone[1::2], strict=True):
        out += text[done : span[s][0]]
        done = span[e][0] if e < len(span) else len(text)
        if "\n" in text[span[e - 1][1] : done] and out.strip() and not out.rstrip(" \t\r").endswith("\n"):
            out = out.rstrip(" \t\r") + "\n"
        left -= e - s
    return out + text[done:] if left else ""


@tidy
def dedup_substrings(docs: DataFrame, threshold: float = THRESHOLD, run_words: int = RUN_WORDS) -> DataFrame:
    """docs with repeated passages removed from text, and two columns more: _removed
    (runs of words, each by its first word and the word after its last) and _removed_words."""
    gone = stash(repeats(docs, threshold, run_words).withColumnsRenamed({"doc_id": "__tw_d", "v": "__tw_v", "gone": "__tw_gone", "removed_words": "__tw_words"}), "gone")
    out = docs.join(maybe_broadcast(gone), (F.col("doc_id") == F.col("__tw_d")) & (_variant() == F.col("__tw_v")), "left").drop("__tw_d", "__tw_v")
    names = [f"c{k}" for k in range(len(out.columns))]
    text, which = names[docs.columns.index("text")], names[out.columns.index("__tw_gone")]
    plain = out.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                at = part.schema.get_field_index(text)
                made = [without(t, g) for t, g in zip(part.column(text).to_pylist(), part.column(which).to_pylist(), strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(made, part.schema.field(at).type))

    done = plain.mapInArrow(run, plain.schema).toDF(*out.columns)
    return done.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("__tw_gone", F.array().cast("array<int>")).alias("_removed"), F.coalesce("__tw_words", F.lit(0)).cast("long").alias("_removed_words"))
