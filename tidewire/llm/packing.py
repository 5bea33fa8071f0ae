"""Best-fit packing with certified partition bounds.

Texts become token counts once; packing then works on small integers. Pieces
are dealt at random over partitions of at most about ``per_partition`` pieces,
each packed by best-fit decreasing. Dual-feasible functions give each
partition a lower bound; one whose bin count equals it is certified: nothing
inside it can be improved. Partitions with gaps then exchange documents: the
bins that are not nearly full (of certified partitions only the emptiest) are
opened, their pieces dealt anew over fewer partitions and best-fit decreasing
reruns. An exchange that saves no bin is undone. Rounds end when the total
meets the bound of the whole (from the counts of each length, at most
``max_len`` numbers) or when exchange gains nothing.

Rows: a null text is empty and has only the separator. Repeated rows and
repeated ids are packed as often as they occur; pieces of equal length go in the
order of their numbers. An empty table gives an empty result. Extra columns are
ignored. A document longer than ``max_len`` is cut
into full pieces, its first piece taking the remainder.
"""

from __future__ import annotations

import array
import base64
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, tidy

MAX_LEN = 2048
SEPARATOR = 0
#: Pieces that one partition packs, about; bounds memory and time of a task.
PER_PARTITION = 16_384
#: Bins with fewer free tokens than this count as nearly full and stay closed.
LEAST_GAP = 16
ROUNDS = 6

_ENCODERS: dict[str, Callable[[str], list[int]]] = {}
_SPECIAL = "<|endoftext|>"


def encoder(name: str = "byte_bpe_50k") -> Callable[[str], list[int]]:
    """text -> ids of the tokenizer file ``name``.json, add_special_tokens=False.

    The same vocabulary's rank file gives the same ids several times faster;
    a text that spells a special token goes to the tokenizer itself.
    """
    if name not in _ENCODERS:
        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        with open(public.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        slow: list[Tokenizer] = []

        def encode(text: str) -> list[int]:
            if _SPECIAL not in text:
                return fast(text)
            if not slow:
                slow.append(Tokenizer.from_file(public.path(f"{name}.json")))
            return slow[0].encode(text, add_special_tokens=False).ids

        _ENCODERS[name] = encode
    return _ENCODERS[name]


def cut(n: int, max_len: int = MAX_LEN) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter."""
    first = n if n <= max_len else n % max_len or max_len
    return [(0, first)] + [(s, max_len) for s in range(first, n, max_len)]


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k", max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for k in range(b.num_rows):
                raw = memoryview(array.array("I", [*encode(b.column("text")[k].as_py() or ""), SEPARATOR]).tobytes())
                rows += [(k, p, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for p, (s, n) in enumerate(cut(len(raw) // 4, max_len))]
            at, *rest = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(v, t) for v, t in zip(rest, kinds, strict=True))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def lower_bound(counts: dict[int, int], size: int = MAX_LEN) -> int:
    """The largest of the bounds that a family of dual-feasible functions gives.

    f_0 is the sum of lengths; f_k, for each k up to half the size, counts
    items above size - k as whole bins, drops items below k and keeps the rest;
    u_k rounds (k + 1) x / size down where it is not whole.
    """
    if not counts:
        return 0
    n = np.zeros(size + 1, np.int64)
    for length, c in counts.items():
        n[length] += c
    x = np.arange(size + 1)
    total = np.concatenate([[0], np.cumsum(n * x)])  # below index
    number = np.concatenate([[0], np.cumsum(n)])
    best = math.ceil(int(total[-1]) / size)
    k = np.arange(1, size // 2 + 1)
    large = number[-1] - number[size - k + 1]
    best = max(best, int((large + -(-(total[size - k + 1] - total[k]) // size)).max()))
    for k in range(1, 24):
        scaled = (k + 1) * x
        u = np.where(scaled % size == 0, x * k, (scaled // size) * size)  # times k * size
        best = max(best, math.ceil(int((n * u).sum()) / (k * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int = MAX_LEN) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item. Bins of equal free space are found by one
    bit operation on a mask of the free spaces present."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]
    mask = count = 0
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        above = mask >> need
        if above:
            gap = need + (above & -above).bit_length() - 1
            at = free[gap].pop()
            if not free[gap]:
                mask ^= 1 << gap
        else:
            gap, at = size, count
            count += 1
        bins[i], offsets[i] = at, size - gap
        left = gap - need
        if left:
            free[left].append(at)
            mask |= 1 << left
    return bins, offsets


_COLS = "piece int, start bigint, length bigint, ids_crc32 bigint, item bigint"
_OUT = "sequence_id bigint, offset bigint, gap bigint, n_bins bigint, bound bigint, emptiest bigint"


def _pack(items: DataFrame, rounds: int, size: int, per_partition: int) -> DataFrame:
    """Deal items at random and pack every part."""
    kind = items.schema["doc_id"].dataType.simpleString()
    parts = max(1, math.ceil(items.count() / per_partition))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(lengths, size)
        gaps = size - np.bincount(bins, lengths).astype(np.int64)
        out = pdf.drop(columns="part")
        out["sequence_id"] = (rounds << 56) + (int(pdf["part"].iloc[0]) << 24) + bins
        out["offset"], out["gap"], out["n_bins"] = offsets, gaps[bins], len(gaps)
        out["bound"] = lower_bound(Counter(lengths.tolist()), size)
        out["emptiest"] = gaps.max()
        return out

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", F.lit(rounds)), F.lit(parts)))
    return stash(dealt.groupBy("part").applyInPandas(pack, f"doc_id {kind}, {_COLS}, {_OUT}"), "packed")


def pack(items: DataFrame, size: int = MAX_LEN, per_partition: int = PER_PARTITION, max_rounds: int = ROUNDS) -> DataFrame:
    """items(doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    # the number of a row in the written files: fixed from here on
    items = stash(items.withColumn("item", F.monotonically_increasing_id()), "pieces")
    packed = _pack(items, 0, size, per_partition)
    bound = lower_bound({r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}, size)
    bins = _bins(packed)
    for r in range(1, max_rounds + 1):
        if bins <= bound:
            break
        certified = F.col("n_bins") == F.col("bound")
        opened = (F.col("gap") >= LEAST_GAP) & (~certified | (F.col("gap") == F.col("emptiest")) | (F.col("gap") >= size // 4))
        pool = packed.where(opened)
        again = _pack(pool.select(*items.columns), r, size, per_partition)
        before, after = _bins(pool), _bins(again)
        if after >= before:
            break
        bins -= before - after
        packed = stash(packed.where(~opened).unionByName(again), "state")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _bins(packed: DataFrame) -> int:
    return packed.where("offset = 0").count()


@tidy
def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k", max_len: int = MAX_LEN, per_partition: int = PER_PARTITION) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer, max_len), max_len, per_partition)
