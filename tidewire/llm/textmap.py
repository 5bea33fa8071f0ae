"""Streaming whole texts through Python workers, and bounded labelled samples."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stash

#: Texts taken at once out of an Arrow batch; only these are Python strings at a time.
STEP = 256
WORD = re.compile(r"[^\W\d_]+")


def map_texts(df: DataFrame, fn: Callable[[list], dict[str, list]], schema: str, step: int = STEP) -> DataFrame:
    """df(text, keep...) to rows of ``schema``: ``fn`` gets a list of texts and
    returns new columns; the other columns of df, which ``schema`` names first, pass as they are."""
    keep = [c for c in df.columns if c != "text"]
    new = [part.split()[0] for part in schema.split(",")][len(keep) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                made = fn(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(made[c]) if not isinstance(made[c], pa.Array) else made[c] for c in new], names=keep + new)

    return df.select(*keep, "text").mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, bound: int, mod: int = 5, rest: int = 0) -> DataFrame:
    """At most ``bound`` rows (doc_id, y, text), half of each class where both have enough.

    Learns from labels whose id is not held out; which rows are taken depends
    on a hash of the id alone. The sample of ids is bounded by the parameter
    and therefore broadcast. Repeated label rows count once (the larger label);
    of several texts of one id, the one with the least hash is taken, so that
    a model does not depend on the order of rows.
    """
    known = (
        labels.select("doc_id", F.col(target).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), mod, rest))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    order = [F.xxhash64(F.lit("sample"), "doc_id"), F.col("doc_id")]
    some = stash(known.where("y = 0").orderBy(*order).limit(bound // 2).unionAll(known.where("y = 1").orderBy(*order).limit(bound // 2)), "sample")
    more = [c for c in ("n_chars",) if c in docs.columns]
    rows = docs.select("doc_id", "text", *more).join(F.broadcast(some), "doc_id")
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", *more)).alias("r"))
    return one.select("doc_id", "y", "r.text", *[f"r.{c}" for c in more])


class Rows:
    """Sparse rows: feature ids and values of all rows end to end, and where each row starts."""

    def __init__(self, ids: list[np.ndarray], vals: list[np.ndarray]) -> None:
        self.size = np.array([len(x) for x in ids], np.int64)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        self.vals = np.concatenate(vals).astype(np.float32) if vals else np.zeros(0, np.float32)
        self.row = np.repeat(np.arange(len(ids)), self.size)
        self.ptr = np.concatenate([[0], np.cumsum(self.size)])

    def __len__(self) -> int:
        return len(self.size)

    def take(self, rows: np.ndarray) -> Rows:
        at = [slice(self.ptr[r], self.ptr[r + 1]) for r in rows]
        return Rows([self.ids[s] for s in at], [self.vals[s] for s in at])

    def sum(self, x: np.ndarray) -> np.ndarray:
        """Sums of x (one value or vector for each entry) by row."""
        if x.ndim == 1:
            return np.bincount(self.row, x, len(self))
        return np.stack([np.bincount(self.row, x[:, k], len(self)) for k in range(x.shape[1])], axis=1)


def words(text: str | None) -> Counter:
    """Counts of the lower-cased runs of letters in a whole text."""
    return Counter(WORD.findall((text or "").lower()))


def slot(word: str, bits: int, salt: int = 0) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"), salt) & ((1 << bits) - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
