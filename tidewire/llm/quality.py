"""Quality classifier: a factorisation machine over hashed words, structure
statistics and numeric metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)),
the sum-of-squares form of all pairwise interactions, linear in the number of
features of a document. It is fitted on at most ``bound`` labelled rows and
scores every whole text.

Rows: null and empty texts score like a text without words (their structure
buckets say so); null metadata has a bucket of its own; equal texts with equal
metadata score alike. With no usable labels, or labels of one class, every
score is 0.5 or the class's smoothed rate; ties at the threshold count as 1.
Very long texts are read whole, in batches of few rows. For the fit, of several
texts of one id the one with the least hash counts. Empty documents give an
empty result. Extra columns are ignored by the scores and kept by the filter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, tidy
from .textmap import Rows, labelled_sample, sigmoid, slot

#: Labelled rows that a fit takes at most.
SAMPLE = 8000
BITS = 16
RANK = 8
BUCKETS = 16

_KINDS = np.zeros(256, np.int64)  # of a byte: lower, upper, digit, space, newline, mark, other letter
_KINDS[ord("A") : ord("Z") + 1] = 1
_KINDS[ord("0") : ord("9") + 1] = 2
_KINDS[[9, 11, 12, 13, 32]] = 3
_KINDS[10] = 4
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _KINDS[_c] = 5
_KINDS[128:] = 6


def structure(text: str) -> list[float]:
    """Statistics between 0 and 1 of a whole text: length, shares of kinds of bytes, words and lines."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(_KINDS[raw], minlength=7) / max(1, len(raw))
    tokens, lines = text.split(), text.split("\n")
    n = max(1, len(tokens))
    marks = np.bincount(raw[_KINDS[raw] == 5], minlength=256) if len(raw) else np.zeros(256)
    bare = sum(t.isalpha() for t in tokens)
    return [
        min(1.0, np.log1p(len(raw)) / 16),
        min(1.0, np.log1p(len(tokens)) / 14),
        *(min(1.0, 2 * x) for x in kinds),
        min(1.0, len(raw) / n / 16),
        len(set(tokens)) / n,
        len(set(lines)) / max(1, len(lines)),
        min(1.0, len(lines) / n * 2),
        bare / n,
        min(1.0, float(marks.max()) / n),
        min(1.0, float(marks[list(b".,")].sum()) / n * 2),
        min(1.0, float((marks > 0).sum()) / 24),
        max(map(len, tokens), default=0) / 64 if tokens and max(map(len, tokens)) < 64 else float(bool(tokens)),
    ]


def features(text: str | None, meta: tuple = (), cache: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, values): hashed distinct words at 1 / sqrt(their number), and one bucket for each statistic."""
    text = text or ""
    seen = {w.lower() for w in text.split()}
    ids = np.fromiter((slot(w, BITS) for w in seen), np.int64, len(seen))
    ids = np.unique(ids)
    stats = [*structure(text), *(0.0 if m is None or m != m else 1 / 16 + min(0.93, np.log1p(max(0.0, float(m))) / 20) for m in meta)]
    own = [(1 << BITS) + k * BUCKETS + min(BUCKETS - 1, int(s * BUCKETS)) for k, s in enumerate(stats)]
    return np.concatenate([ids, np.array(own, np.int64)]), np.concatenate([np.full(len(ids), 1 / np.sqrt(max(1, len(ids)))), np.full(len(own), 0.5)])


class FactorisationMachine:
    """Logistic factorisation machine, fitted by Adagrad on small batches."""

    def __init__(self, size: int, rank: int = RANK, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.02, (size, rank)).astype(np.float32)

    def raw(self, x: Rows) -> np.ndarray:
        vx = self.v[x.ids] * x.vals[:, None]
        return self.w0 + x.sum(self.w[x.ids] * x.vals) + 0.5 * (x.sum(vx) ** 2 - x.sum(vx**2)).sum(1)

    def fit(self, x: Rows, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.1, decay: float = 1e-4) -> FactorisationMachine:
        """Rows weigh so that both classes count alike in the gradient, with the prior put back into w0."""
        share = (y.sum() + 1) / (len(y) + 2)
        self.w0 = float(np.log(share / (1 - share)))
        if not 0 < y.sum() < len(y):
            self.v[:] = 0
            return self
        gw, gv, g0 = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        rng = np.random.default_rng(11)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), batch):
                rows = order[k : k + batch]
                b = x.take(rows)
                vx = self.v[b.ids] * b.vals[:, None]
                total = b.sum(vx)
                p = sigmoid(self.w0 + b.sum(self.w[b.ids] * b.vals) + 0.5 * (total**2 - b.sum(vx**2)).sum(1))
                err = ((p - y[rows]) / len(rows))[b.row].astype(np.float32)
                at, back = np.unique(b.ids, return_inverse=True)
                dw = np.bincount(back, err * b.vals, len(at)) + decay * self.w[at]
                dv = (err * b.vals)[:, None] * (total[b.row] - vx)
                dv = np.stack([np.bincount(back, dv[:, f], len(at)) for f in range(dv.shape[1])], 1) + decay * self.v[at]
                gw[at] += dw**2
                gv[at] += dv**2
                self.w[at] -= rate * dw / np.sqrt(gw[at])
                self.v[at] -= rate * dv / np.sqrt(gv[at])
                d0 = float((p - y[rows]).mean())
                g0 += d0**2
                self.w0 -= rate * d0 / np.sqrt(g0)
        return self


def _with_meta(docs: DataFrame, meta: list[str]) -> DataFrame:
    return docs.select(*[c for c in ("doc_id", "y") if c in docs.columns], "text", *[F.col(c).cast("double").alias(f"_m{k}") for k, c in enumerate(meta)])


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", meta: list[str] | None = None, bound: int = SAMPLE, prior: float | None = None) -> FactorisationMachine:
    """Fit on a bounded sample; features are made on the executors, the fit runs on the driver.

    The sample has the classes half and half; ``prior`` (the share of class 1
    among all usable labels, counted) is put back into the constant.
    """
    meta = [c for c in (meta or []) if c in docs.columns]
    y_ids = _score_columns(_with_meta(labelled_sample(docs, labels, target, bound), meta), len(meta))
    got = y_ids.select("y", "ids", "vals", "doc_id").toArrow().sort_by("doc_id")
    x = Rows([np.asarray(v, np.int64) for v in got["ids"].to_pylist()], [np.asarray(v, np.float32) for v in got["vals"].to_pylist()])
    y = np.asarray(got["y"].to_pylist(), np.float64)
    model = FactorisationMachine((1 << BITS) + 64 * BUCKETS).fit(x, y)
    if prior is not None and 0 < prior < 1 and 0 < y.sum() < len(y):
        model.w0 += float(np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean())))
    return model


def _score_columns(df: DataFrame, n_meta: int) -> DataFrame:
    """(doc_id, y, ids, vals) of a sample."""
    made = df.select("doc_id", "y", F.array(*[f"_m{k}" for k in range(n_meta)]).alias("meta") if n_meta else F.array().cast("array<double>").alias("meta"), "text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            f = [features(t, tuple(m or ())) for t, m in zip(b.column("text").to_pylist(), b.column("meta").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([x[0].astype(np.int32) for x in f], pa.list_(pa.int32())), pa.array([x[1].astype(np.float32) for x in f], pa.list_(pa.float32()))], names=["doc_id", "y", "ids", "vals"])

    return made.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, y int, ids array<int>, vals array<float>")


def share_of_ones(labels: DataFrame, target: str, mod: int = 5, rest: int = 0) -> float | None:
    """The share of class 1 among all usable labels that are not held out."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out(F.col("doc_id"), mod, rest)).agg(F.avg(F.col(target).cast("double"))).first()[0]


def score(docs: DataFrame, model: FactorisationMachine, meta: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, score."""
    meta = [c for c in (meta or []) if c in docs.columns]
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = _with_meta(docs.select("doc_id", "text", *meta), meta)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                metas = zip(*(part.column(f"_m{j}").to_pylist() for j in range(len(meta))), strict=True) if meta else [()] * part.num_rows
                f = [features(t, m) for t, m in zip(part.column("text").to_pylist(), metas, strict=True)]
                p = sigmoid(model.raw(Rows([x[0] for x in f], [x[1] for x in f])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return made.mapInArrow(run, f"doc_id {kind}, score double")


@tidy
def classify(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = 0.3, meta: list[str] | None = None, bound: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= threshold)."""
    model = fit(docs, labels, target, meta, bound, share_of_ones(labels, target))
    out = score(docs, model, meta)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@tidy
def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = SAMPLE) -> DataFrame:
    """docs without the rows that the classifier rejects; scored in place, without a join."""
    meta = [c for c in ("n_chars",) if c in docs.columns]
    model = fit(docs, labels, "quality", meta, bound, share_of_ones(labels, "quality"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text, at = names[docs.columns.index("text")], [names[docs.columns.index(c)] for c in meta]
    schema = plain.schema

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                metas = zip(*(part.column(c).to_pylist() for c in at), strict=True) if at else [()] * part.num_rows
                f = [features(t, m) for t, m in zip(part.column(text).to_pylist(), metas, strict=True)]
                keep = sigmoid(model.raw(Rows([x[0] for x in f], [x[1] for x in f]))) >= threshold
                yield part.filter(pa.array(keep))

    return plain.mapInArrow(run, schema).toDF(*docs.columns)
