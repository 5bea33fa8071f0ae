"""Toxicity: a counterfactual-regularised linear classifier.

A logistic model on the distinct words, and beginnings of words, of a whole text. For every labelled
text that names a group, its identity terms are swapped for other terms of the
same kind, and once for none, and the squared change of the raw score is penalised, so that a
neutral mention cannot carry weight whatever the labels correlate with. It is
fitted on at most ``bound`` labelled rows and scores every whole text.

Rows: null and empty texts get the score of a text without words; equal texts
score alike, ties at the threshold count as 1. Very long texts are read whole,
in batches of few rows. Without usable labels every score is 0.5, with one
class the smoothed rate. Repeated documents are scored each; for the fit, of
several texts of one id the one with the least hash counts. Empty documents
give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, tidy
from .quality import share_of_ones
from .textmap import Rows, labelled_sample, map_texts, sigmoid, slot, words

#: Labelled rows that a fit takes at most.
SAMPLE = 8000
BITS = 18
#: A word needs this many labelled texts, and shares in the two classes that differ
#: by so many standard errors, to have a weight of its own.
LEAST_TEXTS, LEAST_Z = 4, 4.0
#: Lengths of the word beginnings that are features too.
STEMS = (4, 5, 6, 7)

#: Identity terms by kind; a term is swapped for others of its kind.
IDENTITY = {
    "gender": "woman women man men girl girls boy boys female male femme femmes homme hommes frau frauen mann männer mujer mujeres hombre hombres transgender nonbinary",
    "religion": "muslim muslims christian christians jew jews jewish hindu hindus buddhist buddhists catholic catholics atheist atheists musulman musulmans chrétien juif juifs christen juden muslime musulmanes cristianos judíos",
    "origin": "black white asian african european american mexican arab latino immigrant immigrants refugee refugees foreigner foreigners schwarze weiße ausländer flüchtlinge noirs blancs étrangers réfugiés negros blancos extranjeros refugiados",
    "orientation": "gay lesbian bisexual straight homosexual heterosexual queer schwul lesbisch lesbienne homosexuel lesbiana",
    "ability": "disabled blind deaf autistic elderly young old behindert taub handicapé sourd aveugle discapacitado sordo ciego",
}
_PLACE = {t: (terms.split(), k) for terms in IDENTITY.values() for k, t in enumerate(terms.split())}
#: Counterfactuals of one text.
SWAPS = 3


def features(text: str | None) -> np.ndarray:
    """Ids of the distinct words of a whole text and of their beginnings, which inflected forms share."""
    return _ids(set(words(text)))


def _ids(seen: set[str]) -> np.ndarray:
    every = seen | {f"{w[:n]}-" for n in STEMS for w in seen if len(w) > n}
    return np.unique(np.fromiter((slot(w, BITS) for w in every), np.int64, len(every)))


def partner(term: str, turn: int) -> str:
    """Another term of the same kind; all of them over the turns."""
    group, at = _PLACE[term]
    return group[(at + 1 + turn % (len(group) - 1)) % len(group)]


def swaps(text: str | None) -> list[tuple[list[int], list[int]]]:
    """For each counterfactual, the features that go and those that come when every identity term is
    swapped. Partners depend on the text, so that over many texts every term meets every other. The
    last counterfactual has the terms left out, so that no mention counts, not just all mentions alike."""
    seen = set(words(text))
    if not _PLACE.keys() & seen:
        return []
    own, turn = _ids(seen), slot(text or "", 16)
    others = [_ids({partner(w, turn + 7 * k) if w in _PLACE else w for w in seen}) for k in range(SWAPS - 1)] + [_ids(seen - _PLACE.keys())]
    return [(np.setdiff1d(own, o).tolist(), np.setdiff1d(o, own).tolist()) for o in others]


def fit_weights(x: list[np.ndarray], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], penalty: float = 20.0, decay: float = 3e-4, rounds: int = 300, prior: float | None = None) -> tuple[float, np.ndarray]:
    """(bias, weights) of logistic loss + decay |w|^2 + penalty * mean squared score change of the swaps.

    Classes weigh alike; with ``prior``, the share of class 1, half of its log odds go back into the
    bias: all of them would miss rare toxic texts, none would raise false alarms.
    """
    w = np.zeros(1 << BITS)
    share = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        return float(np.log(share / (1 - share))), w
    rows = Rows(x, [np.ones(len(i)) for i in x])
    seen = np.bincount(rows.ids, minlength=1 << BITS)
    ones = np.bincount(rows.ids, y[rows.row], minlength=1 << BITS)
    n1, n0 = y.sum(), len(y) - y.sum()
    pooled = seen / len(y)
    z = np.abs(ones / n1 - (seen - ones) / n0) / np.sqrt(np.maximum(1e-12, pooled * (1 - pooled)) * (1 / n1 + 1 / n0))
    named = {i for a, b in pairs for i in (*a, *b)}
    used = np.flatnonzero((seen >= LEAST_TEXTS) & (z >= LEAST_Z) | np.isin(np.arange(1 << BITS), list(named)))
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    ok = place[rows.ids] >= 0
    col, row = place[rows.ids[ok]], rows.row[ok]
    entries = sorted({(k, i, s) for k, (a, b) in enumerate(pairs) for ids, s in ((a, -1.0), (b, 1.0)) for i in ids})
    drow, dcol, dval = (np.array([e[0] for e in entries], int), place[[e[1] for e in entries]] if entries else np.zeros(0, int), np.array([e[2] for e in entries], float))
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    v, b, square, bsq = np.zeros(len(used)), 0.0, np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        err = weight * (sigmoid(b + np.bincount(row, v[col], len(y))) - y)
        grad = np.bincount(col, err[row], len(used)) + decay * v
        if entries:
            change = np.bincount(drow, dval * v[dcol], len(pairs))
            grad += 2 * penalty / len(pairs) * np.bincount(dcol, dval * change[drow], len(used))
        square += grad**2
        bsq += err.sum() ** 2
        v -= 0.3 * grad / np.sqrt(square)
        b -= 0.3 * err.sum() / np.sqrt(bsq)
    w[used] = v
    if prior is not None and 0 < prior < 1:
        b += float(np.log(prior / (1 - prior)) / 2)
    return float(b), w


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", bound: int = SAMPLE, penalty: float = 20.0) -> tuple[float, np.ndarray]:
    """Fit on a bounded sample; features are made on the executors, the fit runs on the driver."""
    sample = labelled_sample(docs, labels, target, bound).select("doc_id", "y", "text")
    kind = sample.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            s = [swaps(t) for t in texts]
            cols = [pa.array([features(t).astype(np.int32) for t in texts], pa.list_(pa.int32()))]
            cols += [pa.array([[v[side] for v in x] for x in s], pa.list_(pa.list_(pa.int32()))) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *cols], names=["doc_id", "y", "ids", "were", "become"])

    got = sample.mapInArrow(run, f"doc_id {kind}, y int, ids array<int>, were array<array<int>>, become array<array<int>>").toArrow().sort_by("doc_id")
    pairs = [(a, b) for w, n in zip(got["were"].to_pylist(), got["become"].to_pylist(), strict=True) for a, b in zip(w, n, strict=True)]
    y = np.asarray(got["y"].to_pylist(), np.float64)
    return fit_weights([np.asarray(i, np.int64) for i in got["ids"].to_pylist()], y, pairs, penalty, prior=share_of_ones(labels, target))


def score(docs: DataFrame, model: tuple[float, np.ndarray]) -> DataFrame:
    """One row per document: doc_id, score."""
    bias, w = model
    at = np.flatnonzero(w)
    weights = dict(zip(at.tolist(), w[at].tolist(), strict=True))

    def run(texts: list) -> dict[str, list]:
        get = weights.get
        return {"score": sigmoid(np.array([bias + sum(get(i, 0.0) for i in features(t).tolist()) for t in texts]))}

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


@tidy
def classify(docs: DataFrame, labels: DataFrame, target: str = "toxic", threshold: float = 0.5, bound: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= threshold)."""
    out = score(docs, fit(docs, labels, target, bound))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
