"""Language identification by string kernels.

Kernel: the blended-spectrum presence kernel, the number of distinct character
n-grams (n = 1 to 3, hashed) that two texts share, over the geometric mean of
their own numbers. Nyström features on ``landmarks`` texts feed one-versus-rest
kernel ridge regression. Landmarks, whitening and ridge weights fold into one
matrix, so a batch of texts is scored by one product of its presence matrix.

Learns from rows with text and language whose id is not held out: every
language, each from at most ``PER_LANG`` rows, of all languages together about
``SAMPLE`` rows, or ``LEAST_ROWS`` a language where these are more. There are
``LANDMARKS`` landmarks, or one a language where these are more.

Rows: a null or empty text, or one without a letter, is ``und`` with score 0,
as is every text when nothing could be learned. Texts are read whole, very long
ones in blocks. Equal and repeated texts get equal results; equally high
outputs give the first language in order. Empty documents give an empty result.
Extra columns are ignored.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, tidy
from .textmap import map_texts

BITS = 15
PER_LANG, SAMPLE, LEAST_ROWS = 400, 6400, 8
LANDMARKS = 160
#: Characters hashed at once, so that a very long text needs no large arrays.
BLOCK = 1 << 20


def presence(text: str, out: np.ndarray) -> None:
    """Set out[h] = 1 for every hashed n-gram (n = 1..3) of the whole lower-cased text."""
    for k in range(0, len(text), BLOCK):
        c = np.frombuffer(text[k : k + BLOCK + 2].lower().encode("utf-32-le", "replace"), np.uint32)
        h1 = (c + np.uint32(1)) * np.uint32(2654435761)
        out[h1 >> np.uint32(32 - BITS)] = 1
        if len(c) > 1:
            h2 = (h1[:-1] ^ (h1[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
            out[h2 >> np.uint32(32 - BITS)] = 1
        if len(c) > 2:
            h3 = (h2[:-1] ^ (h1[2:] * np.uint32(668265263))) * np.uint32(374761393)
            out[h3 >> np.uint32(32 - BITS)] = 1


def matrix(texts: list) -> np.ndarray:
    """Presence rows divided by their length, so that products are kernel values."""
    x = np.zeros((len(texts), 1 << BITS), np.float32)
    for row, t in zip(x, texts, strict=True):
        if t:
            presence(t, row)
    return _normal(x)


def _normal(x: np.ndarray) -> np.ndarray:
    x /= np.sqrt(np.maximum(1, x.sum(1)))[:, None]
    return x


def _unpacked(bits: np.ndarray) -> np.ndarray:
    """Normalised presence rows of packed ones."""
    return _normal(np.unpackbits(bits, axis=1).astype(np.float32))


def fit_packed(bits: np.ndarray, lang: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-2) -> tuple[list[str], np.ndarray]:
    """(languages, weights) of packed presence rows: scores of normalised presence rows are rows @ weights."""
    langs = sorted(set(lang))
    y = np.array([[1.0 if v == c else -1.0 for c in langs] for v in lang])
    rank = {}
    order = []  # landmarks are dealt over the languages in turn
    for k, v in enumerate(lang):
        rank[v] = rank.get(v, 0) + 1
        order.append((rank[v], v, k))
    mark = _unpacked(bits[[k for *_, k in sorted(order)[: max(landmarks, len(langs))]]])
    kmm = (mark @ mark.T).astype(np.float64)
    value, vec = np.linalg.eigh(kmm)
    good = value > 1e-6 * value.max()
    white = vec[:, good] / np.sqrt(value[good])
    z = np.vstack([(_unpacked(bits[k : k + 256]) @ mark.T).astype(np.float64) @ white for k in range(0, len(bits), 256)])
    z1 = np.hstack([z, np.ones((len(z), 1))])
    # each language's rows weigh alike
    share = np.array([1 / rank[v] for v in lang]) / len(langs)
    reg = ridge * np.eye(z1.shape[1]) * share.sum() / max(1, z1.shape[1])
    beta = np.linalg.solve((z1 * share[:, None]).T @ z1 + reg, (z1 * share[:, None]).T @ y)
    return langs, np.vstack([mark.T @ (white @ beta[:-1]), beta[-1:]]).astype(np.float32)


def fit(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> tuple[list[str], np.ndarray] | None:
    """Fit on a bounded sample: hashes of ids choose the rows, counted per language over all rows.

    A language with very few rows is taken whole; one whose draws fall short has at least its nearest.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return None
    per_lang = min(per_lang, max(LEAST_ROWS, SAMPLE // len(counts)))
    draw = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    rate = F.create_map(*[v for r in counts for v in (F.lit(r["lang"]), F.lit(min(1.0, 1.5 * per_lang / r["count"])))])
    picked = usable.select("doc_id", "lang", "text", draw.alias("draw")).where(F.col("draw") < rate[F.col("lang")])
    bits = map_texts(picked.select("doc_id", "lang", "draw", "text"), lambda texts: {"bits": [np.packbits(r > 0).tobytes() for r in matrix(texts)]}, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, draw double, bits binary", 64)
    rows = bits.orderBy("draw", "doc_id", "bits").limit(2 * per_lang * len(counts)).collect()
    taken: dict[str, int] = {}
    keep = []
    for r in rows:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per_lang:
            keep.append(r)
    return fit_packed(np.array([np.frombuffer(r["bits"], np.uint8) for r in keep]), [r["lang"] for r in keep], landmarks)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray] | None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (softmax of the ridge outputs)."""

    def run(texts: list) -> dict[str, list]:
        known = [any(map(str.isalpha, t or "")) for t in texts]
        if model is None:
            return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}
        langs, w = model
        s = 4.0 * (matrix(texts) @ w[:-1] + w[-1]).astype(np.float64)
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return {"lang_pred": [langs[b] if k else "und" for b, k in zip(best, known, strict=True)], "score": [float(r[b]) if k else 0.0 for r, b, k in zip(p, best, known, strict=True)]}

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


@tidy
def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    out = predict(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
