"""Benchmark decontamination: a prefix-filtered set join, DataFrame functions only.

A benchmark item's windows are its runs of ``size`` words (the whole item if
it has fewer). A window can only occur where all its words do, so its rarest
word in the corpus, counted over all documents, is a sufficient prefix: only
document words that are some window's rarest are joined. The position of the
word in the window fixes where an occurrence would start; starts before the
text, or ends past it, are dropped, and what remains is verified word by word.

The table of prefix words is broadcast only if its counted size is within a
bound; beyond it both joins shuffle (by word, then by document), with the same
rows. Words joined there are counted per partition first.

Texts are read twice: once to count the benchmark's words, once for the join,
which also counts each text's words. A very long text is one row whose words
are exploded lazily, so its size bounds the memory of a task. Words equally
rare are ordered by themselves and their place, so ties give the same result
in every run.

Rows: a null or empty text has no words and no hits. Repeated rows give equal
results. Items without words are ignored, as are null item ids in n_items and
items_sha256; equal items count under each id. Empty documents give an empty
result, an empty benchmark no hits. Extra columns are ignored; a null doc_id is
kept as it is.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BROADCAST_ROWS, maybe_broadcast, small, stash, tidy

WINDOW = 13
#: Words that a window needs for its occurrence alone to remove a document.
LEAST_WORDS = 8
#: Files of a table that the benchmark alone makes, at most; it is small beside the documents.
FILES = 64
#: Everything that is no word character: ASCII besides digits and small letters.
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a whole text, A-Z lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, _BREAK), "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, key, win) of all distinct windows; key is a digest of the words."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = items.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - size))).alias("o"))
    win = cut.select("item_id", F.slice("w", F.col("o") + 1, F.lit(size)).alias("win"))
    return win.select("item_id", F.md5(F.concat_ws(" ", "win").cast("binary")).alias("key"), "win").distinct()


def word_counts(docs: DataFrame, vocabulary: DataFrame, broadcast: bool) -> DataFrame:
    """(w, n): how often each vocabulary word occurs in all documents."""
    each = docs.select(F.explode(words(F.col("text"))).alias("w"))
    if broadcast:
        return each.join(F.broadcast(vocabulary), "w").groupBy("w").agg(F.count("*").alias("n"))
    return each.groupBy("w").agg(F.count("*").alias("n")).join(vocabulary, "w")


def occurrences(docs: DataFrame, benchmark_windows: DataFrame, bound: int = BROADCAST_ROWS, nbytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, h, n_words, start, n, key): where windows occur, and one row with a null key for
    each row of docs; h is a hash of the text.

    The row without a key comes from a mark before the first word, which only the prefix table's
    own mark matches, so one reading of the texts gives hits and numbers of words.
    """
    distinct = benchmark_windows.select("key", "win").dropDuplicates(["key"])
    vocabulary = stash(distinct.select(F.explode("win").alias("w")).distinct().coalesce(FILES), "vocabulary")
    counts = stash(word_counts(docs, vocabulary, small(vocabulary, bound, nbytes)).coalesce(FILES), "counts")
    # rarest word first; ties by word and position
    placed = distinct.select("key", F.posexplode("win").alias("pos", "w")).join(counts, "w")
    first = placed.groupBy("key").agg(F.min(F.struct("n", "w", "pos")).alias("m")).select("key", F.col("m.w").alias("w"), F.col("m.pos").alias("pos"))
    prefix = stash(distinct.join(first, "key").select("w", "pos", "key", "win").coalesce(FILES), "prefix")

    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("words"))
    own = ["doc_id", "h", F.size("words").cast("long").alias("n_words")]
    start = (F.col("p") - F.col("pos") - 1).alias("start")
    fits = (F.col("start") >= 0) & (F.col("start") + F.size("win") <= F.size("words"))
    same = F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.size("win")) == F.col("win")
    if small(prefix, bound, nbytes):
        mark = F.lit("")
        marks = docs.sparkSession.range(1).select(mark.alias("w"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key"), F.array().cast("array<string>").alias("win"))
        table = F.broadcast(prefix.unionByName(marks))
        at = texts.select("doc_id", "h", "words", F.posexplode(F.concat(F.array(mark), "words")).alias("p", "w")).join(table, "w")
        found = at.select(*own, "words", "win", "key", start).where(F.col("key").isNull() | (fits & same))
        return found.select("doc_id", "h", "n_words", "start", F.size("win").alias("n"), "key")
    at = texts.select("doc_id", "h", F.posexplode("words").alias("p", "w")).join(prefix.select("w", "pos", "key"), "w")
    at = at.select("doc_id", "h", "key", (F.col("p") - F.col("pos")).alias("start")).where("start >= 0").distinct()
    once = texts.dropDuplicates(["doc_id", "h"]).withColumnsRenamed({"doc_id": "d2", "h": "h2"})
    near = at.join(once, F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("h").eqNullSafe(F.col("h2")))
    found = near.join(distinct, "key").where(fits & same).select(*own, "start", F.size("win").alias("n"), "key")
    none = F.lit(None)
    return found.unionByName(texts.select(*own, none.cast("int").alias("start"), F.lit(0).alias("n"), none.cast("string").alias("key")))


@tidy
def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20, bound: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    contaminated: a word is hit and at least one in ``share`` words is.
    """
    return _contamination(docs, benchmark, size, share, bound).drop("h", "longest")


def _contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The same with h, the text's hash, and longest, the words of the longest window that occurs."""
    win = stash(windows(benchmark, size).coalesce(FILES), "windows")
    found = stash(occurrences(docs, win, bound), "found")
    by = ["doc_id", "h"]
    hits = found.where("key is not null").select(*by, "start", (F.col("start") + F.col("n")).alias("end"), "key")
    # a null item id counts for n_hit alone
    named = hits.join(win.select("key", F.col("item_id").cast("string").alias("i")), "key")
    spans = F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")
    each = named.groupBy(*by).agg(spans, F.sort_array(F.collect_set("i")).alias("items"), F.max(F.col("end") - F.col("start")).alias("longest"))
    # words under the spans, each once: how far they reach so far tells which are new
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("reach"))
    step = lambda a, x: F.struct((a["total"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["reach"]))).alias("total"), F.greatest(a["reach"], x["end"]).alias("reach"))
    each = each.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.aggregate("spans", start, step, lambda a: a["total"]).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"), "longest")
    base = found.where("key is null").select(*by, "n_words")
    out = base.join(each, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("h").eqNullSafe(F.col("g")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "h",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("longest", F.lit(0)).alias("longest"),
    )


@tidy
def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """docs without those in which a window of ``least`` words or more occurs, however long the
    document is, and without the contaminated ones (where only shorter items occur)."""
    bad = _contamination(docs, benchmark).where((F.col("longest") >= least) | F.col("contaminated"))
    bad = stash(bad.select(F.col("doc_id").alias("__tw_d"), F.col("h").alias("__tw_h")).distinct(), "bad")
    return docs.join(maybe_broadcast(bad), F.col("doc_id").eqNullSafe(F.col("__tw_d")) & (F.xxhash64("text") == F.col("__tw_h")), "left_anti")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[o : o + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS o FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), hits AS (
  SELECT DISTINCT doc_id, s, dw.k, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY 1
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY 1
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
