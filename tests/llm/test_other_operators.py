"""Packing, embeddings, chat and url filters."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.llm import chat, embeddings, packing, urlfilter
from tidewire.llm.hnsw import Graph

# --- packing


@given(st.lists(st.integers(1, 40), min_size=1, max_size=40))
@settings(max_examples=80, deadline=None)
def test_best_fit_is_valid_and_above_the_bound(lengths):
    x = np.array(lengths)
    bins, offsets = packing.best_fit_decreasing(x, 40)
    for b in set(bins.tolist()):
        at = sorted((o, n) for o, n, k in zip(offsets, x, bins, strict=True) if k == b)
        assert [o for o, _ in at] == np.cumsum([0, *[n for _, n in at]])[:-1].tolist() and sum(n for _, n in at) <= 40
    assert packing.lower_bound(Counter(lengths), 40) <= bins.max() + 1


def test_bounds_beyond_the_sum():
    assert packing.lower_bound({21: 5}, 40) == 5  # no two fit together
    assert packing.lower_bound({14: 6}, 40) == 3  # two in each
    assert packing.lower_bound({}, 40) == 0


@pytest.mark.parametrize("text", ["Hello world", "a  b   c \n\n d\t", "naïve Ünïcode 日本 🎉", "<|endoftext|> x", "", "it's 'll 123abc"])
def test_ids_are_those_of_the_tokenizer(text):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    assert packing.encoder()(text) == Tokenizer.from_file(public.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


@given(st.text(max_size=60))
@settings(max_examples=60, deadline=None)
def test_any_text_gives_the_tokenizers_ids(text):
    test_ids_are_those_of_the_tokenizer.__wrapped__(text) if hasattr(test_ids_are_those_of_the_tokenizer, "__wrapped__") else test_ids_are_those_of_the_tokenizer(text)


def test_packing_round_trip(make, vocabulary):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 60, 200, 380]))) for _ in range(150)] + [None, "", " ".join(rng.choices(vocabulary, k=9000)), "same", "same"]
    ids = [*range(150), 150, None, 152, 7, 7]
    got = packing.pack_documents(make(texts, ids, extra=True), per_partition=40).toPandas()
    enc = packing.encoder()
    want = Counter()
    for d, t in zip(ids, texts, strict=True):
        raw = [*enc(t or ""), 0]
        first = len(raw) if len(raw) <= 2048 else len(raw) % 2048 or 2048
        cuts = [0, *range(first, len(raw), 2048), len(raw)] if len(raw) > first else [0, len(raw)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(-1 if d is None else d, p, a, b - a, zlib.crc32(array("I", raw[a:b]).tobytes()))] += 1
    assert Counter(zip(got.doc_id.fillna(-1).astype(int), got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
    # parts of 40 pieces exchange their gaps until next to nothing is lost
    assert got.sequence_id.nunique() <= packing.lower_bound(Counter(got.length.tolist())) + 1
    assert packing.pack_documents(make([])).count() == 0


# --- embeddings


def test_graph_finds_neighbours():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x)
    ids, _ = g.search(x[:200] + 0.01, 30)
    true = np.argsort(-(x[:200] + 0.01) @ x.T, axis=1)[:, :10]
    assert np.mean([len(set(a.tolist()) & set(b.tolist())) / 10 for a, b in zip(ids, true, strict=True)]) > 0.9


def brute_links(vectors, threshold=0.9):
    n = len(vectors)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for v in vectors]
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i].add(j), links[j].add(i)
    comp = list(range(n))
    for _ in range(n):
        for i in range(n):
            comp[i] = min([comp[i], *(comp[j] for j in links[i])])
    return [len(x) for x in links], comp


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    vectors = [b.tolist() for b in base] + [(base[k % 7] + rng.normal(0, 0.05, 16)).tolist() for k in range(60)] + [base[3].tolist()] * 4
    vectors += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None, *[1.0] * 15], [1.0, 0.0], [2.0, 0.1]]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, label int, n_links string")
    got = embeddings.near_duplicates(df, shards=3).toPandas().sort_values("vec_id")
    n, comp = brute_links(vectors)
    assert got.n_links.tolist() == n and got.component_id.tolist() == comp
    assert (got.kept == (got.vec_id == got.component_id)).all()
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_thousands_of_clustered_vectors_have_no_link_with_one_end(spark, monkeypatch):
    # narrow beams and hardly an audit: many links are found from one end only, if at all
    monkeypatch.setattr(embeddings, "BEAM", 4)
    monkeypatch.setattr(embeddings, "AUDIT", 1 << 40)
    rng = np.random.default_rng(8)
    v = np.repeat(rng.normal(size=(60, 24)), 40, axis=0) + rng.normal(0, 0.22, (2400, 24))
    v = np.vstack([v, rng.normal(size=(1600, 24))])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = embeddings.near_duplicates(df, shards=3).toPandas().sort_values("vec_id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    true = near.sum(1) - 1
    n = got.n_links.to_numpy()
    assert true.sum() > 10_000 and (n <= true).all() and n.sum() >= 0.9 * true.sum()
    # each link counts at both ends: in a component of two, both have one
    size = got.groupby("component_id").vec_id.transform("size").to_numpy()
    assert ((n == 0) == (size == 1)).all() and (n[size == 2] == 1).all() and n.sum() % 2 == 0


def test_graphs_are_written_and_read_as_they_were():
    v = np.random.default_rng(4).normal(size=(500, 8))
    shard = embeddings.Shard(np.arange(500), np.ones(500, np.int64), v, 0.9)
    again = embeddings.Shard.load(shard.dump(), 0.9)
    for a, b in zip(shard.graph.search(shard.single[:50], 12), again.graph.search(shard.single[:50], 12), strict=True):
        assert (a == b).all()
    assert (shard.unit == again.unit).all() and (shard.ids == again.ids).all()


def test_beams_widen_and_audits_hold():
    rng = np.random.default_rng(3)
    dense = rng.normal(size=(1, 16)) + rng.normal(0, 0.05, (300, 16))
    v = np.vstack([dense, rng.normal(size=(2000, 16))])
    shard = embeddings.Shard(np.arange(len(v)), np.ones(len(v), np.int64), v, 0.9)
    row, _ = shard.query(np.arange(len(v)), v)
    n = np.bincount(row, minlength=len(v))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    true = (u @ u.T >= 0.9).sum(1) - 1
    assert (n <= true).all() and n.sum() >= 0.98 * true.sum() and (n[:300] == true[:300]).mean() > 0.95


def test_a_wide_beam_takes_few_steps(monkeypatch):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(1, 16)) + rng.normal(0, 0.1, (700, 16)), rng.normal(size=(2300, 16))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g, steps, real = Graph(x), [], np.argpartition
    monkeypatch.setattr(np, "argpartition", lambda *a, **k: (steps.append(1), real(*a, **k))[1])
    ids, _ = g.search(x[:50], 1024)
    assert len(steps) < 100
    true = np.argsort(-x[:50] @ x.T, axis=1)[:, :700]
    assert np.mean([np.isin(t, i).mean() for t, i in zip(true, ids, strict=True)]) > 0.99


def test_vectors_stay_as_wide_as_they_came():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 1]), pa.array([[3.0, 4.0], [1.0, 0.0]], pa.list_(pa.float32()))], names=["cid", "n", "v"])
    shard = embeddings.Shard.load(embeddings.Shard(*embeddings._vectors(batch, 0, 2), 0.9).dump(), 0.9)
    assert shard.v.dtype == np.float32 and shard.unit.dtype == np.float64
    assert shard.unit[0].tolist() == [3 / 5, 4 / 5]


# --- chat


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


_NASTY = st.lists(st.sampled_from([*"ab\\<|>[]/_ \n", "<|im_end|>", "[INST]", "</s>", "\\", "é", "🎉"]), max_size=25).map("".join)


def test_format_reads_back(spark):
    texts: list[str] = []

    @given(_NASTY)
    @settings(max_examples=150, deadline=None)
    def collect(t):
        texts.append(t)

    collect()
    rows = [(k // 5, k % 5, ["user", "assistant", "system", "to\nol<|im_sep|>", ""][(k * 7) % 5], t) for k, t in enumerate(texts)]
    rows += [(-1, 0, None, None), (None, None, "assistant", "x"), (-2, 1, "assistant", "b"), (-2, 1, "assistant", "b"), (-2, 0, "user", "a" * 100_000)]
    df = spark.createDataFrame([(*r, "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    done = chat.render(chat.reconstruct(df))
    got = {r["conv_id"]: r for r in chat.digest(done).collect()}
    plain = {r["conv_id"]: r["formatted"] for r in done.collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        loss = "".join(t for _, role, t in mine if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(mine), sha("".join(f"{a}\n{b}\n" for _, a, b in mine)))
        assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(loss), sha(loss), len(plain[conv]))
        assert plain[conv].count(chat.START) == plain[conv].count(chat.END) == len(mine)
    assert chat.digest(chat.render(chat.reconstruct(df.limit(0)))).count() == 0


def test_events_fold_into_messages(spark):
    log = [
        (1, 0, 1, "message", "user", "hi"),
        (1, 1, 2, "message", "assistant", "Hel"),
        (1, 1, 3, "delta", "assistant", "lo"),
        (1, 1, 5, "delta", "assistant", " again"),
        (1, 1, 4, "regenerate", "assistant", None),
        (1, 1, 6, "delta", "assistant", "!"),
        (1, 0, 7, "edit", "user", "hello"),
        (1, 2, 8, "message", "user", "a"),
        (1, 2, 9, "message", "user", "b"),
        (2, 0, 1, "delta", "assistant", "lone"),
    ]
    df = spark.createDataFrame(log, "conv_id bigint, turn bigint, seq bigint, op string, role string, text string")
    got = sorted((r["conv_id"], r["turn"], r["m"], r["role"], r["text"]) for r in chat.reconstruct(df).collect())
    assert [g[-1] for g in got] == ["hello", " again!", "a", "b", "lone"]


# --- urls


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def test_urls_and_rules(spark):
    urls = ["http://A.Example.net/en/x", "https://example.net/de/", "http://net", "http://notnet/", "x", None, "", "ftp://example.com/de/1?x#y", "http://a.example.com/de", "https://B.org/fr/z", "http://h/a?b://c/d", "http://É.org:80/fr/", "http://x.net/" + "y/" * 2000, "://"]
    df = spark.createDataFrame([(k, u, "h", "host") for k, u in enumerate(urls)], "page_id bigint, url string, html string, host string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(df).collect()}
    for k, u in enumerate(urls):
        host, path = brute_url(u)
        fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert got[k]["verdict"] == verdict if rule else got[k]["verdict"] in ("allow", "block")
    assert urlfilter.filter_urls(df.limit(0)).count() == 0


def test_templates_generalise_and_purity_decides(spark):
    # one host: /spam/<id> is blocked where labelled, /news/<slug> is not; slugs vary statistically
    rows = [("h", f"/spam/{k}", "block" if k % 2 else None) for k in range(60)] + [("h", f"/news/s{k}-story/", "allow" if k % 2 else None) for k in range(60)] + [("h", "/about", None)]
    df = spark.createDataFrame(rows, "host string, path string, by_rule string")
    counts = df.select("host", urlfilter.template(F.col("path")).alias("t"), "by_rule").groupBy("host", "t").agg(F.count("*").alias("n"), F.count_if(F.col("by_rule") == "block").alias("blocked"), F.count("by_rule").alias("labelled"))
    tree = urlfilter.grow(counts)
    assert {tuple(r["tree"]) for r in tree.collect()} == {("spam", "*"), ("news", "*"), ("about",)}
    verdict = {tuple(r["t"]): r["rejected"] for r in urlfilter.judge(tree).collect()}
    assert verdict["spam", "*"] and not verdict["about",] and not any(v for k, v in verdict.items() if k[0] == "news")


def brute_tree(urls, rules, depth=urlfilter.DEPTH):
    """verdicts by the definition, one host after the other, on python dictionaries."""
    variable = re.compile(urlfilter._VARIABLE)
    parts = []
    for u in urls:
        host, path = brute_url(u)
        fits = [(len(h + p), v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        label = max(fits)[1] if fits else None
        parts.append((host, tuple("*" if variable.search(x.lower()) else x for x in path.split("/") if x)[:depth], label))
    known = [p for *_, p in parts if p]
    prior = known.count("block") / len(known) if known else 0.0
    out = {}
    for host in {h for h, *_ in parts}:
        own = [(t, t, label) for h, t, label in parts if h == host]
        for level in range(depth):
            seen = {}
            for _, tree, _ in own:
                if len(tree) > level:
                    seen.setdefault(tree[:level], []).append(tree[level])
            wild = {up for up, segs in seen.items() if (k := len(set(segs) - {"*"})) >= urlfilter.MANY_CHILDREN and sum(x != "*" for x in segs) <= urlfilter.FEW_URLS * k}
            own = [(t, (*tree[:level], "*", *tree[level + 1 :]) if len(tree) > level and tree[:level] in wild else tree, label) for t, tree, label in own]
        stats = {}
        for _, tree, label in own:
            for level in range(len(tree) + 1):
                b, l = stats.get(tree[:level], (0, 0))
                stats[tree[:level]] = (b + (label == "block"), l + (label is not None))
        used = {(): stats[()]}
        for node in sorted(stats, key=len)[1:]:
            (b, l), (pb, pl) = stats[node], used[node[:-1]]
            p = pb / max(1, pl)
            like = not l or abs(b / l - p) <= urlfilter.Z * (p * (1 - p) / l + 1e-9) ** 0.5
            used[node] = (pb, pl) if like else (b, l)
        for t, tree, _ in own:
            b, l = used[tree]
            out[host, t] = (b + urlfilter.STRENGTH * prior) / (l + urlfilter.STRENGTH) >= urlfilter.PURITY
    return [label or ("block" if out[host, t] else "allow") for host, t, label in parts]


def test_the_tree_judges_as_defined(spark):
    rng = random.Random(21)
    rules = (("block", "spam.org", "/a/"), ("block", "spam.org", "/b/"), ("block", "one.org", "/a/"), ("block", "mixed.org", "/a/"), ("allow", "mixed.org", "/b/"), ("allow", "good.org", "/"), ("allow", "few.org", "/b/"))
    hosts = ["spam.org", "www.spam.org", "one.org", "mixed.org", "good.org", "few.org", "none.org"]
    segment = lambda: rng.choice(["a", "b", "c", str(rng.randint(1, 9999)), f"s{rng.randint(1, 40)}-x", "2024-01-02"])
    urls = [f"http://{rng.choice(hosts)}/" + "/".join(segment() for _ in range(rng.randint(0, 4))) for _ in range(900)]
    urls += ["http://spam.org/c/" + "deep/" * 40, "http://one.org/a/x", None, "no url"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = [r["verdict"] for r in urlfilter.filter_urls(df, rules).orderBy("page_id").collect()]
    assert got == brute_tree(urls, rules)
    free = [k for k, u in enumerate(urls) if not any(h in (u or "") for h in ("spam.org/a/", "spam.org/b/", "one.org/a/", "mixed.org/a/", "mixed.org/b/", "good.org", "few.org/b/"))]
    # labels reach urls without a rule, and not all of them
    assert {got[k] for k in free} == {"allow", "block"}
    assert got[urls.index("http://spam.org/c/" + "deep/" * 40)] == "block" and got[-1] == got[-2]
