"""SimHash, substring dedup and decontamination against brute force."""

from __future__ import annotations

import random
from itertools import pairwise

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import decontaminate as dc
from tidewire.llm import simhash as sh
from tidewire.llm import substrings as sub

from .conftest import sentence


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(v >> b & 1 for v in h) > len(h))


@given(st.text(max_size=80))
@settings(max_examples=60, deadline=None)
def test_fingerprint_matches_definition(text):
    assert sh.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_of_a_very_long_text(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = sh.fingerprint(text)
    monkeypatch.setattr(sh, "BLOCK", 64)
    assert sh.fingerprint(text) == whole == brute_fingerprint(text)


@pytest.mark.parametrize("reach", [2, 3])
def test_every_close_pair_shares_an_anchor(reach):
    rng = random.Random(1)
    x = [rng.getrandbits(64) for _ in range(20)]
    y = [v ^ sum(1 << b for b in rng.sample(range(64), k % 3)) for k, v in enumerate(x)]
    rows, keys = sh.anchors(np.array(x + y, np.uint64), reach)
    at = [set(keys[rows == k].tolist()) for k in range(40)]
    assert all(at[k] & at[k + 20] for k in range(20))
    assert all(int(a).bit_count() is not None and (int(a) ^ (x + y)[k]).bit_count() <= reach for k in range(40) for a in at[k])


def brute_components(fps, threshold=2):
    ids, comp = list(fps), {i: i for i in fps}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in ids:
        for j in ids:
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_components_equal_brute_force(make, vocabulary):
    rng = random.Random(5)
    base = [sentence(rng, 60, vocabulary) for _ in range(12)]
    texts = base + [b + " end" for b in base] + [base[0]] * 3 + [None, "", "one", "ONE", " a\tb ", "x " * 3000]
    got = sh.simhash_components(make(texts, extra=True)).toPandas().set_index("doc_id")
    fps = {k: brute_fingerprint(t) for k, t in enumerate(texts)}
    assert {k: int(v, 16) for k, v in got.fingerprint.items()} == fps
    assert got.component_id.to_dict() == brute_components(fps)
    assert got.loc[27, "fingerprint"] == "0" * 16


def test_simhash_dedup_keeps_one_of_each_group(make, vocabulary):
    rng = random.Random(6)
    a, b = sentence(rng, 80, vocabulary), sentence(rng, 80, vocabulary)
    df = make([a, a, b, a, b], ids=[4, 2, 9, None, 9], extra=True)
    out = sh.simhash_dedup(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(2, a), (9, b)]
    alone = sh.simhash_dedup(make([a, a], ids=[None, None]))
    assert [r["doc_id"] for r in alone.collect()] == [None]
    assert sh.simhash_dedup(make([])).count() == 0 and sh.simhash_components(make([])).count() == 0


# --- substrings


def test_bands_reach_the_recall():
    bands, rows = sub.tune()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and bands <= 10
    rng = np.random.default_rng(2)
    hit = 0
    for _ in range(300):
        both = rng.integers(0, 1 << 32, 80, np.uint64)
        a, b = np.concatenate([both, rng.integers(0, 1 << 32, 10, np.uint64)]), np.concatenate([both, rng.integers(0, 1 << 32, 10, np.uint64)])
        keys = sub.band_keys([a.astype(np.uint32), b.astype(np.uint32)], bands, rows)
        hit += bool((keys[0] == keys[1]).any())
    assert hit >= 285


@given(st.lists(st.sampled_from("abcdefgh"), max_size=300), st.integers(0, 40), st.integers(0, 40))
@settings(max_examples=60, deadline=None)
def test_every_shared_run_of_50_words_is_covered(words, before, after):
    passage = [*"the quick brown fox".split(), *words, *(f"w{k}" for k in range(46))]
    a = [*(f"a{k}" for k in range(before)), *passage, *(f"b{k}" for k in range(after))]
    b = [*(f"c{k}" for k in range(after)), *passage, *(f"d{k}" for k in range(before))]
    (at, got), (_, other) = (sub.winnowed(sub.word_hashes(x, {})) for x in (a, b))
    hit = np.zeros(len(a), bool)
    for s in at[np.isin(got, other)]:
        hit[s : s + sub.WINDOW] = True
    edge = sub.WINNOW - 1
    assert hit[before + edge : before + len(passage) - edge].all() and not hit[:before].any() and not hit[before + len(passage) :].any()


def test_one_word_repeated_is_thinned_but_covered():
    at, _ = sub.winnowed(sub.word_hashes(["and"] * 500, {}))
    assert len(at) < 60 and at[0] < sub.WINNOW and at[-1] + sub.WINDOW > 500 - sub.WINNOW and np.diff(at).max() <= sub.WINDOW


@given(st.lists(st.sampled_from(["A", "bb", "\u00e9", " ", "\n", "\t", "\u2003", "\x1c"]), max_size=60), st.data())
@settings(max_examples=80, deadline=None)
def test_only_the_words_of_the_runs_go(parts, data):
    text = "".join(parts)
    words = text.split()
    cuts = sorted(data.draw(st.sets(st.integers(0, len(words)), max_size=6)))
    cuts = cuts[: len(cuts) // 2 * 2]
    stay = [w for k, w in enumerate(words) if not any(s <= k < e for s, e in zip(cuts[::2], cuts[1::2], strict=True))]
    got = sub.without(text, cuts)
    assert got.split() == stay and (got == text if not cuts else True)


def test_lines_stay_apart_where_a_passage_went():
    assert sub.without("a b c\nd e", [1, 3]) == "a\nd e"
    assert sub.without("a b\nc d\ne", [2, 4]) == "a b\ne"
    assert sub.without("a b c", [0, 3]) == ""


def test_passages_inside_prose_go_whatever_sentences_they_have(spark, make, vocabulary):
    rng = random.Random(12)
    texts = []
    for length in (50, 55, 60, 80, 200):
        for stop in (0, 7, 30):
            words = sentence(rng, length, vocabulary).split()
            passage = " ".join(w + "." if stop and k % stop == stop // 2 else w for k, w in enumerate(words))
            texts += [f"{sentence(rng, rng.randint(20, 90), vocabulary)} {passage} {sentence(rng, rng.randint(20, 90), vocabulary)}" for _ in range(3)]
    got = sub.dedup_substrings(make(texts)).toPandas().sort_values("doc_id")
    for k, (text, out) in enumerate(zip(texts, got.text, strict=True)):
        assert out == text if k % 3 == 0 else len(out.split()) <= len(text.split()) - sub.RUN_WORDS
    grams = [{" ".join(w[i : i + 28]) for i in range(len(w) - 27)} for w in (t.lower().split() for t in got.text)]
    assert sum(map(len, grams)) == len(set().union(*grams))


def test_shared_runs_go_to_their_true_ends(make, vocabulary):
    rng = random.Random(14)
    prose = lambda n: sentence(rng, n, vocabulary)
    texts = []
    for length in (28, 30, 35, 41, 49, 50, 75):
        passage = prose(length)
        texts += [f"{prose(rng.randint(20, 90))} {passage} {prose(rng.randint(20, 90))}" for _ in range(3)]
    # runs that the second and third document share beyond what the first has
    for more in (1, 5, 11, 20):
        passage, left, right = prose(40), prose(more), prose(more)
        texts += [f"{prose(30)} {passage} {prose(30)}", *(f"{prose(30)} {left} {passage} {right} {prose(30)}" for _ in range(2))]
    seen, want = set(), []
    for text in texts:
        w = text.split()
        grams = [" ".join(w[i : i + sub.RUN_WORDS]) for i in range(len(w) - sub.RUN_WORDS + 1)]
        goes = {k for i, g in enumerate(grams) if g in seen for k in range(i, i + sub.RUN_WORDS)}
        want.append(" ".join(x for k, x in enumerate(w) if k not in goes))
        seen.update(grams)
    got = sub.dedup_substrings(make(texts)).toPandas().sort_values("doc_id")
    assert [t.split() for t in got.text] == [t.split() for t in want]


def test_repeats_go_and_clean_text_stays(make, vocabulary):
    rng = random.Random(9)
    clean = ["\n".join(sentence(rng, 12, vocabulary).capitalize() + "." for _ in range(6)) for _ in range(5)]
    passage = ". ".join(sentence(rng, 11, vocabulary) for _ in range(6)) + "."
    words = passage.split()
    near = " ".join([*words[:-1], "altered."])
    texts = [
        clean[0] + "\n" + passage,
        passage + "\n" + clean[1],
        sentence(rng, 25, vocabulary) + ". " + passage + " " + sentence(rng, 25, vocabulary) + ".",
        clean[2] + "\n" + near,
        clean[3] + "\nStock line here.",
        clean[4] + "\nStock line here.",
        None,
        "",
        "word " * 20_000,
        passage,
    ]
    df = make(texts, extra=True)
    got = {r["doc_id"]: r for r in sub.dedup_substrings(df).collect()}
    assert got[0]["text"] == texts[0] and got[1]["text"].strip() == clean[1]
    assert passage not in got[2]["text"] and got[2]["text"].startswith(texts[2].split(".")[0])
    assert got[3]["text"].strip() == clean[2] and got[9]["text"] == ""
    for k in (4, 5, 6, 7, 8):
        assert got[k]["text"] == texts[k] and got[k]["_removed"] == [] and got[k]["_removed_words"] == 0
    assert got[1]["_removed_words"] == len(words)
    assert sub.dedup_substrings(df).columns == [*df.columns, "_removed", "_removed_words"]
    assert sub.dedup_substrings(make([])).count() == 0


def test_repeated_rows_and_null_ids_stay(make, vocabulary):
    rng = random.Random(10)
    text = ". ".join(sentence(rng, 12, vocabulary) for _ in range(8)) + "."
    got = [(r["doc_id"], r["text"]) for r in sub.dedup_substrings(make([text, text, text, text], ids=[3, 3, None, 7])).collect()]
    assert sorted(got, key=str) == sorted([(3, text), (3, text), (None, text), (7, "")], key=str)


def test_a_large_group_of_near_copies_is_one_class(make, vocabulary):
    rng = random.Random(11)
    base = sentence(rng, 90, vocabulary).split()
    texts = []
    for k in range(60):
        w = list(base)
        w[k % 90] = f"other{k}"
        texts.append(" ".join(w))
    got = sub.dedup_substrings(make(texts)).toPandas().sort_values("doc_id")
    assert got.text.iloc[0] == texts[0] and (got.text.iloc[1:] == "").all()


@pytest.mark.parametrize("cell", [4, 1024])
def test_classes_equal_those_of_all_pairs_that_share_a_band(make, vocabulary, cell):
    rng = random.Random(13)
    texts = []
    for size in (2, 9, 40):
        base = sentence(rng, 60, vocabulary).split()
        for k in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(60)] = f"other{k}"
            texts.append(" ".join(w))
    every = sub.passages(make(texts))
    got = {r["p"]: r["c"] for r in sub.classes(every, cell=cell).collect()}
    own = {r["p"]: (set(r["bands"]), set(np.frombuffer(r["sh"], np.uint32).tolist())) for r in every.where("sh is not null").collect()}
    comp = {p: p for p in own}

    def root(p):
        while comp[p] != p:
            p = comp[p]
        return p

    for p, (bands, x) in own.items():
        for q, (others, y) in own.items():
            if p < q and bands & others and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                a, b = root(p), root(q)
                comp[max(a, b)] = min(a, b)
    assert got == {p: root(p) for p in own if any(q != p and root(q) == root(p) for q in own)}


# --- decontamination


def brute_contamination(texts, items):
    import re

    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for d, t in enumerate(texts):
        w, hit, names = word(t), set(), set()
        for i, x in items:
            v = word(x)
            k = min(13, len(v))
            wins = {tuple(v[o : o + k]) for o in range(len(v) - k + 1)} if k else set()
            for s in range(len(w) - k + 1 if k else 0):
                if tuple(w[s : s + k]) in wins:
                    hit |= set(range(s, s + k))
                    names.add(str(i))
        out[d] = (len(w), len(hit), len(names), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("bound", [10_000, 0])
def test_contamination_equals_brute_force(spark, make, vocabulary, bound):
    rng = random.Random(12)
    small = vocabulary[:12]
    items = [(k, sentence(rng, n, small if k % 2 else vocabulary)) for k, n in enumerate([20, 5, 13, 40, 1, 15])] + [(10, None), (11, "?!"), (12, "Ünder ÉCOLE x")]
    items += [(20, items[0][1]), (0, items[0][1])]
    texts = [sentence(rng, 30, vocabulary) + " " + items[k % 6][1].upper() + ", " + sentence(rng, 200 if k % 3 else 9, small) for k in range(14)]
    texts += [None, "", "Ünder ÉCOLE x!", "ünder École x", items[0][1] * 2, texts[0], "and " * 4000]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = make(texts, extra=True)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in dc.contamination(df, bench, bound=bound).collect()}
    assert got == brute_contamination(texts, [i for i in items])
    if bound:
        kept = dc.decontaminate(df, bench)
        assert kept.columns == df.columns
        # one window of 8 words or more is enough, in a text of any length; shorter items need their share
        long = brute_contamination(texts, [(i, x) for i, x in items if len((x or "").split()) >= 8])
        assert sorted(r["doc_id"] for r in kept.collect()) == [d for d, v in sorted(got.items()) if not v[3] and not long[d][1]]
        diluted = make([sentence(rng, 5000, vocabulary[20:]) + " " + items[0][1] + " " + sentence(rng, 5000, vocabulary[20:])])
        assert not dc.contamination(diluted, bench).first()["contaminated"] and dc.decontaminate(diluted, bench).isEmpty()
        assert dc.decontaminate(make([]), bench).isEmpty()
        assert dc.contamination(make([]), bench).count() == 0
        assert not dc.contamination(df, bench.limit(0)).where("contaminated").count()


def test_components_of_a_path_and_a_star(spark):
    from tidewire.llm.common import components

    path = list(pairwise(random.Random(2).sample(range(100, 140), 40)))
    star = [(7, k) for k in range(200, 260)]
    got = dict(components(spark.createDataFrame(path + star + [(5, 5), (None, 9)], "a bigint, b bigint")).collect())
    assert {got[k] for e in path for k in e} == {min(k for e in path for k in e)}
    assert {got[k] for k in range(200, 260)} == {7} == {got[7]}
    assert 5 not in got and 9 not in got
