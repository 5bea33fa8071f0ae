"""The three classifiers: held-out accuracy, identities, edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import langid, quality, textmap, toxicity
from tidewire.llm.textmap import Rows

from .conftest import sentence


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = quality.FactorisationMachine(30, 3)
    m.w[:], m.v[:], m.w0 = rng.normal(size=30), rng.normal(size=(30, 3)), 0.7
    ids, vals = rng.permutation(30)[:9], rng.normal(size=9)
    pairs = sum(float(m.v[i] @ m.v[j]) * a * b for p, (i, a) in enumerate(zip(ids, vals, strict=True)) for j, b in list(zip(ids, vals, strict=True))[p + 1 :])
    plain = 0.7 + sum(m.w[i] * a for i, a in zip(ids, vals, strict=True)) + pairs
    assert m.raw(Rows([ids], [vals]))[0] == pytest.approx(plain, rel=1e-4)


def test_pairwise_terms_learn_what_single_words_cannot():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2, 600), rng.integers(0, 2, 600)
    x = Rows([np.array([k, 2 + j]) for k, j in zip(a, b, strict=True)], [np.ones(2)] * 600)
    y = (a ^ b).astype(float)
    m = quality.FactorisationMachine(4).fit(x, y, epochs=60, batch=64, rate=0.2)
    assert ((m.raw(x) > 0) == y).mean() > 0.98


@pytest.fixture
def labelled(spark, make, vocabulary):
    rng = random.Random(4)
    texts, q, t = [], [], []
    for k in range(300):
        bad, toxic = k % 5 == 0, k % 4 == 0
        w = sentence(rng, 40, vocabulary).split()
        if bad:
            w = [f"{x}###" for x in w]
        if toxic:
            w[5:8] = ["vileword", "slurry", "nastiness"]
        texts.append(" ".join(w))
        q.append(0 if bad else 1)
        t.append(int(toxic))
    docs = make([*texts, None, "", "!" * 50, "z" * 100_000], extra=True)
    labels = spark.createDataFrame([(k, q[k], t[k]) for k in range(300)] + [(None, 1, 1), (5, None, None), (99999, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    return docs, labels, q, t


def test_quality_and_toxicity_on_held_out_rows(labelled):
    docs, labels, q, t = labelled
    for got, truth in ((quality.classify(docs, labels, meta=["n_chars", "none"]), q), (toxicity.classify(docs, labels), t)):
        r = got.toPandas().set_index("doc_id")
        assert len(r) == 304 and r.score.between(0, 1).all()
        held = [k for k in range(300) if r.held_out[k]]
        assert 30 < len(held) < 90
        assert np.mean([r.predicted[k] == truth[k] for k in held]) > 0.95
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    ids = {x["doc_id"] for x in kept.select("doc_id").collect()}
    assert len(ids & {k for k in range(300) if q[k]}) >= 236 and len(ids & {k for k in range(300) if not q[k]}) <= 3


def test_no_labels_and_no_documents(labelled, make):
    docs, labels, *_ = labelled
    assert set(quality.classify(docs, labels.limit(0)).toPandas().score.round(6)) == {0.5}
    assert set(toxicity.classify(docs, labels.limit(0)).toPandas().score.round(6)) == {0.5}
    ones = labels.where("toxic = 1")
    assert (toxicity.classify(docs, ones).toPandas().score > 0.9).all()
    assert quality.classify(make([]), labels).count() == 0 and toxicity.classify(make([]), labels).count() == 0


def test_the_penalty_takes_weight_off_identity_terms():
    rng = random.Random(5)
    texts, y = [], []
    for k in range(400):
        toxic = k % 2 == 0
        # labels are confounded: most toxic texts name a group
        group = "muslim" if rng.random() < (0.9 if toxic else 0.1) else "plain"
        texts.append(f"the {group} person {'vileword' if toxic else 'nice'} filler{k % 7} more{k % 11}")
        y.append(float(toxic))
    x, pairs = [toxicity.features(t) for t in texts], [p for t in texts for p in toxicity.swaps(t)]

    def raw(model, text):
        return model[0] + model[1][toxicity.features(text)].sum()

    free, fair = (toxicity.fit_weights(x, np.array(y), pairs, penalty=p) for p in (0.0, 20.0))
    gap = lambda m: abs(raw(m, "the muslim person") - raw(m, "the christian person"))
    assert gap(fair) < 0.2 * gap(free)
    assert raw(fair, "a vileword") > raw(fair, "a nice muslim person")


def test_kernel_rows_are_normalised_presence():
    x = langid.matrix(["abcab", "", None, "abcab abcab"])
    assert np.allclose((x[0] ** 2).sum(), 1) and not x[1].any() and not x[2].any()
    assert x[0] @ x[3] > 0.6


def test_presence_does_not_depend_on_blocks(monkeypatch):
    text = "".join(chr(97 + (k * k) % 23) for k in range(3000))
    whole = langid.matrix([text])
    monkeypatch.setattr(langid, "BLOCK", 50)
    assert np.array_equal(whole, langid.matrix([text]))


def test_languages(spark):
    rng = random.Random(6)
    parts = {"en": ["the", "ing", "tion", "wh", "and"], "de": ["sch", "ung", "keit", "über", "ein"], "fr": ["eau", "ment", "que", "où", "les"]}
    rows = [(k, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(rng.randint(3, 40))), lang) for k, lang in enumerate(["en", "de", "fr"] * 80)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !?", "fr"), (1003, "the thing and the tion", None), (None, "die sch ung keit", "de"), (1004, "eau ment que " * 20_000, "fr")]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id bigint, text string, lang string, lang_pred string, score double")
    got = langid.identify(docs).toPandas()
    by = got.dropna(subset="doc_id").set_index("doc_id")
    held = [k for k in range(240) if by.held_out[k]]
    assert held and np.mean([by.lang_pred[k] == rows[k][2] for k in held]) > 0.97
    assert all(by.lang_pred[k] == "und" and by.score[k] == 0 for k in (1000, 1001, 1002))
    assert by.lang_pred[1003] == "en" and by.lang_pred[1004] == "fr" and len(got) == len(rows)
    assert set(langid.identify(docs.limit(9).selectExpr("doc_id", "text", "cast(null as string) lang")).toPandas().lang_pred) == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_every_language_is_learned_and_signs_are_no_letters(spark):
    rng = random.Random(9)
    names = [f"l{k:02d}" for k in range(24)]
    words = {n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(6)] for n in names}
    rows = [(k, " ".join(rng.choices(words[names[k % 24]], k=12)), names[k % 24]) for k in range(24 * 14)]
    rows += [(9000 + k, t, "l00") for k, t in enumerate(["½ ² ①", "Ⅷ ٣", "_ 12", "   ", "", None])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, landmarks=4)  # fewer than languages: each has one all the same
    got = langid.predict(docs, model).withColumn("held_out", textmap.held_out(F.col("doc_id"), 4, 2)).toPandas().set_index("doc_id")
    assert all(got.lang_pred[9000 + k] == "und" and got.score[9000 + k] == 0 for k in range(6))
    held = [k for k in range(24 * 14) if got.held_out[k]]
    assert {got.lang_pred[k] for k in held} == set(names) and np.mean([got.lang_pred[k] == names[k % 24] for k in held]) > 0.9


def test_repeated_ids_give_one_model_whatever_the_order(spark):
    rows = [(k % 60, f"word{k % 7} text {k}", 9) for k in range(240)]
    labels = spark.createDataFrame([(k, int(k % 7 < 3), 0) for k in range(60)], "doc_id bigint, quality int, toxic int")
    kinds = "doc_id bigint, text string, n_chars bigint"
    samples = [textmap.labelled_sample(spark.createDataFrame(r, kinds), labels, "quality", 40) for r in (rows, rows[::-1])]
    one, two = (sorted(map(tuple, s.collect())) for s in samples)
    assert one == two and len({r[0] for r in one}) == len(one) > 20


def test_swaps_take_a_neutral_mention_off_the_score(spark):
    # in the labels, toxic texts name one group far more often; with the penalty a mention counts less
    rng = random.Random(4)
    neutral = [f"{a} {b} {c}" for a in ("calm", "sunny", "plain") for b in ("river", "table", "window") for c in ("today", "again", "there")]
    rows = []
    for k in range(600):
        bad = k % 2
        text = f"{rng.choice(neutral)} {'vile scum filth' if bad and rng.random() < 0.8 else 'nice day'}"
        rows.append((k, text + (" muslim people" if rng.random() < (0.9 if bad else 0.1) else " people")))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(600)], "doc_id bigint, quality int, toxic int")
    probe = spark.createDataFrame([(1, "sunny table today muslim people"), (2, "sunny table today christian people"), (3, "vile scum filth today people"), (4, "sunny table today people")], "doc_id bigint, text string")
    with_, without = (toxicity.score(probe, toxicity.fit(docs, labels, penalty=p)).toPandas().set_index("doc_id").score for p in (20.0, 0.0))
    assert abs(with_[1] - with_[2]) < 0.1 < without[1] - without[2]
    assert abs(with_[1] - with_[4]) < 0.1 < without[1] - without[4] and with_[3] > 0.5


def test_quality_filter_of_nothing_and_clashing_names(labelled, make):
    docs, labels, q, _ = labelled
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns and sum(q) - 5 <= kept.count() <= sum(q) + 12
    assert quality.quality_filter(docs.limit(0), labels).count() == 0
