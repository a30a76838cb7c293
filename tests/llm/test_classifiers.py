import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomline.llm import quality, toxicity
from loomline.llm import words as W

SYLLABLES = ["an", "er", "tion", "the", "ou", "in", "re", "st", "ble", "ly"]


def corpus(seed=5, n=400):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 80))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["scum", "idiot", "worthless"])
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text, "xx", "s", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(9000, None, None, None, None), (9001, "", "xx", "s", 0), (9002, "word " * 20000, "xx", "s", 7), (None, "no id", "xx", "s", 5), (3, "repeat of an id", "xx", "s", 1)]
    labels += [(None, 1, 1), (9001, None, None), (5, 0, 0), (5, 1, 1), (123456, 1, 0)]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


@pytest.mark.parametrize("module, label, modulus, held", [(quality, "quality", 3, 1), (toxicity, "toxic", 5, 0)])
def test_held_out(tables, module, label, modulus, held):
    docs, labels = tables
    got = module.classify(docs, labels, sample_rows=300).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r[label] for r in labels.collect() if r.doc_id is not None and r.doc_id < 400 and r.doc_id not in (3, 5)}
    right = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth and r.held_out]
    assert len(right) > 50 and np.mean(right) > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == held)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_no_labels_and_empty(tables, module):
    docs, labels = tables
    assert {r.held_out for r in module.classify(docs, labels.limit(0)).collect()} == {True, False}
    assert module.classify(docs.limit(0), labels).collect() == []


def test_keep_good_keeps_columns(tables):
    docs, labels = tables
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 200 < kept.count() < docs.count()


def test_pair_sum_is_that_of_all_pairs():
    rng = np.random.default_rng(1)
    m = quality.FactorisationMachine(6, 3)
    m.weights, m.factors, m.bias = rng.normal(size=6), rng.normal(size=(6, 3)), rng.normal(size=1)
    x = rng.normal(size=(4, 6))
    want = [m.bias[0] + v @ m.weights + sum(v[i] * v[j] * (m.factors[i] @ m.factors[j]) for i in range(6) for j in range(i)) for v in x]
    assert np.allclose(m.logit(x), want)


def test_features_do_not_depend_on_the_batch():
    texts = ["One two.\nOne two.\n", None, "", "É é | x!!", "a" * 5000, "x\ny\nx\ny"]
    chars = [len(t or "") for t in texts]
    whole = quality.features(pa.array(texts), pa.array(chars))
    for i, t in enumerate(texts):
        one = quality.features(pa.array([t], pa.string()), pa.array([chars[i]]))
        assert np.allclose(one[0][0], whole[0][i]) and np.allclose(one[1][0], whole[1][i])


def test_words_like_a_pattern():
    import re

    texts = ["Ab cd-É9_x", None, "", "  zz", "a", "ÀÖ×ß", "end"]
    w = W.words(pa.array(texts))
    want = [re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"\xc3([\x80-\x96\x98-\x9e])", lambda m: b"\xc3" + bytes([m[1][0] + 32]), (t or "").encode().lower())) for t in texts]
    assert np.diff(w.first).tolist() == [len(x) for x in want]
    assert [bytes(w.data[a:b]) for a, b in zip(w.starts, w.ends)] == [x for t in want for x in t]
    assert w.rows().tolist() == [i for i, t in enumerate(want) for _ in t]


def test_windows_do_not_depend_on_the_parts(monkeypatch):
    words = [f"w{i}" for i in range(103)]
    for size, step in ((4, 2), (3, 1), (3, 3)):
        want = [" ".join(words[i : i + size]) for i in range(0, max(1, len(words) - size + step), step)]
        for at_once in (7, 8, 50, 103, 1000):
            monkeypatch.setattr(toxicity, "_WORDS_AT_ONCE", at_once)
            assert [w for part in toxicity.windows(" ".join(words), size, step) for w in part] == want
            assert {x for w in want for x in w.split()} == set(words)
    assert [w for part in toxicity.windows("") for w in part] == [] and [w for part in toxicity.windows("One") for w in part] == ["one"]


def test_toxicity_scores_by_a_plain_reading(tables):
    """Each score from the two dictionaries alone: every window compressed with both by itself, thresholds counted, logistic weights."""
    import zstandard

    docs, labels = tables
    model = toxicity.fit(docs, labels, sample_rows=300)
    distance, calibration = model
    assert b"idiot" in distance.dictionaries[0] and b"idiot" not in distance.dictionaries[1] and zstandard.ZstdCompressionDict(distance.dictionaries[1]).dict_id()
    got = sorted((r.doc_id if r.doc_id is not None else -1, round(r.score, 9)) for r in toxicity.score(docs, model).collect())
    want = []
    for r in docs.collect():
        words = __import__("re").findall(r"[^\W_]+", (r.text or "").lower())
        saved = []
        for i in range(0, max(1, len(words) - 2), 2):
            if words:
                block = toxicity.CARRIER + f" {' '.join(words[i : i + 4])} ".encode() + toxicity.TRAILER
                saved.append(len(distance.ordinary.compress(block)) - len(distance.toxic.compress(block)))
        n = max(1, len(saved))
        passed = [sum(s >= t for s in saved) for t in range(1, 11)]
        top = sorted(saved, reverse=True)[:3] or [0]
        x = [np.log1p(p) for p in passed] + [np.log1p(1000 * p / n) for p in passed] + [top[0], np.mean(top), sum(saved) / n, np.log1p(n)]
        z = calibration.beta[0] + sum(b * np.clip((v - m) / s, -5, 5) for b, v, m, s in zip(calibration.beta[1:], x, calibration.mean, calibration.scale))
        want.append((r.doc_id if r.doc_id is not None else -1, round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 9)))
    assert got == sorted(want)


def test_quality_scores_by_a_plain_reading(tables):
    """Each score of the query's rows, from the model by the sum over all pairs of features, one text at a time."""
    docs, labels = tables
    model = quality.fit(docs, labels, sample_rows=300)
    m = model.machine
    cross = m.factors.astype(float) @ m.factors.astype(float).T
    got = sorted((r.doc_id if r.doc_id is not None else -1, round(r.score, 4)) for r in quality.score(docs, model).collect())
    want = []
    for r in docs.collect():
        x = model.inputs(*quality.features(pa.array([r.text], pa.string()), pa.array([r.n_chars], pa.int64())))[0].astype(float)
        at = np.flatnonzero(x)
        z = m.bias[0] + x @ m.weights + sum(x[i] * x[j] * cross[i, j] for k, i in enumerate(at) for j in at[:k])
        want.append((r.doc_id if r.doc_id is not None else -1, round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 4)))
    assert len(got) == len(want) and max(abs(a[1] - b[1]) for a, b in zip(got, sorted(want))) < 2e-3


def test_rare_forms_share_their_beginning(spark):
    """Each inflected form is in one document; only what they begin with recurs, and frequent words recur in both classes."""
    rng = random.Random(3)
    made = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4)))
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(["and", "with", made()]) for _ in range(40)]
        toxic = i % 3 == 0
        if toxic:
            for at in (7, 19, 31):
                words[at] = "vrizzok" + made()
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, given)
    assert b" vrizzok" in model[0].dictionaries[0] and b"vrizzok" not in model[0].dictionaries[1]
    right = [r.predicted == int(r.doc_id % 3 == 0) for r in toxicity.score(docs, model).collect() if r.held_out]
    assert len(right) > 80 and np.mean(right) > 0.95
