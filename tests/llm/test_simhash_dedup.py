import random

import pytest
import xxhash

from loomline.llm import simhash_dedup as S
from loomline.operators.components import connected_components


def brute(rows):
    """Fingerprints by the definition and components by comparing all pairs."""
    fps = []
    for _, text in rows:
        words = [w for w in __import__("re").split(r"[ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label):
        if doc is not None:
            least[x] = min(doc, least.get(x, doc))
    return sorted(((d, f"{f:016x}", least.get(x)) for (d, _), f, x in zip(rows, fps, label)), key=str)


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, fp int, root int")
    return sorted((tuple(r) for r in S.near_duplicates(docs, **kw).collect()), key=str)


def test_masks_cover_every_pair_of_bits():
    masks = S.covering_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(i):
            assert any(not (m >> i & 1) and not (m >> j & 1) for m in masks)


def test_like_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [rng.choice("abcdefgh") * rng.randint(1, 3) + str(i) for i in range(60)]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 80))]
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            words[rng.randrange(len(words))] = "changed"
            rows.append((1000 - i, "\n".join(words).upper()))
    rows += [(2000, None), (2001, ""), (2002, "\t "), (2003, "One"), (2004, "one"), (2005, "x é X"), (2005, "x é X"), (None, "only null id"), (None, None), (2006, "ÉCOLE école")]
    assert run(spark, rows) == brute(rows)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Fingerprints that crowd one bucket: midpoints must find what all pairs find."""
    rng = random.Random(2)
    values = {0}
    while len(values) < 150:
        base = rng.choice(list(values))
        for _ in range(rng.choice((1, 2, 2, 5))):
            base ^= 1 << rng.randrange(64)
        values.add(base)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for bucket in (2, 16, 10_000):
        links = S.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), pair_bucket=bucket)
        found = connected_components(links).collect()
        root = {r["node"]: r["root"] for r in found}
        label = {v: v for v in signed}
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and label[a] != label[b]:
                    x, y = sorted((label[a], label[b]))
                    label = {k: x if v == y else v for k, v in label.items()}
        assert {v: root.get(v, v) for v in signed} == label
        assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2 for r in links.collect())


def test_empty_table_and_radius(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).collect() == []
    with pytest.raises(ValueError):
        S.fingerprint_links(spark.createDataFrame([(1,)], "fp long"), radius=3)


def test_keep_one(spark):
    docs = spark.createDataFrame([(3, "a b c d", "x"), (1, "A b c d", "y"), (1, "A b c d", "y"), (2, "other words here now", None)], "doc_id long, text string, extra string")
    assert sorted(tuple(r) for r in S.keep_one(docs).collect()) == [(1, "A b c d", "y"), (2, "other words here now", None)]


def test_keep_one_decides_on_rows(spark):
    """Ids that repeat with other texts: no text is lost, no copy stays, whatever the order of the rows."""
    a, b = "words of the text a in a row", "another text that is not like it"
    rows = [(1, a, "k"), (5, a, "k"), (5, b, "k"), (7, b, "k")]
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
        assert sorted(tuple(r) for r in S.keep_one(docs).collect()) == [(1, a, "k"), (5, b, "k")]
    rows = [(3, a, "y"), (3, a, "x"), (3, b, None), (None, a, "z"), (None, "only without id", "2"), (None, "only without id", "1"), (4, None, "n"), (9, "", "m")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, extra string").repartition(3)
        assert sorted((tuple(r) for r in S.keep_one(docs).collect()), key=str) == sorted([(3, a, "x"), (3, b, None), (None, "only without id", "1"), (4, None, "n")], key=str)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(str(i % 97) for i in range(1000))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "_CHUNK", 7)
    assert S.fingerprint(text) == whole
