import random
import re
from collections import Counter

import numpy as np

from loomline.llm import decontaminate as D
from loomline.llm import words as W


def tokens(text):
    return [w.decode() for w in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode())]


def grams(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def alike(a, b):
    same = sum(min(n, b[k]) for k, n in a.items())
    return same / (sum(a.values()) + sum(b.values()) - same)


def brute(docs, items):
    """Every window of the item's size against every item."""
    out = []
    for doc, text in docs:
        words = tokens(text)
        for item, passage in sorted({(i, p) for i, p in items if p is not None}, key=str):
            own = tokens(passage)
            if len(own) < 5:
                continue
            best = max(((round(alike(grams(words[s : s + len(own)]), grams(own)), 12), -s) for s in range(len(words) - len(own) + 1)), default=(0, 0))
            if best[0] >= 0.8:
                out.append((doc, item, -best[1], len(own), best[0]))
    return sorted(out, key=str)


def test_like_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["an", "er", "Tion", "thé", "ou", "in", "re", "st", "ble", "ly", "on", "x1"]
    passage = lambda n: [rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(passage(rng.choice((5, 6, 9, 14, 14, 25, 40, 60))))) for i in range(30)] + [(50, "too few words"), (51, ""), (52, None), (0, None)]
    items.append((60, "a a a a a a a a a a"))
    items.append(items[3])
    docs = []
    for i in range(150):
        words = passage(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            own = items[rng.randrange(30)][1].split()
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = own if rng.random() < 0.8 else own[: len(own) // 2]
        text = rng.choice((" ", "\n", " | ", "!! ")).join(words)
        docs.append((i, text.upper() if rng.random() < 0.2 else text))
    docs += [(500, None), (501, ""), (502, "a " * 300), (503, items[0][1]), (503, items[0][1]), (None, items[1][1]), (504, ("pad " * 3000) + items[2][1] + (" pad" * 3000))]
    got = D.contaminated(spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, item_id int, similarity string"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r.doc_id, r.item_id, r.start_word, r.n_words, round(r.similarity, 12)) for r in got.collect()), key=str)
    want = brute([(d, t.replace("É", "é") if t else t) for d, t in docs], items)
    assert got == want and len(want) > 30


def test_passes_and_clean(spark):
    items = [(i, f"item number {i} has its own words like w{i} and v{i} here") for i in range(20)]
    docs = [(i, f"start {items[i][1]} end", "k") for i in range(0, 20, 2)] + [(100, "clean text of some words that match nothing at all", None), (101, None, "n")]
    documents, benchmark = spark.createDataFrame(docs, "doc_id long, text string, extra string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(documents, benchmark, pass_bytes=300).collect()} >= {(i, i) for i in range(0, 20, 2)}
    for pass_bytes in (300, 1 << 20):
        assert sorted(tuple(r) for r in D.keep_clean(documents, benchmark, pass_bytes=pass_bytes).collect()) == [docs[-2], docs[-1]]
    assert D.keep_clean(documents, benchmark.limit(0)).count() == len(docs)
    assert D.contaminated(documents.limit(0), benchmark).collect() == D.contaminated(documents, benchmark.limit(0)).collect() == []


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(3)
    index = D.Index([" ".join(f"w{rng.integers(1000)}" for _ in range(20)) for _ in range(300)])
    for _ in range(300):
        k, t = rng.integers(300), rng.integers(D.PRINTS)
        other = rng.integers(0, 1 << 63, (1, D.PRINTS)).astype(np.uint64)
        bits = np.unpackbits(index.prints[k, t : t + 1].view(np.uint8))
        bits[rng.choice(64, rng.integers(0, index.radius + 1), replace=False)] ^= 1
        other[0, t] = np.packbits(bits).view("<u8")[0]
        assert any(k in entries for _, entries in index.near(other))


def test_blocks_reject_random_windows_and_find_similar_ones():
    """Under 5 % of random windows pass a block of an item; nearly all windows at a similarity of 0.8 to 1 are found."""
    rng = np.random.default_rng(8)
    a, b = (D.simhash(rng.integers(0, 1 << 63, 160_000).astype(np.uint64), 40)[::40] for _ in range(2))  # windows that share nothing
    apart = np.bitwise_count(a.view("<u2") ^ b.view("<u2")).reshape(len(a), -1)
    assert (apart <= D.RADIUS // D.BLOCKS).any(axis=1).mean() < 0.05
    missed = tried = 0
    for n in (9, 20, 36, 100, 400):
        for _ in range(300):
            own = rng.integers(0, 1 << 63, n).astype(np.uint64)
            other = own.copy()
            gone = rng.integers(1, n // 9 + 1)
            other[rng.choice(n, gone, replace=False)] = rng.integers(0, 1 << 63, gone).astype(np.uint64)
            assert D.similarity(own, other) >= 0.8
            tried += 1
            missed += (np.bitwise_count(D.simhash(own, n) ^ D.simhash(other, n)) > D.RADIUS).all()
    assert missed <= tried * 0.003


def test_many_items_of_one_size_take_under_a_second():
    import time

    import pyarrow as pa

    rng = random.Random(5)
    text = lambda n: " ".join(f"v{rng.randrange(400)}" for _ in range(n))
    items = [text(40) for _ in range(5000)]
    doc = text(400) + " " + items[77] + " " + " ".join(w for i in range(0, 4000, 10) for w in items[i].split()[:7]) + " " + text(400)
    index = D.Index(items)
    start = time.perf_counter()
    found = index.matches(pa.array([doc]))
    assert time.perf_counter() - start < 4 and [(f[1], f[2]) for f in found] == [(77, 400)]
    held = sum(x.nbytes for x in vars(index).values() if isinstance(x, np.ndarray))
    assert held < 5 * sum(map(len, items)) + (8 << 20)


def test_a_line_that_items_of_many_sizes_share():
    """A document of 4,200 words that repeats the line opens no windows; with an item in it, that one is found."""
    import time

    import pyarrow as pa

    rng = random.Random(6)
    text = lambda n: " ".join(f"v{rng.randrange(100_000)}" for _ in range(n))
    line = "which of these is right"
    items = [f"{line} {text(5 + i % 191)}" for i in range(1000)]
    doc = " ".join(f"{line} {text(2)}" for _ in range(600))
    index = D.Index(items)
    start = time.perf_counter()
    assert index.matches(pa.array([doc])) == []
    assert time.perf_counter() - start < 2
    assert [(f[1], f[2]) for f in index.matches(pa.array([doc + " " + items[150]]))] == [(150, 4200)]


def test_simhash_of_runs():
    h = W.mixed(np.arange(30, dtype=np.uint64))
    whole = D.simhash(h, 7)
    assert whole.shape == (24, D.PRINTS)
    for s in (0, 5, 23):
        assert (whole[s] == D.simhash(h[s : s + 7], 7)[0]).all()
