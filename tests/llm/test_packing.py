import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomline.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_best_fit_like_a_plain_scan(lengths):
    place, offset = P.best_fit_decreasing(np.array(lengths, np.int64), 32)
    left = []
    want = {}
    for n in sorted(lengths, reverse=True):
        fits = [c for c in left if c >= n]
        if fits:
            c = min(fits)
            left.remove(c)
        else:
            c = 32
        left.append(c - n)
    used = defaultdict(list)
    for n, p, o in zip(lengths, place, offset):
        used[int(p)].append((int(o), n))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 32
    assert sorted(32 - sum(n for _, n in v) for v in used.values()) == sorted(left)


def documents(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "é", "thntre", "漢字", "\n", "  ", "42"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(99, "a <|endoftext|> b's don't  x \u00a0\u3000 ½²")]
    rows += [(100, None), (101, ""), (102, "word " * 3000), (3, "repeat"), (3, "repeat"), (None, "no id")]
    return rows, spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, length int, offset int")


def test_round_trip(spark):
    rows, docs = documents(spark)
    encoder = Tokenizer.from_file(PATH)
    got = P.pack_documents(docs, PATH, window=64, tasks=3).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for doc in {i for i, _ in rows}:
        want = sorted(tuple(encoder.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows if i == doc)
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc])
        made = sorted((s, len(w[s : s + 64]), zlib.crc32(np.array(w[s : s + 64], "<u4").tobytes()), len(w)) for w in want for s in range(0, len(w), 64))
        assert pieces == made
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
        assert {r.padding for r in parts} == {0 if at & (at - 1) == 0 else 64 - at}
    again = P.pack_documents(docs, PATH, window=64, tasks=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_sequences_hold_every_id(spark):
    rows, docs = documents(spark)
    encoder = Tokenizer.from_file(PATH)
    got = P.sequences(docs, PATH, window=64, tasks=2).collect()
    assert sum(len(r.ids) for r in got) == sum(len(encoder.encode(t or "").ids) + 1 for _, t in rows)
    for r in got:
        assert len(r.ids) == sum(p["length"] for p in r.pieces) <= 64


def test_empty(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_very_long_runs_of_white_space(spark):
    n = 3_000_000
    mixed = "".join(random.Random(4).choices(" \n\t\u00a0\r", k=n))
    texts = ["a" + " " * n + "b", "\n" * n, " \n" * (n // 2), mixed, "a" * n]
    whole = Tokenizer.from_file(PATH)
    want = {i: whole.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = P.pack_documents(docs, PATH).collect()
    for i, ids in want.items():
        made = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        assert made == [(s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for s in range(0, len(ids), 2048)]


def test_full_windows_are_sequences_of_their_own(spark):
    rows, docs = documents(spark)
    got = P.pack_documents(docs, PATH, window=64, tasks=3).collect()
    full = [r.sequence_id for r in got if r.length == 64]
    assert len(full) > 40 and len(set(full)) == len(full) and not set(full) & {r.sequence_id for r in got if r.length < 64}
    assert all(r.offset == r.padding == 0 for r in got if r.length == 64)


def test_encoder_like_tokenizers():
    encode, whole = P.Encoder(PATH), Tokenizer.from_file(PATH)
    assert encode.fast is not None
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encode, whole = P.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        rng = random.Random(5)
        for _ in range(200):
            text = "".join(rng.choice(" \n\tabzé'漢\U0001f600.,!0²ſst\u0301<|endoftext|>") for _ in range(rng.randint(0, 60)))
            assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids
        assert encode("<|endoftext|>").tolist() == whole.encode("<|endoftext|>", add_special_tokens=False).ids
