import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomline.llm import quality, simhash_dedup
from loomline.llm.spark_io import read


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents with every fate: junk, copies, leaks, personal data, clean."""
    rng = random.Random(9)
    out = tmp_path_factory.mktemp("sf")
    words = lambda n: " ".join("".join(rng.choice(["an", "er", "tion", "the", "ou", "in"]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    item = words(40)
    docs, labels = [], []
    for i in range(300):
        text = words(rng.randint(60, 120)) + "."
        if i % 3 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(i % 3 != 0), 0))
    clean = words(90)
    docs += [(1000, clean, "en", "s", len(clean)), (1001, clean, "en", "s", len(clean)), (1002, clean, None, None, len(clean))]
    leak = words(30) + " " + item + " " + words(30)
    mail = words(60) + " someone@mail.example.com " + words(20)
    docs += [(1003, leak, "en", "s", len(leak)), (1004, mail, "en", "s", len(mail)), (1004, mail, "en", "s", len(mail))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_each_stage_takes_effect(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    columns = docs.columns
    fate = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir).cache()
        assert after.columns == columns
        before, rows = {r.doc_id for r in docs.collect()}, after.collect()
        fate[name] = before - {r.doc_id for r in rows}
        if name == "quality":
            scores = {r.doc_id: r.predicted for r in quality.classify(docs, read(spark, sf_dir, "labels")).collect()}
            assert fate[name] == {d for d, p in scores.items() if not p}
            assert len(fate[name] ^ set(range(0, 300, 3))) <= 3 and not any(d >= 1000 for d in fate[name])
        if name == "near_duplicates":
            first = {}
            for r in sorted(docs.collect(), key=lambda r: r.doc_id):
                near = next((f for f in first if (f ^ simhash_dedup.fingerprint(r.text)).bit_count() <= 2), None)
                first.setdefault(simhash_dedup.fingerprint(r.text) if near is None else near, r.doc_id)
            assert sorted(r.doc_id for r in rows) == sorted(first.values()) and {1001, 1002} <= fate[name]
        docs = after
    assert fate["decontamination"] == {1003} and fate["pii"] == set()
    mail = next(r for r in docs.collect() if r.doc_id == 1004)
    assert "<EMAIL>" in mail.text and "@" not in mail.text and mail.n_chars == len(mail.text)
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(encoder.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == want


def test_rows_without_id_or_text(spark, sf_dir):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "x", "y", None), (1, None, "x", "y", None), (2, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert {r.doc_id for r in docs.collect()} <= {None, 1, 2}
