import base64
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.sources import library
from loomline.streaming import stateful


def test_trays_slides_and_faces(spark, tmp_path):
    for name, body in (("a", json.dumps({"id": "a", "date": "", "groups": [{"id": "g1", "scans": ["s"], "date": "1970", "tags": ["x"]}, {"id": "g2", "date": "", "skip": True}]})), ("b", "{broken"), ("c", "{}")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "session.json").write_text(body)
    v = np.array([1.5, -0.25, 65504, 6e-8, 0], "<f2")
    (tmp_path / "a" / "faces.json").write_text(json.dumps({"slides": {"g1": {"key": "k", "faces": [{"id": "f", "box": [0, 0, 1, 1], "score": 0.9, "emb": base64.b64encode(v.tobytes()).decode()}, {"id": "e"}]}}}))
    trays = library.trays(spark, str(tmp_path))
    assert [r.id for r in trays.collect()] == ["a"]
    got = [(r.pos, r.slide_id, r.date, r.skip) for r in library.slides(trays).orderBy("pos").collect()]
    assert got == [(0, "g1", "1970", False), (1, "g2", None, True)]
    faces = {r.face_id: r for r in library.faces(spark, str(tmp_path)).collect()}
    assert faces["f"].tray_id == "a" and np.array_equal(np.array(faces["f"].emb, "f4"), v.astype("f4")) and faces["e"].emb is None


def test_scan_files(spark):
    paths = ["/c/a.jpg", "/c/A.NEF", "/c/b.JPG", "/c/.hid.jpg", "/c/.trash/x.jpg", "/c/t.txt", "/d/a.jpg", "/c/a.dng"]
    got = library.scan_files(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert sorted(r.path for r in got.collect()) == ["/c/A.NEF", "/c/a.dng", "/c/b.JPG", "/d/a.jpg"]


def test_gazetteer_files(spark, tmp_path):
    line = lambda i: "\t".join([str(i), f"City {i}", f"City {i}", "x,y" if i % 2 else "", "1.5", "2.5", "P", "PPL", "AT", "", "07", "", "", "", "1000", "", "", "Z", "2020-01-01"])
    (tmp_path / "c.txt").write_text("# comment\n" + "\n".join(line(i) for i in range(120)) + "\nshort\trow\n")
    (tmp_path / "l.txt").write_text("#ISO\nAT\tAUT\t040\tAU\tAustria\n")
    (tmp_path / "a.txt").write_text("AT.07\tTyrol\n")
    got = library.gazetteer(spark, *(str(tmp_path / n) for n in ("c.txt", "l.txt", "a.txt"))).orderBy("city_id").collect()
    assert len(got) == 120 and (got[1].country, got[1].admin, got[1].alts, got[1].pop) == ("Austria", "Tyrol", ["x", "y"], 1000)
    with pytest.raises(ValueError):
        library.gazetteer(spark, str(tmp_path / "l.txt"), str(tmp_path / "l.txt"), str(tmp_path / "a.txt"))


def test_commit_and_replace(spark, tmp_path):
    table = spark.createDataFrame([(1, "k1", None), (2, "k2", "old"), (3, None, "x")], "id long, key string, v string")
    made = spark.createDataFrame([(1, "k1", "new"), (2, "stale", "new"), (3, None, "y")], "id long, key string, v string")
    got = library.commit_if_unchanged(table, made, "id", "key", ["v"])
    assert {tuple(r) for r in got.collect()} == {(1, "k1", "new"), (2, "k2", "old"), (3, None, "y")}
    for n in (2, 1):
        library.replace_table(table.limit(n), str(tmp_path / "t"))
        assert library.current_table(spark, str(tmp_path / "t")).count() == n
    assert spark.createDataFrame([("n", 5, 7.9)], "a string, b long, c double").select(library.quick_fingerprint(F.col("a"), F.col("b"), F.col("c")).alias("f")).first().f == "n:5:7"


def test_settling_over_batches(spark, tmp_path):
    """A stream in three batches tells each folder once, as the table form does."""
    rows = [("a", "1", 0), ("a", "1", 20), ("a", "2", 25), ("a", "2", 54), ("a", "2", 55), ("a", "2", 90), ("a", "1", 100), ("a", "1", 130), ("b", "1", 0), ("b", "2", 50)]
    schema = "path string, fp string, at long"
    for i, part in enumerate((rows[:3], rows[3:6], rows[6:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stateful.settled_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "path", "fp", "at")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in stateful.settled(spark.createDataFrame(rows, schema), "path", "fp", "at").collect()) == [("a", "1", 100, 130), ("a", "2", 25, 55)]


def test_settling_in_batches(spark, tmp_path):
    """Many micro-batches, some run again with their state as it was, tell each settled folder once, like one table does."""
    pick = random.Random(9)
    rows = sorted(((pick.randrange(400), pick.choice("abc"), pick.choice(["1", "2", None])) for _ in range(160)), key=lambda r: (r[0], r[1], r[2] or ""))
    rows = [(k, f, t) for t, k, f in rows] + [("a", "1", None)]
    schema = "path string, fp string, at long"
    folder = str(tmp_path / "work")
    for i in range(0, len(rows), 33):
        spark.createDataFrame(rows[i : i + 33], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stateful.settle_stream(stream, folder, "path", "fp", "at", 12).trigger(availableNow=True).start().awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(f"{folder}/out").drop("batch").collect()), key=str)
    want = stateful.settled(spark.createDataFrame([r for r in rows if r[2] is not None], schema), "path", "fp", "at", 12)
    assert got == sorted((tuple(r) for r in want.collect()), key=str) and len(got) > 5
    state = spark.read.parquet(f"{folder}/state/0")
    again = stateful.settle_batch(spark.createDataFrame(rows[33:66], schema), state, "path", "fp", "at", 12)
    assert sorted((tuple(r) for r in again[0].collect()), key=str) == sorted((tuple(r) for r in spark.read.parquet(f"{folder}/out/batch=1").collect()), key=str)
    empty = stateful.settle_batch(spark.createDataFrame([], schema), state, "path", "fp", "at", 12)
    assert empty[0].count() == 0 and sorted(map(str, empty[1].collect())) == sorted(map(str, state.collect()))


def test_rate_limits(spark):
    rows = [("u", i, t) for i, t in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 5000])]
    got = [r.wait for r in stateful.rate_limits(spark.createDataFrame(rows, "k string, i long, t long"), "k", "t", "i").orderBy("i").collect()]
    assert got == [0, 0, 2, 4, 8, 16, 32, 64, 128, 256, 512, 900, 900, 900, 900, 0]
