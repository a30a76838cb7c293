import json
import math
import random
import struct

import numpy as np
from pyspark.sql import functions as F

from loomline.functions import documents, text
from loomline.operators import naming, repeats
from loomline.sources import headers, library


def test_half_floats_both_ways(spark):
    """Packing equals numpy's rounding, for all values there are, their neighbours and the middles between them; unpacking gives them back."""
    every = np.arange(65536, dtype=np.uint16).view(np.float16)
    finite = every[np.isfinite(every)].astype(np.float64)
    middle = (np.sort(finite)[1:] + np.sort(finite)[:-1]) / 2
    values = np.concatenate([every.astype(np.float64), middle, np.nextafter(middle, np.inf), np.nextafter(middle, -np.inf), [65519.99, 65520.0, -65520.0, 1e30, 1e-30, 2.0**-25, 5e-324]])
    packed = library.packed_halves(F.col("v"))
    df = spark.createDataFrame([(values[i : i + 128].tolist(),) for i in range(0, len(values), 128)], "v array<double>").select("v", packed.alias("p")).cache()
    rows = df.select("v", F.unbase64("p").alias("b"), library.half_floats(F.unbase64("p")).alias("back")).collect()
    for r in rows:
        with np.errstate(over="ignore"):
            want = np.array(r.v).astype(np.float16)
        got = np.frombuffer(bytes(r.b), "<f2")
        known = ~np.isnan(want)
        assert (got.view(np.uint16)[known] == want.view(np.uint16)[known]).all() and np.isnan(got[~known]).all()
        assert np.array_equal(np.array(r.back, np.float32), want.astype(np.float32), equal_nan=True)
    odd = spark.createDataFrame([(None,), ([],), ([None, 1.0],)], "v array<double>").select(library.packed_halves(F.col("v")).alias("b"), library.half_floats(F.unbase64(library.packed_halves(F.col("v")))).alias("back")).collect()
    assert odd[0].b is None and odd[1].b == "" and odd[1].back == [] and math.isnan(odd[2].back[0]) and odd[2].back[1] == 1.0


def test_headers_round_trip_and_damage():
    fields = {"make": "Canon", "model": "x", "datetime": "2001:02:03 04:05:06", "exposure": 0.008, "fnumber": 2.8, "iso": 100, "focal": 50.0}
    for order in "<>":
        data = headers.header_bytes(fields, order)
        assert headers.header(data) == fields
        jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + (len(data) + 8).to_bytes(2, "big") + b"Exif\0\0" + data
        assert headers.header(jpeg) == fields
        for n in range(len(data)):
            assert set(headers.header(data[:n])) <= set(fields)
    pick = random.Random(2)
    for _ in range(3000):
        broken = bytearray(headers.header_bytes(fields))
        for _ in range(pick.randrange(1, 6)):
            broken[pick.randrange(8, len(broken))] = pick.randrange(256)
        headers.header(bytes(broken))
    assert headers.header(b"") == {} and headers.header(b"\xff\xd8\xff") == {} and headers.header(b"\x89PNG1234567890") == {}
    # a directory that names itself, an original time, and a ratio over zero
    loop = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3) + struct.pack("<HHII", 306, 2, 3, int.from_bytes(b"ab\0", "little")) + struct.pack("<HHII", 34665, 4, 1, 8) + struct.pack("<HHII", 33437, 5, 1, 50) + b"\0" * 4 + struct.pack("<II", 7, 0)
    assert headers.header(loop) == {"datetime": "ab", "fnumber": 0.0}


def test_headers_of_a_folder(spark, tmp_path):
    fields = {"make": "M", "model": None, "iso": 5, "exposure": 0.5}
    rows = [(f"d{i % 3}/p{i}.TIF", headers.header_bytes(fields)) for i in range(7)] + [("x.jpg", None), ("d1/y.txt", b"II*\0")]
    headers.write_files(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / "f"))
    got = headers.picture_headers(spark, str(tmp_path / "f"), endings="tif jpg").collect()
    assert len(got) == 8 and sum(r.make == "M" and r.iso == 5 and r.exposure == 0.5 and r.model is None for r in got) == 7
    assert headers.picture_headers(spark, str(tmp_path / "f"), "path string, length long").where("length = 0").count() == 1
    (tmp_path / "none").mkdir()
    assert headers.picture_headers(spark, str(tmp_path / "none")).collect() == []


def test_side_documents_with_defaults(spark):
    rows = [
        '{"next": 1.0, "a\\"b, 1.0": "x, 1.50", "people": {"p1": {"w": 1.50, "n": [1.0, 2e3, 12345678901234567890123]}}}', "{bad", "[1, 2]", None, "", '{"next": null, "ages_off": ["f"], "z": true}', '{"next": "x", "people": []}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = df.select(documents.filled(F.col("t"), "people").alias("w"), documents.people(F.col("t")).alias("p")).collect()
    assert got[0].w == '{"a\\"b, 1.0":"x, 1.50","ages_off":[],"next":1.0,"people":{"p1":{"n":[1.0,2e3,12345678901234567890123],"w":1.50}},"rejected":{}}'
    assert {got[i].w for i in (1, 2, 3, 4)} == {'{"ages_off":[],"next":1,"people":{},"rejected":{}}'}
    assert json.loads(got[5].w) == {"next": 1, "ages_off": ["f"], "z": True, "people": {}, "rejected": {}}
    assert [(r.p.next, len(r.p.people), r.p.ages_off) for r in got] == [(1, 1, []), (1, 0, []), (1, 0, []), (1, 0, []), (1, 0, []), (1, 0, ["f"]), (1, 0, [])]
    boxed = spark.createDataFrame([('{"boxes": {"3": {"size": 36, "writing": "x"}, "12": {}, "7": {"writing": null}}}',), ('{"boxes": {"a": {}}}',), ("{",), ('{"boxes": []}',)], "t string").select(documents.boxes(F.col("t"))).collect()
    assert {k: tuple(v) for k, v in boxed[0][0].items()} == {3: (36, "x"), 12: (50, ""), 7: (50, "")} and all(not r[0] for r in boxed[1:])


def test_running_sum(spark):
    rows = [("a", i, i % 7) for i in range(500)] + [("b", 1, 3), (None, 2, 5), (None, 1, 1)]
    got = naming.running_sum(spark.createDataFrame(rows, "g string, o int, v int"), ["g"], ["o"], F.col("v"), "s").collect()
    assert sorted(((r.g, r.o, r.s) for r in got), key=str) == sorted(((g, o, sum(v for h, p, v in rows if h == g and p <= o)) for g, o, _ in rows), key=str)


def plain_names(items, taken):
    wanted, used, seen, out = {n for _, n in items if n is not None}, set(taken), set(), {}
    for key, name in sorted(i for i in items if None not in i):
        if name not in seen and name not in taken:
            out[key] = name
        else:
            n = 2
            while f"{name}-{n}" in used | wanted:
                n += 1
            out[key] = f"{name}-{n}"
        seen.add(name)
        used.add(out[key])
    return out


def test_free_names_like_taking_turns(spark):
    """Names that look numbered, taken numbers in rows and with gaps, equal names by the hundred."""
    pick = random.Random(4)
    items = [(k, pick.choice(["a", "a-2", "a-3", "a-2-2", "b", "b-02", "c-1", "", "a-" + str(pick.randrange(40))])) for k in range(400)] + [(None, "a"), (900, None)]
    taken = ["a", "a-5", "a-6", "a-7", "b-2", "c-1", "c-1-3", "a-2-4"] * 2
    got = naming.free_names(spark.createDataFrame(items, "k int, name string"), spark.createDataFrame([(t,) for t in taken] + [(None,)], "name string"), "k", "name").collect()
    names = {r.k: r.name for r in got}
    assert len(got) == len(names) == 400 and len(set(names.values())) == 400 and not set(names.values()) & set(taken)
    assert names == plain_names(items, taken)
    assert naming.free_names(spark.createDataFrame([], "k int, name string"), spark.createDataFrame([], "name string"), "k", "name").collect() == []


def plain_banned(seq, n):
    end = seq[len(seq) - n + 1 :]
    return {seq[i + n - 1] for i in range(len(seq) - n + 1) if seq[i : i + n - 1] == end and None not in seq[i : i + n]} if len(seq) >= n else set()


def test_banned_next(spark):
    pick = random.Random(6)
    seqs = {"u": [2, 0, 5, 6, 7, 5, 6], "v": [2, 0, 5], "w": [1, 1, 1, 1], "x": [5, 6, None, 5, 6], "y": [4, None]} | {str(k): [pick.randrange(3) for _ in range(pick.randrange(1, 30))] for k in range(40)}
    df = spark.createDataFrame([(k, i, t) for k, s in seqs.items() for i, t in enumerate(s)], "s string, i int, t int")
    for n in (1, 2, 3, 4):
        got = {(r.s, r.t) for r in repeats.banned_next(df, ["s"], ["i"], "t", n).collect()}
        assert got == {(k, t) for k, s in seqs.items() for t in plain_banned(s, n)}


def test_tidy(spark):
    rows = spark.createDataFrame([("  a cat  with green eyes ",), ("A rocket.",), ("two dogs,",), ("",), (None,)], "c string")
    assert [r[0] for r in rows.select(text.tidy(F.col("c"))).collect()] == ["A cat with green eyes.", "A rocket.", "Two dogs.", "", None]
