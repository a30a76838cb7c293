"""Steps whose work must grow with their input, against plain versions of what they give."""

import math
import os
import random
import unicodedata
from datetime import date, timedelta
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomline.functions import curves
from loomline.operators import gazetteer, grid, matching, robust, sequence


def test_tones_without_a_table(spark):
    """The entries looked up are those of the whole table, which the query does not work out."""
    from loomline.plans import pictures

    pick = random.Random(2)
    rows = [(k, [(x / 100, pick.random()) for x in sorted(pick.sample(range(101), pick.randrange(1, 7)))], [pick.uniform(-0.2, 1.2) for _ in range(5)] + [0.0, 1.0, None]) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, p array<struct<x: double, y: double>>, v array<double>")
    table = df.withColumn("t", curves.curve_table(F.col("p"), 65)).select("k", F.transform("v", lambda v: curves.toned(F.col("t"), v)).alias("w"))
    want = {r.k: r.w for r in table.collect()}
    for r in df.select("k", curves.toned_at(F.col("p"), F.col("v"), 65).alias("w")).collect():
        assert r.w is None and want[r.k] == [None] * 8 or r.w == want[r.k]
    plan = pictures.tone_curves(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, 1023" not in plan


def test_interval_totals_by_days(spark):
    """As pairs of points and windows counted; windows that are equal, empty, turned round or open; days without points."""
    pick = random.Random(4)
    day = lambda: date(2020, 1, 1) + timedelta(pick.randrange(90))
    points = [(i, pick.choice([None, day(), day(), day()])) for i in range(300)]
    windows = [(w, lo, lo and lo + timedelta(pick.randrange(-2, 40))) for w, lo in ((w, pick.choice([None, day(), day(), date(2020, 2, 1)])) for w in range(120))]
    got = matching.interval_totals(spark.createDataFrame(points, "p long, d date"), "d", "p", spark.createDataFrame(windows + windows[:5], "w long, lo date, hi date"), "w", "lo", "hi")
    want = []
    for w, lo, hi in windows + windows[:5]:
        held = [p for p, d in points if lo and d and lo <= d < hi]
        want += [(w, len(held), min(held))] if held else []
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_box_sums_by_tiles(spark):
    """As by the table of the whole picture; and a picture too large for any such table."""
    pick = random.Random(6)
    sizes = {"a": (11, 9), "b": (4, 4), "c": (0, 3)}
    values = [(k, pick.randrange(-1, w + 2), pick.randrange(-1, h + 1), pick.choice([-2, 1, 5, None])) for k, (w, h) in sizes.items() for _ in range(60)]
    boxes = [(i, pick.choice("abcd"), *(pick.choice([None] + list(range(-3, 14)) * 2) for _ in range(4))) for i in range(300)]
    v = spark.createDataFrame(values, "p string, x int, y int, v long")
    s = spark.createDataFrame([(k, *wh) for k, wh in sizes.items()], "p string, width int, height int")
    b = spark.createDataFrame(boxes, "box int, p string, left int, top int, right int, bottom int")
    want = sorted(map(tuple, grid.box_sums(grid.prefix_sums(v, s, ["p"], "v", tile=4), s, b, ["p"], ["box"]).collect()))
    for whole in ("long", "double"):
        got = grid.tiled_box_sums(v.withColumn("v", F.col("v").cast(whole)), s, b, ["p"], ["box"], "v", tile=4)
        assert sorted(map(tuple, got.collect())) == want
    far = 10**9
    cells = spark.createDataFrame([("a", far - 1, far - 2, 3), ("a", far - 3, far - 3, 4), ("a", 0, 0, 5)], "p string, x long, y long, v long")
    one = spark.createDataFrame([(1, "a", far - 3, far - 3, far + 9, far + 9), (2, "a", -4, -4, 4, 4)], "box int, p string, left long, top long, right long, bottom long")
    assert sorted(map(tuple, grid.tiled_box_sums(cells, spark.createDataFrame([("a", far, far)], "p string, width long, height long"), one, ["p"], ["box"], "v").collect())) == [(1, 9, 7), (2, 25, 5)]


def _km(a, b):
    (p, x), (q, y) = ([math.radians(v) for v in c] for c in (a, b))
    return 12742 * math.asin(math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2))


@pytest.mark.parametrize("seen", [4, 1e-6])
def test_nearest_city_by_all_pairs(spark, monkeypatch, seen):
    """Looking once and looking ever further; poles, the date line, a crowd of cities, many on one place, points without any."""
    monkeypatch.setattr(gazetteer, "SEEN", seen)
    pick = random.Random(8)
    spot = lambda: (pick.choice([pick.uniform(-90, 90), pick.uniform(89, 89.99), -89.5, 47.0]), pick.choice([pick.uniform(-180, 180), 179.99, -179.98, 8.0]))
    towns = [spot() for _ in range(60)] + [(47 + pick.uniform(0, 0.2), 8 + pick.uniform(0, 0.2)) for _ in range(60)] + [(47.1, 8.1)] * 30 + [(None, 1.0)]
    points = [spot() for _ in range(150)] + [(47 + pick.uniform(0, 2), 8 + pick.uniform(0, 2)) for _ in range(100)] + [(47.1, 8.1)] * 5
    cities = spark.createDataFrame([(i, *t) for i, t in enumerate(towns)], "city_id long, lat double, lon double")
    got = gazetteer.nearest_city(spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "p long, lat double, lon double"), cities, "p", "lat", "lon", 300.0)
    want = {}
    for i, p in enumerate(points):
        near = min((round(_km(p, t), 6), j) for j, t in enumerate(towns) if t[0] is not None)
        if near[0] <= 300:
            want[i] = near
    assert {r.p: (round(r.km, 6), r.city_id) for r in got.collect()} == want and 100 < len(want) < len(points)


def test_nearest_city_asks_each_place_once(spark):
    """A thousand points and a thousand cities on four places: 16 pairs meet at most, not a million."""
    rows = spark.range(1000).select("id", (F.col("id") % 4 / 100).alias("lat"), F.lit(8.0).alias("lon"))
    asked = gazetteer._within
    met = []
    try:
        gazetteer._within = lambda places, towns, km: met.append(places.count() * towns.count()) or asked(places, towns, km)
        got = gazetteer.nearest_city(rows.withColumnRenamed("id", "p"), rows.withColumnRenamed("id", "city_id"), "p", "lat", "lon", 20.0)
        assert got.where("city_id = p % 4 AND km = 0").count() == 1000 and max(met) == 16
    finally:
        gazetteer._within = asked


def test_folded_sources_of_all_letters(spark, tmp_path):
    """Every sign of the lower planes first, within and last, as the SQL has it: ß at the start, sigma at an end, loose marks, odd spaces, other digits.

    Signs of later versions of Unicode, and two that got a capital later, are as new to the SQL's engine or the JVM as these are.
    """
    from loomline.plans import places

    signs = [chr(i) for i in [*range(1, 0x3000), *range(0xA640, 0xA800), *range(0xF900, 0xFFFE), 0x1D400, 0x1D165, 0x1F600] if i not in (10, 0x19B, 0x264) and unicodedata.ucd_3_2_0.category(chr(i)) not in ("Cn", "Cs")]
    texts = [(i, f"{c}b a{c}, {c}{c} x{c}\n{c}\nend {c}\n. {c}!{c}, {c},") for i, c in enumerate(signs)] + [(-1, None), (-2, ""), (-3, "ßeta, \u03a3\u0391\u03a3\n" + "e\u0301 " * 300)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    os.rename(next((tmp_path / "d").glob("*.parquet")), tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = {r[:2]: r[2:] for r in c.execute(f"SELECT doc_id, line_no, folded, slug, tags, caption FROM ({places.FOLDED})").fetchall()}
    got = {(r.doc_id, r.line_no): (r.folded, r.slug, r.tags, r.caption) for r in places.folded_sources(spark, str(tmp_path)).collect()}
    off = {k: (ascii(signs[k[0]]), got.get(k), want[k]) for k in want if got.get(k) != want[k]}
    assert not off and len(got) == len(want)


def test_robust_line_of_groups_of_any_size(spark):
    """Small groups in one task and large ones by ranges of values, alike; the small ones are dealt out once for all rounds."""
    pick = random.Random(9)
    rows = [(k, float(i % 50), 2.0 * (i % 50) + pick.gauss(0, 1) + (90.0 if i % 9 == 0 else 0.0)) for k, n in (("a", 200), ("b", 31), ("c", 2), ("d", 1), ("e", 120)) for i in range(n)] + [("e", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    shown = lambda n: {r.k: (r.slope and round(r.slope, 9), r.intercept and round(r.intercept, 9), r.n) for r in robust.robust_line(df, ["k"], "x", "y", group_rows=n).collect()}
    assert shown(1000) == shown(0) == shown(100) and shown(0)["a"][2] < 200 and set(shown(0)) == set("abce")
    plan = robust.robust_line(df, ["k"], "x", "y")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_runs_of_words_stay_where_they_are(spark):
    """A gazetteer that is small is broadcast before any run is dealt out; runs are only of as many words as keys have, and longer ones still hold shorter."""
    city = "city_id long, name string, alts array<string>, pop long"
    lines = spark.createDataFrame([(1, "seen in New London 1970"), (2, "London road"), (3, "greetings from London"), (4, "York"), (5, "Via York, London")], "l long, t string")
    one = gazetteer.city_keys(spark.createDataFrame([(1, "London", [], 9), (2, "York", ["Eboracum"], 5)], city))
    two = gazetteer.city_keys(spark.createDataFrame([(1, "London", [], 9), (2, "York", ["Eboracum"], 5), (3, "New London", [], 1), (4, "Eboracum", [], 5)], city))
    found = gazetteer.places_in_text(lines, one, "l", "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert {r.l: (r.city_id, round(r.confidence, 4)) for r in found.collect()} == {1: (1, 0.6), 3: (1, 0.9), 4: (2, 0.45), 5: (1, 0.6)}
    assert {r.l: (r.city_id, round(r.confidence, 4)) for r in gazetteer.places_in_text(lines, two, "l", "t").collect()} == {1: (3, 0.6), 3: (1, 0.9), 4: (2, 0.45), 5: (1, 0.6)}


def test_words_of_many_texts_meet_a_gazetteer_at_once(spark):
    """No run of words is a row unless the gazetteer is too large for a task; texts by line, line by line and dealt out name the same places, over ends of lines too."""
    pick = random.Random(3)
    words = "welcome unwelcome to greetings from bem vindo a xbem via road bar city alpha beta gamma delta epsilonia zetaville 123456 de of été Łódź straße hotel".split()
    texts = ["".join(pick.choice(words) + pick.choice([" ", " ", ", ", "\n", "\n\n"]) for _ in range(pick.randrange(40))) for _ in range(300)] + [None, "", "\n", "x greetings\nfrom\nalpha", "greetings from\n\nalpha"]
    df = spark.createDataFrame([(i, t, pick.choice([1.0, 0.8, 0.5, None])) for i, t in enumerate(texts)], "l long, t string, c double")
    names = sorted({" ".join(pick.choice(words) for _ in range(pick.choice([1, 1, 2, 2, 3, 4]))) for _ in range(200)})
    cities = spark.createDataFrame([(i, n, [pick.choice(names)], pick.choice([None, 5, 9, 200_000])) for i, n in enumerate(names)], "city_id long, name string, alts array<string>, pop long")
    keys = gazetteer.city_keys(cities)
    shown = lambda **how: sorted(map(tuple, gazetteer.places_in_text(df, keys, "l", "t", F.col("c"), **how).collect()))
    assert shown() == shown(held_keys=0) and shown(by_line=True) == shown(by_line=True, held_keys=0) != shown()
    units = [(i, k, u, c) for i, t, c in map(tuple, df.collect()) if t is not None for ls in [t.split("\n")] for k, u in enumerate(ls + [f"{a} {b}" for a, b in zip(ls, ls[1:])])]
    each = gazetteer.places_in_text(spark.createDataFrame(units, "l long, k int, u string, c double").withColumn("lk", F.struct("l", "k")), keys, "lk", "u", F.col("c"))
    best = each.groupBy(F.col("lk.l").alias("l")).agg(F.min(F.struct(-F.col("confidence"), "lk.k", "city_id")).alias("b")).select("l", "b.city_id", -F.col("b.col1"))
    assert sorted(map(tuple, best.collect())) == shown(by_line=True)
    plan = gazetteer.places_in_text(df, keys, "l", "t", by_line=True)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "MapInArrow" in plan
    # pieces of a few bytes name the same places as one
    held = pa.table({"key": ["alpha", "gamma delta"], "city_id": [1, 2], "_known": [True, True], "_plain": [0.45, 0.6], "_weight": [1.0, 1.0], "_n": [1, 2]})
    batch = pa.record_batch({"l": list(range(len(texts))), "_t": texts, "_c": [1.0] * len(texts)})
    found = lambda piece: [r for b in gazetteer._look(SimpleNamespace(value=held), "l", True, piece)(iter([batch])) for r in b.to_pylist()]
    assert found(10) == found(1 << 20) and len(found(10)) > 50


def test_small_groups_form_their_pairs_themselves(spark):
    """Without large groups nothing is joined; with them only these are, and the counts are the same."""
    pick = random.Random(11)
    df = spark.createDataFrame([(pick.randrange(60), pick.randrange(40)) for _ in range(400)], "g int, m int")
    found = matching.cooccurrence(df, "g", "m")
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, matching.cooccurrence(df, "g", "m", 4).collect()))


def test_clusters_in_few_rounds(spark):
    """A group that takes in forty faces one after the other takes a round for the part, not one for each; so do parts of a few groups, with the same clusters."""
    rows = [(0, [1.0] + [0.0] * 40, 0, 7)] + [(i, [0.7] + [0.0] * (i - 1) + [0.51**0.5] + [0.0] * (40 - i), i, None) for i in range(1, 41)]
    rows += [(41, None, 41, None), (42, [-1.0] + [0.0] * 40, 42, None), (43, [-1.0] + [0.0] * 40, 42, None)]
    df = spark.createDataFrame(rows, "face long, v array<double>, slide long, owner long")
    got = {r.face: (r.owner, r.first) for r in sequence.cluster_items(df, "face", "v", "slide", "owner", max_rounds=3).collect()}
    assert got == {i: (7, 0) for i in range(41)} | {i: (None, i) for i in (41, 42, 43)}
    pick = random.Random(5)
    faces = [(i, [pick.gauss(0, 1) for _ in range(6)], pick.randrange(60), pick.choice([None] * 9 + [1, 2])) for i in range(160)]
    faces = [(i, [x / math.hypot(*v) for x in v], s, o) for i, v, s, o in faces]
    df, bars = spark.createDataFrame(faces, "face long, v array<double>, slide long, owner long"), spark.createDataFrame([(i, 1 + i % 2) for i in range(0, 160, 3)], "face long, owner long")
    shown = lambda **how: sorted(map(str, sequence.cluster_items(df, "face", "v", "slide", "owner", bars, 0.6, **how).collect()))
    assert shown() == shown(block_rows=50, part_rows=20)


def test_a_group_to_which_many_turn(spark):
    """Groups to which more turn than a part has take in a part of them in a round, not the few that all are told."""
    hub = [(i, [1.0] + [0.0] * 150, i, 7) for i in range(800)]
    fans = [(1000 + i, [c] + [0.0] * i + [(1 - c * c) ** 0.5] + [0.0] * (149 - i), 1000 + i, None) for i in range(150) for c in [0.5 + i * 1e-3]]
    df = spark.createDataFrame(hub + fans, "face long, v array<double>, slide long, owner long")
    got = sequence.cluster_items(df, "face", "v", "slide", "owner", None, 0.45, max_rounds=10, block_rows=100, part_rows=40)
    assert {(r.owner, r.first) for r in got.collect()} == {(7, 0)} and got.count() == 950


def test_likest_of_two_blocks():
    """The likest of both sides, whatever pieces the products come in, with copies, crowded slides and refusals, to the last bit."""
    pick = np.random.default_rng(4)
    for case in range(12):
        n, same, k = int(pick.integers(1, 130)), case % 3 == 0, int(pick.integers(1, 9))
        v = pick.normal(size=(n, 5)) / 3
        v[pick.random(n) < 0.4] = v[0]
        names = [f"{'o' if pick.random() < 0.2 else 'i'}{i}" for i in pick.permutation(n)]
        at, never = ([sorted({int(x) for x in pick.integers(0, m, pick.integers(0, 3))}) for _ in range(n)] for m in (40, n))
        rows = {"one": [0] * n, "two": [0 if same else 1] * n, "right": [not same and bool(pick.random() < 0.5) for _ in range(n)], "g": names, "s": [(x * 3).tolist() for x in v], "n": [3] * n, "at": at}
        rows = pa.table(rows | {"never": pa.array([[names[x] for x in some if names[x][0] == "o"] for some in never], pa.list_(pa.string()))})
        want, mean, groups = [], np.array(rows.column("s").to_pylist()) / 3.0, sequence._Groups(rows)
        for i in range(n):
            like = [(float(np.einsum("j,ij->i", mean[i], mean[j : j + 1])[0]), names[j]) for j in range(n) if j != i and (same or rows["right"][i] != rows["right"][j])]
            like = [x for x in like if x[0] >= 0.1 and groups.may(i, groups, names.index(x[1])) and not names[i][0] == x[1][0] == "o"]
            want += [(names[i], h, x) for x, h in sorted(like, reverse=True)[:k]]
        for crowd, tile, together in ((256, (512, 4096), 1 << 20), (2, (8, 16), 20), (256, (3, 5), 1)):
            with pytest.MonkeyPatch.context() as held:
                held.setattr(sequence, "CROWD", crowd)
                assert sorted(tuple(r.values()) for r in sequence._likest(k, 0.1, tile, together)(rows).to_pylist()) == sorted(want)


def test_folders_are_listed_by_tasks(spark, tmp_path):
    """The driver sees the files of the folder itself and the folders in it, not what these hold; all files are read, in folders of any depth."""
    from loomline.sources import headers

    names = ["a.tif", ".hid.tif", "b.txt"] + [f"{d}/p{i}.tif" for d in ("x", "y/z", "y") for i in range(300)] + ["x/.hid.tif", "x/n.txt"]
    headers.write_files(spark.createDataFrame([(n, headers.header_bytes({"make": n, "iso": len(n)})) for n in names], "name string, content binary"), str(tmp_path / "f"))
    (tmp_path / "f" / "empty").mkdir()
    dealt = headers._HeaderReader({"path": str(tmp_path / "f"), "endings": "tif"}, ["path"]).partitions()
    assert sum(len(p.files) for p in dealt) == 1 and len(dealt) == 4
    got = {r.make: r.iso for r in headers.picture_headers(spark, str(tmp_path / "f"), endings="tif").collect()}
    assert got == {n: len(n) for n in names if n.endswith(".tif") and ".hid" not in n}
