"""Exact numbers, planted vectors and properties of the library's own operators."""

import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.functions import dates, text, vectors
from loomline.operators import gazetteer, lifecycle, matching, neighbours, robust, sequence, temporal
from loomline.operators.components import connected_components


def near(base, cos, seed):
    """A unit vector at exactly this cosine from a unit vector."""
    rng = np.random.default_rng(seed)
    side = rng.normal(size=len(base))
    side -= (side @ base) * np.array(base)
    side /= np.linalg.norm(side)
    return (cos * np.array(base) + math.sqrt(1 - cos * cos) * side).tolist()


def unit(seed, n=16):
    v = np.random.default_rng(seed).normal(size=n)
    return (v / np.linalg.norm(v)).tolist()


def test_pace_with_a_break(spark):
    """Thirty-one minutes of work, a break of three hours that counts ten minutes, then eleven more points."""
    t = [60 * i for i in range(31)] + [30 * 60 + 3 * 3600 + 60 * i for i in range(11)]
    rows = spark.createDataFrame([("a", i, x * 1_000_000) for i, x in enumerate(t)] + [("b", 0, 0), ("b", 1, 60_000_000)], "k string, i long, t long")
    got = {r.k: r for r in temporal.pace(rows, ["k"], "t", "i").collect()}
    hours = (40 * 60 + 600) / 3600
    assert math.isclose(got["a"].active_us / 3.6e9, hours) and math.isclose(got["a"].rate, 41 / hours) and got["b"].rate is None


def test_calibration_numbers(spark):
    """Ten people all seen older than they are; one wild sample moves little."""
    rows = [(f"p{i}", 1.15 * a + 1.1, float(a), 1.0) for i in range(10) for a in (5 + i, 20 + i, 40 + i)]
    schema = "p string, guess double, real double, weight double"
    common, _ = robust.calibrate(spark.createDataFrame(rows, schema), "p", "guess", "real", "weight")
    first = common.first()
    assert first.bias < -0.1 and first.n == 30
    wild, _ = robust.calibrate(spark.createDataFrame([*rows, ("p0", 70.0, 2.0, 1.0)], schema), "p", "guess", "real", "weight")
    assert abs(wild.first().bias - first.bias) < 0.02


def test_inverse_variance_and_consensus(spark):
    v, sd = robust.inverse_variance(F.col("v"), F.col("s"))
    r = spark.createDataFrame([(1980.0, 1.0), (1984.0, 2.0)], "v double, s double").agg(v.alias("v"), sd.alias("sd")).first()
    assert math.isclose(r.v, 1980.8) and math.isclose(r.sd, math.sqrt(1 / 1.25))
    rows = [("a", 0, 10.0, 1.0), ("a", 1, 11.0, 1.0), ("a", 2, 50.0, 0.1), ("b", 0, 1.0, 1.0), ("b", 1, 100.0, 0.5), ("c", 0, None, 1.0)]
    got = {r.k: (r.v, r.members) for r in robust.consensus(spark.createDataFrame(rows, "k string, o int, v double, s double"), ["k"], "o", "v", "s").collect()}
    assert got == {"a": (10.5, [0, 1]), "b": (100.0, [1])}


def test_weighted_median_half_way(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 1.0), ("b", 1.0, 1.0), ("b", 2.0, 5.0), ("c", None, 1.0), ("d", 4.0, 2.0)], "k string, v double, w double")
    assert {r.k: r.median for r in robust.weighted_median(rows, ["k"], F.col("v"), F.col("w")).collect()} == {"a": 2.0, "b": 2.0, "d": 4.0}


def test_dates(spark):
    rows = spark.createDataFrame([("1978",), ("1978-6",), ("1978/13/40",), ("1978-02-30",), ("x",), (None,)], "t string")
    d = dates.parse_date(F.col("t"))
    got = [(str(r.s) if r.s else None, r.p) for r in rows.select(d["start"].alias("s"), d["precision"].alias("p")).collect()]
    assert got == [("1978-01-01", 1), ("1978-06-01", 2), ("1978-12-31", 3), (None, None), (None, None), (None, None)]
    s = spark.sql("SELECT date'1978-01-01' AS d").select(dates.span(F.col("d"), F.lit(1)).alias("s")).first().s
    assert math.isclose(s.v, 1978.5) and math.isclose(s.sd, 1 / math.sqrt(12))


def test_text(spark):
    row = spark.createDataFrame([("Ærø  Straße, Łódź!", "a  cat,", "48.2, 16.37")], "a string, b string, c string")
    r = row.select(text.fold(F.col("a")).alias("fold"), text.tidy(F.col("b")).alias("tidy"), text.parse_coords(F.col("c")).alias("c"), text.slugify(F.lit("Zürich & Co")).alias("slug"), text.label(F.lit("a"), F.lit(""), F.lit("a"), F.lit("b")).alias("label")).first()
    assert (r.tidy, r.c.lat, r.c.lon, r.slug, r.label) == ("A cat.", 48.2, 16.37, "zürich-co", "a, b") and "strasse lodz" in r.fold


def test_band_pairs_at_exact_cosines(spark):
    a = unit(1)
    v = [a, near(a, 0.95, 2), unit(3), unit(4), near(a, 0.99, 5)]
    rows = spark.createDataFrame([("t", i, x) for i, x in enumerate(v)] + [("u", 0, a), ("t", 9, None)], "t string, pos long, v array<double>").withColumn("id", F.col("pos"))
    got = {(r.a, r.b): round(r.cos, 9) for r in sequence.band_pairs(rows, ["t"], "pos", "id", "v", 0.93).collect()}
    assert got.pop((0, 1)) == 0.95 and set(got) == {(1, 4)}  # 0 and 4 are alike but too far apart


def test_scenes_and_groups(spark):
    a, b = unit(1), unit(2)
    rows = [("t", i, near(a, 0.99, 100 + i)) for i in range(5)] + [("t", 5, unit(9))] + [("t", 6, near(a, 0.99, 106))] + [("t", 7 + i, near(b, 0.99, 120 + i)) for i in range(4)]
    df = spark.createDataFrame(rows, "t string, pos long, v array<double>")
    assert [(r.first_pos, r.last_pos) for r in sequence.scenes(df, "t", "pos", "v").orderBy("scene").collect()] == [(0, 6), (7, 10)]
    held = df.withColumn("item", F.col("pos"))
    groups = [r.group for r in sequence.group_sequence(held, "t", "pos", "item", "v").orderBy("item").collect()]
    assert groups == [0, 0, 0, 0, 0, 1, 2, 3, 3, 3, 3]


def one_by_one(v, owner, slides, rejected, least):
    """Average linkage by its definition: of all pairs of groups that may merge, the likest; until none is like enough."""
    groups = [[i for i in range(len(v)) if owner[i] == o] for o in sorted({o for o in owner if o is not None})] + [[i] for i in range(len(v)) if owner[i] is None]
    held = lambda g: {owner[i] for i in g if owner[i] is not None}
    while True:
        best = (least, None)
        for x in range(len(groups)):
            for y in range(x):
                a, b = groups[x], groups[y]
                if held(a) and held(b) or {slides[i] for i in a} & {slides[i] for i in b} or any((i, o) in rejected for g, h in ((a, b), (b, a)) for i in g for o in held(h)):
                    continue
                like = float(np.mean(v[a] @ v[b].T))
                if like >= best[0]:
                    best = (like, (x, y))
        if best[1] is None:
            return {i: (next(iter(held(g)), None), min(g)) for g in groups for i in g}
        x, y = best[1]
        groups[y] = groups[y] + groups.pop(x)


def test_clusters_of_the_whole_table_like_one_by_one(spark):
    rows, bars, want = [], [], {}
    for case in range(3):  # collections far apart, so that each can be clustered alone
        rng = np.random.default_rng(case)
        n, at = 24, 100 * case
        base = rng.normal(size=(4, 8))
        v = base[rng.integers(0, 4, n)] + rng.normal(size=(n, 8)) * 0.5
        v = np.concatenate([np.zeros((n, 8 * case)), v / np.linalg.norm(v, axis=1)[:, None], np.zeros((n, 16 - 8 * case))], axis=1)
        owner = [10 * case + int(rng.integers(0, 2)) if rng.random() < 0.25 else None for _ in range(n)]
        slides = (rng.integers(0, 9, n) + at).tolist()
        rejected = {(i, 10 * case + int(rng.integers(0, 2))) for i in range(n) if owner[i] is None and rng.random() < 0.3}
        want |= {at + i: (o, at + first) for i, (o, first) in one_by_one(v, owner, slides, rejected, 0.363).items()}
        rows += [(at + i, v[i].tolist(), slides[i], owner[i]) for i in range(n)]
        bars += [(at + i, o) for i, o in rejected]
    rows.append((999, None, 1, None))
    df = spark.createDataFrame(rows, "face long, v array<double>, slide long, owner long")
    got = {r.face: (r.owner, r.first) for r in sequence.cluster_items(df, "face", "v", "slide", "owner", spark.createDataFrame(bars, "face long, owner long")).collect()}
    assert got == want | {999: (None, 999)} and len({x for x in got.values()}) < 50
    pairs = {(r.a, r.b) for r in sequence.similar_pairs(df, "face", "v", 0.5, block_rows=10).collect()}
    v = {r[0]: np.array(r[1]) for r in rows if r[1]}
    assert pairs == {(a, b) for a in v for b in v if a < b and v[a] @ v[b] >= 0.5}


def swept(faces, near=3):
    """The passing on of names by its definition: sweeps over all pairs, the best fit first, until one changes nothing."""
    def fit(f, a):
        cos = float(np.dot(f["v"], a["v"])) if a["v"] is not None else None
        dress = float(np.sqrt(np.multiply(f["dress"], a["dress"])).sum()) if f["dress"] and a["dress"] else None
        if cos is not None and cos >= 0.363:
            return cos + (dress or 0)
        if dress is not None and (dress >= 0.9 if cos is None else dress >= 0.8 and cos >= 0.2):
            return (cos or 0) + dress
    pairs = [(fit(f, a), f, a) for f in faces for a in faces if not f["sure"] and f["v"] is not None and 0 < abs(f["pos"] - a["pos"]) <= near]
    pairs = sorted((p for p in pairs if p[0] is not None), key=lambda p: (-p[0], p[1]["pos"], p[1]["id"], p[2]["pos"], p[2]["id"]))
    now = {f["id"]: (f["person"], f["known"], f["ignored"]) for f in faces}
    there = {}
    for f in faces:
        there.setdefault(f["pos"], set()).add(f["person"])
    while True:
        before = dict(now)
        for _, f, a in pairs:
            person, known, ignored = now[a["id"]]
            if known and not ignored and person is not None and not (now[f["id"]][1] or now[f["id"]][2]) and person not in f["rejected"] and person not in there[f["pos"]]:
                now[f["id"]] = (person, True, False)
                there[f["pos"]].add(person)
        if now == before:
            return {i: p for i, (p, _, _) in now.items()}


def test_names_spread_like_sweeps(spark):
    a = unit(1)
    face = lambda i, pos, v, person=None, **kw: {"t": "t", "id": i, "pos": pos, "v": v, "dress": None, "person": person, "known": person == 7, "sure": False, "ignored": False, "rejected": []} | kw
    trays = [[face(0, 0, a, 7), face(1, 2, near(a, 0.9, 2)), face(2, 5, near(a, 0.9, 2)), face(3, 5, near(a, 0.8, 3)), face(4, 20, a), face(5, 1, near(a, 0.9, 4), rejected=[7])]]
    for case in range(12):
        rng = np.random.default_rng(case)
        base = [unit(50 + k) for k in range(3)]
        held = []
        for i in range(30):
            person = int(rng.integers(1, 5)) if rng.random() < 0.4 else None
            dress = rng.dirichlet(np.ones(4) * 0.6).tolist() if rng.random() < 0.7 else None
            v = near(base[rng.integers(0, 3)], float(rng.choice([0.6, 0.8, 0.9])), 1000 * case + i) if rng.random() < 0.85 else None
            known = person is not None and person < 4
            held.append({"t": f"c{case}", "id": 100 * case + 200 + i, "pos": int(rng.integers(0, 14)), "v": v, "dress": dress, "person": person, "known": known, "sure": bool(rng.random() < 0.1), "ignored": person == 3, "rejected": rng.integers(1, 4, 1).tolist() if rng.random() < 0.3 else []})
        trays.append(held)
    want = {}
    for held in trays:
        want |= swept(held)
    df = spark.createDataFrame([tuple(f.values()) for held in trays for f in held], "t string, id long, pos long, v array<double>, dress array<double>, person long, known boolean, sure boolean, ignored boolean, rejected array<long>")
    got = {r.id: r.person for r in sequence.spread_names(df, "t", "id", "pos", "v", "person", "dress", "sure", "known", "ignored", "rejected").collect()}
    assert got == want and [want[i] for i in range(6)] == [7, 7, None, 7, None, None]
    assert sum(f["person"] != want[f["id"]] for held in trays for f in held) > 20


def test_greedy_pairs(spark):
    rows = spark.createDataFrame([("x", 1, 1, 0.9), ("x", 1, 2, 0.8), ("x", 2, 1, 0.7), ("x", 2, 2, 0.2), ("y", 1, 1, 0.3)], "k string, a int, b int, s double")
    assert sorted((r.k, r.a, r.b) for r in sequence.greedy_pairs(rows, "k", "a", "b", F.col("s")).collect()) == [("x", 1, 1), ("y", 1, 1)]


def test_components_of_a_long_chain(spark):
    rng = random.Random(1)
    names = list(range(200))
    rng.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(99)] + [(names[i], names[i + 1]) for i in range(100, 199)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[n] == min(names[:100]) for n in names[:100]) and all(got[n] == min(names[100:]) for n in names[100:])
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_nearest_keeps_ties_in_order(spark):
    examples = spark.createDataFrame([(i, "k" if i < 3 else "e", [float(i // 2), 1.0]) for i in range(10)], "n long, s string, f array<double>")
    got = neighbours.nearest(spark.createDataFrame([(1, [0.0, 1.0])], "q long, f array<double>"), examples, "q", "n", "f", k=3).orderBy("rank").collect()
    assert [r.n for r in got] == [0, 1, 2] and got[0].distance == 0


CITIES = [(1, "Venice", ["Venezia"], 45.44, 12.33, 51_000), (2, "Venice", [], 27.1, -82.45, 22_000), (3, "Dayton", ["Venice"], 39.76, -84.19, 140_000), (4, "Florence", ["Firenze"], 43.77, 11.25, 349_000), (5, "Innsbruck", [], 47.26, 11.39, 112_000), (6, "Bar", [], 42.09, 19.1, 13_000), (7, "Suva", [], -18.14, 178.44, 77_000)]


def test_gazetteer(spark):
    cities = spark.createDataFrame(CITIES, "city_id long, name string, alts array<string>, lat double, lon double, pop long")
    keys = gazetteer.city_keys(cities)
    asked = spark.createDataFrame([(1, "venice"), (2, "fir"), (3, "x")], "q long, t string")
    got = {}
    for r in gazetteer.prefix_search(asked, keys, "q", "t").orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.city_id)
    assert got == {1: [1, 2, 3], 2: [4]}
    points = spark.createDataFrame([(1, 45.5, 12.4), (2, 0.0, 0.0), (3, -18.2, -179.9), (4, None, 1.0)], "p long, lat double, lon double")
    found = {r.p: r.city_id for r in gazetteer.nearest_city(points, cities, "p", "lat", "lon", 200.0).collect()}
    assert found == {1: 1, 3: 7}
    lines = spark.createDataFrame([(1, "Greetings from Venice"), (2, "Via Florence 3"), (3, "Innsbruck 1975"), (4, "Bar"), (5, "nothing here"), (6, None)], "l long, t string")
    two = spark.createDataFrame([("s", 1, "WELCOME TO", 0.9), ("s", 2, "VENICE", 0.8), ("t", 1, "x", 1.0)], "s string, n int, t string, c double")
    joined = gazetteer.with_line_pairs(two, "s", "n", "t", "c")
    assert [(r.s, r.city_id, round(r.confidence, 4)) for r in gazetteer.places_in_text(joined.withColumnRenamed("c", "ocr"), keys, "s", "t", F.col("ocr")).collect()] == [("s", 1, round(0.9 * 0.8 * (0.5 + 0.5 * 51 / 73), 4))]
    text_found = {r.l: (r.city_id, round(r.confidence, 4)) for r in gazetteer.places_in_text(lines, keys, "l", "t").collect()}
    assert text_found[1] == (1, round(0.9 * (0.5 + 0.5 * 51 / 73), 4)) and text_found[3] == (5, 0.6) and set(text_found) == {1, 3}


def test_places_and_folded_words_of_all_lines(spark, tmp_path):
    from loomline.plans import places

    texts = [(1, "one venezia\nnothing\nGreetings from\nvenezia today"), (2, "x\n" + "word " * 40 + "\nGreetings from Venezia"), (3, None), (4, "plain"), (5, "a bologna\n\nb venezia\nin bologna")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.confidence for r in places.places_in_text(spark, str(tmp_path)).collect()}
    assert got == {1: 0.9, 2: 0.9, 5: 0.6}
    folded = {(r.doc_id, r.line_no): r.folded for r in places.folded_sources(spark, str(tmp_path)).collect()}
    assert len(folded) == 13 - 1 and folded[2, 1] == " ".join(["word"] * 40) and folded[1, 3] == "venezia today" and folded[5, 1] == ""


def test_queries_over_all_rows(spark):
    """Every order, person and prefix has its rows."""
    from loomline.plans import lifecycle as plans
    from loomline.plans import matching as cards
    from loomline.plans import places

    sf = "/root/testdata/sf0.001"
    count = lambda name, c: spark.read.parquet(f"{sf}/{name}.parquet").select(c).distinct().count()
    assert plans.array_edits(spark, sf).groupBy("tray").count().count() == spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("floor(l_orderkey / 50)").distinct().count()
    assert sorted(r.place for r in cards.person_cards(spark, sf).collect()) == list(range(1, count("customer", "c_custkey") + 1))
    assert places.prefix_search(spark, sf).select("p_partkey").distinct().count() == count("part", "p_partkey")


def test_merge_keeps_rows_of_each_side(spark):
    s = "id long, v string"
    raw = spark.createDataFrame([(1, "raw"), (2, "raw"), (3, "raw"), (6, "raw")], s)
    base = spark.createDataFrame([(1, "base"), (2, "base"), (4, "base"), (3, "base")], s)
    new = spark.createDataFrame([(1, "base"), (2, "new"), (5, "new")], s)
    assert sorted(tuple(r) for r in lifecycle.three_way_merge(raw, base, new, ["id"], ["v"]).collect()) == [(1, "raw"), (2, "new"), (5, "new"), (6, "raw")]


def test_undo_and_redo(spark):
    rows = [("k", i, a, v) for i, (a, v) in enumerate([("edit", "1"), ("edit", "2"), ("undo", None), ("undo", None), ("redo", None), ("edit", "3"), ("redo", None)])]
    r = lifecycle.undo_redo(spark.createDataFrame(rows, "k string, i long, a string, v string"), "k", "i", "a", "v").first()
    assert (r.v, r.undos, r.redos) == ("3", 2, 0)


def test_undo_and_redo_walk_the_batches(spark):
    """Keys over many batches and several keys in one; no group goes whole into one call."""
    rows = [(k, i, ("undo" if i % 4 == 0 else "redo" if i % 9 == 0 else "edit"), f"{k}{i}") for k in ("a", "b", None) for i in range(1, 26)]
    rows += [("c", 2, "undo", None), ("c", 1, "edit", "1")]
    want = {}
    for k, _, a, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        now, undo, redo = want.get(k, ("", [], []))
        if a == "edit":
            now, undo, redo = v, [*undo, now], []
        elif a == "undo" and undo:
            now, undo, redo = undo[-1], undo[:-1], [*redo, now]
        elif a == "redo" and redo:
            now, undo, redo = redo[-1], [*undo, now], redo[:-1]
        want[k] = now, undo, redo
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = lifecycle.undo_redo(spark.createDataFrame(rows, "k string, i long, a string, v string"), "k", "i", "a", "v")
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
        assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(str((k, n, len(u), len(r))) for k, (n, u, r) in want.items())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_interval_join_across_months(spark):
    from datetime import date

    points = spark.createDataFrame([(1, date(2020, 1, 31)), (2, date(2020, 2, 1)), (3, date(2020, 3, 1))], "p long, d date")
    windows = spark.createDataFrame([("a", date(2020, 1, 31), date(2020, 3, 1)), ("b", date(2020, 3, 1), date(2020, 3, 2))], "w string, lo date, hi date")
    assert sorted((r.p, r.w) for r in matching.interval_join(points, "d", windows, "lo", "hi").collect()) == [(1, "a"), (2, "a"), (3, "b")]


def test_turned_box_four_times(spark):
    box = [F.lit(0.1), F.lit(0.2), F.lit(0.4), F.lit(0.9)]
    for _ in range(4):
        box = vectors.turned_box(box, F.lit(90), F.lit(False))
    r = spark.range(1).select(*[b.alias(n) for b, n in zip(box, "abcd")]).first()
    assert np.allclose([r.a, r.b, r.c, r.d], [0.1, 0.2, 0.4, 0.9])
