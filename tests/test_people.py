"""Checks of values and of people operators on small planted cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from loomline.functions import checks
from loomline.operators import matching, neighbours, people, robust, sequence


def unit(*v):
    return (np.array(v) / np.linalg.norm(v)).tolist()


def test_checks(spark):
    curve = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])
    r = spark.range(1).select(
        checks.clean_curve(curve((1, 1), (0, 0))).alias("diagonal"), checks.clean_curve(curve((2, 1), (0.5, 0.7), (0.502, 0.1), (-1, 0))).alias("kept"),
        checks.rotation_vote(F.lit(1), F.lit(8), F.lit(0), F.lit(0)).alias("turn"), checks.rotation_vote(F.lit(5), F.lit(4), F.lit(0), F.lit(0)).alias("unsure"), checks.rotation_vote(F.lit(0), F.lit(0), F.lit(0), F.lit(0)).alias("none"),
        checks.clean_place(F.lit(" "), F.lit(1.0), F.lit(2.0), F.lit(None).cast("string")).alias("place"), checks.clean_place(F.lit("x"), F.lit(float("nan")), F.lit(2.0), F.lit("")).alias("bad"),
        checks.clean_crop(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("whole"), checks.safe_id(F.lit("../x")).alias("safe"),
    ).first()
    assert r.diagonal is None and [(p.x, p.y) for p in r.kept] == [(0.0, 0.0), (0.502, 0.1), (1.0, 1.0)] or [(p.x, p.y) for p in r.kept] == [(0.0, 0.0), (0.5, 0.7), (1.0, 1.0)]
    assert (r.turn, r.unsure, r.none, r.bad, r.whole, r.safe) == (90, None, None, None, None, False)
    assert r.place.name == "1.0000, 2.0000" and r.place.country == ""


def test_reidentify(spark):
    old = spark.createDataFrame([("s", 0, unit(1, 0)), ("s", 2, unit(0, 1))], "slide string, number long, v array<double>")
    found = spark.createDataFrame([("s", 0, unit(0, 1)), ("s", 1, unit(1, 1)), ("s", 2, unit(1, 0.1)), ("t", 0, unit(1, 0))], "slide string, k long, v array<double>")
    got = {(r.slide, r.k): r.number for r in people.reidentify(found, old, "slide", "k", "v", "number").collect()}
    assert got == {("s", 0): 2, ("s", 1): 1, ("s", 2): 0, ("t", 0): 0}


def test_matches_like_taking_turns(spark):
    """Rounds of mutually best pairs give what taking pair after pair gives, ties and chains included; faces that take in turn too."""
    pick = random.Random(3)
    rows = [(k, a, b, pick.choice([0.1, 0.3, 0.5, 0.5, 0.9])) for k in "xyz" for a in range(12) for b in range(11) if pick.random() < 0.5]
    rows += [("chain", i, i + d, 1.0 - i / 50 - d / 100) for i in range(20) for d in (0, 1)] + [("x", None, 1, 0.9), (None, 1, 1, 0.9), ("x", 1, 1, None), ("x", 2, 2, float("nan")), ("z", 3, 3, 0.95), ("z", 3, 3, 0.2)]
    table = spark.createDataFrame(rows, "k string, a int, b int, s double")
    want = set()
    for k in {r[0] for r in rows if r[0]}:
        a_used, b_used = set(), set()
        for s, a, b in sorted((-r[3], r[1], r[2]) for r in rows if r[0] == k and None not in r and r[3] >= 0.3):
            if a not in a_used and b not in b_used:
                a_used.add(a), b_used.add(b), want.add((k, a, b, -s))
    assert {tuple(r) for r in sequence.greedy_pairs(table, "k", "a", "b", F.col("s")).collect()} == want
    likes = {(t, n): pick.choice([0.2, 0.81, 0.9, 0.95]) for t in range(9) for n in range(7)}
    faces = [("s", t, [likes[t, n] for n in range(7)]) for t in range(9)]
    old = [("s", n + 1, [float(i == n) for i in range(7)]) for n in range(7)]
    taken, order = {}, {}
    for t in range(9):
        left = [(-likes[t, n], n + 1) for n in range(7) if likes[t, n] >= 0.8 and n + 1 not in taken.values()]
        if left:
            taken[t] = min(left)[1]
    free = iter([0] + list(range(8, 30)))
    order = {t: taken[t] if t in taken else next(free) for t in range(9)}
    got = people.reidentify(spark.createDataFrame(faces, "slide string, k long, v array<double>"), spark.createDataFrame(old, "slide string, number long, v array<double>"), "slide", "k", "v", "number")
    assert {r.k: r.number for r in got.collect()} == order


def test_large_groups_meet_in_blocks(spark):
    """Blocks of a few members count the same pairs as one join of the whole group."""
    pick = random.Random(1)
    rows = [("all", m) for m in range(70)] + [(f"g{pick.randrange(9)}", pick.randrange(30)) for _ in range(80)] + [("all", None), (None, 3), ("one", 5)]
    df = spark.createDataFrame(rows + rows[:30], "g string, m int")
    want = {}
    for g in {g for g, _ in rows if g}:
        held = sorted({m for h, m in rows if h == g and m is not None})
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    for block in (3, 16, 1024):
        assert {(r.a, r.b): r.n for r in matching.cooccurrence(df, "g", "m", block).collect()} == want


def test_faces_on_slides(spark):
    faces = spark.createDataFrame([(1, "b", [0.5, 0.1], 0), (1, "a", [0.5, 0.1], 90), (1, "c", [0.1, 0.1], 0), (1, "d", None, 0), (1, "hid", [0.0, 0.0], 0), (2, "e", [0.3, 0.1], None), (9, "f", [0.1, 0.1], 0)], "slide int, face string, box array<double>, turn int")
    slides = spark.createDataFrame([(1, 0, "k1"), (2, None, None)], "slide int, turn int, look string")
    owners = spark.createDataFrame([("b", 7, None), ("hid", 8, True), ("c", 9, False)], "face string, person int, ignored boolean")
    got = [tuple(r) for r in people.faces_on_slides(faces, slides, owners, "slide", "face", "/%s?v=%s").orderBy("slide", "place").collect()]
    assert got == [(1, 1, "c", "/c?v=k1", [0.1, 0.1], 9), (1, 2, "a", "/a?v=k1", None, None), (1, 3, "b", "/b?v=k1", [0.5, 0.1], 7), (1, 4, "d", "/d?v=k1", None, None), (2, 1, "e", "/e?v=", [0.3, 0.1], None)]


def test_resuggested(spark):
    kind = "k int, open boolean, params map<string, double>, source string, undo array<struct<params: map<string, double>, what: string>>"
    step = ({"w": 0.0}, "edit")
    rows = [(1, True, {"w": 1.0, "f": 2.0}, "own", [step] * 3), (2, False, {"w": 1.0}, "own", []), (3, True, {"w": 1.0}, "own", None), (4, True, {"w": 1.0}, "own", []), (5, None, {"w": 1.0}, "own", []), (6, True, {"w": 1.0}, "own", None)]
    said = spark.createDataFrame([(1, {"w": 5.0, "g": 6.0}, 7), (2, {"w": 5.0}, 7), (3, {}, 0), (5, {"w": 5.0}, 7), (6, {"w": 5.0}, 2)], "k int, values map<string, double>, n long")
    got = {r.k: r for r in neighbours.resuggested(spark.createDataFrame(rows, kind), said, "k", most_undo=3).collect()}
    assert {k for k, r in got.items() if r.applied} == {1, 6} and len(got) == 6
    assert got[1].params == {"f": 2.0, "w": 5.0, "g": 6.0} and got[1].source == "learned:7" and [s.what for s in got[1].undo] == ["edit", "edit", "learned"] and got[1].undo[-1].params == {"w": 1.0, "f": 2.0}
    assert [s.what for s in got[6].undo] == ["learned"] and got[3].params == {"w": 1.0} and got[3].undo is None and got[2].source == "own"


def test_one_per_slide_keeps_the_sure(spark):
    rows = [("p", 1, 10, unit(1, 0), False), ("p", 1, 11, unit(0, 1), True), ("p", 2, 12, unit(1, 0.1), False), ("p", 3, 13, unit(1, 0), False), ("p", 3, 14, unit(0, -1), False)]
    got = people.one_per_slide(spark.createDataFrame(rows, "person string, slide long, face long, v array<double>, sure boolean"), "person", "slide", "face", "v", "sure")
    assert sorted(r.face for r in got.collect()) == [11, 12, 13]


def test_mean_curves(spark):
    s = "q long, curves map<string, array<struct<x: double, y: double>>>, w double"
    line = lambda *p: [(float(x), float(y)) for x, y in p]
    rows = [(1, {"all": line((0, 0.2), (1, 1))}, 1.0), (1, {"all": line((0, 0.4), (1, 1)), "red": line((0, 0), (1, 1))}, 1.0), (1, {"blue": line((0, 1), (1, 1))}, 0.1), (2, {}, 1.0)]
    got = {(r.q, r.channel): [round(x, 6) for x in r.curve] for r in neighbours.average_curves(spark.createDataFrame(rows, s), "q", "curves", F.col("w")).collect()}
    assert list(got) == [(1, "all")] and got[1, "all"][0] == round(0.6 / 2.1, 6) and got[1, "all"][-1] == 1.0


def test_robust_line_leaves_outliers_out(spark):
    rows = [("a", float(i), 2.0 * i + 1 + (50.0 if i == 7 else 0.0)) for i in range(20)]
    r = robust.robust_line(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").first()
    assert abs(r.slope - 2) < 1e-9 and abs(r.intercept - 1) < 1e-9 and r.n == 19


def test_years_of_slides(spark):
    """One slide with people, one with a neighbour, one whose prior contradicts, one without anything."""
    says = spark.createDataFrame([(1, 1980.0, 1.0), (3, 1990.0, 1.0)], "slide long, v double, sd double")
    priors = spark.createDataFrame([(1, 1981.0, 2.0, False, 1970, False), (2, None, None, False, None, False), (3, 1960.0, 1.0, False, 1960, False), (4, 1950.0, 1.0, False, 1950, False)], "slide long, v double, sd double, own boolean, shown int, skip boolean")
    near = spark.createDataFrame([(2, 1, 1)], "slide long, other long, dist long")
    got = {r.slide: r for r in people.slide_years(says, priors, near).collect()}
    assert set(got) == {1, 2, 3} and abs(got[1].y - 1980.2) < 1e-9 and not got[1].suggest
    assert got[2].y == 1980.0 and got[2].suggest and got[3].against and got[3].y == 1990.0 and got[3].suggest
