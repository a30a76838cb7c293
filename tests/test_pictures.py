import random

import pytest
from pyspark.sql import functions as F

from loomline.functions import curves
from loomline.operators import grid


def flood(cells, reach):
    left, found = set(cells), []
    while left:
        todo, mark = [min(left, key=lambda c: (c[1], c[0]))], set()
        left.discard(todo[0])
        while todo:
            x, y = todo.pop()
            mark.add((x, y))
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    c = (x + dx, y + dy)
                    if c in left and (reach or not dx or not dy):
                        left.discard(c)
                        todo.append(c)
        found.append(mark)
    return found


@pytest.mark.parametrize("diagonal", [True, False])
def test_marks_like_a_flood(spark, diagonal):
    """Random pictures, a long snake over many tiles, negative places; tiles of four cells."""
    pick = random.Random(3)
    pictures = {"a": {(pick.randrange(23), pick.randrange(19)) for _ in range(150)}, "b": {(x, 0 if x % 8 < 4 else 7) for x in range(-20, 20)} | {(x, y) for x in range(-17, 20, 4) for y in range(8)}, None: {(4, 4)}}
    flags = {(k, c): pick.random() < 0.1 for k, v in pictures.items() for c in v}
    rows = [(k, *c, flags[k, c]) for k, v in pictures.items() for c in v]
    cells = spark.createDataFrame(rows + rows[:40] + [("a", None, 1, True)], "p string, x int, y int, f boolean")
    got = grid.marks(grid.labelled_runs(cells, ["p"], "f", diagonal, tile=4), ["p"]).collect()
    want = []
    for k, v in pictures.items():
        for m in flood(v, diagonal):
            first = min((y, x) for x, y in m)
            xs, ys = [x for x, _ in m], [y for _, y in m]
            want.append((k, *first, len(m), min(xs), min(ys), max(xs), max(ys), any(flags[k, c] for c in m)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_no_cells(spark):
    none = spark.createDataFrame([], "p string, x int, y int")
    assert grid.marks(grid.labelled_runs(none, ["p"]), ["p"]).collect() == []


def test_box_sums_like_direct_sums(spark):
    pick = random.Random(5)
    sizes = {"a": (11, 9), "b": (4, 4), "c": (0, 3)}
    values = [(k, pick.randrange(w + 2), pick.randrange(h + 1), pick.choice([-2, 1, 5, None])) for k, (w, h) in sizes.items() for _ in range(60)]
    boxes = [(i, pick.choice("abcd"), *(pick.choice([None] + list(range(-3, 14)) * 2) for _ in range(4))) for i in range(300)]
    v = spark.createDataFrame(values, "p string, x int, y int, v long")
    s = spark.createDataFrame([(k, *wh) for k, wh in sizes.items()], "p string, width int, height int")
    b = spark.createDataFrame(boxes, "box int, p string, left int, top int, right int, bottom int")
    table = grid.prefix_sums(v, s, ["p"], "v", tile=4)
    assert table.count() == sum(w * h for w, h in sizes.values())
    want = []
    for i, p, left, top, right, bottom in boxes:
        w, h = sizes.get(p, (0, 0))
        inside = set() if None in (left, top, right, bottom) else {(x, y) for x in range(max(left, 0), min(right, w - 1) + 1) for y in range(max(top, 0), min(bottom, h - 1) + 1)}
        want.append((i, len(inside), sum(n for k, x, y, n in values if k == p and (x, y) in inside and n is not None)))
    assert sorted(map(tuple, grid.box_sums(table, s, b, ["p"], ["box"]).collect())) == want


def plain_curve(points, x):
    """The smooth curve by its definition, piece by piece."""
    xs, ys = zip(*points)
    n = len(xs)
    d = [(ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) for i in range(n - 1)]
    m = [d[0]] + [0 if d[i - 1] * d[i] <= 0 else (d[i - 1] + d[i]) / 2 for i in range(1, n - 1)] + [d[-1]]
    for i, r in enumerate(d):
        far = (m[i] ** 2 + m[i + 1] ** 2) ** 0.5
        if r == 0:
            m[i] = m[i + 1] = 0
        elif far > 3 * abs(r):
            m[i], m[i + 1] = 3 * abs(r) / far * m[i], 3 * abs(r) / far * m[i + 1]
    if x <= xs[0] or x >= xs[-1]:
        return ys[0] if x <= xs[0] else ys[-1]
    i = max(k for k in range(n - 1) if xs[k] <= x)
    w, u = xs[i + 1] - xs[i], (x - xs[i]) / (xs[i + 1] - xs[i])
    y = (2 * u**3 - 3 * u**2 + 1) * ys[i] + (u**3 - 2 * u**2 + u) * w * m[i] + (3 * u**2 - 2 * u**3) * ys[i + 1] + (u**3 - u**2) * w * m[i + 1]
    return min(max(y, 0), 1)


def test_smooth_curves(spark):
    """As defined; within the range of the points around, and never turning back between them."""
    pick = random.Random(7)
    rows = []
    for k in range(60):
        xs = sorted(pick.sample(range(101), pick.randrange(2, 9)))
        rows.append((k, [(x / 100, pick.choice([0.0, 1.0, pick.random()])) for x in xs]))
    rows += [(100, [(0.5, 0.5)]), (101, []), (102, None)]
    kind = "k int, p array<struct<x: double, y: double>>"
    got = {r.k: r.t for r in spark.createDataFrame(rows, kind).select("k", curves.curve_table(F.col("p"), 129).alias("t")).collect()}
    assert got[100] is None and got[101] is None and got[102] is None
    for k, points in rows[:60]:
        assert got[k] == pytest.approx([plain_curve(points, i / 128) for i in range(129)], abs=1e-12)
        for (x0, y0), (x1, y1) in zip(points, points[1:]):
            inside = [got[k][i] for i in range(129) if x0 <= i / 128 <= x1]
            assert all((b - a) * (y1 - y0) >= -1e-12 for a, b in zip(inside, inside[1:]))
            assert all(min(y0, y1) - 1e-12 <= y <= max(y0, y1) + 1e-12 for y in inside)


def test_toned(spark):
    table = spark.createDataFrame([([0.0, 0.5, 0.7, 1.0], v) for v in (-1.0, 0.0, 0.16, 0.17, 0.9, 2.0, None)], "t array<double>, v double")
    assert [r[0] for r in table.select(curves.toned(F.col("t"), F.col("v"))).collect()] == [0.0, 0.0, 0.0, 0.5, 1.0, 1.0, None]
