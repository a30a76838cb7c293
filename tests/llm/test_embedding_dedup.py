import numpy as np
import pytest

from loomline.llm import embedding_dedup as E


def planted(seed=3, n=260, d=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = rng.normal(size=d)
        label = int(rng.integers(0, 3))
        rows.append((i, base.tolist(), label))
        for k in range(rng.choice([0, 0, 1, 3])):
            base = base + rng.normal(size=d) * np.linalg.norm(base) * rng.choice([0.0, 0.02, 0.045, 0.06]) / np.sqrt(d) * 4
            rows.append((10_000 - 5 * i - k, base.tolist(), label if rng.random() < 0.9 else None))
    rows += [(20_000, None, 1), (20_001, [0.0] * d, 1), (20_002, [float("nan")] * d, 1), (20_003, [None] * d, 1), (20_004, [], 1), (20_005, [1.0] * (d - 1), 1), (20_006, [float("inf")] + [1.0] * (d - 1), 1)]
    rows += [(20_010, rows[0][1], rows[0][2]), (20_010, rows[0][1], rows[0][2]), (None, rows[0][1], rows[0][2]), (20_011, [3 * x for x in rows[0][1]], rows[0][2])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]
    return rows


def brute(rows):
    ok = [v is not None and len(v) > 0 and k is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, k in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                near[i, j] = near[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98
    label = list(range(n))
    for i, j in zip(*np.nonzero(near)):
        x, y = sorted((label[i], label[j]))
        if x != y:
            label = [x if v == y else v for v in label]
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        first = min(ids, default=None)
        out.append((rows[i][0], int(near[i].sum()), first, rows[i][0] == first))
    return sorted(out, key=str)


def test_like_brute_force(spark):
    rows = planted()
    table = spark.createDataFrame([(*r, 9, "c") for r in rows], "vec_id long, embedding array<float>, label int, n long, node string")
    want = brute(rows)
    assert sum(w[1] for w in want) > 150
    for block_rows in (16, 2048):
        assert sorted((tuple(r) for r in E.near_duplicates(table, block_rows=block_rows).collect()), key=str) == want


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    rows = [(i, (base + rng.normal(size=64) * 0.11).tolist(), 0) for i in range(150)] + [(500 + i, base.tolist(), 0) for i in range(40)]
    rows = [(i, [float(np.float32(x)) for x in v], k) for i, v, k in rows]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted((tuple(r) for r in E.near_duplicates(table, block_rows=32).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("block_rows", [1, 2, 3, 4])
def test_parts_that_are_empty(spark, block_rows):
    """Blocks of a few rows are dealt into many parts, some empty; each pair still counts once."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=32)
    rows = [(i, [float(np.float32(x)) for x in base + rng.normal(size=32) * 0.02], 0) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted((tuple(r) for r in E.near_duplicates(table, block_rows=block_rows).collect()), key=str) == brute(rows)


def test_blocks_beyond_their_numbers(spark):
    with pytest.raises(ValueError, match="16-bit"):
        E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), block_rows=1 << 16)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    for d in (2, 8, 64, 300):
        a = rng.normal(size=(4000, d))
        a /= np.linalg.norm(a, axis=1)[:, None]
        side = rng.normal(size=(4000, d))
        side -= (side * a).sum(axis=1)[:, None] * a
        side /= np.linalg.norm(side, axis=1)[:, None]
        c = 0.98 + 1e-9
        b = c * a + np.sqrt(1 - c * c) * side
        window, _, least = E.calibrated(d)
        turn = E.directions(d)
        met = (np.abs((a - b) @ turn) <= window).sum(axis=1)
        assert (met < least).sum() == 0


def planted_at(c, n, d, rng):
    a = rng.normal(size=(n, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=(n, d))
    side -= (side * a).sum(axis=1)[:, None] * a
    return a, c * a + np.sqrt(1 - c * c) * side / np.linalg.norm(side, axis=1)[:, None]


def test_cuts_part_no_pair_and_own_it_once():
    """Pairs at the threshold among many vectors: each is owned by one leaf, but for few that a cut parts; and counting rejects the rest."""
    rng = np.random.default_rng(4)
    a, b = planted_at(0.98 + 1e-9, 20_000, 64, rng)
    on = E.projected(np.concatenate([a, b]))
    tree = E.Cuts.grown(on[::16], E.calibrated(64)[1], 64)
    owned = np.zeros(len(a), int)
    copies = 0
    for _, rows, copied in tree.leaves(on):
        copies += len(rows)
        here = np.full(len(on), -1, np.int64)
        here[rows] = copied
        both = (here[: len(a)] >= 0) & (here[len(a) :] >= 0)
        owned += both & ((here[: len(a)] & here[len(a) :]) == 0)
    assert owned.max() == 1 and (owned == 0).mean() < 0.002
    assert copies < 8 * len(on) and len(tree.axis) > 20
    window, _, least = E.calibrated(64)
    assert ((np.abs(on[:5000] - on[5000:10_000]) <= window).sum(axis=1) >= least).mean() < 0.001


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
