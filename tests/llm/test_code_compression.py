import hashlib

import numpy as np

from loomline.llm import code_compression as C


def brute(rows, parts=16, entries=64):
    """The codes by comparing every part with every entry, in Python's own integers."""
    kept = [(i, v, k) for i, v, k in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = {n: [int(np.floor(256 * x)) for x in v] for n, (_, v, _) in enumerate(kept)}
    small = {n for n, v in ints.items() if len(v) and len(v) % parts == 0 and all(abs(x) < C.MOST for x in v)}
    order = sorted(small, key=lambda n: (kept[n][0] is None, kept[n][0] or 0, kept[n][1]))
    first = min(order, key=lambda n: (kept[n][0] is None, kept[n][0] or 0, len(ints[n]), kept[n][1]))
    order = [n for n in order if len(ints[n]) == len(ints[first])]
    w = len(ints[first]) // parts
    cut = lambda n, p: ints[n][p * w : (p + 1) * w]
    books = [[cut(n, p) for n in order[:entries]] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book))

    for _ in range(2):
        for p in range(parts):
            groups = {}
            for n in order:
                groups.setdefault(near(cut(n, p), books[p])[1], []).append(cut(n, p))
            books[p] = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    found = {n: [near(cut(n, p), books[p]) for p in range(parts)] for n in order}
    label = {}
    for n, f in found.items():
        label[kept[n][2]] = label.get(kept[n][2], 0) + sum(d for d, _ in f)
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{e:02x}" for _, e in found[n]), sum(d for d, _ in found[n]), label[k], name) if n in found else (i, None, None, None, name) for n, (i, _, k) in enumerate(kept)]
    return sorted(out, key=str)


def found(spark, rows, kind="float"):
    table = spark.createDataFrame([(*r, "c", 5) for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string, error int")
    return sorted(map(tuple, C.compress(table).collect()), key=str)


def test_like_brute_force(spark):
    """Ties, copies, zero, odd, short and large vectors, null labels and ids; entries that nothing is near to."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=32) * 0.3).astype(np.float32).astype(float).tolist(), int(i % 4) if i % 5 else None) for i in range(230)]
    rows[3] = (3, rows[2][1], 1)
    rows += [(500 + i, rows[9][1], 2) for i in range(40)] + [(600, [0.0] * 32, 1), (601, None, 1), (602, [float("nan")] * 32, 1), (603, [None] * 32, None), (604, [], 1), (605, [1.0] * 16, 1), (606, [float("inf")] * 32, 1), (607, [3e38] * 32, 1), (None, rows[5][1], 3), (7, rows[8][1], None), (608, [131071.0] * 32, 9)]
    assert found(spark, rows) == brute(rows)


def test_few_and_none(spark):
    assert found(spark, []) == []
    few = [(5, [0.1 * k for k in range(16)], None), (9, [0.1] * 16, None)]
    assert found(spark, few, "double") == brute(few)
    assert found(spark, [(1, [1.0, 2.0], 3)])[0][:4] == (1, None, None, None)


def test_cells_bound_and_filter():
    """Bounds are right for far and near queries, and leave few of the entries to be compared."""
    rng = np.random.default_rng(5)
    entries, queries = rng.integers(-90, 90, size=(64, 4)), rng.integers(-120, 120, size=(3000, 4))
    best, error = C.Cells(entries).nearest(queries)
    exact = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (best == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()
    same = np.repeat(entries[:3], 20, axis=0)
    assert set(C.Cells(same).nearest(queries)[0]) <= {0, 20, 40}
