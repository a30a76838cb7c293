import hashlib
import random
import zlib

from loomline.llm import conversation_trie as T


def plain(rows):
    """The trie by writing out every beginning of every rebuilt conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        """(leaves, saved) of the subtree, without recursion into Python's stack."""
        todo, leaves, saved = [p], 0, 0
        while todo:
            x = todo.pop()
            leaves += x not in children
            saved += (len(members[x]) - 1) * len(x[-1][1].encode()) if x else 0
            todo += children.get(x, [])
        return leaves, saved

    out = []
    for p, own_ids in members.items():
        ends = ",".join(map(str, sorted(c for c in own_ids if len(whole[c]) == len(p))))
        out.append((min(own_ids), len(p), min(members[p[:-1]]) if p else None, len(own_ids), len(children.get(p, [])), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn int, role string, text string, key string, depth int")
    return sorted(map(tuple, T.trie(table).collect()), key=str)


def test_like_writing_out(spark):
    """Shared beginnings, copies by the dozen, missing bases, nulls, repeated turns, a long pair, texts that are others' beginnings."""
    pick = random.Random(3)
    rows = []
    for c in range(0, 90):
        if c % 15 == 10:
            continue
        for t in range(pick.randrange(1, 12)):
            rows.append((c, t, pick.choice(["user", "assistant"]) if t > 3 else "user", pick.choice(["a", "b", "é"]) if t != 2 else None))
    for c in range(200, 240):
        rows += [(c, t, "user", f"same {t}") for t in range(10)]
    for c in (1000, 1005, 1007):
        rows += [(c, t, None, "x") for t in range(25)]
    rows += [(1007, 25, "user", "more"), (1000, 99, "user", "other"), (1000, 99, "user", "other"), (2001, None, "z", "first"), (2001, None, "a", "before"), (2001, 0, "", ""), (None, 1, "user", "x"), (3003, 0, "1:u", "x"), (3004, 0, "1", ":ux")]
    assert found(spark, rows) == plain(rows)


def test_few(spark):
    assert found(spark, []) == []
    assert found(spark, [(4, 0, "user", "x")]) == plain([(4, 0, "user", "x")])
    for rows in ([(5, 0, "user", "x"), (5, 1, "user", "y")], [(c, t, "u", "x") for c in range(10, 30) for t in range(4)]):
        assert found(spark, rows) == plain(rows)
