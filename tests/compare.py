"""Compares a query's rows with its oracle's: columns by name, rows in any order, doubles to nine digits."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = c.execute(sql)
    return [d[0] for d in cur.description], [str(d[1]) for d in cur.description], cur.fetchall()


def shown(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


KIND = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "FLOAT": "float"}


def differences(df, sf_dir: str, sql: str) -> list[str]:
    names, kinds, rows = oracle(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} / {sorted(names)}"]
    order = sorted(names)
    kind = dict(zip(names, kinds))
    found = [f"type of {c}: {t} / {kind[c]}" for c, t in df.dtypes if KIND.get(kind[c], kind[c]) != t and not (t == "timestamp" or t.startswith("array"))]
    at = [names.index(c) for c in order]
    want = sorted(tuple(shown(r[i]) for i in at) for r in rows)
    got = sorted(tuple(shown(r[c]) for c in order) for r in df.collect())
    if len(got) != len(want):
        found.append(f"rows {len(got)} / {len(want)}")
    odd = [(g, w) for g, w in zip(got, want) if g != w]
    if odd:
        found.append(f"{len(odd)} rows differ, first: {odd[0]}")
    if not want:
        found.append("no rows")
    return found
