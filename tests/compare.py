"""Run a registered query and its SQL twin and compare rows (column-sorted, order-free)."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    if v is None:
        return ("0", "")
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, (int, float)):
        return ("n", f"{float(v):+.9e}")
    return ("s", str(v))


def _kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    return type(v).__name__


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) and math.isnan(b)
        if a == 0 and b == 0:
            return math.copysign(1, a) == math.copysign(1, b)
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=0)
    return _kind(a) == _kind(b) and a == b


def check(con, df, sql, rows=None) -> str | None:
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in (df.collect() if rows is None else rows)]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    pos = [names.index(c) for c in cols]
    want = [tuple(r[p] for p in pos) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    order = lambda rows: sorted(rows, key=lambda r: tuple(_key(v) for v in r))
    for g, w in zip(order(got), order(want)):
        for c, a, b in zip(cols, g, w):
            if not same(a, b):
                return f"column {c}: {a!r} vs {b!r} in {g} vs {w}"
    return None
