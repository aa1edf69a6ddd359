"""Runs a query and its SQL on the same tables and compares their rows."""

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql: str, sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    return names, r.fetchall()


def _key(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, (int, float)):
        return (1, round(float(v), 4)) if math.isfinite(v) else (2, str(v))
    return (3, str(v))


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 2e-6 * max(1, abs(a))
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def difference(df, sql: str, sf_dir: str) -> str:
    """What differs, or ''."""
    names, want = rows_of_sql(sql, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    order = sorted(names)
    a = sorted((tuple(r[df.columns.index(n)] for n in order) for r in got), key=lambda r: [_key(v) for v in r])
    b = sorted((tuple(r[names.index(n)] for n in order) for r in want), key=lambda r: [_key(v) for v in r])
    for x, y in zip(a, b, strict=True):
        if not all(map(same, x, y)):
            return f"{order}: {x} and {y}"
    return ""
