"""Compare a Spark result with the rows of its SQL."""

import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6f}" if value != int(value) else str(int(value))
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(df, db, sql):
    """None when both agree, else a short account of the difference."""
    cursor = db.execute(sql)
    names = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = [tuple(r) for r in df.collect()]
    kinds = {c: t for c, t in df.dtypes}
    nested = [c for c, t in kinds.items() if t[:5] in ("array", "map<s", "struc")]
    if nested:
        return f"nested columns {nested}"
    left, right = _rows(df.columns, got), _rows(names, expected)
    if left == right:
        return None
    extra, lost = _sample(left, right), _sample(right, left)
    return f"rows {len(left)} != {len(right)}\n  spark only: {extra}\n  sql only:   {lost}"


def _sample(a, b):
    b = set(b)
    return [tuple(x[:120] for x in r) for r in a if r not in b][:3]
