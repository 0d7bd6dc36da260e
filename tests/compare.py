"""Compare a query with its SQL counterpart, row by row."""

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def sql_rows(sf_dir, sql):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = db.execute(sql)
    return [c[0] for c in result.description], result.fetchall()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def as_counter(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, sf_dir, sql):
    """Empty string if equal, else what differs."""
    columns, rows = sql_rows(sf_dir, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    got, want = as_counter(df.columns, df.collect()), as_counter(columns, rows)
    if got == want:
        return ""
    extra, lacking = got - want, want - got
    return f"{sum(extra.values())} extra {list(extra)[:2]}, {sum(lacking.values())} lacking {list(lacking)[:2]}"
