"""Runs registered queries in Spark and their SQL in DuckDB and tells how they differ."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def difference(df, sql, db):
    """None if the rows agree, else a text."""
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = [names.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
    if got == want:
        return None
    odd = [x for x in zip(got, want) if x[0] != x[1]][:2]
    return f"{len(got)} and {len(want)} rows; {odd}"
