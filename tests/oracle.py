"""Runs a registered query in Spark and its SQL in DuckDB and compares rows."""

from __future__ import annotations

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([names[k] for k in order], [tuple(plain(r[k]) for k in order) for r in values])[1], key=repr)


def compare(spark, name, queries, oracle, sf_dir=SF):
    df = queries[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck(sf_dir).execute(oracle[name])
    want = rows([d[0] for d in res.description], res.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in res.description)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want):
        assert len(a) == len(b) and all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b)), (a, b)
    return len(got)
