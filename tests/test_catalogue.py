"""Every registered query that has SQL gives DuckDB's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tracegrain.plans import analyses, associations, catalogue, comparisons, evidence, kernels  # noqa: F401  (all add their queries)

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    v = float(v)
    return None if math.isnan(v) else float(f"{v:.9g}")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, db, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = db.execute(catalogue.ORACLE_SQL[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    theirs = sorted(repr([plain(r[order.index(c)]) for c in columns]) for r in found.fetchall())
    assert ours == theirs
