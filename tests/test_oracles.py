"""Every registered query against its SQL equivalent in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from quern.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def canonical(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        return repr(round(float(v), 4) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(tuple(r[c] for c in columns) for r in df.collect()) == canonical(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_streams_equal_the_bounded_queries(spark):
    """All of a stream at once: the limiter's answers are those of the table, and so are all windows, open ones included."""
    key = lambda df: canonical(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert key(QUERIES["stream_rate_limit"](spark, FOLDER)) == key(QUERIES["rate_limit_exact"](spark, FOLDER))
    assert key(QUERIES["stream_tumbling"](spark, FOLDER)) == key(QUERIES["tumbling_counts"](spark, FOLDER))
