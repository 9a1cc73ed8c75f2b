"""Every query that has SQL agrees with DuckDB on a supplied table set."""

import duckdb
import pytest

from quillon.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "-" if v is None else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["lexical_rank", "typed_scores", "job_admission"])
def test_same_with_other_partitions(spark, name):
    a = sorted(map(str, QUERIES[name](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    b = sorted(map(str, QUERIES[name](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b
