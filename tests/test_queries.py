"""Every query with SQL, side by side with DuckDB, and every query without SQL runs."""

import duckdb
import pytest

import __spark_entry__
from sigloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (bool, str)):
        return str(v)
    return float(v) + 0.0


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_as_sql(spark, db, name):
    df = plans.queries()[name](spark, SF)
    cur = db.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(columns, cur.fetchall())
    assert len(got) == len(want)
    assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-6 * max(1, abs(y)) for a, b in zip(got, want) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, SF).limit(3).collect() is not None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_workers_have_no_copy_of_the_code(spark):
    """So that every test that runs a kernel shows that its code travels."""

    def look(batches):
        import importlib.util

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"found": [importlib.util.find_spec("sigloom") is not None]})

    assert [r.found for r in spark.range(1).mapInArrow(look, "found boolean").collect()] == [False]
