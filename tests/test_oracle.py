"""Every registered query against its DuckDB oracle (sf0.001), as the driver checks it."""
import pytest

from trailcast.catalog import registry
from trailcast.catalog.check import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    return check(spark, SF, keys=list(registry.all_queries()), verbose=False)


def test_all_queries_match_oracle(results):
    bad = {k: v for k, v in results.items() if not v.get("ok")}
    assert not bad, bad


def test_every_query_has_an_oracle(results):
    rows_only = {k for k, v in results.items() if v.get("rows_only")}
    assert not rows_only


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def test_column_types_match_oracle(spark):
    from trailcast.catalog.check import duckdb_conn
    con = duckdb_conn(SF)
    qs, sqls = registry.all_queries(), registry.all_oracles()
    bad = {}
    for k, sql in sqls.items():
        st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
              for f in qs[k](spark, SF).schema.fields}
        rel = con.sql(sql)
        dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        diff = {c: (st[c], dt.get(c)) for c in st if st[c] != dt.get(c)}
        if diff:
            bad[k] = diff
    assert not bad, bad
