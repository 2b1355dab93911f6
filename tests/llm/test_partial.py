import duckdb
import pytest

from lakeloom.llm import partial, registry
from tests.test_core import plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [*sorted(partial.QUERIES), "op3_simhash"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours.columns, ours.collect()) == plain(theirs.columns, theirs.fetchall())
