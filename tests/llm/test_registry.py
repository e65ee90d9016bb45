"""The subpackage's queries are registered, and those with SQL agree with it."""

import duckdb
import pytest

import __spark_entry__ as E
from lotwise import llm

SF = "/root/testdata/sf0.001"


def test_all_registered():
    q = E.queries()
    assert {n.split("_")[0] for n in q if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in q and set(llm.QUERIES) <= set(q) and set(llm.ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = E.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({E.oracle_sql()[name]})").fetchall()
    key = lambda rows: sorted(repr([f"{v:.9g}" if isinstance(v, float) else v for v in r]) for r in rows)
    assert key(map(tuple, got.select(*cols).collect())) == key(want)
