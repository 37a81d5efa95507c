"""Every registered query of the engine against its SQL, on whole small tables."""

import duckdb
import pytest
from lithoscope.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(rows):
    return sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows_as_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    if name in registry.ORACLE_SQL:
        want = con.sql(registry.ORACLE_SQL[name])
        assert sorted(want.columns) == cols
        assert _rows(got) == _rows(want.project(",".join(f'"{c}"' for c in cols)).fetchall())
    else:
        assert got


def test_plans_prune_columns(spark):
    plan = registry.QUERIES["SUM1_totals"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_entry_imports_without_the_corpus_operators():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
