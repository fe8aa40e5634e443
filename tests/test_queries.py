"""Every registered query of the engine on the smallest tables, against DuckDB where it has SQL."""

import pytest

from markerflow.plans.queries import QUERIES, SQL

from .compare import same

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name, tmp_path):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        same(df, SQL[name], SMALL)
    else:
        df.write.parquet(str(tmp_path / "out"))  # what cannot be written is not a result
        assert df.columns and spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filter_and_columns_reach_the_scan(spark):
    from markerflow.operators.match import usable
    from markerflow.plans import adapters

    plan = usable(adapters.tracks(spark, SMALL), 0.6).select("frame", "obj_id")._jdf.queryExecution().executedPlan().toString()
    assert "DataFilters" in plan and "l_comment" not in plan and "l_tax" not in plan
