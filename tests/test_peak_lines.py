"""Cells along a line are spread where they lie: nothing is exchanged between the spreading and its sum."""

from pyspark.sql import functions as F

from markerflow.operators import candidates


def test_spread_rows_are_not_exchanged(spark):
    cells = spark.range(200).select((F.col("id") % 2).alias("g"), (F.col("id") % 10).alias("gx"), F.floor(F.col("id") / 10).alias("gy"), ((F.col("id") * 7 % 31) / 31).alias("score"))
    plan = candidates.grid_peaks(cells, ["g"], 1)._jdf.queryExecution().executedPlan().toString().splitlines()
    places = [i for i, line in enumerate(plan) if "Generate explode" in line]
    assert len(places) == 2
    for i in places:  # upwards: the aggregates, which come before any exchange
        above = [line for line in plan[:i][::-1] if "Exchange" in line or "HashAggregate" in line]
        assert all("HashAggregate" in line for line in above[:2])
