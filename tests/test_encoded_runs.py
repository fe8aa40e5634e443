"""Run lengths made of words of pixels, and rows that are dealt before each becomes many."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from markerflow.operators import masks
from markerflow.plans import queries

SMALL = "/root/testdata/sf0.001"


def drawn(spark):
    rng = np.random.default_rng(3)
    shown = [rng.random((h, w)) < share for (h, w), share in (((7, 19), 0.5), ((7, 19), 0.95), ((7, 19), 0.05))] + [np.ones((7, 19), bool), np.zeros((7, 19), bool)]
    shown[4][6, 18] = True  # the last pixel alone
    shown[2][0, 0] = True
    rows = [(i, int(x), int(y)) for i, m in enumerate(shown) for y, x in zip(*np.nonzero(m)) for _ in range(1 + (x + y) % 2)]  # some pixels twice
    return shown, spark.createDataFrame(pd.DataFrame(rows, columns=["mask", "x", "y"]))


def test_words_give_the_runs_of_the_mask(spark):
    shown, pixels = drawn(spark)
    found = {r["mask"]: list(r["counts"]) for r in masks.encode_rle(pixels, ["mask"], 7, 19).collect()}
    assert found == {i: masks.mask_rle(m) for i, m in enumerate(shown)}


def test_no_window_and_one_exchange_of_words(spark):
    plan = masks.encode_rle(drawn(spark)[1], ["mask"], 7, 19)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "lag(" not in plan


def test_corners_are_not_worked_out_before_they_are_dealt(spark):
    plan = queries.g13_canonical_corners(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan[plan.index("Exchange") :]


@pytest.mark.parametrize("frame", [lambda s: queries._square(s, SMALL), lambda s: queries._mask_files(s, SMALL), lambda s: queries.g13_canonical_corners(s, SMALL), lambda s: queries.m9_filled_scores(s, SMALL)])
def test_parts_are_dealt_before_the_work(spark, frame):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert frame(spark).select(F.spark_partition_id().alias("p")).distinct().count() == n
