"""Motion over blocks of frames is that of each pixel's frames in one row, and no task holds a pixel's frames."""

import pandas as pd
import pytest

from markerflow.operators import signals


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_motion_over_gaps_and_blocks(spark, block):
    rows = [("a", p, f, None if (p + f) % 11 == 0 else float((f * 7 + p * 3) % 13)) for p in range(3) for f in (0, 1, 2, 9, 10, 11, 30, 31, 64) if (p, f) != (1, 10)]
    pixels = pd.DataFrame(rows, columns=["side", "pixel", "frame", "value"])
    pixels["change"] = pixels.sort_values("frame").groupby("pixel")["value"].transform(lambda v: (v - v.shift()).abs())
    expected = pixels.groupby("frame").agg(brightness=("value", "mean"), motion=("change", "mean"))
    df = spark.createDataFrame([r if r[3] is not None else (*r[:3], None) for r in rows], "side string, pixel int, frame long, value double")
    got = {r["frame"]: (r["brightness"], r["motion"]) for r in signals.motion_curve(df, block=block).collect()}
    assert set(got) == set(expected.index)
    for f, e in expected.iterrows():
        assert got[f][0] == pytest.approx(e["brightness"]) and got[f][1] == pytest.approx(0.0 if pd.isna(e["motion"]) else e["motion"])
