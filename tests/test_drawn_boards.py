"""The frames of g13_board_corners are drawn by as many tasks as the session has shuffle partitions, not by the one that reads the suppliers."""

from markerflow.plans import vision

SMALL = "/root/testdata/sf0.001"


def test_frames_are_dealt_before_they_are_drawn(spark):
    suppliers, frames = vision._drawn_boards(spark, SMALL)
    assert frames.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert frames.count() == suppliers.count() * 64 * 48
