"""Relations of the engine, and the checks that readers make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Field names, order and types of the exchanged files.
TRACK_2D = "frame int, obj_id int, u double, v double, u_local double, v_local double, method string, area_px int, core_radius_px double, solidity double, quality double, valid int"
OBS_3D = (
    "gframe int, frame_L int, frame_R int, obj_id int, uL double, vL double, uR double, vR double, uL_hat double, vL_hat double, uR_hat double, vR_hat double, "
    "X double, Y double, Z double, Z_right double, errL_px double, errR_px double, err_px double, qL double, qR double, valid_3d int"
)
CANDIDATE = "candidate_id int, x double, y double, area double, method string, score double, local_x double, local_y double"


def require_columns(df: DataFrame, names: list[str], what: str = "input") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def conform(df: DataFrame, ddl: str, required: list[str], what: str = "input", also: list[str] | None = None, source: DataFrame | None = None) -> DataFrame:
    """Fields of ddl by name with their types, null where an optional one is absent; other columns are dropped but those of `also`,
    which are taken as they are from source."""
    require_columns(df, required, what)
    fields = [f.strip().rsplit(" ", 1) for f in ddl.split(",")]
    return (df if source is None else source).select(*[(F.col(n).try_cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in fields], *(also or []))
