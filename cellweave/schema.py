"""Schemas of the input tables and the mapping of the platforms' column names to ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

READS = T.StructType(
    [
        T.StructField("cell_id", T.StringType()),
        T.StructField("feature_name", T.StringType()),
        T.StructField("x_location", T.DoubleType()),
        T.StructField("y_location", T.DoubleType()),
        T.StructField("z_location", T.DoubleType()),
        T.StructField("qv", T.DoubleType()),
        T.StructField("overlaps_nucleus", T.IntegerType()),
        T.StructField("nucleus_distance", T.DoubleType()),
        T.StructField("fov_name", T.StringType()),
    ]
)

#: What stands for "no cell" in the layouts.
NO_CELL = ("-1", "0", "UNASSIGNED", "")

#: Layout -> names that differ from ours.
LAYOUTS = {
    "current": {},
    "assignments": {"Gene": "feature_name", "x": "x_location", "y": "y_location", "cell": "cell_id"},
    "boundaries": {"vertex_x": "x", "vertex_y": "y"},
}


def normalise_columns(df: DataFrame, layout: str = "current", no_cell: tuple[str, ...] = NO_CELL) -> DataFrame:
    """Our column names, with null for every sentinel cell."""
    out = df.withColumnsRenamed(LAYOUTS[layout])
    if "cell_id" in out.columns:
        c = F.col("cell_id").cast("string")
        out = out.withColumn("cell_id", F.when(~c.isin(*no_cell), c))
    return out
