"""The spatial tables as views of the driver's star schema: cells, reads, counts and region polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators.reads import read_counts
from cellweave.session import table


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """sample, cell_id, cell_type, x_centroid, y_centroid: one cell per customer."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return (
        table(spark, sf, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("cell_id"),
            F.col("n_regionkey").alias("sample"),
            F.col("c_mktsegment").alias("cell_type"),
            ((F.col("c_custkey") * 37) % 997).cast("double").alias("x_centroid"),
            ((F.col("c_custkey") * 91) % 991).cast("double").alias("y_centroid"),
        )
    )


def reads(spark: SparkSession, sf: str) -> DataFrame:
    """One read per line item; about 5 % are unassigned, one gene is a control probe."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    at = cells(spark, sf).drop("cell_type")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    orders = orders.join(at, F.col("o_custkey") == F.col("cell_id"))  # first, so that line items are shuffled once less
    return (
        table(spark, sf, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "sample",
            F.when(F.col("l_partkey") % 20 != 7, F.col("cell_id")).alias("cell_id"),
            F.when(F.col("p_brand") == "Brand#25", "BLANK_25").otherwise(F.col("p_brand")).alias("feature_name"),
            (F.col("x_centroid") + (F.col("l_quantity") - 25) / 4.1).alias("x_location"),
            (F.col("y_centroid") + (F.round(F.col("l_discount") * 100) - 5)).alias("y_location"),
            F.abs(F.round(F.col("l_tax") * 100)).alias("z_location"),
            ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 11) % 41).alias("qv"),
            F.when(F.col("l_quantity").between(15, 35), 1).otherwise(0).alias("overlaps_nucleus"),
            (F.abs(F.col("l_quantity") - 25) / 4.1).alias("nucleus_distance"),
            F.col("l_returnflag").alias("method"),
            F.col("l_linestatus").alias("dataset"),
        )
    )


def counts(spark: SparkSession, sf: str) -> DataFrame:
    """The sparse cell-by-gene matrix in long form."""
    return read_counts(reads(spark, sf))


def polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Five quadrilaterals: poly_id, region_annotation, seq, x, y."""
    k = F.col("r_regionkey") * 200
    corners = F.array(
        *[
            F.struct(F.lit(i).alias("seq"), (k + dx).cast("double").alias("x"), F.lit(float(y)).alias("y"))
            for i, (dx, y) in enumerate(((0, 10), (180, 0), (190, 900), (-20, 700)))
        ]
    )
    return (
        table(spark, sf, "region")
        .select(F.col("r_regionkey").alias("poly_id"), F.col("r_name").alias("region_annotation"), F.explode(corners).alias("v"))
        .select("poly_id", "region_annotation", "v.seq", "v.x", "v.y")
    )


SQL_VIEWS = """
f_cells AS (
  SELECT c_custkey AS cell_id, n_regionkey AS sample, c_mktsegment AS cell_type,
         CAST((c_custkey * 37) % 997 AS DOUBLE) AS x_centroid, CAST((c_custkey * 91) % 991 AS DOUBLE) AS y_centroid
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
f_reads AS (
  SELECT sample, CASE WHEN l_partkey % 20 = 7 THEN NULL ELSE f_cells.cell_id END AS cell_id,
         CASE WHEN p_brand = 'Brand#25' THEN 'BLANK_25' ELSE p_brand END AS feature_name,
         x_centroid + (l_quantity - 25) / 4.1 AS x_location, y_centroid + (round(l_discount * 100) - 5) AS y_location,
         abs(round(l_tax * 100)) AS z_location, (l_partkey * 7 + l_linenumber * 11) % 41 AS qv,
         CASE WHEN l_quantity BETWEEN 15 AND 35 THEN 1 ELSE 0 END AS overlaps_nucleus,
         abs(l_quantity - 25) / 4.1 AS nucleus_distance, l_returnflag AS method, l_linestatus AS dataset
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN f_cells ON o_custkey = f_cells.cell_id
                JOIN part ON l_partkey = p_partkey
),
f_counts AS (
  SELECT sample, cell_id, feature_name, count(*) AS n FROM f_reads WHERE cell_id IS NOT NULL
  GROUP BY sample, cell_id, feature_name
),
f_polygons AS (
  SELECT r_regionkey AS poly_id, r_name AS region_annotation, seq,
         CAST(CASE seq WHEN 0 THEN r_regionkey * 200 WHEN 1 THEN r_regionkey * 200 + 180
                       WHEN 2 THEN r_regionkey * 200 + 190 ELSE r_regionkey * 200 - 20 END AS DOUBLE) AS x,
         CAST(CASE seq WHEN 0 THEN 10 WHEN 1 THEN 0 WHEN 2 THEN 900 ELSE 700 END AS DOUBLE) AS y
  FROM region CROSS JOIN (SELECT 0 AS seq UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) s
)"""
