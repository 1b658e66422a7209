"""Quality reports of samples: reads and genes per cell, assignment, density, dataset overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.reads import cell_totals


def totals_of_all_cells(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Totals of every cell, 0 for those without a read."""
    got = cell_totals(counts)
    return cells.select("sample", "cell_id").join(got, ["sample", "cell_id"], "left").na.fill(0)


def per_cell_summary(totals: DataFrame) -> DataFrame:
    """Mean, median and the 5th and 95th percentiles, linearly interpolated, of reads and genes per cell."""
    out = []
    for tag, c in (("reads", "total_counts"), ("genes", "expressed_genes")):
        out += [
            F.avg(c).alias(f"mean_{tag}_cells"),
            F.percentile(c, F.lit(0.5)).alias(f"median_{tag}_cells"),
            F.percentile(c, F.lit(0.05)).alias(f"percentile_5th_{tag}_cells"),
            F.percentile(c, F.lit(0.95)).alias(f"percentile_95th_{tag}_cells"),
        ]
    return totals.groupBy("sample").agg(F.count("*").alias("number_of_cells"), *out)


def assigned_share(reads: DataFrame) -> DataFrame:
    return reads.groupBy("sample").agg(
        (F.count("cell_id") / F.count("*")).alias("proportion_of_assigned_reads"),
    )


def report(reads: DataFrame, counts: DataFrame, cells: DataFrame, panel_size: int) -> DataFrame:
    """(sample, metric, value) rows."""
    wide = per_cell_summary(totals_of_all_cells(counts, cells)).join(assigned_share(reads), "sample")
    wide = wide.withColumn("number_of_genes", F.lit(panel_size))
    names = [c for c in wide.columns if c != "sample"]
    return wide.select("sample", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        ["sample"], names, "metric", "value"
    )


def extras(reads: DataFrame, totals: DataFrame, panel: DataFrame, threshold: int = 5) -> DataFrame:
    """Shares of good, in-panel and assigned reads, and of cells with more than ``threshold`` reads."""
    known = panel.select("feature_name", F.lit(1).alias("in_panel"))
    a = (
        reads.join(known, "feature_name", "left")
        .groupBy("sample")
        .agg(
            F.avg((F.col("qv") > 20).cast("int")).alias("reads_prop_qv"),
            F.count("*").alias("total_reads"),
            (F.count("in_panel") / F.count("*")).alias("prop_reads_in_panel"),
            (F.count("cell_id") / F.count("*")).alias("prop_reads_assigned"),
        )
    )
    b = totals.groupBy("sample").agg(F.avg((F.col("total_counts") > threshold).cast("int")).alias("proportion_cells"))
    return a.join(b, "sample")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of value pairs with the share of the row."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows = n.groupBy(F.col(a).alias("__row")).agg(F.sum("n").alias("row_total"))
    return n.join(rows, F.col(a).eqNullSafe(F.col("__row"))).select(a, b, "n", (F.col("n") / F.col("row_total")).alias("share"))


def majority_vote(df: DataFrame, by: list[str], label: str, threshold: float = 0.0, unknown: str = "Unknown") -> DataFrame:
    """Most frequent label of each group, the least on ties, its share, and ``unknown`` where that is under the threshold."""
    n = df.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    best = F.min_by(label, F.struct((-F.col("n")).alias("n"), F.col(label).alias("l")))
    out = n.groupBy(*by).agg(best.alias("label"), (F.max("n") / F.sum("n")).alias("certainty"))
    return out.withColumn("label", F.when(F.col("certainty") >= threshold, F.col("label")).otherwise(unknown))


def signatures(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Mean count per class and gene; cells without the gene count as 0."""
    sizes = cells.groupBy("cell_type").agg(F.count("*").alias("size"))
    typed = counts.join(cells.select("sample", "cell_id", "cell_type"), ["sample", "cell_id"])
    sums = typed.groupBy("cell_type", "feature_name").agg(F.sum("n").alias("total"))
    return sums.join(sizes, "cell_type").select("cell_type", "feature_name", (F.col("total") / F.col("size")).alias("mean"))


def composition_profile(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: cells, genes, types, least and largest type share, mean of cell maxima and totals, sparsity, top-gene share."""
    per_cell = counts.groupBy("sample", "cell_id").agg(F.max("n").alias("peak"), F.sum("n").alias("total"))
    size = cells.agg(F.count("*").alias("n_cells"))
    types = cells.groupBy("cell_type").agg(F.count("*").alias("k"))
    shares = types.agg(
        F.count("*").alias("n_types"),
        (F.min("k") / F.sum("k")).alias("smallest_type"),
        (F.max("k") / F.sum("k")).alias("largest_type"),
    )
    sums = per_cell.agg(F.sum("peak").alias("peaks"), F.sum("total").alias("totals"), F.lit(1).alias("one"))
    genes = counts.groupBy("feature_name").agg(F.sum("n").alias("g"), F.count("*").alias("nnz"))
    gene = genes.agg(
        F.count("*").alias("n_genes"), (F.max("g") / F.sum("g")).alias("top_gene_share"), F.sum("nnz").alias("nnz")
    )
    one = size.join(shares).join(sums).join(gene)  # single rows
    return one.select(
        "n_cells",
        "n_genes",
        "n_types",
        "smallest_type",
        "largest_type",
        (F.col("peaks") / F.col("n_cells")).alias("mean_max"),
        (F.col("totals") / F.col("n_cells")).alias("mean_total"),
        (1 - F.col("nnz") / (F.col("n_cells") * F.col("n_genes"))).alias("sparsity"),
        "top_gene_share",
    )


def gene_datasets(df: DataFrame, key: str, more_than: int) -> DataFrame:
    """Genes that strictly more than ``more_than`` datasets have."""
    out = df.groupBy("feature_name").agg(F.countDistinct(key).alias("datasets"))
    return out.filter(F.col("datasets") > more_than)


def coexpression(counts: DataFrame, min_exp: int = 0) -> DataFrame:
    """P(h > min | g > min) for all gene pairs; 1 where g is never above.

    Pairs are made inside cells, so the work is the sum of squared genes per cell; the full gene square is panel-sized.
    """
    above = counts.filter(F.col("n") > min_exp).select("sample", "cell_id", "feature_name")
    genes = counts.select("feature_name").distinct()
    other = above.withColumnRenamed("feature_name", "h")
    both = above.join(other, ["sample", "cell_id"]).groupBy(F.col("feature_name").alias("g"), "h").agg(F.count("*").alias("n"))
    single = above.groupBy(F.col("feature_name").alias("g")).agg(F.count("*").alias("n_g"))
    square = genes.select(F.col("feature_name").alias("g")).join(genes.select(F.col("feature_name").alias("h")), how="cross")
    return (
        square.join(both, ["g", "h"], "left")
        .join(single, "g", "left")
        .select(
            "g",
            "h",
            F.when(F.col("n_g").isNull(), 1.0).otherwise(F.coalesce("n", F.lit(0)) / F.col("n_g")).alias("p"),
        )
    )
