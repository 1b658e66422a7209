"""Operators on reads: filters, aggregation into the long count matrix, distances and expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.ranking import running_total
from cellweave.functions.scalar import euclid, half_even

CONTROL_PROBES = r"(?i)BLANK|NegControl"


def read_counts(reads: DataFrame) -> DataFrame:
    """Reads per (sample, cell, gene); unassigned reads are left out and zeros are not stored."""
    return (
        reads.filter(F.col("cell_id").isNotNull()).groupBy("sample", "cell_id", "feature_name").agg(F.count("*").alias("n"))
    )


def keep_overlap(reads: DataFrame, overlaps_nucleus: int = 1) -> DataFrame:
    return reads.filter(F.col("overlaps_nucleus") == overlaps_nucleus)


def keep_near_nucleus(reads: DataFrame, max_nucleus_distance: float = 1, min_quality: float = 20) -> DataFrame:
    """Distance 0 keeps reads inside the nucleus, a larger one those strictly nearer; quality is strict."""
    near = (
        F.col("overlaps_nucleus") == 1 if max_nucleus_distance == 0 else F.col("nucleus_distance") < max_nucleus_distance
    )
    return reads.filter(near & (F.col("qv") > min_quality))


def keep_flag_and_quality(reads: DataFrame, overlaps_nucleus: int = 1, min_quality: float = 20) -> DataFrame:
    """Flag 0 keeps all reads."""
    out = reads.filter(F.col("qv") > min_quality)
    return out.filter("overlaps_nucleus = 1") if overlaps_nucleus else out


def drop_controls(df: DataFrame, pattern: str = CONTROL_PROBES) -> DataFrame:
    return df.filter(~F.col("feature_name").rlike(pattern))


def crop(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float], closed: str = "left", shift: bool = True):
    """Rows inside (xmin, xmax, ymin, ymax). ``closed``: left (half-open), neither or both."""
    x0, x1, y0, y1 = box

    def inside(c: Column, low: float, high: float) -> Column:
        above = c > low if closed == "neither" else c >= low
        return above & (c <= high if closed == "both" else c < high)

    out = df.filter(inside(F.col(x), x0, x1) & inside(F.col(y), y0, y1))
    return out.withColumns({x: F.col(x) - x0, y: F.col(y) - y0}) if shift else out


#: Micrometres per pixel divisors of the platforms.
PIXELS_PER_UM = {"A": 8.3333, "N": 4.70588, "R": 9.20586}


def rescale(df: DataFrame, factors: dict[str, float], key: str, *coordinates: str) -> DataFrame:
    """Divide coordinates by the factor of their platform; a platform without a factor keeps its units."""
    pairs = [F.lit(x) for k, v in factors.items() for x in (k, v)]
    f = F.coalesce(F.element_at(F.create_map(*pairs), F.col(key)), F.lit(1.0))
    return df.withColumns({c: F.col(c) / f for c in coordinates})


def name_regions(df: DataFrame, column: str, groups: dict[str, list[str]], out: str = "region") -> DataFrame:
    """Name of the group that lists the value; the later group wins."""
    c = F.lit(None).cast("string")
    for name, members in groups.items():
        c = F.when(F.col(column).isin(members), name).otherwise(c)
    return df.withColumn(out, c)


def cell_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sample", "cell_id").agg(
        F.sum("n").alias("total_counts"), F.count("*").alias("expressed_genes")
    )


def gene_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature_name").agg(F.sum("n").alias("n_counts"), F.count("*").alias("n_cells"))


def filter_cells(counts: DataFrame, min_counts: int = 10, min_genes: int = 3) -> DataFrame:
    kept = cell_totals(counts).filter((F.col("total_counts") >= min_counts) & (F.col("expressed_genes") >= min_genes))
    return counts.join(kept.select("sample", "cell_id"), ["sample", "cell_id"], "left_semi")


def filter_cells_capped(
    totals: DataFrame, min_counts: int, min_genes: int, factor: float = 4.0, quantile: float = 0.99, closed: bool = True
) -> DataFrame:
    """Cells whose total lies between the minimum and ``factor`` times the quantile; ``closed`` includes the bounds."""
    cap = totals.agg((F.percentile("total_counts", F.lit(quantile)) * factor).alias("cap"))
    met = totals.join(F.broadcast(cap))  # one row
    t, g = F.col("total_counts"), F.col("expressed_genes")
    if closed:
        fits = (t >= min_counts) & (t <= F.col("cap")) & (g >= min_genes)
    else:
        fits = (t > min_counts) & (t < F.col("cap")) & (g > min_genes)
    return met.filter(fits).drop("cap")


def filter_genes(counts: DataFrame, min_cells: int = 0, above_total: int | None = None) -> DataFrame:
    """Genes found in at least ``min_cells`` cells and, if given, with a total strictly above ``above_total``."""
    kept = gene_totals(counts).filter(F.col("n_cells") >= min_cells)
    if above_total is not None:
        kept = kept.filter(F.col("n_counts") > above_total)
    return counts.join(kept.select("feature_name"), "feature_name", "left_semi")


def filter_genes_by_peak(counts: DataFrame, above: int) -> DataFrame:
    """Genes whose largest count in a cell is strictly above the limit."""
    kept = counts.groupBy("feature_name").agg(F.max("n").alias("peak")).filter(F.col("peak") > above)
    return counts.join(kept.select("feature_name"), "feature_name", "left_semi")


def centroid_distance(reads: DataFrame, cells: DataFrame) -> DataFrame:
    """Reads with the distance to their cell's centroid; reads without a cell are left out."""
    at = cells.select("sample", "cell_id", "x_centroid", "y_centroid")
    c = F.col
    return reads.join(at, ["sample", "cell_id"]).withColumn(
        "distance", euclid(c("x_location"), c("y_location"), c("x_centroid"), c("y_centroid"))
    )


def gene_distances(distances: DataFrame) -> DataFrame:
    return distances.groupBy("feature_name").agg(
        F.avg("distance").alias("mean"),
        F.median("distance").alias("median"),
        F.stddev_samp("distance").alias("std"),
        F.count("distance").alias("count"),
    )


def mean_peak_distance(distances: DataFrame) -> DataFrame:
    """Mean over cells of the largest distance of a nuclear read."""
    return (
        keep_overlap(distances)
        .groupBy("sample", "cell_id")
        .agg(F.max("distance").alias("peak"))
        .agg(F.avg("peak").alias("mean_peak"))
    )


def z_spread(reads: DataFrame) -> DataFrame:
    return (
        reads.filter(F.col("cell_id").isNotNull())
        .groupBy("sample", "cell_id")
        .agg(
            F.min("z_location").alias("z_min"),
            F.max("z_location").alias("z_max"),
            F.stddev_samp("z_location").alias("z_std"),
        )
        .withColumn("z_range", F.col("z_max") - F.col("z_min"))
    )


def expansion_curve(distances: DataFrame, steps: int = 15) -> DataFrame:
    """For each whole distance 0..steps: reads within it and the share of them in the nucleus, in one pass over the reads."""
    rings = (
        distances.withColumn("ring", half_even(F.col("distance")).cast("int"))
        .groupBy("ring")
        .agg(F.count("*").alias("n"), F.sum("overlaps_nucleus").alias("nuclear"))
    )
    grid = distances.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("ring"))
    # A ring is a whole number, so there are few rows to sum up.
    filled = grid.join(rings, "ring", "left").na.fill(0)
    n = running_total(F.col("n"), F.col("ring"))
    nuclear = running_total(F.col("nuclear"), F.col("ring"))
    return filled.select(
        F.col("ring").alias("expansion_distance"),
        n.alias("captured_reads"),
        F.when(n > 0, nuclear / n).otherwise(0.0).alias("purity"),
    )


def class_mean_distance(distances: DataFrame, cells: DataFrame, above: int = 10) -> DataFrame:
    """Mean distance per gene and class, where strictly more than ``above`` reads support it."""
    typed = distances.join(cells.select("sample", "cell_id", "cell_type"), ["sample", "cell_id"])
    out = typed.groupBy("feature_name", "cell_type").agg(F.avg("distance").alias("mean"), F.count("*").alias("n"))
    return out.filter(F.col("n") > above)


def grid_density(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Rows per cell of a bins x bins grid over the data's range; the last bin is closed."""
    lim = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))

    def place(c: str, low: str, high: str) -> Column:
        width = (F.col(high) - F.col(low)) / bins
        return F.least(F.floor((F.col(c) - F.col(low)) / width), F.lit(bins - 1)).cast("int")

    return (
        df.join(F.broadcast(lim))  # one row
        .groupBy(place(x, "x0", "x1").alias("ix"), place(y, "y0", "y1").alias("iy"))
        .agg(F.count("*").alias("n"))
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def seeded_order(seed: int, *keys: str) -> Column:
    """An order that depends on keys and seed alone, not on partitioning: hexadecimal digits that any SQL engine can make."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def fraction_sample(df: DataFrame, fraction: float, seed: int, *keys: str) -> DataFrame:
    """A row is taken by the hash of its keys, so the sample is the same however the rows are partitioned."""
    if fraction >= 1:
        return df
    return df.filter(F.substring(seeded_order(seed, *keys), 1, 10) < f"{int(fraction * (1 << 40)):010x}")


def fixed_sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    return df.orderBy(seeded_order(seed, *keys), *keys).limit(n)
