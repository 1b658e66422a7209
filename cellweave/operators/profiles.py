"""Distance profiles, replicate correlation and region validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.scalar import half_even, ratio
from cellweave.operators.spatial import as_points, nearest_within

c = F.col


def profile_correlation(distances: DataFrame, cells: DataFrame, steps: int = 15, drop: float = 0.1) -> DataFrame:
    """(cell_type, ring, r, delta, crossover): correlation over genes of the class's nuclear signature with its reads at each
    distance ring; ``crossover`` is where the change falls under ``drop``."""
    typed = distances.join(cells.select("sample", "cell_id", "cell_type"), ["sample", "cell_id"])
    ringed = typed.withColumn("ring", half_even(c("distance")).cast("int")).filter(c("ring") <= steps)
    nuclear = typed.filter("overlaps_nucleus = 1").groupBy("cell_type", "feature_name").agg(F.count("*").alias("x"))
    rings = ringed.groupBy("cell_type", "ring", "feature_name").agg(F.count("*").alias("y"))
    keys = rings.select("cell_type", "ring").distinct()
    full = keys.join(nuclear, "cell_type").join(rings, ["cell_type", "ring", "feature_name"], "left").na.fill(0, ["y"])
    r = full.groupBy("cell_type", "ring").agg(F.corr("x", "y").alias("r"))
    d = c("r") - F.lag("r").over(Window.partitionBy("cell_type").orderBy("ring"))
    return r.withColumn("delta", d).withColumn("crossover", F.coalesce(F.abs("delta") < drop, F.lit(False)))


def best_radius(profile: DataFrame) -> DataFrame:
    """First ring of each class at which the profile has settled."""
    return profile.filter("crossover").groupBy("cell_type").agg(F.min("ring").alias("radius"))


def elbow(curve: DataFrame) -> DataFrame:
    """The expansion distance with the largest second difference of the captured share, the least one on ties."""
    w = Window.orderBy("expansion_distance")  # one row per distance
    share = c("captured_reads") / F.max("captured_reads").over(Window.partitionBy(F.lit(1)))
    s = curve.withColumn("share", share)
    bend = 2 * c("share") - F.lag("share").over(w) - F.lead("share").over(w)
    b = s.withColumn("bend", F.round(bend, 9)).filter(c("bend").isNotNull())
    return b.orderBy(c("bend").desc(), "expansion_distance").limit(1).select("expansion_distance", "bend")


def distance_classes(distances: DataFrame) -> DataFrame:
    """Reads of each gene in the classes -5-0, 0-5, 5-15 and 15+ of the signed nucleus distance, with shares."""
    signed = F.when(c("overlaps_nucleus") == 1, -c("nucleus_distance")).otherwise(c("nucleus_distance"))
    k = F.when(signed < 0, "-5-0").when(signed < 5, "0-5").when(signed < 15, "5-15").otherwise("15+")
    n = distances.groupBy("feature_name", k.alias("class")).agg(F.count("*").alias("n"))
    return n.withColumn("share", c("n") / F.sum("n").over(Window.partitionBy("feature_name")))


def distance_percentiles(distances: DataFrame) -> DataFrame:
    p = F.percentile("distance", F.array(F.lit(0.1), F.lit(0.9)))
    return distances.groupBy("feature_name").agg(p.alias("p")).select(
        "feature_name", F.get("p", F.lit(0)).alias("p10"), F.get("p", F.lit(1)).alias("p90")
    )


def welch_between_genes(summary: DataFrame) -> DataFrame:
    """(g, h, t, df) for all gene pairs from their means, deviations and counts; the square is panel-sized."""
    s = summary.filter(c("count") > 1)
    a = s.select(c("feature_name").alias("g"), c("mean").alias("m1"), (c("std") * c("std") / c("count")).alias("v1"), c("count").alias("n1"))
    b = s.select(c("feature_name").alias("h"), c("mean").alias("m2"), (c("std") * c("std") / c("count")).alias("v2"), c("count").alias("n2"))
    met = a.join(F.broadcast(b), c("g") < c("h"))
    v = c("v1") + c("v2")
    df = ratio(v * v, c("v1") * c("v1") / (c("n1") - 1) + c("v2") * c("v2") / (c("n2") - 1))
    return met.select("g", "h", ratio(c("m1") - c("m2"), F.sqrt(v)).alias("t"), df.alias("df"))


def nearest_nucleus(reads: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """(sample, x_location, y_location, n, cell, dist): nearest centroid within the radius for every distinct place of a read, and how
    many reads lie there."""
    at = reads.groupBy("sample", "x_location", "y_location").agg(F.count("*").alias("n"))
    place = F.struct("x_location", "y_location", "n").alias("id")
    p = at.select("sample", place, c("x_location").alias("x"), c("y_location").alias("y"))
    near = nearest_within(p, as_points(cells), radius)
    return near.select("sample", "src.x_location", "src.y_location", "src.n", c("dst").alias("cell"), "dist")


def reads_in_own_radius(reads: DataFrame, cells: DataFrame, radii: DataFrame, most: float) -> DataFrame:
    """Reads per cell that lie within the radius of the cell's class, nearest cell first."""
    near = nearest_nucleus(reads, cells, most)
    typed = near.join(cells.select("sample", c("cell_id").alias("cell"), "cell_type"), ["sample", "cell"])
    kept = typed.join(F.broadcast(radii), "cell_type").filter(c("dist") <= c("radius"))
    return kept.groupBy("sample", "cell").agg(F.sum("n").alias("n"))


def replicate_correlation(totals: DataFrame, sample: str, key: str, value: str) -> DataFrame:
    """(a, b, r): correlation of a value over keys for all pairs of samples; keys that one lacks are left out."""
    a = totals.select(c(sample).alias("a"), key, c(value).alias("x"))
    b = totals.select(c(sample).alias("b"), key, c(value).alias("y"))
    return a.join(b, key).filter("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"))


def assign_with_fallback(inside: DataFrame, points: DataFrame, distance: float) -> DataFrame:
    """Regions of points, those outside all taking the region of the nearest point inside one within the distance."""
    known = points.join(inside.filter("region <> 'None'"), points["id"] == inside["cell_id"], "left_semi")
    lost = points.join(inside.filter("region = 'None'"), points["id"] == inside["cell_id"], "left_semi")
    near = nearest_within(lost, known, distance)
    named = near.join(inside.select(c("cell_id").alias("dst"), c("region").alias("theirs")), "dst").select(c("src").alias("cell_id"), "theirs")
    return inside.join(named, "cell_id", "left").select("cell_id", F.coalesce("theirs", "region").alias("region"))


def domain_purity(df: DataFrame, domain: str, label: str) -> DataFrame:
    """(domain, purity, n) and, weighted by n, what the whole has: share of the most frequent label."""
    n = df.groupBy(domain, label).agg(F.count("*").alias("n"))
    return n.groupBy(domain).agg((F.max("n") / F.sum("n")).alias("purity"), F.sum("n").alias("n"))


def composition_against_expected(df: DataFrame, region: str, label: str) -> DataFrame:
    """(region, label, n, expected): counts and what independence of region and label would give."""
    n = df.groupBy(region, label).agg(F.count("*").alias("n"))
    a = F.sum("n").over(Window.partitionBy(region))
    b = F.sum("n").over(Window.partitionBy(label))
    t = F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row per pair
    return n.withColumn("expected", a * b / t)


def region_cohesion(values: DataFrame, regions: DataFrame, value: str = "n") -> DataFrame:
    """(region, cells, r): mean over a region's cells of the correlation, over all genes, of a cell's values with the region's mean.

    ``values`` are stored entries (sample, cell_id, feature_name); zeros come in by their number, so nothing is made dense. Cells whose
    values do not vary are left out.
    """
    genes = values.agg(F.countDistinct("feature_name").alias("k"))
    at = regions.select("sample", "cell_id", "region")
    size = at.groupBy("region").agg(F.count("*").alias("size"))
    v = values.select("sample", "cell_id", "feature_name", c(value).cast("double").alias("x")).join(at, ["sample", "cell_id"])
    mean = v.groupBy("region", "feature_name").agg(F.sum("x").alias("s")).join(F.broadcast(size), "region")  # a row per region
    mean = mean.select("region", "feature_name", (c("s") / c("size")).alias("m"))
    whole = mean.groupBy("region").agg(F.sum("m").alias("sm"), F.sum(c("m") * c("m")).alias("smm"))
    cell = v.join(mean, ["region", "feature_name"]).groupBy("region", "sample", "cell_id").agg(
        F.sum("x").alias("sx"), F.sum(c("x") * c("x")).alias("sxx"), F.sum(c("x") * c("m")).alias("sxm")
    )
    met = cell.join(F.broadcast(whole), "region").join(F.broadcast(genes))
    top = c("k") * c("sxm") - c("sx") * c("sm")
    spread = (c("k") * c("sxx") - c("sx") * c("sx")) * (c("k") * c("smm") - c("sm") * c("sm"))
    r = F.when(spread > 1e-9, top / F.sqrt(spread))
    return met.groupBy("region").agg(F.count(r).alias("cells"), F.avg(r).alias("r"))


def welch_between_regions(values: DataFrame, regions: DataFrame, value: str = "n") -> DataFrame:
    """(feature_name, a, b, t, df): Welch's test of every gene between all pairs of regions a < b, zeros included."""
    at = regions.select("sample", "cell_id", "region")
    size = at.groupBy("region").agg(F.count("*").cast("double").alias("k")).filter("k > 1")
    x = c(value).cast("double")
    s = values.join(at, ["sample", "cell_id"]).groupBy("region", "feature_name").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    every = s.select("feature_name").distinct().join(F.broadcast(size), how="cross")  # panel x regions
    m = every.join(s, ["region", "feature_name"], "left").na.fill(0.0, ["s", "q"])
    m = m.select("feature_name", "region", (c("s") / c("k")).alias("m"), "k", ((c("q") - c("s") * c("s") / c("k")) / (c("k") - 1) / c("k")).alias("v"))
    a, b = (m.select("feature_name", *[c(x).alias(x + i) for x in ("region", "m", "k", "v")]) for i in "ab")
    met = a.join(b, "feature_name").filter("regiona < regionb").withColumn("w", c("va") + c("vb"))
    df = c("w") * c("w") / (c("va") * c("va") / (c("ka") - 1) + c("vb") * c("vb") / (c("kb") - 1))
    fine = c("w") > 0
    return met.select(
        "feature_name",
        c("regiona").alias("a"),
        c("regionb").alias("b"),
        F.when(fine, (c("ma") - c("mb")) / F.sqrt("w")).alias("t"),
        F.when(fine, df).alias("df"),
    )
