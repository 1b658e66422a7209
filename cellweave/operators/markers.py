"""Marker ranking and gene-set scores on long matrices, zeros included in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.ranking import arg_max
from cellweave.functions.scalar import ratio
from cellweave.operators.reads import seeded_order


def _group_sums(values: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """(cell_type, feature_name, n1, s1, q1, n2, s2, q2): size, sum and sum of squares of a group and of the rest."""
    v = F.col(value).cast("double")
    typed = values.join(cells.select("sample", "cell_id", "cell_type"), ["sample", "cell_id"])
    g = typed.groupBy("cell_type", "feature_name").agg(F.sum(v).alias("s1"), F.sum(v * v).alias("q1"))
    sizes = cells.groupBy("cell_type").agg(F.count("*").alias("n1"))
    total = F.sum("n1").over(Window.partitionBy(F.lit(1)))  # one row per class
    sizes = sizes.withColumn("n_all", total)
    genes = g.groupBy("feature_name").agg(F.sum("s1").alias("s_all"), F.sum("q1").alias("q_all"))
    full = genes.join(F.broadcast(sizes), how="cross").join(g, ["cell_type", "feature_name"], "left").na.fill(0.0, ["s1", "q1"])
    return full.select(
        "cell_type",
        "feature_name",
        "n1",
        "s1",
        "q1",
        (F.col("n_all") - F.col("n1")).alias("n2"),
        (F.col("s_all") - F.col("s1")).alias("s2"),
        (F.col("q_all") - F.col("q1")).alias("q2"),
    )


def rank_genes_t(values: DataFrame, cells: DataFrame, value: str = "n") -> DataFrame:
    """Welch t of each class against the rest, per gene."""
    s = _group_sums(values, cells, value)
    for k in ("1", "2"):
        n, a, q = F.col(f"n{k}"), F.col(f"s{k}"), F.col(f"q{k}")
        s = s.withColumns({f"m{k}": a / n, f"v{k}": F.greatest((q - a * a / n) / (n - 1), F.lit(0.0)) / n})
    t = ratio(F.col("m1") - F.col("m2"), F.sqrt(F.col("v1") + F.col("v2")), 0.0)
    df = ratio(
        F.pow(F.col("v1") + F.col("v2"), 2),
        F.pow("v1", 2) / (F.col("n1") - 1) + F.pow("v2", 2) / (F.col("n2") - 1),
        0.0,
    )
    return s.select("cell_type", "feature_name", t.alias("t"), df.alias("df"), "m1", "m2")


def rank_genes_wilcoxon(values: DataFrame, cells: DataFrame, value: str = "n") -> DataFrame:
    """Rank-sum z of each class against the rest, per gene, without tie correction.

    Equal values are pre-aggregated, so ranks are running sums over distinct values; all zeros are one tie block.
    """
    typed = values.join(cells.select("sample", "cell_id", "cell_type"), ["sample", "cell_id"])
    sizes = cells.groupBy("cell_type").agg(F.count("*").alias("n1"))
    sizes = sizes.withColumn("n_all", F.sum("n1").over(Window.partitionBy(F.lit(1))))
    mine = typed.groupBy("feature_name", value, "cell_type").agg(F.count("*").alias("k"))
    every = mine.groupBy("feature_name", value).agg(F.sum("k").alias("k_all"))
    w = Window.partitionBy("feature_name").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    nnz = F.sum("k_all").over(Window.partitionBy("feature_name"))
    ranked = every.select(
        "feature_name",
        value,
        nnz.alias("nnz"),
        (F.coalesce(F.sum("k_all").over(w), F.lit(0)) + (F.col("k_all") + 1) / 2).alias("place"),
    )
    in_class = (
        mine.join(ranked, ["feature_name", value])
        .groupBy("cell_type", "feature_name")
        .agg(F.sum(F.col("k") * F.col("place")).alias("places"), F.sum("k").alias("nnz1"))
    )
    genes = ranked.select("feature_name", "nnz").distinct()
    full = genes.join(F.broadcast(sizes), how="cross").join(in_class, ["cell_type", "feature_name"], "left")
    full = full.na.fill(0.0, ["places"]).na.fill(0, ["nnz1"])
    zeros = F.col("n_all") - F.col("nnz")
    total = F.col("places") + F.col("nnz1") * zeros + (F.col("n1") - F.col("nnz1")) * (zeros + 1) / 2
    n1, n = F.col("n1"), F.col("n_all")
    z = (total - n1 * (n + 1) / 2) / F.sqrt(n1 * (n - n1) * (n + 1) / 12)
    return full.select("cell_type", "feature_name", z.alias("z"))


def set_scores(
    lognorm: DataFrame, cells: DataFrame, sets: dict[str, list[str]], bins: int = 5, per_gene: int = 5, seed: int = 0
) -> DataFrame:
    """(sample, cell_id, set, score): mean of the set's genes less that of control genes of the same expression bins.

    Controls are the first ``per_gene`` genes of a bin in hash order that no set gene is; absent genes are dropped.
    """
    spark = lognorm.sparkSession
    rows = [(s, g) for s, genes in sets.items() for g in genes]
    members = spark.createDataFrame(rows, "set string, feature_name string")
    means = lognorm.groupBy("feature_name").agg(F.sum("lognorm").alias("total"))
    binned = means.withColumn("bin", F.ntile(bins).over(Window.orderBy("total", "feature_name")))  # panel-sized
    present = members.join(binned, "feature_name").select("set", "feature_name", "bin")
    order = Window.partitionBy("set", "bin").orderBy(seeded_order(seed, "feature_name"), "feature_name")
    wanted = present.groupBy("set", "bin").agg(F.count("*").alias("k"))
    own = present.select(F.col("set").alias("s2"), F.col("feature_name").alias("g2"))
    controls = (
        wanted.join(binned, "bin")
        .join(own, (F.col("set") == F.col("s2")) & (F.col("feature_name") == F.col("g2")), "left_anti")
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= F.col("k") * per_gene)
        .select("set", "feature_name")
    )
    roles = present.select("set", "feature_name", F.lit(1).alias("role")).unionByName(
        controls.select("set", "feature_name", F.lit(0).alias("role"))
    )
    size = roles.groupBy("set").agg(
        F.sum("role").alias("n_in"), F.sum(1 - F.col("role")).alias("n_out")
    )
    sums = (
        lognorm.join(F.broadcast(roles), "feature_name")
        .groupBy("sample", "cell_id", "set")
        .agg(F.sum(F.col("lognorm") * F.col("role")).alias("a"), F.sum(F.col("lognorm") * (1 - F.col("role"))).alias("b"))
    )
    full = cells.select("sample", "cell_id").join(F.broadcast(size), how="cross")
    met = full.join(sums, ["sample", "cell_id", "set"], "left").na.fill(0.0, ["a", "b"])
    score = ratio(F.col("a"), F.col("n_in"), 0.0) - ratio(F.col("b"), F.col("n_out"), 0.0)
    return met.select("sample", "cell_id", "set", score.alias("score"))


def label_hints(scores: DataFrame) -> DataFrame:
    return arg_max(scores, ["sample", "cell_id"], "set", "score")


def positive_reads(counts_by_method: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """Reads and genes per cell of every platform, of all genes or of the given ones."""
    kept = counts_by_method if genes is None else counts_by_method.join(genes, "feature_name", "left_semi")
    return kept.groupBy("method", "sample", "cell_id").agg(
        F.sum("n").alias("reads"), F.count("*").alias("genes")
    )


def marker_cluster(counts: DataFrame, cells: DataFrame, markers: list[str]) -> DataFrame:
    """Expression of the markers in the class with the highest mean of the first marker."""
    from cellweave.operators.qc import signatures

    s = signatures(counts, cells)
    first = s.filter(F.col("feature_name") == markers[0]).withColumn("one", F.lit(1))
    best = arg_max(first, ["one"], "cell_type", "mean").select("cell_type")
    return s.filter(F.col("feature_name").isin(markers)).join(F.broadcast(best), "cell_type", "left_semi")


def name_clusters(reads: DataFrame, cluster: str, label: str) -> DataFrame:
    """``id_label_part``: the cluster's most frequent label, and nuclei or cyto by its share of nuclear reads."""
    n = reads.groupBy(cluster, label).agg(F.count("*").alias("n"), F.sum("overlaps_nucleus").alias("nuclear"))
    best = F.min_by(label, F.struct((-F.col("n")).alias("n"), F.col(label).alias("l")))
    out = n.groupBy(cluster).agg(best.alias("label"), (F.sum("nuclear") / F.sum("n")).alias("inside"))
    part = F.when(F.col("inside") > 0.5, "nuclei").otherwise("cyto")
    return out.select(cluster, F.concat_ws("_", F.col(cluster).cast("string"), "label", part).alias("name"))
