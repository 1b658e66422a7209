"""Agreement of labelings, purity, efficiency and imputation scores, all from contingency counts and grouped sums."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.scalar import ratio
from cellweave.operators.qc import coexpression
from cellweave.operators.ranks import average_ranks

c = F.col


def _pairs(x: Column) -> Column:
    return x * (x - 1) / 2


def agreement(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Entropies, mutual information, VI, NMI (arithmetic mean), FMI and ARI of two labelings, one row per group of ``by``."""
    by = by or []
    n = df.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    rows = n.groupBy(*by, a).agg(F.sum("n").alias("n"))
    cols = n.groupBy(*by, b).agg(F.sum("n").alias("n"))

    def summary(x: DataFrame, tag: str) -> DataFrame:
        return x.groupBy(*by).agg(
            F.sum(c("n") * F.log("n")).alias(f"e_{tag}"),
            F.sum(_pairs(c("n"))).alias(f"p_{tag}"),
            F.sum(c("n") * c("n")).alias(f"q_{tag}"),
            *([F.sum("n").alias("total")] if tag == "ab" else []),
        )

    parts = [summary(n, "ab"), summary(rows, "a"), summary(cols, "b")]
    met = reduce(lambda x, y: x.join(y, by) if by else x.join(y), parts)  # single rows where there is no group
    t = c("total").cast("double")
    ha, hb = F.log(t) - c("e_a") / t, F.log(t) - c("e_b") / t
    hab = F.log(t) - c("e_ab") / t
    mi = ha + hb - hab
    expected = c("p_a") * c("p_b") / _pairs(t)
    ari = ratio(c("p_ab") - expected, (c("p_a") + c("p_b")) / 2 - expected, 1.0)
    return met.select(
        *by,
        ha.alias("entropy_a"),
        hb.alias("entropy_b"),
        mi.alias("mutual_information"),
        (ha + hb - 2 * mi).alias("vi"),
        ratio(mi, (ha + hb) / 2, 1.0).alias("nmi"),
        ratio((c("q_ab") - t), F.sqrt((c("q_a") - t) * (c("q_b") - t)), 0.0).alias("fmi"),
        ari.alias("ari"),
    )


def pairwise_ari(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, ari) for all pairs of label columns; a null label is a class of its own, as background is."""
    filled = df.select(*[F.coalesce(c(x).cast("string"), F.lit("")).alias(x) for x in columns])
    out = []
    for a, b in combinations(columns, 2):
        out.append(agreement(filled, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "ari"))
    return reduce(DataFrame.unionByName, out)


def _class_means(counts: DataFrame, cells: DataFrame, min_cells: int) -> DataFrame:
    """(cell_type, feature_name, mean) over the full square of classes with enough cells and genes."""
    sizes = cells.groupBy("cell_type").agg(F.count("*").alias("size")).filter(c("size") >= min_cells)
    genes = counts.select("feature_name").distinct()
    sums = counts.join(cells.select("sample", "cell_id", "cell_type"), ["sample", "cell_id"])
    sums = sums.groupBy("cell_type", "feature_name").agg(F.sum("n").alias("s"), F.count("*").alias("k"))
    square = F.broadcast(sizes).join(genes, how="cross")  # classes x panel
    full = square.join(sums, ["cell_type", "feature_name"], "left").na.fill(0, ["s", "k"])
    return full.select("cell_type", "feature_name", (c("s") / c("size")).alias("mean"), (c("k") / c("size")).alias("share"))


def _purity(sp: DataFrame, sc: DataFrame, value: str, mask: str, limit: float) -> DataFrame:
    """(cell_type, feature_name, excess) of the entries that the reference says are negative: 1 - excess averages to purity."""
    a = sp.select("cell_type", "feature_name", c(value).alias("v_sp"))
    b = sc.select("cell_type", "feature_name", c(value).alias("v_sc"), c(mask).alias("m"))
    met = a.join(b, ["cell_type", "feature_name"]).filter(c("m") < limit)
    return met.select("cell_type", "feature_name", "v_sp", "v_sc")


def marker_purity(
    counts_sp: DataFrame,
    cells_sp: DataFrame,
    counts_sc: DataFrame,
    cells_sc: DataFrame,
    mode: str = "cells",
    min_cells: int = 10,
    limit: float = 0.005,
) -> tuple[DataFrame, DataFrame]:
    """Purity (one row; null without at least two classes or any negative entry) and the entries it comes from.

    Mode 'cells' compares shares of positive cells; 'reads' compares the class's share of the gene's mean, and takes entries whose
    mean is under ``limit`` of the gene's mean over classes. Classes need enough cells in both datasets, each counted in its own.
    """
    return purity_of_means(*shared_means(counts_sp, cells_sp, counts_sc, cells_sc, min_cells), mode, limit)


def shared_means(
    counts_sp: DataFrame, cells_sp: DataFrame, counts_sc: DataFrame, cells_sc: DataFrame, min_cells: int = 10
) -> tuple[DataFrame, DataFrame]:
    """(cell_type, feature_name, mean, share) of both datasets, over the genes and classes of both; classes need enough cells."""
    shared = counts_sp.select("feature_name").distinct().intersect(counts_sc.select("feature_name").distinct())
    sp = _class_means(counts_sp.join(shared, "feature_name", "left_semi"), cells_sp, min_cells)
    sc = _class_means(counts_sc.join(shared, "feature_name", "left_semi"), cells_sc, min_cells)
    both = sp.select("cell_type").distinct().intersect(sc.select("cell_type").distinct())
    return tuple(x.join(both, "cell_type", "left_semi") for x in (sp, sc))


def purity_of_means(sp: DataFrame, sc: DataFrame, mode: str = "cells", limit: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """:func:`marker_purity` from the means of :func:`shared_means`."""
    both = sp.select("cell_type").distinct().intersect(sc.select("cell_type").distinct())
    if mode == "reads":
        w = Window.partitionBy("feature_name")  # one row per class
        sp = sp.withColumn("value", ratio(c("mean"), F.sum("mean").over(w), 0.0))
        sc = sc.withColumns(
            {"value": ratio(c("mean"), F.sum("mean").over(w), 0.0), "mask": ratio(c("mean"), F.avg("mean").over(w), 0.0)}
        )
        entries = _purity(sp, sc, "value", "mask", limit)
    else:
        entries = _purity(sp.withColumn("value", c("share")), sc.withColumns({"value": c("share"), "mask": c("share")}), "value", "mask", limit)
    classes = both.agg(F.count("*").alias("classes"))
    score = entries.agg(F.avg("v_sp").alias("a"), F.avg("v_sc").alias("b")).join(classes)
    purity = F.when(c("classes") >= 2, 1 - F.greatest(c("a") - c("b"), F.lit(0.0)))
    return score.select(purity.alias("purity")), entries


def purity_by(entries: DataFrame, key: str) -> DataFrame:
    """1 less the excess over the reference, not under 0, per gene or per class."""
    return entries.groupBy(key).agg((1 - F.greatest(F.avg("v_sp") - F.avg("v_sc"), F.lit(0.0))).alias("purity"))


def coexpression_purity(counts_sp: DataFrame, counts_sc: DataFrame, limit: float = 0.05) -> DataFrame:
    """1 less the mean excess of co-expression over gene pairs that the reference hardly shows together."""
    a = coexpression(counts_sp).withColumnRenamed("p", "p_sp")
    b = coexpression(counts_sc).withColumnRenamed("p", "p_sc").filter(c("p_sc") < limit)
    met = a.join(b, ["g", "h"])
    return met.agg((1 - F.avg(F.greatest(c("p_sp") - c("p_sc"), F.lit(0.0)))).alias("purity"))


def efficiency(counts: DataFrame, method: str, reference: str, min_reads: int = 1) -> DataFrame:
    """(method, feature_name, ratio): mean count above the limit on a platform over the median of those on the reference."""
    high = counts.filter(c("n") > min_reads)
    ref = high.filter(c(method) == reference).groupBy("feature_name").agg(F.median("n").alias("ref"))
    own = high.filter(c(method) != reference).groupBy(method, "feature_name").agg(F.avg("n").alias("mean"))
    return own.join(ref, "feature_name").select(method, "feature_name", (c("mean") / c("ref")).alias("ratio"))


def pairwise_efficiency(counts: DataFrame, n_cells: DataFrame, method: str) -> DataFrame:
    """(a, b, mean, median) of the ratio b / a of mean counts per cell times 100 over the genes that both platforms have."""
    m = counts.groupBy(method, "feature_name").agg(F.sum("n").alias("s")).join(n_cells, method)
    m = m.select(c(method).alias("m"), "feature_name", (c("s") / c("cells") * 100).alias("v"))
    a = m.select(c("m").alias("a"), "feature_name", c("v").alias("va"))
    b = m.select(c("m").alias("b"), "feature_name", c("v").alias("vb"))
    met = a.join(b, "feature_name").filter("a < b").withColumn("r", c("vb") / c("va"))
    return met.groupBy("a", "b").agg(F.avg("r").alias("mean"), F.median("r").alias("median"))


def ks_two_sample(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """Largest distance of two empirical distributions, and the asymptotic p; equal values are pre-aggregated."""
    counted = df.filter(c(group).isin(a, b)).groupBy(value).agg(
        F.sum((c(group) == a).cast("long")).alias("na"), F.sum((c(group) == b).cast("long")).alias("nb")
    )
    total = counted.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    met = counted.join(F.broadcast(total))
    gaps = running_difference(met, value)
    d = gaps.agg(F.max("gap").alias("d")).join(total)
    n = c("ta") * c("tb") / (c("ta") + c("tb"))
    x = c("d") * F.sqrt(n)
    p = reduce(lambda s, k: s + 2 * (-1) ** (k - 1) * F.exp(-2 * k * k * x * x), range(1, 101), F.lit(0.0))
    return d.select("d", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("pval"))


def running_difference(df: DataFrame, value: str, slices: int = 64) -> DataFrame:
    """|Fa - Fb| at every value. Values are cut into slices of equal width, so running sums need no single sorted task: the sums of
    earlier slices are added to those inside a slice."""
    lim = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    width = (c("high") - c("low")) / slices
    s = df.join(F.broadcast(lim)).withColumn(
        "slice", F.when(width > 0, F.least(F.floor((c(value) - c("low")) / width), F.lit(slices - 1))).otherwise(0).cast("int")
    )
    per = s.groupBy("slice").agg(F.sum("na").alias("sa"), F.sum("nb").alias("sb"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    start = per.select(
        "slice",
        F.coalesce(F.sum("sa").over(before), F.lit(0)).alias("a0"),
        F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("b0"),
    )
    w = Window.partitionBy("slice").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = s.join(F.broadcast(start), "slice")
    fa = (c("a0") + F.sum("na").over(w)) / c("ta")
    fb = (c("b0") + F.sum("nb").over(w)) / c("tb")
    return met.select(value, F.abs(fa - fb).alias("gap"))


def imputation_scores(truth: DataFrame, guess: DataFrame, n_cells: int) -> DataFrame:
    """(feature_name, pcc, ssim, js, rmse) from long matrices (sample, cell_id, feature_name, n).

    SSIM is global over values scaled by the gene's maximum, JS over values scaled to a distribution, RMSE over z-scores. A gene
    that was not imputed scores 0, 0, 1 and 1.5; undefined values are 1e-20.
    """
    n = F.lit(float(n_cells))
    keys = ["sample", "cell_id", "feature_name"]
    t = truth.select(*keys, c("n").cast("double").alias("x"))
    g = guess.select(*keys, c("n").cast("double").alias("y"))
    met = t.join(g, keys, "full").na.fill(0.0, ["x", "y"])
    tot = met.groupBy("feature_name").agg(
        F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.max("x").alias("mx"), F.max("y").alias("my")
    )
    m = met.join(tot, "feature_name").withColumns({"p": ratio(c("x"), c("sx"), 0.0), "q": ratio(c("y"), c("sy"), 0.0)})
    mid = (c("p") + c("q")) / 2
    js = F.when(c("p") > 0, c("p") * F.log(c("p") / mid)).otherwise(0.0) + F.when(c("q") > 0, c("q") * F.log(c("q") / mid)).otherwise(0.0)
    s = m.groupBy("feature_name").agg(
        *[F.first(k).alias(k) for k in ("sx", "sy", "mx", "my")],
        F.sum(c("x") * c("x")).alias("sxx"),
        F.sum(c("y") * c("y")).alias("syy"),
        F.sum(c("x") * c("y")).alias("sxy"),
        F.sum(js).alias("js2"),
    )
    vx, vy = c("sxx") / n - F.pow(c("sx") / n, 2), c("syy") / n - F.pow(c("sy") / n, 2)
    cov = c("sxy") / n - c("sx") * c("sy") / (n * n)
    pcc = ratio(cov, F.sqrt(vx * vy))
    ax, ay = c("sx") / n / c("mx"), c("sy") / n / c("my")
    sx2, sy2, sxy = vx / F.pow("mx", 2), vy / F.pow("my", 2), cov / (c("mx") * c("my"))
    k1, k2 = 0.01**2, 0.03**2
    ssim = ((2 * ax * ay + k1) * (2 * sxy + k2)) / ((ax * ax + ay * ay + k1) * (sx2 + sy2 + k2))
    rmse = F.sqrt(F.greatest(2 - 2 * pcc, F.lit(0.0)))  # of z-scores with ddof 0
    known = guess.select("feature_name").distinct().withColumn("known", F.lit(True))
    out = s.filter(c("sx") > 0).join(known, "feature_name", "left")
    pick = lambda v, missing: F.when(c("known").isNull(), missing).otherwise(F.coalesce(v, F.lit(1e-20)))
    return out.select(
        "feature_name",
        pick(pcc, 0.0).alias("pcc"),
        pick(ssim, 0.0).alias("ssim"),
        pick(F.sqrt(F.greatest(c("js2") / 2, F.lit(0.0))), 1.0).alias("js"),
        pick(rmse, 1.5).alias("rmse"),
    )


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks within groups, which may be of any size."""
    rows = df.select(*by, c(x).alias("__a"), c(y).alias("__b"))
    r = average_ranks(average_ranks(rows, by, "__a", "__x"), by, "__b", "__y")
    return r.groupBy(*by).agg(F.corr("__x", "__y").alias("spearman"))


def tool_ranking(scores: DataFrame) -> DataFrame:
    """(tool, score): mean over metrics of the tools' ordinal ranks divided by the number of tools; 1 is best.

    ``scores`` has tool, pcc, ssim, js, rmse; nulls count as 0, PCC and SSIM are better high, JS and RMSE better low.
    """
    s = scores.na.fill(0.0)
    n = F.count("*").over(Window.partitionBy(F.lit(1)))  # one row per tool
    parts = []
    for m, high in (("pcc", True), ("ssim", True), ("js", False), ("rmse", False)):
        order = Window.partitionBy(F.lit(1)).orderBy(c(m).asc() if high else c(m).desc(), c("tool"))
        parts.append(F.row_number().over(order) / n)
    return s.select("tool", (reduce(lambda a, b: a + b, parts) / 4).alias("score"))


def one_change_away(grid: DataFrame, default: dict[str, object]) -> DataFrame:
    """Parameter rows that differ from the default in one parameter at most."""
    changed = reduce(lambda a, b: a + b, [(~c(k).eqNullSafe(F.lit(v))).cast("int") for k, v in default.items()])
    return grid.filter(changed <= 1)
