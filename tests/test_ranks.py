"""Ranks over slices against ranks by sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave import catalog
from cellweave.operators import metrics, ranks
from tests.oracle import differences, views

SF = "/root/testdata/sf0.001"


def rows(n=900, seed=0):
    """One group has all but a few rows, and one value a third of its rows; values may be missing."""
    rng = np.random.default_rng(seed)
    value = np.where(rng.random(n) < 1 / 3, 7.0, np.round(rng.normal(0, 30, n), 1))
    group = np.where(rng.random(n) < 0.95, "large", "small")
    return [(str(g), i, None if i % 50 == 49 else float(v)) for i, (g, v) in enumerate(zip(group, value))]


@pytest.mark.parametrize("descending", [False, True])
def test_average_ranks_equal_sorting(spark, descending):
    data = rows()
    df = spark.createDataFrame(data, "g string, id long, v double").repartition(7)
    got = {r.id: r.place for r in ranks.average_ranks(df, ["g"], "v", "place", descending).collect()}
    for g in ("large", "small"):
        mine = [(i, -np.inf if v is None else v) for name, i, v in data if name == g]
        v = np.array([x for _, x in mine]) * (-1 if descending else 1)
        want = [(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]
        assert [got[i] for i, _ in mine] == want
    assert len(got) == len(data)


def test_ordinal_ranks_are_cut_into_slices(spark):
    """No task sorts a group: the rows of one group lie in many slices, none of which has much more than its share."""
    data = rows(4000)
    df = spark.createDataFrame(data, "g string, id long, v double")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = [F.col("v").desc(), F.col("id")]
        got = ranks.ordinal_ranks(df, ["g"], order, "place").collect()
        sliced = df.repartitionByRange(F.col("g"), *order).groupBy("g", F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    key = lambda r: (np.inf if r[2] is None else -r[2], r[1])
    for g in ("large", "small"):
        mine = sorted((r for r in data if r[0] == g), key=key)
        place = {r.id: r.place for r in got if r.g == g}
        assert [place[r[1]] for r in mine] == list(range(1, len(mine) + 1))
    assert max(r["count"] for r in sliced) <= 2.5 * 4000 / spark.sparkContext.defaultParallelism


def test_spearman_of_one_large_group(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, 500).astype(float)
    y = x + rng.integers(0, 6, 500)
    df = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y)], "g string, x double, y double")

    def rank(v):
        return np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])

    assert metrics.spearman(df, ["g"], "x", "y").first().spearman == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


@pytest.mark.parametrize("name", ["v15_spearman", "n7_binary_enrichment", "j4_anti_join"])
def test_queries_equal_sql(spark, name):
    assert differences(spark, views(SF), name, catalog.queries()[name], catalog.oracle_sql()[name], SF) == ""
    assert catalog.queries()[name](spark, SF).count() > 0
