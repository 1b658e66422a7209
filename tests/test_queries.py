"""Queries against their SQL twins on the smallest tables, and the contract of the registry."""

import pytest

import __spark_entry__ as entry
from cellweave import catalog
from tests.oracle import differences, views

SF = "/root/testdata/sf0.001"
SOME = (
    "flagship a4_a5_a6_per_cell_summary a17_expansion_curve a19_majority_vote a26_coexpression p5_cell_cap j2_map_lookup "
    "j5_point_in_polygon j8_radius_join j9_knn j16_border_distance w1_average_rank w9_false_discovery x6_variable_genes "
    "x10_rank_genes_wilcoxon n5_n6_autocorrelation g4_kernel_density v1_v2_agreement k9_region_fallback f1_f14_scalars v4_silhouette "
    "k10_region_cohesion k10_region_welch e2_segmentation_free"
).split()


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", SOME)
def test_equal_to_sql(spark, con, name):
    assert differences(spark, con, name, catalog.queries()[name], catalog.oracle_sql()[name], SF) == ""


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.queries()) > 120


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_gene_is_left_out(spark):
    assert sorted(r.gene for r in catalog.queries()["i4_leave_one_out"](spark, SF).collect()) == list(range(32))


def test_sweep_has_every_run(spark):
    from cellweave.plans.pipeline import SWEEP

    rows = catalog.queries()["v19_v20_e6_sweep"](spark, SF).collect()
    assert len({r.run for r in rows}) == 1 + sum(len(v) - 1 for v in SWEEP.values()) == 16
    assert len({(r.run, r.kind) for r in rows}) == len(rows) == 32
    assert all(-1 <= r.silhouette <= 1 for r in rows)
    assert all(r.ari == 1 for r in rows if r.run == "default")


def test_line_items_are_shuffled_twice_at_most(spark):
    """Orders meet the cells first; only orders and parts meet line items."""
    from cellweave.plans.fixtures import reads

    plan = reads(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [i for i, line in enumerate(plan) if "Join" in line]
    item = next(i for i, line in enumerate(plan) if "l_orderkey" in line and "Relation" in line)
    depth = lambda i: len(plan[i]) - len(plan[i].lstrip(" :+-"))
    above, least = [], depth(item)
    for i in reversed(range(item)):
        if depth(i) < least:
            least = depth(i)
            above += [i] if i in joins else []
    assert len(above) == 2
