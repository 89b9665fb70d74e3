import pytest
from compare import compare

from routeloom import catalog

SF = "/root/testdata/sf0.001"
#: One of each family here; tests/compare.py runs all of them.
NAMES = ["stock_membership_flag", "component_split", "softmax_topk", "rank_prob_center", "plausibility_filter", "cache_readthrough", "andor_solved", "route_metrics", "evolve_relax", "molecule_report", "running_rate", "wilcoxon", "threshold_sweep"]


@pytest.mark.parametrize("name", NAMES)
def test_equals_duckdb(spark, name):
    got, want, _, _ = compare(spark, name, SF)
    assert got == want


def test_registry():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.QUERIES
