import pytest
from compare import compare

from routeloom import catalog
from routeloom.session import table

SF = "/root/testdata/sf0.001"
NAMES = ["ancestor_closure", "min_depth_intern", "route_best", "json_report", "stock_exclude_target", "typed_scan", "dual_tower_features", "ragged_filter", "simplifying_filter_relabel", "cycle_reject"]


@pytest.mark.parametrize("name", NAMES)
def test_equals_duckdb(spark, name):
    got, want, _, _ = compare(spark, name, SF)
    assert got == want and len(got[1]) > 0


def test_search_takes_every_part(spark):
    parts = {str(r.p_partkey) for r in table(spark, SF, "part").select("p_partkey").collect()}
    for name in ("bfs_rounds", "retrostar_plan", "mcts_plan"):
        rows = catalog.QUERIES[name](spark, SF).collect()
        assert len(rows) == len(parts) and {r.target for r in rows} == parts, name
    assert {r.target for r in catalog.QUERIES["route_trees"](spark, SF).select("target").distinct().collect()} == parts


def test_signs_of_zeros(spark):
    """compare() takes -0.0 for 0.0; the SQL does not."""
    from compare import oracle_rows

    for sf_dir in (SF, SF.replace("0.001", "0.01")):
        got = {r.vec_id: repr([x for x in r.features]) for r in catalog.QUERIES["dual_tower_features"](spark, sf_dir).collect()}
        want = {k: repr(x) for k, x in oracle_rows(catalog.ORACLE["dual_tower_features"], sf_dir)[2]}
        assert got == want and any("-0.0," in x for x in want.values())
