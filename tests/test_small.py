"""Small operators: order of input, heat vectors, models from descriptions, null distributions."""

import pytest

from sylva.operators import clusters as K, collections as C, measures as M
from sylva.operators.place import Model
from sylva.plans import profile as P
from sylva.plans.tree import edges_frame, parse_newick
from sylva.sources.drawings import heat_vector


def test_order_of_input(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "sample string, v int")
    assert [r["sample"] for r in M.in_order(df, ["c", "a"]).collect()] == ["c", "a", "b", "d"]


def test_heat_vector():
    root = parse_newick("(a:1,b:1);")
    assert heat_vector(root, [1.0, -1.0, 0.0])[0]["color"] == (255, 0, 0)
    with pytest.raises(ValueError):
        heat_vector(root, [1.0])


def test_models_from_descriptions():
    rates = {"ac": 1.0, "ag": 2.0, "at": 1.0, "cg": 1.0, "ct": 2.0, "gt": 1.0}
    gamma = Model.from_description({"datatype": "DNA", "subs_model": "GTR", "ras_model": "gamma", "gamma": {"alpha": 0.7, "n_cats": 4}, "subs_rates": rates}, frequencies=[0.4, 0.1, 0.1, 0.4])
    assert gamma.classes == 4 and abs(gamma.rates.mean() - 1) < 1e-9 and abs(gamma.frequencies[0] - 0.4) < 1e-12
    cat = Model.from_description({"datatype": "DNA", "subs_model": "GTR", "ras_model": "Price-CAT", "Price-CAT": {"Rates": [0.5, 2.0], "SiteCategories": [1, 2, 2]}, "subs_rates": rates})
    assert cat.classes == 1 and cat.site_class.tolist() == [0, 1, 1]
    for bad in ({"ras_model": "x"}, {"ras_model": "gamma", "datatype": "DNA", "subs_model": "HKY"}, {"ras_model": "gamma", "datatype": "AA", "subs_model": "WAG"}):
        with pytest.raises(ValueError):
            Model.from_description(bad)


def test_missing_criterion(spark):
    df = spark.createDataFrame([("s", 1, 0.5), ("s", 2, None)], "sample string, pq_id long, post_prob double")
    assert P.required(df.where("pq_id = 1"), "post_prob").count() == 1
    with pytest.raises(Exception, match="no post_prob"):
        P.required(df, "post_prob").collect()


def test_null_distribution(spark):
    edges = edges_frame(spark, parse_newick("((a:1,b:2):1,c:3);"))
    rows = [(s, k, k % 3, 0.0, 1 / 6) for s in "xy" for k in range(6)]
    units = spark.createDataFrame(rows, "sample string, pq_id long, loc int, pos double, m double")
    null = K.shuffle_null(units, edges, "x", "y", 20).collect()
    assert len(null) == 20 and all(r.z >= 0 for r in null)
    assert K.shuffle_p_values(units, edges, "x", "y", 20) == (0.0, 1.0)
    assert K.one_sided(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "value double"), 3.0).first().p == 0.5


def test_averaged_widths(spark):
    units = spark.createDataFrame([("x", 0, 0.0, 1.0), ("y", 0, 0.0, 1.0), ("y", 1, 0.0, 3.0)], "sample string, loc int, pos double, m double")
    got = {r.edge: (r.m, r.width) for r in M.edge_widths(units, edges_frame(spark, parse_newick("(a:1,b:1);")), average=True).collect()}
    assert got == {0: (0.625, 187.5), 1: (0.375, 112.5)}


def test_taxa_at_the_cutoff_in_any_order(spark):
    lineage = spark.createDataFrame([("a", "A")], "tax_id string, anc_tax_id string")
    found = []
    for weights in ([0.1, 0.2, 0.3, 0.4], [0.3, 0.4, 0.2, 0.1]):
        rows = [("x", 1, "a" if w < 0.4 else "b", w) for w in weights]
        placed = spark.createDataFrame(rows, "sample string, pq_id long, classification string, ml_ratio double").coalesce(1)
        found.append(C.filter_taxa(placed, lineage, ["A"], 0.6).count())
    assert found == [0, 0]
