"""Published values of the measures on a four-leaf tree."""

import json
import math

import pytest

from sylva.operators import collections as C, measures as M, pairs as X
from sylva.plans import profile as P
from sylva.sources.placefiles import read_any, read_documents, write_documents

# The tree, the places and the results of the published example; names and likelihoods are ours.
TREE = "((A:2[0],B:9[1]):7[2],C:5[3],D:1[4]):0[5];"
FIELDS = ["edge_num", "likelihood", "like_weight_ratio", "distal_length", "pendant_length"]
RUNS = {
    "test1": [([[0, -7.5, 1.0, 1.0, 10.0]], ["a1"]), ([[1, -7.5, 1.0, 2.0, 10.0]], ["a2"])],
    "test2": [([[3, -7.5, 1.0, 4.0, 10.0]], ["b1"]), ([[3, -7.5, 1.0, 0.0, 10.0]], ["b2"])],
    "test3": [([[2, -7.5, 1.0, 2.0, 10.0]], ["c1"])],
}


def document(rows):
    return json.dumps({"tree": TREE, "placements": [{"p": p, "n": n} for p, n in rows], "metadata": {}, "version": 1, "fields": FIELDS})


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("runs")
    for name, rows in RUNS.items():
        (folder / f"{name}.jplace").write_text(document(rows))
    return read_documents(spark, [str(folder / f"{n}.jplace") for n in RUNS])


def table(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


@pytest.mark.parametrize(("p", "want"), [(0.5, (0.686887, 0.319036, 0.367851)), (1.0, (0.583333, 0.25, 0.333333)), (2.0, (0.677003, 0.408248, 0.540062))])
def test_distances(runs, p, want):
    prof = P.profile(P.mass(runs.placements), runs.edges)
    found = table(M.kr_distance(prof, p, 24.0), "sample1", "sample2")
    for pair, value in zip((("test1", "test2"), ("test1", "test3"), ("test2", "test3")), want, strict=True):
        assert abs(found[pair].distance - value) < 1e-5


def test_unifrac(runs):
    found = table(M.unifrac(P.profile(P.mass(runs.placements), runs.edges)), "sample1", "sample2")
    assert [round(found[k].unifrac, 6) for k in (("test1", "test2"), ("test1", "test3"), ("test2", "test3"))] == [1.0, 0.666667, 1.0]


def test_diversity(runs):
    found = table(M.diversity(P.profile(P.mass(runs.placements, point=True), runs.edges), (0.5,)), "sample")
    assert [found[(s,)].unrooted_pd for s in ("test1", "test2")] == [8.0, 4.0]
    assert [found[(s,)].bwpd_1 for s in ("test1", "test2")] == [8.0, 4.0]
    assert [round(found[(s,)].bwpd_0_5, 5) for s in ("test1", "test2")] == [8.0, 4.0]
    with pytest.raises(ValueError):
        M.diversity(runs.placements, (2.0,))


def test_barycenter(runs):
    found = table(M.barycenter(P.mass(runs.placements), runs.edges), "sample")
    # two equal masses: halfway between them
    assert (found[("test1",)].edge, round(found[("test1",)].pos, 9)) == (1, 6.0)
    assert (found[("test2",)].edge, round(found[("test2",)].pos, 9)) == (3, 2.0)
    assert (found[("test3",)].edge, round(found[("test3",)].pos, 9)) == (2, 2.0)


def test_edpl(spark, tmp_path):
    (tmp_path / "four.jplace").write_text(document([([[0, -1.0, 0.3, 0.0, 10.0], [1, -1.0, 0.2, 6.0, 10.0], [2, -1.0, 0.5, 1.0, 10.0]], ["four"])]))
    run = read_documents(spark, str(tmp_path / "four.jplace"))
    assert abs(X.edpl(run.placements, run.edges).first().edpl - 2.3) < 1e-9


def test_rarefaction_mean(spark, runs):
    both = runs.placements.where("sample IN ('test1', 'test3')")
    merged = C.merge([both]).drop("sample").withColumn("sample", P.F.lit("m"))
    found = {r.k: r for r in M.rarefaction(merged, runs.edges, 3).collect()}
    assert found[2].rooted >= found[2].unrooted > 0 and found[3].rooted > found[2].rooted


def test_round_trip(spark, runs, tmp_path):
    fields = write_documents(runs, str(tmp_path / "out"))
    assert fields == sorted(FIELDS)
    text = next((tmp_path / "out" / "sample=test1").glob("part-*")).read_text()
    parsed = json.loads(text)
    assert parsed["version"] == 3 and len(parsed["placements"]) == 2
    (tmp_path / "again.jplace").write_text(text)
    again = read_any(spark, str(tmp_path / "again.jplace"))
    assert sorted(map(tuple, again.placements.select("loc", "ml_ratio", "distal_bl").collect())) == [(0, 1.0, 1.0), (1, 1.0, 2.0)]
    assert sorted(map(tuple, again.names.select("name", "mass").collect())) == [("a1", 1.0), ("a2", 1.0)]


def test_bad_documents(spark, tmp_path):
    (tmp_path / "a.jplace").write_text(json.dumps({"tree": TREE, "version": 9, "fields": FIELDS, "placements": [{"p": [[0, 1, 1, 0, 0]], "n": "x"}]}))
    (tmp_path / "b.jplace").write_text(json.dumps({"tree": TREE, "version": 3, "fields": FIELDS, "placements": []}))
    for name in ("a", "b"):
        with pytest.raises(ValueError):
            read_documents(spark, str(tmp_path / f"{name}.jplace"))
    with pytest.raises(ValueError):
        read_any(spark, "x.txt")


def test_overlap_islands_and_adcl(spark, runs):
    rows = [("s", 1, 0, 0.5, 0.5), ("s", 1, 1, 0.5, 1.0), ("s", 2, 1, 1.0, 1.0), ("s", 3, 4, 1.0, 0.25)]
    placed = spark.createDataFrame(rows, "sample string, pq_id long, loc int, ml_ratio double, distal_bl double").withColumn("pendant_bl", P.F.lit(0.0))
    assert [tuple(r) for r in X.overlap_graph(placed).collect()] == [("s", 2, 1, 0.5)]
    assert sorted((r.pq_id, r.island) for r in X.islands(placed).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert sorted((r.pq_id, r.island) for r in X.islands(placed, 0.6).collect()) == [(2, 2), (3, 3)]
    near = {r.pq_id: r.distance for r in X.adcl(placed, runs.edges).collect()}
    assert near == {1: 0.5, 2: 1.0, 3: 0.25}


def test_transforms_and_names(spark):
    names = spark.createDataFrame([("s", 1, "ab", 4.0), ("s", 2, "b", 1.0), ("s", 3, "c", 1.0)], "sample string, pq_id long, name string, mass double")
    got = {r.name: r.mass for r in C.transform_masses(names, "asinh", unitize=True).collect()}
    total = math.asinh(4) + 2 * math.asinh(1)
    assert abs(got["ab"] - math.asinh(4) / total) < 1e-12
    assert {r.name for r in C.filter_names(names, include=["a"], exclude=["b"]).collect()} == {"ab", "c"}
    assert {r.name for r in C.filter_names(names, include=["b"], exclude=["a"], default_exclude=True).collect()} == {"b"}
    assert C.duplicate_by_count(names).count() == 6
    assert C.rarefy(names, 4).agg(P.F.sum("mass")).first()[0] == 4.0
