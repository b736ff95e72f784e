"""Clusters of edges, inner sequences, groups, calibration, batched ranking, against plain versions on trees of our own."""

import itertools
import random

import numpy as np
import pytest

from sylva.operators import place as L, placing as A
from sylva.operators.hygiene import place_distance
from sylva.plans.tree import parse_newick
from tests_tools import grow


def reference(seed, n=7, sites=60):
    draw = random.Random(seed)
    root = grow(draw, n)
    base = "".join(draw.choice("ACGT") for _ in range(sites))
    mutate = lambda s: "".join(draw.choice("ACGT") if draw.random() < 0.15 else c for c in s)
    seqs = {x.label: mutate(base) for x in root.leaves()}
    model = L.Model.gtr({"ac": 1.0, "ag": 2.0, "at": 1.0, "cg": 1.0, "ct": 2.0, "gt": 1.0}, [0.3, 0.2, 0.2, 0.3], alpha=0.8)
    return root, seqs, L.Reference(root, seqs, model), mutate(base)


@pytest.mark.parametrize("seed", range(3))
def test_ranks_of_all_edges_at_once(seed):
    root, _, ref, query = reference(seed)
    query = "--" + query[2:-3] + "N-?"
    sites = np.flatnonzero([c not in "-?." for c in query])
    leaf = np.repeat(L.tips("".join(query[k] for k in sites))[None], ref.model.classes, 0)
    got = ref.rank(leaf, sites, 0.1)
    for e in ref.edges():
        v, scale = ref.join(e, ref.length[e] / 2, sites)
        want = float((np.log((v * ref.model.carry(0.1, leaf, sites)).sum(2).mean(0)) + scale).sum())
        assert abs(got[e] - want) < 1e-8
    ref.MIDDLES, ref._middles = 1, None  # in parts that are not kept
    assert ref.rank(leaf, sites, 0.1) == pytest.approx(got)


@pytest.mark.parametrize("seed", range(10))
def test_clusters_hold_near_leaves(seed):
    draw = random.Random(seed)
    root, cutoff = grow(draw, 9), draw.choice([1.5, 3.0, 5.0])
    far, leaves = place_distance(root), {n.id for n in root.leaves()}
    clusters = A.edge_clusters(root, cutoff)
    own = [e & leaves for _, e in clusters]
    assert sorted(x for s in own for x in s) == sorted(leaves)  # each leaf in one
    for s in own:
        # two leaves of one subtree of a cluster are near, but for what the root joins
        below = [s & {x.id for x in c.leaves()} for c in root.children]
        for part in below:
            assert all(far((a, 0.0), (b, 0.0)) <= cutoff + 1e-9 for a, b in itertools.combinations(part, 2))
    assert set().union(*(e for _, e in clusters)) == {n.id for n in root.walk() if n.parent is not None}
    score = {n.id: draw.random() for n in root.walk()}
    order = list(A.by_cluster(clusters, score.__getitem__, 0.05))
    assert sorted(e for _, e in order) == sorted(set().union(*(e for _, e in clusters))) and all(score[e] == v for v, e in order)


def test_clusters_place_alike(spark):
    root, _, ref, query = reference(5)
    plain = L.place_query(ref, query)
    for cutoff in (0.5, 2.0):
        found = L.place_query(ref, query, L.Settings(cluster_cutoff=cutoff, max_strikes=0))
        assert found[0]["edge"] == L.place_query(ref, query, L.Settings(max_strikes=0))[0]["edge"]
    assert plain[0]["ml_ratio"] <= 1
    one = L.place_query(ref, query, L.Settings(posterior=True, informative=True))
    assert abs(sum(p["post_prob"] for p in one) - 1) < 1e-9


def test_prior_means():
    root = parse_newick("((a:1,b:3):2,c:4);")
    ids = {n.label: n.id for n in root.leaves()}
    means = A.prior_means(root, 0.5)
    assert means[ids["a"]] == 1.5 and means[ids["c"]] == 4.5 and means[next(n.id for n in root.walk() if len(n.children) == 2 and n.parent)] == 4.5 and root.id not in means


def test_inner_sequences():
    root = parse_newick("((a:0.01,b:0.01):0.01,(c:0.01,d:0.01):0.01,e:0.01);")
    seqs = {"a": "AAC-", "b": "AAC-", "c": "GAC-", "d": "GAC-", "e": "GAT-"}
    ref = L.Reference(root, seqs, L.Model.gtr({"ac": 1.0, "ag": 1.0, "at": 1.0, "cg": 1.0, "ct": 1.0, "gt": 1.0}, [0.25] * 4))
    inner = [n.id for n in root.walk() if n.children and n.parent is not None]
    found = A.likeliest_sequences(ref, inner, 0.6)
    assert [s[1:3] for s in found.values()] == ["AC", "AC"] and all(s[3] == "-" for s in found.values()) and found[inner[1]][0] == "G"
    assert A.likeness("AC-T", "AGTT") == (2 / 3, 3) and A.likeness("--", "AC") == (0.0, 0)
    assert A.nearest_marked(root, [inner[0]])[next(n.id for n in root.leaves() if n.label == "a")] == inner[0]


def test_groups_by_span():
    seqs = [("l1", "AAAA----"), ("l2", "-AAA----"), ("r1", "----AAAA"), ("r2", "-----AAA"), ("w", "--AAAA--"), ("n", "--------")]
    groups = A.group_by_span(seqs, 2)
    assert sorted(n for g in groups for n, _ in g) == sorted(n for n, _ in seqs)
    assert {"l1", "l2"} <= {n for n, _ in groups[0]} and {"r1", "r2"} <= {n for n, _ in groups[1]}


def test_calibration():
    run = [(1, -10.0), (2, -14.0), (3, -9.0), (4, -30.0)]
    assert A.early_end(run, 3.0, 1) == (False, 2, 1.0) and A.early_end(run, 5.0, 1) == (True, 4, 0.0) and A.early_end(run, 3.0, 2) == (True, 4, 0.0)
    rows = A.calibrate([run, [(7, -1.0), (8, -9.0)]], 5, 2)
    assert len(rows) == 12 and A.cheapest(rows, 1e-9)["tried"] == 3.0 and A.cheapest(rows, -1.0) is None


def test_split_and_overlap(spark):
    seqs = spark.createDataFrame([("a", "AC--"), ("q", "--GT"), ("r", "A---")], "name string, seq string")
    refs, queries = A.split_queries(seqs, spark.createDataFrame([("a",)], "name string"))
    assert [r.name for r in refs.collect()] == ["a"] and sorted(r.name for r in queries.collect()) == ["q", "r"]
    assert [r.name for r in A.check_overlap(queries, [0, 1], discard=True).collect()] == ["r"]
    with pytest.raises(Exception, match="does not overlap"):
        A.check_overlap(queries, [0, 1]).collect()
    assert sorted(r.seq for r in A.clip(queries, [0, 2]).collect()) == ["-G", "A-"]
    with pytest.raises(ValueError):
        L.premask(refs, queries.where("name = 'q'"))
