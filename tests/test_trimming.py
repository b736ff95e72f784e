"""Trimmed trees keep distances; the variance of rarefaction against all draws."""

import itertools
import random
from statistics import pvariance

import pytest

from sylva.operators import measures as M
from sylva.operators.hygiene import place_distance
from sylva.operators.trimming import cut_tree, trim
from sylva.plans.tree import edges_frame, number, parse_newick
from tests_tools import grow


def place(draw, root, n_queries):
    nodes = [n for n in root.walk() if n.parent is not None]
    rows = []
    for q in range(n_queries):
        k = draw.randint(1, 3)
        weights = [draw.random() + 0.1 for _ in range(k)]
        for line, w in enumerate(weights):
            n = draw.choice(nodes)
            rows.append(("xy"[q % 2], q, line, n.id, n.length, w / sum(weights), round(draw.random() * n.length, 3), round(draw.random(), 3)))
    return rows


SCHEMA = "sample string, pq_id long, line int, loc int, bl double, ml_ratio double, distal_bl double, pendant_bl double"


@pytest.mark.parametrize("seed", range(4))
def test_distances_stay(spark, seed):
    import math

    draw = random.Random(seed)
    root = grow(draw, 9)
    rows = place(draw, root, 14)
    df = spark.createDataFrame(rows, SCHEMA)
    names = spark.createDataFrame([(s, q, f"n{q}", 1.0) for s, q in {(r[0], r[1]) for r in rows}], "sample string, pq_id long, name string, mass double")
    edges = edges_frame(spark, root)
    mass = {}
    n_of = {s: len({r[1] for r in rows if r[0] == s}) for s in "xy"}
    for r in rows:
        mass[r[3]] = mass.get(r[3], 0.0) + r[5] / n_of[r[0]] / 2
    path = {n.id: mass.get(n.id, 0.0) + 0.0 for n in root.walk()}
    for n in reversed(list(root.walk())):
        path[n.id] = mass.get(n.id, 0.0) + (path[n.parent.id] if n.parent is not None else 0.0)
    level = sorted(path[n.id] for n in root.leaves())[4]
    kept_leaves = {n.label for n in root.leaves() if path[n.id] >= level - 1e-12}
    old = place_distance(root)
    for rewrite in (False, True):
        out = trim(df, names, edges, level - 1e-12, rewrite=rewrite)
        assert {n.label for n in out.tree.leaves()} == kept_leaves and all(len(n.children) != 1 for n in out.tree.walk())
        got = {(r["sample"], r.pq_id, r.line): r for r in out.placements.collect()}
        new = place_distance(out.tree)
        moved = {e: (t, add) for e, t, add in out.transm}
        for r in rows:
            if r[3] in moved:
                x = got[r[0], r[1], r[2]]
                assert x["loc"] == moved[r[3]][0] and abs(x.distal_bl - r[6] - moved[r[3]][1]) < 1e-9
            elif not rewrite:
                assert (r[0], r[1], r[2]) not in got
        whole = [(r, got[r[0], r[1], r[2]]) for r in rows if (r[0], r[1], r[2]) in got]
        for (a, x), (b, y) in itertools.combinations(whole, 2):
            if a[3] in moved and b[3] in moved:
                assert abs(old((a[3], a[6]), (b[3], b[6])) - new((x["loc"], x.distal_bl), (y["loc"], y.distal_bl))) < 1e-9
            elif a[3] in moved or b[3] in moved:
                assert abs(old((a[3], a[6]), (b[3], b[6])) + a[7] + b[7] - new((x["loc"], x.distal_bl), (y["loc"], y.distal_bl)) - x.pendant_bl - y.pendant_bl) < 1e-9
        for key in {(r[0], r[1]) for r in rows}:
            own = [(r, x) for r, x in whole if (r[0], r[1]) == key]
            total = sum(math.exp(r[5]) for r, _ in own)
            assert all(abs(x.ml_ratio - math.exp(r[5]) / total) < 1e-9 for r, x in own)
        left = {(r["sample"], r.pq_id) for r in out.names.collect()}
        assert left == {k[:2] for k in got} and {(r["sample"], r.pq_id) for r in out.discarded.collect()} == {(r[0], r[1]) for r in rows} - left


def test_cut_tree_of_one_leaf():
    root = parse_newick("((a:1,b:2):3,c:4);")
    a = next(n.id for n in root.leaves() if n.label == "a")
    cut = cut_tree(root, [a])
    assert cut.tree.label == "a" and cut.tree.length == 4.0 and cut.moves[root.id] == (0, a, 4.0)
    with pytest.raises(ValueError):
        cut_tree(root, [])


@pytest.mark.parametrize("seed", range(3))
def test_variance_of_all_draws(spark, seed):
    draw = random.Random(seed)
    root = grow(draw, 6)
    nodes = [n for n in root.walk() if n.parent is not None]
    places = [(n := draw.choice(nodes), draw.choice([0.0, 0.5, 1.0]) * n.length) for _ in range(6)]
    rows = [("s", q, 0, n.id, n.length, 1.0, pos, 0.1) for q, (n, pos) in enumerate(places)]
    got = {(r.k): r for r in M.rarefaction_variance(spark.createDataFrame(rows, SCHEMA), edges_frame(spark, root), 6).collect()}
    below = {n.id: {x.id for x in n.walk()} - {n.id} for n in nodes}

    def spanned(chosen, rooted):
        total = 0.0
        for n in nodes:
            cuts = sorted({0.0, n.length, *(p for m, p in places if m is n)})
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                d = sum(places[q][0].id in below[n.id] or (places[q][0] is n and places[q][1] <= lo) for q in chosen)
                total += (hi - lo) if d > 0 and (rooted or d < len(chosen)) else 0.0
        return total

    for k in range(2, 7):
        each = list(itertools.combinations(range(6), k))
        for rooted, value in ((False, got[k].unrooted), (True, got[k].rooted)):
            assert abs(pvariance([spanned(c, rooted) for c in each]) - value) < 1e-9
    assert number(root) is root


def test_no_leaf_has_the_mass(spark):
    root = parse_newick("((a:1,b:2):3,c:4);")
    at = {n.label: n for n in root.leaves()}
    rows = [("x", q, 0, at[k].id, at[k].length, 1.0, 0.5, 0.25) for q, k in enumerate("abc")]
    df = spark.createDataFrame(rows, SCHEMA)
    names = spark.createDataFrame([("x", q, f"n{q}", 1.0) for q in range(3)], "sample string, pq_id long, name string, mass double")
    gone = trim(df, names, edges_frame(spark, root), 0.5)
    assert gone.placements.count() == 0 and gone.names.count() == 0 and gone.discarded.count() == 3
    kept = trim(df, names, edges_frame(spark, root), 0.5, rewrite=True)
    assert [(n.label, n.id) for n in kept.tree.walk()] == [(None, 0)]
    got = {r.pq_id: (r["loc"], r.old_edge, r.distal_bl, r.pendant_bl, r.ml_ratio) for r in kept.placements.collect()}
    assert got == {0: (0, root.id, 0.0, 3.75, 1.0), 1: (0, root.id, 0.0, 4.75, 1.0), 2: (0, root.id, 0.0, 3.75, 1.0)}
