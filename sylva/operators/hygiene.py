"""Taxonomic hygiene of a reference tree: convexity rank by rank, rooting, inference and review of labels.

Trees, and the taxonomy above their leaves, are held on the driver; distances between many places
are array work.
"""

from __future__ import annotations

from collections.abc import Mapping
from statistics import median, stdev

from ..plans.tree import Node, heights, prune_to, reroot
from .trees import convex_subset

#: tax_id -> its lineage, the root first and itself last, as (tax_id, rank number).
Lineages = Mapping[str, list[tuple[str, int]]]


# -- colours on a tree


def cut_colors(root: Node, colors: Mapping[int, str]) -> dict[int, set[str]]:
    """Colours with leaves both below and above each edge; the root's edge has none."""
    everywhere: dict[str, int] = {}
    for c in colors.values():
        everywhere[c] = everywhere.get(c, 0) + 1
    below: dict[int, dict[str, int]] = {}
    found = {}
    for n in root.walk():
        count: dict[str, int] = {colors[n.id]: 1} if n.is_leaf and n.id in colors else {}
        for child in n.children:
            for c, k in below[child.id].items():
                count[c] = count.get(c, 0) + k
        below[n.id] = count
        found[n.id] = {c for c, k in count.items() if k < everywhere[c]} if n.parent is not None else set()
    return found


def badness(root: Node, colors: Mapping[int, str]) -> tuple[int, int]:
    """(largest, total) number of colours beyond the first in the cut-sets of the edges."""
    each = [max(0, len(c) - 1) for c in cut_colors(root, colors).values()]
    return max(each, default=0), sum(each)


#: What a subtree's kept leaves are, if not all of one colour that occurs outside too: without colour, or of others.
PLAIN, MIXED = "", "\0"


def rooted_convex_subset(root: Node, colors: Mapping[int, str]) -> tuple[set[int], int]:
    """(leaf ids, size) of a largest set of leaves that is convex as seen from the root; leaves without a colour stay.

    Of a node's subtrees those that share a colour must hold no other.  A state is the set of a
    subtree's colours that also occur outside, and what it is: without colour, of one such colour,
    or mixed.
    """
    cut = cut_colors(root, colors)
    state: dict[int, dict[tuple[frozenset, str], tuple[int, tuple]]] = {}
    for n in root.walk():
        # (colours, those of them that only subtrees of one colour hold, what it is)
        own: dict[tuple[frozenset, frozenset, str], tuple[int, tuple]] = {(frozenset(), frozenset(), PLAIN): (0, ())}
        if n.is_leaf and n.id in colors:
            own[frozenset([colors[n.id]]), frozenset(), colors[n.id]] = (1, (n.id,))
        elif n.is_leaf:
            own = {(frozenset(), frozenset(), PLAIN): (1, (n.id,))}
        for child in n.children:
            merged: dict[tuple, tuple[int, tuple]] = {}
            for (used, pure, kind), (value, kept) in own.items():
                for (more, what), (gain, added) in state[child.id].items():
                    single = what not in (PLAIN, MIXED)
                    if used & more and not (single and what in pure):
                        continue
                    both = what if kind == PLAIN else kind if what in (PLAIN, kind) else MIXED
                    key = (used | more, pure | more if single else pure, both)
                    if key not in merged or merged[key][0] < value + gain:
                        merged[key] = (value + gain, kept + added)
            own = merged
            del state[child.id]
        closed: dict[tuple[frozenset, str], tuple[int, tuple]] = {}
        for (used, _, kind), (value, kept) in own.items():
            outside = used & cut[n.id]
            key = (outside, kind if kind == PLAIN or kind in outside else MIXED)
            if key not in closed or closed[key][0] < value:
                closed[key] = (value, kept)
        state[n.id] = closed
    value, kept = max(state[root.id].values(), key=lambda x: x[0])
    return set(kept), value


def convexify(root: Node, ranks: Mapping[str, Mapping[int, str]], *, cutoff: int = 12, only: set[str] | None = None, rooted: bool = False) -> dict[str, dict]:
    """For each rank with a colouring that is not convex and not worse than the cutoff: the kept and cut leaves and both badnesses.

    ``ranks``: rank -> (leaf id -> taxon), the coarsest first; ``only`` limits them.  The search
    gives up a state as soon as another of equal cut-set keeps as much, so an early end needs no
    setting of its own.
    """
    out = {}
    leaves = {n.id for n in root.leaves()}
    for rank, colors in ranks.items():
        if only is not None and rank not in only:
            continue
        worst, total = badness(root, colors)
        if worst == 0 or worst > cutoff:
            continue
        kept, _ = rooted_convex_subset(root, colors) if rooted else convex_subset(root, dict(colors))
        out[rank] = {"kept": kept, "cut": leaves - kept, "max_badness": worst, "tot_badness": total}
    return out


def alternate_colors(root: Node, colors: Mapping[int, str]) -> dict[int, set[str]]:
    """For each leaf without a colour those that it could take in a convex colouring: the regions that it reaches over edges of none."""
    cut = cut_colors(root, colors)
    nodes = {n.id: n for n in root.walk()}
    touch: dict[int, set[str]] = {i: set(cut[i]) for i in nodes}  # regions that meet at a node
    for i, n in nodes.items():
        if n.id in colors and n.is_leaf:
            touch[i].add(colors[i])
        for c in n.children:
            touch[i] |= cut[c.id]
    found = {}
    for leaf in root.leaves():
        if leaf.id in colors:
            continue
        seen, open_, own = {leaf.id}, [leaf], set()
        while open_:
            n = open_.pop()
            own |= touch[n.id]
            steps = [(c, c.id) for c in n.children] + ([(n.parent, n.id)] if n.parent is not None else [])
            for other, edge in steps:
                if other.id not in seen and not cut[edge]:
                    seen.add(other.id)
                    open_.append(other)
        found[leaf.id] = own
    return found


# -- rooting by taxonomy


def common(lineages: list[list[tuple[str, int]]]) -> tuple[str, int] | None:
    """The deepest (taxon, rank) of all lineages."""
    found = None
    for level in zip(*lineages, strict=False):
        if any(x != level[0] for x in level):
            break
        found = level[0]
    return found


def taxonomic_root(root: Node, leaf_lineage: Mapping[int, list[tuple[str, int]]]) -> int:
    """The node to hang the tree from: down from the root towards the subtree whose common taxon is of the coarsest rank.

    It ends where the two coarsest of the subtrees, and of what is above, have equal ranks, or at
    the last inner node.  leaf_lineage: those of the leaves that count.
    """
    own = {}
    for n in root.walk():
        below = [leaf_lineage[n.id]] if n.is_leaf and n.id in leaf_lineage else [x for c in n.children for x in own[c.id]]
        own[n.id] = below
    at, above = root, []
    while True:
        ranked = [(found[1], k) for k, c in enumerate(at.children) if own[c.id] and (found := common(own[c.id])) is not None]
        if above and (found := common(above)) is not None:
            ranked.append((found[1], -1))
        ranked.sort(key=lambda x: (x[0], x[1] >= 0, x[1]))
        if len(ranked) > 1 and ranked[0][0] == ranked[1][0]:
            return at.id
        if not ranked or ranked[0][1] < 0 or at.children[ranked[0][1]].is_leaf:
            return at.id
        down = at.children[ranked[0][1]]
        above = above + [x for c in at.children if c is not down for x in own[c.id]]
        at = down


def reroot_by_taxonomy(root: Node, leaf_taxa: Mapping[int, str], lineages: Lineages) -> Node:
    """The tree rerooted where its taxa part at the coarsest rank that has two of them, judged on a convex subset of leaves at that rank."""
    at_rank: dict[int, dict[int, str]] = {}
    for leaf, tax in leaf_taxa.items():
        for t, rank in lineages[tax]:
            at_rank.setdefault(rank, {})[leaf] = t
    several = [r for r in sorted(at_rank) if len(set(at_rank[r].values())) > 1]
    if not several:
        return root.copy()
    kept, _ = convex_subset(root, at_rank[several[0]])
    return reroot(root, taxonomic_root(root, {k: lineages[t] for k, t in leaf_taxa.items() if k in kept}))


# -- distances of places, inferred and reviewed taxa


def place_distance(root: Node):
    """distance((edge, distal), (edge, distal)) between places on a tree."""
    nodes, tall = {n.id: n for n in root.walk()}, heights(root)

    def ways(edge: int) -> list[int]:
        out, n = [], nodes[edge]
        while n is not None:
            out.append(n.id)
            n = n.parent
        return out

    def distance(a: tuple[int, float], b: tuple[int, float]) -> float:
        (e, d), (f, g) = a, b
        if e == f:
            return abs(d - g)
        up, over = ways(e), ways(f)
        h, k = tall[e] - d, tall[f] - g
        if e in over or f in up:
            return abs(h - k)
        shared = next(x for x in up if x in set(over))
        return h + k - 2 * tall[shared]

    return distance


def infer_taxa(root: Node, leaf_taxa: Mapping[int, str], placed: Mapping[int, tuple[str, int, float, float]], lineages: Lineages) -> dict[int, str | None]:
    """A taxon for each untagged leaf: its placements' common taxon, or a coarser one of its lineage, as soon as it fits there.

    ``placed``: leaf -> (common taxon of its placements, edge, distal, pendant of the best one).  At
    a rank it fits if the place, with its pendant length, is nearer to all tagged leaves of the
    taxon than two leaves of that taxon (inferred ones too) are at most; none fits: None.
    """
    far = place_distance(root)
    at_rank: dict[int, dict[int, str]] = {}
    for leaf, tax in [*leaf_taxa.items(), *((k, v[0]) for k, v in placed.items())]:
        for t, rank in lineages[tax]:
            at_rank.setdefault(rank, {})[leaf] = t
    out: dict[int, str | None] = {}
    for leaf, (tax, edge, distal, pendant) in placed.items():
        out[leaf] = None
        for t, rank in reversed(lineages[tax]):
            members = [x for x, y in at_rank[rank].items() if y == t]
            widest = max((far((a, 0.0), (b, 0.0)) for i, a in enumerate(members) for b in members[:i]), default=0.0)
            others = [x for x in members if x not in placed]
            if others and max(far((x, 0.0), (edge, distal)) for x in others) + pendant < widest:
                out[leaf] = t
                break
    return out


def review(root: Node, colors: Mapping[int, str], placed: Mapping[int, str], lineages: Lineages) -> list[dict]:
    """What placing again says of the leaves that a convex subset cuts (the keys of ``placed``, with their new taxa).

    For each: old and new taxon, whether the new one makes it convex, median distance and
    coefficient of variation (percent) to the remaining leaves of either, and how many leaves of
    the old taxon there are, and how many were cut.
    """
    rest = {k: c for k, c in colors.items() if k not in placed}
    far, alternates = place_distance(root), alternate_colors(root, rest)

    def spread(tax: str, leaf: int) -> tuple[float | None, float | None]:
        own = [far((x, 0.0), (leaf, 0.0)) for x, c in rest.items() if c == tax]
        mean = sum(own) / len(own) if own else 0.0
        return (median(own) if own else None, 100 * stdev(own) / mean if len(own) > 1 and mean > 0 else None)

    rows = []
    for leaf, new in placed.items():
        old = colors[leaf]
        fits = {t for c in alternates[leaf] for t, _ in lineages[c]}
        n_old = sum(c == old for c in colors.values())
        old_median, old_cv = spread(old, leaf)
        new_median, new_cv = spread(new, leaf)
        rows.append({"leaf": leaf, "old": old, "new": new, "makes_convex": new in fits, "old_median": old_median, "old_cv": old_cv, "new_median": new_median, "new_cv": new_cv, "n_old": n_old, "n_cut": n_old - sum(c == old for c in rest.values())})
    return rows


def without(root: Node, leaves: set[str]) -> Node | None:
    """The tree without some leaves (by label), as a reference to place them on again."""
    return prune_to(root, {n.label for n in root.leaves()} - leaves)


# -- leaves of a bare tree


def min_adcl_tree(root: Node, k: int, queries: set[str] = frozenset(), *, method: str = "greedy") -> tuple[list[str], float]:
    """(leaves to keep, cost): k leaves near to all leaves, or near to where the query leaves hang on the tree without them."""
    from . import trees as R

    if queries:
        small, placed = R.cut_taxa(root, {n.label: n.label for n in root.leaves()}, set(queries))
        if small is None:
            raise ValueError("no leaf is left")
        points = [(edge, distal, 1.0 / len(placed)) for _, edge, distal, _ in placed]
    else:
        small = root
        own = list(root.leaves())
        points = [(n.id, 0.0, 1.0 / len(own)) for n in own]
    names = [n.label for n in small.leaves()]
    if method == "full":
        chosen, cost = R.select_full(small, points, k)
    else:
        d, m, _ = R.mass_distances(small, points)
        chosen, cost = {"greedy": R.select_greedy, "pam": R.select_pam, "force": R.select_force}[method](d, m, min(k, len(names)))
    return [names[j] for j in chosen], cost
