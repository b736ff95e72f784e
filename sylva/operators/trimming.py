"""Trimming: a smaller tree of the leaves that mass lies on the way to, with the placements carried over."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans import profile as P
from ..plans.tree import Node, number

KEYS = ["sample", "pq_id"]


def root_of(edges: DataFrame) -> Node:
    """The tree of an ``edges`` relation, its nodes keeping their numbers (tree-sized)."""
    rows = edges.select("id", "parent_id", "bl", "label", "edge_num").orderBy("id").collect()
    nodes = {r.id: Node(r.label, r.bl, r.edge_num) for r in rows}
    for r in rows:
        if r.parent_id is not None:
            nodes[r.parent_id].children.append(nodes[r.id])
    return number(nodes[next(r.id for r in rows if r.parent_id is None)])


@dataclass(frozen=True)
class Cut:
    """What a smaller tree keeps of a larger one, by the larger one's edge numbers.

    ``tree``: the smaller tree; ``moves``: edge -> (its edge in the smaller tree, that edge's lowest
    old edge, what is added to a distal position); ``lost``: dropped edge -> (nearest kept edge
    above, length from there to the distal end).
    """

    tree: Node
    moves: dict[int, tuple[int, int, float]]
    lost: dict[int, tuple[int, float]]


def cut_tree(root: Node, keep: Iterable[int]) -> Cut:
    """The tree over some leaves (numbers), nodes with one child left spliced out, the root's too."""
    keep = set(keep)
    kept = {n.id: False for n in root.walk()}
    for n in root.walk():
        kept[n.id] = n.id in keep if n.is_leaf else any(kept[c.id] for c in n.children)
    if not kept[root.id]:
        raise ValueError("no leaf is kept")
    length = {n.id: (n.length or 0.0) if n.parent is not None else 0.0 for n in root.walk()}
    made: dict[int, Node] = {}
    lowest: dict[int, int] = {}
    moved: dict[int, tuple[int, float]] = {}  # edge -> (lowest old edge of its edge, added)
    for n in root.walk():
        if not kept[n.id]:
            continue
        own = [c for c in n.children if kept[c.id]]
        if len(own) == 1:
            node = made[own[0].id]
            low = lowest[own[0].id]
            moved[n.id] = (low, node.length or 0.0)
            node.length = (node.length or 0.0) + length[n.id]
        else:
            node, low = Node(n.label, length[n.id], None, [made[c.id] for c in own]), n.id
            moved[n.id] = (low, 0.0)
        made[n.id], lowest[n.id] = node, low
    at = {}
    for n in root.walk():
        if kept[n.id] and lowest[n.id] == n.id:
            at[n.id] = made[n.id]
    tree = number(made[root.id])
    lost = {}
    for n in reversed(list(root.walk())):
        if not kept[n.id]:
            up, far = (n.parent.id, 0.0) if kept[n.parent.id] else lost[n.parent.id]
            lost[n.id] = (up, far + length[n.id])
    return Cut(tree, {e: (at[low].id, low, add) for e, (low, add) in moved.items()}, lost)


def bare_root(root: Node) -> Cut:
    """The tree without any leaf: its root is left, the nearest kept node above every other edge."""
    lost: dict[int, tuple[int, float]] = {}
    for n in reversed(list(root.walk())):
        if n.parent is not None:
            lost[n.id] = (root.id, (n.length or 0.0) + (lost[n.parent.id][1] if n.parent.parent is not None else 0.0))
    return Cut(number(Node(root.label, 0.0)), {root.id: (0, root.id, 0.0)}, lost)


@dataclass(frozen=True)
class Trimmed:
    tree: Node
    placements: DataFrame
    names: DataFrame
    discarded: DataFrame
    transm: list[tuple[int, int, float]]


def trim(placements: DataFrame, names: DataFrame, edges: DataFrame, min_mass: float = 0.001, *, rewrite: bool = False, point: bool = False, weight: str = "ml_ratio") -> Trimmed:
    """All samples as one collection on the tree of leaves with at least ``min_mass`` on their way to the root.

    Each sample weighs the same.  Placements on dropped edges go, or with ``rewrite`` move to the
    nearest kept node above, the way there being added to their pendant length.  A query without
    placements left is discarded with its names.  Weights become the softmax of those left, as
    the format's own renormalisation of log likelihoods has it.  If no leaf has the mass, the root
    alone is left.  ``transm`` lists (old edge, new
    edge, what is added to a distal position); placements have ``old_edge``, the lowest old edge
    of theirs.  What comes to the driver has the size of the tree.
    """
    spark = placements.sparkSession
    many = names.groupBy(*KEYS).agg(F.sum("mass").alias("_many"))
    units = P.mass(placements.join(many, KEYS), point=point, weight=weight, multiplicity="_many")
    sums = units.groupBy("loc").agg(F.sum("m").alias("m")).collect()  # a row an edge
    n_samples = units.select("sample").distinct().count()
    mass = {r["loc"]: r["m"] / n_samples for r in sums}
    root = root_of(edges)
    above: dict[int, float] = {}
    for n in reversed(list(root.walk())):
        above[n.id] = (above[n.parent.id] if n.parent is not None else 0.0) + mass.get(n.id, 0.0)
    kept = {n.id for n in root.leaves() if above[n.id] >= min_mass}
    cut = cut_tree(root, kept) if kept else bare_root(root)
    rows = [(e, new, low, add, None) for e, (new, low, add) in cut.moves.items()]
    if rewrite:
        rows += [(e, *cut.moves[up], far) for e, (up, far) in cut.lost.items()]
    moves = F.broadcast(spark.createDataFrame(rows, "loc int, new_loc int, old_edge int, _add double, _far double"))  # a row an edge
    at = placements.withColumn("loc", F.col("loc").cast("int")).join(moves, "loc")
    lost = F.col("_far").isNotNull()
    pend = F.when(lost, F.col("_far") - F.col("distal_bl") + F.col("pendant_bl")).otherwise(F.col("pendant_bl"))
    distal = F.when(lost, F.lit(0.0)).otherwise(F.col("distal_bl")) + F.col("_add")
    own = W.partitionBy(*KEYS)
    out = at.withColumn("pendant_bl", pend).withColumn("distal_bl", distal).drop("loc", "_add", "_far").withColumnRenamed("new_loc", "loc")
    for column in [weight] + (["post_prob"] if "post_prob" in placements.columns and weight != "post_prob" else []):
        share = F.exp(F.col(column) - F.max(column).over(own))
        out = out.withColumn(column, F.when(F.col(column).isNotNull(), share / F.sum(share).over(own)))
    left = out.select(*KEYS).distinct()
    return Trimmed(cut.tree, out, names.join(left, KEYS, "left_semi"), names.join(left, KEYS, "left_anti"), [(e, new, add) for e, (new, _, add) in sorted(cut.moves.items())])
