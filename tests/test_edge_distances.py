"""Distances of all edges on random trees, and rounding to six decimals, against plain code."""

import itertools
import random

from pyspark.sql import functions as F
import pytest

from sylva.operators import pairs as X
from sylva.operators.queries import quick_r6, r6
from sylva.plans.tree import edges_frame, heights
from tests_tools import grow


@pytest.mark.parametrize("seed", range(3))
def test_every_pair_of_edges(spark, seed):
    root = grow(random.Random(seed), 12)
    tall, want = heights(root), {}
    nodes = {n.id: n for n in root.walk()}
    above = {}
    for n in nodes.values():
        above[n.id], up = [n.id], n.parent
        while up is not None:
            above[n.id].append(up.id)
            up = up.parent
    top = {n.id: tall[n.id] - (n.length if n.parent is not None else 0.0) for n in nodes.values()}
    for x, y in itertools.combinations(sorted(nodes), 2):
        if y in above[x]:
            want[x, y] = ("S", top[x] - tall[y])
        else:
            want[x, y] = ("P", top[x] + top[y] - 2 * tall[next(a for a in above[x] if a in above[y])])
    out = X.edge_distances(edges_frame(spark, root))
    rows = out.collect()
    assert {(r.edge1, r.edge2): (r.kind, r.distance) for r in rows} == want and len(rows) == len(want)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan  # pairs meet where they part


def test_quick_rounding(spark):
    draw = random.Random(4)
    values = [0.0, -0.0, -1e-9, 0.1234565, 2.0000005, 1.0000015, -3.4999995, 1e6, 123456789.1234565, 1e300] + [draw.uniform(-50, 50) for _ in range(300)] + [draw.randrange(10**8) / 10**7 for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(quick_r6("v").alias("a"), r6("v").alias("b"), F.lit(1)).collect()
    assert [str(r.a) for r in rows] == [str(r.b) for r in rows]
