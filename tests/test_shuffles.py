"""Shuffles dealt by bits against samples dealt one by one."""

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from sylva.operators import clusters as K
from sylva.operators.measures import kr_distance
from sylva.plans import profile as P
from sylva.plans.tree import edges_frame, parse_newick


@pytest.mark.parametrize("p", [1.0, 2.0])
def test_every_shuffle(spark, p):
    rng = np.random.default_rng(8)
    edges = edges_frame(spark, parse_newick("((A:2,(B:9,E:1):2):7,(C:5,F:2):3,D:1):0;"))
    bl = {r.id: r.bl for r in edges.collect()}
    rows = [("xyz"[q % 3], q // 2, loc, float(bl[loc] * rng.choice([0.0, 0.5, 0.75])), float(rng.random())) for q in range(40) for loc in rng.integers(0, 9, int(rng.integers(1, 4))).tolist()]
    units = spark.createDataFrame(rows, "sample string, pq_id long, loc int, pos double, m double")
    out = K.shuffle_null(units, edges, "x", "y", 63, p, 5)
    assert "explode" not in out._jdf.queryExecution().toString()  # a unit is not written down once a shuffle
    got = {int(r.turn): r.z for r in out.collect()}
    assert sorted(got) == list(range(1, 64))
    two = units.where("sample <> 'z'")
    queries = two.select("sample", "pq_id").distinct()
    n1 = queries.where("sample = 'x'").count()
    for turn in (1, 30, 61, 63):
        order = W.orderBy(F.xxhash64(F.lit(5), F.lit(turn), "sample", "pq_id"), "sample", "pq_id")
        dealt = queries.withColumn("side", F.when(F.row_number().over(order) <= n1, "1").otherwise("2"))
        own = two.join(dealt, ["sample", "pq_id"]).drop("sample").withColumnRenamed("side", "sample")
        own = own.withColumn("m", F.col("m") / F.sum("m").over(W.partitionBy("sample")))
        assert abs(got[turn] - kr_distance(P.profile(own, edges), p).first()["distance"]) < 1e-9
