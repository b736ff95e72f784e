"""Operators over all orders of the star model, and their sparse forms against plain dense ones."""

import re

import numpy as np
import pytest

from sylva.operators import clusters as K
from sylva.operators.pairs import islands, overlap_graph
from sylva.operators.queries import QUERIES as BASE
from sylva.operators.more_queries import QUERIES
from sylva.plans.tree import edges_frame, parse_newick


@pytest.fixture(scope="module")
def orders(spark, sf_dir):
    return {tuple(r) for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_orderkey").distinct().collect()}


@pytest.fixture(scope="module")
def placed(spark):
    rng = np.random.default_rng(5)
    edges = edges_frame(spark, parse_newick("((A:2,(B:9,E:1):2):7,(C:5,F:2):3,D:1):0;"))
    bl = {r.id: r.bl for r in edges.collect()}
    rows = [(s, q, line, loc, float(w), float(bl[loc] * rng.random()), 0.1) for s in "xy" for q in range(25) for w in [rng.dirichlet([1] * int(rng.integers(1, 4)))] for line, w, loc in [(k, v, int(rng.integers(0, 9))) for k, v in enumerate(w)]]
    return spark.createDataFrame(rows, "sample string, pq_id long, line int, loc int, ml_ratio double, distal_bl double, pendant_bl double"), edges


@pytest.mark.parametrize("name", ["compress", "mcl", "islands_by_order"])
def test_every_order(spark, sf_dir, orders, name):
    assert {(r.sample, r.pq_id) for r in QUERIES[name](spark, sf_dir).collect()} == orders


def test_distance_is_that_of_orders(spark, sf_dir):
    want = BASE["kr"](spark, sf_dir).where("sample1 = 'A' AND sample2 = 'R'").first().z1
    got = QUERIES["kr_significance"](spark, sf_dir).first()
    assert abs(got.distance - want) < 2e-6 and 0 <= got.p_gaussian <= 1


def test_trees_hold_every_order(spark, sf_dir, orders):
    own = {str(q) for s, q in orders if s == "N"}
    text = [r.newick for r in QUERIES["tog"](spark, sf_dir).collect()]
    assert any(own <= set(re.findall(r"[(,](\d+):", t)) for t in text)
    assert own <= {str(r.pq_id) for r in QUERIES["sing"](spark, sf_dir).select("pq_id").collect()}


def test_trees_of_every_sample(spark, sf_dir, orders):
    tog = {r.sample: r.newick for r in QUERIES["tog"](spark, sf_dir).collect()}
    assert {(s, int(q)) for s, t in tog.items() for q in re.findall(r"[(,](\d+):", t)} == orders
    sing = QUERIES["sing"](spark, sf_dir).collect()
    assert len(sing) == len(orders) and {(r.sample, r.pq_id) for r in sing} == orders


def test_compress_against_all_pairs(placed):
    rows, edges = placed
    from pyspark.sql import functions as F

    from sylva.plans import profile as P

    single = rows.withColumn("sample", F.concat_ws("/", "sample", F.format_string("%02d", "pq_id")))
    names = sorted(r[0] for r in single.select("sample").distinct().collect())
    r, length, _ = K.profile_matrix(P.profile(P.mass(single), edges), names)
    island = {(x.sample, x.pq_id): x.island for x in islands(rows).collect()}
    for p, cutoff in ((1.0, 3.0), (2.0, 2.0)):
        z = (np.abs(r[:, :, None] - r[:, None, :]) ** p * length[:, None, None]).sum(0) ** (1 / p)
        want = {}
        for s in "xy":
            own = [k for k, n in enumerate(names) if n[0] == s]
            near = z[np.ix_(own, own)] <= cutoff
            near &= np.array([[island[s, a] == island[s, b] for b in range(25)] for a in range(25)])
            np.fill_diagonal(near, False)
            kept = np.arange(25)
            while near.sum(1).max() > 0:
                k = int(near.sum(1).argmax())
                gone = [*np.flatnonzero(near[k]), k]
                kept[gone] = k
                near[gone], near[:, gone] = False, False
            want |= {(s, q): int(kept[q]) for q in range(25)}
        got = {(x.sample, x.pq_id): x.kept_id for x in K.compress(rows, edges, cutoff, p=p).collect()}
        assert got == want and any(k[1] != v for k, v in got.items())


def test_clusters_against_dense(placed):
    rows, _ = placed
    got = {(x.sample, x.pq_id): x.cluster for x in K.markov_clusters(rows, 2.0).collect()}
    overlap = overlap_graph(rows).collect()
    for s in "xy":
        m = np.eye(25)
        for x in overlap:
            if x.sample == s:
                m[x.pq1, x.pq2] = m[x.pq2, x.pq1] = x.overlap
        m /= m.sum(0)
        for _ in range(60):
            m = (m @ m) ** 2.0
            m /= m.sum(0)
        label = np.arange(25)
        for _ in range(25):
            for row in m:
                own = np.flatnonzero(row > 1e-6)
                if len(own):
                    label[own] = label[own].min()
        assert [got[s, q] for q in range(25)] == label.tolist() and len(set(label)) > 1


def test_all_shuffles(spark, sf_dir, monkeypatch):
    drawn = []
    monkeypatch.setattr(K, "gaussian_p_value", lambda *a: (0.0, 0.5))
    plain = K.shuffle_p_values

    def counted(units, edges, sample1, sample2, n=plain.__defaults__[0]):
        drawn.append(n)
        return 0.0, 0.5

    monkeypatch.setattr(K, "shuffle_p_values", counted)
    QUERIES["kr_significance"](spark, sf_dir)
    assert drawn == [100]


def test_compress_moves_copies_as_one(spark, monkeypatch):
    edges = edges_frame(spark, parse_newick("((A:2,B:1):1,C:3):0;"))
    spots = [(0, 0.5), (0, 0.75), (1, 0.5), (3, 1.0), (3, 2.5)]
    rows = [("x", q, 0, *spots[q * q % 5 if q % 3 else q % 5], 1.0, 0.1) for q in range(120)]
    rows += [("x", 200 + k, line, loc, pos, w, 0.1) for k in range(4) for line, (loc, pos, w) in enumerate([(0, 0.5, 0.9), (3, 1.0, 0.1)])]
    df = spark.createDataFrame(rows, "sample string, pq_id long, line int, loc int, distal_bl double, ml_ratio double, pendant_bl double")
    seen, plain = [], K.near_pairs
    monkeypatch.setattr(K, "near_pairs", lambda *a: (seen.append(plain(*a)), seen[-1])[1])
    got = {r.pq_id: r.kept_id for r in K.compress(df, edges, 0.4).collect()}
    assert seen[0].count() <= 15  # pairs of six kinds of queries, not of 124 queries
    long = [2.0, 1.0, 1.0, 3.0]
    marks = [sorted({0.0, long[e], *(p for k, p in spots if k == e)}) for e in range(4)]
    cuts = [(e, a, b) for e, own in enumerate(marks) for a, b in zip(own, own[1:], strict=False)]
    at: dict = {}
    for _, q, _, loc, pos, w, _ in rows:
        for n, (e, a, _) in enumerate(cuts):
            at.setdefault(q, np.zeros(len(cuts)))[n] += w if (e == loc and a >= pos) or (e == 2 and loc in (0, 1)) else 0.0
    ids, far = sorted(at), np.array([b - a for _, a, b in cuts])
    island = {x.pq_id: x.island for x in islands(df).collect()}
    near = np.array([[a != b and island[a] == island[b] and (np.abs(at[a] - at[b]) * far).sum() <= 0.4 for b in ids] for a in ids])
    want = np.arange(len(ids))
    while near.sum(1).max() > 0:
        k = int(near.sum(1).argmax())
        gone = [*np.flatnonzero(near[k]), k]
        want[gone] = k
        near[gone], near[:, gone] = False, False
    assert got == {q: ids[want[k]] for k, q in enumerate(ids)} and len(set(got.values())) < 8


@pytest.mark.parametrize("plain", [0, K.PLAIN])
def test_clusters_of_single_places(spark, monkeypatch, plain):
    monkeypatch.setattr(K, "PLAIN", plain)
    rng = np.random.default_rng(3)
    rows = []
    for q in range(160):
        locs = rng.choice(8, 1 if q % 3 else int(rng.integers(1, 4)), replace=False)
        share = rng.dirichlet([1] * len(locs)) if len(locs) > 1 else [1.0 if q % 5 else 0.75]
        rows += [("x", q, int(k), float(w)) for k, w in zip(locs, share, strict=True)]
    df = spark.createDataFrame(rows, "sample string, pq_id long, loc int, ml_ratio double")
    w = np.zeros((160, 8))
    for _, q, k, v in rows:
        w[q, k] += v
    for inflation in (1.5, 2.0, 4.0):
        m = w @ w.T
        np.fill_diagonal(m, 1)
        m /= m.sum(0)
        for _ in range(60):
            m = (m @ m) ** inflation
            m /= m.sum(0)
        label = np.arange(160)
        for _ in range(160):
            for row in m:
                own = np.flatnonzero(row > 1e-6)
                if len(own):
                    label[own] = label[own].min()
        got = {x.pq_id: x.cluster for x in K.markov_clusters(df, inflation).collect()}
        assert [got[q] for q in range(160)] == label.tolist() and len(set(label.tolist())) > 1


def test_clusters_of_a_crowd(spark):
    # 30 000 queries on three edges, joined by a few: a pair of them each would be 9e8 pairs
    rows = [("x", q, q % 3, 1.0) for q in range(30_000)] + [("x", 30_000 + k, loc, 0.5) for k in range(2) for loc in (k, k + 1)]
    df = spark.createDataFrame(rows, "sample string, pq_id long, loc int, ml_ratio double")
    got = {x.pq_id: x.cluster for x in K.markov_clusters(df, 4.0).collect()}
    assert len(got) == 30_002 and all(got[q] == q % 3 for q in range(30_000))


def test_a_long_chain_is_one_island_in_few_jobs(spark):
    rows = [("x", 500 - q, loc, 1.0) for q in range(300) for loc in (q, q + 1)] + [("x", 900, 400, 1.0), ("y", 7, 3, 1.0), ("y", 6, 3, 0.2)]
    df = spark.createDataFrame(rows, "sample string, pq_id long, loc int, ml_ratio double")
    spark.sparkContext.setJobGroup("chain", "islands of a chain")
    got = {(r.sample, r.pq_id): r.island for r in islands(df, 0.1).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("other", "")
    assert got == {("x", 500 - q): 201 for q in range(300)} | {("x", 900): 900, ("y", 7): 6, ("y", 6): 6}
    assert jobs < 60  # not some for each step along the chain


def test_compress_counts_a_distance_at_the_cutoff(spark):
    # shares of 4/5 and 3/5 on one leaf, the rest on another: each two are exactly 0.4 apart, however they are added up
    edges = edges_frame(spark, parse_newick("((A:1,B:1):1,C:3):0;"))
    far = []
    for k in range(1, 40):
        rows = [("x", 1, 0, 0, 0.0, 4.0 * k, 0.1), ("x", 1, 1, 1, 0.0, 1.0 * k, 0.1), ("x", 2, 0, 0, 0.0, 3.0 * k, 0.1), ("x", 2, 1, 1, 0.0, 2.0 * k, 0.1)]
        far += [(f"s{k}", *r[1:]) for r in rows]
    df = spark.createDataFrame(far, "sample string, pq_id long, line int, loc int, distal_bl double, ml_ratio double, pendant_bl double")
    for cutoff, kept in ((0.4, 1), (0.4 - 1e-9, 2)):
        assert {(r.sample, r.pq_id): r.kept_id for r in K.compress(df, edges, cutoff).collect()} == {(f"s{k}", q): min(q, kept) for k in range(1, 40) for q in (1, 2)}
