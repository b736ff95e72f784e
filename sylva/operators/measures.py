"""Measures over the profile: distances between samples and diversity of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans import profile as P
from ..plans.stage import written

#: Shares nearer than this to 0 or 1 count as such.
CLOSE, PRESENT = 1e-10, 1e-5


def _pairs(prof: DataFrame, *values: str) -> DataFrame:
    """Each stretch once for each pair of samples: an equi-join on the stretch."""
    keys = ["edge", "a"]
    left = prof.select(*keys, "len", F.col("sample").alias("sample1"), *[F.col(v).alias(f"{v}1") for v in values])
    right = prof.select(*keys, F.col("sample").alias("sample2"), *[F.col(v).alias(f"{v}2") for v in values])
    return left.join(right, keys).where("sample1 < sample2")


def kr_distances(prof: DataFrame, exponents: dict[str, float], norm: float | Column = 1.0) -> DataFrame:
    """Kantorovich-Rubinstein distances of every pair of samples, a column for each named exponent p: (sum |r1 - r2|^p len / norm)^min(1, 1/p)."""
    gap = F.abs(F.col("r1") - F.col("r2"))
    norm = F.lit(float(norm)) if isinstance(norm, int | float) else norm

    def distance(p: float) -> Column:
        total = F.sum(gap * F.col("len")) if p == 1 else F.sum(F.pow(gap, F.lit(float(p))) * F.col("len"))
        return F.pow(total / norm, F.lit(min(1.0, 1.0 / p)))

    return _pairs(prof, "r").groupBy("sample1", "sample2").agg(*[distance(p).alias(name) for name, p in exponents.items()])


def kr_distance(prof: DataFrame, p: float = 1.0, norm: float | Column = 1.0) -> DataFrame:
    """The distance Z_p alone."""
    return kr_distances(prof, {"distance": p}, norm)


def unifrac(prof: DataFrame) -> DataFrame:
    """Unweighted UniFrac: branch length under exactly one sample over length under either."""
    on1, on2 = F.col("r1") > PRESENT, F.col("r2") > PRESENT
    one, either = F.sum(F.when(on1 != on2, F.col("len")).otherwise(0.0)), F.sum(F.when(on1 | on2, F.col("len")).otherwise(0.0))
    return _pairs(prof, "r").groupBy("sample1", "sample2").agg((one / F.nullif(either, F.lit(0.0))).alias("unifrac"))


def kr_heat(units: DataFrame, edges: DataFrame, sample1: str, sample2: str) -> DataFrame:
    """Signed net transport over each edge: mass of sample1 at or below it less that of sample2."""
    down = P.below(units.where(F.col("sample").isin(sample1, sample2)), edges, inclusive=True)
    signed = down.groupBy("edge").agg(F.sum(F.when(F.col("sample") == sample1, F.col("m")).otherwise(-F.col("m"))).alias("heat"))
    return edges.select(F.col("id").alias("edge")).join(signed, "edge", "left").select("edge", F.coalesce("heat", F.lit(0.0)).alias("heat"))


def diversity(prof: DataFrame, thetas: Sequence[float] = (0.5,), chao: Sequence[float] = (0.0, 2.0)) -> DataFrame:
    """Each sample's phylogenetic entropy, quadratic entropy, unrooted and rooted PD, BWPD(theta) and qD(T), of point mass.

    Theta must lie in 0 to 1 (0: length where mass lies on both sides); order 1 of qD is its limit.
    """
    if any(not 0 <= t <= 1 for t in thetas):
        raise ValueError("theta must lie in 0 to 1")
    r, length = F.col("r"), F.col("len")
    some, all_of = F.abs(r) > CLOSE, F.abs(r - 1) <= CLOSE

    def bwpd(theta: float) -> Column:
        if theta == 0:
            return F.sum(F.when(some & ~all_of, length).otherwise(0.0))
        x = F.least(r, 1 - r) * 2
        return F.sum((x if theta == 1 else F.pow(F.greatest(x, F.lit(0.0)), F.lit(float(theta)))) * length)

    depth = F.sum(F.when(some, length * r).otherwise(0.0)).over(W.partitionBy("sample"))
    deep = prof.withColumn("_t", depth)
    share = r / F.col("_t")
    columns = [
        F.sum(F.when(some & ~all_of, -length * r * F.log(r)).otherwise(0.0)).alias("phylo_entropy"),
        F.sum(length * r * (1 - r)).alias("quadratic"),
        F.sum(F.when(some & ~all_of, length).otherwise(0.0)).alias("unrooted_pd"),
        F.sum(F.when(some, length).otherwise(0.0)).alias("rooted_pd"),
        bwpd(1.0).alias("bwpd_1"),
        *[bwpd(t).alias(f"bwpd_{str(t).replace('.', '_')}") for t in thetas],
    ]
    for q in chao:
        if q == 1:
            value = F.exp(-F.sum(F.when(some, length * share * F.log(share)).otherwise(0.0))) / F.max("_t")
        else:
            value = F.pow(F.sum(F.when(some, length * F.pow(share, F.lit(float(q)))).otherwise(0.0)), F.lit(1.0 / (1.0 - q))) / F.max("_t")
        columns.append(value.alias(f"chao_{str(q).replace('.', '_')}"))
    return deep.groupBy("sample").agg(*columns)


def pendant_terms(units: DataFrame, callback) -> DataFrame:
    """(sample, extra): a measure's addition for pendant branches, callback(mass, pendant length) summed over units."""
    return units.groupBy("sample").agg(F.sum(callback(F.col("m"), F.col("pend"))).alias("extra"))


def rarefaction(placements: DataFrame, edges: DataFrame, k_max: int, k_min: int = 2) -> DataFrame:
    """Expected PD of k of a sample's queries: (sample, k, unrooted, rooted, quadratic), by best placements.

    A stretch with d of n queries distal is missed by a draw of k with q(d) = C(n-d, k) / C(n, k).
    """
    best = P.ranked(placements).where("rank_in_pq = 1")
    totals = best.groupBy("sample").agg(F.count("*").alias("n"))
    units = best.select("sample", "pq_id", "loc", F.col("distal_bl").alias("pos"), F.lit(1.0).alias("m"))
    counts = P.profile(units, edges).groupBy("sample", F.round("r").cast("long").alias("d")).agg(F.sum("len").alias("len"))
    each = counts.join(totals, "sample").where(F.col("n") >= k_min).withColumn("k", F.explode(F.sequence(F.lit(k_min), F.least(F.lit(k_max), F.col("n")).cast("int"))))

    def missed(d: Column) -> Column:
        steps = F.sequence(F.lit(0), F.col("k") - 1)
        return F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * F.greatest(F.col("n") - d - i, F.lit(0)) / (F.col("n") - i))

    u = (1 - missed(F.col("d")) - missed(F.col("n") - F.col("d"))) * F.col("len")
    n, k, d = F.col("n"), F.col("k"), F.col("d")
    quad = F.col("len") * d * (n - d) * (k - 1) / (k * n * (n - 1))
    inner = (d > 0) & (d < n)
    return each.groupBy("sample", "k").agg(F.sum(F.when(inner, u).otherwise(0.0)).alias("unrooted"), F.sum((1 - missed(d)) * F.col("len")).alias("rooted"), F.sum(F.when(F.col("n") > 1, quad).otherwise(0.0)).alias("quadratic"))


def rarefaction_variance(placements: DataFrame, edges: DataFrame, k_max: int, k_min: int = 2) -> DataFrame:
    """Variance of the PD of k of a sample's queries: (sample, k, unrooted, rooted), by best placements.

    The sum over pairs of stretches of the covariance that both are in the spanned tree, times
    their lengths.  A covariance depends on the numbers d of queries below either stretch, and on
    whether one lies above the other.  So all pairs are first taken to lie apart, from the
    lengths summed by d; pairs of which one is above the other are found along the paths of the
    edges, summed by their two numbers, and put right.  The root's own stretch does not count.
    """
    best = P.ranked(placements).where("rank_in_pq = 1")
    totals = best.groupBy("sample").agg(F.count("*").alias("n"))
    units = best.select("sample", "pq_id", "loc", F.col("distal_bl").alias("pos"), F.lit(1.0).alias("m"))
    top = edges.where("parent_id IS NULL").select(F.col("id").alias("_root"))
    prof = P.profile(units, edges).withColumn("d", F.round("r").cast("long")).join(F.broadcast(top), F.col("edge") == F.col("_root"), "left_anti")
    parts = prof.groupBy("sample", "edge", "d").agg(F.sum("len").alias("len")).where("len > 0 AND d > 0")
    apart = parts.groupBy("sample", "d").agg(F.sum("len").alias("len"))
    pairs = apart.select("sample", F.col("d").alias("d1"), F.col("len").alias("l1")).join(apart.select("sample", F.col("d").alias("d2"), F.col("len").alias("l2")), "sample").select("sample", "d1", "d2", (F.col("l1") * F.col("l2")).alias("v"), F.lit("apart").alias("kind"))
    same = parts.groupBy("sample", "d").agg(F.sum(F.col("len") * F.col("len")).alias("v")).select("sample", F.col("d").alias("d1"), F.col("d").alias("d2"), "v", F.lit("same").alias("kind"))
    # d1 above d2: on an edge above, or further up the same edge
    up = parts.select("sample", F.col("edge").alias("id"), F.col("d").alias("d2"), F.col("len").alias("l2")).join(edges.select("id", F.explode("path").alias("edge")), "id")
    over = up.join(parts.select("sample", "edge", F.col("d").alias("d1"), F.col("len").alias("l1")), ["sample", "edge"]).where("edge <> id OR d1 > d2")
    serial = over.groupBy("sample", "d1", "d2").agg(F.sum(F.col("l1") * F.col("l2")).alias("v")).withColumn("kind", F.lit("serial"))
    each = pairs.unionByName(same).unionByName(serial).join(totals, "sample").where(F.col("n") >= k_min).withColumn("k", F.explode(F.sequence(F.lit(k_min), F.least(F.lit(k_max), F.col("n")).cast("int"))))
    n, d1, d2 = F.col("n"), F.col("d1"), F.col("d2")

    def missed(d: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.col("k") - 1), F.lit(1.0), lambda acc, i: acc * F.greatest(n - d - i, F.lit(0)) / (n - i))

    for name, x in (("q1", d1), ("q2", d2), ("p1", n - d1), ("p2", n - d2), ("both", d1 + d2), ("across", n - d1 + d2)):
        each = each.withColumn(name, missed(x))
    q1, q2, p1, p2, both, across = (F.col(x) for x in ("q1", "q2", "p1", "p2", "both", "across"))
    beside = both - q1 * q2 + (1 - q1) * p2 + (1 - q2) * p1 - p1 * p2
    above = across - p1 * q2 + (1 - p1) * p2 + (1 - q2) * q1 - q1 * p2
    alone = (1 - q1 - p1) - (1 - q1 - p1) * (1 - q1 - p1)
    rooted_beside, rooted_above, rooted_alone = both - q1 * q2, q1 - q1 * q2, q1 - q1 * q1
    put_right = lambda pair, serial, one: F.when(F.col("kind") == "apart", pair).when(F.col("kind") == "serial", 2 * serial - 2 * pair).otherwise(one - pair)
    return each.groupBy("sample", "k").agg(F.sum(F.col("v") * put_right(beside, above, alone)).alias("unrooted"), F.sum(F.col("v") * put_right(rooted_beside, rooted_above, rooted_alone)).alias("rooted"))


def representative_edges(features: DataFrame, edges: DataFrame, distance: float) -> DataFrame:
    """(edge): edges that stand for others near them, by the Euclidean distance of their values over the samples.

    From the leaves up, an edge's candidates are those of its children; the ones farther than
    ``distance`` from it are kept as they are, the others go on, or the edge itself if there are none.
    The work is the tree's, on a vector of the samples for each edge.
    """
    wide = features.groupBy("edge").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "x"))), lambda v: v["x"]).alias("v"))
    rows = edges.select("id", "parent_id").join(wide, F.col("id") == F.col("edge")).orderBy("id").collect()  # a row an edge
    value = {r.id: r.v for r in rows}
    waiting: dict[int, set[int]] = {r.id: set() for r in rows}
    kept: set[int] = set()
    inner = {r.parent_id for r in rows}
    for r in rows:  # children before their parents
        if r.id in inner:
            near = {j for j in waiting[r.id] if sum((a - b) ** 2 for a, b in zip(value[r.id], value[j], strict=True)) ** 0.5 < distance}
            kept |= waiting[r.id] - near
            on = near or {r.id}
        else:
            on = {r.id}
        if r.parent_id is None:
            kept |= on
        else:
            waiting[r.parent_id] |= on
    return edges.sparkSession.createDataFrame([(k,) for k in sorted(kept)], "edge int")


def edge_widths(units: DataFrame, edges: DataFrame, total_width: float = 300.0, factor: float = 0.0, *, average: bool = False) -> DataFrame:
    """(sample, edge, m, width): mass of each edge and its drawn width; the total absolute mass has ``total_width`` unless a factor is given.

    With ``average`` all samples are one, named "average", each of them weighing the same.
    """
    per = P.by_edge(units)
    if average:
        share = F.col("m") / F.sum("m").over(W.partitionBy("sample"))
        n = per.select("sample").distinct().agg(F.count("*").alias("_n"))
        per = per.withColumn("m", share).groupBy("loc").agg(F.sum("m").alias("m")).join(F.broadcast(n)).select(F.lit("average").alias("sample"), "loc", (F.col("m") / F.col("_n")).alias("m"))  # one row
    whole = F.sum(F.abs("m")).over(W.partitionBy("sample"))
    scale = F.lit(float(total_width)) / whole if factor == 0 else F.lit(float(factor))
    return per.select("sample", F.col("loc").alias("edge"), "m", (F.col("m") * scale).alias("width"))


def in_order(results: DataFrame, samples: list[str], column: str = "sample") -> DataFrame:
    """A row-a-sample result in the order in which the samples were given; others come last, by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in samples]), F.col(column)), F.lit(0)), F.lit(len(samples) + 1))
    return results.orderBy(place, column)


def splitify(units: DataFrame, edges: DataFrame, kappa: float = 1.0) -> DataFrame:
    """(sample, edge, x): for x the mass strictly below, sign(1 - 2x) |1 - 2x|^kappa, on every edge of every sample."""
    units = written(P.by_edge(units).withColumn("pos", F.lit(0.0)), "edges")
    names = P.samples_of(units)
    dense = edges.select(F.col("id").alias("edge")).withColumn("sample", F.explode(F.array(*[F.lit(s) for s in names])))
    x = 1 - 2 * F.coalesce(F.col("m"), F.lit(0.0))
    value = x if kappa == 1 else F.signum(x) * F.pow(F.abs(x), F.lit(float(kappa)))
    return dense.join(P.below(units, edges), ["sample", "edge"], "left").select("sample", "edge", value.alias("x"))


def varying_edges(features: DataFrame, epsilon: float = 1e-5) -> DataFrame:
    """Features (sample, edge, x) of edges whose values differ by epsilon or more."""
    moving = features.groupBy("edge").agg((F.max("x") - F.min("x")).alias("spread")).where(F.col("spread") >= epsilon).select("edge")
    return features.join(moving, "edge", "left_semi")


def barycenter(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample, edge, pos): the point where the work to gather a sample's mass there is the same from above and below.

    Work is sum of mass times distance.  On an edge, with all mass below it B (moment b about the
    edge's distal end) and the rest A (moment a about its proximal end), the difference of work is
    linear between breakpoints; the point is where it changes sign, or the node between edges.
    """
    tall = written(P.with_heights(edges), "heights")
    info = tall.select("id", "bl", "h", "path", "parent_id")
    units = written(P.by_place(units), "places")
    placed = units.join(info.select(F.col("id").alias("loc"), "path", F.col("h").alias("_h")), "loc").withColumn("_height", F.col("_h") - F.col("pos"))
    total = placed.groupBy("sample").agg(F.sum("m").alias("all_m"), F.sum(F.col("m") * F.col("_height")).alias("all_h"))
    up = placed.select("sample", "m", "_height", "loc", F.explode("path").alias("id")).where("id <> loc")
    under = up.groupBy("sample", "id").agg(F.sum("m").alias("b_m"), F.sum(F.col("m") * F.col("_height")).alias("b_h"))
    # distance of mass elsewhere: heights to the lowest common ancestor, summed along the path of each edge
    names = P.samples_of(units)
    dense = info.withColumn("sample", F.explode(F.array(*[F.lit(s) for s in names])))
    inc = P.below(units, edges, inclusive=True).withColumnRenamed("edge", "id").withColumnRenamed("m", "inc")
    moment = placed.groupBy("sample", F.col("loc").alias("up")).agg(F.sum(F.col("m") * F.col("pos")).alias("on_pos"))
    flat = dense.select("sample", "id", F.posexplode("path").alias("k", "up")).join(moment, ["sample", "up"], "left").join(inc.select("sample", F.col("id").alias("up"), "inc"), ["sample", "up"], "left").join(info.select(F.col("id").alias("up"), F.col("h").alias("h_up"), F.when(F.col("parent_id").isNull(), F.lit(0.0)).otherwise(F.col("bl")).alias("bl_up")), "up")
    # the path that mass shares with ``id``: each strict ancestor's branch, or the part above for mass on that branch
    beyond = flat.groupBy("sample", "id").agg(F.max(F.when(F.col("k") == 0, F.coalesce("inc", F.lit(0.0)))).alias("inc_id"), F.sum(F.when(F.col("k") > 0, F.coalesce("inc", F.lit(0.0)) * F.col("bl_up") - F.coalesce("on_pos", F.lit(0.0))).otherwise(0.0)).alias("shared_all"))
    base = dense.join(under, ["sample", "id"], "left").join(beyond, ["sample", "id"]).join(total, "sample")
    onto = placed.groupBy("sample", F.col("loc").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("on_edge"), F.sum(F.col("m") * F.col("_height")).alias("on_h"))
    base = base.join(onto, ["sample", "id"], "left")
    zero = F.lit(0.0)
    b_m, b_h = F.coalesce("b_m", zero), F.coalesce("b_h", zero)
    top_h = F.col("h") - F.when(F.col("parent_id").isNull(), zero).otherwise(F.col("bl"))
    out_m = F.col("all_m") - F.col("inc_id")
    out_h = F.col("all_h") - b_h - F.coalesce("on_h", zero)
    # outside mass to the edge's proximal end: h_m + h_top - 2 * h(lca), where sum of m * h(lca) is the shared part of strict ancestors less the own subtree's
    shared = F.col("shared_all") - F.col("inc_id") * top_h
    out_work = out_h + out_m * top_h - 2 * shared
    below_work = b_h - b_m * F.col("h")
    spots = F.coalesce(F.col("on_edge"), F.array().cast("array<struct<pos:double,m:double>>"))
    ready = base.select("sample", F.col("id").alias("edge"), "parent_id", F.when(F.col("parent_id").isNull(), zero).otherwise(F.col("bl")).alias("bl"), b_m.alias("b_m"), below_work.alias("below_work"), out_m.alias("out_m"), out_work.alias("out_work"), spots.alias("spots"))

    def delta(at: Column) -> Column:
        """Proximal less distal work at a place; mass at the place itself does no work."""
        low = F.aggregate("spots", F.lit(0.0), lambda acc, s: acc + F.when(s["pos"] < at, s["m"] * (at - s["pos"])).otherwise(0.0))
        high = F.aggregate("spots", F.lit(0.0), lambda acc, s: acc + F.when(s["pos"] > at, s["m"] * (s["pos"] - at)).otherwise(0.0))
        return (F.col("out_work") + F.col("out_m") * (F.col("bl") - at) + high) - (F.col("below_work") + F.col("b_m") * at + low)

    marks = F.array_sort(F.array_distinct(F.concat(F.array(zero), F.transform("spots", lambda s: s["pos"]), F.array(F.col("bl")))))
    cut = ready.withColumn("marks", marks).withColumn("d_low", delta(zero)).withColumn("d_top", delta(F.col("bl")))
    # positive at the bottom and not at the top: the sign changes on this edge
    here = cut.where((F.col("d_low") >= 0) & (F.col("d_top") < 0))
    steps = here.select("sample", "edge", "d_low", F.explode(F.transform(F.sequence(F.lit(1), F.size("marks") - 1), lambda i: F.struct(F.element_at(F.col("marks"), i).alias("lo"), F.element_at(F.col("marks"), i + 1).alias("hi")))).alias("s"), "spots", "out_work", "out_m", "bl", "below_work", "b_m")
    signed = steps.withColumn("d0", delta(F.col("s.lo"))).withColumn("d1", delta(F.col("s.hi"))).where("d0 >= 0 AND d1 < 0")
    on_edge = signed.select("sample", "edge", (F.col("s.lo") + (F.col("s.hi") - F.col("s.lo")) * F.col("d0") / (F.col("d0") - F.col("d1"))).alias("pos"))
    # else it is the deepest node that is still drawn downwards at its edge's distal end: named by that edge, at 0
    deepest = cut.where("d_low < 0").join(edges.select(F.col("id").alias("edge"), "depth"), "edge").groupBy("sample").agg(F.max_by("edge", F.struct("depth", "edge")).alias("edge")).select("sample", "edge", zero.alias("pos"))
    return on_edge.unionByName(deepest.join(on_edge.select("sample"), "sample", "left_anti"))
