"""Mass on a tree, and the profile: the share of a sample's mass below each point of every branch.

``mass``: (sample, pq_id, loc, pos, pend, m), one row a placement, m summing to 1 in a sample.
``profile``: (edge, a, len, sample, r): on the stretch of edge from a to a + len (measured from its
distal end) the fraction r of the sample's mass lies distal to the point.

Mass is summed by edge and place before anything else, subtree sums go through the ancestors'
paths of ``edges`` (an equi-join and a grouped sum, no range join), and the running sum on an edge
is one window over its few breakpoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .stage import written

TRANSFORMS = {
    "no_trans": lambda x: x,
    "unit": lambda x: F.lit(1.0),
    "log": lambda x: F.log(x),
    "asinh": lambda x: F.asinh(x),
}


def ranked(placements: DataFrame, weight: str = "ml_ratio") -> DataFrame:
    """Placements with rank_in_pq (1 is the best by weight) and w, their weight normalised within the query."""
    own = W.partitionBy("sample", "pq_id")
    ties = [c for c in ("line", "loc", "distal_bl", "pendant_bl", "log_like") if c in placements.columns]
    return placements.withColumn("w", F.col(weight) / F.sum(weight).over(own)).withColumn("rank_in_pq", F.row_number().over(own.orderBy(F.col(weight).desc(), *ties)))


def required(placements: DataFrame, weight: str) -> DataFrame:
    """Placements whose criterion is there in every row; a missing one is an error when rows are read."""
    return placements.withColumn(weight, F.when(F.col(weight).isNotNull(), F.col(weight)).otherwise(F.raise_error(F.lit(f"no {weight}")).cast("double")))


def mass(placements: DataFrame, *, point: bool = False, weight: str = "ml_ratio", multiplicity: str | None = None, transform: str = "no_trans") -> DataFrame:
    """Mass units of every sample: spread over a query's placements by weight, or on its best one.

    A query's mass is its transformed multiplicity (1 without one) over the sample's sum of those.
    """
    own = ranked(placements, weight)
    if point:
        own = own.where("rank_in_pq = 1").withColumn("w", F.lit(1.0))
    many = F.lit(1.0) if multiplicity is None else TRANSFORMS[transform](F.col(multiplicity))
    own = own.withColumn("_many", many)
    totals = own.groupBy("sample", "pq_id").agg(F.max("_many").alias("_many")).groupBy("sample").agg(F.sum("_many").alias("_total"))
    out = own.join(totals, "sample")  # a row a sample: Spark broadcasts it by its size
    return out.select("sample", "pq_id", "loc", F.col("distal_bl").alias("pos"), F.col("pendant_bl").alias("pend"), "rank_in_pq", (F.col("w") * F.col("_many") / F.col("_total")).alias("m"))


def place_mass(placements: DataFrame, *, point: bool = False, weight: str = "ml_ratio", multiplicity: str | None = None, transform: str = "no_trans") -> DataFrame:
    """(sample, loc, pos, m): a sample's mass by place, for whatever needs no single query; written down.

    As :func:`mass` summed by place, but in one pass: a query's shares sum to its multiplicity, so
    the sample's total is that of the places.
    """
    own = W.partitionBy("sample", "pq_id")
    if point:
        shares = ranked(placements, weight).where("rank_in_pq = 1").withColumn("w", F.lit(1.0))
    else:
        shares = placements.withColumn("w", F.col(weight) / F.sum(weight).over(own))
    many = F.lit(1.0) if multiplicity is None else TRANSFORMS[transform](F.col(multiplicity))
    sums = shares.groupBy("sample", "loc", F.col("distal_bl").alias("pos")).agg(F.sum(F.col("w") * many).alias("m"))
    places = written(sums, "places")
    return places.withColumn("m", F.col("m") / F.sum("m").over(W.partitionBy("sample")))


def by_place(units: DataFrame) -> DataFrame:
    return units.groupBy("sample", "loc", "pos").agg(F.sum("m").alias("m"))


def by_edge(units: DataFrame) -> DataFrame:
    return units.groupBy("sample", "loc").agg(F.sum("m").alias("m"))


def below(units: DataFrame, edges: DataFrame, *, inclusive: bool = False) -> DataFrame:
    """(sample, edge, m): mass strictly distal to each edge, or on it too; edges without any are missing."""
    per = by_edge(units).join(edges.select(F.col("id").alias("loc"), "path"), "loc")
    up = per.select("sample", "loc", "m", F.explode("path").alias("edge"))
    return (up if inclusive else up.where("edge <> loc")).groupBy("sample", "edge").agg(F.sum("m").alias("m"))


def samples_of(units: DataFrame) -> list:
    """Names of the samples, in order (samples are few: a row each)."""
    return sorted(r[0] for r in units.select("sample").distinct().collect())


def profile(units: DataFrame, edges: DataFrame, samples: list | None = None) -> DataFrame:
    """(edge, a, len, sample, r) for every sample on every stretch, including edges without mass."""
    places = written(by_place(units), "places")  # a row a place: read for the samples, the cuts, the sums below and on edges
    names = samples if samples is not None else samples_of(places)
    cuts = places.select(F.col("loc").alias("edge"), F.col("pos").alias("a")).unionByName(edges.select(F.col("id").alias("edge"), F.lit(0.0).alias("a"))).distinct()
    along = W.partitionBy("edge").orderBy("a")
    stretches = cuts.join(edges.select(F.col("id").alias("edge"), "bl"), "edge").select("edge", "a", (F.coalesce(F.lead("a").over(along), F.col("bl")) - F.col("a")).alias("len"))
    dense = stretches.withColumn("sample", F.explode(F.array(*[F.lit(x) for x in names])))
    on_edge = dense.join(places.select(F.col("loc").alias("edge"), F.col("pos").alias("a"), "sample", "m"), ["edge", "a", "sample"], "left")
    run = F.coalesce(F.sum("m").over(W.partitionBy("sample", "edge").orderBy("a").rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))
    full = on_edge.select("edge", "a", "len", "sample", run.alias("_on"))
    down = below(places, edges).withColumnRenamed("m", "_below")
    return full.join(down, ["sample", "edge"], "left").select("edge", "a", "len", "sample", (F.coalesce("_below", F.lit(0.0)) + F.col("_on")).alias("r"))


def heights(edges: DataFrame) -> DataFrame:
    """(id, h): distance from the root to each edge's distal end (the root's own branch does not count)."""
    up = edges.select("id", F.explode("path").alias("up"))
    length = edges.select(F.col("id").alias("up"), F.when(F.col("parent_id").isNull(), 0.0).otherwise(F.col("bl")).alias("bl"))
    return up.join(length, "up").groupBy("id").agg(F.sum("bl").alias("h"))


def with_heights(edges: DataFrame) -> DataFrame:
    """edges with h and ``climb``: (edge, its height) from the edge to the root, as one array a node."""
    tall = heights(edges)
    up = edges.select("id", F.posexplode("path").alias("k", "up")).join(tall.select(F.col("id").alias("up"), "h"), "up")
    climb = up.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "up", "h"))), lambda x: F.struct(x["up"].alias("up"), x["h"].alias("h"))).alias("climb"))
    return edges.join(climb, "id").withColumn("h", F.col("climb")[0]["h"])


def distance(climb1: Column, pos1: Column, climb2: Column, pos2: Column) -> Column:
    """Tree distance between a place on one edge and a place on another, from their climbs (see :func:`with_heights`).

    On one edge it is the difference of the places; if one edge is above the other, the difference
    of the places' heights; else the way up to the lowest common ancestor and down.
    """
    e1, e2, h1, h2 = climb1[0]["up"], climb2[0]["up"], climb1[0]["h"] - pos1, climb2[0]["h"] - pos2
    ups1, ups2 = F.transform(climb1, lambda x: x["up"]), F.transform(climb2, lambda x: x["up"])
    shared = F.array_max(F.transform(F.filter(climb1, lambda x: F.array_contains(ups2, x["up"])), lambda x: x["h"]))
    return F.when(e1 == e2, F.abs(pos1 - pos2)).when(F.array_contains(ups1, e2) | F.array_contains(ups2, e1), F.abs(h1 - h2)).otherwise(h1 + h2 - 2 * shared)
