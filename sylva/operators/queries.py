"""Queries of the placement operators over the star schema, and the same in DuckDB SQL.

Every query covers its whole tables.  The SQL is written apart from the DataFrame code: distances
between suppliers' leaves come from their common nation or region, subtree sums from interval
joins.  Results are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans import profile as P, star as S
from ..plans.sql import HEIGHT, profile_cte, star
from ..plans.stage import written
from . import collections as C, measures as M, pairs as X, taxonomy as T, warehouse as H

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: str | Column) -> Column:
    """Rounded to six decimals, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def quick_r6(c: str) -> Column:
    """As :func:`r6`, without decimals of any precision where the sixth place is plain: within 1e-3 of a half, or beyond 1e6, the exact way."""
    scaled = F.col(c) * 1e6
    near = F.rint(scaled)
    return F.when((F.abs(scaled - near) < 0.499) & (F.abs(F.col(c)) < 1e6), near / 1e6 + 0.0).otherwise(r6(c))


def _rounded(df: DataFrame, shift: float = 0.0) -> DataFrame:
    """Doubles to six decimals; ``shift`` moves exact halves of the sixth off the edge, in the SQL too."""
    return df.select(*[r6(F.col(n) + shift if shift else n).alias(n) if t == "double" else F.col(n).cast("bigint").alias(n) if t == "int" else F.col(n) for n, t in df.dtypes])


def _model(spark: SparkSession, sf_dir: str):
    tree = written(S.edges(spark, sf_dir), "tree")  # one row a node, read by every step
    return tree, S.placements(spark, sf_dir, tree)


def monthly(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A rounded run: queries are months of shipping, placed on nations by quantity, a quarter up the edge."""
    tree = written(S.edges(spark, sf_dir), "tree")
    items = S.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sample"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("pq_id"), F.col("l_suppkey"), "l_quantity")
    nation = S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey"), F.col("s_nationkey").cast("long").alias("n"))
    per = items.join(nation, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("sample", "pq_id", "n").agg(F.sum("l_quantity").alias("q"))
    placed = per.join(tree.where("depth = 2").select("n", F.col("id").alias("loc"), "bl"), "n")
    whole = placed.groupBy("sample", "pq_id").agg(F.sum("q").alias("all_q"))
    return tree, placed.join(whole, ["sample", "pq_id"]).select("sample", "pq_id", F.col("loc").alias("line"), "loc", "bl", (F.col("q") / F.col("all_q")).alias("ml_ratio"), (F.col("bl") / 4).alias("distal_bl"), F.lit(0.5).alias("pendant_bl"))


def by_order(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The whole model: queries are orders, one placement a line item, weights as shares of the order's."""
    tree, placed = _model(spark, sf_dir)
    return tree, P.ranked(placed).drop("ml_ratio", "rank_in_pq").withColumnRenamed("w", "ml_ratio")


MONTHLY = """
month_q AS (SELECT l_returnflag sample, CAST(YEAR(l_shipdate) * 12 + MONTH(l_shipdate) AS BIGINT) pq_id, CAST(s_nationkey AS BIGINT) n, SUM(l_quantity) q
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
monthly AS (SELECT sample, pq_id, m.n, id loc, bl, q / SUM(q) OVER (PARTITION BY sample, pq_id) ml_ratio, bl / 4 pos, h.h - bl / 4 height, m.r
  FROM (SELECT month_q.*, CAST(n_regionkey AS BIGINT) r FROM month_q JOIN nation ON n = n_nationkey) m
  JOIN (SELECT n, id, bl FROM edges WHERE depth = 2) e ON e.n = m.n JOIN h USING (id)),
region_h AS (SELECT r, h FROM edges JOIN h USING (id) WHERE depth = 1)"""

_MONTH_DISTANCE = "CASE WHEN x.loc = y.loc THEN CAST(0 AS DOUBLE) WHEN x.r = y.r THEN x.height + y.height - 2 * g.h ELSE x.height + y.height END"

_PAIRS = "FROM profile x JOIN profile y USING (edge, a) WHERE x.sample < y.sample GROUP BY 1, 2"


@query(star(f"SELECT x.sample sample1, y.sample sample2, ROUND(SUM(ABS(x.r - y.r) * x.len), 6) z1, ROUND(SQRT(SUM(POWER(x.r - y.r, 2) * x.len)), 6) z2 {_PAIRS}", profile_cte()))
def kr(spark, sf_dir):
    """Kantorovich-Rubinstein distances of all samples, p = 1 and p = 2, spread mass."""
    tree, placed = _model(spark, sf_dir)
    prof = P.profile(P.place_mass(placed), tree)
    return _rounded(M.kr_distances(prof, {"z1": 1.0, "z2": 2.0}))


@query(star(f"SELECT x.sample sample1, y.sample sample2, ROUND(SUM(SQRT(ABS(x.r - y.r)) * x.len), 6) distance {_PAIRS}", profile_cte("point")))
def kr_point_half(spark, sf_dir):
    """Distances of point mass with exponent 1/2."""
    tree, placed = _model(spark, sf_dir)
    return _rounded(M.kr_distance(P.profile(P.place_mass(placed, point=True), tree), 0.5))


@query(star(f"SELECT x.sample sample1, y.sample sample2, ROUND(SUM(CASE WHEN (x.r > 1e-5) <> (y.r > 1e-5) THEN x.len ELSE 0 END) / SUM(CASE WHEN x.r > 1e-5 OR y.r > 1e-5 THEN x.len ELSE 0 END), 6) unifrac {_PAIRS}", profile_cte()))
def unifrac(spark, sf_dir):
    """Unweighted UniFrac of all samples."""
    tree, placed = _model(spark, sf_dir)
    return _rounded(M.unifrac(P.profile(P.place_mass(placed), tree)))


@query(star("SELECT CAST(e.id AS BIGINT) edge, ROUND(COALESCE(SUM(CASE WHEN m.sample = 'A' THEN m.m ELSE -m.m END), 0), 6) + 0 heat FROM edges e LEFT JOIN (SELECT * FROM mass WHERE sample IN ('A', 'N')) m ON m.loc >= e.lo AND m.loc <= e.id GROUP BY 1"))
def kr_heat(spark, sf_dir):
    """Net transport over every edge from sample A to sample N."""
    tree, placed = _model(spark, sf_dir)
    return _rounded(M.kr_heat(P.place_mass(placed), tree, "A", "N"))


@query(
    star(
        """SELECT sample, ROUND(SUM(CASE WHEN r > 1e-10 AND ABS(r - 1) > 1e-10 THEN -len * r * LN(r) ELSE 0 END), 6) phylo_entropy,
  ROUND(SUM(len * r * (1 - r)), 6) + 0 quadratic,
  ROUND(SUM(CASE WHEN r > 1e-10 AND ABS(r - 1) > 1e-10 THEN len ELSE 0 END), 6) unrooted_pd,
  ROUND(SUM(CASE WHEN r > 1e-10 THEN len ELSE 0 END), 6) rooted_pd,
  ROUND(SUM(2 * LEAST(r, 1 - r) * len), 6) + 0 bwpd_1,
  ROUND(SUM(SQRT(GREATEST(2 * LEAST(r, 1 - r), 0)) * len), 6) bwpd_0_5,
  ROUND(SUM(CASE WHEN r > 1e-10 THEN len ELSE 0 END) / MAX(t), 6) chao_0_0,
  ROUND(1 / SUM(CASE WHEN r > 1e-10 THEN len * POWER(r / t, 2) ELSE 0 END) / MAX(t), 6) chao_2_0
FROM (SELECT *, SUM(CASE WHEN r > 1e-10 THEN len * r ELSE 0 END) OVER (PARTITION BY sample) t FROM profile) GROUP BY sample""",
        profile_cte("point"),
    )
)
def fpd(spark, sf_dir):
    """Phylogenetic entropies, diversities and balance-weighted diversities of each sample."""
    tree, placed = _model(spark, sf_dir)
    return _rounded(M.diversity(P.profile(P.place_mass(placed, point=True), tree)))


_LEAF_DISTANCE = """CASE WHEN x.loc = y.loc THEN ABS(x.distal_bl - y.distal_bl)
  WHEN x.n = y.n THEN x.height + y.height - 2 * nh.h WHEN x.r = y.r THEN x.height + y.height - 2 * rh.h ELSE x.height + y.height END"""
_LEAVES = """
place_h AS (SELECT p.*, e.n, e.r, h.h - p.distal_bl height FROM unit p JOIN edges e ON e.id = p.loc JOIN h ON h.id = p.loc),
nation_h AS (SELECT n, h FROM edges JOIN h USING (id) WHERE depth = 2),
region_h AS (SELECT r, h FROM edges JOIN h USING (id) WHERE depth = 1)"""


@query(
    star(
        f"""SELECT sample, pq_id, ROUND(COALESCE(s, 0) + 1.1e-8, 6) edpl FROM (SELECT DISTINCT sample, pq_id FROM place_h) LEFT JOIN (
  SELECT x.sample, x.pq_id, 2 * SUM(x.w * y.w * {_LEAF_DISTANCE}) s
  FROM place_h x JOIN place_h y ON x.sample = y.sample AND x.pq_id = y.pq_id AND x.rank_in_pq < y.rank_in_pq
  JOIN nation_h nh ON nh.n = x.n JOIN region_h rh ON rh.r = x.r GROUP BY 1, 2) USING (sample, pq_id)""",
        HEIGHT,
        _LEAVES,
    )
)
def edpl(spark, sf_dir):
    """Expected distance between placements of every query."""
    tree, placed = _model(spark, sf_dir)
    own = P.ranked(placed).drop("ml_ratio", "rank_in_pq").withColumnRenamed("w", "ml_ratio")
    return _rounded(X.edpl(own, tree), 1.1e-8)


@query(
    star(
        """SELECT sample, k, ROUND(SUM(CASE WHEN d > 0 AND d < n THEN (1 - q1 - q2) * len ELSE 0 END), 6) unrooted, ROUND(SUM((1 - q1) * len), 6) rooted,
  ROUND(SUM(len * d * (n - d) * (k - 1) / (k * CAST(n AS DOUBLE) * (n - 1))), 6) quadratic
FROM (SELECT *, q.q1 * 1 q1_, 0 z FROM (
  SELECT c.*, k, CASE k WHEN 2 THEN a1 * a2 WHEN 3 THEN a1 * a2 * a3 ELSE a1 * a2 * a3 * a4 END q1,
         CASE k WHEN 2 THEN b1 * b2 WHEN 3 THEN b1 * b2 * b3 ELSE b1 * b2 * b3 * b4 END q2 FROM
   (SELECT t.*, GREATEST(n - d, 0) / CAST(n AS DOUBLE) a1, GREATEST(n - d - 1, 0) / CAST(n - 1 AS DOUBLE) a2, GREATEST(n - d - 2, 0) / CAST(n - 2 AS DOUBLE) a3, GREATEST(n - d - 3, 0) / CAST(n - 3 AS DOUBLE) a4,
      GREATEST(d, 0) / CAST(n AS DOUBLE) b1, GREATEST(d - 1, 0) / CAST(n - 1 AS DOUBLE) b2, GREATEST(d - 2, 0) / CAST(n - 2 AS DOUBLE) b3, GREATEST(d - 3, 0) / CAST(n - 3 AS DOUBLE) b4
    FROM (SELECT p.sample, CAST(ROUND(r * n_pq) AS BIGINT) d, n_pq n, SUM(len) len FROM profile p JOIN n_pq ON s = p.sample GROUP BY 1, 2, 3) t) c
   CROSS JOIN (SELECT CAST(2 AS BIGINT) k UNION ALL SELECT 3 UNION ALL SELECT 4)) q) GROUP BY 1, 2""",
        profile_cte("point"),
    )
)
def rarefact(spark, sf_dir):
    """Expected diversity of draws of 2, 3 and 4 queries from each sample."""
    tree, placed = _model(spark, sf_dir)
    return _rounded(M.rarefaction(placed, tree, 4))


@query(star("SELECT s.sample, CAST(e.id AS BIGINT) edge, ROUND(1 - 2 * COALESCE(SUM(m.m), 0), 6) x FROM edges e CROSS JOIN (SELECT DISTINCT sample FROM mass) s LEFT JOIN mass m ON m.sample = s.sample AND m.loc >= e.lo AND m.loc < e.id GROUP BY 1, 2"))
def splitify(spark, sf_dir):
    """Split differences of every edge and sample."""
    tree, placed = _model(spark, sf_dir)
    return _rounded(M.splitify(P.place_mass(placed), tree))


@query(star("SELECT sample, CAST(loc AS BIGINT) edge, ROUND(SUM(m), 6) m, ROUND(SUM(m) * 300 / MAX(t), 6) width FROM (SELECT *, SUM(m) OVER (PARTITION BY sample) t FROM mass) GROUP BY 1, 2"))
def fat(spark, sf_dir):
    """Mass and drawn width of every occupied edge."""
    tree, placed = _model(spark, sf_dir)
    return _rounded(M.edge_widths(P.place_mass(placed), tree))


@query()
def bary(spark, sf_dir):
    """Barycentre of each sample."""
    tree, placed = _model(spark, sf_dir)
    return _rounded(M.barycenter(P.place_mass(placed), tree))


@query(star("SELECT sample, CAST((SELECT COUNT(*) FROM edges WHERE is_leaf) AS BIGINT) leaves, COUNT(DISTINCT pq_id) pqueries, CAST(COUNT(DISTINCT pq_id) AS DOUBLE) mass FROM place GROUP BY sample"))
def info(spark, sf_dir):
    """Leaves, queries and mass of each sample."""
    tree, placed = _model(spark, sf_dir)
    names = placed.select("sample", "pq_id", F.col("pq_id").cast("string").alias("name"), F.lit(1.0).alias("mass")).distinct()
    return _rounded(C.info(names, tree))


@query(star("SELECT CAST(COUNT(*) AS BIGINT) n_bad FROM place WHERE distal_bl > bl OR distal_bl < 0"))
def check(spark, sf_dir):
    """Number of placements that lie outside their edge."""
    tree, placed = _model(spark, sf_dir)
    return C.check_places(placed.drop("bl"), tree).agg(F.count("*").alias("n_bad"))


@query(
    star(
        """SELECT p.sample, p.pq_id, CAST(p.loc AS BIGINT) loc, ROUND(LEAST(MIN(p.distal_bl), MIN(CASE WHEN l.id = p.loc THEN p.distal_bl WHEN l.n = p.n THEN p.height + l.h - 2 * nh.h WHEN l.r = p.r THEN p.height + l.h - 2 * rh.h ELSE p.height + l.h END)), 6) distance
FROM (SELECT * FROM place_h WHERE rank_in_pq = 1) p JOIN nation_h nh ON nh.n = p.n JOIN region_h rh ON rh.r = p.r
CROSS JOIN (SELECT id, n, r, h FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY n ORDER BY h, id) o FROM edges JOIN h USING (id) WHERE is_leaf) WHERE o <= 2) l GROUP BY 1, 2, 3""",
        HEIGHT,
        _LEAVES,
    )
)
def adcl(spark, sf_dir):
    """Distance of every query's best placement to the closest leaf."""
    tree, placed = _model(spark, sf_dir)
    return _rounded(X.adcl(placed, tree))


@query(star("SELECT sample, pq_id, CAST(line AS BIGINT) line, ROUND(w + 1.1e-8, 6) ml_ratio FROM unit WHERE rank_in_pq <= 2 AND w >= 0.2"))
def top_placements(spark, sf_dir):
    """The two best placements of every query that hold a fifth of its weight."""
    _, placed = _model(spark, sf_dir)
    return _rounded(P.ranked(placed).where("rank_in_pq <= 2 AND w >= 0.2").select("sample", "pq_id", "line", F.col("w").alias("ml_ratio")), 1.1e-8)


@query(star(f"SELECT x.sample, x.pq_id pq1, y.pq_id pq2, ROUND(SUM(x.ml_ratio * y.ml_ratio * {_MONTH_DISTANCE}) + 1.1e-8, 6) distance FROM monthly x JOIN monthly y ON x.sample = y.sample AND x.pq_id < y.pq_id JOIN region_h g ON g.r = x.r GROUP BY 1, 2, 3", HEIGHT, MONTHLY))
def placemat(spark, sf_dir):
    """Expected distance of every two monthly queries of a sample."""
    tree, placed = monthly(spark, sf_dir)
    return _rounded(X.query_distances(placed, tree, point=False), 1.1e-8)


@query(star("SELECT x.sample, x.pq_id pq1, y.pq_id pq2, ROUND(SUM(x.ml_ratio * y.ml_ratio) + 1.1e-8, 6) overlap FROM monthly x JOIN monthly y ON x.sample = y.sample AND x.loc = y.loc AND x.pq_id > y.pq_id GROUP BY 1, 2, 3", HEIGHT, MONTHLY))
def ograph(spark, sf_dir):
    """Overlap graph of the monthly queries."""
    _, placed = monthly(spark, sf_dir)
    return _rounded(X.overlap_graph(placed), 1.1e-8)


@query()
def distmat(spark, sf_dir):
    """Distances of all pairs of edges."""
    tree, _ = _model(spark, sf_dir)
    far = X.edge_distances(tree)
    return far.select(F.col("edge1").cast("bigint").alias("edge1"), F.col("edge2").cast("bigint").alias("edge2"), "kind", quick_r6("distance").alias("distance"))


ORACLES["distmat"] = star(
    """SELECT CAST(x.id AS BIGINT) edge1, CAST(y.id AS BIGINT) edge2, CASE WHEN x.id >= y.lo THEN 'S' ELSE 'P' END kind,
  ROUND(CASE WHEN x.id >= y.lo THEN x.top - y.h ELSE x.top + y.top - 2 * MAX(a.h) END, 6) + 0 distance
FROM es x JOIN es y ON x.id < y.id JOIN es a ON x.id >= a.lo AND x.id <= a.id AND y.id >= a.lo AND y.id <= a.id
GROUP BY x.id, y.id, x.lo, y.lo, x.top, y.top, y.h""",
    HEIGHT,
    "es AS (SELECT e.*, h.h, h.h - CASE WHEN e.parent_id IS NULL THEN 0 ELSE e.bl END top FROM edges e JOIN h USING (id))",
)


@query(
    star(
        f"""SELECT CAST(x.pq_id AS BIGINT) name, ROUND(SUM({_LEAF_DISTANCE} * x.w) / SUM(x.w) + 1.1e-8, 6) error
FROM place_h x JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pq_id ORDER BY ml_ratio DESC, loc, distal_bl, pendant_bl) o FROM place_h WHERE line <= 2) WHERE o = 1) y ON x.pq_id = y.pq_id
JOIN nation_h nh ON nh.n = x.n JOIN region_h rh ON rh.r = x.r WHERE x.line > 2 GROUP BY 1""",
        HEIGHT,
        _LEAVES,
    )
)
def error(spark, sf_dir):
    """Mean distance of each order's later lines to the best of its first two."""
    tree, placed = _model(spark, sf_dir)
    own = P.ranked(placed).select(F.col("pq_id").alias("name"), "line", "loc", "distal_bl", "pendant_bl", "ml_ratio", "w")
    expected = own.where("line <= 2")
    return _rounded(X.placement_error(expected, own.where("line > 2").drop("ml_ratio").withColumnRenamed("w", "ml_ratio"), tree), 1.1e-8)


@query()
def islands(spark, sf_dir):
    """Islands of the monthly queries by placements of at least 0.07."""
    _, placed = monthly(spark, sf_dir)
    return X.islands(placed, 0.07)


ORACLES["islands"] = star(
    """SELECT sample, pq_id, MIN(island) island FROM reach GROUP BY 1, 2""",
    HEIGHT,
    MONTHLY,
    "links AS (SELECT DISTINCT sample, pq_id, loc FROM monthly WHERE ml_ratio >= 0.07)",
    "near AS (SELECT DISTINCT x.sample, x.pq_id a, y.pq_id b FROM links x JOIN links y ON x.sample = y.sample AND x.loc = y.loc)",
    "reach AS (SELECT sample, a pq_id, b island FROM near UNION SELECT r.sample, n.a, r.island FROM reach r JOIN near n ON n.sample = r.sample AND n.b = r.pq_id)",
).replace("WITH ", "WITH RECURSIVE ", 1)


@query()
def islands_by_order(spark, sf_dir):
    """Islands of the orders by placements of at least 0.07."""
    return X.islands(by_order(spark, sf_dir)[1], 0.07)


ORACLES["islands_by_order"] = star(
    """SELECT sample, pq_id, MIN(island) island FROM reach JOIN links USING (sample, loc) GROUP BY 1, 2""",
    "links AS (SELECT DISTINCT sample, pq_id, loc FROM unit WHERE w >= 0.07)",
    "hops AS (SELECT DISTINCT x.sample, x.loc a, y.loc b FROM links x JOIN links y USING (sample, pq_id))",
    "reach AS (SELECT sample, loc, MIN(pq_id) island FROM links GROUP BY 1, 2 UNION SELECT r.sample, h.b, r.island FROM reach r JOIN hops h ON h.sample = r.sample AND h.a = r.loc)",
).replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    star("""SELECT 'merged' sample, COUNT(DISTINCT sample || '/' || pq_id) pqueries, CAST(COUNT(*) AS BIGINT) placements FROM place""")
)
def merge(spark, sf_dir):
    """Samples A and N and R merged into one."""
    _, placed = _model(spark, sf_dir)
    parts = [placed.where(F.col("sample") == x) for x in ("A", "N", "R")]
    return C.merge(parts).groupBy("sample").agg(F.countDistinct("pq_id").alias("pqueries"), F.count("*").alias("placements"))


@query(
    """SELECT sample, MIN(pq_id) pq_id, CAST(COUNT(*) AS BIGINT) n_pqueries FROM (
  SELECT l_returnflag sample, l_orderkey pq_id, STRING_AGG(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_quantity DESC, l_suppkey) k
  FROM lineitem GROUP BY 1, 2) GROUP BY sample, k"""
)
def round(spark, sf_dir):  # noqa: A001
    """Queries that agree in their edges, whatever the place on them."""
    _, placed = _model(spark, sf_dir)
    flat = placed.select("sample", "pq_id", "suppkey", F.col("suppkey").alias("loc"), F.col("ml_ratio"), F.lit(0.0).alias("distal_bl"), F.lit(0.0).alias("pendant_bl"))
    names = placed.select("sample", "pq_id", F.col("pq_id").cast("string").alias("name"), F.lit(1.0).alias("mass")).distinct()
    return C.rounded(flat, names).select("sample", "pq_id", "n_pqueries")


def _names(spark, sf_dir) -> DataFrame:
    """Names of orders: their customer, with the number of lines as mass; a query is an order, a sample its priority."""
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("sample"), F.col("o_orderkey").alias("pq_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), F.lit(1.0).alias("mass"))
    return o


@query("SELECT o_orderpriority sample, CAST(COUNT(*) AS BIGINT) n FROM orders WHERE NOT regexp_matches('c' || o_custkey, '7$') OR regexp_matches('c' || o_custkey, '^c1') GROUP BY 1")
def filter(spark, sf_dir):  # noqa: A001
    """Names kept by an exclusion and an inclusion."""
    return C.filter_names(_names(spark, sf_dir), include=["^c1"], exclude=["7$"]).groupBy("sample").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag sample, l_orderkey pq_id, CAST(COUNT(*) AS DOUBLE) mass FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1 AND COUNT(*) <= 3")
def filter_mass(spark, sf_dir):
    """Queries of more than one and at most three lines."""
    names = S.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sample"), F.col("l_orderkey").alias("pq_id"), F.col("l_linenumber").cast("string").alias("name"), F.lit(1.0).alias("mass"))
    return C.filter_mass(names, 1, 3).groupBy("sample", "pq_id").agg(F.sum("mass").alias("mass"))


@query("SELECT o_orderpriority sample, CAST(COUNT(*) AS BIGINT) n, COUNT(DISTINCT o_orderkey) pqueries FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def split(spark, sf_dir):
    """Placements split into samples by the priority of their order."""
    _, placed = _model(spark, sf_dir)
    names = placed.select("sample", "pq_id", F.col("pq_id").cast("string").alias("name"), F.lit(1.0).alias("mass")).distinct()
    by = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("grp"))
    return C.split(placed.withColumn("_one", F.lit(1)), names, by)[0].groupBy("sample").agg(F.count("*").alias("n"), F.countDistinct("pq_id").alias("pqueries"))


@query("SELECT l_returnflag sample, CAST(COUNT(*) AS BIGINT) pqueries, CAST(SUM(k) AS BIGINT) placements FROM (SELECT l_returnflag, l_orderkey, MAX(k) k FROM (SELECT *, COUNT(*) OVER (PARTITION BY l_returnflag, l_orderkey) k FROM lineitem) GROUP BY l_returnflag, l_orderkey, l_linenumber) GROUP BY 1")
def demulti(spark, sf_dir):
    """A query for each line, all with their order's placements."""
    _, placed = _model(spark, sf_dir)
    names = placed.select("sample", "pq_id", F.col("line").cast("string").alias("name"), F.lit(1.0).alias("mass")).distinct()
    spread, own = C.one_name_each(placed, names)
    return own.groupBy("sample").agg(F.countDistinct("pq_id").alias("pqueries")).join(spread.groupBy("sample").agg(F.count("*").alias("placements")), "sample")


@query("SELECT o_orderpriority sample, COALESCE('c' || b, 'c' || o_custkey) name, SUM(COALESCE(n, 1)) mass FROM orders LEFT JOIN (SELECT c_nationkey * 100000 + c_custkey b, c_custkey k, CAST(1 + c_custkey % 3 AS DOUBLE) n FROM customer WHERE c_custkey % 2 = 0) ON k = o_custkey GROUP BY 1, 2")
def redup(spark, sf_dir):
    """Names restored from a map of kept ones with counts."""
    m = S.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("kept_id"), F.concat(F.lit("c"), (F.col("c_nationkey") * 100000 + F.col("c_custkey")).cast("string")).alias("orig_id"), (1 + F.col("c_custkey") % 3).alias("count"))
    return C.restore_duplicates(_names(spark, sf_dir), m).groupBy("sample", "name").agg(F.sum("mass").alias("mass"))


@query("SELECT o_orderpriority sample, 'c' || (c_nationkey * 100000 + c_custkey) name, CAST(SUM(1 + c_custkey % 3) AS DOUBLE) mass FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")
def redup_all(spark, sf_dir):
    """Names restored from a map of all customers with counts."""
    m = S.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("kept_id"), F.concat(F.lit("c"), (F.col("c_nationkey") * 100000 + F.col("c_custkey")).cast("string")).alias("orig_id"), (1 + F.col("c_custkey") % 3).alias("count"))
    return C.restore_duplicates(_names(spark, sf_dir), m).groupBy("sample", "name").agg(F.sum("mass").alias("mass"))


@query("SELECT o_orderpriority sample, ROUND(ASINH(COUNT(*)) / SUM(ASINH(COUNT(*))) OVER (PARTITION BY o_orderpriority), 6) mass, 'c' || o_custkey name FROM orders GROUP BY o_orderpriority, o_custkey")
def mft(spark, sf_dir):
    """Multiplicities of customers under asinh, made to sum to 1."""
    names = _names(spark, sf_dir).groupBy("sample", "name").agg(F.sum("mass").alias("mass")).withColumn("pq_id", F.col("name"))
    return _rounded(C.transform_masses(names, "asinh", unitize=True).select("sample", "name", "mass"))


@query("SELECT l_returnflag origin, CAST(l_orderkey AS VARCHAR) name, CAST(COUNT(*) AS BIGINT) n, CAST(SUM(CASE WHEN l_quantity >= 10 THEN 1 ELSE 0 END) AS BIGINT) big FROM lineitem GROUP BY 1, 2")
def to_csv(spark, sf_dir):
    """The table of names and placements, counted by name."""
    _, placed = _model(spark, sf_dir)
    names = placed.select("sample", "pq_id", F.col("pq_id").cast("string").alias("name"), F.lit(1.0).alias("mass")).distinct()
    return C.to_table(placed, names).groupBy("origin", "name").agg(F.count("*").alias("n"), F.count_if(F.col("ml_ratio").cast("double") >= 10).alias("big"))


@query(star("SELECT s.sample, CAST(e.id AS BIGINT) id, ROUND(COALESCE(SUM(m.m), 0), 6) path_mass, COALESCE(SUM(m.m), 0) >= 0.005 kept FROM (SELECT * FROM edges WHERE is_leaf) e CROSS JOIN (SELECT DISTINCT sample FROM mass) s LEFT JOIN mass m ON m.sample = s.sample AND m.loc = e.id GROUP BY 1, 2"))
def trim(spark, sf_dir):
    """Leaves with a path mass of at least 0.005."""
    tree, placed = _model(spark, sf_dir)
    return _rounded(C.trim_leaves(P.place_mass(placed), tree, 0.005))


@query()
def rarefy(spark, sf_dir):
    """A draw of 500 orders of each priority."""
    return C.rarefy(_names(spark, sf_dir), 500, seed=3).groupBy("sample").agg(F.sum("mass").alias("mass"))


ORACLES["rarefy"] = "SELECT o_orderpriority sample, CAST(LEAST(COUNT(*), 500) AS DOUBLE) mass FROM orders GROUP BY 1"


# -- taxonomy


def taxa_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(taxa, ranks): regions, nations and suppliers."""
    r = S.table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("tax_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("region").alias("rank"), F.col("r_name").alias("tax_name"))
    n = S.table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("tax_id"), F.concat(F.lit("R"), "n_regionkey").alias("parent_id"), F.lit("nation").alias("rank"), F.col("n_name").alias("tax_name"))
    s = S.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("tax_id"), F.concat(F.lit("N"), "s_nationkey").alias("parent_id"), F.lit("supplier").alias("rank"), F.col("s_name").alias("tax_name"))
    return r.unionByName(n).unionByName(s), spark.createDataFrame([("region", 0), ("nation", 1), ("supplier", 2)], "rank string, rank_order int")


def _classified(spark, sf_dir) -> DataFrame:
    _, placed = _model(spark, sf_dir)
    return P.ranked(placed).withColumn("classification", F.concat(F.lit("S"), F.col("suppkey").cast("string")))


_SHARES = """
shares AS (
  SELECT sample, pq_id, 'supplier' rank, 2 o, 'S' || suppkey tax_id, SUM(w) l FROM unit GROUP BY 1, 2, suppkey
  UNION ALL SELECT sample, pq_id, 'nation', 1, 'N' || s_nationkey, SUM(w) FROM unit JOIN supplier ON s_suppkey = suppkey GROUP BY 1, 2, s_nationkey
  UNION ALL SELECT sample, pq_id, 'region', 0, 'R' || n_regionkey, SUM(w) FROM unit JOIN supplier ON s_suppkey = suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2, n_regionkey),
judged AS (SELECT *, MAX(l) OVER own top, ROW_NUMBER() OVER (PARTITION BY sample, pq_id, rank ORDER BY l DESC, tax_id) k, SUM(CASE WHEN l >= 0.2 - 1e-12 THEN l ELSE 0 END) OVER own s
  FROM shares WINDOW own AS (PARTITION BY sample, pq_id, rank)),
best AS (SELECT * FROM judged WHERE (top >= 0.9 - 1e-12 AND k = 1) OR (top < 0.9 - 1e-12 AND l >= 0.2 - 1e-12 AND s >= 0.9 - 1e-12)),
occupied AS (SELECT DISTINCT sample, pq_id, o, rank FROM best),
wanted AS (SELECT 'region' want_rank, 0 w UNION ALL SELECT 'nation', 1 UNION ALL SELECT 'supplier', 2),
multiclass AS (
  SELECT b.sample, b.pq_id, x.want_rank, b.rank, b.tax_id, b.l likelihood FROM
   (SELECT sample, pq_id, want_rank, MAX(o) o FROM occupied JOIN wanted ON o <= w GROUP BY 1, 2, 3) x JOIN best b ON b.sample = x.sample AND b.pq_id = x.pq_id AND b.o = x.o)"""


@query(star("SELECT sample, pq_id, want_rank, rank, tax_id, ROUND(likelihood + 1.1e-8, 6) likelihood FROM multiclass", _SHARES))
def classify(spark, sf_dir):
    """Every query classified at every wanted rank."""
    taxa, ranks = taxa_of(spark, sf_dir)
    return _rounded(T.classify(_classified(spark, sf_dir), T.lineage(taxa, ranks), ranks), 1.1e-8)


@query("SELECT tax_id, anc_tax_id, rank FROM (SELECT 'S' || s_suppkey tax_id, 'S' || s_suppkey anc_tax_id, 'supplier' rank FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'nation' FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'R' || n_regionkey, 'region' FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'N' || n_nationkey, 'N' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'region' FROM nation UNION ALL SELECT 'R' || r_regionkey, 'R' || r_regionkey, 'region' FROM region)")
def lineage(spark, sf_dir):
    """Lineage of every taxon."""
    return T.lineage(*taxa_of(spark, sf_dir)).select("tax_id", "anc_tax_id", "rank")


@query(
    star(
        """SELECT sample, pq_id, rank, ROUND(evidence + 1.1e-8, 6) evidence, CASE WHEN k = 1 THEN NULL ELSE ROUND(LN(evidence / p) + 1.1e-8, 6) + 0 END bayes_factor FROM (
  SELECT *, LAG(evidence) OVER (PARTITION BY sample, pq_id ORDER BY o) p, ROW_NUMBER() OVER (PARTITION BY sample, pq_id ORDER BY o) k FROM (
    SELECT sample, pq_id, rank, o, SUM(l / n_edges) evidence FROM shares JOIN painted USING (tax_id) GROUP BY 1, 2, 3, 4))""",
        _SHARES,
        "painted AS (SELECT 'S' || s_suppkey tax_id, 1 n_edges FROM supplier UNION ALL SELECT 'N' || s_nationkey, COUNT(*) + 1 FROM supplier GROUP BY 1 UNION ALL SELECT 'R' || n_regionkey, COUNT(*) + 1 FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)",
    )
)
def bayes_factors(spark, sf_dir):
    """Evidence and Bayes factors of every query and rank (an infinite factor is null here)."""
    taxa, ranks = taxa_of(spark, sf_dir)
    lines = T.lineage(taxa, ranks)
    shares = T.roll_up(_classified(spark, sf_dir), lines)
    painted = lines.where("substring(tax_id, 1, 1) = 'S'").groupBy(F.col("anc_tax_id").alias("t")).agg(F.count("*").alias("c")).select(F.col("t").alias("tax_id"), F.when(F.substring("t", 1, 1) == "S", F.col("c")).otherwise(F.col("c") + 1).alias("n_edges"))
    out = T.evidence(shares, painted)
    return _rounded(out.select("sample", "pq_id", "rank", "evidence", F.when(F.col("bayes_factor") < float("inf"), F.col("bayes_factor")).alias("bayes_factor")), 1.1e-8)


def _leaf_taxa(spark, sf_dir, tree) -> DataFrame:
    """Two ranks of colours of leaves: their nation, and a remainder that cuts across the tree."""
    leaf = tree.where("is_leaf")
    one = leaf.select("id", F.lit("nation").alias("rank"), F.lit(0).alias("rank_order"), F.concat(F.lit("N"), F.col("n").cast("string")).alias("color"))
    return one.unionByName(leaf.select("id", F.lit("rest").alias("rank"), F.lit(1).alias("rank_order"), F.concat(F.lit("X"), (F.col("k") % 7).cast("string")).alias("color")))


_COLORS = """
leaf_taxa AS (SELECT id, 'nation' rank, 0 o, 'N' || n color FROM edges WHERE is_leaf UNION ALL SELECT id, 'rest', 1, 'X' || (k % 7) FROM edges WHERE is_leaf),
totals AS (SELECT rank, o, color, COUNT(*) n_leaves FROM leaf_taxa GROUP BY 1, 2, 3),
under AS (SELECT rank, o, e.id edge, e.parent_id, color, COUNT(*) b FROM leaf_taxa l JOIN edges e ON l.id >= e.lo AND l.id <= e.id GROUP BY 1, 2, 3, 4, 5),
cut AS (SELECT u.rank, u.o, edge, u.color FROM under u JOIN totals t USING (rank, color) WHERE b < n_leaves)"""


@query(star("SELECT CAST(edge AS BIGINT) edge, color FROM cut WHERE rank = 'rest'", _COLORS))
def cut_sets(spark, sf_dir):
    """Cut-sets of all edges."""
    tree, _ = _model(spark, sf_dir)
    colors = _leaf_taxa(spark, sf_dir, tree).where("rank = 'rest'").select("id", "color")
    return _rounded(T.cut_sets(tree, colors))


@query(star("SELECT t.rank, t.color tax_id, t.n_leaves FROM totals t WHERE NOT EXISTS (SELECT 1 FROM cut c JOIN (SELECT rank, edge FROM cut GROUP BY 1, 2 HAVING COUNT(*) >= 2) d ON c.rank = d.rank AND c.edge = d.edge WHERE c.rank = t.rank AND c.color = t.color)", _COLORS))
def convex_taxids(spark, sf_dir):
    """Taxa that are convex on the tree."""
    tree, _ = _model(spark, sf_dir)
    return T.convex_taxids(tree, _leaf_taxa(spark, sf_dir, tree))


@query(star("SELECT CAST(edge AS BIGINT) edge, rank, color tax_id FROM (SELECT edge, rank, o, MIN(color) color, ROW_NUMBER() OVER (PARTITION BY edge ORDER BY o DESC) k FROM (SELECT u.rank, u.o, edge, u.color FROM under u JOIN totals t USING (rank, color) WHERE b < n_leaves OR parent_id IS NULL) GROUP BY 1, 2, 3 HAVING COUNT(*) = 1) WHERE k = 1", _COLORS))
def painting(spark, sf_dir):
    """Edges painted by the most specific rank with one colour."""
    tree, _ = _model(spark, sf_dir)
    return _rounded(T.painting(tree, _leaf_taxa(spark, sf_dir, tree)))


@query(star("SELECT rank, COUNT(DISTINCT color) n_taxids, COALESCE(MAX(nb), 0) n_nonconvex, COALESCE(MAX(mb), 0) max_badness, CAST(COALESCE(MAX(tb), 0) AS BIGINT) tot_badness FROM leaf_taxa LEFT JOIN (SELECT rank, MAX(bad) mb, SUM(bad) tb FROM (SELECT rank, edge, COUNT(*) - 1 bad FROM cut GROUP BY 1, 2) GROUP BY 1) USING (rank) LEFT JOIN (SELECT rank, COUNT(DISTINCT color) nb FROM cut JOIN (SELECT rank, edge FROM cut GROUP BY 1, 2 HAVING COUNT(*) > 1) USING (rank, edge) GROUP BY 1) USING (rank) GROUP BY 1", _COLORS))
def taxonomic_info(spark, sf_dir):
    """Taxa, non-convex taxa and badness of each rank."""
    tree, _ = _model(spark, sf_dir)
    return T.taxonomic_info(tree, _leaf_taxa(spark, sf_dir, tree))


@query("SELECT CAST(l_orderkey AS BIGINT) l_orderkey, CASE WHEN COUNT(DISTINCT s_suppkey) = 1 THEN 'S' || MIN(s_suppkey) WHEN COUNT(DISTINCT s_nationkey) = 1 THEN 'N' || MIN(s_nationkey) ELSE 'R' || MIN(n_regionkey) END tax_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY l_orderkey HAVING COUNT(DISTINCT n_regionkey) = 1")
def mrca(spark, sf_dir):
    """Deepest common taxon of the suppliers of each order."""
    taxa, ranks = taxa_of(spark, sf_dir)
    groups = S.table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("tax_id"))
    return T.common_ancestor(groups, T.lineage(taxa, ranks), "l_orderkey")


@query("SELECT CAST(s_suppkey AS VARCHAR) seqname, '>' || s_suppkey || chr(9) || 'Root;' || regexp_replace(r_name, '[\\s;]+', '_', 'g') || ';' || regexp_replace(n_name, '[\\s;]+', '_', 'g') line FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def to_rdp(spark, sf_dir):
    """Headers with the lineage of every supplier."""
    taxa, ranks = taxa_of(spark, sf_dir)
    seqs = S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("seqname"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("tax_id"))
    return T.to_rdp(seqs, taxa, T.lineage(taxa, ranks), ranks, ["region", "nation"])


@query("SELECT CAST(l_partkey AS BIGINT) name, MAX(l_extendedprice) pident FROM lineitem GROUP BY 1")
def blast(spark, sf_dir):
    """The best hit of each part."""
    hits = S.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("tax_id"), F.col("l_extendedprice").alias("pident"))
    return T.classify_blast(hits).select("name", "pident")


# -- warehouse


def _facts(spark, sf_dir):
    taxa, ranks = taxa_of(spark, sf_dir)
    multi = written(T.classify(_classified(spark, sf_dir), T.lineage(taxa, ranks), ranks).select(F.concat_ws("/", "sample", F.col("pq_id").cast("string")).alias("placement_id"), F.col("pq_id").cast("string").alias("name"), "want_rank", "rank", "tax_id", "likelihood"), "multiclass")
    names = multi.select("placement_id", "name").distinct().withColumn("mass", F.lit(1.0))
    return taxa, multi, names


_CONCAT = """
concat AS (SELECT sample || '/' || pq_id placement_id, CAST(pq_id AS VARCHAR) name, want_rank, STRING_AGG(DISTINCT tax_id, ',' ORDER BY tax_id) tax_id, MIN(rank) rank, COUNT(DISTINCT tax_id) id_count FROM multiclass GROUP BY sample, pq_id, want_rank),
taxa AS (SELECT 'R' || r_regionkey tax_id, r_name tax_name, 'region' rank FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 'nation' FROM nation UNION ALL SELECT 'S' || s_suppkey, s_name, 'supplier' FROM supplier)"""


@query(star("SELECT * FROM concat", _SHARES, _CONCAT))
def multiclass_concat(spark, sf_dir):
    """Results of several taxa joined."""
    return H.concat_multiclass(_facts(spark, sf_dir)[1])


@query(star("SELECT tax_id, COALESCE(MAX(tax_name), 'unclassified') tax_name, MAX(t.rank) rank, CAST(COUNT(*) AS BIGINT) tally, COUNT(DISTINCT placement_id) placements FROM concat LEFT JOIN taxa t USING (tax_id) WHERE want_rank = 'nation' GROUP BY tax_id", _SHARES, _CONCAT))
def tally_by_taxon(spark, sf_dir):
    """Tally of the wanted rank nation."""
    taxa, multi, names = _facts(spark, sf_dir)
    return H.tally_by_taxon(H.concat_multiclass(multi), names, taxa.select("tax_id", "tax_name", "rank"), "nation")


@query(star("SELECT specimen, tax_id, COALESCE(MAX(tax_name), tax_id) tax_name, CAST(COUNT(*) AS DOUBLE) tally, ROUND(COUNT(*) / CAST(SUM(COUNT(*)) OVER (PARTITION BY specimen) AS DOUBLE), 6) freq FROM concat JOIN (SELECT CAST(o_orderkey AS VARCHAR) name, o_orderpriority specimen FROM orders) USING (name) LEFT JOIN taxa t USING (tax_id) WHERE want_rank = 'region' GROUP BY specimen, tax_id", _SHARES, _CONCAT))
def tally_by_specimen(spark, sf_dir):
    """Tally of the wanted rank region by order priority."""
    taxa, multi, names = _facts(spark, sf_dir)
    specimens = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("specimen"))
    return _rounded(H.tally_by_specimen(H.concat_multiclass(multi), names, taxa, specimens, "region"))


@query(star("SELECT tax_id, MAX(CASE WHEN id_count > 1 THEN rank END) rank, CAST(MAX(id_count) AS BIGINT) n FROM concat WHERE id_count > 1 GROUP BY tax_id", _SHARES, _CONCAT))
def concat_taxa(spark, sf_dir):
    """Joined ids that become new taxa."""
    taxa, multi, _ = _facts(spark, sf_dir)
    new = H.concat_taxa(H.concat_multiclass(multi), taxa.select("tax_id", "tax_name"))
    return new.groupBy("tax_id").agg(F.max("rank").alias("rank"), F.max(F.size(F.split("tax_id", ","))).cast("long").alias("n"))


@query("SELECT doc_id kept, CAST(n AS BIGINT) n FROM (SELECT MIN(doc_id) doc_id, COUNT(*) n FROM documents GROUP BY text)")
def dedup_sequences(spark, sf_dir):
    """Equal texts, the least id kept."""
    seqs = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("seq"))
    return C.dedup_sequences(seqs).select(F.col("kept_id").alias("kept"), F.col("count").alias("n"))
