"""More queries over the star schema, each with its SQL: whole rows of operators that other queries only count."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans import profile as P, star as S
from ..plans.sql import HEIGHT, profile_cte, star
from . import clusters as K, collections as C, measures as M, more_queries, pairs as X, taxonomy as T, trimming as R, warehouse as H
from .queries import _COLORS, _CONCAT, _LEAF_DISTANCE, _LEAVES, _SHARES, ORACLES, QUERIES, _classified, _facts, _leaf_taxa, _model, _names, _rounded, by_order, query, taxa_of

#: Moves exact halves of the sixth decimal off the edge, on both sides.
SHIFT = 1.1e-8


def _own_names(placed: DataFrame) -> DataFrame:
    return placed.select("sample", "pq_id", F.col("pq_id").cast("string").alias("name"), F.lit(1.0).alias("mass")).distinct()


# -- collections, row by row


@query(star("SELECT 'merged' sample, sample || '/' || pq_id pq_id, CAST(line AS BIGINT) line, CAST(loc AS BIGINT) loc, ml_ratio, ROUND(distal_bl, 6) distal_bl FROM place"))
def merge_rows(spark, sf_dir):
    """Every placement of the merged samples."""
    _, placed = _model(spark, sf_dir)
    return _rounded(C.merge([placed.where(F.col("sample") == x) for x in ("A", "N", "R")]).select("sample", "pq_id", "line", "loc", "ml_ratio", "distal_bl"))


@query(star("SELECT o_orderpriority sample, pq_id, CAST(line AS BIGINT) line, CAST(loc AS BIGINT) loc, ml_ratio FROM place JOIN orders ON o_orderkey = pq_id"))
def split_rows(spark, sf_dir):
    """Every placement under the priority of its order."""
    _, placed = _model(spark, sf_dir)
    by = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("grp"))
    return _rounded(C.split(placed, _own_names(placed), by)[0].select("sample", "pq_id", "line", "loc", "ml_ratio"))


@query(star("SELECT p.sample, p.pq_id || '/' || n.line pq_id, CAST(p.line AS BIGINT) line, CAST(p.loc AS BIGINT) loc FROM place p JOIN (SELECT DISTINCT sample, pq_id, line FROM place) n USING (sample, pq_id)"))
def demulti_rows(spark, sf_dir):
    """Every placement of every line's own query."""
    _, placed = _model(spark, sf_dir)
    names = placed.select("sample", "pq_id", F.col("line").cast("string").alias("name"), F.lit(1.0).alias("mass")).distinct()
    return _rounded(C.one_name_each(placed, names)[0].select("sample", "pq_id", "line", "loc"))


@query("SELECT o_orderpriority sample, o_orderkey pq_id, 'c' || o_custkey name FROM orders WHERE NOT regexp_matches('c' || o_custkey, '7$') OR regexp_matches('c' || o_custkey, '^c1')")
def filter_rows(spark, sf_dir):
    """Names kept by an exclusion and an inclusion."""
    return C.filter_names(_names(spark, sf_dir), include=["^c1"], exclude=["7$"]).select("sample", "pq_id", "name")


@query("SELECT o_orderpriority sample, o_orderkey pq_id, 'c' || o_custkey name FROM orders WHERE regexp_matches('c' || o_custkey, '^c1') AND NOT regexp_matches('c' || o_custkey, '7$')")
def filter_default_exclude(spark, sf_dir):
    """Names of an inclusion that no exclusion meets."""
    return C.filter_names(_names(spark, sf_dir), include=["^c1"], exclude=["7$"], default_exclude=True).select("sample", "pq_id", "name")


@query("SELECT l_returnflag origin, CAST(l_orderkey AS VARCHAR) name, CAST(l_suppkey AS VARCHAR) classification, CAST(l_quantity AS DOUBLE) weight, 'NA' map_ratio FROM lineitem")
def to_csv_rows(spark, sf_dir):
    """The table of names and placements."""
    _, placed = _model(spark, sf_dir)
    table = C.to_table(placed.withColumn("classification", F.col("suppkey")), _own_names(placed))
    return table.select("origin", "name", "classification", F.col("ml_ratio").cast("double").alias("weight"), "map_ratio")


@query(star("SELECT sample, pq_id, CAST(loc AS BIGINT) loc, ROUND(distal_bl, 6) distal_bl, ROUND(bl / 2, 6) edge_bl FROM place WHERE distal_bl > bl / 2 OR distal_bl < 0"))
def check_rows(spark, sf_dir):
    """Placements that would lie outside their edge if it were half as long."""
    tree, placed = _model(spark, sf_dir)
    return _rounded(C.check_places(placed.drop("bl"), tree.withColumn("bl", F.col("bl") / 2)))


@query(star("SELECT sample, pq_id, ROUND(SUM(ml_ratio / 50) + 1.1e-8, 6) total, CAST(SUM(CASE WHEN ml_ratio = 0 THEN 1 ELSE 0 END) AS BIGINT) n_zero FROM place GROUP BY 1, 2 HAVING ABS(SUM(ml_ratio / 50) - 1) > 1e-4 OR SUM(CASE WHEN ml_ratio = 0 THEN 1 ELSE 0 END) > 0"))
def check_weights(spark, sf_dir):
    """Queries whose weights (quantity over 50) do not sum to 1."""
    _, placed = _model(spark, sf_dir)
    out = C.check_weights(placed.withColumn("ml_ratio", F.col("ml_ratio") / 50))
    return _rounded(out.withColumn("n_zero", F.col("n_zero").cast("long")), SHIFT)


@query(
    star(
        """SELECT sample, MIN(pq_id) pq_id, STRING_AGG(CAST(pq_id AS VARCHAR), ',' ORDER BY CAST(pq_id AS VARCHAR)) names, CAST(COUNT(*) AS DOUBLE) mass, CAST(COUNT(*) AS BIGINT) n_pqueries FROM (
  SELECT sample, pq_id, STRING_AGG(loc || ':' || ROUND(distal_bl, 1) || ':' || ROUND(pendant_bl, 1), ';' ORDER BY w DESC, loc, ROUND(distal_bl, 1), ROUND(pendant_bl, 1)) key FROM unit WHERE w >= 0.3 GROUP BY 1, 2) GROUP BY sample, key"""
    )
)
def round_rows(spark, sf_dir):
    """Orders that agree in their larger placements, rounded to one decimal."""
    _, placed = by_order(spark, sf_dir)
    out = C.rounded(placed, _own_names(placed), 1, 0.3)
    return out.select("sample", "pq_id", F.array_join("names", ",").alias("names"), "mass", "n_pqueries")


@query("SELECT 'R' || r_regionkey tax_id, CAST(NULL AS VARCHAR) parent_id, 'region' rank, CAST(0 AS BIGINT) rank_order, r_name tax_name FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'nation', 1, n_name FROM nation UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'supplier', 2, s_name FROM supplier")
def prep_db_rows(spark, sf_dir):
    """The warehouse's dimensions, row by row."""
    taxa, ranks = taxa_of(spark, sf_dir)
    return taxa.join(ranks, "rank").select("tax_id", "parent_id", "rank", F.col("rank_order").cast("bigint").alias("rank_order"), "tax_name")


@query("SELECT CAST(l_partkey AS BIGINT) name, MAX(l_extendedprice) pident, CAST(arg_min(l_suppkey, {'o': -l_extendedprice, 's': l_suppkey}) AS BIGINT) tax_id FROM lineitem GROUP BY 1")
def blast_rows(spark, sf_dir):
    """The best hit of each part, and where it hits."""
    hits = S.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("tax_id"), F.col("l_extendedprice").alias("pident"))
    return T.classify_blast(hits).select("name", "pident", "tax_id")


@query(
    star(
        """SELECT c.tax_id, MAX(c.rank) rank, CASE WHEN COUNT(DISTINCT split_part(t.tax_name, '_', 1)) = 1 AND COUNT(DISTINCT t.tax_name) > 0 AND BOOL_AND(contains(t.tax_name, '_'))
  THEN MIN(split_part(t.tax_name, '_', 1)) || ' ' || STRING_AGG(DISTINCT substr(t.tax_name, instr(t.tax_name, '_') + 1), '/' ORDER BY substr(t.tax_name, instr(t.tax_name, '_') + 1))
  ELSE STRING_AGG(DISTINCT t.tax_name, '/' ORDER BY t.tax_name) END tax_name
FROM (SELECT DISTINCT tax_id, rank, UNNEST(string_split(tax_id, ',')) one FROM concat WHERE id_count > 1) c JOIN taxa t ON t.tax_id = c.one GROUP BY 1""",
        _SHARES,
        _CONCAT,
    )
)
def concat_taxa_rows(spark, sf_dir):
    """Joined ids that become new taxa, with their names; underscores stand for blanks."""
    taxa, multi, _ = _facts(spark, sf_dir)
    named = taxa.select("tax_id", F.translate("tax_name", "_", " ").alias("tax_name"))
    return H.concat_taxa(H.concat_multiclass(multi), named).select("tax_id", "rank", "tax_name")


@query("SELECT MIN(m.kept) kept_id, MIN(d.doc_id) orig_id, CAST(COUNT(*) AS BIGINT) count, lang split FROM documents d JOIN (SELECT text, MIN(doc_id) kept FROM documents GROUP BY text) m ON m.text = d.text GROUP BY d.text, lang")
def dedup_by_split(spark, sf_dir):
    """Equal texts, the least id of each language standing for those of that language."""
    seqs = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("seq"), F.col("lang").alias("split"))
    per = C.dedup_sequences(seqs, "split")
    return per.join(seqs.select(F.col("name").alias("orig_id"), "split"), "orig_id").select("kept_id", "orig_id", "count", "split")


@query("SELECT o_orderpriority sample, o_orderkey pq_id, 'c' || o_custkey name, CAST(1 AS DOUBLE) mass FROM orders, range(1 + o_custkey % 3) r")
def duplicate_by_count(spark, sf_dir):
    """Each order's customer as often as a whole mass says."""
    names = S.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("sample"), F.col("o_orderkey").alias("pq_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), (1 + F.col("o_custkey") % 3).cast("double").alias("mass"))
    return C.duplicate_by_count(names)


@query("SELECT o_orderpriority sample, o_orderkey pq_id, 'c' || o_custkey name, CAST(1 AS DOUBLE) mass FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def placed_only(spark, sf_dir):
    """Orders with a large line."""
    big = S.table(spark, sf_dir, "lineitem").where("l_quantity > 45").join(S.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("sample"), F.col("o_orderkey").alias("pq_id"))
    return C.placed_only(_names(spark, sf_dir), big)


@query(star("SELECT DISTINCT sample, pq_id FROM (SELECT sample, pq_id, n_regionkey r, n_nationkey n, SUM(w) OVER (PARTITION BY sample, pq_id, n_regionkey) wr, SUM(w) OVER (PARTITION BY sample, pq_id, n_nationkey) wn FROM unit JOIN supplier ON s_suppkey = suppkey JOIN nation ON n_nationkey = s_nationkey) WHERE (r = 1 AND wr > 0.6) OR (n = 3 AND wn > 0.6)"))
def filter_taxa(spark, sf_dir):
    """Queries more than 0.6 of whose weight lies in one region or one nation."""
    taxa, ranks = taxa_of(spark, sf_dir)
    own = _classified(spark, sf_dir).drop("ml_ratio").withColumnRenamed("w", "ml_ratio")
    return C.filter_taxa(own, T.lineage(taxa, ranks), ["R1", "N3"], 0.6)


@query(star("SELECT sample, pq_id, CAST(line AS BIGINT) line, ROUND(EXP(s - top) / SUM(EXP(s - top)) OVER (PARTITION BY sample, pq_id) + 1.1e-8, 6) ml_ratio FROM (SELECT *, log_like / 20000 s, MAX(log_like / 20000) OVER (PARTITION BY sample, pq_id) top, ROW_NUMBER() OVER (PARTITION BY sample, pq_id ORDER BY log_like DESC, loc) k FROM place) WHERE k <= 3 AND s >= top + LN(0.2)"))
def keep_best(spark, sf_dir):
    """The three likeliest placements of every query within a fifth of the best, weighed by their likelihoods."""
    _, placed = _model(spark, sf_dir)
    return _rounded(C.keep_best(placed.withColumn("log_like", F.col("log_like") / 20000), 3, 0.2).select("sample", "pq_id", "line", "ml_ratio"), SHIFT)


@query(star("SELECT sample, pq_id, CAST(line AS BIGINT) line FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample, pq_id ORDER BY log_like DESC, line, loc, distal_bl, pendant_bl) k FROM place) WHERE k = 1"))
def best_by_posterior(spark, sf_dir):
    """The best placement of every query by another criterion, which every placement must have."""
    _, placed = _model(spark, sf_dir)
    own = P.required(placed.withColumn("post_prob", F.col("log_like")), "post_prob")
    return _rounded(P.ranked(own, "post_prob").where("rank_in_pq = 1").select("sample", "pq_id", "line"))


@query(star("SELECT sample, name, ROUND(m / SUM(m) OVER (PARTITION BY sample), 6) + 0 mass FROM (SELECT p.sample, CAST(p.pq_id AS VARCHAR) name, LN(1 + p.pq_id % 5) * (1 + e.k % 4) m FROM (SELECT * FROM unit WHERE rank_in_pq = 1) p JOIN edges e ON e.id = p.loc)"))
def mft_scaled(spark, sf_dir):
    """Logarithms of multiplicities, scaled by the value of the leaf that an order lies at, made to sum to 1."""
    tree, placed = _model(spark, sf_dir)
    best = P.ranked(placed).where("rank_in_pq = 1").select("sample", "pq_id", "loc")
    names = best.select("sample", "pq_id", F.col("pq_id").cast("string").alias("name"), (1 + F.col("pq_id") % 5).cast("double").alias("mass"))
    values = tree.where("is_leaf").select(F.col("id").alias("loc"), (1 + F.col("k") % 4).cast("double").alias("value"))
    return _rounded(C.transform_masses(names, "log", values, best, unitize=True).select("sample", "name", "mass"))


@query("SELECT o_orderpriority sample, 'c' || o_custkey name, CAST(SUM(2 + o_custkey % 3) AS DOUBLE) mass FROM orders GROUP BY 1, 2")
def redup_as_mass(spark, sf_dir):
    """Names that keep their own name, with the counts of what they stand for as mass."""
    c = S.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("kept_id"), "c_custkey")
    m = c.select("kept_id", F.col("kept_id").alias("orig_id"), F.lit(1).cast("long").alias("count")).unionByName(c.select("kept_id", F.concat("kept_id", F.lit("b")).alias("orig_id"), (1 + F.col("c_custkey") % 3).alias("count")))
    return C.restore_duplicates(_names(spark, sf_dir), m, as_mass=True).groupBy("sample", "name").agg(F.sum("mass").alias("mass"))


_DRAWS = "md5('7:' || o_orderpriority || ':' || o_orderkey || ':c' || o_custkey || ':' || (r.range + 1))"


@query(f"SELECT sample, pq_id, name, CAST(COUNT(*) AS DOUBLE) mass FROM (SELECT o_orderpriority sample, o_orderkey pq_id, 'c' || o_custkey name, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY {_DRAWS}, o_orderkey, o_custkey, r.range) k FROM orders, range(1 + o_custkey % 3) r) WHERE k <= 500 GROUP BY 1, 2, 3")
def rarefy_rows(spark, sf_dir):
    """A draw of 500 reads of each priority without replacement, one to three reads an order."""
    names = _names(spark, sf_dir).withColumn("mass", (1 + F.substring("name", 2, 20).cast("long") % 3).cast("double"))
    return C.rarefy(names, 500, seed=7)


@query(
    """SELECT sample, pq_id, name, CAST(COUNT(*) AS DOUBLE) mass FROM
  (SELECT o_orderpriority s, CAST('0x' || substr(md5('7:' || o_orderpriority || ':' || (r.range + 1)), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) u FROM (SELECT DISTINCT o_orderpriority FROM orders), range(500) r) d
JOIN (SELECT *, SUM(mass) OVER o - mass lo, SUM(mass) OVER o hi, SUM(mass) OVER (PARTITION BY sample) total FROM
  (SELECT o_orderpriority sample, o_orderkey pq_id, 'c' || o_custkey name, CAST(1 + o_custkey % 3 AS DOUBLE) mass, substr(md5(o_orderkey || ':c' || o_custkey), 1, 3) b FROM orders)
  WINDOW o AS (PARTITION BY sample ORDER BY b, pq_id, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) n ON n.sample = d.s AND u * total >= lo AND u * total < hi GROUP BY 1, 2, 3"""
)
def rarefy_with_replacement(spark, sf_dir):
    """500 reads of each priority drawn with replacement, in proportion to mass."""
    names = _names(spark, sf_dir).withColumn("mass", (1 + F.substring("name", 2, 20).cast("long") % 3).cast("double"))
    return C.rarefy_multinomial(names, 500, seed=7)


# -- trimming


_TRIM = """
leaf_mass AS (SELECT e.id, e.n, e.r, e.bl, COALESCE(m, 0) >= 0.0105 kept FROM edges e LEFT JOIN (SELECT loc, SUM(m.m) / MAX(c) m FROM mass m CROSS JOIN (SELECT COUNT(*) c FROM n_pq) GROUP BY loc) ON loc = e.id WHERE e.is_leaf),
nation_kept AS (SELECT n, COUNT(*) FILTER (WHERE kept) k, MAX(CASE WHEN kept THEN id END) sole, MAX(CASE WHEN kept THEN bl END) sole_bl FROM leaf_mass GROUP BY n),
nations AS (SELECT e.id, e.n, e.r, e.bl, COALESCE(x.k, 0) k, CASE WHEN x.k = 1 THEN sole ELSE e.id END low, CASE WHEN x.k = 1 THEN sole_bl ELSE 0 END add FROM edges e LEFT JOIN nation_kept x USING (n) WHERE e.depth = 2),
region_kept AS (SELECT r, COUNT(*) FILTER (WHERE k > 0) k, MAX(CASE WHEN k > 0 THEN low END) sole, MAX(CASE WHEN k > 0 THEN bl + add END) sole_bl FROM nations GROUP BY r),
regions AS (SELECT e.id, e.r, e.bl, COALESCE(x.k, 0) k, CASE WHEN x.k = 1 THEN sole ELSE e.id END low, CASE WHEN x.k = 1 THEN sole_bl ELSE 0 END add FROM edges e LEFT JOIN region_kept x USING (r) WHERE e.depth = 1),
moves AS (SELECT id loc, id low, CAST(0 AS DOUBLE) add, CAST(NULL AS DOUBLE) far FROM leaf_mass WHERE kept
  UNION ALL SELECT l.id, CASE WHEN n.k > 0 THEN n.low WHEN r.k > 0 THEN r.low ELSE (SELECT MAX(id) FROM edges) END, CASE WHEN n.k > 0 THEN n.add WHEN r.k > 0 THEN r.add ELSE 0 END,
    l.bl + CASE WHEN n.k > 0 THEN 0 ELSE n.bl END + CASE WHEN n.k > 0 OR r.k > 0 THEN 0 ELSE r.bl END FROM leaf_mass l JOIN nations n USING (n) JOIN regions r ON r.r = l.r WHERE NOT kept),
trimmed AS (SELECT u.sample, u.pq_id, u.line, low, add + CASE WHEN far IS NULL THEN distal_bl ELSE 0 END distal_bl, CASE WHEN far IS NULL THEN pendant_bl ELSE far - distal_bl + pendant_bl END pendant_bl, far, w
  FROM unit u JOIN moves USING (loc))"""


def _trimmed(spark, sf_dir, rewrite: bool) -> DataFrame:
    tree, placed = by_order(spark, sf_dir)
    out = R.trim(placed, _own_names(placed), tree, 0.0105, rewrite=rewrite).placements
    return _rounded(out.select("sample", "pq_id", "line", "old_edge", "distal_bl", "pendant_bl", "ml_ratio"), SHIFT)


_TRIM_OUT = "SELECT sample, pq_id, CAST(line AS BIGINT) line, CAST(low AS BIGINT) old_edge, ROUND(distal_bl + 1.1e-8, 6) distal_bl, ROUND(pendant_bl + 1.1e-8, 6) pendant_bl, ROUND(EXP(w) / SUM(EXP(w)) OVER (PARTITION BY sample, pq_id) + 1.1e-8, 6) ml_ratio FROM trimmed"


@query(star(f"{_TRIM_OUT} WHERE far IS NULL", _TRIM))
def trim_rows(spark, sf_dir):
    """Placements on the tree of leaves with a path mass of at least 0.0105; those on other edges go."""
    return _trimmed(spark, sf_dir, False)


@query(star(_TRIM_OUT, _TRIM))
def trim_rewritten(spark, sf_dir):
    """The same, with placements of dropped edges at the nearest kept node."""
    return _trimmed(spark, sf_dir, True)


# -- measures


def _missed(x: str, k: int) -> str:
    return "(" + " * ".join(f"GREATEST(n - ({x}) - {i}, 0) / CAST(n - {i} AS DOUBLE)" for i in range(k)) + ")"


def _variance(k: int) -> str:
    q = lambda x: _missed(x, k)
    o_x, o_y = "CASE WHEN up = 1 THEN n - d1 ELSE d1 END", "CASE WHEN up = 2 THEN n - d2 ELSE d2 END"
    s_x, s_y = "CASE WHEN up = 1 THEN d1 ELSE n - d1 END", "CASE WHEN up = 2 THEN d2 ELSE n - d2 END"
    pair = f"{q(f'{o_x} + {o_y}')} - {q(o_x)} * {q(o_y)} + (1 - {q(o_x)}) * {q(s_y)} + (1 - {q(o_y)}) * {q(s_x)} - {q(s_x)} * {q(s_y)}"
    alone = f"(1 - {q('d1')} - {q('n - d1')}) * ({q('d1')} + {q('n - d1')})"
    rooted = f"{q('CASE up WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d1 + d2 END')} - {q('d1')} * {q('d2')}"
    return f"SELECT sample, CAST({k} AS BIGINT) k, ROUND(SUM(l1 * l2 * CASE WHEN same THEN {alone} ELSE {pair} END), 5) + 0 unrooted, ROUND(SUM(l1 * l2 * CASE WHEN same THEN {q('d1')} * (1 - {q('d1')}) ELSE {rooted} END), 5) + 0 rooted FROM pairs GROUP BY 1"


@query(
    star(
        f"{_variance(2)} UNION ALL {_variance(3)}",
        profile_cte("point"),
        "segs AS (SELECT p.sample, p.edge, p.a, p.len, e.lo, n_pq n, CAST(ROUND(p.r * n_pq) AS BIGINT) d FROM profile p JOIN edges e ON e.id = p.edge JOIN n_pq ON s = p.sample WHERE e.parent_id IS NOT NULL AND len > 0)",
        "pairs AS (SELECT x.sample, x.n, x.len l1, y.len l2, x.d d1, y.d d2, x.edge = y.edge AND x.a = y.a same, CASE WHEN x.edge = y.edge THEN CASE WHEN x.a > y.a THEN 1 ELSE 2 END WHEN y.edge >= x.lo AND y.edge < x.edge THEN 1 WHEN x.edge >= y.lo AND x.edge < y.edge THEN 2 ELSE 0 END up FROM segs x JOIN segs y ON x.sample = y.sample)",
    )
)
def rarefact_variance(spark, sf_dir):
    """Variance of the diversity of draws of 2 and 3 queries from each sample."""
    tree, placed = _model(spark, sf_dir)
    out = M.rarefaction_variance(placed, tree, 3)
    return out.select("sample", F.col("k").cast("bigint").alias("k"), (F.round("unrooted", 5) + 0.0).alias("unrooted"), (F.round("rooted", 5) + 0.0).alias("rooted"))


_SPLIT = "x AS (SELECT s.sample, e.id edge, 1 - 2 * COALESCE(SUM(m.m), 0) x FROM edges e CROSS JOIN (SELECT DISTINCT sample FROM mass) s LEFT JOIN mass m ON m.sample = s.sample AND m.loc >= e.lo AND m.loc < e.id GROUP BY 1, 2)"


@query(
    star(
        """SELECT CAST(id AS BIGINT) edge FROM edges WHERE is_leaf UNION ALL SELECT CAST(id AS BIGINT) FROM bare2 UNION ALL SELECT CAST(id AS BIGINT) FROM lone2 UNION ALL SELECT CAST(e.id AS BIGINT) FROM edges e WHERE depth = 1 AND NOT EXISTS (SELECT 1 FROM up2 u JOIN near n ON n.a = e.id AND n.b = u.x WHERE u.r = e.r)
UNION ALL SELECT CAST(e.id AS BIGINT) FROM edges e WHERE depth = 0 AND NOT EXISTS (SELECT 1 FROM up1 u JOIN near n ON n.a = e.id AND n.b = u.x)""",
        _SPLIT,
        "near AS (SELECT p.edge a, q.edge b FROM x p JOIN x q ON p.sample = q.sample GROUP BY 1, 2 HAVING SQRT(SUM((p.x - q.x) * (p.x - q.x))) < 0.2)",
        "close2 AS (SELECT l.id x, l.n, l.r FROM edges l JOIN edges e ON e.depth = 2 AND e.n = l.n JOIN near ON a = e.id AND b = l.id WHERE l.is_leaf)",
        "lone2 AS (SELECT e.id, e.n, e.r FROM edges e WHERE depth = 2 AND EXISTS (SELECT 1 FROM edges l WHERE l.is_leaf AND l.n = e.n) AND NOT EXISTS (SELECT 1 FROM close2 c WHERE c.n = e.n))",
        "bare2 AS (SELECT e.id, e.r FROM edges e WHERE depth = 2 AND NOT EXISTS (SELECT 1 FROM edges l WHERE l.is_leaf AND l.n = e.n))",
        "up2 AS (SELECT x, r FROM close2 UNION ALL SELECT id, r FROM lone2 UNION ALL SELECT id, r FROM bare2)",
        "up1 AS (SELECT u.x FROM up2 u JOIN edges e ON e.depth = 1 AND e.r = u.r JOIN near n ON n.a = e.id AND n.b = u.x UNION ALL SELECT e.id FROM edges e WHERE depth = 1 AND NOT EXISTS (SELECT 1 FROM up2 u JOIN near n ON n.a = e.id AND n.b = u.x WHERE u.r = e.r))",
    )
)
def splitify_rep_edges(spark, sf_dir):
    """Edges that stand for others whose split differences are nearer than 0.2."""
    tree, placed = _model(spark, sf_dir)
    return _rounded(M.representative_edges(M.splitify(P.place_mass(placed), tree), tree, 0.2))


@query(star("SELECT CAST(edge AS BIGINT) edge, sample, ROUND(x, 6) + 0 x FROM x WHERE edge IN (SELECT edge FROM x GROUP BY 1 HAVING MAX(x) - MIN(x) >= 0.002)", _SPLIT))
def varying_edges(spark, sf_dir):
    """Split differences of edges on which samples differ by at least 0.002."""
    tree, placed = _model(spark, sf_dir)
    return _rounded(M.varying_edges(M.splitify(P.place_mass(placed), tree), 0.002))


_VARY = "own AS (SELECT * FROM x WHERE edge IN (SELECT edge FROM x GROUP BY 1 HAVING MAX(x) - MIN(x) >= 1e-5)), cen AS (SELECT edge, sample, x - AVG(x) OVER (PARTITION BY edge) c FROM own)"


@query(star("SELECT CAST(p.edge AS BIGINT) edge1, CAST(q.edge AS BIGINT) edge2, ROUND(SUM(p.c * q.c) / 2, 9) + 0 cov FROM cen p JOIN cen q ON p.sample = q.sample AND p.edge <= q.edge GROUP BY 1, 2", _SPLIT, _VARY))
def epca_covariance(spark, sf_dir):
    """Covariances of the split differences of all pairs of edges that vary."""
    tree, placed = _model(spark, sf_dir)
    out = K.covariance(M.splitify(P.place_mass(placed), tree))
    return out.select(F.col("edge1").cast("bigint").alias("edge1"), F.col("edge2").cast("bigint").alias("edge2"), (F.round("cov", 9) + 0.0).alias("cov"))


@query(star("SELECT CAST(p.edge AS BIGINT) edge1, CAST(q.edge AS BIGINT) edge2, ROUND(SUM(p.c * q.c) / 2 * SQRT(a.bl * b.bl), 9) + 0 cov FROM cen p JOIN cen q ON p.sample = q.sample AND p.edge <= q.edge JOIN edges a ON a.id = p.edge JOIN edges b ON b.id = q.edge GROUP BY 1, 2, a.bl, b.bl", _SPLIT, _VARY))
def pmlpca_covariance(spark, sf_dir):
    """The same under branch lengths."""
    tree, placed = _model(spark, sf_dir)
    out = K.metric_covariance(M.splitify(P.place_mass(placed), tree), tree)
    return out.select(F.col("edge1").cast("bigint").alias("edge1"), F.col("edge2").cast("bigint").alias("edge2"), (F.round("cov", 9) + 0.0).alias("cov"))


@query(star("SELECT p.sample sample1, q.sample sample2, ROUND(SUM(p.c * q.c * p.len) / 2, 9) + 0 value FROM cen p JOIN cen q ON p.edge = q.edge AND p.a = q.a GROUP BY 1, 2", profile_cte(), "cen AS (SELECT edge, a, len, sample, (1 - 2 * r) - AVG(1 - 2 * r) OVER (PARTITION BY edge, a) c FROM profile)"))
def lpca_matrix(spark, sf_dir):
    """Products of the samples' centred profiles, stretches weighted by length."""
    tree, placed = _model(spark, sf_dir)
    out = K.length_products(P.profile(P.place_mass(placed), tree))
    return out.select("sample1", "sample2", (F.round("value", 9) + 0.0).alias("value"))


@query(star("SELECT sample, ROUND(SUM(m * pend), 9) extra FROM mass GROUP BY 1"))
def pendant_terms(spark, sf_dir):
    """What pendant branches add to a measure: mass times length."""
    _, placed = _model(spark, sf_dir)
    return M.pendant_terms(P.mass(placed), lambda m, pend: m * pend).select("sample", F.round("extra", 9).alias("extra"))


_EDPL = "edpls AS (SELECT sample, pq_id, COALESCE(s, 0) edpl FROM (SELECT DISTINCT sample, pq_id FROM place_h) LEFT JOIN (SELECT x.sample, x.pq_id, 2 * SUM(x.w * y.w * " + _LEAF_DISTANCE + ") s FROM place_h x JOIN place_h y ON x.sample = y.sample AND x.pq_id = y.pq_id AND x.rank_in_pq < y.rank_in_pq JOIN nation_h nh ON nh.n = x.n JOIN region_h rh ON rh.r = x.r GROUP BY 1, 2) USING (sample, pq_id))"


@query(star("SELECT sample, CAST(loc AS BIGINT) edge, ROUND(SUM(edpl * w) / SUM(w), 6) edpl FROM place_h JOIN edpls USING (sample, pq_id) GROUP BY 1, 2", HEIGHT, _LEAVES, _EDPL))
def edge_edpl(spark, sf_dir):
    """Average expected distance of the queries on each edge, by weight."""
    tree, placed = by_order(spark, sf_dir)
    return _rounded(X.edge_edpl(X.edpl(placed, tree), placed))


@query(
    star(
        f"""SELECT CAST(x.pq_id AS BIGINT) name, ROUND(SUM(({_LEAF_DISTANCE} + x.pendant_bl + y.pendant_bl) * x.w) / SUM(x.w) + 1.1e-8, 6) error
FROM place_h x JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pq_id ORDER BY ml_ratio DESC, loc, distal_bl, pendant_bl) o FROM place_h WHERE line <= 2) WHERE o = 1) y ON x.pq_id = y.pq_id
JOIN nation_h nh ON nh.n = x.n JOIN region_h rh ON rh.r = x.r WHERE x.line > 2 GROUP BY 1""",
        HEIGHT,
        _LEAVES,
    )
)
def error_pendant(spark, sf_dir):
    """Mean distance of later lines to the best of the first two, over tree lengths twice as long, scaled back, pendant branches included."""
    tree, placed = _model(spark, sf_dir)
    own = P.ranked(placed).select(F.col("pq_id").alias("name"), "line", "loc", "distal_bl", "pendant_bl", "ml_ratio", "w")
    later = own.where("line > 2").drop("ml_ratio").withColumnRenamed("w", "ml_ratio").withColumn("distal_bl", F.col("distal_bl") * 2)
    return _rounded(X.placement_error(own.where("line <= 2"), later, tree, include_pendant=True, experimental_lengths=tree.select("id", (F.col("bl") * 2).alias("bl"))), SHIFT)


@query(
    star(
        """SELECT * FROM (SELECT p.sample, p.pq_id, CAST(p.loc AS BIGINT) loc, ROUND(LEAST(MIN(p.distal_bl), MIN(CASE WHEN l.id = p.loc THEN p.distal_bl WHEN l.n = p.n THEN p.height + l.h - 2 * nh.h WHEN l.r = p.r THEN p.height + l.h - 2 * rh.h ELSE p.height + l.h END)) + p.pendant_bl, 6) distance
FROM (SELECT * FROM place_h WHERE rank_in_pq = 1) p JOIN nation_h nh ON nh.n = p.n JOIN region_h rh ON rh.r = p.r
CROSS JOIN (SELECT id, n, r, h FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY n ORDER BY h, id) o FROM edges JOIN h USING (id) WHERE is_leaf) WHERE o <= 2) l GROUP BY 1, 2, 3, p.pendant_bl) WHERE distance > 0.5""",
        HEIGHT,
        _LEAVES,
    )
)
def adcl_pendant(spark, sf_dir):
    """Queries whose best placement, with its pendant branch, lies farther than 0.5 from any leaf."""
    tree, placed = _model(spark, sf_dir)
    return _rounded(X.adcl(placed, tree, include_pendant=True, min_distance=0.5))


@query(star("SELECT sample, pq_id, CAST(line AS BIGINT) line, CASE WHEN distal_bl <= bl / 3 THEN 'low' WHEN distal_bl <= 2 * bl / 3 THEN 'middle' ELSE 'high' END part FROM place"))
def covering(spark, sf_dir):
    """Which third of its edge each placement lies on."""
    tree, placed = _model(spark, sf_dir)
    third = lambda k, name: tree.select(F.col("id").alias("loc"), (k * F.col("bl") / 3).alias("start"), F.lit(name).alias("part"))
    snips = third(1, "low").unionByName(third(2, "middle")).unionByName(third(3, "high"))
    return _rounded(X.covering(placed, snips).select("sample", "pq_id", "line", "part"))


@query(star("SELECT 'average' sample, CAST(loc AS BIGINT) edge, ROUND(SUM(m) / 3, 6) m, ROUND(SUM(m) * 100, 6) width FROM mass GROUP BY 2"))
def fat_average(spark, sf_dir):
    """Mass and drawn width of every occupied edge, samples averaged."""
    tree, placed = _model(spark, sf_dir)
    return _rounded(M.edge_widths(P.place_mass(placed), tree, average=True))


@query(star("SELECT p.sample, pq_id, CAST(line AS BIGINT) line, rank_in_pq, place FROM unit p JOIN (SELECT sample, pq_id, ROW_NUMBER() OVER (PARTITION BY sample ORDER BY CAST(pq_id AS VARCHAR), pq_id) place FROM (SELECT DISTINCT sample, pq_id FROM unit)) q USING (sample, pq_id)"))
def sorted_run(spark, sf_dir):
    """Placements in a settled order: by names, then by weight."""
    _, placed = _model(spark, sf_dir)
    return _rounded(C.sorted_run(placed, _own_names(placed)).select("sample", "pq_id", "line", "rank_in_pq", "place"))


@query()
def squash_rounded(spark, sf_dir):
    """Squash clustering of the samples after queries that agree became one."""
    tree, placed = by_order(spark, sf_dir)
    merges = K.squash_collections(placed, _own_names(placed), tree, pre_round=True)
    return _rounded(spark.createDataFrame(merges, "left string, right string, merged string, length_left double, length_right double"))


# -- taxonomic variants


_TAXT = """
taxt AS (SELECT 'S' || suppkey tax, 'S' || suppkey up, 3 o FROM (SELECT DISTINCT suppkey FROM place) UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 2 FROM supplier WHERE s_suppkey IN (SELECT suppkey FROM place)
  UNION ALL SELECT 'S' || s_suppkey, 'R' || n_regionkey, 1 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey IN (SELECT suppkey FROM place)),
tax_mass AS (SELECT sample, up, o, SUM(ml_ratio / t) m FROM (SELECT *, SUM(ml_ratio) OVER (PARTITION BY sample) t FROM place) JOIN taxt ON tax = 'S' || suppkey GROUP BY 1, 2, 3),
tax_dense AS (SELECT s.sample, n.up, n.o, COALESCE(m, 0) m FROM (SELECT DISTINCT sample FROM place) s CROSS JOIN (SELECT DISTINCT up, o FROM taxt) n LEFT JOIN tax_mass t ON t.sample = s.sample AND t.up = n.up)"""


def _tax_profiles(spark, sf_dir):
    taxa, ranks = taxa_of(spark, sf_dir)
    rooted = taxa.withColumn("parent_id", F.coalesce("parent_id", F.lit("root"))).unionByName(spark.createDataFrame([("root", None, "root", "all")], taxa.schema))
    four = ranks.withColumn("rank_order", F.col("rank_order") + 1).unionByName(spark.createDataFrame([("root", 0)], ranks.schema))
    lines = T.lineage(rooted, four)
    own = _classified(spark, sf_dir)
    tips = own.select(F.col("classification").alias("tax_id")).distinct()
    found = {}
    for lengths in ("unit", "inverse"):
        tree = T.tax_tree(rooted, lines, tips, lengths)
        found[lengths] = P.profile(T.tax_mass(own, tree), tree)
    return found


@query(star("SELECT x.sample sample1, y.sample sample2, ROUND(SUM(ABS(x.m - y.m)), 6) unit_z, ROUND(SUM(ABS(x.m - y.m) / (x.o + 1)), 6) inverse_z FROM tax_dense x JOIN tax_dense y ON x.up = y.up AND x.sample < y.sample GROUP BY 1, 2", _TAXT))
def kr_taxonomic(spark, sf_dir):
    """Distances of the samples over the taxonomy, branches of 1 and of 1 / (rank + 1)."""
    found = _tax_profiles(spark, sf_dir)
    unit, inverse = (M.kr_distances(found[k], {f"{k}_z": 1.0}) for k in ("unit", "inverse"))
    return _rounded(unit.join(inverse, ["sample1", "sample2"]))


@query()
def squash_taxonomic(spark, sf_dir):
    """Squash clustering of the samples over the taxonomy."""
    merges = K.squash(_tax_profiles(spark, sf_dir)["unit"], ["A", "N", "R"])
    return _rounded(spark.createDataFrame(merges, "left string, right string, merged string, length_left double, length_right double"))


_LABELS = """
seq AS (SELECT s_suppkey name, CASE WHEN s_acctbal < 2000 THEN 'N' || s_nationkey ELSE 'S' || s_suppkey END tax_id, n_regionkey r, s_nationkey n, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey),
have AS (SELECT name, 'R' || r tax_id, 0 o FROM seq UNION ALL SELECT name, 'N' || n, 1 FROM seq UNION ALL SELECT name, tax_id, 2 FROM seq WHERE s_acctbal >= 2000)"""


def _labels(spark, sf_dir):
    taxa, ranks = taxa_of(spark, sf_dir)
    seq = S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.when(F.col("s_acctbal") < 2000, F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).otherwise(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).alias("tax_id"))
    return seq, T.lineage(taxa, ranks)


@query("WITH " + _LABELS.strip() + " SELECT CAST(name AS BIGINT) name, tax_id FROM have WHERE o = (SELECT MAX(o) FROM (SELECT o FROM have GROUP BY o HAVING COUNT(DISTINCT name) * 100 // (SELECT COUNT(*) FROM seq) > 80))")
def nbc_auto_rank(spark, sf_dir):
    """Taxa to train on at the most specific rank that over 80 % of the suppliers have."""
    return T.rank_labels(*_labels(spark, sf_dir), "auto")


@query("WITH " + _LABELS.strip() + " SELECT CAST(name AS BIGINT) name, tax_id FROM have")
def nbc_all_ranks(spark, sf_dir):
    """Taxa to train on at every rank."""
    return T.rank_labels(*_labels(spark, sf_dir), "all")


def _hybrid_inputs(spark, sf_dir):
    taxa, ranks = taxa_of(spark, sf_dir)
    o = S.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.max("l_suppkey").alias("hi"), F.min("l_suppkey").alias("lo"))
    supplier = S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    deep = o.select("name", F.concat(F.lit("S"), F.col("hi").cast("string")).alias("tax_id"), F.lit(2).alias("rank_order")).where("name % 7 <> 0")
    nation = o.join(supplier, F.col("lo") == F.col("k")).join(S.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    bayes = nation.select("name", F.when(F.col("name") % 2 == 0, F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).otherwise(F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("tax_id"), F.when(F.col("name") % 2 == 0, 1).otherwise(0).alias("rank_order")).where("name % 11 <> 0")
    return deep, bayes, T.lineage(taxa, ranks)


_HYBRID = """
o AS (SELECT l_orderkey name, MAX(l_suppkey) hi, MIN(l_suppkey) lo FROM lineitem GROUP BY 1),
pair AS (SELECT name, 'S' || hi p, h.s_nationkey hn, hn.n_regionkey hr, l.s_nationkey ln, ln.n_regionkey lr FROM o JOIN supplier h ON h.s_suppkey = hi JOIN nation hn ON hn.n_nationkey = h.s_nationkey JOIN supplier l ON l.s_suppkey = lo JOIN nation ln ON ln.n_nationkey = l.s_nationkey),
judged AS (SELECT name, p, CASE WHEN name % 2 = 0 THEN 'N' || ln ELSE 'R' || lr END b, CASE WHEN name % 2 = 0 THEN hn = ln ELSE hr = lr END ok FROM pair WHERE name % 7 <> 0 AND name % 11 <> 0)"""


@query("WITH " + _HYBRID.strip() + " SELECT CAST(name AS BIGINT) name, CASE WHEN ok THEN p ELSE b END tax_id, CASE WHEN ok THEN 'placement' ELSE 'nbc' END source FROM judged")
def hybrid2_rows(spark, sf_dir):
    """Each order's highest supplier if the taxon of its lowest lies on its lineage, else that taxon."""
    return T.hybrid2(*_hybrid_inputs(spark, sf_dir)).select("name", "tax_id", "source")


@query("WITH " + _HYBRID.strip() + " SELECT CAST(name AS BIGINT) name, CASE WHEN ok AND name % 2 = 0 THEN p ELSE b END tax_id, CASE WHEN ok AND name % 2 = 0 THEN 'placement' ELSE 'nbc' END source FROM judged")
def hybrid5_rows(spark, sf_dir):
    """The same, if the supplier is at most one rank more specific."""
    return T.hybrid5(*_hybrid_inputs(spark, sf_dir)).select("name", "tax_id", "source")


@query("WITH " + _HYBRID.strip() + " SELECT CAST(name AS BIGINT) name, b tax_id, 'nbc' source FROM judged")
def hybrid2f_rows(spark, sf_dir):
    """Always the taxon of the lowest supplier."""
    return T.hybrid2f(*_hybrid_inputs(spark, sf_dir)).select("name", "tax_id", "source")


@query("WITH o AS (SELECT DISTINCT l_orderkey name FROM lineitem) SELECT CAST(name AS BIGINT) name, CASE WHEN name % 7 = 0 THEN 'left' ELSE 'right' END missing FROM o WHERE (name % 7 = 0) <> (name % 11 = 0)")
def hybrid_unmatched(spark, sf_dir):
    """Orders that only one of two classifiers has."""
    deep, bayes, _ = _hybrid_inputs(spark, sf_dir)
    return T.unmatched(deep, bayes)


_WORDS = """
seqs AS (SELECT doc_id name, lang tax_id, regexp_replace(translate(lower(text), 'bdefhijklmnopqrsuvwxyz', 'acgtacgtacgtacgtacgtac'), '[^acgt]', '', 'g') s FROM documents),
each AS (SELECT name, tax_id, upper(substr(s, i, 4)) word FROM (SELECT name, tax_id, s, UNNEST(range(1, length(s) - 2)) i FROM seqs WHERE length(s) >= 4)),
words AS (SELECT name, MAX(tax_id) tax_id, word, COUNT(*) n FROM each GROUP BY name, word)"""


def _lettered(spark, sf_dir) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.lower("text").alias("seq"), F.col("lang").alias("tax_id"))


@query("WITH " + _WORDS.strip() + " SELECT name, CAST(list_sum(list_transform(range(1, 5), lambda i: (instr('ACGT', word[i]) - 1) * POW(4, 4 - i))) AS BIGINT) code, n FROM words")
def nbc_words(spark, sf_dir):
    """Four-letter words of documents folded onto four letters, as numbers, counted."""
    return T.word_codes(_lettered(spark, sf_dir).select("name", "seq"), 4, T.FOLDED)


@query(
    "WITH "
    + _WORDS.strip()
    + """, prior AS (SELECT word, (COUNT(*) + 0.5) / ((SELECT COUNT(*) FROM seqs) + 1) p FROM words GROUP BY word), size AS (SELECT tax_id, COUNT(*) m FROM seqs GROUP BY 1)
SELECT w.tax_id, w.word, ROUND(LN((COUNT(*) + MAX(p)) / (MAX(m) + 1)), 6) + 0 log_p FROM words w JOIN prior USING (word) JOIN size s ON s.tax_id = w.tax_id GROUP BY 1, 2"""
)
def nbc_model(spark, sf_dir):
    """Log probabilities of the words of each language."""
    model, size = T.nbc_train_sequences(_lettered(spark, sf_dir), 4, T.FOLDED)
    log_p = F.col("gain") + F.log(F.col("prior")) - F.log(F.col("size") + 1)
    return _rounded(model.join(size, "tax_id").select("tax_id", "word", log_p.alias("log_p")))


@query(
    "WITH "
    + _WORDS.strip()
    + """, prior AS (SELECT word, (COUNT(*) + 0.5) / ((SELECT COUNT(*) FROM seqs) + 1) p FROM words GROUP BY word), size AS (SELECT tax_id, COUNT(*) m FROM seqs GROUP BY 1), seen AS (SELECT tax_id, word, COUNT(*) k FROM words GROUP BY 1, 2),
score AS (SELECT w.name, s.tax_id, SUM(w.n * LN((COALESCE(k, 0) + p) / (m + 1))) v FROM words w JOIN prior USING (word) CROSS JOIN size s LEFT JOIN seen n ON n.word = w.word AND n.tax_id = s.tax_id GROUP BY 1, 2)
SELECT name, ROUND(MAX(v), 4) + 0 score FROM score GROUP BY 1"""
)
def nbc_scores(spark, sf_dir):
    """The best language's score of every document."""
    docs = _lettered(spark, sf_dir)
    return T.nbc_classify_sequences(docs, *T.nbc_train_sequences(docs, 4, T.FOLDED), 4, T.FOLDED).select("name", (F.round("score", 4) + 0.0).alias("score"))


@query(
    star(
        """SELECT s.sample, s.pq_id, s.rank, s.tax_id, ROUND(l + 1.1e-8, 6) likelihood FROM shares s JOIN (
  SELECT sample, pq_id, o, MAX(CASE WHEN k = 1 OR (p > 0 AND evidence > 0 AND LN(evidence / p) >= 0.5) THEN 1 ELSE 0 END) OVER (PARTITION BY sample, pq_id ORDER BY o DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) on_ FROM (
   SELECT *, LAG(evidence) OVER (PARTITION BY sample, pq_id ORDER BY o) p, ROW_NUMBER() OVER (PARTITION BY sample, pq_id ORDER BY o) k FROM (
    SELECT sample, pq_id, o, SUM(l / n_edges) evidence FROM shares JOIN painted USING (tax_id) GROUP BY 1, 2, 3))) e ON e.sample = s.sample AND e.pq_id = s.pq_id AND e.o = s.o
WHERE on_ = 1 AND l >= 0.2 - 1e-12""",
        _SHARES,
        "painted AS (SELECT 'S' || s_suppkey tax_id, 1 n_edges FROM supplier UNION ALL SELECT 'N' || s_nationkey, COUNT(*) + 1 FROM supplier GROUP BY 1 UNION ALL SELECT 'R' || n_regionkey, COUNT(*) + 1 FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)",
    )
)
def classify_by_bayes(spark, sf_dir):
    """Taxa that stay by their Bayes factors: from the finest rank up, all from the first that reaches 0.5."""
    taxa, ranks = taxa_of(spark, sf_dir)
    lines = T.lineage(taxa, ranks)
    shares = T.roll_up(_classified(spark, sf_dir), lines)
    painted = lines.where("substring(tax_id, 1, 1) = 'S'").groupBy(F.col("anc_tax_id").alias("t")).agg(F.count("*").alias("c")).select(F.col("t").alias("tax_id"), F.when(F.substring("t", 1, 1) == "S", F.col("c")).otherwise(F.col("c") + 1).alias("n_edges"))
    out = T.filter_best_bayes(shares, T.evidence(shares, painted), 0.5, 0.2)
    return _rounded(out.select("sample", "pq_id", "rank", "tax_id", "likelihood"), SHIFT)


@query("SELECT n_name query, r_name reference, CAST(u AS BIGINT) overlap, CASE WHEN u = 0 THEN 0 ELSE ROUND(e / u, 6) END identity FROM (SELECT n_name, r_name, list_sum(list_transform(range(1, 11), lambda i: CASE WHEN a[i] <> '-' AND b[i] <> '-' THEN 1 ELSE 0 END)) u, list_sum(list_transform(range(1, 11), lambda i: CASE WHEN a[i] <> '-' AND b[i] <> '-' AND a[i] = b[i] THEN 1 ELSE 0 END)) e FROM (SELECT n_name, r_name, rpad(n_name, 10, '-') a, rpad(r_name, 10, '-') b FROM nation CROSS JOIN region))")
def identities(spark, sf_dir):
    """Shares of equal letters of nations' and regions' names, padded with gaps."""
    aligned = lambda t, c: S.table(spark, sf_dir, t).select(F.col(c).alias("name"), F.rpad(c, 10, "-").alias("seq"))
    return _rounded(T.identities(aligned("nation", "n_name"), aligned("region", "r_name")))


@query("SELECT l_orderkey query, l_returnflag tax_id, ROUND(median(l_discount), 6) median_identity FROM lineitem GROUP BY 1, 2")
def median_identities(spark, sf_dir):
    """Median discount of each order by return flag, as identities by taxon."""
    pairs = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_returnflag").alias("reference"), F.col("l_discount").alias("identity"))
    return _rounded(T.median_identities(pairs, spark.createDataFrame([(x, x) for x in "ANR"], "seqname string, tax_id string")))


@query("SELECT l_suppkey seqname, l_returnflag tax_id, ROUND(median(l_quantity), 6) median, ROUND(stddev_samp(l_quantity) / avg(l_quantity), 6) cv FROM lineitem GROUP BY 1, 2")
def distance_spread(spark, sf_dir):
    """Median and coefficient of variation of quantities by supplier and return flag."""
    d = S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("seqname"), F.col("l_returnflag").alias("tax_id"), F.col("l_quantity").alias("distance"))
    return _rounded(T.distance_spread(d))


@query("SELECT DISTINCT CAST(i AS BIGINT) site FROM (SELECT n_name s, UNNEST(range(0, length(n_name))) i FROM nation) JOIN (SELECT r_name, UNNEST(range(0, length(r_name))) j FROM region) ON i = j WHERE substr(s, i + 1, 1) NOT IN ('-', '?', '.') AND substr(r_name, j + 1, 1) NOT IN ('-', '?', '.')")
def premask(spark, sf_dir):
    """Sites with a letter in some nation's and some region's name."""
    from . import place as L

    seqs = lambda t, c: S.table(spark, sf_dir, t).select(F.col(c).alias("name"), F.col(c).alias("seq"))
    return spark.createDataFrame([(int(k),) for k in L.premask(seqs("region", "r_name"), seqs("nation", "n_name"))], "site long")


# -- convexity


@query(star("SELECT k.rank, CAST(e.id AS BIGINT) edge, GREATEST(COALESCE(c.n, 0) - 1, 0) badness FROM edges e CROSS JOIN (SELECT DISTINCT rank FROM leaf_taxa) k LEFT JOIN (SELECT rank, edge, COUNT(*) n FROM cut GROUP BY 1, 2) c ON c.rank = k.rank AND c.edge = e.id", _COLORS))
def badness_by_rank(spark, sf_dir):
    """Colours beyond the first in the cut-sets of edges, rank by rank."""
    tree, _ = _model(spark, sf_dir)
    taxa = _leaf_taxa(spark, sf_dir, tree)
    out = None
    for rank in ("nation", "rest"):
        one = T.badness(tree, taxa.where(F.col("rank") == rank).select("id", "color")).select(F.lit(rank).alias("rank"), F.col("edge").cast("bigint").alias("edge"), F.col("badness").cast("bigint").alias("badness"))
        out = one if out is None else out.unionByName(one)
    return out


# -- warehouse


def _by_specimen(spark, sf_dir):
    taxa, multi, names = _facts(spark, sf_dir)
    specimens = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("specimen"))
    return H.tally_by_specimen(H.concat_multiclass(multi), names, taxa, specimens, "region")


_TALLY = "tally AS (SELECT specimen, tax_id, COALESCE(MAX(tax_name), tax_id) tax_name, CAST(COUNT(*) AS DOUBLE) tally FROM concat JOIN (SELECT CAST(o_orderkey AS VARCHAR) name, o_orderpriority specimen FROM orders) USING (name) LEFT JOIN taxa t USING (tax_id) WHERE want_rank = 'region' GROUP BY specimen, tax_id)"
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(star("SELECT tax_id, tax_name, " + ", ".join(f"SUM(CASE WHEN specimen = '{p}' THEN tally ELSE 0 END) \"{p}\"" for p in _PRIORITIES) + " FROM tally GROUP BY 1, 2", _SHARES, _CONCAT, _TALLY))
def wide_table(spark, sf_dir):
    """Tallies of regions, a column for each priority."""
    return H.wide_table(_by_specimen(spark, sf_dir), list(_PRIORITIES))


@query(star("SELECT tax_id, tax_name, ROUND(SUM(freq) / 5, 6) average FROM (SELECT *, tally / SUM(tally) OVER (PARTITION BY specimen) freq FROM tally) GROUP BY 1, 2", _SHARES, _CONCAT, _TALLY))
def specimen_averages(spark, sf_dir):
    """Average frequency of each region over the priorities."""
    return _rounded(H.specimen_averages(_by_specimen(spark, sf_dir), 5))


def _rect_by_specimen(spark, sf_dir):
    taxa, multi, names = _facts(spark, sf_dir)
    specimens = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("specimen"))
    return H.rect_by_specimen(H.concat_multiclass(multi), names, taxa, specimens, "nation")


_RECT = """
known AS (SELECT c.placement_id, c.name, COALESCE(t.tax_id, 'none') tax_id, COALESCE(t.tax_name, 'unclassified') tax_name, COALESCE(t.rank, 'root') rank FROM concat c LEFT JOIN taxa t USING (tax_id) WHERE want_rank = 'nation'),
rect AS (SELECT specimen, tax_id, tax_name, rank, CAST(COUNT(*) AS DOUBLE) tally, COUNT(DISTINCT placement_id) placements FROM known JOIN (SELECT CAST(o_orderkey AS VARCHAR) name, o_orderpriority specimen FROM orders) USING (name) GROUP BY 1, 2, 3, 4)"""


@query(star("SELECT *, ROUND(tally / SUM(tally) OVER (PARTITION BY specimen), 6) normalized_tally FROM rect", _SHARES, _CONCAT, _RECT))
def rect_by_specimen(spark, sf_dir):
    """The older tally of nations by priority, joined results as unclassified."""
    return _rounded(_rect_by_specimen(spark, sf_dir))


@query(star("SELECT tax_id, tax_name, rank, ROUND(SUM(f) / 5, 6) normalized_tally FROM (SELECT *, tally / SUM(tally) OVER (PARTITION BY specimen) f FROM rect) GROUP BY 1, 2, 3", _SHARES, _CONCAT, _RECT))
def rect_normalized(spark, sf_dir):
    """Mean share of each nation over the priorities."""
    return _rounded(H.rect_normalized(_rect_by_specimen(spark, sf_dir), 5))


@query(star("SELECT tax_id, tax_name, rank, CAST(COUNT(*) AS DOUBLE) tally, COUNT(DISTINCT placement_id) placements FROM known GROUP BY 1, 2, 3", _SHARES, _CONCAT, _RECT))
def rect_by_taxon(spark, sf_dir):
    """The older tally of nations."""
    taxa, multi, names = _facts(spark, sf_dir)
    return H.rect_by_taxon(H.concat_multiclass(multi), names, taxa, "nation")


@query(star("SELECT tax_id, tax_name, " + ", ".join(f"CAST(SUM(CASE WHEN specimen = '{p}' THEN tally ELSE 0 END) AS BIGINT) \"{p}\"" for p in _PRIORITIES) + " FROM tally GROUP BY 1, 2 UNION ALL SELECT '', 'orders', " + ", ".join(f"COUNT(*) FILTER (WHERE o_orderpriority = '{p}')" for p in _PRIORITIES) + " FROM orders", _SHARES, _CONCAT, _TALLY))
def wide_table_metadata(spark, sf_dir):
    """The same with a row of each priority's number of orders."""
    extra = S.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("specimen")).agg(F.count("*").cast("string").alias("value")).withColumn("key", F.lit("orders"))
    out = H.wide_table(_by_specimen(spark, sf_dir), list(_PRIORITIES), metadata=extra)
    return out.select("tax_id", "tax_name", *[F.col(f"`{c}`").cast("double").cast("long").alias(c) for c in _PRIORITIES])


@query("SELECT DISTINCT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || YEAR(l_shipdate) placement_id, CAST(l_partkey AS VARCHAR) name, YEAR(l_shipdate) run_id FROM lineitem QUALIFY YEAR(l_shipdate) = MAX(YEAR(l_shipdate)) OVER (PARTITION BY l_partkey)")
def current_runs(spark, sf_dir):
    """Placements of names (parts) without those that a later run (year) placed again."""
    year = F.year("l_shipdate").cast("long")
    items = S.table(spark, sf_dir, "lineitem").select(F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")], year.cast("string")).alias("placement_id"), F.col("l_partkey").cast("string").alias("name"), year.alias("run_id")).distinct()
    kept = H.without_superseded(items.select("placement_id", "run_id"), items.select("placement_id", "name"))
    return kept["placement_names"].join(kept["placements"], "placement_id").select("placement_id", "name", "run_id")


_REPAIRED = "SELECT c_custkey placement_id, x || c_custkey name, 'r' want_rank, 'r' rank, 'T' || c_nationkey tax_id, CAST(1 AS DOUBLE) likelihood FROM customer"


def _repaired(spark, sf_dir):
    even = S.table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey").cast("string"))
    multi = even.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("placement_id"), F.concat(F.lit("c"), "k").alias("name"), F.lit("r").alias("want_rank"), F.lit("r").alias("rank"), F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("tax_id"), F.lit(1.0).alias("likelihood"))
    rep = F.concat(F.lit("c"), "k")
    dedup = even.select(rep.alias("global_rep"), rep.alias("specimen_rep"), F.lit(1.0).alias("mass")).unionByName(even.select(rep.alias("global_rep"), F.concat(F.lit("d"), "k").alias("specimen_rep"), (1.0 + F.col("c_custkey") % 3).alias("mass")))
    return H.repair(multi, dedup)


@query("SELECT c_custkey placement_id, 'c' || c_custkey name, CAST(1 AS DOUBLE) mass FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'd' || c_custkey, CAST(1 + c_custkey % 3 AS DOUBLE) FROM customer WHERE c_custkey % 2 = 0")
def repaired_names(spark, sf_dir):
    """Names after duplicates came back; customers of odd number have no result to take."""
    return _repaired(spark, sf_dir)[0]


@query(f"{_REPAIRED}, (SELECT UNNEST(['c', 'd']) x) WHERE c_custkey % 2 = 0")
def repaired_multiclass(spark, sf_dir):
    """Results after duplicates came back."""
    return _repaired(spark, sf_dir)[1]


_REPAIR = "SELECT CAST(o_orderkey AS BIGINT) placement_id, 'c' || o_custkey name, 'o' origin, CAST(1 AS DOUBLE) mass FROM orders"


@query(f"{_REPAIR} UNION ALL SELECT CAST(o_orderkey AS BIGINT), 'd' || o_custkey, 'o', CAST(1 + o_custkey % 3 AS DOUBLE) FROM orders")
def fix_duplicates(spark, sf_dir):
    """Names of orders with a duplicate of each customer restored."""
    names = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("placement_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), F.lit("o").alias("origin"), F.lit(1.0).alias("mass"))
    c = S.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("kept_id"), F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("orig_id"), (1 + F.col("c_custkey") % 3).alias("count"))
    return H.fix_duplicates(names, c)


@query(star("SELECT want_rank, rank, tax_id, name, ROUND(likelihood, 6) likelihood FROM (SELECT rank want_rank, rank, up tax_id, name, SUM(lk) likelihood FROM (SELECT name, t.rank, t.up, 1 / CAST(n AS DOUBLE) lk FROM (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) name, l_suppkey k, COUNT(*) OVER (PARTITION BY l_orderkey) n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity > 40)) JOIN (SELECT s_suppkey k, 'supplier' rank, 'S' || s_suppkey up FROM supplier UNION ALL SELECT s_suppkey, 'nation', 'N' || s_nationkey FROM supplier UNION ALL SELECT s_suppkey, 'region', 'R' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey) t USING (k)) GROUP BY 1, 2, 3, 4)"))
def add_classifications(spark, sf_dir):
    """Suppliers of large lines as external classifications of their orders, at every rank."""
    taxa, ranks = taxa_of(spark, sf_dir)
    extra = S.table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").cast("string").alias("name"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("tax_id"))
    none = spark.createDataFrame([], H.SCHEMAS["multiclass"])
    return _rounded(H.add_classifications(none, extra, T.lineage(taxa, ranks)).drop("placement_id"))


@query(star("SELECT DISTINCT tax_id, CAST(pq_id AS VARCHAR) name FROM multiclass WHERE want_rank = 'nation' AND rank = 'nation'", _SHARES))
def route_by_rank(spark, sf_dir):
    """The nation bins that orders go to."""
    return H.route_by_rank(_facts(spark, sf_dir)[1], "nation")


# -- trees


@query(
    star(
        """SELECT p.sample, p.pq_id, ROUND(CASE WHEN p.distal_bl < 1e-12 THEN v ELSE (v / p.distal_bl + uv / (uw + l.bl - p.distal_bl)) / (1 / p.distal_bl + 1 / (uw + l.bl - p.distal_bl)) END, 4) + 0 value
FROM (SELECT * FROM unit WHERE rank_in_pq = 1) p JOIN leaf_up l ON l.id = p.loc""",
        "leaf AS (SELECT e.id, e.n, e.r, e.bl, s_acctbal v, 1 / e.bl w FROM edges e JOIN supplier ON s_suppkey = e.k WHERE e.is_leaf)",
        "nat AS (SELECT e.id, e.n, e.r, e.bl, SUM(l.v * l.w) / SUM(l.w) v, 1 / (1 / SUM(l.w) + e.bl) w, SUM(l.w) sw, SUM(l.v * l.w) sv FROM edges e JOIN leaf l ON l.n = e.n WHERE e.depth = 2 GROUP BY 1, 2, 3, 4)",
        "reg AS (SELECT e.id, e.r, e.bl, SUM(x.v * x.w) / SUM(x.w) v, 1 / (1 / SUM(x.w) + e.bl) w, SUM(x.w) sw, SUM(x.v * x.w) sv FROM edges e JOIN nat x ON x.r = e.r WHERE e.depth = 1 GROUP BY 1, 2, 3)",
        "top AS (SELECT SUM(v * w) sv, SUM(w) sw FROM reg)",
        "reg_up AS (SELECT r.*, (t.sv - r.v * r.w) / (t.sw - r.w) uv, 1 / (t.sw - r.w) uw FROM reg r CROSS JOIN top t)",
        "nat_up AS (SELECT x.*, (r.sv - x.v * x.w + r.uv / (r.uw + r.bl)) / (r.sw - x.w + 1 / (r.uw + r.bl)) uv, 1 / (r.sw - x.w + 1 / (r.uw + r.bl)) uw FROM nat x JOIN reg_up r ON r.r = x.r)",
        "leaf_up AS (SELECT l.id, l.bl, l.v, (x.sv - l.v * l.w + x.uv / (x.uw + x.bl)) / (x.sw - l.w + 1 / (x.uw + x.bl)) uv, 1 / (x.sw - l.w + 1 / (x.uw + x.bl)) uw FROM leaf l JOIN nat_up x ON x.n = l.n)",
    )
)
def indep_c_rows(spark, sf_dir):
    """Account balances of suppliers carried to each query's best placement."""
    from .more_queries import tree_of
    from .trees import carry_values

    tree, placed = _model(spark, sf_dir)
    values = {r[0]: float(r[1]) for r in S.table(spark, sf_dir, "supplier").select("s_name", "s_acctbal").collect()}  # a row a leaf
    best = P.ranked(placed).where("rank_in_pq = 1").select("sample", "pq_id", "loc", "distal_bl")
    return carry_values(best, tree_of(tree), values).select("sample", "pq_id", (F.round("value", 4) + 0.0).alias("value"))


@query(star("SELECT e.label leaf, CAST((SELECT SUM(k) + COUNT(*) FILTER (WHERE k > 1) FROM nk) + (SELECT COUNT(*) FROM (SELECT r FROM nk GROUP BY r HAVING COUNT(*) > 1)) AS BIGINT) edge, CAST(0 AS DOUBLE) distal, ROUND(e.bl + x.bl + r.bl, 6) pendant FROM edges e JOIN edges x ON x.depth = 2 AND x.n = e.n JOIN edges r ON r.depth = 1 AND r.r = e.r WHERE e.is_leaf AND e.r = 0", "nk AS (SELECT r, n, COUNT(*) k FROM edges WHERE is_leaf AND r <> 0 GROUP BY 1, 2)"))
def prepsim_rows(spark, sf_dir):
    """Where the suppliers of the first region would hang on the tree without them."""
    return QUERIES["prepsim"](spark, sf_dir)


@query(star("SELECT CAST(id AS BIGINT) edge, CASE WHEN heat > 0 THEN 255 ELSE f END red, f green, CASE WHEN heat > 0 THEN f ELSE 255 END blue FROM (SELECT id, heat, CAST(FLOOR(255 * (1 - ABS(heat) / MAX(ABS(heat)) OVER ()) + 0.5) AS BIGINT) f FROM (SELECT e.id, COALESCE(SUM(CASE WHEN m.sample = 'A' THEN m.m ELSE -m.m END), 0) heat FROM edges e LEFT JOIN (SELECT * FROM mass WHERE sample IN ('A', 'N')) m ON m.loc >= e.lo AND m.loc <= e.id GROUP BY 1))"))
def heat_rows(spark, sf_dir):
    """Colours of the net transport from A to N."""
    out = QUERIES["heat"](spark, sf_dir)
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in out.columns])


ORACLES["bary"] = star(
    """SELECT sample, CAST(id AS BIGINT) edge, ROUND(lo + (hi - lo) * d0 / (d0 - d1), 6) pos FROM pieces WHERE d0 >= 0 AND d1 < 0
UNION ALL SELECT sample, CAST(arg_max(id, {'a': depth, 'b': id}) AS BIGINT), CAST(0 AS DOUBLE) FROM ends WHERE low < 0 AND sample NOT IN (SELECT sample FROM pieces WHERE d0 >= 0 AND d1 < 0) GROUP BY 1""",
    HEIGHT,
    "pl AS (SELECT sample, loc, pos, SUM(m) m FROM mass GROUP BY 1, 2, 3)",
    "ee AS (SELECT e.id, e.lo, e.depth, CASE WHEN e.parent_id IS NULL THEN CAST(0 AS DOUBLE) ELSE e.bl END bl, h.h FROM edges e JOIN h USING (id))",
    "side AS (SELECT p.sample, e.id, e.h, p.m, p.pos, p.loc = e.id own, p.loc >= e.lo AND p.loc < e.id below, t.h - p.pos hp, MAX(a.h) hl FROM pl p JOIN h t ON t.id = p.loc CROSS JOIN ee e JOIN ee a ON a.lo <= e.id AND e.id <= a.id AND a.lo <= p.loc AND p.loc <= a.id GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, p.loc)",
    "marks AS (SELECT sample, id, CAST(0 AS DOUBLE) x0 FROM ee CROSS JOIN n_pq_names UNION SELECT sample, id, bl FROM ee CROSS JOIN n_pq_names UNION SELECT sample, loc, pos FROM pl)",
    "work AS (SELECT k.sample, k.id, k.x0, SUM(CASE WHEN own THEN s.m * (pos - x0) WHEN below THEN -s.m * (hp - s.h + x0) ELSE s.m * (hp + s.h - x0 - 2 * hl) END) d FROM marks k JOIN side s ON s.sample = k.sample AND s.id = k.id GROUP BY 1, 2, 3)",
    "ends AS (SELECT w.sample, w.id, e.depth, MAX(CASE WHEN x0 = 0 THEN d END) low, MAX(CASE WHEN x0 = bl THEN d END) high FROM work w JOIN ee e USING (id) GROUP BY 1, 2, 3)",
    "pieces AS (SELECT w.sample, w.id, x0 lo, LEAD(x0) OVER o hi, d d0, LEAD(d) OVER o d1 FROM work w JOIN ends USING (sample, id) WHERE low >= 0 AND high < 0 WINDOW o AS (PARTITION BY w.sample, w.id ORDER BY x0))",
).replace("n_pq_names", "(SELECT s sample FROM n_pq)")

__all__ = ["ORACLES", "QUERIES", "more_queries"]
