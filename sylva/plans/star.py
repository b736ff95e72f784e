"""The placement model over a star schema: region, nation and supplier are the tree, line items the placements.

The relations are built with DataFrame functions; ``CTES`` states the same views as SQL that both
Spark and DuckDB run, for cross-checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root - region - nation - supplier, numbered in post-order: id, parent_id, lo, depth, bl, label, is_leaf, path.

    The tables are dimensions; the numbering sorts one row a node.
    """
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r"))
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("r"), F.col("n_nationkey").cast("long").alias("n"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n")).select("r", "n", F.col("s_suppkey").alias("k"), F.col("s_name").alias("label"))
    none = F.lit(None).cast("long")
    nodes = (
        s.select("r", "n", "k", F.lit(3).alias("depth"), (1 + (F.col("k") % 7) / 8).alias("bl"), "label")
        .unionByName(n.select("r", "n", none.alias("k"), F.lit(2).alias("depth"), (1 + (F.col("n") % 3) / 4).alias("bl"), F.lit(None).cast("string").alias("label")))
        .unionByName(r.select("r", none.alias("n"), none.alias("k"), F.lit(1).alias("depth"), F.lit(1.0).alias("bl"), F.lit(None).cast("string").alias("label")))
    )
    root = spark.range(1).select(none.alias("r"), none.alias("n"), none.alias("k"), F.lit(0).alias("depth"), F.lit(0.0).alias("bl"), F.lit(None).cast("string").alias("label"))
    order = W.orderBy(F.col("r").asc_nulls_last(), F.col("n").asc_nulls_last(), F.col("k").asc_nulls_last())
    placed = nodes.unionByName(root).withColumn("id", F.row_number().over(order) - 1)
    by = {1: ["r"], 2: ["r", "n"]}
    ids = {}
    for depth, keys in by.items():
        ids[depth] = F.max(F.when(F.col("depth") == depth, F.col("id"))).over(W.partitionBy(*keys)).alias(f"_id{depth}")
    top = F.max("id").over(W.partitionBy())
    up = placed.select("*", ids[1], ids[2], top.alias("_id0"))
    lo = F.when(F.col("depth") == 3, F.col("id")).when(F.col("depth") == 2, F.min("id").over(W.partitionBy("r", "n"))).when(F.col("depth") == 1, F.min("id").over(W.partitionBy("r"))).otherwise(0)
    parent = F.when(F.col("depth") == 3, F.col("_id2")).when(F.col("depth") == 2, F.col("_id1")).when(F.col("depth") == 1, F.col("_id0"))
    path = F.when(F.col("depth") == 3, F.array("id", "_id2", "_id1", "_id0")).when(F.col("depth") == 2, F.array("id", "_id1", "_id0")).when(F.col("depth") == 1, F.array("id", "_id0")).otherwise(F.array("id"))
    return up.select("id", F.col("id").alias("edge_num"), parent.alias("parent_id"), lo.alias("lo"), "depth", F.col("bl").cast("double").alias("bl"), "label", (F.col("depth") == 3).alias("is_leaf"), path.alias("path"), "r", "n", "k")


def placements(spark: SparkSession, sf_dir: str, tree: DataFrame) -> DataFrame:
    """One placement a line item: sample, pq_id, rank_in_pq, loc, bl, ml_ratio (weight), distal_bl, pendant_bl, classification, name."""
    leaf = tree.where("is_leaf").select(F.col("k").alias("_k"), F.col("id").alias("loc"), "bl")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("sample"), F.col("l_orderkey").alias("pq_id"), F.col("l_suppkey").alias("_s"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("ml_ratio"), F.col("l_tax").alias("pendant_bl"), F.col("l_extendedprice").alias("log_like")
    )
    placed = items.join(leaf, F.col("_s") == F.col("_k"))
    return placed.select("sample", "pq_id", "line", "loc", "bl", "ml_ratio", (F.col("bl") * (F.col("line") % 8) / 8).alias("distal_bl"), "pendant_bl", "log_like", F.col("_s").alias("suppkey"))


CTES = """
nodes AS (
  SELECT CAST(n_regionkey AS BIGINT) r, CAST(n_nationkey AS BIGINT) n, s_suppkey k, 3 depth,
         CAST(1 AS DOUBLE) + (s_suppkey % 7) / CAST(8 AS DOUBLE) bl, s_name label
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT CAST(n_regionkey AS BIGINT), CAST(n_nationkey AS BIGINT), NULL, 2, CAST(1 AS DOUBLE) + (n_nationkey % 3) / CAST(4 AS DOUBLE), NULL FROM nation
  UNION ALL SELECT CAST(r_regionkey AS BIGINT), NULL, NULL, 1, CAST(1 AS DOUBLE), NULL FROM region
  UNION ALL SELECT NULL, NULL, NULL, 0, CAST(0 AS DOUBLE), NULL),
numbered AS (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY r NULLS LAST, n NULLS LAST, k NULLS LAST) - 1 AS INTEGER) id FROM nodes),
edges AS (
  SELECT *, CASE depth WHEN 3 THEN id WHEN 2 THEN MIN(id) OVER (PARTITION BY r, n) WHEN 1 THEN MIN(id) OVER (PARTITION BY r) ELSE 0 END lo,
    CASE depth WHEN 3 THEN MAX(CASE WHEN depth = 2 THEN id END) OVER (PARTITION BY r, n)
               WHEN 2 THEN MAX(CASE WHEN depth = 1 THEN id END) OVER (PARTITION BY r)
               WHEN 1 THEN MAX(id) OVER () END parent_id,
    depth = 3 is_leaf
  FROM numbered),
place AS (
  SELECT l_returnflag sample, l_orderkey pq_id, l_linenumber line, id loc, bl, l_quantity ml_ratio,
         bl * (l_linenumber % 8) / 8 distal_bl, l_tax pendant_bl, l_extendedprice log_like, l_suppkey suppkey
  FROM lineitem JOIN edges ON k = l_suppkey),
unit AS (
  SELECT *, ml_ratio / SUM(ml_ratio) OVER (PARTITION BY sample, pq_id) w,
         ROW_NUMBER() OVER (PARTITION BY sample, pq_id ORDER BY ml_ratio DESC, line, loc, distal_bl, pendant_bl, log_like) rank_in_pq FROM place),
n_pq AS (SELECT sample s, COUNT(DISTINCT pq_id) n_pq FROM place GROUP BY sample),
mass AS (SELECT sample, pq_id, loc, distal_bl pos, pendant_bl pend, rank_in_pq, w, w / n_pq m FROM unit JOIN n_pq ON s = sample),
point AS (SELECT sample, pq_id, loc, distal_bl pos, pendant_bl pend, CAST(1 AS DOUBLE) / n_pq m FROM unit JOIN n_pq ON s = sample WHERE rank_in_pq = 1)
"""
