from sylva.operators import collections as C
from sylva.operators.more_queries import QUERIES


def test_names_the_map_lacks(spark):
    names = spark.createDataFrame([("s", 1, "a", 2.0), ("s", 2, "b", 3.0)], "sample string, pq_id long, name string, mass double")
    m = spark.createDataFrame([("a", "x", 1), ("a", "y", 4)], "kept_id string, orig_id string, count int")
    assert sorted(tuple(r) for r in C.restore_duplicates(names, m).select("name", "mass").collect()) == [("b", 3.0), ("x", 2.0), ("y", 8.0)]


def test_every_customer_is_in_the_map(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("concat('c', c_nationkey * 100000 + c_custkey) name")
    assert QUERIES["redup_all"](spark, sf_dir).join(customers, "name", "left_anti").count() == 0
