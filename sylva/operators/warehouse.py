"""The classification warehouse: its relations, and the reports over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: The warehouse's relations.
SCHEMAS = {
    "ranks": "rank string, rank_order int",
    "taxa": "tax_id string, tax_name string, rank string",
    "runs": "run_id bigint, params string",
    "placements": "placement_id bigint, classifier string, run_id bigint",
    "placement_names": "placement_id bigint, name string, origin string, mass double",
    "placement_classifications": "placement_id bigint, tax_id string, likelihood double",
    "placement_nbc": "placement_id bigint, tax_id string, bootstrap double",
    "placement_evidence": "placement_id bigint, rank string, evidence double, bayes_factor double",
    "placement_positions": "placement_id bigint, location int, ml_ratio double, log_like double, distal_bl double, pendant_bl double, tax_id string, map_identity_ratio double, map_identity_denom int",
    "placement_median_identities": "placement_id bigint, tax_id string, median_percent_identity double",
    "multiclass": "placement_id bigint, name string, want_rank string, rank string, tax_id string, likelihood double",
}


def create(spark: SparkSession, path: str) -> None:
    """Write empty relations as Parquet below a path, where they are missing."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}")


def append(df: DataFrame, path: str, name: str) -> None:
    """Append rows to a relation, its columns in order."""
    schema = df.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    df.select(*[F.col(x.name).cast(x.dataType) for x in schema]).write.mode("append").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def concat_multiclass(multiclass: DataFrame) -> DataFrame:
    """(placement_id, name, want_rank, tax_id, rank, id_count): the taxa of one result joined by commas."""
    return multiclass.groupBy("placement_id", "name", "want_rank").agg(F.array_join(F.array_sort(F.collect_set("tax_id")), ",").alias("tax_id"), F.min("rank").alias("rank"), F.countDistinct("tax_id").alias("id_count"))


def concat_taxa(multiclass_concat: DataFrame, taxa: DataFrame) -> DataFrame:
    """(tax_id, tax_name, rank) of joined ids that are no taxon yet: names that share their first word are written Word a/b, others joined by /."""
    new = multiclass_concat.where("id_count > 1").select("tax_id", "rank").distinct()
    each = new.select("tax_id", "rank", F.explode(F.split("tax_id", ",")).alias("_t")).join(taxa.select(F.col("tax_id").alias("_t"), "tax_name"), "_t")
    names = each.groupBy("tax_id", "rank").agg(F.array_sort(F.collect_set("tax_name")).alias("_n"))
    first = F.array_distinct(F.transform("_n", lambda x: F.split(x, " ")[0]))
    rest = F.transform("_n", lambda x: F.regexp_replace(x, r"^\S+ ", ""))
    several = F.forall("_n", lambda x: F.contains(x, F.lit(" ")))
    return names.select("tax_id", F.when((F.size(first) == 1) & several, F.concat_ws(" ", first[0], F.array_join(rest, "/"))).otherwise(F.array_join("_n", "/")).alias("tax_name"), "rank").join(taxa.select("tax_id"), "tax_id", "left_anti")


def tally_by_taxon(multiclass_concat: DataFrame, placement_names: DataFrame, taxa: DataFrame, want_rank: str) -> DataFrame:
    """(tax_id, tax_name, rank, tally, placements) at a wanted rank, the highest tally first."""
    own = multiclass_concat.where(F.col("want_rank") == want_rank).select("placement_id", "name", "tax_id").join(placement_names.select("placement_id", "name", "mass"), ["placement_id", "name"]).join(taxa, "tax_id", "left")
    sums = own.groupBy("tax_id").agg(F.coalesce(F.max("tax_name"), F.lit("unclassified")).alias("tax_name"), F.max("rank").alias("rank"), F.sum("mass").cast("bigint").alias("tally"), F.countDistinct("placement_id").alias("placements"))
    return sums.orderBy(F.desc("tally"), "tax_id")


def tally_by_specimen(multiclass_concat: DataFrame, placement_names: DataFrame, taxa: DataFrame, specimens: DataFrame, want_rank: str) -> DataFrame:
    """(specimen, tax_id, tax_name, tally, freq): freq is the share of the specimen's total."""
    own = multiclass_concat.where(F.col("want_rank") == want_rank).select("placement_id", "name", "tax_id").join(placement_names.select("placement_id", "name", "mass"), ["placement_id", "name"]).join(specimens, "name")
    sums = own.groupBy("specimen", "tax_id").agg(F.sum("mass").alias("tally")).withColumn("freq", F.col("tally") / F.sum("tally").over(W.partitionBy("specimen")))
    return sums.join(taxa.select("tax_id", "tax_name"), "tax_id", "left").select("specimen", "tax_id", F.coalesce("tax_name", "tax_id").alias("tax_name"), "tally", "freq")


def wide_table(tally: DataFrame, specimens: list[str], value: str = "tally", metadata: DataFrame | None = None) -> DataFrame:
    """A row for each taxon, a column for each specimen; missing is 0.

    metadata: (specimen, key, value): a row for each key besides, its name as tax_name, its id
    empty; all cells are text then, those that a key lacks null.
    """
    wide = tally.groupBy("tax_id", "tax_name").pivot("specimen", specimens).agg(F.first(value)).na.fill(0.0)
    if metadata is None:
        return wide
    extra = metadata.groupBy(F.lit("").alias("tax_id"), F.col("key").alias("tax_name")).pivot("specimen", specimens).agg(F.first("value"))
    return extra.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in wide.columns]).unionByName(wide.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in wide.columns]))


def _rect(multiclass_concat: DataFrame, placement_names: DataFrame, taxa: DataFrame, want_rank: str) -> DataFrame:
    own = multiclass_concat.where(F.col("want_rank") == want_rank).select("placement_id", "name", "tax_id").join(placement_names.select("placement_id", "name", "mass"), ["placement_id", "name"])
    known = taxa.select(F.col("tax_id").alias("_t"), F.col("tax_name").alias("_n"), F.col("rank").alias("_r"))
    return own.join(known, F.col("tax_id") == F.col("_t"), "left").select("placement_id", "name", "mass", F.coalesce("_t", F.lit("none")).alias("tax_id"), F.coalesce("_n", F.lit("unclassified")).alias("tax_name"), F.coalesce("_r", F.lit("root")).alias("rank"))


def rect_by_taxon(multiclass_concat: DataFrame, placement_names: DataFrame, taxa: DataFrame, want_rank: str) -> DataFrame:
    """The older tally: (tax_id, tax_name, rank, tally, placements), masses not made whole; unknown taxa are one row."""
    return _rect(multiclass_concat, placement_names, taxa, want_rank).groupBy("tax_id", "tax_name", "rank").agg(F.sum("mass").alias("tally"), F.countDistinct("placement_id").alias("placements"))


def rect_by_specimen(multiclass_concat: DataFrame, placement_names: DataFrame, taxa: DataFrame, specimens: DataFrame, want_rank: str) -> DataFrame:
    """The older tally by specimen: (specimen, tax_id, tax_name, rank, tally, placements, normalized_tally: the share of the specimen's mass)."""
    own = _rect(multiclass_concat, placement_names, taxa, want_rank).join(specimens, "name")
    sums = own.groupBy("specimen", "tax_id", "tax_name", "rank").agg(F.sum("mass").alias("tally"), F.countDistinct("placement_id").alias("placements"))
    return sums.withColumn("normalized_tally", F.col("tally") / F.sum("tally").over(W.partitionBy("specimen")))


def rect_normalized(by_specimen: DataFrame, n_specimens: int) -> DataFrame:
    """(tax_id, tax_name, rank, normalized_tally): the mean share over all specimens."""
    return by_specimen.groupBy("tax_id", "tax_name", "rank").agg((F.sum("normalized_tally") / n_specimens).alias("normalized_tally"))


def specimen_averages(tally: DataFrame, n_specimens: int) -> DataFrame:
    """(tax_id, tax_name, average): mean frequency over all specimens, those without the taxon too."""
    return tally.groupBy("tax_id", "tax_name").agg((F.sum("freq") / n_specimens).alias("average"))


def superseded_runs(placements: DataFrame, placement_names: DataFrame) -> DataFrame:
    """(placement_id) of placements whose names a later run placed again."""
    own = placement_names.join(placements, "placement_id")
    last = own.groupBy("name").agg(F.max("run_id").alias("_last"), F.countDistinct("run_id").alias("_n")).where("_n > 1")
    return own.join(last, "name").where("run_id < _last").select("placement_id").distinct()


def without_superseded(placements: DataFrame, placement_names: DataFrame, **others: DataFrame) -> dict[str, DataFrame]:
    """All relations without the rows of placements whose names a later run placed again."""
    gone = superseded_runs(placements, placement_names)
    every = {"placements": placements, "placement_names": placement_names, **others}
    return {name: df.join(gone, "placement_id", "left_anti") for name, df in every.items()}


def has_schema(spark: SparkSession, path: str) -> bool:
    """Whether all relations of the warehouse are there."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return all(system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")) for name in SCHEMAS)


def repair(multiclass: DataFrame, dedup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placement_names, multiclass) after sequences that were left out as duplicates come back.

    dedup: (global_rep, specimen_rep, mass).  Names that multiclass has keep their placement; the
    others take that of their global representative, and copies of its results.
    """
    placed = multiclass.select("placement_id", "name").distinct()
    known = placed.select("name").distinct()
    first = dedup.join(placed, dedup["specimen_rep"] == placed["name"]).select("placement_id", "name", "mass")
    missing = dedup.join(known.withColumnRenamed("name", "specimen_rep"), "specimen_rep", "left_anti")
    second = missing.join(first.select("placement_id", F.col("name").alias("global_rep")), "global_rep").select("placement_id", F.col("specimen_rep").alias("name"), "mass")
    copied = second.select("placement_id", "name").join(missing.select(F.col("specimen_rep").alias("name"), "global_rep"), "name").join(multiclass.drop("placement_id").withColumnRenamed("name", "global_rep"), "global_rep").drop("global_rep")
    return first.unionByName(second), multiclass.unionByName(copied.select(*multiclass.columns))


def fix_duplicates(placement_names: DataFrame, dedup: DataFrame) -> DataFrame:
    """placement_names with the duplicates of a (kept_id, orig_id, count) map added where they are missing."""
    added = dedup.join(placement_names, dedup["kept_id"] == placement_names["name"]).select("placement_id", F.col("orig_id").alias("name"), "origin", F.col("count").cast("double").alias("mass"))
    return placement_names.unionByName(added.join(placement_names.select("placement_id", "name"), ["placement_id", "name"], "left_anti").select("placement_id", "name", "origin", "mass"))


def add_classifications(multiclass: DataFrame, extra: DataFrame, lines: DataFrame, first_id: int = 1_000_000_000) -> DataFrame:
    """multiclass with external (name, tax_id) results, 1/n each where a name has n, fanned out to every rank of the lineage.

    Placement ids of the names are first_id plus a number by name.
    """
    own = extra.distinct().withColumn("likelihood", 1.0 / F.count("*").over(W.partitionBy("name")))
    ids = own.select("name").distinct().withColumn("placement_id", F.lit(first_id) + F.pmod(F.xxhash64("name"), F.lit(1 << 40)))
    fan = own.join(lines, "tax_id").groupBy("name", "rank", F.col("anc_tax_id").alias("_a")).agg(F.sum("likelihood").alias("likelihood"))
    new = fan.join(ids, "name").select("placement_id", "name", F.col("rank").alias("want_rank"), "rank", F.col("_a").alias("tax_id"), "likelihood")
    return multiclass.unionByName(new)


def route_by_rank(multiclass: DataFrame, rank: str) -> DataFrame:
    """(tax_id, name): results whose rank is the wanted one: the bins that names go to."""
    return multiclass.where((F.col("want_rank") == rank) & (F.col("rank") == rank)).select("tax_id", "name").distinct()
