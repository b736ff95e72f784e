"""Operators on collections of placed queries: filter, merge, split, round, redistribute.

Relations: ``placements`` (sample, pq_id, loc, ml_ratio, distal_bl, pendant_bl, ...) and ``names``
(sample, pq_id, name, mass).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.profile import TRANSFORMS

KEYS = ["sample", "pq_id"]


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def filter_names(names: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), default_exclude: bool = False) -> DataFrame:
    """Names kept by unanchored regular expressions: all but the excluded ones (unless included), or only included ones not excluded."""
    inside, outside = _any([F.rlike("name", F.lit(x)) for x in include]), _any([F.rlike("name", F.lit(x)) for x in exclude])
    return names.where((inside & ~outside) if default_exclude else (~outside | inside))


def filter_mass(names: DataFrame, above: float = 0.0, at_most: float = float("inf")) -> DataFrame:
    """Queries with above < mass <= at_most, all their names summed."""
    kept = names.groupBy(*KEYS).agg(F.sum("mass").alias("_m")).where((F.col("_m") > above) & (F.col("_m") <= at_most)).select(*KEYS)
    return names.join(kept, KEYS, "left_semi")


def filter_taxa(placements: DataFrame, lineage: DataFrame, taxa: Sequence[str], cutoff: float = 0.9) -> DataFrame:
    """(sample, pq_id) of queries more than ``cutoff`` of whose weight is classified at or below one of the taxa.

    lineage: (tax_id, anc_tax_id); placements have a classification.  Weights are added from the
    largest down: a sum at the cutoff must not hang on the order in which rows arrive.
    """
    shares = placements.join(lineage.where(F.col("anc_tax_id").isin(list(taxa))), F.col("classification") == F.col("tax_id"))
    falling = F.sort_array(F.collect_list("ml_ratio"), asc=False)
    return shares.groupBy(*KEYS, "anc_tax_id").agg(F.aggregate(falling, F.lit(0.0), lambda a, x: a + x).alias("_p")).where(F.col("_p") > cutoff).select(*KEYS).distinct()


def placed_only(names: DataFrame, placements: DataFrame) -> DataFrame:
    return names.join(placements.select(*KEYS).distinct(), KEYS, "left_semi")


def merge(samples: Sequence[DataFrame], name: str = "merged") -> DataFrame:
    """All rows of several collections as one sample; query ids are told apart by their old sample."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), samples)
    return rows.withColumn("pq_id", F.concat_ws("/", F.col("sample"), F.col("pq_id").cast("string"))).withColumn("sample", F.lit(name))


def split(placements: DataFrame, names: DataFrame, split_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collections by a (name, grp) map; unmapped names are dropped, a query may appear in several groups."""
    new_names = names.join(split_map, "name").select(F.col("grp").alias("sample"), "pq_id", "name", "mass", F.col("sample").alias("_from"))
    own = new_names.select("sample", "pq_id", "_from").distinct()
    moved = placements.withColumnRenamed("sample", "_from").join(own, ["_from", "pq_id"])
    return moved.drop("_from"), new_names.drop("_from")


def rounded(placements: DataFrame, names: DataFrame, digits: int = 3, cutoff: float = 0.01) -> DataFrame:
    """Queries that agree in their placements of weight >= cutoff, rounded to ``digits`` decimals (0: exact), become one.

    (sample, pq_id, names, mass, n_pqueries): the representative is the least query of a cluster.
    """
    kept = placements.where(F.col("ml_ratio") >= cutoff)
    value = (lambda c: F.col(c)) if digits == 0 else (lambda c: F.round(c, digits))
    key = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("ml_ratio")).alias("o"), F.col("loc"), value("distal_bl").alias("d"), value("pendant_bl").alias("p")))), lambda x: F.struct(x["loc"], x["d"], x["p"]))
    keyed = kept.groupBy(*KEYS).agg(key.alias("_key"))
    by_query = names.groupBy(*KEYS).agg(F.collect_list("name").alias("_names"), F.sum("mass").alias("_mass"))
    return keyed.join(by_query, KEYS).groupBy("sample", "_key").agg(F.min("pq_id").alias("pq_id"), F.array_sort(F.flatten(F.collect_list("_names"))).alias("names"), F.sum("_mass").alias("mass"), F.count("*").alias("n_pqueries")).drop("_key")


def one_name_each(placements: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A query for each name: ids become (query/name)."""
    own = names.withColumn("_id", F.concat_ws("/", F.col("pq_id").cast("string"), "name"))
    spread = placements.join(own.select(*KEYS, "_id"), KEYS).drop("pq_id").withColumnRenamed("_id", "pq_id")
    return spread, own.drop("pq_id").withColumnRenamed("_id", "pq_id")


def restore_duplicates(names: DataFrame, dedup_map: DataFrame, *, as_mass: bool = False) -> DataFrame:
    """Names that a (kept_id, orig_id, count) map stands for: each original with its count as mass, or the kept name with their sum.

    A name that the map lacks stays as it is.
    """
    m = dedup_map.select("kept_id", "orig_id", F.col("count").cast("double").alias("_count"))
    if as_mass:
        m = m.groupBy("kept_id").agg(F.sum("_count").alias("_count")).withColumn("orig_id", F.col("kept_id"))
    joined = names.join(m, names["name"] == m["kept_id"], "left")
    return joined.select(*KEYS, F.coalesce("orig_id", "name").alias("name"), F.when(F.col("_count").isNotNull(), F.col("mass") * F.col("_count")).otherwise(F.col("mass")).alias("mass"))


def duplicate_by_count(names: DataFrame) -> DataFrame:
    """Each name as often as its (whole) mass says, with mass 1; any other mass is an error."""
    whole = F.when(F.col("mass") == F.floor("mass"), F.col("mass").cast("int")).otherwise(F.raise_error(F.lit("mass is not whole")))
    return names.withColumn("_k", F.explode(F.sequence(F.lit(1), whole))).select(*KEYS, "name", F.lit(1.0).alias("mass"))


def transform_masses(names: DataFrame, transform: str = "no_trans", leaf_values: DataFrame | None = None, best: DataFrame | None = None, unitize: bool = False) -> DataFrame:
    """Multiplicities transformed (and spread evenly over a query's names), scaled by the value of the nearest leaf, then made to sum to 1: in that order.

    leaf_values: (loc, value) and best: (sample, pq_id, loc), for the scale.
    """
    own = W.partitionBy(*KEYS)
    out = names.withColumn("_m", TRANSFORMS[transform](F.sum("mass").over(own)) / F.count("*").over(own)) if transform != "no_trans" else names.withColumn("_m", F.col("mass"))
    if leaf_values is not None:
        out = out.join(best.join(leaf_values, "loc").select(*KEYS, "value"), KEYS).withColumn("_m", F.col("_m") * F.col("value")).drop("value")
    if unitize:
        out = out.withColumn("_m", F.col("_m") / F.sum("_m").over(W.partitionBy("sample")))
    return out.withColumn("mass", F.col("_m")).drop("_m")


def to_table(placements: DataFrame, names: DataFrame) -> DataFrame:
    """A row for each name and placement; missing values are the text NA."""
    own = names.select(*KEYS, "name", F.col("mass").alias("multiplicity"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NA")) if c in placements.columns else F.lit("NA")
    wide = placements.join(own, KEYS)
    columns = ["loc", "ml_ratio", "post_prob", "log_like", "marginal_like", "distal_bl", "pendant_bl", "classification", "map_ratio", "map_overlap"]
    return wide.select(F.col("sample").alias("origin"), "name", "multiplicity", *[text(c).alias(c) for c in columns])


def info(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample, leaves, pqueries, mass)"""
    leaves = edges.where("is_leaf").agg(F.count("*").alias("leaves"))
    return names.groupBy("sample").agg(F.countDistinct("pq_id").alias("pqueries"), F.sum("mass").alias("mass")).join(F.broadcast(leaves)).select("sample", "leaves", "pqueries", "mass")  # one row


def check_places(placements: DataFrame, edges: DataFrame) -> DataFrame:
    """Placements that lie outside their edge."""
    own = placements.join(edges.select(F.col("id").alias("loc"), F.col("bl").alias("edge_bl")), "loc")
    return own.where((F.col("distal_bl") > F.col("edge_bl")) | (F.col("distal_bl") < 0)).select("sample", "pq_id", "loc", "distal_bl", "edge_bl")


def check_weights(placements: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Queries whose weights do not sum to 1, or with zero weights: (sample, pq_id, total, n_zero)."""
    sums = placements.groupBy(*KEYS).agg(F.sum("ml_ratio").alias("total"), F.count_if(F.col("ml_ratio") == 0).alias("n_zero"))
    return sums.where((F.abs(F.col("total") - 1) > tolerance) | (F.col("n_zero") > 0))


def keep_best(placements: DataFrame, at_most: int = 7, factor: float = 0.01) -> DataFrame:
    """A query's best placements by log likelihood within a factor of the best, with weights from their likelihoods."""
    own = W.partitionBy(*KEYS)
    ranked = placements.withColumn("_k", F.row_number().over(own.orderBy(F.desc("log_like"), "loc"))).withColumn("_top", F.max("log_like").over(own))
    kept = ranked.where((F.col("_k") <= at_most) & (F.col("log_like") >= F.col("_top") + F.log(F.lit(factor))))
    likely = F.exp(F.col("log_like") - F.col("_top"))
    return kept.withColumn("ml_ratio", likely / F.sum(likely).over(own)).drop("_k", "_top")


def dedup_sequences(sequences: DataFrame, split: str | None = None) -> DataFrame:
    """(kept_id, orig_id, count) from (name, seq): the least name of equal sequences is kept, for each split apart."""
    keys = ["_h", "seq"] + ([split] if split else [])
    own = sequences.withColumn("_h", F.sha1(F.encode("seq", "UTF-8")))
    groups = own.groupBy("_h", "seq").agg(F.min("name").alias("kept_id"))
    per = own.groupBy(*keys).agg(F.min("name").alias("orig_id"), F.count("*").alias("count"))
    return per.join(groups, ["_h", "seq"]).select("kept_id", "orig_id", "count")


def trim_leaves(units: DataFrame, edges: DataFrame, min_mass: float = 0.001) -> DataFrame:
    """(sample, id, path_mass, kept): mass on the way from the root to each leaf, and whether the leaf stays."""
    from ..plans.profile import by_edge, samples_of

    per = by_edge(units)
    leaves = edges.where("is_leaf").select("id", F.explode("path").alias("loc")).withColumn("sample", F.explode(F.array(*[F.lit(s) for s in samples_of(units)])))
    sums = leaves.join(per, ["sample", "loc"], "left").groupBy("sample", "id").agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("path_mass"))
    return sums.withColumn("kept", F.col("path_mass") >= min_mass)


def _uniform(text: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def rarefy(names: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n reads of each sample drawn without replacement, every unit of mass a read: names with their drawn mass.

    Reads are ranked by the MD5 of seed, sample, query, name and number: the draw repeats, and
    needs no generator's state.  A sample with fewer reads gives all of them.  Reads are counted
    by the first 16 bits, so only those of the one stretch that the n-th falls in are ordered.
    """
    reads = names.withColumn("_k", F.explode(F.sequence(F.lit(1), F.greatest(F.col("mass").cast("int"), F.lit(1)))))
    reads = reads.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "sample", F.col("pq_id").cast("string"), "name", F.col("_k").cast("string")))).withColumn("_b", F.substring("_h", 1, 4))
    sizes = reads.groupBy("sample", "_b").agg(F.count("*").alias("_c"))
    need = sizes.select("sample", "_b", (n - (F.sum("_c").over(W.partitionBy("sample").orderBy("_b")) - F.col("_c"))).alias("_need")).where("_need > 0")
    order = W.partitionBy("sample", "_b").orderBy("_h", "pq_id", "name", "_k")
    return reads.join(need, ["sample", "_b"]).withColumn("_r", F.row_number().over(order)).where("_r <= _need").groupBy(*KEYS, "name").agg(F.count("*").cast("double").alias("mass"))


def rarefy_multinomial(names: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n reads of each sample drawn with replacement, in proportion to mass: names with their drawn mass.

    Draw j is a place on the sample's mass, by the MD5 of seed, sample and j.  Names lie there by
    a hash of theirs; a place is looked up among the sums of 4096 stretches, then within one.
    """
    own = names.withColumn("_b", F.substring(F.md5(F.concat_ws(":", F.col("pq_id").cast("string"), "name")), 1, 3))
    sums = own.groupBy("sample", "_b").agg(F.sum("mass").alias("_m"))
    along, whole = W.partitionBy("sample").orderBy("_b"), W.partitionBy("sample")
    placed = sums.select("sample", "_b", (F.sum("_m").over(along) - F.col("_m")).alias("_from"), F.sum("_m").over(along).alias("_to"), F.sum("_m").over(whole).alias("_total"))
    # stretches by slices of the whole, so that draws meet them by equality
    slices = 256
    first, last = F.floor(F.col("_from") / F.col("_total") * slices), F.least(F.floor(F.col("_to") / F.col("_total") * slices), F.lit(slices - 1))
    sliced = placed.withColumn("_slice", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    draws = sums.select("sample").distinct().withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_u", _uniform(F.concat_ws(":", F.lit(str(seed)), "sample", F.col("_j").cast("string"))))
    draws = draws.withColumn("_slice", F.floor(F.col("_u") * slices).cast("int"))
    at = draws.join(sliced, ["sample", "_slice"]).withColumn("_x", F.col("_u") * F.col("_total")).where("_x >= _from AND _x < _to").select("sample", "_b", "_x", "_from")
    within = W.partitionBy("sample", "_b").orderBy("pq_id", "name")
    spans = own.select("sample", "_b", "pq_id", "name", (F.sum("mass").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("mass")).alias("_lo"), "mass")
    hit = at.join(spans, ["sample", "_b"]).where("_x >= _from + _lo AND _x < _from + _lo + mass")
    return hit.groupBy(*KEYS, "name").agg(F.count("*").cast("double").alias("mass"))


def sorted_run(placements: DataFrame, names: DataFrame) -> DataFrame:
    """Placements in a settled order: queries by their least name (``place``, from 1), placements by weight (``rank_in_pq``)."""
    from ..plans.profile import ranked

    first = names.groupBy(*KEYS).agg(F.min("name").alias("_name"))
    queries = first.withColumn("place", F.row_number().over(W.partitionBy("sample").orderBy("_name", "pq_id"))).drop("_name")
    return ranked(placements).join(queries, KEYS).orderBy("sample", "place", "rank_in_pq")
