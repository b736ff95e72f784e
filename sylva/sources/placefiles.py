"""Placement documents: readers and writers.

A document is one JSON text (versions 1 to 3): a tree in Newick, ``fields`` that name the positions
of each placement's numbers, and placements with names.  Rows are parsed by Spark; only the tree
text of each distinct tree comes to the driver.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..plans.tree import Node, edge_rows, parse_newick, print_newick

DOCUMENT = "tree string, version int, fields array<string>, placements array<struct<p: string, n: string, nm: string, m: double>>, metadata map<string,string>"
#: Names that a field had in other versions.
RENAMED = {"marginal_prob": "marginal_like"}
COLUMNS = {
    "edge_num": "int", "like_weight_ratio": "double", "post_prob": "double", "likelihood": "double", "marginal_like": "double", "distal_length": "double", "pendant_length": "double", "classification": "string", "map_ratio": "double", "map_overlap": "int",
}


class Placements:
    """A parsed collection: ``tree`` (Node), ``edges``, ``placements`` and ``names``."""

    def __init__(self, tree: Node, edges: DataFrame, placements: DataFrame, names: DataFrame):
        self.tree, self.edges, self.placements, self.names = tree, edges, placements, names


def _matrix(column: Column) -> Column:
    return F.from_json(column, "array<array<string>>")


def read_documents(spark: SparkSession, paths: str | list[str]) -> Placements:
    """Read placement documents that share one tree; a sample is named by its file.

    Gzipped files are read as they are.  A version beyond 1 to 3, a document without placements and
    differing trees are errors.
    """
    raw = spark.read.text(paths, wholetext=True).withColumn("_file", F.input_file_name())
    name = F.regexp_replace(F.element_at(F.split("_file", "/"), -1), r"(\.jplace|\.json)?(\.gz)?$", "")
    docs = raw.select(name.alias("sample"), F.from_json("value", DOCUMENT).alias("d"))
    heads = docs.select("sample", "d.tree", "d.version", F.size("d.placements").alias("n")).collect()  # a row a document
    for h in heads:
        if h.version not in (1, 2, 3):
            raise ValueError(f"{h.sample}: version {h.version} is not 1, 2 or 3")
        if not h.n or h.n < 0:
            raise ValueError(f"{h.sample}: no placements")
    trees = {h.tree for h in heads}
    parsed = [parse_newick(t) for t in sorted(trees)]
    shape = {tuple((r[1], r[2], r[5], r[6]) for r in edge_rows(t)) for t in parsed}
    if len(shape) != 1:
        raise ValueError("the documents' trees differ")
    tree = parsed[0]
    edges = spark.createDataFrame(edge_rows(tree), "id int, edge_num int, parent_id int, lo int, depth int, bl double, label string, is_leaf boolean, path array<int>")
    each = docs.select("sample", "d.fields", F.posexplode("d.placements").alias("pq_id", "x"))
    fields = F.transform("fields", lambda f: F.coalesce(*[F.when(f == a, b) for a, b in RENAMED.items()], f))
    rows = each.select("sample", F.col("pq_id").cast("long").alias("pq_id"), fields.alias("f"), F.posexplode(_matrix(F.col("x.p"))).alias("line", "v"))
    values = F.map_from_arrays("f", "v")
    placed = rows.select("sample", "pq_id", "line", *[F.element_at(values, c).cast(t).alias(c) for c, t in COLUMNS.items()])
    own = edges.select(F.col("edge_num").alias("_e"), F.col("id").alias("loc"), "bl")
    placements = placed.join(F.broadcast(own), F.col("edge_num") == F.col("_e")).select(
        "sample", "pq_id", "line", "loc", "bl", F.col("like_weight_ratio").alias("ml_ratio"), "post_prob", F.col("likelihood").alias("log_like"), "marginal_like", F.col("distal_length").alias("distal_bl"), F.col("pendant_length").alias("pendant_bl"), "classification", "map_ratio", "map_overlap"
    )
    # n: a name or names of mass 1 (or m, if there is one name); nm: pairs of name and mass
    listed = F.coalesce(F.from_json("x.n", "array<string>"), F.when(F.col("x.n").isNotNull(), F.array(F.regexp_replace("x.n", '^"|"$', ""))))
    plain = F.transform(listed, lambda n: F.struct(n.alias("name"), F.coalesce(F.col("x.m"), F.lit(1.0)).alias("mass")))
    pairs = F.transform(_matrix(F.col("x.nm")), lambda v: F.struct(v[0].alias("name"), v[1].cast("double").alias("mass")))
    names = each.select("sample", F.col("pq_id").cast("long").alias("pq_id"), F.explode(F.coalesce(pairs, plain)).alias("n")).select("sample", "pq_id", "n.name", "n.mass")
    return Placements(tree, edges, placements, names)


def write_documents(run: Placements, folder: str, *, metadata: dict | None = None, transm: list[tuple[int, int, float]] | None = None) -> list[str]:
    """Write each sample as a version 3 document: one text file a sample, the fields that have values, sorted.

    ``metadata`` goes into every document, and so does ``transm``, the map of edges of a trimmed
    tree: (old edge, new edge, what is added to a distal position).
    """
    about = dict(metadata or {}) | ({"transm": [list(x) for x in transm]} if transm is not None else {})
    own = run.edges.select(F.col("id").alias("loc"), F.col("edge_num").alias("edge_num"))
    back = {"ml_ratio": "like_weight_ratio", "log_like": "likelihood", "distal_bl": "distal_length", "pendant_bl": "pendant_length"}
    wide = run.placements.join(F.broadcast(own), "loc")
    for a, b in back.items():
        wide = wide.withColumnRenamed(a, b)
    counts = wide.agg(*[F.count(c).alias(c) for c in COLUMNS if c in wide.columns]).first().asDict()
    fields = sorted(c for c, n in counts.items() if n)
    value = F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(F.to_json(F.struct(F.col(c).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6), F.lit("null")) for c in fields]), F.lit("]"))
    best = W.partitionBy("sample", "pq_id").orderBy(F.desc("like_weight_ratio"), "line")
    p = wide.withColumn("_k", F.row_number().over(best)).groupBy("sample", "pq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", value.alias("t")))), lambda x: x["t"]), ",").alias("p"))
    pair = F.concat(F.lit("["), F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(","), F.col("mass").cast("string"), F.lit("]"))
    nm = run.names.groupBy("sample", "pq_id").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("nm"))
    lines = p.join(nm, ["sample", "pq_id"]).select("sample", "pq_id", F.concat(F.lit('{"p":['), "p", F.lit('],"nm":['), "nm", F.lit("]}")).alias("t"))
    # a line a query between a head and a tail: no string holds a whole sample
    k = F.row_number().over(W.partitionBy("sample").orderBy("pq_id"))
    rows = lines.withColumn("_k", k.cast("long")).select("sample", "_k", F.concat(F.when(F.col("_k") == 1, "").otherwise(","), "t").alias("value"))
    head = f'{{"tree":{json.dumps(print_newick(run.tree, braces=True))},"version":3,"fields":{json.dumps(fields)},"metadata":{json.dumps(about)},"placements":['
    ends = lines.select("sample").distinct().select("sample", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("_k"), F.lit(head).alias("value")), F.struct(F.lit(2**62).cast("long").alias("_k"), F.lit("]}").alias("value")))).alias("x")).select("sample", "x._k", "x.value")
    rows.unionByName(ends).repartition("sample").sortWithinPartitions("sample", "_k").select("sample", "value").write.partitionBy("sample").mode("overwrite").text(folder)
    return fields


def read_transm(spark: SparkSession, path: str) -> DataFrame:
    """(old_edge, new_edge, added) of a trimmed document's metadata; no rows without it."""
    text = spark.read.text(path, wholetext=True)
    rows = F.from_json(F.get_json_object("value", "$.metadata.transm"), "array<array<double>>")
    return text.select(F.explode(rows).alias("v")).select(F.col("v")[0].cast("int").alias("old_edge"), F.col("v")[1].cast("int").alias("new_edge"), F.col("v")[2].alias("added"))


#: Columns of a row of the old text format, in order, as our relations call them (the sixth is absent in its shorter rows).
OLD_COLUMNS = ("edge_num", "ml_ratio", "post_prob", "log_like", "marginal_like", "distal_bl", "pendant_bl", "contains", "classification")


def write_legacy(run: Placements, path: str, *, invocation: str = "", now: str | None = None) -> None:
    """Write a collection of one sample as old text, queries under their best edge, in one file.

    ``now``: the header's time, else the present.  Text of a collection is written by Spark,
    partitions in order: header, then a block for each edge, then the queries' rows.
    """
    from datetime import datetime

    when = now or datetime.now().strftime("%Y/%m/%d %H:%M:%S")
    head = [f"# placements, {when}", f"# invocation: {invocation}", "# output format: location, ML weight ratio, PP, ML likelihood, marginal likelihood, attachment location (distal length), pendant branch length, containment classification, classification", f"# reference tree: {print_newick(run.tree)}"]
    own = run.edges.select(F.col("id").alias("loc"), "edge_num")
    wide = run.placements.drop("edge_num").join(F.broadcast(own), "loc")
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")) if c in wide.columns else F.lit("-")
    ranked = W.partitionBy("sample", "pq_id").orderBy(F.desc("ml_ratio"), "line")
    rows = wide.withColumn("_k", F.row_number().over(ranked)).withColumn("_t", F.concat_ws("\t", *[cell(c) for c in OLD_COLUMNS]))
    each = rows.groupBy("sample", "pq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_t"))), lambda x: x["_t"]).alias("_rows"), F.min_by("edge_num", "_k").alias("edge"))
    names = run.names.groupBy("sample", "pq_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("_names"))
    blocks = each.join(names, ["sample", "pq_id"]).select("edge", "pq_id", F.concat_ws("\n", F.concat(F.lit(">"), "_names"), F.lit("-"), F.array_join("_rows", "\n")).alias("value"))
    marks = blocks.select("edge").distinct().select("edge", F.lit(-1).cast("long").alias("pq_id"), F.concat(F.lit("# location "), F.col("edge").cast("string")).alias("value"))
    spark = run.placements.sparkSession
    top = spark.createDataFrame([(-1, k, v) for k, v in enumerate(head)], "edge int, pq_id long, value string")
    top.unionByName(marks).unionByName(blocks).coalesce(1).sortWithinPartitions("edge", "pq_id").select("value").write.mode("overwrite").text(path)


def legacy_placements(spark: SparkSession, path: str, tree: Node) -> Placements:
    """Old text as a collection on its tree: rows of nine columns, or of seven (without containment and marginal likelihood)."""
    raw = _legacy_rows(spark, path)
    v = F.col("values")
    nine = F.size(v) >= 9
    number = lambda i, j: F.when(nine, v[i]).otherwise(v[j] if j is not None else None).try_cast("double")
    edges = spark.createDataFrame(edge_rows(tree), "id int, edge_num int, parent_id int, lo int, depth int, bl double, label string, is_leaf boolean, path array<int>")
    keyed = raw.withColumn("sample", F.lit(os.path.basename(path).removesuffix(".place"))).withColumn("pq_id", F.xxhash64(F.array_join("names", " ")))
    rows = keyed.select("sample", "pq_id", "line", v[0].cast("int").alias("edge_num"), number(1, 1).alias("ml_ratio"), number(2, 2).alias("post_prob"), number(3, 3).alias("log_like"), number(4, None).alias("marginal_like"), number(5, 4).alias("distal_bl"), number(6, 5).alias("pendant_bl"), F.nullif(F.when(nine, v[8]).otherwise(v[6]), F.lit("-")).alias("classification"))
    placed = rows.join(F.broadcast(edges.select("edge_num", F.col("id").alias("loc"), "bl")), "edge_num")
    names = keyed.select("sample", "pq_id", F.explode("names").alias("name")).distinct().withColumn("mass", F.lit(1.0))
    return Placements(tree, edges, placed, names)


def _legacy_rows(spark: SparkSession, path: str) -> DataFrame:
    blocks = spark.read.option("lineSep", ">").text(path).where("length(trim(value)) > 0 AND NOT startswith(value, '#')")
    rows = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    number = F.filter(rows, lambda x: F.rlike(x, F.lit(r"^\s*\d+[\s\t]+[-\d.eE+]+")))
    return blocks.select(F.split(F.trim(rows[0]), r"\s+").alias("names"), rows[1].alias("seq"), F.posexplode(number).alias("line", "v")).select("names", "seq", "line", F.split(F.trim("v"), r"\s+").alias("values"))


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """(names, seq, line, values) of old text files: blocks that begin with >, names, the sequence, then rows of numbers (null: none)."""
    return _legacy_rows(spark, path).withColumn("values", F.transform("values", lambda x: x.try_cast("double")))


def read_any(spark: SparkSession, path: str) -> Placements | DataFrame:
    """By suffix: placement documents (.jplace, .json, gzipped or not) or old text files (.place)."""
    bare = path.removesuffix(".gz")
    if bare.endswith(".place"):
        return read_legacy(spark, path)
    if bare.endswith((".jplace", ".json")):
        return read_documents(spark, path)
    raise ValueError(f"unknown suffix: {os.path.basename(path)}")


def read_biom(spark: SparkSession, path: str, tree: Node) -> tuple[DataFrame, DataFrame]:
    """(placements, names) of an OTU table of format 1: each (row, sample) with a count is a query at the leaf of the row's name."""
    schema = "matrix_type string, data array<array<double>>, rows array<struct<id: string>>, columns array<struct<id: string>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    sparse = doc.where("d.matrix_type = 'sparse'").select("d.rows", "d.columns", F.explode("d.data").alias("v")).select("rows", "columns", F.col("v")[0].cast("int").alias("i"), F.col("v")[1].cast("int").alias("j"), F.col("v")[2].alias("mass"))
    dense = doc.where("d.matrix_type = 'dense'").select("d.rows", "d.columns", F.posexplode("d.data").alias("i", "v")).select("rows", "columns", "i", F.posexplode("v").alias("j", "mass"))
    cells = sparse.unionByName(dense).where("mass > 0").select(F.col("columns")[F.col("j")]["id"].alias("sample"), F.col("i").cast("long").alias("pq_id"), F.col("rows")[F.col("i")]["id"].alias("leaf"), "mass")
    leaves = spark.createDataFrame([(n.label, n.id, float(n.length or 0.0)) for n in tree.leaves()], "leaf string, loc int, bl double")
    at = cells.join(F.broadcast(leaves), "leaf")
    placements = at.select("sample", "pq_id", F.lit(0).alias("line"), "loc", "bl", F.lit(1.0).alias("ml_ratio"), F.lit(0.0).alias("distal_bl"), F.lit(0.0).alias("pendant_bl"))
    return placements, at.select("sample", "pq_id", F.concat(F.lit("pl_"), "pq_id").alias("name"), "mass")
