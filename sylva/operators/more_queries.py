"""Queries whose results SQL cannot state: iterative, drawn or solved on the tree."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans import profile as P, star as S
from ..plans.stage import written
from ..plans.tree import Node, number, print_newick, prune_to, reroot as _reroot, tree_length
from ..sources.drawings import Skeleton, fat_decor, heat_color, hung_on_edge, phyloxml
from . import clusters as K, measures as M, place as L, taxonomy as T, trees as R
from .queries import ORACLES, QUERIES, _classified, _model, _rounded, by_order, query, taxa_of


def tree_of(edges: DataFrame) -> Node:
    """The tree of an ``edges`` relation."""
    nodes = {}
    rows = edges.orderBy("id").select("id", "parent_id", "bl", "label").collect()  # of the tree
    for r in rows:
        nodes[r.id] = Node(r.label, r.bl)
    for r in rows:
        if r.parent_id is not None:
            nodes[r.parent_id].children.append(nodes[r.id])
    return number(nodes[rows[-1].id])


@query()
def squash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squash clustering of the samples."""
    tree, placed = _model(spark, sf_dir)
    prof = P.profile(P.place_mass(placed), tree)
    return _rounded(spark.createDataFrame(K.squash(prof, ["A", "N", "R"]), "left string, right string, merged string, length_left double, length_right double"))


@query()
def epca(spark, sf_dir):
    """First edge components of the samples."""
    tree, placed = _model(spark, sf_dir)
    found = K.edge_pca(M.splitify(P.place_mass(placed), tree), 2)
    return _rounded(spark.createDataFrame([(s, k, float(found["projections"][i, k])) for i, s in enumerate(found["samples"]) for k in range(found["projections"].shape[1])], "sample string, component int, projection double"))


@query()
def lpca(spark, sf_dir):
    """First length components of the samples."""
    tree, placed = _model(spark, sf_dir)
    found = K.length_pca(P.profile(P.place_mass(placed), tree), ["A", "N", "R"], 2)
    return _rounded(spark.createDataFrame([(s, k, float(found["projections"][i, k])) for i, s in enumerate(found["samples"]) for k in range(len(found["values"]))], "sample string, component int, projection double"))


@query()
def pmlpca(spark, sf_dir):
    """First components of edge differences under branch lengths."""
    tree, placed = _model(spark, sf_dir)
    found = K.metric_pca(M.splitify(P.place_mass(placed), tree), dict(tree.select("id", "bl").collect()), 2)
    return _rounded(spark.createDataFrame([(s, k, float(found["projections"][i, k])) for i, s in enumerate(found["samples"]) for k in range(found["projections"].shape[1])], "sample string, component int, projection double"))


@query()
def compress(spark, sf_dir):
    """Orders that go over to a neighbour within a distance of 0.4."""
    tree, placed = by_order(spark, sf_dir)
    return K.compress(placed, tree, 0.4, discard_below=0.0)


@query()
def mcl(spark, sf_dir):
    """Markov clusters of the orders of each sample."""
    return K.markov_clusters(by_order(spark, sf_dir)[1], 4.0)


@query()
def kr_significance(spark, sf_dir):
    """Significance of the distance of A and R, queries are orders: 100 shuffles (steps of 0.01) and 1000 Gaussian deviates."""
    tree, placed = by_order(spark, sf_dir)
    units = written(P.mass(placed).where(F.col("sample").isin("A", "R")).select("sample", "pq_id", "loc", "pos", "m"), "units")
    z, p = K.shuffle_p_values(units, tree, "A", "R")
    return _rounded(spark.createDataFrame([(float(z), float(p), float(K.gaussian_p_value(units, tree, "A", "R")[1]))], "distance double, p_shuffle double, p_gaussian double"))


@query()
def indep_c(spark, sf_dir):
    """Account balances of suppliers carried to every place on the tree, and from there to each query's best placement."""
    tree, placed = _model(spark, sf_dir)
    values = {r[0]: float(r[1]) for r in S.table(spark, sf_dir, "supplier").select("s_name", "s_acctbal").collect()}
    best = P.ranked(placed).where("rank_in_pq = 1").select("sample", "pq_id", "loc", "distal_bl")
    return _rounded(R.carry_values(best, tree_of(tree), values).select("sample", "pq_id", "value"))


@query()
def min_adcl(spark, sf_dir):
    """Ten suppliers that lie close to the mass of all samples, each weighing the same."""
    tree, placed = _model(spark, sf_dir)
    root = tree_of(tree)
    mass = P.place_mass(placed, point=True).groupBy("loc", "pos").agg(F.sum("m").alias("m")).toArrow()  # a row a place on the tree
    at = [mass[c].to_numpy() for c in ("loc", "pos", "m")]
    chosen, cost = R.select_greedy_places(root, *at, min(10, sum(1 for _ in root.leaves())))
    names = {n.id: n.label for n in root.leaves()}
    return _rounded(spark.createDataFrame([(names[leaf], float(cost)) for leaf in chosen], "leaf string, adcl double"))


@query()
def convexify(spark, sf_dir):
    """Suppliers to keep so that a colouring of three colours is convex."""
    tree, _ = _model(spark, sf_dir)
    colors = {r[0]: r[1] for r in tree.where("is_leaf").select("id", (F.col("k") % 3).cast("string")).collect()}
    kept, _ = R.convex_subset(tree_of(tree), colors)
    return spark.createDataFrame([(k, k in kept) for k in sorted(colors)], "id int, kept boolean")


@query()
def pdprune(spark, sf_dir):
    """Suppliers with pendant branches up to 1.25, in the order in which they are cut off."""
    cut = R.prune_short(tree_of(_model(spark, sf_dir)[0]), cutoff=1.25)
    return spark.createDataFrame([(k, n, float(d)) for k, (n, d) in enumerate(cut)], "turn int, leaf string, length double")


@query()
def reroot(spark, sf_dir):
    """The tree hung from its first nation."""
    tree, _ = _model(spark, sf_dir)
    new = _reroot(tree_of(tree), tree.where("depth = 2").agg(F.min("id")).first()[0])
    return spark.createDataFrame([(print_newick(new, digits=6), float(tree_length(new)))], "newick string, length double")


@query()
def prepsim(spark, sf_dir):
    """Suppliers of the first region taken out, and where they would hang."""
    tree, _ = _model(spark, sf_dir)
    region = {r[0]: str(r[1]) for r in tree.where("is_leaf").select("label", "r").collect()}
    _, placed = R.cut_taxa(prune_to(tree_of(tree), set(region)), region, {"0"})  # nations without suppliers are no leaves
    return _rounded(spark.createDataFrame([(a, b, float(c), float(d)) for a, b, c, d in placed], "leaf string, edge int, distal double, pendant double"))


@query()
def fat_tree(spark, sf_dir):
    """Trees drawn with edges as wide as their mass."""
    tree, placed = _model(spark, sf_dir)
    widths = {}
    for r in M.edge_widths(P.place_mass(placed), tree).collect():  # a row an edge and sample
        widths.setdefault(r["sample"], {})[r["edge"]] = r["width"]
    root = tree_of(tree)
    return spark.createDataFrame([(s, phyloxml([(s, root, fat_decor(w))])) for s, w in sorted(widths.items())], "sample string, xml string")


@query()
def heat(spark, sf_dir):
    """Colours of the net transport from A to N."""
    tree, placed = _model(spark, sf_dir)
    rows = M.kr_heat(P.place_mass(placed), tree, "A", "N").collect()  # a row an edge
    top = max(abs(r["heat"]) for r in rows)
    return spark.createDataFrame([(r["edge"], *heat_color(r["heat"], top)) for r in rows], "edge int, red int, green int, blue int")


#: Characters of trees that a task sends on at a time.
TEXT_AT_ONCE = 1 << 24


@query()
def tog(spark, sf_dir):
    """A tree for each sample with every order at its best place."""
    tree, placed = by_order(spark, sf_dir)
    skeleton = Skeleton(tree_of(tree), digits=6)
    best = P.ranked(placed).where("rank_in_pq = 1").select("sample", F.col("loc").cast("int").alias("loc"), "distal_bl", F.col("pq_id").cast("string").alias("name"), F.col("pendant_bl").cast("double").alias("pendant_bl"))
    keys = ["sample", "loc"]

    def along(batches):  # rows of an edge come together and in order
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        made, size = [], 0
        for (sample, loc), own in itertools.groupby(rows, key=lambda row: row[:2]):
            made.append((sample, loc, *hung_on_edge([row[2:] for row in own], skeleton.lengths[loc], skeleton.digits)))
            size += len(made[-1][3])
            if size > TEXT_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], [*keys, "brackets", "tail"])
                made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], [*keys, "brackets", "tail"])

    edges = best.repartition(*keys).sortWithinPartitions(*keys, "distal_bl", "name", "pendant_bl").mapInArrow(along, "sample string, loc long, brackets long, tail string")

    def one(table):  # a row an edge; texts are joined as bytes, without a copy of each
        tails = [chunk.slice(k, 1) for chunk in table["tail"].chunks for k in range(len(chunk))]
        raw = [memoryview(x.buffers()[2])[slice(*np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + 2].tolist())] for x in tails]
        text, parts, at = skeleton.text, [], 0
        for begin, end, what in skeleton.cuts(dict(zip(table["loc"].to_pylist(), zip(table["brackets"].to_pylist(), raw, strict=True), strict=True))):
            parts += [text[at:begin].encode(), b"(" * what if isinstance(what, int) else what]
            at = end
        whole = b"".join([*parts, text[at:].encode()])
        newick = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(whole)], np.int32)), pa.py_buffer(whole))
        return pa.table([table["sample"].slice(0, 1), newick], ["sample", "newick"])

    return edges.groupBy("sample").applyInArrow(one, "sample string, newick string")


@query()
def sing(spark, sf_dir):
    """A tree for each order of each sample, with all its placements."""
    tree, placed = by_order(spark, sf_dir)
    skeleton = Skeleton(tree_of(tree), digits=6)
    rows = P.ranked(placed).groupBy("sample", "pq_id").agg(F.array_sort(F.collect_list(F.struct("rank_in_pq", "loc", "distal_bl", F.col("pendant_bl").cast("double").alias("pendant_bl")))).alias("own"))
    step = max(1, TEXT_AT_ONCE // len(skeleton.text))  # whole trees: a batch of input is many times as long in text

    def each(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                trees = [skeleton.hang([(f"{k}_{x['rank_in_pq']}", x["loc"], x["distal_bl"], x["pendant_bl"]) for x in own]) for k, own in zip(part.column("pq_id").to_pylist(), part.column("own").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("sample"), part.column("pq_id"), pa.array(trees, pa.string())], ["sample", "pq_id", "newick"])

    return rows.mapInArrow(each, "sample string, pq_id long, newick string")


@query()
def nbc(spark, sf_dir):
    """Languages of documents by naive Bayes over 8-letter words of their letters folded onto four."""
    docs = S.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.lower("text").alias("seq"), F.col("lang").alias("tax_id"))
    return T.nbc_classify_sequences(docs, *T.nbc_train_sequences(docs, 8, T.FOLDED), 8, T.FOLDED).select("name", "tax_id")


@query()
def placer(spark, sf_dir):
    """Names of nations placed onto a tree of regions by likelihood, letters folded onto nucleotides."""
    fold = lambda c: F.rpad(F.translate(F.regexp_replace(F.lower(c), "[^a-z]", ""), "bdefhijklmnopqrsuvwxyz", "acgtacgtacgtacgtacgtac"), 14, "-")
    regions = S.table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name", fold("r_name").alias("s")).collect()
    leaves = [Node(r[0], 0.2) for r in regions]
    root = number(Node(None, 0.0, None, [Node(None, 0.1, None, leaves[:2]), *leaves[2:]]))
    model = L.Model.gtr({"ac": 1.0, "ag": 2.0, "at": 1.0, "cg": 1.0, "ct": 2.0, "gt": 1.0}, [0.25] * 4, alpha=0.7)
    ref = L.Reference(root, {r[0]: r[1].upper() for r in regions}, model)
    queries = S.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.upper(fold("n_name")).alias("seq"))
    return L.place(queries, ref).select("name", "line", "loc", F.round("ml_ratio", 4).alias("ml_ratio"))


@query()
def hybrid(spark, sf_dir):
    """Each query's best supplier against the best nation of its order, the first if it is consistent."""
    taxa, ranks = taxa_of(spark, sf_dir)
    own = P.ranked(_classified(spark, sf_dir)).where("rank_in_pq = 1").select(F.concat_ws("/", "sample", F.col("pq_id").cast("string")).alias("name"), F.col("classification").alias("tax_id"), F.lit(2).alias("rank_order"))
    nation = T.classify(_classified(spark, sf_dir), T.lineage(taxa, ranks), ranks, cutoff=0.5).where("want_rank = 'nation' AND rank = 'nation'").select(F.concat_ws("/", "sample", F.col("pq_id").cast("string")).alias("name"), "tax_id", F.lit(1).alias("rank_order"))
    return T.hybrid2(own, nation.dropDuplicates(["name"]), T.lineage(taxa, ranks))


@query("SELECT 'ranks' relation, CAST(3 AS BIGINT) n UNION ALL SELECT 'taxa', (SELECT COUNT(*) FROM region) + (SELECT COUNT(*) FROM nation) + (SELECT COUNT(*) FROM supplier)")
def prep_db(spark, sf_dir):
    """Rows of the warehouse's dimensions."""
    taxa, ranks = taxa_of(spark, sf_dir)
    return ranks.agg(F.count("*").alias("n")).select(F.lit("ranks").alias("relation"), "n").unionByName(taxa.agg(F.count("*").alias("n")).select(F.lit("taxa").alias("relation"), "n"))


__all__ = ["ORACLES", "QUERIES"]
