"""Taxonomy: lineages, classification of placed queries, cut-sets and convexity.

Relations: ``taxa`` (tax_id, parent_id, rank, tax_name), ``ranks`` (rank, rank_order; 0 is the
coarsest), ``lineage`` (tax_id, anc_tax_id, rank, rank_order), a row for each ancestor or self.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.stage import written

#: What a share may miss of a cutoff by rounding.
TOLERANCE = 1e-12
KEYS = ["sample", "pq_id"]


def lineage(taxa: DataFrame, ranks: DataFrame, max_depth: int = 64) -> DataFrame:
    """Every taxon's ancestors and itself, by following parents as often as the deepest taxon needs.

    Each step, and the result, is written down: its size is known to joins, and plans stay short.
    """
    own = taxa.select("tax_id", F.col("tax_id").alias("anc_tax_id"))
    parents = written(taxa.select(F.col("tax_id").alias("_t"), F.col("parent_id").alias("_p")).where("_p IS NOT NULL AND _p <> _t"), "parents")
    found, front = own, own
    for _ in range(max_depth):
        front = written(front.join(parents, F.col("anc_tax_id") == F.col("_t")).select("tax_id", F.col("_p").alias("anc_tax_id")), "lineage")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    named = taxa.select(F.col("tax_id").alias("_t"), "rank")
    return written(found.join(named, F.col("anc_tax_id") == F.col("_t")).join(ranks, "rank").select("tax_id", "anc_tax_id", "rank", "rank_order"), "lineage")


def roll_up(placements: DataFrame, lines: DataFrame, weight: str = "w") -> DataFrame:
    """(sample, pq_id, rank, rank_order, tax_id, likelihood): a query's weight at each ancestor of its placements' taxa."""
    own = placements.select(*KEYS, F.col("classification").alias("tax_id"), F.col(weight).alias("_w"))
    return own.join(lines, "tax_id").groupBy(*KEYS, "rank", "rank_order", F.col("anc_tax_id").alias("_a")).agg(F.sum("_w").alias("likelihood")).withColumnRenamed("_a", "tax_id")


def filter_best(shares: DataFrame, cutoff: float = 0.9, multiclass_min: float = 0.2) -> DataFrame:
    """Per query and rank: the best taxon if it reaches the cutoff, else all of at least multiclass_min if they reach it together."""
    own = W.partitionBy(*KEYS, "rank")
    big = F.col("likelihood") >= multiclass_min - TOLERANCE
    best = F.row_number().over(own.orderBy(F.desc("likelihood"), "tax_id"))
    out = shares.withColumn("_k", best).withColumn("_top", F.max("likelihood").over(own)).withColumn("_sum", F.sum(F.when(big, F.col("likelihood")).otherwise(0.0)).over(own))
    single = F.col("_top") >= cutoff - TOLERANCE
    return out.where((single & (F.col("_k") == 1)) | (~single & big & (F.col("_sum") >= cutoff - TOLERANCE))).drop("_k", "_top", "_sum")


def evidence(shares: DataFrame, painted: DataFrame) -> DataFrame:
    """(sample, pq_id, rank, rank_order, evidence, bayes_factor): weight per painted edge of each taxon, and its log ratio to the coarser occupied rank.

    painted: (tax_id, n_edges).  The first occupied rank's factor is infinite; none follows from zero evidence.
    """
    per = shares.join(painted, "tax_id").groupBy(*KEYS, "rank", "rank_order").agg(F.sum(F.col("likelihood") / F.col("n_edges")).alias("evidence"))
    before = F.lag("evidence").over(W.partitionBy(*KEYS).orderBy("rank_order"))
    first = F.row_number().over(W.partitionBy(*KEYS).orderBy("rank_order")) == 1
    return per.withColumn("bayes_factor", F.when(first, F.lit(float("inf"))).when((before > 0) & (F.col("evidence") > 0), F.log(F.col("evidence") / before)))


def filter_best_bayes(shares: DataFrame, factors: DataFrame, bayes_cutoff: float = 1.0, multiclass_min: float = 0.2) -> DataFrame:
    """From the most specific rank up: once a rank's evidence reaches the cutoff, it and all coarser ranks stay; then small shares go."""
    finer = W.partitionBy(*KEYS).orderBy(F.desc("rank_order")).rowsBetween(W.unboundedPreceding, 0)
    kept = factors.withColumn("_on", F.max((F.coalesce(F.col("bayes_factor") >= bayes_cutoff, F.lit(False))).cast("int")).over(finer)).where("_on = 1").select(*KEYS, "rank")
    return shares.join(kept, [*KEYS, "rank"], "left_semi").where(F.col("likelihood") >= multiclass_min - TOLERANCE)


def want_ranks(best: DataFrame, ranks: DataFrame) -> DataFrame:
    """(sample, pq_id, want_rank, rank, tax_id, likelihood): for each rank wanted the nearest one at or above it with a result.

    A query's results come together once; ranks are few and become a literal.
    """
    wanted = F.array(*[F.struct(F.lit(r[0]).alias("want_rank"), F.lit(int(r[1])).alias("want_order")) for r in ranks.select("rank", "rank_order").collect()])
    held = best.groupBy(*KEYS).agg(F.collect_list(F.struct("rank_order", "rank", "tax_id", "likelihood")).alias("_own"))
    each = held.select(*KEYS, "_own", F.explode(wanted).alias("_w"))
    nearest = F.array_max(F.transform(F.filter("_own", lambda x: x["rank_order"] <= F.col("_w.want_order")), lambda x: x["rank_order"]))
    rows = each.withColumn("_n", nearest).where("_n IS NOT NULL").select(*KEYS, "_w.want_rank", F.explode(F.filter("_own", lambda x: x["rank_order"] == F.col("_n"))).alias("_x"))
    return rows.select(*KEYS, "want_rank", "_x.rank", "_x.tax_id", "_x.likelihood")


def classify(placements: DataFrame, lines: DataFrame, ranks: DataFrame, *, weight: str = "w", cutoff: float = 0.9, multiclass_min: float = 0.2, bayes_cutoff: float = 1.0, painted: DataFrame | None = None) -> DataFrame:
    """The ``multiclass`` relation of placed queries; Bayes factors decide if painted edges are given and their cutoff is not 0."""
    shares = roll_up(placements, lines, weight)
    if painted is None or abs(bayes_cutoff) < 1e-9:
        best = filter_best(shares, cutoff, multiclass_min)
    else:
        best = filter_best_bayes(shares, evidence(shares, painted), bayes_cutoff, multiclass_min)
    return want_ranks(best, ranks)


def classify_rdp(lines: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """(name, tax_name, bootstrap) from result lines: a name, then Taxon(percent) fields parted by tabs or semicolons."""
    parts = F.split("value", r"[\t;]")
    field = F.explode(F.slice(parts, 2, F.size(parts))).alias("_f")
    out = lines.select(F.trim(F.element_at(parts, 1)).alias("name"), field)
    out = out.select("name", F.regexp_extract("_f", r"^\"?(.*?)\"?\(([0-9.]+)\)\s*$", 1).alias("tax_name"), F.expr("try_cast(regexp_extract(_f, '\\\\(([0-9.]+)\\\\)\\\\s*$', 1) AS DOUBLE)").alias("_b"))
    return out.where("tax_name <> '' AND _b IS NOT NULL").withColumn("bootstrap", F.when(F.col("_b") > 1, F.col("_b") / 100).otherwise(F.col("_b"))).where(F.col("bootstrap") >= cutoff).drop("_b")


def classify_blast(hits: DataFrame) -> DataFrame:
    """(name, tax_id, pident): the hit of the highest identity for each name, ties to the least tax_id."""
    return hits.groupBy("name").agg(F.max("pident").alias("pident"), F.min_by("tax_id", F.struct((-F.col("pident")).alias("o"), "tax_id")).alias("tax_id")).select("name", "tax_id", "pident")


def hybrid2(placed: DataFrame, bayes: DataFrame, lines: DataFrame) -> DataFrame:
    """(name, tax_id, source): the placement's taxon if it is at least as specific and the Bayesian one lies on its lineage, else the Bayesian one.

    Both inputs: (name, tax_id, rank_order), the best of each; a name in one only is dropped.
    """
    both = placed.select("name", F.col("tax_id").alias("p"), F.col("rank_order").alias("p_rank")).join(bayes.select("name", F.col("tax_id").alias("b"), F.col("rank_order").alias("b_rank")), "name")
    on = both.join(lines.select(F.col("tax_id").alias("p"), F.col("anc_tax_id").alias("b"), F.lit(True).alias("_on")).distinct(), ["p", "b"], "left")
    use = F.coalesce("_on", F.lit(False)) & (F.col("p_rank") >= F.col("b_rank"))
    return on.select("name", F.when(use, F.col("p")).otherwise(F.col("b")).alias("tax_id"), F.when(use, "placement").otherwise("nbc").alias("source"))


def hybrid5(placed: DataFrame, bayes: DataFrame, lines: DataFrame) -> DataFrame:
    """As :func:`hybrid2`, but the placement is taken only if it is at most one rank more specific."""
    deep = hybrid2(placed, bayes, lines)
    ranks = placed.select("name", F.col("rank_order").alias("p_rank")).join(bayes.select("name", F.col("tax_id").alias("b"), F.col("rank_order").alias("b_rank")), "name")
    both = deep.join(ranks, "name")
    far = (F.col("source") == "placement") & (F.col("p_rank") - F.col("b_rank") > 1)
    return both.select("name", F.when(far, F.col("b")).otherwise(F.col("tax_id")).alias("tax_id"), F.when(far, "nbc").otherwise(F.col("source")).alias("source"))


def common_ancestor(groups: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """(key, tax_id): the deepest taxon on the lineages of all of a group's taxa; null taxa do not count."""
    own = groups.where("tax_id IS NOT NULL").select(key, "tax_id").distinct()
    n = own.groupBy(key).agg(F.count("*").alias("_n"))
    hits = own.join(lines, "tax_id").groupBy(key, "anc_tax_id", "rank_order").agg(F.count("*").alias("_k"))
    return hits.join(n, key).where("_k = _n").groupBy(key).agg(F.max_by("anc_tax_id", F.struct("rank_order", "anc_tax_id")).alias("tax_id"))


def cut_sets(edges: DataFrame, colors: DataFrame) -> DataFrame:
    """(edge, color): colours with leaves both below and above an edge.  colors: (id, color) of leaves; other leaves have none."""
    total = colors.groupBy("color").agg(F.count("*").alias("_all"))
    under = edges.where("is_leaf").select("id", F.explode("path").alias("edge")).join(colors, "id").groupBy("edge", "color").agg(F.count("*").alias("_below"))
    return under.join(total, "color").where("_below < _all").select("edge", "color")


def badness(edges: DataFrame, colors: DataFrame) -> DataFrame:
    """(edge, badness): colours beyond the first in each edge's cut-set."""
    per = cut_sets(edges, colors).groupBy("edge").agg(F.count("*").alias("_n"))
    return edges.select(F.col("id").alias("edge")).join(per, "edge", "left").select("edge", F.greatest(F.coalesce("_n", F.lit(0)) - 1, F.lit(0)).alias("badness"))


def convex_taxids(edges: DataFrame, leaf_taxa: DataFrame) -> DataFrame:
    """(rank, tax_id, n_leaves) of taxa in no cut-set of two or more colours of their rank.

    leaf_taxa: (id, rank, color); each rank is coloured apart.
    """
    total = leaf_taxa.groupBy("rank", "color").agg(F.count("*").alias("n_leaves"))
    under = edges.where("is_leaf").select("id", F.explode("path").alias("edge")).join(leaf_taxa, "id").groupBy("rank", "edge", "color").agg(F.count("*").alias("_b"))
    cut = under.join(total, ["rank", "color"]).where("_b < n_leaves").select("rank", "edge", "color")
    crowded = cut.groupBy("rank", "edge").agg(F.count("*").alias("_n")).where("_n >= 2")
    bad = cut.join(crowded, ["rank", "edge"]).select("rank", "color").distinct()
    return total.join(bad, ["rank", "color"], "left_anti").select("rank", F.col("color").alias("tax_id"), "n_leaves")


def painting(edges: DataFrame, leaf_taxa: DataFrame) -> DataFrame:
    """(edge, rank, tax_id): for each edge the most specific rank at which its leaves below share one colour with the cut, that colour painted.

    leaf_taxa: (id, rank, rank_order, color).  The root counts as cut by all colours of its rank.
    """
    total = leaf_taxa.groupBy("rank", "rank_order", "color").agg(F.count("*").alias("_all"))
    under = edges.where("is_leaf").select("id", F.explode("path").alias("edge")).join(leaf_taxa, "id").groupBy("rank", "rank_order", "edge", "color").agg(F.count("*").alias("_b"))
    root = edges.where("parent_id IS NULL").select(F.col("id").alias("edge"), F.lit(True).alias("_root"))
    cut = under.join(total, ["rank", "rank_order", "color"]).join(root, "edge", "left").where("_b < _all OR _root")
    single = cut.groupBy("edge", "rank", "rank_order").agg(F.count("*").alias("_n"), F.min("color").alias("color")).where("_n = 1")
    return single.groupBy("edge").agg(F.max_by(F.struct("rank", "color"), "rank_order").alias("x")).select("edge", F.col("x.rank").alias("rank"), F.col("x.color").alias("tax_id"))


def taxonomic_info(edges: DataFrame, leaf_taxa: DataFrame) -> DataFrame:
    """(rank, n_taxids, n_nonconvex, max_badness, tot_badness)"""
    total = leaf_taxa.groupBy("rank", "color").agg(F.count("*").alias("_all"))
    under = edges.where("is_leaf").select("id", F.explode("path").alias("edge")).join(leaf_taxa, "id").groupBy("rank", "edge", "color").agg(F.count("*").alias("_b"))
    cut = under.join(total, ["rank", "color"]).where("_b < _all").select("rank", "edge", "color")
    per = cut.groupBy("rank", "edge").agg((F.count("*") - 1).alias("_bad"))
    sums = per.groupBy("rank").agg(F.max("_bad").alias("max_badness"), F.sum("_bad").alias("tot_badness"))
    bad = cut.join(per.where("_bad > 0"), ["rank", "edge"]).groupBy("rank").agg(F.countDistinct("color").alias("n_nonconvex"))
    zero = F.lit(0).cast("long")
    return leaf_taxa.groupBy("rank").agg(F.countDistinct("color").alias("n_taxids")).join(bad, "rank", "left").join(sums, "rank", "left").select("rank", "n_taxids", F.coalesce("n_nonconvex", zero).alias("n_nonconvex"), F.coalesce("max_badness", zero).alias("max_badness"), F.coalesce("tot_badness", zero).alias("tot_badness"))


def to_rdp(seqinfo: DataFrame, taxa: DataFrame, lines: DataFrame, ranks: DataFrame, wanted: list[str]) -> DataFrame:
    """(seqname, line): a header of a sequence's taxa at the wanted ranks, coarsest first; sequences that lack one are dropped."""
    own = seqinfo.where("tax_id IS NOT NULL").join(lines.where(F.col("rank").isin(wanted)), "tax_id").join(taxa.select(F.col("tax_id").alias("anc_tax_id"), "tax_name"), "anc_tax_id")
    text = own.groupBy("seqname").agg(F.array_sort(F.collect_list(F.struct("rank_order", F.regexp_replace("tax_name", r"[\s;]+", "_").alias("n")))).alias("x"))
    return text.where(F.size("x") == len(wanted)).select("seqname", F.concat(F.lit(">"), F.col("seqname"), F.lit("\tRoot;"), F.array_join(F.transform("x", lambda v: v["n"]), ";")).alias("line"))


def identities(queries: DataFrame, references: DataFrame) -> DataFrame:
    """(query, reference, identity, overlap) of aligned sequences: share of equal positions where neither has a gap (0 without any).

    Every query meets every reference by definition; Spark broadcasts references if they are small,
    else deals pairs of partitions.
    """
    pair = queries.select(F.col("name").alias("query"), F.col("seq").alias("_q")).crossJoin(references.select(F.col("name").alias("reference"), F.col("seq").alias("_r")))
    both = F.zip_with(F.split("_q", ""), F.split("_r", ""), lambda a, b: F.when((a == "-") | (b == "-"), F.lit(None)).otherwise((a == b).cast("int")))
    used = F.filter(both, lambda x: x.isNotNull())
    return pair.withColumn("_u", used).select("query", "reference", F.when(F.size("_u") == 0, 0.0).otherwise(F.aggregate("_u", F.lit(0), lambda a, x: a + x) / F.size("_u")).alias("identity"), F.size("_u").alias("overlap"))


def median_identities(pairs: DataFrame, seqinfo: DataFrame) -> DataFrame:
    """(query, tax_id, median_identity) over the references of each taxon."""
    return pairs.join(seqinfo.select(F.col("seqname").alias("reference"), "tax_id"), "reference").groupBy("query", "tax_id").agg(F.percentile("identity", F.lit(0.5)).alias("median_identity"))


def distance_spread(distances: DataFrame) -> DataFrame:
    """(seqname, tax_id, median, cv): median distance to a taxon and its coefficient of variation (null for one distance or a mean of 0)."""
    mean = F.nullif(F.avg("distance"), F.lit(0.0))
    return distances.groupBy("seqname", "tax_id").agg(F.percentile("distance", F.lit(0.5)).alias("median"), (F.stddev_samp("distance") / mean).alias("cv"))


# -- naive Bayes over words of sequences


#: Lower-case letters folded onto four, as the queries over plain text do.
FOLDED = dict(zip("abcdefghijklmnopqrstuvwxyz", "aaccgtgacgtacgtacgttacgtac", strict=True))


def _letter_codes(letters: dict[str, str] | None) -> np.ndarray:
    """What each byte is: a base 0 to 3, 4 for a letter that no word holds, 5 for what is dropped."""
    table = np.full(256, 5, np.uint8)
    if letters is None:
        table[ord("A") : ord("Z") + 1] = 4
    for k, v in (letters or {x: x for x in "ACGT"}).items():
        table[ord(k)] = "ACGT".index(v.upper())
    return table


def _count_words(texts: pa.Array, length: int, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, code, n) of the words of texts, about a million bytes at a time; rows and codes ascend, a row is in one part."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = lo + 1 if 2 * length > 42 else max(lo + 1, int(np.searchsorted(ends, ends[lo] + (1 << 20), side="right")) - 1)
        sizes = np.diff(ends[lo : hi + 1])
        if texts.null_count:
            own = texts.slice(lo, hi - lo).is_valid().to_numpy(zero_copy_only=False)
        else:
            own = np.ones(hi - lo, bool)
        base = table[data[ends[lo] : ends[hi]]]
        row = np.repeat(np.arange(hi - lo), sizes)
        keep = (base < 5) & own[row]
        base, row = base[keep], row[keep]
        m = len(base) - length + 1
        if m > 0:
            code, fits = np.zeros(m, np.int64), row[:m] == row[length - 1 :]
            for j in range(length):
                code = code * 4 + (base[j : m + j] & 3)
                fits &= base[j : m + j] < 4
            key = code[fits] + (row[:m][fits] << (2 * length) if hi - lo > 1 else 0)
            key.sort()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.array([], int)
            n = np.diff(np.append(first, len(key)))
            key = key[first]
            yield lo + ((key >> (2 * length)) if hi - lo > 1 else np.zeros(len(key), np.int64)), key & ((1 << (2 * length)) - 1), n
        lo = hi


def _spelled(codes: np.ndarray, length: int) -> pa.Array:
    """Words by their numbers, two bits a base."""
    shifts = np.arange(2 * (length - 1), -1, -2)
    text = np.frombuffer(b"ACGT", np.uint8)[(codes[:, None] >> shifts) & 3]
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(np.arange(0, len(codes) * length + 1, length, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(text)))


def _alone(sequences: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose name no other row has, rows of repeated names or None): the former need no shuffle."""
    repeated = written(sequences.groupBy("name").agg(F.count("*").alias("_k")).where("_k > 1").select(F.col("name").alias("_name")), "repeated")
    if repeated.isEmpty():
        return sequences, None
    same = F.col("name").eqNullSafe(F.col("_name"))
    return sequences.join(repeated, same, "left_anti"), sequences.join(repeated, same, "left_semi")


def word_codes(sequences: DataFrame, length: int = 8, letters: dict[str, str] | None = None, *, spelled: bool = False) -> DataFrame:
    """(name, code, n): as :func:`words`, the words as numbers of two bits a base; up to 31 bases.

    A task counts the words of whole sequences; only names of several rows are shuffled.
    ``letters`` maps letters of ``seq``, as it is, to bases; whatever it lacks is dropped.
    """
    table, out = _letter_codes(letters), "word" if spelled else "code"
    kind = sequences.schema["name"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            for row, code, n in _count_words(batch.column("seq"), length, table):
                yield pa.RecordBatch.from_arrays([batch.column("name").take(pa.array(row)), _spelled(code, length) if spelled else pa.array(code), pa.array(n)], ["name", out, "n"])

    def counted(rows):
        return rows.select("name", (F.upper("seq") if letters is None else F.col("seq")).alias("seq")).mapInArrow(count, f"name {kind}, {out} {'string' if spelled else 'long'}, n long")

    single, many = _alone(sequences)
    return counted(single) if many is None else counted(single).unionByName(counted(many).groupBy("name", out).agg(F.sum("n").alias("n")))


def words(sequences: DataFrame, length: int = 8, letters: dict[str, str] | None = None) -> DataFrame:
    """(name, word, n): k-mers of ungapped upper-case sequences with no letter beyond A, C, G, T, counted."""
    if length <= 31:
        return word_codes(sequences, length, letters, spelled=True)
    if letters is not None:
        raise ValueError("letters are mapped for words of at most 31 bases")
    seq = F.regexp_replace(F.upper("seq"), "[^A-Z]", "")
    own = sequences.select("name", seq.alias("_s")).where(F.length("_s") >= length)
    each = own.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("_s") - length + 1), lambda i: F.substring(F.col("_s"), i, F.lit(length)))).alias("word"))
    return each.where(F.rlike("word", F.lit("^[ACGT]+$"))).groupBy("name", "word").agg(F.count("*").alias("n"))


def nbc_train(reference_words: DataFrame, seq_taxa: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Word probabilities of taxa: (tax_id, word, log_p) for words seen, and (tax_id, size) with the prior's base.

    prior(word) = (sequences with it + 0.5) / (sequences + 1); p = (sequences of the taxon with it + prior) / (sequences of it + 1).
    """
    seen = reference_words.join(seq_taxa, "name").groupBy("tax_id", "word").agg(F.count("*").alias("_m"))
    return _word_model(seen, reference_words.groupBy("word").agg(F.count("*").alias("_n")), seq_taxa)


def _word_model(seen: DataFrame, counts: DataFrame, seq_taxa: DataFrame) -> tuple[DataFrame, DataFrame]:
    n_all = seq_taxa.agg(F.count("*").alias("_all"))
    prior = counts.join(F.broadcast(n_all)).select("word", ((F.col("_n") + 0.5) / (F.col("_all") + 1)).alias("prior"))
    size = seq_taxa.groupBy("tax_id").agg(F.count("*").alias("size"))
    model = seen.join(prior, "word").join(size, "tax_id").select("tax_id", "word", "prior", (F.log((F.col("_m") + F.col("prior")) / (F.col("size") + 1)) - F.log(F.col("prior") / (F.col("size") + 1))).alias("gain"))
    return model, size


def nbc_train_sequences(sequences: DataFrame, length: int = 8, letters: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`nbc_train` on the words of sequences (name, seq, tax_id): tasks count for each taxon how many of theirs hold a word."""
    table = _letter_codes(letters)
    kind = sequences.schema["tax_id"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            taxa = batch.column("tax_id").dictionary_encode(null_encoding="encode")
            which = taxa.indices.to_numpy(zero_copy_only=False)
            for row, code, _ in _count_words(batch.column("seq"), length, table):
                order = np.lexsort((code, which[row]))
                t, c = which[row][order], code[order]
                first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])) if len(t) else np.array([], int)
                yield pa.RecordBatch.from_arrays([taxa.dictionary.take(pa.array(t[first])), _spelled(c[first], length), pa.array(np.diff(np.append(first, len(t))))], ["tax_id", "word", "_m"])

    single, many = _alone(sequences)
    text = (F.upper("seq") if letters is None else F.col("seq")).alias("seq")
    seen = single.select("tax_id", text).mapInArrow(count, f"tax_id {kind}, word string, _m long").groupBy("tax_id", "word").agg(F.sum("_m").alias("_m"))
    seen = written(seen, "words_of_taxa")  # a row a taxon and word: read for the taxa and for all sequences
    counts = seen.select("word", F.col("_m").alias("_n"))
    if many is not None:
        more = words(many.select("name", "seq"), length, letters)
        seen = seen.unionByName(more.join(many.select("name", "tax_id"), "name").groupBy("tax_id", "word").agg(F.count("*").alias("_m"))).groupBy("tax_id", "word").agg(F.sum("_m").alias("_m"))
        counts = counts.unionByName(more.groupBy("word").agg(F.count("*").alias("_n")))
    return _word_model(seen, counts.groupBy("word").agg(F.sum("_n").alias("_n")), sequences.select("name", "tax_id"))


def nbc_classify(query_words: DataFrame, reference_words: DataFrame, seq_taxa: DataFrame) -> DataFrame:
    """(name, tax_id, score): the taxon of the highest sum of count * log p over a query's words; words no reference has do not count.

    The sum over unseen words of a taxon is the prior's, so only words that occur in a taxon are joined with it.
    """
    return _best_taxa(query_words, *nbc_train(reference_words, seq_taxa))


def _best_taxa(query_words: DataFrame, model: DataFrame, size: DataFrame) -> DataFrame:
    prior = model.select("word", "prior").distinct()
    base = query_words.join(prior, "word").groupBy("name").agg(F.sum(F.col("n") * F.log("prior")).alias("_base"), F.sum("n").alias("_words"))
    gains = query_words.join(model, "word").groupBy("name", "tax_id").agg(F.sum(F.col("n") * F.col("gain")).alias("_gain"))
    each = base.crossJoin(size.where("tax_id IS NOT NULL")).join(gains, ["name", "tax_id"], "left")  # a taxon may win without a common word
    scored = each.select("name", "tax_id", (F.col("_base") - F.col("_words") * F.log(F.col("size") + 1) + F.coalesce("_gain", F.lit(0.0))).alias("score"))
    return scored.groupBy("name").agg(F.max_by(F.struct("tax_id", "score"), F.struct("score", "tax_id")).alias("x")).select("name", "x.tax_id", "x.score")


#: Entries of the matrix of taxa and words that tasks are sent (64 MB); larger models are joined.
MODEL_ENTRIES = 1 << 23


def nbc_classify_sequences(queries: DataFrame, model: DataFrame, size: DataFrame, length: int = 8, letters: dict[str, str] | None = None) -> DataFrame:
    """:func:`nbc_classify` of sequences (name, seq) by a trained model: tasks count the words of a sequence and score it whole.

    The model, whose size is that of the taxonomy, comes to the driver and goes to the tasks as a
    matrix; one of more than ``MODEL_ENTRIES`` is joined instead, as are names of several rows.
    """
    model = written(model, "word_model")
    taxa = sorted(tuple(r) for r in size.where("tax_id IS NOT NULL").collect())  # a row a taxon
    if len(taxa) * 4**length > MODEL_ENTRIES:
        return _best_taxa(words(queries, length, letters), model, size)
    at = {t: k for k, (t, _) in enumerate(taxa)}
    rows = model.select("tax_id", word_number("word").alias("code"), "prior", "gain").toArrow()  # a row a taxon and word
    code = rows["code"].to_numpy()
    log_prior, known = np.zeros(4**length), np.zeros(4**length, bool)
    log_prior[code], known[code] = np.log(rows["prior"].to_numpy()), True
    gain = np.zeros((len(taxa), 4**length))
    which = rows["tax_id"].combine_chunks().dictionary_encode()
    gain[np.array([at[t] for t in which.dictionary.to_pylist()], int)[which.indices.to_numpy()], code] = rows["gain"].to_numpy()
    log_size = np.log(np.array([n for _, n in taxa], float) + 1)
    names, table = pa.array([t for t, _ in taxa], to_arrow_type(size.schema["tax_id"].dataType)), _letter_codes(letters)
    kind, tax_kind = queries.schema["name"].dataType.simpleString(), size.schema["tax_id"].dataType.simpleString()

    def score(batches):
        for batch in batches:
            for row, word, n in _count_words(batch.column("seq"), length, table):
                use = known[word]
                own, row = np.unique(row[use], return_inverse=True)
                if not len(own) or not len(names):
                    continue
                word, n = word[use], n[use].astype(float)
                base, many = np.bincount(row, n * log_prior[word], len(own)), np.bincount(row, n, len(own))
                all_scores = np.array([base - many * log_size[k] + np.bincount(row, n * gain[k][word], len(own)) for k in range(len(names))])
                best = len(names) - 1 - all_scores[::-1].argmax(0)  # of equal ones the last name
                yield pa.RecordBatch.from_arrays([batch.column("name").take(pa.array(own)), names.take(pa.array(best)), pa.array(all_scores[best, np.arange(len(own))])], ["name", "tax_id", "score"])

    single, many = _alone(queries)
    text = (F.upper("seq") if letters is None else F.col("seq")).alias("seq")
    found = single.select("name", text).mapInArrow(score, f"name {kind}, tax_id {tax_kind}, score double")
    return found if many is None else found.unionByName(_best_taxa(words(many, length, letters), model, size))


def nbc_bootstrap(query_words: DataFrame, reference_words: DataFrame, seq_taxa: DataFrame, lines: DataFrame, n: int = 100, seed: int = 1, length: int = 8) -> DataFrame:
    """(name, rank, tax_id, bootstrap): share of n replicates whose best taxon lies at or below each taxon.

    A replicate draws columns, not words of a sequence: every word of length ``length`` a Poisson
    number of times of mean 1 / length, by a hash of seed, replicate and word, the same for all
    sequences.  It counts for a sequence only if the words that it holds there come within 15 %
    of its number of words over the length; of 5 n replicates the first n that count are taken.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), "_b", "word"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    total, term, copies = 0.0, math.exp(-1.0 / length), F.lit(0)
    for k in range(8):
        total += term
        copies = copies + F.when(u > total, 1).otherwise(0)
        term /= (k + 1) * length
    whole = query_words.groupBy("name").agg(F.floor(F.sum("n") / length).alias("_want"))
    drawn = query_words.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(5 * n)))).withColumn("_c", copies).where("_c > 0").withColumn("n", F.col("n") * F.col("_c"))
    held = drawn.groupBy("name", "_b").agg(F.sum("n").alias("_held")).join(whole, "name").where(F.abs(F.col("_held") - F.col("_want")) <= F.floor(F.col("_want") * 15 / 100))
    first = held.withColumn("_k", F.row_number().over(W.partitionBy("name").orderBy("_b"))).where(F.col("_k") <= n).select("name", "_b")
    each = drawn.join(first, ["name", "_b"], "left_semi").select(F.concat_ws("\t", "name", F.col("_b").cast("string")).alias("name"), "word", "n")
    won = nbc_classify(each, reference_words, seq_taxa).select(F.split("name", "\t")[0].alias("name"), "tax_id")
    whole = won.groupBy("name").agg(F.count("*").alias("_all"))
    votes = won.join(lines, "tax_id").groupBy("name", "rank", F.col("anc_tax_id").alias("_a")).agg(F.count("*").alias("_k"))
    return votes.join(whole, "name").select("name", "rank", F.col("_a").alias("tax_id"), (F.col("_k") / F.col("_all")).alias("bootstrap"))


def word_number(word: str) -> Column:
    """A word as a number of two bits a base, A, C, G, T from 0."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda acc, c: acc * 4 + F.instr(F.lit("ACGT"), c) - 1)


def pack_words(word_counts: DataFrame) -> DataFrame:
    """(name, code, n): words as numbers of two bits a base, A, C, G, T from 0."""
    return word_counts.select("name", word_number("word").alias("code"), "n")


def auto_rank(seq_taxa: DataFrame, lines: DataFrame, percent: int = 80) -> str:
    """The most specific rank that more than ``percent`` of the sequences (whole percents) have a taxon of; ValueError if there is none."""
    n_all = seq_taxa.select("name").distinct().count()
    have = seq_taxa.join(lines, "tax_id").groupBy("rank", "rank_order").agg(F.countDistinct("name").alias("k"))
    found = have.where(F.floor(F.col("k") * 100 / n_all) > percent).orderBy(F.desc("rank_order")).select("rank").first()  # a row a rank
    if found is None:
        raise ValueError("no rank is common enough")
    return found[0]


def rank_labels(seq_taxa: DataFrame, lines: DataFrame, rank: str = "auto") -> DataFrame:
    """(name, tax_id) to train on: each sequence's taxon of one rank, of the automatic one, or of every rank ("all")."""
    own = seq_taxa.join(lines, "tax_id")
    if rank != "all":
        own = own.where(F.col("rank") == (auto_rank(seq_taxa, lines) if rank == "auto" else rank))
    return own.select("name", F.col("anc_tax_id").alias("tax_id")).distinct()


def on_best_lineage(votes: DataFrame, best: DataFrame, lines: DataFrame) -> DataFrame:
    """Bootstrap votes (name, rank, tax_id, ...) on the lineage of the taxon that the sequence's words (each once) name: (name, tax_id) in ``best``."""
    own = best.select("name", "tax_id").join(lines.select("tax_id", "anc_tax_id"), "tax_id").select("name", F.col("anc_tax_id").alias("tax_id"))
    return votes.join(own, ["name", "tax_id"], "left_semi")


def hybrid2f(placed: DataFrame, bayes: DataFrame, lines: DataFrame) -> DataFrame:
    """(name, tax_id, source): always the Bayesian taxon, of names that both inputs have."""
    return bayes.join(placed.select("name").distinct(), "name", "left_semi").select("name", "tax_id", F.lit("nbc").alias("source"))


def unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, missing): names that only one of two classifiers has, which hybrids drop: for a warning or a count."""
    both = left.select(F.col("name").alias("l")).distinct().join(right.select(F.col("name").alias("r")).distinct(), F.col("l") == F.col("r"), "full_outer")
    return both.where("l IS NULL OR r IS NULL").select(F.coalesce("l", "r").alias("name"), F.when(F.col("l").isNull(), "left").otherwise("right").alias("missing"))


# -- the taxonomy as a tree


def tax_tree(taxa: DataFrame, lines: DataFrame, tips: DataFrame, lengths: str = "unit") -> DataFrame:
    """``edges`` of the taxa on the lineages of ``tips`` (tax_id), labelled by tax_id; branches are 1 long, or 1 / (rank + 1) for "inverse".

    Taxa are the taxonomy's, so the tree is made on the driver.  More than one root is an error.
    """
    from ..plans.tree import Node, edges_frame, number

    if lengths not in ("unit", "inverse"):
        raise ValueError(f"lengths are unit or inverse, not {lengths}")
    used = tips.select("tax_id").distinct().join(lines.select("tax_id", "anc_tax_id", "rank_order"), "tax_id").select(F.col("anc_tax_id").alias("tax_id"), "rank_order").distinct()
    rows = used.join(taxa.select("tax_id", "parent_id"), "tax_id").orderBy("tax_id").collect()  # a row a taxon
    nodes = {r.tax_id: Node(r.tax_id, 1.0 if lengths == "unit" else 1.0 / (r.rank_order + 1)) for r in rows}
    roots = [r.tax_id for r in rows if r.parent_id not in nodes or r.parent_id == r.tax_id]
    if len(roots) != 1:
        raise ValueError(f"the taxonomy has {len(roots)} roots: {roots[:3]}")
    for r in rows:
        if r.tax_id != roots[0]:
            nodes[r.parent_id].children.append(nodes[r.tax_id])
    return edges_frame(taxa.sparkSession, number(nodes[roots[0]]))


def tax_mass(placements: DataFrame, tree: DataFrame, *, point: bool = False, weight: str = "ml_ratio") -> DataFrame:
    """Mass units on a taxonomic tree: a placement's weight at its taxon, or at the root without one, over the sample's sum of weights.

    Queries weigh by the sum of their weights, not alike.  A taxon that the tree lacks is an error.
    """
    from ..plans.profile import ranked

    own = ranked(placements, weight)
    if point:
        own = own.where("rank_in_pq = 1")
    at = tree.select(F.col("label").alias("_t"), F.col("id").alias("_id"))
    root = tree.where("parent_id IS NULL").select(F.col("id").alias("_root"))
    placed = own.drop("loc").join(F.broadcast(root)).join(at, F.col("classification") == F.col("_t"), "left")  # one row; a row a taxon
    loc = F.when(F.col("classification").isNull(), F.col("_root")).when(F.col("_id").isNotNull(), F.col("_id")).otherwise(F.raise_error(F.concat(F.lit("not in the tree: "), F.col("classification"))).cast("int"))
    totals = own.groupBy("sample").agg(F.sum(weight).alias("_total")).withColumnRenamed("sample", "_sample")
    return placed.join(totals, F.col("sample") == F.col("_sample")).select("sample", "pq_id", loc.alias("loc"), F.lit(0.0).alias("pos"), F.lit(0.0).alias("pend"), "rank_in_pq", (F.col(weight) / F.col("_total")).alias("m"))


def infer_taxa(placements: DataFrame, leaf_taxa: DataFrame, edges: DataFrame, lines: DataFrame, keep: float = 0.01) -> DataFrame:
    """(name, tax_id): for untagged sequences the deepest common taxon of the tagged leaves below their placements.

    placements: (name, loc, ml_ratio), those of at least ``keep``; leaf_taxa: (id, tax_id).  An edge
    without tagged leaves below it counts with those of its nearest ancestor that has some.
    """
    tagged = leaf_taxa.where("tax_id IS NOT NULL")
    under = tagged.join(edges.select("id", F.explode("path").alias("edge")), "id").select("edge", "tax_id").distinct()
    has = under.select("edge").distinct()
    up = edges.select(F.col("id").alias("loc"), F.posexplode("path").alias("_k", "edge")).join(has, "edge")
    nearest = up.groupBy("loc").agg(F.min_by("edge", "_k").alias("edge"))
    own = placements.where(F.col("ml_ratio") >= keep).select("name", "loc").join(nearest, "loc").join(under, "edge").select("name", "tax_id")
    return common_ancestor(own, lines, "name")


def suspects(distances: DataFrame, seqinfo: DataFrame, factor: float = 1.0) -> DataFrame:
    """(seqname, tax_id, median_new, median_old): placed-again sequences that lie farther from their taxon than it is wide.

    distances: (seqname, other, distance) between leaves of one taxon, after and before
    (``is_new``); a sequence is named if its new median exceeds ``factor`` times the old one.
    """
    own = distances.join(seqinfo.select("seqname", "tax_id"), "seqname")
    half = F.lit(0.5)
    both = own.groupBy("seqname", "tax_id").agg(F.percentile(F.when(F.col("is_new"), F.col("distance")), half).alias("median_new"), F.percentile(F.when(~F.col("is_new"), F.col("distance")), half).alias("median_old"))
    return both.where(F.col("median_new") > factor * F.col("median_old"))
