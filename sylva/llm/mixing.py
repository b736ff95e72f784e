"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Within a source a document's expected copies are in proportion to its size class (powers of two)
to a given power, at the rate at which the source's words come to its target while no document
exceeds the limit.  Whole copies are certain; the fraction is an inclusion probability p, which so
differs from class to class.  Documents are ranked by their random odds u/(1-u) over their
inclusion odds p/(1-p), and those at the head of the order get one copy more as long as the
source's target holds them: a sample of fixed size, in words.  The last draw is the document that
comes nearest to the rest.

No source is gathered in one task: the rank is cut into cells (their number follows the source's
number of documents), words are summed by cell before any shuffle, only the cells' sums are
ordered within a source, and only the documents of the one cell in which the target falls are
ordered singly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import persist

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a cell of the rank, about.
CELL_DOCS = 512
#: Copies of a source's row in its join with documents, so that a hot source meets many tasks.
SALTS = 32
#: Power of the size class that expected copies are in proportion to.
POWER = 0.5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys only: 52 bits of their MD5."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: Sequence[float], limit: float, share: float = 1.0) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, source_size, n_docs).

    Weights repeat over the sources in order of code point, null last; targets share ``share`` of
    all sizes.  A target stops at ``limit`` times its source's size and the excess goes to the
    others by weight: that is min(limit * size, level * weight), the level found from one running
    sum over the sources in order of limit * size / weight.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    whole = W.partitionBy()
    by_stop = W.orderBy("_stop", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(W.unboundedPreceding, -1)
    priced = (
        sizes.withColumn("_w", weight)
        .withColumn("_stop", F.col("source_size") * F.lit(float(limit)) / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("_all_w", F.sum("_w").over(whole))
        .withColumn("_stopped", F.coalesce(F.sum(F.col("source_size") * F.lit(float(limit))).over(by_stop), F.lit(0.0)))
        .withColumn("_stopped_w", F.coalesce(F.sum("_w").over(by_stop), F.lit(0.0)))
        # the level if all sources before this one stop and the rest do not
        .withColumn("_level", (F.col("_total") - F.col("_stopped")) / (F.col("_all_w") - F.col("_stopped_w")))
    )
    level = F.max(F.when(F.col("_level") <= F.col("_stop"), F.col("_level"))).over(whole)  # the first such source's
    target = F.least(F.col("source_size") * F.lit(float(limit)), F.coalesce(level * F.col("_w"), F.col("source_size") * F.lit(float(limit))))
    return priced.select("source", "source_size", "n_docs", target.alias("target"))


def copy_rates(classes: DataFrame, limit: float) -> DataFrame:
    """(source, class, expected) from (source, class, n, words, target): the copies that each document of a size class is due.

    That is min(limit, rate * measure), the rate of a source found from one running sum over its
    classes, of which there are at most 64, in the order in which they come to the limit.
    """
    each = W.partitionBy("source")
    before = each.orderBy("_stop").rowsBetween(W.unboundedPreceding, -1)
    stop = F.lit(float(limit))
    priced = (
        classes.withColumn("_stop", stop / F.col("measure"))
        .withColumn("_stopped", F.coalesce(F.sum(F.col("words") * stop).over(before), F.lit(0.0)))
        .withColumn("_left", F.sum(F.col("words") * F.col("measure")).over(each) - F.coalesce(F.sum(F.col("words") * F.col("measure")).over(before), F.lit(0.0)))
        # the rate if all classes before this one are at the limit and the rest are not
        .withColumn("_rate", (F.col("target") - F.col("_stopped")) / F.nullif(F.col("_left"), F.lit(0.0)))
    )
    rate = F.max(F.when(F.col("_rate") <= F.col("_stop"), F.col("_rate"))).over(each)
    return priced.select("source", "class", F.least(F.coalesce(rate, F.max("_stop").over(each)) * F.col("measure"), stop).alias("expected"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), limit: int = 3, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", power: float = POWER, seed: str = "mix", size: Column | None = None) -> DataFrame:
    """How many copies of each document the mix takes: doc_id, source, size, source_size, target, copies, taken.

    size: words of the whole text (null: 0) unless given.  power: expected copies within a source
    are in proportion to the size's power of two to this power (0: alike).  A document is taken
    whole 0 to ``limit`` times.  Documents of size 0 take none.  Null sources are one source; rows
    without an id draw their random number by their text; repeated ids and rows are rows like any
    other, those of one id sharing their random number (ties: the larger size first).  An empty
    table gives no rows.  Further columns are not read.
    """
    number = F.coalesce(F.col(id_column).cast("string"), F.md5(F.coalesce(F.col(text_column), F.lit(""))))
    picked = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).cast("string").alias("source"),
        (word_count(F.col(text_column)) if size is None else F.coalesce(size.cast("long"), F.lit(0))).alias("size"),
        uniform(F.lit(seed), number).alias("_u"),
    ).withColumn("class", F.greatest(F.length(F.bin("size")) - 1, F.lit(0)))
    picked = persist(picked, "sizes")  # texts are read once
    classes = persist(picked.groupBy("source", "class").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "classes")
    sums = classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs"))
    targets = persist(source_targets(sums, weights, limit).withColumnRenamed("source", "_source"), "targets")
    measured = classes.withColumn("measure", F.pow(F.lit(2.0), F.col("class") * F.lit(float(power))))
    measured = measured.join(targets.select("_source", "target"), F.col("source").eqNullSafe(F.col("_source"))).select("source", "class", "words", "measure", "target")
    rates = copy_rates(measured, limit).select(F.col("source").alias("_s"), F.col("class").alias("_class"), "expected")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    priced = targets.join(rates, F.col("_source").eqNullSafe(F.col("_s"))).select("_source", "_class", "source_size", "target", "expected", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / CELL_DOCS)).alias("_cells"), salts.alias("_salt2"))
    salted = picked.withColumn("_salt", F.pmod(F.floor(F.col("_u") * 1e6), F.lit(SALTS)).cast("int"))
    due = salted.join(priced, F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class")) & (F.col("_salt") == F.col("_salt2"))).drop("_source", "_class", "_salt2", "_salt")
    sure = F.when(F.col("size") > 0, F.floor("expected")).otherwise(0).cast("long")
    p = F.least(F.greatest(F.col("expected") - sure, F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (p / (1 - p))
    ranked = due.withColumn("_sure", sure).withColumn("_q", odds).withColumn("_open", (F.col("size") > 0) & (F.col("_sure") < limit))
    # q / (1 + q) keeps the order of q; the target falls near q = 1, whatever the odds are
    ranked = ranked.withColumn("_cell", F.least(F.floor(F.col("_q") / (1 + F.col("_q")) * F.col("_cells")), F.col("_cells") - 1).cast("long"))
    cells = ranked.groupBy("source", "_cell").agg(F.sum(F.col("_sure") * F.col("size")).alias("_sure_words"), F.sum(F.when(F.col("_open"), F.col("size")).otherwise(0)).alias("_words"), F.max("target").alias("target"))
    each = W.partitionBy("source")
    placed = cells.select(
        F.col("source").alias("_source"), F.col("_cell").alias("_c"), "_words",
        (F.col("target") - F.sum("_sure_words").over(each)).alias("_need"),
        (F.sum("_words").over(each.orderBy("_cell")) - F.col("_words")).alias("_before"),
    )
    placed = placed.withColumn("_salt2", salts)
    known = ranked.withColumn("_salt", F.pmod(F.floor(F.col("_u") * 1e6), F.lit(SALTS)).cast("int")).join(
        placed, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_cell") == F.col("_c")) & (F.col("_salt") == F.col("_salt2"))
    )
    inside = F.col("_before") + F.col("_words") <= F.col("_need")
    beyond = F.col("_before") + 0.5 >= F.col("_need")  # no document is nearer to less than half a word than none
    whole_cells = known.where(inside | beyond | ~F.col("_open")).withColumn("_extra", F.when(F.col("_open") & inside & ~beyond, 1).otherwise(0))
    # the cell that the target falls in: its head as far as it fits, then the one document that comes nearest to what is missing
    cell = W.partitionBy("source", "_cell")
    in_order = cell.orderBy("_q", "doc_id", F.col("size").desc())
    split = known.where(~(inside | beyond) & F.col("_open")).withColumn("_k", F.row_number().over(in_order)).withColumn("_run", F.col("_before") + F.sum("size").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    fits = F.col("_run") <= F.col("_need")
    split = split.withColumn("_gap", F.col("_need") - F.coalesce(F.max(F.when(fits, F.col("_run"))).over(cell), F.col("_before")))
    off = F.abs(F.col("_gap") - F.col("size"))
    split = split.withColumn("_last", F.min(F.when(~fits & (off < F.col("_gap")), F.struct(off.alias("off"), F.col("_k").alias("k")))).over(cell))
    split = split.withColumn("_extra", F.when(fits | F.coalesce(F.col("_last.k") == F.col("_k"), F.lit(False)), 1).otherwise(0))
    columns = ["doc_id", "source", "size", "source_size", "target", (F.col("_sure") + F.col("_extra")).alias("copies"), ((F.col("_sure") + F.col("_extra")) * F.col("size")).alias("taken")]
    return whole_cells.select(*columns).unionByName(split.select(*columns))
