"""Sequences, taxonomies and reference packages."""

from __future__ import annotations

import json
import os
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): the first word of each header, the sequence without white space, upper case."""
    blocks = spark.read.option("lineSep", ">").text(path).where("length(trim(value)) > 0")
    name = F.regexp_extract("value", r"^\s*(\S+)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", ""))
    return blocks.select(name.alias("name"), seq.alias("seq"))


def write_fasta(sequences: DataFrame, path: str) -> None:
    sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(path)


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of a possibly interleaved alignment: pieces of a name in the order of lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("k", "line"))
    rows = lines.where(F.rlike("line", F.lit(r"^[^#/\s]\S*\s+\S"))).select("k", F.split(F.trim("line"), r"\s+").alias("x"))
    return rows.select("k", F.col("x")[0].alias("name"), F.col("x")[1].alias("piece")).groupBy("name").agg(F.upper(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda v: v["piece"]), "")).alias("seq"))


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    bare = path.removesuffix(".gz")
    if bare.endswith((".fasta", ".fa")):
        return read_fasta(spark, path)
    if bare.endswith((".sth", ".sto", ".stockholm")):
        return read_stockholm(spark, path)
    raise ValueError(f"unknown suffix: {os.path.basename(path)}")


def write_phylip(rows: list[tuple[str, str]], path: str) -> None:
    """A relaxed PHYLIP file of a (bounded) alignment."""
    if len({len(s) for _, s in rows}) > 1:
        raise ValueError("sequences differ in length")
    with open(path, "w") as out:
        out.write(f"{len(rows)} {len(rows[0][1]) if rows else 0}\n" + "".join(f"{n} {s}\n" for n, s in rows))


def read_taxonomy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(taxa, ranks) of a taxonomy table: tax_id, parent_id, rank, tax_name, then a column a rank, coarsest first; blank and NA are null.

    A taxon with two parents or ranks is an error.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue=None)
    names = raw.columns[4:]
    clean = raw.select(*[F.when(F.trim(c).isin("", "NA"), None).otherwise(F.trim(c)).alias(c) for c in raw.columns])
    doubled = clean.groupBy("tax_id").agg(F.count_distinct("parent_id").alias("p"), F.count_distinct("rank").alias("r")).where("p > 1 OR r > 1")
    if not doubled.isEmpty():
        raise ValueError("a taxon with two parents or ranks")
    taxa = clean.select("tax_id", F.when(F.col("parent_id") == F.col("tax_id"), None).otherwise(F.col("parent_id")).alias("parent_id"), "rank", "tax_name").dropDuplicates(["tax_id"])
    return taxa, spark.createDataFrame([(n, k) for k, n in enumerate(names)], "rank string, rank_order int")


def read_seqinfo(spark: SparkSession, path: str) -> DataFrame:
    """(seqname, tax_id, accession); the first two columns must be there."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    for c in ("seqname", "tax_id"):
        if c not in raw.columns:
            raise ValueError(f"no column {c}")
    clean = lambda c: F.when(F.trim(c).isin("", "NA"), None).otherwise(F.trim(c)).alias(c)
    return raw.select("seqname", clean("tax_id"), clean("accession") if "accession" in raw.columns else F.lit(None).cast("string").alias("accession"))


class ReferencePackage:
    """A folder or zip file with CONTENTS.json: a map of roles to files, format 1.1."""

    def __init__(self, path: str, unpack_to: str | None = None):
        if path.endswith(".zip"):
            if unpack_to is None:
                raise ValueError("a zip file needs a folder to unpack to")
            with zipfile.ZipFile(path) as z:
                z.extractall(unpack_to)
            inner = [d for d, _, files in os.walk(unpack_to) if "CONTENTS.json" in files]
            path = inner[0]
        with open(os.path.join(path, "CONTENTS.json")) as f:
            self.contents = json.load(f)
        version = self.contents.get("metadata", {}).get("format_version")
        if version != "1.1":
            raise ValueError(f"format {version} is not 1.1")
        self.path = path

    def file(self, role: str) -> str:
        return os.path.join(self.path, self.contents["files"][role])

    def has(self, role: str) -> bool:
        return role in self.contents["files"]

    def tree(self):
        from ..plans.tree import parse_newick

        with open(self.file("tree")) as f:
            return parse_newick(f.read())

    def taxonomy(self, spark: SparkSession):
        return read_taxonomy(spark, self.file("taxonomy"))

    def seqinfo(self, spark: SparkSession) -> DataFrame:
        return read_seqinfo(spark, self.file("seq_info"))

    def alignment(self, spark: SparkSession) -> DataFrame:
        return read_alignment(spark, self.file("aln_fasta" if self.has("aln_fasta") else "aln_sto"))

    def model(self) -> dict:
        with open(self.file("phylo_model")) as f:
            return json.load(f)

    def check(self, spark: SparkSession) -> list[str]:
        """What is wrong: leaves and aligned sequences that do not match, taxa that the taxonomy lacks."""
        problems, leaves = [], {n.label for n in self.tree().leaves()}
        if self.has("aln_fasta") or self.has("aln_sto"):
            names = {r[0] for r in self.alignment(spark).select("name").collect()}
            problems += [f"not in the alignment: {x}" for x in sorted(leaves - names)] + [f"not in the tree: {x}" for x in sorted(names - leaves)]
        if self.has("taxonomy") and self.has("seq_info"):
            taxa, _ = self.taxonomy(spark)
            info = self.seqinfo(spark)
            problems += [f"unknown taxon: {r[0]}" for r in info.where("tax_id IS NOT NULL").join(taxa, "tax_id", "left_anti").select("tax_id").distinct().collect()]
            known = {r[0] for r in info.select("seqname").collect()}
            problems += [f"no sequence information: {x}" for x in sorted(leaves - known)]
        return problems


def parse_stats(text: str) -> dict:
    """Model parameters of a tree program's report: datatype, model, gamma shape and categories, base frequencies and GTR rates."""
    number = r"([-\d.eE+]+)"
    found: dict = {}
    if m := re.search(r"(?:Model of (?:nucleotides|amino acids) substitution|Substitution Matrix)\s*:\s*(\w+)", text):
        found["subs_model"] = m[1]
    found["datatype"] = "DNA" if re.search(r"nucleotides|DataType: DNA|GTR", text) else "AA"
    if m := re.search(rf"(?:Gamma shape parameter|alpha(?:\[0\])?)\s*:\s*{number}", text):
        found["alpha"] = float(m[1])
    if m := re.search(r"Number of (?:categories|classes)\s*:\s*(\d+)", text):
        found["n_cat"] = int(m[1])
    if len(f := re.findall(rf"f\(\s*[ACGT]\s*\)\s*=\s*{number}", text)) == 4:
        found["frequencies"] = [float(x) for x in f]
    rates = re.findall(rf"([ACGT])\s*<->\s*([ACGT])[\s:]+{number}", text)
    if rates:
        found["subs_rates"] = {f"{a}{b}".lower(): float(x) for a, b, x in rates}
    elif m := re.search(rf"rates\[0\] ac ag at cg ct gt: {' '.join([number] * 6)}", text):
        found["subs_rates"] = dict(zip(("ac", "ag", "at", "cg", "ct", "gt"), map(float, m.groups()), strict=True))
    return found


def read_pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table without header: leaf values, split maps, specimens, colours, deduplication maps."""
    return spark.read.csv(path, schema=schema)
