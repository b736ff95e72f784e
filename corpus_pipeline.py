"""A corpus pipeline of the training-data operators: documents in, packed sequences out.

Toxic documents go; of each group of near-duplicates one document stays; secrets are blotted out
in the text; sources are mixed to target weights; what is left is packed into sequences.  Each
stage takes all that its predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sylva.llm.mixing import mix_sources
from sylva.llm.ngram_join import jaccard_components
from sylva.llm.packing import pack_documents
from sylva.llm.queries import toxicity_model, vocabulary
from sylva.llm.secrets import find_secrets, redact
from sylva.llm.shared import passing, persist
from sylva.llm.toxicity import score_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.3, the cutoff of op8; the model learns from labels that are not held out.

    Nulls and empty texts are scored as texts without words; repeated rows are judged alike.
    """
    scored = score_documents(docs.select(*COLUMNS), toxicity_model(spark, sf_dir), keep=COLUMNS[1:])
    return scored.where("score < 0.3").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a 5-gram Jaccard similarity of 0.75 the one with the least id; all without words or id stay.

    Rows are told apart by a number, not by their id: of rows that repeat an id with the same text
    one stays, and one whose text is linked with no other stays whatever other rows of its id do.
    """
    # a number for each row, written down, so that rows of one id are told apart
    rows = persist(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    with passing(spark):
        groups = jaccard_components(rows, id_column="_row").where("n_shingles > 0").select(F.col("doc_id").alias("_row"), "component_id")
        named = persist(rows.where("doc_id IS NOT NULL").select("_row", "doc_id").join(groups, "_row"), "grouped")
        best = persist(named.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("best")), "best")
        gone = persist(named.join(best, "component_id").where(F.col("_row") != F.col("best._row")).select("_row"), "gone", keep=True)
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each secret in its text replaced by ``<secret>`` (n_chars follows); null texts stay null."""
    found = find_secrets(docs, keep=COLUMNS[1:])
    clean = found.select("doc_id", redact(F.col("text"), F.col("_spans")).alias("text"), "lang", "source", "n_chars", (F.size("_spans") > 0).alias("_hit"))
    return clean.select("doc_id", "text", "lang", "source", F.when(F.col("_hit"), F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix at weights 1, 2, 3, ... takes it (0 to 3 times).

    Within a source all documents are due the same copies, long or short.  Documents without words belong to no mix and go; null sources are one source.
    """
    # a number for each row, written down, so that rows of one id keep their own copies
    rows = persist(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "mix")
    taken = mix_sources(rows, (1, 2, 3), 3, id_column="_row", seed="pipeline", power=0.0).where("copies > 0").select(F.col("doc_id").alias("_row"), "copies")
    return rows.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Rows that repeat an id (the mix copies documents) are packed each; null texts are empty ones;
    null ids are kept; an empty table gives no rows.
    """
    return pack_documents(docs, vocabulary(), 0, 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_copies),
    ("secrets", blot_secrets),
    ("mix", mix),
    ("packing", pack),
]
#: Trained dictionaries, a tokenizer and a connected-components loop are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with passing(spark):  # what a stage wrote down on the way goes
            docs = persist(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
