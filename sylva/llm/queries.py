"""Queries of the training-data operators: whole tables in, contract digests out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .oracles import ORACLES  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens of every document, counted in flat token files by the separator scan."""
    from .token_scan import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary(), 50256).select("doc_id", "n_tokens")


def op3_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as directly addressable codes and read back."""
    from .codes import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary(), 2)


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all sources at weights 1, 2, 3, ... takes of each document."""
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), (1, 2, 3), 3).select("doc_id", "size", "source_size", "target", "taken")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors at a cosine of 0.95."""
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document, exact and with few edits."""
    from .licenses import certainty, find_notices, labels_of, place_text

    found = find_notices(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels_of(base).alias("base_labels"),
        labels_of(F.col("places")).alias("labels"),
        certainty(F.col("places")).alias("score"),
        place_text(F.col("places")).alias("spans"),
    )


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every vector whose id is divisible by 20."""
    from .topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles reach a Jaccard similarity of 0.75."""
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2


def toxicity_model(spark: SparkSession, sf_dir: str):
    """A model of labelled documents that are not held out."""
    from .toxicity import fit_rows, labelled_rows

    return fit_rows(labelled_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out()))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by compression distance."""
    from .toxicity import score_documents

    scored = score_documents(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), 0, 2048)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of whole texts: counts and spans of the base kinds, and all spans."""
    from .secrets import BASE, find_secrets, span_text

    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("_spans", lambda x: x["order"] < len(BASE))
    count = lambda kind: F.size(F.filter("_spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.encode(span_text(base), "UTF-8"), 256).alias("base_sha256"),
        span_text(F.col("_spans")).alias("spans"),
    )


QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_token_counts": op2_token_counts,
    "op3_token_codes": op3_token_codes,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_toxicity": op8_toxicity,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_secret_scan": op10_secret_scan,
}
