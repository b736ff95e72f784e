"""The contract queries and the pipeline over the smallest tables."""

import math
import re
from collections import defaultdict

import duckdb
import pytest

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op1_pareto_mix", "op4_embedding_dedup", "op6_exact_top_k", "op7_ngram_jaccard", "op10_secret_scan"])
def test_against_sql(spark, duck, sf_dir, name):
    from sylva.llm.queries import ORACLES, QUERIES

    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    answer = duck.sql(ORACLES[name])
    want = sorted(tuple(dict(zip(answer.columns, r, strict=True))[c] for c in columns) for r in answer.fetchall())
    assert [tuple(round(v, 6) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in got] == [tuple(round(v, 6) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in want]


@pytest.mark.parametrize(("name", "columns"), [("op2_token_counts", "doc_id n_tokens"), ("op3_token_codes", "doc_id start n_tokens ids_crc32"), ("op5_license_scan", "doc_id n_words n_base first_word last_word base_labels labels score spans"), ("op8_toxicity", "doc_id held_out score predicted"), ("op9_best_fit_packing", "doc_id piece start length ids_crc32 sequence_id offset")])
def test_columns(spark, sf_dir, name, columns):
    from sylva.llm.queries import QUERIES

    df = QUERIES[name](spark, sf_dir)
    assert df.columns == columns.split()
    assert df.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as C
    from sylva.llm.secrets import BASE
    from sylva.llm.shared import persist

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in C.STAGES:
        docs = persist(stage(spark, docs, sf_dir), name)
        seen[name] = docs
    assert all(seen[n].columns == list(C.COLUMNS) for n in ("toxicity", "near_duplicates", "secrets", "mix"))
    kept = {r.doc_id: r.text for r in seen["near_duplicates"].collect()}
    assert len(set(kept.values())) == len(kept) == seen["secrets"].count()
    for r in seen["secrets"].collect():
        for rule in BASE:
            assert all(len(m[rule.group]) < rule.least for m in re.finditer(rule.pattern, r.text, re.A))
    copies = defaultdict(int)
    for r in seen["mix"].collect():
        copies[r.doc_id] += 1
    assert copies.keys() <= kept.keys() and max(copies.values()) <= 3
    assert seen["packing"].select("doc_id").distinct().count() == len(copies)


def test_stages_with_odd_rows(spark, sf_dir):
    import corpus_pipeline as C

    text = "one two three four five six seven eight"
    rows = [(1, text, "en", "a", 39), (2, text, None, None, None), (None, text, "en", "a", 1), (3, None, "en", None, 0), (4, "", "en", "b", 0), (5, "password=hunter2x " * 3, "en", "b", 54), (5, "another text of this id", "en", "b", 23), (6, "w " * 40_000, None, "a", 80_000)]
    odd = spark.createDataFrame([(*r, 0, "x", 0.5, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _row int, _text string, score double, copies int").repartition(3)
    out = {name: stage(spark, odd, sf_dir).collect() for name, stage in C.STAGES}
    assert len(out["toxicity"]) <= len(rows) and {r.doc_id for r in out["toxicity"]} <= {r[0] for r in rows}
    kept = sorted((repr(r.doc_id), (r.text or "")[:5]) for r in out["near_duplicates"])
    # the copy with an id goes; rows without id or words, and both texts of id 5, stay
    assert kept == sorted((repr(r[0]), (r[1] or "")[:5]) for r in rows if r[0] != 2)
    clean = {(r.doc_id, r.n_chars): r.text for r in out["secrets"]}
    assert len(out["secrets"]) == len(rows) and clean[(3, 0)] is None and clean[(5, 27)] == "<secret> " * 3
    assert {r.doc_id for r in out["mix"]} <= {1, 2, None, 5, 6} and all(r.text for r in out["mix"])
    assert len({(r.doc_id, r.piece, r.ids_crc32) for r in out["packing"]}) >= len({r[0] for r in rows})
    empty = spark.createDataFrame([], odd.schema)
    assert [len(stage(spark, empty, sf_dir).collect()) for _, stage in C.STAGES] == [0] * 5
