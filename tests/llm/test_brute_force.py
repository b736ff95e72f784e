"""Operators and pipeline stages that SQL cannot state, against plain versions row by row."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


COMPRESSORS, LENGTHS = {}, {}


def plain_length(raw, window):
    """The length of one window with a dictionary, compressed alone."""
    import zstandard

    if raw not in COMPRESSORS:
        params = zstandard.ZstdCompressionParameters.from_level(19, source_size=48, dict_size=len(raw), min_match=3, write_checksum=0, write_content_size=0, write_dict_id=0)
        COMPRESSORS[raw] = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, compression_params=params)
    if (raw, window) not in LENGTHS:
        LENGTHS[raw, window] = len(COMPRESSORS[raw].compress(b"~" * 8 + window + b" "))
    return LENGTHS[raw, window]


def plain_score(model, text):
    """A text's toxicity, window by window."""
    words = re.findall(rb"[a-z\x80-\xff]+", lowered(text).encode())
    windows = [w[k : k + 48] for w in words for k in range(0, len(w), 48)]
    if not windows:
        x = [0.0] * 7
    else:
        d = [plain_length(model.ordinary, w) - plain_length(model.toxic, w) for w in windows]
        whole = sum(math.exp(2 * v) for v in d)
        x = [max(d), math.log(whole), math.log(whole / len(d)), *[math.log1p(sum(v >= m for v in d)) for m in (3, 5, 7)], math.log(len(d))]
    z = model.weights[0] + sum(a * b for a, b in zip(x, model.weights[1:], strict=True))
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def test_toxicity_scores(spark, sf_dir):
    from sylva.llm.queries import QUERIES, toxicity_model

    model = toxicity_model(spark, sf_dir)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for k in sorted(texts)[:60]:
        assert abs(got[k].score - plain_score(model, texts[k])) < 1e-9
    for k, r in got.items():
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2)


@pytest.fixture(scope="module")
def repeated(spark):
    """Rows that share ids: with equal and with different texts, without id, without text."""
    draw = random.Random(21)
    pool = [" ".join(draw.choice("ab cd ef gh ij kl secret=abcdef12 general public license all rights reserved".split()) for _ in range(draw.randint(0, 40))) for _ in range(25)]
    rows = [(draw.choice([1, 2, 3, 4, None]), draw.choice([*pool, None]), draw.choice(["s", "t", None])) for _ in range(150)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_rows_that_share_ids(spark, repeated):
    from tokenizers import Tokenizer

    from sylva.llm.licenses import find_notices
    from sylva.llm.mixing import mix_sources
    from sylva.llm.packing import cut_pieces, pack
    from sylva.llm.secrets import find_secrets
    from sylva.llm.token_scan import token_counts
    from sylva.llm.toxicity import fit, score_documents

    rows, df = repeated
    tool = Tokenizer.from_file(VOCABULARY)
    ids = {t: tool.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows}
    count = lambda pairs: Counter(map(repr, pairs))
    assert count((r.doc_id, r.n_tokens) for r in token_counts(df, VOCABULARY, 50256).collect()) == count((k, len(ids[t])) for k, t, _ in rows)
    pieces = cut_pieces(df, VOCABULARY, 0, 16)
    crc = lambda own: zlib.crc32(np.array(own, "<u4").tobytes())
    want = []
    for k, t, _ in rows:
        own = [*ids[t], 0]
        first = len(own) - (-(-len(own) // 16) - 1) * 16
        cuts = [0, *range(first, len(own) + 1, 16)]
        want += [(k, i, a, b - a, crc(own[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    packed = pack(pieces, 16, group_rows=60).collect()
    assert count((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == count(want)
    assert count((r.doc_id, r.n_words) for r in find_notices(df).collect()) == count((k, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t)))) for k, t, _ in rows)
    assert count((r.doc_id, len(r["_spans"])) for r in find_secrets(df).collect()) == count((k, len(re.findall("secret=abcdef12", t or ""))) for k, t, _ in rows)
    model = fit([(t, int("secret" in t)) for _, t, _ in rows if t])
    assert count(r.doc_id for r in score_documents(df, model).collect()) == count(k for k, _, _ in rows)
    mixed = mix_sources(df).collect()
    assert count((r.doc_id, r.source, r["size"]) for r in mixed) == count((k, s, len(SPACE.findall(t or ""))) for k, t, s in rows)
    for s in ("s", "t", None):
        own = [r for r in mixed if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 40 and all(r.taken <= 3 * r["size"] for r in own)


def test_pipeline_stages_against_plain_versions(spark, sf_dir):
    import corpus_pipeline as C
    from sylva.llm.queries import toxicity_model
    from sylva.llm.secrets import BASE, MORE
    from sylva.llm.shared import persist

    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    before = docs
    for name, stage in C.STAGES:
        seen[name] = (before, persist(stage(spark, before, sf_dir), name))
        before = seen[name][1]
    rows = lambda df: [tuple(r) for r in df.collect()]
    # toxicity: those below the cutoff, unchanged
    model = toxicity_model(spark, sf_dir)
    given, kept = (rows(df) for df in seen["toxicity"])
    assert sorted(kept, key=repr) == sorted((r for r in given if plain_score(model, r[1]) < 0.3), key=repr)
    # near-duplicates: the least id of each component
    given, kept = (rows(df) for df in seen["near_duplicates"])
    sets, root = {}, {r[0]: r[0] for r in given}
    for r in given:
        w = SPACE.findall(lowered(r[1]))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = defaultdict(list)
    for k, own in sets.items():
        for s in own:
            by_shingle[s].append(k)
    near = {(a, b) for own in by_shingle.values() for i, a in enumerate(own) for b in own[:i]}
    for a, b in near:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert sorted(kept, key=repr) == sorted((r for r in given if find(r[0]) == r[0]), key=repr)
    # secrets: every stretch that a rule's kept matches cover, blotted out
    given, kept = (rows(df) for df in seen["secrets"])
    want = []
    for r in given:
        text, spans = r[1], []
        for rule in BASE + MORE:
            spans += [(m.start(), m.end()) for m in re.finditer(rule.pattern, text or "", re.A) if len(m[rule.group]) >= rule.least]
        out, at = "", 0
        for a, b in sorted(spans):
            if b > at and (a > at or at == 0):
                out += text[at:a] + "<secret>"
            at = max(at, b)
        want.append((r[0], out + text[at:], *r[2:4], len(out + text[at:])) if spans else r)
    assert sorted(kept, key=repr) == sorted(want, key=repr)
    # mix: whole documents, at most three times, each source near its target
    given, kept = (rows(df) for df in seen["mix"])
    size = {r: len(SPACE.findall(r[1] or "")) for r in given}
    assert max(Counter(kept).values()) <= 3 and set(kept) <= {r for r in given if size[r]}
    total, by_source = defaultdict(int), defaultdict(int)
    for r in given:
        total[r[3]] += size[r]
    for r in kept:
        by_source[r[3]] += size[r]
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(total.values()))
    while True:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * total[s]}
        if not full:
            break
        for s in full:
            target[s], rest = 3 * total[s], rest - 3 * total[s]
        free -= full
    target |= {s: level * weight[s] for s in free}
    longest = max(size.values())
    assert all(abs(by_source[s] - target[s]) <= longest for s in order)
    # packing: every token once, in order; hardly more sequences than tokens need
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(VOCABULARY)
    given, packed = seen["packing"][0].collect(), seen["packing"][1].collect()
    crc = lambda own: zlib.crc32(np.array(own, "<u4").tobytes())
    want = Counter()
    for r in given:
        own = [*tool.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = len(own) - (-(-len(own) // 2048) - 1) * 2048
        cuts = [0, *range(first, len(own) + 1, 2048)]
        want.update((r.doc_id, i, a, b - a, crc(own[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1.01 * sum(r.length for r in packed) / 2048 + 2


def test_nulls_everywhere(spark):
    """A table of nulls only, and columns that clash with the operators' own."""
    from sylva.llm import queries as Q
    from sylva.llm.licenses import find_notices
    from sylva.llm.mixing import mix_sources
    from sylva.llm.ngram_join import jaccard_components
    from sylva.llm.secrets import find_secrets

    own = "doc_id long, text string, source string, row long, mark long, bitmap string, _text string, _id long, size string, class string, target string, _rules long, bucket long, places string"
    df = spark.createDataFrame([(None,) * 14] * 3, own)
    assert [r.places for r in find_notices(df).collect()] == [[]] * 3
    assert [tuple(r) for r in jaccard_components(df).collect()] == [(None, 0, None)] * 3
    assert [r["_spans"] for r in find_secrets(df).collect()] == [[]] * 3
    assert [(r["size"], r.taken) for r in mix_sources(df).collect()] == [(0, 0)] * 3
    assert F.col("x") is not None and Q.QUERIES.keys() >= {"op1_pareto_mix"}
