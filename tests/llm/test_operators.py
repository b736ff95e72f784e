"""The ten operators on small fixtures: brute-force versions, nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, _row int, _text string, size int, score double"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    words = ["the", "General", "public", "license", "it's", "été", "日本語", "x1", "--", "secret=abcdef1", "AKIA" + "A" * 16, "0" * 30, "token:", "all", "rights", "reserved.", "cc", "BY", "\n", "\t ", "é,"]
    base = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 60))) for _ in range(60)]
    base += [base[3], base[3] + " more", base[3] + " words here", base[5], "", "  ", "word", "a b c d", "a b c d", " ".join(f"w{k}" for k in range(30_000)), "x" * 90_000]
    out = [(k, t, f"s{k % 4}" if k % 7 else None, 1, "t", 2, 0.5) for k, t in enumerate(base)]
    return [*out, (900, None, "s1", 1, "t", 2, 0.5), (None, "a text without an id here now", "s2", 1, "t", 2, 0.5), (901, base[3], None, 1, "t", 2, 0.5)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_bulk_encoder_equals_the_library(ids):
    import pyarrow as pa

    from sylva.llm.tokens import Encoder

    odd = ["", " ", "  a  b ", "x　y\n z", "it's  'tis  q", "é  è à ", "a" * 500 + " b", "<|endoftext|> x <|endoftext|>", "tab\t x", "\n\n\n", "日本 語 テ", "1 2  3", "a \u0085 b  c", "\u0085 a  b", "a.\nB,'s\n\nC", "we'll,'ll !!x", "é, è. ’, a’s", None]
    tool = Encoder(VOCABULARY)
    for _ in range(2):
        for _, _, found, counts in tool.batches(pa.array(odd)):
            assert counts.tolist() == [len(ids(t)) for t in odd]
            assert found.tolist() == [i for t in odd for i in ids(t)]
    draw = random.Random(1)
    alphabet = "ab A'.,\n\t é 　日1’-"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(800)]
    for _, _, found, _ in tool.batches(pa.array(texts)):
        assert found.tolist() == [i for t in texts for i in ids(t)]


def test_separator_scan(docs, none, rows, ids):
    from sylva.llm.token_scan import token_counts

    want = sorted((repr(r[0]), len(ids(r[1]))) for r in rows)
    for block in (64, 1 << 20):
        got = token_counts(docs, VOCABULARY, 50256, block_ids=block, id_bytes=2 if block == 64 else 4)
        assert sorted((repr(r.doc_id), r.n_tokens) for r in got.collect()) == want
    assert token_counts(none, VOCABULARY, 50256).count() == 0


def test_scan_of_a_foreign_file(spark, tmp_path):
    from sylva.llm.token_scan import scan_token_files

    np.array([9, 9, 1, 9, 2, 3], "<u2").tofile(tmp_path / "a.ids")
    np.array([], "<u2").tofile(tmp_path / "b.ids")
    for block in (1, 2, 100):
        got = sorted(tuple(r) for r in scan_token_files(spark, f"file://{tmp_path}", 9, block_ids=block).collect())
        assert got == [("a.ids", 0, 0, 0, True), ("a.ids", 1, 1, 0, True), ("a.ids", 2, 2, 1, True), ("a.ids", 3, 4, 2, False)]


def test_codes_round_trip(docs, none, rows, ids):
    from sylva.llm.codes import round_trip

    want, at = [], 0
    for k, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        own = [*ids(text), 2]
        want.append((k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    got = [tuple(r) for r in round_trip(docs, VOCABULARY, 2).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert round_trip(none, VOCABULARY, 2).count() == 0


def test_special_strings_in_texts(spark, ids):
    from tokenizers import Tokenizer

    from sylva.llm.codes import round_trip
    from sylva.llm.packing import cut_pieces
    from sylva.llm.token_scan import token_counts

    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain", "<|endoftext|><|endoftext|> x", "<|endoftext|", "x" * 100 + "<|endoftext|>é", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    crc = lambda own: zlib.crc32(np.array(own, "<u4").tobytes())
    got = {r.doc_id: r.ids_crc32 for r in round_trip(df, VOCABULARY, 2).collect()}
    assert got == {k: crc([*ids(t), 2]) for k, t in enumerate(texts)} and 50256 in ids(texts[0])
    got = {r.doc_id: r.ids_crc32 for r in cut_pieces(df, VOCABULARY, 0, 2048).collect()}
    assert got == {k: crc([*ids(t), 0]) for k, t in enumerate(texts)}
    # the separator scan takes them as ordinary text, and refuses an end id that texts hold
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    got = {r.doc_id: r.n_tokens for r in token_counts(df, VOCABULARY, 50256).collect()}
    assert got == {k: len(t.encode(x or "", add_special_tokens=False).ids) for k, x in enumerate(texts)}
    with pytest.raises(Exception, match="occurs within a text"):
        token_counts(df, VOCABULARY, ids("plain")[0]).collect()


def test_codes_of_repeated_and_missing_ids(spark, ids):
    from sylva.llm.codes import round_trip

    draw = random.Random(3)
    own = [(k, " ".join(draw.choice("one two three".split()) for _ in range(draw.randint(0, 30)))) for k in [None] * 40 + [-(2**63)] * 3 + [7] * 60 + list(range(20))]
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(6)
    for file_ids in (1 << 24, 50):
        got = sorted(round_trip(df, VOCABULARY, 2, file_ids=file_ids).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted((k for k, _ in own), key=lambda k: (k is not None, k or 0))
        assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
        want = sorted((repr(k), zlib.crc32(np.array([*ids(t), 2], "<u4").tobytes())) for k, t in own)
        assert sorted((repr(r.doc_id), r.ids_crc32) for r in got) == want


def test_codes_random_access(tmp_path):
    from sylva.llm.codes import CodeFile, write_file

    own = np.random.default_rng(0).choice([0, 5, 255, 256, 65535, 65536, 2**24, 2**32 - 1], 3000).astype(np.uint32)
    write_file(f"file://{tmp_path}/x.dac", np.array([7, 8]), np.array([1000, 2000]), own)
    f = CodeFile(f"file://{tmp_path}/x.dac")
    assert [f.token(k) for k in range(0, 3000, 37)] == own[::37].tolist()
    for a, b in ((0, 3000), (255, 257), (999, 2100), (5, 5)):
        assert f.tokens(a, b).tolist() == own[a:b].tolist()
    with pytest.raises(IndexError):
        f.token(3000)
    f.close()


def test_packing(docs, none, rows, ids):
    from sylva.llm.packing import best_fit, pack_documents

    got = pack_documents(docs, VOCABULARY, 0, 64, group_rows=40).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for k, text in ((r[0], r[1]) for r in rows):
        own, pieces = [*ids(text), 0], sorted(by_doc[k], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(own) // 64))) and sum(p.length for p in pieces) == len(own)
        assert all(p.length == 64 for p in pieces[1:])
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes())
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(r.length for r in got) // 64)
    assert len(by_sequence) <= 1.01 * least + 2
    assert pack_documents(none, VOCABULARY, 0, 64).count() == 0
    where, offset = best_fit(np.array([5, 3, 2, 5]), 8)
    assert len(set(where.tolist())) == 2 and max(offset) <= 5


def test_packing_closes_what_cannot_shrink(spark):
    from sylva.llm.packing import pack

    rows = [(k, 0, 0, 40, 1) for k in range(500)]
    got = pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), 64, group_rows=50)
    assert got.select("sequence_id").distinct().count() == 500 and got.count() == 500


def test_mixing(spark, docs, none, rows):
    from sylva.llm.mixing import mix_sources

    got = mix_sources(docs).collect()
    again = mix_sources(docs.repartition(3)).collect()
    key = lambda r: (repr(r.doc_id), r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    total = sum(len(SPACE.findall(r[1] or "")) for r in rows)
    target = {r.source: r.target for r in got}
    assert abs(sum(target.values()) - total) < 1e-6 and all(r.taken <= 3 * r.size for r in got)
    assert mix_sources(none).count() == 0
    even = spark.createDataFrame([(k, f"s{k % 3}", 10 + k % 5) for k in range(3000)], "doc_id long, source string, n int").withColumn("text", F.lit(None).cast("string"))
    taken = defaultdict(int)
    for power in (0.0, 0.5, 2.0):
        taken.clear()
        for r in mix_sources(even, size=F.col("n"), power=power).collect():
            taken[r.source, r.target] += r.taken
        assert all(abs(v - t) <= 10 for (_, t), v in taken.items())


def test_longer_documents_are_due_more_copies(spark):
    from sylva.llm.mixing import mix_sources

    rows = [(k, f"s{k % 2}", 4 ** (k % 5)) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n int").withColumn("text", F.lit(None).cast("string"))
    copies, targets, words = defaultdict(list), {}, defaultdict(int)
    for r in mix_sources(df, size=F.col("n")).collect():
        copies[r.source, r.size].append(r.copies)
        targets[r.source] = r.target
        words[r.source] += r.taken
    for source, target in targets.items():
        mean = [sum(copies[source, 4**k]) / len(copies[source, 4**k]) for k in range(5)]
        assert all(a < b or b > 2.9 for a, b in zip(mean, mean[1:], strict=False)) and abs(words[source] - target) <= 256
        rates = [m / 2**k for k, m in enumerate(mean) if m < 2.9]  # in proportion to the root of the size class
        assert max(rates) < 1.35 * min(rates) + 0.02
    assert all(0 <= c <= 3 for own in copies.values() for c in own)


def test_targets_stop(spark):
    from sylva.llm.mixing import source_targets

    sizes = spark.createDataFrame([("a", 1000, 1), ("b", 10, 1), ("c", 100, 1), (None, 0, 1)], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in source_targets(sizes, (1, 2, 3), 3.0).collect()}
    assert got["b"] == 30 and got["c"] == 300 and got[None] == 0 and abs(got["a"] - 780) < 1e-9


def test_secrets(docs, none, rows):
    from sylva.llm.secrets import BASE, MORE, find_secrets, redact, scans_fully, trigram_query

    got = find_secrets(docs, keep=["text"]).withColumn("clean", redact(F.col("text"), F.col("_spans"))).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = []
        for k, rule in enumerate(BASE + MORE):
            spans += [(m.start(), k, rule.kind, m.end()) for m in re.finditer(rule.pattern, r.text or "", re.A) if len(m[rule.group]) >= rule.least]
        assert [tuple(s) for s in r._spans] == sorted(spans)
        if r.text is None:
            assert r.clean is None
        else:
            hidden, at, want = sorted((s[0], s[3]) for s in spans), 0, ""
            for a, b in hidden:
                if a > at or at == 0:
                    want += r.text[at:a] + "<secret>" if b > at else ""
                at = max(at, b)
            assert r.clean == (want + r.text[at:] if spans else r.text)
    assert find_secrets(none).count() == 0
    assert scans_fully(BASE[2]) and not scans_fully(BASE[0]) and not scans_fully(BASE[1])
    assert trigram_query("abc(d|e)f") == frozenset([frozenset(["abc", "bcd", "cdf"]), frozenset(["abc", "bce", "cef"])])
    assert frozenset() in trigram_query("a?b") and trigram_query("x+abcd") == frozenset([frozenset(["abc", "bcd"])])


def test_jaccard(docs, none, rows):
    from sylva.llm.ngram_join import jaccard_components

    sets = {}
    for k, r in enumerate(rows):
        w = SPACE.findall(lowered(r[1]))
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)].append(r[0])
    want = sorted((repr(r[0]), len(sets[k]), repr(min(least[find(k)]) if least[find(k)] else None)) for k, r in enumerate(rows))
    for frequent, bucket in ((24, 1 << 20), (2, 1 << 9)):
        got = jaccard_components(docs, frequent=frequent, bucket=bucket).collect()
        assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == want
    assert jaccard_components(none).count() == 0


def test_jaccard_beyond_the_broadcast_bounds(docs, monkeypatch):
    from sylva.llm import ngram_join as J

    want = sorted(map(repr, J.jaccard_components(docs).collect()))
    monkeypatch.setattr(J, "MOST_IDS", 4)
    monkeypatch.setattr(J, "MOST_FREQUENT", 3)
    assert sorted(map(repr, J.jaccard_components(docs, frequent=2).collect())) == want


def test_jaccard_of_a_large_group_and_a_shared_passage(spark):
    from sylva.llm.ngram_join import jaccard_components

    draw = random.Random(2)
    original = [f"o{k}" for k in range(80)]
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for k in range(150):
        own = list(original)
        for _ in range(draw.randint(0, 3)):
            own[draw.randrange(80)] = f"e{draw.randrange(10**6)}"
        texts.append(" ".join(own))
        texts.append(" ".join(passage + [f"u{k}_{j}" for j in range(draw.randint(5, 60))]))
    rows = list(enumerate(texts))
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(k, len(sets[k]), find(k)) for k, _ in rows]


def test_licenses(docs, none, rows):
    from sylva.llm.licenses import NOTICES, find_notices

    got = {repr(r.doc_id): r for r in find_notices(docs).where("doc_id IS NULL OR doc_id <> 901").collect()}
    for r in rows:
        if r[0] == 901:
            continue
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(r[1]).encode())
        found = got[repr(r[0])]
        want = sorted((k, n.label) for n in NOTICES if n.base for k in range(len(words)) if words[k : k + len(n.phrase.split())] == n.phrase.encode().split())
        assert found.n_words == len(words) and sorted((p.start, p.label) for p in found.places if p.base) == want
    assert find_notices(none).count() == 0


def test_fuzzy_notices(spark):
    from sylva.llm.licenses import find_notices

    rows = [(1, "x GENERAL publik licence y. Permission is hereby granted, free of charg"), (2, "all right reserved all rights reserved"), (3, "generaél public license"), (4, "cc by cc by"), (5, "allrights reserved"), (6, "general public lighthouse")]
    got = {r.doc_id: [(p.label, p.start, p.end, p.edits, p.base) for p in r.places] for r in find_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [("gpl", 1, 4, 2, False), ("mit", 5, 12, 1, False)]
    assert got[2] == [("reserved", 0, 3, 1, False), ("reserved", 3, 6, 0, True)]
    assert got[3] == [("gpl", 0, 3, 1, False)] and got[4] == [("cc-by", 0, 2, 0, True), ("cc-by", 2, 4, 0, True)]
    assert got[5] == [("reserved", 0, 2, 1, False)] and got[6] == []


def test_fuzzy_places_against_all_word_spans(spark):
    from sylva.llm.licenses import NOTICES, find_notices

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    draw, tested = random.Random(11), [n for n in NOTICES if n.edits and len(n.phrase) < 40]
    texts = []
    for k in range(60):
        words = [draw.choice(["a", "of", "general", "public", "licence", "été", "rights", "free"]) for _ in range(draw.randint(0, 8))]
        for n in draw.sample(tested, 2):
            own = list(n.phrase)
            for _ in range(draw.randint(0, n.edits + 2)):
                at = draw.randrange(len(own))
                own[at] = draw.choice(["", own[at] + "x", "é", own[at], "q"])
            words.insert(draw.randint(0, len(words)), "".join(own))
        texts.append((k, " ".join(words)))
    got = {r.doc_id: r.places for r in find_notices(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for k, text in texts:
        words = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text).encode())]
        for p in got[k]:  # within the bound
            phrases = [n for n in NOTICES if n.label == p.label]
            assert any(distance(" ".join(words[p.start : p.end]), n.phrase) <= p.edits <= n.edits for n in phrases)
        for n in tested:  # no span within the bound is missed
            size = len(n.phrase.split())
            for a in range(len(words)):
                for b in range(a + 1, min(len(words), a + size + 2) + 1):
                    if distance(" ".join(words[a:b]), n.phrase) <= n.edits:
                        assert any(p.label == n.label and p.start < b and a < p.end for p in got[k]), (text, n, words[a:b])


def test_time_of_many_notices():
    from time import perf_counter

    from sylva.llm.licenses import NOTICES, _Finder

    finder, seconds = _Finder(NOTICES), []
    for n in (1000, 4000):
        raw = b"general public license all rights reserved " * n
        began = perf_counter()
        assert len([p for p in finder.places(raw) if p[3] == 0]) == 2 * n
        seconds.append(perf_counter() - began)
    assert seconds[1] < 10 * seconds[0] + 0.5


def test_many_secrets_in_one_text(spark):
    from sylva.llm.secrets import find_secrets, redact

    n = 20_000
    text = "é " + "token=abcdef1 " * n + "end"
    row = find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), keep=["text"]).select(redact(F.col("text"), F.col("_spans")).alias("clean"), F.size("_spans").alias("n"), F.col("_spans")[n - 1]["start"].alias("last")).first()
    assert row.n == n and row.clean == "é " + "<secret> " * n + "end" and row.last == 2 + 14 * (n - 1)


VECTORS = "vec_id long, embedding array<float>, row long, v int, list int"


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(4)
    base = draw.standard_normal((300, 12))
    near = base[:60] + draw.standard_normal((60, 12)) * 0.05
    crowd = base[0] + draw.standard_normal((120, 12)) * 0.12
    rows = [(k, [float(x) for x in v], 1, 1, 1) for k, v in enumerate(np.vstack([base, near, crowd]))]
    rows += [(900, None, 1, 1, 1), (901, [0.0] * 12, 1, 1, 1), (902, [float("nan")] * 12, 1, 1, 1), (903, [None, *[1.0] * 11], 1, 1, 1), (904, [1.0, 2.0], 1, 1, 1), (905, [2.0, 4.0], 1, 1, 1), (906, [float("inf")] * 12, 1, 1, 1), (5, rows[5][1], 1, 1, 1), (None, rows[6][1], 1, 1, 1), (907, [], 1, 1, 1)]
    return rows, spark.createDataFrame(rows, VECTORS).repartition(4)


def test_near_vectors(spark, vectors):
    from sylva.llm.embedding_dedup import near_duplicates

    rows, df = vectors
    own = []
    for k, e, *_ in rows:
        v = np.array([np.nan if x is None else np.float32(x) for x in e or []], np.float64)
        own.append((k, v / np.sqrt((v * v).sum()) if len(v) and np.isfinite(v).all() and np.abs(v).max() > 0 else None))
    links = [[j for j, (_, w) in enumerate(own) if j != i and v is not None and w is not None and len(v) == len(w) and v @ w >= 0.95] for i, (_, v) in enumerate(own)]
    root = list(range(len(own)))
    for _ in own:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(own))]
    groups = defaultdict(list)
    for i, (k, _) in enumerate(own):
        if k is not None:
            groups[root[i]].append(k)
    want = sorted((repr(k), len(links[i]), repr(c := min(groups[root[i]], default=None)), k == c) for i, (k, _) in enumerate(own))
    for block, lists in ((4096, None), (40, 7)):
        got = near_duplicates(df, block=block, lists=lists, sample=200).collect()
        assert sorted((repr(r.vec_id), r.n_links, repr(r.component_id), r.kept) for r in got) == want
    assert near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_top_k(spark, vectors):
    from sylva.llm.topk import exact_top_k

    rows, _ = vectors
    rows = [*rows, (20, rows[33][1], 1, 1, 1), (20, rows[20][1], 1, 1, 1), (40, [3.0, -1.5], 1, 1, 1), (60, [], 1, 1, 1), (80, [float(2**40)] * 12, 1, 1, 1)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    own = [(k, [int(np.floor(64 * float(np.float32(x)))) for x in e]) for k, e, *_ in rows if k is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for i, (q, v) in enumerate(own):
        if q % 20:
            continue
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), k) for j, (k, w) in enumerate(own) if j != i and len(w) == len(v))[:7]
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    for shard, block, tiles, fan in ((4096, 512, 4, 16), (50, 4, 3, 2)):
        got = exact_top_k(df, F.col("vec_id") % 20 == 0, 7, shard=shard, block=block, tiles_a_task=tiles, fan=fan).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert exact_top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0, 7).count() == 0
    assert exact_top_k(df, F.lit(False), 7).count() == 0


def test_partial_selection_with_ties():
    from sylva.llm.topk import select

    draw = np.random.default_rng(3)
    for n, m, top in ((4, 30, 3), (3, 5, 20), (2, 1, 1), (5, 40, 2**61)):
        scores, ids, own = draw.integers(-top, top, (n, m)), draw.integers(0, 9, m), draw.random((n, m)) < 0.2
        got = select(scores, ids, own, 6)
        for i in range(n):
            want = sorted((-int(scores[i, j]), int(ids[j])) for j in range(m) if not own[i, j])[:6]
            assert [(-int(s), int(k)) for k, s, e in zip(got.ids[i], got.scores[i], got.empty[i], strict=True) if not e] == want


def test_toxicity(spark, docs, none):
    from sylva.llm.toxicity import fit, labelled_sample, score_documents

    draw = random.Random(8)
    syllables = ["ta", "ri", "on", "el", "mu", "sha", "ke", "do"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))
    rows = []
    for k in range(900):
        own = [word() for _ in range(draw.randint(20, 120))]
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                own[draw.randrange(len(own))] = draw.choice(["zounds", "blaggard", "scoundrel"])
        rows.append((k, " ".join(own), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit(labelled_sample(df, df.select("doc_id", "toxic"), F.col("doc_id") < 600))
    got = {r.doc_id: r.score for r in score_documents(df, model).collect()}
    wrong = sum((got[k] >= 0.3) != bool(t) for k, _, t in rows if k >= 600)
    assert wrong <= 12
    kept = score_documents(docs, model, keep=("text", "score")).columns
    assert kept == ["doc_id", "text", "score", "score"]
    scores = [r.score for r in score_documents(docs, model).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert score_documents(none, model).count() == 0
    assert score_documents(docs, fit([])).agg(F.max("score")).first()[0] < 0.01
    assert fit([("a", 1)]).weights[0] > 0


def test_components(spark):
    from sylva.llm.components import components

    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (5, 5), (7, 6), (None, 3)] + [(200, k) for k in range(201, 260)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in (100, 101, 102)} | {k: 200 for k in range(200, 260)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
