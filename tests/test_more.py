import json

import numpy as np
import pytest

from pyspark.sql import functions as F

from sylva.functions import batch
from sylva.operators import clusters as K, taxonomy as T, warehouse as H
from sylva.operators.place import Model, Reference, Settings, gamma_rates, place, place_query, premask
from sylva.plans import profile as P
from sylva.plans.tree import edges_frame, parse_newick
from sylva.sources.placefiles import read_biom
from sylva.sources.sequences import ReferencePackage, parse_stats, read_alignment, read_taxonomy, write_fasta

# Fixed value: the four-leaf tree for which published results hold.
TREE = "((A:2,B:9):7,C:5,D:1):0;"


@pytest.fixture(scope="module")
def placed(spark):
    rng = np.random.default_rng(2)
    big = "((A:2,(B:9,E:1):2):7,(C:5,F:2):3,D:1):0;"
    length = [2.0, 9.0, 1.0, 2.0, 7.0, 5.0, 2.0, 3.0, 1.0]
    rows = []
    for s in "wxyz":
        for q in range(6):
            for line in range(2):
                loc = int(rng.integers(0, 9))
                rows.append((s, q, line, loc, float(rng.random()), float(rng.random() * length[loc]), 0.1))
    return spark.createDataFrame(rows, "sample string, pq_id long, line int, loc int, ml_ratio double, distal_bl double, pendant_bl double"), edges_frame(spark, parse_newick(big))


def test_squash_pca_and_significance(placed):
    rows, edges = placed
    units = P.mass(rows)
    prof = P.profile(units, edges)
    merges = K.squash(prof, ["w", "x", "y", "z"])
    assert len(merges) == 3 and K.merge_tree(merges).endswith(";")
    from sylva.operators.measures import splitify

    found = K.edge_pca(splitify(units, edges), 2)
    assert found["vectors"].shape[0] == 2 and 0 < found["shares"].sum() <= 1 + 1e-9
    cov = {(r.edge1, r.edge2): r.cov for r in K.covariance(splitify(units, edges)).collect()}
    assert abs(sum(v for (a, b), v in cov.items() if a == b) * found["shares"][0] - found["values"][0]) < 1e-9
    lengths = K.length_pca(prof, ["w", "x", "y", "z"], 2)
    assert lengths["values"][0] >= lengths["values"][1] > 0
    assert K.metric_pca(splitify(units, edges), dict(enumerate([2.0, 9.0, 1.0, 2.0, 7.0, 5.0, 2.0, 3.0, 1.0, 0.0])), 2)["values"][0] > 0
    vectors, _ = K.rotate(found["vectors"], found["values"], found["projections"], 2, K.sign_overlap)
    assert np.allclose(vectors @ vectors.T, np.eye(2), atol=1e-9)
    z, p = K.shuffle_p_values(units, edges, "w", "x", 20)
    assert z > 0 and 0 <= p <= 1
    assert 0 <= K.gaussian_p_value(units, edges, "w", "x", n=200)[1] <= 1


def test_compress_and_clusters(placed):
    rows, edges = placed
    got = K.compress(rows, edges, 3.0).collect()
    assert len(got) == 24 and {(r.sample, r.kept_id) for r in got} <= {(r.sample, r.pq_id) for r in got}
    assert K.compress(rows, edges, -1.0).where("pq_id <> kept_id").count() == 0
    assert K.markov_clusters(rows).count() == 24
    assert K.bootstrap(rows, 1).count() > 0


def test_likelihood_and_placement(spark):
    tree = parse_newick("((a:0.1,b:0.2):0.1,c:0.3,d:0.1):0;")
    seqs = {"a": "ACGTACGTAC", "b": "ACGTACGTCC", "c": "TTGTACGAAC", "d": "TTGTACGAAA"}
    model = Model.gtr({"ac": 1, "ag": 2, "at": 1, "cg": 1, "ct": 2, "gt": 1}, [0.3, 0.2, 0.2, 0.3], alpha=0.5)
    ref = Reference(tree, seqs, model)
    first = ref.log_likelihood(ref.edges()[0])
    assert all(abs(ref.log_likelihood(e) - first) < 1e-9 for e in ref.edges())
    best = place_query(ref, "ACGTACGTAC", Settings(posterior=True))
    assert best[0]["edge"] == 0 and abs(sum(b["ml_ratio"] for b in best) - 1) < 1e-9
    assert abs(sum(b["post_prob"] for b in best) - 1) < 1e-6
    assert place_query(ref, "----------") == []
    got = place(spark.createDataFrame([("q", seqs["c"]), ("r", "-" * 10)], "name string, seq string"), ref).collect()
    assert {r.name for r in got} == {"q"} and min(got, key=lambda r: r.line).loc == 3
    assert np.allclose(gamma_rates(0.5, 4).mean(), 1) and abs(gamma_rates(1.0, 2)[0] - (1 - np.log(2))) < 1e-3
    by_site = Model(model.exchange, model.frequencies, np.array([0.5, 2.0]), np.array([0, 1] * 5))
    own = Reference(tree, seqs, by_site)
    assert all(abs(own.log_likelihood(e) - own.log_likelihood(0)) < 1e-9 for e in own.edges()) and place_query(own, seqs["b"])[0]["edge"] == 1
    flat = Model.from_table(" ".join(["1"] * 190 + ["0.05"] * 20))
    assert np.allclose(flat.transition(50.0), 0.05, atol=1e-6) and np.allclose(flat.transition(0.0)[0], np.eye(20))
    with pytest.raises(ValueError):
        Model.from_table("1 2")
    one = spark.createDataFrame([("a", "A-C-")], "name string, seq string")
    two = spark.createDataFrame([("q", "AC--")], "name string, seq string")
    assert premask(one, two) == [0]


def test_taxonomy(spark):
    taxa = spark.createDataFrame([("r", None, "root", "life"), ("f", "r", "family", "F"), ("g", "f", "genus", "G one"), ("h", "f", "genus", "G two")], "tax_id string, parent_id string, rank string, tax_name string")
    ranks = spark.createDataFrame([("root", 0), ("family", 1), ("genus", 2)], "rank string, rank_order int")
    lines = T.lineage(taxa, ranks)
    assert lines.count() == 9
    rows = spark.createDataFrame([("s", 1, "g", 0.5), ("s", 1, "h", 0.5), ("s", 2, "g", 1.0)], "sample string, pq_id long, classification string, w double")
    got = {(r.pq_id, r.want_rank, r.tax_id): r.likelihood for r in T.classify(rows, lines, ranks).collect()}
    assert got[(1, "genus", "g")] == 0.5 and got[(1, "family", "f")] == 1.0 and got[(2, "genus", "g")] == 1.0
    multi = T.classify(rows, lines, ranks).selectExpr("pq_id placement_id", "cast(pq_id as string) name", "want_rank", "rank", "tax_id", "likelihood")
    joined = H.concat_multiclass(multi)
    assert joined.where("want_rank = 'genus' AND placement_id = 1").first().tax_id == "g,h"
    new = H.concat_taxa(joined, taxa.select("tax_id", "tax_name")).collect()
    assert [(r.tax_id, r.tax_name) for r in new] == [("g,h", "G one/two")]
    groups = spark.createDataFrame([(1, "g"), (1, "h"), (2, "g"), (2, None)], "k int, tax_id string")
    assert {r.k: r.tax_id for r in T.common_ancestor(groups, lines, "k").collect()} == {1: "f", 2: "g"}
    rdp = spark.createDataFrame([("q1\tBacteria(100)\tFirm(85)\tLow(20)",)], "value string")
    assert sorted((r.tax_name, r.bootstrap) for r in T.classify_rdp(rdp).collect()) == [("Bacteria", 1.0), ("Firm", 0.85)]
    best = spark.createDataFrame([("q", "g", 2)], "name string, tax_id string, rank_order int")
    nbc = spark.createDataFrame([("q", "f", 1)], "name string, tax_id string, rank_order int")
    assert T.hybrid2(best, nbc, lines).first().tax_id == "g" and T.hybrid5(best, nbc, lines).first().source == "placement"


def test_inferred_taxa(spark):
    edges = edges_frame(spark, parse_newick(TREE))
    lines = spark.createDataFrame([("g", "g", "genus", 1), ("g", "f", "family", 0), ("h", "h", "genus", 1), ("h", "f", "family", 0), ("f", "f", "family", 0)], "tax_id string, anc_tax_id string, rank string, rank_order int")
    leaves = spark.createDataFrame([(0, "g"), (1, "h"), (3, None)], "id int, tax_id string")
    placed = spark.createDataFrame([("q", 0, 1.0), ("r", 2, 1.0), ("s", 0, 0.999), ("s", 1, 0.001), ("t", 3, 1.0)], "name string, loc int, ml_ratio double")
    assert {r.name: r.tax_id for r in T.infer_taxa(placed, leaves, edges, lines).collect()} == {"q": "g", "r": "f", "s": "g", "t": "f"}


def test_naive_bayes(spark):
    refs = spark.createDataFrame([("a", "ACGTACGTACGTAAAA"), ("b", "TTTTGGGGCCCCTTTT")], "name string, seq string")
    tax = spark.createDataFrame([("a", "x"), ("b", "y")], "name string, tax_id string")
    queries = spark.createDataFrame([("q", "ACGTACGTAC"), ("r", "GGGGCCCC")], "name string, seq string")
    got = {r.name: r.tax_id for r in T.nbc_classify(T.words(queries, 4), T.words(refs, 4), tax).collect()}
    assert got == {"q": "x", "r": "y"}
    lines = spark.createDataFrame([("x", "x", "genus", 0), ("y", "y", "genus", 0)], "tax_id string, anc_tax_id string, rank string, rank_order int")
    boots = {(r.name, r.tax_id): r.bootstrap for r in T.nbc_bootstrap(T.words(queries, 4), T.words(refs, 4), tax, lines, 20, length=4).collect()}
    assert boots[("q", "x")] > 0.8 and boots[("r", "y")] > 0.8
    same = T.identities(queries.limit(1), refs.selectExpr("name", "substring(seq, 1, 10) seq")).where("reference = 'a'").first()
    assert (same.identity, same.overlap) == (1.0, 10)


def test_sources(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">a one\nac-gt\nAC\n>b\nTTTTTTT\n")
    rows = {r.name: r.seq for r in read_alignment(spark, str(tmp_path / "x.fasta")).collect()}
    assert rows == {"a": "AC-GTAC", "b": "TTTTTTT"}
    write_fasta(read_alignment(spark, str(tmp_path / "x.fasta")), str(tmp_path / "out"))
    (tmp_path / "x.sto").write_text("# STOCKHOLM 1.0\na  AC\nb  GT\n\na  GG\nb  TT\n//\n")
    assert {r.name: r.seq for r in read_alignment(spark, str(tmp_path / "x.sto")).collect()} == {"a": "ACGG", "b": "GTTT"}
    (tmp_path / "taxonomy.csv").write_text("tax_id,parent_id,rank,tax_name,root,family\nr,r,root,life,r,\nf,r,family,F,r,f\n")
    taxa, ranks = read_taxonomy(spark, str(tmp_path / "taxonomy.csv"))
    assert {r.tax_id: r.parent_id for r in taxa.collect()} == {"r": None, "f": "r"} and ranks.count() == 2
    (tmp_path / "tree.nwk").write_text("(a:1,b:1,c:1);")
    (tmp_path / "CONTENTS.json").write_text(json.dumps({"files": {"tree": "tree.nwk", "aln_fasta": "x.fasta"}, "metadata": {"format_version": "1.1"}}))
    assert ReferencePackage(str(tmp_path)).check(spark) == ["not in the alignment: c"]
    biom = {"matrix_type": "sparse", "rows": [{"id": "A"}, {"id": "B"}], "columns": [{"id": "s1"}], "data": [[0, 0, 5], [1, 0, 2]]}
    (tmp_path / "t.biom").write_text(json.dumps(biom))
    placements, names = read_biom(spark, str(tmp_path / "t.biom"), parse_newick(TREE))
    assert placements.count() == 2 and {r.name: r.mass for r in names.collect()} == {"pl_0": 5.0, "pl_1": 2.0}
    assert parse_stats("Model of nucleotides substitution: GTR\n . Gamma shape parameter : 0.5\n f(A)= 0.3\n f(C)= 0.2\n f(G)= 0.2\n f(T)= 0.3\n A <-> C 1.5")["subs_rates"] == {"ac": 1.5}


def test_batch():
    assert batch.parse("kr 'a b' {x} # note\n\ninfo {{y}}", {"x": "1"}) == [["kr", "a b", "1"], ["info", "{y}"]]
    assert batch.run("f 1 k=2", {"f": lambda *a, **k: (a, k)}) == [(("1",), {"k": "2"})]
    with pytest.raises(ValueError):
        batch.run("g", {})


def test_warehouse_files(spark, tmp_path):
    H.create(spark, str(tmp_path / "w"))
    H.append(spark.createDataFrame([("root", 0)], "rank string, rank_order int"), str(tmp_path / "w"), "ranks")
    assert H.read(spark, str(tmp_path / "w"), "ranks").count() == 1
    assert H.read(spark, str(tmp_path / "w"), "taxa").count() == 0


def test_stream(spark, tmp_path):
    from sylva.streaming import placements as S

    spark.createDataFrame([("s", 1, 0, 0.5, 0.0, 0.0)], "sample string, pq_id long, loc int, ml_ratio double, distal_bl double, pendant_bl double").selectExpr("*", "timestamp'2024-01-01 00:00:00' placed_at").write.parquet(str(tmp_path / "in"))
    q = S.running_mass(S.read(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("running").first().weight == 0.5


def _plain_words(spark, rows, length):
    found = {}
    for name, text in rows:
        seq = "".join(c for c in (text or "").upper() if "A" <= c <= "Z")
        for i in range(len(seq) - length + 1):
            if set(seq[i : i + length]) <= set("ACGT"):
                found[name, seq[i : i + length]] = found.get((name, seq[i : i + length]), 0) + 1
    return found


def test_words_of_whole_rows(spark):
    rows = [("a", "ac-gtN\nacgta"), ("b", None), ("c", "acg"), ("a", "ACGTAé-ſCGT"), (None, "ttttt"), ("d", ""), (None, "TTTT"), ("e", "g" * 50)]
    df = spark.createDataFrame(rows, "name string, seq string")
    for length in (2, 4, 25, 32):
        want = _plain_words(spark, rows, length)
        assert {(r["name"], r.word): r.n for r in T.words(df, length).collect()} == want
    single = df.where("name <> 'a'")
    plan = T.words(single, 4)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan  # no shuffle of words where names are unique


LABELLED = [("a", "acgtacgtta", "x"), ("b", "ttttggggcc", "y"), ("c", "acgtac", "x"), ("a", "ccccgtta", "x"), ("d", "gattaca", None), ("e", "ggggttttaa", "y"), ("f", "acg", "z")]


def test_training_on_sequences(spark):
    df = spark.createDataFrame(LABELLED, "name string, seq string, tax_id string")
    want, sizes = T.nbc_train(T.words(df, 4), df.select("name", "tax_id"))
    got, own = T.nbc_train_sequences(df, 4, T.FOLDED)
    assert sorted(own.collect(), key=str) == sorted(sizes.collect(), key=str)
    rows = [{(r.tax_id, r.word): (round(r.prior, 12), round(r.gain, 12)) for r in x.collect()} for x in (want, got)]
    assert rows[0] == rows[1] and len(rows[0]) > 15


def test_scores_of_sequences(spark, monkeypatch):
    df = spark.createDataFrame(LABELLED, "name string, seq string, tax_id string")
    queries = spark.createDataFrame([*[r[:2] for r in LABELLED], ("g", "ccgg"), ("h", "accggt"), ("i", None), ("j", "aaaaaaa")], "name string, seq string")
    model, size = T.nbc_train(T.words(df, 4), df.select("name", "tax_id"))
    want = {}
    p = {(r.tax_id, r.word): r.gain for r in model.collect()}
    prior = {r.word: r.prior for r in model.collect()}
    for (name, word), n in _plain_words(spark, [tuple(r) for r in queries.collect()], 4).items():
        for tax, k in size.where("tax_id IS NOT NULL").collect() if word in prior else []:
            want.setdefault(name, {}).setdefault(tax, []).append(n * (np.log(prior[word]) - np.log(k + 1) + p.get((tax, word), 0.0)))
    want = {name: max((round(sum(v), 9), tax) for tax, v in by.items()) for name, by in want.items()}
    assert {tax for _, tax in want.values()} >= {"x", "y"}
    for entries in (T.MODEL_ENTRIES, 0):
        monkeypatch.setattr(T, "MODEL_ENTRIES", entries)
        got = {r["name"]: (round(r.score, 9), r.tax_id) for r in T.nbc_classify_sequences(queries, model, size, 4, T.FOLDED).collect()}
        assert got == want


def test_word_numbers(spark):
    rows = [("a", "Tg-ca!"), ("b", "zebra crossing"), ("a", "tg"), ("c", "")]
    df = spark.createDataFrame(rows, "name string, seq string")
    lower = df.select("name", F.lower("seq").alias("seq"))
    folded = [(n, "".join(T.FOLDED.get(c, "") for c in t.lower())) for n, t in rows]
    want = {(n, sum("ACGT".index(c) * 4 ** (1 - k) for k, c in enumerate(w))): k for (n, w), k in _plain_words(spark, folded, 2).items()}
    assert {(r["name"], r.code): r.n for r in T.word_codes(lower, 2, T.FOLDED).collect()} == want
    packed = T.pack_words(T.words(lower, 2, T.FOLDED))
    assert {(r["name"], r.code): r.n for r in packed.collect()} == want
