"""Named commands, routing of results, old text and transm metadata."""

import json

import pytest

from sylva.functions.commands import COMMANDS, Session, command, transform
from sylva.plans import profile as P
from sylva.plans.tree import parse_newick
from sylva.sources import drawings as D, placefiles as S

TREE = "((x:2{0},y:9{1}):7{2},z:5{3},w:1{4}):0{5};"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("runs")
    for name, weight in (("one", 0.75), ("two", 0.25)):
        doc = {"tree": TREE, "version": 3, "fields": ["edge_num", "like_weight_ratio", "likelihood", "distal_length", "pendant_length"], "metadata": {}, "placements": [{"p": [[0, weight, -5.0, 1.0, 0.2], [3, 1 - weight, -6.0, 2.0, 0.1]], "nm": [["q1", 2.0], ["q2", 1.0]]}, {"p": [[1, 1.0, -4.0, 3.0, 0.3]], "n": ["r1"]}]}
        (at / f"{name}.jplace").write_text(json.dumps(doc))
    (at / "groups.csv").write_text("q1,left\nr1,right\nq2,left\n")
    return at


def test_scripts(spark, folder, tmp_path):
    session = Session(spark)
    text = f"""
# keep, then use by name
info {folder}/one.jplace {folder}/two.jplace out={tmp_path}/info csv=no
filter {folder}/one.jplace include=q1 default=exclude out=@some
info @some
kr {folder}/one.jplace {folder}/two.jplace p={{p}} dir={tmp_path} prefix=z_
merge {folder}/one.jplace {folder}/two.jplace out=@all
info @all out=@table
split_up {folder}/one.jplace:{folder}/groups.csv
trim {folder}/one.jplace min_mass=0.3 rewrite=yes out=@small
"""

    @command("split_up")
    def split_up(session, names):
        return session.read_all(names).names

    out = session.run(text, {"p": "1"})
    del COMMANDS["split_up"]
    assert "one" in (tmp_path / "info").read_text() and [tuple(r) for r in out[2].collect()] == [("one", 4, 1, 2.0)]
    assert spark.read.option("header", True).csv(f"{tmp_path}/z_kr").count() == 1
    assert spark.table("table").first().pqueries == 4
    assert sorted((r["sample"], r.name) for r in out[6].collect()) == [("left", "q1"), ("left", "q2"), ("right", "r1")]
    # a query has 3 / 4 of the mass: leaf z carries a quarter of it and goes
    assert {n.label for n in session.kept["@small"].tree.leaves()} == {"x"}
    with pytest.raises(ValueError):
        session.run("nothing @all")
    with pytest.raises(KeyError):
        session.run("info @unknown")


def test_own_transform(spark, folder):
    transform("square", lambda x: x * x)
    run = Session(spark).read(f"{folder}/one.jplace")
    many = run.names.groupBy("sample", "pq_id").agg({"mass": "sum"}).withColumnRenamed("sum(mass)", "n")
    units = P.mass(run.placements.join(many, ["sample", "pq_id"]), multiplicity="n", transform="square")
    assert abs(units.where("pq_id = 1").first().m - 0.1) < 1e-12
    del P.TRANSFORMS["square"]


def test_old_text(spark, folder, tmp_path):
    run = S.read_documents(spark, f"{folder}/one.jplace")
    S.write_legacy(run, f"{tmp_path}/one.place", invocation="by hand", now="2020/01/01 00:00:00")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/one.place").collect()]
    assert lines[0] == "# placements, 2020/01/01 00:00:00" and "# location 0" in lines and ">q1 q2" in lines
    back = S.legacy_placements(spark, f"{tmp_path}/one.place", parse_newick(TREE))
    key = lambda p: sorted((r["loc"], round(r.ml_ratio, 9), r.log_like, r.distal_bl, r.pendant_bl, r.post_prob, r.classification) for r in p.collect())
    assert key(back.placements) == key(run.placements.withColumn("classification", run.placements["classification"]))
    assert sorted(r.name for r in back.names.collect()) == ["q1", "q2", "r1"]


def test_transm_metadata(spark, folder, tmp_path):
    run = S.read_documents(spark, f"{folder}/one.jplace")
    S.write_documents(run, f"{tmp_path}/out", metadata={"invocation": "by hand"}, transm=[(0, 0, 0.0), (2, 0, 1.5)])
    assert sorted(tuple(r) for r in S.read_transm(spark, f"{tmp_path}/out").collect()) == [(0, 0, 0.0), (2, 0, 1.5)]
    assert S.read_documents(spark, f"{tmp_path}/out/sample=one").names.count() == 3


def test_drawn_reference_trees():
    root = parse_newick("((a:1,b:1):1,c:1);")
    ids = {n.label: n.id for n in root.leaves()}
    text = D.reference_trees(root, {ids["a"]: "t1"}, {"t1": "First"}, parse_newick("(t1:1,t2:1)r:0;"), cut={"rank": {ids["b"]: {"t1", "t2"}}})
    assert text.count("<phylogeny") == 3 and "First|t2" in text
    assert D.colored_newick(root, {ids["a"]: {"color": (255, 0, 16), "width": 2.0}}) == "(('a':1[&!color=#ff0010,!width=2],'b':1):1,'c':1);"
