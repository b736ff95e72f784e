"""The operators as named commands: scripts run them on named collections, and results go where a command says.

A collection is given by a path (read by its suffix), by ``path:map.csv`` (split by a table of
names and groups), or as ``@name``, a result kept by an earlier command.  What a command returns
(a relation, text, or rows) is kept under ``out=@name``, or written below ``dir=`` with
``prefix=``, as CSV, or as padded text with ``csv=no``.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import collections as C, measures as M, pairs as X
from ..plans import profile as P
from ..sources.drawings import padded
from ..sources.placefiles import Placements, read_any
from . import batch

#: name -> command(session, collection, **options).  Users add their own with :func:`command`.
COMMANDS: dict[str, Callable] = {}


def command(name: str):
    """Register a command under a name."""

    def add(f):
        COMMANDS[name] = f
        return f

    return add


def transform(name: str, f: Callable[[Column], Column]) -> None:
    """Register a transform of multiplicities for every operator that takes one by name."""
    P.TRANSFORMS[name] = f


class Session:
    """Runs commands; keeps trees, collections and results by name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, {}

    def read(self, name: str) -> Placements:
        """A collection by path, ``path:map`` or ``@name``."""
        if name.startswith("@"):
            if name not in self.kept:
                raise KeyError(name)
            return self.kept[name]
        path, _, groups = name.partition(":")
        if path not in self.kept:
            self.kept[path] = read_any(self.spark, path)
        run = self.kept[path]
        if not groups:
            return run
        by = self.spark.read.csv(groups, schema="name string, grp string")
        placements, names = C.split(run.placements, run.names, by)
        return Placements(run.tree, run.edges, placements, names)

    def read_all(self, names: list[str]) -> Placements:
        """Several collections of one tree as one, their samples apart."""
        runs = [self.read(n) for n in names]
        shapes = {tuple((n.id, n.label, n.length) for n in r.tree.walk()) for r in runs}
        if len(shapes) != 1:
            raise ValueError("the collections' trees differ")
        first = runs[0]
        for r in runs[1:]:
            first = Placements(first.tree, first.edges, first.placements.unionByName(r.placements, allowMissingColumns=True), first.names.unionByName(r.names))
        return first

    def write(self, result, name: str, options: dict) -> str | None:
        """Keep or write a result; the path, if one was written."""
        out, folder, prefix = options.get("out"), options.get("dir"), options.get("prefix", "")
        if out and out.startswith("@"):
            self.kept[out] = result
            if isinstance(result, DataFrame):
                result.createOrReplaceTempView(out[1:])
            return None
        if not out and not folder:
            return None
        path = out or os.path.join(folder, f"{prefix}{name}")
        if isinstance(result, DataFrame):
            if options.get("csv", "yes") == "no":  # a table for reading: small by its purpose
                rows = [result.columns, *[["" if v is None else str(v) for v in r] for r in result.collect()]]
                result = padded(rows)
            else:
                result.write.mode("overwrite").option("header", True).csv(path)
                return path
        if isinstance(result, str):
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(result)
            return path
        raise TypeError(f"{name} gives nothing that can be written")

    def run(self, text: str, values: dict[str, str] | None = None) -> list:
        """Run a script; the results of its commands."""

        def call(name):
            def one(*words, **options):
                where = {k: options.pop(k) for k in ("out", "dir", "prefix", "csv") if k in options}
                result = COMMANDS[name](self, list(words), **options)
                self.write(result, name, where)
                return result

            return one

        return batch.run(text, {name: call(name) for name in COMMANDS}, values)


def _mass(run: Placements, point: str = "no", transform: str = "no_trans") -> DataFrame:
    many = run.names.groupBy("sample", "pq_id").agg(F.sum("mass").alias("_mult"))
    return P.mass(run.placements.join(many, ["sample", "pq_id"]), point=point == "yes", multiplicity="_mult", transform=transform)


@command("info")
def _info(session, names):
    run = session.read_all(names)
    return C.info(run.names, run.edges)


@command("kr")
def _kr(session, names, p="1", point="no", transform="no_trans"):
    run = session.read_all(names)
    return M.kr_distance(P.profile(_mass(run, point, transform), run.edges), float(p))


@command("unifrac")
def _unifrac(session, names):
    run = session.read_all(names)
    return M.unifrac(P.profile(_mass(run), run.edges))


@command("fpd")
def _fpd(session, names, theta="0.5"):
    run = session.read_all(names)
    return M.diversity(P.profile(_mass(run, "yes"), run.edges), [float(t) for t in theta.split(",")])


@command("edpl")
def _edpl(session, names):
    run = session.read_all(names)
    return X.edpl(run.placements, run.edges)


@command("rarefact")
def _rarefact(session, names, k="10", variance="no"):
    run = session.read_all(names)
    return (M.rarefaction_variance if variance == "yes" else M.rarefaction)(run.placements, run.edges, int(k))


@command("splitify")
def _splitify(session, names, kappa="1"):
    run = session.read_all(names)
    return M.splitify(_mass(run), run.edges, float(kappa))


@command("adcl")
def _adcl(session, names, min_distance=None, max_matches=None):
    run = session.read_all(names)
    return X.adcl(run.placements, run.edges, min_distance=None if min_distance is None else float(min_distance), max_matches=None if max_matches is None else int(max_matches))


@command("to_csv")
def _to_csv(session, names):
    run = session.read_all(names)
    return C.to_table(run.placements, run.names)


@command("check")
def _check(session, names):
    run = session.read_all(names)
    return C.check_places(run.placements.drop("bl"), run.edges)


def _with(run: Placements, placements: DataFrame, names: DataFrame) -> Placements:
    return Placements(run.tree, run.edges, placements, names)


@command("merge")
def _merge(session, names):
    run = session.read_all(names)
    return _with(run, C.merge([run.placements]), C.merge([run.names]))


@command("filter")
def _filter(session, names, include="", exclude="", default="include"):
    run = session.read_all(names)
    kept = C.filter_names(run.names, [x for x in include.split(",") if x], [x for x in exclude.split(",") if x], default == "exclude")
    return _with(run, run.placements.join(kept.select("sample", "pq_id").distinct(), ["sample", "pq_id"], "left_semi"), kept)


@command("demulti")
def _demulti(session, names):
    run = session.read_all(names)
    return _with(run, *C.one_name_each(run.placements, run.names))


@command("mft")
def _mft(session, names, transform="no_trans", unitize="no"):
    run = session.read_all(names)
    return _with(run, run.placements, C.transform_masses(run.names, transform, unitize=unitize == "yes"))


@command("trim")
def _trim(session, names, min_mass="0.001", rewrite="no"):
    from ..operators.trimming import trim
    from ..plans.tree import edges_frame

    run = session.read_all(names)
    out = trim(run.placements, run.names, run.edges, float(min_mass), rewrite=rewrite == "yes")
    return Placements(out.tree, edges_frame(session.spark, out.tree), out.placements, out.names)
