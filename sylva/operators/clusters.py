"""Clustering, components of variation and significance.

What grows with the data (profiles, overlaps, covariance sums) is aggregated by Spark; the matrices
that reach the driver are samples x samples or edges x edges of one reference tree.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans import profile as P
from ..plans.stage import written
from .measures import kr_distance, varying_edges
from .pairs import connected, island_names, islands

#: Classes of queries up to which an island's Markov matrix is multiplied as a plain one.
PLAIN = 4000
#: Distances so little beyond a cutoff are at it: the order in which shares are added does not decide.
TIE = 1e-12


def profile_matrix(prof: DataFrame, samples: list[str]) -> tuple[np.ndarray, np.ndarray, list]:
    """(r: stretches x samples, lengths, (edge, a) keys) of a profile, for a bounded number of samples of one tree."""
    wide = prof.groupBy("edge", "a", "len").pivot("sample", samples).agg(F.first("r")).orderBy("edge", "a").collect()
    return np.array([[row[s] for s in samples] for row in wide], float).reshape(len(wide), len(samples)), np.array([row["len"] for row in wide], float), [(row["edge"], row["a"]) for row in wide]


def squash(prof: DataFrame, samples: list[str], p: float = 1.0, weights: dict[str, float] | None = None) -> list[tuple[str, str, str, float, float]]:
    """Squash clustering: (left, right, merged, length left, length right) of every merge, the nearest pair first.

    A merged sample is the (weighted) mean of its members' mass, so its profile is the mean of
    theirs; lengths are distances to the merged mass.  Ties go to the pair of least names.
    """
    r, length, _ = profile_matrix(prof, samples)
    power = min(1.0, 1.0 / p)
    far = lambda x, y: float((np.abs(x - y) ** p * length).sum() ** power)
    clusters = {s: (r[:, k], (weights or {}).get(s, 1.0)) for k, s in enumerate(samples)}
    merges = []
    while len(clusters) > 1:
        names = sorted(clusters)
        _, a, b = min((far(clusters[x][0], clusters[y][0]), x, y) for i, x in enumerate(names) for y in names[i + 1 :])
        (x, wx), (y, wy) = clusters.pop(a), clusters.pop(b)
        mean, name = (x * wx + y * wy) / (wx + wy), f"({a},{b})"
        merges.append((a, b, name, far(x, mean), far(y, mean)))
        clusters[name] = (mean, wx + wy)
    return merges


def squash_collections(placements: DataFrame, names: DataFrame, edges: DataFrame, *, p: float = 1.0, pre_round: bool = False, taxonomy: DataFrame | None = None, point: bool = False) -> list[tuple[str, str, str, float, float]]:
    """Squash clustering of all samples, by mass on the tree or on a taxonomic one (see ``taxonomy.tax_tree``; placements are classified then).

    With ``pre_round`` queries that agree to three decimals in placements of at least 0.01 are one first.
    """
    from . import collections as C, taxonomy as T

    if pre_round:
        kept = C.rounded(placements, names).select("sample", "pq_id", F.col("mass").alias("_many"))
    else:
        kept = names.groupBy("sample", "pq_id").agg(F.sum("mass").alias("_many"))
    own = placements.join(kept, ["sample", "pq_id"])
    if taxonomy is None:
        prof = P.profile(P.place_mass(own, point=point, multiplicity="_many"), edges)
    else:
        prof = P.profile(T.tax_mass(own, taxonomy, point=point), taxonomy)
    return squash(prof, sorted(r[0] for r in names.select("sample").distinct().collect()), p)


def merge_tree(merges: list[tuple[str, str, str, float, float]]) -> str:
    """Newick text of the merges."""
    text: dict[str, str] = {}
    for a, b, name, x, y in merges:
        text[name] = f"({text.pop(a, a)}:{x:.6g},{text.pop(b, b)}:{y:.6g})"
    return f"{next(iter(text.values()))};" if text else ";"


def bootstrap(placements: DataFrame, seed: int) -> DataFrame:
    """Queries of each sample drawn again with replacement: a Poisson number of copies by a hash of seed and query."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "sample", "pq_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    steps, total = [], 0.0
    term = float(np.exp(-1.0))
    for k in range(9):
        total += term
        steps.append(total)
        term /= k + 1
    copies = sum((F.when(u > s, 1).otherwise(0) for s in steps), F.lit(0))
    own = placements.withColumn("_n", copies).where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return own.withColumn("pq_id", F.xxhash64("pq_id", "_copy")).drop("_n", "_copy")


def near_pairs(placed: DataFrame, edges: DataFrame, cutoff: float, p: float = 1.0) -> DataFrame:
    """(sample, island, pq1, pq2), pq1 < pq2: queries of one island at a distance <= cutoff; placed: (sample, island, pq_id, _at), places (loc, pos, m).

    What a query has on an edge that another does not touch adds in full to their distance.  So of its
    edges, the least frequent first, a query is listed under as many as together exceed the cutoff: two
    queries without a common listing are farther apart.  Those listed together are compared in full: a step
    of an edge costs the pairs of those with mass below it, and steps below which one query lies cost nothing.
    """
    bound = cutoff ** max(1.0, p) + 1e-9
    tree = edges.select("id", "bl", "path").orderBy("id").toArrow().combine_chunks()  # of the tree
    ids, bl = tree.column("id").to_numpy(), tree.column("bl").to_numpy()
    path = np.searchsorted(ids, pa.compute.list_flatten(tree.column("path")).to_numpy())
    path_spots = pa.compute.list_value_length(tree.column("path")).to_numpy().astype(np.int64)
    path_starts = np.cumsum(path_spots) - path_spots

    def spread(at: pa.Array):
        """(query, edge, a, m) of every place and every edge from there to the root: the mass m lies below all of the edge beyond a."""
        flat = at.flatten()
        loc, pos, m = np.searchsorted(ids, flat.field("loc").to_numpy()), flat.field("pos").to_numpy(), flat.field("m").to_numpy()
        k, spots = np.repeat(np.arange(len(at)), pa.compute.list_value_length(at).to_numpy()), path_spots[loc]
        e = path[_ranges(path_starts[loc], spots)]
        return np.repeat(k, spots), e, np.where(e == np.repeat(loc, spots), np.repeat(pos, spots), 0.0), np.repeat(m, spots)

    def shares(at: pa.Array):
        """(query, edge, what the query has there)."""
        k, e, a, m = spread(at)
        order = np.lexsort((a, e, k))
        k, e, a, run = k[order], e[order], a[order], np.cumsum(m[order])
        new = np.append(True, (k[1:] != k[:-1]) | (e[1:] != e[:-1]))
        firsts = np.flatnonzero(new)
        run = run - np.repeat(run[firsts] - m[order][firsts], np.diff(np.append(firsts, len(k))))
        to = np.append(a[1:], 0.0)
        lasts = np.append(firsts[1:], len(k)) - 1
        to[lasts] = bl[e[lasts]]
        return k[firsts], e[firsts], np.add.reduceat(np.maximum(run, 0.0) ** p * (to - a), firsts)

    def counts(batches):
        held: dict = {}
        for batch in batches:
            if batch.num_rows:
                k, e, _ = shares(batch.column("_at"))
                codes = batch.column("sample").dictionary_encode()
                for c, sample in enumerate(codes.dictionary.to_pylist()):
                    held.setdefault(sample, np.zeros(len(ids), np.int64))
                    held[sample] += np.bincount(e[codes.indices.to_numpy()[k] == c], minlength=len(ids))
        for sample, n in held.items():
            e = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([sample] * len(e), pa.string()), pa.array(e), pa.array(n[e])], ["sample", "edge", "n"])

    found = placed.select("sample", "_at").mapInArrow(counts, "sample string, edge long, n long").groupBy("sample", "edge").agg(F.sum("n").alias("n")).toArrow()  # a row an edge and sample
    often: dict = {}
    codes = found.column("sample").combine_chunks().dictionary_encode()
    for c, sample in enumerate(codes.dictionary.to_pylist()):
        own = codes.indices.to_numpy() == c
        often[sample] = np.zeros(len(ids), np.int64)
        often[sample][found.column("edge").to_numpy()[own]] = found.column("n").to_numpy()[own]

    def listed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            k, e, x = shares(batch.column("_at"))
            codes = batch.column("sample").dictionary_encode()
            n = np.array([often[s] for s in codes.dictionary.to_pylist()])[codes.indices.to_numpy()[k], e]
            order = np.lexsort((e, n, k))
            k, e, x = k[order], e[order], x[order]
            firsts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            before = np.cumsum(x) - x
            before -= np.repeat(before[firsts], np.diff(np.append(firsts, len(k))))
            some, short = before <= bound, np.flatnonzero(np.add.reduceat(x, firsts) <= bound)
            out = batch.take(pa.array(np.concatenate([k[some], short])))
            edge = pa.array(np.concatenate([e[some], np.full(len(short), -1)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(out.column(c) for c in ("sample", "island")), edge, *(out.column(c) for c in ("pq_id", "_at"))], ["sample", "island", "edge", "pq_id", "_at"])

    def one(table: pa.Table) -> pa.Table:
        n = table.num_rows
        if n < 2:
            return pa.table([table.column(c).slice(0, 0) for c in ("sample", "island", "pq_id", "pq_id")], ["sample", "island", "pq1", "pq2"])
        table = table.take(pa.compute.sort_indices(table.column("pq_id"))).combine_chunks()
        k, e, a, m = spread(table.column("_at").chunk(0))
        # steps: the stretches of each edge between the places there, from its distal end
        edge = np.unique(e)
        at_e, at_a = np.concatenate([e, edge]), np.concatenate([a, np.zeros(len(edge))])
        order = np.lexsort((at_a, at_e))
        at_e, at_a = at_e[order], at_a[order]
        new = np.append(True, (at_e[1:] != at_e[:-1]) | (at_a[1:] != at_a[:-1]))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        place, at_e, at_a = place[: len(e)], at_e[new], at_a[new]
        lasts = np.flatnonzero(np.append(at_e[1:] != at_e[:-1], True))
        to = np.append(at_a[1:], 0.0)
        to[lasts] = np.maximum(bl[at_e[lasts]], at_a[lasts])
        start, length = len(at_e), to - at_a
        ends = lasts[np.searchsorted(lasts, place)] + 1 - place
        step, who = _ranges(place, ends), np.repeat(k, ends)
        key, which = np.unique(step * n + who, return_inverse=True)
        x, (step, who) = np.bincount(which, np.repeat(m, ends)), np.divmod(key, n)
        alone = np.bincount(who, x**p * length[step], n)
        ends = np.searchsorted(step, np.arange(start + 1))
        met = np.flatnonzero((np.diff(ends) > 1) & (length > 0))
        by_who = np.argsort(who, kind="stable")
        firsts = np.searchsorted(who[by_who], np.arange(n + 1))
        out_a, out_b = [], []
        block = max(1, 2_000_000 // n)
        for lo in range(0, n, block):
            hi = min(n, lo + block)
            # as if no two shared a step, less what those have in common that do
            far = alone[lo:hi, None] + alone[None, :]
            for c in met:
                j, y = who[ends[c] : ends[c + 1]], x[ends[c] : ends[c + 1]]
                first, last = (0, len(j)) if block >= n else np.searchsorted(j, (lo, hi))
                if last > first:
                    u = y[first:last, None]
                    both = np.minimum(u, y) * (2 * length[c]) if p == 1 else (u**p + y**p - np.abs(u - y) ** p) * length[c]
                    if len(j) == n:
                        far -= both
                    else:
                        far[(j[first:last] - lo)[:, None], j] -= both
            i, j = np.nonzero(far <= bound)
            i = i + lo
            i, j = i[i < j], j[i < j]
            whole = np.maximum(far[i - lo, j], 0.0) ** min(1.0, 1.0 / p)
            for k in np.flatnonzero(np.abs(whole - cutoff) < 1e-6):  # on the edge: without the rounding of differences
                gap = np.zeros(start)
                for q, sign in ((i[k], 1.0), (j[k], -1.0)):
                    own = by_who[firsts[q] : firsts[q + 1]]
                    gap[step[own]] += sign * x[own]
                whole[k] = (np.abs(gap) ** p * length).sum() ** min(1.0, 1.0 / p)
            near = whole <= cutoff + TIE
            out_a.append(i[near])
            out_b.append(j[near])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        same = pa.array(np.zeros(len(a), np.int64))
        return pa.table([table.column("sample").take(same), table.column("island").take(same), *(table.column("pq_id").take(pa.array(c)) for c in (a, b))], ["sample", "island", "pq1", "pq2"])

    kind, island = (placed.schema[c].dataType.simpleString() for c in ("pq_id", "island"))
    lists = placed.select("sample", "island", "pq_id", "_at").mapInArrow(listed, f"sample string, island {island}, edge long, pq_id {kind}, _at {placed.schema['_at'].dataType.simpleString()}")
    return lists.groupBy("sample", "island", "edge").applyInArrow(one, f"sample string, island {island}, pq1 {kind}, pq2 {kind}").distinct()


def compress(placements: DataFrame, edges: DataFrame, cutoff: float, *, discard_below: float = 0.0, p: float = 1.0, by: DataFrame | None = None) -> DataFrame:
    """(sample, pq_id, kept_id): within each island, queries at a distance <= cutoff of one with most such neighbours go over to it.

    Greedy: the query of the highest degree (ties: the least) takes its neighbours, and so on.
    Islands, or the clusters ``by`` (sample, pq_id, island), are worked on apart.  Queries of the same places
    and masses have the same neighbours and go together: they are one class, its least query and its size, and
    a task holds near classes that chains of pairs connect, and their pairs, never all pairs of an island.
    """
    spots = F.sort_array(F.collect_list(F.struct("loc", F.col("distal_bl").alias("pos"), F.col("ml_ratio").alias("m"))))
    placed = placements.groupBy("sample", "pq_id").agg(spots.alias("_at"))
    if by is None:
        kept = F.array_distinct(F.transform(F.filter("_at", lambda x: x["m"] >= discard_below), lambda x: x["loc"]))
        placed = written(placed.withColumn("_locs", kept).where(F.size("_locs") > 0), "placed")
        placed = placed.withColumn("_loc", F.array_min("_locs")).join(island_names(placed), ["sample", "_loc"])
    else:
        placed = placed.join(by, ["sample", "pq_id"])
    # one unit of mass a query
    whole = F.aggregate("_at", F.lit(0.0), lambda a, x: a + x["m"])
    units = F.transform("_at", lambda x: F.struct(x["loc"].alias("loc"), x["pos"].alias("pos"), (x["m"] / F.col("_t")).alias("m")))
    placed = placed.withColumn("_t", whole).select("sample", "island", "pq_id", units.alias("_at"))
    if cutoff < 0:
        return placed.select("sample", "pq_id").withColumn("kept_id", F.col("pq_id"))
    same = W.partitionBy("sample", "island", "_at")
    queries = written(placed.select("*", F.min("pq_id").over(same).alias("_first"), F.count("*").over(same).alias("_n")), "alike")
    first = queries.where("pq_id = _first")
    pairs = written(near_pairs(first.select("sample", "island", "pq_id", "_at"), edges, cutoff, p).select("sample", "pq1", "pq2"), "near")
    # a class of several is a pair with itself that holds its size; classes that no chain of pairs connects are apart
    parts = written(connected(pairs.select("sample", F.col("pq1").alias("a"), F.col("pq2").alias("b"))).select("sample", F.col("b").alias("pq1"), F.col("a").alias("part")), "near")
    sizes = first.where("_n > 1").select("sample", F.col("pq_id").alias("pq1"), F.col("pq_id").alias("pq2"), "_n").join(parts, ["sample", "pq1"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, size = (pdf[c].to_numpy() for c in ("pq1", "pq2", "_n"))
        names, which = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = which[: len(a)], which[len(a) :]
        many = np.ones(len(names), np.int64)
        many[a[a == b]] = size[a == b]
        a, b = np.concatenate([a[a != b], b[a != b]]), np.concatenate([b[a != b], a[a != b]])
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        ends = np.searchsorted(a, np.arange(len(names) + 1))
        degree = many - 1 + np.bincount(a, many[b], len(names)).astype(np.int64)
        there, kept = np.ones(len(names), bool), np.arange(len(names))
        heap = list(zip((-degree).tolist(), range(len(names)), strict=True))
        heapq.heapify(heap)
        while heap:
            d, q = heapq.heappop(heap)
            if not there[q] or -d != degree[q] or not d:
                continue
            near = b[ends[q] : ends[q + 1]]
            gone = np.append(near[there[near]], q)
            kept[gone], there[gone] = q, False
            less = []
            for g in gone.tolist():
                other = b[ends[g] : ends[g + 1]]
                other = other[there[other]]
                degree[other] -= many[g]
                less.append(other)
            for other in np.unique(np.concatenate(less)).tolist():
                heapq.heappush(heap, (-int(degree[other]), other))
        return pd.DataFrame({"sample": pdf["sample"].iloc[0], "_first": names, "_kept": names[kept]})

    kind = placements.schema["pq_id"].dataType.simpleString()
    over = pairs.withColumn("_n", F.lit(0).cast("long")).join(parts, ["sample", "pq1"]).unionByName(sizes).groupBy("sample", "part").applyInPandas(one, f"sample string, _first {kind}, _kept {kind}")
    return queries.join(over, ["sample", "_first"], "left").select("sample", "pq_id", F.coalesce("_kept", "_first").alias("kept_id"))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of ranges, one range after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


def markov_clusters(placements: DataFrame, inflation: float = 2.0, rounds: int = 60) -> DataFrame:
    """(sample, pq_id, cluster) by Markov clustering of the overlap graph, island by island; a cluster is named by its least query.

    An island is one task, but no matrix of all its pairs is held.  Queries of weight 1 on one and the same edge have
    the same rows and columns and are one class of several.  The first expansion goes through the edges on which
    queries overlap, to those queries whose share can be kept; what is kept of each column (shares of 1e-9 at least) is sparse.
    """
    groups = islands(placements)
    kind = placements.schema["pq_id"].dataType.simpleString()
    own = placements.groupBy("sample", "pq_id", "loc").agg(F.sum("ml_ratio").alias("wt")).join(groups, ["sample", "pq_id"])
    least_share, block, products = 1e-9, 4_000_000, 2_000_000

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        queries, q = np.unique(pdf["pq_id"].to_numpy(), return_inverse=True)
        _, loc = np.unique(pdf["loc"].to_numpy(), return_inverse=True)
        w, n_loc = pdf["wt"].to_numpy(float), int(loc.max()) + 1
        # classes: their least queries, the class of each query, sizes
        alone = (np.bincount(q)[q] == 1) & (w == 1.0)
        of, lowest = np.arange(len(queries)), np.full(n_loc, len(queries))
        np.minimum.at(lowest, loc[alone], q[alone])
        of[q[alone]] = lowest[loc[alone]]
        named, which, many = np.unique(of, return_inverse=True, return_counts=True)
        kept = np.flatnonzero(of[q] == q)
        kept = kept[np.argsort(q[kept], kind="stable")]
        q, loc, w, n = which[q[kept]], loc[kept], w[kept], len(named)
        starts, spots = np.searchsorted(q, np.arange(n)), np.bincount(q, minlength=n)
        by_loc, loc_spots = np.argsort(loc, kind="stable"), np.bincount(loc, minlength=n_loc)
        loc_starts = np.cumsum(loc_spots) - loc_spots
        square = np.bincount(q, w * w, n)
        sums = np.bincount(q, w * np.bincount(loc, w * many[q], n_loc)[loc], n) - square + 1
        rest = 1 - square
        low = least_share ** (1 / inflation)  # of a column's largest number: what is less is not kept

        def squeezed(c, k, x, cols):  # numbers of some columns, column by column: what is kept of their inflated shares
            ends = np.searchsorted(c, np.arange(cols))
            x = x / np.maximum.reduceat(x, ends)[c]
            for least in (low, least_share):
                c, k, x = (v[x >= least] for v in (c, k, x))
                if least == low:
                    x = x**inflation
                x = x / np.bincount(c, x * many[k], cols)[c]
            return np.bincount(c, minlength=cols), k, x

        def joined(parts):
            counts = np.concatenate([x[0] for x in parts])
            return np.concatenate([[0], np.cumsum(counts)]), np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])

        # ways between edges by one query: (to, share) of each edge
        pairs = spots[q]
        left, right = np.repeat(np.arange(len(q)), pairs), _ranges(starts[q], pairs)
        ways, at = np.unique(loc[left] * n_loc + loc[right], return_inverse=True)
        share = np.bincount(at, w[left] * w[right] * (many / sums)[q[left]])
        way_to, way_starts = ways % n_loc, np.searchsorted(ways, np.arange(n_loc + 1) * n_loc)
        del pairs, left, right, ways, at
        widest = np.bincount(q, w, n).max()
        width = max(1, min(n, block // max(n, n_loc)))
        seen, parts = np.zeros(width * n, bool), []
        for lo in range(0, n, width):
            cols = min(n, lo + width) - lo
            a, b = starts[lo], starts[lo + cols - 1] + spots[lo + cols - 1]
            k, l, v = q[a:b], loc[a:b], w[a:b]
            here = np.bincount((k - lo) * n_loc + l, v, cols * n_loc)
            steps = way_starts[l + 1] - way_starts[l]
            at = _ranges(way_starts[l], steps)
            reach = np.bincount(np.repeat((k - lo) * n_loc, steps) + way_to[at], share[at] * np.repeat(v, steps), cols * n_loc)
            reach += np.bincount((k - lo) * n_loc + l, v * (rest / sums)[k], cols * n_loc)
            own = np.bincount(k - lo, v * reach[(k - lo) * n_loc + l], cols) + (rest / sums)[lo : lo + cols]
            # no query off these edges reaches the least share
            hot = np.flatnonzero((reach * widest >= np.repeat(own * low * (1 - 1e-9), n_loc)) | (here > 0))
            l = hot % n_loc
            seen[np.repeat(hot // n_loc, loc_spots[l]) * n + q[by_loc[_ranges(loc_starts[l], loc_spots[l])]]] = True
            found = np.flatnonzero(seen[: cols * n])
            seen[found] = False
            c, k = found // n, found % n
            at, firsts = _ranges(starts[k], spots[k]), np.cumsum(spots[k]) - spots[k]
            spot = np.repeat(c * n_loc, spots[k]) + loc[at]
            x = np.add.reduceat(w[at] * reach[spot], firsts)
            x += (rest / sums)[k] * (np.add.reduceat(w[at] * here[spot], firsts) + rest[k] * (k == c + lo))
            parts.append(squeezed(c, k, x, cols))
        first, row, value = joined(parts)
        del seen, parts
        old = np.zeros(width * n)
        for _ in range(rounds - 1):
            parts, moved = [], 0.0
            if n <= PLAIN:  # a small island is quicker as a plain matrix
                dense = np.zeros((n, n))
                dense[row, np.repeat(np.arange(n), np.diff(first))] = value
            for lo in range(0, n, width):
                cols = min(n, lo + width) - lo
                a, b = first[lo], first[lo + cols]
                k, v, col = row[a:b], value[a:b], np.repeat(np.arange(cols), np.diff(first[lo : lo + cols + 1]))
                if n <= PLAIN:
                    m = np.zeros((n, cols))
                    m[k, col] = v * many[k]
                    x = np.ascontiguousarray((dense @ m).T).reshape(-1)
                else:
                    x = np.zeros(cols * n)
                    steps = first[k + 1] - first[k]
                    cuts = np.searchsorted(np.cumsum(steps), np.arange(0, int(steps.sum()), products))
                    cuts = np.unique(np.append(cuts, [0, len(k)]))
                    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                        at = _ranges(first[k[s:e]], steps[s:e])
                        x += np.bincount(row[at] + np.repeat(col[s:e] * n, steps[s:e]), value[at] * np.repeat(v[s:e] * many[k[s:e]], steps[s:e]), cols * n)
                found = np.flatnonzero(x)
                counts, new_k, new_v = squeezed(found // n, found % n, x[found], cols)
                # the largest step from the column before
                before, after = col * n + k, np.repeat(np.arange(cols), counts) * n + new_k
                old[before] = v
                moved = max(moved, np.abs(new_v - old[after]).max())
                old[after] = 0
                moved = max(moved, old[before].max())
                old[before] = 0
                parts.append((counts, new_k, new_v))
            first, row, value = joined(parts)
            if moved < 1e-8:
                break
        # queries that a row holds together are one cluster
        col = np.repeat(np.arange(n), np.diff(first))
        row, col = row[value > 1e-6], col[value > 1e-6]
        label = np.arange(n)
        while True:
            least = np.full(n, n)
            np.minimum.at(least, row, label[col])
            new = label.copy()
            np.minimum.at(new, col, least[row])
            new = new[new]
            if (new == label).all():
                break
            label = new
        return pd.DataFrame({"sample": pdf["sample"].iloc[0], "pq_id": queries, "cluster": queries[named[label[which]]]})

    return own.groupBy("sample", "island").applyInPandas(one, f"sample string, pq_id {kind}, cluster {kind}")


# -- principal components


def covariance(features: DataFrame, epsilon: float = 1e-5, scale: bool = False) -> DataFrame:
    """(edge1, edge2, cov) of features (sample, edge, x) with varying values, divisor n - 1; with ``scale`` correlations.

    Features are centred, joined on the sample and summed: a row for each pair of edges of the tree.
    """
    own = varying_edges(features, epsilon)
    stats = own.groupBy("edge").agg(F.avg("x").alias("_mean"), F.count("*").alias("_n"), F.stddev_samp("x").alias("_sd"))
    centred = own.join(stats, "edge").select("sample", "edge", "_n", ((F.col("x") - F.col("_mean")) / (F.col("_sd") if scale else F.lit(1.0))).alias("x"))
    a, b = centred.select("sample", F.col("edge").alias("edge1"), F.col("x").alias("x1"), "_n"), centred.select("sample", F.col("edge").alias("edge2"), F.col("x").alias("x2"))
    return a.join(b, "sample").where("edge1 <= edge2").groupBy("edge1", "edge2").agg((F.sum(F.col("x1") * F.col("x2")) / (F.max("_n") - 1)).alias("cov"))


def metric_covariance(features: DataFrame, edges: DataFrame, epsilon: float = 1e-5) -> DataFrame:
    """(edge1, edge2, cov): :func:`covariance` under branch lengths, times the root of the product of the two."""
    one, two = (edges.select(F.col("id").alias(f"edge{k}"), F.col("bl").alias(f"_bl{k}")) for k in (1, 2))
    return covariance(features, epsilon).join(one, "edge1").join(two, "edge2").select("edge1", "edge2", (F.col("cov") * F.sqrt(F.col("_bl1") * F.col("_bl2"))).alias("cov"))


def length_products(prof: DataFrame) -> DataFrame:
    """(sample1, sample2, value): products of the samples' centred profiles 1 - 2r, stretches weighted by length, divisor n - 1.

    A grouped sum over the stretches; the result is samples x samples.
    """
    each = W.partitionBy("edge", "a")
    own = prof.select("edge", "a", "len", "sample", (1 - 2 * F.col("r") - F.avg(1 - 2 * F.col("r")).over(each)).alias("c"), F.count("*").over(each).alias("n"))
    other = own.select("edge", "a", F.col("sample").alias("sample2"), F.col("c").alias("c2"))
    return own.join(other, ["edge", "a"]).groupBy(F.col("sample").alias("sample1"), "sample2").agg((F.sum(F.col("c") * F.col("c2") * F.col("len")) / (F.max("n") - 1)).alias("value"))


def one_sided(values: DataFrame, observed: float, column: str = "value") -> DataFrame:
    """(p): the share of values at or above what was observed."""
    return values.agg(F.avg((F.col(column) >= observed).cast("double")).alias("p"))


def eigen(matrix: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n largest eigenvalues and their vectors (rows); each vector's entry of largest size is positive."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values)[:n]
    rows = vectors[:, order].T
    sign = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])
    return values[order], rows * np.where(sign == 0, 1, sign)[:, None]


def edge_pca(features: DataFrame, n: int = 5, *, epsilon: float = 1e-5, scale: bool = False) -> dict:
    """Edge principal components: values (shares of variance), vectors by edge, and each sample's projections.

    Two or fewer distinct samples are refused.
    """
    own = varying_edges(features, epsilon).persist()
    edges = sorted(r[0] for r in own.select("edge").distinct().collect())
    samples = sorted(r[0] for r in own.select("sample").distinct().collect())
    wide = own.groupBy("sample").pivot("edge", edges).agg(F.first("x")).collect() if edges else []
    x = np.array([[row[str(e)] for e in edges] for row in sorted(wide, key=lambda r: r["sample"])], float)
    own.unpersist()
    if len(x) == 0 or len(np.unique(x, axis=0)) <= 2:
        raise ValueError("principal components need more than two distinct samples")
    centred = x - x.mean(0)
    if scale:
        centred = centred / centred.std(0, ddof=1)
    cov = centred.T @ centred / (len(x) - 1)
    values, vectors = eigen(cov, n)
    return {"edges": edges, "samples": samples, "values": values, "shares": values / np.trace(cov), "vectors": vectors, "projections": x @ vectors.T}


def length_pca(prof: DataFrame, samples: list[str], n: int = 5) -> dict:
    """Length principal components: samples' centred profiles with stretches weighted by length; vectors over stretches."""
    r, length, keys = profile_matrix(prof, samples)
    x = (1 - 2 * r).T
    centred = x - x.mean(0)
    gram = (centred * length) @ centred.T / (len(samples) - 1)
    values, rows = eigen(gram, n)
    keep = values > 1e-12 * max(values[0], 1e-300)
    values, rows = values[keep], rows[keep]
    vectors = rows @ centred / np.sqrt(values * (len(samples) - 1))[:, None]
    return {"samples": samples, "keys": keys, "values": values, "shares": values / np.trace(gram), "vectors": vectors, "projections": (centred * length) @ vectors.T}


def metric_pca(features: DataFrame, lengths: dict[int, float], n: int = 5) -> dict:
    """Components of edge differences under branch lengths: eigenvectors of D^1/2 G D^1/2."""
    own = varying_edges(features)
    edges = sorted(r[0] for r in own.select("edge").distinct().collect())
    rows = sorted(own.groupBy("sample").pivot("edge", edges).agg(F.first("x")).collect(), key=lambda r: r["sample"])
    x = np.array([[row[str(e)] for e in edges] for row in rows], float)
    root = np.sqrt([lengths[e] for e in edges])
    centred = (x - x.mean(0)) * root
    values, vectors = eigen(centred.T @ centred / (len(x) - 1), n)
    return {"edges": edges, "samples": [r["sample"] for r in rows], "values": values, "vectors": vectors, "projections": centred @ vectors.T}


def rotate(vectors: np.ndarray, values: np.ndarray, projections: np.ndarray, k: int, overlap) -> tuple[np.ndarray, np.ndarray]:
    """The first two or three components turned to lay their support on few edges: the angles of least overlap(vectors), by a grid and refinement."""
    if k not in (2, 3):
        raise ValueError("two or three components are turned")
    scaled = vectors[:k] * np.sqrt(values[:k])[:, None]

    def turn(angles):
        m = np.eye(k)
        for (i, j), a in zip([(0, 1), (0, 2), (1, 2)][: 1 if k == 2 else 3], angles, strict=True):
            g = np.eye(k)
            g[[i, j], [i, j]] = np.cos(a)
            g[i, j], g[j, i] = -np.sin(a), np.sin(a)
            m = g @ m
        return m

    n_angles, best = (1 if k == 2 else 3), None
    grid = np.linspace(-np.pi / 4, np.pi / 4, 25)
    for angles in np.stack(np.meshgrid(*[grid] * n_angles), -1).reshape(-1, n_angles):
        value = overlap(turn(angles) @ scaled)
        if best is None or value < best[0]:
            best = (value, angles)
    width = grid[1] - grid[0]
    for _ in range(30):
        for d in range(n_angles):
            for s in (-width, width):
                angles = best[1].copy()
                angles[d] += s
                if (value := overlap(turn(angles) @ scaled)) < best[0]:
                    best = (value, angles)
        width /= 2
    m = turn(best[1])
    return np.vstack([m @ vectors[:k], vectors[k:]]), np.hstack([projections[:, :k] @ m.T, projections[:, k:]])


def sign_overlap(rows: np.ndarray) -> float:
    """How much components share edges: the sum over pairs of the products of absolute entries."""
    a = np.abs(rows)
    return float(sum((a[i] * a[j]).sum() for i in range(len(a)) for j in range(i + 1, len(a))))


# -- significance of a distance


def shuffle_p_values(units: DataFrame, edges: DataFrame, sample1: str, sample2: str, n: int = 100, p: float = 1.0, seed: int = 1) -> tuple[float, float]:
    """(distance, share of shuffles at least as far): see :func:`shuffle_null`."""
    observed = kr_distance(P.profile(units.where(F.col("sample").isin(sample1, sample2)), edges), p).first()["distance"]
    return observed, one_sided(shuffle_null(units, edges, sample1, sample2, n, p, seed), observed - 1e-12, "z").first()[0]


def shuffle_null(units: DataFrame, edges: DataFrame, sample1: str, sample2: str, n: int = 100, p: float = 1.0, seed: int = 1) -> DataFrame:
    """(turn, z): distances of n shuffles, the null distribution to draw: queries of both samples dealt anew to two samples of the same sizes.

    Queries are dealt by the rank of a hash: those up to the hash that the last query of the first
    sample has.  That limit is found for each shuffle among the queries of one of 1024 stretches of
    hashes; then a row of units carries its sides as bits, tasks sum them by place, and a task
    finishes 10 shuffles.  No unit is written down more than once.
    """
    two = units.where(F.col("sample").isin(sample1, sample2)).select("sample", "pq_id", "loc", "pos", "m")
    queries = written(two.select("sample", "pq_id").distinct(), "dealt_queries")
    n1 = queries.where(F.col("sample") == sample1).count()
    turns = queries.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("h", F.xxhash64(F.lit(seed), "turn", "sample", "pq_id"))
    slots = turns.withColumn("slot", F.shiftright("h", 54))
    run = F.sum("k").over(W.partitionBy("turn").orderBy("slot"))
    last = slots.groupBy("turn", "slot").agg(F.count("*").alias("k")).withColumn("run", run).where((F.col("run") >= n1) & (F.col("run") - F.col("k") < n1))
    last = written(last.select("turn", "slot", (F.col("run") - F.col("k")).alias("before")), "last_slots")  # a row a shuffle
    rank = F.row_number().over(W.partitionBy("turn").orderBy("h", "sample", "pq_id"))
    limits = slots.join(F.broadcast(last), ["turn", "slot"]).withColumn("rank", F.col("before") + rank).where(F.col("rank") == n1)
    limit = {r.turn: (r.h, r["sample"], r.pq_id) for r in limits.select("turn", "h", "sample", "pq_id").collect()}  # a row a shuffle

    def first_side(turn: int) -> Column:
        h, sample, query = limit[turn]
        own = F.xxhash64(F.lit(seed), F.lit(turn), "sample", "pq_id")
        tie = (F.col("sample") < sample) | ((F.col("sample") == sample) & (F.col("pq_id") <= F.lit(query)))
        return (own < h) | ((own == h) & tie)

    wide, packed = 10, 60
    bits = [sum((F.when(first_side(t), F.lit(1 << (t - lo))).otherwise(F.lit(0)).cast("long") for t in range(lo, min(n + 1, lo + packed))), F.lit(0).cast("long")).alias(f"b{lo}") for lo in range(1, n + 1, packed)]
    tree = {r["id"]: (r["path"], r["bl"]) for r in edges.select("id", "path", "bl").collect()}  # of the tree

    def add(batches):
        for batch in batches:
            loc, pos, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("loc", "pos", "m"))
            sides = [batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names[3:]]
            begin = np.flatnonzero(np.concatenate([[True], (loc[1:] != loc[:-1]) | (pos[1:] != pos[:-1])])) if len(loc) else np.array([], int)
            for chunk, lo in enumerate(range(0, n, wide) if len(loc) else []):
                own = np.stack([(sides[t // packed] >> (t % packed)) & 1 for t in range(lo, min(n, lo + wide))], 1) * m[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(begin), chunk, np.int32)), pa.array(loc[begin].astype(np.int32)), pa.array(pos[begin]), pa.array(np.add.reduceat(m, begin)), pa.array(list(np.add.reduceat(own, begin)), pa.list_(pa.float64()))], ["chunk", "loc", "pos", "whole", "first"])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(["loc", "pos"])
        one, whole = np.array(own["first"].tolist()), own["whole"].to_numpy()
        total = one.sum(0)
        gap = one / total - (whole[:, None] - one) / (whole.sum() - total)
        return pd.DataFrame({"turn": np.arange(len(total)) + own["chunk"].iloc[0] * wide + 1, "z": _apart(own["loc"].tolist(), own["pos"].tolist(), gap, tree, p) ** min(1.0, 1.0 / p)})

    rows = two.repartition("loc", "pos").sortWithinPartitions("loc", "pos").select("loc", "pos", "m", *bits)
    places = rows.mapInArrow(add, "chunk int, loc int, pos double, whole double, first array<double>")
    return places.groupBy("chunk").applyInPandas(finish, "turn int, z double")


def _apart(locs: list, places: list, moved: np.ndarray, tree: dict, p: float) -> np.ndarray:
    """For each column of differences of mass at places (in order): the sum over the tree of |difference below| ** p times length."""
    below, on = {}, {}
    for loc, pos, x in zip(locs, places, moved, strict=True):
        on.setdefault(loc, []).append((pos, x))
        for e in tree[loc][0]:
            if e != loc:
                below[e] = below.get(e, 0.0) + x
    z = np.zeros(moved.shape[1])
    for e in {*below, *on}:
        r, at = np.zeros(moved.shape[1]) + below.get(e, 0.0), 0.0
        for pos, x in [*on.get(e, []), (tree[e][1], 0.0)]:
            z += np.abs(r) ** p * max(0.0, pos - at)
            r, at = r + x, pos
    return z


def gaussian_p_value(units: DataFrame, edges: DataFrame, sample1: str, sample2: str, p: float = 1.0, n: int = 1000, seed: int = 1) -> tuple[float, float]:
    """(distance, share at least as far) under Gaussian deviates: differences of profiles with the covariance of shuffled mass.

    Each query adds a standard normal times its centred profile to a deviate.  The normals follow from
    a hash of seed and query; tasks sum them by place, then a task finishes 50 deviates, so what is
    held has the size of the places on the tree, whatever the number of queries.
    """
    two = units.where(F.col("sample").isin(sample1, sample2))
    observed = kr_distance(P.profile(two, edges), p).first()["distance"]
    sizes = {r["sample"]: r["n"] for r in two.groupBy("sample").agg(F.countDistinct("pq_id").alias("n")).collect()}
    n1, n2 = sizes[sample1], sizes[sample2]
    whole = two.groupBy("sample", "pq_id").agg(F.sum("m").alias("_t"))
    single = two.join(whole, ["sample", "pq_id"]).select(F.xxhash64(F.lit(seed), "sample", "pq_id").alias("key"), "loc", "pos", (F.col("m") / F.col("_t")).alias("m"))
    tree = {r["id"]: (r["path"], r["bl"]) for r in edges.select("id", "path", "bl").collect()}  # of the tree
    wide = 50

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(n)
        for key, m in zip(pdf["key"].tolist(), pdf["m"].tolist(), strict=True):
            total += m * np.random.Generator(np.random.Philox(key=key % (1 << 64))).standard_normal(n)
        chunks = [total[k : k + wide].tolist() for k in range(0, n, wide)]
        return pd.DataFrame({"chunk": range(len(chunks)), "loc": pdf["loc"].iloc[0], "pos": pdf["pos"].iloc[0], "base": pdf["m"].sum(), "total": chunks})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(["loc", "pos"])
        s, base = np.array(own["total"].tolist()), own["base"].to_numpy()
        moved = s - base[:, None] * s.sum(0) / (n1 + n2)  # the normals less their mean
        return pd.DataFrame({"z": _apart(own["loc"].tolist(), own["pos"].tolist(), moved * weight, tree, p) ** min(1.0, 1.0 / p)})

    weight = np.sqrt((1 / n1 + 1 / n2) / (n1 + n2))
    places = single.groupBy("loc", "pos").applyInPandas(add, "chunk int, loc int, pos double, base double, total array<double>")
    z = places.groupBy("chunk").applyInPandas(finish, "z double")
    return observed, float(z.agg(F.avg((F.col("z") >= observed).cast("double"))).first()[0])
