"""Embedding near-duplicates by product quantisation, exact in its result.

Fit (on a bounded sample): coarse centroids, and codebooks of the residuals in equal subspaces.
Every vector is put into the list of its nearest centroid with its residual's codes and the exact
error e of its decoded form.  Vectors are scaled to length 1, so cosine >= t means a distance of
at most r = sqrt(2 - 2t), and two bounds lose nothing:

* a vector x of list i probes exactly the lists j with |x - c_j| <= radius_j + r that lie within r
  beyond the plane midway between the centroids, |x - c_j|^2 - |x - c_i|^2 <= 2 r |c_i - c_j|:
  no linked vector lies in another list;
* in a probed list, y is a candidate if the asymmetric distance of x to y's decoded form, summed
  from a table of x's products with the codewords, is at most r + e_y.

Candidates are reranked by exact cosine.  Lists are packed into blocks of bounded size (a larger
list takes several), written as files in the shared folder; a task reads the two blocks of a tile
whose lists are within reach.  It returns each vector's number of links in the tile and one hook
to the least vector of its linked group there, never the pairs of a group.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import fresh_path, open_fs, persist, whole_file
from .textkit import ragged

#: Rows that centroids and codebooks are fitted to at most; coarse lists at most; subspaces and codewords in each.
SAMPLE, MOST_LISTS, SUBSPACES, CODEWORDS = 16_384, 1024, 8, 64
#: Vectors of a block, queries that are compared at once, and successive partners of a block that one task takes.
BLOCK, STEP, RUN = 4096, 256, 2
#: What rounding may take from a bound, in double and (squares, sums of eight) in single precision.
SLACK, ROUNDING = 1e-9, 1e-4


def unit(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length 1, which rows have one) in double precision."""
    wide = raw.astype(np.float64)
    sound = np.isfinite(wide).all(1)
    wide[~sound] = 0
    top = np.abs(wide).max(1, initial=0)
    sound &= top > 0
    wide = wide / np.where(top > 0, top, 1)[:, None]
    return wide / np.where(sound, np.sqrt((wide * wide).sum(1)), 1)[:, None], sound


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), 1)


def k_means(x: np.ndarray, k: int, rounds: int = 5, seed: int = 5) -> np.ndarray:
    """Lloyd's centres; a centre that loses all its rows stays."""
    order = np.random.default_rng(seed)
    k = min(k, len(x))
    x = x.astype(np.float32)
    centres = x[order.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        by_own = np.argsort(own, kind="stable")
        full, firsts = np.unique(own[by_own], return_index=True)
        centres[full] = np.add.reduceat(x[by_own], firsts) / np.diff(np.append(firsts, len(own)))[:, None]
    return centres.astype(np.float64)


class Quantiser:
    """Coarse centroids in an order in which neighbours are near, and a codebook for each subspace."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codewords: int):
        centres = k_means(sample, lists)
        # a greedy walk: lists that lie near get near numbers, so that they share blocks
        left, walk = list(range(1, len(centres))), [0]
        while left:
            here = centres[walk[-1]]
            best = int(np.argmin(((centres[left] - here) ** 2).sum(1)))
            walk.append(left.pop(best))
        self.centres = centres[walk]
        width = sample.shape[1]
        self.cuts = np.linspace(0, width, min(subspaces, width) + 1).astype(int)
        residual = sample - self.centres[_nearest(sample, self.centres)]
        self.books = [k_means(residual[:, a:b], codewords, seed=k) for k, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False))]

    def encode(self, x: np.ndarray):
        """(list, distance to its centroid, codes, error of the decoded form, constant of the asymmetric distance) of each row."""
        own = _nearest(x, self.centres)
        residual = x - self.centres[own]
        codes, decoded, constant = np.zeros((len(x), len(self.books)), np.uint8), self.centres[own].copy(), np.zeros(len(x))
        for s, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            codes[:, s] = _nearest(residual[:, a:b], self.books[s])
            word = self.books[s][codes[:, s]]
            constant += (2 * self.centres[own, a:b] * word + word * word).sum(1)
            decoded[:, a:b] += word
        return own, np.sqrt((residual**2).sum(1)), codes, np.sqrt(((x - decoded) ** 2).sum(1)), constant

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """For each subspace, -2 times the products of every codeword (rows) with every vector: a code looks up a whole row."""
        return [np.ascontiguousarray(-2 * (book @ x[:, a:b].T), np.float32) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)]


def _hooks(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that links (a, b) reach from each of n places."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


class _Block:
    def __init__(self, folder: str, number: int):
        system, path = open_fs(f"{folder}/block-{number:08d}.npz")
        if system.get_file_info(path).type.name != "File":  # no vector fell on this part of a list
            self.rows = np.empty(0, np.int64)
            return
        with system.open_input_file(path) as source:
            held = np.load(io.BytesIO(source.read()))
        self.rows, self.list, self.codes, self.error, self.constant = held["rows"], held["list"], held["codes"], held["error"], held["constant"]
        self.x = unit(held["raw"])[0]
        order = np.argsort(self.list, kind="stable")
        for name in ("rows", "list", "codes", "error", "constant", "x"):
            setattr(self, name, getattr(self, name)[order])
        self.lists, self.firsts = np.unique(self.list, return_index=True)
        self.lasts = np.append(self.firsts[1:], len(self.list))


def _tile(left: _Block, right: _Block, q: Quantiser, radius: np.ndarray, t: float, stats: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places (in left, in right) of linked pairs; within one block each pair once."""
    r, same = np.sqrt(max(0.0, 2 - 2 * t)), left is right
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    own_centres, centres = q.centres[left.list], q.centres[right.lists]
    to_lists = np.maximum(0, (left.x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * (left.x @ centres.T))  # squares
    own = ((left.x - own_centres) ** 2).sum(1)
    gaps = np.sqrt(np.maximum(0, (q.centres**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * (q.centres @ centres.T)))[left.list]
    probes = (np.sqrt(to_lists) <= radius[right.lists][None, :] + r + SLACK) & (to_lists - own[:, None] <= 2 * r * gaps + SLACK)
    for at in range(0, len(left.rows), STEP):
        part = slice(at, at + STEP)
        tables = q.tables(left.x[part])
        for k, (first, last) in enumerate(zip(right.firsts.tolist(), right.lasts.tolist(), strict=True)):
            asked = np.flatnonzero(probes[part, k])
            if same:
                asked = asked[asked + at < last]
            if not len(asked):
                continue
            codes, whole = right.codes[first:last], len(asked) == tables[0].shape[1]
            far, held = np.empty((last - first, len(asked)), np.float32), np.empty((last - first, len(asked)), np.float32)
            far[:] = (right.constant[first:last] - (r + right.error[first:last]) ** 2)[:, None]
            for s, table in enumerate(tables):
                np.take(table if whole else table[:, asked], codes[:, s], axis=0, out=held, mode="clip")
                far += held
            j, i = np.nonzero(far <= (ROUNDING - to_lists[part, k][asked]).astype(np.float32))
            stats[0] += far.size
            i = asked[i] + at
            if same:
                later = i < first + j
                i, j = i[later], j[later]
            stats[1] += len(i)
            if not len(i):
                continue
            if len(i) * 5 > far.size:
                cosine = (left.x[asked + at] @ right.x[first:last].T)[np.searchsorted(asked + at, i), j]
            else:
                cosine = np.einsum("ij,ij->i", left.x[i], right.x[first + j])
            kept = cosine >= t
            found_a.append(i[kept])
            found_b.append(first + j[kept])
    return np.concatenate(found_a), np.concatenate(found_b)


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding", lists: int | None = None, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows link when the cosine of their vectors, in double precision, is at least the threshold
    (above 0).  Null and zero vectors, and those with null or non-finite components, link with
    nothing, and so do vectors of different widths.  Rows of one id are separate rows and may link.
    component_id is the least vec_id that links reach; kept says that it is the row's own.  A null
    id is kept: its component is the least other id in it, else null.  An empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie above 0 and at most at 1")
    spark = vectors.sparkSession
    picked = persist(vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(vector_column, lambda x: x.cast("double")).alias("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sound = picked.where(F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0))
    tiles = None
    for (width,) in sound.select(F.size("v")).distinct().collect():
        one = _links(spark, sound.where(F.size("v") == width), width, threshold, lists, block, sample)
        tiles = one if tiles is None else tiles.unionByName(one)
    if tiles is None:
        return picked.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    tiles = persist(tiles, "tiles")
    counts = tiles.groupBy("row").agg(F.sum("n").alias("n_links"))
    joined = components(tiles.where("row <> root"), a="row", b="root").select(F.col("node").alias("row"), "component")
    named = picked.select("row", "vec_id").join(counts, "row", "left").join(joined, "row", "left").withColumn("component", F.coalesce("component", "row"))
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return named.join(least, "component").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(spark, sound: DataFrame, width: int, t: float, lists: int | None, block: int, sample: int) -> DataFrame:
    """(row, n, root) of every tile: links of a row in the tile, and the least row of its linked group there."""
    n = sound.count()
    rows = sound.orderBy(F.xxhash64("v"), "row").select("v").limit(sample).collect()
    q = Quantiser(unit(np.array([r[0] for r in rows]))[0], lists or max(1, min(MOST_LISTS, round(n**0.5))), SUBSPACES, CODEWORDS)
    shared = spark.sparkContext.broadcast(q)  # its size is bounded by MOST_LISTS

    def assign(batches):
        for batch in batches:
            raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            own, distance, codes, error, constant = shared.value.encode(unit(raw)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array(distance), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(constant), batch.column(1)], ["row", "list", "distance", "codes", "error", "constant", "v"])

    index = persist(sound.select("row", "v").mapInArrow(assign, "row long, list long, distance double, codes binary, error double, constant double, v array<double>"), "index")
    sizes = {r[0]: (r[1], r[2]) for r in index.groupBy("list").agg(F.count("*"), F.max("distance")).collect()}  # a row a list
    radius = np.array([sizes.get(k, (0, -1.0))[1] for k in range(len(q.centres))])
    # lists into blocks: (list, parts, first block)
    plan, n_blocks, room = [], 0, 0
    for k in sorted(sizes):
        count = sizes[k][0]
        if count > block:
            parts = -(-count // block)
            plan.append((k, parts, n_blocks))
            n_blocks, room = n_blocks + parts, 0
        else:
            if room < count:
                n_blocks, room = n_blocks + 1, block
            room -= count
            plan.append((k, 1, n_blocks - 1))
    folder = fresh_path(spark, "blocks")

    def write(table: pa.Table) -> pa.Table:
        number, own = table.column("block")[0].as_py(), table.combine_chunks()
        held = io.BytesIO()
        raw = own.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        codes = np.frombuffer(b"".join(own.column("codes").to_pylist()), np.uint8).reshape(len(raw), -1)
        np.savez(held, rows=own.column("row").to_numpy(), list=own.column("list").to_numpy(), codes=codes, error=own.column("error").to_numpy(), constant=own.column("constant").to_numpy(), raw=raw)
        with whole_file(f"{folder}/block-{number:08d}.npz") as out:
            out.write(held.getvalue())
        return pa.table({"block": pa.array([number], pa.int64())})

    placed = spark.createDataFrame(plan, "list long, parts long, first long")
    blocked = index.join(F.broadcast(placed), "list").withColumn("block", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")))  # at most MOST_LISTS rows
    persist(blocked.drop("distance", "parts", "first").groupBy("block").applyInArrow(write, "block long"), "written")
    # blocks whose lists are within reach of each other: each row of blocks is looked through by a task, none by the driver
    r = np.sqrt(max(0.0, 2 - 2 * t))
    gaps = np.sqrt(np.maximum(0, (q.centres**2).sum(1)[:, None] + (q.centres**2).sum(1) - 2 * q.centres @ q.centres.T))
    near = (gaps <= radius[:, None] + radius[None, :] + r + SLACK) & (radius[:, None] >= 0) & (radius[None, :] >= 0)
    # lists by their first block, and near lists, are of the number of lists
    held_lists, parts, firsts = (np.array(x, np.int64) for x in zip(*plan, strict=True))
    reach = spark.sparkContext.broadcast((near, held_lists, parts, firsts))

    def partners(batches):
        near, held_lists, parts, firsts = reach.value
        for batch in batches:
            for a in batch.column(0).to_pylist():
                own = held_lists[(firsts <= a) & (a < firsts + parts)]
                met = np.flatnonzero(near[np.ix_(own, held_lists)].any(0))
                found = np.unique(ragged(firsts[met], parts[met]))
                found = found[found >= a]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), a)), pa.array(found)], ["a", "b"])

    pairs = persist(spark.range(0, n_blocks, 1, max(1, min(n_blocks, 1000))).mapInArrow(partners, "a long, b long"), "pairs")
    tiles = pairs.repartition(max(1, min(pairs.count(), 50_000)), "a", F.floor(F.col("b") / RUN)).sortWithinPartitions("a", "b")

    def work(batches):
        held: dict[int, _Block] = {}
        for batch in batches:
            for a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for k in (a, b):
                    if k not in held:
                        held = {x: y for x, y in held.items() if x in (a, b)} | {k: _Block(folder, k)}
                left, right = held[a], held[b]
                if not len(left.rows) or not len(right.rows):
                    continue
                i, j = _tile(left, right, shared.value, radius, t, [0, 0])
                if not len(i):
                    continue
                shift = 0 if a == b else len(left.rows)
                rows = left.rows if a == b else np.concatenate([left.rows, right.rows])
                order = np.argsort(rows)  # hooks go to the least row
                place = np.empty(len(rows), np.int64)
                place[order] = np.arange(len(rows))
                x, y = place[i], place[j + shift]
                counts = np.bincount(x, minlength=len(rows)) + np.bincount(y, minlength=len(rows))
                root = _hooks(len(rows), x, y)
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(rows[order][some]), pa.array(counts[some]), pa.array(rows[order][root[some]])], ["row", "n", "root"])

    return tiles.mapInArrow(work, "row long, n long, root long")
