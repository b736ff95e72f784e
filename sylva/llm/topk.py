"""Exact top-k by inner product: tiles of queries against shards of vectors, merged as a tree.

Queries are dealt into blocks of bounded size and vectors into shards of bounded size, each a file
in the shared folder.  A tile is the matrix product of one block and one shard; it keeps every
query's k best by partial selection.  Tiles are numbered, not listed: a task takes a stretch of
numbers, reads one block and one shard at a time, and merges the lists of a block's tiles as it
goes.  What it has for a block is one row; such rows are merged as a tree of bounded fan.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import fresh_path, open_fs, persist, whole_file

#: Rows of a block of queries and of a shard of vectors.
BLOCK, SHARD = 512, 4096
#: Tiles that a task takes at least (if there are as many), tasks at most, and lists that are merged at once.
TILES, TASKS, FAN = 4, 50_000, 16


def quantised(vector: Column, scale: float) -> Column:
    """array<long> of floor(scale * x), x as double; null for a null vector or one with null or non-finite components."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(vector.isNotNull() & sound, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while every partial sum stays below 2**53, else in 64-bit integers."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    bound = np.abs(queries).sum(1, dtype=np.float64).max() * float(np.abs(vectors).max())
    if bound < 2.0**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


class Lists:
    """The best so far of each query of a block: ids and scores, best first; a place that is not taken yet is ``empty``."""

    def __init__(self, ids: np.ndarray, scores: np.ndarray, empty: np.ndarray):
        self.ids, self.scores, self.empty = ids, scores, empty

    @staticmethod
    def none(n: int, k: int) -> Lists:
        return Lists(np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.ones((n, k), bool))

    def merged(self, other: Lists) -> Lists:
        ids, scores, empty = (np.concatenate(x, 1) for x in ((self.ids, other.ids), (self.scores, other.scores), (self.empty, other.empty)))
        order = np.lexsort((ids, -scores, empty))[:, : self.ids.shape[1]]
        return Lists(*(np.take_along_axis(x, order, 1) for x in (ids, scores, empty)))


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Lists:
    """Each row's k highest scores, ties to smaller ids, by partial selection; ``own`` marks what takes no part."""
    n, m = scores.shape
    kept = min(k, m)
    by_id = np.argsort(ids, kind="stable")
    ids, scores, own = ids[by_id], scores[:, by_id], own[:, by_id]
    if scores.size and float(np.abs(scores).max()) < 2.0**62 / m:
        # score and place in one number: no two are equal, so a partition settles ties
        key = scores * m + np.arange(m - 1, -1, -1)
        key[own] = np.iinfo(np.int64).min
        best = np.argpartition(key, m - kept, axis=1)[:, m - kept :] if kept < m else np.broadcast_to(np.arange(m), (n, m))
    else:
        best = np.lexsort((np.broadcast_to(ids, (n, m)), -scores, own))[:, :kept]
    out = Lists.none(n, k)
    found = Lists(ids[best], np.take_along_axis(scores, best, 1), np.take_along_axis(own, best, 1))
    return out.merged(found)


class _Part:
    """A block or a shard: numbers of rows, ids, and the vectors of each width."""

    def __init__(self, folder: str, name: str):
        system, path = open_fs(f"{folder}/{name}")
        if system.get_file_info(path).type.name != "File":  # no row fell on this number
            self.rows, self.ids, widths, flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        else:
            with system.open_input_file(path) as source:
                held = np.load(io.BytesIO(source.read()))
            self.rows, self.ids, widths, flat = held["rows"], held["ids"], held["widths"], held["flat"]
        starts = np.cumsum(widths) - widths
        self.of = {}
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            self.of[width] = (at, flat[starts[at][:, None] + np.arange(width)])


def _tile(block: _Part, shard: _Part, k: int, best: Lists) -> Lists:
    """The lists of a block after one more shard; vectors of different widths do not meet."""
    for width, (queries, asked) in block.of.items():
        if width not in shard.of:
            continue
        vectors, held = shard.of[width]
        own = block.rows[queries][:, None] == shard.rows[vectors][None, :]
        found = Lists(*(x[queries] for x in (best.ids, best.scores, best.empty))).merged(select(_scores(asked, held), shard.ids[vectors], own, k))
        best.ids[queries], best.scores[queries], best.empty[queries] = found.ids, found.scores, found.empty
    return best


LISTS = "block long, piece long, ids binary, scores binary, empty binary"


def _packed(block: int, piece: int, best: Lists) -> pa.RecordBatch:
    parts = [pa.array([x.tobytes()], pa.binary()) for x in (best.ids, best.scores, best.empty)]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([piece], pa.int64()), *parts], ["block", "piece", "ids", "scores", "empty"])


def _unpacked(row: dict, k: int) -> Lists:
    return Lists(*(np.frombuffer(row[name], kind).reshape(-1, k) for name, kind in (("ids", np.int64), ("scores", np.int64), ("empty", bool))))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int, *, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 64.0, block: int = BLOCK, shard: int = SHARD, tiles_a_task: int = TILES, fan: int = FAN) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer products with all rows but itself.

    Components become floor(scale * x).  Rows with null or non-finite components, or a null id,
    take no part; vectors of different widths meet only their own width (empty ones score 0 with
    each other).  Rows that repeat an id are rows like any other: each query row gets a list of its
    own, in which the other rows of its id stand too.  Ties go to the smaller id.  An empty table,
    or one without queries, gives no rows; a query with fewer candidates gets all.  ``is_query``
    is a condition on the columns of ``vectors``.  Products must fit 64 bits.
    """
    spark = vectors.sparkSession
    sound = vectors.select(F.col(id_column).cast("long").alias("_id"), quantised(F.col(vector_column), scale).alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_is_query")).where(F.col("_id").isNotNull() & F.col("_v").isNotNull())
    # a number for each row, written down, so that rows of one id are told apart
    sound = persist(sound.withColumn("_row", F.monotonically_increasing_id()), "quantised")
    n, asked = sound.agg(F.count("*"), F.count_if("_is_query")).first()
    shards, blocks, folder = max(1, -(-n // shard)), max(1, -(-asked // block)), fresh_path(spark, "topk")

    def dealt(rows: DataFrame, kind: str, count: int) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), F.pmod(F.xxhash64("_row", F.lit(kind)), F.lit(count)).alias("number"), "_row", "_id", "_v")

    def write(table: pa.Table) -> pa.Table:
        own, kind, number = table.sort_by("_row").combine_chunks(), table.column("kind")[0].as_py(), table.column("number")[0].as_py()
        held, lists = io.BytesIO(), own.column("_v").combine_chunks()
        np.savez(held, rows=own.column("_row").to_numpy(), ids=own.column("_id").to_numpy(), widths=np.diff(lists.offsets.to_numpy()).astype(np.int64), flat=lists.flatten().to_numpy(zero_copy_only=False))
        with whole_file(f"{folder}/{kind}-{number:08d}.npz") as out:
            out.write(held.getvalue())
        return pa.table({"kind": pa.array([kind]), "number": pa.array([number], pa.int64())})

    both = dealt(sound, "shard", shards).unionByName(dealt(sound.where("_is_query"), "block", blocks))
    persist(both.groupBy("kind", "number").applyInArrow(write, "kind string, number long"), "parts")
    tiles = blocks * shards
    tasks = max(1, min(TASKS, -(-tiles // tiles_a_task)))
    stretch = -(-tiles // tasks)

    def work(batches):
        block_no, own, best, first = -1, None, None, 0
        for batch in batches:
            for tile in batch.column(0).to_pylist():
                here, shard_no = divmod(tile, shards)
                if here != block_no:
                    if own is not None and len(own.rows):
                        yield _packed(block_no, first // stretch, best)
                    block_no, own, first = here, _Part(folder, f"block-{here:08d}.npz"), shard_no
                    best = Lists.none(len(own.rows), k)
                if len(own.rows):
                    best = _tile(own, _Part(folder, f"shard-{shard_no:08d}.npz"), k, best)
        if own is not None and len(own.rows):
            yield _packed(block_no, first // stretch, best)

    lists = spark.range(0, tiles, 1, tasks).mapInArrow(work, LISTS)

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        best = _unpacked(rows[0], k)
        for row in rows[1:]:
            best = best.merged(_unpacked(row, k))
        return pa.Table.from_batches([_packed(rows[0]["block"], rows[0]["piece"], best)])

    pieces = -(-shards // stretch) + 1
    while pieces > 1:
        lists = lists.withColumn("piece", F.floor(F.col("piece") / fan)).groupBy("block", "piece").applyInArrow(merge, LISTS)
        pieces = -(-pieces // fan)

    def spread(batches):
        for batch in batches:
            for row in batch.to_pylist():
                best, own = _unpacked(row, k), _Part(folder, f"block-{row['block']:08d}.npz")
                i, j = np.nonzero(~best.empty)
                yield pa.RecordBatch.from_arrays([pa.array(own.ids[i]), pa.array((j + 1).astype(np.int32)), pa.array(best.ids[i, j]), pa.array(best.scores[i, j])], ["query_id", "rank", "vec_id", "score"])

    return lists.mapInArrow(spread, "query_id long, rank int, vec_id long, score long")
