"""Token-id files of directly addressable codes.

An id is split into byte-wide chunks, least significant first.  Level 0 holds the first chunk of
every id; a bit of level k's continuation bitmap says that the id has a chunk on level k + 1, and
the rank directory (set bits before every block of 256) gives its place there.  So any id can be
read alone: a byte, a bit and a rank on each level, with no block to decode.

File: the eight bytes ``DACIDS02``; little-endian 64-bit numbers: documents, ids, levels, documents
without an id (they come first), then for each level its number of chunks; document ids and the documents' starts (documents + 1), 64 bits
each; for each level its chunks, and for all but the last its bitmap (padded to whole blocks, low
bit first) and its directory (64-bit ranks, one for each block and one for the total).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import fresh_path, open_fs, persist, whole_file

MAGIC, BLOCK_BITS = b"DACIDS02", 256
#: Ids that a file holds, about; a longer document is a file of its own.
FILE_IDS = 1 << 24


def encode(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """(chunks, bitmap bytes, rank directory) of each level; the last level has no bitmap."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        chunks, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
        goes_on = rest > 0
        if not goes_on.any():
            return [*levels, (chunks, None, None)]
        blocks = -(-len(chunks) // BLOCK_BITS)
        padded = np.zeros(blocks * BLOCK_BITS, bool)
        padded[: len(chunks)] = goes_on
        ranks = np.zeros(blocks + 1, np.int64)
        np.cumsum(padded.reshape(blocks, BLOCK_BITS).sum(1), out=ranks[1:])
        levels.append((chunks, np.packbits(padded, bitorder="little"), ranks))
        rest = rest[goes_on]


class CodeFile:
    """Random access to a file of codes by range reads."""

    def __init__(self, uri: str):
        system, path = open_fs(uri)
        self.source = system.open_input_file(path)
        head = self.source.read_at(40, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"not a file of codes: {uri}")
        self.docs, self.n_ids, n_levels, self.n_null = np.frombuffer(head, "<i8", 4, 8).tolist()
        counts = np.frombuffer(self.source.read_at(8 * n_levels, 40), "<i8").tolist()
        self.at_docs = 40 + 8 * n_levels
        self.at_starts = self.at_docs + 8 * self.docs
        place, self.levels = self.at_starts + 8 * (self.docs + 1), []
        for k, n in enumerate(counts):
            blocks = -(-n // BLOCK_BITS) if k + 1 < n_levels else 0
            bits, ranks = place + n, place + n + blocks * BLOCK_BITS // 8
            self.levels.append((n, place, bits, ranks))
            place = ranks + 8 * (blocks + 1 if blocks else 0)

    def close(self) -> None:
        self.source.close()

    def _array(self, kind: str, n: int, place: int) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.frombuffer(self.source.read_at(n * width, place), kind)

    def doc_ids(self) -> np.ndarray:
        return self._array("<i8", self.docs, self.at_docs)

    def starts(self) -> np.ndarray:
        return self._array("<i8", self.docs + 1, self.at_starts)

    def token(self, i: int) -> int:
        """The i-th id of the file: a chunk, a bit and a rank on each level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value, shift = 0, 0
        for k, (_, chunks, bits, ranks) in enumerate(self.levels):
            value |= int(self._array("u1", 1, chunks + i)[0]) << shift
            if k + 1 == len(self.levels):
                break
            block, within = divmod(i, BLOCK_BITS)
            flags = np.unpackbits(self._array("u1", BLOCK_BITS // 8, bits + block * BLOCK_BITS // 8), bitorder="little")
            if not flags[within]:
                break
            i, shift = int(self._array("<i8", 1, ranks + 8 * block)[0]) + int(flags[:within].sum()), shift + 8
        return value

    def tokens(self, first: int, last: int) -> np.ndarray:
        """Ids first to last - 1: on each level one range of chunks, the bits of its blocks and one rank."""
        if not 0 <= first <= last <= self.n_ids:
            raise IndexError((first, last))
        values = np.zeros(last - first, np.uint32)
        where, shift = np.arange(last - first), 0
        for k, (_, chunks, bits, ranks) in enumerate(self.levels):
            n = last - first
            if not n:
                break
            values[where] |= self._array("u1", n, chunks + first).astype(np.uint32) << np.uint32(shift)
            if k + 1 == len(self.levels):
                break
            block, final = first // BLOCK_BITS, -(-last // BLOCK_BITS)
            flags = np.unpackbits(self._array("u1", (final - block) * BLOCK_BITS // 8, bits + block * BLOCK_BITS // 8), bitorder="little")
            skipped = first - block * BLOCK_BITS
            base = int(self._array("<i8", 1, ranks + 8 * block)[0]) + int(flags[:skipped].sum())
            on = np.flatnonzero(flags[skipped : skipped + n])
            first, last, where, shift = base, base + len(on), where[on], shift + 8
        return values


def write_file(uri: str, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, n_null: int = 0) -> None:
    """Write one file of codes at once; the first ``n_null`` documents have no id (their number there means nothing)."""
    levels = encode(ids)
    starts = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=starts[1:])
    with whole_file(uri) as out:
        out.write(MAGIC)
        out.write(np.array([len(counts), len(ids), len(levels), n_null, *(len(x[0]) for x in levels)], "<i8").tobytes())
        out.write(doc_ids.astype("<i8").tobytes())
        out.write(starts.astype("<i8").tobytes())
        for level in levels:
            for part in level:
                if part is not None:
                    out.write(part.tobytes())


def write_codes(docs: DataFrame, vocabulary: str, end_id: int, folder: str, *, id_column: str = "doc_id", text_column: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode whole texts (null: empty), append the end id to each, and write files of codes in ascending document id.

    Rows are dealt out and sorted by id, then by a hash of the text, so that rows of one id, or
    without an id (they come first), may be split over tasks; rows that repeat id and text are
    equal in any order.  A task writes a file whenever ``file_ids`` ids have come together, so its
    memory does not grow with its share; texts may be of any length.  Returns, lazily, one row a
    file: task, number (both in the order of the ids), file, n_docs, n_ids.  An empty table gives
    no files.
    """
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).withColumn("_h", F.xxhash64("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_h")]
    dealt = picked.repartitionByRange(*keys).sortWithinPartitions(*keys, "text").drop("_h")

    def write(batches):
        from pyspark import TaskContext

        from .tokens import encoder, with_end

        tool, task, number = encoder(vocabulary), TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # (document ids, ids, counts) of the file that grows
        n_held = 0

        def flush():
            nonlocal held, n_held, number
            own = pa.chunked_array([x[0] for x in held], pa.int64())
            ids, counts = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            file = f"part-{task:06d}-{number:06d}.dac"
            write_file(f"{folder}/{file}", own.fill_null(0).to_numpy(), counts, ids, own.null_count)
            row = pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([number], pa.int64()), pa.array([file]), pa.array([len(counts)]), pa.array([len(ids)])], ["task", "number", "file", "n_docs", "n_ids"])
            held, n_held, number = [], 0, number + 1
            return row

        for batch in batches:
            for a, b, ids, counts in tool.batches(batch.column(1)):
                ids, counts = with_end(ids, counts, end_id)
                held.append((batch.column(0).slice(a, b - a), ids.astype(np.uint32), counts))
                n_held += len(ids)
                if n_held >= file_ids:
                    yield flush()
        if held:
            yield flush()

    return dealt.mapInArrow(write, "task long, number long, file string, n_docs long, n_ids long")


def read_codes(manifest: DataFrame, folder: str, *, group_ids: int = 1 << 20) -> DataFrame:
    """A row for each document of the files, in file order: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The starts of files are summed in two steps, over a task's files and over the tasks, of which
    there is a row each.  Each file is decoded about ``group_ids`` ids at a time.
    """
    tasks = manifest.groupBy("task").agg(F.sum("n_ids").alias("n"))
    tasks = tasks.select(F.col("task").alias("_task"), (F.sum("n").over(W.orderBy("task")) - F.col("n")).alias("_before"))
    within = F.sum("n_ids").over(W.partitionBy("task").orderBy("number")) - F.col("n_ids")
    listed = manifest.withColumn("_within", within).join(tasks, F.col("task") == F.col("_task")).select("file", (F.col("_before") + F.col("_within")).alias("before"))
    listed = listed.repartition(int(max(1, min(20_000, manifest.count()))), "file")

    def read(batches):
        for batch in batches:
            for file, base in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                codes = CodeFile(f"{folder}/{file}")
                doc_ids, starts = codes.doc_ids(), codes.starts()
                a = 0
                while a < codes.docs:
                    b = min(codes.docs, max(a + 1, int(np.searchsorted(starts, starts[a] + group_ids, "right")) - 1))
                    ids = codes.tokens(int(starts[a]), int(starts[b])).astype("<u4")
                    cuts = (starts[a : b + 1] - starts[a]).tolist()
                    sums = [zlib.crc32(ids[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], mask=np.arange(a, b) < codes.n_null), pa.array(starts[a:b] + base), pa.array(np.diff(starts[a : b + 1])), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    a = b
                codes.close()

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int, *, id_column: str = "doc_id", text_column: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write every document's ids as codes into the shared folder and return what :func:`read_codes` reads back.

    A row for each row of ``docs``: null ids and texts, empty and very long texts, repeated ids
    and rows are kept (those of one id in the order of a hash of their text); an empty table gives none.
    """
    folder = fresh_path(docs.sparkSession, "codes")
    manifest = persist(write_codes(docs, vocabulary, end_id, folder, id_column=id_column, text_column=text_column, file_ids=file_ids), "manifest")
    return read_codes(manifest, folder)
