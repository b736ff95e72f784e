"""Token counts from flat, unindexed token files by a scan for separators.

A file is nothing but ids (little-endian, 2 bytes where the vocabulary allows it, else 4), each
document followed by a separator id.  The scan cuts every file into blocks of fixed size, finds
the separators of a block with one vectorised comparison, and stitches the documents that cross
blocks with a prefix scan over the blocks' summaries (a running count of separators and a running
maximum of the last separator's place).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .shared import fresh_path, open_fs, persist, whole_file

#: Ids in a block of the scan.
BLOCK_IDS = 1 << 20


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str, *, id_column: str = "doc_id", text_column: str = "text", id_bytes: int = 2) -> DataFrame:
    """Encode whole texts (null: empty) and write one flat file a task; a row for each document: file, place (from 0) and id.

    Ids in a file stand in the task's order of rows.  Null ids, repeated rows (also of different
    text) and empty texts are kept, and texts may be of any length; an empty table gives no files
    and no rows.  Columns besides the two are not read.  A special token's string in a text is
    ordinary text here, so that its id can part documents; an end id that still turns up within a
    text is refused, for the scan could not tell it from an end.
    """
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def write(batches):
        from pyspark import TaskContext

        from .tokens import encoder, with_end

        tool, name, place = encoder(vocabulary, ordinary=True), f"part-{TaskContext.get().partitionId():06d}.ids", 0
        kind = "<u2" if id_bytes == 2 else "<u4"

        with whole_file(f"{folder}/{name}") as out:
            for batch in batches:
                for a, b, ids, counts in tool.batches(batch.column(1)):
                    if (ids == end_id).any():
                        raise ValueError(f"the end id {end_id} occurs within a text; choose another")
                    ids, _ = with_end(ids, counts, end_id)
                    if id_bytes == 2 and len(ids) and int(ids.max()) > 0xFFFF:
                        raise ValueError("an id does not fit two bytes; use id_bytes=4")
                    out.write(ids.astype(kind).tobytes())
                    n = b - a
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(place, place + n)), batch.column(0).slice(a, n)], ["file", "place", "doc_id"])
                    place += n

    return picked.mapInArrow(write, "file string, place long, doc_id long")


def scan_token_files(spark: SparkSession, folder: str, end_id: int, *, id_bytes: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """A row for each separator-ended document of every file: file, place (from 0), start (id offset in the file) and n_tokens (without the separator).

    Ids after a file's last separator are one more document, with ``ended`` false.  Two separators
    in a row are an empty document.  The files are found by listing the folder; only their sizes
    are used to cut blocks, so one file may be of any size.
    """
    system, path = open_fs(folder)
    from pyarrow import fs

    found = [x for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.type == fs.FileType.File and x.base_name.endswith(".ids")]
    sizes = spark.createDataFrame([(x.base_name, x.size // id_bytes) for x in found], "file string, ids long")
    starts = sizes.where("ids > 0").select("file", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ids") - 1, F.lit(block_ids).cast("long"))).alias("at"))
    total = sum(x.size // id_bytes for x in found)
    blocks = starts.repartition(int(max(1, min(4096, total // (4 * block_ids) + 1))), "file", "at")

    def scan(batches):
        for batch in batches:
            for file, ids, at in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                own, where = open_fs(f"{folder}/{file}")
                with own.open_input_file(where) as source:
                    raw = source.read_at(min(block_ids, ids - at) * id_bytes, at * id_bytes)
                seen = np.flatnonzero(np.frombuffer(raw, "<u2" if id_bytes == 2 else "<u4") == end_id) + at
                last = at + block_ids >= ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([at]), pa.array([len(seen)]), pa.array([int(seen[-1]) if len(seen) else -1]), pa.array([seen.tolist()], pa.list_(pa.int64())), pa.array([ids if last else None], pa.int64())],
                    ["file", "at", "n_ends", "last_end", "ends", "file_ids"],
                )

    found_ends = persist(blocks.mapInArrow(scan, "file string, at long, n_ends long, last_end long, ends array<long>, file_ids long"), "ends")
    before = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    summary = found_ends.select(
        "file", "at",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("places_before"),
        F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("end_before"),
        "n_ends", "last_end", "file_ids",
    )
    stitched = found_ends.select("file", "at", "ends").join(summary, ["file", "at"])
    # the ends of a block, and at the file's last block the open document's end
    closes = F.greatest("end_before", "last_end")
    is_open = F.col("file_ids").isNotNull() & (closes + 1 < F.col("file_ids"))
    ends = F.when(is_open, F.concat("ends", F.array("file_ids"))).otherwise(F.col("ends"))
    each = stitched.select("file", "places_before", "end_before", "n_ends", ends.alias("ends")).select("file", "places_before", "end_before", "n_ends", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("end_before") + 1).otherwise(F.element_at("ends", F.greatest("k", F.lit(1))) + 1)
    return each.select("file", (F.col("places_before") + F.col("k")).alias("place"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), (F.col("k") < F.col("n_ends")).alias("ended"))


def token_counts(docs: DataFrame, vocabulary: str, end_id: int, *, id_column: str = "doc_id", text_column: str = "text", id_bytes: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Token count of each document (doc_id, n_tokens, file, start), read back from its flat file by the separator scan.

    Null or empty text: 0 tokens.  Repeated rows are counted each; null ids stay null.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "ids")
    written = persist(write_token_files(docs, vocabulary, end_id, folder, id_column=id_column, text_column=text_column, id_bytes=id_bytes), "places")
    scanned = scan_token_files(spark, folder, end_id, id_bytes=id_bytes, block_ids=block_ids)
    return written.join(scanned, ["file", "place"]).select("doc_id", "n_tokens", "file", "start")
