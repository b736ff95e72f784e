"""Best-fit packing of token pieces into sequences of fixed length, as a tree of residual rounds.

Round 0: the pieces are dealt into groups of bounded size by a hash; each group packs its own by
best fit, longest first.  Nearly full bins (a room of 1/1024 at most), and bins that no open bin of
any group fits into, are closed; the underfull ones become items of the next round, in which neighbouring groups merge until a group again holds
its bounded number of bins (or are dealt anew, if they cannot be fewer).  Rounds go on until one
group is left, or a round closes no bin and saves none; then what is open is closed as it is.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import forget, persist_at

#: Items (pieces, later bins) that one group packs at most, about (bounds a task's memory).
GROUP_ROWS = 60_000
#: A bin is nearly full, and closed, if its room is at most this part of the capacity (2 of 2048 tokens).
NEARLY = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of every document (null text: empty): its ids and the end id; only a longer document is cut.

    A cut document's pieces hold ``capacity`` ids, but for the first, which holds the remainder.
    Null ids and repeated rows are kept; further columns are not read.
    """
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def cut(batches):
        from .tokens import encoder, with_end

        tool = encoder(vocabulary)
        for batch in batches:
            for a, b, ids, counts in tool.batches(batch.column(1)):
                ids, counts = with_end(ids, counts, end_id)
                n_pieces = -(-counts // capacity)
                row = np.repeat(np.arange(b - a), n_pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                first = counts - (n_pieces - 1) * capacity
                length = np.where(piece == 0, first[row], capacity)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                cuts = np.concatenate([[0], np.cumsum(length)]).tolist()
                flat = ids.astype("<u4")
                sums = [zlib.crc32(flat[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return picked.mapInArrow(cut, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, its offset there): longest first, each to the open bin that it leaves least room in."""
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = bins = 0  # rooms: bit r is set if a bin has room r
    order = np.argsort(-sizes, kind="stable").tolist()
    lengths = sizes.tolist()
    for k in order:
        size = lengths[k]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, own, bins = capacity, bins, bins + 1
        where[k], offset[k] = own, capacity - room
        if room > size:
            by_room[room - size].append(own)
            rooms |= 1 << (room - size)
    return where, offset


def pack(pieces: DataFrame, capacity: int, *, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Give each piece (rows of :func:`cut_pieces`) a sequence_id and an offset in it.

    Sequences are gapless from 0 and hold at most ``capacity``; numbers of sequences are any.
    Pieces of length 0 or less, or above capacity, do not occur in :func:`cut_pieces` and are
    refused.  An empty table gives no rows.  Equal rows are packed each.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    written, path = persist_at(pieces, "pieces")
    n, low, high = written.agg(F.count("*"), F.min("length"), F.max("length")).first()
    if not n:
        return written.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if low < 1 or high > capacity:
        raise ValueError(f"lengths {low} to {high} do not fit 1 to {capacity}")
    groups = max(1, -(-n // group_rows))
    keyed = written.select(F.pmod(F.xxhash64(*columns), F.lit(groups)).alias("_group"), F.lit(None).cast("long").alias("_bin"), F.col("length").alias("_fill"), F.lit(0).cast("long").alias("_offset"), *columns)
    schema = keyed.schema
    closed: list[DataFrame] = []
    open_rows, round_no, before = keyed, 0, None
    while True:
        final = groups == 1
        result, path_now = persist_at(_round(open_rows, capacity, max(int(low), capacity // NEARLY + 1), round_no, final, schema), f"pack{round_no}")
        closed.append(result.where("_closed"))
        if final:
            break
        rest = result.where("NOT _closed")
        # bins that no other open bin fits into are done, whatever group that bin is in
        least = rest.agg(F.min("_fill")).first()[0]
        if least is None:
            break
        full = F.col("_fill") > capacity - least
        closed.append(rest.where(full))
        rest = rest.where(~full)
        bins = rest.agg(F.countDistinct("_bin")).first()[0]
        if not bins:
            break
        merged = max(1, -(-bins // group_rows))
        if merged >= groups and bins == before:  # nothing was closed or saved: what is open stays as it is
            closed.append(rest)
            break
        # groups that cannot be fewer are dealt anew, so that their bins meet others
        own = F.floor(F.col("_group") * merged / groups) if merged < groups else F.pmod(F.xxhash64("_bin", F.lit(round_no)), F.lit(groups))
        open_rows = rest.withColumn("_group", own).select(*[F.col(x.name).cast(x.dataType) for x in schema])
        groups, round_no, before = merged, round_no + 1, bins
    forget(spark, path)
    out = closed[0]
    for x in closed[1:]:
        out = out.unionByName(x)
    return out.select(*columns, F.col("_bin").alias("sequence_id"), F.col("_offset").alias("offset"))


def _round(rows: DataFrame, capacity: int, least: int, round_no: int, final: bool, schema) -> DataFrame:
    """Each group packs its items once: pieces in round 0, then bins with all their members; bins with less room than ``least`` are closed."""
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in schema) + ", _closed boolean"

    def one(table: pa.Table) -> pa.Table:
        group = table.column("_group")[0].as_py()
        fills = table.column("_fill").to_numpy()
        if table.column("_bin").null_count:
            members = np.arange(len(fills))
            sizes = fills
        else:
            _, firsts, members = np.unique(table.column("_bin").to_numpy(), return_index=True, return_inverse=True)
            sizes = fills[firsts]
        where, offset = best_fit(sizes, capacity)
        full = np.bincount(where, weights=sizes).astype(np.int64)
        # numbers are unique: round, group, place
        number = (np.int64(round_no) << 56) | (np.int64(group) << 26) | where[members]
        done = np.full(len(members), True) if final else (full > capacity - least)[where[members]]
        new = {"_bin": number, "_fill": full[where[members]], "_offset": table.column("_offset").to_numpy() + offset[members]}
        out = table
        for name, values in new.items():
            k = out.schema.get_field_index(name)
            out = out.set_column(k, pa.field(name, pa.int64()), pa.array(values))
        return out.append_column("_closed", pa.array(done))

    return rows.groupBy("_group").applyInArrow(one, fields)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, *, id_column: str = "doc_id", text_column: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Encode, cut and pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id; texts may be of any length; null ids,
    repeated ids and rows are packed each; an empty table gives no rows.
    """
    return pack(cut_pieces(docs, vocabulary, end_id, capacity, id_column=id_column, text_column=text_column), capacity, group_rows=group_rows)
