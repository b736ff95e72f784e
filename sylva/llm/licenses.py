"""Fuzzy search for short license notices.

A text becomes its words joined by single spaces.  A phrase that may be off by k edits is split
into k + 1 pieces; a text within k edits holds one of them unchanged, so exact finds of the pieces
locate all candidates.  Around each, the regex library's bounded-error matching verifies the
phrase and counts its edits; its place is reported in words.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .textkit import LOWER, ragged, text_slices, words_of

#: Bytes of words: digits, a-z, and all of longer characters.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


@dataclass(frozen=True)
class Notice:
    """A phrase of a license: its exact places count as base ones if ``base``; up to ``edits`` edits of characters otherwise."""

    label: str
    phrase: str
    edits: int = 0
    base: bool = False


NOTICES = (
    Notice("cc-by", "cc by", 0, True),
    Notice("gpl", "general public license", 2, True),
    Notice("reserved", "all rights reserved", 2, True),
    Notice("mit", "permission is hereby granted free of charge", 4),
    Notice("apache", "licensed under the apache license", 3),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("mpl", "mozilla public license", 2),
    Notice("gfdl", "free documentation license", 2),
    Notice("cc", "creative commons attribution", 3),
    Notice("cc0", "creative commons zero", 2),
    Notice("cc0", "dedicated to the public domain", 3),
    Notice("isc", "permission to use copy modify and or distribute this software", 5),
    Notice("lgpl", "lesser general public license", 2),
    Notice("agpl", "affero general public license", 2),
    Notice("epl", "eclipse public license", 2),
    Notice("cddl", "common development and distribution license", 4),
    Notice("bsl", "boost software license", 2),
    Notice("artistic", "the artistic license", 2),
    Notice("zlib", "freely subject to the following restrictions", 4),
    Notice("unlicense", "free and unencumbered software released into the public domain", 5),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 3),
    Notice("no-warranty", "without warranty of any kind express or implied", 4),
    Notice("proprietary", "unauthorized copying of this file", 3),
)

PLACES = "array<struct<label:string,start:long,end:long,edits:int,base:boolean>>"
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())]))


def seeds(notice: Notice) -> list[tuple[int, bytes]]:
    """(offset, piece) of a phrase's edits + 1 pieces."""
    raw = notice.phrase.encode()
    cuts = np.linspace(0, len(raw), notice.edits + 2).astype(int).tolist()
    return [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _finds(raw: bytes, piece: bytes):
    at = raw.find(piece)
    while at >= 0:
        yield at
        at = raw.find(piece, at + 1)


def _exact(raw: bytes, phrase: bytes):
    """Places of a phrase whose words stand consecutively."""
    for at in _finds(raw, phrase):
        end = at + len(phrase)
        if (at == 0 or raw[at - 1] in b" \n") and (end == len(raw) or raw[end] in b" \n"):
            yield at, end


class _Finder:
    def __init__(self, notices: Sequence[Notice]):
        import regex

        self.notices = notices
        self.tests = [regex.compile(rf"(?e)(?<!\S)(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={n.edits}}}(?!\S)") for n in notices]

    def places(self, raw: bytes) -> list[tuple[int, int, int, int]]:
        """(number of the notice, first byte, byte after the last, edits) in lines of normalised texts."""
        found = []
        for k, notice in enumerate(self.notices):
            exact = list(_exact(raw, notice.phrase.encode()))
            found += [(k, a, b, 0) for a, b in exact]
            if not notice.edits:
                continue
            width, windows = len(notice.phrase), []
            # an edit may stand for a character of up to four bytes
            slack = 4 * notice.edits + 1
            for offset, piece in seeds(notice):
                for at in _finds(raw, piece):
                    a, b = max(0, at - offset - slack), min(len(raw), at - offset + width + slack)
                    line = raw.rfind(b"\n", a, at)  # not beyond the document
                    a = line + 1 if line >= 0 else a
                    line = raw.find(b"\n", at, b)
                    b = line if line >= 0 else b
                    windows.append((a, b))
            # exact places in order: their starts and ends both ascend
            starts, ends = [x for x, _ in exact], [y for _, y in exact]
            merged: list[list[int]] = []
            for a, b in sorted(set(windows)):  # windows of two lines never touch
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                # whole words only
                while a > 0 and raw[a - 1] not in b" \n":
                    a -= 1
                while b < len(raw) and raw[b] not in b" \n":
                    b += 1
                text = raw[a:b].decode("utf-8", "replace")
                at, byte = 0, a  # a place in the text and its byte: matches come in order
                for m in self.tests[k].finditer(text, overlapped=False):
                    if not m[0]:
                        continue
                    x = byte + len(text[at : m.start()].encode("utf-8", "replace"))
                    y = x + len(m[0].encode("utf-8", "replace"))
                    at, byte = m.end(), y
                    while x < y and raw[x] == 32:  # an insertion at an end
                        x += 1
                    while y > x and raw[y - 1] == 32:
                        y -= 1
                    near = bisect_right(ends, x)  # the first exact place that ends beyond x
                    if near == len(ends) or starts[near] >= y:
                        found.append((k, x, y, sum(m.fuzzy_counts)))
        return found


def find_notices(docs: DataFrame, notices: Sequence[Notice] = NOTICES, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, places) of every whole text; a place has label, start and end (words from 0, end exclusive), edits and base.

    Places are sorted by start, end, label; base ones are exact.  An inexact place that overlaps an
    exact one of its phrase is not listed.  Null and empty texts have no words and no places; null
    ids and repeated rows (also of different text) are kept, texts are whole, of any length; an
    empty table gives no rows; further columns are not read.
    """
    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("_text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    notices = tuple(notices)

    def search(batches):
        finder = _Finder(notices)
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                data = LOWER[data]
                starts, ends, before = words_of(data, offsets, WORD)
                lengths = ends - starts
                n = len(starts)
                flat = np.full(int(lengths.sum()) + n, 32, np.uint8)
                at = np.cumsum(lengths + 1) - (lengths + 1)  # where each word goes
                flat[ragged(at, lengths)] = data[ragged(starts, lengths)]
                finals = before[1:][before[1:] > before[:-1]] - 1
                flat[at[finals] + lengths[finals]] = 10
                rows: dict[int, list] = {}
                for k, x, y, edits in finder.places(flat.tobytes()):
                    first, last = int(np.searchsorted(at, x, "right")) - 1, int(np.searchsorted(at, y, "left"))
                    row = int(np.searchsorted(before, first, "right")) - 1
                    notice = notices[k]
                    rows.setdefault(row, []).append((first - int(before[row]), last - int(before[row]), notice.label, edits, notice.base and edits == 0))
                places = [[{"label": p[2], "start": p[0], "end": p[1], "edits": p[3], "base": p[4]} for p in sorted(set(rows[k]))] if k in rows else [] for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(before)), pa.array(places, _PLACES)], ["doc_id", "n_words", "places"])

    return picked.mapInArrow(search, f"doc_id {kind}, n_words long, places {PLACES}")


def labels_of(places: Column) -> Column:
    """Distinct labels, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def place_text(places: Column) -> Column:
    """label:start:end:edits of each place, comma-joined."""
    return F.array_join(F.transform(places, lambda p: F.concat_ws(":", p["label"], *[p[x].cast("string") for x in ("start", "end", "edits")])), ",")


def certainty(places: Column) -> Column:
    """1 with an exact place, less by 1/8 for each edit of the best inexact one, 0 without a place."""
    best = F.array_min(F.transform(places, lambda p: p["edits"]))
    return F.when(F.size(places) == 0, 0.0).otherwise(1.0 - F.least(best, F.lit(7)) / 8.0)
