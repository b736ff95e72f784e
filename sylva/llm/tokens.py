"""Token ids of whole texts, with the tokenizers library.

A space after a character that is not white space always begins a new pre-token of a byte-level
BPE vocabulary, and so does a mark after a letter, so a text may be cut there without changing its ids.  The pieces repeat a great
deal: each is hashed (vectorised), the library encodes the new ones, and ids are gathered.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from .textkit import ragged, span_hashes, text_slices

#: Pieces longer than this many bytes are encoded each time rather than kept.
KEEP_BYTES = 48
#: Ids and pieces that a worker keeps; beyond these it begins anew (bounds memory only).
KEEP_PIECES, KEEP_IDS = 500_000, 2_500_000
#: Pieces that the library encodes at once.
BATCH = 2048

#: ASCII letters; ASCII marks that are neither letters, digits nor white space.
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
MARK[33:127] = ~LETTER[33:127]
MARK[48:58] = False


class Encoder:
    """Encodes texts in bulk; one for each Python worker.

    Strings of the vocabulary's added tokens in a text become those tokens, as the library has it,
    unless ``ordinary``: then special ones are text like any other.
    """

    def __init__(self, path: str, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.tool = path, Tokenizer.from_file(path)
        self.tool.encode_special_tokens = ordinary
        added = self.tool.get_added_tokens_decoder().values()
        #: Strings that the library looks for before all else: a row that holds one is encoded whole.
        self.added = [t.content.encode() for t in added if not (ordinary and t.special)]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, np.uint64)  # sorted
        self.first = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each piece)"""
        found = []
        for k in range(0, len(pieces), BATCH):  # the library's results are large
            found += [x.ids for x in self.tool.encode_batch_fast(pieces[k : k + BATCH], add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self.keys) + len(keys) > KEEP_PIECES or len(self.ids) > KEEP_IDS:
            self._clear()
        raw = data.tobytes()
        ids, counts = self._encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        firsts = np.cumsum(counts) - counts + len(self.ids)
        where = np.searchsorted(self.keys, keys)
        self.ids = np.concatenate([self.ids, ids])
        self.first, self.count = np.insert(self.first, where, firsts), np.insert(self.count, where, counts)
        self.keys = np.insert(self.keys, where, keys)

    def _marked(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Rows that hold the string of an added token, ascending."""
        raw, rows = data.tobytes(), set()
        for mark in self.added:
            at = raw.find(mark)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(mark) <= offsets[row + 1]:
                    rows.add(row)
                at = raw.find(mark, at + 1)
        return sorted(rows)

    def flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row) of concatenated UTF-8 texts."""
        marked, parts, at = self._marked(data, offsets), [], 0
        for row in [*marked, len(offsets) - 1]:
            parts.append(self._flat(data[offsets[at] : offsets[row]], offsets[at : row + 1] - offsets[at]))
            if row < len(offsets) - 1:
                parts.append(self._encode([data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")]))
            at = row + 1
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`flat`, for rows without added tokens."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        space = data == 32
        prior = np.empty_like(data)
        prior[0], prior[1:] = 32, data[:-1]
        solid = (prior > 32) & (prior < 127)
        # after a character of several bytes, unless it may be white space (U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000)
        many = np.flatnonzero(space & (prior >= 128))
        if len(many):
            two, three = data[np.maximum(many - 2, 0)], data[np.maximum(many - 3, 0)]
            solid[many] = ~((two == 0xC2) | np.isin(three, (0xE1, 0xE2, 0xE3)))
        begin = space & solid
        # between a letter and a mark, before the first line end of a run, and between a lone line end and a letter: always a cut
        letter_before = LETTER[prior]
        begin |= letter_before & MARK[data]
        line = (data == 10) & solid
        begin |= line
        begin[1:] |= line[:-1] & LETTER[data[1:]]
        rows = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[rows] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        kept = np.flatnonzero(ends - starts <= KEEP_BYTES)
        keys = span_hashes(data, starts[kept], ends[kept])
        distinct, sample, which = np.unique(keys, return_index=True, return_inverse=True)
        self_at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            known = self.keys[np.minimum(self_at, len(self.keys) - 1)] == distinct
        if not known.all():
            if len(self.keys) + int((~known).sum()) > KEEP_PIECES or len(self.ids) > KEEP_IDS:
                self._clear()
                known[:] = False
            new = kept[sample[~known]]
            self._learn(data, distinct[~known], starts[new], ends[new])
        at = np.searchsorted(self.keys, distinct)[which]
        first, count = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        first[kept], count[kept] = self.first[at], self.count[at]
        pool = self.ids
        if len(kept) < len(starts):
            long = np.flatnonzero(ends - starts > KEEP_BYTES)
            raw = data.tobytes()
            ids, counts = self._encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
            first[long], count[long] = np.cumsum(counts) - counts + len(pool), counts
            pool = np.concatenate([pool, ids])
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        bounds = total[np.searchsorted(starts, offsets, "left")]
        return pool[ragged(first, count)], np.diff(bounds)

    def batches(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids, number of ids of each row), a few MB of text at a time."""
        for a, b, data, offsets in text_slices(column):
            ids, counts = self.flat(data, offsets)
            yield a, b, ids, counts


_KEPT: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, ordinary: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if (path, ordinary) not in _KEPT:
        _KEPT[path, ordinary] = Encoder(path, ordinary)
    return _KEPT[path, ordinary]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the end id after each row's, and the counts that include it."""
    ends = np.cumsum(counts)
    return np.insert(ids, ends, np.uint32(end_id)), counts + 1
