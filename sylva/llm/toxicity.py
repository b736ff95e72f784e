"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A window is a word behind a fixed lead (zstandard stores blocks of a few bytes as they are, and
the lead lifts a single word above that).  Its distance is the length it compresses to with the
ordinary dictionary less the length with the toxic one.  A document's windows are summed up by
their largest distance, by soft maxima and by how many reach a few distances; a logistic curve over
these, calibrated on labelled rows apart from those of the dictionaries, gives the score.

Most text of a toxic document is ordinary.  So the toxic dictionary is trained on those words of
toxic documents whose document frequency exceeds that in ordinary documents by a factor, each as
often as it occurs there; the ordinary dictionary on the words of ordinary documents.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .textkit import LOWER, span_hashes, text_slices, words_of

#: Bytes of words: letters, and all of longer characters.
WORD = np.zeros(256, bool)
WORD[97:123] = WORD[128:] = True
LEAD, LONGEST = b"~" * 8, 48
#: Labelled documents of each class that are sampled at most, and the bytes that such a document may have.
SAMPLE_DOCS, SAMPLE_BYTES = 4000, 30_000
TOXIC_DICT, ORDINARY_DICT, LEVEL = 4096, 65536, 19
#: Factor (as a logarithm) by which a toxic word's document frequency exceeds the ordinary one, and documents it is in at least.
EXCESS, LEAST_DOCS = 3.0, 3
#: Distances whose windows are counted; numbers that a document's windows are summed up by.
MARKS = (3, 5, 7)
N_FEATURES = 4 + len(MARKS)


@dataclass(frozen=True)
class Model:
    """Two dictionaries and a calibrated curve; ``weights`` are a constant and one for each number of the summary."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def _windows(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    data = LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends = _cut(*words_of(data, np.array([0, len(data)]), WORD)[:2])
    flat = data.tobytes()
    return [flat[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _cut(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words longer than LONGEST are cut into pieces of it."""
    n = -(-(ends - starts) // LONGEST)
    if len(n) and n.max() > 1:
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        first = np.repeat(starts, n) + step * LONGEST
        return first, np.minimum(first + LONGEST, np.repeat(ends, n))
    return starts, ends


def _dictionary(samples: list[bytes], size: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text itself
        return b"".join(dict.fromkeys(samples))[-size:]


def _distances(model: Model, windows: list[bytes]) -> np.ndarray:
    import zstandard

    found = []
    for raw in (model.ordinary, model.toxic):
        own = zstandard.ZstdCompressionDict(raw) if raw else None
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=LONGEST, dict_size=len(raw), min_match=3, write_checksum=0, write_content_size=0, write_dict_id=0)
        squeeze = zstandard.ZstdCompressor(dict_data=own, compression_params=params).compress
        found.append(np.fromiter((len(squeeze(LEAD + w + b" ")) for w in windows), np.int64, len(windows)))
    return found[0] - found[1]


def _summary(distances: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What the windows of each row say: the largest distance, the logarithms of the sum and mean of exp(2 * distance), of
    the numbers of windows at or above each of MARKS, and of the number of all; zeros without windows."""
    out = np.zeros((len(counts), N_FEATURES))
    full = np.flatnonzero(counts)
    if len(full):
        firsts = (np.cumsum(counts) - counts)[full]
        sums = np.add.reduceat(np.exp(2.0 * distances), firsts)
        out[full, 0] = np.maximum.reduceat(distances, firsts)
        out[full, 1] = np.log(sums)
        out[full, 2] = np.log(sums / counts[full])
        for k, mark in enumerate(MARKS):
            out[full, 3 + k] = np.log1p(np.add.reduceat((distances >= mark).astype(np.float64), firsts))
        out[full, -1] = np.log(counts[full])
    return out


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Weights of a logistic regression by Newton steps; a ridge on the standardised numbers keeps few rows from overfitting."""
    centre, spread = x.mean(0), x.std(0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    design = np.column_stack([np.ones(len(x)), (x - centre) / spread])
    w, penalty = np.zeros(design.shape[1]), np.full(design.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - y) + penalty * w
        bend = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-9)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    own = w[1:] / spread
    return (float(w[0] - (own * centre).sum()), *own.tolist())


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model of labelled texts (toxic: 1).  Equal texts count once; a third of them is kept for calibration.

    With one class only the score is that class's share for every text (no rows: 0).
    """
    texts = dict(sorted(rows))
    known = sorted(texts.items(), key=lambda r: zlib.crc32(r[0].encode("utf-8", "surrogatepass")))
    share = sum(label for _, label in known) / len(known) if known else 0.0
    if share in (0.0, 1.0):
        return Model(b"", b"", (30.0 if share else -30.0, *[0.0] * N_FEATURES))
    kept, dictionary = known[::3], [r for k, r in enumerate(known) if k % 3]
    if len({label for _, label in kept}) < 2 or len({label for _, label in dictionary}) < 2:
        kept = dictionary = known
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    size = Counter(label for _, label in dictionary)
    for text, label in dictionary:
        seen[label].update(set(_windows(text)))
    rate = lambda w, c: math.log((seen[c][w] + 0.1) / (size[c] + 0.2))
    marked = {w for w, n in seen[1].items() if n >= min(LEAST_DOCS, size[1]) and rate(w, 1) - rate(w, 0) > EXCESS}
    frame = lambda w: LEAD + w + b" "
    toxic = [frame(w) for w in sorted(marked) for _ in range(seen[1][w])]
    ordinary = [frame(w) for w, n in sorted(seen[0].items(), key=lambda x: (-x[1], x[0]))[:60_000] if w not in marked for _ in range(min(n, 20))]
    order = np.random.default_rng(1)
    order.shuffle(toxic)
    order.shuffle(ordinary)
    model = Model(_dictionary(toxic, TOXIC_DICT), _dictionary(ordinary, ORDINARY_DICT), ())
    place: dict[bytes, int] = {}  # a number for each window, so that texts are held as numbers
    windows = [np.array([place.setdefault(w, len(place)) for w in _windows(text)], np.int32) for text, _ in kept]
    distance = _distances(model, list(place))
    x = _summary(distance[np.concatenate(windows)], np.array([len(own) for own in windows]))
    return Model(model.toxic, model.ordinary, _curve(x, np.array([label for _, label in kept], float)))


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, *, label_column: str = "toxic", id_column: str = "doc_id", text_column: str = "text", n_docs: int = SAMPLE_DOCS, n_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """The rows of :func:`labelled_rows`, on the driver."""
    rows = labelled_rows(docs, labels, usable, label_column=label_column, id_column=id_column, text_column=text_column, n_docs=n_docs, n_bytes=n_bytes).collect()
    return [(r[0], r[1]) for r in rows]


def labelled_rows(docs: DataFrame, labels: DataFrame, usable: Column, *, label_column: str = "toxic", id_column: str = "doc_id", text_column: str = "text", n_docs: int = SAMPLE_DOCS, n_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``n_docs`` labelled texts of each class, of at most ``n_bytes`` each: those of the smallest hash of the id.

    ``usable``: a condition on ``doc_id`` for rows that may be learned from.  Rows without id,
    text or label are left out.
    """
    own = labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("_label")).where(F.col("doc_id").isNotNull() & F.col("_label").isin(0, 1) & usable)
    order = F.xxhash64("doc_id")
    picked = None
    for label in (0, 1):
        one = own.where(F.col("_label") == label).dropDuplicates(["doc_id"]).orderBy(order, "doc_id").limit(n_docs)
        picked = one if picked is None else picked.unionByName(one)
    picked = picked.select(F.col("doc_id").alias("_id"), "_label")  # its size is bounded: 2 * n_docs rows
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("_text")).where(F.col("_text").isNotNull() & (F.octet_length("_text") <= n_bytes))
    return texts.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("_text", "_label")


def fit_rows(rows: DataFrame) -> Model:
    """:func:`fit` of rows (text, label), whose number is bounded, in one task: the driver gets the model, never the texts."""

    def one(table: pa.Table) -> pa.Table:
        texts = [t.decode("utf-8", "replace") for t in table.column(0).cast(pa.binary()).to_pylist()]
        model = fit(list(zip(texts, table.column(1).to_pylist(), strict=True)))
        return pa.table({"toxic": pa.array([model.toxic], pa.binary()), "ordinary": pa.array([model.ordinary], pa.binary()), "weights": pa.array([model.weights], pa.list_(pa.float64()))})

    text, label = rows.columns
    found = rows.select(text, label, F.lit(0).alias("_all")).groupBy("_all").applyInArrow(one, "toxic binary, ordinary binary, weights array<double>").collect()
    return Model(bytes(found[0].toxic), bytes(found[0].ordinary), tuple(found[0].weights)) if found else fit([])


class _Scorer:
    """A worker's compressors, and the distances of windows that it has met (begun anew when too many)."""

    MOST = 1_500_000

    def __init__(self, model: Model):
        self.model, self.keys, self.values = model, np.empty(0, np.uint64), np.empty(0, np.int16)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys, sample, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.MOST:
            self.keys, self.values = self.keys[:0], self.values[:0]
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        if new.any():
            flat = data.tobytes()
            windows = [flat[a:b] for a, b in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist(), strict=True)]
            self.values = np.insert(self.values, at[new], _distances(self.model, windows).astype(np.int16))
            self.keys = np.insert(self.keys, at[new], keys[new])
        return self.values[np.searchsorted(self.keys, keys)][which].astype(np.float64)


def score_documents(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``keep`` beside doc_id, with score (0 to 1, higher: likelier toxic) for every whole text.

    Null and empty texts, and texts without words, get the curve's value for no window.  Null ids
    and repeated rows are kept; an empty table gives no rows.
    """
    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("_text"), *[F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)])
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in picked.schema if x.name != "_text") + ", score double"

    def score(batches):
        scorer = _Scorer(model)
        for batch in batches:
            found = []
            for _, _, data, offsets in text_slices(batch.column(1)):
                data = LOWER[data]
                starts, ends, _ = words_of(data, offsets, WORD)
                starts, ends = _cut(starts, ends)
                counts = np.diff(np.searchsorted(starts, offsets, "left"))
                x = _summary(scorer.of(data, starts, ends) if len(starts) else np.empty(0), counts)
                z = model.weights[0] + x @ np.array(model.weights[1:])
                found.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            scores = np.concatenate(found) if found else np.empty(0)
            rest = [batch.column(k) for k in range(batch.num_columns) if k != 1]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(scores)], [*(n for n in batch.schema.names if n != "_text"), "score"])

    scored = picked.mapInArrow(score, schema)
    return scored.select("doc_id", *[F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)], "score")
