"""N-gram Jaccard self-join with token-combination prefixes; links become components.

Texts are sets of 64-bit shingle hashes.  Equal sets are one class from the start (a 64-bit
fingerprint of the sorted set).  Every class with a link shares with its partner a signature:

* Shingles that occur in many classes are *frequent*, all others rare.  The global order is rare
  shingles by hash, then frequent ones by group and hash.
* A set of n shingles may lack e = n - ceil(threshold * n) of them in a partner.  If it has e + 1
  rare shingles, the first e + 1 are its signatures (single tokens).
* Else all its rare shingles are, and the prefix is extended into the frequent ones: a group of g
  of them yields all its pairs as signatures, and g - 1 of the missing places; groups are added
  until e + 1 places are covered.  Partners that share no signature share at most one shingle of
  a group, so one of them would lack e + 1.  Groups are cut by hash, about two tokens of a set
  each, for the size class of the set and the next one (partners are at most one class apart).

Postings are packed into binary blocks of a bucket of the hash space, so that the shuffle moves a
few large rows.  Short lists propose all their pairs.  Long lists (those of one least member taken
together) propose that member with every other; after those are verified and joined into
components, their largest component sends a few more members to the rest, and then they propose
only the pairs that lie across components.  Candidates are first sifted by bitmaps of their sets, which prove most that
share no more than a passage to be too far apart, and the rest are verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import passing, persist
from .textkit import LOWER, NOT_SPACE, mix, span_hashes, text_slices, words_of

#: A shingle in so many classes (told apart by a byte of their fingerprints) is frequent; lists up to this long propose all pairs.
FREQUENT = 24
#: Frequent shingles that are broadcast at most (8 bytes each): the rarest are called rare beyond.
MOST_FREQUENT = 2_000_000
#: Shingles that a bucket of the hash space holds, about.
BUCKET = 1 << 19
#: Pairs verified in one group, about.
GROUP_PAIRS = 512
#: Members that a long list's largest component sends to the rest before pairs across components are proposed; members of lists on one side of a tile, about.
LEADERS, TILE_ROWS = 8, 512
#: Candidate ids that are broadcast as they are; beyond, as a Bloom filter of as many bytes.
MOST_IDS = 2_000_000

_WAYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], np.uint64)


def shingle_sets(column: pa.Array, size: int):
    """(first row, row after the last, list of sorted distinct hashes of each row's shingles): whole texts, A-Z lowered."""
    ways = np.array([int(_WAYS[k % 8]) * (2 * (k // 8) + 1) % 2**64 for k in range(size)], np.uint64)
    for a, b, data, offsets in text_slices(column):
        data = LOWER[data]
        starts, ends, before = words_of(data, offsets, NOT_SPACE)
        words = span_hashes(data, starts, ends)
        n = len(words) - size + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for k in range(size):
            if n > 0:
                rolled += words[k : k + n] * ways[k]
        rolled = mix(rolled)
        found = []
        for x, y in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if y - x >= size:
                own = _distinct(rolled[x : y - size + 1])
            elif y > x:
                own = mix(np.array([(words[x:y] * ways[: y - x]).sum(dtype=np.uint64) + np.uint64(y - x)], np.uint64))
            else:
                own = np.empty(0, np.uint64)
            found.append(own)
        yield a, b, found


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (a sort: faster here than hashing)."""
    values = np.sort(values)
    if not len(values):
        return values
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair (a, b) once."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _bitmap(own: np.ndarray) -> bytes:
    """Which of about four to eight times as many places as shingles the hashes fall on; a longer map folds onto a shorter one."""
    size = max(64, 1 << int(4 * len(own) - 1).bit_length())
    marks = np.zeros(size, bool)
    marks[(own & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(marks).tobytes()


def _may_link(x: bytes, y: bytes, n_x: int, n_y: int, percent: int) -> bool:
    """False if the bitmaps prove that one set lacks more of the other than it may."""
    if percent * max(n_x, n_y) > 100 * min(n_x, n_y):
        return False
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    a = np.bitwise_or.reduce(a.reshape(-1, size)) if len(a) > size else a
    b = np.bitwise_or.reduce(b.reshape(-1, size)) if len(b) > size else b
    # what is missing on either side: at most n_x + n_y - 2 * (least intersection)
    lacking = int(np.bitwise_count(a ^ b).sum())
    return lacking <= n_x + n_y - 2 * -(-percent * (n_x + n_y) // (100 + percent))


def _fingerprint(own: np.ndarray) -> int:
    import xxhash

    value = xxhash.xxh3_64_intdigest(own.tobytes())
    return value - (1 << 64) if value >> 63 else value


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, width) bytes of 64-bit numbers, high byte first."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]


def _unpack(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - raw.shape[1] :] = raw
    return out.view(">u8").reshape(-1).astype(np.uint64)


def _blocks(keys: np.ndarray, rows: np.ndarray, buckets: int):
    """(bucket, bytes of its rows) of keys of 40 bits in ascending order."""
    which = ((keys * np.uint64(buckets)) >> np.uint64(40)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(which, prepend=-1))
    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
        yield int(which[x]), rows[x:y].tobytes()


def _missing(n: np.ndarray | int, percent: int):
    """Shingles of a set that a partner may lack."""
    return n - -(-n * percent // 100)


def _signatures(own: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Signature keys (40 bits) of a set."""
    n = len(own)
    need = _missing(n, percent) + 1
    short = own >> np.uint64(24)
    often = np.zeros(n, bool)
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, short), len(frequent) - 1)] == short
    rare = short[~often]
    if len(rare) >= need:
        return rare[:need]
    left, dense, out = need - len(rare), mix(own[often]), [rare]
    if n == 1:
        return rare  # a lone frequent shingle: partners are equal sets
    size_class = int(np.log(n) / np.log(100 / percent))
    for key in (size_class, size_class + 1):
        groups = np.uint64(max(1, round((100 / percent) ** key / 2)))
        group = dense % groups
        order = np.lexsort((dense, group))
        tokens, group = dense[order], group[order]
        firsts = np.flatnonzero(np.diff(group, prepend=np.uint64(2**63)))
        lengths = np.diff(np.append(firsts, len(group)))
        covered = np.cumsum(lengths - 1)
        last = min(int(np.searchsorted(covered, left)), len(covered) - 1)
        salt = np.uint64(key * 0x9E3779B97F4A7C15 % 2**64)
        for k in range(last + 1):
            x, g = tokens[firsts[k] : firsts[k] + lengths[k]], int(lengths[k])
            if g > 1:
                i, j = np.triu_indices(g, 1)
                out.append(mix(x[i] * _WAYS[0] + x[j] * _WAYS[1] + salt) >> np.uint64(24))
    return np.concatenate(out)


def _size_class(n: int, percent: int) -> int:
    return int(np.log(n) / np.log(100 / percent))


def _frequent(docs: DataFrame, size: int, buckets: int, least: int) -> DataFrame:
    """(token, classes): shingles (first 40 bits) by how many bytes of fingerprints they occur with, if ``least`` or more."""

    def emit(batches):
        for batch in batches:
            for _, _, sets in shingle_sets(batch.column(1), size):
                full = [x for x in sets if len(x)]
                if not full:
                    continue
                marks = np.repeat(np.array([_fingerprint(x) & 0xFF for x in full], np.uint64), [len(x) for x in full])
                values = _distinct(((np.concatenate(full) >> np.uint64(24)) << np.uint64(8)) | marks)
                found = list(_blocks(values >> np.uint64(8), _pack(values, 6), buckets))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.binary())], ["bucket", "raw"])

    def count(table: pa.Table) -> pa.Table:
        raw = np.concatenate([np.frombuffer(x.as_py(), np.uint8).reshape(-1, 6) for x in table.column("raw")])
        tokens = _distinct(_unpack(raw)) >> np.uint64(8)
        firsts = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
        tokens, classes = tokens[firsts], np.diff(np.append(firsts, len(tokens)))
        kept = classes >= least
        return pa.table({"token": pa.array(tokens[kept].astype(np.int64)), "classes": pa.array(classes[kept].astype(np.int32))})

    return docs.mapInArrow(emit, "bucket long, raw binary").groupBy("bucket").applyInArrow(count, "token long, classes int")


def _lists(docs: DataFrame, frequent, size: int, percent: int, buckets: int, longest: int) -> DataFrame:
    """Proposals of the signature lists: pairs (a, b) of short ones, and members (long_list, a) of long ones.

    Long lists of one least member are taken as one list under its name: the copies of a text
    share thousands of long lists, and few of those differ in their least member.
    """

    def emit(batches):
        often = frequent.value
        for batch in batches:
            for _, _, sets in shingle_sets(batch.column(1), size):
                keys, marks, classes = [], [], []
                for own in sets:
                    if len(own):
                        found = _signatures(own, often, percent)
                        keys.append(found)
                        marks.append(np.full(len(found), np.int64(_fingerprint(own))))
                        classes.append(np.full(len(found), _size_class(len(own), percent), np.uint8))
                if not keys:
                    continue
                flat = np.concatenate(keys)
                rows = np.concatenate([_pack(flat, 5), _pack(np.concatenate(marks).view(np.uint64), 8), np.concatenate(classes)[:, None]], 1)
                order = np.argsort(flat)
                found = list(_blocks(flat[order], rows[order], buckets))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.binary())], ["bucket", "raw"])

    def propose(table: pa.Table) -> pa.Table:
        raw = np.concatenate([np.frombuffer(x.as_py(), np.uint8).reshape(-1, 14) for x in table.column("raw")])
        keys, marks, classes = _unpack(raw[:, :5]), _unpack(raw[:, 5:13]).view(np.int64), raw[:, 13].astype(np.int64)
        order = np.lexsort((marks, keys))
        keys, marks, classes = keys[order], marks[order], classes[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (marks[1:] != marks[:-1])  # copies meet here
        keys, marks, classes = keys[new], marks[new], classes[new]
        firsts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        lengths = np.diff(np.append(firsts, len(keys)))
        left, right, long_keys, long_marks = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for m in np.unique(lengths[(lengths > 1) & (lengths <= longest)]).tolist():  # all lists of one length at once
            at = firsts[lengths == m][:, None] + np.arange(m)
            i, j = np.triu_indices(m, 1)
            near = np.abs(classes[at[:, i]] - classes[at[:, j]]) <= 1
            left.append(marks[at[:, i]][near])
            right.append(marks[at[:, j]][near])
        for k in np.flatnonzero(lengths > longest):
            own = marks[firsts[k] : firsts[k] + lengths[k]]
            long_marks.append(own)
            long_keys.append(np.full(len(own), own[0]))  # lists of one least member are one
        pair_a, pair_b = _distinct_pairs(np.concatenate(left), np.concatenate(right))
        list_key, list_mark = _distinct_pairs(np.concatenate(long_keys), np.concatenate(long_marks))
        n, m = len(pair_a), len(list_key)
        a = pa.array(np.concatenate([pair_a, list_mark]))
        b = pa.array(np.concatenate([pair_b, np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n)
        lists = pa.array(np.concatenate([np.zeros(n, np.int64), list_key]), mask=np.arange(n + m) < n)
        return pa.table({"a": a, "b": b, "long_list": lists})

    return docs.mapInArrow(emit, "bucket long, raw binary").groupBy("bucket").applyInArrow(propose, "a long, b long, long_list long")


def _id_filter(spark, ids: DataFrame):
    """A broadcast test of ids, of bounded size: the ids themselves, or a Bloom filter (false positives only cost time)."""
    n = ids.count()
    if n <= MOST_IDS:
        own = np.sort(np.fromiter((r[0] for r in ids.toLocalIterator()), np.int64, n))
        return spark.sparkContext.broadcast(("ids", own))
    bits = 8 * 8 * MOST_IDS
    words = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(bits)) for k in range(2)])).alias("bit")).groupBy(F.floor(F.col("bit") / 32).alias("word")).agg(F.bit_or(F.pow(F.lit(2.0), F.col("bit") % 32).cast("long")).alias("mask"))
    table = np.zeros(bits // 32, np.uint32)
    for word, mask in words.toLocalIterator():
        table[word] = mask
    return spark.sparkContext.broadcast(("bloom", table))


def _sift(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the bitmaps do not prove to be too far apart."""
    both = pairs.select("a", "b")
    for side in ("a", "b"):
        both = both.join(classes.select(F.col("mark").alias(side), F.col("n").alias(f"n_{side}"), F.col("bitmap").alias(f"bitmap_{side}")), side)

    def sift(batches):
        for batch in batches:
            x, y, n, m = (batch.column(name).to_pylist() for name in ("bitmap_a", "bitmap_b", "n_a", "n_b"))
            keep = pa.array([_may_link(*z, percent) for z in zip(x, y, n, m, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return both.mapInArrow(sift, "a long, b long")


def _sets(docs: DataFrame, marks: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(mark, raw): the whole sets of some classes, from one scan of the texts."""
    reps = persist(marks.join(classes, "mark").select(F.col("row").alias("id"), "mark"), "reps")
    test = _id_filter(docs.sparkSession, reps.select("id"))

    def sets_of(batches):
        kind, table = test.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if kind == "ids":
                keep = np.zeros(len(ids), bool) if not len(table) else table[np.minimum(np.searchsorted(table, ids), len(table) - 1)] == ids
            else:
                keep = np.ones(len(ids), bool)
                for k in (2, 3):  # its two bits
                    bit = batch.column(k).to_numpy(zero_copy_only=False)
                    keep &= (table[bit // 32] >> (bit % 32).astype(np.uint32)) & 1 == 1
            some = np.flatnonzero(keep)
            if not len(some):
                continue
            part = batch.column(1).take(pa.array(some))
            for a, b, sets in shingle_sets(part, size):
                own = ids[some[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([_fingerprint(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "mark", "raw"])

    bits = 8 * 8 * MOST_IDS
    read = docs if test.value[0] == "ids" else docs.select("*", *[F.pmod(F.xxhash64("_row", F.lit(k)), F.lit(bits)).alias(f"_bit{k}") for k in range(2)])
    found = read.mapInArrow(sets_of, "id long, mark long, raw binary")
    # a row that shares an id with a wanted one may bring a set that nobody asked for, or one twice: neither does harm
    return persist(found.join(reps.select(F.col("id").alias("x"), F.col("mark").alias("w")), (F.col("id") == F.col("x")) & (F.col("mark") == F.col("w")), "left_semi").select("mark", "raw"), "sets")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of fingerprints whose sets reach the threshold, written down."""
    # pairs of one left side are verified together; a crowd of them is split
    pairs = persist(pairs, "pairs")
    crowd = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP_PAIRS).alias("parts")).select(F.col("a").alias("w"), "parts")
    placed = persist(pairs.join(crowd, F.col("a") == F.col("w")).select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))).alias("grp")), "placed")
    wanted = placed.select("grp", F.col("a").alias("own")).unionByName(placed.select("grp", F.col("b").alias("own"))).distinct()
    # each set goes once to each of its groups
    sent = wanted.join(sets, F.col("own") == F.col("mark")).select(F.col("grp").alias("own_grp"), "mark", "raw")

    def test_group(left: pa.Table, right: pa.Table) -> pa.Table:
        sets_here = {m: np.frombuffer(r.as_py(), np.uint64) for m, r in zip(right.column("mark").to_pylist(), right.column("raw"), strict=True)}
        kept = []
        for x, y in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True):
            s, t = sets_here[x], sets_here[y]
            if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                kept.append(False)
                continue
            if len(s) > len(t):
                s, t = t, s
            common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
            kept.append(100 * common >= percent * (len(s) + len(t) - common))
        keep = pa.array(kept, pa.bool_())
        return pa.table({"a": left.column("a").filter(keep), "b": left.column("b").filter(keep)})

    return persist(placed.groupBy("grp").cogroup(sent.groupBy("own_grp")).applyInArrow(test_group, "a long, b long"), "links")


def jaccard_components(docs: DataFrame, *, size: int = 5, percent: int = 75, id_column: str = "doc_id", text_column: str = "text", frequent: int = FREQUENT, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document: its set's size and the least id that links reach.

    Words are runs of other than ASCII white space; a text of fewer than ``size`` words is one
    shingle; null and empty texts have none and link with nothing.  Two documents link when
    100 * intersection >= percent * union (percent from 50 to 99).  Repeated rows are linked with
    each other; a row with a null id is kept, links like any other and never names a component
    (if a component has no other, its id is null).  Texts are whole, of any length.  An empty table gives no rows.
    """
    if not 50 <= percent <= 99:
        raise ValueError("percent must lie between 50 and 99")
    with passing(docs.sparkSession):  # all but the last two tables go
        named, least = _joined(docs, size, percent, id_column, text_column, frequent, bucket)
    return named.join(least, "_component", "left").select("doc_id", "n_shingles", F.when(F.col("mark").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _joined(docs: DataFrame, size: int, percent: int, id_column: str, text_column: str, frequent: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their component, least ids of components), written down."""
    spark = docs.sparkSession
    own_id = F.col(id_column).cast("long")
    # a row without an id is told by a hash of its text
    picked = docs.select(F.coalesce(own_id, F.xxhash64(F.col(text_column))).alias("_row"), F.col(text_column).alias("_text"), own_id.alias("_id"))

    def meta(batches):
        for batch in batches:
            for a, b, sets in shingle_sets(batch.column(1), size):
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a), batch.column(0).slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array([_fingerprint(x) if len(x) else None for x in sets], pa.int64()), pa.array([_bitmap(x) if len(x) else None for x in sets], pa.binary())], ["doc_id", "row", "n_shingles", "mark", "bitmap"])

    sizes = persist(picked.mapInArrow(meta, "doc_id long, row long, n_shingles long, mark long, bitmap binary"), "sizes")
    # the row that stands for its class in verification
    classes = persist(sizes.where("mark IS NOT NULL").groupBy("mark").agg(F.min("row").alias("row"), F.first("n_shingles").alias("n"), F.first("bitmap").alias("bitmap")), "classes")
    total = sizes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(1, min(1 << 20, -(-total // bucket)))
    often = persist(_frequent(picked, size, buckets, frequent), "frequent")
    level = frequent
    while (n_often := often.where(F.col("classes") >= level).count()) > MOST_FREQUENT:
        level *= 2
    tokens = np.sort(np.fromiter((r[0] for r in often.where(F.col("classes") >= level).select("token").toLocalIterator()), np.int64, n_often)).astype(np.uint64)
    picked = picked.drop("_id")
    found = persist(_lists(picked, spark.sparkContext.broadcast(tokens), size, percent, buckets, level), "lists")
    members = persist(found.where("b IS NULL").select("long_list", F.col("a").alias("mark")).distinct(), "members")
    first = found.where("b IS NOT NULL").select("a", "b").unionByName(members.where("long_list <> mark").select(F.col("long_list").alias("a"), F.col("mark").alias("b"))).distinct()
    pairs = persist(_sift(first, classes, percent), "candidates")
    wanted = pairs.select(F.col("a").alias("mark")).unionByName(pairs.select(F.col("b").alias("mark"))).unionByName(members.select("mark")).distinct()
    sets = _sets(picked, wanted, classes, size)
    joined = persist(components(_verify(pairs, sets, percent)), "components")
    # the largest component of each long list sends some of its members to the rest
    own = persist(_mixed(members, joined), "mixed")
    if not own.isEmpty():
        each = own.groupBy("long_list", "component").agg(F.count("*").alias("k"))
        main = each.groupBy("long_list").agg(F.max(F.struct("k", "component")).alias("x")).select(F.col("long_list").alias("w"), F.col("x.component").alias("main"))
        sided = own.join(main, F.col("long_list") == F.col("w")).drop("w")
        lead = sided.where("component = main").withColumn("slot", F.pmod(F.xxhash64("mark"), F.lit(LEADERS))).groupBy("long_list", "slot").agg(F.min(F.struct(F.xxhash64("mark", F.lit(1)).alias("h"), "mark")).alias("x")).groupBy("long_list").agg(F.collect_list("x.mark").alias("leads")).select(F.col("long_list").alias("w"), "leads")
        asked = sided.where("component <> main").join(lead, F.col("long_list") == F.col("w")).select("mark", F.explode("leads").alias("lead")).select(F.least("mark", "lead").alias("a"), F.greatest("mark", "lead").alias("b")).distinct()
        joined = _more(joined, _verify(_sift(asked, classes, percent), sets, percent))
        # what is still apart is compared in full
        crossing = _crossing(_mixed(own.select("long_list", "mark"), joined), classes, percent).distinct()
        joined = _more(joined, _verify(crossing, sets, percent))
    # written down, so that the join on components is a plain one, of which Spark may split a large component's side
    named = persist(sizes.join(joined.select(F.col("node").alias("mark"), F.col("component").alias("_component")), "mark", "left").select("doc_id", "n_shingles", "mark", F.coalesce("_component", "mark").alias("_component")), "named", keep=True)
    least = persist(named.where("_component IS NOT NULL").groupBy("_component").agg(F.min("doc_id").alias("component_id")), "least", keep=True)
    return named, least


def _more(joined: DataFrame, links: DataFrame) -> DataFrame:
    """Components with further links."""
    if links.isEmpty():
        return joined
    return persist(components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)), "components")


def _mixed(members: DataFrame, joined: DataFrame) -> DataFrame:
    """(long_list, mark, component) of the long lists whose members are in more than one component."""
    own = members.join(joined.select(F.col("node").alias("mark"), "component"), "mark", "left").select("long_list", "mark", F.coalesce("component", "mark").alias("component"))
    mixed = own.groupBy("long_list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("long_list")
    return own.join(mixed, "long_list", "left_semi")


def _crossing(own: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of a long list's members in different components that the bitmaps let pass.

    Lists that share their largest component mostly repeat each other's pairs: they are worked on
    together, and each pair is looked at once there.  The members of such a group are cut into
    chunks by hash, those of the largest component (which never pair among themselves) apart from
    the rest; a tile is a chunk of the rest with another, or with one of the largest component, so
    no task holds more than two chunks, whatever the size of the group.
    """
    each = own.groupBy("long_list", "component").agg(F.count("*").alias("k"))
    main = each.groupBy("long_list").agg(F.max(F.struct("k", "component")).alias("x")).select(F.col("long_list").alias("w"), F.col("x.component").alias("main"))
    sided = own.join(main, F.col("long_list") == F.col("w")).select("main", (F.col("component") == F.col("main")).alias("inner"), "long_list", "mark", "component")
    chunks = sided.groupBy("main").agg(*[F.ceil(F.count_if(side) / TILE_ROWS).alias(name) for side, name in ((~F.col("inner"), "rest_chunks"), (F.col("inner"), "main_chunks"))]).withColumnRenamed("main", "w")
    cut = lambda name: F.pmod(F.xxhash64("mark"), F.col(name))
    count = lambda name: F.sequence(F.lit(0).cast("long"), F.col(name) - 1)
    # a row of the rest meets all chunks of the rest (as the left or the right side) and all of the largest component
    with_rest = F.transform(count("rest_chunks"), lambda k: F.struct(F.least(k, F.col("c")).alias("x"), F.greatest(k, F.col("c")).alias("y"), F.lit(False).alias("m")))
    with_main = F.transform(count("main_chunks"), lambda k: F.struct(F.col("c").alias("x"), k.alias("y"), F.lit(True).alias("m")))
    from_main = F.transform(count("rest_chunks"), lambda k: F.struct(k.alias("x"), F.col("c").alias("y"), F.lit(True).alias("m")))
    placed = sided.join(chunks, F.col("main") == F.col("w")).withColumn("c", F.when(F.col("inner"), cut("main_chunks")).otherwise(cut("rest_chunks")))
    placed = placed.withColumn("tile", F.explode(F.when(F.col("inner"), from_main).otherwise(F.concat(with_rest, with_main))))
    rows = placed.join(classes.select("mark", "n", "bitmap"), "mark").select("main", "tile", F.when(F.col("tile.m"), F.col("inner")).otherwise(F.col("c") == F.col("tile.y")).alias("right"), (~F.col("tile.m") & (F.col("tile.x") == F.col("tile.y"))).alias("same"), "long_list", "mark", "component", "n", "bitmap")

    def cross(table: pa.Table) -> pa.Table:
        lists, marks, comps, sizes = (table.column(x).to_numpy() for x in ("long_list", "mark", "component", "n"))
        right, same = (table.column(x).to_numpy(zero_copy_only=False).astype(bool) for x in ("right", "same"))
        known, firsts, place = np.unique(marks, return_index=True, return_inverse=True)
        maps, sizes, seen = table.column("bitmap").take(pa.array(firsts)).to_pylist(), sizes[firsts], np.empty(0, np.int64)
        order = np.argsort(lists, kind="stable")
        cuts = np.flatnonzero(np.diff(lists[order], prepend=~lists[order][:1]))
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            rows_here = order[x:y]
            here, there = (rows_here, rows_here) if same[0] else (rows_here[~right[rows_here]], rows_here[right[rows_here]])
            i, j = np.nonzero(comps[here][:, None] != comps[there][None, :])
            a, b = place[here[i]], place[there[j]]
            near = (percent * np.maximum(sizes[a], sizes[b]) <= 100 * np.minimum(sizes[a], sizes[b])) & ((a < b) | ~same[0])
            a, b = a[near], b[near]
            seen = _distinct(np.concatenate([seen, np.minimum(a, b) * len(known) + np.maximum(a, b)]))
        a, b = seen // len(known), seen % len(known)
        kept = np.fromiter((_may_link(maps[i], maps[j], int(sizes[i]), int(sizes[j]), percent) for i, j in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
        return pa.table({"a": pa.array(known[a[kept]]), "b": pa.array(known[b[kept]])})

    return rows.groupBy("main", "tile").applyInArrow(cross, "a long, b long")
