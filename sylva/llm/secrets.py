"""Secret scans by a trigram inverted index; DataFrame functions only on the main path.

Every rule's regular expression is parsed on the driver and turned into a Boolean query of
trigrams that each match must contain (ASCII letters lower-cased).  One scan lists, for each
trigram of any query, the documents that hold it (each alternative of a query keeps its few rarest
trigrams there: a weaker query, so nothing is lost); the postings are intersected by document, a
bit for each trigram, and give each document's candidate rules.  These rows of two numbers go to
the documents, broadcast up to a stated count and by a shuffle beyond it.  Candidates are verified
with the regular expression itself; rules from which no mandatory trigram follows scan every
document.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .shared import persist

#: Trigrams of an alternative that are looked up, and letters by how common they are: trigrams of rare ones come first.
MOST_TRIGRAMS, COMMON = 2, "etaoinsrhldcumfpgwybvkxjqz"
#: Candidates that are broadcast at most (16 bytes each); matches that are counted off one by one before a new start.
MOST_BROADCAST, RUN = 2_000_000, 256
#: More exact strings than this for a part of an expression are no longer listed.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regular expression whose leftmost non-overlapping matches are kept if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: The base rules, in the order in which spans of one start are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Rules of this operator's own.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}", 1),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 1),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 1),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}", 1),
    Rule("url", r"[a-z][a-z0-9+.-]{0,30}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]{3,}@", 1),
)

Query = frozenset  # of frozensets of trigrams: any of them with all of its trigrams; the empty inner set asks nothing
ANY: Query = frozenset([frozenset()])


def _trigrams(text: str) -> frozenset:
    return frozenset(text[k : k + 3] for k in range(len(text) - 2))


def _both(a: Query, b: Query) -> Query:
    found = {x | y for x in a for y in b}
    return frozenset(x for x in found if not any(y < x for y in found)) if len(found) <= MOST_STRINGS else a


def _either(a: Query, b: Query) -> Query:
    found = a | b
    found = frozenset(x for x in found if not any(y < x for y in found))
    return found if len(found) <= MOST_STRINGS else ANY


@dataclass
class _Part:
    """What is known of a part: its exact strings if few, else the query that its matches satisfy."""

    strings: set[str] | None = None
    query: Query = field(default=ANY)

    def asked(self) -> Query:
        if self.strings is None:
            return self.query
        found = ANY if not self.strings else frozenset(_trigrams(s) for s in self.strings)
        return frozenset(x for x in found if not any(y < x for y in found))


def _of(tree, lower=str.lower) -> _Part:
    """The part for a parsed sequence: exact strings grow while they are few; where they end, their trigrams join the query."""
    import re._constants as C

    strings: set[str] = {""}
    query: Query = ANY

    def close() -> None:
        nonlocal strings, query
        query, strings = _both(query, _Part(strings).asked()), {""}

    whole = True
    for op, arg in tree:
        part = _Part(None)
        if op is C.LITERAL:
            part = _Part({lower(chr(arg))})
        elif op is C.IN and arg[0][0] is not C.NEGATE and all(k is C.LITERAL or (k is C.RANGE and v[1] - v[0] < 8) for k, v in arg):
            part = _Part({lower(chr(c)) for k, v in arg for c in ((v,) if k is C.LITERAL else range(v[0], v[1] + 1))})
        elif op is C.SUBPATTERN:
            part = _of(arg[3])
        elif op is C.BRANCH:
            parts = [_of(x) for x in arg[1]]
            if all(x.strings is not None for x in parts):
                part = _Part(set().union(*(x.strings for x in parts)))
            else:
                joined = parts[0].asked()
                for x in parts[1:]:
                    joined = _either(joined, x.asked())
                part = _Part(None, joined)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) or str(op) == "POSSESSIVE_REPEAT":
            least, most, inner = arg
            own = _of(inner)
            if own.strings is not None and most == 1 and least == 0:
                part = _Part(own.strings | {""})
            elif own.strings is not None and least == most and len(own.strings) ** min(least, 7) <= MOST_STRINGS:
                part = _Part({"".join(x) for x in itertools.product(own.strings, repeat=least)})
            elif least:
                part = _Part(None, own.asked())
        if part.strings is not None and len(part.strings) * len(strings) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in part.strings}
            continue
        close()
        whole = False
        if part.strings is not None:
            strings = set(part.strings)
        else:
            query = _both(query, part.query)
    if whole:
        return _Part(strings)
    close()
    return _Part(None, query)


def trigram_query(pattern: str) -> Query:
    """The Boolean query of a regular expression: a set of alternatives, each a set of trigrams that all occur."""
    import re._parser as parser

    return _of(parser.parse(pattern)).asked()


def rarest(query: Query, most: int = MOST_TRIGRAMS) -> Query:
    """The query with at most ``most`` trigrams in each alternative: those of the rarest characters."""
    rank = lambda g: sum(COMMON.find(c) if c in COMMON else len(COMMON) for c in g)
    return frozenset(frozenset(sorted(x, key=lambda g: (-rank(g), g))[:most]) for x in query)


def scans_fully(rule: Rule) -> bool:
    return frozenset() in trigram_query(rule.pattern)


def trigram_postings(docs: DataFrame, trigrams: Sequence[str], *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The inverted index: (trigram, doc_id) for each trigram that a document's lower-cased text holds; null texts hold none."""
    low = F.lower(F.col(text_column))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("_low"), F.lit(g)), F.lit(k)) for k, g in enumerate(trigrams)]))
    return docs.select(F.col(id_column).alias("doc_id"), low.alias("_low")).select("doc_id", F.explode(held).alias("trigram"))


def candidate_rules(docs: DataFrame, rules: Sequence[Rule], *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, rules): a bit for each indexed rule whose trigram query the document's postings satisfy; only documents with some."""
    asked = {k: rarest(trigram_query(r.pattern)) for k, r in enumerate(rules)}
    asked = {k: q for k, q in asked.items() if frozenset() not in q}
    vocabulary = sorted({g for q in asked.values() for x in q for g in x})
    bit = {g: k for k, g in enumerate(vocabulary)}
    words = -(-len(vocabulary) // 62)
    postings = trigram_postings(docs, vocabulary, id_column=id_column, text_column=text_column)
    sets = postings.groupBy("doc_id").agg(*[F.bit_or(F.when(F.floor(F.col("trigram") / 62) == w, F.element_at(F.array(*[F.lit(1 << b).cast("long") for b in range(62)]), (F.col("trigram") % 62 + 1).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"_set{w}") for w in range(words)])

    def holds(grams: frozenset) -> Column:
        test = F.lit(True)
        for w in range(words):
            need = sum(1 << (bit[g] % 62) for g in grams if bit[g] // 62 == w)
            if need:
                test &= F.col(f"_set{w}").bitwiseAND(F.lit(need).cast("long")) == F.lit(need).cast("long")
        return test

    bits = F.lit(0).cast("long")
    for k, query in asked.items():
        any_of = F.lit(False)
        for grams in sorted(query, key=sorted):
            any_of |= holds(grams)
        bits = bits.bitwiseOR(F.when(any_of, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return sets.select(F.col("doc_id").alias("_doc"), bits.alias("_rules")).where("_rules != 0")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once a row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(rows: Column, value, join, zero: Column, kind: str) -> Column:
    """For each of an array's rows, the values of all rows before it joined: in stretches of RUN, so that time grows in proportion to the rows."""
    none = F.array().cast(f"array<{kind}>")
    run = lambda items, at, step: F.aggregate(items, F.struct(at.alias("at"), none.alias("out")), lambda acc, x: F.struct(join(acc["at"], step(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def of_stretches(parts: Column) -> Column:
        sums = F.transform(parts, lambda part: F.aggregate(part, zero, lambda acc, x: join(acc, value(x))))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), run(sums, zero, lambda x: x).alias("at")), lambda z: run(z["part"], z["at"], value)))

    def cut(own: Column) -> Column:
        starts = F.when(F.size(own) > 0, F.sequence(F.lit(0), F.size(own) - 1, F.lit(RUN))).otherwise(F.array().cast("array<int>"))
        return _let(F.transform(starts, lambda k: F.slice(own, k + 1, F.lit(RUN))), of_stretches)

    return _let(rows, cut)


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's kept matches, in code points: what stands between matches gives their places."""
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    matches = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    tested = matches if rule.group == 0 else F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)

    def place(rows: Column) -> Column:
        before = _before(rows, lambda x: x["gap"] + x["size"], lambda x, y: x + y, F.lit(0), "int")
        placed = F.transform(F.arrays_zip(rows.alias("row"), before.alias("at")), lambda z: F.struct((z["at"] + z["row"]["gap"]).alias("start"), (z["at"] + z["row"]["gap"] + z["row"]["size"]).alias("end"), z["row"]["tested"].alias("tested")))
        return F.filter(placed, lambda x: x["tested"] >= rule.least)

    # the text before each match, the match, and what its length is tested by
    rows = F.filter(F.arrays_zip(between.alias("gap"), matches.alias("size"), tested.alias("tested")), lambda x: x["size"].isNotNull())
    return _let(rows, place)


def _labelled(order: int, kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE, *, id_column: str = "doc_id", text_column: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, and _spans: array<struct<start, order, kind, end>> of whole texts, sorted; one row a document.

    Code points, end exclusive.  Null or empty texts have no span; null ids and repeated rows (also
    of different text) are scanned each, texts of any length; an empty table gives no rows; ties of
    start stand in the order of the rules.  Columns that are not asked for are not read, so clashing
    names do no harm.  The candidates of the index are written down when this is called.
    """
    if len(rules) > 62:
        raise ValueError("at most 62 rules")
    found = persist(candidate_rules(docs.where(F.col(id_column).isNotNull()), rules, id_column=id_column, text_column=text_column), "candidates")
    found = F.broadcast(found) if found.count() <= MOST_BROADCAST else found.hint("shuffle_hash")
    picked = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), *[F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)])
    # rows without an id are in no posting: every rule is verified on them
    joined = picked.join(found, F.col("_id") == F.col("_doc"), "left").withColumn("_asked", F.when(F.col("_id").isNull(), F.lit((1 << 62) - 1).cast("long")).otherwise(F.coalesce("_rules", F.lit(0).cast("long"))))
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    parts = []
    for k, rule in enumerate(rules):
        asked = F.lit(True) if scans_fully(rule) else F.col("_asked").bitwiseAND(F.lit(1 << k).cast("long")) != 0
        # a full scan first looks for a match long enough to be kept at all
        single = rule.group == 0 and re.fullmatch(r"\[[^\]\\]+\]\+", rule.pattern)  # one class: a run of it
        test = rule.pattern[:-1] + "{%d,}" % rule.least if single else rule.pattern
        spans = F.transform(_spans(F.col("_text"), rule), _labelled(k, rule.kind))
        parts.append(F.when(asked & F.coalesce(F.rlike(F.col("_text"), F.lit(test)), F.lit(False)), spans).otherwise(none))
    return joined.select(F.col("_id").alias(id_column), *[F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)], F.array_sort(F.concat(*parts)).alias("_spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with each stretch that spans cover replaced by ``mark``: overlapping and touching spans become one.

    Pieces are cut from four-byte code points, where a place is found at once.
    """
    reach = _before(spans, lambda x: x["end"], F.greatest, F.lit(0), "int")

    def whole(wide: Column) -> Column:
        cut = lambda at, end: F.decode(F.substring(wide, at * 4 + 1, (end - at) * 4), "UTF-32")
        fresh = lambda z: (z["span"]["end"] > z["at"]) & ((z["span"]["start"] > z["at"]) | (z["at"] == 0))
        pieces = F.transform(F.arrays_zip(spans.alias("span"), reach.alias("at")), lambda z: F.when(fresh(z), F.concat(cut(z["at"], z["span"]["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), cut(F.array_max(F.transform(spans, lambda x: x["end"])), F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(_let(F.encode(text, "UTF-32"), whole))
