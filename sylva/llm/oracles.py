"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .mixing import CELL_DOCS, POWER
from .secrets import BASE, MORE, Rule

SPACE = r"[^\x20\x09-\x0D]+"
LOWERED = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PARETO = f"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '{SPACE}')) AS BIGINT) size,
         (CAST(CAST('0x' || substr(md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), md5(COALESCE(text, '')))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496 u FROM documents),
classed AS (SELECT *, length(bin(size)) - 1 c FROM docs),
classes AS (SELECT source, c, CAST(SUM(size) AS BIGINT) words, COUNT(*) n FROM classed GROUP BY 1, 2),
sums AS (SELECT source, CAST(SUM(words) AS BIGINT) source_size, CAST(SUM(n) AS BIGINT) n_docs FROM classes GROUP BY 1),
weighed AS (SELECT *, CAST([1, 2, 3][1 + (ROW_NUMBER() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3] AS DOUBLE) w FROM sums),
priced AS (SELECT *, source_size * CAST(3 AS DOUBLE) / w stop, CAST(SUM(source_size) OVER () AS DOUBLE) total, SUM(w) OVER () all_w FROM weighed),
levels AS (SELECT *, (total - COALESCE(SUM(source_size * CAST(3 AS DOUBLE)) OVER before, 0)) / (all_w - COALESCE(SUM(w) OVER before, 0)) level
  FROM priced WINDOW before AS (ORDER BY stop, source IS NULL, source COLLATE "C" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT *, LEAST(source_size * CAST(3 AS DOUBLE), COALESCE((SELECT MAX(level) FROM levels WHERE level <= stop) * w, source_size * CAST(3 AS DOUBLE))) target FROM levels),
measured AS (SELECT k.source, c, words, POW(CAST(2 AS DOUBLE), c * CAST({POWER} AS DOUBLE)) m, target FROM classes k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source),
steps AS (SELECT *, 3 / m stop, COALESCE(SUM(words * CAST(3 AS DOUBLE)) OVER before, 0) stopped, SUM(words * m) OVER (PARTITION BY source) - COALESCE(SUM(words * m) OVER before, 0) rest
  FROM measured WINDOW before AS (PARTITION BY source ORDER BY 3 / m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tried AS (SELECT *, (target - stopped) / NULLIF(rest, 0) rate FROM steps),
rates AS (SELECT source, c, LEAST(COALESCE(MAX(CASE WHEN rate <= stop THEN rate END) OVER (PARTITION BY source), MAX(stop) OVER (PARTITION BY source)) * m, 3) expected FROM tried),
due AS (SELECT d.*, t.source_size, t.target, GREATEST(1, CEIL(t.n_docs / CAST({CELL_DOCS} AS DOUBLE))) cells, r.expected FROM classed d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source JOIN rates r ON d.source IS NOT DISTINCT FROM r.source AND d.c = r.c),
ranked AS (SELECT *, CASE WHEN size > 0 THEN CAST(FLOOR(expected) AS BIGINT) ELSE 0 END sure FROM due),
q AS (SELECT *, (u / (1 - u)) / (LEAST(GREATEST(expected - sure, 1e-9), 1 - 1e-9) / (1 - LEAST(GREATEST(expected - sure, 1e-9), 1 - 1e-9))) q, size > 0 AND sure < 3 open FROM ranked),
celled AS (SELECT *, LEAST(FLOOR(q / (1 + q) * cells), cells - 1) cell FROM q),
by_cell AS (SELECT source, cell, SUM(sure * size) sure_words, SUM(CASE WHEN open THEN size ELSE 0 END) words, MAX(target) target FROM celled GROUP BY 1, 2),
placed AS (SELECT source, cell, words, target - SUM(sure_words) OVER (PARTITION BY source) need, SUM(words) OVER (PARTITION BY source ORDER BY cell) - words before FROM by_cell),
known AS (SELECT c.*, p.words, p.need, p.before FROM celled c JOIN placed p ON c.source IS NOT DISTINCT FROM p.source AND c.cell = p.cell),
split AS (SELECT *, ROW_NUMBER() OVER o k, before + SUM(size) OVER o run FROM known WHERE open AND NOT (before + words <= need OR before + 0.5 >= need)
  WINDOW o AS (PARTITION BY source, cell ORDER BY q, doc_id, size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
gap AS (SELECT *, need - COALESCE(MAX(CASE WHEN run <= need THEN run END) OVER (PARTITION BY source, cell), before) gap FROM split),
last AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, cell ORDER BY CASE WHEN run > need AND ABS(gap - size) < gap THEN 0 ELSE 1 END, ABS(gap - size), k) pick FROM gap)
SELECT doc_id, size, source_size, target, (sure + CASE WHEN run <= need OR (pick = 1 AND run > need AND ABS(gap - size) < gap) THEN 1 ELSE 0 END) * size taken FROM last
UNION ALL
SELECT doc_id, size, source_size, target, (sure + CASE WHEN open AND before + words <= need AND before + 0.5 < need THEN 1 ELSE 0 END) * size FROM known
WHERE NOT open OR before + words <= need OR before + 0.5 >= need
"""

DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id a, b.vec_id b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, CAST(COALESCE(n, 0) AS BIGINT) n_links, LEAST(vec_id, COALESCE(m, vec_id)) component_id, LEAST(vec_id, COALESCE(m, vec_id)) = vec_id kept
FROM v LEFT JOIN (SELECT a, COUNT(*) n FROM links GROUP BY a) x ON x.a = vec_id LEFT JOIN (SELECT a, MIN(b) m FROM reach GROUP BY a) y ON y.a = vec_id
"""

TOP_K = """
WITH v AS (SELECT ROW_NUMBER() OVER () r, vec_id, list_transform(embedding, lambda x: FLOOR(64 * CAST(x AS DOUBLE))) e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(k AS INTEGER) rank, vec_id, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY r ORDER BY score DESC, vec_id) k FROM s) WHERE k <= 20
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{SPACE}') w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END s FROM w),
each AS (SELECT doc_id, len(s) n, UNNEST(s) t FROM sets),
links AS (SELECT a.doc_id a, b.doc_id b FROM each a JOIN each b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 75 * (a.n + b.n - COUNT(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) n_shingles, LEAST(doc_id, COALESCE(m, doc_id)) component_id FROM sets LEFT JOIN (SELECT a, MIN(b) m FROM reach GROUP BY a) x ON a = doc_id
"""


def _either_case(pattern: str) -> str:
    """A pattern that begins with (?i) with both cases of its ASCII letters spelt out (outside of classes and escapes)."""
    if not pattern.startswith("(?i)"):
        return pattern
    out, inside, k, text = "", False, 0, pattern[4:]
    while k < len(text):
        c = text[k]
        if c == "\\":
            width = 4 if text[k + 1] == "x" else 2
            out, k = out + text[k : k + width], k + width
            continue
        inside = (inside or c == "[") and c != "]"
        out += f"[{c.upper()}{c.lower()}]" if c.isalpha() and not inside else c
        k += 1
    return out


def _rule(k: int, rule: Rule) -> str:
    pattern = "'" + _either_case(rule.pattern).replace("'", "''") + "'"
    return f"""SELECT doc_id, {k} o, '{rule.kind}' kind, UNNEST(list_transform(range(1, len(m) + 1), lambda i: {{'start': CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + COALESCE(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS BIGINT), 'size': length(m[i]), 'tested': length(g[i])}})) x
  FROM (SELECT doc_id, regexp_extract_all(text, {pattern}, 0) m, regexp_extract_all(text, {pattern}, {rule.group}) g, regexp_split_to_array(text, {pattern}) b FROM documents WHERE regexp_matches(text, {pattern}))
  WHERE len(m) > 0"""


def _secrets() -> str:
    rules = BASE + MORE
    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(rules))
    parts = " UNION ALL ".join(_rule(k, r) for k, r in enumerate(rules))
    text = "kind || ':' || x.start || ':' || (x.start + x.size)"
    return f"""
WITH every AS ({parts}), spans AS (SELECT * FROM every WHERE x.tested >= CASE o {least} END),
per AS (SELECT doc_id, SUM(CASE WHEN kind = 'assign' THEN 1 ELSE 0 END) n_assign, SUM(CASE WHEN kind = 'access' THEN 1 ELSE 0 END) n_access, SUM(CASE WHEN kind = 'hex' THEN 1 ELSE 0 END) n_hex,
  STRING_AGG({text}, ',' ORDER BY x.start, o) FILTER (WHERE o < {len(BASE)}) base, STRING_AGG({text}, ',' ORDER BY x.start, o) spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(COALESCE(n_assign, 0) AS BIGINT) n_assign, CAST(COALESCE(n_access, 0) AS BIGINT) n_access, CAST(COALESCE(n_hex, 0) AS BIGINT) n_hex, sha256(COALESCE(base, '')) base_sha256, COALESCE(spans, '') spans
FROM documents d LEFT JOIN per p ON p.doc_id = d.doc_id
"""


ORACLES = {"op1_pareto_mix": PARETO, "op4_embedding_dedup": DEDUP, "op6_exact_top_k": TOP_K, "op7_ngram_jaccard": JACCARD, "op10_secret_scan": _secrets()}
