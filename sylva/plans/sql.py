"""The profile as SQL text after the star views, for cross-checks in DuckDB (and Spark)."""

from __future__ import annotations

from .star import CTES


def profile_cte(units: str = "mass", name: str = "profile") -> str:
    """CTEs that build ``name`` (edge, a, len, sample, r) from a mass view."""
    p = name
    return f"""
{p}_byplace AS (SELECT sample, loc, pos, SUM(m) m FROM {units} GROUP BY sample, loc, pos),
{p}_byedge AS (SELECT sample, loc, SUM(m) m FROM {units} GROUP BY sample, loc),
{p}_samples AS (SELECT DISTINCT sample FROM {units}),
{p}_bp AS (SELECT id edge, CAST(0 AS DOUBLE) a FROM edges UNION SELECT loc, pos FROM {p}_byplace),
{p}_seg AS (SELECT edge, a, COALESCE(LEAD(a) OVER (PARTITION BY edge ORDER BY a), bl) - a AS len FROM {p}_bp JOIN edges ON id = edge),
{p}_below AS (SELECT sample, id edge, SUM(m) m FROM {p}_byedge JOIN edges ON loc >= lo AND loc < id GROUP BY sample, id),
{p}_on AS (SELECT s.edge, s.a, b.sample, SUM(b.m) m FROM {p}_seg s JOIN {p}_byplace b ON b.loc = s.edge AND b.pos <= s.a GROUP BY s.edge, s.a, b.sample),
{p} AS (
  SELECT g.edge, g.a, g.len, s.sample, COALESCE(b.m, 0) + COALESCE(o.m, 0) r
  FROM {p}_seg g CROSS JOIN {p}_samples s
  LEFT JOIN {p}_below b ON b.edge = g.edge AND b.sample = s.sample
  LEFT JOIN {p}_on o ON o.edge = g.edge AND o.a = g.a AND o.sample = s.sample)"""


def star(query: str, *more: str) -> str:
    """A query over the star views and further CTEs."""
    return "WITH " + ",\n".join([CTES.strip(), *(x.strip() for x in more)]) + "\n" + query


HEIGHT = "h AS (SELECT e.id, SUM(CASE WHEN u.parent_id IS NULL THEN CAST(0 AS DOUBLE) ELSE u.bl END) h FROM edges e JOIN edges u ON e.id >= u.lo AND e.id <= u.id GROUP BY e.id)"
