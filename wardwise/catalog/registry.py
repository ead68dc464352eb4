"""The query table and the SQL views that the check queries share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
VIEWS: dict[str, str] = {}
_BODIES: dict[str, str] = {}
TIE_GUARD = 1.3e-10


def query(name: str, sql: str | None = None):
    """Registers a query, with the SQL that gives the same rows."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            _BODIES[name] = sql
        return fn

    return wrap


def compose() -> None:
    """Puts the views in front of every check query, once all are registered."""
    SQL.update({name: with_views(body) for name, body in _BODIES.items()})


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def with_views(sql: str) -> str:
    """``sql`` preceded by the views it reads, directly or through other views."""
    order: list[str] = []
    path: list[str] = []
    recursive: set[str] = set()

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_\w+", text)):
            if name in VIEWS and name not in order:
                if name in path:
                    recursive.add(name)
                    continue
                path.append(name)
                visit(VIEWS[name])
                path.pop()
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS {'' if n in recursive else 'MATERIALIZED '}({VIEWS[n]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{sql.strip()}"


def r(x, digits: int = 6) -> Column:
    """Rounded double without a negative zero, for comparison across engines.

    Exact ties of the last digit (1/128 at six digits) would fall either way with the
    last bit of a sum; the guard lifts them off the edge in both engines.
    """
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("double") + F.lit(TIE_GUARD), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded."""
    return df.select(*[r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def R(expr: str, name: str | None = None, digits: int = 6) -> str:
    """SQL twin of ``r``."""
    return f"round(CAST({expr} AS DOUBLE) + {TIE_GUARD!r}, {digits}) + 0.0e0 AS {name or expr.split('.')[-1]}"


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(R(n, None, digits) for n in names)


def number(x: float) -> str:
    """A literal that every engine reads as a double."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def cut_sql(expr: str, breaks, labels=None, right=True, include_lowest=False) -> str:
    """CASE expression for interval bins."""
    arms = []
    last = len(breaks) - 1
    for i in range(1, len(breaks)):
        lo, hi = number(breaks[i - 1]), None if breaks[i] == float("inf") else number(breaks[i])
        if right:
            low = ">=" if include_lowest and i == 1 else ">"
            high = "<="
        else:
            low, high = ">=", "<=" if include_lowest and i == last else "<"
        test = f"({expr}) {low} {lo}" + (f" AND ({expr}) {high} {hi}" if hi else "")
        value = i if labels is None else labels[i - 1]
        value = f"'{value}'" if isinstance(value, str) else (number(value) if isinstance(value, float) else value)
        arms.append(f"WHEN {test} THEN {value}")
    return "CASE " + " ".join(arms) + " END"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


# ------------------------------------------------------------------ base views
view("fx_voters", """
SELECT l_orderkey * 10 + l_linenumber AS voter_id, l_partkey AS precinct_id,
       CASE WHEN l_returnflag = 'R' OR (l_partkey % 5 = 0 AND l_returnflag = 'N') THEN 1 ELSE 0 END AS race,
       CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS vote
FROM lineitem
""")
view("fx_precincts", """
SELECT precinct_id, count(*) AS population,
       CAST(sum(race) AS BIGINT) AS n_minority, CAST(sum(1 - race) AS BIGINT) AS n_majority,
       CAST(sum(vote) AS BIGINT) AS dem_votes, CAST(sum(1 - vote) AS BIGINT) AS rep_votes,
       CAST(sum(race * vote) AS BIGINT) AS dem_votes_minority,
       CAST(sum(race * (1 - vote)) AS BIGINT) AS rep_votes_minority,
       CAST(sum((1 - race) * vote) AS BIGINT) AS dem_votes_majority,
       CAST(sum((1 - race) * (1 - vote)) AS BIGINT) AS rep_votes_majority,
       CAST(sum(race) AS DOUBLE) / count(*) AS per_minority,
       CAST(sum(vote) AS DOUBLE) / count(*) AS dem_voteshare,
       CAST(sum(race * vote) AS DOUBLE) / nullif(sum(race), 0) AS dem_voteshare_minority,
       CAST(sum((1 - race) * vote) AS DOUBLE) / nullif(sum(1 - race), 0) AS dem_voteshare_majority
FROM fx_voters GROUP BY precinct_id
""")
view("fx_maps", """
SELECT CAST(m AS BIGINT) AS map_id,
       CASE m % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS seg_level,
       CASE m % 3 WHEN 0 THEN 0.1e0 WHEN 1 THEN 0.5e0 ELSE 0.9e0 END AS alpha,
       CASE (m % 9) - (m % 3) WHEN 0 THEN 'rep' WHEN 3 THEN 'middle' ELSE 'dem' END AS redist_level
FROM range(1, 31) AS t(m)
""")
view("fx_assignments", """
SELECT map_id, seg_level, redist_level, precinct_id,
       CAST(ntile(14) OVER (PARTITION BY map_id ORDER BY score, precinct_id) - 1 AS BIGINT) AS district_id
FROM (SELECT m.map_id, m.seg_level, m.redist_level, p.precinct_id,
             m.alpha * p.per_minority
             + (1 - m.alpha) * (CAST((p.precinct_id * (7919 + 2 * m.map_id) + m.map_id * 104729) % 10007 AS DOUBLE) / 10007) AS score
      FROM fx_precincts p CROSS JOIN fx_maps m) s
""")
view("fx_labels", """
SELECT map_id, seg_level, redist_level FROM fx_maps
UNION ALL
SELECT map_id, seg_level, 'middle' AS redist_level FROM fx_maps WHERE map_id % 10 = 0 AND redist_level <> 'middle'
""")
view("fx_units", """
SELECT a.map_id, a.seg_level, a.redist_level, a.district_id, p.*
FROM fx_assignments a JOIN fx_precincts p ON p.precinct_id = a.precinct_id
""")
view("fx_cells", """
SELECT precinct_id, precinct_id % 50 AS col, CAST(floor(CAST(precinct_id AS DOUBLE) / 50) AS BIGINT) AS row_no
FROM fx_precincts
""")
view("fx_edges", """
SELECT a.precinct_id AS src, b.precinct_id AS dst FROM fx_cells a JOIN fx_cells b
  ON b.row_no = a.row_no AND b.col = a.col + 1
UNION ALL
SELECT a.precinct_id AS src, b.precinct_id AS dst FROM fx_cells a JOIN fx_cells b
  ON b.row_no = a.row_no + 1 AND b.col = a.col
""")
view("fx_draws", """
SELECT a.map_id, a.seg_level, a.redist_level, a.district_id, a.precinct_id, CAST(d.k AS BIGINT) AS draw,
       CAST((a.precinct_id * 31 + d.k * 17 + a.map_id) % 101 AS DOUBLE) / 100 AS beta_min,
       CAST((a.precinct_id * 29 + d.k * 13 + a.map_id) % 101 AS DOUBLE) / 100 AS beta_maj
FROM fx_assignments a CROSS JOIN range(0, 20) AS d(k)
""")
view("fx_blocks", """
SELECT v.block_id, CAST(sum(v.race) AS BIGINT) AS cvap_min, CAST(sum(1 - v.race) AS BIGINT) AS cvap_maj,
       count(*) AS population, CAST(sum(v.race) AS DOUBLE) / count(*) AS per_minority,
       max(n.n_name) AS state,
       CASE max(n.n_regionkey) % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS category
FROM (SELECT l_orderkey AS block_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS race FROM lineitem) v
JOIN orders o ON o.o_orderkey = v.block_id
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
GROUP BY v.block_id
""")
view("fx_chain", """
SELECT o_custkey AS run, o_totalprice AS score,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS step
FROM orders
""")
