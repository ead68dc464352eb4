"""Representation and the breakdown of waste by group, party and kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardwise.catalog import base
from wardwise.catalog.base import DK
from wardwise.catalog.registry import R, div, query, rounded
from wardwise.catalog.tables import MK, G, _cop
from wardwise.operators import report, shapes, waste
from wardwise.schemas import DISTRICT


def _cop_by(g: str, keys: str) -> str:
    dem = f"(CASE WHEN dem_district THEN true_{g}_dem_votes ELSE 0 END)"
    rep = f"(CASE WHEN dem_district THEN 0 ELSE total_{g} - true_{g}_dem_votes END)"
    return f"""SELECT {keys}, {div(f'sum({dem})', f'sum(total_{g})')} AS d, {div(f'sum({rep})', f'sum(total_{g})')} AS p,
  {div(f'sum({_cop(g)})', f'sum(total_{g})')} AS c FROM fx_results GROUP BY {keys}"""


@query("a33_copartisan_by_scenario", f"""
SELECT {G}, {R('avg(d)', 'mean_frac_minority_dem_copartisan')}, {R('avg(p)', 'mean_frac_minority_rep_copartisan')},
  {R('avg(c)', 'mean_frac_minority_copartisan')}, {R('stddev_samp(c)', 'sd_frac_minority_copartisan')}, count(*) AS n_maps
FROM ({_cop_by('minority', MK)}) t GROUP BY {G}
""")
def a33(spark, sf):
    return rounded(report.copartisan_by_scenario(base.results(spark, sf)))


@query("a33_copartisan_crosstab", f"""
SELECT seg_level, {', '.join(R(f"max(CASE WHEN redist_level = '{k}' THEN c * 100 END)", k) for k in ('dem', 'middle', 'rep'))}
FROM ({_cop_by('minority', G)}) t GROUP BY seg_level
""")
def a33x(spark, sf):
    return rounded(report.copartisan_crosstab(base.results(spark, sf)))


@query("a34_representation_rate", f"""
SELECT {G}, {R(div('sum(CASE WHEN w THEN d ELSE 0 END)', 'sum(d)'), 'minority_dem_copartisan')},
  {R(div('sum(CASE WHEN w THEN 0 ELSE r END)', 'sum(r)'), 'minority_rep_copartisan')},
  {R(div('sum(CASE WHEN w THEN d ELSE r END)', 'sum(d + r)'), 'minority_overall_copartisan')}
FROM (SELECT {G}, true_minority_dem_votes AS d, total_minority - true_minority_dem_votes AS r, total_dem_votes > total_rep_votes AS w FROM fx_results) t
GROUP BY {G}
""")
def a34(spark, sf):
    return rounded(report.representation_rate(base.results(spark, sf)))


@query("d14_copartisan_districts", f"""
SELECT {DK}, {', '.join(f"{_cop(g)} AS {g}_copartisan, {R(div(_cop(g), f'total_{g}'), f'frac_{g}_copartisan')}" for g in waste.GROUPS)}
FROM fx_results
""")
def d14(spark, sf):
    rows = base.results(spark, sf).withColumns({k: v for g in waste.GROUPS for k, v in waste.copartisan_columns(g).items()})
    return rounded(rows.select(*DISTRICT, *[c for g in waste.GROUPS for c in (f"{g}_copartisan", f"frac_{g}_copartisan")]))


_PARTS = [(g, p, k) for g in waste.GROUPS for p in waste.PARTIES for k in ("surplus", "losing")]


@query("d15_waste_breakdown", " UNION ALL ".join(
    f"""SELECT {DK}, '{g}' AS "group", '{p}' AS party, '{k}' AS vote_type, {R(f'{g}_{p}_wasted_{k}', 'votes')},
  {R(div(f'{g}_{p}_wasted_{k}', f'total_{g}') + ' * 100', 'percent')} FROM fx_results""" for g, p, k in _PARTS))
def d15(spark, sf):
    return rounded(shapes.waste_breakdown(base.results(spark, sf), DISTRICT))


@query("d15_waste_by_type", " UNION ALL ".join(
    f"""SELECT {DK}, '{g}' AS "group", '{k}' AS vote_type,
  {R(div(f'({g}_dem_wasted_{k} + {g}_rep_wasted_{k})', f'total_{g}') + ' * 100', 'percent')} FROM fx_results"""
    for g in waste.GROUPS for k in ("surplus", "losing")))
def d15t(spark, sf):
    long = shapes.waste_breakdown(base.results(spark, sf), [*DISTRICT, "total_minority", "total_majority"])
    total = F.when(F.col("group") == "minority", F.col("total_minority")).otherwise(F.col("total_majority"))
    out = long.groupBy(*DISTRICT, "group", "vote_type").agg(
        (F.try_divide(F.sum("votes"), F.max(total).cast("double")) * 100).alias("percent"))
    return rounded(out)


def _net(g: str) -> str:
    return R(div(f"({g}_rep_wasted_surplus + {g}_rep_wasted_losing - {g}_dem_wasted_surplus - {g}_dem_wasted_losing)",
                 f"total_{g}") + " * 100", f"{g}_net_percent")


@query("d16_net_waste", f"""
SELECT {DK}, {_net('minority')}, {_net('majority')}, {R('q', 'waste_ratio')}, {R('CASE WHEN q > 0 THEN log2(q) END', 'log_waste_ratio')}
FROM (SELECT *, {div(div('minority_wasted_total', 'total_minority'), div('majority_wasted_total', 'total_majority'))} AS q FROM fx_results) t
""")
def d16(spark, sf):
    rows = base.results(spark, sf).withColumns({
        f"{g}_{p}_wasted": F.col(f"{g}_{p}_wasted_surplus") + F.col(f"{g}_{p}_wasted_losing")
        for g in waste.GROUPS for p in waste.PARTIES}).withColumns(waste.net_waste_columns())
    return rounded(rows.select(*DISTRICT, "minority_net_percent", "majority_net_percent", "waste_ratio", "log_waste_ratio"))


