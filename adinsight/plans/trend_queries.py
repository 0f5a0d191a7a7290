"""Registered queries: months, KPIs, campaigns, budget and brand trends."""

from __future__ import annotations

from adinsight.operators import budget, trends
from adinsight.plans.oracle import (
    AS_OF, CURRENT, category, chg, cnt, div0, divn, month_abbr, month_text, nonbrand_category, region_of, rnd, tot, whole,
)
from adinsight.plans.registry import as_of, current, register
from adinsight.plans.sample_facts import CONFIG

CAMP = "fx_campaign_performance"

SERIES = f"""select month_start, {tot('cost')} cost, {tot('clicks')} clicks, {tot('conversions')} conv
 from {{{CAMP}}} where month_start<={AS_OF} group by 1"""


def trend_select(source: str, lead: str = "") -> str:
    return f"""select {lead}{month_text('month_start')} as month, {rnd('cost', 2)} as spend, {whole('clicks')} as clicks,
 {rnd('conv', 1)} as main_conv, {rnd(div0('cost', 'conv'), 2)} as cpa, {rnd(div0('conv', 'clicks'), 4)} as cvr from ({source})"""


register("m01_latest_complete_month", lambda f: trends.latest_complete_month(f["fx_uploads"]),
         f"select {AS_OF} as month_start")
register("m02_total_trend", lambda f: trends.total_trend(f[CAMP], as_of(f)), trend_select(SERIES))
register("m03_date_range", lambda f: trends.total_trend(f[CAMP], as_of(f), "1996-03", "1999-10-15"),
         trend_select(SERIES.replace("group by", "and month_start between date '1996-03-01' and date '1999-10-01' group by")))
register("m03_current_month", lambda f: trends.current_month(f[CAMP], as_of(f), None, "2000-05"),
         f"select max(month_start) as month_start from {{{CAMP}}} where month_start<=date '2000-05-01'")


def kpi_sql(chosen: str, series: str = SERIES) -> str:
    def pick(metric: str, where: str) -> str:
        return f"coalesce(sum({metric}) filter (where {where}),0e0)"

    cur = "month_start=cur"
    rows = [("Total Spend", "cost", None), ("Main Conversions", "conv", None), ("CPA (Main Conv)", "cost", "conv"),
            ("CVR (Main Conv)", "conv", "clicks")]
    parts = []
    for metric, num, den in rows:
        now, then = f"c_{num}", f"p_{num}"
        if den:
            now, then = div0(now, f"c_{den}"), div0(then, f"p_{den}")
        parts.append(f"select '{metric}' as metric, prior_label, current_label, {rnd(then, 2)} as prior, "
                     f"{rnd(now, 2)} as current, {chg(now, then)} as change from k")
    sums = ", ".join(f"{pick(m, cur)} c_{m}, {pick(m, 'chosen')} p_{m}" for m in ("cost", "conv", "clicks"))
    lo, hi = "min(month_start) filter (where chosen)", "max(month_start) filter (where chosen)"
    return f"""with s as ({series}),
 a as (select *, max(month_start) over () cur, row_number() over (order by month_start desc) age from s),
 y as (select *, coalesce({chosen},false) chosen from a),
 k as (select {sums}, {month_abbr('max(cur)')} current_label,
  case when {lo} is null then '—' when {lo}={hi} then {month_abbr(lo)} else {month_abbr(lo)}||'–'||{month_abbr(hi)} end prior_label from y)
 {' union all '.join(parts)}"""


YOY = "case when max(month_start=cur-interval 12 month) over () then month_start=cur-interval 12 month else age=2 end"
register("m04_kpi_yoy", lambda f: trends.kpi_scorecard(f[CAMP], as_of(f)), kpi_sql(YOY))
register("m04_kpi_yoy_short_history", lambda f: trends.kpi_scorecard(f[CAMP], as_of(f), date_from="2001-01"),
         kpi_sql(YOY, SERIES.replace("group by", "and month_start>=date '2001-01-01' group by")))
register("m05_kpi_mom", lambda f: trends.kpi_scorecard(f[CAMP], as_of(f), "mom"), kpi_sql("age=2"))
register("m06_kpi_custom",
         lambda f: trends.kpi_scorecard(f[CAMP], as_of(f), "custom", compare_from="1999-02", compare_to="1999-05"),
         kpi_sql("month_start between date '1999-02-01' and date '1999-05-01' and month_start<>cur"))


def changes(lead: str) -> str:
    pp, pc = div0("spend_prior", "conv_prior"), div0("spend_cur", "conv_cur")
    return f"""{lead}, {rnd('spend_prior', 2)} as spend_prior, {rnd('spend_cur', 2)} as spend_cur,
 {chg('spend_cur', 'spend_prior')} as spend_chg, {rnd('conv_prior', 1)} as conv_prior, {rnd('conv_cur', 1)} as conv_cur,
 {chg('conv_cur', 'conv_prior')} as conv_chg, {rnd(pp, 2)} as cpa_prior, {rnd(pc, 2)} as cpa_cur, {chg(pc, pp)} as cpa_chg"""


def cells_sql(keys: dict[str, str], months_back: int, tail: str) -> str:
    """The common table expressions cur, named and cells, followed by ``tail``."""
    named = ", ".join(f"{expr} {k}" for k, expr in keys.items())
    some = " and ".join(f"{k} is not null" for k in keys)
    names = ", ".join(keys)
    return f"""with d as (select {CURRENT} c, cast({CURRENT}-interval {months_back} month as date) p),
 named as (select * from (select {named}, month_start, cost, conversions from {{{CAMP}}}) where {some}),
 cells as (select {names}, {tot('cost', 'month_start=p')} spend_prior, {tot('cost', 'month_start=c')} spend_cur,
  {tot('conversions', 'month_start=p')} conv_prior, {tot('conversions', 'month_start=c')} conv_cur,
  {month_abbr('any_value(p)')} prior_label, {month_abbr('any_value(c)')} cur_label
  from named, d where month_start in (c,p) group by {names})
 {tail}"""


M07_TAIL = f"""select {changes('category, prior_label, cur_label')} from cells union all
 select {changes("'Non-Brand Total', prior_label, cur_label")} from (select any_value(prior_label) prior_label, any_value(cur_label) cur_label,
  sum(spend_prior) spend_prior, sum(spend_cur) spend_cur, sum(conv_prior) conv_prior, sum(conv_cur) conv_cur from cells)"""
NB = {"category": nonbrand_category("campaign")}
register("m07_nb_categories", lambda f: trends.nonbrand_categories(f[CAMP], current(f), CONFIG), cells_sql(NB, 12, M07_TAIL))
register("m07_nb_categories_mom", lambda f: trends.nonbrand_categories(f[CAMP], current(f), CONFIG, "mom"),
         cells_sql(NB, 1, M07_TAIL))
REG = {"region": region_of("campaign"), "category": nonbrand_category("campaign")}
register("m08_regions_cells", lambda f: trends.region_cells(f[CAMP], current(f), CONFIG), cells_sql(
    REG, 12, f"select region, category, prior_label, cur_label, {rnd('spend_prior', 2)} as spend_prior, {rnd('spend_cur', 2)} as spend_cur, "
             f"{rnd('conv_prior', 1)} as conv_prior, {rnd('conv_cur', 1)} as conv_cur from cells"))
SUMS = ("sum(spend_prior) spend_prior, sum(spend_cur) spend_cur, sum(conv_prior) conv_prior, sum(conv_cur) conv_cur")
register("m09_regions_rollup",
         lambda f: trends.regions_rollup(trends.region_cells(f[CAMP], current(f), CONFIG, digits=False), ["PMax", "Widget"]),
         cells_sql(REG, 12, f"""select {changes('region')} from (select coalesce(region,'Non-Brand Total') region, {SUMS}
  from cells where category in ('PMax','Widget') group by rollup(region))"""))
register("m09_regions_chart",
         lambda f: trends.regions_rollup(trends.region_cells(f[CAMP], current(f), CONFIG, digits=False), top=3),
         cells_sql(REG, 12, f"select {changes('region')} from (select region, {SUMS} from cells group by 1 order by spend_cur desc, region limit 3)"))

BRAND = "fx_brand_month"
register("m10_brand_trends", lambda f: trends.brand_trends(f[BRAND], as_of(f)), trend_select(
    f"select brand, month_start, {tot('cost')} cost, {tot('clicks')} clicks, {tot('conversions')} conv from {{{BRAND}}} "
    f"where month_start<={AS_OF} group by 1,2", "brand, "))

_PAIRS = (("cost", "spend", 2), ("conversions", "conv", 1), ("web_reservations", "webres", 1), ("calls", "calls", 1))


def yoy_sql(keys: str, where: str = "true") -> str:
    """CTE ``y``: sums of both periods per key."""
    sums = ", ".join(f"{tot(m, 'month_start=p')} {n}_p, {tot(m, 'month_start=c')} {n}_c" for m, n, _ in _PAIRS)
    return f"""with d as (select {CURRENT} c, cast({CURRENT}-interval 12 month as date) p),
 y as (select {keys}, {sums} from {{{BRAND}}}, d where month_start in (c,p) and {where} group by {keys})"""


def yoy_columns() -> str:
    out = [f"{rnd(f'{n}_p', k)} as {n}_prior, {rnd(f'{n}_c', k)} as {n}_cur, {chg(f'{n}_c', f'{n}_p')} as {n}_chg"
           for _, n, k in _PAIRS]
    pp, pc = div0("spend_p", "conv_p"), div0("spend_c", "conv_c")
    return ", ".join([*out, f"{rnd(pp, 2)} as cpa_prior, {rnd(pc, 2)} as cpa_cur, {chg(pc, pp)} as cpa_chg"])


_YSUM = ", ".join(f"sum({n}_p) {n}_p, sum({n}_c) {n}_c" for _, n, _ in _PAIRS)
register("m11_brand_yoy", lambda f: trends.brand_yoy(f[BRAND], current(f)), yoy_sql("brand") + f"""
 select brand, {yoy_columns()} from y union all select 'TOTAL', {yoy_columns()} from (select {_YSUM} from y)""")
register("m12_brand_regions", lambda f: trends.brand_regions(f[BRAND], current(f)), yoy_sql("brand, region") + f"""
 select brand, region, {yoy_columns()} from y union all select brand, 'TOTAL', {yoy_columns()} from (select brand, {_YSUM} from y group by 1)""")
register("m12_brand_regions_chart", lambda f: trends.brand_regions_chart(f[BRAND], current(f), "Brand#7", 3),
         yoy_sql("brand, region", "brand='Brand#7'") + f" select brand, region, {yoy_columns()} from y order by spend_c desc, region limit 3")
register("m13_brand_region_category", lambda f: trends.brand_region_category(f[BRAND], current(f), ["PROMO", "STANDARD"]),
         f"""select brand, region, {rnd('c', 2)} as cost, {whole('k')} as clicks, {whole('i')} as impr, {rnd('v', 1)} as conv,
 {rnd(div0('v', 'k'), 4)} as cvr, {rnd(div0('c', 'v'), 2)} as cpa from (select brand, region, {tot('cost')} c, {tot('clicks')} k,
 {tot('impressions')} i, {tot('conversions')} v from {{{BRAND}}} where month_start={CURRENT} and category in ('PROMO','STANDARD') group by 1,2)""")


def _level(level: str, keys: str, brand: str, month: str) -> str:
    return f"""select '{level}' as level, campaign_type, {brand} as brand, {month} as month, {rnd('cost', 2)} as spend, {whole('clicks')} as clicks,
 {rnd('conv', 1)} as main_conv, {rnd(div0('cost', 'conv'), 2)} as cpa, {rnd(div0('conv', 'clicks'), 4)} as cvr
 from (select {keys}, {tot('cost')} cost, {tot('clicks')} clicks, {tot('conversions')} conv from {{{BRAND}}} where month_start<={AS_OF} group by {keys})"""


register("m14_campaign_type_split", lambda f: trends.campaign_type_split(f[BRAND], as_of(f)), " union all ".join([
    _level("trend", "campaign_type, month_start", "null", month_text("month_start")),
    _level("total", "campaign_type", "null", "null"), _level("brand", "campaign_type, brand", "brand", "null")]))

register("c01_campaign_snapshot", lambda f: trends.campaign_snapshot(f[CAMP], current(f)), f"""
with d as (select {CURRENT} c, cast({CURRENT}-interval 1 month as date) p),
 n as (select campaign, max(campaign_type) ty, {tot('clicks')} k, {tot('cost')} s, {tot('conversions')} v from {{{CAMP}}}, d where month_start=c group by 1),
 b as (select campaign, {tot('conversions')} v from {{{CAMP}}}, d where month_start=p group by 1)
select n.campaign, trim(list_last(string_split(n.campaign,'|'))) as short_name, ty as type, {whole('k')} as clicks, {rnd('s', 2)} as cost,
 {rnd('n.v', 1)} as conv, {rnd(div0('s', 'n.v'), 2)} as cpa, {rnd(div0('n.v', 'k'), 4)} as cvr, {rnd(div0('s', 'sum(s) over ()'), 4)} as share,
 {rnd('b.v', 1)} as prior_conv, {chg('n.v', 'b.v')} as d_conv from n left join b using (campaign)""")
register("c01_campaign_totals", lambda f: trends.campaign_totals(f[CAMP], current(f)),
         f"select {whole(tot('clicks'))} as clicks, {rnd(tot('cost'), 2)} as cost, {rnd(tot('conversions'), 1)} as conv from {{{CAMP}}} where month_start={CURRENT}")

# --- budget -------------------------------------------------------------------------

LINES = "fx_budget_lines"
EFFECTIVE = f"(select {rnd(tot('monthly'), 2)} from {{{LINES}}})"


def status(pct: str) -> str:
    return f"case when {pct} is null then 'n/a' when {pct}>1.05 then 'over' when {pct}<0.9 then 'under' else 'on-track' end"


register("b01_effective_budget", lambda f: budget.effective_budget(f[LINES], 5000.0),
         f"select {EFFECTIVE} as monthly_budget, 'file' as source, cast(count(*) as bigint) as lines from {{{LINES}}}")
register("b01_manual_budget", lambda f: budget.effective_budget(f[LINES].filter("monthly < 0"), 5000.0),
         f"select 5000e0 as monthly_budget, 'manual' as source, cast(count(*) as bigint) as lines from {{{LINES}}} where monthly<0")
register("b02_budget_composition", lambda f: budget.composition(f[LINES]), " union all ".join(
    f"select '{d}' as dimension, coalesce({d},'(unspecified)') as key, {rnd(tot('monthly'), 2)} as monthly from {{{LINES}}} group by 2"
    for d in ("region", "category")))
B, A = "b", "a"
register("b03_reconciliation", lambda f: budget.reconciliation(f[CAMP], f[LINES], current(f)), f"""
select {month_abbr(CURRENT)} as month, {rnd('b', 2)} as total_budget, {rnd('a', 2)} as total_actual, {rnd('a-b', 2)} as variance,
 {rnd(divn('a', 'b'), 4)} as pct, {status(divn('a', 'b'))} as status
from (select {EFFECTIVE} b, {tot('cost')} a from {{{CAMP}}} where month_start={CURRENT})""")
register("b03_reconciliation_by_category",
         lambda f: budget.reconciliation_by_category(f[CAMP], f[LINES], current(f), CONFIG), f"""
with p as (select coalesce(category,'(unspecified)') category, {tot('monthly')} b from {{{LINES}}} group by 1),
 s as (select {category('campaign', "'Other / uncategorized'")} category, {tot('cost')} a from {{{CAMP}}} where month_start={CURRENT} group by 1),
 j as (select category, coalesce(b,0) b, coalesce(a,0) a from p full outer join s using (category))
select category, {rnd('b', 2)} as budget, {rnd('a', 2)} as actual, {rnd('a-b', 2)} as variance, {rnd(divn('a', 'b'), 4)} as pct, {status(divn('a', 'b'))} as status from j""")
register("b04_budget_pacing", lambda f: budget.pacing(f[CAMP], f[LINES], as_of(f)), f"""
with s as ({SERIES}), t as (select *, {EFFECTIVE} b from s order by month_start desc limit 12),
 l as (select arg_max(cost, month_start) c from t)
select {month_text('month_start')} as month, {rnd('cost', 2)} as spend, {rnd('b', 2)} as budget, {rnd('cost-b', 2)} as variance,
 {rnd(divn('cost', 'b'), 4)} as pct, {status(divn('l.c', 'b'))} as latest_status from t, l""")
register("b04_unbudgeted_pacing", lambda f: budget.pacing(f[CAMP], f[LINES].filter("monthly < 0"), as_of(f)), f"""
with s as ({SERIES}) select {month_text('month_start')} as month, {rnd('cost', 2)} as spend, cast(null as double) as budget,
 cast(null as double) as variance, cast(null as double) as pct, cast(null as varchar) as latest_status from s order by month_start desc limit 12""")
