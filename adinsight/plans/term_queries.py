"""Registered queries: search terms, relevance, findings and recommendations."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adinsight.operators import findings, relevance, screening, terms
from adinsight.plans.oracle import (
    CURRENT, GRADE_LIST, category, cnt, div0, divn, fixed_text, grouped_text, has, money_text, month_abbr, n_text, rnd,
    term_grade, tot, whole,
)
from adinsight.plans import registry
from adinsight.plans.registry import current, last_month
from adinsight.plans.sample_facts import CONFIG, SEASONAL, Facts

STATED: dict[str, str] = {}


def register(name: str, query: Callable[[Facts], DataFrame], sql: str) -> None:
    """Register a query and keep its statement for queries that list it again."""
    STATED[name] = sql
    registry.register(name, query, sql)


ST, QS, CAMP, PMAX = "fx_search_terms", "fx_search_keyword_qs", "fx_campaign_performance", "fx_pmax_placements"
COMPETITOR = f"case when {has('search_term', 'rod')} then 'rod' when {has('search_term', 'hot')} then 'hot' end"
SEGMENT = (f"case when {has('search_term', 'rod', 'hot')} then 'Competitor' when {has('search_term', 'old')} then 'Irrelevant' "
           f"when {has('search_term', 'widget', 'bolt', 'ring', 'sets', 'gear', 'gizmo')} then 'Relevant' else 'Needs Review' end")
STATUS = """case when contains(lower(added_excluded),'exclud') then 'Excluded' when contains(lower(added_excluded),'add') then 'Already Added'
 when substr(grade,1,1) in ('A','B','C') then 'Recommend to Add' when substr(grade,1,1)='D' then 'Review' else 'Unassigned' end"""
T0 = f"""t0 as (select search_term term, brand, '' match, row_index, added_excluded, clicks, cost, conversions, {term_grade()} grade, {SEGMENT} segment,
 {category('search_term')} category, {COMPETITOR} competitor from {{{ST}}} where not {has('search_term', 'gizmo')}),
 t as (select *, {STATUS} status from t0)"""
ORDER = "order by cost desc, term, row_index"
SHARE = rnd(div0("s", "sum(s) over ()"), 4)


def grouped(key: str, where: str = "true", by: str = "") -> str:
    return f"(select {by} {key} k, {cnt()} n, {tot('cost')} s, {tot('conversions')} v from t where {where} group by {by} {key})"


register("t00_term_totals", lambda f: terms.term_totals(f[ST], CONFIG), f"""with {T0} select {cnt()} as total_terms, {rnd(tot('cost'), 2)} as total_spend,
 count(competitor) as competitor_total, {cnt("segment='Relevant'")} as relevant_total, {cnt("segment='Needs Review'")} as flagged_total from t""")
GRADE_COLS = f"n as terms, {rnd('s', 2)} as spend, {{share}} as spend_share, {whole('v')} as conv, {rnd(divn('s', 'v'), 2)} as cpa"
BY_BRAND = rnd(div0("s", "sum(s) over (partition by brand)"), 4)
register("t01_term_grades", lambda f: terms.term_grades(f[ST], CONFIG),
         f"with {T0} select k as grade, {GRADE_COLS.replace('{share}', SHARE)} from {grouped('grade')}")


def labelled(key: str, labels: tuple[str, ...]) -> str:
    values = ",".join(f"('{x}')" for x in labels)
    return f"""with {T0}, g as (select l.k, coalesce(n,0) n, coalesce(s,0e0) s from (values {values}) l(k) left join {grouped(key)} g on g.k=l.k)
 select k as {key}, cast(n as bigint) as terms, {rnd('s', 2)} as spend, {SHARE} as spend_share from g"""


register("t03_intent_segments", lambda f: terms.intent_segments(f[ST], CONFIG),
         labelled("segment", ("Relevant", "Competitor", "Needs Review", "Irrelevant")))
CATS = "coalesce(category,'Other / uncategorized')"
register("t04_service_categories", lambda f: terms.service_categories(f[ST], CONFIG),
         f"with {T0} select k as category, {rnd('s', 2)} as spend from {grouped(CATS)} where s>0")
register("t05_competitor_breakdown", lambda f: terms.competitor_breakdown(f[ST], CONFIG),
         f"with {T0} select k as competitor, {rnd('s', 2)} as spend from {grouped('competitor', 'competitor is not null')} where s>0 order by s desc, k limit 12")
register("t06_competitor_summary", lambda f: terms.competitor_summary(f[ST], CONFIG),
         f"with {T0} select k as competitor, {GRADE_COLS.replace('{share}', SHARE)} from {grouped('competitor', 'competitor is not null')}")
DETAIL = (f"term, row_index, {rnd('cost', 2)} as spend, {whole('clicks')} as clicks, {rnd('conversions', 1)} as conv, "
          f"{rnd(div0('conversions', 'clicks'), 4)} as cvr")
CPA = f"{rnd(divn('cost', 'conversions'), 2)} as cpa"
register("t07_competitor_terms", lambda f: terms.competitor_terms(f[ST], CONFIG),
         f"with {T0} select competitor, {DETAIL}, {CPA} from (select * from t where competitor is not null {ORDER} limit 75)")
register("t08_keyword_status", lambda f: terms.keyword_statuses(f[ST], CONFIG),
         labelled("status", ("Recommend to Add", "Already Added", "Review", "Excluded", "Unassigned")))
register("t09_relevant_terms", lambda f: terms.relevant_terms(f[ST], CONFIG), f"""with {T0} select {DETAIL}, coalesce(category,'Uncategorized') as category, grade, status,
 {rnd(div0('cost', 'clicks'), 2)} as cpc from (select * from t where segment='Relevant' {ORDER} limit 150)""")
register("t10_flagged_terms", lambda f: terms.flagged_terms(f[ST], CONFIG),
         f"with {T0} select {DETAIL}, segment, status, {CPA} from (select * from t where segment='Needs Review' {ORDER} limit 75)")


def verdict(term: str, what: str) -> str:
    """Rule verdict of a term; ``what`` is ``category`` or ``relevant``."""
    words = "list_has_any(regexp_extract_all(lower(" + term + "),'[a-z]+'),['widget','bolt','ring','sets','set','gear'])"
    out = {"category": ("'brand'", "'competitor'", "'product'", "'unrelated'"), "relevant": ("true", "true", "true", "false"),
           "reason": ("'brand term'", "'competitor term'", "'matches a product category'", "'no product/brand match'")}[what]
    return f"case when {has(term, 'gizmo')} then {out[0]} when {has(term, 'rod')} then {out[1]} when {words} then {out[2]} else {out[3]} end"


HEAD = f"""{T0}, top60 as (select * from t {ORDER} limit 60),
 cls as (select distinct term, {verdict('term', 'category')} verdict, {verdict('term', 'relevant')} relevant from t where term<>''),
 h as (select * from top60 left join cls using (term))"""
LISTED = (f"term, match, row_index, {whole('clicks')} as clicks, {rnd('cost', 2)} as cost, {rnd('conversions', 1)} as conv, grade, verdict as intent, relevant")
register("t11_top_graded", lambda f: terms.top_graded(f[ST], CONFIG), f"with {HEAD} select {LISTED} from (select * from h {ORDER} limit 40)")
register("t12_intent_mix", lambda f: terms.intent_mix(f[ST], CONFIG),
         f"with {HEAD} select coalesce(verdict,'unclassified') as intent, {cnt()} as terms, {rnd(tot('cost'), 2)} as cost from h group by 1")
register("t13_relevant_top", lambda f: terms.relevant_top(f[ST], CONFIG), f"with {HEAD} select {LISTED} from (select * from h where relevant {ORDER} limit 25)")
register("t13_competitor_top", lambda f: terms.competitor_top(f[ST], CONFIG),
         f"with {HEAD} select {LISTED} from (select * from t where competitor is not null {ORDER} limit 25) left join cls using (term)")
register("t13_flagged_top", lambda f: terms.flagged_top(f[ST], CONFIG),
         f"with {HEAD} select {LISTED} from (select * from h where conversions=0 and (grade[1]='F' or relevant=false) {ORDER} limit 30)")


def all_terms(f: Facts) -> DataFrame:
    return f[ST].select(F.col("search_term").alias("term")).distinct()


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not import this module


def classify_even(batch: list[str], context: object) -> dict[str, dict[str, object]]:
    """A stand-in classifier: answers for terms of even length and drops the others."""
    return {t: {"relevant": True, "category": "product", "reason": "even"} for t in batch if len(t) % 2 == 0}


register("t14_classify_relevance", lambda f: relevance.classify(all_terms(f), CONFIG), f"""select distinct search_term as term, {verdict('search_term', 'relevant')} as relevant,
 {verdict('search_term', 'category')} as category, {verdict('search_term', 'reason')} as reason, 'heuristic' as source from {{{ST}}}""")
EVEN_LENGTH = "length(search_term)%2=0"
register("t15_pluggable_classifier", lambda f: relevance.classify_with(all_terms(f), CONFIG, classify_even), f"""select distinct search_term as term,
 case when {EVEN_LENGTH} then true else {verdict('search_term', 'relevant')} end as relevant, case when {EVEN_LENGTH} then 'product' else {verdict('search_term', 'category')} end as category,
 case when {EVEN_LENGTH} then 'even' else {verdict('search_term', 'reason')} end as reason, case when {EVEN_LENGTH} then 'model' else 'heuristic' end as source from {{{ST}}}""")


def cache_of(f: Facts) -> DataFrame:
    """A cache that knows the terms of even brands, with another verdict than the rules."""
    known = f[ST].filter(F.substring("brand", 7, 2).cast("int") % 2 == 0).select("search_term").distinct()
    return known.select(F.lit("sample").alias("client_id"), F.col("search_term").alias("term"), F.lit(True).alias("relevant"),
                        F.lit("cached").alias("category"), F.lit("earlier").alias("reason"), F.lit("model").alias("source"))


EVEN = "cast(substr(brand,7,2) as int)%2=0"
register("t16_relevance_cache", lambda f: relevance.refresh_cache(all_terms(f), cache_of(f), CONFIG), f"""
select 'sample' as client_id, search_term as term, case when even then true else {verdict('search_term', 'relevant')} end as relevant,
 case when even then 'cached' else {verdict('search_term', 'category')} end as category, case when even then 'earlier' else {verdict('search_term', 'reason')} end as reason,
 case when even then 'model' else 'heuristic' end as source from (select search_term, bool_or({EVEN}) even from {{{ST}}} group by 1)""")
register("t16_top_with_cache", lambda f: terms.top_graded(f[ST], CONFIG, cache=cache_of(f)), f"""
with {HEAD}, c as (select term, case when contains(term,'brand') and cast(regexp_extract(term,'brand ([0-9]+)',1) as int)%2=0 then 'cached' else verdict end verdict2,
  case when cast(regexp_extract(term,'brand ([0-9]+)',1) as int)%2=0 then true else relevant end relevant2 from cls)
select {LISTED.replace('verdict as', 'verdict2 as').replace(', relevant', ', relevant2 as relevant')} from (select * from h {ORDER} limit 40) left join c using (term)""")
WASTE = f"w as (select search_term term, '' match, row_index, clicks, cost, conversions from {{{ST}}} where cost>0 and coalesce(conversions,0)<=0), w40 as (select * from w {ORDER} limit 40)"
WCLS = f"wc as (select distinct term, {verdict('term', 'category')} category, {verdict('term', 'relevant')} relevant from w)"
register("t17_top_waste", lambda f: terms.top_waste(f[ST], CONFIG), f"""with {WASTE}, {WCLS} select term, match, row_index, {whole('clicks')} as clicks, {rnd('cost', 2)} as cost, relevant, category
 from (select * from w40 {ORDER} limit 20) left join wc using (term)""")
register("t17_top_converting", lambda f: terms.top_converting(f[ST]), f"""select term, row_index, {whole('clicks')} as clicks, {rnd('cost', 2)} as cost, {rnd('conversions', 1)} as conv,
 {rnd(div0('cost', 'conversions'), 2)} as cpa from (select search_term term, * from {{{ST}}} where conversions>0 order by conversions desc, search_term, row_index limit 20)""")
register("t17_waste_split", lambda f: terms.waste_split(f[ST], CONFIG), f"""with {WASTE}, {WCLS} select (select {cnt()} from {{{ST}}}) as total_terms,
 {rnd('(select ' + tot('cost') + ' from w)', 2)} as waste_total, count(distinct term) as classified, {rnd(tot('cost', 'not relevant'), 2)} as irrelevant_waste,
 {rnd(tot('cost', 'relevant'), 2)} as relevant_waste from w left join wc using (term)""")
register("t18_grades_by_brand", lambda f: terms.term_grades(f[ST], CONFIG, ["brand"]),
         f"with {T0} select brand, k as grade, {GRADE_COLS.replace('{share}', BY_BRAND)} from {grouped('grade', by='brand,')}")
register("t18_intent_by_brand", lambda f: terms.intent_segments(f[ST], CONFIG, ["brand"]),
         f"with {T0} select brand, k as segment, n as terms, {rnd('s', 2)} as spend, {BY_BRAND} as spend_share from {grouped('segment', by='brand,')}")
register("t18_categories_by_brand", lambda f: terms.service_categories(f[ST], CONFIG, ["brand"]),
         f"with {T0} select brand, k as category, {rnd('s', 2)} as spend from {grouped(CATS, by='brand,')} where s>0")
register("t18_competitors_by_brand", lambda f: terms.competitor_breakdown(f[ST], CONFIG, ["brand"]),
         f"with {T0} select brand, k as competitor, {rnd('s', 2)} as spend from {grouped('competitor', 'competitor is not null', 'brand,')} where s>0")

# --- findings -----------------------------------------------------------------------


def finding_sql(source: str, where: str, key: str, module: str, severity: str, title: str, observation: str, magnitude: str,
                impact: str, summary: str, dollar: str, effort: str, timing: str, action: str = "'[ACTION REQUIRED]'") -> str:
    return f"""select '{key}' as finding, '{module}' as module, {severity} as severity, {title} as title, {observation} as observation, {magnitude} as magnitude,
 '{impact}' as impact, '{summary}' as summary, {dollar} as dollar, {effort} as effort, {timing} as timing, {action} as action from {source} where {where}"""


DENS = f"(select campaign, {tot('conversions')} v, {tot('cost')} c, trim(list_last(string_split(campaign,'|'))) nm from {{{CAMP}}} where month_start={CURRENT} group by 1)"
TOP_CONV = f"(select string_agg(t, '; ' order by v desc, campaign) from (select *, nm||': '||{n_text('v')} t from {DENS} order by v desc, campaign limit 8))"
TOP_COST = (f"(select string_agg(t, '; ' order by c desc, campaign) from (select *, nm||' ('||{n_text('v')}||' conv, '||{money_text('c')}||')' t "
            f"from {DENS} where v<15 and c>100 order by c desc, campaign limit 8))")
DSUM = f"(select {cnt()} n, {cnt('v>=30')} a, {cnt('v<30')} b, {cnt('v<15 and c>100')} low, {month_abbr(CURRENT)} m, {TOP_CONV} lead, {TOP_COST} costly from {DENS})"
DENSITY_SQL = finding_sql(
    DSUM, "n>0", "density", "D", "case when b>a then 'CRITICAL' else 'IMPORTANT' end", "'Conversion volume per campaign vs the automated-bidding floor'",
    "m||': '||lead||'. '||a||' of '||n||' campaigns reach 30 conversions a month; '||b||' do not.'", "a||' at or above the floor · '||b||' below'",
    "Too little signal per campaign for automated bidding to learn from.",
    "Group small campaigns into one portfolio; keep targets of their own for large ones", "'HIGH'", "'M'", "'Week 1-2'") + " union all " + finding_sql(
    DSUM, "low>0", "low_volume", "D", "'CRITICAL'", "'Costly campaigns far below the automated-bidding floor'",
    "m||': '||costly||'. Under 15 conversions at more than $100 each.'", "low||' campaigns below the floor with material spend'",
    "These campaigns spend without reaching the volume they need.", "Merge, narrow or pause them and move the budget to efficient campaigns",
    "'HIGH'", "'S'", "'Week 1-2'")
register("n01_density", lambda f: findings.density(f[CAMP], current(f), CONFIG), DENSITY_SQL)
register("n01_density_last_month", lambda f: findings.density(f[CAMP], last_month(f), CONFIG),
         DENSITY_SQL.replace(CURRENT, f"(select max(month_start) from {{{CAMP}}})"))
register("n01_density_evidence", lambda f: findings.density_evidence(f[CAMP], current(f), CONFIG),
         f"select campaign, v>=30 as clears_floor, v<15 and c>100 as low_volume, {rnd('v', 1)} as conv, {rnd('c', 2)} as cost from {DENS}")
LAST = f"(select max(month_start) from {{{CAMP}}})"


def trend_sql(seasonal: bool, as_of: str = LAST) -> str:
    rows = f"""(select {month_abbr(as_of)} m, v, p, (v-p)/p d from (select month_start, v, lag(v) over (order by month_start) p from
 (select month_start, {tot('conversions')} v from {{{CAMP}}} where month_start<={as_of} group by 1)) where month_start=(select max(month_start) from {{{CAMP}}} where month_start<={as_of}) and p>=10)"""
    pct = n_text("abs(d*100)")
    values = f"m||' conversions '||{n_text('v')}||' after '||{n_text('p')}||' (-'||{pct}||'%).'"
    if seasonal:
        return finding_sql(rows, "d < -0.15e0", "trend", "D", "'PASS'", f"'Conversions down '||{pct}||'% on the month before, as expected'",
                           f"{values}||' Configured season: summer dip.'", "'Seasonal dip, suppressed'", "Matches the configured season; no performance problem.",
                           "Watch only; compare after the season", "'LOW'", "'S'", "'Reference'", "'[PASS]'")
    return finding_sql(rows, "d < -0.15e0", "trend", "D", "case when d<=-0.4e0 then 'CRITICAL' else 'IMPORTANT' end", f"'Conversions down '||{pct}||'% on the month before'",
                       values, f"{pct}||'% fewer conversions'", "A drop of this size needs a cause before any change.",
                       "Check conversion tracking first, then budgets, bids and competition", "case when d<=-0.4e0 then 'HIGH' else 'MEDIUM' end", "'S'", "'Week 1'")


register("n02_conversion_trend", lambda f: findings.conversion_trend(f[CAMP], last_month(f), CONFIG), trend_sql(False))
register("n02_seasonal_trend", lambda f: findings.conversion_trend(f[CAMP], last_month(f), SEASONAL), trend_sql(True))
register("n02_trend_evidence", lambda f: findings.trend_evidence(f[CAMP], current(f)), f"""select strftime(month_start,'%B %Y') as month, {rnd('v', 1)} as conv
 from (select month_start, {tot('conversions')} v from {{{CAMP}}} where month_start<={CURRENT} group by 1 order by 1 desc limit 8)""")
BUCKETS = f"""(select bool_or({has('campaign', 'brand')}) b, bool_or(regexp_matches(lower(campaign),'non[- ]?brand|generic|category')) n,
 bool_or(regexp_matches(lower(campaign),'conquest|competitor')) c from {{{CAMP}}})"""
HAVE = "concat_ws(', ', case when b then 'Brand' end, case when n then 'Non-Brand' end, case when c then 'Conquest' end)"
LACK = "concat_ws(', ', case when not b then 'Brand' end, case when not n then 'Non-Brand' end, case when not c then 'Conquest' end)"
OK = "b::int+n::int+c::int>=2"
BUCKET_SQL = finding_sql(
    BUCKETS, "true", "three_bucket", "K", f"case when {OK} then 'PASS' else 'IMPORTANT' end",
    f"case when {OK} then 'Brand, non-brand and conquest are separated' else 'Campaign structure lacks '||{LACK} end",
    f"'Found: '||coalesce(nullif({HAVE},''),'none')||'.'||case when {LACK}<>'' then ' Missing: '||{LACK}||'.' else '' end||' Conquest names: rod. Kept out of conquest and negatives: hot.'",
    f"case when {OK} then 'Structure follows the three buckets' else 'Buckets are not fully separated' end",
    "Separate buckets keep bidding signals clean and let copy match intent.", "Keep or rebuild separate brand, non-brand and conquest campaigns",
    f"case when {OK} then 'LOW' else 'MEDIUM' end", f"case when {OK} then 'S' else 'L' end", f"case when {OK} then 'Reference' else 'Month 2' end",
    f"case when {OK} then '[PASS]' else '[BUILD REQUIRED]' end")
register("n03_three_bucket", lambda f: findings.three_bucket(f[CAMP], CONFIG), BUCKET_SQL)
register("n03_campaign_buckets", lambda f: findings.campaign_buckets(f[CAMP]), f"select b as brand, n as nonbrand, c as conquest from {BUCKETS}")
MIX = f"""(select case when starts_with(lower(search_keyword_match_type),'exact') then 'Exact' when starts_with(lower(search_keyword_match_type),'phrase') then 'Phrase'
 when starts_with(lower(search_keyword_match_type),'broad') then 'Broad' else 'Other' end k, {cnt()} n, {tot('cost')} c, {tot('conversions')} v from {{{QS}}} group by 1)"""
MIX_ROW = f"""(select sum(n) n, arg_max(k, c) lead, string_agg(k||': '||n||' kw / '||{money_text('c')}||' / '||{n_text('v')}||' conv', '. ' order by c desc) filter (where k<>'Other') parts,
 string_agg(k, ', ' order by c desc) filter (where k<>'Other' and c<1) lazy from {MIX})"""
MATCH_SQL = finding_sql(
    MIX_ROW, "n>0", "match_types", "K", "'IMPORTANT'", "'How keywords and spend divide over match types'",
    "parts||'. Most spend runs on '||lead||'.'||case when lazy is not null then ' Idle: '||lazy||'.' else '' end",
    f"{grouped_text('n')}||' keywords · most spend on '||lead", "Idle layers add no signal; a wide layer without negatives leaks spend.",
    "Resize exact, phrase and broad; delete or revive idle keywords", "'MEDIUM'", "'S'", "'Week 2'")
register("n04_match_types", lambda f: findings.match_types(f[QS]), MATCH_SQL)
register("n04_match_type_mix", lambda f: findings.match_type_mix(f[QS]),
         f"select k as match, n as keywords, k<>'Other' and c<1 as idle, {rnd('c', 2)} as cost, {rnd('v', 1)} as conv from {MIX}")
IS_BRAND = has("search_keyword", "gizmo")
SPLIT = f"""(select {tot('cost', IS_BRAND)} bc, {tot('conversions', IS_BRAND)} bv, {tot('cost', 'not ' + IS_BRAND)} nc, {tot('conversions', 'not ' + IS_BRAND)} nv from {{{QS}}})"""
BCPA, NCPA = div0("bc", "bv"), div0("nc", "nv")
SPLIT_SQL = finding_sql(
    SPLIT, "bv>0 or nv>0", "brand_split", "K", "'OPPORTUNITY'", f"'Brand against non-brand: CPA gap '||{fixed_text(div0(NCPA, BCPA), 1)}||'x'",
    f"'Brand (gizmo): '||{money_text('bc')}||' / '||{n_text('bv')}||' conv / $'||{fixed_text(BCPA, 2)}||' CPA. Non-brand: '||{money_text('nc')}||' / '||{n_text('nv')}||' conv / $'||{fixed_text(NCPA, 2)}||' CPA.'",
    f"'Brand has '||{n_text(div0('bv', 'bv+nv') + '*100')}||'% of conversions on '||{n_text(div0('bc', 'bc+nc') + '*100')}||'% of spend'",
    "Brand is the cheap anchor, non-brand the growth; one target hides both.", "Defend brand; give non-brand a target of its own", "'MEDIUM'", "'M'", "'Month 2'")
register("n05_brand_split", lambda f: findings.brand_split(f[QS], CONFIG), SPLIT_SQL)
register("n05_brand_split_rows", lambda f: findings.brand_split_rows(f[QS], CONFIG), f"""select case when {IS_BRAND} then 'Brand' else 'Non-brand' end as segment,
 {rnd(tot('cost'), 2)} as spend, {rnd(tot('conversions'), 1)} as conv, {rnd(div0(tot('cost'), tot('conversions')), 2)} as cpa from {{{QS}}} group by 1""")
IDLE, SAFE = "(cost>0 and coalesce(conversions,0)=0)", has("search_term", "gizmo", "hot", "old")
THEMES = f"""(select token, sum(s) c from (select unnest(list_distinct(regexp_extract_all(lower(search_term),'[a-z0-9]+'))) token, cost s from {{{ST}}} where {IDLE} and not {SAFE})
 where length(token)>=3 and token not in ('the','for','and','near','you','your','with','are','best','top','buy','shop','store','online') group by 1)""".replace("sum(s) c", f"{tot('s')} c")
TOP6 = f"(select string_agg(token||' ('||{money_text('c')}||')', ', ' order by c desc, token) from (select * from {THEMES} order by c desc, token limit 6))".replace("', ' order", "'; ' order")
WSUM = f"(select {tot('cost', f'{IDLE} and not {SAFE}')} w, {tot('cost', f'{IDLE} and {SAFE}')} p, {tot('cost')} t, {TOP6} themes from {{{ST}}})"
PCT = div0("w", "t") + "*100"
WASTE_SQL = finding_sql(
    WSUM, "w>0", "waste", "K", f"case when {PCT}>=40 then 'CRITICAL' else 'IMPORTANT' end", "'Spend on search terms without conversions'",
    f"{money_text('w')}||' without a conversion, '||{n_text(PCT)}||'% of search-term spend'||case when p>0 then ' ('||{money_text('p')}||' in protected terms left out)' else '' end||'. Largest themes: '||themes||'.'",
    f"{money_text('w')}||' without conversions · '||{n_text(PCT)}||'% of search spend'", "Without negatives the same queries return every period.",
    "Build shared negative lists, seeded from the largest themes", f"case when {PCT}>=40 then 'HIGH' else 'MEDIUM' end", "'M'", "'Week 2'", "'[BUILD REQUIRED]'")
register("n07_waste", lambda f: findings.waste(f[ST], CONFIG), WASTE_SQL)
register("n07_waste_evidence", lambda f: findings.waste_evidence(f[ST], CONFIG), f"""select search_term as term, row_index, {rnd('cost', 2)} as cost
 from (select * from {{{ST}}} where {IDLE} and not {SAFE} order by cost desc, search_term, row_index limit 30)""")
register("n08_waste_themes", lambda f: findings.waste_themes(f[ST], CONFIG), f"select token, {rnd('c', 2)} as cost from {THEMES} order by c desc, token limit 6")
register("n08_waste_themes_all", lambda f: findings.waste_themes(f[ST], CONFIG, None), f"select token, {rnd('c', 2)} as cost from {THEMES}")
QSUM = f"""(select {cnt("lower(exp_ctr)='below average'")} ln, {tot('cost', "lower(exp_ctr)='below average'")} lc, {cnt('try_cast(quality_score as double)<=3')} dn,
 {tot('cost', 'try_cast(quality_score as double)<=3')} dc, {div0('sum(try_cast(quality_score as double))', 'count(try_cast(quality_score as double))')} mean from {{{QS}}})"""
QUALITY_SQL = finding_sql(
    QSUM, "lc>0", "expected_ctr", "Q", "'IMPORTANT'", f"'Expected CTR below average on '||{money_text('lc')}||' of spend'",
    f"ln||' keywords are rated below average ('||{money_text('lc')}||'). Mean score of the account: '||{fixed_text('mean', 1)}||'.'",
    f"{money_text('lc')}||' rated below average, about '||{money_text('lc*0.33e0')}||' of modelled CPC penalty'", "A low expected CTR is paid for in every click.",
    "Rework the copy of the costliest keywords with a low expected CTR", "'MEDIUM'", "'M'", "'Week 1-2'") + " union all " + finding_sql(
    QSUM, "dn>0", "low_score", "Q", "'IMPORTANT'", f"'Scores 1-3: '||dn||' keywords, '||{money_text('dc')}",
    f"'Scores 1-3: '||dn||' keywords with '||{money_text('dc')}||' of spend. Mean score of the account: '||{fixed_text('mean', 1)}||'.'",
    "dn||' keywords pay a CPC penalty'", "Fixing or pausing them frees budget for better keywords.", "Pause or rework the keywords with the lowest scores",
    "'MEDIUM'", "'M'", "'Month 2'")
register("n09_quality", lambda f: findings.quality(f[QS], CONFIG), QUALITY_SQL)
for _kind, _where in (("expected_ctr", "lower(exp_ctr)='below average'"), ("low_score", "try_cast(quality_score as double)<=3")):
    register(f"n09_{_kind}_evidence", lambda f, k=_kind: findings.quality_evidence(f[QS], CONFIG, k), f"""select search_keyword as keyword, quality_score as qs, row_index,
 {rnd('cost', 2)} as cost from (select * from {{{QS}}} where {_where} order by cost desc, search_keyword, row_index limit 30)""")
PSUM = f"(select {cnt()} t, {cnt('impressions>=2')} s, {cnt('impressions<=1')} o from {{{PMAX}}})"
SP, OP = div0("s", "t") + "*100", div0("o", "t") + "*100"
PMAX_SQL = finding_sql(
    PSUM, "t>0", "placements", "P", "'CRITICAL'", f"'Placements are spread thin: '||{fixed_text(SP, 1)}||'% served twice or more'",
    f"{grouped_text('t')}||' placements; '||{grouped_text('s')}||' ('||{fixed_text(SP, 1)}||'%) had two or more impressions, '||{grouped_text('o')}||' ('||{n_text(OP)}||'%) at most one.'",
    f"{n_text(OP)}||'% of placements had at most one impression'", "A long tail of single impressions dilutes budget and brand safety.",
    "Exclude weak placements and tighten audience signals", "'HIGH'", "'M'", "'Week 2'")
register("n10_pmax_spray", lambda f: findings.placement_spray(f[PMAX]), PMAX_SQL)
register("n10_pmax_evidence", lambda f: findings.placement_evidence(f[PMAX]), f"""select performance_max_placement as placement, cast(impressions as bigint) as impressions
 from {{{PMAX}}} where impressions>=2 order by {{{PMAX}}}.impressions desc, performance_max_placement limit 25""")


def run(f: Facts) -> DataFrame:
    return findings.run_analyzers(CONFIG, current(f), campaigns=f[CAMP], keywords=f[QS], terms=f[ST], placements=f[PMAX])


EVERY = " union all ".join(f"({s})" for s in (DENSITY_SQL, trend_sql(False, CURRENT), MATCH_SQL, SPLIT_SQL, BUCKET_SQL, WASTE_SQL, QUALITY_SQL, PMAX_SQL))
RANKS = """case severity when 'CRITICAL' then 1 when 'IMPORTANT' then 2 when 'OPPORTUNITY' then 3 else 4 end,
 list_position(['density','low_volume','trend','match_types','brand_split','three_bucket','waste','expected_ctr','low_score','placements'], finding)"""
register("n06_findings_overview", lambda f: findings.overview(run(f)),
         f"select title as topic, magnitude as detail from ({EVERY}) where severity<>'PASS' order by {RANKS} limit 6")
register("n11_run_analyzers", run, EVERY)
EVIDENCE = {  # finding -> (query whose oracle lists it, entity, texts, numbers)
    "density": ("n01_density_evidence", "campaign", ("clears_floor", "low_volume"), ("conv", "cost")),
    "trend": ("n02_trend_evidence", "month", (), ("conv",)),
    "match_types": ("n04_match_type_mix", "match", ("idle",), ("keywords", "cost", "conv")),
    "brand_split": ("n05_brand_split_rows", "segment", (), ("spend", "conv", "cpa")),
    "waste": ("n07_waste_evidence", "term", (), ("row_index", "cost")),
    "expected_ctr": ("n09_expected_ctr_evidence", "keyword", ("qs",), ("row_index", "cost")),
    "low_score": ("n09_low_score_evidence", "keyword", ("qs",), ("row_index", "cost")),
    "placements": ("n10_pmax_evidence", "placement", (), ("impressions",)),
}


def evidence_sql() -> str:
    """The evidence lists in long form, of the findings that are raised."""
    parts = []
    for finding, (query, entity, texts, numbers) in (*EVIDENCE.items(), ("low_volume", EVIDENCE["density"])):
        listed = f"({STATED[query]})" + (" where low_volume" if finding == "low_volume" else "")
        parts += [f"select '{finding}' as finding, {entity} as entity, '{c}' as key, cast({c} as varchar) as text, cast(null as double) as number from {listed}" for c in texts]
        parts += [f"select '{finding}', {entity}, '{c}', null, cast({c} as double) from {listed}" for c in numbers]
    return f"select * from ({' union all '.join(parts)}) where finding in (select finding from ({EVERY}))"


register("n11_evidence", lambda f: findings.run_evidence(CONFIG, current(f), campaigns=f[CAMP], keywords=f[QS], terms=f[ST], placements=f[PMAX]), evidence_sql())
register("n12_recommendations", lambda f: findings.recommendations(run(f)), f"""select finding, case severity when 'CRITICAL' then 'High' when 'IMPORTANT' then 'Medium' else 'Low' end as priority,
 case module when 'D' then 'Data Density & Budget' when 'K' then 'Keywords & Negatives' when 'Q' then 'Quality Score' else 'Performance Max' end as category,
 action||' '||summary as recommendation, observation||' '||impact as rationale, case dollar when 'HIGH' then 'High' when 'MEDIUM' then 'Medium' else 'Low' end as expected_impact,
 case effort when 'S' then 'Low' when 'M' then 'Medium' else 'High' end as effort, severity, magnitude, timing from ({EVERY}) where severity<>'PASS'""")
register("n13_complexity_profile", lambda f: findings.complexity_profile(f[PMAX]), f"select 1 as n_brands, count(*)>0 as has_pmax from {{{PMAX}}}")

# --- screening ----------------------------------------------------------------------

WTEXT = f"(select search_term, {tot('cost')} c from {{{ST}}} where {IDLE} and not {SAFE} group by 1)"
register("r01_ngram_themes", lambda f: screening.ngram_themes(f[ST], CONFIG, 2, 50), f"""with w as (select c, regexp_extract_all(lower(search_term),'[a-z0-9]+') l from {WTEXT}),
 g as (select unnest(list_distinct(list_transform(range(1, len(l)), lambda i: l[i]||' '||l[i+1]))) ngram, c from w where len(l)>=2)
select ngram, {cnt()} as terms, {rnd(tot('c'), 2)} as cost from g group by 1 order by {tot('c')} desc, 1 limit 50""")
register("r01_ngram_themes_all", lambda f: screening.ngram_themes(f[ST], CONFIG, 2), f"""with w as (select c, regexp_extract_all(lower(search_term),'[a-z0-9]+') l from {WTEXT}),
 g as (select unnest(list_distinct(list_transform(range(1, len(l)), lambda i: l[i]||' '||l[i+1]))) ngram, c from w where len(l)>=2)
select ngram, {cnt()} as terms, {rnd(tot('c'), 2)} as cost from g group by 1""")
register("r02_near_duplicates", lambda f: screening.near_duplicates(f[QS]), f"""with k as (select array_to_string(list_sort(list_distinct(regexp_extract_all(lower(search_keyword),'[a-z0-9]+'))),' ') word_key, search_keyword, cost from {{{QS}}})
select word_key, {cnt()} as keywords, count(distinct search_keyword) as spellings, min(search_keyword) as first, {rnd(tot('cost'), 2)} as cost from k group by 1 having count(*)>1""")
register("r03_cpa_breaches", lambda f: screening.cpa_breaches(f[ST], 25.0, ["search_term"]), f"""select search_term, {rnd(divn('c', 'v'), 2)} as cpa, {rnd('c', 2)} as cost, {rnd('v', 1)} as conv
 from (select search_term, {tot('cost')} c, {tot('conversions')} v from {{{ST}}} group by 1) where {divn('c', 'v')}>25""")
register("r04_guardrails", lambda f: screening.guardrails(findings.wasted_terms(f[ST], CONFIG), CONFIG, 100), f"""select lower(search_term) as term, {rnd(tot('cost'), 2)} as cost
 from {{{ST}}} where {IDLE} and not {SAFE} and trim(search_term)<>'' group by 1 order by {tot('cost')} desc, 1 limit 100""")
