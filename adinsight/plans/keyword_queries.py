"""Registered queries: quality score, keywords and geography."""

from __future__ import annotations

from adinsight.operators import geo, keywords, quality, terms
from adinsight.plans.oracle import (
    RATING_LIST, category, cnt, div0, divn, has, rating, rnd, term_grade, tot, whole,
)
from adinsight.plans.registry import register
from adinsight.plans.sample_facts import CONFIG

QS, KG, GEO, ZIP, KB, ST = ("fx_search_keyword_qs", "fx_keyword_geo", "fx_geographic", "fx_zip_spend", "fx_keyword_brand",
                            "fx_search_terms")
NBQ = f"(select *, cast(trunc(try_cast(quality_score as double)) as int) qs from {{{QS}}} where not {has('search_keyword', 'gizmo')})"
MEAS = (f"{cnt()} keywords, {tot('cost')} cost, {tot('clicks')} clicks, {tot('impressions')} impr, {tot('conversions')} conv")
RATES = (f"{rnd(div0('cost', 'clicks'), 2)} as cpc, {rnd(div0('clicks', 'impr'), 4)} as ctr, {rnd(div0('conv', 'clicks'), 4)} as cvr, "
         f"{rnd(div0('cost', 'conv'), 2)} as cpa")
SHARED = (f"cast(keywords as bigint) as keywords, {rnd(div0('keywords', 'sum(keywords) over ()'), 4)} as kw_share, {rnd('cost', 2)} as cost, "
          f"{rnd(div0('cost', 'sum(cost) over ()'), 4)} as spend_share, {whole('clicks')} as clicks, {rnd('conv', 1)} as conv, {RATES}")
PER_QS = f"""p as (select cast(i as int) qs, coalesce(keywords,0) keywords, coalesce(cost,0) cost, coalesce(clicks,0) clicks, coalesce(impr,0) impr, coalesce(conv,0) conv
 from range(1,11) r(i) left join (select qs, {MEAS} from {NBQ} where qs between 1 and 10 group by 1) g on g.qs=i)"""

register("q01_qs_distribution", lambda f: quality.distribution(f[QS], CONFIG), f"with {PER_QS} select qs, {SHARED} from p")
register("q02_qs_buckets", lambda f: quality.buckets(f[QS], CONFIG), f"""with {PER_QS},
 b as (select case when qs<=3 then 'Poor (1-3)' when qs<=5 then 'Below Average (4-5)' when qs<=7 then 'Average (6-7)' else 'Strong (8-10)' end bucket,
  sum(keywords) keywords, sum(cost) cost, sum(clicks) clicks, sum(impr) impr, sum(conv) conv from p group by 1) select bucket, {SHARED} from b""")
register("q03_qs_summary", lambda f: quality.summary(f[QS], CONFIG), f"""select total_keywords, {rnd(div0('pts', 'total_keywords'), 1)} as avg_qs,
 {rnd(div0('wk', 'total_keywords'), 4)} as pct_weak, {rnd(div0('st', 'total_keywords'), 4)} as pct_strong from
 (select {cnt()} total_keywords, sum(qs) pts, {cnt('qs<=5')} wk, {cnt('qs>=7')} st from {NBQ} where qs between 1 and 10)""")
WEAK7 = f"{tot('cost', 'qs<=5')} wc, {tot('clicks', 'qs<=5')} wk, {tot('cost', 'qs=7')} sc, {tot('clicks', 'qs=7')} sk"
SAVED = f"wk*greatest(0e0, {div0('wc', 'wk')}-{div0('sc', 'sk')})"
register("q04_qs_savings", lambda f: quality.savings(f[QS], CONFIG), f"""select {rnd(SAVED, 2)} as amount, {rnd(div0('wc', 'wk'), 2)} as cpc_weak,
 {rnd(div0('sc', 'sk'), 2)} as cpc_qs7 from (select {WEAK7} from {NBQ} where qs between 1 and 10)""")
register("q05_qs_totals", lambda f: quality.portfolio_totals(f[QS], CONFIG), f"""select keywords, {rnd('cost', 2)} as cost, {whole('clicks')} as clicks,
 {rnd('conv', 1)} as conv, {RATES} from (select {MEAS} from {NBQ} where qs between 1 and 10)""")


def ratings_sql(by: str = "") -> str:
    """Component ratings, per brand when ``by`` is ``brand,``."""
    long = " union all ".join(f"select brand, '{c}' component, {rating(c)} rating, cost, clicks, impressions, conversions from n"
                              for c, _ in quality.COMPONENTS)
    match = "g.brand=t.brand" if by else "true"
    total = f"select {by} {tot('cost')} tc, {tot('clicks')} tk from n {'group by brand' if by else ''}"
    grouped = f"select {by} component, rating, {MEAS} from l where rating is not null group by {by} component, rating"
    if not by:
        comps = "(values ('exp_ctr'),('ad_relevance'),('landing_page_exp'))"
        grouped = f"""select c.k component, r.k rating, coalesce(keywords,0) keywords, coalesce(cost,0) cost, coalesce(clicks,0) clicks, coalesce(impr,0) impr, coalesce(conv,0) conv
 from {comps} c(k), {RATING_LIST} r(k,i) left join ({grouped}) x on x.component=c.k and x.rating=r.k"""
    avg = div0("tc", "tk")
    vs = divn(f"{divn('cost', 'clicks')}-{avg}", avg)
    lead = "g.brand," if by else ""
    return f"""with n as (select * from {NBQ}), l as ({long}), g as ({grouped}), t as ({total})
select {lead} component, rating, cast(keywords as bigint) as keywords, {rnd(div0('keywords', f'sum(keywords) over (partition by {lead} component)'), 4)} as kw_share,
 {rnd('cost', 2)} as spend, {RATES}, {rnd('conv', 1)} as conv, {rnd(vs, 4)} as cpc_vs_avg from g, t where {match}"""


register("q06_component_ratings", lambda f: quality.component_ratings(f[QS], CONFIG), ratings_sql())
GRID = f"""select {rating('exp_ctr')} e, {rating('landing_page_exp')} l, {rating('ad_relevance')} a, qs, cost, clicks, brand from {NBQ} where qs<>0"""
GCOLS = (f"{rnd(div0('cost', 'clicks'), 2)} as cpc, {rnd('cost', 2)} as spend, {rnd(div0('pts', 'keywords'), 1)} as qs, cast(keywords as bigint) as keywords")
GSUM = f"{tot('cost')} cost, {tot('clicks')} clicks, sum(qs) pts, {cnt()} keywords"
register("q07_component_grid", lambda f: quality.component_grid(f[QS], CONFIG), f"""
select ex as exp_ctr, lx as landing_page_exp, ax as ad_relevance, {GCOLS} from (select r1.k ex, r2.k lx, r3.k ax, coalesce(cost,0) cost, coalesce(clicks,0) clicks, coalesce(pts,0) pts, coalesce(keywords,0) keywords
 from {RATING_LIST} r1(k,i), {RATING_LIST} r2(k,i), {RATING_LIST} r3(k,i)
 left join (select e, l, a, {GSUM} from ({GRID}) where e is not null and l is not null and a is not null group by 1,2,3) g on g.e=r1.k and g.l=r2.k and g.a=r3.k)""")
register("q07_grid_meta", lambda f: quality.ctr_spend_share(f[QS], CONFIG), f"""
select k as rating, {rnd(div0("(select " + tot('cost', 'e=k and l is not null and a is not null') + f" from ({GRID}))", f"(select {tot('cost')} from {NBQ})"), 4)} as spend_share
 from {RATING_LIST} r(k,i)""")


def savings_sql(brand: str, by: str = "") -> str:
    low = {c: cnt(f"qs<=5 and {rating(c)}='Below average'") for c, _ in quality.COMPONENTS}
    worst = "greatest(b1,b2,b3)"
    name = f"case when b1={worst} then 'Expected CTR' when b2={worst} then 'Ad Relevance' else 'LP Experience' end"
    group = "group by brand" if by else ""
    return f"""select {brand} as brand, kws_weak, {rnd('wc', 2)} as spend_weak, {rnd(div0('wc', 'wk'), 2)} as cpc_current, {rnd(div0('sc', 'sk'), 2)} as cpc_target,
 {rnd(SAVED, 2)} as savings, {rnd(div0(SAVED, 'tc'), 4)} as pct_brand_spend,
 case when {worst}>0 then {name}||' ('||{whole(divn(worst, 'kws_weak') + '*100')}||'% below avg)' else '—' end as primary_gap
 from (select {by} {cnt('qs<=5')} kws_weak, {WEAK7}, {tot('cost')} tc, {low['exp_ctr']} b1, {low['ad_relevance']} b2, {low['landing_page_exp']} b3 from {NBQ} {group})"""


register("q08_savings_by_brand", lambda f: quality.savings_by_brand(f[QS], CONFIG), savings_sql("'gizmo'"))
DOMINANT = f"""(select kw, region from (select kw, region, row_number() over (partition by kw order by c desc, region) rn from
 (select lower(search_keyword) kw, region, {tot('cost')} c from {{{KG}}} group by 1,2)) where rn=1)"""
register("q09_optimization_keywords", lambda f: quality.optimization_keywords(f[QS], f[KG], CONFIG), f"""
select search_keyword as keyword, 'gizmo' as brand, coalesce(region,'—') as region, coalesce({category('search_keyword')},'—') as category, qs,
 {rnd('cost', 2)} as spend, {whole('clicks')} as clicks, {rnd(div0('cost', 'clicks'), 2)} as cpc, coalesce({rating('exp_ctr')},'—') as exp_ctr,
 coalesce({rating('ad_relevance')},'—') as ad_relevance, coalesce({rating('landing_page_exp')},'—') as landing_page_exp, {rnd('conversions', 1)} as conv, row_index
 from (select * from {NBQ} where qs<=6 order by cost desc, search_keyword, row_index limit 100) k left join {DOMINANT} d on d.kw=lower(search_keyword)""")
register("q09_optimization_options", lambda f: quality.optimization_options(f[QS], f[KG], CONFIG), f"""
with k as (select lower(search_keyword) kw, {category('search_keyword')} category from {NBQ} where qs<=6), j as (select * from k left join {DOMINANT} d using (kw))
select 'category' as kind, category as value, {cnt()} as keywords from j where category is not null group by 2
union all select 'region', region, {cnt()} from j where region is not null group by 2 union all select 'total', 'keywords', {cnt()} from j""")
register("q10_component_counts", lambda f: quality.component_counts(f[QS]), " union all ".join(
    f"select '{c}' as component, coalesce(nullif(trim({c}),''),'—') as rating, {cnt()} as keywords, {rnd(tot('cost'), 2)} as cost from {{{QS}}} group by 2"
    for c, _ in quality.COMPONENTS))
LOW = tot("cost", "lower(exp_ctr)='below average'")
register("q11_ctr_penalty", lambda f: quality.ctr_penalty(f[QS]),
         f"select {rnd(LOW, 2)} as below_ctr_spend, {rnd(LOW + '*0.33e0', 2)} as savings_estimate from {{{QS}}}")
register("q12_ratings_by_brand", lambda f: quality.component_ratings(f[QS], CONFIG, ["brand"]), ratings_sql("brand,"))
register("q12_grid_by_brand", lambda f: quality.component_grid(f[QS], CONFIG, ["brand"]), f"""select brand, e as exp_ctr, l as landing_page_exp, a as ad_relevance, {GCOLS}
 from (select brand, e, l, a, {GSUM} from ({GRID}) where e is not null and l is not null and a is not null group by 1,2,3,4)""")
register("q12_savings_by_brand", lambda f: quality.savings_by_brand(f[QS], CONFIG, ["brand"]), savings_sql("brand", "brand,"))
register("q12_brand_portfolio", lambda f: quality.brand_portfolio(f[QS], CONFIG), f"""select brand, {rnd('c', 2)} as total_spend,
 {rnd(div0('c', 'sum(c) over ()'), 4)} as pct_portfolio, {rnd(div0('c', 'k'), 2)} as avg_cpc, {rnd(div0('p', 'n'), 1)} as wtd_avg_qs
 from (select brand, {tot('cost')} c, {tot('clicks')} k, sum(qs) p, count(qs) n from {NBQ} group by 1)""")

# --- keywords -----------------------------------------------------------------------

register("k01_top_keywords", lambda f: keywords.top_keywords(f[QS]), f"""select search_keyword as keyword, search_keyword_match_type as match, quality_score as qs,
 {whole('clicks')} as clicks, {rnd('cost', 2)} as cost, {rnd('conversions', 1)} as conv, {rnd(div0('cost', 'conversions'), 2)} as cpa, row_index
 from {{{QS}}} order by {{{QS}}}.cost desc, search_keyword, row_index limit 40""")
PIVOT = f"""c as (select search_keyword keyword, region, min(search_keyword_match_type) match, {tot('cost')} s, {tot('conversions')} v from {{{KG}}} group by 1,2),
 k as (select keyword, {has('keyword', 'gizmo')} branded, sum(s) s, sum(v) v from c group by 1),
 keep as (select * from (select *, row_number() over (partition by branded order by s desc, keyword) r1, row_number() over (partition by branded order by v desc, keyword) r2 from k) where r1<=100 or r2<=100),
 axis as (select region, sum(s) s, sum(v) v from c group by 1 order by 2 desc, 1 limit 25)"""
register("k02_keyword_region_pivot", lambda f: keywords.region_pivot(f[KG], CONFIG), f"""with {PIVOT}
select c.keyword, match, {category('c.keyword')} as category, 'gizmo' as brand, branded, c.region, {rnd('c.s', 2)} as spend, {rnd('c.v', 1)} as conv,
 {rnd('keep.s', 2)} as overall_spend, {rnd('keep.v', 1)} as overall_conv from c join keep using (keyword) where c.region in (select region from axis)""")
register("k02_region_axis", lambda f: keywords.region_axis(f[KG]),
         f"with {PIVOT} select region, {rnd('s', 2)} as spend, {rnd('v', 1)} as conv from axis")
register("k02_pivot_totals", lambda f: keywords.region_pivot_totals(f[KG], CONFIG), f"""with {PIVOT} select branded, {cnt()} as keywords,
 {rnd('sum(s)', 2)} as spend, {rnd('sum(v)', 1)} as conv, (select count(distinct region) from c) as regions from k group by branded""")
register("k03_dominant_region", lambda f: quality.dominant_region(f[KG]), f"select kw, region from {DOMINANT}")


def heat_sql(branded: str, crit: str, metric: str) -> str:
    return f"""with {PIVOT}, best as (select * from keep where branded={branded} and keyword in (select keyword from c where region in (select region from axis))
  order by {rnd(crit, 2 if crit == 's' else 1)} desc, keyword limit 50),
 x as (select c.keyword, c.region, {rnd('c.' + metric, 2 if metric == 's' else 1)} val, {rnd('best.' + metric, 2 if metric == 's' else 1)} o from c join best using (keyword) where c.region in (select region from axis)),
 y as (select *, max(val) over () mv, max(o) over () mo from x)
select keyword, region, val as value, o as overall, {rnd('sqrt(val/mv)', 6)} as heat, {rnd('case when o>0 and mo>0 then sqrt(o/mo) end', 6)} as overall_heat from y where val>0"""


register("k04_keyword_heatmap", lambda f: keywords.heatmap(f[KG], CONFIG), heat_sql("false", "s", "s"))
register("k04_keyword_heatmap_conv", lambda f: keywords.heatmap(f[KG], CONFIG, True, "spend", "conv"), heat_sql("true", "s", "v"))


def wmean(c: str) -> str:
    ok = f"filter (where {c} is not null and impressions>0)"
    return rnd(divn(f"sum(cast(floor({c}*1e6+0.5) as bigint)*impressions) {ok}", f"sum(impressions) {ok}") + "/1e6", 4)


def mode(c: str) -> str:
    return (f"(select {c} from {{{KB}}} m where m.brand=g.brand and m.keyword=g.keyword and nullif({c},'') is not null "
            f"group by {c} order by count(*) desc, {c} limit 1)")


register("k05_keyword_overall", lambda f: keywords.overall_values(f[KB]), f"""
with f as (select * from {{{KB}}}),
 s as (select brand, keyword, {tot('spend')} sp, {tot('conv')} v, {tot('clicks')} k, {tot('impressions')} i, {', '.join(f'{wmean(c)} {c}' for c in keywords.WEIGHTED)} from f group by 1,2),
 {', '.join(f"m_{c} as (select brand, keyword, {c} from (select brand, keyword, {c}, row_number() over (partition by brand, keyword order by count(*) desc, {c}) rn from f where nullif({c},'') is not null group by 1,2,3) where rn=1)" for c in keywords.RATED)}
select s.brand, s.keyword, {rnd('sp', 2)} as spend, {rnd('v', 1)} as conv, {whole('i')} as impressions, {whole('k')} as clicks, {rnd(divn('sp', 'v'), 2)} as cpa,
 {rnd(divn('sp', 'k'), 2)} as cpc, {rnd(divn('v', 'k'), 4)} as cvr, {rnd(divn('k', 'i'), 4)} as ctr, {', '.join(keywords.WEIGHTED)}, {', '.join(keywords.RATED)}
 from s {' '.join(f'left join m_{c} using (brand, keyword)' for c in keywords.RATED)}""")
for _crit in ("spend", "conv"):
    register(f"k06_top50_per_brand_{_crit}", lambda f, c=_crit: keywords.top_per_brand(f[KB], c), f"""
select brand, keyword, cast(rn as int) as rank, {rnd('v', 2)} as total from (select brand, keyword, {tot(_crit)} v, row_number() over (partition by brand order by {tot(_crit)} desc, keyword) rn
 from {{{KB}}} group by 1,2) where rn<=50""")
register("k06_brand_region_axis", lambda f: keywords.brand_region_axis(f[KB]), f"select distinct brand, region from {{{KB}}}")
STATUS = f"""case when contains(lower(added_excluded),'exclud') then 'Excluded' when contains(lower(added_excluded),'add') then 'Already Added'
 when substr(grade,1,1) in ('A','B','C') then 'Recommend to Add' when substr(grade,1,1)='D' then 'Review' else 'Unassigned' end"""
register("k07_keyword_status_summary", lambda f: keywords.status_summary(terms.graded(f[ST], CONFIG, brand_terms_too=True)), f"""
select {STATUS} as status, {cnt()} as terms, {rnd(tot('cost'), 2)} as spend, {rnd(div0(tot('cost'), f'sum({tot("cost")}) over ()'), 4)} as spend_share
 from (select *, {term_grade()} grade from {{{ST}}}) group by 1""")

# --- geography ----------------------------------------------------------------------

GSUMS = f"{tot('clicks')} k, {tot('impressions')} i, {tot('conversions')} v, {tot('conv_value')} x, {tot('cost_conv*conversions')} c"
GTOT = f"{whole('k')} as clicks, {whole('i')} as impr, {rnd('v', 1)} as conv, {rnd('x', 2)} as conv_value, {rnd('c', 2)} as cost"
register("g01_geo_performance", lambda f: geo.geo_performance(f[GEO]), f"""select state_matched as location, {GTOT}, {rnd(div0('c', 'v'), 2)} as cpa,
 {rnd(div0('v', 'k'), 4)} as cvr, {rnd(div0('k', 'i'), 4)} as ctr from (select state_matched, {GSUMS} from {{{GEO}}} group by 1
 order by case when {tot('cost_conv*conversions')}<>0 then {tot('cost_conv*conversions')} else {tot('clicks')} end desc, 1 limit 60)""")
register("g01_geo_totals", lambda f: geo.geo_totals(f[GEO]), f"select {GTOT} from (select {GSUMS} from {{{GEO}}})")
LATEST = f"""(select lower(search_keyword) kw, arg_max({{{QS}}}, row_index) b from {{{QS}}} group by 1)"""


def slice_sql() -> str:
    blocks = []
    for key, label in quality.COMPONENTS:
        cols = []
        for r, n in (("Above average", "above"), ("Average", "avg"), ("Below average", "below")):
            where = f"{key}='{r}'"
            cols.append(f"{rnd(divn(tot('cost', where), tot('clicks', where)), 2)} as {n}_cpc, {whole(tot('clicks', where))} as {n}_clicks")
        blocks.append(f"select '{label}' as component, region, category, {', '.join(cols)} from j group by region, category")
    rated = ", ".join(f"{rating(k)} {k}" for k, _ in quality.COMPONENTS)
    return f"""with r as (select kw, exp_ctr, ad_relevance, landing_page_exp from (select lower(search_keyword) kw, {rated},
  row_number() over (partition by lower(search_keyword) order by row_index desc) rn from {{{QS}}}) where rn=1),
 j as (select region, {category('search_keyword', "'Uncategorized'")} category, cost, clicks, exp_ctr, ad_relevance, landing_page_exp from {{{KG}}} g
  left join r on r.kw=lower(g.search_keyword) where not {has('search_keyword', 'gizmo')}),
 top as (select region, category, {tot('cost')} total, count(*) over () n from j group by 1,2 order by 3 desc, 1, 2 limit 100),
 b as ({' union all '.join(blocks)})
select 'gizmo' as brand, region, category, {rnd('total', 2)} as total_spend, n as slices, component, above_cpc, above_clicks, avg_cpc, avg_clicks, below_cpc, below_clicks,
 {rnd('below_cpc-above_cpc', 2)} as spread from b join top using (region, category)"""


register("g02_keyword_region_ratings", lambda f: geo.keyword_region_ratings(f[KG], f[QS], CONFIG), slice_sql())
CELLS = f"""p as (select zip, state, category, brand, {tot('cost')} s from {{{ZIP}}} group by 1,2,3,4),
 c as (select zip, state, category, string_agg(brand, ', ' order by brand) brands, count(*) n, sum(s) s from p group by 1,2,3)"""
register("g03_zip_overlap", lambda f: geo.zip_overlap(f[ZIP]),
         f"with {CELLS} select zip, state, category, brands, n as n_brands, {rnd('s', 2)} as spend, n>=2 as overlap from c")
register("g03_zip_overlap_filtered", lambda f: geo.zip_overlap(f[ZIP], ["NATION_1", "NATION_3", "NATION_5"], "Brand#7"), f"""with {CELLS}
 select zip, state, category, brands, n as n_brands, {rnd('s', 2)} as spend, n>=2 as overlap from c
 where state in ('NATION_1','NATION_3','NATION_5') and zip in (select zip from p where brand='Brand#7')""")
register("g03_zip_totals", lambda f: geo.zip_totals(f[ZIP]), f"""with {CELLS} select zip, state, {rnd('sum(s)', 2)} as total_nb_spend,
 {rnd('coalesce(sum(s) filter (where n>=2),0)', 2)} as overlap_spend, {cnt('n>=2')} as n_overlap_cats from c group by zip, state""")
register("g03_overlap_categories", lambda f: geo.overlap_categories(f[ZIP]), f"""with {CELLS},
 m as (select category, brands, count(*) k, row_number() over (partition by category order by count(*) desc, brands) rn from c group by 1,2),
 t as (select category, zip, state, s, row_number() over (partition by category order by s desc, zip, state) rn from c)
select category, {cnt()} as zips, {rnd('sum(c.s)', 2)} as spend, max(n) as max_brands, any_value(m.brands) as top_combo, any_value(k) as top_combo_zips,
 any_value(t.zip) as top_zip, any_value(t.state) as top_state, {rnd('any_value(t.s)', 2)} as top_zip_spend
 from c join (select * from m where rn=1) m using (category) join (select * from t where rn=1) t using (category) group by category""")
register("g03_overlap_kpis", lambda f: geo.overlap_kpis(f[ZIP]), f"""with {CELLS},
 z as (select zip, sum(s) s, coalesce(sum(s) filter (where n>=2),0) o, count(*) filter (where n>=2) k from c group by 1)
select {cnt()} as zips, {rnd('sum(s)', 2)} as total_nb_spend, {rnd('sum(o)', 2)} as overlap_spend, {rnd(div0('sum(o)', 'sum(s)'), 4)} as overlap_share,
 {cnt('k>=2')} as zips_2plus, {cnt('k>=3')} as zips_3plus, {rnd('(select avg(n) from c)', 2)} as avg_brands_per_cell from z""")
register("g04_overlap_regions", lambda f: geo.overlap_regions(f[ZIP]), f"""with {CELLS},
 z as (select zip, state, sum(s) s, coalesce(sum(s) filter (where n>=2),0) o, count(*) filter (where n>=2) k from c group by 1,2)
select state as region, {cnt()} as zips, {cnt('k>0')} as overlap_zips, {rnd('sum(s)', 2)} as total_nb_spend, {rnd('sum(o)', 2)} as overlap_spend,
 {rnd(div0('sum(o)', 'sum(s)'), 4)} as overlap_share from z group by 1""")
register("g04_overlap_summary", lambda f: geo.overlap_summary(f[ZIP]), f"""with z as (select zip, count(distinct brand) b, {tot('cost')} s from {{{ZIP}}} group by 1)
select b as brands, {cnt()} as zips, {rnd('sum(s)', 2)} as spend, {rnd('count(*)/sum(count(*)) over ()', 4)} as share from z group by 1""")
