"""Registered queries: ads and landing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adinsight.operators import ads, landing_pages
from adinsight.plans.oracle import GRADE_LIST, ad_grade, category, cnt, div0, divn, has, page_grade, rnd, tot, whole
from adinsight.plans.registry import register
from adinsight.plans.sample_facts import CONFIG, Facts

ADS, LP, DEV = "fx_ads_performance", "fx_landing_pages", "fx_lp_device"
BRANDED = has("concat(campaign,' ',ad_group)", "gizmo")
HEADLINE = "concat(headline_1,' | ',headline_2)"
A = f"""a as (select case when {BRANDED} then 'branded' else 'nonbranded' end segment, campaign, ad_group, ad_final_url final_url, {HEADLINE} headline, row_index,
 {category("concat(ad_group,' '," + HEADLINE + ")", "'Uncategorized'")} category, {ad_grade(BRANDED)} grade, {page_grade()} lp_grade, clicks, impressions, cost, conversions
 from {{{ADS}}} where impressions>0 or cost>0)"""
ORDER = "order by cost desc, ad_group, headline, final_url, row_index"
COLS = f"""segment, ad_group, final_url, headline, row_index, category, grade, lp_grade, {whole('clicks')} as clicks, {whole('impressions')} as impr, {rnd('cost', 2)} as cost,
 {rnd('conversions', 1)} as conv, {rnd(div0('clicks', 'impressions'), 4)} as ctr, {rnd(div0('cost', 'clicks'), 2)} as cpc, {rnd(div0('conversions', 'clicks'), 4)} as cvr"""

register("a01_ad_inventory", lambda f: ads.inventory(f[ADS], CONFIG), f"""with {A} select {COLS}, campaign, '' as type, cast(2 as int) as headlines, cast(0 as int) as descriptions,
 (select count(*) from a) as served from (select * from a {ORDER} limit 100)""")
register("a02_ad_grade_summary", lambda f: ads.grade_summary(f[ADS], CONFIG), f"""with {A} select segment, grade, n as ads, {whole('i')} as impr, {whole('k')} as clicks,
 {rnd(div0('k', 'i'), 4)} as ctr, {rnd('s', 2)} as spend, {rnd(div0('s', 'sum(s) over (partition by segment)'), 4)} as spend_share, {whole('v')} as conv, {rnd(div0('v', 'k'), 4)} as cvr
 from (select segment, grade, {cnt()} n, {tot('impressions')} i, {tot('clicks')} k, {tot('cost')} s, {tot('conversions')} v from a group by 1,2)""")
register("a03_ad_detail", lambda f: ads.detail(f[ADS], CONFIG), f"""with {A} select {COLS}, cast(rn as int) as rank from
 (select *, row_number() over (partition by segment {ORDER}) rn from a) where rn<=100""")
GRID = f"""{A}, g as (select s.segment, x.label grade, y.label lp_grade, coalesce(n,0) n, coalesce(c,0e0) c from (select distinct segment from a) s, {GRADE_LIST.replace('grades(', 'x(')},
 {GRADE_LIST.replace('grades(', 'y(')} left join (select segment, grade, lp_grade, {cnt()} n, {tot('cost')} c from a group by 1,2,3) v on v.segment=s.segment and v.grade=x.label and v.lp_grade=y.label)"""
register("a04_ad_lp_grid", lambda f: ads.pairing_grid(f[ADS], CONFIG), f"""with {GRID} select segment, grade, lp_grade, cast(n as bigint) as ads, {rnd('c', 2)} as spend,
 {rnd(div0('n', 'sum(n) over (partition by segment)'), 4)} as pct from g""")
register("a05_ad_lp_totals", lambda f: ads.pairing_totals(f[ADS], CONFIG), f"with {GRID} " + " union all ".join(
    f"select segment, '{level}' as level, {label} as label, cast(sum(n) as bigint) as ads, {rnd('sum(c)', 2)} as spend from g group by segment, {label}"
    for level, label in (("ad_grade", "grade"), ("page_grade", "lp_grade"), ("grand", "cast(null as varchar)"))))
STRONG, WEAK, STRONG2, WEAK2 = "grade[1] in ('A','B')", "grade[1] in ('D','F')", "lp_grade[1] in ('A','B')", "lp_grade[1] in ('D','F')"
ALIGNED = cnt(f"{STRONG} and {STRONG2}")
register("a06_ad_lp_stats", lambda f: ads.pairing_stats(f[ADS], CONFIG), f"""with {A} select segment, {cnt()} as total, {ALIGNED} as aligned,
 {cnt(f'{STRONG} and {WEAK2}')} as fix_lp, {cnt(f'{WEAK} and {STRONG2}')} as fix_ad, {cnt("grade='Low Volume' or lp_grade='Low Volume'")} as low_vol,
 {rnd(div0(ALIGNED, 'count(*)'), 4)} as aligned_pct from a group by 1""")
QUADRANT = f"""case when grade='Low Volume' or lp_grade='Low Volume' then 'low_volume' when {STRONG} and {WEAK2} then 'red' when grade[1] in ('A','B','C') and {STRONG2} then 'green'
 when {WEAK} and {STRONG2} then 'amber' else 'neutral' end"""
register("a07_pairing_quadrants", lambda f: ads.pairing_quadrants(f[ADS], CONFIG),
         f"with {A} select segment, {QUADRANT} as quadrant, {cnt()} as ads, {rnd(tot('cost'), 2)} as spend from a group by 1,2")
register("a08_ad_options", lambda f: ads.options(f[ADS], CONFIG), f"""with {A} select distinct segment, 'category' as kind, category as value from a where category<>'Uncategorized'
 union all select distinct segment, 'grade', grade from a""")


def lookup(f: Facts) -> DataFrame:
    """Known landing pages of one brand, derived from the landing page report."""
    urls = f[ADS].filter(F.col("ad_final_url").contains("/small/")).select(F.col("ad_final_url").alias("url")).distinct()
    return urls.withColumn("brand", F.lit("Brand#4"))


URL_BRAND = """case when contains(ad_final_url,'/small/') then 'Brand#4' when contains(lower(ad_final_url),'/economy/') then 'Brand#1'
 when contains(lower(ad_final_url),'/standard/') then 'Brand#2' when contains(lower(ad_final_url),'/promo/1') then 'Brand#3' else '' end"""
register("a09_lp_mismatches", lambda f: ads.page_mismatches(f[ADS], CONFIG, lookup(f)).groupBy("brand", "url_brand").agg(
    F.count("*").alias("ads"), F.count_distinct("final_url").alias("urls")), f"""select brand, {URL_BRAND} as url_brand, {cnt()} as ads, count(distinct ad_final_url) as urls
 from {{{ADS}}} where {URL_BRAND}<>'' and {URL_BRAND}<>brand group by 1,2""")

# --- landing pages ------------------------------------------------------------------

PAGES = f"""p as (select landing_page url, {tot('clicks')} k, {tot('impressions')} i, {tot('cost')} c, arg_min(mobile_speed_score, row_index) filter (where mobile_speed_score is not null) speed
 from {{{LP}}} group by 1)"""
register("l01_landing_pages", lambda f: landing_pages.landing_pages(f[LP]), f"""with {PAGES} select url, {whole('k')} as clicks, {whole('i')} as impr, {rnd('c', 2)} as cost,
 {rnd(div0('k', 'i'), 4)} as ctr, speed, (select count(*) from p) as pages from (select * from p order by c desc, url limit 50)""")
SHOP = CONFIG.updated({"product_categories": ["promo goods", "standard", "Economy"]})
URL_CAT = "case when contains(lower(url),'promo') or contains(lower(url),'goods') then 'Promo goods' when contains(lower(url),'standard') then 'Standard' when contains(lower(url),'economy') then 'Economy' else 'Other / uncategorized' end"
register("l02_lp_url_categories", lambda f: landing_pages.url_categories(f[LP], SHOP), f"""with {PAGES} select {URL_CAT} as category, {cnt()} as landing_pages,
 {whole('sum(k)')} as clicks, {rnd('sum(c)', 2)} as cost from p group by 1""")
register("l02_lp_no_category", lambda f: landing_pages.url_categories(f[LP], CONFIG), f"""with {PAGES} select '' as category, {cnt()} as landing_pages, 0 as clicks, 0e0 as cost
 from p where {has('url', 'widget', 'bolt', 'ring', 'sets', 'gear')} group by 1""")
SCORE = f"case when k<5 then '—' when {div0('v', 'k')}>=0.45 then 'Excellent' when {div0('v', 'k')}>=0.30 then 'Strong' when {div0('v', 'k')}>=0.20 then 'Average' else 'Below Avg' end"
register("l03_lp_performance", lambda f: landing_pages.performance(f[ADS]), f"""select ad_final_url as url, {rnd('c', 2)} as cost, {whole('k')} as clicks, {rnd('v', 1)} as conv,
 {rnd(div0('v', 'k'), 4)} as cvr, {rnd(divn('c', 'v'), 2)} as cpa, {SCORE} as score from (select ad_final_url, {tot('cost')} c, {tot('clicks')} k, {tot('conversions')} v from {{{ADS}}} group by 1 order by 2 desc, 1 limit 50)""")
ADCAT = f"case when {BRANDED} then 'BR' else {category("concat(ad_group,' ',headline_1)", "'Other'")} end"
CELLS = f"""c as (select ad_final_url url, {ADCAT} category, {tot('clicks')} k, {tot('conversions')} v, {tot('cost')} s from {{{ADS}}} group by 1,2),
 u as (select url, sum(k) k, sum(v) v, sum(s) s, count(*) n from c group by 1)"""
register("l04_lp_category_grid", lambda f: landing_pages.category_grid(f[ADS], CONFIG), f"""with {CELLS} select c.url, category, {rnd(divn('c.v', 'c.k'), 4)} as cvr, {rnd('t.s', 2)} as url_cost,
 {whole('t.k')} as url_clicks, {rnd('t.v', 1)} as url_conv, {rnd(div0('t.v', 't.k'), 4)} as overall_cvr, n as n_cats from c join (select * from u order by s desc, url limit 100) t using (url)""")
register("l04_grid_categories", lambda f: landing_pages.grid_categories(f[ADS], CONFIG), f"with {CELLS} select category, {rnd('sum(s)', 2)} as spend from c group by 1")
register("l04_grid_stats", lambda f: landing_pages.grid_stats(f[ADS], CONFIG), f"""with {CELLS} select {cnt()} as landing_pages, {rnd('sum(s)', 2)} as spend, {whole('sum(k)')} as clicks,
 {rnd('sum(v)', 1)} as conversions, {rnd(div0('sum(v)', 'sum(k)'), 4)} as weighted_cvr, {rnd('avg(n)', 1)} as avg_cats from u""")
EXT = f"""x as (select *, {divn('v', 'k')} r from c), o as (select *, row_number() over (partition by category order by r, url) lo, row_number() over (partition by category order by r desc, url desc) hi,
 count(*) over (partition by category) n from x where r is not null)"""


def pick(column: str, where: str) -> str:
    return f"max({column}) filter (where {where})"


LOWER, UPPER = pick("r", "lo=(n+1)//2"), pick("r", "lo=n//2+1")
register("l05_lp_category_summary", lambda f: landing_pages.category_summary(f[ADS], CONFIG), f"""with {CELLS}, {EXT}, e as (select category, {rnd(pick('r', 'lo=1'), 4)} as min_cvr,
  {rnd(UPPER, 4)} as median_cvr, {rnd(pick('r', 'hi=1'), 4)} as max_cvr, {pick('url', 'hi=1')} as best_lp, {pick('url', 'lo=1')} as worst_lp from o group by 1)
select category, lps_running, spend, min_cvr, median_cvr, max_cvr, best_lp, worst_lp from e join (select category, {cnt()} as lps_running, {rnd('sum(s)', 2)} as spend from c group by 1) using (category)""")
register("l06_lp_category_rollup", lambda f: landing_pages.category_rollup(f[ADS], CONFIG), f"""with {CELLS}, {EXT} select category, {cnt()} as pages, {rnd('sum(us)', 2)} as spend,
 {rnd(pick('r', 'lo=1'), 4)} as min_cvr, {rnd(f'({LOWER}+{UPPER})/2', 4)} as median_cvr, {rnd(pick('r', 'hi=1'), 4)} as max_cvr, {pick('url', 'hi=1')} as best_lp, {pick('url', 'lo=1')} as worst_lp
 from o join (select url, s us from u) u using (url) group by 1""")
register("l06_median_by_page", lambda f: landing_pages.page_medians(f[ADS], CONFIG), f"""with {CELLS}, x as (select *, {divn('v', 'k')} r from c),
 o as (select *, row_number() over (partition by url order by r, category) lo, count(*) over (partition by url) n from x where r is not null)
select url, {rnd(LOWER, 4)} as lower_median, {rnd(f'({LOWER}+{UPPER})/2', 4)} as median_cvr, {rnd(UPPER, 4)} as upper_median from o group by 1""")


def device_sql() -> str:
    rows = " union all ".join(f"select '{d}' device, url, {d}_cvr r, {d}_cost c, {d}_clicks k from {{{DEV}}} where {d}_cvr is not null and {d}_clicks>0" for d in landing_pages.DEVICES)
    return f"""with l as ({rows}), q as (select *, count(*) filter (where k>=100) over (partition by device) big from l),
 b as (select device, arg_max(url, (r,url)) as best_lp, arg_min(url, (r,url)) as worst_lp from q where big=0 or k>=100 group by 1)
select device, {cnt()} as pages, {rnd(tot('c'), 2)} as cost, {whole(tot('k'))} as clicks, {rnd(div0(tot('r*k'), tot('k')), 4)} as cvr,
 {rnd(div0(tot('k'), f'(select {tot("clicks")} from {{{DEV}}})'), 4)} as click_share, {rnd(div0(tot('c'), f'(select {tot("cost")} from {{{DEV}}})'), 4)} as spend_share,
 any_value(best_lp) as best_lp, any_value(worst_lp) as worst_lp from q join b using (device) group by device"""


register("l07_lp_device_grid", lambda f: landing_pages.device_rollup(f[DEV]), device_sql())
