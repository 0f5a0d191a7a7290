"""Registered queries: column expressions, filters and options over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adinsight.functions import dates, fields, grading, matching, numbers
from adinsight.operators import filters
from adinsight.operators.filters import Filters
from adinsight.plans.oracle import (
    ad_grade, category, chg, cnt, div0, divn, has, nonbrand_category, page_grade, rating, region_of, rnd, term_grade, tot,
)
from adinsight.plans.registry import register
from adinsight.plans.sample_facts import CONFIG, Facts

CAMP, AG, QS, KG, ST, ADS, GEO, LP, KB = (
    "fx_campaign_performance", "fx_ad_group_performance", "fx_search_keyword_qs", "fx_keyword_geo", "fx_search_terms",
    "fx_ads_performance", "fx_geographic", "fx_landing_pages", "fx_keyword_brand")


def tally(df: DataFrame, **outcomes: Column) -> DataFrame:
    """Rows of a table per outcome of the expressions under test."""
    return df.groupBy(*[c.alias(n) for n, c in outcomes.items()]).agg(F.count("*").alias("rows"))


def tally_sql(source: str, **outcomes: str) -> str:
    names = ", ".join(f"{x} as {n}" for n, x in outcomes.items())
    return f"select {names}, {cnt()} as rows from {source} group by {', '.join(str(i + 1) for i in range(len(outcomes)))}"


# --- dates --------------------------------------------------------------------------

LABELS = """(select case o_orderkey%6 when 0 then {full} when 1 then upper({full}) when 2 then concat('  ', replace({full},' ','   '), ' ')
 when 3 then {abbr} when 4 then replace({full},' ','-') else null end label from {orders})"""


def labels(f: Facts) -> DataFrame:
    text = LABELS.replace("{full}", "date_format(o_orderdate,'MMMM yyyy')").replace("{abbr}", "date_format(o_orderdate,'MMM yyyy ')")
    return f.spark.sql(f"select * from {text}", orders=f["orders"])


MONTH = "cast(try_strptime(regexp_replace(trim(label),'\\s+',' ','g'),'%B %Y') as date)"
FULL = "regexp_matches(trim(label),'^(?i)(january|february|march|april|may|june|july|august|september|october|november|december)\\s+[0-9]{4}$')"
MKEY = f"case when {FULL.replace('{4}', '[0-9]{0}').replace('[0-9][0-9]{0}', '[0-9]+')} then {MONTH} end"
SQL_LABELS = LABELS.replace("{full}", "strftime(o_orderdate,'%B %Y')").replace("{abbr}", "strftime(o_orderdate,'%b %Y ')")
register("e01_month_key", lambda f: tally(labels(f), month=dates.month_start("label"), ym=dates.ym(dates.month_start("label")), abbr=dates.month_abbr(dates.month_start("label"))),
         tally_sql(SQL_LABELS, month=MKEY, ym=f"strftime({MKEY},'%Y-%m')", abbr=f"strftime({MKEY},'%b %Y')"))
BOUNDS = """(select case o_orderkey%5 when 0 then substr(cast(o_orderdate as string),1,7) when 1 then substr(cast(o_orderdate as string),1,10) when 2 then ''
 when 3 then substr(cast(o_orderdate as string),1,4) else null end b from {orders})"""
register("e02_ym_bound", lambda f: tally(f.spark.sql(f"select * from {BOUNDS}", orders=f["orders"]), bound=dates.month_bound("b")),
         tally_sql(BOUNDS.replace("as string", "as varchar"), bound="cast(nullif(regexp_extract(b,'^(\\d\\d\\d\\d-\\d\\d)',1),'')||'-01' as date)"))
PRESET_SQL = {
    "mtd": ("date_trunc('month',d)", "d"), "lastmonth": ("date_trunc('month',d)-interval 1 month", "date_trunc('month',d)-interval 1 day"),
    "ytd": ("date_trunc('year',d)", "d"), "today": ("d", "d"), "yesterday": ("d-interval 1 day", "d-interval 1 day"),
    "thisweek": ("d-to_days(cast(dayofweek(d) as int))", "d"), "last7": ("d-interval 7 day", "d-interval 1 day"),
    "lastweek": ("d-to_days(cast(dayofweek(d)+7 as int))", "d-to_days(cast(dayofweek(d)+1 as int))"),
    "last14": ("d-interval 14 day", "d-interval 1 day"), "last30": ("d-interval 30 day", "d-interval 1 day"), "all": ("null", "null"),
}
register("x07_date_presets", lambda f: f["orders"].select(F.col("o_orderdate").cast("date").alias("today")).distinct().select(
    "today", F.inline(dates.date_presets("today"))), " union all ".join(
    f"select today, '{n}' as preset, cast({lo} as date) as date_from, cast({hi} as date) as date_to from (select distinct cast(o_orderdate as date) today, cast(o_orderdate as date) d from {{orders}})"
    for n, (lo, hi) in PRESET_SQL.items()))
register("x07_last_days", lambda f: f["orders"].select(F.col("o_orderdate").cast("date").alias("today")).distinct().select(
    "today", dates.last_days("today", 45).alias("b"), dates.last_days("today", 10, "today").alias("t")).select(
    "today", "b.date_from", "b.date_to", F.col("t.date_from").alias("from_today"), F.col("t.date_to").alias("to_today")), """
select distinct cast(o_orderdate as date) as today, cast(o_orderdate-interval 45 day as date) as date_from, cast(o_orderdate-interval 1 day as date) as date_to,
 cast(o_orderdate-interval 9 day as date) as from_today, cast(o_orderdate as date) as to_today from {orders}""")

# --- matching -----------------------------------------------------------------------

register("e03_is_brand", lambda f: tally(f[ST], branded=matching.is_brand("search_term", CONFIG)), tally_sql(f"{{{ST}}}", branded=has("search_term", "gizmo")))
register("e04_category_of", lambda f: tally(f[ST], keyword=F.col("search_term"), category=matching.category_of("search_term", CONFIG),
                                           bucket=matching.category_of("search_term", CONFIG, "Other / uncategorized")),
         tally_sql(f"{{{ST}}}", keyword="search_term", category=category("search_term"), bucket=category("search_term", "'Other / uncategorized'")))
register("e05_nb_category_of", lambda f: tally(f[CAMP], campaign=F.col("campaign"), category=matching.nonbrand_category("campaign", CONFIG)),
         tally_sql(f"{{{CAMP}}}", campaign="campaign", category=nonbrand_category("campaign")))
register("e06_region_of_campaign", lambda f: tally(f[CAMP], campaign=F.col("campaign"), region=matching.region_of_campaign("campaign")),
         tally_sql(f"{{{CAMP}}}", campaign="campaign", region=region_of("campaign")))
PLACES = """(select case when n_nationkey%3=0 then n_name when n_nationkey%3=1 then '' end region, case when n_nationkey%2=0 then r_name end metro, n_name city, c_custkey
 from {customer} join {nation} on n_nationkey=c_nationkey join {region} on r_regionkey=n_regionkey)"""
register("e07_region_value", lambda f: tally(f.spark.sql(f"select * from {PLACES}", customer=f["customer"], nation=f["nation"], region=f["region"]),
                                            region=matching.region_value(["city", "metro", "region"])),
         tally_sql(PLACES, region="coalesce(nullif(region,''),nullif(metro,''),nullif(city,''))"))
register("e17_matched_competitor", lambda f: tally(f[ST], competitor=matching.matched_competitor("search_term", CONFIG)),
         tally_sql(f"{{{ST}}}", competitor=f"case when {has('search_term', 'rod')} then 'rod' when {has('search_term', 'hot')} then 'hot' end"))
register("e15_intent_of", lambda f: tally(f[ST], intent=matching.search_intent("search_term", CONFIG)), tally_sql(
    f"{{{ST}}}", intent=f"case when {has('search_term', 'rod', 'hot')} then 'Competitor' when {has('search_term', 'old')} then 'Irrelevant' "
                       f"when {has('search_term', 'widget', 'bolt', 'ring', 'sets', 'gear', 'gizmo')} then 'Relevant' else 'Needs Review' end"))
register("e20_campaign_short_name", lambda f: tally(f[CAMP], name=matching.short_name("campaign")),
         tally_sql(f"{{{CAMP}}}", name="trim(list_last(string_split(campaign,'|')))"))
register("e21_tokens", lambda f: f["documents"].select("doc_id", F.explode(matching.theme_tokens("text")).alias("token")).groupBy("doc_id").agg(
    F.count("*").alias("tokens"), F.min("token").alias("first"), F.max("token").alias("last")), """
select doc_id, count(*) as tokens, min(token) as first, max(token) as last from (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text),'[a-z0-9]+'))) token from {documents})
 where length(token)>=3 and token not in ('the','for','and','near','you','your','with','are','best','top','buy','shop','store','online') group by 1""")
LISTS = "(select concat(p_brand, case p_size%5 when 0 then ', ' when 1 then '/' when 2 then ' | ' when 3 then ' ' else ',' end, lower(p_type), ' x') brands from {part})"
register("e22_brand_list_match", lambda f: tally(f.spark.sql(f"select * from {LISTS}", part=f["part"]), promo=matching.in_brand_list("brands", "promo"),
                                                brand1=matching.in_brand_list("brands", "Brand#1")),
         tally_sql(LISTS, promo="list_contains(regexp_split_to_array(upper(brands),'[,\\s/|]+'),'PROMO')", brand1="list_contains(regexp_split_to_array(upper(brands),'[,\\s/|]+'),'BRAND#1')"))
register("e23_url_brand", lambda f: tally(f[ADS], url=F.col("ad_final_url"), brand=matching.url_brand("ad_final_url", CONFIG)), tally_sql(
    f"{{{ADS}}}", url="ad_final_url", brand="case when contains(ad_final_url,'/economy/') then 'Brand#1' when contains(ad_final_url,'/standard/') then 'Brand#2' when contains(ad_final_url,'/promo/1') then 'Brand#3' else '' end"))
register("e24_url_host_path", lambda f: f["pages"].select("page_id", matching.url_host("url").alias("host"), matching.url_path("url").alias("path")), """
select page_id, regexp_replace(regexp_extract(url,'^[a-z]+://([^/?#:]+)',1),'^www\\.','') as host, coalesce(nullif(regexp_extract(url,'^[a-z]+://[^/?#]+([^?#]*)',1),''),'/') as path from {pages}""")


def field_of_events(f: Facts) -> DataFrame:
    """The same field read from JSON text and from a map of it."""
    events = f["events"].withColumn("record", F.from_json("props", "map<string,string>"))
    read = events.select(fields.json_get(events, "props", "k").alias("from_text"), fields.json_get(events, "record", "k").alias("from_map"))
    return read.groupBy("from_text", "from_map").agg(F.count("*").alias("rows"))


register("e27_json_get", field_of_events, """select json_extract_string(props,'$.k') as from_text, json_extract_string(props,'$.k') as from_map, count(*) as rows
 from {events} group by 1""")

# --- grades -------------------------------------------------------------------------

register("e08_norm_rating", lambda f: tally(f[QS], raw=F.col("ad_relevance"), rating=grading.rating("ad_relevance")),
         tally_sql(f"{{{QS}}}", raw="ad_relevance", rating=rating("ad_relevance")))
register("e09_grade_term", lambda f: tally(f[ST], grade=grading.grade_term("clicks", "conversions")), tally_sql(f"{{{ST}}}", grade=term_grade()))
GIZMO = has("campaign", "gizmo")
register("e10_grade_ad", lambda f: tally(f[ADS], branded=matching.is_brand("campaign", CONFIG), grade=grading.grade_ad("clicks", "impressions", matching.is_brand("campaign", CONFIG))),
         tally_sql(f"{{{ADS}}}", branded=GIZMO, grade=ad_grade(GIZMO)))
register("e11_grade_lp", lambda f: tally(f[ADS], grade=grading.grade_page("clicks", "impressions", "conversions")), tally_sql(f"{{{ADS}}}", grade=page_grade()))
CVR = div0("conversions", "clicks")
register("e12_lp_score", lambda f: tally(f[ADS], score=grading.page_score("clicks", "conversions")), tally_sql(
    f"{{{ADS}}}", score=f"case when clicks<5 then '—' when {CVR}>=0.45 then 'Excellent' when {CVR}>=0.3 then 'Strong' when {CVR}>=0.2 then 'Average' else 'Below Avg' end"))
register("e13_match_type_bucket", lambda f: tally(f[QS], bucket=grading.match_type_bucket("search_keyword_match_type")), tally_sql(
    f"{{{QS}}}", bucket="case when search_keyword_match_type like 'Exact%' then 'Exact' when search_keyword_match_type like 'Phrase%' then 'Phrase' when search_keyword_match_type like 'Broad%' then 'Broad' else 'Other' end"))
USED = divn("o_totalprice", "250000*(o_orderkey%3)")
register("e14_budget_status", lambda f: tally(f["orders"], status=grading.budget_status(F.col("o_orderkey") % 3 * 250000.0, "o_totalprice")), tally_sql(
    "{orders}", status=f"case when {USED} is null then 'n/a' when {USED}>1.05 then 'over' when {USED}<0.9 then 'under' else 'on-track' end"))
register("e16_keyword_status", lambda f: tally(f[ST], status=grading.keyword_status(F.nullif("added_excluded", F.lit("None")), grading.grade_term("clicks", "conversions"))), tally_sql(
    f"(select *, {term_grade()} g from {{{ST}}})", status="case when added_excluded='Excluded' then 'Excluded' when added_excluded='Added' then 'Already Added' when g[1] in ('A','B','C') then 'Recommend to Add' when g[1]='D' then 'Review' else 'Unassigned' end"))
register("e25_heat_band", lambda f: tally(f[ST], band=grading.heat_band(numbers.ratio0("conversions", "clicks") * 100)), tally_sql(
    f"{{{ST}}}", band=f"case when {CVR}*100>=40 then 'hi' when {CVR}*100>=25 then 'mh' when {CVR}*100>=15 then 'md' when {CVR}*100>=7 then 'lw' else 'vl' end"))

# --- numbers ------------------------------------------------------------------------


def prices(f: Facts) -> DataFrame:
    """Each price of a customer's orders against the total before it was discounted by its key."""
    return f["orders"].select("o_orderkey", F.col("o_totalprice").alias("cur"), (F.col("o_totalprice") - F.col("o_orderkey") % 7 * 1000.0).alias("prev"),
                              (F.col("o_orderkey") % 4).alias("den"))


register("e18_change", lambda f: prices(f).select("o_orderkey", numbers.change("cur", F.when(F.col("den") > 0, F.col("prev")).otherwise(0.0)).alias("change")), f"""
select o_orderkey, {chg('cur', 'prev')} as change from (select o_orderkey, o_totalprice cur, case when o_orderkey%4>0 then o_totalprice-o_orderkey%7*1000e0 else 0e0 end prev from {{orders}})""")
register("e19_ratios", lambda f: prices(f).select("o_orderkey", numbers.rounded(numbers.ratio0("cur", "den"), 4).alias("zero_guard"), numbers.rounded(numbers.ratio_null("cur", "den"), 4).alias("null_guard")), f"""
select o_orderkey, {rnd(div0('o_totalprice', 'o_orderkey%4'), 4)} as zero_guard, {rnd(divn('o_totalprice', 'o_orderkey%4'), 4)} as null_guard from {{orders}}""")


def heat(f: Facts) -> DataFrame:
    """Supplier balances on both heat scales; the extremes come as scalars."""
    s = f["supplier"]
    low, high = s.agg(F.min("s_acctbal")).scalar(), s.agg(F.max("s_acctbal")).scalar()
    c = F.col("s_acctbal")
    return s.select("s_suppkey", numbers.rounded(grading.heat_linear(c, low, high, True), 6).alias("high_is_good"),
                    numbers.rounded(grading.heat_linear(c, low, high, False), 6).alias("low_is_good"), numbers.rounded(grading.heat_sqrt(c, high), 6).alias("root"))


POS = divn("s_acctbal-lo", "hi-lo")
register("e26_heat_scale", heat, f"""select s_suppkey, {rnd('1-' + POS, 6)} as high_is_good, {rnd(POS, 6)} as low_is_good,
 {rnd('case when s_acctbal>0 and hi>0 then sqrt(s_acctbal/hi) end', 6)} as root from {{supplier}}, (select min(s_acctbal) lo, max(s_acctbal) hi from {{supplier}})""")

# --- global filters -----------------------------------------------------------------

TEXTS = {"campaign": "campaign", "ad_group": "ad_group", "search_keyword": "search_keyword", "search_term": "search_term"}


def filtered(f: Facts, view: str, choice: Filters) -> DataFrame:
    return filters.apply_filters(f[view], choice, CONFIG, ad_groups=f[AG], geographic=f[GEO])


BRIDGE = f"(select ad_group, max(campaign) bc from {{{AG}}} group by 1)"


def in_region(region: str) -> str:
    return f"(select distinct ad_group from {{{GEO}}} where state_matched='{region}')"


register("x01_keywords_by_campaign", lambda f: filtered(f, QS, Filters(seg="nb", campaign="Search | Conquest | Tier B - EUROPE", category="Widget")).select("row_index", "search_keyword", "ad_group"), f"""
select row_index, search_keyword, ad_group from {{{QS}}} left join {BRIDGE} using (ad_group) where coalesce(bc='Search | Conquest | Tier B - EUROPE',true)
 and not {has("ad_group||' '||search_keyword", 'gizmo')} and coalesce({category("ad_group||' '||search_keyword")}='Widget',true)""")
register("x01_ads_by_region", lambda f: filtered(f, ADS, Filters(region="NATION_3", brand="Bolt")).groupBy("ad_group", "campaign").agg(F.count("*").alias("ads"), numbers.rounded(numbers.total("cost"), 2).alias("cost")), f"""
select ad_group, campaign, {cnt()} as ads, {rnd(tot('cost'), 2)} as cost from {{{ADS}}} where ad_group in {in_region('NATION_3')} and {has("campaign||' '||ad_group||' '||ad_final_url", 'bolt')} group by 1,2""")
register("x01_ads_of_brand_segment", lambda f: filtered(f, ADS, Filters(seg="br", campaign="Search | small gizmo")).groupBy("ad_group").agg(F.count("*").alias("ads")), f"""
select ad_group, {cnt()} as ads from {{{ADS}}} where campaign='Search | small gizmo' group by 1""")
register("x01_campaigns_by_region", lambda f: filtered(f, CAMP, Filters(region="NATION_3")).groupBy("campaign").agg(F.count("*").alias("months")), f"""
select campaign, {cnt()} as months from {{{CAMP}}} where campaign in (select bc from {BRIDGE} where ad_group in {in_region('NATION_3')}) group by 1""")
register("x01_geo_by_region", lambda f: filtered(f, GEO, Filters(region="NATION_7", category="Gear")).select("state_matched", "ad_group"),
         f"select state_matched, ad_group from {{{GEO}}} where state_matched='NATION_7'")
register("x01_terms_keep_unresolved", lambda f: tally(filtered(f, ST, Filters(campaign="Search | Brand Defense", region="NATION_1", seg="nb")), added=F.col("added_excluded")),
         tally_sql(f"(select * from {{{ST}}} where not {has('search_term', 'gizmo')})", added="added_excluded"))
register("x02_filter_options", lambda f: filters.filter_options(f[CAMP], CONFIG, f[GEO], f[KG]), f"""
select * from (select distinct 'campaign' as kind, campaign as value from {{{CAMP}}} )
union all select 'region', r from (select state_matched r from {{{GEO}}} union select region from {{{KG}}})
union all select * from (values ('category','Widget'),('category','Bolt'),('category','Ring sets'),('category','Gear'),('brand','gizmo'))""")
register("x04_text_search", lambda f: filters.text_search(f["part"], ["p_name", "p_type", "p_brand"], "Widget PROMO Brand#1").select("p_partkey"),
         "select p_partkey from {part} where contains(lower(p_name||' '||p_type||' '||p_brand),'widget promo brand#1')")
register("x05_multi_select", lambda f: filters.multi_select(f[KB], {"brand": ["Brand#1", "Brand#9"], "region": ["NATION_2", "NATION_4"], "keyword": None}).groupBy("brand", "region").agg(F.count("*").alias("rows")),
         f"select brand, region, {cnt()} as rows from {{{KB}}} where brand in ('Brand#1','Brand#9') and region in ('NATION_2','NATION_4') group by 1,2")
register("x06_sort_any", lambda f: filters.sort_any(f[KB].select("brand", "keyword", "region", "impr_share"), "impr_share", descending=False, numeric=True, ties=["brand", "keyword", "region"]),
         f"select brand, keyword, region, impr_share from {{{KB}}} order by impr_share asc nulls last, brand, keyword, region")
register("x06_sort_formatted", lambda f: filters.sort_any(f["orders"].select("o_orderkey", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("price")), "price", numeric=True, ties=["o_orderkey"]).select("o_orderkey"),
         "select o_orderkey from {orders} order by round(o_totalprice,2) desc, o_orderkey")
