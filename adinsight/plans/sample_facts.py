"""Typed report views derived from the star-schema sample tables.

The texts are portable SQL: Spark runs them over DataFrames, the oracle carries
them as common table expressions.  ``{name}`` stands for another table or view.
Money is summed as whole millionths, so both engines agree to the last bit.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from adinsight.config import ClientConfig

CONFIG = ClientConfig(
    client_id="sample",
    name="Sample",
    brand_terms=("gizmo",),
    product_categories=("widget", "bolt", "ring sets", "gear"),
    competitors_conquest=("rod",),
    competitors_friendly=("hot",),
    waste_exclusions=("old",),
    url_brands=(("/economy/", "Brand#1"), ("/standard/", "Brand#2"), ("/promo/1", "Brand#3")),
)
SEASONAL = CONFIG.updated({"seasonality": [{"label": "summer dip", "months": ["Jul", "August"]}]})

VIEWS: dict[str, str] = {
    "li": """
select l.*, cast(l_quantity as bigint) as qty,
 cast(round(l_extendedprice*100) as bigint)*cast(round(abs(l_discount)*100) as bigint) as cost_u,
 case when l_returnflag='R' and l_suppkey%3=0 then cast(l_quantity as bigint) else 0 end as conv_n
from {lineitem} l""",
    "fx_campaign_performance": """
select case c_mktsegment when 'BUILDING' then 'Search | Brand Defense'
  when 'MACHINERY' then concat('PMax | Tier A - ', r_name) when 'AUTOMOBILE' then concat('Search | Conquest | Tier B - ', r_name)
  when 'FURNITURE' then concat('Search | Non-Brand | Tier A - ', r_name) else concat('Search | Widgets | Tier C - ', r_name) end as campaign,
 case c_mktsegment when 'MACHINERY' then 'Performance Max' else 'Search' end as campaign_type, month_start,
 sum(qty*20) as impressions, sum(qty) as clicks, sum(cost_u)/1e6 as cost, sum(conv_n) as conversions, sum(conv_n)*25 as conv_value
from (select c_mktsegment, r_name, cast(date_trunc('month', o_orderdate) as date) as month_start,
  cast(sum(qty) as bigint) as qty, cast(sum(cost_u) as bigint) as cost_u, cast(sum(conv_n) as bigint) as conv_n
 from {orders} join {customer} on o_custkey=c_custkey join {nation} on n_nationkey=c_nationkey join {region} on r_regionkey=n_regionkey join {li} on l_orderkey=o_orderkey
 group by 1,2,3) segments
group by 1,2,3""",
    "fx_months": """
select cast(date_trunc('month', o_orderdate) as date) as month_start from {orders} group by 1""",
    "fx_uploads": """
select 'sample' as client_id, o_orderpriority as report_type, cast(min(o_orderdate) as date) as window_start,
 cast(max(o_orderdate) as date) as window_end, count(*) as row_count from {orders} group by 2""",
    "fx_ad_group_performance": """
select concat('AG ',p_brand) as ad_group,
 case cast(substr(p_brand,7) as int)%5 when 0 then 'Search | Brand Defense' when 1 then 'PMax | Tier A - ASIA' when 2 then 'Search | Conquest | Tier B - EUROPE'
  when 3 then 'Search | Non-Brand | Tier A - AFRICA' else 'Search | Widgets | Tier C - AMERICA' end as campaign,
 count(distinct p_partkey) as keywords_active, sum(qty) as clicks, sum(qty*20) as impressions, sum(cost_u)/1e6 as cost, sum(conv_n) as conversions
from {li} join {part} on p_partkey=l_partkey group by 1,2""",
    "fx_search_keyword_qs": """
select p_partkey as row_index, lower(concat(p_name,' ',p_type)) as search_keyword,
 case p_partkey%4 when 0 then 'Exact match' when 1 then 'Phrase match' when 2 then 'Broad match' else 'Exact match (close variant)' end as search_keyword_match_type,
 concat('AG ', p_brand) as ad_group, p_brand as brand, case when p_size%11=0 then null else cast(p_size%11 as string) end as quality_score,
 case p_size%3 when 0 then 'Below average' when 1 then 'Average' else 'Above average' end as exp_ctr,
 case p_partkey%5 when 0 then 'Below average' when 1 then 'Above average' when 2 then null else 'Average' end as ad_relevance,
 case (p_partkey+p_size)%4 when 0 then 'Below average' when 1 then 'Above average' else 'Average' end as landing_page_exp,
 coalesce(sum(qty*15),0) as impressions, coalesce(sum(qty),0) as clicks, coalesce(sum(cost_u),0)/1e6 as cost, coalesce(sum(conv_n),0) as conversions
from {part} left join {li} on l_partkey=p_partkey group by 1,2,3,4,5,6,7,8,9""",
    "fx_keyword_geo": """
select lower(concat(p_name,' ',p_type)) as search_keyword, n_name as region, 'Phrase match' as search_keyword_match_type,
 sum(qty) as clicks, sum(cost_u)/1e6 as cost, sum(conv_n) as conversions
from {li} join {part} on p_partkey=l_partkey join {supplier} on s_suppkey=l_suppkey join {nation} on n_nationkey=s_nationkey group by 1,2""",
    "fx_search_terms": """
select lower(concat(p_name,' ',p_type,' ',replace(p_brand,'#',' '))) as search_term, p_brand as brand,
 cast(l_linenumber*7 + l_suppkey%7 as int) as row_index,
 case l_linenumber%3 when 0 then 'Added' when 1 then 'None' else 'Excluded' end as added_excluded,
 sum(qty) as clicks, sum(qty*12) as impressions, sum(cost_u)/1e6 as cost, sum(conv_n) as conversions
from {li} join {part} on p_partkey=l_partkey group by 1,2,3,4""",
    "fx_ads_performance": """
select concat('Search | ', p_name) as campaign, concat('AG ',p_brand) as ad_group, p_brand as brand,
 concat('https://www.shop.example.org/', lower(p_type), '/', cast(l_suppkey%20 as string)) as ad_final_url,
 p_name as headline_1, p_type as headline_2, cast(l_suppkey%20 as int) as row_index,
 sum(qty) as clicks, sum(qty*(2+(l_partkey%17)*(l_partkey%5))) as impressions, sum(cost_u)/1e6 as cost, sum(conv_n) as conversions
from {li} join {part} on p_partkey=l_partkey group by 1,2,3,4,5,6,7""",
    "fx_geographic": """
select n_name as state_matched, concat('AG ',p_brand) as ad_group, sum(qty*20) as impressions, sum(qty) as clicks, sum(conv_n) as conversions, sum(conv_n)*25 as conv_value,
 case when sum(conv_n)>0 then sum(cost_u)/1e6/sum(conv_n) end as cost_conv
from {li} join {part} on p_partkey=l_partkey join {supplier} on s_suppkey=l_suppkey join {nation} on n_nationkey=s_nationkey group by 1,2""",
    "fx_pmax_placements": """
select url as performance_max_placement, cast(page_id%4 as bigint)*cast(page_id%97 as bigint)%23 as impressions from {pages}""",
    "fx_landing_pages": """
select concat('https://shop.example.org/', lower(p_type), '/', cast(l_suppkey%20 as string), '/', cast(p_size as string)) as landing_page,
 case when l_suppkey%3=0 then null else cast(1+l_suppkey%10 as string) end as mobile_speed_score, cast(l_suppkey as int) as row_index,
 sum(qty) as clicks, sum(qty*9) as impressions, sum(cost_u)/1e6 as cost from {li} join {part} on p_partkey=l_partkey group by 1,2,3""",
    "fx_schedule_dow_hod": """
select cast(ts as date) as day, extract(hour from ts) as hour_of_the_day, count(*) as impressions, sum(case when event_type='click' then 1 else 0 end) as clicks,
 sum(case when event_type='purchase' then 1 else 0 end) as conversions, sum(cast(round(value*100) as bigint))/1e2 as cost from {events} group by 1,2""",
    "fx_budget_lines": """
select cast(null as string) as brand, r_name as region, case c_mktsegment when 'BUILDING' then null when 'MACHINERY' then 'Widget' else c_mktsegment end as category,
 count(*)*12.5 as monthly
from {customer} join {nation} on n_nationkey=c_nationkey join {region} on r_regionkey=n_regionkey group by 1,2,3""",
    "fx_brand_month": """
select p_brand as brand, r_name as region, p_type as category,
 case c_mktsegment when 'MACHINERY' then 'Performance Max' else 'Search' end as campaign_type,
 cast(date_trunc('month', o_orderdate) as date) as month_start,
 sum(qty*20) as impressions, sum(qty) as clicks, sum(cost_u)/1e6 as cost, sum(conv_n) as conversions,
 sum(case when l_linestatus='O' then conv_n else 0 end) as web_reservations, sum(case when l_linestatus='F' then conv_n else 0 end) as calls
from {orders} join {customer} on o_custkey=c_custkey join {nation} on n_nationkey=c_nationkey join {region} on r_regionkey=n_regionkey
 join {li} on l_orderkey=o_orderkey join {part} on p_partkey=l_partkey
group by 1,2,3,4,5""",
    "fx_zip_spend": """
select concat('Z', cast(l_suppkey as string)) as zip, n_name as state, p_type as category, p_brand as brand, cost_u/1e6 as cost
from {li} join {part} on p_partkey=l_partkey join {supplier} on s_suppkey=l_suppkey join {nation} on n_nationkey=s_nationkey""",
    "fx_keyword_brand": """
select p_brand as brand, lower(concat(p_name,' ',p_type)) as keyword, n_name as region, sum(cost_u)/1e6 as spend, sum(conv_n) as conv,
 sum(qty) as clicks, sum(qty*(5+l_linenumber)) as impressions,
 cast(case when max(l_linenumber)=1 then null else 10+max(p_size)*1.5 end as double) as impr_share,
 cast(min(p_size)*0.5 as double) as is_lost_rank, cast(max(l_linenumber)*2 as double) as is_lost_bud,
 cast(1+max(p_size)%10 as double) as qs,
 case max(p_size)%4 when 0 then 'Below average' when 1 then 'Above average' when 2 then 'Average' end as lp_exp,
 case max(l_linenumber)%3 when 0 then 'Below average' when 1 then 'Above average' else 'Average' end as ad_rel,
 case min(l_linenumber)%3 when 0 then 'Below average' when 1 then 'Above average' else '' end as ectr
from {li} join {part} on p_partkey=l_partkey join {supplier} on s_suppkey=l_suppkey join {nation} on n_nationkey=s_nationkey group by 1,2,3""",
    "fx_lp_device": """
select concat('https://shop.example.org/', lower(p_type), '/', cast(l_suppkey as string)) as url, sum(cost_u)/1e6 as cost, sum(qty) as clicks,
 sum(case when l_linenumber<=3 then cost_u else 0 end)/1e6 as mobile_cost, sum(case when l_linenumber<=3 then qty else 0 end) as mobile_clicks,
 sum(case when l_linenumber between 4 and 6 then cost_u else 0 end)/1e6 as desktop_cost, sum(case when l_linenumber between 4 and 6 then qty else 0 end) as desktop_clicks,
 sum(case when l_linenumber>6 then cost_u else 0 end)/1e6 as tablet_cost, sum(case when l_linenumber>6 then qty else 0 end) as tablet_clicks,
 sum(case when l_linenumber<=3 then conv_n else 0 end)*1e0/nullif(sum(case when l_linenumber<=3 then qty else 0 end),0) as mobile_cvr,
 sum(case when l_linenumber between 4 and 6 then conv_n else 0 end)*1e0/nullif(sum(case when l_linenumber between 4 and 6 then qty else 0 end),0) as desktop_cvr,
 sum(case when l_linenumber>6 then conv_n else 0 end)*1e0/nullif(sum(case when l_linenumber>6 then qty else 0 end),0) as tablet_cvr
from {li} join {part} on p_partkey=l_partkey group by 1""",
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")
_SCHEMAS: dict[str, StructType] = {}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A sample table; its footer is read for the schema only the first time."""
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


class Facts:
    """Lazy access to the sample tables and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            text = VIEWS.get(name)
            if text is None:
                self._frames[name] = read_table(self.spark, f"{self.sf_dir}/{name}.parquet")
            else:
                self._frames[name] = self.spark.sql(text, **{n: self[n] for n in needed(text)})
        return self._frames[name]


def needed(text: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(text)))


@cache
def _closure(name: str) -> tuple[str, ...]:
    """The view and the views below it, dependencies first."""
    if name not in VIEWS:
        return ()
    below = [v for n in needed(VIEWS[name]) for v in _closure(n)]
    return tuple(dict.fromkeys([*below, name]))


def with_views(sql: str) -> str:
    """The oracle text with the views it mentions in front, as CTEs.

    ``{name}`` in the text marks a view or a base table.
    """
    views = list(dict.fromkeys(v for n in needed(sql) for v in _closure(n)))
    plain = lambda text: _PLACEHOLDER.sub(r"\1", text).strip()
    body = plain(sql)
    ctes = [f"{v} as ({plain(VIEWS[v])})" for v in views]
    if body.lower().startswith("with "):
        ctes.append(body[5:])
        return "with " + ",\n".join(ctes)
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body
