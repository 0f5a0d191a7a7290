"""Registered queries: ingestion steps over text and rows derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adinsight.functions import dates, numbers
from adinsight.operators import screening
from adinsight.plans.oracle import cnt, rnd, tot
from adinsight.plans.registry import register
from adinsight.plans.sample_facts import Facts, needed
from adinsight.sources import budget_files, bundle_sink, report_files, warehouse
from adinsight.streaming.arrivals import watch_clients, watch_folder

VARCHAR = ("as string", "as varchar")


def derived(f: Facts, text: str) -> DataFrame:
    return f.spark.sql(text, **{n: f[n] for n in needed(text)})


HEADERS = """select p_partkey, split(concat(case p_partkey%4 when 0 then 'Search term' when 1 then ' Impr. ' when 2 then '--' else 'Cost / conv.' end, ';', p_name, ';', p_type, ';', p_name, ';',
 p_brand, ';', case when p_size%2=0 then p_type else '' end, ';', case when p_size%3=0 then 'Search term' else ' ' end), ';') header from {part}"""
SLUG = "coalesce(nullif(trim(regexp_replace(lower(trim(x)),'[^a-z0-9]+','_','g'),'_'),''),'col')"
register("s02_slug_headers", lambda f: derived(f, HEADERS).select("p_partkey", F.array_join(report_files.header_slugs("header"), ",").alias("slugs")), f"""
with h as ({HEADERS.replace("split(", "string_split(")}), u as (select p_partkey, unnest(header) x, generate_subscripts(header,1) i from h),
 n as (select *, {SLUG} s, max(i) filter (where trim(x)<>'') over (partition by p_partkey) last from u),
 d as (select *, row_number() over (partition by p_partkey, s order by i)-1 k from n where i<=last)
select p_partkey, string_agg(case when k>0 then s||'_'||k else s end, ',' order by i) as slugs from d group by 1""")
CELLS = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case (l_partkey+l_linenumber)%9 when 0 then '--' when 1 then '  ' when 2 then '"< 10%"' when 3 then ' <0.1 '
 when 4 then concat(' "', cast(l_suppkey as string), '" ') when 5 then concat('$', cast(l_partkey as string), ',', '123', '.50') when 6 then concat(cast(l_suppkey as string), '.25%')
 when 7 then l_returnflag else concat('1_', cast(l_suppkey as string)) end cell from {lineitem}"""
CLEAN = "nullif(trim(trim(trim(cell),'\"')),'')"
CLEANED = f"case when {CLEAN} not in ('--','< 10%','<0.1') then {CLEAN} end"
register("s03_clean_nulls", lambda f: derived(f, CELLS).groupBy(numbers.clean_cell("cell").alias("value")).agg(F.count("*").alias("rows")),
         f"select {CLEANED} as value, {cnt()} as rows from ({CELLS.replace(*VARCHAR)}) group by 1")
NUM = "trim(regexp_replace(cell,'[,$%]','','g'))"
NUMBER = f"case when regexp_matches({NUM},'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') then try_cast({NUM} as double) end"
register("s04_parse_number", lambda f: derived(f, CELLS).groupBy(numbers.parse_number("cell").alias("value")).agg(F.count("*").alias("rows")),
         f"select {NUMBER} as value, {cnt()} as rows from ({CELLS.replace(*VARCHAR)}) group by 1")
WINDOWS = """select o_orderkey, case o_orderkey%6 when 0 then concat({long0}, ' - ', {long1}) when 1 then concat({short0}, '  -  ', {short1}) when 2 then concat(' ', {iso0}, ' - ', {iso1})
 when 3 then {long0} when 4 then concat({iso0}, '-', {iso1}) else 'All time' end w from {orders}"""


def windows(long: str, short: str, iso: str) -> str:
    text = WINDOWS
    for name, fmt in (("long", long), ("short", short), ("iso", iso)):
        for i, d in (("0", "o_orderdate"), ("1", "o_orderdate+interval 40 day")):
            text = text.replace("{" + name + i + "}", fmt.replace("X", d))
    return text


ONE = "coalesce(try_strptime(trim(x),'%B %d, %Y'),try_strptime(trim(x),'%b %d, %Y'),try_strptime(trim(x),'%Y-%m-%d'))"
FIRST, SECOND = ONE.replace("x)", "p[1])"), ONE.replace("x)", "p[2])")
register("s05_parse_window", lambda f: derived(f, windows("date_format(X,'MMMM d, yyyy')", "date_format(X,'MMM d, yyyy')", "date_format(X,'yyyy-MM-dd')"))
         .select("o_orderkey", dates.window_bounds("w").alias("b")).select("o_orderkey", "b.*"), f"""
with w as ({windows("strftime(X,'%B %-d, %Y')", "strftime(X,'%b %-d, %Y')", "strftime(X,'%Y-%m-%d')")}), s as (select o_orderkey, regexp_split_to_array(trim(w),'\\s+-\\s+') p from w)
select o_orderkey, cast({FIRST} as date) as window_start, cast(case when len(p)=2 then {SECOND} else {FIRST} end as date) as window_end from s""")
KINDS = {0: "search_term,clicks", 1: "search_keyword,clicks", 2: "search_keyword,metro", 3: "performance_max_placement", 4: "landing_page,clicks", 5: "day,hour_of_the_day",
         6: "audience_segment", 7: "product_title_sold", 8: "distance_from_location_assets", 9: "state_matched,ad_group", 10: "headline_1,ad_group", 11: "keywords_active",
         12: "campaign,campaign_type", 13: "campaign,campaign_type,ad_group", 14: "region,clicks"}
TYPES = {0: "search_terms", 1: "search_keyword_qs", 2: "keyword_geo", 3: "pmax_placements", 4: "landing_pages", 5: "schedule_dow_hod", 6: "audiences", 7: "products_sold",
         8: "distance_from_location", 9: "geographic", 10: "ads_performance", 11: "ad_group_performance", 12: "campaign_performance"}
KIND = "case p_partkey%15 " + " ".join(f"when {k} then '{v}'" for k, v in KINDS.items()) + " end"
register("s06_detect_report", lambda f: derived(f, f"select p_partkey, split(concat({KIND}, ',', lower(p_type)), ',') slugs from {{part}}").select(
    "p_partkey", report_files.detect_report("slugs").alias("report_type")),
    "select p_partkey, case p_partkey%15 " + " ".join(f"when {k} then '{v}'" for k, v in TYPES.items()) + " end as report_type from {part}")

RECORDS = """select 'f' as file, map('price', cast(cast(p_retailprice as decimal(12,2)) as string), 'size', case when p_size%6=0 then null when p_size%7=0 then 'n/a' else cast(p_size as string) end,
 'name', p_name, 'code', case when p_size%3=0 then p_brand else cast(p_partkey as string) end) record from {part}"""


def numeric_sql() -> str:
    cells = {"price": "cast(p_retailprice as varchar)", "size": "case when p_size%6=0 then null when p_size%7=0 then 'n/a' else cast(p_size as varchar) end", "name": "p_name",
             "code": "case when p_size%3=0 then p_brand else cast(p_partkey as varchar) end"}
    rows = " union all ".join(f"select '{c}' col, {x} v from {{part}}" for c, x in cells.items())
    return f"select 'f' as file, col as column, count(v) as present, count(try_cast(v as double)) as numeric, count(try_cast(v as double))>=0.8*count(v) as is_numeric from ({rows}) where v is not null group by col"


register("s07_infer_numeric_columns", lambda f: report_files.numeric_columns(derived(f, RECORDS), ["file"]), numeric_sql())
LANDING = """select cast(l_orderkey*8+l_linenumber as bigint) as row_index, case l_linenumber%3 when 0 then 'search_terms' when 1 then 'campaign_performance' else 'schedule_dow_hod' end report_type,
 map('search_term', concat('term ', cast(l_partkey as string)), 'campaign', concat('Search | ', l_returnflag), 'month', date_format(l_shipdate,'MMMM yyyy'), 'day', date_format(l_shipdate,'yyyy-MM-dd'),
 'clicks', concat(cast(cast(l_quantity as bigint) as string), ',000'), 'cost', concat('$', cast(cast(l_extendedprice as decimal(14,2)) as string)), 'conversions', case when l_suppkey%4=0 then null else '1.50' end) record from {lineitem}"""
register("s08_land_rows", lambda f: report_files.land_rows(derived(f, LANDING)).select("row_index", "report_type", "campaign", "entity", "date", "clicks", "cost", "conversions", "impressions"), """
select cast(l_orderkey*8+l_linenumber as bigint) as row_index, case l_linenumber%3 when 0 then 'search_terms' when 1 then 'campaign_performance' else 'schedule_dow_hod' end as report_type,
 'Search | '||l_returnflag as campaign, case l_linenumber%3 when 0 then 'term '||l_partkey when 1 then 'Search | '||l_returnflag end as entity,
 case l_linenumber%3 when 1 then strftime(l_shipdate,'%B %Y') when 2 then strftime(l_shipdate,'%Y-%m-%d') end as date, cast(l_quantity*1000 as double) as clicks,
 cast(cast(l_extendedprice as decimal(14,2)) as double) as cost, case when l_suppkey%4<>0 then 1.5e0 end as conversions, cast(null as double) as impressions from {lineitem}""")


def keyword_rows(f: Facts, score: str, measured: str = "true") -> DataFrame:
    return derived(f, f"""select 'k.csv' source_file, 'search_keyword_qs' report_type, p_partkey row_index, map('search_keyword', p_name, 'search_keyword_match_type',
 case when p_size%5=0 then null else p_type end, 'campaign', p_brand, 'ad_group', null, 'quality_score', case when {measured} then {score} end, 'exp_ctr', case when p_size%4<>0 and {measured} then 'Average' end) record from {{part}}""")


NEW = "case when p_size%2=0 then cast(p_size%10 as string) end"
OLD = "case when p_size%3=0 then cast(p_size%7 as string) end"
register("s10_preserve_on_reload", lambda f: warehouse.preserve_scores(keyword_rows(f, NEW), keyword_rows(f, OLD, "p_partkey%3<>1")).select(
    "row_index", F.col("record")["quality_score"].alias("quality_score"), F.col("record")["exp_ctr"].alias("exp_ctr")), f"""
with k as (select p_partkey, p_name a, case when p_size%5=0 then null else p_type end b, p_brand c, {NEW.replace(*VARCHAR)} nq, {OLD.replace(*VARCHAR)} oq, case when p_size%4=0 then null else 'Average' end e from {{part}}),
 o as (select * from (select *, row_number() over (partition by a,b,c order by p_partkey desc) rn from k where p_partkey%3<>1 and (oq is not null or e is not null)) where rn=1)
select k.p_partkey as row_index, coalesce(o.oq,k.nq) as quality_score, coalesce(o.e,k.e) as exp_ctr from k left join o on o.a=k.a and o.b is not distinct from k.b and o.c=k.c""")
UPLOADS = """select concat('client ', cast(o_custkey as string)) client_id, case o_orderkey%14 when 0 then 'campaign_performance' when 1 then 'search_terms' when 2 then 'ads_performance' when 3 then 'keyword_geo'
 when 4 then 'geographic' when 5 then 'landing_pages' else 'audiences' end report_type, o_orderkey row_count, cast(o_orderdate as date) uploaded_at from {orders}"""
EXPECTED = "(values " + ",".join(f"('{r}')" for r in warehouse.EXPECTED_REPORTS) + ") e(r)"
register("s12_coverage_inventory", lambda f: warehouse.coverage(derived(f, UPLOADS)), f"""
with u as ({UPLOADS.replace(*VARCHAR)}), l as (select client_id, report_type, max(row_count) row_count from u group by 1,2), c as (select client_id, count(*) n from l group by 1),
 x as (select client_id, r from c, {EXPECTED} union select client_id, report_type from l)
select client_id, r as report_type, row_count is not null as loaded, row_count, r in (select r from {EXPECTED}) as expected, n||'/12' as coverage from x left join (select client_id cid, report_type rt, row_count from l) on cid=client_id and rt=r join c using (client_id)""")
CLIENTS = "select concat('client ', cast(c_custkey as string)) client_id, c_name name from {customer}"
register("s13_client_rollup", lambda f: warehouse.client_rollup(derived(f, CLIENTS), derived(f, UPLOADS)), f"""
select client_id, name, count(distinct report_type) as reports_loaded, max(uploaded_at) as last_upload from ({CLIENTS.replace(*VARCHAR)}) left join ({UPLOADS.replace(*VARCHAR)}) using (client_id) group by 1,2""")
BUDGET = """select cast(n_nationkey+3 as bigint) row_index, array(n_name, c_mktsegment, case when n_nationkey%6=0 then '-' else concat('$', cast(count(*) as string), ',000.60') end) cells
 from {customer} join {nation} on n_nationkey=c_nationkey group by n_nationkey, n_name, c_mktsegment
 union all select cast(min(n_nationkey) as bigint), array('Budget plan') from {nation} union all select cast(min(n_nationkey)+1 as bigint), array('Market','Service Line','Annual Budget') from {nation}"""
register("s14_budget_scan", lambda f: budget_files.budget_lines(derived(f, BUDGET), "annual"), f"""
select cast(null as varchar) as brand, n_name as region, c_mktsegment as category, {rnd('(count(*)*1000+0.6)/12e0', 2)} as monthly
 from {{customer}} join {{nation}} on n_nationkey=c_nationkey where n_nationkey%6<>0 group by 1,2,3""")
DEEP_BUDGET = """select cast(n_nationkey+9 as bigint) row_index, array(c_mktsegment, n_name, concat(cast(count(*) as string), '.50')) cells
 from {customer} join {nation} on n_nationkey=c_nationkey group by n_nationkey, n_name, c_mktsegment
 union all select cast(r_regionkey as bigint), array(concat('Notes on ', r_name)) from {region} union all select cast(r_regionkey+5 as bigint), array() from {region} where r_regionkey<3
 union all select cast(min(n_nationkey)+8 as bigint), array('Product','Region','Monthly Budget') from {nation}"""
register("s14_deep_header", lambda f: budget_files.budget_lines(derived(f, DEEP_BUDGET), header_rows=12), f"""
select cast(null as varchar) as brand, n_name as region, c_mktsegment as category, {rnd('count(*)+0.5e0', 2)} as monthly
 from {{customer}} join {{nation}} on n_nationkey=c_nationkey group by 1,2,3""")
register("s15_bundle_rows", lambda f: bundle_sink.bundle_rows({"regions": f["region"], "nations": f["nation"]}, "sample"), """
select 'sample' as client_id, 'regions' as section, '{"r_regionkey":'||r_regionkey||',"r_name":"'||r_name||'"}' as row from {region}
union all select 'sample', 'nations', '{"n_nationkey":'||n_nationkey||',"n_name":"'||n_name||'","n_regionkey":'||n_regionkey||'}' from {nation}""")
AUCTION = """select concat('domain', cast(s_suppkey as string), '.example') as domain, concat(cast(s_suppkey%100 as string), '.5%') impr_share, concat(cast(s_suppkey%37 as string), '%') overlap_rate,
 case when s_suppkey%5=0 then null else concat(cast(s_suppkey%61 as string), '%') end position_above, concat(cast(s_suppkey%83 as string), '%') top_of_page, concat(cast(s_suppkey%29 as string), '%') outranking from {supplier}"""
register("r05_auction_insights", lambda f: screening.auction_insights(derived(f, AUCTION)), """
select 'domain'||s_suppkey||'.example' as domain, (s_suppkey%100+0.5e0)/100 as impr_share, (s_suppkey%37)/100e0 as overlap_rate, case when s_suppkey%5<>0 then (s_suppkey%61)/100e0 end as position_above,
 (s_suppkey%83)/100e0 as top_of_page, (s_suppkey%29)/100e0 as outranking from {supplier}""")

# --- files on shared storage -----------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir`` or the warehouse; both must be shared on a cluster.

    A folder that was named may be a mounted one, whatever its scheme; Spark's default warehouse on the driver's disk is not shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        unnamed = root.startswith(("/", "file:")) and root.rstrip("/").endswith("/spark-warehouse")
        if unnamed and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{root} is a local folder; set spark.checkpoint.dir to one that driver and executors share")
    return f"{root.rstrip('/')}/adinsight-{uuid.uuid4().hex}"


def export(f: Facts, rows: DataFrame, columns: dict[str, str], folder: str, files: int) -> str:
    """Write rows as ``files`` report exports: title, window, header, data, total row.

    ``rows`` carries ``pick`` (any whole number) that spreads them over the files.
    """
    names = [f"c{i}" for i in range(len(columns))]
    spread = rows.select((F.pmod(F.xxhash64("pick"), F.lit(files))).alias("file"), F.lit(3).alias("line"),
                         *[F.expr(x).cast("string").alias(c) for c, x in zip(names, columns.values())])
    fixed = [["Sample report"], ["March 1, 1995 - August 1, 2001"], list(columns), ["Total", "1", "2"]]
    extra = [
        F.struct(F.lit(i if i < 3 else 4).alias("line"),
                 *[F.lit(cells[k] if k < len(cells) else None).cast("string").alias(c) for k, c in enumerate(names)])
        for i, cells in enumerate(fixed)
    ]
    frame = f.spark.range(files).select(F.col("id").alias("file"), F.inline(F.array(*extra)))
    placed = spread.unionByName(frame).repartition(files, "file").sortWithinPartitions("file", "line")
    lines = placed.select("file", *names).write.partitionBy("file").mode("overwrite")
    lines.option("escape", '"').option("emptyValue", "").csv(folder)
    return folder


TERM_COLUMNS = {
    "Search term": "case when row_index%5=0 then replace(search_term,' ',', ') when row_index%7=0 then replace(search_term,' ','\n') else search_term end",
    "Match type": "'Broad match'", "Added/Excluded": "case when row_index%3=0 then '--' else added_excluded end", "Clicks": "format_number(clicks,0)",
    "Impr.": "case when row_index%4=0 then ' < 10%' else cast(impressions as string) end", "Cost": "concat('$', format_number(cost,6))",
    "Conversions": "cast(conversions as string)", "Clicks ": "'7'",
}


def scanned(f: Facts, count: int, split_bytes: int = report_files.SPLIT_BYTES) -> DataFrame:
    """Search terms written as ``count`` exports and read back, files beyond ``split_bytes`` by several tasks."""
    rows = f["fx_search_terms"].withColumn("pick", F.xxhash64("search_term", "row_index"))
    folder = export(f, rows, TERM_COLUMNS, scratch(f.spark), count)
    paths = report_files.list_reports(folder, recursive=True)
    files = report_files.describe_files(report_files.read_cells(f.spark, paths, "headers"))
    rows = report_files.records(report_files.read_cells(f.spark, paths, split_bytes=split_bytes), files)
    return report_files.land_rows(rows.withColumn("source_file", F.col("file")))  # a task gives its files in several folders one name


def scan_sums(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.groupBy("report_type", F.col("record")["added_excluded"].alias("added")).agg(
        F.count("*").alias("rows"), F.count("impressions").alias("with_impressions"), F.sum(F.size("record")).alias("cells"),
        F.count(F.when(F.col("entity").contains(","), 1)).alias("with_comma"), F.count(F.when(F.col("entity").contains("\n"), 1)).alias("with_break"),
        numbers.whole(numbers.total("clicks")).alias("clicks"), numbers.rounded(numbers.total("cost"), 2).alias("cost"), *more)


SCAN_SQL = f"""
select 'search_terms' as report_type, case when row_index%3<>0 then added_excluded end as added, {cnt()} as rows, {cnt('row_index%4<>0')} as with_impressions, cast(count(*)*8 as bigint) as cells,
 {cnt('row_index%5=0')} as with_comma, {cnt('row_index%5<>0 and row_index%7=0')} as with_break, cast(sum(clicks) as bigint) as clicks, {rnd(tot('cost'), 2)} as cost from {{fx_search_terms}} group by 2"""
register("s01_report_scan", lambda f: scan_sums(scanned(f, 16)), SCAN_SQL)


def split_scanned(f: Facts) -> DataFrame:
    """Search terms in files of some 250,000 rows, read in pieces of 256 KiB; ``places`` counts file and row number."""
    rows = scanned(f, 1 + f["fx_search_terms"].count() // 250_000, 256 << 10)
    return scan_sums(rows, F.count_distinct("source_file", "row_index").alias("places"))


register("s01_split_scan", split_scanned, SCAN_SQL.replace("as rows,", f"as rows, {cnt()} as places,"))

CAMPAIGN_COLUMNS = {"Campaign": "campaign", "Campaign type": "campaign_type", "Month": "date_format(month_start,'MMMM yyyy')", "Clicks": "cast(clicks as string)",
                    "Impr.": "cast(impressions as string)", "Cost": "format_number(cost,6)", "Conversions": "cast(conversions as string)"}


def loaded(f: Facts) -> warehouse.Warehouse:
    """Two clients loaded, one of them again with fewer months (one row per campaign and month)."""
    home = scratch(f.spark)
    rows = f["fx_campaign_performance"].withColumn("pick", F.lit(0))
    first = report_files.list_reports(export(f, rows, CAMPAIGN_COLUMNS, f"{home}/first", 1), recursive=True)
    again = report_files.list_reports(export(f, rows.filter("month_start >= '2000-01-01'"), CAMPAIGN_COLUMNS, f"{home}/again", 1), recursive=True)
    house = warehouse.Warehouse(f.spark, f"{home}/house")
    for client, paths in (("one", first), ("two", first), ("one", again)):
        warehouse.load_files(house, client, paths)
    return house


CAMP = "fx_campaign_performance"
register("s09_snapshot_replace", lambda f: loaded(f).rows().groupBy("client_id", "report_type", "campaign").agg(
    F.count("*").alias("rows"), numbers.rounded(numbers.total("cost"), 2).alias("cost")), " union all ".join(
    f"select '{c}' as client_id, 'campaign_performance' as report_type, campaign, {cnt()} as rows, {rnd(tot('cost'), 2)} as cost from {{{CAMP}}} where month_start>=date '{d}' group by campaign"
    for c, d in (("one", "2000-01-01"), ("two", "1900-01-01"))))
register("s11_write_ledger", lambda f: loaded(f).uploads().select("client_id", "report_type", "window_start", "window_end", "row_count"), " union all ".join(
    f"select '{c}' as client_id, 'campaign_performance' as report_type, date '1995-03-01' as window_start, date '2001-08-01' as window_end, {cnt()} as row_count from {{{CAMP}}} where month_start>=date '{d}'"
    for c, d in (("one", "2000-01-01"), ("two", "1900-01-01"))))


def interrupted(f: Facts) -> DataFrame:
    """Rows and ledger of two clients after a second load of each, of which one is lost before its commit."""
    home = scratch(f.spark)
    rows = f[CAMP].withColumn("pick", F.xxhash64("campaign", "month_start"))
    first = report_files.list_reports(export(f, rows, CAMPAIGN_COLUMNS, f"{home}/first", 1), recursive=True)
    again = report_files.list_reports(export(f, rows.filter("month_start >= '2000-01-01'"), CAMPAIGN_COLUMNS, f"{home}/again", 1), recursive=True)
    house = warehouse.Warehouse(f.spark, f"{home}/house")
    for client, paths in (("one", first), ("two", first), ("one", again)):
        warehouse.load_files(house, client, paths)
    house.stage(house.rows().filter("client_id = 'one'").withColumn("client_id", F.lit("two")))
    sums = house.rows().groupBy("client_id", "report_type").agg(
        F.count("*").alias("rows"), F.count_distinct("row_index").alias("places"), numbers.rounded(numbers.total("cost"), 2).alias("cost"))
    return sums.join(house.uploads().select("client_id", "report_type", "row_count"), ["client_id", "report_type"])


register("s09_versioned_commit", interrupted, " union all ".join(
    f"select '{c}' as client_id, 'campaign_performance' as report_type, {cnt()} as rows, {cnt()} as places, {rnd(tot('cost'), 2)} as cost, {cnt()} as row_count from {{{CAMP}}} where month_start>=date '{d}'"
    for c, d in (("one", "2000-01-01"), ("two", "1900-01-01"))))


def arrived(f: Facts) -> DataFrame:
    """The same campaign report picked up by the arrival stream, run twice."""
    home = scratch(f.spark)
    rows = f[CAMP].withColumn("pick", F.lit(0))
    folder = export(f, rows, CAMPAIGN_COLUMNS, f"{home}/in", 1) + "/file=0"
    house = warehouse.Warehouse(f.spark, f"{home}/house")
    for _ in range(2):
        watch_folder(house, "one", folder, f"{home}/progress").awaitTermination()
    return house.rows().groupBy("client_id", "date").agg(F.count("*").alias("rows"), numbers.rounded(numbers.total("cost"), 2).alias("cost"))


register("r06_file_arrivals", arrived, f"select 'one' as client_id, strftime(month_start,'%B %Y') as date, {cnt()} as rows, {rnd(tot('cost'), 2)} as cost from {{{CAMP}}} group by month_start")


def many_arrived(f: Facts) -> DataFrame:
    """Reports of three clients, a file a batch; the third client's arrives after a restart, then nothing new does."""
    home = scratch(f.spark)
    rows = f[CAMP].withColumn("pick", F.lit(0))
    house = warehouse.Warehouse(f.spark, f"{home}/house")
    for clients in ((0, 1), (2,), ()):
        for c in clients:
            export(f, rows.filter(F.month("month_start") % 3 == c), CAMPAIGN_COLUMNS, f"{home}/in/client{c}", 1)
        watch_clients(house, f"{home}/in", f"{home}/progress", 1).awaitTermination()
    return house.rows().groupBy("client_id", "date").agg(F.count("*").alias("rows"), numbers.rounded(numbers.total("cost"), 2).alias("cost"))


register("r06_stateful_arrivals", many_arrived, f"""select 'client'||(month(month_start)%3) as client_id, strftime(month_start,'%B %Y') as date, {cnt()} as rows, {rnd(tot('cost'), 2)} as cost
 from {{{CAMP}}} group by month_start""")
