import datetime as dt

import pytest
from pyspark.sql import functions as F

import pytest

from adinsight.config import ClientConfig, Rejected, sanitize
from adinsight.functions import fields
from adinsight.functions import dates, grading, matching, numbers
from adinsight.plans.sample_facts import CONFIG
from adinsight.sources.report_files import detect_report, header_slugs, slug

G = grading.GRADES


def lit(v):
    return F.lit(v)


def evaluate(spark, rows, schema, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_clean_and_parse(spark):
    cells = [(' "a" ',), ("--",), ("",), (" < 10% ",), ('"<0.1"',), (None,), ("x",)]
    assert evaluate(spark, cells, "c string", numbers.clean_cell("c")) == ["a", None, None, None, None, None, "x"]
    texts = ["$1,234.5", "12%", "-", "", "1e3", ".5", "5.", "-3", "12d", "1_000", "nan", "inf", "abc", None]
    assert evaluate(spark, [(t,) for t in texts], "c string", numbers.parse_number("c")) == [
        1234.5, 12.0, None, None, 1000.0, 0.5, 5.0, -3.0, None, None, None, None, None, None]


def test_rounding_ratios_and_change(one):
    assert one(numbers.rounded(lit(2.675), 2), numbers.rounded(lit(0.125), 2), numbers.whole(lit(2.5))) == (2.68, 0.13, 3)
    assert one(numbers.ratio0(lit(1.0), lit(0.0)), numbers.ratio_null(lit(1.0), lit(0.0))) == (0.0, None)
    assert one(numbers.change(lit(3.0), lit(2.0)), numbers.change(lit(3.0), lit(0.0)), numbers.change(lit(3.0), lit(None))) == (0.5, None, None)
    assert one(numbers.money_text(lit(1234567.5)), numbers.fixed_text(lit(2.25), 1)) == ("$1,234,568", "2.3")


def test_sums_are_exact_and_null_safe(spark):
    df = spark.createDataFrame([(0.1,)] * 10 + [(None,)], "c double")
    assert df.agg(numbers.total("c")).first()[0] == 1.0
    assert df.filter("c < 0").agg(numbers.total("c")).first()[0] == 0.0
    assert df.agg(numbers.total("c", F.col("c").isNotNull())).first()[0] == 1.0


@pytest.mark.parametrize("label, month", [
    ("June 2026", dt.date(2026, 6, 1)), ("  june   2026 ", dt.date(2026, 6, 1)), ("Jun 2026", None), ("2026 June", None),
    ("June", None), ("", None), (None, None), ("Juny 2026", None), ("June 2026 x", None)])
def test_month_labels(one, label, month):
    assert one(dates.month_start(lit(label).cast("string"))) == month


def test_month_bounds_and_complete_month(one):
    assert one(dates.month_bound(lit("2026-06")), dates.month_bound(lit("2026-06-15")), dates.month_bound(lit("x")),
               dates.month_bound(lit("2026-13"))) == (dt.date(2026, 6, 1), dt.date(2026, 6, 1), None, None)
    ends = {"2026-06-30": (2026, 6), "2026-06-29": (2026, 5), "2026-01-15": (2025, 12), "2024-02-29": (2024, 2), "2025-12-31": (2025, 12)}
    for end, (y, m) in ends.items():
        assert one(dates.complete_month(lit(end).cast("date"))) == dt.date(y, m, 1)


@pytest.mark.parametrize("raw, start, end", [
    ("January 1, 2025 - July 13, 2026", dt.date(2025, 1, 1), dt.date(2026, 7, 13)),
    ("Jan 1, 2025  -  Jul 3, 2026", dt.date(2025, 1, 1), dt.date(2026, 7, 3)),
    ("2025-01-01 - 2025-02-28", dt.date(2025, 1, 1), dt.date(2025, 2, 28)),
    ("May 5, 2025", dt.date(2025, 5, 5), dt.date(2025, 5, 5)), ("All time", None, None), ("a - b - c", None, None)])
def test_windows(one, raw, start, end):
    assert tuple(one(dates.window_bounds(lit(raw)))) == (start, end)


def test_presets(one):
    got = {r["preset"]: (r["date_from"], r["date_to"]) for r in one(dates.date_presets(lit("2026-03-04").cast("date")))}
    d = dt.date
    assert got["mtd"] == (d(2026, 3, 1), d(2026, 3, 4)) and got["lastmonth"] == (d(2026, 2, 1), d(2026, 2, 28))
    assert got["thisweek"] == (d(2026, 3, 1), d(2026, 3, 4)) and got["lastweek"] == (d(2026, 2, 22), d(2026, 2, 28))
    assert got["last7"] == (d(2026, 2, 25), d(2026, 3, 3)) and got["all"] == (None, None)
    sunday = {r["preset"]: r["date_from"] for r in one(dates.date_presets(lit("2026-03-01").cast("date")))}
    assert sunday["thisweek"] == d(2026, 3, 1)


def test_term_grades_at_the_bounds(one):
    cases = [(4, 4, G[5]), (5, 2, G[0]), (10, 4, G[0]), (100, 39.9, G[1]), (4 * 5, 5, G[1]), (20, 3, G[2]), (20, 1, G[3]), (100, 4.9, G[4]), (5, 0, G[4])]
    for clicks, conv, grade in cases:
        assert one(grading.grade_term(lit(clicks), lit(conv))) == grade, (clicks, conv)


def test_ad_and_page_grades_at_the_bounds(one):
    assert one(grading.grade_ad(lit(50), lit(99), lit(False))) == G[5]
    assert one(grading.grade_ad(lit(10), lit(100), lit(False)), grading.grade_ad(lit(10), lit(100), lit(True))) == (G[0], G[2])
    assert one(grading.grade_ad(lit(6), lit(100), lit(False)), grading.grade_ad(lit(2), lit(100), lit(False)), grading.grade_ad(lit(1), lit(100), lit(False))) == (G[1], G[3], G[4])
    assert one(grading.grade_page(lit(4), lit(500), lit(4)), grading.grade_page(lit(5), lit(99), lit(4)), grading.grade_page(lit(5), lit(100), lit(2))) == (G[5], G[5], G[0])
    assert one(grading.page_score(lit(4), lit(4)), grading.page_score(lit(20), lit(9)), grading.page_score(lit(10), lit(3)), grading.page_score(lit(10), lit(2)), grading.page_score(lit(10), lit(1))) == (
        "—", "Excellent", "Strong", "Average", "Below Avg")


def test_statuses_and_buckets(one):
    status = grading.budget_status
    assert one(status(lit(100.0), lit(105.0)), status(lit(100.0), lit(105.01)), status(lit(100.0), lit(90.0)), status(lit(100.0), lit(89.0)), status(lit(0.0), lit(1.0))) == (
        "on-track", "over", "on-track", "under", "n/a")
    k = grading.keyword_status
    assert one(k(lit("Added/Excluded"), lit(G[0])), k(lit("Added"), lit(G[0])), k(lit(None).cast("string"), lit(G[2])), k(lit("None"), lit(G[3])), k(lit("None"), lit(G[5]))) == (
        "Excluded", "Already Added", "Recommend to Add", "Review", "Unassigned")
    assert one(*[grading.rating(lit(x)) for x in ("ABOVE average", "below", "Average", "—")]) == (*["Above average", "Below average", "Average"], None)
    assert one(*[grading.match_type_bucket(lit(x)) for x in ("Exact match (close variant)", "phrase", "BROAD", "x")]) == ("Exact", "Phrase", "Broad", "Other")
    assert one(*[grading.heat_band(lit(x)) for x in (40.0, 39.9, 15.0, 7.0, 6.9)]) == ("hi", "mh", "md", "lw", "vl")
    q = grading.pairing_quadrant
    assert one(q(lit(G[0]), lit(G[3])), q(lit(G[2]), lit(G[1])), q(lit(G[4]), lit(G[0])), q(lit(G[5]), lit(G[0])), q(lit(G[2]), lit(G[3])), q(lit(G[0]), lit(G[2]))) == (
        "red", "green", "amber", "low_volume", "neutral", "neutral")


def test_categories_first_match_and_label(one):
    assert one(matching.category_of(lit("Large BOLT and widget"), CONFIG)) == "Widget"
    assert one(matching.category_of(lit("a set of rings"), CONFIG)) == "Ring sets"
    assert one(matching.category_of(lit("nothing"), CONFIG), matching.category_of(lit("nothing"), CONFIG, "Other")) == (None, "Other")
    assert matching.category_label("tIRES and wheels") == "TIRES and wheels"
    nb = matching.nonbrand_category
    assert one(nb(lit("Search | Brand Defense"), CONFIG), nb(lit("X | brand"), CONFIG), nb(lit("PMax | All"), CONFIG), nb(lit("Competitor"), CONFIG), nb(lit("NonBrand"), CONFIG), nb(lit("x"), CONFIG)) == (
        None, None, "PMax", "Conquest", "Non-Brand Search", "Other Non-Brand")


def test_long_dictionaries_use_one_alternation(one):
    many = ClientConfig(brand_terms=tuple(f"term{i}.x" for i in range(60)) + ("a+b", r"c\E*"))
    hits = [matching.is_brand(lit(t), many) for t in ("my TERM59.x", "term59-x", "the a+b", "aab", "so c\\e* it")]
    assert one(*hits) == (True, False, True, False, True)


def test_regions_and_names(one):
    r = matching.region_of_campaign
    assert one(r(lit("Search | Non-Brand | Tier A - NYC Metro Core")), r(lit("x tier 2: la")), r(lit("x | Tier B – south-east")), r(lit("no token"))) == (
        "NYC Metro Core", "LA", "South-east", None)
    assert one(matching.short_name(lit("A | B | C ")), matching.short_name(lit("A |")), matching.short_name(lit("A"))) == ("C", "A |", "A")


def test_tokens_lists_and_urls(one):
    assert one(matching.theme_tokens(lit("The best TIRES near me, tires 24h ab"))) == ["tires", "24h"]
    assert one(matching.in_brand_list(lit("north, east/WE"), "we"), matching.in_brand_list(lit("north"), "nor")) == (True, False)
    assert one(matching.url_host(lit("https://www.a.example/b?c")), matching.url_path(lit("https://a.example")), matching.url_path(lit("no url"))) == ("a.example", "/", "no url")
    cfg = ClientConfig(url_brands=(("/x", "X"), ("a.example", "A")))
    assert one(matching.url_brand(lit("https://a.example/x"), cfg), matching.url_brand(lit("https://b.example"), cfg)) == ("X", "")


def test_slugs_and_detection(one):
    assert one(*[slug(lit(x)) for x in ("Impr.", " Cost / conv. ", "***", "CTR %")]) == ("impr", "cost_conv", "col", "ctr")
    assert one(header_slugs(F.array(*[lit(x) for x in ("Cost", "Cost", "", "Cost", " ", "")]))) == ["cost", "cost_1", "col", "cost_2"]
    d = lambda *names: detect_report(F.array(*[lit(n) for n in names]))
    assert one(d("search_keyword", "metro"), d("search_keyword"), d("campaign", "campaign_type"), d("campaign", "campaign_type", "ad_group"), d("x")) == (
        "keyword_geo", "search_keyword_qs", "campaign_performance", None, None)
    assert one(d("state_matched", "search_term")) == "search_terms"


def test_heat_scales(one):
    assert one(grading.heat_linear(lit(5.0), lit(0.0), lit(10.0), True), grading.heat_linear(lit(1.0), lit(1.0), lit(1.0), True)) == (0.5, None)
    assert one(grading.heat_sqrt(lit(25.0), lit(100.0)), grading.heat_sqrt(lit(0.0), lit(100.0)), grading.heat_sqrt(lit(5.0), lit(0.0))) == (0.5, None, None)


def test_config_updates_merge_and_sanitise():
    cfg = ClientConfig().updated({"brand_terms": " a, b\nc ", "thresholds": {"qs_floor": "4", "bogus": 1, "low_vol_conv": ""}, "unknown": 1})
    assert cfg.brand_terms == ("a", "b", "c") and cfg.threshold("qs_floor") == 4 and cfg.threshold("low_vol_conv") == 15
    again = cfg.updated({"budget_lines": [{"region": " N ", "monthly": "10.005"}]})
    assert again.brand_terms == cfg.brand_terms and again.budget_lines[0]["region"] == "N" and len(again.budget_lines) == 1
    assert sanitize({"notes": "x" * 5000})["notes"] == "x" * 5000
    for bad in ({"thresholds": {"qs_floor": "x"}}, {"budget_lines": [{"monthly": "x"}]}, {"budget_lines": [3]}, {"brand_terms": 7}, {"url_brands": ["ab"]}):
        with pytest.raises(Rejected, match=next(iter(bad))):
            sanitize(bad)
    assert ClientConfig(name="N").brand_label == "N"


def test_field_access_reads_maps_structs_and_json(spark):
    df = spark.sql("""select '{"k":"1","a b":"2"}' j, map('k', '1', 'a b', '2') m, named_struct('k', 1) s""")
    row = df.select(*[fields.json_get(df, c, "k") for c in "jms"], fields.json_get(df, "j", "a b"), fields.json_get(df, "m", "x"), fields.json_get(df, "s", "x")).first()
    assert tuple(row) == ("1", "1", "1", "2", None, None)
    with pytest.raises(TypeError):
        fields.json_get(spark.range(1), "id", "k")
