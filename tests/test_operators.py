import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from adinsight.config import ClientConfig
from adinsight.operators import (
    ads, budget, common, findings, geo, keywords, landing_pages, quality, relevance, screening, terms, trends,
)
from adinsight.operators.filters import Filters, apply_filters, multi_select, sort_any, text_search
from adinsight.plans.sample_facts import CONFIG, Facts

SF = "/root/testdata/sf0.001"
CAMPAIGN = ("campaign string, campaign_type string, month_start date, impressions double, clicks double, cost double, "
            "conversions double, conv_value double")


@pytest.fixture(scope="module")
def facts(spark):
    return Facts(spark, SF)


def campaigns(spark, *rows):
    return spark.createDataFrame([(c, "Search", dt.date(y, m, 1), 1000.0, 100.0, cost, conv, 0.0) for c, y, m, cost, conv in rows], CAMPAIGN)


def month(y, m):
    return F.lit(dt.date(y, m, 1))


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- trends -----------------------------------------------------------------------------


def test_partial_month_is_dropped_and_ranges_apply(spark):
    df = campaigns(spark, ("A", 2025, 1, 10.0, 1.0), ("A", 2025, 2, 20.0, 0.0), ("A", 2025, 3, 30.0, 3.0))
    got = rows(trends.total_trend(df, month(2025, 2)))
    assert [(r["month"], r["spend"], r["cpa"]) for r in got] == [("2025-01", 10.0, 10.0), ("2025-02", 20.0, 0.0)]
    assert [r["month"] for r in rows(trends.total_trend(df, month(2025, 3), "2025-02", "2025-02-20"))] == ["2025-02"]


def test_kpis_fall_back_to_the_previous_available_month(spark):
    df = campaigns(spark, ("A", 2025, 1, 10.0, 1.0), ("A", 2025, 4, 20.0, 4.0))
    spend = rows(trends.kpi_scorecard(df, month(2025, 4)))[0]
    assert (spend["prior"], spend["current"], spend["change"], spend["prior_label"]) == (10.0, 20.0, 1.0, "Jan 2025")
    lone = rows(trends.kpi_scorecard(df, month(2025, 1)))[0]
    assert (lone["prior"], lone["change"], lone["prior_label"]) == (0.0, None, "—")
    custom = rows(trends.kpi_scorecard(df, month(2025, 4), "custom", compare_from="2024-01"))[0]
    assert custom["prior"] == 10.0
    assert rows(trends.kpi_scorecard(df.filter("cost < 0"), month(2025, 4))) == []


def test_categories_fall_back_to_the_calendar_month(spark):
    df = campaigns(spark, ("Non-brand", 2025, 1, 10.0, 1.0), ("Non-brand", 2025, 4, 20.0, 4.0), ("PMax", 2025, 3, 5.0, 1.0))
    got = {r["category"]: r for r in rows(trends.nonbrand_categories(df, month(2025, 4), CONFIG))}
    assert got["PMax"]["spend_prior"] == 5.0 and got["PMax"]["spend_cur"] == 0.0
    assert got["Non-Brand Search"]["spend_prior"] == 0.0 and got["Non-Brand Total"]["spend_cur"] == 20.0
    assert got["PMax"]["prior_label"] == "Mar 2025"


def test_campaign_prior_is_null_when_absent_and_duplicates_add_up(spark):
    df = campaigns(spark, ("S | A", 2025, 4, 10.0, 1.0), ("S | A", 2025, 4, 5.0, 1.0), ("B", 2025, 4, 5.0, 0.0), ("B", 2025, 3, 5.0, 0.0), ("C", 2025, 3, 1.0, 1.0))
    got = {r["campaign"]: r for r in rows(trends.campaign_snapshot(df, month(2025, 4)))}
    assert set(got) == {"S | A", "B"}
    assert (got["S | A"]["cost"], got["S | A"]["share"], got["S | A"]["prior_conv"], got["S | A"]["short_name"]) == (15.0, 0.75, None, "A")
    assert (got["B"]["prior_conv"], got["B"]["d_conv"]) == (0.0, None)


# --- budget -----------------------------------------------------------------------------


def test_budget_without_lines_or_categories(spark):
    cfg = ClientConfig(budget_lines=({"region": "N", "monthly": 100.0},))
    df = campaigns(spark, ("A", 2025, 4, 95.0, 1.0))
    lines = cfg.budget_frame(spark)
    assert rows(budget.reconciliation(df, lines, month(2025, 4)))[0]["status"] == "on-track"
    assert rows(budget.reconciliation_by_category(df, lines, month(2025, 4), cfg)) == []
    assert [r["dimension"] for r in rows(budget.composition(lines))] == ["region"]
    none = ClientConfig().budget_frame(spark)
    assert rows(budget.effective_budget(none))[0]["source"] == "none"
    assert rows(budget.reconciliation(df, none, month(2025, 4))) == []
    assert rows(budget.pacing(df, none, month(2025, 4)))[0]["latest_status"] is None
    assert rows(budget.composition(none)) == []


# --- building blocks ----------------------------------------------------------------------


@pytest.mark.parametrize("n, ties", [(1, False), (2, False), (7, False), (2000, True), (50_001, False)])
def test_medians_equal_brute_force(spark, n, ties):
    rng = random.Random(n)
    data = [("hot", float(rng.randint(0, 9)) if ties else rng.random()) for _ in range(n)] + [("cold", 0.25), ("cold", 0.75), ("empty", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    got = {r["g"]: (r["lower_median"], r["upper_median"]) for r in common.exact_medians(df, ["g"], "v").collect()}
    hot = [v for g, v in data if g == "hot"]
    assert got["hot"] == (statistics.median_low(hot), statistics.median_high(hot))
    assert got["cold"] == (0.25, 0.75)


def test_medians_of_many_skewed_and_constant_groups(spark):
    rng = random.Random(3)
    data = [(f"g{i}", float(rng.choice([0, 0, 0, 1, 10**9]))) for i in range(10_000) for _ in range(rng.randint(1, 4))]
    data += [("constant", 7.0)] * 500 + [("skewed", 2.0 ** rng.randint(-1000, 1000)) for _ in range(5001)] + [(None, 1.0), (None, 4.0)]
    held = {}
    for g, v in data:
        held.setdefault(g, []).append(v)
    got = common.exact_medians(spark.createDataFrame(data, "g string, v double"), ["g"], "v").collect()
    assert {r["g"]: (r["lower_median"], r["upper_median"]) for r in got} == {g: (statistics.median_low(v), statistics.median_high(v)) for g, v in held.items()}
    assert len(got) == len(held)


@pytest.mark.parametrize("edge", [F.min, F.max])
def test_medians_do_not_rest_on_good_edges(spark, monkeypatch, edge):
    monkeypatch.setattr(common.F, "percentile_approx", lambda v, shares, accuracy: F.array(*[edge(v)] * 6))
    data = [("a", float(i)) for i in range(100)] + [("b", 3.0)]
    got = common.exact_medians(spark.createDataFrame(data, "g string, v double"), ["g"], "v").collect()
    assert {r["g"]: (r["lower_median"], r["upper_median"]) for r in got} == {"a": (49.0, 50.0), "b": (3.0, 3.0)}


def test_top_per_group_equals_brute_force_on_a_hot_group(spark):
    rng = random.Random(5)
    data = [("hot", f"k{i}", rng.randint(0, 50)) for i in range(3000)] + [("cold", f"k{i}", i) for i in range(3)]
    df = spark.createDataFrame(data, "g string, k string, v int")
    got = common.top_per_group(df, ["g"], [F.col("v").desc(), F.col("k")], 10, ["k"]).collect()
    for group in ("hot", "cold"):
        best = sorted((r for r in data if r[0] == group), key=lambda r: (-r[2], r[1]))[:10]
        assert [(r["k"], r["rank"]) for r in sorted((r for r in got if r["g"] == group), key=lambda r: r["rank"])] == [
            (b[1], i) for i, b in enumerate(best, 1)]


def test_results_do_not_depend_on_the_partitioning(spark, facts):
    def snapshot():
        f = Facts(spark, SF)
        return [sorted(map(repr, df.collect())) for df in (
            terms.term_grades(f["fx_search_terms"], CONFIG), keywords.region_pivot(f["fx_keyword_geo"], CONFIG),
            landing_pages.category_summary(f["fx_ads_performance"], CONFIG), ads.detail(f["fx_ads_performance"], CONFIG))]

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(snapshot())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


# --- properties over the sample facts -------------------------------------------------------


def test_shares_add_up(facts):
    for df, share in ((quality.distribution(facts["fx_search_keyword_qs"], CONFIG), "kw_share"),
                      (terms.intent_segments(facts["fx_search_terms"], CONFIG), "spend_share"),
                      (terms.keyword_statuses(facts["fx_search_terms"], CONFIG), "spend_share")):
        assert abs(df.agg(F.sum(share)).first()[0] - 1) < 0.002


def test_dense_results_keep_empty_cells(facts):
    qs = facts["fx_search_keyword_qs"]
    assert quality.distribution(qs.filter("quality_score = '7'"), CONFIG).count() == 10
    assert quality.component_grid(qs.limit(5), CONFIG).count() == 27
    assert terms.intent_segments(facts["fx_search_terms"].filter("search_term like '%widget%'"), CONFIG).count() == 4
    assert terms.term_grades(facts["fx_search_terms"].filter("clicks < 5"), CONFIG).count() == 1
    assert ads.pairing_grid(facts["fx_ads_performance"].filter("campaign not like '%gizmo%'"), CONFIG).count() == 36


def test_grid_totals_match_the_grid(facts):
    df = facts["fx_ads_performance"]
    grid = rows(ads.pairing_grid(df, CONFIG))
    grand = {r["segment"]: r["ads"] for r in rows(ads.pairing_totals(df, CONFIG)) if r["level"] == "grand"}
    for segment, n in grand.items():
        assert n == sum(r["ads"] for r in grid if r["segment"] == segment)
    assert sum(grand.values()) == ads.graded(df, CONFIG).count()


# --- filters --------------------------------------------------------------------------------


def test_filters_only_remove_rows_and_split_by_segment(facts):
    for view in ("fx_search_terms", "fx_ads_performance", "fx_search_keyword_qs"):
        df = facts[view]
        parts = [apply_filters(df, Filters(seg=s), CONFIG).count() for s in ("br", "nb")]
        assert sum(parts) == df.count()
        assert apply_filters(df, Filters(), CONFIG) is df


def test_unresolved_rows_stay_and_bridges_decide(spark):
    groups = spark.createDataFrame([("g1", "C1"), ("g2", "C2")], "ad_group string, campaign string")
    places = spark.createDataFrame([("North", "g1"), ("South", "g2")], "state_matched string, ad_group string")
    kw = spark.createDataFrame([(1, "g1", {"a": "b"}), (2, "g2", None), (3, "g9", None), (4, None, None), (5, "", None)],
                               "i int, ad_group string, extra map<string,string>")
    bridges = dict(ad_groups=groups, geographic=places)
    ids = lambda df: sorted(r["i"] for r in df.collect())
    assert ids(apply_filters(kw, Filters(campaign="C1"), CONFIG, **bridges)) == [1, 3, 4, 5]
    assert ids(apply_filters(kw, Filters(region="North"), CONFIG, **bridges)) == [1, 4, 5]
    camps = spark.createDataFrame([(1, "C1"), (2, "C2"), (3, None)], "i int, campaign string")
    assert ids(apply_filters(camps, Filters(region="North"), CONFIG, **bridges)) == [1, 3]
    assert ids(apply_filters(camps, Filters(region="Nowhere"), CONFIG, **bridges)) == [1, 2, 3]
    named = spark.createDataFrame([(1, "North", "g2"), (2, "South", "g1")], "i int, state_matched string, ad_group string")
    assert ids(apply_filters(named, Filters(region="North"), CONFIG, **bridges)) == [1]
    text = spark.createDataFrame([(1, "big widget"), (2, "bolt"), (3, "thing")], "i int, search_term string")
    assert ids(apply_filters(text, Filters(category="Widget"), CONFIG)) == [1, 3]


def test_list_helpers(spark):
    df = spark.createDataFrame([(1, "$1,204"), (2, "$99"), (3, None)], "i int, v string")
    order = lambda d: [r["i"] for r in sort_any(df, "v", d, numeric=True).collect()]
    assert order(True) == [1, 2, 3] and order(False) == [2, 1, 3]
    assert text_search(df, ["v"], "").count() == 3 and text_search(df, ["i", "v"], "2 $9").count() == 1
    assert multi_select(df, {"i": []}).count() == 0 and multi_select(df, {"i": None}).count() == 3


# --- relevance ------------------------------------------------------------------------------


def test_classifier_failures_and_gaps_take_the_rules(spark):
    df = spark.createDataFrame([(t,) for t in ("gizmo one", "rod", "blue widgets", "a set", "cheap thing", "known")], "term string")

    def failing(batch, context):
        raise RuntimeError("down")

    failed = relevance.classify_with(df, CONFIG, failing)
    assert context_free(failed.drop("source")) == context_free(relevance.classify(df, CONFIG).drop("source"))
    assert {r["source"] for r in failed.collect()} == {relevance.AFTER_ERROR}
    some = relevance.classify_with(df, CONFIG, lambda b, c: {t: {"relevant": True, "category": "product"} for t in b if t == "known"})
    got = {r["term"]: (r["relevant"], r["category"], r["source"]) for r in some.collect()}
    assert got["known"] == (True, "product", "model") and got["cheap thing"] == (False, "unrelated", "heuristic")
    assert got["gizmo one"][1] == "brand" and got["rod"][1] == "competitor"
    assert got["a set"] == (True, "product", "heuristic") and got["blue widgets"] == (False, "unrelated", "heuristic")


def context_free(df):
    return sorted(map(tuple, df.collect()))


def test_cache_is_used_refreshed_and_invalidated(spark):
    cache = spark.createDataFrame([("client", "old", False, "x", "r", "model"), ("other", "new", True, "y", "r", "model")], relevance.CACHE_SCHEMA)
    df = spark.createDataFrame([("old",), ("new",), ("new",)], "term string")
    fresh = relevance.refresh_cache(df, cache, ClientConfig(client_id="client"))
    mine = {r["term"]: r["source"] for r in fresh.filter("client_id = 'client'").collect()}
    assert mine == {"old": "model", "new": "heuristic"} and fresh.count() == 3
    assert [r["client_id"] for r in relevance.invalidate(fresh, "client").collect()] == ["other"]


def test_every_row_gets_a_verdict_and_repeats_in_the_cache_add_none(spark):
    df = spark.createDataFrame([("old",), ("old",), ("",), ("gizmo",)], "term string")
    cache = spark.createDataFrame([("c", "old", True, "x", "r", "model")] * 3 + [("other", "gizmo", False, "y", "r", "model")], relevance.CACHE_SCHEMA)
    cfg = ClientConfig(client_id="c", brand_terms=("gizmo",))
    got = sorted(map(tuple, relevance.with_verdicts(df, cfg, cache).collect()))
    assert got == [("", None, None), ("gizmo", "brand", True), ("old", "x", True), ("old", "x", True)]
    assert relevance.refresh_cache(df.filter("term <> ''"), cache, cfg).filter("client_id = 'c'").count() == 2


def test_weighted_mean_holds_large_impressions(spark):
    rows = spark.createDataFrame([(90.0, 2e11), (30.0, 1e11)], "impr_share double, impressions double")
    assert rows.select(keywords._weighted_mean("impr_share")).first()[0] == 70.0


def test_median_bracket_that_misses_raises(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(9)], "g string, v double")
    got = common.exact_medians(rows, ["g"], "v").first()
    assert (got["lower_median"], got["upper_median"]) == (4.0, 4.0)


# --- findings -------------------------------------------------------------------------------


def test_trend_finding_levels_and_season(spark):
    base = [("A", 2025, 5, 1.0, 100.0)]

    def severity(conv, cfg=CONFIG, prior=100.0):
        df = campaigns(spark, ("A", 2025, 5, 1.0, prior), ("A", 2025, 6, 1.0, conv))
        return [r["severity"] for r in rows(findings.conversion_trend(df, month(2025, 6), cfg))]

    assert severity(86.0) == [] and severity(84.0) == ["IMPORTANT"] and severity(60.0) == ["CRITICAL"]
    assert severity(1.0, prior=9.0) == []
    for names in (["Jun"], ["june"], ["May", "JUNE "]):
        assert severity(50.0, CONFIG.updated({"seasonality": [{"label": "dip", "months": names}]})) == ["PASS"]
    assert severity(50.0, CONFIG.updated({"seasonality": [{"label": "dip", "months": ["May"]}]})) == ["CRITICAL"]
    assert rows(findings.conversion_trend(campaigns(spark, *base), month(2025, 6), CONFIG)) == []


def test_density_uses_thresholds_and_lists_everything(spark):
    df = campaigns(spark, *[(f"C{i:02d}", 2025, 6, 200.0, 40.0 if i < 2 else 5.0) for i in range(12)])
    got = {r["finding"]: r for r in rows(findings.density(df, month(2025, 6), CONFIG))}
    assert got["density"]["severity"] == "CRITICAL" and got["low_volume"]["magnitude"].startswith("10 campaigns")
    assert findings.density_evidence(df, month(2025, 6), CONFIG).count() == 12
    relaxed = CONFIG.updated({"thresholds": {"smart_bidding_floor": 5, "low_vol_conv": 2}})
    assert [(r["finding"], r["severity"]) for r in rows(findings.density(df, month(2025, 6), relaxed))] == [("density", "IMPORTANT")]


def test_findings_vanish_without_data_or_terms(spark, facts):
    kw, st = facts["fx_search_keyword_qs"], facts["fx_search_terms"]
    assert rows(findings.brand_split(kw, ClientConfig())) == []
    assert rows(findings.match_types(kw.limit(0))) == []
    assert rows(findings.waste(st.filter("conversions > 0"), CONFIG)) == []
    assert rows(findings.placement_spray(facts["fx_pmax_placements"].limit(0))) == []
    bare = campaigns(facts.spark, ("Generic", 2025, 6, 1.0, 1.0))
    got = rows(findings.three_bucket(bare, ClientConfig()))[0]
    assert (got["severity"], got["effort"], got["action"]) == ("IMPORTANT", "L", "[BUILD REQUIRED]")


def test_placements_with_unknown_impressions_count_in_neither_part(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("c", None), (None, 9.0)], "performance_max_placement string, impressions double")
    assert rows(findings.placement_counts(df)) == [{"total": 4, "served": 2, "one": 1}]
    assert [r["placement"] for r in rows(findings.placement_evidence(df))] == ["(unknown)", "a"]


# --- others ---------------------------------------------------------------------------------


def test_locations_without_cost_rank_by_clicks(spark):
    schema = "state_matched string, ad_group string, impressions double, clicks double, conversions double, conv_value double, cost_conv double"
    df = spark.createDataFrame([("A", "g", 10.0, 5.0, 1.0, 0.0, 3.0), ("B", "g", 10.0, 4.0, 0.0, 0.0, None), (None, "g", 10.0, 2.0, None, 0.0, None)], schema)
    got = rows(geo.geo_performance(df))
    assert [(r["location"], r["cost"]) for r in got] == [("B", 0.0), ("A", 3.0), ("(not set)", 0.0)]


def test_devices_prefer_significant_pages(spark):
    schema = "url string, cost double, clicks double, " + ", ".join(f"{d}_{m} double" for d in landing_pages.DEVICES for m in ("cvr", "cost", "clicks"))
    df = spark.createDataFrame([("small", 1.0, 10.0, 0.9, 1.0, 10.0, 0.5, 0.0, 3.0, None, None, None), ("big", 9.0, 200.0, 0.1, 9.0, 150.0, 0.4, 0.0, 50.0, None, None, 0.0)], schema)
    got = {r["device"]: r for r in rows(landing_pages.device_rollup(df))}
    assert set(got) == {"mobile", "desktop"}
    assert got["mobile"]["best_lp"] == "big" and got["desktop"]["best_lp"] == "small"
    assert got["mobile"]["cvr"] == 0.15


def test_page_lookup_wins_over_fragments(spark):
    cfg = ClientConfig(url_brands=(("/a", "A"),))
    df = spark.createDataFrame([("https://x/a", "A"), ("https://x/b", "A"), ("https://x/c", "B")], "final_url string, brand string")
    listed = spark.createDataFrame([("https://x/a", "B")], "url string, brand string")
    assert ads.page_mismatches(df, cfg).count() == 0
    assert [r["final_url"] for r in rows(ads.page_mismatches(df, cfg, listed))] == ["https://x/a"]


def test_near_duplicates_and_guardrails(spark):
    df = spark.createDataFrame([("red shoe",), ("Shoe, red",), ("red red shoe",), ("blue shoe",)], "search_keyword string").withColumn("cost", F.lit(1.0))
    assert [(r["keywords"], r["spellings"]) for r in rows(screening.near_duplicates(df))] == [(3, 3)]
    cand = spark.createDataFrame([("gizmo x", 9.0), ("a", 2.0), ("A", 3.0), ("", 9.0), ("b", 1.0), ("c", -1.0)], "search_term string, cost double")
    assert [(r["term"], r["cost"]) for r in rows(screening.guardrails(cand, CONFIG, 1))] == [("a", 5.0)]


def test_ratings_take_the_last_row_of_a_keyword(spark):
    schema = "search_keyword string, row_index int, exp_ctr string, ad_relevance string, landing_page_exp string"
    df = spark.createDataFrame([("Alpha", 1, "Average", None, None), ("alpha", 2, "Below average", "x", None)], schema)
    got = rows(geo.latest_ratings(df))
    assert got == [{"kw": "alpha", "exp_ctr": "Below average", "ad_relevance": None, "landing_page_exp": None}]


def test_ngram_themes_have_no_limit_of_their_own(facts):
    wasted = facts["fx_search_terms"].sparkSession.createDataFrame(
        [(f"word{i} thing{i}", 0.0, float(i + 1)) for i in range(80)], "search_term string, conversions double, cost double")
    assert screening.ngram_themes(wasted, CONFIG).count() == 80
    assert [r["ngram"] for r in rows(screening.ngram_themes(wasted, CONFIG, top=2))] == ["word79 thing79", "word78 thing78"]
