"""From report files to sections: the path a user takes."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from adinsight.config import ClientConfig
from adinsight.operators.filters import Filters
from adinsight.plans.bundle import Request, build_bundle
from adinsight.plans.sample_facts import CONFIG, Facts
from adinsight.sources import bundle_sink, typed_views
from adinsight.sources.warehouse import Warehouse, load_folder

REPORTS = {
    "campaign_performance": "fx_campaign_performance", "ad_group_performance": "fx_ad_group_performance", "search_keyword_qs": "fx_search_keyword_qs",
    "keyword_geo": "fx_keyword_geo", "search_terms": "fx_search_terms", "ads_performance": "fx_ads_performance",
    "landing_pages": "fx_landing_pages", "geographic": "fx_geographic", "pmax_placements": "fx_pmax_placements",
}
FILES = {
    "camp": ("Campaign,Campaign type,Month,Clicks,Impr.,Cost,Conversions\n"
             "Search | Non-Brand | Tier A - North,Search,January 2025,100,1000,$50.00,10\n"
             "Search | Non-Brand | Tier A - North,Search,February 2025,100,1000,$80.00,20\n"
             "Search | Brand,Search,February 2025,50,100,$10.00,9\n"),
    "terms": "Search term,Search terms match type,Added/Excluded,Clicks,Impr.,Cost,Conversions\nblue widget,Broad,--,10,100,5.5,4\ncold rod,Broad,Added,9,90,7,--\n",
    "kw": "Search keyword,Search keyword match type,Campaign,Ad group,Quality Score,Exp. CTR,Ad relevance,Landing page exp.,Clicks,Impr.,Cost,Conversions\nwidget,Exact match,C,G,4,Below average,Average,--,10,100,5.5,1\n",
    "geo": "State (Matched),Ad group,Clicks,Impr.,Conversions,Conv. value,Cost / conv.\nNorth,G,10,100,2,5,3.5\n",
    "ads": "Ad name,Ad group,Campaign,Headline 1,Headline 2,Ad final URL,Clicks,Impr.,Cost,Conversions\nn,G,C,Widget sale,--,https://a.example/widget,20,150,9,6\n",
    "lp": "Landing page,Mobile speed score,Clicks,Impr.,Cost\nhttps://a.example/widget,7,20,100,9\n",
}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder, root = tmp_path_factory.mktemp("in"), tmp_path_factory.mktemp("house")
    for name, text in FILES.items():
        (folder / f"{name}.csv").write_text(f"{name}\n\"January 1, 2025 - February 28, 2025\"\n{text}")
    house = Warehouse(spark, str(root))
    load_folder(house, "c", str(folder))
    types = {r["report_type"] for r in house.uploads().collect()}
    views = {t: typed_views.typed_view(house.rows(), t) for t in types}
    return house.uploads(), views


def test_files_to_sections(loaded):
    uploads, views = loaded
    assert len(views) == len(FILES)
    sections = build_bundle(CONFIG, uploads, views).sections
    with ThreadPoolExecutor(6) as pool:
        found = pool.map(lambda name: [r.asDict() for r in sections[name].collect()], sections)
        got = dict(zip(sections, found))
    assert [(r["month"], r["spend"], r["main_conv"]) for r in got["total_trend"]] == [("2025-01", 50.0, 10.0), ("2025-02", 90.0, 29.0)]
    assert got["kpis"][0]["prior"] == 50.0 and got["regions"][0]["region"] == "North"
    assert {r["segment"]: r["terms"] for r in got["intent_segments"]} == {"Relevant": 1, "Competitor": 1, "Needs Review": 0, "Irrelevant": 0}
    assert got["geo_performance"][0]["cost"] == 7.0 and got["component_counts"]
    assert got["ads"][0]["grade"].startswith("A") and got["ads"][0]["headline"] == "Widget sale"
    assert got["landing_pages"][0]["speed"] == "7" and got["page_url_categories"][0]["category"] == "Widget"
    assert got["budget"][0]["source"] == "none" and got["budget_reconciliation"] == []
    assert {r["finding"] for r in got["recommendations"]} >= {"density", "expected_ctr", "match_types"}


def test_sections_with_filters_write_as_json(spark, tmp_path):
    facts = Facts(spark, "/root/testdata/sf0.001")
    views = {report: facts[view] for report, view in REPORTS.items()}
    cfg = CONFIG.updated({"budget_lines": [{"region": "ASIA", "category": "Widget", "monthly": 5000}]})
    request = Request(Filters(seg="nb", region="NATION_3", category="Widget"), "1996-01", "2000-12", "mom")
    with build_bundle(cfg, facts["fx_uploads"], views, request, keep_views=True) as bundle:
        assert len(bundle.sections) > 50 and bundle.kept
        bundle_sink.write_bundle(bundle.sections, "sample", str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    found = {r["section"] for r in back.select("section").distinct().collect()}
    assert {"total_trend", "kpis", "search", "findings"} - found <= {"search"} and len(found) > 40


def test_no_campaign_report_means_no_bundle(spark):
    assert build_bundle(ClientConfig(), spark.range(0), {}).sections == {}
