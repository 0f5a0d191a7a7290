"""All sections of one client: typed reports in, a mapping of lazy DataFrames out.

The global filters are applied once per report; findings and the budget
reconciliation look at the unfiltered reports.  Sections whose report is absent
are left out.  Nothing runs until a section is read or written
(:func:`adinsight.sources.bundle_sink.write_bundle`).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from adinsight.config import ClientConfig
from adinsight.operators import (
    ads, budget, findings, geo, keywords, landing_pages, quality, terms, trends,
)
from adinsight.operators.filters import Filters, apply_filters, filter_options
from adinsight.operators.trends import Bound


@dataclass(frozen=True)
class Request:
    """Filters, date range and comparison of a bundle."""

    filters: Filters = Filters()
    date_from: Bound = None
    date_to: Bound = None
    compare: str = "yoy"
    compare_from: Bound = None
    compare_to: Bound = None


@dataclass
class Bundle:
    """Sections by name; ``close`` releases the views kept for the build."""

    sections: dict[str, DataFrame] = field(default_factory=dict)
    kept: list[DataFrame] = field(default_factory=list)

    def __enter__(self) -> Bundle:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        for df in self.kept:
            df.unpersist()
        self.kept.clear()


def build_bundle(cfg: ClientConfig, uploads: DataFrame, reports: Mapping[str, DataFrame],
                 request: Request = Request(), cache: DataFrame | None = None, keep_views: bool = False) -> Bundle:
    """Sections of a client from its typed reports.

    ``keep_views`` persists each filtered report (memory, then disk) so that the
    sections share one scan of it; leave it off when only a few sections are read.
    """
    if "campaign_performance" not in reports:
        return Bundle()
    bundle = Bundle()
    groups, places = reports.get("ad_group_performance"), reports.get("geographic")

    def filtered(name: str) -> DataFrame | None:
        if name not in reports:
            return None
        df = apply_filters(reports[name], request.filters, cfg, ad_groups=groups, geographic=places)
        if keep_views:
            bundle.kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    out = bundle.sections
    every = reports["campaign_performance"]
    campaigns = filtered("campaign_performance")
    as_of = trends.latest_complete_month(uploads).scalar()
    window = (as_of, request.date_from, request.date_to)
    current = trends.current_month(campaigns, *window).scalar()

    out["total_trend"] = trends.total_trend(campaigns, *window)
    out["kpis"] = trends.kpi_scorecard(campaigns, as_of, request.compare, request.date_from, request.date_to,
                                       request.compare_from, request.compare_to)
    out["campaigns"] = trends.campaign_snapshot(campaigns, current)
    out["campaign_totals"] = trends.campaign_totals(campaigns, current)
    out["nb_categories"] = trends.nonbrand_categories(campaigns, current, cfg, request.compare)
    out["regions"] = trends.region_cells(campaigns, current, cfg, request.compare)

    found = findings.run_analyzers(cfg, current, campaigns=every, keywords=reports.get("search_keyword_qs"),
                                   terms=reports.get("search_terms"), placements=reports.get("pmax_placements"))
    out["findings"] = findings.overview(found)
    out["recommendations"] = findings.recommendations(found)
    out["evidence"] = findings.run_evidence(cfg, current, campaigns=every, keywords=reports.get("search_keyword_qs"),
                                            terms=reports.get("search_terms"), placements=reports.get("pmax_placements"))

    lines = cfg.budget_frame(every.sparkSession)
    manual = cfg.thresholds.get("monthly_budget")
    out["budget"] = budget.effective_budget(lines, manual)
    out["budget_composition"] = budget.composition(lines)
    out["budget_reconciliation"] = budget.reconciliation(every, lines, current, manual)
    out["budget_by_category"] = budget.reconciliation_by_category(every, lines, current, cfg)
    out["budget_pacing"] = budget.pacing(campaigns, lines, current, manual)

    locations = filtered("geographic")
    if locations is not None:
        out["geo_performance"] = geo.geo_performance(locations)
        out["geo_totals"] = geo.geo_totals(locations)

    kw, kw_geo = filtered("search_keyword_qs"), filtered("keyword_geo")
    if kw is not None:
        out["qs_distribution"] = quality.distribution(kw, cfg)
        out["qs_buckets"] = quality.buckets(kw, cfg)
        out["qs_summary"] = quality.summary(kw, cfg)
        out["qs_savings"] = quality.savings(kw, cfg)
        out["qs_totals"] = quality.portfolio_totals(kw, cfg)
        out["component_ratings"] = quality.component_ratings(kw, cfg)
        out["component_grid"] = quality.component_grid(kw, cfg)
        out["ctr_spend_share"] = quality.ctr_spend_share(kw, cfg)
        out["savings_by_brand"] = quality.savings_by_brand(kw, cfg)
        out["component_counts"] = quality.component_counts(kw)
        out["ctr_penalty"] = quality.ctr_penalty(kw)
        out["top_keywords"] = keywords.top_keywords(kw)
    if kw_geo is not None:
        out["keyword_regions"] = keywords.region_pivot(kw_geo, cfg)
        out["keyword_region_axis"] = keywords.region_axis(kw_geo)
        out["keyword_region_totals"] = keywords.region_pivot_totals(kw_geo, cfg)
    if kw is not None and kw_geo is not None:
        out["optimization_keywords"] = quality.optimization_keywords(kw, kw_geo, cfg)
        out["optimization_options"] = quality.optimization_options(kw, kw_geo, cfg)
        out["region_category"] = geo.keyword_region_ratings(kw_geo, kw, cfg)

    st = filtered("search_terms")
    if st is not None:
        out["term_totals"] = terms.term_totals(st, cfg)
        out["term_grades"] = terms.term_grades(st, cfg)
        out["intent_segments"] = terms.intent_segments(st, cfg)
        out["service_categories"] = terms.service_categories(st, cfg)
        out["competitor_breakdown"] = terms.competitor_breakdown(st, cfg)
        out["competitor_summary"] = terms.competitor_summary(st, cfg)
        out["competitor_terms"] = terms.competitor_terms(st, cfg)
        out["keyword_status"] = terms.keyword_statuses(st, cfg)
        out["relevant_terms"] = terms.relevant_terms(st, cfg)
        out["flagged_terms"] = terms.flagged_terms(st, cfg)
        out["top_graded"] = terms.top_graded(st, cfg, cache=cache)
        out["intent_mix"] = terms.intent_mix(st, cfg, cache=cache)
        out["relevant_top"] = terms.relevant_top(st, cfg, cache=cache)
        out["competitor_top"] = terms.competitor_top(st, cfg, cache=cache)
        out["flagged_top"] = terms.flagged_top(st, cfg, cache=cache)

    ad = filtered("ads_performance")
    if ad is not None:
        out["ads"] = ads.inventory(ad, cfg)
        out["ad_grades"] = ads.grade_summary(ad, cfg)
        out["ad_detail"] = ads.detail(ad, cfg)
        out["ad_pairing"] = ads.pairing_grid(ad, cfg)
        out["ad_pairing_totals"] = ads.pairing_totals(ad, cfg)
        out["ad_pairing_stats"] = ads.pairing_stats(ad, cfg)
        out["ad_options"] = ads.options(ad, cfg)
        out["page_performance"] = landing_pages.performance(ad)
        out["page_categories"] = landing_pages.category_grid(ad, cfg)
        out["page_category_summary"] = landing_pages.category_summary(ad, cfg)
        out["page_stats"] = landing_pages.grid_stats(ad, cfg)
    pages = filtered("landing_pages")
    if pages is not None:
        out["landing_pages"] = landing_pages.landing_pages(pages)
        out["page_url_categories"] = landing_pages.url_categories(pages, cfg)

    placements = reports.get("pmax_placements")
    if placements is not None:
        out["complexity"] = findings.complexity_profile(placements)
    out["filter_options"] = filter_options(every, cfg, places, reports.get("keyword_geo"))
    return bundle
