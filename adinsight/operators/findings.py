"""Rule-based findings, their evidence and the recommendations made from them.

Every analyzer returns finding rows (zero, one or two) in one schema; evidence
stays in long form, one row per record, so no finding carries an unbounded array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adinsight.config import ClientConfig
from adinsight.functions.dates import month_abbr, month_name
from adinsight.functions.grading import RATINGS, match_type_bucket
from adinsight.functions.matching import contains_any, is_brand, lowered, short_name, theme_tokens
from adinsight.functions.numbers import (
    count_where, fixed_text, grouped_text, money_text, ratio0, rounded, total, units, whole, whole_text,
)
from adinsight.operators.common import everything, money, tenth
from adinsight.operators.quality import CTR_PENALTY

# Severity order, and labels of the recommendation fields.
SEVERITIES = ("CRITICAL", "IMPORTANT", "OPPORTUNITY", "PASS")
PRIORITY = {"CRITICAL": "High", "IMPORTANT": "Medium", "OPPORTUNITY": "Low"}
CATEGORY = {"D": "Data Density & Budget", "K": "Keywords & Negatives", "Q": "Quality Score", "P": "Performance Max"}
EFFORT = {"S": "Low", "M": "Medium", "L": "High"}
IMPACT = {"HIGH": "High", "MEDIUM": "Medium", "LOW": "Low"}
ACT, BUILD, PASS = "[ACTION REQUIRED]", "[BUILD REQUIRED]", "[PASS]"

# The order in which findings are reported.
ORDER = ("density", "low_volume", "trend", "match_types", "brand_split", "three_bucket", "waste", "expected_ctr",
         "low_score", "placements")

FINDING_COLUMNS = ("finding", "module", "severity", "title", "observation", "magnitude", "impact", "summary", "dollar",
                   "effort", "timing", "action")


def say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _finding(key: str, module: str, *, severity: Column | str, title: Column | str, observation: Column,
             magnitude: Column | str, impact: str, summary: str, dollar: Column | str, effort: str, timing: str,
             action: str = ACT) -> list[Column]:
    values = (key, module, severity, title, observation, magnitude, impact, summary, dollar, effort, timing, action)
    return [(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in zip(FINDING_COLUMNS, values)]


def _n(c: Column | str) -> Column:
    return whole_text(c)


# --- campaign density --------------------------------------------------------------


def campaign_density(campaigns: DataFrame, current: Column) -> DataFrame:
    """Conversions and cost per campaign in the current month."""
    return campaigns.filter(F.col("month_start") == current).groupBy("campaign").agg(
        total("conversions").alias("conv"), total("cost").alias("cost")
    )


def _low_volume(cfg: ClientConfig) -> Column:
    return (F.col("conv") < cfg.threshold("low_vol_conv")) & (F.col("cost") > cfg.threshold("low_vol_spend"))


def _named_top(rows: DataFrame, order: list[Column], text: Column, k: int = 8) -> Column:
    """Texts of the first ``k`` rows joined in order, as a scalar."""
    best = rows.orderBy(*order).limit(k).withColumn("_r", F.row_number().over(Window.orderBy(*order)))
    listed = F.sort_array(F.collect_list(F.struct("_r", text.alias("t"))))
    return best.agg(F.array_join(F.transform(listed, lambda s: s["t"]), "; ")).scalar()


def density(campaigns: DataFrame, current: Column, cfg: ClientConfig) -> DataFrame:
    """Campaigns against the automated-bidding floor, and costly ones far below it.

    The texts name the eight leading campaigns; the evidence lists all of them.
    """
    floor = F.lit(float(int(cfg.threshold("smart_bidding_floor"))))
    low_conv, low_spend = cfg.threshold("low_vol_conv"), cfg.threshold("low_vol_spend")
    camps = campaign_density(campaigns, current)
    name = short_name("campaign")
    leaders = _named_top(camps, [F.col("conv").desc(), F.col("campaign")],
                         say(name, ": ", _n("conv")))
    costly = _named_top(camps.filter(_low_volume(cfg)), [F.col("cost").desc(), F.col("campaign")],
                        say(name, " (", _n("conv"), " conv, ", money_text("cost"), ")"))
    sums = camps.agg(
        F.count("*").alias("camps"), count_where(F.col("conv") >= floor).alias("above"),
        count_where(F.col("conv") < floor).alias("below"), count_where(_low_volume(cfg)).alias("low"),
    ).select("*", leaders.alias("leaders"), costly.alias("costly"), month_abbr(current).alias("m"))
    floor_text = str(int(cfg.threshold("smart_bidding_floor")))
    first = sums.filter("camps > 0").select(*_finding(
        "density", "D", severity=F.when(F.col("below") > F.col("above"), "CRITICAL").otherwise("IMPORTANT"),
        title="Conversion volume per campaign vs the automated-bidding floor",
        observation=say(F.col("m"), ": ", F.col("leaders"), ". ", _n("above"), " of ", _n("camps"),
                        f" campaigns reach {floor_text} conversions a month; ", _n("below"), " do not."),
        magnitude=say(_n("above"), " at or above the floor · ", _n("below"), " below"),
        impact="Too little signal per campaign for automated bidding to learn from.",
        summary="Group small campaigns into one portfolio; keep targets of their own for large ones",
        dollar="HIGH", effort="M", timing="Week 1-2",
    ))
    second = sums.filter("low > 0").select(*_finding(
        "low_volume", "D", severity="CRITICAL", title="Costly campaigns far below the automated-bidding floor",
        observation=say(F.col("m"), ": ", F.col("costly"), f". Under {low_conv:.0f} conversions at more than "
                        f"${low_spend:,.0f} each."),
        magnitude=say(_n("low"), " campaigns below the floor with material spend"),
        impact="These campaigns spend without reaching the volume they need.",
        summary="Merge, narrow or pause them and move the budget to efficient campaigns",
        dollar="HIGH", effort="S", timing="Week 1-2",
    ))
    return first.unionByName(second)


def density_evidence(campaigns: DataFrame, current: Column, cfg: ClientConfig) -> DataFrame:
    """All campaigns of the month with their side of the floor."""
    floor = float(int(cfg.threshold("smart_bidding_floor")))
    rows = campaign_density(campaigns, current)
    return rows.select("campaign", (F.col("conv") >= floor).alias("clears_floor"), _low_volume(cfg).alias("low_volume"),
                       tenth("conv"), money("cost"))


# --- conversion trend --------------------------------------------------------------


def _recent_months(campaigns: DataFrame, as_of: Column, count: int) -> DataFrame:
    sums = campaigns.filter(F.col("month_start") <= as_of).groupBy("month_start").agg(total("conversions").alias("conv"))
    return sums.orderBy(F.col("month_start").desc()).limit(count)


def conversion_trend(campaigns: DataFrame, as_of: Column, cfg: ClientConfig) -> DataFrame:
    """A drop of more than 15 % against the previous month, unless the season explains it.

    The lag runs over the last two months of the series.
    """
    last_two = _recent_months(campaigns, as_of, 2)
    prior = F.lag("conv").over(Window.orderBy("month_start"))
    pair = last_two.withColumn("prior", prior).filter(F.col("prior") >= 10)
    drop = (F.col("conv") - F.col("prior")) / F.col("prior")
    full = F.lower(month_name(as_of))
    season = F.lit(None).cast("string")
    for window in reversed(cfg.seasonality):
        names = [str(m).strip().lower() for m in (window.get("months") or [])]
        if names:
            hit = full.substr(1, 3).isin(*names) | F.substring_index(full, " ", 1).isin(*names)
            season = F.when(hit, window.get("label") or "seasonal trough").otherwise(season)
    rows = pair.withColumn("drop", drop).filter(F.col("drop") < -0.15).withColumn("season", season)
    rows = rows.withColumn("m", month_abbr(as_of))
    percent = _n(F.abs("drop") * 100)
    values = say(F.col("m"), " conversions ", _n("conv"), " after ", _n("prior"), " (-", percent, "%).")
    steep = F.col("drop") <= -0.4
    expected = rows.filter(F.col("season").isNotNull()).select(*_finding(
        "trend", "D", severity="PASS", title=say("Conversions down ", percent, "% on the month before, as expected"),
        observation=say(values, " Configured season: ", F.col("season"), "."), magnitude="Seasonal dip, suppressed",
        impact="Matches the configured season; no performance problem.", summary="Watch only; compare after the season",
        dollar="LOW", effort="S", timing="Reference", action=PASS,
    ))
    decline = rows.filter(F.col("season").isNull()).select(*_finding(
        "trend", "D", severity=F.when(steep, "CRITICAL").otherwise("IMPORTANT"),
        title=say("Conversions down ", percent, "% on the month before"), observation=values,
        magnitude=say(percent, "% fewer conversions"), impact="A drop of this size needs a cause before any change.",
        summary="Check conversion tracking first, then budgets, bids and competition",
        dollar=F.when(steep, "HIGH").otherwise("MEDIUM"), effort="S", timing="Week 1",
    ))
    return expected.unionByName(decline)


def trend_evidence(campaigns: DataFrame, as_of: Column) -> DataFrame:
    """Conversions of the last eight months."""
    rows = _recent_months(campaigns, as_of, 8).orderBy("month_start")
    return rows.select(month_name("month_start").alias("month"), tenth("conv"))


# --- keywords ----------------------------------------------------------------------


def _match_type_sums(keywords: DataFrame) -> DataFrame:
    sums = keywords.groupBy(match_type_bucket("search_keyword_match_type").alias("match")).agg(
        F.count("*").alias("keywords"), total("cost").alias("cost"), total("conversions").alias("conv")
    )
    return sums.withColumn("idle", (F.col("match") != "Other") & (F.col("cost") < 1))


def match_type_mix(keywords: DataFrame) -> DataFrame:
    """Keywords, cost and conversions per match type bucket, with the idle flag."""
    return _match_type_sums(keywords).select("match", "keywords", "idle", money("cost"), tenth("conv"))


def match_types(keywords: DataFrame) -> DataFrame:
    """Match-type allocation; the four bucket rows fit one array."""
    rows = _match_type_sums(keywords)
    entry = F.struct((-F.col("cost")).alias("c"), F.col("match"), F.col("keywords"), F.col("conv"), F.col("idle"))
    one = rows.agg(F.sort_array(F.collect_list(entry)).alias("mix"), F.sum("keywords").alias("n")).filter("n > 0")
    named = F.filter("mix", lambda x: x["match"] != "Other")
    parts = F.array_join(F.transform(named, lambda x: say(
        x["match"], ": ", _n(x["keywords"]), " kw / ", money_text(-x["c"]), " / ", _n(x["conv"]), " conv")), ". ")
    lazy = F.array_join(F.transform(F.filter("mix", lambda x: x["idle"]), lambda x: x["match"]), ", ")
    rows = one.select("n", F.col("mix")[0]["match"].alias("lead"), parts.alias("parts"), lazy.alias("lazy"))
    idle_note = F.when(F.col("lazy") != "", say(" Idle: ", F.col("lazy"), ".")).otherwise("")
    return rows.select(*_finding(
        "match_types", "K", severity="IMPORTANT", title="How keywords and spend divide over match types",
        observation=say(F.col("parts"), ". Most spend runs on ", F.col("lead"), ".", idle_note),
        magnitude=say(grouped_text("n"), " keywords · most spend on ", F.col("lead")),
        impact="Idle layers add no signal; a wide layer without negatives leaks spend.",
        summary="Resize exact, phrase and broad; delete or revive idle keywords",
        dollar="MEDIUM", effort="S", timing="Week 2",
    ))


def brand_split_rows(keywords: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Spend, conversions and CPA of brand and non-brand keywords (keyword text only)."""
    label = F.when(is_brand("search_keyword", cfg), "Brand").otherwise("Non-brand")
    sums = keywords.groupBy(label.alias("segment")).agg(total("cost").alias("cost"), total("conversions").alias("conv"))
    return sums.select("segment", rounded(ratio0("cost", "conv"), 2).alias("cpa"), money("cost", "spend"), tenth("conv"))


def brand_split(keywords: DataFrame, cfg: ClientConfig) -> DataFrame:
    brand = is_brand("search_keyword", cfg)
    sums = keywords.agg(total("cost", brand).alias("bc"), total("conversions", brand).alias("bv"),
                        total("cost", ~brand).alias("nc"), total("conversions", ~brand).alias("nv"))
    if not cfg.brand_terms:
        sums = sums.filter(F.lit(False))
    rows = sums.filter((F.col("bv") > 0) | (F.col("nv") > 0)).withColumns({
        "bcpa": ratio0("bc", "bv"), "ncpa": ratio0("nc", "nv"),
    })
    gap = fixed_text(ratio0("ncpa", "bcpa"), 1)
    share = lambda a, b: _n(ratio0(F.col(a), F.col(a) + F.col(b)) * 100)
    return rows.select(*_finding(
        "brand_split", "K", severity="OPPORTUNITY", title=say("Brand against non-brand: CPA gap ", gap, "x"),
        observation=say("Brand (", ", ".join(cfg.brand_terms), "): ", money_text("bc"), " / ", _n("bv"),
                        " conv / $", fixed_text("bcpa", 2), " CPA. Non-brand: ", money_text("nc"), " / ", _n("nv"),
                        " conv / $", fixed_text("ncpa", 2), " CPA."),
        magnitude=say("Brand has ", share("bv", "nv"), "% of conversions on ", share("bc", "nc"), "% of spend"),
        impact="Brand is the cheap anchor, non-brand the growth; one target hides both.",
        summary="Defend brand; give non-brand a target of its own", dollar="MEDIUM", effort="M", timing="Month 2",
    ))


def campaign_buckets(campaigns: DataFrame) -> DataFrame:
    """Which of the three campaign buckets the campaign names show.

    Brand counts as present whenever some name holds ``brand``, also in ``non-brand``.
    """
    name = lowered("campaign")
    return campaigns.agg(
        F.coalesce(F.max(name.contains("brand")), F.lit(False)).alias("brand"),
        F.coalesce(F.max(name.rlike("non[- ]?brand|generic|category")), F.lit(False)).alias("nonbrand"),
        F.coalesce(F.max(name.rlike("conquest|competitor")), F.lit(False)).alias("conquest"),
    )


def three_bucket(campaigns: DataFrame, cfg: ClientConfig) -> DataFrame:
    buckets = (("brand", "Brand"), ("nonbrand", "Non-Brand"), ("conquest", "Conquest"))
    rows = campaign_buckets(campaigns).select(
        F.concat_ws(", ", *[F.when(F.col(k), label) for k, label in buckets]).alias("have"),
        F.concat_ws(", ", *[F.when(~F.col(k), label) for k, label in buckets]).alias("lack"),
        reduce(lambda a, b: a + b, [F.col(k).cast("int") for k, _ in buckets]).alias("n"),
    )
    notes = ""
    if cfg.competitors_conquest:
        notes += f" Conquest names: {', '.join(cfg.competitors_conquest)}."
    if cfg.competitors_friendly:
        notes += f" Kept out of conquest and negatives: {', '.join(cfg.competitors_friendly)}."
    ok = F.col("n") >= 2
    missing = F.when(F.col("lack") != "", say(" Missing: ", F.col("lack"), ".")).otherwise("")
    have = F.when(F.col("have") != "", F.col("have")).otherwise("none")
    return rows.select(*_finding(
        "three_bucket", "K", severity=F.when(ok, "PASS").otherwise("IMPORTANT"),
        title=F.when(ok, "Brand, non-brand and conquest are separated").otherwise(
            say("Campaign structure lacks ", F.col("lack"))),
        observation=say("Found: ", have, ".", missing, notes),
        magnitude=F.when(ok, "Structure follows the three buckets").otherwise("Buckets are not fully separated"),
        impact="Separate buckets keep bidding signals clean and let copy match intent.",
        summary="Keep or rebuild separate brand, non-brand and conquest campaigns",
        dollar=F.when(ok, "LOW").otherwise("MEDIUM"), effort="S", timing="Reference", action=PASS,
    )).withColumns({
        "effort": F.when(F.col("severity") == "PASS", "S").otherwise("L"),
        "timing": F.when(F.col("severity") == "PASS", "Reference").otherwise("Month 2"),
        "action": F.when(F.col("severity") == "PASS", PASS).otherwise(BUILD),
    })


# --- waste ------------------------------------------------------------------------


def _protected(cfg: ClientConfig) -> Column:
    return contains_any(lowered("search_term"), (*cfg.brand_terms, *cfg.competitors_friendly, *cfg.waste_exclusions))


def _zero_conversion() -> Column:
    return (F.col("cost") > 0) & (F.col("conversions").isNull() | (F.col("conversions") == 0))


def wasted_terms(terms: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Rows with cost and no conversions that no protected term covers."""
    return terms.filter(_zero_conversion() & ~_protected(cfg))


def waste_totals(terms: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Waste, protected waste and the waste share of all search-term cost."""
    idle, safe = _zero_conversion(), _protected(cfg)
    sums = terms.agg(total("cost").alias("cost"), total("cost", idle & ~safe).alias("waste"),
                     total("cost", idle & safe).alias("protected"), count_where(idle & ~safe).alias("rows"))
    return sums.withColumn("pct", ratio0("waste", "cost") * 100)


def _theme_costs(terms: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Unrounded cost per distinct token of the wasted terms.

    Rows of one text are summed before the token explosion, so a head term is
    tokenised once; tokens are then combined map-side before the shuffle.
    """
    texts = wasted_terms(terms, cfg).groupBy("search_term").agg(F.sum(units("cost")).alias("u"))
    tokens = texts.select(F.explode(theme_tokens("search_term")).alias("token"), "u")
    return tokens.groupBy("token").agg((F.sum("u") / 1e6).alias("cost"))


def waste_themes(terms: DataFrame, cfg: ClientConfig, top: int | None = 6) -> DataFrame:
    """The costliest tokens of the wasted terms; all of them when ``top`` is None."""
    sums = _theme_costs(terms, cfg)
    if top is not None:
        sums = sums.orderBy(F.col("cost").desc(), "token").limit(top)
    return sums.select("token", money("cost"))


def waste(terms: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Spend on search terms without conversions; critical from 40 % of the spend."""
    order = [F.col("cost").desc(), F.col("token")]
    themes = _named_top(_theme_costs(terms, cfg), order, say(F.col("token"), " (", money_text("cost"), ")"), 6)
    rows = waste_totals(terms, cfg).filter("waste > 0").withColumn("themes", themes)
    severe = F.col("pct") >= 40
    shield = F.when(F.col("protected") > 0, say(" (", money_text("protected"), " in protected terms left out)"))
    return rows.select(*_finding(
        "waste", "K", severity=F.when(severe, "CRITICAL").otherwise("IMPORTANT"),
        title="Spend on search terms without conversions",
        observation=say(money_text("waste"), " without a conversion, ", _n("pct"), "% of search-term spend",
                        F.coalesce(shield, F.lit("")), ". Largest themes: ", F.col("themes"), "."),
        magnitude=say(money_text("waste"), " without conversions · ", _n("pct"), "% of search spend"),
        impact="Without negatives the same queries return every period.",
        summary="Build shared negative lists, seeded from the largest themes",
        dollar=F.when(severe, "HIGH").otherwise("MEDIUM"), effort="M", timing="Week 2", action=BUILD,
    ))


def waste_evidence(terms: DataFrame, cfg: ClientConfig, top: int = 30) -> DataFrame:
    rows = wasted_terms(terms, cfg).orderBy(F.col("cost").desc(), "search_term", "row_index").limit(top)
    return rows.select(F.col("search_term").alias("term"), "row_index", money("cost"))


# --- quality ----------------------------------------------------------------------


def _score() -> Column:
    return F.col("quality_score").try_cast("double")


def _low_ctr() -> Column:
    return F.lower(F.coalesce("exp_ctr", F.lit(""))) == RATINGS[2].lower()


def quality(keywords: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Spend rated below average for expected CTR, and keywords at or below the score floor."""
    floor = int(cfg.threshold("qs_floor"))
    low, danger = _low_ctr(), _score() <= floor
    sums = keywords.agg(
        count_where(low).alias("low_n"), total("cost", low).alias("low_cost"), count_where(danger).alias("dz_n"),
        total("cost", danger).alias("dz_cost"), F.sum(_score()).alias("points"), F.count(_score()).alias("scored"),
    ).withColumn("mean", ratio0("points", "scored"))
    mean = fixed_text("mean", 1)
    first = sums.filter("low_cost > 0").select(*_finding(
        "expected_ctr", "Q", severity="IMPORTANT",
        title=say("Expected CTR below average on ", money_text("low_cost"), " of spend"),
        observation=say(_n("low_n"), " keywords are rated below average (", money_text("low_cost"),
                        "). Mean score of the account: ", mean, "."),
        magnitude=say(money_text("low_cost"), " rated below average, about ",
                      money_text(F.col("low_cost") * CTR_PENALTY), " of modelled CPC penalty"),
        impact="A low expected CTR is paid for in every click.",
        summary="Rework the copy of the costliest keywords with a low expected CTR",
        dollar="MEDIUM", effort="M", timing="Week 1-2",
    ))
    second = sums.filter("dz_n > 0").select(*_finding(
        "low_score", "Q", severity="IMPORTANT",
        title=say(f"Scores 1-{floor}: ", _n("dz_n"), " keywords, ", money_text("dz_cost")),
        observation=say(f"Scores 1-{floor}: ", _n("dz_n"), " keywords with ", money_text("dz_cost"),
                        " of spend. Mean score of the account: ", mean, "."),
        magnitude=say(_n("dz_n"), " keywords pay a CPC penalty"),
        impact="Fixing or pausing them frees budget for better keywords.",
        summary="Pause or rework the keywords with the lowest scores",
        dollar="MEDIUM", effort="M", timing="Month 2",
    ))
    return first.unionByName(second)


def quality_evidence(keywords: DataFrame, cfg: ClientConfig, kind: str = "expected_ctr", top: int = 30) -> DataFrame:
    chosen = _low_ctr() if kind == "expected_ctr" else _score() <= int(cfg.threshold("qs_floor"))
    rows = keywords.filter(chosen).orderBy(F.col("cost").desc(), "search_keyword", "row_index").limit(top)
    return rows.select(F.col("search_keyword").alias("keyword"), F.col("quality_score").alias("qs"), "row_index",
                       money("cost"))


# --- placements ---------------------------------------------------------------------


def placement_counts(placements: DataFrame) -> DataFrame:
    """Placements in all, with two or more impressions, and with at most one."""
    return placements.agg(F.count("*").alias("total"), count_where(F.col("impressions") >= 2).alias("served"),
                          count_where(F.col("impressions") <= 1).alias("one"))


def placement_spray(placements: DataFrame) -> DataFrame:
    rows = placement_counts(placements).filter("total > 0")
    served, one = ratio0("served", "total") * 100, ratio0("one", "total") * 100
    return rows.select(*_finding(
        "placements", "P", severity="CRITICAL",
        title=say("Placements are spread thin: ", fixed_text(served, 1), "% served twice or more"),
        observation=say(grouped_text("total"), " placements; ", grouped_text("served"), " (", fixed_text(served, 1),
                        "%) had two or more impressions, ", grouped_text("one"), " (", _n(one), "%) at most one."),
        magnitude=say(_n(one), "% of placements had at most one impression"),
        impact="A long tail of single impressions dilutes budget and brand safety.",
        summary="Exclude weak placements and tighten audience signals",
        dollar="HIGH", effort="M", timing="Week 2",
    ))


def placement_evidence(placements: DataFrame, top: int = 25) -> DataFrame:
    name = F.coalesce(F.nullif("performance_max_placement", F.lit("")), F.lit("(unknown)"))
    rows = placements.filter(F.col("impressions") >= 2).select(name.alias("placement"), "impressions")
    return rows.orderBy(F.col("impressions").desc(), "placement").limit(top).select(
        "placement", whole("impressions").alias("impressions"))


# --- all findings -------------------------------------------------------------------


def run_analyzers(cfg: ClientConfig, current: Column, *, campaigns: DataFrame, keywords: DataFrame | None = None,
                  terms: DataFrame | None = None, placements: DataFrame | None = None) -> DataFrame:
    """All findings of a client; reports that are absent contribute nothing."""
    parts = [density(campaigns, current, cfg), conversion_trend(campaigns, current, cfg)]
    if keywords is not None:
        parts += [match_types(keywords), brand_split(keywords, cfg), quality(keywords, cfg)]
    parts.append(three_bucket(campaigns, cfg))
    if terms is not None:
        parts.append(waste(terms, cfg))
    if placements is not None:
        parts.append(placement_spray(placements))
    return reduce(DataFrame.unionByName, parts)


def _long(finding: str, evidence: DataFrame) -> DataFrame:
    """A row per value of an evidence table; its first column names the entity, numbers and texts have columns of their own."""
    entity, *rest = evidence.columns
    kinds = dict(evidence.dtypes)

    def value(c: str) -> Column:
        written = kinds[c] in ("string", "boolean")
        return F.struct(F.lit(c).alias("key"), F.when(F.lit(written), F.col(c).cast("string")).alias("text"),
                        F.lit(None).cast("double").alias("number") if written else F.col(c).cast("double").alias("number"))

    return evidence.select(F.lit(finding).alias("finding"), F.col(entity).cast("string").alias("entity"), F.inline(F.array(*map(value, rest))))


def run_evidence(cfg: ClientConfig, current: Column, *, campaigns: DataFrame, keywords: DataFrame | None = None,
                 terms: DataFrame | None = None, placements: DataFrame | None = None) -> DataFrame:
    """Evidence of the findings that were raised, in long form: (finding, entity, key, text, number)."""
    camps = density_evidence(campaigns, current, cfg)
    parts = {"density": camps, "low_volume": camps.filter("low_volume"), "trend": trend_evidence(campaigns, current)}
    if keywords is not None:
        parts["match_types"] = match_type_mix(keywords)
        parts["brand_split"] = brand_split_rows(keywords, cfg)
        parts["expected_ctr"] = quality_evidence(keywords, cfg)
        parts["low_score"] = quality_evidence(keywords, cfg, "low_score")
    if terms is not None:
        parts["waste"] = waste_evidence(terms, cfg)
    if placements is not None:
        parts["placements"] = placement_evidence(placements)
    rows = reduce(DataFrame.unionByName, [_long(key, df) for key, df in parts.items()])
    raised = run_analyzers(cfg, current, campaigns=campaigns, keywords=keywords, terms=terms, placements=placements).select("finding")
    return rows.join(F.broadcast(raised), "finding", "left_semi")  # at most one row a finding


def _position(values: tuple[str, ...], c: str) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c))


def _by_severity() -> list[Column]:
    return [_position(SEVERITIES, "severity"), _position(ORDER, "finding")]


def overview(findings: DataFrame, top: int = 6) -> DataFrame:
    """The first findings that are not a PASS, by severity."""
    rows = findings.filter(F.col("severity") != "PASS").orderBy(*_by_severity()).limit(top)
    return rows.select(F.col("title").alias("topic"), F.col("magnitude").alias("detail"))


def _mapped(c: str, labels: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[F.col(c)], F.col(c))


def recommendations(findings: DataFrame) -> DataFrame:
    """Findings that ask for action, as recommendation objects."""
    rows = findings.filter(F.col("severity") != "PASS").orderBy(*_by_severity())
    return rows.select(
        "finding", _mapped("severity", PRIORITY).alias("priority"), _mapped("module", CATEGORY).alias("category"),
        say(F.col("action"), " ", F.col("summary")).alias("recommendation"),
        say(F.col("observation"), " ", F.col("impact")).alias("rationale"),
        _mapped("dollar", IMPACT).alias("expected_impact"), _mapped("effort", EFFORT).alias("effort"),
        "severity", "magnitude", "timing",
    )


def complexity_profile(placements: DataFrame) -> DataFrame:
    """Account profile: number of brands (one per client) and whether placements exist."""
    return placements.agg((F.count("*") > 0).alias("has_pmax")).select(F.lit(1).alias("n_brands"), "has_pmax")
