"""Text helpers for the SQL oracles: the same numeric rules, written for DuckDB.

The oracles state each operator a second time in plain SQL; they share no code
with the operators.
"""

from __future__ import annotations


def units(c: str) -> str:
    return f"cast(floor(coalesce({c},0)*1e6+0.5) as bigint)"


def tot(c: str, where: str | None = None) -> str:
    """Exact sum of a metric, optionally filtered."""
    only = f" filter (where {where})" if where else ""
    return f"(coalesce(sum({units(c)}){only},0)/1e6)"


def cnt(where: str | None = None) -> str:
    return f"cast(count(*) filter (where {where}) as bigint)" if where else "cast(count(*) as bigint)"


def rnd(x: str, digits: int) -> str:
    return f"cast(round(cast({x} as decimal(28,10)),{digits}) as double)"


def whole(x: str) -> str:
    return f"cast(round(cast({x} as decimal(28,10)),0) as bigint)"


def div0(a: str, b: str) -> str:
    return f"(case when ({b})<>0 then ({a})*1e0/({b}) else 0e0 end)"


def divn(a: str, b: str) -> str:
    return f"(case when ({b})<>0 then ({a})*1e0/({b}) end)"


def chg(cur: str, prev: str) -> str:
    return rnd(divn(f"({cur})-({prev})", prev), 4)


def money_text(x: str) -> str:
    return f"'$'||format('{{{{:,}}}}', {whole(x)})".replace("{{", "{").replace("}}", "}")


def grouped_text(x: str) -> str:
    return money_text(x).replace("'$'||", "")


def fixed_text(x: str, digits: int) -> str:
    return f"cast(cast(round(cast({x} as decimal(28,10)),{digits}) as decimal(28,{digits})) as varchar)"


def n_text(x: str) -> str:
    return f"cast({whole(x)} as varchar)"


def has(text: str, *terms: str) -> str:
    return "(" + " or ".join(f"contains(lower({text}),'{t}')" for t in terms) + ")"


def category(text: str, default: str = "null") -> str:
    return (
        f"case when {has(text, 'widget')} then 'Widget' when {has(text, 'bolt')} then 'Bolt' "
        f"when {has(text, 'ring sets', 'ring', 'sets')} then 'Ring sets' when {has(text, 'gear')} then 'Gear' "
        f"else {default} end"
    )


def nonbrand_category(name: str) -> str:
    return (
        f"case when {has(name, 'brand defense', '| brand', 'gizmo')} then null when {has(name, 'widget')} then 'Widget' "
        f"when {has(name, 'bolt')} then 'Bolt' when {has(name, 'ring', 'sets')} then 'Ring sets' "
        f"when {has(name, 'gear')} then 'Gear' when {has(name, 'pmax', 'performance max')} then 'PMax' "
        f"when {has(name, 'conquest', 'competitor')} then 'Conquest' "
        f"when {has(name, 'non-brand', 'nonbrand', 'non brand')} then 'Non-Brand Search' else 'Other Non-Brand' end"
    )


def region_of(name: str) -> str:
    raw = f"trim(regexp_extract(lower({name}), 'tier\\s+\\S+\\s*[-–:|]\\s*(.+)$', 1))"
    word = "case when length(w)<=3 then upper(w) else upper(w[1])||w[2:] end"
    return f"nullif(array_to_string(list_transform(string_split({raw},' '), lambda w: {word}),' '),'')"


def rating(c: str) -> str:
    return (
        f"case when {has(c, 'above')} then 'Above average' when {has(c, 'below')} then 'Below average' "
        f"when {has(c, 'average')} then 'Average' end"
    )


def bands(value: str, bounds: tuple[float, ...], labels: tuple[str, ...]) -> str:
    whens = " ".join(f"when {value}>={b} then '{label}'" for b, label in zip(bounds, labels))
    return f"case {whens} else '{labels[-1]}' end"


G = ("A — Top Performer", "B — Good", "C — Average", "D — Below Average", "F — Poor / No Conversions")
GRADE_LIST = "(values " + ",".join(f"('{g}',{i})" for i, g in enumerate((*G, "Low Volume"), 1)) + ") as grades(label,pos)"
RATING_LIST = "(values ('Above average',1),('Average',2),('Below average',3))"


def term_grade(clicks: str = "clicks", conv: str = "conversions") -> str:
    return f"case when {clicks}<5 then 'Low Volume' else {bands(div0(conv, clicks), (0.40, 0.25, 0.15, 0.05), G)} end"


def ad_grade(branded: str) -> str:
    ctr = div0("clicks", "impressions")
    return (
        f"case when impressions<100 then 'Low Volume' when {branded} then "
        f"{bands(ctr, (0.30, 0.20, 0.10, 0.05), G)} else {bands(ctr, (0.10, 0.06, 0.04, 0.02), G)} end"
    )


def page_grade() -> str:
    return (
        "case when impressions<100 or clicks<5 then 'Low Volume' else "
        f"{bands(div0('conversions', 'clicks'), (0.40, 0.25, 0.15, 0.05), G)} end"
    )


def month_text(d: str) -> str:
    return f"strftime({d}, '%Y-%m')"


def month_abbr(d: str) -> str:
    return f"strftime({d}, '%b %Y')"


_END = "max(window_end)"
AS_OF = (
    f"(select cast(case when last_day({_END})={_END} then date_trunc('month',{_END}) "
    f"else date_trunc('month',{_END})-interval 1 month end as date) from {{fx_uploads}})"
)
CURRENT = f"(select max(month_start) from {{fx_campaign_performance}} where month_start<={AS_OF})"
