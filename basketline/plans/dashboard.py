"""Analyses of the dashboard by id, the tabs that hold them, and the request pipeline."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from basketline.errors import AccessError
from basketline.operators import charts, segments
from basketline.operators.filters import filter_lines
from basketline.operators.privacy import check, scope_view

# Tabs (also the view each reads), and the analyses on them.
TABS = {
    "revenue": ("revenue_summary_kpis", "country_revenue"),
    "products": ("top_products",),
    "customers": ("repeat_rate", "customer_segments"),
    "time": ("revenue_by_month", "revenue_by_weekday"),
}
TAB_MINIMUM_ROLE = {
    "revenue": "viewer",
    "products": "viewer",
    "customers": "analyst",
    "time": "viewer",
}


def analyses_for(tab: str, role: str) -> tuple[str, ...]:
    """Analyses a role may open on a tab; none on a locked tab."""
    if tab not in TABS:
        raise AccessError(f"unknown tab: {tab!r}")
    return TABS[tab] if check(role, TAB_MINIMUM_ROLE[tab]) else ()


def _segments(lines: DataFrame, **settings) -> charts.Chart:
    found = segments.rfm_segments(lines, **settings)
    return charts.rfm_scatter(found.table, found.details.get("clusters_suppressed", 0))


_ANALYSES: dict[str, Callable[..., charts.Chart]] = {
    "revenue_summary_kpis": lambda lines: charts.chart_from_lines("revenue_by_month", lines),
    "revenue_by_month": lambda lines: charts.chart_from_lines("revenue_by_month", lines),
    "revenue_by_weekday": lambda lines: charts.chart_from_lines("revenue_by_weekday", lines),
    "top_products": lambda lines: charts.chart_from_lines("top_products_bar", lines),
    "country_revenue": lambda lines: charts.chart_from_lines("country_bar", lines),
    "repeat_rate": lambda lines: charts.chart_from_lines("repeat_rate_gauge", lines),
}


def run_analysis(analysis: str, lines: DataFrame, **segment_settings) -> charts.Chart:
    """Compute the chart of an analysis id."""
    if analysis == "customer_segments":
        return _segments(lines, **segment_settings)
    if analysis not in _ANALYSES:
        raise ValueError(f"no analysis named {analysis!r}")
    return _ANALYSES[analysis](lines)


def answer(lines: DataFrame, role: str, tab: str, analysis: str, **filters) -> charts.Chart:
    """One dashboard request: scope the view to the role, filter, and run the analysis."""
    if analysis not in analyses_for(tab, role):
        raise AccessError(f"role {role!r} may not open {analysis!r} on tab {tab!r}")
    return run_analysis(analysis, filter_lines(scope_view(lines, role, tab), **filters))
