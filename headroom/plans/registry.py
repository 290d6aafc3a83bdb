"""All queries of the engine with their SQL oracles."""

from __future__ import annotations

from ..operators import report
from .relations import NOW, RELATIONS, T0, WEEK, Settings, query, text

NAMES = """
usage_between snapshots_between bounds window_ids price_join event_cost api_equiv unpriced_models external_models weekly_usd dq_prices
coalesce_snapshots instances instance_summary scoped_ids operative_window open_closed attribution gap_usage gap_snapshot candidates admission
recency_cap exclusions instance_rates snap_pct latest_plan plan_points billing_evidence dq_grid dq_coverage
floor_week best_hundred bound rate_median band loo_shift tier measured_span plan_cost decision certified_epoch certified_extraction open_extraction
left_on_table window_worth unlock insufficient live_gap capture_curve capture_pace window_context other_windows provider_report status_line brief_rows
formatters plan_resolve dq_calibration dq_attribution dq_checks dq_parse_loss
scan_transcripts dedup_events usage_filters quarantine scan_summary retract_source insert_ignore counter_diff scan_rollout_usage carry_model active_copy
scan_spool scan_polls scan_rollout_snapshots union_sources source_crosscheck manifest_delta
accounts basis open_windows report_notes phrases source_inventory insert_ignore_snapshots union_events counter_warnings
""".split()

QUERIES = {n: query(n) for n in NAMES}
ORACLES = {n: text(n, "duck") for n in NAMES}

# what a user asks for: one provider, another period
ASKED = {
    "one_provider": ("weekly_usd", Settings(providers=("beta",))),
    "one_provider_report": ("provider_report", Settings(providers=("alpha",))),
    "last_week": ("api_equiv", report.settings("7d", NOW)),
    "last_week_report": ("provider_report", report.settings("week", NOW, "both")),
    "second_week": ("usage_between", Settings(T0 + WEEK, T0 + 2 * WEEK)),
    "second_week_snapshots": ("snapshots_between", Settings(T0 + WEEK, T0 + 2 * WEEK, providers=("alpha",))),
    "all_history": ("left_on_table", report.settings("all", NOW)),
}
QUERIES |= {n: query(name, s) for n, (name, s) in ASKED.items()}
ORACLES |= {n: text(name, "duck", settings=s) for n, (name, s) in ASKED.items()}

# the report as JSON has no SQL form; tests hold it against the report's columns
QUERIES["report_json"] = report.report_json
assert set(NAMES) <= set(RELATIONS)
