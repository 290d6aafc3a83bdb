"""Window instances from the snapshot series, attribution of usage, gates."""

from __future__ import annotations

from .relations import MOST_INSTANCES, K, dollars, relation

KW = f"{K}, window_id"
RESET_SLACK, DROP = 600, 5
SNAP = "case when abs({0} - round({0})) < 1e-6 then round({0}) else {0} end"


@relation
def coalesced(d):
    """One row per second: the largest percent; each missing field from the row of next lower percent, of equal percents from the source that comes last."""
    by = d.pair("used_percent", "coalesce(source, '')")
    known = lambda c: f"max_by({c}, {by}) filter (where {c} is not null) {c}"
    return f"""
select {KW}, ts, max(used_percent) used_percent, {known('window_minutes')}, {known('resets_at')}, {known('plan_type')}
from snapshots group by {KW}, ts"""


@relation
def coalesce_snapshots(d):
    return coalesced(d) if d.spark else "select * from coalesced"  # asked for alone, the rows need not be written


def _differ(a: str, b: str) -> str:
    return f"coalesce({a} <> {b}, false)"


SLOT = 86400
POINT = "cast(ts as bigint) ts, cast(used_percent as double) used_percent, cast(window_minutes as bigint) window_minutes, cast(resets_at as bigint) resets_at, plan_type"


@relation
def slots(d):
    """Each part of a series (SLOT seconds) with the last row of the part before it."""
    return f"""
select {KW}, slot, lag(ending) over (partition by {KW} order by slot) border
from (select {KW}, ts div {SLOT} slot, max_by(struct({POINT}), ts) ending from coalesced group by {KW}, ts div {SLOT}) x"""


@relation
def cuts(d):
    """Snapshots, and whether the row before proves a new instance: every such cut is one of the exact rules, so that instances lie inside segments.

    Rows meet their neighbours inside a slot; the first one of a slot meets the border row. No task sorts a whole series.
    """
    before = lambda c, name: f"case when p_ts is null then border.{c} else {name} end"
    return f"""
select {KW}, slot, ts, used_percent, window_minutes, resets_at, plan_type, q_ts is null or used_percent < q_pct - {DROP} or {_differ('q_minutes', 'window_minutes')} or {_differ('q_plan', 'plan_type')}
    or coalesce(ts - q_ts > q_minutes * 60, false) or coalesce(abs(q_resets - resets_at) > {2 * RESET_SLACK}, false) cut
from (select *, {before('ts', 'p_ts')} q_ts, {before('used_percent', 'p_pct')} q_pct, {before('window_minutes', 'p_minutes')} q_minutes, {before('resets_at', 'p_resets')} q_resets, {before('plan_type', 'p_plan')} q_plan
  from (select c.*, b.border from (
    select *, lag(ts) over w p_ts, lag(window_minutes) over w p_minutes, lag(resets_at) over w p_resets, lag(used_percent) over w p_pct, lag(plan_type) over w p_plan
    from (select *, ts div {SLOT} slot from coalesced) x window w as (partition by {KW}, slot order by ts)) c
  join slots b on b.account_id = c.account_id and b.provider = c.provider and b.window_id = c.window_id and b.slot = c.slot) y) z"""


@relation
def segments(d):
    """Snapshots with the number of their segment: cuts so far in the slot, and in the slots before it."""
    return f"""
select c.account_id, c.provider, c.window_id, c.ts, c.used_percent, c.window_minutes, c.resets_at, c.plan_type,
  coalesce(b.ahead, 0) + sum(case when cut then 1 else 0 end) over (partition by c.account_id, c.provider, c.window_id, c.slot order by c.ts rows unbounded preceding) segment
from cuts c join (select {KW}, slot, sum(n) over (partition by {KW} order by slot rows between unbounded preceding and 1 preceding) ahead from (
  select {KW}, slot, sum(case when cut then 1 else 0 end) n from cuts group by {KW}, slot) x) b
on b.account_id = c.account_id and b.provider = c.provider and b.window_id = c.window_id and b.slot = c.slot"""


def _starts(minutes: str, anchor: str, plan: str, last: str, pct: str, r: str) -> str:
    """Whether row `r` starts a new instance, against what the instance so far carries."""
    return (
        f"{_differ(minutes, r + 'window_minutes')} or coalesce(abs({anchor} - {r}resets_at) > {RESET_SLACK}, false) or coalesce({r}used_percent < {pct} - {DROP}, false) "
        f"or coalesce({r}ts - {last} > {minutes} * 60, false) or {_differ(plan, r + 'plan_type')}"
    )


@relation
def instanced(d):
    """Snapshots with the number of their instance, counted from 1 per window.

    An instance carries its first known length, the first known reset as anchor (drift is
    measured against it, not against the row before) and its latest plan. A row starts a
    new one if the length differs, the reset lies more than 600 s from the anchor, the
    percent falls by more than 5, a whole window passed unseen, or the plan differs.
    Spark folds the rows of a segment in order and keeps only the times of the starts, and
    adds the number of starts in the segments before (a row each); the plain form walks each
    series row by row.
    """
    if not d.spark:
        moved = _starts("c_minutes", "c_anchor", "c_plan", "c_ts", "c_pct", "")
        return f"""
with recursive rows_of as materialized (select *, row_number() over (partition by {KW} order by ts) rn from coalesced),
walk as (
  select {KW}, rn, ts, used_percent, window_minutes, resets_at, plan_type, window_minutes c_minutes, resets_at c_anchor, plan_type c_plan, cast(1 as bigint) instance_id from rows_of where rn = 1
  union all
  select {KW}, rn, ts, used_percent, window_minutes, resets_at, plan_type, case when moved then window_minutes else coalesce(c_minutes, window_minutes) end,
    case when moved then resets_at else coalesce(c_anchor, resets_at) end, case when moved then plan_type else coalesce(plan_type, c_plan) end, instance_id + case when moved then 1 else 0 end
  from (select *, {moved} moved from (
    select n.*, w.c_minutes, w.c_anchor, w.c_plan, w.ts c_ts, w.used_percent c_pct, w.instance_id from walk w
    join rows_of n on n.account_id = w.account_id and n.provider = w.provider and n.window_id = w.window_id and n.rn = w.rn + 1) x) y)
select {KW}, ts, used_percent, window_minutes, resets_at, plan_type, instance_id from walk"""
    return f"""
select f.account_id, f.provider, f.window_id, r.ts, r.used_percent, r.window_minutes, r.resets_at, r.plan_type, cast(f.ahead + size(filter(f.starts, x -> x <= r.ts)) as bigint) instance_id
from (select g.*, coalesce(b.ahead, 0) ahead, explode(g.points) r from folded g join (
  select {KW}, segment, sum(n) over (partition by {KW} order by segment rows between unbounded preceding and 1 preceding) ahead from (select {KW}, segment, size(starts) n from folded) x) b
  on b.account_id = g.account_id and b.provider = g.provider and b.window_id = g.window_id and b.segment = g.segment) f"""


@relation
def folded(d):
    """Each segment's rows in order, and the times at which instances start in it."""
    new = f"s.last is null or {_starts('s.minutes', 's.anchor', 's.plan', 's.last', 's.pct', 'r.')}"
    carried = lambda yes, no: f"case when {new} then {yes} else {no} end"
    start = "named_struct('last', cast(null as bigint), 'pct', cast(null as double), 'minutes', cast(null as bigint), 'anchor', cast(null as bigint), 'plan', cast(null as string), 'starts', cast(array() as array<bigint>))"
    step = f"""named_struct('last', r.ts, 'pct', r.used_percent, 'minutes', {carried('r.window_minutes', 'coalesce(s.minutes, r.window_minutes)')}, 'anchor', {carried('r.resets_at', 'coalesce(s.anchor, r.resets_at)')},
    'plan', {carried('r.plan_type', 'coalesce(r.plan_type, s.plan)')}, 'starts', case when {new} then concat(s.starts, array(r.ts)) else s.starts end)"""
    return f"""
select {KW}, segment, points, aggregate(points, {start}, (s, r) -> {step}, s -> s.starts) starts
from (select {KW}, segment, sort_array(collect_list(struct({POINT}))) points from segments group by {KW}, segment) x"""


@relation
def summary(d):
    return f"""
select {KW}, instance_id, min(ts) first_ts, max(ts) last_ts, max(ts) - min(ts) covered_secs, max(used_percent) peak_pct, min(case when used_percent = peak then ts end) peak_ts,
  min_by(used_percent, ts) first_pct, max_by(used_percent, ts) last_pct, max_by(resets_at, ts) filter (where resets_at is not null) resets_at,
  min_by(window_minutes, ts) filter (where window_minutes is not null) window_minutes, max_by(plan_type, ts) filter (where plan_type is not null) plan_type, count(*) n_points
from (select *, max(used_percent) over (partition by {KW}, instance_id) peak from instanced) x group by {KW}, instance_id"""


@relation
def instances(d):
    return f"select {KW}, ts, instance_id from instanced"


@relation
def instance_summary(d):
    return "select * from summary"


@relation
def scoped_ids(d):
    return f"""
select distinct a.account_id, a.provider, a.window_id from window_ids a join window_ids b on a.account_id = b.account_id and a.provider = b.provider
  and length(a.window_id) > length(b.window_id) and substr(a.window_id, 1, length(b.window_id)) = b.window_id"""


@relation
def newest(d):
    """The newest instance of each window that is not scoped, and whether it is live."""
    return f"""
select x.*, coalesce(window_minutes > 0 and {d.now} - last_ts <= window_minutes * 60, false) live from (
  select s.*, row_number() over (partition by s.account_id, s.provider, s.window_id order by s.first_ts desc) newness from summary s
  left join scoped_ids c on c.account_id = s.account_id and c.provider = s.provider and c.window_id = s.window_id where c.window_id is null) x where newness = 1"""


@relation
def operative(d):
    return f"""
select {KW}, window_minutes, window_minutes * 60 regime_secs, live from (
  select *, row_number() over (partition by {K} order by live desc, case when live then window_minutes else last_ts end desc,
    case when live then last_ts else window_minutes end desc, window_id desc) pick from newest) x where pick = 1 and window_minutes > 0"""


@relation
def operative_window(d):
    return "select * from operative"


@relation
def op_instances(d):
    """In-regime instances of the operative window, newest first, and which is open."""
    return f"""
select s.*, o.regime_secs, row_number() over (partition by s.account_id, s.provider order by s.first_ts desc) rn,
  row_number() over (partition by s.account_id, s.provider order by s.first_ts desc) = 1
    and case when s.resets_at is not null then s.resets_at > {d.now} else {d.now} - s.last_ts <= o.regime_secs end is_open
from summary s join operative o on o.account_id = s.account_id and o.provider = s.provider and o.window_id = s.window_id and o.window_minutes = s.window_minutes"""


@relation
def open_closed(d):
    return f"select {KW}, instance_id, first_ts, is_open, not is_open and covered_secs >= 0.75 * regime_secs is_complete from op_instances"


@relation
def instance_days(d):
    """Each attribution span (first_ts, peak_ts] by the days that it touches."""
    return f"select {K}, instance_id, first_ts, peak_ts, regime_secs, {d.every(d.div('first_ts', '86400'), d.div('peak_ts', '86400'))} as day_no from op_instances"


@relation
def attributed(d):
    """Events inside the attribution spans, by the inequality that defines them.

    Spark meets events and spans by account and day, so that no account's history stands in
    one task; the spans of a window do not overlap.
    """
    met = "instance_days i on i.account_id = e.account_id and i.provider = e.provider and i.day_no = e.day_no" if d.spark else "op_instances i on i.account_id = e.account_id and i.provider = e.provider"
    return f"""
select e.account_id, e.provider, e.dedup_key, e.ts, e.usd, e.is_approx, e.is_unpriced, i.instance_id, i.first_ts, i.peak_ts, i.regime_secs
from (select *, {d.div('ts', '86400')} as day_no from priced) e join {met} and e.ts > i.first_ts and e.ts <= i.peak_ts"""


@relation
def attribution(d):
    return f"select {K}, instance_id, count(*) n_events, {dollars('usd')} attributed_usd, bool_or(is_unpriced) unpriced, bool_or(is_approx) approx from attributed group by {K}, instance_id"


@relation
def usage_gaps(d):
    return f"""
select i.account_id, i.provider, i.instance_id, coalesce(greatest(g.inner_gap, i.peak_ts - g.last_event), i.peak_ts - i.first_ts) gap from op_instances i left join (
  select {K}, instance_id, max(ts - before) inner_gap, max(ts) last_event from (
    select {K}, instance_id, ts, lag(ts, 1, first_ts) over (partition by {K}, instance_id order by ts) before from attributed) x group by {K}, instance_id) g
on g.account_id = i.account_id and g.provider = i.provider and g.instance_id = i.instance_id"""


@relation
def gap_usage(d):
    return "select * from usage_gaps"


@relation
def snapshot_gaps(d):
    return f"""
select {K}, instance_id, max(ts - before) gap from (
  select s.account_id, s.provider, s.instance_id, s.ts, lag(s.ts, 1, i.first_ts) over (partition by s.account_id, s.provider, s.instance_id order by s.ts) before
  from instanced s join op_instances i on i.account_id = s.account_id and i.provider = s.provider and i.window_id = s.window_id and i.instance_id = s.instance_id
  where s.ts <= i.peak_ts) x group by {K}, instance_id"""


@relation
def gap_snapshot(d):
    return "select * from snapshot_gaps"


@relation
def prepared(d):
    """Closed in-regime instances with dollars, growth and gaps: the candidates."""
    return f"""
select i.account_id, i.provider, i.instance_id, i.first_ts, i.last_ts, i.peak_ts, i.peak_pct, i.first_pct, i.covered_secs, i.regime_secs, i.is_open,
  greatest(cast(0 as double), {SNAP.format('i.peak_pct')} - ({SNAP.format('i.first_pct')})) dpct, coalesce(a.attributed_usd, cast(0 as double)) attributed_usd, coalesce(a.unpriced, false) unpriced, coalesce(a.approx, false) approx,
  u.gap usage_gap, s.gap snapshot_gap
from op_instances i left join attribution a on a.account_id = i.account_id and a.provider = i.provider and a.instance_id = i.instance_id
left join usage_gaps u on u.account_id = i.account_id and u.provider = i.provider and u.instance_id = i.instance_id
left join snapshot_gaps s on s.account_id = i.account_id and s.provider = i.provider and s.instance_id = i.instance_id"""


@relation
def candidates(d):
    return f"select {K}, instance_id, first_ts, dpct, attributed_usd, unpriced, approx from prepared where not is_open"


@relation
def admitted(d):
    """Gates in order: growth, prices, usage gap, snapshot gap; equality admits."""
    return f"""
select *, case when dpct < 10 then 'low_growth' when unpriced then 'unpriced' when usage_gap > greatest(0.25 * (peak_ts - first_ts), 1800) then 'usage_gap'
  when snapshot_gap > 0.10 * regime_secs then 'snapshot_gap' end reason from prepared where not is_open"""


@relation
def scanned(d):
    return f"""
select * from (select *, coalesce(sum(case when reason is null then 1 else 0 end) over (partition by {K} order by first_ts desc rows between unbounded preceding and 1 preceding), 0) < {MOST_INSTANCES} is_scanned
from admitted) x"""


@relation
def admission(d):
    return f"select {K}, instance_id, first_ts, dpct, usage_gap, snapshot_gap, reason from admitted"


@relation
def recency_cap(d):
    return f"select {K}, instance_id, first_ts, reason, is_scanned from scanned"


@relation
def exclusions(d):
    return f"select {K}, reason, count(*) n from scanned where is_scanned and reason is not null group by {K}, reason"


@relation
def qualified(d):
    return f"""
select *, attributed_usd / dpct * 100 rate, attributed_usd / (dpct + 1) * 100 rate_lo, attributed_usd / (dpct - 1) * 100 rate_hi
from scanned where is_scanned and reason is null"""


@relation
def instance_rates(d):
    return f"select {K}, instance_id, round(cast(rate as double), 6) rate, round(cast(rate_lo as double), 6) rate_lo, round(cast(rate_hi as double), 6) rate_hi from qualified"


@relation
def snap_pct(d):
    return f"select {KW}, ts, {SNAP.format('used_percent')} snapped, abs(used_percent - round(used_percent)) >= 1e-6 fractional from snapshots"


@relation
def latest_plan(d):
    return f"select {K}, max_by(plan_type, ts) filter (where plan_type is not null) plan_type from snapshots group by {K}"


@relation
def plan_points(d):
    return f"""
select {K}, ts, plan_type from (select *, lag(plan_type) over (partition by {K} order by ts) before from (
  select {K}, ts, max(plan_type) plan_type from snapshots where plan_type is not null group by {K}, ts) x) y where before is null or before <> plan_type"""


@relation
def billing_evidence(d):
    return f"""
select s.account_id, s.provider, bool_or(s.ts >= {d.t0} and s.ts < {d.now} and c.window_id is null) have_billing
from snapshots s left join scoped_ids c on c.account_id = s.account_id and c.provider = s.provider and c.window_id = s.window_id group by s.account_id, s.provider"""


@relation
def dq_grid(d):
    return f"select {K}, cast(sum(case when abs(used_percent - round(used_percent)) >= 1e-6 then 1 else 0 end) as bigint) fractional, count(*) n from snapshots group by {K}"


@relation
def dq_coverage(d):
    return f"select {K}, {d.day('min(ts)')} first_day, {d.day('max(ts)')} last_day from usage_events group by {K}"
