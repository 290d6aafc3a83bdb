"""The report of an account and provider: its parts as rows, its notes and phrases as text."""

from __future__ import annotations

from ..functions.text import count, duration, measured, percent, reason_phrase, usd, usd_whole, window_word
from .estimate import DECISION_REASON, on, r6
from .relations import K, relation
from .windows import SNAP


def listed(d, x: str) -> str:
    return d.joined(x)


@relation
def measured_span(d):
    """Measured time inside the period; nothing measured is a span of zero length."""
    return f"""
select k.account_id, k.provider, coalesce(m.measured_secs, 0) measured_secs, coalesce(m.pieces, 0) pieces, coalesce(m.hull_t0, {d.t0}) hull_t0, coalesce(m.hull_t1, {d.t0}) hull_t1,
  least(cast(1 as double), coalesce(m.measured_secs, 0) / cast({d.now - d.t0} as double)) coverage_frac from accounts k left join measured m on {on('m', 'k')}"""


@relation
def excluded(d):
    """Instances that the gates refused, as rows and as a phrase."""
    one = f"case when n > 1 then concat({reason_phrase('reason')}, ' x', {d.text('n')}) else {reason_phrase('reason')} end"
    return f"select {K}, cast(sum(n) as bigint) n_excluded, concat({d.text('cast(sum(n) as bigint)')}, ' excluded: ', {listed(d, one)}) phrase from exclusions group by {K}"


@relation
def basis(d):
    """What an estimate rests on."""
    return f"""
select t.account_id, t.provider, t.tier, o.window_id, o.window_minutes regime_minutes, t.n n_qualifying, coalesce(x.n_excluded, 0) n_excluded, x.phrase excluded,
  {r6('t.lo')} band_lo, {r6('t.med')} band_med, {r6('t.hi')} band_hi, {r6('t.coverage')} band_coverage, {r6('t.shift')} max_loo_shift, {r6('b.min_dpct')} min_dpct, {r6('b.widening')} widening,
  {r6('case when f.floor_window > 0 then f.floor_window end')} floor_usd, {r6('case when t.bound > 0 then t.bound end')} bound_usd, t.bound_source, case when t.bound_source = 'instance' then h.first_ts when t.bound_source = 'week' then f.week_start end bound_ts,
  case when t.bound > 0 then c.start_ts end certified_start, case when t.bound > 0 then c.secs end certified_secs, {r6('case when t.bound > 0 then c.secs / cast(t.regime_secs as double) end')} certified_windows, {r6('case when t.bound > 0 then c.usd end')} certified_usd,
  t.tier = 'MEASURED' floor_binding, {r6('w.worth')} worth_multiple, {r6('coalesce(m.measured_secs, 0) / cast(t.regime_secs as double)')} period_windows,
  i.needed, i.missing, i.path, i.unlocks_at, i.demoted_ts, i.demoted_rate, i.demoted_shift, coalesce(g.fractional, 0) > 0 fractional_seen
from tiered t join operative o on {on('o', 't')} left join excluded x on {on('x', 't')} left join banded b on {on('b', 't')} left join floors f on {on('f', 't')} left join hundreds h on {on('h', 't')}
left join certified c on {on('c', 't')} left join worths w on {on('w', 't')} left join measured m on {on('m', 't')} left join insufficient i on {on('i', 't')} left join dq_grid g on {on('g', 't')}"""


@relation
def open_windows(d):
    """The live windows: the operative one with dollars, or the reason why not; the others with the peaks of their past."""
    none = "cast(null as double)"
    return f"""
select g.account_id, g.provider, o.window_id, true operative, {SNAP.format('g.last_pct')} used_pct, g.resets_at, g.kind, {r6('g.gap_lo')} gap_lo, {r6('g.gap_med')} gap_med, {r6('g.gap_hi')} gap_hi, g.gap_reason,
  {r6("case when g.kind = 'floor' then g.bound end")} certified_bound, {r6("case when g.kind = 'floor' then g.usd end")} certified_used, p.pace, {r6('p.age_frac')} age_frac, {r6('p.per_day_lo')} per_day_lo, {r6('p.per_day_med')} per_day_med, {r6('p.per_day_hi')} per_day_hi,
  {none} median_peak, cast(null as bigint) n_past, cast(null as bigint) hit_100
from gaps g join operative o on {on('o', 'g')} left join capture_pace p on {on('p', 'g')}
union all select account_id, provider, window_id, false, {SNAP.format('used_percent')}, resets_at, cast(null as string), {none}, {none}, {none}, gap_reason, {none}, {none}, cast(null as string), {none}, {none}, {none}, {none}, median_peak, n, hit_100 from other_windows"""


@relation
def report_notes(d):
    """What a reader has to know beside the figures, in the order of the report; each is null where it does not apply."""
    name = f"concat(model, ' (', {count(d, 'tokens')}, ' tok)')"
    models = lambda t: f"(select {K}, {listed(d, name)} names from {t} group by {K})"
    return f"""
select k.account_id, k.provider,
  case when m.pieces > 1 then concat('measured in ', {d.text('m.pieces')}, ' separate stretches of ', {duration(d, 'm.measured_secs')}, ' together; nothing is assumed between them') end disjoint,
  case when m.hull_t0 + 86400 < p.ts then concat('the plan before ', {d.day('p.ts')} , ' is taken to be ', p.plan_type) end history,
  case when c.unknown_plans <> '' then concat('past plans without a price count as the current one: ', c.unknown_plans) end unknown_plans,
  case when u.names is not null then concat('not priced, not in the dollars: ', u.names) end unpriced, case when x.names is not null then concat('not paid for by the subscription: ', x.names) end external,
  case when a.approx_usd > 0.005 then concat({usd(d, 'a.approx_usd')}, ' rest on approximate prices') end approximate,
  case when g.fractional > 0 then 'percents with fractions were seen: the rounding model may be wrong' end fractional, c.error
from accounts k left join measured m on {on('m', 'k')} left join plan_costs c on {on('c', 'k')} left join api_equiv a on {on('a', 'k')} left join dq_grid g on {on('g', 'k')}
left join {models('unpriced_models')} u on {on('u', 'k')} left join {models('external_models')} x on {on('x', 'k')}
left join (select {K}, min(ts) ts, min_by(plan_type, ts) plan_type from plan_points group by {K}) p on {on('p', 'k')}"""


@relation
def provider_report(d):
    """One row per account and provider, whatever is known of it."""
    return f"""
select l.account_id, l.provider, c.plan_type, {r6('c.monthly_usd')} monthly_usd, c.plan_approx, {r6('w.window_cost')} window_cost, m.hull_t0, m.hull_t1, m.measured_secs, {r6('m.coverage_frac')} coverage_frac,
  {r6('l.full_usd')} extracted_usd, l.tier, l.kind, {r6('l.left_lo')} left_lo, {r6('l.left_med')} left_med, {r6('l.left_hi')} left_hi, l.left_approx, l.left_reason,
  {r6('g.gap_lo')} gap_lo, {r6('g.gap_med')} gap_med, {r6('g.gap_hi')} gap_hi, case when g.account_id is null then 'no window is open' else g.gap_reason end gap_reason,
  v.verdict, {r6('v.multiple')} return_multiple, {r6('v.cost')} plan_cost_usd, v.approx decision_approx, {DECISION_REASON.replace('reason_code', 'v.reason_code').replace('verdict', 'v.verdict')} decision_reason,
  n.disjoint note_disjoint, n.history note_history, n.unknown_plans note_unknown_plans, n.unpriced note_unpriced, n.external note_external, n.approximate note_approximate, n.fractional note_fractional, n.error
from left_over l join measured_span m on {on('m', 'l')} join plan_costs c on {on('c', 'l')} join decided v on {on('v', 'l')} join report_notes n on {on('n', 'l')}
left join worths w on {on('w', 'l')} left join gaps g on {on('g', 'l')}"""


@relation
def status_line(d):
    """An entry per open window: percent used, for the operative one what is left (both ends of a band), and the time to its reset."""
    left = f"""case when not operative then '' when kind = 'band' then concat(' - ', {usd_whole(d, 'gap_lo')}, ' to ', {usd_whole(d, 'gap_hi')}, ' left')
  when kind = 'floor' then concat(' - at least ', {usd_whole(d, 'gap_lo')}, ' left') else ' - gap not measured' end"""
    return f"""
select account_id, provider, window_id, operative, concat(provider, ' ', window_id, ' ', {d.fixed(d.even('used_pct'), 0)}, '%', {left},
  case when resets_at is null then '' else concat(' - resets in ', {duration(d, f'greatest(resets_at - {d.now}, 0)')}) end) entry from open_windows"""


@relation
def brief_rows(d):
    return f"""
select l.account_id, l.provider, case l.kind when 'band' then case when l.left_hi > 0 then 'band' else 'no_shortfall' end when 'floor' then 'floor' else case when l.bound > 0 then 'no_shortfall' when l.n > 0 then 'calibrating' else 'unmeasured' end end headline_kind,
  case when l.kind is not null then {usd(d, 'coalesce(l.left_med, l.left_lo)')} end headline, {usd(d, 'l.full_usd')} extracted, v.verdict, l.left_reason reason
from left_over l join decided v on {on('v', 'l')}"""


@relation
def phrases(d):
    """Words of a report: tier, window, what was excluded, how much was measured."""
    return f"""
select k.account_id, k.provider, coalesce(b.tier, 'UNMEASURED') tier, {window_word(d, 'b.regime_minutes')} window_word, coalesce(b.excluded, 'none excluded') excluded, {measured(d, 'm.measured_secs', 'm.coverage_frac', d.requested)} measured
from accounts k join measured_span m on {on('m', 'k')} left join basis b on {on('b', 'k')}"""


@relation
def formatters(d):
    return f"""
select m.account_id, m.provider, {usd(d, 'coalesce(a.full_usd, cast(0 as double))')} usd, {usd_whole(d, 'coalesce(a.full_usd, cast(0 as double))')} whole, {count(d, 'm.measured_secs')} secs, {d.day(str(d.now))} utc_day, {duration(d, 'm.measured_secs')} duration, {percent(d, 'b.coverage')} coverage
from measured_span m left join api_equiv a on {on('a', 'm')} left join banded b on {on('b', 'm')}"""
