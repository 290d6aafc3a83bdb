"""Bands, bounds, tiers, dollars left unused, decisions: at most eight rows per account and provider.

What is unknown is null, with a reason beside it, and no account is left out: reports start
from all accounts that have usage or snapshots.
"""

from __future__ import annotations

from ..functions.text import usd
from .relations import MONTH, K, dollars, relation
from .windows import SNAP

DECISION_REASON = (
    "case when reason_code = 'extracted' then 'dollars extracted are unknown' when reason_code = 'cost' then 'plan cost is unknown: no plan price, or no measured time' "
    "when reason_code = 'straddles' then 'the range lies on both sides of 1.0 times the plan cost' when verdict = 'DOWNGRADE' then 'returns less than 1.0 times the plan cost' end"
)
ON = "{0}.account_id = {1}.account_id and {0}.provider = {1}.provider"


def on(a: str, b: str) -> str:
    return ON.format(a, b)


def r6(x: str) -> str:
    return f"round(cast({x} as double), 6)"


@relation
def regime(d):
    return f"select {K}, min(first_ts) regime_start, max(regime_secs) regime_secs, cast(sum(case when not is_open and covered_secs >= 0.75 * regime_secs then 1 else 0 end) as bigint) complete from op_instances group by {K}"


@relation
def floors(d):
    """Best calendar week inside the regime, scaled to the window; the earliest of equals."""
    return f"""
select x.account_id, x.provider, week_start, usd, approx, usd * least(regime_secs, 604800) / 604800 floor_window from (
  select w.*, g.regime_secs, row_number() over (partition by w.account_id, w.provider order by w.usd desc, w.week_start) pick
  from weekly w join regime g on {on('w', 'g')} where w.week_start >= g.regime_start and w.usd > 0) x where pick = 1"""


@relation
def floor_week(d):
    return f"select {K}, week_start, {r6('usd')} usd, {r6('floor_window')} floor_window, approx from floors"


@relation
def hundreds(d):
    return f"""
select {K}, any_hundred, case when usd > 0 then first_ts end first_ts, usd, case when usd > 0 then approx else false end approx from (
  select {K}, true any_hundred, first_ts, attributed_usd usd, approx, row_number() over (partition by {K} order by attributed_usd desc, first_ts) pick
  from prepared where {SNAP.format('peak_pct')} >= 100) x where pick = 1"""


@relation
def best_hundred(d):
    return f"select {K}, first_ts, {r6('usd')} usd, approx from hundreds"


@relation
def bounded(d):
    return f"""
select g.account_id, g.provider, g.regime_start, g.regime_secs, g.complete, coalesce(h.any_hundred, false) any_hundred,
  greatest(coalesce(f.floor_window, cast(0 as double)), coalesce(h.usd, cast(0 as double))) bound,
  case when greatest(coalesce(f.floor_window, 0), coalesce(h.usd, 0)) <= 0 then null when coalesce(h.usd, 0) >= coalesce(f.floor_window, 0) then 'instance' else 'week' end bound_source,
  case when coalesce(h.usd, 0) >= coalesce(f.floor_window, 0) then coalesce(h.approx, false) else coalesce(f.approx, false) end bound_approx
from regime g left join floors f on {on('f', 'g')} left join hundreds h on {on('h', 'g')}"""


@relation
def bound(d):
    return f"select {K}, {r6('bound')} bound, bound_source, bound_approx from bounded"


@relation
def rate_median(d):
    return f"select {K}, {r6('median(rate)')} med, count(*) n from qualified group by {K}"


@relation
def banded(d):
    """Order statistics of the low, point and high rates, each sorted on its own; n = 8 drops the outermost."""
    return f"""
select {K}, n, med, {d.at('lows', 'case when n = 8 then 2 else 1 end')} lo, {d.at('highs', 'case when n = 8 then 7 else n end')} hi,
  {d.at('array(0.0D, 0.5D, 0.75D, 0.875D, 0.9375D, 0.96875D, 0.984375D, 0.9296875D)' if d.text('x') == 'string(x)' else '[0.0::double, 0.5, 0.75, 0.875, 0.9375, 0.96875, 0.984375, 0.9296875]', 'n')} coverage,
  approx, min_dpct, 1 / (min_dpct - 1) widening
from (select {K}, cast(count(*) as int) n, median(rate) med, {d.sorted('rate_lo')} lows, {d.sorted('rate_hi')} highs, bool_or(approx) approx, min(dpct) min_dpct from qualified group by {K}) x where n >= 2"""


@relation
def band(d):
    return f"select {K}, n, {r6('lo')} lo, {r6('med')} med, {r6('hi')} hi, {r6('coverage')} coverage, approx, {r6('min_dpct')} min_dpct, {r6('widening')} widening from banded"


@relation
def influence(d):
    """Largest relative shift of the median when one instance is left out, and the newest instance that has it."""
    return f"""
select {K}, shift, first_ts, rate from (select l.*, row_number() over (partition by l.account_id, l.provider order by l.shift desc, l.first_ts desc) pick from (
  select q.account_id, q.provider, q.first_ts, q.rate, case when abs(b.med) < 2.220446049250313e-16 then 0 else abs((median(o.rate) - b.med) / b.med) end shift
  from qualified q join qualified o on {on('q', 'o')} and q.instance_id <> o.instance_id join banded b on {on('b', 'q')}
  group by q.account_id, q.provider, q.first_ts, q.rate, b.med) l) x where pick = 1"""


@relation
def loo_shift(d):
    return f"select {K}, {r6('shift')} shift, first_ts from influence"


@relation
def tiered(d):
    return f"""
select x.*, case when any_hundred or (bound > 0 and med is not null and bound >= med) then 'MEASURED' when n >= 4 and shift <= 0.25 then 'CALIBRATED' else 'INSUFFICIENT' end tier
from (select b.*, coalesce(q.n, 0) n, a.lo, a.med, a.hi, a.coverage, coalesce(a.approx, false) band_approx, i.shift, i.first_ts shift_ts, i.rate shift_rate
from bounded b left join (select {K}, count(*) n from qualified group by {K}) q on {on('q', 'b')} left join banded a on {on('a', 'b')} left join influence i on {on('i', 'b')}) x"""


@relation
def tier(d):
    return f"select {K}, tier, n, {r6('shift')} shift from tiered"


@relation
def spans(d):
    """Usage and snapshot spans inside the period, touching ones merged."""
    return f"""
select {K}, min(a) a, max(b) b from (
  select {K}, a, b, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by {K} order by a, b rows unbounded preceding) island from (
    select {K}, a, b, max(b) over (partition by {K} order by a, b rows between unbounded preceding and 1 preceding) reach from (
      select {K}, greatest(lo, {d.t0}) a, least(hi + 1, {d.now}) b from bounds) i where a < b) m) x group by {K}, island"""


@relation
def measured(d):
    return f"select {K}, cast(sum(b - a) as bigint) measured_secs, count(*) pieces, min(a) hull_t0, max(b) hull_t1 from spans group by {K}"


@relation
def accounts(d):
    return f"select {K} from usage_events union select {K} from snapshots"


@relation
def plan_segments(d):
    """Plans by time; the first one reaches back to the beginning."""
    return f"""
select {K}, plan_type, case when row_number() over (partition by {K} order by ts) = 1 then -4611686018427387904 else ts end a,
  lead(ts, 1, 4611686018427387904) over (partition by {K} order by ts) b from plan_points"""


@relation
def plan_resolved(d):
    """The current plan of each account: a configured price beats that of the plan's own."""
    return f"""
select k.account_id, k.provider, l.plan_type, coalesce(o.override_usd, p.monthly_usd) monthly_usd, case when o.override_usd is not null then false else coalesce(p.plan_approx, true) end plan_approx,
  case when o.override_usd is not null then 'config' when p.monthly_usd is not null then 'plan' else 'unknown' end origin, o.override_usd,
  case when o.override_usd is not null or p.monthly_usd is not null then null when l.plan_type is null then 'no snapshot names a plan, and no price is configured' else concat('plan ', l.plan_type, ' has no price') end error
from accounts k left join latest_plan l on {on('l', 'k')} left join plan_overrides o on {on('o', 'k')} left join plans p on p.provider = l.provider and p.plan_id = l.plan_type"""


@relation
def plan_resolve(d):
    return f"select {K}, plan_type, {r6('monthly_usd')} monthly_usd, origin, error from plan_resolved"


@relation
def plan_pieces(d):
    """The plan in force over each piece of measured time; without a known plan, the current one."""
    return f"""
select s.account_id, s.provider, g.plan_type, greatest(s.a, coalesce(g.a, s.a)) a, least(s.b, coalesce(g.b, s.b)) b
from spans s left join plan_segments g on {on('s', 'g')} and greatest(s.a, g.a) < least(s.b, g.b)"""


@relation
def plan_costs(d):
    """Dollars of the plan over the measured time; an unknown historical plan is priced as the current one, and a configured price holds for all time."""
    return f"""
select c.account_id, c.provider, x.cost, c.monthly_usd, c.plan_approx, c.plan_type, coalesce(x.unknown_history, false) unknown_history, x.unknown_plans, c.error
from plan_resolved c left join (
  select s.account_id, s.provider, sum(coalesce(r.override_usd, h.monthly_usd, r.monthly_usd) * ((s.b - s.a) / cast({MONTH} as double))) cost,
    bool_or(h.monthly_usd is null and s.plan_type is not null and r.override_usd is null) unknown_history,
    {d.kinds("case when h.monthly_usd is null and r.override_usd is null then s.plan_type end")} unknown_plans
  from plan_pieces s join plan_resolved r on {on('r', 's')} left join plans h on h.provider = s.provider and h.plan_id = s.plan_type group by s.account_id, s.provider) x on {on('x', 'c')}"""


@relation
def plan_cost(d):
    return f"select {K}, plan_type, {r6('monthly_usd')} monthly_usd, {r6('cost')} cost, unknown_history from plan_costs where cost is not null or plan_type is not null"


@relation
def operands(d):
    """What the decision compares, as a range (lo = hi here), and the plan's cost over the measured time."""
    return f"""
select k.account_id, k.provider, coalesce(a.full_usd, cast(0 as double)) lo, coalesce(a.full_usd, cast(0 as double)) hi, coalesce(a.approx_usd, cast(0 as double)) approx_usd,
  case when c.cost > 0 then c.cost end cost, coalesce(a.approx_usd, 0) > 0 or coalesce(c.plan_approx, true) approx
from accounts k left join api_equiv a on {on('a', 'k')} left join plan_costs c on {on('c', 'k')}"""


@relation
def decided(d):
    """KEEP if the whole range returns the plan's cost, DOWNGRADE if none of it does; the end of the range next to the verdict's border is reported, never a middle."""
    known = f"lo > -{d.inf()} and hi < {d.inf()} and lo <= hi"
    return f"""
select x.*, case verdict when 'KEEP' then lo when 'DOWNGRADE' then hi else case when reason_code = 'cost' and lo = hi then lo end end full_usd,
  case verdict when 'KEEP' then lo / cost when 'DOWNGRADE' then hi / cost end multiple
from (select y.*, case when reason_code is not null then 'UNKNOWN' when lo / cost >= 1 then 'KEEP' else 'DOWNGRADE' end verdict
  from (select o.account_id, o.provider, o.lo, o.hi, o.approx_usd, o.approx, case when o.cost > 0 and o.cost < {d.inf()} then o.cost end cost,
    case when not coalesce({known}, false) then 'extracted' when not coalesce(cost > 0 and cost < {d.inf()}, false) then 'cost' when lo / cost < 1 and hi / cost >= 1 then 'straddles' end reason_code from operands o) y) x"""


@relation
def decision(d):
    return f"""
select {K}, verdict, {r6('multiple')} return_multiple, {r6('full_usd')} extracted_usd, {r6('cost')} plan_cost_usd, approx, {DECISION_REASON} reason from decided"""


def spent_since(d, starts: str, after: str, until: str) -> str:
    """Dollars of each account from its start (`starts` has K and start_ts; `after` is > or >=) to `until`, a condition on ts.

    Spark adds up days first. Whole days meet the start by account, a row a day; only the
    events of the start's own day meet it one by one, by account and day. So no event of a
    long history meets a key that the whole account shares.
    """
    if not d.spark:
        return f"select e.account_id, e.provider, {dollars('e.usd')} usd from priced e join {starts} c on {on('c', 'e')} where e.ts {after} c.start_ts and {until.format('e.ts')} group by e.account_id, e.provider"
    exact = "cast(sum(cast({0} as decimal(28, 9))) as decimal(38, 9))"
    return f"""
select account_id, provider, cast(coalesce(sum(usd), 0) as double) usd from (
  select e.account_id, e.provider, e.usd from (select {K}, ts div 86400 day_no, {exact.format('usd')} usd from priced where {until.format('ts')} group by {K}, ts div 86400) e
  join {starts} c on {on('c', 'e')} and e.day_no > c.start_ts div 86400
  union all select e.account_id, e.provider, cast(e.usd as decimal(38, 9)) from priced e join {starts} c on {on('c', 'e')} and e.ts div 86400 = c.start_ts div 86400 and e.ts {after} c.start_ts where {until.format('e.ts')}) x
group by account_id, provider"""


@relation
def certified_starts(d):
    """When the current plan and regime began."""
    return f"""
select g.account_id, g.provider, greatest(g.regime_start, coalesce(p.ts, 0)) start_ts from regime g left join (select {K}, max(ts) ts from plan_points group by {K}) p on {on('p', 'g')}"""


@relation
def certified_periods(d):
    """The part of that time inside the period."""
    return f"select {K}, greatest(start_ts, {d.t0}) start_ts from certified_starts"


@relation
def certified(d):
    """Measured time and dollars under the current plan and regime."""
    return f"""
select t.account_id, t.provider, t.start_ts, coalesce(s.secs, 0) secs, coalesce(u.usd, cast(0 as double)) usd from certified_starts t
left join (select c.account_id, c.provider, cast(sum(greatest(0, s.b - greatest(s.a, c.start_ts))) as bigint) secs from spans s join certified_starts c on {on('c', 's')} group by c.account_id, c.provider) s on {on('s', 't')}
left join ({spent_since(d, 'certified_periods', '>=', '{} < ' + str(d.now))}) u on {on('u', 't')}"""


@relation
def certified_epoch(d):
    return f"select {K}, start_ts, secs from certified"


@relation
def certified_extraction(d):
    return f"select {K}, start_ts, {r6('usd')} usd from certified"


@relation
def open_starts(d):
    """The live open instance of the operative window."""
    return f"select {K}, first_ts start_ts, first_ts, last_ts, last_pct, resets_at, regime_secs from op_instances where is_open and {d.now} - last_ts <= regime_secs"


@relation
def opened(d):
    """The live open instance of the operative window and the dollars spent in it."""
    return f"""
select o.account_id, o.provider, o.first_ts, o.last_ts, o.last_pct, o.resets_at, o.regime_secs, coalesce(u.usd, cast(0 as double)) usd
from open_starts o left join ({spent_since(d, 'open_starts', '>', '{} <= ' + str(d.now))}) u on {on('u', 'o')}"""


@relation
def open_extraction(d):
    return f"select {K}, first_ts, last_pct, resets_at, {r6('usd')} usd from opened"


@relation
def left_over(d):
    """Dollars left unused over the measured span: a band, a certified floor, or null with the reason (never zero)."""
    usable = "tier is not null and have_billing and measured_secs > 0"
    return f"""
select z.*, case when kind is not null then null when tier is null then 'no limit window was observed' when not have_billing then 'no utilization was recorded in the period'
    when measured_secs <= 0 then 'nothing was measured in the period' when bound > 0 then 'usage covers all that is proven' else 'not calibrated, and no bound is proven yet' end left_reason
from (
select x.*, case when {usable} and tier = 'CALIBRATED' then 'band' when {usable} and certified_low > 0 then 'floor' end kind,
  case when {usable} and tier = 'CALIBRATED' then greatest(greatest(lo, bound) * windows - full_usd, 0) when {usable} and certified_low > 0 then certified_low end left_lo,
  case when {usable} and tier = 'CALIBRATED' then greatest(med * windows - full_usd, 0) end left_med, case when {usable} and tier = 'CALIBRATED' then greatest(hi * windows - full_usd, 0) end left_hi,
  case when {usable} and tier = 'CALIBRATED' then band_approx when {usable} and certified_low > 0 then bound_approx end left_approx
from (select k.account_id, k.provider, t.regime_start, t.regime_secs, t.complete, t.any_hundred, t.bound, t.bound_source, t.bound_approx, coalesce(t.n, 0) n, t.lo, t.med, t.hi, t.coverage, t.band_approx, t.shift, t.shift_ts, t.shift_rate, t.tier,
    coalesce(m.measured_secs, 0) measured_secs, coalesce(m.measured_secs, 0) / cast(t.regime_secs as double) windows, coalesce(a.full_usd, cast(0 as double)) full_usd, coalesce(e.have_billing, false) have_billing,
    case when t.bound > 0 then t.bound * (c.secs / cast(t.regime_secs as double)) - c.usd end certified_low
  from accounts k left join tiered t on {on('t', 'k')} left join measured m on {on('m', 'k')} left join billing_evidence e on {on('e', 'k')} left join api_equiv a on {on('a', 'k')} left join certified c on {on('c', 'k')}) x) z"""


@relation
def left_on_table(d):
    return f"select {K}, tier, kind, {r6('left_lo')} lo, {r6('left_med')} med, {r6('left_hi')} hi, {r6('windows')} windows, left_approx approx, left_reason reason from left_over"


@relation
def worths(d):
    return f"""
select t.account_id, t.provider, t.tier, c.monthly_usd * t.regime_secs / cast({MONTH} as double) window_cost,
  case when c.monthly_usd > 0 then case t.tier when 'CALIBRATED' then t.med when 'MEASURED' then case when t.bound > 0 then t.bound end end / (c.monthly_usd * t.regime_secs / cast({MONTH} as double)) end worth
from tiered t left join plan_costs c on {on('c', 't')}"""


@relation
def window_worth(d):
    return f"select {K}, tier, {r6('window_cost')} window_cost, {r6('worth')} worth from worths"


@relation
def unlocked(d):
    """When a fourth instance can qualify. With none so far at a known pace the date would be absurd: null."""
    return f"""
select t.account_id, t.provider, t.tier, t.n, greatest(0, 4 - t.n) needed, case when t.complete >= 1 then 'rate' else 'structural' end path,
  case when t.complete >= 1 then case when t.n > 0 then {d.now} + cast(ceil(greatest(0, 4 - t.n) / (t.n / cast(t.complete as double))) as bigint) * t.regime_secs end
  else greatest(f.first_ts + 4 * t.regime_secs, {d.now} + t.regime_secs) end unlocks_at
from tiered t join (select s.account_id, s.provider, min(s.first_ts) first_ts from summary s join operative o on {on('o', 's')} and o.window_id = s.window_id group by s.account_id, s.provider) f on {on('f', 't')}"""


@relation
def unlock(d):
    return f"select {K}, needed, path, unlocks_at from unlocked"


@relation
def insufficient(d):
    """What is missing for a calibrated band: more instances, or others beside the one that decides alone."""
    missing = f"""case when u.needed > 0 then concat({d.text('u.needed')}, ' more instances of ', o.window_id, ' with a growth of 10 points or more')
    else concat('the instance of ', {d.day('t.shift_ts')}, ' at ', {usd(d, 't.shift_rate')}, ' a window alone moves the estimate by ', {d.fixed('t.shift * 100', 1)}, '%') end"""
    return f"""
select t.account_id, t.provider, u.needed, case when u.needed > 0 then u.path end path, case when u.needed > 0 then u.unlocks_at end unlocks_at,
  case when u.needed = 0 then t.shift_ts end demoted_ts, {r6('case when u.needed = 0 then t.shift_rate end')} demoted_rate, {r6('case when u.needed = 0 then t.shift end')} demoted_shift, {missing} missing
from tiered t join unlocked u on {on('u', 't')} join operative o on {on('o', 't')} where t.tier = 'INSUFFICIENT'"""


@relation
def gaps(d):
    return f"""
select x.*, case when tier = 'CALIBRATED' then 'band' when bound > 0 and bound - usd > 0 then 'floor' end kind,
  case when tier = 'CALIBRATED' then greatest(greatest(lo * frac, bound - usd), 0) when bound > 0 and bound - usd > 0 then bound - usd end gap_lo,
  case when tier = 'CALIBRATED' then med * frac end gap_med, case when tier = 'CALIBRATED' then hi * frac end gap_hi,
  case when tier = 'CALIBRATED' or (bound > 0 and bound - usd > 0) then null when bound > 0 then 'usage in this window covers all that is proven' else 'not calibrated, and no bound is proven yet' end gap_reason
from (select t.*, o.first_ts open_first, o.last_ts open_last, o.last_pct, o.resets_at, o.usd, greatest((100 - ({SNAP.format('o.last_pct')})) / 100, cast(0 as double)) frac from tiered t join opened o on {on('o', 't')}) x"""


@relation
def live_gap(d):
    return f"select {K}, kind, {r6('gap_lo')} lo, {r6('gap_med')} med, {r6('gap_hi')} hi, gap_reason from gaps"


@relation
def curve(d):
    """Percent of each qualifying instance at 25, 50 and 75 percent of the window; null if it was not observed so long."""
    return f"""
select q.account_id, q.provider, q.instance_id, c.checkpoint, case when q.last_ts >= q.first_ts + cast(floor(c.checkpoint * q.regime_secs) as bigint) then max_by(s.used_percent, s.ts) end pct
from qualified q join (select cast(0.25 as double) checkpoint union all select cast(0.5 as double) union all select cast(0.75 as double)) c on true
join operative o on {on('o', 'q')}
left join instanced s on {on('s', 'q')} and s.window_id = o.window_id and s.instance_id = q.instance_id and s.ts <= q.first_ts + cast(floor(c.checkpoint * q.regime_secs) as bigint)
group by q.account_id, q.provider, q.instance_id, c.checkpoint, q.last_ts, q.first_ts, q.regime_secs"""


@relation
def capture_curve(d):
    return f"select {K}, checkpoint, {r6('median(pct)')} med, count(pct) n, count(*) - count(pct) skipped from curve group by {K}, checkpoint"


@relation
def capture_pace(d):
    return f"""
select g.account_id, g.provider, {r6('g.age')} age_frac, {r6('g.gap_lo / g.n_days')} per_day_lo, {r6('g.gap_med / g.n_days')} per_day_med, {r6('g.gap_hi / g.n_days')} per_day_hi,
  case when g.checkpoint is null then 'too_young' when c.n < 4 then 'uncalibrated' else 'calibrated' end pace, case when c.n >= 4 then c.med end checkpoint_pct, g.checkpoint
from (select *, case when age >= 0.75 then cast(0.75 as double) when age >= 0.5 then cast(0.5 as double) when age >= 0.25 then cast(0.25 as double) end checkpoint
  from (select *, (resets_at - {d.now}) / cast(86400 as double) n_days, greatest({d.now} - open_first, 0) / cast(regime_secs as double) age
    from gaps where tier = 'CALIBRATED' and resets_at > {d.now}) y) g
left join capture_curve c on {on('c', 'g')} and c.checkpoint = g.checkpoint"""


@relation
def contexts(d):
    """Other windows: peaks of the past instances of the same length."""
    return f"""
select s.account_id, s.provider, s.window_id, median({SNAP.format('s.peak_pct')}) median_peak, count(*) n, cast(sum(case when {SNAP.format('s.peak_pct')} >= 100 then 1 else 0 end) as bigint) hit_100
from summary s join newest w on {on('w', 's')} and w.window_id = s.window_id and w.window_minutes = s.window_minutes and w.instance_id <> s.instance_id group by s.account_id, s.provider, s.window_id"""


@relation
def window_context(d):
    return f"select c.* from contexts c join operative o on {on('o', 'c')} and o.window_id <> c.window_id"


@relation
def other_windows(d):
    return f"""
select w.account_id, w.provider, w.window_id, w.last_pct used_percent, w.resets_at, c.median_peak, coalesce(c.n, 0) n, coalesce(c.hit_100, 0) hit_100, 'dollars go with the operative window' gap_reason
from newest w join operative o on {on('o', 'w')} and o.window_id <> w.window_id left join contexts c on {on('c', 'w')} and c.window_id = w.window_id where w.live"""


@relation
def dq_calibration(d):
    return f"select {K}, case when tier = 'INSUFFICIENT' then 'warn' else 'ok' end status, tier from tiered"


@relation
def contained(d):
    """Instances of shorter windows, scoped ones left out, inside the attribution spans of the newest eight long ones that have a span."""
    return f"""
select i.account_id, i.provider, i.instance_id, s.window_id, s.first_ts, s.peak_ts from op_instances i join summary s on {on('s', 'i')} and s.window_id <> i.window_id
  and s.first_ts >= i.first_ts and s.peak_ts <= i.peak_ts and s.peak_ts > s.first_ts
join newest w on {on('w', 's')} and w.window_id = s.window_id and w.window_minutes > 0 and w.window_minutes * 60 < i.regime_secs where i.rn <= 8 and i.peak_ts > i.first_ts"""


@relation
def contained_hours(d):
    """Each contained span by the hours that it touches."""
    return f"select {K}, instance_id, first_ts, peak_ts, {d.every(d.div('first_ts', '3600'), d.div('peak_ts', '3600'))} as hour_no from contained"


@relation
def dq_attribution(d):
    """Dollars of contained shorter instances must not exceed the long instance's: the newest eight that contain any are checked.

    Spark meets events and shorter spans by hour: by instance alone, each event of a week would meet all shorter spans of that week, in one task.
    """
    inside = f"""select c.account_id, c.provider, c.instance_id, {dollars('p.usd')} usd from contained c
    left join attributed p on {on('p', 'c')} and p.instance_id = c.instance_id and p.ts > c.first_ts and p.ts <= c.peak_ts group by c.account_id, c.provider, c.instance_id"""
    if d.spark:
        inside = f"""select c.account_id, c.provider, c.instance_id, {dollars('p.usd')} usd from (select distinct {K}, instance_id from contained) c
    left join (select h.account_id, h.provider, h.instance_id, h.hour_no, sum(cast(e.usd as decimal(28, 9))) usd from contained_hours h
      join (select {K}, instance_id, ts, usd, ts div 3600 hour_no from attributed) e on {on('e', 'h')} and e.instance_id = h.instance_id and e.hour_no = h.hour_no and e.ts > h.first_ts and e.ts <= h.peak_ts
      group by h.account_id, h.provider, h.instance_id, h.hour_no) p on {on('p', 'c')} and p.instance_id = c.instance_id group by c.account_id, c.provider, c.instance_id"""
    return f"""
select s.account_id, s.provider, s.instance_id, {r6('coalesce(a.attributed_usd, 0)')} long_usd, {r6('s.usd')} short_usd, case when s.usd <= coalesce(a.attributed_usd, 0) + 0.01 then 'ok' else 'fail' end status
from ({inside}) s
left join attribution a on {on('a', 's')} and a.instance_id = s.instance_id"""


@relation
def dq_checks(d):
    """One row per check: ok, warn or fail, and how many rows it found wanting."""
    checks = (
        ("price_table", "fail", "price_problems", "problem is not null"), ("unpriced_usage", "warn", "unpriced_models", "tokens > 0"), ("percent_grid", "warn", "dq_grid", "fractional > 0"),
        ("plan_price", "warn", "plan_resolved", "error is not null"), ("billing_evidence", "warn", "billing_evidence", "not have_billing"), ("calibration", "warn", "dq_calibration", "status = 'warn'"),
        ("attribution", "fail", "dq_attribution", "status = 'fail'"), ("parse_loss", "warn", "scan_summary", "parse_errors > 0"), ("sources", "fail", "source_inventory", "status = 'fail'"),
        ("source_crosscheck", "warn", "source_crosscheck", "not agrees"),
    )
    rows = [f"select '{name}' name, '{word}' word, count(*) n_rows, coalesce(sum(case when {bad} then 1 else 0 end), 0) n_bad from {table}" for name, word, table, bad in checks]
    found = "\nunion all ".join(rows)
    return f"select name, case when n_bad = 0 then 'ok' else word end status, concat({d.text('cast(n_bad as bigint)')}, ' of ', {d.text('n_rows')}, ' rows') detail from ({found}) x"
