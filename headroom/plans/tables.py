"""The engine's tables derived from `events` (usage log and utilization snapshots), and the small dimensions."""

from __future__ import annotations

from .relations import relation


@relation
def usage_events(d):
    return f"""
select concat('a', cast(user_id % 10 as string)) account_id, case when user_id % 10 < 5 then 'alpha' else 'beta' end provider,
  {d.epoch('ts')} ts,
  case when event_id % 1999 = 0 then 'm-unknown' when event_type = 'error' and user_id % 10 < 5 then 'ext/error' else concat('m-', event_type) end model,
  cast(round(value * 100) as bigint) cents, cast(round(value * 100) as bigint) * 100 input_tokens,
  cast({d.json_('props', '$.k')} as bigint) * 1000 cached_input_tokens,
  case when user_id % 10 >= 5 then cast({d.json_('props', '$.k')} as bigint) * 10 else 0 end cache_w_5m, cast(0 as bigint) cache_w_1h,
  case when event_id % 13 = 0 then cast({d.json_('props', '$.k')} as bigint) else 0 end cache_w_unsplit,
  cast(round(value * 100) as bigint) * 10 output_tokens, concat('s', cast(user_id as string)) session_id, event_id % 17 = 0 is_sidechain,
  concat('e', cast(event_id as string)) dedup_key, concat('f', cast(user_id as string), '.jsonl') source_file, event_id
from events"""


@relation
def snap_base(d):
    """Account 7 has usage but no snapshots."""
    return f"""
select u.*, 1704067200 + {d.div('ts - 1704067200', '604800')} * 604800 wk_start, 1704067200 + {d.div('ts - 1704067200', '18000')} * 18000 h5_start, t.tot, cast(substr(u.account_id, 2) as bigint) n
from usage_events u join (select account_id, cast(sum(cents) as bigint) tot from usage_events group by account_id) t on t.account_id = u.account_id where u.account_id <> 'a7'"""


def _series(d, window: str, minutes: int, start: str, seconds: int, times: str) -> str:
    """A percent that grows with the account's spending. Account 1 reaches 100; resets of accounts 3 and 8 drift by the day; account 4 has gaps in its metadata."""
    return f"""
select account_id, provider, '{window}' window_id, case when n = 4 and ts % 7 = 0 then null else cast({minutes} as bigint) end window_minutes,
  cast(least(100, max({d.div(f'run * 400 * 100{times}', 'tot * (case when n = 1 then 60 else 100 + 20 * n end)')})) as double) used_percent,
  case when n = 4 and ts % 5 = 0 then null else cast(max({start}) + {seconds} + case when n in (3, 8) then {d.div('(ts - 1704067200) % 604800', '86400')} * 130 else 0 end as bigint) end resets_at, ts, 'log' source,
  case when n = 4 and ts % 3 = 0 then null when n % 2 = 0 and ts >= 1704067200 + 14 * 86400 then 'pro' else 'basic' end plan_type
from (select *, cast(sum(cents) over (partition by account_id, {start} order by ts, event_id rows unbounded preceding) as bigint) run from snap_base) x
group by account_id, provider, ts, tot, n"""


#: Running sums of a week and of five hours are made of those of hours, the largest parts that both consist of.
HOUR = "coalesce(ts - pmod(ts - 1704067200, 3600), -9223372036854775808)"


@relation
def hours(d):
    """Each account's hours with what was spent in the week and in the five hours before them."""
    ahead = lambda start: f"sum(spent) over (partition by account_id, {start} order by hour rows between unbounded preceding and 1 preceding)"
    return f"""
select account_id, hour, cast(sum(spent) over (partition by account_id) as bigint) tot, {ahead('wk_start')} wk_ahead, {ahead('h5_start')} h5_ahead
from (select account_id, hour, wk_start, h5_start, sum(cents) spent from hourly group by account_id, hour, wk_start, h5_start) x"""


@relation
def hourly(d):
    return f"""
select account_id, provider, ts, event_id, cents, {HOUR} hour, 1704067200 + {d.div('ts - 1704067200', '604800')} * 604800 wk_start, 1704067200 + {d.div('ts - 1704067200', '18000')} * 18000 h5_start,
  cast(substr(account_id, 2) as bigint) n from usage_events where account_id <> 'a7'"""


def _both_series(d) -> str:
    """Both series of `_series` from one sort of the events, by hours: no task sorts an account's week."""
    run = lambda ahead: f"cast(coalesce({ahead} + run, {ahead}, run) as bigint)"
    used = lambda r, times: f"cast(least(100, max({d.div(f'{r} * 400 * 100{times}', 'tot * (case when n = 1 then 60 else 100 + 20 * n end)')})) as double)"
    point = lambda window, minutes, start, seconds, percent: (
        f"named_struct('window_id', '{window}', 'minutes', cast({minutes} as bigint), 'used_percent', {percent}, 'resets_at', cast({start} + {seconds} + case when n in (3, 8) then {d.div('(ts - 1704067200) % 604800', '86400')} * 130 else 0 end as bigint))"
    )
    return f"""
select account_id, provider, p.window_id, case when n = 4 and ts % 7 = 0 then null else p.minutes end window_minutes, p.used_percent, case when n = 4 and ts % 5 = 0 then null else p.resets_at end resets_at, ts, 'log' source,
  case when n = 4 and ts % 3 = 0 then null when n % 2 = 0 and ts >= 1704067200 + 14 * 86400 then 'pro' else 'basic' end plan_type
from (select account_id, provider, ts, n, explode(array({point('weekly', 10080, 'wk_start', 604800, 'week_used')}, {point('short', 300, 'h5_start', 18000, 'h5_used')})) p from (
  select account_id, provider, ts, n, max(wk_start) wk_start, max(h5_start) h5_start, {used('wk_run', '')} week_used, {used('h5_run', ' * 20')} h5_used from (
    select r.account_id, r.hour, r.provider, r.ts, r.n, r.wk_start, r.h5_start, o.tot, {run('o.wk_ahead')} wk_run, {run('o.h5_ahead')} h5_run
    from (select *, sum(cents) over (partition by account_id, hour order by ts, event_id rows unbounded preceding) run from hourly) r
    join hours o on o.account_id = r.account_id and o.hour = r.hour) x group by account_id, hour, provider, ts, tot, n) y) z"""


@relation
def snapshots(d):
    if d.spark:
        return f"""{_both_series(d)}
union all select account_id, provider, 'weekly_scoped', cast(10080 as bigint), cast(7 as double), cast(wk_start + 604800 as bigint), min(ts), 'log', cast(null as string)
from hourly where n <> 6 group by account_id, provider, wk_start"""
    return f"""{_series(d, 'weekly', 10080, 'wk_start', 604800, '')}
union all {_series(d, 'short', 300, 'h5_start', 18000, ' * 20')}
union all select account_id, provider, 'weekly_scoped', cast(10080 as bigint), cast(7 as double), cast(wk_start + 604800 as bigint), min(ts), 'log', cast(null as string)
from snap_base where n <> 6 group by account_id, provider, wk_start"""


@relation
def provider_rules(d):
    """Whether a slash in a model's name marks it as one that the subscription does not pay for."""
    return "select 'alpha' provider, true slash_is_external union all select 'beta', false"


@relation
def plan_overrides(d):
    """Configured plan prices by account and provider; they beat those of the plan table."""
    return "select 'a9' account_id, 'beta' provider, cast(30 as double) override_usd union all select 'a4', 'beta', cast(99 as double)"


#: provider, prefix, from, until, input, cached, 5m, 1h, write, output (USD per 1M tokens), approx (fixed values)
PRICES = (
    ("alpha", "m-click", "2023-01-01", "2024-01-15", 2.5, 0.25, None, None, None, 15.0, False),
    ("alpha", "m-click", "2024-01-15", None, 2.0, 0.2, None, None, None, 12.0, False),
    ("alpha", "m-v", "2023-01-01", None, 1.0, 0.1, None, None, 1.25, 6.0, False),
    ("alpha", "m-view", "2023-01-01", "2024-01-20", 5.0, 0.5, None, None, 6.25, 30.0, False),
    ("alpha", "m-purchase", "2023-01-01", None, 1.75, 0.175, None, None, None, 14.0, True),
    ("alpha", "m-signup", "2023-01-01", None, 1.25, 0.125, None, None, None, 10.0, False),
    ("beta", "m-click", "2023-01-01", None, 3.0, 0.3, 3.75, 6.0, None, 15.0, False),
    ("beta", "m-view", "2023-01-01", None, 1.0, 0.1, 1.25, 2.0, None, 5.0, False),
    ("beta", "m-purchase", "2023-01-01", "2024-01-15", 2.0, 0.2, 2.5, 4.0, None, 10.0, False),
    ("beta", "m-purchase", "2024-01-15", None, 3.0, 0.3, 3.75, 6.0, None, 15.0, False),
    ("beta", "m-signup", "2023-01-01", None, 15.0, 1.5, 18.75, 30.0, None, 75.0, True),
    ("beta", "m-error", "2023-01-01", None, 0.8, 0.08, 1.0, 1.6, None, 4.0, False),
)
#: provider, plan, USD per month, approx (fixed values)
PLANS = (("alpha", "basic", 20.0, False), ("alpha", "pro", 100.0, True), ("beta", "pro", 150.0, False))


def _number(v) -> str:
    return "cast(null as double)" if v is None else f"cast({v!r} as double)"


def _epoch_day(v: str | None) -> int:
    from datetime import datetime, timezone

    return 2**62 if v is None else int(datetime.fromisoformat(v).replace(tzinfo=timezone.utc).timestamp())


@relation
def prices(d):
    rows = [
        f"select '{p}' provider, '{x}' prefix, cast({_epoch_day(a)} as bigint) from_ts, cast({_epoch_day(b)} as bigint) until_ts, "
        + ", ".join(f"{_number(v)} {n}" for v, n in zip(r, ("p_input", "p_cached", "p_5m", "p_1h", "p_write", "p_output"), strict=True))
        + f", {'true' if approx else 'false'} price_approx, {'true' if p == 'beta' else 'false'} split_family"
        for p, x, a, b, *r, approx in PRICES
    ]
    return "\nunion all ".join(rows)


@relation
def plans(d):
    return "\nunion all ".join(f"select '{p}' provider, '{i}' plan_id, {_number(m)} monthly_usd, {'true' if a else 'false'} plan_approx" for p, i, m, a in PLANS)
