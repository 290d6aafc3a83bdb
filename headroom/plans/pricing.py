"""Prices: era and longest-prefix join, event cost, dollar aggregates."""

from __future__ import annotations

from .relations import K, dollars, relation

TOKENS = "input_tokens + cached_input_tokens + cache_w_5m + cache_w_1h + cache_w_unsplit + output_tokens"


@relation
def model_prices(d):
    """Each model's price rows by elementary era: prefixes are resolved on distinct models, never on the fact table."""
    return """
select provider, model, prefix, lo, hi, p_input, p_cached, p_5m, p_1h, p_write, p_output, price_approx, split_family from (
  select c.*, s.lo, s.hi, row_number() over (partition by c.provider, c.model, s.lo order by length(c.prefix) desc) pick
  from (select m.model, p.* from (select distinct provider, model from usage_events) m
    join prices p on p.provider = m.provider and substr(m.model, 1, length(p.prefix)) = p.prefix) c
  join (select provider, model, lo, lead(lo, 1, 4611686018427387904) over (partition by provider, model order by lo) hi from (
      select m.provider, m.model, p.from_ts lo from (select distinct provider, model from usage_events) m
        join prices p on p.provider = m.provider and substr(m.model, 1, length(p.prefix)) = p.prefix
      union select m.provider, m.model, p.until_ts from (select distinct provider, model from usage_events) m
        join prices p on p.provider = m.provider and substr(m.model, 1, length(p.prefix)) = p.prefix) e) s
    on s.provider = c.provider and s.model = c.model and s.lo >= c.from_ts and s.lo < c.until_ts) x
where pick = 1"""


@relation
def ruled(d):
    """Usage events and whether their model is external by the provider's rule."""
    return f"""
select e.*, coalesce(r.slash_is_external, false) and e.model like '%/%' is_external, {TOKENS} total_tokens
from usage_events e left join provider_rules r on r.provider = e.provider"""


@relation
def era_prices(d):
    """The price row of each event by definition: of all rows of its provider and era that are a prefix of its model, the longest."""
    return """
select * from (select e.dedup_key, e.account_id, p.*, row_number() over (partition by e.account_id, e.dedup_key order by length(p.prefix) desc) pick
from usage_events e join prices p on p.provider = e.provider and e.ts >= p.from_ts and e.ts < p.until_ts and starts_with(e.model, p.prefix)) x where pick = 1"""


@relation
def priced(d):
    """Every usage event with its dollars: null where external or unpriced. Events have few models, so the prices go to the events: by key, a task would get all events of a model."""
    found, small = "model_prices p on p.provider = e.provider and p.model = e.model and e.ts >= p.lo and e.ts < p.hi", " /*+ BROADCAST(p) */"
    if not d.spark:
        small, found = "", "era_prices p on p.account_id = e.account_id and p.dedup_key = e.dedup_key"
    return f"""
select{small} e.*, p.prefix, p.prefix is null and not e.is_external is_unpriced,
  case when e.is_external then null when p.split_family then
    (e.input_tokens * p.p_input + e.cache_w_5m * p.p_5m + e.cache_w_1h * p.p_1h + e.cache_w_unsplit * p.p_5m + e.cached_input_tokens * p.p_cached + e.output_tokens * p.p_output) * 1e-6
  else (e.input_tokens * p.p_input + e.cached_input_tokens * p.p_cached + e.cache_w_unsplit * coalesce(p.p_write, p.p_input) + e.output_tokens * p.p_output) * 1e-6 end usd,
  case when e.is_external then false when p.prefix is null then false when p.split_family then p.price_approx or e.cache_w_unsplit > 0
    else p.price_approx or (e.cache_w_unsplit > 0 and p.p_write is null) end is_approx
from ruled e left join {found}"""


@relation
def price_join(d):
    return "select dedup_key, account_id, provider, model, prefix, is_external, is_unpriced from priced"


@relation
def event_cost(d):
    return "select dedup_key, round(cast(usd as double), 9) usd, is_approx, total_tokens from priced"


@relation
def api_equiv(d):
    return f"""
select {K}, {dollars('usd')} full_usd, {dollars('case when is_approx then usd end')} approx_usd,
  count(*) n_events from priced where ts >= {d.t0} and ts < {d.now} group by {K}"""


@relation
def unpriced_models(d):
    return f"select {K}, model, cast(sum(total_tokens) as bigint) tokens from priced where is_unpriced group by {K}, model"


@relation
def external_models(d):
    return f"select {K}, model, cast(sum(total_tokens) as bigint) tokens from priced where is_external group by {K}, model"


@relation
def weekly(d):
    """Monday weeks in UTC: day 4 after the epoch was a Monday."""
    return f"""
select {K}, ts - (ts - 345600) % 604800 week_start, {dollars('usd')} usd, bool_or(is_approx) approx from priced where usd is not null group by {K}, ts - (ts - 345600) % 604800"""


@relation
def weekly_usd(d):
    return f"select {K}, week_start, usd, approx from weekly"


@relation
def usage_between(d):
    """Usage of the period asked for."""
    return f"select {K}, ts, model, input_tokens, output_tokens, dedup_key from usage_events where ts >= {d.t0} and ts < {d.now}"


@relation
def snapshots_between(d):
    """Snapshots of the period asked for."""
    return f"select {K}, window_id, ts, used_percent from snapshots where ts >= {d.t0} and ts < {d.now}"


@relation
def bounds(d):
    return f"""
select {K}, kind, lo, hi, n from (select {K}, 'usage' kind, min(ts) lo, max(ts) hi, count(*) n from usage_events group by {K}
union all select {K}, 'snapshots', min(ts), max(ts), count(*) from snapshots group by {K}) x"""


@relation
def window_ids(d):
    return f"select distinct {K}, window_id from snapshots"


def _bad(d, *rates: str) -> str:
    """Not a number from 0 up: negative, infinite or NaN (which both dialects sort above infinity)."""
    return " or ".join(f"not ({r} >= 0 and {r} < {d.inf()})" for r in rates)


@relation
def price_problems(d):
    """What must fail a load: empty prefix, empty era, bad rate, overlapping eras of one prefix, bad or repeated plan."""
    needed = " or ".join(f"{r} is null" for r in ("p_input", "p_cached", "p_output"))
    return f"""
select 'price' kind, provider, prefix id, case when prefix = '' then 'empty prefix' when from_ts >= until_ts then 'empty era' else 'bad rate' end problem from prices
where prefix = '' or from_ts >= until_ts or {needed} or {_bad(d, 'p_input', 'p_cached', 'p_output', 'coalesce(p_5m, 0)', 'coalesce(p_1h, 0)', 'coalesce(p_write, 0)')}
union all select 'price', provider, prefix, 'overlapping eras' from (
  select provider, prefix, from_ts, max(until_ts) over (partition by provider, prefix order by from_ts, until_ts rows between unbounded preceding and 1 preceding) before from prices) x where before > from_ts
union all select 'plan', provider, plan_id, 'repeated plan' from plans group by provider, plan_id having count(*) > 1
union all select 'plan', provider, plan_id, 'bad price' from plans where monthly_usd is null or {_bad(d, 'monthly_usd')}"""


@relation
def dq_prices(d):
    """Each prefix with the events that it prices and what is wrong with it; problem is null where all is well."""
    return f"""
select p.provider, p.prefix, q.problem, coalesce(e.n, 0) n_events, coalesce(e.usd, cast(0 as double)) usd from (select distinct provider, prefix from prices) p
left join (select provider, id, min(problem) problem from price_problems where kind = 'price' group by provider, id) q on q.provider = p.provider and q.id = p.prefix
left join (select provider, prefix, count(*) n, {dollars('usd')} usd from priced group by provider, prefix) e on e.provider = p.provider and e.prefix = p.prefix"""
