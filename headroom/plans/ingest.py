"""Log ingestion: transcripts, rollouts with cumulative counters, spools and polls, from raw lines to events and snapshots.

`transcript_lines`, `rollout_lines`, `spool_lines` and `poll_payloads` are the raw inputs;
users bind their own (`sources.logs` reads files, `sources.refresh` keeps them up to date).
Here they are laid out from `usage_events` in the formats of the logs, with copies in
second files, resets, and broken, synthetic, empty and negative lines among them. Every
line is parsed once.
"""

from __future__ import annotations

import re

from .relations import relation
from .tables import HOUR

TOKENS = "input_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint, output_tokens: bigint, cache_creation: struct<ephemeral_5m_input_tokens: bigint, ephemeral_1h_input_tokens: bigint>"
TRANSCRIPT = f"type: string, timestamp: string, sessionId: string, requestId: string, message: struct<id: string, model: string, usage: struct<{TOKENS}>>"
LIMIT = "struct<used_percent: double, window_minutes: bigint, resets_at: bigint>"
TOTAL = "struct<input_tokens: bigint, cached_input_tokens: bigint, cache_write_input_tokens: bigint, output_tokens: bigint>"
ROLLOUT = f"type: string, timestamp: string, model: string, payload: struct<type: string, model: string, info: struct<total_token_usage: {TOTAL}>, rate_limits: struct<plan_type: string, primary: {LIMIT}, secondary: {LIMIT}>>"
USED = "struct<used_percentage: double, utilization: double, resets_at: bigint>"
SPOOL = f"ts: bigint, rate_limits: struct<weekly: {USED}, short: {USED}>"
PERIOD = "struct<used_percent: double, limit_window_seconds: bigint, reset_at: bigint>"
NAMED = "struct<utilization: double, resets_at: variant>"
POLL = f"plan_type: string, rate_limit: struct<primary_window: {PERIOD}, secondary_window: {PERIOD}>, weekly: {NAMED}, short: {NAMED}"
RESTART = 40  # counters start anew every so many rows
BASELINE = 500_000


def opened(fields: str) -> str:
    """Spark's form of all fields of a parsed line at once: a call a field makes a method too large for the JVM to compile. What does not fit its type is null, as is an object that is none."""
    return f"try_variant_get(v, '$', 'struct<{fields}>')"


def held(lines: str) -> str:
    """Spark's form of the substring tests: LIKE inside OR is a regular expression."""
    return re.sub(r"line like '%(.*?)%'", r"contains(line, '\1')", lines)


def _usage_json(d, split: str) -> str:
    t = d.text
    return f"""concat('{{"type":"assistant","timestamp":"', {d.isotext('ts')}, '","requestId":"r', {t('event_id')}, '","sessionId":"', session_id, '","message":{{"id":"m', {t('event_id')},
  '","model":"', model, '","usage":{{"input_tokens":', {t('input_tokens')}, ',"cache_read_input_tokens":', {t('cached_input_tokens')}, ',"cache_creation_input_tokens":', {t('cache_w_unsplit + cache_w_5m')}, ',"output_tokens":', {t('output_tokens')}, {split}, '}}}}}}')"""


@relation
def transcript_lines(d):
    split = f"""case when cache_w_unsplit = 0 then concat(',"cache_creation":{{"ephemeral_5m_input_tokens":', {d.text('cache_w_5m')}, ',"ephemeral_1h_input_tokens":0}}') else '' end"""
    line = _usage_json(d, split)
    if d.spark:
        made = lambda when, file, no, text: f"case when {when} then named_struct('file', {file}, 'line_no', {no}, 'line', {text}) end"
        odd = lambda n, at, text: made(f"event_id % {n} = 0", "source_file", f"{at}000000 + event_id", text)
        rows = ", ".join((
            made("true", "source_file", "event_id", "line"), made("event_id % 7 < 4", "concat('copy-', source_file)", "event_id", "line"),
            odd(50, 1, """'{"type":"assistant","requestId":"x","message":{"id":"s","model":"<synthetic>","usage":{"input_tokens":1,"output_tokens":1}}}'"""),
            odd(60, 2, """'{"type":"assistant","requestId":"x","message":{"id":"z","model":"m-view","usage":{"input_tokens":0,"output_tokens":0}}}'"""),
            odd(70, 3, f"""concat('{{"type":"assistant","requestId":"x","message":{{"id":"n', {d.text('event_id')}, '","model":"m-view","usage":{{"input_tokens":-5,"output_tokens":1}}}}}}')"""),
            odd(80, 4, """'{"type":"assistant","message":{"usage":{"inp'"""), odd(90, 5, """'{"type":"user","message":{"id":"u"}}'"""),
        ))
        return f"""
select account_id, l.file, l.line_no, l.line from (select account_id, explode(array({rows})) l from (
  select /*+ REPARTITION(event_id) */ account_id, source_file, event_id, {line} line from usage_events where provider = 'beta') x) y where l is not null"""
    return f"""
select account_id, source_file file, event_id line_no, {line} line from usage_events where provider = 'beta'
union all select account_id, concat('copy-', source_file), event_id, {line} from usage_events where provider = 'beta' and event_id % 7 < 4
union all select account_id, source_file, 1000000 + event_id, '{{"type":"assistant","requestId":"x","message":{{"id":"s","model":"<synthetic>","usage":{{"input_tokens":1,"output_tokens":1}}}}}}' from usage_events where provider = 'beta' and event_id % 50 = 0
union all select account_id, source_file, 2000000 + event_id, '{{"type":"assistant","requestId":"x","message":{{"id":"z","model":"m-view","usage":{{"input_tokens":0,"output_tokens":0}}}}}}' from usage_events where provider = 'beta' and event_id % 60 = 0
union all select account_id, source_file, 3000000 + event_id, concat('{{"type":"assistant","requestId":"x","message":{{"id":"n', {d.text('event_id')}, '","model":"m-view","usage":{{"input_tokens":-5,"output_tokens":1}}}}}}') from usage_events where provider = 'beta' and event_id % 70 = 0
union all select account_id, source_file, 4000000 + event_id, '{{"type":"assistant","message":{{"usage":{{"inp' from usage_events where provider = 'beta' and event_id % 80 = 0
union all select account_id, source_file, 5000000 + event_id, '{{"type":"user","message":{{"id":"u"}}}}' from usage_events where provider = 'beta' and event_id % 90 = 0"""


@relation
def ingest_lines(d):
    """Parsed transcript lines with the reason why one is not an event. Cheap substring tests stand before the parse."""
    n = lambda p: f"coalesce({d.got('v', '$.message.usage.' + p, 'bigint')}, 0)"
    text = lambda p: d.got("v", "$." + p, "string")
    lines = f"""(select account_id, file, line_no, {d.parsed('line')} v from transcript_lines where line like '%"assistant"%' and line like '%"usage"%')"""
    if d.spark:
        n, text = (lambda p: f"coalesce(r.message.usage.{p}, 0)"), (lambda p: f"r.{p}")
        usage, creation = "r.message.usage is not null", "r.message.usage.cache_creation is not null"
        lines = f"(select *, {opened(TRANSCRIPT)} r from {held(lines)} p)"
    else:
        usage, creation = d.object("v", "$.message.usage"), d.object("v", "$.message.usage.cache_creation")
    return f"""
select account_id, file, line_no, ok, kind, model, ts, session_id, input_tokens, cached_input_tokens, cache_w_5m, cache_w_1h, cache_w_unsplit, output_tokens, dedup_key,
  case when not ok then 'unparseable' when kind is null or kind <> 'assistant' or not has_usage then 'other' when model = '<synthetic>' then 'synthetic'
    when least(input_tokens, cached_input_tokens, cache_w_5m, cache_w_1h, cache_w_unsplit, output_tokens) < 0 then 'negative'
    when input_tokens + cached_input_tokens + cache_w_5m + cache_w_1h + cache_w_unsplit + output_tokens = 0 then 'empty' when ts is null then 'no_time' end reason
from (select account_id, file, line_no, v is not null ok, {text('type')} kind, coalesce({text('message.model')}, 'UNKNOWN') model, {d.iso(text('timestamp'))} ts, {text('sessionId')} session_id, {usage} has_usage,
  {n('input_tokens')} input_tokens, {n('cache_read_input_tokens')} cached_input_tokens, {n('cache_creation.ephemeral_5m_input_tokens')} cache_w_5m, {n('cache_creation.ephemeral_1h_input_tokens')} cache_w_1h,
  case when {creation} then 0 else {n('cache_creation_input_tokens')} end cache_w_unsplit, {n('output_tokens')} output_tokens,
  case when {text('message.id')} is not null and {text('requestId')} is not null then concat({text('message.id')}, ':', {text('requestId')}) else concat(file, ':', {d.text('line_no')}) end dedup_key
from {lines} w) x"""


@relation
def dedup_events(d):
    """First occurrence of each key, by file and line."""
    return f"""
select account_id, dedup_key, file, line_no from (select *, row_number() over (partition by account_id, dedup_key order by file, line_no) pick from ingest_lines where reason is null) x where pick = 1"""


@relation
def scan_transcripts(d):
    return """
select account_id, dedup_key, ts, model, input_tokens, cached_input_tokens, cache_w_5m, cache_w_1h, cache_w_unsplit, output_tokens, session_id from (
  select *, row_number() over (partition by account_id, dedup_key order by file, line_no) pick from ingest_lines where reason is null) x where pick = 1"""


@relation
def usage_filters(d):
    return "select account_id, reason, count(*) n from ingest_lines where reason in ('synthetic', 'empty') group by account_id, reason"


@relation
def quarantine(d):
    return "select account_id, file, line_no, reason from ingest_lines where reason in ('unparseable', 'negative', 'no_time')"


@relation
def scan_summary(d):
    """What a scan saw and lost, by source and account."""
    zero = "cast(0 as bigint)"
    total = lambda cond: f"cast(sum(case when {cond} then 1 else 0 end) as bigint)"
    return f"""
select 'transcripts' source, account_id, count(distinct file) files, count(*) n_lines, {total("reason in ('unparseable', 'negative', 'no_time')")} parse_errors,
  count(distinct case when reason is null then dedup_key end) events, {zero} snapshots, {zero} warnings from ingest_lines group by account_id
union all select 'rollouts', r.account_id, r.files, r.n_lines, r.bad_lines + coalesce(b.n, 0), coalesce(e.n, 0), coalesce(s.n, 0), coalesce(w.n, 0) from (
  select account_id, count(distinct file) files, count(*) n_lines, {total("v_type is null or (v_type = 'event_msg' and p_type = 'token_count' and ts is null)")} bad_lines from rollout_parsed group by account_id) r
left join (select account_id, count(*) n from rollout_points where not valid group by account_id) b on b.account_id = r.account_id
left join (select account_id, count(*) n from scan_rollout_usage group by account_id) e on e.account_id = r.account_id
left join (select account_id, count(*) n from scan_rollout_snapshots group by account_id) s on s.account_id = r.account_id
left join (select account_id, count(*) n from counter_warnings group by account_id) w on w.account_id = r.account_id
union all select 'spool', l.account_id, {zero}, l.n, l.n - coalesce(g.n, 0), {zero}, coalesce(p.points, 0), {zero} from (select account_id, count(*) n from spool_lines group by account_id) l
left join (select account_id, count(distinct concat(file, ':', {d.text('line_no')})) n from spool_points group by account_id) g on g.account_id = l.account_id
left join (select account_id, count(*) points from scan_spool group by account_id) p on p.account_id = l.account_id
union all select 'polls', l.account_id, {zero}, l.n, l.n - coalesce(g.n, 0), {zero}, coalesce(p.points, 0), {zero} from (select account_id, count(*) n from poll_payloads group by account_id) l
left join (select account_id, count(distinct payload_id) n from poll_points group by account_id) g on g.account_id = l.account_id
left join (select account_id, count(*) points from scan_polls group by account_id) p on p.account_id = l.account_id"""


@relation
def dq_parse_loss(d):
    return "select 'parse_loss' name, case when sum(parse_errors) > 0 then 'warn' else 'ok' end status, cast(sum(parse_errors) as bigint) parse_errors from scan_summary"


@relation
def source_inventory(d):
    """Every source that a scan expects: files, lines and the age of its oldest record in days; one without lines fails."""
    age = lambda ts: d.div(f"{d.now} - min({ts})", "86400")
    return f"""
select n.source, coalesce(s.files, 0) files, coalesce(s.n_lines, 0) n_lines, a.oldest_days, case when coalesce(s.n_lines, 0) = 0 then 'fail' else 'ok' end status
from (select 'transcripts' source union all select 'rollouts' union all select 'spool' union all select 'polls') n
left join (select source, cast(sum(files) as bigint) files, cast(sum(n_lines) as bigint) n_lines from scan_summary group by source) s on s.source = n.source
left join (select 'transcripts' source, {age('ts')} oldest_days from ingest_lines union all select 'rollouts', {age('ts')} from rollout_parsed
  union all select 'spool', {age('ts')} from spool_lines union all select 'polls', {age('ts')} from poll_payloads) a on a.source = n.source"""


@relation
def retracted(d):
    """Files to withdraw."""
    return "select distinct account_id, file from ingest_lines where file like 'copy-f1%'"


@relation
def retract_source(d):
    """`retracted` files' rows withdrawn from the raw table: the next copy of each key takes their place."""
    return """
select account_id, dedup_key, file from (select n.account_id, n.dedup_key, n.file, row_number() over (partition by n.account_id, n.dedup_key order by n.file, n.line_no) pick
from ingest_lines n left join retracted r on r.account_id = n.account_id and r.file = n.file where n.reason is null and r.file is null) x where pick = 1"""


@relation
def existing_keys(d):
    """Event keys that the store holds already."""
    return "select distinct account_id, dedup_key from ingest_lines where reason is null and line_no % 3 = 0"


@relation
def insert_ignore(d):
    """New event keys only, each once: nothing when ingested twice."""
    return """
select n.account_id, n.dedup_key, min(n.file) file from ingest_lines n left join existing_keys o
on o.account_id = n.account_id and o.dedup_key = n.dedup_key where n.reason is null and o.dedup_key is null group by n.account_id, n.dedup_key"""


@relation
def existing_snapshots(d):
    """Keys of snapshots that the store holds already."""
    once = "" if d.spark else "distinct "  # a key that is held twice is held
    return f"select {once}account_id, source, window_id, ts from union_sources where ts % 2 = 0"


@relation
def insert_ignore_snapshots(d):
    """New snapshots only, the first of each account, source, window and second by percent. Spark groups both tables at once instead of joining and then grouping; a key with a null equals none."""
    if d.spark:
        keys = "account_id, source, window_id, ts"
        return f"""
select {keys}, used_percent from (select {keys}, min(used_percent) used_percent, max(seen) seen, max(held) held from (
  select {keys}, used_percent, 1 seen, 0 held from union_sources
  union all select {keys}, cast(null as double), 0, 1 from existing_snapshots where account_id is not null and source is not null and window_id is not null and ts is not null) x
  group by {keys}) y where seen = 1 and held = 0"""
    return """
select n.account_id, n.source, n.window_id, n.ts, min(n.used_percent) used_percent from union_sources n left join existing_snapshots o
on o.account_id = n.account_id and o.source = n.source and o.window_id = n.window_id and o.ts = n.ts where o.ts is null group by n.account_id, n.source, n.window_id, n.ts"""


@relation
def counter_source(d):
    """Running totals per session file, from which the rollout lines are laid out; raw input counts cached tokens too, and cache writes start anew by themselves now and then."""
    k = f"cast({d.json_('props', '$.k')} as bigint) * 10"
    return f"""
select account_id, file, line_no, ts, model, cast(sum(inp + cached) over w as bigint) c_input, cast(sum(cached) over w as bigint) c_cached, cast(sum(wr) over (partition by account_id, file, epoch, sheet order by line_no rows unbounded preceding) as bigint) c_write, cast(sum(outp) over w as bigint) c_output
from (select u.account_id, concat('rollout-', u.session_id, '.jsonl') file, cast(row_number() over (partition by u.account_id, u.session_id order by u.ts, u.event_id) as bigint) line_no, u.ts, u.model,
    u.cents inp, {k} cached, u.cache_w_unsplit wr, u.cents outp,
    {d.div('row_number() over (partition by u.account_id, u.session_id order by u.ts, u.event_id) - 1', str(RESTART))} epoch,
    {d.div('row_number() over (partition by u.account_id, u.session_id order by u.ts, u.event_id) - 1', '15')} sheet
  from usage_events u join events e on e.event_id = u.event_id where u.provider = 'alpha') x window w as (partition by account_id, file, epoch order by line_no rows unbounded preceding)"""


@relation
def rollout_lines(d):
    """A session line, a turn line before some counters, counters with limits, and lines that are broken, of other kinds or without a time."""
    t = d.text
    start = "select account_id, file, line_no * 10"
    limits = lambda name, w: (
        f"""'"{name}":{{"used_percent":', case when c.line_no % 71 = 0 then '-3' else coalesce({t(f'{w}.used_percent')}, 'null') end, ',"window_minutes":', case when c.line_no % 89 = 0 then '0' else coalesce({t(f'{w}.window_minutes')}, 'null') end, ',"resets_at":', coalesce({t(f'{w}.resets_at')}, 'null'), '}}'"""
    )
    point = lambda w: f"left join (select account_id, ts, max(used_percent) used_percent, max(window_minutes) window_minutes, max(resets_at) resets_at, max(plan_type) plan_type from snapshots where window_id = '{w}' group by account_id, ts)"
    if d.spark:
        # the lines of a counter are laid out at once: of a union, the tests of the lines would be moved below it, and each test would lay out its line anew
        made = lambda when, at, text: f"case when {when} then named_struct('line_no', c.line_no * 10 + {at}, 'line', {text}) end"
        rows = ", ".join((
            made("c.line_no = 2", 1, """'{"type":"session_meta","payload":{"id":"s","model":"m-session"}}'"""),
            made("c.line_no % 5 = 3", 2, """concat('{"type":"turn_context","payload":{"model":"', c.model, '"}}')"""),
            made("c.line_no % 40 = 7", 3, """'{"type":"event_msg","payload":{"type":"token_count","info":{"total_token'"""),
            made("c.line_no % 40 = 9", 4, """'{"type":"event_msg","payload":{"type":"token_count","info":{"total_token_usage":{"input_tokens":9}}}}'"""),
            made("c.line_no % 40 = 11", 6, """'{"type":"event_msg","payload":{"type":"agent_message"}}'"""),
            made("c.line_no % 40 = 13", 7, """'{"type":"response_item","payload":{"text":"no session_meta here"}}'"""),
            made("true", 5, f"""concat('{{"timestamp":"', {d.isotext('c.ts')}, '","type":"event_msg","payload":{{"type":"token_count","info":{{"total_token_usage":{{"input_tokens":', {t('c.c_input')}, ',"cached_input_tokens":', {t('c.c_cached')},
    ',"cache_write_input_tokens":', {t('c.c_write')}, ',"output_tokens":', {t('c.c_output')}, '}}}},"rate_limits":{{"plan_type":"', coalesce(p.plan_type, 'basic'), '",', {limits('primary', 'p')}, ',', {limits('secondary', 's')}, '}}}}}}')"""),
        ))
        return f"""
select account_id, file, l.line_no, l.line from (select c.account_id, c.file, explode(array({rows})) l
  from counter_source c {point('weekly')} p on p.account_id = c.account_id and p.ts = c.ts {point('short')} s on s.account_id = c.account_id and s.ts = c.ts) x where l is not null"""
    return f"""
{start} + 1 line_no, '{{"type":"session_meta","payload":{{"id":"s","model":"m-session"}}}}' line from counter_source where line_no = 2
union all {start} + 2, concat('{{"type":"turn_context","payload":{{"model":"', model, '"}}}}') from counter_source where line_no % 5 = 3
union all {start} + 3, '{{"type":"event_msg","payload":{{"type":"token_count","info":{{"total_token' from counter_source where line_no % 40 = 7
union all {start} + 4, '{{"type":"event_msg","payload":{{"type":"token_count","info":{{"total_token_usage":{{"input_tokens":9}}}}}}}}' from counter_source where line_no % 40 = 9
union all {start} + 6, '{{"type":"event_msg","payload":{{"type":"agent_message"}}}}' from counter_source where line_no % 40 = 11
union all {start} + 7, '{{"type":"response_item","payload":{{"text":"no session_meta here"}}}}' from counter_source where line_no % 40 = 13
union all select c.account_id, c.file, c.line_no * 10 + 5, concat('{{"timestamp":"', {d.isotext('c.ts')}, '","type":"event_msg","payload":{{"type":"token_count","info":{{"total_token_usage":{{"input_tokens":', {t('c.c_input')}, ',"cached_input_tokens":', {t('c.c_cached')},
  ',"cache_write_input_tokens":', {t('c.c_write')}, ',"output_tokens":', {t('c.c_output')}, '}}}},"rate_limits":{{"plan_type":"', coalesce(p.plan_type, 'basic'), '",', {limits('primary', 'p')}, ',', {limits('secondary', 's')}, '}}}}}}')
from counter_source c {point('weekly')} p on p.account_id = c.account_id and p.ts = c.ts {point('short')} s on s.account_id = c.account_id and s.ts = c.ts"""


@relation
def rollout_parsed(d):
    """Rollout lines of the three kinds that matter, parsed once; v_type is null where a line does not parse."""
    g = lambda p, kind: d.got("v", "$." + p, kind)
    total = "payload.info.total_token_usage"
    lines = f"""(select account_id, file, line_no, {d.parsed('line')} v from rollout_lines where line like '%"turn_context"%' or line like '%"token_count"%' or line like '%"session_meta"%')"""
    has_total = d.object("v", "$." + total)
    if d.spark:
        g, has_total, lines = (lambda p, kind: f"r.{p}"), f"r.{total} is not null", f"(select *, {opened(ROLLOUT)} r from {held(lines)} p)"
    window = lambda w: f"{g(f'payload.rate_limits.{w}.used_percent', 'double')} {w}_percent, {g(f'payload.rate_limits.{w}.window_minutes', 'bigint')} {w}_minutes, {g(f'payload.rate_limits.{w}.resets_at', 'bigint')} {w}_resets"
    return f"""
select account_id, file, line_no, case when v is not null then coalesce({g('type', 'string')}, '') end v_type, {g('payload.type', 'string')} p_type, {d.iso(g('timestamp', 'string'))} ts, coalesce({g('payload.model', 'string')}, {g('model', 'string')}) named,
  {has_total} has_total, coalesce({g(total + '.input_tokens', 'bigint')}, 0) c_input, coalesce({g(total + '.cached_input_tokens', 'bigint')}, 0) c_cached, coalesce({g(total + '.cache_write_input_tokens', 'bigint')}, 0) c_write,
  coalesce({g(total + '.output_tokens', 'bigint')}, 0) c_output, {g('payload.rate_limits.plan_type', 'string')} plan_type, {window('primary')}, {window('secondary')}
from {lines} x"""


@relation
def rollout_models(d):
    """Each line with the model in force: the last turn's so far; before any turn the first session's, else UNKNOWN."""
    frame = "over (partition by account_id, file order by line_no rows between unbounded preceding and current row)"
    return f"""
select *, coalesce({d.last("case when v_type = 'turn_context' then named end")} {frame}, {d.first("case when v_type = 'session_meta' then named end")} {frame}, 'UNKNOWN') model from rollout_parsed"""


@relation
def carry_model(d):
    return "select account_id, file, line_no, model from rollout_models where v_type = 'event_msg'"


@relation
def counter_rows(d):
    """Cumulative counters: token counts with a time and a total, the model carried along."""
    return "select account_id, file, line_no, ts, model, c_input, c_cached, c_write, c_output from rollout_models where v_type = 'event_msg' and p_type = 'token_count' and ts is not null and has_total"


@relation
def rollout_points(d):
    """Both limits of each token count that states them, and whether the percent is a finite number from 0 up; a window without a length has none."""
    one = lambda w: f"select account_id, file, line_no, ts, plan_type, '{w}' window_id, {w}_percent used_percent, case when {w}_minutes > 0 then {w}_minutes end window_minutes, {w}_resets resets_at from rollout_parsed where v_type = 'event_msg' and p_type = 'token_count' and ts is not null and {w}_percent is not null"
    return f"select *, used_percent >= 0 and used_percent < {d.inf()} valid from ({one('primary')} union all {one('secondary')}) x"


@relation
def counter_steps(d):
    """Each counter row beside the one before it in its file, and how they relate."""
    return f"""
select *, case when p is null then case when c_input + c_write + c_output > {BASELINE} then 'inherited' else 'first' end when c_input >= p_input and c_cached >= p_cached and c_write >= p_write and c_output >= p_output then 'growth'
  when c_input < p_input then 'restart' else 'partial' end step
from (select *, lag(line_no) over w p, lag(c_input) over w p_input, lag(c_cached) over w p_cached, lag(c_write) over w p_write, lag(c_output) over w p_output
  from counter_rows window w as (partition by account_id, file order by line_no)) x"""


@relation
def counter_warnings(d):
    """Baselines taken over from another session, and counters of which only some went back."""
    return "select account_id, file, line_no, step from counter_steps where step in ('inherited', 'partial')"


@relation
def counter_diff(d):
    """Counters to events: a first row and a restart count whole, growth by its difference, a partial regression clamped at zero, an inherited baseline not at all."""
    grow = lambda c: f"case step when 'inherited' then 0 when 'first' then c_{c} when 'restart' then c_{c} else greatest(0, c_{c} - p_{c}) end d_{c}"
    return f"""
select account_id, file, line_no, ts, model, greatest(0, d_input - d_cached) input_tokens, greatest(0, d_cached) cached_input_tokens, greatest(0, d_write) cache_w_unsplit, greatest(0, d_output) output_tokens
from (select *, {grow('input')}, {grow('cached')}, {grow('write')}, {grow('output')} from counter_steps) x where d_input <> 0 or d_cached <> 0 or d_write <> 0 or d_output <> 0"""


@relation
def scan_rollout_usage(d):
    return f"select account_id, file, line_no, concat(file, ':', {d.text('line_no')}) dedup_key, ts, model, input_tokens, cached_input_tokens, cache_w_unsplit, output_tokens from counter_diff"


@relation
def active_copy(d):
    """An active file beats an archived one of the same name."""
    return """
select account_id, base, path, is_archive from (select *, row_number() over (partition by account_id, base order by is_archive, path) pick from (
  select distinct account_id, file base, concat('active/', file) path, false is_archive from counter_rows where line_no % 2 = 0
  union all select distinct account_id, file, concat('archive/', file), true from counter_rows) x) y where pick = 1"""


def _points(d, provider: str) -> str:
    return f"select account_id, provider, window_id, window_minutes, used_percent, resets_at, ts, plan_type from snapshots where provider = '{provider}' and window_id <> 'weekly_scoped'"


@relation
def spool_lines(d):
    """One limit a line, by percent or by the older name; some with a percent that is none, some lines written twice."""
    name = "case when ts % 11 = 0 then 'utilization' else 'used_percentage' end"
    if d.spark:
        # numbered by hours: no task sorts an account
        twice = f"(select * from ({_points(d, 'beta')}) s join (select 0 again union all select 1) twice on again = 0 or ts % 13 = 0)"
        return f"""
select p.account_id, 'spool.jsonl' file, cast(2 * (coalesce(b.ahead, 0) + p.place) + p.again as bigint) line_no, p.ts,
  concat('{{"ts":', {d.text('p.ts')}, ',"rate_limits":{{"', p.window_id, '":{{"', {name.replace('ts', 'p.ts')}, '":', case when p.ts % 83 = 0 then '-1' else {d.text('cast(p.used_percent as bigint)')} end, ',"resets_at":', coalesce({d.text('p.resets_at')}, 'null'), '}}}}}}') line
from (select account_id, ts, window_id, used_percent, resets_at, again, {HOUR} hour, row_number() over (partition by account_id, {HOUR} order by ts, window_id, again) place from {twice} t) p
join (select account_id, hour, sum(n) over (partition by account_id order by hour rows between unbounded preceding and 1 preceding) ahead from (
  select account_id, {HOUR} hour, count(*) n from {twice} t group by account_id, {HOUR}) x) b on b.account_id = p.account_id and b.hour = p.hour"""
    return f"""
select account_id, 'spool.jsonl' file, cast(2 * row_number() over (partition by account_id order by ts, window_id) + again as bigint) line_no, ts, line
from (select account_id, ts, window_id, concat('{{"ts":', {d.text('ts')}, ',"rate_limits":{{"', window_id, '":{{"', {name}, '":', case when ts % 83 = 0 then '-1' else {d.text('cast(used_percent as bigint)')} end, ',"resets_at":', coalesce({d.text('resets_at')}, 'null'), '}}}}}}') line
from ({_points(d, 'beta')}) p) x join (select 0 again union all select 1) twice on again = 0 or ts % 13 = 0"""


@relation
def spool_points(d):
    """One snapshot per window of a line; the window's length comes from a small dimension."""
    if d.spark:
        row = lambda w, minutes: f"named_struct('window_id', '{w}', 'window_minutes', cast({minutes} as bigint), 'used_percent', coalesce(r.rate_limits.{w}.used_percentage, r.rate_limits.{w}.utilization), 'resets_at', r.rate_limits.{w}.resets_at)"
        return f"""
select account_id, file, line_no, ts, p.window_id, p.window_minutes, p.used_percent, p.resets_at
from (select account_id, file, line_no, ts, explode(array({row('weekly', 10080)}, {row('short', 300)})) p from spool_parsed where ts is not null) x where p.used_percent >= 0 and p.used_percent < {d.inf()}"""
    g = lambda w, p, kind: d.got("v", f"$.rate_limits.{w}.{p}", kind)
    one = lambda w, minutes: f"""
  select account_id, file, line_no, ts, '{w}' window_id, cast({minutes} as bigint) window_minutes, coalesce({g(w, 'used_percentage', 'double')}, {g(w, 'utilization', 'double')}) used_percent, {g(w, 'resets_at', 'bigint')} resets_at from spool_parsed"""  # noqa: E731
    return f"select * from ({one('weekly', 10080)} union all {one('short', 300)}) x where used_percent >= 0 and used_percent < {d.inf()} and ts is not null"


@relation
def spool_parsed(d):
    if d.spark:
        return f"select account_id, file, line_no, r.ts, r from (select account_id, file, line_no, {opened(SPOOL)} r from (select account_id, file, line_no, {d.parsed('line')} v from spool_lines) p) x"
    return f"select account_id, file, line_no, {d.got('v', '$.ts', 'bigint')} ts, v from (select account_id, file, line_no, {d.parsed('line')} v from spool_lines) x"


@relation
def scan_spool(d):
    """The first line of each window and second, by file and line."""
    return """
select account_id, window_id, window_minutes, used_percent, resets_at, ts from (
  select *, row_number() over (partition by account_id, window_id, ts order by file, line_no) pick from spool_points) x where pick = 1"""


@relation
def poll_payloads(d):
    """Landed responses of two shapes, each with an id of its own: lengths inside the payload, or windows by name with a reset as a number or as a time; some with an invalid percent, some of those in the second of a valid one."""
    most = lambda w, x: f"max(case when window_id = '{w}' then {x} end)"
    part = lambda w, name: f"""concat('"{name}":{{"used_percent":', {d.text(f"cast({most(w, 'used_percent')} as bigint)")}, ',"limit_window_seconds":', coalesce({d.text(most(w, 'window_minutes') + ' * 60')}, 'null'), ',"reset_at":', coalesce({d.text(most(w, 'resets_at'))}, 'null'), '}}')"""
    other = lambda w: f"""concat('"{w}":{{"utilization":', case when ts % 101 = 0 then '-1' else {d.text(f"cast({most(w, 'used_percent')} as bigint)")} end, ',"resets_at":', case when ts % 2 = 0 then {d.text(most(w, 'resets_at'))} else concat('"', {d.isotext(most(w, 'resets_at'))}, '"') end, '}}')"""
    good = f"""
select account_id, ts, concat('{{"plan_type":"', max(coalesce(plan_type, 'basic')), '","rate_limit":{{', {part('weekly', 'primary_window')}, ',', case when ts % 97 = 0 then '"secondary_window":{{"used_percent":-1,"limit_window_seconds":18000,"reset_at":1}}' else {part('short', 'secondary_window')} end, '}}}}') body
from ({_points(d, 'alpha')}) p group by account_id, ts
union all select account_id, ts, concat('{{', {other('weekly')}, ',', {other('short')}, '}}') from ({_points(d, 'beta')}) q group by account_id, ts"""
    return f"""
select account_id, concat('p', {d.text('ts')}) payload_id, ts, body from ({good}) g
union all select account_id, concat('q', {d.text('ts')}), ts, '{{"weekly":{{"utilization":-1}},"short":{{"utilization":3}}}}' from ({_points(d, 'beta')}) r where ts % 19 = 0 group by account_id, ts"""


@relation
def poll_points(d):
    """All windows of a payload; one invalid percent, or none at all, rejects the whole payload, and no other one of the same second."""
    g = lambda p, kind: d.got("v", "$." + p, kind)
    if d.spark:
        row = lambda plan, w, percent, minutes, resets: f"named_struct('plan_type', {plan}, 'window_id', '{w}', 'used_percent', {percent}, 'window_minutes', {minutes}, 'resets_at', {resets})"
        one = lambda name, w: row("r.plan_type", w, f"r.rate_limit.{name}.used_percent", d.div(f"r.rate_limit.{name}.limit_window_seconds", "60"), f"r.rate_limit.{name}.reset_at")
        reset = lambda w: f"coalesce({d.got(f'r.{w}.resets_at', '$', 'bigint')}, {d.iso(d.got(f'r.{w}.resets_at', '$', 'string'))})"
        other = lambda w, minutes: row("cast(null as string)", w, f"r.{w}.utilization", f"cast({minutes} as bigint)", reset(w))
        return f"""
select account_id, payload_id, p.window_id, p.used_percent, case when p.window_minutes > 0 then p.window_minutes end window_minutes, p.resets_at, ts, p.plan_type from (
  select account_id, payload_id, ts, p, max(case when p.used_percent >= 0 and p.used_percent < {d.inf()} then 0 else 1 end) over (partition by account_id, payload_id) bad from (
    select account_id, payload_id, ts, explode(filter(array({one('primary_window', 'primary')}, {one('secondary_window', 'secondary')}, {other('weekly', 10080)}, {other('short', 300)}), p -> p.used_percent is not null)) p from poll_parsed) x) y where bad = 0"""
    a = lambda name, w: f"select account_id, payload_id, ts, {g('plan_type', 'string')} plan_type, '{w}' window_id, {g(f'rate_limit.{name}.used_percent', 'double')} used_percent, {d.div(g(f'rate_limit.{name}.limit_window_seconds', 'bigint'), '60')} window_minutes, {g(f'rate_limit.{name}.reset_at', 'bigint')} resets_at from poll_parsed"
    b = lambda w, minutes: f"select account_id, payload_id, ts, cast(null as string), '{w}', {g(f'{w}.utilization', 'double')}, cast({minutes} as bigint), coalesce({g(f'{w}.resets_at', 'bigint')}, {d.iso(g(f'{w}.resets_at', 'string'))}) from poll_parsed"
    return f"""
select account_id, payload_id, window_id, used_percent, case when window_minutes > 0 then window_minutes end window_minutes, resets_at, ts, plan_type from (
  select *, max(case when used_percent >= 0 and used_percent < {d.inf()} then 0 else 1 end) over (partition by account_id, payload_id) bad
  from ({a('primary_window', 'primary')} union all {a('secondary_window', 'secondary')} union all {b('weekly', 10080)} union all {b('short', 300)}) x where used_percent is not null) y where bad = 0"""


@relation
def scan_polls(d):
    """The first accepted payload of each window and second, by its id."""
    return """
select account_id, window_id, used_percent, window_minutes, resets_at, ts, plan_type from (
  select *, row_number() over (partition by account_id, window_id, ts order by payload_id) pick from poll_points) x where pick = 1"""


@relation
def poll_parsed(d):
    if d.spark:
        return f"select account_id, payload_id, ts, {opened(POLL)} r from (select account_id, payload_id, ts, {d.parsed('body')} v from poll_payloads) x"
    return f"select account_id, payload_id, ts, {d.parsed('body')} v from poll_payloads"


@relation
def scan_rollout_snapshots(d):
    return "select account_id, window_id, window_minutes, used_percent, resets_at, ts, plan_type from rollout_points where valid"


@relation
def union_sources(d):
    """All snapshot sources as one table, with what each lacks as null."""
    return """
select 'rollout' source, account_id, window_id, used_percent, resets_at, ts, plan_type from scan_rollout_snapshots
union all select 'spool', account_id, window_id, used_percent, resets_at, ts, cast(null as string) from scan_spool
union all select 'poll', account_id, window_id, used_percent, resets_at, ts, plan_type from scan_polls"""


@relation
def union_events(d):
    """All event sources as one table, with what each lacks as zero."""
    zero = "cast(0 as bigint)"
    return f"""
select 'rollout' source, account_id, dedup_key, ts, model, input_tokens, cached_input_tokens, {zero} cache_w_5m, {zero} cache_w_1h, cache_w_unsplit, output_tokens from scan_rollout_usage
union all select 'transcript', account_id, dedup_key, ts, model, input_tokens, cached_input_tokens, cache_w_5m, cache_w_1h, cache_w_unsplit, output_tokens from scan_transcripts"""


@relation
def source_crosscheck(d):
    """A poll against the newest log snapshot of its window within the day before."""
    return """
select p.account_id, p.window_id, p.ts, p.used_percent polled, max_by(r.used_percent, r.ts) logged, abs(p.used_percent - max_by(r.used_percent, r.ts)) <= 5 agrees
from (select account_id, window_id, max(ts) ts, max_by(used_percent, ts) used_percent from scan_polls group by account_id, window_id) p
join scan_rollout_snapshots r on r.account_id = p.account_id and r.window_id = p.window_id and r.ts <= p.ts and r.ts > p.ts - 86400 group by p.account_id, p.window_id, p.ts, p.used_percent"""


@relation
def manifest_delta(d):
    """Files whose newest line or length changed since the last scan (here: a scan that saw the lines before a cut)."""
    return """
select n.account_id, n.file, n.n_lines, o.n_lines seen_lines from (select account_id, file, count(*) n_lines, max(ts) newest from counter_rows group by account_id, file) n
left join (select account_id, file, count(*) n_lines, max(ts) newest from counter_rows where ts < 1706400000 group by account_id, file) o
on o.account_id = n.account_id and o.file = n.file where o.file is null or o.n_lines <> n.n_lines or o.newest <> n.newest"""
