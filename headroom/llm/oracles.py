"""DuckDB SQL for the queries that SQL can express, by their definitions: all windows, all pairs, no sketches and no graphs."""

from __future__ import annotations

from .license_texts import TEMPLATES
from .licenses import CONTAINMENT, MARKS

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Components of the table links (a, b) over the nodes of table ids (id): every node with the smallest one it reaches.
_REACH = """
arcs as (select a, b from links union select b, a from links),
reach(id, root) as (select id, id from ids union select c.b, r.root from reach r join arcs c on c.a = r.id),
component as (select id, min(root) as component_id from reach group by id)"""

OP3 = f"""
with recursive vec as (
  select vec_id, cast(embedding as double[]) v, not (embedding is null or len(embedding) = 0 or list_count(embedding) < len(embedding)
    or len(list_filter(embedding, lambda x: not isfinite(x))) > 0 or len(list_filter(embedding, lambda x: x <> 0)) = 0) usable from embeddings),
ids as (select vec_id as id from vec),
links as (select x.vec_id a, y.vec_id b from vec x join vec y on x.usable and y.usable and len(x.v) = len(y.v) and x.vec_id <> y.vec_id where list_cosine_similarity(x.v, y.v) >= 0.9),
{_REACH}
select c.id as vec_id, coalesce(l.n, 0)::bigint as n_links, c.component_id, c.id = c.component_id as kept
from component c left join (select a, count(*) n from links group by a) l on l.a = c.id
"""

OP4 = f"""
with listed as (select doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) ws from documents),
windows as (select doc_id, i, array_to_string(ws[i + 1 : i + 50], ' ') s from (select doc_id, ws, unnest(range(0, len(ws) - 49)) i from listed where len(ws) >= 50)),
gone as (select w.doc_id, w.i from windows w join (select s, min(doc_id) f from windows group by s) m on m.s = w.s where m.f < w.doc_id),
islands as (select doc_id, min(i) a, max(i) + 50 b from (select *, sum(fresh) over (partition by doc_id order by i) island
  from (select *, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end fresh from gone)) group by doc_id, island),
words as (select doc_id, unnest(ws) word, unnest(range(0, len(ws))) j from listed),
left_over as (select w.doc_id, string_agg(w.word, ' ' order by w.j) kept from words w left join islands x on x.doc_id = w.doc_id and w.j >= x.a and w.j < x.b where x.doc_id is null group by w.doc_id)
select l.doc_id, len(l.ws)::bigint as n_words, coalesce(s.n_removed, 0)::bigint as n_removed, coalesce(s.n_spans, 0)::bigint as n_spans, sha256(coalesce(k.kept, '')) as kept_sha256
from listed l left join (select doc_id, sum(b - a) n_removed, count(*) n_spans from islands group by doc_id) s on s.doc_id = l.doc_id left join left_over k on k.doc_id = l.doc_id
"""

OP5 = """
with raw as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
parts as (select doc_id, 512 * k as off, substr(h, 1024 * k + 1, 1222) part from (select doc_id, h, unnest(range(0, (len(h) // 2 - 99 + 511) // 512)) k from raw where len(h) >= 200)),
strings as (select doc_id, off + i as i, substr(part, 2 * i + 1, 200) s from (select doc_id, off, part, unnest(range(0, len(part) // 2 - 99)) i from parts)),
gone as (select w.doc_id, w.i from strings w join (select s, min(doc_id::hugeint * 4294967296 + i) f from strings group by s) m on m.s = w.s where m.f < w.doc_id::hugeint * 4294967296 + w.i),
islands as (select doc_id, min(i) a, max(i) + 100 b from (select *, sum(fresh) over (partition by doc_id order by i) island
  from (select *, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end fresh from gone)) group by doc_id, island),
cuts as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) before from islands),
pieces as (select c.doc_id, string_agg(substr(r.h, 2 * c.before + 1, 2 * (c.a - c.before)), '' order by c.a) front, max(c.b) last_b, sum(c.b - c.a) n_removed, count(*) n_spans from cuts c join raw r on r.doc_id = c.doc_id group by c.doc_id)
select r.doc_id, (len(r.h) // 2)::bigint as n_bytes, coalesce(p.n_removed, 0)::bigint as n_removed, coalesce(p.n_spans, 0)::bigint as n_spans,
  sha256(unhex(concat(coalesce(p.front, ''), substr(r.h, 2 * coalesce(p.last_b, 0) + 1)))) as kept_sha256
from raw r left join pieces p on p.doc_id = r.doc_id
"""

OP10 = f"""
with recursive listed as (select doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{WORD}'), []) ws from documents),
ids as (select doc_id as id from listed),
shingles as (select distinct doc_id, s from (
  select doc_id, array_to_string(ws[i : i + 4], ' ') s from (select doc_id, ws, unnest(range(1, len(ws) - 3)) i from listed where len(ws) >= 5)
  union all select doc_id, array_to_string(ws, ' ') from listed where len(ws) between 1 and 4)),
sizes as (select doc_id, count(*) n from shingles group by doc_id),
shared as (select x.doc_id a, y.doc_id b, count(*) m from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
links as (select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * m >= 85 * (p.n + q.n - m)),
{_REACH}
select c.id as doc_id, coalesce(z.n, 0)::bigint as n_shingles, c.component_id, c.id = c.component_id as kept from component c left join sizes z on z.doc_id = c.id
"""

#: Every item-sized window in which a shared shingle stands at its place in the item, compared as a whole.
OP9 = """
with cut as (select id, kind, list_filter(string_split(translate(lower(coalesce(text, '')), concat(chr(9), chr(10), chr(11), chr(12), chr(13)), '     '), ' '), lambda x: x <> '') ws
  from (select doc_id id, 'doc' kind, text from documents union all select item_id, 'item', text from benchmark)),
items as (select id item_id, ws, len(ws)::bigint m, least(len(ws), 5) k from cut where kind = 'item' and len(ws) > 0),
docs as (select id doc_id, ws, len(ws) n from cut where kind = 'doc'),
item_shingles as (select item_id, m, k, i - 1 pos, array_to_string(ws[i : i + k - 1], ' ') s from (select *, unnest(range(1, m - k + 2)) i from items)),
lengths as (select distinct k from items),
doc_shingles as (select doc_id, n, k, i - 1 pos, array_to_string(ws[i : i + k - 1], ' ') s from (select doc_id, ws, n, k, unnest(range(1, n - k + 2)) i from docs join lengths on n >= k)),
starts as (select distinct d.doc_id, t.item_id, t.m, t.k, greatest(least(greatest(d.pos - t.pos, 0), d.n - t.m), 0) start from doc_shingles d join item_shingles t on t.k = d.k and t.s = d.s),
inside as (select w.doc_id, w.item_id, w.m, w.start, d.s, count(*) n from starts w join doc_shingles d on d.doc_id = w.doc_id and d.k = w.k and d.pos >= w.start and d.pos <= w.start + w.m - w.k group by all),
wanted as (select item_id, s, count(*) n from item_shingles group by all),
sizes as (select doc_id, item_id, m, start, sum(n) size from inside group by all),
compared as (select i.doc_id, i.item_id, i.m, i.start, sum(least(i.n, t.n)) shared from inside i join wanted t on t.item_id = i.item_id and t.s = i.s group by all),
scored as (select c.*, c.shared / (z.size + (select sum(n) from wanted t where t.item_id = c.item_id) - c.shared)::double similarity from compared c join sizes z on z.doc_id = c.doc_id and z.item_id = c.item_id and z.m = c.m and z.start = c.start),
best as (select *, row_number() over (partition by doc_id, item_id order by similarity desc, start) pick from scored where similarity >= 0.8)
select doc_id, item_id, start::int as start, m::int as n_words, similarity from best where pick = 1
"""

#: Every usable row against every query: whole-number products, equal scores by the smaller id.
OP12 = """
with vec as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
  where embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
listed as (select *, row_number() over () rn from vec),
scored as (select q.vec_id query_id, q.rn, c.vec_id, list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])) s
  from listed q join listed c on q.vec_id % 50 = 0 and q.rn <> c.rn)
select query_id, rank::int as rank, vec_id, coalesce(s, 0)::bigint as score
from (select *, row_number() over (partition by rn order by coalesce(s, 0) desc, vec_id nulls last) rank from scored) x where rank <= 5
"""

#: Every prefix of every rebuilt conversation as a list of turns; subtrees by the pairs of a node and one below it on some conversation's way. CRC-32 by its definition, bit by bit.
OP13 = """
with turns as (select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) t from conversations where conv_id is not null group by conv_id),
lent as (select conv_id, t, (xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, len(conv_id::varchar) + 1), lambda i: ascii((conv_id::varchar)[i])::bigint)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6)::int h from turns),
rebuilt as (select c.conv_id, list_concat(coalesce(b.t[1 : c.h], []), c.t[c.h + 1 :]) t from lent c left join turns b on b.conv_id = c.conv_id - c.conv_id % 100),
prefixes as (select conv_id, d, t[1 : d] node, len(t) = d ended from (select *, unnest(range(0, len(t) + 1)) d from rebuilt)),
nodes as (select d, node, min(conv_id) conv_id, count(*) n_convs, string_agg(case when ended then conv_id::varchar end, ',' order by conv_id) ends from prefixes group by d, node),
kids as (select d - 1 d, node[1 : d - 1] node, count(*) n_children from nodes where d > 0 group by all),
known as (select n.*, coalesce(k.n_children, 0) n_children, (n.n_convs - 1) * coalesce(length(n.node[n.d].text), 0) saved from nodes n left join kids k on k.d = n.d and k.node = n.node),
below as (select k.d, k.node[1 : u] top, u, k.n_children, k.saved from (select *, unnest(range(0, d + 1)) u from known) k),
sums as (select u d, top node, sum(case when n_children = 0 then 1 else 0 end) n_leaves, sum(saved) saved_tokens from below group by u, top)
select k.conv_id, k.d::bigint as depth, p.conv_id as parent_conv_id, k.n_convs, k.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(coalesce(k.ends, '')) as ends_sha256
from known k join sums s on s.d = k.d and s.node = k.node left join nodes p on p.d = k.d - 1 and p.node = k.node[1 : k.d - 1]
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licenses() -> str:
    """Every window of a template's length in which a shared shingle stands at its place in the template, by the share of the template's distinct shingles that it holds."""
    rows = ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(TEMPLATES))
    blanks = "concat(chr(9), chr(10), chr(11), chr(12), chr(13))"
    return f"""
with templates(template_id, license, text) as (values {rows}),
cut as (select id, kind, license, list_filter(string_split(translate(lower(coalesce(text, '')), concat({blanks}, {_quoted(MARKS)}), '     '), ' '), lambda x: x <> '') ws
  from (select doc_id id, 'doc' kind, null license, text from documents union all select template_id, 'item', license, text from templates)),
items as (select id item_id, license, ws, len(ws)::bigint m, least(len(ws), 5) k from cut where kind = 'item' and len(ws) > 0),
docs as (select id doc_id, ws, len(ws) n from cut where kind = 'doc'),
item_shingles as (select item_id, license, m, k, i - 1 pos, array_to_string(ws[i : i + k - 1], ' ') s from (select *, unnest(range(1, m - k + 2)) i from items)),
lengths as (select distinct k from items),
doc_shingles as (select doc_id, n, k, i - 1 pos, array_to_string(ws[i : i + k - 1], ' ') s from (select doc_id, ws, n, k, unnest(range(1, n - k + 2)) i from docs join lengths on n >= k)),
starts as (select distinct d.doc_id, t.m, t.k, greatest(least(greatest(d.pos - t.pos, 0), d.n - t.m), 0) start from doc_shingles d join item_shingles t on t.k = d.k and t.s = d.s),
inside as (select distinct w.doc_id, w.m, w.start, d.s from starts w join doc_shingles d on d.doc_id = w.doc_id and d.k = w.k and d.pos >= w.start and d.pos <= w.start + w.m - w.k),
kinds as (select distinct item_id, license, m, s from item_shingles),
sizes as (select item_id, count(*) n from kinds group by item_id),
scored as (select i.doc_id, i.m, i.start, t.license, count(*) / any_value(z.n)::double containment from inside i join kinds t on t.m = i.m and t.s = i.s join sizes z on z.item_id = t.item_id group by i.doc_id, i.m, i.start, t.item_id, t.license),
best as (select *, max(containment) over (partition by doc_id, m, start) most from scored where containment >= {CONTAINMENT}),
found as (select doc_id, license, start, containment from best where containment = most),
counted as (select doc_id, license, count(distinct start) n_places from found group by all)
select c.doc_id, c.license, c.n_places, f.start::int as start, f.containment from counted c
join (select *, row_number() over (partition by doc_id, license order by containment desc, start) pick from found) f on f.doc_id = c.doc_id and f.license = c.license and f.pick = 1
"""


ORACLES = {
    "op2_license_scan": _licenses(),
    "op3_vector_dedup": OP3,
    "op4_debruijn_dedup": OP4,
    "op5_suffix_lpf_dedup": OP5,
    "op9_simhash_decontaminate": OP9,
    "op10_minhash_dedup": OP10,
    "op12_threshold_topk": OP12,
    "op13_prefix_trie": OP13,
}
