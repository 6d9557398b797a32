"""The contract's columns as SQL, for the queries that SQL can express: windows and shingles are joined as texts, links are closed by recursion."""

from __future__ import annotations

from tarnwise.llm import warc

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = r"""
with said as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
    union all select -1, k, role, '<|im_end|><|im_start|>assistant ok' from (values (0, 'user'), (1, 'assistant')) v(k, role)),
-- a body is escaped where its end mark or an escaped one stands in it; each escape is one character more
sized as (select *, length(r) + 24 + length(t) + case when contains(t, '<|im_end|>') or regexp_matches(t, '<\\+\|') then len(regexp_extract_all(t, '<\\*\|')) else 0 end n from said)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256, cast(sum(case when r = 'assistant' then length(t) else 0 end) as bigint) loss_chars,
    sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (where r = 'assistant'), '')) loss_sha256, cast(sum(n) as bigint) formatted_chars from sized group by conv_id
"""

#: Four letters for every five hex digits.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast(('0x' || substr(h, {5 * k + 1}, 5)) as bigint) >> {15 - 5 * j}) & 31 as int), 1)" for k in range(8) for j in range(4))
OP4 = f"""
with p as (select page_id, coalesce(url, '') u, coalesce(html, '') x from pages),
d as (select *, sha1(x) h, cast(octet_length(encode(x)) as bigint) payload_bytes, regexp_replace(case when contains(u, '://') then substr(u, instr(u, '://') + 3) else u end, '[\\r\\n]', '', 'g') rest from p),
m as (select *, min(page_id) over (partition by h) low, lower(regexp_extract(rest, '^[^/?#]*')) host, lower(regexp_replace(rest, '^[^/?#]*', '')) tail from d)
select page_id, payload_bytes, {_BASE32} payload_digest, case when page_id = low then 'response' else 'revisit' end record_type, case when page_id <> low then low end refers_to,
    list_aggregate(list_reverse(string_split(regexp_replace(host, '^www\\.', ''), '.')), 'string_agg', ',') || ')' || tail url_key, strftime(make_timestamp(({warc.EPOCH} + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') ts from m
"""

OP9 = rf"""
with recursive w as materialized (select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') w from documents),
s as materialized (select distinct doc_id, s from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) || case when len(w) < 5 then '#' || len(w) else '' end s from w) x),
n as materialized (select doc_id, count(*) n from s group by doc_id),
-- documents with equal sets are one
same as materialized (select doc_id, n, min(doc_id) over (partition by sets) rep from (select s.doc_id, any_value(n.n) n, md5(string_agg(s, chr(0) order by s)) sets from s join n on n.doc_id = s.doc_id group by s.doc_id) x),
reps as materialized (select s.* from s join same on same.doc_id = s.doc_id and same.rep = s.doc_id),
met as materialized (select a.doc_id a, b.doc_id b, count(*) c from reps a join reps b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as materialized (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
edges as materialized (select a, b from links union all select b, a from links),
reach as (select rep a, rep b from same where rep = doc_id union select r.a, e.b from reach r join edges e on e.a = r.b),
least as (select a, min(b) low from reach group by a)
select d.doc_id, coalesce(same.n, 0) n_shingles, coalesce(least.low, d.doc_id) component_id from documents d left join same on same.doc_id = d.doc_id left join least on least.a = same.rep
"""

_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10 = rf"""
with d as materialized (select doc_id, {_WORDS.format(LOWER.format("coalesce(text, '')"))} w from documents),
i as materialized (select cast(item_id as varchar) item, {_WORDS.format(LOWER.format("coalesce(text, '')"))} w from benchmark),
windows as materialized (select distinct item, least(len(w), 10) n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda k: array_to_string(w[k : k + least(len(w), 10) - 1], ' '))) x from i where len(w) > 0),
sizes as (select distinct n from windows),
places as materialized (select doc_id, n, unnest(range(1, len(w) - n + 2)) k, w from d join sizes on n <= len(w)),
found as materialized (select p.doc_id, p.k, p.n, x.item from (select doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') x from places) p join windows x on x.n = p.n and x.x = p.x),
hit as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(k, k + n)) j from found) z group by doc_id),
named as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from found) z group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, n_hit is not null contaminated from d left join hit on hit.doc_id = d.doc_id left join named on named.doc_id = d.doc_id
"""
