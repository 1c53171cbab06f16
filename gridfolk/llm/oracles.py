"""SQL for DuckDB that gives the rows of the queries, where SQL can.

op4, op9, op10 and op11 need CRC-32 of whole texts or tokenizers, and op8 is
approximate; tests hold them against brute force instead.
"""

from __future__ import annotations

from .licenses import BEFORE, COPYRIGHT_LINE, LICENCES, MARKER, SPELLINGS
from .linededup import LEAST
from .quality import CLASS_DISTANCE, CLASS_WORDS, CLASSES, COMMON, WORD_DISTANCE, WORD_WORDS
from .urlrules import GLOBS, LOWER, RULES, UPPER


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1 = """
with n as (select source, count(*) as n_docs from documents group by source),
w as (select source, n_docs, pow(n_docs, 0.5) as weight from n),
r as (select source, weight / (select sum(weight) from w) * (select sum(n_docs) from w) / n_docs as rate from w),
k as (select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 24)::bigint + 1)) as k from r),
c as (select source, sum(exp(case when k = 0 then 0 else k * ln(rate) end - rate - lgamma(k + 1.0))) over (partition by source order by k) as upto from k),
u as (select *, ('0x' || substr(md5('1|count|' || doc_id), 1, 13))::bigint / pow(16, 13) as u from documents),
d as (select u.doc_id, u.source, u.lang, u.text, count(c.upto) as n from u left join c on c.source is not distinct from u.source and c.upto <= u.u group by all),
e as (select *, unnest(range(1, n + 1)) as copy from d)
select doc_id, source, lang, text, copy::integer as copy, n::integer as n_copies,
  ('0x' || substr(md5('1|order|' || doc_id || '|' || copy), 1, 15))::bigint as shuffle_key
from e
"""

# The words of each text in order; used by several queries.
WORDS = """
words as (
  select doc_id, unnest(w) as w, generate_subscripts(w, 1) as i
  from (select doc_id, list_filter(regexp_split_to_array({text}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as w from documents)
)"""

OP2 = (
    "with recursive "
    + WORDS.format(text=f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")
    + """,
pairs as (select doc_id, w, lead(w) over (partition by doc_id order by i) as w2, count(*) over (partition by doc_id) as n from words),
shingles as (select distinct doc_id, case when n = 1 then w else w || ' ' || w2 end as s from pairs where n = 1 or w2 is not null),
sizes as (select doc_id, count(*) as n, md5(string_agg(s, chr(1) order by s)) as digest from shingles group by doc_id),
class as (select digest, min(doc_id) as id, any_value(n) as n from sizes group by digest),
owned as (select c.id, c.n, s.s from shingles s join class c on c.id = s.doc_id),
ranked as (select *, row_number() over (partition by id order by c, s) as r from (select *, count(*) over (partition by s) as c from owned)),
prefix as (select id, n, s from ranked where r <= n - (80 * n + 99) // 100 + 1),
maybe as (select distinct a.id as a, b.id as b, a.n as an, b.n as bn from prefix a join prefix b on a.s = b.s and a.id < b.id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
common as (select m.a, m.b, m.an, m.bn, count(*) as c from maybe m join owned x on x.id = m.a join owned y on y.id = m.b and y.s = x.s group by all),
links as (select a, b from common where 100 * c >= 80 * (an + bn - c) union select b, a from common where 100 * c >= 80 * (an + bn - c)),
reach(id, to_id) as (select id, id from class union select r.id, l.b from reach r join links l on l.a = r.to_id),
parts as (select id, min(to_id) as part from reach group by id)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(p.part, d.doc_id) as component_id, coalesce(p.part, d.doc_id) = d.doc_id as kept
from documents d left join sizes s on s.doc_id = d.doc_id left join class c on c.digest = s.digest left join parts p on p.id = c.id
"""
)


def _rule_test(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"((host = {quoted(host)} or ends_with(host, {quoted('.' + host)})) and starts_with(path, {quoted('/' + path)}))"


def _glob_test(rule: str) -> str:
    return f"(contains(host, {quoted(rule.partition('/')[0].strip('*'))}) and starts_with(path, '/'))"


_BY_LENGTH = sorted(RULES, key=lambda x: -len(x[1]))
OP3 = f"""
with rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
split as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') as host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from rest)
select page_id, host, path,
  case {" ".join(f"when {_rule_test(r)} then {quoted(r)}" for _, r in _BY_LENGTH)} end as rule,
  case {" ".join(f"when {_rule_test(r)} then {quoted(v)}" for v, r in _BY_LENGTH)} {" ".join(f"when {_glob_test(r)} then {quoted(v)}" for v, r in sorted(GLOBS, key=lambda x: -len(x[1])))} else 'allow' end as verdict
from split
"""

OP5 = f"""
with cut as (select doc_id, text, list_filter(string_split(replace(regexp_replace(text, '([.!?] )', '\\1' || chr(1), 'g'), chr(10), chr(10) || chr(1)), chr(1)), lambda x: x <> '') as u from documents),
units as (select doc_id, unnest(u) as u, generate_subscripts(u, 1) as i from cut),
t as (select doc_id, i, u, trim(u, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from units),
w as (select *, case when t = '' then 0 else length(t) - length(replace(t, ' ', '')) + 1 end as w from t),
four as (select doc_id, i, w, t, lead(t, 1) over o as t1, lead(t, 2) over o as t2, lead(t, 3) over o as t3, lead(w, 1) over o as w1, lead(w, 2) over o as w2 from w window o as (partition by doc_id order by i)),
wins as (
  select doc_id, i, 4 as size, md5(concat_ws(chr(1), t, t1, t2, t3)) as win from four where t3 is not null
  union all select doc_id, i, 3, '3' || md5(concat_ws(chr(1), t, t1, t2)) from four where w + w1 + w2 >= {LEAST}
  union all select doc_id, i, 2, '2' || md5(concat_ws(chr(1), t, t1)) from four where w + w1 >= {LEAST}
  union all select doc_id, i, 1, '1' || md5(t) from four where w >= {LEAST}),
placed as (select *, row_number() over (partition by win order by doc_id, i) as n from wins),
hit as (select distinct p.doc_id, p.i + k.k as i from placed p join (select unnest(range(0, 4)) as k) k on k.k < p.size where p.n > 1),
runs as (select doc_id, i, i - row_number() over (partition by doc_id order by i) as run from hit),
long as (select r.doc_id, r.run, sum(w.w) as words from runs r join w on w.doc_id = r.doc_id and w.i = r.i group by all),
gone as (select r.doc_id, r.i from runs r join long l on l.doc_id = r.doc_id and l.run = r.run where l.words >= {LEAST}),
left_ as (select u.doc_id, string_agg(u.u, '' order by u.i) filter (where g.i is null) as text, count(g.i) as n_removed from units u left join gone g on g.doc_id = u.doc_id and g.i = u.i group by u.doc_id)
select c.doc_id, case when coalesce(l.n_removed, 0) = 0 then c.text else coalesce(l.text, '') end as text, coalesce(len(c.u), 0)::integer as n_units, coalesce(l.n_removed, 0)::integer as n_removed
from cut c left join left_ l on l.doc_id = c.doc_id
"""

_CLASS_COUNTS = ", ".join(f"(length(t) - length(translate(t, {quoted(c)}, '')))::double" for c in CLASSES)
OP6 = (
    "with "
    + WORDS.format(text="coalesce(text, '')")
    + f""",
d as (select doc_id, lang, coalesce(text, '') as t from documents),
grams as (select doc_id, i, w, lead(w, 1) over o as b, lead(w, 2) over o as c from words window o as (partition by doc_id order by i)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w, b, c) as n from grams where c is not null) where n > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, (select unnest([0, 1, 2]) as k) group by doc_id),
lines as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
sums as (select doc_id, count(*) as n_words, sum(length(w))::bigint as word_chars from words group by doc_id),
base as (
  select d.doc_id, d.lang, d.t, coalesce(s.n_words, 0) as n_words, coalesce(s.word_chars, 0) as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(l.l) - len(list_distinct(l.l)))::bigint as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
  from d left join sums s on s.doc_id = d.doc_id left join covered c on c.doc_id = d.doc_id join lines l on l.doc_id = d.doc_id),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base),
letters as (select doc_id, lang, unnest(regexp_split_to_array(lower(t), '[^\\p{{L}}]+')) as w from d),
common as (select lang, w from (select lang, w, row_number() over (partition by lang order by count(*) desc, w) as r from letters where w <> '' group by lang, w) where r <= {COMMON}),
class as (select doc_id, lang, base_failed, unnest(x) as x, generate_subscripts(x, 1)::varchar as k from (select doc_id, lang, base_failed, list_append(x, greatest(0, length(t) - list_sum(x))) as x from (select *, [{_CLASS_COUNTS}] as x from judged))),
found as (select l.doc_id, l.w, count(*)::double as x from letters l join common c on c.lang is not distinct from l.lang and c.w = l.w group by all),
hits as (select j.doc_id, c.w as k, coalesce(f.x, 0) as x from judged j join common c on c.lang is not distinct from j.lang left join found f on f.doc_id = j.doc_id and f.w = c.w),
in_all as (select doc_id, count(*) as n from letters where w <> '' group by doc_id),
rest as (select j.doc_id, '' as k, (coalesce(a.n, 0) - coalesce(f.x, 0))::double as x from judged j left join in_all a on a.doc_id = j.doc_id left join (select doc_id, sum(x) as x from found group by doc_id) f on f.doc_id = j.doc_id),
word as (select a.doc_id, j.lang, j.base_failed, a.x, a.k from (select * from hits union all by name select * from rest) a join judged j on j.doc_id = a.doc_id),
hist as (select 'class' as h, * from class union all by name select 'word' as h, * from word),
ref as (select h, lang, k, sum(x) as x from hist where not base_failed group by all),
share as (select h, doc_id, lang, k, x / nullif(sum(x) over (partition by h, doc_id), 0) as p from hist),
ref_share as (select h, lang, k, x / nullif(sum(x) over (partition by h, lang), 0) as q from ref),
terms as (select s.h, s.doc_id, case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end as term
  from share s join ref_share r on r.h = s.h and r.k = s.k and r.lang is not distinct from s.lang where p is not null and q is not null),
far as (select doc_id, sqrt(greatest(0, sum(term) filter (where h = 'class') / 2)) as class_distance, sqrt(greatest(0, sum(term) filter (where h = 'word') / 2)) as word_distance from terms group by doc_id)
select j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed, round(f.class_distance, 6) as class_distance, round(f.word_distance, 6) as word_distance,
  not j.base_failed and not coalesce((f.class_distance > {CLASS_DISTANCE} and j.n_words >= {CLASS_WORDS}) or (f.word_distance > {WORD_DISTANCE} and j.n_words >= {WORD_WORDS}), false) as kept
from judged j left join far f on f.doc_id = j.doc_id
"""
)


def _canonical_lines(text: str) -> str:
    spelled = "x"
    for a, b in SPELLINGS:
        spelled = f"replace({spelled}, {quoted(a)}, {quoted(b)})"
    form = f"case when regexp_matches(x, {quoted(COPYRIGHT_LINE)}) then '' else trim(regexp_replace({spelled}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) end"
    lines = f"string_split(lower(coalesce({text}, '')), chr(10))"
    item = f"case when regexp_matches(x, {quoted(MARKER)}) and (i = 1 or regexp_matches(({lines})[i - 1], {quoted(BEFORE)})) then regexp_replace(x, {quoted(MARKER)}, '') else x end"
    return f"list_filter(list_transform(list_transform({lines}, lambda x, i: {item}), lambda x: {form}), lambda x: x <> '')"


OP7 = f"""
with texts(licence_id, text) as (values {", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in LICENCES)}),
known as (select md5(array_to_string({_canonical_lines("text")}, ' ')) as digest, min(licence_id) as licence_id from texts group by 1),
d as (select doc_id, {_canonical_lines("text")} as l from documents),
line as (select doc_id, md5(unnest(l)) as digest from d),
lines as (select doc_id, string_agg(distinct licence_id, ',' order by licence_id) as found from line join known using (digest) group by doc_id)
select d.doc_id, case when len(l) > 0 then md5(array_to_string(l, ' ')) end as text_digest, k.licence_id, coalesce(s.found, '') as line_licences
from d left join known k on len(l) > 0 and k.digest = md5(array_to_string(l, ' ')) left join lines s on s.doc_id = d.doc_id
"""

OP12 = """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor, b.vec_id as id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from r a join r b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
p as (select * from s where same qualify row_number() over (partition by anchor order by score desc, id) <= 5),
n as (select p.anchor, p.id as positive, p.score as positive_score, s.id, s.score, row_number() over (partition by p.anchor, p.id order by s.score desc, s.id) as rank
  from p join s on s.anchor = p.anchor and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor as anchor_id, positive as positive_id, rank::integer as rank, id as negative_id, positive_score, score as negative_score from n where rank <= 3
"""

# CRC-32 by its table of 256 steps of eight bits, over the digits of the ids.
OP13 = """
with recursive bits(n, k, c) as (select range, 0, range from range(256) union all select n, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
steps as (select n, c from bits where k = 8),
ids as (select distinct conv_id, conv_id::varchar as s from conversations where conv_id is not null),
crc(conv_id, s, i, c) as (select conv_id, s, 1, 4294967295::bigint from ids
  union all select conv_id, s, i + 1, xor(crc.c >> 8, steps.c) from crc join steps on steps.n = xor(crc.c, ascii(substr(s, i, 1))) & 255 where i <= length(s)),
taken as (select conv_id, conv_id - conv_id % 20 as base, case when conv_id % 20 = 0 then 0 else xor(c, 4294967295) % 4 end as h from crc where i > length(s)),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
turns as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(length(role) || ':' || role || ':' || text)) - 1 as pos from t),
own as (select conv_id, count(*) as n from turns group by conv_id),
places as (
  select t.conv_id, least(h, coalesce(b.n, 0)) + pos - h as place, role, text from turns t join taken using (conv_id) left join own b on b.conv_id = taken.base where pos >= h
  union all select taken.conv_id, pos, role, text from taken join turns t on t.conv_id = taken.base and pos < h),
paths as (select conv_id, place + 1 as depth, len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) as words, list({'r': role, 't': text}) over (partition by conv_id order by place) as path from places
  union all select conv_id, 0, 0, [] from ids),
nodes as (select depth, path, min(conv_id) as conv, count(*) as n, any_value(words) as words from paths group by depth, path),
held as (select paths.conv_id, depth, conv from paths join nodes using (depth, path)),
ends as (select conv_id, max(depth) as depth from paths group by conv_id),
lists as (select conv, depth, string_agg(conv_id::varchar, ',' order by conv_id) as list from ends join held using (conv_id, depth) group by conv, depth),
named as (select n.conv, n.depth, n.n, n.words, h.conv as parent from nodes n left join held h on h.conv_id = n.conv and h.depth = n.depth - 1),
kids as (select parent, depth - 1 as depth, count(*) as n from named where parent is not null group by all),
plain as (select d.conv, d.depth, d.n, d.words, d.parent, coalesce(k.n, 0) as kids from named d left join kids k on k.parent = d.conv and k.depth = d.depth),
sums as (select a.conv, a.depth, sum((p.kids = 0)::bigint) as leaves, sum((p.n - 1) * p.words) as saved from plain p join held a on a.conv_id = p.conv and a.depth <= p.depth group by a.conv, a.depth)
select p.conv as conv_id, p.depth::bigint as depth, p.parent as parent_conv_id, p.n as n_convs, p.kids as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(list, '')) as ends_sha256
from plain p join sums using (conv, depth) left join lists using (conv, depth)
"""

ORACLES = {
    "op1_mix_sources": OP1,
    "op2_near_duplicates": OP2,
    "op3_url_rules": OP3,
    "op5_line_dedup": OP5,
    "op6_quality_rules": OP6,
    "op7_licence_scan": OP7,
    "op12_hard_negatives": OP12,
    "op13_prefix_trie": OP13,
}
