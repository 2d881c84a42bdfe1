"""SQL for the queries that SQL can express."""

from __future__ import annotations


def _level(name: str, key: str, up: str, parent: str, extra: str = "") -> str:
    """CTEs of one level: its fitted weight and the posterior of its keys."""
    return f"""
{name}_j as (select l.*, p.mean as prior from {name} l join {parent} p using ({up}) where l.n > 0),
{name}_w as (select case when sum(n * pow(bad / n - prior, 2)) - sum(prior * (1 - prior)) > 0
    then least(greatest(sum(n * prior * (1 - prior)) / sum(n)
      / ((sum(n * pow(bad / n - prior, 2)) - sum(prior * (1 - prior))) / greatest(sum(n) - count(*), 1)) - 1, 1.0), 1000.0)
    else 1000.0 end as w from {name}_j),
{name}_r as (
  select {key}{extra}, bad + w * prior as alpha, n - bad + w * (1 - prior) as beta, (bad + w * prior) / (n + w) as mean
  from {name}_j, {name}_w
  union all
  select {key}{extra}, p.mean, 1 - p.mean, p.mean from {name} l join {parent} p using ({up}) where l.n = 0)"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP1 = rf"""
with d as (select row_number() over () as k, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
i as (select item_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
iw as (select item_id, size, array_to_string(w[s:s + size - 1], ' ') as t
  from (select *, least(len(w), 10) as size, unnest(range(1, len(w) - least(len(w), 10) + 2)) as s from i where len(w) > 0)),
sizes as (select distinct size from iw),
dw as (select k, s, size, array_to_string(w[s:s + size - 1], ' ') as t
  from (select k, w, size, unnest(range(1, len(w) - size + 2)) as s from d, sizes where len(w) >= size)),
h as (select dw.k, dw.s, dw.size, iw.item_id from dw join iw using (size, t)),
n as (select k, count(distinct s + o) as n_hit from (select distinct k, s, size from h), range(0, 10) r(o) where o < size group by k),
m as (select k, list_sort(list(distinct item_id::varchar)) as ids from h group by k)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(ids), 0)::bigint as n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (k) left join m using (k)
"""

OP3 = f"""
with cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
placed as (select page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
ruled as (select *, case
    when (host = 'example.net' or suffix(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or suffix(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or suffix(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from placed),
hosts as (select host, count(rule)::double as n, count(case when rule in ('net/', 'example.com/de/') then 1 end)::double as bad,
    coalesce(nullif(regexp_extract(host, '(?:^|\\.)((?:ac|co|com|edu|gov|net|org)\\.[a-z]{{2}})$', 1), ''),
      regexp_extract(host, '[^.]*$')) as suffix from ruled group by host),
host as (select *, regexp_extract(host, '([^.]*\\.)?' || replace(suffix, '.', '\\.') || '$') as domain from hosts),
domain as (select domain, suffix, sum(n) as n, sum(bad) as bad from host group by all),
suff as (select suffix, 0 as root, sum(n) as n, sum(bad) as bad from domain group by all),
total as (select 0 as root, (sum(bad) + 0.5) / (sum(n) + 1.0) as mean from suff),
{_level("suff", "suffix", "root", "total")},
{_level("domain", "domain", "suffix", "suff_r")},
{_level("host", "host", "domain", "domain_r")},
blocked as (select host from host_r
  where mean - 1.64 * sqrt(mean * (1 - mean) / (alpha + beta + 1)) >= 0.5)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when host in (select host from blocked) then 'block' else 'allow' end as verdict from ruled
"""

OP4 = r"""
with base as (select row_number() over () as k, doc_id, source, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) as lines from base),
grams as (select k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g
  from (select k, words, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3)),
twice as (select k, i from (select k, i, count(*) over (partition by k, g) as c from grams) where c > 1),
covered as (select k, count(distinct i + d) as n from twice, (values (0), (1), (2)) t(d) group by k),
m as (select w.k, doc_id, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from w left join covered c using (k)),
b as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m),
f as (select source, (base_failed or 10 * n_symbols > 3 * n_words or 2 * n_dup_lines > n_words
  or word_chars / greatest(n_words, 1) < 2 or word_chars / greatest(n_words, 1) > 20) as failed from b),
s as (select source, count(*)::double as n, count(case when failed then 1 end)::double as bad from f group by source),
t as (select (sum(bad) + 0.5) / (sum(n) + 1.0) as mean, count(*) as k, sum(n) as n from s),
x as (select mean, mean * (1 - mean) as noise, (select sum(s.n * pow(s.bad / s.n - t.mean, 2)) from s) as squares, k, n from t),
p as (select mean, case when squares - k * noise <= 0 then 500.0
  else least(greatest(noise / ((squares - k * noise) / greatest(n - k, 1)) - 1, 2.0), 500.0) end as w from x),
r as (select source, (bad + w * mean) / (n + w) as rate, n + w as total from s, p),
bad as (select source, true as bad from r where rate - 2.33 * sqrt(rate * (1 - rate) / (total + 1)) >= 0.75)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and bad.bad is null) as kept from b left join bad on b.source is not distinct from bad.source
"""

OP10 = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as payload_bytes, sha256(b) as payload_digest from p),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first from d)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to from f
"""

# CRC-32 of a list of bytes, by the table of its 256 remainders.
_CRC_TABLE = """crc as (select list(r order by i) as crc from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as r from (select unnest(range(0, 256)) as i)))"""


def _crc(data: str) -> str:
    """Of an SQL list of bytes, with a column ``crc`` of ``_CRC_TABLE`` in reach."""
    return f"xor(list_reduce(list_concat([4294967295::bigint], {data}), lambda x, y: xor(crc[(xor(x, y) & 255) + 1], x >> 8)), 4294967295)"


OP11 = f"""
with {_CRC_TABLE},
t as (select conv_id as c, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null),
u as (select c, turn, sha256(length(r)::varchar || ':' || r || x) as u, length(x) as n from t),
a as (select c, list({{'u': u, 'n': n}} order by turn nulls first, u) as a from u group by c),
h as (select c, a, {_crc("list_transform(string_split(c::varchar, ''), lambda s: ord(s)::bigint)")} % 6 as h from a, crc),
m as (select h.c, coalesce(b.a[1:h.h], []) || h.a[h.h + 1:] as a from h left join a b on b.c = h.c - h.c % 100),
p as (select c, d, array_to_string(list_transform(a[1:d], lambda e: e.u), '') as k, array_to_string(list_transform(a[1:d - 1], lambda e: e.u), '') as up,
    a, coalesce(a[d].n, 0) as n, d = len(a) as last from (select c, a, unnest(range(0, len(a) + 1)) as d from m)),
g as (select d, k, any_value(up) as up, min(c) as conv_id, count(*) as n_convs, any_value(n) as n,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where last), '')) as ends from p group by d, k),
kids as (select d - 1 as d, up as k, count(*) as n_children from g where d > 0 group by d, up),
v as (select g.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * n as saved from g left join kids using (d, k)),
s as (select p.d, p.k, count(*) filter (where v.n_children = 0) as n_leaves, sum(v.saved) as saved_tokens
    from v join p on p.c = v.conv_id and p.d <= v.d group by p.d, p.k)
select v.conv_id, v.d::bigint as depth, w.conv_id as parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens::bigint as saved_tokens, v.ends as ends_sha256
from v join s using (d, k) left join g w on w.d = v.d - 1 and w.k = v.up
"""

OP13 = rf"""
with {_CRC_TABLE},
t as (select coalesce(doc_id::varchar, '') || ':' as id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[a-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
r as (select id, run, count(*) as n from t group by id, run),
b as (select run, n, {_crc("flatten(list_transform(string_split(id || run, ''), lambda s: case when ord(s) < 128 then [ord(s)::bigint] else [195::bigint, ord(s)::bigint - 64] end))")} as h from r, crc),
w as (select case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(n)::bigint as n from b group by 1),
v as (select word, n from w where length(word) >= 5 and n >= 3),
cut as (select word, n, i, left(word, i - 1) as a, substr(word, i + 1) as z from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
pairs as (select distinct word, near, m from (
    select x.word, y.word as near, y.n as m from cut x join cut y on x.i = y.i and x.a = y.a and x.z = y.z and x.word <> y.word
    union all select x.word, y.word, y.n from cut x join v y on y.word = x.a || x.z
    union all select y.word, x.word, x.n from cut x join v y on y.word = x.a || x.z)),
best as (select word, count(*) as n_near, list({{'m': -m, 'w': encode(near), 'near': near}} order by m desc, encode(near))[1] as b from pairs group by word),
f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when -b.m >= 2 * v.n then b.near end as form, case when -b.m >= 2 * v.n then -b.m end as form_n
  from v left join best using (word)),
recursive_roots as (with recursive x(word, place) as (select word, word from f union all select x.word, f.form from x join f on f.word = x.place where f.form is not null)
  select x.word, x.place as root from x join f on f.word = x.place where f.form is null)
select word, form, root, n, n_near, form_n from f join recursive_roots using (word)
"""

ORACLES = {"op1_benchmark_decontamination": OP1, "op3_url_filters": OP3, "op4_quality_rules": OP4, "op10_warc": OP10, "op11_conversation_trie": OP11, "op13_spelling_variants": OP13}
