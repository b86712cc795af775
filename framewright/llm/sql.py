"""DuckDB SQL for the queries whose whole result SQL can express."""

from __future__ import annotations

from framewright.llm import licenses

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def license_scan() -> str:
    """The same rules over the same words, by marks around matches.

    Characters beyond ASCII become one letter first, so that word boundaries are
    the words' own.  An interval that any earlier one contains with a priority as
    strong would be contained in one that stays, so one comparison is enough.
    """
    table = ", ".join(f"({i}, {r.priority}, {_text(r.label)}, {_text(r.keyword)}, {_text(r.pattern)})" for i, r in enumerate(licenses.rules()))
    base = ", ".join(f"({_text(p)}, {_text(x)})" for p, x in licenses.BASE.items())
    spaces = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    return f"""
with rules(rule, priority, label, keyword, pattern) as (values {table}),
base(phrase, label) as (values {base}),
docs as (
  select doc_id, w, ' ' || regexp_replace(array_to_string(w, ' '), '[^\\x00-\\x7F]', 'z', 'g') || ' ' as j
  from (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents)
), marked as (
  select doc_id, rule, priority, label, regexp_split_to_array(regexp_replace(j, '\\b(' || pattern || ')\\b', chr(1) || '\\1' || chr(2), 'g'), '[' || chr(1) || chr(2) || ']') as p
  from docs join rules on contains(j, ' ' || keyword || ' ')
), found as (
  select doc_id, rule, priority, label, {spaces("array_to_string(p[1:2 * k - 1], '')")} - 1 as s, {spaces("array_to_string(p[1:2 * k], '')")} as e
  from marked, unnest(range(1, len(p) // 2 + 1)) as u(k)
), kept as (
  select * from found x where not exists (
    select 1 from found y where y.doc_id = x.doc_id and y.s <= x.s and y.e >= x.e and y.priority <= x.priority
      and (y.s, -y.e, y.priority, y.rule) < (x.s, -x.e, x.priority, x.rule))
), places as (
  select doc_id, label, i as s from docs, base, unnest(range(len(w))) as u(i) where array_to_string(w[i + 1:i + len(string_split(phrase, ' '))], ' ') = phrase
), labelled as (
  select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from kept union all select doc_id, label from places) group by doc_id
), covered as (
  select doc_id, count(distinct q) as n from kept, unnest(range(s, e)) as u(q) group by doc_id
), based as (
  select doc_id, count(*) as n, min(s) as first_word, max(s) as last_word, string_agg(distinct label, ',' order by label) as labels from places group by doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base, b.first_word::bigint as first_word, b.last_word::bigint as last_word, coalesce(b.labels, '') as base_labels,
  coalesce(l.labels, '') as labels, case when len(d.w) > 0 then coalesce(c.n, 0) / len(d.w)::double else 0.0 end as score, (select count(*) from kept k where k.doc_id = d.doc_id)::bigint as n_detections
from docs d left join based b using (doc_id) left join labelled l using (doc_id) left join covered c using (doc_id)
"""


NEAR_DUPLICATES = f"""
with recursive docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) >= 5 then list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from docs
), each as (
  select doc_id, len(s) as n, unnest(s) as x from sets
), near as (
  select a.doc_id as i, b.doc_id as j from each a join each b on a.x = b.x and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), links as (
  select i, j from near union all select j, i from near
), reach(i, c) as (
  select doc_id, doc_id from documents union select l.j, r.c from reach r join links l on l.i = r.i
), least as (
  select i, min(c) as c from reach group by i
)
select doc_id, len(s)::bigint as n_shingles, c as component_id, doc_id = c as kept from sets join least on i = doc_id
"""

#: What isn't main text in the tables goes: head, menus, advert blocks, footers, comments; then markup.  No article is looked for.
HTML_EXTRACTION = r"""
with inner_html as (
  select page_id, url, regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<head>.*?</head>|<nav>.*?</nav>|<div class="ad">.*?</div>|<footer>.*?</footer>', ' ', 'g'), '</?b>', '', 'g') as h from pages
), plain as (
  select page_id, url, replace(replace(replace(replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as t from inner_html
), clean as (
  select page_id, url, trim(regexp_replace(t, '[\s\x{A0}\x{2028}]+', ' ', 'g')) as text from plain
)
select page_id, url, text, length(text)::bigint as n_chars from clean
"""

#: Equality of prefixes is tested on the turns themselves, not on digests.
CHAT_FORMATTING = """
with turns as (
  select conv_id, case when conv_id is null then row_number() over () end as lone, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations
), whole as (
  select conv_id, count(*) as n_turns,
    list(length(role) || chr(31) || role || chr(31) || text order by turn nulls first, role, text) as turns,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn nulls first, role, text) as rendered
  from turns group by conv_id, lone
), prefixes as (
  select distinct turns[1:i] as p from whole, unnest(range(1, n_turns)) as u(i)
), one as (
  select min(conv_id) as conv_id, any_value(n_turns) as n_turns, count(*) as copies, any_value(rendered) as rendered, turns
  from whole group by turns
)
select conv_id, n_turns, copies, rendered from one where not exists (select 1 from prefixes where p = turns)
"""

#: Keys are compared themselves, not their hashes.
LINE_DEDUP = f"""
with docs as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents
), lines as (
  select r, doc_id, i, l[i + 1] as line, translate(trim(l[i + 1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') as key from docs, unnest(range(len(l))) as u(i)
), shared as (
  select key from lines where key <> '' group by key having count(distinct r) >= 10
)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(s.key) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (s.key is null), '')) as kept_sha256
from lines left join shared s using (key) group by r
"""

#: Every document that shares a term with an item is scored.
RANKED_SEARCH = f"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents
), counts as (
  select count(*) filter (len(w) > 0) as n_docs, sum(len(w))::bigint as n_terms from docs
), items as (
  select row_number() over () as q, item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from benchmark
), asked as (
  select q, item_id, term, count(*) as c from (select q, item_id, unnest(w) as term from items) group by all
), postings as (
  select r, doc_id, n, term, count(*) as tf from (select r, doc_id, len(w) as n, unnest(w) as term from docs) where term in (select term from asked) group by all
), weights as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as weight from postings, counts group by term, n_docs
), scored as (
  select q, item_id, r, doc_id, sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint as score
  from asked join postings using (term) join weights using (term), counts group by all
)
select item_id, row_number() over (partition by q order by score desc, doc_id nulls last, r)::int as rank, doc_id, score from scored where score > 0 qualify rank <= 20
"""


def vector_codes(parts: int = 16, width: int = 4, entries: int = 64, rounds: int = 2) -> str:
    """Every part against every entry: a round is two steps, which entry is nearest and the entries' new values."""
    far = " + ".join(f"(q[{j}] - c[{j}]) * (q[{j}] - c[{j}])" for j in range(1, width + 1))
    floor = lambda s: f"(({s}) - ((({s}) % n) + n) % n) // n"
    steps = ""
    for k in range(rounds + 1):
        steps += f""", near{k} as (
  select r, p, any_value(q) as q, min(({far}) * {entries} + e) as m from parts join book{k} using (p) group by r, p
)"""
        if k < rounds:
            steps += f""", book{k + 1} as (
  select p, e, case when n is null then c else [{", ".join(floor(f"s[{j}]") for j in range(1, width + 1))}] end as c
  from book{k} left join (select p, m % {entries} as e, count(*) as n, [{", ".join(f"sum(q[{j}])::bigint" for j in range(1, width + 1))}] as s from near{k} group by 1, 2) using (p, e)
)"""
    return f"""
with kept as (
  select row_number() over () as r, vec_id, label, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as (
  select r, p, v[{width} * p + 1:{width} * p + {width}] as q from kept, unnest(range({parts})) as u(p)
), book0 as (
  select p, e, v[{width} * p + 1:{width} * p + {width}] as c from (select v, row_number() over (order by vec_id) - 1 as e from kept qualify e < {entries}), unnest(range({parts})) as u(p)
){steps}, coded as (
  select r, string_agg(format('{{:02x}}', m % {entries}), '' order by p) as code, sum(m // {entries})::bigint as error from near{rounds} group by r
), digest as (
  select sha256(string_agg(c[j]::varchar, ',' order by p, e, j)) as d from book{rounds}, unnest(range(1, {width + 1})) as u(j)
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, d as codebooks_sha256 from coded join kept using (r), digest
"""
