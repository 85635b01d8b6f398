"""SQL (DuckDB) of the queries that SQL can say, built from the operators' own constants."""

from __future__ import annotations

from . import quality as q


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def quality_sql() -> str:
    count = lambda c: f"len(regexp_replace(s.marks, '[^{c}]+', '', 'g'))"
    n, w = "len(s.w)", q.WINDOW
    bars = " + ".join([count(q.PLAIN_BARS), *(f"greatest({count(b)} - {count(a)}, 0)" for a, b in q.QUOTES)])
    phrase = " + ".join(f"(length(lower(s.line)) - length(replace(lower(s.line), {_text(p)}, ''))) / {len(p)} * {len(p.split())}" for p in q.BOILERPLATE)
    again = f"1 - len(list_distinct(list_transform(range(1, {n} - {w - 2}), lambda i: array_to_string(s.w[i:i + {w - 1}], ' ')))) / ({n} - {w - 1})"
    other = (
        f"(({count(q.SYMBOLS)} >= 2 and {count(q.SYMBOLS)} * 10 > {n}) or ({count('!')} >= 3 and {count('!')} * 4 > {n})"
        f" or ({bars} >= 2 and ({bars}) * {q.BAR_SHARE} >= {n}) or ({n} <= {q.NAV_WORDS} and not regexp_matches(s.line, {_text(q.SENTENCE_END)}))"
        f" or ({n} between {q.FEW_WORDS} and {q.MANY_WORDS} and len(list_distinct(s.w)) * 2 <= {n}) or ({n} > {q.MANY_WORDS} and {again} > {q.MAX_AGAIN}))"
    )
    return f"""
with d as (
  select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {{
      'line': x, 'w': list_filter(regexp_split_to_array(x, '{q.SPACE}'), lambda y: y <> ''),
      'marks': regexp_replace(x, '[^{q.SYMBOLS}!{q.PLAIN_BARS}{''.join(a + b for a, b in q.QUOTES)}]+', '', 'g')}}), lambda s: len(s.w) > 0) as ls
  from documents),
f as (
  select doc_id, ls, flatten(list_transform(ls, lambda s: s.w)) as ws,
    list_transform(ls, lambda s: {{'other': {other}, 'boiler': ({phrase}) * {q.NOTICE_SHARE} >= {n}, 'n': {n}, 'c': len(array_to_string(s.w, '')), 's': {count(q.SYMBOLS)}}}) as js
  from d),
win as (select doc_id, i, array_to_string(ws[i:i + {q.WINDOW - 1}], ' ') as x from (select doc_id, ws, unnest(range(1, len(ws) - {q.WINDOW - 2})) as i from f)),
dup as (select doc_id, i, lead(i) over (partition by doc_id order by i) as nx from (select *, count(*) over (partition by doc_id, x) as k from win) where k > 1),
rep as (select doc_id, sum(least({q.WINDOW}, coalesce(nx - i, {q.WINDOW}))) as r from dup group by doc_id),
m as (
  select f.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(js, lambda j: j.c)), 0)::bigint as word_chars,
    coalesce(list_sum(list_transform(js, lambda j: j.s)), 0)::bigint as n_symbols,
    (len(ls) - len(list_distinct(list_transform(ls, lambda s: s.line))))::bigint as n_dup_lines,
    coalesce(r, 0)::bigint as n_repeat_words,
    coalesce(list_sum(list_transform(js, lambda j: case when j.other or j.boiler then j.c else 0 end)), 0)::bigint as lost_chars,
    len(list_filter(js, lambda j: j.other)) = 0 and len(list_filter(js, lambda j: j.boiler)) = 1
      and coalesce(list_sum(list_transform(js, lambda j: case when j.boiler then 0 else j.n end)), 0) >= {q.MIN_WORDS} as one_notice
  from f left join rep using (doc_id)),
b as (select *, n_words < {q.MIN_WORDS} or n_repeat_words * 100 > n_words * {q.MAX_REPEAT} as base_failed from m)
select * exclude (one_notice), not base_failed and (lost_chars * 100 <= word_chars * {q.MAX_LOST} or one_notice) as kept from b"""


def mixing_sql() -> str:
    from . import mixing as m

    fits = f"h <= {m.ENTROPY} * ln(n) + 1e-12 and top <= {m.MAX_PASSES} + 1e-12"
    return f"""
with recursive base as (
  select doc_id, coalesce('s' || source, 'n') as k, len(regexp_extract_all(coalesce(text, ''), '{m.WORD}'))::bigint as tokens,
    md5('{m.SEED}|' || coalesce(doc_id::varchar, 'null')) as place from documents),
per as (select k, sum(tokens)::double as t, sum(tokens)::double / (select sum(tokens) from base) as share from base group by k),
live as (select * from per where share > 0),
n as (select count(*) as n, min(ln(share)) as low from live),
steps as (select 0 as i, 0.0::double as lo, 1.0::double as hi
  union all
  select i + 1, case when {fits} then lo else mid end, case when {fits} then mid else hi end
  from (select i, lo, hi, mid, n, ln(z) - mid * s / z as h, exp((mid - 1) * low) / z as top
    from (select i, lo, hi, (lo + hi) / 2 as mid, any_value(n) as n, any_value(low) as low,
        sum(exp(ln(share) * (lo + hi) / 2)) as z, sum(exp(ln(share) * (lo + hi) / 2) * ln(share)) as s
      from steps, live, n where i < 45 group by i, lo, hi))),
a as (select case when (select n from n) < 2 then 1 else hi end as a from steps order by i desc limit 1),
w as (select per.*, coalesce(exp(ln(share) * a) / (select sum(exp(ln(share) * a)) from live, a), 0) as weight from per, a),
q as (select k, t, weight, floor(round(weight * (select sum(tokens) from base), 3) + 0.5)::bigint as quota from w),
r as (select *, case when t > 0 then floor(quota / t) else 0 end::bigint as passes from q),
o as (select doc_id, tokens, weight, quota, passes, quota - passes * t as rest, k, place,
    sum(tokens) over (partition by base.k order by place, tokens) as so_far from base join r using (k)),
c as (select k, max(case when so_far <= rest then place end) as cut from o group by k)
select doc_id, tokens, round(weight, 6) as weight, quota, passes + (place <= coalesce(cut, ''))::bigint as copies from o join c using (k)"""


def licenses_sql(planted: bool = False) -> str:
    """Of documents as they are, with the notices and short texts of ``licenses.KNOWN``; or with every fiftieth text replaced by a known one."""
    from . import licenses as x

    rows = x.KNOWN + (x.planted() if planted else [])
    known = ", ".join(f"({_text(a)}, {_text(b)})" for a, b in rows)
    docs = "select doc_id, coalesce(text, '') as text from documents"
    if planted:
        n = len(x.planted())
        docs = f"""select doc_id, case when doc_id % 50 = 0 then {_text(x.HOLDER)} || repeat('Some words before it. ', (doc_id // {50 * n} % 3 = 2)::int) ||
      case when doc_id // {50 * n} % 2 = 1 then upper(replace(p.text, chr(10), ' ' || chr(13) || chr(10))) else p.text end else coalesce(d.text, '') end as text
  from documents d left join (select row_number() over () - 1 as i, text from (values {', '.join(f"({_text(b)})" for _, b in x.planted())}) v(text)) p on i = doc_id // 50 % {n}"""
    spelled = "{}"
    for a, b in x.SPELLINGS:
        spelled = f"replace({spelled}, {_text(a)}, {_text(b)})"
    front = f"l = '' or regexp_matches(l, {_text(x.TITLES)}) or (regexp_matches(l, {_text(x.STATEMENT)}) and not regexp_matches(l, {_text(x.TERMS)}) and not regexp_matches(l, {_text(x.STEWARD)}))"
    allowed = ", ".join(map(_text, x.ALLOWED))
    return f"""
with docs as ({docs}),
every as (select doc_id, null as license, text from docs union all select null, license, text from (values {known}) v(license, text)),
a as (select doc_id, license, list_transform(string_split(regexp_replace(replace(replace(lower(text), '&', ' and '), '©', ' copyright '), {_text(x.PUNCTUATION)}, ' ', 'g'), chr(10)), lambda l: trim(l)) as ls from every),
b as (select *, coalesce(list_position(list_transform(ls[1:{x.FRONT_LINES}], lambda l: not ({front})), true), 0) as first from a),
c as (select doc_id, license, ls, array_to_string(list_filter(ls[(case when first > 0 then first else {x.FRONT_LINES + 1} end):], lambda l: l <> ''), ' ') as w from b),
e as (select doc_id, license, ls, regexp_replace({spelled.format('w')}, {_text(f'^(?:{x.TITLE} )+')}, '') as w from c),
f as (select doc_id, license, ls, regexp_replace(case when regexp_matches(regexp_extract(w, {_text(x.INLINE)}, 1), {_text(x.TERMS)}) then w else regexp_replace(w, {_text(x.INLINE)}, '\\2') end, {_text(x.APPENDIX)}, '\\1', 'g') as w from e),
g as (select doc_id, license, ls, case when w <> '' then md5(w) end as digest from f),
k as (select digest, min(license) as license from g where license is not null and digest is not null group by 1),
d as (select * exclude (license) from g where license is null),
n as (select doc_id, string_agg(license, ',' order by license) as notices, bool_or(license not in ({allowed})) as bad
  from (select distinct doc_id, license from (select doc_id, md5({spelled.format('line')}) as digest from (select doc_id, unnest(ls) as line from d) where line <> '') join k using (digest)) group by 1)
select doc_id, digest, license, coalesce(notices, '') as notices, coalesce(bad, false) or coalesce(license not in ({allowed}), false) as restricted
from (select doc_id, digest from d) left join k using (digest) left join n using (doc_id)"""


def filter_audit_sql() -> str:
    from . import filter_audit as a

    letters = ", ".join(f"('{f}')" for f in a.FILTERS)
    failed = {
        "A": f"len(w) < {a.MIN_WORDS}",
        "B": f"100 * len(list_distinct(w)) < {a.MIN_DISTINCT} * len(w)",
        "C": f"100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {a.MAX_CAPITALS} * length(t)",
        "D": f"regexp_matches(t, '[{a.SYMBOLS}]')",
        "E": "coalesce(doc_id > min(doc_id) over (partition by t), false)",
    }
    fails = " || ".join(f"case when {c} then '{f}' else '' end" for f, c in failed.items())
    return f"""
with l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
d as (select d.doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from documents d left join l using (doc_id)),
m as (select part, good, toxic, fails, count(*) as n from (select part, good, toxic, {fails} as fails from d) group by all),
f(x) as (values {letters}),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from f a, f b, f c, f d, f e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step::int as step, filter_order[step] as letter, filter_order[1:step - 1] as earlier from o, range(1, 6) r(step)),
r as (select part, filter_order, step, letter, n, good, toxic, fails, contains(fails, letter) as here,
    fails <> '' and length(translate(fails, earlier, '')) < length(fails) as before from m, s),
g as (select part, filter_order, step, letter, sum(case when not here and not before then n else 0 end)::bigint as kept,
    sum(case when here and not before then n else 0 end)::bigint as removed, sum(case when here and before then n else 0 end)::bigint as redundant,
    sum(case when fails = letter then n else 0 end)::bigint as unique_fails,
    sum(case when here and not before then n * good else 0 end)::bigint as good_lost, sum(case when here and not before then n * toxic else 0 end)::bigint as toxic_lost
  from r group by all)
select * exclude (letter), (sum(removed) over (partition by part, letter))::bigint as shapley from g"""
