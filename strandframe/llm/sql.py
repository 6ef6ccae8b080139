"""DuckDB SQL for the queries that SQL expresses."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: rule name -> failure of a measured document, as in ``quality.RULES``
_RULES = {
    "short": "n_words < 10",
    "repetitive": "100 * n_repeat_words > 20 * n_words",
    "dup": "5 * n_dup_lines > n_words",
    "symbols": "2 * n_symbols > n_words",
    "lengths": "(word_chars > 40 * n_words or word_chars < 2 * n_words)",
}


def _shrunk(k: str) -> str:
    mean, square = f"f.{k}_m", f"f.{k}_s"
    apart = f"({square} - {mean} * {mean} - {mean} * (1 - {mean}) * f.hosts / f.n)"
    strength = f"case when {apart} > 0 then least(greatest({mean} * (1 - {mean}) / {apart} - 1, 1.0), 10000.0) else 10000.0 end"
    return f"(h.{k} + {mean} * ({strength})) / (h.n + ({strength}))"


OP4 = f"""
with w as (select doc_id, source, coalesce(text, '') as text, {_WORDS} as words from documents),
b as (select *, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
        case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) else [] end as windows
      from w),
p as (select doc_id, unnest(windows) as win, unnest(range(0, len(windows))) as i from b),
r as (select doc_id, i, lead(i) over (partition by doc_id order by i) as j
      from (select doc_id, i, count(*) over (partition by doc_id, win) as c from p) where c > 1),
c as (select doc_id, sum(least(5, coalesce(j - i, 5)))::bigint as n from r group by doc_id),
m as (select b.doc_id, source, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        coalesce(c.n, 0)::bigint as n_repeat_words from b left join c using (doc_id)),
h as (select source, count(*)::double as n, {', '.join(f"sum(({r})::int)::double as {k}" for k, r in _RULES.items())} from m group by source),
f as (select sum(n) as n, count(*)::double as hosts, {', '.join(f"sum({k}) / sum(n) as {k}_m, sum({k} * {k} / n) / sum(n) as {k}_s" for k in _RULES)} from h),
v as (select h.source, greatest({', '.join(map(_shrunk, _RULES))}) <= 0.5 as ok from h, f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  (not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and v.ok) as kept
from m join v on m.source is not distinct from v.source
"""


#: Links by counting shared shingles; a smaller id spreads along them until nothing changes.
OP3 = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as g
  from words
), grams as (select doc_id, len(g) as n, unnest(g) as g from sets), pairs as (
  select x.doc_id as a, y.doc_id as b, x.n + y.n as n, count(*) as shared
  from grams x join grams y on x.g = y.g and x.doc_id < y.doc_id group by all
), links as (select a, b from pairs where 100 * shared >= 80 * (n - shared)),
edges as (select a as u, b as v from links union all select b, a from links),
reached(id, c) as (select doc_id, doc_id from documents union select v, c from reached join edges on u = id where c < v)
select sets.doc_id, len(g)::bigint as n_shingles, min(c) as component_id
from sets join reached on id = sets.doc_id group by sets.doc_id, g
"""

_SHOWN = "'<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10)"


def _rendered(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda t: {_SHOWN}), '')"


def _mask(turns: str) -> str:
    """Spans of what assistants wrote."""
    before = f"coalesce(list_sum(list_transform({turns}[1 : i - 1], lambda t: length({_SHOWN}))), 0)::bigint"
    span = f"(({before}) + length({turns}[i].role) + 5) || '-' || (({before}) + length({turns}[i].role) + length({turns}[i].text) + 14)"
    which = f"list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant')"
    return f"case when {turns} is not null then coalesce(array_to_string(list_transform({which}, lambda i: {span}), ','), '') end"


OP10 = f"""
with talks as (
  select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
  from conversations where conv_id is not null group by conv_id
), pairs as (
  select floor(conv_id / 2)::bigint as pair_id, max(conv_id) filter (conv_id % 2 = 0) as chosen_id, max(conv_id) filter (conv_id % 2 <> 0) as rejected_id,
    any_value(turns) filter (conv_id % 2 = 0) as c, any_value(turns) filter (conv_id % 2 <> 0) as r
  from talks group by 1
), limits as (select *, coalesce(least(len(c), len(r)), 0) as most from (select *, c is null or r is null as lone from pairs)),
shared as (select *, case when lone then 0 else list_min(list_filter(range(0, most + 1), lambda i: i = most or c[i + 1] <> r[i + 1])) end::int as n_shared from limits),
cut as (select *, c[n_shared + 1 :] as own_c, r[n_shared + 1 :] as own_r from shared)
select pair_id, chosen_id, rejected_id, n_shared, case when n_shared > 0 then {_rendered('c[1 : n_shared]')} else '' end as prompt,
  {_rendered('own_c')} as chosen_completion, {_rendered('own_r')} as rejected_completion,
  {_mask('own_c')} as chosen_mask, {_mask('own_r')} as rejected_mask
from cut
"""
