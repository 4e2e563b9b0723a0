"""SQL that must give the rows of the queries it names."""

from graticule.llm.quality_rules import BOILERPLATE


def _escaped(column):
    out = f"replace({column}, '\\', '\\\\')"
    for mark in ("<s>", "</s>", "[INST]", "[/INST]"):
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


CHAT = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn, role, t)) as turns_sha256,
  cast(coalesce(sum(length(t)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, role, t) filter (role = 'assistant'), ''))
    as loss_sha256,
  cast(sum(22 + length({_escaped('role')}) + length({_escaped('t')})) as bigint) as formatted_chars
from c group by conv_id"""

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

QUALITY_RULES = f"""
with d as (
  select doc_id, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '{_WORD}')) as lines
  from documents),
w as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as k
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from d)),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, k) as n from w) where n > 1),
c as (select doc_id, count(distinct i + o) as n from r, range(3) t(o) group by 1),
l as (
  select doc_id, length(line) as size,
    len(regexp_extract_all(line, '{_WORD}')) as nw,
    len(regexp_extract_all(line, '[#*$%&|<>]+|!!+|\\?\\?+')) as odd,
    len(regexp_extract_all(line, '[|»›·]')) as bars,
    length(lower(line)) - length(regexp_replace(lower(line), '{"|".join(BOILERPLATE)}', '', 'g')) as known
  from (select doc_id, unnest(lines) as line from d)),
f as (
  select doc_id, size, odd > nw * 0.3::double or (bars >= 3 and bars * 4 >= nw)
      or (known > 0 and known >= size * 0.2::double) as fails from l),
s as (
  select doc_id, sum(size) as seen, coalesce(sum(size) filter (fails), 0) as lost,
    count(*) filter (fails) as n_failed from f group by 1),
b as (
  select d.doc_id, cast(len(words) as bigint) as n_words,
    cast(length(regexp_replace(text, '{_SPACE}', '', 'g')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
    coalesce(s.seen, 0) as seen, cast(coalesce(s.lost, 0) as bigint) as removed_chars,
    cast(coalesce(s.n_failed, 0) as bigint) as n_failed_lines
  from d left join c using (doc_id) left join s using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
    and removed_chars <= seen * 0.5::double as kept,
  n_failed_lines, removed_chars
from b"""


def centroids(k=8, rounds=10, width=64):
    """Lloyd's rounds on integer vectors, one pair of common table expressions a round."""
    steps = [f"""
with x as (
  select vec_id, embedding::double[] as e from embeddings where len(embedding) = {width}),
v as materialized (
  select row_number() over () as row, vec_id,
    list_transform(e, lambda a: floor(1024 * a)::bigint) as v
  from x where len(list_filter(e, lambda a: a is not null and isfinite(a))) = {width}),
c0 as materialized (
  select row_number() over (order by sha256('3:' || vec_id) nulls last, v) - 1 as c, v as m
  from v order by c limit {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} as materialized (
  select row, vec_id, v, min((d, c)) as best from (
    select row, vec_id, v, c,
      list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from v, c{i}) group by row, vec_id, v)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} as materialized (
  select c, coalesce(n.m, o.m) as m from c{i} o left join (
    select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as m from (
      select best[2] as c, i, sum(v[i]) as s, count(*) as n
      from a{i}, range(1, {width + 1}) t(i) group by 1, 2) group by c) n using (c))""")
    return ",".join(steps) + f"""
select vec_id, best[2]::int as cluster, best[1]::bigint as distance,
  (sum(best[1]) over (partition by best[2]))::bigint as cluster_inertia,
  (sum(best[1]) over ())::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a{rounds} join c{rounds} on c = best[2]"""


CENTROIDS = centroids()
