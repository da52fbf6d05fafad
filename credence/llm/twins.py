"""DuckDB twins of the corpus queries that SQL can express in full, over the whole tables."""

from __future__ import annotations

from credence.llm import licenses

_LOWER = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _licenses() -> str:
    """Every rule on every text, without any keyword gate; suppression by comparing all detections of a text."""
    rules = ", ".join(f"({i}, {_text(r.label)}, {_text(licenses.bound(r.pattern))}, {r.priority}, {r.weight}::double)" for i, r in enumerate(licenses.rules()))
    base = ", ".join(f"({_text(label)}, {_text(licenses.bound(phrase))})" for label, phrase in licenses.BASE)
    blanks = lambda c: f"(length({c}) - length(replace({c}, ' ', ''))) // 2"
    places = f"""
      select *, list_transform(string_split_regex(line, pattern), lambda x: {blanks("x")}) as gaps, list_transform(regexp_extract_all(line, pattern), lambda x: {blanks("x")}) as sizes
      from found where regexp_matches(line, pattern)"""
    spread = "list_sum(gaps[:k]) + coalesce(list_sum(sizes[:k - 1]), 0)"
    return f"""
with padded as (
  select row_number() over () as rid, doc_id, regexp_replace(' ' || {_LOWER} || ' ', '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g') as p from documents
), docs as (select rid, doc_id, substring(p, 2, length(p) - 2) as line from padded)
, rules(i, label, pattern, p, w) as (values {rules})
, base(label, pattern) as (values {base})
, hits as (
  with found as (select rid, line, rules.* from docs, rules), placed as ({places}), each_ as (select *, unnest(range(1, len(sizes) + 1)) as k from placed)
  select rid, i, label, p, w, ({spread})::bigint as s, ({spread} + sizes[k])::bigint as e from each_
), kept as (
  select * from hits h where not exists (
    select 1 from hits o where o.rid = h.rid and o.i <> h.i and o.s <= h.s and o.e >= h.e
    and (o.p < h.p or (o.p = h.p and (o.e - o.s > h.e - h.s or (o.e - o.s = h.e - h.s and o.i < h.i))))
  )
), base_hits as (
  with found as (select rid, line, base.* from docs, base), placed as ({places}), each_ as (select *, unnest(range(1, len(sizes) + 1)) as k from placed)
  select rid, label, ({spread})::bigint as s from each_
), base_of as (
  select rid, count(*) as n, min(s) as first_word, max(s) as last_word, string_agg(distinct label, ',' order by label) as labels from base_hits group by rid
), labels_of as (
  select rid, string_agg(distinct label, ',' order by label) as labels from (select rid, label from base_hits union select rid, label from kept) group by rid
), best as (select rid, max(w) as w from kept group by rid)
select doc_id, ({blanks("line")})::bigint as n_words, coalesce(n, 0)::bigint as n_base, first_word, last_word, coalesce(base_of.labels, '') as base_labels,
  coalesce(labels_of.labels, '') as labels, greatest(coalesce(w, 0.0), case when n > 0 then 0.5 else 0.0 end)::double as score
from docs left join base_of using (rid) left join labels_of using (rid) left join best using (rid)"""


NEAREST = """
with valid as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(embedding, lambda x: x <> 0)) > 0
), asked as (select vec_id, min(v) as v from valid where vec_id % 20 = 0 group by vec_id)
, scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score
  from asked q join valid c on c.vec_id <> q.vec_id and len(c.v) = len(q.v)
)
select query_id, rank, vec_id, score from (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from scored
) where rank <= 20"""

JACCARD = f"""
with recursive docs as (
  select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents
), words as (select rid, len(w) as n, unnest(w) as x, unnest(range(len(w))) as i from docs)
, runs as (
  select rid, n, i, x || ' ' || lead(x, 1) over o || ' ' || lead(x, 2) over o || ' ' || lead(x, 3) over o || ' ' || lead(x, 4) over o as x
  from words window o as (partition by rid order by i)
), shingles as (
  select distinct rid, x from runs where i <= n - 5
  union all select rid, array_to_string(w, ' ') from docs where len(w) between 1 and 4
), sets as (select docs.rid, doc_id, count(x) as n from docs left join shingles on docs.rid = shingles.rid group by docs.rid, doc_id)
, links as (
  select a, b from (select l.rid as a, r.rid as b, count(*) as shared from shingles l join shingles r on l.x = r.x and l.rid <> r.rid group by all)
  join sets p on p.rid = a join sets q on q.rid = b where 100 * shared >= 80 * (p.n + q.n - shared)
), reach as (
  select rid as a, rid as b from sets union select reach.a, links.b from reach join links on reach.b = links.a
)
select m.doc_id, m.n::bigint as n_shingles, min(o.doc_id) as component_id
from reach join sets m on m.rid = reach.a join sets o on o.rid = reach.b group by m.rid, m.doc_id, m.n"""

SHARDS = """
with recursive docs as (
  select doc_id, coalesce(text, '') as t, octet_length(encode(coalesce(text, ''))) + 1 as size, sha256(coalesce(text, '')) as digest from documents
), ends as (
  select list(c order by c) as l, max(c) as total from (
    select sum(sum(size)) over (order by digest)::bigint as c from docs group by digest)
), search(lo, hi) as (
  select ((total + 7) // 8)::bigint, total::bigint from ends
  union all
  select case when fits then lo else mid + 1 end, case when fits then mid else hi end from (
    select lo, hi, mid, list_reduce([0::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda pos, x: coalesce(list_max(list_filter(l, lambda c: c <= pos + mid)), pos)) >= total as fits
    from (select lo, hi, (lo + hi) // 2 as mid from search where lo < hi), ends)
), best as (select min(hi) as capacity from search)
, cuts as (
  select list_transform(range(1, 9), lambda n: list_reduce(list_transform(range(0, n + 1), lambda z: 0::bigint), lambda pos, x: coalesce(list_max(list_filter(l, lambda c: c <= pos + capacity)), pos))) as k
  from ends, best
), ended as (select digest, sum(sum(size)) over (order by digest) as c from docs group by digest)
, placed as (
  select docs.*, len(list_filter(k, lambda x: x < c))::int as shard from docs join ended using (digest), cuts
), crc as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t
)
select doc_id, size::bigint as size,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(placed.t)), '..'), lambda h: ('0x' || h)::bigint)),
    lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)::bigint as text_crc32,
  'bytes' as law, shard, (row_number() over (partition by shard order by digest, doc_id nulls first, size) - 1)::bigint as slot, null::int as grown_shard
from placed, crc"""

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": _licenses(),
    "op5_block_matrix_ann": NEAREST,
    "op6_ngram_jaccard": JACCARD,
    "op9_minimax_shards": SHARDS,
}
