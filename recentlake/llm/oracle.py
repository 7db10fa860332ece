"""DuckDB SQL of the training-data queries that SQL can express."""

from recentlake.llm.mixing import BUCKET_DIGITS, MAX_REPEATS, SLOPES, WEIGHTS  # noqa: F401

_MIX = f"""
with sized as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))) as order_key,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size
  from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size,
         row_number() over (order by source nulls last) - 1 as rank
  from sized group by source
), weighted as (
  select *, cast([{', '.join(map(str, WEIGHTS))}][rank % {len(WEIGHTS)} + 1] as bigint) as weight,
         cast([{', '.join(map(str, SLOPES))}][rank % {len(SLOPES)} + 1] as double) as slope
  from sources
), levels as (
  select *, {MAX_REPEATS} * source_size as cap,
         sum(source_size) over () - coalesce(sum({MAX_REPEATS} * source_size) over before, 0) as rest,
         sum(weight) over () - coalesce(sum(weight) over before, 0) as weights
  from weighted
  window before as (order by source_size / weight, rank rows between unbounded preceding and 1 preceding)
), flagged as (
  select *, cap * weights < rest * weight as capped from levels
), free as (
  select max(struct_pack(w := weights, r := rest)) as f from flagged where not capped
), targets as (
  select source, source_size, slope,
         case when capped then cast(cap as double) else cast(weight * f.r as double) / cast(f.w as double) end as target
  from flagged, free
), placed as (
  select s.doc_id, s.size, t.source_size, t.target, t.slope,
         coalesce(sum(size) over (partition by s.source order by order_key, doc_id
                                  rows between unbounded preceding and 1 preceding), 0) as start
  from sized s join targets t on s.source is not distinct from t.source
), counted as (
  select *, case when size > 0 then len(list_filter([{', '.join(f'({2 * e} * source_size + 2 * start + size) / 2.0' for e in range(MAX_REPEATS))}],
                                                    lambda m: m < target)) else 0 end as copies,
         ((2 * start + size) / 2.0) / target as u
  from placed
)
select doc_id, size, source_size, target, cast(copies * size as bigint) as taken,
       case when copies > 0 then case when slope = 0 then u else
         (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) end end as first_position
from counted
"""

_REPEATS = r"""
with split as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), starts as (
  select doc_id, unnest(range(1, len(words) - 11)) as i, words from split
), windows as (
  select doc_id, i, array_to_string(words[i:i + 12], ' ') as w from starts
), firsts as (
  select w, min(doc_id) as first from windows group by w
), gone as (
  select distinct doc_id, unnest(range(i, i + 13)) as i from windows join firsts using (w) where first < doc_id
), gone_lists as (
  select doc_id, list(i) as gone from gone group by doc_id
), kept as (
  select s.doc_id, words, coalesce(gone, []) as gone from split s left join gone_lists using (doc_id)
), flagged as (
  select doc_id, len(words) as n_words, len(gone) as n_removed,
         case when len(gone) = 0 then words
              else (select list(words[x] order by x) from (select unnest(range(1, len(words) + 1)) as x) where not list_contains(gone, x)) end as left_words
  from kept
)
select doc_id, cast(n_words as bigint) as n_words, cast(n_removed as bigint) as n_removed,
       sha256(array_to_string(coalesce(left_words, []), ' ')) as kept_sha256
from flagged
"""

_LINKED = r"""
with recursive split as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as words
  from documents
), listed as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
         else list_distinct([array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)]) end as shingles
  from split
), tokens as (
  select doc_id, len(shingles) as n, unnest(shingles) as shingle from listed
), pairs as (
  select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as common
  from tokens a join tokens b on a.shingle = b.shingle and a.doc_id <> b.doc_id
    and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n
  group by all
), links as (
  select a, b from pairs where 100 * common >= 80 * (na + nb - common)
), reach(a, b) as (
  select a, b from links
  union
  select r.a, l.b from reach r join links l on r.b = l.a
), smallest as (
  select a, min(b) as b from reach group by a
)
select doc_id, cast(len(shingles) as bigint) as n_shingles, least(doc_id, coalesce(b, doc_id)) as component_id
from listed left join smallest on doc_id = a
"""

_ARCHIVE = r"""
with hashed as (
  select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as digest from pages
), best as (
  select digest, max(page_id) as last from hashed group by digest
)
select page_id, url, cast(strlen(html) as bigint) as payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(digest, 10 * (x // 8) + 1, 10) as ubigint)
                               >> (35 - 5 * (x % 8))) & 31 as integer), 1) for x in range(0, 32)], '') as payload_digest,
       case when page_id < last then 'revisit' else 'response' end as record_type,
       case when page_id < last then last end as refers_to
from hashed join best using (digest)
"""

_STATISTICS = r"""
with split as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), windows as (
  select doc_id, i, array_to_string(words[i:i + 4], ' ') as w
  from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from split where len(words) >= 5)
), twice as (
  select doc_id, i from windows qualify count(*) over (partition by doc_id, w) > 1
), repeated as (
  select doc_id, count(distinct i + j) as n from twice, range(0, 5) as r(j) group by doc_id
), counted as (
  select doc_id, cast(len(words) as bigint) as n_words,
         cast(coalesce(list_sum([length(w) for w in words]), 0) as bigint) as word_chars,
         cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines
  from (select *, [l for l in string_split(text, chr(10)) if regexp_matches(l, '[^\x20\x09-\x0D]')] as lines from split)
)
select c.*, coalesce(n, 0) as n_repeat_words, n_words < 10 or 100 * coalesce(n, 0) > 20 * n_words as base_failed
from counted c left join repeated r using (doc_id)
"""

SQL = {"op3_shingle_join": _LINKED, "op4_warc_archive": _ARCHIVE, "text_statistics": _STATISTICS,
       "op5_repeated_spans": _REPEATS, "op10_mix_sources": _MIX}


def _clusters_sql() -> str:
    """K-means as one statement: a pair of subqueries for each round."""
    from recentlake.llm.hadamard_clusters import CENTROIDS, DIM, LARGEST, ROUNDS, SCALE, SEED

    parts = [f"""
with kept as (
  select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * greatest(least(cast(x as double), {LARGEST} / {SCALE}), -{LARGEST} / {SCALE})) as bigint)) as v,
         row_number() over () as id
  from embeddings
  where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as (
  select row_number() over (order by sha256('{SEED}:' || coalesce(cast(vec_id as varchar), 'null')), v) - 1 as cluster, v as c
  from kept qualify cluster < {CENTROIDS}
)"""]
    distance = f"list_sum(list_transform(range(1, {DIM + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    for r in range(ROUNDS + 1):
        parts.append(f""", a{r} as materialized (
  select id, any_value(vec_id) as vec_id, any_value(v) as v, min(d) as distance, arg_min(cluster, (d, cluster)) as cluster
  from (select kept.*, cluster, cast({distance} as bigint) as d from kept, c{r}) group by id
)""")
        if r < ROUNDS:
            parts.append(f""", m{r} as (
  select cluster, list(((s - ((s % n) + n) % n) // n) order by i) as m
  from (select cluster, i, sum(v[i]) as s, count(*) as n from a{r}, (select unnest(range(1, {DIM + 1})) as i) group by cluster, i) group by cluster
), c{r + 1} as materialized (
  select cluster, coalesce(m, c) as c from c{r} left join m{r} using (cluster)
)""")
    parts.append(f"""
select vec_id, cast(cluster as integer) as cluster, distance,
       cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia,
       sha256(array_to_string(list_transform(c, lambda x: cast(cast(x as bigint) as varchar)), ',')) as centroid_sha256
from a{ROUNDS} join c{ROUNDS} using (cluster)""")
    return "".join(parts)


SQL["op11_hadamard_clusters"] = _clusters_sql()
