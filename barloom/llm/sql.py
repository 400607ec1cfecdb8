"""SQL of the operators that SQL can express, for DuckDB."""

EXACT_TOP_K = """
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as query_id, b.vec_id as vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
  from usable a join usable b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

NEAR_DUPLICATES = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda v: v <> '') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then []
                      when len(w) = 1 then [w[1]]
                      else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
  from words
), items as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
shared as (
  select x.doc_id as a, y.doc_id as b, x.n as na, y.n as nb, count(*) as c
  from items x join items y on x.shingle = y.shingle and x.doc_id < y.doc_id
    and 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
  group by all
), links as (
  select a, b from shared where 100 * c >= 80 * (na + nb - c)
), both_ways as (select a, b from links union all select b, a from links),
reach as (
  select distinct a as doc_id, a as root from both_ways
  union
  select l.b, r.root from reach r join both_ways l on l.a = r.doc_id where r.root < l.b
), least_root as (select doc_id, min(root) as root from reach group by doc_id)
select s.doc_id, len(s.s) as n_shingles, coalesce(least(r.root, s.doc_id), s.doc_id) as component_id,
       s.doc_id = coalesce(least(r.root, s.doc_id), s.doc_id) as kept
from sets s left join least_root r using (doc_id)
"""

_USABLE = """usable as (
  select vec_id, label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)"""

HARD_NEGATIVES = f"""
with {_USABLE}, rows_ as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, q
  from usable where vec_id is not null and label is not null
), scored as (
  select a.vec_id as anchor_id, b.vec_id as vec_id, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score
  from rows_ a join rows_ b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), negatives as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
         cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as integer) as rank
  from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
    and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from negatives where rank <= 3
"""


def _round(n: int) -> str:
    """Parts assigned to the nearest entries of codebook ``n`` and the next codebook."""
    return f"""
assigned{n} as (
  select r.row, r.p, r.v, c.e, list_inner_product(r.v, r.v) - 2 * list_inner_product(r.v, c.v) + list_inner_product(c.v, c.v) as d
  from parts r join book{n} c on c.p = r.p
  qualify row_number() over (partition by r.row, r.p order by d, c.e) = 1
), means{n} as (
  select p, e, list(m order by i) as v
  from (select p, e, i, floor(sum(v[i]) / count(*)) as m from assigned{n}, range(1, len(v) + 1) t(i) group by p, e, i)
  group by p, e
), book{n + 1} as (select b.p, b.e, coalesce(m.v, b.v) as v from book{n} b left join means{n} m on m.p = b.p and m.e = b.e)"""


PRODUCT_CODES = f"""
with {_USABLE}, numbered as (select *, row_number() over (order by vec_id) - 1 as row from usable),
parts as (
  select row, p, q[p * (len(q) // 16) + 1 : (p + 1) * (len(q) // 16)] as v from numbered, range(16) t(p)
), book0 as (select p, row as e, v from parts where row < 64),
{_round(0)}, {_round(1)}, {_round(2)},
coded as (
  select n.vec_id, n.label, string_agg(lower(printf('%02x', a.e)), '' order by a.p) as code, cast(sum(a.d) as bigint) as error
  from assigned2 a join numbered n on n.row = a.row group by n.row, n.vec_id, n.label
), digest as (
  select sha256(string_agg(cast(cast(v[i] as bigint) as varchar), ',' order by p, e, i)) as codebooks_sha256
  from book2, range(1, len(v) + 1) t(i)
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded, digest
"""
