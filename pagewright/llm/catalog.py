"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, fingerprints, hmm, langid, mixing, ngram_join, quality, quotations, secrets, topk


def queries() -> dict:
    return {
        "op1_secrets": secrets.query,
        "op2_quality": quality.query,
        "op3_hmm": hmm.query,
        "op4_mixing": mixing.query,
        "op5_bpe": bpe.query,
        "op6_ngram_join": ngram_join.query,
        "op7_topk": topk.query,
        "op8_fingerprints": fingerprints.query,
        "op9_language_id": langid.query,
        "op10_quotations": quotations.query,
    }


_TOPK = """with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e)::bigint as score
  from v as q join v on q.vec_id % 50 = 0 and q.vec_id <> v.vec_id and len(q.e) = len(v.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""

_JOIN = r"""with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as l from documents),
sh as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(l) >= 5 then list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i : i + 4], ' ')) when len(l) > 0 then [array_to_string(l, ' ')] else [] end) as s from w)),
n as (select doc_id, count(*) as n from sh group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from sh as a join sh as b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from o join n as x on x.doc_id = a join n as y on y.doc_id = b where 100 * o >= 75 * (x.n + y.n - o)),
both_ways as (select a, b from links union select b, a from links),
reach(id, other) as (select doc_id, doc_id from documents union select id, b from reach join both_ways on other = a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least_id as component_id
from documents as d left join n using (doc_id) join (select id, min(other) as least_id from reach group by id) on id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """Of the two whose results SQL expresses; the others are tested against brute force, the library or held-out rows."""
    return {"op6_ngram_join": _JOIN, "op7_topk": _TOPK}
