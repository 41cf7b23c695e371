"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from gazeledger.llm import decontaminate, divergence

_REACH = """reach as (select id as a, id as b from nodes union select r.a, l.b from reach r join links l on l.a = r.b),
parts as (select a as id, min(b) as component_id from reach group by a)"""

# base 32 of a SHA-1: eight groups of five hex digits, four letters each
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
 cast(((cast('0x' || substr(sha, cast(i // 4 * 5 + 1 as bigint), 5) as bigint) >> cast(15 - i % 4 * 5 as bigint)) & 31) + 1 as bigint), 1)), '')"""

WARC = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages),
k as (select *, max(page_id) over (partition by html) as top from p)
select page_id, cast(strlen(html) as bigint) as payload_bytes, {_BASE32} as payload_digest,
 case when page_id is not distinct from top or top is null then 'response' else 'revisit' end as record_type,
 case when page_id is distinct from top and top is not null then top end as refers_to from k"""

EMBEDDINGS = f"""
with recursive nodes as (select vec_id as id, cast(embedding as double[]) as v from embeddings),
good as (select * from nodes where v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
links as (select x.id as a, y.id as b from good x join good y on x.id <> y.id and len(x.v) = len(y.v)
 where list_cosine_similarity(x.v, y.v) >= 0.9),
{_REACH}
select id as vec_id, (select count(*) from links where a = id) as n_links, component_id, id = component_id as kept from parts"""

NEAR_TEXT = rf"""
with recursive nodes as (select doc_id as id,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select distinct id, unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) as s
 from nodes where len(w) > 0),
sizes as (select id, count(*) as n from sets group by id),
links as (select x.id as a, y.id as b from sets x join sets y on x.s = y.s and x.id <> y.id
 join sizes p on p.id = x.id join sizes q on q.id = y.id group by x.id, y.id, p.n, q.n
 having 100 * count(*) >= 85 * (p.n + q.n - count(*))),
{_REACH}
select r.id as doc_id, coalesce(n, 0) as n_shingles, component_id, r.id = component_id as kept from parts r left join sizes z on z.id = r.id"""

ORACLES = {
    "op3_decontaminate": decontaminate.oracle(),
    "op5_warc": WARC,
    "op8_embeddings": EMBEDDINGS,
    "op9_near_text": NEAR_TEXT,
    "op11_divergence": divergence.ORACLE,
}
