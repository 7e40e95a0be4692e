"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from orrery.llm.bpe import op1_query
from orrery.llm.licenses import op4_query
from orrery.llm.minhash import op5_query
from orrery.llm.mixing import op8_query
from orrery.llm.sharding import op3_query
from orrery.llm.simhash import op6_query
from orrery.llm.suffixes import op9_query
from orrery.llm.toxicity import op7_query
from orrery.llm.vectors import op2_query
from orrery.llm.warc import op10_query

QUERIES = {
    "op1_bpe": op1_query,
    "op2_vector_graph": op2_query,
    "op3_histogram_shards": op3_query,
    "op4_license_scan": op4_query,
    "op5_order_minhash": op5_query,
    "op6_simhash": op6_query,
    "op7_toxicity": op7_query,
    "op8_source_mix": op8_query,
    "op9_suffix_dedup": op9_query,
    "op10_warc_zst": op10_query,
}

#: Every pair of vectors is compared, and links are followed to their end.
_VECTORS = """
with recursive held as (
    select vec_id, embedding::double[] as e, list_max(list_transform(embedding::double[], lambda x: abs(x))) as top from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scaled as (select vec_id, list_transform(e, lambda x: x / top) as e from held where top > 0
), unit as (select vec_id, e, sqrt(list_inner_product(e, e)) as n from scaled
), links as (
    select a.vec_id as a, b.vec_id as b from unit a join unit b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95
), reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a
), least as (select a, min(b) as component_id from reach group by a
), degree as (select a, count(*) as n_links from links group by a)
select v.vec_id, coalesce(d.n_links, 0)::bigint as n_links, c.component_id, v.vec_id = c.component_id as kept
from embeddings v join least c on v.vec_id = c.a left join degree d on v.vec_id = d.a
"""

#: Boundaries by the running sum over all keys; the CRC by half bytes, the lower first, with its table made by the rule.
_SHARDS = """
with crc as (
    select list_transform(range(0, 16), lambda n: list_reduce(range(0, 4), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as t
), sized as (
    select doc_id, coalesce(text, '') as text, octet_length(encode(coalesce(text, ''))) + 1 as size, md5(coalesce(text, '')) as h from documents
), keyed as (
    select doc_id, text, size, (('0x' || substr(h, 1, 9))::bigint << 24) + ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':' || h), 1, 6))::bigint as key from sized
), keys as (select key, sum(size)::bigint as size from keyed group by key
), placed as (select key, size, sum(size) over (order by key)::bigint - size as below, sum(size) over ()::bigint as total from keys
), dealt as (select key, len(list_filter(range(1, 8), lambda i: total * i / 8.0::double <= below + size / 2.0::double))::int as shard from placed
), distinct_texts as (select distinct text from keyed
), halves as (select text, hex(encode(text)) as h from distinct_texts
), bytes as (select text, list_transform(range(0, len(h)), lambda i: ('0x' || substr(h, i + 2 - 2 * (i % 2), 1))::bigint) as b from halves
), summed as (select text, xor(list_reduce(b, lambda c, x: xor(c >> 4, t[xor(c, x) % 16 + 1]), 4294967295), 4294967295)::bigint as text_crc32 from bytes, crc)
select k.doc_id, k.size::bigint as size, s.text_crc32, 'bytes' as law, d.shard,
    (row_number() over (partition by d.shard order by k.key, k.doc_id nulls first) - 1)::bigint as slot, null::int as grown_shard
from keyed k join dealt d using (key) join summed s using (text)
"""

#: The level of the targets by the running sums over sources, the limits by the running sums over hashes.
_MIX = r"""
with d as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
        ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':' || coalesce(text, '')), 1, 15))::bigint as hash from documents
), sources as (select source, sum(size)::bigint as source_size from d group by source
), ranked as (select *, row_number() over (order by source nulls last) - 1 as rank from sources
), capped as (select *, [5, 2, 1][rank % 3 + 1]::double as weight, source_size * 2::double as cap from ranked
), ratios as (select *, cap / weight as ratio from capped
), levels as (
    select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
    from ratios window w as (order by ratio, rank rows between unbounded preceding and 1 preceding)
), final as (select level from levels where ratio > level order by ratio, rank limit 1
), targets as (select source, source_size, case when ratio <= level then cap else weight * (select level from final) end as target from levels
), plan as (select *, (case when source_size > 0 then floor(target / source_size) else 0 end)::int as repeats from targets
), rests as (select *, greatest(0, target - repeats * source_size) as rest from plan
), hashes as (select source, hash, sum(size)::bigint as size from d group by source, hash
), placed as (select *, sum(size) over (partition by source order by hash)::bigint - size as below from hashes
), borders as (
    select p.source, p.hash + (case when r.rest - p.below > p.size / 2::double then 1 else 0 end) as at
    from placed p join rests r on p.source is not distinct from r.source where p.below <= r.rest and p.below + p.size > r.rest
), limits as (
    select r.*, case when r.rest <= 0 then 0 when b.at is not null then b.at when r.rest >= greatest(r.source_size, 1) then 1::bigint << 60 else 0 end as most
    from rests r left join borders b on r.source is not distinct from b.source
)
select d.doc_id, d.size, l.source_size, l.target, (d.size * (l.repeats + (d.hash < l.most)::int))::bigint as taken, (l.repeats + (d.hash < l.most)::int)::int as repeats
from d join limits l on d.source is not distinct from l.source
"""

#: Digests by SHA-1, five hexadecimal digits at a time written as four characters of base32.
_ARCHIVES = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as kept from pages)
select page_id, octet_length(encode(html))::bigint as payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, ((i // 4) * 5 + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) % 32 + 1)::int, 1)), '') as payload_digest,
    case when page_id = kept then 'response' else 'revisit' end as record_type, case when page_id = kept then null else kept end as refers_to
from p
"""

#: The other queries rest on hashes, models or word alignments that SQL cannot express; tests hold them against brute force.
ORACLES: dict[str, str] = {"op2_vector_graph": _VECTORS, "op3_histogram_shards": _SHARDS, "op8_source_mix": _MIX, "op10_warc_zst": _ARCHIVES}
