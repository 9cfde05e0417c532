"""Neighbours by an index, mirrored hashes, and what findings two versions share."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import families, hash_pairs, neighbors
from plumbline.plans import text_queries as texts
from plumbline.plans import vector_queries as vectors
from plumbline.sources.bindings import vector_samples


def knn_cells(spark, d):
    """Neighbours by cells and rings; equal to the join of all blocks."""
    v = vector_samples(spark, d).select("sample_id", "embedding")
    return neighbors.nearest(v, v, vectors.K)


def mirrored_sign_pairs(spark, d):
    """Vectors whose first 64 signs differ in 15 places or fewer, read forwards or one of them backwards; equal vectors are copies, whose smallest id stands for all."""
    bits = lambda v: F.aggregate(F.transform(v, lambda x: F.when(x >= 0, F.expr("1L")).otherwise(F.expr("0L"))), F.lit(0).cast("bigint"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))
    v = vector_samples(spark, d).select("sample_id", "embedding", F.slice("embedding", 1, 64).alias("v"))
    return hash_pairs.mirrored_pairs(v.select("sample_id", bits(F.col("v")).alias("hash"), bits(F.reverse("v")).alias("flip"), "embedding"), 15, content="embedding")


def version_findings(spark, d):
    """Families of copies and near copies, leaks between splits and label conflicts that two versions share, lose or gain."""
    before, after = texts._versions(spark, d)
    h = texts._hashed(spark, d)
    name = lambda x: h.select(F.col("sample_id").alias(x), F.col("norm_sha").alias(f"{x}_sha"))
    near = texts._near(spark, d).select("a", "b").join(name("a"), "a").join(name("b"), "b").select(F.col("a_sha").alias("a"), F.col("b_sha").alias("b"))
    return families.findings_between(before, after, near)


QUERIES = {f.__name__: f for f in (knn_cells, mirrored_sign_pairs, version_findings)}

_FINDINGS = texts.NEAR + """, ver as (select unnest(['x', 'y']) as v), m as (select v, h.* from ver join hashed h on (v = 'x' and sample_id % 5 <> 0) or (v = 'y' and sample_id % 5 <> 1) where norm_sha is not null),
 nodes as (select distinct v, norm_sha from m),
 links as (select distinct p.v, x.norm_sha as a, y.norm_sha as b from near join hashed x on x.sample_id = near.a join hashed y on y.sample_id = near.b join nodes p on p.norm_sha = x.norm_sha join nodes q on q.norm_sha = y.norm_sha and q.v = p.v),
 both_ways as (select v, a, b from links union select v, b, a from links),
 reach as (select distinct v, a as node, a as seen from both_ways union select r.v, r.node, l.b from reach r join both_ways l on l.v = r.v and l.a = r.seen),
 comp as (select v, node, min(seen) as g from reach group by all),
 grouped as (select m.v, coalesce(g, norm_sha) as g, sample_id, raw_sha, split, label from m left join comp on comp.v = m.v and node = norm_sha),
 kinds as (select v, g, count(*) as n, count(distinct split) > 1 as leak, count(distinct label) > 1 as conflict from grouped group by all having count(*) > 1),
 sig as (select v, g, concat_ws('-', count(*), sum(('0x' || substr(raw_sha, 1, 15))::bigint), bit_xor(('0x' || substr(raw_sha, 1, 15))::bigint)) as signature from (select distinct v, g, raw_sha from grouped) group by all),
 f as (select v, kind, signature, n from kinds join sig using (v, g) join (select unnest(['family', 'leak', 'label_conflict']) as kind) on kind = 'family' or (kind = 'leak' and leak) or (kind = 'label_conflict' and conflict)),
 x as (select * from f where v = 'x'), y as (select * from f where v = 'y')
"""
_BITS = "array_to_string(list_transform({}, lambda x: (x >= 0)::int), '')::bit"
ORACLES = {
    "knn_cells": f"with {vectors.KNN} select sample_id, neighbor_id, sim, rk from knn",
    "mirrored_sign_pairs": f"""with s as (select vec_id, embedding, {_BITS.format('embedding[1:64]')} as h, {_BITS.format('list_reverse(embedding[1:64])')} as f from embeddings), r as (select *, min(vec_id) over (partition by embedding) as root from s),
 p as (select x.vec_id as a, y.vec_id as b, bit_count(xor(x.h, y.h)) as distance, least(bit_count(xor(x.h, y.f)), bit_count(xor(x.f, y.h))) as mirror_distance from r x join r y on x.vec_id < y.vec_id and (x.root = y.root and x.root = x.vec_id or x.root <> y.root and x.root = x.vec_id and y.root = y.vec_id))
 select a, b, distance, mirror_distance from p where least(distance, mirror_distance) <= 15""",
    "version_findings": f"with recursive {_FINDINGS} select coalesce(x.kind, y.kind) as kind, coalesce(x.signature, y.signature) as signature, case when x.kind is null then 'new' when y.kind is null then 'resolved' else 'persisting' end as status, x.n as n_before, y.n as n_after from x full join y on x.kind = y.kind and x.signature = y.signature",
}
