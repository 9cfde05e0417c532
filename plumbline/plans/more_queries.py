"""Queries that combine operators: coverage, evidence, lineage, ingestion, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize
from plumbline.operators import coverage, evidence, families, predictions, similarity, trees
from plumbline.operators.graph import connected_components
from plumbline.plans import text_queries as texts
from plumbline.sources.bindings import SQL_REGIONS, SQL_TEXT, SQL_VECTORS, text_samples, vector_samples
from plumbline.sources.files import integrity_check as check_content
from plumbline.sources.tables import table


def _regions(spark, d):
    return similarity.seed_regions(vector_samples(spark, d))


def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    return coverage.coverage_gaps(_regions(spark, d))


def plan_collection(spark, d):
    return coverage.plan_collection(coverage_gaps(spark, d), 20)


def class_cap(spark, d):
    return coverage.class_cap(text_samples(spark, d), 50, 7).select("sample_id", "label")


def bootstrap_f1(spark, d):
    p = predictions.fold_predictions(vector_samples(spark, d))
    return coverage.bootstrap_f1(p, p.withColumn("pred", F.when(F.col("sample_id") % 8 == 0, F.col("label")).otherwise(F.col("pred"))))


def _members(h):
    least = h.filter("norm_sha is not null").groupBy("norm_sha").agg(F.min("sample_id").alias("family_id"), F.count("*").alias("n")).filter("n > 1")
    return h.join(least, "norm_sha").select("sample_id", "family_id")


def _detail(spark, d):
    h = texts._hashed(spark, d)
    return evidence.sample_detail(text_samples(spark, d), texts.quality_rules(spark, d), families.exact_families(h), _members(h), families.family_leaks(h))


def sample_detail(spark, d):
    return _detail(spark, d)


def narrative(spark, d):
    return evidence.narrative(_detail(spark, d))


def unverified_numbers(spark, d):
    """Numbers in document texts against the document's own measures (characters and id)."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.array(F.col("n_chars").cast("double"), F.col("doc_id").cast("double")).alias("known"))
    return evidence.unverified_numbers(docs, "text", "known").filter("unverified > 0").select("doc_id", "unverified")


def lineage_tree(spark, d):
    """Trees of the families of equal content: the longest text is the root."""
    h = texts._hashed(spark, d)
    edges = families.star_edges(h, "norm_sha").select("a", "b", F.lit(0).alias("rank"))
    nodes = _members(h).join(h.select("sample_id", F.col("n_chars").alias("area")), "sample_id")
    return evidence.lineage(edges, nodes)


#: How strong a relation is.
RELATION_RANK = {"exact": 3, "normalized": 2, "resized": 2, "near": 1}


def lineage_near(spark, d):
    """Trees of the families of copies and near copies along their strongest relations: exact before changed before near, then by likeness."""
    h = texts._hashed(spark, d)
    same = [families.star_edges(h, key).select("a", "b", "relation", F.lit(1.0).alias("likeness"), F.lit(1.0).alias("size_ratio")) for key in ("raw_sha", "norm_sha")]
    edges = same[0].unionByName(same[1]).unionByName(texts._near(spark, d).select("a", "b", "relation", F.col("jaccard").alias("likeness"), "size_ratio"))
    rank = F.coalesce(*[F.when(F.col("relation") == name, F.lit(n)) for name, n in RELATION_RANK.items()])
    forest = materialize(trees.maximum_spanning_forest(edges.withColumn("rank", rank), ["rank", "likeness", "size_ratio"]), "family-trees")
    nodes = connected_components(forest, "a", "b").select(F.col("node").alias("sample_id"), F.col("component").alias("family_id"))
    nodes = materialize(nodes.join(h.select("sample_id", F.col("n_chars").alias("area")), "sample_id"), "family-members")
    grown = evidence.lineage(forest.select("a", "b", (-F.col("rank")).alias("rank")), nodes)
    link = forest.select(F.col("a").alias("x"), F.col("b").alias("y"), "rank", F.round("likeness", 4).alias("likeness"))
    tied = grown.withColumns({"x": F.least("sample_id", "parent_id"), "y": F.greatest("sample_id", "parent_id")}).withColumns({c: F.when(F.col("parent_id").isNotNull(), F.col(c)) for c in ("x", "y")})
    return tied.join(link, ["x", "y"], "left").select("sample_id", "family_id", "parent_id", "depth", "rank", "likeness")


def stream_ingest(spark, d):
    from plumbline.streaming.ingest import run_to_end

    return run_to_end(spark, d).groupBy("sha").agg(F.count("*").alias("n"), F.count("copy_of").alias("copies"))


def integrity_check(spark, d):
    h = families.content_hash(text_samples(spark, d))
    return check_content(h.withColumn("text", F.when(F.col("sample_id") % 97 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))))


def audit_report(spark, d):
    from plumbline.plans.audit import report

    return report(spark, d)


QUERIES = {f.__name__: f for f in (coverage_gaps, plan_collection, class_cap, bootstrap_f1, sample_detail, narrative, unverified_numbers, lineage_tree, lineage_near, stream_ingest, integrity_check, audit_report)}

_GAPS = SQL_VECTORS + ", " + SQL_REGIONS + """, rg as (select * from vectors join regions using (sample_id)), ol as (select region, label, count(*) as n, count(*) filter (split = 'train') as n_train from rg group by all), tot as (select label, sum(n) as n_label from ol group by label),
 sz as (select region, sum(n) as size, sum(n_train) as train from ol group by region), mx as (select region, label, n, row_number() over (partition by region order by n desc, label) as r from ol),
 g as (select 'boundary_zone' as kind, region, label, round(1 - n / size::double, 6) as severity from mx join sz using (region) where r = 1 and n / size::double < 0.6
 union all select 'weak_mode', region, label, round(1 - n / n_label::double / 0.08::double, 6) from ol join tot using (label) where n / n_label::double < 0.08
 union all select 'evaluation_blind_spot', region, null, 1.0 from sz where train >= 15 and train = size union all select 'train_coverage_gap', region, null, 1.0 from sz where train = 0),
 s as (select *, round(case kind when 'boundary_zone' then 0.6 when 'weak_mode' then 0.5 when 'evaluation_blind_spot' then 0.55 else 0.8 end::double * (0.6::double + 0.4::double * severity), 6) as score from g),
 gaps as (select kind, region, label, severity, score, case when score >= 0.65 then 'high' when score >= 0.4 then 'medium' else 'low' end as priority from s)"""
_DETAIL = texts.HASHED + texts.QUALITY[len(texts.SQL_TEXT):] + ", leak as (with " + texts.ORACLES["family_leaks"].split("with ", 1)[1][len(texts.HASHED):].lstrip(", \n") + """),
 fam as (select sample_id, min(sample_id) over (partition by norm_sha) as family_id, count(*) over (partition by norm_sha) as n from hashed where norm_sha is not null),
 fnd as (select sample_id, string_agg(distinct finding || ':' || severity, ';' order by finding || ':' || severity) as findings from quality group by sample_id),
 detail as (select s.sample_id, label, split, findings, f.family_id, f.n as family_size, risk from samples s left join fnd using (sample_id) left join (select * from fam where n > 1) f on f.sample_id = s.sample_id left join leak l on l.family_id = f.family_id)"""
ORACLES = {
    "coverage_gaps": f"with {_GAPS} select * from gaps",
    "plan_collection": f"with {_GAPS} select kind, region, label, priority, case priority when 'high' then 100 when 'medium' then 50 else 20 end as quantity, 'open' as status from gaps order by score desc, kind, region, label nulls first limit 20",
    "class_cap": f"with {SQL_TEXT} select sample_id, label from (select *, row_number() over (partition by label order by md5('7|' || sample_id), sample_id) as r from samples) where r <= 50",
    "sample_detail": f"with {_DETAIL} select * from detail",
    "narrative": f"with {_DETAIL} select sample_id, 'Sample ' || sample_id || ': ' || case when findings is null and family_size is null then 'no issue found.' else concat_ws(', ', 'measured issues: ' || findings, 'one of ' || family_size || ' copies', 'copies cross splits at ' || risk || ' risk') || '.' end as text from detail",
    "unverified_numbers": """with n as (select doc_id, n_chars::double as a, doc_id::double as b, unnest(regexp_extract_all(coalesce(text, ''), '([0-9]+(?:\\.[0-9]+)?)', 1))::double as x from documents),
 s as (select * from n where x not in (0, 1, 2, 3) and abs(x - a) > greatest(0.02::double * a, 0.006) and abs(x - b) > greatest(0.02::double * b, 0.006) and abs(x - 100 * a) > greatest(2.0::double * a, 0.006) and abs(x - 100 * b) > greatest(2.0::double * b, 0.006)) select doc_id, count(*)::int as unverified from s group by doc_id""",
    "lineage_tree": f"""with {texts.HASHED}, m as (select sample_id, n_chars, min(sample_id) over (partition by norm_sha) as family_id, count(*) over (partition by norm_sha) as n from hashed where norm_sha is not null), f as (select * from m where n > 1),
 r as (select family_id, sample_id as root from (select *, row_number() over (partition by family_id order by n_chars desc, sample_id) as k from f) where k = 1)
 select sample_id, family_id, case when sample_id = root then null when sample_id = family_id then root else family_id end as parent_id, case when sample_id = root then 0 when root = family_id then 1 when sample_id = family_id then 1 else 2 end as depth from f join r using (family_id)""",
    "lineage_near": f"""with recursive {texts.NEAR}, stars as (select min(sample_id) over (partition by raw_sha) as a, sample_id as b, 3 as rank from hashed where raw_sha is not null union all select min(sample_id) over (partition by norm_sha), sample_id, 2 from hashed where norm_sha is not null),
 every as (select a, b, rank, 1.0::double as likeness, 1.0::double as size_ratio from stars where a <> b union all
  select a, b, case when x.raw_sha = y.raw_sha then 3 when x.norm_sha = y.norm_sha then 2 when size_ratio < 0.97 then 2 else 1 end, jaccard, size_ratio from near join hashed x on x.sample_id = a join hashed y on y.sample_id = b),
 e as (select *, row_number() over (order by rank desc, likeness desc, size_ratio desc, a, b) as k from (select *, row_number() over (partition by a, b order by rank desc, likeness desc, size_ratio desc) as pick from every) where pick = 1),
 both_ways as (select a as u, b as v, k from e union all select b, a, k from e),
 family(sample_id, r) as (select a, a from e union select b, b from e union select w.v, f.r from family f join both_ways w on w.u = f.sample_id),
 members as (select sample_id, min(r) as family_id from family group by sample_id),
 reach(k, node) as (select k, a from e union select r.k, w.v from reach r join both_ways w on w.u = r.node and w.k < r.k),
 tree as (select e.* from e left join reach on reach.k = e.k and reach.node = e.b where reach.k is null),
 ways as (select a as u, b as v, rank, likeness from tree union all select b, a, rank, likeness from tree),
 roots as (select sample_id, family_id from (select m.*, row_number() over (partition by family_id order by n_chars desc, sample_id) as i from members m join samples using (sample_id)) where i = 1),
 grown(sample_id, family_id, parent_id, depth, rank, likeness) as (select sample_id, family_id, null::bigint, 0, null::integer, null::double from roots union all select w.v, g.family_id, g.sample_id, g.depth + 1, w.rank, w.likeness from grown g join ways w on w.u = g.sample_id and (g.parent_id is null or w.v <> g.parent_id))
 select sample_id, family_id, parent_id, depth, rank, round(likeness, 4) as likeness from grown""",
    "stream_ingest": "select sha256(coalesce(text, '')) as sha, count(*) as n, count(*) - 1 as copies from documents group by 1",
    "integrity_check": "select count(*) as n, count(*) filter (doc_id % 97 = 0) as changed from documents",
}
