"""Views with totals, cue predictability, holdouts, replays, masking, and an overview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize, scratch_path
from plumbline.operators import coverage, families, governance, metrics, predictions, profile, shortcuts, similarity, views
from plumbline.plans import more_queries as more
from plumbline.plans import review_queries as review
from plumbline.plans import text_queries as texts
from plumbline.plans import vector_queries as vectors
from plumbline.sources.bindings import SQL_REGIONS, SQL_TEXT, SQL_VECTORS, text_samples, vector_samples
from plumbline.sources.files import manifest_digest, write_findings


def cue_predictability(spark: SparkSession, d: str) -> DataFrame:
    return shortcuts.cue_predictability(profile.cues(texts._attributes(spark, d)))


def list_quality(spark, d):
    """The second page of the medium and high quality findings, twenty a page, with their total."""
    found = views.matching(texts.quality_rules(spark, d), equals={"severity": ["medium", "high"]})
    return views.page(found.select("sample_id", "finding", "severity", "value"), [F.col("severity"), F.col("finding"), F.col("sample_id"), F.col("value")], limit=20, offset=20)


def list_leakage(spark, d):
    """Leaks by risk, then size."""
    leaks = families.family_leaks(texts._hashed(spark, d))
    return views.page(leaks.select("family_id", "size", "kind", "risk"), [F.desc(views.risk_rank()), F.desc("size"), F.col("family_id")], limit=300)


def list_privacy(spark, d):
    found = views.matching(profile.privacy_scan(text_samples(spark, d)), equals={"kind": ["email", "phone"]})
    return views.page(found, [F.desc("n"), F.col("kind"), F.col("sample_id")], limit=25)


def list_samples_page(spark, d):
    """Test samples whose source holds a part of a name, with the worth of their finding."""
    s = views.matching(text_samples(spark, d).select("sample_id", "label", "split", "source", "n_chars"), equals={"split": ["test"]}, like={"source": "SRC1"})
    worst = texts.quality_rules(spark, d).groupBy("sample_id").agg(F.count("*").alias("findings"))
    return views.page(s.join(worst, "sample_id", "left"), [F.desc_nulls_last("findings"), F.col("sample_id")], limit=50, offset=0)


def _listed_cases(spark, d):
    """Numbered cases with what they can be listed by; the status follows the decisions on the case of their number."""
    from plumbline.operators import review
    from plumbline.sources.bindings import decisions

    v = materialize(vectors._verdicts(spark, d).select("sample_id", "verdict", "categories", "codes", "label", "split", "uncertainty", "priority", "impact"), "verdicts")
    numbers = materialize(vectors.case_numbers(spark, d).select("sample_id", "case_no"), "case-numbers")
    status = review.case_status(review.active_decisions(decisions(spark, d))).select(F.col("case_id").alias("case_no"), "status")
    sha = vector_samples(spark, d).select("sample_id", F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: F.when(x >= 0, "1").otherwise("0"))), 256).alias("sha"))
    path = F.concat_ws("/", "split", F.col("label").cast("string"), F.concat(F.lit("V"), F.col("sample_id").cast("string"), F.lit(".vec")))
    rows = v.join(numbers, "sample_id").join(status, "case_no", "left").join(sha, "sample_id").withColumn("status", F.coalesce("status", F.lit("open")))
    return rows.select("case_no", "sample_id", "verdict", "status", "categories", "codes", "label", "split", "uncertainty", F.lit(None).cast("bigint").alias("family_id"), path.alias("path"), "sha", F.round("priority", 4).alias("priority"), F.round("impact", 6).alias("impact"), F.lit(None).cast("timestamp").alias("updated_at"))


def list_cases(spark, d):
    """Undecided cases of evaluation samples with a doubtful label, the highest impact first: the second page."""
    page = views.list_cases(_listed_cases(spark, d), {"verdict": ["STRONG_REVIEW", "REVIEW", "POSSIBLE_RELABEL"], "category": "label", "split": "test"}, search="/V", sort="impact", limit=20, offset=5)
    return page.select("case_no", "sample_id", "verdict", "status", "priority", "total")


def case_facets(spark, d):
    c = vectors._verdicts(spark, d)
    return views.facets(c, "verdict", "uncertainty", "rule")


def label_findings_page(spark, d):
    """Samples to review, the most suspicious first, with their number."""
    e = views.matching(vectors._evidence(spark, d), equals={"action": ["REVIEW", "LIKELY_RARE", "LOW_PRIORITY_REVIEW"]})
    return views.page(e.select("sample_id", F.round("suspicion", 6).alias("suspicion"), "action"), [F.desc("suspicion"), F.col("sample_id")], limit=40)


def cartography(spark, d):
    """Categories of training dynamics, with mean confidence and variability."""
    t = metrics.dynamics(predictions.learning_trajectory(vector_samples(spark, d)))
    return t.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("confidence") + 1e-9, 6).alias("confidence"), F.round(F.avg("variability") + 1e-9, 6).alias("variability"))


def hardest(spark, d):
    """The 24 samples whose labels the model believed least while learning."""
    t = metrics.dynamics(predictions.learning_trajectory(vector_samples(spark, d)))
    return t.orderBy("confidence", "sample_id").limit(24).select("sample_id", "confidence", "category")


def gap_anchors(spark, d):
    """For each region with a coverage gap its six densest samples."""
    v = similarity.seed_regions(vectors._vectors(spark, d))
    members = v.select("sample_id", "region").join(similarity.local_density(vectors._knn(spark, d), 5), "sample_id").withColumn("density", F.round("density", 6))
    return coverage.anchors(coverage.coverage_gaps(v), members, "region")


def holdout(spark, d):
    """Documents for measuring a change: in evaluation, not decided upon, in no leaking family."""
    s = text_samples(spark, d)
    touched = review._status(spark, d).filter("final is not null").select(F.col("case_id").alias("sample_id"))
    h = texts._hashed(spark, d)
    leaking = families.family_leaks(h).select("family_id")
    least = h.groupBy("norm_sha").agg(F.min("sample_id").alias("family_id"))
    leaked = h.join(least, "norm_sha").join(leaking, "family_id", "left_semi")
    return coverage.holdout(s, touched, leaked).groupBy("split", "label").agg(F.count("*").alias("n"))


def failure_replay(spark, d):
    """What becomes of the failures once planted label errors are not learned from."""
    v = vectors._planted(spark, d)
    return predictions.failure_replay(v.drop("wrong"), v.filter("wrong"))


def masked_accuracy(spark, d):
    return predictions.masked_accuracy(vector_samples(spark, d))


def contract_includes(spark, d):
    """Splits and languages that a version must have."""
    s = text_samples(spark, d)
    sets = F.array(F.struct(F.lit("splits").alias("metric"), F.col("split").alias("v")), F.struct(F.lit("languages").alias("metric"), F.col("label").alias("v")))
    actual = s.select(F.explode(sets).alias("x")).filter("x.v is not null").groupBy("x.metric").agg(F.array_sort(F.collect_set("x.v")).alias("values"))
    return governance.contract_includes(actual, [("splits", ["test", "train", "val"]), ("languages", ["de", "en", "xx"]), ("licences", ["cc0"])])


def overview(spark, d):
    """One row on a version: counts, debt by level, readiness."""
    f = review.facts(spark, d)
    debt = governance.debt(f)
    levels = debt.agg(F.count("*").alias("dimensions"), F.count_if(F.col("level") == "HIGH").alias("debt_high"), F.count_if(F.col("level") == "LOW").alias("debt_low"))
    ready = governance.preflight(f).agg(F.max("status").alias("status"), F.count_if(F.col("outcome") == "block").alias("blocks"), F.count_if(F.col("outcome") == "warn").alias("warnings"))
    return f.select("sample_count", "class_count", "duplicate_families", "quality_samples").crossJoin(levels).crossJoin(ready)  # one row each


def dna_strip(spark, d):
    return shortcuts.dna_strip(shortcuts.dna_profile(texts._attributes(spark, d)).withColumn("share", F.round("share", 6)))


def centroid_drift(spark, d):
    v = vector_samples(spark, d)
    return shortcuts.centroid_drift(v.filter("sample_id % 5 <> 0"), v.filter("sample_id % 5 <> 1"))


def case_detail(spark, d):
    """Each sample's verdict with its reasons, prediction, target and eight nearest neighbours."""
    near = vectors._knn(spark, d).filter("rk <= 8").groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "neighbor_id"))), lambda n: n["neighbor_id"].cast("string")), ",").alias("neighbors"))  # eight a sample
    c = vectors._verdicts(spark, d).select("sample_id", "label", "split", "verdict", "rule", F.array_join(F.array_sort("codes"), ",").alias("reasons"), "pred", "p_given", "target", "uncertainty")
    return c.join(near, "sample_id", "left")


def manifest(spark, d):
    """The digest of a version's manifest: paths, contents, labels and splits."""
    path = F.concat_ws("/", "label", "source", F.concat(F.col("sample_id").cast("string"), F.lit(".txt")))
    return manifest_digest(texts._hashed(spark, d).select(path.alias("path"), F.col("raw_sha").alias("sha256"), "label", "split"))


def findings_store(spark, d):
    """Quality findings written for two audits, one of them twice, and read back."""
    place, found = scratch_path(spark, "findings"), texts.quality_rules(spark, d)
    for audit in ("first", "second", "first"):
        write_findings(found, audit, place)
    return spark.read.parquet(place).groupBy("audit_id", "finding").agg(F.count("*").alias("n"))


def run_audit(spark, d):
    """Every stage of an audit with the rows that it wrote."""
    from plumbline.plans import audit

    return audit.run_audit(spark, d, scratch_path(spark, "audit")).select("stage", "rows", "skipped")


QUERIES = {f.__name__: f for f in (cue_predictability, list_quality, list_leakage, list_privacy, list_samples_page, list_cases, case_facets, label_findings_page, cartography, hardest, gap_anchors, holdout, failure_replay, masked_accuracy, contract_includes, overview, dna_strip, centroid_drift, case_detail, manifest, findings_store, run_audit)}

_TEXT, _REVIEW = texts.ORACLES, review.ORACLES
_TRAJECTORY = f"with {SQL_VECTORS}, {vectors._EPOCHS}"
_PREDICTIONS = vectors.SQL_PREDICTIONS.replace(SQL_VECTORS, vectors.SQL_PLANTED)
_AFTER = _PREDICTIONS.replace(vectors.SQL_PLANTED, vectors.SQL_PLANTED.replace("vectors as (", "every as (", 1) + ", vectors as (select * from every where not (split = 'train' and sample_id % 20 = 7))")
ORACLES = {
    "cue_predictability": f"""with {texts.CUES}, rows_ as (select sample_id, label, cue, value, sample_id % 5 as fold from cues), people as (select distinct sample_id, label, fold from rows_),
 per as (select fold, label, count(*) as n from people group by all), tot as (select label, sum(n) as n_all from per group by label), folds as (select distinct fold from rows_),
 prior as (select f.fold, t.label, n_all - coalesce(n, 0) as n_out from tot t cross join folds f left join per p on p.fold = f.fold and p.label = t.label),
 cell as (select fold, cue, value, label, count(*) as n from rows_ group by all), kinds as (select cue, count(distinct value) as kinds from rows_ group by cue), cells as (select cue, value, label, sum(n) as n_all from cell group by all),
 likely as (select p.fold, g.cue, g.value, p.label as guess, n_out, ln((coalesce(c.n_all, 0) - coalesce(x.n, 0) + 1) / (n_out + kinds)::double) as l from (select distinct cue, value from rows_) g cross join prior p join kinds using (cue)
  left join cells c on c.cue = g.cue and c.value = g.value and c.label = p.label left join cell x on x.fold = p.fold and x.cue = g.cue and x.value = g.value and x.label = p.label),
 sc as (select sample_id, label, guess, round(sum(l) + ln(n_out + 1), 9) as s from rows_ r join likely k on k.fold = r.fold and k.cue = r.cue and k.value = r.value group by sample_id, label, guess, n_out),
 best as (select sample_id, label, guess from (select *, row_number() over (partition by sample_id order by s desc, guess) as r from sc) where r = 1), rec as (select label, avg((guess = label)::int::double) as r, count(*) as n from best group by label)
 select round(avg(r), 6) as balanced_accuracy, round(1 / count(*)::double, 6) as chance, sum(n)::bigint as n from rec""",
    "list_quality": f"select sample_id, finding, severity, value, count(*) over () as total from ({_TEXT['quality_rules']}) where severity in ('medium', 'high') order by severity, finding, sample_id, value limit 20 offset 20",
    "list_leakage": f"select family_id, size, kind, risk, count(*) over () as total from ({_TEXT['family_leaks']}) order by case risk when 'critical' then 3 when 'high' then 2 when 'medium' then 1 else 0 end desc, size desc, family_id limit 300",
    "list_privacy": f"select sample_id, kind, n, count(*) over () as total from ({_TEXT['privacy_patterns']}) where kind in ('email', 'phone') order by n desc, kind, sample_id limit 25",
    "list_samples_page": f"select s.sample_id, label, split, source, n_chars, findings, count(*) over () as total from (with {SQL_TEXT} select * from samples) s left join (select sample_id, count(*) as findings from ({_TEXT['quality_rules']}) group by sample_id) using (sample_id) where split = 'test' and contains(lower(source), 'src1') order by findings desc nulls last, sample_id limit 50",
    "case_facets": f"""with {vectors.VERDICT}, u as (select *, case when verdict in ('LEAKAGE_ACTION_NEEDED', 'POSSIBLE_RELABEL') then 'low' when verdict in ('UNCERTAIN', 'REVIEW') then 'high' else 'medium' end as uncertainty from verdicts)
 select 'verdict' as facet, verdict as value, count(*) as n from u group by verdict union all select 'uncertainty', uncertainty, count(*) from u group by uncertainty union all select 'rule', rule, count(*) from u group by rule""",
    "label_findings_page": f"with {vectors.EVIDENCE} select sample_id, round(suspicion, 6) as suspicion, action, count(*) over () as total from scored where action <> 'NO_ACTION' order by round(suspicion, 6) desc, sample_id limit 40",
    "cartography": f"{_TRAJECTORY} select category, count(*) as n, round(avg(round(confidence, 6)) + 1e-9, 6) as confidence, round(avg(round(variability, 6)) + 1e-9, 6) as variability from dynamics group by category",
    "hardest": f"{_TRAJECTORY} select sample_id, round(confidence, 6) as confidence, category from dynamics order by round(confidence, 6), sample_id limit 24",
    "gap_anchors": f"""with {vectors.KNN}, {SQL_REGIONS}, gp as (select distinct region from ({more.ORACLES['coverage_gaps']})), r as (select region, sample_id, round(density, 6) as density, row_number() over (partition by region order by round(density, 6) desc, sample_id) as rk from regions join density using (sample_id) join gp using (region))
 select * from r where rk <= 6""",
    "holdout": f"""with {texts.HASHED}, touched as (select case_id as sample_id from ({_REVIEW['case_status']}) where final is not null), leaking as (select family_id from ({_TEXT['family_leaks']})),
 fam as (select sample_id, min(sample_id) over (partition by norm_sha) as family_id from hashed where norm_sha is not null)
 select split, label, count(*) as n from samples where split in ('val', 'test') and sample_id not in (select sample_id from touched) and sample_id not in (select sample_id from fam where family_id in (select family_id from leaking)) group by all""",
    "failure_replay": f"""select b.sample_id, b.label, b.pred as before, a.pred as after, a.pred = b.label as fixed from (with {_PREDICTIONS} select * from predictions where split in ('val', 'test') and pred <> label) b
 join (with {_AFTER} select sample_id, pred from predictions) a using (sample_id)""",
    "masked_accuracy": f"""with {vectors.SQL_PREDICTIONS}, blocks as (select unnest(range(-1, 4)) as block), mv as (select sample_id, label, block, list_transform(range(1, 65), lambda i: case when (i - 1) // 16 = block then 0.0 else embedding[i] end::double) as x from vectors cross join blocks where split in ('val', 'test')),
 me as (select sample_id, label, block, k, exp(20 * list_inner_product(x, c)) as e from mv join fold_cents on f = sample_id % 5), mp as (select *, e / sum(e) over (partition by sample_id, block) as p from me),
 mr as (select *, row_number() over (partition by sample_id, block order by round(p, 9) desc, k) as r from mp) select block::integer as block, count(*) as n, round(avg((k = label)::int::double), 6) as accuracy from mr where r = 1 group by block""",
    "contract_includes": f"""with {SQL_TEXT}, asked as (select 'splits' as metric, unnest(['test', 'train', 'val']) as v union all select 'languages', unnest(['de', 'en', 'xx']) union all select 'licences', 'cc0'),
 have as (select distinct 'splits' as metric, split as v from samples union select distinct 'languages', label from samples)
 select metric, coalesce(string_agg(a.v, ',' order by a.v) filter (h.v is null), '') as missing, count(*) filter (h.v is null) = 0 as passed from asked a left join have h using (metric, v) group by metric""",
    "overview": f"""select sample_count, class_count, duplicate_families, quality_samples, dimensions, debt_high, debt_low, status, blocks, warnings from (select sample_count, class_count, duplicate_families, quality_samples from ({_REVIEW['facts']})) f,
 (select count(*) as dimensions, count(*) filter (level = 'HIGH') as debt_high, count(*) filter (level = 'LOW') as debt_low from ({_REVIEW['debt']})) d,
 (select max(status) as status, count(*) filter (outcome = 'block') as blocks, count(*) filter (outcome = 'warn') as warnings from ({_REVIEW['preflight']})) p""",
    "dna_strip": f"with b as (select *, row_number() over (order by dimension, bucket) as band from ({_TEXT['dna_profile']})) select band::integer as band, dimension, bucket, round(share / greatest(max(share) over (), 1e-12), 4) as height from b where band <= 24",
    "centroid_drift": f"""with {SQL_VECTORS}, m as (select label, i, avg(embedding[i]) filter (sample_id % 5 <> 0) as p, avg(embedding[i]) filter (sample_id % 5 <> 1) as q from vectors, range(1, 65) t(i) group by all),
 s as (select label, round(10 * (1 - sum(p * q) / sqrt(sum(p * p) * sum(q * q))), 6) as shift from m group by label) select label, shift, case when shift >= 0.15 then 'strong' when shift >= 0.05 then 'moderate' when shift is not null then 'none' end as drift from s""",
    "case_detail": f"""with {vectors.VERDICT}, nb as (select sample_id, string_agg(neighbor_id::varchar, ',' order by rk) as neighbors from knn where rk <= 8 group by sample_id),
 u as (select *, case when verdict in ('LEAKAGE_ACTION_NEEDED', 'POSSIBLE_RELABEL') then 'low' when verdict in ('UNCERTAIN', 'REVIEW') then 'high' else 'medium' end as uncertainty, array_to_string(list_sort(list_filter([{", ".join(f"case when {w} then '{n}' end" for n, w in vectors._CODES)}], lambda x: x is not null)), ',') as reasons from verdicts)
 select sample_id, label, split, verdict, rule, reasons, pred, p_given, target, uncertainty, neighbors from u left join nb using (sample_id)""",
    "manifest": f"""with {texts.HASHED}, l as (select sha256(concat_ws(chr(31), concat_ws('/', label, source, sample_id || '.txt'), raw_sha, label, split)) as line from hashed),
 s as (select count(*) as n, {", ".join(f"sum(('0x' || substr(line, {15 * i + 1}, 15))::bigint)::varchar as s{i}" for i in range(4))} from l) select n, sha256(concat_ws(',', n::varchar, s0, s1, s2, s3)) as digest from s""",
    "findings_store": f"select audit_id, finding, count(*) as n from ({_TEXT['quality_rules']}), (select unnest(['first', 'second']) as audit_id) group by all",
    "run_audit": " union all ".join(f"select '{stage}' as stage, count(*) as rows, false as skipped from ({sql})" for stage, sql in (("profile", _TEXT["version_stats"]), ("quality", _TEXT["quality_escalate"]), ("families", _TEXT["exact_families"]), ("leakage", _TEXT["family_leaks"]), ("shortcuts", _TEXT["shortcut_findings"]), ("labels", vectors.ORACLES["label_scores"]), ("cases", vectors.ORACLES["case_numbers"]), ("debt", _REVIEW["debt"]), ("preflight", _REVIEW["preflight"]))),
}
ORACLES["list_cases"] = f"""with n as ({vectors.ORACLES["case_numbers"]}), v as (with {vectors.VERDICT} select sample_id, split, round(priority, 4) as priority, case when split in ('val', 'test') then 0.6::double * strength else 0 end as impact, m or nn or o as labelled from verdicts),
 s as ({__import__("plumbline.plans.review_queries", fromlist=["ORACLES"]).ORACLES["case_status"]}),
 c as (select case_no, n.sample_id, n.verdict, coalesce(s.status, 'open') as status, v.priority, round(impact, 6) as impact from n join v on v.sample_id = n.sample_id left join s on s.case_id = n.case_no where n.verdict in ('STRONG_REVIEW', 'REVIEW', 'POSSIBLE_RELABEL') and labelled and split = 'test')
 select case_no, sample_id, verdict, status, priority, count(*) over () as total from c order by impact desc, priority desc, case_no limit 20 offset 5"""
