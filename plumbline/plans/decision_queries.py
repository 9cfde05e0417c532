"""What to review within a budget, how far probabilities can be trusted, and what a change set does to models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize
from plumbline.operators import blame, budget, experiments, labels, predictions, similarity
from plumbline.plans import vector_queries as vectors
from plumbline.sources.bindings import SQL_PROBABILITIES, SQL_VECTORS, vector_samples

MINUTES = {"low": 0.75, "medium": 1.0, "high": 1.5}  # a review takes, by the evidence's uncertainty
ITEMS, TIME = 60, 45.0


def _cases(spark, d):
    """All cases with what their review is worth under the balanced objective; copies of a vector are a family."""
    v = vector_samples(spark, d)
    copies = v.groupBy("embedding").agg(F.min("sample_id").alias("family"), F.count("*").alias("n")).filter("n > 1")
    kin = v.join(copies, "embedding").select("sample_id", "family")
    minutes = F.coalesce(*[F.when(F.col("uncertainty") == u, F.lit(m)) for u, m in MINUTES.items()])
    c = labels.case_value(vectors._verdicts(spark, d), "balanced").join(kin, "sample_id", "left")
    return materialize(c.select(F.col("sample_id").alias("case_id"), "value", minutes.alias("minutes"), "family", F.col("label").alias("class"), "verdict", "priority", "impact", "split", "uncertainty", "categories"), "review-cases")


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """The greedy queue of 60 cases or 45 minutes, with reasons."""
    cases = _cases(spark, d)
    return budget.explained(budget.review_queue(cases, ITEMS, TIME), cases, "balanced")


def review_coverage(spark, d):
    """What share of categories, value and high-impact cases that queue takes."""
    cases = _cases(spark, d)
    return budget.coverage(budget.review_queue(cases, ITEMS, TIME), cases)


def temperature_scale(spark, d):
    """The temperature of the out-of-fold probabilities of evaluation rows."""
    p = predictions.class_probabilities(vector_samples(spark, d)).filter("split <> 'train'")
    t = experiments.temperature_scale(p.select(F.transform("probs", lambda x: x["p"]).alias("probabilities"), "label"))
    return t.select(F.round("temperature", 6).alias("temperature"), F.round("nll_before", 6).alias("nll_before"), F.round("nll_after", 6).alias("nll_after"), "n")


def what_if_study(spark, d):
    """Remove training vectors that all their neighbours contradict; doubtful evaluation rows are dropped from the cleaned set. Copies in two splits are leaks."""
    v = vector_samples(spark, d)
    stats = similarity.neighbor_label_stats(vectors._knn(spark, d), v)
    doubtful = stats.filter("neighbor_same = 0 and neighbor_major_share >= 0.5").select("sample_id").join(v.select("sample_id", "split"), "sample_id")
    changes = doubtful.select("sample_id", F.when(F.col("split") == "train", "remove").otherwise("eval_drop").alias("effect"), F.lit(None).cast("int").alias("target"))
    crossing = v.groupBy("embedding").agg(F.countDistinct("split").alias("splits"), F.collect_set("split").alias("kinds")).filter("splits > 1").select("embedding")
    return experiments.what_if_study(v, changes, v.join(crossing, "embedding", "left_semi"), replicates=3, resamples=100)


def blame_chain(spark, d):
    """Every column of the blame map of each wrong prediction on evaluation rows: nearest and harmful training samples, copies, findings, cases, the class's sign cue and leaks."""
    v = vectors._vectors(spark, d)
    p = materialize(predictions.class_probabilities(v), "probabilities")
    judged = materialize(predictions.fold_predictions(v), "predictions")
    failed = judged.filter("split in ('val', 'test') and pred <> label").select("sample_id", "split", "label", "pred", "conf")
    near = vectors.failure_links(spark, d).select("sample_id", F.col("neighbor_id").alias("train_id"), F.lit(blame.NEAREST).alias("link_type"), F.col("sim").alias("score"), F.col("rk").cast("int").alias("rank"))
    harm = predictions.pair_influence(p, failed, 3).select("sample_id", "train_id", F.lit(blame.HARMFUL).alias("link_type"), F.col("influence").alias("score"), F.col("rk").cast("int").alias("rank"))
    copies = materialize(vectors._copies(v).select("sample_id", F.col("root").alias("family_id"), "leaks"), "copies")
    links = near.unionByName(harm).unionByName(blame.family_links(failed, copies, v))
    findings = vectors.label_scores(spark, d)
    cases = vectors.case_numbers(spark, d).select("sample_id", "case_no", "verdict")
    shortcuts = v.filter(F.col("embedding")[0] >= 0.2).select("sample_id", F.lit("first_component=high").alias("cue"))
    known = materialize(blame.described_links(failed, links, v.select("sample_id", "label"), findings, cases, copies.select("sample_id", "family_id"), shortcuts), "described-links")
    return blame.blame_map(failed, known, cases, copies.filter("leaks").select("sample_id"))


QUERIES = {f.__name__: f for f in (review_queue, review_coverage, temperature_scale, what_if_study, blame_chain)}

_RECURSIVE = vectors.VERDICT.replace("with ", "with recursive ", 1) if vectors.VERDICT.startswith("with ") else "recursive " + vectors.VERDICT
CASES = _RECURSIVE + f""",
relatives as (select sample_id, min(sample_id) over (partition by embedding) as fam, count(*) over (partition by embedding) as copies from vectors),
worth as (select verdicts.*, label as cls, case when verdict in ('LEAKAGE_ACTION_NEEDED', 'POSSIBLE_RELABEL') then 'low' when verdict in ('UNCERTAIN', 'REVIEW') then 'high' else 'medium' end as doubt, case when split in ('val', 'test') then 0.6::double * strength else 0 end as impact from verdicts),
cases as (select sample_id as case_id, cls, verdict, priority, impact, split, doubt, leaks, m or nn or o as labelled, severity >= 0.6 as poor, case doubt when 'low' then 0.75 when 'medium' then 1.0 else 1.5 end::double as minutes, case when copies > 1 then fam end as family,
 round(greatest((1.0::double * priority + 0.6::double * impact + 0.3::double * 0.3::double * case doubt when 'low' then 0.2 when 'high' then 1.0 else 0.5 end::double + case when leaks then 0.6::double * strength else 0 end + case when m or nn or o then 0.6::double * strength else 0 end
  + case when severity >= 0.6 then 0.3::double * 0.6::double * strength else 0 end + case when split in ('val', 'test') then 0.3::double * 0.2::double * strength else 0 end) * case when verdict = 'LIKELY_RARE' then 0.6 else 1.0 end::double, 0), 6) as value from worth join relatives using (sample_id)),
queue as (select 0 as rank, cast([] as bigint[]) as ids, cast([] as bigint[]) as families, cast([] as bigint[]) as classes, 0.0::double as spent, null::bigint as case_id, 0.0::double as value, 0.0::double as gain, 0.0::double as ratio
 union all select rank + 1, list_append(ids, pick.case_id), list_append(families, coalesce(pick.family, -1)), list_append(classes, pick.cls), spent + pick.minutes, pick.case_id, pick.value, pick.gain, pick.gain / pick.minutes
 from (select q.rank, q.ids, q.families, q.classes, q.spent, max({{'r': x.gain / x.minutes, 'i': -x.case_id, 'case_id': x.case_id, 'family': x.family, 'cls': x.cls, 'minutes': x.minutes, 'value': x.value, 'gain': x.gain}}) as pick
  from queue q join (select c.*, c.value * (case when c.family is null then 1.0 else pow(0.5, len(list_filter(q2.families, lambda f: f = c.family))) end::double * pow(0.85, least(10, len(list_filter(q2.classes, lambda k: k = c.cls))))) as gain, q2.rank as at from cases c, queue q2) x on x.at = q.rank
  where q.rank < {ITEMS} and not list_contains(q.ids, x.case_id) and q.spent + x.minutes <= {TIME} + 1e-9 group by all))"""
ORACLES = {
    "temperature_scale": f"""with {SQL_VECTORS}, {SQL_PROBABILITIES}, z as (select sample_id, label, k, ln(greatest(p, 1e-12)) as z from probabilities where split <> 'train'),
 t as (select i, 0.05 * pow(400.0, i / 512.0) as t from (select unnest(range(0, 513)) as i) union all select -1, 1.0),
 l as (select i, t, sample_id, ln(sum(exp(z / t))) - max(case when k = label then z / t end) as loss from z, t group by all),
 m as (select i, t, avg(loss) as nll, count(*) as n from l group by all)
 select round(b.t, 6) as temperature, round(o.nll, 6) as nll_before, round(b.nll, 6) as nll_after, b.n from (select * from m where i >= 0 order by nll limit 1) b, (select * from m where i = -1) o""",
    "review_queue": f"""with {CASES}
 select rank, case_id, queue.value, round(gain, 6) as gain, round(ratio, 6) as ratio, round(spent, 6) as spent,
  lower(replace(verdict, '_', ' ')) || ' (priority ' || printf('%.2f', priority) || ')' || case when leaks then '; affects evaluation integrity' else '' end || case when impact >= 0.5 then '; high estimated impact (' || printf('%.2f', impact) || ')' else '' end
  || case when split in ('val', 'test') then '; ' || split || ' sample: label errors here distort metrics' else '' end || case when doubt = 'high' then '; evidence conflicts: human judgment is most valuable' else '' end || ' [objective: balanced]' as reason
 from queue join cases using (case_id) where rank > 0""",
    "review_coverage": f"""with {CASES}, marked as (select cases.*, case when queue.rank > 0 then 1 else 0 end as taken from cases left join queue on queue.case_id = cases.case_id),
 parts as (select 'category: leakage' as part, taken, 1.0::double as w from marked where leaks union all select 'category: label', taken, 1.0 from marked where labelled union all select 'category: quality', taken, 1.0 from marked where poor
  union all select 'category: other', taken, 1.0 from marked where not leaks and not labelled and not poor union all select 'value', taken, value from marked
  union all select 'high_impact', taken, 1.0 from marked where verdict in ('POSSIBLE_RELABEL', 'STRONG_REVIEW', 'LEAKAGE_ACTION_NEEDED', 'POSSIBLE_REMOVE'))
 select part, round(sum(w * taken), 4) as taken, round(sum(w), 4) as open, round(case when sum(w) > 0 then sum(w * taken) / sum(w) else 0 end::double, 4) as share from parts group by part""",
}
ORACLES["blame_chain"] = f"""with near as ({vectors.ORACLES["failure_links"]}), harm as ({vectors.ORACLES["influence_pairs"].replace(" order by conf desc, sample_id limit 2000", "")}), cases as ({vectors.ORACLES["case_numbers"]}), findings as ({vectors.ORACLES["label_scores"]}),
 judged as (with {vectors.SQL_PREDICTIONS} select * from predictions), vs as (with {SQL_VECTORS} select * from vectors),
 failed as (select sample_id, split, label, pred, conf from judged where split in ('val', 'test') and pred <> label),
 kin as (select * from (select sample_id, split, min(sample_id) over (partition by embedding) as family_id, count(*) over (partition by embedding) as n from vs) where n > 1),
 crossing as (select family_id from kin group by family_id having count(distinct split) > 1),
 links as (select sample_id, neighbor_id as train_id, 'nearest_neighbor' as link_type, sim::double as score, rk from near union all select sample_id, train_id, 'harmful_influence', influence, rk from harm
  union all select a.sample_id, b.sample_id, 'same_family', 1.0, 0 from failed f join kin a on a.sample_id = f.sample_id join kin b on b.family_id = a.family_id and b.sample_id <> a.sample_id and b.split = 'train'),
 known as (select l.*, f.label as actual, f.pred as predicted, v.label as train_label, c.case_no, kin.family_id, v.embedding[1] >= 0.2 as cued,
  coalesce(s.action in ('REVIEW', 'LOW_PRIORITY_REVIEW'), false) or coalesce(c.verdict in ('POSSIBLE_RELABEL', 'STRONG_REVIEW'), false) as suspicious
  from links l join failed f on f.sample_id = l.sample_id join vs v on v.sample_id = l.train_id left join findings s on s.sample_id = l.train_id left join cases c on c.sample_id = l.train_id left join kin on kin.sample_id = l.train_id),
 once as (select sample_id, train_id, any_value(train_label = predicted) as conflicting, any_value(suspicious) as suspicious, any_value(case_no) as case_no, any_value(family_id) as family_id, any_value(cued) as cued, min(case when link_type = 'harmful_influence' then rk end) as harm_rank
  from known where link_type <> 'same_family' group by sample_id, train_id),
 acts as (select sample_id, array_to_string(list_sort(list(distinct act)), ',') as actions from (select sample_id, case when suspicious and case_no is not null then 'review_case:' || case_no when case_no is null and harm_rank <= 5 then 'inspect_sample:' || train_id end as act from once) where act is not null group by sample_id),
 per_sample as (select sample_id, count(*) as contributing, count(*) filter (conflicting) as conflicting, count(*) filter (suspicious) as suspicious, count(*) filter (cued) as shortcut_samples, count(distinct family_id) as duplicate_families from once group by sample_id),
 per_link as (select sample_id, count(*) filter (link_type = 'nearest_neighbor') as nearest, count(*) filter (link_type = 'nearest_neighbor' and train_label = predicted) as nearest_predicted, count(*) filter (link_type = 'nearest_neighbor' and train_label = actual) as nearest_true,
  count(*) filter (link_type = 'harmful_influence') as harmful, count(*) filter (link_type = 'same_family') as family_samples, max(score) filter (link_type = 'nearest_neighbor') as closest from known group by sample_id),
 spread as (select sample_id, string_agg(train_label || ':' || n, ',' order by train_label) as nearest_labels from (select sample_id, train_label, count(*) as n from known where link_type = 'nearest_neighbor' group by all) group by sample_id)
 select f.sample_id, f.split, f.label as actual, f.pred as predicted, f.conf as confidence, c.case_no as own_case, c.verdict as own_verdict, case when x.family_id is not null then 1 else 0 end as leaks,
  coalesce(nearest, 0) as nearest, coalesce(nearest_predicted, 0) as nearest_predicted, coalesce(nearest_true, 0) as nearest_true, coalesce(harmful, 0) as harmful, coalesce(family_samples, 0) as family_samples, closest, coalesce(contributing, 0) as contributing, coalesce(conflicting, 0) as conflicting,
  coalesce(suspicious, 0) as suspicious, coalesce(shortcut_samples, 0) as shortcut_samples, coalesce(duplicate_families, 0) as duplicate_families, coalesce(actions, '') as actions, coalesce(nearest_labels, '') as nearest_labels
 from failed f left join cases c on c.sample_id = f.sample_id left join kin k on k.sample_id = f.sample_id left join crossing x on x.family_id = k.family_id left join per_link p on p.sample_id = f.sample_id left join per_sample q on q.sample_id = f.sample_id left join acts a on a.sample_id = f.sample_id left join spread s on s.sample_id = f.sample_id"""
