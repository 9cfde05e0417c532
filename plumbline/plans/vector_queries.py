"""Queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize, written_once
from plumbline.operators import labels, metrics, predictions, similarity
from plumbline.sources.bindings import SQL_PREDICTIONS, SQL_PROBABILITIES, SQL_REGIONS, SQL_VECTORS, vector_samples

K = 10


def _vectors(s: SparkSession, d: str) -> DataFrame:
    """The vectors, dealt evenly and written once: a file with few row groups would leave the steps that go over all vectors to as few tasks."""
    return written_once(s, d, "vectors", lambda: vector_samples(s, d).repartition(2 * s.sparkContext.defaultParallelism, "sample_id"))


def _knn(s: SparkSession, d: str) -> DataFrame:
    """Each vector's neighbours, searched for once; labels have no part in them."""
    v = _vectors(s, d).select("sample_id", "embedding")
    return written_once(s, d, "knn", lambda: similarity.knn_join(v, v, K))


def knn_topk(spark, d):
    return _knn(spark, d)


def local_density(spark, d):
    return similarity.local_density(_knn(spark, d), 5).withColumn("density", F.round("density", 6))


def density_percentile(spark, d):
    return similarity.percentile_rank(local_density(spark, d), "density", "density_pct").select("sample_id", F.round("density_pct", 6).alias("density_pct"))


def neighbor_label_stats(spark, d):
    n = similarity.neighbor_label_stats(_knn(spark, d), vector_samples(spark, d))
    return n.select("sample_id", F.round("neighbor_same", 6).alias("neighbor_same"), "neighbor_major", F.round("neighbor_major_share", 6).alias("neighbor_major_share"))


def centroid_evidence(spark, d):
    return similarity.centroid_evidence(vector_samples(spark, d)).select("sample_id", F.round("ratio", 6).alias("ratio"), "nearest_other")


def witness_reliability(spark, d):
    """How far above chance the neighbours' vote is: clip((balanced accuracy - 1/C) / (1 - 1/C), 0, 1)."""
    n = similarity.neighbor_label_stats(_knn(spark, d), vector_samples(spark, d))
    return predictions.reliability(n, F.col("neighbor_same") >= F.col("neighbor_major_share"))


def similar_subject_pairs(spark, d):
    split = vector_samples(spark, d).select("sample_id", "split")
    k = _knn(spark, d).filter("sim >= 0.3").join(split, "sample_id").join(split.select(F.col("sample_id").alias("neighbor_id"), F.col("split").alias("other")), "neighbor_id").filter("split <> other")
    return k.groupBy(F.least("sample_id", "neighbor_id").alias("a"), F.greatest("sample_id", "neighbor_id").alias("b")).agg(F.max("sim").alias("sim"))


def adaptive_threshold(spark, d):
    return _knn(spark, d).filter("rk = 1").agg(F.round(F.greatest(F.lit(0.3), F.percentile("sim", F.lit(0.995))), 6).alias("threshold"), F.count("*").alias("n"))


def split_integrity_near(spark, d):
    v = vector_samples(spark, d)
    near = similarity.knn_join(v.filter("split <> 'train'").select("sample_id", "embedding"), v.filter("split = 'train'").select("sample_id", "embedding"), 1)
    j = near.join(v.select("sample_id", "split"), "sample_id")
    return j.groupBy("split").agg(F.count("*").alias("n"), F.round(F.percentile("sim", F.lit(0.5)), 6).alias("median_sim"), *[F.count_if(F.col("sim") >= t).alias(f"over_{int(t * 100)}") for t in (0.3, 0.4, 0.5)])


def failure_links(spark, d):
    """For each wrongly predicted evaluation sample the three nearest training samples."""
    v = _vectors(spark, d)
    failed = predictions.fold_predictions(v).filter("split <> 'train' and pred <> label").select("sample_id", "label", "pred")
    links = similarity.knn_join(v.join(failed.select("sample_id"), "sample_id", "left_semi").select("sample_id", "embedding"), v.filter("split = 'train'").select("sample_id", "embedding"), 3)
    names = v.select(F.col("sample_id").alias("neighbor_id"), F.col("label").alias("neighbor_label"))
    return links.join(failed, "sample_id").join(names, "neighbor_id").select("sample_id", "label", "pred", "neighbor_id", "neighbor_label", "sim", "rk")


def blame_map(spark, d):
    """Per failure: links that carry the wrongly predicted label, the true one, and the closest similarity."""
    f = failure_links(spark, d)
    return f.groupBy("sample_id").agg(F.count("*").alias("links"), F.count_if(F.col("neighbor_label") == F.col("pred")).alias("supporting_error"), F.count_if(F.col("neighbor_label") == F.col("label")).alias("supporting_truth"), F.max("sim").alias("closest"))


def sign_hash_pairs(spark, d):
    """Pairs of vectors whose 64 sign bits differ in 15 places or fewer."""
    bits = F.aggregate(F.transform(F.slice("embedding", 1, 64), lambda x, i: F.when(x >= 0, F.expr("1L")).otherwise(F.expr("0L"))), F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))
    return similarity.hamming_join(vector_samples(spark, d).select("sample_id", bits.alias("hash")), 15)


def metrics_confusion(spark, d):
    return metrics.confusion(predictions.fold_predictions(vector_samples(spark, d)))


def metrics_per_class(spark, d):
    return metrics.per_class(predictions.fold_predictions(vector_samples(spark, d)))


def metrics_summary(spark, d):
    return metrics.summary(predictions.fold_predictions(vector_samples(spark, d)))


def ece(spark, d):
    return metrics.ece(predictions.fold_predictions(vector_samples(spark, d)))


def temperature_grid(spark, d):
    """Mean negative log likelihood of two-way logits over a grid of temperatures."""
    p = predictions.fold_predictions(vector_samples(spark, d))
    z = F.log(F.col("conf") / (1.0001 - F.col("conf"))) * F.when(F.col("label") == F.col("pred"), 1.0).otherwise(-1.0)
    g = p.select(z.alias("z"), F.explode(F.array(*[F.lit(t) for t in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)])).alias("t"))
    return g.groupBy("t").agg(F.round(F.avg(F.log(1 + F.exp(-F.col("z") / F.col("t")))), 6).alias("nll"))


def prediction_rows(spark, d):
    """Softmax of the similarities to class centroids: prediction, its probability, margin, entropy."""
    return _predicted(spark, d).select("sample_id", "pred", *[F.round(c, 5).alias(c) for c in ("p_pred", "p_given", "gap", "entropy")])


def _predicted(spark, d):
    v = vector_samples(spark, d)
    parts = v.filter("split = 'train'").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    cents = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c")).agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("k"), "c"))).alias("cents"))
    logits = v.crossJoin(cents).withColumn("e", F.transform("cents", lambda c: F.struct(F.exp(20 * similarity.dot(F.col("embedding"), c["c"])).alias("e"), c["k"].alias("k"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x["e"])
    p = F.transform("e", lambda x: F.struct((-F.round(x["e"] / F.col("total"), 9)).alias("n"), x["k"].alias("k"), (x["e"] / F.col("total")).alias("p")))
    r = logits.withColumn("total", total).withColumn("r", F.array_sort(p))
    given = F.aggregate("r", F.lit(0.0), lambda a, x: a + F.when(x["k"] == F.col("label"), x["p"]).otherwise(0.0))
    entropy = F.aggregate("r", F.lit(0.0), lambda a, x: a - x["p"] * F.log(x["p"]))
    return r.select("sample_id", "label", "split", F.col("r")[0]["k"].alias("pred"), F.col("r")[0]["p"].alias("p_pred"), given.alias("p_given"), (F.col("r")[0]["p"] - F.col("r")[1]["p"]).alias("gap"), entropy.alias("entropy"))


def _copies(v):
    """Vectors that occur several times: their smallest id as ``root``, and whether labels or splits differ.

    Hashes tell which vectors can have copies, so that no others are moved; the vectors themselves decide.
    """
    hashed = v.withColumn("kind", F.xxhash64("embedding"))
    several = hashed.groupBy("kind").agg(F.count("*").alias("n")).filter("n > 1").select("kind")
    some = materialize(hashed.join(several, "kind", "left_semi"), "alike")
    differ = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    groups = some.groupBy("embedding").agg(F.min("sample_id").alias("root"), F.count("*").alias("n"), differ("label").alias("dup_conflict"), differ("split").alias("leaks")).filter("n > 1")
    return some.select("sample_id", "embedding").join(groups, "embedding").select("sample_id", "root", "dup_conflict", "leaks")


def _signals(spark, d, v):
    """All evidence on the labels of ``v``, the vectors of ``d`` under any labels, computed from its vectors; rounded so that verdicts do not hang on the last bit."""
    knn = _knn(spark, d)
    copies = materialize(_copies(v), "copies")  # read three times
    n = materialize(similarity.neighbor_label_stats(knn, v, skip=similarity.neighboring_copies(knn, copies)), "neighbor-labels")
    c = similarity.centroid_evidence(v).select("sample_id", F.round("ratio", 6).alias("centroid_ratio"), "nearest_other")
    p = materialize(predictions.fold_predictions(v), "predictions")
    density = similarity.percentile_rank(similarity.local_density(knn, 5).withColumn("density", F.round("density", 6)), "density", "density_pct").select("sample_id", F.round("density_pct", 6).alias("density_pct"))
    peak = F.round(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))), 6)
    peaks = v.select("sample_id", "label", peak.alias("peak"))
    usual = peaks.groupBy("label").agg(F.avg("peak").alias("mean"), F.stddev_pop("peak").alias("std"))
    shape = peaks.join(F.broadcast(usual), "label").select("sample_id", F.round(F.least(F.greatest((F.col("peak") - 0.25) / 0.25, F.lit(0.0)), F.lit(1.0)), 2).alias("severity"), F.round(F.abs(F.col("peak") - F.col("mean")) / F.greatest("std", F.lit(1e-9)), 2).alias("deviation"))  # one row per class
    dynamics = metrics.dynamics(predictions.learning_trajectory(v)).select("sample_id", F.col("category").alias("dynamics"))
    weight = lambda df, hit, name: predictions.reliability(df, hit).select(F.col("reliability").alias(f"reliability_{name}"))
    reliable = weight(p.filter("split = 'train'"), F.col("pred") == F.col("label"), "model").crossJoin(weight(n, F.col("neighbor_same") >= F.col("neighbor_major_share"), "neighbor"))  # one row each
    near = n.select("sample_id", "label", F.round("neighbor_same", 6).alias("neighbor_same"), "neighbor_major", F.round("neighbor_major_share", 6).alias("neighbor_major_share"))
    own = p.select("sample_id", "split", "pred", F.col("conf").alias("p_pred"), "p_given", "gap")
    alike = copies.select("sample_id", (F.col("sample_id") != F.col("root")).alias("is_copy"), "dup_conflict", "leaks")
    joined = near.join(c, "sample_id").join(own, "sample_id").join(density, "sample_id").join(shape, "sample_id").join(dynamics, "sample_id").join(alike, "sample_id", "left").crossJoin(reliable)
    return joined.fillna(False, ["is_copy", "dup_conflict", "leaks"])


def _evidence(spark, d):
    return written_once(spark, d, "evidence", lambda: labels.score_labels(_signals(spark, d, _vectors(spark, d))))


def _planted(spark, d):
    """Vectors of which each twentieth has the next label: ``wrong``."""
    wrong = F.col("sample_id") % 20 == 7
    return _vectors(spark, d).withColumn("wrong", wrong).withColumn("label", F.when(wrong, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int"))


def _planted_scores(spark, d):
    v = _planted(spark, d)
    e = written_once(spark, d, "planted-evidence", lambda: labels.score_labels(_signals(spark, d, v.drop("wrong"))))
    return e.withColumn("suspicion", F.round("suspicion", 6)).join(v.select("sample_id", "wrong"), "sample_id")


def label_scores(spark, d):
    return _evidence(spark, d).select("sample_id", F.round("suspicion", 6).alias("suspicion"), "action")


def _hypotheses(spark, d):
    """The hypotheses, written: each reason code names them again, and a filter on codes or verdicts would repeat their terms as often."""
    return written_once(spark, d, "hypotheses", lambda: labels.rare_or_wrong(_evidence(spark, d)))


def _coded(spark, d):
    return written_once(spark, d, "codes", lambda: labels.reason_codes(_hypotheses(spark, d)))


def rare_or_wrong(spark, d):
    return _hypotheses(spark, d).select("sample_id", *labels.HYPOTHESES, "hypothesis")


def reason_codes(spark, d):
    return _coded(spark, d).select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def _verdicts(spark, d):
    return written_once(spark, d, "verdicts", lambda: labels.deliberate(_coded(spark, d)))


def verdicts(spark, d):
    return _verdicts(spark, d).select("sample_id", "rule", "verdict", "target", "priority")


def case_numbers(spark, d, max_cases=5000):
    """Cases (everything but calm keeps) numbered by priority, with the one before and after; ``max_cases`` bounds the report."""
    from pyspark.sql import Window

    w = Window.orderBy(F.desc("priority"), "sample_id")
    c = _verdicts(spark, d).filter(~((F.col("verdict") == "KEEP") & (F.col("suspicion") < labels.LOW_PRIORITY)))
    top = c.select("sample_id", "verdict", "priority").orderBy(F.desc("priority"), "sample_id").limit(max_cases)
    return top.select("sample_id", "verdict", "priority", F.row_number().over(w).cast("bigint").alias("case_no"), F.lag("sample_id").over(w).alias("previous"), F.lead("sample_id").over(w).alias("next"))


def list_cases(spark, d):
    return verdicts(spark, d).groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.max("priority"), 4).alias("top_priority"))


def average_precision(spark, d):
    """How well suspicion ranks planted label errors."""
    return metrics.average_precision(_planted_scores(spark, d), "suspicion", "wrong")


def review_effort(spark, d):
    return metrics.review_effort(_planted_scores(spark, d), "suspicion", "wrong")


def dynamics_table(spark, d):
    """What becomes of each label's probability while a model learns from ever more vectors."""
    return metrics.dynamics(predictions.learning_trajectory(vector_samples(spark, d)))


def region_summary(spark, d):
    """Regions around seed vectors, as sizes, dominant class, purity and density; sparse ones are marked."""
    from plumbline.operators.modeling import region_summary as summarize

    v = similarity.seed_regions(_vectors(spark, d))
    return summarize(v.join(similarity.local_density(_knn(spark, d), 5), "sample_id"))


QUERIES = {f.__name__: f for f in (knn_topk, local_density, density_percentile, neighbor_label_stats, centroid_evidence, witness_reliability, similar_subject_pairs, adaptive_threshold, split_integrity_near, failure_links, blame_map, sign_hash_pairs, metrics_confusion, metrics_per_class, metrics_summary, ece, temperature_grid, prediction_rows, label_scores, rare_or_wrong, reason_codes, verdicts, case_numbers, list_cases, average_precision, review_effort, dynamics_table, region_summary)}

_COS = "list_inner_product({0}, {1}) / (sqrt(list_inner_product({0}, {0})) * sqrt(list_inner_product({1}, {1})))"
KNN = SQL_VECTORS + f""", sims as (select a.sample_id, b.sample_id as neighbor_id, round({_COS.format('a.embedding', 'b.embedding')}, 4) as sim from vectors a join vectors b on a.sample_id <> b.sample_id),
knn as (select * from (select *, row_number() over (partition by sample_id order by sim desc, neighbor_id) as rk from sims) where rk <= 10),
density as (select sample_id, sum(sim) / 5 as density from knn where rk <= 5 group by sample_id),
nw as (select k.sample_id, o.label as other, sum(greatest(sim, 0)) as w from knn k join vectors o on o.sample_id = k.neighbor_id group by all),
nt as (select v.sample_id, v.label, sum(w) as total, coalesce(sum(w) filter (other = v.label), 0) as same from vectors v left join nw using (sample_id) group by all),
nm as (select sample_id, other, round(w, 9) as w, row_number() over (partition by sample_id order by round(w, 9) desc, other) as r from nw join vectors v using (sample_id) where other <> v.label),
neigh as (select nt.sample_id, nt.label, case when total > 0 then same / total else 1.0 end as neighbor_same, case when total > 0 then nm.other end as neighbor_major, coalesce(case when total > 0 then nm.w / total end, 0.0) as neighbor_major_share from nt left join nm on nm.sample_id = nt.sample_id and r = 1)"""
CENT = """{c} as (select label as k, list(c order by i) as c from (select label, i, avg(embedding[i]) as c from vectors, range(1, 65) t(i) where split = 'train' group by all) group by label)"""
CENTROID = CENT.format(c="c0") + f""", c1 as (select k, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) as c from c0),
cd as (select sample_id, label, k, 1 - list_inner_product(embedding, c) as d from vectors cross join c1),
cent as (select a.sample_id, a.label, a.d / greatest(a.d + b.d, 1e-9) as ratio, b.k as nearest_other from cd a join (select sample_id, k, round(d, 9) as d, row_number() over (partition by sample_id order by round(d, 9), k) as r from cd where k <> label) b using (sample_id) where a.k = a.label and r = 1)"""
_VOTES = """fam as (select embedding, min(sample_id) as root, count(distinct label) > 1 as dup_conflict, count(distinct split) > 1 as leaks from vectors group by embedding having count(*) > 1),
kin as (select v.sample_id, root, v.sample_id <> root as is_copy, dup_conflict, leaks from vectors v join fam using (embedding)),
votes as (select k.* from knn k left join kin a on a.sample_id = k.sample_id left join kin b on b.sample_id = k.neighbor_id where a.root is null or b.root is null or a.root <> b.root), nw as (select k.sample_id, o.label as other, sum(greatest(sim, 0)) as w from votes k join"""
_EPOCHS = """epoch_cents as (select e, label as k, list(c order by i) as c from (select e, label, i, avg(embedding[i]) as c from (select unnest(range(0, 8)) as e) join vectors on split = 'train' and (sample_id // 10) % 8 <= e, range(1, 65) t(i) group by all) group by all),
epoch_e as (select sample_id, label, e as epoch, k, exp(20 * list_inner_product(embedding, c)) as x from vectors cross join epoch_cents),
epoch_p as (select *, x / sum(x) over (partition by sample_id, epoch) as q from epoch_e),
epoch_r as (select *, row_number() over (partition by sample_id, epoch order by round(q, 9) desc, k) as r from epoch_p),
trajectory as (select sample_id, epoch, round(coalesce(max(q) filter (k = label), 0), 6) + 1e-9 as p, max(k) filter (r = 1) = label as correct from epoch_r group by sample_id, epoch, label),
dyn_c as (select *, lag(correct) over (partition by sample_id order by epoch) as before from trajectory),
dyn_g as (select sample_id, avg(p) as confidence, stddev_pop(p) as variability, avg(correct::int::double) as correctness, count(*) filter (before and not correct) as forgetting, max(epoch) filter (not correct) as wrong from dyn_c group by sample_id),
dynamics as (select *, case when wrong is null then 0 when wrong < 7 then wrong + 1 else -1 end as first_learned,
 case when confidence < 0.3 and correctness < 0.3 then 'hard' when forgetting >= 2 then 'forgotten' when variability >= 0.2 then 'ambiguous' when confidence >= 0.6 and correctness >= 0.8 then 'easy' else 'unstable' end as category from dyn_g)"""
_REL = "(select round(least(greatest((avg(r) - 1 / count(*)::double) / greatest(1 - 1 / count(*)::double, 1e-9), 0), 1), 6)::double as {1} from (select label, avg(({2})::int::double) as r from {0} group by label))"
assert "nw as (select k.sample_id, o.label as other, sum(greatest(sim, 0)) as w from knn k join" in KNN
EVIDENCE = KNN.replace("nw as (select k.sample_id, o.label as other, sum(greatest(sim, 0)) as w from knn k join", _VOTES) + ", " + CENTROID + SQL_PREDICTIONS[len(SQL_VECTORS):] + ", " + _EPOCHS + f""",
peaks as (select sample_id, label, round(list_max(list_transform(embedding, lambda x: abs(x))), 6) as peak from vectors),
usual as (select label, avg(peak) as mean, stddev_pop(peak) as std from peaks group by label),
shape as (select sample_id, round(least(greatest((peak - 0.25) / 0.25::double, 0), 1), 2)::double as severity, round(abs(peak - mean) / greatest(std, 1e-9), 2)::double as deviation from peaks join usual using (label)),
dens as (select sample_id, round((row_number() over (order by round(density, 6), sample_id) - 1) / greatest(1, count(*) over () - 1)::double, 6)::double as density_pct from density),
fixed as (select p.sample_id, p.split, pred, conf as p_pred, p_given, gap, density_pct, severity, deviation, category as dynamics, coalesce(is_copy, false) as is_copy, coalesce(dup_conflict, false) as dup_conflict, coalesce(leaks, false) as leaks, rm, rn
 from predictions p join dens using (sample_id) join shape using (sample_id) join dynamics using (sample_id) left join kin using (sample_id), {_REL.format("predictions where split = 'train'", "rm", "pred = label").replace("where split = 'train' group", "where split = 'train' group")}, {_REL.format("neigh", "rn", "neighbor_same >= neighbor_major_share")}),
ev0 as (select n.sample_id, n.label, round(neighbor_same, 6) as neighbor_same, neighbor_major, round(neighbor_major_share, 6) as neighbor_major_share, round(ratio, 6) as centroid_ratio, nearest_other, f.* exclude (sample_id) from neigh n join cent using (sample_id) join fixed f using (sample_id)),
ev1 as (select *, least(greatest((centroid_ratio - 0.4) / 0.3::double, 0), 1)::double as s_centroid from ev0),
ew as (select *, 0.35::double * greatest(rm, 0.05) as wm, 0.3::double * greatest(rn, 0.05) as wn, 0.1::double * greatest(rm, 0.05) as wd, case dynamics when 'hard' then 1.0 when 'forgotten' then 0.7 when 'ambiguous' then 0.5 when 'unstable' then 0.4 else 0.0 end::double as s_dyn from ev1),
ev as (select *, ((1 - p_given) * wm + (1 - neighbor_same) * wn + s_centroid * 0.15::double + dup_conflict::int * 0.1::double + s_dyn * wd) / (wm + wn + 0.15::double + 0.1::double + wd) as suspicion from ew),
scored as (select *, case when 1 - p_given >= 0.5 and neighbor_major_share < 0.5 and density_pct <= 0.08 and centroid_ratio < 0.55 and severity < 0.6 then 'LIKELY_RARE' when suspicion >= 0.55 then 'REVIEW' when suspicion >= 0.38 then 'LOW_PRIORITY_REVIEW' else 'NO_ACTION' end as action,
 pred <> label and p_given < p_pred as other_pred from ev)"""
HYP = EVIDENCE + """, h0 as (select *, case when other_pred then p_pred else 0.0 end as p_other, coalesce(other_pred and neighbor_major = pred and nearest_other = pred, false) as consistent from scored),
h as (select *, round(least(1.0, (p_other + neighbor_major_share + s_centroid) / 3 + case when consistent then 0.15 else 0.0 end), 4)::double as likely_mislabeled,
 round(((1 - density_pct) + (1 - s_centroid) + (1 - neighbor_major_share) + case when severity < 0.3 then 1.0 else 0.3 end) / 4 * case when p_other >= 0.6 then 0.6 else 1.0 end, 4)::double as rare_valid, round(severity, 4)::double as poor_quality,
 round((1 - density_pct) * least(greatest((deviation - 2) / 4, 0), 1), 4)::double as domain_shifted, round((1 - least(greatest(gap / 0.3::double, 0), 1)) * case when neighbor_major_share >= 0.3 then 1.0 else 0.5 end, 4)::double as ambiguous from h0),
hr as (select sample_id, list({'s': s, 'k': k} order by s desc, i) as r from (select sample_id, unnest([{'i': 0, 'k': 'likely_mislabeled', 's': likely_mislabeled}, {'i': 1, 'k': 'rare_valid', 's': rare_valid}, {'i': 2, 'k': 'poor_quality', 's': poor_quality}, {'i': 3, 'k': 'domain_shifted', 's': domain_shifted}, {'i': 4, 'k': 'ambiguous', 's': ambiguous}], recursive := true) from h) group by sample_id),
hyp as (select h.*, case when r[1].s >= 0.5 and round(r[1].s - r[2].s, 4) >= 0.08 then r[1].k else 'uncertain' end as hypothesis from h join hr using (sample_id))"""
_CODES = [("HIGH_MODEL_DISAGREEMENT", "pred <> label and p_given < 0.2"), ("MODEL_DISAGREEMENT", "pred <> label and p_given >= 0.2 and p_given < 0.4"), ("MODEL_AGREES", "p_given >= 0.6"), ("HIGH_NEIGHBOR_DISAGREEMENT", "rn >= 0.35 and neighbor_same < 0.35 and neighbor_major_share >= 0.5"), ("NEIGHBORS_AGREE", "rn >= 0.35 and neighbor_same >= 0.6"), ("NEIGHBOR_WITNESS_WEAK", "rn < 0.35"), ("OUTSIDE_CLASS_CLUSTER", "centroid_ratio >= 0.55"), ("INSIDE_CLASS_CLUSTER", "centroid_ratio < 0.45"), ("CONSISTENT_ALTERNATIVE_LABEL", "consistent and rn >= 0.35"), ("LOW_DENSITY_REGION", "density_pct <= 0.05"), ("SEVERE_QUALITY_ISSUE", "severity >= 0.9"), ("QUALITY_CONCERN", "severity >= 0.6 and severity < 0.9"), ("EXACT_DUPLICATE_COPY", "is_copy"), ("DUPLICATE_LABEL_CONFLICT", "dup_conflict"), ("CROSS_SPLIT_LEAKAGE", "leaks"), ("RARE_HYPOTHESIS", "hypothesis = 'rare_valid'"), ("MISLABEL_HYPOTHESIS", "hypothesis = 'likely_mislabeled'"), ("AMBIGUOUS_HYPOTHESIS", "hypothesis = 'ambiguous'"), ("DOMAIN_SHIFT_HYPOTHESIS", "hypothesis = 'domain_shifted'"), ("QUALITY_OK", "severity < 0.6"), ("NO_LEAKAGE", "not leaks"), ("EVALUATION_SAMPLE", "split in ('val', 'test')"),
          ("HARD_TO_LEARN", "dynamics = 'hard'"), ("FORGOTTEN_DURING_TRAINING", "dynamics = 'forgotten'"), ("AMBIGUOUS_TRAINING", "dynamics = 'ambiguous'"), ("UNSTABLE_TRAINING", "dynamics = 'unstable'"), ("EASY_TO_LEARN", "dynamics = 'easy'")]
VERDICT = HYP + """, b as (select *, pred <> label and p_given < 0.4 as m, rn >= 0.35 and neighbor_same < 0.35 and neighbor_major_share >= 0.5 as nn, centroid_ratio >= 0.55 as o, consistent and rn >= 0.35 as agreed from hyp),
r as (select *, case when leaks then 'R1' when is_copy and not dup_conflict then 'R2' when dup_conflict then 'R3' when severity >= 0.9 and m and hypothesis <> 'rare_valid' then 'R4'
 when pred <> label and p_given < 0.2 and nn and o and agreed and severity < 0.9 then 'R5' when hypothesis = 'rare_valid' and not agreed then 'R6' when m::int + nn::int + o::int >= 2 then 'R7' when m and rn >= 0.35 and neighbor_same >= 0.6 and centroid_ratio < 0.45 then 'R8'
 when m or nn or o or severity >= 0.6 or hypothesis in ('ambiguous', 'domain_shifted', 'likely_mislabeled') then 'R9' else 'R10' end as rule from b),
v0 as (select *, case rule when 'R1' then 'LEAKAGE_ACTION_NEEDED' when 'R2' then 'POSSIBLE_REMOVE' when 'R3' then 'STRONG_REVIEW' when 'R4' then 'POSSIBLE_REMOVE' when 'R5' then 'POSSIBLE_RELABEL' when 'R6' then 'LIKELY_RARE' when 'R7' then 'STRONG_REVIEW' when 'R8' then 'UNCERTAIN' when 'R9' then 'REVIEW' else 'KEEP' end as verdict,
 greatest(suspicion, case when leaks then 0.85 else 0.0 end, 0.8::double * severity) as strength from r),
verdicts as (select *, case when verdict = 'POSSIBLE_RELABEL' then pred end as target, round(0.45::double * case verdict when 'LEAKAGE_ACTION_NEEDED' then 0.9 when 'POSSIBLE_RELABEL' then 0.85 when 'STRONG_REVIEW' then 0.8 when 'POSSIBLE_REMOVE' then 0.6 when 'REVIEW' then 0.5 when 'UNCERTAIN' then 0.45 when 'LIKELY_RARE' then 0.35 else 0.1 end::double
 + 0.4::double * strength + 0.15::double * case when split in ('val', 'test') then 0.6::double * strength else 0 end, 4) as priority from v0)"""
SQL_PLANTED = SQL_VECTORS.replace(", label,", ", cast(case when vec_id % 20 = 7 then (label + 1) % 10 else label end as integer) as label,")
assert SQL_PLANTED != SQL_VECTORS
FAILURES = SQL_PREDICTIONS + f""", failed as (select * from predictions where split <> 'train' and pred <> label),
links as (select * from (select f.sample_id, f.label, f.pred, t.sample_id as neighbor_id, t.label as neighbor_label, round({_COS.format('v.embedding', 't.embedding')}, 4) as sim, row_number() over (partition by f.sample_id order by round({_COS.format('v.embedding', 't.embedding')}, 4) desc, t.sample_id) as rk
 from failed f join vectors v using (sample_id) join vectors t on t.split = 'train') where rk <= 3)"""
_PC = SQL_PREDICTIONS + """, t as (select label as class, count(*) as support, count(*) filter (label = pred) as tp from predictions group by label), s as (select pred as class, count(*) as said from predictions group by pred),
pr as (select class, support, coalesce(tp / said::double, 0) as p, tp / support::double as r from t left join s using (class)),
pc as (select class, support, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from pr)"""
ORACLES = {
    "knn_topk": f"with {KNN} select sample_id, neighbor_id, sim, rk from knn",
    "local_density": f"with {KNN} select sample_id, round(density, 6) as density from density",
    "density_percentile": f"with {KNN}, dd as (select sample_id, round(density, 6) as density from density) select sample_id, round((row_number() over (order by density, sample_id) - 1) / greatest(1, count(*) over () - 1)::double, 6) as density_pct from dd",
    "neighbor_label_stats": f"with {KNN} select sample_id, round(neighbor_same, 6) as neighbor_same, neighbor_major, round(neighbor_major_share, 6) as neighbor_major_share from neigh",
    "centroid_evidence": f"with {SQL_VECTORS}, {CENTROID} select sample_id, round(ratio, 6) as ratio, nearest_other from cent",
    "witness_reliability": f"with {KNN}, p as (select label, avg((neighbor_same >= neighbor_major_share)::int::double) as r from neigh group by label) select round(least(greatest((avg(r) - 1 / count(*)::double) / (1 - 1 / count(*)::double), 0), 1), 6)::double as reliability, count(*) as classes from p",
    "similar_subject_pairs": f"with {KNN} select least(k.sample_id, neighbor_id) as a, greatest(k.sample_id, neighbor_id) as b, max(sim) as sim from knn k join vectors x on x.sample_id = k.sample_id join vectors y on y.sample_id = neighbor_id where sim >= 0.3 and x.split <> y.split group by all",
    "adaptive_threshold": f"with {KNN} select round(greatest(0.3, quantile_cont(sim, 0.995)), 6)::double as threshold, count(*) as n from knn where rk = 1",
    "split_integrity_near": f"with {SQL_VECTORS}, x as (select a.sample_id, a.split, max(round({_COS.format('a.embedding', 'b.embedding')}, 4)) as sim from vectors a join vectors b on b.split = 'train' where a.split <> 'train' group by all) select split, count(*) as n, round(quantile_cont(sim, 0.5), 6) as median_sim, count(*) filter (sim >= 0.3) as over_30, count(*) filter (sim >= 0.4) as over_40, count(*) filter (sim >= 0.5) as over_50 from x group by split",
    "failure_links": f"with {FAILURES} select * from links",
    "blame_map": f"with {FAILURES} select sample_id, count(*) as links, count(*) filter (neighbor_label = pred) as supporting_error, count(*) filter (neighbor_label = label) as supporting_truth, max(sim) as closest from links group by sample_id",
    "sign_hash_pairs": "with s as (select vec_id, list_transform(embedding[1:64], lambda x: (x >= 0)::int) as b from embeddings), s1 as (select *, min(vec_id) over (partition by b) as root from s), p as (select x.vec_id as a, y.vec_id as b, list_sum(list_transform(list_zip(x.b, y.b), lambda z: (z[1] <> z[2])::int)) as distance from s1 x join s1 y on x.vec_id < y.vec_id and (x.root = y.root and x.root = x.vec_id or x.root <> y.root and x.root = x.vec_id and y.root = y.vec_id)) select a, b, distance::int as distance from p where distance <= 15",
    "metrics_confusion": f"with {SQL_PREDICTIONS} select label, pred, count(*) as n from predictions group by all",
    "metrics_per_class": f"with {_PC} select * from pc",
    "metrics_summary": f"with {_PC}, a as (select count(*) as n, round(avg((label = pred)::int::double), 6) as accuracy, round(avg(-ln(greatest(p_given, 1e-12))), 6) as nll from predictions) select n, accuracy, nll, (select round(avg(recall), 5) from pc) as balanced_accuracy, (select round(avg(f1), 5) from pc) as macro_f1 from a",
    "ece": f"with {SQL_PREDICTIONS}, p as (select greatest(ceil(round(conf * 15, 9)), 1) as bin, count(*) as n, avg(conf::double) as c, avg((label = pred)::int::double) as a from predictions group by 1) select round(sum(n / (select sum(n) from p)::double * abs(a - c)), 6) as ece from p",
    "temperature_grid": f"with {SQL_PREDICTIONS}, z as (select ln(conf::double / (1.0001::double - conf::double)) * case when label = pred then 1 else -1 end as z from predictions) select t::double as t, round(avg(ln(1 + exp(-z / t::double))), 6) as nll from z, (select unnest([0.25, 0.5, 1.0, 2.0, 4.0, 8.0]) as t) group by t",
    "prediction_rows": f"""with {SQL_VECTORS}, {CENT.format(c='c0')}, e as (select sample_id, label, k, exp(20 * list_inner_product(embedding, c)) as e from vectors cross join c0), p as (select sample_id, label, k, e / sum(e) over (partition by sample_id) as p from e),
 r as (select *, row_number() over (partition by sample_id order by round(p, 9) desc, k) as r from p)
 select sample_id, max(k) filter (r = 1) as pred, round(max(p) filter (r = 1), 5) as p_pred, round(max(p) filter (k = label), 5) as p_given, round(max(p) filter (r = 1) - max(p) filter (r = 2), 5) as gap, round(sum(-p * ln(p)), 5) as entropy from r group by sample_id""",
    "label_scores": f"with {EVIDENCE} select sample_id, round(suspicion, 6) as suspicion, action from scored",
    "rare_or_wrong": f"with {HYP} select sample_id, likely_mislabeled, rare_valid, poor_quality, domain_shifted, ambiguous, hypothesis from hyp",
    "reason_codes": f"with {HYP} " + " union all ".join(f"select '{n}' as code, count(*) as n from hyp where {w} having count(*) > 0" for n, w in _CODES),
    "verdicts": f"with {VERDICT} select sample_id, rule, verdict, target, priority from verdicts",
    "case_numbers": f"with {VERDICT}, c as (select * from verdicts where not (verdict = 'KEEP' and suspicion < 0.38) order by priority desc, sample_id limit 5000) select sample_id, verdict, priority, row_number() over w as case_no, lag(sample_id) over w as previous, lead(sample_id) over w as next from c window w as (order by priority desc, sample_id)",
    "list_cases": f"with {VERDICT} select verdict, count(*) as n, max(priority) as top_priority from verdicts group by verdict",
    "average_precision": f"with {EVIDENCE.replace(SQL_VECTORS, SQL_PLANTED)}, r as (select (sample_id % 20 = 7)::int as t, row_number() over w as rk, sum((sample_id % 20 = 7)::int) over w as hits from scored window w as (order by round(suspicion, 6) desc, sample_id)) select round(sum(t * hits / rk::double) / sum(t), 6) as ap, round(sum(t) filter (rk <= 40) / 40::double, 6) as p40, round(sum(t) filter (rk <= 40) / sum(t)::double, 6) as r40, round(sum(t) filter (rk <= 80) / 80::double, 6) as p80, round(sum(t) filter (rk <= 80) / sum(t)::double, 6) as r80 from r",
    "review_effort": f"with {EVIDENCE.replace(SQL_VECTORS, SQL_PLANTED)}, r as (select row_number() over w as rk, sum((sample_id % 20 = 7)::int) over w as hits from scored window w as (order by round(suspicion, 6) desc, sample_id)), t as (select max(hits) as n, count(*) as rows from r) select recall::double as recall, min(rk) as reviews, round(any_value(ceil(recall * n) * (rows + 1) / (n + 1)), 4) as random_reviews from r, t, (select unnest([0.5::double, 0.8::double]) as recall) where hits >= ceil(recall * n) group by recall",
    "dynamics_table": f"with {SQL_VECTORS}, {_EPOCHS} select sample_id, round(confidence, 6) as confidence, round(variability, 6) as variability, round(correctness, 6) as correctness, forgetting, first_learned, category from dynamics",
    "confident_failures": f"with {SQL_PREDICTIONS} select sample_id, label, pred, conf from predictions where split in ('val', 'test') and pred <> label order by conf desc, sample_id limit 2000",
    "witnesses": f"""with {VERDICT}, w0 as (select *, round(abs(0.5 - p_given) * 2, 4) as mw, round(abs(0.5 - neighbor_same) * 2, 4) as nw2, round(abs(0.5 - centroid_ratio) * 2, 4) as cw from verdicts),
 st as (select sample_id, verdict, unnest([{{'witness': 'model', 'stance': case when m then 'prosecution' when p_given >= 0.6 then 'defense' else 'neutral' end, 'weight': mw, 'there': true}},
  {{'witness': 'neighbor', 'stance': case when nn then 'prosecution' when rn >= 0.35 and neighbor_same >= 0.6 then 'defense' else 'neutral' end, 'weight': nw2, 'there': true}},
  {{'witness': 'centroid', 'stance': case when o then 'prosecution' when centroid_ratio < 0.45 then 'defense' else 'neutral' end, 'weight': cw, 'there': true}},
  {{'witness': 'quality', 'stance': case when severity >= 0.6 then 'prosecution' else 'defense' end, 'weight': round(case when severity < 0.6 then 0.4 else severity end::double, 4), 'there': true}},
  {{'witness': 'duplicate', 'stance': 'prosecution', 'weight': case when dup_conflict then 1.0 else 0.6 end::double, 'there': dup_conflict or is_copy}},
  {{'witness': 'split', 'stance': case when leaks then 'prosecution' else 'defense' end, 'weight': case when leaks then 0.9 else 0.3 end::double, 'there': true}},
  {{'witness': 'dynamics', 'stance': case when dynamics in ('hard', 'forgotten') then 'prosecution' when dynamics = 'easy' then 'defense' else 'neutral' end, 'weight': 0.6::double, 'there': true}},
  {{'witness': 'rarity', 'stance': 'defense', 'weight': 0.8::double, 'there': hypothesis = 'rare_valid'}}]) as w from w0),
 ds as (select sample_id, round(coalesce(sum(w.weight) filter (w.there and w.stance = case when verdict in ('KEEP', 'LIKELY_RARE') then 'prosecution' else 'defense' end), 0), 4) as dissent from st group by sample_id)
 select verdict, w.witness as witness, w.stance as stance, count(*) as n, round(avg(w.weight) + 1e-9, 4) as weight, round(avg(dissent) + 1e-9, 4) as dissent from st join ds using (sample_id) where w.there group by all""",
    "rule_trace": f"with {VERDICT} select sample_id, verdict, substr(rule, 2)::bigint as looked_at, list_aggregate(list_transform(range(1, substr(rule, 2)::bigint + 1), lambda i: 'R' || i), 'string_agg', ',') as rules from verdicts",
    "case_candidates": f"with {HYP} select sample_id from hyp where action <> 'NO_ACTION' or hypothesis <> 'uncertain' or is_copy or dup_conflict or leaks",
    "case_value": f"""with {VERDICT}, w as (select * from (values ('balanced', 1.0, 0.6, 0.3, 0.6, 0.6, 0.3, 0.3), ('leakage', 0.5, 0.3, 0.1, 2.0, 0.2, 0.1, 0.1), ('label_errors', 0.8, 0.4, 0.2, 0.1, 2.0, 0.1, 0.2), ('model_impact', 0.5, 2.0, 0.2, 0.6, 0.5, 0.1, 0.2), ('quality', 0.5, 0.2, 0.1, 0.1, 0.2, 2.0, 0.1)) t(objective, risk, imp, unc, leak, lab, qual, cov)),
 x as (select *, case when split in ('val', 'test') then 0.6::double * strength else 0 end as impact, split in ('val', 'test') as held, case when verdict in ('LEAKAGE_ACTION_NEEDED', 'POSSIBLE_RELABEL') then 0.2 when verdict in ('UNCERTAIN', 'REVIEW') then 1.0 else 0.5 end::double as doubt from verdicts)
 select sample_id, objective, round(greatest((risk::double * priority + imp::double * impact + unc::double * 0.3::double * doubt + case when leaks then leak::double * strength else 0 end + case when m or nn or o then lab::double * strength else 0 end
  + case when severity >= 0.6 then qual::double * 0.6::double * strength else 0 end + case when held then cov::double * 0.2::double * strength else 0 end) * case when verdict = 'LIKELY_RARE' then 0.6 else 1.0 end::double, 0), 6) as value from x cross join w""",
    "influence_pairs": f"""with {SQL_PREDICTIONS}, res as (select sample_id, split, any_value(embedding) as x, list(p - (k = label)::int order by k) as r from probabilities group by sample_id, split),
 f as (select sample_id from predictions where split in ('val', 'test') and pred <> label order by conf desc, sample_id limit 2000),
 v as (select f.sample_id, t.sample_id as train_id, round(-(list_inner_product(a.r, t.r) * (list_inner_product(a.x, t.x) + 1) / 64), 6) as s from f join res a using (sample_id) join res t on t.split = 'train'),
 q as (select *, row_number() over (partition by sample_id order by s desc, train_id) as rk from v)
 select sample_id, train_id, 0.0::double - s as influence, rk from q where rk <= 3""",
    "counterfactual": f"""with {SQL_VECTORS}, {SQL_PROBABILITIES}, pk as (select *, (k = label)::int as y from probabilities),
 basis as (select k, i, sum((p - y) * (case when i = 65 then 1.0 else embedding[i] end::double)) as m from pk, range(1, 66) t(i) where split in ('val', 'test') group by all),
 basis_rows as (select k, list(m order by i) as m from basis group by k),
 ne as (select greatest(count(*), 1) as n_eval from vectors where split in ('val', 'test')),
 g as (select sample_id, label, pk.k, p, list_inner_product(list_append(embedding, 1.0), m) / 64 / n_eval as g from pk join basis_rows using (k), ne where split = 'train'),
 b as (select sample_id, label, sum(p * g) as pg, max(g) filter (k = label) as given from g group by all),
 o as (select sample_id, 0 as o, 'keep' as action, null::integer as target, 0.0 as delta from b union all select sample_id, 1, 'remove', null, round(pg - given, 6) from b
  union all select g.sample_id, 2, 'relabel', k::integer, round(g - given, 6) from g join b using (sample_id) where k <> g.label),
 r as (select *, row_number() over (partition by sample_id order by delta, o, coalesce(target, -1)) as r, count(*) over (partition by sample_id) as n_options from o)
 select r.sample_id, round(pg - given, 6) as influence, n_options, action as best_action, target as best_target, delta as best_delta from r join b using (sample_id) where r = 1""",
    "region_summary": f"""with {KNN}, {SQL_REGIONS}, a as (select region, label, split, density from vectors join regions using (sample_id) join density using (sample_id)), l as (select *, row_number() over (partition by region order by n desc, label) as r from (select region, label, count(*) as n from a group by region, label)),
 g as (select region, count(*) as size, avg(density) as density, count(*) filter (split = 'train') as n_train from a group by region), q as (select quantile_cont(density, 0.2) as q20, sum(size) as total from g)
 select region, size, n_train, l.label as dominant, round(l.n / size::double, 6) as purity, round(density, 6) as density, density <= q20 or size < greatest(3, 0.01 * total) as sparse from g join l using (region), q where r = 1""",
}


def confident_failures(spark, d):
    """Wrong predictions on evaluation samples, the most confident first."""
    return predictions.confident_failures(predictions.fold_predictions(vector_samples(spark, d))).select("sample_id", "label", "pred", "conf")


def counterfactual(spark, d):
    """For each training sample the change of evaluation loss by its removal, and the best of all options."""
    return predictions.counterfactuals(predictions.class_probabilities(vector_samples(spark, d))).select("sample_id", "influence", F.size("options").cast("bigint").alias("n_options"), "best_action", "best_target", "best_delta")


def influence_pairs(spark, d):
    """For each of the failures the three training samples that harm it most."""
    v = vector_samples(spark, d)
    p = materialize(predictions.class_probabilities(v), "probabilities")
    return predictions.pair_influence(p, predictions.confident_failures(predictions.fold_predictions(v)), 3)


def witnesses(spark, d):
    """Statements of the witnesses by stance, and the dissent from the verdicts."""
    w = labels.witnesses(_verdicts(spark, d))
    return w.select("verdict", "dissent", F.explode("witnesses").alias("w")).groupBy("verdict", "w.witness", "w.stance").agg(F.count("*").alias("n"), F.round(F.avg("w.weight") + 1e-9, 4).alias("weight"), F.round(F.avg("dissent") + 1e-9, 4).alias("dissent"))


def rule_trace(spark, d):
    """Rules looked at until one matched."""
    return labels.rule_trace(_verdicts(spark, d)).select("sample_id", "verdict", F.size("trace").cast("bigint").alias("looked_at"), F.array_join(F.transform("trace", lambda t: t["rule"]), ",").alias("rules"))


def case_candidates(spark, d):
    """Samples that suspicion, a hypothesis, copies or leakage name."""
    e = _hypotheses(spark, d)
    return labels.case_candidates(e.filter(F.col("action") != "NO_ACTION"), e.filter("hypothesis <> 'uncertain'"), e.filter("is_copy or dup_conflict"), e.filter("leaks"))


def case_value(spark, d):
    """What a review of each case is worth under each objective."""
    c = materialize(_verdicts(spark, d).select("sample_id", "verdict", "priority", "split", "strength", "impact", "categories", "uncertainty"), "verdicts")
    parts = [labels.case_value(c, o).select("sample_id", F.lit(o).alias("objective"), "value") for o in labels.OBJECTIVES]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def baseline_oof(spark, d):
    from plumbline.operators import modeling

    return modeling.out_of_fold(vector_samples(spark, d))


def kmeans_regions(spark, d):
    from plumbline.operators import modeling

    return modeling.kmeans_regions(vector_samples(spark, d)).select("sample_id", "label", "region")


def pca_map(spark, d):
    from plumbline.operators import modeling

    return modeling.pca_map(vector_samples(spark, d))


def self_influence(spark, d):
    from plumbline.operators import modeling

    return modeling.self_influence(vector_samples(spark, d))


def what_if(spark, d):
    """Remove the training samples that neighbours contradict most, relabel none."""
    from plumbline.operators import modeling

    v = vector_samples(spark, d)
    doubtful = similarity.neighbor_label_stats(_knn(spark, d), v).filter("neighbor_same = 0 and neighbor_major_share >= 0.5")
    return modeling.what_if(v, doubtful, v.limit(0).withColumn("target", F.col("label")))


QUERIES |= {f.__name__: f for f in (confident_failures, counterfactual, influence_pairs, witnesses, rule_trace, case_candidates, case_value, baseline_oof, kmeans_regions, pca_map, self_influence, what_if)}
