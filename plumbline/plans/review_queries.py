"""Queries over ``events`` as decisions and ledger, and governance over everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import written_once
from plumbline.operators import export, families, governance, review
from plumbline.plans import text_queries as texts
from plumbline.sources.bindings import SQL_DECISIONS, decisions, text_samples
from plumbline.sources.tables import table


def active_decisions(spark: SparkSession, d: str) -> DataFrame:
    return review.active_decisions(decisions(spark, d)).select("case_id", "reviewer", "decision_id", "action", "target")


def _status(spark, d):
    return review.case_status(review.active_decisions(decisions(spark, d)))


def case_status(spark, d):
    return _status(spark, d)


def final_decision(spark, d):
    return _status(spark, d).filter("final is not null").groupBy("status", "final").agg(F.count("*").alias("n"))


def validate_decision(spark, d):
    """Relabelling targets of a third of the decisions are dropped, to have some that cannot stand."""
    bad = F.when(F.col("decision_id") % 3 == 0, F.lit(None)).otherwise(F.coalesce("target", F.when(F.col("decision_id") % 19 == 0, 1)))
    return review.validate_decisions(decisions(spark, d).withColumn("target", bad.cast("int")))


def agreement_kappa(spark, d):
    return review.agreement(review.active_decisions(decisions(spark, d)))


def reviewer_activity(spark, d):
    return decisions(spark, d).groupBy("reviewer").agg(F.count("*").alias("n"), F.count_if("undone").alias("undone"), F.countDistinct("case_id").alias("cases"), F.max("decision_id").alias("last_id"))


def session_progress(spark, d):
    """Queues of 100 cases: how many are reviewed (not open)."""
    s = _status(spark, d).withColumn("queue", F.floor(F.col("case_id") / 100).cast("bigint"))
    return s.groupBy("queue").agg(F.count("*").alias("items"), F.count_if(F.col("status") != "open").alias("reviewed"))


def review_budget(spark, d):
    cases = _status(spark, d).filter("status in ('open', 'disputed')").select("case_id", F.round(F.lit(0.1) + (F.col("case_id") % 97) / 97.0, 6).alias("value"), (F.lit(0.75) + (F.col("case_id") % 3) * 0.5).alias("minutes"), (F.col("case_id") % 301).alias("family"), (F.col("case_id") % 7).alias("class"))
    return review.review_budget(cases, 100, 90.0)


def _ledger(spark, d):
    e = table(spark, d, "events")
    # Entries of an organisation are those of its users; each user is one chain, so that chains stay short.
    return e.select(F.col("user_id").alias("org"), F.col("event_id").alias("seq"), "event_type", F.col("event_id").alias("entity"), F.coalesce("props", F.lit("")).alias("payload"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def ledger_chain(spark, d):
    return review.ledger_append(_ledger(spark, d)).groupBy("org").agg(F.count("*").alias("entries"), F.max_by("hash", "seq").alias("head"))


def ledger_verify(spark, d):
    """Chains in which every 500th entry's payload was changed afterwards."""
    chained = review.ledger_append(_ledger(spark, d))
    return review.ledger_verify(chained.withColumn("payload", F.when(F.col("seq") % 500 == 499, F.concat("payload", F.lit("x"))).otherwise(F.col("payload"))))


def issue_rates_window(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def stream_decisions(spark, d):
    """Case status kept live from the log of votes and withdrawals; equal to ``case_status``."""
    from plumbline.streaming.live_facts import live_cases, run_to_end

    return run_to_end(spark, d, live_cases)


def stream_facts(spark, d):
    """Facts on cases after the whole log of votes and withdrawals, kept live from batch to batch."""
    from plumbline.streaming.live_facts import run_to_end

    return run_to_end(spark, d)


def stream_issue_rates(spark, d):
    from plumbline.streaming.issue_rates import run_to_end

    return run_to_end(spark, d)


def facts(spark, d):
    """The facts, written once: debt, preflight, contract and reports read the same row."""
    return written_once(spark, d, "facts", lambda: _facts(spark, d))


def _facts(spark, d):
    """One row of counts over the texts and the decisions, from which governance is decided."""
    h = texts._hashed(spark, d)
    fam = families.exact_families(h)
    leaks = families.family_leaks(h)
    quality = texts.quality_rules(spark, d).filter("severity in ('medium', 'high')")
    status = _status(spark, d)
    counts = h.groupBy("label").count()
    classes = lambda where: h.filter(where).select("label").distinct()
    rows = [
        h.agg(F.count("*").alias("sample_count"), F.count_if(F.col("split") != "train").alias("eval_count"), F.round(F.avg(F.col("source").isNotNull().cast("double")), 6).alias("provenance_coverage"), F.round(F.avg((F.coalesce(F.col("text_chars"), F.lit(0)) == 0).cast("double")), 6).alias("unreadable_fraction")),
        counts.agg(F.count("*").alias("class_count"), F.min("count").alias("min_class_count"), F.round(F.max("count") / F.min("count"), 6).alias("imbalance_ratio")),
        classes("split <> 'train'").join(classes("split = 'train'"), "label", "left_anti").agg(F.count("*").alias("missing_from_train")),
        classes("true").join(classes("split <> 'train'"), "label", "left_anti").agg(F.count("*").alias("missing_from_eval")),
        fam.agg(F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("redundant_samples"), F.count("*").alias("duplicate_families")),
        leaks.agg(F.coalesce(F.sum("n_eval"), F.lit(0)).cast("bigint").alias("eval_samples_leaking"), F.coalesce(F.sum(F.when(F.col("kind") == "exact_cross_split", F.col("n_eval")).otherwise(0)), F.lit(0)).cast("bigint").alias("exact_eval_leaks"), F.count_if(F.col("risk").isin("high", "critical")).alias("leakage_high")),
        quality.agg(F.countDistinct("sample_id").alias("quality_samples")),
        texts.cramers_v(spark, d).agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("shortcut_max")),
        texts.underrepresented(spark, d).agg(F.count_if(F.col("priority") == "high").alias("gaps_high"), F.count_if(F.col("priority") == "medium").alias("gaps_medium")),
        status.agg(F.count_if(F.col("status").isin("open", "disputed")).alias("unresolved_cases"), F.count_if(F.col("status") == "disputed").alias("unresolved_high_priority"), F.count_if((F.col("status") == "disputed") & (F.col("case_id") % 2 == 0)).alias("unresolved_label_strong"), F.count_if(F.col("status") == "open").alias("unresolved_label_review")),
    ]
    out = rows[0]
    for r in rows[1:]:  # one row each
        out = out.crossJoin(r)
    return out


def debt(spark, d):
    return governance.debt(facts(spark, d))


def preflight(spark, d):
    return governance.preflight(facts(spark, d))


CONTRACT = [("exact_eval_leaks", "<=", 0), ("leakage_high", "<=", 5), ("min_class_count", ">=", 30), ("unresolved_label_strong", "<=", 2000), ("imbalance_ratio", "<=", 10), ("shortcut_max", "<", 0.5), ("class_count", "==", 4), ("eval_count", ">", 0)]


def contract(spark, d):
    return governance.contract(facts(spark, d), CONTRACT)


LEVEL_CONTRACT = [("debt_overall", "<=", "MODERATE"), ("debt_leakage", "<=", "LOW"), ("debt_quality", "<", "CRITICAL"), ("preflight", "<=", "READY_WITH_WARNINGS"), ("debt_nothing", "<=", "LOW")]


def contract_levels(spark, d):
    """Rules on the levels of debt and the status of the preflight; the last names a metric that isn't there."""
    levels = debt(spark, d).select(F.explode(F.array(F.struct(F.concat(F.lit("debt_"), "dimension").alias("metric"), "level"), F.struct(F.lit("debt_overall").alias("metric"), F.col("overall").alias("level")))).alias("x")).select("x.*").distinct()
    status = preflight(spark, d).select(F.lit("preflight").alias("metric"), F.col("status").alias("level")).distinct()
    return governance.contract_levels(levels.unionByName(status), LEVEL_CONTRACT)


def export_clean(spark, d):
    """Decisions on cases applied to the documents of the same number."""
    h = texts._hashed(spark, d)
    final = _status(spark, d).filter("final is not null").select(F.col("case_id").alias("sample_id"), F.split("final", ":")[0].alias("action"), F.get(F.split("final", ":"), F.lit(1)).alias("target"))
    return families.export_clean(h, final).select("sample_id", "split", "label", "action", "path")


def _decided(spark, d):
    h = texts._hashed(spark, d).select("sample_id", F.concat_ws("/", "split", "label", F.concat(F.col("sample_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("raw_sha").alias("sha"), "label", "split")
    return h, export.applied(h, export.final_decisions(review.active_decisions(decisions(spark, d))))


def export_log(spark, d):
    """The log of the decisions that the cleaned version applies."""
    return export.action_log(_decided(spark, d)[1]).withColumn("decided_at", F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss"))


def export_removed(spark, d):
    return export.removed_list(_decided(spark, d)[1])


def export_relabels(spark, d):
    return export.relabel_map(_decided(spark, d)[1])


def export_summary(spark, d):
    """The cleaned version's number and counts; each split of the corpus counts as a version before."""
    samples, decided = _decided(spark, d)
    return export.summary(samples, decided, samples.agg(F.countDistinct("split").alias("version_number")))


def change_set(spark, d):
    """Effects of decisions on documents: removed, relabelled, dropped from evaluation, protected."""
    s = text_samples(spark, d)
    final = _status(spark, d).filter("final is not null").select(F.col("case_id").alias("sample_id"), "final")
    protect = s.filter("sample_id % 41 = 0").select("sample_id")
    acts = s.join(final, "sample_id").select("sample_id", F.when(F.col("final") == "remove", F.when(F.col("split") == "train", "remove").otherwise("eval_drop")).when(F.startswith("final", F.lit("relabel")), "relabel").alias("effect")).filter("effect is not null")
    kept = acts.join(protect, "sample_id", "left_anti")
    return kept.groupBy("effect").agg(F.count("*").alias("n"), F.sum("sample_id").alias("ids")).unionByName(acts.join(protect, "sample_id", "left_semi").agg(F.lit("protected").alias("effect"), F.count("*").alias("n"), F.sum("sample_id").alias("ids")))


QUERIES = {f.__name__: f for f in (active_decisions, case_status, final_decision, validate_decision, agreement_kappa, reviewer_activity, session_progress, review_budget, ledger_chain, ledger_verify, issue_rates_window, stream_decisions, stream_facts, stream_issue_rates, facts, debt, preflight, contract, contract_levels, export_clean, export_log, export_removed, export_relabels, export_summary, change_set)}

ACTIVE = SQL_DECISIONS + """, active as (select case_id, reviewer, decision_id, action, target, adjudicate, created_at from (select *, row_number() over (partition by case_id, reviewer order by created_at desc, decision_id desc) as r from decisions where not undone) where r = 1),
voted as (select *, action || coalesce(':' || target, '') as key, action in ('keep', 'relabel', 'remove') as decisive from active),
st0 as (select case_id, count(*) as votes, max_by(key, (created_at, decision_id)) filter (adjudicate) as adj, count(distinct key) filter (decisive) as kinds, min(key) filter (decisive) as only_, bool_or(action = 'escalate') as esc from voted group by case_id),
st as (select case_id, votes, case when adj is not null then 'resolved' when esc or kinds > 1 then 'disputed' when kinds = 1 then 'decided' else 'open' end as status, case when adj is not null then adj when not esc and kinds = 1 then only_ end as final from st0)"""
LEDGER = """entries as (select user_id as org, event_id as seq, event_type, event_id as entity, coalesce(props, '') as payload, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, row_number() over (partition by user_id order by event_id) as i from events),
chain as (select org, seq, i, sha256(repeat('0', 64) || chr(31) || event_type || chr(31) || entity || chr(31) || sha256(payload) || chr(31) || ts) as hash from entries where i = 1
 union all select e.org, e.seq, e.i, sha256(c.hash || chr(31) || e.event_type || chr(31) || e.entity || chr(31) || sha256(e.payload) || chr(31) || e.ts) from chain c join entries e on e.org = c.org and e.i = c.i + 1)"""
_BODY = texts.QUALITY[len(texts.SQL_TEXT):]
_CUES = texts.CUES[len(texts.ATTR):]
FACTS = texts.HASHED + _BODY + _CUES + ", fit as (select * from cues where split = 'train')" + texts.CRAMER.format(p="f", src="fit") + ", " + ACTIVE + """,
leak as (""" + texts.ORACLES["family_leaks"].split("with ", 1)[1][len(texts.HASHED):].lstrip(", \n").join(["with ", ""]) + """),
under as (with c as (select label, count(*) as n from samples where split = 'train' group by label), m as (select quantile_cont(n::double, 0.5) as med from c) select case when n < 30 then 'high' else 'medium' end as priority from c, m where n < greatest(30, 1.5 * med)),
cls as (select label, count(*) as n, bool_or(split = 'train') as tr, bool_or(split <> 'train') as ev from samples group by label),
facts as (select (select count(*) from samples) as sample_count, (select count(*) filter (split <> 'train') from samples) as eval_count, (select round(avg((source is not null)::int::double), 6) from samples) as provenance_coverage, (select round(avg((coalesce(length(text), 0) = 0)::int::double), 6) from samples) as unreadable_fraction,
 (select count(*) from cls) as class_count, (select min(n) from cls) as min_class_count, (select round(max(n) / min(n)::double, 6) from cls) as imbalance_ratio, (select count(*) filter (ev and not tr) from cls) as missing_from_train, (select count(*) filter (not ev) from cls) as missing_from_eval,
 (select coalesce(sum(n - 1), 0)::bigint from (select count(*) as n from hashed where norm_sha is not null group by norm_sha having count(*) > 1)) as redundant_samples, (select count(*) from (select 1 from hashed where norm_sha is not null group by norm_sha having count(*) > 1)) as duplicate_families,
 (select coalesce(sum(n_eval), 0)::bigint from leak) as eval_samples_leaking, (select coalesce(sum(n_eval) filter (kind = 'exact_cross_split'), 0)::bigint from leak) as exact_eval_leaks, (select count(*) filter (risk in ('high', 'critical')) from leak) as leakage_high,
 (select count(distinct sample_id) from quality where severity in ('medium', 'high')) as quality_samples, (select coalesce(max(round(v, 6)), 0.0) from fv) as shortcut_max, (select count(*) filter (priority = 'high') from under) as gaps_high, (select count(*) filter (priority = 'medium') from under) as gaps_medium,
 (select count(*) filter (status in ('open', 'disputed')) from st) as unresolved_cases, (select count(*) filter (status = 'disputed') from st) as unresolved_high_priority, (select count(*) filter (status = 'disputed' and case_id % 2 = 0) from st) as unresolved_label_strong, (select count(*) filter (status = 'open') from st) as unresolved_label_review)"""
DEBT = FACTS + """, dims as (select unnest([
 {'dimension': 'label', 'v': (unresolved_label_strong + 0.5 * unresolved_label_review) / sample_count::double, 'm': 0.01, 'h': 0.03, 'k': 0.08, 'floor': 0, 's': true},
 {'dimension': 'leakage', 'v': eval_samples_leaking / eval_count::double, 'm': 0.005, 'h': 0.02, 'k': 0.05, 'floor': case when exact_eval_leaks > 0 then 2 else 0 end, 's': true},
 {'dimension': 'quality', 'v': quality_samples / sample_count::double, 'm': 0.02, 'h': 0.05, 'k': 0.12, 'floor': 0, 's': true},
 {'dimension': 'coverage', 'v': (2 * gaps_high + gaps_medium + case when imbalance_ratio >= 10 then 3 when imbalance_ratio >= 4 then 1 else 0 end)::double, 'm': 2, 'h': 5, 'k': 9, 'floor': 0, 's': true},
 {'dimension': 'shortcut', 'v': shortcut_max, 'm': 0.3, 'h': 0.5, 'k': 0.7, 'floor': 0, 's': true}, {'dimension': 'duplication', 'v': redundant_samples / sample_count::double, 'm': 0.02, 'h': 0.05, 'k': 0.15, 'floor': 0, 's': true},
 {'dimension': 'review', 'v': unresolved_high_priority / sample_count::double, 'm': 0.01, 'h': 0.03, 'k': 0.08, 'floor': 0, 's': true}, {'dimension': 'provenance', 'v': 1 - provenance_coverage, 'm': 0.1, 'h': 0.5, 'k': 0.9, 'floor': 0, 's': false}], recursive := true) from facts),
ranked as (select *, greatest(case when v >= k then 3 when v >= h then 2 when v >= m then 1 else 0 end, floor) as rk from dims),
ov as (select max(rk) filter (s) as t, count(*) filter (s and rk = 1) as mods from ranked)"""
ORACLES = {
    "active_decisions": f"with {ACTIVE} select case_id, reviewer, decision_id, action, target from active",
    "case_status": f"with {ACTIVE} select case_id, votes, status, final from st",
    "final_decision": f"with {ACTIVE} select status, final, count(*) as n from st where final is not null group by all",
    "validate_decision": f"with {SQL_DECISIONS}, x as (select decision_id, action, case when decision_id % 3 = 0 then null else coalesce(target, case when decision_id % 19 = 0 then 1 end) end as target from decisions) select decision_id, case when action = 'relabel' then 'relabel needs a target' else 'only a relabel has a target' end as reason from x where (action = 'relabel' and target is null) or (action <> 'relabel' and target is not null)",
    "agreement_kappa": f"with {ACTIVE}, v as (select case_id, reviewer, action from active where not adjudicate), p as (select a.action as x, b.action as y from v a join v b on a.case_id = b.case_id and a.reviewer < b.reviewer), s as (select action, count(*) as w from (select x as action from p union all select y from p) group by 1), e as (select sum(w * w) / (sum(w) * sum(w))::double as pe from s), o as (select count(*) as pairs, avg((x = y)::int::double) as po from p) select pairs, round(po, 6) as agreement, round((po - pe) / (1 - pe), 6) as kappa from o, e",
    "reviewer_activity": f"with {SQL_DECISIONS} select reviewer, count(*) as n, count(*) filter (undone) as undone, count(distinct case_id) as cases, max(decision_id) as last_id from decisions group by reviewer",
    "session_progress": f"with {ACTIVE} select case_id // 100 as queue, count(*) as items, count(*) filter (status <> 'open') as reviewed from st group by 1",
    "review_budget": f"with {ACTIVE}, c as (select case_id, round(0.1 + (case_id % 97) / 97.0::double, 6) as value, 0.75 + (case_id % 3) * 0.5::double as minutes, case_id % 301 as family, case_id % 7 as class from st where status in ('open', 'disputed')), r as (select *, round(value * pow(0.5, row_number() over (partition by family order by value desc, case_id) - 1) * pow(0.85, least(row_number() over (partition by class order by value desc, case_id) - 1, 10)) / minutes, 9) as ratio from c), t as (select * from r order by ratio desc, case_id limit 100), w as (select row_number() over x as rank, case_id, ratio, round(sum(minutes) over x, 6) as spent from t window x as (order by ratio desc, case_id)) select * from w where spent <= 90",
    "ledger_chain": f"with recursive {LEDGER} select org, count(*) as entries, max_by(hash, seq) as head from chain group by org",
    "ledger_verify": "select user_id as org, count(*) as entries, count(*) filter (event_id % 500 = 499) = 0 as valid, min(event_id) filter (event_id % 500 = 499) as broken_at from events group by user_id",
    "issue_rates_window": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by all",
    "stream_decisions": f"with {ACTIVE} select case_id, votes, status, final from st",
    "stream_facts": f"with {ACTIVE} select " + ", ".join(f"count(*) filter ({e}) as {m}" for m, e in review.DECISION_FACTS.items()) + " from st",
    "facts": f"with {FACTS} select * from facts",
    "debt": f"with {DEBT} select dimension, round(v, 5)::double as value, ['LOW', 'MODERATE', 'HIGH', 'CRITICAL'][rk + 1] as level, round(least(100, 100 * v / k::double), 1)::double as score, ['LOW', 'MODERATE', 'HIGH', 'CRITICAL'][case when t = 3 then 3 when t = 2 or mods >= 3 then 2 else t end + 1] as overall from ranked, ov",
    "preflight": f"""with {FACTS}, c as (select unnest([{{'check': 'readable', 'outcome': case when unreadable_fraction > 0.2 then 'block' when unreadable_fraction > 0 then 'warn' else 'pass' end}}, {{'check': 'min_classes', 'outcome': case when class_count < 2 then 'block' else 'pass' end}}, {{'check': 'train_covers_eval', 'outcome': case when missing_from_train > 0 then 'block' else 'pass' end}},
 {{'check': case when eval_count > 0 then 'eval_covers_classes' else 'has_eval_split' end, 'outcome': case when eval_count = 0 or missing_from_eval > 0 then 'warn' else 'pass' end}}, {{'check': 'exact_eval_leakage', 'outcome': case when exact_eval_leaks > 0 then 'block' else 'pass' end}}, {{'check': 'near_eval_leakage', 'outcome': case when eval_samples_leaking > exact_eval_leaks then 'warn' else 'pass' end}},
 {{'check': 'critical_cases', 'outcome': case when unresolved_high_priority / sample_count::double > 0.1 then 'block' when unresolved_high_priority > 0 then 'warn' else 'pass' end}}, {{'check': 'imbalance', 'outcome': case when imbalance_ratio > 10 then 'warn' else 'pass' end}}, {{'check': 'min_per_class', 'outcome': case when min_class_count < 30 then 'warn' else 'pass' end}}, {{'check': 'shortcut', 'outcome': case when shortcut_max >= 0.5 then 'warn' else 'pass' end}},
 {{'check': 'coverage', 'outcome': case when gaps_high > 0 then 'warn' else 'pass' end}}, {{'check': 'review_queue', 'outcome': case when unresolved_cases >= 1 then 'warn' else 'pass' end}}, {{'check': 'provenance', 'outcome': case when 1 - provenance_coverage > 0.5 then 'warn' else 'pass' end}}], recursive := true) from facts)
 select "check", outcome, (select case when bool_or(outcome = 'block') then 'BLOCKED' when bool_or(outcome = 'warn') then 'READY_WITH_WARNINGS' else 'READY' end from c) as status from c""",
    "contract": f"with {FACTS} " + " union all ".join(f"select '{m}' as metric, '{op}' as op, {float(v)}::double as expected, round({m}::double, 5) as actual, {m} {'=' if op == '==' else op} {v} as passed from facts" for m, op, v in CONTRACT),
    "export_clean": f"with {texts.HASHED}, {ACTIVE}, f as (select case_id as sample_id, split_part(final, ':', 1) as action, nullif(split_part(final, ':', 2), '') as target from st where final is not null), k as (select sample_id, split, case when action = 'relabel' then target else label end as label, coalesce(action, 'keep') as action, source, raw_sha from hashed left join f using (sample_id) where coalesce(action, 'keep') <> 'remove'), p as (select *, concat_ws('/', split, label, source || '.txt') as path from k), n as (select *, row_number() over (partition by path order by sample_id) as i from p) select sample_id, split, label, action, case when i > 1 then regexp_replace(path, '\\.txt$', '-' || coalesce(substring(raw_sha, 1, 8), '') || '-' || sample_id || '.txt') else path end as path from n",
    "change_set": f"with {texts.SQL_TEXT}, {ACTIVE}, a as (select sample_id, case when final = 'remove' then case when split = 'train' then 'remove' else 'eval_drop' end when final like 'relabel%' then 'relabel' end as effect from samples join st on case_id = sample_id where final is not null), b as (select * from a where effect is not null) select effect, count(*) as n, sum(sample_id)::bigint as ids from b where sample_id % 41 <> 0 group by effect union all select 'protected', count(*), sum(sample_id)::bigint from b where sample_id % 41 = 0",
}
ORACLES["contract_levels"] = f"""with d as ({ORACLES["debt"]}), p as ({ORACLES["preflight"]}),
 a as (select 'debt_' || dimension as metric, level from d union select 'debt_overall', overall from d union select 'preflight', status from p),
 rules(metric, op, expected) as (values {", ".join(f"('{m}', '{op}', '{e}')" for m, op, e in LEVEL_CONTRACT)}),
 ranks(word, n) as (values {", ".join(f"('{w}', {i})" for order in (governance.LEVELS, governance.STATUSES) for i, w in enumerate(order))})
 select metric, op, expected, level, coalesce(case op when '<=' then x.n <= y.n when '<' then x.n < y.n when '>=' then x.n >= y.n when '>' then x.n > y.n else x.n = y.n end, false) as passed
 from rules left join a using (metric) left join ranks x on x.word = level left join ranks y on y.word = expected"""
_DECIDED = f"""with {texts.HASHED}, {ACTIVE},
 settled as (select v.*, st.status = 'resolved' as adjudicated, row_number() over (partition by v.case_id order by v.created_at desc, v.decision_id desc) as i from voted v join st on st.case_id = v.case_id where st.status = 'resolved' and v.adjudicate or st.status = 'decided' and v.decisive),
 decided as (select sample_id, s.split || '/' || label || '/' || sample_id || '.txt' as path, raw_sha as sha, label, s.split, d.case_id, d.decision_id, d.reviewer, d.created_at, d.adjudicated, d.target, case when action = 'remove' then 'remove' when action = 'relabel' and target is not null then 'relabel' else 'keep' end as applied
 from hashed s join settled d on d.case_id = s.sample_id where i = 1 and action in ('keep', 'relabel', 'remove'))"""
ORACLES |= {
    "export_log": f"{_DECIDED} select case_id, applied as action, path, reviewer, strftime(created_at, '%Y-%m-%d %H:%M:%S') as decided_at, adjudicated from decided",
    "export_removed": f"{_DECIDED} select path, sha, label, split, case_id, decision_id from decided where applied = 'remove'",
    "export_relabels": f"{_DECIDED} select path, sha, label as from_label, target::varchar as to_label, case_id, decision_id from decided where applied = 'relabel'",
    "export_summary": f"{_DECIDED} select n.v + 1 as version_number, n.s as samples, n.s - r.removed as exported, r.* from (select count(*) as s, count(distinct split) as v from hashed) n, (select count(*) filter (applied = 'remove') as removed, count(*) filter (applied = 'relabel') as relabelled, count(*) as applied_cases from decided) r",
}
