"""Human decisions: latest votes, case status, agreement, budget, and the ledger."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DECISIVE = ("keep", "relabel", "remove")
#: Facts that follow from the status of cases: how many of them meet a condition.
DECISION_FACTS = {
    "unresolved_cases": "status in ('open', 'disputed')",
    "unresolved_high_priority": "status = 'disputed'",
    "unresolved_label_strong": "status = 'disputed' and case_id % 2 = 0",
    "unresolved_label_review": "status = 'open'",
    "decided_cases": "status in ('decided', 'resolved')",
    "disputed_cases": "status = 'disputed'",
    "resolved_cases": "status = 'resolved'",
    "removals": "final = 'remove'",
    "relabellings": "final like 'relabel%'",
}


def active_decisions(decisions: DataFrame) -> DataFrame:
    """The latest decision of each reviewer on each case that was not undone."""
    latest = F.max(F.struct("created_at", "decision_id", "action", "target", "adjudicate"))
    return decisions.filter(~F.col("undone")).groupBy("case_id", "reviewer").agg(latest.alias("d")).select("case_id", "reviewer", "d.decision_id", "d.action", "d.target", "d.adjudicate", "d.created_at")


def case_status(active: DataFrame) -> DataFrame:
    """Status (open, decided, disputed, resolved) and final action of each case.

    An adjudication resolves; escalation or different decisive votes dispute; equal ones decide.
    """
    key = F.concat_ws(":", "action", F.col("target").cast("string"))
    decisive = F.col("action").isin(*DECISIVE)
    g = active.groupBy("case_id").agg(
        F.max(F.when(F.col("adjudicate"), F.struct("created_at", "decision_id", key.alias("key")))).alias("adj"),
        F.countDistinct(F.when(decisive, key)).alias("kinds"),
        F.min(F.when(decisive, key)).alias("only"),
        F.bool_or(F.col("action") == "escalate").alias("escalated"),
        F.count("*").alias("votes"),
    )
    status = F.when(F.col("adj").isNotNull(), "resolved").when(F.col("escalated") | (F.col("kinds") > 1), "disputed").when(F.col("kinds") == 1, "decided").otherwise("open")
    final = F.when(F.col("status") == "resolved", F.col("adj.key")).when(F.col("status") == "decided", F.col("only"))
    return g.withColumn("status", status).select("case_id", "votes", "status", final.alias("final"))


def validate_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions that cannot stand: a relabelling without a target, or a target without a relabelling."""
    bad = F.when((F.col("action") == "relabel") & F.col("target").isNull(), "relabel needs a target").when((F.col("action") != "relabel") & F.col("target").isNotNull(), "only a relabel has a target")
    return decisions.withColumn("reason", bad).filter("reason is not null").select("decision_id", "reason")


def agreement(active: DataFrame) -> DataFrame:
    """Share of agreeing pairs of reviewers on one case, and Cohen's kappa with pooled category shares; adjudications left out.

    Pairs are counted from the votes of each case by action (n choose 2), not enumerated.
    """
    votes = active.filter(~F.col("adjudicate"))
    cells = votes.groupBy("case_id", "action").agg(F.count("*").alias("n"))
    per_case = cells.groupBy("case_id").agg(F.sum("n").alias("v"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"))
    pairs = per_case.filter("v >= 2").agg(F.sum(F.col("v") * (F.col("v") - 1) / 2).alias("pairs"), F.sum("same").alias("same"))
    weighted = cells.join(per_case.filter("v >= 2").select("case_id", "v"), "case_id").groupBy("action").agg(F.sum(F.col("n") * (F.col("v") - 1)).alias("w"))
    pe = weighted.agg((F.sum(F.col("w") * F.col("w")) / (F.sum("w") * F.sum("w"))).alias("pe"))
    po = F.col("same") / F.col("pairs")
    return pairs.crossJoin(pe).select(F.coalesce("pairs", F.lit(0)).cast("bigint").alias("pairs"), F.round(po, 6).alias("agreement"), F.round(F.when(F.col("pe") < 1, (po - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def review_budget(cases: DataFrame, max_items: int, max_minutes: float) -> DataFrame:
    """Cases by value per minute until the budget is used, with discounts for family and class fixed beforehand.

    ``cases``: case_id, value, minutes, family, class. The k-th best case of a family counts
    0.5 ** (k - 1), the k-th of a class 0.85 ** min(k - 1, 10).
    """
    fam = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("value"), "case_id")) - 1
    cls = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("value"), "case_id")) - 1
    ratio = F.round(F.col("value") * F.pow(F.lit(0.5), fam) * F.pow(F.lit(0.85), F.least(cls, F.lit(10))) / F.col("minutes"), 9)
    top = cases.withColumn("ratio", ratio).orderBy(F.desc("ratio"), "case_id").limit(max_items)
    w = Window.orderBy(F.desc("ratio"), "case_id").rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumns({"spent": F.round(F.sum("minutes").over(w), 6), "rank": F.row_number().over(Window.orderBy(F.desc("ratio"), "case_id"))}).filter(F.col("spent") <= max_minutes).select("rank", "case_id", "ratio", "spent")


def ledger_append(entries: DataFrame) -> DataFrame:
    """Chain ``entries`` (org, seq, event_type, entity, payload, ts): each hash covers the one before (``prev``, ``hash``).

    A chain is sequential by definition, so an organisation's entries pass through one task in
    order; but they stream, and only the last hash is kept, so that nothing is gathered.
    ``ledger_verify`` checks all entries in parallel.
    """
    body = F.concat_ws("\x1f", "event_type", F.col("entity").cast("string"), F.sha2("payload", 256), F.col("ts").cast("string"))
    rows = entries.select("org", "seq", body.alias("body")).repartition("org").sortWithinPartitions("org", "seq")
    key = rows.schema["org"].dataType.simpleString()
    kind = rows.schema["seq"].dataType.simpleString()

    def chain(batches):
        org, prev, begun = None, "0" * 64, False
        for batch in batches:
            before, after = [], []
            for o, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not begun or o != org:
                    org, prev, begun = o, "0" * 64, True
                before.append(prev)
                prev = hashlib.sha256((prev + "\x1f" + body).encode()).hexdigest()
                after.append(prev)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, pa.string()), pa.array(after, pa.string())], names=["org", "seq", "prev", "hash"])

    return entries.join(rows.mapInArrow(chain, f"org {key}, seq {kind}, prev string, hash string"), ["org", "seq"])


def ledger_verify(ledger: DataFrame) -> DataFrame:
    """For each organisation: entries, whether the chain holds, and the first entry at which it breaks."""
    w = Window.partitionBy("org").orderBy("seq")
    body = F.concat_ws("\x1f", "prev", "event_type", F.col("entity").cast("string"), F.sha2("payload", 256), F.col("ts").cast("string"))
    bad = (F.col("prev") != F.coalesce(F.lag("hash").over(w), F.lit("0" * 64))) | (F.col("hash") != F.sha2(body, 256))
    marked = ledger.withColumn("bad", bad)
    return marked.groupBy("org").agg(F.count("*").alias("entries"), (~F.bool_or("bad")).alias("valid"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("broken_at"))
