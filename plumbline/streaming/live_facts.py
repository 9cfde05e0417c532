"""Case status and facts kept live from a log of votes and withdrawals, in keyed streaming state.

The log has ``decision_id``, ``case_id``, ``reviewer``, ``action``, ``target``, ``adjudicate``,
``created_at`` and ``undo``: a row with ``undo`` withdraws the vote of that id, whichever of the two
comes first, and the vote before it counts again. Each batch reads and writes the state of the cases
it touches, and nothing else. What changed goes to two append-only tables:

``changes``  the status of a touched case before and after the batch
``facts``    one row per batch: by how much each fact changes, retractions being negative
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.functions.shared_storage import scratch_path
from plumbline.operators.review import DECISION_FACTS, DECISIVE, active_decisions, case_status
from plumbline.sources.bindings import decisions

LOG = ["decision_id", "case_id", "reviewer", "action", "target", "adjudicate", "created_at", "undo"]
_AFTER = "case_id bigint, votes bigint, status string, final string"
CHANGES = f"{_AFTER}, old_votes bigint, old_status string, old_final string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def status_of(votes: list[tuple]) -> tuple[int, str | None, str | None]:
    """Votes that count, status and final action of a case, from its standing votes (created_at, decision_id, reviewer, action, target, adjudicate); by the rules of ``case_status``."""
    latest: dict[int | None, tuple] = {}
    for v in sorted(votes, key=lambda v: (v[0], v[1])):
        latest[v[2]] = v
    if not latest:
        return 0, None, None
    key = {v[1]: v[3] if v[4] is None else f"{v[3]}:{v[4]}" for v in latest.values()}
    decisive = sorted({key[v[1]] for v in latest.values() if v[3] in DECISIVE})
    adjudged = max(((v[0], key[v[1]]) for v in latest.values() if v[5]), default=None)
    n = len(latest)
    if adjudged:
        return n, "resolved", adjudged[1]
    if len(decisive) > 1 or any(v[3] == "escalate" for v in latest.values()):
        return n, "disputed", None
    return (n, "decided", decisive[0]) if decisive else (n, "open", None)


class CaseState(StatefulProcessor):
    """The standing votes of a case, the withdrawals whose votes haven't come yet, and the last status told."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.votes = handle.getMapState("votes", "decision_id bigint", "at_us bigint, reviewer bigint, action string, target int, adjudicate boolean")
        self.withdrawn = handle.getMapState("withdrawn", "decision_id bigint", "seen boolean")
        self.told = handle.getValueState("told", "votes bigint, status string, final string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for r in batch.itertuples(index=False):
                vote = (int(r.decision_id),)
                if r.undo:
                    self.withdrawn.updateValue(vote, (True,))
                    if self.votes.containsKey(vote):
                        self.votes.removeKey(vote)
                elif not self.withdrawn.containsKey(vote):
                    number = lambda x: None if pd.isna(x) else int(x)
                    self.votes.updateValue(vote, (int(r.at_us), number(r.reviewer), r.action, number(r.target), bool(r.adjudicate)))
        standing = [(v[0], k[0], *v[1:]) for k, v in self.votes.iterator()]
        now, before = status_of(standing), self.told.get() if self.told.exists() else (0, None, None)
        self.told.update(now)
        yield pd.DataFrame([(int(key[0]), *now, *before)], columns=[c.split()[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def case_changes(log: DataFrame) -> DataFrame:
    """The status of every case that a batch of the streaming ``log`` touches, after and before."""
    rows = log.select("case_id", "decision_id", "reviewer", "action", "target", F.coalesce("adjudicate", F.lit(False)).alias("adjudicate"), F.coalesce("undo", F.lit(False)).alias("undo"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("at_us"))
    return rows.filter("case_id is not null and decision_id is not null").groupBy("case_id").transformWithStateInPandas(CaseState(), CHANGES, "Update", "none")


def write_changes(store: str, measures: dict[str, str] | None = None):
    """A ``foreachBatch`` function. A batch that is run again overwrites its own folders, so nothing counts twice."""
    measures = measures or DECISION_FACTS

    def write(batch: DataFrame, batch_id: int) -> None:
        changes = f"{store}/changes/batch={batch_id}"
        batch.write.mode("overwrite").parquet(changes)
        rows = batch.sparkSession.read.parquet(changes)
        side = lambda prefix, sign: rows.select("case_id", *[F.col(prefix + c).alias(c) for c in ("votes", "status", "final")], F.lit(sign).alias("sign")).filter("status is not null")
        both = side("", 1).unionByName(side("old_", -1))
        delta = both.agg(*[F.coalesce(F.sum(F.when(F.expr(e), F.col("sign"))), F.lit(0)).cast("bigint").alias(m) for m, e in measures.items()])
        delta.coalesce(1).write.mode("overwrite").parquet(f"{store}/facts/batch={batch_id}")

    return write


def live_cases(spark: SparkSession, store: str) -> DataFrame:
    """The present status of all cases with a standing vote."""
    last = spark.read.parquet(f"{store}/changes").groupBy("case_id").agg(F.max_by(F.struct("votes", "status", "final"), "batch").alias("s"))
    return last.select("case_id", "s.*").filter("status is not null")


def live_facts(spark: SparkSession, store: str) -> DataFrame:
    """The present facts: the sum of one small row per batch."""
    rows = spark.read.parquet(f"{store}/facts").drop("batch")
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns])


def start(log: DataFrame, store: str, progress: str, measures: dict[str, str] | None = None):
    """Start folding the streaming ``log`` into ``store``. The state goes to RocksDB stores, checkpointed under ``progress``."""
    spark, setting = log.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, STATE_STORE)
    try:
        return case_changes(log).writeStream.foreachBatch(write_changes(store, measures)).outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)


def recomputed(log: DataFrame) -> DataFrame:
    """Case status from the whole log at once."""
    gone = log.filter("undo").select("decision_id").distinct()
    votes = log.filter("not undo").join(gone, "decision_id", "left_anti").withColumn("undone", F.lit(False))
    return case_status(active_decisions(votes))


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions as a log: a vote each, and a withdrawal of those that were undone."""
    rows = decisions(spark, sf_dir)
    return rows.withColumn("undo", F.explode(F.when(F.col("undone"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))).select(*LOG)


def run_to_end(spark: SparkSession, sf_dir: str, read=live_facts, files: int = 4) -> DataFrame:
    """Stream the log in a shuffled order, two files a batch, and read what is kept live."""
    source, store = scratch_path(spark, "vote-log"), scratch_path(spark, "live-cases")
    rows = decision_log(spark, sf_dir)
    rows.withColumn("luck", F.xxhash64("decision_id", "undo")).repartition(files, "luck").sortWithinPartitions("luck").drop("luck").write.parquet(source)
    log = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    start(log, store, scratch_path(spark, "live-progress")).awaitTermination()
    return read(spark, store)
