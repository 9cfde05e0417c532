"""Live case status and facts after every batch against a recomputation, with withdrawals and late rows; tables that change."""

import random
import tempfile

import pytest
from compare import spark_rows
from pyspark.sql import functions as F

from plumbline.functions import shared_storage
from plumbline.operators.review import DECISION_FACTS
from plumbline.streaming import live_facts as live

SCHEMA = "decision_id long, case_id long, reviewer long, action string, target int, adjudicate boolean, created_at timestamp_ntz, undo boolean"


def made_log(seed, n, cases):
    """Votes with ties in time, and withdrawals of a fifth of them, all in random order."""
    import datetime as dt

    rnd = random.Random(seed)
    votes = []
    for i in range(n):
        action = rnd.choice(["keep", "relabel", "remove", "unsure", "escalate"])
        at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(n // 3))
        votes.append((i, rnd.randrange(cases), rnd.randrange(3), action, rnd.randrange(2) if action == "relabel" else None, rnd.random() < 0.05, at, False))
    rows = votes + [(*v[:-1], True) for v in rnd.sample(votes, n // 5)]
    rnd.shuffle(rows)
    return rows


def facts_of(status):
    return status.agg(*[F.count_if(F.coalesce(F.expr(e), F.lit(False))).alias(m) for m, e in DECISION_FACTS.items()])


def test_every_batch_equals_a_recomputation(spark):
    source, store, progress = (tempfile.mkdtemp() for _ in range(3))
    rows, stream = made_log(3, 240, 25), None
    for k in range(3):
        spark.createDataFrame(rows[96 * k : 96 * (k + 1)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        live.start(stream, store, progress).awaitTermination()
        status = live.recomputed(spark.read.schema(SCHEMA).parquet(source))
        assert spark_rows(live.live_cases(spark, store)) == spark_rows(status)
        assert spark_rows(live.live_facts(spark, store)) == spark_rows(facts_of(status))
    touched = spark.read.parquet(f"{store}/changes").groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in touched] == [len({r[1] for r in rows[96 * k : 96 * (k + 1)]}) for k in range(3)]


def test_withdrawing_all_votes_retracts_a_case(spark):
    source, store, progress = (tempfile.mkdtemp() for _ in range(3))
    row = (1, 7, 1, "remove", None, False, None, False)
    import datetime as dt

    row = (*row[:6], dt.datetime(2024, 1, 1), False)
    for part in ([row], [(*row[:-1], True)], [row]):  # the vote sent again after its withdrawal stays withdrawn
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        live.start(spark.readStream.schema(SCHEMA).parquet(source), store, progress).awaitTermination()
        removals = live.live_facts(spark, store).first()["removals"]
        assert removals == live.live_cases(spark, store).count() == (0 if part[0][-1] or removals == 0 else 1)
    assert live.live_cases(spark, store).count() == 0


def test_a_batch_run_again_counts_once(spark):
    import datetime as dt

    store = tempfile.mkdtemp()
    batch = spark.createDataFrame([(1, 1, "open", None, 0, None, None), (2, 2, "decided", "keep", 1, "open", None)], live.CHANGES)
    for _ in range(2):
        live.write_changes(store)(batch, 0)
    got = live.live_facts(spark, store).first()
    assert (got["unresolved_cases"], got["decided_cases"]) == (0, 1)


def test_arrivals_are_stored_once_in_every_batch(spark):
    """Copies within a batch and across batches, samples delivered again, null and empty texts, against a plain loop."""
    from plumbline.streaming import ingest

    rnd = random.Random(9)
    rows = [(i, rnd.choice(["a", "b", "c " * 50, "", None, f"only {i}"]), rnd.choice(["train", "test", None])) for i in range(90)]
    rnd.shuffle(rows)
    batches = [rows[:30], rows[30:60] + rows[:10], rows[60:] + rows[20:40] + [(None, "a", "train")]]
    source, store, progress = (tempfile.mkdtemp() for _ in range(3))
    schema, first, want = "sample_id long, text string, split string", {}, {}
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.start(spark.readStream.schema(schema).parquet(source), store, progress).awaitTermination()
        new = sorted((i, t or "") for i, t, _ in batch if i is not None and i not in want)
        for i, t in new:
            first.setdefault(t, i)
            want[i] = None if first[t] == i else first[t]
        got = {r.sample_id: r.copy_of for r in spark.read.parquet(store).collect()}
        assert got == want
        assert spark.read.parquet(f"{store}/batch={k}").count() == len(new)


def test_shared_measures_follow_the_tables(spark, tmp_path):
    """What is written once for many queries is written again when documents or decisions change."""
    from plumbline.plans import review_queries, text_queries

    source = "/root/testdata/sf0.001"
    tables = {t: spark.read.parquet(f"{source}/{t}.parquet") for t in ("documents", "labels", "events")}
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    hashes, facts = text_queries.content_hash(spark, str(tmp_path)).count(), review_queries.facts(spark, str(tmp_path)).first()
    assert hashes == tables["documents"].count() == facts["sample_count"]
    first = shared_storage.written_once(spark, str(tmp_path), "probe", lambda: spark.range(1))
    assert shared_storage.written_once(spark, str(tmp_path), "probe", lambda: spark.range(2)) is first
    tables["documents"].limit(50).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    tables["events"].limit(10).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    changed = review_queries.facts(spark, str(tmp_path)).first()
    assert text_queries.content_hash(spark, str(tmp_path)).count() == 50 == changed["sample_count"]
    assert changed["unresolved_cases"] <= 10 < facts["unresolved_cases"]
    assert shared_storage.written_once(spark, str(tmp_path), "probe", lambda: spark.range(2)).count() == 2
