"""Steps that the queries on vectors share: their work grows no faster than the vectors do."""

from pyspark.sql import functions as F

from plumbline.operators import blocks, similarity
from plumbline.plans import extra_queries, vector_queries


def test_codes_and_verdicts_are_written_before_they_are_read(spark, sf_dir):
    """A filter on an exploded column repeats all the terms behind it, so they have to be columns of a table by then."""
    for query in (vector_queries.witnesses, vector_queries.reason_codes, vector_queries.case_numbers):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "nearest_other" not in plan.split("Relation")[0], query.__name__
    one, two = (vector_queries._verdicts(spark, sf_dir) for _ in range(2))
    assert one.inputFiles() and one.inputFiles() == two.inputFiles()


def test_copies_are_told_from_neighbours_without_meeting_in_pairs(spark):
    """100,000 copies of one vector: 5 * 10**9 pairs of them, of which neighbours are few."""
    n = 100_000
    copies = spark.range(n).select(F.col("id").alias("sample_id"), F.lit(0).cast("bigint").alias("root")).unionByName(spark.createDataFrame([(n, n), (n + 1, n)], "sample_id long, root long"))
    knn = spark.createDataFrame([(7, 0), (7, n), (n, n + 1), (n + 1, 3), (n + 5, n), (n - 1, 8)], "sample_id long, neighbor_id long")
    found = sorted(map(tuple, similarity.neighboring_copies(knn, copies).collect()))
    assert found == [(7, 0), (n - 1, 8), (n, n + 1)]


def test_vectors_of_one_file_are_dealt_to_all_cores(spark, sf_dir):
    assert len(vector_queries._planted(spark, sf_dir).inputFiles()) >= spark.sparkContext.defaultParallelism


def test_no_vector_is_sent_more_than_a_few_times():
    """The left ones come back with their neighbours, about half their own size: so many times its size a vector moves in all."""
    sent = lambda n: (lambda s: s[0] + s[1] * 1.55)(blocks.grid(n, n, 65536, 0.55))
    assert max(map(sent, (2_000, 10_000, 50_000, 100_000, 300_000, 600_000))) <= 26
    assert sent(600_000) <= 1.3 * sent(10_000)


def test_copies_by_their_vectors(spark):
    """Conflicts and leaks among copies; zeros of either sign are equal, and vectors that are missing are no copies."""
    rows = [(1, [0.0, 1.0], 3, "train"), (2, [-0.0, 1.0], 3, "test"), (3, [1.0, 1.0], 1, "train"), (4, [1.0, 1.0], 2, "train"), (5, [2.0, 1.0], 1, "train"), (6, None, 1, "train"), (7, None, 1, "test"), (8, [1.0, 1.0], None, "train"), (9, [5.0], None, "val"), (10, [5.0], None, "val")]
    v = spark.createDataFrame(rows, "sample_id long, embedding array<float>, label int, split string")
    found = sorted(map(tuple, vector_queries._copies(v).collect()))
    assert found == [(1, 1, False, True), (2, 1, False, True), (3, 3, True, False), (4, 3, True, False), (8, 3, True, False), (9, 9, False, False), (10, 9, False, False)]


def test_vectors_without_copies_are_not_moved(spark, sf_dir, monkeypatch):
    """What the evidence sends of a vector that occurs once is its hash."""
    written = []
    monkeypatch.setattr(vector_queries, "materialize", lambda df, label, own=vector_queries.materialize: written.append((label, own(df, label))) or written[-1][1])
    vector_queries._signals(spark, sf_dir, vector_queries._vectors(spark, sf_dir))
    kept = dict(written)
    assert {"alike", "copies"} <= set(kept)
    v = vector_queries._vectors(spark, sf_dir)
    assert kept["alike"].count() == v.groupBy("embedding").count().filter("count > 1").join(v, "embedding").count()


def test_similar_pairs_are_joined_once(spark, sf_dir):
    """The range of similarities reads the pairs that were connected, and doesn't join the neighbours again."""
    plan = extra_queries.similar_subject_clusters(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "neighbor_id" not in plan
