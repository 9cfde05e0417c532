"""Further columns of documents come through every stage with their values, whatever their names; near copies at any similarity."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import external_shuffle, near_dedup, source_mixing, toxicity

NAMES = "tokens kept probability Topic l_source c_source c_topic __source __tokens __kept __bits __page __key luck tie part rank ahead hash row_key cluster component node n signature prediction score h fp".split()


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(400)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(3, 60))) for _ in range(120)]
    rows = [(i, texts[i % 120], rnd.choice(["en", "de", None]), rnd.choice(["s", "t"])) for i in range(160)] + [(7, None, None, None), (7, None, None, None)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return base.withColumns({c: F.concat(F.lit(f"mine {c} "), F.coalesce(F.col("doc_id") % 3, F.lit(9)).cast("string")) for c in NAMES}).cache()


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def untouched(out, docs):
    assert out.columns == docs.columns
    all_rows = rows_of(docs)
    kept = rows_of(out)
    assert kept and set(kept) <= set(all_rows)
    return kept


def test_stages_return_rows_untouched(spark, docs):
    labels = spark.createDataFrame([(i, 1, i % 5 == 0) for i in range(60)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    untouched(toxicity.without_toxic(docs, model), docs)
    kept = untouched(near_dedup.without_near_duplicates(docs), docs)
    assert len(kept) == 121  # 120 texts and the null one
    untouched(source_mixing.mixed_documents(docs, keep=0.7), docs)
    untouched(source_mixing.mixed_documents(docs, keep=0.7, max_levels=0), docs)
    assert rows_of(source_mixing.mixed_documents(docs, keep=1.0, power=1.0)) == rows_of(docs)


def test_mix_uses_a_topic_column_of_any_case(docs):
    mixed = source_mixing.mix(docs)
    assert {r.topic for r in mixed.select("topic").distinct().collect()} == {"mine Topic 0", "mine Topic 1", "mine Topic 2"}
    assert [c for c in mixed.columns if c.lower() in ("topic", "tokens", "probability", "kept")] == ["topic", "tokens", "probability", "kept"]
    assert mixed.filter("l_source not like 'mine l_source%'").isEmpty()


def test_shards_keep_all_columns(docs):
    written = external_shuffle.shuffle_to_shards(docs, shards=3)
    assert written.columns == [*docs.columns, "shard", "slot"]
    assert rows_of(written.select(docs.columns)) == rows_of(docs)


@pytest.mark.parametrize("similarity", [0.5, 0.6, 0.8])
def test_near_copies_at_any_similarity(spark, similarity):
    """Pairs exactly at the limit, just below it and equal ones, against all pairs of shingle sets."""
    rnd = random.Random(int(similarity * 10))
    texts = []
    for k in range(150):
        n = 20 * rnd.randint(2, 12)  # shingles that a text and its copy have in all
        both = round(similarity * n)
        one, rest = [f"w{rnd.randrange(10**9)}" for _ in range(n + 4)], [f"v{rnd.randrange(10**9)}" for _ in range(n)]
        short = rnd.choice([0, 0, 1])  # one shingle short of the limit
        own = (n - both) // 2
        # The first ``both`` shingles are shared; then each text goes on alone.
        shared = one[: both - short + 4]
        texts += [" ".join(shared + one[both + 4 : both + 4 + own + short]), " ".join(shared + rest[: n - both - own])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    gone = {i + 1 for i in range(0, len(texts), 2) if len(sets[i] & sets[i + 1]) >= similarity * len(sets[i] | sets[i + 1]) - 1e-9}
    assert 30 < len(gone) < 150
    kept = {r.doc_id for r in near_dedup.without_near_duplicates(df, similarity=similarity).select("doc_id").collect()}
    assert kept == set(range(len(texts))) - gone


def test_bound_of_fingerprints_follows_the_similarity():
    assert [near_dedup.possible_bits(t) for t in (1.0, 0.8, 0.5, 0.0)] == [0, 76, 114, 180]
