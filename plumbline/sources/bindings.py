"""Given tables seen as samples: an id, a label, a split and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.tables import table


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least half as many partitions as there are cores; unchanged where the files give enough.

    A small table in one file is one task otherwise, however much work follows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 >= cores else df.repartition(cores)


def split_of(sample_id: Column) -> Column:
    """70 % train, 10 % val, 20 % test by the id's last digit."""
    return F.when(sample_id % 10 < 7, "train").when(sample_id % 10 < 8, "val").otherwise("test")


def text_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as samples; the label is the language."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    return d.select(F.col("doc_id").alias("sample_id"), "text", F.col("lang").alias("label"), "source", "n_chars", split_of(F.col("doc_id")).alias("split"))


def vector_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as samples."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), "embedding", "label", split_of(F.col("vec_id")).alias("split"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as review decisions: 4,000 cases, five reviewers."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    action = F.when(kind == "view", "keep").when(kind == "click", "relabel").when(kind == "purchase", "remove").when(kind == "signup", "unsure").otherwise("escalate")
    return e.select(
        F.col("event_id").alias("decision_id"),
        (F.col("event_id") % 4000).alias("case_id"),
        (F.col("user_id") % 5).alias("reviewer"),
        action.alias("action"),
        F.when(kind == "click", F.floor("value").cast("int") % 3).alias("target"),
        F.col("ts").alias("created_at"),
        (F.col("event_id") % 17 == 0).alias("undone"),
        (F.col("event_id") % 101 == 0).alias("adjudicate"),
    )


#: The same bindings as SQL common table expressions.
_SPLIT = "case when {0} % 10 < 7 then 'train' when {0} % 10 < 8 then 'val' else 'test' end as split"
SQL_TEXT = f"samples as (select doc_id as sample_id, text, lang as label, source, n_chars, {_SPLIT.format('doc_id')} from documents)"
SQL_VECTORS = f"vectors as (select vec_id as sample_id, list_transform(embedding, lambda x: cast(x as double)) as embedding, label, {_SPLIT.format('vec_id')} from embeddings)"
SQL_PROBABILITIES = """folds as (select unnest(range(0, 5)) as f),
fold_cents as (select f, label as k, list(c order by i) as c from (select f, label, i, avg(embedding[i]) as c from folds join vectors on split = 'train' and sample_id % 5 <> f, range(1, 65) t(i) group by all) group by all),
fold_e as (select sample_id, label, split, embedding, k, exp(20 * list_inner_product(embedding, c)) as e from vectors join fold_cents on f = sample_id % 5),
probabilities as (select *, e / sum(e) over (partition by sample_id) as p from fold_e)"""
SQL_PREDICTIONS = SQL_VECTORS + ", " + SQL_PROBABILITIES + """, fold_ranks as (select *, row_number() over (partition by sample_id order by round(p, 9) desc, k) as r from probabilities),
predictions as (select sample_id, label, split, max(k) filter (r = 1) as pred, round(max(p) filter (r = 1), 6) as conf, round(coalesce(max(p) filter (k = label), 0), 6) as p_given, round(max(p) filter (r = 1) - coalesce(max(p) filter (r = 2), 0), 6) as gap from fold_ranks group by sample_id, label, split)"""
SQL_REGIONS = """seeds as (select sample_id as seed, embedding as spot, row_number() over (order by sample_id) - 1 as region from vectors order by sample_id limit 8),
near_seed as (select sample_id, region, row_number() over (partition by sample_id order by round(list_inner_product(embedding, spot), 9) desc, region) as r from vectors cross join seeds),
regions as (select sample_id, region from near_seed where r = 1)"""
SQL_DECISIONS = """decisions as (select event_id as decision_id, event_id % 4000 as case_id, user_id % 5 as reviewer,
  case event_type when 'view' then 'keep' when 'click' then 'relabel' when 'purchase' then 'remove' when 'signup' then 'unsure' else 'escalate' end as action,
  case when event_type = 'click' then cast(floor(value) as integer) % 3 end as target, ts as created_at, event_id % 17 = 0 as undone, event_id % 101 = 0 as adjudicate from events)"""
