"""Four stages from raw documents to token counts; each takes all that the stage before it kept.

Every stage takes null, empty and very long texts, null and repeated ids, repeated rows and further
columns; what it makes of them is said where its operator is defined. Of rows with equal words one
stays, so repeated rows and all but one of the texts without words end with the second stage. An
empty table passes through as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.shared_storage import materialize
from plumbline.llm import bpe_automaton, near_dedup, source_mixing, toxicity
from plumbline.llm.registry import default_tokenizer
from plumbline.sources.tables import table


def _bounded_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of fewer rows than Spark's default, which bounds what an executor holds; a size that the session sets is left alone."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, "1000")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2, learned from the labelled documents of the corpus; rejected documents go."""
    _bounded_batches(spark)
    model = toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 on five-word shingles at a similarity of 0.8; one document of each group stays."""
    _bounded_batches(spark)
    return near_dedup.without_near_duplicates(docs, width=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3; documents are sampled by the calibrated probabilities."""
    return source_mixing.mixed_documents(docs, power=0.8, keep=0.7, sweeps=20, seed=42)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10; one row of token counts and digests per document."""
    _bounded_batches(spark)
    return bpe_automaton.encode_decode(docs, default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs, setting = table(spark, sf_dir, "documents"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    finally:
        spark.conf.set(setting, before)
    return docs


#: Learned patterns, group search and BPE have no SQL form.
ORACLE_SQL = None
