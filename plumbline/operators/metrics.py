"""Measures of predictions and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ranges import ranked as in_order


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "pred").agg(F.count("*").alias("n"))


def per_class(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class that occurs."""
    cells = confusion(predictions)
    truth = cells.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    said = cells.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("said"))
    precision, recall = F.coalesce(F.col("tp") / F.col("said"), F.lit(0.0)), F.col("tp") / F.col("support")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return truth.join(said, "class", "left").select("class", "support", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def summary(predictions: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1 and mean negative log likelihood (``p_given``)."""
    k = per_class(predictions).agg(F.round(F.avg("recall"), 5).alias("balanced_accuracy"), F.round(F.avg("f1"), 5).alias("macro_f1"))
    a = predictions.agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("pred")).cast("double")), 6).alias("accuracy"), F.round(F.avg(-F.log(F.greatest("p_given", F.lit(1e-12)))), 6).alias("nll"))
    return a.crossJoin(k)  # one row each


def ece(predictions: DataFrame, bins: int = 15) -> DataFrame:
    """Expected calibration error over bins (lo, hi] of the confidence."""
    b = F.greatest(F.ceil(F.round(F.col("conf") * bins, 9)), F.lit(1))
    per = predictions.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("a"))
    total = per.agg(F.sum("n").alias("t"))
    return per.crossJoin(total).agg(F.round(F.sum(F.col("n") / F.col("t") * F.abs(F.col("a") - F.col("c"))), 6).alias("ece"))


def average_precision(ranked: DataFrame, score: str, truth: str) -> DataFrame:
    """Average precision of ``truth`` by falling ``score`` (ties by id), and precision and recall at 40 and 80."""
    r = ranked_by(ranked, score, truth)
    at = lambda k: F.sum(F.when(F.col("rk") <= k, F.col("t")).otherwise(0))
    n = F.sum("t")
    return r.agg(F.round(F.sum(F.col("t") * F.col("t_sum") / F.col("rk")) / n, 6).alias("ap"), F.round(at(40) / 40, 6).alias("p40"), F.round(at(40) / n, 6).alias("r40"), F.round(at(80) / 80, 6).alias("p80"), F.round(at(80) / n, 6).alias("r80"))


def ranked_by(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """``t`` (0 or 1), its rank ``rk`` by falling score and ``t_sum``, the true ones up to it."""
    return in_order(rows.select("sample_id", score, F.col(truth).cast("int").alias("t")), [F.desc(score), F.col("sample_id")], ("t",))


def review_effort(ranked: DataFrame, score: str, truth: str, levels: tuple[float, ...] = (0.5, 0.8)) -> DataFrame:
    """Reviews in score order until a share of the true ones is found, and how many a random order takes."""
    r = ranked_by(ranked, score, truth).select("rk", F.col("t_sum").alias("hits"))
    total = r.agg(F.max("hits").alias("n"), F.count("*").alias("rows"))
    j = r.crossJoin(total).select("*", F.explode(F.array(*[F.lit(x) for x in levels])).alias("recall"))  # one row
    return j.filter(F.col("hits") >= F.ceil(F.col("recall") * F.col("n"))).groupBy("recall").agg(F.min("rk").cast("bigint").alias("reviews"), F.max(F.round(F.ceil(F.col("recall") * F.col("n")) * (F.col("rows") + 1) / (F.col("n") + 1), 4)).alias("random_reviews"))


def dynamics(trajectory: DataFrame) -> DataFrame:
    """Confidence, variability, correctness, forgetting events, first epoch from which on all are correct, and category.

    ``trajectory`` has ``sample_id``, ``epoch``, ``p`` and ``correct``.
    """
    w = Window.partitionBy("sample_id").orderBy("epoch")
    t = trajectory.withColumn("before", F.lag("correct").over(w))
    wrong = F.max(F.when(~F.col("correct"), F.col("epoch")))
    g = t.groupBy("sample_id").agg(
        F.avg("p").alias("confidence"), F.stddev_pop("p").alias("variability"), F.avg(F.col("correct").cast("double")).alias("correctness"),
        F.count_if(F.col("before") & ~F.col("correct")).alias("forgetting"), wrong.alias("wrong"), F.max("epoch").alias("last"), F.min("epoch").alias("first"),
    )
    learned = F.when(F.col("wrong").isNull(), F.col("first")).when(F.col("wrong") < F.col("last"), F.col("wrong") + 1).otherwise(-1)
    c = F.col
    category = F.when((c("confidence") < 0.3) & (c("correctness") < 0.3), "hard").when(c("forgetting") >= 2, "forgotten").when(c("variability") >= 0.2, "ambiguous").when((c("confidence") >= 0.6) & (c("correctness") >= 0.8), "easy").otherwise("unstable")
    return g.select("sample_id", F.round("confidence", 6).alias("confidence"), F.round("variability", 6).alias("variability"), F.round("correctness", 6).alias("correctness"), "forgetting", learned.alias("first_learned"), category.alias("category"))
