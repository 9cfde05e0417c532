"""Coverage gaps of regions and classes, collection plans, class caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRIORITY = {"boundary_zone": 0.6, "weak_mode": 0.5, "evaluation_blind_spot": 0.55, "train_coverage_gap": 0.8}


def coverage_gaps(regions: DataFrame, weak_share: float = 0.08, max_purity: float = 0.6, blind_min_train: int = 15) -> DataFrame:
    """Gaps of ``regions`` (sample_id, region, label, split): kind, region, class, severity, priority.

    boundary_zone: no class dominates; weak_mode: a class has few of its samples there;
    evaluation_blind_spot: trained on but not evaluated; train_coverage_gap: the reverse.
    """
    of_label = regions.groupBy("region", "label").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("n_train"))
    totals = of_label.groupBy("label").agg(F.sum("n").alias("n_label"))
    size = of_label.groupBy("region").agg(F.sum("n").alias("size"), F.sum("n_train").alias("train"), F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("m"))
    purity = F.col("m.n") / F.col("size")
    gap = lambda df, kind, label, severity: df.select(F.lit(kind).alias("kind"), "region", label.cast("int").alias("label"), F.round(severity, 6).alias("severity"))
    none = F.lit(None)
    parts = [
        gap(size.filter(purity < max_purity), "boundary_zone", -F.col("m.l"), 1 - purity),
        gap(of_label.join(totals, "label").filter(F.col("n") / F.col("n_label") < weak_share), "weak_mode", F.col("label"), 1 - F.col("n") / F.col("n_label") / weak_share),
        gap(size.filter((F.col("train") >= blind_min_train) & (F.col("train") == F.col("size"))), "evaluation_blind_spot", none, F.lit(1.0)),
        gap(size.filter(F.col("train") == 0), "train_coverage_gap", none, F.lit(1.0)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    base = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in PRIORITY.items()])
    score = F.round(base * (0.6 + 0.4 * F.col("severity")), 6)
    return out.withColumn("score", score).withColumn("priority", F.when(score >= 0.65, "high").when(score >= 0.4, "medium").otherwise("low"))


def plan_collection(gaps: DataFrame, limit: int = 40) -> DataFrame:
    """The gaps of most weight as collection tasks with quantities."""
    quantity = F.when(F.col("priority") == "high", 100).when(F.col("priority") == "medium", 50).otherwise(20)
    return gaps.orderBy(F.desc("score"), "kind", "region", "label").limit(limit).select("kind", "region", "label", "priority", quantity.alias("quantity"), F.lit("open").alias("status"))


def class_cap(samples: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` samples of each class, chosen by a seeded hash of the id: a what-if action, not a shortcut."""
    luck = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("sample_id").cast("string")))
    return samples.withColumn("rk", F.row_number().over(Window.partitionBy("label").orderBy(luck, "sample_id"))).filter(F.col("rk") <= most).drop("rk")


def bootstrap_f1(before: DataFrame, after: DataFrame, replicates: int = 50, seed: int = 7) -> DataFrame:
    """Macro F1 of two predictors over paired Poisson resamples of the evaluation rows: mean difference and 95 % interval.

    Both have sample_id, label and pred. A row's weight in a replicate comes from a hash of its id and
    the replicate, so both predictors see the same resample.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("r").cast("string"), F.col("sample_id").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(1, 8):
        total += term
        steps.append(total)
        term /= k
    weight = sum((u >= s).cast("int") for s in steps)
    both = before.select("sample_id", "label", F.col("pred").alias("p0")).join(after.select("sample_id", F.col("pred").alias("p1")), "sample_id")
    cells = both.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", weight).filter("w > 0")
    long = cells.select("r", "label", "w", F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("p0").alias("pred")), F.struct(F.lit(1).alias("v"), F.col("p1").alias("pred")))).alias("x")).groupBy("r", "x.v", "label", "x.pred").agg(F.sum("w").alias("n"))
    truth = long.groupBy("r", "v", F.col("label").alias("c")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    said = long.groupBy("r", "v", F.col("pred").alias("c")).agg(F.sum("n").alias("s"))
    f1 = truth.join(said, ["r", "v", "c"], "left").groupBy("r", "v").agg(F.avg(2 * F.col("tp") / (F.col("t") + F.coalesce("s", F.lit(0)))).alias("f1"))
    delta = f1.groupBy("r").agg(F.sum(F.when(F.col("v") == 1, F.col("f1")).otherwise(-F.col("f1"))).alias("d"))
    return delta.agg(F.round(F.avg("d"), 6).alias("mean"), F.round(F.percentile("d", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("d", F.lit(0.975)), 6).alias("high"), F.count("*").alias("replicates"))


def holdout(samples: DataFrame, touched: DataFrame, leaked: DataFrame) -> DataFrame:
    """Evaluation samples that no action touches and no leak reaches: what a change can be measured on."""
    held = samples.filter("split in ('val', 'test')")
    return held.join(touched.select("sample_id"), "sample_id", "left_anti").join(leaked.select("sample_id"), "sample_id", "left_anti")


def anchors(gaps: DataFrame, members: DataFrame, key: str, most: int = 6) -> DataFrame:
    """For each gap the ``most`` densest members of its ``key``, as examples to collect more of."""
    ranked = gaps.select(key).distinct().join(members, key)
    w = Window.partitionBy(key).orderBy(F.desc("density"), "sample_id")
    return ranked.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= most).select(key, "sample_id", "density", "rk")
