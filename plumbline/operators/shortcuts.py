"""Association of cues with labels, coverage gaps, and distribution profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cramers_v(cues: DataFrame) -> DataFrame:
    """Bias-corrected Cramér's V of every cue (``cue``, ``value``) with ``label``.

    From the cells' counts and the two margins; empty cells count through the margins' products
    (chi square over all cells is n * (sum of n_xy^2 / (n_x n_y) - 1)), so none is made.
    """
    cells = cues.groupBy("cue", "value", "label").agg(F.count("*").alias("n_xy"))
    rows = cells.groupBy("cue", "value").agg(F.sum("n_xy").alias("n_x"))
    columns = cells.groupBy("cue", "label").agg(F.sum("n_xy").alias("n_y"))
    square = cells.join(rows, ["cue", "value"]).join(columns, ["cue", "label"])
    s = square.groupBy("cue").agg(F.sum(F.col("n_xy") * F.col("n_xy") / (F.col("n_x") * F.col("n_y"))).alias("s"), F.sum("n_xy").alias("n"), F.countDistinct("value").alias("r"), F.countDistinct("label").alias("k"))
    less = F.greatest(F.lit(1), F.col("n") - 1)
    phi2 = F.greatest(F.lit(0.0), F.col("s") - 1 - (F.col("k") - 1) * (F.col("r") - 1) / less)
    corrected = lambda c: F.col(c) - (F.col(c) - 1) * (F.col(c) - 1) / less
    room = F.least(corrected("k"), corrected("r")) - 1
    v = F.when((F.col("r") < 2) | (F.col("k") < 2) | (room <= 0), 0.0).otherwise(F.sqrt(phi2 / room))
    return s.select("cue", "n", F.round(v, 6).alias("v"))


def shortcut_findings(cues: DataFrame, min_strength: float = 0.3, min_support: int = 8, min_lift: float = 1.8, min_share: float = 0.5, top: int = 3) -> DataFrame:
    """For cues that predict the label on train: their strongest (value, label) cells by lift times share of the class."""
    fit, ev = cues.filter("split = 'train'"), cues.filter("split in ('val', 'test')")
    v = cramers_v(fit).withColumnRenamed("v", "strength").filter(F.col("strength") >= min_strength)
    v_eval = cramers_v(ev).select("cue", F.when(F.col("n") >= 20, F.round("v", 4)).alias("strength_eval"))
    cells = fit.groupBy("cue", "value", "label").agg(F.count("*").alias("support"))
    of_value = cells.groupBy("cue", "value").agg(F.sum("support").alias("n_value"))
    of_label = cells.groupBy("cue", "label").agg(F.sum("support").alias("n_label"))
    p = F.col("support") / F.col("n_value")
    joined = cells.join(v, "cue").join(of_value, ["cue", "value"]).join(of_label, ["cue", "label"]).withColumns({"p": p, "lift": p / (F.col("n_label") / F.col("n")), "share": F.col("support") / F.col("n_label")})
    best = Window.partitionBy("cue").orderBy(F.round(F.col("lift") * F.col("share"), 9).desc(), "value", "label")
    kept = joined.filter((F.col("support") >= min_support) & (F.col("lift") >= min_lift) & (F.col("share") >= min_share)).withColumn("rk", F.row_number().over(best)).filter(F.col("rk") <= top)
    label = F.when(F.col("strength") >= 0.5, "strong").when(F.col("strength") >= 0.3, "moderate").otherwise("weak")
    return kept.join(v_eval, "cue", "left").select("cue", "value", "label", "support", F.round("lift", 4).alias("lift"), F.round("share", 4).alias("share"), F.round("p", 4).alias("p_class"), F.round("strength", 4).alias("strength"), "strength_eval", label.alias("strength_label"))


def condition_gaps(conditions: DataFrame, other_min: float = 0.12, class_max: float = 0.03) -> DataFrame:
    """Conditions that a class hardly has in training although the other classes do."""
    names = [c for c, t in conditions.dtypes if t == "boolean"]
    long = conditions.filter("split = 'train'").select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c).cast("int").alias("x")) for c in names])).alias("p")).select("label", "p.*")
    g = long.groupBy("label", "condition").agg(F.count("*").alias("n"), F.sum("x").alias("k"))
    t = g.groupBy("condition").agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))
    share, other = F.col("k") / F.col("n"), (F.col("tk") - F.col("k")) / (F.col("tn") - F.col("n"))
    return g.join(t, "condition").filter((F.col("tn") > F.col("n")) & (other >= other_min) & (share <= class_max)).select("label", "condition", "n", F.round(share, 6).alias("share"), F.round(other, 6).alias("other_share"))


def underrepresented(samples: DataFrame, min_per_class: int = 30, relative: float = 0.5) -> DataFrame:
    """Classes with fewer training samples than a minimum or half the median class, and how many are wanted."""
    c = samples.filter("split = 'train'").groupBy("label").agg(F.count("*").alias("n"))
    floor = F.greatest(F.lit(float(min_per_class)), F.lit(relative) * F.col("median_n"))
    j = c.crossJoin(c.agg(F.percentile("n", F.lit(0.5)).alias("median_n")))  # one row
    return j.filter(F.col("n") < floor).select("label", "n", F.round("median_n", 4).alias("median_n"), F.bround(F.greatest(floor - F.col("n"), F.lit(0.0)), 0).cast("bigint").alias("wanted"), F.when(F.col("n") < min_per_class, "high").otherwise("medium").alias("priority"))


def dna_profile(attributes: DataFrame) -> DataFrame:
    """Shares of classes, splits, sources, sizes and word lengths as rows ``dimension``, ``bucket``, ``share``."""
    size = F.when(F.col("chars") < 500, "short").when(F.col("chars") < 2000, "medium").otherwise("long")
    length = F.least(F.floor("word_length").cast("int"), F.lit(19)).cast("string")
    dims = F.array(*[F.struct(F.lit(n).alias("dimension"), v.alias("bucket")) for n, v in (("class", F.col("label")), ("split", F.col("split")), ("source", F.col("source")), ("size", size), ("word_length", length))])
    counts = attributes.select(F.explode(dims).alias("x")).groupBy("x.dimension", "x.bucket").agg(F.count("*").alias("n"))
    totals = counts.groupBy("dimension").agg(F.sum("n").alias("t"))
    return counts.join(totals, "dimension").select("dimension", "bucket", (F.col("n") / F.col("t")).alias("share"))


def dna_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence in bits between two profiles, by dimension: none, moderate from 0.05, strong from 0.15."""
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    j = a.withColumnRenamed("share", "p").join(b.withColumnRenamed("share", "q"), ["dimension", "bucket"], "full_outer").select("dimension", p.alias("p"), q.alias("q"))
    half = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / ((F.col("p") + F.col("q")) / 2))).otherwise(0.0)
    js = j.groupBy("dimension").agg(F.sum(0.5 * half("p") + 0.5 * half("q")).alias("js"))
    return js.select("dimension", F.round("js", 6).alias("js"), F.when(F.col("js") >= 0.15, "strong").when(F.col("js") >= 0.05, "moderate").otherwise("none").alias("drift"))


def cue_predictability(cues: DataFrame, folds: int = 5) -> DataFrame:
    """How well the cues alone tell the label: balanced accuracy out of fold, against chance.

    A naive Bayes classifier with add-one smoothing; a sample's fold is its id modulo ``folds``, and
    the counts of its own fold have no part in its prediction.
    """
    rows = cues.select("sample_id", "label", "cue", "value", (F.col("sample_id") % folds).alias("fold"))
    people = rows.select("sample_id", "label", "fold").distinct()
    per = people.groupBy("fold", "label").agg(F.count("*").alias("n"))
    total = per.groupBy("label").agg(F.sum("n").alias("n_all"))
    every = total.crossJoin(rows.select("fold").distinct())  # classes times folds
    prior = every.join(per, ["fold", "label"], "left").select("fold", "label", (F.col("n_all") - F.coalesce("n", F.lit(0))).alias("n_out"))
    cell = rows.groupBy("fold", "cue", "value", "label").agg(F.count("*").alias("n"))
    kinds = rows.groupBy("cue").agg(F.count_distinct("value").alias("kinds"))
    cells = cell.groupBy("cue", "value", "label").agg(F.sum("n").alias("n_all"))
    grid = rows.select("cue", "value").distinct().crossJoin(prior)  # values times classes times folds
    likely = (
        grid.join(cells, ["cue", "value", "label"], "left")
        .join(cell, ["fold", "cue", "value", "label"], "left")
        .join(kinds, "cue")
        .select("fold", "cue", "value", F.col("label").alias("guess"), "n_out", F.log((F.coalesce("n_all", F.lit(0)) - F.coalesce("n", F.lit(0)) + 1) / (F.col("n_out") + F.col("kinds"))).alias("l"))
    )
    scores = rows.join(likely, ["fold", "cue", "value"]).groupBy("sample_id", "label", "guess", "n_out").agg(F.sum("l").alias("l")).withColumn("s", F.round(F.col("l") + F.log(F.col("n_out") + 1), 9))
    best = scores.groupBy("sample_id", "label").agg(F.min(F.struct((-F.col("s")).alias("s"), "guess")).alias("b"))
    recall = best.groupBy("label").agg(F.avg((F.col("b.guess") == F.col("label")).cast("double")).alias("r"), F.count("*").alias("n"))
    return recall.agg(F.round(F.avg("r"), 6).alias("balanced_accuracy"), F.round(1 / F.count("*"), 6).alias("chance"), F.sum("n").alias("n"))


def dna_strip(profile: DataFrame, bands: int = 24) -> DataFrame:
    """The first ``bands`` shares of a profile by dimension and bucket, scaled by the largest of them: ``band``, ``height``."""
    first = profile.orderBy("dimension", "bucket").limit(bands)
    w = Window.orderBy("dimension", "bucket")  # over ``bands`` rows
    return first.withColumns({"band": F.row_number().over(w), "top": F.max("share").over(Window.partitionBy())}).select("band", "dimension", "bucket", F.round(F.col("share") / F.greatest("top", F.lit(1e-12)), 4).alias("height"))


def centroid_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per class of two versions of vectors: ten times one minus the cosine of its means, with none, moderate or strong; null where one version lacks the class."""
    mean = lambda v, c: v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias(c))
    both = mean(a, "p").join(mean(b, "q"), ["label", "i"], "full_outer")
    cosine = F.sum(F.col("p") * F.col("q")) / F.sqrt(F.sum(F.col("p") * F.col("p")) * F.sum(F.col("q") * F.col("q")))
    drift = both.groupBy("label").agg(F.round(10 * (1 - cosine), 6).alias("shift"))
    return drift.withColumn("drift", F.when(F.col("shift") >= 0.15, "strong").when(F.col("shift") >= 0.05, "moderate").when(F.col("shift").isNotNull(), "none"))
