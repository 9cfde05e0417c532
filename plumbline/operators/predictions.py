"""Out-of-fold predictions by class centroids, and what follows from their residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.similarity import dot, top_products

SHARPNESS = 20.0  # of the softmax over inner products with the centroids


def centroid_models(vectors: DataFrame, members: Column) -> DataFrame:
    """One row per model: ``f`` and ``cents``, the mean of each class over the training vectors whose ``members`` (array of model numbers) name it.

    As many numbers as models, classes and dimensions allow, however many vectors there are.
    """
    fit = vectors.filter("split = 'train'").withColumn("of", members)
    sums = fit.select("of", "label", F.posexplode("embedding").alias("i", "x")).groupBy("of", "label", "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    means = sums.select(F.explode("of").alias("f"), "label", "i", "s", "n").groupBy("f", "label", "i").agg((F.sum("s") / F.sum("n")).alias("c"))
    cents = means.groupBy("f", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))
    return cents.groupBy("f").agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("k"), "c"))).alias("cents"))


def _probabilities(met: DataFrame) -> DataFrame:
    e = F.transform("cents", lambda c: F.struct(c["k"].alias("k"), F.exp(SHARPNESS * dot(F.col("embedding"), c["c"])).alias("e")))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x["e"])
    return met.withColumn("e", e).withColumn("total", total).withColumn("probs", F.transform("e", lambda x: F.struct(x["k"].alias("k"), (x["e"] / F.col("total")).alias("p"))))


def class_probabilities(vectors: DataFrame, folds: int = 5) -> DataFrame:
    """``sample_id``, ``label``, ``split``, ``embedding`` and ``probs``: every class ``k`` with its probability ``p``.

    A sample's own fold (its id modulo ``folds``) has no part in the centroids that judge it.
    """
    others = F.filter(F.array(*[F.lit(f) for f in range(folds)]), lambda f: f != F.col("sample_id") % folds)
    met = vectors.withColumn("f", (F.col("sample_id") % folds).cast("int")).join(F.broadcast(centroid_models(vectors, others)), "f")  # one row per fold
    return _probabilities(met).select("sample_id", "label", "split", "embedding", "probs")


def learning_trajectory(vectors: DataFrame, epochs: int = 8) -> DataFrame:
    """``sample_id``, ``epoch``, ``p`` (of the label) and ``correct`` while a model learns from ever more of the training vectors.

    Epoch e has seen those whose tens number modulo ``epochs`` is at most e.
    """
    first = F.expr(f"cast((sample_id div 10) % {epochs} as int)")
    seen = F.filter(F.array(*[F.lit(e) for e in range(epochs)]), lambda e: e >= first)
    met = vectors.withColumn("f", F.explode(F.array(*[F.lit(e) for e in range(epochs)]))).join(F.broadcast(centroid_models(vectors, seen)), "f")  # one row per epoch
    given = probability_of(F.col("label"))
    best = F.array_min(F.transform("probs", lambda x: F.struct((-F.round(x["p"], 9)).alias("n"), x["k"].alias("k"))))
    return _probabilities(met).select("sample_id", F.col("f").alias("epoch"), (F.round(given, 6) + 1e-9).alias("p"), (best["k"] == F.col("label")).alias("correct"))


def probability_of(label: Column, probs: str = "probs") -> Column:
    return F.aggregate(probs, F.lit(0.0), lambda a, x: a + F.when(x["k"] == label, x["p"]).otherwise(0.0))


def reliability(judged: DataFrame, hit: Column) -> DataFrame:
    """One row: how far above chance a witness is, clip((balanced accuracy - 1 / C) / (1 - 1 / C), 0, 1)."""
    per, c = judged.groupBy("label").agg(F.avg(hit.cast("double")).alias("recall")), F.count("*")
    return per.agg(F.round(F.least(F.greatest((F.avg("recall") - 1 / c) / F.greatest(1 - 1 / c, F.lit(1e-9)), F.lit(0.0)), F.lit(1.0)), 6).alias("reliability"), c.alias("classes"))


def fold_predictions(vectors: DataFrame, folds: int = 5) -> DataFrame:
    """``pred``, ``conf`` (its probability), ``p_given`` (that of the label) and ``gap`` to the second class, rounded to six digits; ties to the smaller class."""
    p = class_probabilities(vectors, folds)
    ranked = F.array_sort(F.transform("probs", lambda x: F.struct((-F.round(x["p"], 9)).alias("n"), x["k"].alias("k"), x["p"].alias("p"))))
    r = p.withColumn("r", ranked)
    second = F.coalesce(F.get("r", 1)["p"], F.lit(0.0))
    return r.select("sample_id", "label", "split", F.col("r")[0]["k"].alias("pred"), F.round(F.col("r")[0]["p"], 6).alias("conf"), F.round(probability_of(F.col("label")), 6).alias("p_given"), F.round(F.col("r")[0]["p"] - second, 6).alias("gap"))


def confident_failures(predictions: DataFrame, most: int = 2000) -> DataFrame:
    """Evaluation samples that are predicted wrongly, the most confident first; ``most`` bounds the report."""
    failed = predictions.filter("split in ('val', 'test') and pred <> label")
    return failed.orderBy(F.desc("conf"), "sample_id").limit(most)


def counterfactual_basis(probabilities: DataFrame) -> DataFrame:
    """One row per class ``k``: the sum over evaluation samples of their residual in that class times (vector, 1), as ``m``.

    A training sample's effect on the loss of all evaluation samples is an inner product with this
    matrix (classes by dimensions + 1), so that training and evaluation samples never meet in pairs.
    """
    ev = probabilities.filter("split in ('val', 'test')").select(F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(F.lit(1.0))).alias("x"), F.explode("probs").alias("q"), "label")
    terms = ev.select(F.col("q.k").alias("k"), (F.col("q.p") - (F.col("q.k") == F.col("label")).cast("double")).alias("r"), F.posexplode("x").alias("i", "x"))
    sums = terms.groupBy("k", "i").agg(F.sum(F.col("r") * F.col("x")).alias("m"))
    return sums.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))


def counterfactuals(probabilities: DataFrame) -> DataFrame:
    """For each training sample the estimated change of the mean evaluation loss by its removal and by every other label.

    First order: removal gives back r . G, where r is the sample's residual and G its products with
    the basis; another label changes r by one class. ``options`` holds all of them, ``best`` is the
    one with the least change (``keep`` is 0; ties in the order keep, remove, classes).
    """
    basis = counterfactual_basis(probabilities).agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("basis"), F.first(F.size("m") - 1).alias("dims"))
    n_eval = probabilities.filter("split in ('val', 'test')").agg(F.greatest(F.count("*"), F.lit(1)).alias("n_eval"))
    x = F.concat(F.transform("embedding", lambda v: v.cast("double")), F.array(F.lit(1.0)))
    fit = probabilities.filter("split = 'train'").crossJoin(F.broadcast(basis)).crossJoin(F.broadcast(n_eval))  # one row each
    g = fit.withColumn("x", x).withColumn("g", F.transform("basis", lambda b: F.struct(b["k"].alias("k"), (dot(F.col("x"), b["m"]) / F.col("dims") / F.col("n_eval")).alias("g"))))
    g_of = lambda k: F.aggregate("g", F.lit(0.0), lambda a, y: a + F.when(y["k"] == k, y["g"]).otherwise(0.0))
    pg = F.aggregate(F.zip_with("probs", "g", lambda p, y: p["p"] * y["g"]), F.lit(0.0), lambda a, y: a + y)
    base = g.withColumns({"given": g_of(F.col("label")), "pg": pg})
    remove = F.struct(F.lit(1).alias("o"), F.lit("remove").alias("action"), F.lit(None).cast("int").alias("target"), F.round(F.col("pg") - F.col("given"), 6).alias("delta"))
    keep = F.struct(F.lit(0).alias("o"), F.lit("keep").alias("action"), F.lit(None).cast("int").alias("target"), F.lit(0.0).alias("delta"))
    relabel = F.transform(F.filter("g", lambda y: y["k"] != F.col("label")), lambda y: F.struct(F.lit(2).alias("o"), F.lit("relabel").alias("action"), y["k"].cast("int").alias("target"), F.round(y["g"] - F.col("given"), 6).alias("delta")))
    options = base.withColumn("options", F.concat(F.array(keep, remove), relabel))
    best = F.array_min(F.transform("options", lambda o: F.struct(o["delta"].alias("delta"), o["o"].alias("o"), F.coalesce(o["target"], F.lit(-1)).alias("target"), o["action"].alias("action"))))
    return options.withColumn("best", best).select("sample_id", "label", F.round(F.col("pg") - F.col("given"), 6).alias("influence"), "options", F.col("best.action").alias("best_action"), F.when(F.col("best.target") >= 0, F.col("best.target")).alias("best_target"), F.col("best.delta").alias("best_delta"))


def pair_influence(probabilities: DataFrame, failures: DataFrame, k: int = 3) -> DataFrame:
    """For each failure (``sample_id``) the ``k`` training samples that harm it most: the least (r . r') (x . x' + 1) / dims.

    Every failure meets every training sample, in blocks that hold residuals and vectors side by side.
    """
    residual = F.transform("probs", lambda x: x["p"] - (x["k"] == F.col("label")).cast("double"))
    rows = probabilities.filter("embedding is not null").select("sample_id", "split", F.size("probs").alias("classes"), F.size("embedding").alias("dims"), F.concat(residual, F.transform("embedding", lambda v: v.cast("double"))).alias("embedding"))
    one = rows.select("classes", "dims").first()  # the same for all
    classes, dims = (one["classes"], one["dims"]) if one else (1, 1)
    asked = rows.join(failures.select("sample_id"), "sample_id", "left_semi")
    found = top_products(asked, rows.filter("split = 'train'"), k, classes, 1.0, -1.0 / dims, decimals=6)
    return found.select("sample_id", F.col("neighbor_id").alias("train_id"), (F.lit(0.0) - F.col("sim")).alias("influence"), "rk")


def masked_accuracy(vectors: DataFrame, blocks: int = 4, folds: int = 5) -> DataFrame:
    """Accuracy on evaluation vectors whole (block -1) and with each block of dimensions set to zero: what the model leans on."""
    others = F.filter(F.array(*[F.lit(f) for f in range(folds)]), lambda f: f != F.col("sample_id") % folds)
    ev = vectors.filter("split in ('val', 'test')").withColumn("f", (F.col("sample_id") % folds).cast("int")).withColumn("block", F.explode(F.array(*[F.lit(b) for b in range(-1, blocks)])))
    width = F.ceil(F.size("embedding") / blocks)
    masked = ev.withColumn("embedding", F.transform("embedding", lambda x, i: F.when(F.floor(i / width) == F.col("block"), 0.0).otherwise(x.cast("double"))))
    p = _probabilities(masked.join(F.broadcast(centroid_models(vectors, others)), "f"))  # one row per fold
    best = F.array_min(F.transform("probs", lambda x: F.struct((-F.round(x["p"], 9)).alias("n"), x["k"].alias("k"))))["k"]
    return p.groupBy("block").agg(F.count("*").alias("n"), F.round(F.avg((best == F.col("label")).cast("double")), 6).alias("accuracy"))


def failure_replay(vectors: DataFrame, removed: DataFrame, folds: int = 5) -> DataFrame:
    """Evaluation samples that were predicted wrongly, and what becomes of them once ``removed`` is not learned from: ``before``, ``after``, ``fixed``."""
    before = fold_predictions(vectors, folds).filter("split in ('val', 'test') and pred <> label").select("sample_id", "label", F.col("pred").alias("before"))
    after = fold_predictions(vectors.filter("split = 'train'").join(removed.select("sample_id"), "sample_id", "left_anti").unionByName(vectors.filter("split <> 'train'")), folds).select("sample_id", F.col("pred").alias("after"))
    return before.join(after, "sample_id").withColumn("fixed", F.col("after") == F.col("label"))
