"""Models on vectors: baseline classifier, regions, map, influence, before/after experiments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize


def with_features(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))


def class_weights(rows: DataFrame) -> DataFrame:
    """``rows`` with ``w``: all / (classes * rows of the class)."""
    c = rows.groupBy("label").agg(F.count("*").alias("n_label"))
    total = c.agg(F.sum("n_label").alias("n"), F.count("*").alias("k"))
    return rows.join(c, "label").crossJoin(total).withColumn("w", F.col("n") / (F.col("k") * F.col("n_label"))).drop("n", "k", "n_label")


def fit_baseline(rows: DataFrame, c: float = 0.001, max_iter: int = 50):
    """Class-balanced multinomial logistic regression on standardised features."""
    n = max(1, rows.count())
    balanced = class_weights(rows).withColumn("label", F.col("label").cast("double"))
    return LogisticRegression(family="multinomial", weightCol="w", standardization=True, regParam=1 / (c * n), maxIter=max_iter).fit(balanced)


def out_of_fold(vectors: DataFrame, k: int = 3, seed: int = 1234) -> DataFrame:
    """``sample_id``, ``label``, ``pred`` and ``probabilities`` from models that did not see the row; folds by a hash of the id, so that classes are even among them on average and no class is sorted."""
    fold = F.pmod(F.xxhash64("sample_id", F.lit(seed)), F.lit(k))
    rows = with_features(materialize(vectors.withColumn("fold", fold), "folds"))
    parts = []
    for f in range(k):
        model = fit_baseline(rows.filter(F.col("fold") != f))
        parts.append(model.transform(rows.filter(F.col("fold") == f).withColumn("label", F.col("label").cast("double"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("sample_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"), vector_to_array("probability").alias("probabilities"))


def kmeans_regions(vectors: DataFrame, seed: int = 7) -> DataFrame:
    """``region`` of each vector; the number of regions is round(sqrt(n / 3)) between 2 and 48, and 1 under 8 rows."""
    n = vectors.count()
    if n < 8:
        return vectors.withColumn("region", F.lit(0))
    k = int(min(48, max(2, np.round(np.sqrt(n / 3)))))
    rows = with_features(vectors)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="region").fit(rows).transform(rows).drop("features")


def pca_map(vectors: DataFrame) -> DataFrame:
    """Two principal components, scaled to -1..1."""
    rows = with_features(vectors)
    xy = PCA(k=2, inputCol="features", outputCol="pc").fit(rows).transform(rows).select("sample_id", vector_to_array("pc").alias("pc")).select("sample_id", F.col("pc")[0].alias("x"), F.col("pc")[1].alias("y"))
    top = xy.agg(F.max(F.abs("x")).alias("mx"), F.max(F.abs("y")).alias("my"))
    return xy.crossJoin(top).select("sample_id", (F.col("x") / F.greatest("mx", F.lit(1e-12))).alias("x"), (F.col("y") / F.greatest("my", F.lit(1e-12))).alias("y"))


def region_summary(assigned: DataFrame, min_fraction: float = 0.01) -> DataFrame:
    """Size, training rows, dominant class, purity and density of every ``region``; sparse: density in the lowest fifth, or very small."""
    of_label = assigned.groupBy("region", "label").agg(F.count("*").alias("n"))
    dominant = of_label.groupBy("region").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("m"))
    g = assigned.groupBy("region").agg(F.count("*").alias("size"), F.avg("density").alias("density"), F.count_if(F.col("split") == "train").alias("n_train"))
    q = g.agg(F.percentile("density", F.lit(0.2)).alias("q20"), F.sum("size").alias("total"))
    sparse = (F.col("density") <= F.col("q20")) | (F.col("size") < F.greatest(F.lit(3.0), min_fraction * F.col("total")))
    return g.join(dominant, "region").crossJoin(q).select("region", "size", "n_train", (-F.col("m.l")).alias("dominant"), F.round(F.col("m.n") / F.col("size"), 6).alias("purity"), F.round("density", 6).alias("density"), sparse.alias("sparse"))


def train_epochs(vectors: DataFrame, epochs: int = 6, lr: float = 0.5) -> list[np.ndarray]:
    """Weights (classes x (dimensions + 1)) after each epoch of full-batch gradient descent.

    A partition sums its rows' gradients in Arrow batches and Spark adds the sums, so an epoch
    moves one small matrix per partition.
    """
    rows = materialize(vectors.select("embedding", "label"), "epoch-rows")
    n = rows.count()
    classes = rows.agg(F.max("label")).first()[0] + 1 if n else 0
    dims = len(rows.first()["embedding"]) if n else 0
    w, out = np.zeros((classes, dims + 1)), []
    for _ in range(epochs if n else 0):
        weights = w.copy()

        def gradient(batches):
            g = np.zeros_like(weights)  # noqa: B023
            for b in batches:
                x, y = _design(b.column(0)), b.column(1).to_numpy()
                r = _softmax(x @ weights.T)  # noqa: B023
                r[np.arange(len(y)), y] -= 1
                g += r.T @ x
            flat = g.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "g"])

        summed = rows.mapInArrow(gradient, "i bigint, g double").groupBy("i").agg(F.sum("g").alias("g")).toArrow()  # one model's weights
        g = np.zeros(w.size)
        g[summed.column("i").to_numpy()] = summed.column("g").to_numpy()
        w = w - lr * g.reshape(w.shape) / n
        out.append(w)
    return out


def _design(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.column_stack((flat, np.ones(len(flat))))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def self_influence(vectors: DataFrame, epochs: int = 6, lr: float = 0.5) -> DataFrame:
    """TracIn self-influence: over the epochs' weights, lr * |residual|^2 * (|x|^2 + 1); local to a row."""
    shared = vectors.sparkSession.sparkContext.broadcast(train_epochs(vectors, epochs, lr))  # a model's weights per epoch

    def run(batches):
        for b in batches:
            x, y = _design(b.column(1)), b.column(2).to_numpy()
            total, p = np.zeros(len(y)), np.zeros((len(y), 1))
            for w in shared.value:
                p = _softmax(x @ w.T)
                r = p.copy()
                r[np.arange(len(y)), y] -= 1
                total += lr * (r**2).sum(1) * (x**2).sum(1)
            given = p[np.arange(len(y)), y] if len(y) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total), pa.array(given)], names=["sample_id", "self_influence", "p_given"])

    return vectors.select("sample_id", "embedding", "label").mapInArrow(run, "sample_id bigint, self_influence double, p_given double")


def what_if(vectors: DataFrame, remove: DataFrame, relabel: DataFrame) -> DataFrame:
    """Evaluation measures of the baseline before and after removing and relabelling training rows."""
    from plumbline.operators.metrics import summary

    fit, held = vectors.filter("split = 'train'"), vectors.filter("split <> 'train'")
    changed = fit.join(remove.select("sample_id"), "sample_id", "left_anti").join(relabel.select("sample_id", "target"), "sample_id", "left").withColumn("label", F.coalesce("target", "label")).drop("target")
    out = None
    for name, rows in (("before", fit), ("after", changed)):
        model = fit_baseline(with_features(materialize(rows, "variant")))
        scored = model.transform(with_features(held).withColumn("label", F.col("label").cast("double")))
        p = vector_to_array("probability")
        s = summary(scored.select(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"), F.get(p, F.col("label").cast("int")).alias("p_given"))).withColumn("variant", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out
