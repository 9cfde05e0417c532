"""Before and after a change set: many weighted models fitted in the same passes, with a control group and intervals.

Variants of the training rows (as they are; changed; with as many rows removed at random) and their
paired Poisson replicates are the columns of one gradient: a pass over the rows moves them all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize
from plumbline.operators.modeling import _design, _softmax

VARIANTS = ("before", "guided", "random")
EFFECTS = ("remove", "relabel", "eval_drop")
SETS = ("original_eval", "preserved_holdout", "cleaned_eval")


def uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each id, by a hash with the seed."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(2**53)


#: Shares up to which a Poisson variable of mean 1 is 0, 1, 2, ...
_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1))) for k in range(16)])


def poisson(ids: np.ndarray, seed: int) -> np.ndarray:
    return np.searchsorted(_POISSON, uniform(ids, seed), "right").astype(np.float64)


@dataclass
class Fitted:
    """Weights of all models, over features that are centred and scaled alike."""

    weights: np.ndarray  # models x classes x (dimensions + 1), the last one constant
    mean: np.ndarray
    scale: np.ndarray

    def probabilities(self, x: np.ndarray, model: int) -> np.ndarray:
        return _softmax(_scaled(x, self.mean, self.scale) @ self.weights[model].T)


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    out = x.copy()
    out[:, :-1] = (x[:, :-1] - mean) / scale
    return out


def _summed(rows: DataFrame, partial, size: int) -> np.ndarray:
    """The sum over partitions of a vector that ``partial`` makes of each batch."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += partial(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

    out, got = np.zeros(size), rows.mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # one vector
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out


class Study:
    """The models to fit: every variant with every replicate. It holds no rows, since it goes to the tasks."""

    def __init__(self, classes: int, replicates: int, seed: int, c: float):
        self.classes, self.replicates, self.seed, self.c = classes, replicates, seed, c
        self.models = [(v, r) for v in VARIANTS for r in range(replicates + 1)]  # replicate 0 has every row once

    def _columns(self, b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        ids, y = b.column(0).to_numpy(), b.column(2).to_numpy()
        after = b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
        return ids, _design(b.column(1)), y, np.where(np.isnan(after), -1, after).astype(np.int64), b.column(4).to_numpy(zero_copy_only=False)

    def _drawn(self, ids: np.ndarray, y: np.ndarray, after: np.ndarray, lucky: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight and label of each row (columns) in each model (rows); a row is drawn alike in all variants of a replicate."""
        draws = np.stack([np.ones(len(ids)), *(poisson(ids, self.seed + r) for r in range(1, self.replicates + 1))])
        there = {"before": np.ones(len(ids)), "guided": (after >= 0).astype(float), "random": (~lucky).astype(float)}
        label = {"before": y, "guided": np.maximum(after, 0), "random": y}
        return np.concatenate([draws * there[v] for v in VARIANTS]), np.concatenate([np.tile(label[v], (self.replicates + 1, 1)) for v in VARIANTS])

    def fit(self, rows: DataFrame, rounds: int = 60, tolerance: float = 1e-7) -> Fitted:
        """Class-balanced softmax regression with a penalty of 1 / c, by accelerated gradient steps.

        ``rows`` has, in this order, ``sample_id``, ``embedding``, ``label``, ``after`` (label, or null:
        removed) and ``lucky`` (removed at random).
        """
        dims, k, m = len(rows.first()["embedding"]), self.classes, len(self.models)

        def measures(b):
            ids, x, y, after, lucky = self._columns(b)
            w, label = self._drawn(ids, y, after, lucky)
            counts = np.stack([np.bincount(label[i], w[i], k) for i in range(m)])
            return np.concatenate([[len(ids)], x[:, :-1].sum(0), (x[:, :-1] ** 2).sum(0), counts.ravel()])

        got = _summed(rows, measures, 1 + 2 * dims + m * k)
        mean = got[1 : dims + 1] / got[0]
        scale = np.sqrt(np.maximum(got[dims + 1 : 2 * dims + 1] / got[0] - mean**2, 1e-12))
        counts = got[2 * dims + 1 :].reshape(m, k)
        total = np.maximum(counts.sum(1), 1e-12)
        balance = np.where(counts > 0, total[:, None] / ((counts > 0).sum(1, keepdims=True) * np.maximum(counts, 1e-12)), 0.0)
        penalty = 1 / (self.c * total)

        def steepness(b):
            ids, x, y, after, lucky = self._columns(b)
            z, (w, label) = _scaled(x, mean, scale), self._drawn(ids, y, after, lucky)
            size = (z**2).sum(1)
            return np.stack([(w[i] * balance[i, label[i]] * size).sum() for i in range(m)])

        step = 1 / (0.5 * np.minimum(_summed(rows, steepness, m) / total, dims + 1) + penalty)
        weights = np.zeros((m, k, dims + 1))
        looked, pace = weights.copy(), 1.0
        for _ in range(rounds):
            at = looked

            def gradient(b, at=at):
                ids, x, y, after, lucky = self._columns(b)
                z, (w, label) = _scaled(x, mean, scale), self._drawn(ids, y, after, lucky)
                out = np.empty((m, k, dims + 1))
                for i in range(m):
                    r = _softmax(z @ at[i].T)
                    r[np.arange(len(y)), label[i]] -= 1
                    out[i] = (r * (w[i] * balance[i, label[i]])[:, None]).T @ z
                return out.ravel()

            g = _summed(rows, gradient, m * k * (dims + 1)).reshape(m, k, dims + 1) / total[:, None, None]
            g[:, :, :-1] += penalty[:, None, None] * at[:, :, :-1]
            new = at - step[:, None, None] * g
            if ((at - new) * (new - weights)).sum() > 0:  # momentum points uphill: begin it anew
                pace = 1.0
            following = (1 + np.sqrt(1 + 4 * pace**2)) / 2
            looked, moved = new + (pace - 1) / following * (new - weights), np.abs(new - weights).max()
            weights, pace = new, following
            if moved < tolerance:
                break
        return Fitted(weights, mean, scale)


def _f1(counts: np.ndarray) -> tuple[float, float]:
    """Macro F1 over classes that occur, and accuracy, of a table of (true, predicted)."""
    true, said, right = counts.sum(1), counts.sum(0), np.diag(counts)
    there = true > 0
    f1 = np.divide(2 * right, true + said, out=np.zeros(len(right)), where=true + said > 0)
    return (float(f1[there].mean()) if there.any() else 0.0), float(right.sum() / max(counts.sum(), 1e-12))


def what_if_study(vectors: DataFrame, changes: DataFrame, leaking: DataFrame | None = None, replicates: int = 5, resamples: int = 200, seed: int = 42, c: float = 0.001, rounds: int = 60) -> DataFrame:
    """What a change set does to models, on three sets of evaluation rows, against removing as many rows at random.

    ``vectors``: sample_id, embedding, label (0, 1, ...), split. ``changes``: sample_id, effect
    (``remove``, ``relabel``, ``eval_drop``) and target, one row for each sample. Sets:
    ``original_eval``; ``preserved_holdout``, without touched rows and those in ``leaking``;
    ``cleaned_eval``, without dropped rows and with changed labels.

    One row per ``variant`` (guided, random), ``set`` and ``metric``: ``n``, ``before``, ``after``,
    ``delta``, ``std`` and ``low`` to ``high`` of the delta over ``replicates`` paired Poisson draws of
    the training rows, ``within_noise`` (|delta| <= 2 std), and for the preserved holdout ``ci_low``
    and ``ci_high``: 95 % of ``resamples`` Poisson draws of the evaluation rows. Rows are drawn by
    hashes of ids, so results repeat. Rows with a null label or vector take no part. The models'
    weights, which don't grow with the rows, are what reaches the driver.
    """
    rows = vectors.filter("label is not null and embedding is not null").select("sample_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.col("label").cast("int").alias("label"), "split")
    change = changes.select("sample_id", "effect", F.col("target").cast("int").alias("target")).dropDuplicates(["sample_id"])
    leak = (leaking if leaking is not None else rows.limit(0)).select("sample_id").distinct().withColumn("leaks", F.lit(True))
    known = materialize(rows.join(change, "sample_id", "left").join(leak, "sample_id", "left"), "study-rows")
    train, held = known.filter("split = 'train'"), known.filter("split <> 'train'")
    size = known.agg(F.max("label").alias("k"), F.max("target").alias("t"), F.count_if(F.col("split") == "train").alias("n"), F.count_if((F.col("split") == "train") & (F.col("effect") == "remove")).alias("gone")).first()
    if not size["n"]:
        raise ValueError("no training rows")
    share, classes = size["gone"] / size["n"], int(max(size["k"], size["t"] or 0)) + 1
    after = F.when(F.col("effect") == "remove", None).when(F.col("effect") == "relabel", F.coalesce("target", "label")).otherwise(F.col("label"))
    luck = F.pmod(F.xxhash64("sample_id", F.lit(seed + 7)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))
    fit_rows = materialize(train.select("sample_id", "embedding", "label", after.cast("int").alias("after"), luck.alias("lucky")), "study-training")
    study = Study(classes, replicates, seed, c)
    fitted = study.fit(fit_rows, rounds)
    shared = vectors.sparkSession.sparkContext.broadcast(fitted)  # models x classes x dimensions
    m, cell, draws = len(study.models), classes * classes, max(resamples, 0)
    untouched = F.col("effect").isNull() & F.col("leaks").isNull()
    cleaned = F.when(F.coalesce(F.col("effect") == "relabel", F.lit(False)), F.coalesce("target", "label")).otherwise(F.col("label"))
    eval_rows = held.select("sample_id", "embedding", "label", untouched.alias("kept"), (F.coalesce("effect", F.lit("")) != "eval_drop").alias("stays"), cleaned.cast("int").alias("cleaned"))

    def tally(b):
        ids, x, y = b.column(0).to_numpy(), _design(b.column(1)), b.column(2).to_numpy()
        kept, stays, clean = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
        sets = ((np.ones(len(y), bool), y), (kept.astype(bool), y), (stays.astype(bool), clean))
        out, boot = np.zeros((m, len(sets), cell)), np.zeros((draws, len(VARIANTS), cell))
        weights = np.stack([poisson(ids, seed + 5000 + d) for d in range(draws)]) if draws else np.zeros((0, len(ids)))
        for i in range(m):
            said = shared.value.probabilities(x, i).argmax(1)
            for s, (inside, label) in enumerate(sets):
                out[i, s] = np.bincount(label[inside] * classes + said[inside], minlength=cell)
            if study.models[i][1] == 0:
                at, inside = y * classes + said, kept.astype(bool)
                for d in range(draws):
                    boot[d, VARIANTS.index(study.models[i][0])] = np.bincount(at[inside], weights[d, inside], cell)
        return np.concatenate([out.ravel(), boot.ravel()])

    got = _summed(eval_rows, tally, m * len(SETS) * cell + draws * len(VARIANTS) * cell)
    tables = got[: m * len(SETS) * cell].reshape(m, len(SETS), classes, classes)
    boots = got[m * len(SETS) * cell :].reshape(draws, len(VARIANTS), classes, classes)
    at = {x: i for i, x in enumerate(study.models)}
    result = []
    for v in VARIANTS[1:]:
        for s, name in enumerate(SETS):
            for j, metric in enumerate(("macro_f1", "accuracy")):
                of = lambda variant, r: _f1(tables[at[variant, r], s])[j]  # noqa: B023, E731
                before, after_value = of("before", 0), of(v, 0)
                delta, deltas = after_value - before, [of(v, r) - of("before", r) for r in range(1, replicates + 1)]
                std = float(np.std(deltas)) if deltas else 0.0
                ends = [None, None]
                if s == 1 and draws:
                    resampled = [_f1(b[VARIANTS.index(v)])[j] - _f1(b[0])[j] for b in boots]
                    ends = [round(float(x), 6) for x in np.percentile(resampled, [2.5, 97.5])]
                extent = [round(f(deltas), 6) if deltas else None for f in (min, max)]
                result.append((v, name, metric, int(tables[0, s].sum()), round(before, 6), round(after_value, 6), round(delta, 6), round(std, 6), *extent, bool(deltas) and abs(delta) <= 2 * std, *ends))
    schema = "variant string, set string, metric string, n int, before double, after double, delta double, std double, low double, high double, within_noise boolean, ci_low double, ci_high double"
    return vectors.sparkSession.createDataFrame(result, schema)


def temperature_scale(rows: DataFrame, low: float = 0.05, high: float = 20.0, points: int = 512, least: int = 20) -> DataFrame:
    """The temperature that makes probabilities fit their labels best: one row with ``temperature``, ``nll`` before and after, and ``n``.

    ``rows`` has ``probabilities`` (an array) and ``label`` (a place in it). Temperatures are
    ``low * (high / low) ** (k / points)``; the mean negative log-likelihood of ``p ** (1 / T)`` falls
    and then rises with k, so a bracket of a few points is refined: one aggregation a round, which
    evaluates all its points. Under ``least`` rows the temperature is 1. Rows whose label has no
    probability, or a null one, are left out; probabilities below 1e-12 count as that.
    """
    floor = F.transform("probabilities", lambda p: F.ln(F.greatest(p.cast("double"), F.lit(1e-12))))
    good = rows.filter("label >= 0 and label < size(probabilities)").filter(~F.exists("probabilities", lambda p: p.isNull())).select(floor.alias("z"), "label")
    good = materialize(good, "temperatures")

    def losses(temperatures: list[float]) -> list[float]:
        def loss(t: float):
            scaled = F.transform("z", lambda v: v / F.lit(t))
            top = F.array_max(scaled)
            total = F.aggregate(F.transform(scaled, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
            return F.avg(F.ln(total) + top - F.get(scaled, F.col("label").cast("int")))

        return list(good.agg(*[loss(t).alias(f"l{i}") for i, t in enumerate(temperatures)]).first())

    n = good.count()
    at = lambda k: low * (high / low) ** (k / points)
    result = (1.0, *(losses([1.0]) * 2 if n else (None, None)), n)
    if n >= least:
        first, last = 0, points
        while True:
            stride = max(1, -(-(last - first) // 16))
            ks = [*range(first, last, stride), last]
            values = losses([at(k) for k in ks])
            best = min(range(len(ks)), key=lambda i: values[i])
            if stride == 1:
                break
            first, last = ks[max(best - 1, 0)], ks[min(best + 1, len(ks) - 1)]
        result = (at(ks[best]), losses([1.0])[0], values[best], n)
    spark = rows.sparkSession
    return spark.createDataFrame([result], "temperature double, nll_before double, nll_after double, n bigint")
