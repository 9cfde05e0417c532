"""Debt levels, preflight checks and data contracts over one row of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels and statuses in rising order.
LEVELS = ("LOW", "MODERATE", "HIGH", "CRITICAL")
STATUSES = ("READY", "READY_WITH_WARNINGS", "BLOCKED")
#: Fixed values, by dimension: limits of moderate, high and critical, and whether it counts overall.
DEBT_LIMITS = {
    "label": (0.01, 0.03, 0.08, True),
    "leakage": (0.005, 0.02, 0.05, True),
    "quality": (0.02, 0.05, 0.12, True),
    "coverage": (2, 5, 9, True),
    "shortcut": (0.3, 0.5, 0.7, True),
    "duplication": (0.02, 0.05, 0.15, True),
    "review": (0.01, 0.03, 0.08, True),
    "provenance": (0.1, 0.5, 0.9, False),
}


def debt(facts: DataFrame) -> DataFrame:
    """One row per dimension: value, level rank (0 to 3), level, score, and the overall level."""
    c, n = F.col, F.greatest(F.col("sample_count"), F.lit(1))
    imbalance = F.coalesce(c("imbalance_ratio"), F.lit(1.0))
    values = {
        "label": (c("unresolved_label_strong") + 0.5 * c("unresolved_label_review")) / n,
        "leakage": F.when(c("eval_count") > 0, c("eval_samples_leaking") / c("eval_count")).otherwise(0.0),
        "quality": c("quality_samples") / n,
        "coverage": 2 * c("gaps_high") + c("gaps_medium") + F.when(imbalance >= 10, 3).when(imbalance >= 4, 1).otherwise(0),
        "shortcut": c("shortcut_max"),
        "duplication": c("redundant_samples") / n,
        "review": c("unresolved_high_priority") / n,
        "provenance": 1 - c("provenance_coverage"),
    }

    def row(name: str) -> Column:
        m, h, k, scored = DEBT_LIMITS[name]
        v = values[name].cast("double")
        rank = F.when(v >= k, 3).when(v >= h, 2).when(v >= m, 1).otherwise(0)
        if name == "leakage":  # exact copies in evaluation are high debt however few
            rank = F.greatest(rank, F.when(c("exact_eval_leaks") > 0, 2).otherwise(0))
        return F.struct(F.lit(name).alias("dimension"), F.round(v, 5).alias("value"), rank.alias("rank"), F.round(F.least(F.lit(100.0), 100 * v / k), 1).alias("score"), F.lit(scored).alias("scored"))

    rows = facts.select(F.array(*[row(name) for name in DEBT_LIMITS]).alias("r"))
    scored = F.filter("r", lambda x: x["scored"])
    top = F.array_max(F.transform(scored, lambda x: x["rank"]))
    moderate = F.size(F.filter(scored, lambda x: x["rank"] == 1))
    overall = F.when(top == 3, 3).when((top == 2) | (moderate >= 3), 2).otherwise(top)
    name = lambda rank: F.element_at(F.array(*[F.lit(x) for x in LEVELS]), rank + 1)
    return rows.select(F.explode("r").alias("x"), overall.alias("o")).select("x.dimension", "x.value", name(F.col("x.rank")).alias("level"), "x.score", name(F.col("o")).alias("overall"))


def preflight(facts: DataFrame) -> DataFrame:
    """One row per check with pass, warn or block, and the status of all."""
    c = F.col
    n = F.greatest(c("sample_count"), F.lit(1))
    block, warn = F.lit("block"), F.lit("warn")
    status = lambda *rules: F.coalesce(*[F.when(when, then) for when, then in rules], F.lit("pass"))
    has_eval = c("eval_count") > 0
    checks = [
        ("readable", status((c("unreadable_fraction") > 0.2, block), (c("unreadable_fraction") > 0, warn))),
        ("min_classes", status((c("class_count") < 2, block))),
        ("train_covers_eval", status((c("missing_from_train") > 0, block))),
        (F.when(has_eval, "eval_covers_classes").otherwise("has_eval_split"), status((~has_eval | (c("missing_from_eval") > 0), warn))),
        ("exact_eval_leakage", status((c("exact_eval_leaks") > 0, block))),
        ("near_eval_leakage", status((c("eval_samples_leaking") > c("exact_eval_leaks"), warn))),
        ("critical_cases", status((c("unresolved_high_priority") / n > 0.1, block), (c("unresolved_high_priority") > 0, warn))),
        ("imbalance", status((F.coalesce(c("imbalance_ratio"), F.lit(1.0)) > 10, warn))),
        ("min_per_class", status((c("min_class_count") < 30, warn))),
        ("shortcut", status((c("shortcut_max") >= 0.5, warn))),
        ("coverage", status((c("gaps_high") > 0, warn))),
        ("review_queue", status((c("unresolved_cases") >= 1, warn))),
        ("provenance", status((1 - c("provenance_coverage") > 0.5, warn))),
    ]
    rows = facts.select(F.array(*[F.struct((F.lit(k) if isinstance(k, str) else k).alias("check"), s.alias("outcome")) for k, s in checks]).alias("r"))
    any_of = lambda x: F.exists("r", lambda r: r["outcome"] == x)
    total = F.when(any_of("block"), "BLOCKED").when(any_of("warn"), "READY_WITH_WARNINGS").otherwise("READY")
    return rows.select(F.explode("r").alias("x"), total.alias("status")).select("x.check", "x.outcome", "status")


COMPARE = {"<=": lambda a, b: a <= b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "==": lambda a, b: a == b}


def contract(facts: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """``metric``, ``op``, ``expected``, ``actual``, ``passed`` of numeric rules over columns of ``facts``; a null fact fails."""
    rows = [F.struct(F.lit(m).alias("metric"), F.lit(op).alias("op"), F.lit(float(v)).alias("expected"), F.round(F.col(m).cast("double"), 5).alias("actual"), F.coalesce(COMPARE[op](F.col(m), F.lit(v)), F.lit(False)).alias("passed")) for m, op, v in rules]
    return facts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def contract_includes(actual: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """``metric``, ``missing`` and ``passed`` of rules that a set of values must include others.

    ``actual`` has ``metric`` and ``values`` (an array); a metric that is not there lacks everything.
    """
    asked = actual.sparkSession.createDataFrame([(m, e) for m, e in rules], "metric string, expected array<string>")
    met = asked.join(actual, "metric", "left")
    missing = F.array_sort(F.array_except("expected", F.coalesce("values", F.array().cast("array<string>"))))
    return met.select("metric", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("passed"))


def level_rank(level: str | Column) -> Column:
    """Place of a level or status in rising order; null for another word."""
    level = F.col(level) if isinstance(level, str) else level
    return F.coalesce(*[F.when(level == name, F.lit(i)) for order in (LEVELS, STATUSES) for i, name in enumerate(order)])


def contract_levels(actual: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``metric``, ``op``, ``expected``, ``level`` and ``passed`` of rules that compare levels or statuses by their order.

    ``actual`` has ``metric`` and ``level``; a metric that isn't there, or a word that is no level, fails.
    """
    asked = actual.sparkSession.createDataFrame(rules, "metric string, op string, expected string")
    met = asked.join(actual, "metric", "left")
    a, b = level_rank("level"), level_rank("expected")
    passed = F.coalesce(*[F.when(F.col("op") == op, test(a, b)) for op, test in COMPARE.items()])
    return met.select("metric", "op", "expected", "level", F.coalesce(passed, F.lit(False)).alias("passed"))
