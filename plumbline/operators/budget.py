"""Which cases to review within a budget of items or minutes: greedy selection with diminishing returns."""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

#: What a further case of a family is worth, what one of a class is worth, and of how many of these account is taken.
FAMILY, CLASS, CLASS_MOST = 0.5, 0.85, 10
HIGH_IMPACT = ("POSSIBLE_RELABEL", "STRONG_REVIEW", "LEAKAGE_ACTION_NEEDED", "POSSIBLE_REMOVE")
LEAST_MINUTES = 0.25
SALTS = 64
QUEUE = "rank int, case_id bigint, value double, gain double, ratio double, spent double"


def candidates(cases: DataFrame, most: int) -> DataFrame:
    """The cases that a greedy choice of ``most`` can come to, whatever it chose before.

    Cases of one class and equal minutes differ in value and family alone. Of them, those of a
    family are taken in falling order; and of the families, at most ``most`` - 1 were chosen from
    before, so the best untouched one is among the first ``most`` by their best case.
    """
    alone = F.concat(F.lit("c"), F.col("case_id").cast("string"))
    kin = cases.withColumns({"kin": F.coalesce(F.concat(F.lit("f"), F.col("family").cast("string")), alone), "own": F.col("value") / F.greatest(F.lit(LEAST_MINUTES), "minutes")})
    falling = F.desc("own"), F.asc("case_id")
    within = kin.withColumn("j", F.row_number().over(Window.partitionBy("class", "minutes", "kin").orderBy(*falling))).filter(F.col("j") <= most)
    heads = within.filter("j = 1").select("class", "minutes", "kin", "own", "case_id", F.pmod(F.xxhash64("kin"), F.lit(SALTS)).alias("salt"))
    for cell in (("class", "minutes", "salt"), ("class", "minutes")):  # a frequent class is cut down in parts first
        heads = heads.withColumn("r", F.row_number().over(Window.partitionBy(*cell).orderBy(*falling))).filter(F.col("r") <= most)
    return within.join(heads.select("class", "minutes", "kin"), ["class", "minutes", "kin"], "left_semi").select("case_id", "value", "minutes", "family", "class")


def review_queue(cases: DataFrame, max_items: int | None = None, max_minutes: float | None = None) -> DataFrame:
    """The greedy queue: each next case has the highest gain a minute among those that still fit; ties go to the smaller ``case_id``.

    ``cases`` has case_id, value, minutes, family (null: none) and class. A case's gain is its value
    times 0.5 for each chosen case of its family and 0.85 for each of its class, ten at most. A case
    that doesn't fit the minutes left is passed over. At least one budget is needed; it bounds the
    queue, and with it what reaches the driver: of each class and number of minutes at most as many
    families, and cases of each, as the queue can hold (minutes should be of few values). Null
    values count as 0, null minutes as the least. Returns ``QUEUE``.
    """
    if max_items is None and max_minutes is None:
        raise ValueError("give max_items or max_minutes")
    most = min(x for x in (max_items, None if max_minutes is None else int(max_minutes / LEAST_MINUTES)) if x is not None)
    whole = cases.select("case_id", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"), F.greatest(F.coalesce(F.col("minutes").cast("double"), F.lit(0.0)), F.lit(LEAST_MINUTES)).alias("minutes"), "family", "class")
    rows = {r["case_id"]: r for r in candidates(whole, most).collect()} if most > 0 else {}
    chosen = lazy_greedy(rows, max_items, max_minutes)
    return cases.sparkSession.createDataFrame([Row(*r) for r in chosen], QUEUE)


def lazy_greedy(rows: dict, max_items: int | None, max_minutes: float | None) -> list[tuple]:
    """Gains only fall, so the first case whose gain is up to date is the best one."""
    family, label, spent, out = Counter(), Counter(), 0.0, []

    def gain(r):
        factor = FAMILY ** family[r["family"]] if r["family"] is not None else 1.0
        return r["value"] * (factor * CLASS ** min(label[r["class"]], CLASS_MOST))

    heap = [(-gain(r) / r["minutes"], i) for i, r in rows.items()]
    heapq.heapify(heap)
    while heap and (max_items is None or len(out) < max_items):
        known, i = heapq.heappop(heap)
        r = rows[i]
        if max_minutes is not None and spent + r["minutes"] > max_minutes + 1e-9:
            continue
        now = -gain(r) / r["minutes"]
        if now > known:
            heapq.heappush(heap, (now, i))
            continue
        spent += r["minutes"]
        out.append((len(out) + 1, i, r["value"], round(-now * r["minutes"], 6), round(-now, 6), round(spent, 6)))
        label[r["class"]] += 1
        if r["family"] is not None:
            family[r["family"]] += 1
    return out


def explained(queue: DataFrame, cases: DataFrame, objective: str) -> DataFrame:
    """``queue`` with ``reason``: verdict and priority, and what else speaks for the case (categories, impact, split, uncertainty)."""
    held = F.when(F.col("split").isin("val", "test"), F.concat("split", F.lit(" sample: label errors here distort metrics")))
    impact = F.when(F.col("impact") >= 0.5, F.concat(F.lit("high estimated impact ("), F.format_number("impact", 2), F.lit(")")))
    parts = [
        F.concat(F.lower(F.replace("verdict", F.lit("_"), F.lit(" "))), F.lit(" (priority "), F.format_number("priority", 2), F.lit(")")),
        F.when(F.array_contains("categories", "leakage"), "affects evaluation integrity"),
        impact,
        held,
        F.when(F.col("uncertainty") == "high", "evidence conflicts: human judgment is most valuable"),
    ]
    facts = cases.select("case_id", "verdict", "priority", "categories", "impact", "split", "uncertainty")
    return queue.join(facts, "case_id").select(*queue.columns, F.concat(F.array_join(F.array_compact(F.array(*parts)), "; "), F.lit(f" [objective: {objective}]")).alias("reason"))


def coverage(queue: DataFrame, cases: DataFrame) -> DataFrame:
    """What share of the cases a queue takes: by ``category`` (a case can have several, or ``other``), all ``value``, and ``high_impact`` cases; ``taken``, ``open`` and ``share``."""
    chosen = queue.select("case_id", F.lit(1).alias("in_queue"))
    rows = cases.join(F.broadcast(chosen), "case_id", "left").withColumn("in_queue", F.coalesce("in_queue", F.lit(0)))  # the queue is bounded by its budget
    none = F.array(F.lit("other"))
    groups = F.when(F.size("categories") > 0, F.col("categories")).otherwise(none)
    count = lambda name, w: F.struct(name.alias("part"), F.coalesce(w.cast("double"), F.lit(0.0)).alias("w"))
    parts = F.concat(F.transform(groups, lambda g: count(F.concat(F.lit("category: "), g), F.lit(1))), F.array(count(F.lit("value"), F.col("value"))), F.when(F.col("verdict").isin(*HIGH_IMPACT), F.array(count(F.lit("high_impact"), F.lit(1)))).otherwise(F.array().cast("array<struct<part:string,w:double>>")))
    summed = rows.select("in_queue", F.explode(parts).alias("x")).groupBy("x.part").agg(F.sum(F.col("x.w") * F.col("in_queue")).alias("taken"), F.sum("x.w").alias("open"))
    return summed.select("part", F.round("taken", 4).alias("taken"), F.round("open", 4).alias("open"), F.round(F.when(F.col("open") > 0, F.col("taken") / F.col("open")).otherwise(0.0), 4).alias("share"))
