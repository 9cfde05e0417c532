"""Mixing sources to target weights by iterative proportional fitting.

Documents are tallied into cells of (source, language, topic). Fitting scales the cells' token
weights to the target share of each source, each language and each topic in turn, never over the
tokens a cell has, for a given number of sweeps; ``residuals`` tells how far the margins still are
from their targets then. A document is kept with the probability weight / tokens of its cell, by a
hash of its id and a seed.

Every level is fitted as itself, however many there are. A tally whose margins have at most
``max_levels`` levels each is gathered and fitted at once; a larger one stays a Spark table, and
each step of a sweep is an aggregation and a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize
from plumbline.llm.common import unused

NONE = "(none)"
MARGINS = ("source", "lang", "topic")

#: Topics by form: name and the pattern that a text must contain; the first that fits wins.
TOPICS = (
    ("legal", r"[Ll]icensed under|[Aa]ll rights reserved|[Cc]opyright"),
    ("contact", r"[A-Za-z0-9._-]@[A-Za-z0-9-]+\.[A-Za-z]"),
    ("tabular", r" \| "),
    ("numeric", r"[0-9]{3}"),
)


def topic_of(text: Column) -> Column:
    chain = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        chain = F.when(F.regexp_like(text, F.lit(pattern)), name).otherwise(chain)
    return chain


def token_count(text: Column) -> Column:
    """Runs of anything but blank, tab and line ends."""
    return F.regexp_count(text, F.lit(r"[^ \t\r\n]+")).cast("bigint")


def rake(tokens: np.ndarray, levels: list[np.ndarray], targets: list[np.ndarray], budget: float, sweeps: int) -> np.ndarray:
    """Cell weights that meet the targets' shares of ``budget``, each at most the cell's tokens.

    ``levels[m]`` is the level of every cell in margin m and ``targets[m]`` the share of every
    level. Where a level has fewer tokens than its target, its cells are taken whole.
    """
    weights = tokens * (budget / max(tokens.sum(), 1.0))
    for _ in range(sweeps):
        for level, target in zip(levels, targets):
            now = np.bincount(level, weights, len(target))
            factor = np.divide(target * budget, now, out=np.ones(len(now)), where=now > 0)
            weights = np.minimum(weights * factor[level], tokens)
    return weights


def tempered(tokens: np.ndarray, power: float) -> np.ndarray:
    """Shares in proportion to tokens ** power: 1 keeps the mix, 0 makes it even."""
    shares = tokens**power
    return shares / max(shares.sum(), 1e-300)


def mix(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    power: float = 0.8,
    keep: float = 0.7,
    sweeps: int = 20,
    max_levels: int = 64,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows of ``docs`` with ``topic``, ``tokens``, ``probability`` and ``kept``.

    ``targets`` names shares of levels by margin (``source``, ``lang``, ``topic``); levels not
    named share what is left, and margins not named get their present shares, tempered by
    ``power``. ``keep`` is the part of all tokens to keep.

    Null sources and languages are the level ``(none)``; null texts have no tokens and topic
    ``prose``. A cell without tokens keeps everything, as it takes nothing from the budget. Rows
    with equal ids are kept or dropped together. A column ``topic`` of ``docs`` is used if there
    is one. An empty table gives no rows. Extra columns pass through, except that columns named
    like the results are replaced.
    """
    rows, (*levels, tokens, probability, kept) = _drawn(docs, targets, power, keep, sweeps, max_levels, seed, id_col, text_col)
    own = [c for c in docs.columns if c.lower() not in ("topic", "tokens", "probability", "kept")]
    return rows.select(*own, F.col(levels[2]).alias("topic"), F.col(tokens).alias("tokens"), F.col(probability).alias("probability"), F.col(kept).alias("kept"))


def _drawn(docs: DataFrame, targets: dict | None, power: float = 0.8, keep: float = 0.7, sweeps: int = 20, max_levels: int = 64, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` untouched, with six columns more under names that it doesn't have: levels of the margins, tokens, probability, and whether kept."""
    names = unused(docs.columns, *(f"__{m}" for m in MARGINS), "__tokens", "__probability", "__kept")
    *levels, tokens, probability_name, kept_name = names
    text = F.coalesce(docs[text_col], F.lit(""))
    has_topic = "topic" in (c.lower() for c in docs.columns)
    named = {m: topic_of(text) if m == "topic" and not has_topic else F.coalesce(docs[m].cast("string"), F.lit(NONE)) for m in MARGINS}
    met = docs.withColumns({level: named[m] for level, m in zip(levels, MARGINS)} | {tokens: token_count(text)})
    tally = materialize(met.groupBy(*[F.col(level).alias(m) for level, m in zip(levels, MARGINS)]).agg(F.sum(tokens).alias("tokens")), "mix-tally")
    most = max(tally.agg(*[F.count_distinct(m) for m in MARGINS]).first())
    if most <= max_levels:
        probability = _probabilities(tally.orderBy(*MARGINS).toPandas(), targets or {}, power, keep, sweeps)
        columns = {n: pa.array([key[i] for key in probability], pa.string()) for i, n in enumerate(("c_source", "c_lang", "c_topic"))}
        table = F.broadcast(docs.sparkSession.createDataFrame(pa.table(columns | {"probability": pa.array(probability.values(), pa.float64())})))  # max_levels ** 3 cells at most
    else:
        table = _fitted(tally, targets or {}, power, keep, sweeps)
    table = table.select(*[F.col(f"c_{m}").alias(level) for m, level in zip(MARGINS, levels)], F.col("probability").alias(probability_name))
    joined = met.join(table, levels, "left")
    luck = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(NONE)))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    sure = F.coalesce(F.col(probability_name), F.lit(1.0))
    return joined.withColumn(probability_name, sure).withColumn(kept_name, luck < F.col(probability_name)), names


def _probabilities(cells, targets: dict, power: float, keep: float, sweeps: int) -> dict[tuple, float]:
    tokens = cells["tokens"].to_numpy(np.float64)
    levels, goals = [], []
    for m in MARGINS:
        names, level = np.unique(cells[m].to_numpy(dtype=object).astype(str), return_inverse=True)
        have = np.bincount(level, tokens, len(names))
        goal = tempered(have, power)
        if asked := targets.get(m):
            fixed = np.array([asked.get(n, np.nan) for n in names])
            left = max(0.0, 1.0 - np.nansum(fixed))
            goal = np.where(np.isnan(fixed), goal * left / max(goal[np.isnan(fixed)].sum(), 1e-300), fixed)
        levels.append(level)
        goals.append(goal)
    weights = rake(tokens, levels, goals, keep * tokens.sum(), sweeps)
    share = np.divide(weights, tokens, out=np.ones_like(weights), where=tokens > 0)
    return {(s, la, t): round(float(p), 9) for s, la, t, p in zip(cells["source"], cells["lang"], cells["topic"], share)}


def _fitted(tally: DataFrame, targets: dict, power: float, keep: float, sweeps: int) -> DataFrame:
    """The same as ``_probabilities`` as a table: ``c_source``, ``c_lang``, ``c_topic`` and ``probability`` of every cell."""
    spark = tally.sparkSession
    budget = keep * float(tally.agg(F.sum("tokens")).first()[0] or 0)
    goals = {}
    for m in MARGINS:
        fixed = targets.get(m) or {}
        asked = spark.createDataFrame(pa.table({m: pa.array(fixed, pa.string()), "fixed": pa.array(map(float, fixed.values()), pa.float64())}))
        have = tally.groupBy(m).agg(F.pow(F.sum("tokens").cast("double"), F.lit(float(power))).alias("goal")).join(asked, m, "left")
        have = materialize(have, "mix-goals")
        free = F.sum(F.when(F.col("fixed").isNull(), F.col("goal")))
        sums = have.agg(F.coalesce(F.sum("fixed"), F.lit(0.0)).alias("fixed"), F.coalesce(free, F.lit(0.0)).alias("free")).first()
        left = max(0.0, 1.0 - sums["fixed"]) / max(sums["free"], 1e-300)
        goals[m] = have.select(m, (F.coalesce("fixed", F.col("goal") * left) * budget).alias("goal"))
    cells = tally.select(*MARGINS, F.col("tokens").cast("double").alias("tokens")).withColumn("w", F.col("tokens") * keep)
    for _ in range(sweeps):
        for m in MARGINS:
            factor = cells.groupBy(m).agg(F.sum("w").alias("now")).join(goals[m], m).select(m, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(1.0).alias("factor"))
            cells = cells.join(factor, m).select(*MARGINS, "tokens", F.least(F.col("w") * F.col("factor"), "tokens").alias("w"))
        cells = materialize(cells, "mix-sweep")
    share = F.round(F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0), 9)
    return cells.select(*[F.col(m).alias(f"c_{m}") for m in MARGINS], share.alias("probability"))


def residuals(mixed: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.8) -> DataFrame:
    """``margin``, ``level``, ``target`` and ``share``: of every level its target share of the kept tokens, and the share that ``mix`` gives it on average.

    The two differ where levels have fewer tokens than their targets, or after too few sweeps.
    """
    named = [F.struct(F.lit(m).alias("margin"), F.coalesce(F.col(m).cast("string"), F.lit(NONE)).alias("level")) for m in MARGINS]
    levels = mixed.select(F.explode(F.array(*named)).alias("x"), "tokens", "probability").groupBy("x.margin", "x.level").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("probability")).alias("kept"))
    fixed = F.lit(None).cast("double")
    for m, names in (targets or {}).items():
        for level, share in names.items():
            fixed = F.when((F.col("margin") == m) & (F.col("level") == level), F.lit(float(share))).otherwise(fixed)
    goal = levels.withColumns({"fixed": fixed, "free": F.when(fixed.isNull(), F.pow(F.col("tokens").cast("double"), F.lit(power))).otherwise(0.0)})
    whole = goal.groupBy("margin").agg(F.sum("kept").alias("all"), F.coalesce(F.sum("fixed"), F.lit(0.0)).alias("taken"), F.sum("free").alias("free_all"))
    left = F.greatest(F.lit(1.0) - F.col("taken"), F.lit(0.0))
    target = F.coalesce("fixed", F.col("free") * left / F.greatest("free_all", F.lit(1e-300)))
    return goal.join(whole, "margin").select("margin", "level", F.round(target, 9).alias("target"), F.round(F.col("kept") / F.greatest("all", F.lit(1e-300)), 9).alias("share"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows that ``mix`` keeps, untouched: further columns may have any names."""
    rows, names = _drawn(docs, settings.pop("targets", None), **settings)
    return rows.filter(F.col(names[-1])).select(*docs.columns)


def oracle_sql(power: float, keep: float, sweeps: int, seed: int) -> str:
    """The same as SQL: one block per margin and sweep."""
    pattern = " ".join(f"when regexp_matches(t, '{p}') then '{n}'" for n, p in TOPICS)
    parts = [
        "docs as (select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang, coalesce(text, '') as t from documents)",
        rf"tallied as (select doc_id, source, lang, case {pattern} else 'prose' end as topic, len(regexp_extract_all(t, '[^ \t\r\n]+')) as tokens from docs)",
        "cells as (select source, lang, topic, sum(tokens)::double as tokens from tallied group by all)",
        "total as (select sum(tokens) as n from cells)",
    ]
    for m in MARGINS:
        parts.append(f"goal_{m} as (select {m}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) over () * (select n from total) * {keep} as goal from cells group by {m})")
    parts.append(f"w0 as (select *, tokens * {keep} as w from cells)")
    for i in range(sweeps * 3):
        m = MARGINS[i % 3]
        parts.append(f"w{i + 1} as materialized (select source, lang, topic, tokens, least(w * case when s > 0 then goal / s else 1 end, tokens) as w from (select *, sum(w) over (partition by {m}) as s from w{i}) join goal_{m} using ({m}))")
    return f"""with {', '.join(parts)}
select doc_id, source, lang, topic, tokens, round(p, 6) as probability, ('0x' || substr(md5('{seed}|' || doc_id), 1, 8))::bigint / 4294967296.0 < p as kept
from (select t.*, case when c.tokens > 0 then round(c.w / c.tokens, 9) else 1.0 end as p from tallied t join w{sweeps * 3} c using (source, lang, topic))"""
