"""Measured attributes of texts, robust statistics, quality rules, cues and conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.quantiles import exact_quantiles, one_row

#: Limits of the quality rules: absolute ones, and distances in robust standard deviations.
LIMITS = {"min_chars": 32, "min_chars_rel": 0.25, "symbols": 0.2, "symbols_z": 2.5, "digits": 0.1, "digits_z": 2.5, "repeated": 0.3, "word_length": 14.0, "word_length_z": 4.0, "empty_words": 3, "capitals": 0.3, "capitals_z": 2.5, "max_chars_rel": 20.0, "unbroken": 30.0, "repeated_high": 0.9, "no_digits_symbols": 0.5}


def text_attributes(samples: DataFrame) -> DataFrame:
    """Length, words, mean word length, and shares of symbols, digits, capitals and repeated lines."""
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    share = lambda count: F.when(n > 0, count / n).otherwise(0.0)
    words = F.regexp_count(text, F.lit(r"[^ \t\r\n]+"))
    letters = F.length(F.regexp_replace(text, r"[ \t\r\n]", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    return samples.withColumns(
        {
            "chars": n.cast("bigint"),
            "words": words.cast("bigint"),
            "word_length": F.when(words > 0, letters / words).otherwise(0.0),
            "symbols": share(F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]"))),
            "digits": share(F.regexp_count(text, F.lit(r"[0-9]"))),
            "capitals": share(F.regexp_count(text, F.lit(r"[A-Z]"))),
            "repeated": F.when(F.size(lines) > 0, 1 - F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(0.0),
        }
    )


def robust_scale(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Median and scale of columns: 1.4826 times the median absolute deviation, or the standard deviation where that vanishes.

    Of whole columns the medians are selected by range histograms; groups are taken to be many and
    keep their own counts of values.
    """
    scale = lambda c: F.when(F.col(f"{c}__mad") < 1e-9, F.col(f"{c}__std") + 1e-9).otherwise(1.4826 * F.col(f"{c}__mad"))
    if not by:
        medians = exact_quantiles(df, {c: (c, 0.5) for c in columns})
        off = df.select(*[F.abs(F.col(c) - F.lit(medians[c]).cast("double")).alias(c) for c in columns])
        spread = exact_quantiles(off, {c: (c, 0.5) for c in columns})
        stats = one_row(df, {f"{c}__median": medians[c] for c in columns} | {f"{c}__mad": spread[c] for c in columns})
        whole = df.agg(*[F.stddev_pop(c).alias(f"{c}__std") for c in columns]).crossJoin(stats)  # one row each
        return whole.select(F.lit(1).alias("__one"), *[F.col(f"{c}__median") for c in columns], *[scale(c).alias(f"{c}__scale") for c in columns])
    keys = by
    base = df.select(*by, *columns)
    medians = base.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).alias(f"{c}__median") for c in columns], *[F.stddev_pop(c).alias(f"{c}__std") for c in columns])
    spread = base.join(medians, keys).groupBy(*keys).agg(*[F.percentile(F.abs(F.col(c) - F.col(f"{c}__median")), F.lit(0.5)).alias(f"{c}__mad") for c in columns])
    return medians.join(spread, keys).select(*keys, *[F.col(f"{c}__median") for c in columns], *[scale(c).alias(f"{c}__scale") for c in columns])


def robust_z(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``df`` with ``{column}_z``, the distance from the median in robust standard deviations."""
    stats = robust_scale(df, columns, by)
    joined = df.join(stats, by) if by else df.crossJoin(stats.drop("__one"))  # one row of statistics
    return joined.withColumns({f"{c}_z": (F.col(c) - F.col(f"{c}__median")) / F.col(f"{c}__scale") for c in columns}).drop(*[f"{c}__{x}" for c in columns for x in ("median", "scale")])


def quality_rules(attributes: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """One row per finding: ``sample_id``, ``finding``, ``severity``, ``value``, ``threshold``, ``comparator``.

    A finding needs an absolute limit and, where it has one, a distance from the rest of the data.
    """
    z = robust_z(attributes, ["symbols", "digits", "word_length", "capitals"])
    median = one_row(attributes, {"median_chars": exact_quantiles(attributes, {"m": ("chars", 0.5)})["m"]})
    rel = F.lit(limits["min_chars_rel"]) * F.col("median_chars")

    def finding(name: str, when: Column, severity: Column | str, value: Column, threshold: Column | float, comparator: str) -> Column:
        sev = severity if isinstance(severity, Column) else F.lit(severity)
        return F.when(when, F.struct(F.lit(name).alias("finding"), sev.alias("severity"), F.round(value.cast("double"), 4).alias("value"), F.round((threshold if isinstance(threshold, Column) else F.lit(float(threshold))).cast("double"), 4).alias("threshold"), F.lit(comparator).alias("comparator")))

    c = F.col
    found = F.array(
        finding("too_short", c("chars") < limits["min_chars"], "high", c("chars"), limits["min_chars"], "<"),
        finding("too_short", (c("chars") >= limits["min_chars"]) & (c("chars") < rel), "medium", c("chars"), rel, "<"),
        finding("symbol_heavy", (c("symbols") > limits["symbols"]) & (c("symbols_z") > limits["symbols_z"]), F.when(c("symbols") > 2 * limits["symbols"], "high").otherwise("medium"), c("symbols"), limits["symbols"], ">"),
        finding("digit_heavy", (c("digits") > limits["digits"]) & (c("digits_z") > limits["digits_z"]), F.when(c("digits") > 2 * limits["digits"], "high").otherwise("medium"), c("digits"), limits["digits"], ">"),
        finding("repeated_lines", c("repeated") > limits["repeated"], "medium", c("repeated"), limits["repeated"], ">"),
        finding("unusual_word_length", F.abs(c("word_length_z")) > limits["word_length_z"], "low", c("word_length"), limits["word_length_z"], "|z|>"),
        finding("capital_heavy", (c("capitals") > limits["capitals"]) & (c("capitals_z") > limits["capitals_z"]), "medium", c("capitals"), limits["capitals"], ">"),
        finding("very_long", c("chars") > limits["max_chars_rel"] * F.col("median_chars"), "low", c("chars"), F.lit(limits["max_chars_rel"]) * F.col("median_chars"), ">"),
        finding("unbroken_text", c("word_length") > limits["unbroken"], "high", c("word_length"), limits["unbroken"], ">"),
        finding("mostly_repeated", c("repeated") > limits["repeated_high"], "high", c("repeated"), limits["repeated_high"], ">"),
        finding("no_letters", c("symbols") + c("digits") > limits["no_digits_symbols"], "high", c("symbols") + c("digits"), limits["no_digits_symbols"], ">"),
        finding("near_empty", c("words") < limits["empty_words"], "high", c("words"), limits["empty_words"], "<"),
    )
    return z.crossJoin(median).select("sample_id", F.explode(F.array_compact(found)).alias("f")).select("sample_id", "f.*")


def escalate(findings: DataFrame) -> DataFrame:
    """``findings`` and, for samples with two or more medium ones, a high ``multiple_quality_concerns``."""
    extra = findings.filter("severity = 'medium'").groupBy("sample_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("finding")), ",").alias("kinds")).filter("n >= 2")
    more = extra.select("sample_id", F.lit("multiple_quality_concerns").alias("finding"), F.lit("high").alias("severity"), F.col("n").cast("double").alias("value"), F.lit(2.0).alias("threshold"), F.lit(">=").alias("comparator"), "kinds")
    return findings.withColumn("kinds", F.lit(None).cast("string")).unionByName(more)


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts of equal-width bins from ``low`` to ``high``; the last bin holds its right edge, values outside are left out."""
    b = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(column).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def cues(attributes: DataFrame) -> DataFrame:
    """Categorical cues that are no content, as rows ``sample_id``, ``label``, ``split``, ``cue``, ``value``; cues of one value are left out."""
    size = F.when(F.col("chars") < 500, "short").when(F.col("chars") < 2000, "medium").otherwise("long")
    marks = F.when(F.col("symbols") < 0.02, "low").when(F.col("symbols") < 0.05, "some").otherwise("high")
    capital = F.when(F.col("capitals") < 0.02, "low").otherwise("high")
    digit = F.when(F.col("digits") < 0.005, "low").when(F.col("digits") < 0.02, "some").otherwise("high")
    again = F.when(F.col("repeated") > 0, "some").otherwise("none")
    word = F.when(F.col("word_length") < 5, "short").when(F.col("word_length") < 6.5, "medium").otherwise("long")
    number = F.when(F.col("words") < 100, "few").when(F.col("words") < 400, "some").otherwise("many")
    style = F.concat_ws("-", marks, capital)
    pairs = F.array(*[F.struct(F.lit(n).alias("cue"), v.alias("value")) for n, v in (("source", F.col("source")), ("length", size), ("marks", marks), ("capitals", capital), ("digits", digit), ("repetition", again), ("word_length", word), ("words", number), ("style", style))])
    long = attributes.select("sample_id", "label", "split", F.explode(pairs).alias("p")).select("sample_id", "label", "split", "p.cue", "p.value")
    varied = long.groupBy("cue").agg(F.countDistinct("value").alias("k")).filter("k > 1").select("cue")
    return long.join(varied, "cue", "left_semi")


def capture_conditions(attributes: DataFrame) -> DataFrame:
    """Boolean conditions of each sample."""
    return attributes.select("sample_id", "label", "split", (F.col("chars") < 200).alias("short"), (F.col("digits") > 0.02).alias("numeric"), (F.col("symbols") > 0.05).alias("marked"), (F.col("repeated") > 0).alias("repetitive"), (F.col("capitals") > 0.05).alias("shouting"), (F.col("chars") > 5000).alias("long"), (F.col("word_length") > 6.5).alias("wordy"))


#: Personal content in texts: kind and pattern.
PRIVACY = {
    "email": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+",
    "ip_address": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "phone": r"\+[0-9][0-9 -]{7,}[0-9]",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
}


def privacy_scan(samples: DataFrame) -> DataFrame:
    """``sample_id``, ``kind`` and ``n`` of patterns of personal content that occur."""
    text = F.coalesce("text", F.lit(""))
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count(text, F.lit(p)).cast("bigint").alias("n")) for k, p in PRIVACY.items()])
    return samples.select("sample_id", F.explode(found).alias("f")).select("sample_id", "f.*").filter("n > 0")
