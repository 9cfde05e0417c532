"""Exact quantiles of whole columns by selection with range histograms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

BINS = 1024


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> dict[str, float | None]:
    """The quantiles ``wanted`` (name: column and share), interpolated between neighbours as SQL's ``percentile_cont`` does.

    A round counts, for each value still sought, how many rows lie in each of ``BINS`` bins between
    the bounds known for it, with the least and largest row of each bin. The bin that holds the
    sought rank gives the next bounds, until they meet. A round is one aggregation that is combined
    before the shuffle: nothing is sorted, and no task holds more than the bins of the values
    sought. Equal or nearly equal columns need one round, others some three. Nulls and NaN are left
    out; a column of nothing else gives None.
    """
    columns = sorted({c for c, _ in wanted.values()})
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns}
    rows = df.select(*[value[c].alias(f"v{i}") for i, c in enumerate(columns)])
    at = {c: f"v{i}" for i, c in enumerate(columns)}
    bounds = rows.agg(*[f(at[c]).alias(f"{n}{at[c]}") for c in columns for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    sought: dict[tuple[str, int], list] = {}  # column and rank: rank among the rows within bounds, and the bounds
    for c, q in wanted.values():
        n = bounds[f"n{at[c]}"]
        for rank in {math.floor(q * (n - 1)), math.ceil(q * (n - 1))} if n else ():
            sought[c, rank] = [rank, bounds[f"lo{at[c]}"], bounds[f"hi{at[c]}"]]
    while open_ := [k for k, (_, lo, hi) in sought.items() if lo < hi]:
        for k, row in _round(rows, at, {k: sought[k] for k in open_}).items():
            sought[k] = row
    out = {}
    for name, (c, q) in wanted.items():
        n = bounds[f"n{at[c]}"]
        if not n:
            out[name] = None
            continue
        low, high = sought[c, math.floor(q * (n - 1))][1], sought[c, math.ceil(q * (n - 1))][1]
        out[name] = low + (high - low) * (q * (n - 1) - math.floor(q * (n - 1))) if high > low else low
    return out


def _round(rows: DataFrame, at: dict[str, str], sought: dict[tuple[str, int], list]) -> dict[tuple[str, int], list]:
    """The same with narrower bounds."""
    keys = list(sought)

    def placed(i: int):
        (c, _), (_, lo, hi) = keys[i], sought[keys[i]]
        v = F.col(at[c])
        # Halves don't overflow; the bins follow the order of the values even where they are rounded.
        share = (v / 2 - F.lit(lo / 2)) / F.lit(max(hi / 2 - lo / 2, 5e-324))
        bin_ = F.when(v == F.lit(hi), BINS).otherwise(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(share * BINS)))).cast("int")
        return F.when((v >= F.lit(lo)) & (v <= F.lit(hi)), F.struct(F.lit(i).alias("i"), bin_.alias("bin"), v.alias("v")))

    counted = rows.select(F.explode(F.array_compact(F.array(*[placed(i) for i in range(len(keys))]))).alias("x")).groupBy("x.i", "x.bin").agg(F.count("*").alias("n"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi"))
    out, passed = {}, dict.fromkeys(range(len(keys)), 0)
    for r in sorted(counted.collect(), key=lambda r: (r["i"], r["bin"])):  # BINS + 1 rows for each value sought
        rank = sought[keys[r["i"]]][0]
        if passed[r["i"]] <= rank < passed[r["i"]] + r["n"]:
            out[keys[r["i"]]] = [rank - passed[r["i"]], r["lo"], r["hi"]]
        passed[r["i"]] += r["n"]
    return out


def one_row(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """``values`` as a table of one row."""
    return df.sparkSession.createDataFrame([Row(**values)], ", ".join(f"`{k}` double" for k in values))
