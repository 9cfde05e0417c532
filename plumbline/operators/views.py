"""Listed views of findings and cases: filters, order, a page, and the total of what fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(rows: DataFrame, equals: dict[str, list] | None = None, contains: dict[str, str] | None = None, like: dict[str, str] | None = None) -> DataFrame:
    """The rows whose columns have one of the given values, whose array columns hold a value, and whose texts hold a part (upper and lower case alike)."""
    tests = [F.col(c).isin(v) for c, v in (equals or {}).items()]
    tests += [F.array_contains(c, v) for c, v in (contains or {}).items()]
    tests += [F.contains(F.lower(c), F.lit(v.lower())) for c, v in (like or {}).items()]
    return rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows


def page(rows: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of ``rows`` in an order that leaves no ties, with ``total``, the number of rows on all pages."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(total)  # one row


def facets(rows: DataFrame, *columns: str) -> DataFrame:
    """Counts by each column alone: ``facet``, ``value``, ``n``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def risk_rank(risk: str = "risk") -> Column:
    return F.when(F.col(risk) == "critical", 3).when(F.col(risk) == "high", 2).when(F.col(risk) == "medium", 1).otherwise(0)


#: Orders of listed cases; the case number settles ties.
CASE_SORTS = {
    "priority": ("-priority",),
    "impact": ("-impact", "-priority"),
    "newest": ("-updated_at",),
    "uncertainty": ("-doubt", "-priority"),
    "case": (),
    "class": ("label", "-priority"),
    "name": ("path",),
}
SAMPLE_SORTS = {"path": (), "suspicion": ("-suspicion",), "priority": ("-priority",)}


def _ordered(names: tuple[str, ...], tie: str) -> list[Column]:
    """Columns to sort by, rising or (with a minus) falling; nulls come last."""
    return [*(F.desc_nulls_last(n[1:]) if n[0] == "-" else F.asc_nulls_last(n) for n in names), F.asc(tie)]


def list_cases(cases: DataFrame, filters: dict[str, object] | None = None, search: str | None = None, sort: str = "priority", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of cases, with ``total``.

    ``cases``: case_no, verdict, status, categories, codes, label, split, uncertainty, family_id,
    path, sha, priority, impact, updated_at. ``filters`` may name verdict (one or a list), status,
    category, reason_code, label, split, uncertainty and family_id. A ``search`` of digits is a case
    number; another is a part of the path, upper and lower case alike, or a whole hash. An unknown
    filter is an error, an unknown ``sort`` is by priority. Uncertainty is sorted high, medium, low.
    """
    wanted = dict(filters or {})
    has = {"categories": wanted.pop("category", None), "codes": wanted.pop("reason_code", None)}
    if unknown := set(wanted) - {"verdict", "status", "label", "split", "uncertainty", "family_id"}:
        raise ValueError(f"no such filter: {', '.join(sorted(unknown))}")
    rows = matching(cases, {c: v if isinstance(v, list) else [v] for c, v in wanted.items() if v is not None}, {c: v for c, v in has.items() if v is not None})
    if search:
        rows = rows.filter(F.col("case_no") == int(search) if search.isdigit() else F.contains(F.lower("path"), F.lit(search.lower())) | (F.col("sha") == search.lower()))
    doubt = F.when(F.col("uncertainty") == "high", 2).when(F.col("uncertainty") == "medium", 1).when(F.col("uncertainty") == "low", 0)
    shown = page(rows.withColumn("doubt", doubt), _ordered(CASE_SORTS.get(sort, CASE_SORTS["priority"]), "case_no"), limit, offset)
    return shown.drop("doubt")


#: Findings that samples can be listed by, and the column of ``list_samples`` that has them; other names are quality findings.
FINDINGS = {"label": "has_label_finding", "duplicate": "in_family", "leakage": "leaks", "privacy": "private"}


def list_samples(samples: DataFrame, label: str | None = None, split: str | None = None, finding: str | None = None, verdict: str | None = None, search: str | None = None, sort: str = "path", limit: int = 60, offset: int = 0) -> DataFrame:
    """A page of samples, with ``total``.

    ``samples``: path, sha, label, split, verdict, suspicion, priority, the booleans of ``FINDINGS``,
    and ``quality`` (array of the names of quality findings). A ``search`` is a part of the path or
    a whole hash. Ties go by path.
    """
    if sort not in SAMPLE_SORTS:
        raise ValueError(f"no such order: {sort}")
    rows = matching(samples, {c: [v] for c, v in (("label", label), ("split", split), ("verdict", verdict)) if v is not None})
    if finding is not None:
        rows = rows.filter(F.coalesce(F.col(FINDINGS[finding]), F.lit(False)) if finding in FINDINGS else F.coalesce(F.array_contains("quality", finding), F.lit(False)))
    if search:
        rows = rows.filter(F.contains(F.lower("path"), F.lit(search.lower())) | (F.col("sha") == search.lower()))
    return page(rows, _ordered(SAMPLE_SORTS[sort], "path"), limit, offset)
