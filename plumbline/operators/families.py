"""Exact duplicate families, leakage between splits, contamination, and version comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize
from plumbline.operators.graph import connected_components

REAL_SPLITS = ("train", "val", "test")
EVAL_SPLITS = ("val", "test")


def normal_text(text: str = "text") -> Column:
    """Trimmed, lower-cased, runs of blanks made one."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", ""), r"[ \t\r\n]+", " "))


def content_hash(samples: DataFrame) -> DataFrame:
    """``raw_sha``: of the text; ``norm_sha``: of ``normal_text``."""
    return samples.withColumns({"raw_sha": F.sha2("text", 256), "norm_sha": F.sha2(normal_text(), 256)})


def star_edges(hashed: DataFrame, key: str = "norm_sha") -> DataFrame:
    """An edge from every member of a hash group to the group's smallest id: the same families as all pairs, in linear size."""
    least = hashed.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("sample_id").alias("root"), F.count("*").alias("size")).filter("size > 1")
    return hashed.join(least, key).filter("sample_id <> root").select(F.col("root").alias("a"), F.col("sample_id").alias("b"), F.when(F.lit(key == "raw_sha"), "exact").otherwise("normalized").alias("relation"))


def exact_families(hashed: DataFrame, key: str = "norm_sha") -> DataFrame:
    """Groups of equal content: ``family_id`` (smallest id), size, pairs (n (n - 1) / 2), distinct labels and raw contents, splits."""
    return (
        hashed.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.min("sample_id").alias("family_id"),
            F.count("*").alias("size"),
            F.countDistinct("label").alias("n_labels"),
            F.countDistinct("raw_sha").alias("n_raw"),
            F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"),
        )
        .filter("size > 1")
        .withColumn("pairs", F.expr("size * (size - 1) div 2"))
        .drop(key)
    )


def family_leaks(hashed: DataFrame, key: str = "norm_sha") -> DataFrame:
    """Families over two or more real splits, with kind and risk by the worst relation across splits.

    Byte-identical copies across splits are ``exact_cross_split`` (critical if test is touched,
    else high); copies equal after normalisation only are ``transformed_cross_split`` (high or
    medium). Counts per raw content and split stand in for the edges, so no pairs are made.
    """
    per_raw = hashed.filter(F.col(key).isNotNull() & F.col("split").isin(*REAL_SPLITS)).groupBy(key, "raw_sha").agg(
        F.count("*").alias("n"), F.min("sample_id").alias("least"), F.collect_set("split").alias("s"), F.collect_set("label").alias("l"), F.count_if(F.col("split").isin(*EVAL_SPLITS)).alias("n_eval")
    )
    splits, labels = F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))), F.array_distinct(F.flatten(F.collect_list("l")))
    exact = F.bool_or(F.size("s") > 1)
    exact_test = F.bool_or((F.size("s") > 1) & F.array_contains("s", "test"))
    fam = per_raw.groupBy(key).agg(F.min("least").alias("family_id"), F.sum("n").alias("size"), splits.alias("sp"), labels.alias("lb"), F.sum("n_eval").alias("n_eval"), exact.alias("exact"), exact_test.alias("exact_test"))
    test = F.array_contains("sp", "test")
    return fam.filter(F.size("sp") >= 2).select(
        "family_id",
        "size",
        F.array_join("sp", ",").alias("splits"),
        F.when(F.col("exact"), "exact_cross_split").otherwise("transformed_cross_split").alias("kind"),
        F.when(F.col("exact") & test, "critical").when(F.col("exact"), "high").when(test, "high").otherwise("medium").alias("risk"),
        (F.size("lb") > 1).alias("label_conflict"),
        "n_eval",
    )


def split_integrity(hashed: DataFrame, key: str = "raw_sha") -> DataFrame:
    """For each evaluation split: samples, samples whose content is in train, fraction, and train classes missing."""
    train = hashed.filter("split = 'train'").select(key).distinct()
    ev = hashed.filter(F.col("split").isin(*EVAL_SPLITS))
    marked = ev.join(train.withColumn("hit", F.lit(1)), key, "left")
    counts = marked.groupBy("split").agg(F.count("*").alias("n"), F.count("hit").alias("exact_in_train"))
    classes = hashed.filter("split = 'train'").select("label").distinct()
    missing = ev.select("split", "label").distinct().join(classes, "label", "left_anti").groupBy("split").agg(F.count("*").alias("classes_missing_from_train"))
    return counts.join(missing, "split", "left").select("split", "n", "exact_in_train", F.round(F.col("exact_in_train") / F.col("n"), 6).alias("fraction"), F.coalesce("classes_missing_from_train", F.lit(0)).alias("classes_missing_from_train"))


def contamination_exact(src: DataFrame, ref: DataFrame) -> DataFrame:
    """For each source row the smallest reference row of equal raw content, else of equal normalised content."""
    by = lambda key, out: ref.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("sample_id").alias(out))
    both = src.join(by("raw_sha", "r"), "raw_sha", "left").join(by("norm_sha", "n"), "norm_sha", "left")
    return both.filter("coalesce(r, n) is not null").select("sample_id", "split", F.coalesce("r", "n").alias("ref_id"), F.when(F.col("r").isNotNull(), "exact").otherwise("normalized").alias("relation"))


def contamination_contains(samples: DataFrame, passages: DataFrame, width: int = 8) -> DataFrame:
    """Samples that hold a passage verbatim: ``sample_id``, ``item_id``.

    The inner words of a passage (all but its first and last, which may be parts of longer words in
    a text), ``width`` of them at most, are an equi-join key against the word windows of all texts;
    what meets is checked by substring search. Passages of fewer than three words have no inner
    word and are compared with every text.
    """
    blank = r"[ \t\r\n]+"
    cut = passages.filter("text is not null and text <> ''").withColumn("w", F.split("text", blank)).withColumn("k", F.least(F.size("w") - 2, F.lit(width)))
    numbers = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    keys = cut.filter("k > 0").select("item_id", F.col("text").alias("passage"), "k", F.xxhash64(F.slice(numbers(F.col("w")), F.lit(2), F.col("k"))).alias("key"))
    texts = samples.filter("text is not null").select("sample_id", "text")
    words = texts.select("sample_id", numbers(F.split("text", blank)).alias("w"))
    found = []
    for k in sorted(r["k"] for r in keys.select("k").distinct().collect()):  # at most ``width`` numbers
        inner = F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.xxhash64(F.slice("w", i, F.lit(k))))  # noqa: B023
        windows = words.filter(F.size("w") >= k).select("sample_id", F.explode(F.array_distinct(inner)).alias("key"))
        found.append(windows.join(keys.filter(F.col("k") == k), "key").select("sample_id", "item_id", "passage"))
    short = cut.filter("k <= 0").select("item_id", F.col("text").alias("passage"))
    if not short.isEmpty():
        found.append(texts.crossJoin(short).filter(F.contains("text", F.col("passage"))).select("sample_id", "item_id", "passage"))
    if not found:
        return texts.limit(0).select("sample_id").crossJoin(passages.limit(0).select("item_id"))
    met = found[0]
    for f in found[1:]:
        met = met.unionByName(f)
    return met.join(texts, "sample_id").filter(F.contains("text", F.col("passage"))).select("sample_id", "item_id").distinct()


def version_match(a: DataFrame, b: DataFrame, key: str = "raw_sha") -> DataFrame:
    """Contents of two versions: label and split sets of each, and whether added, removed or common."""
    side = lambda df, p: df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias(f"{p}_labels"), F.array_join(F.array_sort(F.collect_set("split")), ",").alias(f"{p}_splits"))
    both = side(a, "a").join(side(b, "b"), key, "full_outer")
    return both.withColumn("status", F.when(F.col("a_labels").isNull(), "added").when(F.col("b_labels").isNull(), "removed").otherwise("common"))


def family_signatures(hashed: DataFrame, key: str = "norm_sha") -> DataFrame:
    """A signature of each duplicate family: the hash of its sorted distinct contents."""
    groups = hashed.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("raw_sha")).alias("m")).filter("n > 1")
    return groups.select(F.sha2(F.array_join("m", ","), 256).alias("signature")).distinct()


def group_signatures(members: DataFrame, by: str, content: str = "raw_sha") -> DataFrame:
    """``by`` and ``signature``, which tells what different contents (SHA-256 in hex) a group has, whatever it is called and in any order.

    Number, sum and exclusive or of 60 bits of each content: partial aggregates, so no group is
    gathered however large it is.
    """
    x = F.conv(F.substring(content, 1, 15), 16, 10).cast("bigint")
    own = members.select(by, content).distinct().groupBy(by).agg(F.count("*").alias("__n"), F.sum(x.cast("decimal(38,0)")).alias("__s"), F.bit_xor(x).alias("__x"))
    return own.select(by, F.concat_ws("-", "__n", "__s", "__x").alias("signature"))


def version_groups(hashed: DataFrame, near: DataFrame) -> DataFrame:
    """Groups of two samples or more of one version: ``kind`` (family, leak, label_conflict), ``signature``, ``n``; a group has one row for each kind that fits.

    ``near`` links contents (``a``, ``b``: ``norm_sha``), not samples, so a link holds for whatever
    samples have the contents in this version, and goes if one of them has none. Samples of equal
    content are a group without any link. Samples without content take no part.
    """
    some = hashed.filter("norm_sha is not null").select("sample_id", "norm_sha", "raw_sha", "split", "label")
    here = some.select("norm_sha").distinct()
    links = near.join(here.withColumnRenamed("norm_sha", "a"), "a", "left_semi").join(here.withColumnRenamed("norm_sha", "b"), "b", "left_semi")
    joined = connected_components(links, "a", "b").select(F.col("node").alias("norm_sha"), "component")
    grouped = materialize(some.join(joined, "norm_sha", "left").withColumn("group", F.coalesce("component", "norm_sha")), "version-groups")
    crosses = lambda c: F.min(c) < F.max(c)
    sizes = grouped.groupBy("group").agg(F.count("*").alias("n"), crosses("split").alias("leak"), crosses("label").alias("conflict")).filter("n > 1")
    kinds = F.array_compact(F.array(F.lit("family"), F.when(F.col("leak"), "leak"), F.when(F.col("conflict"), "label_conflict")))
    return sizes.join(group_signatures(grouped, "group"), "group").select(F.explode(kinds).alias("kind"), "signature", "n")


def findings_between(before: DataFrame, after: DataFrame, near: DataFrame) -> DataFrame:
    """``kind``, ``signature``, ``status`` (new, resolved, persisting), ``n_before`` and ``n_after`` of the groups of two versions.

    A group persists if a group of the same different contents is there in the other version, even
    if its samples, their ids or numbers of copies have changed; one that gains or loses a content
    is resolved under the old signature and new under the new one.
    """
    side = lambda v, n: version_groups(v, near).withColumnRenamed("n", n)
    both = side(before, "n_before").join(side(after, "n_after"), ["kind", "signature"], "full_outer")
    return both.select("kind", "signature", F.when(F.col("n_before").isNull(), "new").when(F.col("n_after").isNull(), "resolved").otherwise("persisting").alias("status"), "n_before", "n_after")


def export_clean(samples: DataFrame, final: DataFrame) -> DataFrame:
    """The cleaned version: removed samples go, relabelled ones move, and of samples that would have one name all but the first get a suffix of content and id.

    ``final`` has ``sample_id``, ``action`` (keep, remove, relabel) and ``target``. Names are few and
    shared by many samples, so the first of each is an aggregate, not the head of a sorted group.
    """
    kept = samples.join(final.select("sample_id", "action", "target"), "sample_id", "left").filter("coalesce(action, 'keep') <> 'remove'")
    label = F.when(F.col("action") == "relabel", F.col("target")).otherwise(F.col("label"))
    named = kept.select("sample_id", "split", label.alias("label"), F.coalesce("action", F.lit("keep")).alias("action"), F.substring("raw_sha", 1, 8).alias("sha8"), "raw_sha", F.concat_ws("/", "split", label, F.concat(F.col("source"), F.lit(".txt"))).alias("path"))
    first = named.groupBy("path").agg(F.min("sample_id").alias("first"))
    suffixed = F.regexp_replace("path", r"\.txt$", F.concat_ws("-", F.lit(""), F.coalesce("sha8", F.lit("")), F.concat(F.col("sample_id").cast("string"), F.lit(".txt"))))
    return named.join(first, "path").withColumn("path", F.when(F.col("sample_id") == F.col("first"), F.col("path")).otherwise(suffixed)).drop("sha8", "first")
