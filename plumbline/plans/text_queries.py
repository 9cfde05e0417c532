"""Queries over ``documents``, ``labels`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import written_once
from plumbline.operators import families, near_text, profile, shortcuts
from plumbline.operators.graph import connected_components
from plumbline.operators.ranges import ranked
from plumbline.sources.bindings import SQL_TEXT, text_samples
from plumbline.sources.layout import assign_layout
from plumbline.sources.tables import table


def _hashed(spark, d):
    """Samples with the hashes and the length of their content, without the texts; written once, since most audits read them."""
    return written_once(spark, d, "hashed", lambda: families.content_hash(text_samples(spark, d)).withColumn("text_chars", F.length("text")).drop("text"))


def _attributes(spark, d):
    """Numbers measured on the texts; written once, since most audits read them."""
    return written_once(spark, d, "attributes", lambda: profile.text_attributes(text_samples(spark, d)).drop("text"))


def version_stats(spark: SparkSession, d: str) -> DataFrame:
    s = _hashed(spark, d)
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long")
    dims = F.array(*[F.struct(F.lit(n).alias("dimension"), v.alias("bucket")) for n, v in (("split", F.col("split")), ("class", F.col("label")), ("source", F.col("source")), ("size", size), ("class_split", F.concat_ws("/", "label", "split")))])
    return s.select(F.explode(dims).alias("x"), "raw_sha", "n_chars").groupBy("x.dimension", "x.bucket").agg(F.count("*").alias("n"), F.countDistinct("raw_sha").alias("n_distinct"), F.round(F.percentile("n_chars", F.lit(0.5)), 4).alias("median_chars"), F.sum("n_chars").alias("total_chars"))


def class_balance(spark, d):
    c = text_samples(spark, d).groupBy("label").count()
    return c.agg(F.count("*").alias("classes"), F.max("count").alias("largest"), F.min("count").alias("smallest"), F.round(F.max("count") / F.min("count"), 6).alias("imbalance"))


def layout_assign(spark, d):
    doc = table(spark, d, "documents")
    folder = F.when(F.col("doc_id") % 10 < 7, "Train").when(F.col("doc_id") % 10 < 8, "valid").otherwise("testing")
    paths = doc.select(F.concat_ws("/", F.lit("corpus"), folder, "lang", F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    return assign_layout(paths).select("path", "split", "label")


def content_hash(spark, d):
    return _hashed(spark, d).select("sample_id", "raw_sha", "norm_sha")


def sample_index(spark, d):
    """A gapless index from 0 by path (label, source, id), and the class's number by name."""
    s = text_samples(spark, d).select("sample_id", F.concat_ws("/", F.coalesce("label", F.lit("")), F.coalesce("source", F.lit("")), F.lpad(F.col("sample_id").cast("string"), 12, "0")).alias("path"), "label")
    classes = ranked(s.select("label").distinct(), [F.col("label")]).select("label", (F.col("rk") - 1).alias("class_index"))
    return ranked(s, [F.col("path")]).join(classes, "label", "left").select("sample_id", "path", (F.col("rk") - 1).cast("bigint").alias("idx"), F.col("class_index").cast("bigint").alias("class_index"))


def robust_z(spark, d):
    z = profile.robust_z(_attributes(spark, d), ["chars", "symbols"])
    return z.select("sample_id", F.round("chars_z", 6).alias("chars_z"), F.round("symbols_z", 6).alias("symbols_z"))


def attribute_deviation(spark, d):
    z = profile.robust_z(_attributes(spark, d), ["chars", "symbols", "digits"], ["label"])
    return z.select("sample_id", F.round(F.greatest(*[F.abs(F.col(f"{c}_z")) for c in ("chars", "symbols", "digits")]), 6).alias("deviation"))


def quality_rules(spark, d):
    return profile.quality_rules(_attributes(spark, d))


def quality_escalate(spark, d):
    return profile.escalate(quality_rules(spark, d))


def quality_facets(spark, d):
    return quality_escalate(spark, d).groupBy("finding", "severity").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("samples"))


def histograms(spark, d):
    a = _attributes(spark, d)
    parts = [profile.histogram(a, c, 20, lo, hi).withColumn("attribute", F.lit(c)) for c, lo, hi in (("symbols", 0.0, 0.2), ("capitals", 0.0, 0.2), ("word_length", 0.0, 20.0))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def exact_families(spark, d):
    return families.exact_families(_hashed(spark, d))


def dup_pairs(spark, d):
    h = _hashed(spark, d)
    return families.star_edges(h, "raw_sha").unionByName(families.star_edges(h, "norm_sha"))


def _near(spark, d):
    """Near pairs of different texts, classified."""
    h = near_text.representatives(_hashed(spark, d))
    pairs = written_once(spark, d, "near-pairs", lambda: near_text.near_pairs(_different(spark, d, h)))
    return near_text.classify_pairs(pairs, h)


def _different(spark, d, first):
    """The normalised texts of the rows of ``first``."""
    return text_samples(spark, d).select("sample_id", families.normal_text().alias("text")).join(first.select("sample_id"), "sample_id", "left_semi")


def _near_links(spark, d):
    """Links that connect the same different texts as all near pairs do."""
    return written_once(spark, d, "near-links", lambda: near_text.near_connections(_different(spark, d, near_text.representatives(_hashed(spark, d)))))


def near_pairs(spark, d):
    """Texts that share four fifths of their five-word shingles or more, compared whole."""
    return _near(spark, d).select("a", "b", F.round("jaccard", 4).alias("jaccard"), F.round("size_ratio", 4).alias("size_ratio"), "relation")


def families_components(spark, d):
    """Families as components of copies and near copies."""
    links = families.star_edges(_hashed(spark, d), "norm_sha").select("a", "b").unionByName(_near_links(spark, d).select("a", "b"))
    return connected_components(links, "b", "a").select(F.col("node").alias("sample_id"), F.col("component").alias("family_id"))


def family_leaks(spark, d):
    return families.family_leaks(_hashed(spark, d))


def split_integrity_exact(spark, d):
    return families.split_integrity(_hashed(spark, d))


def contamination_exact(spark, d):
    h = _hashed(spark, d)
    return families.contamination_exact(h.filter("split = 'test'"), h.filter("split = 'train'"))


def contamination_contains(spark, d):
    return families.contamination_contains(text_samples(spark, d), table(spark, d, "benchmark"))


def _versions(spark, d):
    h = _hashed(spark, d)
    return h.filter("sample_id % 5 <> 0"), h.filter("sample_id % 5 <> 1")


def version_diff(spark, d):
    a, b = _versions(spark, d)
    content = families.version_match(a, b).groupBy("status").agg(F.count("*").alias("n"))
    fa, fb = families.family_signatures(a), families.family_signatures(b)
    fam = fa.withColumn("a", F.lit(1)).join(fb.withColumn("b", F.lit(1)), "signature", "full_outer").select(F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "resolved").otherwise("persisting").alias("status"))
    return content.withColumn("kind", F.lit("content")).unionByName(fam.groupBy("status").agg(F.count("*").alias("n")).withColumn("kind", F.lit("family")))


def label_split_changes(spark, d):
    a, b = _versions(spark, d)
    m = families.version_match(a, b).filter("status = 'common' and (a_labels <> b_labels or a_splits <> b_splits)")
    return m.select("raw_sha", "a_labels", "b_labels", "a_splits", "b_splits")


def capture_conditions(spark, d):
    c = profile.capture_conditions(_attributes(spark, d))
    return c.groupBy("label").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(x).cast("double")), 6).alias(f"{x}_share") for x in ("short", "numeric", "marked", "repetitive", "shouting", "long", "wordy")])


def condition_gaps(spark, d):
    return shortcuts.condition_gaps(profile.capture_conditions(_attributes(spark, d)), other_min=0.06, class_max=0.1)


def underrepresented(spark, d):
    return shortcuts.underrepresented(text_samples(spark, d), relative=1.5)


def cramers_v(spark, d):
    return shortcuts.cramers_v(profile.cues(_attributes(spark, d)).filter("split = 'train'"))


def shortcut_findings(spark, d):
    """The cues of the texts and a planted one (a frame that 85 % of one language have), at the operator's own thresholds."""
    a = _attributes(spark, d)
    frame = F.when((F.col("label") == "de") & (F.col("sample_id") % 20 < 17) | (F.col("sample_id") % 20 == 19), "thick").otherwise("none")
    planted = a.select("sample_id", "label", "split", F.lit("frame").alias("cue"), frame.alias("value"))
    return shortcuts.shortcut_findings(profile.cues(a).unionByName(planted))


def privacy_patterns(spark, d):
    return profile.privacy_scan(text_samples(spark, d))


def dna_profile(spark, d):
    return shortcuts.dna_profile(_attributes(spark, d)).withColumn("share", F.round("share", 6))


def dna_drift(spark, d):
    a = _attributes(spark, d)
    return shortcuts.dna_drift(shortcuts.dna_profile(a.filter("sample_id % 5 <> 0")), shortcuts.dna_profile(a.filter("sample_id % 5 <> 1")))


def list_samples(spark, d):
    """Samples with a medium or high finding, largest first, third page of 20."""
    bad = quality_rules(spark, d).filter("severity in ('medium', 'high')").select("sample_id").distinct()
    s = text_samples(spark, d).filter("source ilike 'SRC1%'").join(bad, "sample_id", "left_semi")
    return s.select("sample_id", "label", "split", "n_chars").orderBy(F.desc_nulls_last("n_chars"), "sample_id").offset(4).limit(20)


def quality_labels(spark, d):
    """Findings against the quality labels: precision and recall of 'any medium or high finding'."""
    truth = table(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), (F.col("quality") == 0).alias("bad"))
    found = quality_rules(spark, d).filter("severity in ('medium', 'high')").select("sample_id").distinct().withColumn("hit", F.lit(True))
    j = truth.join(found, "sample_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    tp, hits, bad = F.count_if(F.col("bad") & F.col("hit")), F.count_if("hit"), F.count_if("bad")
    return j.agg(tp.alias("true_positives"), hits.alias("found"), bad.alias("planted"), F.round(tp / F.greatest(hits, F.lit(1)), 6).alias("precision"), F.round(tp / F.greatest(bad, F.lit(1)), 6).alias("recall"))


QUERIES = {f.__name__: f for f in (version_stats, class_balance, layout_assign, content_hash, sample_index, robust_z, attribute_deviation, quality_rules, quality_escalate, quality_facets, histograms, exact_families, dup_pairs, near_pairs, families_components, family_leaks, split_integrity_exact, contamination_exact, contamination_contains, version_diff, label_split_changes, capture_conditions, condition_gaps, underrepresented, cramers_v, shortcut_findings, privacy_patterns, dna_profile, dna_drift, list_samples, quality_labels)}

_W = r"[^ \t\r\n]+"
HASHED = SQL_TEXT + r""", hashed as (select *, sha256(text) as raw_sha, sha256(lower(regexp_replace(regexp_replace(text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '[ \t\r\n]+', ' ', 'g'))) as norm_sha from samples)"""
NEAR = HASHED + r""", reps as (select sample_id, list_filter(string_split(lower(regexp_replace(regexp_replace(text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '[ \t\r\n]+', ' ', 'g')), ' '), lambda x: x <> '') as w from hashed where norm_sha is not null qualify row_number() over (partition by norm_sha order by sample_id) = 1),
 sh as (select distinct sample_id, array_to_string(w[i:i + 4], ' ') as s from (select sample_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from reps where len(w) > 0)),
 sz as (select sample_id, count(*) as n from sh group by sample_id),
 cm as (select x.sample_id as a, y.sample_id as b, count(*) as c from sh x join sh y on x.s = y.s and x.sample_id < y.sample_id group by all),
 near as (select a, b, c / (m.n + k.n - c)::double as jaccard, least(m.n, k.n) / greatest(m.n, k.n)::double as size_ratio from cm join sz m on m.sample_id = a join sz k on k.sample_id = b where c / (m.n + k.n - c)::double >= 0.8 - 1e-9)"""
_COUNT = "len(regexp_extract_all(t, '{}'))"
ATTR = SQL_TEXT + rf""", a0 as (select *, coalesce(text, '') as t from samples),
a1 as (select *, length(t) as chars, {_COUNT.format(_W)} as words, list_filter(string_split(t, chr(10)), lambda x: x <> '') as lines from a0),
attrs as (select sample_id, label, source, split, n_chars, chars, words,
  case when words > 0 then length(regexp_replace(t, '[ \t\r\n]', '', 'g')) / words else 0.0 end as word_length,
  case when chars > 0 then {_COUNT.format("[!-/:-@[-`{-~]")} / chars else 0.0 end as symbols,
  case when chars > 0 then {_COUNT.format("[0-9]")} / chars else 0.0 end as digits,
  case when chars > 0 then {_COUNT.format("[A-Z]")} / chars else 0.0 end as capitals,
  case when len(lines) > 0 then 1 - len(list_distinct(lines)) / len(lines) else 0.0 end as repeated from a1)"""


def _z(cols, by=None, src="attrs"):
    over = f"partition by {by}" if by else ""
    med = ", ".join(f"quantile_cont({c}::double, 0.5) over ({over}) as {c}_m, stddev_pop({c}) over ({over}) as {c}_s" for c in cols)
    mad = ", ".join(f"quantile_cont(abs({c} - {c}_m), 0.5) over ({over}) as {c}_d" for c in cols)
    z = ", ".join(f"({c} - {c}_m) / case when {c}_d < 1e-9 then {c}_s + 1e-9 else 1.4826 * {c}_d end as {c}_z" for c in cols)
    return f"z as (select *, {z} from (select *, {mad} from (select *, {med} from {src})))"


QUALITY = ATTR + ", " + _z(["symbols", "digits", "word_length", "capitals"]) + """, m as (select quantile_cont(chars::double, 0.5) as mc from attrs), q as (
select sample_id, 'too_short' as finding, 'high' as severity, chars::double as value, 32.0 as threshold, '<' as comparator from attrs where chars < 32
union all select sample_id, 'too_short', 'medium', chars, 0.25 * mc, '<' from attrs, m where chars >= 32 and chars < 0.25 * mc
union all select sample_id, 'symbol_heavy', case when symbols > 0.4 then 'high' else 'medium' end, symbols, 0.2, '>' from z where symbols > 0.2 and symbols_z > 2.5
union all select sample_id, 'digit_heavy', case when digits > 0.2 then 'high' else 'medium' end, digits, 0.1, '>' from z where digits > 0.1 and digits_z > 2.5
union all select sample_id, 'repeated_lines', 'medium', repeated, 0.3, '>' from attrs where repeated > 0.3
union all select sample_id, 'unusual_word_length', 'low', word_length, 4.0, '|z|>' from z where abs(word_length_z) > 4
union all select sample_id, 'capital_heavy', 'medium', capitals, 0.3, '>' from z where capitals > 0.3 and capitals_z > 2.5
union all select sample_id, 'very_long', 'low', chars, 20.0 * mc, '>' from attrs, m where chars > 20.0 * mc
union all select sample_id, 'unbroken_text', 'high', word_length, 30.0, '>' from attrs where word_length > 30
union all select sample_id, 'mostly_repeated', 'high', repeated, 0.9, '>' from attrs where repeated > 0.9
union all select sample_id, 'no_letters', 'high', symbols + digits, 0.5, '>' from attrs where symbols + digits > 0.5
union all select sample_id, 'near_empty', 'high', words, 3.0, '<' from attrs where words < 3),
quality as (select sample_id, finding, severity, round(value, 4) as value, round(threshold, 4)::double as threshold, comparator from q),
escalated as (select *, null as kinds from quality union all
  select sample_id, 'multiple_quality_concerns', 'high', count(*)::double, 2.0, '>=', string_agg(distinct finding, ',' order by finding) from quality where severity = 'medium' group by sample_id having count(*) >= 2)"""
CUES = ATTR + """, long0 as (
select sample_id, label, split, 'source' as cue, source as value from attrs
union all select sample_id, label, split, 'length', case when chars < 500 then 'short' when chars < 2000 then 'medium' else 'long' end from attrs
union all select sample_id, label, split, 'marks', case when symbols < 0.02 then 'low' when symbols < 0.05 then 'some' else 'high' end from attrs
union all select sample_id, label, split, 'capitals', case when capitals < 0.02 then 'low' else 'high' end from attrs
union all select sample_id, label, split, 'digits', case when digits < 0.005 then 'low' when digits < 0.02 then 'some' else 'high' end from attrs
union all select sample_id, label, split, 'repetition', case when repeated > 0 then 'some' else 'none' end from attrs
union all select sample_id, label, split, 'word_length', case when word_length < 5 then 'short' when word_length < 6.5 then 'medium' else 'long' end from attrs
union all select sample_id, label, split, 'words', case when words < 100 then 'few' when words < 400 then 'some' else 'many' end from attrs
union all select sample_id, label, split, 'style', case when symbols < 0.02 then 'low' when symbols < 0.05 then 'some' else 'high' end || '-' || case when capitals < 0.02 then 'low' else 'high' end from attrs),
cues as (select * from long0 where cue in (select cue from long0 group by cue having count(distinct value) > 1))"""
CRAMER = """, {p}n as (select cue, count(*) as n, count(distinct value) as r, count(distinct label) as k from {src} group by cue),
{p}x as (select cue, value, count(*) as nx from {src} group by all), {p}y as (select cue, label, count(*) as ny from {src} group by all),
{p}xy as (select cue, value, label, count(*) as nxy from {src} group by all),
{p}phi as (select x.cue, sum(pow(coalesce(nxy, 0) - nx * ny / n::double, 2) / (nx * ny / n::double)) / any_value(n) as phi2, any_value(n) as n, any_value(r) as r, any_value(k) as k
  from {p}x x join {p}y y using (cue) join {p}n using (cue) left join {p}xy xy on xy.cue = x.cue and xy.value = x.value and xy.label = y.label group by x.cue),
{p}v as (select cue, n, case when r < 2 or k < 2 then 0.0 when least(k - pow(k - 1, 2) / greatest(1, n - 1), r - pow(r - 1, 2) / greatest(1, n - 1)) - 1 > 0
  then sqrt(greatest(0, phi2 - (k - 1) * (r - 1) / greatest(1, n - 1)::double) / (least(k - pow(k - 1, 2) / greatest(1, n - 1), r - pow(r - 1, 2) / greatest(1, n - 1)) - 1)) else 0.0 end as v from {p}phi)"""
CONDITIONS = ATTR + ", cond as (select sample_id, label, split, chars < 200 as short, digits > 0.02 as numeric, symbols > 0.05 as marked, repeated > 0 as repetitive, capitals > 0.05 as shouting, chars > 5000 as long, word_length > 6.5 as wordy from attrs)"
_NAMES = ("short", "numeric", "marked", "repetitive", "shouting", "long", "wordy")
DNA = """{p}dna as (select dimension, bucket, count(*) / (select count(*) from {src})::double as share from (
  select unnest([{{'dimension': 'class', 'bucket': label}}, {{'dimension': 'split', 'bucket': split}}, {{'dimension': 'source', 'bucket': source}},
  {{'dimension': 'size', 'bucket': case when chars < 500 then 'short' when chars < 2000 then 'medium' else 'long' end}},
  {{'dimension': 'word_length', 'bucket': cast(least(cast(floor(word_length) as integer), 19) as varchar)}}], recursive := true) from {src}) group by all)"""

ORACLES = {
    "version_stats": f"""with {HASHED}, x as (select unnest([{{'dimension': 'split', 'bucket': split}}, {{'dimension': 'class', 'bucket': label}}, {{'dimension': 'source', 'bucket': source}},
 {{'dimension': 'size', 'bucket': case when n_chars < 500 then 'short' when n_chars < 2000 then 'medium' else 'long' end}}, {{'dimension': 'class_split', 'bucket': label || '/' || split}}], recursive := true), raw_sha, n_chars from hashed)
 select dimension, bucket, count(*) as n, count(distinct raw_sha) as n_distinct, round(quantile_cont(n_chars::double, 0.5), 4) as median_chars, sum(n_chars)::bigint as total_chars from x group by all""",
    "class_balance": f"with {SQL_TEXT}, c as (select label, count(*) as n from samples group by label) select count(*) as classes, max(n) as largest, min(n) as smallest, round(max(n) / min(n)::double, 6) as imbalance from c",
    "layout_assign": """select 'corpus/' || case when doc_id % 10 < 7 then 'Train' when doc_id % 10 < 8 then 'valid' else 'testing' end || '/' || lang || '/' || source || '_' || doc_id || '.txt' as path,
 case when doc_id % 10 < 7 then 'train' when doc_id % 10 < 8 then 'val' else 'test' end as split, lang as label from documents""",
    "content_hash": f"with {HASHED} select sample_id, raw_sha, norm_sha from hashed",
    "sample_index": f"with {SQL_TEXT}, p as (select sample_id, label, concat_ws('/', coalesce(label, ''), coalesce(source, ''), lpad(sample_id::varchar, 12, '0')) as path from samples), c as (select label, row_number() over (order by label) - 1 as class_index from (select distinct label from samples)) select sample_id, path, row_number() over (order by path) - 1 as idx, class_index from p left join c using (label)",
    "robust_z": f"with {ATTR}, {_z(['chars', 'symbols'])} select sample_id, round(chars_z, 6) as chars_z, round(symbols_z, 6) as symbols_z from z",
    "attribute_deviation": f"with {ATTR}, {_z(['chars', 'symbols', 'digits'], 'label')} select sample_id, round(greatest(abs(chars_z), abs(symbols_z), abs(digits_z)), 6) as deviation from z",
    "quality_rules": f"with {QUALITY} select * from quality",
    "quality_escalate": f"with {QUALITY} select * from escalated",
    "quality_facets": f"with {QUALITY} select finding, severity, count(*) as n, count(distinct sample_id) as samples from escalated group by all",
    "histograms": f"with {ATTR} "
    + " union all ".join(f"select '{c}' as attribute, least(cast(floor(({c} - {lo}) / (({hi} - {lo}) / 20)) as integer), 19) as bin, count(*) as n from attrs where {c} between {lo} and {hi} group by all" for c, lo, hi in (("symbols", "0.0::double", "0.2::double"), ("capitals", "0.0::double", "0.2::double"), ("word_length", "0.0::double", "20.0::double"))),
    "exact_families": f"with {HASHED} select min(sample_id) as family_id, count(*) as size, count(distinct label) as n_labels, count(distinct raw_sha) as n_raw, string_agg(distinct split, ',' order by split) as splits, count(*) * (count(*) - 1) // 2 as pairs from hashed where norm_sha is not null group by norm_sha having count(*) > 1",
    "dup_pairs": f"with {HASHED} "
    + " union all ".join(f"select m as a, sample_id as b, '{r}' as relation from (select sample_id, min(sample_id) over (partition by {k}) as m from hashed where {k} is not null) where sample_id <> m" for k, r in (("raw_sha", "exact"), ("norm_sha", "normalized"))),
    "near_pairs": f"with {NEAR} select a, b, round(jaccard, 4) as jaccard, round(size_ratio, 4) as size_ratio, case when x.raw_sha = y.raw_sha then 'exact' when x.norm_sha = y.norm_sha then 'normalized' when size_ratio < 0.97 then 'resized' else 'near' end as relation from near join hashed x on x.sample_id = a join hashed y on y.sample_id = b",
    "families_components": f"""with recursive {NEAR}, e as (select min(sample_id) over (partition by norm_sha) as a, sample_id as b from hashed where norm_sha is not null union all select a, b from near),
 both_ as (select distinct a, b from e where a <> b union select b, a from e where a <> b),
 reach as (select distinct a as node, a as seen from both_ union select r.node, b.b from reach r join both_ b on r.seen = b.a)
 select node as sample_id, min(seen) as family_id from reach group by node""",
    "family_leaks": f"""with {HASHED}, r as (select norm_sha, raw_sha, count(distinct split) > 1 as x, bool_or(split = 'test') as t from hashed where norm_sha is not null group by all),
 f as (select norm_sha, min(sample_id) as family_id, count(*) as size, string_agg(distinct split, ',' order by split) as splits, count(distinct split) as ns, bool_or(split = 'test') as t, count(distinct label) > 1 as label_conflict, count(*) filter (split <> 'train') as n_eval from hashed where norm_sha is not null group by norm_sha),
 e as (select norm_sha, bool_or(x) as exact from r group by norm_sha)
 select family_id, size, splits, case when exact then 'exact_cross_split' else 'transformed_cross_split' end as kind, case when exact and t then 'critical' when exact or t then 'high' else 'medium' end as risk, label_conflict, n_eval::bigint as n_eval from f join e using (norm_sha) where ns >= 2""",
    "split_integrity_exact": f"""with {HASHED} select split, count(*) as n, count(*) filter (raw_sha in (select raw_sha from hashed where split = 'train')) as exact_in_train,
 round(count(*) filter (raw_sha in (select raw_sha from hashed where split = 'train')) / count(*)::double, 6) as fraction, count(distinct label) filter (label not in (select label from hashed where split = 'train')) as classes_missing_from_train from hashed where split in ('val', 'test') group by split""",
    "contamination_exact": f"""with {HASHED}, t as (select * from hashed where split = 'train'), r as (select raw_sha, min(sample_id) as r from t group by 1), n as (select norm_sha, min(sample_id) as n from t group by 1)
 select sample_id, split, coalesce(r, n) as ref_id, case when r is not null then 'exact' else 'normalized' end as relation from hashed left join r using (raw_sha) left join n using (norm_sha) where split = 'test' and coalesce(r, n) is not null""",
    "contamination_contains": "select doc_id as sample_id, item_id from documents d join benchmark b on contains(d.text, b.text) where b.text <> ''",
    "version_diff": f"""with {HASHED}, a as (select * from hashed where sample_id % 5 <> 0), b as (select * from hashed where sample_id % 5 <> 1),
 m as (select case when x.raw_sha is null then 'added' when y.raw_sha is null then 'removed' else 'common' end as status from (select distinct raw_sha from a) x full join (select distinct raw_sha from b) y on x.raw_sha = y.raw_sha),
 fa as (select distinct string_agg(distinct raw_sha, ',' order by raw_sha) as s from a group by norm_sha having count(*) > 1), fb as (select distinct string_agg(distinct raw_sha, ',' order by raw_sha) as s from b group by norm_sha having count(*) > 1),
 f as (select case when x.s is null then 'new' when y.s is null then 'resolved' else 'persisting' end as status from fa x full join fb y on x.s = y.s)
 select 'content' as kind, status, count(*) as n from m group by all union all select 'family', status, count(*) from f group by all""",
    "label_split_changes": f"""with {HASHED}, g as (select raw_sha, string_agg(distinct label, ',' order by label) filter (sample_id % 5 <> 0) as a_labels, string_agg(distinct label, ',' order by label) filter (sample_id % 5 <> 1) as b_labels,
 string_agg(distinct split, ',' order by split) filter (sample_id % 5 <> 0) as a_splits, string_agg(distinct split, ',' order by split) filter (sample_id % 5 <> 1) as b_splits from hashed group by raw_sha)
 select * from g where a_labels is not null and b_labels is not null and (a_labels <> b_labels or a_splits <> b_splits)""",
    "capture_conditions": f"with {CONDITIONS} select label, count(*) as n, " + ", ".join(f"round(avg({c}::int::double), 6) as {c}_share" for c in _NAMES) + " from cond group by label",
    "condition_gaps": f"with {CONDITIONS}, long as (" + " union all ".join(f"select label, '{c}' as condition, {c}::int as x from cond where split = 'train'" for c in _NAMES)
    + "), g as (select label, condition, count(*) as n, sum(x) as k from long group by all), t as (select condition, sum(n) as tn, sum(k) as tk from g group by condition) select label, condition, n, round(k / n::double, 6) as share, round((tk - k) / (tn - n)::double, 6) as other_share from g join t using (condition) where tn > n and (tk - k) / (tn - n)::double >= 0.06 and k / n::double <= 0.1",
    "underrepresented": f"with {SQL_TEXT}, c as (select label, count(*) as n from samples where split = 'train' group by label), m as (select quantile_cont(n::double, 0.5) as med from c) select label, n, round(med, 4) as median_n, cast(round_even(greatest(greatest(30, 1.5 * med) - n, 0), 0) as bigint) as wanted, case when n < 30 then 'high' else 'medium' end as priority from c, m where n < greatest(30, 1.5 * med)",
    "cramers_v": f"with {CUES}, fit as (select * from cues where split = 'train')" + CRAMER.format(p="f", src="fit") + " select cue, n, round(v, 6) as v from fv",
    "shortcut_findings": f"with {CUES.replace('cues as (select * from long0', 'own as (select * from long0')}, cues as (select * from own union all select sample_id, label, split, 'frame', case when label = 'de' and sample_id % 20 < 17 or sample_id % 20 = 19 then 'thick' else 'none' end from attrs), fit as (select * from cues where split = 'train'), held as (select * from cues where split in ('val', 'test'))" + CRAMER.format(p="f", src="fit") + CRAMER.format(p="e", src="held")
    + """, cells as (select cue, value, label, nxy, nxy / nx::double as p, (nxy / nx::double) / (ny / n::double) as lift, nxy / ny::double as share from fxy join fx using (cue, value) join fy using (cue, label) join fn using (cue)),
 top as (select *, row_number() over (partition by cue order by round(lift * share, 9) desc, value, label) as rk from cells where nxy >= 8 and lift >= 1.8 and share >= 0.5)
 select cue, value, label, nxy as support, round(lift, 4) as lift, round(share, 4) as share, round(p, 4) as p_class, round(fv.v, 4) as strength, case when en.n >= 20 then round(ev.v, 4) end as strength_eval, case when fv.v >= 0.5 then 'strong' when fv.v >= 0.3 then 'moderate' else 'weak' end as strength_label
 from top join fv using (cue) left join ev using (cue) left join en using (cue) where rk <= 3 and fv.v >= 0.3""",
    "privacy_patterns": f"with {SQL_TEXT}, p as (" + " union all ".join(f"select sample_id, '{k}' as kind, len(regexp_extract_all(coalesce(text, ''), '{p}')) as n from samples" for k, p in profile.PRIVACY.items()) + ") select * from p where n > 0",
    "dna_profile": f"with {ATTR}, {DNA.format(p='', src='attrs')} select dimension, bucket, round(share, 6) as share from dna",
    "dna_drift": f"with {ATTR}, va as (select * from attrs where sample_id % 5 <> 0), vb as (select * from attrs where sample_id % 5 <> 1), {DNA.format(p='a', src='va')}, {DNA.format(p='b', src='vb')},"
    + """ j as (select coalesce(x.dimension, y.dimension) as dimension, coalesce(x.share, 0.0) as p, coalesce(y.share, 0.0) as q from adna x full join bdna y on x.dimension = y.dimension and x.bucket = y.bucket),
 s as (select dimension, sum(0.5 * case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + 0.5 * case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) as js from j group by dimension)
 select dimension, round(js, 6) as js, case when js >= 0.15 then 'strong' when js >= 0.05 then 'moderate' else 'none' end as drift from s""",
    "list_samples": f"with {QUALITY} select sample_id, label, split, n_chars from samples where source ilike 'SRC1%' and sample_id in (select sample_id from quality where severity in ('medium', 'high')) order by n_chars desc nulls last, sample_id limit 20 offset 4",
    "quality_labels": f"""with {QUALITY}, j as (select labels.quality = 0 as bad, doc_id in (select sample_id from quality where severity in ('medium', 'high')) as hit from labels)
 select count(*) filter (bad and hit) as true_positives, count(*) filter (hit) as found, count(*) filter (bad) as planted, round(count(*) filter (bad and hit) / greatest(count(*) filter (hit), 1)::double, 6) as precision, round(count(*) filter (bad and hit) / greatest(count(*) filter (bad), 1)::double, 6) as recall from j""",
}
