"""Views, memberships, clusters, detector scores and cues of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize
from plumbline.operators import families, shortcuts, similarity
from plumbline.operators.graph import connected_components
from plumbline.operators.ranges import ranked
from plumbline.plans import text_queries as texts
from plumbline.plans import vector_queries as vectors
from plumbline.sources.bindings import SQL_TEXT, text_samples, vector_samples
from plumbline.sources.tables import table


def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    """Every k-th vector, for a plot of at most 200 points."""
    v = vector_samples(spark, d)
    step = v.agg(F.greatest(F.ceil(F.count("*") / 200), F.lit(1)).cast("bigint").alias("step"))
    return ranked(v.select("sample_id", "label"), [F.col("sample_id")]).crossJoin(step).filter((F.col("rk") - 1) % F.col("step") == 0).select("sample_id", "label", "step")  # one row


def validate_version(spark, d):
    """Warnings about a version as a sorted list."""
    s = text_samples(spark, d)
    facts = s.agg(F.countDistinct("label").alias("classes"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") != "train").alias("held"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) < 32).alias("tiny"))
    w = F.array_compact(F.array(F.when(F.col("classes") < 2, "fewer than two classes"), F.when(F.col("train") == 0, "no training split"), F.when(F.col("held") == 0, "no evaluation split"), F.when(F.col("tiny") > 0, "very short texts")))
    return facts.select("classes", "train", "held", "tiny", F.array_join(w, "; ").alias("warnings"))


def ledger_page(spark, d):
    """A user's ten latest events before number 5,000."""
    e = table(spark, d, "events").filter("user_id = 7 and event_id < 5000")
    return e.orderBy(F.desc("event_id")).limit(10).select("event_id", "event_type")


def leak_membership(spark, d):
    """The worst leak that each sample is part of."""
    h = texts._hashed(spark, d)
    rank = F.when(F.col("risk") == "critical", 3).when(F.col("risk") == "high", 2).when(F.col("risk") == "medium", 1).otherwise(0)
    leaks = families.family_leaks(h).select("family_id", "risk", rank.alias("rank"))
    least = h.groupBy("norm_sha").agg(F.min("sample_id").alias("family_id"))
    m = h.join(least, "norm_sha").select("sample_id", "family_id").join(leaks, "family_id")
    return m.groupBy("sample_id").agg(F.max(F.struct("rank", (-F.col("family_id")).alias("f"), "risk")).alias("m")).select("sample_id", (-F.col("m.f")).alias("family_id"), "m.risk")


def similar_subject_clusters(spark, d):
    """Components of similar vectors across splits, with size and range of similarity."""
    pairs = materialize(vectors.similar_subject_pairs(spark, d).filter("sim >= 0.35"), "similar-pairs")  # read twice
    c = connected_components(pairs, "a", "b")
    sizes = c.groupBy("component").agg(F.count("*").alias("size"))
    sims = pairs.join(c, F.col("a") == F.col("node")).groupBy("component").agg(F.min("sim").alias("low"), F.max("sim").alias("high"))
    return sizes.join(sims, "component").select("component", "size", "low", "high")


def score_detectors(spark, d):
    """Pairs of equal raw text as truth against families of equal normalised text: precision and recall, counted by groups."""
    h = texts._hashed(spark, d).filter("raw_sha is not null")
    pairs = lambda *keys: h.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("p"))
    truth, found, both = pairs("raw_sha").select(F.col("p").alias("truth")), pairs("norm_sha").select(F.col("p").alias("found")), pairs("norm_sha", "raw_sha").select(F.col("p").alias("hit"))
    return truth.crossJoin(found).crossJoin(both).select("truth", "found", "hit", F.round(F.col("hit") / F.greatest("found", F.lit(1)), 6).alias("precision"), F.round(F.col("hit") / F.greatest("truth", F.lit(1)), 6).alias("recall"))


def contamination_near(spark, d):
    """Evaluation vectors whose nearest training vector reaches 0.4, and the verdict on the share of them."""
    v = vector_samples(spark, d)
    near = similarity.knn_join(v.filter("split = 'test'").select("sample_id", "embedding"), v.filter("split = 'train'").select("sample_id", "embedding"), 3).filter("rk = 1 and sim >= 0.4")
    n = v.filter("split = 'test'").agg(F.count("*").alias("n"))
    share = F.col("hits") / F.greatest("n", F.lit(1))
    return near.agg(F.count("*").alias("hits")).crossJoin(n).select("n", "hits", F.round(share, 6).alias("fraction"), F.when(F.col("hits") == 0, "clean").when(share <= 0.01, "minor_overlap").otherwise("contaminated").alias("verdict"))


def dna_fingerprint(spark, d):
    """A digest of the coarsely rounded profile."""
    p = shortcuts.dna_profile(texts._attributes(spark, d))
    line = F.concat_ws(":", "dimension", "bucket", F.round(F.col("share") * 50, 0).cast("int").cast("string"))
    return p.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256), 1, 16).alias("fingerprint"))


def order_cues(spark, d):
    """How well flags and months of line items tell the status of their order."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "MM").alias("month"), F.date_format("l_shipdate", "yyyy").alias("year"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    cues = j.select("label", F.explode(F.array(*[F.struct(F.lit(n).alias("cue"), F.col(c).alias("value")) for n, c in (("returnflag", "l_returnflag"), ("linestatus", "l_linestatus"), ("month", "month"), ("year", "year"))])).alias("p")).select("label", "p.*")
    return shortcuts.cramers_v(cues)


def order_drift(spark, d):
    """Drift of order priorities, statuses and segments between the years before and from 1995."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    dims = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(c).alias("bucket")) for n, c in (("priority", "o_orderpriority"), ("status", "o_orderstatus"), ("segment", "c_mktsegment"))])
    long = o.select((F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")).alias("old"), F.explode(dims).alias("x")).groupBy("old", "x.dimension", "x.bucket").agg(F.count("*").alias("n"))
    total = long.groupBy("old", "dimension").agg(F.sum("n").alias("t"))
    share = long.join(total, ["old", "dimension"]).select("old", "dimension", "bucket", (F.col("n") / F.col("t")).alias("share"))
    return shortcuts.dna_drift(share.filter("old").drop("old"), share.filter("not old").drop("old"))


QUERIES = {f.__name__: f for f in (stride_sample, validate_version, ledger_page, leak_membership, similar_subject_clusters, score_detectors, contamination_near, dna_fingerprint, order_cues, order_drift)}

ORACLES = {
    "stride_sample": "with s as (select greatest(1, ceil(count(*) / 200.0))::bigint as step from embeddings) select vec_id as sample_id, label, step from (select *, row_number() over (order by vec_id) - 1 as i from embeddings), s where i % step = 0",
    "validate_version": f"with {SQL_TEXT}, f as (select count(distinct label) as classes, count(*) filter (split = 'train') as train, count(*) filter (split <> 'train') as held, count(*) filter (coalesce(length(text), 0) < 32) as tiny from samples) select *, coalesce(concat_ws('; ', case when classes < 2 then 'fewer than two classes' end, case when train = 0 then 'no training split' end, case when held = 0 then 'no evaluation split' end, case when tiny > 0 then 'very short texts' end), '') as warnings from f",
    "ledger_page": "select event_id, event_type from events where user_id = 7 and event_id < 5000 order by event_id desc limit 10",
    "leak_membership": "with " + texts.HASHED + ", leak as (with " + texts.ORACLES["family_leaks"].split("with ", 1)[1][len(texts.HASHED):].lstrip(", \n") + "), m as (select sample_id, min(sample_id) over (partition by norm_sha) as family_id from hashed where norm_sha is not null) select sample_id, family_id, risk from m join leak using (family_id)",
    "similar_subject_clusters": "with recursive " + vectors.KNN + """, p as (select least(k.sample_id, neighbor_id) as a, greatest(k.sample_id, neighbor_id) as b, max(sim) as sim from knn k join vectors x on x.sample_id = k.sample_id join vectors y on y.sample_id = neighbor_id where sim >= 0.35 and x.split <> y.split group by all),
 e as (select a, b from p union select b, a from p), r as (select distinct a as node, a as seen from e union select r.node, e.b from r join e on r.seen = e.a), c as (select node, min(seen) as component from r group by node)
 select component, count(distinct node) as size, min(sim) as low, max(sim) as high from c left join p on p.a = c.node group by component""",
    "score_detectors": "with " + texts.HASHED + ", g as (select (select coalesce(sum(n * (n - 1) // 2), 0)::bigint from (select count(*) as n from hashed where text is not null group by raw_sha)) as truth, (select coalesce(sum(n * (n - 1) // 2), 0)::bigint from (select count(*) as n from hashed where text is not null group by norm_sha)) as found, (select coalesce(sum(n * (n - 1) // 2), 0)::bigint from (select count(*) as n from hashed where text is not null group by norm_sha, raw_sha)) as hit) select *, round(hit / greatest(found, 1)::double, 6) as precision, round(hit / greatest(truth, 1)::double, 6) as recall from g",
    "contamination_near": "with " + vectors.SQL_VECTORS + f", x as (select a.sample_id, max(round({vectors._COS.format('a.embedding', 'b.embedding')}, 4)) as sim from vectors a join vectors b on b.split = 'train' where a.split = 'test' group by all), f as (select count(*) as n, count(*) filter (sim >= 0.4) as hits from x) select n, hits, round(hits / greatest(n, 1)::double, 6) as fraction, case when hits = 0 then 'clean' when hits / greatest(n, 1)::double <= 0.01 then 'minor_overlap' else 'contaminated' end as verdict from f",
    "dna_fingerprint": "with " + texts.ATTR + ", " + texts.DNA.format(p="", src="attrs") + " select substring(sha256(string_agg(dimension || ':' || bucket || ':' || cast(round(share * 50, 0) as integer), ',' order by dimension || ':' || bucket || ':' || cast(round(share * 50, 0) as integer))), 1, 16) as fingerprint from dna",
    "order_cues": "with j as (select o_orderstatus as label, l_returnflag, l_linestatus, strftime(l_shipdate, '%m') as m, strftime(l_shipdate, '%Y') as y from lineitem join orders on l_orderkey = o_orderkey), cues as (select label, unnest([{'cue': 'returnflag', 'value': l_returnflag}, {'cue': 'linestatus', 'value': l_linestatus}, {'cue': 'month', 'value': m}, {'cue': 'year', 'value': y}], recursive := true) from j)" + texts.CRAMER.format(p="f", src="cues") + " select cue, n, round(v, 6) as v from fv",
    "order_drift": """with o as (select o_orderdate < timestamp '1995-01-01' as old, o_orderpriority, o_orderstatus, c_mktsegment from orders join customer on o_custkey = c_custkey), x as (select old, unnest([{'dimension': 'priority', 'bucket': o_orderpriority}, {'dimension': 'status', 'bucket': o_orderstatus}, {'dimension': 'segment', 'bucket': c_mktsegment}], recursive := true) from o),
 n as (select old, dimension, bucket, count(*) as n from x group by all), s as (select *, n / sum(n) over (partition by old, dimension)::double as share from n), a as (select * from s where old), b as (select * from s where not old),
 j as (select coalesce(a.dimension, b.dimension) as dimension, coalesce(a.share, 0.0) as p, coalesce(b.share, 0.0) as q from a full join b on a.dimension = b.dimension and a.bucket = b.bucket),
 r as (select dimension, sum(0.5 * case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + 0.5 * case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) as js from j group by dimension) select dimension, round(js, 6) as js, case when js >= 0.15 then 'strong' when js >= 0.05 then 'moderate' else 'none' end as drift from r""",
}
