"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe_automaton, chat_format, chroma_fingerprint, collocations, external_shuffle, maxscore, phrase_parsing, prefix_trie, simhash, source_mixing, toxicity, url_filter, warc_archive
from plumbline.sources.bindings import spread
from plumbline.sources.tables import table

def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), k=5, query_every=50)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mixing.mix(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")), power=0.8, keep=0.7, sweeps=20, seed=42)
    name = lambda c: F.coalesce(c, F.lit(source_mixing.NONE)).alias(c)
    return mixed.select("doc_id", name("source"), name("lang"), "topic", "tokens", F.round("probability", 6).alias("probability"), "kept")


URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_warc_capture_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = warc_archive.archive_and_index(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_revisit_bytes=0)
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op6_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, rendered as music, is a recording."""
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return chroma_fingerprint.match_recordings(turns, "text", ["conv_id", "turn"], decode=chroma_fingerprint.melody)


def op7_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    measures = {"doc_id": F.col("doc_id"), "size": (F.octet_length(text) + 1).cast("bigint"), "text_crc32": F.crc32(text)}
    written = external_shuffle.shuffle_to_shards(docs, shards=8, seed=42, measures=measures)
    grown = external_shuffle.shard_of(F.col("doc_id"), 9, 42)
    return written.select(*measures, F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(extra)))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_decode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), default_tokenizer())


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spread(table(spark, sf_dir, "documents").select("lang", "text")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def op13_phrase_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_parsing.edited_likeness(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_maxscore_top_k": op1_maxscore_top_k,
    "op2_toxicity": op2_toxicity,
    "op3_source_mixing": op3_source_mixing,
    "op4_url_filter": op4_url_filter,
    "op5_warc_capture_history": op5_warc_capture_history,
    "op6_chroma_alignment": op6_chroma_alignment,
    "op7_external_shuffle": op7_external_shuffle,
    "op8_chat_format": op8_chat_format,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_phrase_parsing": op13_phrase_parsing,
}

_ESC = r"regexp_replace(replace({0}, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1\\\2', 'g')"
ORACLES = {
    "op3_source_mixing": source_mixing.oracle_sql(power=0.8, keep=0.7, sweeps=20, seed=42),
    "op1_maxscore_top_k": """
with u as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from u q join u c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 5""",
    "op8_chat_format": rf"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length({_ESC.format("role")}) + length({_ESC.format("text")}) + 8 + 7 + case when role = 'assistant' then 9 else 8 end)::bigint as formatted_chars
from rows group by conv_id""",
    "op4_url_filter": url_filter.oracle_sql(URL_RULES),
    "op5_warc_capture_history": rf"""
with p as (select page_id, coalesce(html, '') as html, regexp_replace(coalesce(url, ''), '[\x00-\x20\x7f]', '%20', 'g') as url from pages),
h as (select *, sha1(html) as d, octet_length(encode(html)) as bytes, lower(case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else url end) as rest from p),
k as (select *, max(page_id) over (partition by d) as keeper, count(*) over (partition by d) as copies, regexp_extract(rest, '^[^/?#]*') as host from h)
select page_id, bytes::bigint as payload_bytes, {" || ".join(f"substr('{warc_archive.BASE32}', ((('0x' || substr(d, {10 * i + 1}, 10))::bigint >> {35 - 5 * j}) & 31)::integer + 1, 1)" for i in range(4) for j in range(8))} as payload_digest,
  case when copies > 1 and page_id < keeper then 'revisit' else 'response' end as record_type, case when copies > 1 and page_id < keeper then keeper end as refers_to,
  array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || substr(rest, length(host) + 1) as url_key, strftime(to_timestamp(1704067200 + page_id) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as captured
from k""",
    "op11_phrase_collocations": r"""
with pieces as (
  select coalesce(lang, 'und') as lang, row_number() over () as doc, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (
  select lang, unnest(flatten([[w[i:i + k] for i in range(1, len(w) - k + 1)] for k in [0, 1, 2]])) as g from words),
f as (select lang, g, count(*) as n from grams group by lang, g),
candidates as (select lang, g, n as a from f where len(g) > 1 and n >= 10),
inner_parts as (select lang, n as b, unnest([g[1:2], g[2:3]]) as g from f where len(g) = 3 and n >= 10),
gone as (select c.lang, c.g from candidates c join inner_parts p on p.lang = c.lang and p.g = c.g where 100 * b >= 50 * a group by all),
cuts as (select c.lang, c.g, a, unnest(range(1, len(c.g))) as k from candidates c left join gone on gone.lang = c.lang and gone.g = c.g where gone.g is null),
scored as (
  select cuts.lang, cuts.g, cuts.k, a, x.n as l, y.n as r, ((1000000::hugeint * a * a) // (x.n::hugeint * y.n))::bigint as score
  from cuts join f x on x.lang = cuts.lang and x.g = cuts.g[1:k] join f y on y.lang = cuts.lang and y.g = cuts.g[k + 1:]),
best as (select *, row_number() over (partition by lang, g order by score, k) as pick from scored),
totals as (select lang, sum(len(w))::bigint as n from words group by lang),
ranked as (select lang, array_to_string(g, ' ') as phrase, a, l, r, score, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank from best where pick = 1)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000""",
    "op12_prefix_trie": r"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
digests as (select conv_id, turn, md5(octet_length(encode(role)) || ':' || role || text) as digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from turns),
own as (select conv_id, digest, words, row_number() over (partition by conv_id order by turn nulls first, digest) as p from digests),
ids as (select distinct conv_id as c from own),
steps as (select c, list_concat([4294967295], flatten(list_transform(string_split(c::varchar, ''), lambda x: [ascii(x), 0, 0, 0, 0, 0, 0, 0]))) as s from ids),
taken as (select c, (xor(list_reduce(s, lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295) & 3) as h from steps),
heads as (select c, p as d, digest, words from taken join own on conv_id = c - c % 20 and p <= h),
n_heads as (select c, count(*) as n from heads group by c),
rebuilt as (select * from heads union all select taken.c, p - h + coalesce(n, 0), digest, words from taken join own on conv_id = taken.c and p > h left join n_heads on n_heads.c = taken.c),
paths as (select ids.c, coalesce(string_agg(digest, '' order by d), '') as path, list(words order by d) as words, count(d) as len from ids left join rebuilt on rebuilt.c = ids.c group by ids.c),
prefixes as (select c, unnest(range(0, len + 1)) as depth, path, words, len from paths),
members as (select c, depth, substr(path, 1, 32 * depth) as node, case when depth > 0 then words[depth] else 0 end as words, case when depth = len then c end as ends from prefixes),
nodes as (select node, depth, min(c) as conv_id, count(*) as n_convs, any_value(words) as words, sha256(coalesce(string_agg(ends::varchar, ',' order by ends), '')) as ends_sha256 from members group by node, depth),
up as (select node, case when depth > 0 then substr(node, 1, 32 * (depth - 1)) end as parent from nodes),
kids as (select parent as node, count(*) as n_children from up where parent is not null group by parent),
whole as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (node)),
above as (select substr(node, 1, 32 * t.k) as node, n_children, (n_convs - 1) * words as saved from (select *, unnest(range(0, depth + 1)) as k from whole) t),
sums as (select node, count(*) filter (n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens from above group by node)
select w.conv_id, w.depth, p.conv_id as parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
from whole w join sums using (node) join up using (node) left join nodes p on p.node = up.parent""",
}
