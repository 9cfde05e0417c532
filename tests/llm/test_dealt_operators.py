"""The ten operators against brute force, and on odd input."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from compare import duck_rows, spark_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import bpe_automaton, chat_format, chroma_fingerprint, external_shuffle, maxscore, near_dedup, simhash, source_mixing, toxicity, url_filter, warc_archive
from plumbline.llm.registry import ORACLES, QUERIES, URL_RULES, default_tokenizer

LONG = "lorem ipsum dolor " * 20_000
ODD = [(1, "a b c d"), (1, "a b c d"), (2, None), (None, "x"), (3, ""), (4, " \n\t "), (5, LONG), (6, "ß\u00a0é 漢字 \U0001f600"), (7, "a b c d"), (8, "A B  C\nD")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, topic2 string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeats, empty and very long texts, and columns whose names the operators use for results."""
    return spark.createDataFrame([(i, t, ["en", None][k % 2], ["s", "t", None][k % 3], None, 1.0, "q", None) for k, (i, t) in enumerate(ODD)], DOCS).cache()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(duck, ORACLES[name])


# 1 ---------------------------------------------------------------------------------------------

@pytest.mark.parametrize("spread", [4, 60])
def test_maxscore_equals_brute_force(spark, spread):
    rng = np.random.default_rng(spread)
    v = rng.integers(-spread, spread, (700, 12)) / 256
    v[100:200] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 12), (None, [0.5] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted(tuple(r) for r in maxscore.top_k(df, k=5, shard_rows=300, query_rows=4).select("query_id", "rank", "vec_id", "score").collect())
    w = np.floor(256 * v).astype(int)
    want = []
    for q in range(0, 700, 50):
        best = sorted(((-int(w[q] @ w[j]), j) for j in range(700) if j != q))[:5]
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_maxscore_of_repeated_ids(spark):
    rows = [(0, [1.0]), (0, [0.5]), (3, [2.0]), (3, [2.0]), (4, [1.0])]
    got = [tuple(r) for r in maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).collect()]
    assert sorted(got) == [(0, 1, 3, 128 * 512), (0, 2, 3, 128 * 512), (0, 3, 4, 128 * 256)]


def test_maxscore_of_nothing_and_of_few(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert maxscore.top_k(empty).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in maxscore.top_k(two).collect()] == [(0, 1, 3, 256 * 512)]


# 2 ---------------------------------------------------------------------------------------------

def test_grammar_scores_clauses():
    g = toxicity.Grammar({"blorg": 3.0})
    plain, negated, quoted, none = (g.features(t)[1] for t in ("a blorgish thing", "this is not blorgish at all", 'he said "blorgish" loudly', "a calm thing"))
    assert plain > negated > none == 0 and plain > quoted > 0
    assert g.features("I will kill you")[1] > g.features("they kill time")[1]
    assert g.features(None) == g.features("") == (0.0, 0.0, 0.0)


def score_by_rules(symbols, weights):
    """The grammar's rules applied to each word by looking back over the clause."""
    T = toxicity
    total, threat, open_until, in_quotes, reported = 0.0, 0.0, -1, False, False
    within = lambda i, opening, length, closing=(): next((symbols[j] in opening for j in range(i - 1, max(-1, i - 1 - length), -1) if symbols[j] in (*opening, *closing)), False)
    for i, (s, w) in enumerate(zip(symbols, weights)):
        event, value = s, w
        if s == T.THREAT:
            threat, open_until, value = w, i + 3, 0.25 * w
        elif s == T.TARGET and i <= open_until:
            event, open_until, value = T.COMPLETED, -1, 0.75 * threat
        if s == T.INSULT and within(i, (T.INSULT,), 2):
            value *= 1.25
        if event in (T.INSULT, T.THREAT) and within(i, (T.TARGET,), 4, (T.REPORT,)):
            value *= 1.5
        if within(i, (T.NEGATION,), 2):
            value *= {T.INSULT: 0.5, T.THREAT: 0.3, T.COMPLETED: 0.3}.get(event, 1.0)
        if event in (T.INSULT, T.THREAT, T.COMPLETED):
            total += value * (0.7 if in_quotes or reported else 1.0)
        if s == T.QUOTE:
            in_quotes, reported = not in_quotes, False
        elif s == T.REPORT and not in_quotes:
            reported = True
    return total


def test_composed_grammar_equals_its_rules():
    words = {toxicity.INSULT: "idiot", toxicity.THREAT: "kill", toxicity.TARGET: "you", toxicity.NEGATION: "not", toxicity.REPORT: "said", toxicity.QUOTE: '"', toxicity.OTHER: "thing"}
    g, rnd = toxicity.Grammar({}), random.Random(1)
    for _ in range(3000):
        symbols = [rnd.randrange(7) for _ in range(rnd.randrange(1, 14))]
        tokens = [words[s] for s in symbols]
        weights = [g._weight(t) for t in tokens]
        assert g.clause(tokens, weights) == pytest.approx(score_by_rules(symbols, weights))
        if any(weights):
            assert g.features(" ".join(tokens))[1] == pytest.approx(min(10.0, score_by_rules(symbols, weights)))


def test_quotation_carries_on_to_the_end_of_the_line():
    g = toxicity.Grammar({})
    top = lambda t: g.features(t)[1]
    assert top('"well. idiot."') == pytest.approx(0.7 * top("well. idiot."))
    assert top('"well.\nidiot.') == top("well. idiot.")
    assert top('"well." idiot.') == top("well. idiot.")


def test_patterns_are_not_capped(spark):
    """More telling words than any former limit are all learned."""
    docs = [(i, f"common filler {i % 50} " + " ".join(f"bad{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100 % 10]}{'abcdefghij'[k // 1000]} {'abcdefghij'[(i // 5 * 7 + k) % 10]}{'abcdefghij'[(i // 5 + k // 10) % 10]}" for k in range(4500)) if i % 5 == 0 else f"common filler {i % 50}") for i in range(100)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(100)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
    counts = toxicity._pattern_counts(toxicity._labelled(frame, labels, 1000))
    words = toxicity._patterns(counts.filter("pattern like '%$'"), "pos_a + pos_b", "neg_a + neg_b", "seen_a | seen_b", 16, 64)
    assert len(words) >= 4500


def planted_toxic(spark, n=600):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(60)]
        bad = i % 8 == 0
        if bad:
            for _ in range(3):
                text[rnd.randrange(60)] = "zork" + rnd.choice(["ish", "en", "let", "ous"])
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_beginnings_and_holds_out(spark):
    docs, labels = planted_toxic(spark)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 600
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.score >= 0.5) == (r.doc_id % 8 == 0)
    assert sorted(r.doc_id for r in toxicity.without_toxic(docs, model).collect()) == [i for i in range(600) if i % 8]


def test_toxicity_on_odd_input(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, none)
    assert toxicity.score(odd, model).count() == len(ODD)
    assert toxicity.without_toxic(odd, model).columns == odd.columns
    assert toxicity.score(odd.limit(0), model).count() == 0


# 3 ---------------------------------------------------------------------------------------------

def test_raking_meets_margins():
    rng = np.random.default_rng(0)
    tokens = rng.uniform(50, 100, 24)
    levels = [np.repeat(np.arange(4), 6), np.tile(np.arange(3), 8)]
    targets = [np.array([0.3, 0.2, 0.25, 0.25]), np.array([0.4, 0.3, 0.3])]
    w = source_mixing.rake(tokens, levels, targets, 0.4 * tokens.sum(), 200)
    for level, target in zip(levels, targets):
        assert np.allclose(np.bincount(level, w) / w.sum(), target, atol=1e-6)
    assert (w <= tokens + 1e-9).all()


def test_residuals_tell_how_far_margins_are(spark):
    rows = [(i, "w " * (5 + i % 7), ["en", "de", None][i % 3], f"s{i % 5}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"s1": 0.1}}
    of = lambda sweeps: {(r.margin, r.level): (r.target, r.share) for r in source_mixing.residuals(source_mixing.mix(df, targets, keep=0.3, sweeps=sweeps), targets).collect()}
    far = lambda x: max(abs(a - b) for a, b in x.values())
    done = of(20)
    assert done["source", "s1"][0] == 0.1 and sum(t for (m, _), (t, _) in done.items() if m == "lang") == pytest.approx(1, abs=1e-6)
    assert far(done) < 1e-5 < far(of(0))


def test_mixing_on_odd_input(spark, odd):
    m = source_mixing.mix(odd)
    rows = m.collect()
    assert len(rows) == len(ODD) and {"topic", "tokens", "probability", "kept", "score"} <= set(m.columns)
    assert len({r.kept for r in rows if r.doc_id == 1 and r.source == rows[0].source}) <= 1
    assert source_mixing.mix(odd.limit(0)).count() == 0
    named = source_mixing.mix(odd, targets={"source": {"s": 0.9}}, keep=0.1)
    assert all(0 <= r.probability <= 1 for r in named.collect())
    assert source_mixing.mix(odd, max_levels=1).count() == len(ODD)
    assert source_mixing.mixed_documents(odd).columns == odd.columns


def test_mixing_fits_every_level(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randrange(1, 60), rnd.choice(["en", "de"]), f"host{min(rnd.randrange(90), rnd.randrange(90))}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    tokens = Counter()
    for _, t, _, s in rows:
        tokens[s] += len(t.split())
    rare = min(tokens, key=lambda s: (tokens[s], s))
    targets = {"source": {rare: 0.2 * tokens[rare] / tokens.total()}}
    args = dict(targets=targets, keep=0.3, sweeps=8)
    got, want = ({r.doc_id: r for r in source_mixing.mix(df, max_levels=n, **args).collect()} for n in (64, 100))
    assert len(tokens) > 64 and len(got) == len(rows)
    assert all(abs(got[i].probability - want[i].probability) < 1e-8 and got[i].kept == want[i].kept for i in got)
    weight = sum(r.probability * r.tokens for r in got.values() if r.source == rare)
    assert abs(weight - 0.3 * 0.2 * tokens[rare]) < 0.1 * weight


# 4 ---------------------------------------------------------------------------------------------

def judge(url, rules):
    """Host, path and longest rule in plain Python."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


URLS = [None, "", "nothing", "http://Example.COM/en/71?x#y", "http://a.example.com/en/2", "https://x.example.net/de/8", "https://x.net/de/", "ftp://org/es/a", "http://borg/es/", "http://a.org?es/", "http://é.org/es/#", "x://", "http://casino-win.com/fr/1", "a://b://c/d", "http://EXAMPLE.com"]


def test_url_rules_equal_plain_python(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS)] + [(None, "http://a.com/en/", "x")], "page_id long, url string, verdict string")
    rows = url_filter.judge_urls(df, URL_RULES).collect()
    assert len(rows) == 2 * len(URLS) + 1
    for r in rows:
        if r.page_id is not None:
            host, path, rule, verdict = judge((URLS + URLS)[r.page_id], URL_RULES)
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == verdict or rule is None and r.verdict in ("allow", "block")
    assert url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    wanted = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    pages = [(0, "http://a.com/en/1"), (1, "http://example.com/en/71"), (2, "http://a.net/de/1"), (3, "http://b.example.net/de/81"), (4, "http://a.org/es/"), (5, "http://spam.net/de/"), (6, "http://spam.fr/"), (7, "http://a.fr/")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in QUERIES["op4_url_filter"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(5)] == list(wanted.items())
    assert got[5] == ("net/de/", "allow") and got[6][0] is None and got[7][0] is None
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert {p: (r, v) for p, r, v in con.execute(f"select page_id, rule, verdict from ({ORACLES['op4_url_filter']})").fetchall()} == got


def test_url_model_carries_over(spark):
    rnd = random.Random(2)
    good = [f"http://{''.join(rnd.choice('thenandi') for _ in range(8))}.example.com/a/{i}" for i in range(300)]
    bad = [f"http://{rnd.choice(['big', 'my', 'top'])}-{rnd.choice(['casino', 'pills', 'bets'])}-{rnd.choice(['win', 'now', 'vip'])}.example.com/a/{i}" for i in range(100)]
    unseen = [f"http://{x}.example.com/a/1" for x in ("big-cas1no-win", "my-pi1ls-now", "top-b3ts-vip")]
    df = spark.createDataFrame(list(enumerate(good + bad + unseen)), "page_id long, url string")
    v = {r.page_id: r.verdict for r in url_filter.judge_urls(df, []).collect()}
    assert sum(v[i] == "allow" for i in range(300)) >= 295 and sum(v[i] == "block" for i in range(300, 400)) >= 98
    assert [v[400 + i] for i in range(3)] == ["block"] * 3


def scores_by_hand(texts):
    """Leave-one-out scores by dictionaries of counts; ``texts`` are (text, rejected)."""
    U, counts = url_filter, [[defaultdict(Counter) for _ in range(url_filter.ORDERS)] for _ in range(2)]

    def steps(text):
        t = [c if c in U.ALPHABET else U.OTHER for c in "".join(c.lower() if "A" <= c <= "Z" else c for c in text)] + [U.CLOSE]
        padded = [U.START] * (U.ORDERS - 1) + t
        for i in range(len(t)):
            yield padded[i : i + U.ORDERS - 1], t[i]

    for text, bad in texts:
        for before, c in steps(text):
            for o in range(U.ORDERS):
                counts[bad][o]["".join(before[len(before) - o :])][c] += 1
    out = []
    for text, bad in texts:
        total = n = 0
        for before, c in steps(text):
            p = []
            for k in (0, 1):
                x = 1 / U.SYMBOLS
                for o in range(U.ORDERS):
                    row = counts[k][o]["".join(before[len(before) - o :])]
                    own = int(bad == k)
                    seen, kinds = sum(row.values()) - own, len([1 for v in row.values() if v]) - (own and row[c] == 1)
                    if seen > 0:
                        x = (max(row[c] - own, 0) + kinds * x) / (seen + kinds)
                p.append(x)
            total, n = total + np.log(p[1]) - np.log(p[0]), n + 1
        out.append(total / n)
    return out


def test_url_scores_equal_counting_by_hand(spark):
    rnd = random.Random(4)
    urls = ["http://" + "".join(rnd.choice("abé-./X?[*<") for _ in range(rnd.randrange(1, 25))) for _ in range(150)] + [f"http://spam{i % 7}.com/{'a/b' * (i % 4)}" for i in range(40)] + [None, "", "no-scheme", "http://spam.com/" + "long/" * 900, "http://a.b/" + "long/" * 900]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[:30])], "page_id long, url string")
    rows = sorted(url_filter.judge_urls(df, []).collect(), key=lambda r: r.page_id)
    bad = [int("spam" in r.host) for r in rows]
    want = scores_by_hand([(r.host + r.path, b) for r, b in zip(rows, bad)])
    assert [r.score for r in rows] == pytest.approx(want, abs=1e-8)
    right = lambda t: np.mean([s >= t for s, b in zip(want, bad) if b]) + np.mean([s < t for s, b in zip(want, bad) if not b])
    assert right(rows[0].threshold) >= max(map(right, want)) - 0.02
    assert all((r.verdict == "block") == (r.score >= r.threshold) for r in rows)


def test_url_model_keeps_every_context(spark):
    """Windows are as many as the texts have: no fixed number of rows is shared."""
    texts = spark.range(30_000).select(F.concat(F.lit("h/"), F.md5(F.col("id").cast("string"))).alias("text"), F.lit(False).alias("bad"), F.lit(1).alias("n"))
    seen = {("<<<<" + r.text + ">")[i : i + 5] for r in texts.collect() for i in range(len(r.text) + 1)}
    assert url_filter.window_counts(texts).count() == len(seen) > 500_000


# 5 ---------------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc_archive.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_warc_round_trip(spark):
    html = ["", "<p>é</p>", "\r\n\r\nWARC/1.1\r\n", None, "same", "line\nline\r\n\r\n"]
    pages = [(i, f"http://b.a/{i % 4}", html[i % 6]) for i in range(50)] + [(50, None, "same"), (51, "http://x/a b\nc", "only")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("run", F.lit("clash"))
    rows = warc_archive.archive_and_index(df).collect()
    top = {}
    for i, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), i)
    by = {r.page_id: r for r in rows}
    assert len(rows) == len(by) == len(pages)
    for i, _, h in pages:
        data, r = (h or "").encode(), by[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if top[h or ""] == i else ("revisit", top[h or ""]))
    keys = [(r.url_key, r.captured, r.page_id) for r in rows]
    assert keys == sorted(keys)


def test_warc_repeats_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "b")], "page_id long, url string, html string")
    assert sorted((r.page_id is None, r.record_type) for r in warc_archive.archive_and_index(df).collect()) == [(False, "response"), (False, "response"), (True, "response")]
    assert warc_archive.archive_and_index(df.limit(0)).count() == 0
    kept = warc_archive.archive_and_index(spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], "page_id long, url string, html string"), min_revisit_bytes=2).collect()
    assert {r.record_type for r in kept} == {"response"}


def test_warc_of_long_pages(spark, tmp_path):
    """Files hold fewer records where pages are long; one is read record by record."""
    pages = [(i, f"http://a.b/{i}", f"{i} é " * 60_000) for i in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc_archive.write_archives(df, str(tmp_path / "w"), file_bytes=1 << 20)
    runs = warc_archive.read_runs(spark, str(tmp_path / "w"))
    assert {r["count"] for r in runs.groupBy("run").count().collect()} <= {1, 2, 3}
    merged = warc_archive.merge_histories(runs, range_rows=3)
    assert 2 <= merged.rdd.getNumPartitions() <= 4
    assert [(r.page_id, r.payload_bytes) for r in merged.collect()] == [(i, len(t.encode())) for i, _, t in sorted(pages, key=lambda p: warc_archive.url_key(p[1]))]


# 6 ---------------------------------------------------------------------------------------------

def test_integral_image_filters_equal_direct_sums():
    rng = np.random.default_rng(4)
    pcm = rng.normal(size=40 * chroma_fingerprint.HOP)
    image = chroma_fingerprint.chroma(pcm).astype(float)
    codes = chroma_fingerprint.fingerprint(pcm)
    assert len(codes) == len(image) - chroma_fingerprint.SPAN + 1
    for t in (0, 5, len(codes) - 1):
        code = 0
        for kind, c, h, w in chroma_fingerprint.FILTERS:
            a = lambda t0, t1, c0, c1: image[t + t0 : t + t1, c0:c1].sum()  # noqa: B023, E731
            m, hm = h // 2, w // 2
            x, y = {
                0: (a(0, w, c, c + h), (a(0, w, 0, 12) - a(0, w, c, c + h)) * h / (12 - h)),
                1: (a(0, w, c + m, c + h), a(0, w, c, c + m)),
                2: (a(0, hm, c, c + h), a(hm, w, c, c + h)),
                3: (a(0, hm, c, c + m) + a(hm, w, c + m, c + h), a(0, hm, c + m, c + h) + a(hm, w, c, c + m)),
            }[kind]
            code = code << 2 | [0, 1, 3, 2][int(np.searchsorted([-0.35, 0, 0.35], np.log((1e-3 + x) / (1e-3 + y))))]
        assert int(codes[t]) == code


def test_recordings_align_with_their_excerpts(spark):
    rng = np.random.default_rng(6)
    notes = chroma_fingerprint._notes()
    songs = [notes[rng.integers(0, 36, 60)].ravel() for _ in range(6)]
    cut = songs[2][10 * chroma_fingerprint.HOP :] * 0.5 + rng.normal(0, 0.01, len(songs[2]) - 10 * chroma_fingerprint.HOP)
    pcm = lambda x: (np.clip(x / 2, -1, 1) * 32767).astype("<i2").tobytes()
    rows = [(i, pcm(s)) for i, s in enumerate(songs)] + [(6, pcm(cut)), (7, pcm(songs[0])), (8, None), (9, b"abc")]
    got = {r.id: r for r in chroma_fingerprint.match_recordings(spark.createDataFrame(rows, "id long, audio binary"), "audio", ["id"]).collect()}
    assert len(got) == 10
    assert got[6].class_id == got[2].class_id and got[7].class_id == got[0].class_id and got[8].class_id == got[9].class_id
    assert len({got[i].class_id for i in range(6)}) == 6
    link = got[6] if got[6].anchor else got[2]
    assert abs(link.shift) == 10 and link.bit_error < 0.1
    assert chroma_fingerprint.match_recordings(spark.createDataFrame([], "id long, audio binary"), "audio", ["id"]).count() == 0


@pytest.mark.parametrize("block", [5, 1000])
def test_alignments_connect_what_brute_force_connects(spark, block):
    """Medleys, excerpts and a jingle that unlike recordings share: every pair is tried at every run that it shares."""
    rnd = np.random.default_rng(block)
    songs = [rnd.integers(0, 36, n) for n in (60, 70, 80, 90, 50)]
    jingle = rnd.integers(0, 36, 16)
    parts = [*songs, np.concatenate((songs[0][:30], songs[1][20:60])), np.concatenate((songs[2][40:], songs[3][:50])), songs[3][10:60], songs[4][5:40]]
    parts += [np.concatenate((rnd.integers(0, 36, k), jingle, rnd.integers(0, 36, 90 - k))) for k in (10, 30, 50, 70)] + [np.concatenate((jingle, songs[4][:30]))]
    codes = [chroma_fingerprint.fingerprint(chroma_fingerprint._notes()[p].ravel()) for p in parts]
    df = spark.createDataFrame([(i, [int(c) for c in x.astype(np.int64)]) for i, x in enumerate(codes)], "id long, codes array<long>")
    n, run, want = len(codes), chroma_fingerprint.RUN, list(range(len(codes)))
    for i in range(n):
        for j in range(i):
            at = {}
            for k in range(len(codes[j]) - run + 1):
                at.setdefault(tuple(codes[j][k : k + run]), []).append(k)
            shifts = {b - a for a in range(len(codes[i]) - run + 1) for b in at.get(tuple(codes[i][a : a + run]), [])}
            if any(m >= 8 and e <= 0.35 for m, e in (chroma_fingerprint.overlap_error(codes[i], codes[j], s) for s in shifts)):
                lo, hi = sorted((want[i], want[j]))
                want = [lo if x == hi else x for x in want]
    found = chroma_fingerprint.align(df, block=block).collect()
    for r in found:
        m, e = chroma_fingerprint.overlap_error(codes[r.id], codes[r.anchor], r.shift)
        assert (r.overlap, r.bit_error) == (m, pytest.approx(e)) and m >= 8 and e <= 0.35
    assert parts_of(n, [(r.id, r.anchor) for r in found]) == want and 1 < len(set(want)) < n
    assert want[5] == want[0] == want[1]


# 7 ---------------------------------------------------------------------------------------------

def test_fisher_yates_is_a_uniform_permutation():
    seen = Counter(tuple(external_shuffle.fisher_yates(3, (s,))) for s in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400
    assert external_shuffle.fisher_yates(0, (1,)).tolist() == []


def test_sharding_law_and_slots(spark, odd):
    many = spark.createDataFrame([(i, f"text {i}" * (i % 9)) for i in range(500)] + [(7, "text 7" * 7)] * 100 + ODD, "doc_id long, text string").withColumn("slot", F.lit("clash"))
    rows = external_shuffle.shuffle_to_shards(many, shards=8, bucket_bytes=4000).select("doc_id", "text", "shard", "slot", external_shuffle.shard_of(F.col("doc_id"), 9, 42).alias("grown")).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in many.collect())
    slots, shard = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        shard[r.doc_id].add((r.shard, r.grown))
        assert r.grown in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shard.values())
    order = [r.doc_id for r in sorted((r for r in rows if r.shard == 3), key=lambda r: r.slot) if r.doc_id is not None]
    assert order != sorted(order)
    assert external_shuffle.shuffle_to_shards(odd.limit(0)).count() == 0


def test_slots_depend_on_seed_and_rows_alone(spark):
    rows = [(i, f"text {i % 40}") for i in range(700)] + [(3, "again")] * 150 + [(None, None)] * 20
    slots = lambda data, parts, seed=42: sorted((str(r.doc_id), str(r.text), r.shard, r.slot) for r in external_shuffle.shuffle_to_shards(spark.createDataFrame(data, "doc_id long, text string").repartition(parts), shards=4, seed=seed, bucket_bytes=3000).collect())
    mixed = random.Random(3).sample(rows, len(rows))
    first = slots(rows, 3)
    assert first == slots(mixed, 7) != slots(rows, 3, seed=43)
    ties = external_shuffle.numbered_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("k", F.xxhash64("doc_id", "text")), "k")
    numbers = defaultdict(list)
    for r in ties.collect():
        numbers[r.doc_id, r.text].append(r.tie)
    assert all(sorted(v) == list(range(len(v))) for v in numbers.values())


def spark_hash(*values, seed=42):
    """Spark's xxhash64 of ints ("i"), longs ("q") and texts: XXH64 of each value's bytes, seeded with the hash so far."""
    for kind, v in values:
        seed = xxhash.xxh64(v.encode() if kind == "s" else struct.pack("<" + kind, v), seed=seed & (2**64 - 1)).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def test_slots_equal_brute_force(spark):
    rows = [(i, f"text {i * 7 % 90} é") for i in range(400)]
    shards, seed, bucket_bytes = 5, 11, 2000
    found = external_shuffle.shuffle_to_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=shards, seed=seed, bucket_bytes=bucket_bytes)
    got = {r.doc_id: (r.shard, r.slot) for r in found.collect()}
    buckets = max(1, -(-sum(len(t.encode()) + 64 for _, t in rows) // bucket_bytes))
    held = defaultdict(list)
    for i, t in rows:
        luck = spark_hash(("i", seed + 1), ("q", spark_hash(("i", seed), ("q", i), ("s", t))), ("q", 0))
        held[luck % buckets].append((luck, i))
    want, filled = {}, Counter()
    for b in sorted(held):
        members = sorted(held[b])
        for k in external_shuffle.fisher_yates(len(members), (seed, b)):
            i = members[k][1]
            shard = max((spark_hash(("i", seed), ("i", s), ("q", i)), s) for s in range(shards))[1]
            want[i] = (shard, filled[shard])
            filled[shard] += 1
    assert got == want and buckets > 5


# 8 ---------------------------------------------------------------------------------------------

def test_escape_is_reversible(spark):
    bits = ["<", "|", "\\", "s>", "/s>", "</s>", "<s>", "[INST]", "[/INST]", "[", "<|end|>", "<|turn|>", "a", "\n", "$1"]
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(9))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e")).select("t", "e", chat_format.unescape(F.col("e")).alias("u")).collect()
    assert all(r.t == r.u for r in rows)
    assert not any(c in r.e for r in rows for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_conversations_read_back(spark):
    rnd = random.Random(3)
    turns = [(c, t, rnd.choice(["user", "assistant", "system", None, "<|end|>"]), rnd.choice([None, "", "</s>[INST] ok [/INST]", "<|end|><|turn|>assistant<|body|>x", "é\U0001f600\\", "plain"])) for c in (1, 2, None) for t in range(9)]
    turns += [(5, None, "user", "x"), (5, 1, "assistant", "b"), (5, 1, "assistant", "a"), (5, 1, "assistant", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit("clash"))
    formatted = chat_format.format_conversations(df).cache()
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    by_spans = {r.conv_id: "".join(r.formatted[s.start : s.end] for s in r.loss_spans) for r in formatted.collect()}
    by = defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        loss = "".join(x for _, r, x in rows if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(rows), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in rows).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert re.sub(r"\\([\s\S])", r"\1", by_spans[c]) == loss
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_content_parts_become_placeholders(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [(1, 0, "user", [part("text", "see "), part("image", ref="a.png", units=2), part("text", " and <|image:9|>"), part("audio", ref="b.wav", units=3)]), (1, 1, "assistant", [part("text", "ok")]), (1, 2, "user", [part("document", ref="c.pdf"), None, part("video", ref="d")]), (1, 3, "user", None)]
    r = chat_format.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")).first()
    assert r.formatted == "<|turn|>user<|body|>see <|image:0|> and <\\|image:9|><|audio:1|><|end|><|turn|>assistant<|train|>ok<|end|><|turn|>user<|body|><|document:2|><|video:3|><|end|><|turn|>user<|body|><|end|>"
    assert [(a.ordinal, a.turn_no, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 0, "image", "a.png", 85 + 340), (1, 0, "audio", "b.wav", 2 + 75), (2, 2, "document", "c.pdf", 604), (3, 2, "video", "d", 0)]
    assert [r.formatted[s.start : s.end] for s in r.loss_spans] == ["ok"] and r.attachment_tokens == 425 + 77 + 604


def test_control_strings_over_adjacent_text_parts(spark):
    """However a text is cut into parts, it is escaped as one and read back whole."""
    rnd, whole = random.Random(8), ["<|end|>", "<|turn|>", "<|body|>", "<|train|>", "<|image:0|>", "[INST]", "[/INST]", "<s>", "</s>", "\\", "[\\", "<\\|end|>", "a[", "<"]
    rows, want = [], {}
    for c in range(120):
        text, parts = rnd.choice(whole) + rnd.choice(whole) + rnd.choice(["", "x", "\\"]), []
        cuts = sorted(rnd.randrange(len(text) + 1) for _ in range(rnd.randrange(6)))
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        parts += [("text", p, None, None) for p in pieces]
        if c % 3 == 0:
            at = rnd.randrange(len(parts) + 1)
            parts.insert(at, ("image", None, "r", 1))
            text = "".join(p[1] for p in parts[:at]) + "<|image:0|>" + "".join(p[1] for p in parts[at + 1 :])
        rows += [(c, 0, "assistant", parts), (c, 1, "user", [("text", "next", None, None)])]
        want[c] = text
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    done = chat_format.format_conversations(df)
    got = done.select("conv_id", "formatted", "loss_spans", chat_format.parse_turns(F.col("formatted")).alias("t")).collect()
    assert len(got) == 120
    for r in got:
        assert [(t.role, t.text, t.trained) for t in r.t] == [("assistant", want[r.conv_id], True), ("user", "next", False)]
        inside = r.formatted[r.loss_spans[0].start : r.loss_spans[0].end]
        assert r.formatted == f"<|turn|>assistant<|train|>{inside}<|end|><|turn|>user<|body|>next<|end|>"
        assert not re.search(r"<\|(?!image:0\|>)|</?s>|\[/?INST\]", inside)


def test_loss_spans_say_the_same_as_the_marks(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"<s>{c}[INST] é😀 {t}" * (c % 3)) for c in range(9) for t in range(c)]
    done = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in done.select("formatted", "loss_spans", chat_format.parse_turns(F.col("formatted")).alias("t")).collect():
        by_span = [re.sub(r"\\([\s\S])", r"\1", r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert by_span == [t.text for t in r.t if t.trained]


# 9 ---------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), 42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes_equal_brute_force(spark):
    rnd = random.Random(8)
    words = ["w%d" % i for i in range(300)]
    texts = []
    for _ in range(30):
        t = [rnd.choice(words) for _ in range(rnd.choice([2, 30, 200]))]
        for _ in range(6):
            texts.append(" ".join(t))
            t = list(t)
            t[rnd.randrange(len(t))] = rnd.choice(words)
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + ODD
    got = simhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{f:016x}") for (i, _), f in zip(rows, fps))
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min(label[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(rows))]
        if new == label:
            break
        label = new
    least = {k: min((i for (i, _), x in zip(rows, label) if x == k and i is not None), default=None) for k in set(label)}
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, least[k]) for (i, _), k in zip(rows, label))
    assert simhash.near_duplicate_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("settings_", [{}, {"crowded": 3, "block": 10**6}, {"crowded": 10, "block": 40}])
def test_hamming_links_of_a_dense_family(spark, settings_):
    rnd = random.Random(3)
    hot, fps = rnd.getrandbits(63), set()
    for _ in range(400):
        x = hot
        for _ in range(rnd.randrange(5)):
            x ^= 1 << rnd.randrange(30 if rnd.random() < 0.7 else 63)
        fps.add(x)
    fps = sorted(fps)
    links = {(r.src, r.dst) for r in simhash.hamming_links(spark.createDataFrame([(x,) for x in fps], "fp long"), **settings_).collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in links)

    def parts(edges):
        p = {x: x for x in fps}

        def find(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            p[max(a, b)] = min(a, b)
        return {x: find(x) for x in fps}

    assert parts(links) == parts((a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3)


def test_near_dedup_keeps_one_of_each_group(spark, odd):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(900)]
    rows, groups = [], []
    for g in range(25):
        base = [rnd.choice(words) for _ in range(300)]
        ids = []
        for c in range(5):
            t = list(base)
            for _ in range(c):
                t[rnd.randrange(300)] = rnd.choice(words)
            ids.append(len(rows))
            rows.append((len(rows), " ".join(t)))
        groups.append(ids)
    clean = [(1000 + i, " ".join(rnd.choice(words) for _ in range(120))) for i in range(60)]
    df = spark.createDataFrame(rows + clean + [rows[0], rows[0]], "doc_id long, text string").withColumn("node", F.lit(1))
    kept = near_dedup.without_near_duplicates(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == [g[0] for g in groups] + [c[0] for c in clean]
    left = Counter((r.doc_id, r.text) for r in near_dedup.without_near_duplicates(odd).collect())
    assert left == Counter([(1, "a b c d"), (2, None), (None, "x"), (5, LONG), (6, ODD[7][1])])
    assert near_dedup.without_near_duplicates(odd.limit(0)).count() == 0


def kept_by_brute_force(texts, width=5, similarity=0.8):
    """Positions of the first text of each group, all pairs compared."""
    sets = [{tuple(t[i : i + width]) for i in range(max(1, len(t) - width + 1))} for t in map(str.split, texts)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and (n := len(sets[i] & sets[j])) >= similarity * (len(sets[i]) + len(sets[j]) - n):
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    return sorted(set(group))


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in near_dedup.without_near_duplicates(df).collect())


@pytest.mark.parametrize("kind", ["permutations", "template", "template, unknown as common"])
def test_near_dedup_in_crowds_of_unlike_texts(spark, kind, monkeypatch):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(120)]
    fixed, texts = " ".join(words[:60]), []
    if "unknown" in kind:
        monkeypatch.setattr(near_dedup, "SAMPLED", 2**62)
    for _ in range(150):
        base = rnd.sample(words, 120) if kind == "permutations" else [f"{w}x{rnd.randrange(400)}" for w in words[60:]]
        texts += [" ".join(base), " ".join(base[:-2] + ["end"])]
    if kind != "permutations":
        texts = [f"{fixed} {t}" for t in texts]
    rnd.shuffle(texts)
    want = kept_by_brute_force(texts)
    assert len(want) == 150 and kept(spark, texts) == want


def parts_of(n, edges):
    label = list(range(n))
    for a, b in edges:
        lo, hi = sorted((label[a], label[b]))
        label = [lo if x == hi else x for x in label]
    return label


def test_crowded_buckets_connect_all_that_is_possible(spark):
    rnd = np.random.default_rng(13)
    base = rnd.integers(-(2**62), 2**62, near_dedup.WORDS)
    sig = np.array([[x ^ int(sum(1 << int(b) for b in rnd.choice(62, k, False))) for x in base] for k in rnd.integers(0, 31, 90)], np.int64)
    nodes = spark.createDataFrame([(i, 100, [int(x) for x in s]) for i, s in enumerate(sig)], "node long, size int, signature array<long>")
    seats = spark.createDataFrame([(5, i, 100, 0) for i in range(90)], "key long, node long, size int, at int")
    clusters = spark.createDataFrame([(i, 0) for i in range(10)], "node long, cluster long")
    far = lambda i, j: int(np.bitwise_count((sig[i] ^ sig[j]).view(np.uint64)).sum())
    inner = [(0, i) for i in range(10)]
    possible = {(i, j) for i in range(90) for j in range(i) if far(i, j) <= near_dedup.POSSIBLE}
    want = parts_of(90, [*inner, *possible])
    assert 1 < len(set(want)) < 80
    for crowded, block in ((1000, 0), (20, 7), (20, 40), (20, 2048)):
        got = [(r.a, r.b) for r in near_dedup.between(seats, nodes, clusters, 0.8, crowded=crowded, block=block).collect()]
        assert parts_of(90, [*inner, *got]) == want


@pytest.mark.parametrize("shingles", [300, 2000])
def test_clusters_of_many_blocks_are_compared_in_full(spark, shingles):
    """Families whose members differ from each other more than from their middle, over many blocks."""
    rnd = random.Random(shingles)
    fresh = iter(f"v{i}" for i in range(10**6))
    texts = []
    for size in (90, 40, 3):
        base = [next(fresh) for _ in range(60)]
        for _ in range(size):
            t, at = list(base), rnd.randrange(60)
            for k in range(rnd.choice((1, 2, 3, 8))):
                t[(at + k) % 60] = next(fresh)
            texts.append(" ".join(t))
    rnd.shuffle(texts)
    want = kept_by_brute_force(texts)
    assert 3 < len(want) < 120
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.without_near_duplicates(df, shingles=shingles).collect()) == want


def test_split_by_keys_loses_no_key(spark, monkeypatch):
    from plumbline.llm import key_filter

    rows = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(1).alias("x")).unionByName(spark.createDataFrame([(None, 2)], "key string, x int"))
    keys = rows.filter("x = 1 and substr(key, 2) % 7 = 0").select("key")
    for bits in (2**27, key_filter.PAGE):
        monkeypatch.setattr(key_filter, "MOST_BITS", bits)
        maybe, no = key_filter.split_by_keys(rows, keys, "key")
        assert maybe.join(keys, "key", "left_semi").count() == keys.count() and no.join(keys, "key", "left_semi").count() == 0
        assert maybe.count() + no.count() == 5001 and maybe.count() < 1200 and no.filter("key is null").count() == 1
    assert key_filter.split_by_keys(rows, keys.limit(0), "key")[1].count() == 5001


@pytest.mark.parametrize("n", [9, 60, 300])
def test_near_dedup_finds_passages_added_cut_and_replaced(spark, n):
    rnd = random.Random(n)
    fresh = iter(f"v{i}" for i in range(10**6))
    own = lambda k: [next(fresh) for _ in range(k)]
    texts, shingles = [], n - 4
    most = shingles // 4  # shingles that may be added at 0.8
    swap = max(0, shingles // 9)  # shingles that may be replaced at 0.8
    for _ in range(60):
        base, at = own(n), rnd.randrange(5, max(6, n - swap - 5))
        copies = [base + own(most), own(most) + base, base[: n - shingles // 5], base[shingles // 5 :], base[: n - swap] + own(swap), base[:at] + own(max(0, swap - 4)) + base[at + max(0, swap - 4) :]]
        copies += [base + own(most + 1), base[: n - swap - 1] + own(swap + 1)]  # just below
        texts += [" ".join(t) for t in (base, rnd.choice(copies))]
    want = kept_by_brute_force(texts)
    assert 60 < len(want) < 120 and kept(spark, texts) == want


# 10 --------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def codecs():
    from tokenizers import Tokenizer

    path = default_tokenizer()
    return bpe_automaton.Codec(bpe_automaton.load_tokenizer(path)), Tokenizer.from_file(path)


TEXTS = st.one_of(st.text(), st.text(alphabet="ab '\n\tst1<|endoftext|>é\x85\xa0 "), st.lists(st.sampled_from(["<|endoftext|>", " the", "'ll", "  ", "aaaa", "==", "é", "١", "\u200b", "\x1c"])).map("".join))


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_bpe_equals_the_library(codecs, text):
    ours, theirs = codecs
    text = text.encode("utf-8", "ignore").decode()
    ids = theirs.encode(text, add_special_tokens=False).ids
    got = ours.encode(text)
    assert memoryview(got).cast("I").tolist() == ids if got else not ids
    assert ours.decode(got) == theirs.decode(ids, skip_special_tokens=False) == text


def test_bpe_operator_on_odd_input(spark, odd, codecs):
    rows = bpe_automaton.encode_decode(odd.withColumn("n_tokens", F.lit("clash")), default_tokenizer(), with_ids=True).collect()
    assert len(rows) == len(ODD)
    want = Counter((i, tuple(codecs[1].encode(t or "", add_special_tokens=False).ids), t or "") for i, t in ODD)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in rows) == want
    for r in rows:
        assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe_automaton.encode_decode(odd.limit(0), default_tokenizer()).count() == 0


def test_automaton_forbids_what_merges_would_join():
    vocab = {"a": 0, "b": 1, "ab": 2, "aa": 3, "aab": 4}
    m = bpe_automaton.TokenAutomaton(vocab, [("a", "b"), ("a", "a"), ("a", "ab")])
    assert not m.has_arc(0, 1) and not m.has_arc(0, 0) and not m.has_arc(0, 3) and m.has_arc(3, 0) and m.has_arc(3, 3) and not m.has_arc(0, 2)
    assert m.encode_word(b"aaaaa") == [3, 3, 0] and m.encode_word(b"aaab") == [3, 2]


# pipeline --------------------------------------------------------------------------------------

def run_pipeline(spark, folder):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def test_pipeline_equals_brute_force(spark, sf_dir, codecs):
    """Each stage by plain means: scores of operator 2, all pairs of texts, dictionaries of cells, the library's tokenizer."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    clean = {r.doc_id for r in QUERIES["op2_toxicity"](spark, sf_dir).collect() if not r.predicted}
    docs = sorted((r for r in docs if r.doc_id in clean), key=lambda r: r.doc_id)
    docs = [docs[i] for i in kept_by_brute_force(["".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "") for r in docs])]
    topic = lambda t: next((n for n, p in source_mixing.TOPICS if re.search(p, t)), "prose")
    cell = {r.doc_id: (r.source or source_mixing.NONE, r.lang or source_mixing.NONE, topic(r.text or "")) for r in docs}
    tokens = Counter()
    for r in docs:
        tokens[cell[r.doc_id]] += len(re.findall(r"[^ \t\r\n]+", r.text or ""))
    total, weight = sum(tokens.values()), {c: 0.7 * n for c, n in tokens.items()}
    level = lambda of: [sum(of[c] for c in tokens if c[m] == v) for m in range(3) for v in sorted({c[m] for c in tokens})]
    names = [(m, v) for m in range(3) for v in sorted({c[m] for c in tokens})]
    have = dict(zip(names, level(tokens)))
    goal = {(m, v): 0.7 * total * have[m, v] ** 0.8 / sum(have[k] ** 0.8 for k in names if k[0] == m) for m, v in names}
    for _ in range(20):
        for m in range(3):
            now = Counter()
            for c, w in weight.items():
                now[c[m]] += w
            weight = {c: min(w * (goal[m, c[m]] / now[c[m]] if now[c[m]] else 1.0), tokens[c]) for c, w in weight.items()}
    luck = lambda i: int(hashlib.md5(f"42|{i}".encode()).hexdigest()[:8], 16) / 2**32
    docs = [r for r in docs if luck(r.doc_id) < (round(weight[cell[r.doc_id]] / tokens[cell[r.doc_id]], 9) if tokens[cell[r.doc_id]] else 1.0)]
    want = {}
    for r in docs:
        ids = codecs[1].encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run_pipeline(spark, sf_dir).collect()}
    assert got == want and 50 < len(got) < len(clean)


def test_pipeline_on_odd_and_empty_tables(spark, odd, tmp_path):
    """Every stage gets nulls, repeats, empty and very long texts and extra columns; then nothing at all."""
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        at = docs
        for stage, function in corpus_pipeline.STAGES:
            at = function(spark, at, folder)
            assert stage == "bpe" or at.columns == docs.columns
        kept = [r.doc_id for r in run_pipeline(spark, folder).collect()]
        assert set(kept) <= {1, 2, None, 5, 6} and len(kept) == len(set(kept)) and (name == "odd") == bool(kept)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test-stage")
        assert k == 3 or docs.columns == columns
        n, before = docs.count(), n
        assert n <= before
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    for r in docs.collect():
        assert r.n_tokens == len(t.encode(texts[r.doc_id], add_special_tokens=False).ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
