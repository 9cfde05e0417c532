"""Automata against dictionaries of counts, and collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import collocations as co


def made_grams(seed, vocabulary, n):
    rnd = random.Random(seed)
    words = sorted({bytes(rnd.choices(b"abc\xc3\xa9-", k=rnd.randint(1, 4))) for _ in range(vocabulary)})
    grams = Counter()
    for _ in range(n):
        size = rnd.randint(1, 3)
        grams[tuple(int(rnd.triangular(1, len(words), 1)) for _ in range(size)) + (0,) * (3 - size)] += rnd.choice([1, 1, 1, 7, 10**12])
    return words, grams


def automaton(words, grams):
    keys = sorted(grams)
    return co.Automaton.of(words, np.array(keys, np.int64).reshape(-1, 3).T, np.array([grams[k] for k in keys], np.int64))


def language(a):
    w, n = a.phrases()
    return {tuple(a.words[i - 1] for i in g if i): int(k) for g, k in zip(w.T.tolist(), n)}


@pytest.mark.parametrize("slice_", [1, 10, 1 << 17])
@pytest.mark.parametrize("n", [0, 1, 40, 3000])
def test_automaton_has_the_phrases_it_was_built_from(monkeypatch, slice_, n):
    monkeypatch.setattr(co, "SLICE", slice_)
    words, grams = made_grams(n, 60, n)
    a = automaton(words, grams)
    want = {tuple(words[i - 1] for i in g if i): k for g, k in grams.items()}
    assert language(a) == want
    again = co.Automaton.unpack(a.pack())
    assert language(again) == want and again.words == sorted(again.words)
    asked = [*want, (b"nowhere",), (b"a", b"nowhere")]
    symbols = sorted({w for g in asked for w in g})
    w = np.array([[symbols.index(x) + 1 for x in g] + [0] * (3 - len(g)) for g in asked], np.int64).reshape(-1, 3).T
    assert again.weights_of(symbols, w).tolist() == [want.get(g, 0) for g in asked]


def test_equal_states_are_stored_once():
    words = [b"a", b"b", b"c", b"d"]
    grams = {(i, j, 4): 1 for i in (1, 2, 3) for j in (1, 2, 3)}
    a = automaton(words, grams)
    assert len(a.degree) == 4 and len(a.symbol) == 1 + 3 + 3  # end, (d), (a b c), root


@pytest.mark.parametrize("bits", [21, 22])
def test_union_sums_and_composition_looks_up(monkeypatch, bits):
    if bits == 22:  # the keys of very large vocabularies
        monkeypatch.setattr(co.Packing, "__init__", lambda self, n: setattr(self, "bits", 22))
    made = [made_grams(s, 30 + 10 * s, 400) for s in range(4)]
    total = Counter()
    for words, grams in made:
        for g, k in grams.items():
            total[tuple(words[i - 1] for i in g if i)] += k
    words, w, n = co.union([automaton(*m).pack() for m in made])
    assert {tuple(words[i - 1] for i in g if i): int(k) for g, k in zip(w.T.tolist(), n)} == total
    one, whole = automaton(*made[0]), co.Automaton.of(words, w, n)
    found, own, summed = one.compose(whole)
    got = {tuple(one.words[i - 1] for i in g if i): (int(a), int(b)) for g, a, b in zip(found.T.tolist(), own, summed)}
    assert got == {g: (k, total[g]) for g, k in language(one).items()}


def test_scores_are_exact_beyond_64_bits():
    a, left, right = (np.array([x]) for x in (3_000_000_019, 3_000_000_021, 4_000_000_007))
    assert co.exact_scores(a, left, right).tolist() == [10**6 * 3_000_000_019**2 // (3_000_000_021 * 4_000_000_007)]


def brute_force(rows, least=10, top=2000, share=50):
    langs = {}
    for lang, text in rows:
        langs.setdefault("und" if lang is None else lang, []).append(text or "")
    out = []
    for lang, texts in langs.items():
        f, n = Counter(), 0
        for text in texts:
            folded = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
                words = re.findall("[^ \t]+", piece)
                n += len(words)
                f.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q for p, b in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if (q := p[i:j]) != p and 100 * b >= share * candidates[q]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def made_rows(seed, n):
    rnd = random.Random(seed)
    words = ["Of", "the", "new", "york", "É x", "\x01odd", "a-b", "city", "🙂", "und"]
    sep = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \r\n", "!"]
    text = lambda: "".join(w + rnd.choice(sep) for w in rnd.choices(words, [9, 9, 4, 4, 2, 1, 1, 3, 1, 1], k=rnd.randint(0, 40)))
    rows = [(rnd.choice(["en", "de", None, "und", ""]), rnd.choice([text(), text(), "New York City hall, the new york city", None])) for _ in range(n)]
    return rows + [rows[0]] * 30


@pytest.mark.parametrize("flush, sample, samples, top", [(10**6, 10**9, 8, 2000), (50, 200, 1, 2000), (500, 60, 2, 7)])
def test_collocations_equal_brute_force(spark, flush, sample, samples, top):
    rows = made_rows(flush, 150)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("part", "kind", "blob", "rank", "n", "luck", "batch")})
    got = co.collocations(df, top=top, flush_words=flush, sample_bytes=sample, samples=samples)
    assert sorted(map(tuple, got.collect())) == brute_force(rows, top=top)


def test_odd_texts(spark):
    schema = "lang string, text string"
    assert co.collocations(spark.createDataFrame([], schema)).count() == 0
    assert co.collocations(spark.createDataFrame([(None, None), ("en", ""), ("en", " \t.,")], schema)).count() == 0
    long = [("en", "one two three " * 50_000), (None, "x y " * 9), (None, "x y")]
    assert sorted(map(tuple, co.collocations(spark.createDataFrame(long, schema), flush_words=1000).collect())) == brute_force(long)


def test_query_over_the_documents(spark, sf_dir):
    from plumbline.llm.registry import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()]
    assert sorted(map(tuple, QUERIES["op11_phrase_collocations"](spark, sf_dir).collect())) == brute_force(rows)
