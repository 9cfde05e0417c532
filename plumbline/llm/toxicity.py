"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to symbols: insult, threat, target, negation, reporting, quote, other. Five small
weighted transducers read the symbols of a clause in a cascade, each reading what the one before
it writes. The first writes a target that follows a threat as a completed threat, which carries
most of the threat's weight; the second lifts insults that follow closely on others; the
remaining three raise or lower the weight of what stands in the scope of a target, of a negation,
or of reported speech. Their composition is compiled into one table of transitions, and a
clause's score is the sum of its words' weights times the factors on its path. An open quotation
carries on into the next clause, up to the end of its line. A document's score is a logistic
function of its clauses' scores.

What an insult looks like is learned from labelled documents: whole words and word beginnings
that stand in toxic documents far more often than in others, in varied surroundings (so that
copies of one toxic document do not teach their other words). Everything learned comes from a
sample of at most ``max_labelled`` labelled documents, which bounds the patterns as well.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize
from plumbline.llm.common import map_batches, release

TOKEN = re.compile(r"[^\W\d_]+|[.!?;,\n\"“”«»]")
BOUNDARY = frozenset(".!?;\n")
INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER = SYMBOLS = range(7)
COMPLETED = 7  # written, never read from text: a target that completes a threat

#: Seed words of the grammar; learned patterns come on top.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid imbecile dumbass scumbag bastard asshole retard loser losers worthless pathetic disgusting".split(),
    THREAT: "kill murder destroy hurt stab strangle shoot".split(),
    TARGET: "you your yours he she they them him her people these those du ihr sie tu vous toi usted ustedes ellos".split(),
    NEGATION: "not never isn aren wasn don doesn nobody no kein keine nicht nie jamais pas nunca".split(),
    REPORT: "said says say wrote writes claimed claims quoted quotes reported called sagte schrieb dit dijo".split(),
    QUOTE: ['"', "“", "”", "«", "»"],
}
SEED_WEIGHT = {INSULT: 2.0, THREAT: 2.0}
#: Shares of a threat's weight: what the threatening word has by itself, and what a target adds.
THREATENING, COMPLETING = 0.25, 0.75


@dataclass(frozen=True)
class Transducer:
    """``moves[state, symbol]`` is the next state, the symbol written and its factor; a symbol without a move is written as it is, at factor 1."""

    moves: dict = field(default_factory=dict)
    start: int = 0

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.moves.get((state, symbol), (state, symbol, 1.0))


def threats(length: int) -> Transducer:
    """A threatening word counts for little by itself; a target among the next ``length`` words is written as its completion."""
    moves = {}
    for state in range(length + 1):
        for symbol in SYMBOLS:
            if symbol == THREAT:
                moves[state, symbol] = (length, THREAT, THREATENING)
            elif state and symbol == TARGET:
                moves[state, symbol] = (0, COMPLETED, COMPLETING)
            elif state:
                moves[state, symbol] = (state - 1, symbol, 1.0)
    return Transducer(moves)


def insults(length: int, factor: float) -> Transducer:
    """An insult within ``length`` words of another counts by ``factor``."""
    moves = {}
    for state in range(length + 1):
        for symbol in (*SYMBOLS, COMPLETED):
            if symbol == INSULT:
                moves[state, symbol] = (length, INSULT, factor if state else 1.0)
            elif state:
                moves[state, symbol] = (state - 1, symbol, 1.0)
    return Transducer(moves)


def scope(opening: tuple[int, ...], length: int, factors: dict[int, float], closing: tuple[int, ...] = ()) -> Transducer:
    """After a symbol of ``opening``, those of the next ``length`` words get the given factors; one of ``closing`` ends that early."""
    moves = {}
    for state in range(length + 1):
        for symbol in (*SYMBOLS, COMPLETED):
            factor = factors.get(symbol, 1.0) if state else 1.0
            if symbol in opening:
                moves[state, symbol] = (length, symbol, factor)
            elif state:
                moves[state, symbol] = (0 if symbol in closing else state - 1, symbol, factor)
    return Transducer(moves)


def reported_speech(factor: float) -> Transducer:
    """Within quotes, or after a reporting word up to the end of the clause, what is said counts by ``factor``."""
    moves = {}
    for state in (0, 1, 2):  # 0 plain, 1 after a reporting word, 2 within quotes
        moves[state, REPORT] = (max(state, 1), REPORT, 1.0)
        moves[state, QUOTE] = ({0: 2, 1: 2, 2: 0}[state], QUOTE, 1.0)
        for symbol in (INSULT, THREAT, COMPLETED):
            moves[state, symbol] = (state, symbol, factor if state else 1.0)
    return Transducer(moves)


def compose(*parts: Transducer) -> list[list[tuple[int, int, float]]]:
    """The cascade of the transducers as one table, from state 0 on: (state, symbol) to (state, symbol written at last, product of factors)."""
    start = tuple(t.start for t in parts)
    number, table, queue = {start: 0}, [], deque([start])
    while queue:
        state = queue.popleft()
        row = []
        for symbol in SYMBOLS:
            to, factor = [], 1.0
            for t, s in zip(parts, state):
                at, symbol, f = t.step(s, symbol)
                to.append(at)
                factor *= f
            if (to := tuple(to)) not in number:
                number[to] = len(number)
                queue.append(to)
            row.append((number[to], symbol, factor))
        table.append(row)
    return table


def cascade() -> tuple[Transducer, ...]:
    return (
        threats(3),
        insults(2, 1.25),
        scope((TARGET, COMPLETED), 4, {INSULT: 1.5, THREAT: 1.5}, closing=(REPORT,)),  # who speaks is no target
        scope((NEGATION,), 2, {INSULT: 0.5, THREAT: 0.3, COMPLETED: 0.3}),
        reported_speech(0.7),
    )


def grammar() -> list[list[tuple[int, int, float]]]:
    return compose(*cascade())


def beginnings(word: str) -> list[str]:
    """Patterns that a word fits: beginnings of 4 to 8 letters, and the whole word marked by ``$``."""
    return [word[:k] for k in range(4, min(8, len(word)) + 1)] + ([word + "$"] if len(word) >= 3 else [])


class Grammar:
    """Compiled patterns and transitions; ``features`` of one text."""

    def __init__(self, patterns: dict[str, float], kept_words: int = 100_000):
        self.table = grammar()
        self.patterns = patterns
        self.symbols = {w: s for s, words in SEEDS.items() for w in words}
        self.quoted = self.table[0][QUOTE][0]
        self.kept_words = kept_words
        self.memo: dict[str, float] = {}

    def _weight(self, token: str) -> float:
        best = max((self.patterns[p] for p in beginnings(token) if p in self.patterns), default=0.0)
        return best or SEED_WEIGHT.get(self.symbols.get(token), 0.0)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Log of 1 + the sum, the largest clause score, and log of 1 + the sum for each hundred words."""
        tokens = TOKEN.findall((text or "").lower())
        new = set(tokens).difference(self.memo)
        if new:
            if len(self.memo) + len(new) > self.kept_words:
                self.memo.clear()
                new = set(tokens)
            for t in new:
                self.memo[t] = self._weight(t)
        weights = list(map(self.memo.__getitem__, tokens))
        total = top = 0.0
        done, read, quoted = -1, 0, False  # ``quoted``: whether a quotation of this line is open at token ``read``
        for i, w in enumerate(weights):
            if w and i > done:
                a, b = i, i
                while a > 0 and tokens[a - 1] not in BOUNDARY:
                    a -= 1
                while b + 1 < len(tokens) and tokens[b + 1] not in BOUNDARY:
                    b += 1
                done = b
                for t in tokens[read:a]:
                    quoted = t != "\n" and quoted != (self.symbols.get(t) == QUOTE)
                read = a
                score = self.clause(tokens[a : b + 1], weights[a : b + 1], quoted)
                total += score
                top = max(top, score)
        return float(np.log1p(total)), min(top, 10.0), float(np.log1p(100 * total / (len(tokens) + 20)))

    def clause(self, tokens: list[str], weights: list[float], quoted: bool = False) -> float:
        """The sum of weights times factors on the path; a completed threat has the weight of the threatening word."""
        state, score, threat, table, symbols = self.quoted if quoted else 0, 0.0, 0.0, self.table, self.symbols
        for token, weight in zip(tokens, weights):
            symbol = symbols.get(token, OTHER)
            if weight and symbol not in (INSULT, THREAT):
                symbol = INSULT
            if symbol == THREAT:
                threat = weight
            state, written, factor = table[state][symbol]
            score += (threat if written == COMPLETED else weight) * factor
        return score


@dataclass
class ToxicityModel:
    patterns: dict[str, float]
    intercept: float = -4.0
    slopes: tuple[float, float, float] = (1.5, 1.0, 0.5)
    threshold: float = 0.5


def _is_learning(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def _labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """``text``, ``toxic`` and ``fold`` (1 to 4) of a sample of the rows that may be learned from."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", _is_learning("doc_id")).filter("fold <> 0")
    n = known.count()
    luck = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000))
    sample = known.filter(luck < int(1_000_000 * min(1.0, 0.98 * max_labelled / max(n, 1)))).limit(max_labelled)
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(sample), "doc_id")  # at most max_labelled rows


def _pattern_counts(rows: DataFrame) -> DataFrame:
    """For each pattern: documents by label and surroundings of its toxic occurrences (64 hashed bits), for folds 1-3 and for fold 4."""

    def count(batches):
        release()
        found: dict[str, list[int]] = {}

        def flush():
            cols = list(zip(*found.values()))
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=["pattern", "neg_a", "pos_a", "seen_a", "neg_b", "pos_b", "seen_b"])
            found.clear()
            return out

        cache: dict[str, list[str]] = {}
        for batch in batches:
            for text, toxic, fold in zip(batch.column(0), batch.column(1), batch.column(2)):
                tokens = TOKEN.findall((text.as_py() or "").lower())
                at = 3 if fold.as_py() == 4 else 0
                toxic = toxic.as_py() > 0
                first: dict[str, int] = {}
                for i, t in enumerate(tokens):
                    if t not in first:
                        first[t] = i
                mine: dict[str, int] = {}
                for t, i in first.items():
                    if t not in cache:
                        if len(cache) > 50_000:
                            cache.clear()
                        cache[t] = beginnings(t) if t.isalpha() else []
                    for p in cache[t]:
                        mine.setdefault(p, i)
                for p, i in mine.items():
                    row = found.get(p)
                    if row is None:
                        row = found[p] = [0] * 6
                    if toxic:
                        row[at + 1] += 1
                        near = hash_of((tokens[i - 1] if i else "") + " " + (tokens[i + 1] if i + 1 < len(tokens) else ""))
                        row[at + 2] |= -(1 << 63) if near == 63 else 1 << near
                    else:
                        row[at] += 1
                if len(found) > 100_000:
                    yield flush()
        if found:
            yield flush()

    parts = rows.select("text", "toxic", "fold").mapInArrow(count, "pattern string, neg_a bigint, pos_a bigint, seen_a bigint, neg_b bigint, pos_b bigint, seen_b bigint")
    return parts.groupBy("pattern").agg(*[F.sum(c).alias(c) for c in ("neg_a", "pos_a", "neg_b", "pos_b")], F.bit_or("seen_a").alias("seen_a"), F.bit_or("seen_b").alias("seen_b"))


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) & 63


def _patterns(counts: DataFrame, pos: str, neg: str, seen: str, n_pos: int, n_neg: int) -> dict[str, float]:
    """The patterns that tell toxic documents apart, with log odds as weights; no pattern that a kept one covers."""
    if not n_pos or not n_neg:
        return {}
    varied = F.bit_count(F.expr(seen))
    places = F.when(varied >= 64, F.lit(1e9)).otherwise(-64 * F.log(1 - varied / 64.0))
    p = F.least(F.expr(pos).cast("double"), places)
    q = F.expr(neg).cast("double")
    share = (n_pos + 0.0) / (n_pos + n_neg)
    odds = F.log((p + 0.5) / (n_pos + 1)) - F.log((q + 0.5) / (n_neg + 1))
    surprise = 2 * (p * F.log((p + 1e-9) / ((p + q) * share)) + q * F.log((q + 1e-9) / ((p + q) * (1 - share))))
    best = counts.withColumns({"p": p, "odds": odds}).filter((F.col("p") >= 3) & (F.col("odds") >= 2.0)).withColumn("g", surprise).filter("g >= 18")
    rows = sorted(best.select("pattern", "p", "odds", "g").collect(), key=lambda r: (-round(r["g"], 6), -r["pattern"].endswith("$"), -len(r["pattern"]), r["pattern"]))
    kept: dict[str, float] = {}
    for r in rows:
        word = r["pattern"].rstrip("$")
        if not any(word[:k] in kept for k in range(4, len(word) + 1)):
            kept[r["pattern"]] = min(float(r["odds"]), 5.0)
    return kept


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    design = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(design.shape[1])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty, design.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w[0], w[1:]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> ToxicityModel:
    """Learn patterns and the logistic function from documents whose crc32(doc_id) mod 5 is not 0.

    The logistic function is fitted on a fifth of these with patterns from the others, so that it
    sees patterns at their worth on new documents; then the patterns are learned from all of
    them. With fewer than five toxic documents to fit on, fixed coefficients serve.
    """
    rows = materialize(_labelled(docs, labels, max_labelled), "labelled")
    n = {(r["late"], r["bad"]): r["count"] for r in rows.groupBy((F.col("fold") == 4).alias("late"), (F.col("toxic") > 0).alias("bad")).count().collect()}
    of = lambda late, bad: n.get((late, bad), 0)
    counts = materialize(_pattern_counts(rows).filter("pos_a + pos_b >= 3"), "patterns")
    early = _patterns(counts, "pos_a", "neg_a", "seen_a", of(False, True), of(False, False))
    model = ToxicityModel(_patterns(counts, "pos_a + pos_b", "neg_a + neg_b", "seen_a | seen_b", of(False, True) + of(True, True), of(False, False) + of(True, False)))
    if of(True, True) >= 5 and of(True, False) >= 5:
        held = _features(rows.filter("fold = 4").select("toxic", "text"), "toxic", early).toPandas()
        x, y = held[["f0", "f1", "f2"]].to_numpy(), (held["toxic"] > 0).to_numpy(float)
        model.intercept, slopes = _fit_logistic(x, y)
        model.intercept, model.slopes = float(model.intercept), tuple(map(float, slopes))
    return model


def _features(rows: DataFrame, key: str, patterns: dict[str, float]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(patterns)  # learned from at most max_labelled documents

    def make():
        known = Grammar(shared.value)

        def run(batch):
            found = [known.features(t.as_py()) for t in batch.column(1)]
            return {"k": batch.column(0)} | {f"f{j}": [f[j] for f in found] for j in range(3)}

        return run

    return map_batches(rows.select(F.col(key).cast("bigint").alias("k"), "text"), "k bigint, f0 double, f1 double, f2 double", make).withColumnRenamed("k", key)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of every row.

    Only the text matters to the score. Null and empty texts have no clauses and get the score of
    that. Rows with null or repeated ids stay, one each; a null id counts as held out. An empty
    table gives no rows; other columns are ignored. Long texts are scored whole, in time linear
    in their length.
    """
    found = _features(docs.select("doc_id", "text"), "doc_id", model.patterns)
    z = F.lit(model.intercept) + sum(F.lit(s) * F.col(f"f{j}") for j, s in enumerate(model.slopes))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return found.select("doc_id", F.coalesce(_is_learning("doc_id") == 0, F.lit(True)).alias("held_out"), p.alias("score")).withColumn("predicted", (F.col("score") >= model.threshold).cast("int"))


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that are not judged toxic, with their columns and no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        release()
        model = shared.value
        known = Grammar(model.patterns)
        line = np.log(model.threshold / (1 - model.threshold))
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                good = [model.intercept + float(np.dot(model.slopes, known.features(t.as_py()))) < line for t in part.column(at)]
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
