"""Phrase collocations from weighted acyclic automata of n-gram counts.

1. Shards. Each task counts n-grams of up to three words until it has seen some number of words,
   sorts them, cuts them at the bounds of prefix ranges, and builds a count transducer of each
   piece: states whose n-grams have passed are frozen and found in a register, equal ones once,
   and every arc carries the count of the n-gram that ends there.
2. Union. The transducers of a range meet; their n-grams are merged and the weights summed.
   Phrases below the least count go; they can be neither candidates nor parts of one.
3. Composition. A range writes the parts of its candidates as acceptors, one for each range that
   holds some of them; composed with that range's transducer they come back with the counts. With
   a two-word part goes the count of the longer candidate around it, which tells who is dropped.
4. Scores are exact integers. Each range gives its best phrases of each language, of which few
   are left to be ranked together.

Ranges are cut between whole n-grams, so a frequent word fills many ranges, and a range is asked
at most once by each other range about any part, however many candidates hold it.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize

FLUSH_WORDS = 1_000_000  # words of a shard
SLICE = 1 << 17  # n-grams added to an automaton at once
SAMPLE_BYTES, SAMPLES = 1 << 20, 8  # one n-gram is looked at in so many bytes of text; so many of them make a range
MOST_RANGES = 16_384
COUNTS, ASKED, ANSWERED, LONGER = range(4)

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
_CODEC = pa.Codec("zstd", compression_level=1)


def tokens(data: bytes) -> list[bytes]:
    """Words, with a line feed between pieces, and empty words where several delimiters meet."""
    return data.translate(_FOLD).replace(b"\n", b" \n ").split(b" ")


class Packing:
    """N-grams of up to three symbols (from 1; 0: none) as sortable keys."""

    def __init__(self, symbols: int):
        self.bits = max(int(symbols).bit_length(), 1)

    def pack(self, w) -> np.ndarray:
        """Keys of three rows of symbols, the first of which is an array."""
        if 3 * self.bits <= 63:
            keys = w[0].astype(np.int64) << self.bits
            keys |= w[1]
            keys <<= self.bits
            keys |= w[2]
            return keys
        return np.ascontiguousarray(np.stack(np.broadcast_arrays(*w)).T.astype(">u4")).view("S12").ravel()  # very large vocabularies

    def unpack(self, keys: np.ndarray) -> np.ndarray:
        if 3 * self.bits <= 63:
            low = (1 << self.bits) - 1
            return np.stack([(keys >> k * self.bits & low).astype(np.int32) for k in (2, 1, 0)])
        return keys.view(">u4").reshape(-1, 3).T.astype(np.int32)


def merged(keys: np.ndarray, weights: np.ndarray | None = None, combine: np.ufunc = np.add) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with their combined weights, or how often they occur."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    total = np.diff(np.append(at, len(keys))) if weights is None else combine.reduceat(weights, at) if len(at) else weights
    return keys[at], total.astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


class Automaton:
    """A weighted acyclic automaton over words: arcs lie in the order of their state and symbol.

    State 0 is the end without arcs, the last state is the root. An arc's weight is that of the
    phrase that ends with it, 0 if that isn't a phrase of the automaton.
    """

    def __init__(self, words: list[bytes], degree: np.ndarray, symbol: np.ndarray, weight: np.ndarray, target: np.ndarray):
        self.words, self.degree, self.symbol, self.weight, self.target = words, degree, symbol, weight, target
        self.first = np.cumsum(degree) - degree

    @classmethod
    def of(cls, words: list[bytes], w: np.ndarray, weights: np.ndarray) -> Automaton:
        """From sorted different n-grams ``w`` (three rows of symbols from 1, in the order of ``words``)."""
        used = np.zeros(len(words) + 1, np.int64)
        used[w.ravel()] = 1
        used[0] = 0
        kept = np.flatnonzero(used)
        used[kept] = np.arange(1, len(kept) + 1)
        build = _Builder()
        at = 0
        while at < w.shape[1]:  # a slice ends with the n-grams of a first word
            end = min(at + SLICE, w.shape[1])
            end = int(np.searchsorted(w[0], w[0, end - 1], "right"))
            build.add(used[w[:, at:end]], weights[at:end])
            at = end
        return cls([words[i - 1] for i in kept.tolist()], *build.finish())

    def pack(self) -> bytes:
        out = []
        for a in (np.frombuffer(b"\n".join(self.words), np.uint8), self.degree, self.symbol, self.weight, self.target):
            a = np.ascontiguousarray(a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)))
            planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
            data = _CODEC.compress(planes, asbytes=True)
            out += [struct.pack("<QQB", len(data), len(a), a.itemsize), data]
        return b"".join(out)

    @classmethod
    def words_of(cls, blob: bytes) -> list[bytes]:
        return cls._fields(blob, 1)[0]

    @classmethod
    def unpack(cls, blob: bytes) -> Automaton:
        return cls(*cls._fields(blob, 5))

    @staticmethod
    def _fields(blob: bytes, fields: int) -> list:
        arrays, at = [], 0
        for _ in range(fields):
            size, n, width = struct.unpack_from("<QQB", blob, at)
            planes = _CODEC.decompress(blob[at + 17 : at + 17 + size], n * width, asbytes=True)
            arrays.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel())
            at += 17 + size
        return [arrays[0].tobytes().split(b"\n") if len(arrays[0]) else [], *[a.astype(np.int64) for a in arrays[1:]]]

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """All phrases (three rows of symbols) and their weights, in no order."""
        state, path, out, weights = np.array([len(self.degree) - 1]), np.zeros((3, 1), np.int64), [np.zeros((3, 0), np.int64)], [np.zeros(0, np.int64)]
        for level in range(3):
            n = self.degree[state]
            before = np.cumsum(n) - n
            arc = np.repeat(self.first[state] - before, n) + np.arange(n.sum())
            path = np.repeat(path, n, axis=1)
            path[level] = self.symbol[arc]
            ends = self.weight[arc] > 0
            out.append(path[:, ends])
            weights.append(self.weight[arc][ends])
            state = self.target[arc]
        return np.concatenate(out, axis=1), np.concatenate(weights)

    @cached_property
    def _arcs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.degree)), self.degree) << 32 | self.symbol

    def weights_of(self, words: list[bytes], w: np.ndarray) -> np.ndarray:
        """Weights of the phrases ``w`` over ``words``, 0 for those that aren't in the automaton."""
        place = {x: i for i, x in enumerate(self.words, 1)}
        w = np.array([0, *(place.get(x, -1) for x in words)])[w]
        state, out, alive = np.full(w.shape[1], len(self.degree) - 1), np.zeros(w.shape[1], np.int64), np.ones(w.shape[1], bool)
        for level in range(3):
            on = np.flatnonzero(alive & (w[level] != 0))
            key = state[on] << 32 | w[level, on]
            at = np.minimum(np.searchsorted(self._arcs, key), max(len(self._arcs) - 1, 0))
            hit = (self._arcs[at] == key) & (w[level, on] > 0) if len(self._arcs) else np.zeros(len(on), bool)
            out[on] = np.where(hit, self.weight[at] if len(self._arcs) else 0, 0)
            state[on[hit]] = self.target[at[hit]]
            alive[on[~hit]] = False
        return out

    def compose(self, counts: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The phrases of this acceptor that ``counts`` has, in order: symbols of the acceptor, its own weights and those of ``counts``."""
        w, own = self.phrases()
        packing = Packing(len(self.words))
        order = np.argsort(packing.pack(w), kind="stable")
        w, own = w[:, order], own[order]
        found = counts.weights_of(self.words, w)
        return w[:, found > 0], own[found > 0], found[found > 0]


class _Builder:
    """Builds an automaton from slices of sorted n-grams; a register finds frozen states by a 128-bit signature of their arcs."""

    def __init__(self):
        self.register: dict[tuple[int, int], int] = {}
        self.degree, self.arcs, self.root = [np.zeros(1, np.int64)], [], []

    def add(self, w: np.ndarray, weights: np.ndarray) -> None:
        two = np.flatnonzero(w[1])
        pair = _runs(w[0, two], w[1, two])
        of_pair = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(two))))
        short = w[2, two] == 0
        weight2 = np.zeros(len(pair), np.int64)
        weight2[of_pair[short]] = weights[two[short]]
        three = two[~short]
        state2 = self._freeze(of_pair[~short], len(pair), w[2, three], weights[three], np.zeros(len(three), np.int64))
        single = _runs(w[0])
        of_single = np.repeat(np.arange(len(single)), np.diff(np.append(single, w.shape[1])))
        alone = w[1] == 0
        weight1 = np.zeros(len(single), np.int64)
        weight1[of_single[alone]] = weights[alone]
        state1 = self._freeze(of_single[two[pair]], len(single), w[1, two[pair]], weight2, state2)
        self.root.append((w[0, single], weight1, state1))

    def _freeze(self, owner: np.ndarray, owners: int, symbol: np.ndarray, weight: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The states of owners 0, 1, ... with these arcs, which are in order; those without any end."""
        out = np.zeros(owners, np.int64)
        if not len(owner):
            return out
        at = _runs(owner)
        arc = symbol.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + weight.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + target.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        one, two = np.add.reduceat(_mix(arc), at), np.add.reduceat(_mix(arc + np.uint64(0x27D4EB2F165667C5)), at)
        order = np.lexsort((two, one))
        new = _runs(one[order], two[order])
        which = np.empty(len(at), np.int64)
        which[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
        states, fresh, known = np.empty(len(new), np.int64), [], len(self.register)
        for i, signature in enumerate(zip(one[order[new]].tolist(), two[order[new]].tolist())):
            state = self.register.setdefault(signature, len(self.register) + 1)
            states[i] = state
            if state > known:
                fresh.append(order[new[i]])
                known = state
        fresh = np.array(fresh, np.int64)
        n = np.diff(np.append(at, len(owner)))[fresh]
        before = np.cumsum(n) - n
        arcs = np.repeat(at[fresh] - before, n) + np.arange(n.sum())
        self.degree.append(n)
        self.arcs.append((symbol[arcs], weight[arcs], target[arcs]))
        out[owner[at]] = states[which]
        return out

    def finish(self) -> list[np.ndarray]:
        root = [np.concatenate(c) if self.root else np.zeros(0, np.int64) for c in (zip(*self.root) if self.root else ((), (), ()))]
        columns = [np.concatenate([*(a[k] for a in self.arcs), root[k]]) for k in range(3)]
        return [np.concatenate([*self.degree, [len(root[0])]]), *columns]


def union(blobs: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, phrases in order and summed weights of several packed automata; some million phrases are added at once."""
    words = sorted(set().union(*(Automaton.words_of(b) for b in blobs)))
    place = {x: i for i, x in enumerate(words, 1)}
    packing, keys, weights, waiting = Packing(len(words)), [], [], 0
    for k, blob in enumerate(blobs):
        a = Automaton.unpack(blob)
        w, n = a.phrases()
        keys.append(packing.pack(np.array([0, *map(place.__getitem__, a.words)])[w]))
        weights.append(n)
        waiting += len(n)
        if waiting > 1_000_000 or k == len(blobs) - 1:
            one, n = merged(np.concatenate(keys), np.concatenate(weights))
            keys, weights, waiting = [one], [n], 0
    return words, packing.unpack(keys[0]) if keys else np.zeros((3, 0), np.int64), weights[0] if weights else np.zeros(0, np.int64)


class Ranges:
    """Prefix ranges of (language, phrase): range i begins with bound i - 1."""

    def __init__(self, bounds: list[tuple[str, bytes, bytes, bytes]]):
        self.bounds = bounds
        self.langs = [b[0] for b in bounds]

    def cuts(self, lang: str, words: list[bytes], w: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Range, start and end of the pieces of sorted phrases."""
        low, high = bisect_left(self.langs, lang), bisect_left(self.langs, lang + "\0")
        start = 0
        for i in range(low, high):
            at = self._place(self.bounds[i][1:], words, w)
            if at > start:
                yield i, start, at
            start = at
        if w.shape[1] > start:
            yield high, start, w.shape[1]

    @staticmethod
    def _place(bound: tuple[bytes, ...], words: list[bytes], w: np.ndarray) -> int:
        """Where phrases not before the bound begin."""
        a, b = 0, w.shape[1]
        for level, word in enumerate(bound):
            if not word:
                return a
            i = bisect_left(words, word)
            exact = i < len(words) and words[i] == word
            column = w[level, a:b]
            a, b = a + int(np.searchsorted(column, i + 1)), a + int(np.searchsorted(column, i + 1, "right"))
            if not exact:
                return a
        return a


def sampled_bounds(docs: DataFrame, sample_bytes: int, samples: int) -> list[tuple[str, bytes, bytes, bytes]]:
    """Bounds of ranges of about as many n-grams, from one n-gram in each ``sample_bytes`` of text; they affect the balance alone."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
        for batch in batches:
            rows = []
            for lang, text, luck in zip(*(batch.column(k).to_pylist() for k in range(3))):
                seen = [t for t in tokens(text) if t]
                for k in range(len(text) // sample_bytes + 1 if seen else 0):
                    at = (luck + k * 0x9E3779B97F4A7C15) % len(seen)
                    gram = (b"\n".join(seen[at : at + 3]).split(b"\n\n")[0].split(b"\n") + [b"", b""])[:3]
                    if gram[0]:
                        rows.append((lang, *gram))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)

    luck = F.pmod(F.xxhash64("text"), F.lit(sample_bytes))
    grams = materialize(docs.filter(luck < F.octet_length("text")).select("lang", "text", F.xxhash64("text", F.lit(1)).alias("luck")).mapInArrow(look, "lang string, a binary, b binary, c binary"), "bounds")
    n = grams.count()
    if n > MOST_RANGES * samples:
        grams = grams.filter(F.pmod(F.xxhash64("a", "b", "c", "lang"), F.lit(1_000_000)) < F.lit(int(1e6 * MOST_RANGES * samples / n)))
    rows = sorted((r.lang.encode(), bytes(r.a), bytes(r.b), bytes(r.c)) for r in grams.collect())  # at most MOST_RANGES * samples, or nearly
    return [(b[0].decode(), *b[1:]) for b in sorted(set(rows[samples - 1 :: samples]))]


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


BLOBS = "lang string, part int, origin int, kind int, blob binary, n bigint"
_BLOBS = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("origin", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary()), ("n", pa.int64())])


def _blobs(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_BLOBS), _BLOBS)], schema=_BLOBS)


def shard_rows(texts: dict[str, list[np.ndarray]], ids: _Ids, ranges: Ranges) -> Iterator[tuple]:
    """Count transducers of a shard, cut at the ranges."""
    words = sorted(w for w in ids if w not in (b"", b"\n"))
    rank = np.zeros(len(ids), np.int32)
    rank[[ids[w] for w in words]] = np.arange(1, len(words) + 1)
    rank[ids[b""]] = -1
    packing = Packing(len(words))
    for lang, arrays in texts.items():
        r = rank[np.concatenate(arrays)]
        r = r[r >= 0]
        there = r > 0
        two = there[:-1] & there[1:]
        three = two[:-1] & two[1:]
        grams = [packing.pack(g) for g in ((r[there], 0, 0), (r[:-1][two], r[1:][two], 0), (r[:-2][three], r[1:-1][three], r[2:][three]))]
        keys, n = merged(np.concatenate(grams))
        del grams, there, two, three
        w = packing.unpack(keys)
        del keys
        for part, a, b in ranges.cuts(lang, words, w):
            yield lang, part, -1, COUNTS, Automaton.of(words, w[:, a:b], n[a:b]).pack(), 0


def shard_automata(docs: DataFrame, ranges, flush_words: int) -> DataFrame:
    """Count transducers of all shards: ``lang``, ``part`` (its range) and ``blob``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = lambda: ({}, _Ids({b"": 0, b"\n": 1}), 0)
        (texts, ids, seen), known = fresh(), ranges.value
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = tokens(text.as_py())
                parts.append(b"\n")
                texts.setdefault(lang, []).append(np.fromiter(map(ids.__getitem__, parts), np.int32, len(parts)))
                seen += len(parts)
                if seen >= flush_words:
                    yield from _blobs(list(shard_rows(texts, ids, known))).to_batches()
                    texts, ids, seen = fresh()
        if texts:
            yield from _blobs(list(shard_rows(texts, ids, known))).to_batches()

    return docs.mapInArrow(count, BLOBS)


def _parts(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts into which candidates can be cut; with two-word parts the candidate's count, with words 1."""
    none = np.zeros(w.shape[1], np.int64)
    long = w[2] > 0
    one = [np.stack([c, none, none]) for c in (w[0], np.where(long, w[2], w[1]))]
    two = [np.stack([a, b, none])[:, long] for a, b in ((w[0], w[1]), (w[1], w[2]))]
    return np.concatenate([*one, *two], axis=1), np.concatenate([np.ones(2 * w.shape[1], np.int64), n[long], n[long]])


def _summed(ranges, least: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        lang, part = key[0].as_py(), key[1].as_py()
        words, w, n = union(group.column("blob").to_pylist())
        total = int(n[w[1] == 0].sum())
        w, n = w[:, n >= least], n[n >= least]
        rows = [(lang, part, part, COUNTS, Automaton.of(words, w, n).pack(), total)]
        asked, longer = _parts(w[:, w[1] > 0], n[w[1] > 0])
        packing = Packing(len(words))
        keys, longer = merged(packing.pack(asked), longer, np.maximum)
        asked = packing.unpack(keys)
        for to, a, b in ranges.value.cuts(lang, words, asked):
            rows.append((lang, to, part, ASKED, Automaton.of(words, asked[:, a:b], longer[a:b]).pack(), 0))
        return _blobs(rows)

    return run


def _composed(key: tuple, group: pa.Table) -> pa.Table:
    """Answers to what ranges ask, and for two-word phrases the largest count of a longer candidate."""
    lang, part = key[0].as_py(), key[1].as_py()
    kinds, origins = group.column("kind").to_pylist(), group.column("origin").to_pylist()
    counts = Automaton.unpack(group.column("blob")[kinds.index(COUNTS)].as_py())
    place, rows, around = {x: i for i, x in enumerate(counts.words, 1)}, [], []
    for kind, origin, blob in zip(kinds, origins, group.column("blob")):
        if kind == ASKED:
            acceptor = Automaton.unpack(blob.as_py())
            w, longer, found = acceptor.compose(counts)
            rows.append((lang, origin, part, ANSWERED, Automaton.of(acceptor.words, w, found).pack(), 0))
            two = w[1] > 0
            around.append((np.array([0, *(place.get(x, 0) for x in acceptor.words)])[w[:, two]], longer[two]))
    if around:
        packing = Packing(len(counts.words))
        keys, longer = merged(packing.pack(np.concatenate([w for w, _ in around], axis=1)), np.concatenate([n for _, n in around]), np.maximum)
        rows.append((lang, part, part, LONGER, Automaton.of(counts.words, packing.unpack(keys), longer).pack(), 0))
    return _blobs(rows)


PHRASES = "lang string, part int, phrase string, a bigint, l bigint, r bigint, score bigint"
_PHRASES = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("phrase", pa.string()), *[(c, pa.int64()) for c in ("a", "l", "r", "score")]])


def exact_scores(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """floor(1000000 * a * a / (l * r)) in integers of any size; at most 1000000, since a part is as frequent as its phrase."""
    wide = a.astype(object)
    return (1_000_000 * wide * wide // (left.astype(object) * right.astype(object))).astype(np.int64) if len(a) else np.zeros(0, np.int64)


def _scored(top: int, drop_share: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        lang, part = key[0].as_py(), key[1].as_py()
        by_kind: dict[int, list[bytes]] = {k: [] for k in range(4)}
        for kind, blob in zip(group.column("kind").to_pylist(), group.column("blob")):
            by_kind[kind].append(blob.as_py())
        counts = Automaton.unpack(by_kind[COUNTS][0])
        w, a = counts.phrases()
        w, a = w[:, w[1] > 0], a[w[1] > 0]
        if by_kind[LONGER]:
            longer = Automaton.unpack(by_kind[LONGER][0]).weights_of(counts.words, w)
            stay = (w[2] > 0) | (longer == 0) | (100 * longer < drop_share * a)
            w, a = w[:, stay], a[stay]
        words, answers, found = union(by_kind[ANSWERED])
        parts = Automaton.of(words, answers, found)
        count = lambda *c: parts.weights_of(counts.words, np.stack([*c, *[np.zeros(w.shape[1], np.int64)] * (3 - len(c))]))
        left, right = count(w[0]), np.where(w[2] > 0, count(w[1], w[2]), count(w[1]))
        score = exact_scores(a, left, right)
        long = np.flatnonzero(w[2])
        left2, right2 = count(w[0], w[1])[long], count(w[2])[long]
        score2 = exact_scores(a[long], left2, right2)
        lower = score2 < score[long]
        for mine, other in ((left, left2), (right, right2), (score, score2)):
            mine[long[lower]] = other[lower]
        spelled = [b" ".join(counts.words[i - 1] for i in gram if i) for gram in w.T.tolist()]
        best = sorted(range(len(spelled)), key=lambda i: (-score[i], -a[i], spelled[i]))[:top]
        columns = {"lang": [lang] * len(best), "part": [part] * len(best), "phrase": [spelled[i].decode() for i in best], "a": a[best], "l": left[best], "r": right[best], "score": score[best]}
        return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in _PHRASES], schema=_PHRASES)

    return run


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, drop_share: int = 50, flush_words: int = FLUSH_WORDS, sample_bytes: int = SAMPLE_BYTES, samples: int = SAMPLES) -> DataFrame:
    """The ``top`` phrases of two or three words of each language by their score: how much more often they occur than their parts suggest.

    Returns ``lang``, ``rank`` (from 1), ``phrase``, ``a`` (its count), ``l`` and ``r`` (counts of
    the parts at its lowest-scoring cut), ``n`` (words of the language) and ``score``. Phrases that
    occur fewer than ``least`` times are no candidates; a candidate goes if a longer one around it
    occurs in ``drop_share`` percent of its places or more.

    Null texts count as empty, null languages as ``und``. Repeated rows count as often as they
    occur. A text is held whole while its words are counted. Ties are ordered by count and phrase
    (UTF-8 bytes). Other columns are left out, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))
    ranges = docs.sparkSession.sparkContext.broadcast(Ranges(sampled_bounds(rows, sample_bytes, samples)))  # at most MOST_RANGES bounds
    place = ["lang", "part"]
    asked = materialize(shard_automata(rows, ranges, flush_words).groupBy(*place).applyInArrow(_summed(ranges, least), BLOBS), "phrase-counts")
    counts = asked.filter(F.col("kind") == COUNTS)
    answered = asked.groupBy(*place).applyInArrow(_composed, BLOBS)
    best = counts.unionByName(answered).groupBy(*place).applyInArrow(_scored(top, drop_share), PHRASES)
    order = F.desc("score"), F.desc("a"), "phrase"
    best = best.withColumn("batch", F.col("part") % 64).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "batch").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(counts.groupBy("lang").agg(F.sum("n").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
