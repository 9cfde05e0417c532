"""Document fingerprints by locally consistent parsing.

A text is parsed bottom up. At each level, runs of an equal symbol become one symbol; then
deterministic coin tossing gives every symbol a label below 8 that depends on few symbols to its
left, neighbours never sharing one; a phrase starts wherever a label exceeds both its neighbours.
A phrase's name is a hash of its symbols, and the names are the symbols of the next level. Where a
phrase starts depends on a few symbols around it alone, so equal substrings are cut alike wherever
they stand, except near their ends.

A fingerprint is the name of the whole text followed by the ``KEEP`` smallest names of its phrases
from level ``COARSE`` up (some twenty characters or longer). Texts with few of these also carry
the smallest names of shorter phrases, by which they are compared with each other.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP = 64  # names in a sketch: the likeness of two long texts is an estimate with an error of some 0.06
COARSE, FEW = 3, 24  # texts with fewer names from this level up also carry those of lower levels
LONG = 8  # further copies of a short phrase in one run count among the long ones, since a run becomes one symbol
AT_ONCE = 1 << 16  # code points parsed together

_NAME, _RUN, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Multipliers by place in a phrase; a phrase has 15 symbols at most.
PLACES = mix(np.arange(1, 33, dtype=np.uint64) * _NAME) | np.uint64(1)


#: The symbol of each code point.
CODES = mix(np.arange(1, 0x110001, dtype=np.uint64) * _NAME)


def _toss(left: int, own: int) -> int:
    """Twice the place of the lowest bit in which a label differs from its left neighbour's, plus that bit."""
    differ = left ^ own
    at = (differ & -differ).bit_length() - 1
    return 2 * at + (own >> at & 1)


#: Of labels below 128 by (left, own); the next toss of 128 labels gives 14, and of these 8.
TOSS = np.array([0 if a == b else _toss(a, b) for a in range(128) for b in range(128)], np.uint16)


def labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8 of symbols no two neighbours of which are equal; ``first`` marks symbols without a left neighbour."""
    own = x.astype(np.uint32)  # the lower half tells neighbours apart
    differ = np.empty_like(own)
    np.bitwise_xor(own[1:], own[:-1], out=differ[1:])
    heads = np.flatnonzero(first)
    differ[heads] = 1
    below = differ - np.uint32(1)
    below &= ~differ  # the bits below the lowest in which they differ
    label = np.bitwise_count(below)
    label = (label << 1 | ((own & (below + np.uint32(1))) != 0)).astype(np.uint16)
    for _ in range(2):
        pair = label.copy()
        pair[1:] |= label[:-1] << 7
        pair[heads] = label[heads] | (label[heads] ^ 1) << 7
        label = TOSS[pair]
    return label


def parse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``owner`` (place in ``texts``), ``name`` and ``level`` of all phrases, and the name of each whole text (0: empty)."""
    sizes = np.array([len(t) for t in texts])
    x = CODES[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(x) else np.zeros(0, bool)
    found, whole, level = [], np.zeros(len(texts), np.uint64), 0
    while len(x):
        level += 1
        start = first.copy()
        start[1:] |= x[1:] != x[:-1]
        if not start.all():
            at = np.flatnonzero(start)
            run = np.diff(np.append(at, len(x)))
            if level <= COARSE and len(long := np.flatnonzero(run > LONG)):
                copies = at[np.repeat(long, run[long] - LONG)]
                found.append((owner[copies], mix(x[copies] + np.uint64(level)), np.full(len(copies), COARSE, np.int8)))
            run = run.astype(np.uint64)
            x, owner, first = np.where(run > 1, mix(x[at] + run * _RUN), x[at]), owner[at], first[at]
        label = labels(x, first)
        right = np.append(label[1:], 255)
        right[:-1][first[1:]] = 255
        start = first.copy()
        start[1:] |= (label[1:] > label[:-1]) & (label[1:] > right[1:])
        at = np.flatnonzero(start)
        length = np.diff(np.append(at, len(x)))
        place = np.arange(len(x)) - np.repeat(at, length)
        x = mix(np.add.reduceat(x * PLACES[place], at) + length.astype(np.uint64) * _LENGTH + np.uint64(level))
        owner, first = owner[at], first[at]
        found.append((owner, x, np.full(len(x), level, np.int8)))
        if level >= COARSE:
            several = np.bincount(owner, minlength=len(texts))[owner] > 1
            whole[owner[~several]] = x[~several]
            x, owner, first = x[several], owner[several], first[several]
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, np.int8)]
    return *columns, whole


def _new(ordered: np.ndarray) -> np.ndarray:
    """Which entries differ from the one before."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new


def _smallest(owner: np.ndarray, name: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit names of phrases and of their repetitions, the ``KEEP`` smallest of each owner: where they start, where they end, and the names."""
    half = np.uint64(32)
    keys = np.sort(owner.astype(np.uint64) << half | name >> half)
    at = np.flatnonzero(_new(keys))
    again = np.arange(len(keys)) - np.repeat(at, np.diff(np.append(at, len(keys))))
    if len(more := np.flatnonzero(again)):  # a name's second, third... place has a name of its own
        named = mix(keys[more] << half | again[more].astype(np.uint64))
        keys[more] = keys[more] >> half << half | named >> half
        keys.sort()
        keys = keys[_new(keys)]
    start = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    return start[:-1], np.minimum(start[:-1] + KEEP, start[1:]), keys.astype(np.uint32)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text: name of the whole, sketch, and sketch of short phrases or nothing, joined by colons."""
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= AT_ONCE):
            size += len(texts[end])
            end += 1
        group = texts[at:end]
        owner, name, level, whole = parse(group)
        coarse = level >= COARSE
        sketches = _smallest(owner[coarse], name[coarse], len(group)), _smallest(owner[~coarse], name[~coarse], len(group))
        text = lambda s, i: base64.b64encode(s[2][s[0][i] : s[1][i]].astype(">u4").tobytes()).decode()
        for i in range(len(group)):
            few = sketches[0][1][i] - sketches[0][0][i] < FEW
            out.append(f"{whole[i]:016x}:{text(sketches[0], i)}:{text(sketches[1], i) if few else ''}")
        at = end
    return out


def _names(sketch: str) -> set[int]:
    return set(np.frombuffer(base64.b64decode(sketch), ">u4").tolist())


def likeness(a: str, b: str) -> float:
    """The share of their phrases, repetitions counted, that two texts have in common, by their fingerprints: 0 to 1.

    Exact where neither has more than ``KEEP``, otherwise an estimate. Equal fingerprints give 1,
    and an empty text is unlike any other.
    """
    if a == b:
        return 1.0
    (_, coarse_a, fine_a), (_, coarse_b, fine_b) = a.split(":"), b.split(":")
    x, y = (_names(fine_a), _names(fine_b)) if fine_a and fine_b else (_names(coarse_a), _names(coarse_b))
    both, union = x & y, x | y
    if both and max(len(x), len(y)) == KEEP and len(union) > KEEP:  # beyond what a full sketch reaches nothing is known
        reach = sorted(union)[KEEP - 1]
        both, union = [v for v in both if v <= reach], range(KEEP)
    return round(2 * len(both) / (len(both) + len(union)), 6) if both else 0.0


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGE = "part int, last boolean, doc_id bigint, text string"


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in map(str.split, schema.split(","))])


def _finished(rows: list[tuple[int | None, str]], following: list[str], prints: list[str], next_prints: list[str]) -> dict:
    """The result's columns, from rows, the texts that follow them, and the fingerprints of both."""
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for (_, t), n in zip(rows, following)]
    edited_prints = fingerprints(edited)
    return {
        "doc_id": [i for i, _ in rows],
        "n_chars": [len(t) for _, t in rows],
        "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
        "fingerprint": prints,
        "edited_fingerprint": edited_prints,
        "near_edited": list(map(likeness, prints, edited_prints)),
        "near_next": list(map(likeness, prints, next_prints)),
    }


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a partition but the last, each compared with its edited text and the next row."""
    target, held, held_print = _arrow(SCHEMA), None, None
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            rows, size = [], 0
            while at < batch.num_rows and size < 4 * AT_ONCE and len(rows) < 2000:
                rows.append((batch.column(0)[at].as_py(), batch.column(1)[at].as_py()))
                size += len(rows[-1][1])
                at += 1
            prints = fingerprints([t for _, t in rows])
            if held is not None:
                rows, prints = [held, *rows], [held_print, *prints]
            if len(rows) > 1:
                yield _batch(_finished(rows[:-1], [t for _, t in rows[1:]], prints[:-1], prints[1:]), target)
            held, held_print = rows[-1], prints[-1]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last row of a partition."""
    target, last = _arrow(EDGE), None
    row = lambda r, is_last: _batch({"part": r.column(2), "last": [is_last], "doc_id": r.column(0), "text": r.column(1)}, target)
    for batch in batches:
        if batch.num_rows:
            if last is None:
                yield row(batch.slice(0, 1), False)
            last = pa.RecordBatch.from_arrays([pa.array(c.slice(batch.num_rows - 1).to_pylist(), c.type) for c in batch.columns], names=batch.schema.names)
    if last is not None:
        yield row(last, True)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that end a partition, with the text that follows."""
    target = _arrow(SCHEMA)
    for batch in batches:
        for r in range(batch.num_rows):
            doc_id, text, following = (batch.column(k)[r].as_py() for k in range(3))
            prints = fingerprints([text, following])
            yield _batch(_finished([(doc_id, text)], [following], prints[:1], prints[1:]), target)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike it is to that and to the next text.

    The edited text has its last quarter (rounded down) replaced by as many code points, or all,
    from the beginning of the next document in ascending ``doc_id``; the first follows the last.
    Columns as in ``SCHEMA``; others of ``docs`` are left out, whatever their names.

    Null texts count as empty; empty texts have equal fingerprints, unlike any other. Null ids
    come first; of equal ids the order is by a hash of the text, so repeated rows follow each
    other. A single document is followed by itself. Texts of any length are parsed whole. An empty
    table gives no rows.

    Documents are brought into order by one shuffle into ranges. A range's last document needs the
    first of the next range, so these two of every range are read from the same shuffle and
    brought together; nothing else leaves its range.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    # The hash and the number spread a very frequent id over ranges; rows equal in both are equal.
    keyed = rows.withColumns({"h": F.xxhash64("text"), "n": F.monotonically_increasing_id()})
    order = F.col("doc_id").asc_nulls_first(), "h", "n"
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    within = ranged.select("doc_id", "text").mapInArrow(_neighbours, SCHEMA)
    # Two rows per range: its first and its last document, in the order of the ranges.
    in_turn = Window.orderBy("part", "last")
    edges = ranged.mapInArrow(_edges, EDGE).withColumns({"following": F.lead("text").over(in_turn), "start": F.first("text").over(in_turn)})
    across = edges.filter("last").select("doc_id", "text", F.coalesce("following", "start")).mapInArrow(_across, SCHEMA)
    return within.unionByName(across)
