"""Chroma audio fingerprints, and recordings aligned by them.

A recording (mono PCM) is cut into overlapping frames; each frame's spectrum is folded onto the 12
pitch classes. Over the image of pitch classes by time, an integral image gives the sum of any
rectangle from four corners, and 16 filters compare the sums of neighbouring rectangles. Each
filter's value is coded in two bits (Gray code), 32 bits a frame: one packed integer.

Recordings are aligned through runs of ``RUN`` equal integers. Every run that occurs in several
recordings has an anchor, its first occurrence; each recording votes for (anchor recording, time
offset), every bin of this offset histogram is tried, and the share of differing bits over the
whole overlap decides. A run in very many recordings costs one vote each, never pairs. Runs whose
recordings are still in different classes after that are compared in full, in blocks of bounded
size that pass over what is connected already and return as many alignments as connect classes.

Recordings must share a run: copies that are cut off the frames' grid, or distorted so much that
no four frames in a row stay equal, are not found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize
from plumbline.llm.common import map_batches
from plumbline.operators.graph import connected_components

RATE, FRAME, HOP, RUN = 4000, 1024, 512, 4
SEATS = 1024  # recordings of a run that a block holds, up to twice as many
LOW_HZ, HIGH_HZ = 55.0, 1760.0


def _pitch_classes() -> np.ndarray:
    """Weights that fold spectrum bins onto the 12 pitch classes."""
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    use = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    pitch = np.round(12 * np.log2(np.maximum(hz, 1) / 440.0)).astype(int) % 12
    fold = np.zeros((len(hz), 12), np.float32)
    fold[np.nonzero(use)[0], pitch[use]] = 1
    return fold


_FOLD, _WINDOW = _pitch_classes(), np.hanning(FRAME).astype(np.float32)
#: Filters by rule: kind (0 sum, 1 upper against lower half, 2 earlier against later half, 3 both crosswise), first class, classes, frames.
FILTERS = [(k % 4, (5 * k) % 9, 2 + k % 3, 2 + 2 * (k % 4)) for k in range(16)]
SPAN = max(f[3] for f in FILTERS)
_BOUNDS = np.array([-0.35, 0.0, 0.35])
_GRAY = np.array([0, 1, 3, 2], np.uint64)


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Pitch-class energies of each frame, scaled to sum 1 (0 for silence)."""
    if len(pcm) < FRAME:
        return np.zeros((0, 12), np.float32)
    out = []
    frames = np.lib.stride_tricks.sliding_window_view(pcm, FRAME)[::HOP]
    for at in range(0, len(frames), 512):
        spectrum = np.fft.rfft(frames[at : at + 512].astype(np.float32) * _WINDOW, axis=1)
        out.append((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _FOLD)
    energy = np.concatenate(out)
    total = energy.sum(1, keepdims=True)
    return np.divide(energy, total, out=np.zeros_like(energy), where=total > 1e-9)


def fingerprint(pcm: np.ndarray) -> np.ndarray:
    """One packed integer for every frame that has ``SPAN`` frames from it on."""
    image = chroma(pcm).astype(np.float64)
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    integral = np.zeros((len(image) + 1, 13))
    integral[1:, 1:] = image.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0, t1, c0, c1):
        return integral[t1, c1] - integral[t0, c1] - integral[t1, c0] + integral[t0, c0]

    packed = np.zeros(n, np.uint64)
    for kind, c, height, width in FILTERS:
        c1, cm, tm = c + height, c + height // 2, t + width // 2
        if kind == 0:
            a, b = area(t, t + width, c, c1), (area(t, t + width, 0, 12) - area(t, t + width, c, c1)) * height / (12 - height)
        elif kind == 1:
            a, b = area(t, t + width, cm, c1), area(t, t + width, c, cm)
        elif kind == 2:
            a, b = area(t, tm, c, c1), area(tm, t + width, c, c1)
        else:
            a, b = area(t, tm, c, cm) + area(tm, t + width, cm, c1), area(t, tm, cm, c1) + area(tm, t + width, c, cm)
        packed = packed << np.uint64(2) | _GRAY[np.searchsorted(_BOUNDS, np.log((1e-3 + a) / (1e-3 + b)))]
    return packed


def melody(text: str | None) -> np.ndarray:
    """PCM of a text as music, a note for each word: how a table of texts serves as a table of recordings."""
    import xxhash

    notes = [xxhash.xxh32_intdigest(w, 7) % 36 for w in (text or "").encode().split()]
    return _notes()[notes].ravel() if notes else np.zeros(0, np.float32)


def _notes(cache: list = []) -> np.ndarray:  # noqa: B006
    if not cache:
        t = np.arange(HOP) / RATE
        hz = 110.0 * 2 ** (np.arange(36)[:, None] / 12)
        cache.append((np.sin(2 * np.pi * hz * t) + 0.5 * np.sin(4 * np.pi * hz * t)).astype(np.float32))
    return cache[0]


def pcm16(data: bytes | None) -> np.ndarray:
    """Samples of little-endian signed 16-bit PCM; a trailing odd byte is dropped."""
    data = data or b""
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float32) / 32768


def fingerprints(recordings: DataFrame, audio_col: str, keys: list[str], decode: Callable = pcm16) -> DataFrame:
    """``keys``, ``codes`` (array of longs) and ``codes_sha256`` of every row; ``decode`` turns a value of ``audio_col`` into samples."""
    types = {f.name: f.dataType.simpleString() for f in recordings.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", codes array<bigint>, codes_sha256 string"

    def make():
        def run(batch):
            found = [fingerprint(decode(a.as_py())) for a in batch.column(len(keys))]
            return {k: batch.column(i) for i, k in enumerate(keys)} | {"codes": [f.astype(np.int64) for f in found], "codes_sha256": [hashlib.sha256(f.astype("<u4").tobytes()).hexdigest() for f in found]}

        return run

    return map_batches(recordings.select(*keys, audio_col), schema, make)


def overlap_error(mine: np.ndarray, other: np.ndarray, shift: int) -> tuple[int, float]:
    """Frames that two recordings have in common if ``mine`` begins ``shift`` frames into ``other``, and their share of differing bits."""
    a, b = mine[max(0, -shift) :], other[max(0, shift) :]
    n = min(len(a), len(b))
    return n, float(np.bitwise_count(a[:n] ^ b[:n]).sum()) / (32 * n) if n else 1.0


def _tried(bins: DataFrame, named: DataFrame) -> DataFrame:
    """``bins`` (``id``, ``anchor``, ``shift``, ``votes``) with ``overlap`` and ``bit_error``."""
    both = bins.join(named.select("id", "codes"), "id").join(named.select(F.col("id").alias("anchor"), F.col("codes").alias("other")), "anchor")

    def make():
        def run(batch):
            found = [overlap_error(np.array(mine, np.uint64), np.array(other, np.uint64), shift) for shift, mine, other in zip(*(batch.column(i).to_pylist() for i in (2, 4, 5)))]
            return {k: batch.column(i) for i, k in enumerate(("id", "anchor", "shift", "votes"))} | {"overlap": [f[0] for f in found], "bit_error": [f[1] for f in found]}

        return run

    return map_batches(both.select("id", "anchor", "shift", "votes", "codes", "other"), "id bigint, anchor bigint, shift bigint, votes bigint, overlap bigint, bit_error double", make, rows_at_once=500)


def _compared(seats: DataFrame, named: DataFrame, max_error: float, min_overlap: int, block: int) -> DataFrame:
    """Alignments between the classes (``g``) of the recordings of each run (``run``, ``id``, ``at``, ``g``)."""
    per_run = seats.groupBy("run").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    seated = (
        seats.join(per_run, "run")
        .withColumn("mine", F.pmod(F.xxhash64("id", "at"), F.col("chunks")).cast("int"))
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("run", F.least("mine", "turn").alias("c"), F.greatest("mine", "turn").alias("d"), "mine", "id", "at", "g")
        .join(named.select("id", "codes"), "id")
    )
    schema = pa.schema([("id", pa.int64()), ("anchor", pa.int64()), ("shift", pa.int64()), ("votes", pa.int64()), ("overlap", pa.int64()), ("bit_error", pa.float64())])

    def compare(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("mine").to_numpy(), kind="stable")
        chunk, ids, at, g = (group.column(c).to_numpy()[order] for c in ("mine", "id", "at", "g"))
        codes = group.column("codes").combine_chunks()
        code = lambda i: codes[int(order[i])].values.to_numpy(zero_copy_only=False).astype(np.uint64)
        root = np.unique(g, return_inverse=True)[1]
        half, out = int(np.searchsorted(chunk, chunk[-1])), []
        for i in range(half or len(ids)):
            mine = code(i)
            for j in range(half or i + 1, len(ids)):
                if root[i] != root[j]:
                    n, error = overlap_error(mine, code(j), int(at[j] - at[i]))
                    if n >= min_overlap and error <= max_error:
                        root[root == root[j]] = root[i]
                        out.append((ids[i], ids[j], at[j] - at[i], 1, n, error))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 6, schema)], schema=schema)

    return seated.groupBy("run", "c", "d").applyInArrow(compare, "id bigint, anchor bigint, shift bigint, votes bigint, overlap bigint, bit_error double")


def align(prints: DataFrame, max_error: float = 0.35, min_overlap: int = 8, block: int = SEATS) -> DataFrame:
    """Alignments of distinct fingerprints (``id``, ``codes``): ``id``, ``anchor`` (the recording it aligns with), ``shift``, ``votes``, ``overlap`` and ``bit_error``.

    ``shift`` is the position in the anchor minus that in the recording, in frames. Between
    recordings that share a run, enough alignments are found to connect all that align at it.
    """
    runs = prints.filter(F.size("codes") >= RUN).select(
        "id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("codes") - RUN + 1), lambda i: F.xxhash64(F.slice("codes", i, RUN)))).alias("at", "run")
    )
    anchors = runs.groupBy("run").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("run", F.col("first.id").alias("anchor"), F.col("first.at").alias("there"))
    seats = materialize(runs.join(anchors, "run"), "shared-runs")
    bins = seats.filter("anchor <> id").groupBy("id", "anchor", (F.col("there") - F.col("at")).cast("bigint").alias("shift")).agg(F.count("*").alias("votes"))
    fits = (F.col("overlap") >= min_overlap) & (F.col("bit_error") <= max_error)
    found = materialize(_tried(bins, prints).filter(fits), "alignments")
    classes = materialize(connected_components(found, "id", "anchor"), "classes")
    placed = seats.join(classes.select(F.col("node").alias("id"), F.col("component").alias("g")), "id", "left").select("run", "id", "at", F.coalesce("g", "id").alias("g"))
    mixed = placed.groupBy("run").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi").select("run")
    rest = materialize(placed.join(mixed, "run"), "mixed-runs")
    return found if rest.isEmpty() else found.unionByName(materialize(_compared(rest, prints, max_error, min_overlap, block), "alignments"))


def match_recordings(recordings: DataFrame, audio_col: str, keys: list[str], decode: Callable = pcm16, max_error: float = 0.35) -> DataFrame:
    """One row per recording: ``keys``, ``n_codes``, ``codes_sha256``, its class, and its alignment with an anchor.

    ``class_id`` is the smallest ``codes_sha256`` that alignments connect it with; recordings of
    equal fingerprints share a class. A recording shows its alignment with most votes, then least
    error. Recordings too short for a fingerprint (null, empty, under a few frames) have no codes
    and form one class. Very long recordings are fingerprinted whole, some frames at a time.
    Repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    rows = materialize(fingerprints(recordings, audio_col, keys, decode), "fingerprints")
    distinct = rows.select("codes_sha256", "codes").groupBy("codes_sha256").agg(F.first("codes").alias("codes"))
    # Numbered, so that a collision of hashes merges nothing.
    prints = materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-fingerprints")
    links = align(prints, max_error)
    named = prints.select("id", "codes_sha256")
    ends = links.join(named, "id").join(named.withColumnsRenamed({"id": "anchor", "codes_sha256": "anchor_sha256"}), "anchor")
    links = materialize(ends.select("codes_sha256", F.col("anchor_sha256").alias("anchor"), "shift", "votes", "overlap", "bit_error"), "named-alignments")
    classes = connected_components(links, "codes_sha256", "anchor")
    best = links.groupBy("codes_sha256").agg(F.min(F.struct((-F.col("votes")).alias("v"), "bit_error", "anchor", "shift", "votes", "overlap")).alias("b")).select("codes_sha256", "b.anchor", "b.shift", "b.votes", "b.overlap", "b.bit_error")
    known = best.join(classes, best["codes_sha256"] == classes["node"], "full").select(F.coalesce("codes_sha256", "node").alias("codes_sha256"), "anchor", "shift", "votes", "overlap", "bit_error", F.col("component").alias("class_id"))
    return rows.select(*keys, F.size("codes").cast("bigint").alias("n_codes"), "codes_sha256").join(known, "codes_sha256", "left").withColumn("class_id", F.coalesce("class_id", "codes_sha256")).select(*keys, "n_codes", "codes_sha256", "class_id", "anchor", "shift", "votes", "overlap", F.round("bit_error", 6).alias("bit_error"))
