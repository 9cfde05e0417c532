"""SimHash fingerprints and near duplicates by multi-index hashing.

A fingerprint is cut into segments. If two fingerprints differ in at most ``d`` of their bits and
there are ``m`` segments, then in some segment they differ in at most ``d // m`` bits. So every
fingerprint is put into one table per segment under the segment's value, and looks itself up
under all values within the small Hamming ball around its own; what it finds there is verified
by the distance of the whole fingerprints.

Copies never meet in pairs. Equal fingerprints are one node, whatever the number of their rows.
Tables in which a value is crowded (many different fingerprints with the same segment, as a
large family of near copies gives) are not joined: their members are compared in blocks, which
return only a spanning forest of the links found.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize
from plumbline.llm.common import map_batches
from plumbline.operators.graph import connected_components

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of ``width`` words, repeats included, as unsigned 64-bit numbers.

    A-Z are lower-cased; words are runs of anything but space and the controls 9 to 13. A text of
    fewer words gives one shingle of them all; one without words gives none.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> np.ndarray:
    """Per column of ``hashes`` (rows of bytes), the bits set in over half of the rows, packed again."""
    n, width = hashes.shape
    if not n:
        return np.zeros(width, np.uint8)
    counts = np.zeros((width, 256), np.int64)
    for at in range(0, n, 65_536):
        block = hashes[at : at + 65_536].astype(np.int64) + np.arange(width) * 256
        counts += np.bincount(block.ravel(), minlength=256 * width).reshape(width, 256)
    return np.packbits((counts @ _BITS_OF_BYTE) * 2 > n, axis=1, bitorder="little").ravel()


def fingerprint(text: str | None, width: int = 3) -> int:
    """The signed 64-bit fingerprint of one text; zero if it has no words."""
    hashes = shingle_hashes(text, width)
    return int(majority(hashes.view(np.uint8).reshape(-1, 8)).view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp`` (long) of every row, one row per input row."""

    def make():
        return lambda batch: {"id": batch.column(0), "fp": pa.array([fingerprint(t.as_py(), width) for t in batch.column(1)], pa.int64())}

    return map_batches(docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text")), "id bigint, fp bigint", make).withColumnRenamed("id", id_col)


def ball(bits: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` set bits."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def hamming_links(fps: DataFrame, distance: int = 3, segments: int = 2, crowded: int = 64, block: int = 4096) -> DataFrame:
    """Links between distinct fingerprints at ``distance`` or fewer differing bits.

    ``fps`` has distinct, non-null ``fp``. Returns ``src``, ``dst`` (src > dst): all links found
    through uncrowded tables, and a spanning forest of those of every crowded one, so the
    components are exact.
    """
    bits, radius = 64 // segments, distance // segments
    low = (1 << bits) - 1
    key = lambda s: F.shiftrightunsigned("fp", s * bits).bitwiseAND(F.lit(low))
    table = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), key(s).alias("key")) for s in range(segments)])).alias("k")).select("k.seg", "k.key", "fp")
    crowds = materialize(table.groupBy("seg", "key").agg(F.count("*").alias("n")).filter(F.col("n") > crowded), "crowded-segments")
    # Of two values one bit apart only the larger one asks: half of the ball finds every pair.
    masks = F.array(*[F.lit(m).cast("bigint") for m in ball(bits, radius)])
    asked = F.filter(F.transform(masks, lambda m: F.col("key").bitwiseXOR(m)), lambda k: k <= F.col("key"))
    probes = table.select("seg", F.explode(asked).alias("key"), F.col("fp").alias("asks"))
    found = probes.join(table, ["seg", "key"])
    some_crowded = not crowds.isEmpty()
    if some_crowded:
        found = probes.join(table.join(crowds, ["seg", "key"], "left_anti"), ["seg", "key"])
    close = F.bit_count(F.col("asks").bitwiseXOR(F.col("fp"))) <= distance
    direct = found.filter((F.col("asks") != F.col("fp")) & close).select(F.greatest("asks", "fp").alias("src"), F.least("asks", "fp").alias("dst"))
    if not some_crowded:
        return direct.distinct()
    # Crowded tables: each pair of chunks of members is a group, in which those that ask from outside sit too.
    crowds = crowds.withColumn("chunks", F.ceil(F.col("n") / block).cast("int"))
    seats = (
        table.withColumn("kind", F.lit(0))
        .unionByName(probes.filter("asks is not null").select("seg", "key", F.col("asks").alias("fp"), F.lit(1).alias("kind")))
        .join(crowds, ["seg", "key"])
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("seg", "key", "fp", "kind", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"))
    )

    def forest(group: pa.Table) -> pa.Table:
        src, dst = _forest(group.column("fp").to_numpy(), group.column("kind").to_numpy(), distance)
        return pa.table({"src": src, "dst": dst}, schema=pa.schema([("src", pa.int64()), ("dst", pa.int64())]))

    through_blocks = seats.groupBy("seg", "key", "a", "b").applyInArrow(forest, "src bigint, dst bigint")
    return direct.unionByName(through_blocks).distinct()


def _forest(fps: np.ndarray, kind: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the members (kind 0), and of members with askers (kind 1)."""
    members = np.unique(fps[kind == 0])
    nodes = np.concatenate((members, np.setdiff1d(fps[kind == 1], members)))
    left = np.arange(len(nodes))
    out: list[tuple[int, int]] = []
    unseen = np.ones(len(nodes), bool)
    is_member = np.arange(len(nodes)) < len(members)
    for root in range(len(members)):
        if not unseen[root]:
            continue
        unseen[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            rest = left[unseen] if is_member[at] else left[unseen & is_member]
            near = rest[np.bitwise_count((nodes[rest] ^ nodes[at]).view(np.uint64)) <= distance]
            unseen[near] = False
            queue += near.tolist()
            out += [(max(nodes[at], nodes[x]), min(nodes[at], nodes[x])) for x in near]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def near_duplicate_classes(docs: DataFrame, width: int = 3, distance: int = 3, segments: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and class of every row: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id``.

    Rows are linked if their fingerprints differ in ``distance`` or fewer bits; the class is the
    smallest id reachable through links, the row's own included.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Repeated
    rows and ids stay, one row each. Null ids are kept and get the class of their fingerprint
    (null only if all reachable ids are null). Very long texts are read whole, in time linear in
    their length. An empty table gives no rows; other columns are ignored.
    """
    rows = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "fingerprint-nodes")
    links = hamming_links(nodes, distance, segments)
    components = connected_components(links)
    linked = components.join(nodes, components["node"] == nodes["fp"]).groupBy("component").agg(F.min("least").alias("class"))
    of_node = nodes.join(components.join(linked, "component").select("node", "class"), nodes["fp"] == F.col("node"), "left").select("fp", "n", F.coalesce("class", "least").alias("component_id"))
    of_node = materialize(of_node, "fingerprint-classes")
    # Fingerprints that over a thousandth of all rows share are under a thousand: these are broadcast, so that no task gets all rows of one.
    share = max((nodes.agg(F.sum("n")).first()[0] or 0) // 1000, 1)
    frequent = F.broadcast(of_node.filter(F.col("n") > share).drop("n"))
    met = rows.join(frequent, "fp").unionByName(rows.join(frequent.select("fp"), "fp", "left_anti").join(of_node.filter(F.col("n") <= share).drop("n"), "fp"))
    return met.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
