"""Near-duplicate removal at a shingle similarity: SimHash fingerprints, a complete search, exact verification.

The search has three steps. Each is linear in the rows but for what is said of the last.

1. Candidates. Fingerprints of 64 bits are looked up by multi-index hashing (``simhash``), which
   finds copies that differ little. At a similarity of 0.8 such fingerprints differ in some ten
   bits, more than small balls in few segments can reach, so the search is completed by prefixes:
   put the shingles of all texts into one order, the same for all; two texts with a Jaccard
   similarity of ``t`` or more then share one of the first ``n - ceil(t * n) + 1`` of their ``n``
   shingles, wherever and however they differ. Any order will do; shingles seen to be common in a
   sample come last, so that a common passage fills no buckets (this affects the cost alone).
2. Clusters. A bucket holds the texts with a certain shingle among their first. Each member meets
   the bucket's anchor, and members still in different clusters then meet each other; texts whose
   sizes, places in the order or 256-bit fingerprints rule the similarity out are passed over.
   What is left as possible connects clusters, and only as many pairs as connect them are kept.
3. Verification. The texts of a cluster are sent once to a block of bounded size, where the
   shingle sets themselves are compared unless they are connected already, and the links of a
   spanning forest are returned. A cluster that needs several blocks is compared within its
   blocks first, all of which also hold some members in common; then those outside its largest
   group meet the others, block by block.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import discard, materialize
from plumbline.llm.common import map_batches, unused
from plumbline.llm.key_filter import split_by_keys
from plumbline.llm.simhash import hamming_links, majority, shingle_hashes
from plumbline.operators.graph import connected_components

WORDS = 4  # of 64 bits in a fingerprint; the first is that of operator 9
SPREAD = 6.5  # standard deviations by which fingerprints may differ more than is to be expected
FEW = 16  # shingles below which fingerprints are too coarse to rule anything out
SAMPLED, COMMON = 64, 200_000  # one text in SAMPLED is looked at for the COMMON most common shingles
CROWDED, SEATS = 512, 2048  # buckets of more members are compared in blocks of up to twice SEATS
SHINGLES = 100_000  # in a block of the verification
HUBS = 8  # members that all first blocks of a cluster share


def possible_bits(similarity: float) -> int:
    """In how many of their bits the wide fingerprints of texts of this Jaccard similarity may differ.

    Sets of such texts, as vectors, have a cosine of 2 * t / (1 + t) at least, and each bit differs
    with a probability of the angle over pi. Of texts exactly at the limit one pair in some
    10,000,000,000 differs by ``SPREAD`` deviations more than that: 76 of 256 bits at 0.8, 114 at 0.5.
    """
    differs = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    n = 64 * WORDS
    return min(n, math.floor(n * differs + SPREAD * math.sqrt(n * differs * (1 - differs))))


POSSIBLE = possible_bits(0.8)  # at the similarity that near copies have by default


def widen(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` independent 64-bit hashes of each hash, as rows of bytes; the first is the hash itself."""
    x = hashes[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rest = x[:, 1:]
    rest = (rest ^ (rest >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    rest = (rest ^ (rest >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x[:, 1:] = rest ^ (rest >> np.uint64(31))
    return x.view(np.uint8).reshape(len(hashes), 8 * words)


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """Majority bits of the widened hashes, a bounded number of them at a time."""
    if len(hashes) <= 20_000:
        return majority(widen(hashes, words))
    votes = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 20_000):
        votes += np.unpackbits(widen(hashes[at : at + 20_000], words), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes), bitorder="little")


def common_shingles(docs: DataFrame, width: int = 5) -> np.ndarray:
    """Hashes of the shingles that occur in several texts of a sample, the rarest first; at most ``COMMON`` reach the driver."""
    text = F.coalesce(docs["text"], F.lit(""))

    def make():
        return lambda batch: {"hash": np.concatenate([np.empty(0, np.uint64), *(np.unique(shingle_hashes(t.as_py(), width)) for t in batch.column(0))]).view(np.int64)}

    seen = map_batches(docs.select(text.alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).distinct(), "hash bigint", make)
    top = seen.groupBy("hash").count().filter("count > 1").orderBy(F.desc("count"), "hash").limit(COMMON).select("hash").toArrow()
    return top.column("hash").to_numpy()[::-1].view(np.uint64)


def prefix_length(n: int, similarity: float) -> int:
    """How many of ``n`` shingles, in an order common to all texts, must be looked at to meet every similar text."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def sketches(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id``, ``row_key`` (of id and text), ``words_key`` (of the words), ``size`` (different shingles), ``prefix``, ``rare`` (how many of the prefix are not common) and ``signature`` of every row."""
    common = common_shingles(docs, width)
    by_hash = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[by_hash], by_hash))  # at most COMMON entries

    def make():
        known, rank = shared.value

        def first(hashes):
            rare = len(hashes)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                order = np.where(known[at] == hashes, rank[at], -1)
                hashes, rare = hashes[np.argsort(order, kind="stable")], int((order < 0).sum())
            n = prefix_length(len(hashes), similarity)
            return hashes[:n].view(np.int64), min(rare, n)

        def run(batch):
            out = {k: [] for k in ("row_key", "words_key", "size", "prefix", "rare", "signature")}
            for i, t in zip(batch.column(0), batch.column(1)):
                text = t.as_py() or ""
                data = text.encode()
                out["row_key"].append(row_key(i.as_py(), data))
                out["words_key"].append(hashlib.md5(b" ".join(data.lower().split())).hexdigest())
                hashes = np.unique(shingle_hashes(text, width))
                out["size"].append(len(hashes))
                prefix, rare = first(hashes)
                out["prefix"].append(prefix)
                out["rare"].append(rare)
                out["signature"].append(wide_fingerprint(hashes, WORDS).view(np.int64))
            return out | {"doc_id": batch.column(0)}

        return run

    schema = "doc_id bigint, row_key string, words_key string, size int, prefix array<bigint>, rare int, signature array<bigint>"
    return map_batches(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")), schema, make, rows_at_once=500)


def row_key(doc_id: int | None, data: bytes) -> str:
    return f"{doc_id}|{hashlib.md5(data).hexdigest()}"


def row_key_column(doc_id, text):
    return F.concat(F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("None")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def distinct_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A numbered ``node`` for each text (its first row, by id and text), and the ``row_key`` of the rows that repeat a text.

    Texts are told apart by their keys alone; sketches are not shuffled.
    """
    one = F.min(F.struct(F.col("doc_id").isNull().alias("is_null"), "doc_id", "row_key"))
    several = rows.groupBy("words_key").agg(F.count("*").alias("n"), one["row_key"].alias("first")).filter("n > 1")
    several = materialize(several, "repeated-texts")
    again, alone = split_by_keys(rows, several.select("words_key"), "words_key")
    again = again.join(several, "words_key", "left")
    copies = materialize(again.filter("row_key <> first").select("row_key"), "copies")
    first = again.filter("first is null or row_key = first").drop("n", "first").dropDuplicates(["row_key"])
    nodes = alone.unionByName(first).withColumn("is_null", F.col("doc_id").isNull()).drop("words_key")
    return materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "texts"), copies


def shared_seats(nodes: DataFrame) -> DataFrame:
    """``key``, ``node``, ``size``, ``at`` (place in the order) and ``anchor`` of every seat in a bucket of several members.

    Buckets of rare shingles are small and are looked at where a shuffle brings them together;
    those of common ones may be very large, so they are counted first and then joined.
    """
    seats = nodes.select("node", "size", "rare", F.posexplode("prefix").alias("at", "key"))
    bucket = Window.partitionBy("key")
    rare = seats.filter("at < rare").drop("rare").withColumns({"n": F.count("*").over(bucket), "anchor": F.min("node").over(bucket)}).filter("n > 1").drop("n")
    common = seats.filter("at >= rare").drop("rare")
    full = common.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("anchor")).filter("n > 1").select("key", "anchor")
    return rare.select("key", "node", "size", "at", "anchor").unionByName(common.join(full, "key").select("key", "node", "size", "at", "anchor"))


def _sizes_allow(a: str, b: str, similarity: float):
    return F.least(a, b) >= F.lit(similarity - 1e-9) * F.greatest(a, b)


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a``, ``b`` whose sizes and signatures allow the similarity."""
    at = lambda side: nodes.select(F.col("node").alias(side), F.col("size").alias(f"n{side}"), F.col("signature").alias(f"s{side}"))
    bits = sum(F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(WORDS))
    return pairs.join(at("a"), "a").join(at("b"), "b").filter(_sizes_allow("na", "nb", similarity) & ((F.least("na", "nb") < FEW) | (bits <= possible_bits(similarity)))).select("a", "b")


def looked_up(nodes: DataFrame) -> DataFrame:
    """Pairs of texts whose first fingerprint words operator 9 links, or which are equal."""
    prints = materialize(nodes.filter("size > 0").groupBy(F.col("signature")[0].alias("fp")).agg(F.min("node").alias("least"), F.count("*").alias("n")), "fingerprints")
    equal = nodes.select("node", F.col("signature")[0].alias("fp")).join(prints.filter("n > 1"), "fp").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    end = lambda side, to: prints.select(F.col("fp").alias(side), F.col("least").alias(to))
    return hamming_links(prints.select("fp")).join(end("src", "a"), "src").join(end("dst", "b"), "dst").select("a", "b").unionByName(equal)


def between(seats: DataFrame, nodes: DataFrame, clusters: DataFrame, similarity: float, crowded: int = CROWDED, block: int = SEATS) -> DataFrame:
    """Pairs ``a``, ``b`` of clusters that share a bucket and may hold similar texts: enough pairs to connect them."""
    placed = seats.join(clusters, "node", "left").select("key", "node", "size", "at", F.coalesce("cluster", "node").alias("g"))
    mixed = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi").select("key", "n")
    seated = materialize(placed.join(mixed, "key"), "mixed-buckets")
    few = seated.filter(F.col("n") <= crowded)
    side = lambda s: few.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "size", "at", "g")])
    # Equal shingles stand in the same order in both texts: so many can still be equal after the first.
    most = F.lit(1) + F.least(F.col("size_a") - F.col("at_a") - 1, F.col("size_b") - F.col("at_b") - 1) + F.least("at_a", "at_b")
    least = F.lit(similarity / (1 + similarity)) * (F.col("size_a") + F.col("size_b")) - 1e-6
    met = side("a").join(side("b"), "key").filter((F.col("node_a") > F.col("node_b")) & (F.col("g_a") != F.col("g_b")) & _sizes_allow("size_a", "size_b", similarity) & (most >= least))
    group = met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "g_a", "g_b").distinct()
    direct = possible(group.select("a", "b"), nodes, similarity).join(group, ["a", "b"]).select(F.col("g_a").alias("a"), F.col("g_b").alias("b"))
    crowds = seated.filter(F.col("n") > crowded)
    if crowds.isEmpty():
        return direct.distinct()
    blocks = (
        crowds.join(nodes.select("node", "signature"), "node")
        .withColumn("chunks", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", F.least("mine", "other").alias("c"), F.greatest("mine", "other").alias("d"), "mine", "g", "size", *[F.col("signature")[i].alias(f"s{i}") for i in range(WORDS)])
    )

    def compare(group: pa.Table) -> pa.Table:
        column = lambda c: group.column(c).to_numpy()
        a, b = connect_possible(column("g"), column("mine"), column("size"), np.stack([column(f"s{i}") for i in range(WORDS)], 1).view(np.uint64), similarity)
        return pa.table({"a": a, "b": b}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return direct.unionByName(blocks.groupBy("key", "c", "d").applyInArrow(compare, "a bigint, b bigint")).distinct()


def connect_possible(groups: np.ndarray, chunks: np.ndarray, sizes: np.ndarray, signatures: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of groups that connect what possible pairs of members connect; of two chunks, members meet those of the other chunk."""
    order = np.argsort(chunks, kind="stable")
    groups, chunks, sizes, signatures = groups[order], chunks[order], sizes[order], signatures[order]
    root = np.unique(groups, return_inverse=True)[1]
    half = int(np.searchsorted(chunks, chunks[-1]))  # 0 if there is one chunk
    out = []
    for i in range(half or len(groups)):
        rest = np.arange(half or i + 1, len(groups))
        rest = rest[_possible_with(i, rest, root, sizes, signatures, similarity)]
        for j in rest.tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append((groups[i], groups[j]))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _possible_with(i: int, rest: np.ndarray, root: np.ndarray, sizes: np.ndarray, signatures: np.ndarray, similarity: float) -> np.ndarray:
    """Which of ``rest`` are not connected with member ``i`` yet and may be similar to it."""
    n, mine = sizes[rest], sizes[i]
    fits = (root[rest] != root[i]) & (np.minimum(n, mine) >= (similarity - 1e-9) * np.maximum(n, mine))
    at = np.nonzero(fits)[0]
    near = np.bitwise_count(signatures[rest[at]] ^ signatures[i]).sum(1, dtype=np.int64) <= possible_bits(similarity)
    fits[at] = near | (np.minimum(n[at], mine) < FEW)
    return fits


def connect_similar(sets: list[np.ndarray], groups: np.ndarray, kind: np.ndarray, signatures: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of members with a Jaccard similarity of at least ``similarity``: as many as connect what all such pairs connect.

    Members of kind 0 meet each other; those of kind 1 meet those of kind 2 only.
    """
    sizes = np.array([len(s) for s in sets])
    _, shingle, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True) if len(sets) else (None, np.zeros(0, int), np.zeros(0, int))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark = np.zeros(len(seen), bool)
    root = np.unique(groups, return_inverse=True)[1]
    others = np.nonzero(kind == 2)[0]
    out = []
    for i in np.nonzero(kind != 2)[0].tolist():
        rest = others if kind[i] == 1 else np.arange(i + 1, len(sets))
        rest = rest[_possible_with(i, rest, root, sizes, signatures, similarity)]
        if not len(rest):
            continue
        mine = shingle[starts[i] : ends[i]]
        mark[mine] = True
        n = sizes[rest]
        before = np.cumsum(n) - n
        flat = np.repeat(starts[rest] - before, n) + np.arange(n.sum())
        common = np.add.reduceat(np.append(mark[shingle[flat]], False).astype(np.int64), before) if n.all() else np.zeros(len(rest), np.int64)
        mark[mine] = False
        for j in rest[common >= similarity * (n + sizes[i] - common) - 1e-9].tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def _verified(members: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links ``a``, ``b`` within every ``cluster`` and ``block`` of ``members`` (``node``, ``row_key``, ``g``, ``kind``, ``signature``)."""
    seated = members.join(texts, "row_key").select("cluster", "block", "node", "g", "kind", "text", *[F.col("signature")[i].alias(f"s{i}") for i in range(WORDS)])
    # Repeated rows give a text several times; the shuffle to blocks serves to drop them.
    seated = seated.repartition("cluster", "block").dropDuplicates(["cluster", "block", "node", "kind"])

    def compare(group: pa.Table) -> pa.Table:
        column = lambda c: group.column(c).to_numpy()
        sets = [np.unique(shingle_hashes(t.as_py(), width)) for t in group.column("text")]
        found = connect_similar(sets, column("g"), column("kind"), np.stack([column(f"s{i}") for i in range(WORDS)], 1).view(np.uint64), similarity)
        at = np.array(found, np.int64).reshape(-1, 2)
        node = column("node")
        return pa.table({"a": node[at[:, 0]], "b": node[at[:, 1]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return seated.groupBy("cluster", "block").applyInArrow(compare, "a bigint, b bigint")


def verified_links(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, width: int, similarity: float, shingles: int = SHINGLES) -> DataFrame:
    """A forest of the links between texts of a cluster (``node``, ``cluster``): their connected components are exact."""
    texts = docs.select(row_key_column(docs["doc_id"], docs["text"]).alias("row_key"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    texts, _ = split_by_keys(texts, clusters.join(nodes.select("node", "row_key"), "node").select("row_key"), "row_key")
    per_cluster = clusters.join(nodes.select("node", "size"), "node").groupBy("cluster").agg(F.ceil(F.sum("size") / shingles).cast("int").alias("chunks"))
    members = clusters.join(nodes.select("node", "row_key", "size", "signature"), "node").join(per_cluster, "cluster")
    members = materialize(members.withColumn("chunk", F.pmod(F.xxhash64("node"), F.greatest("chunks", F.lit(1))).cast("int")), "members")
    several = members.filter("chunks > 1")
    alone = F.col("node").alias("g"), F.lit(0).alias("kind")
    first = members.select("cluster", F.col("chunk").alias("block"), "node", "row_key", "signature", *alone)
    split = not several.isEmpty()
    if split:
        hubs = several.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy("node"))).filter(F.col("k") <= HUBS)
        everywhere = hubs.select("cluster", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("block"), "node", "row_key", "signature", *alone)
        first = first.unionByName(everywhere).dropDuplicates(["cluster", "block", "node"])
    links = materialize(_verified(first, texts, width, similarity), "links")
    if not split:
        return links
    found = materialize(connected_components(links, "a", "b"), "groups")
    grouped = several.join(found, "node", "left").withColumn("g", F.coalesce("component", "node"))
    largest = grouped.groupBy("cluster", "g").count().groupBy("cluster").agg(F.max(F.struct("count", "g")).alias("most")).select("cluster", F.col("most.g").alias("largest"))
    asks = grouped.join(largest, "cluster").withColumn("asks", F.col("g") != F.col("largest"))
    turns = asks.filter("asks").groupBy("cluster").agg(F.ceil(F.sum("size") / shingles).cast("int").alias("turns"))
    asks = materialize(asks.join(turns, "cluster").withColumn("turn", F.pmod(F.xxhash64("node"), F.greatest("turns", F.lit(1))).cast("int")), "asking")
    block = lambda turn, chunk: F.concat_ws("/", turn, chunk)
    seat = ("node", "row_key", "signature", "g")
    askers = asks.filter("asks").select("cluster", "turn", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"), *seat).select("cluster", block("turn", "c").alias("block"), *seat, F.lit(1).alias("kind"))
    asked = asks.select("cluster", "chunk", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("t"), *seat).select("cluster", block("t", "chunk").alias("block"), *seat, F.lit(2).alias("kind"))
    return links.unionByName(materialize(_verified(askers.unionByName(asked), texts, width, similarity), "links"))


def near_duplicate_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, shingles: int = SHINGLES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The sketch of every row, the different texts, the rows that repeat one, and ``node`` with ``component`` of all texts that have a link to another text."""
    rows = materialize(sketches(docs, width, similarity), "sketches")
    nodes, copies = distinct_texts(rows)
    seats = materialize(shared_seats(nodes), "seats")
    met = seats.filter("node <> anchor").select(F.col("node").alias("a"), F.col("anchor").alias("b")).unionByName(looked_up(nodes)).distinct()
    clusters = materialize(connected_components(possible(met, nodes, similarity), "a", "b").withColumnRenamed("component", "cluster"), "clusters")
    more = materialize(between(seats, nodes, clusters, similarity), "between")
    discard(seats)
    if not more.isEmpty():
        merged = connected_components(more, "a", "b").withColumnRenamed("component", "into")
        alone = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(clusters, "node", "left_anti").withColumn("cluster", F.col("node"))
        every = clusters.unionByName(alone)
        clusters = materialize(every.join(merged, every["cluster"] == merged["node"], "left").select(every["node"], F.coalesce("into", "cluster").alias("cluster")), "clusters")
    links = verified_links(docs, nodes, clusters, width, similarity, shingles)
    return rows, nodes, copies, materialize(connected_components(links, "a", "b"), "groups")


def without_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, shingles: int = SHINGLES) -> DataFrame:
    """One row of each group of near copies, with the columns of ``docs``.

    Rows whose texts have the same words (A-Z lower-cased) are copies; texts whose sets of
    ``width``-word shingles have a Jaccard similarity of ``similarity`` or more are linked, and
    groups are what links connect. The row with the smallest ``doc_id`` stays (nulls last, ties by
    text). Null, empty and wordless texts are copies of each other. Fully repeated rows count as
    copies. Very long texts are compared whole. Other columns may have any names. An empty table
    gives no rows.
    """
    rows, nodes, copies, found = near_duplicate_groups(docs, width, similarity, shingles)
    # Copies of a text give way to its first row; texts of a group give way to the first of these.
    grouped = nodes.join(found, "node")
    keeper = grouped.groupBy("component").agg(F.min(F.struct("is_null", "doc_id", "row_key")).alias("k")).select(F.col("k.row_key").alias("row_key"))
    near = grouped.select("row_key").join(keeper, "row_key", "left_anti")
    (key,) = unused(docs.columns, "__key")
    gone = materialize(copies.unionByName(near).distinct().withColumnRenamed("row_key", key), "gone")
    repeated = materialize(rows.groupBy("row_key").count().filter("count > 1").select(F.col("row_key").alias(key)), "repeated")
    keyed = docs.withColumn(key, row_key_column(docs["doc_id"], docs["text"]))
    maybe, stay = split_by_keys(keyed, gone, key)
    left = stay.unionByName(maybe.join(gone, key, "left_anti"))
    if not repeated.isEmpty():
        left = left.join(repeated, key, "left_anti").unionByName(left.join(repeated, key, "left_semi").dropDuplicates([key]))
    return left.select(*docs.columns)
