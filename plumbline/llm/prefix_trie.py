"""A prefix trie of conversations as balanced parentheses, in shards.

Conversations become sequences of turn digests. Equal sequences are one, with a count. Sequences
are sorted and cut into ranges, the shards, so that a node's conversations lie side by side: only
the nodes on the first and the last sequence of a shard, its spines, can go on in other shards.

A shard writes its trie as balanced parentheses, with the lowest and highest excess of each block
and of each pair of blocks above. ``find_close`` then delimits subtrees; ranks of opening
parentheses and of leaf pairs ``()`` count nodes and leaves within them, and cumulative arrays
in preorder give their sums. Inner nodes are finished; the spines, with all that hangs from them,
become sequences of the next round, whose shards merge what they share, until one shard is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize

BLOCK = 64  # parentheses
WIDTH = 32  # characters of a turn in a path
SALTS = 16
NOBODY = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """A balanced sequence of parentheses (True opens), with range min-max excess blocks."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1))
        padded = np.append(self.excess, np.full(-len(opens) % BLOCK, self.excess[-1] if len(opens) else 0)).reshape(-1, BLOCK)
        self.low, self.high = [padded.min(1)], [padded.max(1)]
        while len(self.low[-1]) > 1:
            odd = len(self.low[-1]) % 2
            low, high = np.append(self.low[-1], self.low[-1][-odd:][:odd]), np.append(self.high[-1], self.high[-1][-odd:][:odd])
            self.low.append(low.reshape(-1, 2).min(1))
            self.high.append(high.reshape(-1, 2).max(1))
        self.opened = np.cumsum(opens)
        self.leaf_pairs = np.cumsum(opens & ~np.append(opens[1:], True)[: len(opens)])

    def _has(self, level: int, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        inside = at < len(self.low[level])
        at = np.minimum(at, len(self.low[level]) - 1)
        return inside & (self.low[level][at] <= target) & (target <= self.high[level][at])

    def _scan(self, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place from ``start`` to the end of its block whose excess is ``target``, or -1."""
        found, open_, at = np.full(len(start), -1), np.arange(len(start)), start.copy()
        end = np.minimum(start // BLOCK * BLOCK + BLOCK, len(self.excess))
        while len(open_ := open_[at[open_] < end[open_]]):
            hit = self.excess[at[open_]] == target[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
        return found

    def find_close(self, opening: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        target = self.excess[opening] - 1
        within = opening % BLOCK < BLOCK - 1
        close = np.full(len(opening), -1)
        close[within] = self._scan(opening[within] + 1, target[within])
        rest = np.flatnonzero(close < 0)
        at, target, found = opening[rest] // BLOCK, target[rest], np.full(len(rest), -1)
        for level in range(len(self.low)):  # up, until a block to the right has the excess
            right = (found < 0) & (at % 2 == 0)
            right[right] = self._has(level, at[right] + 1, target[right])
            found[right] = level
            at = np.where(right, at + 1, np.where(found < 0, at // 2, at))
        for level in range(len(self.low) - 1, 0, -1):  # and down to the first of its blocks that has it
            down = found == level
            at[down] = 2 * at[down] + ~self._has(level - 1, 2 * at[down], target[down])
            found[down] = level - 1
        close[rest] = self._scan(at * BLOCK, target)
        return close

    def subtrees(self) -> tuple[np.ndarray, np.ndarray]:
        """Per node in preorder, how many nodes and how many leaf pairs its subtree has."""
        opening = np.flatnonzero(self.opens)
        close = self.find_close(opening)
        before = np.append(0, self.leaf_pairs)[opening]
        return self.opened[close] - self.opened[opening] + 1, self.leaf_pairs[close] - before


def digests(path: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(path), np.uint64).reshape(-1, WIDTH // 16)


class Trie:
    """The trie of sorted paths. ``of_item`` holds each path's nodes, root first, one path after the other."""

    def __init__(self, paths: list[str]):
        self.turns = [digests(p) for p in paths]
        stack = np.zeros(max(map(len, self.turns), default=0) + 1, np.int64)
        of_item, runs, last, size = [], [], None, 0
        parents, depths = [], []
        for turns in self.turns:
            shared = -1
            if last is not None:
                n = min(len(last), len(turns))
                differ = (last[:n] != turns[:n]).any(1)
                shared = int(differ.argmax()) if differ.any() else n
                runs.append(len(last) - shared)
            new = len(turns) - shared
            runs.append(new)
            stack[shared + 1 : len(turns) + 1] = np.arange(size, size + new)
            if new:
                parents.append(np.append(stack[shared] if shared >= 0 else -1, np.arange(size, size + new - 1)))
                depths.append(np.arange(shared + 1, len(turns) + 1))
            of_item.append(stack[: len(turns) + 1].copy())
            last, size = turns, size + new
        runs.append(len(last) + 1)
        self.items, self.of_item, self.size = of_item, np.concatenate(of_item), size
        self.parent, self.depth = np.concatenate(parents), np.concatenate(depths)
        self.shape = Parentheses(np.repeat(np.arange(len(runs)) % 2 == 0, runs))

    def keys(self, nodes: np.ndarray | None = None) -> dict[int, str]:
        """The digest of the path to each node of the given item numbers, or of all."""
        state, out = {}, {}
        for i in range(len(self.items)) if nodes is None else nodes:
            running = hashlib.md5()
            for node, turn in zip(self.items[i].tolist(), [b"", *(t.tobytes().hex().encode() for t in self.turns[i])]):
                if node in state:
                    running = state[node].copy()
                else:
                    running.update(turn)
                    state[node] = running.copy()
                    out[node] = running.hexdigest()
        return out


PAYLOAD = ("n", "least", "leaves", "saved", "kids", "ends")
ITEM = "path string, words array<bigint>, n array<bigint>, least array<bigint>, leaves array<bigint>, saved array<bigint>, kids array<bigint>, ends array<string>"
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, node_key string, parent_key string"
_LONG, _LIST = pa.int64(), pa.list_(pa.int64())
OUT = pa.schema(
    [("path", pa.string()), *[(c, _LIST) for c in ("words", *PAYLOAD[:-1])], ("ends", pa.list_(pa.string()))]
    + [(c, _LONG) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [(c, pa.string()) for c in ("ends_sha256", "node_key", "parent_key")]
)


def shard(items: pa.Table, last_round: bool, keyed: bool) -> pa.Table:
    """Finished nodes of a shard's sorted items, and its spines as items of the next round unless this is the last one."""
    trie = Trie(items.column("path").to_pylist())
    flat = {c: items.column(c).combine_chunks().flatten() for c in ("words", *PAYLOAD)}
    total, nodes = trie.size, trie.of_item
    words = np.zeros(total, np.int64)
    words[nodes] = flat["words"].to_numpy()
    own = {}
    for c in ("n", "leaves", "saved", "kids"):
        own[c] = np.zeros(total, np.int64)
        np.add.at(own[c], nodes, flat[c].to_numpy())
    own["least"] = np.full(total, NOBODY)
    np.minimum.at(own["least"], nodes, flat["least"].fill_null(NOBODY).to_numpy())
    ends: list[str | None] = [None] * total
    for at in np.flatnonzero(flat["ends"].is_valid().to_numpy(zero_copy_only=False)).tolist():
        ends[nodes[at]] = flat["ends"][at].as_py()

    size, pairs = trie.shape.subtrees()
    first = np.arange(total)
    def within(x):  # sums over subtrees
        upto = np.append(0, np.cumsum(x))
        return upto[first + size] - upto[first]

    parent, lone = trie.parent, size == 1
    n = within(own["n"])
    saved = within(own["saved"] + (n - 1) * words)
    leaves = pairs + within(own["leaves"] - (lone & (own["kids"] > 0)))
    kids = own["kids"] + np.bincount(parent[1:], minlength=total)
    least = own["least"].copy()
    by_depth = np.argsort(-trie.depth, kind="stable")
    for level in np.split(by_depth, np.flatnonzero(np.diff(trie.depth[by_depth])) + 1):
        if trie.depth[level[0]]:
            np.minimum.at(least, parent[level], least[level])

    spine = np.zeros(total, bool)
    if not last_round:
        spine[trie.items[0]] = spine[trie.items[-1]] = True
    done = np.flatnonzero(~spine)
    hangs = done[(parent[done] >= 0) & spine[parent[done]]]
    ends_of_path = trie.keys([0, len(trie.items) - 1]) if not last_round else {}
    keys = trie.keys() if keyed else {}
    open_parent = np.zeros(total, bool)
    open_parent[hangs] = True
    known = (parent[done] >= 0) & ~open_parent[done]
    up = parent[done]
    table = {c: pa.nulls(len(done), OUT.field(c).type) for c in ("path", "words", *PAYLOAD)}
    table |= {
        "conv_id": least[done], "depth": trie.depth[done], "parent_conv_id": pa.array(least[up], mask=~known), "n_convs": n[done], "n_children": kids[done], "n_leaves": leaves[done], "saved_tokens": saved[done],
        "ends_sha256": [ends[i] or NO_ENDS for i in done.tolist()], "node_key": [keys.get(i) for i in done.tolist()],
        "parent_key": [ends_of_path[p] if o else None for p, o in zip(up.tolist(), open_parent[done].tolist())],
    }
    out = [pa.Table.from_arrays([pa.array(table[f.name], f.type) for f in OUT], schema=OUT)]
    if last_round:
        return out[0]
    hung = {"n": (own["n"], n), "leaves": (own["leaves"], leaves), "saved": (own["saved"], saved), "kids": (own["kids"], np.ones(total, np.int64))}
    for base, add in hung.values():
        np.add.at(base, parent[hangs], add[hangs])
    np.minimum.at(own["least"], parent[hangs], least[hangs])
    told: set[int] = set()  # a node on both spines gives its figures once
    for i in sorted({0, len(trie.items) - 1}):
        path = trie.items[i].tolist()
        mine = [v for v in path if v not in told]
        skipped = len(path) - len(mine)
        told.update(mine)
        values = {c: [[0] * skipped + own[c][mine].tolist()] for c in ("n", "leaves", "saved", "kids")}
        values |= {"least": [[None] * skipped + [None if v == NOBODY else v for v in own["least"][mine].tolist()]], "ends": [[None] * skipped + [ends[v] for v in mine]]}
        values |= {"path": [items.column("path")[i].as_py()], "words": [words[path].tolist()]}
        out.append(pa.Table.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(1, f.type) for f in OUT], schema=OUT))
    return pa.concat_tables(out)


def rebuilt(conversations: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """``conv_id``, ``path`` (digests of its turns) and ``words`` of every rebuilt conversation.

    The first h turns come from the first conversation of the block of ``block`` ids, h being a
    hash of the id below ``most``; the conversation's own turns follow, without its first h.
    """
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in ("role", "text"))
    # The role's length keeps role and text apart; turns of equal number are ordered by their digests.
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.select(conversations["conv_id"].cast("bigint").alias("conv_id"), F.struct(conversations["turn"].alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words")).alias("t")).filter("conv_id is not null")
    whole = lambda rows, c: rows.groupBy(F.col("conv_id").alias(c)).agg(F.sort_array(F.collect_list("t")).alias(c + "_turns"))
    own, base = whole(turns, "conv_id"), whole(turns.filter(F.col("conv_id") % block == 0), "base")
    taken = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    none = F.array().cast("array<struct<turn:bigint,digest:string,words:bigint>>")
    joined = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % block, "taken": taken}).join(base.select("base", F.slice("base_turns", 1, most).alias("base_turns")), "base", "left")
    plain = lambda c: F.col(c).cast("array<struct<turn:bigint,digest:string,words:bigint>>")
    all_turns = F.concat(F.slice(F.coalesce(plain("base_turns"), none), F.lit(1), F.col("taken")), F.slice(plain("conv_id_turns"), F.col("taken") + 1, F.size("conv_id_turns")))
    return joined.select("conv_id", F.array_join(F.transform(all_turns, lambda t: t["digest"]), "").alias("path"), F.transform(all_turns, lambda t: t["words"]).alias("words"))


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each path, from rows sorted by path and id; only a hash's state is kept."""
    schema = pa.schema([("path_key", pa.string()), ("ends", pa.string())])
    now, state, done = None, None, []
    for batch in batches:
        for key, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(str(conv_id).encode())
            else:
                state.update(f",{conv_id}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], schema=schema)
            done = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], schema=schema)


def sequences(conversations: DataFrame) -> DataFrame:
    """Each different rebuilt sequence as an item: its figures belong to its last node."""
    rows = materialize(rebuilt(conversations).withColumn("path_key", F.md5(F.col("path").cast("binary"))), "rebuilt")
    ends = rows.select("path_key", "conv_id").repartition("path_key").sortWithinPartitions("path_key", "conv_id").mapInArrow(_hashed_ends, "path_key string, ends string")
    groups = rows.groupBy("path_key").agg(F.first("path").alias("path"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("least")).join(ends, "path_key")
    at_end = lambda v, rest, kind: F.concat(F.array_repeat(F.lit(rest).cast(kind), F.size("words")), F.array(F.col(v)))
    none = F.array_repeat(F.lit(0).cast("bigint"), F.size("words") + 1)
    return groups.select(
        "path", F.concat(F.array(F.lit(0).cast("bigint")), "words").alias("words"), at_end("n", 0, "bigint").alias("n"), at_end("least", None, "bigint").alias("least"),
        *[none.alias(c) for c in ("leaves", "saved", "kids")], at_end("ends", None, "string").alias("ends"),
    )


def prefix_trie(conversations: DataFrame, shard_turns: int = 20_000) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (``rebuilt``), in columns.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (words that the subtree's nodes would repeat) and ``ends_sha256``
    (of the ids that end there). Other columns of the input are left out, whatever their names.

    Null roles and texts count as empty, a null turn comes first, turns of equal number are ordered
    by a digest of role and text; repeated rows are turns of their own. Rows without ``conv_id``
    belong to no conversation and take no part. A conversation is one value of some fifty bytes a
    turn, so its turns meet in one task; texts are read once and never moved. Any number of equal
    conversations is one sequence; their ids are hashed as a stream, which SHA-256 does in one
    task for each sequence. An empty table gives no nodes.
    """
    items, finished, rounds = materialize(sequences(conversations), "sequences"), [], 0
    while True:
        size = items.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("turns")).first()
        shards = max(1, min(-(-(size["turns"] or 0) // shard_turns), -(-size["n"] // 8)))
        last_round, keyed = shards == 1, rounds > 0

        def run(batches: Iterator[pa.RecordBatch], last_round=last_round, keyed=keyed) -> Iterator[pa.RecordBatch]:
            if got := [b for b in batches if b.num_rows]:
                yield from shard(pa.Table.from_batches(got), last_round, keyed).combine_chunks().to_batches()

        out = materialize(items.repartitionByRange(shards, "path").sortWithinPartitions("path").mapInArrow(run, f"{ITEM}, {NODE}"), "trie")
        finished.append(out.filter("conv_id is not null").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "node_key", "parent_key"))
        if last_round:
            break
        items, rounds = out.filter("path is not null").select(*[c.split()[0] for c in ITEM.split(", ")]), rounds + 1
    result = finished[0]
    if rounds:
        # Nodes that hang from a spine learn its node's smallest member; a node may have very many children.
        spines = finished[1]
        for later in finished[2:]:
            spines = spines.unionByName(later)
        asked = result.unionByName(spines)
        named = spines.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("named"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        result = asked.withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int")).join(named, ["parent_key", "salt"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "named"))
    return result.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
