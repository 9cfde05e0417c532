"""Exact top-k by inner product with MaxScore.

A vector's components are the terms of a query and the postings of a shard: for each term, the
weights that the shard's vectors have in it, with the largest and the smallest. From these a
query gets the range that each term can add to a score. Given the k-th best score so far, the
terms whose ranges together cannot lift a vector over it are non-essential. The postings of the
essential terms are traversed; then the others are probed, the widest first, and only for the
vectors that can still compete. Shards are searched one by one and their best are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXACT = 2**53


class Shard:
    """Postings of some vectors by term, with bounds."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.postings = ids[order], np.ascontiguousarray(weights[order].T)
        self.high, self.low = self.postings.max(1, initial=-(2**62)), self.postings.min(1, initial=2**62)

    def top(self, query_id: int, query: np.ndarray, k: int, probe: int = 8, first: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k, ties to smaller ids; rows of the query's own id are left out."""
        terms = min(len(query), len(self.postings))
        q, post, ids = query[:terms], self.postings[:terms], self.ids
        most, least = np.maximum(q * self.high[:terms], q * self.low[:terms]), np.minimum(q * self.high[:terms], q * self.low[:terms])
        order = np.argsort(least - most, kind="stable")  # widest range first
        q, post, most, least = q[order], post[order], most[order], least[order]
        rest = np.concatenate((np.cumsum(most[::-1])[::-1], [most.dtype.type(0)]))  # what the terms from here on add at most
        # A first block is scored in full, for a bar to start from.
        ids0 = ids[:first]
        start = np.nonzero(ids0 != query_id)[0]
        best_ids, best = _best(ids0[start], q @ post[:, start], k)
        if len(ids) <= first:
            return best_ids, best
        bar = best[-1] if len(best) == k else None
        alive = first + np.nonzero(ids[first:] != query_id)[0]
        spread = np.cumsum((most - least)[::-1])[::-1]
        essential = terms if bar is None else int(np.searchsorted(-spread, -(bar - least.sum()), side="right"))
        essential = max(1, min(terms, essential))
        score = q[:essential] @ post[:essential, first:][:, alive - first] if len(alive) != len(ids) - first else q[:essential] @ post[:essential, first:]
        at = essential
        while bar is not None and at < terms and len(alive):
            keep = score + rest[at] >= bar
            alive, score = alive[keep], score[keep]
            score = score + q[at : at + probe] @ post[at : at + probe][:, alive]
            at += probe
        return _best(np.concatenate((best_ids, ids[alive])), np.concatenate((best, score)), k)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > 4 * k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _matrix(group: pa.Table, dims: int, exact: bool) -> np.ndarray:
    column = group.column("v").combine_chunks()
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), dims), np.float64 if exact else np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 4096, query_rows: int = 2048) -> DataFrame:
    """The ``k`` best other vectors for every vector whose id is divisible by ``query_every``.

    Components become floor(scale * x) and scores are integer inner products. Returns
    ``query_id``, ``rank``, ``vec_id`` and ``score``; ties go to the smaller id, and queries with
    fewer candidates have fewer rows.

    Vectors that are null or hold a null or non-finite component take no part; shorter vectors
    count as filled up with zeros. Rows of equal ids are candidates of their own, not of each
    other, and a query id that occurs in several rows is answered once, for its smallest vector.
    A null id takes no part. An empty table gives no rows; other columns are ignored.

    Queries and vectors are packed into blocks of a bounded number of rows, every query block
    meets every shard once, and a pair returns k rows per query. What is moved grows with the
    number of shards times that of query blocks, so the blocks are as large as memory allows and
    components take the bytes that the largest needs. Neither side is broadcast, however small its
    rows look before they are sent to every block of the other.
    """
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    finite = F.forall(F.col(vector_col), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    usable = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(finite).select(F.col(id_col).cast("bigint").alias("id"), whole.alias("v"))
    queries = usable.filter(F.col("id") % query_every == 0).groupBy("id").agg(F.min("v").alias("v"))
    magnitude = F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0))
    stats = usable.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(magnitude).alias("big"), F.count_if(F.col("id") % query_every == 0).alias("q")).first()
    dims, exact = stats["dims"] or 0, (stats["big"] or 0) ** 2 * (stats["dims"] or 0) < EXACT
    shards, blocks = max(1, -(-stats["n"] // shard_rows)), max(1, -(-stats["q"] // query_rows))
    sent = next(t for t in (np.int16, np.int32, np.int64) if (stats["big"] or 0) <= np.iinfo(t).max)

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy().astype(np.int64)
        return pa.table({"block": [key[0].as_py()], "ids": [ids.tobytes()], "weights": [_matrix(group, dims, exact).astype(sent).tobytes()]}, schema=pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("weights", pa.binary())]))

    packed = "block bigint, ids binary, weights binary"
    deal = lambda df, n: df.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n))).groupBy("block").applyInArrow(pack, packed)
    base = deal(usable, shards).select(F.col("block").alias("s"), "ids", "weights", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    asked = deal(queries, blocks).select(F.col("block").cast("int").alias("b"), F.col("ids").alias("q_ids"), F.col("weights").alias("q_weights"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("s"))
    number = np.float64 if exact else np.int64

    def search(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, weights, q_ids, q_weights = (batch.column(c)[row].as_py() for c in ("ids", "weights", "q_ids", "q_weights"))
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                shard = Shard(ids, np.frombuffer(weights, sent).reshape(len(ids), dims).astype(number))
                found = [(q, *shard.top(q, w, k)) for q, w in zip(q_ids.tolist(), np.frombuffer(q_weights, sent).reshape(len(q_ids), dims).astype(number))]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()), pa.array(np.concatenate([f[1] for f in found]), pa.int64()), pa.array(np.concatenate([f[2] for f in found]).astype(np.int64))],
                        names=["query_id", "vec_id", "score"],
                    )

    found = base.join(asked.hint("merge"), ["s", "b"]).select("ids", "weights", "q_ids", "q_weights").mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
