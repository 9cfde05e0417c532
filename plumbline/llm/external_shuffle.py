"""Sharding by a two-pass external shuffle.

Pass one scatters the rows over buckets that each fit in a task's memory, by a seeded hash; a
Spark shuffle is the scatter, so buckets spill to disk and come back after an executor is lost.
Pass two loads one bucket at a time, puts it in the order of a seeded hash of the rows, permutes
it by Fisher-Yates with a generator seeded by the bucket, and writes it. The seed and the rows alone
decide the order, not how they were laid out in files. The buckets one after another are a random order of all rows, and the
rows of each shard are read in that order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions.shared_storage import scratch_path
from plumbline.llm.common import unused


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A uniform permutation of 0..n-1: for each place from the last on, swap in one of those not placed yet."""
    rng = np.random.default_rng(list(seed))
    order = np.arange(n)
    picks = rng.integers(0, np.arange(n, 0, -1)) if n else order  # picks[k] is uniform on 0..n-1-k
    for k, j in enumerate(picks.tolist()):
        i = n - 1 - k
        order[i], order[j] = order[j], order[i]
    return order


def shard_of(key, shards: int, seed: int):
    """Rendezvous hashing: the shard whose seeded hash with the key is highest, so that one more shard only takes rows into itself."""
    return F.array_max(F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)]))["s"]


def numbered_repeats(docs: DataFrame, key: str, tie: str = "tie") -> DataFrame:
    """``docs`` with a column ``tie``: 0, or a number that tells apart rows of equal ``key``.

    Rows are numbered within their task and then by the counts of the tasks before, so that a row
    that occurs very often is never sorted in one task. Which of them gets which number doesn't
    matter, since they are equal.
    """
    none = F.lit(0).cast("bigint")
    repeated = docs.groupBy(key).count().filter("count > 1").select(key)
    if repeated.isEmpty():
        return docs.withColumn(tie, none)
    part, rank, ahead = unused([*docs.columns, tie], "part", "rank", "ahead")
    again = docs.withColumn(part, F.spark_partition_id()).join(repeated, key, "left_semi")
    per_part = again.groupBy(key, part).agg(F.count("*").alias(rank))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = per_part.select(key, part, F.coalesce(F.sum(rank).over(before), F.lit(0)).alias(ahead))
    within = Window.partitionBy(key, part).orderBy(F.lit(0))
    ties = again.withColumn(rank, F.row_number().over(within)).join(counts, [key, part]).select(*docs.columns, (F.col(rank) - 1 + F.col(ahead)).cast("bigint").alias(tie))
    return docs.join(repeated, key, "left_anti").withColumn(tie, none).unionByName(ties)


def shuffle_to_shards(docs: DataFrame, shards: int = 8, seed: int = 42, bucket_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, measures: dict | None = None) -> DataFrame:
    """Write ``docs`` in random order as ``shards`` shards, and return what was written.

    The folder ``path`` (a fresh one in the shared folder by default) gets Parquet files
    partitioned by ``shard``; ``bucket`` and ``place`` give the order within a shard. Returns the
    written rows: all columns of ``docs``, ``shard``, and ``slot``, which counts from 0 in each
    shard without gaps. Columns of ``docs`` with the names of these four are replaced. With
    ``measures`` (name to column over ``docs``) the result has these instead of the columns of
    ``docs``, taken as the shards are read, so that whole texts need not move again.

    Law ``key``: the id and the number of shards decide the shard. Equal ids share a shard, null
    being one id. Null texts are kept. Repeated rows are numbered, and so spread over buckets like
    others. A very long text is moved whole, and its bucket is as large as it at least. An empty
    table gives no rows. Seed, rows and ``bucket_bytes`` decide every slot; columns that can't be
    hashed (maps) don't tell rows apart.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot", "bucket", "place")
    lot, tie = unused([*docs.columns, "shard", "slot", "bucket", "place"], "luck", "tie")
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 64).alias("bytes")).first()["bytes"] or 0
    buckets = max(1, -(-total // bucket_bytes))
    hashed = [f.name for f in docs.schema if not f.dataType.simpleString().count("map<")]
    ties = numbered_repeats(docs.withColumn(lot, F.xxhash64(F.lit(seed), *hashed)), lot, tie)
    luck = F.xxhash64(F.lit(seed + 1), lot, tie)
    scattered = ties.select(*docs.columns, luck.alias(lot)).withColumns({"bucket": F.pmod(lot, F.lit(buckets)), "shard": shard_of(F.col(id_col), shards, seed)})
    out_type = scattered.withColumn("place", F.lit(0).cast("bigint")).schema
    arrow_type = to_arrow_schema(out_type)

    def permute(key: tuple, bucket: pa.Table) -> pa.Table:
        order = np.argsort(bucket.column(lot).to_numpy(), kind="stable")[fisher_yates(bucket.num_rows, (seed, key[0].as_py()))]
        shard = bucket.column("shard").to_numpy()[order]
        place = np.empty(len(order), np.int64)
        for s in np.unique(shard):
            place[shard == s] = np.arange((shard == s).sum())
        return pa.Table.from_arrays([*(c.combine_chunks().take(pa.array(order)) for c in bucket.columns), pa.array(place)], schema=arrow_type)

    path = path or scratch_path(spark, "shards")
    scattered.groupBy("bucket").applyInArrow(permute, out_type).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    written = spark.read.schema(out_type).parquet(path)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    out = measures or {c: F.col(c) for c in docs.columns}
    n, ahead = unused([*out, "shard", "bucket", "place"], "n", "ahead")
    sizes = written.groupBy("shard", "bucket").agg(F.count("*").alias(n)).select("shard", "bucket", F.coalesce(F.sum(n).over(before), F.lit(0)).alias(ahead))
    rows = written.select(*[e.alias(c) for c, e in out.items()], "shard", "bucket", "place")
    return rows.join(sizes, ["shard", "bucket"]).select(*out, "shard", (F.col(ahead) + F.col("place")).alias("slot"))
