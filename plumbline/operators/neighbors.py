"""Exact nearest neighbours over an index of cells and rings, which leaves out blocks that cannot hold any."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import discard, materialize
from plumbline.operators import blocks
from plumbline.operators.ranges import ranked
from plumbline.operators.similarity import _take

BLOCK = pa.schema([("cell", pa.int32()), ("block", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.binary()), ("m", pa.binary())])
FOUND = pa.schema([("q_cell", pa.int32()), ("q_block", pa.int64()), ("sample_id", pa.int64()), ("neighbor_id", pa.int64()), ("sim", pa.float64())])
BLOCK_DDL = "cell int, block bigint, low double, high double, ids binary, m binary"
EDGE = 1e-7  # added to every bound on an angle, far above the error of doubles


@dataclass
class Cells:
    """Vectors by nearest pivot (cell) and angle to it (ring), in blocks of bounded size."""

    pivots: np.ndarray
    blocks: DataFrame
    block_rows: int
    copies: int


def _unit(vectors: list) -> np.ndarray:
    m = np.array(vectors, np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _usable(df: DataFrame) -> DataFrame:
    return df.filter("embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))").select(F.col("sample_id").cast("bigint").alias("sample_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _blocked(rows: DataFrame, pivots: np.ndarray, block_rows: int) -> DataFrame:
    """Blocks of one cell each, by ascending angle to its pivot."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # at most ``max_pivots`` vectors

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                sims = _unit(batch.column("embedding").to_pylist()) @ shared.value.T
                cell = sims.argmax(1)
                angle = _angle(sims[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays([batch.column("sample_id"), batch.column("embedding"), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["sample_id", "embedding", "cell", "angle"])

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        angle = group.column("angle").to_numpy()
        ids = group.column("sample_id").to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        m = _unit(group.column("embedding").to_pylist())[order]
        return pa.table([[key[0].as_py()], [key[1].as_py()], [float(angle.min())], [float(angle.max())], [ids[order].tobytes()], [m.tobytes()]], schema=BLOCK)

    placed = rows.mapInArrow(place, "sample_id bigint, embedding array<double>, cell int, angle double")
    numbered = ranked(placed, [F.col("cell"), F.col("angle"), F.col("sample_id")])
    return numbered.withColumn("block", F.expr(f"(rk - 1) div {block_rows}")).groupBy("cell", "block").applyInArrow(pack, BLOCK_DDL)


def build_cells(base: DataFrame, copies: int, block_rows: int = 2048, max_pivots: int = 1024) -> Cells:
    """The index of every row of ``base`` (``sample_id``, ``embedding``), for searches of up to ``copies`` - 1 neighbours.

    Pivots are the vectors of the rows whose ids have the smallest hashes, one for ``block_rows`` rows
    and at most ``max_pivots``; only they pass the driver. Of rows with equal vectors the ``copies``
    smallest ids suffice, since ties go to the smaller id, so many copies of one vector cost no more
    than a few. Rows without a vector, or with null or non-finite components, take no part.
    """
    rows = _usable(base)
    same = Window.partitionBy("embedding").orderBy("sample_id")
    few = materialize(rows.withColumn("__n", F.row_number().over(same)).filter(F.col("__n") <= copies).drop("__n"), "cells-rows")
    wanted = min(max_pivots, max(1, few.count() // block_rows))
    chosen = few.orderBy(F.xxhash64("sample_id"), "sample_id").limit(wanted).select("embedding").collect()
    pivots = _unit([r["embedding"] for r in chosen]) if chosen else np.zeros((0, 0))
    cells = materialize(_blocked(few, pivots, block_rows), "cells")
    discard(few)
    return Cells(pivots, cells, block_rows, copies)


def _best(pairs: DataFrame, sides: DataFrame, index: Cells, k: int, decimals: int, bounded: bool) -> DataFrame:
    """``k`` candidates of each query in each cell of a grid that ``pairs`` (of a block of queries and one of the index) fall into; with ``bounded``, only those that its ``reach`` in ``sides`` allows.

    Blocks are dealt to the rows and columns of the grid (``blocks.grid``), and a block is sent once to
    every cell where it has a pair, not with each pair. A task holds the blocks of one cell at a time
    and returns the best of them together.
    """
    pivots, decided = index.pivots, 0.5 * 10.0**-decimals + 1e-9
    shared = pairs.sparkSession.sparkContext.broadcast(pivots)
    counts = [df.count() for df in (sides, index.blocks)]
    rows, columns = (min(max(1, n), side) for n, side in zip(counts, blocks.grid(*[n * index.block_rows for n in counts], max(1, blocks.MOST_VALUES // pivots.shape[1]), 14 * k / (8 * pivots.shape[1]))))
    deal = lambda cell, block, n: F.pmod(F.xxhash64(cell, block), F.lit(n)).cast("int")
    dealt = pairs.withColumns({"row": deal("q_cell", "q_block", rows), "column": deal("cell", "block", columns)})
    asked = dealt.groupBy("row", "column", "q_cell", "q_block").agg(F.collect_list(F.struct("cell", "block")).alias("wanted"))  # at most as many as blocks in a column
    asked = asked.join(sides.select("q_cell", "q_block", "q_ids", "q_m", "reach"), ["q_cell", "q_block"])
    given = dealt.select(*[F.col(c).alias(c) for c in ("row", "column", "cell", "block")]).distinct().join(index.blocks, ["cell", "block"])

    def one(asking: pa.Table, there: pa.Table) -> pa.Table:
        held, out = {}, []
        for x in there.to_pylist() if there.num_rows else ():
            ids = np.frombuffer(x["ids"], np.int64)
            held[x["cell"], x["block"]] = ids, np.frombuffer(x["m"], np.float64).reshape(len(ids), -1), x["low"], x["high"]
        for x in asking.to_pylist() if asking.num_rows else ():
            q_ids = np.frombuffer(x["q_ids"], np.int64)
            q_m = np.frombuffer(x["q_m"], np.float64).reshape(len(q_ids), -1)
            best, best_id, floor = np.full((len(q_ids), k), -np.inf), np.full((len(q_ids), k), -1, np.int64), np.full(len(q_ids), -np.inf)
            if bounded:
                t = np.frombuffer(x["reach"], np.float64)
                floor = np.cos(np.minimum(t, np.pi)) - 1e-9
            for w in x["wanted"]:
                ids, m, low, high = held[w["cell"], w["block"]]
                use = np.arange(len(q_ids))
                if bounded:
                    away = _angle(q_m @ shared.value[w["cell"]])
                    use = np.flatnonzero((away - t <= high) & (away + t >= low) & (_beyond(q_m, shared.value, x["q_cell"], np.array([w["cell"]]))[:, 0] <= t))
                for at in range(0, len(use), 256):
                    mine = use[at : at + 256]
                    sims = q_m[mine] @ m.T
                    least = np.maximum(floor[mine], best[mine, -1] - decided)
                    if len(ids) > k:
                        many = np.count_nonzero(sims >= least[:, None], axis=1) > 4 * k
                        if many.any():
                            least[many] = np.maximum(least[many], np.partition(sims[many], len(ids) - k, axis=1)[:, len(ids) - k] - 2 * decided)
                    r, c = np.nonzero(sims >= least[:, None])
                    if len(r):
                        part, part_id = best[mine], best_id[mine]
                        _take(part, part_id, r, ids[c], np.round(sims[r, c], decimals))
                        best[mine], best_id[mine] = part, part_id
            found = np.isfinite(best)
            n = int(found.sum())
            out.append(pa.table([np.full(n, x["q_cell"], np.int32), np.full(n, x["q_block"], np.int64), np.repeat(q_ids, found.sum(1)), best_id[found], best[found]], schema=FOUND))
        return pa.concat_tables(out) if out else FOUND.empty_table()

    keyed = lambda df: df.repartition(blocks.SPREAD * rows * columns, "row", "column").groupBy("row", "column")
    return keyed(asked).cogroup(keyed(given)).applyInArrow(one, "q_cell int, q_block bigint, sample_id bigint, neighbor_id bigint, sim double")


def _beyond(q: np.ndarray, pivots: np.ndarray, own: int, cells: np.ndarray) -> np.ndarray:
    """Least angle from each query to the half-space in which every vector of a cell lies: nearer to its pivot than to ``own``."""
    normal = pivots[cells] - pivots[own]
    size = np.linalg.norm(normal, axis=1)
    side = np.divide(-(q @ normal.T), size, out=np.zeros((len(q), len(cells))), where=size > 1e-9)
    return np.arcsin(np.clip(side, 0.0, 1.0))


def search_cells(index: Cells, queries: DataFrame, k: int, exclude_self: bool = True, decimals: int = 4) -> tuple[DataFrame, DataFrame]:
    """The ``k`` rows of the index with the highest cosine for each row of ``queries``, and the pairs of blocks that were visited.

    First a block of queries visits the rings of its own cell that its own ring overlaps. The last
    similarity found bounds the angle within which a query needs to look; a ring can hold a vector
    within it only if the query's angle to the ring's pivot allows it (triangle inequality), and the
    half-space between two pivots doesn't forbid it. What remains possible is visited, so the answer
    is exact for any data; where vectors have no clusters, few blocks can be left out.

    Answers: ``sample_id``, ``neighbor_id``, ``sim`` (rounded), ``rk`` from 1, ties to the smaller id;
    equal query vectors are looked up once. Visits: ``q_cell``, ``q_block``, ``cell``, ``block``, ``pass``.
    """
    need = k + int(exclude_self)
    if need > index.copies:
        raise ValueError(f"the index was built for {index.copies} rows a query, not {need}")
    spark, pivots = queries.sparkSession, index.pivots
    if not len(pivots):
        return spark.createDataFrame([], "sample_id bigint, neighbor_id bigint, sim double, rk int"), spark.createDataFrame([], "q_cell int, q_block bigint, cell int, block bigint, pass int")
    asked = materialize(_usable(queries), "cells-asked")
    first = asked.groupBy("embedding").agg(F.min("sample_id").alias("rep"))
    same = materialize(asked.join(first, "embedding").select("sample_id", "rep"), "cells-same")
    packed = materialize(_blocked(first.select(F.col("rep").alias("sample_id"), "embedding"), pivots, index.block_rows), "cells-queries")
    q = packed.select(F.col("cell").alias("q_cell"), F.col("block").alias("q_block"), F.col("low").alias("q_low"), F.col("high").alias("q_high"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    rings = index.blocks.select("cell", "block", "low", "high")
    own = rings.join(q.select("q_cell", "q_block", "q_low", "q_high"), F.col("cell") == F.col("q_cell"))
    near = own.filter((F.col("low") <= F.col("q_high")) & (F.col("high") >= F.col("q_low"))).select("q_cell", "q_block", "cell", "block")
    near = materialize(near, "cells-near")

    found = materialize(_best(near, q.withColumn("reach", F.lit(None).cast("binary")), index, need, decimals, False), "cells-found")
    order = Window.partitionBy("sample_id").orderBy(F.desc("sim"), "neighbor_id")
    last = found.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") == need).select("q_cell", "q_block", F.col("sample_id").alias("id"), F.col("sim").alias("last"))

    bounds = last.groupBy("q_cell", "q_block").agg(F.collect_list(F.struct("id", "last")).alias("bounds"))  # at most ``block_rows`` numbers each
    shared, slack = spark.sparkContext.broadcast(pivots), 0.5 * 10.0**-decimals + 1e-9

    def reaches(batches):  # the angle within which each query must look; all around where too few were found
        for batch in batches:
            for r in range(batch.num_rows):
                q_cell, q_block, q_ids, q_m, bound = (batch.column(c)[r].as_py() for c in range(5))
                of = {x["id"]: x["last"] for x in bound or ()}
                t = _angle(np.array([of.get(i, -2.0) for i in np.frombuffer(q_ids, np.int64).tolist()]) - slack) + EDGE
                yield pa.RecordBatch.from_arrays([pa.array([q_cell], pa.int32()), pa.array([q_block]), pa.array([q_ids]), pa.array([q_m]), pa.array([t.tobytes()])], names=["q_cell", "q_block", "q_ids", "q_m", "reach"])

    def spans(batches):  # the rings of every cell that a block of queries may need
        for batch in batches:
            for r in range(batch.num_rows):
                q_cell, q_block, q_m, reach = (batch.column(c)[r].as_py() for c in range(4))
                t = np.frombuffer(reach, np.float64)[:, None]
                m = np.frombuffer(q_m, np.float64).reshape(len(t), -1)
                for at in range(0, len(shared.value), 256):
                    cells = np.arange(at, min(at + 256, len(shared.value)))
                    away = _angle(m @ shared.value[cells].T)
                    able = _beyond(m, shared.value, q_cell, cells) <= t
                    low, high, use = np.where(able, away - t, np.inf).min(0), np.where(able, away + t, -np.inf).max(0), able.any(0)
                    n = int(use.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([q_cell] * n, pa.int32()), pa.array([q_block] * n, pa.int64()), pa.array(cells[use].astype(np.int32)), pa.array(low[use]), pa.array(high[use])], names=["q_cell", "q_block", "cell", "start", "stop"])

    known = q.join(bounds, ["q_cell", "q_block"], "left").select("q_cell", "q_block", "q_ids", "q_m", "bounds")
    sides = materialize(known.mapInArrow(reaches, "q_cell int, q_block bigint, q_ids binary, q_m binary, reach binary"), "cells-reach")
    wide = sides.select("q_cell", "q_block", "q_m", "reach").mapInArrow(spans, "q_cell int, q_block bigint, cell int, start double, stop double")
    more = wide.join(rings, "cell").filter((F.col("low") <= F.col("stop")) & (F.col("high") >= F.col("start"))).select("q_cell", "q_block", "cell", "block")
    more = materialize(more.join(near, ["q_cell", "q_block", "cell", "block"], "left_anti"), "cells-more")
    rest = _best(more, sides, index, need, decimals, True)
    best = materialize(found.unionByName(rest).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= need).select(F.col("sample_id").alias("rep"), "neighbor_id", "sim"), "cells-best")
    answers = same.join(best, "rep").select("sample_id", "neighbor_id", "sim")
    if exclude_self:
        answers = answers.filter("sample_id <> neighbor_id")
    answers = answers.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k)
    visits = near.withColumn("pass", F.lit(1)).unionByName(more.withColumn("pass", F.lit(2)))
    return answers, visits


def nearest(queries: DataFrame, base: DataFrame, k: int, exclude_self: bool = True, decimals: int = 4, block_rows: int = 2048, max_pivots: int = 1024) -> DataFrame:
    """What ``similarity.knn_join`` returns, by cells and rings."""
    index = build_cells(base, k + int(exclude_self), block_rows, max_pivots)
    return search_cells(index, queries, k, exclude_self, decimals)[0]
