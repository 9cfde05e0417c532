"""Every row of one table against every row of another, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells to split the work into, rows of a block below which it isn't split further, and values (rows times length) of a block.
CELLS, LEAST_ROWS, MOST_VALUES = 64, 512, 1 << 22
#: Partitions for each cell: cells are dealt by hash, and among as many partitions as cells one would often hold three or four.
SPREAD = 4
CLOSE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int32()), ("mirror_distance", pa.int32())])
#: Of all pairs, the share that lookups may visit among random signatures; beyond it, comparing every pair in blocks is less work.
LOOKUPS = 0.01
PACKED = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("m", pa.binary())])


def grid(n_left: int, n_right: int, block_rows: int, answer: float = 0.0) -> tuple[int, int]:
    """Into how many blocks to deal either side.

    The left side is sent once for each block of the right one, and the other way round. Blocks hold
    ``block_rows`` at most; beyond that they are split until there are enough cells, always on the
    side where that moves less. ``answer`` is the size of what a left row gets from each right block,
    against its own. So what is moved grows with the rows from some 5,000 of them (fewer are sent
    less often) as long as ``CELLS`` blocks' pairs hold them, and with their square over
    ``block_rows`` from then on.
    """
    sides = [max(1, -(-n // block_rows)) for n in (n_left, n_right)]
    most = [max(s, -(-n // LEAST_ROWS)) for s, n in zip(sides, (n_left, n_right))]
    while sides[0] * sides[1] < CELLS:
        costs = [n_right * sides[0], n_left * (1 + answer) * sides[1]]
        open_ = [i for i in (0, 1) if sides[i] < most[i]]
        if not open_:
            break
        i = min(open_, key=costs.__getitem__)
        sides[i] += 1
    return sides[0], sides[1]


def packed(rows: DataFrame, column: str, blocks: int) -> DataFrame:
    """``block``, and the ``ids`` and values (``m``) of its rows as bytes, a row for each batch and block; ``rows`` has ``sample_id`` (bigint) and ``column``, numbers or arrays of one length."""

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            block, ids, values = (batch.column(c) for c in ("block", "sample_id", column))
            if pa.types.is_list(values.type):
                if len(pc.unique(pc.list_value_length(values))) > 1:
                    raise ValueError(f"the arrays of {column} differ in length")
                values = values.flatten()
            m = values.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            block, ids = block.to_numpy(), ids.to_numpy()
            which = np.unique(block)
            own = [block == b for b in which]
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([ids[o].tobytes() for o in own], pa.binary()), pa.array([m[o].tobytes() for o in own], pa.binary())], schema=PACKED)

    dealt = rows.select("sample_id", column, F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int").alias("block"))
    return dealt.mapInArrow(pack, "block int, ids binary, m binary")


def _joined(group: pa.Table, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids, ascending, and their values."""
    parts = {c: group.column(c).to_pylist() if group.num_rows else [] for c in ("ids", "m")}  # a group without rows has no columns
    if len({len(m) / len(i) for i, m in zip(parts["ids"], parts["m"])}) > 1:
        raise ValueError("the arrays differ in length")
    ids = np.frombuffer(b"".join(parts["ids"]), np.int64)
    m = np.frombuffer(b"".join(parts["m"]), dtype).reshape(len(ids), -1) if len(ids) else np.empty((0, 0), dtype)
    order = np.argsort(ids, kind="stable")
    return ids[order], m[order]


def meet(left: DataFrame, right: DataFrame, sides: tuple[int, int], dtypes: tuple, compare: Callable, schema: str, halved: bool = False) -> DataFrame:
    """What ``compare(left ids, left values, right ids, right values)`` gives for each pair of blocks of two ``packed`` tables; one pair at a time is in a task's memory.

    With ``halved`` both tables are the same, and of two blocks only one order is looked at.
    """

    def one(a: pa.Table, b: pa.Table) -> pa.Table:
        return compare(*_joined(a, dtypes[0]), *_joined(b, dtypes[1]))

    along = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = left.select(F.col("block").alias("row"), along(sides[1]).alias("column"), "ids", "m")
    columns = right.select(along(sides[0]).alias("row"), F.col("block").alias("column"), "ids", "m")
    if halved:
        rows, columns = rows.filter("row <= column"), columns.filter("row <= column")
    keyed = lambda df: df.repartition(SPREAD * sides[0] * sides[1], "row", "column").groupBy("row", "column")
    return keyed(rows).cogroup(keyed(columns)).applyInArrow(one, schema)


def close_signatures(kinds: DataFrame, max_distance: int, block_rows: int = 1 << 18) -> DataFrame:
    """Pairs ``a`` < ``b`` of ``kinds`` whose ``hash`` differs in at most ``max_distance`` bits from the other's ``hash`` or ``flip``: ``distance`` and ``mirror_distance``, both in full.

    ``kinds`` has one row for each ``sample_id`` (bigint), with a 64-bit ``hash`` and a ``flip`` that may be
    null. Every pair is compared, in blocks of bounded size; nothing is looked up or broadcast.
    """
    values = F.array(F.col("hash"), F.coalesce("flip", F.lit(0).cast("bigint")), F.isnotnull("flip").cast("bigint"))
    n = kinds.count()
    side = max(1, min(20, -(-n // LEAST_ROWS)), -(-n // block_rows))

    def compare(ids: np.ndarray, m: np.ndarray, other_ids: np.ndarray, other: np.ndarray) -> pa.Table:
        found = []
        far = lambda x, y: np.bitwise_count(x[:, None] ^ y[None, :])
        m, other = m.view(np.uint64), other.view(np.uint64)
        same = np.array_equal(ids, other_ids)
        for at in range(0, len(ids) if len(other_ids) else 0, 256):
            h, f, has = (np.ascontiguousarray(m[at : at + 256, i]) for i in range(3))
            for start in range(at if same else 0, len(other_ids), 4096):
                g, e, own = (np.ascontiguousarray(other[start : start + 4096, i]) for i in range(3))
                straight = far(h, g)
                mirrored = np.minimum(np.where(own[None, :] > 0, far(h, e), 65), np.where(has[:, None] > 0, far(f, g), 65)) if own.any() or has.any() else np.full(straight.shape, 65, np.uint8)
                flat = np.flatnonzero(np.minimum(straight, mirrored) <= max_distance)
                r, c = np.divmod(flat, len(g))
                a, b = ids[at + r], other_ids[start + c]
                keep = a < b if same else a != b
                a, b, d, x = a[keep], b[keep], straight.ravel()[flat][keep].astype(np.int32), mirrored.ravel()[flat][keep].astype(np.int32)
                found.append(pa.table([np.minimum(a, b), np.maximum(a, b), pa.array(d), pa.array(x, mask=x > 64)], schema=CLOSE))
        return pa.concat_tables(found) if found else CLOSE.empty_table()

    table = lambda: packed(kinds.select("sample_id", values.alias("values")), "values", side)
    return meet(table(), table(), (side, side), (np.int64, np.int64), compare, "a bigint, b bigint, distance int, mirror_distance int", halved=True)
