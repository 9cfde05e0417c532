"""Small helpers of the operators in this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

def unused(columns: list[str], *names: str) -> list[str]:
    """Names like ``names`` that no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: The one thing that a worker process keeps from task to task, by its key.
_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, kept by this worker process for its next tasks, until something else is."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Drop what is kept and return its memory, since worker processes are reused by operators that don't need it."""
    if _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], rows_at_once: int = 2000, keeps: bool = False) -> DataFrame:
    """Apply a function of Arrow batches, built once per task, in slices of at most ``rows_at_once`` rows.

    ``make`` runs on the executor and returns a function from a batch to a dict of columns.
    Slicing bounds the Python objects alive at a time, whatever the session's batch size. Unless
    the function ``keeps`` something itself, what an earlier task kept is dropped.
    """
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = None
        if not keeps:
            release()
        for batch in batches:
            apply = apply or make()
            for at in range(0, batch.num_rows, rows_at_once):
                out = apply(batch.slice(at, rows_at_once))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)
