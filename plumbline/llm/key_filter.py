"""Rows of a large table that may have one of many keys, told apart without shuffling the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize
from plumbline.llm.common import unused

PAGE = 32_768  # bits of a row of the bitmap, 4 KB
MOST_BITS = 2**27  # 16 MB: the largest bitmap that is broadcast


def split_by_keys(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` may be among ``keys``, and those whose key surely isn't.

    The keys are hashed into a bitmap of 16 bits each, but never of more than ``MOST_BITS``, so
    that what is broadcast is bounded. Beyond some eight million keys more and more rows pass that
    have none; a join with the keys themselves must follow. A null key is surely not among them.
    """
    n, bits = keys.count(), PAGE
    page, bytes_ = unused(rows.columns, "__page", "__bits")
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    pages = keys.filter(F.col(key).isNotNull()).groupBy((at / PAGE).cast("int").alias(page)).agg(F.bitmap_construct_agg((at % PAGE).cast("bigint")).alias(bytes_))
    pages = materialize(pages, "key-bitmap")
    place = (at % PAGE).cast("int")
    byte = F.conv(F.hex(F.substring(bytes_, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn(page, (at / PAGE).cast("int")).join(F.broadcast(pages), page, "left")  # at most MOST_BITS
    has = F.col(bytes_).isNotNull() & F.col(key).isNotNull() & (F.shiftrightunsigned(byte, 0).bitwiseAND(F.expr(f"shiftleft(1, cast(pmod(pmod(xxhash64(`{key}`), {bits}), 8) as int))")) != 0)
    has = F.coalesce(has, F.lit(False))
    return marked.filter(has).select(*rows.columns), marked.filter(~has).select(*rows.columns)
