"""Membership filters of bounded size as tables of bitmaps, built and tested by DataFrame functions.

A hash sets one bit; the bits lie in rows of fixed size, so that a filter is built by Spark's
bitmap aggregate and reaches the tasks as a broadcast of a known greatest size. A filter that
fills up lets more rows pass and never fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.session import cut_lineage

#: Bits of one row, the size of Spark's bitmap aggregates.
ROW_BITS = 32_768
#: Bits for each member, and the most bits of a filter: 64 MB, whatever its members.
BITS_PER_MEMBER, MOST_BITS = 16, 1 << 29


def filter_bits(members: int) -> int:
    """A power of two, at least one row and at most ``MOST_BITS``."""
    bits = ROW_BITS
    while bits < min(members * BITS_PER_MEMBER, MOST_BITS):
        bits *= 2
    return bits


def slot(key: Column, bits: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(bits - 1).cast("long"))


def _bit(slot_column: Column) -> Column:
    return slot_column.bitwiseAND(F.lit(ROW_BITS - 1).cast("long"))


def bitmap_rows(slots: DataFrame) -> DataFrame:
    """``(filter_row, filter_bits)`` of the column ``slot``."""
    return slots.groupBy(F.shiftright("slot", 15).alias("filter_row")).agg(
        F.bitmap_construct_agg(_bit(F.col("slot"))).alias("filter_bits")
    )


def tested(rows: DataFrame, key: Column, filters: DataFrame, bits: int, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: whether the bit of ``key`` is set."""
    at = slot(key, bits)
    byte = F.conv(F.hex(F.substring("filter_bits", (F.shiftright(_bit(at), 3) + 1).cast("int"), F.lit(1))), 16, 10)
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (_bit(at).bitwiseAND(F.lit(7).cast("long")) + 1).cast("int"))
    hit = byte.cast("int").bitwiseAND(mask) != 0
    return rows.join(F.broadcast(filters), F.shiftright(at, 15) == filters["filter_row"], "left").select(
        *rows.columns, F.coalesce(hit, F.lit(False)).alias(name)
    )


def narrowed(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in the only column of ``wanted``.

    A join with ``wanted`` must follow; what it shuffles is then about as much as it keeps. Equal
    integers of different types hash differently, so members are hashed in the type of ``key``.
    """
    bits = filter_bits(wanted.count())
    member = F.col(wanted.columns[0]).cast(rows.schema[key].dataType)
    slots = wanted.select(slot(member, bits).alias("slot"))
    filters = cut_lineage(bitmap_rows(slots))
    return tested(rows, F.col(key), filters, bits, "may_match").where("may_match").drop("may_match")
