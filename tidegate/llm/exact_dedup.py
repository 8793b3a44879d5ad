"""Operator 10: exact dedup by two passes of Bloom filtering, DataFrame functions only.

The first pass sets, for every text hash, one bit of a counting table of bounded size and keeps
the bits that were hit twice or more. The second pass tests every row against those bits: a row
whose bit was hit once has no equal, and goes straight to the result with its partition; only
rows that may be repeated shuffle, as identifier and digest. A filter that fills up sends more
rows through the shuffle and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm import bitmaps
from tidegate.session import cut_lineage


def normalised(text: Column) -> Column:
    """White space runs as one space; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: Column) -> Column:
    """Texts are equal when these are: SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def seen_twice(hashed: DataFrame) -> tuple[DataFrame, int]:
    """First pass: the written filter of the bits that two or more rows hit, and its size.

    Counts are summed in each task before the shuffle, so a text of many copies is a row a task.
    """
    bits = bitmaps.filter_bits(hashed.count())
    counted = hashed.groupBy(bitmaps.slot(F.col("digest"), bits).alias("slot")).count()
    return cut_lineage(bitmaps.bitmap_rows(counted.where("count > 1"))), bits


def may_repeat(hashed: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """Second pass: ``hashed`` with a column ``may_repeat``; the bounded filter is broadcast."""
    return bitmaps.tested(hashed, F.col("digest"), filters, bits, "may_repeat")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``(id_col, keep_id, group_size, kept, text_sha256)``.

    Of equal texts the smallest identifier is kept. Null texts count as empty ones and equal
    them. Rows with the same identifier and text are kept together; a null identifier is kept
    only in a group without others. Other columns are not read.
    """
    hashed = cut_lineage(docs.select(F.col(id_col).alias("id"), digest_of(F.col(text_col)).alias("digest")))
    tested = may_repeat(hashed, *seen_twice(hashed))
    alone = tested.where("not may_repeat").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest"
    )
    return alone.unionByName(_met(tested)).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with their columns.

    Rows that cannot be repeated pass straight through with their texts; of the others the
    dropped identifiers are taken away. Identifiers are taken to be unique; a row without one
    stays.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*columns)
    key, text = (columns[docs.columns.index(c)] for c in (id_col, text_col))
    hashed = cut_lineage(held.select(F.col(key).alias("id"), digest_of(F.col(text)).alias("digest")))
    filters, bits = seen_twice(hashed)
    dropped = cut_lineage(
        _met(may_repeat(hashed, filters, bits)).where("id <> keep_id").select(F.col("id").alias("dropped_id"))
    )
    tested = may_repeat(held.withColumn("digest", digest_of(F.col(text))), filters, bits)
    maybe = tested.where("may_repeat").join(dropped, F.col(key) == F.col("dropped_id"), "left_anti")
    return tested.where("not may_repeat").select(*columns).union(maybe.select(*columns)).toDF(*docs.columns)


def _met(tested: DataFrame) -> DataFrame:
    """Rows that may be repeated, with their group: ``(id, keep_id, group_size, digest)``."""
    maybe = tested.where("may_repeat").select("id", "digest")
    groups = cut_lineage(
        maybe.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    # both sides are plain shuffles, so adaptive execution splits the digest of a large group
    return maybe.join(groups, "digest").select("id", "keep_id", "group_size", "digest")
