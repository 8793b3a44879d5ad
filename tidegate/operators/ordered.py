"""Order-dependent operators that survive a hot key.

A plain window puts every row of a key into one task. Here the caller names a bucket that
grows with the order (``seq div 4096``, a date, a quantile), rows are windowed per
(key, bucket) and only one summary row per bucket is carried across buckets. A key that
owns a third of all rows is thus spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a quantile bucket, on average.
BUCKET_ROWS = 65_536


def _carry(summary: DataFrame, keys: list[str], bucket: str, value: Column, name: str) -> DataFrame:
    """Evaluate ``value`` over the buckets before each bucket of a key."""
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return summary.select(*keys, bucket, value.over(earlier).alias(name))


def running_sum(
    rows: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Inclusive running sum of ``value`` in key order."""
    valued = rows.withColumn("_value", value)
    totals = valued.groupBy(*keys, bucket).agg(F.sum("_value").alias("_total"))
    before = _carry(totals, keys, bucket, F.sum("_total"), "_before")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    local = valued.withColumn("_local", F.sum("_value").over(inside))
    return (
        local.join(before, [*keys, bucket])
        .withColumn(name, F.coalesce(F.col("_before"), F.lit(0)) + F.col("_local"))
        .drop("_value", "_local", "_before")
    )


def ranked(
    rows: DataFrame, keys: list[str], bucket: str, order: list[Column], name: str = "position"
) -> DataFrame:
    """Row numbers from 1 in key order."""
    return running_sum(rows, keys, bucket, order, F.lit(1).cast("long"), name)


def last_before(
    rows: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Last non-null ``value`` strictly before each row in key order."""
    valued = rows.withColumn("_value", value)
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    final = valued.where(F.col("_value").isNotNull()).groupBy(*keys, bucket).agg(
        F.max_by("_value", F.struct(*[_plain(c, i) for i, c in enumerate(order)])).alias("_final")
    )
    every = valued.select(*keys, bucket).distinct().join(final, [*keys, bucket], "left")
    carried = _carry(every, keys, bucket, F.last("_final", ignorenulls=True), "_carried")
    local = valued.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    return (
        local.join(carried, [*keys, bucket])
        .withColumn(name, F.coalesce("_local", "_carried"))
        .drop("_value", "_local", "_carried")
    )


def _plain(column: Column, position: int) -> Column:
    return column.alias(f"o{position}")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "position") -> DataFrame:
    """First ``k`` rows per key.

    The rank filter sits directly on the window, so Spark keeps only ``k`` rows per key and
    map task before it shuffles.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def latest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Newest row per key as an aggregate, combined before the shuffle."""
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def exact_percentiles(
    rows: DataFrame, keys: list[str], value: str, percents: list[float], buckets: int | None = None
) -> DataFrame:
    """Linear-interpolated percentiles without holding a group in one task.

    Values are reduced to counts, spread over quantile buckets from a mergeable sketch and
    counted up with carried bucket totals; the rows around each rank give the answer. The number
    of buckets follows the number of rows, so a global group uses as many tasks as it needs.
    """
    source = rows.where(F.col(value).isNotNull())
    if buckets is None:
        buckets = max(2, -(-source.count() // BUCKET_ROWS))
    counts = source.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = source.groupBy(*keys).agg(
        F.struct(
            F.percentile_approx(value, cuts, max(1000, 10 * buckets)).alias("cuts"), F.count("*").alias("size")
        ).alias("_bounds")
    )
    bounded = (
        counts.join(bounds, keys) if keys else counts.withColumn("_bounds", bounds.scalar())
    )
    placed = bounded.withColumns({
        "_size": F.col("_bounds.size"),
        "_bucket": F.size(F.filter("_bounds.cuts", lambda cut: cut <= F.col(value))),
    }).drop("_bounds")
    summed = running_sum(placed, keys, "_bucket", [F.col(value)], F.col("_n"), "_upto")
    outputs = []
    for percent in percents:
        rank = F.lit(percent / 100.0) * (F.col("_size") - 1)
        low = F.floor(rank)
        high = F.least(low + 1, F.col("_size") - 1)
        weight = rank - low
        covers = (
            lambda index: (F.col("_upto") > index) & (F.col("_upto") - F.col("_n") <= index)
        )
        label = f"p{percent:g}"
        outputs.append(
            (
                F.max(F.when(covers(low), F.col(value) * (F.lit(1.0) - weight)))
                + F.max(F.when(covers(high), F.col(value) * weight))
            ).alias(label)
        )
    return summed.groupBy(*keys).agg(*outputs)
