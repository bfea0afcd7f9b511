"""Running totals and ranks that survive hot groups.

A plain ``sum() OVER (PARTITION BY g ORDER BY ...)`` sends all rows of a group
to one task.  When one group may hold a third of a table that task never ends.
Here a group is split into consecutive buckets of its order key: totals per
bucket are pre-aggregated (map-side), their prefix sums are taken over the
small bucket table, and the exact window runs inside one bucket only.

Buckets follow from the order key where its values are spread; where they may
not be (all rows of a group at one time), ``by_range`` makes buckets of even
size out of the order itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.session import write_table


def running_total(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column],
                  value: Column, name: str) -> DataFrame:
    """Adds ``name``: the inclusive running sum of ``value`` within ``by``.

    ``bucket`` must be non-decreasing along ``order`` inside each group (for
    instance ``floor(pos / 4096)`` or a day), and non-NULL like the ``by``
    columns.
    """
    keys = list(by)
    tagged = df.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = tagged.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        tagged.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_offset") + F.sum("_value").over(inside))
        .drop("_bucket", "_value", "_offset")
    )


def running_rank(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column],
                 name: str = "rank") -> DataFrame:
    """Exact 1-based ``row_number`` within ``by`` for groups of any size."""
    return running_total(df, by, bucket, order, F.lit(1).cast("bigint"), name)


def by_range(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows dealt by range of (``by``, ``order``), with ``_part`` and ``_at``.

    ``_part`` is a row's task, ``_at`` its place among all rows.  A group takes as
    many tasks as its rows need, whatever their times are; of ``order`` the last
    column should tell rows apart.  The rows are written once, so that every
    reader sees the same places.  The number of tasks is named, as adaptive
    execution joins ranges of few bytes again, however many rows they have.
    """
    keys = [F.col(c) for c in by] + list(order)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    placed = write_table(dealt.withColumn("_at", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_at", 33))


def rank_by_range(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Exact 1-based ``row_number`` within ``by``; the rows of one group spread over all tasks.

    A row's rank is its place in its task plus the rows of its group in the tasks
    before; only counts per task and group are gathered.
    """
    keys, placed = list(by), by_range(df, by, order)
    held = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_held"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("_part").alias("_piece"), "_first",
                          F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_offset"))
    same = F.col("_part") == F.col("_piece")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return placed.join(offsets, same).withColumn(
        name, F.col("_offset") + F.col("_at") - F.col("_first") + 1).select(*df.columns, name)


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int,
          name: str = "rank") -> DataFrame:
    """First ``n`` rows per group.

    The literal bound lets Spark cut each group on the map side before the
    shuffle, so a hot group sends at most ``n`` rows per input task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= F.lit(n))


def first_per_key(df: DataFrame, by: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the one with the smallest ``order`` (map-side combined)."""
    rest = [c for c in df.columns if c not in by]
    if not rest:
        return df.distinct()
    packed = F.min_by(F.struct(*rest), order).alias("_row")
    return df.groupBy(*by).agg(packed).select(
        *by, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
