"""Numbering and running totals inside keys of any size.

A plain window over a key sorts that whole key in one task. These helpers split
every key into blocks along its order, work inside the blocks, and add what the
earlier blocks hold. The window over a key then sees one row per block only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a block when the order column is an integer position.
BLOCK = 4096


def block_of(position: Column, width: int = BLOCK) -> Column:
    return F.floor(position / width).cast("bigint")


def number_rows(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence, name: str) -> DataFrame:
    """1-based position of each row inside its key. ``block`` must never decrease along ``order``."""
    keys = list(keys)
    blocked = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block")
    # rows without a key or a block get no number; those without a block still count as a first block
    ranked = blocked.dropna(subset=[*keys, "_block"]).withColumn("_rank", F.row_number().over(inside.orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocked.groupBy(*keys, "_block")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(before))
        # most keys fit one block, so few rows are left to be joined
        .where(F.col("_before").isNotNull())
        .drop("_n")
    )
    return (
        ranked.join(starts, [*keys, "_block"], "left")
        .withColumn(name, F.col("_rank") + F.coalesce("_before", F.lit(0)))
        .drop("_block", "_rank", "_before")
    )


def running_sums(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence, sums: dict[str, Column]
) -> DataFrame:
    """Inclusive running totals inside each key; ``sums`` maps new columns to the values added up."""
    keys = list(keys)
    valued = df.withColumn("_block", block)
    for name, value in sums.items():
        valued = valued.withColumn(name, value)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = valued.groupBy(*keys, "_block").agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
    starts = totals.select(
        *keys, "_block", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums]
    )
    local = valued.select("*", *[F.sum(n).over(inside).alias(f"_l_{n}") for n in sums])
    joined = local.join(starts, [*keys, "_block"])
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_l_{name}") + F.col(f"_b_{name}"))
    return joined.drop("_block", *[f"_{p}_{n}" for p in "lb" for n in sums])


def previous_value(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Value of the preceding row inside each key, reaching back over block borders."""
    keys = list(keys)
    blocked = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    local = blocked.withColumn("_here", F.lag(value).over(inside)).withColumn("_rank", F.row_number().over(inside))
    before = Window.partitionBy(*keys).orderBy("_block")
    ends = (
        blocked.groupBy(*keys, "_block")
        .agg(F.max_by(value, F.struct(*order)).alias("_last"))
        .select(*keys, "_block", F.lag("_last").over(before).alias("_before"))
    )
    return (
        local.join(ends, [*keys, "_block"])
        .withColumn(name, F.when(F.col("_rank") == 1, F.col("_before")).otherwise(F.col("_here")))
        .drop("_block", "_here", "_rank", "_before")
    )
