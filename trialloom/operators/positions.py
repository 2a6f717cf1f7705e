"""A global sort whose partitions stay fixed, and exact positions within groups by it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialloom.session import materialize

PART = "__part"


def range_sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with the partition's number in ``__part``.

    The result is a checkpoint: range boundaries are sampled anew whenever a plan
    runs, so positions may only be counted over partitions written once. A key of
    any weight is spread over as many partitions as its rows need, as long as
    ``order`` goes on behind the key.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn(PART, F.spark_partition_id()))


def _codes(frame: pd.DataFrame) -> np.ndarray:
    """One integer row per row, equal where all columns are equal; null equals null."""
    return np.column_stack([pd.factorize(frame[c], use_na_sentinel=False)[0] for c in frame.columns])


def _same(a: tuple, b: tuple) -> bool:
    return all((pd.isna(x) and pd.isna(y)) or x == y for x, y in zip(a, b, strict=True))


def _local_positions(groups: list[str], out: str, limit: int | None):
    """Numbers the rows of each run of a group within its sorted partition, keeping the first ``limit``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        seen = 0
        for batch in batches:
            if batch.empty:
                continue
            codes = _codes(batch[groups])
            starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)])
            run_of = np.searchsorted(starts, np.arange(len(batch)), side="right") - 1
            position = np.arange(len(batch)) - starts[run_of] + 1
            first, final = (tuple(batch[groups].iloc[i]) for i in (0, -1))
            if last is not None and _same(first, last):
                position[run_of == 0] += seen
            last, seen = final, int(position[-1])
            kept = position <= limit if limit else np.ones(len(batch), dtype=bool)
            yield batch[kept].assign(**{out: position[kept].astype("int64")})

    return run


def group_positions(df: DataFrame, groups: list[str], order: list[Column], out: str = "position", limit: int | None = None) -> DataFrame:
    """``df`` with each row's position within its group in ``order``, from 1; with ``limit`` only the first ones.

    The rows are sorted globally by group and order; counts of each group per
    partition, summed up over the partitions before, turn positions within a
    partition into positions within the group. No task holds a group, whatever
    its size. A null group is a group of its own; rows that ``order`` doesn't
    tell apart come in any order. An empty table gives an empty result.
    """
    fixed = range_sorted(df, [F.col(g).asc_nulls_first() for g in groups] + order)
    counts = fixed.groupBy(PART, *groups).agg(F.count(F.lit(1)).alias("__count"))
    before = Window.partitionBy(*groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(PART).alias("__of"), *(F.col(g).alias(f"__{g}") for g in groups), F.sum("__count").over(before).alias("__before"))
    # In a sorted table only the first group of a partition can have rows before it: at most one row a partition.
    offsets = F.broadcast(offsets.where("__before > 0"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fixed.schema.fields) + f", `{out}` bigint"
    local = fixed.mapInPandas(_local_positions(groups, out, limit), schema)
    match = F.col(PART) == F.col("__of")
    for g in groups:
        match &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    position = F.col(out) + F.coalesce("__before", F.lit(0))
    placed = local.join(offsets, match, "left").select(*df.columns, position.alias(out))
    return placed.where(F.col(out) <= limit) if limit else placed


def sums_before(df: DataFrame, keys: list[str], place: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of its keys with a smaller ``place``, 0 for the first.

    ``place`` is a whole number from 0, one row for each of a key's places. Two
    levels of prefix sums, over blocks of places and within each block, so no task
    has more than ``block`` rows of a key or one row a block. Null keys are keys.
    """
    blocked = df.withColumn("__block", F.floor(F.col(place) / block))
    sums = blocked.groupBy(*keys, "__block").agg(F.sum(value).alias("__sum"))
    over_blocks = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__block").alias("__of"), F.coalesce(F.sum("__sum").over(over_blocks), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy(*keys, "__block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    match = F.col("__block") == F.col("__of")
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return blocked.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(ahead, match).select(*df.columns, (F.col("__ahead") + F.col("__inside")).alias(out))
