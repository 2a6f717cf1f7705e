"""Fusing ranked channels: normalization, weighted sums, rank fusion, unions.

A channel table has one row per group (a case), channel and item, with a score;
``channels`` lists the channels in order, the first one leading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialloom.operators.ranking import RANK_DIGITS, top_k


def min_max(rows: DataFrame, group: list[str], score: str = "score", out: str = "norm", relative: float = 1e-9, short: bool = False) -> DataFrame:
    """Scores of each group scaled to 0..1; where all are equal, 1 if positive, else 0.

    ``relative`` is how close counts as equal, as a part of the larger value; 0
    asks for equality. Null scores count as 0. Groups of any size are reduced by
    partial aggregation and joined back; ``short`` says that groups are bounded (lists
    of k items), and reads their bounds in a window over the rows, which are made once.
    """
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    if short:
        over = Window.partitionBy(*group)
        wide = rows.withColumns({"__low": F.min(value).over(over), "__high": F.max(value).over(over)})
    else:
        bounds = rows.groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
        wide = rows.join(bounds, _same(group), "left")
    low, high = F.col("__low"), F.col("__high")
    equal = (high - low) <= relative * F.greatest(F.abs(low), F.abs(high))
    scaled = F.when(equal, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((value - low) / (high - low))
    return wide.select(*rows.columns, scaled.alias(out))


def _same(group: list[str]) -> Column:
    condition = F.lit(True)
    for g in group:
        condition &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    return condition


def _by_channel(channels: list[str], channel: str, value: str) -> list[Column]:
    return [F.max(F.when(F.col(channel) == c, F.col(value))).alias(f"{value}_{c}") for c in channels]


def fuse(rows: DataFrame, group: list[str], item: str, channels: list[str], weights: dict[str, float] | None = None, mode: str = "weighted", compat: bool = True, relative: float = 1e-9, short: bool = False) -> DataFrame:
    """(group, item, n_channels, score) of every item of any channel, as a full outer merge.

    ``weighted``: the weighted sum of normalized scores over the weights of the
    channels with rows in the group. ``sum``: their plain sum. ``structured``: the
    plain sum, and with ``compat`` the raw score of the first channel on top.
    Merging is one aggregation, so no channel is joined to another. ``short`` says that
    channels are lists of bounded length (see ``min_max``).
    """
    weights = weights or dict.fromkeys(channels, 1.0)
    normed = min_max(rows.where(F.col("channel").isin(channels)), [*group, "channel"], relative=relative, short=short)
    merged = normed.groupBy(*group, item).agg(*_by_channel(channels, "channel", "norm"), *_by_channel(channels, "channel", "score"), F.countDistinct("channel").cast("int").alias("n_channels"))
    if mode == "weighted" and short:
        there = [F.max(F.col(f"norm_{c}").isNotNull().cast("int")).over(Window.partitionBy(*group)) * float(max(weights.get(c, 0.0), 0.0)) for c in channels]
        merged = merged.withColumn("__active", sum(there[1:], there[0]))
    elif mode == "weighted":
        total = F.lit(0.0)
        for c in channels:
            total = total + F.max((F.col("channel") == c).cast("int")) * float(max(weights.get(c, 0.0), 0.0))
        active = rows.where(F.col("channel").isin(channels)).groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg(total.alias("__active"))
        merged = merged.join(active, _same(group), "left")
    score = F.lit(0.0)
    for c in channels:
        factor = float(max(weights.get(c, 0.0), 0.0)) if mode == "weighted" else 1.0
        score = score + F.coalesce(F.col(f"norm_{c}"), F.lit(0.0)) * factor
    if mode == "weighted":
        score = F.when(F.col("__active") > 0, score / F.col("__active")).otherwise(score)
    if mode == "structured" and compat:
        score = score + F.coalesce(*[F.when(F.col(f"norm_{c}").isNotNull(), F.coalesce(F.col(f"score_{c}"), F.lit(0.0))) for c in channels], F.lit(0.0))
    return merged.select(*group, item, "n_channels", score.alias("score"))


def reciprocal_rank(ranked: DataFrame, group: list[str], item: str, rank: str = "rank", k: int = 60) -> DataFrame:
    """(group, item, n_lists, rrf) of every item: the sum of 1 / (k + rank) over the lists it is in."""
    return ranked.groupBy(*group, item).agg(F.count(F.lit(1)).cast("int").alias("n_lists"), F.sum(1.0 / (F.lit(k) + F.col(rank))).alias("rrf"))


def weighted_reciprocal_rank(ranked: DataFrame, group: list[str], item: str, weight: Column, priority: Column, alignment: Column, floor: Column, rank: str = "rank", k: int = 30) -> DataFrame:
    """(group, item, score): each hit counts weight / sqrt(priority) / (k + rank) * (floor + (1 - floor) * alignment)."""
    part = weight / F.sqrt(F.greatest(priority.cast("double"), F.lit(1.0))) / (F.lit(k) + F.col(rank)) * (floor + (1 - floor) * alignment)
    return ranked.withColumn("__part", part).groupBy(*group, item).agg(F.sum("__part").alias("score"))


def hybrid_union(ranked: DataFrame, group: list[str], item: str, channels: list[str], k: int, rank: str = "rank") -> DataFrame:
    """The first half of ``k`` of each channel in turn, each item once, with its place and channels.

    Each branch gives its first ceil(k / number of channels) items; the first
    channel comes first, and at most ``k`` are kept.
    """
    branch = -(-max(int(k), 1) // len(channels))
    order = F.lit(len(channels))
    for i, c in reversed(list(enumerate(channels))):
        order = F.when(F.col("channel") == c, i).otherwise(order)
    taken = ranked.where(F.col("channel").isin(channels) & (F.col(rank) <= branch)).withColumn("__order", order)
    merged = taken.groupBy(*group, item).agg(F.min(F.struct("__order", rank)).alias("__first"), F.array_sort(F.collect_set("channel")).alias("source_channels"))
    placed = top_k(merged, group, [F.col("__first").asc(), F.col(item).asc()], k, "place")
    return placed.select(*group, item, "place", F.array_join("source_channels", ",").alias("source_channels"))


def recommended(ranked: DataFrame, group: list[str], item: str, n: int = 2, rank: str = "rank") -> DataFrame:
    """The items among the first ``n`` of any channel, with those channels."""
    best = ranked.where(F.col(rank) <= n).groupBy(*group, item).agg(F.array_sort(F.collect_set("channel")).alias("c"))
    return best.select(*group, item, F.array_join("c", ",").alias("channels"))


def to_parents(items: DataFrame, group: list[str], parent: str, item: str, kind: str, score: str, weight: Column, keep: int = 3) -> DataFrame:
    """(group, parent, n_items, support, best_item, kept items) of items grouped under their parents.

    An item counts its score times its weight; support is the best one plus .35
    of the second and .2 of the third. Ties go by kind, then item. The best
    ``keep`` are cut in each partition before the shuffle, so a parent's items never
    meet in one task.
    """
    weighed = items.withColumn("__w", F.round(F.col(score) * weight, RANK_DIGITS))
    first = top_k(weighed, [*group, parent], [F.col("__w").desc(), F.col(kind).asc(), F.col(item).asc()], keep, "__rank")
    counts = weighed.groupBy(*group, parent).agg(F.count(F.lit(1)).alias("n_items"))
    at = lambda i: F.coalesce(F.max(F.when(F.col("__rank") == i, F.col("__w"))), F.lit(0.0))
    best = first.groupBy(*group, parent).agg(
        (at(1) + 0.35 * at(2) + 0.2 * at(3)).alias("support"), F.max(F.when(F.col("__rank") == 1, F.col(item))).alias("best_item"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rank", item))), lambda s: s[item]), ",").alias("kept"),
    )
    return best.join(counts, [*group, parent])


def merge_ordered(rows: DataFrame, group: list[str], item: str, order: str, first: list[str], lists: list[str]) -> DataFrame:
    """Rows of equal items merged: the first non-null value of some columns, the union of others, in ``order``."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    unions = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce(F.col(c), F.array().cast("array<string>")).alias("v")))), lambda s: s["v"]))).alias(c) for c in lists]
    return rows.groupBy(*group, item).agg(F.min(order).alias(order), *firsts, *unions)
