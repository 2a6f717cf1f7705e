"""Relational operators: deduplication, filters with stated empty-set rules, histograms, upserts, metrics."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.operators.positions import group_positions
from trialloom.session import materialize


def latest_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in ``order`` (nulls first), with the number of others as ``n_duplicates``.

    Reduced by partial aggregation, so a key of any weight is no task of its own.
    Null keys form one group; rows equal in ``order`` go by their other columns, unless one
    of these is a map.
    """
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    rank = F.struct(F.lit(0).alias("o"), *[F.struct(c.isNotNull().alias("given"), c.alias("value")).alias(f"o{i}") for i, c in enumerate(order)])
    unordered = any("map<" in (t := df.schema[c].dataType.simpleString()) or "variant" in t for c in df.columns if c not in keys)
    # The row stands behind its rank in one value, so ties are decided and nothing is shuffled twice; maps have no order.
    last = F.max_by(row, rank) if unordered else F.max(F.struct(rank.alias("rank"), row.alias("row")))["row"]
    best = df.groupBy(*keys).agg(last.alias("__row"), (F.count(F.lit(1)) - 1).alias("n_duplicates"))
    return best.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns], "n_duplicates")


def latest_in_place(df: DataFrame, key: str, order: list[Column], most: int = 500_000) -> DataFrame:
    """The rows of ``latest_wins`` without their number, where few keys are repeated: all other rows stay where they are read.

    The repeated keys are counted first and, up to ``most`` of them, broadcast; with more, all
    rows are reduced by ``latest_wins``. Rows with a null key are all kept.
    """
    repeated = materialize(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key))
    if repeated.limit(most + 1).count() > most:
        return latest_wins(df, [key], order).drop("n_duplicates")
    alone = df.join(F.broadcast(repeated), key, "left_anti").select(*df.columns)
    return alone.unionByName(latest_wins(df.join(F.broadcast(repeated), key, "left_semi").select(*df.columns), [key], order).drop("n_duplicates"))


def candidate_filter(df: DataFrame, key: str, candidates: DataFrame | None, empty: str = "none") -> DataFrame:
    """The rows whose key is among the candidates. No candidate table keeps all rows.

    ``empty`` says what a table without rows means: ``none`` keeps no row,
    ``all`` keeps all of them.
    """
    if empty not in ("none", "all"):
        raise ValueError("empty is 'none' or 'all'")
    if candidates is None or (empty == "all" and candidates.isEmpty()):
        return df
    return df.join(candidates.select(key), key, "left_semi")


def payload_filter(filters: dict[str, Any], columns: dict[str, str]) -> Column:
    """A condition from must, should and must_not entries over keyword columns, a gender and an age.

    An entry ``{"field": f, "values": [...]}`` matches a row with any of the
    values, in a string or array column (``columns`` names its type). All of must,
    one of should (if there is any) and none of must_not have to hold; entries
    without field or values say nothing. A gender matches itself and All; an age
    must lie within the floor and the ceiling, so a null bound fails.
    """

    def entry(e: dict[str, Any]) -> Column | None:
        values = [str(v) for v in e.get("values") or []]
        name = e.get("field")
        if not name or not values:
            return None
        if columns[name] == "array":
            return F.coalesce(F.arrays_overlap(F.col(name), F.array(*[F.lit(v) for v in values])), F.lit(False))
        return F.coalesce(F.col(name).isin(values), F.lit(False))

    listed = {k: [c for e in filters.get(k) or [] if (c := entry(e)) is not None] for k in ("must", "should", "must_not")}
    condition = F.lit(True)
    for c in listed["must"]:
        condition &= c
    if listed["should"]:
        either = F.lit(False)
        for c in listed["should"]:
            either |= c
        condition &= either
    for c in listed["must_not"]:
        condition &= ~c
    if str(filters.get("gender") or "").lower() in ("male", "female"):
        condition &= F.coalesce(F.col("gender").isin("All", filters["gender"].title()), F.lit(False))
    if filters.get("age_years") is not None:
        age = float(filters["age_years"])
        condition &= F.coalesce((F.col("age_floor_years") <= age) & (F.col("age_ceiling_years") >= age), F.lit(False))
    return condition


def scoped(df: DataFrame, key: str, scopes: DataFrame, scope: str, wanted: list[str], fallback: bool = True) -> DataFrame:
    """The rows in any of the wanted scopes; unknown scopes, or a scope without rows, fall back to all rows.

    Adds ``fell_back``. Without ``fallback``, no wanted scope known means all
    rows, and a known scope without rows none.
    """
    inside = scopes.where(F.col(scope).isin(wanted)).select(key).distinct()
    marked = df.join(inside.withColumn("__in", F.lit(True)), key, "left")
    some = df.join(inside, key, "left_semi") if fallback else inside
    found = not some.isEmpty()
    kept = marked.where("__in") if found else marked
    return kept.drop("__in").withColumn("fell_back", F.lit(not found))


def per_group_fallback(scoped_rows: DataFrame, all_rows: DataFrame, group: list[str]) -> DataFrame:
    """Scoped rows of each group, and all rows of the groups that have none in scope; adds ``fell_back``."""
    without = all_rows.join(scoped_rows.select(*group).distinct(), group, "left_anti")
    return scoped_rows.withColumn("fell_back", F.lit(False)).unionByName(without.withColumn("fell_back", F.lit(True)))


def histogram(df: DataFrame, columns: list[str], out: str = "n") -> DataFrame:
    """Number of rows of each combination of values; nulls count as a value."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(out))


def nested_histogram(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """For each value of ``outer`` a map from the values of ``inner`` to their numbers, as sorted text."""
    pairs = histogram(df, [outer, inner]).select(outer, F.concat_ws("=", F.coalesce(inner, F.lit("")), F.col("n").cast("string")).alias("p"))
    return pairs.groupBy(outer).agg(F.array_join(F.array_sort(F.collect_list("p")), ",").alias("counts"))


def length_stats(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """count, min, max, mean and median (exact, 2 digits) of a column; zeros for an empty table."""
    z = lambda c: F.coalesce(c, F.lit(0))
    return df.groupBy(*(group or [])).agg(
        F.count(value).alias("n"), z(F.min(value)).alias("min"), z(F.max(value)).alias("max"),
        F.round(F.coalesce(F.avg(value), F.lit(0.0)), 2).alias("mean"), F.round(F.coalesce(F.median(value), F.lit(0.0)), 2).alias("median"),
    )


def numbered(df: DataFrame, group: list[str], order: list[Column], out: str = "sequence") -> DataFrame:
    """Rows of each group numbered from 0 in a total order, by exact positions in a global sort."""
    return group_positions(df, group, order, out).withColumn(out, F.col(out) - 1)


def position_slice(df: DataFrame, position: str, start: int = 0, stop: int | None = None, limit: int | None = None) -> DataFrame:
    """The rows at positions [start, stop), then at most ``limit`` from the start; positions are a column, never file order."""
    if limit is not None and limit > 0:
        stop = min(start + limit, stop) if stop is not None else start + limit
    rows = df.where(F.col(position) >= max(start, 0))
    return rows if stop is None else rows.where(F.col(position) < stop)


def _one_per_key(df: DataFrame, key: str, order: list[Column] | None) -> DataFrame:
    """The last row per key in ``order``, equal ones by their other columns, so that a repeated run keeps the same row."""
    return latest_wins(df, [key], order or []).drop("n_duplicates")


def missing_rows(incoming: DataFrame, stored: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """Incoming rows whose key isn't stored yet, the last one per key in ``order``: what a resumed upsert has to write."""
    return _one_per_key(incoming, key, order).join(stored.select(key), key, "left_anti")


def upsert(incoming: DataFrame, stored: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """The stored rows with incoming ones in place of those with the same key; applying it twice is applying it once.

    Of incoming rows with one key the last in ``order`` counts.
    """
    kept = stored.join(incoming.select(key).distinct(), key, "left_anti")
    return kept.unionByName(_one_per_key(incoming, key, order).select(*stored.columns))


def recall_at(ranked: DataFrame, relevant: DataFrame, group: str, item: str, ks: list[int], rank: str = "rank") -> DataFrame:
    """(group, n_relevant, hits and recall at each k); recall is null for a group without relevant items."""
    joined = relevant.select(group, item).distinct().join(ranked.select(group, item, rank), [group, item], "left")
    hits = [F.sum(F.when(F.col(rank) <= k, 1).otherwise(0)).alias(f"hits_{k}") for k in ks]
    per = joined.groupBy(group).agg(F.countDistinct(item).alias("n_relevant"), *hits)
    every = ranked.select(group).distinct().join(per, group, "full")
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ["n_relevant", *[f"hits_{k}" for k in ks]]]
    return every.select(group, *filled).select("*", *[F.round(F.try_divide(F.col(f"hits_{k}"), F.nullif(F.col("n_relevant"), F.lit(0))), 6).alias(f"recall_{k}") for k in ks])


def accuracy(predictions: DataFrame, gold: DataFrame, key: str, predicted: str, expected: str) -> DataFrame:
    """(n, n_correct, accuracy) over all gold rows; a missing prediction is wrong."""
    joined = gold.join(predictions.select(key, predicted), key, "left").where(F.col(expected).isNotNull())
    right = F.coalesce(F.col(predicted) == F.col(expected), F.lit(False)).cast("int")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(right), F.lit(0)).alias("n_correct"), F.round(F.try_divide(F.sum(right), F.count(F.lit(1))), 6).alias("accuracy"))
