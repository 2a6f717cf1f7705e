"""The N best items of every group, by exact positions in one global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.operators.positions import group_positions

POSITION = "position"


def top_n_per_group(df: DataFrame, groups: list[str], score: str, ids: list[str], n: int) -> DataFrame:
    """The ``n`` items of each group with the highest score; ties go to the smaller id.

    An item (``ids``) counts once per group with its best score, reduced before
    the rows are shuffled. The items are sorted globally by group, score and id;
    prefix sums of each group's counts per partition give exact positions, so no
    task holds a group.

    Rows whose score is null or NaN don't count; -0.0 equals 0.0. A null group is
    a group of its own, a null id sorts first. Repeated rows count once. Other
    columns are ignored. An empty table gives an empty result.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    value = F.col(score).cast("double")
    best = (
        df.where(value.isNotNull() & ~F.isnan(value))
        .groupBy(*groups, *ids)
        .agg(F.max(value + F.lit(0.0)).alias(score))
    )
    order = [F.col(score).desc(), *(F.col(i).asc_nulls_first() for i in ids)]
    return group_positions(best, groups, order, POSITION, n)
