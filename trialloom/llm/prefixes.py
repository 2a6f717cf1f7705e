"""Texts that are only the beginning of another text of their group."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialloom.operators.positions import PART, range_sorted
from trialloom.session import materialize


def _with_next(keys: list[str], text: str, id_column: str):
    """Compares each row of a sorted partition with the next; the last row has no verdict yet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        for batch in batches:
            out = []
            for row in batch[[*keys, text, id_column]].itertuples(index=False, name=None):
                if held is not None:
                    out.append((*held[: len(keys)], held[-1], row[: len(keys)] == held[: len(keys)] and row[-2].startswith(held[-2])))
                held = row
            yield pd.DataFrame(out, columns=[*keys, id_column, "is_prefix"])

    return run


def _edges(columns: list[str]):
    """The first and the last row of each partition, the last one marked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        for batch in batches:
            if len(batch):
                first = batch.iloc[:1] if first is None else first
                last = batch.iloc[-1:]
        if first is not None:
            yield pd.concat([first.assign(__last=False), last.assign(__last=True)])[[*columns, "__last"]]

    return run


def mark_prefixes(df: DataFrame, keys: list[str], text: str, id_column: str) -> DataFrame:
    """(keys, id, is_prefix) of each row of a table that is distinct by ``keys`` and ``text``, without nulls there.

    In sorted order all texts between a text and one it begins start with it too,
    so looking at the next row is enough: no pairs, and no group in one task.
    """
    fixed = range_sorted(df.select(*keys, text, id_column), [F.col(c).asc() for c in (*keys, text)])
    named = ", ".join(f"`{c}` {fixed.schema[c].dataType.simpleString()}" for c in (*keys, id_column))
    inner = fixed.mapInPandas(_with_next(keys, text, id_column), named + ", is_prefix boolean")

    # One row a partition: its last text against the first text of the next partition that has rows.
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fixed.schema.fields)
    edges = materialize(fixed.mapInPandas(_edges(fixed.columns), schema + ", __last boolean"))
    first, final = edges.where("NOT __last"), edges.where("__last")
    # The window holds the partitions' numbers only; the texts are joined to them.
    following = first.select(F.col(PART).alias("__at"), F.lag(PART).over(Window.orderBy(PART)).alias("__before"))
    ahead = first.join(following, F.col(PART) == F.col("__at")).select(F.col("__before").alias(PART), F.col(text).alias("__next"), F.struct(*keys).alias("__keys"))
    edge = final.join(ahead, PART, "left").select(
        *keys, id_column, F.coalesce((F.struct(*keys) == F.col("__keys")) & F.col("__next").startswith(F.col(text)), F.lit(False)).alias("is_prefix")
    )
    return inner.unionByName(edge)
