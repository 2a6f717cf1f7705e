"""Cutting oversized texts at natural boundaries, with a fixed overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of boundaries, best first, and the least share of the limit a piece ending there must fill.
LEVELS = (("paragraph", 0.5), ("line", 0.5), ("sentence", 0.4), ("clause", 0.5), ("word", 0.0))
PIECE_FIELDS = "piece_no int, n_pieces int, piece_text string, start_offset int, end_offset int, cut_at string"

_BLANK = re.compile(r"[ \t\r\n]+")
_SENTENCE_END = re.compile(r"[.!?…][\"'”’)\]]*$")
_CLAUSE_END = re.compile(r"[;:,)]$")
_WIDE_SENTENCE_END = re.compile(r"[。！？]")
_WIDE_CLAUSE_END = re.compile(r"[，、；：]")


def normalized(text: Column) -> Column:
    """Blanks at the ends dropped and every run of spaces, tabs and line breaks as one space."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def boundaries(text: str) -> tuple[str, dict[str, np.ndarray]]:
    """The normalized text and, for each kind of boundary, the sorted offsets at which a piece may end.

    Tokens are the runs without blanks; their offsets in the normalized text are
    prefix sums of their lengths. A piece ends behind a token, before the blank.
    """
    ends: dict[str, list[int]] = {name: [] for name, _ in LEVELS}
    tokens: list[str] = []
    at = 0
    source = text.strip(" \t\r\n")
    place = 0
    for gap in [*_BLANK.finditer(source), None]:
        token = source[place : gap.start() if gap else len(source)]
        tokens.append(token)
        wide = at
        at += len(token)
        for pattern, level in ((_WIDE_SENTENCE_END, "sentence"), (_WIDE_CLAUSE_END, "clause")):
            ends[level] += [wide + m.end() for m in pattern.finditer(token)]
        if gap:
            breaks = gap.group().replace("\r\n", "\n").replace("\r", "\n").count("\n")
            ends["word"].append(at)
            if breaks > 1:
                ends["paragraph"].append(at)
            elif breaks:
                ends["line"].append(at)
            if _SENTENCE_END.search(token):
                ends["sentence"].append(at)
            elif _CLAUSE_END.search(token):
                ends["clause"].append(at)
            at += 1
            place = gap.end()
    return " ".join(tokens), {k: np.unique(np.array(v, dtype=np.int64)) for k, v in ends.items()}


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of cut) of each piece in the normalized text.

    The last boundary within the limit is found by binary search, the best kind
    first; without any, the piece is cut hard at the limit. The next piece starts
    ``overlap`` characters before the cut.
    """
    flat, ends = boundaries(text)
    overlap = max(0, min(overlap, limit - 1))
    pieces = []
    start = 0
    while len(flat) - start > limit:
        for level, least in LEVELS:
            array = ends[level]
            i = int(np.searchsorted(array, start + limit, side="right")) - 1
            if i >= 0 and array[i] > start + max(overlap, limit * least):
                pieces.append((start, int(array[i]), level))
                break
        else:
            pieces.append((start, start + limit, "hard"))
        start = pieces[-1][1] - overlap
    return [*pieces, (start, len(flat), "end")]


def _cut(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for values in batch.itertuples(index=False, name=None):
                key, (text, limit, overlap) = values[: len(keys)], values[len(keys) :]
                flat = _BLANK.sub(" ", text.strip(" \t\r\n"))
                pieces = split_text(text, int(limit), int(overlap))
                rows += [(*key, i, len(pieces), flat[a:b], a, b, kind) for i, (a, b, kind) in enumerate(pieces, 1)]
            yield pd.DataFrame(rows, columns=[*keys, "piece_no", "n_pieces", "piece_text", "start_offset", "end_offset", "cut_at"])

    return run


def split_oversized(items: DataFrame, keys: list[str], text: str, limit: str, overlap: str) -> DataFrame:
    """Every item as consecutive pieces of at most ``limit`` normalized characters.

    Items within the limit stay whole, as piece 1 of 1, and never leave the JVM.
    Offsets count in the normalized text; joining the pieces without their
    overlap gives it back. An overlap of the limit or more counts as one less than
    the limit, so that every piece goes on; a null or negative overlap counts as 0. A null or empty text is one piece; a null limit or one
    below 1 cuts nothing. Keys may be null or repeated: each row is cut by itself.
    Columns not named are dropped.
    """
    narrow = items.select(*keys, F.col(text).alias("__text"), F.col(limit).cast("int").alias("__limit"), F.coalesce(F.col(overlap).cast("int"), F.lit(0)).alias("__overlap"))
    flat = normalized(F.col("__text"))
    oversized = F.coalesce((F.col("__limit") > 0) & (F.length(flat) > F.col("__limit")), F.lit(False))
    whole = narrow.where(~oversized).select(
        *keys, F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), flat.alias("piece_text"),
        F.lit(0).alias("start_offset"), F.coalesce(F.length(flat), F.lit(0)).alias("end_offset"), F.lit("end").alias("cut_at"),
    )
    schema = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys) + ", " + PIECE_FIELDS
    return narrow.where(oversized).mapInPandas(_cut(keys), schema).unionByName(whole)
