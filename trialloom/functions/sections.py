"""Eligibility texts parted into inclusion and exclusion sections, with offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.text import normalize_block

# Headings of the sections.
HEADINGS = {
    "inclusion": ("Key Inclusion Criteria", "Main Inclusion Criteria", "Inclusion Criteria", "Criteria for Inclusion", "Patients must meet all of the following", "Inclusion"),
    "exclusion": ("Key Exclusion Criteria", "Main Exclusion Criteria", "Exclusion Criteria", "Criteria for Exclusion", "Patients will be excluded if", "Exclusion"),
}
SCHEMA = "section_no int, section_type string, heading_text string, raw_text string, start_offset int, end_offset int"


def _pattern() -> re.Pattern[str]:
    kinds = ["(?P<%s>%s)" % (kind, "|".join(h.replace(" ", r"\s+") for h in listed)) for kind, listed in HEADINGS.items()]
    return re.compile(r"(?:^|(?<=[\s.;]))(?:" + "|".join(kinds) + r")(?!\w)\s*:?", re.IGNORECASE)


def sections_of(text: str) -> list[tuple[str, str, str, int, int]]:
    """(type, heading, body, start, end) of each section; a section ends where the next heading starts."""
    found = list(_pattern().finditer(text))
    out = []
    for i, m in enumerate(found):
        end = found[i + 1].start() if i + 1 < len(found) else len(text)
        kind = m.lastgroup or "unknown"
        out.append((kind, " ".join(m.group(kind).split()), text[m.end() : end].strip(" -:\n"), m.start(), end))
    return out


def split_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no, type, heading, text, offsets) of every section in a normalized eligibility text.

    Offsets count in the text with lines joined and paragraphs parted by an empty
    line. Texts without a heading, null and empty ones have no rows.
    """
    names = [key, *[f.split()[0] for f in SCHEMA.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *s) for k, t in zip(batch[key], batch["__text"], strict=True) for i, s in enumerate(sections_of(t))]
            yield pd.DataFrame(rows, columns=names)

    narrow = df.select(key, normalize_block(F.col(text)).alias("__text")).where(F.col("__text") != "")
    return narrow.mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {SCHEMA}")


PARTS = "inclusion string, exclusion string, n_inclusion int, n_exclusion int"


def _parts(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        found = sections_of(text) if text else []
        bodies = {kind: [body for k, _, body, *_ in found if k == kind] for kind in HEADINGS}
        rows.append(("\n\n".join(bodies["inclusion"]), "\n\n".join(bodies["exclusion"]), len(bodies["inclusion"]), len(bodies["exclusion"])))
    return pd.DataFrame(rows, columns=["inclusion", "exclusion", "n_inclusion", "n_exclusion"])


def section_parts(text: Column) -> Column:
    """The sections of a normalized text joined by kind, with their numbers, as one struct: a pass over the column, no join."""
    return F.pandas_udf(_parts, PARTS)(text)


def section_status(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, inclusion_text, exclusion_text, unsplit_text, parse_status, warnings) of every row.

    The status is empty, unsplit, inclusion_only, exclusion_only or parsed. Keys may
    be null or repeated; each row is judged by itself.
    """
    flat = df.select(key, normalize_block(F.col(text)).alias("__text"))
    wide = flat.withColumn("__p", section_parts(F.col("__text")))
    ni, ne = F.col("__p.n_inclusion"), F.col("__p.n_exclusion")
    status = F.when(F.col("__text") == "", "empty").when((ni > 0) & (ne > 0), "parsed").when(ni > 0, "inclusion_only").when(ne > 0, "exclusion_only").otherwise("unsplit")
    warnings = F.array_compact(F.array(
        F.when(status == "empty", F.lit("eligibility_text_empty")), F.when(status == "unsplit", F.lit("eligibility_section_headings_not_found")),
        F.when(ni > 1, F.lit("multiple_inclusion_sections")), F.when(ne > 1, F.lit("multiple_exclusion_sections")),
        F.when(status == "inclusion_only", F.lit("exclusion_section_heading_not_found")), F.when(status == "exclusion_only", F.lit("inclusion_section_heading_not_found")),
    ))
    return wide.select(
        key, normalize_block(F.col("__p.inclusion")).alias("inclusion_text"), normalize_block(F.col("__p.exclusion")).alias("exclusion_text"),
        F.when(status == "unsplit", F.col("__text")).otherwise("").alias("unsplit_text"), status.alias("parse_status"), warnings.alias("warnings"),
    )
