"""Deeply nested records as flat tables that keep parent and child links.

Records are shredded into columns: for every leaf path the values with their
repetition and definition levels. The table of a repeated ancestor is rebuilt
from the level sequences alone, by prefix sums over the positions at which its
own level or one above repeats.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are parsed before their results leave the worker.
ROWS_AT_ONCE = 256


@dataclass(frozen=True)
class Repeated:
    """A kind of repeated element: its path from the record's root, and the kind that holds it."""

    kind: str
    path: tuple[str, ...]
    parent: str | None = None


@dataclass(frozen=True)
class Shape:
    """The repeated paths of a record type, each with its depth among the repeated ones."""

    root: str
    kinds: tuple[Repeated, ...]

    def depth(self, path: tuple[str, ...]) -> int:
        """Number of repeated elements on a path: the highest repetition level."""
        listed = {k.path for k in self.kinds}
        return sum(path[: i + 1] in listed for i in range(len(path)))


@dataclass
class LeafColumn:
    """One leaf path: values, repetition levels, definition levels, in document order."""

    path: tuple[str, ...]
    values: list[str | None]
    repetition: list[int]
    definition: list[int]


DECLARATION = re.compile(rb"""<\?xml\s[^>]*?encoding\s*=\s*["']([A-Za-z][A-Za-z0-9._-]*)["'][^>]*\?>""")


def parse_xml(data: bytes | None) -> ET.Element | None:
    """The root of well-formed XML in any encoding it declares; None for anything else."""
    if not data:
        return None
    try:
        return ET.fromstring(data)
    except (ET.ParseError, LookupError):
        return None
    except ValueError:  # expat reads no multi-byte encodings but UTF-8 and UTF-16
        return _parse_decoded(data)


def _parse_decoded(data: bytes) -> ET.Element | None:
    """The root of XML decoded here by the encoding it declares."""
    declared = DECLARATION.match(data)
    if not declared:
        return None
    try:
        return ET.fromstring(data[declared.end() :].decode(declared[1].decode("ascii")))
    except (ET.ParseError, ValueError, LookupError):
        return None


def local_name(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def holds_something(element: ET.Element) -> bool:
    """Whether an element has attributes, child elements or text other than blanks."""
    return bool(element.attrib) or any(isinstance(c.tag, str) for c in element) or bool("".join(element.itertext()).strip())


def shred(record: ET.Element, shape: Shape) -> dict[tuple[str, ...], LeafColumn]:
    """The columns of a record: one for each leaf path below a repeated element.

    A repetition level says which repeated element of the path begins anew (0:
    the record), a definition level how many of the path's repeated elements are
    there. Every repeated element has a column of its own (its text), so that it
    leaves a trace even if nothing in it is filled; repeated elements that hold
    nothing leave none.
    """
    listed = {k.path: k for k in shape.kinds}
    inner = {k.path[: i + 1] for k in shape.kinds for i in range(len(k.path))}
    columns = {k.path: LeafColumn(k.path, [], [], []) for k in shape.kinds}

    def put(path: tuple[str, ...], value: str | None, repetition: int, definition: int) -> None:
        column = columns.setdefault(path, LeafColumn(path, [], [], []))
        column.values.append(value)
        column.repetition.append(repetition)
        column.definition.append(definition)

    def visit(element: ET.Element, path: tuple[str, ...], repetition: int, definition: int) -> None:
        """One instance of the element at ``path``, which begins anew at ``repetition``."""
        if path in listed:
            put(path, "".join(element.itertext()).strip() or None, repetition, definition)
        for name, value in element.attrib.items():
            if definition:
                put((*path, "@" + local_name(name)), value, repetition, definition)
        children: dict[str, list[ET.Element]] = {}
        for child in element:
            if isinstance(child.tag, str):
                children.setdefault(local_name(child.tag), []).append(child)
        missing = {p for p in inner if len(p) == len(path) + 1 and p[:-1] == path and p[-1] not in children}
        for name, found in children.items():
            below = (*path, name)
            if below in listed:
                kept = [c for c in found if holds_something(c)]
                level = shape.depth(below)
                for i, child in enumerate(kept):
                    visit(child, below, repetition if i == 0 else level, level)
                if not kept:
                    missing.add(below)
            elif below in inner:
                for i, child in enumerate(found):
                    # A plain element that occurs again goes on where the first ended.
                    visit(child, below, repetition if i == 0 else shape.depth(below) + 1, definition)
            elif definition:
                for child in found:
                    put(below, "".join(child.itertext()).strip() or None, repetition, definition)
        for gone in missing:
            for kind_path in listed:
                if kind_path[: len(gone)] == gone:
                    put(kind_path, None, repetition, definition)

    visit(record, (), 0, 0)
    return columns


def assemble(columns: dict[tuple[str, ...], LeafColumn], shape: Shape) -> Iterator[tuple[str, int, int, str | None]]:
    """(kind, parent_no, child_no, own text) of every repeated element, from the level sequences.

    An element's number counts the entries of its column defined down to it; its
    parent's number counts, in the same column, the entries at which the parent
    or something above it repeats while the parent is there.
    """
    by_kind = {k.kind: k for k in shape.kinds}
    for kind in shape.kinds:
        column = columns[kind.path]
        level = shape.depth(kind.path)
        repetition = np.array(column.repetition, dtype=np.int64)
        definition = np.array(column.definition, dtype=np.int64)
        own = definition >= level
        numbers = np.cumsum(own)
        parents = np.zeros(len(own), dtype=np.int64)
        if kind.parent:
            above = shape.depth(by_kind[kind.parent].path)
            parents = np.cumsum((repetition <= above) & (definition >= above))
        for i in np.flatnonzero(own):
            yield kind.kind, int(parents[i]), int(numbers[i]), column.values[i]


def flatten(record: ET.Element | None, shape: Shape) -> list[tuple[str, int, int, str | None]]:
    """All rows of a record's tables; none if it is missing or of another type."""
    if record is None or local_name(record.tag) != shape.root:
        return []
    return list(assemble(shred(record, shape), shape))


def find_text(record: ET.Element, path: tuple[str, ...]) -> str | None:
    """The text at a path without repetition, None if it is missing or blank."""
    node: ET.Element | None = record
    for name in path:
        node = next((c for c in node if local_name(c.tag) == name), None)
        if node is None:
            return None
    return "".join(node.itertext()).strip() or None


def flat_tables(df: DataFrame, key: str, xml: str, shape: Shape, id_path: tuple[str, ...]) -> DataFrame:
    """(key, record_id, child_kind, parent_no, child_no, child_text) of every repeated element of every record.

    ``parent_no`` is the ``child_no`` of the element that holds it, 0 for the
    record itself; ``record_id`` is the text at ``id_path``. Null, empty and not
    well-formed bytes, and records with another root, have no rows. Elements
    without attributes, children and text (other than blanks) aren't counted.
    Namespaces are ignored. Keys may be null or repeated. One narrow pass: a
    record's tables come from the task that reads it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "record_id", "child_kind", "parent_no", "child_no", "child_text"]
        for batch in batches:
            for start in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[start : start + ROWS_AT_ONCE]
                rows = []
                for k, data in zip(part[key], part["__xml"], strict=True):
                    record = parse_xml(bytes(data) if data is not None else None)
                    if record is not None:
                        identity = find_text(record, id_path)
                        rows += [(k, identity, *row) for row in flatten(record, shape)]
                yield pd.DataFrame(rows, columns=names)

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, record_id string, child_kind string, parent_no int, child_no int, child_text string"
    return df.select(key, F.col(xml).alias("__xml")).where(F.length("__xml") > 0).mapInPandas(run, schema)


def pivot_kind(rows: DataFrame, kind: str) -> DataFrame:
    """The flat table of one kind of element."""
    return rows.where(F.col("child_kind") == kind).drop("child_kind")


def normal_id(raw: Column) -> Column:
    """A trial number as NCT and 8 digits, null if there aren't 8."""
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    return F.when(F.length(digits) == 8, F.concat(F.lit("NCT"), digits))


def path_id(path: Column) -> Column:
    """The trial number in a file's name, null if it has none."""
    return normal_id(F.regexp_extract(path, r"(?i)NCT[^0-9/]*([0-9]{8})[^/]*$", 1))
