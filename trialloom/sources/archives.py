"""Zip archives and XML files as tables of source documents."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.session import materialize

#: Compressed bytes of the members that a task reads at once, about.
RANGE_BYTES = 64 << 20
SOURCE_FIELDS = ["xml_bytes", "source_corpus", "source_archive", "source_member_path", "input_path"]
# Directories that name a corpus.
CORPUS_DIRS = {"corpus_2023": "totrials_2023", "corpus_2021_2022": "totrials_2021_2022"}


def corpus_of(path: Column) -> Column:
    """The corpus a path's directories name, else its parent directory with odd characters as '_'."""
    parts = F.transform(F.split(path, "/"), F.lower)
    parent = F.regexp_replace(F.coalesce(F.nullif(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit("")), F.lit("default")), r"[^A-Za-z0-9._-]+", "_")
    named = [F.when(F.array_contains(parts, d), F.lit(c)) for d, c in CORPUS_DIRS.items()]
    return F.coalesce(*named, parent)


def explode_zip(df: DataFrame, keys: list[str], content: str, suffix: str = ".xml") -> DataFrame:
    """(keys, member_path, member_bytes, error) of every member with a suffix, whatever its case, in order of name.

    Bytes that are no zip give one row with an error; null bytes give none. One
    archive is read by one task and its members leave it one by one.
    """
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", member_path string, member_bytes binary, error string"
    names = [*keys, "member_path", "member_bytes", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                key, data = row[:-1], row[-1]
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as archive:
                        for name in sorted(archive.namelist()):
                            if name.lower().endswith(suffix):
                                yield pd.DataFrame([(*key, name, archive.read(name), None)], columns=names)
                except (zipfile.BadZipFile, OSError, RuntimeError) as bad:
                    yield pd.DataFrame([(*key, None, None, f"{type(bad).__name__}: {bad}")], columns=names)

    return df.where(F.col(content).isNotNull()).select(*keys, content).mapInPandas(run, schema)


def _open(path: str):
    """(file system, path within it) of a local path or a URI such as Spark lists."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The XML members of each archive in ranges of about ``RANGE_BYTES``, from its directory alone."""
    for batch in batches:
        for path in batch["path"]:
            ranges: list[tuple[str, list[str], str | None]] = []
            try:
                system, inner = _open(path)
                with system.open_input_file(inner) as file, zipfile.ZipFile(file) as archive:
                    held, size = [], 0
                    for info in sorted(archive.infolist(), key=lambda i: i.filename):
                        if info.filename.lower().endswith(".xml"):
                            held.append(info.filename)
                            size += info.compress_size
                            if size >= RANGE_BYTES:
                                ranges.append((path, held, None))
                                held, size = [], 0
                    if held:
                        ranges.append((path, held, None))
            except (zipfile.BadZipFile, OSError, ValueError) as bad:
                ranges.append((path, [], f"{type(bad).__name__}: {bad}"))
            yield pd.DataFrame(ranges, columns=["path", "names", "error"])


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "member_path", "member_bytes", "error"]
    for batch in batches:
        for path, names, error in batch.itertuples(index=False, name=None):
            if error:
                yield pd.DataFrame([(path, None, None, error)], columns=columns)
                continue
            system, inner = _open(path)
            with system.open_input_file(inner) as file, zipfile.ZipFile(file) as archive:
                for name in names:
                    try:
                        row = (path, name, archive.read(name), None)
                    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, ValueError, zlib.error) as bad:
                        row = (path, name, None, f"{type(bad).__name__}: {bad}")
                    yield pd.DataFrame([row], columns=columns)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member_path, member_bytes, error) of the XML members of every zip below a path, of any size.

    No archive is held as a whole: a first pass reads the directories and parts
    them into ranges of members, which are spread over the cores and read by
    offset. An archive or member that can't be read is a row with an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path)
    ranges = materialize(files.select("path").mapInPandas(_listed, "path string, names array<string>, error string"))
    spread_out = ranges.repartition(max(spark.sparkContext.defaultParallelism, min(ranges.count(), 100_000)), F.xxhash64("path", F.get("names", F.lit(0))))
    return spread_out.mapInPandas(_read, "path string, member_path string, member_bytes binary, error string")


def write_zips(df: DataFrame, folder: str, name: str, content: str) -> int:
    """The rows as members of zips in a folder, one zip per partition, written as they come; the number of zips."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        written = 0
        target = f"{folder.rstrip('/')}/part-{uuid.uuid4().hex}.zip"
        system, inner = _open(target)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        with system.open_output_stream(inner) as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
            for batch in batches:
                for member, data in zip(batch[name], batch[content], strict=True):
                    archive.writestr(member, bytes(data))
                    written += 1
        if not written:
            system.delete_file(inner)
        yield pd.DataFrame({"n": [int(written > 0)]})

    rows = df.where(F.col(name).isNotNull() & F.col(content).isNotNull()).select(name, content)
    return int(rows.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0)


def scan_zips(spark: SparkSession, path: str) -> DataFrame:
    """The XML members of every zip below a path, as source documents; what can't be read is left out."""
    members = zip_members(spark, path).where(F.col("error").isNull())
    return members.select(
        F.col("member_bytes").alias("xml_bytes"), corpus_of(F.col("path")).alias("source_corpus"), F.element_at(F.split("path", "/"), -1).alias("source_archive"),
        F.col("member_path").alias("source_member_path"), F.col("path").alias("input_path"),
    )


def scan_xml_files(spark: SparkSession, path: str) -> DataFrame:
    """Every XML file below a path as a source document, with its path relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(path)
    root = path.rstrip("/").removeprefix("file:")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.replace(".", r"\.") + "/?", "")
    return files.select(F.col("content").alias("xml_bytes"), corpus_of(F.col("path")).alias("source_corpus"), F.lit("").alias("source_archive"), relative.alias("source_member_path"), F.col("path").alias("input_path"))


def scan_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The documents of directories, zips and XML files; paths that don't exist are skipped."""
    parts = []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        place = hadoop(path)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            if not path.lower().endswith(".xml"):
                parts.append(scan_zips(spark, path))
            if not path.lower().endswith(".zip"):
                parts.append(scan_xml_files(spark, path))
    if not parts:
        return spark.createDataFrame([], "xml_bytes binary, source_corpus string, source_archive string, source_member_path string, input_path string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def inspect_archives(df: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, readable, n_entries, n_xml, error) of archives given as bytes."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", readable boolean, n_entries int, n_xml int, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False, name=None):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(row[-1] or b""))) as archive:
                        names = archive.namelist()
                    rows.append((*row[:-1], True, len(names), sum(n.endswith(".xml") for n in names), None))
                except zipfile.BadZipFile as bad:
                    rows.append((*row[:-1], False, None, None, f"BadZipFile: {bad}"))
            yield pd.DataFrame(rows, columns=[*keys, "readable", "n_entries", "n_xml", "error"])

    return df.select(*keys, content).mapInPandas(run, schema)
