"""Encoding texts with a public byte-level BPE, fragment by fragment.

Byte pairs that occur inside no vocabulary token can't be joined by any merge, so
a cut between two such bytes is certain. Together with a check that the cut
changes nothing for the pre-tokenizer, the fragments can be encoded
independently and their ids concatenated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Folder of the vocabulary files; every function takes another one.
DEFAULT_FOLDER = "/opt/tokenizers"
# Fixed value: the pre-tokenizer's pattern published with the byte_bpe vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes a fragment has at least: a text is cut at the first certain place behind so many, again and again.
FRAGMENT = 512


class Codec:
    """A tokenizer with its table of byte pairs that mark certain cuts."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.certain = np.ones((256, 256), dtype=bool)
        for token in ranks:
            codes = np.frombuffer(token, np.uint8)
            self.certain[codes[:-1], codes[1:]] = False

    def cuts(self, data: bytes, fragment: int) -> list[int]:
        """Offsets of certain cuts, at least ``fragment`` bytes apart."""
        codes = np.frombuffer(data, np.uint8)
        marks = np.flatnonzero(self.certain[codes[:-1], codes[1:]] & ((codes[1:] & 0xC0) != 0x80)) + 1
        chosen: list[int] = []
        i = int(np.searchsorted(marks, fragment))
        while i < len(marks):
            at = int(marks[i])
            if self._neutral(data, at):
                chosen.append(at)
                i = int(np.searchsorted(marks, at + fragment))
            else:
                i += 1
        return chosen

    @staticmethod
    def _neutral(data: bytes, at: int) -> bool:
        """Whether the pre-tokenizer treats both sides alike with and without the cut.

        Its pattern looks ahead only, and only behind blanks; no piece with another
        character runs into a blank. So a cut before a run of blanks is neutral, and
        so is one between two characters that are no blanks, unless the right one is an
        apostrophe, which may open a contraction.
        """
        left = data[max(0, at - 4) : at].decode("utf-8", "ignore")[-1:]
        if not left or left.isspace() or not left.isprintable():
            return False
        if data[at] in b" \t\r\n":
            return True
        right = data[at : at + 4].decode("utf-8", "ignore")[:1]
        return bool(right) and not right.isspace() and right != "'" and right.isprintable()

    def encode(self, text: str, fragment: int = FRAGMENT) -> list[int]:
        """The ids of ``text`` without special tokens, fragment by fragment."""
        data = text.encode("utf-8")
        ids: list[int] = []
        last = 0
        for cut in [*(self.cuts(data, fragment) if len(data) > fragment else ()), len(data)]:
            ids += self.encoding.encode_ordinary(data[last:cut].decode("utf-8"))
            last = cut
        return ids


@lru_cache(maxsize=4)
def codec(vocabulary: bytes) -> Codec:
    """One codec per worker process."""
    return Codec(vocabulary)


def read_vocabulary(name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> bytes:
    """The vocabulary file, under 1 MB; it travels with the task, so executors need no copy."""
    with open(f"{folder}/{name}.tiktoken", "rb") as file:
        return file.read()


def _arrow_schema_text(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)


def encode_corpus(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER, fragment: int = FRAGMENT, rows_at_once: int = 1024) -> DataFrame:
    """(key, ids) of every row: the token ids of its text, without special tokens.

    An empty or null text gives an empty list. Keys may be null or repeated. The
    work is one narrow pass; a long text costs in proportion to its length, as it
    is encoded in fragments. Columns not named are dropped.
    """
    vocabulary = read_vocabulary(name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(vocabulary).encode
        for whole in batches:
            for batch in _slices(whole, rows_at_once):
                lists = [encode(t, fragment) if t else [] for t in batch.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int32)
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.select(key, df[text].cast(T.StringType()).alias("__text")).mapInArrow(run, f"{_arrow_schema_text(df, [key])}, ids array<int>")


def count_tokens(df: DataFrame, keys: list[str], text: str, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER, fragment: int = FRAGMENT, rows_at_once: int = 1024) -> DataFrame:
    """(keys, n_tokens) of every row; 0 for an empty or null text."""
    vocabulary = read_vocabulary(name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(vocabulary).encode
        for whole in batches:
            for batch in _slices(whole, rows_at_once):
                sizes = [len(encode(t, fragment)) if t else 0 for t in batch.column(len(keys)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(sizes, pa.int64())], names=[*keys, "n_tokens"])

    return df.select(*keys, df[text].cast(T.StringType()).alias("__text")).mapInArrow(run, f"{_arrow_schema_text(df, keys)}, n_tokens bigint")
