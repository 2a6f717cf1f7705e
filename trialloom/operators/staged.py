"""Retrieval in two stages for very many queries: documents are indexed once, queries are spread, and only each query's best parents leave its task.

Documents are sorted by key and indexed in blocks by the terms that are asked for and occur; the blocks stand
in the shared folder. Each task takes a range of sorted bags of terms, reads block after block, and adds
postings up along the beginnings that its bags share. Lists of documents never leave the task.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.operators.ranking import K1, B
from trialloom.operators.rerank import COARSE_RRF, COARSE_TYPE, COVERED, FINE_ARMS, FINE_ENTRY, FINE_TYPE, SUPPORT
from trialloom.operators.search import SLACK, Terms, _counted, _spans, tokens
from trialloom.session import materialize, shared_folder

#: Documents of a block, about, and of the first one, which only gives bounds for the others; postings after which a block ends sooner.
BLOCK, FIRST, BLOCK_POSTINGS = 30_000, 4_000, 4_000_000
#: Bags a task takes about, and bags whose lists are fused at once.
SLICE, FUSED = 10_000, 2_000
#: Pairs of bag and document that are scored at once.
PAIRS = 500_000
#: A term with postings in more than a 16th of a block is added as a whole vector.
DENSE = 16

_ENTRY, _EXIT, _OVERVIEW, _ARMS = (1 << COVERED.index(t) for t in ("eligibility_inclusion", "eligibility_exclusion", "overview", "arms_interventions"))


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a shared folder."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), folder) if "://" not in folder else fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, arrays: dict[str, np.ndarray | pa.Array]) -> None:
    """Writes arrays as one file, which appears when it is whole."""
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    out = io.BytesIO()
    for value in arrays.values():
        if isinstance(value, np.ndarray):
            np.save(out, value)
        else:
            batch = pa.RecordBatch.from_arrays([value], ["v"])
            with pa.ipc.new_stream(raw := io.BytesIO(), batch.schema) as writer:
                writer.write_batch(batch)
            np.save(out, np.frombuffer(raw.getvalue(), np.uint8))
    part = f"{path}/{uuid.uuid4().hex}"
    with system.open_output_stream(part) as file:
        file.write(out.getbuffer())
    system.move(part, f"{path}/{name}")


def _get(folder: str, name: str) -> list[np.ndarray]:
    system, path = _open(folder)
    with system.open_input_stream(f"{path}/{name}") as file:
        data = io.BytesIO(file.read())
    out = []
    while data.tell() < len(data.getbuffer()):
        out.append(np.load(data))
    return out


def _there(folder: str, name: str) -> bool:
    system, path = _open(folder)
    return system.get_file_info(f"{path}/{name}").type == fs.FileType.File


def _drop(folder: str, name: str) -> None:
    system, path = _open(folder)
    system.delete_file(f"{path}/{name}")


def _texts(stored: np.ndarray) -> pa.Array:
    """A column of texts from ``_put``."""
    return pa.ipc.open_stream(stored.tobytes()).read_all().column(0).combine_chunks()


def _round(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded half away from zero, as SQL does."""
    m = 10.0**digits
    return np.copysign(np.floor(np.abs(x) * m + 0.5), x) / m


def _down(x: np.ndarray) -> np.ndarray:
    """A key that sorts falling, NaN first."""
    return np.where(np.isnan(x), -np.inf, -x)


def _count_blocks(sizes: tuple[int, int, int], shared, folder: str, n_fields: int):
    """Writes blocks of a partition's documents, which are sorted: how often the asked terms stand in each field.

    (field, term, n, length): documents with each term, for term -1 all documents and their tokens, for field -1 the partition's blocks.
    """
    small, large, most_postings = sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, partition, block = shared.value, TaskContext.get().partitionId(), 0
        terms, size = Terms(listed), max(len(listed), 1)
        df, n, length = np.zeros((n_fields, size), np.int64), 0, np.zeros(n_fields, np.int64)
        kept: list[tuple[list, pa.RecordBatch]] = []
        rows = postings = 0

        def flush() -> None:
            nonlocal kept, rows, postings, block
            parts, lengths, start = [], np.zeros((n_fields, rows), np.int32), 0
            for fields, batch in kept:
                for i, (r, t, tf, own) in enumerate(fields):
                    parts.append((i, t.astype(np.int64) * rows + r + start, tf))
                    lengths[i, start : start + batch.num_rows] = own
                start += batch.num_rows
            both, place = np.unique(np.concatenate([x for _, x, _ in parts]), return_inverse=True)
            most, at = max((int(x.max()) for _, _, x in parts if x.size), default=0), 0
            tf = np.zeros((n_fields, len(both)), np.uint8 if most < 1 << 8 else np.int32)
            for i, x, own in parts:
                tf[i, place[at : at + len(x)]] = own
                at += len(x)
            term, doc = np.divmod(both, rows)
            _put(folder, f"{partition}-{block}-counts", {"start": np.searchsorted(term, np.arange(size + 1)), "doc": doc.astype(np.int32), "tf": tf, "lengths": lengths})
            own = pa.Table.from_batches([b for _, b in kept])
            column = lambda i: own.column(n_fields + i).combine_chunks()
            _put(folder, f"{partition}-{block}-rows", {"parent": column(0), "kind": column(1), "title": column(2), "weight": column(3).to_numpy(zero_copy_only=False)})
            kept, rows, postings, block = [], 0, 0, block + 1

        for whole in batches:
            at = 0
            while at < whole.num_rows:
                most = small if partition == 0 and block == 0 else large
                batch = whole.slice(at, min(most - rows, 10_000))
                at += batch.num_rows
                fields = _counted(terms, batch.columns[:n_fields], size)
                for i, (_, t, _, own) in enumerate(fields):
                    df[i] += np.bincount(t, minlength=size)
                    length[i] += own.sum()
                kept.append((fields, batch))
                n += batch.num_rows
                rows += batch.num_rows
                postings += sum(len(f[0]) for f in fields)
                if rows >= most or postings >= most_postings:
                    flush()
        if rows:
            flush()
        field, term = np.nonzero(df)
        zeros = np.zeros(len(field), np.int64)
        columns = [np.r_[field, np.arange(n_fields), -1], np.r_[term, np.full(n_fields, -1), partition], np.r_[df[field, term], np.full(n_fields, n), block], np.r_[zeros, length, 0]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["field", "term", "n", "length"])

    return run


def _value_blocks(shared, folder: str):
    """Turns the counts of blocks into postings, by term: documents ascending, and what the term adds to the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if _there(folder, name):  # a task that runs again finds the blocks it was done with
                    continue
                start, doc, tf, lengths = _get(folder, f"{name}-counts")
                term, value = np.repeat(np.arange(len(start) - 1), np.diff(start)), np.zeros(len(doc))
                for i, weight in enumerate(s["weight"]):
                    at = np.flatnonzero(tf[i])
                    ratio = lengths[i][doc[at]] / s["average"][i] if s["average"][i] > 0 else 1.0
                    value[at] += weight * s["idf"][i][term[at]] * tf[i][at] * (K1 + 1) / (tf[i][at] + K1 * (1 - B + B * ratio))
                _put(folder, name, {"n": np.array([lengths.shape[1]]), "start": start, "doc": doc, "value": value})
                _drop(folder, f"{name}-counts")
            yield batch

    return run


def _codes(parts: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """Numbers of texts in their order, and the texts."""
    whole = pa.chunked_array([p.cast(pa.large_string()) for p in parts]).combine_chunks()
    whole = (whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole).dictionary_encode()
    order = pc.sort_indices(whole.dictionary).to_numpy(zero_copy_only=False)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return place[whole.indices.to_numpy(zero_copy_only=False)], whole.dictionary.take(pa.array(order))


def _gather(folder: str, blocks: list[str]):
    """Writes what the tasks need of all documents: numbers of parents, kinds and titles in their order, and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        read = [_get(folder, f"{b}-rows") for b in blocks]
        parent, parents = _codes([_texts(r[0]) for r in read])
        kind, kinds = _codes([_texts(r[1]) for r in read])
        title, _ = _codes([_texts(r[2]) for r in read])
        bits = np.array([1 << COVERED.index(k) if k in COVERED else 0 for k in kinds.to_pylist()], np.int8)
        _put(folder, "rows", {"parent": parent, "kind": kind, "bits": bits[kind], "title": title, "weight": np.concatenate([r[3] for r in read]), "parents": parents})
        yield pa.RecordBatch.from_arrays([pa.array([len(parents)])], ["n"])

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, n): tokens of two columns of texts, and in how many rows they stand."""
    for batch in batches:
        n: Counter[str] = Counter()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n.update({*tokens(a), *tokens(b)})
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["t", "n"])


def _keyed(shared):
    """Texts as sorted numbers of their tokens that occur, four bytes each; rows without a first text that occurs are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        for batch in batches:
            keys = []
            for column in batch.columns[:2]:
                known: dict[str, bytes] = {}
                for text in column.to_pylist():
                    if text not in known:
                        own = sorted(ids[t] for t in tokens(text) if t in ids)
                        known[text] = struct.pack(f">{len(own)}I", *own)
                    keys.append(known[text])
            first, second = keys[: batch.num_rows], keys[batch.num_rows :]
            own = pa.array([len(x) > 0 for x in first], pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary()).filter(own), pa.array(second, pa.binary()).filter(own), batch.column(2).filter(own)], ["a", "b", "ids"])

    return run


class _Bags:
    """Bags of terms in a row, and their exact scores."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.ptr = np.cumsum([0, *(len(t) for t, _ in bags)])
        self.asked, self.times = np.concatenate([t for t, _ in bags]).astype(np.int64), np.concatenate([w for _, w in bags])
        self.short = np.uint16 if self.asked.max() < 1 << 16 else np.int64  # short numbers are sorted by digits

    def scores(self, n: int, start: np.ndarray, doc: np.ndarray, value: np.ndarray, bag: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of documents of a block, each for a bag: terms are looked up one after the other, and added in the order of the bag."""
        out = np.zeros(len(bag))
        of = np.zeros(n)
        for at in range(0, len(bag), PAIRS):
            b = bag[at : at + PAIRS]
            row, place = _spans(self.ptr[b], self.ptr[b + 1])
            term, where = self.asked[place].astype(self.short), docs[at : at + PAIRS][row]
            order = np.argsort(term, kind="stable")
            term, where = term[order], where[order]
            ends = np.flatnonzero(np.r_[True, term[1:] != term[:-1], True])
            added = np.zeros(len(row))
            for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                t = int(term[i])
                mine = doc[start[t] : start[t + 1]]
                of[mine] = value[start[t] : start[t + 1]]
                added[order[i:j]] = of[where[i:j]]
                of[mine] = 0.0
            out[at : at + PAIRS] = np.bincount(row, added * self.times[place], len(b))
        return out


def _best(folder: str, blocks: list[str], bags: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, scores, number of them) of the ``k`` best of each bag, by rounded score, then document; the bags (terms, times) are sorted.

    Documents that may be among them are found by sums of four bytes, with the error these can have, and scored exactly.
    """
    docs, scores, sizes = np.zeros((len(bags), k), np.int32), np.zeros((len(bags), k)), np.zeros(len(bags), np.int64)
    bound = [0.0] * len(bags)
    row = _Bags(bags)
    listed = [list(zip(t.tolist(), w.tolist(), strict=True)) for t, w in bags]
    error = [(len(x) + 2) * 2.0**-23 for x in listed]
    deepest = max(map(len, listed), default=0)
    shared = [0] * (len(listed) + 1)
    for i in range(1, len(listed)):
        p, q, j = listed[i - 1], listed[i], 0
        while j < len(p) and j < len(q) and p[j] == q[j]:
            j += 1
        shared[i] = j
    added: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in bags]
    n_added = [0] * len(bags)
    waiting: list[tuple[int, np.ndarray]] = []
    first = due = n_waiting = 0

    def merge(i: int) -> None:
        m = int(sizes[i])
        own = np.concatenate([docs[i, :m], *(d for d, _ in added[i])])
        held = np.concatenate([scores[i, :m], *(s for _, s in added[i])])
        order = np.argsort(-np.floor(held * 1e9 + 0.5), kind="stable")[:k]  # documents stand in their order
        m = sizes[i] = order.size
        docs[i, :m], scores[i, :m] = own[order], held[order]
        added[i], n_added[i] = [], 0
        if m == k:
            bound[i] = float(scores[i, k - 1]) * (1 - 1e-12 - error[i]) - SLACK

    for block in blocks:
        (n,), start_of, doc, value = _get(folder, block)
        n, start, doc = int(n), start_of.tolist(), doc.astype(np.int64)
        brief = value.astype(np.float32)
        cut = first + n >= due

        def settle() -> None:
            nonlocal waiting, n_waiting
            if not waiting:
                return
            found = np.concatenate([f for _, f in waiting])
            ends = np.cumsum([f.size for _, f in waiting])
            held = row.scores(n, start_of, doc, value, np.repeat([i for i, _ in waiting], np.diff(ends, prepend=0)), found)  # noqa: B023
            found = found + first  # noqa: B023
            a = 0
            for (i, _), z in zip(waiting, ends.tolist(), strict=True):
                added[i].append((found[a:z], held[a:z]))
                n_added[i] += z - a
                a = z
                if cut or n_added[i] > 4 * k:  # noqa: B023
                    merge(i)
            waiting, n_waiting = [], 0

        sums = [np.zeros(n, np.float32)] + [None] * deepest
        whole: dict[int, np.ndarray] = {}
        depth = 0  # sums up to here are of the bag before
        for i, bag in enumerate(listed):
            depth = min(depth, shared[i])
            undo = None
            # The last term, behind which no bag goes on, is added in place and taken back if few documents have it.
            alone = len(bag) if shared[i + 1] < len(bag) else -1
            total = sums[depth]
            for j in range(depth, len(bag)):
                term, times = bag[j]
                a, z = start[term], start[term + 1]
                if (z - a) * DENSE >= n:
                    out = sums[j + 1] if sums[j + 1] is not None else np.empty(n, np.float32)
                    if term not in whole:
                        whole[term] = np.zeros(n, np.float32)
                        whole[term][doc[a:z]] = brief[a:z]
                    np.add(total, whole[term] if times == 1 else whole[term] * np.float32(times), out=out)
                elif j + 1 == alone:
                    if a < z:
                        where = doc[a:z]
                        undo = (where, total[where])
                        total[where] = undo[1] + brief[a:z] * np.float32(times)
                    break
                else:
                    out = sums[j + 1] if sums[j + 1] is not None else np.empty(n, np.float32)
                    np.copyto(out, total)
                    out[doc[a:z]] += brief[a:z] * np.float32(times)
                total = sums[j + 1] = out
                depth = j + 1
            found = (total >= bound[i] if bound[i] > 0 else total > 0).nonzero()[0]
            if found.size > 2 * k:
                held = total[found]
                least = float(np.partition(held, found.size - k)[found.size - k]) * (1 - 2 * error[i]) - SLACK
                found = found[held >= least]
            if undo is not None:
                total[undo[0]] = undo[1]
            if found.size:
                waiting.append((i, found))
                n_waiting += found.size
                if n_waiting >= PAIRS:
                    settle()
        settle()
        first += n
        due = 2 * first if cut else due
    for i in range(len(bags)):
        if added[i]:
            merge(i)
    return docs, scores, sizes


def _firsts(group: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the ``k`` first of their group; rows of a group stand together, groups ascend."""
    return np.arange(len(group)) - np.searchsorted(group, group) < k


def _weighed(group: np.ndarray, score: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Scores scaled to 0..1 in each group, times a weight; groups ascend."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    place = np.cumsum(np.r_[False, group[1:] != group[:-1]])
    low, high = np.minimum.reduceat(score, start)[place], np.maximum.reduceat(score, start)[place]
    equal = high - low <= 1e-9 * np.maximum(np.abs(low), np.abs(high))
    norm = np.where(equal, np.where(high > 0, 1.0, 0.0), (score - low) / np.where(equal, 1.0, high - low))
    return _round(norm * weight, 9)


def _parents(rows: dict[str, np.ndarray], group: np.ndarray, doc: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, parent, support, bits of the covered kinds) from the three best documents of each parent by weighed score, kind and document."""
    both = group.astype(np.int64) * (int(rows["parent"].max()) + 1) + rows["parent"][doc]
    order = np.lexsort((doc, rows["kind"][doc], _down(w), both))
    both, doc, w, group = both[order], doc[order], w[order], group[order]
    start = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    size = np.diff(np.r_[start, len(both)])
    s, bits = [], np.zeros(len(start), np.int8)
    for i in range(len(SUPPORT)):
        at = np.minimum(start + i, len(both) - 1)
        s.append(np.where(size > i, w[at], 0.0))
        bits |= np.where(size > i, rows["bits"][doc[at]], 0).astype(np.int8)
    return group[start], rows["parent"][doc[start]], s[0] * SUPPORT[0] + SUPPORT[1] * s[1] + SUPPORT[2] * s[2], bits


def _listed(n: np.ndarray, each: float) -> np.ndarray:
    """``each``, of two digits, times a number of covered kinds, without the error of a product."""
    return np.array([round(each * i, 2) for i in range(len(COVERED) + 1)])[n]


def _coarse(rows: dict[str, np.ndarray], lists: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], depth: int, pool: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, parent) of the ``pool`` best parents of each group over its fused lists (group, document, score, rank), first list first."""
    group, doc, score, rank = (np.concatenate(x) for x in zip(*lists, strict=True))
    both = group.astype(np.int64) * len(rows["parent"]) + doc
    order = np.argsort(both, kind="stable")
    start = np.flatnonzero(np.r_[True, both[order][1:] != both[order][:-1]])
    rrf = np.add.reduceat(1.0 / (COARSE_RRF + rank[order]), start)
    own = order[start]
    group, doc, score = group[own], doc[own], score[own] + rrf
    order = np.lexsort((rows["title"][doc], -np.floor(rrf * 1e9 + 0.5), group))
    order = order[_firsts(group[order], depth)]
    group, doc, score = group[order], doc[order], score[order]
    group, parent, support, bits = _parents(rows, group, doc, _weighed(group, score, rows["weight"][doc]))
    placed = np.lexsort((parent, _down(_round(support + _listed(np.bitwise_count(bits), COARSE_TYPE), 9)), group))
    placed = placed[_firsts(group[placed], pool)]
    return group[placed], parent[placed]


def _within(folder: str, blocks: list[str], rows: dict[str, np.ndarray], group: np.ndarray, parent: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, document, score) of the ``k`` best documents of each group's bag among its parents' documents."""
    row = _Bags(bags)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    first = 0
    by = np.argsort(parent, kind="stable")
    group, parent = group[by], parent[by]
    held = rows["parent"]
    for block in blocks:
        (n,), start, doc, value = _get(folder, block)
        n = int(n)
        # The block's documents by parent, and the pairs of group and document in it.
        docs = np.argsort(held[first : first + n], kind="stable")
        own = held[first : first + n][docs]
        here = np.flatnonzero((parent >= own[0]) & (parent <= own[-1]))
        a, z = np.searchsorted(own, parent[here]), np.searchsorted(own, parent[here], "right")
        pair, place = _spans(a, z)
        q, d = group[here[pair]], docs[place]
        score = row.scores(n, start, doc, value, q, d)
        some = score > 0
        out.append((q[some], (d[some] + first).astype(np.int32), score[some]))
        first += n
    group, doc, score = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((doc, -np.floor(score * 1e9 + 0.5), group))
    order = order[_firsts(group[order], k)]
    return group[order], doc[order], score[order]


def _retrieve(folder: str, blocks: list[str], depth: int, pool: int, fine: int, k: int, id_type: pa.DataType, names: list[str], most: int, fused: int):
    """The ``k`` best parents of every id of the bags in a partition."""

    def bag(key: bytes) -> tuple[np.ndarray, np.ndarray]:
        terms, times = np.unique(np.frombuffer(key, ">u4").astype(np.int64), return_counts=True)
        return terms, times.astype(np.float64)

    def found(rows: dict[str, np.ndarray], parents: pa.Array, first: list[bytes], second: list[bytes], ids: pa.Array) -> Iterator[pa.RecordBatch]:
        keys = sorted({*first, *(x for x in second if x)})
        number = {x: i for i, x in enumerate(keys)}
        bags = [bag(x) for x in keys]
        docs, scores, sizes = _best(folder, blocks, bags, depth)
        chosen = []
        for at in range(0, len(first), fused):
            lists = []
            for own in (first, second):
                which = np.array([number.get(x, -1) for x in own[at : at + fused]], np.int64)
                g = np.flatnonzero(which >= 0)
                row, place = _spans(np.zeros(len(g), np.int64), sizes[which[g]])
                lists.append(((g[row] + at), docs[which[g][row], place].astype(np.int64), scores[which[g][row], place], place + 1))
            chosen.append(_coarse(rows, lists, depth, pool))
        del docs, scores
        group, parent = (np.concatenate(x) for x in zip(*chosen, strict=True))
        group, doc, score = _within(folder, blocks, rows, group, parent, [bags[number[x]] for x in first], fine)
        group, parent, support, bits = _parents(rows, group, doc, _weighed(group, score, rows["weight"][doc]))
        has = lambda bit: (bits & bit) > 0
        total = support + _listed(np.bitwise_count(bits), FINE_TYPE) + np.where(has(_ENTRY) & has(_OVERVIEW), FINE_ENTRY, 0.0) + np.where(has(_ARMS) & (has(_ENTRY) | has(_EXIT)), FINE_ARMS, 0.0)
        order = np.lexsort((parent, _down(_round(total, 9)), group))
        order = order[_firsts(group[order], k)]
        group, parent, support, total = group[order], parent[order], _round(support[order], 6), _round(total[order], 6)
        rank = np.arange(len(group)) - np.searchsorted(group, group) + 1
        # Rows of each id of a bag.
        start = np.searchsorted(group, np.arange(len(first) + 1))
        offsets, flat = ids.offsets.to_numpy(), ids.values
        which, place = _spans(offsets[:-1], offsets[1:])
        for at in range(0, len(which), 10_000):
            g = which[at : at + 10_000]
            row, own = _spans(start[g], start[g + 1])
            columns = [flat.take(pa.array(place[at : at + 10_000][row])), parents.take(pa.array(parent[own])).cast(pa.string()), *(pa.array(x[own]) for x in (rank, support, total))]
            yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, parents, kept, n = None, None, [], 0

        def some() -> Iterator[pa.RecordBatch]:
            own = pa.Table.from_batches(kept).combine_chunks()
            ids = own.column("ids").combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            yield from found(rows, parents, own.column("a").to_pylist(), own.column("b").to_pylist(), pa.ListArray.from_arrays(_offsets(ids), ids.flatten().cast(id_type)))

        for batch in batches:
            if not batch.num_rows:
                continue
            if rows is None:
                *arrays, parents = _get(folder, "rows")
                rows = dict(zip(("parent", "kind", "bits", "title", "weight"), arrays, strict=True))
                parents = _texts(parents)
            kept.append(batch)
            n += batch.num_rows
            if n >= most:
                yield from some()
                kept, n = [], 0
        if n:
            yield from some()

    return run


def _offsets(lists: pa.Array) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int32))


def two_stages(documents: DataFrame, key: str, weights: dict[str, float], parent: str, kind: str, title: str, weight: str, queries: DataFrame, query_key: str, texts: tuple[str, str], depth: int, pool: int, fine: int, k: int) -> DataFrame:
    """(query_key, parent, rank, support, score) of the ``k`` best parents of every query.

    Both texts of a query are searched over all documents by BM25 (``depth`` documents each), fused by
    rank, scaled, weighed, and grouped to the ``pool`` best parents by support and coverage; then the first text within
    these parents' documents (``fine`` of them), grouped to parents again. Exact: ties go by rounded
    score, then title or kind, then key. Queries with the same terms are searched once; rows of one
    query key count as one query, rows without one have none.

    Keys must be unique. The driver holds the distinct terms of all queries; a task holds a block, lists
    of some ``SLICE`` queries, and five numbers a document. Blocks stay in the shared folder until this process
    ends. Work grows with queries times documents, as exact search does.
    """
    spark = documents.sparkSession
    fields = [f for f, w in weights.items() if w > 0]
    # A blank parts the texts of a key that is there more than once; tokens hold none.
    listed = [F.concat_ws(" ", F.collect_list(F.col(t))).alias(n) for t, n in zip(texts, "ab", strict=True)]
    asked = queries.where(F.col(query_key).isNotNull()).groupBy(query_key).agg(*listed).where(F.col("a") != "")
    asked = materialize(asked.groupBy("a", "b").agg(F.collect_list(query_key).alias("ids")))
    words = asked.select("a", "b").mapInArrow(_words, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    # Terms that most queries have come first, so that many bags begin alike.
    terms = words.sort_values(["n", "t"], ascending=[False, True])["t"].tolist()
    id_type = queries.schema[query_key].dataType
    schema = f"`{query_key}` {id_type.simpleString()}, `{parent}` string, rank long, support double, score double"

    whole = documents.where(F.col(key).isNotNull())
    named = [F.col(f).cast("string").alias(f"__f{i}") for i, f in enumerate(fields)]
    folder = shared_folder(spark, "stages")
    cores = spark.sparkContext.defaultParallelism
    extra = [F.coalesce(F.col(parent).cast("string"), F.lit("")).alias("__parent"), F.coalesce(F.col(kind).cast("string"), F.lit("")).alias("__kind"), F.lower(F.coalesce(F.col(title), F.lit(""))).alias("__title"), F.col(weight).cast("double").alias("__weight")]
    placed = whole.select(*named, *extra, F.col(key).alias("__key")).repartitionByRange(max(cores, -(-whole.select(key).count() // BLOCK)), "__key").sortWithinPartitions("__key")
    counting = _count_blocks((FIRST, 2 * BLOCK, BLOCK_POSTINGS), spark.sparkContext.broadcast(terms), folder, len(fields))
    counts = placed.mapInArrow(counting, "field int, term int, n long, length long").groupBy("field", "term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).toArrow().to_pandas()
    df, average, n = np.zeros((len(fields), max(len(terms), 1))), np.zeros(len(fields)), 0
    some = counts[(counts["field"] >= 0) & (counts["term"] >= 0)]
    df[some["field"], some["term"]] = some["n"]
    for f, m, size in counts.loc[counts["term"] < 0, ["field", "n", "length"]].itertuples(index=False):
        n, average[f] = int(m), size / m if m else 0.0
    blocks = [f"{p}-{b}" for p, m in sorted(counts.loc[counts["field"] < 0, ["term", "n"]].itertuples(index=False, name=None)) for b in range(m)]
    known = df.sum(axis=0) > 0
    if not known.any():
        return spark.createDataFrame([], schema)
    state = {"weight": [float(weights[f]) for f in fields], "average": average.tolist(), "idf": np.log(1 + (n - df + 0.5) / (df + 0.5))}
    names = spark.createDataFrame([(b,) for b in blocks], "block string").repartition(min(len(blocks), 4 * cores))
    names.mapInArrow(_value_blocks(spark.sparkContext.broadcast(state), folder), "block string").count()
    spark.range(1, numPartitions=1).mapInArrow(_gather(folder, blocks), "n long").collect()

    ids = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms) if known[i]})
    id_list = f"array<{id_type.simpleString()}>"
    bags = asked.mapInArrow(_keyed(ids), f"a binary, b binary, ids {id_list}").groupBy("a", "b").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    bags = materialize(bags)
    slices = max(3 * cores, -(-bags.count() // SLICE))
    from pyspark.sql.pandas.types import to_arrow_type

    sliced = bags.repartitionByRange(slices, "a", "b").sortWithinPartitions("a", "b")
    return sliced.mapInArrow(_retrieve(folder, blocks, depth, pool, fine, k, to_arrow_type(id_type), [query_key, parent, "rank", "support", "score"], 2 * SLICE, FUSED), schema)
