"""Packing items of varying length into containers of fixed capacity, source mixture kept."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.operators.positions import sums_before
from trialloom.session import materialize

#: Size of all items of a shard together, about: what one task packs.
SHARD_SIZE = 2_000_000
#: Buckets of a source for each shard: a shard's part of a source is right to one of them.
BUCKETS = 64
#: Containers a window fills before it closes; the mixture is kept window by window.
WINDOW = 128


class Packer:
    """Best fit into open containers; a container closes once nothing useful fits."""

    def __init__(self, capacity: int, open_limit: int):
        self.capacity, self.open_limit = capacity, open_limit
        self.room: list[tuple[int, int]] = []  # (free, container), sorted
        self.made = 0

    def place(self, size: int) -> int:
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            free, container = self.room.pop(at)
        else:
            container, free = self.made, self.capacity
            self.made += 1
        if free - size > 0:
            insort(self.room, (free - size, container))
            if len(self.room) > self.open_limit:
                self.room.pop(0)  # the fullest one
        return container


def drain(sizes: np.ndarray, sources: np.ndarray, shares: dict[int, float], carried: dict[int, float], capacity: int, window: int) -> np.ndarray:
    """Container numbers for the items of a shard.

    Deficit round-robin: each window gives every source its share of the window's
    room on top of what it was short of so far; a source's items leave its queue
    while the credit lasts, the debt of the last one being carried on. The items
    drawn are packed largest first into the open containers.
    """
    order = np.argsort(-sizes, kind="stable")
    queues = {s: order[sources[order] == s] for s in np.unique(sources)}
    # A queue mixes sizes: large and small items of a source alternate, so every window can fill its gaps.
    queues = {s: np.concatenate([q[k :: max(1, len(q) // 64)] for k in range(max(1, len(q) // 64))]) for s, q in queues.items()}
    sums = {s: np.concatenate([[0], np.cumsum(sizes[q])]) for s, q in queues.items()}
    heads = dict.fromkeys(queues, 0)
    credit = {s: carried.get(int(s), 0.0) for s in queues}
    packer = Packer(capacity, 8 * window)
    container = np.zeros(len(sizes), dtype=np.int64)
    room = window * capacity
    while any(heads[s] < len(q) for s, q in queues.items()):
        live = [s for s, q in queues.items() if heads[s] < len(q)]
        total = sum(shares.get(int(s), 0.0) for s in live)
        drawn = []
        for s in live:
            credit[s] += room * (shares.get(int(s), 0.0) / total if total else 1 / len(live))
            start = heads[s]
            end = int(np.searchsorted(sums[s], sums[s][start] + credit[s], side="right")) - 1
            end = max(start, end)
            credit[s] -= float(sums[s][end] - sums[s][start])
            drawn.append(queues[s][start:end])
            heads[s] = end
        batch = np.concatenate(drawn)
        for i in batch[np.argsort(-sizes[batch], kind="stable")]:
            container[i] = packer.place(int(sizes[i]))
    return container


def _pack_shard(capacity: int, window: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["__item", "piece_no"], kind="stable", ignore_index=True)
        sources = frame["__code"].to_numpy()
        first = frame.drop_duplicates("__code")
        shares = dict(zip(first["__code"], first["__share"], strict=True))
        carried = dict(zip(first["__code"], first["__carried"], strict=True))
        container = drain(frame["size"].to_numpy(), sources, shares, carried, capacity, window)
        return pd.DataFrame({"__item": frame["__item"], "piece_no": frame["piece_no"], "shard": frame["shard"], "slot": container})

    return run


def _cut(sources: DataFrame, targets: dict[str, float] | None) -> tuple[DataFrame, int, int]:
    """(source, __code, held, __cut): the size of each source and what of it is in the mixture; sizes in and outside.

    The mixture ends with the source that runs out first at its target share.
    Without targets everything is in it.
    """
    wanted = F.lit(None).cast("double")
    if targets:
        wanted = F.element_at(F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(max(float(v), 0.0)))]), F.coalesce("source", F.lit("")))
        wanted = F.when(F.col("source").isNotNull(), wanted)
    sources = sources.withColumn("__wanted", F.coalesce(wanted, F.lit(0.0)))
    got = sources.agg(F.sum("held").alias("all"), F.min(F.when((F.col("held") > 0) & (F.col("__wanted") > 0), F.col("held") / F.col("__wanted"))).alias("reach")).first()
    if not targets:
        return sources.drop("__wanted").withColumn("__cut", F.col("held").cast("double")), int(got["all"] or 0), 0
    sources = sources.withColumn("__cut", F.least(F.col("held").cast("double"), F.col("__wanted") * float(got["reach"] or 0.0)))
    inside = sources.agg(F.sum("__cut")).first()[0] or 0.0
    return sources.drop("__wanted"), int(inside), int(got["all"] or 0) - int(inside)


def pack(items: DataFrame, key: str, size: str, source: Column, capacity: int, targets: dict[str, float] | None = None, shard_size: int = SHARD_SIZE, window: int = WINDOW) -> DataFrame:
    """Every item's pieces with their container: (key, source, piece_no, n_pieces, size, start_at, container_id, window_id, in_mixture).

    An item above the capacity is divided into full pieces and one rest; no other
    item is. A source's pieces are hashed to buckets, and prefix sums over the buckets deal
    every shard its part of every source; a shard starts from the deficits that
    the shards before it leave, so the mixture holds along the whole row of shards.

    ``targets`` are the shares of the sources, scaled to 1 over the sources that
    have items. They hold until the first source runs out; a hash chooses what of
    the others is used till then. The surplus is packed as well, in containers of its
    own with ``in_mixture`` false. Without targets each source has its share of
    all sizes, so all queues end together and nothing is surplus. ``window_id``
    names ``window`` containers of a shard in a row, what ``mixture_report`` judges.

    An item of size 0 or null size takes no room: one row without container. A null
    source is a queue of its own, outside of any targets. Keys should be unique;
    rows with equal keys are packed each by itself.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    n_pieces = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)).cast("int")
    base = items.select(F.col(key), source.cast("string").alias("source"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    base = materialize(base.withColumn("__item", F.monotonically_increasing_id()).withColumn("n_pieces", n_pieces))
    code = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())
    sources = materialize(base.groupBy("source").agg(F.sum("size").alias("held")).withColumn("__code", code))
    sources, inside, outside = _cut(sources, targets)
    n_inside, n_outside = (max(1, -(-n // shard_size)) for n in (inside, outside))

    pieces = base.select("__item", key, "source", "n_pieces", F.col("size").alias("__whole"), F.explode(F.sequence(F.lit(1), "n_pieces")).alias("piece_no"))
    start = (F.col("piece_no") - 1) * F.lit(capacity).cast("long")
    pieces = pieces.withColumn("start_at", start).withColumn("size", F.least(F.col("__whole") - start, F.lit(capacity).cast("long")))
    dealt = F.pmod(F.xxhash64("__item", "piece_no"), F.lit((n_inside + n_outside) * BUCKETS))
    queue = pieces.where("size > 0").select("__item", "piece_no", "size", code.alias("__code"), dealt.alias("__bucket"))
    # Each source's buckets in a row: the first ones, up to its cut, are in the mixture. Both parts are cut into as many equal
    # lengths as there are shards, so every shard gets its part of every source.
    cells = queue.groupBy("__code", "__bucket").agg(F.sum("size").alias("held"))
    cells = sums_before(cells, ["__code"], "__bucket", "held", "__before").join(sources.select("__code", F.col("held").alias("__all"), "__cut"), "__code")
    middle = F.col("__before") + F.col("held") / 2
    outer = middle > F.col("__cut")
    near = F.least(F.floor(middle * n_inside / F.col("__cut")), F.lit(n_inside - 1))
    far = n_inside + F.least(F.floor((middle - F.col("__cut")) * n_outside / (F.col("__all") - F.col("__cut"))), F.lit(n_outside - 1))
    cells = materialize(cells.select("__code", "__bucket", "held", outer.alias("__outer"), F.when(outer, far).otherwise(near).alias("shard")))
    whole = cells.groupBy("__outer", "__code").agg(F.sum("held").alias("__source"))
    whole = whole.join(whole.groupBy("__outer").agg(F.sum("__source").alias("__whole")), "__outer").select("__outer", "__code", (F.col("__source") / F.col("__whole")).alias("__share"))
    # What each shard holds of each source, and how far the shards before it fell short of the shares.
    held = cells.groupBy("__outer", "__code", "shard").agg(F.sum("held").alias("held"))
    before = sums_before(held, ["__outer", "__code"], "shard", "held", "__held").join(whole, ["__outer", "__code"])
    totals = sums_before(held.groupBy("__outer", "shard").agg(F.sum("held").alias("total")), ["__outer"], "shard", "total", "__total").drop("__outer", "total")
    grid = before.join(totals, "shard").select("shard", "__code", "__share", (F.col("__share") * F.col("__total") - F.col("__held")).alias("__carried"))
    cells = cells.select("__code", "__bucket", "shard").join(grid, ["shard", "__code"])
    placed = queue.join(cells, ["__code", "__bucket"]).groupBy("shard").applyInPandas(_pack_shard(capacity, window), "__item bigint, piece_no int, shard bigint, slot bigint")

    name = lambda last: F.concat(F.lit("s"), F.col("shard").cast("string"), F.lit("-"), last.cast("string"))
    return pieces.join(placed, ["__item", "piece_no"], "left").select(
        key, "source", "piece_no", "n_pieces", "size", "start_at", name(F.col("slot")).alias("container_id"),
        name(F.floor(F.col("slot") / window)).alias("window_id"), (F.col("shard") < n_inside).alias("in_mixture"),
    )


def mixture_report(placed: DataFrame, capacity: int) -> DataFrame:
    """(in_mixture, n_windows, n_containers, fill, mean_error, max_error) of the output of ``pack``.

    ``fill`` is the used part of all containers' room. A window's error is half
    the sum of the differences between its sources' shares and those of all windows
    (the part of the window that would have to be exchanged); the mean weighs windows by their
    sizes, the largest is that of windows that are full up to a tenth. No containers
    give no rows.
    """
    used = placed.where(F.col("container_id").isNotNull())
    source = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    per = used.groupBy("in_mixture", "window_id", source.alias("s")).agg(F.sum("size").alias("n"))
    overall = per.groupBy("in_mixture", "s").agg(F.sum("n").alias("n_all"))
    overall = overall.join(overall.groupBy("in_mixture").agg(F.sum("n_all").alias("total")), "in_mixture")
    windows = per.groupBy("in_mixture", "window_id").agg(F.sum("n").alias("n_window"))
    # A source that a window lacks differs by its whole share: 1 minus the shares of those it has.
    rows = per.join(windows, ["in_mixture", "window_id"]).join(overall, ["in_mixture", "s"])
    share = F.col("n_all") / F.col("total")
    error = (F.sum(F.abs(F.col("n") / F.col("n_window") - share)) + 1 - F.sum(share)) / 2
    errors = rows.groupBy("in_mixture", "window_id", "n_window").agg(error.alias("error"))
    counts = used.groupBy("in_mixture").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("size").alias("n"))
    most = errors.groupBy("in_mixture").agg(F.max("n_window").alias("most"))
    judged = errors.join(most, "in_mixture").groupBy("in_mixture").agg(
        F.count(F.lit(1)).alias("n_windows"), (F.sum(F.col("error") * F.col("n_window")) / F.sum("n_window")).alias("mean_error"),
        F.max(F.when(F.col("n_window") >= 0.9 * F.col("most"), F.col("error"))).alias("max_error"),
    )
    return counts.join(judged, "in_mixture").select("in_mixture", "n_windows", "n_containers", (F.col("n") / (F.col("n_containers") * capacity)).alias("fill"), "mean_error", "max_error")
