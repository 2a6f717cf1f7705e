"""Parents reranked by their best items, coverage and matched terms; fused lists of query variants; a retriever of several channels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialloom.functions.text import normalize_whitespace
from trialloom.operators import fusion
from trialloom.operators.cases import contained
from trialloom.operators.ranking import RANK_DIGITS, top_k

# What the second and third item of a parent count beside the best.
SUPPORT = (1.0, 0.35, 0.2)
# Item types that count as coverage, and what each of them and two combinations add.
COVERED = ("eligibility_inclusion", "eligibility_exclusion", "overview", "arms_interventions")
COARSE_TYPE, FINE_TYPE, FINE_ENTRY, FINE_ARMS = 0.03, 0.05, 0.05, 0.04
# Fixed values: (gain a matched term, most terms that gain) of conditions, interventions and intents.
GAINS = {"conditions": (0.08, 3), "interventions": (0.06, 3), "intents": (0.07, 2)}
# Losses where no term of a kind matches, where one of two kinds is missing, and per term ruled out (two at most).
NO_CONDITION, NO_INTERVENTION, NOT_BOTH, RULED_OUT, MOST_RULED_OUT = 0.55, 0.9, 0.45, 0.45, 2
# Names a backend goes by.
BACKENDS = {"bm25": "bm25", "vector": "vector", "hybrid": "hybrid", "auto": "hybrid", "keyword": "bm25", "parameter": "bm25", "medcpt": "vector"}
#: Constant of rank fusion over query variants.
COARSE_RRF = 60


def best_items(items: DataFrame, group: list[str], parent: str, item: str, kind: str, score: Column, text: str | None = None, short: bool = False, also: tuple[Column, ...] = ()) -> DataFrame:
    """(group, parent, n_items, s1..s3, types, texts) of every parent: its three best items by score, type and id.

    Cut in each partition before the shuffle, so a parent's items never meet in one task.
    ``short`` says that groups are bounded (lists of k items): then they are
    counted in a window over the items, which are made once. ``also`` are further aggregates of the three.
    """
    weighed = items.withColumn("__w", F.round(score, RANK_DIGITS))
    if short:
        weighed = weighed.withColumn("n_items", F.count(F.lit(1)).over(Window.partitionBy(*group, parent)))
    first = top_k(weighed, [*group, parent], [F.col("__w").desc(), F.col(kind).asc(), F.col(item).asc()], len(SUPPORT), "__rank")
    at = lambda i: F.coalesce(F.max(F.when(F.col("__rank") == i, F.col("__w"))), F.lit(0.0)).alias(f"s{i}")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rank", F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda s: s["t"]), " ") if text else F.lit("")
    counted = [*also, F.max("n_items").alias("n_items")] if short else list(also)
    best = first.groupBy(*group, parent).agg(at(1), at(2), at(3), F.array_sort(F.collect_set(kind)).alias("types"), texts.alias("texts"), F.max(F.when(F.col("__rank") == 1, F.col(item))).alias("best_item"), *counted)
    if short:
        return best
    return best.join(weighed.groupBy(*group, parent).agg(F.count(F.lit(1)).alias("n_items")), [*group, parent])


def support() -> Column:
    """The weighted sum of ``s1`` to ``s3``."""
    return F.col("s1") * SUPPORT[0] + F.col("s2") * SUPPORT[1] + F.col("s3") * SUPPORT[2]


def coverage(types: Column, stage: str) -> Column:
    """What the types of a parent's best items add, in the ``coarse`` or the ``fine`` stage."""
    n = F.size(F.array_intersect(types, F.array(*[F.lit(t) for t in COVERED])))
    if stage == "coarse":
        return n * COARSE_TYPE
    has = lambda t: F.array_contains(types, t)
    entry = has("eligibility_inclusion") & has("overview")
    arms = has("arms_interventions") & (has("eligibility_inclusion") | has("eligibility_exclusion"))
    return n * FINE_TYPE + F.when(entry, FINE_ENTRY).otherwise(0.0) + F.when(arms, FINE_ARMS).otherwise(0.0)


def flat_text(text: Column) -> Column:
    """A text in lower case with runs of blanks as one space."""
    return F.lower(normalize_whitespace(text))


def matched_terms(terms: Column, pool: Column | None, text: Column) -> Column:
    """The terms that hold or are held by a text of the pool, or stand in ``text``, in any case; blank ones never."""
    filled = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: flat_text(t) != "")
    flat = flat_text(text)
    inside = F.filter(filled, lambda t: F.contains(flat, flat_text(t)))
    return inside if pool is None else F.filter(filled, lambda t: F.array_contains(inside, t) | (F.size(contained(F.array(flat_text(t)), F.transform(pool, flat_text))) > 0))


def match_score(matched: dict[str, Column], asked: dict[str, Column], ruled_out: Column) -> tuple[Column, Column]:
    """(gain, loss) of a parent from its matched terms of each kind, the terms asked for, and the matched terms that are ruled out."""
    sizes = {kind: F.size(F.coalesce(c, F.array().cast("array<string>"))) for kind, c in asked.items()}
    return count_score({kind: F.size(c) for kind, c in matched.items()}, sizes, F.size(ruled_out))


def count_score(matched: dict[str, Column], asked: dict[str, Column], ruled_out: Column) -> tuple[Column, Column]:
    """``match_score`` of the numbers of terms."""
    gain = F.lit(0.0)
    for kind, (each, most) in GAINS.items():
        if kind in matched:
            gain = gain + F.least(matched[kind], F.lit(most)) * each
    wants = lambda kind: asked[kind] > 0
    lacks = {kind: wants(kind) & (matched[kind] == 0) for kind in ("conditions", "interventions")}
    loss = F.when(lacks["conditions"], NO_CONDITION).otherwise(0.0) + F.when(lacks["interventions"], NO_INTERVENTION).otherwise(0.0)
    loss = loss + F.when(wants("conditions") & wants("interventions") & (lacks["conditions"] | lacks["interventions"]), NOT_BOTH).otherwise(0.0)
    return gain, loss + F.least(ruled_out, F.lit(MOST_RULED_OUT)) * RULED_OUT


def held_terms(terms: list[Column], flat: Column) -> Column:
    """The terms that stand in a text, the first as bit 1, the second as bit 2 and so on; a null term or text has none."""
    out = F.lit(0)
    for i, t in enumerate(terms):
        out = out.bitwiseOR(F.when(F.contains(flat, t), F.lit(1 << i)).otherwise(F.lit(0)))
    return out


def edges(flat: Column, reach: Column) -> Column:
    """The first and last ``reach`` signs of a flat text with a line end between, or the whole text if it isn't longer; '' without a reach.

    Edges of texts joined by blanks hold every term of at most ``reach`` + 1 signs that stands across the
    joint of the whole texts, and none that doesn't stand there, save terms with a line end.
    """
    ends = F.concat(F.left(flat, reach), F.lit("\n"), F.right(flat, reach))
    return F.when(reach.isNull() | flat.isNull(), "").when(F.length(flat) <= 2 * reach, flat).otherwise(ends)


def rerank(parents: DataFrame, profile: dict[str, Column], pools: dict[str, Column], text: Column, ruled_out: Column, stage: str = "fine") -> DataFrame:
    """``best_items`` with support, coverage, gain, loss and score; what the profile asks for matters in the fine stage only.

    ``profile`` and ``pools`` hold arrays of terms by kind (conditions,
    interventions, intents), of the case and of the parent. Bonuses for ages, sexes
    and recruiting states are rules of the domain and left out. Null arrays count as empty.
    """
    if stage not in ("coarse", "fine"):
        raise ValueError("stage is 'coarse' or 'fine'")
    out = parents.withColumn("support", support()).withColumn("coverage", coverage(F.col("types"), stage))
    gain = loss = F.lit(0.0)
    if stage == "fine":
        matched = {k: matched_terms(v, pools.get(k), text) for k, v in profile.items()}
        out = out.withColumns({f"matched_{k}": v for k, v in matched.items()})
        gain, loss = match_score({k: F.col(f"matched_{k}") for k in profile}, profile, matched_terms(ruled_out, None, text))
    out = out.withColumn("gain", gain).withColumn("loss", loss)
    return out.withColumn("score", F.col("support") + F.col("coverage") + F.col("gain") - F.col("loss"))


def fused_lists(ranked: DataFrame, group: list[str], item: str, order: Column, score: str = "score", rank: str = "rank", k: int = COARSE_RRF) -> DataFrame:
    """(group, item, n_lists, score, rrf) over ranked lists of query variants and channels.

    ``rrf`` is the sum of 1 / (k + rank), by which items are placed. ``score`` starts
    from the raw score in the item's first list by ``order`` and gains the same
    sums: what a later normalization works on. Null scores count as 0.
    """
    raw = F.min_by(F.coalesce(F.col(score), F.lit(0.0)), F.struct(order.alias("o"), F.col(rank)))
    added = F.sum(1.0 / (F.lit(k) + F.col(rank)))
    return ranked.groupBy(*group, item).agg(F.count(F.lit(1)).alias("n_lists"), (raw + added).alias("score"), added.alias("rrf"))


def resolve_backend(name: str | None, has_vectors: bool, default: str = "hybrid") -> str:
    """The backend a name stands for; an unknown one is bm25, and without vectors everything is."""
    found = BACKENDS.get(((name or "").strip() or default).lower(), "bm25")
    return found if has_vectors or found == "bm25" else "bm25"


def retrieve(group: str, item: str, catalog: DataFrame, bm25: Callable[[], DataFrame], vector: Callable[[], DataFrame] | None, backend: str | None = None, k: int = 10) -> DataFrame:
    """(group, item, rank, score, channels, catalog columns): the channels a backend asks for, fused and looked up, the ``k`` best of each group.

    Each channel gives (group, item, score), at most ``k`` a group. One channel
    keeps its scores; two are fused, each item starting from its first channel's raw score, placed by
    score, number of channels, title and item. ``catalog`` has one row per item
    with a title; an item without a row has a null title, placed as ''.
    """
    use = resolve_backend(backend, vector is not None)
    listed = {"bm25": bm25, "vector": vector}
    parts = [listed[name]().select(group, item, "score", F.lit(name).alias("channel")) for name in ("bm25", "vector") if use in (name, "hybrid")]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    names = rows.groupBy(group, item).agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"), F.countDistinct("channel").alias("n_channels"), F.max("score").alias("own"))
    if len(parts) == 1:
        scored = names.withColumnRenamed("own", "score")
    else:
        scored = fusion.fuse(rows, [group], item, ["bm25", "vector"], mode="structured", short=True).select(group, item, "score").join(names.drop("own"), [group, item])
    wide = scored.join(catalog, item, "left")
    order = [F.round("score", RANK_DIGITS).desc(), F.desc("n_channels"), F.lower(F.coalesce("title", F.lit(""))), F.col(item)]
    return top_k(wide, [group], order, k).drop("n_channels")


def parameter_rerank(rows: DataFrame, group: str, item: str, names: DataFrame, terms: DataFrame, channels: tuple[str, str] = ("bm25", "vector")) -> DataFrame:
    """(group, item, rank, score, overlap, ratio, channels) of all items of two channels' lists, by the parameters they share with a case.

    Two points a shared parameter, 1.5 times the share of the item's parameters
    that are shared, .75 a channel, and in each channel its place from the end of the list (1 for the
    first) and .35 times its score over the list's best. Placed by score,
    channels, overlap, rank in each channel, first appearance over both, title and item. ``rows``
    has group, item, channel, rank and score of lists of bounded length; ``names`` item, title and an array
    ``parameters``; ``terms`` group and an array ``terms``. Names are compared in
    lower case with blanks and dashes as '_'; a null array counts as empty.
    """
    flat = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda t: F.regexp_replace(F.lower(F.trim(t)), r"[\s_-]+", "_")), lambda t: t != "")
    over = Window.partitionBy(group, "channel")
    kept = rows.where(F.col("channel").isin(*channels)).withColumns({"__size": F.count(F.lit(1)).over(over), "__top": F.max(F.coalesce("score", F.lit(0.0))).over(over)})
    signal = (F.col("__size") - F.col("rank") + 1) / F.col("__size") + F.when(F.col("__top") > 0, F.coalesce("score", F.lit(0.0)) / F.col("__top") * 0.35).otherwise(0.0)
    ranks = [F.coalesce(F.min(F.when(F.col("channel") == c, F.col("rank"))), F.lit(1_000_000_000)).alias(f"__r{i}") for i, c in enumerate(channels)]
    per = kept.groupBy(group, item).agg(F.sum(signal).alias("__signal"), F.countDistinct("channel").alias("n_channels"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"), *ranks)
    wide = per.join(names.select(item, "title", flat(F.col("parameters")).alias("__own")), item, "left").join(terms.select(group, flat(F.col("terms")).alias("__asked")), group, "left")
    own, asked = (F.coalesce(c, F.array().cast("array<string>")) for c in ("__own", "__asked"))
    overlap = F.size(F.filter(own, lambda p: F.array_contains(asked, p)))
    wide = wide.withColumn("overlap", overlap).withColumn("ratio", F.coalesce(F.try_divide(overlap, F.nullif(F.size(F.array_distinct(own)), F.lit(0))), F.lit(0.0)))
    wide = wide.withColumn("score", F.col("overlap") * 2.0 + F.col("ratio") * 1.5 + F.col("n_channels") * 0.75 + F.col("__signal"))
    first = F.least(F.struct("__r0", F.lit(0)), F.struct(F.col("__r1").alias("__r0"), F.lit(1)))
    order = [F.round("score", RANK_DIGITS).desc(), F.desc("n_channels"), F.desc("overlap"), F.col("__r0"), F.col("__r1"), first, F.lower(F.coalesce("title", F.lit(""))), F.col(item)]
    placed = wide.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return placed.select(group, item, "rank", "score", "overlap", "ratio", "channels")
