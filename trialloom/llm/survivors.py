"""One surviving record of each duplicate group, field by field.

Bayesian fusion with copy detection weighs the sources that give a value: source
accuracies and the probability that one source copies another are estimated from
all items, a copied vote is discounted, and the value with the largest posterior
survives. The prior over records is the caller's: with ``policy="ranked"`` it is an
order whose every step outweighs any vote, with ``policy="posterior"`` records are
equal beforehand and only the sources' prior accuracies differ.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.llm.prefixes import mark_prefixes
from trialloom.session import materialize

# Words that stand in for a missing value (compared in lower case, without blanks at the ends).
STAND_INS = (
    "-", "--", "---", "?", "n/a", "n.a.", "na", "nan", "nil", "none", "null", "none given", "not given", "not available",
    "not applicable", "not provided", "not specified", "not stated", "unknown", "unspecified", "undefined", "tbd", "tba",
    "to be determined", "to be announced", "to follow", "pending", "missing", "empty", "blank", "see protocol", "[no text]", "no text",
)
# Endings by which a text says that it is cut off.
CUT_MARKS = r"(?i)(\[\s*(truncated|more|see full [a-z ]+|continued|cut|cut off|abridged|snip|\.\.\.|…)\s*\]|<\s*(truncated|more|see full [a-z ]+|continued|cut|cut off|abridged|snip|\.\.\.|…)\s*>|\(\s*(truncated|more|continued|cut|cut off|abridged|\.\.\.|…)\s*\)|\.\.\.|…)$"

#: Most sources that are told apart; a source is one bit of a mask.
MAX_SOURCES = 12
#: Distinct profiles of items (which sources share values) that are summed up on the driver; more are by Spark.
LOCAL_PROFILES = 20_000
#: A change of all accuracies below this ends the estimation.
SETTLED = 1e-3


def has_value(text: Column) -> Column:
    """Neither null nor blank nor a stand-in, and with at least one letter or digit."""
    bare = F.lower(F.regexp_replace(text, r"^[\s ​﻿]+|[\s ​﻿]+$", ""))
    return F.coalesce(~bare.isin(*STAND_INS) & bare.rlike(r"[\p{L}\p{N}]"), F.lit(False))


@dataclass(frozen=True)
class Trust:
    """What the estimation found: an accuracy per source and, per pair, the probability that one copies the other."""

    sources: list[str]
    accuracy: list[float]
    copies: list[list[float]]  # [s][t]: s copies t
    copied: list[list[float]]  # symmetric: the share of a pair's values that is copied, if there is copying
    n_false: int = 10
    rounds: int = 0
    settled: bool = False

    @property
    def dependence(self) -> list[list[float]]:
        """Probability that a pair of sources depends on each other, in either direction."""
        n = range(len(self.sources))
        return [[self.copies[s][t] + self.copies[t][s] for t in n] for s in n]

    def score(self, mask: int) -> float:
        """The log weight of a value given by the sources in ``mask``.

        Originals vote first; a later source counts by the part of its vote that
        isn't copied from any before it.
        """
        among = [s for s in range(len(self.sources)) if mask >> s & 1]
        depends = self.dependence
        given = sorted(among, key=lambda s: (round(sum(self.copies[s][t] - self.copies[t][s] for t in among), 9), -self.accuracy[s], s))
        total = 0.0
        for i, s in enumerate(given):
            own = math.prod(1 - self.copied[s][t] * depends[s][t] for t in given[:i])
            total += own * math.log(self.n_false * self.accuracy[s] / (1 - self.accuracy[s]))
        return total


def prior_accuracies(n: int) -> list[float]:
    """Accuracies to start from for sources listed by trust, the most trusted one first."""
    return [max(0.5, 0.9 - 0.1 * i) for i in range(n)]


def _odds(prior: list[float], logs: list[float]) -> list[float]:
    """Posterior of hypotheses from their priors and log likelihoods."""
    top = max(logs)
    weights = [p * math.exp(max(-700.0, x - top)) for p, x in zip(prior, logs, strict=True)]
    return [w / sum(weights) for w in weights]


def copying(true: float, false: float, differ: float, a: float, b: float, own_a: float, own_b: float, n_false: int, copy_rate: float, known: bool, prior: float = 0.2) -> tuple[float, float, float]:
    """(P(first copies second), P(second copies first), copied share) of a pair of sources.

    ``true`` and ``false`` count the values both give, ``differ`` the items on which
    they differ, ``own_a`` and ``own_b`` are accuracies on what the other doesn't
    give: a copier's own values are as good as its own work, its copied ones as
    good as the original's, which tells the direction. While no truth is
    ``known``, shared values count alike whether true or false.
    """

    def log_likelihood(p_true: float, p_false: float) -> float:
        p_differ = max(1 - p_true - p_false, 1e-9)
        if known:
            return true * math.log(p_true) + false * math.log(p_false) + differ * math.log(p_differ)
        return (true + false) * math.log(p_true + p_false) + differ * math.log(p_differ)

    def copied_from(original: float, own: float) -> float:
        p_true = original * (copy_rate + (1 - copy_rate) * own)
        p_false = (1 - original) * (copy_rate + (1 - copy_rate) * (1 - own) / n_false)
        return log_likelihood(p_true, p_false)

    apart = (a * b, (1 - a) * (1 - b) / n_false)
    _, first, second = _odds([1 - prior, prior / 2, prior / 2], [log_likelihood(*apart), copied_from(b, own_a), copied_from(a, own_b)])
    expected = sum(apart)
    agreed = (true + false) / max(true + false + differ, 1e-9)
    return first, second, min(1.0, max(0.0, (agreed - expected) / (1 - expected)))


def _believed(profiles: DataFrame, n_false: int) -> Callable[[dict[int, float]], dict[int, float]]:
    """A function from the weight of each mask to the expected number of true values among those with it.

    The same sums either way: over few distinct profiles on the driver, where a
    round takes no job, over more of them as an aggregation.
    """
    if profiles.limit(LOCAL_PROFILES + 1).count() <= LOCAL_PROFILES:
        rows = profiles.collect()  # at most LOCAL_PROFILES
        items = np.array([r["items"] for r in rows], dtype=np.float64)
        flat = [(i, p["mask"], p["k"]) for i, r in enumerate(rows) for p in r["profile"]]
        of, mask, k = (np.array(x) for x in zip(*flat, strict=True)) if flat else (np.zeros(0, dtype=np.int64),) * 3
        rest = np.maximum(n_false + 1 - np.bincount(of, weights=k, minlength=len(rows)), 0.0)

        def local(weight: dict[int, float]) -> dict[int, float]:
            w = k * np.array([weight[m] for m in mask.tolist()])
            part = items[of] * w / (np.bincount(of, weights=w, minlength=len(rows)) + rest)[of]
            return {m: float(part[mask == m].sum()) for m in weight}

        return local

    def distributed(weight: dict[int, float]) -> dict[int, float]:
        listed = F.create_map(*[x for m, w in weight.items() for x in (F.lit(m), F.lit(w))])
        total = F.aggregate("profile", F.lit(0.0), lambda acc, p: acc + p.k * F.element_at(listed, p["mask"]))
        size = F.aggregate("profile", F.lit(0), lambda acc, p: acc + p.k.cast("int"))
        rest = F.greatest(F.lit(n_false + 1) - size, F.lit(0))
        rows = profiles.select("items", F.explode("profile").alias("p"), (total + rest).alias("total"))
        part = F.col("items") * F.col("p.k") * F.element_at(listed, F.col("p.mask")) / F.col("total")
        return {r.mask: float(r.truth) for r in rows.groupBy("p.mask").agg(F.sum(part).alias("truth")).collect()}  # at most 2^MAX_SOURCES rows

    return distributed


def estimate_trust(
    values: DataFrame, item: list[str], sources: list[str], prior: list[float] | None = None, rounds: int = 60, n_false: int = 10, copy_rate: float = 0.8, strength: float = 10.0,
) -> tuple[Trust, list[int]]:
    """Accuracies and copying from a table of one row per item and value with the ``mask`` of its sources; and the masks.

    ``prior`` holds the accuracies believed beforehand (``sources`` by trust, if
    not given), worth ``strength`` claims each. Copying is judged before the first
    vote, from how often sources agree, and then in each round by the values
    they share, false ones above all. Rounds go on until no accuracy moves by more than
    ``SETTLED``; ``Trust.settled`` says whether that was reached within ``rounds``.

    An item matters only by how often each mask occurs among its values, and
    equal such profiles are counted together: a round sums over these. The
    driver gets sums per mask of sources, at most 2^MAX_SOURCES, and profiles up to ``LOCAL_PROFILES``.
    """
    n = len(sources)
    prior = prior or prior_accuracies(n)
    per_mask = values.groupBy(*item, "mask").agg(F.count(F.lit(1)).alias("k"))
    profiles = per_mask.groupBy(*item).agg(F.array_sort(F.collect_list(F.struct("mask", "k"))).alias("profile"))
    profiles = materialize(profiles.groupBy("profile").agg(F.count(F.lit(1)).alias("items")))
    counted = profiles.select("items", F.explode("profile").alias("p")).groupBy("p.mask").agg(F.sum(F.col("items") * F.col("p.k")).alias("k"))
    claims = {r.mask: float(r.k) for r in counted.collect()}  # at most 2^MAX_SOURCES rows
    masks = sorted(claims)
    both = profiles.select("items", F.aggregate("profile", F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(p["mask"])).alias("mask"))
    together = {r.mask: float(r.n) for r in both.groupBy("mask").agg(F.sum("items").alias("n")).collect()}  # at most 2^MAX_SOURCES rows

    believed = _believed(profiles, n_false)

    def judged(accuracy: list[float], truth: dict[int, float] | None) -> tuple[list[list[float]], list[list[float]]]:
        copies, copied = ([[0.0] * n for _ in range(n)] for _ in range(2))
        right = truth or dict.fromkeys(claims, 0.0)

        def own(s: int, t: int) -> tuple[float, float]:
            """The accuracy of ``s`` on what ``t`` doesn't give, and the number of such claims."""
            apart = [m for m in claims if m >> s & 1 and not m >> t & 1]
            said = sum(claims[m] for m in apart)
            return (min(0.99, max(0.01, (sum(right[m] for m in apart) + strength * accuracy[s]) / (said + strength))) if truth else accuracy[s]), said

        for s in range(n):
            for t in range(s):
                pair = (1 << s) | (1 << t)
                shared = sum(k for m, k in claims.items() if m & pair == pair)
                true = sum(x for m, x in right.items() if m & pair == pair)
                differ = max(0.0, sum(k for m, k in together.items() if m & pair == pair) - shared)
                if shared + differ:
                    (own_s, apart_s), (own_t, apart_t) = own(s, t), own(t, s)
                    one, other, copied[s][t] = copying(true, shared - true, differ, accuracy[s], accuracy[t], own_s, own_t, n_false, copy_rate, truth is not None)
                    if min(apart_s, apart_t) < strength:  # a source that says next to nothing by itself shows no direction
                        one = other = (one + other) / 2
                    copies[s][t], copies[t][s], copied[t][s] = one, other, copied[s][t]
        return copies, copied

    trust = Trust(sources, list(prior), *judged(prior, None), n_false)
    before = list(prior)  # the accuracies of the round before the last
    for done in range(1, rounds + 1):
        if not masks:
            break
        truth = believed({m: math.exp(min(trust.score(m), 300.0)) for m in masks})
        accuracy = []
        for s in range(n):
            said = sum(k for m, k in claims.items() if m >> s & 1)
            right = sum(x for m, x in truth.items() if m >> s & 1)
            found = min(0.99, max(0.01, (right + strength * prior[s]) / (said + strength)))
            turned = (found - trust.accuracy[s]) * (trust.accuracy[s] - before[s]) < 0
            accuracy.append((found + trust.accuracy[s]) / 2 if done > 10 and turned else found)  # halved steps end a swing between two states
        moved = max(abs(a - b) for a, b in zip(accuracy, trust.accuracy, strict=True))
        before = trust.accuracy
        trust = Trust(sources, accuracy, *judged(accuracy, truth), n_false, done, moved < SETTLED)
        if trust.settled:
            break
    return trust, masks


@dataclass(frozen=True)
class Fused:
    survivors: DataFrame
    trust: Trust


def fuse_fields(
    claims: DataFrame,
    group: list[str],
    record_id: str,
    fields: dict[str, Column],
    source: str,
    sources: list[str],
    preference: list[Column],
    cut_off_field: str | None = None,
    policy: str = "ranked",
    min_records: int = 2,
) -> Fused:
    """One row per group and field with a value: the surviving value, its record, its posterior.

    ``fields`` maps a field's name to its value as text; ``preference`` orders the
    records that give a value (ascending, nulls last), before ``record_id``.
    Copies of ``cut_off_field`` that say they are cut off, or are only the
    beginning of another copy in the group, yield to any that is whole.
    ``sources`` are the names told apart, the most trusted one first (at most 11,
    more is an error); any other name, and null, is one more source, trusted least.

    ``policy="posterior"`` takes the most probable value, the preference breaking
    ties. ``policy="ranked"`` makes the preference the prior: each of its steps has
    larger odds than all votes together, so votes only decide where it ties, and
    the order ends with the record's id. The posterior of the votes is given in both.

    Values are compared with blanks collapsed. Null, blank and stand-in values
    never count; a field without any value has no row. Groups with a null key or
    fewer than ``min_records`` records have none either. Repeated records and ties
    go to the smaller id. Groups of any size are reduced by partial aggregation.
    """
    if len(sources) >= MAX_SOURCES:
        raise ValueError(f"at most {MAX_SOURCES - 1} sources can be told apart")
    if policy not in ("ranked", "posterior"):
        raise ValueError("policy is 'ranked' or 'posterior'")
    bit = F.lit(1 << len(sources)).cast("long")
    for i, name in enumerate(sources):
        bit = F.when(F.col(source) == name, F.lit(1 << i).cast("long")).otherwise(bit)
    order = [x for p in preference for x in (p.isNull(), p)]
    rep = F.struct(*[x.alias(f"p{i}") for i, x in enumerate(order)], F.col(record_id).alias("id"))
    listed = F.array(*[F.struct(F.lit(n).alias("field_name"), v.cast("string").alias("value")) for n, v in fields.items()])
    base = claims.dropna(subset=group).select(*group, rep.alias("rep"), bit.alias("mask"), listed.alias("fields"))
    base = base.select(*group, "rep", "mask", F.explode("fields").alias("f"))
    item = [*group, "field_name"]
    valid = has_value(F.col("value"))
    flat = F.when(valid, F.trim(F.regexp_replace("value", r"[ \t\r\n]+", " ")))
    rows = base.select(*group, "rep", "mask", "f.*").withColumn("flat", flat)
    # One row per distinct value; rows without a value stay as one row, for the count of records.
    values = rows.groupBy(*item, "flat").agg(
        F.bit_or("mask").alias("mask"), F.min("rep").alias("rep"), F.min_by("value", "rep").alias("value"), F.count(F.lit(1)).alias("records")
    )
    values = materialize(values.withColumn("value_id", F.xxhash64(*item, "flat")))
    given = values.where(F.col("flat").isNotNull())
    trust, masks = estimate_trust(given, item, [*sources, "(other)"])
    if not trust.settled and masks:
        warnings.warn(f"source accuracies still move after {trust.rounds} rounds", stacklevel=2)
    if cut_off_field:
        marked = mark_prefixes(given.where(F.col("field_name") == cut_off_field), group, "flat", "value_id").where("is_prefix")
        marked = marked.withColumn("field_name", F.lit(cut_off_field))
        # The hash of the value spreads the join within one group; the group stands beside it, so that a clash can't mix groups.
        given = given.join(marked, [*item, "value_id"], "left").withColumn(
            "cut_off", (F.col("field_name") == cut_off_field) & (F.coalesce("is_prefix", F.lit(False)) | F.col("flat").rlike(CUT_MARKS))
        )
    else:
        given = given.withColumn("cut_off", F.lit(False))

    score = F.lit(0.0)
    if masks:
        score = F.element_at(F.create_map(*[x for m in masks for x in (F.lit(m), F.lit(math.exp(min(trust.score(m), 300.0))))]), F.col("mask"))
    choice = F.struct("cut_off", F.col("rep")) if policy == "ranked" else F.struct("cut_off", (-F.col("score")).alias("s"), "rep")
    chosen = given.withColumn("score", score).groupBy(*item).agg(
        F.min_by(F.struct("value", F.col("rep.id").alias(record_id), "score", "cut_off"), choice).alias("best"),
        F.sum("score").alias("__total"), F.count(F.lit(1)).alias("n_values"), F.sum("records").alias("__records"),
    )
    empty = values.where(F.col("flat").isNull()).select(*item, F.col("records").alias("__empty"))
    rest = F.greatest(F.lit(trust.n_false + 1) - F.col("n_values"), F.lit(0))
    survivors = (
        chosen.join(empty, item, "left")
        .where(F.col("__records") + F.coalesce("__empty", F.lit(0)) >= min_records)
        .select(*item, f"best.{record_id}", "best.value", "n_values", F.col("best.cut_off").alias("is_cut_off"), (F.col("best.score") / (F.col("__total") + rest)).alias("posterior"))
    )
    return Fused(survivors, trust)
