"""Putting cases together: merged inputs, anchors, intervals, groups by first appearance, best choices."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialloom.functions.text import dedupe, normalize_whitespace, token_count


def merge_maps(base: Column, over: Column) -> Column:
    """Two maps as one, the second one's values winning; a null map counts as empty."""
    none = F.create_map().cast("map<string,string>")
    base, over = F.coalesce(base, none), F.coalesce(over, none)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def anchors(text: Column, least: int = 2, most: int = 14) -> Column:
    """The parts of a problem text between commas, semicolons, 'and', 'complicated by' and 'where', of 2 to 14 words, once each."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?i)[,;\n]+|\.\s|\b(?:and|complicated by|where)\b")
    sized = lambda p: F.size(F.filter(F.split(normalize_whitespace(p), " "), lambda w: w != ""))
    return dedupe(F.filter(parts, lambda p: sized(p).between(least, most)))


# How a problem text may begin without saying anything, in order.
LEADING = (r"patient (?:is|was) a [^,;]+ with (?:a history of )?", "patient initially presented with ", "mri showed ", "found to be ", "the tumor is located in ")
# Words that call for another name behind the text, unless it stands there.
ALIASES = ((("astrocytoma",), "glioma", "glioma"), (("spinal cord", "spinal", "conus"), "spinal tumor", "spinal tumor"), (("avastin",), "bevacizumab", "bevacizumab"), (("mri",), "magnetic resonance imaging", "magnetic resonance imaging"))
# Single words that are anchors, and words that raise an anchor's score by 3, 2 and 1.5.
SINGLE = ("astrocytoma", "avastin", "bevacizumab", "glioma", "hypertension", "mri", "radiation")
RAISING = (
    (3.0, ("astrocytoma", "glioma", "glioblastoma", "meningioma", "tumor", "tumour", "neoplasm", "malignan", "metasta", "spinal", "conus", "cord")),
    (2.0, ("radiation", "radiotherapy", "chemotherapy", "temozolomide", "bevacizumab", "avastin", "surgery", "resection", "steroid")),
    (1.5, ("compression", "paralysis", "weakness", "retention", "numbness", "pain", "progressive")),
)


def _bare(text: Column) -> Column:
    return F.regexp_replace(normalize_whitespace(F.regexp_replace(F.coalesce(text, F.lit("")), "(?i)</?topic[^>]*>", " ")), "^[ ,-]+|[ ,-]+$", "")


def _without_lead(text: Column) -> Column:
    """``text`` without the first opening of ``LEADING`` that stands there, unless nothing is left."""
    out = text
    for lead in reversed(LEADING):
        rest = F.regexp_replace(F.regexp_replace(text, f"(?i)^{lead}", ""), "^[ ,-]+|[ ,-]+$", "")
        out = F.when((rest != "") & (rest != text), rest).otherwise(out)
    return out


def problem_anchors(problems: Column, most: int = 8) -> Column:
    """Up to ``most`` search texts of a list of problems, each once in any case, in order.

    A problem's fragments of 2 to 14 words come first, then the problem itself if
    it has at most 14, each without its opening and followed by its other names.
    Single words count only if they are listed. A null list gives an empty array.
    """
    single = lambda t: F.lower(t).isin(*SINGLE)
    named = lambda t: F.array_compact(F.array(t, *[F.when(F.greatest(F.lit(False), *[F.contains(F.lower(t), F.lit(w)) for w in words], F.lit(False)) & ~F.contains(F.lower(t), F.lit(without)), F.concat(t, F.lit(f" {name}"))) for words, without, name in ALIASES]))
    fits = lambda t: token_count(t).between(2, 14) | single(t)
    whole = lambda p: F.filter(F.array(_without_lead(p)), lambda t: (token_count(p) <= 14) & ((token_count(t) >= 2) | single(t)))

    def of_problem(problem: Column) -> Column:
        parts = F.transform(F.split(problem, r"(?i),|;|\band\b|\bcomplicated by\b|\bwhere\b"), lambda f: _without_lead(_bare(f)))
        return F.flatten(F.transform(F.concat(F.filter(parts, fits), whole(problem)), named))

    return F.slice(dedupe(F.flatten(F.transform(F.transform(F.coalesce(problems, F.array().cast("array<string>")), _bare), of_problem))), 1, most)


def anchor_score(text: Column) -> Column:
    """What an anchor counts: 3, 2 and 1.5 for words of disease, treatment and complication, .5 for 2 to 10 words, -.5 above 16."""
    lowered, words = F.lower(text), token_count(text)
    total = F.when(words.between(2, 10), 0.5).when(words > 16, -0.5).otherwise(0.0)
    for points, listed in RAISING:
        total = total + F.when(F.greatest(*[F.contains(lowered, F.lit(w)) for w in listed]), points).otherwise(0.0)
    return total


def case_summary(problems: Column, most: int = 5) -> Column:
    """'primary problem: ' and the best anchors of a case in their order, joined by '; '; '' without any."""
    scored = F.transform(problem_anchors(problems, 24), lambda t: F.struct(t.alias("text"), anchor_score(t).alias("score")))
    picked = pick_anchors(scored, max(most, 1))
    return F.when(F.size(picked) > 0, F.concat(F.lit("primary problem: "), F.array_join(picked, "; "))).otherwise("")


def first_filled(sources: dict[str, Column]) -> tuple[Column, Column]:
    """(value, name) of the first source, in order, whose text isn't blank; nulls without any."""
    filled = {name: normalize_whitespace(c.cast("string")) for name, c in sources.items()}
    value = F.coalesce(*[F.nullif(c, F.lit("")) for c in filled.values()])
    return value, F.coalesce(*[F.when(c != "", F.lit(name)) for name, c in filled.items()])


def problem_list(seed: Column, inputs: Column, text: Column, most: int = 8) -> Column:
    """Up to ``most`` problems of a case: those given, else its filled inputs as 'name: value', else the parts of its text.

    A text is parted at line ends, if it has any, else at full stops, else at
    semicolons; without a part left in it, its first 240 characters are the one problem. ``inputs`` is a
    map of texts; blank and 'false' ones don't count. Nothing at all gives an empty array.
    """
    none = F.array().cast("array<string>")
    given = F.filter(F.transform(F.coalesce(seed, none), lambda p: F.trim(F.coalesce(p, F.lit("")))), lambda p: p != "")
    kept = F.map_filter(F.coalesce(inputs, F.create_map().cast("map<string,string>")), lambda _, v: ~F.lower(F.trim(F.coalesce(v, F.lit("")))).isin("", "false"))
    named = F.transform(F.map_entries(kept), lambda e: F.concat(F.replace(e["key"], F.lit("_"), F.lit(" ")), F.lit(": "), e["value"]))
    bare = F.trim(F.coalesce(text, F.lit("")))
    parts = lambda at: F.filter(F.transform(F.split(bare, at), lambda p: F.regexp_replace(p, "^[ -]+|[ -]+$", "")), lambda p: p != "")
    listed = [F.when(F.contains(bare, F.lit(sign)) & (F.size(parts(at)) > 0), parts(at)) for sign, at in (("\n", "\n"), (".", r"\."), (";", ";"))]
    told = F.coalesce(*listed, F.when(bare != "", F.array(F.substring(bare, 1, 240))), none)
    return F.slice(F.when(F.size(given) > 0, given).when(F.size(named) > 0, named).otherwise(told), 1, most)


def readiness(n_inputs: Column, n_intervals: Column, n_problems: Column, n_hints: Column) -> Column:
    """'ready' with an interval or four inputs, 'partial' with two inputs, problems or hints, else 'insufficient'; nulls count as 0."""
    n_inputs, n_intervals, n_problems, n_hints = (F.coalesce(c, F.lit(0)) for c in (n_inputs, n_intervals, n_problems, n_hints))
    return F.when((n_intervals >= 1) | (n_inputs >= 4), "ready").when((n_inputs >= 2) | (n_problems >= 2) | (n_hints >= 2), "partial").otherwise("insufficient")


def query_set(df: DataFrame, key: str, summary: Column, problems: Column, hints: Column, most_problems: int = 16, most_hints: int = 8) -> DataFrame:
    """(key, priority, stage, intent, text) of a case's search queries: its summary, its problems, its hints, in that order.

    Problems come without their openings, from two words or if they are listed, each
    once. A text that stands earlier in the set, in any case, is left out;
    priorities count what is kept. Null lists count as empty.
    """
    none = F.array().cast("array<string>")
    single = lambda t: F.lower(t).isin(*SINGLE)
    bare = F.transform(F.coalesce(problems, none), lambda p: _without_lead(_bare(p)))
    kept = F.slice(dedupe(F.filter(bare, lambda t: (token_count(t) >= 2) | single(t))), 1, most_problems)
    hinted = F.slice(F.filter(F.transform(F.coalesce(hints, none), lambda h: F.trim(F.coalesce(h, F.lit("")))), lambda h: h != ""), 1, most_hints)
    entry = lambda stage, intent, text: F.struct(stage.alias("stage"), F.lit(intent).alias("intent"), text.alias("text"))
    numbered = lambda array, stage, intent: F.transform(array, lambda t, i: entry(F.concat(F.lit(stage), (i + 1).cast("string")), intent, t))
    head = F.filter(F.array(F.trim(F.coalesce(summary, F.lit("")))), lambda t: t != "")
    listed = F.concat(F.transform(head, lambda t: entry(F.lit("case_summary_dense"), "case_summary_dense", t)), numbered(kept, "problem_anchor_", "problem_anchor"), numbered(hinted, "risk_hint_", "risk_hint_seed"))
    rows = df.select(key, F.posexplode(listed).alias("at", "q")).select(key, "at", "q.*")
    first = rows.groupBy(key, F.lower(normalize_whitespace(F.col("text"))).alias("__t")).agg(F.min(F.struct("at", "stage", "intent", "text")).alias("q"))
    # A case has some 25 queries at most.
    order = F.row_number().over(Window.partitionBy(key).orderBy("q.at"))
    return first.select(key, order.alias("priority"), "q.stage", "q.intent", "q.text")


def pick_anchors(scored: Column, most: int = 5) -> Column:
    """Up to ``most`` texts of an array of (text, score), best first, none that holds or is held by one picked before; in their first order.

    Ties go to the earlier one.
    """
    numbered = F.transform(scored, lambda s, i: F.struct((-s["score"]).alias("o"), i.alias("i"), s["text"].alias("text")))
    none = F.array().cast("array<struct<o:double,i:int,text:string>>")

    def add(taken: Column, s: Column) -> Column:
        within = F.exists(taken, lambda t: F.contains(F.lower(t["text"]), F.lower(s["text"])) | F.contains(F.lower(s["text"]), F.lower(t["text"])))
        return F.when((F.size(taken) < most) & ~within, F.concat(taken, F.array(s))).otherwise(taken)

    picked = F.aggregate(F.array_sort(numbered), none, add)
    return F.transform(F.array_sort(F.transform(picked, lambda t: F.struct(t["i"].alias("i"), t["text"].alias("text")))), lambda t: t["text"])


def interval_bounds(df: DataFrame, group: list[str], lower: str, upper: str, bands: tuple[tuple[str, float], ...] = (("high", 0.75), ("moderate", 0.4))) -> DataFrame:
    """(group, n, mean_lower, mean_upper, band) of intervals, swapped ones put right, a missing bound taken from the other.

    The band is the first whose limit the middle reaches, else ``low``.
    Intervals without bounds don't count; NaN is no bound.
    """
    clean = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    a, b = F.coalesce(clean(lower), clean(upper)), F.coalesce(clean(upper), clean(lower))
    rows = df.select(*group, F.least(a, b).alias("__a"), F.greatest(a, b).alias("__b")).where(F.col("__a").isNotNull())
    means = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg("__a").alias("mean_lower"), F.avg("__b").alias("mean_upper"))
    band = F.lit("low")
    for name, limit in reversed(bands):
        band = F.when((F.col("mean_lower") + F.col("mean_upper")) / 2 >= limit, name).otherwise(band)
    return means.withColumn("band", band)


def counterfactual(current: Column, target: Column, base: Column, rate: float = 0.1) -> tuple[Column, Column]:
    """(change, risk after it): a tenth of the way from current to target, not below 0; nulls count as 0."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    change = F.greatest((zero(current) - zero(target)) * rate, F.lit(0.0))
    return change, F.greatest(zero(base) - change, F.lit(0.0))


def first_seen(df: DataFrame, group: list[str], value: str, order: str, item: str) -> DataFrame:
    """(group, value as first written, first, n) of values that differ only in case, in order of appearance."""
    rows = df.where(F.trim(F.coalesce(value, F.lit(""))) != "").withColumn("__key", F.lower(normalize_whitespace(F.col(value))))
    return rows.groupBy(*group, "__key").agg(F.min_by(value, order).alias(value), F.min(order).alias("first"), F.count(item).alias("n")).drop("__key")


def lookup(df: DataFrame, key: str, dimension: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Rows with the columns of a dimension by a key compared without case and outer blanks; defaults where there is none.

    The dimension needs one row per key.
    """
    flat = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    side = dimension.select(flat(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in defaults])
    wide = df.withColumn("__key", flat(key)).join(side, "__key", "left").drop("__key")
    return wide.select(*df.columns, *[F.coalesce(F.col(f"__{c}"), F.lit(v)).alias(c) for c, v in defaults.items()])


def select_best(df: DataFrame, group: list[str], order: list[Column], item: str) -> DataFrame:
    """One row per group, the largest in ``order``, ties to the smaller item; by partial aggregation."""
    rank = F.struct(*[(-o.cast("double")).alias(f"o{i}") for i, o in enumerate(order)], F.col(item).alias("item"))
    rest = [c for c in df.columns if c not in group]
    best = df.groupBy(*group).agg(F.min_by(F.struct(*rest), rank).alias("b"))
    return best.select(*group, *[F.col("b")[c].alias(c) for c in rest])


def contained(terms: Column, pool: Column) -> Column:
    """The terms that hold, or are held by, any text of a pool, without regard to case; empty texts never match."""
    either = lambda t, p: (F.lower(p) != "") & (F.lower(t) != "") & (F.contains(F.lower(p), F.lower(t)) | F.contains(F.lower(t), F.lower(p)))
    return F.filter(terms, lambda t: F.exists(pool, lambda p: F.coalesce(either(t, p), F.lit(False))))


def variants(df: DataFrame, term: str, synonyms: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows for each term and each of its synonyms, as ``variant``, once each."""
    known = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k.lower()), F.array(*[F.lit(s) for s in v]))])
    own = F.coalesce(F.try_element_at(known, F.lower(term)), F.array().cast("array<string>"))
    return df.select("*", F.explode(dedupe(F.concat(F.array(term), own))).alias("variant"))


def fragments(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fragment_no, fragment, start_offset, end_offset) of the sentences of a text with blanks collapsed.

    Offsets count in that text. Null and blank texts have no rows.
    """
    end = re.compile(r"(?<=[.!?。！？;；])\s+|(?<=[。！？；])")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch["__text"], strict=True):
                at = number = 0
                for m in [*end.finditer(t), None]:
                    stop = m.start() if m else len(t)
                    if stop > at:
                        rows.append((k, number, t[at:stop], at, stop))
                        number += 1
                    at = m.end() if m else stop
            yield pd.DataFrame(rows, columns=[key, "fragment_no", "fragment", "start_offset", "end_offset"])

    narrow = df.select(key, normalize_whitespace(F.col(text)).alias("__text")).where(F.col("__text") != "")
    return narrow.mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, fragment_no int, fragment string, start_offset int, end_offset int")
