"""Subject areas of documents, by a multi-pattern automaton over curated weighted terms."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.session import materialize

TERMS_FILE = Path(__file__).with_name("subject_terms.txt")
#: Cues of a passing mention (an exclusion, a relative's illness, a contrast): what shares a sentence with one isn't what the
#: text is about. Written like terms, "*" for any letters.
PASSING = (
    "unlike", "in contrast to", "as opposed to", "rather than in", "family history", "relative", "relatives", "mother", "father", "sibling*", "cannot take part", "may not take part", "not eligible", "ineligible", "are excluded", "is excluded",
    "anders als", "im gegensatz zu", "familienanamnese", "in der familie", "verwandte*", "angehorige*", "ausgeschlossen", "nicht teilnehmen",
    "a diferencia de", "en contraste con", "antecedentes familiares", "familiar", "familiares", "pariente*", "se excluye*", "excluid*", "no pueden participar",
    "contrairement a", "a la difference de", "antecedents familiaux", "parent", "parents", "exclu", "exclus", "exclue*", "ne peuvent participer", "ne peuvent pas participer", "ne peut participer",
    "亲属", "家族史", "不得参加", "不能参加", "排除", "不同于", "与之不同",
)
#: Labelled documents the thresholds are fitted on, at most.
LABEL_SAMPLE = 20_000
#: Terms and cues with at least so many letters are also found with two neighbouring letters of a word swapped.
SWAP_FROM = 6


@dataclass(frozen=True)
class Thresholds:
    """What an area needs of a text: a share of its weighted mentions, another one if it is mentioned once only, and mentions per 100 words."""

    share: float = 0.05
    share_single: float = 0.08
    density: float = 0.1


_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*>")
_WRAPPED = re.compile(r"(?<=[^\W\d_])[-­][ \t]*\r?\n\s*(?=[^\W\d_])")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_SPACE = re.compile(r"\s+")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_WIDE = re.compile("[⺀-\U0003ffff]")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*|\r[^\S\n]*\r\s*")
_STOP = re.compile(r"[.!?;](?=\s|$)|[。！？；¶]")


def fold(text: str) -> str:
    """Lower case without accents, in compatibility form, blanks collapsed."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).replace("’", "'")
    return _SPACE.sub(" ", text.casefold())


def clean(text: str) -> str:
    """``fold`` after markup, invisible characters and hyphens at line ends are gone; "¶" where a paragraph ends."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return fold(_PARAGRAPH.sub(" ¶ ", _INVISIBLE.sub("", _WRAPPED.sub("", text)).replace("\r\n", "\n")))


@dataclass(frozen=True)
class Term:
    subject: str
    weight: float
    text: str
    open_left: bool
    open_right: bool


def _wide(text: str) -> bool:
    return bool(_WIDE.search(text))


def parse_term(raw: str, subject: str = "", weight: float = 0.0) -> Term:
    """A term as written, "*" at an end for any letters there; words of scripts without blanks may stand anywhere."""
    text = fold(raw.strip())
    bare = text.strip("*")
    return Term(subject, weight, bare, text.startswith("*") or _wide(bare), text.endswith("*") or _wide(bare))


def read_terms(path: Path = TERMS_FILE) -> list[Term]:
    """The curated terms: lines of ``subject | weight | term; term; ...``; of a repeated term the first counts."""
    terms: dict[tuple[str, bool, bool], Term] = {}
    for line in path.read_text(encoding="utf-8").splitlines():
        if line.strip() and not line.startswith("#"):
            subject, weight, listed = (x.strip() for x in line.split("|", 2))
            for raw in filter(str.strip, listed.split(";")):
                term = parse_term(raw, subject, float(weight))
                terms.setdefault((term.text, term.open_left, term.open_right), term)
    return list(terms.values())


class Matcher:
    """The automaton over all terms, their spellings and the passing cues."""

    def __init__(self, terms: tuple[Term, ...]):
        self.terms = terms
        self.automaton = ahocorasick.Automaton()
        # Spelling -> readings (term, open at the left, open at the right); -1 is a cue. Listed spellings come before variants.
        spelled: dict[str, list[tuple[int, bool, bool]]] = {}
        listed = [*enumerate(terms), *((-1, parse_term(cue)) for cue in PASSING)]
        for variants in (False, True):
            for i, term in listed:
                for text in self._spellings(term.text)[1:] if variants else [term.text]:
                    if not variants or text not in spelled:
                        spelled.setdefault(text, []).append((i, term.open_left, term.open_right))
        for text, readings in spelled.items():
            self.automaton.add_word(text, (len(text), readings))
        self.automaton.make_automaton()

    @staticmethod
    def _spellings(text: str) -> list[str]:
        out = [text]
        if "-" in text and len(text) > 8:
            out += [text.replace("-", " "), text.replace("-", "")]
        if not _wide(text):
            for word in re.finditer(r"[^\W\d_]{2,}", text) if len(text) >= SWAP_FROM else ():
                a, b = word.span()
                out += [text[:k] + text[k + 1] + text[k] + text[k + 2 :] for k in range(a, b - 1) if text[k] != text[k + 1]]
        return out

    def mentions(self, text: str) -> tuple[int, dict[int, int]]:
        """Number of words, and for each term the number of mentions, passing ones left out.

        Of overlapping mentions the longest counts.
        """
        flat = clean(text)
        found, cues = [], []
        for end, (size, readings) in self.automaton.iter(flat):
            start = end - size + 1
            left = start == 0 or not flat[start - 1].isalnum()
            right = end + 1 == len(flat) or not flat[end + 1].isalnum() or (flat[end + 1] == "s" and not flat[end + 2 : end + 3].isalnum())
            for term, open_left, open_right in readings:
                if (left or open_left) and (right or open_right):
                    if term < 0:
                        cues.append(start)
                    else:
                        found.append((start, -end, term))
                    break
        words = max(1, flat.count(" ") + 1, 0 if flat.isascii() else len(_WIDE.findall(flat)) // 2)
        if not found:
            return words, {}
        passing = set()
        if cues:
            stops = [m.start() for m in _STOP.finditer(flat)]
            passing = {bisect_right(stops, c) for c in cues}
        found.sort()
        last = -1
        counted: Counter[int] = Counter()
        for start, end, term in found:
            if start <= last:
                continue
            last = -end
            if not passing or bisect_right(stops, start) not in passing:
                counted[term] += 1
        return words, dict(counted)


@lru_cache(maxsize=2)
def matcher(terms: tuple[Term, ...]) -> Matcher:
    """One automaton per worker process."""
    return Matcher(terms)


def match_terms(df: DataFrame, key: str, text: str, terms: list[Term]) -> DataFrame:
    """(key, n_words, mentions) of every text with at least one mention; mentions: array of (term, n)."""
    listed = tuple(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = matcher(listed).mentions
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch["__text"], strict=True):
                words, found = find(t)
                if found:
                    rows.append((k, words, [{"term": a, "n": b} for a, b in sorted(found.items())]))
            yield pd.DataFrame(rows, columns=[key, "n_words", "mentions"])

    narrow = df.select(key, F.col(text).alias("__text")).where(F.col(text).rlike(r"[\p{L}]"))
    return narrow.mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_words int, mentions array<struct<term:int,n:int>>")


def subject_scores(df: DataFrame, key: str, text: str, terms: list[Term] | None = None) -> DataFrame:
    """(key, subject_code, n_mentions, share, density) of every area mentioned in a text.

    A mention counts its term's weight times its rarity, the logarithm of all
    texts with mentions over those with this term; ``share`` is an area's part
    of a text's sum, ``density`` its mentions per 100 words. One pass over the
    texts; the term counts, one number a term, are all the driver gets.
    """
    terms = terms or read_terms()
    found = materialize(match_terms(df, key, text, terms))
    total = found.count()
    counted = found.select(F.explode("mentions.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    frequency = {r.term: r.n for r in counted.collect()}  # at most one row per curated term
    rarity = [t.weight * math.log(1 + total / frequency.get(i, 1)) if total else 0.0 for i, t in enumerate(terms)]
    subjects = sorted({t.subject for t in terms})
    # Literals of the whole term list as SQL text: building them element by element takes seconds.
    weight = F.expr(f"array({', '.join(f'{r!r}D' for r in rarity)})")
    area = F.expr(f"array({', '.join(str(subjects.index(t.subject)) for t in terms)})")
    weighted = F.transform("mentions", lambda m: F.struct(F.get(area, m["term"]).alias("area"), m["n"].alias("n"), (F.get(weight, m["term"]) * m["n"]).alias("w")))
    added = lambda rows, name: F.aggregate(rows, F.lit(0.0), lambda acc, m: acc + m[name])

    def of_area(i: Column) -> Column:
        own = F.filter("weighted", lambda m: m["area"] == i)
        return F.struct(F.get(F.lit(subjects), i).alias("subject_code"), added(own, "n").alias("n"), added(own, "w").alias("w"))

    rows = found.select(key, "n_words", weighted.alias("weighted"))
    per_area = F.transform(F.array_distinct(F.transform("weighted", lambda m: m["area"])), of_area)
    rows = rows.select(key, "n_words", added(F.col("weighted"), "w").alias("__all"), F.explode(per_area).alias("a"))
    return rows.select(key, "a.subject_code", F.col("a.n").cast("int").alias("n_mentions"), (F.col("a.w") / F.col("__all")).alias("share"), (F.col("a.n") * 100 / F.col("n_words")).alias("density"))


def above(scores: DataFrame, thresholds: Thresholds) -> DataFrame:
    """The rows of ``subject_scores`` that reach the thresholds."""
    share = F.when(F.col("n_mentions") > 1, thresholds.share).otherwise(thresholds.share_single)
    return scores.where((F.col("share") >= share) & (F.col("density") >= thresholds.density))


def assign_subjects(df: DataFrame, key: str, text: str, terms: list[Term] | None = None, labels: DataFrame | None = None, thresholds: Thresholds | None = None) -> DataFrame:
    """(key, subject_code, share) of every area a fair share of the text is about.

    Mentions in sentences that name something in passing (an exclusion, a
    relative's illness, a contrast) don't count. ``thresholds`` are calibrated on
    ``labels`` (key, subject_code) unless they are given; without either the
    defaults hold. Null, empty and blank texts and texts without any term have no
    row. Keys should be unique; rows with equal keys are judged each by itself.
    Columns not named are dropped.
    """
    scores = subject_scores(df, key, text, terms)
    if thresholds is None:
        thresholds = calibrate(scores, labels, key) if labels is not None else Thresholds()
    return above(scores, thresholds).select(key, "subject_code", "share")


def calibrate(scores: DataFrame, labels: DataFrame, key: str, sample: int = LABEL_SAMPLE, prior: Thresholds = Thresholds()) -> Thresholds:  # noqa: B008
    """The thresholds that fit hand-set labels.

    Of all thresholds of a grid whose F1 lies within one standard error of the
    best, those nearest to ``prior`` (by ratio): a few labels, some of them wrong,
    move nothing without evidence. ``labels`` has ``key`` and ``subject_code``; at
    most ``sample`` labelled documents are used, those with the smallest hash of
    their key. No labels give ``prior``.
    """
    chosen = labels.where(F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(sample)
    truth = labels.join(chosen, key, "left_semi").select(key, "subject_code", F.lit(1).alias("truth")).distinct()
    rows = scores.join(chosen, key, "left_semi").join(truth, [key, "subject_code"], "full")
    rows = rows.select(F.coalesce("n_mentions", F.lit(0)).alias("n"), F.coalesce("share", F.lit(0.0)).alias("s"), F.coalesce("density", F.lit(0.0)).alias("d"), F.coalesce("truth", F.lit(0)).alias("t")).toPandas()
    n, share, density, true = (rows[c].to_numpy() for c in ("n", "s", "d", "t"))
    wanted = int(true.sum())
    if not wanted:
        return prior
    fits = []
    for d in sorted({0.0, 0.05, 0.2, 0.4, prior.density}):
        dense = (density >= d) & (n > 0)
        for_many, for_single = ({a: dense & kind & (share >= a) for a in sorted({*(x / 50 for x in range(1, 49)), known})} for kind, known in ((n > 1, prior.share), (n == 1, prior.share_single)))
        many = {a: (int(m.sum()), int(true[m].sum())) for a, m in for_many.items()}
        single = {a: (int(m.sum()), int(true[m].sum())) for a, m in for_single.items()}
        fits += [(2 * (mt + st) / (m + s + wanted), a, b, d) for a, (m, mt) in many.items() for b, (s, st) in single.items()]
    best = max(f for f, *_ in fits)
    within = best - math.sqrt(best * (1 - best) / wanted)
    ratio = lambda x, y: math.log((x + 0.01) / (y + 0.01)) ** 2
    near = min((ratio(a, prior.share) + ratio(b, prior.share_single) + ratio(d, prior.density), a, b, d) for f, a, b, d in fits if f >= within)
    return Thresholds(*near[1:])
