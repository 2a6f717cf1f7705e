"""Texts matched against small lexicons: labels by keyword, terms with their polarity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.text import normalize_whitespace

# Cues that negate what follows or precedes within 80 characters, and what ends their reach.
NEGATION_CUES = ("no", "not", "without", "denies", "deny", "negative for", "absence of", "free of", "does not have", "doesn't have", "is not", "was not", "not currently", "not prescribed")
SCOPE_BREAKS = ("but", "however", "although", "though", "whereas", "while", "continued", "continues", "presented", "presents")
SCOPE = 80
# What makes a clause a question, which negates nothing.
QUESTIONS = ("what is", "estimated", "estimate", "patient-years", "based on these factors", "stroke rate")


def keyword_pattern(keyword: str) -> str:
    """A keyword as a pattern: words parted by blanks, slashes or dashes; one of more than 4 letters as a stem."""
    parts = [re.escape(p) for p in re.split(r"[\s/_-]+", keyword.strip().lower()) if p]
    if len(parts) > 1:
        return r"\b" + r"[\s/_-]+".join(parts) + r"\b"
    return rf"\b{parts[0]}\b" if len(parts[0]) <= 4 else rf"\b{parts[0]}[a-z0-9]*\b"


def labels(text: Column, mapping: dict[str, tuple[str, ...]], default: str | None = None) -> Column:
    """The labels with any keyword in a text, in the mapping's order; the default if there is none."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.array(*[F.when(lowered.rlike("|".join(keyword_pattern(k) for k in words)), F.lit(label)) for label, words in mapping.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found) if default else found


def _polarity(clause: Column, term: str) -> Column:
    """'negative', 'positive' or null for a term in a clause."""
    cue = r"\b(?:" + "|".join(re.escape(c) for c in NEGATION_CUES) + r")\b"
    reach = rf"(?:(?!\b(?:{'|'.join(SCOPE_BREAKS)})\b)[^,;:()\[\]]){{0,{SCOPE}}}?"
    term = rf"(?:{term})"
    asked = clause.rlike(rf"(?i)\b(?:{'|'.join(QUESTIONS)})\b")
    negated = ~asked & (clause.rlike(rf"(?i){cue}{reach}{term}") | clause.rlike(rf"(?i){term}{reach}{cue}"))
    return F.when(clause.rlike(rf"(?i){term}"), F.when(negated, "negative").otherwise("positive"))


def term_flags(df: DataFrame, key: str, text: str, terms: dict[str, str]) -> DataFrame:
    """(key, term, positive, negative) of every lexicon term a text refers to.

    ``terms`` maps a name to a pattern. Clauses end at . ; , and line ends; a
    clause is negative if a cue stands within 80 characters of the term with no
    break between, unless it is worded like a question. Null and blank texts have no rows.
    """
    clauses = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"[.;\n,]+"), normalize_whitespace), lambda c: c != "")
    # Only clauses that hold a term are looked at further.
    any_term = "(?i)" + "|".join(f"(?:{p})" for p in terms.values())
    rows = df.select(key, F.explode(F.filter(clauses, lambda c: c.rlike(any_term))).alias("clause"))
    found = F.array(*[F.struct(F.lit(n).alias("term"), _polarity(F.col("clause"), p).alias("polarity")) for n, p in terms.items()])
    rows = rows.select(key, F.explode(F.filter(found, lambda f: f["polarity"].isNotNull())).alias("f"))
    return rows.groupBy(key, "f.term").agg(F.bool_or(F.col("f.polarity") == "positive").alias("positive"), F.bool_or(F.col("f.polarity") == "negative").alias("negative"))


def alias_concepts(df: DataFrame, key: str, text: str, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, concept, alias) of every concept named in a text, by its first alias in list order."""
    hit = lambda a: F.col(text).rlike(rf"(?i)(^|[^A-Za-z0-9]){re.escape(a)}($|[^A-Za-z0-9])")
    found = F.array(*[F.struct(F.lit(c).alias("concept"), F.coalesce(*[F.when(hit(a), F.lit(a)) for a in listed]).alias("alias")) for c, listed in aliases.items()])
    return df.select(key, F.explode(F.filter(found, lambda f: f["alias"].isNotNull())).alias("f")).select(key, "f.concept", "f.alias")


def age_sex(text: Column) -> tuple[Column, Column]:
    """(age in years, 'female' or 'male') that a text states, null without."""
    pattern = r"(?i)\b(\d{1,3})\s*[- ]?\s*years?[- ]old\b|(\d{1,3})\s*岁"
    age = F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) for i in (1, 2)]).try_cast("int")
    lowered = F.lower(text)
    sex = F.when(lowered.rlike(r"\b(female|woman|girl)\b|女"), "female").when(lowered.rlike(r"\b(male|man|boy)\b|男"), "male")
    return F.when((age > 0) & (age < 130), age), sex


def overlap_score(wanted: dict[str, list[str]], weights: dict[str, float]) -> Column:
    """The weighted number of labels that columns of labels share with the wanted ones."""
    total = F.lit(0.0)
    for column, values in wanted.items():
        shared = F.array_intersect(F.coalesce(F.col(column), F.array().cast("array<string>")), F.array(*[F.lit(v) for v in values]).cast("array<string>"))
        total = total + F.size(shared) * float(weights.get(column, 1.0))
    return total
