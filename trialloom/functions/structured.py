"""Nested inputs, signatures and query texts out of structured cases."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trialloom.functions.text import dedupe, normalize_whitespace


# Names of parameters and the phrases they go by, in order; a blank stands for blanks or dashes, or nothing.
PARAMETERS = (
    ("age", ("age",)), ("sex", ("male", "female", "sex", "gender")), ("non_white_ethnicity", ("non white ethnicity",)), ("ethnicity", ("ethnicity",)),
    ("oxygen_saturation", ("oxygen saturation", "oxygen saturations", "spo2")), ("radiological_severity_score", ("radiological severity score",)),
    ("neutrophil_count", ("neutrophil count",)), ("crp", ("c reactive protein", "crp")), ("albumin", ("albumin",)), ("creatinine", ("creatinine",)),
    ("diabetes", ("diabetes",)), ("hypertension", ("hypertension", "htn")), ("chronic_lung_disease", ("chronic lung disease",)), ("ferritin", ("ferritin",)),
    ("ldh", ("lactate dehydrogenase", "ldh")), ("rapidly_progressive_ild", ("rapidly progressive ild", "rpild")), ("serum_sodium", ("serum sodium",)),
    ("performance_status", ("performance status",)), ("ph_positive", ("philadelphia chromosome", "ph positive")), ("morphology", ("french american british morphology",)),
    ("courses_to_cr", ("courses to achieve complete response", "courses to complete response", "courses to cr")), ("marrow_blasts", ("bone marrow blast", "bone marrow blasts", "marrow blast", "marrow blasts")),
    ("cardiothoracic_ratio", ("cardiothoracic ratio",)), ("sdnn", ("sdnn",)), ("corrected_qt_interval", ("maximum corrected qt interval", "qtc")), ("qrs_dispersion", ("qrs dispersion",)),
    ("non_sustained_ventricular_tachycardia", ("non sustained ventricular tachycardia",)), ("left_ventricular_hypertrophy", ("left ventricular hypertrophy",)),
)
# Names that say nothing.
LOW_SIGNAL = ("score", "risk", "risk_score", "result", "output", "value", "parameter", "input")
_KNOWN = tuple((name, re.compile("|".join(r"\b" + p.replace(" ", r"[-\s]*") + r"\b" for p in phrases), re.I)) for name, phrases in PARAMETERS)


def identifier(text: str) -> str:
    """Lower case, everything but letters and digits as one '_', none at the ends."""
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")


def canonical_parameter(text: str) -> str:
    """The parameter a phrase names: a known one, else its words; what stands behind a colon, a comparison or points is left out."""
    head = re.split(r"[:<>=≥≤]|\bassign(?:ed)?\b|\bpoints?\b", " ".join((text or "").split()).replace("μ", "u").replace("µ", "u"), maxsplit=1, flags=re.I)[0]
    head = re.sub(r"^(?:the patient'?s|the|an?)\s+", "", re.sub(r"\([^)]*\)", " ", head).strip(), flags=re.I)
    return next((name for name, pattern in _KNOWN if pattern.search(head)), identifier(head))


def says_little(name: str) -> bool:
    """A name that is one letter, a numbered placeholder, a number, or a general word."""
    return not name or name in LOW_SIGNAL or bool(re.fullmatch(r"[a-z]\d*|(?:arg|var|value|feature|input|score)_?\d+|\d+(?:_\d+)*", name))


def flatten_value(value: object, prefix: str = "") -> Iterator[str]:
    """'a.b[1]: v' for every filled leaf of nested objects and lists.

    Lists count from 1, items of a list at the top are ``item[1]`` and so on;
    blanks in a value are collapsed.
    """
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from flatten_value(inner, f"{prefix}.{key}" if prefix else str(key))
    elif isinstance(value, list):
        for i, inner in enumerate(value, 1):
            yield from flatten_value(inner, f"{prefix or 'item'}[{i}]")
    elif value is not None and (text := " ".join(str(value).split())):
        yield f"{prefix}: {text}" if prefix else text


def _leaves(text: str | None) -> list[str]:
    try:
        return list(flatten_value(json.loads(text))) if text else []
    except ValueError:
        return []


def flatten_json(text: Column) -> Column:
    """The leaves of JSON texts; null, blank and broken ones give an empty array."""
    return F.pandas_udf(_leaves_of_all, "array<string>")(text)


def _leaves_of_all(texts: pd.Series) -> pd.Series:
    return texts.map(_leaves)


def signature(code: str | None) -> list[str]:
    """The parameter names of the first function in Python source; parsed, never run."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError):
        return []
    first = next((n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)), None)
    return [a.arg for a in [*first.args.posonlyargs, *first.args.args, *first.args.kwonlyargs] if a.arg not in ("self", "cls")] if first else []


_LISTED = re.compile(r"^\s*(?:[-*•]|\d+\.)\s*(.+)$", re.M)
_INTRODUCED = re.compile(r"\b(?:parameters?|variables?|inputs?|factors?|predictors?|components?)\b(?:\s+(?:are|is|include|includes|including|used))*\s*:?\s+([^.\n]+)", re.I)
_PARTED = re.compile(r",(?![^()]*\))|\band/or\b|\s+and\s+", re.I)
_PRODUCT = re.compile(r"-?\d+(?:\.\d+)?\s*[x*×]\s*(?:(?:log|ln|sqrt)\s*\(\s*([^,)]+)|([^+\-\n)]+))", re.I)


def prose_parameters(text: str | None) -> list[str]:
    """The parameters that prose names: behind words like "parameters include", as items of a list, and as factors of a formula."""
    text = text or ""
    found: list[str] = []
    for m in _INTRODUCED.finditer(text):
        found += [canonical_parameter(p) for p in _PARTED.split(m.group(1))]
    found += [canonical_parameter(item) for item in _LISTED.findall(text)]
    for line in text.splitlines():
        if "=" in line:
            found += [canonical_parameter(a or b) for a, b in _PRODUCT.findall(line.partition("=")[2])]
    return list(dict.fromkeys(n for n in found if not says_little(n)))


def all_parameters(code: str | None, prose: str | None) -> list[str]:
    """A signature's names, then those that only prose gives; prose first where half of the signature says little and prose names as many."""
    own = list(dict.fromkeys(identifier(n) for n in signature(code)))
    told = prose_parameters(prose)
    vague = sum(map(says_little, own))
    swap = own and told and len(told) >= len(own) and vague >= max(1, len(own) // 2)
    return list(dict.fromkeys([*told, *own] if swap else [*own, *told]))


def _signatures(codes: pd.Series) -> pd.Series:
    return codes.map(signature)


def _all_parameters(codes: pd.Series, prose: pd.Series) -> pd.Series:
    return pd.Series([all_parameters(c, p) for c, p in zip(codes, prose, strict=True)])


def parameter_names(code: Column, prose: Column | None = None) -> Column:
    """``signature`` of every text, or with ``prose`` the names of both."""
    return F.pandas_udf(_signatures, "array<string>")(code) if prose is None else F.pandas_udf(_all_parameters, "array<string>")(code, prose)


def declared_only(inputs: Column, declared: Column) -> Column:
    """The entries of a map whose keys are declared and whose values are filled."""
    return F.map_filter(inputs, lambda k, v: F.array_contains(declared, k) & (F.trim(F.coalesce(v, F.lit(""))) != ""))


def query_text(raw: Column, summary: Column, problems: Column, facts: Column, max_raw: int = 1200) -> Column:
    """A case as a search text: the raw text, or its summary if that is too long, then problems and facts once each."""
    flat = normalize_whitespace(raw)
    short = normalize_whitespace(summary)
    head = F.when((F.length(flat) > max_raw) & (short != ""), short).otherwise(flat)
    return F.array_join(dedupe(F.concat(F.array(head), F.coalesce(problems, F.array().cast("array<string>")), F.coalesce(facts, F.array().cast("array<string>")))), "\n")
