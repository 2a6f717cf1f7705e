"""Texts that ranking channels search: labelled lines of the filled fields of a calculator or a trial."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialloom.functions.text import dedupe, first_sentence, normalize_whitespace

# What families and protocol buckets are called in these texts; others by their name with blanks.
FAMILY_LABELS = {
    "severity_score": "severity stratification", "diagnostic_rule": "diagnostic rule", "treatment_selection": "treatment selection", "prognostic_model": "prognosis estimation", "complication_risk": "complication risk",
    "risk_score": "risk prediction",
}
FOCUS_LABELS = {
    "admission_triage": "admission triage", "screening_diagnosis": "screening and diagnosis", "treatment_selection": "treatment selection", "perioperative_management": "perioperative management",
    "monitoring_followup": "monitoring and follow-up", "prognosis_counseling": "prognosis counseling",
}
#: Parameters named in a calculator's text, at most.
INPUTS = 12


def _line(label: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(f"{label}: "), text))


def _list(label: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, ", ")))


def _named(values: Column, labels: dict[str, str] | None = None) -> Column:
    known = F.create_map(*[x for k, v in (labels or {"": ""}).items() for x in (F.lit(k), F.lit(v))])
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(F.try_element_at(known, v), F.replace(v, F.lit("_"), F.lit(" "))))


def calculator_text(fields: dict[str, Column], taxonomy: dict[str, Column], parameters: Column) -> Column:
    """Lines of a calculator: title, first sentences of its fields, its labels and its first parameters; missing fields have no line."""
    at = lambda name: fields.get(name, F.lit(None).cast("string"))
    decision = F.coalesce(F.nullif(first_sentence(at("interpretation")), F.lit("")), first_sentence(at("utility")))
    return F.concat_ws(
        "\n", _line("title", normalize_whitespace(at("title"))), _line("primary task", first_sentence(at("purpose"))), _line("eligible population", first_sentence(at("eligibility"))), _line("specialty", normalize_whitespace(at("specialty"))),
        _list("clinical domain", _named(taxonomy["clinical_domains"])), _list("patient segment", _named(taxonomy["patient_segments"])), _list("calculator family", _named(taxonomy["calculator_families"], FAMILY_LABELS)),
        _list("protocol focus", _named(taxonomy["protocol_buckets"], FOCUS_LABELS)), _list("inputs", F.slice(F.coalesce(parameters, F.array().cast("array<string>")), 1, INPUTS)), _line("decision focus", decision),
        _line("evidence summary", first_sentence(at("abstract"))),
    )


def trial_text(fields: dict[str, Column], lists: dict[str, Column]) -> Column:
    """Lines of a trial record: title, lists without repeats, study profile, summary and eligibility text; states of workflows are left out."""
    at = lambda name: normalize_whitespace(fields.get(name, F.lit(None).cast("string")))
    listed = lambda label, name: _list(label, dedupe(lists[name], ignore_case=False)) if name in lists else F.lit(None).cast("string")
    profile = F.concat_ws("; ", *[F.nullif(at(c), F.lit("")) for c in ("study_type", "phase", "primary_purpose")])
    return F.concat_ws(
        "\n", _line("title", at("title")), listed("conditions", "conditions"), listed("mesh terms", "mesh_terms"), listed("keywords", "keywords"), listed("interventions", "interventions"),
        _line("study profile", profile), _line("summary", at("brief_summary")), _line("eligibility", at("eligibility_text")),
    )
