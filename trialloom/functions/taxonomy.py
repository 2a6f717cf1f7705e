"""Request texts classified by four dictionaries, with rules for ages and specialties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialloom.functions.lexicon import labels
from trialloom.functions.text import normalize_whitespace

# Labels and their keywords, stems among them.
DOMAINS = {
    "cardiology": ("cardiology", "cardiac", "heart", "atrial", "ventric", "coronary", "myocard", "stemi", "nstemi"),
    "pulmonology": ("pulmonology", "pulmonary", "pneumonia", "copd", "asthma", "respiratory", "lung", "hypoxem"),
    "oncology": ("oncology", "cancer", "tumor", "carcinoma", "lymphoma", "leukemia", "glioma", "metasta"),
    "neurology": ("neurology", "stroke", "brain", "neuro", "seizure", "dementia", "parkinson", "head injury"),
    "gastroenterology_hepatology": ("gastroenterology", "hepatology", "liver", "hepatic", "cirrhosis", "pancrea", "colon", "rectal", "gastric", "bowel"),
    "nephrology_urology": ("nephrology", "renal", "kidney", "urology", "urinary", "bladder", "prostate"),
    "infectious_disease": ("infectious disease", "infection", "infectious", "sepsis", "bacter", "viral", "fung", "covid"),
    "hematology": ("hematology", "anemia", "coagul", "thromb", "hemoph", "stem cell", "transplant"),
    "surgery_perioperative": ("surgery", "surgical", "operative", "postoperative", "perioperative", "resection", "arthroplasty"),
    "emergency_critical_care": ("emergency", "triage", "icu", "critical care", "intensive care", "shock", "ventilation"),
    "obstetrics_gynecology": ("pregnan", "obstetric", "gynecology", "maternal", "preeclampsia", "ovarian"),
    "endocrinology_metabolic": ("diabetes", "glucose", "endocrinology", "thyroid", "metabolic", "obesity"),
    "rheumatology_immunology": ("rheumatology", "lupus", "autoimmune", "arthritis", "inflammatory", "vasculitis"),
}
SEGMENTS = {
    "pediatric": ("pediatric", "children", "adolescent", "infant", "young girls"),
    "neonatal": ("neonate", "neonatal", "newborn", "birth weight"),
    "older_adult": ("elderly", "older adult", "older adults", "geriatric", "aged 65", "age >= 65", "70 years"),
    "pregnancy": ("pregnan", "maternal", "postpartum", "women who have recently given birth"),
    "critical_care": ("icu", "critical care", "intensive care", "shock", "ventilation", "ecmo", "critically ill"),
    "emergency_care": ("emergency department", "presenting with", "presented with", "urgent", "triage"),
    "surgical_candidate": ("surgery", "surgical", "operative", "postoperative", "resection", "arthroplasty", "esophagectomy"),
    "oncology_patient": ("cancer", "oncology", "tumor", "carcinoma", "lymphoma", "leukemia", "glioma"),
    "transplant_patient": ("transplant", "stem cell transplant", "allo-hct", "auto-sct", "hct", "lvad"),
}
BUCKETS = {
    "admission_triage": ("triage", "admission", "icu", "level of care", "disposition", "hospitalized", "hospitalisation"),
    "screening_diagnosis": ("diagnos", "diagnostic", "screen", "detect", "differentiat", "ct", "mri", "imaging", "biopsy"),
    "treatment_selection": ("therapy", "treatment", "management", "protocol", "chemotherapy", "radiotherapy", "immunotherapy", "benefit"),
    "perioperative_management": ("surgery", "surgical", "perioperative", "operative", "postoperative", "resection", "arthroplasty"),
    "monitoring_followup": ("follow-up", "monitor", "readmission", "toxicity", "complication", "flare", "adverse", "failure"),
    "prognosis_counseling": ("prognosis", "survival", "mortality", "outcome", "recurrence", "progression-free"),
}
FAMILIES = {
    "severity_score": ("severity", "triage", "icu", "admission", "disposition", "critical"),
    "diagnostic_rule": ("diagnos", "diagnostic", "screen", "detect", "differentiat", "ct", "mri", "imaging", "rule"),
    "treatment_selection": ("therapy", "treatment", "management", "protocol", "benefit", "surgery", "chemotherapy", "radiotherapy"),
    "prognostic_model": ("prognosis", "survival", "mortality", "outcome", "recurrence", "progression-free"),
    "complication_risk": ("complication", "toxicity", "bleeding", "infection", "readmission", "failure", "adverse"),
    "risk_score": ("risk", "probability", "likelihood", "predict"),
}
# What a specialty says about patients, and the bucket that a family stands for where none is found.
SPECIALTIES = (
    ("pediatrics", "pediatric"), ("neonatology", "neonatal"), ("geriatrics", "older_adult"), ("emergency medicine", "emergency_care"), ("critical care", "critical_care"), ("intensive care", "critical_care"),
    ("anesthesiology", "critical_care"), ("surgery", "surgical_candidate"), ("oncology", "oncology_patient"),
)
FAMILY_BUCKETS = (("severity_score", "admission_triage"), ("diagnostic_rule", "screening_diagnosis"), ("treatment_selection", "treatment_selection"), ("complication_risk", "monitoring_followup"), ("prognostic_model", "prognosis_counseling"))
AGE = r"\b(\d{1,3})\s*[- ]?year[- ]old\b"


def classify(text: Column, specialty: Column) -> dict[str, Column]:
    """Four arrays of labels: clinical_domains, patient_segments, protocol_buckets, calculator_families.

    The first age stated adds neonatal below 1, pediatric below 18 and older_adult
    from 65. No family means risk_score; no bucket the one of the first family
    that has one. Nulls count as blank.
    """
    special = F.lower(normalize_whitespace(specialty))
    full = F.lower(F.concat_ws(" ", F.trim(F.coalesce(text, F.lit(""))), F.trim(F.coalesce(specialty, F.lit("")))))
    age = F.nullif(F.regexp_extract(full, AGE, 1), F.lit("")).try_cast("int")
    by_age = F.when(age < 1, "neonatal").when(age < 18, "pediatric").when(age >= 65, "older_adult")
    added = F.array_compact(F.array(*[F.when(F.contains(special, F.lit(word)), F.lit(label)) for word, label in SPECIALTIES], by_age))
    families = labels(full, FAMILIES, "risk_score")
    buckets = labels(full, BUCKETS)
    stand_in = F.coalesce(*[F.when(F.array_contains(families, f), F.lit(b)) for f, b in FAMILY_BUCKETS])
    return {
        "clinical_domains": labels(full, DOMAINS), "patient_segments": F.array_distinct(F.concat(labels(full, SEGMENTS), added)),
        "protocol_buckets": F.when(F.size(buckets) == 0, F.array_compact(F.array(stand_in))).otherwise(buckets), "calculator_families": families,
    }


# How channels of queries are told by stage and intent, in order.
CHANNELS = (
    ("case_summary", ("case_summary_dense",), ("case_summary_",)), ("problem_anchor", ("problem_anchor",), ("problem_anchor_",)), ("risk_hint", ("risk_hint_seed",), ("risk_seed_", "risk_hint_")),
)
OTHER_CHANNELS = (("case_summary", "clinical_question", "coarse_question"), ("calculator_category", "calculator_classification", None), ("protocol_mapping", "protocol_matching", None))


def query_channel(stage: Column, intent: Column) -> Column:
    """The channel that a query's stage and intent belong to, ``general`` if none."""
    stage, intent = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (stage, intent))
    out = F.lit("general")
    for channel, own, at in reversed(OTHER_CHANNELS):
        out = F.when((intent == own) | (stage == at if at else F.lit(False)), channel).otherwise(out)
    for channel, own, starts in reversed(CHANNELS):
        begins = F.lit(False)
        for s in starts:
            begins |= stage.startswith(s)
        exact = stage == "risk_hint" if channel == "risk_hint" else stage == "case_summary_dense" if channel == "case_summary" else F.lit(False)
        out = F.when(intent.isin(*own) | begins | exact, channel).otherwise(out)
    return out
