import datetime as dt
import io
import json
import random
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from trialloom.functions import lexicon, retrieval_text, rules, sections, structured, taxonomy
from trialloom.functions import text as T
from trialloom.operators import cases, evaluation, fusion, nested, positions, ranking, relational, units
from trialloom.plans import knowledge_base as kb
from trialloom.plans.stages import stage
from trialloom.queries.problems import ALIASES, STUDY
from trialloom.sources import archives, files
from trialloom.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# Text -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: T.normalize_whitespace(F.lit(" a　 b\t\nc ")), "a b c"),
        (lambda: T.normalize_whitespace(F.lit(None).cast("string")), ""),
        (lambda: T.normalize_block(F.lit("a\n b \n\n\n c\r\nd\n")), "a b\n\nc\n\nd"),
        (lambda: T.dedupe(F.array(F.lit("A b"), F.lit(" a  B"), F.lit(None), F.lit(""), F.lit("c"))), ["A b", "c"]),
        (lambda: T.dedupe(F.lit(None).cast("array<string>")), []),
        (lambda: T.tokenize(F.lit("EGFR_19 突变,x")), ["egfr", "19", "突", "变", "突变", "x"]),
        (lambda: F.size(T.tokenize(F.lit("一二三四五六七"))), 7 + 6 + 5 + 4 + 3 + 2 + 1),
        (lambda: T.token_count(F.lit("two words 两字")), 4),
        (lambda: T.first_sentence(F.lit("One. Two.")), "One."),
        (lambda: T.first_sentence(F.lit("x" * 300), 20), "x" * 17 + "..."),
        (lambda: T.token_estimate(F.lit("")), 1),
        (lambda: T.pack(F.array(F.lit("aaa"), F.lit("bb"), F.lit("c" * 20), F.lit("d")), 8), ["aaa\n\nbb", "c" * 20, "d"]),
        (lambda: T.pack(F.array().cast("array<string>"), 8), []),
        (lambda: T.age_years(F.lit("6 Months")), 0.5),
        (lambda: T.age_years(F.lit("N/A")), None),
        (lambda: T.parse_partial_date(F.lit("March 2021")), dt.date(2021, 3, 1)),
        (lambda: T.parse_partial_date(F.lit("April 06, 2020")), dt.date(2020, 4, 6)),
        (lambda: T.lenient_json(F.lit('x ```json\n{"a": 1}\n``` y')), '{"a": 1}'),
        (lambda: T.lenient_json(F.lit("none")), None),
        (lambda: T.choice(F.lit("b"), F.array(F.lit("A"), F.lit("B"))), "B"),
        (lambda: T.choice(F.lit("Computed score is 6. Therefore the best matching option is E.\nAnswer: E"), F.split(F.lit("ABCDE"), "")), "E"),
        (lambda: T.choice(F.lit("The estimated stroke rate is 8.5 per 100 patient-years."), F.split(F.lit("ABCDE"), "")), None),
        (lambda: T.choice(F.lit("Selected option: b; not option C"), F.split(F.lit("ABC"), "")), "B"),
        (lambda: T.choice(F.lit("Answer: Z, or choice C"), F.split(F.lit("ABC"), "")), "C"),
        (lambda: T.sanitize_question(F.lit("A man of 65.\nWhat is the rate?\n\nChoices:\nA. 1.9\n\nPlease compute the answer using the appropriate calculator.")), "A man of 65. What is the rate?"),
        (lambda: T.sanitize_question(F.lit("Please compute the answer using the appropriate calculator now.\nRate?\nEnd your final answer with the format: Answer: <LETTER>.")), "Rate?"),
        (lambda: T.sanitize_question(F.lit("A. one\nB. two")), "A. one B. two"),
        (lambda: T.sanitize_question(F.lit(None).cast("string")), ""),
        (lambda: T.choice(F.lit("The answer is forty"), F.array(F.lit("A"), F.lit("F"))), None),
        (lambda: T.split_criteria(F.lit("- a one\n  more\n- b two\n\nc")), ["a one more", "b two", "c"]),
        (lambda: T.split_criteria(F.lit("age over 18; no other drug; can walk far")), ["age over 18", "no other drug", "can walk far"]),
        (lambda: T.negated_clauses(F.lit("No fever. Has cough; denies pain")), ["No fever.", "denies pain"]),
        (lambda: T.uuid5(F.lit("python.org"), "6ba7b810-9dad-11d1-80b4-00c04fd430c8"), "886313e1-3b8a-5372-9b90-0c9aee199e5d"),
        (lambda: T.alignment(F.lit("heart failure trial"), F.lit("chronic heart failures")), pytest.approx(3.5 / 6)),
        (lambda: T.alignment(F.lit(""), F.lit("x")), 0.0),
        (lambda: T.to_number(F.lit("about -3.5 kg")), -3.5),
        (lambda: T.to_bool(F.lit("absent")), False),
    ],
)
def test_text_functions(spark, column, want):
    assert one(spark, column()) == want


# Taxonomy and search texts --------------------------------------------------------------------


def test_taxonomy_rules(spark):
    def of(text, specialty=None):
        found = taxonomy.classify(F.lit(text).cast("string"), F.lit(specialty).cast("string"))
        row = spark.range(1).select(*[v.alias(k) for k, v in found.items()]).first()
        return [list(row[k]) for k in ("clinical_domains", "patient_segments", "protocol_buckets", "calculator_families")]

    assert of(None) == [[], [], [], ["risk_score"]]
    assert of("A 0 year-old and a 70-year-old") == [[], ["neonatal"], [], ["risk_score"]]
    assert of("Severity of sepsis in an 80-year-old") == [["infectious_disease"], ["older_adult"], ["admission_triage"], ["severity_score"]]
    assert of("chance", "Pediatrics and General Surgery") == [["surgery_perioperative"], ["pediatric", "surgical_candidate"], ["perioperative_management"], ["treatment_selection"]]
    assert of("Bleeding; stem-cell  transplant")[1:3] == [["transplant_patient"], ["monitoring_followup"]]


def test_query_channels(spark):
    of = lambda stage, intent: one(spark, taxonomy.query_channel(F.lit(stage).cast("string"), F.lit(intent).cast("string")))
    assert [of(*x) for x in (("case_summary_x", ""), (None, "case_summary_dense"), ("problem_anchor_1", "odd"), ("risk_hint", ""), ("risk_seed_2", None), ("x", "clinical_question"), ("Coarse_Question", ""), ("", "calculator_classification"), ("", "protocol_matching"), (None, None))] == [
        "case_summary", "case_summary", "problem_anchor", "risk_hint", "risk_hint", "case_summary", "case_summary", "calculator_category", "protocol_mapping", "general",
    ]


def test_metrics_of_cases(frame):
    cases = frame([("a", ["t1", "t9"], ["Gout "], None), ("b", None, ["gout"], "boom"), ("c", ["t1"], None, None)], "k string, must array<string>, conditions array<string>, error string").selectExpr("*", "array('t2') acceptable", "cast(null as array<string>) interventions")
    candidates = frame([("a", "t1", 3, "acute GOUT", True), ("a", "t2", 11, "gout", None), ("a", "t9", 15, None, False), ("c", "t2", 1, "x", None)], "k string, t string, rank int, text string, is_open boolean")
    criteria = frame([("a", "t1", "met", 0), ("a", "t1", " Unknown", 0), ("a", "t2", "unknown", None), ("c", "t2", None, None)], "k string, t string, label string, questions int")
    metrics = evaluation.case_metrics(cases, candidates, criteria, "k", "t")
    out = {r.k: r for r in metrics.collect()}
    a = out["a"]
    assert (a.n_candidates, a.must_hits_10, a.must_hits_20, a.recall_10, a.recall_20, a.acceptable_hits_10, a.condition_matches_10, a.open_10, a.n_met, a.n_unknown) == (3, 1, 2, 0.5, 1.0, 0, 1, 1, 1, 2)
    assert a.failure_buckets == ["too_many_unknowns", "missing_questions_empty_despite_unknowns"]
    assert out["b"].failure_buckets == ["protocol_exception", "no_candidates"] and out["b"].recall_10 is None
    assert out["c"].failure_buckets == ["must_retrieve_miss", "no_recruiting_trials_top10", "criteria_parse_empty"]
    total = {r["item"]: r.value for r in evaluation.summary(metrics, ["n_candidates", "recall_20"]).collect()}
    assert total["case_count"] == 3 and total["failed_case_count"] == 1 and total["mean_n_candidates"] == pytest.approx(4 / 3) and total["mean_recall_20"] == pytest.approx(1 / 3) and total["bucket_no_candidates"] == 1
    empty = {r["item"]: r.value for r in evaluation.summary(metrics.limit(0), ["recall_20"]).collect()}
    assert empty == {"case_count": 0.0, "failed_case_count": 0.0, "completed_case_count": 0.0, "mean_recall_20": 0.0}


def test_search_texts_of_nothing(spark):
    none = F.lit(None).cast("array<string>")
    labels = dict.fromkeys(("clinical_domains", "patient_segments", "protocol_buckets", "calculator_families"), none)
    assert one(spark, retrieval_text.calculator_text({}, labels, none)) == "" and one(spark, retrieval_text.trial_text({}, {})) == ""
    text = one(spark, retrieval_text.calculator_text({"title": F.lit(" A  b "), "utility": F.lit("Use. It.")}, labels | {"calculator_families": F.array(F.lit("risk_score"), F.lit("x_y"))}, F.array(*[F.lit(str(i)) for i in range(20)])))
    assert text == "title: A b\ncalculator family: risk prediction, x y\ninputs: " + ", ".join(map(str, range(12))) + "\ndecision focus: Use."


# Positions ------------------------------------------------------------------------------------


def test_sums_before_match_a_running_sum(frame):
    random.seed(2)
    rows = [(k, p, random.randrange(-5, 50)) for k in ("a", "b", None) for p in random.sample(range(200), 120)]
    got = positions.sums_before(frame(rows, "k string, p long, v long"), ["k"], "p", "v", "s", block=16).collect()
    assert {(r.k, r.p, r.v): r.s for r in got} == {(k, p, v): sum(w for j, q, w in rows if j == k and q < p) for k, p, v in rows}
    assert positions.sums_before(frame([], "k string, p long, v long"), ["k"], "p", "v", "s").count() == 0


# Units ----------------------------------------------------------------------------------------

UNITS = [
    units.Unit("glucose", "mmol_per_l", True, 1.0, 0.0, 2.2, 28.0), units.Unit("glucose", "mg_per_dl", False, 0.0555, 0.0, 40.0, 500.0),
    units.Unit("hemoglobin", "g_per_l", True, 1.0, 0.0, 60.0, 190.0), units.Unit("hemoglobin", "g_per_dl", False, 10.0, 0.0, 6.0, 19.0),
    units.Unit("platelet_count", "giga_per_l", True, 1.0, 0.0, 15.0, 800.0), units.Unit("platelet_count", "per_ul", False, 0.001, 0.0, 15000.0, 800000.0),
    units.Unit("platelet_count", "thousand_per_ul", False, 1.0, 0.0, 15.0, 800.0), units.Unit("body_height", "cm", True, 1.0, 0.0, 140.0, 205.0),
    units.Unit("body_height", "m", False, 100.0, 0.0, 1.4, 2.05), units.Unit("body_height", "inch", False, 2.54, 0.0, 55.0, 81.0),
    units.Unit("symptom_duration", "day", True, 1.0, 0.0, 1.0, 900.0), units.Unit("symptom_duration", "month", False, 30.4375, 0.0, 1.0, 30.0),
    units.Unit("body_temperature", "celsius", True, 1.0, 0.0, 34.5, 41.0), units.Unit("body_temperature", "fahrenheit", False, 0.555556, -17.777778, 94.0, 106.0),
]


@pytest.fixture(scope="module")
def book():
    return units.UnitBook(UNITS, ALIASES)


@pytest.mark.parametrize(
    ("concept", "text", "code"),
    [
        ("glucose", "mg / dl", "mg_per_dl"), ("glucose", "mg%", "mg_per_dl"), ("glucose", "mM", "mmol_per_l"), ("glucose", "MMOL/L", "mmol_per_l"), ("glucose", "mg dL⁻¹", "mg_per_dl"),
        ("hemoglobin", "G/L", "g_per_l"), ("hemoglobin", "g per 100 mL", "g_per_dl"), ("hemoglobin", "g%", "g_per_dl"), ("platelet_count", "G/L", "giga_per_l"), ("platelet_count", "×10⁹/L", "giga_per_l"),
        ("platelet_count", "x10³/µL", "thousand_per_ul"), ("platelet_count", "K/uL", "thousand_per_ul"), ("platelet_count", "/mm3", "per_ul"), ("platelet_count", "cells/uL", "per_ul"),
        ("body_height", "m", "m"), ("symptom_duration", "mo", "month"), ("body_height", '"', "inch"), ("body_temperature", "℉", "fahrenheit"), ("glucose", "see text", None), ("glucose", "kg", None), ("glucose", "", None),
    ],
)
def test_unit_strings(book, concept, text, code):
    found = book.read(concept, units.normal_unit(text))[0]
    assert (found.code if found else None) == code


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (("glucose", "131", "see text", "measured blood sugar of 131 mg/dL. Given 500 mL saline before.", ""), (131.0, "mg_per_dl")),
        (("glucose", None, None, "glucose 8,4 mM (aged 12 years)", ""), (8.4, "mmol_per_l")),
        (("glucose", "276", "?", "glucose: 276", ""), (276.0, "mg_per_dl")),
        ((None, "", "", "The first 63 people were enrolled in 30 weeks. Hb = 13.2", ""), (13.2, "g_per_dl")),
        ((None, "37", None, None, "structured_inputs.body_temperature"), (37.0, "celsius")),
        (("platelet_count", "400,149", "cells/uL", None, None), (400149.0, "per_ul")),
        (("body_height", "~1.307e+02", "cm", None, None), (130.7, "cm")),
        (("glucose", "pending", "mg/dL", "glucose: to follow", ""), None),
        (("heart failure", "5", "mg/dL", "glucose 5", ""), None),
        ((None, None, None, None, None), None),
    ],
)
def test_quantities(book, row, want):
    found = units.measured(book, *row)
    assert (found and (pytest.approx(found[1]), found[2].code)) == want


@pytest.mark.parametrize("gap", [1, 20, 45, 200, 5000])
def test_units_and_numbers_are_read_however_far_they_stand(book, gap):
    filler = ("as noted by the ward " * (gap // 21 + 1))[:gap].rstrip()
    assert units.measured(book, "glucose", None, None, f"glucose {filler} 131 mg/dL", "")[1:] == (131.0, book.units["glucose"][1])
    assert units.measured(book, "glucose", "131", "see text", f"glucose was 131 mg{' ' * gap}/{' ' * gap}dL", "")[2].code == "mg_per_dl"
    assert units.bounded(book, "platelet_count", 20.0, 30.0, None, f"{filler} of the lab all given in thousand per uL")[3].code == "thousand_per_ul"


@pytest.mark.parametrize(
    ("text", "signature"),
    [
        ("m^3", ((("volume", 1),), 1000.0)), ("mm^3", ((("volume", 1),), 1e-6)), ("cm3", ((("volume", 1),), 1e-3)), ("dm³", ((("volume", 1),), 1.0)), ("kg/m2", ((("length", -2), ("mass", 1)), 1000.0)),
        ("mIU/L", ((("activity", 1), ("volume", -1)), 1e-3)), ("mEq/L", ((("charge", 1), ("volume", -1)), 1e-3)), ("kcal", ((("energy", 1),), 4184.0)), ("kelvin", ((("kelvin", 1),), 1.0)),
        ("mL/min", ((("time", -1), ("volume", 1)), 1.44)), ("seconds", ((("time", 1),), 1 / 86_400)), ("g m^-3", ((("mass", 1), ("volume", -1)), 1e-3)), ("kPa", ((("pressure", 1),), 1000.0)),
    ],
)
def test_decompositions_of_units_outside_the_given_tables(text, signature):
    best = units.decompositions(units.normal_unit(text))[0][1]
    assert best[0] == signature[0] and best[1] == pytest.approx(signature[1], rel=1e-4)


def test_the_prior_of_a_field_weighs_readings_and_lets_clear_others_win(book):
    assert book.read("body_height", "m")[0].code == "m" and book.read("symptom_duration", "mo")[0].code == "month"
    assert book.read("body_height", "mmHg")[0] is None and book.read("glucose", "kilograms")[0] is None


def test_units_of_a_table(frame):
    rows = [(1, "glucose", None, 100.0, "-", "range in mg/dl per case note"), (2, "body_height", 1.5, 1.8, None, "lab sheet, all values in m"), (3, "body_height", None, None, "cm", ""), (4, "body_height", float("nan"), 60.0, None, "calculator input (in)"), (None, "unknown", 1.0, 2.0, None, None)]
    df = frame(rows, "k long, c string, a double, b double, u string, concept string")
    out = units.to_common_units(df, "k", UNITS, ALIASES, F.col("c"), F.col("u"), F.col("concept"), lower=F.col("a"), upper=F.col("b")).collect()
    assert {(r.k, r.unit_code) for r in out} == {(1, "mg_per_dl"), (2, "m"), (4, "inch")}
    assert {r.k: r.upper_common for r in out}[4] == pytest.approx(152.4)
    empty = units.to_common_units(df.limit(0), "k", UNITS, ALIASES, F.col("c"), F.col("u"), F.col("concept"), lower=F.col("a"), upper=F.col("b"))
    assert empty.count() == 0


# Nested records -------------------------------------------------------------------------------


def _walk(root):
    out, count = [], {}
    by_parent = {}
    for k in STUDY.kinds:
        by_parent.setdefault(k.parent, []).append(k)

    def holds(e):
        return bool(e.attrib) or len(e) > 0 or bool((e.text or "").strip())

    def down(element, base, parent, number):
        for k in by_parent.get(parent, []):
            for e in element.findall("/".join(k.path[len(base) :])):
                if holds(e):
                    count[k.kind] = count.get(k.kind, 0) + 1
                    out.append((k.kind, number, count[k.kind]))
                    down(e, k.path, k.kind, count[k.kind])

    down(root, (), None, 0)
    return sorted(out)


CHILDREN = {
    "clinical_study": ["condition", "intervention", "location", "clinical_results"], "intervention": ["arm_group_label", "other_name"], "location": ["investigator"], "clinical_results": ["outcome_list"],
    "outcome_list": ["outcome"], "outcome": ["measure"], "measure": ["class_list"], "class_list": ["class"], "class": ["category_list"], "category_list": ["category"], "category": ["measurement_list"], "measurement_list": ["measurement"],
}


def _random_record(tag="clinical_study"):
    e = ET.Element(tag)
    for k in CHILDREN.get(tag, []):
        for _ in range(random.choice([0, 1, 1, 2, 3])):
            e.append(_random_record(k))
    if tag not in CHILDREN and random.random() < 0.6:
        e.text = " x "
    if random.random() < 0.1:
        e.set("a", "b")
    return e


def test_shredding_and_assembly_match_a_walk():
    random.seed(23)
    for _ in range(300):
        record = _random_record()
        assert sorted(r[:3] for r in nested.flatten(record, STUDY)) == _walk(record)


def test_flat_tables_of_odd_bytes(frame):
    good = "<clinical_study><id_info><nct_id>NCT1</nct_id></id_info><condition> é </condition><condition/><!-- x --></clinical_study>"
    rows = [(1, good.encode("utf-16"), 0), (2, b"\xef\xbb\xbf" + good.encode(), 0), (3, b"", 0), (4, None, 0), (5, b"<clinical_study>", 0), (6, b"<html/>", 0), (None, b'<?xml version="1.0" encoding="ISO-8859-1"?>' + good.encode("latin-1"), 0)]
    out = nested.flat_tables(frame(rows, "k long, x binary, child_no int"), "k", "x", STUDY, ("id_info", "nct_id")).collect()
    assert sorted((r.k or 0, r.record_id, r.child_kind, r.child_no, r.child_text) for r in out) == [(k, "NCT1", "condition", 1, "é") for k in (0, 1, 2)]


# Positions, ranking, fusion -------------------------------------------------------------------


def test_group_positions_match_brute_force(frame):
    random.seed(29)
    rows = [(random.choice(["hot"] * 6 + ["a", None]), i) for i in range(500)]
    out = positions.group_positions(frame(rows, "g string, i int", 6), ["g"], [F.desc("i")]).collect()
    want = {}
    for g, i in sorted(rows, key=lambda r: -r[1]):
        want[i] = want.setdefault(("n", g), 0) + 1
        want["n", g] = want[i]
    assert {r.i: r.position for r in out} == {k: v for k, v in want.items() if isinstance(k, int)}


def test_bm25_keeps_global_statistics_for_candidates(frame):
    docs = frame([("a", "heart failure heart"), ("b", "heart"), ("c", None), ("d", "kidney"), (None, "heart")], "id string, t string")
    queries = frame([(1, "heart heart failure"), (2, None), (3, "zzz")], "q long, t string")
    every = {r.id: r.score for r in ranking.bm25(docs, "id", {"t": 1.0, "id": -1.0}, queries, "q", "t").collect()}
    some = {r.id: r.score for r in ranking.bm25(docs, "id", {"t": 1.0}, queries, "q", "t", candidates=frame([("b",)], "id string")).collect()}
    assert set(every) == {"a", "b"} and every["a"] > every["b"] and some == {"b": every["b"]}


def test_dense_top_k_of_a_subset_and_odd_rows(frame):
    rows = [(4, [1.0, 0.0]), (5, [0.5, 0.5]), (6, [0.0, 1.0]), (7, None), (8, [1.0]), (None, [9.0, 9.0])]
    base = frame(rows, "id long, v array<double>")
    asked = frame([(1, [0.6, 0.4]), (2, None)], "q long, v array<float>")
    out = ranking.dense_top_k(base, "id", "v", asked, "q", "v", 2).orderBy("rank").collect()
    assert [(r.q, r.id, round(r.score, 6)) for r in out] == [(1, 4, 0.6), (1, 5, 0.5)]
    assert ranking.dense_top_k(base, "id", "v", asked.limit(0), "q", "v", 2).count() == 0


CHANNEL = "c string, channel string, i string, score double"


def test_fusion_rules(frame):
    rows = frame([("x", "bm25", "a", 4.0), ("x", "bm25", "b", 2.0), ("x", "dense", "a", 0.5), ("y", "bm25", "a", 0.0), (None, "bm25", "a", 3.0)], CHANNEL)
    weighted = {(r.c, r.i): r.score for r in fusion.fuse(rows, ["c"], "i", ["bm25", "dense"], {"bm25": 0.5, "dense": 0.5}).collect()}
    assert weighted == {("x", "a"): 1.0, ("x", "b"): 0.0, ("y", "a"): 0.0, (None, "a"): 1.0}
    structured_ = {(r.c, r.i): r.score for r in fusion.fuse(rows, ["c"], "i", ["bm25", "dense"], mode="structured").collect()}
    assert structured_["x", "a"] == 6.0 and structured_["x", "b"] == 2.0
    clean = {(r.c, r.i): r.score for r in fusion.fuse(rows, ["c"], "i", ["bm25", "dense"], mode="structured", compat=False).collect()}
    assert clean["x", "a"] == 2.0


def test_hybrid_union_takes_halves_in_order(frame):
    rows = [("x", ch, f"{ch}{n}" if n != 2 else "both", n) for ch in ("bm25", "dense") for n in range(1, 8)]
    out = fusion.hybrid_union(frame(rows, "c string, channel string, i string, rank int"), ["c"], "i", ["bm25", "dense"], 6).orderBy("place").collect()
    assert [(r.i, r.source_channels) for r in out] == [("bm251", "bm25"), ("both", "bm25,dense"), ("bm253", "bm25"), ("dense1", "dense"), ("dense3", "dense")]


# Relational -----------------------------------------------------------------------------------


def test_latest_wins_with_nulls_and_ties(frame):
    rows = [("a", 1, "x"), ("a", None, "y"), ("a", 2, "z"), (None, 1, "n"), (None, 3, "m")]
    out = {r.k: (r.v, r.n_duplicates) for r in relational.latest_wins(frame(rows, "k string, o int, v string"), ["k"], [F.col("o")]).collect()}
    assert out == {"a": ("z", 2), None: ("m", 1)}


def test_candidate_filter_and_its_empty_sets(frame):
    df, none = frame([(1,), (2,)], "k long"), frame([], "k long")
    assert relational.candidate_filter(df, "k", None).count() == 2
    assert relational.candidate_filter(df, "k", none).count() == 0
    assert relational.candidate_filter(df, "k", none, empty="all").count() == 2


def test_scope_falls_back(frame):
    df, scopes = frame([(1,), (2,)], "k long"), frame([(1, "a"), (9, "b")], "k long, s string")
    assert [(r.k, r.fell_back) for r in relational.scoped(df, "k", scopes, "s", ["a"]).collect()] == [(1, False)]
    assert {(r.k, r.fell_back) for r in relational.scoped(df, "k", scopes, "s", ["b"]).collect()} == {(1, True), (2, True)}


def test_of_repeated_incoming_rows_the_last_in_order_counts(frame):
    rows = [(1, "b", 2), (1, "a", 2), (1, "z", 1), (2, "x", None), (3, "y", 0)]
    stored = frame([(3, "old", 9)], "k int, v string, o int")
    for parts in (1, 3, 5):
        new = frame(rows, "k int, v string, o int", parts)
        assert sorted(map(tuple, relational.upsert(new, stored, "k", [F.col("o")]).collect())) == [(1, "b", 2), (2, "x", None), (3, "y", 0)]
        assert sorted(map(tuple, relational.missing_rows(new, stored, "k", [F.col("o")]).collect())) == [(1, "b", 2), (2, "x", None)]


def test_upsert_twice_is_once(frame):
    stored, new = frame([(1, "old"), (2, "old")], "k long, v string"), frame([(2, "new"), (3, "new")], "k long, v string")
    once = relational.upsert(new, stored, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, relational.upsert(new, once, "k").collect())) == [(1, "old"), (2, "new"), (3, "new")]


def test_recall_without_relevant_items_is_null(frame):
    ranked = frame([("x", "a", 1), ("x", "b", 2), ("y", "a", 1)], "c string, i string, rank int")
    out = {r.c: (r.hits_1, r.recall_1) for r in relational.recall_at(ranked, frame([("x", "b"), ("x", "a"), ("z", "q")], "c string, i string"), "c", "i", [1]).collect()}
    assert out == {"x": (1, 0.5), "y": (0, None), "z": (0, 0.0)}


# Sections, lexicons, rules --------------------------------------------------------------------


def test_sections_in_any_order():
    text = "Exclusion Criteria:\n\nNone known\n\nKey Inclusion Criteria\n\n- Age over 18. Noninclusion is no heading"
    assert [(k, h, b) for k, h, b, _, _ in sections.sections_of(text)] == [("exclusion", "Exclusion Criteria", "None known"), ("inclusion", "Key Inclusion Criteria", "Age over 18. Noninclusion is no heading")]
    assert sections.sections_of("no headings here") == []


def test_term_polarity(frame):
    rows = [(1, "No history of diabetes. Has hypertension"), (2, "denies pain, diabetes known"), (3, None), (4, "diabetes but no insulin")]
    out = {(r.k, r.term): (r.positive, r.negative) for r in lexicon.term_flags(frame(rows, "k long, t string"), "k", "t", {"diabetes": "diabetes", "insulin": "insulin", "hypertension": "hypertension"}).collect()}
    assert out == {(1, "diabetes"): (False, True), (1, "hypertension"): (True, False), (2, "diabetes"): (True, False), (4, "diabetes"): (True, False), (4, "insulin"): (False, True)}


def test_score_rules(frame):
    compiled = rules.parse_rules("Each item is assigned 1 point if present:\n1. Age 65 years or older\n2. Male sex\n3. SBP < 90 mmHg (2 points)\n")
    assert [(r.parameter, r.operator, r.value, r.points) for r in compiled] == [("age", ">=", 65.0, 1.0), ("sex", None, None, 1.0), ("sbp", "<", 90.0, 2.0)]
    assert rules.parse_rules("- Age over 5") is None and rules.parse_rules("") is None
    df = frame([("70", "yes", 85), (None, "no", None)], "age string, sex string, sbp int")
    got = df.select(rules.score(compiled, {"age": F.col("age"), "sex": F.col("sex"), "sbp": F.col("sbp")}).alias("s")).collect()
    assert sorted(r.s for r in got) == [0.0, 4.0]


def test_rules_of_a_score_of_twelve_factors(spark):
    """The published form of a deterioration score: every form of criterion, shared points."""
    prose = """Each factor is assigned 1 point if present:
1. Age ≥40 years
2. Male sex
3. Non-white ethnicity
4. Oxygen saturations <93%
5. Radiological severity score >3
6. Neutrophil count > 8.0 x 10^9/L
7. CRP at least 40 mg/L
8. Albumin less than or equal to 34 g/L
9. Creatinine 100 or more
10. Diabetes mellitus
11. Hypertension
12. Chronic lung disease"""
    compiled = rules.parse_rules(prose)
    assert [r.parameter for r in compiled] == ["age", "sex", "non_white_ethnicity", "oxygen_saturation", "radiological_severity_score", "neutrophil_count", "crp", "albumin", "creatinine", "diabetes", "hypertension", "chronic_lung_disease"]
    given = {"age": 45, "sex": "male", "non_white_ethnicity": True, "oxygen_saturation": 92, "radiological_severity_score": 4, "neutrophil_count": 7.5, "crp": 45, "albumin": 33, "creatinine": 105, "diabetes": True, "hypertension": False, "chronic_lung_disease": True}
    assert one(spark, rules.score(compiled, {k: F.lit(v) for k, v in given.items()})) == 10.0
    assert one(spark, rules.score(compiled, {})) == 0.0


@pytest.mark.parametrize(
    ("value", "want"), [(0.0, False), (0, False), (2.5, True), ("0.0", True), ("0", False), ("absent", False), (" ", False), (True, True), (False, False), (None, False), ("severe", True)]
)
def test_truth_of_values(spark, value, want):
    assert one(spark, rules.truth(F.lit(value).cast("double") if isinstance(value, float) else F.lit(value))) is want


def test_rules_of_sex_and_ethnicity(spark):
    assert [one(spark, rules.male_like(F.lit(x))) for x in ("Male", "boy", "F", "woman", "yes", "", None)] == [True, True, False, False, True, False, False]
    assert [one(spark, rules.non_white_like(F.lit(x))) for x in ("White", "caucasian ", "unknown", "Asian", "", None)] == [False, False, False, True, False, False]


def test_parameters_of_prose():
    told = "Inputs are serum sodium, the patient's age and/or CRP (mg/L, fasting).\n- Female: 2 points\nScore = 0.3 x albumin + 2.1 * ln(creatinine, base)"
    assert structured.prose_parameters(told) == ["serum_sodium", "age", "crp", "sex", "albumin", "creatinine"]
    assert structured.all_parameters("def f(x1, x2): pass", "- age\n- sodium level") == ["age", "sodium_level", "x1", "x2"]
    assert structured.all_parameters("def f(age, ph): pass", "- sodium level") == ["age", "ph", "sodium_level"]
    assert structured.prose_parameters(None) == [] and structured.canonical_parameter("C-reactive protein > 3") == "crp"


def test_structured_inputs(spark):
    assert list(structured.flatten_value({"a": {"b": [1, {"c": " x\n y"}]}, "d": None})) == ["a.b[1]: 1", "a.b[2].c: x y"]
    assert list(structured.flatten_value(["u", {"v": [None, "w"]}])) == ["item[1]: u", "item[2].v[2]: w"]
    assert structured.signature("def f(a, *, b=1): pass") == ["a", "b"] and structured.signature("not python(") == []


# Sources and plans ----------------------------------------------------------------------------

XML = """<clinical_study><required_header><download_date>Snapshot of {day}</download_date></required_header><id_info><nct_id>NCT11110001</nct_id></id_info>
<brief_title>Trial</brief_title><overall_status>Recruiting</overall_status><condition>NSCLC</condition><condition>nsclc</condition>
<detailed_description><textblock>One.

Two.</textblock></detailed_description><eligibility><criteria><textblock>Inclusion Criteria:

- adult

Exclusion Criteria:

- none</textblock></criteria><minimum_age>18 Years</minimum_age><maximum_age>N/A</maximum_age></eligibility>
<intervention><intervention_type>Drug</intervention_type><intervention_name>X</intervention_name></intervention>
<primary_outcome><measure>OS</measure><time_frame>1 year</time_frame></primary_outcome></clinical_study>"""


@pytest.fixture
def corpus(tmp_path):
    for folder, day in (("corpus_2021_2022", "April 27, 2021"), ("corpus_2023", "May 08, 2023")):
        (tmp_path / folder).mkdir()
        with zipfile.ZipFile(tmp_path / folder / "s.zip", "w") as archive:
            archive.writestr("NCT1111xxxx/NCT11110001.XML", XML.format(day=day))
            archive.writestr("notes.txt", "x")
    (tmp_path / "corpus_2023" / "bad.zip").write_bytes(b"no zip")
    (tmp_path / "loose.xml").write_text("<clinical_study><brief_title>Loose</brief_title></clinical_study>")
    return tmp_path


def test_from_archives_to_chunks(spark, corpus):
    sources = archives.scan_sources(spark, [str(corpus), str(corpus / "nowhere")])
    assert sources.count() == 3
    keyed = sources.withColumn("arrival", F.monotonically_increasing_id())
    records = kb.trial_records(keyed, ["source_corpus", "source_archive", "source_member_path", "arrival"], "xml_bytes", "source_member_path")
    priority = F.when(F.col("source_corpus") == "totrials_2023", 2).when(F.col("source_corpus") == "totrials_2021_2022", 1).otherwise(0)
    latest = kb.latest_records(records, priority, "source_archive", "source_member_path", "arrival")
    rows = {r.nct_id: r for r in latest.collect()}
    assert set(rows) == {"NCT11110001", "loose"}
    best = rows["NCT11110001"]
    assert (best.source_corpus, best.n_duplicates, best.age_floor_years, best.age_ceiling_years, best.conditions) == ("totrials_2023", 1, 18.0, None, ["NSCLC"])
    built = {r.chunk_id: r for r in kb.record_chunks(latest).collect()}
    assert {k for k in built if k.startswith("NCT")} == {f"NCT11110001::{k}::0" for k in kb.RANK_WEIGHTS}
    assert "inclusion criteria: adult" in built["NCT11110001::eligibility_inclusion::0"].text
    assert "detailed description: One.\n\nTwo." in built["NCT11110001::description::0"].text
    assert "measure=OS; time_frame=1 year" in built["NCT11110001::outcomes::0"].text


def test_broken_archives_are_reported(spark, frame):
    out = io.BytesIO()
    zipfile.ZipFile(out, "w").close()
    df = frame([(1, b"x"), (2, None), (3, out.getvalue())], "k long, b binary")
    assert [(r.k, bool(r.error)) for r in archives.explode_zip(df, ["k"], "b").collect()] == [(1, True)]
    assert {(r.k, r.readable) for r in archives.inspect_archives(df, ["k"], "b").collect()} == {(1, False), (2, False), (3, True)}


def test_json_catalogs(spark, tmp_path):
    for name, body in (("cardio", {"N1": {"title": "a"}, "N2": {"title": "b", "nct_id": "NX"}}), ("onco", {"N1": {"title": "c"}})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "trials.json").write_text(json.dumps(body))
    out = files.department_catalog(spark, str(tmp_path), "struct<title:string,nct_id:string>").collect()
    assert {(r.nct_id, r.department_tag, r.title) for r in out} == {("N1", "cardio", "a"), ("NX", "cardio", "b"), ("N1", "onco", "c")}


def test_eval_cases_skip_remarks_and_reject_bad_lines(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text('# remark\n\n{"case_id": "a", "structured_case": {"x": 1}}\n')
    assert [(r.case_id, r.expected) for r in files.read_eval_cases(spark, str(path)).collect()] == [("a", "{}")]
    path.write_text('{"case_id": "a"}\n')
    with pytest.raises(Exception, match="not an evaluation case"):
        files.read_eval_cases(spark, str(path)).collect()


def test_grep_and_blocks(spark, tmp_path, frame):
    (tmp_path / "a.txt").write_text("one\ntwo words \nthree")
    assert [(r.line_no, r.column_no, r.line) for r in files.grep(spark, str(tmp_path), "words").collect()] == [(2, 5, "two words")]
    blocks = frame([("=== RESULT 1 BEGIN ===\nnot json\n=== RESULT 1 END ===\n=== RESULT 2 BEGIN ===\n{\"k\": 2}\n=== RESULT 2 END ===\n=== RESULT 3 BEGIN ===\n{",)], "t string")
    assert [r.k for r in files.parse_blocks(blocks, "t", "k long").collect()] == [2]


def test_stage_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert stage(spark, str(tmp_path / "s"), build).count() == 3
    assert len(calls) == 1


def test_events_of_windows_that_ended_are_dropped(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "cp"))
    at = lambda h, day=1: dt.datetime(2024, 1, day, h)

    def run(rows):
        spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(source)
        events = streams.read_stream(spark, source)
        return {(r.window_start, r.kind): r.n for r in streams.counted_windows(events, sink, state, "ts", ["kind"], late="2 hours").collect()}

    assert run([(at(5), "a"), (at(5), "a"), (at(6), None)]) == {(at(5), "a"): 2, (at(6), None): 1}
    assert run([(at(5), "a"), (at(9), "b")]) == {(at(5), "a"): 3, (at(6), None): 1, (at(9), "b"): 1}  # late, but its window is still open
    run([(at(12), "c")])
    assert run([(at(5), "a"), (at(11), "c")]) == {(at(5), "a"): 3, (at(6), None): 1, (at(9), "b"): 1, (at(11), "c"): 1, (at(12), "c"): 1}  # the first is too late


def test_zips_of_many_members_are_read_by_ranges(spark, frame, tmp_path, monkeypatch):
    rows = [(f"d{i % 3}/n{i:03}.{'XML' if i % 2 else 'xml'}", bytes([i % 251]) * i) for i in range(120)] + [("read.me", b"x"), (None, b"y"), ("z.xml", None)]
    assert archives.write_zips(frame(rows, "name string, data binary", 2), str(tmp_path / "zips"), "name", "data") == 2
    (tmp_path / "zips" / "broken.zip").write_bytes(b"no zip")
    whole = archives.zip_members(spark, str(tmp_path / "zips")).collect()
    monkeypatch.setattr(archives, "RANGE_BYTES", 64)
    parts = archives.zip_members(spark, str(tmp_path / "zips")).collect()
    for got in (whole, parts):
        assert sorted((r.member_path, bytes(r.member_bytes)) for r in got if not r.error) == sorted((n, d) for n, d in rows[:120])
        assert [r.path.endswith("broken.zip") for r in got if r.error] == [True]
    assert archives.scan_zips(spark, str(tmp_path / "zips")).count() == 120


def test_stream_upsert_keeps_the_last_row(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (2, 1, "x")], "k long, o long, v string").write.parquet(str(source))
    run = lambda: streams.upsert_stream(streams.read_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "cp"), "k", ["o"])
    assert sorted((r.k, r.v) for r in run().collect()) == [(1, "c"), (2, "x")]
    spark.createDataFrame([(1, 2, "late"), (2, 5, "new")], "k long, o long, v string").write.mode("append").parquet(str(source))
    assert sorted((r.k, r.v) for r in run().collect()) == [(1, "c"), (2, "new")]


# Cases ----------------------------------------------------------------------------------------


def test_case_columns(spark):
    left, right = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2"))
    assert one(spark, cases.merge_maps(left, right)) == {"a": "1", "b": "2"}
    assert one(spark, cases.merge_maps(F.lit(None).cast("map<string,string>"), right)) == {"b": "2"}
    assert one(spark, cases.anchors(F.lit("Chest pain, fever and  night sweats; cough"))) == ["Chest pain", "night sweats"]
    assert one(spark, cases.anchors(F.lit(None).cast("string"))) == []
    scored = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(s).alias("score")) for t, s in (("b", 1.0), ("a b", 2.0), ("c", 1.0), ("d", 1.0))])
    assert one(spark, cases.pick_anchors(scored, 2)) == ["a b", "c"]
    assert one(spark, cases.contained(F.array(F.lit("Lung"), F.lit("x"), F.lit(None)), F.array(F.lit("lung cancer"), F.lit(""), F.lit(None)))) == ["Lung"]


def test_problem_anchors_and_summaries(spark):
    of = lambda *problems: one(spark, cases.problem_anchors(F.array(*[F.lit(p) for p in problems]).cast("array<string>")))
    assert of("Found to be anaplastic astrocytoma of the conus; headache, MRI") == [
        "anaplastic astrocytoma of the conus", "anaplastic astrocytoma of the conus glioma", "anaplastic astrocytoma of the conus spinal tumor", "MRI", "MRI magnetic resonance imaging", "anaplastic astrocytoma of the conus; headache, MRI",
        "anaplastic astrocytoma of the conus; headache, MRI glioma", "anaplastic astrocytoma of the conus; headache, MRI spinal tumor",
    ]
    assert of("fever", None, " - ", "Glioma", "GLIOMA", "found to be ") == ["Glioma", "found to be"]
    assert one(spark, cases.problem_anchors(F.lit(None).cast("array<string>"))) == []
    assert [one(spark, cases.anchor_score(F.lit(t))) for t in ("glioma", "spinal pain after surgery", "x " * 17, "")] == [3.0, 7.0, -0.5, 0.0]
    assert one(spark, cases.case_summary(F.array(F.lit("severe back pain"), F.lit("glioma of the cord"), F.lit("back PAIN"), F.lit("radiation")), 2)) == "primary problem: severe back pain; glioma of the cord"
    assert one(spark, cases.case_summary(F.array(F.lit("word")))) == ""


def test_negation_by_hand(frame):
    rows = [(1, "No sign of diabetes. diabetes"), (2, "no fever (diabetes)"), (3, "not seen although diabetes"), (4, "What is the risk without diabetes"), (5, f"no {'x' * 90} diabetes"), (6, "diabetes was not found"), (7, "note on diabetes")]
    out = {r.k: (r.positive, r.negative) for r in lexicon.term_flags(frame(rows, "k long, t string"), "k", "t", {"d": r"\bdiabetes\b"}).collect()}
    assert out == {1: (True, True), 2: (True, False), 3: (True, False), 4: (True, False), 5: (True, False), 6: (False, True), 7: (True, False)}


def test_intervals_with_missing_and_swapped_bounds(frame):
    rows = [("a", 0.9, 0.7), ("a", None, 0.9), ("b", float("nan"), None), (None, 0.1, 0.2)]
    out = {r.g: (r.n, round(r.mean_lower, 6), round(r.mean_upper, 6), r.band) for r in cases.interval_bounds(frame(rows, "g string, lo double, hi double"), ["g"], "lo", "hi").collect()}
    assert out == {"a": (2, 0.8, 0.9, "high"), None: (1, 0.1, 0.2, "low")}


def test_lookup_and_best_choice(frame):
    rows = frame([(1, " f "), (2, None), (3, "Q")], "k long, s string")
    side = frame([("F", "closed")], "s string, state string")
    assert {(r.k, r.state) for r in cases.lookup(rows, "s", side, {"state": "?"}).collect()} == {(1, "closed"), (2, "?"), (3, "?")}
    picks = frame([("g", 2, 5.0), ("g", 1, 5.0), ("g", 3, None), (None, 9, 1.0)], "g string, i long, s double")
    assert {(r.g, r.i) for r in cases.select_best(picks, ["g"], [F.coalesce("s", F.lit(-1.0))], "i").collect()} == {("g", 1), (None, 9)}


def test_fragments_rebuild_the_text(frame):
    out = cases.fragments(frame([(1, " One is  here. 两句。三句! End"), (2, None), (3, " ")], "k long, t string"), "k", "t").orderBy("fragment_no").collect()
    flat = "One is here. 两句。三句! End"
    assert [r.fragment for r in out] == ["One is here.", "两句。", "三句!", "End"]
    assert all(flat[r.start_offset : r.end_offset] == r.fragment for r in out)
