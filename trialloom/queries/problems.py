"""The pN_ queries of the general problems: units and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.operators import nested, units
from trialloom.session import spread, table


# What the concepts are called in texts.
ALIASES = {
    "glucose": ["glucose", "fasting glucose", "plasma glucose", "blood sugar", "blood glucose", "血糖"],
    "creatinine": ["creatinine", "serum creatinine", "肌酐"],
    "hemoglobin": ["hemoglobin", "haemoglobin", "Hb", "Hgb", "血红蛋白"],
    "hba1c": ["HbA1c", "A1c", "glycated haemoglobin", "glycated hemoglobin", "糖化血红蛋白"],
    "body_temperature": ["body temperature", "temperature", "temp", "体温"],
    "body_weight": ["body weight", "weight", "体重"],
    "body_height": ["body height", "height", "stature", "身高"],
    "platelet_count": ["platelet count", "platelets", "PLT", "血小板"],
    "systolic_pressure": ["systolic pressure", "systolic blood pressure", "systolic BP", "SBP", "收缩压"],
    "symptom_duration": ["symptom duration", "duration of symptoms", "症状持续", "症状持续时间"],
}


def p4_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recorded quantity in the common unit of its concept."""
    book = units.read_units(table(spark, sf_dir, "measure_units"))
    spans = units.to_common_units(
        spread(table(spark, sf_dir, "evidence_spans").select("span_id", "normalized_concept", "value", "unit", "text", "source")), "span_id", book, ALIASES,
        F.col("normalized_concept"), F.col("unit"), F.col("source"), value=F.col("value"), text=F.col("text"),
    )
    intervals = units.to_common_units(
        table(spark, sf_dir, "interval_inputs"), "interval_id", book, ALIASES,
        F.col("feature_name"), F.col("unit"), F.col("source"), lower=F.col("lower_bound"), upper=F.col("upper_bound"),
    )
    return (
        spans.withColumnRenamed("span_id", "record_id").withColumn("record_kind", F.lit("span"))
        .unionByName(intervals.withColumnRenamed("interval_id", "record_id").withColumn("record_kind", F.lit("interval")))
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_converted(spark, sf_dir).where(~F.col("is_common")).select("record_kind", "record_id", "unit_code")


_ROOT = ("clinical_results", "outcome_list", "outcome")
_CLASS = (*_ROOT, "measure", "class_list", "class")
_CATEGORY = (*_CLASS, "category_list", "category")
STUDY = nested.Shape(
    "clinical_study",
    (
        *[nested.Repeated(k, (k,)) for k in ("condition", "keyword", "arm_group", "intervention", "primary_outcome", "secondary_outcome", "reference", "location")],
        nested.Repeated("intervention_arm", ("intervention", "arm_group_label"), "intervention"),
        nested.Repeated("intervention_alias", ("intervention", "other_name"), "intervention"),
        nested.Repeated("location_investigator", ("location", "investigator"), "location"),
        nested.Repeated("result_outcome", _ROOT),
        nested.Repeated("result_class", _CLASS, "result_outcome"),
        nested.Repeated("result_category", _CATEGORY, "result_class"),
        nested.Repeated("result_measurement", (*_CATEGORY, "measurement_list", "measurement"), "result_category"),
    ),
)


def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flat tables of the registry XML, one row per repeated element, with its text."""
    sources = spread(table(spark, sf_dir, "trial_xml_sources").select("source_id", "xml_bytes", "source_member_path"))
    # The path travels with the key, so the trial number needs no join back.
    keyed = sources.select(F.struct("source_id", "source_member_path").alias("key"), "xml_bytes")
    rows = nested.flat_tables(keyed, "key", "xml_bytes", STUDY, ("id_info", "nct_id"))
    number = F.coalesce(nested.normal_id(F.col("record_id")), nested.path_id(F.col("key.source_member_path")))
    return rows.select(F.col("key.source_id").alias("source_id"), number.alias("nct_id"), "child_kind", "parent_no", "child_no", "child_text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_tables(spark, sf_dir).drop("child_text")


QUERIES = {f.__name__: f for f in (p4_found, p4_converted, p5_found, p5_tables)}
