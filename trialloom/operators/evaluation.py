"""Metrics of evaluation cases: hits at depths, matches, failure buckets, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The failure buckets, in order.
BUCKETS = (
    "protocol_exception", "no_candidates", "must_retrieve_miss", "wrong_condition_top10", "no_recruiting_trials_top10", "eligibility_not_assessed", "criteria_parse_empty", "too_many_unknowns",
    "missing_questions_empty_despite_unknowns",
)


def _texts(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def case_metrics(cases: DataFrame, candidates: DataFrame, criteria: DataFrame, case: str, item: str) -> DataFrame:
    """One row per case: counts, hits and recall at 10 and 20, matches at 10, labels of criteria, failure buckets.

    ``cases`` has a unique ``case``, arrays ``must``, ``acceptable``, ``conditions`` and
    ``interventions`` (null as good as empty) and ``error``. ``candidates`` has ``case``, ``item``,
    ``rank`` from 1, ``text`` and ``is_open``; a case's first 20 are looked at, each by
    itself. ``criteria`` has ``case``, ``item``, ``label`` (met, not_met, unknown, ...) and
    ``questions``, one row per criterion, a null label for a trial without any. Recall is null without items that must be found.
    """
    arrays = ("must", "acceptable", "conditions", "interventions")
    wide = candidates.join(cases.select(case, *[_texts(a).alias(a) for a in arrays]), case)
    at = lambda k: F.col("rank") <= k
    holds = lambda terms: F.exists(terms, lambda t: (F.trim(t) != "") & F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower(F.trim(t))))
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    found = wide.groupBy(case).agg(
        F.count(F.lit(1)).alias("n_candidates"), *[F.count_distinct(F.when(at(k) & F.array_contains("must", F.col(item)), F.col(item))).alias(f"must_hits_{k}") for k in (10, 20)],
        F.count_distinct(F.when(at(10) & F.array_contains("acceptable", F.col(item)), F.col(item))).alias("acceptable_hits_10"), n(at(10) & holds(F.col("conditions"))).alias("condition_matches_10"),
        n(at(10) & holds(F.col("interventions"))).alias("intervention_matches_10"), n(at(10) & F.coalesce("is_open", F.lit(False))).alias("open_10"),
    )
    label = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    judged = criteria.groupBy(case).agg(
        F.count_distinct(item).alias("n_assessed"), F.count("label").alias("n_criteria"), *[n(label == x).alias(f"n_{x}") for x in ("met", "not_met", "unknown")], F.coalesce(F.sum("questions"), F.lit(0)).alias("n_questions"),
    )
    out = cases.select(case, F.size(F.array_distinct(_texts("must"))).alias("n_must"), (F.size(_texts("conditions")) > 0).alias("__wants"), F.coalesce("error", F.lit("")).alias("error"))
    out = out.join(found, case, "left").join(judged, case, "left").na.fill(0)
    c = F.col
    conditions = (
        c("error") != "", c("n_candidates") == 0, (c("n_must") > 0) & (c("must_hits_20") == 0), c("__wants") & (c("n_candidates") > 0) & (c("condition_matches_10") == 0), (c("n_candidates") > 0) & (c("open_10") == 0),
        (c("n_candidates") > 0) & (c("n_assessed") == 0), (c("n_assessed") > 0) & (c("n_criteria") == 0), c("n_unknown") > c("n_met") + c("n_not_met"), (c("n_unknown") > 0) & (c("n_questions") == 0),
    )
    buckets = F.array_compact(F.array(*[F.when(x, F.lit(b)) for x, b in zip(conditions, BUCKETS, strict=True)]))
    recall = [F.try_divide(c(f"must_hits_{k}"), F.nullif(c("n_must"), F.lit(0))).alias(f"recall_{k}") for k in (10, 20)]
    return out.select("*", *recall, buckets.alias("failure_buckets")).drop("__wants")


def summary(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """(item, value): numbers of all, completed and failed cases, means of columns (null as 0), and cases per failure bucket."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    failed = F.sum((F.col("error") != "").cast("double"))
    parts = {"case_count": F.count(F.lit(1)).cast("double"), "failed_case_count": z(failed), "completed_case_count": F.count(F.lit(1)) - z(failed), **{f"mean_{x}": z(F.avg(z(F.col(x).cast("double")))) for x in columns}}
    one = metrics.agg(F.map_from_entries(F.array(*[F.struct(F.lit(k), v) for k, v in parts.items()])).alias("m")).select(F.explode("m").alias("item", "value"))
    buckets = metrics.select(F.explode("failure_buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return one.unionByName(buckets.select(F.concat(F.lit("bucket_"), "b").alias("item"), "value"))
