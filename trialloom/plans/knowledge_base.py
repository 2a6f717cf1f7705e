"""From source XML to trial records, chunks and a manifest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions import text as T
from trialloom.functions.sections import section_parts
from trialloom.operators.nested import local_name, parse_xml
from trialloom.operators.relational import latest_wins

# Fields of a trial record by the path of their element; the model of the source XML.
TEXTS = {
    "nct_id": "id_info/nct_id", "source_url": "required_header/url", "source_snapshot_date": "required_header/download_date",
    "brief_title": "brief_title", "official_title": "official_title", "acronym": "acronym", "overall_status": "overall_status",
    "study_type": "study_type", "phase": "phase", "primary_purpose": "study_design_info/primary_purpose",
    "intervention_model": "study_design_info/intervention_model", "allocation": "study_design_info/allocation", "masking": "study_design_info/masking",
    "enrollment": "enrollment", "gender": "eligibility/gender", "minimum_age": "eligibility/minimum_age", "maximum_age": "eligibility/maximum_age",
    "healthy_volunteers": "eligibility/healthy_volunteers", "start_date": "start_date", "completion_date": "completion_date",
    "last_update_posted": "last_update_posted",
}
BLOCKS = {"brief_summary": "brief_summary/textblock", "detailed_description": "detailed_description/textblock", "eligibility_text": "eligibility/criteria/textblock"}
LISTS = {
    "conditions": "condition", "condition_mesh_terms": "condition_browse/mesh_term", "keywords": "keyword",
    "interventions": "intervention/intervention_name", "intervention_types": "intervention/intervention_type",
    "intervention_descriptions": "intervention/description", "intervention_mesh_terms": "intervention_browse/mesh_term",
    "arm_group_labels": "arm_group/arm_group_label", "arm_group_types": "arm_group/arm_group_type", "arm_group_descriptions": "arm_group/description",
    "primary_outcome_measures": "primary_outcome/measure", "primary_outcome_descriptions": "primary_outcome/description",
    "primary_outcome_time_frames": "primary_outcome/time_frame", "secondary_outcome_measures": "secondary_outcome/measure",
    "secondary_outcome_descriptions": "secondary_outcome/description", "secondary_outcome_time_frames": "secondary_outcome/time_frame",
    "reference_pmids": "reference/PMID", "reference_citations": "reference/citation", "countries": "location_countries/country",
    "facility_cities": "location/facility/address/city", "facility_states": "location/facility/address/state", "facility_countries": "location/facility/address/country",
}
# Weights of the chunk types.
RANK_WEIGHTS = {"overview": 1.0, "description": 0.75, "eligibility_inclusion": 1.2, "eligibility_exclusion": 1.2, "outcomes": 0.9, "arms_interventions": 0.85}
CHUNK_CHARS = 1400


def _nodes(root, path: str) -> list:
    found = [root]
    for name in path.split("/"):
        found = [c for n in found for c in n if local_name(c.tag) == name]
    return found


def project_xml(sources: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """The raw fields of every well-formed record beside its keys, with ``error`` for the others.

    One Python pass reads the elements; what is made of them stays in the JVM.
    """
    texts = {**TEXTS, **BLOCKS}
    schema = ", ".join([*[f"`{k}` {sources.schema[k].dataType.simpleString()}" for k in keys], *[f"{c} string" for c in texts], "enrollment_type string", *[f"{c} array<string>" for c in LISTS], "error string"])
    names = [*keys, *texts, "enrollment_type", *LISTS, "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False, name=None):
                root = parse_xml(bytes(row[-1]) if row[-1] is not None else None)
                if root is None:
                    rows.append((*row[:-1], *[None] * (len(texts) + 1), *[[]] * len(LISTS), "not well-formed"))
                    continue
                first = [next(("".join(n.itertext()) for n in _nodes(root, p)), None) for p in texts.values()]
                kind = next((n.attrib.get("type") for n in _nodes(root, "enrollment")), None)
                rows.append((*row[:-1], *first, kind, *[["".join(n.itertext()) for n in _nodes(root, p)] for p in LISTS.values()], None))
            yield pd.DataFrame(rows, columns=names)

    return sources.select(*keys, xml).mapInPandas(run, schema)


def trial_records(sources: DataFrame, keys: list[str], xml: str, member_path: str) -> DataFrame:
    """A trial record per well-formed source: normalized fields, lists without repeats, derived columns."""
    raw = project_xml(sources, keys, xml).where(F.col("error").isNull())
    blank = lambda c: F.nullif(c, F.lit(""))
    flat = [T.normalize_whitespace(F.col(c)).alias(c) for c in [*TEXTS, "enrollment_type"] if c != "nct_id"]
    stem = F.regexp_extract(member_path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    nct = F.coalesce(blank(T.normalize_whitespace(F.col("nct_id"))), stem)
    out = raw.select(*keys, nct.alias("nct_id"), *flat, *[T.normalize_block(F.col(c)).alias(c) for c in BLOCKS], *T.dedupe_columns(list(LISTS)))
    return out.select(
        "*", F.coalesce(blank(F.col("brief_title")), blank(F.col("official_title")), F.col("nct_id")).alias("display_title"),
        T.dedupe(F.concat("conditions", "condition_mesh_terms", "keywords")).alias("condition_terms"), T.dedupe(F.concat("interventions", "intervention_mesh_terms")).alias("intervention_terms"),
        ((F.size("reference_citations") > 0) | (F.size("reference_pmids") > 0)).alias("has_results_references"),
        T.age_years(F.col("minimum_age")).alias("age_floor_years"), T.age_years(F.col("maximum_age")).alias("age_ceiling_years"),
        T.parse_partial_date(F.regexp_extract("source_snapshot_date", r"([A-Za-z]+ \d{1,2}, \d{4})", 1)).alias("snapshot_on"), T.parse_partial_date(F.col("last_update_posted")).alias("updated_on"),
    )


def latest_records(records: DataFrame, priority: Column, archive: str, member_path: str, arrival: str) -> DataFrame:
    """One record per trial: the highest corpus priority, then the latest snapshot and update, then names, then arrival."""
    ranked = records.withColumn("__priority", priority).where(F.col("nct_id") != "")
    order = [F.col("__priority"), F.coalesce("snapshot_on", F.lit("1970-01-01").cast("date")), F.coalesce("updated_on", F.lit("1970-01-01").cast("date")), F.coalesce(archive, F.lit("")), F.coalesce(member_path, F.lit("")), F.col(arrival)]
    return latest_wins(ranked, ["nct_id"], order).drop("__priority")


# Labels of the lines of chunk texts, and titles of the lists in them.
LABELS = {
    "title": "title: ", "acronym": "acronym: ", "profile": "study profile: ", "conditions": "conditions: ", "condition_mesh": "condition mesh terms: ", "interventions": "interventions: ",
    "intervention_mesh": "intervention mesh terms: ", "summary": "summary: ", "nct_id": "nct_id: ", "chunk_type": "chunk type: ", "overall_status": "overall status: ",
}
TITLES = {"primary": "Primary outcomes", "secondary": "Secondary outcomes", "references": "References", "interventions": "Interventions", "arm": "Arm groups"}


def _line(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))


def _listed(label: str, column: str) -> Column:
    return _line(label, F.array_join(column, ", "))


def _profile(*columns: str) -> Column:
    return _line(LABELS["profile"], F.concat_ws("; ", *[F.nullif(F.col(c), F.lit("")) for c in columns]))


def overview_text() -> Column:
    """The overview of a record, one line per filled field."""
    return F.concat_ws(
        "\n", _line(LABELS["title"], F.col("display_title")), _line(LABELS["acronym"], F.col("acronym")), _profile("study_type", "phase", "primary_purpose", "overall_status"),
        _listed(LABELS["conditions"], "conditions"), _listed(LABELS["condition_mesh"], "condition_mesh_terms"), _listed(LABELS["interventions"], "interventions"),
        _listed(LABELS["intervention_mesh"], "intervention_mesh_terms"), _line(LABELS["summary"], F.col("brief_summary")),
    )


def _rows(fields: dict[str, str]) -> Column:
    """Lines of 'name=value; ...' from lists of any lengths, position by position."""
    size = F.greatest(*[F.size(c) for c in fields.values()])
    at = lambda c, i: F.nullif(F.get(F.col(c), i), F.lit(""))
    row = lambda i: F.concat_ws("; ", *[F.when(at(c, i).isNotNull(), F.concat(F.lit(f"{n}="), at(c, i))) for n, c in fields.items()])
    lines = F.filter(F.transform(F.sequence(F.lit(0), size - 1), row), lambda r: r != "")
    return F.when(size > 0, lines).otherwise(F.array().cast("array<string>"))


def _titled(title: str, rows: Column) -> Column:
    return F.when(F.size(rows) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("- "), r)), "\n")))


def outcomes_text() -> Column:
    kind = lambda k: _rows({"measure": f"{k}_outcome_measures", "description": f"{k}_outcome_descriptions", "time_frame": f"{k}_outcome_time_frames"})
    return F.concat_ws("\n", _titled(TITLES["primary"], kind("primary")), _titled(TITLES["secondary"], kind("secondary")), _titled(TITLES["references"], F.col("reference_citations")))


def arms_text() -> Column:
    interventions = _rows({"name": "interventions", "type": "intervention_types", "description": "intervention_descriptions"})
    arms = _rows({"label": "arm_group_labels", "type": "arm_group_types", "description": "arm_group_descriptions"})
    return F.concat_ws("\n", _titled(TITLES["interventions"], interventions), _titled(TITLES["arm"], arms))


def _context(kind: Column) -> Column:
    return F.concat_ws(
        "\n", F.concat(F.lit(LABELS["title"]), F.col("display_title")), _line(LABELS["nct_id"], F.col("nct_id")), F.concat(F.lit(LABELS["chunk_type"]), kind), _line(LABELS["overall_status"], F.col("overall_status")),
        _profile("study_type", "phase", "primary_purpose"), _listed(LABELS["conditions"], "conditions"), _listed(LABELS["interventions"], "interventions"),
    )


def record_chunks(records: DataFrame, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """(chunk_id, nct_id, chunk_type, chunk_sequence, text, token_estimate, rank_weight) of every record's chunks.

    Six kinds: the overview whole, the others packed paragraph by paragraph; each
    chunk begins with the record's context. Kinds without text have none.
    """
    wide = records.withColumn("__split", section_parts(T.normalize_block(F.col("eligibility_text"))))
    wide = wide.withColumn("inclusion_text", F.col("__split.inclusion")).withColumn("exclusion_text", F.col("__split.exclusion"))
    packed = lambda c: T.pack(T.paragraphs(c), max_chars)
    bodies = {
        "overview": ("overview", F.filter(F.array(T.normalize_block(overview_text())), lambda t: t != "")),
        "description": ("detailed description", packed(F.col("detailed_description"))),
        "eligibility_inclusion": ("inclusion criteria", packed(F.col("inclusion_text"))),
        "eligibility_exclusion": ("exclusion criteria", packed(F.col("exclusion_text"))),
        "outcomes": ("outcomes and references", packed(outcomes_text())),
        "arms_interventions": ("arms and interventions", packed(arms_text())),
    }

    def typed(kind: str, label: str, body: Column) -> Column:
        return F.transform(body, lambda t, i: F.struct(F.lit(kind).alias("chunk_type"), F.lit(label).alias("label"), i.alias("chunk_sequence"), t.alias("body")))

    listed = F.flatten(F.array(*[typed(kind, label, body) for kind, (label, body) in bodies.items()]))
    keep = ["nct_id", "display_title", "overall_status", "study_type", "phase", "primary_purpose", "conditions", "interventions"]
    rows = wide.select(*keep, F.explode(listed).alias("c")).select(*keep, "c.*")
    text = T.normalize_block(F.concat(_context(F.col("chunk_type")), F.lit("\n"), F.col("label"), F.lit(": "), F.col("body")))
    rows = rows.select("nct_id", "chunk_type", "chunk_sequence", text.alias("text"))
    weight = F.create_map(*[x for k, w in RANK_WEIGHTS.items() for x in (F.lit(k), F.lit(w))])
    return rows.select(
        F.concat_ws("::", "nct_id", "chunk_type", F.col("chunk_sequence").cast("string")).alias("chunk_id"), "nct_id", "chunk_type", "chunk_sequence", "text",
        T.token_estimate(F.col("text")).alias("token_estimate"), weight[F.col("chunk_type")].alias("rank_weight"),
    )


def manifest(sources: DataFrame, records: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item, value, n) of a build: counts of sources, records and chunks, and of chunk types and statuses."""
    one = lambda df, item: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(item).alias("item"), F.lit("").alias("value"), "n")
    by = lambda df, item, c: df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(item).alias("item"), F.coalesce(c, F.lit("")).alias("value"), "n")
    parts = [one(sources, "sources"), one(records, "records"), one(chunks, "chunks"), by(chunks, "chunk_type", "chunk_type"), by(records, "status", "overall_status")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.unionByName(records.agg(F.coalesce(F.sum("n_duplicates"), F.lit(0)).alias("n")).select(F.lit("duplicates").alias("item"), F.lit("").alias("value"), "n"))
