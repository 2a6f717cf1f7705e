"""Queries of sources, sinks, the knowledge base, lexicons, score rules and streams."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.functions import lexicon, rules, sections, structured
from trialloom.functions import retrieval_text as texts
from trialloom.functions import taxonomy as taxonomies
from trialloom.functions import text as T
from trialloom.operators import relational
from trialloom.plans import knowledge_base as kb
from trialloom.queries.registry import Registry
from trialloom.queries.retrieval import chunks
from trialloom.session import materialize, shared_folder, spread, table
from trialloom.sources import archives, files
from trialloom.streaming import streams

query = Registry()


# Archives and XML -----------------------------------------------------------------------------


def _zip_all(names: pd.Series, contents: pd.Series) -> pd.Series:
    def pack(name: str, data: bytes) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr(name, data)
            archive.writestr("README.txt", "not XML")
        return out.getvalue()

    return pd.Series([pack(n, d) for n, d in zip(names, contents, strict=True)])


def _zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "trial_xml_sources").where(F.col("xml_bytes").isNotNull())
    return rows.select("source_id", F.pandas_udf(_zip_all, "binary")("source_member_path", "xml_bytes").alias("content"))


@query("SELECT source_id, source_member_path AS member_path, octet_length(xml_bytes) AS n_bytes, sha256(xml_bytes) AS sha FROM trial_xml_sources WHERE xml_bytes IS NOT NULL")
def scan_zip_xml(spark, sf_dir):
    members = archives.explode_zip(_zips(spark, sf_dir), ["source_id"], "content")
    return members.select("source_id", "member_path", F.length("member_bytes").cast("bigint").alias("n_bytes"), F.sha2("member_bytes", 256).alias("sha"))


@query("SELECT source_id, source_member_path AS member_path, octet_length(xml_bytes) AS n_bytes, sha256(xml_bytes) AS sha FROM trial_xml_sources WHERE xml_bytes IS NOT NULL")
def scan_zip_files(spark, sf_dir):
    """All sources written to zips of many members in the shared folder and read from there by offset."""
    rows = table(spark, sf_dir, "trial_xml_sources").where(F.col("xml_bytes").isNotNull())
    named = F.concat(F.col("source_id").cast("string"), F.lit("/"), F.regexp_replace("source_member_path", r"(?i)(\.xml)?$", ".xml"), F.lit("|"), F.col("source_member_path"), F.lit(".XML"))
    folder = shared_folder(spark, "zips")
    archives.write_zips(rows.select(named.alias("name"), "xml_bytes").repartition(4), folder, "name", "xml_bytes")
    members = archives.zip_members(spark, folder).where(F.col("error").isNull())
    path = F.regexp_replace(F.get(F.split("member_path", r"\|"), 1), r"\.XML$", "")
    return members.select(F.get(F.split("member_path", "/"), 0).cast("bigint").alias("source_id"), path.alias("member_path"), F.length("member_bytes").cast("bigint").alias("n_bytes"), F.sha2("member_bytes", 256).alias("sha"))


@query("SELECT source_id, TRUE AS readable, 2 AS n_entries, 1 AS n_xml FROM trial_xml_sources WHERE xml_bytes IS NOT NULL UNION ALL SELECT source_id, FALSE, NULL, NULL FROM trial_xml_sources WHERE xml_bytes IS NOT NULL")
def archive_inspect(spark, sf_dir):
    zips = _zips(spark, sf_dir)
    broken = zips.withColumn("content", F.encode(F.lit("no zip"), "UTF-8"))
    return archives.inspect_archives(zips.unionByName(broken), ["source_id"], "content").drop("error")


@query("""SELECT source_id, CASE WHEN list_contains(string_split(lower(input_path), '/'), 'corpus_2023') THEN 'totrials_2023' WHEN list_contains(string_split(lower(input_path), '/'), 'corpus_2021_2022') THEN 'totrials_2021_2022'
ELSE regexp_replace(string_split(input_path, '/')[-2], '[^A-Za-z0-9._-]+', '_', 'g') END AS corpus FROM trial_xml_sources""")
def corpus_tag(spark, sf_dir):
    return table(spark, sf_dir, "trial_xml_sources").select("source_id", archives.corpus_of(F.col("input_path")).alias("corpus"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spread(table(spark, sf_dir, "trial_xml_sources").drop("input_path", "received_at"))
    return kb.trial_records(sources, ["source_id", "source_corpus", "source_archive", "source_member_path"], "xml_bytes", "source_member_path")


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_replace(F.lower(F.trim("source_corpus")), r"[\s-]+", "_")
    priority = F.when(name == "totrials_2023", 2).when(name == "totrials_2021_2022", 1).otherwise(0)
    return kb.latest_records(_records(spark, sf_dir), priority, "source_archive", "source_member_path", "source_id")


@query()
def xml_to_record(spark, sf_dir):
    return _records(spark, sf_dir).select("source_id", "nct_id", "display_title", "overall_status", "conditions", "interventions", "age_floor_years", "age_ceiling_years", "snapshot_on", "has_results_references")


@query()
def record_to_chunks(spark, sf_dir):
    return kb.record_chunks(_latest(spark, sf_dir))


@query()
def kb_build(spark, sf_dir):
    records = materialize(_latest(spark, sf_dir))
    built = materialize(kb.record_chunks(records))
    return kb.manifest(table(spark, sf_dir, "trial_xml_sources"), records, built)


@query()
def split_sections(spark, sf_dir):
    rows = _records(spark, sf_dir).select("source_id", "eligibility_text")
    return sections.split_sections(rows, "source_id", "eligibility_text")


@query("""SELECT event_id, CASE WHEN user_id % 5 IN (0, 1) THEN 'a ' || event_id WHEN user_id % 5 = 4 THEN 'a ' || event_id || '.' || chr(10) || chr(10) || 'c' ELSE '' END AS inclusion_text, CASE WHEN user_id % 5 IN (0, 2) THEN event_type ELSE '' END AS exclusion_text,
CASE user_id % 5 WHEN 0 THEN 'parsed' WHEN 1 THEN 'inclusion_only' WHEN 2 THEN 'exclusion_only' WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 'empty' ELSE 'unsplit' END ELSE 'inclusion_only' END AS parse_status,
CASE user_id % 5 WHEN 1 THEN 'exclusion_section_heading_not_found' WHEN 2 THEN 'inclusion_section_heading_not_found' WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 'eligibility_text_empty' ELSE 'eligibility_section_headings_not_found' END WHEN 4 THEN 'multiple_inclusion_sections,exclusion_section_heading_not_found' ELSE '' END AS warnings FROM events""")
def section_status(spark, sf_dir):
    a, kind, n = F.concat(F.lit("- a "), F.col("event_id").cast("string")), F.col("event_type"), F.col("user_id") % 5
    text = F.when(n == 0, F.concat(F.lit("Inclusion Criteria:\n\n"), a, F.lit("\n\nKey exclusion  criteria\n- "), kind)).when(n == 1, F.concat(F.lit("Criteria for inclusion: "), a)).when(n == 2, F.concat(F.lit("Patients will be excluded if: "), kind))
    text = text.when(n == 3, F.when(F.col("event_id") % 2 == 0, " \n").otherwise(F.concat(F.lit("Adults with "), kind))).otherwise(F.concat(F.lit("INCLUSION CRITERIA "), a, F.lit(". Main Inclusion Criteria: c")))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("t"))
    return sections.section_status(rows, "event_id", "t").select("event_id", "inclusion_text", "exclusion_text", "parse_status", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT parse_status, u.w AS warning, count(*) AS n FROM eligibility_sections LEFT JOIN LATERAL (SELECT unnest(warnings) AS w) u ON TRUE GROUP BY ALL")
def parse_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "eligibility_sections").select("parse_status", F.explode_outer("warnings").alias("warning"))
    return relational.histogram(rows, ["parse_status", "warning"])


# Catalogs, files and sinks --------------------------------------------------------------------


@query("""WITH c AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC, text DESC) AS rn FROM trial_chunks) WHERE rn = 1),
r AS (SELECT nct_id, min(title) AS display_title, count(*) AS n FROM c GROUP BY nct_id HAVING count(*) > 3)
SELECT c.chunk_id, c.nct_id, r.display_title, CAST(r.n AS VARCHAR) AS overall_status, coalesce(nullif(c.rank_weight, 0), 1.0) AS rank_weight FROM c LEFT JOIN r USING (nct_id) WHERE trim(c.chunk_id) <> '' AND trim(c.nct_id) <> ''""")
def chunk_catalog(spark, sf_dir):
    rows = chunks(spark, sf_dir, "nct_id", "title", "text", "rank_weight").withColumn("embedding_text", F.lit(None).cast("string"))
    records = rows.groupBy("nct_id").agg(F.min("title").alias("display_title"), F.count(F.lit(1)).alias("n")).where("n > 3").withColumn("overall_status", F.col("n").cast("string"))
    return files.chunk_catalog(rows, records).select("chunk_id", "nct_id", "display_title", "overall_status", "rank_weight")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS pmid, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE coalesce(n_name, '') END AS title, coalesce(r_name, '') AS abstract FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20 LEFT JOIN region ON r_regionkey = n_regionkey")
def calc_catalog(spark, sf_dir):
    calculators = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("pmid"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("").alias("title"), "s_nationkey")
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 20").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    metadata = calculators.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("pmid", F.col("n_name").alias("t"), F.col("r_name").alias("a"))
    return files.calculator_catalog(calculators, metadata).select("pmid", "title", "abstract")


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def sink_jsonl(spark, sf_dir):
    folder = shared_folder(spark, "jsonl")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    files.write_jsonl(rows, folder, ["c_mktsegment"])
    read = files.read_jsonl(spark, f"{folder}/*", "c_custkey bigint, c_name string, c_acctbal double")
    return read.join(rows.select("c_custkey", "c_mktsegment"), "c_custkey")


@query("SELECT n_nationkey, n_name, CAST(n_nationkey % 3 AS BIGINT) AS n_tags FROM nation")
def tsv_index(spark, sf_dir):
    folder = shared_folder(spark, "tsv")
    tags = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), F.col("n_nationkey") % 3)
    files.write_tsv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", tags.alias("tags")), folder)
    return files.read_tsv(spark, folder, ("tags",), ("n_nationkey",)).select("n_nationkey", "n_name", F.size("tags").cast("bigint").alias("n_tags"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def record_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    folder = shared_folder(spark, "blocks")
    files.format_blocks(rows, "s_suppkey").select("block").write.text(folder)  # one file per task
    written = spark.read.text(folder, wholetext=True)
    return files.parse_blocks(written, "value", "s_suppkey bigint, s_name string, s_acctbal double")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS case_id, '{}' AS expected, o_orderpriority AS notes FROM orders")
def eval_cases(spark, sf_dir):
    folder = shared_folder(spark, "cases")
    case = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("case_id"), F.struct(F.col("o_totalprice").alias("price")).alias("structured_case"), F.col("o_orderpriority").alias("notes")))
    lines = table(spark, sf_dir, "orders").select(F.explode(F.array(F.lit("# a remark"), F.lit("  "), case)).alias("value"))
    lines.write.text(folder)
    return files.read_eval_cases(spark, folder).select("case_id", "expected", "notes")


@query("SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_topics, count(DISTINCT o_orderkey) AS n_docs, round(avg(CASE WHEN o_orderkey % 4 IN (1, 2) THEN 1.0 ELSE 0.0 END), 4) AS positive_fraction FROM orders")
def qrels_file(spark, sf_dir):
    folder = shared_folder(spark, "qrels")
    line = F.concat_ws(" ", F.col("o_custkey").cast("string"), F.lit("0"), F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 4).cast("string"))
    table(spark, sf_dir, "orders").select(F.explode(F.array(line, F.lit("odd line"))).alias("value")).write.text(folder)
    return files.qrels_profile(files.read_qrels(spark, folder))


@query("SELECT n_nationkey AS number, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'glaucoma' END AS template, CASE WHEN n_nationkey % 2 = 0 THEN 'case of ' || n_name ELSE '' END AS text, CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS nation FROM nation")
def topics_stats(spark, sf_dir):
    folder = shared_folder(spark, "topics")
    key, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    free = F.concat(F.lit('<topic number="'), key, F.lit('">\n case  of '), name, F.lit("\n</topic>"))
    filled = F.concat(F.lit('<topic number="'), key, F.lit('" template="glaucoma"><field name="nation">'), name, F.lit("</field></topic>"))
    topics = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, free).otherwise(filled).alias("value"))
    # One well-formed file: the table has a fixed number of rows.
    topics.agg(F.concat(F.lit("<topics>"), F.array_join(F.collect_list("value"), "\n"), F.lit("</topics>")).alias("value")).write.text(folder)
    return files.read_topics(spark, folder).select("number", "template", "text", F.try_element_at("fields", F.lit("nation")).alias("nation"))


@query("""SELECT c_custkey AS nct_id, c_mktsegment AS department_tag, 'primary' AS department_role FROM customer UNION ALL SELECT c_custkey, 'HOUSEHOLD', 'secondary' FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'""")
def dept_package(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    index = rows.select(F.col("c_custkey").alias("nct_id"), F.col("c_mktsegment").alias("primary_department"), F.array(F.lit("HOUSEHOLD")).alias("secondary_departments"))
    return files.department_package(index, rows.select(F.col("c_custkey").alias("nct_id"), "c_name")).select("nct_id", "department_tag", "department_role")


# Lexicons -------------------------------------------------------------------------------------

# A small lexicon of request types.
BUCKETS = {
    "screening_diagnosis": ("diagnos", "screen", "detect", "imaging"),
    "treatment_selection": ("therapy", "treatment", "chemotherapy", "radiotherapy"),
    "monitoring_followup": ("follow-up", "monitor", "adverse", "complication"),
    "prognosis_counseling": ("prognosis", "survival", "mortality", "progression-free"),
}
TERMS = {"diabetes": r"\bdiabetes\b|\bT2DM\b", "hypertension": r"\bhypertension\b", "dialysis": r"\bdialysis\b", "insulin": r"\binsulin\b"}
CONCEPTS = {"lung_cancer": ("non-small cell lung cancer", "NSCLC", "small cell lung carcinoma"), "heart_failure": ("HFrEF", "heart failure"), "kidney_disease": ("ESRD", "CKD", "chronic kidney disease")}


def _label_sql() -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '{'|'.join(lexicon.keyword_pattern(k) for k in words)}') THEN '{label}' END" for label, words in BUCKETS.items())
    return f"SELECT doc_id, coalesce(nullif(array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ','), ''), 'other') AS labels FROM documents"


@query(_label_sql())
def taxonomy(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.array_join(lexicon.labels(F.col("text"), BUCKETS, "other"), ",").alias("labels"))


@query("SELECT * FROM (SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\bdiagnos[a-z0-9]*\\b|\\bscreen[a-z0-9]*\\b|\\bdetect[a-z0-9]*\\b|\\bimaging[a-z0-9]*\\b') THEN 4.0 ELSE 0.0 END + CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END AS score FROM documents) WHERE score > 0")
def taxonomy_pool(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", lexicon.labels(F.col("text"), BUCKETS).alias("buckets"), F.array("lang").alias("langs"))
    score = lexicon.overlap_score({"buckets": ["screening_diagnosis"], "langs": ["en"]}, {"buckets": 4.0, "langs": 1.0})
    return rows.select("doc_id", score.alias("score")).where("score > 0")


@query("SELECT doc_id, term FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS term FROM documents WHERE len(list_filter(regexp_split_to_array(text, '[.;\\n,]+'), lambda c: regexp_matches(c, '(?i){p}'))) > 0" for n, p in TERMS.items()) + ")")
def term_detect(spark, sf_dir):
    return lexicon.term_flags(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", TERMS).select("doc_id", "term")


_CUES = "\\b(?:" + "|".join(c.replace("'", "''") for c in lexicon.NEGATION_CUES) + ")\\b"
_BROKEN = f"regexp_replace(c, '(?i)[,;:()\\[\\]]|\\b(?:{'|'.join(lexicon.SCOPE_BREAKS)})\\b', chr(1), 'g')"


def _negation_sql(name: str, term: str) -> str:
    reach = f"[^\\x01]{{0,{lexicon.SCOPE}}}?"
    negated = f"(NOT regexp_matches(c, '(?i)\\b(?:{'|'.join(lexicon.QUESTIONS)})\\b') AND (regexp_matches({_BROKEN}, '(?i){_CUES}{reach}(?:{term})') OR regexp_matches({_BROKEN}, '(?i)(?:{term}){reach}{_CUES}')))"
    return f"SELECT doc_id, '{name}' AS term, bool_or(NOT n) AS positive, bool_or(n) AS negative FROM (SELECT doc_id, {negated} AS n FROM clauses WHERE regexp_matches(c, '(?i){term}')) GROUP BY doc_id"


@query("WITH clauses AS (SELECT doc_id, unnest(list_transform(regexp_split_to_array(text, '[.;\\n,]+'), lambda p: trim(regexp_replace(p, '" + T.BLANK + "+', ' ', 'g')))) AS c FROM documents) " + " UNION ALL ".join(_negation_sql(n, p) for n, p in TERMS.items()))
def negation_flags(spark, sf_dir):
    return lexicon.term_flags(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", TERMS)


@query(" UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS concept, alias FROM (SELECT doc_id, coalesce(" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9]){a}($|[^A-Za-z0-9])') THEN '{a}' END" for a in listed) + ") AS alias FROM documents) WHERE alias IS NOT NULL"
    for c, listed in CONCEPTS.items()
))
def concepts(spark, sf_dir):
    return lexicon.alias_concepts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", CONCEPTS)


@query("""SELECT doc_id, CASE WHEN age > 0 AND age < 130 THEN age END AS age, CASE WHEN regexp_matches(lower(text), '\\b(female|woman|girl)\\b|女') THEN 'female' WHEN regexp_matches(lower(text), '\\b(male|man|boy)\\b|男') THEN 'male' END AS sex
FROM (SELECT doc_id, text, TRY_CAST(coalesce(nullif(regexp_extract(text, '(?i)\\b(\\d{1,3})\\s*[- ]?\\s*years?[- ]old\\b|(\\d{1,3})\\s*岁', 1), ''), nullif(regexp_extract(text, '(?i)\\b(\\d{1,3})\\s*[- ]?\\s*years?[- ]old\\b|(\\d{1,3})\\s*岁', 2), '')) AS INT) AS age FROM documents)""")
def age_sex(spark, sf_dir):
    age, sex = lexicon.age_sex(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", age.alias("age"), sex.alias("sex"))


_SPECIALTY = ("Pediatrics", "General Surgery", "Emergency Medicine", "Oncology; geriatrics", "Intensive Care")
_AT = "list_extract([" + ", ".join(f"'{x}'" for x in _SPECIALTY) + "], CAST(doc_id % 7 + 1 AS INT))"


def _flat_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{T.BLANK}+', ' ', 'g'))"


def _first_sql(x: str) -> str:
    sentence = f"coalesce(nullif(regexp_extract({_flat_sql(x)}, '^(.*?[.!?])( |$)', 1), ''), {_flat_sql(x)})"
    return f"CASE WHEN length({sentence}) <= 220 THEN {sentence} ELSE regexp_replace(substring({sentence}, 1, 217), '[ ,;:]+$', '') || '...' END"


def _found_sql(mapping: dict[str, tuple[str, ...]]) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(t, '{'|'.join(lexicon.keyword_pattern(k) for k in words)}') THEN '{label}' END" for label, words in mapping.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


@query(f"""WITH s AS (SELECT doc_id, lower(concat_ws(' ', trim(coalesce(text, '')), coalesce({_AT}, ''))) AS t, lower(coalesce({_AT}, '')) AS sp FROM documents),
l AS (SELECT doc_id, {_found_sql(taxonomies.DOMAINS)} AS d, {_found_sql(taxonomies.SEGMENTS)} AS p, {_found_sql(taxonomies.BUCKETS)} AS b, {_found_sql(taxonomies.FAMILIES)} AS f,
  [{', '.join(f"CASE WHEN contains(sp, '{w}') THEN '{x}' END" for w, x in taxonomies.SPECIALTIES)}] AS a, TRY_CAST(nullif(regexp_extract(t, '{taxonomies.AGE}', 1), '') AS INT) AS age FROM s),
g AS (SELECT doc_id, d, list_filter(p || a || [CASE WHEN age < 1 THEN 'neonatal' WHEN age < 18 THEN 'pediatric' WHEN age >= 65 THEN 'older_adult' END], lambda x: x IS NOT NULL) AS p, b, CASE WHEN len(f) = 0 THEN ['risk_score'] ELSE f END AS f FROM l)
SELECT doc_id, array_to_string(list_sort(d), ',') AS clinical_domains, array_to_string(list_sort(list_distinct(p)), ',') AS patient_segments, CASE WHEN len(b) > 0 THEN array_to_string(list_sort(b), ',') ELSE coalesce({', '.join(f"CASE WHEN list_contains(f, '{x}') THEN '{y}' END" for x, y in taxonomies.FAMILY_BUCKETS)}, '') END AS protocol_buckets, array_to_string(list_sort(f), ',') AS calculator_families FROM g""")
def taxonomy_full(spark, sf_dir):
    """Four kinds of labels of every document, a specialty by its number."""
    special = F.get(F.array(*[F.lit(x) for x in _SPECIALTY]), (F.col("doc_id") % 7).cast("int"))
    found = taxonomies.classify(F.col("text"), special)
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *[F.array_join(F.array_sort(v), ",").alias(k) for k, v in found.items()])


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'risk_hint' WHEN 'signup' THEN 'problem_anchor' WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 'case_summary' ELSE 'protocol_mapping' END ELSE 'general' END AS channel FROM events""")
def query_channel(spark, sf_dir):
    kind = F.col("event_type")
    stage = F.when(kind == "click", "Risk_Hint_3").when(kind == "signup", " x").when((kind == "purchase") & (F.col("user_id") % 2 == 0), "coarse_question ")
    intent = F.when(kind == "signup", "PROBLEM_anchor").when((kind == "purchase") & (F.col("user_id") % 2 == 1), "protocol_matching").otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", taxonomies.query_channel(stage, intent).alias("channel"))


@query(f"""WITH d AS (SELECT doc_id, {_flat_sql('title')} AS t, {_first_sql('text')} AS s, source FROM documents), l AS (SELECT doc_id, t, s FROM d)
SELECT doc_id, concat_ws(chr(10), CASE WHEN t <> '' THEN 'title: ' || t END, CASE WHEN s <> '' THEN 'primary task: ' || s END, CASE WHEN trim(coalesce(source, '')) <> '' THEN 'specialty: ' || {_flat_sql('source')} END, CASE WHEN doc_id % 2 = 0 THEN 'clinical domain: heart valve' END,
  'calculator family: risk prediction, odd family', CASE WHEN doc_id % 3 = 0 THEN 'protocol focus: screening and diagnosis' END, 'inputs: age, x' || doc_id, CASE WHEN s <> '' THEN 'decision focus: ' || s ELSE 'decision focus: Use it.' END) AS calculator,
  concat_ws(chr(10), CASE WHEN t <> '' THEN 'title: ' || t END, CASE WHEN t <> '' THEN 'conditions: ' || t || ', Gout' ELSE 'conditions: Gout' END, CASE WHEN {_flat_sql('source')} <> '' THEN 'study profile: ' || {_flat_sql('source')} || '; II' ELSE 'study profile: II' END, CASE WHEN {_flat_sql('text')} <> '' THEN 'summary: ' || {_flat_sql('text')} END) AS trial FROM l JOIN documents USING (doc_id)""")
def retrieval_text(spark, sf_dir):
    """Search texts of calculators and trials made of the documents' fields."""
    strings = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    none = F.lit(None).cast("array<string>")
    labels = {
        "clinical_domains": F.when(F.col("doc_id") % 2 == 0, strings("heart_valve")), "patient_segments": none, "calculator_families": strings("risk_score", "odd_family"),
        "protocol_buckets": F.when(F.col("doc_id") % 3 == 0, strings("screening_diagnosis")),
    }
    fields = {"title": F.col("title"), "purpose": F.col("text"), "specialty": F.col("source"), "interpretation": F.col("text"), "utility": F.lit("Use it. Often.")}
    calculator = texts.calculator_text(fields, labels, F.array(F.lit("age"), F.concat(F.lit("x"), F.col("doc_id").cast("string"))))
    trial = texts.trial_text({"title": F.col("title"), "study_type": F.col("source"), "phase": F.lit("II"), "brief_summary": F.col("text")}, {"conditions": F.array("title", F.lit("Gout"), "title", F.lit(" ")), "keywords": none})
    return spread(table(spark, sf_dir, "documents").select("doc_id", "title", "text", "source")).select("doc_id", calculator.alias("calculator"), trial.alias("trial"))


# Structured cases and score rules -------------------------------------------------------------


@query(
    """SELECT event_id, concat_ws('|', 'k: ' || json_extract_string(props, '$.k'), 'list[1]: ' || event_type, 'list[2].deep: ' || user_id, CASE WHEN user_id % 3 = 0 THEN 'list[2].odd[1]: a b' END, 'value: ' || CAST(event_id % 7 AS VARCHAR)) AS leaves,
concat_ws('|', 'item[1]: ' || event_type, 'item[2].id: ' || event_id) AS top FROM events"""
)
def flatten_inputs(spark, sf_dir):
    deep = F.concat(F.lit('{"deep": '), F.col("user_id").cast("string"), F.lit(', "odd": ['), F.when(F.col("user_id") % 3 == 0, F.lit('" a \\n  b "')).otherwise("null"), F.lit("]}"))
    nested = F.concat(
        F.regexp_replace("props", r"\}$", ""), F.lit(', "list": ["'), F.col("event_type"), F.lit('", '), deep, F.lit(', null], "blank": " ", "value": '), (F.col("event_id") % 7).cast("string"), F.lit("}")
    )
    top = F.concat(F.lit('["'), F.col("event_type"), F.lit('", {"id": '), F.col("event_id").cast("string"), F.lit(', "none": null}, ""]'))
    joined = lambda c: F.array_join(structured.flatten_json(c), "|")
    return table(spark, sf_dir, "events").select("event_id", joined(nested).alias("leaves"), joined(top).alias("top"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'size_' || p_size || ',brand,age' ELSE 'brand' END AS names, concat_ws(',', 'x' || p_partkey || 'y', 'age', 'crp', CASE WHEN p_size % 2 = 0 THEN 'serum_sodium' END) AS told, '' AS nothing FROM part")
def param_names(spark, sf_dir):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    code = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("import math\ndef score_"), key, F.lit("(size_"), size, F.lit(", brand, *, age=4):\n    return 1\ndef other(x):\n    return x\n"))).otherwise("def f(brand):\n  return 1")
    prose = F.concat(
        F.lit("Parameters include x"), key, F.lit("y, the patient's age and C-reactive protein (mg/L).\n"), F.when(F.col("p_size") % 2 == 0, "- Serum sodium: 2 points\n- score: 1 point\n").otherwise("- \n"), F.lit("Risk = 2 x age + 3 * log(CRP)"),
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(structured.parameter_names(code), ",").alias("names"), F.array_join(structured.parameter_names(F.lit(""), prose), ",").alias("told"), F.array_join(structured.parameter_names(F.col("p_name")), ",").alias("nothing")
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, 1 AS n_kept FROM events")
def input_filter(spark, sf_dir):
    given = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("other"), F.lit("1"), F.lit("age"), F.lit(" ")))
    kept = structured.declared_only(given, F.array(F.lit("k"), F.lit("age")))
    return table(spark, sf_dir, "events").select("event_id", F.element_at(kept, "k").alias("k"), F.size(kept).alias("n_kept"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN length(t) > 1200 AND h <> '' THEN h ELSE t END, CASE WHEN lower(h) <> lower(CASE WHEN length(t) > 1200 AND h <> '' THEN h ELSE t END) THEN h END], lambda x: x IS NOT NULL AND x <> ''), chr(10)) AS query_text
FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '""" + T.BLANK + """+', ' ', 'g')) AS t, trim(regexp_replace(coalesce(title, ''), '""" + T.BLANK + """+', ' ', 'g')) AS h FROM documents)""")
def query_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", structured.query_text(F.col("text"), F.col("title"), F.array("title"), F.lit(None).cast("array<string>")).alias("query_text"))


PROSE = """The score adds points.
- Size at least 30: 2 points
- Retail price > 1500 (3 points)
- Brand is present: 1 points
* size less than 10: -1 points
2. Weight 20 cm or more (4 points)
"""
PROSE_SHARED = """Each of these is assigned 2 points if it holds.
1. Age ≥ 40 years
2. Male sex
3. Non-white ethnicity
4. Total discount
5. Quantity over 30 (5 points).
"""


@query("SELECT p_partkey, CASE WHEN p_size >= 30 THEN 2.0 ELSE 0.0 END + CASE WHEN p_retailprice > 1500 THEN 3.0 ELSE 0.0 END + CASE WHEN p_brand <> '' THEN 1.0 ELSE 0.0 END - CASE WHEN p_size < 10 THEN 1.0 ELSE 0.0 END + CASE WHEN p_partkey % 40 >= 20 THEN 4.0 ELSE 0.0 END AS score FROM part")
def prose_score(spark, sf_dir):
    compiled = rules.parse_rules(PROSE)
    values = {"size": F.col("p_size"), "retail_price": F.col("p_retailprice"), "brand_is_present": F.col("p_brand"), "weight": F.concat(F.lit("about "), (F.col("p_partkey") % 40).cast("string"), F.lit(" cm"))}
    return table(spark, sf_dir, "part").select("p_partkey", rules.score(compiled, values).alias("score"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber * 10 >= 40 THEN 2.0 ELSE 0.0 END + CASE WHEN l_returnflag = 'A' THEN 2.0 ELSE 0.0 END
+ CASE WHEN l_linestatus = 'O' THEN 2.0 ELSE 0.0 END + CASE WHEN l_discount <> 0 THEN 2.0 ELSE 0.0 END + CASE WHEN l_quantity > 30 THEN 5.0 ELSE 0.0 END AS score FROM lineitem"""
)
def prose_score_shared(spark, sf_dir):
    compiled = rules.parse_rules(PROSE_SHARED)
    values = {
        "age": F.col("l_linenumber") * 10, "sex": F.when(F.col("l_returnflag") == "A", "Man").when(F.col("l_returnflag") == "N", "girl"),
        "non_white_ethnicity": F.when(F.col("l_linestatus") == "O", "Black").otherwise("Declined"), "total_discount": F.col("l_discount"), "quantity": F.col("l_quantity"),
    }
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.score(compiled, values).alias("score"))


@query(
    """SELECT span_id, coalesce(nullif(trim(value), ''), '36.8') AS value, coalesce(nullif(trim(unit), ''), 'C') AS unit,
array_to_string(list_filter([CASE WHEN trim(coalesce(unit, '')) = '' THEN 'unit' END, CASE WHEN trim(coalesce(value, '')) = '' THEN 'value' END], lambda x: x IS NOT NULL), ',') AS used,
CASE WHEN trim(coalesce(normalized_concept, '')) = '' THEN 'missing_inputs' ELSE 'completed' END AS status FROM evidence_spans"""
)
def calc_defaults(spark, sf_dir):
    given = {"value": F.trim("value"), "unit": F.trim("unit"), "concept": F.col("normalized_concept")}
    filled, used = rules.with_defaults(given, {"value": 36.8}, {"value": 1.0, "unit": "C"})
    return table(spark, sf_dir, "evidence_spans").select(
        "span_id", filled["value"].alias("value"), filled["unit"].alias("unit"), F.array_join(used, ",").alias("used"), rules.run_status(filled, ["value", "unit", "concept"]).alias("status")
    )


# Streams --------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.read_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, sf_dir):
    counted = streams.counted_windows(_events(spark, sf_dir), shared_folder(spark, "counts"), shared_folder(spark, "stream"), "ts", ["event_type"])
    return counted.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def stream_latest(spark, sf_dir):
    rows = streams.upsert_stream(_events(spark, sf_dir).select("user_id", "event_id", "ts", "value"), shared_folder(spark, "latest"), shared_folder(spark, "stream"), "user_id", ["ts", "event_id"])
    return rows.drop("ts")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_upsert(spark, sf_dir):
    sink, checkpoint = shared_folder(spark, "upsert"), shared_folder(spark, "stream")
    events = _events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")
    streams.upsert_stream(events, sink, checkpoint, "event_id", ["ts"])
    return streams.upsert_stream(events, sink, checkpoint, "event_id", ["ts"]).drop("ts")
