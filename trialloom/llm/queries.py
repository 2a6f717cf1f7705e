"""The pN_ queries of the problems tagged llm, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.llm import packing, splitting, subjects, survivors, tokens, top_n
from trialloom.session import bounded_broadcast, spread, table

CAPACITY = 1024


def normal_nct(raw: Column) -> Column:
    """A trial number as NCT and 8 digits, null if there aren't 8."""
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    return F.when(F.length(digits) == 8, F.concat(F.lit("NCT"), digits))


# 1 ------------------------------------------------------------------------------------------


def p1_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nct_id, chunk_id, score and position of the three best chunks of every trial."""
    hits = table(spark, sf_dir, "chunk_hits").where(F.col("nct_id").isNotNull()).select("nct_id", "chunk_id", "score")
    return top_n.top_n_per_group(hits, ["nct_id"], "score", ["chunk_id"], 3)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_ranked(spark, sf_dir).select("nct_id", "chunk_id")


# 2 ------------------------------------------------------------------------------------------


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk and section text as pieces within the limit of its type."""
    limits = table(spark, sf_dir, "chunk_limits")
    chunks = table(spark, sf_dir, "trial_chunks").groupBy("chunk_id").agg(F.max_by("text", F.struct("loaded_at", "text")).alias("text"))
    chunks = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_key"), "text", F.lower(F.trim(F.get(F.split("chunk_id", "::"), 1))).alias("chunk_type"))
    sections = spread(table(spark, sf_dir, "eligibility_sections").select("section_id", "section_type", "raw_text")).select(
        F.lit("section").alias("item_kind"), F.col("section_id").cast("string").alias("item_key"), F.col("raw_text").alias("text"),
        F.concat(F.lit("eligibility_"), F.coalesce(F.lower(F.trim("section_type")), F.lit("unknown"))).alias("chunk_type"),
    )
    items = chunks.unionByName(sections).join(bounded_broadcast(limits), "chunk_type", "left")
    return splitting.split_oversized(items, ["item_kind", "item_key"], "text", "max_chars", "overlap_chars")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where((F.col("n_pieces") > 1) & (F.col("piece_no") == 1)).select("item_kind", "item_key")


# 3 ------------------------------------------------------------------------------------------


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    trust = table(spark, sf_dir, "corpus_trust")
    sources = table(spark, sf_dir, "trial_xml_sources").select("source_id", "source_corpus", "source_member_path", "input_path")
    named = F.lower(F.regexp_replace(F.trim("source_corpus"), r"[\s_-]+", "_"))
    sources = sources.select(
        "source_id", F.when(F.length(named) > 0, named).alias("corpus"), F.split("input_path", "/").alias("steps"),
        normal_nct(F.regexp_extract("source_member_path", r"(?i)NCT[^0-9/]*([0-9]{8})[^/]*$", 1)).alias("path_nct"),
    )
    by_dir = trust.select("corpus_dir", F.col("source_corpus").alias("dir_corpus"))
    # corpus_trust is a fixed table of a few rows; the bound is checked before it is broadcast.
    sources = sources.join(bounded_broadcast(by_dir), F.col("corpus").isNull() & F.array_contains("steps", F.col("corpus_dir")), "left")
    sources = sources.select("source_id", F.coalesce("corpus", "dir_corpus").alias("corpus"), "path_nct")
    sources = sources.join(bounded_broadcast(trust.select(F.col("source_corpus").alias("corpus"), "trust_rank")), "corpus", "left")
    sections = table(spark, sf_dir, "eligibility_sections").select("section_id", "source_id", "nct_id", "section_type", "heading_text", "raw_text", "end_offset", "extracted_at")
    claims = sections.join(sources, "source_id", "left").withColumn("nct_id", F.coalesce(normal_nct(F.col("nct_id")), "path_nct"))
    kind = F.lower(F.trim("section_type"))
    claims = claims.withColumn("section_type", F.when(F.length(kind) > 0, kind).otherwise("unknown"))
    names = [r.source_corpus for r in trust.orderBy("trust_rank").limit(survivors.MAX_SOURCES).collect()]  # one too many is an error of fuse_fields
    return claims, names


def _fused(spark: SparkSession, sf_dir: str, policy: str) -> survivors.Fused:
    claims, names = _claims(spark, sf_dir)
    return survivors.fuse_fields(
        claims, ["nct_id", "section_type"], "section_id", {c: F.col(c) for c in ("heading_text", "raw_text", "end_offset")}, "corpus", names,
        [F.col("trust_rank"), -F.unix_micros(F.col("extracted_at").cast("timestamp"))], cut_off_field="raw_text", policy=policy,
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "ranked").survivors.select("nct_id", "section_type", "field_name", "section_id")


def p3_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most probable value of each field by Bayesian fusion, with its posterior."""
    return _fused(spark, sf_dir, "posterior").survivors.select("nct_id", "section_type", "field_name", "section_id", "n_values", F.round("posterior", 6).alias("posterior"))


# 6 ------------------------------------------------------------------------------------------


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


# 7 ------------------------------------------------------------------------------------------


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with the container of 1,024 tokens they are in."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    sized = tokens.count_tokens(documents, ["doc_id", "source"], "text")
    return packing.pack(sized, "doc_id", "n_tokens", F.col("source"), CAPACITY)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_containers(spark, sf_dir).where((F.col("n_pieces") > 1) & (F.col("piece_no") == 1)).select("doc_id")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill and mixture error by window of all texts packed by source, in the corpus's own mixture."""
    return packing.mixture_report(p7_containers(spark, sf_dir), CAPACITY)


#: Shares of languages that p7_targets asks for.
LANGUAGE_TARGETS = {"en": 0.5, "de": 0.15, "es": 0.15, "fr": 0.1, "zh": 0.1}


def p7_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill and mixture error of all texts packed to set shares of languages; what is over comes in a second row."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    sized = tokens.count_tokens(documents, ["doc_id", "lang"], "text")
    return packing.mixture_report(packing.pack(sized, "doc_id", "n_tokens", F.lower(F.trim("lang")), CAPACITY, targets=LANGUAGE_TARGETS), CAPACITY)


# 8 ------------------------------------------------------------------------------------------


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of every document, by thresholds calibrated on the labelled ones."""
    labels = table(spark, sf_dir, "doc_subject_labels").select("doc_id", "subject_code")
    found = subjects.assign_subjects(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", labels=labels)
    areas = bounded_broadcast(table(spark, sf_dir, "subject_areas").select("subject_code"))
    return found.select("doc_id", "subject_code").join(areas, "subject_code", "left_semi").select("doc_id", "subject_code")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents of each subject area."""
    return p8_found(spark, sf_dir).groupBy("subject_code").agg(F.count(F.lit(1)).alias("n_documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_ranked, p2_found, p2_pieces, p3_found, p3_fused, p6_ids, p7_found, p7_containers, p7_mixture, p7_targets, p8_found, p8_composition)
}

_BEST = """
WITH best AS (
  SELECT nct_id, chunk_id, max(score + 0.0) AS score FROM chunk_hits
  WHERE nct_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY nct_id ORDER BY score DESC, chunk_id) AS position FROM best
)
"""
_FLAT = "trim(regexp_replace({0}, '[ \\t\\r\\n]+', ' ', 'g'))"

SQL: dict[str, str] = {
    "p1_found": _BEST + "SELECT nct_id, chunk_id FROM placed WHERE position <= 3",
    "p1_ranked": _BEST + "SELECT nct_id, chunk_id, score, position FROM placed WHERE position <= 3",
    "p2_found": f"""
WITH items AS (
  SELECT DISTINCT 'chunk' AS item_kind, chunk_id AS item_key, text, split_part(chunk_id, '::', 2) AS chunk_type FROM trial_chunks
  UNION ALL
  SELECT 'section', CAST(section_id AS VARCHAR), raw_text, 'eligibility_' || lower(trim(section_type)) FROM eligibility_sections
)
SELECT DISTINCT item_kind, item_key FROM items JOIN chunk_limits USING (chunk_type)
WHERE length({_FLAT.format("text")}) > max_chars
""",
    "p3_found": f"""
WITH src AS (
  SELECT source_id, trust_rank,
    CASE WHEN regexp_matches(source_member_path, '(?i)NCT[^0-9/]*[0-9]{{8}}[^/]*$')
      THEN 'NCT' || regexp_extract(source_member_path, '(?i)NCT[^0-9/]*([0-9]{{8}})[^/]*$', 1) END AS path_nct
  FROM (
    SELECT source_id, source_member_path, coalesce(
      nullif(lower(regexp_replace(trim(source_corpus), '[\\s_-]+', '_', 'g')), ''),
      (SELECT t.source_corpus FROM corpus_trust t WHERE list_contains(string_split(x.input_path, '/'), t.corpus_dir))) AS corpus
    FROM trial_xml_sources x
  ) s LEFT JOIN corpus_trust t ON t.source_corpus = s.corpus
), sec AS (
  SELECT section_id, trust_rank, extracted_at, heading_text, raw_text, end_offset, lower(trim(section_type)) AS section_type,
    coalesce(CASE WHEN length(regexp_replace(nct_id, '[^0-9]', '', 'g')) = 8 THEN 'NCT' || regexp_replace(nct_id, '[^0-9]', '', 'g') END, path_nct) AS nct_id
  FROM eligibility_sections LEFT JOIN src USING (source_id)
), long AS (
  SELECT nct_id, section_type, section_id, trust_rank, extracted_at, f.field_name, {_FLAT.format("f.value")} AS flat
  FROM sec, LATERAL (VALUES ('heading_text', heading_text), ('raw_text', raw_text), ('end_offset', CAST(end_offset AS VARCHAR))) f(field_name, value)
  WHERE nct_id IS NOT NULL
), given AS (
  SELECT * FROM long WHERE regexp_matches(flat, '[\\p{{L}}\\p{{N}}]')
    AND lower(flat) NOT IN ('n/a','n.a.','na','none','null','none given','not provided','unknown','tbd','to be determined','see protocol','[no text]')
), held AS (
  SELECT g.*, field_name = 'raw_text' AND (
      regexp_matches(flat, '(\\[truncated\\]|\\[more\\]|\\[see full protocol\\]|\\(continued\\)|<cut>|<truncated>|<more>|\\.\\.\\.|…)$')
      OR EXISTS (SELECT 1 FROM given o WHERE o.nct_id = g.nct_id AND o.section_type = g.section_type AND o.field_name = 'raw_text'
                 AND length(o.flat) > length(g.flat) AND starts_with(o.flat, g.flat))) AS cut_off
  FROM given g
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY nct_id, section_type, field_name
    ORDER BY cut_off, trust_rank NULLS LAST, extracted_at DESC NULLS LAST, section_id) AS n FROM held
)
SELECT nct_id, section_type, field_name, section_id FROM placed
WHERE n = 1 AND (nct_id, section_type) IN (SELECT (nct_id, section_type) FROM sec GROUP BY nct_id, section_type HAVING count(*) > 1)
""",
}
