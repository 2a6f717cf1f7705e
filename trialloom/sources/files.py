"""Line, JSON and tab-separated files: catalogs, evaluation cases, record blocks, qrels, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """One JSON object a line, null fields kept, replacing what is there."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Lines of JSON by a fixed schema; blank lines and lines that are no JSON are dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    kind = schema if isinstance(schema, str) else schema.simpleString()
    parsed = lines.select(F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"))
    return parsed.where("ok").select("r.*")


def chunk_catalog(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """Chunks with the title and status of their record; chunks without an id or trial are dropped.

    A chunk of an unknown trial stays, with nulls; an empty embedding text is the
    text, a missing or zero weight 1.
    """
    kept = chunks.where((F.trim("chunk_id") != "") & (F.trim("nct_id") != ""))
    wide = kept.join(records.select("nct_id", "display_title", "overall_status"), "nct_id", "left")
    embedding = F.coalesce(F.nullif(F.col("embedding_text"), F.lit("")), F.col("text"))
    return wide.withColumn("embedding_text", embedding).withColumn("rank_weight", F.coalesce(F.nullif(F.col("rank_weight"), F.lit(0.0)), F.lit(1.0)))


def keyed_objects(spark: SparkSession, path: str, value_type: str, key: str = "id") -> DataFrame:
    """A JSON file that is one object of objects, as rows: its key, its fields and its file's path."""
    whole = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("path"))
    rows = whole.select("path", F.explode(F.from_json("value", f"map<string,{value_type}>")).alias(key, "v"))
    return rows.select(key, "v.*", "path")


def calculator_catalog(calculators: DataFrame, metadata: DataFrame) -> DataFrame:
    """Calculators with title and abstract of their publication where they have none of their own."""
    meta = metadata.select("pmid", F.col("t").alias("__t"), F.col("a").alias("abstract"))
    wide = calculators.join(meta, "pmid", "left")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("__t"), F.lit(""))
    return wide.withColumn("title", title).withColumn("abstract", F.coalesce("abstract", F.lit(""))).drop("__t")


def department_catalog(spark: SparkSession, root: str, value_type: str, file_name: str = "trials.json") -> DataFrame:
    """The trials of every ``<department>/<file_name>``, with their department as ``department_tag``."""
    rows = keyed_objects(spark, f"{root.rstrip('/')}/*/{file_name}", value_type, "key")
    own = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    tag = F.coalesce(F.nullif(F.trim("department_tag"), F.lit("")), own) if "department_tag" in rows.columns else own
    nct = F.coalesce(F.nullif(F.trim("nct_id"), F.lit("")), F.col("key")) if "nct_id" in rows.columns else F.col("key")
    return rows.withColumn("department_tag", tag).withColumn("nct_id", nct).drop("key", "path").where(F.trim("nct_id") != "")


def csv_cell(cell: Column) -> Column:
    """The items of a cell of comma-separated values, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ","), F.trim), lambda x: x != "")


def read_tsv(spark: SparkSession, path: str, list_columns: tuple[str, ...] = (), int_columns: tuple[str, ...] = ()) -> DataFrame:
    """A tab-separated file with a header, without quoting; some columns as lists, some as numbers (blank: 0)."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    out = []
    for c in rows.columns:
        text = F.trim(F.coalesce(F.col(c), F.lit("")))
        out.append((csv_cell(F.col(c)) if c in list_columns else F.coalesce(text.try_cast("int"), F.lit(0)) if c in int_columns else text).alias(c))
    return rows.select(*out)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header, lists joined by commas, replacing what is there."""
    flat = [F.array_join(c, ",").alias(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def department_package(index: DataFrame, trials: DataFrame) -> DataFrame:
    """One row per trial and department of the index, the primary one first: the rows of the department files."""
    tags = F.concat(F.array("primary_department"), F.filter("secondary_departments", lambda d: d != F.col("primary_department")))
    rows = index.join(trials, "nct_id").withColumn("department_tags", F.array_distinct(F.filter(tags, lambda d: d != "")))
    rows = rows.select("*", F.posexplode("department_tags").alias("__at", "department_tag"))
    return rows.withColumn("department_role", F.when(F.col("__at") == 0, "primary").otherwise("secondary")).drop("__at")


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, structured_case, expected, notes) of evaluation cases, one JSON object a line.

    Blank lines and lines that begin with # are skipped; a line that is no object,
    or has no case_id or structured_case, is an error. A missing ``expected`` is {}.
    """
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    field = lambda name: F.get_json_object("value", f"$.{name}")
    fine = F.try_parse_json("value").isNotNull() & (F.coalesce(F.trim(field("case_id")), F.lit("")) != "") & F.coalesce(F.ltrim(field("structured_case")).startswith("{"), F.lit(False))
    checked = F.when(fine, field("case_id")).otherwise(F.raise_error(F.concat(F.lit("not an evaluation case: "), F.substring("value", 1, 80))))
    return lines.select(checked.cast("string").alias("case_id"), field("structured_case").alias("structured_case"), F.coalesce(field("expected"), F.lit("{}")).alias("expected"), field("notes").alias("notes"))


def format_blocks(df: DataFrame, key: str, label: str = "RESULT") -> DataFrame:
    """One framed text block per row, its fields as JSON between a BEGIN and an END line."""
    body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    frame = lambda edge: F.concat(F.lit(f"=== {label} "), F.col(key).cast("string"), F.lit(f" {edge} ==="))
    return df.select(F.col(key), F.concat_ws("\n", frame("BEGIN"), body, frame("END")).alias("block"))


def parse_blocks(text: DataFrame, column: str, schema: str, label: str = "RESULT") -> DataFrame:
    """The records of framed blocks in texts; blocks that aren't closed or hold no object are dropped."""
    found = F.regexp_extract_all(column, F.lit(rf"(?ms)^=== {label} (\S+) BEGIN ===\n(.*?)\n=== {label} \1 END ===$"), F.lit(2))
    bodies = text.select(F.explode(found).alias("body")).where(F.ltrim("body").startswith("{") & F.try_parse_json("body").isNotNull())
    return bodies.select(F.from_json("body", schema).alias("r")).select("r.*")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(topic, doc_id, label) of relevance judgements: lines of four fields, others dropped."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") == 4)
    return parts.select(F.col("p")[0].alias("topic"), F.col("p")[2].alias("doc_id"), F.col("p")[3].alias("label"))


def qrels_profile(qrels: DataFrame) -> DataFrame:
    """(n_rows, n_topics, n_docs, positive_fraction) of judgements; labels 1 and 2 are positive."""
    positive = F.sum(F.col("label").isin("1", "2").cast("int"))
    return qrels.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("topic").alias("n_topics"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.coalesce(F.try_divide(positive, F.count(F.lit(1))), F.lit(0.0)), 4).alias("positive_fraction"))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(number, template, text, fields) of topics in XML: free text, or a template's named fields."""
    schema = "_number int, _template string, _VALUE string, field array<struct<_name:string,_VALUE:string>>"
    rows = spark.read.format("xml").option("rowTag", "topic").schema(schema).load(path)
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    fields = F.map_from_entries(F.transform(F.coalesce("field", F.array().cast("array<struct<_name:string,_VALUE:string>>")), lambda f: F.struct(f["_name"], flat(f["_VALUE"]))))
    return rows.select(F.col("_number").alias("number"), F.coalesce("_template", F.lit("")).alias("template"), flat(F.col("_VALUE")).alias("text"), fields.alias("fields"))


def matching_lines(df: DataFrame, keys: list[str], text: str, query: str, ignore_case: bool = False) -> DataFrame:
    """(keys, line_no, column_no, line) of every line of a text column that holds ``query``, counted from 1; null texts have none."""
    same = F.lower if ignore_case else (lambda c: c)
    wanted = F.lit(query.lower() if ignore_case else query)
    lines = df.where(F.contains(same(F.col(text)), wanted)).select(*keys, F.posexplode(F.split(text, r"\r\n|[\r\n]")).alias("at", "line"))
    found = F.instr(same(F.col("line")), query.lower() if ignore_case else query)
    return lines.where(F.contains(same(F.col("line")), wanted)).select(*keys, (F.col("at") + 1).alias("line_no"), found.alias("column_no"), F.rtrim("line").alias("line"))


def grep(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(path, line_no, column_no, line) of every line of the files below a path that holds a text."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return matching_lines(files, ["path"], "value", query)
