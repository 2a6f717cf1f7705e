"""Queries of the text functions, each over all documents or chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.functions import text as T
from trialloom.queries.registry import Registry
from trialloom.session import spread, table
from trialloom.sources import files

query = Registry()

_B = T.BLANK + "+"
#: DuckDB twins of the expressions, over a column or expression x.
_WS = lambda x: f"trim(regexp_replace(coalesce({x}, ''), '{_B}', ' ', 'g'))"
_BLOCK = lambda x: (
    f"replace(replace(regexp_replace(regexp_replace(array_to_string(list_transform(regexp_split_to_array(coalesce({x}, ''), '{T.LINE_END}'), lambda l: {_WS('l')}), chr(10)), '^\\n+|\\n+$', '', 'g'), '\\n\\n+', chr(1), 'g'), chr(10), ' '), chr(1), chr(10) || chr(10))"
)
duck_tokens = lambda x: (
    f"flatten(list_transform(regexp_extract_all(lower(replace(coalesce({x}, ''), '_', ' ')), '{T.TOKEN}'), lambda c: CASE WHEN regexp_matches(c, '^[a-z0-9]') THEN [c] "
    "ELSE flatten(list_transform(range(1, least(length(c), 6) + 1), lambda n: list_transform(range(1, length(c) - n + 2), lambda a: substring(c, a, n)))) || CASE WHEN length(c) > 6 THEN [c] ELSE [] END END))"
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"SELECT doc_id, {_WS('text')} AS norm_text FROM documents")
def norm_ws(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.normalize_whitespace(F.col("text")).alias("norm_text"))


@query(f"SELECT doc_id, {_BLOCK('text')} AS block_text FROM documents")
def norm_block(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.normalize_block(F.col("text")).alias("block_text"))


@query(
    f"""WITH lines AS (
  SELECT doc_id, u.line, u.pos, {_WS('u.line')} AS t FROM documents,
    LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u
), first AS (SELECT doc_id, lower(t) AS k, arg_min(t, pos) AS t, min(pos) AS pos FROM lines WHERE t <> '' GROUP BY ALL)
SELECT d.doc_id, coalesce(array_to_string(list(t ORDER BY pos) FILTER (WHERE t IS NOT NULL), '|'), '') AS lines FROM documents d LEFT JOIN first USING (doc_id) GROUP BY d.doc_id"""
)
def dedupe_ci(spark, sf_dir):
    lines = T.dedupe(F.split("text", "\n"))
    return _documents(spark, sf_dir).select("doc_id", F.array_join(lines, "|").alias("lines"))


@query(
    f"""WITH lines AS (
  SELECT doc_id, u.line, u.pos, {_WS('u.line')} AS t FROM documents,
    LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u
), first AS (SELECT doc_id, t, min(pos) AS pos FROM lines WHERE t <> '' GROUP BY ALL)
SELECT d.doc_id, coalesce(array_to_string(list(t ORDER BY pos) FILTER (WHERE t IS NOT NULL), '|'), '') AS lines FROM documents d LEFT JOIN first USING (doc_id) GROUP BY d.doc_id"""
)
def dedupe_cs(spark, sf_dir):
    lines = T.dedupe(F.split("text", "\n"), ignore_case=False)
    return _documents(spark, sf_dir).select("doc_id", F.array_join(lines, "|").alias("lines"))


@query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {duck_tokens('text')} AS t FROM documents)")
def tokenize(spark, sf_dir):
    tokens = _documents(spark, sf_dir).select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) + len(regexp_extract_all(coalesce(text, ''), '[\\x{4E00}-\\x{9FFF}]')) AS n FROM documents")
def token_count(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.token_count(F.col("text")).cast("bigint").alias("n"))


@query("SELECT chunk_id, greatest(1, CAST(ceil(length(coalesce(text, '')) / 4.0) AS INTEGER)) AS n FROM trial_chunks")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "trial_chunks").select("chunk_id", T.token_estimate(F.col("text")).alias("n"))


@query(
    f"""WITH f AS (SELECT doc_id, {_WS('text')} AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN regexp_extract(t, '^(.*?[.!?])( |$)', 1) = '' THEN t ELSE regexp_extract(t, '^(.*?[.!?])( |$)', 1) END AS s FROM f)
SELECT doc_id, CASE WHEN length(s) <= 220 THEN s ELSE regexp_replace(substring(s, 1, 217), '[ ,;:]+$', '') || '...' END AS sentence FROM s"""
)
def first_sentence(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))


@query("SELECT chunk_id, sha256(chunk_id || '::' || coalesce(text, '')) AS digest FROM trial_chunks")
def digest(spark, sf_dir):
    return table(spark, sf_dir, "trial_chunks").select("chunk_id", T.digest(F.col("chunk_id"), F.col("text")).alias("digest"))


_SHA = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(CASE WHEN trim(chunk_id) = '' THEN '__empty__' ELSE trim(chunk_id) END))"


@query(f"""SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE substr(h, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9'
WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT chunk_id, {_SHA} AS h FROM trial_chunks)""")
def uuid5(spark, sf_dir):
    return table(spark, sf_dir, "trial_chunks").select("chunk_id", T.uuid5(F.col("chunk_id")).alias("point_id"))


@query(f"""WITH RECURSIVE p AS (SELECT section_id, list_filter(string_split({_BLOCK('raw_text')}, chr(10) || chr(10)), lambda x: x <> '') AS a FROM eligibility_sections),
walk AS (SELECT section_id, a, 1 AS i, 0 AS piece_no, a[1] AS piece FROM p WHERE len(a) > 0
  UNION ALL SELECT section_id, a, i + 1, CASE WHEN length(piece) + 2 + length(a[i + 1]) <= 1400 THEN piece_no ELSE piece_no + 1 END,
    CASE WHEN length(piece) + 2 + length(a[i + 1]) <= 1400 THEN piece || chr(10) || chr(10) || a[i + 1] ELSE a[i + 1] END FROM walk WHERE i < len(a))
SELECT section_id, piece_no, arg_max(piece, i) AS piece FROM walk GROUP BY section_id, piece_no""")
def pack_chunks(spark, sf_dir):
    pieces = T.pack(T.paragraphs(F.col("raw_text")), 1400)
    return table(spark, sf_dir, "eligibility_sections").select("section_id", F.posexplode(pieces).alias("piece_no", "piece"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 2 THEN CAST(o_orderdate AS DATE) WHEN 3 THEN CAST(o_orderdate AS DATE) END AS day FROM orders"""
)
def parse_dates(spark, sf_dir):
    at, n = F.col("o_orderdate"), F.col("o_orderkey") % 6
    text = F.when(n == 0, F.date_format(at, " MMMM d,  yyyy")).when(n == 1, F.lower(F.date_format(at, "MMMM yyyy"))).when(n == 2, F.date_format(at, "yyyy-MM-dd")).when(n == 3, F.upper(F.date_format(at, "MMMM dd, yyyy")))
    text = text.when(n == 4, F.concat(F.lit("Octember 3, "), F.date_format(at, "yyyy"))).otherwise("N/A")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.parse_partial_date(text).alias("day"))


@query(
    """SELECT p_partkey, CAST(p_size AS DOUBLE) AS years, round_even(p_size * (1.0::DOUBLE / 12), 4) AS months, round_even(p_size * (1.0::DOUBLE / 52), 4) AS weeks,
round_even(p_size * (1.0::DOUBLE / 365), 4) AS days, CAST(NULL AS DOUBLE) AS nothing FROM part"""
)
def age_years(spark, sf_dir):
    aged = lambda unit: T.age_years(F.concat_ws(" ", F.col("p_size").cast("string"), F.lit(unit)))
    return table(spark, sf_dir, "part").select("p_partkey", aged("Years").alias("years"), aged("Months").alias("months"), aged("Weeks").alias("weeks"), aged("days").alias("days"), T.age_years(F.lit("N/A")).alias("nothing"))


@query(
    """SELECT event_id, CASE user_id % 5 WHEN 3 THEN event_id WHEN 4 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE user_id % 5 WHEN 3 THEN 'array' WHEN 4 THEN 'none' ELSE 'object' END AS kind FROM events"""
)
def lenient_json(spark, sf_dir):
    number, at = F.col("event_id").cast("string"), F.col("user_id") % 5
    reply = F.when(at == 0, F.concat(F.lit("Reply:\n```json\n"), "props", F.lit("\n```\nor {1}"))).when(at == 1, F.concat(F.lit(" \n"), "props", F.lit(" "))).when(at == 2, F.concat(F.lit("```\nno\n``` The result is "), "props", F.lit(" as asked.")))
    reply = reply.when(at == 3, F.concat(F.lit('so [{"k": '), number, F.lit("}, 2] it is"))).otherwise(F.concat(F.lit("k} is "), number, F.lit(" {")))
    found = T.lenient_json(reply)
    k = F.coalesce(F.get_json_object(found, "$.k"), F.get_json_object(found, "$[0].k")).cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.when(found.isNull(), "none").when(found.startswith("["), "array").otherwise("object").alias("kind"))


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '' ELSE concat_ws(chr(10) || chr(10), 'x = ' || event_id, CASE WHEN user_id % 3 = 1 THEN 'y = "' || event_type || '"' || chr(10) || '  z' END) END AS code, '' AS nothing FROM events""")
def code_blocks(spark, sf_dir):
    first = F.concat(F.lit("Try\n```python\nx = "), F.col("event_id").cast("string"), F.lit("\n```\nthen "))
    second = F.when(F.col("user_id") % 3 == 1, F.concat(F.lit('```Python y = "'), F.col("event_type"), F.lit('"\n  z \n``` or '))).otherwise("``` python\n```python \n``` ")
    reply = F.when(F.col("user_id") % 3 == 0, F.lit("```sql\nz\n``` ``python x``")).otherwise(F.concat(first, second, F.lit("```sql\nz\n```")))
    return table(spark, sf_dir, "events").select("event_id", T.code_blocks(reply).alias("code"), T.code_blocks(F.col("props")).alias("nothing"))


_NUM = "TRY_CAST(nullif(regexp_extract(coalesce(value, ''), '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE)"


@query(f"SELECT span_id, {_NUM} AS number, NOT (lower(trim(coalesce(value, ''))) IN ('', {', '.join(repr(w) for w in T.NO)})) AS truth FROM evidence_spans")
def coerce_values(spark, sf_dir):
    return table(spark, sf_dir, "evidence_spans").select("span_id", T.to_number(F.col("value")).alias("number"), T.to_bool(F.col("value")).alias("truth"))


@query(f"""SELECT DISTINCT doc_id, clause FROM (SELECT doc_id, unnest(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(10), 'g'), '[\\n\\r;]+'), lambda c: {_WS('c')})) AS clause FROM documents)
WHERE clause <> '' AND regexp_matches(clause, '{T.NEGATION}')""")
def negated_clauses(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.explode(T.negated_clauses(F.col("text"))).alias("clause"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 6 = 5 THEN NULL WHEN p_size % 6 = 4 THEN 'B' ELSE chr(65 + p_size % 4) END AS said, CASE WHEN p_size % 6 = 4 THEN 'B' WHEN p_size % 6 < 5 AND p_size % 4 < 2 THEN chr(65 + p_size % 4) END AS among_two,
CASE WHEN regexp_matches(p_name, '^[A-D]$') THEN p_name END AS nothing FROM part"""
)
def choice_extract(spark, sf_dir):
    letter = F.chr(F.lit(65) + F.col("p_size") % 4)
    said = ("The points add up. Answer: @\n", "final choice : @", "Selected option: @.", "So option @ fits", "answer: Z, that is choice B", "The answer is (@), not 8.5")
    reply = F.replace(F.get(F.array(*[F.lit(x) for x in said]), F.col("p_size") % 6), F.lit("@"), letter)
    letters = lambda s: F.split(F.lit(s), "")
    return table(spark, sf_dir, "part").select("p_partkey", T.choice(reply, letters("ABCD")).alias("said"), T.choice(reply, letters("AB")).alias("among_two"), T.choice(F.col("p_name"), letters("ABCD")).alias("nothing"))


@query(
    """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'What is ' || p_name || '? B) of ' || p_size WHEN 1 THEN 'Is it ' || p_brand || '?' ELSE 'A. ' || p_name || ' B. x' END AS question FROM part"""
)
def sanitize_question(spark, sf_dir):
    size = F.col("p_size").cast("string")
    asked = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("What is\n "), F.col("p_name"), F.lit("?\nA. one\nB) of "), size, F.lit("\n choices :\nA. two\nwhatever")))
    asked = asked.when(F.col("p_size") % 3 == 1, F.concat(F.lit("Please compute the answer using the appropriate calculator.\r\nIs it  "), F.col("p_brand"), F.lit("?\r\nEnd your final answer with the format: Answer: <LETTER>.\n  Answer : <letter>")))
    asked = asked.otherwise(F.concat(F.lit("A. "), F.col("p_name"), F.lit("\nB. x")))
    return table(spark, sf_dir, "part").select("p_partkey", T.sanitize_question(asked).alias("question"))


_BULLET = "^\\s*(?:[-*•·]|\\(?\\d{1,3}[.)])\\s+"
_ITEMS = f"""list_filter(list_transform(string_split(array_to_string(list_transform(regexp_split_to_array(coalesce(raw_text, ''), '\\r\\n|\\r|\\n'),
  lambda l: CASE WHEN {_WS('l')} = '' THEN chr(1) WHEN regexp_matches(l, '{_BULLET}') THEN chr(1) || regexp_replace(l, '{_BULLET}', '') ELSE l END), chr(10)), chr(1)), lambda i: {_WS('i')}), lambda i: i <> '')"""


@query(f"""WITH s AS (SELECT section_id, {_ITEMS} AS items, list_filter(list_transform(string_split(coalesce(raw_text, ''), ';'), lambda i: {_WS('i')}), lambda i: i <> '') AS parts FROM eligibility_sections),
c AS (SELECT section_id, CASE WHEN len(items) <= 1 AND len(parts) > 1 AND len(list_filter(parts, lambda p: len(string_split(p, ' ')) < 3)) = 0 THEN parts ELSE items END AS a FROM s),
u AS (SELECT section_id, unnest(a) AS item, generate_subscripts(a, 1) AS pos FROM c), f AS (SELECT section_id, arg_min(item, pos) AS item, min(pos) AS pos FROM u GROUP BY section_id, lower(item))
SELECT section_id, row_number() OVER (PARTITION BY section_id ORDER BY pos) - 1 AS item_no, item FROM f""")
def split_criteria(spark, sf_dir):
    return table(spark, sf_dir, "eligibility_sections").select("section_id", F.posexplode(T.split_criteria(F.col("raw_text"))).alias("item_no", "item"))


_WORDS = lambda x: (
    f"list_filter(list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN w[:-4] || 'y' WHEN length(w) > 4 AND ends_with(w, 's') THEN w[:-2] ELSE w END), lambda w: length(w) >= 3)"
)


@query(f"SELECT chunk_id, array_to_string({_WORDS('text')}, ' ') AS words FROM trial_chunks")
def align_tokens(spark, sf_dir):
    return table(spark, sf_dir, "trial_chunks").select("chunk_id", F.array_join(T.align_tokens(F.col("text")), " ").alias("words"))


_LOW = "['trial', 'study', 'patient']"
_WEIGHT = lambda a: f"coalesce(list_sum(list_transform({a}, lambda w: CASE WHEN list_contains({_LOW}, w) THEN 0.15 ELSE 1.0 END)), 0)"
_PAIRS = lambda a: f"CASE WHEN len({a}) < 2 THEN [] ELSE list_distinct(list_filter(list_transform(range(1, len({a})), lambda i: CASE WHEN {a}[i] <> {a}[i + 1] THEN {a}[i] || ' ' || {a}[i + 1] END), lambda p: p IS NOT NULL)) END"


@query(f"""WITH w AS (SELECT chunk_id, {_WORDS('title')} AS q, {_WORDS('text')} AS o FROM trial_chunks), s AS (SELECT *, list_distinct(q) AS dq, list_filter(q, lambda w: NOT list_contains({_LOW}, w)) AS strong FROM w),
b AS (SELECT *, {_PAIRS('strong')} AS pq, {_PAIRS('o')} AS po FROM s), t AS (SELECT chunk_id, {_WEIGHT('dq')} + len(pq) * 1.5 AS total, {_WEIGHT('list_intersect(dq, o)')} + len(list_intersect(pq, po)) * 1.5 AS met FROM b)
SELECT chunk_id, round(CASE WHEN total > 0 THEN met / total * least(total / 4, 1.0) ELSE 0 END, 6) AS alignment FROM t""")
def alignment(spark, sf_dir):
    return table(spark, sf_dir, "trial_chunks").select("chunk_id", F.round(T.alignment(F.col("title"), F.col("text"), ("trial", "study", "patient")), 6).alias("alignment"))


@query(
    """SELECT doc_id, line_no, column_no FROM (
  SELECT doc_id, u.line_no, instr(lower(u.line), 'diabet') AS column_no FROM documents,
    LATERAL (SELECT unnest(regexp_split_to_array(text, '\\r\\n|[\\r\\n]')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r\\n|[\\r\\n]'), 1) AS line_no) u) WHERE column_no > 0"""
)
def text_grep(spark, sf_dir):
    found = files.matching_lines(_documents(spark, sf_dir), ["doc_id"], "text", "diabet", ignore_case=True)
    return found.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("column_no").cast("bigint").alias("column_no"))
