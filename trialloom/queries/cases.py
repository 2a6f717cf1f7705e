"""Queries of the operators that put cases together."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.functions.text import BLANK
from trialloom.operators import cases, relational
from trialloom.queries.registry import Registry
from trialloom.session import bounded_broadcast, spread, table

query = Registry()


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' WHEN c_custkey % 5 = 0 THEN NULL ELSE 'old' END AS segment, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS name,
CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 2 END + CASE WHEN c_custkey % 2 <> 0 THEN 0 WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS n FROM customer""")
def case_build(spark, sf_dir):
    base = F.when(F.col("c_custkey") % 5 != 0, F.create_map(F.lit("segment"), F.lit("old"), F.lit("name"), F.col("c_mktsegment")))
    over = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("segment"), F.lit("new"), F.lit("extra"), F.lit("x")))
    merged = table(spark, sf_dir, "customer").select("c_custkey", cases.merge_maps(base, over).alias("m"))
    return merged.select("c_custkey", F.col("m")["segment"].alias("segment"), F.col("m")["name"].alias("name"), F.size("m").alias("n"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand || ' of ' || p_type || '|size ' || p_size WHEN 1 THEN 'pain ' || p_size || '|loss of ' || p_name ELSE '' END AS anchors FROM part""")
def anchors(spark, sf_dir):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_brand"), F.lit(" of  "), F.col("p_type"), F.lit(" and size "), size, F.lit("; word, SIZE "), size))
    text = text.when(F.col("p_size") % 3 == 1, F.concat(F.lit("pain "), size, F.lit(" complicated by loss of  "), F.col("p_name"), F.lit(" where one"))).otherwise("one, two;three")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(cases.anchors(text), "|").alias("anchors"))


def _problems():
    size = F.col("p_size").cast("string")
    forms = (
        F.array(F.concat(F.lit("Patient is a 40-year-old with a history of spinal cord pain "), size, F.lit(", MRI and fever"))), F.array(F.concat(F.lit("<topic x>mri showed  mass of "), size, F.lit("</topic>")), F.lit("glioma"), F.lit("word")),
        F.array(F.concat(F.lit("low back pain grade "), size), F.lit("Chronic pain"), F.lit("- radiation, "), F.lit("chronic PAIN")), F.lit(None).cast("array<string>"),
    )
    out = forms[3]
    for i in (2, 1, 0):
        out = F.when(F.col("p_size") % 4 == i, forms[i]).otherwise(out)
    return out


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'spinal cord pain ' || p_size || '|spinal cord pain ' || p_size || ' spinal tumor|MRI|MRI magnetic resonance imaging'
WHEN 1 THEN 'mass of ' || p_size || '|glioma' WHEN 2 THEN 'low back pain grade ' || p_size || '|Chronic pain|radiation' ELSE '' END AS anchors FROM part""")
def problem_anchors(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(cases.problem_anchors(_problems()), "|").alias("anchors"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'primary problem: spinal cord pain ' || p_size || '; MRI magnetic resonance imaging' WHEN 1 THEN 'primary problem: mass of ' || p_size || '; glioma'
WHEN 2 THEN 'primary problem: low back pain grade ' || p_size || '; Chronic pain' ELSE '' END AS summary FROM part""")
def case_summary(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", cases.case_summary(_problems(), 2).alias("summary"))


@query("""SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_name END, CASE WHEN s_suppkey % 2 = 0 THEN 'nation ' || s_nationkey END, CAST(s_acctbal AS VARCHAR)) AS value,
CASE WHEN s_suppkey % 3 = 0 THEN 'name' WHEN s_suppkey % 2 = 0 THEN 'nation' ELSE 'balance' END AS source FROM supplier""")
def first_filled(spark, sf_dir):
    sources = {"none": F.lit(None).cast("string"), "name": F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(" "), "nation": F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("nation  "), F.col("s_nationkey").cast("string"))), "balance": F.col("s_acctbal")}
    value, source = cases.first_filled(sources)
    return table(spark, sf_dir, "supplier").select("s_suppkey", value.alias("value"), source.alias("source"))


@query("""SELECT event_id, CASE user_id % 6 WHEN 0 THEN event_type || '|b' WHEN 1 THEN 'event type: ' || event_type || '|n: ' || user_id WHEN 2 THEN event_type || ' x|y; z.' WHEN 3 THEN 'one ' || user_id || '|two; three' WHEN 4 THEN event_type || '|' || user_id ELSE CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END END AS problems FROM events""")
def problem_list(spark, sf_dir):
    kind, user, n = F.col("event_type"), F.col("user_id").cast("string"), F.col("user_id") % 6
    seed = F.when(n == 0, F.array(F.concat(F.lit(" "), kind), F.lit(None), F.lit(" "), F.lit("b"))).when(n == 2, F.array(F.lit(" ")))
    inputs = F.when(n < 2, F.create_map(F.lit("event_type"), kind, F.lit("blank"), F.lit(" "), F.lit("no"), F.lit("False"), F.lit("n"), user))
    text = F.when(n == 2, F.concat(F.lit("- "), kind, F.lit(" x -\n\n - y; z."))).when(n == 3, F.concat(F.lit("one "), user, F.lit(". two; three."))).when(n == 4, F.concat(kind, F.lit("; "), user)).when((n == 5) & (F.col("event_id") % 2 == 0), F.concat(F.lit(" "), kind))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(cases.problem_list(seed, inputs, text), "|").alias("problems"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 6 OR p_size % 5 >= 4 THEN 'ready' WHEN p_size % 5 >= 2 OR p_size % 3 >= 2 OR p_size % 11 >= 9 THEN 'partial' ELSE 'insufficient' END AS status FROM part")
def readiness(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", cases.readiness(size % 5, F.when(size % 7 == 6, 1), size % 3, F.when(size % 11 >= 9, 2).otherwise(1)).alias("status"))


@query("""WITH q AS (SELECT p_partkey, u.o, u.stage, u.intent, u.text FROM part, LATERAL (SELECT unnest([
  {'o': 1, 'stage': 'case_summary_dense', 'intent': 'case_summary_dense', 'text': CASE WHEN p_size % 2 = 0 THEN p_name END}, {'o': 2, 'stage': 'problem_anchor_1', 'intent': 'problem_anchor', 'text': 'pain of ' || p_type}, {'o': 3, 'stage': 'problem_anchor_2', 'intent': 'problem_anchor', 'text': 'Glioma'},
  {'o': 4, 'stage': 'risk_hint_1', 'intent': 'risk_hint_seed', 'text': CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_name END}, {'o': 5, 'stage': 'risk_hint_2', 'intent': 'risk_hint_seed', 'text': 'risk ' || p_size}], recursive := true)) u WHERE u.text IS NOT NULL)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY o) AS priority, stage, intent, text FROM q""")
def query_set(spark, sf_dir):
    problems = F.array(F.concat(F.lit("Found to be pain of  "), F.col("p_type")), F.lit("word"), F.lit("Glioma"), F.lit(None), F.lit("GLIOMA"))
    hints = F.array(F.col("p_name"), F.lit(" "), F.concat(F.lit("risk "), F.col("p_size").cast("string")), F.lit("glioma"))
    out = cases.query_set(table(spark, sf_dir, "part"), "p_partkey", F.when(F.col("p_size") % 2 == 0, F.upper("p_name")), problems, hints)
    # The summary is the name in upper case here, so a hint with the name falls away beside it.
    return out.select("p_partkey", F.col("priority").cast("bigint").alias("priority"), "stage", "intent", F.when(F.col("intent") == "case_summary_dense", F.lower("text")).otherwise(F.col("text")).alias("text"))


@query("""WITH b AS (SELECT feature_name, CASE WHEN isnan(lower_bound) THEN NULL ELSE lower_bound END AS lo, CASE WHEN isnan(upper_bound) THEN NULL ELSE upper_bound END AS hi FROM interval_inputs),
c AS (SELECT feature_name, least(coalesce(lo, hi), coalesce(hi, lo)) AS a, greatest(coalesce(lo, hi), coalesce(hi, lo)) AS b FROM b WHERE lo IS NOT NULL OR hi IS NOT NULL),
m AS (SELECT feature_name, count(*) AS n, avg(a) AS ma, avg(b) AS mb FROM c GROUP BY ALL)
SELECT feature_name, n, round(ma, 6) AS mean_lower, round(mb, 6) AS mean_upper, CASE WHEN (ma + mb) / 2 >= 0.75 THEN 'high' WHEN (ma + mb) / 2 >= 0.4 THEN 'moderate' ELSE 'low' END AS band FROM m""")
def interval_summary(spark, sf_dir):
    out = cases.interval_bounds(table(spark, sf_dir, "interval_inputs"), ["feature_name"], "lower_bound", "upper_bound")
    return out.withColumn("mean_lower", F.round("mean_lower", 6)).withColumn("mean_upper", F.round("mean_upper", 6))


@query("SELECT l_orderkey, l_linenumber, round(greatest((l_quantity - 10) * 0.1, 0), 6) AS change, round(greatest(2 - greatest((l_quantity - 10) * 0.1, 0), 0), 6) AS after FROM lineitem")
def counterfactual(spark, sf_dir):
    change, after = cases.counterfactual(F.col("l_quantity"), F.lit(10), F.lit(2.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(change, 6).alias("change"), F.round(after, 6).alias("after"))


@query("""SELECT arg_min(normalized_concept, span_id) AS concept, min(span_id) AS first, count(span_id) AS n FROM evidence_spans WHERE trim(coalesce(normalized_concept, '')) <> '' GROUP BY lower(normalized_concept)""")
def missing_questions(spark, sf_dir):
    rows = table(spark, sf_dir, "evidence_spans").select(F.col("normalized_concept").alias("concept"), "span_id", F.lit(1).alias("one"))
    return cases.first_seen(rows, ["one"], "concept", "span_id", "span_id").drop("one")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'unknown' END AS state, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 3 ELSE 0 END AS priority FROM orders")
def status_map(spark, sf_dir):
    dimension = bounded_broadcast(spark.createDataFrame([(" f", "closed", 1), ("O", "open", 3)], "o_orderstatus string, state string, priority int"))
    return cases.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", dimension, {"state": "unknown", "priority": 0}).drop("o_orderstatus")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'O') DESC, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def select_trial(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return cases.select_best(rows, ["o_custkey"], [(F.col("o_orderstatus") == "O").cast("int"), F.col("o_totalprice")], "o_orderkey").select("o_custkey", "o_orderkey")


@query("""SELECT chunk_id, array_to_string(list_filter(['outcome', 'eligibility_text_full', 'absent'], lambda t: len(list_filter(source_fields, lambda p: p <> '' AND (contains(lower(p), t) OR contains(t, lower(p))))) > 0), ',') AS matched FROM trial_chunks""")
def match_terms(spark, sf_dir):
    terms = F.array(*[F.lit(t) for t in ("outcome", "eligibility_text_full", "absent")])
    return table(spark, sf_dir, "trial_chunks").select("chunk_id", F.array_join(cases.contained(terms, F.col("source_fields")), ",").alias("matched"))


@query("SELECT c_custkey, c_mktsegment AS variant FROM customer UNION ALL SELECT c_custkey, 'Machines' FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT c_custkey, u.v FROM customer, LATERAL (SELECT unnest(['Cars', 'Motor vehicles']) AS v) u WHERE c_mktsegment = 'AUTOMOBILE'")
def term_variants(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return cases.variants(rows, "c_mktsegment", {"automobile": ("Cars", "Motor vehicles", "AUTOMOBILE"), "Machinery": ("machinery ", "Machines", " MACHINES")}).drop("c_mktsegment")


_FLAT = "trim(regexp_replace(coalesce(text, ''), '" + BLANK + "+', ' ', 'g'))"


@query(f"""WITH f AS (SELECT doc_id, {_FLAT} AS t FROM documents),
m AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(t, '([。！？；])( ?)', '\\1' || chr(1) || '\\2', 'g'), '([.!?;]) ', '\\1' || chr(1) || ' ', 'g'), chr(1)) AS a FROM f WHERE t <> ''),
u AS (SELECT doc_id, unnest(a) AS part, generate_subscripts(a, 1) AS pos FROM m), o AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (starts_with(part, ' '))::INT AS start_offset FROM u WHERE part <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS fragment_no, ltrim(part, ' ') AS fragment, start_offset, start_offset + length(ltrim(part, ' ')) AS end_offset FROM o""")
def evidence_index(spark, sf_dir):
    return cases.fragments(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


@query("SELECT DISTINCT normalized_concept AS concept FROM evidence_spans WHERE normalized_concept IS NOT NULL AND normalized_concept NOT IN (SELECT concept FROM measure_units)")
def knowledge_gaps(spark, sf_dir):
    asked = table(spark, sf_dir, "evidence_spans").select(F.col("normalized_concept").alias("concept")).where("concept IS NOT NULL")
    return relational.missing_rows(asked, table(spark, sf_dir, "measure_units"), "concept")


@query("""SELECT concept, source, rank FROM (SELECT concept, source, row_number() OVER (PARTITION BY concept ORDER BY o, source) AS rank FROM (
  SELECT DISTINCT feature_name AS concept, 'intervals' AS source, 0 AS o FROM interval_inputs UNION ALL SELECT DISTINCT concept, 'units:' || unit_code, 1 FROM measure_units)) WHERE rank <= 2""")
def knowledge_union(spark, sf_dir):
    from trialloom.operators.ranking import top_k

    live = table(spark, sf_dir, "interval_inputs").select(F.col("feature_name").alias("concept"), F.lit("intervals").alias("source"), F.lit(0).alias("o"))
    units = table(spark, sf_dir, "measure_units").select("concept", F.concat(F.lit("units:"), "unit_code").alias("source"), F.lit(1).alias("o"))
    ranked = top_k(live.unionByName(units).distinct(), ["concept"], [F.col("o").asc(), F.col("source").asc()], 2)
    return ranked.select("concept", "source", F.col("rank").cast("bigint").alias("rank"))
