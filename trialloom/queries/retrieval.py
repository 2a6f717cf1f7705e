"""Queries of the ranking channels, their fusion and the filters, over chunks, hits and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.functions import text as T
from trialloom.operators import fusion, ranking, relational, search
from trialloom.queries.registry import Registry
from trialloom.queries.texts import duck_tokens
from trialloom.session import bounded_broadcast, materialize, table

query = Registry()
CHANNELS = ["bm25", "dense"]
K = 10

# Chunks and hits ----------------------------------------------------------------------------

_CHUNKS = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC, text DESC) AS rn FROM trial_chunks) WHERE rn = 1"


def chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Some columns of the chunks as loaded last; only these are read."""
    rows = table(spark, sf_dir, "trial_chunks").select("chunk_id", "loaded_at", *columns)
    return relational.latest_wins(rows, ["chunk_id"], [F.col("loaded_at"), *[F.col(c) for c in columns]])


def chunks_in_place(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``chunks`` for reading more than once: only chunks that were loaded twice are shuffled."""
    rows = table(spark, sf_dir, "trial_chunks").select("chunk_id", "loaded_at", *columns)
    return relational.latest_in_place(rows, "chunk_id", [F.col("loaded_at"), *[F.col(c) for c in columns]])


_KIND = "split_part(chunk_id, '::', 2)"


def kind():
    """The chunk type in a chunk's id."""
    return F.get(F.split("chunk_id", "::"), 1)


_HITS = """
hits AS (
  SELECT case_id, channel, chunk_id, max(score + 0.0) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY ingested_at DESC) AS rn FROM chunk_hits) WHERE rn = 1 AND score IS NOT NULL AND NOT isnan(score)
  GROUP BY ALL),
ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, channel ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM hits) WHERE rank <= 50)
"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score of each chunk per case and channel, each delivery once."""
    rows = table(spark, sf_dir, "chunk_hits").select("hit_id", "case_id", "channel", "chunk_id", "score", "ingested_at")
    last = relational.latest_wins(rows, ["hit_id"], [F.col("ingested_at")])
    return last.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("case_id", "channel", "chunk_id").agg(F.max(F.col("score") + 0.0).alias("score"))


#: Depth of a channel's list ahead of fusion: the usual limit of hits of the fine stage.
DEPTH = 50


def ranked_hits(spark: SparkSession, sf_dir: str, depth: int = DEPTH) -> DataFrame:
    """The ``depth`` best chunks of each case and channel: a channel's list, as a retriever asked for so many gives it."""
    return ranking.top_k(hits(spark, sf_dir), ["case_id", "channel"], [F.round("score", 9).desc(), F.col("chunk_id").asc()], depth)


@query(f"WITH {_HITS} SELECT case_id, channel, chunk_id, rank FROM ranked")
def topk_total_order(spark, sf_dir):
    return ranked_hits(spark, sf_dir).select("case_id", "channel", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


_NORM = """
normed AS (
  SELECT *, CASE WHEN hi - lo <= 1e-9 * greatest(abs(lo), abs(hi)) THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE (score - lo) / (hi - lo) END AS norm
  FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM ranked WINDOW w AS (PARTITION BY case_id, channel)))
"""


@query(f"WITH {_HITS}, {_NORM} SELECT case_id, channel, chunk_id, round(norm, 6) AS norm FROM normed", name="minmax")
def minmax(spark, sf_dir):
    return fusion.min_max(ranked_hits(spark, sf_dir), ["case_id", "channel"], short=True).select("case_id", "channel", "chunk_id", F.round("norm", 6).alias("norm"))


_WIDE = """
wide AS (SELECT case_id, chunk_id, max(norm) FILTER (channel = 'bm25') AS nb, max(norm) FILTER (channel = 'dense') AS nd,
  max(score) FILTER (channel = 'bm25') AS sb, max(score) FILTER (channel = 'dense') AS sd, count(DISTINCT channel) AS n_channels
  FROM normed WHERE channel IN ('bm25', 'dense') GROUP BY ALL),
active AS (SELECT case_id, 0.5 * max(CAST(channel = 'bm25' AS INT)) + 0.5 * max(CAST(channel = 'dense' AS INT)) AS w FROM ranked WHERE channel IN ('bm25', 'dense') GROUP BY ALL)
"""


@query(f"WITH {_HITS}, {_NORM}, {_WIDE} SELECT case_id, chunk_id, n_channels, round((0.5 * coalesce(nb, 0) + 0.5 * coalesce(nd, 0)) / w, 6) AS score FROM wide JOIN active USING (case_id)")
def fuse_weighted(spark, sf_dir):
    fused = fusion.fuse(ranked_hits(spark, sf_dir), ["case_id"], "chunk_id", CHANNELS, dict.fromkeys(CHANNELS, 0.5), short=True)
    return fused.withColumn("score", F.round("score", 6)).withColumn("n_channels", F.col("n_channels").cast("bigint"))


@query(f"WITH {_HITS}, {_NORM}, {_WIDE} SELECT case_id, chunk_id, n_channels, round(coalesce(sb, sd) + coalesce(nb, 0) + coalesce(nd, 0), 6) AS score FROM wide")
def fuse_structured(spark, sf_dir):
    fused = fusion.fuse(ranked_hits(spark, sf_dir), ["case_id"], "chunk_id", CHANNELS, mode="structured", short=True)
    return fused.withColumn("score", F.round("score", 6)).withColumn("n_channels", F.col("n_channels").cast("bigint"))


@query(f"WITH {_HITS}, {_NORM}, {_WIDE} SELECT case_id, chunk_id, n_channels, round(coalesce(nb, 0) + coalesce(nd, 0), 6) AS score FROM wide")
def fuse_full_outer(spark, sf_dir):
    fused = fusion.fuse(ranked_hits(spark, sf_dir), ["case_id"], "chunk_id", CHANNELS, mode="sum", short=True)
    return fused.withColumn("score", F.round("score", 6)).withColumn("n_channels", F.col("n_channels").cast("bigint"))


@query(f"""WITH {_HITS}, {_NORM}, {_WIDE}
SELECT case_id, chunk_id, rank FROM (SELECT case_id, chunk_id, row_number() OVER (PARTITION BY case_id ORDER BY round(coalesce(nb, 0) + coalesce(nd, 0), 9) DESC, n_channels DESC, {_KIND}, chunk_id) AS rank FROM wide) WHERE rank <= 10""")
def fuse_ordered(spark, sf_dir):
    fused = fusion.fuse(ranked_hits(spark, sf_dir), ["case_id"], "chunk_id", CHANNELS, mode="sum", short=True)
    placed = ranking.top_k(fused, ["case_id"], [F.round("score", 9).desc(), F.desc("n_channels"), kind(), F.col("chunk_id")], K)
    return placed.select("case_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_HITS} SELECT case_id, chunk_id, count(*) AS n_lists, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf FROM ranked GROUP BY ALL")
def rrf(spark, sf_dir):
    merged = fusion.reciprocal_rank(ranked_hits(spark, sf_dir), ["case_id"], "chunk_id")
    return merged.select("case_id", "chunk_id", F.col("n_lists").cast("bigint").alias("n_lists"), F.round("rrf", 6).alias("rrf"))


@query(f"""WITH {_HITS} SELECT case_id, chunk_id, round(sum(CASE channel WHEN 'bm25' THEN 4.5 WHEN 'dense' THEN 3.0 ELSE 1.25 END / sqrt(CASE channel WHEN 'bm25' THEN 1 ELSE 2 END) / (30 + rank) * (0.3 + 0.7 * (0.5))), 9) AS score FROM ranked GROUP BY ALL""")
def rrf_weighted(spark, sf_dir):
    weight = F.when(F.col("channel") == "bm25", 4.5).when(F.col("channel") == "dense", 3.0).otherwise(1.25)
    priority = F.when(F.col("channel") == "bm25", 1).otherwise(2)
    merged = fusion.weighted_reciprocal_rank(ranked_hits(spark, sf_dir), ["case_id"], "chunk_id", weight, priority, F.lit(0.5), F.lit(0.3))
    return merged.withColumn("score", F.round("score", 9))


@query(f"""WITH {_HITS}, taken AS (SELECT case_id, chunk_id, min(CASE channel WHEN 'bm25' THEN 0 ELSE 1000 END + rank) AS f, string_agg(DISTINCT channel, ',' ORDER BY channel) AS source_channels
  FROM ranked WHERE channel IN ('bm25', 'dense') AND rank <= 5 GROUP BY ALL)
SELECT case_id, chunk_id, place, source_channels FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY f, chunk_id) AS place FROM taken) WHERE place <= 10""")
def hybrid_union(spark, sf_dir):
    return fusion.hybrid_union(ranked_hits(spark, sf_dir), ["case_id"], "chunk_id", CHANNELS, 10).withColumn("place", F.col("place").cast("bigint"))


@query(f"WITH {_HITS} SELECT case_id, chunk_id, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM ranked WHERE rank <= 2 GROUP BY ALL", name="recommended")
def recommended(spark, sf_dir):
    return fusion.recommended(ranked_hits(spark, sf_dir), ["case_id"], "chunk_id")


@query(f"""WITH {_HITS}, c AS ({_CHUNKS}), per AS (
  SELECT case_id, split_part(chunk_id, '::', 1) AS nct_id, chunk_id, {_KIND} AS kind, round(max(score) * coalesce(max(nullif(rank_weight, 0)), 1.0), 9) AS w FROM ranked LEFT JOIN c USING (chunk_id) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY case_id, nct_id ORDER BY w DESC, kind, chunk_id) AS r, count(*) OVER (PARTITION BY case_id, nct_id) AS n_items FROM per)
SELECT case_id, nct_id, n_items, round(max(w) FILTER (r = 1) + 0.35 * coalesce(max(w) FILTER (r = 2), 0) + 0.2 * coalesce(max(w) FILTER (r = 3), 0), 9) AS support,
  max(chunk_id) FILTER (r = 1) AS best_item, string_agg(chunk_id, ',' ORDER BY r) FILTER (r <= 3) AS kept FROM o GROUP BY ALL""")
def chunk_to_trial(spark, sf_dir):
    best = ranked_hits(spark, sf_dir).groupBy("case_id", "chunk_id").agg(F.max("score").alias("score"))
    weights = chunks(spark, sf_dir, "rank_weight").select("chunk_id", "rank_weight")
    rows = best.join(weights, "chunk_id", "left").withColumn("nct_id", F.get(F.split("chunk_id", "::"), 0)).withColumn("kind", kind())
    weight = F.coalesce(F.nullif(F.col("rank_weight"), F.lit(0.0)), F.lit(1.0))
    return fusion.to_parents(rows, ["case_id"], "nct_id", "chunk_id", "kind", "score", weight).withColumn("support", F.round("support", 9))


@query(f"""WITH {_HITS}, c AS ({_CHUNKS}) SELECT r.case_id, r.channel, r.rank, r.chunk_id, coalesce(nullif(trim(c.title), ''), r.chunk_id) AS title, coalesce(c.nct_id, split_part(r.chunk_id, '::', 1)) AS nct_id
FROM ranked r LEFT JOIN c USING (chunk_id) WHERE rank <= 10""")
def hydrate(spark, sf_dir):
    first = ranked_hits(spark, sf_dir).where(F.col("rank") <= K)
    wide = first.join(chunks(spark, sf_dir, "title", "nct_id").select("chunk_id", "title", "nct_id"), "chunk_id", "left")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("chunk_id"))
    return wide.select("case_id", "channel", F.col("rank").cast("bigint").alias("rank"), "chunk_id", title.alias("title"), F.coalesce("nct_id", F.get(F.split("chunk_id", "::"), 0)).alias("nct_id"))


@query(f"""WITH {_HITS} SELECT case_id, chunk_id, arg_min(score, o) AS first_score, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels
FROM (SELECT *, CASE channel WHEN 'bm25' THEN 1 WHEN 'dense' THEN 2 ELSE 3 END AS o FROM ranked) GROUP BY ALL""")
def merge_primary(spark, sf_dir):
    rows = ranked_hits(spark, sf_dir).withColumn("o", F.when(F.col("channel") == "bm25", 1).when(F.col("channel") == "dense", 2).otherwise(3)).withColumn("listed", F.array("channel"))
    merged = fusion.merge_ordered(rows, ["case_id"], "chunk_id", "o", ["score"], ["listed"])
    return merged.select("case_id", "chunk_id", F.col("score").alias("first_score"), F.array_join(F.array_sort("listed"), ",").alias("channels"))


# BM25 ---------------------------------------------------------------------------------------

_T = duck_tokens


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every span whose id is divisible by 100, as a search text."""
    return table(spark, sf_dir, "evidence_spans").where(F.col("span_id") % 100 == 0).select("span_id", "text")


def _bm25_sql(fields: dict[str, tuple[str, float]], where: str = "") -> str:
    listed = " UNION ALL ".join(f"SELECT chunk_id, '{f}' AS field, {w} AS w, {_T(x)} AS t FROM c" for f, (x, w) in fields.items())
    return f"""WITH c AS ({_CHUNKS}), f AS ({listed}),
st AS (SELECT field, count(*) AS n, avg(len(t)) AS av FROM f GROUP BY field),
p AS (SELECT chunk_id, field, w, len(t) AS dl, u.term, count(*) AS tf FROM f, LATERAL (SELECT unnest(t) AS term) u GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
q AS (SELECT span_id, u.term, count(*) AS qc FROM evidence_spans, LATERAL (SELECT unnest({_T('text')}) AS term) u WHERE span_id % 100 = 0 GROUP BY ALL),
s AS (SELECT span_id, chunk_id, sum(w * qc * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * CASE WHEN av > 0 THEN dl / av ELSE 1 END))) AS score
  FROM q JOIN p USING (term) JOIN df USING (field, term) JOIN st USING (field) {where} GROUP BY ALL)
SELECT span_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


def _found(scores: DataFrame) -> DataFrame:
    return _shown(ranking.ranked(scores, "span_id", "chunk_id", K))


def _best(spark: SparkSession, sf_dir: str, rows: DataFrame, weights: dict[str, float], keep: str | None = None) -> DataFrame:
    return _shown(search.bm25_top_k(rows, "chunk_id", weights, _asked(spark, sf_dir), "span_id", "text", K, keep))


def _shown(placed: DataFrame) -> DataFrame:
    return placed.select("span_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query(_bm25_sql({"text": ("text", 1.0)}))
def bm25_single(spark, sf_dir):
    return _best(spark, sf_dir, chunks_in_place(spark, sf_dir, "text"), {"text": 1.0})


#: Anything but a blank.
_INK = "[^" + T.BLANK.removeprefix("[")


def chunk_fields(rows: DataFrame, *more: str) -> DataFrame:
    """The five fields of the chunk channel, and more columns; the embedding text stands for the text where it is filled. Blanks stay as they are, tokens don't hold them."""
    filled = F.when(F.col("embedding_text").rlike(_INK), F.col("embedding_text"))
    eligibility = F.when(kind().startswith("eligibility"), F.col("text"))
    return rows.select("chunk_id", "title", F.coalesce(filled, F.col("text")).alias("retrieval_text"), kind().alias("purpose"), eligibility.alias("eligibility"), F.col("text").alias("summary"), *more)


_FILLED = "coalesce(nullif(trim(regexp_replace(coalesce(embedding_text, ''), '" + T.BLANK + "+', ' ', 'g')), ''), text)"


@query(_bm25_sql({
    "title": ("title", 2.8), "retrieval_text": (_FILLED, 4.0), "purpose": (_KIND, 0.4), "eligibility": (f"CASE WHEN starts_with({_KIND}, 'eligibility') THEN text END", 0.8), "summary": ("text", 1.2),
}))
def bm25_chunks(spark, sf_dir):
    rows = chunk_fields(chunks_in_place(spark, sf_dir, "title", "text", "embedding_text"))
    return _best(spark, sf_dir, rows, ranking.CHUNK_WEIGHTS)


@query(_bm25_sql({"title": ("title", 3.8), "retrieval_text": ("text", 1.2)}))
def bm25_fielded(spark, sf_dir):
    rows = chunks_in_place(spark, sf_dir, "title", "text").select("chunk_id", "title", F.col("text").alias("retrieval_text"))
    return _best(spark, sf_dir, rows, {k: ranking.CALCULATOR_WEIGHTS[k] for k in ("title", "retrieval_text")})


@query(_bm25_sql({"text": ("text", 1.0)}, f"WHERE {_KIND} = 'outcomes'"))
def bm25_subset(spark, sf_dir):
    return _best(spark, sf_dir, chunks_in_place(spark, sf_dir, "text"), {"text": 1.0}, f"{_KIND} = 'outcomes'")


@query(f"""WITH c AS ({_CHUNKS}), f AS (SELECT chunk_id, {_T('text')} AS t FROM c),
p AS (SELECT DISTINCT chunk_id, u.term FROM f, LATERAL (SELECT unnest(t) AS term) u)
SELECT term, count(*) AS df, (SELECT count(*) FROM f) AS n_docs, round((SELECT avg(len(t)) FROM f), 6) AS avg_length FROM p GROUP BY term""")
def corpus_stats(spark, sf_dir):
    tokens, stats = ranking.corpus_stats(chunks(spark, sf_dir, "text"), "chunk_id", ["text"])
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # One row of statistics joins every term.
    return df.withColumn("field", F.lit("text")).join(F.broadcast(stats), "field").select("term", "df", "n_docs", F.round("avg_length", 6).alias("avg_length"))


_NAME = "lower(trim(regexp_replace(n, '\\s+', ' ', 'g')))"
_HIT = f"""coalesce(n IS NOT NULL AND CASE WHEN regexp_matches({_NAME}, '^[a-z0-9]+$') THEN list_contains(qt, {_NAME})
  ELSE len({_T(_NAME)}) > 0 AND (contains(lower(text), {_NAME}) OR len(list_filter({_T(_NAME)}, lambda x: NOT list_contains(qt, x))) = 0) END, FALSE)"""


@query(f"""WITH c AS ({_CHUNKS}), f AS (SELECT chunk_id, 'title' AS field, 3.8 AS w, {_T('title')} AS t FROM c UNION ALL SELECT chunk_id, 'text', 1.2, {_T('text')} FROM c),
st AS (SELECT field, count(*) AS n, avg(len(t)) AS av FROM f GROUP BY field), p AS (SELECT chunk_id, field, w, len(t) AS dl, u.term, count(*) AS tf FROM f, LATERAL (SELECT unnest(t) AS term) u GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL), a AS (SELECT span_id, text, {_T('text')} AS qt FROM evidence_spans WHERE span_id % 100 = 0),
q AS (SELECT span_id, u.term, count(*) AS qc FROM a, LATERAL (SELECT unnest(qt) AS term) u GROUP BY ALL),
s AS (SELECT span_id, chunk_id, sum(w * qc * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * CASE WHEN av > 0 THEN dl / av ELSE 1 END))) AS score FROM q JOIN p USING (term) JOIN df USING (field, term) JOIN st USING (field) GROUP BY ALL),
r AS (SELECT span_id, chunk_id, score + len(list_filter([title], lambda n: {_HIT})) + 0.35 * len(list_filter(coalesce(source_fields, []), lambda n: {_HIT})) AS score FROM s JOIN (SELECT chunk_id, title, source_fields FROM c) USING (chunk_id) JOIN a USING (span_id))
SELECT span_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10""")
def bm25_params(spark, sf_dir):
    """Chunk names found in a query raise its BM25 score: 1 per title hit, .35 per source field hit.

    Queries that no name occurs in have their BM25 scores and are searched; only for
    the others are all documents with a shared term listed and raised.
    """
    rows = chunks_in_place(spark, sf_dir, "title", "text", "source_fields")
    asked = _asked(spark, sf_dir)
    weights = {"title": 3.8, "text": 1.2}
    fields = F.coalesce("source_fields", F.array().cast("array<string>"))
    listed = F.concat(F.array("title"), fields)
    names = bounded_broadcast(rows.select(F.explode(listed).alias("name")).where(F.col("name").isNotNull()).distinct())
    read = asked.repartition(spark.sparkContext.defaultParallelism).select("span_id", T.tokenize(F.col("text")).alias("tokens"), F.lower("text").alias("lowered"))
    named = materialize(read.crossJoin(names).where(F.size(ranking.matches(F.array("name"), F.col("tokens"), F.col("lowered"))) > 0).select("span_id").distinct())
    plain = search.bm25_top_k(rows, "chunk_id", weights, asked.join(named, "span_id", "left_anti"), "span_id", "text", K).select("span_id", "chunk_id", "score")
    if named.isEmpty():
        return _found(plain)
    asked = asked.join(named, "span_id", "left_semi")
    scores = ranking.bm25(rows, "chunk_id", weights, asked, "span_id", "text")
    wide = scores.join(rows.select("chunk_id", "title", "source_fields"), "chunk_id").join(asked.withColumnRenamed("text", "asked"), "span_id")
    hits = lambda a: F.size(ranking.matches(a, T.tokenize(F.col("asked")), F.lower("asked")))
    raised = wide.withColumn("score", F.col("score") + hits(F.array("title")) + 0.35 * hits(fields))
    return _found(raised.select("span_id", "chunk_id", "score").unionByName(plain))


# Vectors ------------------------------------------------------------------------------------


def _dense_sql(where: str = "TRUE", k: int = K) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND {where})
SELECT query_id, vec_id, rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""


def _dense(base: DataFrame, embeddings: DataFrame) -> DataFrame:
    asked = embeddings.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    found = ranking.dense_top_k(base, "vec_id", "embedding", asked, "query_id", "asked", K)
    return found.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query(_dense_sql())
def dense_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return _dense(rows, rows)


@query(_dense_sql("e.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"))
def dense_subset(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    candidates = table(spark, sf_dir, "documents").where(F.col("lang") == "en").select(F.col("doc_id").alias("vec_id"))
    return _dense(relational.candidate_filter(rows, "vec_id", candidates), rows)


@query(_dense_sql("e.label IN (1, 3) AND NOT e.label IN (2)"))
def dense_filtered(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    text = rows.withColumn("label", F.col("label").cast("string"))
    condition = relational.payload_filter({"must": [{"field": "label", "values": [1, 3]}], "must_not": [{"field": "label", "values": [2]}]}, {"label": "string"})
    return _dense(text.where(condition), rows)


# Filters ------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def candidate_filter(spark, sf_dir):
    candidates = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return relational.candidate_filter(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", candidates, empty="none")


@query("SELECT chunk_id, nct_id FROM trial_chunks WHERE list_has_any(source_fields, ['interventions', 'eligibility_text']) AND (chunk_type = 'outcomes' OR chunk_type = 'arms_interventions') AND NOT coalesce(nct_id IN ('NCT90000007'), FALSE)")
def payload_filter(spark, sf_dir):
    condition = relational.payload_filter(
        {"must": [{"field": "source_fields", "values": ["interventions", "eligibility_text"]}], "should": [{"field": "chunk_type", "values": ["outcomes"]}, {"field": "chunk_type", "values": ["arms_interventions"]}], "must_not": [{"field": "nct_id", "values": ["NCT90000007"]}, {"field": "", "values": ["x"]}]},
        {"source_fields": "array", "chunk_type": "string", "nct_id": "string"},
    )
    return table(spark, sf_dir, "trial_chunks").where(condition).select("chunk_id", "nct_id")


@query("SELECT p_partkey FROM part WHERE CASE WHEN p_size % 5 = 0 THEN 'All' WHEN p_size % 2 = 0 THEN 'Male' ELSE 'Female' END IN ('All', 'Female') AND p_size <= 30 AND p_size + 20 >= 30")
def range_filter(spark, sf_dir):
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(size % 5 == 0, "All").when(size % 2 == 0, "Male").otherwise("Female").alias("gender"), size.alias("age_floor_years"), (size + 20).alias("age_ceiling_years"))
    return rows.where(relational.payload_filter({"gender": "female", "age_years": 30}, {})).select("p_partkey")


@query("SELECT c_custkey, FALSE AS fell_back FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE', 'NOWHERE'))")
def dept_scope(spark, sf_dir):
    scopes = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    return relational.scoped(table(spark, sf_dir, "customer"), "c_nationkey", scopes, "r_name", ["ASIA", "EUROPE", "NOWHERE"]).select("c_custkey", "fell_back")


@query(f"""WITH {_HITS}, s AS (SELECT * FROM ranked WHERE {_KIND} = 'overview' AND rank <= 20), a AS (SELECT * FROM ranked WHERE rank <= 20)
SELECT case_id, channel, chunk_id, FALSE AS fell_back FROM s UNION ALL SELECT case_id, channel, chunk_id, TRUE FROM a WHERE (case_id, channel) NOT IN (SELECT (case_id, channel) FROM s)""")
def scoped_fallback(spark, sf_dir):
    rows = ranked_hits(spark, sf_dir).where("rank <= 20").select("case_id", "channel", "chunk_id")
    return relational.per_group_fallback(rows.where(kind() == "overview"), rows, ["case_id", "channel"])


@query("SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def set_intersect(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"))
    return done.intersect(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key")))


# Deduplication, numbering, histograms, metrics ----------------------------------------------


@query("""SELECT o_custkey, o_orderkey, n - 1 AS n_duplicates FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r = 1""")
def latest_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return relational.latest_wins(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) - 1 AS sequence FROM lineitem")
def seq_in_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return relational.numbered(rows, ["l_orderkey"], [F.col("l_shipdate").asc(), F.col("l_linenumber").asc()]).drop("l_shipdate")


@query(f"WITH {_HITS} SELECT case_id, channel, chunk_id, row_number() OVER (PARTITION BY case_id, channel ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM hits")
def row_number_rank(spark, sf_dir):
    from trialloom.operators.positions import group_positions

    return group_positions(hits(spark, sf_dir), ["case_id", "channel"], [F.round("score", 9).desc(), F.col("chunk_id").asc()], "rank").drop("score")


@query("SELECT o_orderkey, pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE pos >= 100 AND pos < 900")
def range_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey").withColumn("all", F.lit(1))
    placed = relational.numbered(rows, ["all"], [F.col("o_orderkey").asc()], "pos")
    return relational.position_slice(placed, "pos", 100, 900).select("o_orderkey", "pos")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 1000")
def slice_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey").withColumn("all", F.lit(1))
    placed = relational.numbered(rows, ["all"], [F.col("o_orderkey").asc()], "pos")
    return relational.position_slice(placed, "pos", 1000, 2000, limit=50).select("o_orderkey")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def histogram(spark, sf_dir):
    return relational.histogram(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderstatus, string_agg(o_orderpriority || '=' || n, ',' ORDER BY o_orderpriority || '=' || n) AS counts FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
def nested_histogram(spark, sf_dir):
    return relational.nested_histogram(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT source, count(n_chars) AS n, coalesce(min(n_chars), 0) AS min, coalesce(max(n_chars), 0) AS max, round(avg(n_chars), 2) AS mean, round(median(n_chars), 2) AS median FROM documents GROUP BY source")
def length_stats(spark, sf_dir):
    return relational.length_stats(table(spark, sf_dir, "documents"), "n_chars", ["source"])


@query("""SELECT count(*) AS n_rows, count(DISTINCT case_id) AS n_topics, count(DISTINCT chunk_id) AS n_docs, round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END), 4) AS positive_share FROM chunk_hits WHERE score IS NOT NULL AND NOT isnan(score)""")
def qrels_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "chunk_hits").where(F.col("score").isNotNull() & ~F.isnan("score"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("case_id").alias("n_topics"), F.countDistinct("chunk_id").alias("n_docs"), F.round(F.avg(F.when(F.col("score") >= 0.5, 1.0).otherwise(0.0)), 4).alias("positive_share"))


@query(f"""WITH {_HITS}, rel AS (SELECT DISTINCT case_id, chunk_id FROM hits WHERE channel = 'hybrid' AND score > 0.5), r AS (SELECT * FROM ranked WHERE channel = 'bm25'),
j AS (SELECT rel.case_id, count(*) AS n_relevant, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS hits_10, sum(CASE WHEN rank <= 20 THEN 1 ELSE 0 END) AS hits_20 FROM rel LEFT JOIN r USING (case_id, chunk_id) GROUP BY ALL),
e AS (SELECT case_id FROM r UNION SELECT case_id FROM rel)
SELECT case_id, coalesce(n_relevant, 0) AS n_relevant, coalesce(hits_10, 0) AS hits_10, coalesce(hits_20, 0) AS hits_20, round(hits_10 / n_relevant, 6) AS recall_10, round(hits_20 / n_relevant, 6) AS recall_20 FROM e LEFT JOIN j USING (case_id)""")
def recall_at_k(spark, sf_dir):
    relevant = hits(spark, sf_dir).where("channel = 'hybrid' AND score > 0.5").select("case_id", "chunk_id")
    return relational.recall_at(ranked_hits(spark, sf_dir).where("channel = 'bm25'"), relevant, "case_id", "chunk_id", [10, 20])


@query("""SELECT count(*) AS n, sum(CASE WHEN coalesce(t.chunk_type = split_part(t.chunk_id, '::', 2), FALSE) THEN 1 ELSE 0 END) AS n_correct, round(sum(CASE WHEN coalesce(t.chunk_type = split_part(t.chunk_id, '::', 2), FALSE) THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
FROM (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC, chunk_type DESC NULLS LAST) AS rn FROM trial_chunks) WHERE rn = 1) t""")
def accuracy(spark, sf_dir):
    rows = relational.latest_wins(table(spark, sf_dir, "trial_chunks").select("chunk_id", "chunk_type", "loaded_at"), ["chunk_id"], [F.col("loaded_at"), F.col("chunk_type")])
    return relational.accuracy(rows.select("chunk_id", "chunk_type"), rows.select("chunk_id", kind().alias("kind")), "chunk_id", "chunk_type", "kind")


@query("""WITH f AS (SELECT span_id, list_filter([CASE WHEN value IS NULL OR trim(value) = '' THEN 'no_value' END, CASE WHEN unit IS NULL OR trim(unit) = '' THEN 'no_unit' END, CASE WHEN normalized_concept IS NULL THEN 'no_concept' END], lambda x: x IS NOT NULL) AS b FROM evidence_spans)
SELECT u.bucket, count(*) AS n FROM f, LATERAL (SELECT unnest(b) AS bucket) u GROUP BY ALL""")
def failure_buckets(spark, sf_dir):
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    buckets = F.array_compact(F.array(F.when(blank("value"), F.lit("no_value")), F.when(blank("unit"), F.lit("no_unit")), F.when(F.col("normalized_concept").isNull(), F.lit("no_concept"))))
    return table(spark, sf_dir, "evidence_spans").select(F.explode(buckets).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH c AS ({_CHUNKS}), f AS (SELECT nct_id, u.f AS f, min({_KIND} || chunk_id) AS o FROM c, LATERAL (SELECT unnest(source_fields) AS f) u GROUP BY ALL)
SELECT nct_id, string_agg(f, ',' ORDER BY f) AS fields FROM f GROUP BY nct_id""")
def dept_merge(spark, sf_dir):
    rows = chunks(spark, sf_dir, "nct_id", "title", "source_fields").withColumn("o", F.concat(kind(), "chunk_id")).withColumn("one", F.lit(1))
    merged = fusion.merge_ordered(rows, ["one"], "nct_id", "o", ["title"], ["source_fields"])
    return merged.where(F.size("source_fields") > 0).select("nct_id", F.array_join(F.array_sort("source_fields"), ",").alias("fields"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'stored' ELSE 'incoming' END AS origin FROM orders")
def upsert_resume(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    stored = rows.where("o_orderkey % 3 = 0").withColumn("origin", F.lit("stored"))
    incoming = rows.unionByName(rows).withColumn("origin", F.lit("incoming"))
    new = relational.missing_rows(incoming, stored, "o_orderkey")
    once = relational.upsert(new, stored, "o_orderkey")
    return relational.upsert(relational.missing_rows(incoming, once, "o_orderkey"), once, "o_orderkey")


# Two-stage retrieval ------------------------------------------------------------------------


#: Trials a case keeps after the coarse stage, and the chunks a channel may give it for each of them.
COARSE_TRIALS, CHUNKS_A_TRIAL = 300, 4


def coarse_pool(found: DataFrame, coarse_trials: int = COARSE_TRIALS) -> DataFrame:
    """(case_id, nct_id, coarse_rank): rank fusion over all channels, each trial by its best chunk."""
    limit = max(int(coarse_trials), 1)
    listed = ranking.top_k(found, ["case_id", "channel"], [F.round("score", 9).desc(), F.col("chunk_id").asc()], limit * CHUNKS_A_TRIAL)
    first = fusion.reciprocal_rank(listed, ["case_id"], "chunk_id").withColumn("nct_id", F.get(F.split("chunk_id", "::"), 0))
    coarse = first.groupBy("case_id", "nct_id").agg(F.max(F.round("rrf", 9)).alias("rrf"))
    return ranking.top_k(coarse, ["case_id"], [F.desc("rrf"), F.asc("nct_id")], limit, "coarse_rank").select("case_id", "nct_id", "coarse_rank")


def two_stage_rows(spark: SparkSession, sf_dir: str, channels: list[str], coarse_trials: int = COARSE_TRIALS) -> DataFrame:
    """The given hits of some channels within the coarse pool, as trials: normalized, added, times the chunk's rank weight."""
    found = hits(spark, sf_dir)
    fine = found.withColumn("nct_id", F.get(F.split("chunk_id", "::"), 0)).join(coarse_pool(found, coarse_trials), ["case_id", "nct_id"], "left_semi")
    merged = fusion.fuse(fine, ["case_id"], "chunk_id", channels, mode="sum")
    rows = merged.join(chunks(spark, sf_dir, "rank_weight").select("chunk_id", "rank_weight"), "chunk_id", "left")
    rows = rows.withColumn("nct_id", F.get(F.split("chunk_id", "::"), 0)).withColumn("kind", kind())
    return fusion.to_parents(rows, ["case_id"], "nct_id", "chunk_id", "kind", "score", F.coalesce(F.nullif(F.col("rank_weight"), F.lit(0.0)), F.lit(1.0)))


def _two_stage(spark: SparkSession, sf_dir: str, channels: list[str]) -> DataFrame:
    placed = ranking.top_k(two_stage_rows(spark, sf_dir, channels), ["case_id"], [F.round("support", 9).desc(), F.asc("nct_id")], K)
    return placed.select("case_id", "nct_id", F.col("rank").cast("bigint").alias("rank"), F.round("support", 9).alias("support"))


def _two_stage_sql(channels: str) -> str:
    return f"""WITH {_HITS}, listed AS (SELECT *, row_number() OVER (PARTITION BY case_id, channel ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM hits),
r AS (SELECT case_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM listed WHERE rank <= 1200 GROUP BY ALL),
co AS (SELECT case_id, split_part(chunk_id, '::', 1) AS nct_id, max(round(rrf, 9)) AS rrf FROM r GROUP BY ALL),
pool AS (SELECT case_id, nct_id FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rrf DESC, nct_id) AS cr FROM co) WHERE cr <= 300),
fine AS (SELECT h.*, p.nct_id, min(score) OVER w AS lo, max(score) OVER w AS hi FROM hits h JOIN pool p ON p.case_id = h.case_id AND p.nct_id = split_part(h.chunk_id, '::', 1) WHERE channel IN ({channels}) WINDOW w AS (PARTITION BY h.case_id, channel)),
s AS (SELECT case_id, nct_id, chunk_id, sum(CASE WHEN hi - lo <= 1e-9 * greatest(abs(lo), abs(hi)) THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE (score - lo) / (hi - lo) END) AS s FROM fine GROUP BY ALL),
c AS ({_CHUNKS}), w AS (SELECT s.case_id, s.nct_id, s.chunk_id, {_KIND} AS kind, round(s * coalesce(nullif(rank_weight, 0), 1.0), 9) AS w FROM s LEFT JOIN c USING (chunk_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY case_id, nct_id ORDER BY w DESC, kind, chunk_id) AS r FROM w),
t AS (SELECT case_id, nct_id, max(w) FILTER (r = 1) + 0.35 * coalesce(max(w) FILTER (r = 2), 0) + 0.2 * coalesce(max(w) FILTER (r = 3), 0) AS support FROM o GROUP BY ALL)
SELECT case_id, nct_id, rank, round(support, 9) AS support FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(support, 9) DESC, nct_id) AS rank FROM t) WHERE rank <= 10"""


@query(_two_stage_sql("'bm25'"))
def two_stage(spark, sf_dir):
    """Of the fine stage, the aggregation of BM25 alone."""
    return _two_stage(spark, sf_dir, ["bm25"])


@query(_two_stage_sql("'dense'"))
def two_stage_vector(spark, sf_dir):
    return _two_stage(spark, sf_dir, ["dense"])


@query(_two_stage_sql("'bm25', 'dense'"))
def two_stage_merged(spark, sf_dir):
    return _two_stage(spark, sf_dir, CHANNELS)
