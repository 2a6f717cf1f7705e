"""Queries of reranking, of fusion over query variants, and of retrieval from texts in one and two stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.functions import text as T
from trialloom.operators import evaluation, fusion, ranking, relational, rerank, search, staged
from trialloom.queries.registry import Registry
from trialloom.queries.retrieval import _CHUNKS, _FILLED, _HITS, _KIND, _NORM, DEPTH, chunk_fields, chunks, chunks_in_place, hits, kind, ranked_hits
from trialloom.queries.texts import duck_tokens
from trialloom.session import bounded_broadcast, materialize, spread, table

query = Registry()
K, POOL = 10, 30
ASKED = {"interventions": ("insulin", "placebo"), "intents": ("prevention", "change")}
RULED_OUT = ("pregnan", "stroke", "allerg")
ASKED_CONDITIONS = 4
#: Most trials or cases whose titles or conditions are broadcast.
FEW = 200_000

_trial = lambda: F.get(F.split("chunk_id", "::"), 0)
_texts = lambda words: F.array(*[F.lit(w) for w in words])
_long = lambda c: F.col(c).cast("bigint").alias(c)
_rounded = lambda *names: [F.round(n, 6).alias(n) for n in names]
_WEIGHT = "coalesce(nullif(rank_weight, 0), 1.0)"
_S = "coalesce(max(w) FILTER (r = {0}), 0)"
_COVERED = "[" + ", ".join(f"'{t}'" for t in rerank.COVERED) + "]"
_FINE = """len(list_intersect(types, {0})) * 0.05 + CASE WHEN list_contains(types, 'eligibility_inclusion') AND list_contains(types, 'overview') THEN 0.05 ELSE 0 END
  + CASE WHEN list_contains(types, 'arms_interventions') AND (list_contains(types, 'eligibility_inclusion') OR list_contains(types, 'eligibility_exclusion')) THEN 0.04 ELSE 0 END""".format(_COVERED)


def _weight():
    return F.coalesce(F.nullif(F.col("rank_weight"), F.lit(0.0)), F.lit(1.0))


def _best_sql(name: str, rows: str, group: str) -> str:
    """Three best chunks of each trial in ``rows`` (group, nct_id, chunk_id, kind, w, text) as s1..s3, types, texts."""
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {group}, nct_id ORDER BY w DESC, kind, chunk_id) AS r, count(*) OVER (PARTITION BY {group}, nct_id) AS n_items FROM {rows}),
{name} AS (SELECT {group}, nct_id, any_value(n_items) AS n_items, {_S.format(1)} AS s1, {_S.format(2)} AS s2, {_S.format(3)} AS s3, list_sort(list(DISTINCT kind)) AS types, string_agg(coalesce(text, ''), ' ' ORDER BY r) AS texts FROM {name}_o WHERE r <= 3 GROUP BY {group}, nct_id)"""


# Reranking given hits -------------------------------------------------------------------------

_IN = lambda t, x: f"contains(lower({_flat_sql(x)}), {t})"


def _flat_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{T.BLANK}+', ' ', 'g'))"


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"""WITH {_HITS}, {_NORM}, c AS ({_CHUNKS}), fused AS (SELECT case_id, chunk_id, sum(norm) AS score FROM normed GROUP BY ALL),
rows AS (SELECT case_id, split_part(chunk_id, '::', 1) AS nct_id, chunk_id, {_KIND} AS kind, round(score * {_WEIGHT}, 9) AS w, text FROM fused LEFT JOIN c USING (chunk_id)),
{_best_sql('best', 'rows', 'case_id')},
t AS (SELECT nct_id, min(title) AS title FROM c GROUP BY nct_id),
p AS (SELECT case_id, list_slice(list_sort(list(DISTINCT lower(replace(normalized_concept, '_', ' ')))), 1, 4) AS conditions FROM evidence_spans WHERE trim(coalesce(normalized_concept, '')) <> '' GROUP BY case_id),
m AS (SELECT best.*, coalesce(conditions, []) AS conditions,
  list_filter(coalesce(conditions, []), lambda t: {_IN('t', 'texts')} OR (coalesce({_flat_sql('title')}, '') <> '' AND ({_IN('t', 'title')} OR contains(t, lower({_flat_sql('title')}))))) AS mc,
  list_filter({_LIST(ASKED['interventions'])}, lambda t: {_IN('t', 'texts')}) AS mi, list_filter({_LIST(ASKED['intents'])}, lambda t: {_IN('t', 'texts')}) AS mn,
  list_filter({_LIST(RULED_OUT)}, lambda t: {_IN('t', 'texts')}) AS mx FROM best LEFT JOIN t USING (nct_id) LEFT JOIN p USING (case_id)),
s AS (SELECT case_id, nct_id, n_items, s1 + 0.35 * s2 + 0.2 * s3 AS support, {_FINE} AS coverage, 0.08 * least(len(mc), 3) + 0.06 * least(len(mi), 3) + 0.07 * least(len(mn), 2) AS gain,
  CASE WHEN len(conditions) > 0 AND len(mc) = 0 THEN 0.55 ELSE 0 END + CASE WHEN len(mi) = 0 THEN 0.9 ELSE 0 END + CASE WHEN len(conditions) > 0 AND (len(mc) = 0 OR len(mi) = 0) THEN 0.45 ELSE 0 END + 0.45 * least(len(mx), 2) AS loss FROM m)
SELECT case_id, nct_id, rank, n_items, round(CAST(support AS DOUBLE), 6) AS support, round(CAST(coverage AS DOUBLE), 6) AS coverage, round(CAST(gain AS DOUBLE), 6) AS gain, round(CAST(loss AS DOUBLE), 6) AS loss, round(CAST(support + coverage + gain - loss AS DOUBLE), 9) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(support + coverage + gain - loss, 9) DESC, n_items DESC, nct_id) AS rank FROM s) WHERE rank <= 10""")
def trial_rerank(spark, sf_dir):
    """Support, coverage, matched and ruled-out terms of the ten best trials of each case, from the given hits."""
    fused = fusion.min_max(ranked_hits(spark, sf_dir), ["case_id", "channel"], short=True).groupBy("case_id", "chunk_id").agg(F.sum("norm").alias("score"))
    loaded = chunks_in_place(spark, sf_dir, "text", "nct_id", "title", "rank_weight")
    titles = loaded.groupBy("nct_id").agg(F.min("title").alias("title")).select("nct_id", rerank.flat_text(F.col("title")).alias("title"))
    spans = table(spark, sf_dir, "evidence_spans").select("case_id", "normalized_concept").where(F.trim("normalized_concept") != "")
    # A concept is one of a fixed list, so a case has few of them.
    asked = spans.groupBy("case_id").agg(F.slice(F.array_sort(F.collect_set(F.lower(F.replace("normalized_concept", F.lit("_"), F.lit(" "))))), 1, ASKED_CONDITIONS).alias("conditions"))
    # How far the longest condition with a blank can reach beyond the joint of two texts.
    asked = asked.withColumn("reach", F.array_max(F.transform(F.filter("conditions", lambda t: F.contains(t, F.lit(" "))), lambda t: F.length(t) - 1)))
    titles, asked = (bounded_broadcast(materialize(x), FEW) for x in (titles, asked))
    conditions = [F.get("conditions", i) for i in range(ASKED_CONDITIONS)]
    # The fixed terms hold no blank: they stand within one text and are looked for once a chunk. A text stays with its chunk, only what it holds goes to the cases.
    listed = [*ASKED["interventions"], *ASKED["intents"], *RULED_OUT]
    texts = loaded.select("chunk_id", "rank_weight", rerank.flat_text(F.col("text")).alias("flat")).withColumn("listed", rerank.held_terms([F.lit(w) for w in listed], F.col("flat")))
    rows = fused.join(texts, "chunk_id", "left").join(asked, "case_id", "left").select(
        "case_id", _trial().alias("nct_id"), "chunk_id", kind().alias("kind"), (F.col("score") * _weight()).alias("score"), F.coalesce("listed", F.lit(0)).alias("listed"),
        rerank.held_terms(conditions, F.col("flat")).alias("held"), rerank.edges(F.col("flat"), F.col("reach")).alias("edges"),
    ).repartition("case_id")
    best = rerank.best_items(rows, ["case_id"], "nct_id", "chunk_id", "kind", F.col("score"), "edges", short=True, also=(F.bit_or("listed").alias("listed"), F.bit_or("held").alias("held")))
    wide = best.join(titles, "nct_id", "left").join(asked, "case_id", "left")
    joined = F.when(F.col("n_items") > 1, F.trim(F.replace("texts", F.lit("  "), F.lit(" "))))
    across = rerank.held_terms([F.when(F.contains(c, F.lit(" ")) & ~F.contains(c, F.lit("\n")), c) for c in conditions], joined)
    named = F.lit(0)
    for i, c in enumerate(conditions):
        named = named.bitwiseOR(F.when((F.col("title") != "") & (F.contains("title", c) | F.contains(c, F.col("title"))), F.lit(1 << i)).otherwise(F.lit(0)))
    bits = lambda words: F.bit_count(F.col("listed").bitwiseAND(F.lit(sum(1 << listed.index(w) for w in words))))
    matched = {"conditions": F.bit_count(F.col("held").bitwiseOR(across).bitwiseOR(named)), **{k: bits(v) for k, v in ASKED.items()}}
    wanted = {"conditions": F.coalesce(F.size("conditions"), F.lit(0)), **{k: F.lit(len(v)) for k, v in ASKED.items()}}
    gain, loss = rerank.count_score(matched, wanted, bits(RULED_OUT))
    scored = wide.withColumns({"support": rerank.support(), "coverage": rerank.coverage(F.col("types"), "fine"), "gain": gain, "loss": loss})
    scored = scored.withColumn("score", F.col("support") + F.col("coverage") + F.col("gain") - F.col("loss"))
    placed = ranking.top_k(scored, ["case_id"], [F.round("score", 9).desc(), F.desc("n_items"), F.col("nct_id")], K)
    return placed.withColumn("score", F.round("score", 9)).select("case_id", "nct_id", _long("rank"), _long("n_items"), *_rounded("support", "coverage", "gain", "loss"), "score")


@query(f"""WITH h AS (SELECT case_id, coalesce(purpose, '') AS purpose, channel, chunk_id, max(score + 0.0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY ingested_at DESC) AS rn FROM chunk_hits)
  WHERE rn = 1 AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, purpose, channel ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM h) WHERE rank <= 120),
f AS (SELECT case_id, chunk_id, count(*) AS n_lists, arg_min(score, purpose || chr(1) || channel) + sum(1.0::DOUBLE / (60 + rank)) AS score, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM l GROUP BY ALL),
t AS (SELECT f.*, lower(coalesce(title, '')) AS title FROM f LEFT JOIN ({_CHUNKS}) c USING (chunk_id))
SELECT case_id, chunk_id, place, n_lists, round(score, 6) AS score, round(rrf, 6) AS rrf FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(rrf, 9) DESC, title, chunk_id) AS place FROM t) WHERE place <= 120""")
def rrf_coarse(spark, sf_dir):
    """The coarse list of each case: rank fusion over purposes (as query variants) and channels, raw score of the first list kept."""
    rows = table(spark, sf_dir, "chunk_hits").select("hit_id", "case_id", "purpose", "channel", "chunk_id", "score", "ingested_at")
    last = relational.latest_wins(rows, ["hit_id"], [F.col("ingested_at")]).where(F.col("score").isNotNull() & ~F.isnan("score"))
    best = last.groupBy("case_id", F.coalesce("purpose", F.lit("")).alias("purpose"), "channel", "chunk_id").agg(F.max(F.col("score") + 0.0).alias("score"))
    listed = ranking.top_k(best, ["case_id", "purpose", "channel"], [F.round("score", 9).desc(), F.col("chunk_id")], 4 * POOL)
    fused = rerank.fused_lists(listed, ["case_id"], "chunk_id", F.struct("purpose", "channel"))
    titled = fused.join(chunks(spark, sf_dir, "title").select("chunk_id", F.lower("title").alias("title")), "chunk_id", "left")
    placed = ranking.top_k(titled, ["case_id"], [F.round("rrf", 9).desc(), F.coalesce("title", F.lit("")), F.col("chunk_id")], 4 * POOL, "place")
    return placed.select("case_id", "chunk_id", _long("place"), _long("n_lists"), *_rounded("score", "rrf"))


# Retrieval from texts -------------------------------------------------------------------------


def bm25_ctes(name: str, docs: str, key: str, fields: dict[str, tuple[str, float]], asked: str, query_key: str, keep: str = "TRUE") -> str:
    """CTEs down to ``name`` (query_key, key, score): BM25 of the rows of ``docs`` for the rows (query_key, text) of ``asked``."""
    listed = " UNION ALL ".join(f"SELECT {key}, '{f}' AS field, {w} AS w, {duck_tokens(x)} AS t FROM {docs}" for f, (x, w) in fields.items())
    return f"""{name}_f AS ({listed}), {name}_st AS (SELECT field, count(*) AS n, avg(len(t)) AS av FROM {name}_f GROUP BY field),
{name}_p AS (SELECT {key}, field, w, len(t) AS dl, u.term, count(*) AS tf FROM {name}_f, LATERAL (SELECT unnest(t) AS term) u GROUP BY ALL),
{name}_df AS (SELECT field, term, count(*) AS df FROM {name}_p GROUP BY ALL),
{name}_q AS (SELECT {query_key}, u.term, count(*) AS qc FROM {asked}, LATERAL (SELECT unnest({duck_tokens('text')}) AS term) u GROUP BY ALL),
{name} AS (SELECT {query_key}, {key}, sum(w * qc * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * CASE WHEN av > 0 THEN dl / av ELSE 1 END))) AS score
  FROM {name}_q JOIN {name}_p USING (term) JOIN {name}_df USING (field, term) JOIN {name}_st USING (field) WHERE {keep} GROUP BY ALL)"""


_SENTENCE = f"CASE WHEN regexp_extract({_flat_sql('text')}, '^(.*?[.!?])( |$)', 1) = '' THEN {_flat_sql('text')} ELSE regexp_extract({_flat_sql('text')}, '^(.*?[.!?])( |$)', 1) END"
_FIRST = f"CASE WHEN length({_SENTENCE}) <= 220 THEN {_SENTENCE} ELSE regexp_replace(substring({_SENTENCE}, 1, 217), '[ ,;:]+$', '') || '...' END"
_DOCS = f"docs AS (SELECT doc_id, title, text, source, {_FIRST} AS summary FROM documents), asked AS (SELECT doc_id AS query_id, summary AS text FROM docs WHERE doc_id % 100 = 0)"
_TRIAL_FIELDS = {"title": ("title", 3.0), "retrieval_text": ("text", 3.8), "purpose": ("source", 0.8), "summary": ("summary", 1.4)}


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents with the fields of the trial channel, and the stated query set: first sentences of every hundredth."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "title", "text", "source"))
    docs = rows.select("doc_id", "title", F.col("text").alias("retrieval_text"), F.col("source").alias("purpose"), F.lit(None).cast("string").alias("eligibility"), T.first_sentence(F.col("text")).alias("summary"))
    return docs, docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), F.col("summary").alias("text"))


def _trial_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = _catalog(spark, sf_dir)
    return search.bm25_top_k(docs, "doc_id", ranking.TRIAL_WEIGHTS, asked, "query_id", "text", K)


@query(f"""WITH {_DOCS}, {bm25_ctes('s', 'docs', 'doc_id', _TRIAL_FIELDS, 'asked', 'query_id')}
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""")
def bm25_trials(spark, sf_dir):
    """The trial channel, five weighted fields, over all documents."""
    return _trial_channel(spark, sf_dir).select("query_id", "doc_id", _long("rank"), *_rounded("score"))


def _retrieve(spark: SparkSession, sf_dir: str, backend: str, vectors: bool = True) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")

    def vector() -> DataFrame:
        asked = embeddings.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("asked"))
        return ranking.dense_top_k(embeddings, "doc_id", "embedding", asked, "query_id", "asked", K)

    titles = table(spark, sf_dir, "documents").select("doc_id", "title")
    found = rerank.retrieve("query_id", "doc_id", titles, lambda: _trial_channel(spark, sf_dir), vector if vectors else None, backend, K)
    return found.select("query_id", "doc_id", _long("rank"), *_rounded("score"), "channels", "title")


_DENSE = """v AS (SELECT query_id, doc_id, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)) WHERE rank <= 10)"""
_SCALED = "CASE WHEN hi - lo <= 1e-9 * greatest(abs(lo), abs(hi)) THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE (score - lo) / (hi - lo) END"


@query(f"""WITH {_DOCS}, {bm25_ctes('s', 'docs', 'doc_id', _TRIAL_FIELDS, 'asked', 'query_id')},
b AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10), {_DENSE},
r AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM (SELECT *, 'bm25' AS channel, 1 AS o FROM b UNION ALL SELECT *, 'vector', 2 FROM v) WINDOW w AS (PARTITION BY query_id, channel)),
f AS (SELECT query_id, doc_id, arg_min(score, o) + sum({_SCALED}) AS score, string_agg(channel, ',' ORDER BY channel) AS channels, count(*) AS n FROM r GROUP BY ALL)
SELECT query_id, doc_id, rank, round(score, 6) AS score, channels, title FROM (SELECT f.*, title, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, n DESC, lower(coalesce(title, '')), doc_id) AS rank FROM f LEFT JOIN documents USING (doc_id)) WHERE rank <= 10""")
def structured_retrieve(spark, sf_dir):
    """Both channels for each query, fused and looked up."""
    return _retrieve(spark, sf_dir, "auto")


@query(f"""WITH {_DENSE} SELECT query_id, doc_id, rank, round(score, 6) AS score, 'vector' AS channels, title FROM (
  SELECT v.*, title, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(coalesce(title, '')), doc_id) AS rank FROM v LEFT JOIN documents USING (doc_id)) WHERE rank <= 10""")
def structured_vector(spark, sf_dir):
    return _retrieve(spark, sf_dir, "medcpt")


@query(f"""WITH {_DOCS}, {bm25_ctes('s', 'docs', 'doc_id', _TRIAL_FIELDS, 'asked', 'query_id')},
b AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10)
SELECT query_id, doc_id, rank, round(score, 6) AS score, 'bm25' AS channels, title FROM (SELECT b.*, title, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, lower(coalesce(title, '')), doc_id) AS rank FROM b LEFT JOIN documents USING (doc_id)) WHERE rank <= 10""")
def structured_degraded(spark, sf_dir):
    """Both channels asked for, but there are no vectors: BM25 alone."""
    return _retrieve(spark, sf_dir, "hybrid", vectors=False)


_CHUNK_FIELDS = {
    "title": ("title", 2.8), "retrieval_text": (_FILLED, 4.0), "purpose": (_KIND, 0.4), "eligibility": (f"CASE WHEN starts_with({_KIND}, 'eligibility') THEN text END", 0.8), "summary": ("text", 1.2),
}


@query(f"""WITH c AS ({_CHUNKS}), spans AS (SELECT span_id, text, trim(replace(coalesce(normalized_concept, ''), '_', ' ')) AS concept FROM evidence_spans),
asked AS (SELECT span_id || '|1' AS q, text FROM spans UNION ALL SELECT span_id || '|2', concept || ' eligibility trial' FROM spans WHERE concept <> ''),
{bm25_ctes('s', 'c', 'chunk_id', _CHUNK_FIELDS, 'asked', 'q')},
l AS (SELECT CAST(split_part(q, '|', 1) AS BIGINT) AS span_id, split_part(q, '|', 2) AS variant, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s WHERE score > 0) WHERE rank <= 120),
f AS (SELECT span_id, chunk_id, arg_min(score, variant) + sum(1.0::DOUBLE / (60 + rank)) AS score, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM l GROUP BY ALL),
p AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY span_id ORDER BY round(rrf, 9) DESC, lower(coalesce(title, '')), chunk_id) AS place FROM f LEFT JOIN c USING (chunk_id)) WHERE place <= 120) WINDOW w AS (PARTITION BY span_id)),
cr AS (SELECT span_id, split_part(chunk_id, '::', 1) AS nct_id, chunk_id, {_KIND} AS kind, round({_SCALED} * {_WEIGHT}, 9) AS w, text FROM p LEFT JOIN c USING (chunk_id)), {_best_sql('coarse', 'cr', 'span_id')},
pool AS (SELECT span_id, nct_id FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY round(s1 + 0.35 * s2 + 0.2 * s3 + 0.03 * len(list_intersect(types, {_COVERED})), 9) DESC, nct_id) AS cr FROM coarse) WHERE cr <= 30),
fl AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM (SELECT * FROM (SELECT CAST(split_part(q, '|', 1) AS BIGINT) AS span_id, chunk_id, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, chunk_id) AS rank
  FROM s JOIN pool ON pool.span_id = CAST(split_part(q, '|', 1) AS BIGINT) AND pool.nct_id = split_part(chunk_id, '::', 1) WHERE ends_with(q, '|1') AND score > 0) WHERE rank <= 40) WINDOW w AS (PARTITION BY span_id)),
fr AS (SELECT span_id, split_part(chunk_id, '::', 1) AS nct_id, chunk_id, {_KIND} AS kind, round({_SCALED} * {_WEIGHT}, 9) AS w, text FROM fl LEFT JOIN c USING (chunk_id)), {_best_sql('fine', 'fr', 'span_id')},
t AS (SELECT span_id, nct_id, s1 + 0.35 * s2 + 0.2 * s3 AS support, s1 + 0.35 * s2 + 0.2 * s3 + {_FINE} AS score FROM fine)
SELECT span_id, nct_id, rank, round(CAST(support AS DOUBLE), 6) AS support, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY round(score, 9) DESC, nct_id) AS rank FROM t) WHERE rank <= 10""")
def two_stage_texts(spark, sf_dir):
    """From texts to trials: variants of each query over all chunks, fused to 30 trials; then BM25 within these, as trials again."""
    loaded = chunks_in_place(spark, sf_dir, "text", "title", "embedding_text", "rank_weight")
    fields = chunk_fields(loaded, "rank_weight").withColumns({"nct_id": _trial(), "weight": _weight()})
    spans = table(spark, sf_dir, "evidence_spans").select("span_id", "text", "normalized_concept")
    concept = F.trim(F.replace(F.coalesce("normalized_concept", F.lit("")), F.lit("_"), F.lit(" ")))
    asked = spans.select("span_id", "text", F.when(concept != "", F.concat(concept, F.lit(" eligibility trial"))).alias("named"))
    return staged.two_stages(fields, "chunk_id", ranking.CHUNK_WEIGHTS, "nct_id", "purpose", "title", "weight", asked, "span_id", ("text", "named"), depth=4 * POOL, pool=POOL, fine=40, k=K)


_TERMS = {0: ("Eligibility text", "primary-outcome measures"), 1: ("interventions", "ARM groups", "brief_summary")}
_KEYED = "list_filter(list_transform(coalesce({0}, []), lambda t: regexp_replace(lower(trim(t)), '[\\s_-]+', '_', 'g')), lambda t: t <> '')"
_ODD = "(ascii(right(case_id, 1)) % 2 = 1)"


@query(f"""WITH {_HITS}, c AS ({_CHUNKS}), k AS (SELECT *, count(*) OVER w AS size, max(score) OVER w AS top FROM ranked WHERE channel IN ('bm25', 'dense') WINDOW w AS (PARTITION BY case_id, channel)),
p AS (SELECT case_id, chunk_id, sum((size - rank + 1) / CAST(size AS DOUBLE) + CASE WHEN top > 0 THEN score / top * 0.35 ELSE 0 END) AS signal, count(*) AS n, string_agg(channel, ',' ORDER BY channel) AS channels,
  coalesce(min(rank) FILTER (channel = 'bm25'), 1000000000) AS r0, coalesce(min(rank) FILTER (channel = 'dense'), 1000000000) AS r1 FROM k GROUP BY ALL),
w AS (SELECT p.*, lower(coalesce(title, '')) AS title, {_KEYED.format("source_fields")} AS own, CASE WHEN {_ODD} THEN {_KEYED.format(_LIST(_TERMS[1]))} ELSE {_KEYED.format(_LIST(_TERMS[0]))} END AS asked FROM p LEFT JOIN c USING (chunk_id)),
o AS (SELECT *, len(list_filter(own, lambda x: list_contains(asked, x))) AS overlap FROM w),
s AS (SELECT *, CASE WHEN len(own) = 0 THEN 0.0 ELSE CAST(overlap AS DOUBLE) / len(list_distinct(own)) END AS ratio FROM o), t AS (SELECT *, overlap * 2.0::DOUBLE + ratio * 1.5::DOUBLE + n * 0.75::DOUBLE + signal AS score FROM s)
SELECT case_id, chunk_id, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, n DESC, overlap DESC, r0, r1, least(r0 * 2, r1 * 2 + 1), title, chunk_id) AS rank, round(score, 9) AS score, overlap, round(ratio, 6) AS ratio, channels FROM t""")
def param_rerank(spark, sf_dir):
    """The pool of both channels of each case, by the source fields that chunks share with a case's terms."""
    rows = ranked_hits(spark, sf_dir)
    names = chunks(spark, sf_dir, "title", "source_fields").select("chunk_id", "title", F.col("source_fields").alias("parameters"))
    terms = rows.select("case_id").distinct().select("case_id", F.when(F.ascii(F.right("case_id", F.lit(1))) % 2 == 1, _texts(_TERMS[1])).otherwise(_texts(_TERMS[0])).alias("terms"))
    out = rerank.parameter_rerank(rows, "case_id", "chunk_id", names, terms, ("bm25", "dense")).withColumn("score", F.round("score", 9))
    return out.select("case_id", "chunk_id", _long("rank"), "score", *_rounded("ratio"), _long("overlap"), "channels")


# Evaluation -----------------------------------------------------------------------------------

_MEANS = ["n_candidates", "condition_matches_10", "intervention_matches_10", "open_10", "n_assessed", "n_criteria", "n_unknown", "n_questions", "recall_10", "recall_20"]
_EVAL = f"""WITH {_HITS}, best AS (SELECT case_id, split_part(chunk_id, '::', 1) AS nct_id, max(score) AS score FROM ranked WHERE channel = 'bm25' GROUP BY ALL),
cand AS (SELECT case_id, nct_id, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, nct_id) AS rank FROM best), titles AS (SELECT nct_id, min(title) AS text FROM ({_CHUNKS}) GROUP BY nct_id),
must AS (SELECT case_id, list(DISTINCT split_part(chunk_id, '::', 1)) AS must FROM hits WHERE channel = 'hybrid' AND score > 0.5 GROUP BY case_id),
cases AS (SELECT c.case_id, must, CASE WHEN {_ODD.replace('case_id', 'c.case_id')} THEN ['fibrosis', ' '] END AS conditions, ['IN'] AS interventions, CASE WHEN ends_with(c.case_id, '7') THEN 'timed out' END AS error FROM (SELECT DISTINCT case_id FROM chunk_hits UNION SELECT DISTINCT case_id FROM evidence_spans) c LEFT JOIN must USING (case_id)),
crit AS (SELECT case_id, source AS item, CASE WHEN span_id % 5 = 0 THEN NULL WHEN value IS NULL OR trim(value) = '' THEN 'unknown' WHEN unit IS NULL THEN 'not_met' ELSE 'met' END AS label, CASE WHEN span_id % 3 = 0 THEN 1 ELSE 0 END AS questions FROM evidence_spans),
f AS (SELECT cand.case_id, count(*) AS n_candidates, count(DISTINCT CASE WHEN rank <= 10 AND list_contains(must, nct_id) THEN nct_id END) AS must_hits_10, count(DISTINCT CASE WHEN rank <= 20 AND list_contains(must, nct_id) THEN nct_id END) AS must_hits_20,
  0 AS acceptable_hits_10, sum((rank <= 10 AND conditions IS NOT NULL AND contains(lower(coalesce(text, '')), 'fibrosis'))::INT) AS condition_matches_10, sum((rank <= 10 AND contains(lower(coalesce(text, '')), 'in'))::INT) AS intervention_matches_10,
  sum((rank <= 10 AND right(nct_id, 1) IN ('1', '2', '3'))::INT) AS open_10 FROM cand JOIN cases USING (case_id) LEFT JOIN titles USING (nct_id) GROUP BY ALL),
j AS (SELECT case_id, count(DISTINCT item) AS n_assessed, count(label) AS n_criteria, sum((coalesce(label, '') = 'met')::INT) AS n_met, sum((coalesce(label, '') = 'not_met')::INT) AS n_not_met, sum((coalesce(label, '') = 'unknown')::INT) AS n_unknown, sum(questions) AS n_questions FROM crit GROUP BY ALL),
m AS (SELECT cases.case_id, coalesce(error, '') AS error, coalesce(len(must), 0) AS n_must, conditions IS NOT NULL AS wants, {', '.join(f'coalesce({x}, 0) AS {x}' for x in ('n_candidates', 'must_hits_10', 'must_hits_20', 'acceptable_hits_10', 'condition_matches_10', 'intervention_matches_10', 'open_10', 'n_assessed', 'n_criteria', 'n_met', 'n_not_met', 'n_unknown', 'n_questions'))} FROM cases LEFT JOIN f USING (case_id) LEFT JOIN j USING (case_id)),
e AS (SELECT *, CASE WHEN n_must > 0 THEN CAST(must_hits_10 AS DOUBLE) / n_must END AS recall_10, CASE WHEN n_must > 0 THEN CAST(must_hits_20 AS DOUBLE) / n_must END AS recall_20, list_filter([CASE WHEN error <> '' THEN 'protocol_exception' END, CASE WHEN n_candidates = 0 THEN 'no_candidates' END, CASE WHEN n_must > 0 AND must_hits_20 = 0 THEN 'must_retrieve_miss' END,
  CASE WHEN wants AND n_candidates > 0 AND condition_matches_10 = 0 THEN 'wrong_condition_top10' END, CASE WHEN n_candidates > 0 AND open_10 = 0 THEN 'no_recruiting_trials_top10' END, CASE WHEN n_candidates > 0 AND n_assessed = 0 THEN 'eligibility_not_assessed' END, CASE WHEN n_assessed > 0 AND n_criteria = 0 THEN 'criteria_parse_empty' END,
  CASE WHEN n_unknown > n_met + n_not_met THEN 'too_many_unknowns' END, CASE WHEN n_unknown > 0 AND n_questions = 0 THEN 'missing_questions_empty_despite_unknowns' END], lambda x: x IS NOT NULL) AS buckets FROM m)"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked_hits(spark, sf_dir)
    best = found.where("channel = 'bm25'").groupBy("case_id", _trial().alias("nct_id")).agg(F.max("score").alias("score"))
    placed = ranking.top_k(best, ["case_id"], [F.round("score", 9).desc(), F.col("nct_id")], DEPTH)
    titles = chunks(spark, sf_dir, "nct_id", "title").groupBy("nct_id").agg(F.min("title").alias("text"))
    candidates = placed.join(titles, "nct_id", "left").withColumn("is_open", F.right("nct_id", F.lit(1)).isin("1", "2", "3"))
    must = hits(spark, sf_dir).where("channel = 'hybrid' AND score > 0.5").groupBy("case_id").agg(F.collect_set(_trial()).alias("must"))
    spans = table(spark, sf_dir, "evidence_spans").select("span_id", "case_id", "source", "value", "unit")
    named = table(spark, sf_dir, "chunk_hits").select("case_id").union(spans.select("case_id")).distinct()
    cases = named.join(must, "case_id", "left").select(
        "case_id", "must", F.array().cast("array<string>").alias("acceptable"), F.when(F.ascii(F.right("case_id", F.lit(1))) % 2 == 1, _texts(("fibrosis", " "))).alias("conditions"), _texts(("IN",)).alias("interventions"),
        F.when(F.col("case_id").endswith("7"), "timed out").alias("error"),
    )
    label = F.when(F.col("span_id") % 5 != 0, F.when(F.trim(F.coalesce("value", F.lit(""))) == "", "unknown").when(F.col("unit").isNull(), "not_met").otherwise("met"))
    criteria = spans.select("case_id", F.col("source").alias("nct_id"), label.alias("label"), (F.col("span_id") % 3 == 0).cast("int").alias("questions"))
    return evaluation.case_metrics(cases, candidates, criteria, "case_id", "nct_id")


@query(f"{_EVAL} SELECT case_id, n_candidates, must_hits_10, must_hits_20, condition_matches_10, intervention_matches_10, open_10, n_assessed, n_criteria, n_met, n_not_met, n_unknown, n_questions, round(recall_10, 6) AS recall_10, round(recall_20, 6) AS recall_20, array_to_string(buckets, ',') AS failure_buckets FROM e")
def eval_metrics(spark, sf_dir):
    whole = [c for c in ("n_candidates", "must_hits_10", "must_hits_20", "condition_matches_10", "intervention_matches_10", "open_10", "n_assessed", "n_criteria", "n_met", "n_not_met", "n_unknown", "n_questions")]
    return _metrics(spark, sf_dir).select("case_id", *[_long(c) for c in whole], *_rounded("recall_10", "recall_20"), F.array_join("failure_buckets", ",").alias("failure_buckets"))


@query(f"""{_EVAL} SELECT item, round(value, 6) AS value FROM (SELECT 'case_count' AS item, CAST(count(*) AS DOUBLE) AS value FROM e UNION ALL SELECT 'failed_case_count', CAST(sum((error <> '')::INT) AS DOUBLE) FROM e UNION ALL SELECT 'completed_case_count', CAST(sum((error = '')::INT) AS DOUBLE) FROM e
UNION ALL {' UNION ALL '.join(f"SELECT 'mean_{x}', avg(coalesce(CAST({x} AS DOUBLE), 0)) FROM e" for x in _MEANS)} UNION ALL SELECT 'bucket_' || u.b, CAST(count(*) AS DOUBLE) FROM e, LATERAL (SELECT unnest(buckets) AS b) u GROUP BY ALL)""")
def eval_summary(spark, sf_dir):
    return evaluation.summary(_metrics(spark, sf_dir), _MEANS).withColumn("value", F.round("value", 6))
