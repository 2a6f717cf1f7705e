"""Ranking channels: fielded BM25, exact inner products, and total-order top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialloom.functions.text import tokenize
from trialloom.session import bounded_broadcast, materialize

#: Digits that scores are ranked by, so that the order of sums can't reorder ties.
RANK_DIGITS = 9
#: Terms of queries that are broadcast at once.
QUERY_TERMS = 200_000
#: Queries whose vectors meet a block of rows at once, about.
QUERY_BLOCK = 512
#: Most queries whose vectors are broadcast.
BROADCAST_QUERIES = 32_768
#: Rows a block of queries is held against at once.
ROW_BLOCK = 2048

# Field weights of the ranking channels.
CALCULATOR_WEIGHTS = {"title": 3.8, "retrieval_text": 1.2, "purpose": 0.8, "eligibility": 0.4, "abstract": 3.6}
TRIAL_WEIGHTS = {"title": 3.0, "retrieval_text": 3.8, "purpose": 0.8, "eligibility": 0.5, "summary": 1.4}
CHUNK_WEIGHTS = {"title": 2.8, "retrieval_text": 4.0, "purpose": 0.4, "eligibility": 0.8, "summary": 1.2}
K1, B = 1.5, 0.75


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in a total order, with their rank from 1; k below 1 counts as 1."""
    position = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(rank, position).where(F.col(rank) <= max(int(k), 1))


def corpus_stats(documents: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """((field, key, tokens, length) of every document and field, (field, n_docs, avg_length) of every field).

    Empty and null fields count with length 0.
    """
    listed = F.array(*[F.struct(F.lit(f).alias("field"), tokenize(F.col(f)).alias("tokens")) for f in fields])
    tokens = documents.select(key, F.explode(listed).alias("f")).select(key, "f.field", "f.tokens", F.size("f.tokens").alias("length"))
    return tokens, tokens.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))


def _postings(documents: DataFrame, key: str, fields: list[str], terms: DataFrame | None) -> DataFrame:
    """(key, term, lengths, tf) of every document and asked term, both arrays by field; and one row with the term '' per document.

    Everything is grouped by the key first, so a document's rows are made where the
    document is; the rows without a term carry the lengths of all documents.
    """
    tokens = documents.where(F.col(key).isNotNull()).select(key, *[tokenize(F.col(f)).alias(f"__t{i}") for i, f in enumerate(fields)])
    sizes = [f"__l{i}" for i in range(len(fields))]

    entries = [F.struct(F.lit(i).alias("field"), F.col(f"__t{i}").alias("tokens")) for i in range(len(fields))]
    listed = F.array(F.struct(F.lit(-1).alias("field"), F.array(F.lit("")).alias("tokens")), *entries)
    rows = tokens.select(key, *[F.size(f"__t{i}").alias(sizes[i]) for i in range(len(fields))], F.explode(listed).alias("f"))
    rows = rows.select(key, *sizes, "f.field", F.explode("f.tokens").alias("term"))
    if terms is not None:
        rows = rows.join(terms, "term", "left_semi")
    counted = rows.groupBy(key, "term", *sizes).agg(*[F.count(F.when(F.col("field") == i, 1)).cast("int").alias(f"__n{i}") for i in range(len(fields))])
    return counted.select(key, "term", F.array(*sizes).alias("lengths"), F.array(*[f"__n{i}" for i in range(len(fields))]).alias("tf"))


def bm25(
    documents: DataFrame,
    key: str,
    weights: dict[str, float],
    queries: DataFrame,
    query_key: str,
    query_text: str,
    candidates: DataFrame | None = None,
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """(query_key, key, score) of every document that shares a term with a query.

    The score of a field is the sum over the query's terms, a repeated one as
    often as it stands there, of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b *
    length / average length)); fields are weighted and added. Document counts and
    average lengths cover all documents, also those with an empty field.
    ``candidates`` (query_key, key, or key alone) restricts what is scored, never
    the statistics. Negative weights count as 0; null keys and texts give no rows.
    Keys must be unique.

    The postings are spread by document and meet the queries' terms there: in
    blocks of at most ``QUERY_TERMS`` terms of whole queries, each broadcast, as many
    blocks as there are. Pairs of query and document are added up where the document is and
    never shuffled; with ``ranked`` on top, each partition passes on its best few per query.
    """
    fields = [f for f, w in weights.items() if w > 0]
    asked = queries.where(F.col(query_key).isNotNull()).select(query_key, F.explode(tokenize(F.col(query_text))).alias("term"))
    asked = materialize(asked.groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("asked")))
    terms = asked.select("term").unionByName(asked.sparkSession.createDataFrame([("",)], "term string")).distinct()
    # With more terms than that nearly every word is asked for, and the postings are kept whole.
    few = terms.limit(QUERY_TERMS + 1).count() <= QUERY_TERMS
    postings = materialize(_postings(documents, key, fields, F.broadcast(terms) if few else None))
    lengths = [F.avg(F.col("lengths")[i].cast("double")).alias(f"a{i}") for i in range(len(fields))]
    stats = postings.where(F.col("term") == "").agg(F.count(F.lit(1)).alias("n"), *lengths).first()  # one row
    held = postings.where(F.col("term") != "")
    df = held.groupBy("term").agg(*[F.sum((F.col("tf")[i] > 0).cast("int")).alias(f"d{i}") for i in range(len(fields))])
    part = F.lit(0.0)
    for i, f in enumerate(fields):
        average = float(stats[f"a{i}"] or 0.0)
        idf = F.log(1 + (stats["n"] - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        ratio = F.col("lengths")[i] / F.lit(average) if average > 0 else F.lit(1.0)
        tf = F.col("tf")[i]
        part = part + F.when(tf > 0, F.lit(float(weights[f])) * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * ratio))).otherwise(0.0)
    if candidates is not None and query_key not in candidates.columns:
        held = held.join(candidates.select(key), key, "left_semi")
    # The number of partitions is given, so that adaptive planning doesn't merge them: the work is in the pairs made of them.
    spark = asked.sparkSession
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    held = held.join(bounded_broadcast(df, 2 * QUERY_TERMS), "term").select(key, "term", part.alias("part")).repartition(n_parts, key)

    n_blocks = max(1, -(-asked.count() // QUERY_TERMS))
    if n_blocks > 1:
        held = materialize(held).repartition(n_parts, key)
    scored: DataFrame | None = None
    for block in range(n_blocks):
        own = asked.where(F.pmod(F.xxhash64(query_key), F.lit(n_blocks)) == block) if n_blocks > 1 else asked
        pairs = held.join(bounded_broadcast(own, 4 * QUERY_TERMS), "term")
        if candidates is not None and query_key in candidates.columns:
            pairs = pairs.join(candidates.select(query_key, key), [query_key, key], "left_semi")
        scores = pairs.groupBy(query_key, key).agg(F.sum(F.col("asked") * F.col("part")).alias("score"))
        scored = scores if scored is None else scored.unionByName(scores)
    return scored


def ranked(scores: DataFrame, query_key: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best documents of each query by rounded score, then key, with score and rank."""
    order = [F.round(score, RANK_DIGITS).desc(), F.col(key).asc()]
    return top_k(scores.where(F.col(score) > 0), [query_key], order, k)


def _packed(key: str, vector: str):
    """Rows of one vector length as blocks: their keys and their vectors in a row of doubles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), ROW_BLOCK):
                batch = whole.iloc[start : start + ROW_BLOCK]
                sizes = batch[vector].map(len)
                out = []
                for size, rows in batch.groupby(sizes, sort=True):
                    rows = rows.sort_values(key)  # rows of equal score then stand by key
                    out.append((int(size), list(rows[key]), np.stack(list(rows[vector])).astype(np.float64).tobytes()))
                yield pd.DataFrame(out, columns=["__dim", "__keys", "__rows"])

    return run


def _best_of_pairs(query_key: str, key: str, k: int):
    """The ``k`` best rows of each query over the pairs of row block and query block in a partition."""

    def merged(kept: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(kept).sort_values(["score", key], ascending=[False, True]).groupby(query_key, sort=False).head(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            for size, keys, data, asked in zip(batch["__dim"], batch["__keys"], batch["__rows"], batch["__asked"], strict=True):
                names = np.array([q["q"] for q in asked], dtype=object)
                matrix = np.array([q["v"] for q in asked], dtype=np.float64)
                scores = np.round(np.frombuffer(data, np.float64).reshape(-1, size) @ matrix.T, RANK_DIGITS)
                order = np.argsort(-scores, axis=0, kind="stable")[:k]
                best = np.take_along_axis(scores, order, axis=0)
                kept.append(pd.DataFrame({query_key: np.repeat(names, len(order)), key: np.asarray(keys)[order.T.ravel()], "score": best.T.ravel()}))
                if len(kept) >= 32:
                    kept = [merged(kept)]
        if kept:
            yield merged(kept)

    return run


def dense_top_k(base: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int) -> DataFrame:
    """The ``k`` vectors with the largest inner product for every query: (query_key, key, score, rank).

    Exact: blocks of ``ROW_BLOCK`` rows meet blocks of about ``QUERY_BLOCK`` queries, each
    partition keeps its ``k`` best per query, and these few rows are merged. The
    base is read once. Up to ``BROADCAST_QUERIES`` queries are broadcast; beyond, row
    blocks are joined to query blocks by the number of the block. No vector passes
    through the driver. Sums are made in double precision and rounded to 9 digits;
    ties go to the smaller key. Null keys and vectors, and vectors of another length than a
    query's, have no rows for it; repeated rows are ranked each by itself.
    """
    asked = queries.where(F.col(query_key).isNotNull() & F.col(query_vector).isNotNull()).select(F.col(query_key).alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
    n_asked = asked.count()
    n_blocks = max(1, -(-n_asked // QUERY_BLOCK))
    blocks = asked.groupBy(F.size("v").alias("__dim"), F.pmod(F.xxhash64("q"), F.lit(n_blocks)).cast("int").alias("__block")).agg(F.collect_list(F.struct("q", "v")).alias("__asked"))
    key_type, q_type = base.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    narrow = base.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias(vector))
    packed = narrow.mapInPandas(_packed(key, vector), f"__dim int, __keys array<{key_type}>, __rows binary")
    if n_asked <= BROADCAST_QUERIES:
        pairs = packed.join(F.broadcast(blocks), "__dim")
    else:
        pairs = packed.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, ["__dim", "__block"])
    found = pairs.select("__dim", "__keys", "__rows", "__asked").mapInPandas(_best_of_pairs(query_key, key, k), f"`{query_key}` {q_type}, `{key}` {key_type}, score double")
    return top_k(found, [query_key], [F.col("score").desc(), F.col(key).asc()], k)


def matches(names: Column, query_tokens: Column, query_text: Column) -> Column:
    """The names that occur in a query: a single word as a token, others as a substring or with all their tokens."""
    clean = lambda n: F.lower(F.trim(F.regexp_replace(n, r"\s+", " ")))

    def hit(name: Column) -> Column:
        tokens = tokenize(clean(name))
        single = clean(name).rlike("^[a-z0-9]+$")
        return F.when(single, F.array_contains(query_tokens, clean(name))).otherwise((F.size(tokens) > 0) & (F.contains(query_text, clean(name)) | (F.size(F.array_except(tokens, query_tokens)) == 0)))

    return F.filter(names, lambda n: F.coalesce(hit(n), F.lit(False)))
