"""Reranking, fusion of query variants and backends, against hand-counted cases."""

import pytest
from pyspark.sql import functions as F

from trialloom.operators import ranking, rerank

ITEMS = "g string, p string, id string, kind string, score double, text string"


def test_best_items_and_coverage(frame):
    rows = [
        ("x", "A", "a1", "overview", 1.0, "one"), ("x", "A", "a2", "eligibility_inclusion", 0.5, "two"), ("x", "A", "a3", "arms_interventions", 0.5, None), ("x", "A", "a4", "outcomes", 0.4, "four"),
        ("x", "B", "b1", "outcomes", None, "five"), (None, "A", "a1", "overview", 2.0, ""),
    ]
    best = rerank.best_items(frame(rows, ITEMS), ["g"], "p", "id", "kind", F.col("score"), "text")
    out = {(r.g, r.p): r for r in rerank.rerank(best, {}, {}, F.col("texts"), F.array().cast("array<string>"), "coarse").collect()}
    a = out["x", "A"]
    assert (a.n_items, a.s1, a.s2, a.s3, a.best_item, a.texts) == (4, 1.0, 0.5, 0.5, "a1", "one  two")  # the type parts a2 from a3
    assert a.support == pytest.approx(1 + 0.35 * 0.5 + 0.2 * 0.5) and a.coverage == pytest.approx(0.09) and a.score == pytest.approx(a.support + a.coverage)
    assert out["x", "B"].score == 0.0
    fine = {r.p: r.c for r in best.where("g = 'x'").select("p", rerank.coverage(F.col("types"), "fine").alias("c")).collect()}
    assert fine == {"A": pytest.approx(0.15 + 0.05 + 0.04), "B": 0.0}


def test_gains_and_losses_of_terms(frame):
    rows = [(1, ["Heart  failure", "gout", ""], ["insulin"], "Trial of INSULIN in heart failure; no stroke, pregnancy, allergy"), (2, ["gout"], ["insulin"], "nothing"), (3, None, ["insulin"], "insulin"), (4, ["gout"], [], ""), (5, ["acute gout attack"], ["insulin"], "insulin")]
    parents = frame(rows, "p long, c array<string>, i array<string>, texts string").selectExpr("*", "1D s1", "0D s2", "0D s3", "array() types", "if(p = 5, array('gout', null), array()) pool")
    out = {
        r.p: (round(r.gain, 6), round(r.loss, 6))
        for r in rerank.rerank(parents, {"conditions": F.col("c"), "interventions": F.col("i")}, {"conditions": F.col("pool")}, F.col("texts"), F.array(*[F.lit(x) for x in ("stroke", "PREGNAN", "allerg", "")])).collect()
    }
    assert out == {1: (0.14, 0.9), 2: (0.0, 1.9), 3: (0.06, 0.0), 4: (0.0, 0.55), 5: (0.14, 0.0)}
    with pytest.raises(ValueError):
        rerank.rerank(parents, {}, {}, F.lit(""), F.array(), "final")


def test_fused_lists_keep_the_raw_score_of_the_first_list(frame):
    rows = [("x", "b", 2, "d1", 9.0, 1), ("x", "a", 1, "d1", 5.0, 3), ("x", "a", 1, "d2", None, 1)]
    out = {r.d: r for r in rerank.fused_lists(frame(rows, "g string, q string, o int, d string, score double, rank int"), ["g"], "d", F.struct("o")).collect()}
    assert out["d1"].rrf == pytest.approx(1 / 61 + 1 / 63) and out["d1"].score == pytest.approx(5 + 1 / 61 + 1 / 63) and out["d1"].n_lists == 2
    assert out["d2"].score == pytest.approx(1 / 61)


def test_backends_degrade():
    assert [rerank.resolve_backend(n, True) for n in ("auto", " MedCPT ", "keyword", "parameter", None, "", "odd")] == ["hybrid", "vector", "bm25", "bm25", "hybrid", "hybrid", "bm25"]
    assert {rerank.resolve_backend(n, False) for n in ("auto", "vector", None)} == {"bm25"}


def test_retrieve_fuses_only_what_is_asked(frame):
    catalog = frame([("d1", "B", 1), ("d2", "a", 2)], "d string, title string, extra int")
    keyword = lambda: frame([("q", "d1", 2.0), ("q", "d3", 1.0)], "q string, d string, score double")
    vector = lambda: frame([("q", "d2", 0.5), ("q", "d1", 0.5), ("r", "d1", 0.1)], "q string, d string, score double")
    got = lambda **o: {(r.q, r.d): (round(r.score, 6), r.rank, r.channels, r.title) for r in rerank.retrieve("q", "d", catalog, keyword, **o).collect()}
    assert got(vector=vector) == {("q", "d1"): (4.0, 1, "bm25,vector", "B"), ("q", "d2"): (1.5, 2, "vector", "a"), ("q", "d3"): (1.0, 3, "bm25", None), ("r", "d1"): (1.1, 1, "vector", "B")}
    assert got(vector=None) == {("q", "d1"): (2.0, 1, "bm25", "B"), ("q", "d3"): (1.0, 2, "bm25", None)}
    assert got(vector=vector, backend="medcpt", k=1) == {("q", "d2"): (0.5, 1, "vector", "a"), ("r", "d1"): (0.1, 1, "vector", "B")}


@pytest.mark.parametrize("blocks", ["one", "many"])
def test_dense_and_bm25_give_the_same_whatever_the_blocks(frame, monkeypatch, blocks):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(300)] + [(900, [1.0]), (None, [1.0, 1.0, 1.0]), (901, None)]
    asked = [(i, [1.0, float(i), -1.0]) for i in range(40)] + [(77, [2.0])]
    texts = [(i, " ".join(f"w{(i * k) % 11}" for k in range(1, 6))) for i in range(60)]
    questions = [(i, f"w{i % 11} w{i % 3} w{i % 3}") for i in range(30)]
    if blocks == "many":
        monkeypatch.setattr(ranking, "QUERY_BLOCK", 7)
        monkeypatch.setattr(ranking, "BROADCAST_QUERIES", 0)
        monkeypatch.setattr(ranking, "ROW_BLOCK", 16)
        monkeypatch.setattr(ranking, "QUERY_TERMS", 9)
    dense = ranking.dense_top_k(frame(rows, "id long, v array<double>"), "id", "v", frame(asked, "q long, v array<double>"), "q", "v", 3)
    want = set()
    for q, v in asked:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i is not None and w is not None and len(w) == len(v))[:3]
        want |= {(q, i, n) for n, (_, i) in enumerate(best, 1)}
    assert {(r.q, r.id, r["rank"]) for r in dense.collect()} == want
    scores = ranking.bm25(frame(texts, "d long, t string"), "d", {"t": 1.0}, frame(questions, "q long, t string"), "q", "t")
    assert {(r.q, r.d) for r in scores.collect()} == {(q, d) for q, a in questions for d, t in texts if set(a.split()) & set(t.split())}
    assert scores.count() == scores.select("q", "d").distinct().count()


def test_terms_across_the_texts_of_a_trial(spark, tmp_path):
    """Conditions that stand across the joints of a trial's best texts, odd ones, and hits without a chunk, against the SQL."""
    import datetime
    import random

    from tests.test_queries import plain
    from trialloom import queries

    duckdb = pytest.importorskip("duckdb")
    random.seed(11)
    at = datetime.datetime(2024, 1, 1)
    words = ["heart", "Failure", "a", "weak", " ", "\t", "x", "insulin", "stroke", "prevention"]
    text = lambda: random.choice([None, "", " ", *[" ".join(random.choices(words, k=random.randint(1, 4))) for _ in range(9)]])
    kinds = ["overview", "eligibility_inclusion", "outcomes", "arms_interventions"]
    ids = [f"N{t}::{k}::0" for t in range(12) for k in kinds]
    chunks = [(c, c.split("::")[0], random.choice([None, "", "Heart", "weak  Heart failure", "other"]), text(), random.choice([None, 0.0, 1.0, 0.83]), at) for c in ids if random.random() < 0.9]
    chunks += [(c, n, t, "insulin heart", 1.0, datetime.datetime(2024, 1, 2)) for c, n, t, *_ in chunks[:5]]
    hits = [(i, f"case-{i % 30}", random.choice(["bm25", "dense", "hybrid"]), random.choice(ids), random.random() * 9, at) for i in range(900)]
    concepts = ["heart_failure", "a_weak_heart", "heart__failure", "_weak", "weak_", "_", "failure\nheart", "Failure", "x_a", "  ", None]
    spans = [(i, f"case-{i % 29}", random.choice(concepts)) for i in range(70)]
    for name, rows, schema in (
        ("trial_chunks", chunks, "chunk_id string, nct_id string, title string, text string, rank_weight double, loaded_at timestamp"),
        ("chunk_hits", hits, "hit_id long, case_id string, channel string, chunk_id string, score double, ingested_at timestamp"),
        ("evidence_spans", spans, "span_id long, case_id string, normalized_concept string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    duck = duckdb.connect()
    duck.execute("SET timezone = 'UTC'")
    for name in ("trial_chunks", "chunk_hits", "evidence_spans"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    df = queries.QUERIES["trial_rerank"](spark, str(tmp_path))
    relation = duck.sql(queries.SQL["trial_rerank"])
    places = [relation.columns.index(c) for c in df.columns]
    assert sorted(tuple(plain(x) for x in r) for r in df.collect()) == sorted(tuple(plain(row[i]) for i in places) for row in relation.fetchall())
