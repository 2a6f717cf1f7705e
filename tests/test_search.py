import random

import pyspark.sql.functions as F
import pytest

from trialloom.functions import text as T
from trialloom.operators import ranking, relational, search

ODD = ["", None, "a_b A9 É x", "心血压abc 9血压心血压心血压", "K İx a", "abcdefgh abcdefghi abcdefghijklmnopq", "abcdefghijklmnopqr", "a", "b"]


@pytest.mark.parametrize("blocks", ["one", "many"])
def test_top_k_without_pairs_is_ranked_bm25(frame, monkeypatch, blocks):
    random.seed(3)
    words = [f"w{i}" for i in range(25)] + ["abcdefgh", "abcdefghi", "心血", "血", "k"]
    text = lambda n: " ".join(random.choices(words, weights=range(len(words), 0, -1), k=n))
    docs = [(f"d{i}", text(random.randint(0, 9)), random.choice([None, "w1 w2", text(3)]), "x" if i % 3 else "y") for i in range(400)]
    docs += [(f"e{i}", t, t, "y") for i, t in enumerate(ODD)] + [(f"same{i}", "w3 w4", None, "y") for i in range(30)] + [(None, "w1", "w1", "y")]
    asked = [(i, text(random.randint(0, 6))) for i in range(40)] + [(90, "w3 w4 w4"), (91, None), (92, "zzz"), (None, "w1"), *[(100 + i, t) for i, t in enumerate(ODD)]]
    if blocks == "many":
        for name, value in {"BLOCK": 20, "PROBE": 30, "ASKED_ROWS": 60, "BLOCK_BYTES": 40}.items():
            monkeypatch.setattr(search, name, value)
    d, q = frame(docs, "id string, t string, u string, kind string"), frame(asked, "q long, text string")
    weights = {"t": 1.0, "u": 0.4, "kind": -1.0}
    for keep in (None, "kind = 'y'"):
        pairs = ranking.bm25(d, "id", weights, q, "q", "text", candidates=d.where(keep).select("id") if keep else None)
        want = {(r.q, r.id, r["rank"]): r.score for r in ranking.ranked(pairs, "q", "id", 7).collect()}
        got = {(r.q, r.id, r["rank"]): r.score for r in search.bm25_top_k(d, "id", weights, q, "q", "text", 7, keep).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_terms_are_found_as_tokenized(frame):
    rows = frame([(t,) for t in ODD], "t string").select("t", T.tokenize(F.col("t")).alias("tokens")).collect()
    for r in rows:
        assert sorted(search.tokens(r.t or "")) == sorted(r.tokens)


def test_latest_in_place_is_latest_wins(frame):
    rows = frame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "x"), ("c", 3, None), ("c", 3, "w")], "k string, o int, v string")
    want = sorted(map(str, relational.latest_wins(rows, ["k"], [F.col("o")]).drop("n_duplicates").collect()))
    for most in (500_000, 1):
        assert sorted(map(str, relational.latest_in_place(rows, "k", [F.col("o")], most).collect())) == want


def test_names_in_queries_raise_only_their_scores(spark, tmp_path, monkeypatch):
    """Queries without a name in them never reach the pairs; both kinds rank as by hand."""
    import datetime

    from trialloom.queries import retrieval

    at = datetime.datetime(2024, 1, 1)
    rows = [(f"N{i}::outcomes::0", "Heart Study" if i % 4 else "Liver", f"heart w{i % 5} w{i % 7} pain", ["pain", "text_field"] if i % 3 else None, at) for i in range(40)]
    spark.createDataFrame(rows, "chunk_id string, title string, text string, source_fields array<string>, loaded_at timestamp").write.parquet(f"{tmp_path}/trial_chunks.parquet")
    spans = [(100, "w1 w2"), (200, "pain in w3"), (300, "study of heart w4"), (400, None), (500, "w6 pai"), (7, "pain")]
    spark.createDataFrame(spans, "span_id long, text string").write.parquet(f"{tmp_path}/evidence_spans.parquet")
    texts = {s: t for s, t in spans if t and s % 100 == 0}
    docs = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "chunk_id string, title string, text string")
    base = ranking.bm25(docs, "chunk_id", {"title": 3.8, "text": 1.2}, spark.createDataFrame(list(texts.items()), "q long, t string"), "q", "t").collect()
    by = {r[0]: r for r in rows}

    def bonus(text, row):
        words = text.split()
        title = all(w in words for w in row[1].lower().split())
        return title + 0.35 * (row[3] is not None and "pain" in words)

    want = set()
    for q in texts:
        scored = sorted((-round(r.score + bonus(texts[q], by[r.chunk_id]), 9), r.chunk_id) for r in base if r.q == q)[:10]
        want |= {(q, c, n, round(-x, 6)) for n, (x, c) in enumerate(scored, 1)}
    paired, pairs = [], ranking.bm25
    monkeypatch.setattr(ranking, "bm25", lambda d, k, w, asked, *a, **b: paired.extend(r.span_id for r in asked.collect()) or pairs(d, k, w, asked, *a, **b))
    got = retrieval.bm25_params(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and sorted(paired) == [200, 300]


@pytest.mark.parametrize("blocks", ["one", "many"])
def test_pools_of_parents_and_queries_alike(frame, monkeypatch, blocks):
    """Each query within its own parents, with statistics of all documents kept from a search before; queries of the same terms all have their rows."""
    random.seed(5)
    text = lambda n: " ".join(f"w{random.randint(0, 12)}" for _ in range(n))
    docs = [(f"d{i:03}", text(random.randint(0, 8)), f"P{i % 17}" if i % 10 else None) for i in range(300)]
    asked = [(i, text(4)) for i in range(20)] + [(30, "w1 w2 w2"), (31, "W2-w1 w2"), (32, "w1 w2"), (33, None), (34, "zzz")]
    pools = [(q, f"P{(q * j) % 19}") for q, _ in asked for j in (1, 2, 5)] + [(30, "P1"), (30, "P1"), (99, "P1"), (31, None), (None, "P2")]
    if blocks == "many":
        for name, value in {"BLOCK": 20, "PROBE": 30, "ASKED_ROWS": 40, "LOOKUPS": 7}.items():
            monkeypatch.setattr(search, name, value)
    d, q, p = frame(docs, "id string, t string, p string"), frame(asked, "q long, text string"), frame(pools, "q long, p string")
    rows = lambda df: {(r.q, r.id, r["rank"]): r.score for r in df.collect()}
    counts = search.Counts()
    for candidates, own in ((None, {}), (p.join(d, "p").select("q", "id").distinct(), {"parent": "p", "pool": p})):
        want = rows(ranking.ranked(ranking.bm25(d, "id", {"t": 1.5}, q, "q", "text", candidates=candidates), "q", "id", 4))
        got = rows(search.bm25_top_k(d, "id", {"t": 1.5}, q, "q", "text", 4, counts=counts, **own))
        assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert own or {k[1:] for k in got if k[0] == 30} == {k[1:] for k in got if k[0] == 31}


def test_two_stages_never_list_pairs(spark, monkeypatch):
    from trialloom.queries import rerank

    monkeypatch.setattr(ranking, "bm25", lambda *a, **o: pytest.fail("lists all pairs"))
    assert rerank.two_stage_texts(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("blocks", ["one", "many"])
def test_two_stages_take_every_span(spark, tmp_path, monkeypatch, blocks):
    """Spans of any id, alike, twice under one id, without a text, a concept or an id, against the SQL."""
    import datetime

    from tests.test_queries import plain
    from trialloom import queries
    from trialloom.operators import staged

    if blocks == "many":
        for name, value in {"FIRST": 7, "BLOCK": 40, "SLICE": 3, "FUSED": 2}.items():
            monkeypatch.setattr(staged, name, value)
    duckdb = pytest.importorskip("duckdb")
    random.seed(17)
    at = datetime.datetime(2024, 1, 1)
    text = lambda n: " ".join(f"w{random.randint(0, 30)}" for _ in range(n))
    kinds = ["overview", "eligibility_inclusion", "outcomes", "arms_interventions"]
    ids = [f"N{t}::{k}::{n}" for t in range(60) for k in kinds for n in range(2)]
    chunks = [(c, random.choice([None, "", "W1 title", "w2"]), text(random.randint(0, 9)), random.choice([None, None, " ", text(4)]), random.choice([None, 0.0, 1.0, 0.83]), at) for c in ids]
    chunks += [(c, "w2 later", "w3 w4", None, 1.0, datetime.datetime(2024, 1, 2)) for c in ids[:9]]
    spans = [(i, text(random.randint(0, 5)), random.choice([None, "", "w1_w2", "w7", " _w9_"])) for i in range(1, 70)]
    spans += [(200, "w1 w2", "w7"), (301, "W2-w1", "w7"), (302, None, "w1"), (303, "w1 zzz", None), (304, "zzz", "yyy"), (305, None, None), (306, "w1", "w2"), (306, "w3 w1", "w2"), (None, "w1 w2", "w3"), (-7, "w5", "w1")]
    for name, rows, schema in (
        ("trial_chunks", chunks, "chunk_id string, title string, text string, embedding_text string, rank_weight double, loaded_at timestamp"),
        ("evidence_spans", spans, "span_id long, text string, normalized_concept string"),
    ):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    duck = duckdb.connect()
    duck.execute("SET timezone = 'UTC'")
    for name in ("trial_chunks", "evidence_spans"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    df = queries.QUERIES["two_stage_texts"](spark, str(tmp_path))
    relation = duck.sql(queries.SQL["two_stage_texts"])
    places = [relation.columns.index(c) for c in df.columns]
    got = sorted(tuple(plain(x) for x in r) for r in df.collect())
    assert got == sorted(tuple(plain(row[i]) for i in places) for row in relation.fetchall())
    assert {"-7", "1", "200", "301", "306"} <= {r[df.columns.index("span_id")] for r in got}
