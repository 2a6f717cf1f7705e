"""Channels and stages against brute force, on tables written for it."""

import datetime as dt
import math
import re
from collections import Counter

import pytest

from trialloom import queries

AT = dt.datetime(2024, 1, 1)


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


CHUNK = "chunk_id string, nct_id string, title string, text string, embedding_text string, rank_weight double, loaded_at timestamp"


def test_bm25_chunks_scores_five_fields(spark, folder):
    chunks = [
        ("A::eligibility_inclusion::0", "A", "one trial", "adults with asthma, asthma untreated", None, 1.0, AT),
        ("B::overview::0", "B", "two trial", "adults with asthma, asthma untreated", None, 1.0, AT),
        ("C::eligibility_exclusion::0", "C", "three trial", "stroke within a year", "severe asthma", 1.0, AT),
        ("D::outcomes::0", "D", None, "change of asthma score", " ", 1.0, AT),
        ("E::description::0", "E", "asthma trial", None, None, 1.0, AT),
    ]
    data = folder(trial_chunks=(chunks, CHUNK), evidence_spans=([(100, "asthma eligibility"), (101, "asthma")], "span_id long, text string"))
    got = {r.chunk_id: r.score for r in queries.QUERIES["bm25_chunks"](spark, data).collect()}

    cut = lambda x: re.findall("[a-z0-9]+", (x or "").lower())
    kind = lambda c: c[0].split("::")[1]
    fields = {
        2.8: lambda c: c[2], 4.0: lambda c: (c[4] or "").strip() or c[3], 0.4: lambda c: kind(c).replace("_", " "),
        0.8: lambda c: c[3] if kind(c).startswith("eligibility") else "", 1.2: lambda c: c[3],
    }
    want = Counter()
    for weight, of in fields.items():
        docs = {c[0]: cut(of(c)) for c in chunks}
        average = sum(map(len, docs.values())) / len(docs)
        for term in ("asthma", "eligibility"):
            df = sum(term in d for d in docs.values())
            for key, d in docs.items():
                tf = d.count(term)
                want[key] += weight * math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / average))
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items() if v > 0}
    assert got["A::eligibility_inclusion::0"] > got["B::overview::0"]


HIT = "hit_id long, case_id string, channel string, chunk_id string, score double, ingested_at timestamp"


def test_two_stage_keeps_every_trial_within_the_coarse_limit(spark, folder):
    """30 trials: the later half by the fused ranks has the best BM25 scores, within lists longer than 50 chunks."""
    hits, n = [], 0
    for t in range(30):
        for k in range(2):
            n += 1
            hits.append((n, "x", "bm25", f"N{t:02}::overview::{k}", t + k / 10, AT))
        for channel in ("dense", "hybrid"):
            n += 1
            hits.append((n, "x", channel, f"N{t:02}::outcomes::0", 1 - t / 100, AT))
    data = folder(chunk_hits=(hits, HIT), trial_chunks=([("N29::overview::1", "N29", "t", "t", None, 2.0, AT), ("N00::outcomes::0", "N00", "t", "t", None, 0.0, AT)], CHUNK))
    norm = {"bm25": lambda x: x / 29.1, "dense": lambda x: (x - 0.71) / 0.29}
    for name, channels in {"two_stage": ["bm25"], "two_stage_vector": ["dense"], "two_stage_merged": ["bm25", "dense"]}.items():
        per = {}
        for _, _, channel, chunk, score, _ in hits:
            if channel in channels:
                per.setdefault(chunk[:3], []).append(norm[channel](score) * (2.0 if chunk == "N29::overview::1" else 1.0))
        support = {t: sum(w * x for w, x in zip((1, 0.35, 0.2), sorted(v, reverse=True), strict=False)) for t, v in per.items()}
        want = sorted(support.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
        got = queries.QUERIES[name](spark, data).orderBy("rank").collect()
        assert [(r.nct_id, r.support) for r in got] == [(t, pytest.approx(v, abs=1e-6)) for t, v in want], name


def test_coarse_limit_is_a_parameter(spark, folder):
    from trialloom.queries.retrieval import COARSE_TRIALS, coarse_pool, hits

    rows = [(i, "x", "bm25", f"N{i:03}::overview::0", float(-i), AT) for i in range(400)]
    found = hits(spark, folder(chunk_hits=(rows, HIT)))
    assert coarse_pool(found).count() == COARSE_TRIALS == 300
    assert [r.nct_id for r in coarse_pool(found, 30).orderBy("coarse_rank").collect()] == [f"N{i:03}" for i in range(30)]
