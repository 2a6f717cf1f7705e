"""Every query of the problems on the smallest data: against its SQL, or an independent restatement."""

import math
import os
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from trialloom.llm import queries, subjects, tokens

DATA = Path(os.environ.get("TRIALLOOM_TESTDATA", "/root/testdata/sf0.001"))
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for path in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="module")
def rows(spark):
    kept = {}

    def of(name):
        if name not in kept:
            kept[name] = queries.QUERIES[name](spark, str(DATA)).collect()
        return kept[name]

    return of


@pytest.fixture(scope="module")
def documents(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(rows, duck, name):
    got = rows(name)
    relation = duck.sql(queries.SQL[name])
    columns = sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    assert got and sorted(got[0].asDict()) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got) == sorted(tuple(plain(row[i]) for i in places) for row in relation.fetchall())


def test_pieces_rebuild_every_text_within_its_limit(rows, duck):
    limits = {t: (m, o) for t, m, o in duck.sql("SELECT chunk_type, max_chars, overlap_chars FROM chunk_limits").fetchall()}
    texts = {("chunk", k): (t, k.split("::")[1].strip().lower()) for k, t in duck.sql("SELECT chunk_id, arg_max(text, loaded_at) FROM trial_chunks GROUP BY chunk_id").fetchall()}
    texts |= {("section", str(k)): (t, f"eligibility_{(s or 'unknown').strip().lower()}") for k, t, s in duck.sql("SELECT section_id, raw_text, section_type FROM eligibility_sections").fetchall()}
    pieces = defaultdict(list)
    for r in rows("p2_pieces"):
        pieces[r.item_kind, r.item_key].append(r)
    assert set(pieces) == set(texts)
    cut = 0
    for item, listed in pieces.items():
        text, kind = texts[item]
        limit, overlap = limits[kind]
        flat = " ".join(x for x in (text or "").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if x)
        listed.sort(key=lambda r: r.piece_no)
        assert listed[-1].n_pieces == len(listed) and (len(listed) > 1) == (len(flat) > limit)
        at = 0
        for r in listed:
            assert (r.piece_text or "") == flat[r.start_offset : r.end_offset] and len(r.piece_text or "") <= limit
            assert r.start_offset == (0 if r.piece_no == 1 else at - overlap)
            at = r.end_offset
        assert at == len(flat)
        cut += len(listed) > 1
    assert cut == len(rows("p2_found")) > 5


def test_fused_survivors_give_values_of_their_groups(rows, duck):
    found, fused = rows("p3_found"), rows("p3_fused")
    key = lambda r: (r.nct_id, r.section_type, r.field_name)
    assert {key(r) for r in found} == {key(r) for r in fused} and len(found) == len(fused)
    assert all(0 < r.posterior <= 1 and r.n_values >= 1 for r in fused)
    one = {key(r) for r in fused if r.n_values == 1}
    agree = Counter(key(a) in one for a in fused if a.section_id in {b.section_id for b in found if key(b) == key(a)})
    assert agree[True] and agree[False]


def test_ids_and_sizes_are_those_of_the_plain_tokenizer(rows, documents):
    encode = tokens.codec(tokens.read_vocabulary()).encoding.encode_ordinary
    want = {k: encode(t or "") for k, t in documents.items()}
    assert {r.doc_id: r.ids for r in rows("p6_ids")} == want
    assert {r.doc_id for r in rows("p7_found")} == {k for k, ids in want.items() if len(ids) > 1024}
    filled, sizes = Counter(), Counter()
    for r in rows("p7_containers"):
        sizes[r.doc_id] += r.size
        if r.container_id:
            filled[r.container_id] += r.size
    assert sizes == Counter({k: len(ids) for k, ids in want.items()}) and max(filled.values()) <= 1024
    (report,) = rows("p7_mixture")
    assert report.in_mixture and report.n_containers == len(filled) and report.fill == pytest.approx(sum(filled.values()) / (1024 * len(filled)))
    assert {r.in_mixture for r in rows("p7_targets")} <= {True, False} and all(0 < r.fill <= 1 for r in rows("p7_targets"))


def test_subjects_follow_from_mentions_and_labels(rows, documents, duck):
    """Shares and thresholds counted document by document."""
    terms = subjects.read_terms()
    match = subjects.matcher(tuple(terms))
    found = {k: match.mentions(t) for k, t in documents.items() if t and any(c.isalpha() for c in t)}
    found = {k: (words, hits) for k, (words, hits) in found.items() if hits}
    df = Counter(i for _, hits in found.values() for i in hits)
    want = set()
    for k, (words, hits) in found.items():
        weight, number = Counter(), Counter()
        for i, n in hits.items():
            weight[terms[i].subject] += n * terms[i].weight * math.log(1 + len(found) / df[i])
            number[terms[i].subject] += n
        for s, w in weight.items():
            if w / sum(weight.values()) >= (0.05 if number[s] > 1 else 0.08) and number[s] * 100 / words >= 0.1:
                want.add((k, s))
    got = {(r.doc_id, r.subject_code) for r in rows("p8_found")}
    assert got == want
    labels = set(duck.sql("SELECT doc_id, subject_code FROM doc_subject_labels").fetchall())
    labelled = {k for k, _ in labels}
    said = {x for x in got if x[0] in labelled}
    assert len(said & labels) >= 0.9 * len(labels) and len(said & labels) >= 0.9 * len(said)
    assert {r.subject_code: r.n_documents for r in rows("p8_composition")} == Counter(s for _, s in got)
