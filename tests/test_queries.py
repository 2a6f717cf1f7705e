"""Every core query with SQL against DuckDB, on the smallest data."""

import math
import os
from collections import Counter
from pathlib import Path
from xml.etree import ElementTree

import pytest

from trialloom import queries

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


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    relation = duck.sql(queries.SQL[name])
    places = [relation.columns.index(c) for c in columns]
    assert sorted(relation.columns) == columns
    assert got == sorted(tuple(plain(row[i]) for i in places) for row in relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_gives_the_same_rows_again(spark, name):
    """Another number of partitions must not change a row."""

    def rows():
        df = queries.QUERIES[name](spark, str(DATA))
        return df.columns, sorted(str(tuple(r)) for r in df.collect())

    first = rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows() == first and first[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_flat_tables_equal_a_plain_walk_of_the_xml(spark):
    """p5_found against paths walked with the standard parser, kind by kind."""
    plain_kinds = ("condition", "keyword", "arm_group", "intervention", "primary_outcome", "secondary_outcome", "reference", "location")
    result = ("clinical_results", "outcome_list", "outcome"), ("measure", "class_list", "class"), ("category_list", "category"), ("measurement_list", "measurement")

    def down(node, path):
        nodes = [node]
        for name in path:
            nodes = [c for n in nodes for c in n if c.tag == name]
        return nodes

    filled = lambda e: bool(e.attrib or len(e) or (e.text or "").strip())
    want = Counter()
    for row in spark.read.parquet(f"{DATA}/trial_xml_sources.parquet").collect():
        try:
            root = ElementTree.fromstring(bytes(row.xml_bytes or b""))
        except (ElementTree.ParseError, ValueError):
            continue
        numbers: Counter = Counter()

        def note(kind, parent, source=row.source_id, numbers=numbers):
            numbers[kind] += 1
            want[source, kind, parent, numbers[kind]] += 1
            return numbers[kind]

        for kind in plain_kinds:
            for element in filter(filled, down(root, (kind,))):
                at = note(kind, 0)
                for inner, tag in {"intervention": (("intervention_arm", "arm_group_label"), ("intervention_alias", "other_name")), "location": (("location_investigator", "investigator"),)}.get(kind, ()):
                    for child in filter(filled, down(element, (tag,))):
                        note(inner, at)
        for outcome in filter(filled, down(root, result[0])):
            o = note("result_outcome", 0)
            for group in filter(filled, down(outcome, result[1])):
                c = note("result_class", o)
                for category in filter(filled, down(group, result[2])):
                    g = note("result_category", c)
                    for _ in filter(filled, down(category, result[3])):
                        note("result_measurement", g)
    got = Counter((r.source_id, r.child_kind, r.parent_no, r.child_no) for r in queries.QUERIES["p5_found"](spark, str(DATA)).collect())
    assert got == want and len(want) > 300
