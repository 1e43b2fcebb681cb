"""The pipeline and the registered corpus queries."""

import duckdb
import pytest

import corpus_pipeline
from cellbasis.llm import decontaminate, queries
from tests_llm_helpers import brute_near_components, same_text_groups

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toArrow(), con.sql(queries.oracle_sql()[name]).to_arrow_table()
    names = sorted(want.schema.names)
    assert names == sorted(got.schema.names)
    rows = lambda t: sorted(map(repr, zip(*[t.column(c).to_pylist() for c in names], strict=True)))
    assert rows(got) == rows(want)


def test_ten_operators_are_registered():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert names == list(range(1, 11))


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34", None, "s", 5)], docs.schema)
    docs = docs.unionByName(extra).cache()
    stages = dict(corpus_pipeline.STAGES)

    known = stages["language_id"](spark, docs, SF).cache()
    assert known.columns == columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in known.collect()} == {9001, 9002}

    single = stages["exact_dedup"](spark, known, SF).cache()
    rows = [(r.doc_id, r.text) for r in known.collect()]
    assert single.columns == columns and {r.doc_id for r in single.collect()} == same_text_groups(rows)

    apart = stages["near_dedup"](spark, single, SF).cache()
    rows = [(r.doc_id, r.text) for r in single.collect()]
    assert apart.columns == columns and {r.doc_id for r in apart.collect()} == brute_near_components(rows)

    clean = stages["decontaminate"](spark, apart, SF).cache()
    judged = decontaminate.decontaminate(apart, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in judged.where("not contaminated").collect()}

    packed = stages["pack"](spark, clean, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
