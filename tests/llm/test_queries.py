"""The registered queries against SQL, and the pipeline against its parts."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from brindle.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


@pytest.mark.parametrize("name", queries.ORACLE)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(repr, want.project(", ".join(columns)).fetchall()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, kept = docs.count(), docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert 0 < kept.count() <= before
        before = kept.count()
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    passages = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(p in t for p in passages for t in rows.values())
    assert len(set(rows.values())) == len(rows)
    found = decontaminate.Passages([(0, passages[0])], decontaminate.Q, decontaminate.EDIT_RATE)
    assert decontaminate.find(passages[0], found)
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_nulls_clashes_and_nothing(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.first()
    odd = [(None, None, None, None, None), (None, first["text"], None, None, 1), (-5, "", "en", "s", 0), (first["doc_id"], first["text"], first["lang"], first["source"], 1), (-6, "long words of a text " * 40_000, "en", "s", 1)]
    clash = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for column in ("__own", "__lang", "__score", "__string", "kept", "g", "n", "rank", "item_id", "distance", "sequence_id", "n_words"):
        clash = clash.withColumn(column, F.lit(7))
    out = stage(spark, clash, SF)
    rows = out.count()
    if name == "packing":
        assert out.where("doc_id is null").agg(F.sum("length")).first()[0] > 1
    else:
        assert out.columns == clash.columns and 0 < rows <= clash.count()
        assert out.where("kept <> 7 or __own <> 7 or rank <> 7").count() == 0
    assert stage(spark, clash.limit(0), SF).count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    for table in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
