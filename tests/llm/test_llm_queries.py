"""The registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import sys
from pathlib import Path

import compare
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

from stallwise.llm import mixing, queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    same, message = compare.compare(spark, compare.duck(SMALL), queries.queries()[name], SQL[name], SMALL)
    assert same, message


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.queries()[name](spark, SMALL).count() > 0


def test_byte_query_against_brute_force(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted((tuple(r) for r in queries.queries()["op4_suffix"](spark, SMALL).collect()), key=str)
    assert found == brute.cut_bytes(docs)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    good = corpus_pipeline.keep_quality(spark, docs, SMALL).cache()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert good.columns == columns and 0 < good.count() < docs.count()
    assert good.join(labels, "doc_id").filter("quality = 0").count() <= 1

    single = corpus_pipeline.keep_one_of_group(spark, good, SMALL).cache()
    groups = brute.linked([(r["doc_id"], r["text"]) for r in good.collect()])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(d for d, n, least in groups if d == least or not n)

    clean = corpus_pipeline.keep_uncontaminated(spark, single, SMALL).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    judged = brute.contamination([(r["doc_id"], r["text"]) for r in single.collect()], items)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(j[0] for j in judged if not j[5])

    mixed = corpus_pipeline.mix_sources(spark, clean, SMALL).cache()
    words = F.sum(mixing.n_words(F.col("text")))
    assert mixed.columns == columns
    assert abs(mixed.select(words).first()[0] - clean.select(words).first()[0]) <= clean.select("source").distinct().count()

    rows = corpus_pipeline.write_token_files(spark, mixed, SMALL).orderBy("start").collect()
    assert len(rows) == mixed.count()
    assert [r["start"] for r in rows[1:]] == [r["start"] + r["n_tokens"] for r in rows[:-1]]


def test_pipeline_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).withColumn("score", F.lit(1))
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", None, 0, 2), (1, "", "en", None, 0, 2)], docs.schema)
    rows = docs.unionAll(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SMALL)
        assert rows.columns == docs.columns
        rows = rows.cache()
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SMALL).count() == rows.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
        assert empty.count() == 0
        empty = empty if "text" in empty.columns else docs.limit(0)
