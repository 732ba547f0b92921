"""The pipeline on the smallest tables, each stage against its operator's rule."""

from pathlib import Path

import pytest

import corpus_pipeline
from cladetally.llm import mixing, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="sample tables absent")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, words = docs.columns, lambda df: df.agg({"n": "sum"}).first()[0]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        if number < 4:
            assert docs.columns == columns, name
        if number == 0:
            kept = {r["doc_id"] for r in docs.collect()}
            assert all((i in kept) == bool(y) for i, y in labels.items() if i in kept or not y)
        if number == 1:
            found = queries.set_join.near_duplicates(before).collect()
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted({r["component_id"] for r in found})
        if number == 2:
            assert docs.count() == before.count()
        if number == 3:
            n = [df.select(mixing.word_count("text").alias("n")) for df in (before, docs)]
            assert abs(words(n[0]) - words(n[1])) <= 20
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 1024
    assert corpus_pipeline.run(spark, SF).columns == docs.columns


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    from tools.check_oracles import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    problem, rows = compare(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name])
    assert problem is None and rows > 0, problem
