"""Stored tables end with the block that uses them last."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cladetally.session import keep, materialize, shared_dir, stored_tables


@pytest.fixture
def tables(spark):
    folder = Path(shared_dir(spark).removeprefix("file:")) / "tables"
    folder.mkdir(parents=True, exist_ok=True)
    before = {p.name for p in folder.iterdir()}
    return lambda: {p.name for p in folder.iterdir()} - before


def test_tables_go_with_their_block(spark, tables):
    with stored_tables(spark):
        a = materialize(spark.range(5))
        with stored_tables(spark):
            b = materialize(a.withColumn("x", F.col("id") * 2))
            c = keep(materialize(b.where("x > 2")))
            assert len(tables()) == 3 and c.count() == 3
        assert len(tables()) == 2 and c.count() == 3 and a.count() == 5
    assert not tables()


def test_tables_go_after_a_failure(spark, tables):
    with pytest.raises(ZeroDivisionError), stored_tables(spark):
        materialize(spark.range(5))
        raise ZeroDivisionError
    with pytest.raises(Exception, match="broken"):
        materialize(spark.range(5).select(F.raise_error(F.lit("broken"))))
    assert not tables()


def test_tables_without_a_block_stay(spark, tables):
    assert materialize(spark.range(3)).count() == 3 and len(tables()) == 1
    with stored_tables(spark):
        kept = keep(materialize(spark.range(4)))
    assert kept.count() == 4
