"""Derived columns recomputed for published rows."""

import pytest
from pyspark.sql import functions as F

from cladetally.functions import classify as cl, measures as ms
from cladetally.functions.common import percent, round_even
from cladetally.operators import keyed as ky

# fixed values: taxon, OTUs, genomes, species, isolates, isolate %, novelty, over-representation, circle size
ROWS = [
    ("Abditibacteriota", 257, 45, 7, 2, 4.44, 36.714, 0.027, 20),
    ("Calditrichota", 455, 274, 13, 7, 2.55, 35.0, 0.029, 20),
    ("Planctomycetota", 13119, 10360, 498, 384, 3.71, 26.343, 0.038, 20),
    ("Thermomicrobiota", 511, 277, 20, 7, 2.53, 25.55, 0.039, 20),
    ("Acidobacteriota", 9124, 12455, 370, 219, 1.76, 24.659, 0.041, 20),
    ("Mastigamoebidae", 1609, 2, 1, 2, 100.0, 1609.0, 0.001, 10),
    ("Euglenaceae", 470, 3, 1, 3, 100.0, 470.0, 0.002, 10),
    ("Neovahlkampfiidae", 211, 1, 1, 1, 100.0, 211.0, 0.005, 10),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [r[:5] for r in ROWS], "taxon string, otus bigint, genomes bigint, species bigint, isolates bigint")


def test_factors_and_sizes(rows):
    got = rows.select(
        "taxon", round_even(percent("isolates", "genomes"), 2).alias("pct"), ms.novelty_factor("otus", "species").alias("nov"),
        ms.overrepresentation_factor("otus", "species").alias("over"), cl.isolate_circle_size("isolates", "genomes").alias("size"))
    assert {r.taxon: (r.pct, r.nov, r.over, r["size"]) for r in got.collect()} == {r[0]: r[5:] for r in ROWS}


def test_top_flags(rows):
    flagged = ky.flag_top(rows.withColumn("nov", ms.novelty_factor("otus", "species")), "nov", "taxon", 3, "top")
    assert {r.taxon for r in flagged.where("top").collect()} == {"Mastigamoebidae", "Euglenaceae", "Neovahlkampfiidae"}


def test_infinite_novelty_sorts_first(rows):
    df = rows.withColumn("nov", F.when(F.col("taxon") == "Calditrichota", float("inf")).otherwise(F.col("otus") / F.col("species")))
    assert ky.sort_by_novelty(df, "nov", "otus", "taxon").first().taxon == "Calditrichota"
