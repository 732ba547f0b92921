"""What grows with the tables stays off the driver and out of single tasks."""

from pyspark.sql import functions as F

from cladetally.functions import lineages as ln
from cladetally.operators import matching as mt
from cladetally.operators import taxonomy as tx


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_are_looked_up_without_a_broadcast(spark):
    names = spark.createDataFrame([(7, "Alpha"), (3, "Alpha"), (9, "Beta")], "taxid long, name string")
    src = spark.createDataFrame([("Alpha",), ("Alpha",), ("x-Beta",), ("Gamma",), (None,)], "name string")
    assert "Broadcast" not in plan(tx.name_to_taxid(src, names, "name"))
    ladder = [("whole", F.col("name")), ("tail", F.regexp_extract("name", "-(.+)", 1))]
    tried = tx.resolve_names(src, names, "name", tx.variants_of(ladder))
    assert {r.name: (r.taxid, r.method) for r in tried.collect()} == {
        "Alpha": (3, "whole"), "x-Beta": (9, "tail"), "Gamma": (None, "none"), None: (None, "none")}
    assert tried.count() == 4


def test_parts_of_the_sample_tables_do_not_pass_the_driver(spark, tmp_path):
    from checks import shapes as sh

    spark.range(40).selectExpr(
        "id as l_orderkey", "id % 7 as l_partkey", "id as l_suppkey", "cast(1 + id % 7 as int) as l_linenumber", "1.0D as l_quantity",
        "1.0D as l_extendedprice", "0.1D as l_discount", "'A' as l_returnflag", "timestamp'2020-01-01' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(5).selectExpr("id as p_partkey", "concat('red part', id) as p_name", "'B1' as p_brand", "'T' as p_type", "cast(id as int) as p_size").write.parquet(
        f"{tmp_path}/part.parquet")
    rows = sh.assemblies(spark, str(tmp_path))
    assert "Broadcast" not in plan(rows)
    assert rows.count() == sum(i % 7 < 5 for i in range(40))


def test_evidence_is_grouped_in_all_shuffle_partitions(spark):
    def lineage(*nodes):
        return [(t, r, n) for t, r, n in nodes]

    family, kind = (5, "family", "Fam"), (50, "species", "Fam sp")
    census = spark.createDataFrame([("Fam", lineage((1, "phylum", "Phy"), family)), ("Fam", lineage((1, "phylum", "Phy"), family))],
                                   f"taxon string, lineage {ln.LINEAGE_TYPE}")
    members = spark.createDataFrame([("m1", lineage((1, "phylum", "Phy"), family, kind)), ("m2", lineage((2, "phylum", "Other")))],
                                    f"name string, lineage {ln.LINEAGE_TYPE}")
    pairs = mt.evidence_pairs(census, members, "family")
    assert [tuple(r) for r in pairs.collect()] == [("Fam", "m1", True, False, True, True, "high")]
    assert "REPARTITION_BY_NUM" in plan(pairs) and "Broadcast" not in plan(pairs)
