import os
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, compare

SF = "/root/testdata/sf0.001"
QUICK = [
    "a1_census_by_rank_18s", "a4_species_counts", "a14_unclassified_patterns", "a18_distribution", "a30_hierarchy_conflicts",
    "g1_pattern_source", "j4_catalogue_only", "j9_consolidate", "j3_ancestor_match_log", "j7_accession_mapping", "l1_build_lineages", "l3_resolve_18s", "l19_fuzzy_match",
    "merge_ncbi_genus", "n4_clean_organelle_name", "p3_ncbi_counts",
    "p5_eukprot_lineages", "p6_merge_18s_ncbi", "p7_triple_anchor", "p10_scatter_table", "s2_read_assembly_summary", "top_novel_families", "w1_best_genome_per_species",
]
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="sample tables absent")


def test_registry_is_consistent():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 200
    own = entry._load()
    assert set(own.QUERIES) == set(own.ORACLES)


def test_entry_works_where_training_data_cannot_be_imported(monkeypatch):
    monkeypatch.setitem(sys.modules, "cladetally.llm.queries", None)
    assert set(entry.queries()) == set(entry._load().QUERIES)


@needs_data
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "novelty_factor" in df.columns


@needs_data
@pytest.mark.parametrize("name", sorted(entry._load().QUERIES) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    if name in entry.oracle_sql():
        problem, rows = compare(df, con, entry.oracle_sql()[name])
        assert problem is None, problem
        assert rows > 0
