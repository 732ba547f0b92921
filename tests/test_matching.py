import random

import pytest
from pyspark.sql import functions as F

from cladetally.operators import anchor as an, figures as fg, genomes as ge, keyed as ky, matching as mt
from cladetally.plans import pipelines as pl

CENSUS = "taxon string, taxid bigint, otu_count bigint, size_count bigint, otu_percentage double, size_percentage double"
CATALOGUE = ("taxon string, domain string, genomes bigint, species bigint, isolates bigint, isolate_genomes bigint, "
             "taxid bigint, lineage string")


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(5)
    census = [(f"T{i}", rnd.choice([None, 100 + i, 7]), i, 2 * i, 0.5, 0.5) for i in range(30)]
    census += [("Bacteria", 2, 9, 9, 0.0, 0.0), ("a.b(c)", None, 4, 4, 0.0, 0.0)]
    cat = []
    for i in range(120):
        name = f"T{rnd.randrange(45)}" if i else "a.b(c)"
        parts = ["Bacteria" if i % 3 else "Archaea", f"T{rnd.randrange(40)}", name if i % 5 else "other"]
        cat.append((name + ("" if i % 7 else "x"), rnd.choice(["Bacteria", "Archaea"]), rnd.randrange(9), rnd.randrange(4),
                    rnd.randrange(3), rnd.randrange(1, 9), rnd.choice([None, 7, 100 + rnd.randrange(40)]), ";".join(parts)))
    return census, cat


def naive(census, cat, by_taxid):
    out = {}
    for c in census:
        hits = [k for k in cat if c[0] in k[7].split(";") or (by_taxid and c[1] is not None and c[1] == k[6])]
        by_id = [k for k in cat if by_taxid and c[1] is not None and c[1] == k[6]]
        if hits:
            out[c[0]] = (sum(k[2] for k in hits), sum(k[3] for k in hits), sum(k[4] for k in hits), len(hits),
                         int(any(k[0] == c[0] for k in hits)), len(by_id))
    return out


@pytest.mark.parametrize("by_taxid", [True, False])
def test_totals_equal_text_search(spark, tables, by_taxid):
    census, cat = tables
    c = spark.createDataFrame(census, CENSUS)
    k = mt.catalogue_with_parts(spark.createDataFrame(cat, CATALOGUE))
    got = {r.taxon: (r.genomes, r.species, r.isolates, r.matched_rows, r.direct_matches, r.taxid_matches)
           for r in mt.match_totals(c, k, by_taxid).collect()}
    assert got == naive(census, cat, by_taxid)


def test_pairs_and_rest_equal_text_search(spark, tables):
    census, cat = tables
    c = spark.createDataFrame(census, CENSUS)
    k = mt.catalogue_with_parts(spark.createDataFrame(cat, CATALOGUE))
    pairs = [(r.census_taxon, r.catalogue_taxon, r.match_type) for r in mt.match_pairs(c, k).collect()]
    want = []
    for a in census:
        for b in cat:
            by_id = a[1] is not None and a[1] == b[6]
            if a[0] in b[7].split(";") or by_id:
                want.append((a[0], b[0], "direct_match" if a[0] == b[0] else "taxid_match" if by_id else "lineage_match"))
    assert sorted(pairs) == sorted(want)
    reached = {p[1] for p in want}
    rest = {r.taxon for r in mt.catalogue_only(c, k).collect()}
    assert rest == {b[0] for b in cat if b[0] not in reached and (b[2] > 0 or b[3] > 0)}


def test_merge_plan_has_no_cartesian_product(spark, tables):
    c = spark.createDataFrame(tables[0], CENSUS)
    k = mt.catalogue_with_parts(spark.createDataFrame(tables[1], CATALOGUE))
    plan = mt.merge_with_catalogue(c, k, "ncbi")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_merge_factors_and_status(spark):
    c = spark.createDataFrame([("A", None, 4, 8, 1.0, 1.0), ("B", None, 3, 3, 1.0, 1.0), ("C", None, 5, 5, 1.0, 1.0)], CENSUS)
    k = mt.catalogue_with_parts(spark.createDataFrame([
        ("A", "Bacteria", 10, 3, 2, 4, None, "Bacteria;A"), ("B", "Bacteria", 2, 0, 0, 0, None, "Bacteria;B"),
        ("Z", "Bacteria", 8, 1, 1, 8, None, "Bacteria;Z")], CATALOGUE))
    rows = {r.taxon: r for r in mt.merge_with_catalogue(c, k, "ncbi").collect()}
    assert rows["A"].novelty_factor == 1.333 and rows["A"].overrepresentation_factor == 0.75
    assert rows["A"].isolate_percentage == 50.0 and rows["A"].genome_pct_db == 50.0
    assert (rows["B"].match_status, rows["B"].total_matches) == ("census_only", 1)  # matches without species
    assert rows["B"].novelty_factor == float("inf")
    assert (rows["C"].match_status, rows["C"].domain) == ("census_only", "Unknown")
    assert rows["Z"].match_status == "ncbi_only"


COUNTS, ACC = "taxon string, domain string, genomes bigint, species bigint", "accession_clean string, taxon string, domain string"


@pytest.fixture(scope="module")
def anchors(spark):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)
    counts_a = frame([("Same_A", "Bacteria", 5, 2), ("OldName", "Bacteria", 4, 2), ("Extra", "Bacteria", 3, 1),
                      ("Target2", "Archaea", 2, 1), ("Good", "Bacteria", 1, 1), ("Placeholder", "Bacteria", 1, 1), ("Euk", "Eukaryota", 9, 9)], COUNTS)
    counts_b = frame([("Same", "Bacteria", 50, 20), ("NewName", "Bacteria", 40, 20), ("Reverse", "Archaea", 30, 10),
                      ("OnlyB", "Bacteria", 20, 5), ("Xviricota", "Viruses", 7, 7), ("Candidatus Y", "Bacteria", 1, 1)], COUNTS)
    acc_a = frame([("1", "OldName", "Bacteria"), ("2", "OldName", "Bacteria"), ("3", "OldName", "Bacteria"), ("4", "Extra", "Bacteria"),
                   ("5", "Target2", "Archaea"), ("6", "Target2", "Archaea"), ("9", "Good", "Bacteria"), ("10", "Placeholder", "Bacteria")], ACC)
    acc_b = frame([("1", "NewName", "Bacteria"), ("2", "NewName", "Bacteria"), ("3", "Same", "Bacteria"), ("4", "Same", "Bacteria"),
                   ("5", "Reverse", "Archaea"), ("6", "Missing", "Archaea")], ACC)
    assemblies = frame([("9", 900), ("10", 901)], "assembly_accession string, taxid bigint")
    lineages = frame([(900, [(900, "phylum", "Realia")]), (901, [(901, "phylum", "Candidatus Z")])],
                     "taxid bigint, lineage array<struct<taxid:bigint,rank:string,name:string>>")
    return counts_a, counts_b, acc_a, acc_b, assemblies, lineages


def test_triple_anchor(anchors):
    out = pl.triple_anchor(*anchors)
    rows = {r.taxon: r for r in out.table.collect()}
    assert rows["NewName"].anchor_type == "Accession_Mapped_GTDB_to_NCBI"
    # a direct match and a mapped one consolidate; the direct match's counts stay
    assert rows["Same"].anchor_type == "Accession_Mapped_GTDB_to_NCBI+Direct_Name"
    assert (rows["Same"].gtdb_genome_count, rows["Same"].mapping_count) == (5, 2)
    # Target2's usual partner (tie: smaller name) is unknown to the counts, so it is found in reverse
    assert rows["Reverse"].anchor_type == "Accession_Mapped_NCBI_to_GTDB"
    assert rows["OnlyB"].database_presence == "NCBI_Only"
    assert rows["Good"].database_presence == "GTDB_Only"
    assert not {"Placeholder", "Euk", "Xviricota", "Candidatus Y"} & set(rows)
    assert [r.taxon for r in out.unverified.collect()] == ["Placeholder"]
    assert pl.export_anchored(out.table, "phylum").columns == [
        "Phylum", "GTDB_Domain", "NCBI_Domain", "Database_Presence", "Match_Status", "Anchor_Type",
        "GTDB_Genome_Count", "GTDB_Species_Count", "NCBI_Genome_Count", "NCBI_Species_Count"]


def test_triple_anchor_compat_has_no_gtdb_only(anchors):
    out = pl.triple_anchor(*anchors, compat=True)
    assert out.table.where("database_presence = 'GTDB_Only'").count() == 0
    assert {r.taxon for r in out.unverified.collect()} == {"Good", "Placeholder"}


def test_modal_partner_ties_take_smaller_name(spark):
    pairs = spark.createDataFrame([("a", "z", 3), ("a", "y", 3), ("a", "b", 1)], "a string, b string, n bigint")
    assert an.modal_partner(pairs, "a", "b").first()["b"] == "y"


ASM = ("assembly_accession string, taxid bigint, species_taxid bigint, genome_source string, assembly_level string, "
       "phylum string, domain string")


@pytest.fixture(scope="module")
def asm(spark):
    return spark.createDataFrame([
        ("G3", 1, 10, "uncultured", "Complete Genome", "P", "Bacteria"), ("G2", 1, 10, "isolate", "Contig", "P", "Bacteria"),
        ("G1", 1, 10, "isolate", "Contig", "P", "Bacteria"), ("G4", 2, 11, "uncultured", None, "P", "Bacteria"),
        ("G5", 3, None, "isolate", "Contig", "Q", "Archaea"),
    ], ASM)


def test_best_genome(asm):
    got = {r.species_taxid: r.assembly_accession for r in ky.best_genome_per_species(asm).collect()}
    assert got == {10: "G1", 11: "G4"}


def test_counts_ignore_missing_species(asm):
    got = {r.phylum: (r.phylum_genome_count, r.phylum_species_count) for r in ge.genome_and_species_counts(asm, "phylum").collect()}
    assert got == {"P": (4, 2), "Q": (1, 0)}


def test_rank_map_with_repeats_does_not_multiply(spark, asm):
    m = spark.createDataFrame([(1, "F1"), (1, "F1"), (2, "F2")], "taxid bigint, family string")
    assert ge.attach_rank(asm, m).count() == 4


def test_genus_parents_exact_before_partial(spark):
    top = spark.createDataFrame([("Abc",), ("Xyz",), ("None",)], "genus string")
    combos = spark.createDataFrame([
        ("Abcd", "F1", "D1", 99, "1"), ("Abc", "F2", "D2", 1, "2"), ("Wxyz Xyz", "F3", "D3", 5, "3")],
        "genus string, family string, division string, row_count bigint, taxonomic_combination string")
    got = {r.genus: (r.family, r.combination_row_count) for r in fg.genus_parents(top, combos).collect()}
    assert got == {"Abc": ("F2", 1), "Xyz": ("F3", 5), "None": ("NOT_FOUND", 0)}


def test_top_with_other_sums_the_rest(spark):
    df = spark.createDataFrame([(f"t{i}", i, 10) for i in range(20)], "k string, a bigint, b bigint")
    rows = {r.k: r for r in ky.top_with_other(df, "k", ["a", "b"], "a", 5).collect()}
    assert (rows["t19"].position, rows["Other"].position) == (1, 6)
    assert (rows["Other"].a, rows["Other"].b) == (sum(range(15)), 150)


def test_skewed_keys_give_whole_results(spark):
    """A third of all rows under one key: nothing is dropped, capped or sampled."""
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), F.col("id").alias("v"))
    best = {r.k: r.v for r in ky.first_per_key(df, ["k"], [F.desc("v")]).collect()}
    assert best["hot"] == 29997 and len(best) == 501
    few = ky.top_per_key(df, ["k"], ["v"], 3)
    assert "WindowGroupLimit" in few._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_skew_limits(spark):
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_dictionary_joins_are_split_by_aqe(spark, small_skew_limits):
    """A taxid or a name with a third of all rows: the join is split and the result is whole."""
    from cladetally.operators import taxonomy as tx

    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 2000)
    rows = spark.range(200000).select(F.sha1(F.col("id").cast("string")).alias("assembly_accession"), key.alias("taxid"))
    ranks = spark.range(2000).select(F.col("id").alias("taxid"), F.concat(F.lit("P"), F.col("id") % 9).alias("phylum"), F.lit("B").alias("domain"))
    ranked = ge.attach_rank(rows, ranks).groupBy("phylum").agg(F.count("*").alias("n"), F.max("assembly_accession"))
    assert "skew=true" in final_plan(ranked)
    assert sum(r.n for r in ranked.collect()) == 200000
    names = spark.range(2000).select(F.col("id").alias("taxid"), F.concat(F.lit("N"), "id").alias("name"))
    named = rows.select("assembly_accession", F.concat(F.lit("N"), "taxid").alias("v"))
    found = tx.name_to_taxid(named, names, "v").groupBy("taxid").agg(F.count("*").alias("n"), F.max("assembly_accession"))
    assert "skew=true" in final_plan(found)
    assert sum(r.n for r in found.collect()) == 200000


def test_eleventh_accession_verifies(spark):
    from cladetally.operators import anchor as an

    acc = spark.createDataFrame([("T", f"a{i:02}") for i in range(12)], "taxon string, accession_clean string")
    assemblies = spark.createDataFrame([("a11", 7)], "assembly_accession string, taxid int")
    lineages = spark.createDataFrame([(7, [(7, "P", "phylum")])], "taxid int, lineage array<struct<taxid:int,name:string,rank:string>>")
    row = an.verified_taxa(acc.select("taxon").distinct(), acc, assemblies, lineages).first()
    assert row["verified"] and row["sample_accessions"] == "a00, a01, a02, a03, a04"
    assert not an.verified_taxa(acc.select("taxon").distinct(), acc, assemblies, lineages, compat=True).first()["verified"]


def test_every_listed_genus_finds_its_parents(spark):
    from cladetally.operators import figures as fg

    top = spark.createDataFrame([(f"Genus{i:02}",) for i in range(40)], "genus string")
    combos = spark.createDataFrame([(f"Genus{i:02} sp", f"F{i}", "D", 1, "x") for i in range(40)],
                                   "genus string, family string, division string, row_count long, taxonomic_combination string")
    got = {r["genus"]: r["family"] for r in fg.genus_parents(top, combos).collect()}
    assert got == {f"Genus{i:02}": f"F{i}" for i in range(40)}
