import re

import pytest
from hypothesis import given, settings, strategies as st

from cladetally.functions import names as nm, predicates as pr


@pytest.mark.parametrize("given_name, expected", [
    ("Theileria1", "Theileria"), ("Eimeria 12", "Eimeria"), ("123", "1"), ("7", "7"), (" 7", " 7"),
    ("A1B2", "A1B"), ("plain", "plain"), ("", ""), ("a 1 2", "a 1"),
])
def test_strip_trailing_numbers(one, given_name, expected):
    assert one(given_name, nm.strip_trailing_numbers) == expected


def plain_strip(name):
    if not name:
        return name
    m = re.match(r"^(.+?)(\d+)$", name.strip(" \t\r\n"))
    return m.group(1).rstrip() if m else name


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aB1 _9", max_size=8), min_size=1, max_size=40))
def test_strip_trailing_numbers_against_plain(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "x string")
    got = [r["y"] for r in rows.select(nm.strip_trailing_numbers("x").alias("y")).collect()]
    assert got == [plain_strip(n) for n in names]


@pytest.mark.parametrize("given_name, expected", [
    ("Vitis_vinifera:plas.Chloroplast", "Vitis vinifera"),
    ("uncultured_bacterium.Mitochondria", "uncultured bacterium"),
    ("Genus_species.Plastid", "Genus species"),
    ("Gammaproteobacteria.U.family", "Gammaproteobacteria"),
    ("Embryophyceae_XX", "Embryophyceae XX"),
    ("Clade_X_1", "Clade  X"),
    ("Theileria1", "Theileria"),
    ("Unknown", "Unknown"),
    (None, None),
])
def test_clean_organelle_name(one, given_name, expected):
    assert one(given_name, nm.clean_organelle_name) == expected


@pytest.mark.parametrize("given_name, kind, base", [
    ("Vitis_vinifera:plas.Chloroplast", "chloroplast", "Vitis_vinifera"),
    ("A:mito.Mitochondria", "mitochondria", "A"), ("x:Apicoplast", "apicoplast", "x"), ("plain", None, "plain"),
])
def test_detect_organelle(one, given_name, kind, base):
    got = one(given_name, nm.detect_organelle)
    assert (got["organelle_type"], got["base_name"], got["is_organelle"]) == (kind, base, kind is not None)


@pytest.mark.parametrize("given_name, expected", [
    ("Vitis_vinifera.Chloroplast", "Vitis vinifera"), ("Vitis_vinifera:Plastid", "Vitis vinifera"),
    ("plain", None), (".Chloroplast", None),
])
def test_organelle_host(one, given_name, expected):
    assert one(given_name, nm.organelle_host) == expected


@pytest.mark.parametrize("given_name, expected", [
    ("uncultured_Alphaproteobacteria_bacterium", "Alphaproteobacteria"), ("uncultured_Rickettsia_sp", "Rickettsia"),
    ("marine_metagenome", None), ("Rickettsia", None), ("uncultured_A_Bcd_Efg_Hij", "Bcd Efg"),
    ("uncultured_proteobacteria", "proteobacteria"),
])
def test_meaningful_part(one, given_name, expected):
    assert one(given_name, nm.meaningful_part) == expected


@pytest.mark.parametrize("given_name, expected", [
    ("Flamella-lineage", "Flamella"), ("Blastocystis-Group", "Blastocystis"), ("Endomyxa-Ascetosporea_XX", "Ascetosporea"),
    ("Novel-Clade-4_X", None), ("plain", None), ("Mataza-lineage_X", "Mataza"),
])
def test_hyphen_extract(one, given_name, expected):
    assert one(given_name, nm.hyphen_extract) == expected


@pytest.mark.parametrize("given_name, expected", [
    ("Acanthamoeba sp", "Acanthamoeba"), ("Acanthamoeba sp.", "Acanthamoeba"), ("Acanthamoeba sp ATCC", "Acanthamoeba"),
    ("Acanthamoeba castellanii", "Acanthamoeba"), ("lower case", None), (None, None),
])
def test_genus_of_organism(one, given_name, expected):
    assert one(given_name, nm.genus_of_organism) == expected


@pytest.mark.parametrize("rank, given_name, expected", [
    ("genus", "Vitis_vinifera", "Vitis"), ("family", "Vitis_vinifera", None), ("phylum", "Vitis_vinifera", None),
    ("family", "Vitaceae", "Vitaceae"), ("genus", "Vitis", "Vitis"),
])
def test_appropriate_rank_name(one, rank, given_name, expected):
    assert one(given_name, lambda c: nm.appropriate_rank_name(c, rank)) == expected


@pytest.mark.parametrize("fn, given_name, expected", [
    (nm.normalize_name, "Bacillota_A", "bacillota"), (nm.normalize_name, None, ""),
    (nm.strip_variant_suffix, "Bacillota_A", "Bacillota"), (nm.strip_variant_suffix, "Bacillota_AB", "Bacillota_AB"),
    (nm.clean_accession, "RS_GCF_000000001.1", "GCF_000000001.1"),
    (nm.clean_taxid, "12 x\n34", "12"), (nm.clean_taxid, "FAILED", "FAILED"), (nm.clean_taxid, "none", "none"),
    (nm.clean_merge_name, "Candidatus X_A", "X"), (nm.clean_merge_name, "Y_12", "Y"),
    (nm.canonical_name, "Methanobacteriota", "Euryarchaeota"), (nm.cut_strain, "A  b strain 4", "A b"),
    (nm.base_group, "Eukaryota.U.division", "Eukaryota"), (nm.fix_family_case, "vITACEAE*", "Vitaceae"),
    (nm.fix_family_case, None, "Unclassified"), (nm.species_of_organism, "A b c", "A b"),
    (nm.apply_synonyms, "Maxillopoda", "Copepoda"), (nm.apply_synonyms, "MAST-12", "MAST-12"),
    (nm.genus_of_taxonomy, "Eukaryota;Amoebozoa;two words;low", "Amoebozoa"),
    (nm.genus_of_census_name, "Genus_species.Mitochondria", "Genus"),
])
def test_small_rules(one, fn, given_name, expected):
    assert one(given_name, fn) == expected


def test_genus_spelling(spark):
    rows = spark.createDataFrame([
        ("Acanthomoeba x", "Eukaryota;Acanthamoeba;Acanthomoeba x"), ("Vitis x", "Eukaryota;Quercus;Vitis x"),
    ], "name string, lineage string")
    fix = nm.repair_genus_spelling("name", nm.lineage_genus("lineage"))
    got = [(r["f"]["name"], r["f"]["correction_type"]) for r in rows.select(fix.alias("f")).collect()]
    assert got == [("Acanthamoeba x", "genus_spelling"), ("Vitis x", "none")]


@pytest.mark.parametrize("fn, given_name, expected", [
    (pr.is_verifiable_phylum, "Candidatus X", False), (pr.is_verifiable_phylum, "Bacillota", True),
    (pr.is_verifiable_phylum, None, False), (pr.is_placeholder, " Missing ", True), (pr.is_placeholder, None, False),
    (pr.is_unclassified_name, "A.U.b", True), (pr.is_unclassified_name, "AxUxb", False),
    (pr.is_eukaryote_group, "Streptophyta_x", True), (pr.is_virus_name, "Nucleocytoviricota", True),
])
def test_predicates(one, fn, given_name, expected):
    assert one(given_name, fn) is expected
