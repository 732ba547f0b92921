import random

import pytest
from pyspark.sql import functions as F

from cladetally.functions import lineages as ln
from cladetally.operators import fuzzy, taxonomy as tx


def walk(taxid, nodes, names):
    path, seen = [], set()
    while taxid is not None and taxid != 1 and taxid not in seen and taxid in nodes:
        seen.add(taxid)
        path.append((taxid, nodes[taxid][1], names.get(taxid)))
        taxid = nodes[taxid][0]
    return [p for p in reversed(path) if p[2] is not None]


@pytest.fixture(scope="module")
def taxdump():
    rnd = random.Random(3)
    nodes = {1: (1, "no rank")}
    for t in range(2, 400):
        # a deep chain, then random parents
        nodes[t] = (t - 1 if t < 60 else rnd.randrange(1, t), rnd.choice(["clade", "family", "genus", "phylum"]))
    nodes[900], nodes[901], nodes[902] = (901, "clade"), (902, "genus"), (900, "family")  # a cycle
    nodes[903] = (900, "species")  # leads into the cycle
    nodes[950] = (7777, "family")  # parent not in the table
    names = {t: f"N{t}" for t in nodes if t % 17}
    return nodes, names


@pytest.fixture(scope="module")
def frames(spark, taxdump):
    nodes, names = taxdump
    return (
        spark.createDataFrame([(t, p, r) for t, (p, r) in nodes.items()], "taxid bigint, parent bigint, rank string"),
        spark.createDataFrame(list(names.items()), "taxid bigint, name string"),
    )


def test_lineages_equal_a_plain_walk(taxdump, frames):
    nodes, names = taxdump
    got = {r.taxid: [tuple(x) for x in r.lineage] for r in tx.build_lineages(*frames).collect()}
    assert set(got) == set(nodes) - {1}
    for t in got:
        assert got[t] == walk(t, nodes, names), t


def test_name_lookup_takes_smallest_taxid(spark):
    names = spark.createDataFrame([(9, "A"), (4, "A"), (5, "B")], "taxid bigint, name string")
    df = spark.createDataFrame([("A",), ("B",), ("C",)], "n string")
    got = dict(tx.name_to_taxid(df, names, "n").collect())
    assert got == {"A": 4, "B": 5, "C": None}


def test_ladders(spark):
    names = spark.createDataFrame([
        (1, "Vitis vinifera"), (2, "Rickettsia"), (3, "Theileria"), (4, "Flamella"), (5, "Embryophyceae"),
    ], "taxid bigint, name string")

    def solve(values, ladder):
        df = spark.createDataFrame([(v,) for v in values], "n string")
        rows = tx.resolve_names(df, names, "n", tx.variants_of(ladder("n"))).collect()
        return {r.n: (r.taxid, r.method) for r in rows}

    assert solve(["Vitis_vinifera.Chloroplast", "uncultured_Rickettsia_sp", "Theileria1", "nothing", "uncultured"],
                 tx.ladder_16s) == {
        "Vitis_vinifera.Chloroplast": (1, "host_or_original"), "uncultured_Rickettsia_sp": (2, "meaningful_part"),
        "Theileria1": (3, "cleaned"), "nothing": (None, "none"), "uncultured": (None, "none")}
    assert solve(["Embryophyceae_XX", "Theileria7", "Flamella-lineage", "zzz"], tx.ladder_18s) == {
        "Embryophyceae_XX": (5, "genus_fallback"), "Theileria7": (3, "direct"),
        "Flamella-lineage": (4, "hyphen_part"), "zzz": (None, "none")}


def test_eukprot_ladder(spark):
    names = spark.createDataFrame([(10, "Acanthamoeba"), (11, "Old name"), (12, "Amoebozoa"), (13, "Full name"), (14, "Oldgenus")],
                                  "taxid bigint, name string")
    nodes = spark.createDataFrame([(12, 1, "phylum"), (10, 12, "genus"), (11, 12, "species")], "taxid bigint, parent bigint, rank string")
    meta = spark.createDataFrame([
        ("E1", "Full name", [], "x"), ("E2", "Acanthamoeba sp", [], "x"), ("E3", "New name", ["Zed y", "Old name"], "x"),
        ("E4", "Newer name", ["Oldgenus foo"], "x"), ("E5", "Lost one", [], "Eukaryota;'Amoebozoa';Deep;strain 3"), ("E6", "Gone one", [], "Q"),
    ], "eukprot_id string, name_to_use string, previous_names array<string>, taxonomy string")
    got = {r.name_to_use: (r.taxid, r.match_type, r.tail) for r in tx.resolve_eukprot(meta, names, nodes).collect()}
    assert got == {
        "Full name": (13, "full", []), "Acanthamoeba sp": (10, "genus", []), "New name": (11, "previous_name", []),
        "Newer name": (14, "previous_name_genus", []),
        "Lost one": (12, "hierarchical_phylum", ["Deep", "Lost one"]), "Gone one": (None, "none", [])}


LIN = [(131567, "cellular root", "cellular organisms"), (2, "domain", "Bacteria"), (5, "clade", "C1"), (6, "clade", "C2"),
       (7, "phylum", "P"), (8, "family", "F")]


@pytest.fixture(scope="module")
def lin(spark):
    return spark.createDataFrame([(LIN,)], f"lineage {ln.LINEAGE_TYPE}")


def test_lineage_expressions(lin):
    row = lin.select(
        ln.name_at_rank("lineage", "clade").alias("first"), ln.name_at_rank("lineage", "clade", "last").alias("last"),
        ln.lineage_text(ln.truncate_lineage("lineage", "phylum")).alias("cut"),
        ln.lineage_text(ln.truncate_lineage("lineage", "order")).alias("same"),
        ln.lineage_text(ln.drop_root("lineage")).alias("rooted"),
        ln.rank_or_fallback("lineage", "division").alias("division"), ln.rank_or_fallback("lineage", "genus").alias("genus"),
        ln.detect_domain("lineage").alias("domain"),
        ln.lineage_text(ln.append_original("lineage", F.lit("F1"), F.lit(8))).alias("appended"),
    ).first()
    assert row.first == "C1" and row["last"] == "C2"
    assert row.cut.endswith(";P") and row.same.endswith(";F") and row.rooted.startswith("Bacteria;")
    assert (row.division, row.genus, row.domain) == ("C2", "F", "Bacteria")
    assert row.appended.endswith(";F;F1")


@pytest.mark.parametrize("text, expected", [
    ("x;Riboviria", "Viruses"), ("cellular organisms;Fungi", "Eukaryota"), ("cellular organisms;Archaea x", "Archaea"),
    ("cellular organisms;thing", "Bacteria"), ("thing", "Unknown"),
])
def test_domain_words(spark, text, expected):
    ranks = ";".join("no rank" for _ in text.split(";"))
    row = spark.createDataFrame([(text, ranks)], "l string, r string").select(ln.detect_domain(ln.parse_lineage("l", "r")).alias("d")).first()
    assert row.d == expected


def test_parse_lineage_is_cut_to_the_shortest_part(spark):
    row = spark.createDataFrame([("A;B;C", "domain;phylum", "1;2;x")], "n string, r string, t string").select(
        ln.parse_lineage("n", "r", "t").alias("l")).first()
    assert [tuple(x) for x in row.l] == [(1, "domain", "A"), (2, "phylum", "B")]


def test_merge_by_last_taxid_keeps_rows_without_taxid(spark):
    a = [(1, "domain", "D"), (2, "phylum", "P"), (3, "class", "C"), (4, "order", "O"), (5, "family", "Fam")]
    rows = spark.createDataFrame([("f1", "D", 3, a), ("f2", "D", 5, a), ("f3", "D", 2, None)],
                                 f"family string, domain string, n bigint, lineage {ln.LINEAGE_TYPE}")
    got = {(r.family, r.taxid, r.n) for r in tx.merge_by_last_taxid(rows, "family", "n").collect()}
    assert got == {("Fam", 5, 8), ("f3", None, 2)}
    assert {r.family for r in tx.merge_by_last_taxid(rows, "family", "n", compat=True).collect()} == {"Fam"}


def test_repair_phylum(spark):
    rows = spark.createDataFrame([
        (1, "cellular organisms;Eukaryota;SAR", "no rank;domain;clade"), (2, "Bacteria;Gammaproteobacteria", "domain;class"),
        (3, "Bacteria;Some order;x incertae sedis", "domain;order;no rank"), (4, "Eukaryota;Chlorophyceae", "domain;class"), (5, "a;b", "c;d"),
    ], "taxid bigint, lineage string, ranks string")
    got = {r.taxid: (r.phylum, r.domain, r.mapping_method) for r in tx.repair_phylum(rows).collect()}
    assert got == {
        1: ("SAR", "Eukaryota", "clade_mapping_sar"), 2: ("Pseudomonadota", "Bacteria", "bacterial_mapping_gammaproteobacteria"),
        3: ("Unclassified_some order", "Bacteria", "incertae_sedis_parent"), 4: ("chlorophyceae", "Eukaryota", "class_as_phylum")}


def test_hierarchy_orphans(spark):
    def table(rows):
        return spark.createDataFrame([(n, i, [(None, "", x) for x in lineage]) for i, (n, lineage) in enumerate(rows)],
                                     f"name string, order_no int, lineage {ln.LINEAGE_TYPE}")
    out = tx.build_hierarchy(table([("P", ["P"])]), table([("F", ["P", "F"]), ("Lone", ["Lone"])]),
                             table([("g1", ["P", "F", "g1"]), ("g2", ["P", "g2"]), ("g3", ["Lone", "g3"])]))
    got = {(r.level, r.name): (r.family, r.phylum, r.placement) for r in out.collect()}
    assert got[("genus", "g1")] == ("F", "P", "placed")
    assert got[("genus", "g2")] == (None, "P", "orphan")
    assert got[("genus", "g3")] == (None, None, "unmatched")
    assert got[("family", "Lone")][2] == "unmatched"


def test_near_names_equal_brute_force(spark):
    import difflib

    rnd = random.Random(11)
    parts = ["bac", "ter", "ia", "idae", "aceae", "mon", "pyr", "cocc", "us", "ella"]
    entries = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(200)})

    def change(word):
        letters = list(word)
        for _ in range(rnd.randint(0, 3)):
            letters.insert(rnd.randrange(len(letters) + 1), rnd.choice("abcde"))
            if rnd.random() < 0.5:
                letters.pop(rnd.randrange(len(letters)))
        return "".join(letters)

    probes = sorted({change(rnd.choice(entries)) for _ in range(150)} - set(entries))
    want = {}
    for a in probes:
        scores = [(-difflib.SequenceMatcher(None, a, b).ratio(), b) for b in entries if len(a) >= 3 and len(b) >= 3]
        good = [x for x in scores if -x[0] > (0.85 if len(a) > 5 else 0.9)]
        if good:
            want[a] = (min(good)[1], -min(good)[0])
    got = fuzzy.near_names(spark.createDataFrame([(p,) for p in probes], "a string"),
                           spark.createDataFrame([(e,) for e in entries], "b string")).collect()
    assert want and {r.a: (r.b, r.score) for r in got} == want
