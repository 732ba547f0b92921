import gzip
import json
import random
from collections import Counter
from pathlib import Path
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from cladetally.functions import classify as cl
from cladetally.operators import census as ce, keyed as ky, quality as qu
from cladetally.plans import pipelines as pl
from cladetally.sources import tables as st


def test_read_clusters(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("centroid\tmembers\tsize\tphylum\tfamiliy\tgenus\na\tm\t3\tP\tF\tG\nb\tm\t\tP\t\tG.U.genus\n")
    rows = st.read_clusters(spark, str(tmp_path / "c.tsv"), "16s").orderBy("centroid").collect()
    assert rows[0]["family"] == "F" and rows[1]["size"] is None and rows[1]["family"] is None


def test_read_clusters_checks_columns(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("centroid\tsize\na\t3\n")
    with pytest.raises(ValueError, match="members"):
        st.read_clusters(spark, str(tmp_path / "c.tsv"), "18s")


def test_read_assembly_summary(spark, tmp_path):
    head = "##   See README\n#" + "\t".join(st.ASSEMBLY_COLUMNS) + "\n"
    row = {c: "na" for c in st.ASSEMBLY_COLUMNS} | {"assembly_accession": "GCA_1", "taxid": "5", "species_taxid": "6",
                                                    "organism_name": 'A "q" b', "genome_size": "100", "seq_rel_date": "2020/01/31"}
    bad = row | {"taxid": "x"}
    text = head + "\n".join("\t".join(r[c] for c in st.ASSEMBLY_COLUMNS) for r in (row, bad)) + "\n# late comment\n"
    (tmp_path / "a.txt").write_text(text)
    got = st.read_assembly_summary(spark, str(tmp_path / "a.txt")).collect()
    assert len(got) == 1
    assert (got[0].taxid, got[0].organism_name, got[0].gc_percent, str(got[0].seq_rel_date)) == (5, 'A "q" b', None, "2020-01-31")


def test_read_taxid_map_and_gtdb(spark, tmp_path):
    (tmp_path / "m").write_text("RS_GCF_1.1\t5\nbroken\nGB_GCA_2.1\t6\textra\nRS_GCF_1.1\t7\n")
    assert [tuple(r) for r in st.read_taxid_map(spark, str(tmp_path / "m")).collect()] == [("GCF_1.1", "7")]
    (tmp_path / "bac").write_text("RS_GCF_1.1\td__Bacteria;p__P\n")
    (tmp_path / "arc").write_text("RS_GCF_2.1\td__Archaea;p__Q\n")
    assert st.read_gtdb_taxonomy(spark, str(tmp_path / "bac"), str(tmp_path / "arc")).count() == 2


def test_read_taxdump(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tdomain\t|\n")
    (tmp_path / "names.dmp").write_text("2\t|\tBacteria\t|\t\t|\tscientific name\t|\n2\t|\teubacteria\t|\t\t|\tsynonym\t|\n")
    nodes, names = st.read_taxdump(spark, str(tmp_path))
    assert {tuple(r) for r in nodes.collect()} == {(1, 1, "no rank"), (2, 1, "domain")}
    assert [tuple(r) for r in st.scientific_names(names).collect()] == [(2, "Bacteria")]


def test_reports_and_source(spark, tmp_path):
    doc = {"reports": [
        {"accession": "A1", "assembly_info": {"assembly_type": "metagenome-assembled"}},
        {"accession": "A2", "biosample": {"attributes": [{"name": "sample_type", "value": "pure isolate"}]}},
        {"accession": "A3", "biosample": {"attributes": [{"name": "x", "value": "y"}, {"name": "isolation_source", "value": "environmental"}]}},
        {"accession": None}]}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    rows = st.read_assembly_reports(spark, str(tmp_path / "r.json"))
    got = {r.accession: r.s for r in rows.select("accession", cl.source_from_report("assembly_type", "attributes").alias("s")).collect()}
    assert got == {"A1": "uncultured", "A2": "isolate", "A3": "uncultured"}


def test_write_table_squeezes_text(spark, tmp_path):
    df = spark.createDataFrame([("a\t b\n c", None)], "x string, y int")
    st.write_table(df, str(tmp_path / "o"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "o")).first()
    assert (back.x, back.y) == ("a b c", "NA")


@pytest.mark.parametrize("name, note, expected", [
    ("Escherichia coli", None, "isolate"), ("uncultured thing", None, "uncultured"), ("Magnetospirillum x", None, "uncultured"),
    ("enrichment culture strain X", None, "isolate"), ("enrichment culture X", None, "uncultured"), ("x", "derived from metagenome", "uncultured"),
    (None, None, "isolate"),
])
def test_genome_source(spark, name, note, expected):
    row = spark.createDataFrame([(name, note)], "n string, e string").select(cl.genome_source("n", "e").alias("s")).first()
    assert row.s == expected


def test_genome_source_whole_words(spark):
    row = spark.createDataFrame([("Magnetospirillum x",)], "n string").select(cl.genome_source("n", word_boundary=True).alias("s")).first()
    assert row.s == "isolate"


@pytest.mark.parametrize("lineage, expected", [
    ("Viruses;unclassified bacteria viruses", "viruses"), ("Bacteria;unclassified Bacteria", "unclassified_bacteria"),
    ("Eukaryota;environmental samples", "environmental_samples"), ("Bacteria;incertae sedis", "incertae_sedis"), ("Bacteria;x", "interesting_cases"),
    ("x metagenome", "metagenomes"),
])
def test_unmapped_category(spark, lineage, expected):
    row = spark.createDataFrame([(lineage,)], "l string").select(cl.unmapped_category("l", None, "family").alias("c")).first()
    assert row.c == expected


CLUSTERS = [("c1", "m", 5, "Euk", "Fam", "Gen"), ("c2", "m", 3, "Euk", "Fam", "Gen"), (None, "m", 2, "Euk.U.division", "Fam.U.family", "Gen"),
            ("c4", "m", None, "Euk", None, "Gen.U.genus"), ("c5", "m", 7, "Other", "Fam", " ")]


@pytest.fixture(scope="module")
def clusters(spark):
    return spark.createDataFrame(CLUSTERS, "centroid string, members string, size bigint, division string, family string, genus string")


def test_census_rules(clusters):
    got = {(r["rank"], r.taxon): (r.otu_count, r.size_count) for r in ce.census_all_ranks(clusters, "18s").collect()}
    assert got[("division", "Euk")] == (3, 8) and got[("genus", "Gen")] == (2, 10) and got[("division", "Euk.U.division")] == (0, 2)
    c16 = clusters.withColumnRenamed("division", "phylum")
    one = {r.taxon: (r.otu_count, r.size_count) for r in ce.census_by_rank(c16, "genus", "16s").collect()}
    assert one == {"Gen": (3, 10), "Gen.U.genus": (1, 1)}


def test_census_totals_equal_inputs(spark, clusters):
    names = spark.createDataFrame([(5, "Euk"), (6, "Gen")], "taxid bigint, name string")
    lineages = spark.createDataFrame([(5, [(5, "domain", "Euk")])], "taxid bigint, lineage array<struct<taxid:bigint,rank:string,name:string>>")
    out = pl.census(clusters, names, lineages, "18s")
    division = {r.taxon: r for r in out["division"].collect()}
    assert sum(r.otu_count for r in division.values()) == 4
    assert division["Euk"].otu_percentage == 75.0 and division["Euk"].lineage[0]["name"] == "Euk"
    assert division["Euk.U.division"].lineage[-1]["rank"] == "original_name"
    reasons = {(r["rank"], r.taxon): r.reason for r in out["unmapped"].collect()}
    assert reasons[("genus", "Gen")] == "TAXID_NO_LINEAGE" and reasons[("family", "Fam")] == "NO_TAXID_FOUND"
    text = pl.export_census(out["division"], True).where("Name_to_use = 'Euk'").first()
    assert (text.taxid, text.lineage, text.lineage_ranks) == ("5", "Euk", "domain")


def test_patterns_and_quality(clusters):
    q = pl.census_quality(clusters)
    pattern = {r.pattern: r.combinations for r in q["patterns"].collect()}
    assert pattern == {"fully_classified": 2, "multiple_unclassified": 1, "genus_unclassified": 1}
    top = q["combinations"].first()
    assert (top.taxonomic_combination, top.row_count, top.example_centroids) == ("Euk|Fam|Gen", 2, "c1; c2")


def test_distribution_against_numpy(spark):
    import numpy as np

    values = [1, 1, 2, 5, 9, 9, 9, 40]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    r = ce.distribution_stats(df, ["v"]).first()
    assert (r["mean"], r["median"], r["q25"], r["q75"]) == (np.mean(values), np.median(values), np.quantile(values, .25), np.quantile(values, .75))
    assert abs(r["std"] - np.std(values, ddof=1)) < 1e-9
    assert [x.v for x in ce.iqr_outliers(df, "v").collect()] == [40]


def test_hierarchy_conflicts(spark):
    rows = spark.createDataFrame([("G", "F1", "P"), ("G", "F2", "P"), ("H", "F1", "P")], "genus string, family string, phylum string")
    got = {(r.lower_value, r.higher_value) for r in qu.hierarchy_conflicts(rows, [("genus", "family"), ("family", "phylum")]).collect()}
    assert got == {("G", "F1"), ("G", "F2")}


def test_records_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\n" + "".join(f"a{i}\n" for i in range(700)))
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n\n" if i % 50 else f"# {i}\n" for i in range(300)))
    want = [f"a{i}" for i in range(700)] + [f"b{i}" for i in range(300) if i % 50]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "257")
    try:
        got = st.read_numbered(spark, str(tmp_path)).collect()
        assert [r.value for r in sorted(got)] == want and sorted(r.record for r in got) == list(range(len(want)))
        picked = ky.systematic_sample(st.read_numbered(spark, str(tmp_path)), 60).collect()
        assert [r.value for r in sorted(picked)] == want[::len(want) // 60][:60] and len(picked) == 60
        assert ky.systematic_sample(st.read_numbered(spark, str(tmp_path)), 5000).count() == len(want)
        # The last line of an accession wins, over splits and files.
        (tmp_path / "m").mkdir()
        (tmp_path / "m" / "1").write_text("".join(f"RS_GCF_{i % 40}.1\t{900 - i}\n" for i in range(800)))
        (tmp_path / "m" / "2").write_text("GB_GCF_3.1\t1\nRS_GCF_3.1\t100000\nRS_GCF_4.1\t9\n")
        last = {r.accession_clean: r.taxid for r in st.read_taxid_map(spark, str(tmp_path / "m")).collect()}
        assert last == {f"GCF_{i}.1": str(900 - (760 + i)) for i in range(40)} | {"GCF_3.1": "100000", "GCF_4.1": "9"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_summaries_of_three_layouts(spark, tmp_path):
    row = {c: f"{c} x" for c in st.ASSEMBLY_COLUMNS} | {"species_taxid": "6", "genome_size": "100", "gc_percent": "41.5", "seq_rel_date": "2020/01/31"}
    layouts = {"a": st.ASSEMBLY_COLUMNS[:22], "b": st.ASSEMBLY_COLUMNS[:23][::-1], "c": st.ASSEMBLY_COLUMNS}
    for i, (name, columns) in enumerate(layouts.items()):
        lines = ["##  See README", "#" + "\t".join(columns), *("\t".join((row | {"taxid": str(10 * i + k)})[c] for c in columns) for k in range(3))]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = {r.taxid: r for r in st.read_assembly_summary(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == [0, 1, 2, 10, 11, 12, 20, 21, 22]
    for taxid, r in got.items():
        assert (r.assembly_accession, r.organism_name, r.assembly_level, r.species_taxid) == ("assembly_accession x", "organism_name x", "assembly_level x", 6)
        assert (r.genome_size, r.gc_percent) == ((100, 41.5) if taxid >= 20 else (None, None)) and str(r.seq_rel_date) == "2020-01-31"
    (tmp_path / "d").write_text("#assembly_accession\ttaxid\nGCA_1\t5\n")
    with pytest.raises(ValueError, match="missing columns.*organism_name.*/d"):
        st.read_assembly_summary(spark, str(tmp_path))
    (tmp_path / "d").write_text("GCA_1\t5\n")
    with pytest.raises(Exception, match="no header in"):
        st.read_assembly_summary(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("known", [100_000, 0])
def test_reports_are_cut_at_any_byte(spark, tmp_path, monkeypatch, known):
    from cladetally.sources import reports

    monkeypatch.setattr(reports, "KNOWN_SPLITS", known)
    element = {"accession": "A", "assembly_info": {"assembly_level": 'braces }{][ and "quotes\\" \\'}, "n": [[1], {"x": {"y": "}"}}]}
    long = element | {"accession": "long", "note": "} { \\\" " * 300}
    docs = [{"meta": {"inner": {"k": 1}}, "reports": [element | {"accession": f"A{i}"} for i in range(40)] + [long], "total_count": 41},
            {"reports": []}, {"reports": [element | {"accession": "été }"}]}]
    (tmp_path / "a.json").write_text(json.dumps(docs[0], indent=1))
    (tmp_path / "b.json").write_text(json.dumps(docs[1]) + "\n" + json.dumps(docs[2], ensure_ascii=False))
    want = sorted(json.dumps(r, sort_keys=True) for doc in docs for r in doc["reports"])
    try:
        for size in (61, 200, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = reports.array_elements(spark, str(tmp_path)).collect()
            assert sorted(json.dumps(json.loads(r.json), sort_keys=True) for r in got) == want
        assert {r.accession for r in st.read_assembly_reports(spark, str(tmp_path)).collect()} >= {"A0", "long", "été }"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_orders(spark):
    df = spark.createDataFrame([
        ("a", "x", 3, 1.0, "census_only"), ("b", "x", 9, 5.0, "matched"), ("c", "y", 5, float("inf"), "matched"),
        ("d", "y", 20, 2.0, "ncbi_only"), ("e", "y", 1, 5.0, "matched"),
    ], "k string, g string, n bigint, f double, match_status string")

    def keys(frame):
        return "".join(r.k for r in frame.collect())

    assert keys(ky.sort_matched_first(df, "n", "k")) == "bceda"
    assert keys(ky.sort_by_novelty(df, "f", "n", "k")) == "cbeda"
    assert keys(ky.sort_by_species(df, "n", "f", "k")) == "dbcae"
    assert keys(ky.order_by_group_block(df, "g", "n", ["k"])) == "dceba"
    assert keys(ky.bottom_k(df, "n", 2, ["k"])) == "ea"


def test_elements_are_cut_out_of_whole_batches(spark, tmp_path, monkeypatch):
    """A batch of pieces is scanned at once: marks in strings, escapes, deeper objects, other arrays and bare values."""
    from cladetally.sources import reports

    scanned = []
    monkeypatch.setattr(reports, "Marks", type("Marks", (reports.Marks,), {"__init__": lambda self, data: (scanned.append(len(data)), super(type(self), self).__init__(data))[1]}))
    docs = [{"m": {"k": ["}", {"x": "\\"}]}, "r": [{"a": 'q"}{', "b": [{"c": 1}, []]}, {"a": "]\\\""}], "n": [1, [{"z": 1}], {"a": "é"}]}, [{"not": "under the root"}]]
    pieces = [("f", b, p) for b, d in enumerate(docs) for p in json.dumps(d, ensure_ascii=False).split("}")]
    batch = reports.pa.RecordBatch.from_arrays(
        [reports.pa.array([b for _, b, _ in pieces], reports.pa.int64()), reports.pa.array([0] * len(pieces), reports.pa.int64()),
         reports.pa.array([p for _, _, p in pieces])], names=["file", "block", "value"])
    found = [r for b in reports._cut_out([batch], {(0, 0): (False, ""), (1, 0): (False, "")}) for r in b.to_pylist()]
    want = [*docs[0]["r"], docs[0]["n"][2]]
    assert [json.loads(r["json"]) for r in found] == want and {r["part"] for r in found} == {None}
    assert len(scanned) == len(docs)


def _bytes_of(files):
    return sum(Path(unquote(urlparse(str(f)).path)).stat().st_size for f in files)


@pytest.mark.parametrize("known", [100_000, 0])
def test_reports_store_what_the_schema_reads(spark, tmp_path, monkeypatch, known):
    """Fields no schema names are not stored, whether an element lies in one split or crosses its ends."""
    from cladetally.sources import reports

    monkeypatch.setattr(reports, "KNOWN_SPLITS", known)
    rest = random.Random(7)
    docs = [[{"accession": f"{d}-{i}" if i % 5 else None, "note": '} \\" ' + rest.randbytes(1000).hex(), "assembly_info": {"assembly_level": f"l{i % 3}"}}
             for i in range(600)] for d in range(2)]
    for d, doc in enumerate(docs):
        (tmp_path / f"{d}.json").write_text(json.dumps({"reports": doc}))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = st.read_assembly_reports(spark, str(tmp_path))
        assert sorted((r.accession, r.assembly_level) for r in rows.collect()) == sorted(
            (r["accession"], r["assembly_info"]["assembly_level"]) for doc in docs for r in doc if r["accession"])
        assert _bytes_of(rows.inputFiles()) * 8 < _bytes_of(tmp_path.glob("*.json"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_compressed_reports_beside_plain_ones(spark, tmp_path):
    """A compressed file is one split, plain ones beside it are cut at any byte."""
    from cladetally.sources import reports

    docs = [{"reports": [{"accession": f"{d}-{i}", "x": '}{ \\"' * (i % 4)} for i in range(50)] + [{}], "n": 1} for d in range(4)]
    for d, doc in enumerate(docs):
        text = json.dumps(doc, indent=d % 2 or None).encode()
        (tmp_path / f"{d}.json{'.gz' * (d < 2)}").write_bytes(gzip.compress(text) if d < 2 else text)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = [json.loads(r.json) for r in reports.array_elements(spark, str(tmp_path)).collect()]
        read = [r.accession for r in st.read_assembly_reports(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(str, got)) == sorted(str(r) for doc in docs for r in doc["reports"])
    assert sorted(read) == sorted(r["accession"] for doc in docs for r in doc["reports"][:-1])


def test_report_query_takes_little_disk(spark, tmp_path, monkeypatch):
    """All reports are written and read back; on disk they and what the reader stores take a fifth of their text at most."""
    from checks import q_tables
    from checks.registry import QUERIES

    monkeypatch.setattr(q_tables, "_place", lambda s, name: str(tmp_path / name))
    spark.range(12000).selectExpr(
        "id % 2000 as l_orderkey", "id % 50 as l_partkey", "id % 9 as l_suppkey", "cast(id % 8 + 1 as int) as l_linenumber", "1D as l_quantity", "9D as l_extendedprice",
        "0.1D as l_discount", "case id % 3 when 0 then 'A' when 1 then 'N' end as l_returnflag", "timestamp'2020-01-01' as l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(49).selectExpr("id as p_partkey", "concat('name \"', id, '} ') as p_name", "'t' as p_type", "'b' as p_brand", "cast(id % 50 as int) as p_size").write.parquet(
        str(tmp_path / "part.parquet"))
    rows = QUERIES["s9_read_assembly_reports"](spark, str(tmp_path))
    want = Counter()
    for i in range(12000):
        name, line = f'name "{i % 50}}} ', i % 8 + 1
        if i % 50 < 49 and line != 7:
            want[f"GCA_{i % 2000:09d}.{line}", {1: "Complete Genome", 2: "Chromosome", 3: "Scaffold", 4: "Contig"}.get(line, "Other"), "isolate" if i % 3 == 0 else "uncultured",
                 (name, f"uncultured {name}", f"{name} strain {i % 9}")[i % 3]] += 1
    assert {tuple(r)[:4]: r.n for r in rows.collect()} == want
    text = spark.read.option("lineSep", "\n").text(str(tmp_path / "reports.json"))
    written = text.selectExpr("sum(octet_length(value) + 1)").first()[0]
    assert written > 1_000_000 and 5 * (_bytes_of((tmp_path / "reports.json").glob("part-*")) + _bytes_of(rows.inputFiles())) < written
