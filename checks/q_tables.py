"""Readers, writers, windows, top lists and set operations on the sample tables.

The file queries write the whole derived table in the reader's own format to the session's shared
folder and read it back.
"""

import uuid

from pyspark.sql import functions as F

from cladetally.functions.common import round_even
from cladetally.operators import keyed as ky
from cladetally.session import shared_dir
from cladetally.sources import tables as st
from checks import shapes as sh
from checks.registry import query


def _place(s, name):
    return f"{shared_dir(s)}/cladetally/{name}-{uuid.uuid4().hex[:12]}"


def _tsv(df, path, header=True):
    df.write.option("sep", "\t").option("header", header).option("quote", "").csv(path)
    return path


@query("s1_read_clusters", """SELECT coalesce(division, 'NA') AS phylum, coalesce(family, 'NA') AS family, count(*) AS n, coalesce(sum(size), 0)::BIGINT AS size
 FROM clusters GROUP BY 1, 2""")
def _(s, d):
    raw = sh.clusters_16s(s, d).withColumnRenamed("family", "familiy").select(*st.CLUSTER_COLUMNS["16s"])
    back = st.read_clusters(s, _tsv(raw, _place(s, "clusters")), "16s")
    return back.groupBy(F.coalesce("phylum", F.lit("NA")).alias("phylum"), F.coalesce("family", F.lit("NA")).alias("family")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def _with_header(lines, head):
    """Write-out with the header lines first in every file."""
    def rows(batches):
        import pyarrow as pa
        yield pa.RecordBatch.from_arrays([pa.array(head)], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])
    return lines.mapInArrow(rows, "value string")


def _assembly_lines(s, d, where, columns):
    """Assemblies as lines of a summary with the given columns."""
    cols = {c: F.lit("na") for c in columns}
    cols |= {c: F.col(c).cast("string") for c in st.USED_ASSEMBLY_COLUMNS if c in columns}
    cols["taxid"] = F.when(F.col("assembly_level") == "Chromosome", "bad").otherwise(F.col("taxid").cast("string"))
    cols["seq_rel_date"] = F.date_format("seq_rel_date", "yyyy/MM/dd")
    cols["species_taxid"] = F.coalesce(F.col("species_taxid").cast("string"), F.lit("na"))
    a = sh.assemblies(s, d).where(where).select(*[c.alias(n) for n, c in cols.items()])
    return a.select(F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in a.columns]).alias("value"))


# Three layouts in one folder: 22 columns, 23 in another order, and all 28. The older ones have no genome size.
LAYOUTS = {
    "assembly_level = 'Scaffold'": st.ASSEMBLY_COLUMNS[:22],
    "assembly_level = 'Contig'": [*st.ASSEMBLY_COLUMNS[22:10:-1], *st.ASSEMBLY_COLUMNS[:11]],
    "assembly_level not in ('Scaffold', 'Contig')": st.ASSEMBLY_COLUMNS,
}


@query("s2_read_assembly_summary", """SELECT assembly_accession, taxid, species_taxid IS NULL AS no_species, assembly_level, organism_name, coalesce(nullif(isolate, ''), '-') AS isolate,
 CASE WHEN assembly_level IN ('Scaffold', 'Contig') THEN -1 ELSE genome_size END AS genome_size, strftime(seq_rel_date, '%Y-%m-%d') AS day, count(*) AS n
 FROM assemblies WHERE assembly_level <> 'Chromosome' GROUP BY ALL""")
def _(s, d):
    path = _place(s, "assembly_summary")
    for i, (where, columns) in enumerate(LAYOUTS.items()):
        _with_header(_assembly_lines(s, d, where, columns), ["##  generated", "#" + "\t".join(columns)]).write.text(f"{path}/{i}")
    back = st.read_assembly_summary(s, f"{path}/*")
    return back.groupBy("assembly_accession", "taxid", F.col("species_taxid").isNull().alias("no_species"), "assembly_level", "organism_name",
                        F.coalesce("isolate", F.lit("-")).alias("isolate"), F.coalesce("genome_size", F.lit(-1)).alias("genome_size"),
                        F.date_format("seq_rel_date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("s3_read_gtdb_taxonomy", "SELECT accession, taxonomy FROM gtdb")
def _(s, d):
    raw = sh.gtdb_taxonomy(s, d)
    bac = _tsv(raw.where("taxonomy like 'd__Bacteria%'"), _place(s, "bac"), False)
    arc = _tsv(raw.where("taxonomy not like 'd__Bacteria%'"), _place(s, "arc"), False)
    return st.read_gtdb_taxonomy(s, bac, arc)


@query("s4_read_gtdb_metadata", """SELECT accession_clean, domain, phylum, coalesce(genus, '-') AS genus FROM (SELECT accession[4:] AS accession_clean, split_part(taxonomy, ';', 1)[4:] AS domain,
 split_part(taxonomy, ';', 2)[4:] AS phylum, nullif(split_part(taxonomy, ';', 6)[4:], '') AS genus FROM gtdb)""")
def _(s, d):
    raw = sh.gtdb_taxonomy(s, d).withColumn("extra", F.lit(1))
    back = st.read_gtdb_metadata(s, _tsv(raw, _place(s, "gtdb_metadata")))
    return back.select("accession_clean", "domain", "phylum", F.coalesce("genus", F.lit("-")).alias("genus"))


@query("s5_read_taxid_map", """SELECT accession[4:] AS accession_clean, CASE n % 3 WHEN 0 THEN '12' WHEN 1 THEN '7' ELSE '40' END AS taxid
 FROM (SELECT accession, regexp_extract(accession, '([0-9]+)\\.', 1)::BIGINT AS n FROM gtdb)""")
def _(s, d):
    # The last line wins, whatever the taxid and its spelling: 5, 12; or 12, 7; or 7, 12 and 40 in a later file.
    acc = sh.gtdb_taxonomy(s, d).select("accession", F.regexp_extract("accession", r"([0-9]+)\.", 1).cast("bigint").alias("n"))
    tab = lambda x: F.concat("accession", F.lit(f"\t{x}"))
    first = F.when(F.col("n") % 3 == 0, F.array(tab(5), tab(12))).when(F.col("n") % 3 == 1, F.array(tab(12), tab(7))).otherwise(F.array(tab(7), tab(12)))
    path = _place(s, "taxid.map")
    acc.select(F.explode(F.concat(first, F.array(tab("x\ty"), F.lit("lonely")))).alias("value")).write.text(f"{path}/a")
    acc.where("n % 3 = 2").select(tab(40).alias("value")).write.text(f"{path}/b")
    return st.read_taxid_map(s, f"{path}/*")


@query("s6_read_taxdump", """SELECT n.taxid, n.parent, n.rank, m.name FROM nodes n LEFT JOIN sci m USING (taxid)""".replace("m.name", "coalesce(m.name, '-') AS name"))
def _(s, d):
    folder = _place(s, "taxdump")
    bar = "\t|\t"
    n, m = sh.nodes(s, d), sh.names_all(s, d)
    n.select(F.concat(F.concat_ws(bar, n.taxid.cast("string"), n.parent.cast("string"), n["rank"]), F.lit("\t|")).alias("value")).write.text(f"{folder}/nodes.dmp")
    m.select(F.concat(F.concat_ws(bar, m.taxid.cast("string"), m.name, F.lit(""), m.name_class), F.lit("\t|")).alias("value")).write.text(f"{folder}/names.dmp")
    nodes, names = st.read_taxdump(s, folder)
    return nodes.join(st.scientific_names(names), "taxid", "left").withColumn("name", F.coalesce("name", F.lit("-")))


@query("s7_read_eukprot", """SELECT eukprot_id, name_to_use, CASE WHEN previous = '' THEN 0 ELSE 2 END AS previous_names, taxonomy FROM eukprot""")
def _(s, d):
    back = st.read_eukprot(s, _tsv(sh.eukprot_raw(s, d), _place(s, "eukprot")))
    return back.select("eukprot_id", "name_to_use", F.size("previous_names").alias("previous_names"), "taxonomy")


@query("s8_read_rank_table", "SELECT taxon, domain, genomes, species FROM cat_genus")
def _(s, d):
    path = _place(s, "counts.csv")
    sh.catalogue(s, d, "genus").select("taxon", "domain", "genomes", "species").write.option("header", True).csv(path)
    sh.t(s, d, "region").selectExpr("concat('# note ', r_name) value").write.mode("append").text(path)
    return st.read_rank_table(s, path, "taxon string, domain string, genomes bigint, species bigint").where("genomes is not null")


@query("s9_read_assembly_reports", """SELECT assembly_accession AS accession, assembly_level, genome_source AS source, organism_name AS name, count(*) AS n FROM assemblies
 WHERE species_taxid IS NOT NULL GROUP BY ALL""")
def _(s, d):
    path = _place(s, "reports.json")
    report = F.struct(
        F.when(F.col("species_taxid").isNotNull(), F.col("assembly_accession")).alias("accession"),
        F.struct(F.lit("haploid").alias("assembly_type"), F.col("assembly_level")).alias("assembly_info"),
        F.struct(F.array(F.struct(F.lit("sample } [type").alias("name"), F.col("genome_source").alias("value")),
                         F.struct(F.lit('a "quoted" {').alias("name"), F.col("organism_name").alias("value"))).alias("attributes")).alias("biosample"))
    lines = sh.assemblies(s, d).select(F.concat(F.lit(","), F.to_json(report)).alias("value"))

    # Every file is one object with one array, its reports dealt over lines; an empty report comes first. Compressed, as plain text takes a dozen times the disk of the tables.
    def document(batches):
        import pyarrow as pa
        yield pa.RecordBatch.from_arrays([pa.array(['{"total_count": 1, "reports": [', "{}"])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["], ", '"rest": {"x": []}}'])], ["value"])

    lines.mapInArrow(document, "value string").write.option("compression", "gzip").text(path)
    rows = st.read_assembly_reports(s, path)
    return rows.groupBy("accession", "assembly_level", F.col("attributes")[0]["value"].alias("source"), F.col("attributes")[1]["value"].alias("name")).agg(F.count("*").alias("n"))


@query("s10_write_table", """SELECT doc_id, length(trim(regexp_replace(text, '[\\x00-\\x1f\\x7f\\s]+', ' ', 'g'), ' ')) AS n_chars FROM documents""")
def _(s, d):
    path = _place(s, "documents.tsv")
    st.write_table(sh.t(s, d, "documents").select("doc_id", "text"), path, "tsv")
    back = s.read.schema("doc_id bigint, text string").option("sep", "\t").option("header", True).csv(path)
    return back.select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


@query("s11_systematic_sample", """SELECT r AS record, assembly_accession, taxid FROM (SELECT assembly_accession, taxid, row_number() OVER (ORDER BY assembly_accession, taxid) - 1 AS r, count(*) OVER () AS n FROM assemblies)
 WHERE r % greatest(1, n // 500) = 0 AND r < 500 * greatest(1, n // 500)""")
def _(s, d):
    # A summary in the order of its accessions, read back in splits.
    path = _place(s, "sorted_summary")
    a = sh.assemblies(s, d).orderBy("assembly_accession", "taxid").select(F.concat_ws("\t", "assembly_accession", F.col("taxid").cast("string")).alias("value"))
    _with_header(a, ["##  generated", "#assembly_accession\ttaxid"]).write.text(path)
    parts = F.split("value", "\t")
    return ky.systematic_sample(st.read_numbered(s, path), 500).select(
        "record", parts[0].alias("assembly_accession"), parts[1].cast("bigint").alias("taxid"))


# --- windows ---------------------------------------------------------------------------------------------------
LEVEL = "CASE assembly_level WHEN 'Complete Genome' THEN 0 WHEN 'Chromosome' THEN 1 WHEN 'Scaffold' THEN 2 WHEN 'Contig' THEN 3 ELSE 4 END"


@query("w1_best_genome_per_species", f"""SELECT species_taxid, assembly_accession, assembly_level, genome_source FROM (SELECT *, row_number() OVER (PARTITION BY species_taxid
 ORDER BY genome_source = 'uncultured', {LEVEL}, assembly_accession, genome_size, gc_percent) AS rn FROM assemblies WHERE species_taxid IS NOT NULL) WHERE rn = 1""")
def _(s, d):
    best = ky.best_genome_per_species(sh.assemblies(s, d), tie_break=("assembly_accession", "genome_size", "gc_percent"))
    return best.select("species_taxid", "assembly_accession", "assembly_level", "genome_source")


@query("w1_keep_last_event", """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id) AS rn FROM events) WHERE rn = 1""")
def _(s, d):
    return ky.first_per_key(sh.t(s, d, "events"), ["user_id"], ["event_type", "ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("w2_top_flags", """SELECT taxon, novelty_factor, novelty_factor > 1 AND rn <= 10 AS is_top FROM (SELECT taxon, novelty_factor,
 row_number() OVER (ORDER BY novelty_factor DESC, taxon) AS rn FROM merged_genus WHERE match_status = 'matched')""")
def _(s, d):
    m = sh.merged(s, d).where("match_status = 'matched'")
    return ky.flag_top(m, "novelty_factor", "taxon", 10, "is_top").select("taxon", "novelty_factor", "is_top")


@query("w3_first_per_key", "SELECT taxid, min(organism_name) AS organism_name FROM assemblies GROUP BY taxid")
def _(s, d):
    return ky.first_per_key(sh.assemblies(s, d).select("taxid", "organism_name"), ["taxid"], ["organism_name"])


AXES = """SELECT taxon, position, 1 AS axis_no, 'genomes' AS axis, genomes AS c FROM topn UNION ALL SELECT taxon, position, 2, 'species', species FROM topn"""
TOPN = """topn AS (SELECT taxon, position, genomes, species FROM (SELECT taxon, genomes, species, row_number() OVER (ORDER BY genomes DESC, taxon) AS position FROM g) WHERE position <= 12
 UNION ALL SELECT 'Other', least(12, (SELECT count(*) FROM g)) + 1, coalesce(sum(genomes), 0)::BIGINT, coalesce(sum(species), 0)::BIGINT FROM (SELECT *, row_number() OVER (ORDER BY genomes DESC, taxon) AS position FROM g) WHERE position > 12)"""
G = "g AS (SELECT taxon, sum(genomes)::BIGINT AS genomes, sum(species)::BIGINT AS species FROM cat_genus GROUP BY taxon)"


def _top(s, d):
    g = sh.catalogue(s, d, "genus").groupBy("taxon").agg(F.sum("genomes").alias("genomes"), F.sum("species").alias("species"))
    return ky.top_with_other(g, "taxon", ["genomes", "species"], "genomes", 12)


def _axes(s, d):
    return ky.long_axes(_top(s, d), "taxon", {"genomes": "genomes", "species": "species"})


def _with(extra, body):
    full = sh.sql("SELECT * FROM cat_genus")
    return full[:full.rindex("\nSELECT * FROM cat_genus")] + f",\n{extra}\n{body}"


def raw_query(name, text):
    """Register a query whose text already carries its CTEs."""
    from checks import registry

    def add(fn):
        registry.QUERIES[name] = fn
        registry.ORACLES[name] = text
        return fn
    return add


@raw_query("w4_label_positions", _with(f"{G},\n{TOPN}", f"""SELECT axis, taxon, round_even(percentage * 1000, 0) / 1000 AS percentage, round_even((run - percentage / 2) * 1000, 0) / 1000 AS label_y FROM (
 SELECT *, sum(percentage) OVER (PARTITION BY axis ORDER BY position) AS run FROM (SELECT axis, taxon, position, c::DOUBLE / sum(c) OVER (PARTITION BY axis) * 100 AS percentage FROM ({AXES})) WHERE percentage >= 2)"""))
def _(s, d):
    return ky.label_positions(_axes(s, d)).select("axis", "taxon", round_even("percentage", 3).alias("percentage"), round_even("label_y", 3).alias("label_y"))


@query("w5_group_block_order", """SELECT *, row_number() OVER (ORDER BY group_max DESC, division NULLS FIRST, row_count DESC, taxonomic_combination) AS position FROM (
 SELECT taxonomic_combination, division, row_count, max(row_count) OVER (PARTITION BY division) AS group_max FROM combos)""")
def _(s, d):
    from cladetally.operators.census import taxonomic_combinations
    ordered = ky.order_by_group_block(taxonomic_combinations(sh.clusters(s, d), examples=False), "division", "row_count", ["taxonomic_combination"], "position")
    return ordered.select("taxonomic_combination", "division", "row_count", "group_max", "position")


@query("w6_first_accessions", """SELECT taxon, accession_clean, accession_no FROM (SELECT taxon, accession_clean, row_number() OVER (PARTITION BY taxon ORDER BY accession_clean) AS accession_no
 FROM (SELECT DISTINCT taxon, accession_clean FROM acc_a)) WHERE accession_no <= 10""")
def _(s, d):
    return ky.first_accessions(sh.acc_a(s, d), "taxon").select("taxon", "accession_clean", F.col("accession_no").cast("bigint").alias("accession_no"))


@query("w7_rank_in_top_list", """SELECT row_number() OVER (ORDER BY n DESC, genus) AS rank, genus, n FROM (SELECT genus, count(*) AS n FROM assemblies GROUP BY genus) QUALIFY rank <= 20""")
def _(s, d):
    n = sh.assemblies(s, d).groupBy("genus").agg(F.count("*").alias("n"))
    return ky.top_list(n, "n", 20, ["genus"]).select(F.col("rank").cast("bigint").alias("rank"), "genus", "n")


# --- top lists ---------------------------------------------------------------------------------------------------
@query("t1_top_and_bottom", """(SELECT 'top' AS part, taxonomic_combination, row_count FROM combos ORDER BY row_count DESC, taxonomic_combination LIMIT 15)
 UNION ALL (SELECT 'bottom', taxonomic_combination, row_count FROM combos ORDER BY row_count, taxonomic_combination LIMIT 15)""")
def _(s, d):
    from cladetally.operators.census import taxonomic_combinations
    c = taxonomic_combinations(sh.clusters(s, d), examples=False).select("taxonomic_combination", "row_count")
    return ky.top_k(c, "row_count", 15, ["taxonomic_combination"]).select(F.lit("top").alias("part"), "*").union(
        ky.bottom_k(c, "row_count", 15, ["taxonomic_combination"]).select(F.lit("bottom").alias("part"), "*"))


@query("t2_matched_first", """SELECT taxon, match_status, ncbi_genome_count, row_number() OVER (ORDER BY match_status <> 'matched', ncbi_genome_count DESC, taxon) AS position FROM merged_genus""")
def _(s, d):
    return ky.sort_matched_first(sh.merged(s, d), "ncbi_genome_count", "taxon", "position").select("taxon", "match_status", "ncbi_genome_count", "position")


@raw_query("t3_top_with_other", _with(f"{G},\n{TOPN}", f"SELECT taxon, position, axis, c::DOUBLE AS absolute_count FROM ({AXES})"))
def _(s, d):
    return _axes(s, d).select("taxon", F.col("position").cast("bigint").alias("position"), "axis", "absolute_count")


@raw_query("t3_axis_links", _with(f"{G},\n{TOPN}", "SELECT taxon, 'genomes' AS source, 'species' AS target, species::DOUBLE AS value FROM topn"))
def _(s, d):
    return ky.axis_links(_axes(s, d), "taxon").select("taxon", "source", "target", "value")


@query("t4_novelty_order", """SELECT taxon, novelty_factor = 'inf'::DOUBLE AS infinite, census_otu_count,
 row_number() OVER (ORDER BY novelty_factor = 'inf'::DOUBLE DESC, novelty_factor DESC, census_otu_count DESC, taxon) AS position FROM merged_genus WHERE census_otu_count > 0""")
def _(s, d):
    rows = ky.sort_by_novelty(sh.merged(s, d).where("census_otu_count > 0"), "novelty_factor", "census_otu_count", "taxon", "position")
    return rows.select("taxon", (F.col("novelty_factor") == float("inf")).alias("infinite"), "census_otu_count", "position")


@query("t4_species_order", """SELECT taxon, ncbi_species_count, census_otu_count, row_number() OVER (ORDER BY ncbi_species_count DESC, census_otu_count DESC, taxon) AS position
 FROM merged_genus WHERE match_status = 'matched'""")
def _(s, d):
    rows = ky.sort_by_species(sh.merged(s, d).where("match_status = 'matched'"), "ncbi_species_count", "census_otu_count", "taxon", "position")
    return rows.select("taxon", "ncbi_species_count", "census_otu_count", "position")


@query("w3_genus_family", """SELECT genus, family FROM (SELECT genus, family, row_number() OVER (PARTITION BY genus ORDER BY row_count DESC, family) AS rn FROM combos) WHERE rn = 1""")
def _(s, d):
    from cladetally.operators.census import taxonomic_combinations
    from cladetally.operators.figures import genus_family_map
    return genus_family_map(taxonomic_combinations(sh.clusters(s, d), examples=False))


# --- set operations --------------------------------------------------------------------------------------------------
@query("u1_union_blocks", """SELECT src, count(*) AS n, count(species) AS with_species FROM (SELECT 'a' AS src, taxon, species FROM counts_a UNION ALL SELECT 'b', taxon, NULL FROM counts_b) GROUP BY src""")
def _(s, d):
    a = sh.counts_a(s, d).select(F.lit("a").alias("src"), "taxon", "species")
    b = sh.counts_b(s, d).select(F.lit("b").alias("src"), "taxon")
    return ky.union_all(a, b).groupBy("src").agg(F.count("*").alias("n"), F.count("species").alias("with_species"))


@query("u2_accession_sets", """SELECT CASE WHEN a.k IS NULL THEN 'only_b' WHEN b.k IS NULL THEN 'only_a' ELSE 'both' END AS side, count(*) AS n
 FROM (SELECT DISTINCT accession_clean AS k FROM acc_a) a FULL JOIN (SELECT DISTINCT accession_clean AS k FROM acc_b) b ON a.k = b.k GROUP BY 1""")
def _(s, d):
    return ky.set_comparison(sh.acc_a(s, d), sh.acc_b(s, d), "accession_clean").groupBy("side").agg(F.count("*").alias("n"))


@query("u3_distinct_names", """SELECT division AS name FROM clusters WHERE division IS NOT NULL UNION SELECT family FROM clusters WHERE family IS NOT NULL UNION SELECT genus FROM clusters WHERE genus IS NOT NULL""")
def _(s, d):
    c = sh.clusters(s, d)
    return ky.distinct_names([c.select(F.col(x).alias("name")) for x in ("division", "family", "genus")], "name")
