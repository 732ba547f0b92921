"""Whole pipelines on the sample shapes."""

from pyspark.sql import functions as F

from cladetally.functions import lineages as ln
from cladetally.functions.common import round_even
from cladetally.plans import pipelines as pl
from cladetally.sources.tables import shape_eukprot
from checks import shapes as sh
from checks.q_taxonomy import LADDER_18S
from checks.registry import query


@query("top_novel_families", """SELECT row_number() OVER (ORDER BY novelty_factor DESC, taxon) AS rank, taxon, census_otu_count, ncbi_species_count, novelty_factor, overrepresentation_factor
 FROM merged_family WHERE match_status = 'matched' QUALIFY rank <= 10""")
def _(s, d):
    out = pl.top_novel_taxa(sh.merged(s, d, "family"), 10)
    return out.select(F.col("rank").cast("bigint").alias("rank"), "taxon", "census_otu_count", "ncbi_species_count", "novelty_factor", "overrepresentation_factor")


@query("top_novel_genera", """SELECT row_number() OVER (ORDER BY novelty_factor DESC, taxon) AS rank, taxon, census_otu_count, ncbi_species_count, novelty_factor, overrepresentation_factor
 FROM merged_genus WHERE match_status = 'matched' QUALIFY rank <= 25""")
def _(s, d):
    out = pl.top_novel_taxa(sh.merged(s, d, "genus"), 25)
    return out.select(F.col("rank").cast("bigint").alias("rank"), "taxon", "census_otu_count", "ncbi_species_count", "novelty_factor", "overrepresentation_factor")


RESOLVED = LADDER_18S.replace("FROM src", "FROM (SELECT DISTINCT genus AS name FROM clusters WHERE genus IS NOT NULL)")


@query("p1_census_18s", f"""SELECT r.name AS "Name_to_use", coalesce(r.taxid::VARCHAR, 'NA') AS taxid, c.otu_count, c.size_count, coalesce(l.lineage, '') || CASE WHEN regexp_matches(r.name, '[0-9_]|\\.U\\.') THEN CASE WHEN l.lineage IS NULL THEN '' ELSE ';' END || r.name ELSE '' END AS lineage
 FROM ({RESOLVED}) r JOIN census_genus c ON c.taxon = r.name LEFT JOIN lin l ON l.taxid = r.taxid""")
def _(s, d):
    out = pl.census(sh.clusters(s, d), sh.names_stored(s, d), sh.tree_stored(s, d), "18s")
    return pl.export_census(out["genus"], False).select("Name_to_use", "taxid", "otu_count", "size_count", "lineage")


@query("p1_census_16s_phylum", f"""SELECT taxon, otu_count, round_even(otu_count::DOUBLE / sum(otu_count) OVER () * 100 * 100, 0) / 100 AS otu_percentage, size_count FROM (SELECT division AS taxon, count(*) AS otu_count, sum(coalesce(size, 1))::BIGINT AS size_count FROM clusters GROUP BY 1)""")
def _(s, d):
    out = pl.census(sh.clusters_16s(s, d), sh.names_stored(s, d), sh.tree_stored(s, d), "16s")
    return out["phylum"].select("taxon", "otu_count", "otu_percentage", "size_count")


@query("p1_census_unmapped", f"""SELECT c.rank, c.taxon, c.otu_count FROM (SELECT 'division' AS rank, division AS taxon, count(centroid) AS otu_count FROM clusters GROUP BY 2 UNION ALL SELECT 'family', family, count(centroid) FROM clusters GROUP BY 2
 UNION ALL SELECT 'genus', genus, count(centroid) FROM clusters WHERE genus IS NOT NULL GROUP BY 2) c LEFT JOIN ({LADDER_18S.replace("FROM src", "FROM (SELECT division AS name FROM clusters UNION SELECT family FROM clusters UNION SELECT genus FROM clusters)")}) r ON r.name = c.taxon
 LEFT JOIN lin l ON l.taxid = r.taxid WHERE l.taxid IS NULL""")
def _(s, d):
    out = pl.census(sh.clusters(s, d), sh.names_stored(s, d), sh.tree_stored(s, d), "18s")
    return out["unmapped"].select("rank", "taxon", "otu_count")


@query("p2_taxid_rank_map", """SELECT DISTINCT a.taxid, l.family, l.superkingdom AS domain FROM assemblies a JOIN lin l USING (taxid) WHERE l.family IS NOT NULL""")
def _(s, d):
    return pl.taxid_rank_map(sh.assemblies(s, d), sh.nodes(s, d), sh.sci_names(s, d), "family")[0]


P3 = """SELECT m.phylum, m.domain, count(*) AS phylum_genome_count, count(DISTINCT coalesce(a.species_taxid, sp.species_taxid, a.taxid)) AS phylum_species_count FROM assemblies a JOIN map_phylum m USING (taxid) LEFT JOIN (SELECT taxid, a_taxid AS species_taxid FROM tree WHERE a_rank = 'species') sp USING (taxid) GROUP BY 1, 2"""


@query("p3_ncbi_counts", f"""SELECT c.phylum AS phylum, domain, phylum_genome_count, round_even(phylum_genome_count::DOUBLE / sum(phylum_genome_count) OVER () * 100 * 100, 0) / 100 AS phylum_genome_percentage, phylum_species_count, coalesce(x.taxid::VARCHAR, 'NA') AS taxid, coalesce(l.lineage, '') AS lineage
 FROM ({P3}) c LEFT JOIN lookup x ON x.name = c.phylum LEFT JOIN lin l ON l.taxid = x.taxid""")
def _(s, d):
    counts, _ = pl.ncbi_counts(sh.assemblies(s, d), sh.rank_map(s, d, "phylum"), sh.names_stored(s, d), sh.tree_stored(s, d), "phylum")
    return counts.select("phylum", "domain", "phylum_genome_count", "phylum_genome_percentage", "phylum_species_count",
                         F.coalesce(F.col("taxid").cast("string"), F.lit("NA")).alias("taxid"), ln.lineage_text("lineage").alias("lineage"))


def _p3_rank(rank):
    sql = f"""SELECT c.{rank}, domain, {rank}_genome_count, round_even({rank}_genome_count::DOUBLE / sum({rank}_genome_count) OVER () * 100 * 100, 0) / 100 AS {rank}_genome_percentage, {rank}_species_count,
 coalesce(x.taxid::VARCHAR, 'NA') AS taxid, coalesce(l.lineage, '') AS lineage FROM ({P3.replace('phylum', rank)}) c LEFT JOIN lookup x ON x.name = c.{rank} LEFT JOIN lin l ON l.taxid = x.taxid"""

    @query(f"p3_ncbi_counts_{rank}", sql)
    def _(s, d):
        counts, _ = pl.ncbi_counts(sh.assemblies(s, d), sh.rank_map(s, d, rank), sh.names_stored(s, d), sh.tree_stored(s, d), rank)
        return counts.select(rank, "domain", f"{rank}_genome_count", f"{rank}_genome_percentage", f"{rank}_species_count",
                             F.coalesce(F.col("taxid").cast("string"), F.lit("NA")).alias("taxid"), ln.lineage_text("lineage").alias("lineage"))


for _rank in ("family", "genus"):
    _p3_rank(_rank)


@query("p3_accessions", """SELECT a.assembly_accession AS accession_clean, m.family, m.domain, a.assembly_level, a.genome_source, a.taxid, count(*) AS n FROM (
 SELECT assembly_accession, assembly_level, taxid, CASE WHEN contains(lower(organism_name), 'uncultured') OR contains(lower(coalesce(excluded_from_refseq, '')), 'metagenome') THEN 'uncultured' ELSE 'isolate' END AS genome_source FROM assemblies) a
 JOIN map_family m USING (taxid) GROUP BY ALL""")
def _(s, d):
    _, rows = pl.ncbi_counts(sh.assemblies(s, d), sh.rank_map(s, d, "family"), sh.names_stored(s, d), sh.tree_stored(s, d), "family")
    return rows.groupBy("accession_clean", "family", "domain", "assembly_level", "genome_source", "taxid").agg(F.count("*").alias("n"))


@query("p2_taxid_rank_map_phylum", """SELECT DISTINCT a.taxid, l.phylum, l.superkingdom AS domain FROM assemblies a JOIN lin l USING (taxid) WHERE l.phylum IS NOT NULL""")
def _(s, d):
    return pl.taxid_rank_map(sh.assemblies(s, d), sh.nodes(s, d), sh.sci_names(s, d), "phylum")[0]


def _gtdb(s, d, rank):
    """The chain of a rank. The first catalogue knows some nations as families and all market segments as phyla."""
    tree = sh.tree_stored(s, d)
    known = sh.t(s, d, "nation").where("n_regionkey < 2").selectExpr("cast(100 + n_nationkey as bigint) taxid", "concat('F', n_nationkey) name").union(
        sh.t(s, d, "customer").selectExpr("cast(10 + length(c_mktsegment) % 5 as bigint) taxid", "c_mktsegment name").distinct())
    return pl.gtdb_catalogue(sh.gtdb_taxonomy(s, d), rank, [("gtdb", known), ("ncbi", sh.names_stored(s, d))], {"gtdb": tree, "ncbi": tree})


def _with_texts(df):
    return df.withColumns({"taxid": F.coalesce(F.col("taxid").cast("string"), F.lit("NA")), "lineage": F.coalesce(ln.lineage_text("lineage"), F.lit(""))})


@query("p4_gtdb_counts", """SELECT c.family, c.domain, c.family_counts, coalesce(n.taxid::VARCHAR, 'NA') AS taxid, coalesce(l.lineage, '') AS lineage FROM (
 SELECT regexp_replace(family, '_[A-Z]$', '') AS family, domain, count(*) AS family_counts FROM gtdb_ranks WHERE family IS NOT NULL GROUP BY 1, 2) c
 LEFT JOIN (SELECT 'F' || n_nationkey AS family, 100 + n_nationkey AS taxid FROM nation WHERE n_regionkey < 2) n USING (family) LEFT JOIN lin l ON l.taxid = n.taxid""")
def _(s, d):
    return _with_texts(_gtdb(s, d, "family")["counts"]).select("family", "domain", "family_counts", "taxid", "lineage")


@query("p4_gtdb_counts_phylum", """SELECT c.phylum, c.domain, c.phylum_counts, (10 + length(c.phylum) % 5)::VARCHAR AS taxid, 'gtdb' AS taxid_source, coalesce(l.lineage, '') AS lineage FROM (
 SELECT regexp_replace(phylum, '_[A-Z]$', '') AS phylum, domain, count(*) AS phylum_counts FROM gtdb_ranks GROUP BY 1, 2) c LEFT JOIN lin l ON l.taxid = 10 + length(c.phylum) % 5""")
def _(s, d):
    return _with_texts(_gtdb(s, d, "phylum")["counts"]).select("phylum", "domain", "phylum_counts", "taxid", "taxid_source", "lineage")


@query("p4_conflicts")
def _(s, d):
    return _gtdb(s, d, "family")["conflicts"].drop("parents")


@query("p4_chain_species", "SELECT regexp_replace(genus, '_[A-Z]$', '') AS genus, domain, count(DISTINCT species) AS genus_species_count FROM gtdb_ranks WHERE genus IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    return _gtdb(s, d, "genus")["species"]


@query("p4_gtdb_species_counts", "SELECT regexp_replace(family, '_[A-Z]$', '') AS family, domain, count(DISTINCT species) AS family_species_count FROM gtdb_ranks WHERE family IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    return pl.gtdb_species(sh.gtdb_taxonomy(s, d), "family")


@query("p5_eukprot_lineages", """SELECT match_type, count(*) AS n, sum(len(string_split(lineage, ';')))::BIGINT AS parts FROM (SELECT CASE kind WHEN 0 THEN 'full' WHEN 1 THEN 'genus' WHEN 2 THEN 'previous_name' WHEN 3 THEN 'previous_name_genus' WHEN 4 THEN 'hierarchical_phylum' ELSE 'none' END AS match_type,
 coalesce(l.lineage, '') || CASE WHEN kind IN (1, 3) THEN ';' || name_to_use WHEN kind = 4 THEN ';Nothing;Deeper;' || name_to_use ELSE '' END AS lineage
 FROM eukprot e LEFT JOIN lin l ON l.taxid = CASE kind WHEN 0 THEN own_taxid WHEN 1 THEN nation_taxid WHEN 2 THEN own_taxid WHEN 3 THEN nation_taxid WHEN 4 THEN nation_taxid END) GROUP BY 1""")
def _(s, d):
    out = pl.eukprot_lineages(shape_eukprot(sh.eukprot_raw(s, d)), sh.names_stored(s, d), sh.nodes(s, d), sh.tree_stored(s, d))
    return out.groupBy("match_type").agg(F.count("*").alias("n"), F.sum(F.size(F.split(ln.lineage_text("lineage"), ";"))).alias("parts"))


@query("p5_lineage_rows", """SELECT name_to_use, match_type, lineage, count(*) AS n FROM (SELECT name_to_use, CASE kind WHEN 0 THEN 'full' WHEN 1 THEN 'genus' WHEN 2 THEN 'previous_name' WHEN 3 THEN 'previous_name_genus' WHEN 4 THEN 'hierarchical_phylum' ELSE 'none' END AS match_type,
 coalesce(l.lineage, '') || CASE WHEN kind IN (1, 3) THEN ';' || name_to_use WHEN kind = 4 THEN ';Nothing;Deeper;' || name_to_use ELSE '' END AS lineage
 FROM eukprot e LEFT JOIN lin l ON l.taxid = CASE kind WHEN 0 THEN own_taxid WHEN 1 THEN nation_taxid WHEN 2 THEN own_taxid WHEN 3 THEN nation_taxid WHEN 4 THEN nation_taxid END) GROUP BY ALL""")
def _(s, d):
    out = pl.eukprot_lineages(shape_eukprot(sh.eukprot_raw(s, d)), sh.names_stored(s, d), sh.nodes(s, d), sh.tree_stored(s, d))
    return out.groupBy("name_to_use", "match_type", ln.lineage_text("lineage").alias("lineage")).agg(F.count("*").alias("n"))


# the sample domains are the part types; two of them read as Bacteria and Archaea, two as Eukaryota
DOMAIN = "CASE domain WHEN 'ECONOMY' THEN 'Bacteria' WHEN 'SMALL' THEN 'Archaea' ELSE 'Eukaryota' END"


def _catalogue(s, d, rank):
    return sh.catalogue_full(s, d, rank).withColumn("domain", F.expr(DOMAIN))


def _merge_sql(cat_where, census_where, isolate_denominator, by_taxid):
    pair = "p.by_lineage" if not by_taxid else "(p.by_lineage OR p.by_taxid)"
    return f"""SELECT c.taxon, c.otu_count AS census_otu_count, coalesce(m.g, 0) AS ncbi_genome_count, coalesce(m.s, 0) AS ncbi_species_count,
 CASE WHEN m.den > 0 THEN round_even(m.i::DOUBLE / m.den * 100 * 100, 0) / 100 ELSE 0 END AS isolate_percentage, CASE WHEN m.s > 0 THEN 'matched' ELSE 'census_only' END AS match_status
 FROM census_genus c LEFT JOIN (SELECT p.taxon, sum(p.genomes)::BIGINT AS g, sum(p.species)::BIGINT AS s, sum(p.isolates)::BIGINT AS i, sum({isolate_denominator})::BIGINT AS den FROM pairs_genus p WHERE {pair} AND {cat_where} GROUP BY p.taxon) m USING (taxon)
 WHERE {census_where.format(x='c.taxon')}
 UNION ALL SELECT k.taxon, 0, k.genomes, k.species, CASE WHEN i.isolate_genomes > 0 THEN round_even(i.isolates::DOUBLE / i.isolate_genomes * 100 * 100, 0) / 100 ELSE 0 END, 'ncbi_only'
 FROM cat_genus k LEFT JOIN iso_genus i ON i.taxon = k.taxon AND i.domain = k.domain WHERE {cat_where.replace('p.', 'k.').replace('cat_taxon', 'taxon')} AND k.taxon NOT IN (SELECT p.cat_taxon FROM pairs_genus p WHERE {pair} AND {cat_where} AND {census_where.format(x='p.taxon')})"""


@query("p6_merge_16s_ncbi", _merge_sql("p.domain IN ('ECONOMY', 'SMALL') AND NOT contains(lower(p.cat_taxon), 'candidat')", "true", "p.isolate_genomes", True))
def _(s, d):
    out = pl.merge_census(sh.census(s, d, "genus"), _catalogue(s, d, "genus"), "16s", "ncbi", "genus")
    return out.table.select("taxon", "census_otu_count", "ncbi_genome_count", "ncbi_species_count", "isolate_percentage", "match_status")


@query("p6_merge_18s_ncbi", _merge_sql("p.domain NOT IN ('ECONOMY', 'SMALL')", "true", "p.genomes", False))
def _(s, d):
    out = pl.merge_census(sh.census(s, d, "genus"), _catalogue(s, d, "genus"), "18s", "ncbi", "genus")
    return out.table.select("taxon", "census_otu_count", "ncbi_genome_count", "ncbi_species_count", "isolate_percentage", "match_status")


@query("p6_merge_16s_gtdb", """SELECT c.taxon, coalesce(m.g, 0) AS gtdb_genome_count, coalesce(m.g, 0) AS gtdb_species_count, CASE WHEN m.g > 0 THEN 'matched' ELSE 'census_only' END AS match_status FROM census_genus c LEFT JOIN (SELECT taxon, sum(genomes)::BIGINT AS g FROM pairs_genus WHERE by_lineage AND domain IN ('ECONOMY', 'SMALL') GROUP BY 1) m USING (taxon)
 UNION ALL SELECT taxon, genomes, genomes, 'gtdb_only' FROM cat_genus WHERE domain IN ('ECONOMY', 'SMALL') AND taxon NOT IN (SELECT cat_taxon FROM pairs_genus WHERE by_lineage AND domain IN ('ECONOMY', 'SMALL'))""")
def _(s, d):
    out = pl.merge_census(sh.census(s, d, "genus"), _catalogue(s, d, "genus"), "16s", "gtdb", "genus")
    return out.table.select("taxon", "gtdb_genome_count", "gtdb_species_count", "match_status")


@query("p6_match_log", """SELECT match_type, count(*) AS n, sum(genomes)::BIGINT AS genomes FROM (SELECT genomes, CASE WHEN taxon = cat_taxon THEN 'direct_match' WHEN by_taxid THEN 'taxid_match' ELSE 'lineage_match' END AS match_type FROM pairs_genus WHERE domain IN ('ECONOMY', 'SMALL')) GROUP BY 1""")
def _(s, d):
    out = pl.merge_census(sh.census(s, d, "genus"), _catalogue(s, d, "genus"), "16s", "ncbi", "genus")
    return out.match_log.groupBy("match_type").agg(F.count("*").alias("n"), F.sum("genomes").alias("genomes"))


def _anchored(s, d, compat, rank="phylum"):
    asm = sh.t(s, d, "orders").selectExpr("cast(o_orderkey as string) assembly_accession", "o_custkey * 5 + 1000 taxid")
    return pl.triple_anchor(sh.counts_a(s, d), sh.counts_b(s, d), sh.acc_a(s, d), sh.acc_b(s, d), asm, sh.tree_stored(s, d), rank, compat=compat)


def _register_p7():
    from checks import registry
    from checks.q_matching import ANCHOR_SQL

    verified = sh.sql("""SELECT taxon, bool_or(coalesce(l.phylum IS NOT NULL, false)) AS ok FROM (SELECT DISTINCT taxon, accession_clean FROM acc_a) LEFT JOIN (SELECT o_orderkey::VARCHAR AS accession_clean, o_custkey * 5 + 1000 AS taxid FROM orders) o USING (accession_clean) LEFT JOIN lin l USING (taxid) GROUP BY taxon""")
    registry.ORACLES["p7_triple_anchor"] = f"SELECT taxon, database_presence, anchor_type, gtdb_genome_count, ncbi_genome_count FROM ({ANCHOR_SQL}) WHERE database_presence <> 'GTDB_Only' OR taxon IN (SELECT taxon FROM ({verified}) WHERE ok)"
    registry.ORACLES["p7_triple_anchor_family"] = registry.ORACLES["p7_triple_anchor"].replace("l.phylum IS NOT NULL", "l.family IS NOT NULL")
    registry.ORACLES["p7_triple_anchor_compat"] = f"SELECT taxon, database_presence, anchor_type, gtdb_genome_count, ncbi_genome_count FROM ({ANCHOR_SQL}) WHERE database_presence <> 'GTDB_Only'"
    registry.ORACLES["p7_unverified_compat"] = f"SELECT taxon, gtdb_genome_count FROM ({ANCHOR_SQL}) WHERE database_presence = 'GTDB_Only'"


@query("p7_triple_anchor")
def _(s, d):
    return _anchored(s, d, False).table.select("taxon", "database_presence", "anchor_type", "gtdb_genome_count", "ncbi_genome_count")


@query("p7_triple_anchor_family")
def _(s, d):
    return _anchored(s, d, False, "family").table.select("taxon", "database_presence", "anchor_type", "gtdb_genome_count", "ncbi_genome_count")


@query("p7_triple_anchor_compat")
def _(s, d):
    return _anchored(s, d, True).table.select("taxon", "database_presence", "anchor_type", "gtdb_genome_count", "ncbi_genome_count")


@query("p7_unverified_compat")
def _(s, d):
    return _anchored(s, d, True).unverified.select("taxon", "gtdb_genome_count")


_register_p7()


@query("p8_census_quality", "SELECT count(*) AS combinations, sum(row_count)::BIGINT AS clusters, count(DISTINCT split_part(division, '.U.', 1)) AS divisions FROM combos")
def _(s, d):
    q = pl.census_quality(sh.clusters(s, d))
    totals = q["patterns"].agg(F.sum("combinations").alias("combinations"), F.sum("clusters").alias("clusters"))
    divisions = q["division_sizes"].agg(F.count("*")).scalar()
    return totals.withColumn("divisions", divisions)


@query("p9_species_report", """SELECT genomes, count(*) AS species FROM (SELECT CASE WHEN n < 2 THEN '1' WHEN n < 5 THEN '2-4' WHEN n < 10 THEN '5-9' WHEN n < 50 THEN '10-49' WHEN n < 100 THEN '50-99' WHEN n < 500 THEN '100-499' WHEN n < 1000 THEN '500-999' ELSE '1000+' END AS genomes
 FROM (SELECT species_taxid, count(*) AS n FROM assemblies WHERE species_taxid IS NOT NULL GROUP BY 1)) GROUP BY 1""")
def _(s, d):
    return pl.species_report(sh.assemblies(s, d), {r: sh.rank_map(s, d, r) for r in ("phylum", "family")})["bins"].select("genomes", "species")


@query("p9_source_mix", """SELECT CASE WHEN u = 0 THEN 'isolate_only' WHEN i = 0 THEN 'uncultured_only' ELSE 'mixed' END AS mix, count(*) AS species, sum(i + u)::BIGINT AS genomes, round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100 * 10, 0) / 10 AS species_pct
 FROM (SELECT species_taxid, count(*) FILTER (coalesce(isolate, '') <> '') AS i, count(*) FILTER (coalesce(isolate, '') = '') AS u FROM assemblies WHERE species_taxid IS NOT NULL GROUP BY 1) GROUP BY 1""")
def _(s, d):
    return pl.species_report(sh.assemblies(s, d), {r: sh.rank_map(s, d, r) for r in ("phylum", "family")})["source_mix"]


@query("p10_scatter_table", """SELECT taxon, novelty_factor, CASE WHEN p = 0 THEN 25 WHEN p < 10 THEN 20 WHEN p < 50 THEN 15 ELSE 10 END AS circle_size, novelty_factor > 1 AND row_number() OVER (ORDER BY novelty_factor DESC, taxon) <= 10 AS is_top_novelty,
 overrepresentation_factor > 1 AND row_number() OVER (ORDER BY overrepresentation_factor DESC, taxon) <= 10 AS is_top_coverage
 FROM (SELECT *, CASE WHEN ncbi_genome_count > 0 THEN isolate_count::DOUBLE / ncbi_genome_count * 100 ELSE 0 END AS p FROM merged_phylum WHERE match_status = 'matched' AND census_otu_count > 0)""")
def _(s, d):
    out = pl.figure_tables(sh.merged(s, d, "phylum"))["scatter"]
    return out.select("taxon", "novelty_factor", "circle_size", "is_top_novelty", "is_top_coverage")


@query("p10_alluvial_table", """SELECT axis, sum(c)::DOUBLE AS total, count(*) AS blocks FROM (SELECT taxon, unnest(['NCBI_Total_Genomes', 'Census_Sequences', 'Census_OTUs', 'NCBI_Total_Species']) AS axis, unnest([g, z, o, sp]) AS c FROM (
 SELECT CASE WHEN rn <= 12 THEN taxon ELSE 'Other' END AS taxon, sum(ncbi_genome_count) AS g, sum(census_size_count) AS z, sum(census_otu_count) AS o, sum(ncbi_species_count) AS sp FROM (SELECT *, row_number() OVER (ORDER BY census_size_count DESC, taxon) AS rn FROM merged_genus WHERE match_status = 'matched') GROUP BY 1)) GROUP BY axis""")
def _(s, d):
    out = pl.figure_tables(sh.merged(s, d, "genus"))["alluvial"]
    return out.groupBy("axis").agg(F.sum("absolute_count").alias("total"), F.count("*").alias("blocks"))


# --- every output of the two quality pipelines, compared with the SQL of its operator ----------------------------------
def _rounded(df, **places):
    return df.withColumns({c: round_even(c, p) for c, p in places.items()})


CENSUS_OUTPUTS = {
    "patterns": ("a14_unclassified_patterns", lambda df: df),
    "classification_rates": ("a15_classification_rates", lambda df: df),
    "unclassified_by_rank": ("a16_unclassified_by_rank", lambda df: df),
    "unclassified_lineages": ("a17_unclassified_lineages", lambda df: df.where("level = 'genus'").drop("level")),
    "distribution": ("a18_distribution", lambda df: _rounded(df.where("measure <> 'avg_size_per_cluster'"), mean=4, std=4)),
    "outliers": ("a19_iqr_outliers", lambda df: df.select("taxonomic_combination", "row_count", "lower_bound", "upper_bound")),
    "division_sizes": ("a20_division_sizes", lambda df: _rounded(df, avg_clusters_per_combination=4).drop("avg_sequences_per_combination", "avg_size_per_cluster")),
    "combinations": ("a13_combinations", lambda df: df.select("taxonomic_combination", "row_count", "total_size", "avg_size_per_cluster", "example_centroids")),
}
REPORT_OUTPUTS = {
    "bins": ("a23_genome_bins", lambda df: df),
    "coverage": ("a24_rank_coverage", lambda df: df.where("rank <> 'domain'")),
    "top_taxa": ("a24_rank_top_taxa", lambda df: df.where("rank = 'phylum'").withColumn("position", F.col("position").cast("bigint"))),
    "species": ("a21_species_profile", lambda df: _rounded(df, mean_genome_size=2, mean_gc_percent=4).select(
        "species_taxid", "representative_organism_name", "isolate_count", "uncultured_count", "total_genomes", "mean_genome_size",
        F.coalesce(F.rint(F.col("std_genome_size") / 1000), F.lit(-1.0)).alias("std_genome_size"), "min_genome_size", "max_genome_size", "mean_gc_percent",
        F.date_format("earliest_date", "yyyy-MM-dd").alias("earliest"), F.date_format("latest_date", "yyyy-MM-dd").alias("latest"))),
}


def _register_outputs():
    from checks import q_counts, q_quality, registry  # noqa: F401 - their SQL is used

    registry.ORACLES["p4_conflicts"] = registry.ORACLES["a30_hierarchy_conflicts"]

    def add(name, oracle, build, shape):
        query(name)(lambda s, d: shape(build(s, d)))
        registry.ORACLES[name] = oracle

    for output, (like, shape) in CENSUS_OUTPUTS.items():
        oracle = registry.ORACLES[like]
        if output == "distribution":
            oracle = f"SELECT * FROM ({oracle}) WHERE measure <> 'avg_size_cents'"
        add(f"p8_{output}", oracle, lambda s, d, o=output: pl.census_quality(sh.clusters(s, d))[o], shape)
    for output, (like, shape) in REPORT_OUTPUTS.items():
        add(f"p9_{output}", registry.ORACLES[like],
            lambda s, d, o=output: pl.species_report(sh.assemblies(s, d), {r: sh.rank_map(s, d, r) for r in ("phylum", "family")})[o], shape)


_register_outputs()


@query("p9_distribution", """SELECT measure, count(*) AS n, min(v) AS min, max(v) AS max, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75 FROM (
 SELECT 'total_genomes' AS measure, count(*)::DOUBLE AS v FROM assemblies WHERE species_taxid IS NOT NULL GROUP BY species_taxid) GROUP BY measure""")
def _(s, d):
    out = pl.species_report(sh.assemblies(s, d), {"phylum": sh.rank_map(s, d, "phylum")})["distribution"]
    return out.where("measure = 'total_genomes'").drop("mean", "std")


@query("p9_anomalies", """SELECT rule, count(*) AS species FROM (SELECT unnest(list_filter([CASE WHEN s.n > 1000 THEN 'many_genomes' END, CASE WHEN s.i = 0 AND s.n > 100 THEN 'uncultured_only' END,
 CASE WHEN s.g < 100000 THEN 'very_small_genome' END, CASE WHEN s.g > 50000000 THEN 'very_large_genome' END, CASE WHEN p.phylum IS NULL THEN 'missing_phylum' END, CASE WHEN p.domain IS NULL THEN 'missing_domain' END], lambda x: x IS NOT NULL)) AS rule
 FROM (SELECT species_taxid, count(*) AS n, count(*) FILTER (coalesce(isolate, '') <> '') AS i, avg(genome_size) AS g FROM assemblies WHERE species_taxid IS NOT NULL GROUP BY 1) s LEFT JOIN map_phylum p ON p.taxid = s.species_taxid) GROUP BY rule""")
def _(s, d):
    out = pl.species_report(sh.assemblies(s, d), {"phylum": sh.rank_map(s, d, "phylum")})["anomalies"]
    return out.groupBy("rule").agg(F.count("*").alias("species"))
