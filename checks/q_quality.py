"""Data-quality queries."""

from pyspark.sql import functions as F

from cladetally.functions import classify as cl
from cladetally.functions.common import round_even
from cladetally.operators import genomes as ge, quality as qu, taxonomy as tx
from checks import shapes as sh
from checks.q_names import _domain_sql
from checks.registry import query


@query("a21_species_profile", """SELECT species_taxid, min_by(organism_name, (assembly_accession, organism_name)) AS representative_organism_name, count(*) FILTER (coalesce(isolate, '') <> '') AS isolate_count,
 count(*) FILTER (coalesce(isolate, '') = '') AS uncultured_count, count(*) AS total_genomes, round_even(avg(genome_size) * 100, 0) / 100 AS mean_genome_size,
 coalesce(round_even(stddev_samp(genome_size)), -1) AS std_genome_size, min(genome_size) AS min_genome_size, max(genome_size) AS max_genome_size, round_even(avg(gc_percent) * 10000, 0) / 10000 AS mean_gc_percent,
 strftime(min(seq_rel_date), '%Y-%m-%d') AS earliest, strftime(max(seq_rel_date), '%Y-%m-%d') AS latest FROM assemblies WHERE species_taxid IS NOT NULL GROUP BY species_taxid""".replace("round_even(stddev_samp(genome_size))", "round_even(stddev_samp(genome_size) / 1000, 0)"))
def _(s, d):
    p = ge.species_profile(sh.assemblies(s, d))
    return p.select("species_taxid", "representative_organism_name", "isolate_count", "uncultured_count", "total_genomes",
                    round_even("mean_genome_size", 2).alias("mean_genome_size"), F.coalesce(F.rint(F.col("std_genome_size") / 1000), F.lit(-1.0)).alias("std_genome_size"),
                    "min_genome_size", "max_genome_size", round_even("mean_gc_percent", 4).alias("mean_gc_percent"),
                    F.date_format("earliest_date", "yyyy-MM-dd").alias("earliest"), F.date_format("latest_date", "yyyy-MM-dd").alias("latest"))


RAW = "(SELECT CASE WHEN l_linenumber = 6 THEN NULL ELSE 1000 + l_partkey END AS taxid, CASE WHEN l_linenumber > 4 THEN NULL WHEN l_linenumber = 4 THEN 0 ELSE 1000 + l_partkey END AS species_taxid, l_returnflag AS flag, p_name AS organism_name FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _raw(s, d):
    return sh.t(s, d, "lineitem").join(sh.t(s, d, "part"), F.expr("l_partkey = p_partkey")).selectExpr(
        "case when l_linenumber = 6 then null else 1000 + l_partkey end taxid",
        "case when l_linenumber > 4 then null when l_linenumber = 4 then 0 else 1000 + l_partkey end species_taxid",
        "l_returnflag flag", "p_name organism_name")


def _assign_sql(key):
    return f"""SELECT {key}count(*) AS total_assemblies, count(*) FILTER (species_taxid > 0 AND taxid IS NOT NULL) AS species_assigned, count(*) FILTER (taxid IS NOT NULL AND NOT coalesce(species_taxid > 0, false)) AS taxid_only,
 count(*) FILTER (taxid IS NULL) AS no_taxid, count(DISTINCT CASE WHEN taxid IS NOT NULL AND species_taxid > 0 THEN species_taxid END) AS unique_species,
 round_even(count(*) FILTER (taxid IS NULL)::DOUBLE / count(*) * 100 * 1000, 0) / 1000 AS no_taxid_pct FROM {RAW}"""


def _assign(df, by=None):
    out = qu.assignment_summary(df, by)
    keys = [by[0]] if by else []
    return out.select(*keys, "total_assemblies", "species_assigned", "taxid_only", "no_taxid", "unique_species", round_even("no_taxid_pct", 3).alias("no_taxid_pct"))


@query("a22_assignment_overall", _assign_sql(""))
def _(s, d):
    return _assign(_raw(s, d))


@query("a22_assignment_by_level", _assign_sql("flag, ") + " GROUP BY flag")
def _(s, d):
    return _assign(_raw(s, d), ("flag", F.col("flag")))


@query("a22_assignment_by_domain", f"SELECT domain, count(*) AS total_assemblies, sum(quality)::BIGINT AS species_assigned FROM (SELECT {_domain_sql('lower(text)')} AS domain, quality FROM documents JOIN labels USING (doc_id)) GROUP BY domain")
def _(s, d):
    rows = sh.t(s, d, "documents").join(sh.t(s, d, "labels"), "doc_id").selectExpr(
        "doc_id taxid", "case when quality = 1 then doc_id + 1 end species_taxid", "text organism_name")
    out = qu.assignment_summary(rows, ("domain", cl.inferred_domain("organism_name")))
    return out.select("domain", "total_assemblies", "species_assigned")


@query("a22_problem_organisms", f"""SELECT status, organism_name, n FROM (SELECT status, organism_name, count(*) AS n, row_number() OVER (PARTITION BY status ORDER BY count(*) DESC, organism_name) AS rn FROM (
 SELECT CASE WHEN taxid IS NULL THEN 'no_taxid' ELSE 'taxid_only' END AS status, organism_name FROM {RAW} WHERE taxid IS NULL OR NOT coalesce(species_taxid > 0, false)) GROUP BY 1, 2) WHERE rn <= 10""")
def _(s, d):
    return qu.top_problem_organisms(_raw(s, d)).select("status", "organism_name", "n")


PROFILE = "(SELECT species_taxid, count(*) AS total_genomes, count(*) FILTER (coalesce(isolate, '') <> '') AS isolate_count, avg(genome_size) AS mean_genome_size FROM assemblies WHERE species_taxid IS NOT NULL GROUP BY 1)"


@query("a23_genome_bins", f"""SELECT genomes, count(*) AS species, round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100 * 10, 0) / 10 AS species_pct FROM (SELECT CASE WHEN total_genomes < 2 THEN '1' WHEN total_genomes < 5 THEN '2-4' WHEN total_genomes < 10 THEN '5-9'
 WHEN total_genomes < 50 THEN '10-49' WHEN total_genomes < 100 THEN '50-99' WHEN total_genomes < 500 THEN '100-499' WHEN total_genomes < 1000 THEN '500-999' ELSE '1000+' END AS genomes FROM {PROFILE}) GROUP BY genomes""")
def _(s, d):
    return qu.genomes_per_species_bins(ge.species_profile(sh.assemblies(s, d)))


STATS = f"(SELECT s.*, p.phylum, f.family FROM {PROFILE} s LEFT JOIN map_phylum p ON p.taxid = s.species_taxid LEFT JOIN map_family f ON f.taxid = s.species_taxid)"


def _stats(s, d):
    return ge.attach_rank_maps(ge.species_profile(sh.assemblies(s, d)), {r: sh.rank_map(s, d, r) for r in ("phylum", "family")})


@query("a24_rank_coverage", f"""SELECT 'phylum' AS rank, count(*) AS species, count(phylum) AS named_species, count(DISTINCT phylum) AS distinct_taxa, round_even(count(phylum)::DOUBLE / count(*) * 100 * 10, 0) / 10 AS coverage_pct FROM {STATS}
 UNION ALL SELECT 'family', count(*), count(family), count(DISTINCT family), round_even(count(family)::DOUBLE / count(*) * 100 * 10, 0) / 10 FROM {STATS}""")
def _(s, d):
    return qu.rank_coverage(_stats(s, d), ["phylum", "family"])


@query("a24_rank_top_taxa", f"""SELECT 'phylum' AS rank, phylum AS taxon, n AS total_genomes, position FROM (SELECT phylum, sum(total_genomes)::BIGINT AS n, row_number() OVER (ORDER BY sum(total_genomes) DESC, phylum) AS position FROM {STATS} WHERE phylum IS NOT NULL GROUP BY phylum) WHERE position <= 10""")
def _(s, d):
    return qu.rank_top_taxa(_stats(s, d), ["phylum"]).withColumn("position", F.col("position").cast("bigint"))


@query("a25_anomalies", f"""SELECT rule, count(*) AS species FROM (SELECT unnest(list_filter([CASE WHEN total_genomes > 1000 THEN 'many_genomes' END, CASE WHEN isolate_count = 0 AND total_genomes > 100 THEN 'uncultured_only' END,
 CASE WHEN mean_genome_size < 100000 THEN 'very_small_genome' END, CASE WHEN mean_genome_size > 50000000 THEN 'very_large_genome' END, CASE WHEN phylum IS NULL THEN 'missing_phylum' END], lambda x: x IS NOT NULL)) AS rule FROM {STATS}) GROUP BY rule""")
def _(s, d):
    return qu.species_anomalies(_stats(s, d), ["phylum"]).groupBy("rule").agg(F.count("*").alias("species"))


@query("a26_accession_profile", """SELECT coalesce(domain, 'all') AS domain, coalesce(phylum, 'all') AS phylum, count(*) AS entries, count(*) FILTER (genome_source = 'isolate') AS isolates, count(*) FILTER (genome_source = 'uncultured') AS uncultured,
 CASE grouping_id(domain, phylum) WHEN 0 THEN 'taxon' WHEN 1 THEN 'domain' ELSE 'all' END AS level FROM assemblies GROUP BY ROLLUP (domain, phylum)""")
def _(s, d):
    out = qu.accession_profile(sh.assemblies(s, d), "phylum")
    return out.select(F.coalesce("domain", F.lit("all")).alias("domain"), F.coalesce("phylum", F.lit("all")).alias("phylum"), "entries", "isolates", "uncultured", "level")


@query("a26_accession_summary", """SELECT (SELECT count(*) FROM assemblies) AS total_entries, count(*) AS unique_taxa, max(n) AS largest, min(n) AS smallest, round_even(avg(n) * 1000, 0) / 1000 AS mean_entries, (SELECT count(DISTINCT organism_name) FROM assemblies) AS unique_organisms FROM (SELECT genus, count(*) AS n FROM assemblies GROUP BY 1)""")
def _(s, d):
    out = qu.accession_summary(sh.assemblies(s, d), "genus")
    return out.select("total_entries", "unique_taxa", "largest", "smallest", round_even("mean_entries", 3).alias("mean_entries"), "unique_organisms")


@query("a26_taxa_of_domain", "SELECT p_brand AS taxon_name, min(p_partkey) AS taxid FROM part WHERE p_type = 'SMALL' GROUP BY 1")
def _(s, d):
    rows = sh.t(s, d, "part").selectExpr("p_brand phylum", "case when p_type = 'SMALL' then ' Viruses' else 'Bacteria' end domain",
                                         "case when p_size % 2 = 0 then concat('[', p_partkey, ', 5]') else cast(p_partkey as string) end taxid")
    return qu.taxa_of_domain(rows, "phylum")


STATE = "CASE WHEN isolate IS NULL THEN 'null' WHEN isolate = '' THEN 'empty' WHEN lower(trim(isolate)) = 'missing' THEN 'placeholder' ELSE 'filled' END"


@query("a27_isolate_quality", f"SELECT {STATE} AS isolate_state, assembly_level, count(*) AS entries, round_even(avg(genome_size) * 100, 0) / 100 AS mean_genome_size FROM assemblies GROUP BY 1, 2")
def _(s, d):
    return qu.isolate_field_quality(sh.assemblies(s, d)).withColumn("mean_genome_size", round_even("mean_genome_size", 2))


@query("a27_common_isolates", f"SELECT isolate, count(*) AS entries FROM assemblies WHERE {STATE} = 'filled' GROUP BY isolate ORDER BY entries DESC, isolate LIMIT 100")
def _(s, d):
    return qu.common_isolate_values(sh.assemblies(s, d))


def _has(*words):
    return " AND ".join(f"contains(lower(lineage), '{w}')" for w in words)


CATEGORY = f"""CASE WHEN {_has('virus')} THEN 'viruses' {{meta}} WHEN {_has('bacteria', 'unclassified')} THEN 'unclassified_bacteria' WHEN {_has('eukaryota', 'unclassified')} THEN 'unclassified_eukaryota'
 WHEN {_has('archaea', 'unclassified')} THEN 'unclassified_archaea' WHEN {_has('environmental samples')} THEN 'environmental_samples' {{inc}} ELSE 'interesting_cases' END"""
PH = CATEGORY.format(meta="", inc="")
FA = CATEGORY.format(meta=f"WHEN {_has('metagenome')} THEN 'metagenomes'", inc=f"WHEN {_has('incertae sedis')} OR contains(reason, 'incertae sedis') THEN 'incertae_sedis'")


@query("a28_categories_phylum", f"""SELECT category, CASE WHEN category <> 'interesting_cases' THEN '-' WHEN {_has('eukaryota', 'sar')} THEN 'SAR group eukaryotes' WHEN {_has('eukaryota', 'opisthokonta')} THEN 'Opisthokonta group'
 WHEN {_has('bacteria', 'proteobacteria')} THEN 'Proteobacteria subgroups' WHEN {_has('incertae sedis')} THEN 'Incertae sedis (uncertain placement)' ELSE 'Other complex cases' END AS pattern, count(*) AS entries, count(*) FILTER (contains(ranks, 'clade')) AS clade_instead_of_phylum
 FROM (SELECT *, {PH} AS category FROM unmapped) GROUP BY 1, 2""")
def _(s, d):
    return qu.unmapped_categories(sh.unmapped(s, d), "phylum")


@query("a28_categories_family", f"""SELECT category, CASE WHEN category <> 'interesting_cases' THEN '-' WHEN {_has('proteobacteria')} THEN 'Proteobacteria subgroups' WHEN {_has('bacillota')} THEN 'Firmicutes/Bacillota groups' WHEN {_has('actinobacteria')} THEN 'Actinobacteria groups'
 WHEN {_has('eukaryota', 'fungi')} THEN 'Fungal groups' WHEN {_has('eukaryota', 'metazoa')} THEN 'Animal groups' WHEN {_has('eukaryota', 'stramenopiles')} THEN 'Stramenopile groups' WHEN {_has('eukaryota')} THEN 'Other eukaryotic groups' WHEN {_has('archaea')} THEN 'Archaeal groups' ELSE 'Other complex cases' END AS pattern,
 count(*) AS entries FROM (SELECT *, {FA} AS category FROM unmapped) GROUP BY 1, 2""")
def _(s, d):
    return qu.unmapped_categories(sh.unmapped(s, d), "family").drop("clade_instead_of_phylum")


@query("a28_reason_patterns", "SELECT CASE p_partkey % 4 WHEN 0 THEN 'Missing family rank' WHEN 1 THEN 'Multiple family matches' WHEN 2 THEN 'Family not in lineage' ELSE '-' END AS pattern, count(*) AS n FROM part GROUP BY 1")
def _(s, d):
    return sh.unmapped(s, d).groupBy(F.coalesce(cl.unmapped_reason_pattern("reason"), F.lit("-")).alias("pattern")).agg(F.count("*").alias("n"))


def _link(low, high):
    return f"SELECT DISTINCT '{low}' AS lower_rank, \"{low}\" AS lower_value, '{high}' AS higher_rank, \"{high}\" AS higher_value FROM gtdb_ranks WHERE \"{low}\" IS NOT NULL AND \"{high}\" IS NOT NULL"


LINKS = " UNION ALL ".join(_link(a, b) for a, b in [("genus", "family"), ("family", "order"), ("order", "class"), ("class", "phylum"), ("phylum", "domain")])


@query("a30_hierarchy_conflicts", f"SELECT * FROM ({LINKS}) QUALIFY count(*) OVER (PARTITION BY lower_rank, lower_value) > 1")
def _(s, d):
    return qu.hierarchy_conflicts(ge.gtdb_ranks(sh.gtdb_taxonomy(s, d), None)).drop("parents")


@query("a31_map_integrity", """SELECT problem, count(*) AS n FROM (SELECT 'bad_accession' AS problem FROM acc_b UNION ALL SELECT 'taxid_not_in_nodes' FROM m WHERE taxid NOT IN (SELECT taxid FROM nodes)
 UNION ALL SELECT 'taxid_not_in_names' FROM m WHERE taxid NOT IN (SELECT taxid FROM names_all) UNION ALL SELECT 'accession_not_in_metadata' FROM m WHERE accession_clean NOT IN (SELECT accession_clean FROM acc_a)) GROUP BY 1""".replace(" FROM m WHERE", " FROM (SELECT accession_clean, 1000 + accession_clean::BIGINT AS taxid FROM acc_b) WHERE"))
def _(s, d):
    m = sh.acc_b(s, d).selectExpr("accession_clean", "1000 + cast(accession_clean as bigint) taxid")
    return qu.map_integrity(m, sh.nodes(s, d), sh.names_all(s, d), sh.acc_a(s, d)).groupBy("problem").agg(F.count("*").alias("n"))


@query("a32_completeness", """SELECT source, rank, total_records, missing, round_even(missing::DOUBLE / total_records * 100 * 1000, 0) / 1000 AS missing_pct, CASE WHEN missing::DOUBLE / total_records * 100 < 1 THEN 'EXCELLENT' WHEN missing::DOUBLE / total_records * 100 < 5 THEN 'GOOD' WHEN missing::DOUBLE / total_records * 100 < 10 THEN 'FAIR' ELSE 'POOR' END AS status FROM (
 SELECT 'gtdb' AS source, 'family' AS rank, count(*) AS total_records, count(*) FILTER (family IS NULL) AS missing FROM gtdb_ranks UNION ALL SELECT 'gtdb', 'genus', count(*), count(*) FILTER (genus IS NULL) FROM gtdb_ranks
 UNION ALL SELECT 'census', 'family', count(*), count(*) FILTER (family IS NULL) FROM clusters UNION ALL SELECT 'census', 'genus', count(*), count(*) FILTER (genus IS NULL) FROM clusters)""")
def _(s, d):
    out = qu.completeness({"gtdb": ge.gtdb_ranks(sh.gtdb_taxonomy(s, d), None), "census": sh.clusters(s, d)}, ["family", "genus"])
    return out.select("source", "rank", "total_records", "missing", round_even("missing_pct", 3).alias("missing_pct"), "status")


AGREE = """(SELECT coalesce(a.k, b.k) AS k, a.x AS ax, b.x AS bx FROM (SELECT accession_clean AS k, min(lower(taxon)) AS x FROM acc_a GROUP BY 1) a FULL JOIN (SELECT accession_clean AS k, min(lower(taxon)) AS x FROM acc_b GROUP BY 1) b ON a.k = b.k)"""


def _agree(s, d):
    return qu.catalogue_agreement(sh.acc_a(s, d).withColumn("taxon", F.lower("taxon")), sh.acc_b(s, d).withColumn("taxon", F.lower("taxon")))


@query("a33_catalogue_agreement", f"""SELECT count(ax) AS a_accessions, count(bx) AS b_accessions, count(*) FILTER (ax IS NOT NULL AND bx IS NOT NULL) AS common, count(*) FILTER (ax = bx) AS agree, count(*) FILTER (ax <> bx) AS disagree,
 round_even(count(*) FILTER (ax = bx)::DOUBLE / (count(*) FILTER (ax = bx) + count(*) FILTER (ax <> bx)) * 100 * 1000, 0) / 1000 AS agreement_pct FROM {AGREE}""")
def _(s, d):
    return _agree(s, d)[0].select("a_accessions", "b_accessions", "common", "agree", "disagree", round_even("agreement_pct", 3).alias("agreement_pct"))


@query("a33_disagreements", f"SELECT k AS accession_clean, ax AS a_taxon, bx AS b_taxon FROM {AGREE} WHERE ax <> bx")
def _(s, d):
    return _agree(s, d)[1]


@query("a34_share_recheck", """SELECT taxon, abs(genome_pct_db - e1) < 0.01 AS ok_genome_pct_db, abs(species_pct - e2) < 0.01 AS ok_species_pct, abs(isolate_percentage - e3) < 0.01 AS ok_isolate_percentage FROM (
 SELECT *, ncbi_genome_count::DOUBLE / (SELECT sum(genomes) FROM cat_genus) * 100 AS e1, ncbi_species_count::DOUBLE / (SELECT sum(species) FROM cat_genus) * 100 AS e2, CASE WHEN ncbi_genome_count > 0 THEN isolate_count::DOUBLE / ncbi_genome_count * 100 ELSE 0 END AS e3 FROM merged_genus)""")
def _(s, d):
    out = qu.recheck_shares(sh.merged(s, d), sh.catalogue(s, d, "genus"))
    return out.select("taxon", "ok_genome_pct_db", "ok_species_pct", "ok_isolate_percentage")


@query("a47_mapping_changes", """SELECT taxid, 'gained' AS change FROM (SELECT taxid FROM map_phylum WHERE domain <> 'SMALL' EXCEPT SELECT taxid FROM map_phylum WHERE domain <> 'ECONOMY')
 UNION ALL SELECT taxid, 'lost' FROM (SELECT taxid FROM map_phylum WHERE domain <> 'ECONOMY' EXCEPT SELECT taxid FROM map_phylum WHERE domain <> 'SMALL')""")
def _(s, d):
    m = sh.rank_map(s, d, "phylum")
    return tx.mapping_changes(m.where("domain <> 'SMALL'"), m.where("domain <> 'ECONOMY'"))


@query("a48_mapping_discrepancies", """SELECT m.taxid, 'Fam' || (m.taxid % 25) || 'x1' AS expected, l.family AS found FROM map_family m JOIN lin l USING (taxid) WHERE l.family IS NOT NULL AND l.family <> 'Fam' || (m.taxid % 25) || 'x1'""")
def _(s, d):
    m = sh.rank_map(s, d, "family").selectExpr("taxid", "concat('Fam', taxid % 25, 'x1') family")
    return qu.mapping_discrepancies(m, sh.tree(s, d), "family")


@query("a48_mapping_hit_rate", """SELECT count(*) AS total_records, count(m.taxid) AS mapped_records, count(DISTINCT CASE WHEN m.taxid IS NULL THEN a.taxid END) AS unmapped_taxids, round_even(count(m.taxid)::DOUBLE / count(*) * 100 * 1000, 0) / 1000 AS mapped_pct
 FROM assemblies a LEFT JOIN map_genus m USING (taxid)""".replace("LEFT JOIN map_genus m USING (taxid)", "LEFT JOIN map_genus m ON m.taxid = a.taxid"))
def _(s, d):
    return qu.mapping_hit_rate(sh.assemblies(s, d), sh.rank_map(s, d, "genus"), "genus").withColumn("mapped_pct", round_even("mapped_pct", 3))
