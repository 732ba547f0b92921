"""Counting, census and census-quality queries."""

from pyspark.sql import functions as F

from cladetally.functions.common import round_even
from cladetally.operators import census as ce, genomes as ge, keyed as ky
from cladetally.session import materialize
from checks import shapes as sh
from checks.q_names import CLEANED
from checks.registry import query


def _combos(s, d, examples=False):
    return materialize(ce.taxonomic_combinations(sh.clusters(s, d), examples=examples))


@query("a1_census_by_rank_18s", """SELECT 'division' AS rank, division AS taxon, count(centroid) AS otu_count, coalesce(sum(size), 0)::BIGINT AS size_count FROM clusters WHERE division IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'family', family, count(centroid), coalesce(sum(size), 0)::BIGINT FROM clusters WHERE family IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'genus', genus, count(centroid), coalesce(sum(size), 0)::BIGINT FROM clusters WHERE genus IS NOT NULL GROUP BY 2""")
def _(s, d):
    return ce.census_all_ranks(sh.clusters(s, d), "18s")


C16 = f"""SELECT taxon, count(*) AS otu_count, sum(coalesce(size, 1))::BIGINT AS size_count FROM (SELECT taxon, size FROM (SELECT family AS taxon, size, {CLEANED.replace('name', 'family')} AS c FROM clusters)
 WHERE NOT (contains(c, ' ') AND len(regexp_split_to_array(trim(c), '\\s+')) >= 2) AND trim(taxon) <> '') GROUP BY taxon"""


@query("a1_census_by_rank_16s", C16)
def _(s, d):
    return ce.census_by_rank(sh.clusters_16s(s, d), "family", "16s")


@query("a2_database_shares", "SELECT taxon, otu_percentage, size_percentage FROM census_family")
def _(s, d):
    return sh.census(s, d, "family").select("taxon", "otu_percentage", "size_percentage")


@query("a3_genome_counts", "SELECT phylum, domain, count(*) AS phylum_genome_count FROM assemblies GROUP BY 1, 2")
def _(s, d):
    return ge.genome_counts(sh.assemblies(s, d), "phylum")


@query("a3_gtdb_genome_counts", "SELECT regexp_replace(phylum, '_[A-Z]$', '') AS phylum, domain, count(*) AS phylum_counts FROM gtdb_ranks GROUP BY 1, 2")
def _(s, d):
    return ge.gtdb_genome_counts(ge.gtdb_ranks(sh.gtdb_taxonomy(s, d)), "phylum")


@query("a4_species_counts", "SELECT family, domain, count(DISTINCT species_taxid) AS family_species_count FROM assemblies GROUP BY 1, 2")
def _(s, d):
    return ge.species_counts(sh.assemblies(s, d), "family")


@query("a3_a4_counts_with_shares", """SELECT genus, domain, g AS genus_genome_count, sp AS genus_species_count, round_even(g::DOUBLE / sum(g) OVER () * 100 * 100, 0) / 100 AS genus_genome_percentage,
 round_even(sp::DOUBLE / sum(sp) OVER () * 100 * 100, 0) / 100 AS genus_species_percentage FROM (SELECT genus, domain, count(*) AS g, count(DISTINCT species_taxid) AS sp FROM assemblies GROUP BY 1, 2)""")
def _(s, d):
    return ge.with_shares(ge.genome_and_species_counts(sh.assemblies(s, d), "genus"), "genus")


@query("a5_species_subset_counts", """SELECT phylum, domain, count(*) AS phylum_species_count FROM (SELECT *, row_number() OVER (PARTITION BY species_taxid ORDER BY genome_source = 'uncultured', assembly_accession, phylum, domain) AS rn
 FROM assemblies WHERE species_taxid IS NOT NULL) WHERE rn = 1 AND phylum IS NOT NULL GROUP BY 1, 2""")
def _(s, d):
    return ge.subset_species_counts(sh.assemblies(s, d), "phylum")


@query("a5_gtdb_species_counts", """SELECT 'phylum' AS rank, regexp_replace(p[1], '_[A-Z]$', '') AS taxon, p[2] AS domain, count(*) AS n FROM (SELECT species, min([phylum, domain]) AS p FROM gtdb_ranks GROUP BY species) GROUP BY ALL
 UNION ALL SELECT 'family', regexp_replace(family, '_[A-Z]$', ''), domain, count(DISTINCT species) FROM gtdb_ranks WHERE family IS NOT NULL GROUP BY ALL
 UNION ALL SELECT 'genus', g, domain, sum(n)::BIGINT FROM (SELECT regexp_replace(genus, '_[A-Z]$', '') AS g, genus, domain, count(DISTINCT species) AS n FROM gtdb_ranks GROUP BY ALL) GROUP BY ALL""")
def _(s, d):
    ranks = ge.gtdb_ranks(sh.gtdb_taxonomy(s, d), None)
    out = [ge.gtdb_species_counts(ranks, r).select(F.lit(r).alias("rank"), F.col(r).alias("taxon"), "domain", F.col(f"{r}_species_count").alias("n"))
           for r in ("phylum", "family", "genus")]
    return ky.union_all(*out)


@query("a7_merge_variants", "SELECT regexp_replace(genus, '_[A-Z]$', '') AS genus, domain, sum(n)::BIGINT AS n, count(*) AS variants FROM (SELECT genus, domain, count(*) AS n FROM gtdb_ranks GROUP BY 1, 2) GROUP BY 1, 2")
def _(s, d):
    n = ge.gtdb_ranks(sh.gtdb_taxonomy(s, d)).groupBy("genus", "domain").agg(F.count("*").alias("n"))
    return ge.merge_variants(n, "genus", "n")


@query("a7_variant_members", "SELECT regexp_replace(phylum, '_[A-Z]$', '') AS phylum, domain, accession_clean, phylum AS variant FROM gtdb_ranks")
def _(s, d):
    return ge.variant_members(ge.gtdb_ranks(sh.gtdb_taxonomy(s, d)), "phylum")


@query("a13_combinations", """SELECT c.taxonomic_combination, c.row_count, c.total_size, c.avg_size_per_cluster, e.example_centroids FROM combos c JOIN (SELECT k, string_agg(centroid, '; ' ORDER BY centroid) AS example_centroids FROM (
 SELECT DISTINCT coalesce(division, 'NA') || '|' || coalesce(family, 'NA') || '|' || coalesce(genus, 'NA') AS k, centroid, dense_rank() OVER (PARTITION BY division, family, genus ORDER BY centroid) AS rn FROM clusters) WHERE rn <= 3 GROUP BY k) e ON e.k = c.taxonomic_combination""")
def _(s, d):
    return _combos(s, d, True).select("taxonomic_combination", "row_count", "total_size", "avg_size_per_cluster", "example_centroids")


PATTERN = """CASE WHEN NOT contains(taxonomic_combination, '.U.') THEN 'fully_classified' WHEN contains(division, '.U.')::INT + contains(family, '.U.')::INT + contains(genus, '.U.')::INT > 1 THEN 'multiple_unclassified'
 WHEN contains(division, '.U.') THEN 'division_unclassified' WHEN contains(family, '.U.') THEN 'family_unclassified' ELSE 'genus_unclassified' END"""


@query("a14_unclassified_patterns", f"""SELECT pattern, combinations, clusters, sequences, round_even(combinations::DOUBLE / sum(combinations) OVER () * 100 * 10, 0) / 10 AS combinations_pct,
 round_even(clusters::DOUBLE / sum(clusters) OVER () * 100 * 10, 0) / 10 AS clusters_pct, round_even(sequences::DOUBLE / sum(sequences) OVER () * 100 * 10, 0) / 10 AS sequences_pct
 FROM (SELECT {PATTERN} AS pattern, count(*) AS combinations, sum(row_count)::BIGINT AS clusters, sum(total_size)::BIGINT AS sequences FROM combos GROUP BY 1)""")
def _(s, d):
    return ce.unclassified_patterns(_combos(s, d))


@query("a15_classification_rates", f"""SELECT division, count(*) AS total_combinations, sum(ok)::BIGINT AS classified_combinations, sum(row_count)::BIGINT AS total_clusters, sum(row_count * ok)::BIGINT AS classified_clusters,
 sum(total_size)::BIGINT AS total_sequences, sum(total_size * ok)::BIGINT AS classified_sequences, round_even(sum(ok)::DOUBLE / count(*) * 100 * 10, 0) / 10 AS combination_classification_rate,
 round_even(sum(row_count * ok)::DOUBLE / sum(row_count) * 100 * 10, 0) / 10 AS cluster_classification_rate,
 CASE WHEN sum(total_size) > 0 THEN round_even(sum(total_size * ok)::DOUBLE / sum(total_size) * 100 * 10, 0) / 10 ELSE 0 END AS sequence_classification_rate
 FROM (SELECT split_part(division, '.U.', 1) AS division, row_count, total_size, ({PATTERN} = 'fully_classified')::INT AS ok FROM combos) GROUP BY division""")
def _(s, d):
    return ce.classification_rates(_combos(s, d))


@query("a16_unclassified_by_rank", """SELECT taxonomic_level, classification_status, count(*) AS entry_count, sum(size)::BIGINT AS sequence_count, round_even(count(*)::DOUBLE / (SELECT count(*) FROM clusters) * 100 * 10, 0) / 10 AS entry_percentage,
 round_even(sum(size)::DOUBLE / (SELECT sum(size) FROM clusters) * 100 * 10, 0) / 10 AS sequence_percentage FROM (
 SELECT 'division' AS taxonomic_level, CASE WHEN contains(coalesce(division, ''), '.U.') THEN 'unclassified (.U.)' ELSE 'classified' END AS classification_status, coalesce(size, 0) AS size FROM clusters
 UNION ALL SELECT 'family', CASE WHEN contains(coalesce(family, ''), '.U.') THEN 'unclassified (.U.)' ELSE 'classified' END, coalesce(size, 0) FROM clusters
 UNION ALL SELECT 'genus', CASE WHEN contains(coalesce(genus, ''), '.U.') THEN 'unclassified (.U.)' ELSE 'classified' END, coalesce(size, 0) FROM clusters) GROUP BY 1, 2""")
def _(s, d):
    return ce.unclassified_by_rank(sh.clusters(s, d))


@query("a17_unclassified_lineages", """SELECT genus AS unclassified_name, sig AS lineage_signature, count(*) AS count, sum(coalesce(size, 0))::BIGINT AS sequence_count, array_to_string(list_sort(list_distinct(list(centroid)))[1:3], '; ') AS example_centroids
 FROM (SELECT *, division || '|' || family || '|' || genus AS sig FROM clusters WHERE contains(genus, '.U.')) GROUP BY 1, 2""")
def _(s, d):
    return ce.unclassified_lineages(sh.clusters(s, d), "genus")


@query("a18_distribution", """SELECT m AS measure, count(*) AS n, round_even(avg(v) * 10000, 0) / 10000 AS mean, quantile_cont(v, 0.5) AS median, round_even(stddev_samp(v) * 10000, 0) / 10000 AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75
 FROM (SELECT 'row_count' AS m, row_count::DOUBLE AS v FROM combos UNION ALL SELECT 'total_size', total_size::DOUBLE FROM combos UNION ALL SELECT 'avg_size_cents', round(avg_size_per_cluster * 100)::DOUBLE FROM combos) GROUP BY m""")
def _(s, d):
    # the mean size in hundredths is a whole number, so its sum does not depend on the row order
    cents = F.round(F.col("avg_size_per_cluster") * 100).cast("bigint")
    out = ce.distribution_stats(_combos(s, d).withColumn("avg_size_cents", cents), ["row_count", "total_size", "avg_size_cents"])
    return out.withColumns({"mean": round_even("mean", 4), "std": round_even("std", 4)})


@query("a19_iqr_outliers", """SELECT taxonomic_combination, row_count, lo AS lower_bound, hi AS upper_bound FROM combos, (SELECT q1 - (q3 - q1) * 1.5 AS lo, q3 + (q3 - q1) * 1.5 AS hi FROM (
 SELECT quantile_cont(row_count::DOUBLE, 0.25) AS q1, quantile_cont(row_count::DOUBLE, 0.75) AS q3 FROM combos)) WHERE row_count < lo OR row_count > hi""")
def _(s, d):
    return ce.iqr_outliers(_combos(s, d), "row_count").select("taxonomic_combination", "row_count", "lower_bound", "upper_bound")


@query("a20_division_sizes", """SELECT split_part(division, '.U.', 1) AS division, count(*) AS combinations, sum(row_count)::BIGINT AS total_clusters, sum(total_size)::BIGINT AS total_sequences, round_even(avg(row_count) * 10000, 0) / 10000 AS avg_clusters_per_combination,
 median(row_count) AS median_clusters, median(total_size) AS median_sequences, median(avg_size_per_cluster) AS median_avg_size FROM combos GROUP BY 1""")
def _(s, d):
    out = ce.division_size_stats(_combos(s, d))
    return out.select("division", "combinations", "total_clusters", "total_sequences", round_even("avg_clusters_per_combination", 4).alias("avg_clusters_per_combination"),
                      "median_clusters", "median_sequences", "median_avg_size")


def _census_with_ids(s, d):
    from cladetally.operators import taxonomy as tx
    counted = ce.census_all_ranks(sh.clusters(s, d), "18s")
    return tx.name_to_taxid(counted, sh.names(s, d), "taxon")


CENSUS3 = """(SELECT 'division' AS rank, division AS taxon, count(centroid) AS otu_count, coalesce(sum(size), 0)::BIGINT AS size_count FROM clusters WHERE division IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'family', family, count(centroid), coalesce(sum(size), 0)::BIGINT FROM clusters WHERE family IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'genus', genus, count(centroid), coalesce(sum(size), 0)::BIGINT FROM clusters WHERE genus IS NOT NULL GROUP BY 2)"""


@query("a29_unmapped_names", f"""SELECT rank, taxon, otu_count, CASE WHEN x.taxid IS NULL THEN 'NO_TAXID_FOUND' ELSE 'TAXID_NO_LINEAGE' END AS reason FROM {CENSUS3} c LEFT JOIN lookup x ON x.name = c.taxon LEFT JOIN lin l ON l.taxid = x.taxid WHERE l.taxid IS NULL""")
def _(s, d):
    return ce.unmapped_names(_census_with_ids(s, d), sh.tree(s, d)).select("rank", "taxon", "otu_count", "reason")


@query("a29_mapping_rates", f"""SELECT coalesce(rank, 'all') AS rank, count(*) AS total, count(x.taxid) AS mapped, count(*) - count(x.taxid) AS unmapped, round_even((count(*) - count(x.taxid))::DOUBLE / count(*) * 100 * 10, 0) / 10 AS unmapped_pct
 FROM {CENSUS3} c LEFT JOIN lookup x ON x.name = c.taxon GROUP BY ROLLUP(rank)""")
def _(s, d):
    return ce.mapping_rates(_census_with_ids(s, d))


@query("a29_name_patterns", """SELECT pattern, count(*) AS names, count(*) AS otus, sum(p_partkey)::BIGINT AS sequences FROM (SELECT p_partkey, unnest(list_filter([CASE WHEN contains(name, 'Candidatus') THEN 'Candidatus' END,
 CASE WHEN contains(name, 'Mitochondria') OR contains(name, 'Chloroplast') OR contains(name, ':plas') THEN 'Organelles' END, CASE WHEN contains(lower(name), 'uncultured') THEN 'Uncultured' END,
 CASE WHEN contains(lower(name), 'metagenome') OR contains(lower(name), 'environmental') OR contains(lower(name), 'marine') THEN 'Environmental' END,
 CASE WHEN contains(name, '_') AND NOT contains(name, '.') THEN 'Species_level' END, CASE WHEN contains(lower(name), 'unclassified') THEN 'Unclassified' END,
 CASE WHEN contains(name, 'Group') OR contains(name, 'group') THEN 'Group_taxa' END], lambda x: x IS NOT NULL)) AS pattern FROM hard_names) GROUP BY 1""")
def _(s, d):
    rows = sh.hard_names(s, d).select(F.col("name").alias("taxon"), F.lit(1).alias("otu_count"), F.col("p_partkey").alias("size_count"))
    return ce.unmapped_pattern_counts(rows)


@query("a29_pattern_examples", """SELECT pattern, taxon, position FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY p_partkey DESC, taxon) AS position FROM (SELECT p_partkey, name AS taxon, unnest(list_filter([
 CASE WHEN contains(name, 'Mitochondria') OR contains(name, 'Chloroplast') OR contains(name, ':plas') THEN 'Organelles' END, CASE WHEN contains(lower(name), 'uncultured') THEN 'Uncultured' END,
 CASE WHEN contains(lower(name), 'metagenome') OR contains(lower(name), 'marine') THEN 'Environmental' END, CASE WHEN contains(name, '_') AND NOT contains(name, '.') THEN 'Species_level' END,
 CASE WHEN contains(name, 'Group') OR contains(name, 'group') THEN 'Group_taxa' END], lambda x: x IS NOT NULL)) AS pattern FROM hard_names)) WHERE position <= 5""")
def _(s, d):
    rows = sh.hard_names(s, d).select(F.col("name").alias("taxon"), F.col("p_partkey").alias("otu_count"))
    return ce.unmapped_pattern_examples(rows).select("pattern", "taxon", F.col("position").cast("bigint").alias("position"))


@query("a35_occurrence", """SELECT taxon, bool_or(r = 0) AS in_division, bool_or(r = 1) AS in_family, bool_or(r = 2) AS in_genus, arg_min(n, r)::BIGINT AS otu_count FROM (
 SELECT split_part(division, '.U.', 1) AS taxon, 0 AS r, count(*) AS n FROM clusters GROUP BY 1 UNION ALL SELECT family, 1, count(*) FROM clusters GROUP BY 1
 UNION ALL SELECT split_part(genus, ' ', 1), 2, count(*) FROM clusters WHERE genus IS NOT NULL GROUP BY 1) GROUP BY taxon""")
def _(s, d):
    c = sh.clusters(s, d)

    def table(e):
        return c.groupBy(F.expr(e).alias("taxon")).agg(F.count("*").alias("otu_count"), F.count("*").alias("size_count")).where("taxon is not null")
    return ce.occurrence_across_ranks({"division": table("substring_index(division, '.U.', 1)"), "family": table("family"),
                                       "genus": table("substring_index(genus, ' ', 1)")}).drop("size_count")


@query("a36_member_counts", """SELECT trim(replace(split_part(taxonomy, ';', 5), '''', '')) AS taxon, count(DISTINCT eukprot_id) AS genome_count FROM eukprot WHERE len(string_split(taxonomy, ';')) >= 5 GROUP BY 1""")
def _(s, d):
    return ce.member_counts(sh.eukprot_raw(s, d), "Taxonomy_UniEuk", "EukProt_ID", 5)


@query("a36_member_ids", """SELECT DISTINCT trim(replace(split_part(taxonomy, ';', 4), '''', '')) AS taxon, eukprot_id AS id FROM eukprot WHERE len(string_split(taxonomy, ';')) >= 4""")
def _(s, d):
    return ce.taxon_members(sh.eukprot_raw(s, d), "Taxonomy_UniEuk", "EukProt_ID", 4)


@query("a46_species_listing", """SELECT species_taxid, coalesce(s.name, '-') AS species_name, count(a.taxid) AS total_records FROM assemblies a LEFT JOIN sci s ON s.taxid = a.species_taxid WHERE species_taxid IS NOT NULL GROUP BY 1, 2""")
def _(s, d):
    return ge.species_taxid_listing(sh.assemblies(s, d), sh.sci_names(s, d)).withColumn("species_name", F.coalesce("species_name", F.lit("-")))
