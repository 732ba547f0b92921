"""Figure-table queries."""

from pyspark.sql import functions as F

from cladetally.functions import measures as ms
from cladetally.functions.common import round_even
from cladetally.operators import figures as fg, genomes as ge, keyed as ky
from checks import shapes as sh
from checks.q_matching import J5, J16, _family_genera, _novel_combos, _outer
from checks.registry import query


@query("a37_presence_overlap", """SELECT count(*) FILTER (a > 0 AND b <= 0) AS only_ncbi, count(*) FILTER (a > 0 AND b > 0) AS both, count(*) FILTER (b > 0 AND a <= 0) AS only_eukprot, sum(a)::BIGINT AS ncbi_genomes, sum(b)::BIGINT AS eukprot_genomes
 FROM (SELECT taxon, sum(a) AS a, sum(b) AS b FROM (SELECT taxon, ncbi_genome_count AS a, census_otu_count AS b FROM merged_genus) GROUP BY taxon)""")
def _(s, d):
    return fg.presence_overlap(sh.merged(s, d), "ncbi_genome_count", "census_otu_count")


FAMILY_PAIRS = """(SELECT c_mktsegment AS family_gtdb, CASE WHEN o_orderpriority LIKE '1%' THEN c_mktsegment ELSE n_name END AS family_ncbi, 1::BIGINT AS g, (o_orderkey % 3)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _pairs(s, d):
    return sh.t(s, d, "orders").join(sh.t(s, d, "customer"), F.expr("o_custkey = c_custkey")).join(
        sh.t(s, d, "nation"), F.expr("c_nationkey = n_nationkey")).selectExpr(
        "c_mktsegment family_gtdb", "case when o_orderpriority like '1%' then c_mktsegment else n_name end family_ncbi",
        "1L gtdb_genome_count", "o_orderkey % 3 ncbi_genome_count")


@query("a38_reclassification_matrix", f"""SELECT family_gtdb, family_ncbi, genomes, round_even(genomes::DOUBLE / sum(genomes) OVER (PARTITION BY family_gtdb) * 1000000, 0) / 1000000 AS share FROM (
 SELECT family_gtdb, family_ncbi, sum(g)::BIGINT AS genomes FROM {FAMILY_PAIRS} p WHERE family_gtdb IN (SELECT family_gtdb FROM {FAMILY_PAIRS} GROUP BY 1 ORDER BY sum(g) DESC, family_gtdb LIMIT 10)
 AND family_ncbi IN (SELECT family_ncbi FROM {FAMILY_PAIRS} GROUP BY 1 ORDER BY sum(n) DESC, family_ncbi LIMIT 10) GROUP BY 1, 2)""")
def _(s, d):
    return fg.reclassification_matrix(_pairs(s, d)).withColumn("share", round_even("share", 6))


@query("a38_matrix_pivot", f"""SELECT family_gtdb, round_even(coalesce(max(share) FILTER (family_ncbi = 'BUILDING'), 0) * 1000000, 0) / 1000000 AS "BUILDING", round_even(coalesce(max(share) FILTER (family_ncbi = 'MACHINERY'), 0) * 1000000, 0) / 1000000 AS "MACHINERY" FROM (
 SELECT family_gtdb, family_ncbi, n::DOUBLE / sum(n) OVER (PARTITION BY family_gtdb) AS share FROM (SELECT family_gtdb, family_ncbi, sum(g) AS n FROM {FAMILY_PAIRS} p WHERE family_gtdb IN (SELECT family_gtdb FROM {FAMILY_PAIRS} GROUP BY 1 ORDER BY sum(g) DESC, family_gtdb LIMIT 10)
 AND family_ncbi IN (SELECT family_ncbi FROM {FAMILY_PAIRS} GROUP BY 1 ORDER BY sum(n) DESC, family_ncbi LIMIT 10) GROUP BY 1, 2)) GROUP BY 1""")
def _(s, d):
    wide = fg.matrix_pivot(fg.reclassification_matrix(_pairs(s, d)), ["BUILDING", "MACHINERY"])
    return wide.select("family_gtdb", *[round_even(c, 6).alias(c) for c in ("BUILDING", "MACHINERY")])


@query("a38_mismatch_percent", f"""SELECT sum(g)::BIGINT AS total_genomes, (sum(g) FILTER (family_gtdb <> family_ncbi))::BIGINT AS mismatched_genomes, round_even((sum(g) FILTER (family_gtdb <> family_ncbi))::DOUBLE / sum(g) * 100 * 1000, 0) / 1000 AS mismatch_pct FROM {FAMILY_PAIRS}""")
def _(s, d):
    return fg.mismatch_percent(_pairs(s, d)).withColumn("mismatch_pct", round_even("mismatch_pct", 3))


@query("a39_fold_change", """SELECT taxon, a_count, b_count, round_even(log2((b_count + 1)::DOUBLE / (a_count + 1)) * 1000000, 0) / 1000000 AS fold_change FROM (SELECT coalesce(a.taxon, b.taxon) AS taxon, coalesce(a.n, 0)::BIGINT AS a_count, coalesce(b.n, 0)::BIGINT AS b_count
 FROM (SELECT taxon, sum(genomes) AS n FROM counts_a GROUP BY 1) a FULL JOIN (SELECT taxon, sum(genomes) AS n FROM counts_b GROUP BY 1) b ON a.taxon = b.taxon)""")
def _(s, d):
    return fg.catalogue_fold_change(sh.counts_a(s, d), sh.counts_b(s, d)).withColumn("fold_change", round_even("fold_change", 6))


@query("a40_correlation", """SELECT count(*) AS total_taxa, round_even(sum(round(cov * 100)::BIGINT)::DOUBLE / 100 / count(*) * 10000, 0) / 10000 AS avg_coverage, round_even(avg(CASE WHEN ncbi_species_count > 0 THEN census_otu_count::DOUBLE / ncbi_species_count ELSE 1 END) * 10000, 0) / 10000 AS avg_novelty,
 round_even(corr(census_otu_count, ncbi_species_count) * 1000000, 0) / 1000000 AS correlation FROM (SELECT *, CASE WHEN census_otu_count > 0 THEN round_even(ncbi_species_count::DOUBLE / census_otu_count * 100 * 100, 0) / 100 ELSE 0 END AS cov FROM merged_genus)""")
def _(s, d):
    m = sh.merged(s, d).withColumn("coverage", ms.coverage_percentage("ncbi_species_count", "census_otu_count"))
    out = fg.correlation_summary(m, "census_otu_count", "ncbi_species_count", "coverage")
    return out.select("total_taxa", round_even("avg_coverage", 4).alias("avg_coverage"), round_even("avg_novelty", 4).alias("avg_novelty"), round_even("correlation", 6).alias("correlation"))


@query("a41_genome_isolate_ratio", """SELECT taxon, CASE WHEN isolate_count > 0 THEN ncbi_genome_count::DOUBLE / isolate_count ELSE (SELECT max(ncbi_genome_count) FROM merged_genus)::DOUBLE END AS genome_isolate_ratio FROM merged_genus""")
def _(s, d):
    return fg.genome_isolate_ratio(sh.merged(s, d), "ncbi_genome_count", "isolate_count").select("taxon", "genome_isolate_ratio")


@query("a42_genus_contribution", f"""SELECT genus, string_agg(listed_family, '; ' ORDER BY listed_family) AS associated_families, count(*) AS number_of_families, round_even(sum(round(novelty_factor * 1000)::BIGINT)::DOUBLE / 1000 / count(*) * 1000, 0) / 1000 AS average_family_novelty_factor, max(size)::BIGINT AS genus_census_size_count
 FROM (SELECT listed_family, genus, max(novelty_factor) AS novelty_factor, sum(size) AS size FROM ({J16}) jj, (SELECT 1 FROM clusters LIMIT 1) c1, (SELECT 1 FROM merged_family LIMIT 1) m1 GROUP BY 1, 2) GROUP BY genus""")
def _(s, d):
    out = fg.genus_contribution(_family_genera(s, d).withColumn("size", F.coalesce("size", F.lit(0))))
    return out.select("genus", "associated_families", "number_of_families", "average_family_novelty_factor", "genus_census_size_count")


@query("a42_overrepresented_genera", """SELECT x.genus, x.associated_families, x.number_of_families, x.average_factor, x.census_otu_count, coalesce(m.ncbi_species_count, 0) AS db_species_count FROM (SELECT c.taxon AS genus, string_agg(f.family, '; ' ORDER BY f.family) AS associated_families, count(*) AS number_of_families,
 round_even(sum(round(f.factor * 1000)::BIGINT)::DOUBLE / 1000 / count(*) * 1000, 0) / 1000 AS average_factor, max(c.otu_count) AS census_otu_count FROM census_genus c JOIN (SELECT taxon AS family, overrepresentation_factor AS factor FROM merged_family WHERE match_status = 'matched' ORDER BY overrepresentation_factor DESC, taxon LIMIT 6) f
 ON contains(lower('root;' || c.taxon), lower(f.family)) GROUP BY 1) x LEFT JOIN (SELECT taxon, max(ncbi_species_count) AS ncbi_species_count FROM merged_genus GROUP BY 1) m ON m.taxon = x.genus""")
def _(s, d):
    census = sh.census(s, d, "genus").select(F.col("taxon").alias("genus"), "otu_count", F.concat(F.lit("root;"), "taxon").alias("lineage"))
    top = ky.top_k(sh.merged(s, d, "family").where("match_status = 'matched'"), "overrepresentation_factor", 6, ["taxon"]).select(
        F.col("taxon").alias("family"), F.col("overrepresentation_factor").alias("factor"))
    out = fg.overrepresented_genera(census, sh.merged(s, d), top, 6)
    return out.select("genus", "associated_families", "number_of_families", "average_factor", "census_otu_count", "db_species_count")


@query("a43_novelty_by_genus", """SELECT c.genus, t.novelty_factor, count(*) AS num_combinations, sum(row_count)::BIGINT AS total_clusters, round_even(sum(round(avg_size_per_cluster * 100)::BIGINT)::DOUBLE / 100 / count(*) * 100, 0) / 100 AS avg_cluster_size
 FROM combos c JOIN (SELECT taxon AS genus, novelty_factor FROM merged_genus WHERE match_status = 'matched' ORDER BY novelty_factor DESC, taxon LIMIT 15) t USING (genus) GROUP BY ALL""")
def _(s, d):
    return fg.novelty_by_genus(_novel_combos(s, d)).select("genus", "novelty_factor", "num_combinations", "total_clusters", "avg_cluster_size")


@query("a43_novelty_by_family", """SELECT family, count(genus) AS genera, round_even(sum(round(novelty_factor * 1000)::BIGINT)::DOUBLE / 1000 / count(*) * 10, 0) / 10 AS mean_novelty, sum(census_otu_count)::BIGINT AS census_otu_count FROM (SELECT c.family, c.genus, t.novelty_factor, t.census_otu_count
 FROM combos c JOIN (SELECT taxon AS genus, novelty_factor, census_otu_count FROM merged_genus WHERE match_status = 'matched' ORDER BY novelty_factor DESC, taxon LIMIT 15) t USING (genus)) GROUP BY 1""")
def _(s, d):
    return fg.novelty_by_family(_novel_combos(s, d).select("family", "genus", "novelty_factor", "census_otu_count"))


J5P = J5.replace("coalesce(k.taxon, c.taxon) AS taxon_name", "coalesce('Candidatus ' || k.taxon, c.taxon || '_A') AS taxon_name")


@query("a44_representation_bias", f"""SELECT taxon_name, (ncbi_species_count > 0)::INT AS in_ncbi, (census_otu_count > 0)::INT AS in_census, (ncbi_species_count > 0 AND census_otu_count > 0)::INT AS in_both,
 CASE WHEN ncbi_species_count > 0 AND census_otu_count > 0 THEN round_even(log2(ncbi_species_count::DOUBLE / census_otu_count) * 1000000, 0) / 1000000 ELSE -99 END AS bias FROM ({J5P}) x, (SELECT 1 FROM cat_genus LIMIT 1) k1, (SELECT 1 FROM census_genus LIMIT 1) c1""")
def _(s, d):
    out = fg.representation_flags(_outer(s, d), "ncbi_species_count", "census_otu_count")
    return out.select("taxon_name", "in_ncbi", "in_census", "in_both", F.coalesce(round_even("representation_bias", 6), F.lit(-99.0)).alias("bias"))


@query("a45_duplicate_roll_up", f"""SELECT taxon_name, sum(ncbi_genome_count)::BIGINT AS ncbi_genome_count, max(census_otu_count) AS census_otu_count, avg(ncbi_species_count) AS ncbi_species_count FROM ({J5P}) x, (SELECT 1 FROM cat_genus LIMIT 1) k1, (SELECT 1 FROM census_genus LIMIT 1) c1 GROUP BY 1""")
def _(s, d):
    return fg.roll_up_names(_outer(s, d), "taxon_name", ["ncbi_genome_count"], ["census_otu_count"], ["ncbi_species_count"])


@query("a49_weighted_factors", """SELECT taxon, round_even(novelty_factor * log10(ncbi_species_count + 1) * 1000000, 0) / 1000000 AS weighted_novelty, round_even(overrepresentation_factor * log10(census_otu_count + 1) * 1000000, 0) / 1000000 AS weighted_coverage FROM merged_genus WHERE match_status = 'matched'""")
def _(s, d):
    m = sh.merged(s, d).where("match_status = 'matched'")
    return m.select("taxon", round_even(ms.weighted_novelty("novelty_factor", "ncbi_species_count"), 6).alias("weighted_novelty"),
                    round_even(ms.weighted_coverage("overrepresentation_factor", "census_otu_count"), 6).alias("weighted_coverage"))


@query("a50_isolate_database_share", """SELECT m.taxon AS taxon_name, coalesce(g.n, 0) AS total_genome_count, coalesce(g.i, 0) AS isolate_count, round_even(coalesce(g.i, 0)::DOUBLE / (SELECT count(*) FROM assemblies)::DOUBLE * 100 * 100, 0) / 100 AS isolate_genome_percentage,
 coalesce(b.i, 0) AS isolate_species_count FROM merged_genus m LEFT JOIN (SELECT genus AS taxon, count(*) AS n, count(*) FILTER (genome_source = 'isolate') AS i FROM assemblies GROUP BY 1) g USING (taxon)
 LEFT JOIN (SELECT genus AS taxon, count(*) FILTER (genome_source = 'isolate') AS i FROM (SELECT *, row_number() OVER (PARTITION BY species_taxid ORDER BY genome_source = 'uncultured', assembly_accession, genus) AS rn FROM assemblies WHERE species_taxid IS NOT NULL) WHERE rn = 1 GROUP BY 1) b USING (taxon)""".replace("CASE assembly_level", "CASE assembly_level"))
def _(s, d):
    a = sh.assemblies(s, d)
    subset = ky.best_genome_per_species(a, tie_break=("assembly_accession", "genus"), use_level=False)
    m = sh.merged(s, d).withColumnRenamed("taxon", "taxon_name").drop("isolate_count")
    out = ge.isolate_share_of_database(a, subset, m, "genus")
    return out.select("taxon_name", "total_genome_count", "isolate_count", "isolate_genome_percentage", "isolate_species_count")


@query("a51_supergroup_rollup", """SELECT CASE WHEN p >= 5 THEN g ELSE 'Others' END AS supergroup, sum(n)::BIGINT AS genomes FROM (SELECT g, n, n::DOUBLE / sum(n) OVER () * 100 AS p FROM (SELECT split_part(lineage, ';', 3) AS g, sum(genomes) AS n FROM cat_genus GROUP BY 1)) GROUP BY 1""")
def _(s, d):
    return fg.supergroup_rollup(sh.catalogue(s, d, "genus"), "lineage", "genomes").select("supergroup", "genomes")


@query("a52_total_representation", """SELECT taxon, round_even(r * 1000000, 0) / 1000000 AS total_representation, row_number() OVER (ORDER BY r DESC, taxon) AS rank FROM (SELECT taxon, a / sum(a) OVER () * 100 + b / sum(b) OVER () * 100 + c / sum(c) OVER () * 100 + e / sum(e) OVER () * 100 AS r
 FROM (SELECT taxon, ncbi_genome_count::DOUBLE AS a, census_size_count::DOUBLE AS b, census_otu_count::DOUBLE AS c, ncbi_species_count::DOUBLE AS e FROM merged_genus)) QUALIFY rank <= 10""")
def _(s, d):
    out = fg.total_representation(sh.merged(s, d), ["ncbi_genome_count", "census_size_count", "census_otu_count", "ncbi_species_count"], 10)
    return out.select("taxon", round_even("total_representation", 6).alias("total_representation"), F.col("rank").cast("bigint").alias("rank"))


@query("a53_scaled_sizes", """SELECT taxon, round_even((3 + (r - min(r) OVER ()) * 9 / (max(r) OVER () - min(r) OVER ())) * 1000000, 0) / 1000000 AS circle_size FROM (SELECT taxon, sqrt(greatest(ncbi_genome_count::DOUBLE / greatest(isolate_count, 1), 1)) AS r FROM merged_genus)""")
def _(s, d):
    return fg.scaled_sizes(sh.merged(s, d), "ncbi_genome_count", "isolate_count").select("taxon", round_even("circle_size", 6).alias("circle_size"))


@query("a53_ratio_quartiles", """SELECT round_even(quantile_cont(r, 0.25) * 1000000, 0) / 1000000 AS q25, round_even(quantile_cont(r, 0.5) * 1000000, 0) / 1000000 AS q50, round_even(quantile_cont(r, 0.75) * 1000000, 0) / 1000000 AS q75 FROM (SELECT greatest(ncbi_genome_count::DOUBLE / greatest(isolate_count, 1), 1) AS r FROM merged_genus)""")
def _(s, d):
    out = fg.ratio_quartiles(sh.merged(s, d).select(ms.genomes_per_isolate("ncbi_genome_count", "isolate_count").alias("ratio")))
    return out.select(*[round_even(c, 6).alias(c) for c in out.columns])


@query("a54_gtdb_join", """SELECT s.taxon, s.species, coalesce(g.genomes, 0) AS genomes FROM (SELECT regexp_replace(genus, '_[A-Z]$', '') AS taxon, count(DISTINCT species) AS species FROM gtdb_ranks GROUP BY 1) s
 LEFT JOIN (SELECT regexp_replace(genus, '_[A-Z]$', '') AS taxon, count(*) AS genomes FROM gtdb_ranks WHERE domain = 'Archaea' GROUP BY 1) g USING (taxon)""")
def _(s, d):
    from cladetally.functions.names import strip_variant_suffix
    r = ge.gtdb_ranks(sh.gtdb_taxonomy(s, d)).withColumn("taxon", strip_variant_suffix("genus"))
    species = r.select("taxon", "species").distinct().groupBy("taxon").agg(F.count("*").alias("species"))
    genomes = r.where("domain = 'Archaea'").groupBy("taxon").agg(F.count("*").alias("genomes"))
    return fg.gtdb_counts_joined(species, genomes)


@query("a12_coverage_percentage", """SELECT taxon, CASE WHEN census_otu_count > 0 THEN round_even(ncbi_species_count::DOUBLE / census_otu_count * 100 * 100, 0) / 100 ELSE 0 END AS coverage FROM merged_phylum""")
def _(s, d):
    return sh.merged(s, d, "phylum").select("taxon", ms.coverage_percentage("ncbi_species_count", "census_otu_count").alias("coverage"))
