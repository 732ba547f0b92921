"""Name expressions, filters and classifications on the sample tables."""

from pyspark.sql import functions as F

from cladetally.functions import classify as cl, fixed_values as fv, names as nm, predicates as pr
from checks import shapes as sh
from checks.registry import query


def strip_sql(x):
    return f"(CASE WHEN regexp_matches(trim({x}), '^.+\\d+$') THEN rtrim(regexp_extract(trim({x}), '^(.+?)(\\d+)$', 1)) ELSE {x} END)"


def any_sql(x, words):
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


BASE = """(CASE WHEN contains(lower(name), 'chloroplast') OR contains(lower(name), 'mitochondria') OR contains(lower(name), 'plastid') OR contains(lower(name), 'apicoplast')
 THEN replace(replace(replace(CASE WHEN contains(name, '.') THEN split_part(name, '.', 1) ELSE split_part(name, ':', 1) END, ':plas', ''), ':mito', ''), ':api', '') ELSE name END)"""
CLEANED = f"""(CASE WHEN contains({BASE}, '.U.') THEN {strip_sql(f"split_part({BASE}, '.U.', 1)")}
 WHEN length({BASE}) - length(replace({BASE}, '_', '')) = 1 AND NOT regexp_matches(split_part({BASE}, '_', 2), '\\d') THEN {strip_sql(f"replace({BASE}, '_', ' ')")}
 ELSE {strip_sql(f"replace({BASE}, '_', '  ')")} END)"""


@query("n1_strip_trailing_numbers", f"""SELECT name, {strip_sql('name')} AS stripped FROM
 (SELECT p_brand AS name FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT n_name FROM nation)""")
def _(s, d):
    names = sh.t(s, d, "part").selectExpr("p_brand name").union(
        sh.t(s, d, "customer").selectExpr("c_name name")).union(sh.t(s, d, "nation").selectExpr("n_name name"))
    return names.select("name", nm.strip_trailing_numbers("name").alias("stripped"))


@query("n2_clean_taxon_name", f"""SELECT n_name AS name, {strip_sql("replace(n_name, '_', '  ')")} AS cleaned, count(*) AS suppliers
 FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def _(s, d):
    return sh.t(s, d, "supplier").join(sh.t(s, d, "nation"), F.expr("s_nationkey = n_nationkey")).groupBy(
        F.col("n_name").alias("name")).agg(F.count("*").alias("suppliers")).withColumn("cleaned", nm.clean_taxon_name("name"))


@query("n3_detect_organelle", f"""SELECT p_partkey, coalesce(CASE WHEN contains(lower(name), 'chloroplast') THEN 'chloroplast'
 WHEN contains(lower(name), 'mitochondria') THEN 'mitochondria' END, 'none') AS organelle_type, {BASE} AS base_name FROM hard_names""")
def _(s, d):
    o = nm.detect_organelle("name")
    return sh.hard_names(s, d).select("p_partkey", F.coalesce(o["organelle_type"], F.lit("none")).alias("organelle_type"),
                                      o["base_name"].alias("base_name"))


@query("n4_clean_organelle_name", f"SELECT p_partkey, {CLEANED} AS cleaned FROM hard_names")
def _(s, d):
    return sh.hard_names(s, d).select("p_partkey", nm.clean_organelle_name("name").alias("cleaned"))


@query("n5_organelle_host", """SELECT p_partkey, coalesce(CASE WHEN contains(name, '.Chloroplast') THEN trim(replace(split_part(name, '.Chloroplast', 1), '_', ' '))
 WHEN contains(name, '.Mitochondria') THEN trim(replace(split_part(name, '.Mitochondria', 1), '_', ' ')) END, '-') AS host FROM hard_names""")
def _(s, d):
    return sh.hard_names(s, d).select("p_partkey", F.coalesce(nm.organelle_host("name"), F.lit("-")).alias("host"))


@query("n6_meaningful_part", """SELECT p_partkey, coalesce(CASE WHEN contains(lower(name), 'uncultured') AND NOT contains(lower(name), 'metagenome') THEN
 nullif(array_to_string(list_filter(string_split(name, '_'), lambda w: NOT list_contains(['uncultured','bacterium','organism','eukaryote','sp','species'], lower(w))
  AND length(w) > 2 AND (regexp_matches(w, '^[A-Z][a-z]+$') OR suffix(w, 'bacteria')))[1:2], ' '), '') END, '-') AS meaningful FROM hard_names""")
def _(s, d):
    return sh.hard_names(s, d).select("p_partkey", F.coalesce(nm.meaningful_part("name"), F.lit("-")).alias("meaningful"))


@query("n7_appropriate_rank_name", f"""SELECT p_partkey, coalesce(CASE WHEN contains(c, ' ') AND length(trim(c)) > 0 AND len(regexp_split_to_array(trim(c), '\\s+')) >= 2 THEN regexp_split_to_array(trim(c), '\\s+')[1] ELSE c END, '-') AS genus,
 coalesce(CASE WHEN NOT (contains(c, ' ') AND len(regexp_split_to_array(trim(c), '\\s+')) >= 2) THEN c END, '-') AS family,
 coalesce(CASE WHEN NOT contains(c, ' ') THEN c END, '-') AS phylum FROM (SELECT p_partkey, {CLEANED} AS c FROM hard_names)""")
def _(s, d):
    return sh.hard_names(s, d).select("p_partkey", *[
        F.coalesce(nm.appropriate_rank_name("name", r), F.lit("-")).alias(r) for r in ("genus", "family", "phylum")])


@query("n8_genus_extractors", f"""SELECT h.p_partkey, {strip_sql("split_part(split_part(name, '.', 1), '_', 1)")} AS census_genus,
 coalesce(CASE WHEN regexp_matches(o, '^[A-Z]') THEN split_part(o, ' ', 1) END, '-') AS organism_genus,
 'Name' || h.p_partkey AS taxonomy_genus
 FROM hard_names h JOIN (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN upper(p_name[1]) || p_name[2:] || ' sp. 12' ELSE p_name END AS x,
  CASE WHEN p_size % 2 = 0 THEN upper(p_name[1]) || p_name[2:] ELSE p_name END AS y FROM part) p USING (p_partkey)
 CROSS JOIN LATERAL (SELECT CASE WHEN contains(x, ' sp') AND regexp_matches(x, ' sp\\b') THEN replace(y, ' ', chr(1)) ELSE x END AS o0) q
 CROSS JOIN LATERAL (SELECT o0 AS o) r""".replace("split_part(o, ' ', 1)", "replace(split_part(o, ' ', 1), chr(1), ' ')"))
def _(s, d):
    organism = sh.t(s, d, "part").selectExpr(
        "p_partkey", "case when p_size % 2 = 0 then concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), ' sp. 12') else p_name end x",
        "concat('Eukaryota; Big group; Name', p_partkey, '; lower; two words') tax")
    return sh.hard_names(s, d).join(organism, "p_partkey").select(
        "p_partkey", nm.genus_of_census_name("name").alias("census_genus"),
        F.coalesce(nm.genus_of_organism("x"), F.lit("-")).alias("organism_genus"),
        nm.genus_of_taxonomy("tax").alias("taxonomy_genus"))


@query("n9_hyphen_extract", """SELECT p_partkey, coalesce(CASE WHEN NOT contains(name, '-') THEN NULL
 WHEN suffix(name, '-lineage') THEN split_part(split_part(name, '-lineage', 1), '_', 1)
 WHEN contains(name, '-Group') THEN split_part(name, '-Group', 1)
 WHEN NOT contains(lower(split_part(split_part(name, '-', 2), '_', 1)), 'clade') THEN split_part(split_part(name, '-', 2), '_', 1) END, '-') AS part FROM hard_names""")
def _(s, d):
    return sh.hard_names(s, d).select("p_partkey", F.coalesce(nm.hyphen_extract("name"), F.lit("-")).alias("part"))


@query("n10_synonyms", """SELECT l_returnflag AS flag, CASE l_returnflag WHEN 'A' THEN 'Copepoda' WHEN 'N' THEN 'MAST-12' ELSE 'R' END AS name,
 CASE l_returnflag WHEN 'A' THEN 'adopted' ELSE l_returnflag END AS by_table, count(*) AS n FROM lineitem GROUP BY l_returnflag""")
def _(s, d):
    rows = sh.t(s, d, "lineitem").selectExpr("l_returnflag flag", "l_returnflag by_table",
                                             "case l_returnflag when 'A' then 'Maxillopoda' when 'N' then 'MAST-12' else 'R' end name")
    table = sh.t(s, d, "lineitem").where("l_returnflag = 'A'").selectExpr("l_returnflag old_name", "'adopted' new_name").distinct()
    return nm.apply_synonym_table(rows.withColumn("name", nm.apply_synonyms("name")), "by_table", table).groupBy(
        "flag", "name", "by_table").agg(F.count("*").alias("n"))


@query("n11_normalize_name", """SELECT n_name || '_' || n_regionkey AS name, lower(split_part(n_name, '_', 1)) AS key, count(*) AS customers
 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def _(s, d):
    return sh.t(s, d, "customer").join(sh.t(s, d, "nation"), F.expr("c_nationkey = n_nationkey")).groupBy(
        F.expr("concat(n_name, '_', n_regionkey)").alias("name")).agg(F.count("*").alias("customers")).withColumn(
        "key", nm.normalize_name("name"))


@query("n12_strip_variant_suffix", "SELECT accession_clean, CASE WHEN regexp_matches(phylum, '_[A-Z]$') THEN phylum[:-3] ELSE phylum END AS base FROM gtdb_ranks")
def _(s, d):
    r = sh.gtdb_taxonomy(s, d)
    return r.select(nm.clean_accession("accession").alias("accession_clean"),
                    nm.strip_variant_suffix(nm.gtdb_rank("taxonomy", "phylum")).alias("base"))


@query("n13_gtdb_rank_extraction", """SELECT accession_clean, domain, phylum, class, "order", coalesce(family, 'Unclassified') AS family, genus, species FROM gtdb_ranks""")
def _(s, d):
    from cladetally.operators.genomes import gtdb_ranks
    return gtdb_ranks(sh.gtdb_taxonomy(s, d))


@query("n14_accession_check", """SELECT accession, accession[4:] AS accession_clean, regexp_matches(accession[4:], '^(GCA|GCF)_[0-9]{9}\\.[0-9]+$') AS valid FROM gtdb
 UNION ALL SELECT accession_clean, accession_clean, false FROM acc_a""")
def _(s, d):
    raw = sh.gtdb_taxonomy(s, d).select("accession").union(sh.acc_a(s, d).select("accession_clean"))
    return raw.select("accession", nm.clean_accession("accession").alias("accession_clean"),
                      nm.is_valid_accession(nm.clean_accession("accession")).alias("valid"))


@query("n15_clean_taxid", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'FAILED' WHEN 1 THEN c_custkey::VARCHAR ELSE c_mktsegment END AS taxid FROM customer""")
def _(s, d):
    raw = F.expr("case c_custkey % 3 when 0 then 'FAILED' when 1 then concat('id ', c_custkey, ' x\n77') else c_mktsegment end")
    return sh.t(s, d, "customer").select("c_custkey", nm.clean_taxid(raw).alias("taxid"))


@query("n16_merge_name_cleanup", """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name WHEN 3 THEN p_name ELSE p_name || ':plas' END AS cleaned FROM part""")
def _(s, d):
    raw = F.expr("case p_size % 5 when 0 then concat('Candidatus ', p_name) when 1 then concat(p_name, '_A') "
                 "when 2 then concat(p_name, '_', p_partkey) when 3 then concat(p_name, '.Mitochondria') else concat(p_name, ':plas.Chloroplast') end")
    return sh.t(s, d, "part").select("p_partkey", nm.clean_merge_name(raw).alias("cleaned"))


@query("n17_canonical_names", """SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'Euryarchaeota' WHEN 'MACHINERY' THEN 'Sappinia pedata' ELSE c_mktsegment END AS name, count(*) AS n FROM customer GROUP BY 1""")
def _(s, d):
    raw = F.expr("case c_mktsegment when 'BUILDING' then 'Methanobacteriota' when 'MACHINERY' then 'Sappina' else c_mktsegment end")
    return sh.t(s, d, "customer").groupBy(nm.canonical_name(raw).alias("name")).agg(F.count("*").alias("n"))


@query("n18_cut_strain", """SELECT assembly_accession, trim(regexp_replace(split_part(organism_name, 'strain', 1), '\\s+', ' ', 'g')) AS name, count(*) AS n FROM assemblies GROUP BY 1, 2""")
def _(s, d):
    return sh.assemblies(s, d).groupBy("assembly_accession", nm.cut_strain("organism_name").alias("name")).agg(F.count("*").alias("n"))


@query("n19_base_group", "SELECT split_part(division, '.U.', 1) AS base, count(*) AS n FROM clusters GROUP BY 1")
def _(s, d):
    return sh.clusters(s, d).groupBy(nm.base_group("division").alias("base")).agg(F.count("*").alias("n"))


@query("n20_genus_spelling", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND length(w) > 3 THEN w || 's' || n[length(w)+1:] ELSE n END AS name,
 CASE WHEN p_size % 3 = 0 AND length(w) > 3 THEN 'genus_spelling' ELSE 'none' END AS correction_type
 FROM (SELECT p_partkey, p_size, p_name AS n, split_part(p_name, ' ', 1) AS w FROM part)""")
def _(s, d):
    rows = sh.t(s, d, "part").selectExpr(
        "p_partkey", "p_name", "concat('Eukaryota;', case when p_size % 3 = 0 then concat(substring_index(p_name, ' ', 1), 's') else 'Zzzzzz' end, ';', p_name) lin")
    fix = nm.repair_genus_spelling("p_name", nm.lineage_genus("lin"))
    return rows.select("p_partkey", fix["name"].alias("name"), fix["correction_type"].alias("correction_type"))


@query("n21_family_case", """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'Unclassified' ELSE upper(p_name[1]) || lower(p_name[2:]) END AS family FROM part""")
def _(s, d):
    raw = F.expr("case when p_size % 7 = 0 then null else concat(p_name, '*!') end")
    return sh.t(s, d, "part").select("p_partkey", nm.fix_family_case(raw).alias("family"))


@query("n22_species_of_organism", """SELECT split_part(organism_name, ' ', 1) || CASE WHEN contains(organism_name, ' ') THEN ' ' || split_part(organism_name, ' ', 2) ELSE '' END AS species, count(*) AS n FROM assemblies GROUP BY 1""")
def _(s, d):
    return sh.assemblies(s, d).groupBy(nm.species_of_organism("organism_name").alias("species")).agg(F.count("*").alias("n"))


@query("standardize_names_census", f"""SELECT p_partkey, {strip_sql("replace(name, '_', '  ')")} AS cleaned_name, {strip_sql("split_part(split_part(name, '.', 1), '_', 1)")} AS genus_name,
 {strip_sql("replace(name, '_', ' ')")} AS number_stripped FROM hard_names""")
def _(s, d):
    return nm.standardize_names(sh.hard_names(s, d), "name", "census_18s").drop("name", "hyphen_part")


# --- filters ----------------------------------------------------------------------------------------------
DOMAIN_CASE = "CASE o_orderstatus WHEN 'F' THEN 'Bacteria' WHEN 'O' THEN 'Eukaryota' ELSE 'Viruses' END"


@query("f1_domain_filters", f"""SELECT domain, domain = 'Bacteria' AS prokaryote, domain = 'Eukaryota' AS eukaryote, domain NOT IN ('Eukaryota', 'Viruses') AS anchor, count(*) AS n
 FROM (SELECT {DOMAIN_CASE} AS domain FROM orders) GROUP BY domain""")
def _(s, d):
    return sh.t(s, d, "orders").select(F.expr(DOMAIN_CASE).alias("domain")).groupBy(
        "domain", pr.is_prokaryote("domain").alias("prokaryote"), pr.is_eukaryote("domain").alias("eukaryote"),
        pr.is_anchor_domain("domain").alias("anchor")).agg(F.count("*").alias("n"))


FILTER_NAME = "CASE p_size % 6 WHEN 0 THEN 'Candidatus ' || p_name WHEN 1 THEN p_name || '.U.family' WHEN 2 THEN p_name || 'virus' WHEN 3 THEN 'Aviricota ' || p_name WHEN 4 THEN 'Alveolata_' || p_brand ELSE p_name END"


@query("f2_name_exclusions", f"SELECT name, count(*) AS n FROM (SELECT {FILTER_NAME} AS name FROM part) WHERE NOT regexp_matches(lower(name), 'candidat|[.]u[.]|virus|viral') GROUP BY 1")
def _(s, d):
    return sh.t(s, d, "part").select(F.expr(FILTER_NAME).alias("name")).where(
        pr.is_clean_name("name") & ~pr.starts_candidate("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("f3_eukaryote_groups", f"SELECT name, count(*) AS n FROM (SELECT {FILTER_NAME} AS name FROM part) WHERE NOT regexp_matches(lower(name), 'eukaryota|opisthokonta|streptophyta|chlorophyta|stramenopiles|alveolata|rhizaria|discoba') GROUP BY 1")
def _(s, d):
    return sh.t(s, d, "part").select(F.expr(FILTER_NAME).alias("name")).where(~pr.is_eukaryote_group("name")).groupBy(
        "name").agg(F.count("*").alias("n"))


@query("f4_empty_taxa", "SELECT genus AS taxon, count(*) AS n FROM clusters WHERE genus IS NOT NULL AND trim(genus) <> '' GROUP BY genus")
def _(s, d):
    return sh.clusters(s, d).where(pr.is_named("genus")).groupBy(F.col("genus").alias("taxon")).agg(F.count("*").alias("n"))


@query("f5_verifiable_phylum", """SELECT phylum, count(*) AS n FROM (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'Candidatus X' WHEN 'MACHINERY' THEN 'synthetic construct' ELSE c_mktsegment END AS phylum FROM customer)
 WHERE phylum NOT IN ('Candidatus X', 'synthetic construct') GROUP BY phylum""")
def _(s, d):
    p = F.expr("case c_mktsegment when 'BUILDING' then 'Candidatus X' when 'MACHINERY' then 'synthetic construct' else c_mktsegment end")
    return sh.t(s, d, "customer").select(p.alias("phylum")).where(pr.is_verifiable_phylum("phylum")).groupBy("phylum").agg(F.count("*").alias("n"))


@query("f6_rank_appropriateness", """SELECT taxid, contains(ranks, 'phylum') AND NOT contains(ranks, 'family') AND NOT contains(ranks, 'species') AS phylum_ok,
 contains(ranks, 'family') AND NOT contains(ranks, 'species') AS family_ok FROM lin""")
def _(s, d):
    from cladetally.functions.lineages import fits_rank
    return sh.tree(s, d).select("taxid", fits_rank("lineage", "phylum").alias("phylum_ok"), fits_rank("lineage", "family").alias("family_ok"))


@query("f7_eukaryotes_only", """SELECT taxon, otu_count FROM (SELECT genus AS taxon, count(centroid) AS otu_count FROM clusters WHERE genus IS NOT NULL GROUP BY genus) c
 LEFT JOIN lookup a ON a.name = c.taxon LEFT JOIN lookup b ON b.name = split_part(c.taxon, ' ', 1) LEFT JOIN lin l ON l.taxid = coalesce(a.taxid, b.taxid)
 WHERE coalesce(contains(l.lineage, 'Eukaryota'), true)""")
def _(s, d):
    from cladetally.operators import taxonomy as tx
    from cladetally.operators.census import census_by_rank
    census = census_by_rank(sh.clusters(s, d), "genus", "18s")
    return tx.eukaryotes_only(census, sh.names(s, d), sh.tree(s, d), "taxon").select("taxon", "otu_count")


@query("f8_figure_filter", """SELECT taxon, census_otu_count, ncbi_species_count FROM merged_genus WHERE match_status = 'matched' AND census_otu_count > 0 AND ncbi_species_count > 0""")
def _(s, d):
    from cladetally.plans.pipelines import figure_rows
    return figure_rows(sh.merged(s, d)).select("taxon", "census_otu_count", "ncbi_species_count")


@query("f9_significance_cutoffs", """SELECT taxon, census_otu_count, contains(taxon, '.U.') AND census_otu_count >= 50 AS drawn_bacteria FROM merged_genus
 WHERE census_otu_count >= 2 AND CASE WHEN census_otu_count > 0 THEN round_even(ncbi_species_count::DOUBLE / census_otu_count * 100 * 100, 0) / 100 ELSE 0 END <= 100""")
def _(s, d):
    from cladetally.functions.measures import coverage_percentage
    m = sh.merged(s, d)
    return m.where(pr.passes_cutoff("census_otu_count", coverage_percentage("ncbi_species_count", "census_otu_count"), "genus")).select(
        "taxon", "census_otu_count", pr.is_significant_unclassified("taxon", "census_otu_count", "Bacteria").alias("drawn_bacteria"))


@query("f11_placeholder_isolates", "SELECT assembly_accession, isolate, count(*) AS n FROM assemblies WHERE lower(trim(isolate)) = 'missing' GROUP BY 1, 2")
def _(s, d):
    return sh.assemblies(s, d).where(pr.is_placeholder("isolate")).groupBy("assembly_accession", "isolate").agg(F.count("*").alias("n"))


@query("f12_domain_rank_check", """SELECT taxid, array_to_string(list_filter([CASE WHEN NOT regexp_matches(lower(lineage), '\\bbacteria\\b') THEN 'domain mismatch' END,
 CASE WHEN NOT contains(ranks, 'class') THEN 'rank missing' END], lambda x: x IS NOT NULL), ';') AS issues FROM unmapped
 WHERE NOT (regexp_matches(lower(lineage), '\\bbacteria\\b') AND contains(ranks, 'class'))""")
def _(s, d):
    from cladetally.functions.lineages import name_at_rank, parse_lineage
    u = sh.unmapped(s, d).withColumn("l", parse_lineage("lineage", "ranks"))
    issues = pr.taxon_issues(F.lit("taxon"), "lineage", name_at_rank("l", "class"), "Bacteria", "class")
    return u.select("taxid", issues.alias("i")).where(F.size("i") > 0).select("taxid", F.array_join("i", ";").alias("issues"))


@query("f13_near_diagonal", """SELECT taxon, novelty_factor, overrepresentation_factor FROM merged_genus
 WHERE (novelty_factor > 1.5 OR overrepresentation_factor > 1.5) AND match_status = 'matched' AND taxon NOT IN ('small ring')""")
def _(s, d):
    m = sh.merged(s, d).where("match_status = 'matched'")
    return m.where(pr.is_off_diagonal("novelty_factor", "overrepresentation_factor", "taxon", ["small ring"])).select(
        "taxon", "novelty_factor", "overrepresentation_factor")


# --- genome source --------------------------------------------------------------------------------------------
UNC = ['uncultured', 'environmental', 'metagenome', 'unclassified', 'unknown', 'unidentified', 'mixed culture', 'mag', 'single amplified genome', 'sag']


@query("g1_pattern_source", f"""SELECT source, genome_source, count(*) AS n FROM (SELECT source, CASE WHEN {any_sql('lower(text)', UNC)}
 OR (contains(lower(text), 'enrichment culture') AND NOT regexp_matches(lower(text), '\\bstrain\\b|\\bisolate\\b|\\bstr\\.\\b')) THEN 'uncultured' ELSE 'isolate' END AS genome_source FROM documents) GROUP BY 1, 2""")
def _(s, d):
    return sh.t(s, d, "documents").groupBy("source", cl.genome_source("text").alias("genome_source")).agg(F.count("*").alias("n"))


@query("g1_assembly_source", f"""SELECT assembly_level, genome_source, count(*) AS n FROM (SELECT assembly_level, CASE WHEN {any_sql("lower(organism_name || '|' || coalesce(excluded_from_refseq, ''))", UNC)} THEN 'uncultured' ELSE 'isolate' END AS genome_source FROM assemblies) GROUP BY 1, 2""")
def _(s, d):
    return sh.assemblies(s, d).groupBy("assembly_level", cl.genome_source("organism_name", "excluded_from_refseq").alias("genome_source")).agg(F.count("*").alias("n"))


@query("g2_priority_source", """SELECT genome_source, count(*) AS n FROM (SELECT CASE WHEN contains(coalesce(excluded_from_refseq, ''), 'metagenome') THEN 'uncultured'
 WHEN l7 = 1 THEN 'uncultured' WHEN regexp_matches(organism_name, '(?i)\\buncultured\\b') THEN 'uncultured' ELSE 'isolate' END AS genome_source
 FROM (SELECT *, CASE WHEN assembly_level = 'Scaffold' THEN 1 ELSE 0 END AS l7 FROM assemblies)) GROUP BY 1""")
def _(s, d):
    attrs = F.expr("case when assembly_level = 'Scaffold' then array(named_struct('name', 'isolation_source', 'value', 'Environmental water')) end")
    report = cl.source_from_report(F.lit("haploid"), attrs)
    return sh.assemblies(s, d).groupBy(
        cl.genome_source_by_priority("assembly_accession", "organism_name", "excluded_from_refseq", report).alias("genome_source")
    ).agg(F.count("*").alias("n"))


@query("g3_keyword_source", f"""SELECT lang, k8, k16, count(*) AS n FROM (SELECT lang,
 CASE WHEN text IS NULL THEN 'unknown' WHEN {any_sql('lower(text)', fv.SOURCE_KEYWORDS_8)} THEN 'uncultured' ELSE 'isolate' END AS k8,
 CASE WHEN {any_sql('lower(text)', fv.SOURCE_KEYWORDS_16)} OR {any_sql('lower(source)', fv.EXCLUSION_KEYWORDS)} THEN 'uncultured' ELSE 'isolate' END AS k16 FROM documents) GROUP BY 1, 2, 3""")
def _(s, d):
    return sh.t(s, d, "documents").groupBy("lang", cl.genome_source_by_keyword("text").alias("k8"),
                                           cl.genome_source_by_keyword_and_note("text", "source").alias("k16")).agg(F.count("*").alias("n"))


@query("g4_isolate_field", "SELECT coalesce(isolate, '') <> '' AS is_isolate, count(*) AS n FROM assemblies GROUP BY 1")
def _(s, d):
    return sh.assemblies(s, d).groupBy(cl.has_isolate_field("isolate").alias("is_isolate")).agg(F.count("*").alias("n"))


def _domain_sql(x):
    return "CASE " + " ".join(f"WHEN {any_sql(x, w)} THEN '{l}'" for l, w in fv.INFERRED_DOMAIN_WORDS) + " ELSE 'Unclassified' END"


@query("g5_inferred_domain", f"SELECT lang, {_domain_sql('lower(text)')} AS domain, count(*) AS n FROM documents GROUP BY 1, 2")
def _(s, d):
    return sh.t(s, d, "documents").groupBy("lang", cl.inferred_domain("text").alias("domain")).agg(F.count("*").alias("n"))


@query("g6_isolate_circle", """SELECT taxon, CASE WHEN p = 0 THEN 25 WHEN p < 10 THEN 20 WHEN p < 50 THEN 15 ELSE 10 END AS circle_size
 FROM (SELECT taxon, CASE WHEN ncbi_genome_count > 0 THEN isolate_count::DOUBLE / ncbi_genome_count * 100 ELSE 0 END AS p FROM merged_genus)""")
def _(s, d):
    return sh.merged(s, d).select("taxon", cl.isolate_circle_size("isolate_count", "ncbi_genome_count").alias("circle_size"))


@query("g7_representation_band", """SELECT taxon, CASE WHEN p = 0 THEN 'No_Representation' WHEN p < 1 THEN 'Low_Representation' WHEN p < 10 THEN 'Moderate_Representation'
 WHEN p < 50 THEN 'Good_Representation' ELSE 'High_Representation' END AS band
 FROM (SELECT taxon, CASE WHEN census_otu_count > 0 THEN round_even(ncbi_species_count::DOUBLE / census_otu_count * 100 * 100, 0) / 100 ELSE 0 END AS p FROM merged_genus)""")
def _(s, d):
    from cladetally.functions.measures import coverage_percentage
    return sh.merged(s, d).select("taxon", cl.representation_band(coverage_percentage("ncbi_species_count", "census_otu_count")).alias("band"))
