"""Joins of census, catalogue and accession tables on the sample shapes."""

from pyspark.sql import functions as F

from cladetally.functions.common import round_even
from cladetally.operators import anchor as an, figures as fg, genomes as ge, matching as mt
from cladetally.operators import quality as qu
from cladetally.session import materialize
from checks import shapes as sh
from checks.registry import query


@query("j1_assembly_rank_map", """SELECT m.phylum, m.domain, count(*) AS n FROM assemblies a JOIN map_phylum m USING (taxid) GROUP BY 1, 2""")
def _(s, d):
    a = sh.assemblies(s, d).drop("phylum", "domain")
    # a map with repeated taxids must not multiply genomes
    doubled = sh.rank_map(s, d, "phylum")
    return ge.attach_rank(a, doubled.union(doubled)).groupBy("phylum", "domain").agg(F.count("*").alias("n"))


@query("j2_lineage_containment", "SELECT taxon AS census_taxon, cat_taxon AS catalogue_taxon, genomes, count(*) AS n FROM pairs_family WHERE by_lineage GROUP BY ALL")
def _(s, d):
    c, k = sh.stored(s, d, "family")
    return mt.match_pairs(c, k, by_taxid=False).groupBy("census_taxon", "catalogue_taxon", "genomes").agg(F.count("*").alias("n"))


@query("j3_match_log", """SELECT taxon AS census_taxon, cat_taxon AS catalogue_taxon, genomes, species,
 CASE WHEN taxon = cat_taxon THEN 'direct_match' WHEN by_taxid THEN 'taxid_match' ELSE 'lineage_match' END AS match_type FROM pairs_genus""")
def _(s, d):
    c, k = sh.stored(s, d, "genus")
    return mt.match_pairs(c, k).select("census_taxon", "catalogue_taxon", "genomes", "species", "match_type")


# A name is reached when one of its rows is; homonyms in other domains go with it.
@query("j4_catalogue_only", """WITH RECURSIVE k AS (SELECT CASE WHEN domain = 'ECONOMY' THEN 'New ' || taxon ELSE taxon END AS taxon, CASE WHEN domain = 'ECONOMY' THEN NULL ELSE taxid END AS taxid,
 CASE WHEN domain = 'ECONOMY' THEN 'New ' || taxon ELSE lineage END AS lineage, domain, genomes FROM cat_genus)
 SELECT taxon, domain, genomes FROM k WHERE taxon NOT IN (SELECT k.taxon FROM k JOIN census_genus c ON contains(';' || k.lineage || ';', ';' || c.taxon || ';') OR c.taxid = k.taxid)""")
def _(s, d):
    # one domain's genera are renamed, so that the census cannot reach them
    new = F.col("domain") == "ECONOMY"
    cat = sh.catalogue(s, d, "genus").withColumns({
        "taxid": F.when(~new, F.col("taxid")), "taxon": F.when(new, F.concat(F.lit("New "), "taxon")).otherwise(F.col("taxon")),
        "lineage": F.when(new, F.concat(F.lit("New "), "taxon")).otherwise(F.col("lineage"))})
    return mt.catalogue_only(sh.census(s, d, "genus"), mt.catalogue_with_parts(cat)).select("taxon", "domain", "genomes")


J5 = """SELECT coalesce(k.taxon, c.taxon) AS taxon_name, coalesce(k.genomes, 0) AS ncbi_genome_count, coalesce(k.species, 0) AS ncbi_species_count,
 coalesce(c.otu_count, 0) AS census_otu_count FROM (SELECT *, taxon AS k FROM cat_genus) k FULL JOIN (SELECT *, taxon AS k FROM census_genus) c ON k.k = c.k"""


def _outer(s, d):
    return mt.outer_name_merge(sh.catalogue(s, d, "genus").withColumn("taxon", F.concat(F.lit("Candidatus "), F.col("taxon"))),
                               sh.census(s, d, "genus").withColumn("taxon", F.concat("taxon", F.lit("_A"))), "ncbi")


@query("j5_outer_name_merge", J5.replace("coalesce(k.taxon, c.taxon) AS taxon_name", "coalesce('Candidatus ' || k.taxon, c.taxon || '_A') AS taxon_name"))
def _(s, d):
    return _outer(s, d).select("taxon_name", "ncbi_genome_count", "ncbi_species_count", "census_otu_count")


INDEX = """SELECT key, taxon, domain, genomes, species FROM (SELECT lower(split_part(trim(taxon), '_', 1)) AS key, *, row_number() OVER (PARTITION BY lower(split_part(trim(taxon), '_', 1)) ORDER BY genomes DESC, taxon, domain) AS rn
 FROM {src} WHERE lower(domain) NOT IN ('eukaryota', 'viruses')) WHERE rn = 1"""
IA, IB = INDEX.format(src="counts_a"), INDEX.format(src="counts_b")


@query("j6_direct_names", f"""SELECT b.taxon, a.domain AS gtdb_domain, b.domain AS ncbi_domain, a.genomes AS gtdb_genome_count, b.genomes AS ncbi_genome_count
 FROM ({IA}) a JOIN ({IB}) b USING (key)""")
def _(s, d):
    a, b = an.name_index(sh.counts_a(s, d)), an.name_index(sh.counts_b(s, d), True)
    return an.direct_matches(a, b).select("taxon", "gtdb_domain", "ncbi_domain", "gtdb_genome_count", "ncbi_genome_count")


PAIRS = """SELECT a, b, count(*) AS n FROM (SELECT accession_clean, min(lower(split_part(taxon, '_', 1))) AS a FROM acc_a WHERE domain <> 'Eukaryota' GROUP BY 1)
 JOIN (SELECT accession_clean, min(lower(split_part(taxon, '_', 1))) AS b FROM acc_b GROUP BY 1) USING (accession_clean) WHERE a <> b GROUP BY 1, 2"""


@query("j7_accession_mapping", f"""SELECT 'a' AS side, a AS name, b AS partner FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rn FROM ({PAIRS})) WHERE rn = 1
 UNION ALL SELECT 'b', b, a FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS rn FROM ({PAIRS})) WHERE rn = 1""")
def _(s, d):
    p = an.accession_name_pairs(sh.acc_a(s, d), sh.acc_b(s, d))
    left = an.modal_partner(p, "a", "b").select(F.lit("a").alias("side"), F.col("a").alias("name"), F.col("b").alias("partner"))
    return left.union(an.modal_partner(p, "b", "a").select(F.lit("b"), "b", "a"))


ANCHORED = f"""WITH ia AS ({IA}), ib AS ({IB}), pr AS ({PAIRS}),
 dm AS (SELECT a.key AS ak, b.key AS bk, 'Direct_Name' AS anchor, 0 AS o FROM ia a JOIN ib b USING (key)),
 ma AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rn FROM pr) WHERE rn = 1),
 mb AS (SELECT b, a FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS rn FROM pr) WHERE rn = 1),
 fw AS (SELECT ia.key AS ak, ib.key AS bk, 'Accession_Mapped_GTDB_to_NCBI' AS anchor, 1 AS o FROM ia JOIN ma ON ma.a = ia.key JOIN ib ON ib.key = ma.b WHERE ia.key NOT IN (SELECT ak FROM dm)),
 bw AS (SELECT ia.key AS ak, ib.key AS bk, 'Accession_Mapped_NCBI_to_GTDB' AS anchor, 2 AS o FROM ib JOIN mb ON mb.b = ib.key JOIN ia ON ia.key = mb.a
  WHERE ib.key NOT IN (SELECT bk FROM dm) AND ia.key NOT IN (SELECT ak FROM dm) AND ia.key NOT IN (SELECT ak FROM fw)),
 mm AS (SELECT * FROM dm UNION ALL SELECT * FROM fw UNION ALL SELECT * FROM bw),
 rr AS (SELECT ib.taxon, mm.o, ia.taxon AS gname, ia.domain AS gd, ib.domain AS nd, ia.genomes AS gg, ib.genomes AS ng, mm.anchor FROM mm JOIN ia ON ia.key = mm.ak JOIN ib ON ib.key = mm.bk)
 SELECT x.taxon, x.gd AS gtdb_domain, x.nd AS ncbi_domain, 'Both' AS database_presence, y.anchor_type, x.gg AS gtdb_genome_count, x.ng AS ncbi_genome_count
 FROM (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY o, gname) AS rn FROM rr) x JOIN (SELECT taxon, string_agg(anchor, '+' ORDER BY anchor) AS anchor_type FROM (SELECT DISTINCT taxon, anchor FROM rr) GROUP BY taxon) y USING (taxon) WHERE rn = 1
 UNION ALL SELECT taxon, domain, '', 'GTDB_Only', 'None', genomes, 0 FROM ia WHERE key NOT IN (SELECT ak FROM mm)
 UNION ALL SELECT taxon, '', domain, 'NCBI_Only', 'None', 0, genomes FROM ib WHERE key NOT IN (SELECT bk FROM mm)"""
ANCHOR_SQL = sh.sql("SELECT * FROM counts_a, counts_b").rsplit("\n", 1)[0] + ",\n" + ANCHORED.removeprefix("WITH ")


def _anchored(s, d):
    return an.apply_anchors(sh.counts_a(s, d), sh.counts_b(s, d), sh.acc_a(s, d), sh.acc_b(s, d))


def _raw(name, text):
    from checks import registry

    def add(fn):
        registry.QUERIES[name] = fn
        registry.ORACLES[name] = text
        return fn
    return add


@_raw("j8_apply_anchors", f"SELECT database_presence, anchor_type, count(*) AS n, sum(gtdb_genome_count)::BIGINT AS gtdb, sum(ncbi_genome_count)::BIGINT AS ncbi FROM ({ANCHOR_SQL}) GROUP BY 1, 2")
def _(s, d):
    return _anchored(s, d).groupBy("database_presence", "anchor_type").agg(
        F.count("*").alias("n"), F.sum("gtdb_genome_count").alias("gtdb"), F.sum("ncbi_genome_count").alias("ncbi"))


@_raw("j9_consolidate", ANCHOR_SQL)
def _(s, d):
    return _anchored(s, d).select("taxon", "gtdb_domain", "ncbi_domain", "database_presence", "anchor_type", "gtdb_genome_count", "ncbi_genome_count")


@_raw("f10_suspicious_taxa", f"SELECT taxon, gtdb_genome_count FROM ({ANCHOR_SQL}) WHERE database_presence = 'GTDB_Only'")
def _(s, d):
    # the second catalogue only, so that names stay unmatched
    return an.suspicious_taxa(_anchored(s, d)).select("taxon", "gtdb_genome_count")


@query("j10_verification", """SELECT taxon, bool_or(coalesce(l.phylum IS NOT NULL, false)) AS verified FROM (SELECT DISTINCT taxon, accession_clean FROM acc_a) LEFT JOIN (SELECT o_orderkey::VARCHAR AS accession_clean, o_custkey * 5 + 1000 AS taxid FROM orders) o USING (accession_clean) LEFT JOIN lin l USING (taxid) GROUP BY taxon""")
def _(s, d):
    acc = sh.acc_a(s, d)
    asm = sh.t(s, d, "orders").selectExpr("cast(o_orderkey as string) assembly_accession", "o_custkey * 5 + 1000 taxid")
    return an.verified_taxa(acc.select("taxon").distinct(), acc, asm, sh.tree(s, d)).select("taxon", "verified")


@query("j11_isolates_of_matches", """SELECT taxon, sum(isolates)::BIGINT AS isolates, sum(isolate_genomes)::BIGINT AS isolate_genomes FROM pairs_genus GROUP BY taxon""")
def _(s, d):
    return mt.match_totals(*sh.stored(s, d, "genus")).select("taxon", "isolates", "isolate_genomes")


@query("j12_species_to_counts", """SELECT coalesce(a.family, b.family) AS family, coalesce(a.domain, b.domain) AS domain, coalesce(g, 0) AS family_genome_count, coalesce(sp, 0) AS family_species_count FROM
 (SELECT family, domain, count(*) AS g FROM assemblies WHERE genome_source = 'isolate' GROUP BY 1, 2) a FULL JOIN (SELECT family, domain, count(DISTINCT species_taxid) AS sp FROM assemblies WHERE assembly_level = 'Contig' GROUP BY 1, 2) b ON a.family = b.family AND a.domain = b.domain""")
def _(s, d):
    a = sh.assemblies(s, d)
    return ge.join_species_counts(ge.genome_counts(a.where("genome_source = 'isolate'"), "family"), ge.species_counts(a.where("assembly_level = 'Contig'"), "family"), "family")


@query("j13_attach_source", """SELECT genome_source, count(*) AS n FROM (SELECT CASE WHEN m.k IS NULL THEN 'isolate' ELSE 'uncultured' END AS genome_source FROM assemblies a
 LEFT JOIN (SELECT DISTINCT assembly_accession AS k FROM assemblies WHERE genome_size > 30000000) m ON m.k = a.assembly_accession) GROUP BY 1""")
def _(s, d):
    a = sh.assemblies(s, d)
    classified = a.where("genome_size > 30000000").selectExpr("assembly_accession accession_clean", "'uncultured' genome_source")
    return ge.attach_source(a, classified).groupBy("genome_source").agg(F.count("*").alias("n"))


@query("j14_stats_rank_maps", """SELECT s.species_taxid, n AS total_genomes, coalesce(p.phylum, '-') AS phylum, coalesce(f.family, '-') AS family, coalesce(p.domain, f.domain, '-') AS domain
 FROM (SELECT species_taxid, count(assembly_accession) AS n FROM assemblies WHERE species_taxid IS NOT NULL GROUP BY 1) s LEFT JOIN map_phylum p ON p.taxid = s.species_taxid LEFT JOIN map_family f ON f.taxid = s.species_taxid""")
def _(s, d):
    stats = ge.species_profile(sh.assemblies(s, d)).select("species_taxid", "total_genomes")
    maps = {r: sh.rank_map(s, d, r) for r in ("phylum", "family")}
    return ge.attach_rank_maps(stats, maps).fillna("-", ["phylum", "family", "domain"])


COMBO_G = "SELECT family, division, row_count, taxonomic_combination, genus AS g FROM combos"


@query("j15_genus_parents", f"""SELECT t.genus, coalesce(x.family, 'NOT_FOUND') AS family, coalesce(x.division, 'NOT_FOUND') AS division, coalesce(x.row_count, 0) AS combination_row_count
 FROM (SELECT taxon AS genus FROM merged_genus WHERE match_status = 'matched' ORDER BY novelty_factor DESC, taxon LIMIT 20) t
 LEFT JOIN (SELECT n.genus, c.*, row_number() OVER (PARTITION BY n.genus ORDER BY c.g <> n.genus, c.row_count DESC, c.taxonomic_combination) AS rn
 FROM (SELECT taxon AS genus FROM merged_genus WHERE match_status = 'matched' ORDER BY novelty_factor DESC, taxon LIMIT 20) n JOIN ({COMBO_G}) c ON contains(c.g, n.genus)) x ON x.genus = t.genus AND x.rn = 1""")
def _(s, d):
    from cladetally.operators.census import taxonomic_combinations
    from cladetally.plans.pipelines import top_novel_taxa
    top = top_novel_taxa(sh.merged(s, d), 20).select(F.col("taxon").alias("genus"))
    return fg.genus_parents(top, taxonomic_combinations(sh.clusters(s, d), examples=False))


J16 = """SELECT f.family AS listed_family, c.genus, f.novelty_factor, sum(c.size)::BIGINT AS size, how FROM (SELECT taxon AS family, novelty_factor FROM merged_family WHERE match_status = 'matched' ORDER BY novelty_factor DESC, taxon LIMIT 8) f
 JOIN (SELECT division AS phylum, family, genus, coalesce(sum(size), 0) AS size FROM clusters WHERE genus IS NOT NULL GROUP BY 1, 2, 3) c
 ON contains(lower(c.family), lower(f.family)) OR contains(lower(c.phylum), lower(f.family)) OR contains(lower(c.genus), lower(f.family))
 JOIN (SELECT f2.family, CASE WHEN bool_or(contains(lower(c2.family), lower(f2.family))) THEN 0 ELSE 1 END AS how FROM (SELECT taxon AS family FROM merged_family) f2 JOIN clusters c2
  ON c2.genus IS NOT NULL AND (contains(lower(c2.family), lower(f2.family)) OR contains(lower(c2.division), lower(f2.family)) OR contains(lower(c2.genus), lower(f2.family))) GROUP BY 1) h ON h.family = f.family
 WHERE how = 1 OR contains(lower(c.family), lower(f.family)) GROUP BY ALL"""


def _family_genera(s, d):
    from cladetally.plans.pipelines import top_novel_taxa
    top = materialize(top_novel_taxa(sh.merged(s, d, "family"), 8).select(F.col("taxon").alias("family"), "novelty_factor"))
    return fg.family_genera(sh.clusters_16s(s, d), top)


@query("j16_family_genera", J16)
def _(s, d):
    return _family_genera(s, d).select("listed_family", "genus", "novelty_factor", F.coalesce("size", F.lit(0)).alias("size"), "how")


@query("j16_lineage_members", """SELECT k.taxon, f.family AS listed_family, count(*) AS n FROM cat_genus k JOIN (SELECT taxon AS family FROM merged_family WHERE match_status = 'matched' ORDER BY novelty_factor DESC, taxon LIMIT 8) f
 ON contains(lower(k.lineage), lower(f.family)) GROUP BY 1, 2""")
def _(s, d):
    from cladetally.plans.pipelines import top_novel_taxa
    top = top_novel_taxa(sh.merged(s, d, "family"), 8).select(F.col("taxon").alias("family"))
    return fg.lineage_members(sh.catalogue(s, d, "genus"), top).groupBy("taxon", "listed_family").agg(F.count("*").alias("n"))


def _novel_combos(s, d):
    from cladetally.operators.census import taxonomic_combinations
    from cladetally.plans.pipelines import top_novel_taxa
    top = top_novel_taxa(sh.merged(s, d), 15).select(F.col("taxon").alias("genus"), "novelty_factor", "census_otu_count")
    return fg.novel_genus_combinations(top, taxonomic_combinations(sh.clusters(s, d), examples=False))


@query("j17_novel_combinations", """SELECT c.genus, c.taxonomic_combination, c.row_count, t.novelty_factor FROM combos c JOIN (SELECT taxon AS genus, novelty_factor FROM merged_genus WHERE match_status = 'matched' ORDER BY novelty_factor DESC, taxon LIMIT 15) t USING (genus)""")
def _(s, d):
    return _novel_combos(s, d).select("genus", "taxonomic_combination", "row_count", "novelty_factor")


@query("j18_recheck_in_counts", "SELECT DISTINCT u.taxid::VARCHAR AS taxid, 'genus' AS count_level FROM unmapped u JOIN cat_genus k ON u.taxid = k.taxid UNION ALL SELECT DISTINCT u.taxid::VARCHAR, 'family' FROM unmapped u JOIN cat_family k ON u.taxid = k.taxid")
def _(s, d):
    return qu.recheck_in_counts(sh.unmapped(s, d), {r: sh.catalogue(s, d, r) for r in ("genus", "family")})


@query("j19_raw_count_check", """SELECT k.taxon, k.n AS stored, coalesce(a.n, 0) AS actual_count, k.n - coalesce(a.n, 0) AS difference FROM (SELECT genus AS taxon, count(*) AS n FROM assemblies GROUP BY 1) k
 LEFT JOIN (SELECT genus AS taxon, count(DISTINCT species_taxid) AS n FROM assemblies WHERE species_taxid IS NOT NULL GROUP BY 1) a USING (taxon)""")
def _(s, d):
    a = sh.assemblies(s, d)
    stored = a.groupBy(F.col("genus").alias("taxon")).agg(F.count("*").alias("stored"))
    return qu.raw_count_check(stored, a, "genus", "species_taxid", "stored")


@query("j20_fill_lineage", """SELECT u.taxid, coalesce(l1.lineage, l2.lineage, '') AS lineage, CASE WHEN l1.taxid IS NOT NULL THEN 'taxid' WHEN l2.taxid IS NOT NULL THEN 'species_taxid' ELSE 'none' END AS lineage_source, coalesce(l1.family, l2.family, '-') AS family_name
 FROM unmapped u LEFT JOIN lin l1 ON l1.taxid = u.taxid LEFT JOIN lin l2 ON l2.taxid = u.species_taxid""")
def _(s, d):
    out = qu.fill_lineage(sh.unmapped(s, d).select("taxid", "species_taxid"), sh.tree(s, d))
    return out.select("taxid", "lineage", "lineage_source", F.coalesce("family_name", F.lit("-")).alias("family_name"))


@query("j21_division_override", "SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'Insecta' WHEN 'MACHINERY' THEN 'Zea' ELSE c_mktsegment END AS taxon, CASE c_mktsegment WHEN 'BUILDING' THEN 'Opisthokonta' WHEN 'MACHINERY' THEN 'Streptophyta' ELSE 'Other' END AS division, count(*) AS n FROM customer GROUP BY 1, 2")
def _(s, d):
    rows = sh.t(s, d, "customer").selectExpr("case c_mktsegment when 'BUILDING' then 'Insecta' when 'MACHINERY' then 'Zea' else c_mktsegment end taxon")
    return fg.division_override(rows).groupBy("taxon", "division").agg(F.count("*").alias("n"))


@query("j22_evidence", """SELECT taxon, name, bool_or(dn) AS direct_name, bool_or(ti) AS taxid_match, bool_or(an) AS ancestor, bool_or(cn) AS cross_name, CASE WHEN bool_or(dn OR ti) THEN 'high' ELSE 'medium' END AS confidence FROM (
 SELECT c.name AS taxon, m.taxid AS name, m.family = c.name AS dn, mf.a_taxid = c.taxid AS ti, t.a_taxid = c.taxid AS an, t.a_name = c.name AS cn
 FROM (SELECT taxid, family FROM lin WHERE species IS NOT NULL) m JOIN tree t USING (taxid) JOIN tree mf ON mf.taxid = m.taxid AND mf.a_rank = 'family'
 JOIN (SELECT l.taxid AS id, coalesce(l.name, '') AS name, l.a_taxid AS taxid FROM tree l WHERE l.rank IN ('phylum', 'family') AND l.a_rank = 'phylum') c ON t.a_taxid = c.taxid OR t.a_name = c.name) GROUP BY 1, 2""")
def _(s, d):
    tree = materialize(sh.tree(s, d))
    node = F.try_element_at("lineage", F.lit(-1))
    census = tree.where(node["rank"].isin("phylum", "family")).select(node["name"].alias("taxon"), "lineage")
    members = tree.where(node["rank"] == "species").select(F.col("taxid").alias("name"), "lineage")
    return mt.evidence_pairs(census, members, "family")


ANCESTORS = """(SELECT c.taxon, k.taxon AS cat_taxon, k.genomes, k.species, k.domain, contains(';' || k.lineage || ';', ';' || c.taxon || ';') AS by_lineage, coalesce(c.taxid = k.taxid, false) AS by_taxid
 FROM (SELECT domain AS taxon, 1000 + max(taxid) % 500 AS taxid FROM assemblies GROUP BY 1 UNION ALL SELECT taxon, taxid FROM census_phylum) c JOIN cat_genus k ON contains(';' || k.lineage || ';', ';' || c.taxon || ';') OR c.taxid = k.taxid)"""


def _ancestor_inputs(s, d):
    """Census names that are ancestors (domains, phyla) of the genus catalogue's rows."""
    domains = sh.assemblies(s, d).groupBy(F.col("domain").alias("taxon")).agg((1000 + F.max("taxid") % 500).alias("taxid"))
    census = domains.union(sh.census(s, d, "phylum").select("taxon", "taxid"))
    return materialize(census), materialize(sh.catalogue_full(s, d, "genus"))


@query("j3_ancestor_match_log", f"SELECT taxon AS census_taxon, cat_taxon AS catalogue_taxon, genomes, CASE WHEN by_taxid THEN 'taxid_match' ELSE 'lineage_match' END AS match_type FROM {ANCESTORS}")
def _(s, d):
    return mt.match_pairs(*_ancestor_inputs(s, d)).select("census_taxon", "catalogue_taxon", "genomes", "match_type")


@query("a8_ancestor_totals", f"SELECT taxon, sum(genomes)::BIGINT AS genomes, sum(species)::BIGINT AS species, count(*) AS matched_rows, sum(by_taxid::INT)::BIGINT AS taxid_matches FROM {ANCESTORS} GROUP BY taxon")
def _(s, d):
    return mt.match_totals(*_ancestor_inputs(s, d)).select("taxon", "genomes", "species", "matched_rows", "taxid_matches")


# --- merges -----------------------------------------------------------------------------------------------------
for _rank in ("phylum", "family", "genus"):
    @query(f"merge_ncbi_{_rank}", f"SELECT * FROM merged_{_rank}")
    def _(s, d, rank=_rank):
        return sh.merged(s, d, rank)


@query("a8_match_aggregation", """SELECT taxon, sum(genomes)::BIGINT AS genomes, sum(species)::BIGINT AS species, count(*) AS matched_rows, max((taxon = cat_taxon)::INT) AS direct_matches, sum(by_taxid::INT)::BIGINT AS taxid_matches FROM pairs_phylum GROUP BY taxon""")
def _(s, d):
    return mt.match_totals(*sh.stored(s, d, "phylum")).select("taxon", "genomes", "species", "matched_rows", "direct_matches", "taxid_matches")


@query("a9_distinct_members", """SELECT c.taxon, count(DISTINCT m.name) AS member_species, count(DISTINCT CASE WHEN m.name = c.taxon THEN m.name END) AS direct_matches FROM census_genus c JOIN members m ON m.part = c.taxon GROUP BY 1""")
def _(s, d):
    return mt.distinct_member_counts(sh.census(s, d, "genus"), sh.members(s, d))


@query("a6_isolate_share", """SELECT genus AS taxon, count(*) FILTER (genome_source = 'isolate') AS isolate_count, count(*) AS total_genomes, round_even(count(*) FILTER (genome_source = 'isolate')::DOUBLE / count(*) * 100 * 100, 0) / 100 AS isolate_percentage
 FROM assemblies GROUP BY 1 HAVING count(*) FILTER (genome_source = 'isolate') > 0""")
def _(s, d):
    return mt.isolate_shares(sh.assemblies(s, d), "genus").withColumnRenamed("genus", "taxon")


@query("a10_factors", "SELECT taxon, novelty_factor = 'inf'::DOUBLE AS infinite, CASE WHEN novelty_factor = 'inf'::DOUBLE THEN -1 ELSE novelty_factor END AS novelty, overrepresentation_factor, match_status FROM merged_family WHERE match_status <> 'ncbi_only'")
def _(s, d):
    m = sh.merged(s, d, "family").where("match_status <> 'ncbi_only'")
    inf = F.col("novelty_factor") == float("inf")
    return m.select("taxon", inf.alias("infinite"), F.when(inf, -1.0).otherwise(F.col("novelty_factor")).alias("novelty"), "overrepresentation_factor", "match_status")


@query("a11_merge_summary", """SELECT 'genus' AS level, count(*) AS total_entries, count(*) FILTER (match_status = 'matched') AS matched_taxa, count(*) FILTER (match_status = 'census_only') AS census_only_taxa,
 count(*) FILTER (match_status = 'ncbi_only') AS ncbi_only_taxa, round_even(count(*) FILTER (match_status = 'matched')::DOUBLE / count(*) * 100 * 10, 0) / 10 AS match_rate FROM merged_genus""")
def _(s, d):
    return mt.merge_summary(sh.merged(s, d), "genus", "ncbi")


MEMBERS = """SELECT c.taxon, coalesce(m.n, 0) AS eukprot_species_count, CASE WHEN c.otu_count > 0 THEN round_even(coalesce(m.n, 0)::DOUBLE / c.otu_count * 100 * 100, 0) / 100 ELSE 0 END AS coverage_percentage
 FROM census_genus c LEFT JOIN (SELECT part, count(DISTINCT name) AS n FROM members WHERE NOT regexp_matches(lower(name), 'candidat|\\.u\\.|virus|viral') GROUP BY part) m ON m.part = c.taxon WHERE NOT regexp_matches(lower(c.taxon), 'candidat|\\.u\\.|virus|viral')"""


@query("merge_members_genus", MEMBERS)
def _(s, d):
    from cladetally.plans.pipelines import merge_census_with_members
    return merge_census_with_members(sh.census(s, d, "genus"), sh.members(s, d), "genus").table.select("taxon", "eukprot_species_count", "coverage_percentage")


@query("a12_coverage_summary", f"""SELECT 'genus' AS level, count(*) AS total_taxa, count(*) FILTER (eukprot_species_count > 0) AS taxa_with_species, round_even(sum(round(coverage_percentage * 100)::BIGINT)::DOUBLE / 100 / count(*) * 10000, 0) / 10000 AS mean_coverage, median(coverage_percentage) AS median_coverage FROM ({MEMBERS}) z, (SELECT 1 FROM census_genus LIMIT 1) c0, (SELECT 1 FROM members LIMIT 1) m0""")
def _(s, d):
    from cladetally.plans.pipelines import merge_census_with_members
    out = merge_census_with_members(sh.census(s, d, "genus"), sh.members(s, d), "genus").summary
    return out.select("level", "total_taxa", "taxa_with_species", round_even("mean_coverage", 4).alias("mean_coverage"), "median_coverage")


