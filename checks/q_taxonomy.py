"""Taxonomy-tree queries on the sample tree of regions, nations, families and customers."""

from pyspark.sql import functions as F

from cladetally.functions import lineages as ln
from cladetally.operators import taxonomy as tx
from cladetally.session import materialize
from cladetally.sources.tables import shape_eukprot
from checks import shapes as sh
from checks.q_names import CLEANED, strip_sql
from checks.registry import query


def _na(c):
    return F.coalesce(F.col(c).cast("string"), F.lit("NA"))


@query("l1_build_lineages", "SELECT taxid, lineage, ranks, taxids FROM lin")
def _(s, d):
    built = tx.build_lineages(sh.nodes(s, d), sh.sci_names(s, d))
    a, b, c = ln.lineage_texts("lineage")
    return built.select("taxid", a, b.alias("ranks"), c.alias("taxids"))


@query("l2_name_to_taxid", "SELECT genus AS name, coalesce(x.taxid::VARCHAR, 'NA') AS taxid, count(*) AS n FROM assemblies LEFT JOIN lookup x ON x.name = genus GROUP BY 1, 2")
def _(s, d):
    g = sh.assemblies(s, d).groupBy(F.col("genus").alias("name")).agg(F.count("*").alias("n"))
    return tx.name_to_taxid(g, sh.names(s, d), "name").withColumn("taxid", _na("taxid"))


LADDER_18S = f"""SELECT DISTINCT v.name AS name, coalesce(a.taxid, b.taxid, c.taxid, e.taxid) AS taxid,
 CASE WHEN a.taxid IS NOT NULL THEN 'direct' WHEN b.taxid IS NOT NULL THEN 'genus_fallback' WHEN c.taxid IS NOT NULL THEN 'number_stripped' WHEN e.taxid IS NOT NULL THEN 'hyphen_part' ELSE 'none' END AS method
 FROM (SELECT name, {strip_sql("replace(name, '_', '  ')")} AS v1, {strip_sql("split_part(split_part(name, '.', 1), '_', 1)")} AS v2, {strip_sql("replace(name, '_', ' ')")} AS v3,
  CASE WHEN NOT contains(name, '-') THEN NULL WHEN suffix(name, '-lineage') THEN split_part(split_part(name, '-lineage', 1), '_', 1) WHEN contains(name, '-Group') THEN split_part(name, '-Group', 1)
  WHEN NOT contains(lower(split_part(split_part(name, '-', 2), '_', 1)), 'clade') THEN split_part(split_part(name, '-', 2), '_', 1) END AS v4 FROM src) v
 LEFT JOIN lookup a ON a.name = v1 LEFT JOIN lookup b ON b.name = v2 LEFT JOIN lookup c ON c.name = v3 LEFT JOIN lookup e ON e.name = v4"""
SRC = "(SELECT name FROM hard_names UNION SELECT c_name || '_XX' FROM customer UNION SELECT p_name FROM part)"


@query("l3_resolve_18s", f"SELECT name, coalesce(taxid::VARCHAR, 'NA') AS taxid, method FROM ({LADDER_18S.replace('FROM src', 'FROM ' + SRC)})")
def _(s, d):
    src = sh.hard_names(s, d).select("name").union(sh.t(s, d, "customer").selectExpr("concat(c_name, '_XX')")).union(
        sh.t(s, d, "part").select("p_name"))
    return tx.resolve_names(src, sh.names(s, d), "name", tx.variants_of(tx.ladder_18s("name"))).withColumn("taxid", _na("taxid"))


@query("l3_resolve_16s", f"""SELECT DISTINCT v.name AS name, coalesce(a.taxid, b.taxid, c.taxid, e.taxid)::VARCHAR AS taxid FROM (
 SELECT name, coalesce(CASE WHEN contains(name, '.Chloroplast') THEN trim(replace(split_part(name, '.Chloroplast', 1), '_', ' '))
  WHEN contains(name, '.Mitochondria') THEN trim(replace(split_part(name, '.Mitochondria', 1), '_', ' ')) END, name) AS v1, {CLEANED} AS v2,
  CASE WHEN contains(lower(name), 'uncultured') AND NOT contains(lower(name), 'metagenome') THEN
 nullif(array_to_string(list_filter(string_split(name, '_'), lambda w: NOT list_contains(['uncultured','bacterium','organism','eukaryote','sp','species'], lower(w))
  AND length(w) > 2 AND regexp_matches(w, '^[A-Z][a-z]+$'))[1:2], ' '), '') END AS v3, {strip_sql('name')} AS v4
  FROM (SELECT name FROM hard_names UNION SELECT n_name FROM nation UNION SELECT 'uncultured_' || upper(p_name[1]) || p_name[2:] FROM part)) v
 LEFT JOIN lookup a ON a.name = v1 LEFT JOIN lookup b ON b.name = v2 LEFT JOIN lookup c ON c.name = v3 LEFT JOIN lookup e ON e.name = v4
 WHERE coalesce(a.taxid, b.taxid, c.taxid, e.taxid) IS NOT NULL""")
def _(s, d):
    src = sh.hard_names(s, d).select("name").union(sh.t(s, d, "nation").select("n_name")).union(
        sh.t(s, d, "part").selectExpr("concat('uncultured_', upper(substr(p_name, 1, 1)), substr(p_name, 2))"))
    out = tx.resolve_names(src, sh.names(s, d), "name", tx.variants_of(tx.ladder_16s("name")))
    return out.where("taxid is not null").select("name", F.col("taxid").cast("string").alias("taxid"))


@query("l4_lineage_lookup", "SELECT m.taxid, coalesce(lineage, '') AS lineage, count(*) AS n FROM assemblies m LEFT JOIN lin USING (taxid) GROUP BY 1, 2")
def _(s, d):
    a = sh.assemblies(s, d).groupBy("taxid").agg(F.count("*").alias("n"))
    return tx.with_lineage(a, sh.tree(s, d)).withColumn("lineage", ln.lineage_text("lineage"))


@query("l5_rank_columns", "SELECT taxid, coalesce(superkingdom, '-') AS superkingdom, coalesce(phylum, '-') AS phylum, coalesce(family, '-') AS family, coalesce(species, '-') AS species FROM lin")
def _(s, d):
    ranks = ["superkingdom", "phylum", "family", "species"]
    return sh.tree(s, d).select("taxid", *ln.rank_columns("lineage", ranks)).fillna("-", ranks)


@query("l6_truncate", "SELECT taxid, CASE WHEN phylum IS NOT NULL THEN array_to_string(string_split(lineage, ';')[1:2], ';') ELSE lineage END AS lineage FROM lin")
def _(s, d):
    return sh.tree(s, d).select("taxid", ln.lineage_text(ln.truncate_lineage("lineage", "phylum")).alias("lineage"))


@query("l7_append_original", """SELECT name, coalesce(l.lineage || CASE WHEN regexp_matches(name, '[0-9_]|\\.U\\.') THEN ';' || name ELSE '' END, CASE WHEN regexp_matches(name, '[0-9_]|\\.U\\.') THEN name ELSE '' END) AS lineage
 FROM (SELECT DISTINCT genus AS name FROM clusters WHERE genus IS NOT NULL UNION SELECT c_name FROM customer) LEFT JOIN lookup x USING (name) LEFT JOIN lin l ON l.taxid = x.taxid""")
def _(s, d):
    n = sh.clusters(s, d).where("genus is not null").select(F.col("genus").alias("name")).union(sh.t(s, d, "customer").select("c_name")).distinct()
    full = tx.with_lineage(tx.name_to_taxid(n, sh.names(s, d), "name"), sh.tree(s, d))
    return full.select("name", ln.lineage_text(ln.append_original("lineage", "name", "taxid")).alias("lineage"))


@query("l8_drop_root", "SELECT taxid, array_to_string(string_split(lineage, ';')[2:], ';') AS lineage, string_split(ranks, ';')[2] AS first_rank FROM unmapped")
def _(s, d):
    l = sh.unmapped(s, d).withColumn("l", ln.drop_root(ln.parse_lineage("lineage", "ranks")))
    return l.select("taxid", ln.lineage_text("l").alias("lineage"), F.get("l", F.lit(0))["rank"].alias("first_rank"))


def _words(words):
    return "(" + " OR ".join(f"contains(lower(lineage), '{w}')" for w in words) + ")"


def _domain_case():
    from cladetally.functions import fixed_values as fv
    return (f"CASE WHEN {_words(fv.VIRAL_WORDS)} THEN 'Viruses' WHEN {_words(fv.EUKARYOTE_WORDS)} THEN 'Eukaryota' "
            f"WHEN {_words(fv.ARCHAEA_WORDS)} THEN 'Archaea' WHEN {_words(fv.BACTERIA_WORDS)} THEN 'Bacteria' "
            "WHEN contains(lineage, 'cellular organisms') THEN 'Bacteria' ELSE 'Unknown' END")


@query("l9_detect_domain", f"SELECT taxid, {_domain_case()} AS domain FROM unmapped UNION ALL SELECT taxid, superkingdom FROM lin")
def _(s, d):
    u = sh.unmapped(s, d).select("taxid", ln.parse_lineage("lineage", F.replace("ranks", F.lit("domain"), F.lit("no rank"))).alias("lineage"))
    return u.union(sh.tree(s, d)).select("taxid", ln.detect_domain("lineage").alias("domain"))


@query("l10_taxid_rank_map", """SELECT DISTINCT a.taxid, coalesce(l.family, '-') AS family, coalesce(superkingdom, '-') AS domain,
 CASE WHEN l.taxid IS NULL THEN 'No lineage found' WHEN l.family IS NULL THEN 'No family found in lineage' ELSE '-' END AS reason FROM assemblies a LEFT JOIN lin l USING (taxid)""")
def _(s, d):
    mapped, lost = tx.map_taxids_to_rank(sh.assemblies(s, d), sh.tree(s, d), "family")
    return mapped.select("taxid", "family", "domain", F.lit("-").alias("reason")).union(
        lost.select("taxid", F.lit("-"), F.lit("-"), "reason"))


@query("l11_subfamily_fallback", """SELECT DISTINCT a.taxid, CASE WHEN a.taxid % 2 = 0 THEN l.family ELSE l.phylum END AS family FROM assemblies a JOIN lin l USING (taxid) WHERE species IS NOT NULL""")
def _(s, d):
    # half of the leaves carry a family, the other half a subfamily named after their phylum
    def rename(x, taxid):
        return F.struct(x["taxid"].alias("taxid"),
                        F.when((x["rank"] == "family") & (taxid % 2 == 1), F.lit("tribe"))
                        .when((x["rank"] == "phylum") & (taxid % 2 == 1), F.lit("subfamily")).otherwise(x["rank"]).alias("rank"),
                        x["name"].alias("name"))
    tree = sh.tree(s, d).withColumn("lineage", F.transform("lineage", lambda x: rename(x, F.col("taxid"))))
    return tx.map_taxids_to_rank(sh.assemblies(s, d), tree, "family", subfamily_fallback=True)[0].select("taxid", "family")


@query("l12_two_catalogues", """SELECT name, coalesce(a.taxid, b.taxid)::VARCHAR AS taxid, CASE WHEN a.taxid IS NOT NULL THEN 'first' WHEN b.taxid IS NOT NULL THEN 'second' ELSE 'none' END AS taxid_source FROM (
 SELECT DISTINCT p_name AS name FROM part UNION SELECT c_name FROM customer) LEFT JOIN (SELECT p_name AS name, min(p_partkey) AS taxid FROM part WHERE p_size > 25 GROUP BY 1) a USING (name)
 LEFT JOIN lookup b USING (name)""")
def _(s, d):
    part = sh.t(s, d, "part")
    src = part.selectExpr("p_name name").union(sh.t(s, d, "customer").select("c_name")).distinct()
    first = part.where("p_size > 25").selectExpr("p_partkey taxid", "p_name name")
    out = tx.resolve_with_fallback(src, "name", [("first", first), ("second", sh.names(s, d))])
    return out.withColumn("taxid", F.col("taxid").cast("string"))


@query("l13_merge_by_last_taxid", """SELECT family, domain, sum(n)::BIGINT AS family_counts, taxid FROM (SELECT f.a_name AS family, l.superkingdom AS domain, f.a_taxid::VARCHAR AS taxid, n FROM (
 SELECT taxid, count(*) AS n FROM assemblies GROUP BY taxid) a JOIN lin l USING (taxid) JOIN tree f ON f.taxid = a.taxid AND f.a_rank = 'family') GROUP BY 1, 2, 4
 UNION ALL SELECT 'T' || a.taxid, 'none', count(*), 'NA' FROM assemblies a WHERE a.taxid NOT IN (SELECT taxid FROM lin) GROUP BY 1""")
def _(s, d):
    n = sh.assemblies(s, d).groupBy("taxid").agg(F.count("*").alias("family_counts"))
    full = n.join(sh.tree(s, d), "taxid", "left").select(
        F.coalesce(ln.name_at_rank("lineage", "family"), F.concat(F.lit("T"), F.col("taxid"))).alias("family"),
        F.coalesce(ln.name_at_rank("lineage", "superkingdom"), F.lit("none")).alias("domain"),
        "family_counts", ln.truncate_lineage("lineage", "family").alias("lineage"))
    return tx.merge_by_last_taxid(full, "family", "family_counts").select("family", "domain", "family_counts", _na("taxid").alias("taxid"))


@query("l14_ancestor_rescue", """SELECT name_to_use, taxid, match_type, tail FROM (
 SELECT name_to_use, nation_taxid::BIGINT AS taxid, 'hierarchical_phylum' AS match_type, 'Nothing;Deeper;' || name_to_use AS tail FROM eukprot WHERE kind = 4
 UNION ALL SELECT name_to_use, x.taxid, 'hierarchical_family', tail FROM (SELECT name_to_use, split_part(split_part(taxonomy, ';', 4), ';', 1) AS fam, trim(split_part(taxonomy, ';', 5), '''') || ';' || name_to_use AS tail
  FROM eukprot WHERE kind NOT IN (4, 5, 1)) JOIN lookup x ON x.name = fam
 UNION ALL SELECT n, taxid, 'hierarchical_family', tail FROM (SELECT name_to_use AS n, x.taxid, trim(split_part(taxonomy, ';', 5), '''') || ';' || name_to_use AS tail FROM eukprot JOIN lookup x ON x.name = split_part(taxonomy, ';', 4) WHERE kind = 1))""")
def _(s, d):
    meta = shape_eukprot(sh.eukprot_raw(s, d))
    out = tx.rescue_by_ancestor(meta, sh.names(s, d), sh.nodes(s, d), "name_to_use", "taxonomy")
    return out.withColumn("tail", F.array_join("tail", ";"))


@query("l15_species_taxid", """SELECT a.taxid, CASE WHEN a.species_taxid IS NOT NULL THEN a.species_taxid ELSE a.taxid END AS species_taxid, count(*) AS n FROM assemblies a GROUP BY 1, 2""")
def _(s, d):
    return tx.with_species_taxid(sh.assemblies(s, d), sh.tree(s, d)).groupBy("taxid", "species_taxid").agg(F.count("*").alias("n"))


@query("l16_rank_of_taxid", """SELECT DISTINCT a.taxid, coalesce(n.rank, '-') AS node_rank, CASE WHEN n.rank IS NULL THEN 'missing' WHEN n.rank <> 'species' THEN 'mismatch' ELSE 'verified' END AS rank_status
 FROM (SELECT taxid FROM assemblies UNION SELECT taxid FROM names_all) a LEFT JOIN nodes n USING (taxid)""")
def _(s, d):
    ids = sh.assemblies(s, d).select("taxid").union(sh.names(s, d).select("taxid")).distinct()
    return tx.rank_of(ids, sh.nodes(s, d), expected="species").withColumn("node_rank", F.coalesce("node_rank", F.lit("-")))


EUK = """SELECT name_to_use, CASE kind WHEN 0 THEN own_taxid WHEN 1 THEN nation_taxid WHEN 2 THEN own_taxid WHEN 3 THEN nation_taxid WHEN 4 THEN nation_taxid END AS taxid,
 CASE kind WHEN 0 THEN 'full' WHEN 1 THEN 'genus' WHEN 2 THEN 'previous_name' WHEN 3 THEN 'previous_name_genus' WHEN 4 THEN 'hierarchical_phylum' ELSE 'none' END AS match_type, kind FROM eukprot"""


@query("l17_resolve_eukprot", f"SELECT name_to_use, coalesce(taxid::VARCHAR, 'NA') AS taxid, match_type FROM ({EUK.replace('FROM eukprot', 'FROM  eukprot')}) z, (SELECT count(*) FROM eukprot) q")
def _(s, d):
    meta = shape_eukprot(sh.eukprot_raw(s, d))
    return tx.resolve_eukprot(meta, sh.names(s, d), sh.nodes(s, d)).select("name_to_use", _na("taxid").alias("taxid"), "match_type")


@query("l18_extend_lineage", f"""SELECT e.name_to_use, coalesce(l.lineage, '') || CASE WHEN match_type IN ('genus', 'previous_name_genus') THEN ';' || e.name_to_use WHEN kind = 4 THEN ';Nothing;Deeper;' || e.name_to_use ELSE '' END AS lineage
 FROM (SELECT name_to_use, CASE kind WHEN 0 THEN own_taxid WHEN 1 THEN nation_taxid WHEN 2 THEN own_taxid WHEN 3 THEN nation_taxid WHEN 4 THEN nation_taxid END AS taxid,
 CASE kind WHEN 1 THEN 'genus' WHEN 3 THEN 'previous_name_genus' ELSE '-' END AS match_type, kind FROM eukprot) e LEFT JOIN lin l USING (taxid)""")
def _(s, d):
    from cladetally.plans.pipelines import eukprot_lineages
    meta = shape_eukprot(sh.eukprot_raw(s, d))
    return eukprot_lineages(meta, sh.names(s, d), sh.nodes(s, d), sh.tree(s, d)).select("name_to_use", ln.lineage_text("lineage").alias("lineage"))


@query("l20_repair_phylum", """SELECT taxid, phylum, domain, method AS mapping_method FROM (SELECT taxid, lineage, r,
 CASE WHEN r = 'clade' AND p = 'sar' THEN 'SAR' WHEN r = 'clade' AND p = 'fungi' THEN 'Fungi' WHEN r = 'clade' AND p = 'metazoa' THEN 'Metazoa' WHEN r = 'clade' AND p = 'stramenopiles' THEN 'Stramenopiles'
  WHEN b AND r IN ('class', 'clade') AND p = 'alphaproteobacteria' THEN 'Pseudomonadota' WHEN b AND r IN ('class', 'clade') AND p = 'actinobacteria' THEN 'Actinobacteriota'
  WHEN e AND r = 'class' AND (contains(p, 'phyceae') OR contains(p, 'mycetes') OR contains(p, 'zoa')) THEN p END AS phylum,
 CASE WHEN r = 'clade' AND p IN ('sar', 'fungi', 'metazoa', 'stramenopiles') THEN 'clade_mapping_' || p
  WHEN b AND r IN ('class', 'clade') AND p IN ('alphaproteobacteria', 'actinobacteria') THEN 'bacterial_mapping_' || p WHEN e AND r = 'class' THEN 'class_as_phylum' END AS method,
 CASE WHEN r = 'clade' AND p IN ('sar', 'fungi', 'metazoa', 'stramenopiles') THEN CASE WHEN e THEN 'Eukaryota' WHEN b THEN 'Bacteria' WHEN contains(lower(lineage), 'archaea') THEN 'Archaea' WHEN contains(lower(lineage), 'virus') THEN 'Viruses' ELSE 'Unknown' END
  WHEN b AND p IN ('alphaproteobacteria', 'actinobacteria') THEN 'Bacteria' ELSE 'Eukaryota' END AS domain
 FROM (SELECT taxid, lineage, split_part(ranks, ';', 3) AS r, lower(split_part(lineage, ';', 3)) AS p, contains(lower(lineage), 'bacteria') AS b, contains(lower(lineage), 'eukaryota') AS e FROM unmapped)) WHERE phylum IS NOT NULL""")
def _(s, d):
    return tx.repair_phylum(sh.unmapped(s, d)).select("taxid", "phylum", "domain", "mapping_method")


@query("l20_incertae_parent", """SELECT taxid, phylum, method AS mapping_method FROM (SELECT taxid,
 CASE WHEN r = 'clade' AND p = 'sar' THEN 'SAR' WHEN r = 'clade' AND p = 'fungi' THEN 'Fungi' WHEN r = 'clade' AND p = 'metazoa' THEN 'Metazoa' WHEN r = 'clade' AND p = 'stramenopiles' THEN 'Stramenopiles'
  WHEN b AND r IN ('class', 'clade') AND p = 'alphaproteobacteria' THEN 'Pseudomonadota' WHEN b AND r IN ('class', 'clade') AND p = 'actinobacteria' THEN 'Actinobacteriota'
  WHEN r IN ('class', 'order') AND p <> 'incertae sedis' THEN 'Unclassified_' || p END AS phylum,
 CASE WHEN r = 'clade' AND p IN ('sar', 'fungi', 'metazoa', 'stramenopiles') THEN 'clade_mapping_' || p
  WHEN b AND r IN ('class', 'clade') AND p IN ('alphaproteobacteria', 'actinobacteria') THEN 'bacterial_mapping_' || p ELSE 'incertae_sedis_parent' END AS method
 FROM (SELECT taxid, split_part(ranks, ';', 3) AS r, lower(split_part(lineage, ';', 3)) AS p, contains(lower(lineage), 'bacteria') AS b FROM unmapped)) WHERE phylum IS NOT NULL""")
def _(s, d):
    # every lineage gains an incertae sedis leaf, so the parent rule takes what the rules before it leave
    u = sh.unmapped(s, d).withColumn("lineage", F.concat("lineage", F.lit(" incertae sedis")))
    return tx.repair_phylum(u).select("taxid", "phylum", "mapping_method")


@query("l21_build_hierarchy", """SELECT level, name, phylum FROM (SELECT 'phylum' AS level, a_name AS name, a_name AS phylum FROM tree WHERE rank = 'phylum' AND a_rank = 'phylum'
 UNION ALL SELECT 'family', name, coalesce(max(a_name) FILTER (a_rank = 'phylum'), '-') FROM tree WHERE rank = 'family' GROUP BY name
 UNION ALL SELECT 'genus', name, coalesce(max(a_name) FILTER (a_rank = 'phylum'), '-') FROM tree WHERE rank = 'species' GROUP BY taxid, name)""")
def _(s, d):
    tree = materialize(sh.tree(s, d))
    node = F.try_element_at("lineage", F.lit(-1))

    def level(rank):
        return tree.where(node["rank"] == rank).select(node["name"].alias("name"), F.col("taxid").alias("order_no"), "lineage")
    out = tx.build_hierarchy(level("phylum"), level("family"), level("species"))
    return out.select("level", "name", F.coalesce("phylum", F.lit("-")).alias("phylum"))


@query("l22_rank_fallback", "SELECT taxid, coalesce(phylum, '-') AS division, coalesce(family, phylum, '-') AS family FROM lin")
def _(s, d):
    return sh.tree(s, d).select("taxid", F.coalesce(ln.rank_or_fallback("lineage", "division"), F.lit("-")).alias("division"),
                                F.coalesce(ln.rank_or_fallback("lineage", "family"), F.lit("-")).alias("family"))




# Ratio of matching blocks of candidate pairs: the longest common stretch (the first of a, then of b), then those on both
# sides of it. A pair above the threshold differs by few letters, and so by no more single edits; these are counted in
# bytes here, of which the letters of the sample tables have two at most.
NEAR = r"""{probes}, {entries},
 pairs AS (SELECT a, b, CASE WHEN len(a) > 5 THEN 85 ELSE 90 END AS t FROM probes JOIN entries ON len(a) >= 3 AND len(b) >= 3
  AND levenshtein(a, b) <= (1 + (strlen(a) > len(a) OR strlen(b) > len(b))::INT) * (((100 - CASE WHEN len(a) > 5 THEN 85 ELSE 90 END) * (len(a) + len(b)) - 1) // 100)),
 segments(a, b, s, t, best) AS (SELECT a, b, a, b, {best} FROM (SELECT a, b, a AS s, b AS t FROM pairs)
  UNION ALL SELECT a, b, s, t, {best} FROM (SELECT a, b, unnest([s[1:-best.i - 1], s[-best.i + best.k:]]) AS s,
   unnest([t[1:strpos(t, s[-best.i:-best.i + best.k - 1]) - 1], t[strpos(t, s[-best.i:-best.i + best.k - 1]) + best.k:]]) AS t
   FROM segments WHERE best.k > 0) WHERE s <> '' AND t <> ''),
 scored AS (SELECT a, b, 2.0::DOUBLE * sum(coalesce(best.k, 0)) / (len(a) + len(b)) AS score FROM segments GROUP BY a, b),
 near AS (SELECT a, b, score FROM (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM scored
  WHERE score > CASE WHEN len(a) > 5 THEN 0.85::DOUBLE ELSE 0.9::DOUBLE END) WHERE rn = 1)""".replace(
    "{best}", "list_max(flatten([[{'k': k, 'i': -i} for k in range(1, len(s) - i + 2) if contains(t, s[i:i + k - 1])] for i in range(1, len(s) + 1)]))")


def _near_sql(probes, entries):
    return NEAR.replace("{probes}", f"probes AS ({probes})").replace("{entries}", f"entries AS ({entries})")


def _words(s, d, table, col):
    """Distinct lower-case words of whole texts."""
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    return sh.t(s, d, table).select(words.alias(col)).where(F.length(col) > 0).distinct()


def _words_sql(table, col):
    return f"SELECT DISTINCT w AS {col} FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS w FROM {table}) WHERE w <> ''"


@query("l19_near_names", "WITH RECURSIVE " + _near_sql(_words_sql("conversations", "a") + " AND w NOT IN (" + _words_sql("benchmark", "b") + ")", _words_sql("benchmark", "b"))
       + " SELECT a, b, score FROM near")
def _(s, d):
    from cladetally.operators.fuzzy import near_names
    entries = _words(s, d, "benchmark", "b")
    probes = _words(s, d, "conversations", "a").join(entries, F.col("a") == F.col("b"), "left_anti")
    return near_names(probes, entries)


# Customers' families as they are, with a hyphen, with the ending of a plural, with a letter more, with a letter changed,
# and with two letters swapped; the parts' types match nothing.
PLANTED = """concat('Fam', c_nationkey, 'x', c_custkey % 7)"""
PLANTED_FORMS = """CASE c_custkey % 6 WHEN 0 THEN upper(f) WHEN 1 THEN concat('Fam-', substr(f, 4)) WHEN 2 THEN concat('Fam ', substr(f, 4))
 WHEN 3 THEN concat(f, 'q') WHEN 4 THEN concat('G', substr(f, 2)) ELSE concat('Fma', substr(f, 4)) END"""


@query("l19_fuzzy_match", "WITH RECURSIVE src AS (SELECT DISTINCT " + PLANTED_FORMS + " AS name FROM (SELECT c_custkey, " + PLANTED + """ AS f FROM customer) UNION SELECT DISTINCT p_type FROM part),
 known AS (SELECT lower(name) AS b, min(taxid) AS taxid FROM names_all WHERE taxid BETWEEN 200 AND 399 GROUP BY 1),
 spelled AS (SELECT a, arg_min(b, pos) AS b, min(pos) AS pos FROM (SELECT DISTINCT lower(name) AS a, unnest([lower(name), replace(lower(name), '-', ''), replace(lower(name), '_', ''),
  replace(lower(name), ' ', ''), regexp_replace(lower(name), '[^a-z0-9]', '', 'g')]) AS v, unnest([0, 1, 2, 3, 4]) AS pos FROM src) JOIN known ON v = b GROUP BY a),
 """ + _near_sql("SELECT DISTINCT lower(name) AS a FROM src WHERE lower(name) NOT IN (SELECT a FROM spelled)", "SELECT b FROM known") + """
 SELECT s.name AS taxon, CASE WHEN p.pos = 0 THEN 'exact' WHEN p.pos > 0 THEN 'variant' WHEN n.a IS NOT NULL THEN 'fuzzy' ELSE 'unmapped' END AS match_type,
  coalesce(coalesce(k.taxid, m.taxid)::VARCHAR, 'NA') AS taxid, CASE WHEN p.pos = 0 THEN 1.0 WHEN p.pos > 0 THEN 0.9 ELSE coalesce(n.score, 0.0) END AS match_score
 FROM src s LEFT JOIN spelled p ON p.a = lower(s.name) LEFT JOIN known k ON k.b = p.b LEFT JOIN near n ON n.a = lower(s.name) LEFT JOIN known m ON m.b = n.b""")
def _(s, d):
    from cladetally.operators.fuzzy import fuzzy_match
    src = sh.t(s, d, "customer").selectExpr("c_custkey", f"{PLANTED} f").selectExpr(f"{PLANTED_FORMS} taxon").union(
        sh.t(s, d, "part").select("p_type")).distinct()
    node = "named_struct('taxid', 2759L, 'rank', 'superkingdom', 'name', 'Eukaryota')"
    euk = materialize(sh.tree(s, d)).withColumn("lineage", F.expr(f"concat(array({node}), lineage)"))
    out = fuzzy_match(src, sh.names(s, d), sh.nodes(s, d), euk, "taxon", "family")
    return out.select("taxon", "match_type", F.coalesce(F.col("taxid").cast("string"), F.lit("NA")).alias("taxid"), "match_score")


# Node t of the sample tree with all its ancestors, itself included, and the path from the root.
ABOVE = """above(taxid, anc, path) AS (SELECT taxid, taxid, [taxid] FROM nodes UNION ALL SELECT a.taxid, p.taxid, [p.taxid] || a.path
 FROM above a JOIN nodes n ON n.taxid = a.anc JOIN nodes p ON p.taxid = n.parent AND p.taxid <> n.taxid)"""


@query("l1_tree_intervals", "WITH RECURSIVE " + ABOVE + """, paths AS (SELECT taxid, arg_max(path, len(path)) AS path FROM above GROUP BY taxid),
 numbered AS (SELECT taxid, row_number() OVER (ORDER BY path) - 1 AS pre FROM paths)
 SELECT taxid, pre, pre + (SELECT count(*) FROM above a WHERE a.anc = n.taxid) AS "end" FROM numbered n""")
def _(s, d):
    from cladetally.operators.subtrees import tree_intervals
    return tree_intervals(sh.nodes(s, d))


@query("a8_subtree_totals", "WITH RECURSIVE " + ABOVE + """ SELECT c.taxon, c.taxid, coalesce(sum(k.genomes), 0)::BIGINT AS genomes, coalesce(sum(k.species), 0)::BIGINT AS species, count(k.taxid) AS matched_rows
 FROM (SELECT DISTINCT m.name AS taxon, n.taxid FROM nodes n JOIN sci m USING (taxid)) c LEFT JOIN above a ON a.anc = c.taxid LEFT JOIN
 (SELECT CASE WHEN taxid % 3 = 0 THEN 200 + taxid % 200 ELSE taxid END AS taxid, genomes, species FROM cat_genus WHERE taxid IS NOT NULL) k ON k.taxid = a.taxid GROUP BY 1, 2""")
def _(s, d):
    # catalogue rows below every taxid; a third of them is moved up to families
    from cladetally.operators import subtrees as sb, taxonomy as tx
    moved = F.when(F.col("taxid") % 3 == 0, 200 + F.col("taxid") % 200).otherwise(F.col("taxid"))
    cat = sh.catalogue(s, d, "genus").where("taxid is not null").select(moved.alias("taxid"), "genomes", "species", F.lit(1).alias("matched_rows"))
    totals = sb.subtree_totals(sb.tree_intervals(sh.nodes(s, d)), cat, ["genomes", "species", "matched_rows"])
    names = sh.sci_names(s, d).select(F.col("name").alias("taxon"), "taxid").distinct()
    return names.join(totals, "taxid").select("taxon", "taxid", "genomes", "species", "matched_rows")
