"""The sample tables read as the domain tables, for Spark (functions) and DuckDB (CTE texts).

Both sides state the same mapping independently. Spark functions are lazy projections and joins
over the whole tables: no row is left out. Taxa, accessions and taxids that only one side has come from
renaming: some genera end in ` cat` in the catalogue and in ` env` in the census, some accessions and
mapped taxids are lifted into a range of their own.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from cladetally.functions import lineages as ln


_SCHEMAS: dict = {}


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A sample table; its schema is read from the file once."""
    path = f"{d}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _lineitem_part(spark, d):
    # Shuffled, never broadcast: the file of parts is many times smaller than its rows, which would pass through the driver at each use.
    return t(spark, d, "lineitem").join(t(spark, d, "part").hint("shuffle_hash"), F.expr("l_partkey = p_partkey"))


def assemblies(spark, d) -> DataFrame:
    return _lineitem_part(spark, d).selectExpr(
        "concat('GCA_', lpad(cast(l_orderkey as string), 9, '0'), '.', l_linenumber) as assembly_accession",
        "1000 + l_partkey as taxid",
        "case when l_linenumber = 7 then null else 1000 + l_partkey div 2 end as species_taxid",
        "case l_returnflag when 'A' then p_name when 'N' then concat('uncultured ', p_name) "
        "else concat(p_name, ' strain ', l_suppkey) end as organism_name",
        "case l_linenumber when 1 then 'Complete Genome' when 2 then 'Chromosome' when 3 then 'Scaffold' "
        "when 4 then 'Contig' else 'Other' end as assembly_level",
        "case l_returnflag when 'A' then concat('iso', l_suppkey) when 'N' then null "
        "else case when l_linenumber > 4 then 'Missing ' else '' end end as isolate",
        "case when l_linenumber = 5 then 'derived from metagenome' when l_linenumber = 6 then 'genus undefined' end "
        "as excluded_from_refseq",
        "cast(floor(l_extendedprice) as bigint) * 1000 as genome_size",
        "cast(round(l_discount * 100) as double) as gc_percent",
        "cast(l_shipdate as date) as seq_rel_date",
        "p_type as domain", "p_brand as phylum", "substring_index(p_name, ' ', 1) as family",
        "case when p_size % 10 = 3 then concat(p_name, ' cat') else p_name end as genus",
        "case when l_returnflag = 'A' then 'isolate' else 'uncultured' end as genome_source",
    )


def clusters(spark, d) -> DataFrame:
    return _lineitem_part(spark, d).selectExpr(
        "concat(l_orderkey, '-', l_linenumber) as centroid",
        "concat('m', l_suppkey) as members",
        "case when l_linenumber = 7 then null else cast(l_quantity as bigint) end as size",
        "case when p_size % 13 = 0 then concat(p_brand, '.U.division') else p_brand end as division",
        "case when p_size % 11 = 0 then concat(substring_index(p_name, ' ', 1), '.U.family') "
        "else substring_index(p_name, ' ', 1) end as family",
        "case when p_size % 7 = 0 then concat(substring_index(p_name, ' ', 1), '.U.genus') "
        "when p_size = 1 then null when p_size % 10 = 4 then concat(p_name, ' env') else p_name end as genus",
    )


def clusters_16s(spark, d) -> DataFrame:
    return clusters(spark, d).withColumnRenamed("division", "phylum")


def nodes(spark, d) -> DataFrame:
    region = t(spark, d, "region").selectExpr("cast(10 + r_regionkey as bigint) taxid", "1L parent", "'superkingdom' rank")
    nation = t(spark, d, "nation").selectExpr(
        "cast(100 + n_nationkey as bigint) taxid", "cast(10 + n_regionkey as bigint) parent", "'phylum' rank")
    family = t(spark, d, "customer").selectExpr(
        "cast(200 + c_nationkey * 7 + c_custkey % 7 as bigint) taxid",
        "cast(100 + c_nationkey as bigint) parent", "'family' rank").distinct()
    species = t(spark, d, "customer").selectExpr(
        "1000 + c_custkey as taxid", "cast(200 + c_nationkey * 7 + c_custkey % 7 as bigint) parent", "'species' rank")
    root = t(spark, d, "region").where("r_regionkey = 0").selectExpr("1L taxid", "1L parent", "'no rank' rank")
    return root.union(region).union(nation).union(family).union(species)


def names_all(spark, d) -> DataFrame:
    region = t(spark, d, "region").selectExpr("cast(10 + r_regionkey as bigint) taxid", "r_name name", "'scientific name' name_class")
    nation = t(spark, d, "nation").selectExpr(
        "cast(100 + n_nationkey as bigint) taxid", "replace(n_name, '_', '') name", "'scientific name' name_class")
    family = t(spark, d, "customer").selectExpr(
        "cast(200 + c_nationkey * 7 + c_custkey % 7 as bigint) taxid",
        "concat('Fam', c_nationkey, 'x', c_custkey % 7) name", "'scientific name' name_class").distinct()
    species = t(spark, d, "customer").selectExpr("1000 + c_custkey taxid", "c_name name", "'scientific name' name_class")
    part = t(spark, d, "part").selectExpr("1000 + p_partkey taxid", "p_name name", "'common name' name_class")
    brand = t(spark, d, "part").selectExpr("cast(100 + p_partkey % 25 as bigint) taxid", "p_brand name", "'common name' name_class")
    return region.union(nation).union(family).union(species).union(part).union(brand)


def names(spark, d) -> DataFrame:
    return names_all(spark, d).select("taxid", "name")


def sci_names(spark, d) -> DataFrame:
    return names_all(spark, d).where("name_class = 'scientific name'").select("taxid", "name")


def tree(spark, d) -> DataFrame:
    """Lineages of the sample tree by joins on its known depth (the recursive build is its own query)."""
    n, s = nodes(spark, d), sci_names(spark, d)
    lab = n.join(s, "taxid").select("taxid", "parent", F.struct("taxid", "rank", "name").alias("node"))
    l1 = lab.where("parent = 1").select("taxid", F.array("node").alias("lineage"))
    out, cur = l1, l1
    for _ in range(3):
        up = cur.select(F.col("taxid").alias("parent"), F.col("lineage").alias("_l"))
        cur = lab.join(up, "parent").select("taxid", F.array_append("_l", F.col("node")).alias("lineage"))
        out = out.union(cur)
    return out.select("taxid", F.col("lineage").cast(ln.LINEAGE_TYPE).alias("lineage"))


def tree_stored(spark, d) -> DataFrame:
    """The lineage table as pipelines get it: written once, read often."""
    from cladetally.session import materialize

    return materialize(tree(spark, d))


def names_stored(spark, d) -> DataFrame:
    from cladetally.session import materialize

    return materialize(names(spark, d))


def gtdb_taxonomy(spark, d) -> DataFrame:
    return t(spark, d, "orders").join(t(spark, d, "customer"), F.expr("o_custkey = c_custkey")).selectExpr(
        "concat(case when o_orderkey % 2 = 0 then 'RS_GCF_' else 'GB_GCA_' end, lpad(cast(o_orderkey as string), 9, '0'), '.1') accession",
        "concat('d__', case when o_orderstatus = 'F' then 'Archaea' else 'Bacteria' end, "
        "';p__', c_mktsegment, case when o_orderpriority like '1%' then '_A' else '' end, "
        "';c__C', c_nationkey % 5, ';o__O', c_nationkey, "
        "case when o_custkey % 11 = 0 then '' else concat(';f__F', c_nationkey, case when o_custkey % 3 = 0 then '_B' else '' end) end, "
        "';g__G', o_custkey % 50, case when o_custkey % 4 = 0 then '_C' else '' end, "
        "';s__G', o_custkey % 50, ' sp', o_custkey) taxonomy",
    )


def acc_a(spark, d) -> DataFrame:
    return t(spark, d, "orders").selectExpr(
        "cast(case when o_totalprice > 50000 then o_orderkey else 1000000000000 + o_orderkey end as string) accession_clean",
        "case when o_totalprice > 420000 then concat('Lonely', o_orderkey % 3) "
        "when o_orderstatus = 'F' then concat(o_orderpriority, '_A') else o_orderpriority end taxon",
        "case when o_orderstatus = 'P' then 'Eukaryota' when o_orderkey % 2 = 0 then 'Bacteria' else 'Archaea' end domain",
    )


def acc_b(spark, d) -> DataFrame:
    return t(spark, d, "orders").join(t(spark, d, "customer"), F.expr("o_custkey = c_custkey")).selectExpr(
        "cast(case when o_totalprice < 400000 then o_orderkey else 2000000000000 + o_orderkey end as string) accession_clean",
        "case when o_orderpriority like '5%' then lower(o_orderpriority) else c_mktsegment end taxon",
        "case when o_orderkey % 2 = 0 then 'Bacteria' else 'Archaea' end domain",
    )


def counts_a(spark, d) -> DataFrame:
    return acc_a(spark, d).groupBy("taxon", "domain").agg(
        F.count("*").alias("genomes"), F.countDistinct(F.expr("cast(accession_clean as bigint) div 3")).alias("species"))


def counts_b(spark, d) -> DataFrame:
    return acc_b(spark, d).groupBy("taxon", "domain").agg(
        F.count("*").alias("genomes"), F.countDistinct(F.expr("cast(accession_clean as bigint) div 3")).alias("species"))


def eukprot_raw(spark, d) -> DataFrame:
    return t(spark, d, "customer").join(t(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).join(
        t(spark, d, "region"), F.expr("n_regionkey = r_regionkey")).selectExpr(
        "concat('EP', lpad(cast(c_custkey as string), 9, '0')) as EukProt_ID",
        "case c_custkey % 6 when 0 then c_name when 1 then concat(replace(n_name, '_', ''), '_sp_', c_custkey) "
        "else concat('Xenus_', c_custkey) end as Name_to_Use",
        "case c_custkey % 6 when 2 then concat('Foo_bar, ', c_name) when 3 then concat('Foo_bar, ', replace(n_name, '_', ''), '_sp') end "
        "as Previous_Names",
        "case when c_custkey % 6 = 4 then concat('Eukaryota;', r_name, ';', replace(n_name, '_', ''), ';Nothing;Deeper') "
        "when c_custkey % 6 = 5 then 'Eukaryota;Nowhere' "
        "else concat('Eukaryota;', r_name, ';', replace(n_name, '_', ''), ';Fam', c_nationkey, 'x', c_custkey % 7, ';''Gen', c_mktsegment, '''') end "
        "as Taxonomy_UniEuk",
    )


def unmapped(spark, d) -> DataFrame:
    return t(spark, d, "part").selectExpr(
        "1000 + p_partkey as taxid",
        "1000 + p_partkey div 2 as species_taxid",
        "case p_partkey % 4 when 0 then 'No family found' when 1 then 'Multiple families' when 2 then 'family not in lineage' else 'incertae sedis' end as reason",
        "concat_ws(';', 'cellular organisms', "
        "case p_size % 5 when 0 then 'Bacteria' when 1 then 'Eukaryota' when 2 then 'Archaea' when 3 then 'Viruses' else 'metagenomes' end, "
        "case p_partkey % 13 when 0 then 'unclassified Bacteria' when 1 then 'environmental samples' when 2 then 'SAR' "
        "when 3 then 'Opisthokonta' when 4 then 'Alphaproteobacteria' when 5 then 'Ascomycetes' when 6 then 'Bacillota' "
        "when 7 then 'Fungi' when 8 then 'Metazoa' when 9 then 'incertae sedis' when 10 then 'Stramenopiles' "
        "when 11 then 'Chlorophyceae' else 'Actinobacteria' end, p_name) as lineage",
        "concat_ws(';', 'cellular root', 'domain', "
        "case p_partkey % 4 when 0 then 'clade' when 1 then 'class' when 2 then 'order' else 'no rank' end, 'species') as ranks",
    )


def catalogue(spark, d, rank: str) -> DataFrame:
    """Counts of a rank with a `;` lineage, from the assemblies."""
    a = assemblies(spark, d)
    key = {"phylum": "phylum", "family": "family", "genus": "genus"}[rank]
    parts = {
        "phylum": F.concat_ws(";", "domain", "phylum"),
        "family": F.concat_ws(";", "domain", F.min("phylum"), "family"),
        "genus": F.concat_ws(";", "domain", F.min("phylum"), F.min("family"), "genus"),
    }[rank]
    return a.groupBy("domain", key).agg(
        F.count("*").alias("genomes"), F.countDistinct("species_taxid").alias("species"),
        F.min("taxid").alias("taxid"), parts.alias("lineage"),
    ).withColumnRenamed(key, "taxon")


def catalogue_full(spark, d, rank: str) -> DataFrame:
    from cladetally.operators import matching as mt

    return mt.with_isolates(mt.catalogue_with_parts(catalogue(spark, d, rank)), assemblies(spark, d), rank)


def census(spark, d, rank: str) -> DataFrame:
    from cladetally.operators import census as ce

    col = "division" if rank == "phylum" else rank
    base = ce.census_by_rank(clusters(spark, d), col, "18s")
    shared = ce.with_database_shares(base, base)
    taxids = t(spark, d, "part").groupBy(
        F.expr({"phylum": "p_brand", "family": "substring_index(p_name, ' ', 1)", "genus": "p_name"}[rank]).alias("taxon")
    ).agg(F.expr("1000 + max(p_partkey)").alias("taxid"))
    return shared.join(taxids, "taxon", "left")


def members(spark, d) -> DataFrame:
    return t(spark, d, "part").selectExpr(
        "concat(p_name, ' ', p_size) as name",
        "array_distinct(split(concat_ws(';', p_type, p_brand, substring_index(p_name, ' ', 1), p_name), ';')) as parts",
    )


def stored(spark, d, rank: str):
    """Census and catalogue of a rank as stored tables, the form the mergers read."""
    from cladetally.session import materialize

    return materialize(census(spark, d, rank)), materialize(catalogue_full(spark, d, rank))


def merged(spark, d, rank: str = "genus") -> DataFrame:
    from cladetally.operators import matching as mt
    from cladetally.session import materialize

    return materialize(mt.merge_with_catalogue(*stored(spark, d, rank), "ncbi"))


def rank_map(spark, d, rank: str) -> DataFrame:
    col = {"phylum": "p_brand", "family": "substring_index(p_name, ' ', 1)", "genus": "p_name"}[rank]
    return t(spark, d, "part").selectExpr(
        "case when p_size > 5 then 1000 + p_partkey else 1000000000000 + p_partkey end as taxid", f"{col} as {rank}", "p_type as domain")


# --- the same shapes for DuckDB -------------------------------------------------------------------------
CTE = {
    "assemblies": """SELECT 'GCA_' || lpad(l_orderkey::VARCHAR, 9, '0') || '.' || l_linenumber AS assembly_accession,
  1000 + l_partkey AS taxid,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE 1000 + l_partkey // 2 END AS species_taxid,
  CASE l_returnflag WHEN 'A' THEN p_name WHEN 'N' THEN 'uncultured ' || p_name
    ELSE p_name || ' strain ' || l_suppkey END AS organism_name,
  CASE l_linenumber WHEN 1 THEN 'Complete Genome' WHEN 2 THEN 'Chromosome' WHEN 3 THEN 'Scaffold'
    WHEN 4 THEN 'Contig' ELSE 'Other' END AS assembly_level,
  CASE l_returnflag WHEN 'A' THEN 'iso' || l_suppkey WHEN 'N' THEN NULL
    ELSE CASE WHEN l_linenumber > 4 THEN 'Missing ' ELSE '' END END AS isolate,
  CASE WHEN l_linenumber = 5 THEN 'derived from metagenome' WHEN l_linenumber = 6 THEN 'genus undefined' END AS excluded_from_refseq,
  floor(l_extendedprice)::BIGINT * 1000 AS genome_size, round(l_discount * 100)::DOUBLE AS gc_percent,
  l_shipdate::DATE AS seq_rel_date, p_type AS domain, p_brand AS phylum, split_part(p_name, ' ', 1) AS family,
  CASE WHEN p_size % 10 = 3 THEN p_name || ' cat' ELSE p_name END AS genus,
  CASE WHEN l_returnflag = 'A' THEN 'isolate' ELSE 'uncultured' END AS genome_source
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "clusters": """SELECT l_orderkey || '-' || l_linenumber AS centroid, 'm' || l_suppkey AS members,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity::BIGINT END AS size,
  CASE WHEN p_size % 13 = 0 THEN p_brand || '.U.division' ELSE p_brand END AS division,
  CASE WHEN p_size % 11 = 0 THEN split_part(p_name, ' ', 1) || '.U.family' ELSE split_part(p_name, ' ', 1) END AS family,
  CASE WHEN p_size % 7 = 0 THEN split_part(p_name, ' ', 1) || '.U.genus' WHEN p_size = 1 THEN NULL
    WHEN p_size % 10 = 4 THEN p_name || ' env' ELSE p_name END AS genus
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "nodes": """SELECT 1::BIGINT AS taxid, 1::BIGINT AS parent, 'no rank' AS rank
  UNION ALL SELECT 10 + r_regionkey, 1, 'superkingdom' FROM region
  UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey, 'phylum' FROM nation
  UNION ALL SELECT DISTINCT 200 + c_nationkey * 7 + c_custkey % 7, 100 + c_nationkey, 'family' FROM customer
  UNION ALL SELECT 1000 + c_custkey, 200 + c_nationkey * 7 + c_custkey % 7, 'species' FROM customer""",
    "names_all": """SELECT (10 + r_regionkey)::BIGINT AS taxid, r_name AS name, 'scientific name' AS name_class FROM region
  UNION ALL SELECT 100 + n_nationkey, replace(n_name, '_', ''), 'scientific name' FROM nation
  UNION ALL SELECT DISTINCT 200 + c_nationkey * 7 + c_custkey % 7, 'Fam' || c_nationkey || 'x' || (c_custkey % 7), 'scientific name' FROM customer
  UNION ALL SELECT 1000 + c_custkey, c_name, 'scientific name' FROM customer
  UNION ALL SELECT 1000 + p_partkey, p_name, 'common name' FROM part
  UNION ALL SELECT 100 + p_partkey % 25, p_brand, 'common name' FROM part""",
    "lookup": "SELECT name, min(taxid) AS taxid FROM names_all GROUP BY name",
    "sci": "SELECT taxid, min(name) AS name FROM names_all WHERE name_class = 'scientific name' GROUP BY taxid",
    "tree": """SELECT x.taxid, x.rank, x.name, y.taxid AS a_taxid, y.rank AS a_rank, y.name AS a_name, y.lvl FROM (
  SELECT n.taxid, n.rank, s.name FROM nodes n JOIN sci s USING (taxid) WHERE n.taxid <> 1) x JOIN (
  SELECT c.taxid AS leaf, c.taxid, c.rank, sc.name, 4 AS lvl FROM nodes c JOIN sci sc USING (taxid) WHERE c.taxid <> 1
  UNION ALL SELECT c.taxid, p.taxid, p.rank, sp.name, 3 FROM nodes c JOIN nodes p ON c.parent = p.taxid JOIN sci sp ON sp.taxid = p.taxid WHERE p.taxid <> 1 AND c.taxid <> 1
  UNION ALL SELECT c.taxid, g.taxid, g.rank, sg.name, 2 FROM nodes c JOIN nodes p ON c.parent = p.taxid JOIN nodes g ON p.parent = g.taxid JOIN sci sg ON sg.taxid = g.taxid WHERE g.taxid <> 1 AND p.taxid <> 1 AND c.taxid <> 1
  UNION ALL SELECT c.taxid, h.taxid, h.rank, sh.name, 1 FROM nodes c JOIN nodes p ON c.parent = p.taxid JOIN nodes g ON p.parent = g.taxid JOIN nodes h ON g.parent = h.taxid JOIN sci sh ON sh.taxid = h.taxid WHERE h.taxid <> 1 AND g.taxid <> 1 AND p.taxid <> 1 AND c.taxid <> 1
  ) y ON y.leaf = x.taxid""",
    "lin": """SELECT taxid, string_agg(a_name, ';' ORDER BY lvl) AS lineage, string_agg(a_rank, ';' ORDER BY lvl) AS ranks,
  string_agg(a_taxid::VARCHAR, ';' ORDER BY lvl) AS taxids,
  max(a_name) FILTER (a_rank = 'superkingdom') AS superkingdom, max(a_name) FILTER (a_rank = 'phylum') AS phylum,
  max(a_name) FILTER (a_rank = 'family') AS family, max(a_name) FILTER (a_rank = 'species') AS species FROM tree GROUP BY taxid""",
    "gtdb": """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'RS_GCF_' ELSE 'GB_GCA_' END || lpad(o_orderkey::VARCHAR, 9, '0') || '.1' AS accession,
  'd__' || CASE WHEN o_orderstatus = 'F' THEN 'Archaea' ELSE 'Bacteria' END ||
  ';p__' || c_mktsegment || CASE WHEN o_orderpriority LIKE '1%' THEN '_A' ELSE '' END ||
  ';c__C' || (c_nationkey % 5) || ';o__O' || c_nationkey ||
  CASE WHEN o_custkey % 11 = 0 THEN '' ELSE ';f__F' || c_nationkey || CASE WHEN o_custkey % 3 = 0 THEN '_B' ELSE '' END END ||
  ';g__G' || (o_custkey % 50) || CASE WHEN o_custkey % 4 = 0 THEN '_C' ELSE '' END ||
  ';s__G' || (o_custkey % 50) || ' sp' || o_custkey AS taxonomy FROM orders JOIN customer ON o_custkey = c_custkey""",
    "gtdb_ranks": """SELECT regexp_replace(accession, '^[A-Z]{2}_', '') AS accession_clean,
  split_part(split_part(taxonomy, 'd__', 2), ';', 1) AS domain, split_part(split_part(taxonomy, 'p__', 2), ';', 1) AS phylum,
  split_part(split_part(taxonomy, 'c__', 2), ';', 1) AS class, split_part(split_part(taxonomy, 'o__', 2), ';', 1) AS "order",
  nullif(split_part(split_part(taxonomy, 'f__', 2), ';', 1), '') AS family, split_part(split_part(taxonomy, 'g__', 2), ';', 1) AS genus,
  split_part(split_part(taxonomy, 's__', 2), ';', 1) AS species FROM gtdb""",
    "acc_a": """SELECT (CASE WHEN o_totalprice > 50000 THEN o_orderkey ELSE 1000000000000 + o_orderkey END)::VARCHAR AS accession_clean,
  CASE WHEN o_totalprice > 420000 THEN 'Lonely' || (o_orderkey % 3) WHEN o_orderstatus = 'F' THEN o_orderpriority || '_A' ELSE o_orderpriority END AS taxon,
  CASE WHEN o_orderstatus = 'P' THEN 'Eukaryota' WHEN o_orderkey % 2 = 0 THEN 'Bacteria' ELSE 'Archaea' END AS domain
  FROM orders""",
    "acc_b": """SELECT (CASE WHEN o_totalprice < 400000 THEN o_orderkey ELSE 2000000000000 + o_orderkey END)::VARCHAR AS accession_clean,
  CASE WHEN o_orderpriority LIKE '5%' THEN lower(o_orderpriority) ELSE c_mktsegment END AS taxon,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Bacteria' ELSE 'Archaea' END AS domain
  FROM orders JOIN customer ON o_custkey = c_custkey""",
    "counts_a": """SELECT taxon, domain, count(*) AS genomes, count(DISTINCT accession_clean::BIGINT // 3) AS species FROM acc_a GROUP BY taxon, domain""",
    "counts_b": """SELECT taxon, domain, count(*) AS genomes, count(DISTINCT accession_clean::BIGINT // 3) AS species FROM acc_b GROUP BY taxon, domain""",
    "eukprot": """SELECT 'EP' || lpad(c_custkey::VARCHAR, 9, '0') AS eukprot_id,
  CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN replace(n_name, '_', '') || ' sp ' || c_custkey ELSE 'Xenus ' || c_custkey END AS name_to_use,
  CASE c_custkey % 6 WHEN 2 THEN 'Foo bar, ' || c_name WHEN 3 THEN 'Foo bar, ' || replace(n_name, '_', '') || ' sp' ELSE '' END AS previous,
  CASE WHEN c_custkey % 6 = 4 THEN 'Eukaryota;' || r_name || ';' || replace(n_name, '_', '') || ';Nothing;Deeper'
    WHEN c_custkey % 6 = 5 THEN 'Eukaryota;Nowhere'
    ELSE 'Eukaryota;' || r_name || ';' || replace(n_name, '_', '') || ';Fam' || c_nationkey || 'x' || (c_custkey % 7) || ';''Gen' || c_mktsegment || '''' END AS taxonomy,
  c_custkey % 6 AS kind, replace(n_name, '_', '') AS nation, 100 + n_nationkey AS nation_taxid, 1000 + c_custkey AS own_taxid
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "unmapped": """SELECT 1000 + p_partkey AS taxid, 1000 + p_partkey // 2 AS species_taxid,
  CASE p_partkey % 4 WHEN 0 THEN 'No family found' WHEN 1 THEN 'Multiple families' WHEN 2 THEN 'family not in lineage' ELSE 'incertae sedis' END AS reason,
  'cellular organisms;' ||
  CASE p_size % 5 WHEN 0 THEN 'Bacteria' WHEN 1 THEN 'Eukaryota' WHEN 2 THEN 'Archaea' WHEN 3 THEN 'Viruses' ELSE 'metagenomes' END || ';' ||
  CASE p_partkey % 13 WHEN 0 THEN 'unclassified Bacteria' WHEN 1 THEN 'environmental samples' WHEN 2 THEN 'SAR'
    WHEN 3 THEN 'Opisthokonta' WHEN 4 THEN 'Alphaproteobacteria' WHEN 5 THEN 'Ascomycetes' WHEN 6 THEN 'Bacillota'
    WHEN 7 THEN 'Fungi' WHEN 8 THEN 'Metazoa' WHEN 9 THEN 'incertae sedis' WHEN 10 THEN 'Stramenopiles'
    WHEN 11 THEN 'Chlorophyceae' ELSE 'Actinobacteria' END || ';' || p_name AS lineage,
  'cellular root;domain;' || CASE p_partkey % 4 WHEN 0 THEN 'clade' WHEN 1 THEN 'class' WHEN 2 THEN 'order' ELSE 'no rank' END || ';species' AS ranks
  FROM part""",
    "combos": """SELECT coalesce(division, 'NA') AS division, coalesce(family, 'NA') AS family, coalesce(genus, 'NA') AS genus,
  count(*) AS row_count, sum(coalesce(size, 0))::BIGINT AS total_size,
  round_even(sum(coalesce(size, 0))::DOUBLE / count(*) * 100, 0) / 100 AS avg_size_per_cluster,
  coalesce(division, 'NA') || '|' || coalesce(family, 'NA') || '|' || coalesce(genus, 'NA') AS taxonomic_combination
  FROM clusters GROUP BY 1, 2, 3""",
    "members": """SELECT DISTINCT p_name || ' ' || p_size AS name, unnest([p_type, p_brand, split_part(p_name, ' ', 1), p_name]) AS part FROM part""",
}
for _rank, _col, _tax in [("phylum", "division", "p_brand"), ("family", "family", "split_part(p_name, ' ', 1)"), ("genus", "genus", "p_name")]:
    _key = _rank
    _lin = {"phylum": "domain || ';' || phylum", "family": "domain || ';' || min(phylum) || ';' || family",
            "genus": "domain || ';' || min(phylum) || ';' || min(family) || ';' || genus"}[_rank]
    CTE[f"cat_{_rank}"] = f"""SELECT domain, {_key} AS taxon, count(*) AS genomes, count(DISTINCT species_taxid) AS species,
  min(taxid) AS taxid, {_lin} AS lineage FROM assemblies GROUP BY domain, {_key}"""
    CTE[f"iso_{_rank}"] = f"""SELECT {_key} AS taxon, domain, count(*) FILTER (genome_source = 'isolate') AS isolates, count(*) AS isolate_genomes
  FROM assemblies a WHERE {_key} IN (SELECT {_key} FROM assemblies WHERE genome_source = 'isolate') GROUP BY {_key}, domain"""
    CTE[f"census_{_rank}"] = f"""SELECT c.*, x.taxid FROM (
  SELECT {_col} AS taxon, count(centroid) AS otu_count, coalesce(sum(size), 0)::BIGINT AS size_count,
   round_even(count(centroid)::DOUBLE / (SELECT count(centroid) FROM clusters WHERE {_col} IS NOT NULL)::DOUBLE * 100 * 100, 0) / 100 AS otu_percentage,
   round_even(coalesce(sum(size), 0)::DOUBLE / (SELECT sum(size) FROM clusters WHERE {_col} IS NOT NULL)::DOUBLE * 100 * 100, 0) / 100 AS size_percentage
  FROM clusters WHERE {_col} IS NOT NULL GROUP BY {_col}) c
  LEFT JOIN (SELECT {_tax} AS taxon, 1000 + max(p_partkey) AS taxid FROM part GROUP BY 1) x USING (taxon)"""
    # every census/catalogue pair, by comparing texts
    CTE[f"pairs_{_rank}"] = f"""SELECT c.taxon, c.taxid AS census_taxid, k.taxon AS cat_taxon, k.domain, k.taxid AS cat_taxid, k.genomes, k.species,
  coalesce(i.isolates, 0) AS isolates, coalesce(i.isolate_genomes, 0) AS isolate_genomes,
  contains(';' || k.lineage || ';', ';' || c.taxon || ';') AS by_lineage, coalesce(c.taxid = k.taxid, false) AS by_taxid
  FROM census_{_rank} c JOIN cat_{_rank} k ON contains(';' || k.lineage || ';', ';' || c.taxon || ';') OR c.taxid = k.taxid
  LEFT JOIN iso_{_rank} i ON i.taxon = k.taxon AND i.domain = k.domain"""
    CTE[f"merged_{_rank}"] = f"""SELECT c.taxon, c.otu_count AS census_otu_count, c.size_count AS census_size_count, c.otu_percentage, c.size_percentage,
  coalesce(m.g, 0) AS ncbi_genome_count, coalesce(m.s, 0) AS ncbi_species_count, coalesce(m.i, 0) AS isolate_count,
  round_even(coalesce(m.g, 0)::DOUBLE / t.g * 100 * 100, 0) / 100 AS genome_pct_db,
  round_even(coalesce(m.s, 0)::DOUBLE / t.s * 100 * 100, 0) / 100 AS species_pct,
  CASE WHEN m.ig > 0 THEN round_even(m.i::DOUBLE / m.ig * 100 * 100, 0) / 100 ELSE 0 END AS isolate_percentage,
  CASE WHEN m.s > 0 THEN round_even(c.otu_count::DOUBLE / m.s * 1000, 0) / 1000 ELSE 'inf'::DOUBLE END AS novelty_factor,
  CASE WHEN c.otu_count > 0 THEN round_even(coalesce(m.s, 0)::DOUBLE / c.otu_count * 1000, 0) / 1000 ELSE 'inf'::DOUBLE END AS overrepresentation_factor,
  coalesce(m.direct, 0) AS direct_matches, coalesce(m.tx, 0) AS taxid_matches,
  coalesce(m.n - m.direct - m.tx, 0) AS lineage_matches, coalesce(m.n, 0) AS total_matches,
  CASE WHEN m.s > 0 THEN 'matched' ELSE 'census_only' END AS match_status, coalesce(d.domain, 'Unknown') AS domain
  FROM census_{_rank} c CROSS JOIN (SELECT sum(genomes)::DOUBLE AS g, sum(species)::DOUBLE AS s FROM cat_{_rank}) t
  LEFT JOIN (SELECT taxon, sum(genomes)::BIGINT AS g, sum(species)::BIGINT AS s, sum(isolates)::BIGINT AS i, sum(isolate_genomes)::BIGINT AS ig,
    count(*) AS n, max((cat_taxon = taxon)::INT)::BIGINT AS direct, sum(by_taxid::INT)::BIGINT AS tx FROM pairs_{_rank} GROUP BY taxon) m USING (taxon)
  LEFT JOIN (SELECT taxon, domain FROM (SELECT taxon, domain, row_number() OVER (PARTITION BY taxon ORDER BY count(*) DESC, domain DESC) AS rn
    FROM pairs_{_rank} GROUP BY taxon, domain) WHERE rn = 1) d USING (taxon)
  UNION ALL
  SELECT k.taxon, 0, 0, 0, 0, k.genomes, k.species, coalesce(i.isolates, 0),
  round_even(k.genomes::DOUBLE / t.g * 100 * 100, 0) / 100, round_even(k.species::DOUBLE / t.s * 100 * 100, 0) / 100,
  CASE WHEN i.isolate_genomes > 0 THEN round_even(i.isolates::DOUBLE / i.isolate_genomes * 100 * 100, 0) / 100 ELSE 0 END,
  NULL, NULL, 0, 0, 0, 0, 'ncbi_only', k.domain
  FROM cat_{_rank} k CROSS JOIN (SELECT sum(genomes)::DOUBLE AS g, sum(species)::DOUBLE AS s FROM cat_{_rank}) t
  LEFT JOIN iso_{_rank} i ON i.taxon = k.taxon AND i.domain = k.domain
  WHERE k.taxon NOT IN (SELECT cat_taxon FROM pairs_{_rank}) AND (k.genomes > 0 OR k.species > 0)"""
    CTE[f"map_{_rank}"] = f"""SELECT CASE WHEN p_size > 5 THEN 1000 + p_partkey ELSE 1000000000000 + p_partkey END AS taxid,
  {_tax} AS {_rank}, p_type AS domain FROM part"""

_NEEDS: dict[str, list[str]] = {}


def _needs(name: str) -> list[str]:
    """CTEs a text refers to, dependencies first."""
    import re

    if name not in _NEEDS:
        out: list[str] = []
        words = set(re.findall(r"\b[a-z_]+\b", CTE[name]))
        for other in CTE:
            if other != name and other in words and re.search(rf"(FROM|JOIN)\s+{other}\b", CTE[name]):
                out += [x for x in [*_needs(other), other] if x not in out]
        _NEEDS[name] = out
    return _NEEDS[name]


def sql(body: str) -> str:
    """Prefix a query with the CTEs it uses."""
    import re

    used: list[str] = []
    for name in CTE:
        if re.search(rf"(FROM|JOIN|,)\s+{name}\b", body):
            used += [x for x in [*_needs(name), name] if x not in used]
    if not used:
        return body
    ctes = ",\n".join(f"{n} AS ({CTE[n]})" for n in used)
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body.removeprefix('WITH RECURSIVE ')}"
    return f"WITH {ctes}\n{body}"


def hard_names(spark, d) -> DataFrame:
    """Census-like spellings made from every part name."""
    return t(spark, d, "part").selectExpr("p_partkey", """
        case p_size % 12
          when 0 then concat(replace(p_name, ' ', '_'), ':plas.Chloroplast')
          when 1 then concat(replace(p_name, ' ', '_'), '.Mitochondria')
          when 2 then concat('uncultured_', initcap(substring_index(p_name, ' ', 1)), '_bacterium')
          when 3 then concat(replace(p_brand, '#', ''), '_XX')
          when 4 then concat(p_name, '.U.genus')
          when 5 then concat(substring_index(p_name, ' ', 1), '-lineage')
          when 6 then concat(substring_index(p_name, ' ', 1), '-Group')
          when 7 then concat('X-', substring_index(p_name, ' ', -1), '_XX')
          when 8 then concat('Novel-Clade-', p_size, '_X')
          when 9 then concat(initcap(substring_index(p_name, ' ', 1)), p_partkey)
          when 10 then concat('uncultured_', initcap(substring_index(p_name, ' ', 1)), '_', initcap(substring_index(p_name, ' ', -1)), '_sp')
          else concat('marine_', substring_index(p_name, ' ', 1), '_metagenome') end as name""")


def _cap(x):
    return f"upper({x}[1]) || lower({x}[2:])"


_W1, _W2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', -1)"
CTE["hard_names"] = f"""SELECT p_partkey, CASE p_size % 12
  WHEN 0 THEN replace(p_name, ' ', '_') || ':plas.Chloroplast' WHEN 1 THEN replace(p_name, ' ', '_') || '.Mitochondria'
  WHEN 2 THEN 'uncultured_' || {_cap(_W1)} || '_bacterium' WHEN 3 THEN replace(p_brand, '#', '') || '_XX'
  WHEN 4 THEN p_name || '.U.genus' WHEN 5 THEN {_W1} || '-lineage' WHEN 6 THEN {_W1} || '-Group'
  WHEN 7 THEN 'X-' || {_W2} || '_XX' WHEN 8 THEN 'Novel-Clade-' || p_size || '_X'
  WHEN 9 THEN {_cap(_W1)} || p_partkey
  WHEN 10 THEN 'uncultured_' || {_cap(_W1)} || '_' || {_cap(_W2)} || '_sp'
  ELSE 'marine_' || {_W1} || '_metagenome' END AS name FROM part"""
