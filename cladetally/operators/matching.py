"""Joins between census names and catalogue lineages.

Containment of a name in a `;` lineage is written as an equality on exploded lineage parts. For
sums, the catalogue is first totalled per part, so a common ancestor such as a domain reaches the
shuffle as one row per map task and meets one census row. Only the match log emits pairs.
"""

from pyspark.sql import DataFrame, functions as F

from cladetally.functions import fixed_values as fv
from cladetally.functions import lineages as ln
from cladetally.functions.common import percent, round_even
from cladetally.functions.measures import match_status, novelty_factor, overrepresentation_factor
from cladetally.functions.names import clean_merge_name
from cladetally.operators.keyed import union_all

# A catalogue has: taxon, domain, genomes, species, isolates, isolate_genomes, taxid, parts
# (array of the names in its lineage). A census has: taxon, taxid, otu_count, size_count,
# otu_percentage, size_percentage. Both are read several times: pass stored tables.


def catalogue_with_parts(df: DataFrame, lineage: str = "lineage") -> DataFrame:
    """Adds `parts`, the distinct lineage names, from a `;` text or a lineage array."""
    is_text = dict(df.dtypes)[lineage] == "string"
    names = F.split(F.col(lineage), ";") if is_text else ln.lineage_names(lineage)
    return df.withColumn("parts", F.array_distinct(names))


def isolate_shares(accessions: DataFrame, taxon: str) -> DataFrame:
    """Isolate rows and all rows per taxon; taxa without isolates are absent."""
    out = accessions.where(F.col(taxon).isNotNull()).groupBy(taxon).agg(
        F.count_if(F.col("genome_source") == "isolate").alias("isolate_count"),
        F.count("*").alias("total_genomes"),
    )
    return out.where("isolate_count > 0").withColumn(
        "isolate_percentage", round_even(percent("isolate_count", "total_genomes"), 2)
    )


def with_isolates(catalogue: DataFrame, accessions: DataFrame, taxon: str) -> DataFrame:
    """Catalogue rows with `isolates` and `isolate_genomes` of their taxon and domain.

    `isolate_genomes` counts the genomes of taxa that have an isolate; both are zero otherwise.
    """
    rows = accessions.where(F.col(taxon).isNotNull()).groupBy(F.col(taxon).alias("taxon"), "domain").agg(
        F.count_if(F.col("genome_source") == "isolate").alias("isolates"),
        F.count("*").alias("isolate_genomes"),
    )
    owners = rows.groupBy("taxon").agg(F.sum("isolates").alias("_n")).where("_n > 0")
    return catalogue.join(
        rows.join(owners, "taxon", "left_semi"), ["taxon", "domain"], "left"
    ).fillna(0, ["isolates", "isolate_genomes"])


_SUMS = ["genomes", "species", "isolates", "isolate_genomes"]


def _totals(df: DataFrame, keys, taxon_is_key) -> DataFrame:
    """Catalogue totals per key and domain: partial sums run before the shuffle."""
    return df.groupBy(*keys, "domain").agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        F.count("*").alias("rows"),
        F.count_if(taxon_is_key).alias("same_name"),
    )


def match_totals(census: DataFrame, catalogue: DataFrame, by_taxid: bool = True) -> DataFrame:
    """Sums, match counts and majority domain of each census taxon's matches.

    A catalogue row matches by lineage part or by taxid and counts once: rows matched both ways
    are added twice and subtracted once, all on pre-aggregated totals.
    """
    names = census.select("taxon", "taxid")
    parts = catalogue.select("taxon", "taxid", "domain", *_SUMS, F.explode("parts").alias("part"))
    by_part = _totals(parts, ["part"], F.col("taxon") == F.col("part"))
    lineage_hits = names.join(by_part, names["taxon"] == by_part["part"]).select(
        names["taxon"], "domain", *_SUMS, "rows", "same_name", F.lit(0).cast("bigint").alias("taxid_rows")
    )
    signed = lineage_hits
    if by_taxid:
        known = catalogue.where("taxid is not null")
        by_id = _totals(known, ["taxid"], F.lit(False))
        id_hits = names.where("taxid is not null").join(by_id, "taxid").select(
            "taxon", "domain", *_SUMS, "rows",
            F.col("same_name"), F.col("rows").alias("taxid_rows"),
        )
        # the row's own name may differ from every lineage part and still equal the census name
        own = known.where(~F.array_contains("parts", F.col("taxon"))).groupBy("taxid", "taxon").agg(
            F.count("*").alias("same_name")
        )
        own_hits = names.join(own, ["taxon", "taxid"]).select("taxon", "same_name")
        both = _totals(parts.where("taxid is not null"), ["taxid", "part"], F.lit(False))
        both_hits = names.join(both, (names["taxon"] == both["part"]) & (names["taxid"] == both["taxid"])).select(
            names["taxon"], "domain", *[(-F.col(c)).alias(c) for c in _SUMS], (-F.col("rows")).alias("rows"),
            "same_name", F.lit(0).cast("bigint").alias("taxid_rows"),
        )
        signed = union_all(lineage_hits, id_hits, both_hits, own_hits)
    per_domain = signed.groupBy("taxon", "domain").agg(
        *[F.sum(c).alias(c) for c in [*_SUMS, "rows", "same_name", "taxid_rows"]]
    )
    majority = F.max(F.when(F.col("domain").isNotNull() & (F.col("rows") > 0),
                            F.struct(F.col("rows"), F.col("domain"))))
    return per_domain.groupBy("taxon").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS],
        F.coalesce(F.sum("rows"), F.lit(0)).alias("matched_rows"),
        (F.sum("same_name") > 0).cast("int").alias("direct_matches"),
        F.coalesce(F.sum("taxid_rows"), F.lit(0)).alias("taxid_matches"),
        majority["domain"].alias("domain"),
    )


def match_pairs(census: DataFrame, catalogue: DataFrame, by_taxid: bool = True) -> DataFrame:
    """Match log: one row per census taxon and catalogue taxon with its strongest match type."""
    names = census.select(F.col("taxon").alias("census_taxon"), F.col("taxid").alias("census_taxid"))
    cat = catalogue.select(
        F.col("taxon").alias("catalogue_taxon"), F.col("taxid").alias("catalogue_taxid"),
        "genomes", "species", "parts",
    )
    out = ["census_taxon", "catalogue_taxon", "catalogue_taxid", "genomes", "species"]
    lineage = (
        cat.withColumn("census_taxon", F.explode("parts")).join(names, "census_taxon")
        .select(*out, (F.col("census_taxid") == F.col("catalogue_taxid")).alias("_same_id"))
    )
    pairs = lineage
    if by_taxid:
        only_id = (
            names.where("census_taxid is not null")
            .join(cat, F.col("census_taxid") == F.col("catalogue_taxid"))
            .where(~F.array_contains("parts", F.col("census_taxon")))
            .select(*out, F.lit(True).alias("_same_id"))
        )
        pairs = lineage.unionByName(only_id)
    kind = (
        F.when(F.col("census_taxon") == F.col("catalogue_taxon"), "direct_match")
        .when(F.coalesce("_same_id", F.lit(False)) & F.lit(by_taxid), "taxid_match")
        .otherwise("lineage_match")
    )
    return pairs.withColumn("match_type", kind).drop("_same_id")


def catalogue_only(census: DataFrame, catalogue: DataFrame, by_taxid: bool = True,
                   with_data_only: bool = True) -> DataFrame:
    """Catalogue taxa that no census name reaches through a lineage part or a taxid."""
    reached = (
        catalogue.select("taxon", F.explode("parts").alias("part"))
        .join(census.select(F.col("taxon").alias("part")), "part", "left_semi").select("taxon")
    )
    if by_taxid:
        ids = census.where("taxid is not null").select("taxid")
        reached = reached.union(catalogue.join(ids, "taxid", "left_semi").select("taxon"))
    rest = catalogue.join(reached, "taxon", "left_anti")
    return rest.where("genomes > 0 or species > 0") if with_data_only else rest


def distinct_member_counts(census: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct members (organism names) per census taxon, direct and through the lineage.

    `members` has name and parts. Pairs are made distinct before they are counted, so one popular
    ancestor is spread over many tasks.
    """
    pairs = (
        members.select("name", F.explode("parts").alias("taxon"))
        .join(census.select("taxon"), "taxon", "left_semi").distinct()
    )
    return pairs.groupBy("taxon").agg(
        F.count("*").alias("member_species"),
        F.count_if(F.col("name") == F.col("taxon")).alias("direct_matches"),
    )


def merge_with_catalogue(census: DataFrame, catalogue: DataFrame, db: str, by_taxid: bool = True,
                         isolate_denominator: str = "isolate_taxa", with_data_only: bool = True) -> DataFrame:
    """Census rows with catalogue sums and factors, plus catalogue-only rows.

    `isolate_denominator`: `isolate_taxa` divides by the genomes of matched taxa that have
    isolates; `all_matched` by all matched genomes.
    """
    total = catalogue.agg(F.struct(F.sum("genomes").alias("g"), F.sum("species").alias("s"))).scalar()
    hits = match_totals(census, catalogue, by_taxid)
    zero = [*_SUMS, "matched_rows", "direct_matches", "taxid_matches"]
    rows = census.join(hits, "taxon", "left").fillna(0, zero)
    denominator = F.col("isolate_genomes" if isolate_denominator == "isolate_taxa" else "genomes")
    lineage = F.col("matched_rows") - F.col("direct_matches") - F.col("taxid_matches")

    def shares(denominator):
        return [
            round_even(percent("genomes", total.getField("g")), 2).alias("genome_pct_db"),
            round_even(percent("species", total.getField("s")), 2).alias("species_pct"),
            round_even(percent("isolates", denominator), 2).alias("isolate_percentage"),
        ]

    counts = [
        F.col("genomes").alias(f"{db}_genome_count"),
        F.col("species").alias(f"{db}_species_count"),
        F.col("isolates").alias("isolate_count"),
    ]
    merged = rows.select(
        "taxon",
        F.col("otu_count").alias("census_otu_count"), F.col("size_count").alias("census_size_count"),
        "otu_percentage", "size_percentage", *counts, *shares(denominator),
        novelty_factor("otu_count", "species").alias("novelty_factor"),
        overrepresentation_factor("otu_count", "species").alias("overrepresentation_factor"),
        F.col("direct_matches").cast("bigint").alias("direct_matches"),
        "taxid_matches", lineage.alias("lineage_matches"),
        F.col("matched_rows").alias("total_matches"),
        match_status("species").alias("match_status"),
        F.coalesce("domain", F.lit("Unknown")).alias("domain"),
    )
    rest = catalogue_only(census, catalogue, by_taxid, with_data_only)
    zero_long = F.lit(0).cast("bigint")
    only = rest.select(
        "taxon",
        zero_long.alias("census_otu_count"), zero_long.alias("census_size_count"),
        F.lit(0.0).alias("otu_percentage"), F.lit(0.0).alias("size_percentage"),
        *counts, *shares(F.col("isolate_genomes")),
        F.lit(None).cast("double").alias("novelty_factor"),
        F.lit(None).cast("double").alias("overrepresentation_factor"),
        zero_long.alias("direct_matches"), zero_long.alias("taxid_matches"),
        zero_long.alias("lineage_matches"), zero_long.alias("total_matches"),
        match_status("species", f"{db}_only").alias("match_status"),
        F.coalesce("domain", F.lit("Unknown")).alias("domain"),
    )
    return merged.unionByName(only)


def merge_with_members(census: DataFrame, members: DataFrame, db: str = "eukprot") -> DataFrame:
    """Census rows against organisms counted by distinct name, with coverage."""
    hits = distinct_member_counts(census, members)
    rows = census.join(hits, "taxon", "left").fillna(0, ["member_species", "direct_matches"])
    return rows.select(
        "taxon",
        F.col("otu_count").alias("census_otu_count"), F.col("size_count").alias("census_size_count"),
        "otu_percentage", "size_percentage",
        F.col("member_species").alias(f"{db}_species_count"),
        round_even(percent("member_species", "otu_count"), 2).alias("coverage_percentage"),
        novelty_factor("otu_count", "member_species").alias("novelty_factor"),
        overrepresentation_factor("otu_count", "member_species").alias("overrepresentation_factor"),
        "direct_matches",
        (F.col("member_species") - F.col("direct_matches")).alias("lineage_matches"),
        F.col("member_species").alias("total_matches"),
        match_status("member_species").alias("match_status"),
    )


def merge_summary(merged: DataFrame, level: str, db: str) -> DataFrame:
    """Rows per status and match rate of one level."""
    status = F.col("match_status")
    return merged.agg(
        F.lit(level).alias("level"),
        F.count("*").alias("total_entries"),
        F.count_if(status == "matched").alias("matched_taxa"),
        F.count_if(status == "census_only").alias("census_only_taxa"),
        F.count_if(status == f"{db}_only").alias(f"{db}_only_taxa"),
    ).withColumn("match_rate", round_even(percent("matched_taxa", "total_entries"), 1))


def evidence_pairs(census: DataFrame, members: DataFrame, level: str) -> DataFrame:
    """Pairs with their evidence: name at rank, taxid at rank, ancestor taxid, name in lineage.

    `census`: taxon, lineage array. `members`: name, lineage array. Each kind of evidence is one
    equality join; a pair is high with a name or taxid at the rank, else medium.

    Pairs are grouped in as many tasks as there are shuffle partitions, and not before the shuffle: their rows shrink so much when
    written that adaptive coalescing would gather most pairs in a few tasks. No side of a join is broadcast for the same reason.
    """
    partitions = int(census.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = F.coalesce(*[ln.node_at_rank("lineage", r, "last")["taxid"] for r in fv.EVIDENCE_RANKS])
    names = census.select("taxon", ids.alias("taxid")).hint("merge")
    m = members.select(
        "name", "lineage",
        ln.rank_or_fallback("lineage", level).alias("rank_name"),
        ln.taxid_or_fallback("lineage", level).alias("rank_taxid"),
    )
    nodes = m.select("name", F.explode("lineage").alias("n"))

    def flags(kind):
        return [F.lit(kind == k).alias(k) for k in ("direct_name", "taxid_match", "ancestor", "cross_name")]

    found = union_all(
        m.join(names, m["rank_name"] == names["taxon"]).select("taxon", "name", *flags("direct_name")),
        m.join(names, m["rank_taxid"] == names["taxid"]).select("taxon", "name", *flags("taxid_match")),
        nodes.join(names, F.col("n.taxid") == names["taxid"]).select("taxon", "name", *flags("ancestor")),
        nodes.join(names, F.col("n.name") == names["taxon"]).select("taxon", "name", *flags("cross_name")),
    )
    pair = found.repartition(partitions, "taxon", "name").groupBy("taxon", "name").agg(
        *[F.bool_or(k).alias(k) for k in ("direct_name", "taxid_match", "ancestor", "cross_name")]
    )
    return pair.withColumn(
        "confidence", F.when(F.col("direct_name") | F.col("taxid_match"), "high").otherwise("medium")
    )


def outer_name_merge(catalogue: DataFrame, census: DataFrame, db: str) -> DataFrame:
    """Full outer join on the cleaned name; the catalogue's spelling is shown when both have one."""
    a = catalogue.select(
        clean_merge_name("taxon").alias("taxon_name_clean"), F.col("taxon").alias("_a"),
        F.col("genomes").alias(f"{db}_genome_count"), F.col("species").alias(f"{db}_species_count"),
    )
    b = census.select(
        clean_merge_name("taxon").alias("taxon_name_clean"), F.col("taxon").alias("_b"),
        F.col("otu_count").alias("census_otu_count"), F.col("size_count").alias("census_size_count"),
    )
    return (
        a.join(b, "taxon_name_clean", "full")
        .withColumn("taxon_name", F.coalesce("_a", "_b")).drop("_a", "_b")
        .fillna(0, [f"{db}_genome_count", f"{db}_species_count", "census_otu_count", "census_size_count"])
    )
