"""Reconciling two catalogues by name, by shared accessions and by verified phylum.

Count tables: `taxon, domain, genomes, species`. Accession tables: `accession_clean, taxon, domain`.
"""

from pyspark.sql import DataFrame, functions as F

from cladetally.functions import names as nm
from cladetally.functions.predicates import (
    is_anchor_domain, is_named, is_prokaryote, is_suspicious_anchor, is_verifiable_phylum,
    is_virus_name, starts_candidate,
)
from cladetally.functions import lineages as ln
from cladetally.operators.keyed import first_per_key, smallest_per_key, union_all
from cladetally.session import materialize


def name_index(counts: DataFrame, drop_viruses: bool = False) -> DataFrame:
    """One row per normalized name: the variant with most genomes, then the smallest name."""
    rows = counts.where(
        is_named("taxon") & ~F.lower("taxon").isin("nan", "none") & is_anchor_domain("domain")
    )
    if drop_viruses:
        rows = rows.where(~is_virus_name("taxon"))
    keyed = rows.select(nm.normalize_name("taxon").alias("key"), "taxon", "domain", "genomes", "species")
    return first_per_key(keyed, ["key"], [F.desc("genomes"), "taxon", "domain"])


def _accession_keys(acc: DataFrame, out: str) -> DataFrame:
    rows = acc.where(
        F.col("accession_clean").isNotNull() & F.col("taxon").isNotNull()
        & is_prokaryote(F.initcap(F.lower("domain")))
    ).select("accession_clean", nm.normalize_name("taxon").alias(out))
    return rows.groupBy("accession_clean").agg(F.min(out).alias(out))


def accession_name_pairs(acc_a: DataFrame, acc_b: DataFrame) -> DataFrame:
    """How often shared accessions carry name a in one catalogue and another name b in the other."""
    shared = _accession_keys(acc_a, "a").join(_accession_keys(acc_b, "b"), "accession_clean")
    return shared.where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def modal_partner(pairs: DataFrame, key: str, partner: str) -> DataFrame:
    """Most frequent partner of each name; ties go to the smaller name."""
    best = F.min(F.struct(-F.col("n"), F.col(partner).alias("p")))
    return pairs.groupBy(key).agg(best["p"].alias(partner))


def _pair_rows(joined: DataFrame, anchor: str, order: int) -> DataFrame:
    return joined.select(
        F.col("b.taxon").alias("taxon"),
        F.col("a.domain").alias("gtdb_domain"), F.col("b.domain").alias("ncbi_domain"),
        F.lit(anchor).alias("anchor_type"), F.lit(order).alias("_order"),
        F.col("a.genomes").alias("gtdb_genome_count"), F.col("a.species").alias("gtdb_species_count"),
        F.col("b.genomes").alias("ncbi_genome_count"), F.col("b.species").alias("ncbi_species_count"),
        F.col("a.taxon").alias("gtdb_name"), F.col("a.key").alias("a_key"), F.col("b.key").alias("b_key"),
    )


def direct_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Same normalized name in both indexes."""
    joined = a.alias("a").join(b.alias("b"), F.col("a.key") == F.col("b.key"))
    return _pair_rows(joined, "Direct_Name", 0)


def tagged_keys(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stored `(key, a, b, asks_b, asks_a)`: one row per name of either index, with its row in each and the
    partner that shared accessions name on the other side. A key with both rows is a direct match."""
    def side(index, tag, other):
        row = F.struct("taxon", "domain", "genomes", "species")
        return index.select("key", row.alias(tag)).withColumn(other, F.lit(None).cast(index.select(row.alias("r")).schema["r"].dataType))

    keys = union_all(side(a, "a", "b"), side(b, "b", "a")).groupBy("key").agg(
        F.first("a", ignorenulls=True).alias("a"), F.first("b", ignorenulls=True).alias("b"))
    partners = union_all(
        modal_partner(pairs, "a", "b").select(F.col("a").alias("key"), F.col("b").alias("asks_b")),
        modal_partner(pairs, "b", "a").select(F.col("b").alias("key"), F.col("a").alias("asks_a")),
    ).groupBy("key").agg(F.max("asks_b").alias("asks_b"), F.max("asks_a").alias("asks_a"))
    only_a, only_b = F.col("b").isNull(), F.col("a").isNull()
    # Names that match directly ask for nothing.
    return materialize(keys.join(partners, "key", "left").select(
        "key", "a", "b", F.when(only_a, F.col("asks_b")).alias("asks_b"), F.when(only_b, F.col("asks_a")).alias("asks_a")))


def reconcile(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stored rows of both indexes: direct matches, a to b through accessions, b to a for names of a that are still
    open, and names that stand on one side only (`order` 0 to 3).

    One table of tagged keys is read; the two kinds of mapped matches are look-ups in it.
    """
    keys = tagged_keys(a, b, pairs)
    target = keys.where("b is not null").select(F.col("key").alias("asks_b"), F.col("key").alias("found"), F.col("b").alias("found_b"))
    forward = materialize(keys.where("a is not null").join(target, "asks_b", "left").select("key", "a", "b", "found", "found_b"))
    still = forward.where("b is null and found is null").select(F.col("key").alias("asks_a"), F.col("key").alias("a_key"), F.col("a").alias("found_a"))
    backward = materialize(keys.where("asks_a is not null").join(still, "asks_a").select("key", "b", "a_key", "found_a"))

    def rows(frame, x, y, x_key, y_key, order):
        return frame.select(x.alias("a"), y.alias("b"), x_key.alias("a_key"), y_key.alias("b_key"), F.lit(order).alias("order"))

    nothing = F.lit(None).cast(keys.schema["a"].dataType)
    key, no_key = F.col("key"), F.lit(None).cast("string")
    used_b = forward.where("b is null").select(F.col("found").alias("key")).union(backward.select("key")).where("key is not null")
    used_a = backward.select(F.col("a_key").alias("key"))
    return materialize(union_all(
        rows(forward.where("b is not null"), F.col("a"), F.col("b"), key, key, 0),
        rows(forward.where("b is null and found is not null"), F.col("a"), F.col("found_b"), key, F.col("found"), 1),
        rows(backward, F.col("found_a"), F.col("b"), F.col("a_key"), key, 2),
        rows(forward.where("b is null and found is null").join(used_a, "key", "left_anti"), F.col("a"), nothing, key, no_key, 3),
        rows(keys.where("a is null").join(used_b, "key", "left_anti"), nothing, F.col("b"), no_key, key, 3),
    ))


def consolidate(matches: DataFrame) -> DataFrame:
    """One row per NCBI name: counts of the first match, anchor types sorted and joined by `+`."""
    first = F.min(F.struct(
        "_order", "gtdb_name", "gtdb_domain", "ncbi_domain",
        "gtdb_genome_count", "gtdb_species_count", "ncbi_genome_count", "ncbi_species_count",
    ))
    grouped = matches.groupBy("taxon").agg(
        first.alias("f"),
        F.array_join(F.sort_array(F.collect_set("anchor_type")), "+").alias("anchor_type"),
        F.count("*").alias("mapping_count"),
    )
    return grouped.select(
        "taxon", "f.gtdb_domain", "f.ncbi_domain",
        F.lit("Both").alias("database_presence"), F.lit("Match").alias("match_status"), "anchor_type",
        "f.gtdb_genome_count", "f.gtdb_species_count", "f.ncbi_genome_count", "f.ncbi_species_count",
        "mapping_count",
    )


ANCHORS = ["Direct_Name", "Accession_Mapped_GTDB_to_NCBI", "Accession_Mapped_NCBI_to_GTDB"]


def matched_rows(reconciled: DataFrame) -> DataFrame:
    """Matches as rows of `consolidate`."""
    anchor = F.get(F.array(*[F.lit(x) for x in ANCHORS]), F.col("order"))
    return reconciled.where("order < 3").select(
        F.col("b.taxon").alias("taxon"), F.col("a.domain").alias("gtdb_domain"), F.col("b.domain").alias("ncbi_domain"),
        anchor.alias("anchor_type"), F.col("order").alias("_order"),
        F.col("a.genomes").alias("gtdb_genome_count"), F.col("a.species").alias("gtdb_species_count"),
        F.col("b.genomes").alias("ncbi_genome_count"), F.col("b.species").alias("ncbi_species_count"),
        F.col("a.taxon").alias("gtdb_name"),
    )


def single_rows(reconciled: DataFrame) -> DataFrame:
    """Names of either index that no anchor reached."""
    zero, only_a = F.lit(0).cast("bigint"), F.col("a").isNotNull()
    return reconciled.where("order = 3").select(
        F.coalesce("a.taxon", "b.taxon").alias("taxon"),
        F.coalesce("a.domain", F.lit("")).alias("gtdb_domain"), F.coalesce("b.domain", F.lit("")).alias("ncbi_domain"),
        F.when(only_a, "GTDB_Only").otherwise("NCBI_Only").alias("database_presence"),
        F.coalesce("a.genomes", zero).alias("gtdb_genome_count"), F.coalesce("a.species", zero).alias("gtdb_species_count"),
        F.coalesce("b.genomes", zero).alias("ncbi_genome_count"), F.coalesce("b.species", zero).alias("ncbi_species_count"),
        F.lit("No_Match").alias("match_status"), F.lit("None").alias("anchor_type"), zero.alias("mapping_count"),
    )


def apply_anchors(counts_a: DataFrame, counts_b: DataFrame, acc_a: DataFrame, acc_b: DataFrame) -> DataFrame:
    """Direct names, accession-mapped names, then the rest, consolidated by NCBI name."""
    found = reconcile(name_index(counts_a), name_index(counts_b, drop_viruses=True), materialize(accession_name_pairs(acc_a, acc_b)))
    return union_all(consolidate(matched_rows(found)), single_rows(found))


def verified_taxa(suspicious: DataFrame, acc_a: DataFrame, assemblies: DataFrame, lineages: DataFrame,
                  rank: str = "phylum", compat: bool = False) -> DataFrame:
    """`(taxon, verified, sample_accessions)` of suspicious taxa that have accessions.

    Verified = one of the accessions leads to a lineage whose rank is present and is no placeholder.
    `compat=True` never finds the rank, as older published tables were made. The five smallest accessions
    are shown.
    """
    rows = acc_a.join(suspicious.select("taxon"), "taxon", "left_semi").select("taxon", "accession_clean").distinct()
    taxids = assemblies.select(F.col("assembly_accession").alias("accession_clean"), "taxid").distinct()
    ok = lineages.select(
        "taxid",
        F.lit(False).alias("ok") if compat
        else is_verifiable_phylum(ln.name_at_rank("lineage", rank, "last")).alias("ok"),
    )
    checked = rows.join(taxids, "accession_clean", "left").join(ok, "taxid", "left")
    verified = checked.groupBy("taxon").agg(F.bool_or(F.coalesce("ok", F.lit(False))).alias("verified"))
    samples = smallest_per_key(rows, ["taxon"], "accession_clean", 5, "few").select(
        "taxon", F.array_join("few", ", ").alias("sample_accessions"))
    return verified.join(samples, "taxon")


def split_verified(summary: DataFrame, checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and rows moved out for want of a verifiable name."""
    bad = checked.where(~F.col("verified")).select("taxon", "sample_accessions")
    kept = summary.join(bad.select("taxon"), "taxon", "left_anti")
    moved = summary.join(bad, "taxon").withColumn(
        "reason_filtered", F.lit("No verifiable NCBI taxonomy classification")
    )
    return kept, moved


def suspicious_taxa(summary: DataFrame) -> DataFrame:
    return summary.where(is_suspicious_anchor("database_presence", "match_status"))


def without_candidates(summary: DataFrame) -> DataFrame:
    return summary.where(~starts_candidate("taxon"))
