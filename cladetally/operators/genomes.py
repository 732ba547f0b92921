"""Counting jobs on assembly and catalogue tables."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from cladetally.functions import fixed_values as fv
from cladetally.functions import names as nm
from cladetally.functions.common import round_even
from cladetally.operators.keyed import best_genome_per_species, first_per_key, share_of
from cladetally.session import materialize


@dataclass(frozen=True)
class RankMap:
    """Stored map with one row per taxid. Build it once with `unique_ranks`."""

    table: DataFrame


def unique_ranks(rank_map: "DataFrame | RankMap") -> RankMap:
    """A taxid on several rows keeps the first by its other columns."""
    if isinstance(rank_map, RankMap):
        return rank_map
    others = [c for c in rank_map.columns if c != "taxid"]
    return RankMap(materialize(first_per_key(rank_map, ["taxid"], others)))


def attach_rank(assemblies: DataFrame, rank_map: "DataFrame | RankMap") -> DataFrame:
    """Assemblies with a known rank. The map is unique on taxid, so genome counts cannot multiply; it is
    stored, so both sides of the join are plain shuffles and AQE can split a taxid that holds a large
    share of the assemblies."""
    return assemblies.join(unique_ranks(rank_map).table, "taxid")


def attach_source(assemblies: DataFrame, classified: DataFrame) -> DataFrame:
    """Classified genome source by accession; unlisted accessions count as isolates."""
    source = first_per_key(
        classified.select(
            F.col("accession_clean").alias("assembly_accession"), F.col("genome_source").alias("_source")
        ),
        ["assembly_accession"], ["_source"],
    )
    return (
        assemblies.drop("genome_source").join(source, "assembly_accession", "left")
        .withColumn("genome_source", F.coalesce("_source", F.lit("isolate"))).drop("_source")
    )


def genome_counts(df: DataFrame, rank: str, accession: str = "assembly_accession") -> DataFrame:
    return df.where(F.col(rank).isNotNull()).groupBy(rank, "domain").agg(
        F.count(accession).alias(f"{rank}_genome_count")
    )


def species_counts(df: DataFrame, rank: str, species: str = "species_taxid") -> DataFrame:
    """Exact distinct species. Distinct triples are formed first, then counted: a rank with most
    of the genomes is reduced to its species before it meets in one group."""
    named = df.where(F.col(rank).isNotNull())
    return named.select(rank, "domain", species).distinct().groupBy(rank, "domain").agg(
        F.count(species).alias(f"{rank}_species_count")
    )


def join_species_counts(genomes: DataFrame, species: DataFrame, rank: str) -> DataFrame:
    """Outer join on rank and domain, missing counts zero."""
    return genomes.join(species, [rank, "domain"], "full").fillna(
        0, [f"{rank}_genome_count", f"{rank}_species_count"]
    )


def genomes_per_taxid(assemblies: DataFrame) -> DataFrame:
    """Assemblies as `(taxid, species_taxid, genomes)`: what the counting joins need. A species
    with a large share of all assemblies reaches the joins as one row."""
    keys = [c for c in ("taxid", "species_taxid") if c in assemblies.columns]
    return assemblies.groupBy(*keys).agg(F.count("assembly_accession").alias("genomes"))


def genome_and_species_counts(df: DataFrame, rank: str, genomes: str | None = None) -> DataFrame:
    """Both counts in two shuffles: per (rank, domain, species) rows first, then their totals.

    `genomes` names a column of counts when the rows are already grouped.
    """
    number = F.count("assembly_accession") if genomes is None else F.sum(genomes)
    per_species = df.where(F.col(rank).isNotNull()).groupBy(rank, "domain", "species_taxid").agg(
        number.alias("_n")
    )
    return per_species.groupBy(rank, "domain").agg(
        F.sum("_n").alias(f"{rank}_genome_count"),
        F.count("species_taxid").alias(f"{rank}_species_count"),
    )


def with_shares(counts: DataFrame, rank: str) -> DataFrame:
    """Share of all counted genomes and species, two places."""
    out = share_of(counts, f"{rank}_genome_count", f"{rank}_genome_percentage")
    return share_of(out, f"{rank}_species_count", f"{rank}_species_percentage")


def subset_species_counts(df: DataFrame, rank: str, species: str = "species_taxid") -> DataFrame:
    """One genome per species (isolates first), then species per rank and domain."""
    best = best_genome_per_species(df, species, ("assembly_accession", rank, "domain"), use_level=False)
    return best.where(F.col(rank).isNotNull()).groupBy(rank, "domain").agg(
        F.count("*").alias(f"{rank}_species_count")
    )


def gtdb_ranks(taxonomy: DataFrame, missing: str | None = "Unclassified") -> DataFrame:
    """Clean accession and the seven rank columns of a GTDB taxonomy text."""
    return taxonomy.select(
        nm.clean_accession("accession").alias("accession_clean"),
        *[nm.gtdb_rank("taxonomy", r, missing).alias(r) for r in fv.GTDB_RANK_PATTERNS],
    )


def gtdb_genome_counts(ranks: DataFrame, rank: str) -> DataFrame:
    """Genomes per rank and domain, lettered variants merged into their base name."""
    return ranks.where(F.col(rank).isNotNull()).groupBy(
        nm.strip_variant_suffix(rank).alias(rank), "domain"
    ).agg(F.count("*").alias(f"{rank}_counts"))


def gtdb_species_counts(ranks: DataFrame, rank: str) -> DataFrame:
    """Species per rank and domain, by the rule of each rank.

    phylum: each species counts once, for its smallest (phylum, domain); family: distinct species
    per base family; genus: distinct species per lettered genus, then summed per base genus.
    """
    out = f"{rank}_species_count"
    rows = ranks.where(F.col(rank).isNotNull() & F.col("species").isNotNull())
    base = nm.strip_variant_suffix(rank).alias(rank)
    if rank == "phylum":
        once = rows.groupBy("species").agg(F.min(F.struct("phylum", "domain")).alias("p"))
        return once.groupBy(
            nm.strip_variant_suffix(F.col("p.phylum")).alias("phylum"), F.col("p.domain").alias("domain")
        ).agg(F.count("*").alias(out))
    key = rank if rank == "genus" else base
    distinct = rows.select(key, "domain", "species").distinct()
    return distinct.groupBy(nm.strip_variant_suffix(rank).alias(rank), "domain").agg(F.count("*").alias(out))


def merge_variants(counts: DataFrame, rank: str, count_col: str) -> DataFrame:
    """Counts summed per base name and domain, with the number of variants."""
    return counts.groupBy(nm.strip_variant_suffix(rank).alias(rank), "domain").agg(
        F.sum(count_col).alias(count_col), F.count("*").alias("variants")
    )


def variant_members(rows: DataFrame, rank: str, accession: str = "accession_clean") -> DataFrame:
    """Accession list of each merged name in long form: one row per accession.

    A list cell per name would gather the largest phylum in one task.
    """
    return rows.select(
        nm.strip_variant_suffix(rank).alias(rank), "domain", accession, F.col(rank).alias("variant")
    )


def species_taxid_listing(assemblies: DataFrame, species_names: DataFrame) -> DataFrame:
    """Records per species taxid with its name."""
    counts = assemblies.where("species_taxid is not null").groupBy("species_taxid").agg(
        F.count("taxid").alias("total_records")
    )
    names = species_names.groupBy(F.col("taxid").alias("species_taxid")).agg(
        F.min("name").alias("species_name")
    )
    return counts.join(names, "species_taxid", "left")


def species_profile(df: DataFrame) -> DataFrame:
    """Per species: genomes, isolates, size, gc and date ranges, first organism name by accession."""
    isolate = F.coalesce(F.col("isolate"), F.lit("")) != ""
    return df.where("species_taxid is not null").groupBy("species_taxid").agg(
        F.min_by("organism_name", F.struct("assembly_accession", "organism_name"))
        .alias("representative_organism_name"),
        F.count_if(isolate).alias("isolate_count"),
        F.count_if(~isolate).alias("uncultured_count"),
        F.count("assembly_accession").alias("total_genomes"),
        F.avg("genome_size").alias("mean_genome_size"),
        F.stddev_samp("genome_size").alias("std_genome_size"),
        F.min("genome_size").alias("min_genome_size"),
        F.max("genome_size").alias("max_genome_size"),
        F.avg("gc_percent").alias("mean_gc_percent"),
        F.stddev_samp("gc_percent").alias("std_gc_percent"),
        F.min("seq_rel_date").alias("earliest_date"),
        F.max("seq_rel_date").alias("latest_date"),
    )


def attach_rank_maps(stats: DataFrame, maps: dict[str, DataFrame], key: str = "species_taxid") -> DataFrame:
    """Left join of each rank map; the domain comes from the first map that has one."""
    out = stats
    for rank, table in maps.items():
        unique = first_per_key(table.select("taxid", rank, "domain"), ["taxid"], [rank, "domain"])
        out = out.join(
            unique.select(F.col("taxid").alias(key), rank, F.col("domain").alias(f"_d_{rank}")), key, "left"
        )
    domains = [F.col(f"_d_{r}") for r in maps]
    return out.withColumn("domain", F.coalesce(*domains)).drop(*[f"_d_{r}" for r in maps])


def isolate_share_of_database(accessions: DataFrame, subset: DataFrame, merged: DataFrame, taxon: str,
                              db: str = "ncbi") -> DataFrame:
    """Isolate genomes and isolate species of each merged taxon against database totals."""
    is_isolate = F.col("genome_source") == "isolate"
    g = accessions.groupBy(F.col(taxon).alias("taxon_name")).agg(
        F.count("*").alias("total_genome_count"), F.count_if(is_isolate).alias("isolate_count")
    )
    s = subset.groupBy(F.col(taxon).alias("taxon_name")).agg(
        F.count_if(is_isolate).alias("isolate_species_count")
    )
    all_genomes = accessions.agg(F.count("*").cast("double")).scalar()
    all_species = subset.agg(F.count("*").cast("double")).scalar()
    out = merged.join(g, "taxon_name", "left").join(s, "taxon_name", "left").fillna(
        0, ["total_genome_count", "isolate_count", "isolate_species_count"]
    )

    def pct(col, total):
        return F.when(total > 0, round_even(F.col(col) / total * 100, 2)).otherwise(0.0)

    return out.withColumns({
        "isolate_genome_percentage": pct("isolate_count", all_genomes),
        "dataset_genome_percentage": pct(f"{db}_genome_count", all_genomes),
        "isolate_species_percentage": pct("isolate_species_count", all_species),
        "dataset_species_percentage": pct(f"{db}_species_count", all_species),
    })
