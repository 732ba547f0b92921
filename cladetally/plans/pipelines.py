"""The ten pipelines: DataFrames in, DataFrames out.

Taxon-level tables that a pipeline reads several times are written once to the session's shared
folder, so the large inputs are scanned once. Everything else stays lazy.
"""

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from cladetally.functions import classify as cl
from cladetally.functions import fixed_values as fv
from cladetally.functions import lineages as ln
from cladetally.functions import names as nm
from cladetally.functions import predicates as pr
from cladetally.functions.common import exact_mean
from cladetally.operators import anchor, census as ce, figures as fg, genomes as ge
from cladetally.operators import keyed as ky, matching as mt, quality as qu, taxonomy as tx
from cladetally.operators.quantiles import exact_quantiles
from cladetally.session import materialize


class Outputs(Mapping):
    """Named tables of a pipeline; each is built when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


# --- census by rank ----------------------------------------------------------------------------
def census(clusters: DataFrame, names: DataFrame, lineages: DataFrame, gene: str) -> dict[str, DataFrame]:
    """Census table of each rank with taxid, shares and lineage, keyed by rank; `unmapped` holds
    the names without taxid or lineage.

    Names of all ranks are resolved together, once.
    """
    ranks = ce.RANKS_16S if gene == "16s" else ce.RANKS_18S
    counted = materialize(ce.census_all_ranks(clusters, gene))
    if gene == "16s":
        counted = ce.fitting_names(counted)
    by_rank = {r: counted.where(F.col("rank") == r).drop("rank") for r in ranks}
    every = ky.distinct_names(by_rank.values(), "taxon")
    ladder = tx.ladder_16s("taxon") if gene == "16s" else tx.ladder_18s("taxon")
    resolved = materialize(
        tx.resolve_names(every, names, "taxon", tx.variants_of(ladder)).select("taxon", "taxid")
    )
    out, stacked = {}, []
    for rank, table in by_rank.items():
        totals = by_rank["phylum"] if gene == "16s" else table
        mapped = ce.with_database_shares(table, totals).join(resolved, "taxon", "left")
        stacked.append(mapped.withColumn("rank", F.lit(rank)))
        full = tx.with_lineage(mapped, lineages)
        out[rank] = full.withColumn("lineage", ln.append_original("lineage", "taxon", "taxid"))
    clean = nm.clean_organelle_name if gene == "16s" else nm.clean_taxon_name
    lost = ce.unmapped_names(ky.union_all(*stacked), lineages)
    out["unmapped"] = lost.withColumns({
        "cleaned_name": clean("taxon"),
        "appropriate_name": ce.appropriate_names("rank", "taxon") if gene == "16s" else F.col("taxon"),
    })
    return out


def export_census(table: DataFrame, with_shares: bool) -> DataFrame:
    """Column layout of a census file, ordered by OTUs."""
    shares = ["otu_percentage", "size_percentage"] if with_shares else []
    return table.orderBy(F.desc("otu_count"), "taxon").select(
        F.col("taxon").alias("Name_to_use"), tx.as_taxid_text("taxid").alias("taxid"),
        "otu_count", *shares[:1], "size_count", *shares[1:], *ln.lineage_texts("lineage"),
    )


# --- taxid to rank map ---------------------------------------------------------------------------
def taxid_rank_map(assemblies: DataFrame, nodes: DataFrame, names: DataFrame, rank: str,
                   lineages: DataFrame | None = None, subfamily_fallback: bool = False):
    """`(mapped, unmapped)` of the assembly taxids at a rank."""
    if lineages is None:
        lineages = tx.build_lineages(nodes, names)
    return tx.map_taxids_to_rank(assemblies, lineages, rank, subfamily_fallback)


# --- catalogue counts ------------------------------------------------------------------------------
def ncbi_counts(assemblies: DataFrame, rank_map: DataFrame, names: DataFrame, lineages: DataFrame,
                rank: str) -> tuple[DataFrame, DataFrame]:
    """`(counts, accessions)` of a rank."""
    rank_map = ge.unique_ranks(rank_map)
    per_taxid = ge.attach_rank(ge.genomes_per_taxid(assemblies), rank_map)
    full = tx.with_species_taxid(per_taxid, lineages)
    counted = materialize(ge.genome_and_species_counts(full, rank, "genomes"))
    counts = ge.with_shares(counted, rank)
    classified = ge.attach_rank(assemblies.drop(rank, "domain"), rank_map).withColumn(
        "genome_source", cl.genome_source("organism_name", "excluded_from_refseq")
    )
    named = tx.with_lineage(tx.name_to_taxid(counts, names, rank), lineages)
    accessions = classified.select(
        F.col("assembly_accession").alias("accession_clean"), rank, "domain", "organism_name",
        "assembly_level", "genome_source", "taxid",
    )
    return named.orderBy(F.desc(f"{rank}_genome_count"), rank, "domain"), accessions


def _gtdb_ranks(taxonomy: DataFrame, rank: str) -> DataFrame:
    return ge.gtdb_ranks(taxonomy, "Unclassified" if rank == "phylum" else None)


def _gtdb_counts(ranks: DataFrame, rank: str, catalogues, lineages) -> DataFrame:
    counts = ge.gtdb_genome_counts(ranks, rank)
    found = tx.resolve_with_fallback(counts, rank, catalogues)
    parts = [
        found.where(F.col("taxid_source") == label).join(lineages[label], "taxid", "left")
        for label, _ in catalogues
    ]
    none = found.where(F.col("taxid_source") == "none").withColumn(
        "lineage", F.lit(None).cast(ln.LINEAGE_TYPE)
    )
    full = ky.union_all(*parts, none).withColumn("lineage", ln.truncate_lineage("lineage", rank))
    if rank == "phylum":
        return full
    return tx.merge_by_last_taxid(full, rank, f"{rank}_counts")


def gtdb_counts(taxonomy: DataFrame, rank: str, catalogues: list[tuple[str, DataFrame]],
                lineages: dict[str, DataFrame]) -> DataFrame:
    """Genome counts per rank with taxid and lineage cut to the rank, merged by last taxid.

    `catalogues` are tried in order for a taxid; the lineage comes from the one that had it.
    """
    return _gtdb_counts(_gtdb_ranks(taxonomy, rank), rank, catalogues, lineages)


def gtdb_species(taxonomy: DataFrame, rank: str) -> DataFrame:
    return ge.gtdb_species_counts(_gtdb_ranks(taxonomy, rank), rank)


def gtdb_catalogue(taxonomy: DataFrame, rank: str, catalogues: list[tuple[str, DataFrame]],
                   lineages: dict[str, DataFrame]) -> Outputs:
    """The whole chain of a rank over one stored table of ranks: names whose higher ranks disagree, genome
    counts with taxid and lineage, species counts."""
    ranks = materialize(_gtdb_ranks(taxonomy, rank))
    return Outputs({
        "conflicts": lambda: qu.hierarchy_conflicts(ranks),
        "counts": lambda: _gtdb_counts(ranks, rank, catalogues, lineages),
        "species": lambda: ge.gtdb_species_counts(ranks, rank),
    })


# --- EukProt lineages --------------------------------------------------------------------------------
def eukprot_lineages(meta: DataFrame, names: DataFrame, nodes: DataFrame, lineages: DataFrame) -> DataFrame:
    """Taxid, match type and full lineage of every EukProt name."""
    resolved = tx.resolve_eukprot(meta, names, nodes)
    full = tx.with_lineage(resolved, lineages)
    rooted = ln.drop_root("lineage")
    return full.select(
        "name_to_use", "taxid", "match_type",
        F.array_join("tail", ";").alias("remaining_lineage"),
        ln.extend_with_species(rooted, "match_type", "name_to_use", "tail").alias("lineage"),
    )


# --- census x catalogue ---------------------------------------------------------------------------------
@dataclass
class Merged:
    table: DataFrame
    summarise: Callable[[], DataFrame]
    match_log: DataFrame

    @property
    def summary(self) -> DataFrame:
        return self.summarise()


def merge_census(census_rows: DataFrame, catalogue: DataFrame, gene: str, db: str, level: str) -> Merged:
    """Merge of one rank. `catalogue` has the columns `operators.matching` names.

    16S NCBI: prokaryote rows without candidate and `.U.` names, eukaryote groups left out of the
    census, matches by lineage or taxid. 16S GTDB: prokaryote rows without candidate names, lineage
    only, genome counts serve as species counts. 18S NCBI: eukaryote rows, lineage only, isolate
    share over all matched genomes, catalogue rows without counts kept.
    """
    by_taxid, isolate_rule, with_data_only = False, "isolate_taxa", True
    if gene == "16s":
        cat = catalogue.where(pr.is_prokaryote("domain") & ~pr.is_candidate_name("taxon"))
        rows = census_rows.where(~pr.is_eukaryote_group("taxon"))
        by_taxid = db == "ncbi"
        if db == "gtdb":
            cat = cat.withColumn("species", F.col("genomes"))
        else:
            cat = cat.where(~pr.is_unclassified_name("taxon"))
    else:
        cat, rows = catalogue.where(pr.is_eukaryote("domain")), census_rows
        isolate_rule, with_data_only = "all_matched", False
    rows, cat = materialize(rows), materialize(cat)
    merged = materialize(mt.merge_with_catalogue(rows, cat, db, by_taxid, isolate_rule, with_data_only))
    return Merged(
        table=ky.sort_matched_first(merged, f"{db}_genome_count", "taxon"),
        summarise=lambda: mt.merge_summary(merged, level, db),
        match_log=mt.match_pairs(rows, cat, by_taxid),
    )


def merge_census_with_members(census_rows: DataFrame, members: DataFrame, level: str,
                              db: str = "eukprot") -> Merged:
    """EukProt variant: distinct organism names instead of counts."""
    rows = census_rows.where(pr.is_clean_name("taxon"))
    rows, kept = materialize(rows), members.where(pr.is_clean_name("name"))
    merged = materialize(mt.merge_with_members(rows, kept, db))
    pairs = kept.select("name", F.explode("parts").alias("taxon")).join(
        rows.select("taxon"), "taxon", "left_semi").distinct()
    return Merged(
        table=ky.sort_matched_first(merged, f"{db}_species_count", "taxon"),
        summarise=lambda: coverage_summary(merged, level, f"{db}_species_count"),
        match_log=pairs,
    )


def coverage_summary(merged: DataFrame, level: str, species: str) -> DataFrame:
    """Taxa with species, their share, mean and median coverage."""
    counted = materialize(merged.groupBy("coverage_percentage", (F.col(species) > 0).alias("hit")).agg(
        F.count("*").alias("n")
    ))
    median = exact_quantiles(counted, "coverage_percentage", [0.5], n="n").scalar()
    return counted.agg(
        F.lit(level).alias("level"), F.sum("n").alias("total_taxa"),
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("taxa_with_species"),
        exact_mean("coverage_percentage", 2, "n").alias("mean_coverage"),
    ).withColumn("median_coverage", median[0]).withColumn(
        "coverage_pct", F.col("taxa_with_species") / F.col("total_taxa") * 100)


# --- two catalogues --------------------------------------------------------------------------------------
@dataclass
class Anchored:
    table: DataFrame
    unverified: DataFrame


def triple_anchor(counts_a: DataFrame, counts_b: DataFrame, acc_a: DataFrame, acc_b: DataFrame,
                  assemblies: DataFrame, lineages: DataFrame, rank: str = "phylum",
                  compat: bool = False) -> Anchored:
    """Reconciled taxa of two catalogues and the names that could not be verified."""
    summary = materialize(anchor.apply_anchors(counts_a, counts_b, acc_a, acc_b))
    suspicious = anchor.suspicious_taxa(summary)
    checked = anchor.verified_taxa(suspicious, acc_a, assemblies, lineages, rank, compat=compat)
    kept, moved = anchor.split_verified(summary, checked)
    return Anchored(
        table=anchor.without_candidates(kept).orderBy("database_presence", "taxon"), unverified=moved
    )


def export_anchored(table: DataFrame, rank: str) -> DataFrame:
    """Column layout of a reconciliation file."""
    return table.select(
        F.col("taxon").alias(rank.capitalize()), *[F.col(c).alias(label) for c, label in fv.RECONCILIATION_LABELS.items()]
    )


# --- census quality ----------------------------------------------------------------------------------------
def census_quality(clusters: DataFrame) -> Outputs:
    combos = materialize(ce.taxonomic_combinations(clusters))
    plain = combos.drop("example_centroids")
    return Outputs({
        "combinations": lambda: ky.order_by_group_block(combos, "division", "row_count", ["taxonomic_combination"]),
        "patterns": lambda: ce.unclassified_patterns(plain),
        "classification_rates": lambda: ce.classification_rates(plain),
        "unclassified_by_rank": lambda: ce.unclassified_by_rank(clusters),
        "unclassified_lineages": lambda: ky.union_all(*[
            ce.unclassified_lineages(clusters, r).withColumn("level", F.lit(r)) for r in ce.RANKS_18S
        ]),
        "distribution": lambda: ce.distribution_stats(plain, ["row_count", "total_size", "avg_size_per_cluster"]),
        "outliers": lambda: ce.iqr_outliers(plain, "row_count"),
        "division_sizes": lambda: ce.division_size_stats(plain),
    })


# --- species report ---------------------------------------------------------------------------------------------
def species_report(assemblies: DataFrame, rank_maps: dict[str, DataFrame]) -> Outputs:
    ranks = ["domain", *rank_maps]
    profile = materialize(ge.species_profile(assemblies))
    stats = materialize(ge.attach_rank_maps(profile, rank_maps))
    return Outputs({
        "species": lambda: stats,
        "bins": lambda: qu.genomes_per_species_bins(profile),
        "coverage": lambda: qu.rank_coverage(stats, ranks),
        "top_taxa": lambda: qu.rank_top_taxa(stats, ranks),
        "anomalies": lambda: qu.species_anomalies(stats, ranks),
        "source_mix": lambda: qu.species_source_mix(profile),
        "distribution": lambda: ce.distribution_stats(profile, ["total_genomes", "mean_genome_size", "mean_gc_percent"]),
    })


# --- figure tables ------------------------------------------------------------------------------------------------
FIGURE_MEASURES = {
    "NCBI_Total_Genomes": "ncbi_genome_count", "Census_Sequences": "census_size_count",
    "Census_OTUs": "census_otu_count", "NCBI_Total_Species": "ncbi_species_count",
}


def figure_rows(merged: DataFrame) -> DataFrame:
    """Rows a figure draws: matched taxa with census and species counts."""
    return merged.where(pr.is_figure_row("match_status", ["census_otu_count", "ncbi_species_count"]))


def scatter_table(merged: DataFrame, phyla: DataFrame | None = None, n: int = 10) -> DataFrame:
    """Scatter source: circle size, phylum (renamed to the current figure spelling), top flags.

    `phyla` is `(taxon, lineage)`; without it the taxon itself is the phylum.
    """
    rows = figure_rows(merged)
    if phyla is None:
        rows = rows.withColumn("phylum", F.col("taxon"))
    else:
        known = ky.first_per_key(
            phyla.select("taxon", ln.name_at_rank("lineage", "phylum").alias("phylum")), ["taxon"], ["phylum"]
        )
        rows = rows.join(known, "taxon").where(pr.is_known_division("phylum"))
    rows = rows.withColumns({
        "phylum": nm.canonical_name("phylum", fv.CANONICAL_PHYLA),
        "circle_size": cl.isolate_circle_size("isolate_count", "ncbi_genome_count"),
    })
    flagged = ky.flag_top(rows, "novelty_factor", "taxon", n, "is_top_novelty")
    return ky.flag_top(flagged, "overrepresentation_factor", "taxon", n, "is_top_coverage")


def alluvial_table(merged: DataFrame, n: int = 12) -> DataFrame:
    """Top taxa by census sequences plus `Other`, one row per axis."""
    rows = merged.where(F.col("match_status") == "matched")
    top = ky.top_with_other(rows, "taxon", list(FIGURE_MEASURES.values()), "census_size_count", n)
    return ky.long_axes(top, "taxon", FIGURE_MEASURES)


def figure_tables(merged: DataFrame, phyla: DataFrame | None = None) -> dict[str, DataFrame]:
    merged = materialize(merged)
    axes = materialize(alluvial_table(merged))
    return {
        "scatter": scatter_table(merged, phyla),
        "alluvial": axes,
        "labels": ky.label_positions(axes),
        "links": ky.axis_links(axes, "taxon"),
        "ratios": fg.genome_isolate_ratio(merged, "ncbi_genome_count", "isolate_count"),
    }


def top_novel_taxa(merged: DataFrame, k: int = 10) -> DataFrame:
    """Census taxa with most OTUs per catalogue species, matched taxa only."""
    rows = merged.where(F.col("match_status") == "matched")
    return ky.top_list(rows, "novelty_factor", k, ["taxon"])
