"""Data-quality tables: assignment, anomalies, integrity, agreement."""

from pyspark.sql import DataFrame, Window as W, functions as F

from cladetally.functions import classify as cl
from cladetally.functions import fixed_values as fv
from cladetally.functions import lineages as ln
from cladetally.functions import names as nm
from cladetally.functions.common import percent, round_even
from cladetally.operators.keyed import top_per_key, union_all
from cladetally.session import materialize


def assignment_summary(df: DataFrame, by=None) -> DataFrame:
    """Species assignment counts and shares, overall or per column (level, inferred domain)."""
    status = cl.assignment_status("taxid", "species_taxid")
    keyed = df.withColumn("_status", status)
    if by is not None:
        keyed = keyed.withColumn(by[0], by[1])
    keys = [] if by is None else [by[0]]
    # species made distinct first: a key with most of the rows is reduced before it is counted
    assigned = F.col("_status") == "species_assigned"
    per_species = keyed.groupBy(*keys, F.when(assigned, F.col("species_taxid")).alias("_sp")).agg(
        F.count("*").alias("_n"),
        *[F.count_if(F.col("_status") == s).alias(s) for s in ("species_assigned", "taxid_only", "no_taxid")],
    )
    out = per_species.groupBy(*keys).agg(
        F.sum("_n").alias("total_assemblies"),
        *[F.sum(s).alias(s) for s in ("species_assigned", "taxid_only", "no_taxid")],
        F.count("_sp").alias("unique_species"),
    )
    return out.withColumns({
        "species_assigned_pct": percent("species_assigned", "total_assemblies"),
        "taxid_only_pct": percent("taxid_only", "total_assemblies"),
        "no_taxid_pct": percent("no_taxid", "total_assemblies"),
        "avg_assemblies_per_species": percent("species_assigned", "unique_species") / 100,
    })


def top_problem_organisms(df: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent organism names among rows without a species, per status."""
    rows = df.withColumn("status", cl.assignment_status("taxid", "species_taxid"))
    counts = rows.where(F.col("status") != "species_assigned").where("organism_name is not null").groupBy(
        "status", "organism_name"
    ).agg(F.count("*").alias("n"))
    return top_per_key(counts, ["status"], [F.desc("n"), "organism_name"], k, "rank")


def genomes_per_species_bins(profile: DataFrame) -> DataFrame:
    """Species per bin of genome counts. There are eight bins, so the total is a window over them."""
    every = F.sum("species").over(W.partitionBy(F.lit(1)))
    return profile.groupBy(cl.genome_bin("total_genomes").alias("genomes")).agg(
        F.count("*").alias("species")
    ).withColumn("species_pct", round_even(percent("species", every), 1))


def rank_coverage(stats: DataFrame, ranks) -> DataFrame:
    """Non-empty share and distinct values of each rank, in one long pass."""
    long = stats.select(F.inline(F.array(*[
        F.struct(F.lit(r).alias("rank"), F.nullif(F.col(r), F.lit("")).alias("taxon")) for r in ranks
    ])))
    per_taxon = long.groupBy("rank", "taxon").agg(F.count("*").alias("_n"))
    out = per_taxon.groupBy("rank").agg(
        F.sum("_n").alias("species"),
        F.sum(F.when(F.col("taxon").isNotNull(), F.col("_n")).otherwise(0)).alias("named_species"),
        F.count("taxon").alias("distinct_taxa"),
    )
    return out.withColumn("coverage_pct", round_even(percent("named_species", "species"), 1))


def rank_top_taxa(stats: DataFrame, ranks, measure: str = "total_genomes", k: int = 10) -> DataFrame:
    long = stats.select(F.col(measure), F.inline(F.array(*[
        F.struct(F.lit(r).alias("rank"), F.nullif(F.col(r), F.lit("")).alias("taxon")) for r in ranks
    ])))
    sums = long.where("taxon is not null").groupBy("rank", "taxon").agg(F.sum(measure).alias(measure))
    return top_per_key(sums, ["rank"], [F.desc(measure), "taxon"], k, "position")


def species_anomalies(stats: DataFrame, ranks=()) -> DataFrame:
    """Species per anomaly rule, in one pass; a species can break several rules."""
    lim = fv.ANOMALY_LIMITS
    rules = [
        F.when(F.col("total_genomes") > lim["genomes"], "many_genomes"),
        F.when((F.col("isolate_count") == 0) & (F.col("total_genomes") > lim["uncultured"]), "uncultured_only"),
        F.when(F.col("mean_genome_size") < lim["min_size"], "very_small_genome"),
        F.when(F.col("mean_genome_size") > lim["max_size"], "very_large_genome"),
        *[F.when(F.coalesce(r, F.lit("")) == "", f"missing_{r}") for r in ranks],
    ]
    return stats.withColumn("rule", F.explode(F.array_compact(F.array(*rules)))).select(
        "rule", "species_taxid", "total_genomes", "isolate_count", "mean_genome_size"
    )


def accession_profile(accessions: DataFrame, taxon: str) -> DataFrame:
    """Entries, isolates and uncultured per (domain, taxon), per domain and in total."""
    rows = accessions.groupBy("domain", taxon).agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("genome_source") == "isolate").alias("isolates"),
        F.count_if(F.col("genome_source") == "uncultured").alias("uncultured"),
        F.count_if(F.col("genome_source").isNull()).alias("missing_source"),
    )
    total = rows.rollup("domain", taxon).agg(
        *[F.sum(c).alias(c) for c in ("entries", "isolates", "uncultured", "missing_source")],
        F.grouping_id().alias("level_id"),
    )
    level = F.when(F.col("level_id") == 0, "taxon").when(F.col("level_id") == 1, "domain").otherwise("all")
    return total.withColumn("level", level).drop("level_id")


def accession_summary(accessions: DataFrame, taxon: str) -> DataFrame:
    """Entries, distinct taxa, largest, smallest and mean taxon, missing values, distinct organisms."""
    per_taxon = accessions.groupBy(taxon).agg(
        F.count("*").alias("n"), F.count_if(F.col("genome_source").isNull()).alias("no_source")
    )
    named = F.col(taxon).isNotNull()
    organisms = accessions.select("organism_name").where("organism_name is not null").distinct()
    return per_taxon.agg(
        F.sum("n").alias("total_entries"), F.count(taxon).alias("unique_taxa"),
        F.max(F.when(named, F.col("n"))).alias("largest"), F.min(F.when(named, F.col("n"))).alias("smallest"),
        F.avg(F.when(named, F.col("n"))).alias("mean_entries"),
        F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("missing_taxon"),
        F.sum("no_source").alias("missing_source"),
    ).withColumn("unique_organisms", organisms.agg(F.count("*")).scalar())


def taxa_of_domain(counts: DataFrame, taxon: str, domains=("viruses", "virus")) -> DataFrame:
    """Distinct taxa of a domain with their taxid; of a `[1, 2]` list text the first one."""
    text = F.col("taxid").cast("string")
    listed = F.get(F.from_json(text, "array<bigint>"), F.lit(0))
    taxid = F.when(text.startswith("["), listed).otherwise(text.try_cast("bigint"))
    rows = counts.where(F.lower(F.trim("domain")).isin(*domains))
    return rows.groupBy(F.col(taxon).alias("taxon_name")).agg(F.min(taxid).alias("taxid"))


def species_source_mix(profile: DataFrame) -> DataFrame:
    """Species and genomes by isolate-only, uncultured-only and mixed."""
    mix = (
        F.when(F.col("uncultured_count") == 0, "isolate_only")
        .when(F.col("isolate_count") == 0, "uncultured_only").otherwise("mixed")
    )
    every = W.partitionBy(F.lit(1))  # three rows
    return profile.groupBy(mix.alias("mix")).agg(
        F.count("*").alias("species"), F.sum("total_genomes").alias("genomes")
    ).withColumn("species_pct", round_even(percent("species", F.sum("species").over(every)), 1))


def isolate_field_quality(df: DataFrame) -> DataFrame:
    """Rows, genome sizes and distinct values by state of the isolate field and assembly level."""
    return df.groupBy(cl.isolate_field_state("isolate").alias("isolate_state"), "assembly_level").agg(
        F.count("*").alias("entries"), F.sum("genome_size").alias("_size"),
        F.count("genome_size").alias("_sized"),
    ).withColumn("mean_genome_size", F.col("_size") / F.nullif("_sized", F.lit(0))).drop("_size", "_sized")


def common_isolate_values(df: DataFrame, k: int = 100) -> DataFrame:
    """Most frequent real isolate names."""
    filled = df.where(cl.isolate_field_state("isolate") == "filled")
    counts = filled.groupBy("isolate").agg(F.count("*").alias("entries"))
    return counts.orderBy(F.desc("entries"), "isolate").limit(k)


def unmapped_categories(unmapped: DataFrame, rank: str = "phylum") -> DataFrame:
    """Rows per category and, for the interesting ones, per pattern."""
    category = cl.unmapped_category("lineage", "reason", rank)
    tagged = unmapped.withColumn("category", category)
    pattern = F.when(F.col("category") == "interesting_cases", cl.unmapped_pattern("lineage", rank))
    return tagged.withColumn("pattern", F.coalesce(pattern, F.lit("-"))).groupBy("category", "pattern").agg(
        F.count("*").alias("entries"),
        F.count_if(cl.lacks_phylum_but_has_clade("ranks")).alias("clade_instead_of_phylum"),
    )


def hierarchy_conflicts(ranks: DataFrame, pairs=fv.ADJACENT_RANKS) -> DataFrame:
    """Names with more than one parent at the next rank; one row per (name, parent).

    A rank column that holds only `Unclassified` is skipped, its pair with it.
    """
    links = materialize(ranks.select(F.explode(F.array(*[
        F.struct(F.lit(low).alias("lower_rank"), F.col(low).alias("lower_value"),
                 F.lit(high).alias("higher_rank"), F.col(high).alias("higher_value"))
        for low, high in pairs
    ])).alias("l")).select("l.*").where("lower_value is not null and higher_value is not null").distinct())
    per_name = links.groupBy("lower_rank", "lower_value").agg(
        F.count("*").alias("parents")
    ).where("parents > 1")
    named = links.groupBy("lower_rank").agg(
        F.bool_or(F.col("lower_value") != "Unclassified").alias("_l"),
        F.bool_or(F.col("higher_value") != "Unclassified").alias("_h"),
    ).where("_l and _h").select("lower_rank")
    return links.join(named, "lower_rank", "left_semi").join(per_name, ["lower_rank", "lower_value"])


def map_integrity(taxid_map: DataFrame, nodes: DataFrame, names: DataFrame, metadata: DataFrame) -> DataFrame:
    """Problem rows of a taxid map: accession format, taxid not in nodes or names, accession not
    in the metadata. Anti joins need no distinct right side; leaving it out keeps both sides plain
    shuffles that AQE can split."""
    m = taxid_map.select("accession_clean", F.col("taxid").cast("string").alias("taxid"))
    node_ids = nodes.select(F.col("taxid").cast("string").alias("taxid"))
    name_ids = names.select(F.col("taxid").cast("string").alias("taxid"))
    known = metadata.select("accession_clean")

    def tag(df, label):
        return df.select("accession_clean", "taxid").withColumn("problem", F.lit(label))

    return union_all(
        tag(m.where(~nm.is_valid_accession("accession_clean")), "bad_accession"),
        tag(m.join(node_ids, "taxid", "left_anti"), "taxid_not_in_nodes"),
        tag(m.join(name_ids, "taxid", "left_anti"), "taxid_not_in_names"),
        tag(m.join(known, "accession_clean", "left_anti"), "accession_not_in_metadata"),
    )


def completeness(tables: dict[str, DataFrame], ranks: list[str]) -> DataFrame:
    """Records, missing taxa and a status per source and rank."""
    out = []
    for source, df in tables.items():
        counts = df.agg(
            F.count("*").alias("total_records"),
            *[F.count_if(F.col(r).isNull()).alias(r) for r in ranks],
        )
        out.append(counts.select(
            F.lit(source).alias("source"), "total_records",
            F.inline(F.array(*[
                F.struct(F.lit(r).alias("rank"), F.col(r).alias("missing")) for r in ranks
            ])),
        ))
    stats = union_all(*out).withColumn("missing_pct", percent("missing", "total_records"))
    return stats.withColumn("status", cl.completeness_band("missing_pct")).withColumn(
        "complete_records", F.col("total_records") - F.col("missing")
    )


def catalogue_agreement(a: DataFrame, b: DataFrame, taxon: str = "taxon") -> tuple[DataFrame, DataFrame]:
    """Accession overlap and name agreement of two catalogues, and the rows that disagree."""
    def one(df, name):
        rows = df.select(F.trim("accession_clean").alias("accession_clean"), F.col(taxon).alias(name))
        return rows.where("accession_clean is not null").groupBy("accession_clean").agg(F.min(name).alias(name),
                                                                                       F.lit(True).alias(f"in_{name}"))

    joined = one(a, "a_taxon").join(one(b, "b_taxon"), "accession_clean", "full")
    both = F.col("in_a_taxon") & F.col("in_b_taxon")
    summary = joined.agg(
        F.count("in_a_taxon").alias("a_accessions"),
        F.count("in_b_taxon").alias("b_accessions"),
        F.count_if(both).alias("common"),
        F.count_if(F.col("a_taxon") == F.col("b_taxon")).alias("agree"),
        F.count_if(F.col("a_taxon") != F.col("b_taxon")).alias("disagree"),
    ).withColumns({
        "a_overlap_pct": percent("common", "a_accessions"),
        "b_overlap_pct": percent("common", "b_accessions"),
        "agreement_pct": percent("agree", F.col("agree") + F.col("disagree")),
    })
    return summary, joined.where(F.col("a_taxon") != F.col("b_taxon")).select(
        "accession_clean", "a_taxon", "b_taxon"
    )


def recheck_shares(merged: DataFrame, totals: DataFrame, db: str = "ncbi", tolerance: float = 0.01,
                   taxa: list[str] | None = None) -> DataFrame:
    """Percentages recomputed from raw totals; `ok_*` where the stored value is within tolerance."""
    total = totals.agg(F.struct(F.sum("genomes").alias("g"), F.sum("species").alias("s"))).scalar()
    rows = merged if taxa is None else merged.where(F.col("taxon").isin(taxa))
    checks = {
        "genome_pct_db": percent(f"{db}_genome_count", total.getField("g")),
        "species_pct": percent(f"{db}_species_count", total.getField("s")),
        "isolate_percentage": percent("isolate_count", f"{db}_genome_count"),
    }
    out = rows.withColumns({f"expected_{c}": e for c, e in checks.items()})
    return out.withColumns({
        f"ok_{c}": F.abs(F.col(c) - F.col(f"expected_{c}")) < tolerance for c in checks
    }).select("taxon", *checks, *[f"expected_{c}" for c in checks], *[f"ok_{c}" for c in checks])


def mapping_discrepancies(rank_map: DataFrame, lineages: DataFrame, rank: str) -> DataFrame:
    """Stored rank names that differ from the name in the lineage."""
    found = ln.name_at_rank("lineage", rank)
    return rank_map.join(lineages, "taxid").select(
        "taxid", F.col(rank).alias("expected"), found.alias("found")
    ).where(F.col("found").isNotNull() & (F.col("found") != F.col("expected")))


def mapping_hit_rate(assemblies: DataFrame, rank_map: DataFrame, rank: str) -> DataFrame:
    """Assemblies with and without a rank, and distinct unmapped taxids.

    Assemblies are first counted per taxid, so one species with most genomes joins as one row.
    A taxid with several names counts once.
    """
    per_taxid = assemblies.groupBy("taxid").agg(F.count("*").alias("n"))
    joined = per_taxid.join(rank_map.groupBy("taxid").agg(F.max(rank).alias(rank)), "taxid", "left")
    hit = F.col(rank).isNotNull()
    return joined.agg(
        F.sum("n").alias("total_records"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("mapped_records"),
        F.count_if(~hit).alias("unmapped_taxids"),
    ).withColumn("mapped_pct", percent("mapped_records", "total_records"))


def recheck_in_counts(unmapped: DataFrame, count_tables: dict[str, DataFrame]) -> DataFrame:
    """Unmapped taxids that do occur in a count table of some level."""
    ids = unmapped.select(F.trim(F.col("taxid").cast("string")).alias("taxid")).distinct()
    out = []
    for level, table in count_tables.items():
        known = table.select(F.trim(F.col("taxid").cast("string")).alias("taxid")).where("taxid is not null")
        out.append(ids.join(known.distinct(), "taxid", "left_semi").withColumn("count_level", F.lit(level)))
    return union_all(*out)


def fill_lineage(unmapped: DataFrame, lineages: DataFrame) -> DataFrame:
    """Lineage by taxid, else by species taxid, with the family found."""
    by_id = lineages.select("taxid", F.col("lineage").alias("_l1"))
    by_species = lineages.select(F.col("taxid").alias("species_taxid"), F.col("lineage").alias("_l2"))
    out = unmapped.join(by_id, "taxid", "left").join(by_species, "species_taxid", "left")
    chosen = F.coalesce("_l1", "_l2")
    source = F.when(F.col("_l1").isNotNull(), "taxid").when(F.col("_l2").isNotNull(), "species_taxid")
    return out.withColumns({
        "lineage": ln.lineage_text(chosen), "family_name": ln.name_at_rank(chosen, "family"),
        "lineage_source": F.coalesce(source, F.lit("none")),
    }).drop("_l1", "_l2")


def raw_count_check(merged: DataFrame, raw: DataFrame, taxon: str, ident: str, count_col: str) -> DataFrame:
    """Stored counts against distinct ids of the raw table."""
    actual = raw.where(F.col(ident).isNotNull()).select(F.col(taxon).alias("taxon"), ident).distinct().groupBy(
        "taxon").agg(F.count("*").alias("actual_count"))
    return merged.select("taxon", count_col).join(actual, "taxon", "left").fillna(0, ["actual_count"]).withColumn(
        "difference", F.col(count_col) - F.col("actual_count")
    )
