"""Census tables and their quality tables."""

from pyspark.sql import DataFrame, Window as W, functions as F

from cladetally.functions import names as nm
from cladetally.functions.classify import unclassified_pattern
from cladetally.functions.common import contains_any, percent, round_even, strip
from cladetally.functions.predicates import is_named
from cladetally.operators.keyed import smallest_per_key, top_per_key, union_all
from cladetally.operators.quantiles import exact_quantiles
from cladetally.session import materialize

RANKS_16S = ["phylum", "family", "genus"]
RANKS_18S = ["division", "family", "genus"]


def census_by_rank(clusters: DataFrame, rank: str, gene: str) -> DataFrame:
    """`(taxon, otu_count, size_count)` of one rank.

    16S: a missing size counts 1, names too fine for the rank are left out. 18S: null names are
    left out, clusters without a centroid do not count as OTUs.
    """
    if gene == "16s":
        kept = clusters.where(is_named(rank))
        otus, sizes = F.count("*"), F.sum(F.coalesce("size", F.lit(1)))
    else:
        kept = clusters.where(F.col(rank).isNotNull())
        otus, sizes = F.count("centroid"), F.coalesce(F.sum("size"), F.lit(0))
    out = kept.groupBy(F.col(rank).alias("taxon")).agg(otus.alias("otu_count"), sizes.alias("size_count"))
    return out.where(nm.is_appropriate_for(F.lit(rank), "taxon")) if gene == "16s" else out


def census_all_ranks(clusters: DataFrame, gene: str) -> DataFrame:
    """`(rank, taxon, otu_count, size_count)` of all ranks in one scan of the clusters.

    16S names are not yet filtered: store this table, then apply `fitting_names`, so that the name
    rules run once per distinct name and not once per cluster.
    """
    ranks = RANKS_16S if gene == "16s" else RANKS_18S
    if gene == "16s":
        otu, size, kept = F.lit(1), F.coalesce("size", F.lit(1)), is_named("taxon")
    else:
        otu = F.col("centroid").isNotNull().cast("int")
        size, kept = F.coalesce("size", F.lit(0)), F.col("taxon").isNotNull()
    long = clusters.select(otu.alias("_otu"), size.alias("_size"), F.inline(F.array(*[
        F.struct(F.lit(r).alias("rank"), F.col(r).alias("taxon")) for r in ranks
    ])))
    return long.where(kept).groupBy("rank", "taxon").agg(
        F.sum("_otu").alias("otu_count"), F.sum("_size").alias("size_count")
    )


def fitting_names(census: DataFrame) -> DataFrame:
    """16S census rows whose name is not finer than its rank."""
    return census.where(nm.is_appropriate_for("rank", "taxon"))


def appropriate_names(rank: str, taxon: str):
    """Lookup name of each row at the rank its row names."""
    ranks = F.col(rank)
    out = F.when(ranks == RANKS_16S[0], nm.appropriate_rank_name(taxon, RANKS_16S[0]))
    for r in RANKS_16S[1:]:
        out = out.when(ranks == r, nm.appropriate_rank_name(taxon, r))
    return out


def with_database_shares(census: DataFrame, totals_from: DataFrame) -> DataFrame:
    """OTU and size percentages against the totals of `totals_from`.

    16S tables of every rank use the phylum table; 18S tables use their own rank.
    """
    total = totals_from.agg(
        F.struct(F.sum("otu_count").cast("double").alias("o"), F.sum("size_count").cast("double").alias("s"))
    ).scalar()
    return census.withColumns({
        "otu_percentage": round_even(percent("otu_count", total.getField("o")), 2),
        "size_percentage": round_even(percent("size_count", total.getField("s")), 2),
    })


def example_values(df: DataFrame, keys: list[str], value: str, k: int = 3, out: str = "examples") -> DataFrame:
    """Smallest k distinct values per key, joined with `; `."""
    return smallest_per_key(df, keys, value, k, out).withColumn(out, F.array_join(out, "; "))


def taxonomic_combinations(clusters: DataFrame, ranks=RANKS_18S, examples: bool = True) -> DataFrame:
    """Clusters and sequences per rank combination; nulls read as `NA`."""
    rows = clusters.select(
        *[F.coalesce(r, F.lit("NA")).alias(r) for r in ranks],
        F.coalesce("size", F.lit(0)).alias("size"),
        F.coalesce("centroid", F.lit("NA")).alias("centroid"),
    )
    out = rows.groupBy(*ranks).agg(
        F.count("*").alias("row_count"), F.sum("size").alias("total_size")
    ).withColumn("avg_size_per_cluster", round_even(F.col("total_size") / F.col("row_count"), 2))
    out = out.withColumn("taxonomic_combination", F.concat_ws("|", *ranks))
    if examples:
        out = out.join(example_values(rows, list(ranks), "centroid", 3, "example_centroids"), list(ranks))
    return out


def unclassified_patterns(combinations: DataFrame) -> DataFrame:
    """Combinations, clusters and sequences per `.U.` pattern with their shares.

    There are five patterns, so the totals are a window over five rows.
    """
    grouped = combinations.groupBy(
        unclassified_pattern("division", "family", "genus").alias("pattern")
    ).agg(
        F.count("*").alias("combinations"),
        F.sum("row_count").alias("clusters"),
        F.sum("total_size").alias("sequences"),
    )
    every = W.partitionBy(F.lit(1))
    return grouped.withColumns({
        f"{c}_pct": round_even(percent(c, F.sum(c).over(every)), 1)
        for c in ("combinations", "clusters", "sequences")
    })


def classification_rates(combinations: DataFrame) -> DataFrame:
    """Fully classified share of each base division, by three measures."""
    full = unclassified_pattern("division", "family", "genus") == "fully_classified"
    out = combinations.groupBy(nm.base_group("division").alias("base_division")).agg(
        F.count("*").alias("total_combinations"),
        F.count_if(full).alias("classified_combinations"),
        F.sum("row_count").alias("total_clusters"),
        F.sum(F.when(full, F.col("row_count")).otherwise(0)).alias("classified_clusters"),
        F.sum("total_size").alias("total_sequences"),
        F.sum(F.when(full, F.col("total_size")).otherwise(0)).alias("classified_sequences"),
    ).withColumnRenamed("base_division", "division")
    return out.withColumns({
        "combination_classification_rate": round_even(percent("classified_combinations", "total_combinations"), 1),
        "cluster_classification_rate": round_even(percent("classified_clusters", "total_clusters"), 1),
        "sequence_classification_rate": round_even(percent("classified_sequences", "total_sequences"), 1),
    })


def unclassified_by_rank(clusters: DataFrame, ranks=RANKS_18S) -> DataFrame:
    """Classified and `.U.` entries of each rank in one pass over the clusters."""
    long = clusters.select(F.coalesce("size", F.lit(0)).alias("size"), F.inline(F.array(*[
        F.struct(F.lit(r).alias("taxonomic_level"), F.col(r).alias("name")) for r in ranks
    ])))
    unclassified = F.coalesce(F.col("name").contains(".U."), F.lit(False))
    grouped = long.groupBy(
        "taxonomic_level",
        F.when(unclassified, "unclassified (.U.)").otherwise("classified").alias("classification_status"),
    ).agg(F.count("*").alias("entry_count"), F.sum("size").alias("sequence_count"))
    level = W.partitionBy("taxonomic_level")  # two rows each
    return grouped.withColumns({
        "entry_percentage": round_even(percent("entry_count", F.sum("entry_count").over(level)), 1),
        "sequence_percentage": round_even(percent("sequence_count", F.sum("sequence_count").over(level)), 1),
    })


def unclassified_lineages(clusters: DataFrame, rank: str, ranks=RANKS_18S) -> DataFrame:
    """Per `.U.` name and rank signature: clusters, sequences, up to three example centroids."""
    rows = clusters.where(F.col(rank).contains(".U.")).select(
        F.col(rank).alias("unclassified_name"),
        F.concat_ws("|", *[F.coalesce(r, F.lit("nan")) for r in ranks]).alias("lineage_signature"),
        F.coalesce("size", F.lit(0)).alias("size"), "centroid",
    )
    keys = ["unclassified_name", "lineage_signature"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("count"), F.sum("size").alias("sequence_count"))
    return counts.join(example_values(rows, keys, "centroid", 3, "example_centroids"), keys, "left")


def distribution_stats(df: DataFrame, measures: list[str], by: list[str] | None = None) -> DataFrame:
    """mean, median, std, min, max, q25, q75 of each measure; the quantiles are exact."""
    by = by or []
    long = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures
    ])))
    counted = materialize(long.where("value is not null").groupBy(*by, "measure", "value").agg(F.count("*").alias("_n")))
    v, n = F.col("value"), F.col("_n")
    keys = [*by, "measure"]
    stats = counted.groupBy(*keys).agg(
        F.sum(n).alias("n"), (F.sum(v * n) / F.sum(n)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
    )
    spread = counted.join(stats.select(*keys, "mean"), keys).groupBy(*keys).agg(
        F.sum(n * F.pow(v - F.col("mean"), F.lit(2.0))).alias("_ss")
    )
    q = exact_quantiles(counted, "value", [0.25, 0.5, 0.75], keys, "_n", "_q")
    return stats.join(spread, keys).join(q, keys).select(
        *by, "measure", "n", "mean", F.col("_q")[1].alias("median"),
        F.when(F.col("n") > 1, F.sqrt(F.col("_ss") / (F.col("n") - 1))).alias("std"),
        "min", "max", F.col("_q")[0].alias("q25"), F.col("_q")[2].alias("q75"),
    )


def iqr_outliers(df: DataFrame, measure: str) -> DataFrame:
    """Rows outside q1 - 1.5 IQR .. q3 + 1.5 IQR, with the bounds."""
    q = exact_quantiles(df, measure, [0.25, 0.75]).scalar()
    iqr = q[1] - q[0]
    return df.withColumns({
        "lower_bound": q[0] - iqr * 1.5, "upper_bound": q[1] + iqr * 1.5
    }).where((F.col(measure) < F.col("lower_bound")) | (F.col(measure) > F.col("upper_bound")))


def division_size_stats(combinations: DataFrame) -> DataFrame:
    """Sums, means and medians per base division."""
    rows = combinations.withColumn("base", nm.base_group("division"))
    sums = rows.groupBy("base").agg(
        F.count("*").alias("combinations"),
        F.sum("row_count").alias("total_clusters"),
        F.sum("total_size").alias("total_sequences"),
    )
    stats = distribution_stats(rows, ["row_count", "total_size", "avg_size_per_cluster"], ["base"])
    wide = stats.groupBy("base").agg(
        *[F.max(F.when(F.col("measure") == m, F.col(s))).alias(out) for m, s, out in [
            ("row_count", "mean", "avg_clusters_per_combination"),
            ("total_size", "mean", "avg_sequences_per_combination"),
            ("avg_size_per_cluster", "mean", "avg_size_per_cluster"),
            ("row_count", "median", "median_clusters"),
            ("total_size", "median", "median_sequences"),
            ("avg_size_per_cluster", "median", "median_avg_size"),
        ]]
    )
    return sums.join(wide, "base").withColumnRenamed("base", "division")


NAME_PATTERNS = {
    "Candidatus": lambda c: c.contains("Candidatus"),
    "Organelles": lambda c: contains_any(
        c, ["Mitochondria", "Chloroplast", "Apicoplast", "Plastid", ":plas", ":mito", ":api"]),
    "Uncultured": lambda c: F.lower(c).contains("uncultured"),
    "Environmental": lambda c: contains_any(F.lower(c), ["metagenome", "environmental", "marine"]),
    "Species_level": lambda c: c.contains("_") & ~c.contains("."),
    "Unclassified": lambda c: F.lower(c).contains("unclassified"),
    "Group_taxa": lambda c: contains_any(c, ["Group", "group"]),
}


def unmapped_names(census: DataFrame, lineages: DataFrame) -> DataFrame:
    """Names without a taxid or whose taxid has no lineage, with the reason."""
    known = lineages.select("taxid", F.lit(True).alias("_known"))
    out = census.join(known, "taxid", "left").where("taxid is null or _known is null")
    reason = F.when(F.col("taxid").isNull(), "NO_TAXID_FOUND").otherwise("TAXID_NO_LINEAGE")
    return out.withColumn("reason", reason).drop("_known")


def mapping_rates(census: DataFrame) -> DataFrame:
    """Mapped and unmapped names per rank, and over all ranks."""
    rates = census.rollup("rank").agg(
        F.count("*").alias("total"), F.count("taxid").alias("mapped")
    ).withColumn("rank", F.coalesce("rank", F.lit("all")))
    return rates.withColumn("unmapped", F.col("total") - F.col("mapped")).withColumn(
        "unmapped_pct", round_even(percent("unmapped", "total"), 1)
    )


def _with_patterns(unmapped: DataFrame) -> DataFrame:
    hits = F.array_compact(F.array(*[
        F.when(rule(F.col("taxon")), F.lit(label)) for label, rule in NAME_PATTERNS.items()
    ]))
    return unmapped.withColumn("pattern", F.explode(hits))


def unmapped_pattern_counts(unmapped: DataFrame) -> DataFrame:
    """Names, OTUs and sequences per overlapping name pattern; one pass, one small shuffle."""
    return _with_patterns(unmapped).groupBy("pattern").agg(
        F.count("*").alias("names"), F.sum("otu_count").alias("otus"), F.sum("size_count").alias("sequences")
    )


def unmapped_pattern_examples(unmapped: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent names of each pattern."""
    return top_per_key(_with_patterns(unmapped), ["pattern"], [F.desc("otu_count"), "taxon"], k, "position")


def occurrence_across_ranks(by_rank: dict[str, DataFrame]) -> DataFrame:
    """Ranks each name occurs at; its counts come from the highest of them."""
    tagged = union_all(*[
        t.select("taxon", F.lit(i).alias("_order"), F.lit(r).alias("rank"), "otu_count", "size_count")
        for i, (r, t) in enumerate(by_rank.items())
    ])
    top = F.min(F.struct("_order", "otu_count", "size_count"))
    return tagged.groupBy("taxon").agg(
        *[F.bool_or(F.col("rank") == r).alias(f"in_{r}") for r in by_rank],
        top["otu_count"].alias("otu_count"), top["size_count"].alias("size_count"),
    )


def member_counts(members: DataFrame, taxonomy: str, ident: str, position: int) -> DataFrame:
    """Distinct ids per taxon found at a fixed place of a `;` taxonomy (5 = family)."""
    pairs = taxon_members(members, taxonomy, ident, position)
    return pairs.groupBy("taxon").agg(F.count("*").alias("genome_count"))


def taxon_members(members: DataFrame, taxonomy: str, ident: str, position: int) -> DataFrame:
    """Distinct (taxon, id) pairs: the id list of each taxon in long form."""
    part = F.get(F.split(F.col(taxonomy), ";"), F.lit(position - 1))
    taxon = strip(F.replace(part, F.lit("'"), F.lit("")))
    return members.select(taxon.alias("taxon"), F.col(ident).alias("id")).where("taxon is not null").distinct()
