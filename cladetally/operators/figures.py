"""Tables behind the figures: comparisons, roll-ups, scaled sizes, novel genera."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cladetally.functions import fixed_values as fv
from cladetally.functions.common import exact_mean, literal_map, percent, ratio_or_inf, round_even
from cladetally.functions.measures import fold_change, genomes_per_isolate, representation_bias
from cladetally.operators.keyed import first_per_key, top_k, top_list, union_all
from cladetally.operators.quantiles import exact_quantiles
from cladetally.session import materialize


def presence_overlap(df: DataFrame, a: str, b: str, names=("ncbi", "eukprot")) -> DataFrame:
    """Taxa only in a, in both, only in b, and the sums of both counts."""
    per_taxon = df.groupBy("taxon").agg(F.sum(a).alias("a"), F.sum(b).alias("b"))
    in_a, in_b = F.col("a") > 0, F.col("b") > 0
    return per_taxon.agg(
        F.count_if(in_a & ~in_b).alias(f"only_{names[0]}"),
        F.count_if(in_a & in_b).alias("both"),
        F.count_if(in_b & ~in_a).alias(f"only_{names[1]}"),
        F.sum("a").alias(f"{names[0]}_genomes"), F.sum("b").alias(f"{names[1]}_genomes"),
    )


def reclassification_matrix(pairs: DataFrame, k: int = 10) -> DataFrame:
    """Share of each top-k GTDB family's genomes in each top-k NCBI family, long form.

    `pairs`: family_gtdb, family_ncbi, gtdb_genome_count, ncbi_genome_count.
    """
    per_pair = pairs.groupBy("family_gtdb", "family_ncbi").agg(
        F.sum("gtdb_genome_count").alias("g"), F.sum("ncbi_genome_count").alias("n")
    )
    rows = top_k(per_pair.groupBy("family_gtdb").agg(F.sum("g").alias("g")), "g", k, ["family_gtdb"])
    cols = top_k(per_pair.groupBy("family_ncbi").agg(F.sum("n").alias("n")), "n", k, ["family_ncbi"])
    cells = (
        per_pair.join(rows.select("family_gtdb"), "family_gtdb", "left_semi")
        .join(cols.select("family_ncbi"), "family_ncbi", "left_semi")
    )
    sums = cells.groupBy("family_gtdb").agg(F.sum("g").alias("row_sum"))
    return cells.join(sums, "family_gtdb").select(
        "family_gtdb", "family_ncbi", F.col("g").alias("genomes"),
        (percent("g", "row_sum") / 100).alias("share"),
    )


def matrix_pivot(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Wide matrix for the given column families, zero where a pair is absent."""
    return cells.groupBy("family_gtdb").pivot("family_ncbi", columns).agg(F.sum("share")).fillna(0.0)


def mismatch_percent(pairs: DataFrame) -> DataFrame:
    differs = F.col("family_gtdb") != F.col("family_ncbi")
    return pairs.agg(
        F.sum("gtdb_genome_count").alias("total_genomes"),
        F.sum(F.when(differs, F.col("gtdb_genome_count")).otherwise(0)).alias("mismatched_genomes"),
    ).withColumn("mismatch_pct", percent("mismatched_genomes", "total_genomes"))


def catalogue_fold_change(a: DataFrame, b: DataFrame) -> DataFrame:
    """Genome sums of two catalogues per taxon and log2((b + 1) / (a + 1))."""
    ga = a.groupBy("taxon").agg(F.sum("genomes").alias("a_count"))
    gb = b.groupBy("taxon").agg(F.sum("genomes").alias("b_count"))
    return ga.join(gb, "taxon", "full").fillna(0, ["a_count", "b_count"]).withColumn(
        "fold_change", fold_change("a_count", "b_count")
    )


def correlation_summary(merged: DataFrame, otus: str, species: str, coverage: str) -> DataFrame:
    """Taxa, mean coverage, mean novelty (1 without species) and Pearson correlation."""
    novelty = F.when(F.col(species) > 0, F.col(otus) / F.col(species)).otherwise(1.0)
    return merged.agg(
        F.count("*").alias("total_taxa"), exact_mean(coverage, 2).alias("avg_coverage"),
        F.avg(novelty).alias("avg_novelty"),
        F.corr(F.col(otus).cast("double"), F.col(species).cast("double")).alias("correlation"),
    )


def genome_isolate_ratio(df: DataFrame, genomes: str, isolates: str) -> DataFrame:
    """Genomes per isolate; the largest genome count where there is no isolate."""
    top = df.agg(F.max(genomes).cast("double")).scalar()
    ratio = F.when(F.col(isolates) > 0, F.col(genomes) / F.col(isolates)).otherwise(top)
    return df.withColumn("genome_isolate_ratio", ratio)


def scaled_sizes(df: DataFrame, genomes: str, isolates: str, scale: str = "sqrt") -> DataFrame:
    """Marker size 3..12 from the genome/isolate ratio, square-root or log scaled."""
    ratio = genomes_per_isolate(genomes, isolates)
    raw = F.sqrt(ratio) if scale == "sqrt" else F.log10(ratio)
    sized = df.withColumn("ratio", ratio).withColumn("size_raw", raw)
    span = sized.agg(F.struct(F.min("size_raw").alias("lo"), F.max("size_raw").alias("hi"))).scalar()
    lo, hi = span.getField("lo"), span.getField("hi")
    return sized.withColumn(
        "circle_size", F.when(hi > lo, 3 + (F.col("size_raw") - lo) * 9 / (hi - lo)).otherwise(3.0)
    )


def ratio_quartiles(df: DataFrame, ratio: str = "ratio") -> DataFrame:
    q = F.col("quantiles")
    return exact_quantiles(df, ratio, [0.25, 0.5, 0.75]).select(q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"))


def supergroup_rollup(df: DataFrame, lineage: str, count_col: str, min_pct: float = 5.0) -> DataFrame:
    """Sums per supergroup (third lineage part, the fourth when that is the domain); groups under
    the share become `Others`."""
    parts = F.split(F.col(lineage), ";")
    third = F.get(parts, F.lit(2))
    group = (
        F.when(F.size(parts) < 3, "Other")
        .when(third != "Eukaryota", third)
        .otherwise(F.coalesce(F.get(parts, F.lit(3)), F.lit("Other")))
    )
    sums = df.groupBy(group.alias("supergroup")).agg(F.sum(count_col).alias("n"))
    total = sums.agg(F.sum("n").cast("double")).scalar()
    big = percent("n", total) >= min_pct
    out = sums.groupBy(F.when(big, F.col("supergroup")).otherwise("Others").alias("supergroup")).agg(
        F.sum("n").alias(count_col)
    )
    return out.withColumn("percentage", percent(count_col, total))


def total_representation(df: DataFrame, measures: list[str], k: int) -> DataFrame:
    """Taxa ranked by the sum of their shares of the given measures."""
    total = df.agg(F.struct(*[F.sum(m).cast("double").alias(m) for m in measures])).scalar()
    shares = [percent(m, total.getField(m)) for m in measures]
    out = df.withColumn("total_representation", sum(shares[1:], shares[0]))
    return top_list(out, "total_representation", k, ["taxon"])


def division_override(df: DataFrame, taxon: str = "taxon") -> DataFrame:
    """Division of listed families and genera, `Other` for the rest."""
    found = F.try_element_at(literal_map(fv.DIVISION_OF_TAXON), F.col(taxon))
    return df.withColumn("division", F.coalesce(found, F.lit("Other")))


def representation_flags(merged: DataFrame, species: str, otus: str) -> DataFrame:
    """Presence flags, both ratios and the log2 bias."""
    s, o = F.col(species), F.col(otus)
    return merged.withColumns({
        "in_ncbi": (s > 0).cast("int"), "in_census": (o > 0).cast("int"),
        "in_both": ((s > 0) & (o > 0)).cast("int"),
        "ncbi_to_census_ratio": ratio_or_inf(species, otus),
        "census_to_ncbi_ratio": ratio_or_inf(otus, species),
        "representation_bias": representation_bias(species, otus),
    })


def roll_up_names(df: DataFrame, key: str, sums=(), maxima=(), means=(), first=()) -> DataFrame:
    """One row per name: summed, largest, averaged and first (smallest non-null) columns."""
    return df.groupBy(key).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima],
        *[F.avg(c).alias(c) for c in means], *[F.min(c).alias(c) for c in first],
    )


def gtdb_counts_joined(species: DataFrame, genomes: DataFrame) -> DataFrame:
    """Species counts with the genome count of the same name, zero when absent."""
    g = genomes.groupBy("taxon").agg(F.max("genomes").alias("genomes"))
    return species.select("taxon", "species").join(g, "taxon", "left").fillna(0, ["genomes"])


LISTED_CHARS = 4_000_000


def _hits(rows: DataFrame, texts: str, words: list[str], out: str) -> DataFrame:
    """`rows`, once for each of `words` that one of the texts in array column `texts` holds, named in `out`."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def found(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in words:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for batch in batches:
            held = [sorted({w for t in line or () if t is not None for _, w in automaton.iter(t)})
                    for line in batch.column(texts).to_pylist()]
            at = np.repeat(np.arange(len(held)), [len(h) for h in held])
            hit = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*hit.columns, pa.array([w for h in held for w in h], pa.string())], names=schema.names)

    return rows.mapInArrow(found, schema)


def held_names(rows: DataFrame, texts: list, names: DataFrame, name: str) -> DataFrame:
    """`rows` joined with the rows of `names` whose `name` one of the array columns' texts holds.

    An automaton of the listed names reads each text once and yields its hits only. A list goes to the tasks in
    portions of about LISTED_CHARS characters; the texts are read once for each portion.
    """
    names = materialize(names)
    size = names.agg(F.sum(F.char_length(name))).first()[0] or 0
    portions = 1 + size // LISTED_CHARS
    marked = rows.withColumn("_texts", F.flatten(F.array(*texts)))
    found = []
    for portion in range(portions):
        some = names.where((F.char_length(name) > 0) & (F.pmod(F.xxhash64(name), F.lit(portions)) == portion))
        words = [r[0] for r in some.select(name).distinct().collect()]
        if words:
            found.append(_hits(marked, "_texts", words, name))
    if not found:
        found = [marked.where("false").withColumn(name, F.lit(None).cast("string"))]
    return union_all(*found).drop("_texts").join(names, name)


def genus_parents(top_genera: DataFrame, combinations: DataFrame) -> DataFrame:
    """Family and division of each listed genus: exact name, else a name that contains it, else
    `NOT_FOUND`. Ties go to the combination with most clusters, then its name.
    """
    order = [F.desc("row_count"), "taxonomic_combination"]
    combos = combinations.select("genus", "family", "division", "row_count", "taxonomic_combination")
    listed = top_genera.select("genus").distinct()
    hits = held_names(combos.withColumnRenamed("genus", "_g"), [F.array("_g")], listed, "genus")
    best = first_per_key(hits, ["genus"], [(F.col("_g") != F.col("genus")).cast("int"), *order])
    return top_genera.join(best.select("genus", "family", "division", "row_count"), "genus", "left").withColumns({
        "family": F.coalesce("family", F.lit("NOT_FOUND")),
        "division": F.coalesce("division", F.lit("NOT_FOUND")),
        "combination_row_count": F.coalesce("row_count", F.lit(0)),
    }).drop("row_count")


def family_genera(clusters: DataFrame, families: DataFrame) -> DataFrame:
    """Genera of each listed family: families containing the name, else phylum or genus texts
    containing it. Case is ignored. One row per (listed family, genus).

    Sizes are summed per (phylum, family, genus) first.
    """
    combos = clusters.where("genus is not null").groupBy("phylum", "family", "genus").agg(
        F.sum("size").alias("size")
    )
    listed = families.select(F.col("family").alias("listed_family"), "novelty_factor", F.lower("family").alias("_low"))
    by_family = held_names(combos, [F.array(F.lower("family"))], listed, "_low").withColumn("how", F.lit(0))
    other = held_names(combos, [F.array(F.lower("phylum"), F.lower("genus"))], listed, "_low").withColumn("how", F.lit(1))
    hits = by_family.unionByName(other)
    how = hits.groupBy("listed_family").agg(F.min("how").alias("how"))
    return hits.join(how, ["listed_family", "how"]).groupBy("listed_family", "genus").agg(
        F.max("novelty_factor").alias("novelty_factor"), F.sum("size").alias("size"),
        F.min("phylum").alias("phylum"), F.min("family").alias("family"), F.min("how").alias("how"),
    )


def lineage_members(genera: DataFrame, families: DataFrame, lineage: str = "lineage") -> DataFrame:
    """Genera with a lineage part that contains a listed name, ignoring case."""
    listed = families.select(F.col("family").alias("listed_family"), F.lower("family").alias("_low"))
    parts = F.transform(F.split(F.col(lineage), ";"), lambda p: F.lower(p))
    return held_names(genera, [parts], listed, "_low").drop("_low")


def genus_contribution(members: DataFrame) -> DataFrame:
    """Families of each genus (a listed family at most once), their number and mean factor."""
    grouped = members.groupBy("genus").agg(
        F.array_join(F.array_sort(F.collect_set("listed_family")), "; ").alias("associated_families"),
        F.count("*").alias("number_of_families"),
        exact_mean("novelty_factor", 3).alias("_avg"),
        F.max("size").alias("genus_census_size_count"), F.min("phylum").alias("phylum"),
    )
    return grouped.withColumn("average_family_novelty_factor", round_even("_avg", 3)).drop("_avg")


def overrepresented_genera(census: DataFrame, merged: DataFrame, families: DataFrame, k: int,
                           species: str = "ncbi_species_count", genomes: str = "ncbi_genome_count") -> DataFrame:
    """Census genera under listed families with their database counts and the families' mean factor.

    `census`: genus, otu_count, lineage text. `families`: family, factor (at most k rows).
    """
    members = lineage_members(census.select("genus", "otu_count", "lineage"), families)
    factor = families.select(F.col("family").alias("listed_family"), "factor")
    grouped = members.join(factor, "listed_family").groupBy("genus").agg(
        F.array_join(F.array_sort(F.collect_set("listed_family")), "; ").alias("associated_families"),
        F.count("*").alias("number_of_families"), exact_mean("factor", 3).alias("_avg"),
        F.max("otu_count").alias("census_otu_count"),
    )
    db = merged.select(F.col("taxon").alias("genus"), F.col(species).alias("db_species_count"),
                       F.col(genomes).alias("db_genome_count"))
    db = first_per_key(db, ["genus"], [F.desc("db_species_count"), F.desc("db_genome_count")])
    return grouped.join(db, "genus", "left").fillna(0, ["db_species_count", "db_genome_count"]).withColumn(
        "average_factor", round_even("_avg", 3)
    ).drop("_avg")


def genus_family_map(combinations: DataFrame) -> DataFrame:
    """One family per genus: the combination with most clusters, then the smaller family."""
    named = combinations.where("genus is not null and family is not null").select("genus", "family", "row_count")
    return first_per_key(named, ["genus"], [F.desc("row_count"), "family"]).select("genus", "family")


def novel_genus_combinations(novel: DataFrame, combinations: DataFrame) -> DataFrame:
    """Combinations of listed genera with the factor and counts of the genus."""
    return combinations.join(novel.select("genus", "novelty_factor", "census_otu_count"), "genus")


def novelty_by_genus(joined: DataFrame) -> DataFrame:
    return joined.groupBy("genus", "novelty_factor", "census_otu_count").agg(
        F.count("*").alias("num_combinations"), F.sum("row_count").alias("total_clusters"),
        F.sum("total_size").alias("total_size"),
        round_even(exact_mean("avg_size_per_cluster", 2), 2).alias("avg_cluster_size"),
    )


def novelty_by_family(placed: DataFrame) -> DataFrame:
    return placed.where(F.col("family") != "NOT_FOUND").groupBy("family").agg(
        F.count("genus").alias("genera"),
        round_even(exact_mean("novelty_factor", 3), 1).alias("mean_novelty"),
        F.sum("census_otu_count").alias("census_otu_count"),
    )


