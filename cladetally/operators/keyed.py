"""Keyed selection, top lists, ranks and samples.

`row_number() <= k` keeps at most k rows per key and map task before the shuffle, so a key that
owns a large share of the rows never gathers in one task.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cladetally.functions.classify import assembly_level_rank
from cladetally.functions.common import as_col, round_even
from cladetally.session import materialize


def _keys(*columns):
    return [c if isinstance(c, Column) else F.col(c) for c in columns]


def top_per_key(df: DataFrame, keys, order, k: int, rank_col: str = "_rn") -> DataFrame:
    """First k rows of each key in the given order, numbered from 1."""
    w = W.partitionBy(*_keys(*keys)).orderBy(*_keys(*order))
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """Whole first row of each key; name enough order columns to break every tie."""
    return top_per_key(df, keys, order, 1).drop("_rn")


def best_genome_per_species(df: DataFrame, species: str = "species_taxid",
                            tie_break=("assembly_accession",), use_level: bool = True) -> DataFrame:
    """One genome per species: isolates first, then the better assembly level, then accession."""
    order = [(F.col("genome_source") == "uncultured").cast("int")]
    if use_level:
        order.append(assembly_level_rank("assembly_level"))
    return first_per_key(df.where(F.col(species).isNotNull()), [species], [*order, *tie_break])


HELD_ROWS = 1 << 17


def _smallest(table: pa.Table, keys: list[str], value: str, k: int) -> pa.Table:
    """Smallest k distinct values of each key, in order."""
    table = table.group_by([*keys, value], use_threads=False).aggregate([]).sort_by([(c, "ascending") for c in [*keys, value]])
    at = np.arange(len(table))
    begins = at == 0
    for key in keys:
        codes = table[key].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        begins[1:] |= codes[1:] != codes[:-1]
    return table.filter(pa.array(at - np.maximum.accumulate(np.where(begins, at, 0)) < k))


def smallest_per_key(df: DataFrame, keys, value: str, k: int, out: str) -> DataFrame:
    """Array `out` of the smallest k distinct values of each key, in order; nulls are left out.

    A merge that keeps k values combines on the map side: a key's rows leave a task as k rows, however many they
    are and however often a value repeats. A task holds `HELD_ROWS` rows and a batch; with more keys it passes
    them on and starts anew.
    """
    plain = df.select(*keys, value).where(F.col(value).isNotNull())
    names = [f"_k{i}" for i in range(len(keys))]
    coded = plain.toDF(*names, "_value")

    def merged(batches):
        held, waiting, rows = [], 0, 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            waiting += batch.num_rows
            if waiting < HELD_ROWS:
                continue
            held = [_smallest(pa.concat_tables(held), names, "_value", k)]
            waiting, rows = 0, held[0].num_rows
            if rows > HELD_ROWS:
                yield from held[0].to_batches()
                held = []
        if held:
            yield from _smallest(pa.concat_tables(held), names, "_value", k).to_batches()

    partial = coded.mapInArrow(merged, coded.schema)
    few = partial.groupBy(*names).agg(F.slice(F.array_sort(F.collect_set("_value")), 1, k).alias("_few"))
    return few.select(*[F.col(n).alias(key) for n, key in zip(names, keys)], F.col("_few").alias(out))


def first_accessions(df: DataFrame, taxon: str, accession: str = "accession_clean", k: int = 10) -> DataFrame:
    """Smallest k distinct accessions of each taxon, numbered from 1."""
    few = smallest_per_key(df, [taxon], accession, k, "_few").select(taxon, F.posexplode("_few").alias("_at", accession))
    return few.select(taxon, accession, (F.col("_at") + 1).alias("accession_no"))


def top_k(df: DataFrame, measure, k: int, tie_break, ascending: bool = False) -> DataFrame:
    """k rows with the largest (or smallest) measure; planned as one TakeOrdered."""
    m = as_col(measure)
    return df.orderBy(m.asc() if ascending else m.desc(), *_keys(*tie_break)).limit(k)


def bottom_k(df: DataFrame, measure, k: int, tie_break) -> DataFrame:
    return top_k(df, measure, k, tie_break, ascending=True)


def top_list(df: DataFrame, measure, k: int, tie_break, rank_col: str = "rank") -> DataFrame:
    """Top k, numbered. The window sees k rows only."""
    m = as_col(measure)
    w = W.orderBy(m.desc(), *_keys(*tie_break))
    return top_k(df, measure, k, tie_break).withColumn(rank_col, F.row_number().over(w))


def flag_top(df: DataFrame, measure: str, key: str, n: int, flag: str, above: float = 1.0) -> DataFrame:
    """True for rows whose measure exceeds `above` and is among the n largest.

    The n keys reach the rows as one scalar array, so nothing is shuffled by the flag.
    """
    best = top_k(df.where(F.col(measure) > above).select(key, measure), measure, n, [key])
    keys = best.agg(F.collect_set(key)).scalar()
    return df.withColumn(
        flag, F.coalesce((F.col(measure) > above) & F.array_contains(keys, F.col(key)), F.lit(False))
    )


def top_with_other(df: DataFrame, key: str, measures: list[str], order_by: str, n: int,
                   other: str = "Other") -> DataFrame:
    """Top n rows plus one row that sums the rest; `position` 1..n, then n+1."""
    top = top_list(df.select(key, *measures), order_by, n, [key], "position")
    totals = df.agg(*[F.sum(m).alias(m) for m in measures], F.count("*").alias("_rows"))
    top_sums = top.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures],
                       F.count("*").alias("_rows"))
    head = top_sums.select(F.struct("*")).scalar()
    rest = totals.select(
        F.lit(other).alias(key),
        *[(F.coalesce(F.col(m), F.lit(0)) - head.getField(m)).alias(m) for m in measures],
        (head.getField("_rows").cast("int") + 1).alias("position"),
    )
    return top.unionByName(rest)


def long_axes(df: DataFrame, key: str, measures: dict[str, str]) -> DataFrame:
    """One row per (key, axis): `axis_no`, `axis`, `absolute_count`; missing counts are zero."""
    axes = F.array(*[
        F.struct(F.lit(i).alias("axis_no"), F.lit(axis).alias("axis"),
                 F.coalesce(F.col(col), F.lit(0)).cast("double").alias("absolute_count"))
        for i, (axis, col) in enumerate(measures.items(), 1)
    ])
    return df.select(key, "position", F.inline(axes))


def axis_links(axes: DataFrame, key: str) -> DataFrame:
    """Link of each key from one axis to the next, weighted by the next axis."""
    w = W.partitionBy(key).orderBy("axis_no")
    return (
        axes.select(
            key, "position",
            F.col("axis").alias("source"),
            F.lead("axis").over(w).alias("target"),
            F.lead("absolute_count").over(w).alias("value"),
        ).where("target is not null")
    )


def label_positions(axes: DataFrame, min_share: float = 2.0) -> DataFrame:
    """Label mid-point of each block on its axis, blocks below the share left out.

    The input is a top-n table in long form, so an axis has n + 1 rows.
    """
    per_axis = axes.groupBy("axis").agg(F.sum("absolute_count").alias("_total"))
    shares = axes.join(per_axis, "axis").withColumn(
        "percentage",
        F.when(F.col("_total") > 0, F.col("absolute_count") / F.col("_total") * 100).otherwise(0.0),
    )
    w = W.partitionBy("axis").orderBy("position")
    running = F.sum("percentage").over(w.rowsBetween(W.unboundedPreceding, 0))
    placed = shares.where(F.col("percentage") >= min_share).withColumn("cumulative", running)
    before = F.lag("cumulative", 1, 0.0).over(w)
    return placed.withColumn("label_y", before + F.col("percentage") / 2).drop("_total")


def with_position(df: DataFrame, order, position: str) -> DataFrame:
    """Each row's place from 1 in the order of the whole table.

    Rows are dealt out by ranges of the order; a row's place is its place in its range plus the rows of the ranges
    before it, one number per range. Rows that tie take their places in any order.
    """
    order = _keys(*order)
    ranges = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("_rows").over(W.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = ranges.groupBy("_range").agg(F.count("*").alias("_rows")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    numbered = ranges.withColumn("_no", inside).join(starts, "_range")
    return numbered.withColumn(position, F.col("_start") + F.col("_no")).drop("_range", "_start", "_no")


def _sorted(df: DataFrame, order, position: str | None) -> DataFrame:
    return df.orderBy(*order) if position is None else with_position(df, order, position)


def order_by_group_block(df: DataFrame, group: str, measure: str, tie_break, position: str | None = None) -> DataFrame:
    """Rows sorted by their group's largest measure, then group, then their own measure; or, unsorted, with
    their place in this order in column `position`, as in the other orders here.

    The group maximum is a join with a stored, pre-aggregated table, not a window, so a dominant
    group stays spread.
    """
    peak = materialize(df.groupBy(group).agg(F.max(measure).alias("group_max")))
    order = [F.desc("group_max"), F.col(group), F.desc(measure), *_keys(*tie_break)]
    return _sorted(df.join(peak, group), order, position)


def sort_matched_first(df: DataFrame, count_col: str, name_col: str, position: str | None = None) -> DataFrame:
    """Matched block first, each block by count descending, then name."""
    return _sorted(df, [F.col("match_status") != "matched", F.desc(count_col), F.col(name_col)], position)


def sort_by_novelty(df: DataFrame, novelty: str, otus: str, name_col: str, position: str | None = None) -> DataFrame:
    """Infinite novelty first, then novelty, then OTUs."""
    inf = F.col(novelty) == float("inf")
    return _sorted(df, [inf.desc(), F.desc(novelty), F.desc(otus), F.col(name_col)], position)


def sort_by_species(df: DataFrame, species: str, otus: str, name_col: str, position: str | None = None) -> DataFrame:
    """Most species first, then most OTUs."""
    return _sorted(df, [F.desc(species), F.desc(otus), F.col(name_col)], position)


def systematic_sample(numbered: DataFrame, n: int, record: str = "record") -> DataFrame:
    """Each step-th of the numbered records, n at most; the step is the number of records over n."""
    step = numbered.agg(F.greatest(F.lit(1), F.floor(F.count("*") / n)).cast("bigint")).scalar()
    return numbered.where((F.pmod(F.col(record), step) == 0) & (F.col(record) < step * n))


def union_all(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def set_comparison(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both inputs with `side` = both, only_a or only_b. One shuffle."""
    tagged = union_all(
        a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")),
        b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")),
    )
    side = (
        F.when((F.max("a") == 1) & (F.max("b") == 1), "both")
        .when(F.max("a") == 1, "only_a").otherwise("only_b")
    )
    return tagged.where(F.col(key).isNotNull()).groupBy(key).agg(side.alias("side"))


def distinct_names(frames, col: str) -> DataFrame:
    """Distinct names over several tables."""
    return union_all(*[f.select(col) for f in frames]).where(F.col(col).isNotNull()).distinct()


def share_of(df: DataFrame, measure: str, out: str, places: int = 2) -> DataFrame:
    """Share of the column total in percent; the total is a scalar subquery."""
    total = df.agg(F.sum(measure).cast("double")).scalar()
    pct = F.when(total > 0, F.col(measure) / total * 100).otherwise(0.0)
    return df.withColumn(out, round_even(pct, places))
