"""Exact quantiles by distributed selection: no task gathers the values of a group.

Distinct values with their counts are dealt out by ranges of (group, value) and stored with the number of their
range. The counts per range, at most one row per range and group beyond the first of each, tell in which range a
rank lies; running counts are taken in these ranges only. A group that holds most of the table is spread over as many ranges
as the session has shuffle partitions.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cladetally.session import materialize


def _same(a: DataFrame, b: DataFrame, keys) -> Column:
    """Equality of the keys, nulls included."""
    return F.expr("true") if not keys else _all([a[k].eqNullSafe(b[k]) for k in keys])


def _all(conditions) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def value_ranges(df: DataFrame, value: str, by=(), n: str | None = None) -> DataFrame:
    """Stored `(by, _v, _n, _part)`: distinct values, their counts and the range they lie in; ranges follow
    the order of group and value. Nulls are left out."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(
        (F.count("*") if n is None else F.sum(n)).alias("_n"))
    return materialize(counted.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))


def exact_quantiles(df: DataFrame, value: str, shares, by=(), n: str | None = None, out: str = "quantiles") -> DataFrame:
    """One row per group with the array `out` of the quantiles at `shares`, interpolated between neighbours.

    `n` weighs the rows by a whole number. Without `by` there is one row, null for an empty table.
    """
    by, shares = list(by), list(shares)
    ranges = value_ranges(df, value, by, n)
    sums = ranges.groupBy(*by, "_part").agg(F.sum("_n").alias("_held"))
    group = [F.col(c) for c in by] or [F.lit(1)]
    before = F.sum("_held").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    placed = sums.withColumns({
        "_before": F.coalesce(before, F.lit(0)), "_total": F.sum("_held").over(W.partitionBy(*group))
    })
    places = [(F.col("_total") - 1) * F.lit(float(p)) for p in shares]
    slots = F.array(*[
        F.struct(F.lit(2 * i + up).alias("_slot"), side(place).cast("bigint").alias("_rank"), place.alias("_place"))
        for i, place in enumerate(places) for up, side in enumerate((F.floor, F.ceil))
    ])
    wanted = placed.select(*by, "_part", "_before", "_held", F.inline(slots)).where(
        (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_held")))
    keys = [*by, "_part"]
    touched = wanted.select(*keys).distinct()
    rows = ranges.join(touched, _same(ranges, touched, keys), "left_semi")
    rows = rows.withColumn("_upto", F.sum("_n").over(W.partitionBy(*keys).orderBy("_v")))
    offset = wanted["_rank"] - wanted["_before"]
    found = wanted.join(rows, _same(wanted, rows, keys) & (offset < rows["_upto"]) & (offset >= rows["_upto"] - rows["_n"])).select(
        *[wanted[k] for k in by], "_slot", "_place", "_rank", "_v")

    def at(slot, what):
        return F.max(F.when(F.col("_slot") == slot, F.col(what)))

    def quantile(i):
        low, high = at(2 * i, "_v"), at(2 * i + 1, "_v")
        place = at(2 * i, "_place")
        between = (at(2 * i + 1, "_rank") - place) * low + (place - at(2 * i, "_rank")) * high
        return F.when(low == high, low).otherwise(between)

    return found.groupBy(*by).agg(F.array(*[quantile(i) for i in range(len(shares))]).alias(out))
