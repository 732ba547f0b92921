"""Subtree questions by intervals: a node's descendants are a range of numbers.

`tree_intervals` numbers a tree in pre-order. The tour around the tree is a linked list of two steps per node, into
it and out of it; pointer doubling sums the steps that follow each one, whatever the tree's depth. Then
x lies below a when `a.pre <= x.pre < a.end`, and the sum over a subtree is the difference of two running sums, so no
row is repeated for its ancestors.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cladetally.session import materialize

NO_PARENT = -1


def _siblings(tree: DataFrame) -> DataFrame:
    """`(taxid, parent, sibling)`: the next larger child of the same parent.

    Children are dealt out by ranges, so a parent of a third of all nodes is spread; only the first child of each
    range, one row per range and parent, is looked up across ranges."""
    parts = materialize(tree.repartitionByRange("parent", "taxid").withColumn("part", F.spark_partition_id()))
    inside = F.lead("taxid").over(W.partitionBy("parent", "part").orderBy("taxid"))
    firsts = parts.groupBy("parent", "part").agg(F.min("taxid").alias("first")).withColumn(
        "later", F.lead("first").over(W.partitionBy("parent").orderBy("part"))).select("parent", "part", "later")
    return parts.withColumn("inside", inside).join(firsts, ["parent", "part"]).select(
        "taxid", "parent", F.coalesce("inside", "later").alias("sibling"))


def tour(nodes: DataFrame) -> DataFrame:
    """`(step, next, ahead)`: step 2 t leads into node t, 2 t + 1 out of it; `ahead` is 1 for a step into a node."""
    tree = nodes.groupBy("taxid").agg(F.min("parent").alias("parent"))
    known = tree.select(F.col("taxid").alias("parent"), F.lit(True).alias("known"))
    tree = materialize(tree.join(known, "parent", "left").select(
        "taxid", F.when((F.col("parent") != F.col("taxid")) & F.col("known"), F.col("parent")).otherwise(NO_PARENT).cast("bigint").alias("parent")))
    child = tree.groupBy("parent").agg(F.min("taxid").alias("child")).withColumnRenamed("parent", "taxid")
    placed = _siblings(tree).join(child, "taxid", "left")
    into, out = 2 * F.col("taxid"), 2 * F.col("taxid") + 1
    after = F.coalesce(2 * F.col("sibling"), F.when(F.col("parent") != NO_PARENT, 2 * F.col("parent") + 1))
    return placed.select(F.inline(F.array(
        F.struct(into.alias("step"), F.coalesce(2 * F.col("child"), out).alias("next"), F.lit(1).cast("bigint").alias("ahead")),
        F.struct(out.alias("step"), after.alias("next"), F.lit(0).cast("bigint").alias("ahead")))))


def tree_intervals(nodes: DataFrame) -> DataFrame:
    """Stored `(taxid, pre, end)` from `(taxid, parent)`: the node's number in pre-order, children by taxid, and the
    number behind its last descendant.

    A node that is its own parent, or whose parent is not in the table, is a root. Nodes on or below a cycle have no place
    in the tour and no row. Rounds: the logarithm of twice the number of nodes.
    """
    steps = materialize(tour(nodes))
    rounds = (2 * steps.count()).bit_length()
    for _ in range(rounds):
        open_ = steps.where("next is not null")
        if open_.isEmpty():
            break
        hop = steps.select(F.col("step").alias("next"), F.col("next").alias("further"), F.col("ahead").alias("more"))
        grown = open_.join(hop, "next").select("step", F.col("further").alias("next"), (F.col("ahead") + F.col("more")).alias("ahead"))
        steps = materialize(steps.where("next is null").unionByName(grown))
    ended = steps.where("next is null")
    pairs = ended.groupBy(F.expr("step div 2").alias("taxid")).agg(
        F.max(F.when(F.col("step") % 2 == 0, F.col("ahead"))).alias("from_in"), F.max(F.when(F.col("step") % 2 == 1, F.col("ahead"))).alias("from_out"))
    pairs = materialize(pairs.where("from_in is not null and from_out is not null"))
    total = pairs.agg(F.max("from_in")).scalar()
    return materialize(pairs.select("taxid", (total - F.col("from_in")).alias("pre"), (total - F.col("from_out")).alias("end")))


def is_below(x_pre: Column, a_pre: Column, a_end: Column) -> Column:
    """Whether x is the ancestor itself or below it."""
    return (x_pre >= a_pre) & (x_pre < a_end)


def running_sums(df: DataFrame, order: str, sums) -> DataFrame:
    """Stored `df` with `before_<c>`: the sum of c over all rows before this one; `order` is unique.

    Rows are dealt out by ranges; a range's sums and the sums of the ranges before it, one row per range, add up."""
    sums = list(sums)
    parts = materialize(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    earlier = W.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    inner = parts.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    return materialize(inner.join(offsets, "_part").withColumns(
        {f"before_{c}": F.col(f"before_{c}") + F.col(f"_{c}") for c in sums}).drop("_part", *[f"_{c}" for c in sums]))


def subtree_totals(intervals: DataFrame, rows: DataFrame, sums, taxid: str = "taxid") -> DataFrame:
    """`(taxid, ...)`: sums over the rows of each node and all nodes below it, for every node of the tree.

    Rows are first totalled per taxid; rows whose taxid is not in the tree are left out."""
    sums = list(sums)
    own = rows.groupBy(F.col(taxid).alias("taxid")).agg(*[F.sum(c).alias(c) for c in sums])
    placed = intervals.join(own, "taxid", "left").fillna(0, sums)
    summed = running_sums(placed, "pre", sums)
    whole = summed.agg(F.struct(*[F.sum(c).alias(c) for c in sums])).scalar()
    ends = summed.select(F.col("pre").alias("end"), *[F.col(f"before_{c}").alias(f"end_{c}") for c in sums])
    return summed.join(ends, "end", "left").select("taxid", *[
        (F.coalesce(F.col(f"end_{c}"), whole.getField(c)) - F.col(f"before_{c}")).alias(c) for c in sums])
