"""Selection that spreads its work: quantiles, smallest values per key, names held by texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladetally.operators import figures as fg, keyed as ky
from cladetally.operators.quantiles import exact_quantiles, value_ranges


def test_quantiles_equal_sorting(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1e6), float(rng.randint(0, 5)), None]), rng.randint(1, 4)) for _ in range(3000)]
    rows += [("one", 2.5, 1), ("same", 7.0, 3), ("same", 7.0, 2)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r["g"]: r["q"] for r in exact_quantiles(df, "v", shares, ["g"], "w", "q").collect()}
    for g in ("a", "b", None, "one", "same"):
        values = [v for k, v, w in rows if k == g and v is not None for _ in range(w)]
        assert got[g] == pytest.approx(np.percentile(values, [100 * p for p in shares]).tolist())
    assert len(got) == 5
    whole = exact_quantiles(df, "v", [0.5]).collect()
    assert len(whole) == 1 and whole[0]["quantiles"] == pytest.approx([np.median([v for _, v, _ in rows if v is not None])])
    assert exact_quantiles(df.limit(0), "v", [0.5]).first()["quantiles"] == [None]
    assert exact_quantiles(df.limit(0), "v", [0.5], ["g"]).count() == 0


def test_a_group_of_a_million_values_is_spread(spark):
    rows = spark.range(1_000_000).select(F.lit("hot").alias("g"), (F.col("id") * 0.37 + 1).alias("v")).union(
        spark.range(1000).select(F.concat(F.lit("g"), F.col("id") % 50), F.col("id").cast("double")))
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = value_ranges(rows, "v", ["g"]).groupBy("_part", "g").count()
        assert parts.agg(F.max("count")).first()[0] < 60_000
        # Totals are kept once per range and group, and a group lies in neighbouring ranges.
        assert parts.count() <= 51 + 40
        got = {r["g"]: r["quantiles"] for r in exact_quantiles(rows, "v", [0.25, 0.5, 0.999], ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    values = np.arange(1_000_000) * 0.37 + 1
    assert got["hot"] == pytest.approx(np.percentile(values, [25, 50, 99.9]).tolist())
    assert got["g7"] == pytest.approx(np.percentile(np.arange(7, 1000, 50), [25, 50, 99.9]).tolist())


def test_smallest_values_combine_before_the_shuffle(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None, "é"]), rng.randint(0, 2), rng.choice(["x", "y", "ü", None, str(rng.randint(0, 999))])) for _ in range(5000)]
    rows += [("hot", 0, "v")] * 5000
    df = spark.createDataFrame(rows, "k string, n int, v string")
    for held in (1 << 17, 7):  # 7: tasks pass rows on many times
        monkeypatch.setattr(ky, "HELD_ROWS", held)
        got = {(r["k"], r["n"]): r["few"] for r in ky.smallest_per_key(df, ["k", "n"], "v", 3, "few").collect()}
        want = {}
        for k, n, v in rows:
            if v is not None:
                want.setdefault((k, n), set()).add(v)
        assert got == {key: sorted(values, key=lambda v: v.encode())[:3] for key, values in want.items()}
    assert ky.smallest_per_key(df.limit(0), ["k", "n"], "v", 3, "few").count() == 0


@pytest.mark.parametrize("chars", [4_000_000, 12])
def test_names_held_by_texts(spark, monkeypatch, chars):
    monkeypatch.setattr(fg, "LISTED_CHARS", chars)  # 12: several portions of the list
    texts = [(1, ["abcab", None]), (2, ["xx", "bca"]), (3, []), (4, None), (5, ["été abc", "bc"]), (6, ["a"])]
    names = [("ab", 1), ("bc", 2), ("bc", 3), ("abc", 4), ("té a", 5), ("", 6), (None, 7), ("a", 8)]
    got = fg.held_names(spark.createDataFrame(texts, "id int, t array<string>"), [F.col("t")],
                        spark.createDataFrame(names, "name string, no int"), "name").select("id", "name", "no").collect()
    want = {(i, n, no) for i, t in texts for n, no in names if n and any(x and n in x for x in t or ())}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    none = fg.held_names(spark.createDataFrame(texts, "id int, t array<string>"), [F.col("t")],
                         spark.createDataFrame([], "name string, no int"), "name")
    assert none.count() == 0 and none.columns == ["name", "id", "t", "no"]


def test_tree_intervals_and_subtree_totals(spark):
    from cladetally.operators import subtrees as sb

    rng = random.Random(6)
    # A wide root, a deep chain, small trees, an orphan, a self-parent, a cycle with a tail.
    parent = {1: 1} | {i: 1 for i in range(2, 400)} | {i: i - 1 for i in range(400, 700)}
    parent |= {i: rng.choice([x for x in parent if x < i]) for i in range(700, 900)} | {950: 9999, 951: 950}
    parent |= {970: 971, 971: 972, 972: 970, 973: 970}
    nodes = spark.createDataFrame(list(parent.items()), "taxid bigint, parent bigint")
    got = {r.taxid: (r.pre, r.end) for r in sb.tree_intervals(nodes).collect()}

    children, roots = {}, []
    for t, p in sorted(parent.items()):
        (roots if p == t or p not in parent else children.setdefault(p, [])).append(t)
    want, stack, number = {}, [(t, False) for t in reversed(roots)], 0
    while stack:
        t, left = stack.pop()
        if left:
            want[t] = (want[t], number)
            continue
        want[t], number = number, number + 1
        stack += [(t, True), *((c, False) for c in reversed(children.get(t, [])))]
    assert got == want and 970 not in got and 973 not in got

    rows = [(rng.choice(list(want)), rng.randint(0, 9)) for _ in range(2000)] + [(123456, 5), (970, 5), (None, 5)]
    totals = {r.taxid: r.n for r in sb.subtree_totals(sb.tree_intervals(nodes), spark.createDataFrame(rows, "taxid bigint, n bigint"), ["n"]).collect()}
    for t, (pre, end) in want.items():
        assert totals[t] == sum(n for x, n in rows if x in want and pre <= want[x][0] < end)
    assert sb.tree_intervals(nodes.limit(0)).count() == 0


def test_positions_equal_sorting(spark):
    rng = random.Random(3)
    rows = [(f"k{i}", rng.choice(["x", "y", "z"]), rng.randint(0, 30), rng.choice([1.0, 2.5, float("inf")]), rng.choice(["matched", "census_only"]))
            for i in range(500)]
    df = spark.createDataFrame(rows, "k string, g string, n bigint, f double, match_status string").repartition(7)
    for sort in (lambda **p: ky.sort_matched_first(df, "n", "k", **p), lambda **p: ky.sort_by_novelty(df, "f", "n", "k", **p),
                 lambda **p: ky.sort_by_species(df, "n", "f", "k", **p), lambda **p: ky.order_by_group_block(df, "g", "n", ["k"], **p)):
        placed = sorted((r["place"], r["k"]) for r in sort(position="place").collect())
        assert [p for p, _ in placed] == list(range(1, 501)) and [k for _, k in placed] == [r["k"] for r in sort().collect()]
    assert ky.with_position(df.limit(0), ["k"], "place").count() == 0
