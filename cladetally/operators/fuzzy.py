"""Near matches of taxon names against a dictionary.

Similarity is the ratio 2M / (la + lb) of `difflib`, with M the characters in matching blocks. A
ratio above t leaves fewer than (1 - t)(la + lb) characters unmatched, so at most `u` single
insertions or deletions separate the names; lengths tell how many of them are deletions on either side.

The index is exact and takes one of two forms, by the lengths of both names:

* Whole names. Take all the letters out of both names that may be unmatched: some choice leaves the same
  letters. Names join on what is left, which hardly any two names share that are not near. Used while
  a name has at most `VARIANTS` such choices.
* Parts. Of k parts of the dictionary's name at most u / 2 hold two or more insertions or deletions, so
  any u / 2 + 1 of them include one that stands in the other name with at most one. As many parts are
  cut as stay `PART` letters long; the most common ones, by their count in the dictionary, are left out.

Both are equality joins that lose no match, on keys of at least four letters whose frequency does not follow a
name's commonest ending. The ratio is an array expression. (`difflib` treats letters of names of 200 and
more letters apart; the ratio here does not.)
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cladetally.functions.common import as_col
from cladetally.session import materialize

SHORT_NAME, SHORT_THRESHOLD, THRESHOLD = 5, 90, 85  # per cent
VARIANTS = 100
PART = 5
LEFT_OUT = 2


def _budget(la: Column, lb: Column) -> Column:
    """Most unmatched characters a pair of these lengths may have; same parity as la + lb."""
    total = la + lb
    slack = F.when(la > SHORT_NAME, 100 - THRESHOLD).otherwise(100 - SHORT_THRESHOLD)
    most = F.floor((slack * total - 1) / 100).cast("int")
    return most - F.pmod(total - most, F.lit(2))


def _choices(n: Column, d: Column) -> Column:
    """Ways to take d of n letters out; more than `VARIANTS` for d above 3."""
    ways = F.when(d == 0, 1).when(d == 1, n).when(d == 2, n * (n - 1) / 2).when(d == 3, n * (n - 1) * (n - 2) / 6)
    return F.when(n - d < 2, VARIANTS + 1).otherwise(ways).cast("int")


def _with_lengths(df: DataFrame, own: str, other: str) -> DataFrame:
    """One row per length the partner of a name can have, with the budget `u`, the letters to take out on
    either side, whether whole names are joined, and else how many parts must stand."""
    n = F.col(own)
    lengths = F.sequence(F.greatest(F.lit(3), F.floor(n * 0.7).cast("int")), F.ceil(n * 1.4).cast("int") + 1)
    out = df.withColumn(other, F.explode(lengths)).withColumn("u", _budget(F.col("la"), F.col("lb")))
    out = out.where(F.col("u") >= F.abs(F.col("la") - F.col("lb")))
    fewer_a, fewer_b = ((F.col("u") + sign * (F.col("la") - F.col("lb"))) / 2 for sign in (1, -1))
    out = out.withColumns({"da": fewer_a.cast("int"), "db": fewer_b.cast("int")})
    whole = (F.coalesce(_choices(F.col("la"), F.col("da")), F.lit(VARIANTS + 1)) <= VARIANTS) & (
        F.coalesce(_choices(F.col("lb"), F.col("db")), F.lit(VARIANTS + 1)) <= VARIANTS)
    return out.withColumn("whole", whole).withColumn("needed", (F.floor(F.col("u") / 2) + 1).cast("int"))


def _without(name: Column, d: Column, most: int) -> Column:
    """All texts that taking d letters out of `name` can leave, d up to `most`."""
    start = F.array(F.struct(name.alias("t"), F.lit(1).alias("at")))

    def shorter(states):
        return F.flatten(F.transform(states, lambda s: F.transform(
            F.when(F.length(s["t"]) >= s["at"], F.sequence(s["at"], F.length(s["t"]))).otherwise(F.array().cast("array<int>")),
            lambda p: F.struct(F.concat(F.substring(s["t"], 1, p - 1), F.substring(s["t"], p + 1, F.length(s["t"]))).alias("t"), p.alias("at")))))

    states, by_d = start, None
    for taken in range(most + 1):
        texts = F.transform(states, lambda s: s["t"])
        by_d = F.when(d == taken, texts) if by_d is None else by_d.when(d == taken, texts)
        states = shorter(states)
    return F.array_distinct(by_d)


def _whole_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.where("whole").select("a", "la", "da").distinct().withColumn("key", F.explode(_without(F.col("a"), F.col("da"), 3)))
    right = b.where("whole").select("b", "lb", "db").distinct().withColumn("key", F.explode(_without(F.col("b"), F.col("db"), 3)))
    u = _budget(F.col("la"), F.col("lb"))
    fits = (F.col("da") + F.col("db") == u) & (F.col("da") - F.col("db") == F.col("la") - F.col("lb"))
    return left.join(right, "key").where(fits).select("a", "b")


def _part_bounds() -> tuple[Column, Column]:
    """Start and size of part i of the dictionary's name."""
    k = F.col("k")
    start = F.floor(F.col("i") * F.col("lb") / k).cast("int")
    return start, F.floor((F.col("i") + 1) * F.col("lb") / k).cast("int") - start


def _part_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    spare = F.least(F.lit(LEFT_OUT), F.floor(F.col("lb") / PART) - F.col("needed"))
    k = F.col("needed") + F.greatest(F.lit(0), spare)
    start, size = _part_bounds()
    # The dictionary's parts, the commonest left out; each whole and with one letter taken out.
    cut = b.where("not whole").select("b", "lb", "needed").distinct().withColumn("k", k.cast("int"))
    cut = cut.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("part", F.substring("b", start + 1, size))
    keys = ["lb", "needed", "i"]
    common = materialize(cut.groupBy(*keys, "part").agg(F.count("*").alias("_n")))
    rarest = W.partitionBy("b", "needed").orderBy("_n", "i")
    kept = cut.join(common, [*keys, "part"]).withColumn("_r", F.row_number().over(rarest)).where(F.col("_r") <= F.col("needed"))
    right = kept.select("b", *keys, F.explode(F.array_distinct(F.concat(F.array("part"), _without(F.col("part"), F.lit(1), 1)))).alias("key"))
    # The other name's stretches that can stand for part i: as long, one shorter, or one longer less a letter.
    placed = (a.where("not whole").select("a", "la", "lb", "u", "da", "db", "needed").distinct().withColumn("k", k.cast("int"))
              .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("at", start).withColumn("size", size))
    first, last = F.col("i") == 0, F.col("i") == F.col("k") - 1

    def stretches(n: Column) -> Column:
        low = F.when(first, 0).when(last, F.col("la") - n).otherwise(F.greatest(F.lit(0), F.col("at") - F.col("db")))
        high = F.when(first, 0).when(last, F.col("la") - n).otherwise(F.least(F.col("at") + F.col("da"), F.col("la") - n))
        spots = F.when((low >= 0) & (high >= low) & (high + n <= F.col("la")), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda p: F.substring("a", p + 1, n))

    longer = F.flatten(F.transform(stretches(F.col("size") + 1), lambda t: _without(t, F.lit(1), 1)))
    texts = F.concat(stretches(F.col("size") - 1), stretches(F.col("size")), longer)
    left = placed.select("a", *keys, F.explode(F.array_distinct(texts)).alias("key"))
    return left.join(right, [*keys, "key"]).select("a", "b")


def candidate_pairs(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs `(a, b)` that can exceed the threshold; `probes` has a, `entries` has b."""
    a = _with_lengths(probes.select("a", F.length("a").alias("la")).where("la >= 3"), "la", "lb")
    b = _with_lengths(entries.select("b", F.length("b").alias("lb")).where("lb >= 3"), "lb", "la")
    pairs = _whole_pairs(a, b).union(_part_pairs(a, b)).distinct()
    return pairs.where(F.levenshtein("a", "b") <= _budget(F.length("a"), F.length("b")))


def _longest_block(a: Column, b: Column, seg: Column) -> Column:
    """Longest stretch that stands in both segments of the letters, the first in a, then in b: n, i, j."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.lit(0).alias("j"))

    def row(s, i):
        # Length of the common stretch that ends at i and at each j.
        ends = F.transform(F.sequence(seg["bl"], seg["bh"] - 1), lambda j: F.when(
            F.get(a, i) == F.get(b, j), F.when(j == seg["bl"], 0).otherwise(F.coalesce(F.get(s["ends"], j - seg["bl"] - 1), F.lit(0))) + 1).otherwise(0))

        def better(x):
            n = F.array_max(x)
            j = (F.array_position(x, n) - 1).cast("int") + seg["bl"]
            found = F.struct(n.alias("n"), (i - n + 1).alias("i"), (j - n + 1).alias("j"))
            return F.struct(x.alias("ends"), F.when(n > s["best"]["n"], found).otherwise(s["best"]).alias("best"))

        return F.transform(F.array(ends), better)[0]

    start = F.struct(F.array().cast("array<int>").alias("ends"), none.alias("best"))
    return F.aggregate(F.sequence(seg["al"], seg["ah"] - 1), start, row, lambda s: s["best"])


def block_ratio(a: Column, b: Column) -> Column:
    """2M / (la + lb): the longest block, then those left and right of it, in any depth."""
    segment = "array<struct<al: int, ah: int, bl: int, bh: int>>"

    def part(al, ah, bl, bh):
        return F.when((ah > al) & (bh > bl), F.struct(al.alias("al"), ah.alias("ah"), bl.alias("bl"), bh.alias("bh")))

    def of(letters):
        x, y = letters["a"], letters["b"]
        todo = F.array_compact(F.array(part(F.lit(0), F.size(x), F.lit(0), F.size(y)))).cast(segment)

        def step(s, _):
            seg = F.get(s["todo"], F.lit(0))

            def split(best):
                after = F.concat(F.slice(s["todo"], 2, F.size(s["todo"])), F.when(best["n"] > 0, F.array_compact(F.array(
                    part(seg["al"], best["i"], seg["bl"], best["j"]),
                    part(best["i"] + best["n"], seg["ah"], best["j"] + best["n"], seg["bh"])))).otherwise(F.array()).cast(segment))
                return F.struct(after.alias("todo"), (s["m"] + best["n"]).alias("m"))

            return F.when(F.size(s["todo"]) > 0, F.transform(F.array(_longest_block(x, y, seg)), split)[0]).otherwise(s)

        # Every step takes one segment away, and adds two only with a block.
        rounds = F.sequence(F.lit(1), 2 * F.least(F.size(x), F.size(y)) + 1)
        matched = F.aggregate(rounds, F.struct(todo.alias("todo"), F.lit(0).alias("m")), step, lambda s: s["m"])
        return 2.0 * matched / (F.size(x) + F.size(y))

    return F.transform(F.array(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"))), of)[0]


def near_names(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """Best entry of each probe above the threshold, `(a, b, score)`; ties go to the smaller name."""
    pairs = candidate_pairs(probes, entries).withColumn("score", block_ratio(F.col("a"), F.col("b")))
    floor = F.when(F.length("a") > SHORT_NAME, THRESHOLD / 100).otherwise(SHORT_THRESHOLD / 100)
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("b")))
    return pairs.where(F.col("score") > floor).groupBy("a").agg(best.alias("m")).select(
        "a", F.col("m.b").alias("b"), (-F.col("m.s")).alias("score")
    )


def _variants(c: Column) -> Column:
    def ending(old, new):
        return F.when(c.endswith(old), F.concat(F.substr(c, F.lit(1), F.length(c) - len(old)), F.lit(new)))

    return F.array(
        c, F.replace(c, F.lit("-"), F.lit("")), F.replace(c, F.lit("_"), F.lit("")),
        F.replace(c, F.lit(" "), F.lit("")), F.regexp_replace(c, r"[^a-z0-9]", ""),
        ending("ae", "a"), ending("ales", "a"), ending("ida", "a"),
    )


def fuzzy_match(df: DataFrame, names: DataFrame, nodes: DataFrame, lineages: DataFrame, col: str,
                rank: str | None = None) -> DataFrame:
    """`(col, taxid, name, match_type, match_score)`: exact, spelling variant (0.9), near match, or
    unmapped. Only eukaryote entries of the rank take part; a name on several taxids takes the
    smallest."""
    eukaryotes = lineages.where(
        F.exists("lineage", lambda x: x["name"] == "Eukaryota")).select("taxid")
    wanted = nodes if rank is None else nodes.where(F.col("rank") == rank)
    allowed = names.join(wanted.select("taxid"), "taxid", "left_semi").join(eukaryotes, "taxid", "left_semi")
    entries = materialize(
        allowed.groupBy(F.lower("name").alias("b")).agg(F.min(F.struct("taxid", "name")).alias("e"))
    )
    probes = materialize(
        df.select(as_col(col).alias(col), F.lower(col).alias("a")).where(F.col(col).isNotNull()).distinct()
    )
    tried = probes.select("a").distinct().select("a", F.posexplode(_variants(F.col("a"))).alias("pos", "b"))
    spelled = tried.where("b is not null").join(entries.select("b"), "b").groupBy("a").agg(
        F.min(F.struct("pos", "b")).alias("m")
    ).select("a", F.col("m.b").alias("b"), F.when(F.col("m.pos") == 0, 1.0).otherwise(0.9).alias("score"),
             F.when(F.col("m.pos") == 0, "exact").otherwise("variant").alias("match_type"))
    spelled = materialize(spelled)
    rest = materialize(probes.select("a").distinct().join(spelled.select("a"), "a", "left_anti"))
    near = near_names(rest, entries).withColumn("match_type", F.lit("fuzzy"))
    found = spelled.unionByName(near).join(entries, "b")
    return probes.join(found, "a", "left").select(
        col, F.col("e.taxid").alias("taxid"), F.col("e.name").alias("name"),
        F.coalesce("match_type", F.lit("unmapped")).alias("match_type"),
        F.coalesce("score", F.lit(0.0)).alias("match_score"),
    )
