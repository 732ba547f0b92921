"""Order MinHash fingerprints, sensitive to edit distance.

A text's tokens are runs of Latin letters and digits (24 at most) and single other characters but white space. Its
k-mers are k tokens in a row; the last ones run over the end and hold fewer. Equal k-mers are told apart by the
number of their occurrence, in text order, and each numbered k-mer gets a 40-bit hash. For each of m hash functions
the l numbered k-mers with the smallest values are selected, put back in text order, and hashed as a tuple. The m
tuples are the fingerprint; two fingerprints' likeness is the share of tuples that agree. A tuple agrees only when
the same k-mers were selected and stand in the same order, so moved text counts as a difference, unlike in plain
MinHash.

The m functions are rotations of one: h_j(x) = h(x) - t_j modulo the range, with m evenly spaced t_j. One sort of the hashes
then serves all of them: function j selects the l values that follow t_j, going round at the end.

Only built-in expressions are used. A text is hashed where it is read; memory per row is a few words per token.

Defined cases: null text counts as empty; texts without tokens share one fingerprint; texts with fewer than l k-mers
select them again, going round; positions
from 16,777,215 on count as one; input columns beside doc_id and text are ignored. In `with_edited`, rows are ordered by
doc_id, then text; a row without an id has no next document and its edited text only loses its end; equal rows
are rows of their own; a single document follows itself.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladetally.session import materialize

TOKEN = r"[a-zA-Z0-9À-ɏ]{1,24}|\S"
K, L, M = 3, 2, 64
RANGE = 128
POSITION_BITS = 24


def let(value: Column, body) -> Column:
    """`body` of `value`, evaluated once however often `body` names it, in lambdas too."""
    return F.transform(F.array(value), body)[0]


def _packed(h: Column, position: Column) -> Column:
    """Hash in the high 40 bits, position in the low 24: arrays of plain numbers sort without boxing."""
    return h.bitwiseAND(F.lit(-1 << POSITION_BITS)).bitwiseOR(F.least(position, F.lit((1 << POSITION_BITS) - 1)).cast("long"))


def _kmers(text: Column, k: int) -> Column:
    words = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))
    return let(words, lambda h: F.transform(h, lambda x, i: _packed(F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]), i)))


def _kmer(e: Column) -> Column:
    return F.shiftright(e, POSITION_BITS)


def _position(e: Column) -> Column:
    return e.bitwiseAND(F.lit((1 << POSITION_BITS) - 1))


def _numbered(s: Column) -> Column:
    """Hashes of k-mer and occurrence number, out of the sorted k-mers. The first occurrence keeps the k-mer's
    own hash; the others, few in most texts, are numbered run by run."""
    new = lambda e, i: (i == 0) | (_kmer(e) != _kmer(F.get(s, i - 1)))

    def later(rest):
        starts = F.filter(F.transform(rest, lambda e, i: F.when((i == 0) | (_kmer(e) != _kmer(F.get(rest, i - 1))), i)), lambda i: i.isNotNull())
        return let(starts, lambda st: F.flatten(F.transform(st, lambda b, j: F.transform(
            F.slice(rest, b + 1, F.coalesce(F.get(st, j + 1), F.size(rest)) - b),
            lambda e, o: _packed(F.xxhash64(_kmer(e), o + 1), _position(e))))))

    return F.concat(F.filter(s, new), let(F.filter(s, lambda e, i: ~new(e, i)), later))


def _select(s: Column, l: int, m: int) -> Column:  # noqa: E741
    bits = m.bit_length() - 1
    # Number of the stretch between two t_j that a value lies in, from 0 to m - 1.
    stretch = lambda i: (F.shiftright(F.get(s, i), 64 - bits) + m // 2).cast("int")
    indices = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
    firsts = F.transform(
        F.filter(indices, lambda i: (i == 0) | (F.shiftright(F.get(s, i).bitwiseXOR(F.get(s, i - 1)), 64 - bits) != 0)),
        lambda i: F.struct(stretch(i).alias("b"), i.alias("i")))
    # Each t_j is followed by the first value of the next filled stretch.
    after = let(firsts, lambda f: F.concat(
        F.flatten(F.transform(f, lambda e, j: F.array_repeat(e["i"], e["b"] - F.coalesce(F.get(f, j - 1)["b"], F.lit(-1))))),
        F.array_repeat(F.lit(0), m - 1 - F.coalesce(F.get(f, F.size(f) - 1)["b"], F.lit(-1)))))

    def in_text_order(part):
        by_position = F.sort_array(F.transform(part, lambda e: F.struct(_position(e).alias("p"), e.alias("e"))))
        return F.xxhash64(F.transform(by_position, lambda e: _kmer(e["e"])))

    def tuples(r):
        if l != 2:
            return F.transform(after, lambda at: in_text_order(F.slice(r, at + 1, l)))
        pair = lambda a, b: F.when(_position(a) <= _position(b), F.xxhash64(_kmer(a), _kmer(b))).otherwise(F.xxhash64(_kmer(b), _kmer(a)))
        return F.transform(after, lambda at: pair(F.get(r, at), F.get(r, at + 1)))

    return let(F.concat(s, F.slice(s, 1, l)), tuples)


def with_fingerprints(rows: DataFrame, texts: dict[str, str], k: int = K, l: int = L, m: int = M) -> DataFrame:  # noqa: E741
    """Add to `rows`, for each name: column of text in `texts`, an array of m tuple hashes. `m` is a power of two.

    The steps are projections of their own: sorting outside of lambdas is compiled, and sorts unboxed numbers.
    Naming a step's result twice keeps the optimizer from folding it into the next one."""
    twice = lambda c, body: F.when(F.size(c) >= 0, let(F.col(c), body))
    kept = rows.columns
    for name, text in texts.items():
        rows = rows.withColumn(name, F.sort_array(_kmers(F.coalesce(F.col(text), F.lit("")), k)))
    rows = rows.select(*kept, *[F.sort_array(twice(n, _numbered)).alias(n) for n in texts])
    return rows.select(*kept, *[twice(n, lambda s: _select(s, l, m)).alias(n) for n in texts])


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing tuples."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def as_text(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _last_of_next(keys: DataFrame) -> DataFrame:
    """For every id range the largest id of the next lower range, or of the highest range after the lowest.

    The ranges' rows are dealt out in order, numbered by part, stored, and followed within parts and across them:
    only one row per part meets in one task."""
    parts = materialize(keys.repartitionByRange("range").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("range")
    ends = parts.groupBy("part").agg(F.max("high").alias("part_high"))
    before = Window.orderBy("part")
    total = Window.partitionBy()
    ends = ends.select("part", F.coalesce(F.lag("part_high").over(before), F.max("part_high").over(total)).alias("part_before"))
    return (parts.withColumn("lower", F.lag("high").over(inside)).join(ends, "part")
            .select("range", F.coalesce("lower", "part_before").alias("next_id")))


def with_next(docs: DataFrame, width: int = RANGE, **sizes) -> DataFrame:
    """doc_id, text, its fingerprint, and both of the next document in descending order, round after the last.

    Documents are dealt by ranges of `width` ids, so a range holds a bounded number of ids and the next text is
    found in place; only a range's last document fetches its successor by a join, one text per range."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bucket = F.floor(F.col("doc_id") / width)
    keys = plain.where("doc_id is not null").groupBy(bucket.alias("range")).agg(F.max("doc_id").alias("high"))
    follow = materialize(_last_of_next(keys))
    wanted = follow.select(F.col("next_id").alias("doc_id")).distinct()
    # Several rows may share that id: the first of them in descending order of text.
    heads = plain.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("head"))
    heads = follow.join(heads, follow["next_id"] == heads["doc_id"]).select(F.col("range").cast("string").alias("deal"), "head")
    heads = with_fingerprints(heads, {"head_print": "head"}, **sizes)
    # Rows without an id are dealt by hash, apart from the ranges, so that they spread.
    ranged = plain.withColumn("deal", F.when(F.col("doc_id").isNotNull(), bucket.cast("string")).otherwise(
        F.concat(F.lit("none "), F.pmod(F.xxhash64("text"), F.lit(65_536)).cast("string"))))
    # Dealt out before they are hashed, so that no fingerprint is shuffled; the join below has the same key.
    printed = with_fingerprints(ranged.repartition("deal"), {"fingerprint": "text"}, **sizes)
    order = Window.partitionBy("deal").orderBy(F.desc("doc_id"), F.desc("text"))
    follows = lambda c: F.when(F.col("doc_id").isNotNull(), F.lead(c).over(order))
    return (printed.withColumn("next_text", follows("text")).withColumn("next_print", follows("fingerprint"))
            .join(heads, "deal", "left")
            .select("doc_id", "text", "fingerprint", F.coalesce("next_text", "head").alias("next_text"),
                    F.coalesce("next_print", "head_print").alias("next_print")))


def edited(text: Column, next_text: Column) -> Column:
    """The last third of a text, in code points, replaced by the start of the next."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(F.coalesce(next_text, F.lit("")), F.lit(1), third))


def with_edited(docs: DataFrame, k: int = K, l: int = L, m: int = M, width: int = RANGE) -> DataFrame:  # noqa: E741
    """Fingerprints of each text and its edited text, and the likeness to the edited and the next text.

    A row without an id has no next text; it is compared with the empty one."""
    rows = with_next(docs, width, k=k, l=l, m=m)
    rows = rows.withColumn("next_text", F.coalesce("next_text", F.lit("")))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fingerprint", "next_print",
                       edited(F.col("text"), F.col("next_text")).alias("edited"))
    prints = with_fingerprints(rows, {"edited_fingerprint": "edited"}, k, l, m)
    nothing = F.array_repeat(F.xxhash64(F.lit(None).cast("long")), m)
    return prints.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fingerprint")).alias("fingerprint"), as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("next_print", nothing)).alias("near_next"))
