"""Exact Jaccard join of documents' word n-gram sets, with skipping by set relations.

Two documents link when their sets of distinct five-word shingles have a Jaccard similarity of 0.8 or more. The
result names each document's connected component.

1. Sets and classes. Documents with equal sets are one class; only one set per class is joined.
2. Index. A set's tokens are put in one order for all sets: by how often a sample of the documents holds them, rare
   ones first, then by hash. The first l tokens that linked sets share stand among the first n - ceil(0.8 n) + l of
   either, so only those are indexed, with their position, and only sets that share l indexed tokens are compared;
   l = 1 + n / 32 keeps documents apart that share a passage. The order only decides the cost, never the result.
3. Answers of pivots. In every index list the set in which the list's token stands first is the pivot: it has
   the fewest rare tokens, so in a group of near copies it is the text the others were made from, or close to it. The
   sets that share l tokens of its lists with it are compared with it, which takes no more comparisons than the lists have entries.
   Their exact overlaps are kept, and of those that hold half of it the tokens that the pivot lacks, their extras.
4. Homes. Lists whose sets are all connected by now are skipped whole. Every set of the others gets a home: of the pivots
   that hold half of it, that of most sets; a set that the strongest home of its lists has not been compared with is compared with it.
5. Answers derived from them. Two sets x and y of the same home c overlap in at least o_x + o_y - n_c tokens, and without common extras in
   at most min(o_x, o_y); so they are accepted, refused, or share as many extras as the difference asks for. Those meet by an equality join
   on home and extra, over the rarest extras that one of so many must be among, where the positions leave room for the rest. Sets of
   different homes meet block by block: a list is cut into blocks by size, blocks that cannot hold partners
   are never joined, and entries whose positions leave too few tokens are skipped. What is left is compared.
6. Components by alternating large-star and small-star steps over the links.

Copies never meet in pairs; near copies meet their pivots, not each other. Sets are recomputed from the text where a
comparison needs them, so that no table of all sets is stored or moved.

Sets hold 64-bit hashes of shingles; a class is named by a 64-bit hash of its set, which two different sets of a
corpus share with a probability of about (number of sets)^2 / 2^65.

Defined cases: texts that are null or hold no word have the empty set, link with nothing, and are their own
component; texts of fewer than five words have their whole sequence as the one shingle; equal rows are linked; rows without an id
take part, and a component of none but them has the id null; an empty table gives no rows; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladetally.llm.batches import bounded
from cladetally.llm.columns import put_back, set_apart
from cladetally.llm.order_minhash import let
from cladetally.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
SAMPLE_SHARE = 16
SAMPLE_LEAST = 4
RANKED_TOKENS = 1 << 19
BROADCAST_KEYS = 1_000_000
SLICE_ROWS = 512
SALT_ROWS = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: Column) -> Column:
    """A-Z in lower case. Of texts of ASCII alone, whose bytes are as many as their characters, `lower` changes nothing else and is quicker."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shingles(text: Column, width: int = SHINGLE) -> Column:
    """Sorted array of the hashes of the distinct shingles."""
    words = F.transform(F.regexp_extract_all(_lowered(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    runs = let(words, lambda h: F.when(F.size(h) >= width, F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - width + 1, F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, width)])))
        .when(F.size(h) > 0, F.array(F.xxhash64(F.lit(0), h))).otherwise(F.array().cast("array<bigint>")))
    return F.sort_array(F.array_distinct(runs))


def linked(overlap: Column, n: Column, m: Column) -> Column:
    """100 * intersection >= 80 * union."""
    return 9 * overlap >= 4 * (n + m)


def _near_size(n: Column, m: Column) -> Column:
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m))


def shared_least(n: Column) -> Column:
    """Tokens of the index that two linked sets share at least; the smaller of the two sets' numbers counts."""
    return F.least(F.floor((4 * n + 4) / 5), 1 + F.floor(n / 32)).cast("int")


def token_ranks(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that several documents of a sixteenth of the texts hold, sorted, and their rank, rare ones first.

    The most frequent `RANKED_TOKENS` at most, 12 bytes each. All other tokens come before them."""
    sample = (docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_SHARE)) == 3)
              .withColumn("key", F.xxhash64("text")).dropDuplicates(["key"]))
    counts = (sample.select(F.explode(shingles(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
              .where(F.col("n") >= SAMPLE_LEAST).orderBy(F.desc("n"), "token").limit(RANKED_TOKENS)).toPandas()
    tokens = counts["token"].to_numpy(dtype=np.int64)
    ranks = np.arange(len(tokens), 0, -1, dtype=np.int32)
    order = np.argsort(tokens)
    return tokens[order], ranks[order]


def indexed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node (the class), n, and the indexed tokens in order. Stored: all later steps read it."""
    shared = docs.sparkSession.sparkContext.broadcast(token_ranks(docs))
    sets = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), shingles(F.col("text")).alias("h"))
            .select("doc_id", "text_key", F.xxhash64("h").alias("node"), F.size("h").alias("n"), "h"))

    def prefixes(batches):
        tokens, ranks = shared.value
        # Slices of a batch bound what the sort holds.
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            sizes = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column("h").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            if len(tokens) and len(flat):
                at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
                rank = np.where(tokens[at] == flat, ranks[at], 0)
                if rank.any():
                    flat = flat[np.lexsort((flat, rank, row))]
            least = (4 * sizes + 4) // 5
            kept = np.where(sizes > 0, sizes - least + np.minimum(least, 1 + sizes // 32), 0)
            inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            offsets = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[inside < np.repeat(kept, sizes)], pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "text_key", "node", "n")], prefix],
                                             names=["doc_id", "text_key", "node", "n", "prefix"])

    return materialize(bounded(sets).mapInArrow(prefixes, "doc_id long, text_key long, node long, n int, prefix array<long>"))


def compare(pairs: DataFrame, docs: DataFrame, classes: DataFrame, extras: bool = False) -> DataFrame:
    """Exact overlap of pairs (a, b) of classes as a, b, n_a, n_b, overlap; with `extras` also what b holds beside
    a where they share half of either.

    The texts of both sides are found in place by their keys and turned into sets there; only the sets travel, once
    for each pair of b and once for a. Without pairs no text is read."""
    number = pairs.count()
    if not number:
        kinds = {"n_a": "int", "n_b": "int", "overlap": "int"} | ({"extra": "array<long>"} if extras else {})
        return pairs.where(F.lit(False)).select("a", "b", *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()])
    names = classes.select("node", F.col("rep.doc_id").alias("__id"), F.col("rep.text_key").alias("__text"))
    # A pivot's set is there once for each `SALT_ROWS` of its partners, so these meet it in many tasks.
    salts = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).alias("salts")))
    salted = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts"))
    partners = materialize(salted.groupBy("b").agg(F.collect_list(F.struct("a", "salt")).alias("partners"))
                           .join(names, F.col("b") == F.col("node")).drop("node"))
    pivots = materialize(salts.join(names, F.col("a") == F.col("node")).drop("node")
                         .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).drop("salts"))
    # Broadcast up to a counted bound; beyond it a shuffled join finds the texts.
    few = number <= BROADCAST_KEYS
    texts = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))

    def sets(keys, *columns):
        found = texts.join(F.broadcast(keys) if few else keys,
                           F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__text")))
        return found.select(*columns, shingles(F.col("text")).alias("h"))

    members = sets(partners, "b", "partners").select("b", F.col("h").alias("h_b"), F.inline("partners"))
    heads = sets(pivots, "a", "salt").withColumnRenamed("h", "h_a")
    found = members.join(heads, ["a", "salt"]).select(
        "a", "b", F.size("h_a").alias("n_a"), F.size("h_b").alias("n_b"), F.size(F.array_intersect("h_a", "h_b")).alias("overlap"),
        *([F.array_except("h_b", "h_a").alias("extra")] if extras else []))
    if extras:
        found = found.withColumn("extra", F.when(2 * F.col("overlap") >= F.greatest("n_a", "n_b"), F.col("extra")))
    # Equal rows give a pair twice.
    return materialize(found.dropDuplicates(["a", "b"]))


def _stars(edges: DataFrame) -> bool:
    """Whether edges (u, v) are stars already: every u has one v, and no v is a u. One aggregate, no join."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                         F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").count() == 0


def components(links: DataFrame) -> DataFrame:
    """`node`, `root` for every node of links (a, b): root is the smallest node it is connected with.

    The driver plans two joins a round, and none where the links are stars from a smallest node already."""
    def pairs(one, other):
        return F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in (one, other)]))

    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not _stars(edges):
        # Large star: every larger neighbour of u moves to the smallest node next to u.
        both = edges.select(pairs(("u", "v"), ("v", "u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = materialize(large.join(least, "u").select(pairs(("v", "m"), ("u", "m"))).where("u <> v").distinct())
    return edges.select(F.inline(F.array(*[F.struct(F.col(u).alias("node"), F.col("v").alias("root")) for u in "uv"]))).distinct()


def _need(n: Column, m: Column, o: Column, r: Column) -> Column:
    """Common extras that linked sets of sizes n and m hold at least, by their overlaps o and r with one pivot."""
    return F.ceil(4 * (n + m) / 9).cast("int") - F.least(o, r)


def _extra_pairs(homes: DataFrame, close: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of different components that have their home pivot and enough of their extras in common.

    A set's own need is what a partner of the smallest size asks of it; so it shares one of its rarest e - need + 1
    extras with every partner. Extras are ordered by how many sets of the pivot hold them."""
    own = homes.join(close.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "extra"), ["pivot", "node"])
    own = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("e", F.size("extra"))
    own = own.withColumn("least", F.greatest(F.lit(1), F.ceil(4 * F.col("n") / 5).cast("int") - F.col("overlap"))).where("e >= least")
    spread = materialize(own.select("pivot", "node", "n", "overlap", "root", "e", "least", F.explode("extra").alias("token")))
    # Tokens of one component connect nothing.
    lists = materialize(spread.groupBy("pivot", "token").agg(F.count("*").alias("held"), F.min("root").alias("r0"), F.max("root").alias("r1")))
    ranked = spread.join(lists.select("pivot", "token", "held"), ["pivot", "token"]).withColumn(
        "pos", F.row_number().over(Window.partitionBy("pivot", "node").orderBy("held", "token")) - 1).where("pos <= e - least")
    entries = materialize(ranked.join(lists.where("r0 <> r1").select("pivot", "token"), ["pivot", "token"], "left_semi"))
    fields = ("node", "n", "root", "overlap", "e", "pos")
    x, y = (entries.select("pivot", "token", *[F.col(c).alias(f"{side}_{c}") for c in fields]) for side in "xy")
    need = _need(F.col("x_n"), F.col("y_n"), F.col("x_overlap"), F.col("y_overlap"))
    return (x.join(y, ["pivot", "token"])
            .where((F.col("x_node") < F.col("y_node")) & (F.col("x_root") != F.col("y_root")) & _near_size(F.col("x_n"), F.col("y_n"))
                   & (F.least(F.col("x_e") - F.col("x_pos"), F.col("y_e") - F.col("y_pos")) >= need))
            .select(F.col("x_node").alias("a"), F.col("y_node").alias("b"), F.lit(False).alias("sure")).distinct())


def _open_entries(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of the lists that hold several components."""
    rooted = materialize(lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    open_ = rooted.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("token")
    return materialize(rooted.join(open_, "token").dropDuplicates(["token", "node"]))


def _homes(entries: DataFrame, close: DataFrame) -> DataFrame:
    """Home pivot of each set of the entries: of the pivots it holds half of, that with most such sets. A pivot may be
    its own home. node, n, pivot, overlap, n_pivot, members."""
    members = close.groupBy(F.col("a").alias("pivot")).agg(F.count("*").alias("members"), F.max("n_a").alias("n_pivot"))
    known = close.select(F.col("a").alias("pivot"), F.col("b").alias("node"), F.col("n_b").alias("n"), "overlap").join(members, "pivot")
    own = members.select("pivot", F.col("pivot").alias("node"), F.col("n_pivot").alias("n"), F.col("n_pivot").alias("overlap"), "members", "n_pivot")
    best = F.max_by(F.struct("pivot", "n", "overlap", "n_pivot", "members"), F.struct("members", "pivot")).alias("h")
    found = known.unionByName(own).join(entries.select("node").distinct(), "node", "left_semi").groupBy("node").agg(best)
    return found.select("node", "h.*")


def _wanted_homes(entries: DataFrame, homes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) to compare so that sets of one group get the same home: each set with the pivot of most members
    that is the home of a set in one of its lists, where its own has fewer members or none. At most one for each set."""
    homed = entries.select("token", "node", "n").join(homes.select("node", "pivot", "members"), "node", "left")
    strongest = homed.groupBy("token").agg(F.max(F.struct("members", "pivot")).alias("s")).where("s.pivot is not null")
    wish = (homed.join(strongest, "token").groupBy("node").agg(F.max("n").alias("n_b"), F.max("members").alias("members"), F.max("s").alias("s"))
            .where("node <> s.pivot and (members is null or members < s.members)"))
    # Half of either can only be shared by sets of which one is at most twice the other.
    return wish.select(F.col("s.pivot").alias("a"), F.col("node").alias("b"), "n_b").join(sizes, "a").where(
        2 * F.least("n_a", "n_b") >= F.greatest("n_a", "n_b")).select("a", "b")


def _both_ways(answers: DataFrame) -> DataFrame:
    return answers.select("a", "b").union(answers.select(F.col("b").alias("a"), F.col("a").alias("b")))


def links(docs: DataFrame, index: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that connect the same classes as all qualifying pairs do: a class and the root of its
    component where the pivots' answers settle that, and the links found after."""
    postings = index.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    first = F.shiftleft(F.col("pos").cast("long"), 32) + F.pmod("node", F.lit(1 << 32))
    ends = (postings.groupBy("token").agg(F.min_by("node", first).alias("pivot"), F.min("node").alias("low"), F.max("node").alias("high"))
            .where("low <> high"))
    lists = materialize(postings.join(ends.select("token", "pivot"), "token").select("token", "pos", "node", "n", "pivot"))

    stars = (lists.where("node <> pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b"))
             .agg(F.max("n").alias("n_b"), F.countDistinct("token").alias("shared")))
    sizes = classes.select(F.col("node").alias("a"), F.col("n").alias("n_a"))
    stars = stars.join(sizes, "a").where(_near_size(F.col("n_a"), F.col("n_b")) & (F.col("shared") >= shared_least(F.least("n_a", "n_b"))))
    answers = compare(materialize(stars.select("a", "b")), docs, classes, extras=True)

    def linking(found):
        return found.where(linked(F.col("overlap"), F.col("n_a"), F.col("n_b"))).select("a", "b")

    # Sets that share lists get the same pivot where they can: one more comparison for a set at most.
    roots = components(linking(answers))
    entries = _open_entries(lists.drop("pivot"), roots)
    # Stored, as it is read twice: the driver plans its joins once.
    wanted = _wanted_homes(entries, materialize(_homes(entries, answers.where(F.col("extra").isNotNull()))), sizes)
    more = materialize(wanted.join(answers.select("a", "b"), ["a", "b"], "left_anti"))
    added = compare(more, docs, classes, extras=True)
    answers = answers.unionByName(added)
    # Components so far and the new links: those found before are not walked again.
    roots = materialize(components(linking(added).union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))))
    entries = _open_entries(entries.drop("root"), roots)
    close = answers.where(F.col("extra").isNotNull())
    homes = materialize(_homes(entries, close))

    entries = materialize(entries.join(homes.select("node", "pivot", "overlap", "n_pivot"), "node", "left")
                          # Sizes that link differ by a factor of 1.25 at most: partners are in the same block or the next.
                          .withColumn("block", F.floor(F.log(F.col("n")) / F.log(F.lit(1.25)) + 1e-9)))
    fields = ["pos", "node", "n", "root", "pivot", "overlap"]
    x = entries.select("token", "block", "n_pivot", *[F.col(c).alias(f"x_{c}") for c in fields])
    y = entries.select("token", F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block"), *[F.col(c).alias(f"y_{c}") for c in fields], F.col("block").alias("own"))
    n, m = F.col("x_n"), F.col("y_n")
    same_home = F.coalesce(F.col("x_pivot") == F.col("y_pivot"), F.lit(False))
    # Each of the first l common tokens leaves room for the rest of the overlap behind it.
    least_shared = shared_least(F.least(n, m))
    room = F.least(n - F.col("x_pos"), m - F.col("y_pos")) + least_shared - 1
    met = x.join(y, ["token", "block"]).where(
        (F.col("x_root") != F.col("y_root"))
        # Within a block each pair once; across blocks the smaller block is y's.
        & ((F.col("own") < F.col("block")) | (F.col("x_node") < F.col("y_node")))
        & _near_size(n, m) & linked(room, n, m)
        # Sets of one home that need common extras meet by these.
        & (~same_home | (_need(n, m, F.col("x_overlap"), F.col("y_overlap")) <= 0)))
    least = F.when(same_home, F.col("x_overlap") + F.col("y_overlap") - F.col("n_pivot"))
    swap = F.col("x_node") < F.col("y_node")
    a = F.when(swap, F.col("x_node")).otherwise(F.col("y_node"))
    b = F.when(swap, F.col("y_node")).otherwise(F.col("x_node"))
    pairs = (met.select(a.alias("a"), b.alias("b"), least_shared.alias("l"), F.coalesce(linked(least, n, m), F.lit(False)).alias("sure"))
             .groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("l").alias("l"), F.max("sure").alias("sure"))
             .where("shared >= l").select("a", "b", "sure"))
    pairs = (pairs.union(_extra_pairs(homes, close, roots)).groupBy("a", "b").agg(F.max("sure").alias("sure"))
             # Pivots may be on either side of a pair.
             .join(_both_ways(answers).distinct(), ["a", "b"], "left_anti"))
    pairs = materialize(pairs)
    rest = compare(pairs.where(~F.col("sure")).select("a", "b"), docs, classes)
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(pairs.where("sure").select("a", "b")).union(linking(rest))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_key (hash of the text), n_shingles, class_id and component_id, the smallest
    ids among equal sets and among connected documents, and root, which names the component itself: ids may be null
    or stand on several texts. Without words root is null."""
    docs = docs.select("doc_id", "text")
    index = indexed(docs)
    filled = index.where("n > 0")
    classes = materialize(filled.groupBy("node").agg(
        F.min("doc_id").alias("class_id"), F.max("n").alias("n"), F.min(F.struct("doc_id", "text_key")).alias("rep")))
    roots = components(links(docs, filled, classes))
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    found = materialize(named.join(smallest, "root").select("node", "class_id", "component_id", "root"))
    rows = index.select("doc_id", "text_key", "node", F.col("n").cast("long").alias("n_shingles"))
    joined = rows.where("n_shingles > 0").join(found, "node").select("doc_id", "text_key", "n_shingles", "class_id", "component_id", "root")
    alone = rows.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"),
                                              F.lit(None).cast("long").alias("root"))
    return joined.unionByName(alone)


def keep_first(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each component: that with the smallest id, of rows equal in id one."""
    rows = materialize(near_duplicates(docs))
    plain, names = set_apart(docs, {"doc_id", "text"})
    keyed = plain.withColumn("__key", F.xxhash64("text"))
    # The rows that go are fewer than those that stay; a null id stays only where no other is in its component.
    gone = materialize(rows.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
                       .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text")).distinct())
    other = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    left = keyed.join(other, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text")), "left_anti")
    repeated = rows.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeated:
        # Rows with words that share an id, or have none, and are connected: one of them stays.
        named = rows.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text"), "root").distinct()
        left = left.join(named, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text")))
        solo = left.where("root is null").select(*names)
        left = left.where("root is not null").dropDuplicates(["root"]).select(*names).unionByName(solo)
    return put_back(left, names)
