"""Mix sources to target weights in fixed-length blocks of words.

Each source's documents are laid end to end into one stream of words, cut into blocks of `block_words`.
A source's share of the mix becomes a number of slots. Slots are dealt to output shards by a hash, so the
counts of the sources in a shard are a multinomial draw, given the totals. Slot j of a source takes block
`perm(j mod blocks)`, with a keyed permutation of its own for each source; the last slot takes only the head of its
block, so that a source's words meet its target. Blocks are joined to documents by block index.

Only built-in expressions are used. No step gathers a source: offsets are running sums over hash buckets of
about `BUCKET_ROWS` documents plus running sums over the buckets' totals, and slots are exploded in two steps.

Defined cases: null text has no words; null sources form one source, ordered last; documents without words
are never taken; an empty table gives an empty mix; equal rows are documents of their own; rows without an id
take part. Input columns beside doc_id, text and source are ignored here and kept by `render`.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladetally.llm.columns import put_back, set_apart
from cladetally.llm.order_minhash import let
from cladetally.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 512
SLOTS_PER_SHARD = 1024
MAX_EPOCHS = 3
BUCKET_ROWS = 4096
SLOT_CHUNK = 32_768
ROUNDS = 4
FIRST_WALK = 6
WALK = 90


def word_count(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key() -> Column:
    """Equal for equal documents."""
    return F.xxhash64("doc_id", "source", "text")


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


def measure(docs: DataFrame) -> DataFrame:
    """Words of every document and the key of its row, without the text; stored, as all later steps read it."""
    return materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        row_key().alias("row_key"), word_count("text").alias("size"), _source_key().alias("source_key")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: its size, its weight by position among the sources, and its target.

    Targets share the size of all sources by weight. Those above `max_epochs` times their source stop there
    and the excess is shared again: in the order of size over weight, a source stops when the level that is
    left for it and all later ones would lift it above its limit. The table has one row per source."""
    by_source = sizes.groupBy("source_key").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    null_last = [F.col("source_key") == "", F.col("source_key")]
    position = F.row_number().over(Window.orderBy(*null_last)) - 1
    weighted = by_source.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (position % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything)
             - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    limit = max_epochs * F.col("source_size")
    leveled = weighted.withColumn("level", level).withColumn("stopped", F.col("level") * F.col("weight") > limit)
    final = F.min(F.when(~F.col("stopped"), F.struct(F.col("source_size") / F.col("weight"), "source_key", "level"))).over(everything)["level"]
    return leveled.withColumn("target", F.when(F.col("stopped") | (F.col("source_size") == 0), limit.cast("double"))
                              .otherwise(final * F.col("weight"))).drop("level", "stopped")


def positions(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Word offset of each document in its source's stream."""
    spread = sizes.join(sources.select("source_key", "source_rows"), "source_key").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "row_key"), F.ceil(F.col("source_rows") / BUCKET_ROWS)))
    totals = spread.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source_key", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start"))
    inside = (Window.partitionBy("source_key", "bucket").orderBy("doc_id", "row_key")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (spread.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(totals, ["source_key", "bucket"])
            .withColumn("start", F.col("bucket_start") + F.col("inner"))
            .drop("bucket", "bucket_start", "inner", "source_rows"))


def _plan(sources: DataFrame, block_words: int, seed: int, max_epochs: int) -> DataFrame:
    """Per source: words to take, whole epochs, full blocks, slots, and the key of its permutation."""
    size = F.col("source_size")
    return (sources.where("source_size > 0")
            .withColumn("to_take", F.least(F.round("target").cast("long"), max_epochs * size))
            .withColumn("epochs", F.expr("to_take div source_size"))
            .withColumn("rest", F.col("to_take") % size)
            .withColumn("full", F.expr(f"source_size div {block_words}"))
            .withColumn("blocks", F.ceil(size / block_words))
            .withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block_words))
            .withColumn("key", F.xxhash64(F.lit(seed), F.lit("permutation"), "source_key")))


def permuted(i: Column, n: Column, key: Column) -> Column:
    """Place of i in a permutation of 0 .. n - 1 that `key` chooses.

    A Feistel network of `ROUNDS` rounds permutes the numbers below the next power of two; a number that lands at n or
    above is sent through again until it lands below, which keeps every number below n met once. It lands there
    with a chance of a half or more each time; after some hundred times, which no run will see, an error ends the job."""
    bits = F.greatest(F.length(F.bin(F.greatest(n - 1, F.lit(1)))), F.lit(2))
    low_bits = F.floor(bits / 2).cast("int")
    one = F.lit(1).cast("long")
    shape = F.struct(low_bits.alias("b"), (F.call_function("shiftleft", one, low_bits) - 1).alias("low"),
                     (F.call_function("shiftleft", one, bits - low_bits) - 1).alias("high"), n.cast("long").alias("n"), key.alias("key"))

    def network(x, s):
        halves = F.struct(F.call_function("shiftright", x, s["b"]).alias("h"), x.bitwiseAND(s["low"]).alias("l"))
        for round_ in range(ROUNDS):
            halves = let(halves, (_high_round if round_ % 2 == 0 else _low_round)(s, round_))
        return let(halves, lambda v: F.call_function("shiftleft", v["h"], s["b"]).bitwiseOR(v["l"]))

    def walk(s):
        def sent_on(x, times):
            return F.aggregate(F.sequence(F.lit(1), F.lit(times)), x, lambda y, _: F.when(y < s["n"], y).otherwise(network(y, s)))

        def landed(x, otherwise):
            return let(x, lambda y: F.when(y < s["n"], y).otherwise(otherwise(y)))

        # Hardly any number is still on its way after the first few times.
        soon = sent_on(network(i.cast("long"), s), FIRST_WALK)
        lost = lambda _: F.raise_error(F.lit("a permutation did not land")).cast("long")
        return landed(soon, lambda x: landed(sent_on(x, WALK), lost))

    return let(shape, walk)


def _high_round(s: Column, number: int):
    return lambda v: F.struct(v["h"].bitwiseXOR(F.xxhash64(s["key"], F.lit(number), v["l"]).bitwiseAND(s["high"])).alias("h"), v["l"].alias("l"))


def _low_round(s: Column, number: int):
    return lambda v: F.struct(v["h"].alias("h"), v["l"].bitwiseXOR(F.xxhash64(s["key"], F.lit(number), v["h"]).bitwiseAND(s["low"])).alias("l"))


def draw(sources: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 1, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per slot of the mix: output shard, source, slot, epoch, block, the words taken from its start.

    In an epoch every full block comes once, in the order of the source's permutation; a short last block comes
    after them."""
    plan = _plan(sources, block_words, seed, max_epochs)
    shards = plan.select(F.greatest(F.ceil(F.sum("slots") / SLOTS_PER_SHARD), F.lit(1)).alias("n")).scalar()
    chunks = plan.where("slots > 0").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {SLOT_CHUNK}"))))
    # The rows are few and small until they are exploded: stated in number, the tasks are not merged by their size.
    number = plan.agg(F.sum(F.expr(f"(slots + {SLOT_CHUNK} - 1) div {SLOT_CHUNK}"))).first()[0] or 1
    tasks = min(number, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slots = (chunks.repartition(tasks, "source_key", "chunk")
             .withColumn("slot", F.explode(F.sequence(F.col("chunk") * SLOT_CHUNK,
                                                      F.least((F.col("chunk") + 1) * SLOT_CHUNK, F.col("slots")) - 1)))
             .withColumn("epoch", F.expr("slot div blocks"))
             .withColumn("turn", F.col("slot") % F.col("blocks")))
    walked = permuted(F.col("turn"), F.col("full"), F.col("key"))
    short = F.col("turn") == F.col("full")
    length = F.when(short, F.col("source_size") - F.col("full") * block_words).otherwise(F.lit(block_words).cast("long"))
    left = F.col("rest") - F.col("turn") * block_words
    return slots.select(
        F.pmod(F.xxhash64(F.lit(seed), "source_key", "slot"), shards).alias("shard"), "source_key", "slot", "epoch",
        F.when(short, F.col("full")).otherwise(walked).alias("block"),
        F.when(F.col("epoch") < F.col("epochs"), length).otherwise(F.least(length, left)).alias("words"))


def join_blocks(placed: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per slot and document that its words touch: `from_word` counts from the document's first word."""
    last = F.expr(f"(start + size - 1) div {block_words}")
    spans = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block_words}"), last)))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("words"))
    # The slots come from a handful of rows, so their size is estimated far too low for a broadcast.
    return (spans.join(slots.hint("merge"), ["source_key", "block"])
            .withColumn("from_word", begin - F.col("start"))
            .withColumn("n_words", end - begin)
            .where("n_words > 0"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), block_words: int = BLOCK_WORDS, seed: int = 1,
        max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Measured documents with their offsets, sources with targets, and the mix: the pieces of all slots."""
    sizes = measure(docs)
    sources = materialize(targets(sizes, weights, max_epochs))
    placed = positions(sizes, sources)
    pieces = join_blocks(placed, draw(sources, block_words, seed, max_epochs), block_words)
    return sizes, sources, pieces


def taken_words(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), block_words: int = BLOCK_WORDS, seed: int = 1) -> DataFrame:
    """One row per document: its size, its source's size and target, the words the mix takes of it."""
    sizes = measure(docs)
    sources = materialize(targets(sizes, weights))
    placed = positions(sizes, sources)
    pieces = join_blocks(placed, draw(sources, block_words, seed), block_words)
    # A document with words has its start to itself; the rest are never taken.
    taken = pieces.groupBy("source_key", "start", "doc_id", "row_key", "source", "size").agg(F.sum("n_words").alias("taken"))
    full = placed.where("size > 0").join(taken.select("source_key", "start", "taken"), ["source_key", "start"], "left")
    rows = full.select("doc_id", "source_key", "size", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")).unionByName(
        sizes.where("size = 0").select("doc_id", "source_key", "size", F.lit(0).cast("long").alias("taken")))
    return (rows.join(sources.select("source_key", "source_size", "target"), "source_key")
            .select("doc_id", "size", "source_size", "target", "taken"))


def render(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """The mix as documents: each document comes once for every time any of its words is taken, with the words
    of that time in their order. A copy that takes all words keeps the text as it is, others join their words by
    single spaces. Columns of `docs` are kept; n_chars, if there, is counted anew."""
    # Times a word range is taken are numbered per document by epoch, so a copy holds each word once at most.
    ranges = (pieces.groupBy("row_key", "source_key", "start", "size", "epoch")
              .agg(F.array_sort(F.collect_list(F.struct(F.col("from_word").cast("int").alias("from_word"), F.col("n_words").cast("int").alias("n_words")))).alias("ranges"),
                   F.sum("n_words").alias("copy_words"))
              # Equal rows share one row of text below.
              .groupBy("row_key").agg(F.collect_list(F.struct("start", "size", "epoch", "ranges", "copy_words")).alias("copies")))
    plain, names = set_apart(docs, {"doc_id", "source", "text", "n_chars"})
    keyed = plain.withColumn("row_key", row_key()).dropDuplicates(["row_key"])
    copies = keyed.join(ranges, "row_key").withColumn("copy", F.explode("copies"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(
        F.col("copy.ranges"), lambda r: F.slice(w, r["from_word"] + 1, r["n_words"]))), " "))[0]
    text = F.when(F.col("copy.copy_words") == F.col("copy.size"), F.col("text")).otherwise(part)
    out = copies.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return put_back(out, names)
