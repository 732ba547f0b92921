"""Remove sentences that a repeated run of consecutive sentences covers.

A sentence ends with a run of `.`, `!`, `?` that no letter or digit follows directly (`3.5`, `e.g.` go on), with a sentence mark of
another script, or at a line end; closing quotes and the white space after it belong to it. From every sentence a run
goes on, and up to every sentence a run comes from before, until it holds `span` sentences and `min_words` words; each is hashed.
So a repeated passage of that size is covered from its first sentence to its last, however short its sentences are, and
what a few common words make up by chance ("Yes." "No." "Ok.") is no passage. Scripts written without blanks count each character as a word.

Over all documents the first occurrence of a run, in the order of document id and position, stays; the sentences of
every other occurrence go, in the same document or another.

Scale: runs are reduced to first occurrences by an aggregate that combines on the map side, so a run that a third of
all documents hold is one row per task; the occurrences then join these on the hash, which AQE splits when a run
is frequent. Runs are compared by 128 bits of hash. Only one document's own positions are ever gathered.

Defined cases: null text stays null and has no sentences; empty texts are kept; rows equal in id and text are one
document and treated alike; rows without an id come last in the order; all input columns but `text` are passed
through; the added ones, `n_sentences` and `n_removed`, replace input columns of these names.
"""

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladetally.llm.batches import bounded
from cladetally.llm.columns import put_back, set_apart
from cladetally.session import materialize

# White space; sentence marks of other scripts; closing quotes and brackets; scripts written without blanks.
SPACE = " \t\n\r\x0b\x0c"
ENDS = "。！？｡।॥؟۔"
CLOSING = "\"'”’»)\\]」』"
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
SENTENCE = regex.compile(
    rf"(?:\.\p{{L}}\.|[.!?]++[^.!?{ENDS}{CLOSING}{SPACE}]|[^.!?\n{ENDS}]++)++(?:(?:[.!?]++|[{ENDS}]++)[{CLOSING}]*+[{SPACE}]*+|\n[{SPACE}]*+)?+"
    rf"|(?:[.!?]++|[{ENDS}]++)[{CLOSING}]*+[{SPACE}]*+|\n[{SPACE}]*+")
WORD = regex.compile(rf"[{UNSPACED}]|[^{SPACE}{UNSPACED}]+")
SPAN = 3
MIN_WORDS = 12
RUN_SCHEMA = "doc_id string, key bigint, pos int, n int, h1 bigint, h2 bigint"


def sentences(text: str) -> list[str]:
    """Sentences with what separates them, so that joining them gives the text."""
    return SENTENCE.findall(text)


def word_count(sentence: str) -> int:
    # Words of ASCII text are what blanks separate; bytes split at these alone.
    return len(sentence.encode().split()) if sentence.isascii() else len(WORD.findall(sentence))


def run_bounds(words: list[int], span: int = SPAN, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """First and behind the last sentence of every run: the shortest from each sentence on and up to each sentence."""
    upto = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    n, at = len(words), np.arange(len(words) + 1)
    # Sums grow, so a sorted search finds where enough words are reached.
    ends = np.maximum(np.searchsorted(upto, upto[:-1] + min_words, side="left"), at[:-1] + span)
    starts = np.minimum(np.searchsorted(upto, upto[1:] - min_words, side="right") - 1, at[1:] - span)
    runs = {(int(i), int(e)) for i, e in zip(at[:-1], ends) if e <= n}
    runs |= {(int(i), int(e)) for i, e in zip(starts, at[1:]) if i >= 0}
    return sorted(runs)


def hashed_runs(text: str, span: int = SPAN, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int]]:
    """Position, number of sentences and 128 bits of hash of every run."""
    parts = sentences(text)
    bare = [s.strip(SPACE) for s in parts]
    out = []
    for i, e in run_bounds([word_count(s) for s in bare], span, min_words):
        digest = hashlib.blake2b("\n".join(bare[i:e]).encode(), digest_size=16).digest()
        out.append((i, e - i, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__key", F.xxhash64(F.col("doc_id").cast("string"), "text"))


def runs(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per hashed run: document, first sentence, number of sentences, hash."""
    def rows(batches):
        for batch in batches:
            columns = [[] for _ in range(6)]
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                for run in hashed_runs(text, span, min_words):
                    for column, value in zip(columns, (doc_id, key, *run)):
                        column.append(value)
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "key", "pos", "n", "h1", "h2"])

    keyed = _keyed(docs.select("doc_id", "text").where(F.col("text").isNotNull()))
    plain = keyed.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("__key").alias("key"), "text")
    return bounded(plain).mapInArrow(rows, RUN_SCHEMA).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("key").alias("__key"), F.struct("pos", "n", "h1", "h2").alias("r")).select("doc_id", "__key", "r.*")


def repeated(found: DataFrame) -> DataFrame:
    """Runs that are not the first with their hash."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("__key"), F.col("pos"))
    placed = found.withColumn("place", place)
    # Stored, so that both sides of the join are plain shuffles and Spark can split a run that many documents hold.
    first = materialize(placed.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("final"))
                        .where(F.col("first") != F.col("final")).select("h1", "h2", "first"))
    return placed.join(first, ["h1", "h2"]).where(F.col("place") != F.col("first")).select("doc_id", "__key", "pos", "n")


def without(text: str | None, gone: list[dict]) -> tuple[str | None, int, int]:
    """The text without the sentences of the runs, its number of sentences and of those removed."""
    if text is None:
        return None, 0, 0
    parts = sentences(text)
    if not gone:
        return text, len(parts), 0
    covered = np.zeros(len(parts) + 1, dtype=np.int64)
    np.add.at(covered, [r["pos"] for r in gone], 1)
    np.add.at(covered, [r["pos"] + r["n"] for r in gone], -1)
    kept = [s for s, c in zip(parts, np.cumsum(covered).tolist()) if not c]
    return "".join(kept), len(parts), len(parts) - len(kept)


def remove_repeated(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with the text that stays, the number of sentences and of those removed."""
    # Two documents share a key only by a collision of the hash; one row per key keeps rows from multiplying.
    gone = repeated(runs(docs, span, min_words)).groupBy("__key").agg(F.collect_set(F.struct("pos", "n")).alias("__gone"))
    plain, names = set_apart(docs, {"doc_id", "text"})
    joined = _keyed(plain).join(gone, "__key", "left").drop("__key")
    schema = T.StructType([*[f for f in joined.schema.fields if f.name not in ("text", "__gone")],
                           T.StructField("text", T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])

    def rows(batches):
        for batch in batches:
            done = [without(t, g) for t, g in zip(batch.column("text").to_pylist(), batch.column("__gone").to_pylist())]
            kept = [batch.column(f.name) for f in schema.fields[:-3]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
                                              pa.array([d[2] for d in done], pa.int64())], names=schema.names)

    return put_back(bounded(joined).mapInArrow(rows, schema), names, ("n_sentences", "n_removed"))
