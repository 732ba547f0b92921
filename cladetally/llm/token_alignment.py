"""Align the tokens of two tokenizers on the bytes of each text, and count corpus-wide which ids stand for each other.

A is a byte-level BPE stated as ranks, B a sentencepiece model; both encode a blank and the text, B adding the blank itself.
Special tokens written in a text are plain text. Byte offsets at which tokens of both end cut them into groups;
two tokens whose bytes overlap are linked.

1. Identity map. For every id of A the id of B with the same bytes, if there is one, is computed once per worker. Links
   of such a pair are counted in a vector over A's vocabulary, one vector a task; they never meet in a shuffle.
2. Irregular groups. Only pairs of other ids enter a shuffle, summed on the map side: one row per pair and task.
3. Look-up. The pairs that make up at least a FREQUENT-th of all irregular entries are at most FREQUENT; they and the vectors (a
   number per id of A) go to every task. Documents' other pairs meet their counts in a shuffled join; such a pair is held
   by less than a FREQUENT-th of the entries, so no key is hot.

Groups are found for many texts at once, in arrays over their bytes. Texts are tokenized once: what counting needs of
them (distinct pairs with multiplicities) is stored in the shared folder. A document's row is named by a number
stored with it, as ids may be null or repeated.

Defined cases: texts that are null, empty, or whose tokens do not spell the blank and the text (B's normalization or unknown
characters) have no tokens: counts are zero and `groups` is empty; repeated rows count as documents of their own; an empty table
gives no rows; all input columns are passed through, those named like an added one are replaced by it.
"""

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladetally.llm.batches import beside_text, bounded
from cladetally.llm.columns import put_back, set_apart
from cladetally.llm.packing import encoding, slices
from cladetally.session import materialize

SLICE_CHARS = 1 << 18
FREQUENT = 1 << 16
SPACE = "▁"
SAME = "array<struct<a: int, n: int>>"
PAIRS = "array<struct<a: int, b: int, n: int>>"
ADDED = ("n_a", "n_b", "n_groups", "n_links", "groups", "same", "pairs")

_VOCABULARIES: dict = {}


class Vocabularies:
    """Both tokenizers, their tokens' bytes, and the identity map."""

    def __init__(self, ranks_path: str, model_path: str):
        import sentencepiece

        self.a = encoding(ranks_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        with open(ranks_path, "rb") as lines:
            ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
        a_bytes = [ranks.get(i, b"") for i in range(max(ranks) + 1)]
        b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_of = [pa.array(side, pa.binary()) for side in (a_bytes, b_bytes)]
        self.lengths = [np.array([len(t) for t in side], dtype=np.int64) for side in (a_bytes, b_bytes)]
        # Of several pieces with the same bytes the last is the written one; single bytes come before it.
        by_bytes = {t: i for i, t in enumerate(b_bytes) if t}
        self.same = np.array([by_bytes.get(t, -1) for t in a_bytes], dtype=np.int64)
        # An id as decimal text with what follows it: "," within its side of a group, "|" after A's, ";" after B's.
        self.written = pa.array([f"{i}{end}" for side, ends in ((a_bytes, ",|"), (b_bytes, ",;")) for i in range(len(side)) for end in ends])

    def _piece(self, i: int) -> bytes:
        if self.b.is_unknown(i) or self.b.is_control(i):
            return b""
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a = [np.concatenate([self.a.encode_to_numpy(part, disallowed_special=()) for part in slices(" " + t)]) for t in texts]
        return a, [np.array(ids, dtype=np.uint32) for ids in self.b.encode(texts, num_threads=1)]


def vocabularies(ranks_path: str, model_path: str) -> Vocabularies:
    """One for each worker."""
    key = (ranks_path, model_path)
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabularies(*key)
    return _VOCABULARIES[key]


@dataclass
class Aligned:
    """Results of several texts; `same` and `pairs` are (text, a, n) and (text, a, b, n) in order."""
    counts: np.ndarray  # texts x (n_a, n_b, n_groups, n_links)
    groups: list[bytes]
    same: tuple[np.ndarray, ...]
    pairs: tuple[np.ndarray, ...]


def align_texts(texts: list[str | None], known: Vocabularies) -> Aligned:
    counts, groups = np.zeros((len(texts), 4), dtype=np.int64), [b""] * len(texts)
    none = np.empty(0, dtype=np.int64)
    number = np.array([i for i, t in enumerate(texts) if t], dtype=np.int64)
    encoded = known.encode([texts[i] for i in number])
    sizes = [np.array([len(ids) for ids in side], dtype=np.int64) for side in encoded]
    spelled = np.ones(len(number), dtype=bool)
    for side in (0, 1):
        flat = np.concatenate([*encoded[side], np.empty(0, dtype=np.uint32)])
        joined = known.bytes_of[side].take(pa.array(flat.astype(np.int32)))
        edges = np.frombuffer(joined.buffers()[1], dtype=np.int32)[np.concatenate([[0], np.cumsum(sizes[side])])] if len(flat) else np.zeros(len(number) + 1, int)
        data = joined.buffers()[2].to_pybytes() if len(flat) else b""
        for j, i in enumerate(number):
            spelled[j] &= data[edges[j]:edges[j + 1]] == b" " + texts[i].encode()
    if not spelled.any():
        return Aligned(counts, groups, (none,) * 3, (none,) * 4)
    number = number[spelled]
    sizes = [s[spelled] for s in sizes]
    ids = [np.concatenate([e for e, ok in zip(side, spelled) if ok]).astype(np.int64) for side in encoded]
    ends = [np.cumsum(known.lengths[side][ids[side]]) for side in (0, 1)]
    total = int(ends[0][-1])
    here = []
    for side in (0, 1):
        marks = np.zeros(total + 1, dtype=bool)
        marks[ends[side]] = True
        here.append(marks)
    # Between two ends that follow each other lies one pair of overlapping tokens.
    cut = np.flatnonzero(here[0] | here[1])
    token = [(np.cumsum(marks, dtype=np.int32)[cut] - marks[cut]) for marks in here]
    a, b = ids[0][token[0]], ids[1][token[1]]
    text_of_a = np.repeat(np.arange(len(number)), sizes[0])
    text = text_of_a[token[0]]
    both = here[0] & here[1]
    before = np.cumsum(both, dtype=np.int32) - both  # groups that end before a byte
    group = [before[ends[side]] for side in (0, 1)]
    closes = [both[ends[side]] for side in (0, 1)]
    n_groups = int(group[0][-1]) + 1
    per_group = [np.bincount(g, minlength=n_groups) for g in group]
    counts[number, 0], counts[number, 1] = sizes
    counts[number, 2] = np.bincount(text_of_a[closes[0]], minlength=len(number))
    counts[number, 3] = np.bincount(text, minlength=len(number))

    order = np.empty(len(ids[0]) + len(ids[1]), dtype=np.int32)
    order[np.arange(len(ids[0])) + (np.cumsum(per_group[1]) - per_group[1])[group[0]]] = 2 * ids[0] + closes[0]
    order[np.arange(len(ids[1])) + np.cumsum(per_group[0])[group[1]]] = 2 * len(known.same) + 2 * ids[1] + closes[1]
    written = known.written.take(pa.array(order))
    places = np.frombuffer(written.buffers()[1], dtype=np.int32)[np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])])]
    data = written.buffers()[2].to_pybytes()
    for j, i in enumerate(number):
        groups[i] = data[places[j]:places[j + 1] - 1]

    regular = known.same[a] == b
    wide_a, wide_b = len(known.same), len(known.lengths[1])
    key, n = np.unique(text[regular] * wide_a + a[regular], return_counts=True)
    same = (number[key // wide_a], key % wide_a, n)
    key, n = np.unique((text[~regular] * wide_a + a[~regular]) * wide_b + b[~regular], return_counts=True)
    pairs = (number[key // (wide_a * wide_b)], key // wide_b % wide_a, key % wide_b, n)
    return Aligned(counts, groups, same, pairs)


def _lists(rows: tuple[np.ndarray, ...], names: list[str], texts: int) -> pa.Array:
    offsets = np.searchsorted(rows[0], np.arange(texts + 1)).astype(np.int32)
    fields = [pa.array(c.astype(np.int32)) for c in rows[1:]]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names))


def align(docs: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """`docs` with n_a, n_b, n_groups, n_links, `groups` (`a1,a2|b1;a3|b2,b3`: ids of A and B, in order), and the distinct
    linked ids with the number of links: `same` those of the identity map, `pairs` the others."""
    def aligned(texts: list[str | None]) -> list[pa.Array]:
        done = align_texts(texts, vocabularies(ranks_path, model_path))
        return [*[pa.array(done.counts[:, c]) for c in range(4)], pa.array(done.groups, pa.binary()).cast(pa.string()),
                _lists(done.same, ["a", "n"], len(texts)), _lists(done.pairs, ["a", "b", "n"], len(texts))]

    plain, names = set_apart(docs, {"text"})
    found = beside_text(plain, aligned, f"n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, same {SAME}, pairs {PAIRS}", SLICE_CHARS)
    return put_back(found, names, ADDED)


def same_counts(aligned: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each id of A linked with its like: a vector a task, summed."""
    def vectors(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).flatten().field("a").to_numpy(zero_copy_only=False)
            total += np.bincount(ids, minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["a", "n"])

    out = np.zeros(size, dtype=np.int64)
    for row in bounded(aligned.select("same")).mapInArrow(vectors, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect():
        out[row["a"]] = row["n"]
    return out


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, documents that hold them linked; pairs of the identity map are not among them."""
    return aligned.select(F.inline("pairs")).groupBy("a", "b").agg(F.count("*").alias("docs"))


def count_links(aligned: DataFrame, ranks_path: str, model_path: str, frequent: int = FREQUENT) -> DataFrame:
    """`aligned`, without `same` and `pairs`, with n_best (links whose count is their A id's highest) and count_sum. A
    pair's count is the number of documents that hold it linked."""
    known = vocabularies(ranks_path, model_path)
    wide_b, size = len(known.lengths[1]), len(known.same)
    renamed, names = set_apart(aligned.drop("n_best", "count_sum"), {"same", "pairs"})
    rows = materialize(renamed.withColumn("__row", F.monotonically_increasing_id()))
    same = same_counts(rows, size)
    pairs = materialize(pair_counts(rows))
    best = same.copy()
    for row in pairs.groupBy("a").agg(F.max("docs").alias("most")).collect():  # one row per id of A
        best[row["a"]] = max(best[row["a"]], row["most"])
    entries = pairs.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    # At most `frequent` pairs hold a frequent-th of the entries each.
    often = pairs.where(F.col("docs") * frequent >= entries).select((F.col("a").cast("long") * wide_b + F.col("b")).alias("key"), "docs").orderBy("key").toPandas()
    shared = rows.sparkSession.sparkContext.broadcast((same, best, often["key"].to_numpy(np.int64), often["docs"].to_numpy(np.int64)))

    @F.arrow_udf(f"struct<n_best: bigint, count_sum: bigint, rare: {PAIRS}>")
    def looked_up(same_lists: pa.Array, pair_lists: pa.Array) -> pa.Array:
        same_docs, most, keys, docs = shared.value
        n_best, count_sum = np.zeros(len(same_lists)), np.zeros(len(same_lists), dtype=np.int64)

        def add(text, a, n, count):
            n_best[:] += np.bincount(text, weights=n * (count == most[a]), minlength=len(n_best))
            np.add.at(count_sum, text, n * count)

        def flat(lists, fields):
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten()
            return np.repeat(np.arange(len(lists)), sizes), *[values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]

        text, a, n = flat(same_lists, ["a", "n"])
        add(text, a, n, same_docs[a])
        text, a, b, n = flat(pair_lists, ["a", "b", "n"])
        key = a * wide_b + b
        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        found = keys[at] == key if len(keys) else np.zeros(len(key), dtype=bool)
        add(text[found], a[found], n[found], docs[at[found]])
        rare = _lists((text[~found], a[~found], b[~found], n[~found]), ["a", "b", "n"], len(same_lists))
        return pa.StructArray.from_arrays([pa.array(n_best.astype(np.int64)), pa.array(count_sum), rare], ["n_best", "count_sum", "rare"])

    marked = bounded(rows).withColumn("__l", looked_up("same", "pairs")).drop("same", "pairs")
    # A pair's own count against its id's highest, which may be one of the identity map.
    highest = rows.sparkSession.createDataFrame(
        pa.table({"a": pa.array(np.flatnonzero(best), pa.int32()), "most": pa.array(best[best > 0], pa.int64())}))
    rest = pairs.where(F.col("docs") * frequent < entries).join(highest, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).cast("long").alias("top"))
    others = (marked.select("__row", F.inline("__l.rare")).join(rest, ["a", "b"])
              .groupBy("__row").agg(F.sum(F.col("n") * F.col("top")).alias("__best"), F.sum(F.col("n") * F.col("docs")).alias("__sum")))
    found = marked.join(others, "__row", "left").select(
        "*", (F.col("__l.n_best") + F.coalesce("__best", F.lit(0))).alias("n_best"),
        (F.col("__l.count_sum") + F.coalesce("__sum", F.lit(0))).alias("count_sum"))
    names = {new: old for new, old in names.items() if new not in ("same", "pairs")}
    return put_back(found, names, ("n_best", "count_sum"))
