"""Elements of JSON arrays, read from byte ranges of files.

A file holds JSON objects such as `{"reports": [{...}, {...}], "total_count": 2}`, on one line or many; it may be one
object of many gigabytes. Spark reads it as text cut behind every `}`, so each task sees its splits only, and
any store that Spark reads will do. A split does not know whether it begins inside a string, nor how deep:

1. Every split states, for both cases, whether it ends inside a string and which brackets it closes and opens.
2. These statements, one row per split, are put together in file order: how every split begins.
3. Every split then yields the elements that lie in it, and the pieces of elements that cross its ends. The pieces, two
   at most for a split, are joined in file order.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cladetally.session import materialize

SPLIT = ["file", "block"]
KINDS = np.zeros(256, dtype=np.int8)  # opening brackets 1, closing ones -1
KINDS[[ord("{"), ord("[")]] = 1
KINDS[[ord("}"), ord("]")]] = -1
CURLY, SQUARE, QUOTE, ESCAPE = (ord(c) for c in '{["\\')


def _quotes(data: np.ndarray) -> np.ndarray:
    """Places of the quotes that begin or end a string: those after an even number of backslashes."""
    at = np.flatnonzero(data == QUOTE)
    if not (data == ESCAPE).any():
        return at
    plain = np.flatnonzero(data != ESCAPE)
    before = np.searchsorted(plain, at)
    last = np.where(before > 0, plain[np.maximum(before - 1, 0)], -1)
    return at[(at - last) % 2 == 1]


class Marks:
    """Brackets and quotes of a stretch of text that does not end within an escape."""

    def __init__(self, data: np.ndarray):
        kinds = KINDS[data]
        self.at = np.flatnonzero(kinds)
        quotes = _quotes(data)
        self.odd = len(quotes) % 2 == 1
        self.within = np.searchsorted(quotes, self.at) % 2 == 1
        self.kind, self.mark = kinds[self.at], data[self.at]

    def outside(self, in_string: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, kinds and marks of the brackets outside strings."""
        free = self.within == in_string
        return self.at[free], self.kind[free], self.mark[free]


class Reach:
    """Brackets that a stretch of text closes before it opened them, and those it leaves open."""

    def __init__(self, in_string: bool):
        self.in_string, self.closed, self.opened = in_string, 0, ""

    def read(self, marks: Marks) -> None:
        _, kind, mark = marks.outside(self.in_string)
        self.in_string ^= marks.odd
        if not len(kind):
            return
        depth = np.cumsum(kind, dtype=np.int64)
        closed = max(0, -int(depth.min()))
        # An opening bracket stays open where the depth never falls below its own again.
        left = (kind > 0) & (depth == np.minimum.accumulate(depth[::-1])[::-1])
        self.closed += max(0, closed - len(self.opened))
        self.opened = self.opened[:max(0, len(self.opened) - closed)] + mark[left].tobytes().decode()


class Elements:
    """Objects in an array directly under the root, cut out of a stretch of text that begins in a known state."""

    def __init__(self, in_string: bool, stack: str):
        self.in_string, self.stack = in_string, stack
        self.pieces: list[bytes] = []
        self.cut = self.inside  # the element at hand began before this stretch

    @property
    def inside(self) -> bool:
        return self.stack[:3] == "{[{"

    def read(self, data: np.ndarray) -> list[tuple[pa.Array, bool]]:
        """Elements that end here, and whether they began before the stretch."""
        marks = Marks(data)
        at, kind, mark = marks.outside(self.in_string)
        self.in_string ^= marks.odd
        inside = self.inside
        depth = len(self.stack) + np.cumsum(kind, dtype=np.int64)
        depth -= np.minimum(0, np.minimum.accumulate(depth)) if len(depth) else 0  # what closes nothing is passed over
        # The level of elements is entered and left in turn.
        starts = np.flatnonzero((kind > 0) & (depth == 3))
        ends = np.flatnonzero((kind < 0) & (depth == 2))
        found = []
        if inside and len(ends):
            self.pieces.append(data[:at[ends[0]] + 1].tobytes())
            found.append((pa.array([b"".join(self.pieces)], pa.binary()).cast(pa.string()), self.cut))
            self.pieces, self.cut = [], False
        elif inside:
            self.pieces.append(data.tobytes())
        if len(self.stack) >= 3:
            ends = ends[1:]
        under = self._marks_at(starts, 1, kind, depth, mark), self._marks_at(starts, 2, kind, depth, mark)
        wanted = (under[0] == CURLY) & (under[1] == SQUARE) & (mark[starts] == CURLY)
        low, high = at[starts[:len(ends)][wanted[:len(ends)]]], at[ends[wanted[:len(ends)]]] + 1
        if len(low):
            edges = np.zeros(len(data) + 1, dtype=np.int8)
            edges[low] += 1
            edges[high] -= 1
            kept = data[np.cumsum(edges[:-1], dtype=np.int8).view(bool)]
            offsets = np.concatenate([[0], np.cumsum(high - low)])
            found.append((pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept)).cast(pa.string()), False))
        if len(starts) > len(ends) and wanted[-1]:
            self.pieces.append(data[at[starts[-1]]:].tobytes())
        # The brackets left open: of the old ones as many as the depth never fell below, and the new ones.
        if len(depth):
            lowest = np.minimum.accumulate(depth[::-1])[::-1]
            left = (kind > 0) & (depth == lowest)
            self.stack = self.stack[:min(len(self.stack), int(lowest[0]) - int(left[0]))] + mark[left].tobytes().decode()
        return found

    def _marks_at(self, places: np.ndarray, level: int, kind: np.ndarray, depth: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The bracket that is open at a level before each place."""
        opened = np.flatnonzero((kind > 0) & (depth == level))
        before = np.searchsorted(opened, places)
        first = ord(self.stack[level - 1]) if len(self.stack) >= level else 0
        return np.concatenate([[first], mark[opened]])[before]


def _stretches(batches) -> Iterator[tuple[tuple, np.ndarray, pa.RecordBatch]]:
    """`(split, text, rows)` for the rows of a batch that belong to one split, in order."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            split = tuple(batch.column(c)[at].as_py() for c in SPLIT)
            # The rows of a split follow each other, so its last row ends it.
            end = batch.num_rows
            if split != tuple(batch.column(c)[end - 1].as_py() for c in SPLIT):
                other = pc.invert(pc.and_(*(pc.equal(batch.column(c).slice(at), v) for c, v in zip(SPLIT, split))))
                end = at + pc.index(other, True).as_py()
            rows = batch.slice(at, end - at)
            values = rows.column("value").cast(pa.binary())
            # The text is cut behind every bracket of this kind.
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), b"}")[0].as_py() + b"}"
            yield split, np.frombuffer(text, dtype=np.uint8), rows
            at = end


def _splits(batches, of) -> Iterator[tuple[tuple, object, np.ndarray | None]]:
    """`(split, reader, text)` for each stretch, in order; `of` makes the reader of a split from its first rows; last with text None."""
    now, reader = None, None
    for split, text, rows in _stretches(batches):
        if split != now:
            if now is not None:
                yield now, reader, None
            now, reader = split, of(split, rows)
        yield now, reader, text
    if now is not None:
        yield now, reader, None


def _reaches(batches):
    for split, readers, text in _splits(batches, lambda split, rows: (Reach(False), Reach(True))):
        if text is not None:
            marks = Marks(text)
            for reader in readers:
                reader.read(marks)
        else:
            yield pa.RecordBatch.from_pylist([
                {"file": split[0], "block": split[1], "starts_in": bool(i), "ends_in": bool(r.in_string), "closed": r.closed, "opened": r.opened}
                for i, r in enumerate(readers)], schema=pa.schema([
                    ("file", pa.int64()), ("block", pa.int64()), ("starts_in", pa.bool_()), ("ends_in", pa.bool_()),
                    ("closed", pa.int64()), ("opened", pa.string())]))


def _beginnings(reaches: pd.DataFrame) -> pd.DataFrame:
    """How each split of one file begins."""
    stated = {(r.block, r.starts_in): r for r in reaches.itertuples()}
    rows, in_string, stack = [], False, ""
    for block in sorted(reaches["block"].unique()):
        rows.append((reaches["file"].iloc[0], int(block), in_string, stack))
        reach = stated[(block, in_string)]
        stack = stack[:max(0, len(stack) - int(reach.closed))] + reach.opened
        in_string = bool(reach.ends_in)
    return pd.DataFrame(rows, columns=["file", "block", "in_string", "stack"])


def _unknown(file: int, block: int):
    raise RuntimeError(f"the split at {block} of the file with hash {file} was not there before; read again")


def _cut_out(batches, known: dict | None):
    """Elements of each split: whole, or a piece with `part` 0 (ends here), 1 (fills the split), 2 (begins here).
    Beginnings are `known`, or stand beside the text."""
    def begin(split, rows):
        if known is not None:
            return Elements(*(known.get(split) or _unknown(*split)))
        in_string, stack = (rows.column(c)[0].as_py() for c in ("in_string", "stack"))
        return _unknown(*split) if stack is None else Elements(in_string, stack)

    def rows_of(split, part, json):
        n = len(json)
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(split[0], pa.int64()), n), pa.repeat(pa.scalar(split[1], pa.int64()), n),
                                           pa.repeat(pa.scalar(part, pa.int32()), n), json], names=["file", "block", "part", "json"])

    for split, reader, text in _splits(batches, begin):
        if text is not None:
            for json, cut in reader.read(text):
                yield rows_of(split, 0 if cut else None, json)
        elif reader.pieces:
            yield rows_of(split, 1 if reader.cut else 2, pa.array([b"".join(reader.pieces)], pa.binary()).cast(pa.string()))


KNOWN_SPLITS = 100_000  # some 15 MB


def array_elements(spark: SparkSession, path, schema: str | None = None) -> DataFrame:
    """`json`: one row per object in an array directly under the root object of the files; or `r`: what `schema` reads of it.

    The files are read twice. Elements are stored once as they come out, so a schema keeps what it does not name off the disk.
    """
    # A file goes by the hash of its path, as every short row carries it.
    text = spark.read.option("lineSep", "}").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    reaches = text.mapInArrow(_reaches, "file bigint, block bigint, starts_in boolean, ends_in boolean, closed bigint, opened string")
    begins = materialize(reaches.groupBy("file").applyInPandas(_beginnings, "file bigint, block bigint, in_string boolean, stack string"))
    if begins.count() <= KNOWN_SPLITS:
        known = {(r["file"], r["block"]): (r["in_string"], r["stack"]) for r in begins.collect()}
        ordered = text
    else:
        known = None
        ordered = (text.withColumn("at", F.monotonically_increasing_id()).join(begins, SPLIT, "left")
                   .repartition(*SPLIT).sortWithinPartitions(*SPLIT, "at"))

    cut = ordered.mapInArrow(lambda batches: _cut_out(batches, known), "file bigint, block bigint, part int, json string")
    name, element = ("json", F.col("json")) if schema is None else ("r", F.from_json("json", schema))
    found = materialize(cut.select(*SPLIT, "part", F.when(F.col("part").isNotNull(), F.col("json")).alias("piece"),
                                   F.when(F.col("part").isNull(), element).alias(name)), compression="zstd")
    pieces = found.where("part is not null").withColumn("element", F.sum((F.col("part") == 2).cast("int")).over(
        W.partitionBy("file").orderBy("block", "part")))
    crossing = pieces.groupBy("file", "element").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "part", "piece"))), lambda p: p["piece"]), "").alias("json"))
    return found.where("part is null").select(name).unionByName(crossing.select(element.alias(name)))
