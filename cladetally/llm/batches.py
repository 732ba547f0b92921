"""Size of the batches that Python workers get."""

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH_BYTES = 4 << 20
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


UNITS = {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}


def in_bytes(size: str) -> int:
    """A size as Spark's settings state it: `4194304`, `16m`, `1GB`."""
    parts = re.fullmatch(r"(-?[0-9]+)([kmgtp]?)b?", size.strip().lower())
    if parts is None:
        raise ValueError(f"not a size: {size}")
    return int(parts[1]) << UNITS[parts[2]]


def bounded(df: DataFrame) -> DataFrame:
    """`df`, with Arrow batches of its session bounded to `BATCH_BYTES`; a smaller bound that the session has stays.

    An executor holds a batch several times (as rows, as Arrow on both sides, as objects), once for each task. The
    default of 64 MB is a sizeable part of an executor; a row larger than the bound is a batch of its own. The setting
    stays with the session, as frames are run after their operator has returned."""
    conf = df.sparkSession.conf
    if not 0 < in_bytes(conf.get(SETTING, "64m")) <= BATCH_BYTES:
        conf.set(SETTING, str(BATCH_BYTES))
    return df


def portions(texts: list, most: int):
    """Bounds of runs of texts that hold `most` characters together at most, or are one text."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > most and i > at:
            yield at, i
            at, size = i, len(text or "")
    if at < len(texts):
        yield at, len(texts)


def beside_text(df: DataFrame, make: Callable[[list], list[pa.Array]], added: str, most: int = BATCH_BYTES) -> DataFrame:
    """`df` with columns that `make` derives from the values of column `text`, for about `most` characters at once; `added` is
    their DDL. What `make` holds and returns is bounded by `most` but for longer texts.

    A step of its own, as Spark leaves a Python function over lambda expressions unevaluated."""
    fields = T._parse_datatype_string(added).fields

    def rows(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for low, high in portions(texts, most):
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, *make(texts[low:high])],
                                                 names=[*batch.schema.names, *[f.name for f in fields]])

    return bounded(df).mapInArrow(rows, T.StructType([*df.schema.fields, *fields]))
