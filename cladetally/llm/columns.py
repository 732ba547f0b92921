"""Keep the columns of an input apart from those an operator adds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_apart(docs: DataFrame, used: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with every column that is not in `used` renamed, so that no name inside an operator meets it, and the
    names in order: new name to old."""
    names = {c if c in used else f"__in_{i}": c for i, c in enumerate(docs.columns)}
    return docs.toDF(*names), names


def put_back(rows: DataFrame, names: dict[str, str], added: tuple[str, ...] = ()) -> DataFrame:
    """The input's columns under their own names, then the added ones; an input column of an added one's name is
    replaced by it."""
    lowered = {a.lower() for a in added}
    return rows.select(*[F.col(new).alias(old) for new, old in names.items() if old.lower() not in lowered], *added)
