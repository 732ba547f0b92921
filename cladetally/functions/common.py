"""Small expression helpers shared by the other modules."""

from functools import reduce

from pyspark.sql import Column, functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim blanks, tabs and line ends on both sides."""
    return F.btrim(as_col(c), F.lit(" \t\r\n"))


def contains_any(c, words) -> Column:
    """True when the text holds any of the words, taken literally."""
    c = as_col(c)
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def before(c, mark: str) -> Column:
    """Text before the first mark; all of it when the mark is absent."""
    return F.substring_index(as_col(c), mark, 1)


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def round_even(c, places: int) -> Column:
    """Round half to even, the rule of the numeric tables this library reproduces."""
    scale = float(10 ** places)
    return F.rint(as_col(c).cast("double") * scale) / scale


def ratio_or_inf(num, den) -> Column:
    """num / den, infinite when den is zero."""
    num, den = as_col(num).cast("double"), as_col(den).cast("double")
    return F.when(den > 0, num / den).otherwise(F.lit(float("inf")))


def percent(num, den) -> Column:
    """num / den x 100, zero when den is zero or missing."""
    num, den = as_col(num).cast("double"), as_col(den).cast("double")
    return F.when(den > 0, num / den * 100).otherwise(F.lit(0.0))


def exact_mean(c, places: int, n=None) -> Column:
    """Mean of values with few decimals, summed as decimals: the result does not depend on the
    order of the rows. `n` weighs the values."""
    value = as_col(c).try_cast(f"decimal(20,{places})")
    if n is None:
        return F.sum(value).cast("double") / F.count(value)
    return F.sum(value * as_col(n)).cast("double") / F.sum(as_col(n))


def first_hit(c, rules, default=None) -> Column:
    """Label of the first rule whose words occur in the text. `rules` is [(label, words), ...]."""
    return F.coalesce(
        *[F.when(contains_any(c, words), F.lit(label)) for label, words in rules],
        F.lit(default),
    )
