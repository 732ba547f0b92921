"""Numeric expressions of the merged and figure tables."""

from pyspark.sql import Column, functions as F

from cladetally.functions.common import as_col, percent, ratio_or_inf, round_even


def novelty_factor(otus, species, places: int | None = 3) -> Column:
    """Census OTUs per catalogue species; infinite without species."""
    c = ratio_or_inf(otus, species)
    return c if places is None else round_even(c, places)


def overrepresentation_factor(otus, species, places: int | None = 3) -> Column:
    c = ratio_or_inf(species, otus)
    return c if places is None else round_even(c, places)


def coverage_percentage(species, otus, places: int = 2) -> Column:
    return round_even(percent(species, otus), places)


def match_status(species, only_label: str | None = None) -> Column:
    """A census row whose matches hold no species stays `census_only`."""
    if only_label is not None:
        return F.lit(only_label)
    return F.when(as_col(species) > 0, "matched").otherwise("census_only")


def fold_change(a, b) -> Column:
    """log2((b + 1) / (a + 1))."""
    return F.log2((as_col(b) + 1) / (as_col(a) + 1))


def representation_bias(species, otus) -> Column:
    both = (as_col(species) > 0) & (as_col(otus) > 0)
    return F.when(both, F.log2(as_col(species).cast("double") / as_col(otus)))


def weighted_novelty(factor, species) -> Column:
    return as_col(factor) * F.log10(as_col(species).cast("double") + 1)


def weighted_coverage(factor, otus) -> Column:
    return as_col(factor) * F.log10(as_col(otus).cast("double") + 1)


def genomes_per_isolate(genomes, isolates) -> Column:
    """Genomes per isolate, at least 1, with at least one isolate assumed."""
    ratio = as_col(genomes).cast("double") / F.greatest(as_col(isolates), F.lit(1))
    return F.greatest(ratio, F.lit(1.0))
