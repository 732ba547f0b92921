"""Row filters, as boolean columns."""

from functools import reduce

from pyspark.sql import Column, functions as F

from cladetally.functions import fixed_values as fv
from cladetally.functions.common import as_col, contains_any, strip


def is_prokaryote(domain) -> Column:
    return as_col(domain).isin(fv.PROKARYOTE_DOMAINS)


def is_eukaryote(domain) -> Column:
    return F.lower(as_col(domain)).contains("eukaryota")


def is_anchor_domain(domain) -> Column:
    """Not one of the eukaryote or virus spellings."""
    return ~F.lower(strip(domain)).isin(fv.NON_PROKARYOTE_DOMAINS)


def is_virus_name(name) -> Column:
    return contains_any(F.lower(as_col(name)), fv.VIRUS_NAME_PARTS)


def is_candidate_name(name) -> Column:
    return F.lower(as_col(name)).contains("candidat")


def starts_candidate(name) -> Column:
    return F.lower(as_col(name)).startswith("candidat")


def is_unclassified_name(name) -> Column:
    """Holds `.U.` in any letter case, taken literally."""
    return F.lower(as_col(name)).contains(".u.")


def is_clean_name(name) -> Column:
    """Neither candidate, unclassified nor viral."""
    low = F.lower(as_col(name))
    return ~is_candidate_name(name) & ~is_unclassified_name(name) & ~contains_any(low, ["virus", "viral"])


def is_eukaryote_group(name) -> Column:
    return contains_any(F.lower(as_col(name)), [g.lower() for g in fv.EUKARYOTE_GROUPS])


def is_named(name) -> Column:
    return as_col(name).isNotNull() & (strip(name) != "")


def is_verifiable_phylum(name) -> Column:
    low = F.lower(as_col(name))
    return F.coalesce(is_named(name) & ~contains_any(low, fv.UNVERIFIABLE_PHYLUM_WORDS), F.lit(False))


def is_placeholder(value) -> Column:
    return F.coalesce(F.lower(strip(value)).isin(fv.ISOLATE_PLACEHOLDERS), F.lit(False))


def is_known_division(name) -> Column:
    return as_col(name).isNotNull() & ~as_col(name).isin(fv.UNKNOWN_DIVISIONS)


def is_figure_row(status, measures) -> Column:
    """Matched, with every measure present and both counts above zero."""
    above = reduce(lambda a, b: a & b, [F.coalesce(as_col(m) > 0, F.lit(False)) for m in measures])
    return (as_col(status) == "matched") & above


def passes_cutoff(otus, coverage, level: str) -> Column:
    return (as_col(otus) >= fv.CENSUS_CUTOFFS[level]) & F.coalesce(as_col(coverage) <= 100, F.lit(True))


def is_significant_unclassified(name, otus, domain: str) -> Column:
    """`.U.` census rows of a domain that are large enough to draw."""
    name, low = as_col(name), fv.UNCLASSIFIED_CUTOFFS[domain]
    base = name.contains(".U.") & (as_col(otus) >= low)
    if domain == "Archaea":
        return base & name.contains("Archaea")
    if domain == "Bacteria":
        named = contains_any(
            name, ["Bacteria", "Proteobacteria", "Firmicutes", "Bacteroidetes", "Actinobacteria"]
        )
        return base & (named | (~name.contains("Eukaryota") & ~name.contains("Archaea")))
    return base


def is_suspicious_anchor(presence, status) -> Column:
    return (as_col(presence) == "GTDB_Only") & (as_col(status) == "No_Match")


def taxon_issues(taxon, lineage_text, rank_name, expected_domain: str, rank: str) -> Column:
    """Problems of a taxon against its expected domain and rank; empty array = fine."""
    low = F.lower(as_col(lineage_text))
    issues = []
    if expected_domain.lower() in ("bacteria", "archaea"):
        word = rf"\b{expected_domain.lower()}\b"
        issues.append(F.when(~low.rlike(word), F.lit("domain mismatch")))
    issues.append(F.when(F.lower(as_col(taxon)).contains("candidatus"), F.lit("candidatus")))
    issues.append(F.when(F.coalesce(as_col(rank_name), F.lit("")) == "", F.lit("rank missing")))
    found = F.array_compact(F.array(*issues))
    no_lineage = as_col(lineage_text).isNull() | (as_col(lineage_text) == "")
    return F.when(no_lineage, F.array(F.lit("not found"))).otherwise(found)


def is_off_diagonal(novelty, coverage, taxon, excluded=fv.FIGURE_EXCLUDED_GENERA, factor=1.5) -> Column:
    far = (as_col(novelty) > factor) | (as_col(coverage) > factor)
    return far & ~as_col(taxon).isin(excluded)
