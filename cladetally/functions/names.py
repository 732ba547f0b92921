"""Taxon-name expressions. All run inside the JVM; none needs a Python worker."""

from pyspark.sql import Column, DataFrame, functions as F

from cladetally.functions import fixed_values as fv
from cladetally.functions.common import as_col, before, contains_any, literal_map, strip
from cladetally.functions.lineages import name_at_rank


def strip_trailing_numbers(c) -> Column:
    """`Theileria1` -> `Theileria`. The first character always stays."""
    return F.regexp_replace(as_col(c), r"^\s*+(.+?)\s*\d+\s*$", "$1")


def clean_taxon_name(c) -> Column:
    """Underscores become two blanks, then trailing numbers go."""
    return strip_trailing_numbers(F.replace(as_col(c), F.lit("_"), F.lit("  ")))


def organelle_type(c) -> Column:
    low = F.lower(as_col(c))
    return F.coalesce(*[F.when(low.contains(o), F.lit(o)) for o in fv.ORGANELLES])


def organelle_base(c) -> Column:
    """Name with its organelle part removed; unchanged when there is none.

    Text before the first dot, else before the first colon, without organelle tags.
    """
    c = as_col(c)
    base = F.regexp_replace(c, r"^(?:([^.]*)\..*|([^.:]*):[^.]*)$", "$1$2")
    base = F.regexp_replace(base, "|".join(fv.ORGANELLE_TAGS), "")
    return F.when(c.rlike("(?i)" + "|".join(fv.ORGANELLES)), base).otherwise(c)


def detect_organelle(c) -> Column:
    kind = organelle_type(c)
    return F.struct(
        kind.isNotNull().alias("is_organelle"),
        kind.alias("organelle_type"),
        organelle_base(c).alias("base_name"),
    )


def clean_organelle_name(c) -> Column:
    """Lookup form of a census name: no organelle part, no `.U.` tail, no underscores."""
    base = organelle_base(c)
    binomial = base.rlike(r"^[^_]*_[^_\d]*$")
    return (
        F.when(base.contains(".U."), strip_trailing_numbers(before(base, ".U.")))
        .when(binomial, strip_trailing_numbers(F.replace(base, F.lit("_"), F.lit(" "))))
        .otherwise(clean_taxon_name(base))
    )


def organelle_host(c) -> Column:
    """Host organism of an organelle sequence; null for other names."""
    c = as_col(c)
    host = F.regexp_extract(c, r"^(.*?)[.:](Chloroplast|Mitochondria|Apicoplast|Plastid)", 1)
    return F.nullif(strip(F.replace(host, F.lit("_"), F.lit(" "))), F.lit(""))


def meaningful_part(c) -> Column:
    """Taxon words inside an `uncultured ...` name; null when there are none."""
    c = as_col(c)
    low = F.lower(c)
    words = F.split(strip(F.replace(c, F.lit("_"), F.lit(" "))), r"\s+")
    kept = F.filter(
        words,
        lambda w: ~F.lower(w).isin(fv.GENERIC_TERMS)
        & (F.length(w) > 2)
        & (w.rlike(r"^[A-Z][^A-Z]*[a-z][^A-Z]*$") | w.endswith("bacteria")),
    )
    usable = ~contains_any(low, fv.ENVIRONMENTAL_TERMS) & low.contains("uncultured")
    return F.when(usable & (F.size(kept) > 0), F.array_join(F.slice(kept, 1, 2), " "))


def first_word(c) -> Column:
    return F.split(strip(c), r"\s+").getItem(0)


def _two_words(c) -> Column:
    return c.rlike(r"\S\s+\S")


def appropriate_rank_name(c, rank: str, lineage=None) -> Column:
    """Name to look up at a rank; null when the entry is too fine for that rank."""
    cleaned = clean_organelle_name(c)
    by_name = {
        "genus": F.when(_two_words(cleaned), first_word(cleaned)).otherwise(cleaned),
        "family": F.when(~_two_words(cleaned), cleaned),
        "phylum": F.when(~cleaned.contains(" "), cleaned),
    }.get(rank, cleaned)
    if lineage is None:
        return by_name
    return F.coalesce(name_at_rank(lineage, rank), by_name)


def is_appropriate_for(rank_col, c) -> Column:
    """Whether a name fits the rank named in another column (the 16S rule)."""
    cleaned, rank = clean_organelle_name(c), as_col(rank_col)
    return (
        F.when(rank == "family", ~_two_words(cleaned))
        .when(rank == "phylum", ~cleaned.contains(" "))
        .otherwise(F.lit(True))
    )


def genus_of_census_name(c) -> Column:
    """Text before the first dot and underscore, without trailing numbers."""
    return strip_trailing_numbers(before(before(c, "."), "_"))


def genus_of_organism(c) -> Column:
    """Text before ` sp`, else a capitalised first word, else null."""
    c = as_col(c)
    sp = strip(F.regexp_extract(c, r"(?i)(.+?)\s+sp\b.*", 1))
    word = first_word(c)
    return F.when(sp != "", sp).when(word.rlike(r"^\p{Lu}"), word)


def genus_of_taxonomy(c) -> Column:
    """Last one-word capitalised part of a `;` taxonomy that is not the domain."""
    parts = F.transform(F.split(as_col(c), ";"), strip)
    kept = F.filter(
        parts,
        lambda p: ~p.contains(" ") & (p != "Eukaryota") & (F.length(p) > 2) & p.rlike(r"^\p{Lu}"),
    )
    return F.try_element_at(kept, F.lit(-1))


def hyphen_extract(c) -> Column:
    """Taxon inside a hyphenated name; null when nothing usable is there."""
    c = as_col(c)
    lineage_form = c.endswith("-lineage") | (c.contains("_X") & c.contains("-lineage"))
    second = before(F.split(c, "-").getItem(1), "_")
    return (
        F.when(~c.contains("-"), F.lit(None).cast("string"))
        .when(lineage_form, before(before(c, "-lineage"), "_"))
        .when(c.contains("-Group"), before(c, "-Group"))
        .when(~contains_any(F.lower(second), fv.HYPHEN_STOP_WORDS), second)
    )


def apply_synonyms(c, mapping: dict = fv.NAME_SYNONYMS) -> Column:
    """Current name where the table has one, else the name itself."""
    known = {k: v for k, v in mapping.items() if v is not None}
    return F.coalesce(F.try_element_at(literal_map(known), as_col(c)), as_col(c))


def apply_synonym_table(df: DataFrame, col: str, table: DataFrame) -> DataFrame:
    """Same for a user's `(old_name, new_name)` table of any size; old names must be unique."""
    names = table.select(F.col("old_name").alias(col), F.col("new_name").alias("_new"))
    joined = df.join(names, col, "left")
    return joined.withColumn(col, F.coalesce("_new", col)).drop("_new")


def normalize_name(c) -> Column:
    """Comparison key across catalogues: trimmed, lower case, text before the first underscore."""
    return before(F.lower(strip(F.coalesce(as_col(c), F.lit("")))), "_")


def strip_variant_suffix(c) -> Column:
    """`Bacillota_A` -> `Bacillota`."""
    return F.regexp_replace(as_col(c), fv.VARIANT_SUFFIX, "")


def gtdb_rank(c, rank: str, missing: str | None = None) -> Column:
    found = F.nullif(strip(F.regexp_extract(as_col(c), fv.GTDB_RANK_PATTERNS[rank], 1)), F.lit(""))
    return F.coalesce(found, F.lit(missing))


def clean_accession(c) -> Column:
    return strip(F.regexp_replace(as_col(c), fv.ACCESSION_PREFIX, ""))


def is_valid_accession(c) -> Column:
    return as_col(c).rlike(fv.ACCESSION_FORMAT)


def clean_taxid(c) -> Column:
    """First digit run of the first line; text without digits and `FAILED` stay as they are."""
    c = as_col(c)
    line = before(c, "\n")
    digits = F.regexp_extract(line, r"(\d+)", 1)
    return F.when((c == "FAILED") | (digits == ""), c).otherwise(digits)


def clean_merge_name(c) -> Column:
    """Name key of the outer name merge."""
    for pattern in [
        r"^Candidatus\s+", r"\.Mitochondria$", r"\.Chloroplast$", r"\.Apicoplast$",
        r":plas\.Chloroplast$", r"_[A-Z]$", r"_\d+$",
    ]:
        c = F.regexp_replace(as_col(c), pattern, "")
    return strip(c)


def canonical_name(c, mapping: dict = fv.CANONICAL_PHYLA | fv.SPELLING_FIXES) -> Column:
    return F.coalesce(F.try_element_at(literal_map(mapping), as_col(c)), as_col(c))


def cut_strain(c) -> Column:
    """Text before `strain` / `isolate`, blanks squeezed."""
    cut = F.regexp_replace(as_col(c), r"(?s)(strain|isolate).*$", "")
    return strip(F.regexp_replace(cut, r"\s+", " "))


def base_group(c) -> Column:
    return before(c, ".U.")


def repair_genus_spelling(name, genus) -> Column:
    """Replace the genus of a name by a near-identical genus from its lineage.

    Struct of the repaired name and `correction_type` (`genus_spelling` or `none`).
    """
    name, genus = as_col(name), as_col(genus)
    own = first_word(name)
    near = (
        (own != genus)
        & (F.length(own) > 3)
        & (F.length(genus) > 3)
        & (F.abs(F.length(own) - F.length(genus)) <= 2)
        & (F.lower(F.substring(own, 1, 3)) == F.lower(F.substring(genus, 1, 3)))
    )
    near = F.coalesce(near, F.lit(False))
    at = F.instr(name, own)
    fixed = F.concat(F.substr(name, F.lit(1), at - 1), genus, F.substr(name, at + F.length(own)))
    return F.struct(
        F.when(near, fixed).otherwise(name).alias("name"),
        F.when(near, F.lit("genus_spelling")).otherwise(F.lit("none")).alias("correction_type"),
    )


def lineage_genus(lineage_text) -> Column:
    """Last one-word part, the final part excluded, that could be a genus."""
    parts = F.transform(F.split(as_col(lineage_text), ";"), strip)
    head = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    kept = F.filter(
        head, lambda p: ~p.contains(" ") & (p != "Eukaryota") & (F.length(p) > 3)
    )
    return F.try_element_at(kept, F.lit(-1))


def fix_family_case(c) -> Column:
    """Trailing symbols off, first letter upper, rest lower; null -> `Unclassified`."""
    c = as_col(c)
    bare = strip(F.regexp_replace(c, r"[^A-Za-z0-9_\-]+$", ""))
    cased = F.concat(F.upper(F.substring(bare, 1, 1)), F.lower(F.substr(bare, F.lit(2))))
    return F.when(c.isNull() | (c == "Unclassified"), F.lit("Unclassified")).otherwise(cased)


def species_of_organism(c) -> Column:
    return F.substring_index(as_col(c), " ", 2)


PROFILES = {
    # columns added by standardize_names, per kind of table
    "census_16s": {
        "cleaned_name": clean_organelle_name,
        "organelle": detect_organelle,
        "host_name": organelle_host,
        "meaningful_name": meaningful_part,
        "number_stripped": strip_trailing_numbers,
    },
    "census_18s": {
        "cleaned_name": clean_taxon_name,
        "genus_name": genus_of_census_name,
        "number_stripped": lambda c: strip_trailing_numbers(
            F.replace(as_col(c), F.lit("_"), F.lit(" "))
        ),
        "hyphen_part": hyphen_extract,
    },
    "catalogue": {"normalized_name": normalize_name, "base_name": strip_variant_suffix},
    "organism": {
        "genus_name": genus_of_organism,
        "species_name": species_of_organism,
        "without_strain": cut_strain,
    },
}


def standardize_names(df: DataFrame, col: str, profile: str) -> DataFrame:
    """One projection that adds every standard form a profile defines."""
    return df.withColumns({name: fn(F.col(col)) for name, fn in PROFILES[profile].items()})
