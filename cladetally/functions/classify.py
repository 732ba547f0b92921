"""Genome-source and band classifications."""

from functools import reduce

from pyspark.sql import Column, functions as F

from cladetally.functions import fixed_values as fv
from cladetally.functions.common import as_col, contains_any, first_hit, percent


def _source(uncultured: Column) -> Column:
    return F.when(F.coalesce(uncultured, F.lit(False)), "uncultured").otherwise("isolate")


def genome_source(organism, note=None, word_boundary: bool = False) -> Column:
    """isolate unless the organism name or the exclusion note holds an uncultured word.

    An enrichment culture that names a strain stays an isolate. `mag` and `sag` also match
    inside words; `word_boundary=True` asks for whole words.
    """
    name = F.lower(F.coalesce(as_col(organism), F.lit("")))
    texts = [name]
    if note is not None:
        texts.append(F.lower(F.coalesce(as_col(note), F.lit(""))))

    def word_hit(text):
        if word_boundary:
            alternatives = "|".join(w.replace("-", r"\-") for w in fv.UNCULTURED_WORDS)
            return text.rlike(rf"\b({alternatives})\b")
        return contains_any(text, fv.UNCULTURED_WORDS)

    no_strain = ~name.rlike(fv.STRAIN_PATTERN)
    hits = [word_hit(t) | (t.contains(fv.ENRICHMENT_WORD) & no_strain) for t in texts]
    return _source(reduce(lambda a, b: a | b, hits))


def source_from_report(assembly_type, attributes) -> Column:
    """Verdict of an assembly report: uncultured, isolate or null.

    `attributes` is `array<struct<name,value>>`; the first attribute that decides wins.
    """
    def verdict(a):
        name, value = F.lower(a["name"]), F.lower(a["value"])
        return (
            F.when((name == "sample_type") & value.contains("metagenome"), "uncultured")
            .when((name == "isolation_source") & contains_any(value, ["metagenome", "environmental"]),
                  "uncultured")
            .when((name == "sample_type") & value.contains("isolate"), "isolate")
        )

    by_type = F.when(F.lower(as_col(assembly_type)).contains("metagenome"), "uncultured")
    by_attribute = F.get(F.array_compact(F.transform(as_col(attributes), verdict)), F.lit(0))
    return F.coalesce(by_type, by_attribute)


def genome_source_by_priority(accession, taxon, note=None, report_source=None) -> Column:
    """Exclusion note first, then the report's verdict, then patterns on accession and taxon."""
    pattern = "(?i)" + "|".join(fv.SOURCE_PATTERNS)
    by_note = F.lit(None).cast("string")
    if note is not None:
        note_hit = as_col(note).rlike("(?i)" + fv.EXCLUSION_NOTE_PATTERN)
        by_note = F.when(note_hit, "uncultured")
    by_report = as_col(report_source) if report_source is not None else F.lit(None).cast("string")
    text_hit = F.coalesce(as_col(accession).rlike(pattern), F.lit(False)) | F.coalesce(
        as_col(taxon).rlike(pattern), F.lit(False)
    )
    return F.coalesce(by_note, by_report, _source(text_hit))


def genome_source_by_keyword(organism) -> Column:
    """Eight keywords; a missing name is `unknown`."""
    low = F.lower(as_col(organism))
    return F.when(low.isNull(), "unknown").otherwise(_source(contains_any(low, fv.SOURCE_KEYWORDS_8)))


def genome_source_by_keyword_and_note(organism, note) -> Column:
    """Note keywords, then the longer name keyword list."""
    by_note = contains_any(F.lower(F.coalesce(as_col(note), F.lit(""))), fv.EXCLUSION_KEYWORDS)
    by_name = contains_any(F.lower(F.coalesce(as_col(organism), F.lit(""))), fv.SOURCE_KEYWORDS_16)
    return _source(by_note | by_name)


def has_isolate_field(isolate) -> Column:
    return F.coalesce(as_col(isolate), F.lit("")) != ""


def inferred_domain(organism) -> Column:
    """Domain guessed from well-known words in the organism name."""
    low = F.lower(as_col(organism))
    return F.when(low.isNull(), "Unknown").otherwise(
        first_hit(low, fv.INFERRED_DOMAIN_WORDS, "Unclassified")
    )


def isolate_circle_size(isolates, genomes) -> Column:
    """Marker size of the isolate share: 25 for none, then 20, 15, 10."""
    share = percent(isolates, genomes)
    out = F.when(share == 0, 25)
    for limit, size in fv.ISOLATE_CIRCLE_SIZES:
        out = out.when(share < limit, size)
    return out.otherwise(10)


def representation_band(coverage) -> Column:
    out = F.when(as_col(coverage) == 0, "No_Representation")
    for limit, label in fv.REPRESENTATION_BANDS:
        out = out.when(as_col(coverage) < limit, label)
    return out.otherwise("High_Representation")


def completeness_band(missing_pct) -> Column:
    out = None
    for limit, label in fv.COMPLETENESS_BANDS:
        cond = as_col(missing_pct) < limit
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise("POOR")


def genome_bin(count) -> Column:
    out = F.lit(None).cast("string")
    for low, high, label in reversed(fv.GENOME_BINS):
        inside = as_col(count) >= low
        if high is not None:
            inside = inside & (as_col(count) < high)
        out = F.when(inside, label).otherwise(out)
    return out


def assembly_level_rank(level) -> Column:
    """0 for the best assembly level, 4 for any other."""
    out = F.lit(len(fv.ASSEMBLY_LEVEL_ORDER))
    for i, name in reversed(list(enumerate(fv.ASSEMBLY_LEVEL_ORDER))):
        out = F.when(as_col(level) == name, i).otherwise(out)
    return out


def assignment_status(taxid, species_taxid) -> Column:
    assigned = F.coalesce(as_col(species_taxid) > 0, F.lit(False))
    return (
        F.when(as_col(taxid).isNull(), "no_taxid")
        .when(assigned, "species_assigned")
        .otherwise("taxid_only")
    )


def unclassified_pattern(division, family, genus) -> Column:
    """Which of the three ranks hold `.U.`."""
    d, f, g = [as_col(x).contains(".U.").cast("int") for x in (division, family, genus)]
    return (
        F.when(d + f + g == 0, "fully_classified")
        .when(d + f + g > 1, "multiple_unclassified")
        .when(d == 1, "division_unclassified")
        .when(f == 1, "family_unclassified")
        .otherwise("genus_unclassified")
    )


def unmapped_category(lineage, reason=None, rank: str = "phylum") -> Column:
    """Category of a taxid without the wanted rank; the first rule that fits decides."""
    low = F.lower(as_col(lineage))

    def unclassified(domain):
        return low.contains(domain) & low.contains("unclassified")

    out = F.when(contains_any(low, ["virus", "acellular root"]), "viruses")
    if rank == "family":
        out = out.when(low.contains("metagenome"), "metagenomes")
    out = (
        out.when(unclassified("bacteria"), "unclassified_bacteria")
        .when(unclassified("eukaryota"), "unclassified_eukaryota")
        .when(unclassified("archaea"), "unclassified_archaea")
        .when(contains_any(low, ["environmental samples", "uncultured", "unidentified"]),
              "environmental_samples")
    )
    if rank == "family":
        uncertain = low.contains("incertae sedis")
        if reason is not None:
            uncertain = uncertain | F.lower(as_col(reason)).contains("incertae sedis")
        out = out.when(uncertain, "incertae_sedis")
    return out.otherwise("interesting_cases")


def unmapped_pattern(lineage, rank: str = "phylum") -> Column:
    """Finer pattern of the interesting cases."""
    low = F.lower(as_col(lineage))
    has = low.contains
    if rank == "phylum":
        return (
            F.when(has("eukaryota") & has("sar"), "SAR group eukaryotes")
            .when(has("eukaryota") & has("opisthokonta"), "Opisthokonta group")
            .when(has("bacteria") & has("proteobacteria"), "Proteobacteria subgroups")
            .when(has("incertae sedis"), "Incertae sedis (uncertain placement)")
            .otherwise("Other complex cases")
        )
    return (
        F.when(has("proteobacteria"), "Proteobacteria subgroups")
        .when(has("firmicutes") | has("bacillota"), "Firmicutes/Bacillota groups")
        .when(has("bacteroidetes") | has("bacteroidota"), "Bacteroidetes/Bacteroidota groups")
        .when(has("actinobacteria"), "Actinobacteria groups")
        .when(has("eukaryota") & has("fungi"), "Fungal groups")
        .when(has("eukaryota") & has("metazoa"), "Animal groups")
        .when(has("eukaryota") & has("stramenopiles"), "Stramenopile groups")
        .when(has("eukaryota"), "Other eukaryotic groups")
        .when(has("archaea"), "Archaeal groups")
        .otherwise("Other complex cases")
    )


def lineage_text_domain(lineage) -> Column:
    """Domain of a lineage text by the first of four words."""
    return first_hit(
        F.lower(as_col(lineage)),
        [("Eukaryota", ["eukaryota"]), ("Bacteria", ["bacteria"]),
         ("Archaea", ["archaea"]), ("Viruses", ["virus"])],
        "Unknown",
    )


def isolate_field_state(isolate) -> Column:
    """null, empty, placeholder or filled."""
    from cladetally.functions.predicates import is_placeholder

    c = as_col(isolate)
    return (
        F.when(c.isNull(), "null")
        .when(c == "", "empty")
        .when(is_placeholder(c), "placeholder")
        .otherwise("filled")
    )




def unmapped_reason_pattern(reason) -> Column:
    low = F.lower(as_col(reason))
    return (
        F.when(low.contains("no family found"), "Missing family rank")
        .when(low.contains("multiple families"), "Multiple family matches")
        .when(low.contains("family not in lineage"), "Family not in lineage")
    )


def lacks_phylum_but_has_clade(ranks) -> Column:
    low = F.lower(as_col(ranks))
    return low.contains("clade") & ~low.contains("phylum")
