"""Lineage expressions on `array<struct<taxid:bigint, rank:string, name:string>>`, root first."""

from functools import reduce

from pyspark.sql import Column, functions as F

from cladetally.functions import fixed_values as fv
from cladetally.functions.common import as_col, contains_any, strip

LINEAGE_TYPE = "array<struct<taxid:bigint,rank:string,name:string>>"


def parse_lineage(names, ranks, taxids=None) -> Column:
    """Three parallel `;` strings -> lineage array. Cut to the shortest of the given parts."""
    n = F.transform(F.split(as_col(names), ";"), strip)
    r = F.transform(F.split(F.coalesce(as_col(ranks), F.lit("")), ";"), lambda x: F.lower(strip(x)))
    length = F.least(F.size(n), F.size(r))
    ids = F.split(F.coalesce(as_col(taxids), F.lit("")), ";") if taxids is not None else None
    if ids is not None:
        has_ids = as_col(taxids).isNotNull() & (as_col(taxids) != "")
        length = F.when(has_ids, F.least(length, F.size(ids))).otherwise(length)

    def node(x, i):
        taxid = F.lit(None).cast("bigint")
        if ids is not None:
            taxid = F.try_element_at(ids, i + 1).try_cast("bigint")
        return F.struct(taxid.alias("taxid"), F.get(r, i).alias("rank"), x.alias("name"))

    known = as_col(names).isNotNull() & (as_col(names) != "")
    return F.when(known, F.transform(F.slice(n, F.lit(1), length), node))


def lineage_names(c) -> Column:
    return F.transform(as_col(c), lambda x: x["name"])


def lineage_text(c, field: str = "name") -> Column:
    """`;`-joined export form; missing taxids print as NA."""
    parts = F.transform(as_col(c), lambda x: F.coalesce(x[field].cast("string"), F.lit("NA")))
    return F.coalesce(F.array_join(parts, ";"), F.lit(""))


def lineage_texts(c) -> list[Column]:
    return [
        lineage_text(c, "name").alias("lineage"),
        lineage_text(c, "rank").alias("lineage_ranks"),
        lineage_text(c, "taxid").alias("lineage_taxids"),
    ]


def node_at_rank(c, rank: str, which: str = "first") -> Column:
    """Node at a rank. `which` picks among repeated ranks: first = root-most, last = leaf-most."""
    hits = F.filter(as_col(c), lambda x: F.lower(x["rank"]) == rank)
    return F.try_element_at(hits, F.lit(1 if which == "first" else -1))


def name_at_rank(c, rank: str, which: str = "first") -> Column:
    return node_at_rank(c, rank, which)["name"]


def rank_columns(c, ranks=fv.MAIN_RANKS, which: str = "first") -> list[Column]:
    return [name_at_rank(c, r, which).alias(r) for r in ranks]


def truncate_lineage(c, rank: str) -> Column:
    """Cut everything below the rank; unchanged when the rank is absent."""
    c = as_col(c)
    ranks = F.transform(c, lambda x: F.lower(x["rank"]))
    at = F.array_position(ranks, rank).cast("int")
    return F.when(at > 0, F.slice(c, F.lit(1), at)).otherwise(c)


def needs_original_name(name) -> Column:
    return as_col(name).rlike(r"\d|\.U\.|_") & (as_col(name) != "NA")


def append_original(c, name, taxid) -> Column:
    """Add the census name as a last `original_name` level when it carries a digit, `.U.` or `_`."""
    c = F.coalesce(as_col(c), F.expr(f"cast(array() as {LINEAGE_TYPE})"))
    extra = F.struct(
        as_col(taxid).cast("bigint").alias("taxid"),
        F.lit("original_name").alias("rank"),
        as_col(name).alias("name"),
    )
    return F.when(needs_original_name(name), F.array_append(c, extra)).otherwise(c)


def drop_root(c) -> Column:
    """Remove a leading `cellular organisms` node."""
    c = as_col(c)
    first = F.get(c, F.lit(0))
    is_root = (first["name"] == fv.ROOT_NAME) | (first["taxid"] == fv.ROOT_TAXID)
    return F.when(
        F.coalesce(is_root, F.lit(False)),
        F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))),
    ).otherwise(c)


def detect_domain(c) -> Column:
    """Domain node if present, else the first keyword list that hits, else Bacteria / Unknown."""
    c = as_col(c)
    node = F.get(F.filter(c, lambda x: F.lower(x["rank"]).isin("domain", "superkingdom")), F.lit(0))

    def any_part(words):
        return F.exists(c, lambda x: contains_any(F.lower(x["name"]), words))

    return F.coalesce(
        node["name"],
        F.when(any_part(fv.VIRAL_WORDS), "Viruses"),
        F.when(any_part(fv.EUKARYOTE_WORDS), "Eukaryota"),
        F.when(any_part(fv.ARCHAEA_WORDS), "Archaea"),
        F.when(any_part(fv.BACTERIA_WORDS), "Bacteria"),
        F.when(any_part([fv.ROOT_NAME]), "Bacteria"),
        F.lit("Unknown"),
    )


def extend_with_species(c, match_type, name, tail) -> Column:
    """Lengthen a lineage that stops above the organism.

    Genus-level matches gain the organism name; rescued names gain their unmatched tail.
    """
    c = F.coalesce(as_col(c), F.expr(f"cast(array() as {LINEAGE_TYPE})"))

    def nodes(texts):
        return F.transform(
            texts,
            lambda t: F.struct(
                F.lit(None).cast("bigint").alias("taxid"), F.lit("").alias("rank"), t.alias("name")
            ),
        )

    genus_like = as_col(match_type).isin("genus", "previous_name_genus") & (F.size(c) > 0)
    out = F.when(genus_like, F.concat(c, nodes(F.array(as_col(name))))).otherwise(c)
    has_tail = F.coalesce(F.size(as_col(tail)) > 0, F.lit(False))
    return F.when(has_tail, F.concat(out, nodes(as_col(tail)))).otherwise(out)


def rank_or_fallback(c, target: str) -> Column:
    """Special clade if present, else the first rank of the target's list that the lineage has."""
    c = as_col(c)
    special = F.get(F.filter(lineage_names(c), lambda n: n.isin(fv.SPECIAL_CLADES)), F.lit(0))
    ranks = fv.RANK_FALLBACKS.get(target, [target])
    return F.coalesce(special, *[name_at_rank(c, r, "last") for r in ranks])


def taxid_or_fallback(c, target: str) -> Column:
    """Taxid of the node `rank_or_fallback` names."""
    c = as_col(c)
    special = F.get(F.filter(c, lambda x: x["name"].isin(fv.SPECIAL_CLADES)), F.lit(0))
    ranks = fv.RANK_FALLBACKS.get(target, [target])
    return F.coalesce(special, *[node_at_rank(c, r, "last") for r in ranks])["taxid"]


def lineage_has(c, name: str) -> Column:
    return F.exists(as_col(c), lambda x: x["name"].contains(name))


def fits_rank(c, rank: str) -> Column:
    """The lineage holds the rank and nothing finer; lineages without ranks pass."""
    finer = {"phylum": ["family", "genus", "species"], "family": ["genus", "species"]}.get(rank, [])
    ranks = F.transform(as_col(c), lambda x: F.lower(x["rank"]))
    clean = reduce(lambda a, b: a & b, [~F.array_contains(ranks, r) for r in finer], F.lit(True))
    ok = F.array_contains(ranks, rank) & clean
    return F.coalesce(ok | (F.size(ranks) == 0), F.lit(True))
