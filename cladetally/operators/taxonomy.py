"""Taxonomy-tree operators: lineages, name resolution, rank maps.

Everything is a join against the taxdump tables. No side is broadcast by hint: Catalyst and AQE
choose from measured sizes. Dictionaries are made unique and stored before they are joined, so
both sides of the join are plain shuffles and AQE can split a key that many names share.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cladetally.functions import fixed_values as fv
from cladetally.functions import lineages as ln
from cladetally.functions import names as nm
from cladetally.functions.classify import lineage_text_domain
from cladetally.functions.common import as_col, strip
from cladetally.operators.keyed import first_per_key, union_all
from cladetally.session import cut_lineage, materialize


def build_lineages(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """`(taxid, lineage)` for every node below the root, root-most ancestor first.

    Pointer doubling: a row holds the path walked so far and the next ancestor; each round joins
    the table with itself and doubles every path, so depth d takes log2(d) rounds. Each round is
    checkpointed. A walk that meets a node again (a cycle) is cut at the repeat; a parent that is
    not in the table ends the walk.
    """
    label = names.groupBy("taxid").agg(F.min("name").alias("name"))
    tree = nodes.where(F.col("taxid") != 1).join(label, "taxid", "left")
    node = F.struct("taxid", F.coalesce("rank", F.lit("no rank")).alias("rank"), "name")
    step = cut_lineage(tree.select(
        "taxid",
        F.array(node).alias("path"),
        F.when((F.col("parent") != 1) & (F.col("parent") != F.col("taxid")), F.col("parent")).alias("next"),
    ))
    done = step.where("next is null")
    active = step.where("next is not null")
    while not active.isEmpty():
        hop = step.select(
            F.col("taxid").alias("next"), F.col("path").alias("_path"), F.col("next").alias("_next")
        )
        grown = active.join(hop, "next", "left").select(
            "taxid",
            F.concat("path", F.coalesce("_path", F.array())).alias("path"),
            F.col("_next").alias("next"),
        )
        distinct = F.size(F.array_distinct(F.col("path")["taxid"]))
        looped = distinct < F.size("path")
        active = cut_lineage(grown.select(
            "taxid",
            F.slice("path", F.lit(1), distinct).alias("path"),
            F.when(~looped, F.col("next")).alias("next"),
        ))
        done = done.unionByName(active.where("next is null"))
        step = done.unionByName(active.where("next is not null"))
        active = active.where("next is not null")
    named = F.filter("path", lambda x: x["name"].isNotNull())
    return done.select("taxid", F.reverse(named).alias("lineage"))


@dataclass(frozen=True)
class NameIndex:
    """Stored `(name, taxid)` with unique names. Build it once with `index_names`."""

    table: DataFrame


def index_names(names: "DataFrame | NameIndex") -> NameIndex:
    """A name on several taxids keeps the smallest."""
    if isinstance(names, NameIndex):
        return names
    return NameIndex(materialize(names.groupBy("name").agg(F.min("taxid").alias("taxid"))))


def name_to_taxid(df: DataFrame, names: "DataFrame | NameIndex", col: str, out: str = "taxid") -> DataFrame:
    """Exact name lookup; names without a taxid keep a null.

    Merged, never broadcast: files of names are many times smaller than the names, so neither side's size is known from them.
    """
    lookup = index_names(names).table.select(F.col("name").alias(col), F.col("taxid").alias(out))
    return df.join(lookup.hint("merge"), col, "left")


def with_lineage(df: DataFrame, lineages: DataFrame) -> DataFrame:
    """Left join of the lineage; an unknown taxid gets an empty one."""
    empty = F.expr(f"cast(array() as {ln.LINEAGE_TYPE})")
    return df.join(lineages, "taxid", "left").withColumn("lineage", F.coalesce("lineage", empty))


def ladder_16s(col: str) -> list[tuple[str, Column]]:
    c = F.col(col)
    host = nm.organelle_host(c)
    return [
        ("host_or_original", F.coalesce(host, c)),
        ("cleaned", nm.clean_organelle_name(c)),
        ("meaningful_part", nm.meaningful_part(c)),
        ("number_stripped", nm.strip_trailing_numbers(c)),
    ]


def ladder_18s(col: str) -> list[tuple[str, Column]]:
    c = F.col(col)
    spaced = F.replace(c, F.lit("_"), F.lit(" "))
    return [
        ("direct", nm.clean_taxon_name(c)),
        ("genus_fallback", nm.genus_of_census_name(c)),
        ("number_stripped", nm.strip_trailing_numbers(spaced)),
        ("hyphen_part", F.replace(nm.hyphen_extract(c), F.lit("_"), F.lit(" "))),
    ]


def ladder_eukprot(name: str = "name_to_use", previous: str = "previous_names") -> Column:
    """Array of `(method, variant)` in the order they are tried."""
    def step(method, c):
        return F.array(F.struct(F.lit(method).alias("method"), c.alias("variant")))

    older = F.flatten(F.transform(F.col(previous), lambda p: F.array(
        F.struct(F.lit("previous_name").alias("method"), p.alias("variant")),
        F.struct(F.lit("previous_name_genus").alias("method"), nm.genus_of_organism(p).alias("variant")),
    )))
    word = nm.first_word(name)
    return F.concat(
        step("full", F.col(name)),
        step("genus", nm.genus_of_organism(name)),
        F.coalesce(older, F.array()),
        step("genus", F.when(word.rlike(r"^\p{Lu}"), word)),
    )


def variants_of(ladder) -> Column:
    return F.array(*[F.struct(F.lit(m).alias("method"), c.alias("variant")) for m, c in ladder])


def resolve_names(df: DataFrame, names: DataFrame, col: str, variants: Column) -> DataFrame:
    """First variant with a taxid wins; `(col, taxid, method)` for each distinct name.

    Equal names are tried once. Variants are exploded and joined on equality. The minimum per name is
    pre-aggregated before the shuffle.
    """
    if df.columns == [col]:
        df = df.distinct()
    tried = df.select(F.col(col), F.posexplode(variants).alias("pos", "v")).select(
        col, "pos", F.col("v.method").alias("method"), F.col("v.variant").alias("variant")
    ).where(
        F.col("variant").isNotNull() & ~F.lower("variant").isin(fv.UNSEARCHABLE_NAMES)
    )
    hits = name_to_taxid(tried, names, "variant").where("taxid is not null")
    best = hits.groupBy(col).agg(F.min(F.struct("pos", "taxid", "method")).alias("hit"))
    known = df.select(col).distinct()
    return known.join(best, col, "left").select(
        col, F.col("hit.taxid").alias("taxid"), F.coalesce("hit.method", F.lit("none")).alias("method")
    )


def rank_of(df: DataFrame, nodes: DataFrame, taxid: str = "taxid", expected: str | None = None) -> DataFrame:
    """Node rank of each taxid with a `verified` / `mismatch` / `missing` status."""
    ranks = nodes.select(F.col("taxid").alias(taxid), F.col("rank").alias("node_rank"))
    status = F.when(F.col("node_rank").isNull(), "missing")
    if expected is not None:
        status = status.when(F.col("node_rank") != expected, "mismatch")
    return df.join(ranks, taxid, "left").withColumn("rank_status", status.otherwise("verified"))


def map_taxids_to_rank(assemblies: DataFrame, lineages: DataFrame, rank: str,
                       subfamily_fallback: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct assembly taxids split into `(taxid, <rank>, domain)` and unmapped with a reason.

    Both halves have one row per taxid, so the counting joins cannot multiply genomes.
    """
    taxids = assemblies.select("taxid").where("taxid is not null").distinct()
    found = taxids.join(lineages, "taxid", "left")
    name = ln.name_at_rank("lineage", rank)
    if subfamily_fallback and rank == "family":
        name = F.coalesce(name, ln.name_at_rank("lineage", "subfamily"))
    placed = materialize(found.select("taxid", "lineage", F.nullif(strip(name), F.lit("")).alias(rank)))
    mapped = placed.where(F.col(rank).isNotNull()).select(
        "taxid", rank, ln.detect_domain("lineage").alias("domain")
    )
    reason = F.when(F.col("lineage").isNull(), "No lineage found").otherwise(f"No {rank} found in lineage")
    unmapped = placed.where(F.col(rank).isNull()).select(
        "taxid", reason.alias("reason"),
        ln.lineage_text("lineage", "name").alias("lineage"),
        ln.lineage_text("lineage", "rank").alias("ranks"),
    )
    return mapped, unmapped


def resolve_with_fallback(df: DataFrame, col: str, catalogues: list[tuple[str, DataFrame]]) -> DataFrame:
    """Taxid from the first catalogue that knows the name, with `taxid_source`."""
    out = df
    for i, (_, names) in enumerate(catalogues):
        out = name_to_taxid(out, names, col, f"_t{i}")
    ids = [F.col(f"_t{i}") for i in range(len(catalogues))]
    source = F.coalesce(*[F.when(t.isNotNull(), label) for t, (label, _) in zip(ids, catalogues)])
    return (
        out.withColumn("taxid", F.coalesce(*ids))
        .withColumn("taxid_source", F.coalesce(source, F.lit("none")))
        .drop(*[f"_t{i}" for i in range(len(catalogues))])
    )


def merge_by_last_taxid(counts: DataFrame, rank: str, count_col: str, compat: bool = False) -> DataFrame:
    """Rows that share the deepest lineage taxid and the domain are summed.

    The display name is the fifth lineage part when there is one. The row with the most genomes
    (then the smallest name) gives name and lineage. Rows without a taxid stay as they are;
    `compat=True` drops them.
    """
    rows = counts.withColumn("last_taxid", F.try_element_at("lineage", F.lit(-1))["taxid"])
    name = F.coalesce(F.get(F.col("lineage"), F.lit(4))["name"], F.col(rank))
    summed = (
        rows.where("last_taxid is not null")
        .groupBy("last_taxid", "domain")
        .agg(
            F.sum(count_col).alias(count_col),
            F.min(F.struct(-F.col(count_col), F.col(rank), name.alias("shown"),
                           F.col("lineage"))).alias("rep"),
        )
        .select(
            F.col("rep.shown").alias(rank), "domain", count_col,
            F.col("last_taxid").alias("taxid"), F.col("rep.lineage").alias("lineage"),
        )
    )
    if compat:
        return summed
    kept = rows.where("last_taxid is null").select(
        rank, "domain", count_col, F.lit(None).cast("bigint").alias("taxid"), "lineage"
    )
    return summed.unionByName(kept)


def rescue_by_ancestor(df: DataFrame, names: DataFrame, nodes: DataFrame, key: str, taxonomy: str) -> DataFrame:
    """Deepest part of a row's own taxonomy that has a taxid, the rank found and the unmatched tail.

    Returns `(key, taxid, match_type, tail)` for rescued rows only.
    """
    bare = F.transform(F.split(F.col(taxonomy), ";"), lambda p: F.btrim(strip(p), F.lit("'\"")))
    parts = F.filter(
        bare, lambda p: (p != "") & ~p.isin("strain", "isolate") & ~p.startswith("strain ")
    )
    rows = df.select(key, parts.alias("parts"))
    exploded = rows.select(key, F.posexplode("parts").alias("pos", "part"))
    hits = name_to_taxid(exploded, names, "part").where("taxid is not null")
    deepest = hits.groupBy(key).agg(F.max(F.struct("pos", "taxid")).alias("hit")).select(
        key, F.col("hit.pos").alias("pos"), F.col("hit.taxid").alias("taxid")
    )
    ranked = deepest.join(nodes.select("taxid", "rank"), "taxid", "left").join(rows, key)
    tail = F.slice("parts", F.col("pos") + 2, F.greatest(F.size("parts") - F.col("pos") - 1, F.lit(0)))
    return ranked.select(
        key, "taxid",
        F.concat(F.lit("hierarchical_"), F.coalesce("rank", F.lit("unknown"))).alias("match_type"),
        F.array_append(tail, F.col(key)).alias("tail"),
    )


def with_species_taxid(df: DataFrame, lineages: DataFrame) -> DataFrame:
    """Given species taxid, else the species-rank ancestor, else the taxid itself."""
    species = lineages.select("taxid", ln.node_at_rank("lineage", "species")["taxid"].alias("_sp"))
    given = F.col("species_taxid") if "species_taxid" in df.columns else F.lit(None).cast("bigint")
    return (
        df.join(species, "taxid", "left")
        .withColumn("species_taxid", F.coalesce(given, F.col("_sp"), F.col("taxid")))
        .drop("_sp")
    )


def resolve_eukprot(df: DataFrame, names: DataFrame, nodes: DataFrame) -> DataFrame:
    """EukProt names through the whole ladder; `match_type` and `tail` per name.

    Full name, genus, each previous name and its genus, genus again, then ancestor rescue.
    """
    names = index_names(names)
    one = materialize(first_per_key(df, ["name_to_use"], ["eukprot_id"]))
    direct = materialize(resolve_names(one, names, "name_to_use", ladder_eukprot()))
    lost = one.join(direct.where("taxid is null").select("name_to_use"), "name_to_use", "left_semi")
    rescued = rescue_by_ancestor(lost, names, nodes, "name_to_use", "taxonomy").select(
        "name_to_use", F.col("taxid").alias("_taxid"), "match_type", "tail"
    )
    return direct.join(rescued, "name_to_use", "left").select(
        "name_to_use",
        F.coalesce("taxid", "_taxid").alias("taxid"),
        F.coalesce("match_type", "method").alias("match_type"),
        F.coalesce("tail", F.expr("cast(array() as array<string>)")).alias("tail"),
    )


def repair_phylum(unmapped: DataFrame) -> DataFrame:
    """Phylum for taxids whose lineage has none: clade words, bacterial class words, the parent of
    an incertae sedis group, an early eukaryote class. `mapping_method` names the rule; rows no
    rule fits are dropped. Per lineage level the clade rule comes before the class rule.
    """
    low = F.lower(F.coalesce("lineage", F.lit("")))
    parts = F.transform(F.split(low, ";"), strip)
    ranks = F.transform(F.split(F.lower(F.coalesce("ranks", F.lit(""))), ";"), strip)
    levels = F.slice(parts, F.lit(1), F.least(F.size(parts), F.size(ranks)))
    nodes = F.transform(levels, lambda p, i: F.struct(
        i.alias("i"), p.alias("name"), F.get(ranks, i).alias("rank")
    ))
    domain = lineage_text_domain(F.col("lineage"))

    def verdict(phylum, dom, method):
        return F.struct(phylum.alias("phylum"), dom.alias("domain"), method.alias("mapping_method"))

    def keyword(part, table, prefix, dom):
        return F.coalesce(*[
            F.when(part.contains(k), verdict(F.lit(v), dom, F.lit(f"{prefix}_{k}")))
            for k, v in table.items()
        ])

    def by_level(x):
        clade = F.when(x["rank"] == "clade", keyword(x["name"], fv.CLADE_PHYLA, "clade_mapping", domain))
        cls = F.when(
            low.contains("bacteria") & x["rank"].isin("class", "clade"),
            keyword(x["name"], fv.BACTERIAL_CLASS_PHYLA, "bacterial_mapping", F.lit("Bacteria")),
        )
        return F.coalesce(clade, cls)

    first_level = F.get(F.array_compact(F.transform(nodes, by_level)), F.lit(0))
    parent = F.get(F.filter(nodes, lambda x: x["rank"].isin("phylum", "class", "order")
                            & ~x["name"].contains("incertae sedis")), F.lit(0))
    by_parent = F.when(
        low.contains("incertae sedis") & parent.isNotNull(),
        verdict(F.concat(F.lit("Unclassified_"), parent["name"]), domain, F.lit("incertae_sedis_parent")),
    )
    early = F.get(F.filter(nodes, lambda x: (x["rank"] == "class") & (x["i"] < 4)
                           & x["name"].rlike("|".join(fv.CLASS_AS_PHYLUM_PARTS))), F.lit(0))
    by_class = F.when(
        low.contains("eukaryota") & early.isNotNull(),
        verdict(early["name"], F.lit("Eukaryota"), F.lit("class_as_phylum")),
    )
    fix = F.coalesce(first_level, by_parent, by_class)
    return unmapped.withColumn("_fix", fix).where("_fix is not null").select(
        "taxid", "_fix.phylum", "_fix.domain", "_fix.mapping_method",
        F.col("lineage").alias("original_lineage"),
    )


def place_parents(children: DataFrame, parents: DataFrame, child: str, parent: str, order: str) -> DataFrame:
    """Parent of each child: the parent name found in the child's lineage.

    Several parents in one lineage: the first by `order` (ascending), then name. Children without
    one keep a null parent. The join is on equal lineage parts, never on text search.
    """
    parts = children.select(child, F.explode(F.array_distinct(ln.lineage_names("lineage"))).alias(parent))
    placed = (
        parts.join(parents.select(parent, F.col(order).alias("_order")), parent)
        .groupBy(child).agg(F.min(F.struct("_order", parent)).alias("p"))
        .select(child, F.col(f"p.{parent}").alias(parent))
    )
    return children.select(child).distinct().join(placed, child, "left")


def build_hierarchy(phyla: DataFrame, families: DataFrame, genera: DataFrame) -> DataFrame:
    """Rows `(level, name, family, phylum, placement)`; inputs have `name, order_no, lineage`.

    A genus goes under its family when the family is placed, else under its phylum as an orphan.
    """
    p = phyla.select(F.col("name").alias("phylum"), "order_no")
    f = families.select(F.col("name").alias("family"), "order_no", "lineage")
    g = genera.select(F.col("name").alias("genus"), "order_no", "lineage")
    family_phylum = place_parents(f, p, "family", "phylum", "order_no")
    genus_family = place_parents(g, f.drop("lineage"), "genus", "family", "order_no")
    genus_phylum = place_parents(g, p, "genus", "phylum", "order_no").withColumnRenamed("phylum", "_own")
    families_out = family_phylum.select(
        F.lit("family").alias("level"), F.col("family").alias("name"), "family", "phylum",
        F.when(F.col("phylum").isNull(), "unmatched").otherwise("placed").alias("placement"),
    )
    placed = family_phylum.where("phylum is not null")
    genera_out = (
        genus_family.join(placed, "family", "left").join(genus_phylum, "genus")
        .select(
            F.lit("genus").alias("level"), F.col("genus").alias("name"),
            F.when(F.col("phylum").isNotNull(), F.col("family")).alias("family"),
            F.coalesce("phylum", "_own").alias("phylum"),
            F.when(F.col("phylum").isNotNull(), "placed")
            .when(F.col("_own").isNotNull(), "orphan").otherwise("unmatched").alias("placement"),
        )
    )
    phyla_out = p.select(
        F.lit("phylum").alias("level"), F.col("phylum").alias("name"),
        F.lit(None).cast("string").alias("family"), "phylum", F.lit("placed").alias("placement"),
    )
    return union_all(phyla_out, families_out, genera_out)


def eukaryotes_only(census: DataFrame, names: DataFrame, lineages: DataFrame, col: str) -> DataFrame:
    """Drop rows whose name (or genus) resolves to a lineage without Eukaryota; unresolved stay."""
    ladder = [("name", F.col(col)), ("genus", nm.first_word(F.replace(F.col(col), F.lit("_"), F.lit(" "))))]
    resolved = resolve_names(census, names, col, variants_of(ladder)).select(col, "taxid")
    verdict = resolved.join(lineages, "taxid", "left").select(
        col, F.coalesce(ln.lineage_has("lineage", "Eukaryota"), F.lit(True)).alias("_keep")
    )
    return census.join(verdict.where("_keep").select(col), col, "left_semi")


def mapping_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """Taxids gained and lost between two rank maps."""
    n, o = new.select("taxid").distinct(), old.select("taxid").distinct()
    gained = n.join(o, "taxid", "left_anti").withColumn("change", F.lit("gained"))
    lost = o.join(n, "taxid", "left_anti").withColumn("change", F.lit("lost"))
    return gained.unionByName(lost)


def as_taxid_text(c) -> Column:
    return F.coalesce(as_col(c).cast("string"), F.lit("NA"))
