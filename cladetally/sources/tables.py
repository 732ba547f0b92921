"""Readers and writers. Every reader takes a fixed schema; nothing is inferred from the data."""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from cladetally.functions import names as nm
from cladetally.functions.common import as_col, strip
from cladetally.session import materialize
from cladetally.sources.reports import array_elements

CLUSTER_COLUMNS = {
    "16s": ["centroid", "members", "size", "phylum", "familiy", "genus"],
    "18s": ["centroid", "members", "size", "division", "family", "genus"],
}
ASSEMBLY_COLUMNS = [
    "assembly_accession", "bioproject", "biosample", "wgs_master", "refseq_category", "taxid",
    "species_taxid", "organism_name", "infraspecific_name", "isolate", "version_status",
    "assembly_level", "release_type", "genome_rep", "seq_rel_date", "asm_name", "asm_submitter",
    "gbrs_paired_asm", "paired_asm_comp", "ftp_path", "excluded_from_refseq",
    "relation_to_type_material", "asm_not_live_date", "assembly_type", "group", "genome_size",
    "genome_size_ungapped", "gc_percent",
]
LATER_ASSEMBLY_COLUMNS = ["asm_not_live_date", "assembly_type", "group", "genome_size", "genome_size_ungapped", "gc_percent"]
USED_ASSEMBLY_COLUMNS = [
    "assembly_accession", "taxid", "species_taxid", "organism_name", "assembly_level", "isolate",
    "excluded_from_refseq", "genome_size", "gc_percent", "seq_rel_date",
]


def _text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Column names of a delimited file: one line of one file is read."""
    return spark.read.option("sep", sep).option("header", True).csv(path).limit(0).columns


def require_columns(found, wanted) -> None:
    missing = [c for c in wanted if c not in found]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def read_clusters(spark: SparkSession, path: str, gene: str) -> DataFrame:
    """Cluster TSV of a gene (`16s` or `18s`); the misspelt family column is renamed."""
    wanted = CLUSTER_COLUMNS[gene]
    found = _header(spark, path, "\t")
    require_columns(found, wanted)
    raw = spark.read.schema(_text_schema(found)).option("sep", "\t").option("header", True).csv(path)
    out = raw.select(*wanted).withColumn("size", F.col("size").try_cast("bigint"))
    return out.withColumnRenamed("familiy", "family")


def _file_lines(spark: SparkSession, path) -> DataFrame:
    """`(file, block, value)`: lines with their file and the place of their split in it."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _column_places(lines: DataFrame, required) -> DataFrame:
    """Stored `(file, names)`: the column names of each file, one row per file."""
    comments = lines.where((F.col("block") == 0) & F.col("value").startswith("#") & F.col("value").contains(ASSEMBLY_COLUMNS[0]))
    names = F.transform(F.split(F.ltrim(F.col("value"), F.lit("# ")), "\t"), lambda name: strip(name))
    heads = materialize(comments.select("file", names.alias("names")).where(F.array_contains("names", ASSEMBLY_COLUMNS[0]))
                        .groupBy("file").agg(F.min("names").alias("names")))
    absent = F.array_except(F.array(*[F.lit(c) for c in required]), "names")
    faulty = heads.select("file", absent.alias("absent")).where(F.size("absent") > 0).orderBy("file").first()
    if faulty is not None:
        raise ValueError(f"missing columns: {faulty['absent']} in {faulty['file']}")
    return heads


def read_assembly_summary(spark: SparkSession, path, keep=USED_ASSEMBLY_COLUMNS, optional=LATER_ASSEMBLY_COLUMNS) -> DataFrame:
    """Assembly summaries. Every file's columns are found by the names in its own header, so that files of several
    layouts can be read together; columns of `keep` that are not `optional` must be there.

    `#` lines are skipped; rows without a numeric taxid are dropped; `na` in numeric columns becomes null. Files
    without a header hold no rows: an error names the first one that has any.
    """
    lines = _file_lines(spark, path)
    required = [c for c in dict.fromkeys([*keep, "taxid"]) if c not in optional]
    heads = _column_places(lines, required)
    rows = lines.where(~F.col("value").startswith("#") & (strip("value") != "")).join(heads, "file", "left")
    rows = rows.withColumn("parts", F.split("value", "\t"))
    unheaded = F.raise_error(F.concat(F.lit("no header in "), F.col("file"))).cast("string")

    def text(name):
        place = F.array_position("names", name)
        found = F.when(place > 0, F.nullif(F.get("parts", place.cast("int") - 1), F.lit("")))
        return F.when(F.col("names").isNull(), unheaded).otherwise(found)

    shaped = {
        "taxid": strip(text("taxid")).try_cast("bigint"), "species_taxid": text("species_taxid").try_cast("bigint"),
        "genome_size": text("genome_size").try_cast("bigint"), "gc_percent": text("gc_percent").try_cast("double"),
        "seq_rel_date": F.try_to_date(F.replace(text("seq_rel_date"), F.lit("/"), F.lit("-"))),
    }
    out = rows.select(*[shaped.get(c, text(c)).alias(c) for c in dict.fromkeys([*keep, "taxid"])])
    return out.where(F.col("taxid").isNotNull()).select(*keep)


def read_gtdb_taxonomy(spark: SparkSession, *paths: str) -> DataFrame:
    """Headerless `accession, taxonomy` TSVs, stacked."""
    schema = _text_schema(["accession", "taxonomy"])
    return spark.read.schema(schema).option("sep", "\t").csv(list(paths))


def read_gtdb_metadata(spark: SparkSession, *paths: str) -> DataFrame:
    """Metadata TSVs with a header: first two columns = accession, taxonomy, split into ranks."""
    found = _header(spark, paths[0], "\t")
    raw = (
        spark.read.schema(_text_schema(found)).option("sep", "\t").option("header", True)
        .csv(list(paths))
        .select(F.col(found[0]).alias("accession"), F.col(found[1]).alias("taxonomy"))
    )
    parts = F.split("taxonomy", ";")
    ranks = ["domain", "phylum", "class", "order", "family", "genus", "species"]
    out = raw.select(
        nm.clean_accession("accession").alias("accession_clean"),
        *[
            F.nullif(strip(F.regexp_replace(F.get(parts, F.lit(i)), r"^[a-z]__", "")), F.lit("")).alias(r)
            for i, r in enumerate(ranks)
        ],
    )
    return out.where(
        (F.col("accession_clean") != "") & F.col("domain").isNotNull() & F.col("phylum").isNotNull()
    )


def read_taxid_map(spark: SparkSession, path) -> DataFrame:
    """Two-column TSV; lines of another width are skipped; of the lines of a clean accession the last one stays.

    Lines are ordered by file name, split and place in the split; an accession's lines combine before the
    shuffle."""
    lines = _file_lines(spark, path).withColumn("at", F.monotonically_increasing_id())
    parts = F.split(strip("value"), "\t")
    pairs = lines.where(F.size(parts) == 2).select(
        nm.clean_accession(parts.getItem(0)).alias("accession_clean"), strip(parts.getItem(1)).alias("taxid"),
        F.struct("file", "block", "at").alias("place"),
    )
    return pairs.groupBy("accession_clean").agg(F.max_by("taxid", "place").alias("taxid"))


def read_numbered(spark: SparkSession, path, comment: str = "#") -> DataFrame:
    """`(record, value)`: the lines that are neither empty nor comments, numbered from 0 through all files in the order of
    their names.

    Counts per split and their running sums give each split its first number, so no line is sorted or sent.
    The lines are stored once, as splits may be dealt out anew for a second read.
    """
    lines = _file_lines(spark, path).where(~F.col("value").startswith(comment) & (strip("value") != ""))
    stored = materialize(lines.withColumn("at", F.monotonically_increasing_id()))
    splits = stored.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    # One row per split.
    before = F.sum("lines").over(W.partitionBy(F.lit(1)).orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1))
    starts = materialize(splits.withColumn("before", F.coalesce(before, F.lit(0))).select("file", "block", "first", "before"))
    return stored.join(starts, ["file", "block"]).select(
        (F.col("before") + F.col("at") - F.col("first")).alias("record"), "value")


def _read_dmp(spark: SparkSession, path: str, fields: dict) -> DataFrame:
    parts = F.split("value", r"\|")
    return spark.read.text(path).select(
        *[strip(F.get(parts, F.lit(i))).alias(name) for name, i in fields.items()]
    )


def read_taxdump(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """`nodes(taxid, parent, rank)` and `names(taxid, name, name_class)`."""
    nodes = _read_dmp(spark, f"{folder}/nodes.dmp", {"taxid": 0, "parent": 1, "rank": 2})
    names = _read_dmp(spark, f"{folder}/names.dmp", {"taxid": 0, "name": 1, "name_class": 3})
    nodes = nodes.select(
        F.col("taxid").try_cast("bigint").alias("taxid"),
        F.col("parent").try_cast("bigint").alias("parent"),
        "rank",
    )
    names = names.withColumn("taxid", F.col("taxid").try_cast("bigint"))
    return nodes.where("taxid is not null"), names.where("taxid is not null")


def scientific_names(names: DataFrame) -> DataFrame:
    return names.where(F.col("name_class") == "scientific name").select("taxid", "name")


def read_eukprot(spark: SparkSession, path: str) -> DataFrame:
    """EukProt metadata: blanks for underscores in names, previous names as an array."""
    found = _header(spark, path, "\t")
    require_columns(found, ["EukProt_ID", "Name_to_Use", "Previous_Names", "Taxonomy_UniEuk"])
    raw = spark.read.schema(_text_schema(found)).option("sep", "\t").option("header", True).csv(path)
    return shape_eukprot(raw)


def shape_eukprot(raw: DataFrame) -> DataFrame:
    def spaced(c) -> Column:
        return strip(F.replace(as_col(c), F.lit("_"), F.lit(" ")))

    previous = F.transform(F.split(F.coalesce("Previous_Names", F.lit("")), ","), spaced)
    return raw.select(
        F.col("EukProt_ID").alias("eukprot_id"),
        spaced("Name_to_Use").alias("name_to_use"),
        F.filter(previous, lambda x: x != "").alias("previous_names"),
        F.col("Taxonomy_UniEuk").alias("taxonomy"),
    )


def read_rank_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Count, accession or combination CSV; `#` lines are comments, `NA` is null."""
    return (
        spark.read.schema(schema).option("header", True).option("comment", "#")
        .option("nullValue", "NA").csv(path)
    )


REPORT_SCHEMA = (
    "accession string, assembly_info struct<assembly_type:string,assembly_level:string>, "
    "biosample struct<attributes:array<struct<name:string,value:string>>>"
)


def read_assembly_reports(spark: SparkSession, path) -> DataFrame:
    """JSON report files, one row per report; a file of any size is read by many tasks."""
    return shape_reports(array_elements(spark, path, REPORT_SCHEMA))


def shape_reports(reports: DataFrame) -> DataFrame:
    return reports.where("r.accession is not null").select(
        F.col("r.accession").alias("accession"),
        F.col("r.assembly_info.assembly_type").alias("assembly_type"),
        F.col("r.assembly_info.assembly_level").alias("assembly_level"),
        F.col("r.biosample.attributes").alias("attributes"),
    )


def clean_text(c) -> Column:
    """Control characters and repeated blanks squeezed to one blank."""
    return strip(F.regexp_replace(as_col(c), r"[\x00-\x1f\x7f\s]+", " "))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=()) -> None:
    """CSV, TSV or Parquet folder. Text formats get squeezed text and `NA` for null."""
    if fmt == "parquet":
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        return
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    out = df.withColumns({c: clean_text(c) for c in text}) if text else df
    (
        out.write.mode("overwrite").partitionBy(*partition_by)
        .option("header", True).option("nullValue", "NA")
        .option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    )
