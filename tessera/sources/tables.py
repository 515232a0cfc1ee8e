"""Sources: delimited and Parquet tables, and the binding of test tables to business records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import norm_basic, norm_legal, parse_list

_strings = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
RECORD = _strings("entity_id", "business_name", "business_address", "country")
TRUTH = _strings("source1_entity_id", "matched_entity_ids")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD, columns: list[str] | None = None) -> DataFrame:
    """A tab-separated file with a header: all text, empty fields are empty texts, `NA` and
    `null` are data, quotes are doubled within quotes, which may hold line ends."""
    rows = spark.read.schema(schema).options(sep="\t", header=True, escape='"', multiLine=True).csv(path)
    return rows.select(columns or schema.names).na.fill("")


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table or folder tree; partition columns come from the folder names."""
    rows = spark.read.parquet(path)
    return rows.select(columns) if columns else rows


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path and length of the files below a folder, without reading them."""
    files = spark.read.format("binaryFile").options(pathGlobFilter=glob, recursiveFileLookup=True).load(root)
    return files.select("path", "length")


def bound_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business records of three sources, derived from the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    name, kind = F.substring("text", 1, 40), F.col("doc_id") % 5
    noisy = (
        F.when(kind == 0, F.replace(name, F.lit("e"), F.lit("E")))
        .when(kind == 1, F.concat(name, F.lit(" Pvt. Ltd.")))
        .when(kind == 2, F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit(", Inc")))
        .when(kind == 3, F.substring("text", 1, 30))
        .otherwise(name)
    )
    source = F.element_at(F.array(F.lit("S1"), F.lit("S2"), F.lit("S3")), (F.col("doc_id") % 3).cast("int") + 1)
    first = F.col("source") == "S1"
    return docs.withColumn("source", source).select(
        F.concat("source", F.lit("-"), "doc_id").alias("entity_id"), "source",
        F.when(first, name).otherwise(noisy).alias("business_name"),
        F.when(~first & (F.col("doc_id") % 20 == 7), "").otherwise(F.substring("text", 41, 40)).alias("business_address"),
        F.col("lang").alias("country"), F.substring("text", 1, 60).alias("truth_key"),
    )


def normalized(records: DataFrame) -> DataFrame:
    """Records with norm_name, norm_name_legal and norm_addr."""
    named = records.withColumns({"norm_name": norm_basic(F.col("business_name")), "norm_addr": norm_basic(F.col("business_address"))})
    return named.withColumn("norm_name_legal", norm_legal(F.col("norm_name")))


def truth_lists(records: DataFrame) -> DataFrame:
    """The raw ground truth: each S1 record and the comma list of its matches, maybe empty."""
    s1 = records.where("source = 'S1'").select(F.col("entity_id").alias("source1_entity_id"), "country", "truth_key")
    others = records.where("source <> 'S1'").select("entity_id", "country", "truth_key")
    lists = s1.join(others, ["country", "truth_key"]).groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("matched_entity_ids"))
    return s1.select("source1_entity_id").join(lists, "source1_entity_id", "left").na.fill("")


def truth_pairs(lists: DataFrame) -> DataFrame:
    """One row for each match of a ground-truth list."""
    items = lists.select("source1_entity_id", F.explode(parse_list(F.col("matched_entity_ids"))).alias("target_entity_id"))
    return items.withColumn("target_source", F.when(F.col("target_entity_id").startswith("S2-"), "S2").otherwise("S3"))


def truth_summary(lists: DataFrame, s1: DataFrame) -> DataFrame:
    """country, match_count and is_singleton of each S1 record; unknown countries are named."""
    counted = lists.select("source1_entity_id", F.size(parse_list(F.col("matched_entity_ids"))).alias("match_count"))
    country = s1.select(F.col("entity_id").alias("source1_entity_id"), "country")
    joined = counted.join(country, "source1_entity_id", "left")
    return joined.select("source1_entity_id", F.coalesce("country", F.lit("UNKNOWN")).alias("country"), "match_count", (F.col("match_count") == 0).alias("is_singleton"))


def targets_of(records: DataFrame, *sources: str) -> DataFrame:
    """The records to be found, of the second and third source unless others are named: their
    union, as one scan."""
    return records.where(F.col("source").isin(*(sources or ("S2", "S3"))))
