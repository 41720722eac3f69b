"""Readers and writers with explicit schemas; every path is one all executors can reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Spellings of a missing number, and the label of an unused region.
MISSING = ("", "n/a", "na", "nan")
PLACEHOLDER = "*.*.*.*.*"


def scan_units(spark: SparkSession, pattern: str, schema: str, fmt: str = "csv") -> DataFrame:
    """Union of the per-unit files that match, with the file of each row."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(pattern).withColumn("source_file", F.input_file_name())


def file_counts(units: DataFrame) -> DataFrame:
    return units.agg(F.count_distinct("source_file").alias("n_files"), F.count(F.lit(1)).alias("n_rows"))


def as_number(raw: Column) -> Column:
    """Number or NULL for any spelling of a missing value; other text is an error."""
    text = F.lower(F.trim(raw))
    return F.when(~text.isin(*MISSING), text.cast("double"))


def scan_tsv(spark: SparkSession, path: str, columns: list[str], numbers: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)
    return df.select(*[as_number(F.col(c)).alias(c) if c in numbers else F.col(c) for c in columns])


def invalid_numbers(df: DataFrame, value: str) -> DataFrame:
    """Rows with a negative or infinite value, which the scan must not accept."""
    v = F.col(value)
    return df.filter((v < 0) | (F.abs(v) == float("inf")) | F.isnan(v))


def scan_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_labels(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id name ...``; other lines, ids <= 0 and placeholder names are skipped."""
    parts = F.split(F.trim(F.regexp_replace("value", "^﻿", "")), r"\s+")
    d = spark.read.text(path).select(F.try_element_at(parts, F.lit(1)).alias("id"),
                                     F.try_element_at(parts, F.lit(2)).alias("roi_name"))
    d = d.select(F.expr("try_cast(try_cast(id AS double) AS int)").alias("roi_id"), "roi_name")
    return d.filter((F.col("roi_id") > 0) & F.col("roi_name").isNotNull()
                    & (F.col("roi_name") != PLACEHOLDER))


def scan_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Size and SHA-256 of every file below ``path``, read as bytes by the executors."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return d.select(F.col("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_pattern_cache(df: DataFrame, path: str, roi: str, subject: str, spread: int | None = None,
                        spread_by: str | None = None) -> None:
    """One folder per region, so later stages read only theirs; inside it rows are sorted by
    subject for file skipping. A large subject or region is spread over ``spread`` tasks (by
    default as many as there are shuffle partitions)."""
    spread = spread or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.hash(spread_by), F.lit(spread)) if spread_by else F.lit(0)
    (df.repartition(F.col(roi), F.col(subject), salt).sortWithinPartitions(roi, subject)
     .write.partitionBy(roi).parquet(path))


def write_results(long: DataFrame, wide: DataFrame, path: str) -> None:
    """Both shapes of a result; an existing result is never overwritten."""
    long.write.mode("error").parquet(f"{path}/long")
    wide.write.mode("error").parquet(f"{path}/wide")
