"""Batch readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import safe_name
from ..session import new_table

# The columns of a scraped registry file.
KEY = "pk_unique_id"
SOURCE = "source_url"
SINGLE_FIELDS = [
    "name", "organization_type", "email", "officialWebsite", "officialPhone",
    "yearEstablished", "acceptsVolunteers", "facebookLink", "twitterLink",
    "linkedinLink", "instagramLink", "logo",
    "address_line1", "address_line2", "address_line3",
    "address_city", "address_stateOrRegion", "address_zipOrPostcode",
    "address_country", "address_countryCode",
    "facilityTypeId", "operatorTypeId", "description",
    "area", "numberDoctors", "capacity",
    "missionStatement", "missionStatementLink", "organizationDescription",
    "mongo DB",
]
LIST_FIELDS = [
    "specialties", "procedure", "equipment", "capability",
    "phone_numbers", "websites", "affiliationTypeIds", "countries",
]

REGISTRY_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in [KEY, SOURCE, *SINGLE_FIELDS, *LIST_FIELDS]]
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_registry_csv(spark: SparkSession, path: str, schema: T.StructType = REGISTRY_SCHEMA) -> DataFrame:
    """Registry CSV with header, quoted line breaks and doubled quotes.

    Every column is read as text and typed later, so no inference pass over the file is
    needed. Columns are taken by header name: absent ones are left out, others ignored.
    A multi-line file cannot be split, so large registries should arrive as many files.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}
    header = spark.read.options(**options).csv(path).columns
    present = [c for c in header if c in schema.names]
    as_text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(as_text).options(**options).csv(path).select(*[F.col(f"`{c}`") for c in present])


def with_safe_names(df: DataFrame) -> DataFrame:
    """Rename columns whose names hold blanks or dots."""
    return df.withColumnsRenamed({c: safe_name(c) for c in df.columns if safe_name(c) != c})


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Replace (``overwrite``) or extend (``append``) a Parquet table.

    An appended batch may bring new columns; ``read_evolving`` merges the schemas.
    """
    df.write.mode(mode).parquet(path)


#: Column of a bucketed table: grows along the rows of a key in the order they are sorted by.
ROW_RANK = "_row_rank"


def bucketed_table(df: DataFrame, name: str, key: str, order: list[str], buckets: int) -> DataFrame:
    """The rows as a table bucketed by a key and sorted by it and ``order`` within a bucket, a file for each bucket.

    Joins and aggregates by the key need no exchange. ``ROW_RANK`` stands for the order in a fixed width, so that the
    first row with some property is a minimum of numbers. All rows of a key are in one bucket.
    """
    spark, keys = df.sparkSession, [key, *[F.col(c).asc_nulls_first() for c in order]]
    table, path = new_table(spark, name)
    rows = df.repartition(buckets, key).sortWithinPartitions(*keys).withColumn(ROW_RANK, F.monotonically_increasing_id())
    rows.write.bucketBy(buckets, key).sortBy(key, ROW_RANK).option("path", path).saveAsTable(table)
    return spark.table(table)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def register_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def describe_columns(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type text and nullability."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, col_name string, data_type string, nullable boolean")


def domain_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-null values of the columns with their row counts, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("row_count"))
    )


def rows_from_records(spark: SparkSession, records: list[dict], schema: T.StructType) -> DataFrame:
    """Small literal table under an explicit schema; missing keys become NULL."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in records], schema)


# Layout of the trace and evaluation tables.
TRACE_SCHEMA = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("agent_used", T.StringType()),
    T.StructField("answer_length", T.IntegerType()),
    T.StructField("citation_count", T.IntegerType()),
    T.StructField("total_time_seconds", T.DoubleType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("answer_preview", T.StringType()),
])
EVALUATION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("expected_route", T.StringType()),
    T.StructField("actual_route", T.StringType()),
    T.StructField("correct_route", T.BooleanType()),
    T.StructField("agent_used", T.StringType()),
    T.StructField("answer_length", T.IntegerType()),
    T.StructField("time_seconds", T.DoubleType()),
    T.StructField("answer_preview", T.StringType()),
])
