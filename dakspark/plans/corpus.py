"""The address corpus of the test tables, and queries on it with one letter lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: The corpus's cities are the regions of the test tables.
CITIES = ("africa", "america", "asia", "europe", "middle east", "middle")

ADDRESS_SQL = """addr AS (
  SELECT c_custkey AS addr_id, lower(r_name) AS city, lower(c_mktsegment) AS street,
         CAST(500000 + (c_custkey * 37) % 900 AS VARCHAR) AS pin,
         concat('No ', c_custkey % 977, ', ', lower(c_mktsegment), ' road, ', replace(lower(n_name), '_', 'ward '),
                ' layout, ', lower(r_name), ' ', 500000 + (c_custkey * 37) % 900) AS text
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

NOISY_SQL = """noisy AS (
  SELECT addr_id, city, street, pin, text,
         replace(text, street, concat(substr(street, 1, CAST(addr_id % length(street) AS INT)),
                                      substr(street, CAST(addr_id % length(street) AS INT) + 2))) AS noisy
  FROM addr)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows over all cores: a table of a few megabytes is read in one or two tasks, and text work on it is long."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """addr_id, city, street, pin, text: one address for each customer."""
    read = lambda name: table(spark, sf_dir, name)
    rows = (
        spread(read("customer"), "c_custkey")
        .join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    pin = (500000 + (F.col("c_custkey") * 37) % 900).cast("string")
    ward = F.replace(F.lower("n_name"), F.lit("_"), F.lit("ward "))
    return rows.select(
        F.col("c_custkey").alias("addr_id"),
        F.lower("r_name").alias("city"),
        F.lower("c_mktsegment").alias("street"),
        pin.alias("pin"),
        F.concat(
            F.lit("No "), (F.col("c_custkey") % 977).cast("string"), F.lit(", "), F.lower("c_mktsegment"), F.lit(" road, "),
            ward, F.lit(" layout, "), F.lower("r_name"), F.lit(" "), pin,
        ).alias("text"),
    )


def noisy_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses with `noisy`, the text without one letter of its street's name."""
    at = (F.col("addr_id") % F.char_length("street")).cast("int")
    short = F.concat(F.substr("street", F.lit(1), at), F.substr("street", at + 2, F.char_length("street")))
    return addresses(spark, sf_dir).withColumn("noisy", F.replace("text", F.col("street"), short))


def parsed(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("parsed", X.parse(text))
