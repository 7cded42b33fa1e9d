"""Sources: CSV, JSON lines, text, JDBC, the pincode dimension, geocoder payloads and caches."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators.tables import first_per_key

ADDRESS_COLUMNS = (
    "address_id BIGINT, source_raw_address STRING, normalized_full_address STRING, house_no STRING, flat_no STRING, "
    "floor STRING, house_name STRING, apartment_name STRING, landmark STRING, street STRING, area STRING, town STRING, "
    "village STRING, district STRING, state STRING, country STRING, pincode STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
PAIR_COLUMNS = (
    "id BIGINT, raw_address STRING, noisy_input STRING, clean_target STRING, city STRING, state STRING, pincode STRING, "
    "is_verified BOOLEAN"
)
#: Header names that mean the same.
PINCODE_HEADERS = {
    "pincode": ("pincode", "pin", "pin_code", "postal_code"),
    "office": ("officename", "postofficename", "office", "office_name", "post_office"),
    "district": ("districtname", "districtsname", "district", "district_name"),
    "state": ("statename", "state", "state_name"),
}


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """The column raw_address of a CSV file with a header, trimmed, blank ones dropped."""
    rows = spark.read.option("header", True).csv(path).select(F.trim("raw_address").alias("raw_address"))
    return rows.where(F.col("raw_address") != "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text, trimmed, blank ones dropped."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where(F.col("text") != "")


def read_pairs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Training pairs of a JSON-lines file; bad lines fail if `strict`, else they are left out."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(PAIR_COLUMNS).option("mode", mode).json(path)


def read_address_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of a JSON-lines file: over four characters, each text once, the smallest id of each."""
    rows = read_pairs(spark, path, strict=True).select("id", F.trim(F.coalesce("clean_target", "raw_address")).alias("text"))
    return first_per_key(rows.where(F.char_length("text") > 4), "text", "id").select("id", "text")


def jdbc_options(env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Options of a MySQL reader from DB_URL, or DB_HOST, DB_PORT, DB_USER, DB_PASSWORD, DB_NAME."""
    url = env.get("DB_URL") or f"jdbc:mysql://{env.get('DB_HOST', 'localhost')}:{env.get('DB_PORT', '3306')}/{env.get('DB_NAME', 'addresses')}"
    return {"url": url, "user": env.get("DB_USER", ""), "password": env.get("DB_PASSWORD", "")}


def read_jdbc(spark: SparkSession, table: str, low: int, high: int, parts: int, options: Mapping[str, str] | None = None) -> DataFrame:
    """A table read in ranges of address_id."""
    reader = spark.read.format("jdbc").options(**(options or jdbc_options()))
    return reader.options(
        dbtable=table, partitionColumn="address_id", lowerBound=low, upperBound=high, numPartitions=parts
    ).load()


def canonical_text() -> Column:
    """The normalised text, else the raw one, else the parts; null if all are blank."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(F.col("normalized_full_address")), blank(F.col("source_raw_address")), blank(X.compose()))


def remap_headers(rows: DataFrame, names: Mapping[str, Sequence[str]] = PINCODE_HEADERS) -> DataFrame:
    """Columns renamed by synonyms, letter case and spaces aside; a missing one is null."""
    have = {c.lower().replace(" ", "_"): c for c in rows.columns}
    have |= {c.lower().replace(" ", ""): c for c in rows.columns}
    cols = []
    for name, others in names.items():
        found = next((have[o] for o in others if o in have), None)
        cols.append((F.col(f"`{found}`").cast("string") if found else F.lit(None).cast("string")).alias(name))
    return rows.select(*cols)


def pincode_dimension(rows: DataFrame) -> DataFrame:
    """One row for each valid pincode, the first office by name; district and state in lower case."""
    named = remap_headers(rows).where(F.col("pincode").rlike("^[0-9]{6}$"))
    return first_per_key(named, "pincode", "office").select(
        "pincode", "office", F.lower(F.trim("district")).alias("district"), F.lower(F.trim("state")).alias("state")
    )


def precision_of(kind: Column) -> Column:
    return F.coalesce(X.lookup(V.PRECISION)[kind], F.lit(0.5))


def parse_geocode(payload: Column | str) -> Column:
    """A geocoder's JSON answer as a struct, null for an empty one."""
    p = F.col(payload) if isinstance(payload, str) else payload
    get = lambda path: F.get_json_object(p, path)
    kind = F.coalesce(
        get("$.location_type"),
        get("$.geometry.location_type"),
        precision_class(get("$.place_rank").try_cast("int"), PLACE_RANKS),
        precision_class(get("$.confidence").try_cast("int"), CONFIDENCES),
    )
    return F.when(
        p.isNotNull() & (p != ""),
        F.struct(
            F.coalesce(get("$.formatted"), get("$.formatted_address"), get("$.display_name")).alias("formatted"),
            F.coalesce(get("$.lat"), get("$.geometry.location.lat")).try_cast("double").alias("lat"),
            F.coalesce(get("$.lon"), get("$.lng"), get("$.geometry.location.lng")).try_cast("double").alias("lon"),
            F.coalesce(get("$.postal_code"), get("$.address.postcode")).alias("postal_code"),
            F.coalesce(get("$.city"), get("$.address.city"), get("$.address.town")).alias("city"),
            F.coalesce(get("$.state"), get("$.address.state")).alias("state"),
            F.coalesce(get("$.place_id"), F.lit("")).alias("place_id"),
            precision_of(kind).alias("precision"),
        ),
    )


class TableGeocoder:
    """Answers geocoding from a table (query, payload): the offline provider."""

    def __init__(self, answers: DataFrame):
        self.answers = first_per_key(answers.select(F.lower(F.trim("query")).alias("query"), "payload"), "query", "payload")

    def geocode(self, rows: DataFrame, text: str) -> DataFrame:
        found = self.answers.select(F.col("query").alias("_q"), parse_geocode("payload").alias("geocode"))
        return rows.join(found, F.lower(F.trim(text)) == F.col("_q"), "left").drop("_q")


class NullGeocoder:
    """Knows nothing; what a run without a provider uses."""

    def geocode(self, rows: DataFrame, text: str) -> DataFrame:
        return rows.withColumn("geocode", F.when(F.lit(False), parse_geocode(F.lit(""))))


def select_geocoder(answers: DataFrame | None = None):
    """The table's provider if there is one, else the null one."""
    return NullGeocoder() if answers is None else TableGeocoder(answers)


def read_prompts(spark: SparkSession, path: str, with_geo: bool = True, share: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Prompts and targets (id, prompt, target) of a JSON-lines file of pairs, split by a hash of the id into training and
    validation rows, so that a row is on the same side in every run."""
    from ..functions import display as D

    rows = read_pairs(spark, path).where("trim(coalesce(noisy_input, '')) <> '' AND trim(coalesce(clean_target, '')) <> ''")
    prompt = D.geo_prompt(F.trim("noisy_input"), F.col("city"), F.col("state"), F.col("pincode")) if with_geo else F.trim("noisy_input")
    made = rows.select("id", prompt.alias("prompt"), F.trim("clean_target").alias("target"))
    held = F.pmod(F.xxhash64("id", "prompt", F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    return made.where(~held), made.where(held)


def read_artifacts(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Published tables that belong together; an error if their row counts differ."""
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in names}
    counts = {name: t.count() for name, t in tables.items()}
    if len(set(counts.values())) > 1:
        raise ValueError(f"tables of one build differ in rows: {counts}")
    return tables


def read_pincodes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The pincode dimension from the first of `paths` that can be read and has rows: CSV with a header, or JSON lines."""
    failures = []
    for path in paths:
        try:
            rows = spark.read.json(path) if ".json" in path else spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
            found = pincode_dimension(rows)
            if not found.isEmpty():
                return found
            failures.append(f"{path}: no rows")
        except Exception as error:  # the next mirror is tried; all failures are told at the end
            failures.append(f"{path}: {str(error).splitlines()[0]}")
    raise OSError("no pincodes: " + "; ".join(failures))


def lookup_pincodes(asked: DataFrame, dimension: DataFrame, misses: DataFrame, fetch=None) -> tuple[DataFrame, DataFrame]:
    """Rows of the dimension for distinct asked pincodes, and the ones it lacks.  `misses` are known not to exist;
    `fetch(batches)`, if given, is asked for the others, in batches, for the caller to append."""
    once = asked.select("pincode").where(F.col("pincode").rlike("^[0-9]{6}$")).distinct()
    found = once.join(dimension, "pincode")
    unknown = once.join(dimension, "pincode", "left_anti").join(misses.select("pincode").distinct(), "pincode", "left_anti")
    if fetch is None:
        return found, unknown
    new = unknown.mapInPandas(fetch, dimension.schema)
    return found.unionByName(new), unknown.join(new.select("pincode"), "pincode", "left_anti")


# The least rank of a place that stands for each precision, where a provider gives a rank or confidence.
PLACE_RANKS = ((30, "ROOFTOP"), (26, "RANGE_INTERPOLATED"), (20, "GEOMETRIC_CENTER"), (0, "APPROXIMATE"))
CONFIDENCES = ((9, "ROOFTOP"), (7, "RANGE_INTERPOLATED"), (5, "GEOMETRIC_CENTER"), (0, "APPROXIMATE"))


def precision_class(value: Column, steps: Sequence[tuple[int, str]]) -> Column:
    """The class of a provider's rank or confidence, null for none."""
    out = F.lit(None).cast("string")
    for least, name in reversed(steps):
        out = F.when(value >= least, name).otherwise(out)
    return out
