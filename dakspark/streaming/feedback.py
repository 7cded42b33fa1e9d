"""Feedback as a stream: label normalising, windows by event time, bandit state, quotas, latest queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEEDBACK = "ts TIMESTAMP, query STRING, predicted STRING, corrected STRING, label STRING, source STRING"


def normal_label(label: Column) -> Column:
    """1 for what means yes, 0 for what means no, null for anything else."""
    said = F.lower(F.trim(label.cast("string")))
    return F.when(said.isin("1", "true", "yes", "correct"), 1).when(said.isin("0", "false", "no", "wrong", "incorrect"), 0)


def split_feedback(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, with label 0 or 1, and rejected ones."""
    named = rows.withColumn("normal", normal_label(F.col("label")))
    good = named.where(F.col("normal").isNotNull()).withColumn("label", F.col("normal")).drop("normal")
    return good, named.where(F.col("normal").isNull()).drop("normal")


def read_event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The files of a Parquet table as a stream; event time as a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    stream = reader.parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts and sums by window of event time and type."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("day"), "event_type", "n", "total")
    )


def within_quota(events: DataFrame, user: str, limit: int) -> DataFrame:
    """Which requests are within `limit` for each user and UTC day, in order of time."""
    from pyspark.sql import Window

    w = Window.partitionBy(user, F.to_date("ts")).orderBy("ts", "event_id")
    return events.withColumn("used", F.row_number().over(w)).withColumn("allowed", F.col("used") <= limit)


EPSILON, DECAY, FLOOR, START = 0.10, 0.995, 0.02, 0.5


def epsilon_after(searches: int) -> float:
    return max(FLOOR, EPSILON * DECAY**searches)


def bandit_stream(feedback: DataFrame) -> DataFrame:
    """Per arm the running mean of rewards, kept as state: (arm, reward) in, (arm, pulls, value) out."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pulls, value = state.get if state.exists else (0, START)
        for batch in batches:
            for reward in batch["reward"]:
                pulls += 1
                value = reward if pulls == 1 else value + (reward - value) / pulls
        state.update((pulls, value))
        yield pd.DataFrame({"arm": [key[0]], "pulls": [pulls], "value": [value]})

    return feedback.groupBy("arm").applyInPandasWithState(
        update, "arm string, pulls long, value double", "pulls long, value double", "update", GroupStateTimeout.NoTimeout
    )


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns its result table."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.table(name)


def choose_arm(values: DataFrame, luck: Column, searches: Column) -> Column:
    """The arm of a search: by chance with a share that falls with the searches, else the arm of the largest value.

    `values` has arm and value, a row an arm (four of them); `luck` is uniform in 0 to 1, so that a run can be repeated.
    """
    arms = [r["arm"] for r in values.orderBy(F.col("value").desc(), "arm").collect()]  # one row an arm
    share = F.greatest(F.lit(FLOOR), EPSILON * F.pow(F.lit(DECAY), searches))
    place = F.floor(luck / share * len(arms)).cast("int")
    return F.when(luck < share, F.element_at(F.array(*[F.lit(a) for a in sorted(arms)]), F.least(place + 1, F.lit(len(arms))))).otherwise(F.lit(arms[0]))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, key: list[str]) -> DataFrame:
    """Runs a stream of updates over what is there; each batch is added to a table of files, and the latest row of each
    key is returned, so that nothing lands on the driver."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(path)
    rest = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("m")).select(*key, "m.*")


def paced(rows: DataFrame, call, schema: str, seconds: float = 1.05, lanes: int = 1) -> DataFrame:
    """Calls an outside service for rows with at least `seconds` between calls: one task a lane, each of which waits.
    `call(row)` returns a tuple; an error is a row with nulls and the message in the column `error`, the last of schema."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                began = time.monotonic()
                try:
                    out.append((*call(row), None))
                except Exception as error:  # told in the row, for a later run to try again
                    out.append((*([None] * (len(names) - 1)), str(error)))
                time.sleep(max(0.0, seconds - (time.monotonic() - began)))
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(lanes).mapInPandas(run, schema)
