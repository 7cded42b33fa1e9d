"""Cleaning, duplicates, audits and noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def keep_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """Of rows with equal keys the first by `order`, which tells rows apart.

    The least of each key is found by a pre-summed aggregate of thin rows, so a hot key is no sort in one task.
    """
    keyed = rows.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min(order).alias("_first"))
    same = keyed["_key"].eqNullSafe(first["_key"]) & keyed[order].eqNullSafe(first["_first"])
    return keyed.join(first, same, "left_semi").drop("_key")


def duplicate_groups(rows: DataFrame, key: Column) -> DataFrame:
    """How many keys occur more than once, and how many rows they have beyond the first."""
    groups = rows.select(key.alias("k")).groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


def spread_keys(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return rows.groupBy(key).agg(F.countDistinct(F.lower(value)).alias("values")).where("values > 1")


def issue_counts(rows: DataFrame, text: str) -> DataFrame:
    return rows.select(F.explode(X.issues(text)).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def quality_report(rows: DataFrame, text: str, source: str, short: int = 20) -> DataFrame:
    """Per source: rows, distinct texts, short ones, blank ones."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    return rows.groupBy(source).agg(
        F.count("*").alias("rows"),
        F.countDistinct(text).alias("distinct_texts"),
        F.sum(F.when(F.char_length(t) < short, 1).otherwise(0)).alias("short_rows"),
        F.sum(F.when(t == "", 1).otherwise(0)).alias("blank_rows"),
    )


def choose_target(raw: Column, clean: Column, verified: Column) -> Column:
    """The raw text if the clean one lacks one of its numbers, if it is verified, or if it is long enough."""
    numbers = lambda t: X.number_tokens(X.tokens(X.normalize_v1(t)))
    lost = F.size(F.array_except(numbers(raw), numbers(clean))) > 0
    return F.when(lost | verified | (F.char_length(F.trim(raw)) >= 5), F.struct(raw.alias("target"), F.lit("raw").alias("target_source"))).otherwise(
        F.struct(clean.alias("target"), F.lit("clean").alias("target_source"))
    )


def clean_training(rows: DataFrame, order: str) -> DataFrame:
    """Pairs (raw_address, clean_target, pincode, is_verified) cleaned: spacing, runs, pincode; blank and repeated ones dropped."""
    picked = rows.withColumn("_t", choose_target(F.col("raw_address"), F.col("clean_target"), F.col("is_verified")))
    text = X.fix_spacing(X.normalize_v1(F.col("_t.target")))
    joined = X.join_pincode(text, F.col("pincode"))
    tidy = F.array_join(X.cap_repeats(X.drop_runs(X.tokens(joined))), " ")
    out = picked.withColumn("cleaned", tidy).withColumn("target_source", F.col("_t.target_source")).drop("_t")
    return keep_first(out.where(F.char_length("cleaned") >= 5), F.col("cleaned"), order)


def add_noise(rows: DataFrame, key: str, text: str, copies: int = 4) -> DataFrame:
    """Each text `copies` times with typing errors; a hash of key, copy and place takes the place of chance."""
    toks = X.tokens(F.lower(F.col(text)))

    def noisy(t: Column, i: Column) -> Column:
        luck = F.pmod(F.xxhash64(F.col(key), F.col("copy"), i, t), F.lit(100))
        at = (F.pmod(F.xxhash64(t, i, F.col("copy")), F.greatest(F.char_length(t) - 1, F.lit(1))) + 1).cast("int")
        n = F.char_length(t)
        sub = lambda a, b: F.substr(t, a, b)
        swap = F.concat(sub(F.lit(1), at - 1), sub(at + 1, F.lit(1)), sub(at, F.lit(1)), sub(at + 2, n))
        drop = F.concat(sub(F.lit(1), at - 1), sub(at + 1, n))
        twice = F.concat(sub(F.lit(1), at), sub(at, n))
        abbreviations = X.lookup({v: k for k, v in X.V.ABBREVIATIONS.items()})
        return (
            F.when((F.char_length(t) < 4) | t.rlike("[0-9]"), t)
            .when(luck < 12, swap)
            .when(luck < 20, drop)
            .when(luck < 27, twice)
            .when(luck < 34, F.coalesce(abbreviations[t], t))
            .when(luck < 38, F.lit(""))
            .otherwise(t)
        )

    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return many.withColumn("noisy", F.array_join(F.filter(F.transform(toks, noisy), lambda t: t != ""), " "))


def issue_samples(rows: DataFrame, key: str, text: str, most: int = 3) -> DataFrame:
    """Per issue its count and the texts of its first rows: at most three a task are kept before the shuffle."""
    found = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), F.explode(X.issues(text)).alias("issue"))
    salted = found.groupBy("issue", F.pmod(F.xxhash64("k"), F.lit(1000)).alias("salt")).agg(
        F.count("*").alias("n"), F.min(F.struct("k", "t")).alias("first")
    )
    ordered = F.slice(F.array_sort(F.collect_list("first")), F.lit(1), F.lit(most))
    return salted.groupBy("issue").agg(F.sum("n").alias("n"), F.transform(ordered, lambda x: x["t"]).alias("samples"))


def reject_reasons(rows: DataFrame, raw: str, cleaned: str) -> DataFrame:
    """Of a cleaning: rows by what became of them, with those a label's bad word marks."""
    from ..functions import display as D

    why = (
        F.when(F.col(raw).isNull() | (F.trim(F.col(raw)) == ""), "missing")
        .when(F.char_length(F.coalesce(F.col(cleaned), F.lit(""))) < 5, "short")
        .when(D.bad_label(F.col(cleaned)), "bad_label")
        .when(F.col(raw) == F.col(cleaned), "unchanged")
        .otherwise("changed")
    )
    return rows.groupBy(why.alias("outcome")).agg(F.count("*").alias("n"))


def top_changes(changes: DataFrame, most: int = 50) -> DataFrame:
    """The commonest replacements (src, dst), with their counts."""
    return changes.groupBy("src", "dst").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "src", "dst").limit(most)


def backfill_pincode(rows: DataFrame, pincode: str, texts: list[str]) -> DataFrame:
    """Rows whose pincode is blank with the first one that a text has; only rows that change."""
    blank = F.coalesce(F.trim(F.col(pincode)), F.lit("")) == ""
    found = F.coalesce(*[X.pincode(F.col(t)) for t in texts])
    return rows.where(blank & found.isNotNull()).withColumn(pincode, found)
