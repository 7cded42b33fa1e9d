"""Joins and upserts between record tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_new(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Incoming rows whose key is not there yet, each key once, the first by `order`."""
    rest = [c for c in incoming.columns if c not in key]
    least = F.struct(order, *[c for c in rest if c != order])
    once = incoming.groupBy(*key).agg(F.min(least).alias("_m")).select(*key, "_m.*").select(*incoming.columns)
    return once.join(existing.select(*key).distinct(), list(key), "left_anti")


def upsert(stored: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """A full merge in which a new row without a value never replaces a stored one."""
    a = stored.select(key, F.col(value).alias("_old"))
    b = new.select(key, F.col(value).alias("_new"))
    return a.join(b, key, "full").select(key, F.coalesce("_new", "_old").alias(value))


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A dimension: the first row of each key."""
    rest = [c for c in rows.columns if c != key]
    least = F.struct(order, *[c for c in rest if c != order])
    return rows.groupBy(key).agg(F.min(least).alias("_m")).select(key, "_m.*").select(*rows.columns)


def changed_rows(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value differs, nulls compared as equal: what a keyed update has to write."""
    return old.select(key, F.col(value).alias("before")).join(new.select(key, F.col(value).alias("after")), key).where(
        ~F.col("before").eqNullSafe(F.col("after"))
    )


def fresh_entries(cache: DataFrame, now: float, ttl_days: int) -> DataFrame:
    """Cache rows (key, payload, fetched_at) that are neither empty nor older than the limit."""
    return cache.where((F.lit(now) - F.col("fetched_at") <= ttl_days * 86400) & (F.coalesce("payload", F.lit("")) != ""))


def merge_maps(weak: DataFrame, strong: DataFrame, key: str, value: str) -> DataFrame:
    """Two dictionaries as one; where both have a key the second one's value counts."""
    a, b = weak.select(key, F.col(value).alias("_a")), strong.select(key, F.col(value).alias("_b"))
    return a.join(b, key, "full").select(key, F.coalesce("_b", "_a").alias(value))


def still_to_do(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the cache has no answer for: what a resumed bulk job has left."""
    return rows.select(key).distinct().join(cache.select(key).distinct(), key, "left_anti")
