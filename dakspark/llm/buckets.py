"""Links between items that share a bucket, without listing the pairs of a bucket.

Copies of one original are each like it, but less like each other.  So each bucket tries its most
central item, the one whose buckets are fullest, against the others; then the most central of those
that the first did not reach; and so on.  A large group of copies is joined by its original in one
round, at the cost of its size.  What is still apart after LEADER_ROUNDS rounds is tried in full, but
only across components, and only pairs that a caller's bound does not rule out.  Small buckets, if the
caller says what is small, are tried in full before and take no part in the rounds, which then have
little or nothing to do.  Whatever is tried is confirmed by the caller on full data, and no pair that
could be a link is left untried, unless its ends are in one component already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut_at, drop_path, maybe_broadcast, release
from .components import connected_components

LEADER_ROUNDS = 3
#: Items that share so many small buckets are tried first, without a bound.
LIKELY = 3


def link_buckets(
    keys: DataFrame,
    confirm: Callable[[DataFrame], DataFrame],
    near: Callable[[Column, Column], Column],
    refine: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
    worth: Callable[[Column, Column, Column], Column] | None = None,
    prepare: Callable[[DataFrame], None] | None = None,
    scratch: Scratch | None = None,
    small: int = 0,
    bound: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Components (node, component) of the items that `confirm` links; items without a link have no row.

    `keys` has key, id, n, where rows may repeat; pairs with `near(n, n)` false are never tried; `refine` may drop pairs by a
    cheap test (which `worth` does in the last round), `confirm` keeps those that are links.  For the last, full round, `enrich(ids)` gives
    (id, more) and `worth(key, more, more)` tells if a pair of a bucket can still be a link.  `prepare(ids)`
    is called once with all items that may be tried, before any are, and `bound(ids)` with those that `refine` and `enrich`
    will see.  In buckets of up to `small` items all pairs are tried at once.  Tables that later plans read go to `scratch`, for the caller to drop.
    """
    spark = keys.sparkSession
    scratch = scratch or Scratch(spark)
    # Buckets with more than one item; most items have none, and thin rows of few buckets may fit a broadcast.
    full = keys.groupBy("key").agg(F.min("id").alias("l"), F.max("id").alias("h")).where("l < h").select("key")
    full, full_path = cut_at(full, "buckets")
    side, _ = maybe_broadcast(full, row_bytes=16)
    own = keys.join(side, "key").groupBy("key", "id").agg(F.min("n").alias("n"))
    own, own_path = cut_at(own, "own")
    shared, shared_path = cut_at(own.join(own.groupBy("key").agg(F.count("*").alias("m")), "key"), "shared")
    drop_path(spark, full_path)
    drop_path(spark, own_path)
    parts, tried, met = None, None, None
    if small:
        few = shared.where(F.col("m") <= small)
        left = few.select("key", F.col("id").alias("x"), F.col("n").alias("nx"))
        right = few.select("key", F.col("id").alias("y"), F.col("n").alias("ny"))
        met = left.join(right, "key").where((F.col("x") < F.col("y")) & near(F.col("nx"), F.col("ny")))
        met = met.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.count("*").alias("times"))
        met, met_path = cut_at(met, "met")
    rest = shared.where(F.col("m") > small)
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("id"))
    if prepare is not None:
        prepare((rest.select("id") if met is None else rest.select("id").unionByName(ends(met))).distinct())
    if met is not None:
        # First each item with the one it shares most buckets with, then what is still apart.
        best = met.where(F.col("times") >= LIKELY).groupBy("b").agg(F.max_by("a", "times").alias("a")).select("a", "b")
        tried = scratch.cut(best, "pairs")
        parts = _joined(tried, None, confirm, scratch)
        apart = met.select("a", "b").join(tried, ["a", "b"], "left_anti")
        if parts is not None:
            side, _ = maybe_broadcast(parts, row_bytes=16)
            for end in ("a", "b"):
                apart = apart.join(side.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
            apart = apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
        apart, apart_path = cut_at(apart, "apart")
        drop_path(spark, met_path)
        if bound is not None:
            bound(rest.select("id").unionByName(ends(apart)).distinct())
        more = scratch.cut(refine(apart), "pairs")
        parts = _joined(more, parts, confirm, scratch)
        tried = tried.unionByName(more)
        drop_path(spark, apart_path)
        if rest.isEmpty():
            drop_path(spark, shared_path)
            return _named(keys, parts, scratch)
    if met is None and bound is not None:
        bound(rest.select("id").distinct())
    central = rest.groupBy("id").agg(F.sum("m").alias("cent"))
    members = rest.join(central, "id").select("key", "id", "n", "cent", F.col("id").alias("c"), F.lit(True).alias("open"))
    if parts is not None:
        members = members.drop("c").join(parts.select(F.col("node").alias("id"), "component"), "id", "left")
        members = members.withColumn("c", F.coalesce("component", "id")).drop("component")
    members, members_path = cut_at(members, "members")
    drop_path(spark, shared_path)
    for turn in range(LEADER_ROUNDS + 1):
        # Buckets that are one component by now are done.
        spread = members.groupBy("key").agg(F.min("c").alias("l"), F.max("c").alias("h")).where("l < h").select("key")
        split, split_path = cut_at(members.join(spread, "key"), "split")
        drop_path(spark, members_path)
        if split.isEmpty():
            break
        left = split.select("key", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx"))
        right = split.select("key", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("c").alias("cy"), "open", "cent")
        pair = F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
        if turn < LEADER_ROUNDS:
            best = right.where("open").groupBy("key").agg(F.max("cent").alias("cent"))
            lead = right.where("open").join(best, ["key", "cent"])
            lead = lead.join(lead.groupBy("key").agg(F.min("y").alias("y")), ["key", "y"])
            found = left.join(lead.select("key", "y", "ny", "cy"), "key").where("cx <> cy")
            found = found.where(near(F.col("nx"), F.col("ny")))
            lead, lead_path = cut_at(lead.select("key", "y"), "leaders")
        else:
            if enrich is not None:
                more = enrich(split.select("id").distinct())
                left = left.join(more.select(F.col("id").alias("x"), F.col("more").alias("mx")), "x")
                right = right.join(more.select(F.col("id").alias("y"), F.col("more").alias("my")), "y")
            can = (F.col("cx") < F.col("cy")) & near(F.col("nx"), F.col("ny"))
            if worth is not None:
                can &= worth(left["key"], F.col("mx"), F.col("my"))
            found = left.join(right.drop("open", "cent"), (left["key"] == right["key"]) & can)
        fresh = found.select(*pair).distinct()
        if tried is not None:
            fresh = fresh.join(tried, ["a", "b"], "left_anti")
        fresh = scratch.cut(fresh if turn == LEADER_ROUNDS and worth is not None else refine(fresh), "pairs")
        tried = fresh if tried is None else tried.unionByName(fresh)
        parts = _joined(fresh, parts, confirm, scratch)
        release(spark)
        if turn == LEADER_ROUNDS:
            break
        now = split.drop("c") if parts is not None else split
        if parts is not None:
            now = now.join(parts.withColumnRenamed("node", "id"), "id", "left")
            now = now.withColumn("c", F.coalesce("component", "id")).drop("component")
        reach = lead.join(now.select("key", F.col("id").alias("y"), F.col("c").alias("reached")), ["key", "y"])
        members = now.join(reach.select("key", "reached"), "key", "left").select(
            "key", "id", "n", "cent", "c", (F.col("open") & ~F.coalesce(F.col("c") == F.col("reached"), F.lit(False))).alias("open")
        )
        members, members_path = cut_at(members, "members")
        drop_path(spark, split_path)
        drop_path(spark, lead_path)
    return _named(keys, parts, scratch)


def _joined(pairs: DataFrame, parts: DataFrame | None, confirm: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame | None:
    """The components so far and those of `pairs` that are links."""
    if pairs.isEmpty():
        return parts
    links = confirm(pairs)
    if parts is not None:
        links = links.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return connected_components(links, scratch=scratch)


def _named(keys: DataFrame, parts: DataFrame | None, scratch: Scratch) -> DataFrame:
    if parts is None:
        return keys.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)
    return scratch.cut(parts, "components")
