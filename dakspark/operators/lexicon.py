"""Corpus statistics: token counts, areas, context weights, n-gram models, mined misspellings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V


def token_counts(rows: DataFrame, toks: Column, least_letters: int = 2) -> DataFrame:
    """How often each alphabetic token of two letters and more occurs."""
    words = rows.select(F.explode(toks).alias("token")).where(F.col("token").rlike(f"^[a-z]{{{least_letters},}}$"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


def areas(counts: DataFrame, cities: Sequence[str] = V.CITIES, least: int = 5) -> DataFrame:
    """Tokens of over three letters, neither stop word nor city, seen `least` times or more."""
    return counts.where(
        (F.char_length("token") > 3) & ~F.col("token").isin(*V.STOP_WORDS, *cities) & (F.col("n") >= least)
    )


def context_weights(rows: DataFrame, toks: str, weight: int = 2, least: int = 2) -> DataFrame:
    """Per token its weight as a road and as a locality: `weight`, and one more before a word of that class."""
    pairs = F.transform(
        toks, lambda t, i: F.struct(t.alias("token"), F.get(F.col(toks), i + 1).alias("after"))
    )
    words = rows.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("token").rlike("^[a-z]{3,}$"))
    road = F.coalesce(F.col("after").isin(*V.ROAD_WORDS), F.lit(False))
    locality = F.coalesce(F.col("after").isin(*V.LOCALITY_WORDS), F.lit(False))
    return (
        words.groupBy("token")
        .agg(
            F.sum(F.when(road, weight + 1).otherwise(0)).alias("road_weight"),
            F.sum(F.when(locality, weight + 1).otherwise(0)).alias("locality_weight"),
            F.sum(F.lit(weight)).alias("geo_weight"),
        )
        .where(F.col("geo_weight") >= least)
    )


def bigrams(rows: DataFrame, toks: str) -> DataFrame:
    """Counts of neighbouring tokens and of the first of them."""
    pairs = F.transform(
        F.slice(F.col(toks), F.lit(1), F.greatest(F.size(toks) - 1, F.lit(0))),
        lambda t, i: F.struct(t.alias("first"), F.get(F.col(toks), i + 1).alias("second")),
    )
    two = rows.select(F.explode(pairs).alias("p")).select("p.*").groupBy("first", "second").agg(F.count("*").alias("n"))
    one = rows.select(F.explode(toks).alias("first")).groupBy("first").agg(F.count("*").alias("n_first"))
    return two.join(one, "first")


def log_probability(rows: DataFrame, key: str, toks: str, model: DataFrame, vocabulary: int) -> DataFrame:
    """The mean log probability of each row's bigrams, with one added to each count."""
    pairs = F.transform(
        F.slice(F.col(toks), F.lit(1), F.greatest(F.size(toks) - 1, F.lit(0))),
        lambda t, i: F.struct(t.alias("first"), F.get(F.col(toks), i + 1).alias("second")),
    )
    given = rows.select(key, F.explode(pairs).alias("p")).select(key, "p.*")
    one = model.groupBy("first").agg(F.max("n_first").alias("n_first"))
    scored = given.join(model.select("first", "second", "n"), ["first", "second"], "left").join(one, "first", "left")
    part = F.log((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("n_first", F.lit(0)) + vocabulary))
    return scored.groupBy(key).agg(F.avg(part).alias("log_probability"))


def mine_misspellings(pairs: DataFrame, least: int = 3, share: float = 0.60) -> DataFrame:
    """From rows (noisy, clean) of token lists of equal length: src, dst seen often and mostly together.

    Sources that are a usual word themselves, known already, or half of a swap are left out.
    """
    diffs = pairs.select(F.explode(X.changed_tokens(F.col("noisy"), F.col("clean"))).alias("d")).select("d.*")
    words = diffs.where(F.col("src").rlike("^[a-z]{3,}$") & F.col("dst").rlike("^[a-z]{3,}$"))
    counts = words.groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = counts.groupBy("src").agg(F.sum("n").alias("total"))
    best = Window.partitionBy("src").orderBy(F.col("n").desc(), "dst")
    top = counts.withColumn("rank", F.row_number().over(best)).where("rank = 1").join(total, "src")
    kept = top.where((F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).select("src", "dst", "n", "total")
    known = (*V.CITIES, *V.ROAD_WORDS, *V.LOCALITY_WORDS, *V.STOP_WORDS, *V.MISSPELLINGS)
    swap = kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return kept.where(~F.col("src").isin(*known)).join(swap, ["src", "dst"], "left_anti")


# Counts of words that are known but not seen, of the vocabulary and of corrections' targets.
KNOWN_PRIOR, TARGET_PRIOR = 20, 15


def with_priors(counts: DataFrame, known: DataFrame, targets: DataFrame) -> DataFrame:
    """Token counts (token, n) with a constant count for known words (token), and another for targets, that aren't seen."""
    priors = known.select("token", F.lit(KNOWN_PRIOR).alias("prior")).unionByName(targets.select("token", F.lit(TARGET_PRIOR).alias("prior")))
    unseen = priors.groupBy("token").agg(F.max("prior").cast("long").alias("n")).join(counts, "token", "left_anti")
    return counts.select("token", F.col("n").cast("long").alias("n")).unionByName(unseen)


def geo_vocabulary(rows: DataFrame, toks: str, least: int = 2) -> DataFrame:
    """Words beside a road or locality word, or that end like a place, count two, others one: those of `least` and more."""
    t = F.col(toks)
    after = (*V.ROAD_WORDS, *V.LOCALITY_WORDS)
    ends = rf"(?:{'|'.join(V.LOCALITY_WORDS)})$"
    weigh = F.transform(
        t,
        lambda w, i: F.struct(
            w.alias("token"), F.when(F.coalesce(F.get(t, i + 1).isin(*after), F.lit(False)) | w.rlike(ends), 2).otherwise(1).alias("weight")
        ),
    )
    words = rows.select(F.explode(weigh).alias("x")).select("x.*").where(F.col("token").rlike("^[a-z]{4,}$") & ~F.col("token").isin(*V.STOP_WORDS))
    return words.groupBy("token").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= least)


def retarget(learned: DataFrame, curated: DataFrame, hops: int = 3) -> DataFrame:
    """Learned pairs (src, dst) whose target is itself corrected by the curated map point to where that ends, after up to
    `hops` steps; pairs that end at their source go."""
    step = curated.select(F.col("src").alias("_from"), F.col("dst").alias("_to"))
    out = learned.select("src", "dst")
    for _ in range(hops):
        out = out.join(step, F.col("dst") == F.col("_from"), "left").select("src", F.coalesce("_to", "dst").alias("dst"))
    return out.where("src <> dst")
