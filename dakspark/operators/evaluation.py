"""Measures: hits, calibration, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hit_rates(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """Hit@1 and Hit@5 of ranked answers (query_id, addr_id, rank) for truth (query_id, true_id)."""
    joined = truth.join(ranked, "query_id", "left")
    per = joined.groupBy("query_id").agg(
        F.max(F.when((F.col("addr_id") == F.col("true_id")) & (F.col("rank") == 1), 1).otherwise(0)).alias("h1"),
        F.max(F.when((F.col("addr_id") == F.col("true_id")) & (F.col("rank") <= 5), 1).otherwise(0)).alias("h5"),
    )
    return per.agg(F.count("*").alias("queries"), F.round(F.avg("h1"), 6).alias("hit_at_1"), F.round(F.avg("h5"), 6).alias("hit_at_5"))


def calibration(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Rows, positive rate, mean, percentiles, Brier score, ROC area (by ranks, ties shared) and average precision.

    Scores are rounded to six places and counted first; the running sums go over distinct scores, cut into a thousand
    stretches, each its own window, with the stretches' totals carried from one to the next.
    """
    scored = scored.withColumn(score, F.round(score, 6))
    stats = scored.agg(
        F.count("*").alias("n"),
        F.sum(label).alias("positives"),
        F.min(score).alias("low"),
        F.max(score).alias("high"),
        F.avg(score).alias("mean"),
        F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"),
        F.percentile(score, [0.1, 0.5, 0.9]).alias("shares"),
    )
    stretch = F.floor(F.col(score) * 1000).cast("long")
    by_score = scored.groupBy(stretch.alias("stretch"), score).agg(F.count("*").alias("c"), F.sum(label).alias("p"))
    totals = by_score.groupBy("stretch").agg(F.sum("c").alias("c"), F.sum("p").alias("p"))  # about a thousand rows
    earlier = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("stretch", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}0") for x in "cp"])
    inside = Window.partitionBy("stretch").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_score.withColumns({f"{x}1": F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in "cp"}).join(F.broadcast(carried), "stretch")
    ranked = ranked.select("c", "p", (F.col("c0") + F.col("c1")).alias("before"), (F.col("p0") + F.col("p1")).alias("p_before"))
    ranked = ranked.crossJoin(F.broadcast(stats.select("n", "positives")))  # one row
    # Precision among all rows of this score and above, weighed by the positives of this score.
    precision = (F.col("positives") - F.col("p_before")) / (F.col("n") - F.col("before"))
    ranks = ranked.agg(
        F.sum(F.col("p") * (F.col("before") + (F.col("c") + 1) / 2)).alias("rank_sum"), F.sum(F.col("p") * precision).alias("gained")
    )
    p, n = F.col("positives"), F.col("n")
    auc = (F.col("rank_sum") - p * (p + 1) / 2) / (p * (n - p))
    return stats.crossJoin(F.broadcast(ranks)).select(  # one row each
        n.alias("rows"),
        F.round(p / n, 6).alias("positive_rate"),
        F.round("low", 6).alias("low"),
        F.round("high", 6).alias("high"),
        F.round("mean", 6).alias("mean"),
        F.round("brier", 6).alias("brier"),
        F.round(auc, 6).alias("roc_auc"),
        F.round(F.col("gained") / p, 6).alias("average_precision"),
        *[F.round(F.get("shares", F.lit(i)), 6).alias(name) for i, name in enumerate(("p10", "p50", "p90"))],
    )


def daily_counts(events: DataFrame, ts: str = "ts", days: int = 14) -> DataFrame:
    """Counts of the last `days` days up to the last event, days without events included."""
    per = events.select(F.to_date(ts).alias("day")).groupBy("day").agg(F.count("*").alias("n"))
    last = events.agg(F.max(F.to_date(ts)).alias("last"))
    calendar = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    return calendar.join(per, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def latest_per_key(rows: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(ts, tie))
    return rows.groupBy(key).agg(last.alias("_m")).select(key, "_m.*").select(*rows.columns)


def bandit_values(feedback: DataFrame, arm: str, reward: str) -> DataFrame:
    """Per arm its mean reward and pulls: what the running update ends at."""
    return feedback.groupBy(arm).agg(F.count("*").alias("pulls"), F.round(F.avg(reward), 6).alias("value"))


def batch_stats(rows: DataFrame, status: str, confidence: str) -> DataFrame:
    """Of a batch of corrections: rows, answered ones, failed ones, the mean confidence of those answered."""
    bad = F.col(status).isin("error", "no_match") | F.col(status).isNull()
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(~bad).alias("ok"),
        F.count_if(bad).alias("failed"),
        F.round(F.avg(F.when(~bad, F.col(confidence))), 6).alias("mean_confidence"),
    )


def engine_stats(rows: DataFrame, text: str, toks: str, areas: DataFrame) -> DataFrame:
    """Sizes of a corpus in one row: addresses, distinct ones, words, areas."""
    words = rows.select(F.explode(toks).alias("token")).agg(F.countDistinct("token").alias("vocabulary"))
    sizes = rows.agg(F.count("*").alias("addresses"), F.countDistinct(text).alias("unique_addresses"))
    return sizes.crossJoin(F.broadcast(words)).crossJoin(F.broadcast(areas.agg(F.count("*").alias("areas"))))  # one row each
