"""Whole corrections: spelling, candidates, reranking, decision, verification, answer; and cascades of fallbacks.

Candidates come from equi-joins on rare words within a block, so pairs grow with the corpus, not its square.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import similarity as S
from ..functions import text as X
from ..sources.writers import staged
from . import matching, ranking, spelling, verification

#: Words of a query that candidates are looked up by, the rarest; and candidates of a query that ratios see.
RARE_WORDS, POOL = 4, 50
#: The parts of a parsed address that scores of a pair read.
SCORED = ("pincode", "city", "road_anchor", "locality_anchors", "informative_tokens", "numbers")
#: Of a tier that a query reaches: the least score to end there.
FALLBACKS = (("exact", 1.0), ("verified", 0.92), ("rerank", 0.78), ("relaxed", 0.60), ("global", 0.0))


def rare_candidates(queries: DataFrame, corpus: DataFrame, on: Sequence[str] = (), words: int = RARE_WORDS, pool: int = POOL) -> DataFrame:
    """Rows (query_id, addr_id, shared): corpus rows (addr_id, toks) that share one of the query's rarest words, and the
    columns `on` where the query has them; per query those with the largest sum of idf.

    Rare words have short postings, so a query meets few rows however large its block is.  A word whose postings are
    longer than the pool is only used if the query has no rarer one.
    """
    posted = corpus.select("addr_id", *on, F.explode(F.array_distinct("toks")).alias("term"))
    counts = posted.groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.select("query_id", *on, F.explode(F.array_distinct("toks")).alias("term")).join(counts, "term")
    rarest = Window.partitionBy("query_id").orderBy("df", "term")
    asked = asked.withColumn("place", F.row_number().over(rarest)).where(F.col("place") <= words)
    keys = ["term", *on]
    found = asked.select("query_id", "df", *keys).join(posted, keys)
    scored = found.groupBy("query_id", "addr_id").agg(F.sum(1 / F.log2(F.col("df") + 1)).alias("shared"))
    best = Window.partitionBy("query_id").orderBy(F.col("shared").desc(), "addr_id")
    return scored.withColumn("shared", F.round("shared", 9)).withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= pool).drop("_rank")


def candidate_pairs(queries: DataFrame, corpus: DataFrame, pool: int = POOL) -> DataFrame:
    """Rows (query_id, addr_id, shared) of queries (query_id, parsed) and corpus rows (addr_id, parsed): within the query's
    own pincode first, and over all rows for queries whose pincode is missing or has no candidate."""
    q = queries.select("query_id", F.col("parsed.tokens").alias("toks"), F.col("parsed.pincode").alias("pincode"))
    c = corpus.select("addr_id", F.col("parsed.tokens").alias("toks"), F.col("parsed.pincode").alias("pincode"))
    # Within a pincode the pincode itself tells nothing.
    held = q.where(F.col("pincode").isNotNull()).withColumn("toks", F.array_remove("toks", F.col("pincode")))
    near = staged(rare_candidates(held, c, ["pincode"], pool=pool), "candidates")
    rest = q.join(near.select("query_id").distinct(), "query_id", "left_anti")
    wide = rare_candidates(rest.drop("pincode"), c.drop("pincode"), pool=pool)
    return near.unionByName(wide)


def _slim(parsed: str) -> Column:
    """What scores and gates of a pair read of a parsed address."""
    return F.struct(*[F.col(f"{parsed}.{k}") for k in SCORED])


def ranked_matches(queries: DataFrame, corpus: DataFrame, top: int = 5, finalists: int = 10) -> DataFrame:
    """Per query its best corpus rows by the geo-boosted score.

    Sliding ratios are costly, so they see the `finalists` best by token ratios only: the base score without them
    orders the pool.  Pairs of the pool carry their texts and what the score reads; whole parses join the best ones.
    """
    queries, corpus = staged(queries, "queries"), staged(corpus, "corpus")
    pairs = candidate_pairs(queries, corpus)
    left = queries.select("query_id", F.col("text").alias("q_text"), _slim("parsed").alias("q"))
    right = corpus.select("addr_id", F.col("text").alias("c_text"), _slim("parsed").alias("c"))
    pairs = pairs.join(left, "query_id").join(right, "addr_id")
    cheap = pairs.withColumn("ts", S.token_sort_ratio("q_text", "c_text")).withColumn("tt", S.token_set_ratio("q_text", "c_text"))
    cheap = cheap.withColumn("rough", matching.geo_boosted(0.5 * F.col("ts") + 0.5 * F.col("tt"), F.col("q"), F.col("c")))
    order = Window.partitionBy("query_id").orderBy(F.col("rough").desc(), F.col("shared").desc(), "addr_id")
    few = cheap.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= finalists).drop("_place")
    w = matching.WEIGHTS
    base = w[0] * F.col("ts") + w[1] * F.col("tt") + w[2] * S.partial_ratio("q_text", "c_text") + w[3] * S.indel_ratio("q_text", "c_text")
    scored = few.withColumn("base", base).withColumn("score", matching.geo_boosted(F.col("base"), F.col("q"), F.col("c")))
    last = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("base").desc(), "addr_id")
    best = scored.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= top).drop("q", "c")
    best = best.join(queries.select("query_id", F.col("parsed").alias("q")), "query_id")
    return best.join(corpus.select("addr_id", F.col("parsed").alias("c")), "addr_id")


def correct_addresses(queries: DataFrame, corpus: DataFrame, vocabulary: DataFrame, names: DataFrame, dimension: DataFrame, geocoder, top: int = 5) -> DataFrame:
    """The flagship: per query (query_id, text) a corrected address with status, confidence, changes and notes.

    Layers: spelling by the token cascade; candidates by rare words; ranking with the pincode anchor and the composite
    re-pick of near ties; decision between a strong record and a generated address; verification by geocode and pincode.
    A query under three characters has no match.
    """
    long = queries.where(F.char_length(F.trim(F.coalesce("text", F.lit("")))) >= 3)
    spelled = staged(spelling.correct_sentences(long, "query_id", "text", vocabulary, names), "spelled")
    asks = long.select("query_id", F.col("text").alias("raw")).join(spelled, "query_id")
    asks = asks.select("query_id", "raw", F.col("corrected").alias("text"), "changes", X.parse("corrected").alias("parsed"))
    known = corpus.select("addr_id", X.normalize_v1("text").alias("text"), X.parse("text").alias("parsed"))
    asks = staged(asks, "asks")
    found = staged(ranked_matches(asks, known, top), "ranked")
    match = matching.display_similarity(F.col("ts"), F.col("tt"), F.col("q"), F.col("c")) / 100
    anchored = ranking.pincode_anchor(F.col("score") / 100, F.col("q.pincode"), F.col("c.pincode"))
    rated = found.withColumn("probability", anchored).withColumn("match_score", match).withColumn(
        "overlap", matching.distinctive_share(F.col("q.tokens"), F.col("c.tokens"))
    )
    best = ranking.repick(rated.drop("rank")).where("rank = 1")
    best = best.select(
        "query_id",
        "addr_id",
        "c_text",
        "probability",
        "match_score",
        verification.strong_match(F.col("match_score"), F.col("q"), F.col("c"), F.col("q_text"), F.col("c_text")).alias("strong"),
    )
    rows = asks.join(best, "query_id", "left").withColumn("expected_pincode", F.col("parsed.pincode")).withColumn("expected_state", F.col("parsed.state"))
    checked = verification.verify(geocoder.geocode(rows, "text"), dimension)
    return decide(checked).join(queries.select("query_id", F.col("text").alias("query")), "query_id", "right").select(
        "query_id",
        "query",
        F.coalesce("status", F.lit("no_match")).alias("status"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "address",
        "addr_id",
        "corrected",
        "changes",
        "record",
        F.coalesce("notes", F.array(F.lit("query_too_short"))).alias("notes"),
    )


def decide(rows: DataFrame) -> DataFrame:
    """Verified rows with the answer: the record's address if the match is strong, else a generated one, each with its confidence."""
    strong = F.coalesce("strong", F.lit(False))
    pin, precision = F.col("expected_pincode"), F.col("geocode.precision")
    agrees = pin == F.col("geocode.postal_code")
    sure = matching.final_confidence(F.col("probability"), F.when(F.col("geocoded"), precision), F.col("pincode_valid"), F.col("consistent"), agrees)
    sure = F.greatest(sure, F.col("match_score"))
    have = F.lit(0)
    for part in (F.col("parsed.city"), F.col("parsed.state"), pin):
        have = have + part.isNotNull().cast("int")
    made = matching.generated_confidence(
        F.col("pincode_valid"), F.col("consistent"), F.col("geocoded"), have, F.coalesce("match_score", F.lit(0.0))
    )
    status = F.when(strong, F.when(sure >= 0.90, "found_in_database").otherwise(matching.status(sure, F.col("geocoded")))).otherwise(
        F.when(made >= 0.65, "generated").otherwise("low_confidence")
    )
    written = verification.generated_address(F.col("text"), F.col("geocode"), pin, F.col("pincode_valid"), F.col("district"), F.col("state"))
    return rows.select(
        "query_id",
        status.alias("status"),
        F.round(F.when(strong, sure).otherwise(made), 4).alias("confidence"),
        F.when(strong, D.display("c_text")).otherwise(written).alias("address"),
        F.when(strong, F.col("addr_id")).alias("addr_id"),
        F.col("text").alias("corrected"),
        "changes",
        verification.structured_record(F.col("parsed"), F.col("geocode"), F.col("district"), F.col("state")).alias("record"),
        F.when(strong, F.col("notes")).otherwise(F.concat("notes", F.array(F.lit("no_strong_db_match")))).alias("notes"),
    )


def exact_matches(queries: DataFrame, corpus: DataFrame, columns: Sequence[str] = ("raw", "corrected")) -> DataFrame:
    """Rows (query_id, addr_id, by): the first corpus row of equal normal text, by the raw text before the corrected one."""
    canonical = corpus.select(X.normalize_v1("text").alias("norm"), "addr_id").groupBy("norm").agg(F.min("addr_id").alias("addr_id"))
    tries = F.array(*[F.struct(F.lit(i).alias("by"), X.normalize_v1(c).alias("norm")) for i, c in enumerate(columns)])
    asked = queries.select("query_id", F.explode(tries).alias("t")).select("query_id", "t.*").where("norm <> ''")
    hits = asked.join(canonical, "norm").groupBy("query_id").agg(F.min(F.struct("by", "addr_id")).alias("m"))
    return hits.select("query_id", "m.addr_id", "m.by")


def fall_through(queries: DataFrame, tiers: Sequence[tuple[str, DataFrame, float]]) -> DataFrame:
    """Per query the answer of the first tier (name, answers (query_id, addr_id, score), least) whose best score reaches
    its least one; queries that none answers are `generated`.  A tier's answers count only for what earlier ones left."""
    left, out = queries.select("query_id"), None
    for name, answers, least in tiers:
        best = answers.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("addr_id")).alias("a"))).alias("m"))
        own = left.join(best, "query_id").where(F.col("m.score") >= least)
        own = own.select("query_id", F.lit(name).alias("tier"), (-F.col("m.a")).alias("addr_id"), F.col("m.score").alias("score"))
        out = own if out is None else out.unionByName(own)
        left = left.join(own, "query_id", "left_anti")
    rest = left.select("query_id", F.lit("generated").alias("tier"), F.lit(None).cast("long").alias("addr_id"), F.lit(0.0).alias("score"))
    return out.unionByName(rest)


def better_of(first: DataFrame, second: DataFrame, pivot: float = 0.75) -> DataFrame:
    """A second answer (query_id, confidence, geocoded, address) replaces the first where that is under the pivot and the
    second is surer, or found on the map as the first was not."""
    other = second.select("query_id", *[F.col(c).alias(f"_{c}") for c in ("confidence", "geocoded", "address")])
    both = first.join(other, "query_id", "left")
    take = F.coalesce(
        (F.col("confidence") < pivot) & ((F.col("_confidence") > F.col("confidence")) | (F.col("_geocoded") & ~F.col("geocoded"))), F.lit(False)
    )
    pick = lambda c: F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return both.select("query_id", pick("confidence"), pick("geocoded"), pick("address"), take.alias("retried"))


def response(rows: DataFrame) -> DataFrame:
    """Corrections as the JSON objects of the service: query_id, payload."""
    names = [c for c in ("query", "status", "confidence", "address", "addr_id", "corrected", "changes", "record", "notes") if c in rows.columns]
    return rows.select("query_id", F.to_json(F.struct(*names)).alias("payload"))


def ordered_merge(sources: Sequence[DataFrame], text: str = "text", k: int = 10) -> DataFrame:
    """Suggestions (query_id, text, place) of several sources, the first source's first, each text once whatever its case."""
    rows = None
    for i, s in enumerate(sources):
        own = s.select("query_id", F.col(text).alias("text"), F.struct(F.lit(i).alias("source"), F.col("place").alias("place")).alias("at"))
        rows = own if rows is None else rows.unionByName(own)
    once = rows.groupBy("query_id", F.lower("text").alias("low")).agg(F.min(F.struct("at", "text")).alias("m"))
    rank = Window.partitionBy("query_id").orderBy("m.at", "low")
    return once.withColumn("place", F.row_number().over(rank).cast("long")).where(F.col("place") <= k).select("query_id", F.col("m.text").alias("text"), "place")


def live_suggest(prefixes: DataFrame, corpus: DataFrame, vocabulary: DataFrame, k: int = 8) -> DataFrame:
    """Per prefix (query_id, prefix): completions by prefix, then rows that share the corrected prefix's rare words.

    Queries of the same prefix are answered once.
    """
    from .retrieval import prefix_matches

    everyone = prefixes.select("query_id", "prefix")
    prefixes = staged(everyone.groupBy("prefix").agg(F.min("query_id").alias("query_id")), "prefixes")
    direct = prefix_matches(prefixes, corpus, k=k).withColumnRenamed("rank", "place")
    toks = prefixes.select("query_id", X.tokens(X.normalize_v1("prefix")).alias("toks"))
    fixed = spelling.correct_tokens(toks, "query_id", "toks", vocabulary).select("query_id", F.col("corrected").alias("toks"))
    wide = rare_candidates(fixed, corpus.select("addr_id", X.tokens(X.normalize_v1("text")).alias("toks")), pool=k)
    order = Window.partitionBy("query_id").orderBy(F.col("shared").desc(), "addr_id")
    wide = wide.join(corpus.select("addr_id", "text"), "addr_id").withColumn("place", F.row_number().over(order).cast("long"))
    answers = ordered_merge([direct, wide], k=k).join(prefixes, "query_id").select("prefix", "text", "place")
    return everyone.join(answers, "prefix").select("query_id", "text", "place")
