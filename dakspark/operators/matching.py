"""Similarity of blocked pairs, the gates on a match, confidence and status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import similarity as S
from ..functions import text as X
from ..functions import vocabulary as V

#: Weights of token_sort, token_set, partial, ratio.
WEIGHTS = (0.30, 0.25, 0.20, 0.25)


def base_score(a: Column, b: Column) -> Column:
    parts = (S.token_sort_ratio(a, b), S.token_set_ratio(a, b), S.partial_ratio(a, b), S.indel_ratio(a, b))
    return sum(w * p for w, p in zip(WEIGHTS, parts))


def agree(a: Column, b: Column) -> Column:
    """Equal, or unknown on a side."""
    return a.isNull() | b.isNull() | (a == b)


def meet(a: Column, b: Column) -> Column:
    """Something in common, or nothing on a side."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def structured_gate(q: Column, c: Column) -> Column:
    """Pincode, city and road equal where both are known; numbers and localities meet; sub-anchors agree.

    A query's number that ends the candidate's pincode is not asked for, but one that the candidate has as well meets it.
    """
    plain = lambda p: F.filter(p["numbers"], lambda n: F.char_length(n) != 6)
    unasked = F.size(D.real_house_numbers(q["numbers"], c["pincode"])) == 0
    subs = F.forall(
        F.map_keys(q["sub_anchors"]), lambda k: agree(c["sub_anchors"][k], q["sub_anchors"][k])
    )
    return (
        agree(q["pincode"], c["pincode"])
        & agree(q["city"], c["city"])
        & agree(q["road_anchor"], c["road_anchor"])
        & (unasked | meet(plain(q), plain(c)))
        & meet(q["locality_anchors"], c["locality_anchors"])
        & subs
    )


def building_gate(query: Column, candidate: Column) -> Column:
    """A building's name, unless generic, must be in the candidate."""
    name = F.regexp_extract(F.lower(query), rf"\b([a-z]{{4,}})\s+(?:{'|'.join(V.BUILDING_WORDS)})\b", 1)
    return (name == "") | name.isin(*V.GENERIC_BRANDS) | F.contains(F.lower(candidate), name)


def distinctive_share(query: Column, candidate: Column) -> Column:
    """The share of the query's telling tokens that the candidate has; 1 without any."""
    own = F.filter(query, lambda t: (F.char_length(t) >= 4) & ~t.rlike("^[0-9]+$") & ~t.isin(*V.STOP_WORDS))
    return F.when(F.size(own) == 0, 1.0).otherwise(X.token_overlap(own, candidate))


def fuzzy_share(pairs: DataFrame, key: Sequence[str], query: str, candidate: str, least: float = 85.0) -> DataFrame:
    """As `distinctive_share`, where a token also counts that is like one of the candidate's: rows (key, share).

    Only tokens that the candidate lacks are held against its tokens of a like length, in one pass over pairs.
    """
    telling = F.filter(query, lambda t: (F.char_length(t) >= 4) & ~t.rlike("^[0-9]+$") & ~t.isin(*V.STOP_WORDS))
    rows = pairs.select(*key, F.array_distinct(telling).alias("own"), F.array_distinct(F.filter(candidate, lambda t: F.char_length(t) >= 4)).alias("other"))
    lost = rows.select(*key, "other", F.explode(F.array_except("own", "other")).alias("a"))
    near = lost.select(*key, "a", F.explode("other").alias("b")).where(F.abs(F.char_length("a") - F.char_length("b")) <= 2)
    again = near.where(S.indel_ratio("a", "b") >= least).groupBy(*key).agg(F.countDistinct("a").alias("again"))
    exact = F.size(F.array_intersect("own", "other"))
    share = F.when(F.size("own") == 0, 1.0).otherwise((exact + F.coalesce("again", F.lit(0))) / F.size("own"))
    return rows.join(again, list(key), "left").select(*key, F.round(share, 6).alias("share"))


def geo_boosted(base: Column, q: Column, c: Column) -> Column:
    """The base score with what agrees added and what contradicts taken off; a wrong pincode or road caps it at 69."""
    differs = lambda k: q[k].isNotNull() & c[k].isNotNull() & (q[k] != c[k])
    same = lambda k: q[k].isNotNull() & (q[k] == c[k])
    plain = lambda p: F.filter(p["numbers"], lambda n: F.char_length(n) != 6)
    number_off = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
    on = lambda test, x: F.when(test, x).otherwise(0.0)
    score = (
        base
        + on(same("city"), 18)
        + 12 * F.least(F.lit(2), F.size(F.array_intersect(q["locality_anchors"], c["locality_anchors"])))
        + on(F.arrays_overlap(q["numbers"], c["numbers"]), 5)
        + 5 * X.token_overlap(q["informative_tokens"], c["informative_tokens"])
        + on(same("road_anchor"), 25)
        + on(same("pincode"), 12)
        - on(differs("city"), 25)
        - on(number_off(q["numbers"], c["numbers"]), 20)
        - on(number_off(plain(q), plain(c)), 20)
        - on(differs("pincode"), 28)
        - F.when(differs("road_anchor"), 30.0).when(q["road_anchor"].isNotNull() & c["road_anchor"].isNull(), 20.0).otherwise(0.0)
        - on(~meet(q["locality_anchors"], c["locality_anchors"]), 22)
    )
    held = F.greatest(F.lit(0.0), F.least(F.lit(99.9), score))
    hard = differs("pincode") | differs("road_anchor")
    return F.bround(F.when(hard, F.least(held, F.lit(69.0))).otherwise(held), 1)


def display_similarity(sorted_ratio: Column, set_ratio: Column, q: Column, c: Column) -> Column:
    """The better token ratio, less what contradicts: 0 to 100."""
    differs = lambda k: q[k].isNotNull() & c[k].isNotNull() & (q[k] != c[k])
    on = lambda test, x: F.when(test, x).otherwise(0)
    off = (
        on(~meet(q["numbers"], c["numbers"]), 18)
        + on(differs("pincode"), 20)
        + on(differs("city"), 12)
        + on(differs("road_anchor"), 25)
        + on(~meet(q["locality_anchors"], c["locality_anchors"]), 15)
    )
    return F.bround(F.greatest(F.lit(0.0), F.greatest(sorted_ratio, set_ratio) - off), 1)


def status(confidence: Column, geocoded: Column, found: Column | None = None) -> Column:
    out = F.when(geocoded & (confidence >= 0.90), "verified")
    if found is not None:
        out = out.when(found, "found_in_database")
    return out.when(confidence >= 0.90, "high_confidence").when(confidence >= 0.65, "medium_confidence").otherwise("low_confidence")


def final_confidence(score: Column, precision: Column, pin_valid: Column, consistent: Column, pin_agrees: Column) -> Column:
    """In this order: precision or a discount, a valid pincode, an inconsistent state, agreement of pincodes.

    A null precision is a failed geocode; a null agreement is an unknown pincode.
    """
    up = lambda x: F.least(F.lit(1.0), x)
    c = F.when(precision.isNotNull(), up(score + 0.05 * precision)).otherwise(score * 0.9)
    c = F.when(pin_valid, up(c + 0.05)).otherwise(c)
    c = F.when(pin_valid & ~consistent, c * 0.7).otherwise(c)
    c = F.when(pin_agrees, up(c + 0.05)).when(~pin_agrees, c * 0.85).otherwise(c)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def generated_confidence(pin_valid: Column, consistent: Column, geocoded: Column, have: Column, best: Column) -> Column:
    """Of an address that no record confirms: `have` of city, state and pincode are known, `best` is the nearest record's score."""
    on = lambda test, x: F.when(test, x).otherwise(0.0)
    total = 0.30 + on(pin_valid, 0.20) + on(pin_valid & consistent, 0.10) + on(geocoded, 0.20) + 0.05 * have + 0.10 * best
    return F.least(F.lit(0.95), total)


def match_addresses(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per query (query_id, text, parsed) its best address, whether the gates allow it, confidence and status."""
    from .correction import ranked_matches

    best = ranked_matches(queries, corpus, top=1)
    gate = structured_gate(F.col("q"), F.col("c")) & building_gate(F.col("q_text"), F.col("c_text"))
    share = distinctive_share(F.col("q")["tokens"], F.col("c")["tokens"])
    found = best.select("query_id", "addr_id", "score", gate.alias("allowed"), share.alias("share"), F.col("c_text").alias("best_address"))
    confidence = F.when(F.col("allowed"), F.col("score") / 100).otherwise(F.col("score") / 200)
    return (
        queries.select("query_id", F.col("text").alias("query"))
        .join(found, "query_id", "left")
        .withColumn("confidence", F.coalesce(F.round(confidence, 4), F.lit(0.0)))
        .withColumn("status", status(F.col("confidence"), F.lit(False), F.col("allowed") & (F.col("score") >= 80) & (F.col("share") > 0.5)))
    )
