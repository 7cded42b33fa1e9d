"""Verification of corrected addresses: geocodes, the pincode dimension, trust in outside answers, reliable suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import similarity as S
from ..functions import text as X
from ..functions import vocabulary as V
from .matching import agree, building_gate, distinctive_share, meet, structured_gate

# Words that don't tell places apart, and the least scores and overlaps of a verified match.
COMMON_WORDS = (
    "road", "main", "cross", "stage", "layout", "block", "phase", "sector", "near", "behind", "opposite", "bengaluru",
    "bangalore", "karnataka", "india", "house", "flat", "no", "number", "street",
)
VERIFIED_LEAST, TOKEN_LEAST, INFORMATIVE_LEAST = 92.0, 0.65, 0.45
STRONG, SHOWN_LEAST, SHOWN_SURE, RANK_SURE = 0.80, 70.0, 78.0, 90.0


def merge_geocodes(found: Column, refined: Column, kept: tuple[str, ...] = ("formatted", "lat", "lon", "place_id", "precision")) -> Column:
    """A validator's answer over a geocoder's, field by field; what is in `kept` comes from the geocoder, if it has any."""
    names = ("formatted", "lat", "lon", "postal_code", "city", "state", "place_id", "precision")
    one = lambda n: F.coalesce(found[n], refined[n]) if n in kept else F.coalesce(refined[n], found[n])
    return F.when(found.isNull(), refined).when(refined.isNull(), found).otherwise(F.struct(*[one(n).alias(n) for n in names]))


def with_pincodes(rows: DataFrame, pincode: Column, dimension: DataFrame) -> DataFrame:
    """`rows` with pin_district and pin_state of their pincode, from a dimension (pincode, office, district, state).

    The dimension has one row a pincode, of which there are under a million.
    """
    known = dimension.select(
        F.col("pincode").alias("_pin"), F.col("district").alias("pin_district"), F.col("state").alias("pin_state")
    )
    return rows.withColumn("_asked", pincode).join(known, F.col("_asked") == F.col("_pin"), "left").withColumn(
        "pin_known", F.col("_pin").isNotNull()
    ).withColumn("pin_unknown", F.col("_asked").isNotNull() & F.col("_pin").isNull()).drop("_asked", "_pin")


def verify(rows: DataFrame, dimension: DataFrame, refined: Column | None = None) -> DataFrame:
    """`rows` (geocode, expected_pincode, expected_state) with geocoded, pincode_valid, consistent, district, state, notes.

    The expected pincode counts before the geocode's; the state of the pincode must be part of the geocode's and of the expected one.
    """
    second = refined if refined is not None else F.lit(None).cast(rows.schema["geocode"].dataType)
    merged = rows.withColumn("geocode", merge_geocodes(F.col("geocode"), second)).withColumn("_validated", second.isNotNull())
    out = with_pincodes(merged, F.coalesce("expected_pincode", "geocode.postal_code"), dimension)
    state = F.nullif(F.col("pin_state"), F.lit(""))
    apart = lambda c: F.coalesce(F.col("pin_known") & ~F.contains(F.lower(c), state), F.lit(False))
    by_geo, by_query = apart(F.col("geocode.state")), apart(F.col("expected_state"))
    notes = F.array_compact(
        F.array(
            F.when(F.col("geocode").isNull(), "geocode_miss"),
            F.when(F.col("_validated"), "validated"),
            F.when(F.col("pin_unknown"), "pincode_unknown"),
            F.when(by_geo, "pincode_state_disagrees_with_geocode"),
            F.when(by_query, "pincode_state_disagrees_with_expected"),
        )
    )
    return out.select(
        *merged.columns[:-1],
        F.col("geocode").isNotNull().alias("geocoded"),
        F.col("pin_known").alias("pincode_valid"),
        (~by_geo & ~by_query).alias("consistent"),
        F.col("pin_district").alias("district"),
        F.col("pin_state").alias("state"),
        notes.alias("notes"),
    )


def trusted(text: Column, outside: Column, pincode: Column, pincode_valid: Column, outside_pincode: Column) -> Column:
    """If an outside address is of the place that was asked for.

    Not so if a valid pincode differs, if most of the telling words are missing, if a numbered main, cross, block or
    stage has another number, or if a building's name is missing.
    """
    low, own = F.lower(outside), F.lower(text)
    other_pin = pincode_valid & outside_pincode.isNotNull() & (pincode != outside_pincode) & ~F.contains(low, pincode)
    words = F.filter(F.regexp_extract_all(own, F.lit("[a-z]+"), F.lit(0)), lambda t: (F.char_length(t) >= 5) & ~t.isin(*COMMON_WORDS))
    missing = F.size(F.filter(words, lambda t: ~F.contains(low, t)))
    most = (F.size(words) > 0) & (missing >= F.floor(F.size(words) / 2) + 1)
    number = F.regexp_extract(own, r"\b([0-9]{1,3})(?:st|nd|rd|th)?\s+(main|cross|block|stage)\b", 1)
    kind = F.regexp_extract(own, r"\b([0-9]{1,3})(?:st|nd|rd|th)?\s+(main|cross|block|stage)\b", 2)
    moved = (number != "") & ~F.regexp_like(low, F.concat(F.lit("\\b"), number, F.lit("\\w*\\s+"), kind))
    return ~(F.coalesce(other_pin, F.lit(False)) | most | moved | ~building_gate(text, outside))


def generated_address(text: Column, geocode: Column, pincode: Column, pincode_valid: Column, district: Column, state: Column) -> Column:
    """The outside address if it can be trusted and says more than a city; else the text for display, with city, state,
    pincode and country added where it lacks them."""
    sure = geocode.isNotNull() & geocode["formatted"].isNotNull() & trusted(text, geocode["formatted"], pincode, pincode_valid, geocode["postal_code"])
    full = F.size(F.split(F.coalesce(geocode["formatted"], F.lit("")), ",")) >= 4
    parts = (
        F.coalesce(F.nullif(district, F.lit("")), geocode["city"]),
        F.coalesce(F.nullif(state, F.lit("")), geocode["state"]),
        F.coalesce(pincode, geocode["postal_code"]),
        F.lit("india"),
    )
    out = X.with_missing(D.display(text), parts)
    return F.when(F.coalesce(sure & full, F.lit(False)), D.replace_house_number(X.strip_plus_code(geocode["formatted"]), X.house_number(text))).otherwise(out)


def structured_record(parsed: Column, geocode: Column, district: Column, state: Column) -> Column:
    """What is known of the parts: the geocode's, else the pincode's, else the text's."""
    low = lambda c: F.nullif(F.lower(c), F.lit(""))
    return F.struct(
        F.get(X.plain_numbers(parsed["tokens"]), F.lit(0)).alias("house_no"),
        parsed["road_anchor"].alias("street"),
        F.get(parsed["locality_anchors"], F.lit(0)).alias("area"),
        F.coalesce(low(geocode["city"]), low(district), parsed["city"]).alias("town"),
        F.coalesce(low(geocode["state"]), low(state), parsed["state"]).alias("state"),
        F.coalesce(parsed["pincode"], geocode["postal_code"]).alias("pincode"),
        F.lit("india").alias("country"),
    )


def strong_match(score: Column, q: Column, c: Column, q_text: Column, c_text: Column) -> Column:
    """A record that is the address asked for: score, structure, building and telling words."""
    return (score >= STRONG) & structured_gate(q, c) & building_gate(q_text, c_text) & (distinctive_share(q["tokens"], c["tokens"]) > 0.5)


def reliable_suggestion(probability: Column, q: Column, c: Column, q_text: Column, c_text: Column) -> Column:
    """If a suggestion of the reranker can be shown; the city may differ."""
    loose = lambda p: p.withField("city", F.lit(None).cast("string"))
    overlap = X.token_overlap(X.tokens(X.normalize_v2(q_text)), X.tokens(X.normalize_v2(c_text)))
    return (probability >= 0.40) & structured_gate(loose(q), loose(c)) & building_gate(q_text, c_text) & (overlap >= 0.20)


def reliable_display(rank_score: Column, shown: Column, q: Column, c: Column) -> Column:
    """As `reliable_suggestion`, by the scores of the fuzzy matcher."""
    plain = lambda p: F.filter(p["numbers"], lambda n: F.char_length(n) != 6)
    return (
        (shown >= SHOWN_LEAST)
        & meet(plain(q), plain(c))
        & agree(q["pincode"], c["pincode"])
        & agree(q["road_anchor"], c["road_anchor"])
        & meet(q["locality_anchors"], c["locality_anchors"])
        & ((rank_score >= RANK_SURE) | (shown >= SHOWN_SURE))
    )


def verified_matches(pairs: DataFrame, street: Column, other_street: Column) -> DataFrame:
    """Of candidate pairs (query_id, addr_id, q_text, c_text, q, c, record) per query the best by token ratios, if it passes
    all tests: ratio, token overlap, street words, street names, informative tokens, and the record's own place.

    `record` has pincode, state, town, district, in normal form, null where unknown.
    """
    best = Window.partitionBy("query_id").orderBy(F.col("verification_score").desc(), "addr_id")
    score = F.greatest(S.token_sort_ratio("q_text", "c_text"), S.token_set_ratio("q_text", "c_text"))
    top = pairs.withColumn("street_q", street).withColumn("street_c", other_street).withColumn("verification_score", score)
    top = top.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")
    own, other = F.array_distinct(X.tokens("q_text")), F.array_distinct(X.tokens("c_text"))
    has = lambda toks, names: F.exists(toks, lambda t: t.isin(*names))
    overlap = X.token_overlap(own, other)
    told = F.col("q.informative_tokens")
    informative = F.when(F.size(told) == 0, 1.0).otherwise(X.token_overlap(told, F.col("c.informative_tokens")))
    town = F.col("record.town").isNull() & F.col("record.district").isNull()
    at = F.coalesce(F.col("q.city") == F.col("record.town"), F.lit(False)) | F.coalesce(F.col("q.city") == F.col("record.district"), F.lit(False))
    passes = (
        (F.col("verification_score") >= VERIFIED_LEAST)
        & ((F.size(own) < 6) | (overlap >= TOKEN_LEAST))
        & (~has(own, V.ROAD_WORDS) | has(other, V.ROAD_WORDS))
        & (~has(own, ("road", "rd")) | has(other, ("road", "rd")))
        & agree(F.col("street_q"), F.col("street_c"))
        & ((F.size(told) < 3) | (informative >= INFORMATIVE_LEAST))
        & agree(F.col("q.pincode"), F.col("record.pincode"))
        & agree(F.col("q.state"), F.col("record.state"))
        & (F.col("q.city").isNull() | town | at)
    )
    return top.where(passes).select(
        "query_id",
        "addr_id",
        F.round("verification_score", 2).alias("verification_score"),
        F.round(overlap, 3).alias("token_overlap"),
        F.round(informative, 3).alias("informative_overlap"),
    )
