"""Candidate generation: terms and geographic anchors of a query, and cascades of equality and keyword blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..sources.writers import staged


def blocking_terms(text: Column | str, cities: Sequence[str] = V.CITIES) -> Column:
    """Up to two cities, two numbers and six words of four letters or more, each once, in order."""
    toks = X.tokens(X.normalize_blocking(text))
    pick = lambda test, n: F.slice(F.array_distinct(F.filter(toks, test)), F.lit(1), F.lit(n))
    return F.struct(
        pick(lambda t: t.isin(*cities), 2).alias("cities"),
        pick(lambda t: t.rlike("^[0-9]+$"), 2).alias("numbers"),
        pick(
            lambda t: (F.char_length(t) >= 4) & ~t.rlike("^[0-9]+$") & ~t.isin(*cities) & ~t.isin(*V.STOP_WORDS), 6
        ).alias("words"),
    )


def geo_anchors(text: Column | str, cities: Sequence[str] = V.CITIES) -> Column:
    """The last city, the last pincode, the state and the street word of a query."""
    norm = X.normalize_blocking(text)
    toks = X.tokens(norm)
    pins = F.filter(toks, lambda t: t.rlike("^[0-9]{6}$"))
    return F.struct(
        X.last_in(toks, cities).alias("city"),
        F.get(F.reverse(pins), F.lit(0)).alias("pincode"),
        X.detect_state(norm, toks).alias("state"),
        street_anchor(toks, cities).alias("street"),
    )


def street_anchor(toks: Column, cities: Sequence[str] = V.CITIES) -> Column:
    """The longest word of five letters before a road or locality word, else of seven; the first of equals."""
    word = lambda t, n: t.rlike(f"^[a-z]{{{n},}}$") & ~t.isin(*cities) & ~t.isin(*V.STOP_WORDS)
    near = F.filter(toks, lambda t, i: word(t, 5) & F.get(toks, i + 1).isin(*V.ROAD_WORDS, *V.LOCALITY_WORDS))
    wide = F.filter(toks, lambda t: word(t, 7) & ~t.isin(*V.ROAD_WORDS, *V.LOCALITY_WORDS))
    longest = lambda a: F.array_max(
        F.transform(a, lambda t, i: F.struct(F.char_length(t).alias("n"), (-i).alias("i"), t.alias("t")))
    )["t"]
    return F.coalesce(longest(near), longest(wide))


def match_count(columns: Sequence[str], terms: Column) -> Column:
    """How many of the terms occur in any of the columns, letter case aside."""
    whole = F.concat_ws("\u0001", *[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    return F.size(F.filter(terms, lambda t: F.contains(whole, t)))


def keyword_block(queries: DataFrame, corpus: DataFrame, top: int = 200) -> DataFrame:
    """Per query (query_id, terms): the addresses (addr_id, text) with the most terms as words.

    Two terms are needed if there are two or more; the highest count first, then the lowest id.  Rows that hold the
    same of the terms asked for are alike to every query, so of each such kind the first `top` are enough, and queries
    of the same terms are answered once: joins grow with the kinds of rows and of queries, not with rows times queries.
    """
    asked = queries.where(F.size("terms") > 0).select("query_id", F.array_sort("terms").alias("terms"))
    kinds = asked.select("terms").distinct()
    wanted = kinds.select(F.explode("terms").alias("term")).distinct()
    postings = corpus.select("addr_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    alike = postings.join(wanted, "term").groupBy("addr_id").agg(F.array_sort(F.collect_list("term")).alias("held"))
    first = Window.partitionBy("held").orderBy("addr_id")
    few = alike.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= top).drop("_r")
    few = staged(few, "kinds")
    terms = kinds.select("terms", F.least(F.size("terms"), F.lit(2)).alias("least"), F.explode("terms").alias("term"))
    held = few.select("held").distinct().select("held", F.explode("held").alias("term"))
    counted = terms.join(held, "term").groupBy("terms", "held", "least").agg(F.count("*").alias("block_score"))
    rank = Window.partitionBy("terms").orderBy(F.col("block_score").desc(), "addr_id")
    answers = (
        counted.where("block_score >= least")
        .join(few, "held")
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= top)
        .select("terms", "addr_id", "block_score", F.col("rank").cast("long").alias("rank"))
    )
    return asked.join(answers, "terms").select("query_id", "addr_id", "block_score", "rank")


#: The order in which geographic blocks are tried.
CASCADE = (("pincode", "city", "street"), ("city", "street"), ("pincode", "city"), ("pincode",), ("city",))
#: The full cascade, with the state; its last pass is `keyword_block`.
FULL_CASCADE = (
    ("pincode", "city", "state", "street"), ("city", "state", "street"), ("city", "street"), ("pincode", "city", "state"),
    ("city", "state"), ("pincode",), ("city",),
)


def geo_cascade(queries: DataFrame, corpus: DataFrame, cascade: Sequence[Sequence[str]] = CASCADE) -> DataFrame:
    """Per query the addresses of the first block of the cascade that has any: (query_id, tier, addr_id).

    Each tier is an equi-join of the queries that no earlier tier answered.
    """
    left, out = queries, None
    for tier, keys in enumerate(cascade, 1):
        usable = left.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).select("query_id", *keys)
        found = usable.join(corpus, list(keys)).select("query_id", F.lit(tier).alias("tier"), "addr_id")
        out = found if out is None else out.unionByName(found)
        if tier < len(cascade):
            left = left.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return out


def full_cascade(queries: DataFrame, corpus: DataFrame, top: int = 2000, keywords: bool = True) -> DataFrame:
    """Per query (query_id, pincode, city, state, street, terms) the rows of the first pass that has any, the first `top`
    by id: (query_id, tier, addr_id).  Seven geographic passes, then words.

    A city's block is large and asked for by many queries.  So each block's first rows are taken once, before the join,
    and a query meets at most `top` rows.
    """
    left, out = queries, None
    for tier, keys in enumerate(FULL_CASCADE, 1):
        first = Window.partitionBy(*keys).orderBy("addr_id")
        block = corpus.select("addr_id", *keys).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= top).drop("_r")
        usable = left.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).select("query_id", *keys)
        found = usable.join(block, list(keys)).select("query_id", F.lit(tier).alias("tier"), "addr_id")
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("query_id").distinct(), "query_id", "left_anti")
    if keywords:
        words = keyword_block(left.select("query_id", "terms"), corpus.select("addr_id", "text"), top)
        out = out.unionByName(words.select("query_id", F.lit(len(FULL_CASCADE) + 1).alias("tier"), "addr_id"))
    return out


def geo_then_keywords(queries: DataFrame, corpus: DataFrame, least: int = 10, top: int = 2000) -> DataFrame:
    """All rows of the query's city and pincode; for queries with under `least` of them, the first `top` rows that share its
    words as well."""
    geo = queries.join(corpus.select("addr_id", "pincode", "city"), ["pincode", "city"]).select("query_id", "addr_id")
    many = geo.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rest = queries.join(many, "query_id", "left_anti").select("query_id", "terms")
    words = keyword_block(rest, corpus.select("addr_id", "text"), top).select("query_id", "addr_id")
    return geo.unionByName(words).distinct()


def substring_match(columns: Sequence[str], terms: Sequence[str]) -> Column:
    """If any of the terms is in any of the columns, letter case and nulls aside."""
    out = F.lit(False)
    for c in columns:
        low = F.lower(F.coalesce(F.col(c), F.lit("")))
        for t in terms:
            out = out | F.contains(low, F.lit(t.lower()))
    return out
