"""Retrieval: BM25 over postings, exact inner products, prefixes, and fusion of their scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import staged

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(docs: DataFrame, key: str, toks: str) -> DataFrame:
    """Rows (key, term, tf, len) of the documents' tokens."""
    terms = docs.select(key, F.size(toks).alias("len"), F.explode(toks).alias("term"))
    return terms.groupBy(key, "term", "len").agg(F.count("*").alias("tf"))


def term_weights(posted: DataFrame, docs: DataFrame, toks: str) -> DataFrame:
    """Per term its idf: ln(N - n + 0.5) - ln(n + 0.5), negative ones set to EPSILON of the mean; the mean length, n and N."""
    stats = docs.agg(F.count("*").alias("docs"), F.avg(F.size(toks)).alias("mean_len"))
    df = posted.groupBy("term").agg(F.count("*").alias("n"))
    idf = df.crossJoin(F.broadcast(stats)).withColumn(  # one row of statistics
        "raw", F.log(F.col("docs") - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)
    )
    mean = idf.agg(F.avg("raw").alias("mean_idf"))
    return idf.crossJoin(F.broadcast(mean)).select(
        "term", "mean_len", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"), "n", "docs"
    )


def term_score() -> Column:
    """What a posting (tf, len) of a term (idf, mean_len) adds to a document's score, asked for once."""
    return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))


def bm25(queries: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Scores (query_id, key, score) of queries (query_id, terms) against docs (key, toks), by shared terms."""
    posted = staged(postings(docs, key, "toks"), "postings")
    weights = term_weights(posted, docs, "toks")
    asked = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    # Only terms that are asked for reach the wide join.
    wanted = weights.join(asked.select("term").distinct(), "term", "left_semi")
    return (
        posted.join(wanted, "term")
        .join(asked, "term")
        .groupBy("query_id", key)
        .agg(F.sum(F.col("qtf") * term_score()).alias("score"))
    )


def top_k(scores: DataFrame, k: int, key: str, score: str = "score", digits: int = 6) -> DataFrame:
    """The k best per query; scores that agree to `digits` places are ordered by key."""
    rounded = scores.withColumn(score, F.round(score, digits))
    rank = Window.partitionBy("query_id").orderBy(F.col(score).desc(), key)
    return rounded.withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") <= k)


#: A term that one document in so many has is common: its documents are scored by what they hold, not one by one.
COMMON_SHARE = 100


def bm25_top_k(queries: DataFrame, docs: DataFrame, k: int, key: str = "doc_id", digits: int = 6) -> DataFrame:
    """`top_k` of `bm25`, of documents (key, toks) with keys of their own, without the pairs that can't be among the k best.

    Documents that hold the same of the common terms asked for are one group, which a query scores once.  A document
    without a rarer term of the query has its group's score, so of a group only its k smallest keys can be among the k
    best, and only of the best groups that have k documents together.  All documents with a rarer term are scored by
    themselves; that term's idf is above zero, so they are never worse than their group.
    """
    posted = staged(postings(docs, key, "toks"), "postings")
    asked = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = staged(asked, "asked")
    wanted = term_weights(posted, docs, "toks").join(asked.select("term").distinct(), "term", "left_semi")
    wanted = staged(wanted.withColumn("common", F.col("n") * COMMON_SHARE >= F.col("docs")), "weights")
    held = posted.join(wanted, "term").withColumn("w", term_score())

    own = held.where("common").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("holds"))
    own = staged(own, "holds")
    groups = staged(own.groupBy("holds").agg(F.min(key).alias("group")), "groups")
    member = staged(own.join(groups, "holds").select(key, "group"), "members")
    place = Window.partitionBy("group").orderBy(key)
    first = member.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k).drop("_r")

    bag = asked.join(wanted.where("common").select("term"), "term").groupBy("query_id")
    bag = staged(bag.agg(F.array_sort(F.collect_list(F.struct("term", "qtf"))).alias("asks")), "bags")
    bags = bag.groupBy("asks").agg(F.min("query_id").alias("bag"))
    own_bag = staged(bag.join(bags, "asks").select("query_id", "bag"), "bag_of")
    left = bags.select("bag", F.explode("asks").alias("a")).select("bag", "a.*")
    right = groups.select("group", F.explode("holds").alias("h")).select("group", "h.*")
    base = staged(left.join(right, "term").groupBy("bag", "group").agg(F.sum(F.col("qtf") * F.col("w")).alias("base")), "base")

    sizes = first.groupBy("group").agg(F.count("*").alias("size"))
    rated = base.withColumn("r", F.round("base", digits)).join(sizes, "group")
    better = Window.partitionBy("bag").orderBy(F.col("r").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rated = rated.withColumn("upto", F.sum("size").over(better)).withColumn("same", F.sum("size").over(Window.partitionBy("bag", "r")))
    kept = rated.where(F.col("upto") - F.col("same") < k).select("bag", "group", "base", "r")
    best = Window.partitionBy("bag").orderBy(F.col("r").desc(), key)
    lists = kept.join(first, "group").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("bag", key, "base")
    plain = own_bag.join(lists, "bag").select("query_id", key, F.col("base").alias("score"))

    extra = asked.join(held.where("NOT common"), "term").groupBy("query_id", key).agg(F.sum(F.col("qtf") * F.col("w")).alias("extra"))
    extra = extra.join(own_bag, "query_id", "left").join(member, key, "left").join(base, ["bag", "group"], "left")
    extra = extra.select("query_id", key, (F.coalesce("base", F.lit(0.0)) + F.col("extra")).alias("score"))
    both = plain.unionByName(extra).groupBy("query_id", key).agg(F.max("score").alias("score"))
    return top_k(both, k, key, digits=digits)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


#: Query vectors that are sent to the corpus's partitions at a time, and parts of the corpus that keep their own best.
QUERY_BLOCK, PARTS = 2_000, 256


def dense_scores(queries: DataFrame, corpus: DataFrame, key: str = "vec_id") -> DataFrame:
    """Inner products of a stated query set (query_id, vector) with every row of corpus (key, embedding).

    Exact search: the queries are counted and sent to the corpus's partitions in blocks of QUERY_BLOCK.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else queries
        both = corpus.crossJoin(F.broadcast(own)).select("query_id", key, inner_product(F.col("vector"), F.col("embedding")).alias("score"))
        out = both if out is None else out.unionByName(both)
    return out


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", digits: int = 6) -> DataFrame:
    """The k best of `dense_scores` per query.  Each part of the corpus keeps its own k best as one small array per query,
    summed before the shuffle, so all pairs never leave their tasks."""
    scores = dense_scores(queries, corpus, key).withColumn("score", F.round("score", digits))
    part = F.pmod(F.xxhash64(key), F.lit(PARTS))
    own = Window.partitionBy("query_id", "part").orderBy(F.col("score").desc(), key)
    few = scores.withColumn("part", part).withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= k).drop("_r", "part")
    return top_k(few, k, key, digits=digits)


def shared_top_k(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", digits: int = 6) -> DataFrame:
    """As `dense_top_k`, for vectors that many rows share: each distinct vector of either side is scored once, and of the
    rows of a vector only the k smallest keys can be among the k best."""
    asked = queries.groupBy("vector").agg(F.min("query_id").alias("bag"))
    asked, vectors = staged(asked, "asked"), staged(corpus.groupBy("embedding").agg(F.min(key).alias("group")), "vectors")
    place = Window.partitionBy("embedding").orderBy(key)
    first = corpus.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k).drop("_r")
    first = first.join(vectors, "embedding").select(key, "group")
    scores = dense_scores(asked.withColumnRenamed("bag", "query_id"), vectors, "group").withColumn("score", F.round("score", digits))
    sizes = first.groupBy("group").agg(F.count("*").alias("size"))
    better = Window.partitionBy("query_id").orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rated = staged(scores, "scores").join(sizes, "group").withColumn("upto", F.sum("size").over(better))
    rated = rated.withColumn("same", F.sum("size").over(Window.partitionBy("query_id", "score")))
    kept = rated.where(F.col("upto") - F.col("same") < k).select("query_id", "group", "score")
    best = top_k(kept.join(first, "group").drop("group"), k, key, digits=digits).withColumnRenamed("query_id", "bag")
    return queries.join(asked, "vector").select("query_id", "bag").join(best, "bag").select("query_id", key, "score", "rank")


def prefix_matches(prefixes: DataFrame, corpus: DataFrame, per_prefix: int = 50, k: int = 10) -> DataFrame:
    """Per prefix (query_id, prefix): the first k ids of texts, without repeats, of which a word begins with it.

    Words are keyed by their first letters, so the join is an equi-join on a short key, and queries of the same prefix
    are answered once.
    """
    size = 3
    word = corpus.select("addr_id", F.lower("text").alias("text"), F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word"))
    keyed = word.withColumn("key", F.substring("word", 1, size))
    queries = prefixes.select("query_id", F.lower("prefix").alias("prefix")).where(F.char_length("prefix") >= size)
    asked = queries.select("prefix", F.substring("prefix", 1, size).alias("key")).distinct()
    hits = asked.join(keyed, "key").where(F.startswith("word", F.col("prefix")))
    once = hits.groupBy("prefix", "text").agg(F.min("addr_id").alias("addr_id"))
    rank = Window.partitionBy("prefix").orderBy("addr_id")
    best = once.withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") <= min(k, per_prefix))
    return queries.join(best, "prefix").select("query_id", "text", "addr_id", "rank")


def min_max(scores: DataFrame, score: str = "score") -> DataFrame:
    """Per query scores from 0 to 1; all 1 where they don't differ."""
    w = Window.partitionBy("query_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return scores.withColumn(score, F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low)))


def fuse(sources: Mapping[str, DataFrame], weights: Mapping[str, float], key: str) -> DataFrame:
    """The weighted sum of the sources' min-max scores (query_id, key, score); a missing score counts 0."""
    parts = None
    for name, frame in sources.items():
        own = min_max(frame).select("query_id", key, (F.col("score") * weights[name]).alias("score"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy("query_id", key).agg(F.sum("score").alias("score"))


def max_normal(scores: DataFrame, score: str = "score") -> DataFrame:
    """Per query scores over the largest one."""
    return scores.withColumn(score, F.col(score) / (F.max(score).over(Window.partitionBy("query_id")) + 1e-9))


# Weights of lexical, dense and fuzzy scores, and the least fuzzy score that counts.
WEIGHTED, FUZZY_LEAST = {"bm25": 0.30, "dense": 0.50, "fuzzy": 0.20}, 0.55


def weighted_fusion(bm25_scores: DataFrame, dense: DataFrame, fuzzy: DataFrame, key: str) -> DataFrame:
    """Lexical scores over their largest, dense ones as they are, fuzzy ones above the least: the weighted sum per query and key."""
    parts = (
        max_normal(bm25_scores).select("query_id", key, (F.col("score") * WEIGHTED["bm25"]).alias("score")),
        dense.select("query_id", key, (F.col("score") * WEIGHTED["dense"]).alias("score")),
        fuzzy.where(F.col("score") > FUZZY_LEAST).select("query_id", key, (F.col("score") * WEIGHTED["fuzzy"]).alias("score")),
    )
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("query_id", key).agg(F.sum("score").alias("score"))


def union_distinct(sources: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Candidates of all sources, each once, with the sources that have it."""
    rows = None
    for name, frame in sources.items():
        own = frame.select("query_id", key, F.lit(name).alias("source"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("query_id", key).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def merge_best(first: DataFrame, second: DataFrame, key: str, k: int) -> DataFrame:
    """Both lists of candidates, the larger score of each, the k best per query."""
    both = first.select("query_id", key, "score").unionByName(second.select("query_id", key, "score"))
    return top_k(both.groupBy("query_id", key).agg(F.max("score").alias("score")), k, key)


def merge_live(candidates: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Candidates with scores (query_id, key, scores: map) and a live source (query_id, key, score): a row of both has the
    live score beside its own ones, a row of one has that one's."""
    own = live.select("query_id", key, F.col("score").alias("_live"))
    none = F.create_map().cast("map<string,double>")
    added = F.when(F.col("_live").isNotNull(), F.map_from_arrays(F.array(F.lit("sql")), F.array("_live"))).otherwise(none)
    kept = F.map_filter(F.coalesce("scores", none), lambda k, _: k != "sql")
    return candidates.join(own, ["query_id", key], "full").select("query_id", key, F.map_concat(kept, added).alias("scores"))


def top_by_strategy(scored: DataFrame, depths: Mapping[str, int], key: str) -> DataFrame:
    """Candidates that are among the first of any strategy, a column of scores each with its depth: one window a
    strategy over the same partitioning, so one shuffle; each candidate once."""
    rows, test = scored, F.lit(False)
    for i, (name, depth) in enumerate(depths.items()):
        order = Window.partitionBy("query_id").orderBy(F.col(name).desc(), key)
        rows = rows.withColumn(f"_r{i}", F.row_number().over(order))
        test = test | (F.col(f"_r{i}") <= depth)
    return rows.where(test).drop(*[f"_r{i}" for i in range(len(depths))])


def pincode_bucket(scores: DataFrame, queries: DataFrame, corpus: DataFrame, key: str, seed: int = 200) -> DataFrame:
    """Scores (query_id, key, score) of rows within the query's pincode; a query with a pincode of the corpus, but no
    such score, gets the bucket's first rows with score 1; queries without a pincode keep all their scores."""
    pins = queries.where(F.col("pincode").isNotNull()).select("query_id", "pincode")
    rows = corpus.select(key, F.col("pincode").alias("_own"))
    free = scores.join(pins, "query_id", "left_anti")
    held = scores.join(pins, "query_id").join(rows, key).where(F.col("pincode") == F.col("_own")).select("query_id", key, "score")
    empty = pins.join(held.select("query_id").distinct(), "query_id", "left_anti")
    order = Window.partitionBy("pincode").orderBy(key)
    first = corpus.select(key, "pincode").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= seed)
    seeds = empty.join(first, "pincode").select("query_id", key, F.lit(1.0).alias("score"))
    return free.select("query_id", key, "score").unionByName(held).unionByName(seeds)


def hybrid(bm25_scores: DataFrame, dense: DataFrame, queries: DataFrame, corpus: DataFrame, key: str, k: int = 200) -> DataFrame:
    """Lexical and dense scores, 4k of each, within the query's pincode where it has one, min-max fused, the k best."""
    queries, corpus = staged(queries, "queries"), staged(corpus, "corpus")
    best = {name: staged(top_k(s, 4 * k, key).drop("rank"), name) for name, s in (("bm25", bm25_scores), ("dense", dense))}
    few = {name: pincode_bucket(s, queries, corpus, key) for name, s in best.items()}
    return top_k(fuse(few, {"bm25": 1.0, "dense": 1.0}, key), k, key)


def keyword_retrieval(queries: DataFrame, corpus: DataFrame, columns: list[str], rows: int = 200, least: float = 60.0) -> DataFrame:
    """Per query (query_id, text, terms) the first rows by id of the corpus (addr_id, text, columns) that hold a term in any
    column, scored by ratio; those of `least` and more, over 100.  Terms meet postings in an equi-join."""
    from ..functions import similarity as S
    from ..functions import text as X

    whole = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    posted = corpus.select("addr_id", F.explode(F.array_distinct(X.tokens(X.normalize_blocking(whole)))).alias("term"))
    hits = queries.select("query_id", F.explode("terms").alias("term")).join(posted, "term").select("query_id", "addr_id").distinct()
    order = Window.partitionBy("query_id").orderBy("addr_id")
    few = hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= rows).drop("_r")
    pairs = few.join(queries.select("query_id", F.col("text").alias("q_text")), "query_id").join(
        corpus.select("addr_id", F.col("text").alias("c_text")), "addr_id"
    )
    scored = pairs.withColumn("ratio", S.indel_ratio("q_text", "c_text")).where(F.col("ratio") >= least)
    return scored.select("query_id", "addr_id", F.round(F.col("ratio") / 100, 6).alias("score"))
