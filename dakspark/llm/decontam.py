"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed, GRAM consecutive ones to a k-gram; of each SPAN consecutive k-grams the smallest is
kept as a fingerprint.  With GRAM + SPAN - 1 = WINDOW, any shared run of WINDOW words shares one.
Training and benchmark fingerprints are joined, and a hit is extended: the windows of the item that
hold the shared k-gram are compared word by word with the document's words around it.  Where a k-gram
recurs within SPAN, document and item may keep different ones, so items keep all of these.  Items under
WINDOW words are one window each; their first min(GRAM, length) words are looked up at every place.

The benchmark's fingerprints are broadcast only if their counted rows fit a limit, together with
their words; beyond it both sides are shuffled by fingerprint, with the document's words around the
k-gram alone, not its text.

Defined cases: null text has no words; items with null id or without words match nothing; items that
repeat an id count once; documents that repeat an id, or have none, are told apart by their text;
empty tables leave all documents clean; a text of any length is looked through in blocks; further
columns, whatever their names, stay with `drop_contaminated` and are ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, maybe_broadcast

WINDOW, GRAM = 13, 7
SPAN = WINDOW - GRAM + 1
#: A text's words are looked through in blocks of so many, which overlap by WINDOW - 1.
BLOCK = 256
#: Fixed value: what lies between words.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Before lower-casing.
ANY_CASE_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def count_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), ANY_CASE_GAP), "")).cast("long")


def grams(hashes: str, k: int) -> Column:
    """Hashes of all runs of k words of the column `hashes`, by their first place."""
    firsts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - k + 1, F.lit(0)))
    return F.transform(firsts, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, k)]))


#: A k-gram's hash keeps its upper bits; the lower PLACE_BITS hold its place, modulo their range.
PLACE_BITS = 3


def placed(hashed: str) -> Column:
    mask = (1 << PLACE_BITS) - 1
    return F.transform(
        hashed, lambda x, i: x.bitwiseAND(F.lit(~mask).cast("long")).bitwiseOR(i.cast("long").bitwiseAND(F.lit(mask)))
    )


def window_minima(values: str) -> Column:
    """The smallest of each `SPAN` consecutive values; the last windows are shorter, which adds prints only."""
    return F.transform(values, lambda x, i: F.least(x, *[F.get(values, i + j) for j in range(1, SPAN)]))


def changes(minima: str) -> Column:
    """The windows (from 0) whose smallest k-gram is not that of the window before."""
    return F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(minima) - 1, F.lit(0))),
        lambda i: (F.size(minima) > 0) & ((i == 0) | (F.get(minima, i) != F.get(minima, i - 1))),
    )


def winnowed(df: DataFrame, hashed: str) -> DataFrame:
    """A row for each fingerprint of the k-grams in column `hashed`: print, place (from 1)."""
    mask = (1 << PLACE_BITS) - 1
    rows = (
        df.withColumn("_placed", placed(hashed))
        .drop(hashed)
        .withColumn("_minima", window_minima("_placed"))
        .drop("_placed")
        .withColumn("_changes", changes("_minima"))
        .withColumn("_window", F.explode_outer("_changes"))
        .where(F.col("_window").isNotNull())
        .drop("_changes")
        .withColumn("_least", F.get("_minima", F.col("_window")))
    )
    ahead = F.pmod(F.col("_least").bitwiseAND(F.lit(mask)).cast("int") - F.col("_window"), F.lit(mask + 1))
    return rows.withColumn("print", F.shiftright("_least", PLACE_BITS)).withColumn(
        "place", F.col("_window") + ahead + 1
    ).drop("_minima", "_window", "_least")


def recurring(df: DataFrame, hashed: str) -> DataFrame:
    """A row for each k-gram in column `hashed` that occurs again less than SPAN places away: print, place (from 1)."""
    rows = df.withColumn("_prints", F.transform(hashed, lambda x: F.shiftright(x, PLACE_BITS))).drop(hashed)

    def again(i: Column) -> Column:
        own, out = F.get("_prints", i), F.lit(False)
        for j in range(1, SPAN):
            out = out | own.eqNullSafe(F.get("_prints", i + j)) | own.eqNullSafe(F.get("_prints", i - j))
        return out

    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("_prints") - 1, F.lit(0))), again)
    rows = rows.withColumn("_at", F.explode(places))
    return rows.withColumn("print", F.get("_prints", F.col("_at"))).withColumn("place", F.col("_at") + 1).drop("_prints", "_at")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Per item of `benchmark` (item_id, text): its words and how many words its windows have."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("item")
    )
    return items.where(F.size("item") > 0).withColumn("wide", F.least(F.lit(WINDOW), F.size("item")))


def _around(words: str) -> Column:
    """The words that windows around the k-gram at `place` can have, from at most SPAN - 1 before it."""
    before = F.least(F.col("place") - 1, F.lit(SPAN - 1))
    return F.slice(words, F.col("place") - before, before + WINDOW)


def item_keys(items: DataFrame) -> DataFrame:
    """Rows (kind, print, item_place, item words around it): what is looked up in documents.

    kind 0 are winnowed fingerprints of items of WINDOW words and more, and their recurring k-grams; kind k > 0 is the k-gram that
    begins a shorter item.  Only the words that windows around the k-gram can have are kept.
    """
    hashes = items.withColumn("hashes", F.transform("item", lambda w: F.xxhash64(w)))
    whole = hashes.where(F.col("wide") == WINDOW).withColumn("hashed", grams("hashes", GRAM)).drop("hashes")
    long = winnowed(whole, "hashed").unionByName(recurring(whole, "hashed")).select(
        F.lit(0).alias("kind"),
        "print",
        "item_id",
        "wide",
        # words place - SPAN + 1 ... place + WINDOW - 1, as far as the item has them
        F.least(F.col("place") - 1, F.lit(SPAN - 1)).alias("before"),
        _around("item").alias("around"),
    )
    kind = F.least(F.col("wide"), F.lit(GRAM))
    first = F.lit(None).cast("long")
    for k in range(1, GRAM + 1):
        first = F.when(kind == k, F.xxhash64(*[F.get("hashes", F.lit(j)) for j in range(k)])).otherwise(first)
    short = hashes.where(F.col("wide") < WINDOW).select(
        kind.alias("kind"),
        first.alias("print"),
        "item_id",
        "wide",
        F.lit(0).alias("before"),
        F.col("item").alias("around"),
    )
    return long.unionByName(short).distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, n_words, item_id, at, wide): an item's window occurs at word `at` (from 1)."""
    keys = cut(item_keys(benchmark_windows(benchmark)), "benchmark-keys")
    kinds = sorted(r["kind"] for r in keys.select("kind").distinct().collect())  # at most GRAM + 1
    side, small = maybe_broadcast(keys, row_bytes=600)
    hashes = word_blocks(docs).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    found = None
    for kind in kinds:
        k = kind or GRAM
        hashed = hashes.withColumn("hashed", grams("hashes", k)).drop("hashes")
        if kind:
            places = hashed.select("*", F.posexplode("hashed").alias("place", "print")).withColumn(
                "place", F.col("place") + 1
            )
        else:
            places = winnowed(hashed, "hashed")
        around = _around("words")
        own = [
            "doc_id",
            "text_key",
            "n_words",
            "base",
            "place",
            "print",
            F.least(F.col("place") - 1, F.lit(SPAN - 1)).alias("doc_before"),
        ]
        if small:
            rows = places.join(side.where(F.col("kind") == kind), "print").select(
                *own, around.alias("doc_around"), "item_id", "wide", "before", "around"
            )
        else:
            rows = places.select(*own, around.alias("doc_around")).join(side.where(F.col("kind") == kind), "print")
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    if found is None:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, text_key long, n_words long, item_id string, at int, wide int"
        )
    found = found.withColumn("_at", _occurrences())
    at = F.explode_outer("_at").alias("at")
    return found.select("doc_id", "text_key", "n_words", "item_id", "wide", at).where(F.col("at").isNotNull())


def word_blocks(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, n_words, base, words): the words of a text from `base` on.

    Each window of the text lies whole in one block at least, and rows stay small however long a text is.
    """
    words = docs.where(F.col("text").isNotNull()).select(
        "doc_id", text_key().alias("text_key"), words_of(F.col("text")).alias("words")
    )
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(BLOCK))
    cut_up = F.transform(
        starts, lambda s: F.struct(s.alias("base"), F.slice("words", s + 1, F.lit(BLOCK + WINDOW - 1)).alias("words"))
    )
    blocks = words.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), cut_up.alias("blocks"))
    # For explode of a column the optimizer adds a filter on its size, which would make the blocks twice.
    return blocks.select("doc_id", "text_key", "n_words", F.explode_outer("blocks").alias("block")).select(
        "doc_id", "text_key", "n_words", "block.base", "block.words"
    )


def _occurrences() -> Column:
    """Extension: the places where a window of the item that holds the shared k-gram occurs."""
    first = F.greatest(F.lit(0), F.col("before") - (SPAN - 1))
    tries = F.sequence(first, F.col("before"))
    alike = F.filter(
        tries,
        lambda s: (F.col("doc_before") - F.col("before") + s >= 0)
        & (s + F.col("wide") <= F.size("around"))
        & (F.col("doc_before") - F.col("before") + s + F.col("wide") <= F.size("doc_around"))
        & (
            F.slice("around", s + 1, F.col("wide"))
            == F.slice(
                "doc_around", F.greatest(F.lit(1), F.col("doc_before") - F.col("before") + s + 1), F.col("wide")
            )
        ),
    )
    return F.transform(alike, lambda s: (F.col("base") + F.col("place") - F.col("before") + s).cast("int"))


TEXT_SEED = 17


def text_key() -> Column:
    """Tells texts under one id apart."""
    return F.xxhash64("text", F.lit(TEXT_SEED))


def hit_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per text of `docs` (doc_id, text) that holds a window: key, n_words, n_items, items_sha256, n_hit, contaminated."""
    by_doc = (
        find_hits(docs, benchmark)
        .groupBy("doc_id", "text_key", "n_words", "at", "wide")
        .agg(F.collect_set("item_id").alias("items"))
        .groupBy("doc_id", "text_key", "n_words")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.collect_set(F.struct("at", "wide"))).alias("runs"),
        )
        .select(
            F.struct("doc_id", "text_key").alias("key"),
            "n_words",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
            _covered(F.col("runs")).cast("long").alias("n_hit"),
        )
    )
    return by_doc.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = docs.select("doc_id", "text")
    by_doc = hit_documents(docs, benchmark).drop("n_words")
    counted = docs.select(
        "doc_id",
        count_words(F.col("text")).alias("n_words"),
        F.struct("doc_id", text_key().alias("text_key")).alias("key"),
    )
    return counted.join(by_doc, counted["key"].eqNullSafe(by_doc["key"]), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )


def _covered(runs: Column) -> Column:
    """How many words the sorted runs cover together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    total = F.aggregate(
        runs,
        start,
        lambda had, run: F.struct(
            (had["n"] + F.greatest(F.lit(0), run["at"] + run["wide"] - F.greatest(had["end"], run["at"]))).alias("n"),
            F.greatest(had["end"], run["at"] + run["wide"]).alias("end"),
        ),
    )
    return total["n"]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the contaminated rows, with all columns.

    A row goes for its own text only: other texts under its id, or without an id, stay.
    """
    bad = hit_documents(docs.select("doc_id", "text"), benchmark).where("contaminated")
    bad, _ = maybe_broadcast(cut(bad.select(F.col("key.doc_id").alias("bad_id"), F.col("key.text_key").alias("bad_key")), "contaminated"), 24)
    own = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"], F.lit(TEXT_SEED)) == bad["bad_key"])
    return docs.join(bad, own, "left_anti")


def contaminated_documents(spark, sf_dir: str) -> DataFrame:
    """op9: all documents against the whole benchmark."""
    from .common import read_table

    return contamination(
        read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text")
    )
