"""MinHash near-duplicates by a multi-index Hamming join.

A document's shingles are hashed to 64 bits; its signature has SYMBOLS minima of BITS bits each and is
split into CHUNKS.  Two signatures that differ in at most RADIUS symbols differ in at most ERRORS
symbols of some chunk (pigeonhole: RADIUS < CHUNKS * (ERRORS + 1)), so listing each chunk with every
choice of ERRORS symbols left out finds all such pairs.  Candidates within RADIUS are confirmed on
their full sets.

No bucket emits its pairs.  Equal sets are one class from the start; buckets are joined round by round
by their most central members (see `buckets`).  Pairs across components that remain are ruled out where
possible by an exact bound, the shingles that no other such document has; the others are confirmed on
their full sets.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; null ids are
left out of `near_duplicates` and stay with `drop_near_duplicates`; rows that repeat an id are one
document, with the shingles of the smallest of its texts (by size and hash), and only rows of that text
go with it: other texts under the id, which were not compared, stay; an empty table gives no rows;
further columns, whatever their names, stay with `drop_near_duplicates` and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import link_buckets
from .common import Scratch, cut_at, drop_path, maybe_broadcast, small_batches

SYMBOLS, BITS, CHUNKS, ERRORS = 48, 16, 12, 1
RADIUS = CHUNKS * (ERRORS + 1) - 1
WIDE = SYMBOLS // CHUNKS
#: Slots of shingle hashes that bound what two sets can have in common.
SLOTS = 64
TEXT_SEED = 61

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.cumprod(np.full(256, 0x100000001B3, np.uint64), dtype=np.uint64)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    if not inside.any():
        return np.empty(0, np.uint64)
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    sizes = edge[1::2] - edge[::2]
    begin = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
    powers = _POWERS
    if sizes.max() > len(powers):
        powers = np.cumprod(np.full(int(sizes.max()), 0x100000001B3, np.uint64), dtype=np.uint64)
    terms = (raw[inside].astype(np.uint64) + np.uint64(1)) * powers[place]
    return _mixed(np.add.reduceat(terms, begin) + sizes.astype(np.uint64) * _MIX)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `width` words; with fewer words, of all of them."""
    words = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(words):
        return words
    k = min(width, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        total = _mixed(total + words[j : len(words) - k + 1 + j] * np.uint64(2 * j + 3) + _MIX)
    return np.unique(total + np.uint64(k))


_KEYS = _mixed(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * _MIX)
_FACTORS = _mixed(np.arange(1001, SYMBOLS + 1001, dtype=np.uint64) * _MIX) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS minima, each cut to BITS bits.  The shingles are mixed already, so a product orders them anew."""
    least = np.empty(SYMBOLS, np.uint64)
    for i in range(SYMBOLS):
        least[i] = ((shingles ^ _KEYS[i]) * _FACTORS[i]).min()
    return (_mixed(least) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """Per document: n_shingles, two 64-bit hashes of its whole set, and its signature."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, left, right, signs = [], [], [], []
            for text in batch["text"]:
                own = shingle_set(text, width)
                sizes.append(len(own))
                left.append(int(np.bitwise_xor.reduce(_mixed(own + _MIX)).view(np.int64)) if len(own) else 0)
                right.append(int(own.sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
                signs.append(signature(own).view(np.int16).tolist() if len(own) else [])
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_shingles": sizes,
                    "set_a": left,
                    "set_b": right,
                    "sign": signs,
                    "tkey": batch["tkey"],
                }
            )

    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", "text", _text_key().alias("tkey"))
    return keyed.mapInPandas(
        sketch, "doc_id long, n_shingles long, set_a long, set_b long, sign array<short>, tkey long"
    )


def _text_key() -> Column:
    """Tells the texts of a repeated id apart."""
    return F.xxhash64("text", F.lit(TEXT_SEED))


def _packed(sign: Column, chunk: int) -> Column:
    """A chunk's symbols as one 64-bit number."""
    out = F.lit(0).cast("long")
    for j in range(WIDE):
        symbol = F.element_at(sign, chunk * WIDE + j + 1).cast("long").bitwiseAND(F.lit(0xFFFF))
        out = F.shiftleft(out, BITS).bitwiseOR(symbol)
    return out


def chunk_keys(sign: Column) -> Column:
    """Each chunk with each choice of ERRORS symbols left out, as one 64-bit key: no two choices meet."""
    out = []
    for chunk in range(CHUNKS):
        for left_out in range(WIDE):
            key = F.lit(chunk * WIDE + left_out).cast("long")
            for j in range(WIDE):
                if j != left_out:
                    symbol = F.element_at(sign, chunk * WIDE + j + 1).cast("long").bitwiseAND(F.lit(0xFFFF))
                    key = F.shiftleft(key, BITS).bitwiseOR(symbol)
            out.append(key)
    return F.array(*out)


def _lanes(x: Column, y: Column) -> Column:
    """How many of a chunk's symbols differ."""
    both = x.bitwiseXOR(y)
    return sum((F.shiftright(both, BITS * j).bitwiseAND(F.lit(0xFFFF)) != 0).cast("int") for j in range(WIDE))


def _distance(x: Column, y: Column) -> Column:
    """How many symbols of two packed signatures differ."""
    return sum(_lanes(x[c], y[c]) for c in range(CHUNKS))


def _near_in_size(a: Column, b: Column, percent: int) -> Column:
    """A pair can reach the threshold only if the smaller set is `percent` of the larger."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


class _Confirmer:
    """Confirms pairs of classes on their full sets."""

    def __init__(self, docs: DataFrame, width: int, percent: int, scratch: Scratch):
        self.docs, self.width, self.percent, self.scratch = docs, width, percent, scratch

    def shingles(self, ids: DataFrame) -> DataFrame:
        """Rows (id, s) of the sets of the documents in `ids`."""
        width = self.width

        def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                sets = [shingle_set(x, width).view(np.int64) for x in batch["text"]]
                yield pd.DataFrame(
                    {
                        "id": np.repeat(batch["doc_id"].to_numpy(), [len(x) for x in sets]),
                        "s": np.concatenate(sets) if sets else np.empty(0, np.int64),
                    }
                )

        own = self.scratch.cut(ids.select(F.col("id").alias("doc_id")), "wanted")
        own, _ = maybe_broadcast(own, row_bytes=16)
        return self.docs.join(own, "doc_id", "left_semi").mapInPandas(pieces, "id long, s long").distinct()

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) with 100 * intersection >= percent * union."""
        width, percent = self.width, self.percent
        wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()

        def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame(
                    {"doc_id": batch["doc_id"], "s": [shingle_set(x, width).tobytes() for x in batch["text"]]}
                )

        wanted, wanted_path = cut_at(wanted, "wanted")
        wanted, _ = maybe_broadcast(wanted, row_bytes=16)
        own = self.docs.join(wanted, "doc_id", "left_semi").mapInPandas(sets, "doc_id long, s binary")
        own, path = cut_at(own, "sets")
        drop_path(self.docs.sparkSession, wanted_path)

        def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                good = []
                for x, y in zip(batch["sa"], batch["sb"]):
                    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    good.append(100 * both >= percent * (len(p) + len(q) - both))
                yield batch.loc[good, ["a", "b"]]

        joined = pairs.join(own.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b").join(
            own.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a"
        )
        links = self.scratch.cut(joined.select("a", "b", "sa", "sb").mapInPandas(confirm, "a long, b long"), "links")
        drop_path(self.docs.sparkSession, path)
        return links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document of `docs` (doc_id, text): n_shingles, component_id, kept; and tkey, of the text that was compared."""
    spark = docs.sparkSession
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    scratch = Scratch(spark)
    known, known_path = cut_at(sketches(docs, width), "sketches")
    first = F.min(F.struct("n_shingles", "set_a", "set_b", "sign", "tkey"))
    # Ids that repeat are rare: they are merged by a pre-summed aggregate of thin rows.
    whole = scratch.cut(known.groupBy("doc_id").agg(first.alias("k")).select("doc_id", "k.*"), "whole")
    if whole.count() < known.count():
        # Only then are texts moved: of each id's texts the chosen one stays.
        chosen = whole.select("doc_id", F.col("tkey").alias("_tkey"))
        docs = docs.join(chosen, "doc_id").where(_text_key().eqNullSafe(F.col("_tkey"))).select("doc_id", "text")
    drop_path(spark, known_path)
    classes = (
        whole.where("n_shingles > 0")
        .groupBy("n_shingles", "set_a", "set_b")
        .agg(F.min(F.struct("doc_id", "sign")).alias("k"))
        .select(F.col("k.doc_id").alias("id"), F.col("n_shingles").alias("n"), F.col("k.sign").alias("sign"), "set_a", "set_b")
    )
    classes = scratch.cut(classes, "classes")
    confirm = _Confirmer(docs, width, percent, scratch)

    keys = classes.select("id", "n", F.explode(chunk_keys(F.col("sign"))).alias("key"))
    signs = classes.select("id", F.array(*[_packed(F.col("sign"), c) for c in range(CHUNKS)]).alias("chunks"))

    def within_radius(pairs: DataFrame) -> DataFrame:
        a, b = (signs.select(F.col("id").alias(x), F.col("chunks").alias(f"chunks_{x}")) for x in "ab")
        near = pairs.join(a, "a").join(b, "b").where(_distance(F.col("chunks_a"), F.col("chunks_b")) <= RADIUS)
        return near.select("a", "b")

    def enrich(ids: DataFrame) -> DataFrame:
        """The signature, the set's size, and how many shingles that others of `ids` have too lie in each slot of hashes.

        Documents that share no shingle with another one can't be linked and are left out.
        """
        pieces = confirm.shingles(ids)
        common = pieces.groupBy("s").agg(F.min("id").alias("l"), F.max("id").alias("h")).where("l < h").select("s")
        slot = F.pmod("s", F.lit(SLOTS)).cast("int")
        by_slot = pieces.join(common, "s").groupBy("id", slot.alias("slot")).agg(F.count("*").cast("int").alias("m"))
        counts = by_slot.groupBy("id").agg(
            F.map_from_entries(F.collect_list(F.struct("slot", "m"))).alias("m"), F.sum("m").alias("others")
        )
        filled = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)))
        rows = classes.join(ids, "id", "left_semi").join(counts.select("id", "others", filled.alias("slots")), "id")
        more = F.struct("n", "others", "slots", *[_packed(F.col("sign"), c).alias(f"c{c}") for c in range(CHUNKS)])
        return scratch.cut(rows.select("id", more.alias("more")), "enriched")

    def worth(key: Column, x: Column, y: Column) -> Column:
        """Signatures within RADIUS, no earlier bucket with both, and enough shingles that can be common.

        Two sets can't have more in common than the smaller count of each slot, all slots added.
        """
        most = F.aggregate(
            F.zip_with(x["slots"], y["slots"], lambda p, q: F.least(p, q)), F.lit(0), lambda total, m: total + m
        )
        needed = percent * (x["n"] + y["n"])
        some = (100 + percent) * F.least(x["others"], y["others"]) >= needed  # the cheapest test, so the first
        enough = (100 + percent) * most >= needed
        apart = [_lanes(x[f"c{c}"], y[f"c{c}"]) for c in range(CHUNKS)]
        slot = F.shiftrightunsigned(key, BITS * (WIDE - ERRORS))
        first = F.lit(False)
        for c in reversed(range(CHUNKS)):
            here = (slot >= c * WIDE) & (slot < (c + 1) * WIDE) & ((apart[c] == 1) | (slot == c * WIDE))
            first = F.when(apart[c] <= ERRORS, here).otherwise(first)
        return some & (sum(apart) <= RADIUS) & first & enough

    parts = link_buckets(keys, confirm, lambda x, y: _near_in_size(x, y, percent), within_radius, enrich, worth, scratch=scratch)
    root = classes.join(parts.withColumnRenamed("node", "id"), "id", "left").select(
        "n", "set_a", "set_b", F.coalesce("component", "id").alias("root")
    )
    member = whole.join(
        root, (whole["n_shingles"] == root["n"]) & (whole["set_a"] == root["set_a"]) & (whole["set_b"] == root["set_b"]), "left"
    )
    # A class is named by its smallest document, so the root is the component's smallest.
    component = F.coalesce("root", "doc_id")
    named, _ = cut_at(
        member.select(
            "doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"), "tkey"
        ),
        "named",
    )
    scratch.drop()
    return named


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each group, the one of the smallest id; all columns stay.

    Rows without an id stay, of rows that repeat a kept id all stay, and a row goes only with its own text.
    """
    gone = near_duplicates(docs, width, percent).where(~F.col("kept"))
    gone, _ = maybe_broadcast(gone.select(F.col("doc_id").alias("gone_id"), F.col("tkey").alias("gone_key")), 24)
    own = (docs["doc_id"] == gone["gone_id"]) & F.xxhash64(docs["text"], F.lit(TEXT_SEED)).eqNullSafe(gone["gone_key"])
    return docs.join(gone, own, "left_anti")


def near_duplicate_documents(spark, sf_dir: str) -> DataFrame:
    """op1: shingles of four words, similarity of 0.8 or more."""
    from .common import read_table

    return near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"), width=4).drop("tkey")
