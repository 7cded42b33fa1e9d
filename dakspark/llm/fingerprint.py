"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text's paragraphs (lines, and each six sentences of longer ones) are hashed to 64 bits.  Each digest goes to one
cell of each of three sub-tables; a cell has a count, the xor of its digests and the xor of their
checks.  Two versions' sketches are subtracted cell by cell, then peeled: a cell with one digest gives
it up, which frees others.  If cells remain, the digests are dealt to groups by their bits, each with
a sketch of its own, and a group that can't be peeled is retried with a larger one; the last retry
counts the group's digests directly, which always succeeds.

The likeness of two texts is common / all distinct digests, by the recovered difference.

Defined cases: null text = empty text; two texts without digests have likeness 1; a paragraph that
repeats counts once; rows are ordered by id, descending, null ids last, repeated ids by their texts'
hashes; the only row is its own next; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast

#: A line, or each six sentences of a longer one.
PARAGRAPH = "(?:[^\\n.!?]*[.!?]+ *){1,6}|[^\\n.!?]+"
#: Cells of each of the three sub-tables: of the fingerprint, and of the retries' groups.
CELLS, GROUP_CELLS = 12, (4, 16)
#: Digests that a group of the retries is expected to hold.
GROUP_SIZE = 4
ROUNDS = 6
#: Rows that a range of ids is to hold, and the quantiles of ids that come to the driver.
ROWS_PER_RANGE, COARSE = 5_000, 128


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs."""
    parts = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(parts, lambda x: F.xxhash64(x, F.lit(41))))


def _check(x: Column) -> Column:
    return F.xxhash64(x, F.lit(43)).bitwiseAND(F.lit(0xFFFFFFFF))


def _place(x: Column, table: int, cells: int) -> Column:
    """The cell, within a sub-table, of a digest: other bits for each of the three."""
    return F.pmod(F.shiftright(x, 14 * table + 3), F.lit(cells)).cast("int")


def _table(found: Column, table: int, cells: int) -> Column:
    """The cells (n, key, check) of one sub-table."""
    zero = F.lit(0).cast("long")
    held = F.transform(
        F.sequence(F.lit(0), F.lit(cells - 1)), lambda c: F.filter(found, lambda x: _place(x, table, cells) == c)
    )
    return F.transform(
        held,
        lambda own: F.struct(
            F.size(own).alias("n"),
            F.aggregate(own, zero, lambda a, x: a.bitwiseXOR(x)).alias("key"),
            F.aggregate(own, zero, lambda a, x: a.bitwiseXOR(_check(x))).alias("check"),
        ),
    )


def sketch(found: Column, cells: int) -> Column:
    """The sub-tables t0, t1, t2 of an array of digests."""
    return F.struct(*[_table(found, t, cells).alias(f"t{t}") for t in range(3)])


def subtract(a: Column, b: Column) -> Column:
    def cell(p: Column, q: Column) -> Column:
        return F.struct(
            (p["n"] - q["n"]).alias("n"),
            p["key"].bitwiseXOR(q["key"]).alias("key"),
            p["check"].bitwiseXOR(q["check"]).alias("check"),
        )

    return F.struct(*[F.zip_with(a[f"t{t}"], b[f"t{t}"], cell).alias(f"t{t}") for t in range(3)])


def _pure(cells: Column) -> Column:
    """The digests that are alone in a cell, with their side."""
    return F.transform(
        F.filter(cells, lambda c: (F.abs(c["n"]) == 1) & (_check(c["key"]) == c["check"])),
        lambda c: F.struct(c["key"].alias("key"), c["n"].alias("n")),
    )


def _freed(cells: Column, pure: Column, table: int, size: int) -> Column:
    """The cells of one sub-table without the digests in `pure`."""

    def without(cell: Column, place: Column) -> Column:
        return F.aggregate(
            F.filter(pure, lambda x: _place(x["key"], table, size) == place),
            cell,
            lambda left, x: F.struct(
                (left["n"] - x["n"]).alias("n"),
                left["key"].bitwiseXOR(x["key"]).alias("key"),
                left["check"].bitwiseXOR(_check(x["key"])).alias("check"),
            ),
        )

    return F.transform(cells, without)


def peel(cells: Column, size: int, rounds: int = ROUNDS) -> Column:
    """The digests that make up a difference of sketches, with their sides (1, -1); null on failure."""
    kind = "array<struct<key:bigint,n:int>>"
    tables = ("t0", "t1", "t2")
    none = F.array().cast(kind)
    state = F.struct(cells.alias("cells"), none.alias("pure"), none.alias("found"))

    def step(s: Column, turn: Column) -> Column:
        """Odd turns look for digests that are alone, even turns take them out."""
        pure = F.array_distinct(F.concat(*[_pure(s["cells"][t]) for t in tables]))
        freed = F.struct(*[_freed(s["cells"][t], s["pure"], i, size).alias(t) for i, t in enumerate(tables)])
        return (
            F.when(turn % 2 == 1, F.struct(s["cells"].alias("cells"), pure.alias("pure"), s["found"].alias("found")))
            .when(F.size(s["pure"]) == 0, s)
            .otherwise(F.struct(freed.alias("cells"), none.alias("pure"), F.concat(s["found"], s["pure"]).alias("found")))
        )

    end = F.aggregate(F.sequence(F.lit(1), F.lit(2 * rounds)), state, step)

    def left_over(s: Column) -> Column:
        return F.exists(
            F.concat(*[s["cells"][t] for t in tables]), lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0)
        )

    return F.aggregate(F.array(end), F.lit(None).cast(kind), lambda _, s: F.when(~left_over(s), s["found"]))


def _grouped(pair: Column, groups: Column, shift: int) -> Column:
    """Structs (a, b) of digests, dealt to groups by the bits from `shift` on."""
    return F.transform(
        F.sequence(F.lit(0), groups - 1),
        lambda g: F.struct(
            F.filter(pair["a"], lambda x: F.pmod(F.shiftright(x, shift), groups) == g).alias("a"),
            F.filter(pair["b"], lambda x: F.pmod(F.shiftright(x, shift), groups) == g).alias("b"),
        ),
    )


def _group_difference(pair: Column) -> Column:
    """How many digests differ within a group: larger sketches while peeling fails, a count at last."""
    tries = [_found(peel(subtract(sketch(pair["a"], c), sketch(pair["b"], c)), c)) for c in GROUP_CELLS]
    exact = F.size(F.array_except(pair["a"], pair["b"])) + F.size(F.array_except(pair["b"], pair["a"]))
    return F.coalesce(*tries, exact.cast("long"))


def _found(peeled: Column) -> Column:
    """How many digests were recovered, null if peeling failed."""
    return F.array_size(peeled).cast("long")


def group_root(a: str, b: str) -> Column:
    """The retries deal digests to this many groups, and each of those to as many again."""
    return F.ceil(F.sqrt((F.size(a) + F.size(b)) / F.lit(GROUP_SIZE)) + 0.01).cast("int")


def difference(a: str, b: str, sketch_a: str, sketch_b: str, root: str) -> Column:
    """How many digests are in one of two texts only, by the columns of digests, fingerprints and `group_root`."""
    first = _found(peel(subtract(F.col(sketch_a), F.col(sketch_b)), CELLS))
    coarse = _grouped(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.col(root), 45)
    dealt = F.flatten(F.transform(coarse, lambda pair: _grouped(pair, F.col(root), 32)))
    retried = F.aggregate(
        F.transform(dealt, _group_difference), F.lit(0).cast("long"), lambda total, n: total + n
    )
    return F.coalesce(first, retried)


def likeness(a: str, b: str, differ: str) -> Column:
    """Common digests of all, from both counts and the difference."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - F.col(differ)) / (both + F.col(differ)))


def fingerprint_text(cells: Column, count: Column) -> Column:
    """The sketch as a string: the digests' count, then each cell in hex."""
    hexed = F.transform(
        F.concat(cells["t0"], cells["t1"], cells["t2"]),
        lambda c: F.concat(
            F.lpad(F.hex(c["n"].cast("long")), 4, "0"), F.lpad(F.hex(c["key"]), 16, "0"), F.lpad(F.hex(c["check"]), 8, "0")
        ),
    )
    return F.concat(F.lpad(F.hex(count.cast("long")), 8, "0"), F.array_join(hexed, ""))


def _within(edges: list[int], found: Column) -> Column:
    """How many of the sorted edges are below a value: a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(found > edges[mid], tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(edges))


def _ranges(rows: DataFrame, total: int) -> DataFrame:
    """`rows` (doc_id, text, tie) with coarse and fine, whose order is that of descending id and rising tie.

    Coarse ranges are cut at COARSE quantiles of the ids, which the driver learns.  Each is cut evenly, by ids, into as
    many fine ones as its count asks for, and an id that fills a coarse range of its own, as null ids may, by its texts'
    hashes.  No number of ranges is capped.
    """
    shares = [i / COARSE for i in range(1, COARSE)]
    quantiles = rows.agg(F.percentile_approx("doc_id", shares, 20 * COARSE).alias("e")).first()["e"] if total > ROWS_PER_RANGE else None
    edges = sorted(set(quantiles or []))
    hot = sorted({e for e in quantiles or [] if quantiles.count(e) > 1})
    last = len(edges) + 1
    coarse = F.when(F.col("doc_id").isNull(), last).otherwise(F.lit(len(edges)) - _within(edges, F.col("doc_id")))
    alone = F.col("doc_id").isNull() | (F.col("doc_id").isin(*hot) if hot else F.lit(False))
    rows = rows.withColumn("coarse", coarse).withColumn("alone", alone)
    sizes = (
        rows.groupBy("coarse", "alone")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .select(
            "coarse", "alone", F.ceil(F.col("n") / ROWS_PER_RANGE).cast("double").alias("parts"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high")
        )
    )
    sizes = F.broadcast(cut(sizes, "ranges"))  # two rows a coarse range at most
    # The largest ids come first, and an id that stands alone is the largest of its coarse range.
    place = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("doc_id").cast("double")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    by_tie = (F.col("tie").cast("double") + 2.0**63) / 2.0**64
    part = F.least(F.floor(F.when(F.col("alone"), by_tie).otherwise(place) * F.col("parts")), F.col("parts") - 1).cast("long")
    fine = F.when(F.col("alone"), part - F.lit(1 << 40)).otherwise(part)
    return rows.join(sizes, ["coarse", "alone"]).select("doc_id", "text", "tie", "coarse", fine.alias("fine"))


def with_next(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with next_text, the text of the next row by descending id.

    Ids are cut into ranges of like size; a window orders the rows of a range, and the last row of
    each takes the first of the next range that has rows.  Texts are shuffled once.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text", F.lit(47)).alias("tie"))
    total = docs.agg(F.count("*").alias("n")).first()["n"]
    if not total:
        return docs.select("doc_id", "text", F.col("text").alias("next_text"))
    rows = _ranges(rows, total)
    # Each range's first row, by its place alone; its text is then looked up.
    order = F.struct(F.when(F.col("doc_id").isNull(), 1).otherwise(0).alias("none"), (-1 - F.col("doc_id")).alias("k"), "tie")
    heads = rows.groupBy("coarse", "fine").agg(F.min_by(F.struct("doc_id", "tie"), order).alias("head"))
    heads = cut(heads.select("coarse", "fine", "head.doc_id", "head.tie"), "heads")
    firsts = heads.groupBy("coarse").agg(F.min_by(F.struct("doc_id", "tie"), "fine").alias("h")).orderBy("coarse").collect()
    after = [(r["coarse"], *firsts[(i + 1) % len(firsts)]["h"]) for i, r in enumerate(firsts)]  # a row a coarse range, going round
    onward = F.broadcast(docs.sparkSession.createDataFrame(after, "coarse int, next_id long, next_tie long"))
    ahead = Window.partitionBy("coarse").orderBy("fine")
    wanted = heads.withColumn("up", F.lead(F.struct("doc_id", "tie")).over(ahead)).join(onward, "coarse")
    head = F.coalesce("up", F.struct(F.col("next_id").alias("doc_id"), F.col("next_tie").alias("tie")))
    wanted = cut(wanted.select(F.col("coarse").alias("to_coarse"), F.col("fine").alias("to_fine"), head.alias("h")).select("to_coarse", "to_fine", F.col("h.doc_id").alias("head_id"), F.col("h.tie").alias("head_tie")), "wanted")
    wanted, _ = maybe_broadcast(wanted, 40)
    found = (
        rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["head_id"]) & (rows["tie"] == wanted["head_tie"]))
        .groupBy("to_coarse", "to_fine")
        .agg(F.min("text").alias("head_text"))
    )
    found = cut(found.select(F.col("to_coarse").alias("coarse"), F.col("to_fine").alias("fine"), "head_text"), "heads")
    window = Window.partitionBy("coarse", "fine").orderBy(F.col("doc_id").desc_nulls_last(), F.col("tie").asc())
    return (
        rows.withColumn("led", F.lead("text").over(window))
        .join(found.hint("merge"), ["coarse", "fine"], "left")
        .select("doc_id", "text", F.coalesce("led", "head_text").alias("next_text"))
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): its fingerprint, its edited text's, and how like it is to that and the next."""
    n, cut_off = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut_off), F.substr("next_text", F.lit(1), cut_off))
    return (
        with_next(docs)
        .select("doc_id", "text", "next_text", n.cast("long").alias("n_chars"), edited.alias("edited"))
        .select(
            "doc_id",
            "n_chars",
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            digests(F.col("text")).alias("own"),
            digests(F.col("edited")).alias("new"),
            digests(F.col("next_text")).alias("next"),
        )
        .withColumns({f"{k}_cells": sketch(F.col(k), CELLS) for k in ("own", "new", "next")})
        .withColumns({f"root_{k}": group_root("own", k) for k in ("new", "next")})
        .withColumn("to_new", difference("own", "new", "own_cells", "new_cells", "root_new"))
        .withColumn("to_next", difference("own", "next", "own_cells", "next_cells", "root_next"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            fingerprint_text(F.col("own_cells"), F.size("own")).alias("fingerprint"),
            fingerprint_text(F.col("new_cells"), F.size("new")).alias("edited_fingerprint"),
            likeness("own", "new", "to_new").alias("near_edited"),
            likeness("own", "next", "to_next").alias("near_next"),
        )
    )


def document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """op8: all documents, their edited texts and their next ones."""
    from .common import read_table

    return fingerprints(read_table(spark, sf_dir, "documents", "doc_id", "text"))
