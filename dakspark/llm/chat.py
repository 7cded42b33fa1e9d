"""Chat formatting with cumulative-snapshot collapse.

A chat that is logged after every turn leaves many conversations that are prefixes of longer ones.
Each prefix of a conversation has a hash, the sum of hashes of (rank, role, text) over its turns; sums
can be made piecewise, so a conversation of any length is hashed in blocks of BLOCK turns and no task
needs it whole.  A conversation whose full hash and length are a proper prefix of another is dropped
by an anti-join; of conversations that are equal the smallest id stays.  Those that stay are rendered,
in parts of BLOCK turns.

Defined cases: null role = `user`, null text = empty; turns are ordered by number, null numbers last,
ties by role and text, so equal rows repeat a turn; rows with a null conversation id are left out;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK = 1024
#: How a turn is rendered.
OPENING, CLOSING = "<|im_start|>", "<|im_end|>\n"


def _hash(seed: int) -> Column:
    """A turn's 64-bit hash under its rank, as a decimal, so that sums stay exact."""
    return F.xxhash64("rank", "role", "text", F.lit(seed)).cast("decimal(38,0)")


def ranked_turns(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text) with rank, 1 for a conversation's first turn, by blocks.

    A block is a range of turn numbers; ranks are counted within it and moved by what lies before, so
    no window holds more than a block's turns, if numbers don't repeat without end.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(2**62)).cast("long").alias("block"),
    )
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    return (
        rows.withColumn("own", F.row_number().over(order))
        .join(starts, ["conv_id", "block"])
        .select("conv_id", "block", "role", "text", (F.col("start") + F.col("own")).alias("rank"))
    )


def prefixes(ranked: DataFrame) -> DataFrame:
    """Per turn of a conversation: the length n and the two hashes a, b of the prefix that it ends."""
    hashed = ranked.select("conv_id", "block", "rank", _hash(51).alias("ha"), _hash(53).alias("hb"))
    by_block = hashed.groupBy("conv_id", "block").agg(F.sum("ha").alias("sa"), F.sum("hb").alias("sb"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    starts = by_block.select(
        "conv_id",
        "block",
        F.coalesce(F.sum("sa").over(before), zero).alias("pa"),
        F.coalesce(F.sum("sb").over(before), zero).alias("pb"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return (
        hashed.withColumns({"ca": F.sum("ha").over(inside), "cb": F.sum("hb").over(inside)})
        .join(starts, ["conv_id", "block"])
        .select(
            "conv_id",
            F.col("rank").alias("n"),
            (F.col("ca") + F.col("pa")).cast("string").alias("a"),
            (F.col("cb") + F.col("pb")).cast("string").alias("b"),
        )
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns) of the conversations that are no proper prefix of another, each text once."""
    found = cut(prefixes(ranked_turns(turns)), "prefixes")
    ends = found.groupBy("conv_id").agg(F.max("n").alias("n_turns"))
    # Proper prefixes, each once: what every snapshot's end is held against.
    inner = (
        found.join(ends, "conv_id").where(F.col("n") < F.col("n_turns")).groupBy("n", "a", "b").agg(F.lit(1).alias("one"))
    )
    last = found.join(ends, "conv_id").where(F.col("n") == F.col("n_turns")).select("conv_id", "n", "a", "b")
    one = last.groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    return one.join(inner, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """Per part of at most BLOCK turns of the conversations in `kept`: its turns rendered in order."""
    ranked = ranked_turns(turns).join(kept, "conv_id")
    line = F.concat(F.lit(OPENING), "role", F.lit("\n"), "text", F.lit(CLOSING))
    return (
        ranked.select(
            "conv_id",
            "n_turns",
            F.floor((F.col("rank") - 1) / BLOCK).cast("long").alias("part"),
            F.struct("rank", line.alias("line")).alias("row"),
        )
        .groupBy("conv_id", "n_turns", "part")
        .agg(F.array_sort(F.collect_list("row")).alias("rows"))
        .select("conv_id", "part", "n_turns", F.array_join(F.transform("rows", lambda r: r["line"]), "").alias("text"))
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, part, n_turns, text) of all maximal conversations."""
    return render(turns, maximal_conversations(turns))


def formatted_conversations(spark, sf_dir: str) -> DataFrame:
    """op2: the rendered conversations that no longer one contains as its beginning."""
    from .common import read_table

    return format_chats(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


#: The same in SQL, over conversations of under BLOCK turns without nulls or repeated turns.
FORMAT_SQL = """
WITH t AS (SELECT conv_id, turn, role, text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rank FROM conversations),
p AS (SELECT conv_id, rank, string_agg(role || chr(1) || text || chr(2), '') OVER (PARTITION BY conv_id ORDER BY rank) AS prefix,
             max(rank) OVER (PARTITION BY conv_id) AS n FROM t),
ends AS (SELECT prefix, n, min(conv_id) AS conv_id FROM p WHERE rank = n GROUP BY prefix, n),
kept AS (SELECT conv_id, n FROM ends WHERE prefix NOT IN (SELECT prefix FROM p WHERE rank < n))
SELECT t.conv_id, CAST(0 AS BIGINT) AS part, CAST(k.n AS BIGINT) AS n_turns,
  string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' ORDER BY t.rank) AS text
FROM t JOIN kept k ON t.conv_id = k.conv_id GROUP BY t.conv_id, k.n
"""
