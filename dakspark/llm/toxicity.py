"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word's input is its own vector, if training saw it often enough, beside the mean of its character
n-grams' vectors.  A text is cut into overlapping windows of words; both directions of the network
run over each window, attention pools the states, and the text's score is that of its worst window.

Training takes a bounded sample of labelled rows (SAMPLE_TOXIC and SAMPLE_CLEAN texts, of each at most
SAMPLE_CHARS characters at a place that follows from its id) to the driver.  Labels hold for texts,
so each toxic text trains with its worst window as the network then sees it, each clean one with its
worst and another.

Training runs in a process of its own that has numpy alone and keeps words as numbers.  Scoring is a
function of a row's text: `keep_clean` filters rows where they lie, without a join or shuffle, so null
and repeated ids need no rule.

Defined cases: null text, and text without a word, is one empty window, which has a score; without
labels of both kinds every score is 0 and every row stays; labels with null toxic are left out, of
repeated ones the largest counts; rows that repeat an id are scored each on its own; a text of any
length is scored in pieces that share all its windows; an empty table gives no rows; further columns,
whatever their names, stay with `keep_clean` and are ignored elsewhere.
"""

from __future__ import annotations

import os
import pickle
import subprocess
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gated
from .common import release, small_batches
from .gated import GatedNet, Scorer, word_pieces
from .langid import held_out

#: The documented bounds on what training reads.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2500, 4000, 6000
#: Texts are scored in parts of so many rows and words.
PART_ROWS, PART_WORDS = 64, 20_000


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> GatedNet | None:
    """A network from `docs` (doc_id, text) and `labels` (doc_id, toxic), by a bounded sample."""
    marks = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return None
    luck = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(1_000_000)) / 1e6
    rate = F.when(F.col("toxic") == 1, SAMPLE_TOXIC / counts[1]).otherwise(SAMPLE_CLEAN / counts[0])
    chosen = marks.where(luck < rate).limit(2 * (SAMPLE_TOXIC + SAMPLE_CLEAN))
    place = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.greatest(F.lit(1), F.char_length("text") - SAMPLE_CHARS + 1))
    rows = (
        docs.where(F.col("text").isNotNull())
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "toxic", F.substr("text", (place + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("part"))
        # An id may repeat without end; one of its texts is enough.
        .groupBy("doc_id", "toxic")
        .agg(F.min("part").alias("part"))
        .collect()
    )
    rows.sort(key=lambda r: -r["doc_id"])
    if len({r["toxic"] for r in rows}) < 2:
        return None
    # The process that trains counts beside the driver, which waits for it.
    release(docs.sparkSession)
    return train_apart(rows)


def train_apart(rows: list) -> GatedNet:
    """Trains in a process of its own, which is sent one row after the other; `rows` (toxic, part) is emptied."""
    paths = os.pathsep.join(os.path.abspath(p) for p in sys.path if p)
    command = f"from {gated.__name__} import train_from_input; train_from_input()"
    with subprocess.Popen(
        [sys.executable, "-c", command], stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=os.environ | {"PYTHONPATH": paths}
    ) as process:
        while rows:
            row = rows.pop()
            pickle.dump((row["part"], row["toxic"]), process.stdin)
        pickle.dump(None, process.stdin)
        process.stdin.close()
        net = process.stdout.read()
    if process.returncode:
        raise RuntimeError(f"training ended with {process.returncode}")
    return pickle.loads(net)


def _scores(scorer: Scorer, texts: pa.Array) -> Iterator[float]:
    """The score of each text: that of its worst window.  Few texts are Python strings at a time."""
    for at in range(0, len(texts), PART_ROWS):
        held, owner, words = [], [], 0
        best: dict[int, float] = {}

        def flush() -> None:
            for k, found in zip(owner, scorer.window_logits(held)):
                best[k] = max(best.get(k, -np.inf), float(found.max()))

        for k, text in enumerate(texts.slice(at, PART_ROWS)):
            for piece in word_pieces(text.as_py()):
                held.append(piece)
                owner.append(k)
                words += len(piece)
                if words >= PART_WORDS:
                    flush()
                    held, owner, words = [], [], 0
        if held:
            flush()
        for k in sorted(best):
            yield float(gated._sigmoid(np.float64(best[k])))


def _by_batch(net: GatedNet, place: int, made: Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch], spark) -> Callable:
    """A function for mapInArrow: `made(batch, scores)` of each batch, whose text is column `place`."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield made(batch, pa.array(_scores(scorer, batch.column(place)), pa.float64()))

    return run


def score_toxicity(docs: DataFrame, net: GatedNet | None) -> DataFrame:
    """`docs` (doc_id, text) with score, of all windows of the whole text, and predicted."""
    if net is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def made(batch: pa.RecordBatch, scores: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])

    run = _by_batch(net, 1, made, docs.sparkSession)
    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows that the network, trained on the labelled ones, finds toxic; all columns stay."""
    net = fit_toxicity(docs, labels)
    if net is None:
        return docs

    def made(batch: pa.RecordBatch, scores: pa.Array) -> pa.RecordBatch:
        return batch.filter(pc.less(scores, 0.5))

    return docs.mapInArrow(_by_batch(net, docs.columns.index("text"), made, docs.sparkSession), docs.schema)


def document_toxicity(spark, sf_dir: str) -> DataFrame:
    """op7: learns from the labelled documents that aren't held out and scores all."""
    from .common import read_table

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    net = fit_toxicity(docs, labels.where(~held_out(0, 5)))
    return score_toxicity(docs, net).select("doc_id", held_out(0, 5).alias("held_out"), "score", "predicted")
