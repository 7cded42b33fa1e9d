"""Language identification by a byte convolutional network, trained here in numpy.

A text's UTF-8 bytes are cut into windows of fixed length that cover all of it.  Each byte has a
learned vector; filters of several widths run over a window, each is pooled by its maximum over the
window, and a softmax layer gives the languages.  A text's prediction is that of its windows' mean
log probability, weighted by their bytes.

Training takes a bounded sample (SAMPLE_WINDOWS windows, dealt evenly to the languages by a hash of
the id) to the driver; all else is done where the rows lie.

Defined cases: null text or text without a letter = `und` with score 0; languages without text are
not learned; without any labelled row every prediction is `und`; an empty table gives no rows; over
MAX_LANGUAGES languages among the labels are an error, as a window a language is then no sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 24
BYTE_DIM = 8
#: The documented bound on what training reads.
SAMPLE_WINDOWS = 8000
MAX_LANGUAGES = 500
UNKNOWN = "und"


class ByteConvNet:
    """Byte vectors, filters of the given widths, max pooling, softmax."""

    def __init__(self, classes: int, widths=WIDTHS, filters=FILTERS, dim=BYTE_DIM, seed=7):
        rng = np.random.default_rng(seed)
        self.widths, self.dim, self.span = widths, dim, max(widths)
        self.vectors = rng.normal(0, 0.5, (256, dim)).astype(np.float32)
        #: One matrix for all widths; rows past a filter's width stay zero.
        self.mask = np.zeros((self.span * dim, len(widths) * filters), np.float32)
        for i, w in enumerate(widths):
            self.mask[: w * dim, i * filters : (i + 1) * filters] = 1
        self.filters = rng.normal(0, 1 / np.sqrt(self.span * dim), self.mask.shape).astype(np.float32) * self.mask
        self.bias = np.zeros(self.mask.shape[1], np.float32)
        self.out = rng.normal(0, 0.1, (self.mask.shape[1], classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of (n, length) bytes: the filters' inputs, their values by place, and the largest of each."""
        n, length = windows.shape
        places = length - self.span + 1
        given = self.vectors[windows].reshape(n, length * self.dim)
        stride = given.strides
        spans = np.lib.stride_tricks.as_strided(
            given, (n, places, self.span * self.dim), (stride[0], self.dim * 4, 4)
        )
        inputs = np.ascontiguousarray(spans).reshape(n * places, -1)
        values = (inputs @ self.filters).reshape(n, places, -1)
        return inputs, values, values.max(1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        top = np.maximum(self.pooled(windows)[2] + self.bias, 0)
        scores = top @ self.out + self.out_bias
        scores -= scores.max(1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(1, keepdims=True))

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs=8, batch=64, rate=0.004, seed=3) -> ByteConvNet:
        """Adam on the cross entropy."""
        rng = np.random.default_rng(seed)
        names = ("vectors", "filters", "bias", "out", "out_bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                grads = self._gradients(windows[own], labels[own])
                step += 1
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    fixed = np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                    getattr(self, k).__isub__(rate * first[k] / (1 - 0.9**step) / fixed)
        return self

    def _gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        n = len(windows)
        inputs, values, top = self.pooled(windows)
        places, where = values.shape[1], values.argmax(1)
        kept = np.maximum(top + self.bias, 0)
        scores = kept @ self.out + self.out_bias
        odds = np.exp(scores - scores.max(1, keepdims=True))
        wrong = odds / odds.sum(1, keepdims=True)
        wrong[np.arange(n), labels] -= 1
        wrong /= n
        back = (wrong @ self.out.T) * (kept > 0)
        best = inputs.reshape(n, places, -1)[np.arange(n)[:, None], where]  # (n, filters, span * dim)
        to_filters = np.einsum("nf,nfd->df", back, best) * self.mask
        to_inputs = back[:, :, None] * self.filters.T[None]  # (n, filters, span * dim)
        to_vectors = np.zeros_like(self.vectors)
        rows = np.arange(n)[:, None]
        for j in range(self.span):
            part = to_inputs[:, :, j * self.dim : (j + 1) * self.dim]
            np.add.at(to_vectors, windows[rows, where + j].ravel(), part.reshape(-1, self.dim))
        return {
            "vectors": to_vectors,
            "filters": to_filters.astype(np.float32),
            "bias": back.sum(0),
            "out": kept.T @ wrong,
            "out_bias": wrong.sum(0),
        }


def cut_windows(text: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover all bytes, the last filled with spaces; and how many bytes each has."""
    raw = np.frombuffer(text, np.uint8)
    n = max(1, -(-len(raw) // window))
    out = np.full(n * window, 32, np.uint8)
    out[: len(raw)] = raw
    sizes = np.full(n, window)
    sizes[-1] = len(raw) - (n - 1) * window
    return out.reshape(n, window), sizes


def fit_language_model(
    docs: DataFrame, sample: int = SAMPLE_WINDOWS, window: int = WINDOW
) -> tuple[ByteConvNet, list[str]] | None:
    """A model of `docs` (doc_id, text, lang), from at most about `sample` windows over all languages.

    A window's place in its text follows from a hash of the id.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = sample / len(counts)
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, share / n))).otherwise(rate)
    luck = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1e6
    place = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.greatest(F.lit(1), F.char_length("text") - window + 1))
    rows = (
        known.where(luck < rate)
        .select("lang", F.substr("text", (place + 1).cast("int"), F.lit(window)).alias("part"))
        .limit(2 * sample)
        .collect()
    )
    names = sorted({r["lang"] for r in rows})
    if not names:
        return None
    rows.sort(key=lambda r: (r["lang"], r["part"]))
    data = np.stack([cut_windows(r["part"].encode()[:window], window)[0][0] for r in rows])
    labels = np.array([names.index(r["lang"]) for r in rows])
    return ByteConvNet(len(names)).fit(data, labels), names


def predict_languages(docs: DataFrame, model: tuple[ByteConvNet, list[str]] | None, window: int = WINDOW) -> DataFrame:
    """`docs` (doc_id, text) with lang_pred and score, from all windows of the whole text."""
    spark = docs.sparkSession
    has_letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, names = shared.value
        for batch in batches:
            langs, scores = [], []
            for text, usable in zip(batch["text"], batch["usable"]):
                if not usable:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                windows, sizes = cut_windows(text.encode(), window)
                total = np.zeros(len(names))
                for at in range(0, len(windows), 32):
                    logs = net.log_probabilities(windows[at : at + 32])
                    total += logs.T.astype(float) @ sizes[at : at + 32]
                total /= sizes.sum()
                odds = np.exp(total - total.max())
                langs.append(names[int(odds.argmax())])
                scores.append(float(odds.max() / odds.sum()))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": langs, "score": scores})

    small_batches(spark)
    given = docs.select("doc_id", "text", has_letter.alias("usable"))
    return given.mapInPandas(predict, "doc_id long, lang_pred string, score double")


def held_out(remainder: int, of: int):
    """If crc32 of the id as text, modulo `of`, is `remainder`; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == remainder, F.lit(False))


def document_languages(spark, sf_dir: str) -> DataFrame:
    """op4: learns from the documents that aren't held out and predicts all."""
    from .common import read_table

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit_language_model(docs.where(~held_out(2, 4)))
    return predict_languages(docs, model).select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score")
