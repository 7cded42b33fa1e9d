"""Hierarchical packing of tokenised documents into windows of several lengths.

Documents are tokenised where they lie, without a shuffle, and packed by the task that holds them:
full windows of the longest tier are cut off first; what remains of a document is routed to the
smallest tier that holds it; tiers are packed from long to short, gaps are filled with whole pieces
of shorter tiers and at last with a cut piece, so windows are full.  Only what is left at the end of
a stock is cut into powers of two, the lengths that need no padding.  Windows of a tier are dealt to
step groups of equally many tokens.

A stock holds at most about STOCK_IDS token ids, or one document, so memory is bounded by the
longest document.  Nothing depends on other tasks: a lost task is packed again alike.

Defined cases: null text = empty text, which is the end id alone; rows that repeat an id are packed
as documents of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TIERS = (2048, 1024, 512, 256)
END_ID = 1
STOCK_IDS = 2_000_000
STEP_IDS = 16_384
PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
    "offset long, window_length long, step_group long"
)

#: Fixed value: how the vocabulary's rule splits plain text, for texts of the letters in PLAIN only.
WORD = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9a-zß-öø-ÿ]+")
#: Other letters, where case, composition or classes need the library's own rules, and MARK take the direct way.
OTHER, MARK = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]"), "<|"
#: Words of each kind, on which a vocabulary must agree with WORD.
PROBE = "It's 10.5% of the naïve Straßen: Ça, ÀÉÎÕÜ we'll... 'x' o'd\tþÿ¿!"
#: Chunks and words whose ids a worker keeps, also between its tasks and while it does other stages' work.
KEPT_WORDS = 600_000
#: Pieces that are handed on at a time.
FRAME_ROWS = 1000


class WordEncoder:
    """Ids of whole texts by a vocabulary file whose words are independent of each other.

    Plain texts are cut at white space; each distinct chunk is split into words, which the vocabulary's
    model encodes, once and kept.  Of KEPT_WORDS chunks and words the older half goes when the newer one
    is full, but for those used since.  All other texts go through the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        #: How the model spells the letters beyond ASCII: as the characters of their bytes.
        self.spelling = {k: spell(chr(k))[0][0] for k in range(0xC0, 0x100)}
        if self.encode([PROBE])[0].tolist() != self.tokenizer.encode(PROBE, add_special_tokens=False).ids:
            raise ValueError("words and pieces of the vocabulary differ")

    def _word(self, word: str) -> bytes:
        spelt = word if word.isascii() else word.translate(self.spelling)
        return array("H", [x.id for x in self.model.tokenize(spelt)]).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Makes all the chunks known, by the older half if they are there."""
        known, older = self.known, self.older
        for chunk in chunks:
            ids = older.pop(chunk, None)
            if ids is None:
                words = WORD.findall(chunk)
                if len(words) == 1:
                    ids = self._word(chunk)
                else:
                    for word in words:
                        if word not in known:
                            known[word] = older.pop(word, None) or self._word(word)
                    ids = b"".join([known[x] for x in words])
            known[chunk] = ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) >= KEPT_WORDS // 2:
            self.known, self.older = {}, self.known
        split = [None if MARK in x or OTHER.search(x) else x.lower().split() for x in texts]
        found = [None if x is None else list(map(self.known.get, x)) for x in split]
        gaps = [[i for i, ids in enumerate(x) if ids is None] if x and None in x else [] for x in found]
        new = {chunks[i] for chunks, own in zip(split, gaps) for i in own}
        if new:
            self._learn(new)
        out = []
        for text, chunks, parts, own in zip(texts, split, found, gaps):
            if chunks is None:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append(np.array(ids, "<u4"))
            else:
                for i in own:
                    parts[i] = self.known[chunks[i]]
                out.append(np.frombuffer(b"".join(parts), "<u2").astype("<u4"))
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One for each worker, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pack_stock(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Windows over documents of the given lengths: (window length, [(document, start, length)]).

    Each id lies in one piece; every window is full, the last ones of a stock being powers of two.
    """
    longest = tiers[0]
    stock: list[tuple[int, int, int]] = []  # (length, document, start), ascending
    for k, n in enumerate(lengths):
        for at in range(0, n - n % longest, longest):
            yield longest, [(k, at, longest)]
        if n % longest:
            stock.append((n % longest, k, n - n % longest))
    stock.sort()
    shortest = tiers[-1]
    for place, tier in enumerate(tiers):
        floor = tiers[place + 1] if place + 1 < len(tiers) else 0
        while stock and stock[-1][0] > floor:
            if floor == 0 and sum(x[0] for x in stock[-tier:]) < tier:
                break
            n, k, start = stock.pop()
            window, gap = [(k, start, n)], tier - n
            while gap and stock:
                fit = bisect_right(stock, (gap, len(lengths), 0)) - 1
                if fit >= 0 and (stock[fit][0] * 4 >= gap or gap <= shortest // 4):
                    n, k, start = stock.pop(fit)
                elif gap >= shortest and fit >= 0:
                    n, k, start = stock.pop(fit)
                else:
                    whole = len(stock) - 1 if fit < 0 else fit
                    n, k, start = stock.pop(whole)
                    if n > gap:
                        insort(stock, (n - gap, k, start + gap))
                        n = gap
                window.append((k, start, n))
                gap -= n
            if gap:
                yield from _powers(window)
            else:
                yield tier, window
    if stock:
        yield from _powers([(k, start, n) for n, k, start in reversed(stock)])


def _powers(pieces: list[tuple[int, int, int]]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Cuts what is left into windows whose lengths are powers of two."""
    left = sum(n for _, _, n in pieces)
    at = 0
    k, start, n = pieces[0]
    while left:
        size = 1 << (left.bit_length() - 1)
        window, room = [], size
        while room:
            took = min(room, n)
            window.append((k, start, took))
            room, start, n = room - took, start + took, n - took
            if n == 0 and at + 1 < len(pieces):
                at += 1
                k, start, n = pieces[at]
        yield size, window
        left -= size


def pack_documents(
    docs: DataFrame,
    encoder: Callable[[], object],
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    step_ids: int = STEP_IDS,
) -> DataFrame:
    """One row per piece of `docs` (doc_id, text): its ids (little-endian uint32) and its place.

    `encoder()` gives, on the worker, an object whose encode(texts) returns arrays of ids.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = encoder().encode
        context = TaskContext.get()
        made = (context.partitionId() if context else 0) << 36
        steps: dict[int, list[int]] = {}
        next_step = made

        def emit(names: list, arrays: list[np.ndarray]):
            nonlocal made, next_step
            rows = []
            for size, window in pack_stock([len(x) for x in arrays], tiers):
                group = steps.setdefault(size, [0, 0])
                if group[1] == 0:
                    group[0], next_step = next_step, next_step + 1
                offset = 0
                for k, start, n in window:
                    ids = arrays[k][start : start + n].tobytes()
                    rows.append((names[k], start, n, ids, len(arrays[k]), made, offset, size, group[0]))
                    offset += n
                made += 1
                group[1] = (group[1] + size) % max(size, step_ids)
                if len(rows) >= FRAME_ROWS:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

        def frame(rows):
            names = [x.strip().split(" ")[0] for x in PIECES.split(",")]
            return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

        names, arrays, held = [], [], 0
        for batch in batches:
            texts = ["" if x is None else x for x in batch["text"]]
            ids = batch["doc_id"].astype("Int64")
            for at in range(0, len(texts), 16):
                for name, own in zip(ids[at : at + 16], encode(texts[at : at + 16])):
                    names.append(None if name is pd.NA else int(name))
                    arrays.append(np.append(own, np.uint32(end_id)).astype("<u4"))
                    held += len(arrays[-1])
                if held >= STOCK_IDS:
                    yield from emit(names, arrays)
                    names, arrays, held = [], [], 0
        if arrays:
            yield from emit(names, arrays)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(pack, PIECES)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_query(docs: DataFrame, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """The pieces of `docs` with the checksum of their ids, and the ids (little-endian uint32) if asked for."""
    path = vocabulary or default_vocabulary()
    return pack_documents(docs, lambda: word_encoder(path)).select(
        "doc_id",
        *(["ids"] if keep_ids else []),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "window_length",
        "step_group",
    )


def packed_documents(spark, sf_dir: str) -> DataFrame:
    """op3: packs all documents into windows of at most 2048 ids."""
    from .common import read_table

    return pack_query(read_table(spark, sf_dir, "documents", "doc_id", "text"))
