"""Packing as an exact round trip."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from dakspark.llm.packing import default_vocabulary, pack_documents, pack_query, pack_stock, word_encoder


def test_windows_are_full_and_whole():
    rng = random.Random(2)
    for _ in range(40):
        lengths = [rng.choice([1, 3, rng.randint(1, 60), rng.randint(1, 6000)]) for _ in range(rng.randint(0, 200))]
        pieces = [[] for _ in lengths]
        for size, window in pack_stock(lengths):
            assert sum(n for _, _, n in window) == size and size <= 2048 and size & (size - 1) == 0
            for k, start, n in window:
                pieces[k].append((start, n))
        for n, own in zip(lengths, pieces):
            assert sum(x for _, x in own) == n
            at = 0
            for start, size in sorted(own):
                assert start == at and size > 0
                at += size


def texts():
    rng = random.Random(3)
    words = ["Hello,", "world's", "don't", "naïve", "ÉTÉ", "12.5", "<|endoftext|>", "İx", "ß", "...?", "a"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 30, 3000])))) for i in range(40)]
    return rows + [(100, None), (101, ""), (102, "x" * 60_000), (3, rows[3][1])]


def test_round_trip(spark, frame):
    rows = texts()
    vocabulary = Tokenizer.from_file(default_vocabulary())
    want = sorted(
        (d, np.array([*vocabulary.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t in rows
    )
    path = default_vocabulary()
    pieces = pack_documents(frame(rows).repartition(3), lambda: word_encoder(path)).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    got = []
    for doc, own in by_doc.items():
        # A repeated row gives each of its pieces again.
        copies = sum(r[0] == doc for r in rows)
        whole = sorted({(p["start"], bytes(p["ids"])) for p in own}) if copies == 1 else None
        if whole is not None:
            got.append((doc, b"".join(x for _, x in whole)))
        assert sum(p["length"] for p in own) == copies * own[0]["doc_tokens"]
    assert [w for w in want if w[0] != 3] == sorted(got)
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        assert at == own[0]["window_length"] <= 2048


def test_query_checksums(frame):
    rows = [(1, "one two"), (None, "three")]
    ids = Tokenizer.from_file(default_vocabulary()).encode("one two", add_special_tokens=False).ids
    got = {r["doc_id"]: r for r in pack_query(frame(rows).coalesce(1)).where("doc_id = 1 AND start = 0").collect()}
    first = got[1]["length"]
    assert got[1]["ids_crc32"] == zlib.crc32(np.array([*ids, 1][:first], "<u4").tobytes())
    assert pack_query(frame([])).count() == 0


def test_words_of_a_cleared_store_are_learned_once_a_batch(monkeypatch):
    from dakspark.llm import packing

    monkeypatch.setattr(packing, "KEPT_WORDS", 40)
    rng = random.Random(4)
    rare = ["".join(rng.choices("abcdé'9.-", k=rng.randint(1, 8))) for _ in range(600)]
    batches = [[" ".join(["the", "Road", "x<|y", *rng.choices(rare, k=rng.choice([0, 3, 30]))][:: rng.choice([1, 1, 2])]) for _ in range(8)] for _ in range(40)]
    encoder, vocabulary = packing.WordEncoder(default_vocabulary()), Tokenizer.from_file(default_vocabulary())
    batches += [["'s 'still 'll it's we've'd ''s", "don't\tstop\x0b", "", "a\u00a0b"]]
    learn, calls = encoder._learn, []
    encoder._learn = lambda words: (calls.append(len(words)), learn(words))
    for texts in batches:
        got = [x.tolist() for x in encoder.encode(texts)]
        assert got == [vocabulary.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(calls) <= len(batches)


def test_words_in_use_are_kept_when_the_store_is_renewed(monkeypatch):
    from dakspark.llm import packing

    monkeypatch.setattr(packing, "KEPT_WORDS", 200)
    encoder, vocabulary = packing.WordEncoder(default_vocabulary()), Tokenizer.from_file(default_vocabulary())
    tokenizer, seen = encoder.tokenizer, []
    used = [f"straße{chr(97 + i)}" for i in range(20)]
    plain = encoder._word
    encoder._word = lambda word: (seen.append(word), plain(word))[1]
    for i in range(100):
        texts = [" ".join([*used, *(f"w{chr(97 + i % 26)}{chr(97 + j)}{chr(97 + i // 26)}q," for j in range(10))])]
        assert encoder.encode(texts)[0].tolist() == vocabulary.encode(texts[0], add_special_tokens=False).ids
    assert encoder.tokenizer is tokenizer and max(map(seen.count, used)) == 1
    assert len(encoder.known) + len(encoder.older) <= 400
