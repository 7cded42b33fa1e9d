"""Winnowing against brute force, by broadcast and by shuffle."""

import hashlib
import random
import re

import pytest

from dakspark.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        words = split(text)
        k = min(13, len(words))
        if item is not None and k:
            for i in range(len(words) - k + 1):
                windows.setdefault(tuple(words[i : i + k]), set()).add(str(item))
    out = []
    for doc, text in docs:
        words, hit, found = split(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(words) - k + 1):
                if own := windows.get(tuple(words[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


def sample():
    rng = random.Random(3)
    words = "a b c dd é É x1 zz Q".split()
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 7, 9, 12, 13, 14, 20, 40]))) for i in range(60)]
    docs = []
    for i in range(200):
        own = text(rng.randint(0, 40))
        if rng.random() < 0.6:
            own += " " + rng.choice(items)[1] + " " + text(rng.randint(0, 20))
        docs.append((i if i % 50 else None, own))
    docs += [(5, "a b"), (6, None), (7, ""), docs[9], docs[9], (8, "a b c dd " * 4000)]
    return docs, [*items, (3, text(14)), (None, "a b c"), (70, None), (71, ""), (72, " . ")]


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_against_brute_force(frame, monkeypatch, limit):
    docs, items = sample()
    whole = decontam.maybe_broadcast
    monkeypatch.setattr(decontam, "maybe_broadcast", lambda df, row_bytes: whole(df, row_bytes, limit))
    got = decontam.contamination(frame(docs), frame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)


def test_empty_tables_and_columns(frame):
    items = frame([], "item_id long, text string")
    assert decontam.contamination(frame([(1, "a b")]), items).first()["contaminated"] is False
    assert decontam.contamination(frame([]), frame([(1, "a b")], "item_id long, text string")).count() == 0
    long = " ".join(f"w{i}" for i in range(15))
    rows = frame([(1, long, 3), (2, "clean words", 4)], "doc_id long, text string, item_id long")
    kept = decontam.drop_contaminated(rows, frame([(1, long)], "item_id long, text string"))
    assert [tuple(r) for r in kept.collect()] == [(2, "clean words", 4)]


def test_words_that_repeat(frame):
    """Runs of short periods, where document and item may keep different ones of equal k-grams."""
    rng = random.Random(4)
    items, docs = [], []
    for i in range(60):
        unit = [f"u{i}x{j}" for j in range(1 + i % 6)]
        run = (unit * 20)[: rng.choice([13, 14, 16, 20])]
        own = lambda n: [f"o{rng.randrange(10**6)}" for _ in range(n)]
        items.append((i, " ".join(own(rng.randrange(9)) + run + own(rng.randrange(9)))))
        docs += [(10 * i + k, " ".join(own(rng.randrange(30)) + run + own(rng.randrange(30)))) for k in range(4)]
    got = decontam.contamination(frame(docs), frame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)


def test_rows_go_for_their_own_text(frame):
    """Null and repeated ids: clean texts under the id of a contaminated one stay; extra columns may clash."""
    long = " ".join(f"w{i}" for i in range(15))
    rows = [(None, long, 1), (None, "clean words here", 2), (5, long, 3), (5, "other clean text", 4), (1, "clean", 5), (2, None, 6)]
    docs = frame(rows, "doc_id long, text string, bad_id int")
    kept = decontam.drop_contaminated(docs, frame([(1, long)], "item_id long, text string"))
    assert sorted(r["bad_id"] for r in kept.collect()) == [2, 4, 5, 6] and kept.columns == docs.columns


def test_long_texts_cost_their_length(frame):
    """Blocks are bounded, so that a window at any place of a long text is found, short items among them."""
    rng = random.Random(9)
    words = [f"o{rng.randrange(10**5)}" for _ in range(3000)]
    items = [(1, "rare pair"), (2, " ".join(f"i{k}" for k in range(20)))]
    for at in (0, 250, 255, 256, 257, 1500, 2985):
        words[at : at + 2] = ["rare", "pair"]
    for at in (240, 500, 1020, 2970):
        words[at : at + 20] = [f"i{k}" for k in range(20)]
    docs = [(1, " ".join(words))]
    got = decontam.contamination(frame(docs), frame(items, "item_id long, text string"))
    assert [tuple(r) for r in got.collect()] == brute(docs, items)
