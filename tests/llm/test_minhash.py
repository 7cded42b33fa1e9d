"""Near-duplicates against brute force."""

import random

import pytest

from dakspark.llm.minhash import drop_near_duplicates, near_duplicates


def brute(rows, width=4, percent=80):
    sets = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = (text or "").encode().lower().split()
        k = min(width, len(words))
        sets[doc] = frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def run(frame_):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(frame_, width=4).collect()}


def edited(words, rate, rng):
    return " ".join(w if rng.random() > rate else f"x{rng.randrange(10**6)}" for w in words)


def test_against_brute_force(frame):
    rng = random.Random(4)
    rows, doc = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(rng.choice([1, 4, 25])):
            rows.append((doc, edited(base, rng.choice([0, 0.005, 0.02, 0.05, 0.1]), rng)))
            doc += 1
    shared = " ".join(f"p{i}" for i in range(40))
    rows += [(doc + i, shared + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))) for i in range(25)]
    rng.shuffle(rows)
    assert run(frame(rows)) == brute(rows)


def test_edges(frame):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "É x"), (8, "é x"), (9, "a b c d " * 5000), (10, "a b c d " * 5000), (None, "one")]
    assert run(frame(rows)) == brute(rows)


def test_empty_and_clashing_columns(frame):
    assert near_duplicates(frame([])).count() == 0
    rows = [(1, "a b c d e f", 7, 8), (2, "a b c d e f", 7, 8)]
    out = drop_near_duplicates(frame(rows, "doc_id long, text string, id long, component long"))
    assert [tuple(r) for r in out.collect()] == [rows[0]] and out.columns == ["doc_id", "text", "id", "component"]


@pytest.mark.parametrize("ids", [(1, 1, 2)])
def test_repeated_ids(frame, ids):
    rows = [(ids[0], "a b c d e"), (ids[1], "a b c d e"), (ids[2], "a b c d e")]
    assert run(frame(rows)) == {1: (2, 1, True), 2: (2, 1, False)}


def test_rows_go_for_their_own_text(frame):
    """Texts under a null or repeated id that were not compared stay."""
    copy = "a b c d e f"
    rows = [(1, copy, 1), (2, copy, 2), (2, copy + " and other words after it", 3), (None, copy, 4), (None, "x", 5), (3, None, 6)]
    out = drop_near_duplicates(frame(rows, "doc_id long, text string, gone_id int"))
    assert sorted(r["gone_id"] for r in out.collect()) == [1, 3, 4, 5, 6]
