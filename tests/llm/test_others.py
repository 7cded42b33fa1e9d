"""Chats, pseudonyms, fingerprints, lines, components."""

import hashlib
import random
import re

import pytest

from dakspark.llm import chat, components, fingerprint, linededup, pii

TURNS = "conv_id long, turn long, role string, text string, part int"


def test_chat_keeps_maximal(frame):
    a = [("user", "hi"), ("assistant", "yes"), ("user", "more")]
    rows = [(i, t, *a[t], 0) for i, n in ((1, 2), (2, 3), (3, 3), (4, 1)) for t in range(n)]
    rows += [(5, 0, "user", "no", 0), (6, 10, None, None, 0), (None, 0, "user", "x", 0)]
    got = {r["conv_id"]: r["text"] for r in chat.format_chats(frame(rows, TURNS)).collect()}
    assert set(got) == {2, 5, 6}
    assert got[2] == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in a)
    assert got[6] == "<|im_start|>user\n<|im_end|>\n"
    assert chat.format_chats(frame([], TURNS)).count() == 0


def test_chat_in_blocks(frame, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    rng = random.Random(1)
    chats = [[("user", str(rng.randrange(2))) for _ in range(rng.randint(1, 9))] for _ in range(40)]
    rows = [(i, t, *x, 0) for i, c in enumerate(chats) for t, x in enumerate(c)]
    want = {min(j for j, d in enumerate(chats) if d == c) for c in chats if not any(d[: len(c)] == c and len(d) > len(c) for d in chats)}
    got = chat.format_chats(frame(rows, TURNS)).collect()
    assert {r["conv_id"] for r in got} == want
    for i in want:
        parts = sorted((r["part"], r["text"]) for r in got if r["conv_id"] == i)
        assert "".join(t for _, t in parts).count("<|im_start|>") == len(chats[i])


def luhn(digits):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(digits[::-1])) % 10 == 0


def test_pseudonyms(frame):
    text = "mail A.b1@Mail3.example.com, +1 (555) 555-5657 10.0.0.1 card 4111 1111 1111 1111, 4111111111111112 on 2020-02-29 2020-02-30 SSN 123-45-6789 GB82WEST12345698765432."
    rows = frame([(1, text, 0), (2, "again 2020-02-29 " * 500, 0), (3, None, 0), (4, "", 0), (5, "none", 0)], "doc_id long, text string, kind int")
    got = {r["doc_id"]: r for r in pii.pseudonymise(rows, "k").collect()}
    found = {x["kind"]: (x["value"], x["pseudonym"]) for x in got[1]["pii"] if x["kind"]}
    assert set(found) == {"email", "phone", "ip", "card", "date", "ssn", "iban"}
    for kind, (value, new) in found.items():
        assert value != new and value not in got[1]["text"] and new in got[1]["text"], kind
        assert len(value) == len(new) or kind in ("ip", "iban")
    assert luhn(re.sub(r"\D", "", found["card"][1]))
    assert "4111111111111112" in got[1]["text"] and "2020-02-30" in got[1]["text"]
    assert got[2]["text"] == f"again {found['date'][1]} " * 500
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "none"
    assert pii.pseudonymise(rows.where("1 = 0"), "k").count() == 0


@pytest.mark.parametrize("shape", ["2020-01-01", "10.0.0.0", "123-45-0001"])
def test_pseudonyms_are_a_permutation(spark, shape):
    from pyspark.sql import functions as F

    if shape[:4] == "2020":
        value = F.date_add(F.lit(shape).cast("date"), F.col("id").cast("int")).cast("string")
    elif shape[:2] == "10":
        value = F.concat(F.lit("10.0."), F.floor(F.col("id") / 256).cast("string"), F.lit("."), (F.col("id") % 256).cast("string"))
    else:
        value = F.concat(F.lit("123-45-"), F.lpad((F.col("id") + 1).cast("string"), 4, "0"))
    found = spark.range(1000).select(value.alias("v")).select(pii.found_values(F.col("v"), "k")[0].alias("x")).select("x.*").collect()
    rows = spark.createDataFrame([(x["value"], x["pseudonym"]) for x in found], "v string, p string")
    assert rows.where("p IS NULL").count() == 0 and rows.select("p").distinct().count() == 1000
    assert rows.where(pii.kind_of(F.col("p")).isNull()).count() == 0


def twin(left, right, sizes, tag, key="k"):
    """The Feistel network in plain Python."""
    half = [left, right]
    for i in range(pii.ROUNDS):
        seed = f"{key}|{tag}|{i}|{half[1 - i % 2]}"
        noise = int(hashlib.sha256(seed.encode()).hexdigest()[:15], 16)
        half[i % 2] = (half[i % 2] + noise) % sizes[i % 2]
    return half


def pseudonyms(frame, values):
    rows = pii.pseudonymise(frame([(i, v) for i, v in enumerate(values)]), "k").collect()
    return {values[r["doc_id"]]: r["text"] for r in rows}


def test_feistel_against_python(frame):
    from datetime import date, timedelta

    days = [date(1999, 12, 31), date(2020, 2, 29), date(1900, 1, 1)]
    values = [f"{d:%Y-%m-%d}" for d in days] + [f"{d:%m/%d/%Y}" for d in days] + [f"{d:%d.%m.%Y}" for d in days]
    got = pseudonyms(frame, values)
    for d in days:
        n = (d - date(1900, 1, 1)).days
        a, b = twin(n // 270, n % 270, (270, 270), "date")
        new = date(1900, 1, 1) + timedelta(days=a * 270 + b)
        assert [got[f"{d:{f}}"] for f in ("%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y")] == [f"{new:{f}}" for f in ("%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y")]
    a, b = twin(415 - 200, 5552671, (800, 10**7), "phone1")
    national = f"{a + 200}{b:07d}"
    forms = ["+1 415 555 2671", "+1-415-555-2671", "+14155552671", "(415) 555-2671", "415-555-2671", "415.555.2671"]
    got = pseudonyms(frame, forms)
    assert {re.sub(r"\D", "", got[f])[-10:] for f in forms} == {national}
    assert all(re.sub("[0-9]", "9", got[f]) == re.sub("[0-9]", "9", f) for f in forms)
    forms = ["+442079460958", "+44 20 7946 0958", "+44 (20) 7946-0958"]
    assert len({re.sub(r"\D", "", x) for x in pseudonyms(frame, forms).values()}) == 1
    a, b = twin(4111111, 11111111, (10**7, 10**8), "card15")
    (card,) = pseudonyms(frame, ["4111 1111 1111 1111"]).values()
    assert luhn(re.sub(r"\D", "", card)) and re.sub(r"\D", "", card)[:-1] == f"{a:07d}{b:08d}"


def test_values_beside_others(frame):
    """Cards beside other numbers, IBANs in blocks, and what isn't valid."""
    card, iban = "4111111111111111", "GB82 WEST 1234 5698 7654 32"
    texts = ["4111 1111 1111 1111 12/26", f"{card} 123", f"50 {card}", f"pay {iban} now", "13/31/2020", "32.01.2020", "4111 1111 1111 1112"]
    rows = pii.pseudonymise(frame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, pii int, _found int"), "k")
    assert rows.columns == ["doc_id", "text", "pii", "_found", "pii_1"]
    got = {r["doc_id"]: r for r in rows.collect()}
    assert [x["kind"] for i in range(4) for x in got[i]["pii_1"] if x["kind"]] == ["card", "card", "card", "iban"]
    assert got[0]["text"].endswith(" 12/26") and got[1]["text"].endswith(" 123") and got[2]["text"].startswith("50 ")
    new = got[3]["text"].removeprefix("pay ").removesuffix(" now")
    assert re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", new) and new != iban
    assert [got[i]["text"] for i in (4, 5, 6)] == texts[4:]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def pieces(text):
    return set(re.findall(fingerprint.PARAGRAPH, text))


def test_fingerprints(frame, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 3)
    monkeypatch.setattr(fingerprint, "COARSE", 4)
    rng = random.Random(6)
    line = lambda: " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 6))) + rng.choice([".", "", "!"])
    rows = [(i * i, "\n".join(line() for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(40)] + [(5, None), (7, "é" * 900)]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(frame(rows)).collect()}
    texts = [(d, t or "") for d, t in sorted(rows, reverse=True)]
    seen = {}
    for i, (doc, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(pieces(text), pieces(edited)))
        assert r["near_next"] == pytest.approx(jaccard(pieces(text), pieces(after)))
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert seen.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]


def test_next_of_hot_ids(frame, monkeypatch):
    """A third of the rows has one id, a third has none: ranges are cut by their texts."""
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 5)
    monkeypatch.setattr(fingerprint, "COARSE", 6)
    low = -(2**63)
    rows = [(7, f"a{i}") for i in range(40)] + [(None, f"n{i}") for i in range(40)] + [(i * 3 - 50, f"t{i}") for i in range(40)] + [(low, "least"), (low + 1, "second")]
    got = {r["text"]: r["next_text"] for r in fingerprint.with_next(frame(rows)).collect()}
    seen, text = [], "t39"
    for _ in rows:
        seen.append(text)
        text = got[text]
    assert text == "t39" and len(set(seen)) == len(rows)
    ids = [{t: d for d, t in rows}[t] for t in seen]
    known = [x for x in ids if x is not None]
    assert known == sorted(known, reverse=True) and ids[len(known) :] == [None] * 40


def test_fingerprint_edges(frame):
    one = fingerprint.fingerprints(frame([(1, "a b.")])).first()
    assert one["near_next"] == 1.0
    tied = fingerprint.fingerprints(frame([(None, "x"), (None, "x"), (1, "y"), (1, "y"), (1, "z")])).collect()
    assert len(tied) == 5
    assert fingerprint.fingerprints(frame([])).count() == 0


def fuzzy(rows, percent=80):
    lines = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if line.strip(" "):
                raw = line.encode()
                lines[line] = {raw[i : i + 8] for i in range(max(1, len(raw) - 7))}
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = list(lines)
    for i, a in enumerate(names):
        for b in names[:i]:
            if 100 * len(lines[a] & lines[b]) >= percent * len(lines[a] | lines[b]):
                root[find(a)] = find(b)
    return find


def test_lines_against_brute_force(frame):
    rng = random.Random(8)
    base = [" ".join(f"word{rng.randrange(400)}" for _ in range(rng.choice([2, 12, 60, 150]))) for _ in range(25)]

    def vary(line):
        out = list(line)
        for _ in range(rng.choice([0, 0, 1])):
            out[rng.randrange(len(out))] = rng.choice("qxz")
        return "".join(out)

    rows = [(i, "\n".join([vary(rng.choice(base)) for _ in range(rng.randint(1, 6))] + ["", "tail %d" % i])) for i in range(30)]
    find, seen, want = fuzzy(rows), set(), {}
    for doc, text in rows:
        kept = []
        for line in text.split("\n"):
            if line.strip(" "):
                if find(line) in seen:
                    continue
                seen.add(find(line))
            kept.append(line)
        want[doc] = "\n".join(kept)
    got = {r["doc_id"]: r["text"] for r in linededup.dedupe_lines(frame(rows)).collect()}
    assert sum(got[d] != t for d, t in want.items()) <= 1  # banding finds all but few pairs at the threshold


def test_line_edges(frame):
    rows = [(2, "same line here\n\nown", 9, "k"), (1, "same line here", 14, "k"), (3, None, None, None), (4, "", 0, ""), (None, "same line here", 14, ""), (1, "same line here", 14, "k"), (6, "z" * 40_000, 40_000, "")]
    out = linededup.dedupe_lines(frame(rows, "doc_id long, text string, n_chars long, id string"))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = [(2, "\nown", 4, "k"), (1, "same line here", 14, "k"), (3, None, None, None), (4, "", 0, ""), (None, "", 0, ""), (1, "same line here", 14, "k"), rows[6]]
    assert got == sorted(want, key=repr)
    assert linededup.dedupe_lines(frame([])).count() == 0


def test_lines_of_few_shingles(frame):
    """Long lines that repeat themselves: in some of them no shingle's hash is in a tier's share."""
    units = [f"{w} " for w in ("The", "Aivi", "Oneaea", "ab", "x1", "qq7", "Zz", "lorem")] + ["-", "=", "+-", "| -", "*~", "#."]
    lines = [(u * 6000)[:n] for u, n in zip(units, [300, 1721, 6119] * 5)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines)), (3, "\n".join([*lines, "own"]))]
    got = {r["doc_id"]: r["text"] for r in linededup.dedupe_lines(frame(rows)).collect()}
    assert got == {1: rows[0][1], 2: "", 3: "own"}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, x) for x in range(4000, 4100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    rows = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(rows).collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(rows.limit(0)).count() == 0


def test_lines_sets_are_made_once(spark):
    from pyspark.sql import functions as F

    from dakspark.llm import linededup

    test = linededup.alike(F.col("a"), F.col("b"), 80)
    assert str(test).lower().count("cast(a as binary)") == 1 and str(test).lower().count("cast(b as binary)") == 1
    rows = [("the same line of text", "the same line of text", True), ("abc", "abc", True), ("abc", "abd", False),
            ("0123456789abcdefghij", "0123456789abcdefghik", True), ("0123456789", "012345678x", False)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select("want", test.alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_shingles_cast_outside_the_walk():
    from pyspark.sql import functions as F

    from dakspark.llm import linededup

    walk = str(linededup.shingles(F.col("a"))).lower()
    assert walk.index("cast(a as binary)") < walk.index("xxhash64")


def test_steps_over_few_edges_need_no_shuffle(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(150)] + [(7, None), (9, 9)]
    rows = spark.createDataFrame(edges, "a long, b long").repartition(5)
    plans, cut_at = [], components.cut_at
    monkeypatch.setattr(components, "cut_at", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut_at(df, name))[1])
    found = {}
    for few in (100_000, 0):
        plans.clear()
        monkeypatch.setattr(components, "FEW_EDGES", few)
        found[few] = {r["node"]: r["component"] for r in components.connected_components(rows).collect()}
        assert len(plans) > 2 and any("Exchange" in x.replace("BroadcastExchange", "") for x in plans[1:]) == (few == 0)
    assert found[0] == found[100_000] and {found[0][i] for i in range(41)} == {0}


def test_small_buckets_need_no_rounds(frame, monkeypatch):
    from dakspark.llm import buckets

    rng = random.Random(3)
    base = [" ".join(f"word{rng.randrange(300)}" for _ in range(rng.choice([6, 40, 150]))) for _ in range(12)]
    rows = [(i, "\n".join(x[: rng.randrange(20, len(x))] + "#" + x[-20:] if rng.random() < 0.2 else x.replace("d1", "e1", 1) for x in rng.sample(base, 5))) for i in range(30)]
    names, cut_at, found = [], buckets.cut_at, {}
    monkeypatch.setattr(buckets, "cut_at", lambda df, name: (names.append(name), cut_at(df, name))[1])
    for small in (linededup.SMALL, 3, 0):
        names.clear()
        monkeypatch.setattr(linededup, "SMALL", small)
        found[small] = sorted(tuple(r) for r in linededup.dedupe_lines(frame(rows)).collect())
        assert ("leaders" in names) == (small < 256)
    assert len({tuple(x) for x in found.values()}) == 1
