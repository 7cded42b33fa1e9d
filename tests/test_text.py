"""Scalar functions on known cases."""

import pytest
from pyspark.sql import functions as F

from dakspark.functions import similarity as S
from dakspark.functions import text as X


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("No. 12B, M.G. Road,Bangalore-560001", "no 12 b m g road bangalore 560001"),
        ("3rd Cross_15th Main", "3rd cross 15th main"),
        ("", ""),
        ("  Café   Street ", "café street"),
    ],
)
def test_normalize_v1(spark, text, want):
    assert one(spark, X.normalize_v1("t"), t=text) == want


def test_normalize_null(spark):
    assert one(spark, X.normalize_v1("t"), t=None) is None


@pytest.mark.parametrize(("text", "want"), [("12/4 5t Main, 2n Cross", "12/4 5th main 2nd cross"), ("a-b;c", "a b c")])
def test_normalize_v2(spark, text, want):
    assert one(spark, X.normalize_v2("t"), t=text) == want


def test_parse_known_address(spark):
    got = one(spark, X.parse("t"), t="RPNC Systems, 3rd Floor, Bannerghatta Road, Bengaluru-560029")
    assert got["pincode"] == "560029" and got["city"] == "bangalore" and got["road_anchor"] == "bannerghatta"
    assert got["state"] == "karnataka"


@pytest.mark.parametrize(("token", "want"), [("56029", "056029"), ("5600291", "560029"), ("560029", "560029"), ("abc", None)])
def test_repair_pincode(spark, token, want):
    assert one(spark, X.repair_pincode("t"), t=token) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("btm stage", "btm layout stage"), ("btm layout", "btm layout"), ("m g road east", "mahatma gandhi road east"), ("", "")],
)
def test_canonicalize(spark, text, want):
    assert one(spark, X.canonicalize("t"), t=text) == want


def test_sub_anchors_first_of_each(spark):
    got = one(spark, X.sub_anchors(X.tokens(F.col("t"))), t="4th block 2nd main 7th block")
    assert got == {"block": "4", "main": "2"}


@pytest.mark.parametrize(("a", "b"), [("bengaluru", "bangalore"), ("shanti", "santhi")])
def test_phonetic_pairs(spark, a, b):
    assert one(spark, X.phonetic_hash("a") == X.phonetic_hash("b"), a=a, b=b)


@pytest.mark.parametrize(("text", "want"), [("a a b a", "a b a"), ("", "")])
def test_drop_runs(spark, text, want):
    assert one(spark, F.array_join(X.drop_runs(X.tokens(F.col("t"))), " "), t=text) == want


def test_issues(spark):
    got = one(spark, X.issues("t"), t="road road nagarbangalore,delhi 15 th x560001")
    assert {"dup_token", "glued_city", "comma_no_space", "bad_ordinal", "glued_pincode"} <= set(got)


def test_join_pincode(spark):
    assert one(spark, X.join_pincode("t", F.col("p")), t="delhi 560 0 01 india", p="560001") == "delhi 560001 india"


def test_ratios_by_definition():
    assert S.ratio("", "") == 100 and S.ratio("abc", "") == 0
    assert S.ratio("abcd", "abxd") == 75
    assert S.token_sort("b a", "a b") == 100
    assert S.token_set("a b", "a b c") == 100 and S.token_set("", "a") == 0
    assert S.partial("road", "main road east") == 100


def test_lcs_against_table():
    import random

    random.seed(1)
    for _ in range(200):
        a, b = ("".join(random.choices("abc ", k=random.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert S.lcs_length(a, b) == table[-1][-1]


def test_ratios_of_many_pairs():
    """A batch gives what its pairs give one by one: long, empty, equal and odd strings included."""
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abné😀0", k=rng.choice([1, 2, 5, 9])))
    text = lambda: " ".join(word() for _ in range(rng.choice([0, 1, 2, 5, 9, 30])))
    a = [text() for _ in range(600)] + ["", "", "x\0", "a" * 64, "a" * 65, "ab " * 200, "  ", "b a"]
    b = [rng.choice([x, x[3:], x + " road", text(), text()[:64]]) for x in a[:600]] + ["", "a", "x", "b" * 64, "a" * 65, "b " * 200, "a", "a b"]
    for many, one in ((S.lcs_lengths, S.lcs_length), (S.ratios, S.ratio), (S.token_sorts, S.token_sort), (S.token_sets, S.token_set), (S.partials, S.partial)):
        assert many(a, b).tolist() == [one(x, y) for x, y in zip(a, b)]
        assert many(a[:600], b[:600]).tolist() == [one(x, y) for x, y in zip(a[:600], b[:600])]
