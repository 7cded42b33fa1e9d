"""Display forms, spelling, verification and corrections on small rows; sources and sinks on small files."""

import pytest
from pyspark.sql import functions as F

from dakspark.functions import display as D
from dakspark.functions import text as X
from dakspark.operators import correction, matching, spelling, verification
from dakspark.plans.catalogue import QUERIES
from dakspark.sources import readers, writers
from dakspark.streaming import feedback

DIR = "/root/testdata/sf0.001"


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], names).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ("31 32 a mg road", "31/32A MG Road"),
        ("no 7 b hsr layout", "No 7B HSR Layout"),
        ("no 16/17 gst road", "No. 16/17 GST Road"),
        ("no 12 2nd cross", "No. 12 2nd Cross"),
        ("", ""),
    ],
)
def test_display(spark, text, shown):
    assert one(spark, D.display("t"), t=text) == shown


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ("no12 34 mg road 2nd block tamil nadu india 600001", "No. 12/34, MG Road, 2nd Block, Tamil Nadu 600001, India"),
        ("green villa pune", "Green Villa, Pune"),
        ("pune", "Pune"),
        ("", ""),
    ],
)
def test_comma_display(spark, text, shown):
    assert one(spark, D.comma_display("t"), t=text) == shown


def test_rewrites(spark):
    ok = lambda new, old: one(spark, D.usable_rewrite(F.col("a"), F.col("b")), a=new, b=old)
    assert ok("12 temple road pune", "12 temple raod pune")
    assert not ok("14 temple road", "12 temple road") and not ok("temple", "temple") and not ok("12 road road road", "12 road")
    assert not ok("12 temple road bangalor", "12 temple road") and not ok(None, "12 temple road")


def test_unicode(spark):
    assert one(spark, X.nfkc("t"), t="ﬁne ①２") == "fine 12" and one(spark, X.nfkc("t"), t=None) is None
    assert one(spark, X.normalize_any("t"), t="दिल्ली Road") == "dilli road"
    assert one(spark, X.transliterate("t"), t="plain") == "plain"


def test_edits(spark):
    pairs = [("road", "raod", 1), ("abcd", "badc", 2), ("ab", "bxa", 2), ("road", "rd", 2), ("road", "rxyzd", 3), ("a", "a", 0)]
    rows = spark.createDataFrame(pairs, "a string, b string, n int")
    got = rows.select("n", spelling.edit_distance("a", "b").alias("d")).collect()
    assert all(r["n"] == r["d"] for r in got)
    words = spark.createDataFrame([("bxa",), ("ab",), ("qq",)], "word string")
    near = spelling.edit_neighbours_two(words, spark.createDataFrame([("ab", 3), ("road", 1)], "token string, n long"))
    assert sorted(tuple(r) for r in near.collect()) == [("bxa", "ab", 3), ("qq", "ab", 3)]


def test_cascade_stages(spark):
    vocabulary = spark.createDataFrame([("temple", 9), ("whitefield", 5), ("koramangala", 7), ("garden", 4)], "token string, n long")
    names = spark.createDataFrame([("whitefield", 5), ("koramangala", 7)], "token string, n long")
    rows = [("blr", 1, "bangalore"), ("x", 1, "cross"), ("raod", 2, "road"), ("temple", 3, "temple"), ("pune", 0, "pune"), ("12", 0, "12"),
            ("koramangla", 4, "koramangala"), ("tempel", 6, "temple"), ("zzzzzz", 9, "zzzzzz")]
    contexts = spark.createDataFrame([(w, "", "road") for w, _, _ in rows], "word string, prev string, next string")
    got = {r["word"]: (r["stage"], r["corrected"]) for r in spelling.cascade(contexts, vocabulary, names).collect()}
    assert got == {w: (s, c) for w, s, c in rows}


def test_refine_and_alignment(spark):
    assert one(spark, spelling.refine(F.col("a"), F.col("b")), a="12 zpartment whitefieldroad", b="Apartment, Whitefield Road") == "12 apartment whitefield road"
    changes = one(spark, spelling.aligned_changes(F.split("a", " "), F.split("b", " ")), a="a b c d", b="a x y d")
    assert [tuple(c) for c in changes] == [("b c", "x y")]
    protected = one(spark, spelling.protect(F.array(F.struct(F.lit("a").alias("src"), F.lit("b").alias("dst"))), F.array(F.lit("a"))))
    assert protected == []


def test_generated_addresses(spark):
    payload = '{"formatted": "4, Temple Road, Indiranagar, Pune 411001, India", "city": "Pune", "postal_code": "411001"}'
    rows = spark.createDataFrame([(1, "12 temple road indiranagar", payload), (2, "9 market street", payload), (3, "5 hill lane", None)], "k int, text string, payload string")
    rows = rows.withColumn("geocode", readers.parse_geocode("payload"))
    made = verification.generated_address(F.col("text"), F.col("geocode"), F.lit("411001"), F.lit(True), F.lit("pune"), F.lit("maharashtra"))
    got = {r["k"]: r["out"] for r in rows.select("k", made.alias("out")).collect()}
    assert got == {
        1: "12, Temple Road, Indiranagar, Pune 411001, India",
        2: "9 Market Street, Pune, Maharashtra, 411001, India",
        3: "5 Hill Lane, Pune, Maharashtra, 411001, India",
    }


def test_merge_geocodes(spark):
    rows = spark.createDataFrame([('{"formatted": "a", "city": "x"}', '{"formatted": "b", "city": "y", "state": "z"}')], "a string, b string")
    both = verification.merge_geocodes(readers.parse_geocode("a"), readers.parse_geocode("b"))
    got = rows.select(both.alias("g")).first()["g"]
    assert (got["formatted"], got["city"], got["state"]) == ("a", "y", "z")


def test_verified_matches(spark):
    texts = ["12 temple road indiranagar pune 411001", "12 temple road indiranagar pune 411002", "99 other street"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "addr_id long, c_text string").withColumn("c", X.parse("c_text"))
    record = F.struct(F.col("c.pincode").alias("pincode"), F.lit(None).cast("string").alias("state"), F.lit("pune").alias("town"), F.lit(None).cast("string").alias("district"))
    asks = spark.createDataFrame([(7, texts[0]), (8, "12 temple road indiranagar delhi 411001")], "query_id long, q_text string").withColumn("q", X.parse("q_text"))
    pairs = asks.crossJoin(corpus).withColumn("record", record)
    got = verification.verified_matches(pairs, F.col("q.road_anchor"), F.col("c.road_anchor")).collect()
    assert [(r["query_id"], r["addr_id"], r["verification_score"]) for r in got] == [(7, 0, 100.0)]


def test_reliability(spark):
    rows = spark.createDataFrame([("12 temple road pune", "12 temple road delhi"), ("12 temple road", "12 market road")], "a string, b string")
    rows = rows.withColumn("q", X.parse("a")).withColumn("c", X.parse("b"))
    sure = verification.reliable_suggestion(F.lit(0.5), F.col("q"), F.col("c"), F.col("a"), F.col("b"))
    shown = verification.reliable_display(F.lit(50.0), F.lit(80.0), F.col("q"), F.col("c"))
    assert [tuple(r) for r in rows.select(sure, shown).collect()] == [(True, True), (False, False)]


def test_corrections(spark):
    got = QUERIES["correct_addresses"](spark, DIR).collect()
    found = [r for r in got if r["status"] == "found_in_database"]
    assert len(got) == 150 and len(found) >= 120
    assert sum(r["addr_id"] == r["query_id"] for r in found) >= 0.95 * len(found)
    vocabulary = spark.createDataFrame([("road", 1)], "token string, n long")
    asks = spark.createDataFrame([(1, "x"), (2, None), (3, "5 hill lane nowhere")], "query_id long, text string")
    corpus = spark.createDataFrame([(1, "12 temple road pune 411001")], "addr_id long, text string")
    pins = spark.createDataFrame([], "pincode string, office string, district string, state string")
    rows = correction.correct_addresses(asks, corpus, vocabulary, vocabulary, pins, readers.NullGeocoder()).collect()
    assert {r["query_id"]: r["status"] for r in rows} == {1: "no_match", 2: "no_match", 3: "low_confidence"}


def test_fuzzy_share(spark):
    rows = spark.createDataFrame([(1, ["temple", "garden"], ["tempel", "other"]), (2, ["12"], ["x"])], "k int, a array<string>, b array<string>")
    got = {r["k"]: r["share"] for r in matching.fuzzy_share(rows, ["k"], "a", "b", 80.0).collect()}
    assert got == {1: 0.5, 2: 1.0}


def test_pincode_sources(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    (tmp_path / "good.json").write_text('{"pin": "560001", "officename": "GPO", "district": "Bangalore", "statename": "Karnataka"}\n')
    rows = readers.read_pincodes(spark, [str(tmp_path / "none.csv"), str(tmp_path / "bad.csv"), str(tmp_path / "good.json")])
    assert [tuple(r) for r in rows.collect()] == [("560001", "GPO", "bangalore", "karnataka")]
    with pytest.raises(OSError):
        readers.read_pincodes(spark, [str(tmp_path / "bad.csv")])
    asked = spark.createDataFrame([("560001",), ("560002",), ("560003",), ("x",)], "pincode string")
    misses = spark.createDataFrame([("560003",)], "pincode string")
    found, unknown = readers.lookup_pincodes(asked, rows, misses)
    assert found.count() == 1 and [r[0] for r in unknown.collect()] == ["560002"]


def test_prompts_and_artifacts(spark, tmp_path):
    lines = [f'{{"id": {i}, "noisy_input": "n{i}", "clean_target": "c{i}", "city": "pune"}}' for i in range(300)]
    (tmp_path / "p.jsonl").write_text("\n".join([*lines, '{"id": 900, "noisy_input": " "}', "{bad"]))
    train, held = readers.read_prompts(spark, str(tmp_path / "p.jsonl"))
    assert train.count() + held.count() == 300 and 10 <= held.count() <= 60
    assert train.first()["prompt"].endswith(" | city=pune")
    writers.publish({"a": train, "b": train}, str(tmp_path))
    writers.publish({"a": train, "c": held}, str(tmp_path))
    assert set(readers.read_artifacts(spark, str(tmp_path), ["a", "b"])) == {"a", "b"} and not (tmp_path / ".old-a").exists()
    with pytest.raises(ValueError):
        readers.read_artifacts(spark, str(tmp_path), ["a", "c"])


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id int, text string")
    writers.append_feedback(rows, str(tmp_path / "log"))
    writers.append_feedback(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert writers.rewrite_corpus(rows, str(tmp_path), "corpus").endswith("corpus-v1") and writers.rewrite_corpus(rows, str(tmp_path), "corpus").endswith("corpus-v2")
    writers.write_with_report(rows, str(tmp_path / "out"), rows.groupBy().count(), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["count"] == 1


def test_paced_calls(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    got = feedback.paced(rows, lambda r: (r["k"], 10 // (2 - r["k"])), "k long, v long, error string", seconds=0.01).collect()
    assert {(r["k"], r["v"]) for r in got if r["error"] is None} == {(1, 10), (3, -10)} and sum(r["error"] is not None for r in got) == 1


def test_backup_on_clash(spark):
    rows = spark.createDataFrame([(1, 0.5, False, "a"), (2, 0.9, False, "b")], "query_id long, confidence double, geocoded boolean, address string")
    second = spark.createDataFrame([(1, 0.4, True, "c"), (2, 0.95, True, "d")], "query_id long, confidence double, geocoded boolean, address string")
    got = {r["query_id"]: r["address"] for r in correction.better_of(rows, second).collect()}
    assert got == {1: "c", 2: "b"}


@pytest.mark.parametrize(
    ("made", "cut"),
    [(lambda: X.canonicalize("t"), "split(t,"), (lambda: D.display("t"), "lower(t)"), (lambda: X.cap_repeats(X.drop_runs(X.tokens("t"))), "split(t,"), (lambda: X.parse("t"), "lower(t)")],
)
def test_a_text_is_taken_apart_once(spark, made, cut):
    assert str(made()).count(cut) == 1


def test_aliases_by_walk(spark):
    pairs = [("  12  mg   road ", "12 mahatma gandhi road"), ("btm layout btm", "btm layout btm layout"), ("hill lane", "hill lane"), ("mg mg road", "mg mahatma gandhi road"), (None, None), ("", "")]
    rows = spark.createDataFrame(pairs, "t string, want string")
    assert [r["got"] for r in rows.select(X.canonicalize("t").alias("got")).collect()] == [w for _, w in pairs]


def test_equal_prefixes_are_suggested_once(spark):
    corpus = spark.range(60).select(F.col("id").alias("addr_id"), F.concat(F.lit("temple road "), "id").alias("text"))
    vocabulary = spark.createDataFrame([("temple", 60), ("road", 60)], "token string, n long")
    asks = spark.range(50).select(F.col("id").alias("query_id"), F.lit("templ").alias("prefix"))
    got = correction.live_suggest(asks, corpus, vocabulary, k=4).collect()
    assert len(got) == 200 and {(r["text"], r["place"]) for r in got} == {(f"temple road {i}", i + 1) for i in range(4)}


def test_ratios_by_brute_force():
    import random

    from dakspark.functions import similarity as S

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    def windows(short, long):
        n = len(short)
        own = [long[max(0, i) : i + n] for i in range(1 - n, len(long))]
        return max(200.0 * lcs(short, w) / (n + len(w)) for w in own)

    luck = random.Random(3)
    for _ in range(1500):
        a, b = ("".join(luck.choice("abcd ") for _ in range(luck.randint(1, 12))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        want = max(windows(short, long), windows(long, short) if len(a) == len(b) else 0.0)
        assert S.partial(a, b) == want and S.lcs_length(a, b) == lcs(a, b)
    assert S.partial("abbc", "middle east road x") == 25.0


def test_pool_of_pairs_is_slim(spark):
    asks = spark.createDataFrame([(1, "12 temple road pune 411001")], "query_id long, text string").withColumn("parsed", X.parse("text"))
    corpus = spark.createDataFrame([(i, f"{i} temple road pune 411001") for i in range(10, 30)], "addr_id long, text string").withColumn("parsed", X.parse("text"))
    assert correction.candidate_pairs(asks, corpus).columns == ["query_id", "addr_id", "shared"]
    best = correction.ranked_matches(asks, corpus, top=2).orderBy("rank").collect()
    assert best[0]["addr_id"] == 12 and best[0]["c"]["raw"] == "12 temple road pune 411001" and len(best) == 2


def test_best_by_shared_scores(spark):
    """The k best by groups of like rows are those of all pairs, ties, repeated words and rows without words included."""
    import random

    from dakspark.operators import retrieval

    rng = random.Random(5)
    words = lambda n: [rng.choice(["road", "road", "east", "west", f"n{rng.randint(0, 150)}"]) for _ in range(n)]
    docs = spark.createDataFrame([(i, words(rng.choice([0, 1, 3, 3, 4]))) for i in range(600)], "doc_id long, toks array<string>")
    asks = [(i, words(rng.choice([0, 1, 2, 4]))) for i in range(40)] + [(90, ["road"]), (91, ["n7"]), (92, ["nowhere"]), (93, None)]
    asks = spark.createDataFrame(asks, "query_id long, terms array<string>")
    vector = F.array(*[F.pmod(F.xxhash64("c", F.lit(i)), F.lit(7)) - 3.0 for i in range(3)])
    queries = asks.withColumn("c", F.col("query_id") % 6).select("query_id", vector.alias("vector"))
    corpus = docs.withColumn("c", F.col("doc_id") % 11).select(F.col("doc_id").alias("vec_id"), vector.alias("embedding"))
    for k in (7, 90):
        want = retrieval.top_k(retrieval.bm25(asks, docs), k, "doc_id")
        got = retrieval.bm25_top_k(asks, docs, k)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
        want = retrieval.dense_top_k(queries, corpus, k)
        got = retrieval.shared_top_k(queries, corpus, k)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_texts_spared_the_walk_hold_no_alias(spark):
    import random

    rng = random.Random(4)
    aliases = {"a": "a b", "b c": "d", "c.d": "x", "a b c": "q", "e (f": "g h"}
    texts = [" ".join(rng.choice(["a", "b", "c", "c.d", "cxd", "e", "(f", "ab", "é"]) for _ in range(rng.randrange(7))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(X.canonicalize("t", aliases).alias("a"), X._canonical(X.tokens("t"), aliases).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and sum(r["a"] != t for r, t in zip(got, texts)) > 100
