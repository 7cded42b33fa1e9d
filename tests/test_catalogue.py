"""Every query with SQL against DuckDB on the smallest tables; streaming and sources on small files."""

import duckdb
import pytest
from pyspark.sql import functions as F

from dakspark.plans.catalogue import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    return con


def plain(value):
    if hasattr(value, "as_tuple"):
        value = float(value)
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    order = [want.columns.index(c) for c in cols]
    assert mine == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_noisy_queries_find_their_address(spark):
    row = QUERIES["hit_at_k"](spark, DIR).first()
    assert row["hit_at_1"] >= 0.95 and row["hit_at_5"] >= 0.99


def test_readers_and_writers(spark, tmp_path):
    from dakspark.sources import readers, writers

    (tmp_path / "raw.csv").write_text('raw_address\n"12, MG Road"\n\n"  "\n')
    assert [r[0] for r in readers.read_raw_csv(spark, str(tmp_path / "raw.csv")).collect()] == ["12, MG Road"]
    (tmp_path / "pairs.jsonl").write_text('{"id": 1, "raw_address": "a road"}\n{bad\n')
    assert readers.read_pairs(spark, str(tmp_path / "pairs.jsonl")).where("id = 1").count() == 1
    pins = spark.createDataFrame([("560001", "b", "X", "Y"), ("560001", "a", "X", "Y"), ("56", "c", "X", "Y")], "PinCode string, officename string, District string, StateName string")
    assert readers.pincode_dimension(pins).collect()[0][:2] == ("560001", "a")
    writers.publish({"one": pins, "two": pins}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "one")).count() == 3 and not (tmp_path / ".staged-one").exists()


def test_geocoders(spark):
    from dakspark.sources import readers

    answers = spark.createDataFrame([("mg road", '{"lat": 12.9, "lon": 77.6, "location_type": "ROOFTOP"}')], "query string, payload string")
    rows = spark.createDataFrame([("MG Road",), ("other",)], "text string")
    got = {r["text"]: r["geocode"] for r in readers.select_geocoder(answers).geocode(rows, "text").collect()}
    assert got["MG Road"]["precision"] == 1.0 and got["other"] is None
    assert readers.select_geocoder().geocode(rows, "text").where("geocode IS NOT NULL").count() == 0


def test_bandit_stream_is_the_mean(spark, tmp_path):
    from dakspark.streaming import feedback

    rows = [("a", 1.0), ("a", 0.0), ("b", 1.0), ("a", 1.0)]
    spark.createDataFrame(rows, "arm string, reward double").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("arm string, reward double").json(str(tmp_path / "in"))
    done = feedback.run_once(feedback.bandit_stream(stream), "arms", str(tmp_path / "state"), "update")
    got = {r["arm"]: (r["pulls"], round(r["value"], 6)) for r in done.collect()}
    assert got == {"a": (3, 0.666667), "b": (1, 1.0)}


def test_feedback_labels(spark):
    from dakspark.streaming import feedback

    rows = spark.createDataFrame([("1",), ("Correct",), ("0",), ("maybe",), (None,)], "label string")
    good, bad = feedback.split_feedback(rows)
    assert sorted(r["label"] for r in good.collect()) == [0, 1, 1] and bad.count() == 2


def test_ranker_trains(spark):
    from dakspark.operators import ranking

    rows = [(i / 40, 0.5, i / 40, 0.5, 0.5, 0.5, 0.0, 1.0, float(i >= 20)) for i in range(40)]
    frame = spark.createDataFrame(rows, list(ranking.FEATURES) + ["label"])
    model = ranking.train_ranker(frame, trees=3, depth=2)
    assert model.transform(frame).where("prediction = label").count() >= 38


def test_upsert_keeps_hits(spark):
    from dakspark.operators import tables

    old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    new = spark.createDataFrame([(1, None), (2, "z"), (3, "w")], "k int, v string")
    assert {tuple(r) for r in tables.upsert(old, new, "k", "v").collect()} == {(1, "x"), (2, "z"), (3, "w")}


def test_number_that_ends_a_pincode_still_meets(spark):
    from dakspark.functions import text as X
    from dakspark.operators import matching

    pairs = [("No 17, mg road, 5 layout 500017", "No 17, mg road, 3 layout 500017", True), ("No 17, mg road, 5 layout 500017", "No 4, mg road, 3 layout 500017", False),
             ("No 17, mg road 500017", "No 4, mg road 500017", True)]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", X.parse("a").alias("q"), X.parse("b").alias("c"))
    assert all(r["want"] == r["got"] for r in rows.select("want", matching.structured_gate(F.col("q"), F.col("c")).alias("got")).collect())


def test_place_has_all_its_rows(spark):
    from dakspark.operators import blocking

    corpus = spark.range(30).select(F.col("id").alias("addr_id"), F.lit("560001").alias("pincode"), F.lit("pune").alias("city"), F.lit("mg road").alias("text"))
    asks = spark.createDataFrame([(1, "560001", "pune", ["mg"])], "query_id long, pincode string, city string, terms array<string>")
    assert blocking.geo_then_keywords(asks, corpus, least=3, top=5).count() == 30


def most_rows(rows):
    """The largest number of rows that any step of a query's plan gave out, the query run."""
    rows.collect()

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        if name == "ReusedExchangeExec":
            return 0
        own = plan.metrics().get("numOutputRows")
        kids = plan.children()
        return max([own.get().value() if own.isDefined() else 0, *[walk(kids.apply(i)) for i in range(kids.size())]])

    return walk(rows._jdf.queryExecution().executedPlan())


def test_equal_queries_are_answered_once(spark):
    from dakspark.operators import blocking, retrieval

    corpus = spark.range(400).select(F.col("id").alias("addr_id"), F.concat(F.lit("temple road "), "id").alias("text"))
    asks = spark.range(300).select(F.col("id").alias("query_id"), F.array(F.lit("temple"), F.lit("road")).alias("terms"), F.lit("temp").alias("prefix"))
    blocks = blocking.keyword_block(asks, corpus, top=5)
    found = retrieval.prefix_matches(asks, corpus, k=5)
    assert most_rows(blocks) <= 3000 and most_rows(found) <= 3000
    for rows in (blocks, found):
        assert {(r["addr_id"], r["rank"]) for r in rows.collect()} == {(i, i + 1) for i in range(5)} and rows.count() == 1500


def test_rows_of_like_terms_keep_their_order(spark):
    from dakspark.operators import blocking

    corpus = spark.createDataFrame([(1, "a x"), (2, "a b"), (3, "b a a"), (4, "c"), (5, "a b c"), (6, "b c")], "addr_id long, text string")
    asks = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a"]), (3, ["c"]), (4, ["a", "b", "c"]), (5, [])], "query_id long, terms array<string>")
    got = sorted(tuple(r) for r in blocking.keyword_block(asks, corpus, top=3).collect())
    ab = [(2, 2, 1), (3, 2, 2), (5, 2, 3)]
    assert got == [(q, *r) for q in (1, 2) for r in ab] + [(3, 4, 1, 1), (3, 5, 1, 2), (3, 6, 1, 3), (4, 2, 2, 2), (4, 3, 2, 3), (4, 5, 3, 1)]
