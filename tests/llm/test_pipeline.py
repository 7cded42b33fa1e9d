"""The pipeline's stages on the smallest tables."""

import corpus_pipeline
from dakspark.llm.packing import default_vocabulary

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == names, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] >= 100
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    vocabulary = Tokenizer.from_file(default_vocabulary())
    total = sum(len(vocabulary.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert pieces.selectExpr("sum(length)").first()[0] == total
    assert len(corpus_pipeline.STAGES) in (4, 5)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, gone_id int, bad_id string, component long"


def odd_rows(spark):
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").orderBy("item_id").first()["text"]
    one = " ".join(f"w{i}" for i in range(40))
    texts = [(1, one), (2, one + " tail"), (None, item), (None, "clean words of a row"), (7, item), (7, "other clean text about things"), (8, None), (9, ""), (10, " \n\n"), (7, item)]
    rows = [(d, t, None, "s", len(t or ""), i, "b", 0) for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


def test_rows_are_judged_by_their_own_text(spark):
    """Null and repeated ids, null, empty and blank texts, columns whose names the operators use."""
    docs, want = odd_rows(spark), {"toxicity": set(range(10)), "near_dedup": set(range(10)) - {1}, "decontamination": set(range(10)) - {2, 4, 9}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        rows = {r["gone_id"]: r for r in out.collect()}
        if name != "line_dedup":
            assert set(rows) == want[name], name
            continue
        texts = {r["gone_id"]: r["text"] for r in docs.collect()}
        # The item's lines stay where they come first: with the smallest id, and in all rows that repeat that document.
        gone = {1, 2}
        assert {k: r["text"] for k, r in rows.items() if k not in gone} == {k: t for k, t in texts.items() if k not in gone}
        assert rows[1]["text"] == "" and not rows[2]["text"].strip() and rows[1]["n_chars"] == 0


def test_empty_table(spark):
    docs = odd_rows(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns), name


def test_a_job_gives_back_memory_as_it_goes(spark, monkeypatch):
    from dakspark.llm import common

    calls = []
    monkeypatch.setattr(common, "release", calls.append)
    scratch = common.Scratch(spark)
    for i in range(2 * common.RELEASE_EVERY):
        assert scratch.cut(spark.range(i), "rows").count() == i
    assert len(calls) == 2


def test_the_driver_keeps_little_beyond_what_is_in_use(spark):
    import gc
    import time

    from dakspark.llm import common

    jvm = spark.sparkContext._jvm
    held = jvm.java.nio.ByteBuffer.allocate(600 << 20)
    del held
    gc.collect()
    time.sleep(1)  # the gateway forgets it in a thread of its own
    common.release(spark)
    heap = jvm.java.lang.management.ManagementFactory.getMemoryMXBean().getHeapMemoryUsage()
    assert heap.getUsed() < 300 << 20
    # By Java's own rule 3.3 times what is in use would stay.
    assert heap.getCommitted() <= 2 * heap.getUsed() + (16 << 20)


def test_release_trims_memory_outside_the_heap(spark, monkeypatch):
    from dakspark.llm import common

    asked, array = [], common._array

    def seen(spark, kind, items):
        items = list(items)
        asked.extend(x for x in items if isinstance(x, str))
        return array(spark, kind, items)

    monkeypatch.setattr(common, "_array", seen)
    monkeypatch.setattr(common, "Py4JError", ZeroDivisionError)  # so that a failure shows
    common.release(spark)
    assert asked == ["systemTrimNativeHeap"]
