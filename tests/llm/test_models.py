"""Trained models: gradients by differences, held-out accuracy, defined cases."""

import numpy as np

from dakspark.llm import gated, langid, toxicity

DIR = "/root/testdata/sf0.01"


def test_convolution_gradients():
    rng = np.random.default_rng(0)
    net = langid.ByteConvNet(3, filters=3, dim=2)
    windows, labels = rng.integers(0, 256, (4, 16)).astype(np.uint8), np.array([0, 1, 2, 1])
    for name in ("vectors", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))

    def loss():
        return -net.log_probabilities(windows)[np.arange(4), labels].mean()

    # The stride trick reads 4-byte floats, so differences are taken in single precision.
    for name in ("vectors", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float32))
    for name, grad in net._gradients(windows, labels).items():
        values = getattr(net, name)
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        values[at] += 0.01
        high = loss()
        values[at] -= 0.02
        low = loss()
        values[at] += 0.01
        assert abs((high - low) / 0.02 - grad[at]) < 0.02 * abs(grad[at]) + 2e-3


def test_windows_cover_all_bytes():
    for n in (0, 1, 255, 256, 257, 1000):
        windows, sizes = langid.cut_windows(b"a" * n, 256)
        assert sizes.sum() == n and windows.size >= n


def test_language_held_out(spark):
    rows = langid.document_languages(spark, DIR).join(spark.read.parquet(f"{DIR}/documents.parquet"), "doc_id")
    good = rows.where("held_out AND lang_pred = lang").count()
    assert good >= 0.95 * rows.where("held_out").count()


def test_language_edges(frame):
    learned = frame([(i, "the cat sat " * 5, "en") for i in range(20)] + [(i, "le chat noir " * 5, "fr") for i in range(20, 40)] + [(50, None, "en"), (51, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit_language_model(learned)
    rows = frame([(1, None), (2, ""), (3, "123 !"), (4, "the cat " * 3000), (None, "le chat")])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict_languages(rows, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and got[None][0] == "fr"
    assert langid.fit_language_model(learned.where("1 = 0")) is None
    assert [r["lang_pred"] for r in langid.predict_languages(rows, None).collect()] == ["und"] * 5
    assert langid.predict_languages(frame([]), model).count() == 0


def test_recurrent_gradients():
    net = gated.GatedNet(["a", "b", "cd"])
    for name in net.PARTS:
        setattr(net, name, getattr(net, name).astype(np.float64))
    windows, labels = [["a", "cd", "x"], ["b"], [], ["zz", "a"] * 12], np.array([1.0, 0, 1, 0])
    words = sorted({w for x in windows for w in x})

    def loss():
        table = net.project(words)
        index, sizes = np.zeros((4, gated.WINDOW), int), np.array([len(x) for x in windows])
        for i, x in enumerate(windows):
            index[i, : len(x)] = [words.index(w) for w in x]
        z = net.logits(table, index, sizes)
        return np.mean(np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels))

    for name, grad in net.gradients(windows, labels).items():
        values, at = getattr(net, name), np.unravel_index(np.abs(grad).argmax(), grad.shape)
        values[at] += 1e-3
        high = loss()
        values[at] -= 2e-3
        low = loss()
        values[at] += 1e-3
        assert abs((high - low) / 2e-3 - grad[at]) < 1e-3


def test_windows_overlap_and_cover():
    for n in (0, 1, 24, 25, 40, 41, 100, 1001):
        begin = gated.windows_of(n)
        assert begin[0] == 0 and begin[-1] + gated.WINDOW >= n
        assert all(b - a == gated.STRIDE for a, b in zip(begin, begin[1:]))


def toxic_rows():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(240):
        text = list(rng.choice(words, 60))
        if i % 4 == 0:
            text[int(rng.integers(60))] = "vilest"
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    return docs, labels


def test_toxicity_finds_rare_words(frame):
    docs, labels = toxic_rows()
    net = toxicity.fit_toxicity(frame(docs), frame([*labels, (7, None)], "doc_id long, toxic int"))
    long = " ".join(["w1"] * 5000 + ["vilest"] + ["w2"] * 5000)
    rows = [(1, "w3 w4 vilest w5"), (2, "w3 w4 w5 w6"), (3, None), (4, ""), (5, long), (None, "w7")]
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score_toxicity(frame(rows), net).collect()}
    assert got[1][1] == 1 and got[5][1] == 1 and got[2][1] == 0
    assert all(0 <= s <= 1 for s, _ in got.values()) and got[3] == got[4]
    assert toxicity.fit_toxicity(frame(docs), frame([(1, 0)], "doc_id long, toxic int")) is None
    assert toxicity.score_toxicity(frame([]), net).count() == 0
    kept = toxicity.keep_clean(frame([(d, t, 1) for d, t in docs], "doc_id long, text string, score int"), frame(labels, "doc_id long, toxic int"))
    assert kept.columns == ["doc_id", "text", "score"] and 170 <= kept.count() <= 190
