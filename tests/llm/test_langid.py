import zlib

import numpy as np
from pyspark.sql import functions as F

from planlake.llm import langid
from planlake.llm._io import table


def test_held_out_accuracy(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    got = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 300 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)


def test_odd_rows(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.fit(docs)
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (None, "the and of this", "x"), (4, "the and of this that it " * 9000, "x"), (4, "the", "x"), (5, "\x00\u4e00", "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, held_out string")
    got = sorted((r["doc_id"] or 0, r["lang_pred"], r["held_out"], 0 <= r["score"] <= 1) for r in langid.predict(odd, model).collect())
    assert [g[0] for g in got] == [0, 1, 2, 3, 4, 4, 5] and all(g[3] for g in got)
    assert [g[1] for g in got][1:4] == ["und"] * 3 and ("en" in {g[1] for g in got})
    assert all(g[2] == (g[0] != 0 and zlib.crc32(str(g[0]).encode()) % 3 == 1) for g in got)
    assert {r["doc_id"] for r in langid.identified(odd, model).collect()} >= {None, 4} and not {1, 2, 3} & {r["doc_id"] for r in langid.identified(odd, model).collect()}
    assert langid.fit(docs.limit(0)) is None and langid.predict(odd, None).where(F.col("lang_pred") != "und").count() == 0
    assert langid.predict(docs.limit(0), model).count() == 0


def test_network_is_a_convolution():
    """Pooled values and probabilities against plain loops over filters and places."""
    rng = np.random.default_rng(3)
    texts = ["the cat sat", "el gato", "die Katze sitzt", "x"]
    model = langid.train(texts, ["en", "es", "de", "en"], epochs=2)
    for text in texts:
        data = np.frombuffer(text.encode() + bytes(rng.integers(97, 99, 40).tolist()), np.uint8)
        window = langid.windows_of(data, np.array([0]), np.array([len(data)]))
        x = model.embed[window[0]]
        pooled = []
        for i, width in enumerate(langid.WIDTHS):
            for f in range(langid.FILTERS):
                kernel = model.filters[:, i * langid.FILTERS + f].reshape(-1, langid.EMBED)
                assert not kernel[width:].any()
                pooled.append(max(float((x[t : t + width] * kernel[:width]).sum()) for t in range(langid.WINDOW - max(langid.WIDTHS) + 1)))
        h = np.maximum(np.array(pooled) + model.bias, 0)
        e = np.exp(h @ model.dense + model.dense_bias)
        assert np.allclose(model.probabilities(window)[0], e / e.sum(), atol=1e-4)


def test_predictions_are_those_of_all_windows(spark, sf):
    """Every document against a plain loop over its own windows."""
    docs = table(spark, sf, "documents")
    model = langid.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in langid.predict(docs, model).collect():
        data = np.frombuffer((texts[r["doc_id"]] or "").encode(), np.uint8)
        if not any(c.isalpha() for c in texts[r["doc_id"]] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        total = np.zeros(len(model.labels))
        for at in range(0, len(data), langid.WINDOW):
            size = min(langid.WINDOW, len(data) - at)
            total += size * model.probabilities(langid.windows_of(data, np.array([at]), np.array([at + size])))[0]
        assert r["lang_pred"] == model.labels[total.argmax()] and abs(r["score"] - total.max() / len(data)) < 1e-4


def test_every_label_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ALL", 150)
    docs = spark.createDataFrame([(i, f"{'abcdefgh'[i % 7] * 9} {i % 80}", f"l{i % 80}" if i % 80 else "") for i in range(4000)], "doc_id long, text string, lang string")
    rows = langid.training_rows(docs).collect()
    assert len({r["lang"] for r in rows}) == 80 and "" in {r["lang"] for r in rows} and len(rows) == 80


def test_training_never_sees_held_out_or_unlabelled(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en" if i % 2 else None) for i in range(60)], "doc_id long, text string, lang string")
    seen = {r["text"] for r in langid.training_rows(docs).collect()}
    assert seen == {f"text {i}" for i in range(60) if i % 2 and zlib.crc32(str(i).encode()) % 3 != 1}


def test_repeated_rows_leave_no_label_out(spark):
    rows = [(k, f"lang{k}", f"text {k}") for k in range(30) for _ in range(300)] + [(1000 + i, "common", f"w{i}") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = [r["lang"] for r in langid.training_rows(docs).collect()]
    held = {f"lang{k}" for k in range(30) if zlib.crc32(str(k).encode()) % 3 == 1}
    assert set(got) == {f"lang{k}" for k in range(30)} - held | {"common"} and all(got.count(x) == 1 for x in set(got) - {"common"})
    assert got.count("common") == langid.SAMPLE_DOCS
