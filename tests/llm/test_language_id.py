import zlib

import numpy as np

from quire.llm import langid, queries


def test_gradients_agree_with_differences():
    draw = np.random.default_rng(1)
    net = langid.Network(["a", "b", "c"], hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x = draw.integers(0, 256, (4, 6)).astype(np.uint8)
    lengths, of, weight = np.array([6, 4, 1, 6]), np.array([0, 1, 2, 0]), np.ones(4)
    _, grads = net.gradients(x, lengths, of, weight)
    for name in ("fwz", "fuz", "bur", "bun", "bwn", "out", "bias"):
        w = net.w[name]
        places = np.argwhere(np.abs(grads[name]) > 1e-4)
        for at in map(tuple, places[:: max(1, len(places) // 4)]):
            old, step = w[at], 1e-2
            w[at] = old + step
            up, _ = net.gradients(x, lengths, of, weight)
            w[at] = old - step
            down, _ = net.gradients(x, lengths, of, weight)
            w[at] = old
            assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-3


def plain(net, text):
    """Mean label probabilities of a text, one byte and one gate at a time."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    raw, w, k = text.encode(), {n: x.astype(np.float64) for n, x in net.w.items()}, net.hidden
    total = np.zeros(len(net.labels))
    for at in range(0, len(raw), langid.SEGMENT):
        part = raw[at : at + langid.SEGMENT]
        filled = part + bytes(langid.SEGMENT - len(part))
        states = {}
        for way in "fb":
            h, out = np.zeros(k), [None] * langid.SEGMENT
            for t in range(langid.SEGMENT) if way == "f" else reversed(range(langid.SEGMENT)):
                b = filled[t]
                z = sigmoid(w[way + "wz"][b] + h @ w[way + "uz"])
                r = sigmoid(w[way + "wr"][b] + h @ w[way + "ur"])
                n = np.tanh(w[way + "wn"][b] + r * (h @ w[way + "un"]))
                h = z * h + (1 - z) * n
                out[t] = h
            states[way] = out
        for t in range(len(part)):
            x = np.concatenate([states["f"][t], states["b"][t]]) @ w["out"] + w["bias"]
            e = np.exp(x - x.max())
            total += e / e.sum()
    return total / max(1, len(raw))


def test_inference_by_a_plain_loop():
    draw = np.random.default_rng(4)
    texts = ["", "a", "Ein kurzer Satz.", "é" * 60, "x" * 96, "y" * 97, "".join(map(chr, draw.integers(32, 300, 500)))]
    for scale in (1.0, 40.0):  # the second takes logits far beyond what exponentials hold
        net = langid.Network(["a", "b", "c"], hidden=5)
        net.w["out"] *= scale
        net.w["bias"] = net.w["bias"] - np.float32(200.0 * (scale > 1))
        found = langid.pooled(net, texts)
        expected = np.array([plain(net, t) if t else np.zeros(3) for t in texts])
        assert np.isfinite(found).all() and np.abs(found - expected).max() < 2e-4 * scale


def test_held_out_accuracy(spark, medium):
    found = queries.op1_language_id(spark, medium).toPandas()
    docs = spark.read.parquet(f"{medium}/documents.parquet").toPandas()
    both = found.merge(docs, on="doc_id")
    assert (both["held_out"] == both["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert len(both) == len(docs)
    letters = both["text"].map(lambda t: t is not None and any(map(str.isalpha, t)))
    assert (both["lang_pred"][~letters] == "und").all()
    assert both["score"].between(0, 1).all()
    test = both[both["held_out"] & letters & both["lang"].notna()]
    assert (test["lang_pred"] == test["lang"]).mean() > 0.95


def test_predictions_read_nothing_but_text(spark, small):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs)
    a = langid.predict(docs, model).select("doc_id", "lang_pred", "score").toPandas()
    b = langid.predict(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None)), model).select("doc_id", "lang_pred", "score").toPandas()
    assert a.equals(b)


def test_odd_rows(odd, none):
    rows = langid.identify(odd).collect()
    assert len(rows) == 12
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert by[1] == by[2] == by[3] == by[9] == ("und", 0.0)
    assert by[4][0] in {"de", "en", "fr"}
    assert langid.identify(none).count() == 0
    kept = langid.keep_known(odd)
    assert kept.columns == odd.columns and 9 not in {r["doc_id"] for r in kept.collect()}
    assert langid.keep_known(none).count() == 0


def test_nothing_to_learn(make_docs):
    docs = make_docs([(1, "some text", None), (2, None, "de"), (3, "123", None)])
    assert {r["lang_pred"] for r in langid.identify(docs).collect()} == {"und"}
    assert [r["doc_id"] for r in langid.keep_known(docs).collect()] == [1]
