from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.conftest import DATA
from vellumine.llm import langid, tokens


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = langid.predict_language(docs, langid.fit_language(docs)).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    kept = found[found.held_out]
    assert len(kept) > 20 and (kept.lang == kept.lang_pred).mean() >= 0.95
    assert found.score.between(0, 1).all()


def test_fit_sees_only_labelled_training_rows(spark):
    rows = [(i, "aaaa bbbb" if i % 2 else "xxxx yyyy", "A" if i % 2 else "X") for i in range(200)]
    lies = [(i, t, "held" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    net = langid.fit_language(spark.createDataFrame([*lies, (900, "zzz", None)], "doc_id long, text string, lang string"))
    assert net.labels == ["A", "X"]
    found = langid.predict_language(spark.createDataFrame([(1, "aaaa bbbb"), (2, "yyyy xxxx")], "doc_id long, text string"), net)
    assert {r.doc_id: r.lang_pred for r in found.collect()} == {1: "A", 2: "X"}


def test_undetermined_and_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    net = langid.fit_language(docs)
    rows = [(1, None), (2, ""), (3, "12 34 --"), (4, "é"), (None, "the and of"), (6, "the of and " * 30000), (6, "the of and " * 30000)]
    frame = spark.createDataFrame([(*r, "x", 9.0) for r in rows], "doc_id long, text string, lang string, score double")
    found = langid.predict_language(frame, net).collect()
    by_id = {r.doc_id: r for r in found}
    assert [by_id[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [by_id[i].score for i in (1, 2, 3)] == [0.0] * 3
    assert by_id[4].lang_pred in net.labels and by_id[None].held_out is False
    assert len(found) == 7 and by_id[6].lang_pred == "en"
    assert langid.predict_language(frame.where("false"), net).count() == 0


def test_nothing_labelled(spark):
    frame = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    net = langid.fit_language(frame)
    assert net is None
    assert [(r.lang_pred, r.score) for r in langid.predict_language(frame, net).collect()] == [("und", 0.0)]
    assert langid.keep_languages(frame, net, 0.4).count() == 0


def test_windows_cover_every_byte():
    texts = ["a" * 300, "", "bc", None, "d" * langid.WINDOW]
    data, rows = tokens.utf8(pa.array(texts))
    x, row, weight = langid.windows(data, rows)
    for k, t in enumerate(texts):
        assert b"".join(bytes(w[:n]) for w, n in zip(x[row == k], weight[row == k])).decode() == (t or "")


def test_tables_give_the_responses_of_the_filters():
    net = langid.ByteNet(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (20, langid.WINDOW))
    pooled, _ = net._pooled(x)
    direct = langid._softmax(np.tanh(pooled) @ net.out + net.out_bias)
    assert np.allclose(langid.Predictor(net).windows(x.astype(np.uint8)), direct, atol=1e-5)


def test_keep_languages_keeps_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    junk = spark.createDataFrame([(-1, "12345", "en", "s", 5), (-2, None, None, None, None)], docs.schema)
    kept = langid.keep_languages(docs.union(junk), langid.fit_language(docs), 0.4)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count()
    assert kept.where(F.col("doc_id") < 0).count() == 0


def test_every_language_is_learned(spark):
    rows = [(i, f"word{i % 520} ", f"l{i % 520:03d}") for i in range(520 * 6) if i % 520 or i < 3000]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trained = {r.lang for r in docs.where(~langid.held_out(F.col("doc_id"))).select("lang").distinct().collect()}
    assert len(trained) > 500 and set(langid.fit_language(docs).labels) == trained


def test_whole_texts_against_a_plain_forward_pass(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    net = langid.fit_language(docs)
    rows = [*((r.doc_id, r.text) for r in docs.orderBy(F.length("text")).limit(8).collect()), (9000, "É"), (9001, docs.first().text * 3)]
    found = {r.doc_id: r for r in langid.predict_language(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()}
    for doc_id, text in rows:
        raw = text.encode()
        total = np.zeros(len(net.labels))
        for at in range(0, len(raw), langid.WINDOW):
            part = raw[at : at + langid.WINDOW]
            window = part + b" " * (langid.WINDOW - len(part))
            pooled = [max(sum(net.filters[w][j][window[i + j]][f] for j in range(w)) for i in range(langid.WINDOW - w + 1)) + net.bias[w][f] for w in langid.WIDTHS for f in range(langid.FILTERS)]
            e = np.exp((logits := np.tanh(pooled) @ net.out + net.out_bias) - logits.max())
            total += len(part) * e / e.sum()
        assert found[doc_id].lang_pred == net.labels[int(total.argmax())]
        assert abs(found[doc_id].score - total.max() / len(raw)) < 1e-4


def test_the_fit_takes_a_bounded_number_of_windows(spark, monkeypatch):
    rows = [(i, f"{i} " + "abc " * 50_000, "A") for i in range(1, 4)] + [(i, "xyz", "B") for i in range(4, 8)]
    seen = []
    monkeypatch.setattr(langid.ByteNet, "fit", lambda self, x, y: seen.append((x.shape, np.bincount(y).tolist())))
    net = langid.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.labels == ["A", "B"] and seen == [((2 * langid.SAMPLE_WINDOWS, langid.WINDOW), [langid.SAMPLE_WINDOWS] * 2)]


def test_the_limit_is_set_from_every_held_out_row(spark):
    rng = random.Random(4)
    net = langid.ByteNet(["a", "b"])
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(30)), rng.choice("ab")) for i in range(40_000)]
    docs = spark.createDataFrame([*rows, (None, "abc", "a"), (-1, None, "a"), (-2, "abc", None)], "doc_id long, text string, lang string")
    found = langid.predict_language(docs, net).join(docs, "doc_id").where("held_out and lang = lang_pred and text is not null").toPandas()["score"].to_numpy()
    assert len(found) > 3500
    wanted = 0.5 + langid.LIMIT_PART * max(0.0, np.quantile(found, langid.LIMIT_SHARE) - 0.5)
    assert abs(langid.least_score(docs, net) - wanted) < 1e-12


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(6)
    for values in ([0.3], [0.2, 0.9], [1.0] * 50, [0.0, 1.0, 1.0], 1 - rng.random(3000) * 1e-9, np.repeat(rng.random(40), 30), [0.5, np.nextafter(0.5, 1), np.nextafter(0.5, 0)] * 5):
        frame = spark.createDataFrame([(float(v),) for v in values], "score double")
        for share in (0.0, 0.001, 0.34, 1.0):
            number, quantile = langid._low_quantile(frame, share)
            assert number == len(values) and abs(quantile - np.quantile(values, share)) < 1e-15
    assert langid._low_quantile(frame.where("false"), 0.001) == (0, 0.0)
