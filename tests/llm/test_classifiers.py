"""Quality and language: held-out accuracy and defined results for odd rows."""

import os

import numpy as np
import pyarrow as pa
import pytest

from tabulon.llm import langid, quality
from tabulon.llm.common import remainder

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@needs_tables
def test_quality_on_held_out_documents(spark):
    got = quality.op3_attention_quality(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


@needs_tables
def test_language_on_held_out_documents(spark):
    got = langid.op4_string_kernel_langid(spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows_of_both(spark):
    texts = [None, "", " \n", "12 34 !!", "the cat and the dog " * 30, "der hund und die katze " * 30, "x" * 100000, "é"]
    rows = [(k, t, ["en", "de", None][k % 3], "s") for k, t in enumerate(texts * 3)] + [(None, "the", "en", "s"), (4, "repeated id", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(df)
    got = langid.predict(df, model, ["doc_id", "text"]).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} <= {"en", "de", "und"}
    for r in got:
        lettered = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not lettered) and (lettered or r["score"] == 0)
    labels = spark.createDataFrame([(k, k % 2) for k in range(24)] + [(None, 1), (3, None), (3, 0)], "doc_id long, quality int")
    scored = quality.score(df, quality.fit(df, labels), ["doc_id"]).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    one = quality.fit(df, labels.where("quality = 1"))
    assert {r["score"] for r in quality.score(df, one, ["doc_id"]).collect()} == {1.0}
    none = quality.fit(df, labels.where("false"))
    assert {r["score"] for r in quality.score(df, none, ["doc_id"]).collect()} == {0.5}
    blank = langid.fit(df.where("lang is null"))
    assert {r["lang_pred"] for r in langid.predict(df, blank, ["doc_id"]).collect()} == {"und"}
    empty = df.where("false")
    assert langid.predict(empty, model, ["doc_id"]).count() == 0 and quality.score(empty, one, ["doc_id"]).count() == 0


def test_languages_of_small_share_are_learned(spark, monkeypatch):
    rows = [(k, f"the cat and the dog of number {k} went to the house", "en") for k in range(6000)]
    rows += [(10_000 + k, f"η γάτα και ο σκύλος του σπιτιού {k}", "el") for k in range(5)] + [(20_000, "кошка и собака " * 2000, "ru")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    new = spark.createDataFrame([(1, "ο σκύλος και η γάτα πήγαν"), (2, "собака и кошка"), (3, "a dog of the house")], "doc_id long, text string")
    for marks in (langid.ALL_LANDMARKS, 3):
        monkeypatch.setattr(langid, "ALL_LANDMARKS", marks)
        model = langid.fit(df)
        assert model.languages == ["el", "en", "ru"]
        assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(new, model, ["doc_id"]).collect()} == {1: "el", 2: "ru", 3: "en"}


def test_remainder_is_crc32_of_the_id_as_text(spark):
    import zlib
    rows = spark.range(50).select("id", remainder("id", 5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_kernel_is_shared_ngrams():
    def grams(t):
        b = t.lower().encode()
        return {b[i:i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    texts = ["the cat", "The bat", "été", "a", ""]
    codes = langid.distinct_codes(pa.array(texts))
    x = langid.Vocabulary(codes).presence(pa.array(texts)).astype(int)
    assert (x @ x.T == [[len(grams(s) & grams(t)) for t in texts] for s in texts]).all()


def test_attention_gradient():
    rng = np.random.default_rng(0)
    m = quality.AttentionModel()
    m.p = {k: v.astype(np.float64) + 0.1 * rng.normal(size=v.shape) for k, v in m.p.items()}
    x, per_doc, y = rng.normal(size=(9, quality.FEATURES)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = m._forward(x, per_doc)["s"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grad = m._gradient(x, per_doc, y)
    for name, g in grad.items():
        flat = m.p[name].reshape(-1)
        k = int(rng.integers(len(flat)))
        old = flat[k]
        flat[k] = old + 1e-5
        up = loss()
        flat[k] = old - 1e-5
        down = loss()
        flat[k] = old
        assert abs((up - down) / 2e-5 - np.asarray(g).reshape(-1)[k]) < 1e-6


def test_passages_cut_texts_by_words():
    x, per_doc = quality.passages(pa.array(["w " * 130, "", None, "one two", "\n x" * 64]))
    assert per_doc.tolist() == [3, 1, 1, 1, 1] and len(x) == 7
    assert x[0, quality.CLASSES + 2] > 0.9 and x[3].sum() == 0
