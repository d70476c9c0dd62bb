"""The pipeline's stages against brute force on a small table."""

import os
from collections import Counter

import pytest

import corpus_pipeline as P

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def without_repeats(texts, n=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i:i + n] for r in raw for i in range(len(r) - n + 1))
    for r in raw:
        covered = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if count[r[i:i + n]] > 1:
                covered[i:i + n] = b"\1" * n
        yield bytes(b for b, c in zip(r, covered) if not c)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
    assert [d.columns for d in kept[:-1]] == [P.COLUMNS] * (len(kept) - 1)
    quality, once, bare, mixed, pieces = ([r.asDict() for r in d.collect()] for d in kept)
    ids = [r["doc_id"] for r in once]
    assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in quality}
    want = dict(zip(ids, without_repeats([r["text"] for r in once])))
    assert {r["doc_id"]: r["text"] for r in bare} == {k: v.decode("utf-8", "ignore") for k, v in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in bare)
    texts = {r["doc_id"]: r["text"] for r in bare}
    assert {r["doc_id"] for r in mixed} <= set(ids) and all(r["text"] == texts[r["doc_id"]] for r in mixed)
    from tokenizers import Tokenizer
    import public_tokenizers
    tokenizer = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    copies = {}
    for r in mixed:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    for d, n in copies.items():
        size = len(tokenizer.encode(texts[d], add_special_tokens=False).ids) + 1
        assert sum(r["length"] for r in pieces if r["doc_id"] == d) == n * size


def test_one_document_of_each_group_stays_even_if_rows_repeat(spark):
    rows = [(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, "a b c d e", "en", "s", 9), (3, "z y x w v", "en", None, 9), (4, None, None, "s", 0), (5, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in P.one_of_each(spark, df, "").collect()) == [1, 3, 4]


def test_rows_without_an_id_and_with_one_id_and_two_texts_stay(spark):
    rows = [(None, "a b c d e", "en", "s", 9), (None, "a b c d e", "de", "s", 9), (None, "p q r s t", "en", "s", 9), (None, "z y x w v", "en", "s", 9),
            (3, "z y x w v", "en", "s", 9), (7, "k l m n o", "en", "s", 9), (7, "f g h i j", "en", "s", 9), (None, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = P.one_of_each(spark, df, "").collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == [
        ("3", "z y x w v"), ("7", "f g h i j"), ("7", "k l m n o"), ("None", "None"), ("None", "a b c d e"), ("None", "p q r s t")]


def test_stages_on_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0


def test_run_is_registered():
    import __spark_entry__ as E
    assert E.queries()["pipeline"] is P.run and "pipeline" not in E.oracle_sql()
