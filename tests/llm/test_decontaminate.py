"""Benchmark decontamination against plain Python."""

import hashlib
import random
import re

import pytest

from tabulon.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, size=10):
    cut = {}
    for i, text in items:
        w = words(text)
        for k in range(max(len(w) - size + 1, 1) if w else 0):
            cut.setdefault(tuple(w[k:k + size]), set()).add(None if i is None else str(i))
    lengths = {len(k) for k in cut}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in cut:
                    hit |= set(range(k, k + n))
                    found |= cut[tuple(w[k:k + n])]
        found = sorted(found - {None}, key=lambda s: s.encode())
        out.append((i, len(w), len(hit), found))
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "clash", 1, "t") for x in docs], "doc_id long, text string, row string, pos int, term string")
    b = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, phrase int")
    got = D.decontaminate(d, b, **kw).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str)


def sample(seed, n, most=60, letters="abcdeFGé"):
    rnd = random.Random(seed)
    return [(k, " ".join(rnd.choice(letters) * rnd.choice([1, 1, 1, 2]) for _ in range(rnd.randrange(most)))) for k in range(n)]


def mixed_tables(seed):
    rnd = random.Random(seed)
    items = sample(seed, 30, 40) + [(100, "Solo"), (101, "two words"), (102, None), (103, ""), (104, "..."), (None, "q1 q2 q3 q4"),
                                    (105, "a " * 25), (106, "a " * 25), (106, "not the same text at all here"), (107, "never never seen")]
    docs = sample(seed + 1, 60)
    for k in range(60, 120):
        _, t = rnd.choice(items)
        w = (t or "").split()
        a = rnd.randrange(len(w) + 1)
        docs.append((k, f"{docs[k - 60][1]}, {' '.join(w[a:a + rnd.choice([3, 9, 10, 11, 40])]).upper()}; solo-two WORDS " + docs[k - 59 if k < 119 else 0][1]))
    docs += [(None, docs[70][1]), (None, None), (7, ""), (7, docs[7][1]), docs[80], docs[80], (500, "q1 q2 q3 q4"), (501, "b " * 20000 + "a " * 30)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [True, False])
def test_hits_and_items(spark, monkeypatch, seed, small):
    if not small:  # the whole vocabulary is indexed, and nothing is broadcast
        monkeypatch.setattr(D, "VOCABULARY_ROWS", 0)
        monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    docs, items = mixed_tables(seed)
    assert run(spark, docs, items) == expected(docs, items)


@pytest.mark.parametrize("size", [1, 2, 3])
def test_short_windows(spark, size):
    docs, items = sample(5, 40, 20), sample(6, 6, 8) + [(9, "zz yy")]
    assert run(spark, docs, items, size=size) == expected(docs, items, size)


def test_empty_tables(spark):
    docs, items = sample(7, 3), sample(8, 3)
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == expected(docs, [])
    assert run(spark, docs, [(1, None)]) == expected(docs, [])


def test_a_passage_in_most_documents(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    docs = [(k, f"x{k} " * (k % 5) + (passage if k % 3 else "other words") + f" y{k}") for k in range(300)]
    items = [(k, passage) for k in range(40)] + [(77, "some " + passage)]
    assert run(spark, docs, items) == expected(docs, items)


def test_digest_of_the_items(spark, tmp_path):
    from tabulon.llm.queries import QUERIES
    docs, items = mixed_tables(3)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in QUERIES["op12_positional_index"](spark, str(tmp_path)).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)
    want = sorted(((i, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0) for i, n, h, f in expected(docs, items)), key=str)
    assert got == want


@pytest.mark.parametrize("span", [1, 3, 7, 60])
def test_proximity(spark, span):
    docs = sample(11, 40, 50)
    phrases = [["a", "b"], ["c"], ["é", "d", "e"], ["a", "a", "bb"], ["gg", "f", "c", "a"], ["absent", "a"], ["a", "b", "c", "d", "e"]]
    index = D.positional_index(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = spark.createDataFrame(list(enumerate(phrases)), "phrase long, terms array<string>")
    ids = {r["row"]: r["keep"]["doc_id"] for r in index.documents.collect()}
    got = {(ids[r["row"]], r["phrase"], r["start"]) for r in D.proximity_matches(index, asked, span).collect()}
    for i, text in docs:
        w = words(text)
        for k, phrase in enumerate(phrases):
            need = set(phrase)
            starts = {s for s in range(1, len(w) + 1) if need <= set(w[s - 1:s - 1 + span])}
            # the whole words at the end count as a span too, which need not be full
            mine = {s for d, p, s in got if (d, p) == (i, k)}
            assert mine <= starts and bool(mine) == bool(starts), (i, phrase, mine, starts)
