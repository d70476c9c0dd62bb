"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from tabulon.llm import spelling as P


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def vocabulary(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def groups(counts, factor=10):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda v: (-counts[v], v))
            if counts[best] >= factor * n:
                form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def pairs(spark, words, most):
    got = P.near_words(spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n long"), most).collect()
    return sorted(tuple(r) for r in got)


def brute(words):
    return sorted((a, b, n) for a in words for b, n in words.items() if is_near(a, b))


def variants(rnd, word, letters):
    for _ in range(rnd.randrange(1, 6)):
        word = word or "x"
        k = rnd.randrange(len(word))
        word = rnd.choice([word[:k] + rnd.choice(letters) + word[k + 1:], word[:k] + word[k + 1:], word[:k] + rnd.choice(letters) + word[k:]])
    return word or "x"


@pytest.mark.parametrize("most", [1, 5, 70, 1024])
def test_all_near_words_once(spark, most):
    rnd = random.Random(most)
    letters = "abcàÿ×÷Ü"
    seeds = ["".join(rnd.choices(letters, k=rnd.choice([1, 2, 5, 8, 30]))) for _ in range(25)]
    words = {variants(rnd, rnd.choice(seeds), letters): rnd.randrange(2, 50) for _ in range(400)}
    words |= {"a" * k: k for k in range(1, 12)} | {"ab" * k: 3 for k in range(1, 9)}
    assert pairs(spark, words, most) == brute(words)


def test_one_beginning_in_most_words(spark):
    """A third of all words share all but two letters, with blocks of far more than 64 words."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {"beginning" + a + b: 2 for a in letters for b in letters[:16]} | {"beginnin" + a: 5 for a in letters}
    rnd = random.Random(3)
    words |= {"".join(rnd.choices(letters, k=9)): 2 for _ in range(400)}
    assert pairs(spark, words, 100) == brute(words)


def test_whole_operator(spark):
    rnd = random.Random(8)
    base = ["Organisation", "Señorita", "behaviour", "straßenbahn", "élémentaire", "CENTRALISE", "abcdefg"]
    docs = []
    for k in range(600):
        w = [rnd.choice(base) for _ in range(rnd.randrange(0, 40))]
        w += [variants(rnd, rnd.choice(base), "abcé") for _ in range(2)] * rnd.randrange(0, 3)
        docs.append((k, " ".join(w) + rnd.choice(["", "7x", "\n"])))
    docs += [(None, "organisation organisation"), (None, None), (5, None), (5, ""), (6, "x" * 4000 + " " + "x" * 4000), docs[3], docs[3]]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, word string, n int")
    got = sorted(tuple(r) for r in P.spelling_groups(P.word_counts(df, every=31)).collect())
    want = groups(vocabulary(docs))
    assert got == want
    assert any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in groups({"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100}))


def test_chains_of_forms(spark):
    counts = {"aaaaaaaa"[:8 - k] + "b" * k: 10 ** k for k in range(9)} | {"zzzzzzz": 4, "zzzzzzy": 4}
    got = P.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert sorted(tuple(r) for r in got.collect()) == groups(counts)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.spelling_groups(P.word_counts(empty, every=31)).collect() == []
