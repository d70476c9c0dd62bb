"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tabulon.llm import resample as R

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def buckets(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def expected(docs, target, share=(5, 100), least=20):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, text in docs:
        np.add.at(s, buckets(text), 1)
    for text in target:
        np.add.at(t, buckets(text), 1)
    S, T = s.sum(), t.sum()
    gain = [math.floor(1000 * math.log(float(b + 1) * float(S + 10000) / (float(a + 1) * float(T + 10000)))) for a, b in zip(s, t)]
    out = []
    for i, text in docs:
        found = buckets(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    long = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    drawn = long[:share[0] * len(long) // share[1]]
    return sorted(((*x[:4], drawn.index(x) + 1 if x in drawn else None) for x in out), key=str)


def run(spark, docs, target, **kw):
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, resample string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.draw(R.weighed(df, goal, keep=["doc_id"]), **kw).select("doc_id", "resample.n_features", "resample.weight", "draw.score", "draw.rank")
    return sorted((tuple(r) for r in got.collect()), key=str)


def sample(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["Alpha", "beta", "x1", "Éclair", "straße", "日本", "a", "zeta-phi", "UPPER", "naïve", "\U0001F600ok", "q" * 70]
    return [(k, rnd.choice([" ", "\n", ", "]).join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 2, 3, 19, 20, 21, 60])))) for k in range(n)]


def test_weights_scores_and_ranks(spark):
    docs = sample(1, 120) + [(None, "beta " * 30), (7, None), (7, ""), (5, sample(1, 6)[5][1]), (900, "\x00\x01 ---")]
    target = [t for _, t in sample(2, 15)] + [None, "", "only here"]
    assert run(spark, docs, target) == expected(docs, target)
    assert run(spark, docs, target, share=(100, 100)) == expected(docs, target, (100, 100))


def test_empty_tables(spark):
    assert run(spark, [], ["a b"]) == []
    docs = sample(3, 30)
    assert run(spark, docs, []) == expected(docs, [])


@pytest.mark.parametrize("piece", [40, 300])
def test_long_texts_are_scanned_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(R, "PIECE_BYTES", piece)
    texts = ["w" * 5000 + " tail " + "é" * 300, " ".join(t for _, t in sample(4, 40)), None, " " * 1000, "a", "x " * 500 + "a" * 300]
    found = [[] for _ in texts]
    for row, bucket, _ in R.features(pa.array(texts)):
        for r, b in zip(row.tolist(), bucket.tolist()):
            found[r].append(b)
    assert [sorted(f) for f in found] == [sorted(buckets(t)) for t in texts]


def test_crc_is_composed():
    rnd = random.Random(5)
    a, b = [bytes(rnd.randbytes(rnd.randrange(0, 50))) for _ in range(200)], [bytes(rnd.randbytes(rnd.choice([0, 1, 5, 63, 64, 700, 70000]))) for _ in range(200)]
    left, right = (np.array([zlib.crc32(x) for x in y], np.uint32) for y in (a, b))
    got = R._CRC.shift(left, np.array([len(x) for x in b])) ^ right
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]
