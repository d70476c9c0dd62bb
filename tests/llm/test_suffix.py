"""Exact substring removal against brute force, and the parts of the merge sort."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.llm.suffix import Run, Segments, encode_run, merge_runs, rolling, suffix_dedup

N = 200


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i:i + N] for r in raw for i in range(len(r) - N + 1))
    out = []
    for r in raw:
        covered = bytearray(len(r))
        for i in range(len(r) - N + 1):
            if count[r[i:i + N]] > 1:
                covered[i:i + N] = b"\1" * N
        kept = bytes(b for b, c in zip(r, covered) if not c)
        runs = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((len(r), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return out


def run(df, **options):
    got = suffix_dedup(df, keep=["doc_id"], **options)
    rows = got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    return sorted((r[0] is None, r[0] or 0, *r[1:]) for r in rows)


def want(ids, texts):
    return sorted((i is None, i or 0, *x) for i, x in zip(ids, brute(texts)))


def corpus():
    rnd = random.Random(3)

    def text(n):
        return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(n))

    texts = [text(rnd.randint(0, 250)) for _ in range(24)]
    passage, line = text(70), text(25)
    for i in range(24):
        half = len(texts[i]) // 2
        if i % 3 == 0:
            texts[i] = texts[i][:half] + passage + texts[i][half:]
        if i % 4 == 1:
            texts[i] += line + text(30) + line
    texts += ["a" * 900, "ab " * 250, "x" * 199, "x" * 200, "x" * 201, None, "", texts[3], texts[3], texts[5][:300],
              texts[6] + texts[7], texts[8] * 3]
    for _ in range(8):
        near = list(texts[9] + passage)
        for _ in range(3):
            near[rnd.randrange(len(near))] = "Z"
        texts.append("".join(near))
    return texts


def test_equals_brute_force_with_clashing_columns(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 1, "k", "r") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, kept string, row string")
    assert run(df) == want(range(len(texts)), texts)
    assert suffix_dedup(df).columns == ["doc_id", "row", "kept", "n_bytes", "n_removed", "n_spans"]


def test_hot_anchors_give_the_same(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert run(df, hot_least=2, hot_share=1e-9) == want(range(len(texts)), texts)


def test_repeated_ids_and_null_ids(spark):
    a, b = "one two three " * 30, "".join(chr(97 + i * 7 % 26) for i in range(700))
    ids, texts = [1, 1, 1, None, None, 2], [a, a, b, b, None, b[100:450]]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    assert run(df) == want(ids, texts)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []


def test_as_text_drops_cut_characters(spark):
    tail = "".join(chr(97 + i * 11 % 26) for i in range(300))
    df = spark.createDataFrame([(1, "é" + tail), (2, "ũ" + tail)], "doc_id long, text string")  # they share their second byte
    rows = suffix_dedup(df, keep=["doc_id"], as_text=True).collect()
    assert [r["kept"] for r in rows] == ["", ""]
    assert {r["n_removed"] for r in rows} == {301}


def test_driver_table(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    if os.path.exists(path):
        df = spark.read.parquet(path)
        rows = df.select("doc_id", "text").collect()
        assert run(df) == want([r[0] for r in rows], [r[1] for r in rows])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8), min_size=1, max_size=6))
def test_loser_tree_orders_and_knows_common_prefixes(lists):
    runs = [Run(encode_run(sorted((x, b"", 0, k) for k, x in enumerate(one)), [(7, 8)])) for one in lists]
    out = [(runs[r].suffixes[e], lcp, int(runs[r].edges[e + 1] - runs[r].edges[e])) for r, e, lcp in merge_runs(runs)]
    assert [x for x, _, n in out for _ in range(n)] == sorted(x for one in lists for x in one)
    for (x, _, _), (y, lcp, _) in zip(out, out[1:]):
        assert lcp == len(os.path.commonprefix([x, y]))


def test_run_round_trip():
    items = sorted([(b"abc", b"zy", 0, 5), (b"abd", b"zx", 1, 9), (b"abd", b"zx", 1, 700), (b"b", b"", 0, 2)])
    r = Run(encode_run(items, [(1, 2), (3, 4)]))
    got = [(r.suffixes[e], r.lefts[e], *r.table[r.docs[k]].tolist(), int(r.firsts[k]))
           for e in range(len(r.suffixes)) for k in range(r.edges[e], r.edges[e + 1])]
    assert got == [(s, left, *((1, 2), (3, 4))[d], f) for s, left, d, f in items]


def test_segments_cover_each_window_once():
    texts = ["a" * 250, "xy" * 300, "q" * 10, "".join(chr(97 + i * i % 26) for i in range(900)), ""]
    s = Segments(pa.array(texts), N)
    windows = sorted((int(d), int(x - s.offsets[d])) for d, a, z in zip(s.doc, s.first, s.last) for x in range(a, z + 1))
    assert windows == [(d, x) for d, t in enumerate(texts) for x in range(len(t) - N + 1)]


def test_rolling_hash_depends_on_content_only():
    data = np.frombuffer(b"hello world, hello world, hello", np.uint8)
    h = rolling(data, 13)
    assert h[0] == h[13] and len(set(h.tolist())) == 13
