"""SimHash: fingerprints and components against brute force; the Golay keys miss no pair."""

import random
import re

import numpy as np
import xxhash

from tabulon.llm.components import connected_components
from tabulon.llm.simhash import ERRORS, codeword_index, fingerprint_links, index_keys, probe_keys, simhash_components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    values = sorted(set(prints))
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(values):
        for j in range(i):
            if (x ^ values[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return {x: find(i) for i, x in enumerate(values)}


def test_code_is_perfect():
    assert len(set(ERRORS.tolist())) == 1 << 11
    words = np.arange(0, 1 << 23, 997)
    assert codeword_index(words).max() < 1 << 12


def test_no_pair_within_four_bits_is_missed():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2 ** 63, 500, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 500, dtype=np.uint64)
    row, key = probe_keys(x)
    looked = [set() for _ in x]
    for r, k in zip(row.tolist(), key.tolist()):
        looked[r].add(k)
    for bits in range(5):
        y = x.copy()
        for k in range(len(y)):
            for b in rng.choice(64, bits, replace=False):
                y[k] ^= np.uint64(1) << np.uint64(b)
        stored = index_keys(y)
        assert all(looked[k] & set(stored[k].tolist()) for k in range(len(x)))


def test_texts_against_brute_force(spark):
    rnd = random.Random(5)

    def text(n):
        return " ".join("".join(rnd.choice("abcDE") for _ in range(rnd.randint(1, 6))) for _ in range(n))

    texts = [text(rnd.randint(0, 60)) for _ in range(40)] + [None, "", "  \n", "one", "One", "one two three", "x " * 5000]
    texts += [texts[0]] * 5 + [texts[1] + " tail", " no break"]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i, t, "f") for i, t in zip(ids, texts)], "doc_id long, text string, fp string")
    got = {r["doc_id"]: (r["fingerprint"] % (1 << 64), r["component_id"]) for r in simhash_components(df).collect()}
    prints = {i: brute_print(t) for i, t in zip(ids, texts)}
    group = brute_components(prints.values())
    for i, p in prints.items():
        assert got[i] == (p, min(j for j, q in prints.items() if group[q] == group[p]))


def test_crowded_keys_link_the_same_components(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2 ** 62, 3, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(62, int(k), replace=False)) for b in base for k in rng.integers(0, 5, 25)]
    prints = sorted(set(near))
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    group = brute_components(prints)
    for hot in (1000, 1):
        links = fingerprint_links(df, hot_rows=hot)
        found = {r["node"]: r["root"] for r in connected_components(links).collect()}
        assert {p: found.get(p, p) for p in prints} == {p: min(q for q in prints if group[q] == group[p]) for p in prints}


def test_repeated_rows_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "zz yy xx ww vv")], "doc_id long, text string")
    rows = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash_components(df).collect())
    assert rows == [(-1, -1), (-1, 3), (3, 3), (3, 3)]
    assert simhash_components(df.where("false")).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(31)}, **{k: 100 for k in range(100, 140)}}
