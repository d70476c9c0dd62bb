"""Mixing and quality rules against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np

from tabulon.llm.mix import emit, mix_sources
from tabulon.llm.rules import POOLED, distance, quality_rules, references


def fill(sizes, weights, total, cap):
    """Share, cut at the cap, share the rest again, until nothing is over."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total * sum(sizes)
    while open_:
        w = sum(weights[k] for k in open_)
        over = {k for k in open_ if left * weights[k] / w > cap * sizes[k]}
        if not over:
            for k in open_:
                target[k] = left * weights[k] / w
            break
        for k in over:
            target[k] = cap * sizes[k]
            left -= target[k]
        open_ -= over
    return target


def test_targets_are_filled_up_by_weight(spark):
    rnd = random.Random(2)
    for n in (1, 2, 3, 7):
        sizes = [rnd.choice([0, 3, 40, 500, 3000]) for _ in range(n)]
        names = [f"s{k}" for k in range(n - 1)] + [None]
        rows = [(k, "w " * size, name) for k, (size, name) in enumerate(zip(sizes, names))]
        got = {r["source"]: r["mix"]["target"] for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        want = fill(sizes, [(3, 1, 2)[k % 3] for k in range(n)], 1.5, 2)
        for name, w in zip(names, want):
            assert math.isclose(got[name], w, abs_tol=1e-6)


def test_order_is_by_code_point_and_reruns_agree(spark):
    rows = [(k, "a b c", s) for k, s in enumerate(["b", "B", "é", "", None, "\U0001F600", "￮"] * 40)] + [(None, None, "b"), (3, "x", "b")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, mix string")
    one = sorted((str(r["doc_id"]), str(r["source"]), r["mix"]) for r in mix_sources(df).collect())
    two = sorted((str(r["doc_id"]), str(r["source"]), r["mix"]) for r in mix_sources(df.repartition(7)).collect())
    assert one == two
    names = sorted({r[2] for r in rows if r[2] is not None}, key=lambda s: [ord(c) for c in s]) + [None]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = fill([sizes[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2)
    for r in mix_sources(df).collect():
        assert math.isclose(r["mix"]["target"], want[names.index(r["source"])], abs_tol=1e-6)
        assert 0 <= r["mix"]["copies"] <= 2


def test_taken_comes_near_the_target_and_emit_repeats_rows(spark):
    rows = [(k, "w " * (1 + k % 17), f"s{k % 4 if k % 3 else 0}") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mix_sources(df).cache()
    taken, target = Counter(), {}
    for r in mixed.collect():
        taken[r["source"]] += r["mix"]["size"] * r["mix"]["copies"]
        target[r["source"]] = r["mix"]["target"]
    assert all(abs(taken[s] - t) <= 0.05 * t for s, t in target.items())
    out = emit(mixed)
    assert out.columns == df.columns and out.count() == sum(r["mix"]["copies"] for r in mixed.collect())
    mixed.unpersist()


def test_many_sources_take_the_shuffled_way(spark, monkeypatch):
    import tabulon.llm.mix as module
    rows = [(k, "a b", f"s{k % 30 if k % 3 else 0}") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted((r["doc_id"], r["mix"]) for r in mix_sources(df).collect())
    monkeypatch.setattr(module, "BROADCAST_ROWS", 3)
    assert sorted((r["doc_id"], r["mix"]) for r in mix_sources(df).collect()) == want


def test_mixing_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(df).count() == 0 and emit(mix_sources(df)).count() == 0
    assert mix_sources(spark.createDataFrame([(1, None, None)], df.schema)).first()["mix"]["copies"] == 0


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = Counter(zip(words, words[1:], words[2:]))
    covered, seen, again = set(), set(), 0
    for i, t in enumerate(zip(words, words[1:], words[2:])):
        if triples[t] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


def test_counts_are_those_of_plain_python(spark):
    rnd = random.Random(4)
    texts = [None, "", " ", "\n\n", "a", "a\na\n a\na", "é ü x", "a b c a b c a b", "x " * 4000, "#| <b>\x0b\x0c y\r\n#| <b>\x0b\x0c y"]
    texts += ["".join(rnd.choice("ab  \n#é.\t") for _ in range(rnd.randint(0, 400))) for _ in range(60)]
    df = spark.createDataFrame([(k, t, ["en", None, "xx"][k % 3], 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, rules int")
    for r in quality_rules(df).collect():
        q = r["rules"]
        want = counts(texts[r["doc_id"]])
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == want
        assert q["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (q["base_failed"] and q["kept"])


def test_reference_covers_all_rows_and_odd_texts_are_far(spark):
    rnd = random.Random(6)

    def prose(n):
        return " ".join(rnd.choice(["the", "of", "and", "to"]) if rnd.random() < 0.4 else "".join(rnd.choice("aeinrst") for _ in range(6)) for _ in range(n))

    rows = [(k, prose(120), "en") for k in range(150)] + [(900, prose(120).upper().replace(" ", "!! "), "en"), (901, prose(120).replace(" ", " | "), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = references(df)
    assert set(refs) == {POOLED, "en"} and {b"the", b"of", b"and", b"to"} <= set(refs["en"][1])
    assert refs["en"][2].sum() == sum(len(t.split()) for _, t, _ in rows)
    dropped = {r["doc_id"] for r in quality_rules(df).where("not rules.kept").collect()}
    assert dropped == {900, 901}
    assert quality_rules(df.where("false")).count() == 0


def test_small_languages_are_judged_within_themselves(spark, monkeypatch):
    import tabulon.llm.rules as module
    rnd = random.Random(8)

    def prose(n, letters):
        return " ".join("".join(rnd.choice(letters) for _ in range(6)) for _ in range(n))

    star = [(300 + k, prose(60, "mnopq"), "*") for k in range(20)]
    greek = star + [(k, prose(60, "αεινοστ"), "el") for k in range(30)] + [(70, prose(60, "αεινοστ").replace(" ", " ||||||| "), "el")]
    rows = greek + [(80, prose(60, "абвгд"), None), (81, prose(60, "абвгд"), "ru"), (82, "абв", "ru"), (83, None, None), (84, None, "el"), (85, None, "xx")]
    rows += [(100 + k, prose(200, "aeinrst"), "en") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(module, "REFERENCE_WORDS", 1000)
    want = {*range(30), 80, 81, *range(100, 130), *range(300, 320)}
    for share, held in ((0.001, 4 << 20), (0.5, 4 << 20), (0.001, 0), (0.001, 20_000)):  # the result does not depend on the way
        monkeypatch.setattr(module, "LANGUAGE_SHARE", share)
        monkeypatch.setattr(module, "CANDIDATE_BYTES", held)
        got = quality_rules(df, own=True).collect()
        assert len(got) == len(rows) and {r["doc_id"] for r in got if r["rules"]["kept"]} == want
        if share == 0.001 and held == 4 << 20:
            before = {r["doc_id"]: r["rules"] for r in got}
        for r in got:
            assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(r["rules"], before[r["doc_id"]]))


def test_distance_is_zero_to_one():
    p = np.array([[1, 0], [0, 5], [2, 2], [0, 0]])
    assert np.allclose(distance(p, np.array([3, 0])), [0, 1, distance(np.array([[1, 1]]), np.array([1, 0]))[0], 0])


def test_a_source_without_ids_comes_near_its_target(spark):
    rows = [(None, f"w{k} " * (1 + k % 9), "a") for k in range(3000)] + [(k, f"v{k} x", "b") for k in range(3000)] + [(7, f"u{k}", "c") for k in range(3000)]
    taken, target = Counter(), {}
    for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        taken[r["source"]] += r["mix"]["size"] * r["mix"]["copies"]
        target[r["source"]] = r["mix"]["target"]
    assert all(abs(taken[s] - t) <= 0.06 * t for s, t in target.items())
