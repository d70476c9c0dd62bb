"""Quality rules: divergence of a document's histograms from its language's.

Every document gets two distributions: its characters over eight classes and
its words over the common words of its language (one more bin for all other
words).  Each is compared with the same distribution over all documents of the
language by the Jensen-Shannon distance (base 2, so 0 to 1); a document that is
farther than a threshold is rejected.  Short documents scatter by chance, so each
test has a minimum length.

References cover all documents.  A word is common if it makes up ``SHARE`` of
the language's words; such a word has that share in at least one slice of the
input, so a first pass names candidates slice by slice and a second counts them
exactly.

With ``own=True`` (the query and the pipeline) no document is compared with other
languages: every language of ``REFERENCE_WORDS`` words or more, whatever its share, has
a reference of its own; documents of smaller languages and without one are judged by
the base rules only.  References of languages with ``LANGUAGE_SHARE`` of all words (at most
1 / LANGUAGE_SHARE, with 1 / SHARE words each) travel with the tasks, those of the
others are a table that is joined: two ways to one result.  Without ``own``,
languages below that share and null are compared with the reference of all words.

Defined results: a null or empty text has zero counts, fails the base rules and
has distances of 0; rows that repeat are judged alike; an empty table gives an
empty result; other columns are kept (an input column ``rules`` is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Words, read_table, text_slices, utf8_bytes, written
from tabulon.session import ship_package

SHARE = 0.002
LANGUAGE_SHARE = 0.001
CLASS_DISTANCE, CLASS_WORDS = 0.29, 50
WORD_DISTANCE, WORD_WORDS = 0.44, 50
POOLED = "\x00all"  # the reference of all words; not the name of a language
REFERENCE_WORDS = 5_000  # 10 of a common word
CANDIDATE_BYTES = 4 << 20  # candidate words of all languages that are collected; further languages are counted in tables

# Classes of bytes (every code point counts once, by its first byte).
LOWER, UPPER, DIGIT, SENTENCE, SYMBOL, LETTER, WHITE, CONTROL, NONE = range(9)
BYTE_CLASS = np.full(256, NONE)
BYTE_CLASS[0:32] = CONTROL
BYTE_CLASS[127] = CONTROL
BYTE_CLASS[33:127] = SYMBOL
BYTE_CLASS[[9, 10, 11, 12, 13, 32]] = WHITE
BYTE_CLASS[97:123] = LOWER
BYTE_CLASS[65:91] = UPPER
BYTE_CLASS[48:58] = DIGIT
BYTE_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = SENTENCE
BYTE_CLASS[192:256] = LETTER
CLASSES = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def lower_words(words: Words) -> pa.Array:
    """The vocabulary with A-Z in lower case (other letters as they are)."""
    flat = np.frombuffer(words.vocabulary.buffers()[2] or b"", dtype=np.uint8).copy()
    flat[(flat >= 65) & (flat <= 90)] += 32
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.vocabulary),
                                            [None, words.vocabulary.buffers()[1], pa.py_buffer(flat)])


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each class for each text."""
    n = len(offsets) - 1
    key = np.repeat(np.arange(n) * (CLASSES + 1), np.diff(offsets)) + BYTE_CLASS[data]
    return np.bincount(key, minlength=n * (CLASSES + 1)).reshape(n, CLASSES + 1)[:, :CLASSES]


def spans_sum(per_byte: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(words: Words) -> np.ndarray:
    """Per text: words that lie in a 3-word window which occurs twice or more in that text."""
    n = len(words.counts)
    if len(words.codes) < 3:
        return np.zeros(n, np.int64)
    size = len(words.vocabulary)
    inside = words.doc[2:] == words.doc[:-2]
    pair = words.codes[:-1] * size + words.codes[1:]
    pair = pa.array(pair).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    triple = pa.array(pair[:-1] * size + words.codes[2:]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.flatnonzero(inside)
    key = pa.array(words.doc[at] * (int(triple.max()) + 1) + triple[at]).dictionary_encode()
    code = key.indices.to_numpy(zero_copy_only=False)
    again = at[np.bincount(code, minlength=len(key.dictionary))[code] > 1]
    covered = np.zeros(len(words.codes), bool)
    for shift in range(3):
        covered[again + shift] = True
    return np.bincount(words.doc[covered], minlength=n)


def duplicate_lines(col: pa.Array) -> np.ndarray:
    r"""Per text: \n-split lines that have a word and equal an earlier line."""
    lines = pc.split_pattern(pc.fill_null(col.cast(pa.large_binary()), b""), b"\n")
    flat, doc = pc.list_flatten(lines), pc.list_parent_indices(lines).to_numpy(zero_copy_only=False)
    n = len(col)
    if not len(flat):
        return np.zeros(n, np.int64)
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    data, off = utf8_bytes(coded.dictionary)
    has_word = spans_sum(~np.isin(data, [9, 10, 11, 12, 13, 32]), off) > 0
    keep = has_word[code]
    key = pa.array((doc * np.int64(len(has_word)) + code)[keep]).dictionary_encode()
    idx = key.indices.to_numpy(zero_copy_only=False)
    again = np.ones(len(idx), bool)
    again[np.unique(idx, return_index=True)[1]] = False
    return np.bincount(doc[keep][again], minlength=n)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of counts ``p`` from ``q``; 0 where ``p`` is empty."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.maximum(total, 1)
    q = np.broadcast_to(q / max(q.sum(), 1), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum((left + right) / 2, 0)), 0.0)


def _languages(col: pa.Array) -> tuple[np.ndarray, list]:
    coded = col.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word) that make up SHARE of a slice's words, for each language and for all; and words by language."""
    for b in text_slices(batches, "text"):
        w = Words(b.column("text"))
        low = lower_words(w).dictionary_encode()
        code = low.indices.to_numpy(zero_copy_only=False)[w.codes] if len(w.codes) else np.zeros(0, np.int64)
        lang, names = _languages(b.column("lang"))
        of = lang[w.doc] if len(w.doc) else np.zeros(0, np.int64)
        out = []
        for k, name in [(None, POOLED), *enumerate(names)]:
            mine = code if k is None else code[of == k]
            if (k is not None and name is None) or not len(mine):
                continue
            counts = np.bincount(mine, minlength=len(low.dictionary))
            for c in np.flatnonzero(counts >= SHARE * len(mine)):
                out.append((name, low.dictionary[int(c)].as_py()))
            out.append((name, None, len(mine)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary()),
             pa.array([x[2] if len(x) > 2 else 0 for x in out], pa.int64())], names=["lang", "word", "words"])


def _code_of(words: Words, common: pa.Array) -> np.ndarray:
    """Each word's place in ``common``, or len(common)."""
    if not len(words.codes):
        return np.zeros(0, np.int64)
    place = pc.fill_null(pc.index_in(lower_words(words), value_set=common), len(common))
    return place.to_numpy(zero_copy_only=False).astype(np.int64)[words.codes]


def _counter(names: list[str], common: dict[str, list[bytes]]):
    """Per slice and language: characters by class, and words by common word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: np.zeros(CLASSES + len(common[n]) + 1, np.int64) for n in names}
        for b in text_slices(batches, "text"):
            w = Words(b.column("text"))
            classes = class_counts(w.data, w.offsets)
            lang, seen = _languages(b.column("lang"))
            for name in names:
                rows = np.ones(len(lang), bool) if name == POOLED else lang == (seen.index(name) if name in seen else -1)
                if not rows.any():
                    continue
                sums[name][:CLASSES] += classes[rows].sum(axis=0)
                code = _code_of(w, pa.array(common[name], pa.large_binary()))
                sums[name][CLASSES:] += np.bincount(code[rows[w.doc]], minlength=len(common[name]) + 1)
        out = [(n, k, int(v)) for n in names for k, v in enumerate(sums[n]) if v]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()),
                                          pa.array([x[2] for x in out], pa.int64())], names=["lang", "bin", "n"])

    return count


def _all_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice and language: characters by class (word null), and each word's count (bin -1)."""
    for b in text_slices(batches, "text"):
        w = Words(b.column("text"))
        low = lower_words(w).dictionary_encode()
        code = low.indices.to_numpy(zero_copy_only=False)[w.codes] if len(w.codes) else np.zeros(0, np.int64)
        classes = class_counts(w.data, w.offsets)
        lang, names = _languages(b.column("lang"))
        key = (lang[w.doc].astype(np.int64) * max(len(low.dictionary), 1) + code) if len(code) else code
        pairs, n = np.unique(key, return_counts=True)
        of, word = np.divmod(pairs, max(len(low.dictionary), 1))
        sums = np.zeros((len(names), CLASSES), np.int64)
        np.add.at(sums, lang, classes)
        some, bins = np.nonzero(sums)
        whose = pa.array(names, pa.string()).take(pa.array(np.concatenate([of, some])))
        words = pa.concat_arrays([low.dictionary.take(pa.array(word)).cast(pa.binary()), pa.nulls(len(some), pa.binary())])
        yield pa.RecordBatch.from_arrays([whose, words, pa.array(np.concatenate([np.full(len(of), -1), bins]).astype(np.int32)),
                                          pa.array(np.concatenate([n, sums[some, bins]]))], names=["lang", "word", "bin", "n"])


def small_references(src: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, classes, words) for the languages of ``totals`` (lang, total): what ``references`` gives, as a written table."""
    counted = written(src.join(totals.select("lang"), "lang", "left_semi").select("text", "lang").mapInArrow(
        _all_counts, "lang string, word binary, bin int, n long").groupBy("lang", "word", "bin").agg(F.sum("n").alias("n")), "counts")
    classes = counted.where("word is null").groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("classes"))
    common = counted.where("word is not null").join(totals, "lang").where(F.col("n") >= SHARE * F.col("total"))
    words = common.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("words"))
    return written(totals.join(classes, "lang").join(words, "lang", "left").select("lang", F.struct("total", "classes", "words").alias("__ref")), "references")


def _reference(of: dict) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    classes = np.zeros(CLASSES, np.int64)
    for c in of["classes"]:
        classes[c["bin"]] = c["n"]
    words = of["words"] or []
    n = [w["n"] for w in words]
    return classes, [w["word"] for w in words], np.array([*n, of["total"] - sum(n)], np.int64)


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[np.ndarray, list[bytes], np.ndarray]]:
    """lang -> (class counts, common words, their counts and the rest's).  Bounded by the two shares."""
    src = _source(docs, text_col, lang_col)
    return _references(src, _named(src))


def _source(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))


def _named(src: DataFrame) -> DataFrame:
    return written(src.mapInArrow(_candidates, "lang string, word binary, words long").groupBy("lang", "word").agg(
        F.sum("words").alias("words")), "words")


def _references(src: DataFrame, named: DataFrame, own: bool = False) -> dict[str, tuple[np.ndarray, list[bytes], np.ndarray]]:
    """With ``own`` without the reference of all words, and of languages only as many as have CANDIDATE_BYTES of candidates."""
    totals = {r["lang"]: r["words"] for r in named.where("word is null").join(
        F.broadcast(named.where(f"word is null and lang = '{POOLED}'").select(F.col("words").alias("whole"))),
        F.col("words") >= LANGUAGE_SHARE * F.col("whole")).collect()}
    names = sorted(totals)
    if own and names:
        size = named.where(F.col("word").isNotNull() & F.col("lang").isin(names) & (F.col("lang") != POOLED)).groupBy("lang").agg(
            F.sum(F.length("word") + 64).alias("bytes"))  # a row a name
        held, out = 0, {POOLED}
        for r in sorted(size.collect(), key=lambda r: (r["bytes"], r["lang"])):
            held += r["bytes"]
            if held > CANDIDATE_BYTES:
                out.add(r["lang"])
        names = [n for n in names if n not in out]
    found: dict[str, list[bytes]] = {n: [] for n in names}
    for r in named.where(F.col("word").isNotNull() & F.col("lang").isin(names)).collect() if names else []:
        found[r["lang"]].append(bytes(r["word"]))
    common = {n: sorted(found[n]) for n in names}
    counted = src.mapInArrow(_counter(names, common), "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    sums = {n: np.zeros(CLASSES + len(common[n]) + 1, np.int64) for n in names}
    for r in counted.collect() if names else []:
        sums[r["lang"]][r["bin"]] = r["n"]
    refs = {}
    for n in names:
        words = sums[n][CLASSES:]
        real = words[:-1] >= SHARE * totals[n]
        kept = [c for c, ok in zip(common[n], real, strict=True) if ok]
        refs[n] = (sums[n][:CLASSES], kept, np.append(words[:-1][real], totals[n] - words[:-1][real].sum()))
    return refs


def _judge(refs: dict, joined: bool = False):
    """With ``joined`` each row brings its language's reference, or null."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "__text"):
            w = Words(b.column("__text"))
            n = b.num_rows
            classes = class_counts(w.data, w.offsets)
            words = w.counts
            chars = spans_sum(~(SPACE_OR_PART[w.data]), w.offsets)
            symbols = spans_sum(SYMBOLS[w.data], w.offsets)
            repeats, lines = repeated_words(w), duplicate_lines(b.column("__text"))
            failed = (words < 50) | (100 * repeats > 50 * words)
            js_class, js_word = np.zeros(n), np.zeros(n)
            lang, seen = _languages(b.column("__lang"))
            for k, name in enumerate(seen):
                rows = np.flatnonzero(lang == k)
                if joined:
                    of = b.column("__ref")[int(rows[0])].as_py()
                    ref = _reference(of) if of else None
                else:
                    ref = refs.get(name) if name is not None and name in refs else refs.get(POOLED)
                if ref is None:
                    continue
                js_class[rows] = distance(classes[rows], ref[0])
                code = _code_of(w, pa.array(ref[1], pa.large_binary()))
                bins = len(ref[1]) + 1
                slot = np.full(n, -1)
                slot[rows] = np.arange(len(rows))
                mine = slot[w.doc] >= 0
                hist = np.bincount(slot[w.doc][mine] * bins + code[mine], minlength=len(rows) * bins).reshape(len(rows), bins)
                js_word[rows] = distance(hist, ref[2])
            far = ((words >= CLASS_WORDS) & (js_class > CLASS_DISTANCE)) | ((words >= WORD_WORDS) & (js_word > WORD_DISTANCE))
            rules = pa.StructArray.from_arrays(
                [pa.array(x.astype(np.int64)) for x in (words, chars, symbols, lines, repeats)]
                + [pa.array(failed), pa.array(js_class), pa.array(js_word), pa.array(~failed & ~far)], names=RULE_NAMES)
            yield pa.RecordBatch.from_arrays([b.column(0), rules], names=["__row", "rules"])

    return judge


RULE_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_class", "js_words", "kept"]
RULES = ("struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, "
         "base_failed: boolean, js_class: double, js_words: double, kept: boolean>")
SPACE_OR_PART = (BYTE_CLASS == WHITE) | ((np.arange(256) >= 128) & (np.arange(256) < 192))


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, own: bool = False) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``rules``: the counts, the two distances, ``base_failed`` and ``kept``."""
    plain = _source(docs, text_col, lang_col)
    named = _named(plain)
    refs = _references(plain, named, own)
    cols = [docs[c] for c in (docs.columns if keep is None else keep) if c != "rules"]
    src = docs.select(F.struct(*cols).alias("__row"), docs[text_col].alias("__text"), docs[lang_col].cast("string").alias("__lang"))
    kind = src.schema["__row"].dataType.simpleString()
    judged = f"__row {kind}, rules {RULES}"
    if not own:
        return src.mapInArrow(_judge(refs), judged).select("__row.*", "rules")
    large = [n for n in refs if n != POOLED]
    mine = {n: refs[n] for n in large if refs[n][2].sum() >= REFERENCE_WORDS}
    totals = named.where(F.col("word").isNull() & (F.col("lang") != POOLED) & ~F.col("lang").isin(large) & (F.col("words") >= REFERENCE_WORDS)).select(
        "lang", F.col("words").alias("total"))
    if totals.isEmpty():
        return src.mapInArrow(_judge(mine), judged).select("__row.*", "rules")
    there = F.col("__lang").isNull() | F.col("__lang").isin(large)
    small = src.where(~there).join(small_references(plain, totals).withColumnRenamed("lang", "__lang"), "__lang", "left")
    return src.where(there).mapInArrow(_judge(mine), judged).unionByName(
        small.select("__row", "__text", "__lang", "__ref").mapInArrow(_judge({}, joined=True), judged)).select("__row.*", "rules")


def op9_divergence_rules(spark, sf_dir):
    judged = quality_rules(read_table(spark, sf_dir, "documents"), keep=["doc_id"], own=True)
    return judged.select("doc_id", "rules.n_words", "rules.word_chars", "rules.n_symbols", "rules.n_dup_lines",
                         "rules.n_repeat_words", "rules.base_failed", "rules.kept")


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lang,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT r, lang, word, i, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM (SELECT r, lang, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d)
), tri AS (
  SELECT r, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, word, w2, w3) AS n FROM tri WHERE w3 IS NOT NULL) WHERE n > 1
), cov AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + s AS p FROM rep, (SELECT unnest([0, 1, 2]) AS s)) GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), base AS (
  SELECT d.r, d.doc_id, d.lang, d.t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines ON d.r = lines.r LEFT JOIN cov ON d.r = cov.r
), tot AS (
  SELECT lang AS k, count(*) AS n FROM w WHERE lang IS NOT NULL GROUP BY lang
), big AS (
  SELECT k, n FROM tot WHERE n >= 5000
), common AS (
  SELECT c.k, c.low, c.n, big.n AS total FROM (
    SELECT lang AS k, low, count(*) AS n FROM w WHERE lang IS NOT NULL GROUP BY lang, low) c JOIN big ON c.k = big.k WHERE c.n >= 0.002 * big.n
), q_word AS (
  SELECT k, low, n::DOUBLE / total AS q FROM common
  UNION ALL SELECT big.k, NULL, 1 - coalesce(sum(c.n), 0)::DOUBLE / any_value(big.n) FROM big LEFT JOIN common c ON big.k = c.k GROUP BY big.k
), doc AS (
  SELECT base.*, big.k FROM base LEFT JOIN big ON base.lang = big.k
), p_word AS (
  SELECT doc.r, doc.k, c.low, count(*)::DOUBLE / any_value(doc.n_words) AS p
  FROM doc JOIN w ON doc.r = w.r LEFT JOIN common c ON c.k = doc.k AND c.low = w.low GROUP BY doc.r, doc.k, c.low
), js_word AS (
  SELECT r, sqrt(greatest((sum(p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) + 1 - sum(q)) / 2, 0)) AS js
  FROM p_word p JOIN q_word q ON p.k = q.k AND p.low IS NOT DISTINCT FROM q.low GROUP BY r
), cls AS (
  SELECT r, k, unnest(l) AS n, unnest(range(8)) AS c, list_sum(l) AS total FROM (
    SELECT r, k, [length(regexp_replace(t, '[^a-z]', '', 'g')), length(regexp_replace(t, '[^A-Z]', '', 'g')),
                  length(regexp_replace(t, '[^0-9]', '', 'g')), length(regexp_replace(t, '[^.,;:!?''"()-]', '', 'g')),
                  length(regexp_replace(t, '[^\x23-\x26\x2A\x2B\x2F\x3C-\x3E\x40\x5B-\x60\x7B-\x7E]', '', 'g')),
                  length(regexp_replace(t, '[\x00-\x7F]', '', 'g')), length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')),
                  length(regexp_replace(t, '[^\x00-\x08\x0E-\x1F\x7F]', '', 'g'))] AS l FROM doc)
), q_cls AS (
  SELECT k, c, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY k) AS q FROM (
    SELECT c, n, k FROM cls WHERE k IS NOT NULL)
  GROUP BY k, c
), js_cls AS (
  SELECT r, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
                              + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS js
  FROM (SELECT r, k, c, n::DOUBLE / total AS p FROM cls WHERE total > 0) x JOIN q_cls USING (k, c) GROUP BY r
), res AS (
  SELECT doc.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         coalesce(js_cls.js, 0) AS jc, coalesce(js_word.js, 0) AS jw
  FROM doc LEFT JOIN js_cls ON doc.r = js_cls.r LEFT JOIN js_word ON doc.r = js_word.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words >= 50 AND jc > 0.29) AND NOT (n_words >= 50 AND jw > 0.44) AS kept
FROM res
"""
