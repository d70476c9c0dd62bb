"""Importance resampling towards a target distribution, from hashed word n-grams.

Features are the runs of one to three consecutive words; a feature's bucket is the
crc32 of its bytes, words joined by a space, modulo ``BUCKETS``.  No feature is ever
built as a string:

1. the distinct words of a piece of text, each bounded by a delimiter on both sides,
   go into an Aho-Corasick automaton; a word's payload is its crc32, the crc32 of
   the word and a space, and its length in bytes;
2. the automaton scans the piece once and emits a payload a word (the mark between
   two documents is a word of its own);
3. neighbouring payloads are composed: ``crc(AB) = shift(crc(A), bytes of B) xor crc(B)``,
   where the shift is a table lookup a byte (``Crc``).

One scan counts buckets over all documents and all target texts; the logarithms of
the ratio of the two smoothed distributions are the buckets' gains; a second scan
sums the gains of each document's features.  Documents are drawn without
replacement by the largest scores, weight plus Gumbel noise that is hashed from the id.

What the driver holds is a number a bucket.  A task holds one slice of texts: a
text beyond ``PIECE_BYTES`` is scanned in pieces that end between words, with the last two
payloads carried over, and a word of over ``LONG_WORD`` characters stands in the automaton
under a short name.

Defined results: a null or empty text has no features and weight 0; a null id is
hashed as ``null`` and comes after other ids among equal scores; rows that repeat
are scored alike and drawn one by one; of rows with equal score and id those with
fewer features come first; empty documents give an empty result, an empty target a
target distribution of smoothing alone; other columns are kept (input columns
``resample`` and ``draw`` are replaced).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.ranking import row_index
from tabulon.llm.common import SLICE_BYTES, read_table, text_slices, utf8_bytes, written
from tabulon.session import ship_package

BUCKETS = 10_000
PIECE_BYTES = SLICE_BYTES // 2  # the automaton of a piece should stay in a processor's cache
LONG_WORD = 200
LEAST_WORDS = 20
SHARE = (5, 100)

# 0-9, a-z and every byte of other scripts belong to words, A-Z become lower case, the rest stands between words.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
POLYNOMIAL = 0xEDB88320  # of crc32, lowest bit first
MARK, NAME = "\x01", "\x02"  # delimiters in a text, so free here


class Crc:
    """Composition of crc32 values: ``shift(crc, size)`` is what ``crc`` gives to the crc of a text with ``size`` bytes more."""

    SHORT = 64

    def __init__(self):
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLYNOMIAL), byte >> 1).astype(np.uint32)
        one = np.zeros((4, 256), np.uint32)  # a zero byte more
        for k in range(4):
            value = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
            one[k] = byte[value & 255] ^ (value >> 8)
        same = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        short = [same]
        for _ in range(self.SHORT - 1):
            short.append(self._apply(one, short[-1]))
        self.short = np.stack(short).reshape(-1)
        powers = [one]  # 1, 2, 4, ... zero bytes
        while len(powers) < 40:
            powers.append(self._apply(powers[-1], powers[-1]))
        self.powers = powers

    @staticmethod
    def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]

    def shift(self, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        low = np.minimum(size, self.SHORT - 1) * 1024
        out = (self.short[low + (crc & 255)] ^ self.short[low + 256 + ((crc >> 8) & 255)]
               ^ self.short[low + 512 + ((crc >> 16) & 255)] ^ self.short[low + 768 + (crc >> 24)])
        far = np.flatnonzero(size >= self.SHORT)
        if len(far):
            value, rest = crc[far], size[far]
            for k, table in enumerate(self.powers):
                some = (rest >> k & 1).astype(bool)
                value[some] = self._apply(table, value[some])
            out[far] = value
        return out


def _payloads(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, crc, crc with a space, bytes) of the words of ``text`` in order; the mark has number 0.

    Words are between spaces; ``text`` starts and ends with one.
    """
    named: dict[str, str] = {}
    if re.search(f"[^ ]{{{LONG_WORD + 1},}}", text):
        def name(found: re.Match) -> str:
            short = f"{NAME}{len(named)}"
            named[short] = found[0]
            return short

        text = re.sub(f"[^ ]{{{LONG_WORD + 1},}}", name, text)
    words = sorted(set(text.split(" ")) - {"", MARK})  # neighbours in the automaton are neighbours in memory
    raw = [named.get(word, word).encode() for word in words] if named else [word.encode() for word in words]
    size = np.fromiter(map(len, [b"", *raw]), np.int64, len(words) + 1)
    crc = np.fromiter(map(zlib.crc32, [b"", *raw]), np.uint32, len(words) + 1)
    spaced = _CRC.shift(crc, np.ones(len(crc), np.int64)) ^ np.uint32(zlib.crc32(b" "))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    automaton.add_word(f" {MARK} ", 0)
    for k, word in enumerate(words, 1):
        automaton.add_word(f" {word} ", k)
    automaton.make_automaton()
    numbers = np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64)
    return numbers, crc, spaced, size


def _pieces(col: pa.Array) -> Iterator[tuple[int, bytes, bool]]:
    """(first row, words of rows that follow one another with a mark between them, it goes on from the piece before)."""
    data, offsets = utf8_bytes(col)
    text = data.tobytes().translate(TO_WORDS)
    if len(text) <= 2 * PIECE_BYTES:
        yield 0, f" {MARK} ".encode().join(text[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())), False
        return
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        first = True
        while a < b or first:
            end = b if b - a <= PIECE_BYTES else text.find(b" ", a + PIECE_BYTES, b)
            end = b if end < 0 else end
            yield row, text[a:end], not first
            a, first = end, False


_CRC = Crc()


def features(col: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket, words in the feature) of all features of a column of texts, piece by piece."""
    held = np.zeros((3, 0), np.int64)  # crc, crc with a space and bytes of the last two words of the text so far
    for first, words, goes_on in _pieces(col):
        number, crc, spaced, size = _payloads(f" {words.decode()} ")
        row = first + np.cumsum(number == 0)
        word = number > 0
        row, number = row[word], number[word]
        carried = held if goes_on else held[:, :0]
        n = carried.shape[1]
        row = np.concatenate([np.full(n, first), row])
        crc = np.concatenate([carried[0].astype(np.uint32), crc[number]])
        spaced = np.concatenate([carried[1].astype(np.uint32), spaced[number]])
        size = np.concatenate([carried[2], size[number]])
        two = _CRC.shift(spaced[:-1], size[1:]) ^ crc[1:]
        two_spaced = _CRC.shift(spaced[:-1], size[1:] + 1) ^ spaced[1:]
        three = _CRC.shift(two_spaced[:-1], size[2:]) ^ crc[2:]
        fresh = np.arange(len(row)) >= n  # a feature belongs to the piece of its last word
        for length, hashed in ((1, crc), (2, two), (3, three)):
            last = row[length - 1:]
            inside = (last == row[:len(last)]) & fresh[length - 1:]
            yield last[inside], (hashed[inside] % np.uint32(buckets)).astype(np.int64), np.full(np.count_nonzero(inside), length)
        held = np.stack([crc[-2:].astype(np.int64), spaced[-2:].astype(np.int64), size[-2:]])


def _counter(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in text_slices(batches, "__text", PIECE_BYTES):
            for _, bucket, _ in features(b.column("__text"), buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; ``buckets`` numbers reach the driver."""
    ship_package(texts.sparkSession)
    counted = texts.select(texts[text_col].cast("string").alias("__text")).mapInArrow(_counter(buckets), "bucket int, n long")
    total = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log) of each bucket's smoothed share in the target over its share in the source."""
    s, t, buckets = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _scorer(gain: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "__text", PIECE_BYTES):
            n = b.num_rows
            number, words, weight = (np.zeros(n, np.int64) for _ in range(3))
            for row, bucket, length in features(b.column("__text"), len(gain)):
                found = np.bincount(row, minlength=n)
                number += found
                if len(length) and length[0] == 1:
                    words += found
                weight += np.bincount(row, weights=gain[bucket], minlength=n).astype(np.int64)  # whole numbers below 2^53
            scored = pa.StructArray.from_arrays([pa.array(number), pa.array(words), pa.array(weight)], names=["n_features", "n_words", "weight"])
            yield pa.RecordBatch.from_arrays([b.column(0), scored], names=["__row", "resample"])

    return score


def weighed(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text",
            keep: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``resample`` = struct(n_features, n_words, weight)."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets))
    cols = [docs[c] for c in (docs.columns if keep is None else keep) if c not in ("resample", "draw")]
    src = docs.select(F.struct(*cols).alias("__row"), docs[text_col].cast("string").alias("__text"))
    kind = src.schema["__row"].dataType.simpleString()
    return src.mapInArrow(_scorer(gain), f"__row {kind}, resample struct<n_features: long, n_words: long, weight: long>").select("__row.*", "resample")


def draw(docs: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``weighed`` with ``draw`` = struct(score, rank): the rank of the drawn ones, from 1; null for others.

    ``floor(share)`` of the documents with ``least_words`` words or more are drawn.
    """
    # the first 32 bits of a digest, which other engines repeat
    seeded = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(seeded, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), (F.col("resample.weight") + noise).cast("long").alias("score"),
                       (F.col("resample.n_words") < least_words).alias("short"), F.col(id_col).alias("id"))
    rows = written(rows.select("__row", "score", "short", "id", (-F.col("score")).alias("from_top"), F.col("id").isNull().alias("no_id"),
                               F.col("__row.resample.n_features").alias("features")), "scored")
    drawn = share[0] * rows.where("not short").count() // share[1]
    placed = row_index(rows, ["short", "from_top", "no_id", "id", "features"], name="place")
    rank = F.when(~F.col("short") & (F.col("place") < drawn), F.col("place") + 1).cast("long")
    return placed.select("__row.*", F.struct("score", rank.alias("rank")).alias("draw"))


def op11_importance_resampling(spark, sf_dir):
    scored = weighed(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return draw(scored).select("doc_id", "resample.n_features", "resample.weight", "draw.score", "draw.rank")


OP11_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), texts AS (
  SELECT row_number() OVER () AS r, doc_id, true AS is_doc, text FROM documents UNION ALL SELECT -row_number() OVER (), NULL, false, text FROM benchmark
), w AS (
  SELECT r, doc_id, is_doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts
), f AS (
  SELECT r, is_doc, array_to_string(ws[i:i + k - 1], ' ') AS f
  FROM (SELECT r, is_doc, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k)
), keyed AS (
  SELECT f, hex(f) AS x FROM (SELECT DISTINCT f FROM f)
), hashed AS (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(x) + 1, 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket FROM keyed, crc
), fb AS (
  SELECT r, is_doc, bucket, count(*) AS n FROM f JOIN hashed USING (f) GROUP BY r, is_doc, bucket
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE is_doc), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE NOT is_doc), 0)::DOUBLE AS t FROM fb GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM sums) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS g FROM sums
), weight AS (
  SELECT r, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM fb JOIN gain USING (bucket) WHERE is_doc GROUP BY r
), scored AS (
  SELECT w.r, w.doc_id, len(ws) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(w.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE)
           / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weight USING (r) WHERE is_doc
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY words < 20, score DESC, doc_id NULLS LAST, n_features) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN words >= 20 AND place <= (SELECT 5 * count(*) // 100 FROM scored WHERE words >= 20) THEN place END AS rank
FROM ranked
"""
