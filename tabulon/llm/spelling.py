"""Spelling variants of a vocabulary by a bit-sliced position index.

Two words are near if they differ by one inserted, deleted or replaced letter.  The
index of a block of up to 64 words holds, for each (position, letter), one number
whose bits are the words that have this letter there.  A word is compared with the
whole block at once: letter by letter it keeps the set of words without an error so
far, the set with one replaced letter, and the set with one letter more, whose
positions are shifted by one; each step is an ``and`` with the index (of the next
position for the shifted set).  A word that leaves the first set at letter i has its
error at i, so every pair is found at one place only.

To meet only words that can be near, class ``l`` pairs words of ``l`` letters with
words of ``l`` and ``l + 1`` letters, and a region [a, b) of the class holds the pairs whose
error is at a letter from a to b - 1: these agree in the first a and the last l - b
letters, which name a bucket.  Every class starts with two regions; a bucket of
over ``BUCKET_WORDS`` words is divided into the two halves of its region, until it is small
or the region is one letter (then its words differ in two letters at most).  This
loses no pair, so the index stays bounded however common a beginning is.

Defined results: texts that are null or empty have no words; a null id counts as
the text ``null``; rows that repeat count again; of near words with equal counts the
smaller in code-point order is the form; an empty table gives an empty result;
other columns are never read.  A word or text may be of any length: a word is in
four buckets, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import BROADCAST_ROWS, read_table, release_memory, written
from tabulon.session import ship_package

# The letters of a run; A-Z alone are lower-cased.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST = 7
DAMAGE = 31
FACTOR = 10
BUCKET_WORDS = 1024
TASK_ROWS = 100_000
CHUNK_PAIRS, CHUNK_CELLS = 1 << 18, 1 << 21


def lower_ascii(word: Column) -> Column:
    return (F.when(F.octet_length(word) == F.length(word), F.lower(word))
            .when(word.rlike("[A-Z]"), F.translate(word, UPPER, LOWER)).otherwise(word))


def damaged(word: Column, key: Column, every: int) -> Column:
    """``word`` without the code point that the crc32 of ``key:word`` names, if ``every`` divides that number."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % every == 0, cut).otherwise(word)


def word_counts(docs: DataFrame, shortest: int = SHORTEST, least: int = 2, every: int | None = None,
                text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, n) of the runs of letters with ``shortest`` letters or more that occur ``least`` times or more."""
    # a run of fewer letters cannot become a longer word
    runs = F.regexp_extract_all(docs[text_col], F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    found = docs.select(docs[id_col].alias("id"), F.explode(runs).alias("run")).select("id", lower_ascii(F.col("run")).alias("word"))
    if every:
        found = found.select(damaged(F.col("word"), F.col("id"), every).alias("word")).where(F.length("word") >= shortest)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


# ----------------------------------------------------------------- buckets
def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (word, n, size, class, a, b) with ``key``: the letters that all words of the bucket share."""
    tail = F.greatest(F.col("class") - F.col("b"), F.lit(0))
    return rows.withColumn("key", F.concat_ws(" ", "a", "b", F.substring("word", F.lit(1), F.col("a")),
                                              F.when(tail > 0, F.substring("word", F.col("size") - tail + 1, tail)).otherwise("")))


def _halves(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    part = F.explode(F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b"))))
    return _keyed(rows.withColumn("part", part).select("word", "n", "size", "class", "part.a", "part.b"))


def buckets(words: DataFrame, most: int = BUCKET_WORDS) -> DataFrame:
    """(word, n, size, class, a, b, key): every word in the buckets of its two classes."""
    rows = words.select("word", "n", F.length("word").alias("size"))
    # the word as the shorter one of a pair, and as the longer one
    rows = rows.withColumn("class", F.explode(F.array(F.col("size"), F.col("size") - 1))).where("class >= 1")
    rows = written(_halves(rows.withColumn("a", F.lit(0)).withColumn("b", F.col("class") + 1)), "buckets")
    done = None
    while True:
        hot = rows.where("b - a > 1").groupBy("class", "key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most).select("class", "key")
        hot = written(hot, "hot")
        count = hot.count()
        if count and count <= BROADCAST_ROWS:
            hot = F.broadcast(hot)
        small = rows.join(hot, ["class", "key"], "left_anti") if count else rows
        done = small.select(*_ROW) if done is None else done.unionByName(small.select(*_ROW))
        if not count:
            return done
        rows = written(_halves(rows.join(hot, ["class", "key"], "left_semi").select("word", "n", "size", "class", "a", "b")), "halves")


_ROW = ["class", "key", "a", "b", "size", "word", "n"]


# ----------------------------------------------------------------- the index of some buckets
def near_pairs(letters: np.ndarray, offsets: np.ndarray, bucket: np.ndarray, size: int, low: np.ndarray, high: np.ndarray):
    """Pairs of rows (shorter or equal, other, one letter more) within buckets of one class.

    ``letters``/``offsets`` are the words as code points, ``bucket`` the row's bucket from 0
    in order, ``size`` the class and ``low``/``high`` the row's region.
    """
    n = np.diff(offsets)
    rows = np.arange(len(n))
    alphabet, code = np.unique(letters, return_inverse=True)
    first = np.searchsorted(bucket, np.arange(bucket[-1] + 1))  # first row of each bucket
    members = np.diff(np.append(first, len(rows)))
    blocks = (members + 63) // 64
    block_from = np.concatenate([[0], np.cumsum(blocks)])
    place = rows - first[bucket]
    block, bit = block_from[bucket] + place // 64, np.uint64(1) << (place % 64).astype(np.uint64)
    table = np.zeros((int(block_from[-1]), size + 2, len(alphabet)), np.uint64)
    owner = np.repeat(rows, n)
    at = np.arange(len(letters)) - offsets[:-1][owner]
    np.bitwise_or.at(table, (block[owner], at, code), bit[owner])
    equal, longer = np.zeros(len(table), np.uint64), np.zeros(len(table), np.uint64)
    np.bitwise_or.at(equal, block[n == size], bit[n == size])
    np.bitwise_or.at(longer, block[n == size + 1], bit[n == size + 1])
    # a line for each (word of the class, block of its bucket)
    ask = rows[n == size]
    many = blocks[bucket[ask]]
    word = np.repeat(ask, many)
    against = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(block_from[bucket[ask]], many)
    same = equal[against] | longer[against]
    replaced, inserted = np.zeros(len(word), np.uint64), np.zeros(len(word), np.uint64)
    for i in range(size):
        letter = code[offsets[word] + i]
        here, next_ = table[against, i, letter], table[against, i + 1, letter]
        leaves = np.where((low[word] <= i) & (i < high[word]), same & ~here, np.uint64(0))
        replaced = (replaced & here) | leaves
        inserted = (inserted | leaves) & next_
        same = same & here
        live = (same | replaced | inserted) != 0
        if 2 * np.count_nonzero(live) < len(live):
            word, against, same, replaced, inserted = word[live], against[live], same[live], replaced[live], inserted[live]
    replaced &= equal[against]
    inserted |= np.where((low[word] <= size) & (size < high[word]), same, np.uint64(0))
    inserted &= longer[against]
    first_row = np.repeat(first, blocks) + 64 * (np.arange(len(table)) - np.repeat(block_from[:-1], blocks))
    found = []
    for bits in (replaced, inserted):
        line = np.flatnonzero(bits)
        which, member = np.nonzero(np.unpackbits(bits[line].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        found.append((word[line][which], first_row[against[line][which]] + member))
    return found


def _code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    text = words.to_pylist()
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, text), np.int64, len(text)))])
    return np.frombuffer("".join(text).encode("utf-32-le"), dtype=np.uint32), offsets


def _pairs_of(table: pa.Table, bucket: np.ndarray) -> pa.RecordBatch:
    words, count = table["word"].combine_chunks(), table["n"].combine_chunks()
    letters, offsets = _code_points(words)
    replaced, inserted = near_pairs(letters, offsets, bucket, table["class"][0].as_py(), table["a"].to_numpy(), table["b"].to_numpy())
    one = pa.array(np.concatenate([replaced[0], inserted[0], inserted[1]]))
    two = pa.array(np.concatenate([replaced[1], inserted[1], inserted[0]]))
    return pa.RecordBatch.from_arrays([words.take(one), words.take(two), count.take(two)], names=["word", "near", "near_n"])


def _chunks(table: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole buckets of one class, so many that the index and the lines stay bounded."""
    size, key = table["class"].to_numpy(), table["key"].combine_chunks().dictionary_encode().indices.to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (size[1:] != size[:-1]) | (key[1:] != key[:-1])]))
    members = np.diff(np.append(starts, len(size)))
    blocks = (members + 63) // 64
    begin, pairs, cells = 0, 0, 0
    for k in range(len(starts) + 1):
        if k < len(starts):
            more, wide = int(members[k] * blocks[k]), int(blocks[k] * (size[starts[k]] + 2) * 64)
            if k == begin or size[starts[k]] == size[starts[begin]] and pairs + more <= CHUNK_PAIRS and cells + wide <= CHUNK_CELLS:
                pairs, cells = pairs + more, cells + wide
                continue
        end = starts[k] if k < len(starts) else len(size)
        yield table.slice(starts[begin], end - starts[begin]), np.repeat(np.arange(k - begin), members[begin:k])
        if k < len(starts):
            begin, pairs, cells = k, more, wide


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of sorted rows; the last bucket of a batch waits for the next batch, as it may go on there."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        now = pa.Table.from_batches([b])
        now = now if held is None else pa.concat_tables([held, now])
        last = now.num_rows - 1
        of = (now["class"][last], now["key"][last])
        whole = last
        size, key = now["class"], now["key"]
        while whole >= 0 and key[whole] == of[1] and size[whole] == of[0]:
            whole -= 1
        held = now.slice(whole + 1)
        for table, bucket in _chunks(now.slice(0, whole + 1)) if whole >= 0 else []:
            yield _pairs_of(table, bucket)
    if held is not None:
        for table, bucket in _chunks(held):
            yield _pairs_of(table, bucket)
    release_memory()


def near_words(words: DataFrame, most: int = BUCKET_WORDS) -> DataFrame:
    """(word, near, near_n): each near word of each of ``words`` (word, n), once."""
    ship_package(words.sparkSession)
    rows = buckets(words, most)
    spark = words.sparkSession
    # an explicit number: the rows are few bytes for much work
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows.count() // TASK_ROWS))
    dealt = rows.repartition(tasks, "class", "key").sortWithinPartitions("class", "key")
    return dealt.mapInArrow(_near, "word string, near string, near_n long")


# ----------------------------------------------------------------- forms
def _joinable(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): chains are followed by doubling; counts grow along them, so they end."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(_joinable(on), "root", "left_semi").isEmpty():
            return now
        now = written(now.join(_joinable(on), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_groups(words: DataFrame, factor: float = FACTOR, most: int = BUCKET_WORDS) -> DataFrame:
    """``words`` (word, n) with the form, root, n_near and form_n of each word.

    A word's form is its near word of largest n, if that is at least ``factor`` times
    its own; the root is the last word of the forms of forms.
    """
    words = written(words.select("word", "n"), "words")
    near = near_words(words, most).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    best = -F.col("best.less")
    takes = best >= factor * F.col("n")
    judged = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best.near")).alias("form"), F.when(takes, best).cast("long").alias("form_n")), "forms")
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_bit_sliced_spelling(spark, sf_dir):
    return spelling_groups(word_counts(read_table(spark, sf_dir, "documents"), every=DAMAGE))


OP13_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT id, run, count(*) AS times FROM (
    SELECT coalesce(doc_id::VARCHAR, 'null') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]{7,}')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY id, run
), keyed AS (
  SELECT run, times, hex(id || ':' || run) AS x FROM runs
), hashed AS (
  SELECT run, times, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(x) + 1, 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM keyed, crc
), cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), without AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n FROM without a JOIN without b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, l.word, l.n FROM words w JOIN without l ON l.rest = w.word
  UNION SELECT l.word, w.word, w.n FROM words w JOIN without l ON l.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS top, min(near) FILTER (WHERE n = m) AS first
  FROM (SELECT *, max(n) OVER (PARTITION BY word) AS m FROM near) GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 10 * w.n THEN first END AS form,
         CASE WHEN top >= 10 * w.n THEN top END::BIGINT AS form_n FROM words w LEFT JOIN best USING (word)
), chain AS (
  WITH RECURSIVE c AS (
    SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL
  ) SELECT c.word, c.root FROM c JOIN forms f ON c.root = f.word WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word)
"""
