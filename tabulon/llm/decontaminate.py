"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

``positional_index`` stores the postings (term, row, position) of the documents in
the shared folder, with one header record a document.  ``phrase_matches`` looks up
phrases of the test set in it:

1. the terms of a phrase are ordered by the length of their lists; a phrase with a
   term that no document has is given up at once;
2. the lists of its two rarest terms are shifted to a common position and
   intersected.  Phrases that share the pair and its distance share this step;
   the intersection is a grouping, so repeated rows do not multiply;
3. the phrases of the pairs that are left are looked up at their start: the other
   terms' lists are joined by (row, position, term), and a phrase occurs where all
   of its terms are found.

``proximity_matches`` finds the places where all terms of a phrase lie, in any
order, within a span of positions, also from the rarest term on.

Words: A-Z are lower-cased, a word is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  Positions
count from 1.  Only the test set's vocabulary is indexed if it is of a proven size
(``VOCABULARY_ROWS`` terms and ``VOCABULARY_BYTES`` bytes), as it is then broadcast;
beyond that every word is indexed, with the same results.

Defined results: a null or empty text has no words and no matches; a null text of
an item gives no window; an item of fewer than ``size`` words is one window; items of
equal id and equal texts are found in the same documents, and equal item ids count
once; rows without an id or with one id are documents of their own, as the index
numbers rows itself; overlapping matches count a word once; a very long text is one
row of words while it is read and afterwards ordinary postings; empty tables give no
matches; other columns, also ones named ``row``, ``term`` or ``pos``, are only kept
within a struct.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import BROADCAST_ROWS, read_table, written

# What separates words (A-Z are letters before they are lower-cased).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
VOCABULARY_ROWS = 200_000
VOCABULARY_BYTES = 4 << 20
MOST_SPAN = 60  # starts of a span are bits of one long


def words_of(text: Column) -> Column:
    """The words of a text, not yet lower-cased; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), "")


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return (F.when(F.octet_length(word) == F.length(word), F.lower(word))
            .when(word.rlike("[A-Z]"), F.translate(word, UPPER, LOWER)).otherwise(word))


@dataclass
class PositionalIndex:
    """``documents`` (row, n_words, keep) and ``postings`` (term, row, pos) of one written table."""

    documents: DataFrame
    postings: DataFrame


def _small(terms: DataFrame) -> bool:
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("b")).first()
    return size["n"] <= VOCABULARY_ROWS and size["b"] <= VOCABULARY_BYTES


def positional_index(docs: DataFrame, terms: DataFrame | None = None, text_col: str = "text",
                     keep: Sequence[str] = ("doc_id",)) -> PositionalIndex:
    """Write the postings of ``docs``; with ``terms`` (term), of these terms only if they are few enough to broadcast.

    Each document also writes a header, the record of position 0, with its columns
    ``keep``.  Header and postings are numbered in the same pass, so they belong
    together whatever task is run again.
    """
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("keep"), words_of(docs[text_col]).alias("words"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "keep", F.size("words").cast("long").alias("n_words"), "words")
    records = rows.select("row", "keep", "n_words", F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "word"))
    records = records.select("row", "keep", "n_words", "pos", lower_ascii(F.col("word")).alias("term"))
    if terms is not None:
        terms = terms.select("term").distinct()
        if _small(terms):
            known = F.broadcast(terms.withColumn("known", F.lit(True)))
            records = records.join(known, "term", "left").where("pos = 0 or known")
    head = F.col("pos") == 0
    index = written(records.select("row", "pos", "term", F.when(head, F.col("keep")).alias("keep"),
                                   F.when(head, F.col("n_words")).alias("n_words")), "postings")
    return PositionalIndex(index.where("pos = 0").select("row", "n_words", "keep"),
                           index.where("pos > 0").select("term", "row", "pos"))


def _few(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` if it is counted small; otherwise leave the join to the planner."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _by_rarity(index: PositionalIndex, phrases: DataFrame) -> DataFrame:
    """(phrase, terms, size, ranked): offsets and terms from the rarest on; phrases with an unknown term go."""
    asked = phrases.select("phrase", "terms", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    vocabulary = asked.select("term").distinct()
    lists = written(index.postings.join(_few(vocabulary), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "lists")
    ranked = asked.join(_few(lists), "term").groupBy("phrase", "terms", "size").agg(
        F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("ranked"))  # the words of one phrase
    return ranked.where(F.size("ranked") == F.col("size"))


def phrase_matches(index: PositionalIndex, phrases: DataFrame) -> DataFrame:
    """Exact occurrences (row, phrase, start, size) of ``phrases`` (phrase long, terms array), each phrase a different one."""
    first, second = F.col("ranked")[0], F.get(F.col("ranked"), F.lit(1))
    plan = _by_rarity(index, phrases).select(
        "phrase", "terms", "size", first["term"].alias("t1"), first["offset"].alias("o1"),
        second["term"].alias("t2"), (second["offset"] - first["offset"]).alias("apart"))
    plan = written(plan, "phrases")
    # one leg: the two rarest terms and their distance; a phrase of one word has no second term
    legs = plan.groupBy("t1", "t2", "apart").agg(F.xxhash64(F.col("t1"), F.col("t2"), F.col("apart")).alias("h"))
    legs = written(legs.select(F.monotonically_increasing_id().alias("leg"), "t1", "t2", "apart"), "legs")
    sides = legs.select("leg", F.col("t1").alias("term"), F.lit(0).alias("shift"), F.lit(1).alias("side")).unionByName(
        legs.where("t2 is not null").select("leg", F.col("t2").alias("term"), F.col("apart").alias("shift"), F.lit(2).alias("side")))
    lists = index.postings.join(_few(sides), "term").select("row", "leg", (F.col("pos") - F.col("shift")).alias("at"), "side")
    both = lists.groupBy("row", "leg", "at").agg(F.bit_or("side").alias("sides"))
    met = both.join(_few(legs), "leg").where((F.col("sides") == 3) | ((F.col("sides") == 1) & F.col("t2").isNull()))
    leg_of = plan.join(legs, plan["t1"].eqNullSafe(legs["t1"]) & plan["t2"].eqNullSafe(legs["t2"])
                       & plan["apart"].eqNullSafe(legs["apart"])).select("leg", "phrase", "terms", "size", "o1")
    starts = met.select("row", "leg", "at").join(_few(leg_of), "leg").select(
        "row", "phrase", "size", "terms", (F.col("at") - F.col("o1")).alias("start")).where("start >= 1")
    starts = written(starts, "starts")
    done = starts.where("size <= 2")
    asked = starts.where("size > 2").select("row", "phrase", "size", "start", F.posexplode("terms").alias("offset", "term"))
    asked = asked.select("row", "phrase", "size", "start", "term", (F.col("start") + F.col("offset")).alias("pos"))
    candidates = starts.select("row").distinct()
    postings = index.postings
    if candidates.count() <= VOCABULARY_ROWS:  # longs: a size that is proven small
        postings = postings.join(F.broadcast(candidates), "row", "left_semi")
    found = asked.join(postings, ["row", "pos", "term"]).groupBy("row", "phrase", "start", "size").agg(
        F.count(F.lit(1)).alias("n")).where("n = size")
    return found.select("row", "phrase", "start", "size").unionByName(done.select("row", "phrase", "start", "size"))


def proximity_matches(index: PositionalIndex, phrases: DataFrame, span: int) -> DataFrame:
    """Places (row, phrase, start) where all different terms of a phrase lie within ``span`` positions from ``start``.

    For each occurrence of the rarest term, the starts of spans that hold both it and
    a given posting are bits of a number: or-ed for a term, and-ed over the terms.
    ``start`` is the first such span's; a start that several occurrences give is returned once.
    """
    if not 1 <= span <= MOST_SPAN:
        raise ValueError(f"span must be from 1 to {MOST_SPAN}")
    different = phrases.select("phrase", F.array_distinct("terms").alias("terms")).where(F.size("terms") > 0)
    plan = written(_by_rarity(index, different).select("phrase", "size", "ranked"), "near")
    rarest = plan.select("phrase", F.col("ranked")[0]["term"].alias("term"))
    others = plan.select("phrase", F.explode("ranked").alias("r")).select("phrase", F.col("r.term").alias("term"))
    anchors = index.postings.join(_few(rarest), "term").select("row", "phrase", F.col("pos").alias("at"))
    # a posting can share a span with anchors of its own block of positions and of the two next to it
    blocks = anchors.withColumn("block", F.explode(F.array(*[F.floor(F.col("at") / span) + k for k in (-1, 0, 1)])))
    near = index.postings.join(_few(others), "term").withColumn("block", F.floor(F.col("pos") / span))
    met = blocks.join(near, ["row", "phrase", "block"]).where(F.abs(F.col("pos") - F.col("at")) < span)
    # bit b stands for the span that starts at at - b
    low = F.greatest(F.lit(0), F.col("at") - F.col("pos"))
    high = F.least(F.lit(span - 1), F.col("at") - F.col("pos") + span - 1)
    bits = F.call_function("shiftleft", F.lit(1).cast("long"), (high + 1).cast("int")) - F.call_function(
        "shiftleft", F.lit(1).cast("long"), low.cast("int"))
    per_term = met.groupBy("row", "phrase", "at", "term").agg(F.bit_or(bits).alias("starts"))
    every = per_term.groupBy("row", "phrase", "at").agg(F.bit_and("starts").alias("starts"), F.count(F.lit(1)).alias("n"))
    every = every.join(_few(plan.select("phrase", "size")), "phrase").where("n = size and starts <> 0")
    top = F.length(F.bin("starts")) - 1  # the earliest start
    return every.select("row", "phrase", F.greatest(F.col("at") - top, F.lit(1)).alias("start")).distinct()


def windows(items: DataFrame, size: int = WINDOW, text_col: str = "text") -> DataFrame:
    """``items`` with ``terms``: one row for each ``size`` consecutive words; an item with fewer words is one row."""
    words = F.transform(words_of(items[text_col]), lower_ascii)
    rows = items.select(F.struct(*[items[c] for c in items.columns]).alias("item"), words.alias("words")).where("size(words) > 0")
    last = F.greatest(F.size("words") - size + 1, F.lit(1))
    return rows.select("item", "words", F.explode(F.sequence(F.lit(1), last)).alias("at")).select(
        "item", F.slice("words", F.col("at"), F.lit(size)).alias("terms"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, text_col: str = "text", item_col: str = "item_id",
                  keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keep..., n_words, n_hit, items): words of each document inside any occurrence of a test window, and the sorted
    ids (as strings) of the items that have such a window."""
    cut = written(windows(items.select(F.col(item_col).cast("string").alias("id"), F.col(text_col).alias("text")), size)
                  .select("item.id", "terms"), "windows")
    different = written(cut.groupBy("terms").agg(F.count(F.lit(1)).alias("n"))
                        .select(F.monotonically_increasing_id().alias("phrase"), "terms"), "different")
    index = positional_index(docs, different.select(F.explode("terms").alias("term")), text_col, keep)
    found = written(phrase_matches(index, different), "found")
    before = F.max(F.col("start") + F.col("size")).over(
        Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("size")
    hit = found.select("row", F.greatest(end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0)).alias("new"))
    hit = hit.groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    owners = cut.join(different, "terms").select("phrase", "id").distinct()
    listed = (found.select("row", "phrase").distinct().join(_few(owners), "phrase").where("id is not null")
              .groupBy("row").agg(F.array_sort(F.collect_set("id")).alias("items")))  # the test items of one document
    out = index.documents.join(hit, "row", "left").join(listed, "row", "left")
    return out.select("keep.*", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op12_positional_index(spark, sf_dir):
    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), grams AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
), found AS (
  SELECT DISTINCT r, i, g.k, g.t FROM grams g JOIN (SELECT DISTINCT k, t FROM win) v ON g.t = v.t AND g.k = v.k
), hit AS (
  SELECT r, count(*)::BIGINT AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r
), items AS (
  SELECT r, count(*)::BIGINT AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found JOIN win USING (k, t) WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
