"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, a target is derived for each source, and each
document is emitted ``floor(rate)`` times plus one more time if a number that is
hashed from its id and text falls below the rate's fraction (``rate = target / size of
the source``).

Targets: the sources share ``total`` times all sizes by weight; no target
exceeds ``max_rate`` times its source's size, and what is over goes to the other
sources by weight until none is above.  That is the level ``L`` with
``sum(min(cap, L * weight)) = total``: with the sources in order of
``cap / weight`` it follows from running sums, so sources are never collected.

Defined results: a null text has size 0; a null source is a source of its own
and comes last; a source of size 0 has target 0 and its documents are emitted
0 times; rows that repeat with one ``doc_id`` and text get the same number of copies
(so a source made of few different rows can miss its target by as much as one of
them weighs), rows without an id are told apart by their texts; an
empty table gives an empty result.  Other columns are kept; an input column ``mix`` is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.ranking import running_sums
from tabulon.llm.common import BROADCAST_ROWS, hot_aware_join, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from a key and a text: the first 52 bits of an MD5, which other engines repeat."""
    of_text = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), of_text, F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int], total: float, max_rate: float) -> DataFrame:
    """``sizes`` (source, n_rows, size) with ``target``: see the module's text."""
    order = sizes.withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    placed = running_sums(order, ["no_source", "source"], [], name="place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("place") % len(weights) + 1).cast("int"))
    capped = (placed.withColumn("weight", weight).withColumn("cap", F.col("size") * F.lit(float(max_rate)))
              .withColumn("ratio", F.col("cap") / F.col("weight")))
    capped = running_sums(capped, ["ratio", "place"], ["cap", "weight"], name="nth")
    whole = capped.agg(F.sum("size").alias("s"), F.sum("weight").alias("w")).first()  # two numbers
    share = float(total) * float(whole["s"] or 0)
    # the level if exactly the sources before this one are at their cap
    level = (F.lit(share) - F.col("cap_before")) / (F.lit(float(whole["w"] or 1)) - F.col("weight_before"))
    found = (capped.where(level <= F.col("ratio")).agg(F.min_by(level, "nth").alias("level")).first()["level"])
    by_level = F.col("cap") if found is None else F.least(F.col("cap"), F.col("weight") * F.lit(float(found)))
    return capped.select("no_source", "source", "n_rows", F.col("size").alias("source_size"), by_level.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), total: float = 1.5, max_rate: float = 2.0,
                seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``mix`` = struct(size, source_size, target, copies): how often each row is emitted."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "mix"]).alias("row"))
    row = row.select("row", word_count(F.col(f"row.{text_col}")).alias("size"),
                     F.coalesce(F.col(f"row.{source_col}"), F.lit("")).alias("source"),
                     F.col(f"row.{source_col}").isNull().alias("no_source"))
    per_source = docs.groupBy(F.col(source_col).alias("source")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(word_count(F.col(text_col))).alias("size"))
    targets = written(source_targets(per_source, weights, total, max_rate), "sources")
    on = ["source", "no_source"]
    if targets.count() <= BROADCAST_ROWS:
        joined = row.join(F.broadcast(targets), on, "left")
    else:
        rows = targets.agg(F.sum("n_rows")).first()[0]
        hot = targets.where(F.col("n_rows") >= rows / 1000.0)  # at most 1,000 sources
        joined = hot_aware_join(row, targets, on, hot, [f"row.{id_col}"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (uniform(F.col(f"row.{id_col}"), F.col(f"row.{text_col}"), seed) < rate - F.floor(rate)).cast("long")
    return joined.select("row.*", F.struct("size", "source_size", "target", copies.cast("long").alias("copies")).alias("mix"))


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy, with the documents' columns only."""
    copy = F.explode(F.array_repeat(F.lit(1), F.col("mix.copies").cast("int")))
    return mixed.withColumn("mix", copy).drop("mix")


def op8_mix_sources(spark, sf_dir):
    from tabulon.llm.common import read_table
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target",
                        (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS of_text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s
), c AS (
  SELECT *, 2 * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM w
), r AS (
  SELECT *, row_number() OVER o AS nth,
         coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS cap_before,
         coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS weight_before
  FROM c WINDOW o AS (ORDER BY ratio, place)
), l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - cap_before)
            / ((SELECT sum(weight) FROM w)::DOUBLE - weight_before) AS level FROM r
), found AS (
  SELECT min_by(level, nth) AS level FROM l WHERE level <= ratio
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(weight * (SELECT level FROM found), cap::DOUBLE)) AS target FROM r
), m AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':' || of_text || ':42'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM m
"""
