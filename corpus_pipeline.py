"""From raw documents to packed training sequences, one operator a stage.

Every stage takes the documents that its predecessor left (Parquet, read again)
and returns documents of the same columns; the last returns pieces of sequences.
Rows that repeat a ``doc_id`` with its text are repeats of a document; rows of one
id with other texts, and rows without an id, are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import read_table, shared_dir
from tabulon.llm.mix import emit, mix_sources
from tabulon.llm.pack import digest, pack
from tabulon.llm.rules import quality_rules
from tabulon.llm.simhash import simhash_components
from tabulon.llm.suffix import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each judged within its own language."""
    return quality_rules(docs, own=True).where("rules.kept").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest id (no id comes last), then of the smallest text hash."""
    # two 64-bit hashes; a struct is never null, so rows without an id are found again too
    key = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    keyed = docs.withColumn("__key", key)
    found = simhash_components(keyed, id_col="__key")
    stays = found.where(F.col("__key") == F.col("component_id")).groupBy("__key").agg(F.count(F.lit(1)).alias("rows"))
    once = keyed.join(stays.where("rows = 1").select("__key"), "__key", "left_semi")
    repeated = keyed.join(stays.where("rows > 1").select("__key"), "__key", "left_semi").dropDuplicates(["__key"])
    return once.unionByName(repeated).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that the suffix operator removes; a character that is cut in two goes as a whole."""
    found = suffix_dedup(docs, keep=["doc_id", "lang", "source"], as_text=True).withColumnRenamed("kept", "text")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return emit(mix_sources(docs)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their digests."""
    import public_tokenizers
    return digest(pack(docs, public_tokenizers.path(TOKENIZER), keep=["doc_id"]))


STAGES = [
    ("quality rules", keep_quality),
    ("simhash near-dedup", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each stage's documents are written in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = shared_dir(spark, f"stage-{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


# Packing needs a tokenizer's vocabulary, which SQL cannot express.
ORACLE_SQL = None
