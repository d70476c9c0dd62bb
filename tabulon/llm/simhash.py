"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint has a bit set if it is set in over half the hashes of
its word shingles.  Fingerprints within four bits are linked and a document's
component is the smallest id it can reach.

Equal fingerprints are one node.  A fingerprint is cut into three segments (22,
21 and 21 bits).  With four errors either two segments have at most one each, or
one has none and the next has two.  The perfect Golay code decodes any 23-bit
word to one codeword, so a fingerprint is stored under six keys (three pairs of
codeword indices; three whole segments with the next one's index) and looks up
the indices of every word within one or two bits, 160 keys or so in place of
the 1,900 that flipping bits would need.  What meets is verified by bit count.

Defined results: a null, empty or blank text has fingerprint zero, linked like
any other; repeated rows are labelled each; a null id never names a component
(one of null ids only has a null component); an empty table gives an empty
result; other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Words, hot_aware_join, read_table, text_slices, written
from tabulon.llm.components import connected_components
from tabulon.session import ship_package

SHINGLE = 4
SEED = 42


def fingerprints_of(col: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints of texts: a bit is set if it is set in over half the shingles' hashes."""
    import xxhash

    w = Words(col, lower=True, code=False)
    n_words, n = len(w.starts), len(w.counts)
    out = np.zeros(n, np.uint64)
    if not n_words:
        return out
    # the words with one space before each; a shingle is a stretch of these bytes
    lengths = w.ends - w.starts
    text = np.full(len(w.letters) + n_words, 32, np.uint8)
    text[np.arange(len(w.letters)) + np.repeat(np.arange(n_words), lengths) + 1] = w.letters
    first = w.word_offsets[:-1] + np.arange(n_words) + 1
    last = first + lengths
    per_doc = np.where(w.counts > 0, np.maximum(w.counts - shingle + 1, 1), 0)
    edges = np.concatenate([[0], np.cumsum(per_doc)])
    head = np.repeat(w.edges[:-1], per_doc) + np.arange(edges[-1]) - np.repeat(edges[:-1], per_doc)
    tail = np.minimum(head + shingle, np.repeat(w.edges[1:], per_doc)) - 1
    view, digest = memoryview(text), xxhash.xxh64_intdigest
    hashes = np.array([digest(view[a:b], SEED) for a, b in zip(first[head].tolist(), last[tail].tolist(), strict=True)], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = np.flatnonzero(per_doc)
    sums = np.add.reduceat(bits, edges[:-1][some], axis=0, dtype=np.int32)
    major = (sums * 2 > per_doc[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(major, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


# ---------------------------------------------------------------- Golay code
# The generator polynomial of the perfect [23, 12, 7] code and its sizes.
GENERATOR, LENGTH, CHECKS = 0xC75, 23, 11
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width; together 64 bits


def _syndromes(words: np.ndarray) -> np.ndarray:
    words = words.copy()
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        words ^= (words >> bit & 1) * (GENERATOR << (bit - CHECKS))
    return words


def _error_patterns() -> np.ndarray:
    """The error of weight 3 or less for each syndrome: the code is perfect, so there is exactly one."""
    errors = [0] + [1 << i for i in range(LENGTH)]
    errors += [1 << i | 1 << j for i in range(LENGTH) for j in range(i)]
    errors += [1 << i | 1 << j | 1 << k for i in range(LENGTH) for j in range(i) for k in range(j)]
    errors = np.array(errors, np.int64)
    table = np.zeros(1 << CHECKS, np.int64)
    table[_syndromes(errors)] = errors
    return table


ERRORS = _error_patterns()
LOW = _syndromes(np.arange(1 << 12))
HIGH = _syndromes(np.arange(1 << CHECKS) << 12)


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    return (words ^ ERRORS[LOW[words & 0xFFF] ^ HIGH[words >> 12]]) >> CHECKS


def _distinct_rows(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted codes of each row, which of them are the first of their value)."""
    codes = np.sort(codes, axis=1)
    first = np.ones(codes.shape, bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    return codes, first


def _near_codes(words: np.ndarray, width: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords nearest to any word within ``distance`` bits of each word."""
    flips = [0] + [1 << i for i in range(width)]
    if distance == 2:
        flips += [1 << i | 1 << j for i in range(width) for j in range(i)]
    return _distinct_rows(codeword_index(words[:, None] ^ np.array(flips, np.int64)[None, :]))



def _combine(kind: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A key: its kind, a code or a whole segment (up to 24 bits), and a code (12 bits)."""
    return (np.int64(kind) << 36) | left.astype(np.int64) << 12 | right.astype(np.int64)


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    return [(prints >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64) for first, width in SEGMENTS]


def index_keys(prints: np.ndarray) -> np.ndarray:
    """(n, 6) keys under which a fingerprint is stored."""
    parts = _segments(prints)
    codes = [codeword_index(p) for p in parts]
    return np.stack([_combine(k, codes[k], codes[(k + 1) % 3]) for k in range(3)]
                    + [_combine(3 + k, parts[k], codes[(k + 1) % 3]) for k in range(3)], axis=1)


def probe_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each key, key): all keys under which a fingerprint within four bits may be stored."""
    parts = _segments(prints)
    one = [_near_codes(p, width, 1) for p, (_, width) in zip(parts, SEGMENTS, strict=True)]
    two = [_near_codes(p, width, 2) for p, (_, width) in zip(parts, SEGMENTS, strict=True)]
    rows, keys = [], []
    for k in range(3):
        (left, is_left), (right, is_right) = one[k], one[(k + 1) % 3]
        r, i, j = np.nonzero(is_left[:, :, None] & is_right[:, None, :])
        rows.append(r)
        keys.append(_combine(k, left[r, i], right[r, j]))
        right, is_right = two[(k + 1) % 3]
        r, j = np.nonzero(is_right)
        rows.append(r)
        keys.append(_combine(3 + k, parts[k][r], right[r, j]))
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(find):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                prints = b.column(0).slice(at, 1000).to_numpy(zero_copy_only=False).view(np.uint64)
                rows, keys = find(prints)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[rows].view(np.int64))], names=["key", "fp"])

    return emit


def _stored(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = index_keys(prints)
    return np.repeat(np.arange(len(prints)), keys.shape[1]), keys.ravel()


def _meeting_points(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values within two bits: two fingerprints within four bits share at least one."""
    flips = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    points = prints[:, None] ^ np.array(flips, np.uint64)[None, :]
    return np.repeat(np.arange(len(prints)), len(flips)), points.ravel().view(np.int64)


# ---------------------------------------------------------------- linking
def fingerprint_links(prints: DataFrame, max_bits: int = 4, hot_rows: int = 1000) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column ``fp``) within ``max_bits`` (up to 4) of each other.

    Below ``hot_rows`` stored fingerprints a key, all pairs that meet are verified.
    Fingerprints that meet a key with more are linked through their meeting points
    instead, which gives the same components from a number of rows in proportion.
    """
    ship_package(prints.sparkSession)
    if not 0 <= max_bits <= 4:
        raise ValueError("the segments cover up to 4 differing bits")
    stored = prints.select("fp").mapInArrow(_keyed(_stored), "key long, fp long")
    hot = written(stored.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("key"), "hot-keys")
    index = written(stored.join(hot, "key", "left_anti").withColumn("hot", F.lit(False))
                    .unionByName(hot.select("key", F.lit(0).cast("long").alias("fp"), F.lit(True).alias("hot"))), "index")
    probes = prints.select("fp").mapInArrow(_keyed(probe_keys), "key long, fp long")
    distance = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("i.fp")))
    # many keys come from a narrow table, so the planner would take them for small
    met = probes.hint("merge").alias("p").join(index.alias("i"), F.col("p.key") == F.col("i.key")).where(
        F.col("i.hot") | ((F.col("p.fp") < F.col("i.fp")) & (distance <= max_bits)))
    met = written(met.select(F.col("p.fp").alias("a"), F.col("i.fp").alias("b"), "hot").distinct(), "met")
    links = met.where(~F.col("hot")).select("a", "b")
    crowd = met.where("hot").select(F.col("a").alias("fp")).distinct()
    if crowd.isEmpty():
        return links
    if max_bits < 4:  # meeting points stand for exactly four bits
        raise ValueError("raise hot_rows: crowded keys are handled for 4 bits only")
    points = crowd.mapInArrow(_keyed(_meeting_points), "key long, fp long")
    least = written(points.groupBy("key").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most")
                    .select("key", "least"), "points")
    near = points.hint("merge").join(least, "key").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()
    return links.unionByName(near)


def _printer(shingle: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fingerprints_of(b.column("text"), shingle).view(np.int64))],
                                             names=["id", "fp"])

    return of


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = 4, id_col: str = "doc_id",
                       text_col: str = "text", hot_rows: int = 1000) -> DataFrame:
    """(id_col, fingerprint long, component_id) for each row of ``docs``."""
    ship_package(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    prints = written(src.mapInArrow(_printer(shingle), f"id {kind}, fp long"), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = connected_components(fingerprint_links(distinct, max_bits, hot_rows))
    placed = written(distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", "n", F.coalesce("root", "fp").alias("root")), "placed")
    # most components are one fingerprint, which is its own root and meets no other
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    least = written(least.where("prints > 1"), "least")
    large = least.where(F.col("prints") >= distinct.count() / 1000.0)  # at most 1,000 components
    label = hot_aware_join(placed, least.select("root", "component_id"), ["root"], large, ["fp"])
    label = written(label.select("fp", "n", F.coalesce("component_id", "first").alias("component_id")), "labels")
    hot = label.where(F.col("n") >= prints.count() / 1000.0)  # at most 1,000 fingerprints
    joined = hot_aware_join(prints, label.select("fp", "component_id"), ["fp"], hot, ["id"])
    return joined.select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def op6_golay_simhash(spark, sf_dir):
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
