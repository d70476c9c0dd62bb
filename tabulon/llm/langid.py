"""Language identification with a string kernel.

Two texts are as similar as the number of byte n-grams (``1..MAX_N``, A-Z in
lower case) that occur in both, over the root of the product of their own
numbers: the blended-spectrum presence kernel.  Landmark texts per language span
a Nystroem feature space (K_nL K_LL^-1/2), in which a ridge regression is fitted
one language against the rest.  Kernel, whitening and ridge weights of a landmark
are linear in the presence vector, so scoring is one matrix product of a batch's
presence matrix with one column a language, over the whole texts.

Learning takes bounded samples by hash of the id: about ``TRAIN_ROWS`` rows and
``LANDMARKS`` landmarks a language (landmarks among texts of up to
``LANDMARK_CHARS`` characters; a language without one drawn has the start of its shortest text).
Every language with a row to learn from is learned, whatever its share; beyond
``ALL_LANDMARKS`` / ``LANDMARKS`` languages each has fewer landmarks, one at
least, so the driver's state grows with the number of languages and not with the
rows.  N-grams of no landmark are orthogonal to all of them and left out.

Defined results: a null text or one without a letter is ``und`` with score 0; a
null lang or id is not learned from; a null id is not held out; repeated rows are
scored alike; without a row to learn from everything is ``und``; an empty table
gives an empty result; other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import read_table, remainder, text_slices, utf8_bytes
from tabulon.session import ship_package

MAX_N = 3
TRAIN_ROWS = 1500       # a language
LANDMARKS = 64          # a language
LANDMARK_CHARS = 20_000
ALL_LANDMARKS = 1024
RIDGE = 1e-2            # times the number of rows
SHARPNESS = 6.0
UNKNOWN = "und"
BATCH_ROWS = 256


def gram_codes(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of each n-gram, its code) for n = 1..MAX_N; codes of different n differ."""
    data, off = utf8_bytes(col)
    up = (data >= 65) & (data <= 90)
    data = np.where(up, data + 32, data).astype(np.int32)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    code = data.copy()
    base = 0
    for n in range(1, MAX_N + 1):
        if n > 1:
            code = (code[:-1] << 8) | data[n - 1:]
        whole = row[: len(code)] == row[n - 1:]
        yield row[: len(code)][whole], code[whole] + base
        base += 256 ** n


CODES = sum(256 ** n for n in range(1, MAX_N + 1))


class Vocabulary:
    """Places of the n-grams that occur in a landmark."""

    def __init__(self, codes: np.ndarray):
        self.size = len(codes)
        self.place = np.full(CODES, self.size, np.int32)
        self.place[codes] = np.arange(self.size, dtype=np.int32)

    def presence(self, col: pa.Array) -> np.ndarray:
        out = np.zeros((len(col), self.size + 1), np.uint8)
        for row, code in gram_codes(col):
            out[row, self.place[code]] = 1
        return out[:, : self.size]


def distinct_codes(col: pa.Array) -> np.ndarray:
    seen = np.zeros(CODES, bool)
    for _, code in gram_codes(col):
        seen[code] = True
    return np.flatnonzero(seen)


def normed(presence: np.ndarray) -> np.ndarray:
    """Presence vectors of length 1: their products are the normalised kernel."""
    x = presence.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1.0))


def _share(counts: dict[str, int], rows: int) -> Column:
    """For a row's language, the share of its rows that makes about ``rows``."""
    pairs = [F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows / n))]
    return F.create_map(*pairs)[F.col("lang")]


def _moments(codes: np.ndarray, landmarks: np.ndarray, languages: list[str]):
    """Sums over a part of the sample: kernel features times themselves, and times the languages' targets."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, m = Vocabulary(codes), len(landmarks)
        gram, target, n = np.zeros((m, m)), np.zeros((m, len(languages))), 0
        for b in text_slices(batches, "text", max_rows=BATCH_ROWS):
            k = (normed(vocabulary.presence(b.column("text"))) @ landmarks.T).astype(np.float64)
            y = np.array(languages)[None, :] == np.array(b.column("lang").to_pylist(), dtype=object)[:, None]
            gram += k.T @ k
            target += k.T @ np.where(y, 1.0, -1.0)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([target.tobytes()], pa.binary()), pa.array([n], pa.int64())],
                                         names=["gram", "target", "n"])

    return add


class LanguageModel:
    def __init__(self, languages: list[str], codes: np.ndarray, weights: np.ndarray):
        self.languages, self.codes, self.weights = languages, codes, weights


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    ship_package(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    src = src.where("id is not null and text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0)))
    languages = sorted(counts)
    known = src.where(F.col("lang").isin(languages))

    def draw(salt: int, rows: int) -> DataFrame:
        u = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
        return known.where(u <= _share(counts, rows))

    each = min(LANDMARKS, max(1, ALL_LANDMARKS // len(languages)))
    marks = draw(1, each).where(F.length("text") <= LANDMARK_CHARS).orderBy("lang", F.xxhash64("id")).limit(2 * each * len(languages)).toArrow()
    texts = marks["text"].combine_chunks()
    without = sorted(set(languages) - set(marks["lang"].to_pylist()))
    if without:
        short = known.where(F.col("lang").isin(without)).groupBy("lang").agg(F.min_by("text", F.struct(F.length("text"), F.xxhash64("id"))).alias("text"))
        more = short.orderBy("lang").select(F.substring("text", 1, LANDMARK_CHARS).alias("text")).toArrow()["text"].combine_chunks()
        texts = pa.concat_arrays([texts.cast(more.type), more])
    codes = distinct_codes(texts)
    landmarks = normed(Vocabulary(codes).presence(texts))
    parts = draw(2, TRAIN_ROWS).repartition(16).mapInArrow(_moments(codes, landmarks, languages), "gram binary, target binary, n long").collect()
    m = len(landmarks)
    gram = sum(np.frombuffer(r["gram"]).reshape(m, m) for r in parts)
    target = sum(np.frombuffer(r["target"]).reshape(m, -1) for r in parts)
    n = sum(r["n"] for r in parts)
    value, vector = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # K_LL^-1/2 on the space the landmarks span
    ridge = np.linalg.solve(root.T @ gram @ root + RIDGE * max(n, 1) / m * np.eye(keep.sum()), root.T @ target)
    return LanguageModel(languages, codes, (landmarks.T @ (root @ ridge)).astype(np.float32))


def _scorer(model: LanguageModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model.codes)
        for b in text_slices(batches, "__text", max_rows=BATCH_ROWS):
            text = b.column("__text")
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if model.languages:
                raw = SHARPNESS * (normed(vocabulary.presence(text)) @ model.weights).astype(np.float64)
                p = np.exp(raw - raw.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                names = np.array(model.languages, dtype=object)[p.argmax(axis=1)]
            else:
                p, names = np.zeros((b.num_rows, 1)), np.full(b.num_rows, UNKNOWN, dtype=object)
            names[~lettered] = UNKNOWN
            best = np.where(lettered, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(names, pa.string()), pa.array(best)], names=["__row", "lang_pred", "score"])

    return score


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``."""
    ship_package(docs.sparkSession)
    src = docs.select(F.struct(*[docs[c] for c in keep]).alias("__row"), docs[text_col].cast("string").alias("__text"))
    kind = src.schema["__row"].dataType.simpleString()
    return src.mapInArrow(_scorer(model), f"__row {kind}, lang_pred string, score double").select("__row.*", "lang_pred", "score")


def op4_string_kernel_langid(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(remainder("doc_id", 4) != 2))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out, "lang_pred", "score")
