"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage is
encoded: shares of byte classes, word statistics (length, distinct words,
repeats of the word before, words that end in a mark) and hashed byte pairs,
through a learned layer.  Gated attention weighs the passages,

    a_k  ~  exp(w . (tanh(V h_k) * sigmoid(U h_k))),    z = sum a_k h_k,

and a logistic unit scores z.  Encoder, attention and unit are learned together
from document labels only, by Adam on the log loss.  All passages of all
documents are scored, whatever the length.

Learning takes a bounded sample: about ``TRAIN_DOCS`` labelled documents by hash
of the id, among those of up to ``TRAIN_DOC_BYTES`` bytes, so what the driver
holds is bounded; all other steps cover all rows.

Defined results: a null or empty text is a bag of one passage without words and
is scored like any other; a document with several labels takes the highest;
a null id is never learned from nor held out; repeated rows are scored alike;
without labels of both kinds every score is the labels' mean (0.5 without any);
an empty table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import SPACE, Words, read_table, remainder, text_slices
from tabulon.session import ship_package

PASSAGE_WORDS = 64
HASHED = 256
HIDDEN = 32
ATTENTION = 16
TRAIN_DOCS = 5000
TRAIN_DOC_BYTES = 32 << 10
EPOCHS, STEP, DECAY = 30, 3e-3, 1e-4
THRESHOLD = 0.3

# Byte classes of a passage's first features.
CLASS_OF = np.full(256, 5)
CLASS_OF[97:123] = 0
CLASS_OF[65:91] = 1
CLASS_OF[48:58] = 2
CLASS_OF[[ord(c) for c in ".,;:!?'\"()-"]] = 3
CLASS_OF[SPACE] = 4
CLASS_OF[128:256] = 6
CLASSES = 7
STATS = 5
FEATURES = CLASSES + STATS + HASHED


def passages(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, number of passages of each text); a text without words has one."""
    w = Words(col)
    n = len(w.counts)
    per_doc = np.maximum(1, -(-w.counts // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(per_doc)])
    total = first[-1]
    x = np.zeros((total, FEATURES), np.float32)
    place = np.arange(len(w.starts)) - w.edges[:-1][w.doc]  # of a word in its text
    passage = first[:-1][w.doc] + place // PASSAGE_WORDS
    # a passage's bytes: from its first word (or its text's begin) to the next passage
    doc_of = np.repeat(np.arange(n), per_doc)
    begin = w.offsets[:-1][doc_of].copy()
    later = np.flatnonzero(np.arange(total) != first[:-1][doc_of])
    heads = np.flatnonzero((place % PASSAGE_WORDS == 0) & (place > 0))
    begin[later] = w.starts[heads]
    size = np.diff(np.append(begin, len(w.data)))
    of = np.repeat(np.arange(total), size)
    x[:, :CLASSES] = np.bincount(of * CLASSES + CLASS_OF[w.data], minlength=total * CLASSES).reshape(total, CLASSES)
    x[:, :CLASSES] /= np.maximum(size, 1)[:, None]
    if len(w.starts):
        words = np.maximum(np.bincount(passage, minlength=total), 1)
        s = x[:, CLASSES: CLASSES + STATS]
        s[:, 0] = np.bincount(passage, weights=np.minimum(w.ends - w.starts, 40), minlength=total) / words / 10
        key = pa.array(passage * len(w.vocabulary) + w.codes).unique().to_numpy() // len(w.vocabulary)
        s[:, 1] = np.bincount(key, minlength=total) / words
        again = np.zeros(len(w.codes), bool)
        again[1:] = (w.codes[1:] == w.codes[:-1]) & (place[1:] > 0)
        s[:, 2] = np.bincount(passage[again], minlength=total) / words
        mark = CLASS_OF[w.data[w.ends - 1]]
        s[:, 3] = np.bincount(passage[mark == 3], minlength=total) / words
        s[:, 4] = np.bincount(passage[mark == 5], minlength=total) / words
    if len(w.data) > 1:
        pair = (w.data[:-1].astype(np.uint32) << 8 | w.data[1:]) * np.uint32(2654435761) >> np.uint32(24)
        same = of[:-1] == of[1:]
        hashed = np.bincount(of[:-1][same] * HASHED + pair[same], minlength=total * HASHED).reshape(total, HASHED)
        x[:, CLASSES + STATS:] = np.sqrt(hashed / np.maximum(size, 1)[:, None])
    return x, per_doc


class AttentionModel:
    """Weights: encoder (W, b), gates (V, U, w) and the document's unit (c, d); inputs are standardised first."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.p = {"W": rng.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
                  "V": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, ATTENTION)), "U": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, ATTENTION)),
                  "w": rng.normal(0, ATTENTION ** -0.5, ATTENTION), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.constant: float | None = None

    def _forward(self, x: np.ndarray, per_doc: np.ndarray) -> dict:
        p = self.p
        edges = np.concatenate([[0], np.cumsum(per_doc)])[:-1]
        of = np.repeat(np.arange(len(per_doc)), per_doc)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, edges)[of])
        a = e / np.add.reduceat(e, edges)[of]
        z = np.add.reduceat(a[:, None] * h, edges, axis=0)
        return {"of": of, "h": h, "t": t, "g": g, "a": a, "z": z, "s": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}

    def score(self, x: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(per_doc), self.constant)
        return self._forward((x - self.mean) * self.scale, per_doc)["s"].astype(np.float64)

    def _gradient(self, x: np.ndarray, per_doc: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self._forward(x, per_doc)
        of, h, t, g, a = f["of"], f["h"], f["t"], f["g"], f["a"]
        ds = (f["s"] - y) / len(y)
        dz = ds[:, None] * p["c"]
        da = np.einsum("ij,ij->i", dz[of], h)
        de = a * (da - np.bincount(of, weights=a * da, minlength=len(y))[of])
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = a[:, None] * dz[of] + dt @ p["V"].T + dg @ p["U"].T
        dpre = dh * (1 - h * h)
        return {"W": x.T @ dpre, "b": dpre.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de,
                "c": f["z"].T @ ds, "d": ds.sum(keepdims=True)}

    def train(self, x: np.ndarray, per_doc: np.ndarray, y: np.ndarray, seed: int = 7) -> "AttentionModel":
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean = x.mean(axis=0)
        self.scale = (1 / np.maximum(x.std(axis=0), 1e-3)).astype(np.float32)
        x = (x - self.mean) * self.scale
        edges = np.concatenate([[0], np.cumsum(per_doc)])
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        at = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for batch in np.array_split(order, max(1, len(order) // 64)):
                rows = np.concatenate([np.arange(edges[k], edges[k + 1]) for k in batch])
                grad = self._gradient(x[rows], per_doc[batch], y[batch])
                at += 1
                for k, v in grad.items():
                    v = v + DECAY * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] = (self.p[k] - STEP * (first[k] / (1 - 0.9 ** at)) / (np.sqrt(second[k] / (1 - 0.999 ** at)) + 1e-8)).astype(np.float32)
        return self


def _encoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches, "text"):
        x, per_doc = passages(b.column("text"))
        edges = np.concatenate([[0], np.cumsum(per_doc)])
        rows = [x[edges[k]: edges[k + 1]].astype(np.float16).tobytes() for k in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(rows, pa.binary())], names=["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AttentionModel:
    """Learn from the labelled ones of ``docs``, from a sample if they are many (see the module's text)."""
    ship_package(docs.sparkSession)
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col(label_col).cast("double")).alias("y"))
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = y.count()
    share = min(1.0, TRAIN_DOCS / max(n, 1))
    y = y.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    size = F.octet_length("text")
    some = src.join(y, "id").where(size <= TRAIN_DOC_BYTES)
    bag = some.select("text", "y").mapInArrow(_encoder, "y double, x binary").limit(2 * TRAIN_DOCS).toArrow()
    bags = [np.frombuffer(v, np.float16).reshape(-1, FEATURES) for v in bag["x"].to_pylist()]
    per_doc = np.array([len(v) for v in bags], np.int64)
    x = np.concatenate([*bags, np.zeros((0, FEATURES), np.float16)]).astype(np.float32)
    return AttentionModel().train(x, per_doc, bag["y"].to_numpy())


def _scorer(model: AttentionModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "__text"):
            x, per_doc = passages(b.column("__text"))
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(model.score(x, per_doc))], names=["__row", "score"])

    return score


def score(docs: DataFrame, model: AttentionModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``score`` (0 to 1)."""
    ship_package(docs.sparkSession)
    src = docs.select(F.struct(*[docs[c] for c in keep]).alias("__row"), docs[text_col].cast("string").alias("__text"))
    kind = src.schema["__row"].dataType.simpleString()
    return src.mapInArrow(_scorer(model), f"__row {kind}, score double").select("__row.*", "score")


def op3_attention_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(remainder("doc_id", 5) != 0), read_table(spark, sf_dir, "labels"))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
