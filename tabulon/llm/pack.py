"""Packing by power-of-two decomposition: every sequence is one piece of one document.

A document's ids (with an end id) are cut into pieces of ``max_tokens`` and then
of the powers of two that make up the rest, longest first.  Pieces of equal
length form a bucket from which batches are drawn, so no sequence is padded and
none crosses documents.  A piece is numbered inside its task and the number
carries the task's partition and the bucket, so sequences need no shuffle.

Ids come from a ``tokenizers`` file whose pre-tokenizer never joins text across
white space (checked on the file when it is opened).  Each distinct word of a
slice of the input is encoded once and ids are put together with numpy.

Defined results: a null or empty text has the end id only; rows that repeat are
packed each; an empty table gives no piece; texts of any length are cut whole.
``keep`` columns of the input travel with each piece, the pieces' own columns
take precedence over input columns of the same name.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import SLICE_BYTES, Words, read_table, text_slices
from tabulon.session import ship_package

MAX_TOKENS = 4096
END_ID = 2
CACHE_WORDS = 1_000_000  # encoded words that a Python worker remembers

MARKS, ALNUM = np.zeros(256, bool), np.zeros(256, bool)
MARKS[list(b".,;:!?")] = True
ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True

PIECE_COLUMNS = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Ids of words.  Each is encoded once while it stays in the memory of about ``CACHE_WORDS`` words:
    ``place`` numbers the words, ``start`` and ``size`` give their stretch of ``pool``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        words = ["Aa", "b1,", "it's", "é..", "x"]
        whole = self._encode([" \n".join(words)])[0].ids
        if whole != [i for e in self._encode(words) for i in e.ids]:
            raise ValueError("this tokenizer joins text across white space; encode whole texts instead")
        self.normalized = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.word_ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.pool, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _remember(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        known = len(self.place)
        self.place.update(zip(words, range(known, known + len(words)), strict=True))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.pool = np.concatenate([self.pool, ids.astype(np.uint32)])

    def _add(self, words: list[bytes], texts: list[str]) -> None:
        found = [e.ids for e in self._encode(texts)]
        self._remember(words, np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))

    def _letters(self, text: str) -> bool:
        """Letters only, and letters still when they are normalized: some become a letter and a mark of its own, which
        the tokenizer joins with what follows."""
        return text.isalpha() and (text.isascii() or self.normalized(text).isalpha())

    def _add_letters(self, words: list[bytes], texts: list[str]) -> None:
        """Words of letters only: encoded as one text, cut after each id that ends a word."""
        ids = np.array(self._encode([" ".join(texts)])[0].ids, dtype=np.uint32)
        ends = np.flatnonzero(self.word_ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):  # a letter that the normalizer takes apart
            self._add(words, texts)
        else:
            self._remember(words, ids, np.diff(ends, prepend=0))

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words one after the other, offsets of the words in them)."""
        size = self.size[places]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.pool[np.repeat(self.start[places] - total[:-1], size) + np.arange(total[-1])], total

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Places of words, for :meth:`gather`."""
        if len(self.place) > CACHE_WORDS:
            self._forget()
        place = self.place
        at = list(map(place.get, words))
        new = [w for w, k in zip(words, at, strict=True) if k is None]
        texts = [w.decode() for w in new]
        letters, marked, rest = {}, [], []
        for w, t in zip(new, texts, strict=True):
            if self._letters(t):
                letters[w] = t
            elif t[-1] in ".,;:!?" and self._letters(t[:-1]):  # the word's ids and the mark's
                marked.append((w, w[:-1], w[-1:]))
                if w[:-1] not in place:
                    letters[w[:-1]] = t[:-1]
            else:
                rest.append((w, t))
        for some in batched(letters.items(), 50_000):
            self._add_letters([w for w, _ in some], [t for _, t in some])
        marks = [m for m in {m for _, _, m in marked} if m not in place]
        self._add(marks, [m.decode() for m in marks])
        rest = [(w, t) for w, t in rest if w not in place]
        self._add([w for w, _ in rest], [t for _, t in rest])
        if marked:
            both = np.array([(place[core], place[m]) for _, core, m in marked])
            ids, total = self.gather(both.ravel())
            self._remember([w for w, _, _ in marked], ids, np.diff(total[::2]))
        return np.array([place[w] if k is None else k for w, k in zip(words, at, strict=True)], np.int64)


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_texts(col: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, each with its end id; offsets of the texts in them)."""
    words = Words(col, code=False)
    # "word," is two units, the word and the mark, if a letter or digit of ASCII stands before the mark
    size = words.ends - words.starts
    last, before = words.data[words.ends - 1], words.data[np.maximum(words.ends - 2, 0)]
    marked = (size > 1) & MARKS[last] & ALNUM[before]
    edges = np.insert(words.word_offsets, np.flatnonzero(marked) + 1, words.word_offsets[1:][marked] - 1)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [
        None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(words.letters))]).dictionary_encode()
    codes = units.indices.to_numpy(zero_copy_only=False)
    words.edges = words.edges + np.concatenate([[0], np.cumsum(marked)])[words.edges]
    encoder = word_encoder(path)
    ids, total = encoder.gather(encoder(units.dictionary.to_pylist())[codes])
    offsets = total[words.edges] + np.arange(len(words.edges))  # an end id for each text before
    out = np.full(offsets[-1], end_id, np.uint32)
    doc_of = np.repeat(np.arange(len(words.counts)), np.diff(total[words.edges]))
    out[np.arange(len(ids)) + doc_of] = ids
    return out, offsets


def piece_lengths(tokens: int, max_tokens: int) -> list[int]:
    rest = tokens % max_tokens
    return [max_tokens] * (tokens // max_tokens) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _packer(path: str, max_tokens: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = TaskContext.get().partitionId(), [0] * max_tokens.bit_length()
        for b in text_slices(batches, "__text", 2 * SLICE_BYTES):
            ids, offsets = encode_texts(b.column("__text"), path, end_id)
            doc, start, length, numbers = [], [], [], []
            for k, n in enumerate(np.diff(offsets).tolist()):
                at = 0
                for size in piece_lengths(n, max_tokens):
                    bucket = size.bit_length() - 1
                    doc.append(k)
                    start.append(at)
                    length.append(size)
                    numbers.append(part << 40 | counts[bucket] << 4 | bucket)
                    counts[bucket] += 1
                    at += size
            doc = np.array(doc, np.int64)
            # pieces follow one another in the ids without a gap
            edges = np.concatenate([[0], np.cumsum(np.array(length, np.int64))]) * 4
            taken = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(edges), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [b.column("__row").take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), taken.cast(pa.binary()),
                 pa.array(np.diff(offsets)[doc], pa.int64()), pa.array(numbers, pa.int64()), pa.array(np.zeros(len(doc), np.int64))],
                names=["__row", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return cut


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID,
         text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Pieces of all documents: ``keep`` columns, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id (one sequence a piece; its low four bits name the bucket) and offset (always 0)."""
    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    ship_package(docs.sparkSession)
    own = {x.split()[0] for x in PIECE_COLUMNS.split(", ")}
    keep = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text_col]) if c not in own]
    src = docs.select(F.struct(*[docs[c] for c in keep]).alias("__row"), docs[text_col].cast("string").alias("__text"))
    kind = src.schema["__row"].dataType.simpleString()
    return src.mapInArrow(_packer(tokenizer_path, max_tokens, end_id), f"__row {kind}, {PIECE_COLUMNS}").select("__row.*", *own_order())


def own_order() -> list[str]:
    return [x.split()[0] for x in PIECE_COLUMNS.split(", ")]


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_pack_pow2(spark, sf_dir, name: str = "word_bpe_49k.json"):
    import public_tokenizers
    return digest(pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(name), keep=["doc_id"]))
