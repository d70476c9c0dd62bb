"""Exact substring removal from sorted suffix runs, merged without comparing known prefixes twice.

Every byte covered by a ``min_bytes`` long string that also starts anywhere else
is removed; documents are UTF-8 byte strings and matches stay inside them.

*Which suffixes are sorted.*  Of the ``GRAM``-byte strings inside a window of
``min_bytes`` the one with the least hash (leftmost on ties) is the window's
anchor.  Equal windows have their anchor at the same place, so windows need only
be compared below equal anchors: consecutive windows with one anchor are a
segment, its suffix runs from the anchor to the end of the last window and its
left context from the first window to the anchor.  That is one suffix for some
60 bytes, and none is lost.  Anchors whose string occurs once in all documents
are counted out before anything is sorted (their distinguishing prefix is
shorter than ``GRAM``).

*Sorting.*  Tasks sort the suffixes of their documents into runs, in the order of
the anchor's fingerprint and then of the bytes: only suffixes with an equal
anchor can match, and fingerprints make ranges of equal size without sampling.
Runs are front-coded (each suffix without the prefix it shares with the one
before; left contexts likewise from their right end), cut by range, exchanged,
and merged by a loser tree that keeps each player's common prefix with the last
suffix put out and compares from there on.

*Matches.*  Equal segments repeat as a whole.  Where a group of one anchor holds
different segments, the merged common prefixes say which suffix agrees with a
neighbour far enough to hold a whole window together with its left context; the
windows of those are compared.

*Hot anchors.*  An anchor with a large part of all occurrences (at most
``4 x partitions`` of them) does not go to one task: its windows are counted by
grouping on a 128-bit hash and joined back.  Texts with at least a thousandth of
all rows as exact copies are removed whole and only one copy goes on as a partner
for others.

Defined results: a null or empty text has no bytes and nothing is removed; a text
shorter than ``min_bytes`` stays; repeated rows are copies of each other; rows of
one id with different texts are different documents; an empty table gives an
empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import hot_aware_join, read_table, text_slices, utf8_bytes, written
from tabulon.session import ship_package

MIN_BYTES = 200
GRAM = 64
CHUNK = 1 << 16         # windows hashed at once: arrays that stay in a core's cache
RUN_SUFFIXES = 50_000   # suffixes of a sorted run
RANGES = 8             # ranges of fingerprints a partition, at least
RANGE_SUFFIXES = 50_000  # suffixes of a range on average, at most
PART_BYTES = 1 << 20   # segments whose windows are compared at once, or one anchor's

# Odd multipliers of the rolling hashes and of the last mixing.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = 0xBF58476D1CE4E5B9


def _letters(seed: int) -> np.ndarray:
    """A number for each byte, from one multiplicative rule."""
    x = (np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 1000)) * np.uint64(BASES[1])
    x ^= x >> np.uint64(31)
    return x * np.uint64(MIX) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(32))


def _power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def rolling(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``length`` bytes from each position, by doubling."""
    base = BASES[seed]
    part = _letters(seed)[data]  # of 1, 2, 4, ... bytes
    out, done, size = None, 0, 1
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    while True:
        if length & size:
            here = part[done: done + n]
            out = here if out is None else out * _power(base, size) + here
            done += size
        if size * 2 > length:
            return _mixed(out)
        part = part[:-size] * _power(base, size) + part[size:]
        size *= 2


class Segments:
    """Segments of a slice: ``doc``, ``anchor``, ``first`` and ``last`` window (positions in ``data``) and ``key``."""

    def __init__(self, col: pa.Array, min_bytes: int):
        self.data, self.offsets = utf8_bytes(col)
        found = [self._chunk(at, min_bytes) for at in range(0, max(0, len(self.data) - min_bytes + 1), CHUNK)]
        self.anchor, self.first, self.last, self.key = (
            np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint64 if k == 3 else np.int64) for k in range(4))
        self.doc = np.searchsorted(self.offsets, self.first, side="right") - 1

    def _chunk(self, at: int, min_bytes: int):
        data = self.data[at: at + CHUNK + min_bytes - 1]
        h = rolling(data, GRAM)
        width = min_bytes - GRAM + 1
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size:])
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # windows inside one document
        edges = np.clip(self.offsets - at, 0, len(anchor))
        change = np.zeros(len(anchor) + 1, np.int32)
        opens, closes = edges[:-1], np.clip(self.offsets[1:] - at - min_bytes + 1, 0, len(anchor))
        some = closes > opens
        np.add.at(change, opens[some], 1)
        np.add.at(change, closes[some], -1)
        inside = np.cumsum(change)[:-1] > 0
        differs = anchor[1:] != anchor[:-1]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= differs | ~inside[:-1]
        ends[:-1] &= differs | ~inside[1:]
        # two documents that touch: a window of the next one begins where the last one's end
        touch = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(anchor))]
        starts[touch] |= inside[touch]
        ends[touch - 1] |= inside[touch - 1]
        first, last = np.flatnonzero(starts), np.flatnonzero(ends)
        # hashes of anchors are least ones: mixed again, they are even over all values
        return anchor[first] + at, first + at, last + at, _mixed(h[anchor[first]] + np.uint64(BASES[1]))


# ---------------------------------------------------------------- front-coded runs
def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, given that the first ``known`` bytes agree."""
    n = min(len(a), len(b))
    if known >= n:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def encode_run(items: list[tuple[bytes, bytes, int, int]], docs: list[tuple[int, int]]) -> bytes:
    """Sorted (suffix, reversed left context, document's place in ``docs``, first window) as one compressed block.

    Equal suffixes with equal contexts are one entry with several occurrences.
    """
    head, tails, docs_of, firsts = [], [], [], []
    last, last_left, n = b"", b"", 0
    for suffix, left, doc, first in items:
        if n and suffix == last and left == last_left:
            head[-1] += 1
        else:
            lcp, left_lcp = common_prefix(last, suffix, 0), common_prefix(last_left, left, 0)
            head += [lcp, len(suffix) - lcp, left_lcp, len(left) - left_lcp, 1]
            tails += [suffix[lcp:], left[left_lcp:]]
            last, last_left, n = suffix, left, n + 1
        docs_of.append(doc)
        firsts.append(first)
    used = sorted(set(docs_of))
    place = {d: k for k, d in enumerate(used)}
    table = np.array([docs[d] for d in used], np.int64)
    firsts = np.diff(np.array(firsts, np.int64), prepend=0)
    parts = [np.array(head, np.int32).tobytes(), table.tobytes(), np.array([place[d] for d in docs_of], np.int32).tobytes(),
             firsts.tobytes(), b"".join(tails)]
    return zlib.compress(struct.pack("<5q", *(len(p) for p in parts)) + b"".join(parts), 1)


class Run:
    """A decoded run: ``suffixes`` with ``lcps`` to the one before, ``lefts``, and occurrences by entry."""

    def __init__(self, block: bytes):
        raw = zlib.decompress(block)
        sizes = struct.unpack_from("<5q", raw)
        at = np.cumsum([40, *sizes])
        part = [raw[at[k]: at[k + 1]] for k in range(5)]
        head = np.frombuffer(part[0], np.int32).reshape(-1, 5)
        self.table = np.frombuffer(part[1], np.int64).reshape(-1, 2)
        self.docs = np.frombuffer(part[2], np.int32)
        self.firsts = np.cumsum(np.frombuffer(part[3], np.int64))
        self.edges = np.concatenate([[0], np.cumsum(head[:, 4])])
        self.lcps = head[:, 0].tolist()
        self.suffixes, self.lefts = [], []
        tails, x, suffix, left = part[4], 0, b"", b""
        for lcp, size, left_lcp, left_size, _ in head.tolist():
            suffix = suffix[:lcp] + tails[x: x + size]
            left = left[:left_lcp] + tails[x + size: x + size + left_size]
            x += size + left_size
            self.suffixes.append(suffix)
            self.lefts.append(left)


def merge_runs(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, entry, common prefix with the entry put out before) in order, by a loser tree.

    ``known[r]`` is the common prefix of run r's next suffix with the last one put
    out.  Of two players the one with the longer known prefix is smaller; only
    if they are equal are bytes compared, from there on, and the loser then knows
    its common prefix with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    head = [0] * len(runs)
    known = [0] * k
    text: list[bytes | None] = [r.suffixes[0] if r.suffixes else None for r in runs] + [None] * (k - len(runs))

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = text[a], text[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        lcp = common_prefix(x, y, known[a])
        if x[lcp: lcp + 1] <= y[lcp: lcp + 1]:  # an end sorts before any byte; equal ones in order of the runs
            known[b] = lcp
            return a, b
        known[a] = lcp
        return b, a

    loser = [0] * k
    level = list(range(k))
    node = k
    while len(level) > 1:
        node //= 2
        winners = []
        for j in range(0, len(level), 2):
            win, lose = play(level[j], level[j + 1])
            loser[node + j // 2] = lose
            winners.append(win)
        level = winners
    winner = level[0]
    while text[winner] is not None:
        run, entry = winner, head[winner]
        yield run, entry, known[run]
        head[run] = entry = entry + 1
        if entry < len(runs[run].suffixes):
            text[run], known[run] = runs[run].suffixes[entry], runs[run].lcps[entry]
        else:
            text[run] = None
        node = (k + run) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2


# ---------------------------------------------------------------- tasks
def _count_keys(min_bytes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            keys = pa.array(Segments(b.column("text"), min_bytes).key.view(np.int64)).value_counts()
            yield pa.RecordBatch.from_arrays([keys.field(0), keys.field(1)], names=["key", "n"])

    return count


def _keys_by_doc(min_bytes: int, hot: np.ndarray):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            s = Segments(b.column("text"), min_bytes)
            cold = ~np.isin(s.key, hot)
            coded = pa.array(s.key[cold].view(np.int64)).dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            pair = pa.array(code * b.num_rows + s.doc[cold]).unique().to_numpy()
            key = coded.dictionary.take(pa.array(pair // max(1, b.num_rows)))
            doc = pa.array(pair % max(1, b.num_rows))
            yield pa.RecordBatch.from_arrays([key, b.column("k1").take(doc), b.column("k2").take(doc)], names=["key", "k1", "k2"])

    return emit


def _hot_windows(min_bytes: int, hot: np.ndarray):
    """Each different window of a document below a hot anchor, with its positions."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            s = Segments(b.column("text"), min_bytes)
            mine = np.flatnonzero(np.isin(s.key, hot))
            if not len(mine):
                continue
            size = s.last[mine] - s.first[mine] + 1
            x = np.repeat(s.first[mine] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            doc = np.repeat(s.doc[mine], size)
            h1, h2 = _window_hashes(s.data, x, min_bytes)
            order = np.lexsort((x, h2, h1, doc))
            x, doc, h1, h2 = x[order], doc[order], h1[order], h2[order]
            new = np.ones(len(x), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            head = np.flatnonzero(new)
            edges = pa.array(np.append(head, len(x)).astype(np.int32))
            rows = pa.array(doc[head])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[head].view(np.int64)), pa.array(h2[head].view(np.int64)), b.column("k1").take(rows), b.column("k2").take(rows),
                 pa.ListArray.from_arrays(edges, pa.array(x - s.offsets[doc]))], names=["h1", "h2", "k1", "k2", "at"])

    return emit


def _window_hashes(data: np.ndarray, x: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((2, len(x)), np.uint64)
    for at in range(0, len(data), CHUNK):
        here = np.flatnonzero((x >= at) & (x < at + CHUNK))
        if len(here):
            part = data[at: at + CHUNK + min_bytes - 1]
            for seed in range(2):
                out[seed, here] = rolling(part, min_bytes, seed)[x[here] - at]
    return out[0], out[1]


def _run_writer(min_bytes: int, ranges: int):
    """Documents with their repeated keys -> sorted, front-coded runs by range."""

    def blocks(items: list, docs: list) -> Iterator[tuple[int, bytes]]:
        items.sort()
        of = [(int.from_bytes(x[0][:8], "big") * ranges) >> 64 for x in items]
        edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(items)] if items else [0]
        for a, z in zip(edges, edges[1:], strict=False):
            yield of[a], encode_run(items[a:z], docs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, docs = [], []
        for b in _and_end(text_slices(batches, "text")):
            if b is not None:
                s = Segments(b.column("text"), min_bytes)
                repeated = b.column("keys").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                mine = np.flatnonzero(np.isin(s.key, repeated))
                data, base = s.data.tobytes(), len(docs)
                docs += zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True)
                begin = s.offsets[s.doc[mine]]
                fingerprint = s.key[mine].astype(">u8").tobytes()
                items += [(fingerprint[8 * k: 8 * k + 8] + data[a: z + min_bytes], data[f:a][::-1], base + d, f - o)
                          for k, (a, f, z, d, o) in enumerate(zip(s.anchor[mine].tolist(), s.first[mine].tolist(), s.last[mine].tolist(),
                                                                  s.doc[mine].tolist(), begin.tolist(), strict=True))]
            if items and (b is None or len(items) >= RUN_SUFFIXES):
                out = list(blocks(items, docs))
                items, docs = [], []
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())],
                                                 names=["range", "run"])

    return emit


def _and_end(slices: Iterator) -> Iterator:
    yield from slices
    yield None


def _range_merger(min_bytes: int):
    """Runs of one range -> (k1, k2, start, stop) of repeated bytes."""

    def merge(table: pa.Table) -> pa.Table:
        runs = [Run(x.as_py()) for x in table["run"]]
        order = list(merge_runs(runs))
        # entries equal in suffix and context become one
        lcps = np.array([x[2] for x in order] + [0], np.int64)
        texts, weights, members, groups, reach, seen = [], [], [], [], [], {}
        group = -1
        for at, (r, e, lcp) in enumerate(order):
            run = runs[r]
            suffix, left = run.suffixes[e], run.lefts[e]
            if lcp < len(suffix) or at == 0 or lcp < len(runs[order[at - 1][0]].suffixes[order[at - 1][1]]):
                seen = {}  # entries with this very suffix, by context
            if lcp < 8 or at == 0:
                group += 1
            if left in seen:
                known = seen[left]
                weights[known] += run.edges[e + 1] - run.edges[e]
                members[known].append((r, e))
                continue
            seen[left] = len(texts)
            texts.append(left[::-1] + suffix[8:])
            weights.append(int(run.edges[e + 1] - run.edges[e]))
            members.append([(r, e)])
            groups.append(group)
            reach.append(max(lcps[at + 1], lcp) - 8 + len(left))  # bytes shared with a neighbour, and the context
        docs, starts, stops = [], [], []

        def found(k: int, a: int, z: int) -> None:
            """Windows a to z (without z) of entry k repeat."""
            for r, e in members[k]:
                run = runs[r]
                span = slice(run.edges[e], run.edges[e + 1])
                docs.append(run.table[run.docs[span]])
                starts.append(run.firsts[span] + a)
                stops.append(run.firsts[span] + z - 1 + min_bytes)

        weight, group = np.array(weights, np.int64), np.array(groups, np.int64)
        whole = weight > 1
        for k in np.flatnonzero(whole).tolist():
            found(k, 0, len(texts[k]) - min_bytes + 1)
        # groups in which some entry does not repeat as a whole, but shares enough with a neighbour
        mixed = np.bincount(group, minlength=group.max(initial=-1) + 1) > 1
        open_ = ~whole & mixed[group] & (np.array(reach) >= min_bytes) if len(weight) else np.zeros(0, bool)
        for part in _parts(np.flatnonzero(np.isin(group, group[open_])), texts, group):
            for k, a, z in _shared_windows([texts[k] for k in part], part, group, open_, min_bytes):
                found(k, a, z)
        table = np.concatenate([*docs, np.zeros((0, 2), np.int64)])
        return pa.table({"k1": table[:, 0], "k2": table[:, 1], "start": np.concatenate([*starts, np.zeros(0, np.int64)]),
                         "stop": np.concatenate([*stops, np.zeros(0, np.int64)])})

    return merge


def _parts(places: np.ndarray, texts: list[bytes], group: np.ndarray) -> Iterator[np.ndarray]:
    """Whole groups together, about PART_BYTES of text at a time."""
    size = np.cumsum([len(texts[k]) for k in places.tolist()])
    ends = np.flatnonzero(np.diff(group[places], append=-1)) + 1
    start = 0
    for end in ends.tolist():
        if end == len(places) or size[end - 1] - (size[start - 1] if start else 0) >= PART_BYTES:
            yield places[start:end]
            start = end


def _shared_windows(texts: list[bytes], places: np.ndarray, group: np.ndarray, open_: np.ndarray, min_bytes: int):
    """(entry, from, to): windows of open entries that another entry of their group has too.

    Entries of one group are different segments, so a window occurs at most once
    in a segment at one distance from the anchor; equal windows are equal hashes.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    count = size - min_bytes + 1
    x = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    of = np.repeat(np.arange(len(texts)), count)
    h1, h2 = _window_hashes(data, x, min_bytes)
    h2 = h2 ^ _mixed(group[places][of].astype(np.uint64) + np.uint64(1))
    code = pa.array(h1).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.uint64)
    both = pa.array(code << np.uint64(32) | h2 >> np.uint64(32)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    twice = (np.bincount(both)[both] > 1) & open_[places][of]
    edge = np.flatnonzero(twice & ~np.concatenate([[False], twice[:-1] & (of[1:] == of[:-1])]))
    stop = np.flatnonzero(twice & ~np.concatenate([twice[1:] & (of[1:] == of[:-1]), [False]]))
    for a, z in zip(edge.tolist(), stop.tolist(), strict=True):
        k = of[a]
        yield int(places[k]), int(x[a] - begin[k]), int(x[z] - begin[k]) + 1


def _remover(as_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            b = b.filter(pc.invert(b.column("partner")))  # here, so that the exchange before it is the same for both readers
            data, off = utf8_bytes(b.column("text"))
            kept, removed, runs = [], [], []
            for k, (starts, stops) in enumerate(zip(b.column("starts").to_pylist(), b.column("stops").to_pylist(), strict=True)):
                raw = data[off[k]: off[k + 1]].tobytes()
                pieces, done, gone, n = [], 0, 0, 0
                for a, z in _union(starts or [], stops or []):
                    pieces.append(raw[done:a])
                    gone, n, done = gone + z - a, n + 1, z
                kept.append(b"".join(pieces) + raw[done:])
                removed.append(gone)
                runs.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())],
                names=["row", "kept", "n_bytes", "n_removed", "n_spans"])

    return remove


def _union(starts: list[int], stops: list[int]) -> Iterator[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    open_at = end = None
    for a, z in sorted(zip(starts, stops, strict=True)):
        if open_at is None or a > end:
            if open_at is not None:
                yield open_at, end
            open_at, end = a, z
        else:
            end = max(end, z)
    if open_at is not None:
        yield open_at, end


# ---------------------------------------------------------------- plan
def _spans_of_hot(src: DataFrame, hot: np.ndarray, min_bytes: int) -> DataFrame:
    """(k1, k2, start, stop) of repeated windows below hot anchors."""
    windows = written(src.mapInArrow(_hot_windows(min_bytes, hot), "h1 long, h2 long, k1 long, k2 long, at array<long>"), "hot-windows")
    counted = windows.groupBy("h1", "h2").agg(F.sum(F.size("at")).alias("n"), F.count(F.lit(1)).alias("docs"))
    twice = written(counted.where("n > 1").withColumn("again", F.lit(True)), "repeated")
    crowded = twice.where(F.col("docs") >= windows.count() / 1000.0)  # at most 1,000 windows
    met = hot_aware_join(windows, twice.select("h1", "h2", "again"), ["h1", "h2"], crowded, ["k1", "k2"]).where("again")
    return met.select("k1", "k2", F.col("at").alias("starts"), F.transform("at", lambda x: x + min_bytes).alias("stops"))


def suffix_dedup(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text",
                 keep: list[str] | None = None, as_text: bool = False, hot_least: float = 100.0, hot_share: float = 0.25) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``kept`` (binary: the remaining bytes), ``n_bytes``, ``n_removed`` and ``n_spans``.
    With ``as_text``, ``kept`` is a string: characters of which a part was removed go as a whole.

    A document is known by its id and the 64-bit hash of its text.  An anchor is hot with ``hot_share`` of a
    partition's even part of all occurrences, and ``hot_least`` of them.
    """
    if min_bytes < 2 * GRAM:
        raise ValueError(f"min_bytes must be at least {2 * GRAM}")
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    own = ["kept", "n_bytes", "n_removed", "n_spans"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*own, text_col)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k1, k2 = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62))), F.xxhash64(text)
    src = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct(*[F.col(c) for c in keep]).alias("row"), text.alias("text"))

    # large groups of exact copies: at most 1,000
    src = src.withColumn("whole", F.md5(F.col("text").cast("binary")))
    rows = docs.count()
    groups = src.groupBy("whole").agg(F.count(F.lit(1)).alias("copies"), F.min("k1").alias("stays"))
    groups = written(groups.where((F.col("copies") > 1) & (F.col("copies") >= rows / 1000.0)), "copies")
    src = src.join(F.broadcast(groups), "whole", "left")
    copied = (F.col("copies") > 1) & (F.octet_length("text") >= min_bytes)
    copies = src.where(copied)
    # one copy of each goes on as a partner of others, also where many rows have its id
    kind = src.schema["row"].dataType.simpleString()
    partners = written(copies.where(F.col("k1") == F.col("stays")).groupBy("whole").agg(
        F.min("k1").alias("k1"), F.first("k2").alias("k2"), F.first("text").alias("text")).select("k1", "k2", "text"), "partners")
    # keys that cannot be null: a filter for nulls before one of its two readers would keep the exchange below from being shared
    known = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("k1", "k2")]
    others = src.where(~F.coalesce(copied, F.lit(False))).select("k1", "k2", "row", "text", F.lit(False).alias("partner")).unionByName(
        partners.select(*known, F.lit(None).cast(kind).alias("row"), "text", F.lit(True).alias("partner")))

    # anchors that occur more than once
    plain = others.select("k1", "k2", "text")
    counted = plain.select("text").mapInArrow(_count_keys(min_bytes), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    keys = written(counted.where("n > 1"), "anchors")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    total = keys.agg(F.sum("n")).first()[0] or 0
    crowd = max(hot_least, hot_share * total / partitions)  # at most 1 / hot_share anchors a partition have so many
    hot = keys.where(F.col("n") >= crowd).select("key").toArrow()["key"].to_numpy().view(np.uint64)
    cold = keys.where(F.col("n") < crowd).select("key")
    by_doc = plain.mapInArrow(_keys_by_doc(min_bytes, hot), "key long, k1 long, k2 long").hint("merge").join(cold, "key")
    repeated = written(by_doc.groupBy("k1", "k2").agg(F.collect_list("key").alias("keys")), "candidates")

    # one exchange of the texts serves the sorted runs and the result
    moved = others.repartition("k1", "k2")
    ranges = max(RANGES * partitions, -(-total // RANGE_SUFFIXES))
    runs = moved.join(repeated, ["k1", "k2"]).mapInArrow(_run_writer(min_bytes, ranges), "range int, run binary")
    spans = runs.groupBy("range").applyInArrow(_range_merger(min_bytes), "k1 long, k2 long, start long, stop long")
    spans = spans.groupBy("k1", "k2").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    if len(hot):
        both = spans.unionByName(_spans_of_hot(plain, hot, min_bytes))
        spans = both.groupBy("k1", "k2").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("stops")).alias("stops"))
    left = moved.join(spans, ["k1", "k2"], "left").mapInArrow(
        _remover(as_text), f"row {kind}, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long")
    size = F.octet_length("text").cast("long")
    away = copies.select("row", F.lit("" if as_text else b"").alias("kept"), size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"))
    return left.unionByName(away).select("row.*", *own)


def op10_suffix_dedup(spark, sf_dir):
    found = suffix_dedup(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
