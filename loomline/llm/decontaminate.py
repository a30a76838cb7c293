"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact weighted-shingle similarity."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm import words as W
from loomline.llm.spark_io import slices

SHINGLE = 5
SIMILARITY = 0.8
#: A window has ``PRINTS`` independent fingerprints of 64 bits; it is a candidate if one of them lies within the radius of an item's.
#: A window of the item's size at the least similarity shares 8/9 of the item's shingles, so about 9.7 bits of 64 differ, with a
#: standard deviation of 2.9: one fingerprint finds 73 % of such windows, five find 99.9 %.
PRINTS, BITS, RADIUS = 5, 64, 11
#: Each fingerprint is cut into ``BLOCKS`` blocks. Within the radius one block at least differs in RADIUS // BLOCKS bits or fewer:
#: a random fingerprint passes with a chance of 0.8 %, one of five with 4 %.
BLOCKS, BLOCK_BITS = 4, 16
#: Benchmarks beyond so many bytes are searched for in several passes; the index holds about five bytes for one of text, and 6 MB.
PASS_BYTES = 16 << 20
_TABLE_BITS = 20
_ROUND = 0x9E3779B97F4A7C15


def simhash(hashes: np.ndarray, size: int, prints: int = PRINTS) -> np.ndarray:
    """The fingerprints (windows x prints, uint64) of every run of ``size`` shingles, each counted as often as it occurs; a tied bit is 0."""
    out = []
    for k in range(prints):
        own = W.mixed(hashes + np.uint64(k * _ROUND % (1 << 64))) if k else hashes
        bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
        total = np.zeros((len(own) + 1, BITS), np.int32)
        np.cumsum(bits, axis=0, out=total[1:])
        out.append(np.packbits((total[size:] - total[:-size]) * 2 > size, axis=1, bitorder="little").view("<u8")[:, 0])
    return np.stack(out, axis=1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the lesser counts over the sum of the greater counts, of two multisets of shingles."""
    kinds, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(kinds)), np.bincount(at[len(a) :], minlength=len(kinds))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Index:
    """Benchmark items: the block tables of their fingerprints, and the shingles that lead to their sizes.

    Items of the same words are one entry. A block table lists entries by the value of one block of one fingerprint.
    """

    def __init__(self, texts: list[str], radius: int = RADIUS, threshold: float = SIMILARITY):
        self.radius, self.threshold = radius, threshold
        w = W.words(pa.array(texts, pa.string()))
        entry_of: dict[bytes, int] = {}
        self.items: list[list[int]] = []
        held: list[np.ndarray] = []
        for i in range(len(texts)):
            own = w.hashes[w.first[i] : w.first[i + 1]]
            if len(own) < SHINGLE:
                continue
            entry = entry_of.setdefault(own.tobytes(), len(held))
            if entry == len(held):
                held.append(W.shingles(own, SHINGLE))
                self.items.append([])
            self.items[entry].append(i)
        self.counts = np.array([len(s) for s in held], np.int64)  # shingles; words less four
        self.first = np.append(0, np.cumsum(self.counts))
        self.shingles = np.concatenate(held) if held else np.zeros(0, np.uint64)
        self.prints = np.concatenate([simhash(s, len(s)) for s in held]) if held else np.zeros((0, PRINTS), np.uint64)
        values = self.prints.view("<u2").reshape(-1, PRINTS * BLOCKS)
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32)
        self.starts = np.stack([np.searchsorted(np.sort(values[:, t]), np.arange((1 << BLOCK_BITS) + 1)) for t in range(PRINTS * BLOCKS)]).astype(np.int32)
        self.masks = np.flatnonzero(np.bitwise_count(np.arange(1 << BLOCK_BITS, dtype=np.uint32)) <= radius // BLOCKS)
        pairs = np.unique(np.stack([self.shingles, np.repeat(self.counts, self.counts).astype(np.uint64)], axis=1), axis=0)
        self.keys, self.key_counts = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.keys >> np.uint64(64 - _TABLE_BITS)] = True

    def near(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``prints``, entry) of fingerprints within the radius, by looking up every block value that differs in few enough bits.

        All pairs within the radius are found: if no block differed in RADIUS // BLOCKS bits or fewer, more than the radius would differ.
        """
        blocks = prints.view("<u2").reshape(-1, PRINTS * BLOCKS)
        for t in range(PRINTS * BLOCKS):
            value = blocks[:, t, None].astype(np.int64) ^ self.masks[None, :]
            a, b = self.starts[t][value], self.starts[t][value + 1]
            row, mask = np.nonzero(b > a)
            first, n = a[row, mask].astype(np.int64), (b - a)[row, mask]
            step = max(1, (1 << 22) // max(1, int(n.max(initial=1))))
            for s in range(0, len(row), step):
                m = n[s : s + step]
                at = np.repeat(first[s : s + step] - np.append(0, np.cumsum(m)[:-1]), m) + np.arange(m.sum())
                rows, entries = np.repeat(row[s : s + step], m), self.order[t][at]
                close = np.bitwise_count(prints[rows, t // BLOCKS] ^ self.prints[entries, t // BLOCKS]) <= self.radius
                if close.any():
                    yield rows[close], entries[close]

    def matches(self, column: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity) of each text and item that a window of the text is similar to: the best window, the first of equals.

        Of a window of s shingles at a similarity t, 2 t s / (1 + t) are shingles of the item at least. So windows with
        fewer places that hold a shingle of an item of their size get no fingerprint: nothing is lost, and a line that
        items of many sizes share opens none.
        """
        if not len(self.keys):
            return []
        w = W.words(column)
        every = W.shingles(w.hashes, SHINGLE)
        maybe = np.flatnonzero(self.table[every >> np.uint64(64 - _TABLE_BITS)])
        lo, hi = np.searchsorted(self.keys, every[maybe], side="left"), np.searchsorted(self.keys, every[maybe], side="right")
        text = np.searchsorted(w.first, maybe, side="right") - 1
        real = (hi > lo) & (maybe + SHINGLE <= w.first[text + 1])
        maybe, lo, n, text = maybe[real], lo[real], (hi - lo)[real], text[real]
        place = np.repeat(maybe, n)
        count = self.key_counts[np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())] if len(n) else np.zeros(0, np.int64)
        text = np.repeat(text, n)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        order = np.lexsort((place, count, text))
        place, count, text = place[order], count[order], text[order]
        edges = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(count, prepend=-1) != 0))
        for start, end in zip(edges.tolist(), [*edges[1:].tolist(), len(place)]):
            t, size = int(text[start]), int(count[start])
            first, last = int(w.first[t]), int(w.first[t + 1]) - size - SHINGLE + 1  # the last start of a window
            if last < first:
                continue
            needed = max(1, math.ceil(2 * self.threshold * size / (1 + self.threshold) - 1e-9))
            if end - start < needed:
                continue
            a, b = np.maximum(place[start + needed - 1 : end] - size + 1, first), np.minimum(place[start : end - needed + 1], last)
            a, b = a[a <= b], b[a <= b]
            if len(a):
                self._search(every, a, b, size, first, t, best)
        return [(t, i, start, int(self.counts[entry]) + SHINGLE - 1, -found) for (t, entry), (found, start) in sorted(best.items()) for i in self.items[entry]]

    def _search(self, every: np.ndarray, a: np.ndarray, b: np.ndarray, size: int, first: int, text: int, best: dict) -> None:
        """Windows of ``size`` shingles that start from each of ``a`` up to ``b``, both in order."""
        fresh = np.flatnonzero(np.append(True, a[1:] > np.maximum.accumulate(b)[:-1] + 1))
        for lo, hi in zip(a[fresh].tolist(), np.maximum.reduceat(b, fresh).tolist()):
            for at in range(lo, hi + 1, 1 << 11):
                part = every[at : min(hi + 1, at + (1 << 11)) + size - 1]
                seen = set()
                for rows, entries in self.near(simhash(part, size)):
                    seen |= {(e, r) for e, r in zip(entries.tolist(), rows.tolist()) if self.counts[e] == size}
                for entry, row in sorted(seen):
                    found = (-similarity(part[row : row + size], self.shingles[self.first[entry] : self.first[entry + 1]]), at + row - first)
                    if -found[0] >= self.threshold and found < best.get((text, entry), (0, 0)):
                        best[text, entry] = found


def _passes(benchmark: DataFrame, item_col: str, text_col: str, pass_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the benchmark in parts of about ``pass_bytes``, so that what is sent to every task is bounded."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    parts = 1 + int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // pass_bytes)
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect()
        rows.sort(key=lambda r: (str(r["item"]), r["text"]))
        yield [r["item"] for r in rows], [r["text"] for r in rows]


def _mapped(docs: DataFrame, index: Index, text_col: str, schema: T.StructType, use: Callable) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            yield use(b, shared.value.matches(b.column(text_col)))

    return docs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", radius: int = RADIUS, threshold: float = SIMILARITY, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Rows (id_col, item_id, start_word, n_words, similarity), one per document and benchmark item that a passage of it is similar to.

    Words are runs of letters and digits in lower case. A passage is a window of as many words as the item; its
    similarity is that of the multisets of five-word shingles. The best window counts, the first of equals. Items of
    fewer than five words and null texts match nothing. Repeated documents give repeated rows, repeated items one,
    null ids are kept, an empty table gives no rows, other columns are ignored. One pass over the texts, no shuffle.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_col].dataType), T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType())])
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = None
    for ids, texts in _passes(benchmark, item_col, item_text, pass_bytes):

        def use(b: pa.RecordBatch, found: list, ids: list = ids) -> pa.RecordBatch:
            kind = pa.array(ids).type if ids else pa.null()
            columns = [b.column("_id").take(pa.array([f[0] for f in found], pa.int64())), pa.array([ids[f[1]] for f in found], kind), *(pa.array([f[k] for f in found], pa.int64()) for k in (2, 3)), pa.array([f[4] for f in found], pa.float64())]
            return pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

        part = _mapped(rows, Index(texts, radius, threshold), "_text", schema, use)
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", radius: int = RADIUS, threshold: float = SIMILARITY, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs`` with no passage similar to a benchmark item, with all their columns.

    Each row is judged by itself: repeated rows stay or go together; null, empty and very short texts stay, as does
    everything if the benchmark is empty or has no item of five words. Columns of any name pass through. An empty table
    gives no rows.
    """
    for _, texts in _passes(benchmark, item_col, item_text, pass_bytes):

        def use(b: pa.RecordBatch, found: list) -> pa.RecordBatch:
            clean = np.ones(b.num_rows, bool)
            clean[[f[0] for f in found]] = False
            return b.filter(pa.array(clean))

        docs = _mapped(docs, Index(texts, radius, threshold), text_col, docs.schema, use)
    return docs
