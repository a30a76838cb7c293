"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm import words as W
from loomline.llm.labelled import SAMPLE_ROWS, bounded_sample, remainder, training_labels
from loomline.llm.spark_io import slices

BUCKETS = 2048
FACTORS = 8
BINS = 8
MODULUS, HELD_OUT = 3, 1
STATISTICS = (
    "log_bytes", "log_words", "word_length", "letters", "upper", "digits", "white", "sentence_marks", "symbols", "bars", "shouts", "non_ascii",
    "log_lines", "line_length", "repeated_lines", "distinct_words", "repeated_triples", "top_word", "metadata_chars", "metadata_gap",
)


def _by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _class(*spans: tuple[int, int] | str) -> np.ndarray:
    out = np.zeros(256, bool)
    for s in spans:
        for c in s.encode() if isinstance(s, str) else range(s[0], s[1] + 1):
            out[c] = True
    return out


_CLASSES = {
    "letters": _class((65, 90), (97, 122), (128, 255)), "upper": _class((65, 90)), "digits": _class((48, 57)), "white": _class(" \t\n\r\x0b\x0c"),
    "sentence_marks": _class(".,;:?'\""), "symbols": _class("#$%&*+/<=>@[\\]^_`{}~"), "bars": _class("|"), "shouts": _class("!"), "non_ascii": _class((128, 255)), "log_lines": _class("\n"),
}


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: how many distinct keys it has, and how often its most frequent one occurs."""
    held = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (keys >> np.uint64(24)))  # 40 bits tell the keys of one text apart
    new = np.ones(len(held), bool)
    new[1:] = held[1:] != held[:-1]
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(held)))
    rows = (held[at] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    if len(rows):
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        most[rows[first]] = np.maximum.reduceat(runs, first)
    return np.bincount(rows, minlength=n).astype(float), most


def features(texts: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Statistics (texts x len(STATISTICS)) and hashed words (texts x BUCKETS, rows of length 1 or 0) of some texts."""
    n = len(texts)
    w = W.words(texts)
    data, offsets = W.raw(texts)
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    per = {k: _by_text(c[data], offsets) for k, c in _CLASSES.items()}
    count = np.diff(w.first).astype(float)
    rows = w.rows()
    lines = per["log_lines"] + 1
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets, breaks + 1]))
    edges = edges[edges <= len(data)]
    up, down = W._power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    starts, stops = edges[:-1], edges[1:]
    long = stops - starts > 4
    starts, stops = starts[long], stops[long]
    line_rows = np.searchsorted(offsets, starts, side="right") - 1
    line_keys = (total[stops] - total[starts]) * down[starts]
    distinct_lines, _ = _distinct(line_rows, line_keys, n)
    line_count = np.bincount(line_rows, minlength=n).astype(float)
    distinct, top = _distinct(rows, w.hashes, n)
    triples = W.shingles(w.hashes, 3)
    whole = rows[: len(triples)] == rows[2:] if len(triples) else np.zeros(0, bool)
    distinct_triples, _ = _distinct(rows[: len(triples)][whole], triples[whole], n)
    triple_count = np.bincount(rows[: len(triples)][whole], minlength=n).astype(float)
    chars = size - _by_text((data & 0xC0) == 0x80, offsets)
    given = np.asarray(n_chars.cast(pa.float64()).fill_null(-1.0).to_numpy(zero_copy_only=False))
    given = np.where(given < 0, chars, given)
    word_bytes = np.bincount(rows, weights=(w.ends - w.starts).astype(float), minlength=n)
    columns = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(count), "word_length": word_bytes / np.maximum(count, 1), "log_lines": np.log1p(lines), "line_length": np.log1p(size / lines),
        "repeated_lines": 1 - distinct_lines / np.maximum(line_count, 1), "distinct_words": distinct / np.maximum(count, 1), "repeated_triples": 1 - distinct_triples / np.maximum(triple_count, 1),
        "top_word": top / np.maximum(count, 1), "metadata_chars": np.log1p(given), "metadata_gap": np.abs(given - chars) / np.maximum(np.maximum(given, chars), 1),
    }
    columns["repeated_lines"][line_count == 0] = 0
    columns["repeated_triples"][triple_count == 0] = 0
    columns |= {k: v / some for k, v in per.items() if k != "log_lines"}
    bucket = (w.hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    held = np.bincount(rows * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    held /= np.maximum(np.sqrt((held * held).sum(axis=1, keepdims=True)), 1)
    return np.stack([columns[k] for k in STATISTICS], axis=1).astype(np.float32), held


class FactorisationMachine:
    """Bias, weights and low-rank pair weights, scored in linear time: the pair sum is half the square of the sum less the sum of the squares."""

    def __init__(self, width: int, factors: int = FACTORS, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.bias = np.zeros(1, np.float32)
        self.weights = np.zeros(width, np.float32)
        self.factors = rng.normal(0, 0.02, (width, factors)).astype(np.float32)

    def logit(self, x: np.ndarray) -> np.ndarray:
        summed = x @ self.factors
        return self.bias[0] + x @ self.weights + 0.5 * ((summed**2).sum(axis=1) - (x**2) @ (self.factors**2).sum(axis=1))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 15, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 0) -> None:
        """Minimises the weighted log loss by Adam; the same rows in the same order give the same model."""
        rng = np.random.default_rng(seed)
        parts = [self.bias, self.weights, self.factors]
        first, second, steps = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        for epoch in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                b = x[rows]
                error = (1 / (1 + np.exp(-np.clip(self.logit(b), -30, 30))) - y[rows]) * weight[rows] / weight[rows].sum()
                error = error.astype(np.float32)
                pull = b.T @ (error[:, None] * (b @ self.factors)) - self.factors * ((b**2).T @ error)[:, None]
                steps += 1
                for p, g, m, v in zip(parts, (error.sum(keepdims=True), b.T @ error + decay * self.weights, pull + decay * self.factors), first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate / (1 + epoch / 8) * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)


class QualityModel:
    """Standardised and binned statistics and hashed words, and the machine over them."""

    def __init__(self, statistics: np.ndarray, words: np.ndarray, labels: np.ndarray, weight: np.ndarray):
        self.mean, self.scale = statistics.mean(axis=0), statistics.std(axis=0) + 1e-3
        self.cuts = np.quantile(statistics, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.astype(np.float32)
        x = self.inputs(statistics, words)
        self.machine = FactorisationMachine(x.shape[1])
        self.machine.fit(x, labels.astype(np.float32), weight.astype(np.float32))

    def inputs(self, statistics: np.ndarray, words: np.ndarray) -> np.ndarray:
        even = np.clip((statistics - self.mean) / self.scale, -4, 4) / 4
        bins = np.zeros((len(statistics), statistics.shape[1], BINS), np.float32)
        at = np.stack([np.searchsorted(c, statistics[:, k], side="left") for k, c in enumerate(self.cuts)], axis=1)
        np.put_along_axis(bins, at[:, :, None], 0.5, axis=2)
        return np.concatenate([even, bins.reshape(len(statistics), -1), words], axis=1).astype(np.float32)

    def score(self, statistics: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.machine.logit(self.inputs(statistics, words)).astype(float), -30, 30)))


def _chars(docs: DataFrame, chars_col: str | None):
    return F.col(chars_col).cast("long") if chars_col and chars_col in docs.columns else F.lit(None).cast("long")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chars_col: str | None = "n_chars", sample_rows: int = SAMPLE_ROWS) -> QualityModel | None:
    """A model from a sample of ``sample_rows`` labelled rows at most that are not held out; None if a class has no row.

    Class weights restore the shares that the classes have among all labelled rows. The driver holds the sample's
    features, about 9 kB a row. Of rows whose id repeats the least label and the least features count; labels that are
    null or have no document teach nothing, null and empty texts teach what an empty text has.
    """
    train = training_labels(labels, label_col, lambda i: remainder(i, MODULUS) != HELD_OUT, id_col)
    sample, stands_for = bounded_sample(train, sample_rows, id_col)
    schema = T.StructType([docs.schema[id_col], T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            x = np.concatenate(features(b.column("_text"), b.column("_chars")), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], [f.name for f in schema.fields])

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("_text"), _chars(docs, chars_col).alias("_chars")).join(F.broadcast(sample), id_col)
    held = rows.select(id_col, "label", "_text", "_chars").mapInArrow(run, schema).groupBy(id_col).agg(F.min("label").alias("label"), F.min("x").alias("x")).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).collect()
    y = np.array([r["label"] for r in held])
    if len(set(y.tolist())) < 2:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in held])
    n = len(STATISTICS)
    return QualityModel(x[:, :n], x[:, n:], y, np.where(y == 1, stands_for[1], stands_for[0]))


def score(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """Rows (id_col, held_out, score, predicted), one per row of ``docs``, in one pass without a shuffle.

    A null text is empty and gets the score of its (empty) features; a null id is not held out; without a model
    every score is 0.5. Other columns than text and ``chars_col`` are never looked at.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("_score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for b in slices(batches, "_in_text"):
            found = held.score(*features(b.column("_in_text"), b.column("_in_chars"))) if held else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(found)], [id_col, "_score"])

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("_in_text"), _chars(docs, chars_col).alias("_in_chars")).mapInArrow(run, schema)
    held_out = F.coalesce(remainder(F.col(id_col), MODULUS) == HELD_OUT, F.lit(False))
    return rows.select(id_col, held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chars_col: str | None = "n_chars", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fits on the labelled rows that are not held out and scores every document: id_col, held_out, score, predicted."""
    return score(docs, fit(docs, labels, id_col, text_col, label_col, chars_col, sample_rows), id_col, text_col, chars_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chars_col: str | None = "n_chars", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the model gives 0.5 or more, with all their columns; all rows if there are no labels to learn from.

    Each row is judged by itself: repeated rows stay or go together, null and empty texts are judged as an empty text
    is, null ids are judged like others. Columns of any name pass through. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, chars_col, sample_rows))
    counted = chars_col in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for b in slices(batches, text_col):
            chars = b.column(chars_col) if counted else pa.nulls(b.num_rows, pa.int64())
            yield b.filter(pa.array(held.score(*features(b.column(text_col), chars)) >= 0.5)) if held else b

    return docs.mapInArrow(run, docs.schema)
