"""Toxicity by compression distance: two zstandard dictionaries, and how much better the toxic one shortens a text's windows."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.labelled import bounded_sample, remainder, training_labels
from loomline.llm.spark_io import slices, stored

MODULUS, HELD_OUT = 5, 0
#: Labelled rows to fit on, half toxic at most; two of three give the dictionaries, the third calibrates.
SAMPLE_ROWS = 6000
#: Words of a window that is scored, from one start to the next; words of a window that a dictionary is trained on.
WINDOW, STEP, TRAINING_WINDOW = 4, 2, 3
#: Windows that each dictionary is trained on at most, those with the least hashes.
TRAINING_WINDOWS = 100_000
#: Bytes of the dictionaries, and the trainer's segment and match length: about a word with what is around it.
TOXIC_BYTES, ORDINARY_BYTES, SEGMENT, MATCH = 1024, 16384, 12, 8
#: A toxic document is toxic in few of its windows. The toxic dictionary is trained on those with a word, or a word's beginning of so many
#: letters (rare inflected forms share one), that is in more different windows of toxic documents than chance lets any of all be, in so many
#: windows at least, and in a share of them so many times that of the windows of ordinary documents. Without the last, frequent words lead
#: there as soon as one language has more toxic text than another.
BEGINNINGS, LEAST_WINDOWS, LEAST_RATIO = (4, 8), 3, 3
#: Saved bytes at which a window counts for one of the thresholds that the calibration weighs.
THRESHOLDS = tuple(range(1, 11))
#: Stands before each window and at the end of both dictionaries, so that no window is too short to be worth compressing;
#: and after each window, since no match begins in the last bytes of a block. Both cost the same with either dictionary.
CARRIER, TRAILER = bytes(range(1, 32)), bytes(range(2, 14))
#: How a trained dictionary begins, and how it ends its tables; its content follows.
_MAGIC = (0xEC30A437).to_bytes(4, "little")
_TABLES_END = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))
_WORD = re.compile(r"[^\W_]+")
_WORDS_AT_ONCE = 1 << 15
#: Saved bytes are held to these; more or less says nothing more.
_LOW, _HIGH = -16, 48


def windows(text: str, size: int = WINDOW, step: int = STEP) -> Iterator[list[str]]:
    """Windows of ``size`` words in lower case, from every ``step``-th word on, some thousands at a time; the last may be shorter."""
    held: list[str] = []
    least = 1  # windows of the last part: none if the words left over are in a window already
    found = _WORD.finditer(text.lower())
    while True:
        fresh = [m[0] for _, m in zip(range(_WORDS_AT_ONCE), found)]
        held += fresh
        last = len(fresh) < _WORDS_AT_ONCE
        starts = range(0, max(least, len(held) - size + step) if last else len(held) - size + 1, step)
        yield [" ".join(held[i : i + size]) for i in starts if held]
        if last:
            return
        held, least = held[len(starts) * step :], 0


class Distance:
    """Bytes that the toxic dictionary saves over the ordinary one, by window."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.dictionaries = toxic, ordinary
        self._start()

    def _start(self) -> None:
        import zstandard

        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=6, hash_log=15, chain_log=16, window_log=17, target_length=64, **plain)
        self.toxic, self.ordinary = (self._compressor(zstandard, d, how) for d in self.dictionaries)

    @staticmethod
    def _compressor(zstandard, dictionary: bytes, how):
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=data, compression_params=how)

    def __getstate__(self):
        return self.dictionaries

    def __setstate__(self, state):
        self.dictionaries = state
        self._start()

    def saved(self, found: list[str]) -> np.ndarray:
        """Length of each window compressed with the ordinary dictionary less that with the toxic one."""
        blocks = [CARRIER + f" {w} ".encode("utf-8", "surrogatepass") + TRAILER for w in found]
        return self._lengths(self.ordinary, blocks) - self._lengths(self.toxic, blocks)

    @staticmethod
    def _lengths(compressor, blocks: list[bytes]) -> np.ndarray:
        if not blocks:
            return np.zeros(0, np.int64)
        out = compressor.multi_compress_to_buffer(blocks, threads=1)
        return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))

    def statistics(self, text: str) -> list[float]:
        """What the calibration weighs: how many windows pass each threshold, in number and in share, the best windows, the mean and the length."""
        counts = np.zeros(_HIGH - _LOW + 1, np.int64)
        for part in windows(text):
            counts += np.bincount(np.clip(self.saved(part), _LOW, _HIGH) - _LOW, minlength=len(counts))
        n = max(1, int(counts.sum()))
        values = np.arange(_LOW, _HIGH + 1)
        above = np.cumsum(counts[::-1])[::-1]
        passed = np.array([above[t - _LOW] for t in THRESHOLDS])
        top = np.repeat(values[::-1], np.minimum(counts[::-1], 3))[:3] if counts.any() else np.zeros(1)
        return [*np.log1p(passed), *np.log1p(1000 * passed / n), float(top.max()), float(top.mean()), float((values * counts).sum() / n), float(np.log1p(n))]


def _trained(samples: list[bytes], size: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=MATCH).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples to train on: they are the dictionary
        return b" " + b" ".join(samples)[-size:]


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Distance:
    """A dictionary trained on windows of toxic text and one trained on windows of ordinary text.

    The content of the ordinary one also stands before that of the toxic one, with the same tables in front, so that
    what is common to all text is shortened alike and only toxic content makes a difference.
    """
    common, own = _trained(ordinary, ORDINARY_BYTES), _trained(toxic, TOXIC_BYTES)
    at = own.find(_TABLES_END)
    if at < 0 and own.startswith(_MAGIC):
        raise RuntimeError("the trainer ends its tables in another way: the content of the dictionary can't be told apart")
    return Distance(common + (own[at + len(_TABLES_END) :] if at >= 0 else own) + CARRIER, common + CARRIER)


class Calibration:
    """Logistic weights over the statistics, found by damped Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = self._inputs(x)
        self.beta = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-3
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            slope = z.T @ (weight * (p - y)) + penalty * self.beta
            bend = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
            self.beta -= np.clip(np.linalg.solve(bend, slope), -2, 2)

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -5, 5)], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._inputs(x) @ self.beta, -30, 30)))


def _sampled(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (key, label, part 0 to 2) of the sampled documents, one per id: with the text in part 0, with its windows in the others.

    Of rows that repeat an id the text with the least hash counts.
    """
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("windows", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            parts, texts = b.column("part").to_pylist(), b.column("text").to_pylist()
            kept = [None if part else text for part, text in zip(parts, texts)]
            shown = [[w for some in windows(text, TRAINING_WINDOW, TRAINING_WINDOW) for w in some] if part else None for part, text in zip(parts, texts)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "label", "part")), pa.array(kept, pa.string()), pa.array(shown, pa.list_(pa.string()))], [f.name for f in schema.fields])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(id_col, text.alias("_text")).join(F.broadcast(sample), id_col).groupBy(id_col).agg(F.min("label").alias("label"), F.min_by("_text", F.xxhash64("_text")).alias("text"))
    key = F.xxhash64(F.col(id_col).cast("string"))
    return stored(rows.select(key.alias("key"), "label", F.pmod(key, F.lit(3)).cast("int").alias("part"), "text").mapInArrow(run, schema), "sampled")


def _with_beginnings(word: Column) -> Column:
    """A word, ended by a blank, and its beginnings."""
    lengths = F.filter(F.sequence(*map(F.lit, BEGINNINGS)), lambda n: n <= F.length(word))
    return F.concat(F.array(F.concat(word, F.lit(" "))), F.transform(lengths, lambda n: F.substring(word, F.lit(1), n)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple[Distance, Calibration] | None:
    """Dictionaries and calibration from ``sample_rows`` labelled rows at most that are not held out; None if a class has no row.

    Windows that copies share count once. The contrast of a word or beginning is by how many standard deviations more
    of the different windows of toxic documents hold it than their share of all windows would have. Of n without any
    contrast, the greatest is about sqrt(2 ln n), and those above that lead to the windows for the toxic dictionary.
    They are counted in Spark; the driver holds the training windows and the statistics of the calibrating third, both
    of bounded number.
    """
    train = training_labels(labels, label_col, lambda i: remainder(i, MODULUS) != HELD_OUT, id_col)
    sample, stands_for = bounded_sample(train, sample_rows, id_col)
    held = _sampled(docs, sample, id_col, text_col)
    shown = held.where("part > 0").select("label", F.explode("windows").alias("window")).distinct()
    totals = {r["label"]: r["n"] for r in shown.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None
    share = totals[1] / (totals[0] + totals[1])
    each = shown.select("label", "window", F.explode(F.array_distinct(F.flatten(F.transform(F.split("window", " "), _with_beginnings)))).alias("word"))
    counts = each.groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("all"))
    least = math.sqrt(2 * math.log(max(2, counts.count())))
    expected = F.col("all") * share
    contrast = (F.col("toxic") - expected) / F.sqrt(expected * (1 - share) + 0.5)
    often = F.col("toxic") * totals[0] >= LEAST_RATIO * (F.col("all") - F.col("toxic")) * totals[1]
    telling = counts.where((contrast >= least) & often & (F.col("toxic") >= LEAST_WINDOWS)).select("word")

    def chosen(rows: DataFrame) -> list[bytes]:
        return [r["window"].encode("utf-8", "surrogatepass") for r in rows.orderBy(F.xxhash64("window"), "window").limit(TRAINING_WINDOWS).collect()]

    hot = each.where("label = 1").join(telling, "word", "left_semi").select("window").distinct()
    distance = train_dictionaries(chosen(hot), chosen(shown.where("label = 0").select("window")))
    x, y = _calibrating(held.where("part = 0"), distance)
    if len(set(y.tolist())) < 2:
        return None
    return distance, Calibration(x, y, np.where(y == 1, stands_for[1], stands_for[0]) / max(stands_for.values()))


def _calibrating(rows: DataFrame, distance: Distance) -> tuple[np.ndarray, np.ndarray]:
    schema = "key long, label int, x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = [distance.statistics(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label"), pa.array(x, pa.list_(pa.float64()))], ["key", "label", "x"])

    found = rows.select("key", "label", "text").mapInArrow(run, schema).orderBy("key").collect()
    return np.array([r["x"] for r in found], float).reshape(len(found), -1), np.array([r["label"] for r in found], float)


def score(docs: DataFrame, model: tuple[Distance, Calibration] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, held_out, score, predicted), one per row of ``docs``, in one pass without a shuffle.

    A null text is empty and gets the score of a text without windows; a null id is not held out; without a model
    every score is 0. Other columns are never looked at; repeated rows are scored each.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("_score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for b in slices(batches, "_in_text"):
            if held:
                distance, calibration = held
                found = calibration(np.array([distance.statistics(t or "") for t in b.column("_in_text").to_pylist()]))
            else:
                found = np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(found)], [id_col, "_score"])

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("_in_text")).mapInArrow(run, schema)
    held_out = F.coalesce(remainder(F.col(id_col), MODULUS) == HELD_OUT, F.lit(False))
    return rows.select(id_col, held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fits on the labelled rows that are not held out and scores every document: id_col, held_out, score, predicted."""
    return score(docs, fit(docs, labels, id_col, text_col, label_col, sample_rows), id_col, text_col)
