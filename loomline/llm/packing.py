"""Packing tokenized documents into windows of a fixed size by best-fit decreasing."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.spark_io import slices, stored

WINDOW = 2048
END_ID = 1
#: Each task numbers its sequences from its own multiple of this: full windows by even numbers, packed rests by odd ones.
SEQUENCES_PER_TASK = 1 << 40
#: Rests that one packing task takes on average.
RESTS_PER_TASK = 1 << 17


class CapacityTree:
    """A segment tree over the capacities 0 to ``window``: leaf c counts the open windows with c tokens left."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.counts = [0] * (2 * self.size)

    def add(self, capacity: int, n: int = 1) -> None:
        at = capacity + self.size
        while at:
            self.counts[at] += n
            at >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of ``need`` or more that an open window has, or -1."""
        at, counts = need + self.size, self.counts
        if not counts[at]:
            while True:
                if at & (at + 1) == 0:  # the last node of its level: nothing to the right
                    return -1
                if not at & 1 and counts[at + 1]:
                    at += 1
                    break
                at >>= 1
            while at < self.size:
                at = 2 * at if counts[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset in it of each length (1 to ``window``), longest first, each into the tightest open window."""
    order = np.argsort(-lengths, kind="stable")
    place, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, open_at, opened = CapacityTree(window), [[] for _ in range(window + 1)], 0
    for i in order.tolist():
        n = int(lengths[i])
        left = tree.tightest(n)
        if left < 0:
            place[i], offset[i], left = opened, 0, window
            opened += 1
        else:
            place[i], offset[i] = open_at[left].pop(), window - left
            tree.add(left, -1)
        if left > n:
            open_at[left - n].append(int(place[i]))
            tree.add(left - n)
    return place, offset


class Encoder:
    """Token ids of texts as the tokenizers file at ``path`` gives them, without special tokens being added.

    Where the file is a byte-level BPE whose ids are in the order of its merges, the same ids come faster from tiktoken
    with the file's own vocabulary; texts with the string of an added token, and all texts of other files, go to
    tokenizers itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        self.fast = self._fast(path)

    def _fast(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model", {})
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not spec.get("normalizer")
        if not plain or model.get("type") != "BPE" or model.get("unk_token") or model.get("dropout") or model.get("ignore_merges"):
            return None
        vocab = {token: i for token, i in model["vocab"].items() if token not in self.added}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [vocab.get(m, -1) for m in merged]
        singles = [i for token, i in vocab.items() if len(token) == 1]
        if ids != sorted(ids) or len(singles) != 256 or len(set(ids)) != len(vocab) - 256 or max(singles) > min(ids):
            return None
        byte_of = bytes_of_letters()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(x in text for x in self.added):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), "<u4")
            except ValueError:  # a run of white space beyond what its pattern matcher can go back over
                pass
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4")


def bytes_of_letters() -> dict[str, int]:
    """Byte-level BPE writes each byte as a letter: printable bytes as themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenized documents cut into full windows and one rest: id_col, start, length, ids_crc32, doc_tokens, piece and, if wanted, ids.

    ``piece`` is a number of its own for each. ``tokenizer`` is the path of a tokenizers file that every executor can read.
    """
    if window < 1:
        raise ValueError("a window holds one token at least")
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "piece"))]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, number = Encoder(tokenizer), TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        for batch in slices(batches, "_text"):
            rows, starts, lengths, sums, totals, ids_out = [], [], [], [], [], []
            for row, text in enumerate(batch.column("_text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    rows.append(row), starts.append(start), lengths.append(len(part)), sums.append(zlib.crc32(part.tobytes())), totals.append(len(ids))
                    if with_ids:
                        ids_out.append(part.astype(np.int64))
            columns = [batch.column("_id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)), pa.array(np.arange(number, number + len(rows)))]
            number += len(rows)
            if with_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def pack(cut: DataFrame, window: int = WINDOW, tasks: int | None = None) -> DataFrame:
    """Adds sequence_id, offset and padding to pieces of up to ``window`` tokens; ``cut`` must give the same rows each time it is read.

    A full window is a sequence by itself and stays where it is. The rests are dealt out evenly, by a hash of their
    numbers, to ``tasks`` packing tasks (one for about ``RESTS_PER_TASK`` if none is given), each of which sorts its
    pieces, so a repeated task gives the same windows. A task holds its rests' rows, some hundred bytes each, ids not
    counted. ``padding`` is that of the whole sequence: it is filled up to the window, save where its tokens are a
    power of two.
    """
    schema = T.StructType([*cut.schema.fields, *(T.StructField(n, T.LongType()) for n in ("sequence_id", "offset", "padding"))])
    full, rests = cut.where(F.col("length") == window), cut.where(F.col("length") < window)
    tasks = tasks or 1 + rests.count() // RESTS_PER_TASK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        lengths = np.concatenate([b.column("length").to_numpy(zero_copy_only=False) for b in held])
        place, offset = best_fit_decreasing(lengths, window)
        filled = np.bincount(place, weights=lengths).astype(np.int64)
        padding = np.where(filled & (filled - 1) == 0, 0, window - filled)[place]
        place = 2 * (place + TaskContext.get().partitionId() * SEQUENCES_PER_TASK) + 1
        done = 0
        for b in held:
            part = slice(done, done := done + b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place[part]), pa.array(offset[part]), pa.array(padding[part])], [f.name for f in schema.fields])

    dealt = rests.repartition(tasks, F.xxhash64("piece")).sortWithinPartitions(F.desc("length"), "piece")
    whole = full.select(*cut.columns, (F.col("piece") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("padding"))
    return whole.unionByName(dealt.mapInArrow(run, schema))


def _cut(docs: DataFrame, *how, **more) -> DataFrame:
    """The pieces from a table in the shared folder: they are read twice, and a lost executor must not number them anew."""
    return stored(pieces(docs, *how, **more), "pieces")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", tasks: int | None = None) -> DataFrame:
    """Rows (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding), one per piece of a document.

    A document is its token ids and then ``end_id``; documents longer than a window are first cut into full windows.
    A null or empty text is the end id alone. Repeated rows are packed each, a null id is kept, an empty table gives
    no rows, other columns are ignored. Texts of any length and any run of white space give the ids of the tokenizers
    file. Text is read and tokenized once and never shuffled: only the numbers of the rests move.
    """
    return pack(_cut(docs, tokenizer, window, end_id, id_col, text_col), window, tasks).drop("piece")


def sequences(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", tasks: int | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (in order, unpadded), and the pieces they are made of."""
    packed = pack(_cut(docs, tokenizer, window, end_id, id_col, text_col, with_ids=True), window, tasks)
    held = F.sort_array(F.collect_list(F.struct("offset", id_col, "start", "length", "ids")))
    return packed.groupBy("sequence_id").agg(held.alias("_held")).select("sequence_id", F.flatten("_held.ids").alias("ids"), F.transform("_held", lambda x: F.struct(x["offset"], x[id_col], x["start"], x["length"])).alias("pieces"))
