"""Near-duplicate documents by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.spark_io import cut, slices
from loomline.operators.components import connected_components

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
#: Buckets of up to so many fingerprints are compared pair by pair, larger ones by midpoints.
PAIR_BUCKET = 16
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of a text: words parted by ASCII white space, A-Z lower-cased, each shingle one vote."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    votes = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, _CHUNK):
        end = min(n, start + _CHUNK)
        part = [digest(b" ".join(words[i : i + shingle]), seed) for i in range(start, end)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, text_key long, fp long), one per row of ``docs``; with the id, the key of a text tells rows apart that repeat an id."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("text_key", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = [fingerprint(x) for x in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), pa.array(found, pa.int64())], [f.name for f in schema.fields])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_key"), text.alias("_text")).mapInArrow(run, schema)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks; for every set of up to ``radius`` bit positions one mask at least has none of them.

    Each position is given a vector of radius + 1 bits, not zero. The mask of a vector v holds the positions whose own
    vector has an odd product with v. The vectors of ``radius`` positions leave some v orthogonal to them all.
    """
    vectors = 2 ** (radius + 1) - 1
    masks = [sum(1 << i for i in range(bits) if ((1 + i % vectors) & v).bit_count() % 2) for v in range(1, vectors + 1)]
    return [m - (1 << bits) if m >= 1 << (bits - 1) else m for m in masks]


def _flipped(fp: Column) -> Column:
    """The value itself and all values one bit away."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit((1 << i) if i < BITS - 1 else -(1 << i))) for i in range(BITS)])


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Links (a, b) between distinct values of ``fps.fp`` whose components are those of all pairs within ``radius`` bits.

    Fingerprints meet in the tables of the covering masks. Small buckets are compared pair by pair. The members of a
    large bucket instead send themselves to every value one bit away: two values within two bits share such a
    midpoint, and those that share one (65 at most) are within two bits of each other, so each is linked to the
    least of them. No pair is lost and no bucket is expanded into all its pairs.
    """
    if radius != 2:
        raise ValueError("midpoints are exact for a radius of 2")
    masks = F.array(*[F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(covering_masks(radius))])
    keyed = fps.select("fp", F.inline(masks))
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = cut(sizes)
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    small = keyed.join(sizes.where(F.col("n") <= pair_bucket), ["table", "key"])
    pairs = small.select("table", "key", F.col("fp").alias("a")).join(small.select("table", "key", F.col("fp").alias("b")), ["table", "key"]).where((F.col("a") < F.col("b")) & (apart <= radius)).select("a", "b")
    large = keyed.join(sizes.where(F.col("n") > pair_bucket), ["table", "key"]).select("fp").distinct()
    at = large.select("fp", F.explode(_flipped(F.col("fp"))).alias("at"))
    least = at.groupBy("at").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").select("at", "least")
    stars = at.join(least, "at").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """Rows (id_col, text_key, fp, root, component_id), one per row of ``docs``; root is a fingerprint that names the component."""
    thin = cut(fingerprints(docs, id_col, text_col))
    fps = cut(thin.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = cut(connected_components(fingerprint_links(fps.select("fp"), radius)))
    members = roots.join(fps, roots["node"] == fps["fp"]).select("fp", "root", "first")
    firsts = members.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = members.join(firsts, "root").select("fp", "root", "component_id")
    named = fps.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    return thin.join(named, "fp").select(id_col, "text_key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows (id_col, fingerprint 16 hex digits, component_id), one per row of ``docs``.

    Documents are linked when their fingerprints differ in ``radius`` bits or fewer; component_id is the smallest
    id reachable by links. A null text counts as empty, an empty text has fingerprint zero and is linked like any
    other, repeated rows are linked with each other, a null id never is the smallest unless all are null. Other
    columns of ``docs`` are ignored and an empty table gives no rows. Texts are read once; from then on only ids and
    fingerprints move, and equal fingerprints are one node.
    """
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _grouped(docs, id_col, text_col, radius).select(id_col, shown.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Of each component of near copies one row of ``docs``, with all its columns; the decision is on rows, not on ids.

    The row stays that has the component's smallest id; of several the one with the least fingerprint, then the least
    hash of the text, then the first by its other columns written as JSON, so the order of the rows decides nothing.
    An id that several texts share stays once for each component that it leads. Rows without an id stay only where
    no row of their component has one. The texts are shuffled once, by id and hash.
    """
    leads = _grouped(docs, id_col, text_col, radius).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    kept = leads.groupBy("root").agg(F.min(F.struct("fp", "text_key", F.col(id_col).alias("id"))).alias("_k")).select(F.col("_k.id").alias("_kept_id"), F.col("_k.text_key").alias("_kept_key"))
    # two hashes stand for id and text, so that join and window shuffle by the same columns, which no null needs a case for
    id_key = lambda c: F.xxhash64(F.lit(7), F.col(c)).alias("_id")
    kept = kept.select(id_key("_kept_id"), F.col("_kept_key").alias("_key"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), id_key(id_col), F.xxhash64(F.col(text_col).cast("string")).alias("_key"))
    named = rows.join(kept, ["_id", "_key"], "left_semi")
    others = F.to_json(F.struct(*[F.col(f"_row.`{c}`") for c in docs.columns if c != text_col]))
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_key").orderBy(others))).where("_n = 1")
    return first.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
