"""Labelled rows: which are held out, and a bounded sample of the others to fit a classifier on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the labelled sample, half of them from each class at most.
SAMPLE_ROWS = 4000


def remainder(id_col: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))


def training_labels(labels: DataFrame, label_col: str, usable: Callable[[Column], Column], id_col: str = "doc_id") -> DataFrame:
    """Rows (id_col, label 0 or 1), one per id. Rows with a null id or label are left out; contradicting labels of one id too."""
    rows = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col(id_col).isNotNull())
    one = rows.groupBy(id_col).agg(F.min("label").alias("label"), F.max("label").alias("_other")).where("label = _other").drop("_other")
    return one.where(usable(F.col(id_col)))


def bounded_sample(train: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> tuple[DataFrame, dict[int, float]]:
    """Up to ``rows`` labels, half of each class at most, those with the least hashes; and how many rows of ``train`` each of a class stands for."""
    half = rows // 2
    key = F.xxhash64(F.col(id_col).cast("string"))
    parts = [train.where(F.col("label") == k).orderBy(key, id_col).limit(half) for k in (0, 1)]
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    return parts[0].unionByName(parts[1]), {k: counts.get(k, 0) / max(1, min(half, counts.get(k, 0))) for k in (0, 1)}
