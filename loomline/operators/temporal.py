"""Operators over ordered rows: interpolation of sparse dates, gaps, runs, sessions, pace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """Adds the place of each row in its group, from 0; ``order`` must tell all rows of a group apart."""
    return df.withColumn(name, (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def nearest(df: DataFrame, keys: Sequence[str], pos: str, value: Column, before: str = "before", after: str = "after") -> DataFrame:
    """Two-sided as-of join of a table with itself: ``value`` of the nearest rows before and after that have one."""
    w = W.partitionBy(*keys).orderBy(pos)
    return df.withColumn(before, F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn(after, F.first(value, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)))


def interpolate_dates(df: DataFrame, keys: Sequence[str], pos: str, at: str, precision: str, default_at: str | None = None, default_precision: str | None = None) -> DataFrame:
    """Adds at_est (microseconds), precision_est and source to every row.

    A row's own date comes first; between two dated rows time goes with the position and the precision is the lesser
    one; next to one dated row only, that row's date is taken; then the group's default; else there is none.
    """
    held = F.when(F.col(at).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(at).alias("t"), F.col(precision).alias("k")))
    out = nearest(df, keys, pos, held, "_b", "_a")
    b, a = F.col("_b"), F.col("_a")
    between = b["t"] + F.floor((a["t"] - b["t"]).cast("double") * (F.col(pos) - b["p"]) / (a["p"] - b["p"])).cast("long")
    source = F.when(F.col(at).isNotNull(), "own").when(b.isNotNull() & a.isNotNull(), "between").when(b.isNotNull() | a.isNotNull(), "near")
    if default_at:
        source = source.when(F.col(default_at).isNotNull(), "tray")
    source = source.otherwise("none")
    out = out.withColumn("source", source)
    pick = lambda own, mid, side, rest: F.when(F.col("source") == "own", own).when(F.col("source") == "between", mid).when(F.col("source") == "near", side).otherwise(rest)
    rest_at, rest_precision = (F.col(default_at), F.col(default_precision)) if default_at else (F.lit(None), F.lit(None))
    out = out.withColumn("at_est", pick(F.col(at), between, F.coalesce(b["t"], a["t"]), rest_at).cast("long"))
    return out.withColumn("precision_est", pick(F.col(precision), F.least(b["k"], a["k"]), F.coalesce(b["k"], a["k"]), rest_precision).cast("int")).drop("_b", "_a")


def same_class_dates(df: DataFrame, keys: Sequence[str], class_col: str, pos: str, at: str) -> DataFrame:
    """Adds before_at and after_at: the nearest dated rows of the same class on either side, seen from every row of that class."""
    return nearest(df, [*keys, class_col], pos, F.col(at), "before_at", "after_at")


def fill_between_equal(df: DataFrame, keys: Sequence[str], pos: str, value: str, skip: Column, same=None) -> DataFrame:
    """Adds ``filled``: what the nearest valued rows on both sides agree on, for rows without a value; rows to skip neither get nor give one."""
    same = same or (lambda x, y: x == y)
    out = nearest(df, keys, pos, F.when(~skip, F.col(value)), "_b", "_a")
    return out.withColumn("filled", F.when(F.col(value).isNull() & ~skip & same(F.col("_b"), F.col("_a")), F.col("_b"))).drop("_b", "_a")


def sessions(df: DataFrame, keys: Sequence[str], at: str, tie: str, gap: int, name: str = "session") -> DataFrame:
    """Adds a number that grows with every row more than ``gap`` after the one before it in its group."""
    w = W.partitionBy(*keys).orderBy(at, tie)
    starts = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("long"), F.lit(0))
    return df.withColumn("_s", starts).withColumn(name, F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def coalesced_edits(df: DataFrame, owner: Sequence[str], key: str, at: str, tie: str, gap: int, most: int = 60) -> DataFrame:
    """Undo steps: consecutive edits of one owner with the same key within ``gap`` of the last are one step; the newest ``most`` stay.

    An edit without a key is a step of its own.
    """
    w = W.partitionBy(*owner).orderBy(at, tie)
    joins = (F.col(key) == F.lag(key).over(w)) & (F.col(at) - F.lag(at).over(w) <= gap)
    steps = df.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("step", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long"))
    found = steps.groupBy(*owner, "step").agg(F.first(key).alias(key), F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return found.withColumn("_r", F.row_number().over(W.partitionBy(*owner).orderBy(F.desc("step")))).where(F.col("_r") <= most).drop("_r")


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "run") -> DataFrame:
    """Adds the number of each run of equal values in the order given, from 0; nulls equal each other."""
    w = W.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    change = F.when(first | F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return df.withColumn("_c", change).withColumn(name, F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("_c")


def pace(df: DataFrame, keys: Sequence[str], at_us: str, tie: str, cap_s: int = 600, least_s: int = 300) -> DataFrame:
    """n, active_us (gaps capped) and rate per active hour; the rate is null for fewer than two rows or too little activity."""
    gap = F.col(at_us) - F.lag(at_us).over(W.partitionBy(*keys).orderBy(at_us, tie))
    capped = F.when(gap.isNull(), 0).otherwise(F.least(gap, F.lit(cap_s * 1_000_000)))
    out = df.withColumn("_gap", capped).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_gap").cast("long").alias("active_us"))
    rate = (F.col("n") - 1) / (F.col("active_us") / 3.6e9)
    return out.withColumn("rate", F.when((F.col("n") >= 2) & (F.col("active_us") >= least_s * 1_000_000), rate))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The last ``most`` rows of each group."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")
