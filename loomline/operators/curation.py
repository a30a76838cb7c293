"""Rows merged into their neighbours, changes named, weak members found, people of a scene pooled, work that is due."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Share of clipped picture beyond which a scan is clipped, and share of the best sharpness below which it is blurry.
CLIPPED, BLURRY = 0.85, 0.6


def merge_next(df: DataFrame, keys: Sequence[str], pos: str, into: Column, joined: Sequence[str], united: Sequence[str], left: str) -> DataFrame:
    """Rows whose ``into`` is true take in the row after them, and what that takes in: keys, pos, arrays, orphans.

    ``joined`` arrays are put one after the other, ``united`` ones keep the first of equals. ``orphans`` are the values
    of ``left`` of the rows that went, nulls left out. The last row of a key has none to take in.
    """
    by = W.partitionBy(*keys).orderBy(pos)
    rows = df.withColumn("_gone", F.coalesce(F.lag(into).over(by), F.lit(False))).withColumn("_head", F.sum(F.when(F.col("_gone"), 0).otherwise(1)).over(by))
    held = F.sort_array(F.collect_list(F.struct(F.col(pos), "_gone", *[F.coalesce(c, F.array()).alias(c) for c in (*joined, *united)], F.col(left))))
    of = lambda c: F.flatten(F.transform("_held", lambda x: x[c]))
    gone = F.filter("_held", lambda x: x["_gone"] & x[left].isNotNull())
    merged = rows.groupBy(*keys, "_head").agg(F.min(pos).alias(pos), held.alias("_held"))
    return merged.select(*keys, pos, *[of(c).alias(c) for c in joined], *[F.array_distinct(of(c)).alias(c) for c in united], F.transform(gone, lambda x: x[left]).alias("orphans"))


def changed_keys(before: Column, after: Column) -> Column:
    """What an edit of an array of maps changes, as "local 0:a,b 2:c"; null where an entry came or went.

    A key that is missing and one that holds null are the same.
    """

    def named(b: Column, a: Column) -> Column:
        every = F.array_sort(F.array_union(F.map_keys(b), F.map_keys(a)))
        return F.array_join(F.filter(every, lambda k: ~F.try_element_at(b, k).eqNullSafe(F.try_element_at(a, k))), ",")

    each = F.transform(F.zip_with(before, after, named), lambda k, i: F.when(k != "", F.concat(i.cast("string"), F.lit(":"), k)))
    return F.when(F.size(before) == F.size(after), F.concat(F.lit("local "), F.array_join(each, " ")))


def weak_members(df: DataFrame, keys: Sequence[str], item: str, sharp: str, clipped: str) -> DataFrame:
    """Rows (keys, item, reason): members of groups of two or more that are clipped or blurry against the sharpest.

    Where all would be, the sharpest stays, the first of equals.
    """
    by = W.partitionBy(*keys)
    best = F.coalesce(F.nullif(F.max(sharp).over(by), F.lit(0.0)), F.lit(1.0))
    rows = df.withColumn("_n", F.count("*").over(by)).withColumn("reason", F.when(F.col(clipped) > CLIPPED, "clipped").when(F.col(sharp) < BLURRY * best, "blurry"))
    rows = rows.withColumn("_weak", F.count("reason").over(by)).withColumn("_place", F.row_number().over(by.orderBy(F.desc(sharp), item)))
    return rows.where((F.col("_n") > 1) & F.col("reason").isNotNull() & ~((F.col("_weak") == F.col("_n")) & (F.col("_place") == 1))).select(*keys, item, "reason")


def pooled_people(df: DataFrame, scene: str, person: str, year: str, sd: str, birth_sd: str) -> DataFrame:
    """Rows (scene, person, year, sd, n): each person of a scene once, at the median of its years, surer the more slides it is on.

    The deviation is that of a guess, the median, over the root of the slides, three at most, with that of the birth year.
    """
    by = df.groupBy(scene, person).agg(F.median(year).alias("_y"), F.median(sd).alias("_s"), F.min(birth_sd).alias("_b"), F.count("*").alias("n"))
    own = F.col("_s") / F.sqrt(F.least("n", F.lit(3)))
    return by.select(scene, person, F.col("_y").alias("year"), F.sqrt(own * own + F.col("_b") * F.col("_b")).alias("sd"), "n")


def due_work(df: DataFrame, tray: str, order: str, kinds: Sequence[tuple[str, Column]], skipped: Column | None = None) -> DataFrame:
    """Rows (tray, pending, kind, order): how much of each tray is due, and what comes next: kinds by their order, then rows by theirs. Of ``skipped`` rows nothing is due."""
    df = df if skipped is None else df.where(~F.coalesce(skipped, F.lit(False)))
    each = F.array(*[F.when(due, F.struct(F.lit(i).alias("rank"), F.col(order).alias("at"), F.lit(kind).alias("kind"))) for i, (kind, due) in enumerate(kinds)])
    work = df.select(tray, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("w"))
    return work.groupBy(tray).agg(F.count("*").alias("pending"), F.min("w").alias("w")).select(tray, "pending", F.col("w.kind").alias("kind"), F.col("w.at").alias(order))


def collapsed(df: DataFrame, keys: Sequence[str], order: str, symbol: str, sureness: str, letters: Sequence[str]) -> DataFrame:
    """Rows (keys, text, confidence): a line read step by step: repeats in a row and the blank (0) go, the rest are letters.

    The confidence is the mean of the steps that count, 0 for an empty line.
    """
    by = W.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_new", (F.col(symbol) != F.coalesce(F.lag(symbol).over(by), F.lit(0))) & (F.col(symbol) > 0) & (F.col(symbol) <= len(letters)))
    letter = F.get(F.array(*[F.lit(x) for x in letters]), F.col(symbol) - 1)
    held = F.sort_array(F.collect_list(F.when(F.col("_new"), F.struct(F.col(order), letter.alias("x")))))
    return rows.groupBy(*keys).agg(F.trim(F.array_join(F.transform(held, lambda x: x["x"]), "")).alias("text"), F.coalesce(F.avg(F.when(F.col("_new"), F.col(sureness))), F.lit(0.0)).alias("confidence"))


def first_of(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """The rows of all parts, of each key only that of the first part that has it."""
    rows = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.groupBy(key).agg(F.min_by(F.struct(*[c for c in parts[0].columns if c != key]), "_part").alias("_r")).select(key, "_r.*")
