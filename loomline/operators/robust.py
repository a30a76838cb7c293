"""Robust and weighted estimators per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.sources.shared import cut

_NEAR = 1e-9


def _cumulated(sums: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Running weights of each group's values in order, without one task that holds a group: ranges of values are added up first, and each range starts from the sum of those before it."""
    held = cut(sums.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()))
    ranges = held.groupBy(*keys, "_p").agg(F.sum("_w").alias("_s"), F.min("_v").alias("_f"))  # a row per group and partition
    w = W.partitionBy(*keys).orderBy("_p")
    starts = ranges.select(*keys, "_p", F.coalesce(F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_o"), F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_t"), F.lead("_f").over(w).alias("_n"))
    own = W.partitionBy(*keys, "_p").orderBy("_v")
    return held.join(starts, [*keys, "_p"]).select(*keys, "_v", "_w", (F.col("_o") + F.sum("_w").over(own.rowsBetween(W.unboundedPreceding, 0))).alias("_c"), "_t", F.coalesce(F.lead("_v").over(own), "_n").alias("_next"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact percentiles per group by linear interpolation, one column for each name of ``at``; nulls don't count.

    Equal values are counted before the shuffle, and a group's values are spread over ranges, so no task holds a group.
    """
    counts = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count("*").cast("double").alias("_w"))
    ranked = _cumulated(counts, keys)
    place = lambda c: F.lit(c) * (F.col("_t") - 1)
    found = ranked.groupBy(*keys).agg(F.first("_t").alias("_t"), *[F.min(F.when(F.col("_c") > f(place(c)), F.col("_v"))).alias(f"_{n}_{name}") for name, c in at.items() for n, f in (("lo", F.floor), ("hi", F.ceil))])
    between = lambda name, c: F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (place(c) - F.floor(place(c)))
    return found.select(*keys, *[between(name, c).alias(name) for name, c in at.items()])


def weighted_median(df: DataFrame, keys: Sequence[str], value: Column, weight: Column, name: str = "median") -> DataFrame:
    """Per group the value where the cumulated weight passes half; exactly at half, the mean with the next value.

    Equal values are added up before the shuffle, so a large group costs as many rows as it has distinct values.
    """
    sums = df.select(*keys, value.alias("_v"), weight.alias("_w")).where("_v IS NOT NULL AND _w > 0").groupBy(*keys, "_v").agg(F.sum("_w").alias("_w"))
    w = W.partitionBy(*keys).orderBy("_v")
    running = F.sum("_w").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_c")
    cumulated = sums.select("*", running, F.sum("_w").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_t"), F.lead("_v").over(w).alias("_next")) if keys else _cumulated(sums)
    reached = cumulated.where(F.col("_c") >= F.col("_t") / 2 - _NEAR)
    least = reached.groupBy(*keys).agg(F.min_by(F.struct("_v", "_c", "_t", "_next"), "_v").alias("m"))
    m = F.col("m")
    middle = F.when(m["_c"] > m["_t"] / 2 + _NEAR, m["_v"]).otherwise((m["_v"] + F.coalesce(m["_next"], m["_v"])) / 2)
    return least.select(*keys, middle.alias(name))


# How strongly priors pull at small numbers of samples.
PRIOR_N, PERSON_N, PRIOR_SIGMA, MAD = 3.0, 4.0, 0.2, 1.4826


def calibrate(samples: DataFrame, person: str, guess: str, real: str, weight: str) -> tuple[DataFrame, DataFrame]:
    """How guesses differ from real values in log space: (one row bias, sigma, n; rows person, own).

    The common bias is the median over persons of their medians, each person counting once at most, so that one with
    many samples says no more than another; each person's own correction follows, and the spread left after both.
    """
    r = samples.select(F.col(person).alias("p"), (F.log1p(F.greatest(F.col(real), F.lit(0.0))) - F.log1p(F.greatest(F.col(guess), F.lit(0.0)))).alias("x"), F.col(weight).cast("double").alias("w"))
    weights = r.groupBy("p").agg(F.sum("w").alias("wp"), F.count("*").alias("np"))
    medians = cut(weighted_median(r, ["p"], F.col("x"), F.col("w")).join(weights, "p").withColumn("w1", F.least("wp", F.lit(1.0))))
    totals = medians.agg(F.sum("w1").alias("k"), F.sum("wp").alias("w"), F.sum("np").alias("n"))
    bias = cut(weighted_median(medians, [], F.col("median"), F.col("w1")).crossJoin(F.broadcast(totals)).select((F.col("median") * F.col("k") / (F.col("k") + PRIOR_N)).alias("bias"), "w", "n"))
    # what is common shifts a person's median as it shifts every sample
    own = medians.crossJoin(F.broadcast(bias.select("bias"))).select("p", "bias", ((F.col("median") - F.col("bias")) * F.col("wp") / (F.col("wp") + PERSON_N)).alias("own"))
    left = r.join(own, "p").select(F.abs(F.col("x") - F.col("bias") - F.col("own")).alias("d"), "w")
    spread = weighted_median(left, [], F.col("d"), F.col("w"), "mad").crossJoin(F.broadcast(bias))
    square = F.pow(F.col("mad") * MAD, F.lit(2.0))
    sigma = F.sqrt((F.col("w") * square + PRIOR_N * PRIOR_SIGMA * PRIOR_SIGMA) / (F.col("w") + PRIOR_N))
    return spread.select("bias", sigma.alias("sigma"), F.col("n").cast("long").alias("n")), own.select(F.col("p").alias(person), "own")


def inverse_variance(value: Column, sd: Column) -> tuple[Column, Column]:
    """Aggregates: the mean weighted by the inverse variance, and its standard deviation."""
    total = F.sum(1 / (sd * sd))
    return F.sum(value / (sd * sd)) / total, F.sqrt(1 / total)


def consensus(df: DataFrame, keys: Sequence[str], order: str, value: str, sd: str, agree: float = 2.5) -> DataFrame:
    """Per group the inverse-variance mean of the values that agree with the one that most agree with: v, sd, n and members.

    Two values agree within ``agree`` of their joint deviations. Ties: the least deviation, then the first in order.
    A group's values are compared in pairs; groups are the few estimates that exist for one thing.
    """
    v = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"), F.col(sd).alias("s"))))
    held = df.where(F.col(value).isNotNull() & (F.col(sd) > 0)).groupBy(*keys).agg(v.alias("all"))
    friends = F.transform("all", lambda a: F.struct(F.filter("all", lambda b: F.abs(a["v"] - b["v"]) <= agree * F.sqrt(a["s"] * a["s"] + b["s"] * b["s"])).alias("f"), a["s"].alias("s"), a["o"].alias("o")))
    ranked = F.array_sort(F.transform(friends, lambda x: F.struct((-F.size(x["f"])).alias("n"), x["s"].alias("s"), x["o"].alias("o"), x["f"].alias("f"))))
    best = held.select(*keys, F.element_at(ranked, 1)["f"].alias("f"))
    total = F.aggregate("f", F.lit(0.0), lambda acc, x: acc + 1 / (x["s"] * x["s"]))
    mean = F.aggregate("f", F.lit(0.0), lambda acc, x: acc + x["v"] / (x["s"] * x["s"])) / total
    return best.select(*keys, mean.alias("v"), F.sqrt(1 / total).alias("sd"), F.size("f").cast("long").alias("n"), F.transform("f", lambda x: x["o"]).alias("members"))


#: Points of a group that one task sorts; larger groups are spread over ranges of values.
GROUP_ROWS = 1 << 20


def robust_line(df: DataFrame, keys: Sequence[str], x: str, y: str, rounds: int = 4, floor: float = 0.5, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per group slope and intercept of a line fitted again and again to the points near the one before: keys, slope, intercept, n.

    A point stays if its residual is within ``floor`` or three robust deviations of the round's points. Groups of up to
    ``group_rows`` points are dealt out by their keys once, to as many tasks as the points ask for, and go through all rounds where they are; those of larger
    groups are stored after each round, and their medians go by ranges of values.
    """
    points = df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    sizes = cut(points.groupBy(*keys).count())
    large = cut(sizes.where(F.col("count") > group_rows).select(*keys))
    tasks = max(int((sizes.agg(F.sum("count")).first()[0] or 0) // GROUP_ROWS) + 1, df.sparkSession.sparkContext.defaultParallelism)
    near = lambda m: F.col("_r") <= F.greatest(F.lit(floor), 3 * MAD * m)
    residual = F.abs(F.col("_y") - F.col("intercept") - F.col("slope") * F.col("_x"))

    def fitted(p: DataFrame) -> DataFrame:
        return p.groupBy(*keys).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.count("*").alias("n"))

    few = points if large.isEmpty() else points.join(large, list(keys), "left_anti")
    few = few.repartition(tasks, *keys)
    own = W.partitionBy(*keys)
    for _ in range(rounds - 1):
        off = few.withColumn("slope", F.regr_slope("_y", "_x").over(own)).withColumn("intercept", F.regr_intercept("_y", "_x").over(own)).select(*keys, "_x", "_y", residual.alias("_r")).where("_r IS NOT NULL")
        ranked = off.withColumn("_i", F.row_number().over(own.orderBy("_r")) - 1).withColumn("_p", (F.count("*").over(own) - 1) / 2)
        at = lambda f: F.max(F.when(F.col("_i") == f("_p"), F.col("_r"))).over(own)
        few = ranked.withColumn("_m", (at(F.floor) + at(F.ceil)) / 2).where(near(F.col("_m"))).select(*keys, "_x", "_y")
    if large.isEmpty():
        return fitted(few)
    many = points.join(large, list(keys), "left_semi")
    for _ in range(rounds - 1):
        off = cut(many.join(fitted(many), list(keys)).withColumn("_r", residual).where("_r IS NOT NULL"))
        many = cut(off.join(percentiles(off, keys, "_r", {"_m": 0.5}), list(keys)).where(near(F.col("_m"))).select(*keys, "_x", "_y"))
    return fitted(few).unionByName(fitted(many))
