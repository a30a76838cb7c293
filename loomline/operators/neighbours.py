"""Nearest-neighbour suggestion over short feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions.curves import smooth

# Fixed values.
K, MAX_DISTANCE, OTHER_CLASS_WEIGHT, ENOUGH, SOFTEN = 7, 3.0, 0.3, 5, 0.25
#: Steps that can be undone.
MOST_UNDO = 60
#: Examples that may be kept; queries meet all of them, so their number is what bounds the join.
MAX_EXAMPLES = 20_000


def standardised(examples: DataFrame, features: str) -> DataFrame:
    """One row: mean and population deviation (+ 0.001) of every dimension."""
    each = examples.select(F.posexplode(features).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), (F.stddev_pop("x") + 1e-3).alias("s"))
    rows = F.sort_array(F.collect_list(F.struct("i", "m", "s")))
    return each.agg(rows.alias("r")).select(F.col("r.m").alias("mean"), F.col("r.s").alias("scale"))


def newest_examples(examples: DataFrame, order: str, most: int = MAX_EXAMPLES) -> DataFrame:
    """The last ``most`` examples, which makes the side that every query is compared with a bounded one."""
    return examples.orderBy(F.desc(order)).limit(most)


def nearest(queries: DataFrame, examples: DataFrame, query_id: str, order: str, features: str, k: int = K, max_distance: float = MAX_DISTANCE, most: int = MAX_EXAMPLES, others: bool = False) -> DataFrame:
    """Rows (query_id, the example's columns, distance, rank): the k nearest examples of each query that lie within the distance.

    With ``others`` an example whose ``order`` is the query's id is the query itself and left out.

    Distance is the root of the mean squared difference of standardised features. Examples are at most ``most``, so
    they are broadcast, and Spark keeps the k best of each query in its task before it shuffles them. Ties go to the
    earlier example.
    """
    few = newest_examples(examples, order, most)
    scale = standardised(few, features)
    z = lambda c: F.zip_with(F.zip_with(c, F.col("mean"), lambda x, m: x.cast("double") - m), F.col("scale"), lambda d, s: d / s)
    few = few.crossJoin(F.broadcast(scale)).select(z(F.col(features)).alias("_ez"), F.struct(*[c for c in examples.columns if c != features]).alias("example"))
    asked = queries.crossJoin(F.broadcast(scale)).select(F.col(query_id), z(F.col(features)).alias("_qz"))
    square = F.aggregate(F.zip_with("_qz", "_ez", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    met = asked.crossJoin(F.broadcast(few))
    met = met.where(F.col(query_id) != F.col("example")[order]) if others else met
    pairs = met.select(query_id, "example", F.sqrt(square / F.size("_qz")).alias("distance"))
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy("distance", F.col("example")[order]))).where(F.col("rank") <= k)
    return ranked.where(F.col("distance") <= max_distance).select(query_id, "example.*", "distance", "rank")


def regress(found: DataFrame, query_id: str, values: list[str], weight: Column) -> DataFrame:
    """Weighted means of the neighbours' values, to three digits, and the weighted vote of those that are flags."""
    total = F.sum(weight)
    return found.groupBy(query_id).agg(F.count("*").alias("neighbours"), *[F.round(F.sum(weight * F.col(v)) / total, 3).alias(v) for v in values])


def resuggested(slides: DataFrame, suggestions: DataFrame, key: str, most_undo: int = MOST_UNDO) -> DataFrame:
    """The rows of ``slides`` (key, open, params map, source, undo array<struct<params map, what>>) with what is suggested put in, and ``applied``.

    Only rows that are ``open`` (not developed, skipped or locked, and described) and have something suggested change:
    suggested values go over their own, the source says from how many examples they come, and what was before goes
    onto the steps to undo, of which the last ``most_undo`` stay. ``suggestions`` (key, values map, n) has each key once
    at most. Nulls count as not open and as no steps.
    """
    rows = slides.join(suggestions.select(F.col(key).alias("_key"), F.col("values").alias("_values"), F.col("n").alias("_n")), F.col(key) == F.col("_key"), "left")
    applied = F.coalesce(F.col("open") & (F.size("_values") > 0), F.lit(False))
    kept = F.map_filter("params", lambda name, v: ~F.array_contains(F.map_keys("_values"), name))
    step = F.struct(F.col("params").alias("params"), F.lit("learned").alias("what"))
    steps = F.concat(F.coalesce("undo", F.array().cast(slides.schema["undo"].dataType)), F.array(step))
    last = F.slice(steps, F.greatest(F.size(steps) - most_undo + 1, F.lit(1)), F.lit(most_undo))
    changed = {"params": F.map_concat(kept, F.col("_values")), "source": F.concat(F.lit("learned:"), F.col("_n").cast("string")), "undo": last}
    return rows.select(*[F.when(applied, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in slides.columns], applied.alias("applied"))


def classify(found: DataFrame, query_id: str, label: str) -> DataFrame:
    """Rows (query_id, label, share): each class's share of the neighbours' weight, held back by n / (n + 1)."""
    w = 1 / (F.col("distance") + SOFTEN)
    each = found.groupBy(query_id, label).agg(F.sum(w).alias("_w"), F.count("*").alias("_n"))
    all_of = W.partitionBy(query_id)
    n = F.sum("_n").over(all_of)
    return each.select(query_id, label, (F.col("_w") / F.sum("_w").over(all_of) * n / (n + 1)).alias("share"))


def smoothed(shares: DataFrame, item: str, group: str, label: str, share: str, class_order: Column, own: float = 0.5, least: float = 0.3) -> DataFrame:
    """The class of each item after mixing its shares with its group's mean; none under ``least``; ties go to the first class.

    A class that an item lacks counts as 0 in the mean, which is over all items of the group.
    """
    items = shares.groupBy(group).agg(F.count_distinct(item).alias("_n"))
    means = shares.groupBy(group, label).agg(F.sum(share).alias("_s")).join(items, group).select(group, label, (F.col("_s") / F.col("_n")).alias("_mean"))
    grid = shares.select(item, group).distinct().join(means, group)
    mixed = grid.join(shares.select(item, label, share), [item, label], "left").withColumn("_p", own * F.coalesce(F.col(share), F.lit(0.0)) + (1 - own) * F.col("_mean"))
    best = mixed.groupBy(item, group).agg(F.max_by(F.struct(F.col(label), F.col("_p")), F.struct(F.col("_p"), -class_order)).alias("b"))
    return best.where(F.col("b._p") >= least).select(item, group, F.col(f"b.{label}").alias(label), F.col("b._p").alias("p"))


#: Places at which curves are read before they are averaged, and how near the diagonal a curve is none.
CURVE_PLACES, DIAGONAL = 9, 0.005


def average_curves(found: DataFrame, query_id: str, curves: str, weight: Column) -> DataFrame:
    """Rows (query_id, channel, curve array<double>): each channel's mean curve where half of the neighbours' weight has one.

    ``curves`` is map<string, array<struct<x, y>>>; each smooth curve is read at even places, level beyond its ends. A
    neighbour without a curve counts as the straight line. A mean that nowhere leaves the diagonal is dropped.
    """
    places = [i / (CURVE_PLACES - 1) for i in range(CURVE_PLACES)]
    weighed = found.select(query_id, curves, weight.alias("_w"))
    totals = weighed.groupBy(query_id).agg(F.sum("_w").alias("_t"))
    each = weighed.select(query_id, "_w", F.explode(curves).alias("channel", "_c")).where(F.size("_c") >= 2)
    read = each.withColumn("_r", smooth(F.col("_c"), F.array(*[F.lit(x) for x in places])))
    sums = read.groupBy(query_id, "channel").agg(F.sum("_w").alias("_s"), *[F.sum(F.col("_w") * F.get("_r", F.lit(i))).alias(f"_y{i}") for i in range(CURVE_PLACES)])
    mean = F.array(*[(F.col(f"_y{i}") + (F.col("_t") - F.col("_s")) * x) / F.col("_t") for i, x in enumerate(places)])
    rows = sums.join(totals, query_id).where(F.col("_s") >= 0.5 * F.col("_t")).select(query_id, "channel", mean.alias("curve"))
    straight = F.array(*[F.lit(x) for x in places])
    return rows.where(F.exists(F.zip_with("curve", straight, lambda a, b: F.abs(a - b)), lambda d: d > DIAGONAL))
