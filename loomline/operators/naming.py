"""Running sums along an order that no single task holds, and names that clash with no other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.sources.shared import stored


def running_sum(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The rows with ``name``: the sum of ``value`` over the rows of their group up to them, in an order without ties in a group.

    Groups are cut into ranges of the order, which tasks share out; the sums of the ranges before are added to what a
    range sums up by itself. A group of any size is spread over many tasks, and a window holds one range of it.
    """
    spread = stored(df.withColumn("_value", value).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = spread.groupBy(*by, "_range").agg(F.sum("_value").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_of"), before.alias("_before"))
    same = F.col("_range") == F.col("_of")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    own = F.sum("_value").over(W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return spread.join(totals, same).withColumn(name, F.col("_before") + own).select(*df.columns, name)


def free_numbers(asks: DataFrame, used: DataFrame, by: list[str], key: str, place: str, first: int) -> DataFrame:
    """Rows (by, key, number): to each of ``asks`` (by, key, place) the place-th number from ``first`` on that its group doesn't use.

    Places count from 1 and differ within a group, ``used`` has each number (by, number) of ``first`` or more once. The
    r-th free number follows from the gaps: it is first + r - 1 and one more for each number in use with fewer than r
    free ones below it, so places and numbers in use are merged by one running count.
    """
    kind = dict(asks.dtypes)[key]
    held = running_sum(used, by, ["number"], F.lit(1), "so_far")
    below = held.select(*by, (F.col("number") - first + 1 - F.col("so_far")).alias("at"), F.lit(0).alias("asks"), F.lit(None).cast(kind).alias(key), F.col("number").cast("long").alias("number"))
    asking = asks.select(*by, F.col(place).cast("long").alias("at"), F.lit(1).alias("asks"), key, F.lit(0).cast("long").alias("number"))
    merged = running_sum(asking.unionByName(below), by, ["at", F.desc("asks"), "number"], 1 - F.col("asks"), "passed")
    return merged.where("asks = 1").select(*by, key, (F.col("at") + first - 1 + F.col("passed")).alias("number"))


#: A name that looks numbered: what stands before the number, and the number from 2 on.
NUMBERED = r"^(.*)-([2-9]|[1-9]\d{1,17})$"


def free_names(items: DataFrame, taken: DataFrame, key: str, wanted: str) -> DataFrame:
    """Rows (key, name): each item's wanted name, or that with the least number "-2", "-3", ... that leaves no two names alike.

    The first item by ``key`` that wants a name has it as it stands unless ``taken`` (one column, the same name as ``wanted``)
    holds it. The others get numbers in order of their keys. Numbers are passed over whose name is taken or is wanted
    as it stands by any item, also where a name wanted looks like a numbered one. Keys are unique; rows without a key or
    a name are left out; names in ``taken`` may repeat.
    """
    rows = items.where(F.col(key).isNotNull() & F.col(wanted).isNotNull()).select(F.col(key).alias("key"), F.col(wanted).alias("stem"))
    held = taken.where(F.col(wanted).isNotNull()).select(F.col(wanted).alias("stem")).distinct()
    ranked = running_sum(rows, ["stem"], ["key"], F.lit(1), "place")
    ranked = stored(ranked.join(held.withColumn("held", F.lit(1)), "stem", "left").withColumn("place", F.col("place") - 1 + F.coalesce("held", F.lit(0))), "places")
    plain = ranked.where("place = 0").select("key", F.col("stem").alias("name"))
    numbered = ranked.where("place > 0").select("stem", "key", "place")
    stems = numbered.select("stem").distinct()
    names = held.unionByName(rows.select("stem")).distinct().where(F.col("stem").rlike(NUMBERED))
    used = names.select(F.regexp_extract("stem", NUMBERED, 1).alias("stem"), F.regexp_extract("stem", NUMBERED, 2).cast("long").alias("number")).join(stems, "stem", "left_semi")
    given = free_numbers(numbered, used, ["stem"], "key", "place", 2).select("key", F.concat("stem", F.lit("-"), F.col("number").cast("string")).alias("name"))
    return plain.unionByName(given).withColumnsRenamed({"key": key})
