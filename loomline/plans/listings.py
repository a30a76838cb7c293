"""Queries that list, rank, check and expand: labels of scenes, prominent items, usage, shuffles, clean-up verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.sources.shared import read


def scene_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10: per order the return flag that more than half of its lines have, the most confident of equals."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_discount").alias("c"))
    rows = rows.withColumn("members", F.sum("n").over(W.partitionBy("l_orderkey"))).withColumn("r", F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("n"), F.desc("c"), "l_returnflag")))
    return rows.where("r = 1 AND 2 * n > members").select("l_orderkey", "l_returnflag", "n")


SCENES = "WITH g AS (SELECT l_orderkey, l_returnflag, count(*) AS n, sum(l_discount) AS c FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_returnflag, n FROM (SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, c DESC, l_returnflag) AS r FROM g) WHERE r = 1 AND 2 * n > m"


def prominent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT10, SRT11: of each order the sure and wide lines, half as wide as the widest at least, eight at most, from left to right."""
    rows = read(spark, sf_dir, "lineitem").where("l_tax <= 0.06 AND l_quantity >= 4").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    w = W.partitionBy("l_orderkey")
    rows = rows.withColumn("most", F.max("l_quantity").over(w)).where("l_quantity * 2 >= most")
    rows = rows.withColumn("r", F.row_number().over(w.orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_extendedprice"))).where("r <= 8")
    return rows.select("l_orderkey", "l_partkey", "l_quantity", F.row_number().over(w.orderBy("l_partkey", "l_linenumber", "l_extendedprice")).cast("long").alias("place"))


PROMINENT = """WITH k AS (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) AS most FROM lineitem WHERE l_tax <= 0.06 AND l_quantity >= 4), t AS (SELECT * FROM k WHERE l_quantity * 2 >= most QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_extendedprice) <= 8)
SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_extendedprice) AS place FROM t"""


def folder_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG21: bytes per source without the excluded language, against a quota."""
    used = read(spark, sf_dir, "documents").where("lang <> 'es'").groupBy("source").agg(F.sum(F.octet_length("text").cast("long")).alias("used"))
    return used.select("source", "used", (F.col("used") > 100_000).alias("over"))


USAGE = "SELECT source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS used, sum(octet_length(encode(text))) > 100000 AS over FROM documents WHERE lang <> 'es' GROUP BY source"


def shuffled_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN14: a stable order for a seed in which each item comes once."""
    key = F.sha1(F.concat(F.lit("seed 7:"), F.col("p_partkey").cast("string")))
    return read(spark, sf_dir, "part").select("p_partkey", F.row_number().over(W.partitionBy((F.col("p_partkey") % 50).alias("shard")).orderBy(key)).cast("long").alias("turn"))


SHUFFLED = "SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY sha1('seed 7:' || p_partkey)) AS turn FROM part"


def pull_in_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN21, JN28: remote items that aren't here yet: taken, skipped as known or not usable, counted."""
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    known = lab.select("doc_id", F.lit(True).alias("known"))
    rows = d.join(known, "doc_id", "left").select("source", F.coalesce("known", F.lit(False)).alias("known"), (F.col("lang").isin("en", "de")).alias("usable"))
    return rows.groupBy("source").agg(F.count_if(~F.col("known") & F.col("usable")).alias("taken"), F.count_if("known").alias("skipped"), F.count_if(~F.col("known") & ~F.col("usable")).alias("unusable"))


PULL = "SELECT source, count(*) FILTER (l.doc_id IS NULL AND lang IN ('en', 'de')) AS taken, count(*) FILTER (l.doc_id IS NOT NULL) AS skipped, count(*) FILTER (l.doc_id IS NULL AND lang NOT IN ('en', 'de')) AS unusable FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source"


def event_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN26: events of two slides or more, expanded to the slides they hold."""
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 10).alias("first_pos"), (F.col("s_suppkey") * 10 + F.col("s_suppkey") % 6).alias("last_pos")).where("last_pos > first_pos")
    return rows.select("s_suppkey", F.explode(F.sequence("first_pos", "last_pos")).alias("pos"))


SLIDES = "SELECT s_suppkey, unnest(range(s_suppkey * 10, s_suppkey * 10 + s_suppkey % 6 + 1)) AS pos FROM supplier WHERE s_suppkey % 6 > 0"


def tag_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET2, SET3, AGG12, LIF4: tags taken away become dismissals, those put back are no longer left out."""
    k = F.col("p_partkey")
    old, new = F.array(k % 3, k % 5 + 10, k % 7 + 20), F.array(k % 3 + k % 2, k % 5 + 10)
    gone = F.array_except(old, new)
    each = read(spark, sf_dir, "part").select(F.explode(gone).alias("tag"))
    return each.groupBy("tag").agg(F.count("*").alias("dismissed"))


TAGS = "SELECT tag, count(*) AS dismissed FROM (SELECT unnest(list_filter(list_distinct([p_partkey % 3, p_partkey % 5 + 10, p_partkey % 7 + 20]), lambda x: NOT list_contains([p_partkey % 3 + p_partkey % 2, p_partkey % 5 + 10], x))) AS tag FROM part) GROUP BY tag"


def card_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF6: files that may go from a card: those whose copy has the same size and hash."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("sha1"), F.octet_length("text").alias("size"))
    copy = d.where("doc_id % 6 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise(F.col("sha1")).alias("c_sha1"), F.when(F.col("doc_id") % 9 == 0, F.lit(0)).otherwise(F.col("size")).alias("c_size"))
    verdict = F.when(F.col("c_sha1").isNull(), "missing").when((F.col("c_size") == F.col("size")) & (F.col("c_sha1") == F.col("sha1")), "deletable").otherwise("mismatched")
    return d.join(copy, "doc_id", "left").select("doc_id", verdict.alias("verdict"))


CARD = "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'missing' WHEN doc_id % 7 <> 0 AND (doc_id % 9 <> 0 OR octet_length(encode(text)) = 0) THEN 'deletable' ELSE 'mismatched' END AS verdict FROM documents"


def double_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL5, FLT10: places that more than one thing claims."""
    rows = read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))
    return rows.where("n > 1")


DOUBLE = "SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS first_key FROM customer GROUP BY ALL HAVING count(*) > 1"


def shown_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT7, DAT8: dates as precise as they look: the first of January is a year, the first of a month a month."""
    day = F.to_date(F.when(F.col("o_orderkey") % 3 == 0, F.trunc("o_orderdate", "year")).when(F.col("o_orderkey") % 3 == 1, F.trunc("o_orderdate", "month")).otherwise(F.to_date("o_orderdate")))
    shown = F.when((F.month(day) == 1) & (F.dayofmonth(day) == 1), F.date_format(day, "yyyy")).when(F.dayofmonth(day) == 1, F.date_format(day, "yyyy-MM")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return read(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"), F.date_format(F.to_timestamp(F.date_format(day, "yyyy:MM:dd"), "yyyy:MM:dd"), "yyyy-MM-dd").alias("iso"))


SHOWN = """WITH d AS (SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN date_trunc('year', o_orderdate) WHEN 1 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE WHEN month(d) = 1 AND day(d) = 1 THEN strftime(d, '%Y') WHEN day(d) = 1 THEN strftime(d, '%Y-%m') ELSE strftime(d, '%Y-%m-%d') END AS shown, strftime(d, '%Y-%m-%d') AS iso FROM d"""

QUERIES = {f.__name__: f for f in (scene_labels, prominent, folder_usage, shuffled_rounds, pull_in_plan, event_slides, tag_changes, card_verdict, double_places, shown_dates)}
ORACLES = {"scene_labels": SCENES, "prominent": PROMINENT, "folder_usage": USAGE, "shuffled_rounds": SHUFFLED, "pull_in_plan": PULL, "event_slides": SLIDES, "tag_changes": TAGS, "card_verdict": CARD, "double_places": DOUBLE, "shown_dates": SHOWN}
