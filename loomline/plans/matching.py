"""Queries that match rows by content, time, overlap and company."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions.vectors import iou
from loomline.operators import matching, sequence
from loomline.sources.shared import read, stored


def cooccurrence_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14, SRT5: for each part the twelve parts most often on the same orders."""
    pairs = matching.cooccurrence(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "n").select("p.a", "p.b", "n")
    return both.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("n"), "b"))).where("r <= 12").select("a", "b", "n")


COOCCURRENCE = "WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), p AS (SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS n FROM l x JOIN l y ON x.l_orderkey = y.l_orderkey AND x.l_partkey <> y.l_partkey GROUP BY ALL) SELECT a, b, n FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) <= 12"


def dedupe_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN16, HSH2, WIN13: the first document of each content."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("sha1"))
    return matching.first_of_content(rows, F.col("sha1"), ["doc_id"])


DEDUPE = "SELECT min(doc_id) AS doc_id, sha1(text) AS sha1 FROM documents GROUP BY sha1(text)"


def new_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN16, SRC7: contents of the later documents that the earlier ones don't have."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("sha1"))
    return matching.new_content(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0"), "sha1", ["doc_id"]).select("doc_id", "sha1")


NEW = "SELECT min(doc_id) AS doc_id, sha1(text) AS sha1 FROM documents WHERE doc_id % 2 = 1 AND sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY sha1(text)"


def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN17, JN19, SET6: documents without a label."""
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")


UNLABELLED = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def orders_with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN15, JN18: orders some line of which came back."""
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


RETURNS = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"


def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG9, AGG22, JN1: the dearest order of each customer, the first of equals, with the customer's name."""
    best = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct(F.col("o_totalprice"), -F.col("o_orderkey"))).alias("b"), F.count("*").alias("n"))
    return best.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left").select("o_custkey", "c_name", F.col("b.o_orderkey").alias("o_orderkey"), F.col("b.o_totalprice").alias("o_totalprice"), "n")


BEST = "SELECT o_custkey, c_name, o_orderkey, o_totalprice, n FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) LEFT JOIN customer ON c_custkey = o_custkey"


def interval_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN20: for each supplier a window of days, and the orders placed in it."""
    windows = read(spark, sf_dir, "supplier").select("s_suppkey", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") * 7 % 700).cast("int")).alias("lo")).withColumn("hi", F.date_add("lo", 40))
    points = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return matching.interval_totals(points, "day", "o_orderkey", windows, "s_suppkey", "lo", "hi").select("s_suppkey", "n", F.col("first").alias("first_key"))


INTERVAL = "WITH w AS (SELECT s_suppkey, DATE '1995-01-01' + CAST(s_suppkey * 7 % 700 AS INTEGER) AS lo FROM supplier) SELECT s_suppkey, count(*) AS n, min(o_orderkey) AS first_key FROM w JOIN orders ON CAST(o_orderdate AS DATE) >= lo AND CAST(o_orderdate AS DATE) < lo + 40 GROUP BY s_suppkey"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    left, top = (k * 37 % 50) / 100.0, (k * 53 % 50) / 100.0
    return read(spark, sf_dir, "part").select("p_partkey", F.floor(k / 10).alias("asset"), (k % 2).alias("side"), left.alias("l"), top.alias("t"), (left + 0.3 + F.col("p_size") / 200.0).alias("r"), (top + 0.4).alias("b"))


_BOXES = "x AS (SELECT p_partkey, p_partkey // 10 AS asset, p_partkey % 2 AS side, CAST(p_partkey * 37 % 50 AS DOUBLE) / 100 AS l, CAST(p_partkey * 53 % 50 AS DOUBLE) / 100 AS t, CAST(p_partkey * 37 % 50 AS DOUBLE) / 100 + CAST(0.3 AS DOUBLE) + CAST(p_size AS DOUBLE) / 200 AS r, CAST(p_partkey * 53 % 50 AS DOUBLE) / 100 + CAST(0.4 AS DOUBLE) AS b FROM part)"


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir)
    one, two = rows.where("side = 0").alias("x"), rows.where("side = 1").alias("y")
    both = one.join(two, F.expr("x.asset = y.asset"))
    return both.select(F.col("x.asset").alias("asset"), F.col("x.p_partkey").alias("one"), F.col("y.p_partkey").alias("two"), iou([F.col(f"x.{c}") for c in "ltrb"], [F.col(f"y.{c}") for c in "ltrb"]).alias("iou"))


def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13, MTH4: boxes of two sides on one asset that overlap by three tenths."""
    return _overlaps(spark, sf_dir).where("iou >= 0.3").select("asset", "one", "two", F.round("iou", 9).alias("iou"))


OVERLAPS = f"WITH {_BOXES}, p AS (SELECT a.asset, a.p_partkey AS one, c.p_partkey AS two, greatest(least(a.r, c.r) - greatest(a.l, c.l), 0) * greatest(least(a.b, c.b) - greatest(a.t, c.t), 0) AS i, (a.r - a.l) * (a.b - a.t) + (c.r - c.l) * (c.b - c.t) AS s FROM x a JOIN x c ON a.asset = c.asset AND a.side = 0 AND c.side = 1) SELECT asset, one, two, round(i / (s - i), 9) AS iou FROM p WHERE i / (s - i) >= 0.3"


def box_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAT1: one-to-one matches of these boxes, the best first."""
    return sequence.greedy_pairs(_overlaps(spark, sf_dir), "asset", "one", "two", F.col("iou"))


MATCHES = f"""WITH RECURSIVE {_BOXES}, o AS (SELECT a.asset, a.p_partkey AS one, c.p_partkey AS two, greatest(least(a.r, c.r) - greatest(a.l, c.l), 0) * greatest(least(a.b, c.b) - greatest(a.t, c.t), 0) AS i, (a.r - a.l) * (a.b - a.t) + (c.r - c.l) * (c.b - c.t) AS s FROM x a JOIN x c ON a.asset = c.asset AND a.side = 0 AND c.side = 1),
p AS (SELECT asset, one, two, i / (s - i) AS score, row_number() OVER (PARTITION BY asset ORDER BY i / (s - i) DESC, one, two) AS k FROM o WHERE i / (s - i) >= 0.3),
r AS (SELECT asset, one, two, score, k, true AS took, [one] AS ones, [two] AS twos FROM p WHERE k = 1
    UNION ALL SELECT asset, one, two, score, k, free, CASE WHEN free THEN list_append(ones, one) ELSE ones END, CASE WHEN free THEN list_append(twos, two) ELSE twos END FROM (SELECT p.*, r.ones, r.twos, NOT list_contains(r.ones, p.one) AND NOT list_contains(r.twos, p.two) AS free FROM r JOIN p ON p.asset = r.asset AND p.k = r.k + 1))
SELECT asset, one, two, score FROM r WHERE took"""


def two_way_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN24: how often two sides meet, seen from both."""
    return matching.votes(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus").select("o_orderpriority", "o_orderstatus", "n", "of_a", "of_b")


VOTES = "WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderpriority, o_orderstatus, n, CAST(sum(n) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS of_a, CAST(sum(n) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS of_b FROM c"


def new_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN23, WIN10: within twelve places, the nearest item of each set of members that brings a new one."""
    k = F.col("vec_id")
    sets = F.sort_array(F.array_distinct(F.filter(F.array(k % 5, k % 3, F.when(k % 4 == 0, k % 7)), lambda x: x.isNotNull())))
    rows = read(spark, sf_dir, "embeddings").select(F.floor(k / 50).alias("tray"), k.alias("pos"), "vec_id", sets.alias("people"))
    return matching.neighbours_with_new_sets(rows, "tray", "pos", "vec_id", "people")


COMPANY = """WITH e AS (SELECT vec_id, vec_id // 50 AS tray, list_sort(list_distinct(list_filter([vec_id % 5, vec_id % 3, CASE WHEN vec_id % 4 = 0 THEN vec_id % 7 END], lambda x: x IS NOT NULL))) AS s FROM embeddings)
SELECT a.vec_id, b.vec_id AS near, abs(a.vec_id - b.vec_id) AS dist FROM e a JOIN e b ON a.tray = b.tray AND a.vec_id <> b.vec_id AND abs(a.vec_id - b.vec_id) <= 12 AND NOT list_has_all(a.s, b.s)
QUALIFY row_number() OVER (PARTITION BY a.vec_id, b.s ORDER BY abs(a.vec_id - b.vec_id), b.vec_id) = 1"""


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("c_custkey", "c_name").agg(F.count_distinct("o_orderkey").alias("n"), F.min(F.to_date("o_orderdate")).alias("first_day"), F.max(F.to_date("o_orderdate")).alias("last_day"))


CARDS = "WITH c AS (SELECT c_custkey, c_name, count(DISTINCT o_orderkey) AS n, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY first_day ASC NULLS LAST, c_custkey) AS place FROM c"


def person_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG24, SRT6: the cards of all persons. Places count within a range of the order, after those of the ranges before."""
    order = [F.asc_nulls_last("first_day"), F.col("c_custkey")]
    ranged = stored(_cards(spark, sf_dir).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "cards")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_d"))
    before = sizes.select("_p", (F.sum("_d").over(W.orderBy("_p")) - F.col("_d")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_n", within).join(F.broadcast(before), "_p").select("c_custkey", "c_name", "n", "first_day", "last_day", (F.col("_before") + F.col("_n")).alias("place"))


def piles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11, AGG12: open suggestions of one kind and value with their mean confidence; in a kind the biggest pile first, then by name."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    found = rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("confidence"))
    return found.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "source")).cast("long"))


PILES = "SELECT lang, source, count(*) AS n, round(avg(quality), 6) AS confidence, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS place FROM documents JOIN labels USING (doc_id) GROUP BY lang, source"

QUERIES = {f.__name__: f for f in (cooccurrence_top, dedupe_content, new_content, unlabelled, orders_with_returns, best_per_group, interval_window, box_overlaps, box_matches, two_way_votes, new_company, person_cards, piles)}
ORACLES = {"cooccurrence_top": COOCCURRENCE, "dedupe_content": DEDUPE, "new_content": NEW, "unlabelled": UNLABELLED, "orders_with_returns": RETURNS, "best_per_group": BEST, "interval_window": INTERVAL, "box_overlaps": OVERLAPS, "box_matches": MATCHES, "two_way_votes": VOTES, "new_company": COMPANY, "person_cards": CARDS, "piles": PILES}
