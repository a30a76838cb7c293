"""Queries on ordered rows: dates, gaps, runs, sessions, pace, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions import dates
from loomline.operators import temporal
from loomline.sources.shared import read

HOUR_US = 3_600_000_000
#: The moment that library statistics are as of; never the clock.
NOW = "1998-08-02"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in microseconds and their place per user."""
    rows = read(spark, sf_dir, "events").withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return temporal.positions(rows, ["user_id"], ["ts", "event_id"])


_EVENTS = """ev AS (
    SELECT event_id, user_id, event_type, epoch_us(ts) AS at_us, ts, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
    FROM events
)"""


def pace_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3, PRJ8, WIN4: gap-capped activity and rate per user."""
    return temporal.pace(events(spark, sf_dir), ["user_id"], "at_us", "event_id", cap_s=6 * 3600)


PACE = f"""WITH {_EVENTS}, g AS (SELECT user_id, at_us - lag(at_us) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS gap FROM ev),
s AS (SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN gap IS NULL THEN 0 ELSE least(gap, 21600000000) END) AS BIGINT) AS active_us FROM g GROUP BY user_id)
SELECT user_id, n, active_us, CASE WHEN n >= 2 AND active_us >= 300000000 THEN (n - 1) / (active_us / CAST(3.6e9 AS DOUBLE)) END AS rate FROM s"""


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    precision = F.when(F.col("event_type") == "signup", (F.col("event_id") % 3 + 1).cast("int"))
    start = F.when(precision == 1, F.trunc(F.col("ts"), "year")).when(precision == 2, F.trunc(F.col("ts"), "month")).when(precision == 3, F.to_date("ts"))
    return rows.withColumn("own_precision", precision).withColumn("own_us", F.unix_micros(start.cast("timestamp"))).withColumn("tray_us", F.when(F.col("user_id") % 2 == 0, F.lit(1_577_836_800_000_000))).withColumn("tray_precision", F.lit(1))


def date_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1, WIN2, JN8, DAT1: every event's date from its own, those on both sides, one side or the group's."""
    found = temporal.interpolate_dates(_dated(spark, sf_dir), ["user_id"], "pos", "own_us", "own_precision", "tray_us", "tray_precision")
    shown = dates.format_date(F.timestamp_micros("at_est").cast("date"), F.col("precision_est"))
    return found.select("event_id", "user_id", "pos", "source", "precision_est", shown.alias("date"))


INTERPOLATE = f"""WITH {_EVENTS}, d AS (
    SELECT *, CASE WHEN event_type = 'signup' THEN CAST(event_id % 3 + 1 AS INTEGER) END AS p,
        CASE WHEN event_type <> 'signup' THEN NULL WHEN event_id % 3 = 0 THEN epoch_us(date_trunc('year', ts)) WHEN event_id % 3 = 1 THEN epoch_us(date_trunc('month', ts)) ELSE epoch_us(date_trunc('day', ts)) END AS t
    FROM ev
), n AS (
    SELECT *, last_value(CASE WHEN t IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pb, last_value(t IGNORE NULLS) OVER b AS tb, last_value(p IGNORE NULLS) OVER b AS kb,
        first_value(CASE WHEN t IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS pa, first_value(t IGNORE NULLS) OVER a AS ta, first_value(p IGNORE NULLS) OVER a AS ka
    FROM d WINDOW b AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), e AS (
    SELECT event_id, user_id, pos,
        CASE WHEN t IS NOT NULL THEN 'own' WHEN tb IS NOT NULL AND ta IS NOT NULL THEN 'between' WHEN tb IS NOT NULL OR ta IS NOT NULL THEN 'near' WHEN user_id % 2 = 0 THEN 'tray' ELSE 'none' END AS source,
        CASE WHEN t IS NOT NULL THEN t WHEN tb IS NOT NULL AND ta IS NOT NULL THEN tb + CAST(floor(CAST(ta - tb AS DOUBLE) * (pos - pb) / (pa - pb)) AS BIGINT)
            WHEN tb IS NOT NULL OR ta IS NOT NULL THEN coalesce(tb, ta) WHEN user_id % 2 = 0 THEN 1577836800000000 END AS at_est,
        CASE WHEN t IS NOT NULL THEN p WHEN tb IS NOT NULL AND ta IS NOT NULL THEN least(kb, ka) WHEN tb IS NOT NULL OR ta IS NOT NULL THEN coalesce(kb, ka) WHEN user_id % 2 = 0 THEN 1 END AS precision_est
    FROM n
)
SELECT event_id, user_id, pos, source, CAST(precision_est AS INTEGER) AS precision_est, CASE precision_est WHEN 1 THEN strftime(make_timestamp(at_est), '%Y') WHEN 2 THEN strftime(make_timestamp(at_est), '%Y-%m') WHEN 3 THEN strftime(make_timestamp(at_est), '%Y-%m-%d') END AS date FROM e"""


def date_same_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN9, CLS3: nearest dated rows of the same class on either side."""
    rows = events(spark, sf_dir).withColumn("class", F.col("k") % 4).withColumn("own", F.when(F.col("event_type") == "signup", F.col("at_us")))
    return temporal.same_class_dates(rows, ["user_id"], "class", "pos", "own").select("event_id", "class", "before_at", "after_at")


SAME_CLASS = f"""WITH {_EVENTS}, d AS (SELECT *, k % 4 AS class, CASE WHEN event_type = 'signup' THEN at_us END AS own FROM ev)
SELECT event_id, class, last_value(own IGNORE NULLS) OVER (PARTITION BY user_id, class ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_at,
    first_value(own IGNORE NULLS) OVER (PARTITION BY user_id, class ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_at FROM d"""


def gap_fill_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN3, FLT8: what both valued neighbours agree on."""
    rows = events(spark, sf_dir).withColumn("place", F.when(F.col("k") % 3 == 0, F.col("event_type"))).withColumn("skip", F.col("event_id") % 7 == 0)
    return temporal.fill_between_equal(rows, ["user_id"], "pos", "place", F.col("skip")).select("event_id", "place", "filled")


GAP_FILL = f"""WITH {_EVENTS}, d AS (SELECT *, CASE WHEN k % 3 = 0 THEN event_type END AS place, event_id % 7 = 0 AS skip FROM ev), v AS (SELECT *, CASE WHEN NOT skip THEN place END AS q FROM d),
n AS (SELECT *, last_value(q IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(q IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM v)
SELECT event_id, place, CASE WHEN place IS NULL AND NOT skip AND b = a THEN b END AS filled FROM n"""


def edit_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN9: undo steps of each user, edits of one type within six hours joined, the newest sixty kept."""
    rows = events(spark, sf_dir).withColumn("kind", F.when(F.col("k") % 10 != 0, F.col("event_type")))
    return temporal.coalesced_edits(rows, ["user_id"], "kind", "at_us", "event_id", 6 * HOUR_US).select("user_id", "step", "kind", "n", "first_at", "last_at")


EDITS = f"""WITH {_EVENTS}, d AS (SELECT *, CASE WHEN k % 10 <> 0 THEN event_type END AS kind FROM ev),
f AS (SELECT *, CASE WHEN kind = lag(kind) OVER w AND at_us - lag(at_us) OVER w <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM d WINDOW w AS (PARTITION BY user_id ORDER BY at_us, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS step FROM f),
g AS (SELECT user_id, step, any_value(kind) AS kind, count(*) AS n, min(at_us) AS first_at, max(at_us) AS last_at FROM s GROUP BY user_id, step)
SELECT user_id, CAST(step AS BIGINT) AS step, kind, n, first_at, last_at FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY step DESC) <= 60"""


def year_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN12: runs of orders of one year in the order of their keys."""
    rows = read(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    found = temporal.runs(rows, ["o_custkey"], ["o_orderkey"], "year")
    return found.groupBy("o_custkey", "run").agg(F.min("year").alias("year"), F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


YEAR_RUNS = """WITH y AS (SELECT o_custkey, o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders),
c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR year = lag(year) OVER w THEN 0 ELSE 1 END AS ch FROM y WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
r AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c)
SELECT o_custkey, run, min(year) AS year, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM r GROUP BY o_custkey, run"""


def turn_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1, WIN8, WIN13: turns numbered and stamped a minute apart from noon, the first of equal texts marked."""
    rows = temporal.positions(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"])
    first = F.row_number().over(W.partitionBy("conv_id", "text").orderBy("pos")) == 1
    return temporal.runs(rows, ["conv_id"], ["pos"], "role").select("conv_id", "turn", "pos", "run", F.date_format(F.timestamp_seconds(F.lit(1577880000) + F.col("pos") * 60), "yyyy-MM-dd HH:mm:ss").alias("stamp"), first.alias("first_of_text"))


TURN_RUNS = """WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM conversations),
c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR role IS NOT DISTINCT FROM lag(role) OVER w THEN 0 ELSE 1 END AS ch FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY pos))
SELECT conv_id, turn, pos, CAST(sum(ch) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run, strftime(make_timestamp((1577880000 + pos * 60) * 1000000), '%Y-%m-%d %H:%M:%S') AS stamp,
    row_number() OVER (PARTITION BY conv_id, text ORDER BY pos) = 1 AS first_of_text FROM c"""


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    return o.groupBy("o_custkey").agg(
        F.count("*").alias("slides"), F.count_if(status == "F").alias("uploaded"), F.count_if(status == "P").alias("skipped"), F.count_if(status == "O").alias("pending"),
        F.count_if((status == "F") | (status == "P")).alias("reviewed"), F.sort_array(F.collect_set("o_orderpriority")).alias("sources"),
    )


def collection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1, PRJ2: conditional counts per collection and its sorted distinct sources."""
    return _collections(spark, sf_dir).withColumn("sources", F.array_join("sources", "|"))


SUMMARY = """SELECT o_custkey, count(*) AS slides, count(*) FILTER (o_orderstatus = 'F') AS uploaded, count(*) FILTER (o_orderstatus = 'P') AS skipped, count(*) FILTER (o_orderstatus = 'O') AS pending,
    count(*) FILTER (o_orderstatus IN ('F', 'P')) AS reviewed, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS sources FROM orders GROUP BY o_custkey"""


def library_rollup(spark: SparkSession, sf_dir: str, target: int = 1_000_000, days: int = 14) -> DataFrame:
    """AGG2, AGG23, DAT6: totals of the library, its recent pace and what is left."""
    now = F.lit(NOW).cast("date")
    totals = _collections(spark, sf_dir).agg(F.count("*").alias("trays"), F.sum("slides").alias("slides"), F.sum("uploaded").alias("uploaded"), F.sum("skipped").alias("skipped"), F.sum("pending").alias("pending"), F.count_if((F.col("slides") > 0) & (F.col("uploaded") + F.col("skipped") >= F.col("slides"))).alias("finished"))
    day = F.to_date("o_orderdate")
    recent = read(spark, sf_dir, "orders").agg(F.count_if((day > F.date_sub(now, days)) & (day <= now)).alias("n_recent"), F.min(F.when((day > F.date_sub(now, days)) & (day <= now), day)).alias("first_recent"), F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year"))
    both = totals.crossJoin(F.broadcast(recent))
    done = F.col("uploaded") + F.col("skipped")
    per_day = F.col("n_recent") / F.least(F.lit(days), F.greatest(F.lit(1), F.coalesce(F.date_diff(now, F.col("first_recent")), F.lit(1))))
    return both.select("trays", "slides", "uploaded", "skipped", "pending", "finished", F.greatest(F.lit(target) - done, F.lit(0)).cast("long").alias("remaining"), F.round(per_day, 6).alias("per_day"), "first_year", "last_year", F.greatest(F.round((F.lit(target) - F.col("slides")) / (F.col("slides") / F.col("trays"))), F.lit(0.0)).cast("long").alias("trays_to_scan"))


ROLLUP = f"""WITH t AS (SELECT o_custkey, count(*) AS slides, count(*) FILTER (o_orderstatus = 'F') AS uploaded, count(*) FILTER (o_orderstatus = 'P') AS skipped, count(*) FILTER (o_orderstatus = 'O') AS pending FROM orders GROUP BY o_custkey),
s AS (SELECT count(*) AS trays, CAST(sum(slides) AS BIGINT) AS slides, CAST(sum(uploaded) AS BIGINT) AS uploaded, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(pending) AS BIGINT) AS pending, count(*) FILTER (slides > 0 AND uploaded + skipped >= slides) AS finished FROM t),
r AS (SELECT count(*) FILTER (d > DATE '{NOW}' - 14 AND d <= DATE '{NOW}') AS n_recent, min(CASE WHEN d > DATE '{NOW}' - 14 AND d <= DATE '{NOW}' THEN d END) AS first_recent, CAST(min(year(d)) AS INTEGER) AS first_year, CAST(max(year(d)) AS INTEGER) AS last_year FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders))
SELECT trays, slides, uploaded, skipped, pending, finished, CAST(greatest(1000000 - (uploaded + skipped), 0) AS BIGINT) AS remaining, round(CAST(n_recent AS DOUBLE) / least(14, greatest(1, coalesce(DATE '{NOW}' - first_recent, 1))), 6) AS per_day, first_year, last_year,
    CAST(greatest(round((1000000 - slides) / (CAST(slides AS DOUBLE) / trays)), 0) AS BIGINT) AS trays_to_scan FROM s, r"""


def rollup_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roll-up over region and nation (an addition of ours)."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    both = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return both.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


HIERARCHY = "SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"


def recent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7, SRT8: the newest twenty entries of each owner."""
    return temporal.keep_last(events(spark, sf_dir), ["user_id"], [F.desc("at_us"), F.desc("event_id")], 20).select("user_id", "event_id", "at_us")


RECENT_LOG = f"WITH {_EVENTS} SELECT user_id, event_id, at_us FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY at_us DESC, event_id DESC) <= 20"


def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM6: sessions by a gap of six hours, in Spark's own session windows."""
    rows = events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    found = rows.groupBy("user_id", F.session_window("at", "6 hours").alias("s")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select("user_id", F.unix_micros("s.start").alias("start_us"), (F.unix_micros("s.end") - 6 * HOUR_US).alias("last_us"), "n", "total")


SESSIONS = f"""WITH {_EVENTS}, f AS (SELECT *, CASE WHEN at_us - lag(at_us) OVER w < 21600000000 THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY at_us, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT user_id, min(at_us) AS start_us, max(at_us) AS last_us, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, g"""

QUERIES = {f.__name__: f for f in (pace_per_user, date_interpolate, date_same_class, gap_fill_same, edit_sessions, year_runs, turn_runs, collection_summary, library_rollup, rollup_hierarchy, recent_log, activity_sessions)}
ORACLES = {
    "pace_per_user": PACE, "date_interpolate": INTERPOLATE, "date_same_class": SAME_CLASS, "gap_fill_same": GAP_FILL, "edit_sessions": EDITS, "year_runs": YEAR_RUNS, "turn_runs": TURN_RUNS,
    "collection_summary": SUMMARY, "library_rollup": ROLLUP, "rollup_hierarchy": HIERARCHY, "recent_log": RECENT_LOG, "activity_sessions": SESSIONS,
}
