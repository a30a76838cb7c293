"""Further queries: robust lines, mean curves, dates of a class, precedence, the whole row of a slide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions import checks
from loomline.operators import lifecycle, neighbours, robust
from loomline.plans.estimates import _features, _NEAREST
from loomline.plans.ordered import _EVENTS, date_same_class, events
from loomline.sources.shared import read


def robust_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH15: a line through each supplier's prices by quantity, outliers left out in four rounds."""
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"))
    return robust.robust_line(rows, ["l_suppkey"], "l_quantity", "price").select("l_suppkey", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")


def _line_sql(rounds: int = 4) -> str:
    out = "WITH p0 AS (SELECT l_suppkey AS k, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)"
    for i in range(rounds):
        out += f", f{i} AS (SELECT k, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, count(*) AS n FROM p{i} GROUP BY k)"
        if i < rounds - 1:
            out += f", r{i} AS (SELECT k, x, y, abs(y - i - s * x) AS r FROM p{i} JOIN f{i} USING (k)), m{i} AS (SELECT k, quantile_cont(r, 0.5) AS m FROM r{i} GROUP BY k), p{i + 1} AS (SELECT k, x, y FROM r{i} JOIN m{i} USING (k) WHERE r <= greatest(0.5, 3 * CAST(1.4826 AS DOUBLE) * m))"
    return out + f" SELECT k AS l_suppkey, round(s, 6) AS slope, round(i, 6) AS intercept, n FROM f{rounds - 1}"


def mean_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KNN2, MTH13: mean tone curves of the nearest examples, smooth ones; an example without a curve counts as the straight line."""
    k = F.col("example_id")
    point = lambda x, y: F.struct(F.lit(x).alias("x"), y.cast("double").alias("y"))
    curve = F.array(point(0.0, k % 3 / 10.0), point(0.5, 0.4 + k % 5 / 20.0), point(1.0, F.lit(1.0)))
    rows = _features(spark, sf_dir)
    examples = rows.select(F.col("vec_id").alias("example_id"), "f").withColumn("curves", F.map_filter(F.create_map(F.lit("all"), curve, F.lit("red"), F.when(k % 2 == 0, curve)), lambda n, v: v.isNotNull()))
    found = neighbours.nearest(rows.where("vec_id % 100 = 0").select("vec_id", "f"), examples, "vec_id", "example_id", "f", others=True)
    means = neighbours.average_curves(found, "vec_id", "curves", 1 / (F.col("distance") + neighbours.SOFTEN))
    return means.select("vec_id", "channel", F.round(F.element_at("curve", 1), 6).alias("low"), F.round(F.element_at("curve", 4), 6).alias("mid"), F.round(F.element_at("curve", 9), 6).alias("high"))


CURVES = f"""{_NEAREST}, w AS (SELECT q, vec_id AS e, 1 / (distance + CAST(0.25 AS DOUBLE)) AS w, CAST(vec_id % 3 AS DOUBLE) / 10 AS y0, CAST(0.4 AS DOUBLE) + CAST(vec_id % 5 AS DOUBLE) / 20 AS y5 FROM k),
g AS (SELECT *, (y5 - y0) * 2 AS d0, (1 - y5) * 2 AS d1 FROM w), h AS (SELECT *, CASE WHEN d0 * d1 <= 0 THEN 0 ELSE (d0 + d1) / 2 END AS m FROM g),
l AS (SELECT *, CASE WHEN d0 = 0 THEN 0 WHEN 1 + (m / d0) * (m / d0) > 9 THEN 3 / sqrt(1 + (m / d0) * (m / d0)) ELSE 1 END AS f FROM h),
s AS (SELECT *, CAST(0.15625 AS DOUBLE) * y0 + CAST(0.046875 AS DOUBLE) / 2 * f * d0 + CAST(0.84375 AS DOUBLE) * y5 - CAST(0.140625 AS DOUBLE) / 2 * f * m AS y3 FROM l),
c AS (SELECT q, 'all' AS channel, w, y0, y3 FROM s UNION ALL SELECT q, 'red', w, y0, y3 FROM s WHERE e % 2 = 0), t AS (SELECT q, sum(w) AS t FROM w GROUP BY q)
SELECT q AS vec_id, channel, round(sum(w * y0) / t, 6) AS low, round((sum(w * y3) + (t - sum(w)) * CAST(0.375 AS DOUBLE)) / t, 6) AS mid, CAST(1 AS DOUBLE) AS high FROM c JOIN t USING (q) GROUP BY q, channel, t HAVING sum(w) >= 0.5 * t"""


def class_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS3, FLT3, PRJ9: date suggestions from rows of the same class, surer on both sides, inside the class's era."""
    eras = F.broadcast(spark.createDataFrame([(0, 2024, None), (1, 2020, 2023), (2, 2010, 2030)], "class int, from_year int, to_year int"))
    rows = date_same_class(spark, sf_dir).join(eras, "class")
    mid = F.when(F.col("before_at").isNotNull() & F.col("after_at").isNotNull(), F.floor((F.col("before_at") + F.col("after_at")) / 2)).otherwise(F.coalesce("before_at", "after_at"))
    year = F.year(F.timestamp_micros(mid.cast("long")))
    confidence = F.when(F.col("before_at").isNotNull() & F.col("after_at").isNotNull(), 0.6).otherwise(0.45)
    return rows.select("event_id", "class", year.alias("year"), confidence.alias("confidence"), "from_year", "to_year").where((F.col("year") >= F.col("from_year")) & (F.col("year") <= F.coalesce("to_year", F.lit(9999)))).select("event_id", "class", "year", "confidence")


CLASS_DATES = f"""WITH {_EVENTS}, d AS (SELECT *, k % 4 AS class, CASE WHEN event_type = 'signup' THEN at_us END AS own FROM ev),
n AS (SELECT event_id, class, last_value(own IGNORE NULLS) OVER (PARTITION BY user_id, class ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(own IGNORE NULLS) OVER (PARTITION BY user_id, class ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM d),
y AS (SELECT event_id, class, CAST(year(make_timestamp(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a + b) // 2 ELSE coalesce(b, a) END)) AS INTEGER) AS year, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.45 AS DOUBLE) END AS confidence FROM n)
SELECT event_id, y.class, year, confidence FROM y JOIN (VALUES (0, 2024, NULL), (1, 2020, 2023), (2, 2010, 2030)) e(class, f, t) ON y.class = e.class WHERE year BETWEEN f AND coalesce(t, 9999)"""


def kept_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG2: which place suggestion stands."""
    k = F.col("event_id")
    own, stored, live = F.when(k % 5 == 0, "own"), F.when(k % 3 != 0, F.concat(F.lit("s"), (k % 4).cast("string"))), F.when(k % 2 == 0, F.concat(F.lit("l"), (k % 7).cast("string")))
    state = F.when(k % 6 == 0, "accepted").when(k % 6 == 1, "dismissed").otherwise("suggested")
    return events(spark, sf_dir).select("event_id", lifecycle.place_to_keep(own, stored, live, state).alias("place"))


PLACES = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 6 < 2 THEN CASE WHEN event_id % 3 <> 0 THEN 's' || (event_id % 4) END ELSE coalesce(CASE WHEN event_id % 2 = 0 THEN 'l' || (event_id % 7) END, CASE WHEN event_id % 3 <> 0 THEN 's' || (event_id % 4) END) END AS place FROM events"


def slide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ3, JN3: every document with its label, its place in its source and what its source has, by joins on keys."""
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    sums = d.groupBy("source").agg(F.count("*").alias("in_source"), F.sum("n_chars").cast("long").alias("source_chars"))
    pos = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    return d.withColumn("pos", pos.cast("long")).join(lab, "doc_id", "left").join(sums, "source", "left").select("doc_id", "source", "pos", "quality", "toxic", "in_source", "source_chars")


ROWS = "WITH s AS (SELECT source, count(*) AS in_source, CAST(sum(n_chars) AS BIGINT) AS source_chars FROM documents GROUP BY source) SELECT doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY doc_id) - 1 AS pos, quality, toxic, in_source, source_chars FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN s ON s.source = d.source"


def filtered_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT4, FLT5, FLT12: people by what is known of them and by part of their name."""
    c = read(spark, sf_dir, "customer")
    n = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("seen"))
    rows = c.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    return rows.where((F.col("c_acctbal") >= 0) & ((F.col("seen") <= 1) | F.contains(F.lower("c_name"), F.lit("7")))).select("c_custkey", "c_name", "seen")


PEOPLE = "SELECT c_custkey, c_name, coalesce(n, 0) AS seen FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey WHERE c_acctbal >= 0 AND (coalesce(n, 0) <= 1 OR contains(lower(c_name), '7'))"


def clean_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL2, VAL4: curves ordered, held to their range and thinned."""
    k = F.col("p_partkey")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    curve = checks.clean_curve(F.array(point(k % 10 / 5.0 - 0.2, k % 7 / 5.0), point(k % 4 / 4.0, k % 3 / 3.0), point(F.lit(0.5), F.lit(0.5))))
    return read(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.size(curve), F.lit(0)).cast("int").alias("points"), F.round(F.element_at(curve, 1)["x"], 6).alias("first_x"), F.round(F.element_at(curve, -1)["y"], 6).alias("last_y"))


CLEAN = """WITH p AS (SELECT p_partkey, list_sort([{'x': greatest(least(CAST(p_partkey % 10 AS DOUBLE) / 5 - CAST(0.2 AS DOUBLE), 1), 0), 'y': greatest(least(CAST(p_partkey % 7 AS DOUBLE) / 5, 1), 0)}, {'x': CAST(p_partkey % 4 AS DOUBLE) / 4, 'y': CAST(p_partkey % 3 AS DOUBLE) / 3}, {'x': CAST(0.5 AS DOUBLE), 'y': CAST(0.5 AS DOUBLE)}]) AS ps FROM part),
k AS (SELECT p_partkey, list_reduce(list_transform(ps, lambda p: [p]), lambda held, p: CASE WHEN p[1].x - held[-1].x >= CAST(0.004 AS DOUBLE) THEN list_concat(held, p) ELSE held END) AS c FROM p),
g AS (SELECT p_partkey, CASE WHEN len(c) >= 2 AND len(list_filter(c, lambda p: abs(p.x - p.y) >= 1e-9)) > 0 THEN c END AS c FROM k)
SELECT p_partkey, CAST(coalesce(len(c), 0) AS INTEGER) AS points, round(c[1].x, 6) AS first_x, round(c[-1].y, 6) AS last_y FROM g"""

QUERIES = {f.__name__: f for f in (robust_line, mean_curves, class_dates, kept_places, slide_rows, filtered_people, clean_curves)}
ORACLES = {"clean_curves": CLEAN, "robust_line": _line_sql(), "mean_curves": CURVES, "class_dates": CLASS_DATES, "kept_places": PLACES, "slide_rows": ROWS, "filtered_people": PEOPLE}
