"""Queries with robust estimators, votes, thresholds and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions import dates, vectors
from loomline.operators import neighbours, robust, temporal
from loomline.sources.shared import read


def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4: weighted median of the quantities of each supplier."""
    weight = 1 + (F.col("l_linenumber") % 4) * 0.25
    return robust.weighted_median(read(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_quantity"), weight)


def _median_sql(source: str, key: str, value: str, weight: str, name: str) -> str:
    """CTEs that give the weighted median per key (an expression)."""
    return f"""{name}_s AS (SELECT {key} AS k, {value} AS v, sum({weight}) AS w FROM {source} GROUP BY ALL),
    {name}_c AS (SELECT k, v, sum(w) OVER (PARTITION BY k ORDER BY v ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY k) AS t, lead(v) OVER (PARTITION BY k ORDER BY v) AS nx FROM {name}_s),
    {name} AS (SELECT k, CASE WHEN c > t / 2 + 1e-9 THEN v ELSE (v + coalesce(nx, v)) / 2 END AS m FROM {name}_c WHERE c >= t / 2 - 1e-9 QUALIFY row_number() OVER (PARTITION BY k ORDER BY v) = 1)"""


MEDIAN = f"WITH {_median_sql('lineitem', 'l_suppkey', 'l_quantity', 'CAST(1 + (l_linenumber % 4) * 0.25 AS DOUBLE)', 'm')} SELECT k AS l_suppkey, m AS median FROM m"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("guess"), F.floor(F.col("l_extendedprice") / 1000).cast("double").alias("real"), F.when(F.col("l_linenumber") % 2 == 0, 0.5).otherwise(1.0).alias("weight"))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5, EST4: common and personal corrections of guesses and the spread left."""
    common, own = robust.calibrate(_samples(spark, sf_dir), "l_suppkey", "guess", "real", "weight")
    return own.crossJoin(F.broadcast(common)).select("l_suppkey", *[F.round(c, 9).alias(c) for c in ("own", "bias", "sigma")], "n")


CALIBRATION = f"""WITH r AS (SELECT l_suppkey AS p, ln(1 + greatest(floor(l_extendedprice / 1000), 0)) - ln(1 + greatest(l_quantity, 0)) AS x, CASE WHEN l_linenumber % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS w FROM lineitem),
{_median_sql('r', 'p', 'x', 'w', 'pm')},
wt AS (SELECT p, sum(w) AS wp, count(*) AS np FROM r GROUP BY p),
m1 AS (SELECT p, m, least(wp, CAST(1 AS DOUBLE)) AS w1 FROM pm JOIN wt ON k = p),
{_median_sql('m1', '0', 'm', 'w1', 'bm')},
b AS (SELECT m * kk / (kk + 3) AS bias, ww, nn FROM bm, (SELECT sum(least(wp, CAST(1 AS DOUBLE))) AS kk, sum(wp) AS ww, sum(np) AS nn FROM wt)),
sh AS (SELECT p, x - bias AS y, w, x FROM r, b),
{_median_sql('sh', 'p', 'y', 'w', 'om')},
o AS (SELECT p, m * wp / (wp + 4) AS own FROM om JOIN wt ON k = p),
d AS (SELECT abs(y - own) AS d, w FROM sh JOIN o USING (p)),
{_median_sql('d', '0', 'd', 'w', 'dm')}
SELECT o.p AS l_suppkey, round(own, 9) AS own, round(bias, 9) AS bias, round(sqrt((ww * pow(1.4826 * m, 2) + 3 * 0.04) / (ww + 3)), 9) AS sigma, CAST(nn AS BIGINT) AS n FROM o, b, dm"""


def age_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH7: guesses corrected in log space."""
    a = vectors.corrected_age(F.col("p_size").cast("double"), F.lit(-0.1), F.when(F.col("p_partkey") % 3 == 0, 0.05), F.lit(0.2))
    return read(spark, sf_dir, "part").select("p_partkey", F.round(a["age"], 9).alias("age"), F.round(a["sd"], 9).alias("sd"))


AGE = """WITH a AS (SELECT p_partkey, exp(ln(1 + CAST(p_size AS DOUBLE)) - CAST(0.1 AS DOUBLE) + CASE WHEN p_partkey % 3 = 0 THEN CAST(0.05 AS DOUBLE) ELSE 0 END) - 1 AS x FROM part)
SELECT p_partkey, round(greatest(x, 0), 9) AS age, round(greatest(CAST(0.5 AS DOUBLE), CAST(0.2 AS DOUBLE) * (1 + x)), 9) AS sd FROM a"""


def inverse_variance_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6: the mean of each order's quantities weighted by their certainty."""
    v, sd = robust.inverse_variance(F.col("l_quantity"), F.col("l_tax") + 0.5)
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(v, 9).alias("v"), F.round(sd, 9).alias("sd"))


IVW = "SELECT l_orderkey, round(sum(l_quantity / ((l_tax + 0.5) * (l_tax + 0.5))) / sum(1 / ((l_tax + 0.5) * (l_tax + 0.5))), 9) AS v, round(sqrt(1 / sum(1 / ((l_tax + 0.5) * (l_tax + 0.5)))), 9) AS sd FROM lineitem GROUP BY l_orderkey"


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7, EST1: what the largest agreeing set of an order's values says."""
    rows = temporal.positions(read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).withColumn("sd", F.col("l_tax") * 20 + 2)
    return robust.consensus(rows, ["l_orderkey"], "pos", "l_quantity", "sd").select("l_orderkey", F.round("v", 9).alias("v"), F.round("sd", 9).alias("sd"), "n", F.array_join("members", ",").alias("members"))


CONSENSUS = """WITH x AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS o, l_quantity AS v, l_tax * 20 + 2 AS s FROM lineitem),
f AS (SELECT a.k, a.o AS ao, a.s AS sa, b.o, b.v, b.s FROM x a JOIN x b ON a.k = b.k AND abs(a.v - b.v) <= CAST(2.5 AS DOUBLE) * sqrt(a.s * a.s + b.s * b.s)),
c AS (SELECT k, ao, any_value(sa) AS sa, count(*) AS n FROM f GROUP BY k, ao),
best AS (SELECT k, ao FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, sa, ao) = 1)
SELECT k AS l_orderkey, round(sum(v / (s * s)) / sum(1 / (s * s)), 9) AS v, round(sqrt(1 / sum(1 / (s * s))), 9) AS sd, count(*) AS n, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS members FROM f JOIN best USING (k, ao) GROUP BY k"""


def date_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT2, DAT3, DAT4: middle and deviation of partial dates, and their windows a day wider."""
    rows = read(spark, sf_dir, "orders").withColumn("p", (F.col("o_orderkey") % 3 + 1).cast("int")).withColumn("d", F.to_date("o_orderdate"))
    start = F.when(F.col("p") == 1, F.trunc("d", "year")).when(F.col("p") == 2, F.trunc("d", "month")).otherwise(F.col("d"))
    s, w = dates.span(start, F.col("p")), dates.window_of(start, F.col("p"))
    return rows.select("o_orderkey", F.round(s["v"], 6).alias("v"), F.round(s["sd"], 6).alias("sd"), w["lo"].alias("lo"), w["hi"].alias("hi"))


SPANS = """WITH d AS (SELECT o_orderkey, CAST(o_orderkey % 3 + 1 AS INTEGER) AS p, CAST(o_orderdate AS DATE) AS d FROM orders),
s AS (SELECT o_orderkey, p, CAST(CASE p WHEN 1 THEN date_trunc('year', d) WHEN 2 THEN date_trunc('month', d) ELSE d END AS DATE) AS st FROM d),
w AS (SELECT *, CASE p WHEN 1 THEN CAST(1 AS DOUBLE) WHEN 2 THEN CAST(1 AS DOUBLE) / 12 ELSE CAST(1 AS DOUBLE) / 365 END AS wd, CASE WHEN year(st) % 4 = 0 AND (year(st) % 100 <> 0 OR year(st) % 400 = 0) THEN CAST(366 AS DOUBLE) ELSE CAST(365 AS DOUBLE) END AS yl FROM s)
SELECT o_orderkey, round(year(st) + (dayofyear(st) - 1) / yl + wd / 2, 6) AS v, round(wd / sqrt(CAST(12 AS DOUBLE)), 6) AS sd, st - 1 AS lo,
    CAST(CASE p WHEN 1 THEN st + INTERVAL 1 YEAR WHEN 2 THEN st + INTERVAL 1 MONTH ELSE st + INTERVAL 1 DAY END AS DATE) + 1 AS hi FROM w"""


def threshold_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH12, AGG25: how feedback on each source moves its threshold."""
    both = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    counts = both.groupBy("source").agg(F.sum("quality").cast("long").alias("accepted"), F.sum("toxic").cast("long").alias("dismissed"))
    return counts.withColumn("threshold", F.round(vectors.learned_threshold(F.col("accepted"), F.col("dismissed") * 9), 9))


FEEDBACK = "SELECT source, CAST(sum(quality) AS BIGINT) AS accepted, CAST(sum(toxic) AS BIGINT) AS dismissed, round(0.12 * least(greatest(CAST(1 + sum(toxic) * 9 AS DOUBLE) / (1 + sum(quality)), 1), 4), 9) AS threshold FROM labels JOIN documents USING (doc_id) GROUP BY source"


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13, JN24: the priority that two thirds of a customer's orders share, two at least."""
    counts = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("total", F.sum("n").over(W.partitionBy("o_custkey"))).withColumn("r", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("n"), "o_orderstatus")))
    return ranked.where("r = 1 AND n >= 2 AND n * 3 >= total * 2").select("o_custkey", "o_orderstatus", "n", "total")


MAJORITY = "WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, o_orderstatus, n, CAST(total AS BIGINT) AS total FROM (SELECT *, sum(n) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus) AS r FROM c) WHERE r = 1 AND n >= 2 AND n * 3 >= total * 2"


def pure_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14: customers all of whose orders, two at least, have one status."""
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("status"), F.max("o_orderstatus").alias("other"), F.count("*").alias("n")).where("status = other AND n >= 2").select("o_custkey", "status", "n")


PURE = "SELECT o_custkey, min(o_orderstatus) AS status, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1 AND count(*) >= 2"


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG8, AGG20: exact percentiles by linear interpolation."""
    at = {f"p{int(c * 1000)}": c for c in (0.004, 0.01, 0.05, 0.5, 0.95, 0.99, 0.996)}
    found = robust.percentiles(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", at)
    return found.select("l_returnflag", *[F.round(n, 6).alias(n) for n in at])


PERCENTILES = "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {c}), 6) AS p{int(c * 1000)}" for c in (0.004, 0.01, 0.05, 0.5, 0.95, 0.99, 0.996)) + " FROM lineitem GROUP BY l_returnflag"


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG19: 128 equal bins of 0..1, the last closed on the right."""
    x = F.col("c_acctbal") / 11000 + 0.1
    bin_of = F.least(F.floor(x * 128), F.lit(127)).cast("int")
    return read(spark, sf_dir, "customer").where((x >= 0) & (x <= 1)).groupBy("c_mktsegment", bin_of.alias("bin")).agg(F.count("*").alias("n"))


HISTOGRAM = "SELECT c_mktsegment, CAST(least(floor((c_acctbal / 11000 + CAST(0.1 AS DOUBLE)) * 128), 127) AS INTEGER) AS bin, count(*) AS n FROM customer WHERE c_acctbal / 11000 + CAST(0.1 AS DOUBLE) BETWEEN 0 AND 1 GROUP BY ALL"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 13), lambda x: x.cast("double")).alias("f"), (F.col("vec_id") % 10 / 10.0).alias("warmth"), F.when(F.col("vec_id") % 3 == 0, 1.0).otherwise(0.0).alias("trim"))


def feature_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15: mean and deviation of every feature."""
    each = _features(spark, sf_dir).select(F.posexplode("f").alias("i", "x"))
    return each.groupBy("i").agg(F.round(F.avg("x"), 9).alias("mean"), F.round(F.stddev_pop("x") + 1e-3, 9).alias("scale"))


SCALE = "SELECT CAST(i - 1 AS INTEGER) AS i, round(avg(x), 9) AS mean, round(stddev_pop(x) + 1e-3, 9) AS scale FROM (SELECT i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 14) r(i)) GROUP BY i"

_NEAREST = """WITH e AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 14) r(i)),
st AS (SELECT i, avg(x) AS m, stddev_pop(x) + CAST(1e-3 AS DOUBLE) AS s FROM e GROUP BY i),
z AS (SELECT vec_id, label, i, (x - m) / s AS z FROM e JOIN st USING (i)),
d AS (SELECT q.vec_id AS q, x.vec_id AS vec_id, any_value(x.label) AS label, any_value(q.label) AS own, sqrt(sum((q.z - x.z) * (q.z - x.z)) / 13) AS distance FROM z q JOIN z x ON q.i = x.i AND q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id GROUP BY q.vec_id, x.vec_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 7 AND distance <= 3)"""


def knn_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KNN1, SRT3: sliders and a vote from the seven nearest examples; other classes weigh less."""
    rows = _features(spark, sf_dir)
    asked, examples = rows.where("vec_id % 100 = 0").select("vec_id", "f", F.col("label").alias("own")), rows.withColumnRenamed("vec_id", "example_id")
    found = neighbours.nearest(asked.select("vec_id", "f"), examples, "vec_id", "example_id", "f", others=True).join(asked.select("vec_id", "own"), "vec_id")
    weight = F.when(F.col("own") == F.col("label"), 1.0).otherwise(neighbours.OTHER_CLASS_WEIGHT) / (F.col("distance") + neighbours.SOFTEN)
    return neighbours.regress(found, "vec_id", ["warmth", "trim"], weight).select("vec_id", "neighbours", "warmth", (F.col("trim") >= 0.5).alias("trim"))


REGRESS = f"""{_NEAREST}, w AS (SELECT q, (CASE WHEN own = label THEN CAST(1 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END) / (distance + CAST(0.25 AS DOUBLE)) AS w, vec_id % 10 / CAST(10 AS DOUBLE) AS warmth, CASE WHEN vec_id % 3 = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS trim FROM k)
SELECT q AS vec_id, count(*) AS neighbours, round(sum(w * warmth) / sum(w), 3) AS warmth, round(sum(w * trim) / sum(w), 3) >= 0.5 AS trim FROM w GROUP BY q"""


def resuggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF12: what past examples suggest, put into every slide that is still open, with a step to undo; developed, skipped and locked ones stay."""
    k = F.col("vec_id")
    given = F.map_from_arrays(F.array(F.lit("warmth"), F.lit("fade")), F.array(F.lit(9.0), (k % 7).cast("double")))
    steps = F.when(k % 300 == 0, F.array_repeat(F.struct(given.alias("params"), F.lit("edit").alias("what")), 60)).otherwise(F.array_repeat(F.struct(given.alias("params"), F.lit("edit").alias("what")), 1))
    open_ = (k % 400 != 0) & (k % 700 != 100)
    slides = read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select("vec_id", open_.alias("open"), given.alias("params"), F.lit("own").alias("source"), steps.alias("undo"))
    found = knn_regress(spark, sf_dir)
    suggestions = found.select("vec_id", F.map_from_arrays(F.array(F.lit("warmth"), F.lit("trim")), F.array(F.col("warmth"), F.col("trim").cast("double"))).alias("values"), F.col("neighbours").alias("n"))
    out = neighbours.resuggested(slides, suggestions, "vec_id")
    at = lambda name: F.try_element_at("params", F.lit(name)).alias(name)
    return out.select("vec_id", "applied", "source", at("warmth"), at("fade"), at("trim"), F.size("undo").cast("long").alias("steps"), F.get("undo", F.size("undo") - 1)["what"].alias("last"))


RESUGGESTED = f"""WITH s AS (SELECT * FROM ({REGRESS})), e AS (SELECT vec_id, vec_id % 400 <> 0 AND vec_id % 700 <> 100 AS open FROM embeddings WHERE vec_id % 100 = 0), j AS (SELECT e.*, s.*EXCLUDE (vec_id), coalesce(open AND s.vec_id IS NOT NULL, false) AS applied FROM e LEFT JOIN s USING (vec_id))
SELECT vec_id, applied, CASE WHEN applied THEN 'learned:' || neighbours ELSE 'own' END AS source, CASE WHEN applied THEN warmth ELSE CAST(9 AS DOUBLE) END AS warmth, CAST(vec_id % 7 AS DOUBLE) AS fade, CASE WHEN applied THEN CAST(trim AS DOUBLE) END AS trim,
    CAST(CASE WHEN vec_id % 300 = 0 THEN 60 WHEN applied THEN 2 ELSE 1 END AS BIGINT) AS steps, CASE WHEN applied THEN 'learned' ELSE 'edit' END AS last FROM j"""


def knn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KNN3, AGG16: shares of the classes among the nearest examples, held back for few neighbours."""
    rows = _features(spark, sf_dir)
    examples = rows.withColumnRenamed("vec_id", "example_id")
    known = examples.groupBy("label").agg(F.count("*").alias("n")).where("n >= 5").select("label")
    found = neighbours.nearest(rows.where("vec_id % 100 = 0").select("vec_id", "f"), examples, "vec_id", "example_id", "f", others=True)
    return neighbours.classify(found.join(F.broadcast(known), "label", "left_semi"), "vec_id", "label").withColumn("share", F.round("share", 9))


CLASSIFY = f"""{_NEAREST}, kn AS (SELECT * FROM k WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 5)),
c AS (SELECT q, label, sum(1 / (distance + CAST(0.25 AS DOUBLE))) AS w, count(*) AS n FROM kn GROUP BY q, label)
SELECT q AS vec_id, label, round(w / sum(w) OVER (PARTITION BY q) * sum(n) OVER (PARTITION BY q) / (sum(n) OVER (PARTITION BY q) + 1), 9) AS share FROM c"""


def class_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS1, CLS2, AGG17: each item's class after mixing its shares with its group's mean."""
    found = knn_classify(spark, sf_dir).withColumn("tray", F.floor(F.col("vec_id") / 500))
    return neighbours.smoothed(found, "vec_id", "tray", "label", "share", F.col("label"), least=0.15).select("vec_id", "label", F.round("p", 6).alias("p"))


SMOOTHING = f"""WITH sh AS ({CLASSIFY}), t AS (SELECT *, vec_id // 500 AS tray FROM sh), m AS (SELECT tray, label, sum(share) / any_value(n) AS mean FROM t JOIN (SELECT tray, count(DISTINCT vec_id) AS n FROM t GROUP BY tray) USING (tray) GROUP BY tray, label),
g AS (SELECT i.vec_id, m.label, CAST(0.5 AS DOUBLE) * coalesce(t.share, 0) + CAST(0.5 AS DOUBLE) * m.mean AS p FROM (SELECT DISTINCT vec_id, tray FROM t) i JOIN m USING (tray) LEFT JOIN t ON t.vec_id = i.vec_id AND t.label = m.label)
SELECT vec_id, label, round(p, 6) AS p FROM g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) = 1 AND p >= 0.15"""


def fade_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH8: class shares from fourteen colour features."""
    f = F.transform(F.slice("embedding", 1, 14), lambda x: F.abs(x.cast("double")))
    c = vectors.fade_classes(F.col("f"))
    return read(spark, sf_dir, "embeddings").select("vec_id", f.alias("f")).select("vec_id", *[F.round(c[k], 9).alias(k) for k in ("kodachrome", "ektachrome", "agfachrome")])


_D = lambda x: f"CAST({x} AS DOUBLE)"
_SIG = lambda x: f"(1 / (1 + exp(-({x}))))"
FADE = f"""WITH e AS (SELECT vec_id, list_transform(embedding[1:14], lambda x: abs(CAST(x AS DOUBLE))) AS f FROM embeddings),
a AS (SELECT vec_id, least(f[1], f[2], f[3]) AS bl, f[11] AS ct, (f[12] + 3 * (f[1] - f[2]) + (f[7] - f[8])) / 3 AS rd, (f[13] + 3 * (f[3] - f[2]) + (f[9] - f[8])) / 3 AS bu FROM e),
s AS (SELECT vec_id, {_SIG(f"({_D(0.06)} - sqrt(rd * rd + bu * bu)) / {_D(0.02)}")} * {_SIG(f"(ct - {_D(0.45)}) / {_D(0.08)}")} * {_SIG(f"({_D(0.04)} - bl) / {_D(0.015)}")} AS k1,
    {_SIG(f"(rd - {_D(0.05)}) / {_D(0.03)}")} * {_SIG(f"(bu + {_D(0.04)}) / {_D(0.04)}")} * ({_D(0.4)} + {_D(0.6)} * {_SIG(f"(bl - {_D(0.05)}) / {_D(0.025)}")}) AS k2,
    {_SIG(f"(-rd - {_D(0.05)}) / {_D(0.03)}")} * {_SIG(f"(bu + {_D(0.04)}) / {_D(0.04)}")} * ({_D(0.5)} + {_D(0.5)} * {_SIG(f"(bl - {_D(0.05)}) / {_D(0.025)}")}) AS k3 FROM a)
SELECT vec_id, round({_D(0.75)} * k1 / (k1 + k2 + k3 + {_D(0.3)}), 9) AS kodachrome, round({_D(0.75)} * k2 / (k1 + k2 + k3 + {_D(0.3)}), 9) AS ektachrome, round({_D(0.75)} * k3 / (k1 + k2 + k3 + {_D(0.3)}), 9) AS agfachrome FROM s"""

QUERIES = {f.__name__: f for f in (resuggested, weighted_median, calibration, age_correction, inverse_variance_mean, consensus, date_spans, threshold_feedback, majority_vote, pure_clusters, percentiles, histogram, feature_scale, knn_regress, knn_classify, class_smoothing, fade_heuristic)}
ORACLES = {
    "resuggested": RESUGGESTED, "weighted_median": MEDIAN, "calibration": CALIBRATION, "age_correction": AGE, "inverse_variance_mean": IVW, "consensus": CONSENSUS, "date_spans": SPANS, "threshold_feedback": FEEDBACK, "majority_vote": MAJORITY,
    "pure_clusters": PURE, "percentiles": PERCENTILES, "histogram": HISTOGRAM, "feature_scale": SCALE, "knn_regress": REGRESS, "knn_classify": CLASSIFY, "class_smoothing": SMOOTHING, "fade_heuristic": FADE,
}
