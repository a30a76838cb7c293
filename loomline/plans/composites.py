"""Queries that put several operators together: people, years, look-alikes, plans, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions import checks
from loomline.functions.vectors import dot
from loomline.operators import people, sequence
from loomline.operators.components import connected_components
from loomline.plans.vectors import _DOT, _slides
from loomline.sources.shared import read


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL1, VAL3, FLT9, FLT11, ROT1: cleaned places and crops, safe names, flags and votes."""
    k = F.col("p_partkey")
    place = checks.clean_place(F.when(k % 5 != 0, F.col("p_name")).otherwise("  "), k % 200 - 100.0, k % 380 - 190.0, F.col("p_brand"))
    crop = checks.clean_crop((k % 30) / 20.0 - 0.5, (k % 7) / 10.0, (k % 40) / 20.0, (k % 11) / 10.0 + 0.1)
    vote = checks.rotation_vote(k % 7, k % 3, k % 2, (k % 11 == 0).cast("int") * 9)
    return read(spark, sf_dir, "part").select("p_partkey", place["name"].alias("name"), place["lat"].alias("lat"), F.round(crop["l"], 6).alias("l"), F.round(crop["r"], 6).alias("r"), checks.safe_id(F.col("p_brand")).alias("safe"), checks.auto_straighten((k % 10) / 10.0, (k % 5) / 20.0, k % 3 == 0, k % 4 == 0).alias("straighten"), vote.cast("int").alias("turn"))


VALIDATED = """WITH x AS (SELECT p_partkey, p_partkey AS k, p_name, p_brand, CAST(p_partkey % 200 AS DOUBLE) - 100 AS la, CAST(p_partkey % 380 AS DOUBLE) - 190 AS lo, greatest(least(CAST(p_partkey % 30 AS DOUBLE) / 20 - 0.5, 1), 0) AS l, greatest(least(CAST(p_partkey % 7 AS DOUBLE) / 10, 1), 0) AS t,
    greatest(least(CAST(p_partkey % 40 AS DOUBLE) / 20, 1), 0) AS r, greatest(least(CAST(p_partkey % 11 AS DOUBLE) / 10 + CAST(0.1 AS DOUBLE), 1), 0) AS b, list_sort([(CAST(p_partkey % 7 AS DOUBLE), 0), (CAST(p_partkey % 3 AS DOUBLE), -90), (CAST(p_partkey % 2 AS DOUBLE), -180), (CASE WHEN p_partkey % 11 = 0 THEN CAST(9 AS DOUBLE) ELSE 0 END, -270)], 'DESC') AS v FROM part),
y AS (SELECT *, abs(la) <= 90 AND abs(lo) <= 180 AS ok, r - l >= 0.05 AND b - t >= 0.05 AND NOT (l <= 0 AND t <= 0 AND r >= 1 AND b >= 1) AS cr, v[1][1] AS n1, v[2][1] AS n2, v[1][1] + v[2][1] + v[3][1] + v[4][1] AS n FROM x)
SELECT p_partkey, CASE WHEN ok THEN CASE WHEN k % 5 <> 0 THEN trim(p_name) ELSE printf('%.4f, %.4f', la, lo) END END AS name, CASE WHEN ok THEN la END AS lat, CASE WHEN cr THEN round(l, 6) END AS l, CASE WHEN cr THEN round(r, 6) END AS r, regexp_matches(p_brand, '^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$') AS safe,
    CAST(k % 10 AS DOUBLE) / 10 >= 0.8 AND CAST(k % 5 AS DOUBLE) / 20 >= 0.1 AND k % 3 <> 0 AND k % 4 <> 0 AS straighten, CAST(CASE WHEN n > 0 AND n1 / n >= 0.7 AND n1 >= 2 * n2 + 0.3 * n THEN -v[1][2] END AS INTEGER) AS turn FROM y"""


def look_alikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF9, JN4, JN5, JN6, CLU1: slides to merge, to split and to call duplicates, pairs offered as merges left out of the last."""
    rows = _slides(spark, sf_dir)
    nxt = W.partitionBy("tray").orderBy("pos")
    merge = rows.withColumn("b", F.lead("vec_id").over(nxt)).withColumn("_v", F.lead("embedding").over(nxt)).where("b IS NOT NULL").select("tray", F.col("vec_id").alias("a"), "b", dot(F.col("embedding"), F.col("_v")).alias("c")).where("c >= 0.2")
    split = sequence.prefix_unlike(rows, ["stack"], "pos", "vec_id", "embedding", 0.0).select(F.lit("split").alias("kind"), F.col("vec_id").alias("a"), F.col("vec_id").alias("b"), F.round(F.least(F.lit(1.0), (0.0 - F.col("most")) / 0.3 + 0.5), 9).alias("confidence"))
    pairs = sequence.band_pairs(rows, ["tray"], "pos", "vec_id", "embedding", 0.2).join(merge.select("a", "b"), ["a", "b"], "left_anti")
    member = connected_components(pairs, "a", "b")
    duplicates = pairs.join(member, pairs["a"] == member["node"]).groupBy("root").agg(F.avg("cos").alias("c"), F.max("b").alias("b")).select(F.lit("duplicates").alias("kind"), F.col("root").alias("a"), "b", F.round("c", 9).alias("confidence"))
    return merge.select(F.lit("merge").alias("kind"), "a", "b", F.round("c", 9).alias("confidence")).unionByName(split).unionByName(duplicates)


LOOK_ALIKES = f"""WITH RECURSIVE m AS (SELECT a.vec_id AS a, b.vec_id AS b, {_DOT} AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id // 50 = b.vec_id // 50 WHERE {_DOT} >= 0.2),
s AS (SELECT a.vec_id AS a, max({_DOT}) AS c FROM embeddings a JOIN embeddings b ON a.vec_id // 5 = b.vec_id // 5 AND b.vec_id < a.vec_id GROUP BY a.vec_id HAVING max({_DOT}) < 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_DOT} AS c FROM embeddings a JOIN embeddings b ON a.vec_id // 50 = b.vec_id // 50 AND b.vec_id BETWEEN a.vec_id + 2 AND a.vec_id + 3 WHERE {_DOT} >= 0.2),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a), k AS (SELECT node, min(reach) AS root FROM r GROUP BY node)
SELECT 'merge' AS kind, a, b, round(c, 9) AS confidence FROM m UNION ALL SELECT 'split', a, a, round(least(1, (0 - c) / CAST(0.3 AS DOUBLE) + 0.5), 9) FROM s
UNION ALL SELECT 'duplicates', root, max(b), round(avg(c), 9) FROM p JOIN k ON p.a = k.node GROUP BY root"""


def _says(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").where(k % 3 != 0).select(k.alias("slide"), (1950 + k % 40 * 1.5).alias("v"), (1 + k % 4 * 0.75).alias("sd"))


def slide_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EST5, DAT5, WIN10: the year of every slide from its people, its neighbours and the dates around it."""
    k = F.col("vec_id")
    base = read(spark, sf_dir, "embeddings").select(k.alias("slide"))
    source = F.when(F.col("slide") % 4 == 0, "between").when(F.col("slide") % 4 == 1, "near").when(F.col("slide") % 4 == 2, "tray")
    s = F.col("slide")
    priors = base.select("slide", F.when(source.isNotNull(), 1955 + s % 37 * 1.5).alias("v"), people.prior_sd(source, s % 7 + 1950.0, s % 11 + 1950.0, s % 6).alias("sd"), (s % 13 == 0).alias("own"), (1955 + s % 37).alias("shown"), (s % 17 == 0).alias("skip"))
    near = base.select("slide", F.explode(F.array(*[F.struct((s + d).alias("other"), F.lit(abs(d)).cast("long").alias("dist")) for d in (-5, -1, 2, 7)])).alias("p")).select("slide", "p.other", "p.dist")
    return people.slide_years(_says(spark, sf_dir), priors, near).select("slide", F.round("y", 6).alias("y"), F.round("sd", 6).alias("sd"), "parts", "against", "suggest")


SLIDE_YEARS = """WITH says AS (SELECT vec_id AS s, 1950 + vec_id % 40 * CAST(1.5 AS DOUBLE) AS v, 1 + vec_id % 4 * CAST(0.75 AS DOUBLE) AS sd FROM embeddings WHERE vec_id % 3 <> 0),
pr AS (SELECT vec_id AS s, CASE WHEN vec_id % 4 < 3 THEN 1955 + vec_id % 37 * CAST(1.5 AS DOUBLE) END AS v, CASE vec_id % 4 WHEN 0 THEN greatest(CAST(0.5 AS DOUBLE), abs(vec_id % 11 - vec_id % 7) / CAST(4 AS DOUBLE)) WHEN 1 THEN 1.5 + CAST(0.1 AS DOUBLE) * (vec_id % 6) WHEN 2 THEN CAST(1.5 AS DOUBLE) END AS sd, vec_id % 13 = 0 AS own, 1955 + vec_id % 37 AS shown, vec_id % 17 = 0 AS skip FROM embeddings),
nr AS (SELECT e.vec_id AS s, abs(d) AS dist, y.s AS o, y.v, sqrt(y.sd * y.sd + pow(0.5 + CAST(0.1 AS DOUBLE) * abs(d), 2)) AS sd FROM embeddings e, (VALUES (-5), (-1), (2), (7)) t(d), says y WHERE y.s = e.vec_id + d),
fs AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY s ORDER BY sd, dist, o, v) = 1),
an AS (SELECT pr.*, says.v AS ov, says.sd AS os, coalesce(says.v, fs.v) AS av, coalesce(says.sd, fs.sd) AS asd FROM pr LEFT JOIN says USING (s) LEFT JOIN fs USING (s) WHERE coalesce(says.v, fs.v) IS NOT NULL),
pt AS (SELECT s, ov AS v, os AS sd FROM an WHERE ov IS NOT NULL UNION ALL SELECT an.s, nr.v, nr.sd FROM an JOIN nr ON an.s = nr.s AND abs(nr.v - av) <= CAST(2.5 AS DOUBLE) * sqrt(nr.sd * nr.sd + asd * asd)),
b AS (SELECT s, sum(v / (sd * sd)) / sum(1 / (sd * sd)) AS bv, sqrt(1 / sum(1 / (sd * sd))) AS bs, count(*) AS parts FROM pt GROUP BY s),
j AS (SELECT an.*, bv, bs, parts, coalesce(abs(v - bv) <= CAST(2.5 AS DOUBLE) * sqrt(sd * sd + bs * bs), false) AS jo FROM an JOIN b USING (s)),
f AS (SELECT *, CASE WHEN jo THEN (bv / (bs * bs) + v / (sd * sd)) / (1 / (bs * bs) + 1 / (sd * sd)) ELSE bv END AS y, CASE WHEN jo THEN sqrt(1 / (1 / (bs * bs) + 1 / (sd * sd))) ELSE bs END AS ys FROM j)
SELECT s AS slide, round(y, 6) AS y, round(ys, 6) AS sd, parts, v IS NOT NULL AND NOT jo AS against, NOT own AND NOT skip AND ys <= 8 AND NOT (jo AND (bs >= sd OR abs(bv - v) <= sd)) AND floor(y) <> shown AS suggest FROM f"""


def suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EST1, EST2, EST3: faces whose age can't be that of the person they are named."""
    k = F.col("p_partkey")
    faces = read(spark, sf_dir, "part").select(k.alias("face"), (k % 20).alias("person"), (1950 + k % 30 * 1.0).alias("year"), (0.3 + k % 3 * 0.5).alias("year_sd"), (k % 60 * 1.0).alias("age"), F.lit(2.0).alias("age_sd"), (k % 10 / 10.0).alias("fit"), (k % 5).alias("n"), (k % 2 == 0).alias("dated"))
    births = spark.range(20).select(F.col("id").alias("person"), (1920 + F.col("id") * 2.0).alias("born"), (0.5 + F.col("id") % 3).alias("born_sd"))
    return people.suspects(faces, births).select("face", "person", F.round("off", 6).alias("off"), F.round("sd", 6).alias("sd"))


SUSPECTS = """WITH x AS (SELECT p_partkey AS face, p_partkey % 20 AS person, abs(p_partkey % 60 - (1950 + p_partkey % 30 - (1920 + p_partkey % 20 * 2))) * CAST(1 AS DOUBLE) AS off, sqrt(4 + pow(0.3 + p_partkey % 3 * CAST(0.5 AS DOUBLE), 2) + pow(0.5 + p_partkey % 20 % 3, 2)) AS sd, CAST(p_partkey % 10 AS DOUBLE) / 10 AS fit, p_partkey % 5 AS n, p_partkey % 2 = 0 AS dated FROM part)
SELECT face, person, round(off, 6) AS off, round(sd, 6) AS sd FROM x WHERE off >= 6 AND off > 2.5 * sd AND ((fit < 0.35 AND n >= 3) OR dated)"""


def one_face_per_slide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLU4, AGG18: of several faces of one person on a slide the one most like the person's others."""
    rows = read(spark, sf_dir, "embeddings").where("label IS NOT NULL").select("vec_id", "label", F.floor(F.col("vec_id") / 8).alias("slide"), "embedding", (F.col("vec_id") % 29 == 0).alias("sure"))
    return people.one_per_slide(rows, "label", "slide", "vec_id", "embedding", "sure").select("vec_id", "label", "slide")


ONE_FACE = """WITH e AS (SELECT vec_id, label, vec_id // 8 AS slide, vec_id % 29 = 0 AS sure, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i) WHERE label IS NOT NULL), s AS (SELECT label, i, sum(x) AS s FROM e GROUP BY label, i),
l AS (SELECT vec_id, any_value(e.label) AS label, any_value(slide) AS slide, any_value(sure) AS sure, sum(x * (s - x)) / sqrt(sum((s - x) * (s - x))) AS k FROM e JOIN s ON e.label = s.label AND e.i = s.i GROUP BY vec_id),
r AS (SELECT *, bool_or(sure) OVER (PARTITION BY label, slide) AS any_sure, row_number() OVER (PARTITION BY label, slide ORDER BY k DESC, vec_id) AS r FROM l)
SELECT vec_id, label, slide FROM r WHERE CASE WHEN any_sure THEN sure ELSE r = 1 END"""


def followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRP2: faces of an unnamed group that follow the one that was named."""
    rows = _slides(spark, sf_dir).select("vec_id", "embedding", F.col("stack").alias("slide"), F.col("tray").alias("group"))
    return people.followers(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", "slide", 0.1).select("group", "vec_id", "slide", F.round("cos", 9).alias("cos"))


FOLLOWERS = f"SELECT b.vec_id // 50 AS \"group\", b.vec_id, b.vec_id // 5 AS slide, round({_DOT}, 9) AS cos FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id // 50 = b.vec_id // 50 AND a.vec_id // 5 <> b.vec_id // 5 WHERE {_DOT} >= 0.1 QUALIFY row_number() OVER (PARTITION BY b.vec_id // 5 ORDER BY {_DOT} DESC, b.vec_id) = 1"


def reidentified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAT2: faces found again keep their numbers."""
    rows = _slides(spark, sf_dir).select(F.col("stack").alias("slide"), "vec_id", "embedding", (F.col("vec_id") % 5).alias("number"))
    return people.reidentify(rows.drop("number"), rows.where("vec_id % 3 <> 0").select("slide", "number", "embedding"), "slide", "vec_id", "embedding", "number")


REIDENTIFIED = """WITH RECURSIVE v AS (SELECT vec_id, vec_id // 5 AS slide, vec_id % 5 AS number, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY vec_id // 5 ORDER BY vec_id) AS k FROM embeddings), o AS (SELECT * FROM v WHERE vec_id % 3 <> 0),
c AS (SELECT f.slide, f.k, list(o.number ORDER BY list_dot_product(f.e, o.e) DESC, o.number) AS likes FROM v f JOIN o ON o.slide = f.slide WHERE list_dot_product(f.e, o.e) >= CAST(0.8 AS DOUBLE) GROUP BY ALL),
s AS (SELECT v.slide, v.k, v.vec_id, coalesce(likes, []) AS likes FROM v LEFT JOIN c USING (slide, k)),
r AS (SELECT slide, k, vec_id, likes[1] AS got, CASE WHEN likes[1] IS NULL THEN [] ELSE [likes[1]] END AS taken FROM s WHERE k = 1
    UNION ALL SELECT slide, k, vec_id, g, CASE WHEN g IS NULL THEN taken ELSE list_append(taken, g) END FROM (SELECT s.*, r.taken, list_filter(s.likes, lambda n: NOT list_contains(r.taken, n))[1] AS g FROM r JOIN s ON s.slide = r.slide AND s.k = r.k + 1)),
u AS (SELECT slide, list(number) AS olds FROM o GROUP BY slide)
SELECT slide, vec_id, coalesce(got, list_filter(range(20), lambda n: NOT list_contains(coalesce(olds, []), n))[count(*) FILTER (got IS NULL) OVER (PARTITION BY slide ORDER BY k)]) AS number FROM r LEFT JOIN u USING (slide)"""


def people_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF7, JN24, AGG13, AGG14: links, names, merges and conflicts between two lists of people."""
    o = read(spark, sf_dir, "orders")
    pairs = o.select((F.col("o_custkey") % 200).alias("pid"), (F.col("o_custkey") % 200 % 150 + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).alias("rid"))
    ours = spark.range(200).select(F.col("id").alias("pid"), F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("P"), (F.col("id") % 150).cast("string"))).alias("name"))
    theirs = spark.range(152).select(F.col("id").alias("rid"), F.when(F.col("id") % 4 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("id") % 140).cast("string"))).alias("name"))
    return people.sync_actions(pairs, ours, theirs)


SYNC = """WITH p AS (SELECT o_custkey % 200 AS pid, o_custkey % 200 % 150 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS rid FROM orders), n AS (SELECT pid, rid, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY pid) AS tp, count(*) OVER (PARTITION BY rid) AS kr FROM n), l AS (SELECT pid, rid FROM c WHERE n >= 2 AND (kr = 1 OR n >= tp * (CAST(2 AS DOUBLE) / 3))),
m AS (SELECT pid, rid, CASE WHEN pid % 3 <> 0 THEN 'P' || (pid % 150) END AS o, CASE WHEN rid % 4 <> 0 THEN 'p' || (rid % 140) END AS t FROM l)
SELECT CASE WHEN o IS NULL AND t IS NOT NULL THEN 'take_name' WHEN o IS NOT NULL AND t IS NULL THEN 'give_name' WHEN lower(o) <> lower(t) THEN 'conflict' ELSE 'link' END AS kind, pid, rid, coalesce(o, t) AS name FROM m
UNION ALL SELECT 'merge', pid, rid, CAST(f AS VARCHAR) FROM (SELECT *, min(pid) OVER (PARTITION BY rid) AS f FROM l) WHERE pid <> f"""


def merged_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG6, MRG8: people merged into others, the first name that isn't empty kept."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    rows = c.select(k.alias("pid"), k.alias("ord"), F.when(k % 2 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(k % 3 != 0, "").otherwise((1900 + k % 90).cast("string")).alias("birthday"), F.array(k % 7, k % 11).alias("faces"))
    into = c.where(k % 5 != 0).select(k.alias("pid"), (k - k % 5).alias("target")).where("target > 0")
    return people.merged_people(rows, into).select("pid", "name", "birthday", F.array_join(F.transform("faces", lambda x: x.cast("string")), ",").alias("faces"))


MERGED = """WITH x AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 AND c_custkey - c_custkey % 5 > 0 THEN c_custkey - c_custkey % 5 ELSE c_custkey END AS t, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS n, CASE WHEN c_custkey % 3 <> 0 THEN '' ELSE CAST(1900 + c_custkey % 90 AS VARCHAR) END AS b FROM customer),
f AS (SELECT t, list_sort(list(DISTINCT v)) AS fs FROM (SELECT t, k % 7 AS v FROM x UNION ALL SELECT t, k % 11 FROM x) GROUP BY t)
SELECT t AS pid, first(n ORDER BY k <> t, k) FILTER (n <> '') AS name, first(b ORDER BY k <> t, k) FILTER (b <> '') AS birthday, array_to_string(any_value(fs), ',') AS faces FROM x JOIN f USING (t) GROUP BY t"""


def remote_look_alikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF8, SRT4, JN19: the three most alike remote items in the same days that aren't our own, decided ones left out."""
    k = F.col("vec_id")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.floor(k / 20).alias("day"))
    ours, remote = rows.where(k % 2 == 0), rows.where(k % 2 == 1).select(F.col("vec_id").alias("rid"), F.col("embedding").alias("_v"), "day").where("rid % 9 <> 0")
    decided = ours.where("vec_id % 8 = 0").select("vec_id", (F.col("vec_id") + 1).alias("rid"))
    found = ours.join(remote, "day").join(decided, ["vec_id", "rid"], "left_anti").select("vec_id", "rid", dot(F.col("embedding"), F.col("_v")).alias("c")).where("c >= 0.05")
    return found.withColumn("r", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("c"), "rid"))).where("r <= 3").select("vec_id", "rid", F.round("c", 9).alias("cos"))


REMOTE = f"SELECT a.vec_id, b.vec_id AS rid, round({_DOT}, 9) AS cos FROM embeddings a JOIN embeddings b ON a.vec_id // 20 = b.vec_id // 20 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND b.vec_id % 9 <> 0 AND NOT (a.vec_id % 8 = 0 AND b.vec_id = a.vec_id + 1) WHERE {_DOT} >= 0.05 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) <= 3"


def unlock_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF10, LIF11, LIF5: per slide whether its lost scans can come back as they were, from the final picture, or not."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("lost"), (F.col("l_linestatus") == "F").alias("stacked"), (F.col("l_linenumber") == 1).alias("final"))
    by = rows.groupBy("l_orderkey").agg(F.count_if("lost").alias("lost"), F.bool_and(~F.col("lost") | F.col("stacked")).alias("all_stacked"), F.bool_or("final").alias("final"))
    return by.where("lost > 0").select("l_orderkey", "lost", F.when(F.col("all_stacked"), "restore").when(F.col("final"), "final_only").otherwise("gone").alias("plan"))


UNLOCK = "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS lost, CASE WHEN bool_and(l_returnflag <> 'R' OR l_linestatus = 'F') THEN 'restore' WHEN bool_or(l_linenumber = 1) THEN 'final_only' ELSE 'gone' END AS plan FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_returnflag = 'R') > 0"


def atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN22, JN2, JN29, SRT6: things grouped by place, with who belongs there, places without a name last."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    places = n.join(r, n.n_regionkey == r.r_regionkey, "left").select("n_nationkey", F.concat_ws(", ", "n_name", "r_name").alias("place"))
    who = c.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.col("c_custkey") % 10 == 0, F.col("c_name")))), 1, 5), "|").alias("people"))
    return places.join(who, places.n_nationkey == who.c_nationkey, "left").select("place", F.coalesce("n", F.lit(0)).alias("n"), "people")


ATLAS = "WITH w AS (SELECT c_nationkey, count(*) AS n, array_to_string(list_sort(list(DISTINCT c_name) FILTER (c_custkey % 10 = 0))[1:5], '|') AS people FROM customer GROUP BY c_nationkey) SELECT n_name || ', ' || r_name AS place, coalesce(n, 0) AS n, CASE WHEN n IS NOT NULL THEN coalesce(people, '') END AS people FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN w ON c_nationkey = n_nationkey"

QUERIES = {f.__name__: f for f in (validated, look_alikes, slide_years, suspects, one_face_per_slide, followers, reidentified, people_sync, merged_people, remote_look_alikes, unlock_plan, atlas)}
ORACLES = {"reidentified": REIDENTIFIED, 
    "validated": VALIDATED, "look_alikes": LOOK_ALIKES, "slide_years": SLIDE_YEARS, "suspects": SUSPECTS, "one_face_per_slide": ONE_FACE, "followers": FOLLOWERS, "people_sync": SYNC, "merged_people": MERGED,
    "remote_look_alikes": REMOTE, "unlock_plan": UNLOCK, "atlas": ATLAS,
}
