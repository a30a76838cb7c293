"""Queries on vectors along an order: duplicates, components, scenes, groups, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions.vectors import dot
from loomline.operators import sequence
from loomline.operators.components import connected_components
from loomline.sources.shared import read

#: The test vectors are nearly orthogonal, so thresholds lie lower than the operators' own.
ALIKE, LINKED = 0.30, 0.25


def _slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.col("vec_id").alias("pos"), F.floor(F.col("vec_id") / 50).alias("tray"), F.floor(F.col("vec_id") / 5).alias("stack"))


_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def band_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN4, JN7, MTH1: pairs up to three places apart in a tray that are alike."""
    return sequence.band_pairs(_slides(spark, sf_dir), ["tray"], "pos", "vec_id", "embedding", ALIKE).select("tray", "a", "b", F.round("cos", 9).alias("cos"))


BAND = f"SELECT a.vec_id // 50 AS tray, a.vec_id AS a, b.vec_id AS b, round({_DOT}, 9) AS cos FROM embeddings a JOIN embeddings b ON a.vec_id // 50 = b.vec_id // 50 AND b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 3 WHERE {_DOT} >= {ALIKE}"


def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5: neighbours with their likeness."""
    rows = _slides(spark, sf_dir).withColumn("next_id", F.lead("vec_id").over(W.partitionBy("tray").orderBy("pos"))).withColumn("next_v", F.lead("embedding").over(W.partitionBy("tray").orderBy("pos")))
    return rows.where("next_id IS NOT NULL").select("vec_id", "next_id", F.round(dot(F.col("embedding"), F.col("next_v")), 9).alias("cos"))


ADJACENT = f"SELECT a.vec_id, b.vec_id AS next_id, round({_DOT}, 9) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id // 50 = b.vec_id // 50"


def prefix_unlike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN6: members of a stack that are like none before them."""
    return sequence.prefix_unlike(_slides(spark, sf_dir), ["stack"], "pos", "vec_id", "embedding", 0.05).select("stack", "vec_id", F.round("most", 9).alias("most"))


UNLIKE = f"SELECT a.vec_id // 5 AS stack, a.vec_id, round(max({_DOT}), 9) AS most FROM embeddings a JOIN embeddings b ON a.vec_id // 5 = b.vec_id // 5 AND b.vec_id < a.vec_id GROUP BY a.vec_id HAVING max({_DOT}) < 0.05"


def duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLU1, SET7: components of alike pairs."""
    pairs = sequence.band_pairs(_slides(spark, sf_dir), ["tray"], "pos", "vec_id", "embedding", LINKED)
    return connected_components(pairs, "a", "b").select(F.col("node").alias("vec_id"), F.col("root").alias("component"))


COMPONENTS = f"""WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id // 50 = b.vec_id // 50 AND b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 3 WHERE {_DOT} >= {LINKED}),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
SELECT node AS vec_id, min(reach) AS component FROM r GROUP BY node"""


def best_of_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG9, MTH10: of each component the member with the best quality, the first of equals."""
    found = duplicate_components(spark, sf_dir)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.abs(F.element_at("embedding", 1).cast("double")).alias("sharp"), F.abs(F.element_at("embedding", 2).cast("double")).alias("clipped"))
    scored = found.join(rows, "vec_id").withColumn("quality", F.col("sharp") * (1 - F.col("clipped")))
    return scored.groupBy("component").agg(F.max_by("vec_id", F.struct(F.col("quality"), -F.col("vec_id"))).alias("best"), F.count("*").alias("members"))


BEST = f"WITH c AS ({COMPONENTS}), s AS (SELECT c.*, abs(CAST(embedding[1] AS DOUBLE)) * (1 - abs(CAST(embedding[2] AS DOUBLE))) AS q FROM c JOIN embeddings USING (vec_id)) SELECT component, first(vec_id ORDER BY q DESC, vec_id) AS best, count(*) AS members FROM s GROUP BY component"


def sequence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN5: items in a row that are like any member of the group so far."""
    return sequence.group_sequence(_slides(spark, sf_dir), "tray", "pos", "vec_id", "embedding", 0.15)


GROUPS = """WITH RECURSIVE e AS (SELECT vec_id // 50 AS tray, row_number() OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS k, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
r AS (SELECT tray, k, vec_id, CAST(0 AS BIGINT) AS g, [v] AS ms FROM e WHERE k = 1
    UNION ALL SELECT tray, k, vec_id, CASE WHEN alike THEN g ELSE g + 1 END, CASE WHEN alike THEN list_append(ms, v) ELSE [v] END FROM (SELECT e.tray, e.k, e.vec_id, e.v, r.g, r.ms, list_max(list_transform(r.ms, lambda m: list_dot_product(m, e.v))) > CAST(0.15 AS DOUBLE) AS alike FROM r JOIN e ON e.tray = r.tray AND e.k = r.k + 1))
SELECT tray, vec_id, g AS "group" FROM r"""


def scene_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN6, WIN7: where two items in a row leave a scene."""
    return sequence.scenes(_slides(spark, sf_dir), "tray", "pos", "embedding", 0.05)


SCENES = """WITH RECURSIVE e AS (SELECT vec_id // 50 AS tray, vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER w AS k, lead(CAST(embedding AS DOUBLE[])) OVER w AS nv FROM embeddings WINDOW w AS (PARTITION BY vec_id // 50 ORDER BY vec_id)),
r AS (SELECT tray, k, vec_id, CAST(0 AS BIGINT) AS s, [v] AS recent, true AS member FROM e WHERE k = 1
    UNION ALL SELECT tray, k, vec_id, CASE WHEN far AND next_far THEN s + 1 ELSE s END, CASE WHEN NOT far THEN list_append(recent, v)[-4:] WHEN next_far THEN [v] ELSE recent END, NOT far OR next_far
    FROM (SELECT *, list_dot_product(v, m) < CAST(0.05 AS DOUBLE) * sqrt(list_dot_product(m, m)) AS far, nv IS NULL OR list_dot_product(nv, m) < CAST(0.05 AS DOUBLE) * sqrt(list_dot_product(m, m)) AS next_far
        FROM (SELECT e.tray, e.k, e.vec_id, e.v, e.nv, r.s, r.recent, list_transform(range(1, 65), lambda i: list_avg(list_transform(r.recent, lambda x: x[i]))) AS m FROM r JOIN e ON e.tray = r.tray AND e.k = r.k + 1))),
g AS (SELECT tray, s AS scene, min(vec_id) AS first_pos, count(*) AS members, max(max(s)) OVER (PARTITION BY tray) AS many FROM r WHERE member GROUP BY tray, s), t AS (SELECT vec_id // 50 AS tray, max(vec_id) AS last FROM embeddings GROUP BY ALL)
SELECT tray, scene, first_pos, coalesce(lead(first_pos) OVER (PARTITION BY tray ORDER BY scene) - 1, last) AS last_pos, members FROM g JOIN t USING (tray) WHERE many > 0"""


def cluster_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLU2, CLU3: constrained average linkage over all faces of the library: existing people, faces they were rejected from, four faces a slide."""
    k = F.col("vec_id")
    rows = _slides(spark, sf_dir).select("vec_id", "embedding", F.floor(k / 4).alias("slide"), F.when(k % 25 == 0, F.col("label")).alias("owner"))
    rejected = rows.where(k % 7 == 0).select("vec_id", F.explode(F.array((k % 10).cast("int"), (k % 3).cast("int"))).alias("owner"))
    return sequence.cluster_items(rows, "vec_id", "embedding", "slide", "owner", rejected)


def spread_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRP1: names of three labels passed on to faces nearby."""
    rows = _slides(spark, sf_dir).select("tray", "vec_id", F.floor(F.col("vec_id") / 2).alias("pos"), "embedding", F.when(F.col("label") < 3, F.col("label")).alias("person"))
    return sequence.spread_names(rows, "tray", "vec_id", "pos", "embedding", "person")


def _prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("r")).select("label", F.col("r.m").alias("prototype"))


def zero_shot_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MDL1, MTH6, SRT2, AGG18: softmax over the labels' mean vectors, the four best above a threshold."""
    few = _prototypes(spark, sf_dir)
    scores = read(spark, sf_dir, "embeddings").select("vec_id", "embedding").crossJoin(few).select("vec_id", "label", (dot(F.col("embedding"), F.col("prototype")) * 100).alias("x"))
    own = W.partitionBy("vec_id")
    p = F.exp(F.col("x") - F.max("x").over(own))
    shares = scores.withColumn("e", p).withColumn("p", F.col("e") / F.sum("e").over(own))
    ranked = shares.where("p >= 0.05").withColumn("r", F.row_number().over(own.orderBy(F.desc("p"), "label"))).where("r <= 4")
    return ranked.select("vec_id", "label", F.round("p", 6).alias("p"))


ZERO_SHOT = """WITH e AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i)), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i),
s AS (SELECT e.vec_id, m.label, 100 * sum(e.x * m.m) AS x FROM e JOIN m USING (i) GROUP BY e.vec_id, m.label), p AS (SELECT vec_id, label, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM s),
q AS (SELECT vec_id, label, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM p)
SELECT vec_id, label, round(p, 6) AS p FROM q WHERE p >= 0.05 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) <= 4"""


def person_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRP3, SRT9, CLU4: mean of the three best likenesses of an item to the members of each label nearby."""
    rows = _slides(spark, sf_dir).where("label IS NOT NULL")
    pairs = rows.alias("x").join(rows.alias("y"), F.expr("x.stack = y.stack AND x.vec_id <> y.vec_id")).select(F.col("x.vec_id").alias("vec_id"), F.col("y.label").alias("person"), dot(F.col("x.embedding"), F.col("y.embedding")).alias("cos"))
    return sequence.top_mean(pairs, ["vec_id", "person"], "cos").select("vec_id", "person", F.round("mean", 9).alias("mean"), "n")


LIKELIHOOD = f"WITH p AS (SELECT a.vec_id, b.label AS person, {_DOT} AS c FROM embeddings a JOIN embeddings b ON a.vec_id // 5 = b.vec_id // 5 AND a.vec_id <> b.vec_id WHERE a.label IS NOT NULL AND b.label IS NOT NULL), r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY vec_id, person ORDER BY c DESC) <= 3) SELECT vec_id, person, round(avg(c), 9) AS mean, count(*) AS n FROM r GROUP BY ALL"

QUERIES = {f.__name__: f for f in (band_duplicates, adjacent_pairs, prefix_unlike, duplicate_components, best_of_duplicates, sequence_groups, scene_changes, cluster_people, spread_names, zero_shot_top4, person_likelihood)}
ORACLES = {"band_duplicates": BAND, "adjacent_pairs": ADJACENT, "prefix_unlike": UNLIKE, "duplicate_components": COMPONENTS, "best_of_duplicates": BEST, "sequence_groups": GROUPS, "scene_changes": SCENES, "zero_shot_top4": ZERO_SHOT, "person_likelihood": LIKELIHOOD}
