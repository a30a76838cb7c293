"""Queries on status, merging, change capture and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.operators import lifecycle, temporal
from loomline.sources.shared import read


def _slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as slides: the status from what was uploaded and what is now."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (k % 11 == 0).alias("skip"), (k % 13 == 0).alias("locked"), F.when(k % 3 == 0, k % 5).alias("up_key"), (k % 7 % 5).alias("key"), F.when(k % 3 == 0, k % 4).alias("up_meta"), (k % 8 % 4).alias("meta"), (k % 2 == 0).alias("reviewed"), (k % 17 == 0).alias("lost"))
    return rows.withColumn("status", lifecycle.status(*[F.col(c) for c in ("skip", "locked", "up_key", "key", "up_meta", "meta", "reviewed")]))


_STATUS = """s AS (SELECT o_orderkey AS k, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'skipped' WHEN o_orderkey % 3 = 0 AND (o_orderkey % 13 = 0 OR (o_orderkey % 5 = o_orderkey % 7 % 5 AND o_orderkey % 4 = o_orderkey % 8 % 4)) THEN 'uploaded'
    WHEN o_orderkey % 3 = 0 THEN 'changed' WHEN o_orderkey % 2 = 0 THEN 'reviewed' ELSE 'new' END AS status FROM orders)"""


def slide_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1, FLT2, FLT6, FLT13: the status of every item, stale keys told by comparison."""
    return _slides(spark, sf_dir).select("o_orderkey", "status")


STATUS = f"WITH {_STATUS} SELECT k AS o_orderkey, status FROM s"


def upload_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF3, LIF5, SNK4, SNK5: what to upload, in batches of two hundred per customer nation."""
    rows = lifecycle.upload_plan(_slides(spark, sf_dir), "status", F.col("o_orderkey") % 6 == 0, F.col("lost")).where("action <> 'none'").withColumn("shard", F.col("o_custkey") % 25)
    number = F.row_number().over(W.partitionBy("shard").orderBy("o_orderkey")) - 1
    return rows.select("o_orderkey", "action", "shard", F.floor(number / 200).alias("batch"))


PLAN = f"""WITH {_STATUS}, a AS (SELECT k, o_custkey % 25 AS shard, CASE WHEN status = 'skipped' THEN 'none' WHEN k % 17 = 0 THEN 'lost' WHEN status = 'changed' THEN CASE WHEN k % 6 = 0 THEN 'meta_only' ELSE 'upload' END WHEN status = 'reviewed' THEN 'upload' ELSE 'none' END AS action FROM s)
SELECT k AS o_orderkey, action, shard, (row_number() OVER (PARTITION BY shard ORDER BY k) - 1) // 200 AS batch FROM a WHERE action <> 'none'"""


def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG4: changes between two versions put onto a third, by row and by column."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").cast("long").alias("nation"))
    k = F.col("c_custkey")
    raw = c.where(k % 10 != 1).withColumn("nation", F.when(k % 4 == 0, F.col("nation") + 100).otherwise(F.col("nation")))
    base = c.where(k % 10 != 2)
    new = c.where(k % 10 != 3).withColumn("c_mktsegment", F.when(k % 3 == 0, "MOVED").otherwise(F.col("c_mktsegment"))).withColumn("nation", F.when(k % 8 == 0, F.lit(None)).otherwise(F.col("nation")))
    return lifecycle.three_way_merge(raw, base, new, ["c_custkey"], ["c_name", "c_mktsegment", "nation"])


MERGE = """WITH c AS (SELECT c_custkey AS k, c_name AS a, c_mktsegment AS b, CAST(c_nationkey AS BIGINT) AS n FROM customer), r AS (SELECT k, a, b, CASE WHEN k % 4 = 0 THEN n + 100 ELSE n END AS n FROM c WHERE k % 10 <> 1), o AS (SELECT * FROM c WHERE k % 10 <> 2),
w AS (SELECT k, a, CASE WHEN k % 3 = 0 THEN 'MOVED' ELSE b END AS b, CASE WHEN k % 8 = 0 THEN NULL ELSE n END AS n FROM c WHERE k % 10 <> 3),
j AS (SELECT coalesce(r.k, o.k, w.k) AS k, r.k AS rk, o.k AS ok, w.k AS wk, r.a AS ra, o.a AS oa, w.a AS wa, r.b AS rb, o.b AS ob, w.b AS wb, r.n AS rn, o.n AS onn, w.n AS wn FROM r FULL JOIN o ON r.k = o.k FULL JOIN w ON w.k = coalesce(r.k, o.k))
SELECT k AS c_custkey, CASE WHEN wk IS NULL OR (wa IS NOT DISTINCT FROM oa AND ok IS NOT NULL AND rk IS NOT NULL) THEN ra ELSE wa END AS c_name, CASE WHEN wk IS NULL OR (wb IS NOT DISTINCT FROM ob AND ok IS NOT NULL AND rk IS NOT NULL) THEN rb ELSE wb END AS c_mktsegment,
    CASE WHEN wk IS NULL OR (wn IS NOT DISTINCT FROM onn AND ok IS NOT NULL AND rk IS NOT NULL) THEN rn ELSE wn END AS nation FROM j WHERE wk IS NOT NULL OR (rk IS NOT NULL AND ok IS NULL)"""


def remote_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG5, PRJ10: fields that the remote side changed since the last push, taken over and counted."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    ours = c.select("c_custkey", F.col("c_name").alias("caption"), F.col("c_mktsegment").alias("tag"), F.col("c_name").alias("pushed_caption"), F.when(k % 9 != 0, F.col("c_mktsegment")).alias("pushed_tag"))
    remote = c.select("c_custkey", F.when(k % 5 == 0, F.concat("c_name", F.lit(" edited"))).otherwise(F.col("c_name")).alias("caption"), F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("tag"))
    return lifecycle.pulled(ours, remote, ["c_custkey"], ["caption", "tag"])


EDITS = """WITH x AS (SELECT c_custkey, c_name, c_mktsegment AS t, CASE WHEN c_custkey % 5 = 0 THEN c_name || ' edited' ELSE c_name END AS rc, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS rt, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS pt FROM customer)
SELECT c_custkey, CASE WHEN rc IS DISTINCT FROM c_name THEN rc ELSE c_name END AS caption, CASE WHEN rt IS DISTINCT FROM pt THEN rt ELSE t END AS tag, CAST(rc IS DISTINCT FROM c_name AS INTEGER) + CAST(rt IS DISTINCT FROM pt AS INTEGER) AS changed FROM x WHERE rc IS DISTINCT FROM c_name OR rt IS DISTINCT FROM pt"""


def merged_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG1, LIF4: a new run of suggestions merged into the decided ones."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("value"))
    k = F.col("doc_id")
    old = d.where(k % 3 != 0).select("doc_id", "value", F.when(k % 4 == 0, "accepted").when(k % 4 == 1, "dismissed").otherwise("suggested").alias("state"), F.lit(0.25).alias("confidence"))
    new = d.where(k % 5 != 0).select("doc_id", "value", (k % 10 / 10.0).alias("confidence"))
    return lifecycle.merged_suggestions(old, new, d.where(k % 7 == 0), ["doc_id"], "value")


SUGGESTIONS = """WITH x AS (SELECT doc_id AS k, lang AS value, doc_id % 3 <> 0 AS o, doc_id % 5 <> 0 AS n, CASE WHEN doc_id % 3 <> 0 THEN CASE doc_id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'dismissed' ELSE 'suggested' END END AS st FROM documents)
SELECT k AS doc_id, value, CASE WHEN n THEN CAST(k % 10 AS DOUBLE) / 10 ELSE CAST(0.25 AS DOUBLE) END AS confidence, CASE WHEN st IN ('accepted', 'dismissed') THEN st WHEN k % 7 = 0 THEN 'accepted' ELSE 'suggested' END AS state FROM x WHERE st IN ('accepted', 'dismissed') OR n"""


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG7, MRG3: the last change of each key over the table."""
    base = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    changes = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), "o_orderkey")
    return lifecycle.upsert(base, changes, ["key"], "o_orderkey")


LAST = "WITH l AS (SELECT o_custkey AS key, o_orderpriority AS value FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) SELECT key, value FROM l UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT key FROM l)"


def array_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1, SET1, ARR1, ARR4: active parts of every order, tags joined and dropped, lists split in two."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("scans"))
    kept = F.filter("scans", lambda x: x % 3 != 0)
    active = lines.select(F.floor(F.col("l_orderkey") / 50).alias("tray"), F.col("l_orderkey").alias("pos"), F.when(F.size(kept) == 0, F.slice("scans", 1, 1)).otherwise(kept).alias("scans"), F.array_union(F.lit([1, 9]), "scans").alias("tags"))
    parts = lifecycle.split_at(active.select("tray", "pos", "scans"), ["tray"], "pos", "scans", (F.col("pos") % 3).cast("int"))
    return parts.select("tray", "pos", F.array_join(F.transform("scans", lambda x: x.cast("string")), ",").alias("scans"), F.col("part").cast("int").alias("part"))


ARRAYS = """WITH l AS (SELECT l_orderkey AS k, list_sort(list(l_linenumber)) AS s FROM lineitem GROUP BY l_orderkey), a AS (SELECT k, CASE WHEN len(list_filter(s, lambda x: x % 3 <> 0)) = 0 THEN s[1:1] ELSE list_filter(s, lambda x: x % 3 <> 0) END AS s, k % 3 AS c FROM l),
p AS (SELECT k, 0 AS part, CASE WHEN c > 0 AND c < len(s) THEN s[1:c] ELSE s END AS s FROM a UNION ALL SELECT k, 1, s[c + 1:] FROM a WHERE c > 0 AND c < len(s))
SELECT k // 50 AS tray, row_number() OVER (PARTITION BY k // 50 ORDER BY k, part) - 1 AS pos, array_to_string(s, ',') AS scans, part FROM p"""


def range_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN25, LIF1, LIF2: values carried over a range of places, locked items left out and counted."""
    rows = temporal.positions(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"])
    lo, hi = F.least(F.col("o_custkey") % 5, F.col("o_custkey") % 3), F.greatest(F.col("o_custkey") % 5, F.col("o_custkey") % 3)
    inside = (F.col("pos") >= lo) & (F.col("pos") <= hi)
    locked = F.col("o_orderkey") % 4 == 0
    out = rows.withColumn("value", F.when(inside & ~locked, "set").otherwise(F.col("o_orderstatus")))
    return out.select("o_orderkey", "value", F.count_if(inside & locked).over(W.partitionBy("o_custkey")).alias("left_out"))


RANGE = """WITH p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders), i AS (SELECT *, pos BETWEEN least(o_custkey % 5, o_custkey % 3) AND greatest(o_custkey % 5, o_custkey % 3) AS inside, o_orderkey % 4 = 0 AS locked FROM p)
SELECT o_orderkey, CASE WHEN inside AND NOT locked THEN 'set' ELSE o_orderstatus END AS value, count(*) FILTER (inside AND locked) OVER (PARTITION BY o_custkey) AS left_out FROM i"""


def undo_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG9: the state of each user's edits after undos and redos."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 == 0, "undo").when(F.col("event_id") % 9 == 0, "redo").otherwise("edit").alias("action"), "event_type")
    return lifecycle.undo_redo(rows, "user_id", "event_id", "action", "event_type")


UNDO = """WITH RECURSIVE e AS (SELECT user_id, event_type AS v, CASE WHEN event_id % 4 = 0 THEN 'undo' WHEN event_id % 9 = 0 THEN 'redo' ELSE 'edit' END AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, '' AS now, CAST([] AS VARCHAR[]) AS undo, CAST([] AS VARCHAR[]) AS redo FROM e
    UNION ALL SELECT e.user_id, e.k, CASE WHEN a = 'edit' THEN v WHEN a = 'undo' AND len(undo) > 0 THEN undo[-1] WHEN a = 'redo' AND len(redo) > 0 THEN redo[-1] ELSE now END,
        CASE WHEN a = 'edit' OR a = 'redo' AND len(redo) > 0 THEN list_append(undo, now) WHEN a = 'undo' AND len(undo) > 0 THEN undo[:-2] ELSE undo END,
        CASE WHEN a = 'edit' THEN [] WHEN a = 'undo' AND len(undo) > 0 THEN list_append(redo, now) WHEN a = 'redo' AND len(redo) > 0 THEN redo[:-2] ELSE redo END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, now AS event_type, len(undo) AS undos, len(redo) AS redos FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1"""


def cleanup_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT7: for each customer why its things can't be cleaned up yet."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.max("o_totalprice").alias("most"))
    reasons = F.array(F.when(F.col("open") > 0, F.concat(F.col("open").cast("string"), F.lit(" open"))), F.when(F.col("pending") > 0, "pending"), F.when(F.col("most") > 400000, "large"))
    return o.select("o_custkey", F.array_join(F.filter(reasons, lambda x: x.isNotNull()), "; ").alias("reasons"))


BLOCKERS = "WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS op, count(*) FILTER (o_orderstatus = 'P') AS pe, max(o_totalprice) AS mo FROM orders GROUP BY o_custkey) SELECT o_custkey, concat_ws('; ', CASE WHEN op > 0 THEN op || ' open' END, CASE WHEN pe > 0 THEN 'pending' END, CASE WHEN mo > 400000 THEN 'large' END) AS reasons FROM o"


def merged_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ4, PRJ5, PRJ6, PRJ7, ARR3: defaults merged and held to their range, neutral entries dropped before a key is made."""
    k = F.col("p_partkey")
    given = F.map_filter(F.create_map(F.lit("warmth"), F.when(k % 2 == 0, k % 300 / 100.0 - 1), F.lit("fade"), F.when(k % 3 == 0, k % 50 / 10.0 - 2.5), F.lit("angle"), F.when(k % 5 == 0, F.lit(0.0))), lambda n, v: v.isNotNull())
    defaults = F.create_map(F.lit("warmth"), F.lit(0.0), F.lit("fade"), F.lit(0.5), F.lit("angle"), F.lit(0.0))
    merged = F.map_zip_with(defaults, given, lambda n, d, g: F.greatest(F.least(F.coalesce(g, d), F.lit(1.0)), F.lit(-1.0)))
    lean = F.map_filter(merged, lambda n, v: ~v.eqNullSafe(F.element_at(defaults, n)))
    return read(spark, sf_dir, "part").select("p_partkey", F.element_at(merged, "warmth").alias("warmth"), F.element_at(merged, "fade").alias("fade"), F.array_join(F.array_sort(F.map_keys(lean)), ",").alias("changed"), F.coalesce(F.nullif(F.when(k % 4 == 0, F.col("p_brand")).otherwise(""), F.lit("")), F.nullif(F.col("p_type"), F.lit("")), F.lit("")).alias("stock"))


PARAMS = """WITH x AS (SELECT p_partkey, greatest(least(coalesce(CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 300 AS DOUBLE) / 100 - 1 END, 0), 1), -1) AS w, greatest(least(coalesce(CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 50 AS DOUBLE) / 10 - 2.5 END, CAST(0.5 AS DOUBLE)), 1), -1) AS f, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_type END AS stock FROM part)
SELECT p_partkey, CAST(w AS DOUBLE) AS warmth, CAST(f AS DOUBLE) AS fade, concat_ws(',', CASE WHEN f <> 0.5 THEN 'fade' END, CASE WHEN w <> 0 THEN 'warmth' END) AS changed, stock FROM x"""

QUERIES = {f.__name__: f for f in (slide_status, upload_plan, three_way_merge, remote_edits, merged_suggestions, last_wins, array_edits, range_update, undo_redo, cleanup_blockers, merged_params)}
ORACLES = {"slide_status": STATUS, "upload_plan": PLAN, "three_way_merge": MERGE, "remote_edits": EDITS, "merged_suggestions": SUGGESTIONS, "last_wins": LAST, "array_edits": ARRAYS, "range_update": RANGE, "undo_redo": UNDO, "cleanup_blockers": BLOCKERS, "merged_params": PARAMS}
