"""Queries on rows that are merged, changed, weak, due, shared or gone, and on the library's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions import checks, vectors
from loomline.functions import text as X
from loomline.operators import curation, gazetteer, people
from loomline.plans import places
from loomline.sources import library
from loomline.sources.shared import read, scratch


def _shown(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR2, SET1: every third order takes in its customer's next one: scans joined, tags united, uploads orphaned."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.array(k, k + 1).alias("scans"), F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("tags"), F.when(k % 2 == 0, k).alias("asset"))
    out = curation.merge_next(rows, ["o_custkey"], "o_orderkey", k % 3 == 0, ["scans"], ["tags"], "asset")
    return out.select("o_custkey", "o_orderkey", _shown("scans"), _shown("tags"), _shown("orphans"))


MERGED = """WITH o AS (SELECT *, coalesce(lag(o_orderkey) OVER w % 3 = 0, false) AS gone FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
g AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS head FROM o),
t AS (SELECT o_custkey, head, t, min(a) AS a FROM (SELECT o_custkey, head, o_orderstatus AS t, o_orderkey * 2 AS a FROM g UNION ALL SELECT o_custkey, head, substr(o_orderpriority, 1, 1), o_orderkey * 2 + 1 FROM g) GROUP BY ALL),
u AS (SELECT o_custkey, head, string_agg(t, ',' ORDER BY a) AS tags FROM t GROUP BY ALL)
SELECT o_custkey, min(o_orderkey) AS o_orderkey, string_agg(o_orderkey || ',' || (o_orderkey + 1), ',' ORDER BY o_orderkey) AS scans, any_value(tags) AS tags, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (gone AND o_orderkey % 2 = 0), '') AS orphans FROM g JOIN u USING (o_custkey, head) GROUP BY o_custkey, head"""


def changed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR6: what an edit of each order's lines changes; every seventh order gets one line more."""
    n = F.col("l_linenumber")
    disc, flag = F.col("l_discount").cast("string"), F.col("l_returnflag")
    before = F.create_map(F.lit("discount"), disc, F.lit("flag"), flag)
    after = F.map_filter(F.create_map(F.lit("discount"), F.when(n % 2 == 0, "none").otherwise(disc), F.lit("flag"), F.when(F.col("l_suppkey") % 3 == 0, "X").otherwise(flag), F.lit("extra"), F.when(F.col("l_partkey") % 5 == 0, "new")), lambda k, v: v.isNotNull())
    held = lambda m: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.map_entries(m).alias("m")))), lambda x: F.map_from_entries(x["m"]))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(held(before).alias("b"), held(after).alias("a"))
    longer = F.when(F.col("l_orderkey") % 7 == 0, F.concat("a", F.slice("a", 1, 1))).otherwise(F.col("a"))
    return rows.select("l_orderkey", curation.changed_keys(F.col("b"), longer).alias("label"))


CHANGED = """WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, concat_ws(',', CASE WHEN l_linenumber % 2 = 0 THEN 'discount' END, CASE WHEN l_partkey % 5 = 0 THEN 'extra' END, CASE WHEN l_suppkey % 3 = 0 AND l_returnflag <> 'X' THEN 'flag' END) AS k FROM lineitem)
SELECT l_orderkey, CASE WHEN l_orderkey % 7 <> 0 THEN 'local ' || coalesce(string_agg(i || ':' || k, ' ' ORDER BY i) FILTER (k <> ''), '') END AS label FROM l GROUP BY l_orderkey"""


def weak_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH11, AGG9: lines of an order that are clipped or blurry; one always stays."""
    rows = read(spark, sf_dir, "lineitem").withColumn("clipped", F.col("l_discount") * 9)
    return curation.weak_members(rows, ["l_orderkey"], "l_linenumber", "l_quantity", "clipped")


WEAK = """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, count(*) OVER w AS n, CASE WHEN l_discount * 9 > CAST(0.85 AS DOUBLE) THEN 'clipped' WHEN l_quantity < CAST(0.6 AS DOUBLE) * max(l_quantity) OVER w THEN 'blurry' END AS reason FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)),
p AS (SELECT *, count(reason) OVER (PARTITION BY l_orderkey) AS weak, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS place FROM r)
SELECT l_orderkey, l_linenumber, reason FROM p WHERE n > 1 AND reason IS NOT NULL AND NOT (weak = n AND place = 1)"""


def scene_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN11: the people of each scene, each once, at the median of what its faces say."""
    k = F.col("l_partkey")
    rows = read(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 8).alias("scene"), (k % 6).alias("person"), (1950 + k % 37 + 0.5).alias("year"), (1.0 + k % 5 / 2.0).alias("sd"), (0.5 + k % 6 / 4.0).alias("birth_sd"))
    out = curation.pooled_people(rows, "scene", "person", "year", "sd", "birth_sd")
    return out.select("scene", "person", F.round("year", 6).alias("year"), F.round("sd", 6).alias("sd"), "n")


SCENE = """WITH x AS (SELECT l_orderkey // 8 AS scene, l_partkey % 6 AS person, 1950 + l_partkey % 37 + CAST(0.5 AS DOUBLE) AS year, 1 + CAST(l_partkey % 5 AS DOUBLE) / 2 AS sd, CAST(0.5 AS DOUBLE) + CAST(l_partkey % 6 AS DOUBLE) / 4 AS b FROM lineitem),
g AS (SELECT scene, person, median(year) AS year, median(sd) / sqrt(least(count(*), 3)) AS s, min(b) AS b, count(*) AS n FROM x GROUP BY ALL)
SELECT scene, person, round(year, 6) AS year, round(sqrt(s * s + b * b), 6) AS sd, n FROM g"""


def stale_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM3, FLT6: per tray how much is stale and what is done next: slides before scans before eyes; skipped ones never."""
    k = F.col("vec_id")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.floor(k / 50).alias("tray"), (k % 11 == 0).alias("skip"))
    return curation.due_work(rows, "tray", "vec_id", [("slide", (k % 97 == 5) & (k % 3 == 0)), ("scan", k % 29 == 4), ("eyes", k % 13 == 7)], F.col("skip"))


STALE = """WITH w AS (SELECT vec_id // 50 AS tray, vec_id, unnest(list_filter([CASE WHEN vec_id % 97 = 5 AND vec_id % 3 = 0 THEN '0slide' END, CASE WHEN vec_id % 29 = 4 THEN '1scan' END, CASE WHEN vec_id % 13 = 7 THEN '2eyes' END], lambda x: x IS NOT NULL)) AS kind FROM embeddings WHERE vec_id % 11 <> 0)
SELECT tray, count(*) OVER (PARTITION BY tray) AS pending, substr(kind, 2) AS kind, vec_id FROM w QUALIFY row_number() OVER (PARTITION BY tray ORDER BY kind, vec_id) = 1"""


def collapsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR11: each user's events as a line read step by step, repeats and blanks dropped."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 7 % 5).cast("int").alias("symbol"), (F.col("event_id") % 10 / 10.0).alias("sure"))
    return curation.collapsed(rows, ["user_id"], "event_id", "symbol", "sure", ["a", "b", " "]).select("user_id", "text", F.round("confidence", 9).alias("confidence"))


COLLAPSED = """WITH e AS (SELECT user_id, event_id, event_id * 7 % 5 AS s, CAST(event_id % 10 AS DOUBLE) / 10 AS c FROM events), n AS (SELECT *, s <> coalesce(lag(s) OVER (PARTITION BY user_id ORDER BY event_id), 0) AND s BETWEEN 1 AND 3 AS new FROM e)
SELECT user_id, trim(coalesce(string_agg(['a', 'b', ' '][s], '' ORDER BY event_id) FILTER (new), '')) AS text, round(coalesce(avg(c) FILTER (new), 0), 9) AS confidence FROM n GROUP BY user_id"""


def visible_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET4: own and shared albums, each once, the own entry first."""
    c = read(spark, sf_dir, "customer")
    own = c.where("c_nationkey < 15").select("c_custkey", F.lit("own").alias("list"), F.col("c_name").alias("album"))
    shared = c.where("c_nationkey >= 8").select("c_custkey", F.lit("shared").alias("list"), F.col("c_mktsegment").alias("album"))
    return curation.first_of([own, shared], "c_custkey")


ALBUMS = "SELECT c_custkey, CASE WHEN c_nationkey < 15 THEN 'own' ELSE 'shared' END AS list, CASE WHEN c_nationkey < 15 THEN c_name ELSE c_mktsegment END AS album FROM customer"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET5: boxes that are numbered or hold a tray, with their trays by side."""
    known = read(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("number"), F.col("n_name").alias("writing"))
    inside = read(spark, sf_dir, "supplier").where("s_nationkey % 4 <> 1").groupBy(F.col("s_nationkey").alias("number"), F.when(F.col("s_suppkey") % 2 == 0, "a").otherwise("b").alias("side")).agg(F.max("s_suppkey").alias("tray"))
    trays = inside.groupBy("number").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "side", F.col("tray").cast("string")))), ",").alias("trays"))
    return known.join(trays, "number", "full").select("number", F.coalesce("writing", F.lit("")).alias("writing"), F.coalesce("trays", F.lit("")).alias("trays"))


BOXES = """WITH t AS (SELECT s_nationkey AS number, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS side, max(s_suppkey) AS tray FROM supplier WHERE s_nationkey % 4 <> 1 GROUP BY ALL), g AS (SELECT number, string_agg(side || '=' || tray, ',' ORDER BY side) AS trays FROM t GROUP BY number),
n AS (SELECT n_nationkey AS number, n_name AS writing FROM nation WHERE n_nationkey % 3 <> 0)
SELECT number, coalesce(writing, '') AS writing, coalesce(trays, '') AS trays FROM n FULL JOIN g USING (number)"""


def trash_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET8, JN18: what skipped orders alone refer to, by customer: parts that no kept order of theirs uses."""
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey", (F.col("o_orderstatus") == "F").alias("skip"))
    return rows.where("skip").select("o_custkey", "l_partkey").distinct().join(rows.where("NOT skip").select("o_custkey", "l_partkey"), ["o_custkey", "l_partkey"], "left_anti")


TRASH = "WITH r AS (SELECT o_custkey, l_partkey, o_orderstatus = 'F' AS skip FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT o_custkey, l_partkey FROM r WHERE skip EXCEPT SELECT o_custkey, l_partkey FROM r WHERE NOT skip"


def by_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT7: each customer's things by when they were taken, undated ones last, as they came otherwise."""
    taken = F.when(F.col("o_orderkey") % 4 != 0, F.to_date("o_orderdate"))
    order = W.partitionBy("o_custkey").orderBy(F.asc_nulls_last("taken"), "o_orderkey")
    return read(spark, sf_dir, "orders").withColumn("taken", taken).select("o_custkey", "o_orderkey", "taken", F.row_number().over(order).cast("long").alias("place"))


TAKEN = "WITH t AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS taken FROM orders) SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY taken ASC NULLS LAST, o_orderkey) AS place FROM t"


def tray_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR13, HSH1: the tag that a tray's pictures carry, and a key of what it holds."""
    name = F.when(F.col("p_partkey") % 9 == 0, "  ").when(F.col("p_partkey") % 10 != 0, F.concat_ws("/", "p_brand", "p_name"))
    key = X.content_key(F.col("p_brand"), F.col("p_size"))
    return read(spark, sf_dir, "part").select("p_partkey", X.tray_tag(name).alias("tag"), key.alias("key"))


TAGS = """SELECT p_partkey, 'Trays/' || coalesce(nullif(trim(replace(CASE WHEN p_partkey % 9 = 0 THEN '  ' WHEN p_partkey % 10 <> 0 THEN p_brand || '/' || p_name END, '/', '-')), ''), 'Untitled tray') AS tag,
    substr(sha1('["' || p_brand || '","' || p_size || '"]'), 1, 12) AS key FROM part"""


def place_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN27, JN10, JN11, SRT1: what the place field offers: typed coordinates, named after the nearest city, else cities by prefix."""
    k = F.col("p_partkey")
    typed = F.concat_ws(", ", (k * 13 % 1200 / 10 - 60).cast("string"), (k * 29 % 3600 / 10 - 180).cast("string"))
    asked = read(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, typed).otherwise(F.substring("p_name", 1, 4)).alias("q")).withColumn("at", X.parse_coords(F.col("q")))
    cities = places.cities(spark, sf_dir)
    points = asked.where("at IS NOT NULL").select("p_partkey", F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"))
    near = gazetteer.nearest_city(points, cities, "p_partkey", "lat", "lon", 300.0)
    named = points.join(near, "p_partkey", "left").select("p_partkey", F.col("city_id"), F.when(F.col("city_id").isNull(), X.coords_label(F.col("lat"), F.col("lon"))).otherwise("").alias("label"), F.lit(1).cast("long").alias("rank"))
    texts = asked.where("at IS NULL").select("p_partkey", "q")
    words = texts.select("q", F.col("q").alias("t")).distinct()
    found = texts.join(gazetteer.prefix_search(words, gazetteer.city_keys(places.gazetteer_rows(spark, sf_dir)), "q", "t"), "q")
    return named.unionByName(found.select("p_partkey", "city_id", F.lit("").alias("label"), F.col("rank").cast("long").alias("rank")))


_AT = "CAST(p_partkey * 13 % 1200 AS DOUBLE) / 10 - 60 AS lat, CAST(p_partkey * 29 % 3600 AS DOUBLE) / 10 - 180 AS lon"
SEARCH = f"""WITH c AS (SELECT s_suppkey AS city_id, {places.POINT.format(k='s_suppkey')} FROM supplier), p AS (SELECT p_partkey, {_AT} FROM part WHERE p_partkey % 3 = 0),
d AS (SELECT p_partkey, city_id, 12742 * asin(sqrt(pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2))) AS km FROM p, c),
b AS (SELECT p_partkey, city_id FROM d WHERE km <= 300 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY km, city_id) = 1),
f AS ({places.PREFIX.replace("substr(p_name, 1, 5)", "substr(p_name, 1, 4)")})
SELECT p_partkey, city_id, CASE WHEN city_id IS NULL THEN printf('%.4f, %.4f', lat, lon) ELSE '' END AS label, CAST(1 AS BIGINT) AS rank FROM p LEFT JOIN b USING (p_partkey)
UNION ALL SELECT p_partkey, city_id, '', rank FROM f WHERE p_partkey % 3 <> 0"""


def scan_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6, SRC7, STR12: the scans among a card's files and their quick fingerprints."""
    k = F.col("o_orderkey")
    end = F.get(F.array(*[F.lit(x) for x in ("jpg", "NEF", "txt", "JPG", "tiff")]), (k % 5).cast("int"))
    folder = F.when(k % 17 == 0, "/card/.trash/").otherwise(F.concat(F.lit("/card/"), (k % 3).cast("string"), F.lit("/")))
    name = F.concat(F.when(k % 13 == 0, "._").otherwise(""), F.lit("scan"), F.floor(k / 2).cast("string"), F.lit("."), end)
    files = read(spark, sf_dir, "orders").select(F.concat(folder, name).alias("path"), (k * 1000).alias("size"), (k * 1.5).alias("modified"))
    kept = library.scan_files(files)
    return kept.select("path", library.quick_fingerprint(F.element_at(F.split("path", "/"), -1), F.col("size"), F.col("modified")).alias("fingerprint"))


LISTING = """WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN '/card/.trash/' ELSE '/card/' || (o_orderkey % 3) || '/' END AS dir, CASE WHEN o_orderkey % 13 = 0 THEN '._' ELSE '' END || 'scan' || (o_orderkey // 2) AS stem, ['jpg', 'NEF', 'txt', 'JPG', 'tiff'][o_orderkey % 5 + 1] AS e FROM orders),
v AS (SELECT * FROM f WHERE NOT starts_with(stem, '.') AND dir <> '/card/.trash/' AND e <> 'txt')
SELECT dir || stem || '.' || e AS path, stem || '.' || e || ':' || (k * 1000) || ':' || CAST(floor(k * CAST(1.5 AS DOUBLE)) AS BIGINT) AS fingerprint FROM v WHERE e = 'NEF' OR NOT EXISTS (SELECT 1 FROM v r WHERE r.e = 'NEF' AND r.dir = v.dir AND lower(r.stem) = lower(v.stem))"""


def stored_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, SRC2, SRC5: tray documents, one for each nation, written as JSON and read back as slides; unreadable documents are left out."""
    c = read(spark, sf_dir, "customer")
    slide = F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("id"), F.array(F.col("c_name")).alias("scans"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("19"), (10 + F.col("c_custkey") % 90).cast("string"))).alias("date"), (F.col("c_custkey") % 2 == 0).alias("reviewed"))
    trays = c.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(slide)).alias("groups"))
    whole = F.to_json(F.struct(F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("id"), F.lit("").alias("date"), F.transform("groups", lambda g: g.dropFields("k")).alias("groups")))
    path = scratch(spark, "trays")
    broken = F.when(F.col("c_nationkey") % 7 == 3, F.lit("{broken")).otherwise(whole)
    trays.select(broken.alias("value"), F.col("c_nationkey").alias("tray")).write.partitionBy("tray").text(path)
    return library.slides(library.trays(spark, path, "*.txt")).select("tray_id", "pos", "slide_id", "date", "reviewed")


STORED = """SELECT 't' || c_nationkey AS tray_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, c_name AS slide_id, CASE WHEN c_custkey % 3 <> 0 THEN '19' || (10 + c_custkey % 90) END AS date, c_custkey % 2 = 0 AS reviewed FROM customer WHERE c_nationkey % 7 <> 3"""


def gazetteer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8, JN2: cities, countries and regions written as tab-separated files and read back joined."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    path = scratch(spark, "gazetteer")
    nation = lambda c: F.concat(F.lit("N"), c.cast("string"))
    known = {"id": F.col("s_suppkey").cast("string"), "name": F.col("s_name"), "ascii": F.col("s_name"), "alts": F.when(F.col("s_suppkey") % 2 == 0, F.lit("x,y")).otherwise(""), "lat": F.lit("1.5"), "lon": F.lit("2.5"), "cc": nation(F.col("s_nationkey")), "admin1": (F.col("s_suppkey") % 3).cast("string"), "pop": (F.col("s_suppkey") * 10).cast("string")}
    line = F.concat_ws("\t", *[known.get(x, F.lit("")) for x in library.CITY_COLUMNS])
    s.select(line.alias("value")).unionByName(spark.createDataFrame([("# comment",), ("short\trow",)], "value string")).write.text(f"{path}/cities")
    n.select(F.concat_ws("\t", nation(F.col("n_nationkey")), F.lit("-"), F.lit("-"), F.lit("-"), "n_name").alias("value")).write.text(f"{path}/countries")
    r.select(F.concat_ws("\t", F.concat(F.lit("N1."), F.col("r_regionkey").cast("string")), "r_name").alias("value")).write.text(f"{path}/regions")
    found = library.gazetteer(spark, f"{path}/cities", f"{path}/countries", f"{path}/regions", least_rows=1)
    return found.select("city_id", "name", F.size("alts").alias("alts"), "country", "admin", "pop")


GAZETTEER = "SELECT s_suppkey AS city_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 0 END AS alts, n_name AS country, CASE WHEN s_nationkey = 1 THEN r_name ELSE '' END AS admin, s_suppkey * 10 AS pop FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = s_suppkey % 3"


def committed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1, SNK2, MRG3: results saved only for rows that are as they were, in a table that is replaced as a whole."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit("old").alias("state"))
    made = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("gone").alias("o_orderstatus"), F.lit("new").alias("state"))
    path = scratch(spark, "rows")
    library.replace_table(o, path)
    library.replace_table(library.commit_if_unchanged(library.current_table(spark, path), made, "o_orderkey", "o_orderstatus", ["state"]), path)
    return library.current_table(spark, path)


COMMITTED = "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 6 = 0 THEN 'new' ELSE 'old' END AS state FROM orders"


def assigned_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG8: whose each face is after a batch of edits, who is rejected, what is sure."""
    owners = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("face"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") % 20).alias("person"))
    rejected = owners.where("face % 3 = 0").select("face", (F.col("face") % 7).alias("person"))
    k = F.col("l_partkey")
    edits = read(spark, sf_dir, "lineitem").where("l_orderkey % 4 <> 0").select(F.col("l_orderkey").alias("face"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"), F.when(k % 4 != 0, k % 20).alias("person"), (F.col("l_suppkey") % 2 == 0).alias("age_off"))
    return people.assign_faces(owners, rejected, edits).select("face", "person", _shown("rejected"), "sure", "age_off")


ASSIGNED = """WITH o AS (SELECT o_orderkey AS face, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 20 END AS person FROM orders),
e AS (SELECT l_orderkey AS face, list(CASE WHEN l_partkey % 4 <> 0 THEN l_partkey % 20 END ORDER BY l_linenumber, l_partkey, l_suppkey) AS tos, list(l_suppkey % 2 = 0 ORDER BY l_linenumber, l_partkey, l_suppkey) AS offs FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY l_orderkey),
x AS (SELECT o.face, o.person AS first, tos, offs, CASE WHEN tos IS NULL THEN o.person ELSE tos[-1] END AS now, CASE WHEN len(tos) > 1 THEN tos[-2] ELSE o.person END AS had FROM o LEFT JOIN e USING (face))
SELECT face, now AS person, array_to_string(list_sort(list_distinct(list_filter(list_concat([first, CASE WHEN face % 3 = 0 THEN face % 7 END], coalesce(tos, [])), lambda p: p IS NOT NULL AND p IS DISTINCT FROM now))), ',') AS rejected,
    tos IS NOT NULL AND now IS NOT NULL AS sure, coalesce(tos IS NOT NULL AND offs[-1] AND now = had, false) AS age_off FROM x"""


def slide_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT11: faces of each slide from left to right with their web addresses, those of ignored people left out; no box where the slide was turned since."""
    k = F.col("p_partkey")
    slide = F.floor(k / 6)
    part = read(spark, sf_dir, "part")
    faces = part.select(slide.alias("slide"), "p_partkey", F.array(k * 37 % 101 / 100.0, F.lit(0.5)).alias("box"), F.when(slide % 5 == 0, 90).otherwise(0).alias("turn"))
    slides = part.select(slide.alias("slide"), F.lit(0).alias("turn"), (slide % 9).cast("string").alias("look")).distinct()
    owners = part.where(k % 4 == 0).select("p_partkey", (k % 50).alias("person"), F.lit(False).alias("ignored")).unionByName(part.where(k % 13 == 0).select("p_partkey", F.lit(-1).cast("long").alias("person"), F.lit(True).alias("ignored")))
    owners = owners.groupBy("p_partkey").agg(F.min("person").alias("person"), F.max("ignored").alias("ignored"))
    found = people.faces_on_slides(faces, slides, owners, "slide", "p_partkey")
    return found.select("slide", "place", "p_partkey", F.get("box", F.lit(0)).alias("left"), "person", "url")


FACES = """SELECT p_partkey // 6 AS slide, row_number() OVER (PARTITION BY p_partkey // 6 ORDER BY CAST(p_partkey * 37 % 101 AS DOUBLE) / 100, p_partkey) AS place, p_partkey, CASE WHEN p_partkey // 6 % 5 <> 0 THEN CAST(p_partkey * 37 % 101 AS DOUBLE) / 100 END AS "left",
    CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 50 END AS person, '/api/people/faces/' || p_partkey || '.jpg?v=' || (p_partkey // 6 % 9) AS url FROM part WHERE p_partkey % 13 <> 0"""


def album_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN29: the pictures of each album by date and name, marked where a tray has them already; videos and trash left out."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    pulled = li.groupBy("l_orderkey").agg(F.max("l_suppkey").alias("tray")).where("l_orderkey % 3 = 0")
    assets = o.where("o_orderstatus <> 'P' AND o_orderkey % 10 <> 0").join(pulled, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("day", F.to_date("o_orderdate"))
    return assets.select(F.col("o_custkey").alias("album"), "o_orderkey", "day", "tray", F.row_number().over(W.partitionBy("o_custkey").orderBy("day", "o_orderkey")).cast("long").alias("place"))


ASSETS = """WITH p AS (SELECT l_orderkey, max(l_suppkey) AS tray FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey)
SELECT o_custkey AS album, o_orderkey, CAST(o_orderdate AS DATE) AS day, tray, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS place FROM orders LEFT JOIN p ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND o_orderkey % 10 <> 0"""


def remote_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ11, VAL1: a remote picture's position and town as a place, or none."""
    k = F.col("p_partkey")
    lat, lon = F.when(k % 7 != 0, k * 13 % 2000 / 10.0 - 100), F.when(k % 11 != 0, k * 29 % 3800 / 10.0 - 190)
    at = checks.clean_place(F.when(k % 3 != 0, F.col("p_brand")), lat, lon, F.when(k % 2 == 0, F.col("p_type")))
    return read(spark, sf_dir, "part").select("p_partkey", at.alias("at")).select("p_partkey", F.col("at.name").alias("name"), F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"), F.col("at.country").alias("country"))


REMOTE = """WITH x AS (SELECT *, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey * 13 % 2000 AS DOUBLE) / 10 - 100 END AS la, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey * 29 % 3800 AS DOUBLE) / 10 - 190 END AS lo FROM part), v AS (SELECT *, coalesce(abs(la) <= 90 AND abs(lo) <= 180, false) AS ok FROM x)
SELECT p_partkey, CASE WHEN ok THEN CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE printf('%.4f, %.4f', la, lo) END END AS name, CASE WHEN ok THEN round(la, 5) END AS lat, CASE WHEN ok THEN round(lo, 5) END AS lon, CASE WHEN ok THEN CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END END AS country FROM v"""


def face_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH16, MTH17: pixel boxes of faces and bodies, and the balance that makes a spot grey."""
    k = F.col("p_partkey")
    face, body = vectors.age_boxes([k % 90 / 100.0, k % 80 / 100.0, (k % 20 + 1) / 100.0, (k % 15 + 1) / 100.0], F.lit(1201), F.lit(803))
    warmth, tint = vectors.neutral_balance(k % 100 / 100.0, k % 90 / 90.0, k % 70 / 70.0)
    return read(spark, sf_dir, "part").select("p_partkey", _joined(face).alias("face"), _joined(body).alias("body"), warmth.alias("warmth"), tint.alias("tint"))


def _joined(box: list):
    return F.concat_ws(",", *[c.cast("string") for c in box])


CROPS = """WITH x AS (SELECT p_partkey, CAST(p_partkey % 90 AS DOUBLE) / 100 * 1201 AS x, CAST(p_partkey % 80 AS DOUBLE) / 100 * 803 AS y, CAST(p_partkey % 20 + 1 AS DOUBLE) / 100 * 1201 AS w, CAST(p_partkey % 15 + 1 AS DOUBLE) / 100 * 803 AS h,
    ln(greatest(least(CAST(p_partkey % 100 AS DOUBLE) / 100, 0.98), 0.02)) AS lr, ln(greatest(least(CAST(p_partkey % 90 AS DOUBLE) / 90, 0.98), 0.02)) AS lg, ln(greatest(least(CAST(p_partkey % 70 AS DOUBLE) / 70, 0.98), 0.02)) AS lb FROM part),
y AS (SELECT *, x AS l1, y AS t1, x + w AS r1, y + h AS b1, x + w / 2 - 1.5 * w AS l2, y - 0.3 * h AS t2, x + w / 2 + 1.5 * w AS r2, y + 6.5 * h AS b2, greatest(least(4 * (lr - lb) / (lr + lb), 1), -1) AS warm FROM x),
z AS (SELECT *, trunc(greatest(l1, 0))::INT AS a1, trunc(greatest(t1, 0))::INT AS c1, trunc(greatest(l2, 0))::INT AS a2, trunc(greatest(t2, 0))::INT AS c2 FROM y)
SELECT p_partkey, a1 || ',' || c1 || ',' || greatest(trunc(least(r1, 1201))::INT, a1 + 1) || ',' || greatest(trunc(least(b1, 803))::INT, c1 + 1) AS face, a2 || ',' || c2 || ',' || greatest(trunc(least(r2, 1201))::INT, a2 + 1) || ',' || greatest(trunc(least(b2, 803))::INT, c2 + 1) AS body,
    round(warm, 3) + 0 AS warmth, round(greatest(least(4 * (lr * (1 - CAST(0.25 AS DOUBLE) * warm) / lg - 1), 1), -1), 3) + 0 AS tint FROM z"""

QUERIES = {f.__name__: f for f in (merged_rows, changed_labels, weak_scans, scene_people, stale_work, collapsed_lines, visible_albums, boxes, trash_plan, by_taken, tray_tags, place_search, scan_listing, stored_slides, gazetteer_files, committed_rows, assigned_faces, slide_faces, album_assets, remote_places, face_crops)}
ORACLES = {
    "merged_rows": MERGED, "changed_labels": CHANGED, "weak_scans": WEAK, "scene_people": SCENE, "stale_work": STALE, "collapsed_lines": COLLAPSED, "visible_albums": ALBUMS, "boxes": BOXES, "trash_plan": TRASH, "by_taken": TAKEN,
    "tray_tags": TAGS, "place_search": SEARCH, "scan_listing": LISTING, "stored_slides": STORED, "gazetteer_files": GAZETTEER, "committed_rows": COMMITTED, "assigned_faces": ASSIGNED, "slide_faces": FACES, "album_assets": ASSETS,
    "remote_places": REMOTE, "face_crops": CROPS,
}
