"""Queries on files and documents of their own kinds: camera headers, side documents, half floats, export names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import documents, text, vectors
from loomline.operators import naming, repeats
from loomline.sources import headers, library
from loomline.sources.shared import read, scratch


#: Parts whose pictures lie in one folder.
FOLDER_PARTS = 4096


def camera_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9: headers written for each part, in both byte orders, some inside a JPEG, some cut, of an unknown kind or leading back to themselves, and read back.

    Each folder of some thousand pictures is written by one task and listed and read by one, so the driver sees folders only.
    """
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", (1 / (k % 1000 + 1)).alias("exposure"), (k % 200 / 10).alias("fnumber"), (k % 6400).alias("iso"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, contents = [], []
            for r in b.to_pylist():
                n = r["p_partkey"]
                data = headers.header_bytes({"make": r["p_brand"], "model": r["p_type"] if n % 4 else None, "datetime": "2024:01:02 03:04:05", "exposure": r["exposure"], "fnumber": r["fnumber"], "iso": r["iso"]}, "<>"[n % 2])
                loop = data[:4] + (0).to_bytes(4, "little")
                data = {1: data[:20], 2: b"PNG." + data, 3: loop, 4: b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + (len(data) + 8).to_bytes(2, "big") + b"Exif\0\0" + data}.get(n % 11, data)
                names.append(f"{n // FOLDER_PARTS}/p{n}.tif"), contents.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents, pa.binary())], ["name", "content"])

    folder = scratch(spark, "pictures")
    rows = rows.repartition(1 + rows.count() // FOLDER_PARTS, F.floor(k / FOLDER_PARTS))
    headers.write_files(rows.mapInArrow(build, "name string, content binary"), folder)
    found = headers.picture_headers(spark, folder, "path string, make string, model string, datetime string, exposure double, fnumber double, iso long")
    return found.select(F.regexp_extract("path", r"p(\d+)\.tif$", 1).cast("long").alias("p_partkey"), "make", "model", "datetime", F.round("exposure", 9).alias("exposure"), "fnumber", "iso")


HEADERS = """WITH p AS (SELECT *, p_partkey % 11 NOT IN (1, 2, 3) AS ok FROM part)
SELECT p_partkey, CASE WHEN ok THEN p_brand END AS make, CASE WHEN ok AND p_partkey % 4 <> 0 THEN p_type END AS model, CASE WHEN ok THEN '2024:01:02 03:04:05' END AS datetime,
    CASE WHEN ok THEN round(1 / CAST(p_partkey % 1000 + 1 AS DOUBLE), 9) END AS exposure, CASE WHEN ok THEN CAST(p_partkey % 200 AS DOUBLE) / 10 END AS fnumber, CASE WHEN ok THEN p_partkey % 6400 END AS iso FROM p"""

def _documents(spark: SparkSession, sf_dir: str, name: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Documents written for most nations, each in its own folder, and read back for all of them; some are damaged, some missing."""
    c = read(spark, sf_dir, "customer")
    tray = F.concat(F.lit("t"), F.col("c_nationkey").cast("string"))
    held = made(c.withColumn("tray", tray)).where("tray <> 't3'").select(F.concat("tray", F.lit("/" + name)).alias("name"), F.when(F.col("tray") == "t5", F.concat(F.lit("{,"), "text")).otherwise(F.col("text")).cast("binary").alias("content"))
    path = scratch(spark, "documents")
    headers.write_files(held, path)
    ids = c.select(tray.alias("id")).distinct()
    return library.side_documents(spark, path, name, ids)


def side_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3, ARR5: people documents of each tray with their defaults where they are missing or damaged, as values and written again, all numbers as they were."""

    def made(c: DataFrame) -> DataFrame:
        person = F.concat(F.lit('"p'), F.col("c_custkey").cast("string"), F.lit('":{"share":'), (F.col("c_custkey") % 10).cast("string"), F.lit('.50,"size":2e'), (F.col("c_custkey") % 9).cast("string"), F.lit("}"))
        each = c.groupBy("tray").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("p"), F.col("c_custkey").cast("string")), person.alias("p")))), lambda s: s["p"]), ",").alias("people"), F.count("*").alias("n"))
        more = F.when(F.col("n") % 2 == 0, F.concat(F.lit('"next": '), F.col("n").cast("string"), F.lit(".0, "))).otherwise("")
        return each.select("tray", F.concat(F.lit('{"version": 1.0, '), more, F.lit('"people": {'), "people", F.lit("}}")).alias("text"))

    rows = _documents(spark, sf_dir, "people.json", made).select("id", documents.people(F.col("text")).alias("d"), documents.filled(F.col("text"), "people").alias("written"))
    return rows.select("id", F.size("d.people").cast("long").alias("people"), F.col("d.next").alias("next"), F.size("d.ages_off").cast("long").alias("ages_off"), "written")


SIDE = """WITH c AS (SELECT 't' || c_nationkey AS id, string_agg('"p' || c_custkey || '":{"share":' || (c_custkey % 10) || '.50,"size":2e' || (c_custkey % 9) || '}', ',' ORDER BY 'p' || c_custkey) AS people, count(*) AS n FROM customer GROUP BY 1),
d AS (SELECT *, id NOT IN ('t3', 't5') AS ok FROM c)
SELECT id, CASE WHEN ok THEN n ELSE 0 END AS people, CASE WHEN ok AND n % 2 = 0 THEN n ELSE 1 END AS next, CAST(0 AS BIGINT) AS ages_off,
    '{"ages_off":[],"next":' || CASE WHEN ok AND n % 2 = 0 THEN n || '.0' ELSE '1' END || ',"people":{' || CASE WHEN ok THEN people ELSE '' END || '},"rejected":{}' || CASE WHEN ok THEN ',"version":1.0' ELSE '' END || '}' AS written FROM d"""


def side_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3: numbered boxes of each tray's document, with the usual size and no writing where none is told."""

    def made(c: DataFrame) -> DataFrame:
        size = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit('"size": '), (F.col("c_custkey") % 60).cast("string"))).otherwise('"old": null')
        box = F.concat(F.lit('"'), F.col("c_custkey").cast("string"), F.lit('": {'), size, F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(', "writing": "'), "c_mktsegment", F.lit('"'))).otherwise(""), F.lit("}"))
        return c.groupBy("tray").agg(F.concat(F.lit('{"boxes": {'), F.array_join(F.collect_list(box), ", "), F.lit("}}")).alias("text"))

    rows = _documents(spark, sf_dir, "boxes.json", made)
    return rows.select("id", F.explode(documents.boxes(F.col("text"))).alias("box", "held")).select("id", F.col("box").cast("long").alias("box"), "held.size", "held.writing")


SIDE_BOXES = """SELECT 't' || c_nationkey AS id, c_custkey AS box, CAST(CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 60 ELSE 50 END AS INTEGER) AS size, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS writing FROM customer WHERE c_nationkey NOT IN (3, 5)"""


def stored_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4, HSH3, MTH2: faces of each tray with their vectors as packed half floats, written as JSON documents and read back as one relation, the vectors at unit length."""
    e = read(spark, sf_dir, "embeddings")
    face = F.struct(F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("id"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.125), F.lit(1.0)).alias("box"), (F.col("vec_id") % 8 / 8).alias("score"), library.packed_halves(F.col("embedding")).alias("emb"))
    slides = e.groupBy("label", F.floor(F.col("vec_id") / 7).alias("slide")).agg(F.struct(F.lit("k").alias("key"), F.collect_list(face).alias("faces")).alias("v"))
    trays = slides.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("s"), F.col("slide").cast("string")), "v"))).alias("slides"))
    path = scratch(spark, "faces")
    headers.write_files(trays.select(F.concat(F.lit("t"), F.coalesce(F.col("label").cast("string"), F.lit("")), F.lit("/faces.json")).alias("name"), F.to_json(F.struct("slides")).cast("binary").alias("content")), path)
    unit = vectors.normalised(F.col("emb"))
    return library.faces(spark, path).select("tray_id", "slide_id", "face_id", "score", F.col("emb").getItem(0).cast("double").alias("first"), F.round(unit.getItem(1), 6).alias("second"))


STORED_FACES = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
h AS (SELECT *, list_transform(e, lambda x: CASE WHEN x = 0 THEN x ELSE round_even(x * pow(2, 10 - greatest(floor(log2(abs(x))), -14)), 0) / pow(2, 10 - greatest(floor(log2(abs(x))), -14)) END) AS r FROM v)
SELECT 't' || coalesce(label::VARCHAR, '') AS tray_id, 's' || (vec_id // 7) AS slide_id, 'f' || vec_id AS face_id, CAST(vec_id % 8 AS DOUBLE) / 8 AS score, r[1] AS first, round(r[2] / sqrt(list_dot_product(r, r)), 6) AS second FROM h"""


def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: file names of exports, numbered where they clash with each other or with names that are there, also where a name looks numbered."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    slug = text.slugify(F.lower(F.col("o_orderpriority")))
    wanted = F.when(F.col("o_orderkey") % 9 == 0, F.concat(slug, F.lit("-"), (F.col("o_orderkey") % 60).cast("string"))).otherwise(slug)
    there = c.select(F.concat(F.lit("2-high-"), (F.col("c_custkey") % 200 * 3).cast("string")).alias("name")).unionByName(spark.createDataFrame([("5-low",)], "name string"))
    found = naming.free_names(o.select("o_orderkey", wanted.alias("name")), there, "o_orderkey", "name")
    return found.select("o_orderkey", F.concat("name", F.lit(".jpg")).alias("name"))


EXPORT_NAMES = """WITH i AS (SELECT o_orderkey AS k, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9_-]+', '-', 'g'), '-') || CASE WHEN o_orderkey % 9 = 0 THEN '-' || (o_orderkey % 60) ELSE '' END AS stem FROM orders),
t AS (SELECT DISTINCT '2-high-' || (c_custkey % 200 * 3) AS stem FROM customer UNION SELECT '5-low'),
r AS (SELECT k, i.stem, row_number() OVER (PARTITION BY i.stem ORDER BY k) - 1 + (t.stem IS NOT NULL)::INT AS place FROM i LEFT JOIN t ON t.stem = i.stem),
m AS (SELECT stem, max(place) + (SELECT count(*) FROM i) // 9 + (SELECT count(*) FROM t) + 10 AS most FROM r WHERE place > 0 GROUP BY stem),
f AS (SELECT m.stem, n, row_number() OVER (PARTITION BY m.stem ORDER BY n) AS place FROM m, LATERAL (SELECT unnest(range(2, most::BIGINT)) AS n) ANTI JOIN (SELECT stem AS name FROM i UNION SELECT stem FROM t) u ON u.name = m.stem || '-' || n)
SELECT k AS o_orderkey, r.stem || CASE WHEN r.place = 0 THEN '' ELSE '-' || f.n END || '.jpg' AS name FROM r LEFT JOIN f ON f.stem = r.stem AND f.place = r.place"""


def banned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR10: the words that may not go on a conversation, since they would repeat two words in a row that it has."""
    words = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.lower("text"), " ")).alias("at", "word"))
    return repeats.banned_next(words.withColumn("word", F.nullif(F.col("word"), F.lit(""))), ["conv_id"], ["turn", "at"], "word", n=2)


BANNED = """WITH w AS (SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS word, generate_subscripts(string_split(lower(text), ' '), 1) AS place FROM conversations),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, place) AS pos, nullif(word, '') AS word FROM w), n AS (SELECT conv_id, max(pos) AS n FROM s GROUP BY conv_id)
SELECT DISTINCT a.conv_id, b.word FROM n JOIN s y ON y.conv_id = n.conv_id AND y.pos = n.n JOIN s a ON a.conv_id = n.conv_id AND a.word = y.word JOIN s b ON b.conv_id = a.conv_id AND b.pos = a.pos + 1 AND b.word IS NOT NULL"""

QUERIES = {f.__name__: f for f in (camera_headers, side_documents, side_boxes, stored_faces, export_names, banned_words)}
ORACLES = {"camera_headers": HEADERS, "side_documents": SIDE, "side_boxes": SIDE_BOXES, "stored_faces": STORED_FACES, "export_names": EXPORT_NAMES, "banned_words": BANNED}
