"""A library on disk: tray documents, faces, scans in folders, gazetteer files; and writing them back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.values import let

TRAY = """id string, name string, album string, box int, side string, date string, stock string, created double,
scans map<string, struct<file: string, source: string, size: bigint, sha1: string, taken: string>>,
groups array<struct<id: string, scans: array<string>, excluded: array<string>, rotation: int, reviewed: boolean, skip: boolean, date: string, caption: string, tags: array<string>, stock: string,
    place: struct<name: string, lat: double, lon: double, country: string>, developed_at: double, locked: string>>"""
FACES = "slides map<string, struct<key: string, faces: array<struct<id: string, box: array<double>, score: double, emb: string, age: double, manual: boolean>>>>"
# Endings of raw files, and the columns of the gazetteer files.
RAW_ENDINGS = ("dng", "cr2", "cr3", "nef", "arw", "orf", "raf")
SCAN_ENDINGS = (*RAW_ENDINGS, "jpg", "jpeg", "tif", "tiff")
CITY_COLUMNS = "id name ascii alts lat lon fclass fcode cc cc2 admin1 admin2 admin3 admin4 pop elevation dem tz modified".split()


def trays(spark: SparkSession, path: str, pattern: str = "session.json") -> DataFrame:
    """One row per readable tray document below ``path``, with its modification time; unreadable ones are left out."""
    rows = spark.read.schema(f"{TRAY}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("modified")).where("_corrupt IS NULL AND id IS NOT NULL").drop("_corrupt")


def slides(tray_rows: DataFrame) -> DataFrame:
    """One row per slide with its place in the tray; an empty date or caption is none."""
    rows = tray_rows.select(F.col("id").alias("tray_id"), F.col("date").alias("tray_date"), F.col("stock").alias("tray_stock"), F.posexplode("groups").alias("pos", "g"))
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c.split(".")[1])
    return rows.select("tray_id", "tray_date", "tray_stock", F.col("pos").cast("long").alias("pos"), F.col("g.id").alias("slide_id"), "g.scans", "g.excluded", "g.rotation", F.coalesce("g.reviewed", F.lit(False)).alias("reviewed"), F.coalesce("g.skip", F.lit(False)).alias("skip"), blank("g.date"), blank("g.caption"), "g.tags", blank("g.stock"), "g.place", "g.developed_at", "g.locked")


def faces(spark: SparkSession, path: str) -> DataFrame:
    """One row per face of the documents named faces.json, vectors unpacked; the tray's name is that of its folder."""
    rows = spark.read.schema(FACES).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "faces.json").json(path)
    each = rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("tray_id"), F.explode(F.map_entries("slides")).alias("e")).select("tray_id", F.col("e.key").alias("slide_id"), F.explode("e.value.faces").alias("f"))
    return each.select("tray_id", "slide_id", F.col("f.id").alias("face_id"), "f.box", "f.score", half_floats(F.unbase64("f.emb")).alias("emb"), "f.age", F.coalesce("f.manual", F.lit(False)).alias("manual"))


def half_floats(data: Column) -> Column:
    """Little-endian half-precision numbers, as an array of floats, without leaving the JVM."""
    pair = lambda digits, i: F.conv(F.concat(F.substring(digits, i * 4 + 3, 2), F.substring(digits, i * 4 + 1, 2)), 16, 10).cast("int")

    def value(bits: Column) -> Column:
        sign = F.when(bits >= 32768, -1.0).otherwise(1.0)
        exponent, part = F.floor(bits / 1024) % 32, bits % 1024
        small = part * 2.0**-24
        normal = (1 + part / 1024) * F.pow(F.lit(2.0), exponent - 15)
        special = F.when(part == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
        return (sign * F.when(exponent == 0, small).when(exponent == 31, special).otherwise(normal)).cast("float")

    count = F.floor(F.length(data) / 2).cast("int")
    numbers = let(F.hex(data), lambda digits: F.transform(F.sequence(F.lit(0), F.floor(F.length(digits) / 4).cast("int") - 1), lambda i: let(pair(digits, i), value)))
    return F.when(count > 0, numbers).when(count == 0, F.array().cast("array<float>"))


def packed_halves(numbers: Column) -> Column:
    """An array of numbers as base64 of little-endian half-precision numbers, as ``half_floats`` unpacks them, without leaving the JVM.

    Ties go to the even neighbour; what is too large becomes infinite, and small numbers keep as many bits as they
    have. A null array gives null, an empty one the empty text; a null number becomes not-a-number.
    """

    def bits(x: Column) -> Column:
        size = F.abs(x)
        above = F.floor(F.log2(size))
        exponent = F.greatest(above + F.when(F.pow(F.lit(2.0), above) > size, -1).when(F.pow(F.lit(2.0), above + 1) <= size, 1).otherwise(0), F.lit(-14))
        steps = F.rint(size / F.pow(F.lit(2.0), exponent - 10)) + (exponent + 14) * 1024
        held = F.when(x.isNull() | F.isnan(x), 32256).when(size >= 65520, 31744).when(size == 0, 0).otherwise(steps)
        return held.cast("int") + F.when(x.cast("string").startswith("-"), 32768).otherwise(0)

    swapped = lambda d: F.concat(F.substring(d, 3, 2), F.substring(d, 1, 2))
    return F.base64(F.unhex(F.array_join(F.transform(numbers, lambda x: let(F.lpad(F.hex(bits(x.cast("double"))), 4, "0"), swapped)), "")))


def side_documents(spark: SparkSession, path: str, name: str, ids: DataFrame) -> DataFrame:
    """Rows (id, text): for each of ``ids`` (one column, id) the document ``name`` in the folder of that name below ``path``, null where there is none."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path)
    found = files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("id"), F.col("value").alias("text"))
    return ids.join(found, "id", "left")


def scan_files(files: DataFrame, path: str = "path") -> DataFrame:
    """The scans among files: no hidden ones, known endings, and no JPEG or TIFF beside a raw file of the same name."""
    name = F.element_at(F.split(path, "/"), -1)
    rows = files.withColumn("_name", name).withColumn("_dir", F.expr(f"left({path}, length({path}) - length(_name))"))
    rows = rows.withColumn("_end", F.lower(F.element_at(F.split("_name", r"\."), -1))).withColumn("_stem", F.lower(F.regexp_replace("_name", r"\.[^.]*$", "")))
    rows = rows.where(~F.col("_name").startswith(".") & ~F.col("_dir").rlike(r"(^|/)\.[^/]+/") & F.col("_end").isin(*SCAN_ENDINGS))
    raw = rows.where(F.col("_end").isin(*RAW_ENDINGS)).select("_dir", "_stem").distinct()
    kept = rows.where(F.col("_end").isin(*RAW_ENDINGS)).unionByName(rows.where(~F.col("_end").isin(*RAW_ENDINGS)).join(raw, ["_dir", "_stem"], "left_anti").select(*rows.columns))
    return kept.select(*files.columns)


def gazetteer(spark: SparkSession, cities: str, countries: str, admins: str, least_rows: int = 100) -> DataFrame:
    """Cities with the names of their country and region; comment lines and short rows are skipped; too few rows are an error."""
    read = lambda p: spark.read.option("sep", "\t").option("comment", "#").option("quote", "").csv(p)
    c = spark.read.schema(", ".join(f"{x} string" for x in CITY_COLUMNS)).option("sep", "\t").option("comment", "#").option("quote", "").csv(cities).where("pop IS NOT NULL AND lat IS NOT NULL")
    if c.limit(least_rows).count() < least_rows:
        raise ValueError(f"fewer than {least_rows} cities in {cities}")
    land = read(countries).select(F.col("_c0").alias("cc"), F.col("_c4").alias("country"))
    region = read(admins).select(F.col("_c0").alias("_code"), F.col("_c1").alias("admin"))
    rows = c.join(land, "cc", "left").withColumn("_code", F.concat_ws(".", "cc", "admin1")).join(region, "_code", "left")
    return rows.select(F.col("id").cast("long").alias("city_id"), "name", "ascii", F.when(F.col("alts").isNull(), F.array().cast("array<string>")).otherwise(F.split("alts", ",")).alias("alts"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "cc", F.coalesce("country", "cc").alias("country"), F.coalesce("admin", F.lit("")).alias("admin"), F.col("pop").cast("long").alias("pop"))


def quick_fingerprint(name: Column, size: Column, modified: Column) -> Column:
    """name:size:whole seconds, enough to tell that a file was seen before."""
    return F.concat_ws(":", name, size.cast("string"), F.floor(modified).cast("string"))


def commit_if_unchanged(table: DataFrame, results: DataFrame, item: str, key: str, columns: list[str]) -> DataFrame:
    """Results put into the rows whose key is still the one they were made for; other rows keep what they have."""
    made = results.select(F.col(item).alias("_i"), F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    rows = table.join(made, (F.col(item) == F.col("_i")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    return rows.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def replace_table(df: DataFrame, path: str) -> None:
    """Writes the rows as a new version below ``path`` and then moves the note of which version counts over the old note.

    That one move is atomic, so ``current_table`` sees the old rows or the new ones and never none, also when the
    writer is lost at any point. Versions before stay for those who still read them.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    note, place = jvm.org.apache.hadoop.fs.Path(f"{path}/_note-{version}"), jvm.org.apache.hadoop.fs.Path(f"{path}/current.txt")
    out = note.getFileSystem(conf).create(note)
    out.write(version.encode())
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.getFileSystem(conf).getUri(), conf)
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(files.makeQualified(note), files.makeQualified(place), over)


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the version that counts."""
    note = spark.read.text(f"{path}/current.txt").first()["value"]
    return spark.read.parquet(f"{path}/{note}")
