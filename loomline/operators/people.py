"""People in collections: corrections of age guesses, years of slides, merging, following, syncing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions.vectors import dot
from loomline.operators import naming
from loomline.operators.sequence import mutual_pairs
from loomline.sources.shared import stored

# Fixed values.
FACE_ADDRESS = "/api/people/faces/%s.jpg?v=%s"
SAME, MATCH, MISNAMED, DRIFT_FIXED, DRIFT_STEP, AGREE, MAX_SD = 0.363, 0.8, 6.0, 0.5, 0.1, 2.5, 8.0


def prior_sd(source: Column, before: Column, after: Column, distance: Column) -> Column:
    """How sure an interpolated year is: a quarter of the gap it lies in, or less with the distance from the one date it has."""
    return F.when(source == "between", F.greatest(F.lit(0.5), F.abs(after - before) / 4)).when(source == "near", 1.5 + 0.1 * distance).when(source == "tray", F.lit(1.5))


def one_per_slide(faces: DataFrame, person: str, slide: str, face: str, vector: str, sure: str) -> DataFrame:
    """Of several faces of one person on a slide the sure ones, else the one most like the person's other faces; the smaller id of equals.

    The likeness is to the sum of the person's vectors without the face's own, so no pair of faces is formed.
    """
    each = faces.select(person, F.posexplode(vector).alias("_i", "_x")).groupBy(person, "_i").agg(F.sum(F.col("_x").cast("double")).alias("_s"))
    sums = each.groupBy(person).agg(F.sort_array(F.collect_list(F.struct("_i", "_s"))).alias("_r")).select(person, F.col("_r._s").alias("_sum"))
    rest = F.zip_with("_sum", F.col(vector), lambda s, x: s - x.cast("double"))
    like = dot(F.col(vector), rest) / F.nullif(F.sqrt(dot(rest, rest)), F.lit(0.0))
    rows = faces.join(sums, person).withColumn("_like", F.coalesce(like, F.lit(0.0)))
    w = W.partitionBy(person, slide)
    rows = rows.withColumn("_any", F.max(F.col(sure).cast("int")).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("_like"), face)))
    return rows.where(F.when(F.col("_any") == 1, F.col(sure)).otherwise(F.col("_r") == 1)).select(*faces.columns)


def faces_on_slides(faces: DataFrame, slides: DataFrame, owners: DataFrame, slide: str, face: str, address: str = FACE_ADDRESS) -> DataFrame:
    """Rows (slide, place, face, url, box, person): the faces of each slide from left to right, for saying who is who.

    ``faces`` (slide, face, box, turn) were found on the slide turned by ``turn``; where ``slides`` (slide, turn, look)
    says it is turned otherwise now, there is no box. ``owners`` (face, person, ignored) has each face once at most;
    faces of people who are ignored are not listed and take no place. An address names the face and the slide's look.
    Faces without a box come last, equal ones in order of the face.
    """
    rows = faces.select(slide, face, "box", F.col("turn").alias("_turn")).join(slides.select(slide, "turn", "look"), slide).join(owners.select(face, "person", "ignored"), face, "left")
    rows = rows.where(~F.coalesce("ignored", F.lit(False)))
    place = F.row_number().over(W.partitionBy(slide).orderBy(F.get("box", F.lit(0)).asc_nulls_last(), face)).cast("long")
    url = F.format_string(address, F.col(face).cast("string"), F.coalesce("look", F.lit("")))
    return rows.select(slide, place.alias("place"), face, url.alias("url"), F.when(F.col("_turn").eqNullSafe(F.col("turn")), F.col("box")).alias("box"), "person")


def followers(named: DataFrame, group: DataFrame, face: str, vector: str, slide: str, least: float = SAME) -> DataFrame:
    """Faces of an unnamed group that follow one of it that was named: alike enough, the best of each slide, none of the named face's own slide."""
    one = named.select(F.col("group").alias("group"), F.col(vector).alias("_v"), F.col(slide).alias("_s"))
    rows = group.join(one, "group").where(F.col(slide) != F.col("_s")).withColumn("cos", dot(F.col(vector), F.col("_v"))).where(F.col("cos") >= least)
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("group", slide).orderBy(F.desc("cos"), face))).where("_r = 1").select("group", face, slide, "cos")


def reidentify(found: DataFrame, old: DataFrame, slide: str, order: str, vector: str, number: str, least: float = MATCH) -> DataFrame:
    """Rows (slide, order, number): faces found again keep the number of the old face most like them, new ones get the smallest free number.

    Faces have their turn in their order, which differs on a slide; each takes the likest old face that none before it
    took, if their product is ``least`` or more, ties to the smaller number. The others get numbers from 0 on that no
    old face of the slide has, in their order. A face without a vector is like none.

    Who takes whom comes from rounds of mutually best pairs, numbers from the gaps between those in use: joins and
    running counts, whatever is on one slide.
    """
    faces = found.select(F.col(slide).alias("slide"), F.col(order).alias("turn"), F.col(vector).alias("v"))
    held = old.select(F.col(slide).alias("slide"), F.col(number).cast("long").alias("number"), F.col(vector).alias("_v"))
    like = faces.join(held, "slide").withColumn("like", dot(F.col("v"), F.col("_v"))).where((F.col("like") >= least) & ~F.isnan("like"))
    like = like.groupBy("slide", "turn", "number").agg(F.max("like").alias("like"))
    again = mutual_pairs(like, ["slide"], "turn", "number", F.struct(-F.col("like"), F.col("number")), F.struct("turn"))
    again = stored(again.select("slide", "turn", "number"), "again")
    new = naming.running_sum(faces.select("slide", "turn").join(again, ["slide", "turn"], "left_anti"), ["slide"], ["turn"], F.lit(1), "place")
    used = held.where("number >= 0").select("slide", "number").distinct()
    named = again.unionByName(naming.free_numbers(new, used, ["slide"], "turn", "place", 0))
    return named.select(F.col("slide").alias(slide), F.col("turn").alias(order), F.col("number").alias(number))


def suspects(faces: DataFrame, births: DataFrame, least_years: float = MISNAMED, agree: float = AGREE) -> DataFrame:
    """Rows of ``faces`` (face, person, year, year_sd, age, age_sd, fit, n, dated) whose age can't be: probably someone else.

    The age looked differs from the one the birth gives by ``least_years`` and by ``agree`` deviations, and the face fits
    the person's others badly or the year is sure.
    """
    rows = faces.join(births.select("person", "born", "born_sd"), "person")
    off = F.abs(F.col("age") - (F.col("year") - F.col("born")))
    sd = F.sqrt(F.pow("age_sd", F.lit(2.0)) + F.pow("year_sd", F.lit(2.0)) + F.pow("born_sd", F.lit(2.0)))
    weak = (F.col("fit") < 0.35) & (F.col("n") >= 3)
    return rows.where((off >= least_years) & (off > agree * sd) & (weak | F.col("dated"))).select("face", "person", off.alias("off"), sd.alias("sd"))


def slide_years(says: DataFrame, priors: DataFrame, near: DataFrame, agree: float = AGREE, max_sd: float = MAX_SD) -> DataFrame:
    """Rows (slide, y, sd, parts, against, suggest): the year that people, neighbours and dates around give each slide.

    ``says`` (slide, v, sd) is what a slide's own people say, ``near`` (slide, other, dist) the neighbours that bring new
    people, ``priors`` (slide, v, sd, own, shown, skip) the estimate from dates around. The anchor is the slide's own, or
    the surest neighbour. Neighbours that agree with it join, further ones less surely; the prior joins if it agrees with
    these, else it stands against them. A suggestion needs a slide without its own date, a deviation of ``max_sd`` at
    most and a year that isn't shown already, and is not made where the prior agrees and is no less sure.
    """
    ours = says.select("slide", F.col("v").alias("_v"), F.col("sd").alias("_sd"))
    drift = F.sqrt(F.pow("_os", F.lit(2.0)) + F.pow(DRIFT_FIXED + DRIFT_STEP * F.col("dist"), F.lit(2.0)))
    around = near.join(says.select(F.col("slide").alias("other"), F.col("v").alias("_ov"), F.col("sd").alias("_os")), "other").select("slide", F.struct(drift.alias("s"), F.col("dist").alias("d"), F.col("other").alias("o"), F.col("_ov").alias("v")).alias("p"))
    held = around.groupBy("slide").agg(F.sort_array(F.collect_list("p")).alias("near"))
    none = F.expr("CAST(array() AS array<struct<s:double,d:bigint,o:bigint,v:double>>)")
    rows = priors.join(ours, "slide", "left").join(held, "slide", "left").withColumn("near", F.coalesce(F.col("near").cast("array<struct<s:double,d:bigint,o:bigint,v:double>>"), none))
    first = F.get("near", F.lit(0))
    rows = rows.withColumn("_av", F.coalesce("_v", first["v"])).withColumn("_as", F.coalesce("_sd", first["s"])).where("_av IS NOT NULL")
    agrees = lambda v1, s1, v2, s2: F.abs(v1 - v2) <= agree * F.sqrt(s1 * s1 + s2 * s2)
    friends = F.filter("near", lambda p: agrees(p["v"], p["s"], F.col("_av"), F.col("_as")))
    own = F.when(F.col("_v").isNotNull(), F.array(F.struct(F.col("_sd").alias("s"), F.lit(0).cast("long").alias("d"), F.lit(-1).cast("long").alias("o"), F.col("_v").alias("v")))).otherwise(none)
    rows = rows.withColumn("_parts", F.concat(own, friends))
    weight = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + 1 / (p["s"] * p["s"]))
    mean = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["v"] / (p["s"] * p["s"])) / weight
    rows = rows.withColumn("_bv", mean).withColumn("_bs", F.sqrt(1 / weight))
    joins = F.coalesce(agrees(F.col("v"), F.col("sd"), F.col("_bv"), F.col("_bs")), F.lit(False))
    wp, wb = 1 / (F.col("sd") * F.col("sd")), 1 / (F.col("_bs") * F.col("_bs"))
    rows = rows.withColumn("_joins", joins).withColumn("_y", F.when(joins, (F.col("_bv") * wb + F.col("v") * wp) / (wb + wp)).otherwise(F.col("_bv"))).withColumn("_ys", F.when(joins, F.sqrt(1 / (wb + wp))).otherwise(F.col("_bs")))
    against = F.col("v").isNotNull() & ~F.col("_joins")
    idle = F.col("_joins") & ((F.col("_bs") >= F.col("sd")) | (F.abs(F.col("_bv") - F.col("v")) <= F.col("sd")))
    suggest = ~F.col("own") & ~F.col("skip") & (F.col("_ys") <= max_sd) & ~idle & ~F.floor("_y").eqNullSafe(F.col("shown"))
    return rows.select("slide", F.col("_y").alias("y"), F.col("_ys").alias("sd"), F.size("_parts").cast("long").alias("parts"), against.alias("against"), suggest.alias("suggest"))


def merged_people(people: DataFrame, into: DataFrame) -> DataFrame:
    """People (pid, ord, name, birthday, faces) folded by ``into`` (pid, target): the first name and birthday that isn't empty, all faces."""
    rows = people.join(into, "pid", "left").withColumn("target", F.coalesce("target", "pid"))
    own_first = F.struct((F.col("pid") != F.col("target")).alias("o"), F.col("ord").alias("k"))
    first = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", own_first))
    return rows.groupBy("target").agg(first("name").alias("name"), first("birthday").alias("birthday"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("faces")))).alias("faces")).withColumnRenamed("target", "pid")


def sync_actions(pairs: DataFrame, ours: DataFrame, theirs: DataFrame, least: int = 2, share: float = 2 / 3) -> DataFrame:
    """Rows (kind, pid, rid, name): what to do so that our people and the remote ones agree.

    ``pairs`` (pid, rid) are faces matched on both sides. A remote person whose faces, two at least, are all ours is
    linked; a person most of whose faces a remote one has is linked to it; names go to the side that has none; two
    people linked to one remote person are to be merged; different names are a conflict.
    """
    n = pairs.groupBy("pid", "rid").agg(F.count("*").alias("n"))
    by_r, by_p = W.partitionBy("rid"), W.partitionBy("pid")
    counts = n.withColumn("_tr", F.sum("n").over(by_r)).withColumn("_tp", F.sum("n").over(by_p)).withColumn("_kr", F.count("*").over(by_r))
    linked = counts.where((F.col("n") >= least) & ((F.col("_kr") == 1) | (F.col("n") >= share * F.col("_tp")))).select("pid", "rid")
    named = linked.join(ours.select("pid", F.col("name").alias("_o")), "pid").join(theirs.select("rid", F.col("name").alias("_t")), "rid")
    o, t = F.nullif("_o", F.lit("")), F.nullif("_t", F.lit(""))
    kind = F.when(o.isNull() & t.isNotNull(), "take_name").when(o.isNotNull() & t.isNull(), "give_name").when(F.lower(o) != F.lower(t), "conflict").otherwise("link")
    first = F.min("pid").over(by_r)
    merges = linked.withColumn("_f", first).where("pid <> _f").select(F.lit("merge").alias("kind"), "pid", "rid", F.col("_f").cast("string").alias("name"))
    return named.select(kind.alias("kind"), "pid", "rid", F.coalesce(o, t).alias("name")).unionByName(merges)


def assign_faces(owners: DataFrame, rejected: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows (face, person, rejected, sure, age_off) of every face, after edits (face, ord, person or null, age_off) in their order.

    The last edit says whose a face is, and makes that sure. Whoever had it on the way, or was rejected before, and is
    not its person in the end, is rejected. Its age is off if the last edit says so and confirms the person it had.
    """
    told = edits.groupBy("face").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.col("person").alias("to"), "age_off"))), lambda e: e.dropFields("ord")).alias("_e"))
    before = rejected.groupBy("face").agg(F.collect_set("person").alias("_r"))
    rows = owners.join(told, "face", "full").join(before, "face", "left").withColumn("_e", F.coalesce("_e", F.expr("CAST(array() AS array<struct<to:bigint,age_off:boolean>>)")))
    last = F.try_element_at("_e", F.lit(-1))
    edited = F.size("_e") > 0
    now = F.when(edited, last["to"]).otherwise(F.col("person"))
    had = F.when(F.size("_e") > 1, F.try_element_at("_e", F.lit(-2))["to"]).otherwise(F.col("person"))
    ever = F.array_union(F.coalesce("_r", F.expr("CAST(array() AS array<bigint>)")), F.concat(F.array(F.col("person")), F.transform("_e", lambda e: e["to"])))
    out = F.array_sort(F.filter(ever, lambda p: p.isNotNull() & ~p.eqNullSafe(now)))
    return rows.select("face", now.alias("person"), out.alias("rejected"), (edited & now.isNotNull()).alias("sure"), F.coalesce(edited & last["age_off"] & (now == had), F.lit(False)).alias("age_off"))
