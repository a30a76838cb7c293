"""Cleaning and checking of single values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.text import coords_label, squeeze

ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"


def safe_id(text: Column) -> Column:
    """Whether a name can be part of a path."""
    return F.coalesce(text.rlike(ID), F.lit(False))


def clean_place(name: Column, lat: Column, lon: Column, country: Column) -> Column:
    """struct<name, lat, lon, country>: finite coordinates in range to five digits, a name or else the coordinates; null if invalid."""
    valid = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    shown = F.coalesce(F.nullif(F.substring(squeeze(name), 1, 200), F.lit("")), coords_label(lat, lon))
    return F.when(valid, F.struct(shown.alias("name"), F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"), F.substring(F.coalesce(squeeze(country), F.lit("")), 1, 100).alias("country")))


def clean_crop(left: Column, top: Column, right: Column, bottom: Column, least: float = 0.05) -> Column:
    """struct<l, t, r, b> held to 0..1 and at least ``least`` wide and high; null for the whole picture and for less."""
    hold = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    l, t, r, b = hold(left), hold(top), hold(right), hold(bottom)  # noqa: E741
    whole = (l <= 0) & (t <= 0) & (r >= 1) & (b >= 1)
    return F.when((r - l >= least) & (b - t >= least) & ~whole, F.struct(l.alias("l"), t.alias("t"), r.alias("r"), b.alias("b")))


def clean_curve(points: Column, least_step: float = 0.004, most: int = 16) -> Column:
    """Points array<struct<x, y>> in order of x, held to 0..1, closer ones dropped; null for fewer than two or the plain diagonal."""
    hold = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    kind = "array<struct<x:double,y:double>>"
    ordered = F.array_sort(F.transform(points, lambda p: F.struct(hold(p["x"]).cast("double").alias("x"), hold(p["y"]).cast("double").alias("y"))))

    def add(acc: Column, p: Column) -> Column:
        far = (F.size(acc) == 0) | (p["x"] - F.element_at(acc, -1)["x"] >= least_step)
        return F.when(far & (F.size(acc) < most), F.concat(acc, F.array(p))).otherwise(acc)

    kept = F.aggregate(ordered, F.array().cast(kind), add)
    diagonal = F.forall(kept, lambda p: F.abs(p["x"] - p["y"]) < 1e-9)
    return F.when((F.size(kept) >= 2) & ~diagonal, kept)


def auto_straighten(confidence: Column, angle: Column, developed: Column, touched: Column) -> Column:
    """Whether a found angle is applied unasked: sure, not tiny, and nothing done by hand yet."""
    return (confidence >= 0.8) & (F.abs(angle) >= 0.1) & ~developed & ~touched


def rotation_vote(upright: Column, right: Column, down: Column, left: Column) -> Column:
    """0, 90, 180 or 270 that the faces found agree on, null if they don't: seven tenths of all and well ahead of the second."""
    votes = F.array(*[F.struct(v.cast("double").alias("n"), F.lit(-d).alias("d")) for v, d in ((upright, 0), (right, 90), (down, 180), (left, 270))])
    ranked = F.sort_array(votes, asc=False)
    best, second = F.element_at(ranked, 1), F.element_at(ranked, 2)
    total = upright + right + down + left
    return F.when((total > 0) & (best["n"] / total >= 0.7) & (best["n"] >= 2 * second["n"] + 0.3 * total), -best["d"])
