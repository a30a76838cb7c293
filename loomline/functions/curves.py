"""Smooth tone curves through a few points, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.values import let

TABLE = 1024


def _rises(points: Column) -> Column:
    """Of each piece between two points how fast it rises."""
    pieces = F.sequence(F.lit(0), F.size(points) - 2)
    step = lambda i, c: F.get(points, i + 1)[c] - F.get(points, i)[c]
    return F.transform(pieces, lambda i: F.try_divide(step(i, "y"), step(i, "x")).cast("double"))


def slopes(points: Column) -> Column:
    """At each point the slope of the smooth curve: the mean of its pieces' rises, none at a turn, and held so near them that no piece turns back.

    A piece (rise d, slopes a d and b d at its ends) keeps its direction if a² + b² is 9 at most; else both ends are
    scaled to that, first piece first, each with the slope that the one before it left.
    """

    def over(rises: Column) -> Column:
        inner = lambda i: (F.get(rises, i) + F.get(rises, i + 1)) / 2
        turn = lambda i: F.get(rises, i) * F.get(rises, i + 1) <= 0
        free = lambda i: F.when(i == F.size(rises), F.get(rises, i - 1)).when(turn(i - 1), 0.0).otherwise(inner(i - 1))

        def piece(held: Column, i: Column) -> Column:
            d, before, after = F.get(rises, i), held["slope"], free(i + 1)
            far = F.sqrt((before / d) * (before / d) + (after / d) * (after / d))
            scale = F.when(d == 0, 0.0).when(far > 3, 3 / far).otherwise(1.0)
            return F.struct(F.array_append(held["done"], before * scale).alias("done"), (after * scale).alias("slope"))

        start = F.struct(F.array().cast("array<double>").alias("done"), F.get(rises, F.lit(0)).alias("slope"))
        return F.aggregate(F.sequence(F.lit(0), F.size(rises) - 1), start, piece, lambda held: F.array_append(held["done"], held["slope"]))

    return let(_rises(points), over)


def smooth(points: Column, xs: Column) -> Column:
    """The smooth curve's values at each of ``xs``, in 0..1, level before the first point and after the last.

    Points array<struct<x, y>> are in order of x and differ in it; two make a straight line. Null for fewer than two.
    """

    def at(x: Column, p: Column, m: Column) -> Column:
        last = F.size(p) - 2
        return let(F.least(F.greatest(F.size(F.filter(p, lambda o: o["x"] <= x)) - 1, F.lit(0)), last), lambda i: piece(x, F.get(p, i), F.get(p, i + 1), F.get(m, i), F.get(m, i + 1)))

    def piece(x: Column, a: Column, b: Column, before: Column, after: Column) -> Column:
        wide = b["x"] - a["x"]

        def value(u: Column) -> Column:
            back = 1 - u
            y = back * back * ((1 + 2 * u) * a["y"] + u * wide * before) + u * u * ((3 - 2 * u) * b["y"] - back * wide * after)
            return F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))

        return let(F.least(F.greatest(F.try_divide(x - a["x"], wide), F.lit(0.0)), F.lit(1.0)), value)

    held = let(points, lambda p: let(slopes(p), lambda m: F.transform(xs, lambda x: at(x, p, m))))
    return F.when(F.size(points) >= 2, held)


def curve_table(points: Column, n: int = TABLE) -> Column:
    """``smooth`` at n even places from 0 to 1, to be looked up by ``toned``."""
    return smooth(points, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i / F.lit(float(n - 1))))


def toned_at(points: Column, values: Column, n: int = TABLE) -> Column:
    """``toned`` of each of ``values`` by the table of the curve through ``points``, of which only the entries looked up are worked out."""
    last = float(n - 1)
    place = lambda v: F.floor(F.least(F.greatest(v * last + 0.5, F.lit(0.0)), F.lit(last)))
    return F.zip_with(values, smooth(points, F.transform(values, lambda v: place(v) / F.lit(last))), lambda v, y: F.when(v.isNotNull(), y))


def toned(table: Column, value: Column) -> Column:
    """A value 0..1 after a curve: the entry of its table nearest to it; values beyond are held to the ends. Null without a table or value."""
    last = F.size(table) - 1
    return F.when(value.isNotNull(), F.get(table, F.least(F.greatest(value * last + 0.5, F.lit(0.0)), last.cast("double")).cast("int")))
