"""Pictures as tables of cells: connected marks with their statistics, and sums over boxes, tile by tile."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.operators.components import connected_components
from loomline.sources.shared import stored

#: Cells along each side of a tile. A task holds one tile, whatever the size of the picture.
TILE = 256


def _tile_of(c: str, tile: int) -> Column:
    return F.floor(F.col(c) / tile).cast("long")


def _runs_of(tile: int, reach: int, by: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(cells: pa.Table) -> pa.Table:
        """Runs of set cells along the rows of one tile, each with the first cell of the part that it belongs to in the tile."""
        y, x, flag = (cells.column(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "flag"))
        top, left = y.min() // tile * tile, x.min() // tile * tile
        held, marked = np.zeros((tile, tile + 2), np.int8), np.zeros((tile, tile), np.int64)
        held[y - top, x - left + 1] = 1
        np.maximum.at(marked, (y - top, x - left), flag.astype(np.int64))
        edge = np.diff(held, axis=1)
        row, begin = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1] - 1
        so_far = np.concatenate([np.zeros((tile, 1), np.int64), marked.cumsum(axis=1)], axis=1)
        wide = tile + 4
        low = np.searchsorted(row * wide + end, (row + 1) * wide + begin - reach)
        high = np.searchsorted(row * wide + begin, (row + 1) * wide + end + reach, side="right")
        n = np.maximum(high - low, 0)
        one = np.repeat(np.arange(len(row)), n)
        two = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(low, n)
        first = _joined(len(row), one, two)
        same = [pa.repeat(cells.column(c)[0], len(row)) for c in by]
        return pa.table([*same, pa.array(row[first] + top), pa.array(begin[first] + left), pa.array(row + top), pa.array(begin + left), pa.array(end + left), pa.array(so_far[row, end + 1] > so_far[row, begin])], names=[*by, "part_y", "part_x", "y", "x0", "x1", "flag"])

    return run


def _joined(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The least number of each one's component, given links."""
    root = np.arange(n)
    while True:
        a, b = root[one], root[two]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]


def labelled_runs(cells: DataFrame, by: list[str], flag: str | None = None, diagonal: bool = True, tile: int = TILE) -> DataFrame:
    """Rows (by, y, x0, x1, flag, mark_y, mark_x): the runs of set cells along rows, with the first cell of the mark they belong to.

    ``cells`` has a row (by, x, y) for each set cell of the pictures ``by``; repeated rows count once, rows with a null
    coordinate not at all. Cells are of one mark if a path of neighbours joins them, over corners too if ``diagonal``.
    The first cell is that of the least y, then x. flag: whether any cell of the run has a true ``flag``.

    Each tile finds the parts in it; parts are linked where cells meet over tile borders, by equal coordinates, and
    joined to marks by components. What moves is one row per cell to its tile, then runs, and cells on borders.
    """
    reach = int(diagonal)
    own = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    rows = cells.where("x IS NOT NULL AND y IS NOT NULL").select(*by, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), own.alias("flag"))
    rows = rows.withColumn("tile_x", _tile_of("x", tile)).withColumn("tile_y", _tile_of("y", tile))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "part_y long, part_x long, y long, x0 long, x1 long, flag boolean"])
    runs = stored(rows.groupBy(*by, "tile_y", "tile_x").applyInArrow(_runs_of(tile, reach, by), schema), "runs")
    part = F.struct(*by, F.col("part_y").alias("y"), F.col("part_x").alias("x"))
    along = lambda a, b: F.explode(F.sequence(a, b))
    below = runs.where(F.pmod("y", F.lit(tile)) == tile - 1).select(*by, part.alias("a"), (F.col("y") + 1).alias("y"), along(F.col("x0") - reach, F.col("x1") + reach).alias("x"))
    beside = runs.where(F.pmod("x1", F.lit(tile)) == tile - 1).select(*by, part.alias("a"), along(F.col("y") - reach, F.col("y") + reach).alias("y"), (F.col("x1") + 1).alias("x"))
    upper = runs.where(F.pmod("y", F.lit(tile)) == 0).select(*by, part.alias("b"), "y", along(F.col("x0"), F.col("x1")).alias("x"))
    leftmost = runs.where((F.pmod("x0", F.lit(tile)) == 0) & (F.pmod("y", F.lit(tile)) != 0)).select(*by, part.alias("b"), "y", F.col("x0").alias("x"))
    same = [*by, "y", "x"]
    met = _null_safe(below.unionByName(beside), upper.unionByName(leftmost), same).select("a", "b").distinct()
    roots = connected_components(met).select(F.col("node").alias("part"), F.col("root").alias("mark"))
    named = runs.withColumn("part", part).join(roots, "part", "left").withColumn("mark", F.coalesce("mark", "part"))
    return named.select(*by, "y", "x0", "x1", "flag", F.col("mark.y").alias("mark_y"), F.col("mark.x").alias("mark_x"))


def _null_safe(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    a, b = a.alias("l"), b.alias("r")
    on = None
    for c in columns:
        here = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        on = here if on is None else on & here
    return a.join(b, on)


def marks(runs: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, mark_y, mark_x, area, left, top, right, bottom, flagged), one per mark of ``labelled_runs``; edges are the outermost cells."""
    totals = runs.groupBy(*by, "mark_y", "mark_x").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("left"), F.min("y").alias("top"), F.max("x1").alias("right"), F.max("y").alias("bottom"), F.max("flag").alias("flagged")
    )
    return totals.select(*by, "mark_y", "mark_x", "area", "left", "top", "right", "bottom", "flagged")


def prefix_sums(values: DataFrame, sizes: DataFrame, by: list[str], value: str, tile: int = TILE) -> DataFrame:
    """Rows (by, x, y, total) for every cell of the pictures: the sum of ``value`` over the cells not beyond it in x and in y.

    ``sizes`` has one row (by, width, height) per picture, ``values`` any number of rows (by, x, y, value); those
    outside or null add nothing, as do cells without one. Keys ``by`` are not null. Sums are of the value's own kind.

    A cell's total is that of its tile up to it, of the rows left of the tile and the columns above it up to the cell,
    and of the tiles above and left. Rows, columns and tiles carry on through sums of tiles alone, so no window holds
    more than a tile or one line of tiles.
    """
    side = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / tile).cast("long") - 1))
    inside = lambda t, n: F.explode(F.sequence(F.col(t) * tile, F.least((F.col(t) + 1) * tile, F.col(n)) - 1))
    sized = sizes.where("width > 0 AND height > 0").select(*by, F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))
    tiles = sized.withColumn("tile_y", side("height")).withColumn("tile_x", side("width"))
    key = [*by, "tile_y", "tile_x"]
    empty = tiles.withColumn("y", inside("tile_y", "height")).withColumn("x", inside("tile_x", "width")).select(*key, "y", "x", F.lit(0).cast(dict(values.dtypes)[value]).alias("v"), F.lit(True).alias("cell"))
    given = values.where(F.col(value).isNotNull()).withColumn("tile_y", _tile_of("y", tile)).withColumn("tile_x", _tile_of("x", tile)).select(*key, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(value).alias("v"), F.lit(False).alias("cell"))
    cells = empty.unionByName(given).groupBy(*key, "y", "x").agg(F.sum("v").alias("v"), F.max("cell").alias("cell")).where("cell").drop("cell")
    cells = stored(cells, "cells")
    upto, before = (W.unboundedPreceding, W.currentRow), (W.unboundedPreceding, -1)
    over = lambda part, order, rows: W.partitionBy(*part).orderBy(order).rowsBetween(*rows)
    zero = lambda c: F.coalesce(c, F.lit(0))
    by_tile = cells.repartition(*key)
    local = by_tile.withColumn("v", F.sum("v").over(over([*key, "y"], "x", upto))).withColumn("v", F.sum("v").over(over([*key, "x"], "y", upto)))
    rows = cells.groupBy(*key, "y").agg(F.sum("v").alias("v")).withColumn("v", zero(F.sum("v").over(over([*by, "y"], "tile_x", before))))
    rows = rows.withColumn("left", F.sum("v").over(over(key, "y", upto))).select(*key, "y", "left")
    columns = cells.groupBy(*key, "x").agg(F.sum("v").alias("v")).withColumn("v", zero(F.sum("v").over(over([*by, "x"], "tile_y", before))))
    columns = columns.withColumn("above", F.sum("v").over(over(key, "x", upto))).select(*key, "x", "above")
    corners = cells.groupBy(*key).agg(F.sum("v").alias("v")).withColumn("v", zero(F.sum("v").over(over([*by, "tile_y"], "tile_x", before))))
    corners = corners.withColumn("corner", zero(F.sum("v").over(over([*by, "tile_x"], "tile_y", before)))).select(*key, "corner")
    whole = local.join(corners, key).join(rows, [*key, "y"]).join(columns, [*key, "x"])
    return whole.select(*by, "x", "y", (F.col("v") + F.col("left") + F.col("above") + F.col("corner")).alias("total"))


def _clipped(boxes: DataFrame, sizes: DataFrame, by: list[str], key: list[str]) -> tuple[DataFrame, Column]:
    """Rows (key, by, x0, y0, x1, y1), the boxes as far as they lie in their pictures, null with a null edge; and whether one has cells."""
    held = boxes.join(sizes.select(*by, "width", "height"), by, "left")
    x0, y0 = F.greatest("left", F.lit(0)), F.greatest("top", F.lit(0))
    x1, y1 = F.least("right", F.col("width") - 1), F.least("bottom", F.col("height") - 1)
    edges = F.col("left").isNotNull() & F.col("top").isNotNull() & F.col("right").isNotNull() & F.col("bottom").isNotNull() & F.col("width").isNotNull()
    rows = held.select(*key, *by, *[F.when(edges, c).cast("long").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])
    return rows, (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))


def _area(real: Column) -> Column:
    return F.when(real, (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)).otherwise(0).alias("area")


def box_sums(prefix: DataFrame, sizes: DataFrame, boxes: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Rows (key, area, total): cells and sum of values in each box (key, by, left, top, right, bottom), edges included, as far as it lies in its picture.

    Each box looks up the totals at its corners by equal coordinates, four at most whatever its size. Keys are unique.
    A box with a null edge, of an unknown picture or beside its picture has no cells and the sum 0.
    """
    cut_, real = _clipped(boxes, sizes, by, key)
    corner = lambda x, y, sign: F.struct(x.alias("x"), y.alias("y"), F.lit(sign).alias("sign"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    four = F.array(corner(x1, y1, 1), corner(x0 - 1, y1, -1), corner(x1, y0 - 1, -1), corner(x0 - 1, y0 - 1, 1))
    asked = cut_.where(real).select(*key, *by, F.explode(F.filter(four, lambda c: (c["x"] >= 0) & (c["y"] >= 0))).alias("c")).select(*key, *by, "c.x", "c.y", "c.sign")
    sums = asked.join(prefix, [*by, "x", "y"]).groupBy(*key).agg(F.sum(F.col("sign") * F.col("total")).alias("total"))
    return cut_.select(*key, _area(real)).join(sums, key, "left").withColumn("total", F.coalesce("total", F.lit(0)))


def _summed_in(tile: int, by: list[str], whole: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(cells: pa.Table, pieces: pa.Table) -> pa.Table:
        """The sum of each piece of a box in one tile, from the tile's table of two-dimensional sums."""
        kind = np.int64 if whole else np.float64
        table = np.zeros((tile + 1, tile + 1), kind)
        if cells.num_rows and pieces.num_rows:
            y, x, v = (cells.column(c).to_numpy() for c in ("y", "x", "v"))
            table[y % tile + 1, x % tile + 1] = v
            table = table.cumsum(axis=0).cumsum(axis=1)
        left, top, right, bottom = (pieces.column(c).to_numpy() for c in ("left", "top", "right", "bottom"))
        sums = table[bottom + 1, right + 1] - table[top, right + 1] - table[bottom + 1, left] + table[top, left]
        return pa.table([*[pieces.column(c) for c in (*by, "x0", "y0", "x1", "y1")], pa.array(sums, pa.int64() if whole else pa.float64())], names=[*by, "x0", "y0", "x1", "y1", "total"])

    return run


def tiled_box_sums(values: DataFrame, sizes: DataFrame, boxes: DataFrame, by: list[str], key: list[str], value: str, tile: int = TILE) -> DataFrame:
    """What ``box_sums`` gives by ``prefix_sums``, for boxes that are small beside a tile: no table of the whole pictures is made.

    A box is cut where tiles meet, four pieces at most if it is no larger than a tile; each tile that a box lies in
    makes the table of sums of its own cells. What moves is a row per cell with values and per piece, so the work
    follows the values and the boxes, not the pictures' width and height. Equal boxes are asked once. Values are
    summed as long if they are of a whole kind, else as double.
    """
    cut_, real = _clipped(boxes, sizes, by, key)
    whole = dict(values.dtypes)[value] in ("tinyint", "smallint", "int", "bigint")
    box = [*by, "x0", "y0", "x1", "y1"]
    spans = lambda a, b: F.explode(F.sequence(_tile_of(a, tile), _tile_of(b, tile)))
    asked = cut_.where(real).select(*box).distinct().withColumn("tile_y", spans("y0", "y1")).withColumn("tile_x", spans("x0", "x1"))
    inside = lambda c, t: F.least(F.greatest(F.col(c) - F.col(t) * tile, F.lit(0)), F.lit(tile - 1))
    pieces = asked.select(*box, "tile_y", "tile_x", inside("x0", "tile_x").alias("left"), inside("y0", "tile_y").alias("top"), inside("x1", "tile_x").alias("right"), inside("y1", "tile_y").alias("bottom"))
    summed = values.where(F.col(value).isNotNull() & (F.col("x") >= 0) & (F.col("y") >= 0)).groupBy(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).agg(F.sum(value).cast("long" if whole else "double").alias("v"))
    cells = summed.withColumn("tile_y", _tile_of("y", tile)).withColumn("tile_x", _tile_of("x", tile))
    kinds = dict(cut_.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in box), f"total {'long' if whole else 'double'}"])
    same = [*by, "tile_y", "tile_x"]
    cells = cells.select(*[F.col(c).alias(f"_{c}") for c in same], "y", "x", "v")
    sums = cells.groupBy(*[f"_{c}" for c in same]).cogroup(pieces.groupBy(*same)).applyInArrow(_summed_in(tile, by, whole), schema).groupBy(*box).agg(F.sum("total").alias("total"))
    return cut_.join(sums, box, "left").select(*key, _area(real), F.coalesce("total", F.lit(0)).alias("total"))
