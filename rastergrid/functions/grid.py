"""Regular tile grids: layouts, key arithmetic and tile-count scalars.

Column 0 is the western column and row 0 the northern row. Key ranges of an
extent are half-open at the east and south edges unless ``closed`` is asked for.
A layout's methods take and return SQL text for ``F.expr``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("xmin", "ymin", "xmax", "ymax")
INT_MAX = 2**31 - 1
INT_MIN = -(2**31)


def number(value: float) -> str:
    """A double literal."""
    return f"({float(value)!r}D)"


@dataclass(frozen=True)
class Layout:
    """An extent cut into ``cols`` x ``rows`` tiles of ``tile_cols`` x ``tile_rows`` cells."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float
    cols: int
    rows: int
    tile_cols: int
    tile_rows: int

    @classmethod
    def from_cells(cls, extent, cell_w: float, cell_h: float, tile: int) -> Layout:
        """Layout of square tiles over ``extent``, grown east and south to whole tiles."""
        xmin, ymin, xmax, ymax = extent
        cols = max(1, math.ceil((xmax - xmin) / (cell_w * tile)))
        rows = max(1, math.ceil((ymax - ymin) / (cell_h * tile)))
        return cls(xmin, ymax - rows * tile * cell_h, xmin + cols * tile * cell_w, ymax,
                   cols, rows, tile, tile)

    @classmethod
    def from_tile_count(cls, extent, cols: int, rows: int, tile: int) -> Layout:
        """Layout with a fixed number of tiles over exactly ``extent``."""
        return cls(*extent, cols, rows, tile, tile)

    @property
    def tile_w(self) -> float:
        return (self.xmax - self.xmin) / self.cols

    @property
    def tile_h(self) -> float:
        return (self.ymax - self.ymin) / self.rows

    @property
    def cell_w(self) -> float:
        return self.tile_w / self.tile_cols

    @property
    def cell_h(self) -> float:
        return self.tile_h / self.tile_rows

    # SQL text -------------------------------------------------------------

    def col_of(self, x: str) -> str:
        return f"int(floor(({x} - {number(self.xmin)}) / {number(self.tile_w)}))"

    def row_of(self, y: str) -> str:
        return f"int(floor(({number(self.ymax)} - {y}) / {number(self.tile_h)}))"

    def key_extent(self, col: str = "col", row: str = "row") -> dict[str, str]:
        """Map extent of a key by column name."""
        w, h = number(self.tile_w), number(self.tile_h)
        return {
            "xmin": f"{number(self.xmin)} + ({col}) * {w}",
            "ymin": f"{number(self.ymax)} - ({row} + 1) * {h}",
            "xmax": f"{number(self.xmin)} + ({col} + 1) * {w}",
            "ymax": f"{number(self.ymax)} - ({row}) * {h}",
        }

    def key_range(self, box: tuple[str, ...] = BOX, closed: bool = False) -> dict[str, str]:
        """Inclusive key range of an extent; ``closed`` also counts tiles it only touches."""
        xmin, ymin, xmax, ymax = box
        x0 = f"({xmin} - {number(self.xmin)}) / {number(self.tile_w)}"
        x1 = f"({xmax} - {number(self.xmin)}) / {number(self.tile_w)}"
        y0 = f"({number(self.ymax)} - {ymax}) / {number(self.tile_h)}"
        y1 = f"({number(self.ymax)} - {ymin}) / {number(self.tile_h)}"
        if closed:
            return {"cmin": f"int(ceil({x0}) - 1)", "rmin": f"int(ceil({y0}) - 1)",
                    "cmax": f"int(floor({x1}))", "rmax": f"int(floor({y1}))"}
        return {"cmin": f"int(floor({x0}))", "rmin": f"int(floor({y0}))",
                "cmax": f"int(greatest(floor({x0}), ceil({x1}) - 1))",
                "rmax": f"int(greatest(floor({y0}), ceil({y1}) - 1))"}


def named(texts: dict[str, str]) -> list[Column]:
    """Named SQL texts as select items."""
    return [F.expr(text).alias(name) for name, text in texts.items()]


def explode_keys(df: DataFrame, cmin="cmin", rmin="rmin", cmax="cmax", rmax="rmax",
                 col="col", row="row") -> DataFrame:
    """One row per key of each row's inclusive key range; the range columns are dropped.

    Two chained generators stream the keys, so no row ever holds the whole product.
    """
    out = (df.withColumn(row, F.explode(F.sequence(F.col(rmin), F.col(rmax))))
             .withColumn(col, F.explode(F.sequence(F.col(cmin), F.col(cmax)))))
    return out.drop(*{cmin, rmin, cmax, rmax} - {col, row})


def drop_negative_keys(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Drop keys west or north of the grid; with ``layout`` also those east or south of it."""
    out = df.where((F.col("col") >= 0) & (F.col("row") >= 0))
    if layout is not None:
        out = out.where((F.col("col") < layout.cols) & (F.col("row") < layout.rows))
    return out


def keys_for_extent(extents: DataFrame, layout: Layout) -> DataFrame:
    """Keys covering each row's extent, cut at the layout's upper bounds."""
    rng = layout.key_range()
    capped = rng | {"cmax": f"least({rng['cmax']}, {layout.cols - 1})",
                    "rmax": f"least({rng['rmax']}, {layout.rows - 1})"}
    ranged = extents.select("*", *named(capped))
    return explode_keys(ranged.where("cmin <= cmax and rmin <= rmax"))


def keys_for_raster(rasters: DataFrame, tile_size: int) -> DataFrame:
    """Keys of each raster over its own grid of ceil(map width / tile size) tiles per axis."""
    counted = rasters.select(
        "*",
        F.lit(0).alias("cmin"), F.lit(0).alias("rmin"),
        (tile_ceiling_count(F.col("xmax") - F.col("xmin"), tile_size) - 1).cast("int").alias("cmax"),
        (tile_ceiling_count(F.col("ymax") - F.col("ymin"), tile_size) - 1).cast("int").alias("rmax"))
    return explode_keys(counted.where("cmax >= 0 and rmax >= 0"))


def layout_from_extent(extents: DataFrame, cell_w: float, cell_h: float, tile: int) -> DataFrame:
    """The layout of each row's extent as a relation of its defining numbers."""
    w, h = F.lit(float(cell_w * tile)), F.lit(float(cell_h * tile))
    cols = F.greatest(F.lit(1), F.ceil((F.col("xmax") - F.col("xmin")) / w)).cast("int")
    rows = F.greatest(F.lit(1), F.ceil((F.col("ymax") - F.col("ymin")) / h)).cast("int")
    return extents.select(
        F.col("xmin").alias("xmin"), (F.col("ymax") - rows * h).alias("ymin"),
        (F.col("xmin") + cols * w).alias("xmax"), F.col("ymax").alias("ymax"),
        cols.alias("cols"), rows.alias("rows"),
        F.lit(tile).alias("tile_cols"), F.lit(tile).alias("tile_rows"))


# Tile-count scalars --------------------------------------------------------

def _saturate(c: Column) -> Column:
    """To a 32-bit integer range: NaN gives 0, anything outside clamps to the ends."""
    clamped = F.least(F.greatest(c, F.lit(float(INT_MIN))), F.lit(float(INT_MAX)))
    return F.when(F.isnan(c), F.lit(0)).otherwise(clamped.cast("int"))


def tile_floor_count(x: Column, size: int) -> Column:
    return _saturate(F.floor(x / F.lit(float(size))).cast("double"))


def tile_ceiling_count(x: Column, size: int) -> Column:
    return _saturate(F.ceil(x / F.lit(float(size))).cast("double"))


def tile_floor_value(x: Column, size: int) -> Column:
    return tile_floor_count(x, size).cast("bigint") * size


def tile_ceiling_value(x: Column, size: int) -> Column:
    return tile_ceiling_count(x, size).cast("bigint") * size
