"""Table shapes shared by the operators.

scenes    one row per scene, band and window: cells are row-major, NULL is NoData. ``ord`` is the
          scene's rank in merge order; ``c0, r0, w, h`` place the window in the scene.
tiles     one row per key and band: ``col, row, band, cells``.
features  ``fid, geom_type, rings, attrs`` and the bounding box.
"""

from __future__ import annotations

from dataclasses import dataclass

from rastergrid.functions.geometry import RINGS_TYPE

SCENE_SCHEMA = ("scene string, ord bigint, epsg int, xmin double, ymin double, xmax double, "
                "ymax double, n_cols int, n_rows int, cell_type string, band int, "
                "c0 int, r0 int, w int, h int, cells array<double>")

HEADER_SCHEMA = ("scene string, ord bigint, epsg int, xmin double, ymin double, xmax double, "
                 "ymax double, n_cols int, n_rows int, n_bands int, cell_type string, path string")

FEATURE_SCHEMA = (f"fid bigint, geom_type string, rings {RINGS_TYPE}, attrs map<string,string>, "
                  "xmin double, ymin double, xmax double, ymax double")


@dataclass(frozen=True)
class LayerMeta:
    """What one pass over the scene headers tells about a layer."""

    epsg: int
    cell_type: str
    extent: tuple[float, float, float, float]
    cell_w: float
    cell_h: float

    @property
    def n_cols(self) -> int:
        return max(1, round((self.extent[2] - self.extent[0]) / self.cell_w))

    @property
    def n_rows(self) -> int:
        return max(1, round((self.extent[3] - self.extent[1]) / self.cell_h))
