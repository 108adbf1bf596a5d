"""The global integer lattice that points, cells and tiles share, rigid frames, and the map projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: metres per US survey foot.
FT = 0.3048006096012192


def cell_of(value: Column, size: float) -> Column:
    """Index of the lattice cell that holds a coordinate. Never derived from a tile's own origin."""
    return F.floor(value / F.lit(float(size))).cast("bigint")


def cell_centre(index: Column, size: float) -> Column:
    return (index + F.lit(0.5)) * F.lit(float(size))


def floor_div(value: Column, by: int) -> Column:
    """Whole division that rounds down for negative values too."""
    return F.floor(value / F.lit(by)).cast("bigint")


def with_cells(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn("cx", cell_of(F.col(x), size)).withColumn("cy", cell_of(F.col(y), size))


def tile_key(tile_x: Column, tile_y: Column) -> Column:
    """``x+00012_y-00003``."""
    return F.format_string("x%+06d_y%+06d", tile_x, tile_y)


def column_letters(index: Column) -> Column:
    """Spreadsheet letters of a zero-based index: A..Z, AA..ZZ, AAA..ZZZ (18,278 columns)."""
    def letter(n: Column) -> Column:
        return F.char(F.lit(65) + (n % 26).cast("int"))

    two = F.floor((index - 26) / 26)
    three = F.floor((index - 702) / 676)
    return (
        F.when(index < 26, letter(index))
        .when(index < 702, F.concat(letter(two), letter((index - 26) % 26)))
        .otherwise(F.concat(letter(three), letter(F.floor((index - 702) / 26) % 26), letter((index - 702) % 26)))
    )


class Frame:
    """A rigid right-handed frame: an origin in feet and a bearing; +y of the frame points along the bearing."""

    def __init__(self, bearing_rad: float, origin_x: float, origin_y: float, scale: float, grid_step_mm: float):
        if scale <= 0 or grid_step_mm <= 0 or not all(map(math.isfinite, (bearing_rad, origin_x, origin_y))):
            raise ValueError("a frame needs a finite origin and bearing, and a positive scale and grid step")
        self.origin = (origin_x, origin_y)
        self.y_axis = (math.sin(bearing_rad), math.cos(bearing_rad))
        self.x_axis = (math.cos(bearing_rad), -math.sin(bearing_rad))
        self.mm_per_ft = FT * 1000.0 / scale
        self.cell_ft = grid_step_mm / self.mm_per_ft

    def to_frame(self, x: Column, y: Column) -> tuple[Column, Column]:
        dx, dy = x - self.origin[0], y - self.origin[1]
        return dx * self.x_axis[0] + dy * self.x_axis[1], dx * self.y_axis[0] + dy * self.y_axis[1]

    def to_world(self, u: Column, v: Column) -> tuple[Column, Column]:
        return (
            u * self.x_axis[0] + v * self.y_axis[0] + self.origin[0],
            u * self.x_axis[1] + v * self.y_axis[1] + self.origin[1],
        )


# The Long Island zone of the state plane (Lambert conformal conic, two parallels), GRS80, US survey feet.
LCC = {
    "a": 6378137.0, "inv_f": 298.257222101, "lat1": 40.0 + 40.0 / 60, "lat2": 41.0 + 2.0 / 60,
    "lat0": 40.0 + 10.0 / 60, "lon0": -74.0, "false_east_m": 300000.0,
}


def _lcc_constants() -> tuple[float, float, float, float]:
    f = 1 / LCC["inv_f"]
    e = math.sqrt(f * (2 - f))

    def m(lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)

    def t(lat: float) -> float:
        s = e * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    p1, p2, p0 = (math.radians(LCC[k]) for k in ("lat1", "lat2", "lat0"))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    big_f = m(p1) / (n * t(p1) ** n)
    return e, n, LCC["a"] * big_f, LCC["a"] * big_f * t(p0) ** n


def project_lcc(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees to state-plane feet."""
    e, n, scale, rho0 = _lcc_constants()
    phi = F.radians(lat)
    s = F.sin(phi) * e
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((F.lit(1.0) - s) / (F.lit(1.0) + s), F.lit(e / 2))
    rho = F.pow(t, F.lit(n)) * scale
    theta = F.radians(lon - LCC["lon0"]) * n
    return (rho * F.sin(theta) + LCC["false_east_m"]) / FT, (F.lit(rho0) - rho * F.cos(theta)) / FT
