"""Positions on a sphere: Morton codes, chords, and covers of a radius by code ranges.

Codes take single precision and 22 bits an axis: longitude or right ascension on even bits, latitude or declination on
odd bits. Distances take double precision.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 22
CELLS = (1 << BITS) - 1
EVEN = 0x5555555555555555


@dataclass(frozen=True)
class Sphere:
    """Least coordinates, and length of a degree in the unit of radii."""

    min_lat: float
    min_lon: float
    unit: float

    @property
    def radius(self) -> float:
        return self.unit * 180.0 / math.pi


EARTH = Sphere(-90.0, -180.0, 111.3195)
CELESTIAL = Sphere(-90.0, 0.0, 1.0)


def _internal(lat: Column, lon: Column, sphere: Sphere) -> tuple[Column, Column]:
    """Shifted to start at 0, wrapped, and reflected beyond the poles; single precision."""
    f = lambda c: c.cast("float")
    wrap = lambda c: F.when(c < 0, f(c + F.lit(360.0).cast("float"))).otherwise(c)
    y = wrap(f(f(f(lat) - f(F.lit(sphere.min_lat))) % f(F.lit(360.0))))
    x = f(f(lon) - f(F.lit(sphere.min_lon)))
    over = y > 180
    y, x = F.when(over, f(f(F.lit(360.0)) - y)).otherwise(y), F.when(over, f(x + f(F.lit(180.0)))).otherwise(x)
    return y, wrap(f(x % f(F.lit(360.0))))


def _grid(value: Column, span: float) -> Column:
    share = (value / F.lit(float(span)).cast("float")).cast("float")
    return F.greatest(F.lit(0), F.least(F.lit(CELLS), (share * F.lit(float(CELLS)).cast("float")).cast("float").cast("long"))).cast("long")


def _spread(c: Column) -> Column:
    """Bits to even places: binary digits read in base 4. The argument stands once, so plans that inline codes stay small."""
    return F.conv(F.bin(c), 4, 10).cast("long")


def _compact(c: Column) -> Column:
    """Even bits to a number: what _spread undoes."""
    return F.conv(F.conv(c.bitwiseAND(F.lit(EVEN)).cast("string"), 10, 4), 2, 10).cast("long")


def encode(lat: Column, lon: Column, sphere: Sphere = EARTH) -> Column:
    """Morton code of a position."""
    y, x = _internal(lat, lon, sphere)
    return _spread(_grid(x, 360)).bitwiseOR(F.shiftleft(_spread(_grid(y, 180)), 1))


def decode(code: Column, sphere: Sphere = EARTH) -> tuple[Column, Column]:
    """Latitude and longitude of the lower corner of a code's cell."""
    x, y = _compact(code), _compact(F.shiftright(code, 1))
    return y / F.lit(float(CELLS)) * 180.0 + sphere.min_lat, x / F.lit(float(CELLS)) * 360.0 + sphere.min_lon


def chord_squared(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Squared chord between a position and a fixed one on the unit sphere; what top-k orders by."""
    a, b = math.radians(lat0), math.radians(lon0)
    phi, lam = F.radians(lat), F.radians(lon)
    dx = F.cos(phi) * F.cos(lam) - math.cos(a) * math.cos(b)
    dy = F.cos(phi) * F.sin(lam) - math.cos(a) * math.sin(b)
    dz = F.sin(phi) - math.sin(a)
    return dx * dx + dy * dy + dz * dz


def radius_chord_squared(radius: float, sphere: Sphere = EARTH) -> float:
    """The squared chord that a radius, at most half the circumference, spans."""
    if radius < 0:
        raise ValueError("a radius can't be negative")
    return 4 * math.sin(min(radius / sphere.radius, math.pi) / 2) ** 2


def haversine(lat: Column, lon: Column, lat0: float, lon0: float, sphere: Sphere = EARTH) -> Column:
    """Great-circle distance in the sphere's unit."""
    return 2 * sphere.radius * F.asin(F.least(F.lit(1.0), F.sqrt(chord_squared(lat, lon, lat0, lon0)) / 2))


def format_position(lat: Column, lon: Column) -> Column:
    return F.format_string("%.4f, %.4f", lat.cast("double"), lon.cast("double"))


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, with those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def radius_cover(lat: float, lon: float, radius: float, sphere: Sphere = EARTH, most: int = 16) -> list[tuple[int, int]]:
    """At most `most` disjoint, sorted code ranges that hold every position within the radius.

    The box around the circle (the whole turn if it reaches a pole, two boxes where it crosses the seam) is cut into quadtree cells; the cell
    with the most area outside the box is cut first, while ranges are left.
    """
    degrees = math.degrees(min(radius / sphere.radius, math.pi)) + 1e-4  # slack for single precision
    south, north = lat - degrees, lat + degrees
    scale_y, scale_x = CELLS / 180.0, CELLS / 360.0
    row = lambda v: min(CELLS, max(0, int((v - sphere.min_lat) * scale_y)))
    y0, y1 = max(0, row(south) - 2), min(CELLS, row(north) + 2)
    if south <= -90 or north >= 90:
        spans = [(0, CELLS)]
    else:
        wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(min(degrees, 90))) / math.cos(math.radians(lat))))) + 1e-4
        start, end = ((lon - sphere.min_lon - wide) % 360.0), ((lon - sphere.min_lon + wide) % 360.0)
        a, b = max(0, int(start * scale_x) - 2), min(CELLS, int(end * scale_x) + 2)
        spans = [(0, CELLS)] if wide >= 180 else [(a, b)] if start <= end else [(a, CELLS), (0, b)]

    def inside(x: int, y: int, size: int) -> int:
        """Cells of the quadtree block that some box holds."""
        tall = max(0, min(y + size - 1, y1) - max(y, y0) + 1)
        return tall * sum(max(0, min(x + size - 1, b) - max(x, a) + 1) for a, b in spans)

    def code(x: int, y: int) -> int:
        return sum(((x >> i & 1) << (2 * i)) | ((y >> i & 1) << (2 * i + 1)) for i in range(BITS))

    heap = [(-((1 << 2 * BITS) - inside(0, 0, 1 << BITS)), 0, 0, 1 << BITS)]
    done: list[tuple[int, int, int]] = []
    while heap and len(heap) + len(done) < 4 * most:
        waste, x, y, size = heapq.heappop(heap)
        if waste == 0 or size == 1:
            done.append((x, y, size))
            continue
        half = size // 2
        for dx in (0, half):
            for dy in (0, half):
                if held := inside(x + dx, y + dy, half):
                    heapq.heappush(heap, (held - half * half, x + dx, y + dy, half))
    blocks = done + [(x, y, s) for _, x, y, s in heap]
    ranges = merge_ranges([(code(x, y), code(x, y) + s * s - 1) for x, y, s in blocks])
    while len(ranges) > most:  # close the smallest gap
        i = min(range(len(ranges) - 1), key=lambda k: ranges[k + 1][0] - ranges[k][1])
        ranges[i : i + 2] = [(ranges[i][0], ranges[i + 1][1])]
    return ranges


def in_ranges(code: Column, ranges: list[tuple[int, int]]) -> Column:
    """A predicate that Parquet scans can push down."""
    out = F.lit(False)
    for i, (lo, hi) in enumerate(ranges):
        one = code.between(lo, hi)
        out = one if i == 0 else out | one
    return out
