"""Positions as column expressions: 35-bit cells, their neighbours, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LON_BITS, LAT_BITS = 18, 17
EARTH_KM = 6367.0
# Fixed value: the letters of cells, in order.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def lat_index(lat: Column) -> Column:
    ok = (lat >= -90) & (lat < 90)
    return F.when(ok, F.floor((lat + 90) / 180 * (1 << LAT_BITS))).cast("long")


def lon_index(lon: Column) -> Column:
    ok = ~F.isnan(lon) & (F.abs(lon) < float("inf"))
    return F.when(ok, F.pmod(F.floor((lon + 180) / 360 * (1 << LON_BITS)), F.lit(1 << LON_BITS))).cast("long")


def _spread(i: Column) -> Column:
    """The bits of a number below 2 ** 18 with a zero after each: halves move apart, then quarters, and so on."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        i = i.bitwiseOR(F.shiftleft(i, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return i


def interleaved(lat_i: Column, lon_i: Column) -> Column:
    """One number of both indexes' bits in turn, longitude first."""
    return _spread(lon_i.cast("long")).bitwiseOR(F.shiftleft(_spread(lat_i.cast("long")), 1))


def cell(lat: Column, lon: Column) -> Column:
    return interleaved(lat_index(lat), lon_index(lon))


def cell_text(cell_: Column) -> Column:
    """The seven base-32 letters of a cell."""
    return F.concat(*(F.substring(F.lit(ALPHABET), F.shiftright(cell_, 5 * (6 - i)).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(7)))


def cell_parsed(text: Column) -> Column:
    """The cell of seven base-32 letters; null for anything else."""
    ok = F.lower(text).rlike(f"^[{ALPHABET}]{{7}}$")
    value = F.lit(0).cast("long")
    for i in range(7):
        value = value * 32 + (F.instr(F.lit(ALPHABET), F.substring(F.lower(text), i + 1, 1)) - 1).cast("long")
    return F.when(ok, value)


def _uneven(cell_: Column, first: int, bits: int) -> Column:
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out + F.shiftleft(F.shiftright(cell_, 2 * b + first).bitwiseAND(F.lit(1)), b)
    return out


def cell_center(cell_: Column) -> Column:
    """(lat, lon) of a cell's middle."""
    lat = (_uneven(cell_, 1, LAT_BITS) + 0.5) / (1 << LAT_BITS) * 180 - 90
    lon = (_uneven(cell_, 0, LON_BITS) + 0.5) / (1 << LON_BITS) * 360 - 180
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def cell_side_m(lat: Column) -> Column:
    """The narrowest side of a cell near a latitude: its height, or its width one degree nearer the pole."""
    degree = 111_000.0
    width = 360 / (1 << LON_BITS) * degree * F.cos(F.radians(F.least(F.abs(lat) + 1, F.lit(90.0))))
    return F.least(F.lit(180 / (1 << LAT_BITS) * degree), width)


def ring(lat: Column, lon: Column, *around: int) -> Column:
    """Cells at the distances `around` a position: 8k of them at distance k, fewer at the poles; distance 0 is its own cell.

    Rows and columns are spread once each and combined, so a cell costs one operation.
    """
    far = max(around)
    rows = [lat_index(lat) + y for y in range(-far, far + 1)]
    spread = F.struct(
        F.array(*(F.when((r >= 0) & (r < 1 << LAT_BITS), F.shiftleft(_spread(r), 1)) for r in rows)).alias("y"),
        F.array(*(_spread(F.pmod(lon_index(lon) + x, F.lit(1 << LON_BITS))) for x in range(-far, far + 1))).alias("x"),
    )
    steps = [(y, x) for k in around for y in range(-k, k + 1) for x in range(-k, k + 1) if max(abs(y), abs(x)) == k]
    near = F.transform(F.array(spread), lambda s: F.array(*(F.get(s["y"], F.lit(y + far)).bitwiseOR(F.get(s["x"], F.lit(x + far))) for y, x in steps)))
    return F.filter(F.flatten(near), lambda c: c.isNotNull())


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def km_to_score(km: Column) -> Column:
    return F.when(km > 100, 0.0).otherwise(F.exp(-F.pow(km / 50, 2)))


def compensated_sum(*terms: Column) -> Column:
    """The terms' sum with what each addition loses carried along, as Python's sum does."""
    total, lost = F.lit(0.0), F.lit(0.0)
    for x in terms:
        new = total + x
        lost = lost + F.when(F.abs(total) >= F.abs(x), (total - new) + x).otherwise((x - new) + total)
        total = new
    return total + lost
