"""Requests as parameters, their values as texts: read into options, answered as GeoJSON bodies."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions import french, text
from ..operators import reverse as reverse_
from ..operators.index import Index
from ..operators.search import search
from . import geojson

# What switches may say, the names of filters and of coordinates, in the order in which they count.
TRUE, FALSE = ("true", "True", "t", "yes", "y", "1", "on"), ("false", "False", "f", "no", "n", "0", "off")
FILTERS, LAT, LON = ("type", "citycode", "postcode"), ("lat", "latitude"), ("lon", "lng", "long", "longitude")


class Refused(ValueError):
    """A request that can't be answered: status, title and description."""

    def __init__(self, title: str, description: str | None = None, status: int = 400) -> None:
        super().__init__(description or title)
        self.status, self.title, self.description = status, title, description

    def body(self) -> dict:
        return {"title": self.title} | ({"description": self.description} if self.description is not None else {})


def _invalid(name: str, why: str) -> Refused:
    return Refused("Invalid parameter", f'The "{name}" parameter is invalid. {why}')


def _missing(name: str) -> Refused:
    return Refused("Missing parameter", f'The "{name}" parameter is required.')


def flag(value: str, blank: bool | None = None) -> bool | None:
    """What a switch says; None for anything else. blank: what an empty one says."""
    return True if value in TRUE else False if value in FALSE else blank if value == "" else None


def whole_number(value: str) -> int | None:
    """int() of a text, but None for what is no whole number."""
    return int(value) if re.fullmatch(r"\s*[+-]?[0-9]+(_[0-9]+)*\s*", value) else None


def number(value: str) -> float | None:
    """float() of a text, but None for what is no finite number."""
    if not re.fullmatch(r"\s*[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?\s*", value):
        return None
    out = float(value)
    return out if math.isfinite(out) else None


def _last(params: Sequence[tuple[str, str]], *names: str) -> tuple[str, str] | None:
    """The first of the names that is given, with its last value."""
    return next(((n, [v for k, v in params if k == n][-1]) for n in names if any(k == n for k, _ in params)), None)


def filters(params: Iterable[tuple[str, str]]) -> dict[str, list[str]]:
    """The values of each filter that is named: those that hold a space parted by spaces, others trimmed."""
    out: dict[str, list[str]] = {}
    params = list(params)
    for name in FILTERS:
        given = [v for k, v in params if k == name]
        if given:
            out[name] = [w for v in given for w in ([x.strip() for x in v.split(" ") if x.strip()] if " " in v else [v.strip()])]
    return out


def _asked(named: dict[str, list[str]]) -> dict[str, list[str]]:
    """What a search takes of the filters. A type that is given but says nothing still turns house numbers off."""
    return {"types": named["type"] or [""] if "type" in named else None, "citycodes": named.get("citycode"), "postcodes": named.get("postcode")}


def coordinates(params: Sequence[tuple[str, str]]) -> tuple[float | None, float | None]:
    """Latitude and longitude, each by the first of its names that is given."""
    out = []
    for names, most in ((LAT, 90.0), (LON, 180.0)):
        got = _last(params, *names)
        value = None if got is None else number(got[1])
        if got is not None and value is None:
            raise _invalid(got[0], "invalid value")
        out.append((names[0], most, value))
    for name, most, value in reversed(out):
        if value is not None and abs(value) > most:
            raise _invalid(name, "out of range")
    return out[0][2], out[1][2]


@dataclass(frozen=True)
class Request:
    limit: int
    lat: float | None
    lon: float | None
    named: dict[str, list[str]] = field(default_factory=dict)
    query: str = ""
    autocomplete: bool = True
    nearest: float | None = None


def read_search(params: Sequence[tuple[str, str]]) -> Request:
    """A search: q is required, the last of a repeated parameter counts, a limit of 0 is 5, autocomplete is on unless told otherwise."""
    query = _last(params, "q")
    if query is None or not query[1]:
        raise _missing("q")
    limit = _limit(params, 5)
    if not 1 <= limit <= 100:
        raise _invalid("limit", "out of range (1..100)")
    given = _last(params, "autocomplete")
    autocomplete = True if given is None else flag(given[1], True)
    if autocomplete is None:
        raise _invalid("autocomplete", 'The value of the parameter must be "true" or "false".')
    lat, lon = coordinates(params)
    return Request(limit, lat, lon, filters(params), query[1], autocomplete)


def _limit(params: Sequence[tuple[str, str]], default: int) -> int:
    given = _last(params, "limit")
    if given is None:
        return default
    value = whole_number(given[1])
    if value is None:
        raise _invalid("limit", "The value must be an integer.")
    return value or default


def read_reverse(params: Sequence[tuple[str, str]]) -> Request:
    """A position: both coordinates are required; a negative limit leaves out as many results from the end."""
    lat, lon = coordinates(params)
    for name, value in (("lon", lon), ("lat", lat)):
        if value is None:
            raise _missing(name)
    limit = _limit(params, 1)
    near, radius = _last(params, "nearest"), _last(params, "radius")
    asked = False if near is None else flag(near[1])
    if asked is None:
        raise Refused(f'invalid "nearest": {near[1]}')
    try:
        wide = reverse_.nearest_radius(asked, None if radius is None else number(radius[1]) or 0.0)
    except ValueError as e:
        raise Refused(str(e)) from None
    if wide is not None and not 1 <= limit <= 100:
        raise _invalid("limit", "out of range (1..100)")
    return Request(limit, lat, lon, filters(params), nearest=wide)


_SHAPE = "qid int, query string, limit int, autocomplete boolean, types array<string>, citycodes array<string>, postcodes array<string>, lat double, lon double"


def _frame(index: Index, request: Request, center: bool):
    asked = _asked(request.named)
    lat, lon = (request.lat, request.lon) if center else (None, None)
    return index.spark.createDataFrame([(0, request.query, request.limit, request.autocomplete, asked["types"], asked["citycodes"], asked["postcodes"], lat, lon)], _SHAPE)


def _answer(asked, found, shown: dict) -> dict:
    body = json.loads(geojson.collections(asked.select("qid"), geojson.features(found)).first().body)
    return body | shown


def search_json(index: Index, params: Sequence[tuple[str, str]]) -> dict:
    """What a search request is answered."""
    request = read_search(params)
    both = request.lat is not None and request.lon is not None
    asked = _frame(index, request, both)
    length = asked.select(F.char_length(text.fold(F.col("query"))).alias("n")).first().n
    if length > french.MAX_QUERY:
        raise Refused(f"Query too long, {length} chars, limit is {french.MAX_QUERY}", status=413)
    rows = asked if both else asked.drop("lat", "lon")
    shown: dict = {"query": request.query}
    if request.named:
        shown["filters"] = request.named
    if both and request.lat and request.lon:
        shown["center"] = [request.lon, request.lat]
    return _answer(asked, search(rows, index), shown | {"limit": request.limit})


def reverse_json(index: Index, params: Sequence[tuple[str, str]]) -> dict:
    """What a request for a position is answered."""
    request = read_reverse(params)
    asked = _frame(index, request, True)
    most = request.limit if request.limit > 0 else 2**31 - 1
    found = reverse_.reverse(asked, index, most) if request.nearest is None else reverse_.nearest(asked, index, request.nearest, most)
    if request.limit < 0:
        found = found.filter(F.col("rank") <= found.count() + request.limit)
    shown = {"filters": request.named} if request.named else {}
    return _answer(asked, reverse_.presented(found, index), shown | {"limit": request.limit})


def health(index: Index, version: str = "1") -> dict:
    return {"status": "HEALTHY", "version": version, "documents": index.documents.count(), "cores": index.spark.sparkContext.defaultParallelism}
