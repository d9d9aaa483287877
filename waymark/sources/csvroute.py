"""CSV files of a request, whatever their dialect: read, geocoded row by row, and written back in the same dialect.

A request's file is one text on the driver. Only its questions and their answers go through Spark; large tables are for sources.tables and operators.batch.
"""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from ..operators import batch, reverse
from ..operators.index import FIELDS, Index
from .requests import flag, number

# Result columns in their order, delimiters that are tried, and those for files of one column.
SEARCH_HEADERS = ("latitude", "longitude", "result_label", "result_score", "result_score_next", "result_type", "result_id", "result_housenumber", *(f"result_{f}" for f in FIELDS))
REVERSE_HEADERS = ("result_latitude", "result_longitude", "result_label", "result_distance", "result_type", "result_id", "result_housenumber", *(f"result_{f}" for f in FIELDS))
DELIMITERS, FREE = ",;\t|", ";,\t|~^°"
SIGNATURE = "﻿"
#: The score that a result must exceed unless told otherwise.
MIN_SCORE = 0.5


class BadRequest(ValueError):
    pass


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quotechar: str = '"'
    skipinitialspace: bool = False
    lineterminator: str = "\r\n"
    quoting: int = csv.QUOTE_MINIMAL

    def options(self) -> dict:
        return {"delimiter": self.delimiter, "quotechar": self.quotechar, "skipinitialspace": self.skipinitialspace, "lineterminator": self.lineterminator, "quoting": self.quoting, "doublequote": True}


@dataclass(frozen=True)
class Response:
    body: bytes
    content_type: str
    content_disposition: str
    warning: str | None = None


def decoded(data: bytes, encoding: str = "utf-8-sig") -> tuple[str, bool]:
    """The file's text, lines ended by \\r\\n, and whether its encoding writes a signature."""
    name = encoding.lower().replace("-", "_")
    if name not in ("utf_8", "utf8", "u8", "utf", "utf_8_sig", "utf8_sig"):
        raise BadRequest(f'Unable to decode with encoding "{encoding}"')
    signed = name.endswith("_sig")
    try:
        text = data.decode("utf-8-sig" if signed else "utf-8")
    except UnicodeDecodeError:
        raise BadRequest(f'Unable to decode with encoding "{encoding}"') from None
    content = text.replace("\r", "").replace("\n", "\r\n")
    if not content:
        raise BadRequest("Empty file")
    return content, signed


def sniffed(content: str) -> Dialect:
    """The dialect that a text seems to have; the Unix one where it has none."""
    try:
        found = csv.Sniffer().sniff(content)
    except csv.Error:
        return Dialect(lineterminator="\n", quoting=csv.QUOTE_ALL)
    return Dialect(found.delimiter, found.quotechar or '"', found.skipinitialspace)


def dialect_of(content: str, delimiter: str | None = None, quote: str | None = None) -> Dialect:
    """The dialect, with the delimiter and the quote that are asked for. A file of one column gets a delimiter that it doesn't hold."""
    out = sniffed(content)
    for name, shown, value in (("delimiter", "delimiter", delimiter), ("quotechar", "quotechar", quote)):
        if value:
            if len(value) != 1:
                raise BadRequest(f'"{shown}" must be a 1-character string')
            out = replace(out, **{name: value})
    if out.delimiter.isalnum() or out.delimiter == "\r":
        free = next((c for c in FREE if c not in content), None)
        if free is None:
            raise BadRequest('Unable to detect delimiter, please add one with "delimiter" parameter.')
        out = replace(out, delimiter=free)
    return out


def records(content: str, dialect: Dialect) -> list[list[str]]:
    options = dialect.options()
    return list(csv.reader(content.splitlines(True), **{k: v for k, v in options.items() if k not in ("lineterminator", "quoting")}))


def fitting(content: str, dialect: Dialect, columns: Sequence[str] | None = None, quote: str | None = None) -> tuple[Dialect, list[list[str]]]:
    """The records in the dialect, or, where their header lacks columns that are asked for, or is one column though a delimiter stands in it, in the first dialect that fits."""
    line = content.split("\r\n")[0]

    def fits(rows: list[list[str]]) -> bool:
        header = rows[0] if rows else []
        return all(c in header for c in columns) if columns else len(header) > 1 or not any(d in line for d in DELIMITERS)

    first = records(content, dialect)
    if fits(first):
        return dialect, first
    for delimiter in DELIMITERS:
        other = Dialect(delimiter, quote or '"')
        if fits(rows := records(content, other)):
            return other, rows
    return dialect, first


def cell(header: Sequence[str], row: Sequence[str], name: str) -> str | None:
    """A row's value in a column: of columns of one name the last; none beyond a short row's end."""
    at = len(header) - 1 - list(reversed(header)).index(name) if name in header else None
    return row[at] if at is not None and at < len(row) else None


def stem(filename: str) -> str:
    return os.path.splitext(filename)[0]


def _check(header: Sequence[str], names: Sequence[str]) -> None:
    for name in names:
        if name not in header:
            raise BadRequest(f"Cannot found column '{name}' in columns [{', '.join(map(repr, header))}]")


class _Job:
    """A request's file, read, and what it asks of each row."""

    def __init__(self, data: bytes, filename: str, params: Mapping[str, Sequence[str]]) -> None:
        self.params, self.filename = params, filename
        self.encoding = self.last("encoding") or "utf-8-sig"
        self.content, self.signed = decoded(data, self.encoding)
        dialect = dialect_of(self.content, self.last("delimiter"), self.last("quote"))
        self.bom = self.switch("with_bom", True)
        asked = list(params.get("columns") or ())
        self.dialect, rows = fitting(self.content, dialect, asked or None, (self.last("quote") or "")[:1] or None)
        self.header, self.rows = (rows[0] if rows else []), [r for r in rows[1:] if r]
        self.columns = asked or list(self.header)
        self.filters = {n: [c for v in params.get(n) or () for c in v.split(" ") if c] for n in batch.FILTERS}

    def last(self, name: str) -> str | None:
        values = self.params.get(name)
        return values[-1] if values else None

    def switch(self, name: str, blank: bool | None = None) -> bool:
        value = self.last(name)
        said = False if value is None else flag(value, blank)
        if said is None:
            raise BadRequest(f'Invalid parameter "{name}": {value}')
        return said

    def value(self, row: Sequence[str], name: str) -> str:
        return cell(self.header, row, name) or ""

    def asked_filters(self, row: Sequence[str]) -> list[list[str]]:
        return [[v for c in self.filters[n] if (v := self.value(row, c).strip())] for n in batch.FILTERS]

    def written(self, headers: Sequence[str], results: Mapping[int, Mapping[str, str]], warning: str | None = None) -> Response:
        """The rows with their results: a result's column that the file has already keeps its place, and shows its old value where there is no result."""
        every = [*self.header, *(h for h in headers if h not in self.header)]
        out = io.StringIO()
        out.write(SIGNATURE if self.encoding.startswith("utf-8") and self.bom else "")
        writer = csv.writer(out, **self.dialect.options())
        writer.writerow(every)
        for i, row in enumerate(self.rows):
            found = results.get(i)
            writer.writerow([found[h] if found is not None and h in found and h in headers else self.value(row, h) for h in every])
        body = ((SIGNATURE if self.signed else "") + out.getvalue()).encode()
        return Response(body, f"text/csv; charset={self.encoding}", f'attachment; filename="{stem(self.filename)}.geocoded.csv"', warning)


def _text(value) -> str:
    return "" if value is None else repr(value) if isinstance(value, float) else str(value)


def search_csv(index: Index, data: bytes, filename: str = "", params: Mapping[str, Sequence[str]] | None = None) -> Response:
    """The file with the best result of each row. A row whose query is too long stays without one and is named in the warning."""
    job = _Job(data, filename, params or {})
    try:
        min_score = float(job.last("min_score").strip()) if job.last("min_score") is not None else MIN_SCORE
    except ValueError:
        raise BadRequest(f'Invalid parameter "min_score": {job.last("min_score")}') from None
    fallback, plain = job.switch("postcode_fallback"), job.switch("plain_number")
    try:
        position = batch.named_position(job.last("lat"), job.last("lon"))
    except ValueError as e:
        raise BadRequest(str(e)) from None
    _check(job.header, [*job.columns, *(c for n in batch.FILTERS for c in job.filters[n]), *(position or ())])
    split = [c for c in batch.SPLIT_COLUMNS if c in (job.params.get("result_columns") or ())]
    asked = []
    for i, row in enumerate(job.rows):
        center = _center(job, row, position, i) if position else (None, None)
        asked.append((i, " ".join(job.value(row, c) for c in job.columns), *job.asked_filters(row), *center))
    shape = "qid int, query string, types array<string>, citycodes array<string>, postcodes array<string>, lat double, lon double"
    queries = index.spark.createDataFrame(asked, shape)
    long_ = [r.qid + 1 for r in queries.filter(batch.is_too_long(F.col("query"))).select("qid").collect()]
    best = batch.geocode(queries if position else queries.drop("lat", "lon"), index, min_score, fallback, plain)
    parts = batch.text.split_housenumber(F.col("housenumber"))
    shown = best.select("qid", "lat", "lon", "label", "score", F.nullif("next", F.lit(0.0)).alias("next"), "kind", "id", "housenumber", *(F.get(f, F.lit(0)).alias(f) for f in FIELDS), parts["num"].alias("num"), parts["complement"].alias("complement"), F.coalesce(parts["short"], parts["complement"]).alias("short"))
    results = {}
    for r in shown.collect():  # a row per row of the request's file
        values = [r.lat, r.lon, r.label, r.score, "0" if r.next is None else r.next, r.kind, r.id, r.housenumber, *(r[f] for f in FIELDS)]
        results[r.qid] = dict(zip((*SEARCH_HEADERS, *batch.SPLIT_COLUMNS), map(_text, [*values, r.num, r.complement, r.short])))
    return job.written([*SEARCH_HEADERS, *split], results, batch.warning(long_))


def _center(job: _Job, row: Sequence[str], position: tuple[str, str], i: int) -> tuple[float | None, float | None]:
    cells = [job.value(row, c) for c in position]
    if "" in cells:
        return None, None
    for name, text in zip(position, cells):
        if number(text) is None:
            raise BadRequest(f'invalid number "{text}" in column "{name}", row {i + 1}')
    lat, lon = map(number, cells)
    if not -90 <= lat < 90:
        raise BadRequest(f'latitude "{cells[0]}" out of range in column "{position[0]}", row {i + 1}')
    return lat, lon


def reverse_csv(index: Index, data: bytes, filename: str = "", params: Mapping[str, Sequence[str]] | None = None) -> Response:
    """The file with the address nearest each row's position; none for rows whose values are no numbers."""
    job = _Job(data, filename, params or {})
    try:
        radius = job.last("radius")
        wide = reverse.nearest_radius(job.switch("nearest"), None if radius is None else number(radius) or 0.0)
    except ValueError as e:
        raise BadRequest(str(e)) from None
    _check(job.header, [*job.columns, *(c for n in batch.FILTERS for c in job.filters[n])])
    names = [next((n for n in group if n in job.header), None) for group in (batch.LATITUDES, batch.LONGITUDES)]
    asked = []
    for i, row in enumerate(job.rows):
        lat, lon = (number(cell(job.header, row, n) or "") if n else None for n in names)
        if lat is None or lon is None:
            continue
        if not -90 <= lat < 90:
            raise BadRequest(f"latitude {lat!r} out of range, row {i + 1}")
        asked.append((i, lat, lon, *job.asked_filters(row)))
    positions = index.spark.createDataFrame(asked, "qid int, lat double, lon double, types array<string>, citycodes array<string>, postcodes array<string>")
    found = reverse.reverse(positions, index) if wide is None else reverse.nearest(positions, index, wide)
    results = {}
    for r in reverse.presented(found, index).collect():  # a row per row of the request's file
        values = [r.lat, r.lon, r.label, int(r.distance_m), r.kind, r.id, r.housenumber, *(next(iter(r[f]), None) for f in FIELDS)]
        results[r.qid] = dict(zip(REVERSE_HEADERS, map(_text, values)))
    return job.written(REVERSE_HEADERS, results)
