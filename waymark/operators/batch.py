"""Tables in, tables out: a row's columns are its query or its position, and its result's columns come last."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import french, text
from . import fallback, reverse
from .index import FIELDS, Index
from .search import Settings, search

LATITUDES, LONGITUDES = ("latitude", "lat"), ("longitude", "lon", "lng", "long")
#: Result columns that a caller gets only by naming them.
SPLIT_COLUMNS = ("result_num", "result_num_complement", "result_num_complement_short")
FILTERS = {"type": "types", "citycode": "citycodes", "postcode": "postcodes"}


def _check(table: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in table.columns]:
        raise ValueError(f"no column {', '.join(repr(c) for c in missing)}")


def query_of(table: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The columns' values joined by one space, nulls as empty texts; all columns where none are named."""
    _check(table, columns or ())
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns or table.columns]
    return F.concat_ws(" ", *values) if values else F.lit("")


def is_too_long(query: Column) -> Column:
    """Whether a query gets no result because it has over 200 characters, folded."""
    return F.char_length(text.fold(query)) > french.MAX_QUERY


def too_long(table: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows that get no result because their queries are too long."""
    return table.filter(is_too_long(query_of(table, columns)))


def warning(rows: Sequence[int], listed: int = 100) -> str | None:
    """What a caller is told of rows, numbered from 1, whose queries are too long; None if there are none."""
    if not rows:
        return None
    return f"query_too_long; limit={french.MAX_QUERY}; count={len(rows)}; rows={','.join(str(r) for r in sorted(rows)[:listed])}"


def filter_values(columns: Sequence[str]) -> Column:
    """A row's values of a filter: those of the columns, trimmed, blanks left out."""
    return F.filter(F.array(*(F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in columns)), lambda v: v != "")


def number_of(value: Column) -> Column:
    """A finite number as Python reads it, underscores between digits included; otherwise null."""
    out = F.regexp_replace(F.trim(value.cast("string")), r"(?<=[0-9])_(?=[0-9])", "").try_cast("double")
    return F.when(F.abs(out) < float("inf"), out)


def named_position(lat: str | None, lon: str | None) -> tuple[str, str] | None:
    """The columns of a position to search around: both or neither."""
    if (lat is None) != (lon is None):
        raise ValueError('"lat" names a column without "lon"' if lon is None else '"lon" names a column without "lat"')
    return None if lat is None or lon is None else (lat, lon)


def _center(position: tuple[str, str]) -> tuple[Column, Column]:
    """A row's position: null where either cell is empty; a value that is no number, or no latitude, ends the job and is named."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in position]
    given = (cells[0] != "") & (cells[1] != "")

    def read(cell: Column, name: str) -> Column:
        value = number_of(cell)
        return F.when(given & value.isNull(), F.raise_error(F.concat(F.lit('invalid number "'), cell, F.lit(f'" in column "{name}"'))).cast("double")).when(given, value)

    lat, lon = read(cells[0], position[0]), read(cells[1], position[1])
    lat = F.when((lat < -90) | (lat >= 90), F.raise_error(F.concat(F.lit('latitude "'), cells[0], F.lit(f'" out of range in column "{position[0]}"'))).cast("double")).otherwise(lat)
    return lat, lon


def _key(*parts: Column) -> Column:
    """One text for what is asked in a row: alike for rows that ask the same."""
    return F.to_json(F.struct(*(p.alias(f"k{i}") for i, p in enumerate(parts))))


def _attached(table: DataFrame, key: Column, found: DataFrame) -> DataFrame:
    """table with found's columns, but the first, last, matched by that; columns of the same names give way."""
    results = found.columns[1:]
    kept = [c for c in table.columns if c not in results]
    name = "__key"
    while name in table.columns:
        name = f"_{name}"
    joined = table.select(*(F.col(f"`{c}`") for c in kept), key.alias(name)).join(found.withColumnRenamed(found.columns[0], name), name, "left")
    return joined.select(*(F.col(f"`{c}`") for c in kept), *results)


def _fields() -> list[Column]:
    return [F.get(c, F.lit(0)).alias(f"result_{c}") for c in FIELDS]


def geocode(queries: DataFrame, index: Index, min_score: float | None = None, postcode_fallback: bool = False, plain_number: bool = False, settings: Settings | None = None) -> DataFrame:
    """qid, the best result of each query and next, the second's rounded score (0 if there is none); nothing where the best one's rounded score is not over min_score."""
    asked = queries.withColumn("limit", F.lit(3)).withColumn("autocomplete", F.lit(False))
    found = search(asked, index, settings)
    if postcode_fallback:
        found = fallback.postcode_fallback(asked, found, index, settings)
    if plain_number:
        found = fallback.plain_number(asked, found, index)
    second = found.filter("rank = 2").select("qid", text.rounded(F.col("score")).alias("next"))
    best = found.filter("rank = 1").withColumn("score", text.rounded(F.col("score"))).join(second, "qid", "left").withColumn("next", F.coalesce("next", F.lit(0.0)))
    return best if min_score is None else best.filter(F.col("score") > min_score)


def geocode_table(
    table: DataFrame, index: Index, columns: Sequence[str] | None = None, min_score: float | None = None, filters: Mapping[str, Sequence[str]] | None = None, position: tuple[str, str] | None = None,
    wanted: Mapping[str, Sequence[str]] | None = None, postcode_fallback: bool = False, plain_number: bool = False, result_columns: Sequence[str] = (), settings: Settings | None = None,
) -> DataFrame:
    """table with 16 result columns of each row's best document; nulls where none was found, scored over min_score or the query is too long.

    filters: for type, citycode and postcode the columns whose values a row's documents must have; wanted: values for all rows. position: the columns of a position to search
    around. Each distinct question is searched once, however many rows ask it. result_score_next is 0 where a result has no second. result_columns may name those of
    SPLIT_COLUMNS, which come last. An empty table, empty queries and columns that are called like results are allowed.
    """
    query = query_of(table, columns)
    by = {}
    for name, field in FILTERS.items():
        of_rows, of_all = list((filters or {}).get(name, ())), list((wanted or {}).get(name, ()))
        _check(table, of_rows)
        if of_rows or of_all:
            by[field] = F.concat(filter_values(of_rows) if of_rows else F.array().cast("array<string>"), F.array(*map(F.lit, of_all)).cast("array<string>"))
    if position is not None:
        _check(table, position)
        by["lat"], by["lon"] = _center(position)
    key = _key(query, *by.values())
    asked = table.select(query.alias("query"), *(c.alias(n) for n, c in by.items()), key.alias("qid")).distinct()
    best = geocode(asked, index, min_score, postcode_fallback, plain_number, settings)
    parts = text.split_housenumber(F.col("housenumber"))
    short = F.coalesce(parts["short"], parts["complement"])
    split = dict(zip(SPLIT_COLUMNS, (parts["num"], parts["complement"], short)))
    rows = best.select(
        "qid", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("label").alias("result_label"), F.col("score").alias("result_score"), F.col("next").alias("result_score_next"), F.col("kind").alias("result_type"), F.col("id").alias("result_id"),
        F.col("housenumber").alias("result_housenumber"), *_fields(), *(split[c].alias(c) for c in SPLIT_COLUMNS if c in result_columns),
    )
    return _attached(table, key, rows)


def position_columns(table: DataFrame, lat: str | None = None, lon: str | None = None) -> tuple[str, str]:
    """The columns named, or else the first that are called like coordinates."""
    lat = lat or next((c for c in LATITUDES if c in table.columns), None)
    lon = lon or next((c for c in LONGITUDES if c in table.columns), None)
    if lat not in table.columns or lon not in table.columns:
        raise ValueError("no position columns: name them with lat and lon")
    return lat, lon


def reverse_table(table: DataFrame, index: Index, lat: str | None = None, lon: str | None = None, filters: Mapping[str, Sequence[str]] | None = None, radius_m: float | None = None) -> DataFrame:
    """table with 15 result columns of the nearest document; nulls where the position is no number or nothing is near.

    A latitude outside [-90, 90) ends the job and is named. Each distinct position is looked up once. radius_m: look for the nearest within it, not only in the cells around.
    """
    names = position_columns(table, lat, lon)
    a, b = (number_of(F.col(f"`{c}`")) for c in names)
    a = F.when((a < -90) | (a >= 90), F.raise_error(F.concat(F.lit("latitude "), a.cast("string"), F.lit(f' out of range in column "{names[0]}"'))).cast("double")).otherwise(a)
    by = {}
    for name, field in FILTERS.items():
        of_rows = list((filters or {}).get(name, ()))
        _check(table, of_rows)
        if of_rows:
            by[field] = filter_values(of_rows)
    key = _key(a, b, *by.values())
    asked = table.select(a.alias("lat"), b.alias("lon"), *(c.alias(n) for n, c in by.items()), key.alias("qid")).filter("lat is not null and lon is not null").distinct()
    found = reverse.reverse(asked, index) if radius_m is None else reverse.nearest(asked, index, radius_m)
    rows = reverse.presented(found, index).select(
        "qid", F.col("lat").alias("result_latitude"), F.col("lon").alias("result_longitude"), F.col("label").alias("result_label"), F.col("distance_m").cast("long").alias("result_distance"),
        F.col("kind").alias("result_type"), F.col("id").alias("result_id"), F.col("housenumber").alias("result_housenumber"), *_fields(),
    )
    return _attached(table, key, rows)
