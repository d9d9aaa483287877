"""Gazetteers: strict NDJSON documents, and a view of the part table that stands in for one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXTS = ("name", "postcode", "citycode", "city", "context", "oldcitycode", "oldcity", "district")
_NUMBERS = ("x", "y", "lon", "lat", "importance", "population")
KNOWN = {"id", "banId", "type", "housenumbers", *_TEXTS, *_NUMBERS}


_ENTRY = ("id", "banId", "x", "y", "lon", "lat")


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Documents of NDJSON (gzip by suffix): text fields as arrays of values, numbers as doubles, house numbers as a map in the order given.

    A line with an unknown field, its house numbers' too, without lon or lat, or with a whole number beyond 64 bits ends the job and is shown in the error. Blank lines don't count.
    """
    line = spark.read.text(path).filter(F.trim("value") != "")
    strange = lambda text, known: F.coalesce(F.size(F.array_except(F.json_object_keys(text), F.array(*(F.lit(k) for k in sorted(known))))), F.lit(1)) != 0
    field = lambda name: F.get_json_object("value", f"$.{name}")
    lat, lon = field("lat").try_cast("double"), field("lon").try_cast("double")
    entries = F.from_json(field("housenumbers"), "map<string,string>")
    bad_entries = F.exists(F.map_values(F.coalesce(entries, F.create_map().cast("map<string,string>"))), lambda e: strange(e, _ENTRY) | F.get_json_object(e, "$.lat").isNull() | F.get_json_object(e, "$.lon").isNull())
    wide = F.greatest(F.lit(False), *(F.coalesce(field(n).rlike("^-?[0-9]{16,}$") & (F.abs(field(n).try_cast("decimal(38,0)")) > 9223372036854775807), F.lit(False)) for n in _NUMBERS))
    bad = strange(F.col("value"), KNOWN) | lat.isNull() | lon.isNull() | bad_entries | wide
    checked = line.withColumn("ok", F.when(bad, F.raise_error(F.concat(F.lit("not a document: "), F.left("value", F.lit(200))))).otherwise(F.lit(True)))
    values = lambda name: F.when(F.left(field(name), F.lit(1)) == "[", F.from_json(field(name), "array<string>")).when(F.coalesce(field(name), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(field(name)))
    number = "map<string,struct<id:string,banId:string,x:double,y:double,lon:double,lat:double>>"
    return checked.filter("ok").select(field("id").alias("id"), field("banId").alias("ban_id"), field("type").alias("kind"), *(values(n).alias(n) for n in _TEXTS), *(field(n).try_cast("double").alias(n) for n in _NUMBERS), F.from_json(field("housenumbers"), number).alias("housenumbers"))


def of_parts(part: DataFrame) -> DataFrame:
    """A gazetteer made of the part table: every part is a street or a municipality, with the house numbers 1 to p_size modulo 7."""
    key, n = F.col("p_partkey"), F.col("p_size") % 7
    lat, lon = 42.0 + key * 37 % 900 / 100, -1.0 + key * 53 % 700 / 100
    number = lambda i: F.struct(i.cast("string").alias("key"), F.struct(F.concat_ws("_", key.cast("string"), i.cast("string")).alias("id"), F.lit(None).cast("string").alias("banId"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (lon + i / 1000).alias("lon"), (lat + i / 1000).alias("lat")).alias("value"))
    numbers = F.when(n > 0, F.map_from_entries(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), number)))
    return part.select(
        key.cast("string").alias("id"), F.when(F.col("p_size") % 10 == 0, "municipality").otherwise("street").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("city"), F.col("p_type").alias("context"),
        F.lpad((F.col("p_size") * 1000).cast("string"), 5, "0").alias("postcode"), (F.col("p_retailprice") / 1000).alias("importance"), lat.alias("lat"), lon.alias("lon"), numbers.alias("housenumbers"),
    )
