"""Search results as GeoJSON texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.index import FIELDS

# What a collection says of itself.
ATTRIBUTION, LICENCE, VERSION = "BAN", "ETALAB-2.0", "draft"
# The types of documents, each of which names its name.
KINDS = ("municipality", "street", "locality")


def feature() -> Column:
    """A presented result as a point with its properties; null, empty and zero ones are null, which to_json leaves out.

    The name stands under the document's own type too; a house number comes before the name. A distance is cut to whole metres.
    """
    first = {f: F.get(f, F.lit(0)) for f in FIELDS}
    filled = lambda c: F.when(c != "", c)
    nonzero = lambda c: F.when(c != 0, c)
    name = F.when(F.col("housenumber").isNull(), first["name"]).otherwise(F.concat_ws(" ", "housenumber", F.coalesce(filled(first["name"]), F.lit("None"))))
    texts = {"label": F.col("label"), "score": F.col("score"), "housenumber": F.col("housenumber"), "id": F.col("id"), "banId": F.col("ban_id"), "type": F.col("kind"), "name": name} | {f: first[f] for f in ("postcode", "citycode", "oldcitycode", "city", "oldcity", "district", "context")}
    numbers = {"x": F.col("x"), "y": F.col("y"), "importance": F.col("doc_importance"), "population": F.col("population")}
    own = {k: F.when(F.col("doc_kind") == k, first["name"]) for k in KINDS}
    given = F.struct(*((c if n in ("label", "score") else filled(c)).alias(n) for n, c in texts.items()), *(nonzero(c).alias(n) for n, c in numbers.items()), *(c.alias(n) for n, c in own.items()), F.col("distance_m").cast("long").alias("distance"))
    return F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), given.alias("properties"))


def features(found: DataFrame) -> DataFrame:
    """qid, rank, feature of presented results."""
    return found.select("qid", "rank", feature().alias("feature"))


def collections(asked: DataFrame, made: DataFrame, **shown: Column) -> DataFrame:
    """qid, body: each of asked (qid) with its features, best first, and whatever else is shown of the request; one without results has an empty list."""
    listed = made.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.to_json("feature").alias("feature")))).alias("all"))
    rows = asked.join(listed, "qid", "left")
    found = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("all", F.array().cast("array<struct<rank:int,feature:string>>")), lambda x: x["feature"]), ","), F.lit("]"))
    rest = F.to_json(F.struct(F.lit(ATTRIBUTION).alias("attribution"), F.lit(LICENCE).alias("licence"), *(c.alias(n) for n, c in shown.items())))
    return rows.select("qid", F.concat(F.lit(f'{{"type":"FeatureCollection","version":"{VERSION}","features":'), found, F.lit(","), F.substring(rest, F.lit(2), F.length(rest))).alias("body"))
