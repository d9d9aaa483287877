"""Second thoughts on a search: without a postcode that may be wrong, and the plain number where a street lacks the suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import french, text
from .index import Index, of_docs
from .search import Settings, housenumber_checks, search

#: The rounded score from which a house number is trusted, and a street for its plain number.
CONFIDENT = 0.62
# The communes of which arrondissements are parts, with the first and last of their codes.
ARRONDISSEMENTS = (("75101", "75120", "75056"), ("13201", "13216", "13055"), ("69381", "69389", "69123"))


def city_of(citycode: Column) -> Column:
    """The commune that an arrondissement belongs to; other codes stay."""
    out = F.when(F.lit(False), citycode)
    for first, last, whole in ARRONDISSEMENTS:
        out = out.when(citycode.rlike("^[0-9]{5}$") & citycode.between(first, last), whole)
    return out.otherwise(citycode)


def confident() -> Column:
    return F.coalesce(F.col("housenumber").isNotNull() & (text.rounded(F.col("score")) >= CONFIDENT), F.lit(False))


def _named_in(asked: Column) -> Column:
    """Whether words of a query hold the commune of a result, as it is or was called."""
    return F.exists(F.concat("city", "oldcity"), lambda name: french.names(asked, french.words(name)))


def several_postcodes(results: DataFrame, index: Index) -> DataFrame:
    """results with several: whether the commune spans several postcodes, as its municipality lists them; unknown counts as several."""
    towns = index.documents.filter((F.col("kind") == "municipality") & (F.size("name") > 0)).select("doc", F.size("postcode").alias("n"), F.explode("citycode").alias("town"))
    first = towns.groupBy("town").agg(F.min_by("n", "doc").alias("n_postcodes"))
    known = results.withColumn("town", city_of(F.get("citycode", F.lit(0)))).join(first, "town", "left")
    return known.withColumn("several", F.coalesce(F.col("n_postcodes") > 1, F.lit(True))).drop("town", "n_postcodes")


def _namesakes(rescued: DataFrame, index: Index, settings: Settings | None) -> DataFrame:
    """qid of rescued results (qid, query, and the result) that left a commune of the same name behind, in the département of the query's postcode."""
    own = french.departement(F.get("postcode", F.lit(0)))
    codes = french.postcodes(F.col("query"))
    away = rescued.filter(F.get("postcode", F.lit(0)).isNotNull()).filter(~F.exists(codes, lambda c: french.departement(c) == own))
    asked = away.select("qid", F.explode(F.concat("city", "oldcity")).alias("name"), codes.alias("codes")).select("qid", "name", F.explode("codes").alias("code"))
    asked = asked.withColumn("again", F.concat_ws(" ", "name", "code"))
    found = search(asked.select(F.col("again").alias("qid"), F.col("again").alias("query"), F.lit(10).alias("limit")).distinct(), index, settings)
    towns = found.filter("doc_kind = 'municipality'").select(F.col("qid").alias("again"), F.col("name").alias("names"), F.col("postcode").alias("posts"))
    here = F.exists("names", lambda n: french.words(n) == french.words(F.col("name"))) & F.exists("posts", lambda p: french.departement(p) == french.departement(F.col("code")))
    return asked.join(towns, "again").filter(here).select("qid").distinct()


def postcode_fallback(queries: DataFrame, found: DataFrame, index: Index, settings: Settings | None = None) -> DataFrame:
    """found, where the query without its postcode finds a confident house number in a commune that it names replaced by what that finds.

    Tried where no house number was found with confidence and the postcode may matter: the best result isn't a place in a commune that the query names and that has one
    postcode. A rescue that leaves a commune of the same name behind, in the postcode's département, doesn't count.
    """
    best = found.filter("rank = 1")
    first = queries.select("qid", F.col("query").cast("string").alias("query")).join(several_postcodes(best, index), "qid", "left").withColumn("sure", confident())
    worth = F.col("doc").isNull() | F.col("housenumber").isNotNull() | ~F.coalesce(_named_in(french.words(F.col("query"))), F.lit(False)) | F.col("several")
    tried = first.filter(~F.col("sure") & worth).select("qid", french.without_postcode(F.col("query")).alias("without")).filter("without is not null")
    again = queries.join(tried, "qid").drop("query").withColumnRenamed("without", "query")
    if again.isEmpty():
        return found
    retried = search(again, index, settings)
    asked = queries.select("qid", F.col("query").cast("string").alias("query"))
    rescued = retried.filter("rank = 1").join(asked, "qid").filter(confident() & _named_in(french.words(F.col("query"))))
    good = rescued.join(_namesakes(rescued, index, settings), "qid", "left_anti").select("qid").distinct()
    return found.join(good, "qid", "left_anti").unionByName(retried.join(good, "qid", "left_semi"))


def plain_number(queries: DataFrame, found: DataFrame, index: Index, least: float | None = CONFIDENT) -> DataFrame:
    """found, where the best result of a query with a number and a suffix is a street that has only the plain number made that number; scores stay the street's.

    least: the rounded score from which a street is trusted; None for any.
    """
    given = F.col("types").cast("array<string>") if "types" in queries.columns else F.lit(None).cast("array<string>")
    number = F.array_join(F.transform(F.filter(french.search_tokens(F.col("query").cast("string"), index.synonyms), lambda t: t["housenumber"]), lambda t: t["value"]), "")
    digits = F.regexp_extract(number, "^([0-9]+)[^0-9].*$", 1)
    asked = queries.filter(housenumber_checks(given)[0]).select("qid", digits.alias("digits")).filter("digits <> ''")
    tokens = asked.select("digits").distinct().select("digits", french.housenumber_token(F.col("digits"), index.synonyms).alias("token"))
    (housenumbers,) = of_docs(found.filter("rank = 1"), index.housenumbers)
    numbers = housenumbers.select("doc", "token", *(F.col(c).alias(f"n_{c}") for c in ("number", "id", "ban_id", "x", "y", "lat", "lon")))
    sure = F.lit(True) if least is None else text.rounded(F.col("score")) >= least
    plain = found.filter((F.col("rank") == 1) & F.col("housenumber").isNull() & sure).select("qid", "doc").join(asked, "qid").join(tokens, "digits").join(numbers, ["doc", "token"]).drop("digits", "token", "doc").withColumn("rank", F.lit(1))
    met = found.join(plain, ["qid", "rank"], "left")
    named = F.when(F.size("name") > 0, F.col("name")).otherwise(F.array(F.lit("")))
    called = french.labels(named, F.get("postcode", F.lit(0)), F.col("city"), F.col("n_number"), F.lit("housenumber"))
    hit = F.col("n_number").isNotNull()
    changes = {"labels": called, "label": F.get(called, F.lit(0)), "kind": F.lit("housenumber"), "housenumber": F.col("n_number"), **{c: F.col(f"n_{c}") for c in ("id", "ban_id", "x", "y", "lat", "lon")}}
    return met.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in found.columns))
