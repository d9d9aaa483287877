"""The index: eight tables made of documents by DataFrame jobs, written once and read by every search.

documents: id, kind, name, postcode, city, context, citycode, oldcitycode, oldcity, district (each a text or an array of texts), lat, lon, and
ban_id, x, y, importance, population, housenumbers (number -> id, banId, x, y, lon, lat, in the order given) where there are such columns.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields as fields_of

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import french, geo, synonyms as S, text
from ..sources.store import exists, new_folder, renamed, written

FORMAT = 1
#: Boosts of the fields; a municipality's postcode counts more.
NAME_BOOST, FIELD_BOOST, MUNICIPALITY_POSTCODE_BOOST, IMPORTANCE_WEIGHT = 4.0, 1.0, 1.2, 0.1
NGRAM_LEAST, NGRAM_MOST = 3, 20
FIELDS = ("name", "postcode", "city", "context", "citycode", "oldcitycode", "oldcity", "district")
_NUMBERS = ("x", "y", "lat", "lon", "importance", "population")
#: A house number as the index keeps it.
NUMBER = "struct<number:string,id:string,ban_id:string,x:double,y:double,lat:double,lon:double>"


@dataclass(frozen=True)
class Index:
    """The tables and the synonyms they were made with.

    documents(doc, id, kind, fields..., words: token -> score, types, near: cells, folded: its folded labels and their grams), postings(token, doc, score), tokens(token, df, max_score),
    pairs(token, other), edge_ngrams(ngram, token), filters(name, value, doc), cells(cell, doc), housenumbers(doc, token, number...).
    """

    documents: DataFrame
    postings: DataFrame
    tokens: DataFrame
    pairs: DataFrame
    edge_ngrams: DataFrame
    filters: DataFrame
    cells: DataFrame
    housenumbers: DataFrame
    synonyms: dict

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession


TABLES = tuple(f.name for f in fields_of(Index))[:-1]
#: Numbers of documents up to this many go to every machine.
FEW_DOCS = 200_000


def of_docs(rows: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """What tables by doc hold of the documents in rows, to be joined by sorting: a table's files say little of its size in memory, so it must never be sent to all machines whole.

    Where rows name many documents, the tables as they are.
    """
    docs = written(rows.select("doc").distinct(), "docs")
    few = docs.count() <= FEW_DOCS
    return [(t.join(F.broadcast(docs), "doc", "left_semi") if few else t).hint("merge") for t in tables]


def numbered(documents: DataFrame) -> DataFrame:
    """documents with doc, the rank by falling importance, then id; ranges are sorted by themselves and counted on from each other."""
    spark = documents.sparkSession
    if "doc" in documents.columns:
        return documents
    order = (F.coalesce(F.col("importance"), F.lit(0.0)).desc(), F.col("id").asc())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(documents.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id()), "numbered")
    part, at = F.shiftright("doc", 33), F.col("doc").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    base = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row per range
    return placed.withColumn("part", part).join(F.broadcast(base), "part").withColumn("doc", F.col("base") + at).drop("part", "base")


def _values(documents: DataFrame, name: str) -> Column:
    """A text column's values: none for null and for an empty text alone."""
    if name not in documents.columns:
        return F.array().cast("array<string>")
    if isinstance(documents.schema[name].dataType, T.ArrayType):
        return F.coalesce(F.col(name).cast("array<string>"), F.array().cast("array<string>"))
    return F.when(F.coalesce(F.col(name).cast("string"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(F.col(name).cast("string")))


def prepared(documents: DataFrame) -> DataFrame:
    """Documents with all columns that the index knows, texts as arrays; numbers is an array of house numbers in their order. Other columns are left out."""
    have = lambda name, kind: (F.col(name) if name in documents.columns else F.lit(None)).cast(kind).alias(name)
    if "housenumbers" in documents.columns:
        entry = lambda e: F.struct(e["key"].alias("number"), e["value"]["id"].alias("id"), e["value"]["banId"].alias("ban_id"), *(e["value"][c].alias(c) for c in ("x", "y", "lat", "lon")))
        numbers = F.coalesce(F.transform(F.map_entries("housenumbers"), entry).cast(f"array<{NUMBER}>"), F.array().cast(f"array<{NUMBER}>"))
    else:
        numbers = F.array().cast(f"array<{NUMBER}>")
    known = numbered(documents)
    out = known.select(F.col("doc").cast("long").alias("doc"), have("id", "string"), have("ban_id", "string"), F.coalesce(have("kind", "string"), F.lit("")).alias("kind"), *(_values(documents, f).alias(f) for f in FIELDS), *(have(c, "double") for c in _NUMBERS), numbers.alias("numbers"))
    return out.withColumn("importance", F.coalesce("importance", F.lit(0.0)))


def _spoken(rows: DataFrame, of: str, made: Column, name: str) -> DataFrame:
    """rows with what is made of the values of a column, once of each: written, or the planner makes it of every row to leave out empty ones, and sends rows to all machines by the size of their files."""
    once = written(rows.select(of).distinct().select(of, made.alias(name)), "spoken")
    return rows.join(F.broadcast(once), of) if once.count() <= FEW_DOCS else rows.join(once.hint("merge"), of)


def postings(docs: DataFrame, synonyms: dict | None = None) -> DataFrame:
    """token, doc, score of prepared documents with a name: of all values a document has the word in, the best score. Each distinct value is taken apart once."""
    boosts = {f: F.lit(FIELD_BOOST) for f in FIELDS} | {"name": F.lit(NAME_BOOST), "postcode": F.when(F.col("kind") == "municipality", MUNICIPALITY_POSTCODE_BOOST).otherwise(FIELD_BOOST)}
    each = docs.filter(F.size("name") > 0).select("doc", "importance", F.explode(F.array(*(F.struct(F.col(f).alias("values"), boosts[f].alias("boost")) for f in FIELDS))).alias("f")).select("doc", "importance", "f.boost", F.explode("f.values").alias("value"))
    scored = _spoken(each, "value", french.index_tokens(F.col("value"), synonyms), "words").select("doc", F.explode("words").alias("token"), ((F.lit(1.0) / F.size("words")) * (F.col("boost") + F.col("importance") * IMPORTANCE_WEIGHT)).alias("score"))
    return scored.groupBy("token", "doc").agg(F.max("score").alias("score")).filter("score > 0")


def token_stats(posted: DataFrame) -> DataFrame:
    return posted.groupBy("token").agg(F.count("*").alias("df"), F.max("score").alias("max_score"))


def pairs(posted: DataFrame) -> DataFrame:
    """token, other: words that some document has both of. A document's words meet within its own row."""
    listed = posted.groupBy("doc").agg(F.collect_set("token").alias("words"))
    return listed.select(F.explode("words").alias("token"), "words").select("token", F.explode("words").alias("other")).filter("token <> other").distinct()


def edge_ngrams(tokens: DataFrame) -> DataFrame:
    """ngram, token: beginnings of 3 to 20 characters that are shorter than the word."""
    n = F.char_length("token")
    lengths = F.sequence(F.lit(NGRAM_LEAST), F.greatest(F.least(n - 1, F.lit(NGRAM_MOST)), F.lit(NGRAM_LEAST)))
    return tokens.select("token").distinct().filter(n > NGRAM_LEAST).select(F.explode(F.transform(lengths, lambda i: F.left("token", i))).alias("ngram"), "token")


def types() -> Column:
    """The values of the type filter that a prepared document answers to."""
    return F.filter(F.array(F.col("kind"), F.when(F.size("numbers") > 0, "housenumber")), lambda x: x.isNotNull())


def named_values(name: str, values: Column) -> Column:
    """(name, value) of each value of a filter."""
    return F.transform(values, lambda v: F.struct(F.lit(name).alias("name"), v.alias("value")))


def filters(docs: DataFrame) -> DataFrame:
    """name, value, doc of prepared documents with a name."""
    each = F.concat(*(named_values(n, v) for n, v in (("type", types()), ("citycode", F.col("citycode")), ("postcode", F.col("postcode")))))
    return docs.filter(F.size("name") > 0).select("doc", F.explode(each).alias("f")).select("f.name", "f.value", "doc").distinct()


def housenumbers(docs: DataFrame, synonyms: dict | None = None) -> DataFrame:
    """doc, token, number, id, ban_id, x, y, lat, lon, cell: of a document's numbers with one token the last."""
    each = docs.select("doc", F.posexplode("numbers").alias("at", "n")).select("doc", "at", "n.*")
    last = _spoken(each, "number", french.housenumber_token(F.col("number"), synonyms), "token").groupBy("doc", "token").agg(F.max_by(F.struct("number", "id", "ban_id", "x", "y", "lat", "lon"), "at").alias("n"))
    return last.select("doc", "token", "n.*").withColumn("cell", geo.cell(F.col("lat"), F.col("lon")))


def cells(docs: DataFrame, numbers: DataFrame) -> DataFrame:
    """cell, doc: a document's own cell, if it has a name, and those of its house numbers."""
    own = docs.filter(F.size("name") > 0).select(geo.cell(F.col("lat"), F.col("lon")).alias("cell"), "doc")
    return own.union(numbers.select("cell", "doc")).filter("cell is not null").distinct()


def _looked_up(docs: DataFrame, posted: DataFrame, where: DataFrame) -> DataFrame:
    """The table that searches look documents up in: what they hold, and what they may be called."""
    words = posted.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("token", "score"))).alias("words"))
    near = where.groupBy("doc").agg(F.collect_set("cell").alias("near"))
    empty = lambda name, kind: F.coalesce(F.col(name), F.array().cast(kind)).alias(name)
    named = F.when(F.size("name") > 0, F.col("name")).otherwise(F.array(F.lit("")))
    first = F.get("postcode", F.lit(0))
    called = french.labels(named, first, F.col("city"), F.lit(None).cast("string"), F.col("kind"))
    street = french.labels(named, first, F.col("city"), F.lit(None).cast("string"), F.lit("housenumber"))
    # rows are put in order before their labels are made, or the ordering makes all labels twice
    held = docs.join(words.hint("merge"), "doc", "left").join(near.hint("merge"), "doc", "left").repartitionByRange("doc").sortWithinPartitions("doc")
    joined = held.withColumn("types", types()).withColumn("label", F.get(called, F.lit(0))).withColumn("folded", F.transform(called, text.fold)).withColumn("folded_street", F.when(F.col("kind") == "municipality", F.transform(street, text.fold)).otherwise(F.col("folded"))).withColumn("grams", F.transform("folded", text.gram_codes))
    joined = joined.withColumn("grams_street", F.when(F.col("kind") == "municipality", F.transform("folded_street", text.gram_codes)).otherwise(F.col("grams")))
    return joined.select(*(c for c in joined.columns if c not in ("numbers", "words", "near")), F.coalesce("words", F.create_map().cast("map<string,double>")).alias("words"), empty("near", "array<long>"))


def build(documents: DataFrame, path: str | None = None, synonyms: dict | None = None) -> Index:
    """Writes the index of documents to path, a folder that appears only when it is whole, and opens it. synonyms: those of addresses unless others are given.

    Documents without a name are kept but not indexed by words; an empty table makes an empty index. A document of an id that another has is one of its own.
    """
    spark, synonyms = documents.sparkSession, S.table() if synonyms is None else synonyms
    path = path or new_folder(spark, "index")
    part = f"{path}.partial"

    def kept(name: str, df: DataFrame, *order: str) -> DataFrame:
        sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        sorted_.write.mode("overwrite").option("compression", "zstd").parquet(f"{part}/{name}")
        return spark.read.schema(df.schema).parquet(f"{part}/{name}")

    docs = written(prepared(documents), "prepared")
    posted = kept("postings", postings(docs, synonyms), "token", "doc")
    tokens = kept("tokens", token_stats(posted), "token")
    kept("pairs", pairs(posted), "token", "other")
    kept("edge_ngrams", edge_ngrams(tokens), "ngram", "token")
    kept("filters", filters(docs), "name", "value", "doc")
    numbers = kept("housenumbers", housenumbers(docs, synonyms), "doc", "token")
    where = kept("cells", cells(docs, numbers), "cell", "doc")
    kept("documents", _looked_up(docs, posted, where))
    spark.createDataFrame([(FORMAT, json.dumps(synonyms))], "format int, synonyms string").coalesce(1).write.mode("overwrite").parquet(f"{part}/meta")
    renamed(spark, part, path)
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    """The index in a folder. A folder without one, of another format, or that lacks a table is an error."""
    if missing := [t for t in ("meta", *TABLES) if not exists(spark, f"{path}/{t}")]:
        raise ValueError(f"no index in {path}: {', '.join(missing)} missing")
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta is None or meta.format != FORMAT:
        raise ValueError(f"the index in {path} has another format than {FORMAT}")
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in TABLES), json.loads(meta.synonyms))
