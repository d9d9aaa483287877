"""The driver's queries of the search engine over a gazetteer made of the part table, each through its operator and the stored index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import french, geo, text
from ..functions import synonyms as S
from ..operators import batch, index, postings, reverse, search
from ..sources import gazetteer, geojson
from .sql import oracle_sql

__all__ = ["oracle_sql", "queries"]

_opened: dict[tuple[str, str], index.Index] = {}


def _read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _index(spark, sf_dir: str) -> index.Index:
    """The stored index of the parts, built once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _opened:
        _opened[key] = index.build(gazetteer.of_parts(_read(spark, sf_dir, "part")))
    return _opened[key]


def _asked(spark, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("qid"), F.concat_ws(" ", "p_name", "p_brand").alias("query"))


def _number() -> Column:
    """A house number that the part has; null if it has none."""
    n = F.col("p_size") % 7
    return F.when(n > 0, (1 + F.col("p_partkey") % F.greatest(n, F.lit(1))).cast("string"))


def _positions(spark, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return _read(spark, sf_dir, "events").select(key.alias("qid"), (42.0 + key * 37 % 900 / 100).alias("lat"), (-1.0 + key * 53 % 700 / 100 + 0.001).alias("lon"))


def _found(spark, sf_dir: str, asked: DataFrame) -> DataFrame:
    return search.search(asked, _index(spark, sf_dir)).select("qid", "rank", "doc", "label", F.round("score", 9).alias("score"))


def _filtered(spark, sf_dir: str) -> DataFrame:
    """Each query among documents of its part's own type and postcode."""
    part = _read(spark, sf_dir, "part").filter("p_partkey % 50 = 0")
    kind = F.when(F.col("p_size") % 10 == 0, "municipality").otherwise("street")
    asked = part.select(F.col("p_partkey").alias("qid"), F.concat_ws(" ", "p_name", "p_brand").alias("query"), F.array(kind).alias("types"), F.array(F.lit(" "), F.lpad((F.col("p_size") * 1000).cast("string"), 5, "0")).alias("postcodes"))
    return _found(spark, sf_dir, asked)


def _around(spark, sf_dir: str) -> DataFrame:
    """Each query around a position beside its part's."""
    key = F.col("p_partkey")
    part = _read(spark, sf_dir, "part").filter("p_partkey % 50 = 0")
    asked = part.select(key.alias("qid"), F.concat_ws(" ", "p_name", "p_brand").alias("query"), (42.0 + key * 37 % 900 / 100 + 0.2).alias("lat"), (-1.0 + key * 53 % 700 / 100).alias("lon"))
    return search.search(asked, _index(spark, sf_dir)).select("qid", "rank", "doc", F.round("score", 9).alias("score"), F.round("distance_m", 3).alias("distance_m"))


def _numbers(spark, sf_dir: str) -> DataFrame:
    """Queries with a house number before the name, which some of the documents have."""
    part = _read(spark, sf_dir, "part").filter("p_partkey % 50 = 0").filter(_number().isNotNull())
    asked = part.select(F.col("p_partkey").alias("qid"), F.concat_ws(" ", _number(), "p_name", "p_brand").alias("query"))
    return search.search(asked, _index(spark, sf_dir)).select("qid", "rank", "doc", "id", "kind", "housenumber", "label", F.round("score", 9).alias("score"))


def _vocabulary(spark, sf_dir: str) -> DataFrame:
    """word: those of the parts' names and types."""
    return _read(spark, sf_dir, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")).alias("word")).distinct()


def _fuzzy(spark, sf_dir: str) -> DataFrame:
    """Each word with a letter too many."""
    return _found(spark, sf_dir, _vocabulary(spark, sf_dir).select(F.col("word").alias("qid"), F.concat("word", F.lit("q")).alias("query")))


def _completed(spark, sf_dir: str) -> DataFrame:
    """The first three letters of each word, unless they are a word or sound shorter."""
    begun = _vocabulary(spark, sf_dir).select(F.left("word", F.lit(3)).alias("qid")).distinct()
    spoken = begun.withColumn("token", F.array_join(french.index_tokens(F.col("qid"), S.table()), " ")).filter(F.char_length("token") >= 3)
    asked = spoken.join(_index(spark, sf_dir).tokens, "token", "left_anti").select("qid", F.col("qid").alias("query"), F.lit(True).alias("autocomplete"))
    return _found(spark, sf_dir, asked)


def _relaxed(spark, sf_dir: str) -> DataFrame:
    """Two words that no name has both of."""
    words = _read(spark, sf_dir, "part").select(F.element_at(F.split("p_name", " "), -1).alias("b")).distinct()
    pairs = words.join(words.withColumnRenamed("b", "c"), F.col("b") < F.col("c"))  # some ten words
    return _found(spark, sf_dir, pairs.select(F.concat_ws(" ", "b", "c").alias("qid"), F.concat_ws(" ", "b", "c").alias("query")))


def _geocoded(spark, sf_dir: str) -> DataFrame:
    """Every part as a row of a table whose columns are a house number, the name and the brand."""
    table = _read(spark, sf_dir, "part").select("p_partkey", _number().alias("number"), "p_name", "p_brand")
    made = batch.geocode_table(table, _index(spark, sf_dir), ["number", "p_name", "p_brand"], min_score=0.3)
    return made.select("p_partkey", "result_id", "result_label", "result_score", "result_score_next", "result_type", "result_postcode", "result_housenumber", F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"))


def _plain(spark, sf_dir: str) -> DataFrame:
    """House numbers with a suffix that no document has."""
    table = _read(spark, sf_dir, "part").filter("p_partkey % 10 = 0").filter(_number().isNotNull()).select("p_partkey", F.concat(_number(), F.lit("b")).alias("number"), "p_name", "p_brand")
    made = batch.geocode_table(table, _index(spark, sf_dir), ["number", "p_name", "p_brand"], plain_number=True, result_columns=["result_num"])
    return made.select("p_partkey", "result_id", "result_label", "result_type", "result_housenumber", "result_num", "result_score")


def _fallback(spark, sf_dir: str) -> DataFrame:
    """Every part with another part's postcode, after its house number if it has one."""
    table = _read(spark, sf_dir, "part")
    wrong = F.lpad(((F.col("p_size") + 7) % 50 * 1000 + 1000).cast("string"), 5, "0")
    rows = table.select("p_partkey", F.concat_ws(" ", _number(), "p_name", wrong, "p_brand").alias("address"))
    return batch.geocode_table(rows, _index(spark, sf_dir), ["address"], postcode_fallback=True).select("p_partkey", "result_id", "result_score")


def _reversed(spark, sf_dir: str) -> DataFrame:
    spots = _positions(spark, sf_dir).select("qid", F.col("lat").cast("string").alias("lat"), "lon")
    return batch.reverse_table(spots, _index(spark, sf_dir)).select("qid", "result_id", "result_label", "result_housenumber", "result_type", "result_distance")


def _spots(spark, sf_dir: str, **radius) -> DataFrame:
    found = reverse.nearest(_positions(spark, sf_dir), _index(spark, sf_dir), **radius) if radius else reverse.reverse(_positions(spark, sf_dir), _index(spark, sf_dir))
    return found.select("qid", "doc", F.col("housenumber.number").alias("housenumber"), F.round("distance_m", 3).alias("distance_m"))


def _features(spark, sf_dir: str) -> DataFrame:
    made = geojson.features(search.search(_asked(spark, sf_dir), _index(spark, sf_dir))).select("qid", "rank", "feature.*")
    return made.select("qid", "rank", "type", F.col("geometry.type").alias("geometry"), F.round(F.element_at("geometry.coordinates", 1), 9).alias("lon"), F.round(F.element_at("geometry.coordinates", 2), 9).alias("lat"), "properties.id", "properties.label", "properties.street", "properties.municipality", "properties.postcode")


def _words_of(spark, sf_dir: str) -> DataFrame:
    """The asked queries as candidates of all their words."""
    ix = _index(spark, sf_dir)
    tokens = F.transform(french.search_tokens(F.col("query"), ix.synonyms), lambda t: t["value"])
    return postings.keys(_asked(spark, sf_dir).select("qid", tokens.alias("tokens")), ix)


def _completions(spark, sf_dir: str) -> DataFrame:
    spoken = lambda c: french.index_tokens(c, S.table())
    asked = _read(spark, sf_dir, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("qid"), F.split("p_name", " ").alias("w"))
    ends = asked.select("qid", F.left(F.element_at(spoken(F.element_at("w", -1)), 1), F.lit(3)).alias("last"), spoken(F.element_at("w", 1)).alias("others"), F.lit(False).alias("alone"))
    return postings.completions(ends, _index(spark, sf_dir)).filter("ord <= 10").select("qid", F.col("ord").alias("rank"), "token")


def _misspelt(spark, sf_dir: str) -> DataFrame:
    ix = _index(spark, sf_dir)
    words = ix.tokens.select("token").unionByName(ix.tokens.select(F.concat("token", F.lit("e")).alias("token")))
    return search.known_misspellings(words, ix).select("token", "other").distinct()


def _clean(spark, sf_dir: str) -> DataFrame:
    """Texts as queries, with post boxes and floors put before some of them."""
    box = F.when(F.col("p_partkey") % 3 == 0, "BP 123 ").when(F.col("p_partkey") % 3 == 1, "3ème étage ").otherwise("lieu dit ")
    return _read(spark, sf_dir, "part").select("p_partkey", french.clean_query(F.concat(box, F.col("p_name"), F.lit(" 75001 "), F.col("p_brand"), F.lit(" cedex 01"))).alias("cleaned"))


def _phonemes(spark, sf_dir: str) -> DataFrame:
    """The vocabulary of all texts, each word once, as it sounds."""
    words = _read(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", french.phonemes(F.col("word")).alias("phonemes"))


def _synonyms(spark, sf_dir: str) -> DataFrame:
    """Names with the size and an abbreviation, as they are indexed."""
    value = F.concat_ws(" ", F.lit("av"), F.col("p_size").cast("string"), "p_name", F.lit("st zi"))
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(french.index_tokens(value, S.table()), " ").alias("tokens"))


def _best_label(spark, sf_dir: str) -> DataFrame:
    """How near the best label of each document comes to its name and type."""
    asked = text.fold(F.concat_ws(" ", F.get("name", F.lit(0)), F.get("context", F.lit(0))))
    documents = _index(spark, sf_dir).documents.select("id", "folded", "grams", asked.alias("asked")).withColumn("codes", text.gram_codes(F.col("asked")))
    # one character has no bigrams
    alike = lambda x, g: F.when((F.char_length(x) < 2) | (F.char_length("asked") < 2), (x == F.col("asked")).cast("double")).otherwise(text.code_similarity(g, F.col("codes")))
    near = text.let(F.zip_with("folded", "grams", alike), french.best_similarity)
    return documents.select("id", F.round(near, 9).alias("similarity"))


def _sets(union: bool):
    def made(spark, sf_dir: str) -> DataFrame:
        """Of each brand the types that two sizes have both of, or either."""
        part = _read(spark, sf_dir, "part").groupBy("p_brand").agg(*(F.collect_set(F.when(F.col("p_size") % 2 == k, F.col("p_size"))).alias(f"s{k}") for k in (0, 1)), F.collect_set(F.when(F.col("p_size") < 25, F.col("p_size"))).alias("small"))
        both = postings.union_sets(F.col("s0"), F.col("small")) if union else postings.intersect_sets(F.col("s0"), F.col("small"))
        return part.select("p_brand", F.array_join(F.transform(both, lambda x: x.cast("string")), ",").alias("sizes"))

    return made


def _cells(around: int, *rings: int):
    def made(spark, sf_dir: str) -> DataFrame:
        spots = _positions(spark, sf_dir).filter(f"qid % {around} = 0") if around > 1 else _positions(spark, sf_dir)
        return spots.select("qid", F.explode(geo.ring(F.col("lat"), F.col("lon"), *rings)).alias("cell"))

    return made


def _ties(spark, sf_dir: str) -> DataFrame:
    """The words of each type alone: many documents have one score."""
    ix = _index(spark, sf_dir)
    words = ix.tokens.filter("df >= 5").select(F.col("token").alias("qid"), F.lit(0).alias("ord"), F.array(F.struct("df", "token")).alias("words"))
    return postings.with_ties(words, ix, 5).select("qid", F.col("doc").cast("long").alias("doc"), "rank", "kept", "tied")


def _scan(spark, sf_dir: str) -> DataFrame:
    """Of all documents with each query's words the five best by its rarest word."""
    made = postings.scanned(_words_of(spark, sf_dir), _index(spark, sf_dir), 5, None)
    return made.select("qid", "doc", "rank")


def _held_numbers(spark, sf_dir: str) -> DataFrame:
    """The house number that a written number meets in each document, if any."""
    ix = _index(spark, sf_dir)
    asked = ix.documents.select("doc", F.concat((F.col("doc") % 6 + 1).cast("string"), F.when(F.col("doc") % 5 == 0, " bis").otherwise("")).alias("asked"))
    spoken = asked.select("asked").distinct().select("asked", french.housenumber_token(F.col("asked"), ix.synonyms).alias("token"))
    met = asked.join(spoken, "asked").join(ix.housenumbers, ["doc", "token"], "left")
    return met.select("doc", "asked", "token", "number", "id")


def queries() -> dict:
    return {
        "text_fold": lambda s, d: _read(s, d, "documents").select("doc_id", text.fold(F.col("text")).alias("folded")),
        "text_tokens": lambda s, d: _read(s, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens")),
        "text_leading_zeros": lambda s, d: _read(s, d, "part").select("p_partkey", text.without_leading_zeros(F.concat_ws(" ", F.lpad(F.col("p_size").cast("string"), 4, "0"), "p_name")).alias("cleaned")),
        "text_clean": _clean,
        "text_phonemes": _phonemes,
        "text_synonyms": _synonyms,
        "housenumber_split": lambda s, d: _read(s, d, "part").select("p_partkey", text.split_housenumber(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, " bis").when(F.col("p_size") % 3 == 1, "B").otherwise(""))).alias("n")).select("p_partkey", "n.num", "n.complement", "n.short"),
        "bigram_similarity": lambda s, d: _read(s, d, "part").select("p_partkey", F.round(text.similarity(text.fold(F.col("p_name")), text.fold(F.concat_ws(" ", "p_name", "p_brand"))), 9).alias("similarity")),
        "labels": lambda s, d: _index(s, d).documents.select("id", F.posexplode(french.labels(F.col("name"), F.get("postcode", F.lit(0)), F.col("city"), F.lit(None).cast("string"), F.col("kind"))).alias("nth", "label")),
        "label_best": _best_label,
        "index_numbering": lambda s, d: _index(s, d).documents.select("id", "doc"),
        "index_postings": lambda s, d: _index(s, d).postings.select("token", "doc", F.round("score", 9).alias("score")),
        "index_token_stats": lambda s, d: _index(s, d).tokens.select("token", "df", F.round("max_score", 9).alias("max_score")),
        "index_pairs": lambda s, d: _index(s, d).pairs,
        "index_edge_ngrams": lambda s, d: _index(s, d).edge_ngrams,
        "index_filters": lambda s, d: _index(s, d).filters,
        "index_geocells": lambda s, d: _index(s, d).cells,
        "index_housenumbers": lambda s, d: _index(s, d).housenumbers.select("doc", "token", "number", "id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon")),
        "geo_expand": _cells(1, 0, 1),
        "geo_ring": _cells(20, 3),
        "set_intersect": _sets(False),
        "set_union": _sets(True),
        "postings_intersect_topk": lambda s, d: postings.intersect(_words_of(s, d), _index(s, d), 10).select("qid", "doc", "rank", F.round("sum", 9).alias("sum")),
        "postings_with_ties": _ties,
        "manual_scan": _scan,
        "filter_docs": lambda s, d: search.allowed(_index(s, d).filters, {"type": ["municipality", "housenumber"], "postcode": [f"{n:02d}000" for n in range(5, 20)]}),
        "housenumber_match": _held_numbers,
        "fuzzy_known": _misspelt,
        "autocomplete_words": _completions,
        "search_exact": lambda s, d: _found(s, d, _asked(s, d)),
        "search_filtered": _filtered,
        "search_around_point": _around,
        "search_housenumbers": _numbers,
        "search_fuzzy": _fuzzy,
        "search_autocomplete": _completed,
        "search_relaxed": _relaxed,
        "geocode_batch": _geocoded,
        "geocode_plain_number": _plain,
        "geocode_postcode_fallback": _fallback,
        "reverse": _spots,
        "reverse_nearest": lambda s, d: _spots(s, d, radius_m=5000.0),
        "reverse_batch": _reversed,
        "geojson_features": _features,
    }
