"""French text against golden values."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import french, synonyms

# What texts must become.
SYNONYMS = french.read_synonyms(["# numbers", "1 => un", "2 => deux", "3 => trois", "5 => cinq", "12 => douze", "13 => treize", "14 => quatorze", "st, saint => saint", "17e, xviie => dix septieme"])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


INDEX = [
    ("Montee de la Foret", "monte de la foret"),
    ("L'Abergement-de-Varey", "l aberjemen de varei"),
    ("Œuvre Ærø Straße", "euvr ero stras"),
    ("½ chemin", "1/2 chemin"),
    ("Bonn½uvre", "bon 1/2uvr"),
    ("Rue du Général de Gaulle", "ru du jeneral de gaul"),
    ("Vingt seigneur Georges Pforzheim boeufs chateaux", "vin senieur jorj pforzaim beu chateau"),
    ("Champvallon Montbon impossible", "chanvalon monbon inposibl"),
    ("Allée des 3 Fontaines", "ale de troi fontain"),
    ("St Michel", "sain michel"),
    ("ª ²", "a deu"),
    ("75002", "75002"),
    ("10 ter avenue", "10t avenu"),
    ("4 bis", "4b"),
    ("1 a 3 rue", "un a troi ru"),
    ("12345 b rue", "12345 b ru"),
    ("12 14 rue", "katorz ru"),
    ("17e", "dix septiem"),
    ("", ""),
    (None, ""),
]


def test_index_tokens(spark):
    rows = spark.createDataFrame(list(enumerate(t for t, _ in INDEX)), "i int, t string").select("i", french.index_tokens(F.col("t"), SYNONYMS).alias("x")).collect()
    assert {r.i: " ".join(r.x) for r in rows} == {i: w for i, (_, w) in enumerate(INDEX)}


QUERY = [
    ("6bis place carnot", "6b plas karno", "6b"),
    ("8 bis rue de la paix 75002 paris", "8b ru de la paix 75002 pari", "8b"),
    ("7 b chemin des vignes", "7b chemin de vign", "7b"),
    ("rue haute 12", "ru aut douz", None),
    ("Ets Dupont batiment B 22 rue des Fleurs 59350 Lille Cedex 23", "22 ru de fleur 59 lil", "22"),
    ("residence les pins 13 allee b 33000 bordeaux", "trez ale b 33000 bordeau", "trez"),
    ("BP 123 75001 Paris Cedex 01", "75 pari", "75"),
    ("CS 70001 33000 Bordeaux", "33000 bordeau", None),
    ("3ème étage 5 rue de la gare 69001 lyon", "sink ru de la gar 69001 lion", "sink"),
    ("lieu dit les granges 12345 village", "le granj 12345 vilaj", None),
    ("route de st jean s/ mer 06230", "rout de sain jan sur mer 06230", None),
    ("0003 avenue foch 75016 paris", "troi avenu fok 75016 pari", "troi"),
]


def test_query_tokens(spark):
    rows = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(QUERY)], "i int, q string").select("i", french.query_tokens(F.col("q"), SYNONYMS).alias("x")).orderBy("i").collect()
    for (q, words, number), r in zip(QUERY, rows):
        assert " ".join(t.value for t in r.x) == words, q
        assert next((t.value for t in r.x if t.housenumber), None) == number, q
    assert one(spark, french.query_tokens(F.lit("x" * 201))) is None


def test_street_types(spark):
    rows = spark.createDataFrame([(w,) for w in ["rue", "RUE", "av", "allees", "cite", "paris", "saint", "rues", ""]], "w string").select(french.is_street_type(F.col("w")).alias("x")).collect()
    assert [r.x for r in rows] == [True] * 5 + [False] * 4


def test_misspellings(spark):
    paix = one(spark, french.misspellings(F.lit("paix")))
    assert len(paix) == 150
    assert paix[:12] == ["apix", "piax", "paxi", "oaix", "aaix", "laix", "maix", "peix", "pzix", "pqix", "poix", "ppix"]
    assert paix[144:] == ["paizx", "paixz", "aix", "pix", "pax", "pai"]
    ru = one(spark, french.misspellings(F.lit("ru")))
    assert len(ru) == 86 and ru[:10] == ["ur", "eu", "du", "fu", "tu", "ry", "re", "rh", "rj", "ri"]
    assert len(one(spark, french.misspellings(F.lit("")))) == 26


def _labels(spark, names, postcode, cities, number, kind):
    arr = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return one(spark, french.labels(arr(names), F.lit(postcode).cast("string"), arr(cities), F.lit(number).cast("string"), F.lit(kind)))


def test_labels(spark):
    assert _labels(spark, ["Rue X"], "01640", ["Y"], "16", "housenumber") == ["16 Rue X 01640 Y", "Rue X 01640 Y", "16 Rue X 01640", "Rue X 01640", "16 Rue X Y", "Rue X Y", "16 Rue X", "Rue X"]
    assert _labels(spark, ["Paris"], "75001", ["Paris"], None, "municipality") == ["Paris", "75001 Paris", "Paris 75001"]
    assert _labels(spark, ["A", "B"], None, ["X", "Y"], None, "locality") == ["A X", "A", "A Y", "A", "B X", "B", "B Y", "B"]


def test_similarities(spark):
    assert one(spark, french.best_similarity(F.array(F.lit(0.5), F.lit(0.91), F.lit(1.0)))) == 0.91
    assert one(spark, french.best_similarity(F.array(F.lit(0.5), F.lit(0.8)))) == 0.8
    got = [one(spark, french.autocomplete_similarity(F.lit("rue lima 69001 lyon"), F.lit(q))) for q in ("rue lima 69001 lyon", "rue lima", "lima")]
    assert got == [1.0, 0.9, 0.7]


@pytest.mark.parametrize("line", ["a b", "a =>"])
def test_bad_synonyms(line):
    with pytest.raises(ValueError):
        french.read_synonyms([line])


def test_compensated_sum(spark):
    from waymark.functions import geo

    assert [one(spark, geo.compensated_sum(*map(F.lit, x))) for x in ((0.1, 1.0, 0.1), (0.1, 1.0), (0.0,))] == [1.2, 1.1, 0.0]


def test_synonym_table():
    table = synonyms.table()
    assert table["17e"] == table["xviieme"] == "dix septieme" and table["19e"] == "dix neuvieme" and table["5e"] == "cinquieme" and table["iv"] == table["4"] == "quatre" and table["1re"] == "premiere" and table["100"] == "cent"
    assert table["bd"] == "boulevard" and table["cr"] == "cour" and table["st"] == "saint" and "paris" not in table and "21" not in table
    assert [synonyms.roman(n) for n in (1, 4, 9, 14, 19, 20)] == ["i", "iv", "ix", "xiv", "xix", "xx"]


def test_search_sees_folded_queries(spark):
    """Punctuation is gone when search takes a query apart, and the limit counts folded characters; documents' texts keep theirs."""
    values = lambda c: one(spark, F.transform(c, lambda t: t["value"]))
    assert values(french.search_tokens(F.lit("½ chemin"), SYNONYMS)) == ["deu", "chemin"] and one(spark, french.index_tokens(F.lit("½ chemin"), SYNONYMS)) == ["1/2", "chemin"]
    assert values(french.search_tokens(F.lit("s/ mer"), SYNONYMS)) == ["s", "mer"] and values(french.query_tokens(F.lit("route s/ mer"), SYNONYMS)) == ["rout", "sur", "mer"]
    assert values(french.search_tokens(F.lit("n°5"), SYNONYMS)) == ["ndeg5"]
    assert one(spark, french.search_tokens(F.lit("x, " * 101))) is None and one(spark, french.search_tokens(F.lit("x" + "," * 300))) is not None
    assert one(spark, french.housenumber_token(F.lit("13"), SYNONYMS)) == "trez" and one(spark, french.housenumber_token(F.lit("1bis"), SYNONYMS)) == "1b" and one(spark, french.housenumber_token(F.lit(None).cast("string"))) == ""


def test_communes(spark):
    words = lambda t: F.array(*map(F.lit, t.split())).cast("array<string>")
    cases = [("rue de paris toulouse", "paris", False), ("rue de paris toulouse", "toulouse", True), ("grande rue paris 75001", "paris", True), ("av de l paris x", "paris", False), ("paris", "paris", True), ("st denis 93", "st denis", True), ("a b", "a b c", False)]
    for query, name, want in cases:
        assert one(spark, french.names(words(query), words(name))) is want, (query, name)
    assert one(spark, french.names(words("a"), F.array().cast("array<string>"))) is False
    assert one(spark, french.words(F.lit("Saint-Denis, Sainte Ève"))) == ["st", "denis", "ste", "eve"]
    got = [one(spark, french.without_postcode(F.lit(q))) for q in (" 4 rue  x 75001 paris", "75001", "rue x", "1234 75001a")]
    assert got == ["4 rue x paris", None, None, None]
    assert [one(spark, french.departement(F.lit(p))) for p in ("75001", "97400", "2")] == ["75", "974", "2"]
