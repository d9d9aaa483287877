"""The stored index and the search of addresses on small gazetteers: what each rule finds."""

import pytest
from pyspark.sql import functions as F

from waymark.operators import batch, fallback, index, postings, reverse, search
from waymark.sources import gazetteer

NUMBERS = "map<string,struct<id:string,banId:string,x:double,y:double,lon:double,lat:double>>"
SHAPE = f"id string, kind string, name string, postcode array<string>, citycode array<string>, city array<string>, importance double, lat double, lon double, housenumbers {NUMBERS}, label string"


def place(id_, kind, name, postcode=None, city=None, importance=0.5, lat=48.8, lon=2.3, numbers=(), citycode=None):
    held = {n: (f"{id_}_{n}", None, 0.0, 0.0, lon + 0.0001 * (i + 1), lat + 0.0001 * (i + 1)) for i, n in enumerate(numbers)}
    listed = lambda v: None if v is None else [v] if isinstance(v, str) else list(v)
    return (id_, kind, name, listed(postcode), listed(citycode or id_.split("_")[0]), listed(city), importance, lat, lon, held or None, "a column of its own")


def made(spark, rows, path=None):
    return index.build(spark.createDataFrame(rows, SHAPE), path)


def asked(spark, rows, shape="qid int, query string"):
    return spark.createDataFrame(rows, shape)


def ids(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append(r.id)
    return out


@pytest.fixture(scope="module")
def towns(spark, tmp_path_factory):
    """Two streets of one name in two towns, the first with numbers."""
    rows = [place("75101_0001", "street", "Rue Lima", "75001", "Paris", lat=48.86, lon=2.34, numbers=("4", "5bis", "50bis", "50B")), place("69381_0001", "street", "Rue Lima", "69001", "Lyon", lat=45.76, lon=4.83)]
    path = f"{tmp_path_factory.mktemp('towns')}/index"
    made(spark, rows, path)
    return index.opened(spark, path)


def test_index(spark, towns, tmp_path):
    words = {(r.token, r.doc): r.score for r in towns.postings.collect()}
    assert words["lima", 1] == (1.0 / 2) * (4.0 + 0.05) and words["75001", 1] == 1.0 * (1.0 + 0.05) and ("pari", 1) in words
    assert {(r.token, r.number, r.id) for r in towns.housenumbers.collect()} == {("katr", "4", "75101_0001_4"), ("5b", "5bis", "75101_0001_5bis"), ("50b", "50B", "75101_0001_50B")}
    assert {(r.name, r.value) for r in towns.filters.filter("doc = 1").collect()} == {("type", "street"), ("type", "housenumber"), ("citycode", "75101"), ("postcode", "75001")}
    assert {(r.token, r.other) for r in towns.pairs.collect()} >= {("lima", "lion"), ("pari", "ru")} and ("lion", "pari") not in {tuple(r) for r in towns.pairs.collect()}
    assert {r.ngram for r in towns.edge_ngrams.collect()} >= {"lim", "par", "750", "7500"}
    with pytest.raises(ValueError, match="no index"):
        index.opened(spark, f"{tmp_path}/none")
    none = index.build(spark.createDataFrame([], SHAPE), f"{tmp_path}/empty")
    assert search.search(asked(spark, [(1, "rue lima"), (2, None)]), none).count() == 0
    nameless = made(spark, [place("1_1", "street", None, "75001", "Paris", numbers=("4",))])
    assert nameless.documents.count() == 1 and nameless.postings.count() == 0 and nameless.filters.count() == 0 and nameless.cells.count() == 1
    with pytest.raises(ValueError, match="missing"):
        nameless.spark.read.parquet(f"{tmp_path}/empty/meta").write.parquet(f"{tmp_path}/part/meta")
        index.opened(spark, f"{tmp_path}/part")


def test_boosts(spark):
    """A municipality's postcode counts more; of several fields with a word the best counts; repeated words count in a field's length."""
    ix = made(spark, [place("01002", "municipality", "Oslo Oslo Bains", ["01640", "01641"], "Oslo", 0.2)])
    words = {r.token: r.score for r in ix.postings.collect()}
    assert words["01640"] == 1.0 * (1.2 + 0.2 * 0.1) and words["oslo"] == (1.0 / 3) * (4.0 + 0.2 * 0.1) and words["01002"] == 1.0 * (1.0 + 0.2 * 0.1)
    assert [r.label for r in search.search(asked(spark, [(1, "oslo")]), ix).collect()] == ["Oslo Oslo Bains 01640 Oslo"]


def test_searches(spark, towns):
    rows = [
        (1, "rue lima", None, None, None), (2, "rue lima", None, None, ["69001"]), (3, "rue lima", None, ["75101"], None), (4, "rue lima", None, None, ["69001", "75001"]), (5, "rue lima", None, ["75101"], ["69001"]), (6, "rue lima", None, None, ["13001"]),
        (7, "rue lima", None, None, [" 69001 ", ""]), (8, "4 rue lima", None, ["75101"], None), (9, "4 rue lima", ["street"], ["75101"], None), (10, "4 rue lima", ["housenumber"], None, None), (11, "9 rue lima", ["housenumber"], None, None), (12, "9 rue lima", ["housenumber", "street"], None, None),
        (13, "4 rue lima", [" "], ["75101"], None), (14, "rue limma lyon", None, None, None), (15, "lima lyon paris", None, None, None), (16, "zzz", None, None, None), (17, "", None, None, None), (18, None, None, None, None), (19, "x" * 201, None, None, None), (20, "50 bis rue lima paris", None, None, None),
        (21, "rue lima 75001 paris nowhere", None, None, None), (22, "4", None, None, None), (23, "(rue) l'ima", None, None, None),
    ]
    found = search.search(asked(spark, rows, "qid int, query string, types array<string>, citycodes array<string>, postcodes array<string>").withColumn("limit", F.lit(3)), towns).cache()
    got = ids(found)
    lyon, paris, four = "69381_0001", "75101_0001", "75101_0001_4"
    assert got[1] == [lyon, paris] and got[2] == [lyon] and got[3] == [paris] and sorted(got[4]) == [lyon, paris] and 5 not in got and 6 not in got and got[7] == [lyon]
    assert got[8] == [four] and got[9] == [paris] and got[10] == [four] and 11 not in got and len(got[12]) == 2 and got[13] == [paris]
    assert got[14] == [lyon] and got[15] == [paris, lyon] and not {16, 17, 18, 19, 22} & set(got)
    assert got[20] == ["75101_0001_50B"] and got[21] == [paris]
    by = {(r.qid, r["rank"]): r for r in found.collect()}
    assert by[8, 1].label == "4 Rue Lima 75001 Paris" and by[8, 1].kind == "housenumber" and by[8, 1].doc_kind == "street" and by[8, 1].housenumber == "4" and by[8, 1].lat == pytest.approx(48.8601)
    assert by[1, 1].str_distance == 1.0 and by[1, 1].score == (0.05 + 1.0) / 1.1 and by[1, 1].distance_m is None
    # the label that is compared: 4 rue lima paris holds the whole query
    assert by[8, 1].str_distance == 1.0


def test_around_a_position(spark, towns):
    rows = [(1, "rue lima", 45.7601, 4.8301), (2, "4", 48.8601, 2.3401), (3, "4", 43.3, 5.4), (4, "4", 48.8601, 0.0), (5, "rue lima", 0.0, 2.3), (6, "rue lima", None, 2.3)]
    found = search.search(asked(spark, rows, "qid int, query string, lat double, lon double"), towns).cache()
    got, by = ids(found), {(r.qid, r["rank"]): r for r in found.collect()}
    assert got[1] == ["69381_0001", "75101_0001"] and got[2] == ["75101_0001_4"] and 3 not in got and 4 not in got
    assert by[2, 1].distance_m == pytest.approx(0, abs=1e-6) and by[1, 2].distance_m > 390_000
    assert by[1, 2].score == pytest.approx((0.05 + 1.0 + 0.0) / 1.2) and by[5, 1].distance_m > 1e6 and by[6, 1].distance_m is None
    assert by[1, 1].score == pytest.approx((0.05 + 1.0 + 0.1) / 1.2, abs=1e-6)


def test_autocomplete(spark, towns):
    rows = [(1, "rue lima lyo", True), (2, "rue lima lyo", False), (3, "rue lima lyon", True), (4, "lima lyon", True), (5, "li", True), (6, "lim", True)]
    found = search.search(asked(spark, rows, "qid int, query string, autocomplete boolean"), towns).cache()
    by = {(r.qid, r.id): r.str_distance for r in found.collect()}
    lyon, paris = "69381_0001", "75101_0001"
    assert by[1, lyon] == 0.9 and by[3, lyon] == 1.0 and by[4, lyon] == 0.7
    assert by[1, paris] == pytest.approx(by[2, paris] * 0.9)
    assert 5 not in ids(found) and sorted(ids(found)[6]) == [lyon, paris]


@pytest.fixture(scope="module")
def crowd(spark):
    """A hundred and two equal streets, and four names that share words in a ring."""
    rows = [place(str(i), "street", "Lima") for i in range(100, 202)] + [place(str(i), "street", n) for i, n in enumerate(("Tango Oslo", "Oslo Rome", "Rome Kiev", "Kiev Tango"), 300)]
    return made(spark, rows)


def test_ties_and_relations(spark, crowd):
    got = ids(search.search(asked(spark, [(1, "lima"), (2, "tango oslo rome kiev"), (3, "tango oslo paris"), (4, "tanggo kiev")]).withColumn("limit", F.lit(3)), crowd))
    assert got[1] == ["100", "101", "102"]
    assert set(got[2]) <= {"300", "301", "302", "303"} and len(got[2]) == 3 and got[3] == ["300"] and got[4] == ["303"]
    words = asked(spark, [(1, ["lima"]), (2, ["lima", "oslo"]), (3, ["oslo", "rom"]), (4, ["nothing"])], "qid int, tokens array<string>")
    tied = postings.with_ties(postings.keys(words, crowd), crowd, 100).collect()
    assert sum(r.kept for r in tied if r.qid == 1) == 100 and sum(r.tied for r in tied if r.qid == 1) == 102
    assert [(r.qid, r.doc, r.tied) for r in tied if r.qid != 1] == [(3, 103, False)]
    assert postings.intersect(postings.keys(words, crowd), crowd, 0).count() == 0
    assert [r.doc for r in postings.scanned(postings.keys(words, crowd), crowd, 2, 50).filter("qid = 1").orderBy("rank").collect()] == [0, 1]


def test_relation_groups(spark, crowd):
    """Words join the group of whichever neighbour comes first; groups within others go."""
    own = search._Search(crowd, search.Settings())
    state = own.analysed(asked(spark, [(1, "tango oslo rome kiev")]))
    words = {r.token: r.df for r in crowd.tokens.collect()}
    assert {w: words[w] for w in ("tango", "oslo", "rom", "kiev")} == {"tango": 2, "oslo": 2, "rom": 2, "kiev": 2}
    links = [(0, 2), (0, 3), (1, 2), (1, 3)]  # kiev, oslo, rom, tango by bytes
    row = state.select(F.array_sort(F.transform("words", lambda w: F.struct(w["value"].alias("value"), w["df"].alias("df")))).alias("set"), F.array(*(F.lit(i * 1000 + j) for a, b in links for i, j in ((a, b), (b, a)))).alias("links"))
    groups = row.select(search._groups(10_000).alias("g")).first().g
    assert [[w.value for w in g] for g in groups] == [["kiev", "rom"], ["oslo", "rom"], ["kiev", "tango"]]
    assert row.select(search._groups(1).alias("g")).first().g == []  # all are common


def test_common_words(spark, crowd):
    """With low limits: common words alone, scanned or intersected, and those that narrow a full bucket."""
    rows = [place(str(i), "street", n, "75001", c) for i, (n, c) in enumerate([("Rue Basse", "Oslo")] * 6 + [("Rue Haute", "Oslo")] * 6 + [("Rue Haute", "Rome")] * 5 + [("Rue Verte", "Kiev")], 100)]
    ix = made(spark, rows)
    q = asked(spark, [(1, "rue"), (2, "rue haute"), (3, "verte rue"), (4, "haute oslo"), (5, "rue hau")]).withColumn("autocomplete", F.col("qid") == 5).withColumn("limit", F.lit(3))
    low = search.Settings(least=2, most=4, common=4, widest=1000)
    got = ids(search.search(q, ix, low))
    assert got[1] == ["100", "101", "102"] and got[2] == ["106", "107", "108"] and got[3] == ["117"] and got[4] == ["106", "107", "108"] and len(got[5]) == 3
    scans = search.Settings(least=2, most=4, common=4, widest=5, scan=8)
    got = ids(search.search(q.filter("qid in (1, 2, 4)"), ix, scans))
    assert got[1] == ["100", "101", "102"] and got[4] == ["106", "107", "108"]
    kept = asked(spark, [(1, "rue haute", ["13001"]), (2, "rue haute", ["75001"])], "qid int, query string, postcodes array<string>")
    assert list(ids(search.search(kept, ix, scans))) == [2]


def test_reduced_words(spark, towns):
    """A word too many goes, then two; numbers first."""
    got = ids(search.search(asked(spark, [(1, "rue lima lyon 75001"), (2, "lima lima paris 69001 lyon 75001")]), towns))
    assert set(got[1]) == {"69381_0001", "75101_0001"} and got[2]


def test_reverse(spark, towns):
    rows = [(1, 48.8601, 2.3401, None), (2, 48.86, 2.34, None), (3, 48.8601, 2.3401, ["street"]), (4, 0.0, 0.0, None), (5, 45.7602, 4.8302, ["housenumber"]), (6, 90.0, 1.0, None), (7, None, 1.0, None), (8, float("nan"), 1.0, None), (9, 48.8601, 2.3401, ["housenumber"])]
    spots = asked(spark, rows, "qid int, lat double, lon double, types array<string>")
    found = reverse.presented(reverse.reverse(spots, towns), towns).collect()
    by = {r.qid: r for r in found}
    assert {q: r.id for q, r in by.items()} == {1: "75101_0001_4", 2: "75101_0001", 3: "75101_0001", 9: "75101_0001_4"}
    assert by[1].label == "4 Rue Lima 75001 Paris" and by[1].distance_m == pytest.approx(0, abs=1e-6) and by[3].label == "Rue Lima 75001 Paris" and by[1].score == 1.0
    far = asked(spark, [(1, 48.875, 2.34), (2, 48.95, 2.34), (3, 48.86, 2.3655)], "qid int, lat double, lon double")
    assert {r.qid for r in reverse.nearest(far, towns, 2000.0).collect()} == {1, 3} and {r.qid for r in reverse.reverse(far, towns).collect()} == set()
    assert {r.qid: r.doc for r in reverse.nearest(far, towns, 10_000.0, 2).collect()} == {1: 1, 2: 1, 3: 1}
    for wrong in ((False, 5.0), (True, 0.0), (True, 10_001.0)):
        with pytest.raises(ValueError):
            reverse.nearest_radius(*wrong)
    assert reverse.nearest_radius(True) == 5000.0 and reverse.nearest_radius(False) is None


def test_nearest_at_the_edges(spark):
    """Across the meridian of 180 degrees, and over the pole."""
    ix = made(spark, [place("1_1", "street", "East", lat=10.0, lon=179.9999), place("2_1", "street", "West", lat=10.2, lon=-179.9999), place("3_1", "street", "North", lat=89.99, lon=10.0), place("4_1", "street", "South", lat=-89.995, lon=0.0)])
    spots = asked(spark, [(1, 10.0, -179.9999), (2, 10.2, 179.9999), (3, 89.99, -170.0), (4, -89.995, 120.0), (5, 10.1, 0.0), (6, 10.0, 179.99)], "qid int, lat double, lon double")
    assert ids(reverse.presented(reverse.nearest(spots, ix), ix)) == {1: ["1_1"], 2: ["2_1"], 3: ["3_1"], 4: ["4_1"], 6: ["1_1"]}
    assert ids(reverse.presented(reverse.reverse(spots.filter("qid in (1, 2)"), ix), ix)) == {1: ["1_1"], 2: ["2_1"]}


@pytest.fixture(scope="module")
def perpignan(spark):
    streets = [place("66136_0001", "street", "Rue Clement Marot", "66000", "Perpignan", numbers=("4", "12bis"), lat=42.69, lon=2.89), place("66136_0002", "street", "Rue Clement Marot Prolongee", "66100", "Perpignan", lat=42.69, lon=2.89)]
    return made(spark, [place("66136", "municipality", "Perpignan", ["66000", "66100"], "Perpignan", 0.6), *streets, place("67028", "municipality", "Benfeld", "67230", "Benfeld", 0.5), place("67028_0001", "street", "Rue du Moulin", "67230", "Benfeld")])


def test_fallbacks(spark, perpignan):
    q = asked(spark, [(1, "4 rue clement marot 66100 perpignan"), (2, "4 rue du moulin 67230 benfeld"), (3, "4 bis rue clement marot perpignan"), (4, "rue clement marot"), (5, "5 bis rue clement marot perpignan"), (6, "4 rue clement marot 66000 perpignan")])
    plain = {r.qid: r for r in batch.geocode(q, perpignan).collect()}
    rescued = {r.qid: r for r in batch.geocode(q, perpignan, postcode_fallback=True, plain_number=True).collect()}
    assert plain[1].housenumber != "4" and rescued[1].id == "66136_0001_4" and rescued[1].label == "4 Rue Clement Marot 66000 Perpignan"
    assert rescued[2].id == plain[2].id and plain[3].housenumber is None and rescued[3].housenumber == "4" and rescued[3].score == plain[3].score and rescued[3].kind == "housenumber"
    assert rescued[5].housenumber is None and rescued[6].id == plain[6].id == "66136_0001_4"
    assert fallback.plain_number(q.withColumn("types", F.array(F.lit("street"))), search.search(q, perpignan), perpignan, None).filter("housenumber is not null and qid = 3").count() == 0
    codes = spark.createDataFrame([("75101",), ("75120",), ("75121",), ("13216",), ("69389",), ("2A004",), (None,)], "c string").select(fallback.city_of(F.col("c")).alias("c")).collect()
    assert [r.c for r in codes] == ["75056", "75056", "75121", "13055", "69123", "2A004", None]


def test_numbering(spark):
    rows = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9), ("d", None), ("é", 0.5), ("B", 0.5)], "id string, importance double").repartition(4)
    assert [r.id for r in index.numbered(rows).orderBy("doc").collect()] == ["c", "B", "a", "b", "é", "d"]


def test_read_ndjson(spark, tmp_path):
    import gzip

    good = ['{"id":"1","type":"street","name":"Rue X","postcode":["75001","75002"],"city":"","lon":2.5,"lat":48,"importance":0.3,"housenumbers":{"22":{"id":"1_22","banId":null,"x":1,"y":2.5,"lon":2,"lat":48},"16":{"id":"1_16","banId":"u","x":1,"y":2,"lon":2,"lat":48}}}', "", '{"id":"2","type":"municipality","name":"Y","lon":1,"lat":1}']
    with gzip.open(f"{tmp_path}/a.ndjson.gz", "wt") as f:
        f.write("\n".join(good))
    rows = gazetteer.read_ndjson(spark, f"{tmp_path}/a.ndjson.gz").orderBy("id").collect()
    assert rows[0].postcode == ["75001", "75002"] and rows[0].city == [] and rows[0].lat == 48.0 and list(rows[0].housenumbers) == ["22", "16"] and rows[1].housenumbers is None and rows[1].importance is None
    assert made(spark, [place("1", "street", "x")]).documents.count() == 1
    bad = ['{"id":"1","type":"street","name":"x","new":1,"lon":1,"lat":1}', '{"id":"1","name":"x","lat":1}', '{"id":"1","name":"x","lon":null,"lat":1}', "no json", '{"id":"1","lon":1,"lat":1,"housenumbers":{"1":{"id":"a","lon":1,"lat":1,"z":2}}}', '{"id":"1","lon":1,"lat":1,"x":18446744073709551615}', '{"id":"1","lon":"east","lat":1}']
    for i, line in enumerate(bad):
        with open(f"{tmp_path}/bad{i}.ndjson", "w") as f:
            f.write(line)
        with pytest.raises(Exception, match="not a document"):
            gazetteer.read_ndjson(spark, f"{tmp_path}/bad{i}.ndjson").collect()
    ix = index.build(gazetteer.read_ndjson(spark, f"{tmp_path}/a.ndjson.gz"))
    assert ids(search.search(asked(spark, [(1, "22 rue x 75002")]), ix)) == {1: ["1_22"]}
