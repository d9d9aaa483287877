"""Tables, files, requests and streams through the geocoder."""

import json

import pytest
from pyspark.sql import functions as F

from waymark.operators import batch, index, search
from waymark.sources import csvroute, geojson, requests, tables
from waymark.streaming import geocode

from .test_engine import asked, made, place

RESULTS = ["latitude", "longitude", "result_label", "result_score", "result_score_next", "result_type", "result_id", "result_housenumber", "result_name", "result_postcode", "result_city", "result_context", "result_citycode", "result_oldcitycode", "result_oldcity", "result_district"]


@pytest.fixture(scope="module")
def ix(spark):
    rows = [place("66136_0001", "street", "Rue Clement Marot", "66000", "Perpignan", lat=42.69, lon=2.89, numbers=("4", "12bis")), place("69381_0001", "street", "Rue Clement Marot", "69001", "Lyon", importance=0.4, lat=45.76, lon=4.83), place("66136", "municipality", "Perpignan", ["66000", "66100"], "Perpignan", 0.6, lat=42.7, lon=2.9)]
    return made(spark, rows)


def test_geocode_table(spark, ix):
    rows = [(1, "12 BIS RUE CLEMENT MAROT", "perpignan", "old", 1), (2, "rue clement marot", None, None, 1), (3, None, None, None, 1), (4, "x" * 201, "", None, 1), (5, "nowhere", "", None, 1), (1, "12 BIS RUE CLEMENT MAROT", "perpignan", "old", 1), (6, "rue clement marot", "lyon 69001", None, 1)]
    table = spark.createDataFrame(rows, "id long, street string, city string, result_label string, score int")
    out = batch.geocode_table(table, ix, ["street", "city"], result_columns=["result_num_complement_short", "result_label", "result_num"])
    assert out.columns == ["id", "street", "city", "score", *RESULTS, "result_num", "result_num_complement_short"]
    got = {r.id: r for r in out.collect()}
    assert out.count() == 7 and got[1].result_id == "66136_0001_12bis" and got[1].result_label == "12bis Rue Clement Marot 66000 Perpignan" and (got[1].result_housenumber, got[1].result_num, got[1].result_num_complement_short) == ("12bis", "12", "b") and got[1].result_type == "housenumber"
    assert got[2].result_id == "66136_0001" and got[2].result_score_next > 0 and got[2].result_housenumber is None and got[2].result_num is None
    assert got[6].result_id == "69381_0001" and got[6].result_score_next == 0.0 and got[6].result_postcode == "69001"
    assert [got[i].result_id for i in (3, 4, 5)] == [None] * 3 and got[5].result_score_next is None
    assert [r.id for r in batch.too_long(table, ["street", "city"]).collect()] == [4]
    assert batch.warning([4, 2]) == "query_too_long; limit=200; count=2; rows=2,4" and batch.warning([]) is None and batch.warning(range(1, 201)).endswith(",100")
    assert batch.geocode_table(table, ix, ["street", "city"], min_score=1.0).filter("result_id is not null").count() == 0
    assert batch.geocode_table(table.limit(0), ix).count() == 0
    for wrong in ({"columns": ["town"]}, {"columns": ["street"], "filters": {"postcode": ["zip"]}}, {"columns": ["street"], "position": ("a", "b")}):
        with pytest.raises(ValueError, match="no column"):
            batch.geocode_table(table, ix, **wrong)


def test_filters_and_positions_of_rows(spark, ix):
    rows = [(1, "rue clement marot", "69001 ", "", "", ""), (2, "rue clement marot", "13001", "", "", ""), (3, "rue clement marot", "", "", "", ""), (4, "rue clement marot", "", "municipality", "", ""), (5, "rue clement marot", None, None, "45.7601", "4_.83".replace("_", "")), (6, "rue clement marot", "", "street", "45.76", "")]
    table = spark.createDataFrame(rows, "id int, q string, zip string, kind string, lat string, lon string")
    got = {r.id: r.result_id for r in batch.geocode_table(table, ix, ["q"], filters={"postcode": ["zip"], "type": ["kind"]}, position=("lat", "lon")).collect()}
    assert got == {1: "69381_0001", 2: None, 3: "66136_0001", 4: None, 5: "69381_0001", 6: "66136_0001"}
    assert {r.result_id for r in batch.geocode_table(table.limit(1), ix, ["q"], wanted={"postcode": ["66000"]}).collect()} == {"66136_0001"}
    for lat, lon, why in (("abc", "1", "invalid number"), ("90", "1", "out of range")):
        with pytest.raises(Exception, match=why):
            batch.geocode_table(spark.createDataFrame([("rue", lat, lon)], "q string, lat string, lon string"), ix, ["q"], position=("lat", "lon")).collect()
    for half in (("lat", None), (None, "lon")):
        with pytest.raises(ValueError, match="without"):
            batch.named_position(*half)


def test_reverse_table(spark, ix):
    rows = [(1, "42.6901", "2.8901", ""), (2, "", "", ""), (3, "abc", "1", ""), (4, "0", "0", ""), (5, None, "1", ""), (6, "4_5.76", " 4.83 ", ""), (7, "nan", "1", ""), (8, "42.6901", "2.8901", "street"), (9, "42.705", "2.9", "")]
    table = spark.createDataFrame(rows, "id long, lat string, lng string, kind string")
    out = batch.reverse_table(table, ix, filters={"type": ["kind"]})
    assert len(out.columns) == 4 + 15
    got = {r.id: r for r in out.collect()}
    assert {i: r.result_id for i, r in got.items()} == {1: "66136_0001_4", 2: None, 3: None, 4: None, 5: None, 6: "69381_0001", 7: None, 8: "66136_0001", 9: None}
    assert got[1].result_distance == 0 and got[1].result_label == "4 Rue Clement Marot 66000 Perpignan" and got[8].result_distance > 0
    assert {r.id: r.result_label for r in batch.reverse_table(table, ix, radius_m=2000.0).collect()}[9] == "Perpignan"
    with pytest.raises(Exception, match="out of range"):
        batch.reverse_table(spark.createDataFrame([("95", "1")], "lat string, lon string"), ix).collect()
    with pytest.raises(ValueError, match="position columns"):
        batch.reverse_table(table.drop("lat"), ix)


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([("a;b", 'say "x"'), (None, "two\nlines")], "p string, q string")
    for name in ("t.csv", "t.PQ"):
        tables.write_table(df, f"{tmp_path}/{name}")
        assert sorted(map(repr, tables.read_table(spark, f"{tmp_path}/{name}").collect())) == sorted(map(repr, df.collect()))
    with pytest.raises(ValueError):
        tables.format_of("x.xls")


def test_geojson(spark, ix):
    q = asked(spark, [(1, "4 rue clement marot perpignan"), (2, "zzz")])
    got = {r.qid: json.loads(r.body) for r in geojson.collections(q, geojson.features(search.search(q, ix)), query=F.col("query")).collect()}
    first = got[1]["features"][0]
    assert first["geometry"]["coordinates"] == [pytest.approx(2.8901), pytest.approx(42.6901)] and first["properties"] == {
        "label": "4 Rue Clement Marot 66000 Perpignan", "score": first["properties"]["score"], "housenumber": "4", "id": "66136_0001_4", "type": "housenumber", "name": "4 Rue Clement Marot", "postcode": "66000", "citycode": "66136", "city": "Perpignan", "importance": 0.5, "street": "Rue Clement Marot"
    }
    assert got[2]["features"] == [] and got[2]["licence"] == "ETALAB-2.0" and got[2]["query"] == "zzz" and got[1]["version"] == "draft"


def test_request_values():
    ints = {"5": 5, " 2 ": 2, "+2": 2, "-1": -1, "1_0": 10, "": None, "2.0": None, "1__0": None, "_1": None, "abc": None}
    assert {v: requests.whole_number(v) for v in ints} == ints
    floats = {"48.8": 48.8, " 4_8.5 ": 48.5, "1e2": 100.0, ".5": 0.5, "5.": 5.0, "nan": None, "inf": None, "1e999": None, "": None, "_1": None, "x": None}
    assert {v: requests.number(v) for v in floats} == floats
    assert requests.flag("on") is True and requests.flag("off") is False and requests.flag("") is None and requests.flag("", True) is True and requests.flag("maybe") is None
    named = [("postcode", "75001 75002"), ("type", ""), ("TYPE", "street"), ("postcode", " "), ("postcode", " 75003 "), ("type", "street,locality")]
    assert requests.filters(named) == {"type": ["", "street,locality"], "postcode": ["75001", "75002", "75003"]}


def test_read_requests():
    read = lambda *pairs: requests.read_search([("q", "paris"), *pairs])
    assert read().autocomplete and read(("autocomplete", "")).autocomplete and not read(("autocomplete", "1"), ("autocomplete", "off")).autocomplete
    assert (read(("limit", "0")).limit, read(("limit", "7"), ("limit", "3")).limit) == (5, 3)
    got = read(("latitude", " 4_8.5 "), ("lng", "2"))
    assert (got.lat, got.lon) == (48.5, 2.0)
    spot = requests.read_reverse([("lat", "0"), ("lon", "0"), ("limit", "-2")])
    assert (spot.lat, spot.lon, spot.limit, spot.nearest) == (0.0, 0.0, -2, None)
    assert requests.read_reverse([("lat", "48"), ("lon", "2"), ("nearest", "1"), ("radius", "800")]).nearest == 800.0
    for reader, pairs, why in (
        (requests.read_search, [], 'The "q" parameter is required.'), (requests.read_search, [("q", "x"), ("limit", "101")], "out of range (1..100)"), (requests.read_search, [("q", "x"), ("autocomplete", "maybe")], '"true" or "false"'), (requests.read_search, [("q", "x"), ("lng", "abc")], 'The "lng" parameter is invalid. invalid value'),
        (requests.read_search, [("q", "x"), ("lat", "91"), ("lon", "181")], 'The "lon" parameter is invalid. out of range'), (requests.read_reverse, [], 'The "lon" parameter is required.'), (requests.read_reverse, [("lon", "2")], 'The "lat" parameter is required.'),
        (requests.read_reverse, [("lat", "48"), ("lon", "2"), ("limit", "x")], "must be an integer"), (requests.read_reverse, [("lat", "48"), ("lon", "2"), ("nearest", "1"), ("limit", "101")], "out of range"), (requests.read_reverse, [("lat", "48"), ("lon", "2"), ("radius", "5")], "goes with"),
    ):
        with pytest.raises(requests.Refused) as e:
            reader(pairs)
        assert why in (e.value.description or e.value.title) and e.value.status == 400 and e.value.body()["title"]


def test_answers(spark, ix):
    body = requests.search_json(ix, [("q", "rue clement marot"), ("autocomplete", "0"), ("postcode", "69001"), ("lat", "45.76"), ("lon", "4.83")])
    assert [f["properties"]["id"] for f in body["features"]] == ["69381_0001"] and body["filters"] == {"postcode": ["69001"]} and body["center"] == [4.83, 45.76] and body["limit"] == 5 and body["features"][0]["properties"]["distance"] == 0
    assert [f["properties"]["id"] for f in requests.reverse_json(ix, [("lat", "42.6901"), ("lon", "2.8901")])["features"]] == ["66136_0001_4"]
    assert requests.reverse_json(ix, [("lat", "42.6901"), ("lon", "2.8901"), ("limit", "-1")])["features"] == []
    with pytest.raises(requests.Refused) as e:
        requests.search_json(ix, [("q", "x" * 201)])
    assert e.value.status == 413 and "201 chars" in e.value.title and requests.health(ix)["documents"] == 3


def test_dialects():
    content = "ad3,city,zip_code\r\n1 RUE D 'ARC,PARIS,75001\r\n2 RUE L 'EST ' B,LYON,69001\r\n"
    for columns in (["ad3", "city", "zip_code"], None):
        dialect, rows = csvroute.fitting(content, csvroute.Dialect(" ", "'"), columns)
        assert (dialect.delimiter, dialect.quotechar) == (",", '"') and rows[2] == ["2 RUE L 'EST ' B", "LYON", "69001"]
    assert csvroute.dialect_of("a;b\r\n1;2\r\n").delimiter == ";" and csvroute.dialect_of("name\r\nx\r\n").delimiter in csvroute.FREE
    assert csvroute.dialect_of("a;b\r\n1;2\r\n", "|", "'") == csvroute.Dialect("|", "'")
    for wrong in ((b"", "utf-8"), (b"\xff", "utf-8"), (b"a", "latin-1")):
        with pytest.raises(csvroute.BadRequest):
            csvroute.decoded(*wrong)
    assert csvroute.decoded(b"\xef\xbb\xbfa\rb\nc") == ("ab\r\nc", True)
    assert csvroute.cell(["a", "b", "a"], ["1", "2", "3"], "a") == "3" and csvroute.cell(["a", "b", "a"], ["1", "2"], "a") is None and csvroute.cell(["a"], ["1"], "z") is None
    assert [csvroute.stem(n) for n in ("chunk.csv", "a.b.csv", ".hidden", "dir.d/file", "")] == ["chunk", "a.b", ".hidden", "dir.d/file", ""]


def test_search_csv(spark, ix):
    data = ("q;cp;result_city\n12 BIS RUE CLEMENT MAROT;66000;x\nRUE CLEMENT MAROT;69001;\nzzz;;old\n\n" + "VOLUPTATEM " * 25 + ";;\n").encode()
    out = csvroute.search_csv(ix, data, "a.b.csv", {"columns": ["q"], "postcode": ["cp"], "result_columns": ["result_num"]})
    lines = out.body.decode().removeprefix(csvroute.SIGNATURE).splitlines()
    assert lines[0] == "q;cp;result_city;" + ";".join(h for h in RESULTS if h != "result_city") + ";result_num"
    assert lines[1].startswith("12 BIS RUE CLEMENT MAROT;66000;Perpignan;42.6902;2.8902") and lines[1].endswith(";12") and ";12bis;" in lines[1] and "69381_0001" in lines[2]
    assert lines[3] == "zzz;;old" + ";" * 16 and out.warning == "query_too_long; limit=200; count=1; rows=4" and out.content_disposition.endswith('"a.b.geocoded.csv"')
    for params, why in (({"postcode": ["zip"]}, "Cannot found column 'zip'"), ({"lat": ["cp"]}, "without"), ({"lat": ["q"], "lon": ["cp"]}, 'invalid number "12 BIS RUE CLEMENT MAROT" in column "q", row 1'), ({"min_score": ["x"]}, "min_score"), ({"with_bom": ["maybe"]}, "with_bom"), ({"lat": ["cp"], "lon": ["cp"]}, "out of range")):
        with pytest.raises(csvroute.BadRequest, match=why.replace("(", ".")):
            csvroute.search_csv(ix, data, "", {"columns": ["q"], **params})


def test_reverse_csv(spark, ix):
    data = b"latitude,lon,id\n42.6901,2.8901,1\nabc,2,2\n,,3\n42.705,2.9,4\n"
    lines = csvroute.reverse_csv(ix, data, "p.csv", {"encoding": ["utf-8"]}).body.decode().splitlines()
    assert lines[0].startswith("latitude,lon,id,result_latitude") and "4 Rue Clement Marot 66000 Perpignan,0,housenumber" in lines[1] and lines[2] == "abc,2,2" + "," * 15 and lines[4].endswith("," * 15)
    assert "Perpignan" in csvroute.reverse_csv(ix, data, "p.csv", {"nearest": ["1"], "radius": ["900"], "with_bom": [""], "encoding": ["utf-8"]}).body.decode().splitlines()[4]
    for params in ({"nearest": ["1"], "radius": ["0"]}, {"radius": ["5"]}, {"type": ["kind"]}):
        with pytest.raises(csvroute.BadRequest):
            csvroute.reverse_csv(ix, data, "", params)
    with pytest.raises(csvroute.BadRequest, match="row 1"):
        csvroute.reverse_csv(ix, b"lat,lon\n91,1\n")


def test_stream(spark, ix, tmp_path):
    spark.createDataFrame([(1, "perpignan"), (2, "rue clement marot lyon")], "id long, q string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, q string").parquet(f"{tmp_path}/in")
    geocode.geocoded_stream(stream, ix, f"{tmp_path}/out", f"{tmp_path}/ck", ["q"], availableNow=True).awaitTermination(120)
    assert {r.id: r.result_id for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: "66136", 2: "69381_0001"}
