"""The scalar functions against golden values and, per query, the engine against DuckDB."""

import glob
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, text
from waymark.operators import search
from waymark.plans import queries as plans

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_fold(spark):
    assert one(spark, text.fold(F.lit("L'Abergement-de-Varey"))) == "l abergement de varey"
    assert one(spark, text.fold(F.lit("Œuvre  Straße é½"))) == "oeuvre strasse e 1 2"
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []
    assert one(spark, text.without_leading_zeros(F.lit("007 rue 0012"))) == "7 rue 12"


@pytest.mark.parametrize("written, want", [("12bis", ("12", "bis", "b")), ("12", ("12", None, None)), ("3 B", ("3", "B", "b")), ("x", (None, "x", "x"))])
def test_split_housenumber(spark, written, want):
    assert tuple(one(spark, text.split_housenumber(F.lit(written)))) == want


@pytest.mark.parametrize("a, b, want", [("lima", "lima", 1.0), ("ab", "cd", 0.0), ("a", "a", 1.0), ("abab", "ab", 1 / 3), ("rue de la gare 45000 orleans", "rue de la gare", 0.48148148148148145), ("aa", "aaa", 0.5), ("aaaa", "aaa", 2 / 3), ("paris", "pariss", 0.8), ("", "abc", 0.0), ("ab", "x", 0.0)])
def test_similarity(spark, a, b, want):
    assert one(spark, text.similarity(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_rounding(spark):
    assert one(spark, text.rounded(F.lit(1.005))) == 1.0
    assert one(spark, text.rounded(F.lit(0.125))) == 0.12
    assert one(spark, text.rounded(F.lit(1234.5))) == 1234.5


def test_transliteration(spark):
    got = {w: one(spark, text.fold(F.lit(w))) for w in ("Łódź", "Őrség", "ŒUVRE", "Москва", "Ελλάδα", "Thề", "Ŝŭ", "東京 x", "n°5", "Straße", "ĳ")}
    assert got == {"Łódź": "lodz", "Őrség": "orseg", "ŒUVRE": "oeuvre", "Москва": "moskva", "Ελλάδα": "ellada", "Thề": "the", "Ŝŭ": "su", "東京 x": "x", "n°5": "ndeg5", "Straße": "strasse", "ĳ": "ij"}


def test_numbers_as_python_writes_them(spark):
    xs = [0.0, -0.0, 1.0, 0.87, 45.123456, 0.0001, 0.00001234, 1e16, 123456789012345.6, -2.5e-7, 1e22, 12345678.0, 0.001, 887475.0, float("nan"), float("inf"), float("-inf"), 1e7, 123456789.125]
    rows = spark.createDataFrame(list(enumerate(xs)), "i int, v double").select("i", text.python_number(F.col("v")).alias("x")).orderBy("i").collect()
    assert [r.x for r in rows] == list(map(repr, xs))


def test_gram_codes(spark):
    pairs = [("lima", "lima"), ("abab", "ab"), ("aaaa", "aaa"), ("rue de la gare", "rue de la gare 45000 orleans"), ("ab", "cd")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    got = rows.select(text.similarity(a, b).alias("x"), text.code_similarity(text.gram_codes(a), text.gram_codes(b)).alias("y"), (F.array_sort(text.prefixed_codes(a, b, text.gram_codes(b))) == F.array_sort(text.gram_codes(F.concat_ws(" ", a, b)))).alias("z")).collect()
    assert all(r.x == r.y and r.z for r in got)


def test_cells(spark):
    assert one(spark, geo.cell_text(geo.cell(F.lit(48.8566), F.lit(2.3522)))) == "u09tvw0"
    assert one(spark, geo.cell(F.lit(90.0), F.lit(0.0))) is None
    assert [one(spark, F.size(geo.ring(F.lit(10.0), F.lit(180.0), k))) for k in (0, 1, 2, 5)] == [1, 8, 16, 40]
    assert one(spark, F.size(geo.ring(F.lit(89.9999), F.lit(0.0), 0, 1))) == 6 and one(spark, F.size(geo.ring(F.lit(90.0), F.lit(0.0), 1))) == 0
    here = geo.cell(F.lit(48.8566), F.lit(2.3522))
    assert one(spark, geo.cell_parsed(F.lit("U09TVW0"))) == one(spark, here) and one(spark, geo.cell_parsed(F.lit("u09tvwa"))) is None and one(spark, geo.cell_parsed(F.lit("u09"))) is None
    middle = one(spark, geo.cell_center(here))
    assert abs(middle.lat - 48.8566) < 180 / 2**17 and abs(middle.lon - 2.3522) < 360 / 2**18 and one(spark, geo.cell(F.lit(middle.lat), F.lit(middle.lon))) == one(spark, here)
    assert one(spark, geo.cell_side_m(F.lit(0.0))) == pytest.approx(360 / 2**18 * 111_000 * math.cos(math.radians(1))) and one(spark, geo.cell_side_m(F.lit(89.5))) == pytest.approx(0, abs=1e-9)


def test_filters(spark):
    rows = spark.createDataFrame([("type", "street", 1), ("type", "street", 2), ("postcode", "01000", 2)], "name string, value string, doc long")
    assert [r.doc for r in search.allowed(rows, {"type": [" street ", ""], "postcode": ["01000"]}).collect()] == [2]
    assert search.allowed(rows, {"type": [" "]}) is None


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {path.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    got = plans.queries()[name](spark, DATA)
    want = con.sql(plans.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda records: sorted(map(repr, records))
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(con.sql(f"SELECT {', '.join(columns)} FROM ({plans.oracle_sql()[name]})").fetchall())


def test_without_the_training_operators(tmp_path):
    """The engine's queries are there when the folders of the training operators are not, with the pipeline's file and without it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/waymark", tmp_path / "waymark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    ask = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for pipeline in (False, True):
        if pipeline:
            (tmp_path / "corpus_pipeline.py").write_text("from waymark.llm import packing\n")
        got = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
        assert got.returncode == 0, got.stderr
        assert got.stdout.split() == [str(len(plans.queries())), "False", "False"]
