"""What repeats is done once, and nothing is cut: candidates, queries and positions that ask the same are one question."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from waymark.operators import postings, reverse, search
from waymark.plans import queries as plans

from .test_engine import asked, made, place


@pytest.fixture(scope="module")
def hamlets(spark):
    return made(spark, [place(f"7_{i:03}", "street", "Rue Haute" if i % 2 else "Rue Basse", "75001", "Paris", importance=1 - i / 100, numbers=("1",), lat=48.0 + i / 1e4, lon=2.0) for i in range(60)])


def _word(ix, df):
    return ix.tokens.filter(F.col("df") == df).orderBy("token").first().token


def test_candidates_once(spark, hamlets):
    """F16: candidates of the same words are one question, whatever the words' order; each gets its whole answer."""
    common, rare = _word(hamlets, 60), _word(hamlets, 30)
    rows = asked(spark, [(i, [common, rare] if i % 2 else [rare, common, common]) for i in range(40)], "qid int, tokens array<string>")
    candidates = postings.keys(rows, hamlets)
    members, questions = postings._questions(candidates, ("qid", "ord"), 3)
    assert questions.count() == 1 and members.count() == 40
    got = postings.intersect(candidates, hamlets, 3).collect()
    assert len(got) == 120 and len({(r["rank"], r.doc) for r in got}) == 3


def test_queries_once(spark, hamlets, monkeypatch):
    """F2, F3, F5, F7 to F10, F13: queries alike in all but qid are searched once, and each is answered."""
    seen = []
    analysed = search._Search.analysed
    monkeypatch.setattr(search._Search, "analysed", lambda self, queries: seen.append(queries.count()) or analysed(self, queries))
    q = asked(spark, [(i, "1 rue haute" if i % 2 else "rue basse paris", 2) for i in range(30)], "qid int, query string, limit int")
    got = search.search(q, hamlets).collect()
    assert seen == [2] and len(got) == 60 and {(r.qid % 2, r["rank"], r.doc) for r in got} == {(0, 1, 0), (0, 2, 2), (1, 1, 1), (1, 2, 3)}


def test_positions_once(spark, hamlets):
    """positions that are the same are one question; a document without a name is nearest only where its house number reaches it."""
    spots = asked(spark, [(i, 48.0 + i % 3 / 1e4, 2.0) for i in range(30)], "qid int, lat double, lon double")
    members, questions = reverse._asked(spots)
    assert questions.count() == 3 and members.count() == 30
    for found in (reverse.reverse(spots, hamlets), reverse.nearest(spots, hamlets, 5000.0)):
        assert sorted((r.qid, r.doc) for r in found.collect()) == [(i, i % 3) for i in range(30)]


def test_scan_of_all(spark, hamlets):
    """no cap of scanned documents; the best by the rarest word's score among all that hold every word."""
    words = asked(spark, [(1, [_word(hamlets, 30), _word(hamlets, 60)])], "qid int, tokens array<string>")
    got = postings.scanned(postings.keys(words, hamlets), hamlets, 50, None)
    assert got.count() == 30 and postings.scanned(postings.keys(words, hamlets), hamlets, 50, 4).count() == 4


def test_fallback_of_all(spark, tmp_path, monkeypatch):
    """every row of the table has a row in the result; no SQL cut stands in manual_scan."""
    rows = [(i, "large ring" if i % 2 else "hot bolt", f"Brand#{i % 3}", "LARGE", 1 + i % 8, 900.0 + i) for i in range(1, 20)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    found = plans.queries()["geocode_postcode_fallback"](spark, str(tmp_path))
    assert sorted(r.p_partkey for r in found.collect()) == list(range(1, 20))
    assert "<= 40" not in plans.oracle_sql()["manual_scan"]
