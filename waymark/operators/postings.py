"""Posting lists: scored intersections of words, ties at a cut, sets, bounded scans.

A candidate (qid, ord) is a set of words that a document must hold all of. Candidates that ask the same are one question. Words only look into each document's own row,
so common words never spread a question over their whole lists.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import numbered_questions
from .index import Index

BUCKET_MAX = 100
#: Words of a question that documents are led by before its other words are looked at.
DEPTH = 3
#: Questions up to this many go to every machine; more are dealt out by their beginnings.
FEW_QUESTIONS = 20_000


def keys(queries: DataFrame, index: Index) -> DataFrame:
    """qid, ord, words (df, token) of queries (qid, tokens): one candidate of all words of each query; df is null for unknown words."""
    each = queries.select("qid", F.explode(F.array_distinct("tokens")).alias("token")).join(index.tokens.select("token", "df"), "token", "left")
    return each.groupBy("qid").agg(F.collect_list(F.struct("df", "token")).alias("words")).select("qid", F.lit(0).alias("ord"), "words")


def _questions(candidates: DataFrame, by: tuple[str, ...], cut: int | Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, asked): by and question of the candidates whose words are all known, and each different question once (a written table), whoever asks it.

    A question is a number for words in order, filters' values and cells (of neither order nor repeats matter), and cut.
    """
    have = set(candidates.columns)
    values = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))))
    fields = {"words": F.array_sort(F.array_distinct("words"))} | {c: values(c) for c in ("types", "citycodes", "postcodes") if c in have}
    if "cells" in have:
        fields["cells"] = F.array_sort(F.array_distinct("cells"))
    if cut is not None:
        fields["cut"] = (F.lit(cut) if isinstance(cut, int) else cut).cast("int")
    met = candidates.filter((F.size("words") > 0) & F.forall("words", lambda w: F.coalesce(w["df"], F.lit(0)) > 0))
    return numbered_questions(met.select(*by, *(v.alias(f"asks_{n}") for n, v in fields.items())), {f"asks_{n}": n for n in fields}, by)


def _met(asked: DataFrame, index: Index) -> DataFrame:
    """asked's columns with doc and held (its words) of every document that answers a question.

    Documents are read once and follow the beginnings of the questions' words, the rarest first: a row is a document and a beginning that it holds all words of, shared by all
    questions that begin so. The work goes by what is found, not by questions times the documents of their rarest words.
    """
    extra = [(c, e) for c, e in (("types", "types"), ("citycode", "citycodes"), ("postcode", "postcodes"), ("near", "cells")) if e in asked.columns]
    joined = F.broadcast if asked.count() <= FEW_QUESTIONS else (lambda df: df.hint("merge"))
    word = lambda n: F.get("words", F.lit(n))["token"]
    begun = lambda n: F.xxhash64(F.slice(F.transform("words", lambda w: w["token"]), 1, n))  # noqa: E731  # should two have one number, all words decide in the end
    rows = index.documents.select("doc", F.col("words").alias("held"), *(F.col(c).alias(f"held_{e}") for c, e in extra)).withColumn("token", F.explode(F.map_keys("held")))
    roots = asked.select(word(0).alias("token"), begun(1).alias("node")).distinct()
    rows = rows.join(F.broadcast(roots), "token").drop("token")  # never more than the index has words
    for n in range(1, DEPTH):
        # a question without a further word stays where it is
        steps = asked.select(begun(n).alias("node"), word(n).alias("token"), begun(n + 1).alias("next")).distinct()
        rows = rows.join(joined(steps), (rows["node"] == steps["node"]) & (steps["token"].isNull() | F.map_contains_key(rows["held"], steps["token"]))).drop("node", "token").withColumnRenamed("next", "node")
    rows = rows.join(joined(asked.withColumn("node", begun(DEPTH))), "node").filter(F.forall("words", lambda w: F.map_contains_key("held", w["token"])))
    for _, asks in extra:
        own = F.arrays_overlap(f"held_{asks}", asks)
        rows = rows.filter(F.col("cells").isNull() | own if asks == "cells" else (F.size(asks) == 0) | own)
    return rows.drop("node", *(f"held_{e}" for _, e in extra))


def _summed(asked: DataFrame, index: Index) -> DataFrame:
    """question, doc, sum, and cut where asked has it."""
    added = F.aggregate("words", F.lit(0.0), lambda s, w: s + F.try_element_at("held", w["token"]))
    asks = [F.size(c) > 0 for c in ("types", "citycodes", "postcodes") if c in asked.columns]
    if "cells" in asked.columns:
        added = added + F.when(F.col("cells").isNotNull(), 1.0).otherwise(0.0)
    if asks:
        added = added + F.when(functools.reduce(Column.__or__, asks), 1.0).otherwise(0.0)
    return _met(asked, index).select("question", "doc", added.alias("sum"), *(c for c in ("cut",) if c in asked.columns))


def fetched(candidates: DataFrame, index: Index, by: tuple[str, ...] = ("qid", "ord")) -> DataFrame:
    """by, doc, sum: every document that holds all words of a candidate and passes its filters.

    candidates: by, words (array of df, token), and where there are such columns types, citycodes, postcodes (arrays of which a document must hold some value; empty
    ones ask nothing) and cells (of which it must lie in one; null asks nothing). The rarest word's score is added first, ties by word; a filter or a cell adds 1.
    """
    members, asked = _questions(candidates, by)
    return members.join(_summed(asked, index), "question").drop("question")


def best(found: DataFrame, limit: int | Column = BUCKET_MAX, by: tuple[str, ...] = ("qid", "ord")) -> DataFrame:
    """found with rank, the first `limit` by falling sum, then rising doc."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("sum"), "doc"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= limit)


def intersect(candidates: DataFrame, index: Index, limit: int | Column = BUCKET_MAX) -> DataFrame:
    """qid, ord, doc, sum, rank of the best documents that hold all words; none for a limit of 0. Each different question is answered once."""
    members, asked = _questions(candidates, ("qid", "ord"), limit)
    top = best(_summed(asked, index), limit if isinstance(limit, int) else F.col("cut"), ("question",))
    return members.join(top.drop("cut"), "question").drop("question")


def with_ties(candidates: DataFrame, index: Index, limit: int = BUCKET_MAX) -> DataFrame:
    """intersect() with all documents that tie with the last one kept, where some are left out: kept says which side of the cut a row is, tied whether it ties there."""
    members, asked = _questions(candidates, ("qid", "ord"))
    of = Window.partitionBy("question")
    found = _summed(asked, index).withColumn("level", F.rank().over(of.orderBy(F.desc("sum")))).filter(F.col("level") <= limit)
    placed = found.withColumn("rank", F.row_number().over(of.orderBy(F.desc("sum"), "doc"))).withColumn("n", F.count("*").over(of)).withColumn("last", F.max("level").over(of))
    cut = placed.select("question", "doc", "sum", "rank", (F.col("rank") <= limit).alias("kept"), ((F.col("n") > limit) & (F.col("level") == F.col("last"))).alias("tied"))
    return members.join(cut, "question").select("qid", "ord", "doc", "sum", "rank", "kept", "tied")


def scanned(candidates: DataFrame, index: Index, wanted: int | Column, scan: int | None = 501) -> DataFrame:
    """qid, ord, doc, rank: of the rarest word's `scan` best documents, or of all for None, those that hold the other words too and pass the filters, the first `wanted`."""
    members, asked = _questions(candidates, ("qid", "ord"), wanted)
    asked = asked.withColumn("token", F.get("words", F.lit(0))["token"])
    held = _met(asked, index).withColumn("score", F.try_element_at("held", "token"))
    if scan is not None:
        order = Window.partitionBy("token").orderBy(F.desc("score"), "doc")
        near = index.postings.join(F.broadcast(asked.select("token").distinct()), "token").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= scan)
        held = held.join(near.select("token", "doc"), ["token", "doc"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "doc"))
    top = held.select("question", "doc", "score", "cut").withColumn("rank", rank).filter(F.col("rank") <= F.col("cut")).select("question", "doc", "rank")
    return members.join(top, "question").select("qid", "ord", "doc", "rank")


def intersect_sets(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def union_sets(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def paired(candidates: DataFrame, index: Index, by: tuple[str, ...]) -> DataFrame:
    """The candidates (by, token, others: words) whose token stands with each of the others in some document; those without others stay."""
    each = candidates.select(*by, "token", F.explode(F.array_distinct("others")).alias("other"))
    met = each.join(index.pairs.select("token", "other"), ["token", "other"], "left_semi").groupBy(*by, "token").agg(F.count("*").alias("met"))
    return candidates.join(met, [*by, "token"], "left").filter(F.coalesce("met", F.lit(0)) == F.size(F.array_distinct("others"))).drop("met")


def completions(ends: DataFrame, index: Index) -> DataFrame:
    """qid, ord, token, df: words that begin with a query's last word and stand with each of its others in some document.

    ends: qid, last, others (array), alone. Where alone is set they come by falling score, otherwise by falling frequency; ties by word. ord counts from 1.
    """
    found = ends.join(index.edge_ngrams.select(F.col("ngram").alias("last"), "token"), "last").drop("last")
    fit = paired(found, index, ("qid",)).join(index.tokens, "token")
    order = Window.partitionBy("qid").orderBy(F.when(F.col("alone"), F.col("max_score")).otherwise(F.col("df").cast("double")).desc(), "token")
    return fit.withColumn("ord", F.row_number().over(order)).select("qid", "ord", "token", "df")
