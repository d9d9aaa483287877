"""Stupid-backoff language-model scores, computed relationally.

A word's score is count(context + word) / count(context) for the longest context whose n-gram is counted, ALPHA times less for
each word the context was shortened by, and count(word) / words for no context. A document's score is the sum of its words'
logarithms.

foreign_scores() says this for any texts under the tables of any corpus: n-grams exploded by position, joined to each order's table by a
left join, backed off where the join finds nothing.

own_scores() is for texts that are the corpus themselves, as in op6. N-grams are exploded by position to rows (k, o, n, r): context, last word, uses, text.
Rows are dealt out once, by k; in a hash partition each n-gram meets all uses of itself and of its context, so each row is joined to both counts
in place (windows over k, o and over k), scored, and summed by text. What ends a text is a row that only counts. Every n-gram of the corpus is counted, so
none is missing and a context is shortened only where a text begins: the first words of a text are scored as one n-gram over all words.

Hot n-grams are taken out before: a sample names frequent contexts and n-grams, one scan of all texts counts these exactly, and they are broadcast. A
frequent n-gram is scored where it stands. Other n-grams of a frequent context are dealt by both words, so that the context's rows are spread.
Which n-grams the sample names changes the work, never a score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .store import written

ALPHA = 0.4
ORDER = 2
#: Frequent contexts and n-grams that are broadcast, at most.
CONTEXTS = 16_000
COMMON = 300_000
#: Share of the rows that is looked at for them.
SAMPLE = 0.125
#: Words that a hash partition is meant to hold the n-grams of.
PART = 3_000_000
#: Rows that a Python step gives back at a time.
OUT = 40_000
#: o of rows that aren't n-grams with a context of their own: a frequent context's number below CONTEXTS, what only counts as a context, a text's first words, a text.
END, HEAD, TEXT = -1, -2, -3
#: Words of the documents that one block holds, and rows at most: their numbers are 16-bit.
BLOCK = 600_000
BLOCK_ROWS = 32_000


def _rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))


def _grams(rows: DataFrame, order: int) -> DataFrame:
    """rows with at (position) and g1 to g<order>, the n-grams that end there; null where the text is too short."""
    listed = rows.withColumn("w", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).drop("text")
    placed = listed.select("*", F.posexplode("w").alias("at", "word"))
    return placed.select(*listed.drop("w").columns, "at", *(F.when(F.col("at") >= k - 1, F.array_join(F.slice("w", F.col("at") + 2 - k, k), " ")).alias(f"g{k}") for k in range(1, order + 1)))


def count_tables(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> list[DataFrame]:
    """For each length up to order the table (g, c) of all n-grams and how often they occur, written."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    grams = _grams(docs.select(text.alias("text")), order)
    return [written(grams.filter(F.col(f"g{k}").isNotNull()).groupBy(F.col(f"g{k}").alias("g")).agg(F.count("*").alias("c")), f"lm_counts_{k}") for k in range(1, order + 1)]


def foreign_scores(docs: DataFrame, tables: list[DataFrame], id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """doc_id, n_words, log_score of every row under count_tables() of any corpus, of as many orders as there are tables.

    N-grams of two words or more count from `least` occurrences on. A word that the corpus lacks counts half an occurrence, so that every score is
    finite; an empty corpus counts as one word. Null and empty texts have no words and score 0; repeated rows and null ids are rows of their own.
    """
    order = len(tables)
    rows = written(_rows_of(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "lm_rows")
    counted = _grams(rows.drop("doc_id"), order)
    total = max(tables[0].agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0], 1)
    for k, table in enumerate(tables, 1):
        counted = counted.join(table.select(F.col("g").alias(f"g{k}"), F.col("c").alias(f"c{k}")), f"g{k}", "left")
        if k < order:
            context = table.select(F.col("g").alias("x"), F.col("c").alias(f"context{k}"))
            counted = counted.withColumn("x", F.regexp_replace(F.col(f"g{k + 1}"), " [^ ]*$", "")).join(context, "x", "left").drop("x")
    score = F.log(F.coalesce(F.col("c1"), F.lit(0.5)) / total)
    for k in range(2, order + 1):
        score = F.when(F.col(f"c{k}") >= least, F.log(F.col(f"c{k}") / F.col(f"context{k - 1}"))).when(F.col(f"g{k}").isNotNull(), score + math.log(ALPHA)).otherwise(score)
    sums = counted.groupBy("row").agg(F.count("*").alias("n_words"), F.sum(score).alias("log_score"))
    return rows.join(sums, "row", "left").select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.round(F.coalesce("log_score", F.lit(0.0)), 6).alias("log_score"))


def _blocks(batches, most: int = BLOCK):
    """(doc ids, word hashes, row of each word) of blocks of rows."""
    held: list[tuple] = []
    size = count = 0
    for batch in (whole.slice(a, BLOCK_ROWS) for whole in batches for a in range(0, whole.num_rows, BLOCK_ROWS)):
        for i, j, off, data in W.chunks(batch.column("text")):
            starts, ends, first = W.places(off, data)
            if held and count + j - i > BLOCK_ROWS:
                yield _block(held)
                held, size, count = [], 0, 0
            held.append((batch.column("doc_id").slice(i, j - i), W.hashes(data, starts, ends), np.diff(first)))
            size, count = size + len(starts), count + j - i
            if size >= most:
                yield _block(held)
                held, size, count = [], 0, 0
    if held:
        yield _block(held)


def _block(held: list[tuple]):
    ids, h, n = zip(*held)
    n = np.concatenate(n)
    return pa.concat_arrays(ids), np.concatenate(h), np.repeat(np.arange(len(n)), n)


def _starts(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a block whether it begins its text, and the number of words that follow in it."""
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    ends = np.concatenate([at[1:], [len(row)]]).astype(np.int64)
    return first, np.repeat(ends, np.diff(np.concatenate([at, [len(row)]]))) - 1 - np.arange(len(row)) if len(row) else np.zeros(0, np.int64)


def _keys(h: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams of 1 to `order` words that begin at each word, as far as there are words; those over the ends of texts too."""
    out = [h]
    for k in range(1, order):
        before = out[-1][: max(0, len(h) - k)]
        out.append(W.mix(before * np.uint64(0xD1342543DE82EF95) + h[k:]) if len(before) else before)
    return out


def _sent(**columns):
    """Batches of OUT rows at most; an array or one value for each column, None for nulls."""
    kinds = {"k": pa.int64(), "o": pa.int64(), "n": pa.int32(), "r": pa.int64(), "doc_id": pa.int64(), "n_words": pa.int64(), "base": pa.float64(), "g": pa.int64(), "x": pa.int64(), "size": pa.int32()}
    size = max(len(c) for c in columns.values() if isinstance(c, (np.ndarray, pa.Array)))
    for i in range(0, size, OUT):
        m = min(OUT, size - i)
        made = []
        for name, c in columns.items():
            if isinstance(c, np.ndarray):
                c = c[i : i + m]
                c = pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, kinds[name])
            elif isinstance(c, pa.Array):
                c = c.slice(i, m)
            else:
                c = pa.nulls(m, kinds[name]) if c is None else pa.array(np.full(m, c), kinds[name])
            made.append(c)
        yield pa.RecordBatch.from_arrays(made, names=list(columns))


def frequent(rows: DataFrame, order: int, share: float = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of contexts (order - 1 words) and of n-grams with such a context that are frequent in a sample of rows: CONTEXTS and COMMON at most."""

    def run(batches):
        for _, h, row in _blocks(batches):
            left = _starts(row)[1]
            keys = _keys(h, order)
            for size in range(max(1, order - 1), order + 1):
                at = np.flatnonzero(left[: len(keys[size - 1])] >= size - 1)
                g, first, n = np.unique(keys[size - 1][at], return_index=True, return_counts=True)
                often = n > 1
                if often.any():
                    x = keys[size - 2][at[first[often]]] if size > 1 else np.zeros(int(often.sum()), np.uint64)
                    yield from _sent(size=size, g=g[often], x=x, n=n[often])

    some = rows if share >= 1 else rows.sample(share, 7)
    seen = written(some.mapInArrow(W.settled(run), "size int, g long, x long, n int").groupBy("size", "g").agg(F.first("x").alias("x"), F.sum("n").alias("n")), "lm_frequent")

    def most(size: int, limit: int) -> pa.Table:
        least, held = 1 << 62, 0
        for r in seen.filter(F.col("size") == size).groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
            held += r["count"]
            if held > limit:
                break
            least = r.n
        return seen.filter((F.col("size") == size) & (F.col("n") >= least)).select("g", "x").toArrow()  # `limit` rows at most

    table = most(order, COMMON)
    grams, of = (table.column(c).to_numpy().view(np.uint64) for c in (0, 1))
    if order == 1:
        return np.zeros(0, np.uint64), np.sort(grams)
    contexts = np.sort(most(order - 1, CONTEXTS).column(0).to_numpy().view(np.uint64))
    return contexts, np.sort(grams[_found(contexts, of)[1]])


def _found(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def own_scores(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", share: float = SAMPLE) -> DataFrame:
    """doc_id, n_words, log_score of every row under the counts of all rows' n-grams, up to `order` words.

    Null and empty texts have no words and score 0; repeated rows are rows of their own, and their words count as often; an empty table gives an empty
    result; further columns are left out. share: of the rows, in which hot n-grams are looked for.
    """
    spark = docs.sparkSession
    rows = _rows_of(docs, id_col, text_col)
    hot = spark.sparkContext.broadcast(frequent(rows, order, share))

    def counts(batches):
        contexts, grams = hot.value
        uses = np.zeros(len(contexts) + len(grams) + 1, dtype=np.int64)  # the last: all words
        for _, h, row in _blocks(batches):
            left = _starts(row)[1]
            keys = _keys(h, order)
            uses[-1] += len(h)
            for table, size, first in ((contexts, order - 1, 0), (grams, order, len(contexts))):
                if size and len(table):
                    at, there = _found(table, keys[size - 1][left[: len(keys[size - 1])] >= size - 1])
                    uses[first : first + len(table)] += np.bincount(at[there], minlength=len(table))
        g = np.flatnonzero(uses)
        if len(g):
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(uses[g])], names=["g", "n"])

    known = rows.mapInArrow(W.settled(counts), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()  # CONTEXTS + COMMON + 1 rows at most
    n_contexts, n_grams = (len(x) for x in hot.value)
    uses = np.ones(n_contexts + n_grams + 1, dtype=np.int64)
    uses[known.column("g").to_numpy()] = known.column("n").to_numpy()
    total = int(uses[-1])
    logs = spark.sparkContext.broadcast(np.log(uses))

    def exploded(batches):
        contexts, grams = hot.value
        log_context, log_gram, log_total = logs.value[:n_contexts], logs.value[n_contexts:-1], float(logs.value[-1])
        before = TaskContext.get().partitionId() << 40  # the same if the task runs again
        for ids, h, row in _blocks(batches):
            first, left = _starts(row)
            keys = _keys(h, order)
            n_words = np.bincount(row, minlength=len(ids))
            base = np.zeros(len(ids))
            at = np.flatnonzero(left[: len(keys[-1])] >= order - 1)
            place, common = _found(grams, keys[-1][at])
            if order > 1:
                x = keys[-2][at]
                context, wide = _found(contexts, x)
                over = np.where(wide, log_context[context] if n_contexts else 0.0, 0.0)
            else:
                x, context, wide, over = at, np.zeros(len(at), np.int64), np.ones(len(at), bool), np.full(len(at), log_total)
            base += np.bincount(row[at], weights=-over, minlength=len(ids))
            if common.any():
                base += np.bincount(row[at[common]], weights=log_gram[place[common]], minlength=len(ids))
            salted, plain = wide & ~common, ~wide & ~common
            if salted.any():
                number = context[salted]
                k = W.mix(h[at[salted] + order - 1] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield from _sent(k=k, o=number, n=1, r=before + row[at[salted]], doc_id=None, n_words=None, base=None)
            if plain.any():
                yield from _sent(k=x[plain], o=h[at[plain] + order - 1], n=1, r=before + row[at[plain]], doc_id=None, n_words=None, base=None)
            for size in range(1, order):
                g = keys[size - 1]
                begins = np.flatnonzero(first[: len(g)] & (left[: len(g)] >= size - 1 if size == order - 1 else left[: len(g)] == size - 1))
                base[row[begins]] -= log_total
                if size == order - 1:
                    ends = g[left[: len(g)] == size - 1]
                    place, there = _found(contexts, ends)
                    more, n = ends[~there], 1
                    place, there = _found(contexts, g[begins])
                    if there.any():
                        base[row[begins[there]]] += log_context[place[there]]
                    begins = begins[~there]
                else:
                    more, n = np.unique(g[left[: len(g)] >= size - 1], return_counts=True)
                if len(more):
                    yield from _sent(k=more, o=END, n=n, r=None, doc_id=None, n_words=None, base=None)
                if len(begins):
                    yield from _sent(k=g[begins], o=HEAD, n=0, r=before + row[begins], doc_id=None, n_words=None, base=None)
            r = before + np.arange(len(ids))
            yield from _sent(k=W.mix(r.astype(np.uint64)), o=TEXT, n=0, r=r, doc_id=ids, n_words=n_words, base=base)
            before += len(ids)

    o = F.col("o")
    wide = o.between(0, max(n_contexts, 1) - 1)  # with one word, the empty context has number 0
    counts_as_context = F.when((o == HEAD) | (o == TEXT) | wide, 0).otherwise(F.col("n"))
    dealt = rows.mapInArrow(W.settled(exploded), "k long, o long, n int, r long, doc_id long, n_words long, base double").repartition(max(1, math.ceil(total / PART)), "k")
    joined = dealt.withColumn("uses", F.sum("n").over(Window.partitionBy("k", "o"))).withColumn("context", F.sum(counts_as_context).over(Window.partitionBy("k")))
    gained = F.when(o == TEXT, F.col("base")).when(o == HEAD, F.log("context")).when(wide, F.log("uses")).otherwise(F.log(F.col("uses") / F.col("context")))
    sums = joined.filter("r IS NOT NULL").groupBy("r").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum(gained).alias("log_score"))
    return sums.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"))


def op6_lm(spark, sf_dir):
    """Stupid-backoff log score of every document under the counts of all words and pairs of all documents; mean_log_score is it per word."""
    from .store import table

    made = own_scores(table(spark, sf_dir, "documents"))
    return made.withColumn("mean_log_score", F.round(F.col("log_score") / F.greatest("n_words", F.lit(1)), 6))
