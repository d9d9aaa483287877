"""Removing passages that repeat: FM-indexes of shards, searched backwards by all candidate stretches.

A window is a run of `window` words, and its anchor the least hash of the runs of ANCHOR words in it; equal windows have equal
anchors. Neighbouring windows with one anchor form a stretch. Anchors that occur once hold no repeated window, so only stretches of
repeated anchors are kept. A shard indexes all distinct stretches of its anchors, weighted by how often each occurs, and
streams them through the index: what matches twice or more over a window's length is reported. The stretches of an
anchor that is very common are dealt out window by window, so that no shard holds them all. Texts that are equal count once, with
a weight. Words stand as 64-bit hashes of which an index numbers the different ones, and texts as 96 bits of hashes.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .fmindex import FMIndex, repeats
from .store import free_names, written

WINDOW = 35
ANCHOR = 8
#: Symbols that one index is meant to hold.
SHARD = 400_000
#: Distinct texts above which an anchor's stretches are dealt out window by window: those of fewer fit one index.
COMMON = SHARD // (2 * WINDOW + ANCHOR)
_TEXT_KEY = ("h1", "h2")


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each stretch of one text's word hashes."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(ANCHOR, window)
    g = W.grams(h, k)
    span = window - k + 1
    low, width = g, 1
    while width * 2 <= span:
        low, width = np.minimum(low[: len(low) - width], low[width:]), width * 2
    least = np.minimum(low[:n], low[span - width : span - width + n])
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate([[0], change])
    return least[first], first, np.diff(np.concatenate([first, [n]]))


def recurring(h: np.ndarray, a: np.ndarray, window: int) -> np.ndarray:
    """Whether each anchor stands more than once in its own text: then one stretch may hold equal windows."""
    g = np.sort(W.grams(h, min(ANCHOR, window)))
    return np.searchsorted(g, a, side="right") - np.searchsorted(g, a) > 1


def _rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).withColumn("h1", F.xxhash64("text")).withColumn("h2", F.hash("text"))


def _word_hashes(column: pa.Array):
    """(row, hashes of its words) for every row."""
    for i, j, off, data in W.chunks(column):
        starts, ends, first = W.places(off, data)
        h = W.hashes(data, starts, ends)
        for r in range(i, j):
            yield r, h[first[r - i] : first[r - i + 1]]


def stretches(rows: DataFrame, window: int) -> DataFrame:
    """anchor, h1, h2, copies: the stretches of each text's anchors, one row per anchor, text and task."""

    def run(batches):
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            out = []
            for r, h in _word_hashes(batch.column(0)):
                a, _, _ = anchors(h, window)
                if len(a):
                    a = np.concatenate([a, a[recurring(h, a, window)]])  # once more, so that it counts as repeated
                    out.append((np.full(len(a), h1[r]), np.full(len(a), h2[r]), a.view(np.int64)))
            if out:
                x, y, a = (np.concatenate(c) for c in zip(*out))
                for i in range(0, len(a), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in (a, x, y)], names=["anchor", "h1", "h2"])

    return rows.select("text", "h1", "h2").mapInArrow(W.settled(run), "anchor long, h1 long, h2 int")


def repeated_stretches(rows: DataFrame, weights: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """key, content, weight, h1, h2, first, symbols of the stretches whose anchors repeat; a very common anchor's windows one by one.

    rows: one per text; wanted: h1, h2, anchors and whether each is common.
    """

    def run(batches):
        for batch in batches:
            h1, h2, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            lists = batch.column(4).to_pylist()
            out, size = [], 0
            for r, h in _word_hashes(batch.column(0)):
                want = {x["anchor"]: x["common"] for x in lists[r]}
                a, first, n = anchors(h, window)
                for anchor, f, m in zip(a.view(np.int64).tolist(), first.tolist(), n.tolist()):
                    common = want.get(anchor)
                    if common is None:
                        continue
                    for at, windows in ((f, m),) if not common else ((f + i, 1) for i in range(m)):
                        own = h[at : at + windows + window - 1].tobytes()
                        content = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True)
                        out.append((content if common else anchor, content, int(weight[r]), int(h1[r]), int(h2[r]), at, own))
                        size += len(own)
                if size > 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    texts = rows.join(weights, list(_TEXT_KEY)).join(wanted, list(_TEXT_KEY))
    return texts.select("text", "h1", "h2", "copies", "anchors").mapInArrow(W.settled(run), "key long, content long, weight long, h1 long, h2 int, first int, symbols binary")


_KINDS = [("key", pa.int64()), ("content", pa.int64()), ("weight", pa.int64()), ("h1", pa.int64()), ("h2", pa.int32()), ("first", pa.int32()), ("symbols", pa.binary())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(zip(*rows), _KINDS)], names=[n for n, _ in _KINDS])


def search(sequences: list[np.ndarray], weights: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(sequence, first, end) of stretches that occur twice or more, by an FM-index of all sequences."""
    lengths = np.array([len(s) for s in sequences])
    symbols, text = np.unique(np.concatenate(sequences), return_inverse=True)
    # a separator after each sequence: symbol 0, which no search asks for
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    full = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
    inside = np.ones(len(full), dtype=bool)
    inside[ends] = False
    full[inside] = text + 1
    index = FMIndex(full, len(symbols) + 1, np.repeat(weights, lengths + 1), int(lengths.max()))
    which, first, end = repeats(index, full, starts, ends, window)
    return list(zip(which.tolist(), (first - starts[which]).tolist(), (end - starts[which]).tolist()))


def repeated_parts(contents: DataFrame, shards: int, window: int) -> DataFrame:
    """key, content, parts (first and end within the stretch) of distinct stretches that hold repeated windows.

    contents: key, content, weight, symbols. Whole anchors are taken together until an index has SHARD symbols.
    """

    def run(batches):
        held, weights, names, size, last = [], [], [], 0, None

        def flush():
            parts: dict[int, list] = {}
            for i, a, b in search(held, np.array(weights), window):
                parts.setdefault(i, []).append({"a": a, "b": b})
            if parts:
                return pa.RecordBatch.from_arrays([pa.array([names[i][0] for i in parts], pa.int64()), pa.array([names[i][1] for i in parts], pa.int64()), pa.array(list(parts.values()), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["key", "content", "parts"])
            return None

        for batch in batches:
            for key, content, weight, symbols in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != last and size >= SHARD:
                    if (out := flush()) is not None:
                        yield out
                    held, weights, names, size = [], [], [], 0
                last = key
                held.append(np.frombuffer(symbols, dtype=np.uint64))
                weights.append(weight)
                names.append((key, content))
                size += len(held[-1])
        if held and (out := flush()) is not None:
            yield out

    return contents.select("key", "content", "weight", "symbols").repartition(shards, "key").sortWithinPartitions("key").mapInArrow(W.settled(run), "key long, content long, parts array<struct<a:int,b:int>>")


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """h1, h2 (hashes of a text) and spans: the word ranges [a, b) that windows occurring elsewhere too cover."""
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12)
    rows = _rows_of(docs, id_col, text_col)
    seen = written(stretches(rows, window).groupBy("anchor", *_TEXT_KEY).agg(F.count("*").alias("n")), "anchors")
    stats = seen.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).filter("n > 1")
    wanted = seen.select("anchor", *_TEXT_KEY).join(stats, "anchor").groupBy(*_TEXT_KEY).agg(F.collect_list(F.struct("anchor", (F.col("texts") > common).alias("common"))).alias("anchors"))
    weights = rows.select(*_TEXT_KEY).groupBy(*_TEXT_KEY).agg(F.count("*").alias("copies"))
    # one row per text: the limit of rank 1 works before the shuffle too, so large groups of copies don't move
    one = rows.select("text", *_TEXT_KEY).withColumn("r", F.row_number().over(Window.partitionBy(*_TEXT_KEY).orderBy(F.lit(1)))).filter("r = 1").drop("r")
    found = written(repeated_stretches(one, weights, wanted, window), "stretches")
    contents = found.groupBy("key", "content").agg(F.sum("weight").alias("weight"), F.first("symbols").alias("symbols"))
    symbols = found.agg(F.sum(F.length("symbols"))).first()[0] or 0
    parts = repeated_parts(contents, max(n, int(symbols // 8 // SHARD)), window)
    where = found.select("key", "content", *_TEXT_KEY, "first").join(parts, ["key", "content"])
    spans = where.select(*_TEXT_KEY, F.explode(F.transform("parts", lambda p: F.struct((p.a + F.col("first")).alias("a"), (p.b + F.col("first")).alias("b")))).alias("span"))
    return spans.groupBy(*_TEXT_KEY).agg(F.collect_set("span").alias("spans"))


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, common: int = COMMON) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined by a space; only with_text) of every row.

    Null and empty texts have no words; texts shorter than a window keep all. A text that occurs twice repeats itself, so all its
    windows go from both. Rows that repeat an id are rows of their own.
    """
    rows, spans = _rows_of(docs, id_col, text_col), repeated_spans(docs, window, id_col, text_col, common)

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, parts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = text.as_py().encode().split()
                kept = words
                if parts:
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    for p in parts:
                        gone[p["a"]] += 1
                        gone[p["b"]] -= 1
                    kept = list(itertools.compress(words, np.cumsum(gone[:-1]) == 0))
                line = b" ".join(kept)
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(line).hexdigest(), line.decode() if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    joined = rows.join(spans, list(_TEXT_KEY), "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    made = joined.mapInArrow(W.settled(run), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return made if with_text else made.drop("kept")


def cleaned(docs: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with texts that hold no repeated window any more; texts that lose nothing, nulls among them, stay as they are.

    Repeated rows are rows of their own; an empty table gives an empty result. Columns may have any names.
    """
    h1, h2, spans_ = free_names(docs, "h1", "h2", "spans")
    spans = repeated_spans(docs, window, docs.columns[0], text_col).withColumnsRenamed({"h1": h1, "h2": h2, "spans": spans_})
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    joined = docs.join(spans, (F.xxhash64(text) == F.col(h1)) & (F.hash(text) == F.col(h2)), "left").select(*(f"`{c}`" for c in docs.columns), spans_)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            out = []
            for text, parts in zip(batch.column(place).to_pylist(), batch.column(len(docs_names)).to_pylist()):
                if parts and text is not None:
                    words = text.encode().split()
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    for p in parts:
                        gone[p["a"]] += 1
                        gone[p["b"]] -= 1
                    text = b" ".join(itertools.compress(words, np.cumsum(gone[:-1]) == 0)).decode()
                out.append(text)
            columns = list(batch.columns[: len(docs_names)])
            columns[place] = pa.array(out, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = docs.columns
    return joined.mapInArrow(W.settled(run), docs.schema)


def op10_substring(spark, sf_dir):
    """What is left of every document without repeated windows of 35 words."""
    from .store import table

    return without_repeats(table(spark, sf_dir, "documents"), with_text=False)
