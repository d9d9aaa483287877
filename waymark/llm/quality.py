"""Quality classifier: supervised subword embeddings.

A text's vector is the mean of learned vectors of hashed features: its words, their character 3- to 5-grams, word ends
included, and one feature that all pairs of equal neighbouring words share. A text's score depends on nothing but the text. NEUTRAL further features without a vector keep the
means of very short texts small. A softmax layer gives the label. Both are trained by numpy stochastic gradient descent on a bounded sample of
labelled rows (SAMPLE texts of at most LONGEST bytes, the first by a hash of their id).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import _BLANK, hashes, places, settled, string_buffers

SAMPLE = 4_000
LONGEST = 20_000
BITS = 17
DIM = 16
GRAMS = (3, 4, 5)
NEUTRAL = 16
#: Texts are read in spans of this many bytes, cut between words.
SPAN = 1 << 18
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: The feature of a word that repeats the one before it.
REPEATED = 1


def features(data: bytes, bits: int = BITS, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of UTF-8 text, which must begin and end between words: position of each, in code points, and bucket.

    breaks: positions where a text of its own begins; words on both sides of one are no pair.
    """
    chars = np.frombuffer((b" " + data + b" ").decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    blank = (chars < 33) & _BLANK[np.minimum(chars, 255)]
    c = np.where(blank, np.uint32(32), chars).astype(np.uint64)
    run = np.concatenate([[0], np.cumsum(blank)])
    where, bucket = [], []
    shift = np.uint64(64 - bits)
    h = c
    for n in range(2, GRAMS[-1] + 1):
        h = h[: len(c) - n + 1] * _B + c[n - 1 :]
        if n in GRAMS:
            ok = np.flatnonzero(run[n - 1 : len(c)] == run[1 : len(c) - n + 2])  # no blank but at the ends
            where.append(ok)
            bucket.append((h[ok] ^ np.uint64(n)) * _A >> shift)
    raw = np.frombuffer(data, dtype=np.uint8)
    starts, ends, _ = places(np.array([0, len(raw)]), raw)
    if len(starts):
        at, word = np.flatnonzero(~blank[1:] & blank[:-1]) + 1, hashes(raw, starts, ends)
        where.append(at)
        bucket.append(word * _A >> shift)
        pair = np.flatnonzero(word[1:] == word[:-1]) + 1
        if breaks is not None:
            text = np.searchsorted(breaks, at, side="right")
            pair = pair[text[pair] == text[pair - 1]]
        where.append(at[pair])
        bucket.append(np.full(len(pair), REPEATED, dtype=np.uint64))
    return np.concatenate(where), np.concatenate(bucket).astype(np.int64)


@dataclass
class Model:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def share(self) -> np.ndarray:
        """What each feature adds to the log odds of label 1, before it is divided by the number of features."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32)

    def odds(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(texts: list[bytes], labels: list[int], epochs: int = 8, rate: float = 2.0, seed: int = 5, bits: int = BITS, dim: int = DIM) -> Model:
    """Stochastic gradient descent, one text a step, with a falling rate. The bias is the log odds of the labels, so a text without features gets their frequency."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    output, bias = np.zeros((dim, 2), dtype=np.float32), np.log(np.bincount(labels, minlength=2)[:2] + 1.0)
    bias = (bias - bias.mean()).astype(np.float32)
    bags = []
    for t in texts:
        ids, counts = np.unique(features(t, bits)[1].astype(np.int32), return_counts=True)
        bags.append((ids, counts.astype(np.float32)))
    step, steps = 0, max(1, epochs * len(bags))
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, counts = bags[i]
            if len(ids):
                weight = (counts / (counts.sum() + NEUTRAL)).astype(np.float32)
                now = rate * (1 - step / steps)
                mean = weight @ vectors[ids]
                z = mean @ output + bias
                p = np.exp(z - z.max())
                wrong = p / p.sum()
                wrong[labels[i]] -= 1
                back = output @ wrong
                output -= now * 0.25 * np.outer(mean, wrong)
                vectors[ids] -= now * 4 * np.outer(weight, back) * np.float32(len(ids) ** 0.5)
            step += 1
    return Model(vectors, output, bias)


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from; null ids are among them."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """A model of the first `sample` labelled rows, by a hash of the id, that are not held out.

    Labels other than 0 and 1 don't count, of several labels of an id the largest does. Without any labelled row every text scores 0.5.
    The driver holds `sample` texts of `longest` bytes at most.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    marks = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("label in (0, 1)").filter(~held_out(F.col("doc_id")))
    chosen = marks.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    got = rows.join(F.broadcast(chosen), "doc_id").filter(F.octet_length("text") <= longest).groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return train([r.text.encode() for r in got], [r.label for r in got])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row. Null and empty texts get the score of the bias alone; equal texts get equal scores.

    Repeated rows and null ids are rows of their own, an empty table gives an empty result. Texts of over SPAN bytes are read in parts
    that end between words; only a single word longer than that is cut, and its n-grams over the cut are left out.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _scored(rows, "text", model, threshold).drop("text")


def kept(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose texts score the threshold or more; further columns of any name stay as they are."""
    name = "predicted"
    while name in docs.columns or "score" + name in docs.columns:
        name += "_"
    return _scored(docs, text_col, model, threshold, "score" + name, name).filter(F.col(name) == 1).drop(name, "score" + name)


def _scored(rows: DataFrame, text_col: str, model: Model, threshold: float, score_name: str = "score", name: str = "predicted") -> DataFrame:
    share, odds = rows.sparkSession.sparkContext.broadcast(model.share()), model.odds()
    place = rows.columns.index(text_col)

    def run(batches):
        w = share.value
        for batch in batches:
            off, data = string_buffers(batch.column(place))
            off = off.tolist()
            total, count = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
            i = 0
            while i < len(total):
                j = i + 1
                while j < len(total) and off[j + 1] - off[i] <= SPAN:
                    j += 1
                if j == i + 1 and off[j] - off[i] > SPAN:  # a long text: in parts
                    last = b""
                    for part in _parts(data[off[i] : off[j]].tobytes(), SPAN):
                        _, bucket = features(part)
                        total[i] += w[bucket].sum(dtype=np.float64)
                        count[i] += len(bucket)
                        words = part.split()
                        if words and words[0] == last and part[:1].isspace():  # the pair over the seam
                            total[i] += w[REPEATED]
                            count[i] += 1
                        last = words[-1] if words else last
                else:
                    own = [data[off[k] : off[k + 1]].tobytes() for k in range(i, j)]
                    ends = np.cumsum([len(x) - _tails(x) + 1 for x in own])
                    where, bucket = features(b"\n".join(own), breaks=ends)
                    at = np.searchsorted(ends, where, side="right")
                    at = np.minimum(at, j - i - 1)
                    total[i:j] += np.bincount(at, weights=w[bucket], minlength=j - i)
                    count[i:j] += np.bincount(at, minlength=j - i)
                i = j
            z = np.clip(total / (count + NEUTRAL) + odds, -40, 40)
            s = np.round(1 / (1 + np.exp(-z)), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*batch.schema.names, score_name, name])

    return rows.mapInArrow(settled(run), T.StructType([*rows.schema, T.StructField(score_name, T.DoubleType()), T.StructField(name, T.IntegerType())]))


def _tails(x: bytes) -> int:
    """Bytes of UTF-8 that begin no character."""
    return int(np.count_nonzero((np.frombuffer(x, dtype=np.uint8) & 0xC0) == 0x80)) if not x.isascii() else 0


def _parts(data: bytes, span: int):
    """Spans of about `span` bytes that end between words, or, in a word longer than that, between characters."""
    a = 0
    while a < len(data):
        b = min(len(data), a + span)
        if b < len(data):
            cut = max(data.rfind(blank, a, b) for blank in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            b = cut if cut > a else b
            while b > a + 1 and b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
        yield data[a:b]
        a = b


def op1_quality(spark, sf_dir):
    """Score and prediction of every document."""
    from .store import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
