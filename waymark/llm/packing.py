"""Bulk-synchronous best-fit packing of token sequences.

Documents are cut into pieces of at most the capacity. Full pieces are sequences of their own; all others are packed in rounds, each over all pieces that are
left and all gaps of opened sequences:

- pieces and gaps are sorted by range of size; a range is one task's share of rows, and a size with more rows than that is split by a hash;
- each task sweeps its range upwards: a gap takes the longest piece below it that no tighter gap took (pieces and gaps match like brackets), and what is left of the gap goes on
  to take pieces of the range while it can;
- pieces that found no gap in their range go on to the gaps that are left in the next ranges above, again like brackets: this needs the numbers of pieces and
  gaps left per range only. Who gets which gap goes by rank: the longest pieces of a range get its nearest gaps, as many for each gap as surely fit;
- gaps shrink by what they took, and the next round begins. Where no gap holds the longest pieces, as many new sequences are
  opened as their tokens fill.

Each round is a shuffle by range and one by gap; written tables carry pieces and gaps from round to round.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import free_names, written
from .words import settled

CAPACITY = 1024
END_ID = 2
#: Pieces and gaps that a range is meant to hold.
RANGE_ROWS = 20_000
#: Texts that go to the tokenizer at once.
ENCODED = 64

_PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
_coders: dict = {}


def coder(vocabulary: str, ranks: str | None = None):
    """Texts -> lists of ids, by the tokenizers file `vocabulary` as it is, its added tokens included.

    ranks: a file of the same byte-pair vocabulary as ranks. Texts that hold no added token are then encoded from it, which is several times as fast and gives the same
    ids; the two files are compared, and a difference is an error.
    """
    if (vocabulary, ranks) not in _coders:
        _coders[vocabulary, ranks] = _by_file(vocabulary) if ranks is None else _by_ranks(vocabulary, ranks)
    return _coders[vocabulary, ranks]


def _by_file(vocabulary: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    return lambda texts: [x.ids for x in whole.encode_batch_fast(texts, add_special_tokens=False)]


def _by_ranks(vocabulary: str, ranks: str):
    import base64
    import json
    import re

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(vocabulary) as f:
        known = json.load(f)
    # byte-level vocabularies write a byte as one printable character: itself, or, for those that don't print, the next free one from 256 on
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = dict(zip(map(chr, [*prints, *range(256, 512 - len(prints))]), [*prints, *(b for b in range(256) if b not in set(prints))]))
    added = {t["content"] for t in known["added_tokens"]}
    if {bytes(letters[c] for c in t): i for t, i in known["model"]["vocab"].items() if t not in added} != own:
        raise ValueError(f"{ranks} is another vocabulary than {vocabulary}")
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={}).encode_ordinary
    holds = re.compile("|".join(map(re.escape, added)) or "(?!)").search

    def encode(texts: list[str]) -> list[list[int]]:
        rest = [i for i, t in enumerate(texts) if holds(t)]
        out = [None if i in set(rest) else fast(t) for i, t in enumerate(texts)] if rest else [fast(t) for t in texts]
        # the tokenizers file takes much memory: it is read where a text needs it
        for i, ids in zip(rest, coder(vocabulary)([texts[i] for i in rest]) if rest else ()):
            out[i] = ids
        return out

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of full length but the first, which may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every piece of every document.

    Null and empty texts are one piece that holds the end id alone. Repeated rows and null ids are documents of their own; further columns are left out; an empty
    table has no pieces.
    """
    schema = T.StructType([*_PIECES, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches):
        encode = coder(vocabulary, ranks)
        for batch in batches:
            rows: list[tuple] = []
            for i in range(0, batch.num_rows, ENCODED):
                docs_, texts = (c.slice(i, ENCODED).to_pylist() for c in batch.columns)
                for doc, own_ids in zip(docs_, encode([t or "" for t in texts])):
                    ids = np.array([*own_ids, end_id], dtype="<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + length]
                        rows.append((doc, k, start, length, zlib.crc32(own.tobytes()), *([own.astype(np.int32)] if with_ids else [])))
                if len(rows) >= 20_000:
                    yield _batch(rows, with_ids)
                    rows = []
            if rows:
                yield _batch(rows, with_ids)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(settled(run), schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + with_ids]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])


@dataclass(frozen=True)
class Ranges:
    """The range of each size: of rows of a size s, a hash modulo split[s] counts up from first[s]."""

    first: tuple[int, ...]
    split: tuple[int, ...]
    count: int


def ranges(rows: dict[int, int], capacity: int, most: int = RANGE_ROWS) -> Ranges:
    """Ranges of about `most` rows, for the number of rows of each size: neighbouring sizes share one, a size with more rows gets several."""
    first, split, at, held = [0] * (capacity + 1), [1] * (capacity + 1), 0, 0
    for size in range(capacity + 1):
        n = rows.get(size, 0)
        if held and held + n > most:
            at, held = at + 1, 0
        first[size], split[size] = at, max(1, -(-n // most))
        if split[size] > 1:
            at, n = at + split[size], 0
        held += n
    return Ranges(tuple(first), tuple(split), at + (held > 0) if held or at else 1)


def sweep(lengths: list[int], gaps: list[int], capacity: int, opens: bool = False) -> tuple[list[tuple[int, int, int]], list[int], list[int]]:
    """Matches sorted lengths with sorted gaps: (piece, gap, what the gap had left before) of all matches, the pieces left, and what each gap has left.

    opens: no other range has gaps for what is left, so sequences are opened until nothing is; they follow the given gaps.
    """
    found: list[tuple[int, int, int]] = []
    left, room = list(range(len(lengths))), list(gaps)
    live = sorted(range(len(gaps)), key=lambda g: room[g])
    while True:
        while live and left:
            stack: list[int] = []
            at, took, kept = 0, [], []
            for g in live:
                while at < len(left) and lengths[left[at]] <= room[g]:
                    stack.append(left[at])
                    at += 1
                if stack:
                    piece = stack.pop()
                    found.append((piece, g, room[g]))
                    room[g] -= lengths[piece]
                    took.append(g)
            kept = stack + left[at:]
            left = kept
            live = sorted((g for g in took if left and room[g] >= lengths[left[0]]), key=lambda g: room[g])
        if not (opens and left):
            return found, left, room
        new = -(-sum(lengths[i] for i in left) // capacity)
        live = list(range(len(room), len(room) + new))
        room += [capacity] * new


def exchange(left: list[tuple[int, int, int, int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Flows between ranges: (range of pieces, first rank, number, pieces a gap, range of gaps, first rank of gaps, number of gaps).

    left: (range, pieces left, longest of them, gaps left, least of them) by range. Pieces are ranked from the longest, gaps from the least.
    """
    out, stack = [], []  # the stack has (range, rank of the next piece, pieces, longest)
    for number, pieces_, longest, gaps, least in sorted(left):
        rank = 0
        while rank < gaps and stack:
            below, piece, n, long_ = stack.pop()
            each = max(1, least // long_)
            use = min(gaps - rank, -(-n // each))
            take = min(n, use * each)
            out.append((below, piece, take, each, number, rank, use))
            rank += use
            if take < n:
                stack.append((below, piece + take, n - take, long_))
        if pieces_:
            stack.append((number, 0, pieces_, longest))
    return out


PIECE, GAP, PLACED = 0, 1, 2
_STATE = "what int, id long, size int, range int, rank long, sequence long, offset int"


def pack(items: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """items, all columns, with sequence_id and offset; length is 1 to capacity.

    Every row is placed, repeated rows and rows with null ids too; ties go by the order in which rows were written. An empty table gives an empty result. Columns of
    items that are called sequence_id or offset give way to the new ones. Driver: a row per size and per range.
    """
    spark = items.sparkSession
    (item,) = free_names(items, "item")
    rows = written(items.drop("sequence_id", "offset").withColumn(item, F.monotonically_increasing_id()), "pieces")
    short = rows.filter(F.col("length") < capacity).select(F.lit(PIECE).alias("what"), F.col(item).alias("id"), F.col("length").cast("int").alias("size"))
    state = short.select("*", F.lit(0).alias("range"), F.lit(0).cast("long").alias("rank"), F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("int").alias("offset"))
    full = rows.filter(F.col("length") >= capacity).select(F.col(item).alias("id"), (-1 - F.col(item)).alias("sequence"), F.lit(0).alias("offset"))
    placed, opened = [full], 0
    while True:
        counts: dict[int, dict[int, int]] = {PIECE: {}, GAP: {}}
        for r in state.groupBy("what", "size").agg(F.count("*").alias("n")).collect():  # two rows a size
            counts[r.what][r.size] = r.n
        if not counts[PIECE]:
            break
        smallest, largest = min(counts[PIECE]), max(counts[GAP], default=0)
        stuck = sum(s * n for s, n in counts[PIECE].items() if s > largest)
        new = -(-stuck // capacity)
        if new:
            begun = spark.range(opened, opened + new).select(F.lit(GAP).alias("what"), "id", F.lit(capacity).alias("size"), F.lit(0).alias("range"), F.lit(0).cast("long").alias("rank"), F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("int").alias("offset"))
            state, opened = state.unionByName(begun), opened + new
            counts[GAP][capacity] = new
        sizes = {s: counts[PIECE].get(s, 0) + (counts[GAP].get(s, 0) if s >= smallest else 0) for s in range(capacity + 1)}
        cut_ = ranges(sizes, capacity, range_rows)
        swept = written(_swept(state.filter((F.col("what") == PIECE) | (F.col("size") >= smallest)), cut_, capacity, opened), "swept")
        placed.append(swept.filter(F.col("what") == PLACED).select("id", "sequence", "offset"))
        if cut_.count == 1:
            break  # the only task has placed all
        state = swept.filter(F.col("what") != PLACED)
        ends = state.filter(F.col("range") >= 0).groupBy("range", "what").agg(F.count("*").alias("n"), F.max("size").alias("most"), F.min("size").alias("least")).collect()  # two rows a range
        by: dict[int, list[int]] = {}
        for r in ends:
            own = by.setdefault(r["range"], [0, 0, 0, 0])
            own[2 * r.what : 2 * r.what + 2] = (r.n, r.least if r.what == GAP else r.most)
        flows = exchange([(k, *v) for k, v in by.items()], capacity)
        if flows:
            state = written(_exchanged(state, flows, capacity), "exchanged")
            placed.append(state.filter(F.col("what") == PLACED).select("id", "sequence", "offset"))
            state = state.filter(F.col("what") != PLACED)
    every = placed[0]
    for more in placed[1:]:
        every = every.unionByName(more)
    found = every.select(F.col("id").alias(item), F.col("sequence").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
    return rows.join(found, item).drop(item)


def _swept(state: DataFrame, cut_: Ranges, capacity: int, opened: int) -> DataFrame:
    """One sweep: pieces and gaps that are left, with their range and rank, and pieces placed. Gaps that took something have no range: they wait for the next round."""
    spark, alone = state.sparkSession, cut_.count == 1
    table = spark.createDataFrame([(s, a, n) for s, (a, n) in enumerate(zip(cut_.first, cut_.split))], "size int, first int, split int")
    dealt = state.select("what", "id", "size").join(F.broadcast(table), "size").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("split"))).cast("int").alias("range"), "what", "size", "id")  # capacity + 1 rows

    def one(number: int, what: np.ndarray, size: np.ndarray, ids: np.ndarray):
        pieces_, gaps = np.flatnonzero(what == PIECE), np.flatnonzero(what == GAP)
        lengths, rooms = size[pieces_].tolist(), size[gaps].tolist()
        found, left, room = sweep(lengths, rooms, capacity, alone)
        names = ids[gaps].tolist() + list(range(opened, opened + len(room) - len(rooms)))
        took = {g for _, g, _ in found}
        out = [(PLACED, int(ids[pieces_[p]]), lengths[p], -1, 0, names[g], capacity - had) for p, g, had in found]
        if not alone:
            out += [(PIECE, int(ids[pieces_[p]]), lengths[p], number, rank, None, None) for rank, p in enumerate(reversed(left))]
            out += [(GAP, names[g], room[g], -1, 0, None, None) for g in took if room[g]]
            out += [(GAP, names[g], room[g], number, rank, None, None) for rank, g in enumerate(g for g in range(len(room)) if g not in took)]
        for i in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out[i : i + 50_000]), _KINDS)], names=[n for n, _ in _KINDS])

    def run(batches):
        held: list[pa.RecordBatch] = []
        number = None
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if a == b:
                    continue
                if at[a] != number and held:
                    yield from flush(number, held)
                    held = []
                number = int(at[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush(number, held)

    def flush(number, held):
        yield from one(number, *(np.concatenate([h.column(c).to_numpy(zero_copy_only=False) for h in held]) for c in (1, 2, 3)))

    return dealt.repartition(cut_.count, "range").sortWithinPartitions("range", "size", "what", "id").mapInArrow(settled(run), _STATE)


_KINDS = [("what", pa.int32()), ("id", pa.int64()), ("size", pa.int32()), ("range", pa.int32()), ("rank", pa.int64()), ("sequence", pa.int64()), ("offset", pa.int32())]


def _exchanged(state: DataFrame, flows: list[tuple], capacity: int) -> DataFrame:
    """The pieces and gaps left by a sweep after pieces went to the gaps of other ranges, and the pieces placed so."""
    spark = state.sparkSession
    table = spark.createDataFrame(flows, "of int, piece long, n long, each long, to int, gap long, gaps long")  # two flows a range at most
    pieces_, gaps = state.filter((F.col("what") == PIECE)), state.filter((F.col("what") == GAP))
    here = (F.col("range") == F.col("of")) & (F.col("rank") >= F.col("piece")) & (F.col("rank") < F.col("piece") + F.col("n"))
    nth = F.col("rank") - F.col("piece")
    sent = pieces_.join(table, here, "left").select("what", "id", "size", F.coalesce("to", F.lit(-1)).alias("range"), F.when(F.col("to").isNull(), F.lit(-1 - F.col("id"))).otherwise(F.col("gap") + F.floor(nth / F.col("each"))).alias("rank"), (nth % F.col("each")).alias("nth"))
    # a gap and the pieces sent to it meet by the gap's range and rank; what stays alone keeps a key of its own
    meet = sent.unionByName(gaps.select("what", "id", "size", "range", F.when(F.col("range") < 0, F.lit(-1 - F.col("id"))).otherwise(F.col("rank")).alias("rank"), F.lit(-1).cast("long").alias("nth")))
    key = ["range", "rank", F.when(F.col("range") < 0, F.col("what")).otherwise(GAP).alias("kind")]
    meet = meet.select("what", "id", "size", "nth", *key)
    of = Window.partitionBy("range", "rank", "kind")
    before = F.sum(F.when(F.col("what") == PIECE, F.col("size"))).over(of.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    met = meet.select("*", F.coalesce(before, F.lit(0)).alias("before"), F.sum(F.when(F.col("what") == PIECE, F.col("size"))).over(of).alias("total"), F.max(F.when(F.col("what") == GAP, F.col("id"))).over(of).alias("sequence"), F.max(F.when(F.col("what") == GAP, F.col("size"))).over(of).alias("room"))
    lands = (F.col("what") == PIECE) & F.col("sequence").isNotNull()
    return met.select(
        F.when(lands, F.lit(PLACED)).otherwise(F.col("what")).alias("what"), "id", F.when(F.col("what") == GAP, F.col("size") - F.coalesce("total", F.lit(0))).otherwise(F.col("size")).cast("int").alias("size"), F.lit(0).alias("range"), F.lit(0).cast("long").alias("rank"),
        F.when(lands, F.col("sequence")).alias("sequence"), F.when(lands, F.lit(capacity) - F.col("room") + F.col("before")).cast("int").alias("offset"),
    )


def op3_packing(spark, sf_dir):
    """All documents as token pieces in sequences of 1024 tokens."""
    import public_tokenizers

    from .store import table

    path = public_tokenizers.path
    return pack(pieces(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), ranks=path("byte_bpe_50k.tiktoken")))
