"""Mixing sources to target weights by blocks.

Each source's words, document after document, form one stream that is cut into blocks of a fixed number of words (BLOCK; fewer for
sources of few words, so that a block is at most a FINE-th of its source). Output shards have a fixed number of slots; how many
slots of a shard a source fills is a multinomial draw that depends on the shard's number alone, so shards are drawn where they are
made, in Spark. A source's slots are numbered through all shards; those over its quota are left out, and what all draws together
lack of it comes in one shard more. A pseudorandom permutation of the source's block numbers says which block a slot takes: slot
j takes block perm(j mod blocks), so a source is read again only when all of it has been read. Blocks and slots are
joined by (source, block).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import free_names, written
from .words import chunks, places, settled

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 32
#: Blocks of a source at least, if it has so many words.
FINE = 256
SHARD_SLOTS = 8192
#: Shards whose slots are numbered together.
RUN = 1024
#: Documents that one part of a source's stream is meant to hold, and parts at least.
PART_ROWS = 50_000
LEAST_PARTS = 64


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words that the mix takes of each source. Sources by code point, null last; an excess over `most` times a source's size is shared by weight among the others until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, free = {}, share * sum(sizes.values()), list(names)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
        left = max(0.0, left - sum(out[s] for s in over))
        free = [s for s in free if s not in over]
    return out


def drawn(shard: int, quota: list[int], shard_slots: int, seed: int) -> list[int]:
    """Slots of each source in an output shard: a multinomial draw whose chances are the quotas."""
    return np.random.default_rng([seed, shard]).multinomial(shard_slots, np.array(quota) / sum(quota)).tolist()


#: Fixed primes over 2^20, of which a permutation takes those prime to its range.
_PRIMES = (1048583, 1048589, 1048601, 1048609, 1048613, 1048627)


def permutation(n: int, key: int, rounds: int = 3) -> list[tuple[int, int]]:
    """(shift, multiplier) of each round of a pseudorandom permutation of 0 to n - 1."""
    rng = np.random.default_rng([key, n])
    fit = [p for p in _PRIMES if n % p]
    return [(int(rng.integers(n)), int(rng.choice(fit))) for _ in range(rounds)]


def permuted(i: Column, n: Column, rounds: list[tuple[Column, Column]]) -> Column:
    """i, below n, under a permutation: each round is an affine map modulo n, and between two rounds even and odd numbers are set apart."""
    for r, (shift, times) in enumerate(rounds):
        i = (i + shift) * times % n
        if r + 1 < len(rounds):
            i = F.shiftright(i, 1) + i.bitwiseAND(1) * F.shiftright(n + 1, 1)
    return i


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size in words (null text: 0) and the salt in whose order a source's stream runs."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), text.alias("text"), F.xxhash64(text).alias("tie"))

    # a regular expression makes strings of all words: the JVM then takes all the memory it may
    def run(batches):
        for batch in batches:
            size = np.zeros(batch.num_rows, dtype=np.int64)
            for i, j, off, data in chunks(batch.column(2)):
                size[i:j] = np.diff(places(off, data)[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), batch.column(3)], names=["doc_id", "source", "size", "tie"])

    kinds = T.StructType([rows.schema["doc_id"], rows.schema["source"], T.StructField("size", T.LongType()), rows.schema["tie"]])
    return rows.mapInArrow(settled(run), kinds).withColumn("salt", F.xxhash64("doc_id", "tie"))


def source_table(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[dict]:
    """name, size, target, words of a block, blocks, quota (slots) and parts of each source; there are as many rows as sources."""
    got = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sizes, documents = {r.source: int(r.size) for r in got}, {r.source: r.n for r in got}
    out = []
    for name, target in targets(sizes, weights, share, most).items():
        width = max(1, min(BLOCK, sizes[name] // FINE))
        blocks = -(-sizes[name] // width)
        mean = sizes[name] / blocks if blocks else 1
        parts = max(LEAST_PARTS, -(-documents[name] // PART_ROWS))
        out.append({"source": name, "sid": len(out), "source_size": sizes[name], "target": float(target), "width": width, "blocks": blocks, "quota": min(int(most) * blocks, round(target / mean)), "parts": parts})
    return out


def slots(spark, sources: list[dict], seed: int = 17, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, sid, slot (the source's own number) and block of every slot of the mix."""
    live = [s for s in sources if s["quota"]]
    quota, sids = [s["quota"] for s in live], [s["sid"] for s in live]
    shards = -(-sum(quota) // shard_slots) if live else 0

    def draw(batches):
        for batch in batches:
            got = [(k, sid, n) for k in batch.column(0).to_pylist() for sid, n in zip(sids, drawn(k, quota, shard_slots, seed)) if n]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got) if got else ([], [], []), (pa.int64(), pa.int32(), pa.int64()))], names=["shard", "sid", "n"])

    parts = max(8, spark.sparkContext.defaultParallelism)
    runs = spark.range(0, shards, 1, parts).mapInArrow(draw, "shard long, sid int, n long").withColumn("run", F.floor(F.col("shard") / RUN))
    # slots before a shard: those of earlier runs of shards, and of earlier shards of its run
    sums = runs.groupBy("sid", "run").agg(F.sum("n").alias("n"))
    earlier = lambda *key: F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("run" if len(key) == 1 else "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select("sid", "run", earlier("sid").alias("base"))
    placed = runs.withColumn("before", earlier("sid", "run")).join(base, ["sid", "run"]).select("shard", "sid", (F.col("base") + F.col("before")).alias("first"), "n")
    perms = [[x for pair in permutation(s["blocks"], seed * 1_000_003 + s["sid"], 2) for x in pair] for s in live]
    known = spark.createDataFrame([(s["sid"], s["quota"], s["blocks"], *p) for s, p in zip(live, perms)], "sid int, quota long, blocks long, s0 long, m0 long, s1 long, m1 long")
    lack = known.join(sums.groupBy("sid").agg(F.sum("n").alias("n")), "sid", "left").select(F.lit(shards).cast("long").alias("shard"), "sid", F.coalesce("n", F.lit(0)).alias("first"), (F.col("quota") - F.coalesce("n", F.lit(0))).alias("n"))
    rows = placed.unionByName(lack).join(F.broadcast(known), "sid").withColumn("end", F.least(F.col("first") + F.col("n"), F.col("quota"))).filter("end > first")
    slot = rows.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("end") - 1)))
    block = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), [(F.col("s0"), F.col("m0")), (F.col("s1"), F.col("m1"))])
    return slot.select("shard", "sid", "slot", block.alias("block"))


def blocks(rows: DataFrame, sources: list[dict]) -> DataFrame:
    """doc_id, tie, sid, block, first word and number of words of each document's part in each block of its source."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(s["source"], s["sid"], s["width"], s["parts"]) for s in sources], "source string, sid int, width int, parts long")
    keyed = rows.join(F.broadcast(names), rows.source.eqNullSafe(names.source)).select("doc_id", "tie", "size", "sid", "width", F.pmod(F.col("salt"), F.col("parts")).alias("salt"))
    sums = keyed.groupBy("sid", "salt").agg(F.sum("size").alias("n"))
    base = sums.select("sid", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("sid", "salt").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = keyed.withColumn("before", before).join(base, ["sid", "salt"]).withColumn("at", F.col("base") + F.col("before")).filter("size > 0")
    part = placed.select("doc_id", "tie", "sid", "size", "width", "at", F.explode(F.sequence(F.floor(F.col("at") / F.col("width")), F.floor((F.col("at") + F.col("size") - 1) / F.col("width")))).alias("block"))
    first = F.greatest(F.col("block") * F.col("width") - F.col("at"), F.lit(0))
    last = F.least((F.col("block") + 1) * F.col("width") - F.col("at"), F.col("size"))
    return part.select("doc_id", "tie", "sid", "block", first.alias("first_word"), (last - first).alias("n_words"))


def mix(rows: DataFrame, sources: list[dict], seed: int = 17) -> DataFrame:
    """The mix: shard, slot, sid, block, doc_id, tie, first_word, n_words of every part that it takes.

    rows: sized(), as a written table. Texts without words take no part; repeated rows are rows of their own; an empty
    table gives an empty mix. No block is taken more often than `most` times, so no document either.
    """
    # both sides grow with the input: never broadcast, though the planner takes the slots, made of short runs, for few
    return blocks(rows, sources).join(slots(rows.sparkSession, sources, seed).hint("merge"), ["sid", "block"])


def taken(rows: DataFrame, sources: list[dict], seed: int = 17) -> DataFrame:
    """rows with what the mix takes of each; rows alike in id, text and source share it, the remainder going to the first."""
    info = rows.sparkSession.createDataFrame([(s["source"], s["sid"], s["source_size"], s["target"]) for s in sources], "name string, sid int, source_size long, target double")
    took = mix(rows, sources, seed).groupBy("doc_id", "tie", "sid").agg(F.sum("n_words").alias("words")).withColumnsRenamed({"doc_id": "d", "tie": "t", "sid": "s"})
    alike = Window.partitionBy("doc_id", "tie", "sid")
    named = rows.join(F.broadcast(info), rows.source.eqNullSafe(info.name))
    named = named.withColumn("alike", F.count("*").over(alike)).withColumn("nth", F.row_number().over(alike.orderBy("size")))
    out = named.join(took, named.doc_id.eqNullSafe(took.d) & (named.tie == took.t) & (named.sid == took.s), "left")
    words = F.coalesce("words", F.lit(0).cast("long"))
    share = F.floor(words / F.col("alike")) + (F.col("nth") <= words % F.col("alike")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", share.cast("long").alias("taken"))


def mixed(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them, all columns: a row per document with the words of the blocks taken, and a second one with those taken twice.

    Null and empty texts have no words and don't appear; of rows alike in id, text and source each gets its share; an empty table gives an empty mix.
    Columns may have any names.
    """
    d_, t_, s_, parts_, alike_ = free_names(docs, "d", "t", "s", "parts", "alike")
    rows = written(sized(docs, id_col, text_col, source_col), "mix_sizes")
    sources = source_table(rows)
    names = docs.sparkSession.createDataFrame([(s["source"], s["sid"]) for s in sources], "name string, sid int")
    alike = rows.groupBy("doc_id", "tie", "source").agg(F.count("*").alias("alike"))
    # parts of rows alike lie one after another; each such row gets the parts of its own words, modulo the size
    part = mix(rows, sources, seed).groupBy("doc_id", "tie", "sid", "first_word", "n_words").agg(F.count("*").alias("times"))
    parts = part.groupBy("doc_id", "tie", "sid").agg(F.collect_list(F.struct("first_word", "n_words", "times")).alias(parts_))
    keyed = parts.join(F.broadcast(names), "sid").join(alike.withColumnsRenamed({"doc_id": "d", "tie": "t", "source": "s"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")) & F.col("name").eqNullSafe(F.col("s")))
    keyed = keyed.select(F.col("d").alias(d_), F.col("t").alias(t_), F.col("s").alias(s_), parts_, F.col("alike").alias(alike_))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    mine = docs.join(keyed, F.col(f"`{id_col}`").eqNullSafe(F.col(d_)) & (F.xxhash64(text) == F.col(t_)) & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(s_)))
    columns, place = docs.columns, docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            rows_, texts = [], []
            for i, (text, taken_, n) in enumerate(zip(batch.column(place).to_pylist(), *(batch.column(len(columns) + j).to_pylist() for j in (0, 1)))):
                words = text.encode().split()
                times = np.zeros(len(words), dtype=np.int64)
                for p in taken_:
                    times[p["first_word"] : p["first_word"] + p["n_words"]] += p["times"]
                for level in range(int(times.max(initial=0)) if n == 1 else -(-int(times.max(initial=0)) // n)):
                    take = times > level * n
                    rows_.append(i)
                    texts.append(text if take.all() else b" ".join(w for w, t in zip(words, take.tolist()) if t).decode())
            own = [c.take(pa.array(rows_, pa.int64())) for c in batch.columns[: len(columns)]]
            own[place] = pa.array(texts, own[place].type)
            yield pa.RecordBatch.from_arrays(own, names=columns)

    return mine.select(*(f"`{c}`" for c in columns), parts_, alike_).mapInArrow(settled(run), docs.schema)


def op7_mixing(spark, sf_dir):
    """Words that the mix takes of each document."""
    from .store import table

    rows = written(sized(table(spark, sf_dir, "documents")), "mix_sizes")
    return taken(rows, source_table(rows))
