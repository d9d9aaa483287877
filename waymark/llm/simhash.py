"""SimHash fingerprints and near-duplicate search by the generalised pigeonhole principle.

Bits that go together are put in one part each (measured over all fingerprints); the parts get unequal thresholds, whose sum is
the distance less the number of parts plus one, by dynamic programming on estimated candidate counts. Two
fingerprints within the distance then agree, in some part, up to that part's threshold. Each part's values are probed by key, and pairs
are verified on the whole fingerprints where they meet. A bucket gives back a spanning set of its links, never all of
its pairs.
"""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import free_names, written
from .words import mix, settled

SEED = 42
#: Estimated cost of a probe row, in verified candidates.
PROBE_COST = 400.0
#: Fingerprints of one bucket are compared in tiles of this width, so that a bucket's pairs are never held at once.
BLOCK = 2_048
TILE = 256


def fingerprint(words: list[bytes], k: int, seeds: tuple[int, ...] = (SEED,)) -> list[int]:
    """64 majority bits per seed over the XXH64 of all k-word shingles, repeats included; 0 without words."""
    if not words:
        return [0] * len(seeds)
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    spans = [line[a:b] for a, b in zip(starts[: max(1, len(words) - k + 1)], ends[min(k, len(words)) - 1 :].tolist())]
    n = len(spans)
    out = []
    for seed in seeds:
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(x, seed) for x in spans], dtype=np.uint64)
        eight = h.view(np.uint8).reshape(-1, 8)
        bits = 0
        for byte in range(8):
            set_ = np.bincount(eight[:, byte], minlength=256) @ _BITS
            bits |= int(np.packbits(set_ * 2 > n, bitorder="little")[0]) << 8 * byte
        out.append(bits)
    return out


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """Sorted XXH64 of the distinct k-word shingles; texts of fewer words are one shingle, those without words have none."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + k]), SEED) for i in range(max(1, len(words) - k + 1))] if words else [], dtype=np.uint64))


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text", seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """doc_id, fps (array of signed longs, one per seed) and n_shingles of every row; a null text has no words."""

    def run(batches):
        for batch in batches:
            fps, sizes = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().lower().split()
                fps.append(np.array(fingerprint(words, k, seeds), dtype=np.uint64).view(np.int64))
                sizes.append(max(1, len(words) - k + 1) if words else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["doc_id", "fps", "n_shingles"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(settled(run), "doc_id long, fps array<long>, n_shingles long")


@dataclass(frozen=True)
class Plan:
    """parts: the bits of each part; limits: the distance allowed in it, -1 where it isn't probed."""

    parts: tuple[tuple[int, ...], ...]
    limits: tuple[int, ...]
    cost: float


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often each two bits are both set, over all fingerprints; only 64 x 64 sums leave a task."""

    def run(batches):
        total, rows = np.zeros((64, 64), dtype=np.int64), 0
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(x), 65_536):
                b = np.unpackbits(x[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (b.T @ b).astype(np.int64)
            rows += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([total.ravel()], pa.list_(pa.int64()))], names=["rows", "both"])

    parts = fps.mapInArrow(settled(run), "rows long, both array<long>")
    summed = parts.select("rows", F.posexplode("both")).groupBy("pos").agg(F.sum("rows").alias("rows"), F.sum("col").alias("n")).collect()  # 4096 rows
    both = np.zeros(4096, dtype=np.int64)
    for r in summed:
        both[r.pos] = r.n
    return (summed[0].rows if summed else 0), both.reshape(64, 64)


def grouped(rows: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of near equal number, each filled with the bits most correlated with those it has."""
    p = np.diag(both) / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, out = set(range(64)), []
    for i in range(parts):
        width = 64 * (i + 1) // parts - 64 * i // parts
        start = max(free, key=lambda b: (spread[b], -b))
        group = [start]
        free.remove(start)
        while len(group) < width:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def candidates(rows: int, both: np.ndarray, group: list[int], limit: int) -> list[float]:
    """Estimated pairs within distance 0 to `limit` in the bits of group: a pair differs in bit b with chance 2p(1-p)."""
    p = np.diag(both)[group] / max(rows, 1)
    chance = np.zeros(limit + 1)
    chance[0] = 1.0
    for q in 2 * p * (1 - p):
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return (np.cumsum(chance) * rows * rows / 2).tolist()


def allocated(rows: int, both: np.ndarray, distance: int, narrow: float = 1.0, most_probes: int = 2_000) -> Plan:
    """The cheapest division and thresholds; narrow: the share of pairs that other keys leave."""
    best = None
    for m in range(1, 13):
        total = distance - m + 1
        groups = grouped(rows, both, m)
        options = []
        for g in groups:
            est = candidates(rows, both, g, max(0, total + m))
            options.append([(-1, 0.0)] + [(t, rows * (1 + pr) * PROBE_COST + est[t] * narrow) for t in range(min(len(g), total + m) + 1) if (pr := sum(math.comb(len(g), i) for i in range(t + 1))) <= most_probes])
        reach = {0: (0.0, ())}
        for opts in options:  # sums of thresholds so far -> cheapest
            nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
            for (s, (c, chosen)), (t, extra) in itertools.product(reach.items(), opts):
                if s + t not in nxt or c + extra < nxt[s + t][0]:
                    nxt[s + t] = (c + extra, (*chosen, t))
            reach = nxt
        if total in reach and (best is None or reach[total][0] < best.cost):
            best = Plan(tuple(map(tuple, groups)), reach[total][1], reach[total][0])
    assert best is not None
    return best


def _part_value(x: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.uint64)
    for i, b in enumerate(bits):
        out |= (x >> np.uint64(b) & np.uint64(1)) << np.uint64(i)
    return out


def keys(x: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and whether it is a probe, for every key of every fingerprint: one own key per part and the values around it."""
    rows, values, probes = [], [], []
    n = np.arange(len(x))
    for part, (bits, limit) in enumerate(zip(plan.parts, plan.limits)):
        if limit < 0:
            continue
        own = _part_value(x, bits) | np.uint64(part) << np.uint64(58) if len(bits) <= 58 else _part_value(x, bits)
        for t in range(limit + 1):
            for flips in itertools.combinations(range(len(bits)), t):
                mask = np.uint64(sum(1 << f for f in flips))
                rows.append(n)
                values.append(own ^ mask)
                probes.append(np.full(len(x), t > 0))
    return (np.concatenate(rows), np.concatenate(values), np.concatenate(probes)) if rows else (n[:0], x[:0], n[:0] > 0)


class Links:
    """Union-find over the members of one bucket, kept as a growing array."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def tops(self) -> np.ndarray:
        """The root of every member."""
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def join(self, i: int, j: int) -> bool:
        a, b = self.top(i), self.top(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def bucket_links(fps: np.ndarray, probe: np.ndarray, sizes: np.ndarray, distance: int, ratio: float, wide_distance: int) -> list[tuple[int, int]]:
    """Links within a bucket that span its components, each from the first member to one other, so that buckets of the same members give the same links. fps: rows of 64-bit words, of which the first is indexed; two probes aren't compared, since their own keys meet elsewhere."""
    own = np.flatnonzero(~probe)
    near = np.flatnonzero(probe)
    links = Links(len(fps))
    for side, same in ((own, True), (near, False)):
        for a in range(0, len(side), TILE):
            left = side[a : a + TILE]
            for b in range(a // BLOCK * BLOCK if same else 0, len(own), BLOCK):
                right = own[b : b + BLOCK]
                ok = np.bitwise_count(fps[left, None, 0] ^ fps[None, right, 0]) <= distance
                i, j = np.nonzero(ok)
                i, j = left[i], right[j]
                keep = i < j if same else i != j
                if fps.shape[1] > 1:
                    keep &= np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1) <= wide_distance
                if ratio:
                    keep &= np.minimum(sizes[i], sizes[j]) >= ratio * np.maximum(sizes[i], sizes[j])
                if keep.any():
                    top = links.tops()
                    keep &= top[i] != top[j]
                    for x, y in zip(i[keep].tolist(), j[keep].tolist()):
                        links.join(x, y)
    top = links.tops()
    rest = np.flatnonzero(top != np.arange(len(top)))
    return list(zip(top[rest].tolist(), rest.tolist()))


def near_links(distinct: DataFrame, distance: int, words: int = 1, ratio: float = 0.0, wide_distance: int = 64, partitions: int | None = None) -> DataFrame:
    """Links (a, b) between node ids that span all components of `distance`.

    distinct: node (long), fps (array of `words` longs, of which the first is indexed), size (long), a written table of different fps and
    sizes. ratio: least quotient of sizes (0: any); then only nodes of neighbouring size bands meet.
    """
    spark = distinct.sparkSession
    rows, both = bit_counts(distinct.select(F.element_at("fps", 1).alias("fp")))
    plan = allocated(rows, both, distance, 0.2 if ratio else 1.0)
    step = math.log(1 / ratio) if ratio else 0.0

    def probe(batches):
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            fps = np.asarray(batch.column(1).flatten()).view(np.uint64).reshape(-1, words)
            size = batch.column(2).to_numpy(zero_copy_only=False)
            for i in range(0, len(node), 4_096):
                x, n, s = fps[i : i + 4_096], node[i : i + 4_096], size[i : i + 4_096]
                row, key, is_probe = keys(x[:, 0], plan)
                band = np.floor(np.log(np.maximum(s, 1)) / step).astype(np.int64) if ratio else np.zeros(len(s), np.int64)
                # an own key stands in its band; the text of the lower band also looks into the one above
                if ratio:
                    row, key = np.concatenate([row, row]), np.concatenate([mix(key) + (band[row] + d).astype(np.uint64) for d in (0, 1)])
                    is_probe = np.concatenate([is_probe, np.ones(len(is_probe), bool)])
                for a in range(0, len(row), 100_000):
                    r = row[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 100_000].view(np.int64)), pa.array(is_probe[a : a + 100_000]), pa.array(n[r]), pa.array(s[r]), pa.FixedSizeListArray.from_arrays(pa.array(x[r].ravel().view(np.int64)), words).cast(pa.list_(pa.int64()))], names=["key", "probe", "node", "size", "fps"])

    def meet(batches):
        carry = None
        for batch in itertools.chain(batches, [None]):
            now = carry if batch is None else (batch if carry is None else pa.concat_batches([carry, batch]))
            if now is None or not now.num_rows:
                continue
            key = now.column(0).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.diff(key)) + 1
            stop = len(key) if batch is None else (int(edge[-1]) if len(edge) else 0)  # the last bucket may go on in the next batch
            carry = None if batch is None else now.slice(stop)
            if not stop:
                continue
            starts = np.concatenate([[0], edge[edge < stop]])
            ends = np.concatenate([starts[1:], [stop]])
            probe_, node, size = (now.column(i).slice(0, stop).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            fps = np.asarray(now.column(4).slice(0, stop).flatten()).view(np.uint64).reshape(-1, words)
            owns = np.add.reduceat((~probe_).astype(np.int64), starts)
            out = []
            for s, e in zip(*(x[(owns > 0) & (ends - starts > 1)] for x in (starts, ends))):
                out += [(node[s + i], node[s + j]) for i, j in bucket_links(fps[s:e], probe_[s:e], size[s:e], distance, ratio, wide_distance)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12)
    probed = distinct.select("node", "fps", "size").mapInArrow(settled(probe), "key long, probe boolean, node long, size long, fps array<long>")
    return probed.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(settled(meet), "a long, b long").distinct()


def near_groups(prints: DataFrame, distance: int, words: int = 1, ratio: float = 0.0, wide_distance: int = 64) -> DataFrame:
    """prints (doc_id, fps, n_shingles; a written table) with component_id, the smallest doc_id of all that links reach.

    Rows with equal fingerprints are one node, so groups of copies of any size cost one row. Null ids get no component of
    their own choice: they take that of their group, or null where it holds no id.
    """
    key = ["fps"] + (["n_shingles"] if ratio else [])
    size = F.col("n_shingles") if ratio else F.lit(0).cast("long")
    nodes = written(prints.groupBy(*key).agg(F.min("doc_id").alias("least")).select("fps", size.alias("size"), "least", (F.element_at("fps", 1) if words == 1 and not ratio else F.xxhash64("fps", size)).alias("node")), "nodes")
    linked = components(near_links(nodes, distance, words, ratio, wide_distance))
    named = nodes.join(linked, "node", "left").select("fps", "size", "least", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("fps", "size", "component_id")
    mine = prints.withColumn("size", size)
    return mine.join(named, ["fps", "size"]).drop("size")


#: Shingle sets are alike where their Jaccard similarity is 4 / 5 or more.
ALIKE = (4, 5)
#: Fingerprints of a shingle set, each over the hashes mixed anew, and the distance within which one of them must find a candidate. At a
#: Jaccard similarity of 0.8 a pair differs in 9.8 of 64 bits on average (deviation 2.9), and in more than 14 with a chance of 0.055 at most, so it misses all five with 5e-7.
DEDUP_WORDS = 5
DEDUP_DISTANCE = 14


def set_fingerprints(shingles: np.ndarray, words: int = DEDUP_WORDS) -> np.ndarray:
    """For each word 64 majority bits over a set of shingle hashes; 0 for an empty set."""
    counts = np.zeros((words, 64), dtype=np.int64)
    for i in range(0, len(shingles), 65_280):
        x = shingles[i : i + 65_280]
        for word in range(words):
            bits = np.unpackbits(mix(x + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[word] += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(shingles), axis=1, bitorder="little").view(np.uint64).ravel()


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingle_prints(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t (hash of the text), node (hash of the set of k-word shingles), size (of that set) and fps of every row."""

    def run(batches):
        for batch in (whole.slice(i, 1_000) for whole in batches for i in range(0, whole.num_rows, 1_000)):
            nodes, sizes, fps = [], [], []
            for text in batch.column(2):
                own = shingles(_words(text.as_py()), k)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                fps.append(set_fingerprints(own).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "t", "node", "size", "fps"])

    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text")).mapInArrow(settled(run), "doc_id long, t long, node long, size long, fps array<long>")


def _runs(batches):
    """Batches of whole runs of equal values of the first column, by which the rows are sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(key, key[-1]))
        if last or held and held[0].column(0)[0].as_py() != key[0]:
            yield pa.concat_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.concat_batches(held)


def _bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys that have two rows or more."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    many = np.diff(edges) > 1
    return edges[:-1][many], edges[1:][many]


def candidate_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that span all components of candidates: nodes of which one fingerprint lies within DEDUP_DISTANCE and whose sizes allow a similarity of 0.8.

    Each of the fingerprints is divided, probed and verified on its own, as near_links() does it, and its links are written, so that the probes of one lie on the disks at a time.
    """
    filled = nodes.filter("size > 0")
    links = [written(near_links(filled.select("node", F.array(F.element_at("fps", word)).alias("fps"), "size"), DEDUP_DISTANCE, ratio=ALIKE[0] / ALIKE[1] - 1e-9), "links") for word in range(1, DEDUP_WORDS + 1)]
    # a text has a link in each of its buckets, whose first members differ: they are linked to the least of them instead
    least = functools.reduce(DataFrame.union, links).groupBy("b").agg(F.min("a").alias("least"), F.collect_set("a").alias("a"))
    return least.select(F.col("least").alias("a"), F.explode(F.concat("a", F.array("b"))).alias("b")).filter("a <> b").distinct()


def alike(sets: list[np.ndarray]) -> np.ndarray:
    """For each set of distinct values the first of all sets that links of a Jaccard similarity of ALIKE or more lead to."""
    sizes = np.array([len(x) for x in sets])
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(value, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(value))])
    at = np.concatenate([[0], np.cumsum(sizes)])
    links, left = Links(len(sets)), len(sets) - 1
    for i in range(len(sets)):
        own = value[at[i] : at[i + 1]]
        n = first[own + 1] - first[own]
        shared = np.bincount(holders[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        for j in np.flatnonzero(ALIKE[1] * shared >= ALIKE[0] * (sizes + sizes[i] - shared)).tolist():
            left -= links.join(i, j)
        if not left:
            break
    return links.tops()


def exact_groups(docs: DataFrame, nodes: DataFrame, k: int, text_col: str = "text") -> DataFrame:
    """node, group (one of its nodes) of the nodes that have candidates: components of links of 0.8 or more, measured on the shingle sets.

    The sets of one component of candidates meet in one task.
    """
    linked = components(candidate_links(nodes)).join(nodes.select("node", "t"), "node")
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(F.xxhash64(text).alias("t"), text.alias("text")).join(linked, "t").dropDuplicates(["node"])

    def verify(batches):
        for run in _runs(batches):
            node = run.column(1).to_numpy(zero_copy_only=False)
            for s, e in zip(*_bounds(run.column(0).to_numpy(zero_copy_only=False))):
                tops = alike([shingles(_words(x.as_py()), k) for x in run.column(2).slice(s, e - s)])
                yield pa.RecordBatch.from_arrays([pa.array(node[s:e]), pa.array(node[s:e][tops])], names=["node", "group"])

    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 12)
    return texts.select("component", "node", "text").repartition(n, "component").sortWithinPartitions("component").mapInArrow(settled(verify), "node long, group long")


def one_of_each(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without near-duplicates of k-word shingles: of each group the row of the smallest id stays.

    Groups are the components of links of a Jaccard similarity of 0.8 or more between sets of distinct shingles; the
    fingerprints find the candidates. Rows that repeat id and text are one. Texts without words are alike. Null ids stay only where
    their group has no other.
    """
    prints = shingle_prints(docs, k, id_col, text_col)
    nodes = written(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("t").alias("t"), *(F.first(c).alias(c) for c in ("size", "fps"))), "nodes")
    groups = nodes.select("node", "least").join(written(exact_groups(docs, nodes, k, text_col), "groups"), "node", "left")
    (name,) = free_names(docs, "stays")
    stays = groups.groupBy(F.coalesce("group", "node").alias("group")).agg(F.min("least").alias(name)).select(name).distinct()
    return docs.join(stays, F.col(f"`{id_col}`").eqNullSafe(F.col(name)), "left_semi").dropDuplicates([id_col, text_col])


def op2_simhash(spark, sf_dir):
    """Fingerprint and component of every document; links at 2 or fewer differing bits."""
    from .store import table

    prints = written(fingerprints(table(spark, sf_dir, "documents"), 3), "prints")
    found = near_groups(prints, 2)
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.element_at("fps", 1))), 16, "0").alias("fingerprint"), "component_id")
