"""The operators against brute force on small tables with nulls, ties, repeats and empty texts."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from waymark.llm import fingerprint, lm, mixing, nearest, packing, quality, sharding, simhash, substring, warc

TEXTS = [None, "", "a", " a  b\tc ", "A b c d e f", "a b c d e f", "x " * 50, "é è ü " * 9, "a b a b a b a b", "the cat sat on the mat and the dog sat on it"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(TEXTS * 3)] + [(None, "a b c", "s1"), (3, "a b", "s0"), (3, "a b", "s0")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def test_substring(docs):
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in docs.collect()]
    for window in (1, 3, 5):
        seen = collections.Counter(tuple(w[i : i + window]) for _, w in rows for i in range(len(w) - window + 1))
        want = []
        for doc, w in rows:
            gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
            want.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
        got = [tuple(r) for r in substring.without_repeats(docs, window, with_text=False).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
        dealt = substring.without_repeats(docs, window, with_text=False, common=1).collect()  # every anchor's windows one by one
        assert sorted((tuple(r) for r in dealt), key=key) == sorted(want, key=key)
    assert substring.without_repeats(docs.limit(0), 3).count() == 0


def test_cleaned(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(0, f"x1  x2\n{passage} y1 y2", None, 1), (1, f"{passage} z", "s", 2), (2, None, "s", 3), (3, "", "s", 4), (4, "w " * 200, "s", 5), (5, "all  my\town words", "s", 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, H1 string, __spans int")
    got = {r.doc_id: r.text for r in substring.cleaned(table).collect()}
    assert got == {0: "x1 x2 y1 y2", 1: "z", 2: None, 3: "", 4: "", 5: "all  my\town words"}
    assert substring.cleaned(table).columns == table.columns and substring.cleaned(table.limit(0)).count() == 0


def brute_lm(rows, order):
    """Each text's sum of logarithms, by definition."""
    counts = [collections.Counter(tuple(w[i : i + k]) for _, w in rows for i in range(len(w) - k + 1)) for k in range(1, order + 1)]
    total, out = sum(counts[0].values()), []
    for doc, w in rows:
        s = 0.0
        for i in range(len(w)):
            k = min(i + 1, order)
            g = tuple(w[i + 1 - k : i + 1])
            s += math.log(counts[k - 1][g] / (counts[k - 2][g[:-1]] if k > 1 else total))
        out.append((doc, len(w), s))
    return out


def close(got, want):
    got = sorted((tuple(r)[:3] for r in got), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=key)):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-4)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm(docs, order):
    more = docs.union(docs.sparkSession.createDataFrame([(90, "once seen words a b", "s0"), (91, "a once b", "s0"), (92, "b seen", None)], docs.schema))
    want = brute_lm([(r.doc_id, (r.text or "").encode().split()) for r in more.collect()], order)
    close(lm.own_scores(more, order).collect(), want)
    close(lm.foreign_scores(more, lm.count_tables(more, order)).collect(), want)


def test_lm_with_many_rare_words(spark):
    rng = np.random.default_rng(9)
    texts = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 5000)) for i in range(60)]
    want = brute_lm([(i, t.encode().split()) for i, t in texts], 2)
    close(lm.own_scores(spark.createDataFrame(texts, "doc_id long, text string")).collect(), want)


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("limits", [(0, 0), (3, 0), (3, 5), (1000, 1000)])
def test_lm_with_hot_ngrams(spark, monkeypatch, order, limits):
    """Whichever contexts and n-grams are taken out as hot, none, a few or all, the scores are those of the definition."""
    monkeypatch.setattr(lm, "CONTEXTS", limits[0])
    monkeypatch.setattr(lm, "COMMON", limits[1])
    rng = np.random.default_rng(10)
    texts = [(i, " ".join(f"w{x}" for x in rng.zipf(1.5, n) % 50)) for i, n in enumerate([0, 1, 1, 2, 2, 3, 40, 200])] + [(8, "w1 " * 300), (None, "w1 w1")]
    want = brute_lm([(i, t.encode().split()) for i, t in texts], order)
    made = lm.own_scores(spark.createDataFrame(texts, "doc_id long, text string"), order, share=1.0)
    close(made.collect(), want)
    # a row per n-gram, joined to the counts of itself and of its context in its hash partition
    assert made._jdf.queryExecution().executedPlan().toString().count("Window ") >= 2


def test_lm_backs_off(spark):
    corpus = spark.createDataFrame([("a b c",), ("a b d",), (None,)], "text string")
    texts = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, "a x c"), (4, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.log_score for r in lm.foreign_scores(texts, lm.count_tables(corpus, 2)).collect()}
    assert got[1] == pytest.approx(math.log(2 / 6) + math.log(2 / 2), abs=1e-5)
    assert got[2] == pytest.approx(math.log(2 / 6) + math.log(0.4 * 2 / 6), abs=1e-5)
    assert got[3] == pytest.approx(math.log(2 / 6) + math.log(0.4 * 0.5 / 6) + math.log(0.4 * 1 / 6), abs=1e-5) and got[4] == 0
    assert lm.foreign_scores(texts, lm.count_tables(corpus.limit(0), 2)).count() == 5


def test_op6(docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_lm([(r.doc_id, (r.text or "").encode().split()) for r in docs.collect()], 2)
    close(lm.op6_lm(docs.sparkSession, str(tmp_path)).select("doc_id", "n_words", "log_score").collect(), want)


def test_simhash(docs, spark):
    prints = {(r.doc_id, r.fps[0] % (1 << 64)) for r in simhash.fingerprints(docs).collect()}
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        assert (r.doc_id, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))) in prints
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 40)
    fps = np.concatenate([base, base[:20] ^ (1 << rng.integers(0, 62, 20)), base[:10] ^ 7, base[:5]])
    rows = spark.createDataFrame([(i, [int(x)], 1) for i, x in enumerate(fps)], "doc_id long, fps array<long>, n_shingles long")
    up = list(range(len(fps)))
    for _ in fps:
        for i, x in enumerate(fps):
            for j, y in enumerate(fps):
                if int(x ^ y).bit_count() <= 2:
                    up[i] = up[j] = min(up[i], up[j])
    assert {r.doc_id: r.component_id for r in simhash.near_groups(rows, 2).collect()} == dict(enumerate(up))


def near_texts():
    """Texts whose five-word shingle sets are just above and below a Jaccard similarity of 0.8, of several lengths, chains of them and loose ends."""
    rng, out = np.random.default_rng(5), [None, "", " ", "a b", "A  b", "a b c d e", "a b c d e f"]
    for n in (12, 24, 45, 90, 225, 450):  # one end changed by c words changes c shingles: (n - c) / (n + c)
        for extra in (-3, -1, 0, 1, 3):
            words = [f"w{x}" for x in rng.integers(0, 1 << 40, n + 4)]
            c = max(1, n // 9 + extra)
            out += [" ".join(words), " ".join(words[:-c] + [f"v{x}" for x in rng.integers(0, 1 << 40, c)])]
            if extra == 0:
                out.append(" ".join([f"u{x}" for x in rng.integers(0, 1 << 40, c)] + words[c:]))  # like the first, not like the second
    return out


def brute_groups(texts, k=5):
    """The first text of each component of exact links."""
    sets = [frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset() for w in ((t or "").encode().lower().split() for t in texts)]
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = top[i], top[j]
                top = [min(a, b) if x in (a, b) else x for x in top]
    return set(top)


def test_one_of_each(spark):
    texts = near_texts()
    want = brute_groups(texts)
    assert 0 < len(want) < len(texts)
    rows = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[-1]), (3, texts[3])], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(rows).collect()) == sorted(want)


def test_one_of_each_with_repeated_lines(spark):
    rng = np.random.default_rng(6)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    texts = []
    for n in (60, 90, 150):
        words, line = fresh(n), fresh(10)
        texts += [" ".join(words), " ".join(words + words[-4:] * 60), " ".join(words[:20] + words[16:20] * 50 + words[20:])]  # the same sets but for 4 shingles, or 8
        texts += [" ".join(line * 20 + fresh(n)), " ".join(line * 20 + fresh(n))]  # different texts with the same line
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_groups(texts)
    assert len(want) == 9
    assert sorted(r.doc_id for r in simhash.one_of_each(rows).collect()) == sorted(want)


def test_candidate_links_come_from_fingerprints(spark):
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 1 << 63, (40, simhash.DEDUP_WORDS), dtype=np.uint64)
    far = ~bits
    rows = []
    for i in range(40):
        near = far[i].copy()
        word, distance = i % simhash.DEDUP_WORDS, simhash.DEDUP_DISTANCE + i % 2  # one fingerprint within the distance, or just beyond
        near[word] = bits[i][word] ^ np.uint64(sum(1 << int(b) for b in rng.permutation(64)[:distance]))
        rows += [(2 * i, 100, bits[i].view(np.int64).tolist()), (2 * i + 1, 81 if i % 3 else 79, near.view(np.int64).tolist())]
    nodes = spark.createDataFrame(rows, "node long, size long, fps array<long>")
    got = {(min(r), max(r)) for r in simhash.candidate_links(nodes).collect()}
    assert {(2 * i, 2 * i + 1) for i in range(40) if i % 2 == 0 and i % 3} == {x for x in got if x[0] // 2 == x[1] // 2}


def test_set_fingerprints():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 1 << 63, 70_000, dtype=np.uint64)
    for n in (0, 1, 2, 255, 256, 70_000):
        want = [sum(1 << b for b in range(64) if 2 * int((simhash.mix(x[:n] + np.uint64(w * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(b) & np.uint64(1)).sum()) > n) for w in range(simhash.DEDUP_WORDS)]
        assert simhash.set_fingerprints(x[:n]).tolist() == want


def test_sized_makes_no_strings_of_words(docs):
    rows = mixing.sized(docs)
    assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert collections.Counter((r.doc_id, r.source, r.size) for r in rows.collect()) == collections.Counter((r.doc_id, r.source, len((r.text or "").encode().split())) for r in docs.collect())


def check_packed(rows, capacity):
    """Sequences without gaps or overlaps, within the capacity; how many there are."""
    spans = collections.defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
    for x in spans.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans)


def first_fit(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        at = min((i for i, g in enumerate(gaps) if g >= x), key=lambda i: gaps[i], default=None)
        if at is None:
            gaps.append(capacity)
            at = len(gaps) - 1
        gaps[at] -= x
    return len(gaps)


@pytest.mark.parametrize("range_rows", [20_000, 40])
def test_pack(spark, range_rows):
    rng = np.random.default_rng(3)
    lengths = [*rng.integers(1, 101, 300).tolist(), *[30] * 150, *[100] * 20, *rng.integers(1, 8, 200).tolist()]
    items = spark.createDataFrame([(i % 5 or None, 0, int(x), "o") for i, x in enumerate(lengths)], "doc_id long, piece int, length long, offset string").repartition(5)
    got = packing.pack(items, 100, range_rows).collect()
    assert sorted(r.length for r in got) == sorted(lengths)
    assert check_packed(got, 100) <= 1.03 * first_fit(lengths, 100) + 1
    assert packing.pack(items.limit(0), 100).count() == 0


def test_ranges_and_sweep():
    cut_ = packing.ranges({1: 10, 5: 95, 6: 3}, 8, 30)
    assert cut_.first[1] == 0 and cut_.split[5] == 4 and cut_.first[6] == cut_.first[5] + 4 and cut_.count == cut_.first[6] + 1
    found, left, room = packing.sweep([3, 5, 9], [2, 6, 8], 10)
    assert sorted(found) == [(0, 2, 8), (1, 1, 6)] and left == [2] and room == [2, 1, 5]
    assert packing.exchange([(0, 5, 3, 0, 0), (1, 0, 0, 2, 7), (2, 1, 8, 1, 9)], 10) == [(0, 0, 4, 2, 1, 0, 2), (0, 4, 1, 3, 2, 0, 1)]
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


def test_coders_agree(tmp_path):
    import base64

    import public_tokenizers
    from tokenizers import Tokenizer

    path, ranks = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
    whole, end = Tokenizer.from_file(path), "<|endoftext|>"
    texts = [t or "" for t in TEXTS] + [f"a {end} b", f"{end}{end}x  {end}", f"a{end}  b\n", "<|endoftext|", "don't 12345  \n\n\tx  ", "naïve 東京 🙂\u200d\u00a0 ß", "\x00\r\n", " \u3000 x", "I'LL we'll 'S"]
    rng = np.random.default_rng(1)
    texts += ["".join(map(chr, rng.choice([*range(32, 127), 10, 9, 0xA0, 0xE9, 0x2028, 0x3042, 0x1F600], 60))) for _ in range(300)]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(x) for x in packing.coder(path)(texts)] == want == [list(x) for x in packing.coder(path, ranks)(texts)]
    (tmp_path / "other").write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        packing.coder(path, str(tmp_path / "other"))


def test_op3(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [None, "", "a", f"a {end} b", "the quick brown fox " * 900, "naïve 東京 🙂\u200d\u00a0 ß", "x" * 3000, "a", "word " * 1022, "word " * 1023, "word " * 1024]
    spark.createDataFrame([(i if i != 7 else None, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, piece string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        starts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((i if i != 7 else None, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))))
    assert whole.encode(f"a {end} b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = packing.op3_packing(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    assert check_packed(got, 1024) <= first_fit([x[3] for x in want], 1024)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u", "aa"), (2, "v", "aa"), (2, "v", "aa"), (3, None, None), (None, "é x", ""), (None, None, "é\r\n\r\nWARC/1.1\r\n" * 6000)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w")
    got = warc.read(spark, f"{tmp_path}/w").collect()
    assert len(got) == 6 and all(r.complete for r in got)
    assert sorted(bytes(r.payload) for r in got if r.record_type == "response") == sorted({(h or "").encode() for _, _, h in rows})
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {2, 3}
    assert warc.dechunked(b"5\r\nabc") is None


def test_warc_damage(spark, tmp_path):
    good = b"".join(b + b"\r\n\r\n" for b in warc.page_records(7, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), 1, None))
    import gzip
    import os

    os.mkdir(f"{tmp_path}/d")
    for name, data in {"whole": good, "head": good + b"WARC/1.1\r\nWARC-Type: resp", "nolength": good + b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", "block": good + good[:-20], "gzip": gzip.compress(good)[:-12]}.items():
        with open(f"{tmp_path}/d/{name}.warc", "wb") as f:
            f.write(data)
    rows = warc.read(spark, f"{tmp_path}/d").collect()
    assert {r.page_id for r in rows if r.complete} == {7} and sum(r.complete for r in rows) >= 4
    assert list(warc.parse(b"WARC/1.1\r\n")) == [] and list(warc.parse(b"")) == []


def test_sharding(docs):
    rows = sharding.shard(sharding.sized(docs), 5).collect()
    assert len(rows) == docs.count()
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    texts = collections.defaultdict(set)
    for r in rows:
        texts[r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for x in texts.values()) and zlib.crc32(b"") in texts
    assert sharding.shard(sharding.sized(docs.limit(0)), 5).count() == 0


def test_sharding_is_even(spark, tmp_path):
    rng = np.random.default_rng(4)
    texts = ["x" * int(n) for n in rng.integers(1, 2000, 3000)] + ["copy"] * 500 + [None] * 40
    spark.createDataFrame([(i, f"{i} {t}" if t and t != "copy" else t, 1) for i, t in enumerate(texts)], "doc_id long, text string, slot int").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sharding.op9_sharding(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len(t) + 16, zlib.crc32(t)) for i, t in enumerate((f"{i} {t}" if t and t != "copy" else t or "").encode() for i, t in enumerate(texts)))
    loads = collections.Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert set(loads) == set(range(40)) and max(loads.values()) - min(loads.values()) < 0.02 * sum(loads.values()) / 40
    # a text that holds more than a shard's share has one to itself, and the others stay even
    big = spark.createDataFrame([(i, "b" * 100_000 if i == 0 else f"{i}" * 5) for i in range(400)], "doc_id long, text string")
    loads = collections.Counter()
    for r in sharding.shard(sharding.sized(big), 4).collect():
        loads[r.shard] += r.size
    few = sorted(loads.values())
    assert few[-1] == 100_016 and few[2] - few[0] < 0.05 * few[0]


def test_mixing(docs):
    rows = mixing.sized(docs)
    got = mixing.taken(rows, mixing.source_table(rows)).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.targets({"a": 10, "b": 10, None: 10}) == {"a": 20.0, "b": pytest.approx(50 / 3), None: pytest.approx(25 / 3)}
    none = mixing.sized(docs.limit(0))
    assert mixing.taken(none, mixing.source_table(none)).count() == 0


@pytest.mark.parametrize("words", [20, 900, 40_000])
def test_mixing_meets_targets(spark, tmp_path, words):
    rng = np.random.default_rng(words)
    rows = []
    for source in ("a", "b", None, "é"):
        left = words
        while left:
            n = min(left, int(rng.integers(1, 60)))
            rows.append((len(rows), " ".join(f"w{x}" for x in rng.integers(0, 99, n)), source, 1))
            left -= n
    rows += [(len(rows), None, "a", 1), (None, "", "b", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, taken int").write.parquet(f"{tmp_path}/documents.parquet")
    runs = [sorted((tuple(r) for r in mixing.op7_mixing(spark, str(tmp_path)).collect()), key=key) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    source_of, took, target = {r[0]: r[2] for r in rows}, collections.Counter(), {}
    for doc, size, source_size, aim, n in runs[0]:
        assert n <= 2 * size and source_size == words
        took[source_of[doc]] += n
        target[source_of[doc]] = aim
    for source, aim in target.items():
        assert abs(took[source] - aim) <= max(1, 0.005 * words)


def test_mixed_takes_what_it_counts(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 99, int(rng.integers(0, 90)))), f"s{i % 3}", "x") for i in range(200)] + [(5, None, None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, __parts string")
    counted = mixing.sized(table)
    want = {r.doc_id: r.taken for r in mixing.taken(counted, mixing.source_table(counted)).collect() if r.taken}
    got = collections.Counter()
    made = mixing.mixed(table)
    for r in made.collect():
        got[r.doc_id] += len(r.text.split())
        assert set(r.text.split()) <= set(rows[r.doc_id][1].split())
    assert dict(got) == want and made.columns == table.columns and mixing.mixed(table.limit(0)).count() == 0


def test_fingerprint(docs):
    made = fingerprint.with_next(fingerprint.fingerprints(docs), 4).collect()
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = sorted(((a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1])), key=key)
    assert sorted(((r.doc_id, r.text, r.next_text) for r in made), key=key) == want
    assert len({(r.text, tuple(r.sketch)) for r in made}) == len({r.text for r in made})
    assert fingerprint.with_next(fingerprint.fingerprints(docs.limit(0)), 4).count() == 0
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert fingerprint.with_next(fingerprint.fingerprints(nulls), 4).count() == docs.count()


def test_sketches_of_short_texts(spark):
    """A text whose hashes all lie above the threshold says nothing of containment, never something wrong; merging keeps least hashes right."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(200):
        words = [f"w{x}" for x in rng.integers(0, 1 << 30, 60)]
        rows.append((i, " ".join(words[20:26]), " ".join(words), " ".join(words[:10]), " ".join(words[6:16])))
    df = spark.createDataFrame(rows, "i int, a string, b string, c string, d string")
    for name in "abcd":
        df = df.withColumn(f"h{name}", fingerprint.word_hashes(F.col(name)))
    for name in "abcd":
        df = df.withColumn(f"s{name}", fingerprint.sketch(F.col(f"h{name}")))
    union = F.concat_ws(" ", "c", F.substring_index("d", " ", -6))  # words 0 to 15: the shingles of both
    df = df.withColumn("hu", fingerprint.word_hashes(union)).withColumn("su", fingerprint.sketch(F.col("hu")))
    got = df.select(fingerprint.containment(F.col("sa"), F.col("sb")).alias("x"), (fingerprint.merged(F.col("sc"), F.col("sd")) == F.col("su")).alias("m"), fingerprint.resemblance(F.col("sa"), F.col("sa")).alias("r"), F.size("sa").alias("n")).collect()
    assert {r.x for r in got} == {1.0, None} and all(r.m for r in got) and all(r.r == 1.0 and r.n for r in got)


def test_op4(spark, tmp_path):
    texts = [(3, "one two three four five six seven eight nine ten eleven twelve"), (1, ""), (2, None), (9, "é" * 7), (5, "x"), (4, "one two three four five six seven eight nine ten eleven twelve")]
    spark.createDataFrame(texts, "doc_id long, text string").withColumn("sketch", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprint.op4_fingerprint(spark, str(tmp_path)).collect()}
    order = sorted(((d, t or "") for d, t in texts), reverse=True)
    for (doc, text), (after, following) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = following[:half] + "" if not text else text[: len(text) - half] + following[:half]
        assert got[doc].n_chars == len(text) and got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[doc].near_edited <= 1 and (got[doc].near_next == 1) == (got[doc].fingerprint == got[after].fingerprint)
        assert (got[doc].near_edited == 1) == (got[doc].fingerprint == got[doc].edited_fingerprint)
    assert got[3].fingerprint == got[4].fingerprint != "" and got[1].fingerprint == got[2].fingerprint == ""


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 16))
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(9000, None), (9300, [0.0] * 16), (9600, [float("nan")] * 16)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in nearest.search(rows, lambda i: i % 300 == 0).collect():
        got[r.query_id].add(r.vec_id)
    found = [len(got[q] & set(np.argsort(-np.where(np.arange(6000) == q, -np.inf, x @ x[q]))[:20].tolist())) / 20 for q in range(0, 6000, 300)]
    assert np.mean(found) >= 0.9 and set(got) == set(range(0, 6000, 300))


def test_nearest_with_copies_and_ties(spark):
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(i, one) for i in range(100)] + [(i, two) for i in range(100, 104)] + [(0, one), (None, one), (300, [1.0, None, 0.0]), (301, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query", F.lit(1))
    got = nearest.search(table, lambda i: i % 50 == 0, k=5).collect()
    by = collections.defaultdict(dict)
    for r in got:
        by[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert {q: [x[n][0] for n in sorted(x)] for q, x in by.items()} == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [101, 102, 103, 0, 1]}
    assert by[100][1] == (101, 1.0) and by[100][4][1] == 0.0
    assert nearest.search(table.limit(0), lambda i: i % 50 == 0).count() == 0
    assert [(r.query_id, r.vec_id) for r in nearest.search(table.filter("vec_id in (0, 7)"), lambda i: i % 50 == 0).collect()] == [(0, 7)]


@pytest.fixture(scope="module")
def marked(spark):
    rng = np.random.default_rng(7)
    good, bad = [f"g{x}" for x in range(60)], [f"b{x}" for x in range(60)]
    texts = [" ".join(rng.choice(good if i % 2 else bad, int(rng.integers(3, 40))).tolist()) for i in range(400)]
    return texts, [(i, i % 2) for i in range(300)]


def test_quality(spark, marked):
    texts, labels = marked
    odd = [None, "", " ", "spam spam spam", "spam a", "a spam", "spam  spam\n", "x" * 300_000, "spam " * 70_000 + "spam", " é\u2003ü", texts[0]]
    rows = [(i, t, i) for i, t in enumerate([*texts, *odd])] + [(None, "spam a", 0), (7, texts[7], 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score int")
    model = quality.fit(table.filter("doc_id <> 7"), spark.createDataFrame(labels + [(3, None), (5, 7), (None, 1)], "doc_id long, quality int"))
    got = [quality.score(t, model).collect() for t in (table.repartition(1).orderBy("doc_id"), table.repartition(3).orderBy(F.desc("doc_id")), table.coalesce(1).orderBy("text"))]
    for run in got:
        assert sorted((tuple(r) for r in run), key=key) == sorted((tuple(r) for r in got[0]), key=key) and len(run) == len(rows)
    alone = {r.doc_id: r.score for r in got[0] if r.doc_id is not None}
    for i in (len(texts) + 3, len(texts) + 4, 2, 5):
        assert [r.score for r in quality.score(table.filter(F.col("doc_id") == i), model).collect()] == [alone[i]]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got[0])
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(alone[i] >= 0.5) == i % 2 for i in held]) >= 0.95
    stays = quality.kept(table, model)
    assert stays.columns == table.columns and sorted((r.doc_id for r in stays.collect()), key=lambda x: (x is not None, x or 0)) == sorted((r.doc_id for r in got[0] if r.predicted), key=lambda x: (x is not None, x or 0))
    assert quality.score(table.limit(0), model).count() == 0


def test_quality_without_labels(spark):
    table = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = quality.fit(table, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score(table, model).collect()] == [0.5, 0.5]


def test_quality_of_a_long_text(spark, marked):
    """Read in parts, a long text has the features of the whole."""
    texts, labels = marked
    model = quality.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    long_ = " ".join(texts) + " g1" * 120_000
    got = quality.score(spark.createDataFrame([(1, long_)], "doc_id long, text string"), model).first().score
    _, bucket = quality.features(long_.encode())
    z = model.share()[bucket].sum(dtype=np.float64) / (len(bucket) + quality.NEUTRAL) + model.odds()
    assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)
