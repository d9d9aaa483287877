"""The pipeline, stage by stage, against brute force on a small corpus."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import mixing, quality

from .test_operators import brute_groups, check_packed


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    good, bad = [f"g{x}" for x in range(300)], [f"b{x}" for x in range(60)]
    shared = " ".join(rng.choice(good, 60).tolist())
    texts = []
    for i in range(240):
        words = rng.choice(bad if i % 4 == 0 else good, int(rng.integers(5, 160))).tolist()
        texts.append(" ".join(words) + (f"\n{shared}" if i % 10 == 1 else ""))
    texts += [texts[1], texts[2] + " g5", None, "", texts[7].replace(" ", "\t", 1)]
    at = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def brute_clean(texts, window=35):
    words = {d: (t or "").split() for d, t in texts.items()}
    seen = collections.Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out[d] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else texts[d]
    return out


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "repeats", "mix", "pack"]
    model = quality.fit(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    now, outputs = docs, {}
    for name, stage in stages.items():
        made = stage(spark, now, corpus)
        if name != "pack":
            assert made.columns == docs.columns
            made.write.parquet(f"{corpus}/{name}")
            made = spark.read.parquet(f"{corpus}/{name}")
            assert all((r.n_chars, r.doc_id) == (len(r.text or ""), r.doc_id) for r in made.collect())
        outputs[name], now = made, made
    scored = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    kept = rows_of(outputs["quality"])
    assert set(kept) == scored and len([d for d in scored if d < 240 and d % 4]) == 180 and not any(d % 4 == 0 for d in scored if d < 240)
    order = sorted(kept)
    want = {order[i] for i in brute_groups([kept[d] for d in order])}
    distinct = rows_of(outputs["near_copies"])
    assert set(distinct) == want and 240 not in want and 244 not in want
    cleaned = rows_of(outputs["repeats"])
    assert cleaned == brute_clean(distinct)
    counted = mixing.sized(outputs["repeats"])
    takes = {r.doc_id: r.taken for r in mixing.taken(counted, mixing.source_table(counted)).collect() if r.taken}
    mixed = collections.Counter()
    for r in outputs["mix"].collect():
        mixed[r.doc_id] += len(r.text.split())
    assert dict(mixed) == takes
    packed = outputs["pack"].collect()
    assert check_packed(packed, 1024) >= 1 and {r.doc_id for r in packed} == set(mixed)


def test_run(spark, corpus):
    got = corpus_pipeline.run(spark, corpus).collect()
    check_packed(got, 1024)
    assert len(got) > 100 and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_an_empty_table(spark, corpus):
    none = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, corpus).count() == 0


def test_stages_with_clashing_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(30)
    for c in ("predicted", "score", "__stays", "stays", "h1", "__h1", "__parts", "item", "sequence_id", "rank"):
        docs = docs.withColumn(c, F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, corpus).columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, corpus).count() >= 30


def test_shuffle_files_go(spark, tmp_path):
    """what a written table was shuffled through doesn't stay on the disks, and the setting is as it was."""
    import glob
    import time

    from waymark.llm import store

    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    data = lambda: set(glob.glob(f"{folder}/**/shuffle_*.data", recursive=True))
    before, setting = data(), spark.conf.get(store._CLEANUP, None)
    assert len(store.written(spark.range(100_000).groupBy((F.col("id") % 977).alias("k")).count(), "gone").collect()) == 977
    for _ in range(50):
        left = [f for f in data() - before if "shuffle" in f]
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(store._CLEANUP, None) == setting
