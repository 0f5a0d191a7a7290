"""What the operators leave on disk and in memory: shuffle files, worker caches, rows that move."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adinsight.llm import collocations, common, hash_counts, jaccard_join, suffix_tree_lm


def test_a_written_table_leaves_no_shuffle_files(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.size()))

    before, setting = files(), spark.conf.get(common.CLEANUP, None)
    rows = common.written(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), "no-shuffle-files")
    assert files() <= before and rows.count() == 700
    assert spark.conf.get(common.CLEANUP, None) == setting


def test_a_worker_gives_its_cache_up_after_a_task():
    def run(batches):
        jaccard_join._shingler(3)(b"a b c d")
        yield from batches

    batch = pa.RecordBatch.from_pydict({"x": [1]})
    first = common.worker_cache("shingler", lambda: None, 0)
    assert first is None and list(common.tidy(run)(iter([batch]))) == [batch]
    kept = common.worker_cache("shingler", lambda: None, 3)
    assert isinstance(kept, jaccard_join.Shingler)
    assert list(common.tidy(run, "shingler")(iter([batch]))) == [batch]
    assert common.worker_cache("shingler", lambda: "made anew", 3) == "made anew"


def test_texts_are_worked_on_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(jaccard_join, "TOGETHER", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["abcdef", None, "ghijkl", "", "é"])], names=["id", "text"])
    got = [(ids.to_pylist(), texts) for ids, texts in jaccard_join._grouped(iter([batch, batch.slice(0, 0)]))]
    assert got == [([0, 1, 2], [b"abcdef", b"", b"ghijkl"]), ([3, 4], [b"", "é".encode()])]


def test_packed_counts_are_added_by_bucket(spark):
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 64, 400, dtype=np.uint64) for _ in range(3)]
    parts = [np.unique(np.concatenate([p, parts[0][:50], np.array([0, (1 << 64) - 1], np.uint64)])) for p in parts]
    rows = [x for p in parts for x in zip(*hash_counts.buckets(3, p, np.full(len(p), 2)))]

    def merge(held):
        hashes, n = hash_counts.distinct(*map(np.concatenate, zip(*(hash_counts.unpack(data, 1) for _, data in held))))
        yield pa.RecordBatch.from_pydict({"q": hashes.view(np.int64), "n": n})

    got = hash_counts.merged(spark.createDataFrame(rows, "bucket int, data binary"), merge, "q long, n long", "bucket").collect()
    wanted = collections.Counter(int(h) for p in parts for h in p.view(np.int64))
    assert len(got) == len(wanted) and {r.q: r.n for r in got} == {h: 2 * n for h, n in wanted.items()}


def test_only_phrases_with_the_least_count_get_rows(spark):
    lm, rng = suffix_tree_lm, random.Random(5)
    docs = spark.createDataFrame([(" ".join(str(rng.randrange(60)) for _ in range(400)),) for _ in range(20)], "text string").repartition(4)
    known = lm.count_words(docs)
    encoded = common.written(lm._encoded(docs.select(F.lit(1).alias("id"), F.lit(False).alias("held_out"), "text"), known), "tokens")
    every = spark.sparkContext.broadcast((np.full(1 << 15, 255, np.uint8),) * 2)
    counts = collections.Counter()
    for r in docs.collect():
        tokens = [lm.word_hash(w) for w in r.text.encode().split()] + [lm.word_hash(lm.END)]
        pairs = lm._longer(np.array(tokens[1:], np.int64), np.array(tokens[:-1], np.int64))
        counts.update(pairs.tolist())
    wanted = {q for q, n in counts.items() if n >= 4}
    likely = lm._likely(encoded, every, 1, 4, 3)
    assert {r.q for r in likely.collect()} == wanted and 0 < len(wanted) < len(counts)
    marks = spark.sparkContext.broadcast(lm._marked(likely, 1 << 20))
    told = {r.q: r.n for r in lm._count_phrases(encoded, marks, 1).collect()}
    assert wanted <= set(told) and len(told) < len(wanted) + 20 and all(counts[q] == n for q, n in told.items())


def test_a_scan_tells_packed_rows(spark):
    texts = [("en", " ".join(f"w{(7 * i * i + j) % 900}" for i in range(3000))) for j in range(4)]
    path = common.new_path(spark, "dealt")
    collocations._dealt(spark.createDataFrame(texts, "lang string, text string").repartition(2), path, 1, 4, 0)
    every = spark.read.schema(collocations._DEALT).parquet(path).filter("shard >= 0")
    rows = collocations._scan(every, 4, None, None, True, 3, 1 << 17).collect()
    words = [hash_counts.unpack(bytes(r.data), 2) for r in rows]
    assert len(rows) <= 8 * 2 * 2 < sum(len(h) for h, *_ in words)
    assert sum(int(n.sum()) for _, n, _ in words) == 12000 == every.agg(F.sum("words")).first()[0]


def _jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_marks_of_the_tree_take_no_job_for_each_partition(spark, monkeypatch, many_partitions):
    monkeypatch.setattr(suffix_tree_lm, "LEAST_BITS", 1 << 10)
    hashes = np.random.default_rng(2).integers(0, 1 << 63, 500)
    rows = spark.createDataFrame([(int(h),) for h in hashes], "q long")
    before = _jobs(spark)
    marks = suffix_tree_lm._marked(rows, 1 << 16)
    assert suffix_tree_lm._has(marks, hashes).all() and _jobs(spark) - before < 10


def test_the_first_unit_tells_the_parts_of_a_phrase(spark, monkeypatch):
    lm, rng = suffix_tree_lm, random.Random(6)
    monkeypatch.setattr(lm, "UNIT", 1)
    monkeypatch.setattr(lm, "TOGETHER", 100)
    docs = spark.createDataFrame([(" ".join(str(rng.randrange(30)) for _ in range(300)),) for _ in range(12)], "text string").repartition(3)
    encoded = common.written(lm._encoded(docs.select(F.lit(1).alias("id"), F.lit(False).alias("held_out"), "text"), lm.count_words(docs)), "tokens")
    assert encoded.select("unit").distinct().count() == 12
    every = spark.sparkContext.broadcast((np.full(1 << 15, 255, np.uint8),) * 2)
    likely = common.written(lm._likely(encoded, every, 1, 4, 3), "likely")
    plain = lm._count_phrases(encoded, spark.sparkContext.broadcast(lm._marked(likely, 1 << 20)), 1).filter("n >= 4").select("q", "context", "shorter", "n")
    first = spark.sparkContext.broadcast(lm._marked(likely.select(F.col("first").alias("q")), 1 << 20))
    told = lm._count_phrases(encoded, first, 1, likely).filter("n >= 4").select("q", "context", "shorter", "n")
    assert sorted(told.collect()) == sorted(plain.collect()) and plain.count() > 100


def test_weights_are_found_by_their_leading_bits():
    lm, rng = suffix_tree_lm, np.random.default_rng(3)
    for n in (1, 2, 900):
        hashes = np.unique(np.concatenate([rng.integers(-(1 << 63), (1 << 63) - 1, n), (1 << 40) + np.arange(n)]))  # many with the same bits
        wanted = np.concatenate([rng.choice(hashes, 500), rng.integers(-(1 << 63), (1 << 63) - 1, 500), np.array([-(1 << 63), (1 << 63) - 1])])
        found, place = lm._find(hashes, *lm._begins(hashes), wanted)
        assert sorted(found) == np.flatnonzero(np.isin(wanted, hashes)).tolist() and (hashes[place] == wanted[found]).all()


def test_marks_of_a_scan_take_no_job_for_each_partition(spark, monkeypatch, many_partitions):
    monkeypatch.setattr(collocations, "PIECE", 1 << 7)
    plain = type(spark.range(0)).repartition  # as on a cluster where more partitions are set
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, n, *cols: plain(self, max(n, 40) if isinstance(n, int) else n, *cols))
    hashes = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 500).view(np.uint64))
    rows = spark.createDataFrame([(1, 0, hash_counts.pack(hashes, np.full(500, 3), np.full(500, 3)))], collocations._PACKED)
    before = _jobs(spark)
    marks = collocations._marked(rows, 2, np.zeros(1 << 13, np.uint8))
    assert 400 < int(np.unpackbits(marks).sum()) <= 500 and _jobs(spark) - before < 10


def test_phrases_with_equal_hashes_stay_apart():
    tokens = np.array([5, 6, 5, 6, 5, 7, 0], np.int64)
    at = np.array([0, 2, 4])
    chosen, n = collocations._distinct(tokens, np.array([9, 9, 8], np.uint64), at, 2)
    assert sorted(zip(at[chosen].tolist(), n.tolist())) in ([(0, 2), (4, 1)], [(2, 2), (4, 1)])
    chosen, n = collocations._distinct(tokens, np.array([9, 9, 9], np.uint64), at, 2)
    assert at[chosen].tolist() == [0, 2, 4] and n.tolist() == [1, 1, 1]
