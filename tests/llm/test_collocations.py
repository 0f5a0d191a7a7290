"""Collocations against brute force: nulls, ties, repeats, long texts, clashing columns, several shards."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from adinsight.llm import collocations
from adinsight.llm.collocations import Marks

SF = "/root/testdata/sf0.001"


def brute(rows, least, longest, top, cover=(80, 100)):
    counts = defaultdict(Counter)
    for lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                counts[lang or "und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(a for p, a in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(held[p[i : i + k]], a)
        ranked = []
        for p, a in candidates.items():
            if p in held and cover[1] * held[p] >= cover[0] * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = "the of new york city time a b cc Ärger ÉT x1 's zz".split()
    texts = []
    for _ in range(120):
        parts = [rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! "]) for _ in range(rng.randint(0, 60))]
        texts.append((rng.choice(["en", "en", "fr", None, "und"]), "".join(parts)))
    texts += [("en", "New York City "), ("en", None), ("en", ""), ("en", " . ,; "), ("de", "one"), ("de", "\x1c\x85 x \x1c\x85 x"), ("fr", "\x00 \x00 \x00 \x00 \x00")]
    texts += [("en", "new york " * 9000), ("long", "w " * 40000 + "v " + "w " * 5)] + [texts[3]] * 5
    return texts


@pytest.mark.parametrize("least, longest, top, shards", [(5, 4, 50, 3), (2, 4, 10, 4), (30, 4, 2000, 1), (5, 2, 2000, 3), (3, 3, 7, 2)])
def test_collocations_equal_brute_force(spark, rows, least, longest, top, shards):
    docs = spark.createDataFrame([(i, x, t, 1, "z") for i, (x, t) in enumerate(rows)], "doc_id long, lang string, text string, n int, phrase string").repartition(4)
    got = collocations.collocations(docs, least, longest, top, shards=shards)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, longest, top)


def test_fuller_marks_give_the_same_result(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_BITS", 1 << 6)
    monkeypatch.setattr(collocations, "MOST_BITS", 1 << 6)
    monkeypatch.setattr(collocations, "PIECE", 8)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert sorted(map(tuple, collocations.collocations(docs, 4).collect())) == brute(rows, 4, 4, 2000)


def test_equal_hashes_are_counted_again(spark, monkeypatch):
    plain = collocations.word_hash
    monkeypatch.setattr(collocations, "word_hash", lambda word, seed=0: 7 if not seed and word in (b"york", b"of") else plain(word, seed))
    rows = [("en", "new york of new york of new york x of of york")] * 2
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs, 2).collect())) == brute(rows, 2, 4, 2000)


def test_no_texts(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "few words only")], "lang string, text string")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 5 * 10**15
    key = ["g", *collocations.WORDS]
    phrases = spark.createDataFrame([(1, 8, 9, 0, 0, big), (1, 8, 0, 0, 0, big + 1), (1, 9, 0, 0, 0, big + 3)], ", ".join(f"{c} long" for c in [*key, "a"]))
    row = collocations._best_cut(phrases, phrases.filter("w2 <> 0"), 4).first()
    assert (row.score, row.l, row.r) == (2_000_000 * big // (2 * big + 4), big + 1, big + 3)


def test_marks_find_what_they_hold():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    data = np.zeros(1 << 13, np.uint8)
    at = hashes & np.uint64(8 * len(data) - 1)
    np.bitwise_or.at(data, (at >> np.uint64(3)).astype(int), (1 << (at & np.uint64(7))).astype(np.uint8))
    assert Marks(data)(hashes).all() and Marks(data)(rng.integers(0, 1 << 63, 1000, dtype=np.uint64)).mean() < 0.1


def test_registered_query_equals_its_sql(spark):
    got = sorted(map(tuple, collocations.op13_dynamic_itemset_counting(spark, SF).collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert got == sorted(con.sql(collocations.ORACLE).fetchall()) and got
