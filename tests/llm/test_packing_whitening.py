"""Packing and whitening against brute force, on small tables with nulls, ties, repeats and odd columns."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from adinsight.llm import packing, whitening
from adinsight.llm.packing import Capacity, Rule

PATH = public_tokenizers.path("byte_bpe_50k.json")


# --- 11: packing -----------------------------------------------------------------------------------------------------


def one_by_one(lengths, capacity, rule):
    """Sequences of a best fit that places single pieces, longest first."""
    bins, full = [], np.array(capacity)
    for length in sorted(lengths, reverse=True):
        piece, best = np.array([length, 1, length * length]), None
        for i, left in enumerate(bins):
            if (left >= piece).all():
                rest = (left - piece) / full
                w = np.array(rule.weights)
                value = (w * rest * rest).sum() if rule.kind == "norm" else (rest * w * (piece / full)).sum()
                if best is None or value < best[0]:
                    best = value, i
        if best is None:
            bins.append(full.copy())
            best = 0, len(bins) - 1
        bins[best[1]] = bins[best[1]] - piece
    return bins


@pytest.mark.parametrize("rule", packing.RULES)
@pytest.mark.parametrize("capacity", [Capacity(50, 50, 2500), Capacity(50, 3, 2500), Capacity(50, 50, 1600), Capacity(50, 4, 900)])
def test_plan_equals_placing_one_by_one(capacity, rule):
    rng = random.Random(repr((capacity, rule)))
    for _ in range(12):
        lengths = [min(capacity.piece, rng.choice([rng.randint(1, 50), rng.randint(1, 9), 7])) for _ in range(rng.randint(1, 150))]
        n, runs = packing.best_fit(collections.Counter(lengths), capacity, rule)
        bins = one_by_one(lengths, capacity, rule)
        assert n == len(bins)
        placed = collections.defaultdict(list)
        for run in runs:
            for k in range(run.count):
                placed[run.first + k // run.each].append((run.offset + k % run.each * run.length, run.length))
        assert sorted(length for p in placed.values() for _, length in p) == sorted(lengths)
        for pieces in placed.values():
            pieces.sort()
            assert [o for o, _ in pieces] == [sum(length for _, length in pieces[:i]) for i in range(len(pieces))]
            assert sum(length for _, length in pieces) <= capacity.tokens and len(pieces) <= capacity.documents
            assert sum(length**2 for _, length in pieces) <= capacity.attention
        left = sorted(tuple(b) for b in bins)
        assert left == sorted((capacity.tokens - sum(length for _, length in p), capacity.documents - len(p),
                               capacity.attention - sum(length**2 for _, length in p)) for p in placed.values())


def test_plan_is_bounded_by_the_capacity():
    rng = np.random.default_rng(1)
    small = dict(enumerate(rng.integers(1, 1000, 1024).tolist(), 1))
    n, runs = packing.best_fit({k: v * 10**9 for k, v in small.items()}, Capacity(), Rule())
    assert len(runs) < 20_000 and sum(r.count for r in runs) == 10**9 * sum(small.values())
    assert n <= 1.01 * -(-10**9 * sum(k * v for k, v in small.items()) // 1024)


def test_a_piece_that_fits_nowhere():
    with pytest.raises(ValueError):
        packing.best_fit({9: 1}, Capacity(8, 8, 64), Rule())
    assert Capacity(1024, 8, 900).piece == 30


@pytest.mark.parametrize("capacity", [Capacity(64, 64, 4096), Capacity(64, 2, 3000)])
def test_packed_documents(spark, capacity):
    rng, library = random.Random(2), Tokenizer.from_file(PATH)
    texts = [None, "", "a", "long " * 3000] + ["".join(rng.choice(["so ", "much ", "\n", "  ", "x"]) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, "no id", "x", 0), (5, texts[5], "x", 1), (5, texts[5], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, length int").repartition(3)
    out = packing.pack(docs, PATH, capacity, end_id=2)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    wanted = collections.defaultdict(list)
    for i, t, *_ in rows:
        wanted[i].append(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4"))
    places = collections.defaultdict(list)
    for i, pieces in got.items():
        pieces.sort(key=lambda r: (r.piece, r.sequence_id, r.offset))
        assert b"".join(bytes(r.ids) for r in pieces if len(wanted[i]) == 1) == (wanted[i][0].tobytes() if len(wanted[i]) == 1 else b"")
        assert sum(r.length for r in pieces) == sum(map(len, wanted[i]))
        for r in pieces:
            assert len(r.ids) == 4 * r.length and (r.length == capacity.piece if r.piece else r.start == 0)
            assert zlib.crc32(wanted[i][0][r.start : r.start + r.length].tobytes()) == zlib.crc32(r.ids)
            places[r.sequence_id].append((r.offset, r.length))
    assert set(got) == set(wanted)
    for p in places.values():
        p.sort()
        assert all(o == sum(length for _, length in p[:i]) for i, (o, _) in enumerate(p)) and sum(length for _, length in p) <= capacity.tokens
        assert len(p) <= capacity.documents and sum(length**2 for _, length in p) <= capacity.attention
    whole = packing.sequences(out).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(len(t) for ts in wanted.values() for t in ts)
    assert all(sorted(r.offsets) == [o for o, _ in places[r.sequence_id]] for r in whole)


def test_packing_nothing(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(nothing, PATH, end_id=2).count() == 0
    assert packing.pack(spark.createDataFrame([(1, None)], "doc_id long, text string"), PATH).count() == 0


# --- 12: whitening ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["random", "repeated", "steep", "close", "diagonal", "low rank"])
def test_leading_pairs_of_a_matrix(n, kind):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    values = {"random": 10 * rng.random(n), "repeated": np.round(3 * rng.random(n)) + 1, "steep": 10.0 ** -np.arange(n),
              "close": np.concatenate([np.ones(4), 1 - 1e-9 * np.arange(n)])[:n], "diagonal": np.arange(n, 0, -1.0),
              "low rank": np.where(np.arange(n) < 2, 5.0 + np.arange(n), 0)}[kind]
    matrix = np.diag(values) if kind == "diagonal" else q @ np.diag(values) @ q.T
    matrix = (matrix + matrix.T) / 2
    got, vectors = whitening.leading_pairs(matrix, 8)
    k = min(n, 8)
    assert np.allclose(got, np.sort(values)[::-1][:k], rtol=0, atol=1e-13 * values.max())
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
    assert np.abs(matrix @ vectors - got * vectors).max() < 1e-13 * values.max()


def test_sturm_counts():
    rng = np.random.default_rng(0)
    diagonal, off = rng.standard_normal(30), rng.standard_normal(29)
    off[7] = 0
    true = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    x = np.concatenate([(true[1:] + true[:-1]) / 2, [-99, 99]])
    assert (whitening.below(diagonal, off, x) == (true[None] < x[:, None]).sum(1)).all()


def brute(vectors, k):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(0)
    away = n * x - sums
    c = away.astype(float) / n
    v = c.T @ c / n
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return [int(s) for s in (away * away).sum(1)], c @ basis / np.sqrt(values), values / np.trace(v)


def test_whitened_vectors(spark):
    rng = np.random.default_rng(5)
    good = (rng.standard_normal((400, 12)) * np.arange(1, 13)).astype(np.float32)
    good[7] = good[8]
    rows = [(i, v.tolist(), 1, [0.0]) for i, v in enumerate(good)] + [(None, good[0].tolist(), None, None), (3, good[3].tolist(), 1, [0.0])]
    odd = [(900, None, 1, None), (901, [1.0] * 11 + [None], 1, None), (902, [1.0] * 11 + [float("nan")], 1, None),
           (903, [float("inf")] + [1.0] * 11, 1, None), (904, [], 1, None), (905, [1.0] * 5, 1, None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, w int, whitened array<double>").repartition(3)
    model = whitening.fit(df, components=5)
    out = whitening.whiten(df, model, whitened="projected", deviation="away").collect()
    away, wanted, share = brute([r[1] for r in rows], 5)
    assert model.n == len(rows) and np.allclose(model.explained, share, rtol=1e-10) and model.identity_error < 1e-10
    assert np.abs(np.linalg.norm(model.vectors, axis=0) - 1).max() < 1e-14
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    got = sorted(out, key=lambda r: (r.vec_id is None, r.vec_id or 0, r.embedding))
    assert [r.away for r in got] == [away[i] for i in order]
    g, w = np.array([r.projected for r in got]), wanted[order]
    assert np.allclose(np.abs(g), np.abs(w), rtol=1e-9, atol=1e-9) and (np.sign((g * w).sum(0)) != 0).all()
    assert np.allclose(g * np.sign((g * w).sum(0)), w, atol=1e-9)
    assert all(r.w is None if r.vec_id is None else r.w == 1 for r in got) and len(got[0].whitened or [1]) == 1


@pytest.mark.parametrize("vectors, kept", [([], 0), ([[1.0, 2.0]], 1), ([[1.0, 2.0]] * 5, 5), ([None, []], 0), ([[1.0], [1.0], [2.0, 3.0], [2.0, 4.0]], 2),
                                           ([[3e38, 1.0], [-3e38, 2.0], [0.0, 5.0]], 3)])
def test_whitening_of_few_vectors(spark, vectors, kept):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    out = whitening.whiten(df, model).collect()
    assert len(out) == kept == model.n and all(len(r.whitened) == len(model.values) for r in out)
    assert model.identity_error is None or model.identity_error < 1e-6


def test_deviations_are_exact_beyond_64_bits():
    x = np.array([[10**9, 1], [5, 2**40]])
    sums = [10**9 + 5, 2**40 + 1]
    assert whitening.deviations(x, 2, sums) == [None if (v := sum((2 * int(a) - s) ** 2 for a, s in zip(r, sums))) >= 1 << 63 else v for r in x]
    assert whitening.deviations(np.array([[3]]), 1 << 40, [7]) == [None]
    assert whitening.deviations(np.array([[3, 4]]), 1000, [2999, 4001]) == [2]


def test_registered_whitening(spark):
    rows = whitening.op12_embedding_whitening(spark, "/root/testdata/sf0.001")
    got = rows.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.col("whitened") ** 2).alias("s"), F.min("explained").alias("e"), F.max("n").alias("all")).orderBy("component").collect()
    assert [r.component for r in got] == list(range(1, 9))
    assert all(abs(r.s / r["all"] - 1) < 1e-9 and r.n == r["all"] for r in got)
    assert [r.e for r in got] == sorted((r.e for r in got), reverse=True)
