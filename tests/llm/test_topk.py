import math
import random

from pyspark.sql import functions as F

from quern.llm import topk


def brute(rows, k):
    use = []
    for i, v in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for at, (q, qv) in enumerate(use):
        if q is None or q % 50:
            continue
        scores = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(qv, cv, strict=False)))), c) for n, (c, cv) in enumerate(use) if n != at]
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        out += [(q, n + 1, c, s) for n, (s, c) in enumerate(scores[:k])]
    return sorted(out, key=str)


def run(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    return sorted((tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, **settings).collect()), key=str)


def as_float32(v):
    import struct

    return None if v is None else [x if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v]


def test_against_brute_force(spark):
    rng = random.Random(14)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]
    rows += [(2000, None), (2050, [1.0, None]), (2051, [float("nan")] * 16), (2100, [float("inf")] * 16), (2150, []), (2151, [5.0]), (2200, [-9.0] * 20), (None, [1.0] * 16)]
    rows = [(i, as_float32(v)) for i, v in rows]
    assert run(spark, rows, block_rows=64, query_rows=4) == brute(rows, 5)
    assert run(spark, rows, k=9) == brute(rows, 9)


def test_few_candidates_and_large_numbers(spark):
    rows = [(50, as_float32([1e9, -1e9])), (100, as_float32([3e9, 1e9])), (1, as_float32([2e7, 1.0]))]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, [(50, [1.0])]) == [] and run(spark, []) == [] and run(spark, [(1, [1.0])]) == []


def test_all_scores_tie(spark):
    rows = [(i, [1.0, 2.0]) for i in range(200)]
    assert run(spark, rows, block_rows=16) == brute(rows, 5)


def test_rows_that_repeat_an_id_and_rows_without(spark):
    rng = random.Random(15)
    rows = [(i % 120, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(None, [rng.gauss(0, 2) for _ in range(8)]) for _ in range(30)]
    rows += [(50, rows[50][1]), (None, rows[0][1]), (None, rows[0][1])]
    rows = [(i, as_float32(v)) for i, v in rows]
    got = run(spark, rows, block_rows=40, query_rows=3)
    assert got == brute(rows, 5) and any(r[2] is None for r in got) and any(r[0] == r[2] for r in got)


def test_blocks_are_dealt_to_several_tasks(spark):
    rng = random.Random(16)
    rows = [(i, as_float32([rng.gauss(0, 1) for _ in range(4)])) for i in range(640)]
    for blocks in (8, 16):
        assert run(spark, rows, block_rows=640 // blocks, query_rows=2) == brute(rows, 5)
    for candidates, queries in ((1, 1), (8, 1), (16, 7), (64, 2), (100, 100), (5000, 100)):
        r, c = topk.grid(candidates, queries)
        assert r <= candidates and c <= queries and candidates * queries / (r * c) <= 2 * topk.CELL_PAIRS
        assert candidates * c + queries * r <= candidates * queries + 2 * max(candidates, queries)


def test_cutoff_saves_exact_scores():
    import numpy as np

    rng = np.random.default_rng(17)
    matrix = np.floor(256 * rng.normal(size=(4000, 64)) * np.exp(rng.normal(size=(4000, 1))))
    block = topk.Block(0, np.arange(4000), np.arange(4000), np.zeros(4000, bool), np.zeros(4000, bool), matrix)
    queries, heads = block.take(np.arange(20)), next(iter([block]))
    heads = topk.Block.of(next(topk._heads([block.row()])).to_pylist()[0])
    assert len(heads.ids) <= topk.SLICES * topk.HEAD
    cut = topk._merged(None, np.where(topk._own(queries, heads), -np.inf, queries.matrix @ heads.matrix.T), 5)[:, 4]
    at_q, _, _ = topk._sufficient(queries, cut, block)
    assert 100 <= len(at_q) < 20 * 4000 / 50
