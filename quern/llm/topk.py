"""Exact top-k inner-product search by a three-phase uniform threshold (operator 2).

A score is a sum over slices of the components, and each slice keeps its own score list. Phase 1 gathers the heads of
these lists, the candidates of each block that are longest in a slice, and scores only those in full; the k-th best is a
cutoff that no true answer can miss. Phase 2 hands the cutoff to every block with the queries: of four slices one must
reach a quarter of it, so entries that reach it in none are below the cutoff for certain and the others are collected.
Phase 3 adds up what was collected exactly. Queries and candidates travel in blocks of bounded size. All pairs of blocks
have to meet; they are dealt to cells of a grid, so a block is copied once per row or column of it and not once per pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cleaned, trim, written

SLICES = 4
HEAD = 64  # candidates of a block that a slice's list gives to phase 1
CELL_PAIRS = 16  # pairs of blocks that meet in a cell
BLOCK = "b long, n_rows int, n_queries int, dim int, wide boolean, keys binary, ids binary, nulls binary, asked binary, data binary"
ARROW = pa.schema([("b", pa.int64()), ("n_rows", pa.int32()), ("n_queries", pa.int32()), ("dim", pa.int32()), ("wide", pa.bool_()), ("keys", pa.binary()), ("ids", pa.binary()), ("nulls", pa.binary()), ("asked", pa.binary()), ("data", pa.binary())])


class Block:
    """Vectors with their keys (each row has one of its own), ids (of which some may be null) and who asks."""

    def __init__(self, number: int, keys, ids, nulls, asked, matrix):
        self.number, self.keys, self.ids, self.nulls, self.asked, self.matrix = number, keys, ids, nulls, asked, matrix

    def take(self, rows: np.ndarray, number: int | None = None) -> Block:
        return Block(self.number if number is None else number, *(x[rows] for x in (self.keys, self.ids, self.nulls, self.asked, self.matrix)))

    def row(self) -> pa.RecordBatch:
        """As a row; components are 32-bit where they fit."""
        wide = bool(len(self.matrix)) and bool(np.abs(self.matrix).max(initial=0) > np.iinfo(np.int32).max)
        data = self.matrix if wide else self.matrix.astype(np.int32)
        values = (self.number, len(self.ids), int(self.asked.sum()), self.matrix.shape[1], wide, *(x.tobytes() for x in (self.keys, self.ids, self.nulls, self.asked, data)))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, ARROW.types, strict=True)], schema=ARROW)

    @classmethod
    def of(cls, row: dict) -> Block:
        keys, ids = (np.frombuffer(row[k], np.int64) for k in ("keys", "ids"))
        nulls, asked = (np.frombuffer(row[k], bool) for k in ("nulls", "asked"))
        data = np.frombuffer(row["data"], np.float64 if row["wide"] else np.int32).astype(np.float64)
        return cls(row["b"], keys, ids, nulls, asked, data.reshape(len(ids), row["dim"]))


def join(blocks: list[Block], number: int) -> Block:
    """All vectors as one block; shorter ones end in zeros."""
    dim = max(b.matrix.shape[1] for b in blocks)
    matrices = [np.pad(b.matrix, ((0, 0), (0, dim - b.matrix.shape[1]))) for b in blocks]
    return Block(number, *(np.concatenate([getattr(b, k) for b in blocks]) for k in ("keys", "ids", "nulls", "asked")), np.concatenate(matrices))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as rows, padded with zeros to the longest."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out


def _pack(scale: float):
    """A partition of (vec_id, asked, vector) as a block of floor(scale * x); its number is the partition's."""

    def run(batches):
        number, parts, known = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            n, ids = batch.num_rows, batch.column(0)
            keys = (number << 32) + known + np.arange(n, dtype=np.int64)
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            asked = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            parts.append(Block(number, keys, ids.fill_null(0).to_numpy(), nulls, asked, np.floor(scale * _matrix(batch.column(2)))))
            known += n
        if known:
            yield join(parts, number).row()
        trim()

    return run


def _blocks(batches):
    for batch in batches:
        yield from map(Block.of, batch.to_pylist())


def _asked(batches):
    """The queries of each block, as a block."""
    for block in _blocks(batches):
        if block.asked.any():
            yield block.take(np.flatnonzero(block.asked)).row()


def _rejoin(size: int):
    """Blocks of at most about `size` rows from those of a partition; numbered by place, so no two are alike."""

    def run(batches):
        place, made, parts = TaskContext.get().partitionId(), 0, []
        for block in _blocks(batches):
            parts.append(block)
            if sum(len(b.ids) for b in parts) >= size:
                yield join(parts, (place << 24) + made).row()
                made, parts = made + 1, []
        if parts:
            yield join(parts, (place << 24) + made).row()

    return run


def cuts(dim: int) -> list[tuple[int, int]]:
    edges = [round(dim * k / SLICES) for k in range(SLICES + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _heads(batches):
    """Of each block the candidates that are longest in a slice."""
    for block in _blocks(batches):
        chosen = np.zeros(len(block.ids), bool)
        for a, b in cuts(block.matrix.shape[1]):
            length = np.square(block.matrix[:, a:b]).sum(1)
            chosen[np.argpartition(-length, min(HEAD, len(length)) - 1)[:HEAD]] = True
        yield block.take(np.flatnonzero(chosen)).row()


def _slice_scores(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Partial scores of each slice, queries by candidates. Doubles are exact below 2**53; beyond it Python integers."""
    dim = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q, c))
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(dim, 1)
    if top >= 2.0**53:
        whole = np.vectorize(int, otypes=[object])
        q, c = (whole(x) if x.size else x.astype(object) for x in (q, c))
    return [q[:, a:b] @ c[:, a:b].T if b > a else np.zeros((len(q), len(c)), q.dtype) for a, b in cuts(dim)]


def _own(queries: Block, candidates: Block) -> np.ndarray:
    """Which pairs are a query and its own row."""
    order = np.argsort(candidates.keys)
    at = np.minimum(np.searchsorted(candidates.keys, queries.keys, sorter=order), len(order) - 1)
    hit = np.flatnonzero(candidates.keys[order[at]] == queries.keys)
    own = np.zeros((len(queries.ids), len(order)), bool)
    own[hit, order[at[hit]]] = True
    return own


def _cells(batches):
    """(queries and their cutoffs, candidates) for each pair of blocks of a cell, whose queries come first."""
    cell, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["cell"] != cell:
                cell, held = row["cell"], []
            if row["is_query"]:
                held.append((Block.of(row), None if row["cut"] is None else np.frombuffer(row["cut"])))
                continue
            candidates = Block.of(row)
            for queries, cut in held:
                yield cell, queries, cut, candidates


CUTS = pa.schema([("b", pa.int64()), ("scores", pa.binary())])


def _phase1(k: int):
    """The k best full scores of the heads, merged over a cell."""

    def run(batches):
        at, held = None, {}

        def rows():
            return [pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((b, s.tobytes()), CUTS.types, strict=True)], schema=CUTS) for b, s in held.items()]

        for cell, queries, _, heads in _cells(batches):
            if cell != at:
                yield from rows()
                at, held = cell, {}
            full = sum(_slice_scores(queries.matrix, heads.matrix)).astype(float)
            full[_own(queries, heads)] = -np.inf
            held[queries.number] = _merged(held.get(queries.number), full, k)
        yield from rows()
        trim()

    return run


def _merged(scores: np.ndarray | None, more: np.ndarray, k: int) -> np.ndarray:
    """The k best of both, in each row, best first; -inf where there are fewer."""
    both = more if scores is None else np.concatenate([scores, more], 1)
    best = -np.sort(-both, 1)[:, :k]
    return np.pad(best, ((0, 0), (0, k - best.shape[1])), constant_values=-np.inf)


def _cutoffs(k: int):
    """The cutoffs of each block of queries from its scores of all cells, which arrive together."""

    def run(batches):
        at, held = None, None
        for batch in batches:
            for b, scores in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != at and held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([held[:, k - 1].tobytes()])], names=["b", "cut"])
                    held = None
                at, held = b, _merged(held, np.frombuffer(scores).reshape(-1, k), k)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([held[:, k - 1].tobytes()])], names=["b", "cut"])

    return run


FOUND = pa.schema([("query_key", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _sufficient(queries: Block, cut: np.ndarray, candidates: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, exact score) of the entries that reach the cutoff."""
    # scores beyond a long tie at the nearest one, so the cutoff does too
    tau = np.where(cut < -(2.0**63), -np.inf, np.minimum(cut, 2.0**63))
    parts = _slice_scores(queries.matrix, candidates.matrix)
    exact = parts[0].dtype != object
    slack = 0.0 if exact else np.maximum(1.0, np.abs(np.where(np.isfinite(tau), tau, 0)) * 1e-9)
    share = ((tau - slack) / SLICES)[:, None]
    collected = np.zeros(parts[0].shape, bool)
    for p in parts:
        collected |= (p if exact else p.astype(float)) >= share
    collected &= ~_own(queries, candidates)
    at_q, at_c = np.nonzero(collected)
    scores = sum(p[at_q, at_c] for p in parts)
    enough = (scores if exact else scores.astype(float)) >= (tau - 2 * slack)[at_q]
    at_q, at_c, scores = at_q[enough], at_c[enough], scores[enough]
    scores = scores.astype(np.int64) if exact else np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in scores], np.int64)
    return at_q, at_c, scores


def _best(k: int, keys, query_ids, ids, nulls, scores):
    """Of each query's entries the k best: highest score, then smaller id, null last."""
    order = np.lexsort((ids, nulls, ~scores, keys))
    keys = keys[order]
    first = np.maximum.accumulate(np.where(np.concatenate([[True], keys[1:] != keys[:-1]]), np.arange(len(keys)), 0)) if len(keys) else keys
    order = order[np.arange(len(keys)) - first < k]
    return keys[np.arange(len(keys)) - first < k], *(x[order] for x in (query_ids, ids, nulls, scores))


def _phase23(k: int):
    """Entries that reach a slice's share of the cutoff, then exact scores of those; the k best of a cell for each query."""

    def run(batches):
        at, held = None, None

        def rows():
            if held is not None and len(held[0]):
                keys, query_ids, ids, nulls, scores = held
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(query_ids), pa.array(ids, mask=nulls), pa.array(scores)], schema=FOUND)

        for cell, queries, cut, candidates in _cells(batches):
            if cell != at:
                yield from rows()
                at, held = cell, None
            q, c, scores = _sufficient(queries, cut, candidates)
            new = (queries.keys[q], queries.ids[q], candidates.ids[c], candidates.nulls[c], scores)
            held = _best(k, *(new if held is None else (np.concatenate(x) for x in zip(held, new, strict=True))))
        yield from rows()
        trim()

    return run


def grid(candidates: int, queries: int) -> tuple[int, int]:
    """Rows and columns of a grid whose cells hold about CELL_PAIRS pairs of blocks with as few copies as can be."""
    cells = max(1, -(-candidates * queries // CELL_PAIRS))
    rows = min(candidates, max(1, round(math.sqrt(cells * candidates / queries))))
    return rows, min(queries, max(1, -(-cells // rows)))


def met(candidates: DataFrame, queries: DataFrame, rows: int, columns: int) -> DataFrame:
    """Blocks by cell, the queries first; each candidate in a row of the grid, each query in a column."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    keep = ["b", "dim", "wide", "keys", "ids", "nulls", "asked", "data"]
    asked = queries.select(*keep, "cut", F.pmod(F.shiftright("b", 24), F.lit(columns)).alias("column"), every(rows).alias("row"))
    given = candidates.select(*keep, F.lit(None).cast("binary").alias("cut"), F.pmod("b", F.lit(rows)).alias("row"), every(columns).alias("column"))
    both = asked.withColumn("is_query", F.lit(True)).unionByName(given.withColumn("is_query", F.lit(False)))
    cells = both.select(*keep, "cut", "is_query", (F.col("row") * F.lit(columns) + F.col("column")).alias("cell"))
    return cells.repartitionById(min(rows * columns, 1 << 17), F.pmod("cell", F.lit(1 << 17)).cast("int")).sortWithinPartitions("cell", F.col("is_query").desc(), "b")


def search(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 4096, query_rows: int = 512) -> DataFrame:
    """The k best candidates of every query row by integer inner product of floor(scale * x).

    is_query: condition on id_col that marks queries (null: none). Candidates are all rows but the query's own, so rows
    that repeat its id are candidates, each is a query if it asks, and a row without an id is a candidate with a null
    vec_id. Rows whose vector is null or holds null, NaN or infinite components take no part. Vectors of different
    lengths are padded with zeros, so an empty one scores 0. Ties go to the smaller id, null last. Scores beyond a long
    are given, and ranked, as the nearest long. Other columns are not read.
    """
    x = F.col("vector")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), is_query.alias("asked"), F.col(vec_col).cast("array<double>").alias("vector")).where(x.isNotNull() & usable)
    with cleaned(vectors.sparkSession):
        blocks = max(1, -(-vectors.count() // block_rows))
    candidates = written(rows.repartition(blocks).mapInArrow(_pack(scale), BLOCK))
    with cleaned(vectors.sparkSession):
        asked = candidates.agg(F.sum("n_queries")).first()[0] or 0
    places = max(1, -(-asked // query_rows))
    queries = written(candidates.where("n_queries > 0").mapInArrow(_asked, BLOCK).repartition(places).mapInArrow(_rejoin(query_rows), BLOCK))
    rows_, columns = grid(blocks, places)
    heads = candidates.mapInArrow(_heads, BLOCK)
    scores = met(heads, queries.withColumn("cut", F.lit(None).cast("binary")), rows_, columns).mapInArrow(_phase1(k), "b long, scores binary")
    cut = written(scores.repartitionById(places, F.shiftright("b", 24).cast("int")).sortWithinPartitions("b").mapInArrow(_cutoffs(k), "b long, cut binary"))
    found = met(candidates, queries.join(cut, "b"), rows_, columns).mapInArrow(_phase23(k), "query_key long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_key").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
