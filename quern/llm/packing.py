"""Packing documents into token sequences by first-fit decreasing (operator 4).

Documents are dealt evenly to tasks, equal ones too, and taken there in random order in groups of bounded size, by
documents and by tokens. A group cuts whole sequences off long documents, then puts
the rests, longest first, each into the first bin with room for it; a tournament tree over the bins' free room finds
that bin in logarithmic time. The emptiest bins are then dissolved into the gaps of the others.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cleaned, small_batches, trim
from .words import IdStore, ascii_words, factorise

LENGTH = 2048
GROUP_DOCS, GROUP_TOKENS = 2048, 4 << 20


class TournamentTree:
    """Free room of bins; each inner node holds the most room below it."""

    def __init__(self, size: int):
        self.leaves = 1 << max(0, (size - 1).bit_length())
        self.room = [0] * (2 * self.leaves)

    def set(self, leaf: int, room: int) -> None:
        at = leaf + self.leaves
        self.room[at] = room
        at >>= 1
        while at:
            self.room[at] = max(self.room[2 * at], self.room[2 * at + 1])
            at >>= 1

    def first(self, need: int) -> int:
        """The first bin with `need` room, or -1."""
        if self.room[1] < need:
            return -1
        at = 1
        while at < self.leaves:
            at = 2 * at if self.room[2 * at] >= need else 2 * at + 1
        return at - self.leaves


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in sizes; every size from 1 to capacity."""
    bins: list[list[int]] = []
    tree = TournamentTree(max(1, len(sizes)))
    free = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = tree.first(sizes[i])
        if at < 0:
            at = len(bins)
            bins.append([])
            free.append(capacity)
        bins[at].append(i)
        free[at] -= sizes[i]
        tree.set(at, free[at])
    return bins


def pack_group(lengths: list[int], capacity: int = LENGTH, least_piece: int = 32) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document's position, start, length) that hold every token of the documents once.

    Gaps of at least least_piece tokens are filled from the emptiest bins, so that few sequences need padding.
    """
    whole, rests = [], []
    for i, n in enumerate(lengths):
        cut = n - n % capacity
        whole += [[(i, a, capacity)] for a in range(0, cut, capacity)]
        if n > cut:
            rests.append((i, cut, n - cut))
    bins = [[rests[k] for k in b] for b in first_fit_decreasing([r[2] for r in rests], capacity)]
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-fill[b], b))
    gaps = [b for b in order if capacity - fill[b] >= least_piece]
    alive = set(range(len(bins)))
    while len(gaps) > 1:
        last = gaps[-1]
        if sum(capacity - fill[b] for b in gaps[:-1]) < fill[last]:
            break
        alive.discard(last)
        gaps.pop()
        todo = bins[last][::-1]
        while todo and gaps:
            i, start, n = todo.pop()
            b = gaps[0]
            take = min(n, capacity - fill[b])
            bins[b].append((i, start, take))
            fill[b] += take
            if take < n:
                todo.append((i, start + take, n - take))
            if capacity - fill[b] < least_piece:
                gaps.pop(0)
        if todo:
            bins[last] = todo
            fill[last] = sum(p[2] for p in todo)
            alive.add(last)
            break
    return whole + [bins[b] for b in order if b in alive]


def padding(fill: int, capacity: int = LENGTH) -> int:
    """Padding of a sequence: none at a power of two, else up to the capacity."""
    return 0 if fill & (fill - 1) == 0 else capacity - fill


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _store(path: str) -> IdStore:
    tokenizer = _tokenizer(path)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """White space is dropped by this vocabulary, so words are encoded side by side and told apart by offsets."""
        ids, lengths = [], []
        for at in range(0, len(words), 256):
            part = words[at : at + 256]
            found = tokenizer.encode(" ".join(part), add_special_tokens=False)
            edges = np.cumsum([len(w) + 1 for w in part])
            starts = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
            ids.append(np.array(found.ids, np.int64))
            lengths.append(np.bincount(np.searchsorted(edges, starts, side="right"), minlength=len(part)))
        return (np.concatenate(ids), np.concatenate(lengths)) if ids else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    return IdStore(encode)


TOKENS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _tokenise(path: str, end_id: int):
    if not 0 <= end_id < 1 << 16:
        raise ValueError(f"end_id: {end_id}")

    def run(batches):
        store = _store(path)
        for batch in batches:
            for part in small_batches(batch, "text", 8 << 20):
                flat, sizes = store.ids(*factorise(pc.fill_null(part.column("text"), ""), ascii_words))
                edges, rows = np.concatenate([[0], np.cumsum(sizes)]).tolist(), []
                for a, b in zip(edges, edges[1:], strict=False):
                    rows.append(np.append(flat[a:b], np.uint16(end_id)).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes + 1), pa.array(rows, pa.binary())], schema=TOKENS)
        trim()

    return run


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _pack(capacity: int, with_ids: bool, group_docs: int, group_tokens: int):
    def run(batches):
        place, made, held, tokens = TaskContext.get().partitionId() << 32, 0, [], 0

        def close(group):
            nonlocal made
            rows = []
            for sequence in pack_group([n for _, n, _ in group], capacity):
                at = 0
                for i, start, n in sequence:
                    doc, whole, ids = group[i]
                    piece = np.frombuffer(ids, "<u2", n, 2 * start).astype("<u4").tobytes()
                    rows.append((doc, start, n, zlib.crc32(piece), whole, place + made, at, piece if with_ids else None))
                    at += n
                made += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                tokens += row[1]
                # half a group more is held, so that what is left at the end is never a small group
                if 2 * len(held) >= 3 * group_docs or 2 * tokens >= 3 * group_tokens:
                    n = total = 0
                    while n < group_docs and total < group_tokens:
                        total += held[n][1]
                        n += 1
                    yield close(held[:n])
                    held, tokens = held[n:], tokens - total
        if held:
            yield close(held)
        trim()

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = LENGTH, end_id: int = 1, group_docs: int = GROUP_DOCS, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most `capacity` tokens; a row per piece.

    tokenizer: path of a vocabulary that drops white space and never joins across it; ids of 65536 or more raise a
    ValueError. Each document is its ids and end_id; a null or empty text is end_id alone. Every id lies in one piece, and
    offsets in a sequence have no gaps. Groups hold about group_docs documents or group_tokens tokens, whichever is less.
    Rows that repeat an id are packed each; a null id stays null. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with cleaned(docs.sparkSession):
        parts = max(1, min(1 << 17, -(-rows.count() // (2 * group_docs))))
    tokens = rows.mapInArrow(_tokenise(tokenizer, end_id), "doc_id long, n_tokens long, ids binary")
    # dealt in turn, so neither equal rows nor any key meet in a task; the order there is that of a hash
    dealt = tokens.repartition(parts).sortWithinPartitions(F.xxhash64("doc_id", "n_tokens", F.crc32("ids")), "doc_id", "n_tokens", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    out = dealt.mapInArrow(_pack(capacity, with_ids, group_docs, group_tokens), schema)
    return out if with_ids else out.drop("ids")
