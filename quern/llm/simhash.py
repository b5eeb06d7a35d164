"""SimHash near-dedup with BK-trees (operator 3).

Fingerprints are taken over whole texts. Two fingerprints within r bits agree on at least one of r + 1 blocks of bits,
and on what is left the same holds again, so distinct fingerprints are dealt to shards by a block of a block. Each
shard has its own BK-tree (children keyed by Hamming distance to the parent), and a query follows only the edges
within the radius. A fingerprint links to what it finds; components are joined up by a distributed minimum.

Where texts of a given Jaccard similarity are asked for (keep_similar), 64 bits are too few for blocks: at 0.8 about ten
differ. There the shards are MinHash bands of the shingles, the trees' radius is wide, and what they link is compared by
its shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_key, cleaned, components, named, plain, small_batches, trim, written

SEED = 42
RADIUS = 3
BANDS, BAND_ROWS = 32, 5
WIDE_RADIUS = 24
LARGE_SHARD, SLACK = 256, 8


def shingles(text: bytes, width: int) -> np.ndarray:
    """The XXH64 of every word shingle, repeats included; fewer words make one shingle, none at all no shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        spans = [(0, len(flat))]
    else:
        starts = np.concatenate([[0], ends[: len(words) - width] + 1])
        spans = zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], SEED) for a, b in spans], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = votes * 2 > len(hashes)
    return int(np.packbits(bits).view(">u8")[0])


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority bits of the XXH64 of every word shingle, repeats included; no words: zero."""
    return majority(shingles(text, width))


PRINTS = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])


def _prints(width: int):
    def run(batches):
        for batch in batches:
            for part in small_batches(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                prints = np.array([fingerprint(t or b"", width) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints)], schema=PRINTS)
        trim()

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, print): SimHash of A-Z lower-cased text over shingles of `width` words, as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_prints(width), "doc_id long, print long")


class BKTree:
    """Integers by Hamming distance: every child of a node is keyed by its distance to that node."""

    def __init__(self):
        self.root: tuple[int, dict] | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        node = self.root
        while d := (node[0] ^ x).bit_count():
            kid = node[1].get(d)
            if kid is None:
                node[1][d] = (x, {})
                return
            node = kid

    def within(self, x: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            at, kids = todo.pop()
            d = (at ^ x).bit_count()
            if d <= radius:
                found.append(at)
            if kids:
                todo += [kid for key, kid in kids.items() if d - radius <= key <= d + radius]
        return found


def shard_links(members: list[int], radius: int, slack: int = 0) -> list[tuple[int, int]]:
    """Links that connect whatever lies within the radius, found by one BK-tree over the members.

    With slack, members that close to one in the tree stay out of it and the radius is wider by as much: some more is
    linked, nothing less, and a large group of near copies leaves a small tree.
    """
    tree, root, links = BKTree(), {}, []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x in members:
        if x in root:
            continue
        root[x] = x
        found = tree.within(x, radius + slack)
        for y in found:
            a, b = top(x), top(y)
            if a != b:
                root[a] = b
                links.append((x, y))
        if not slack or not any((x ^ y).bit_count() <= slack for y in found):
            tree.add(x)
    return links


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _shards(radius: int, slack: int = 0):
    """Links within each run of equal shard keys of sorted input."""

    def links_of(keys, prints):
        """Links of whole shards."""
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        pairs = starts[sizes == 2]
        near = np.bitwise_count((prints[pairs] ^ prints[pairs + 1]).view(np.uint64)) <= radius
        a, b = [prints[pairs[near]]], [prints[pairs[near] + 1]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            links = shard_links(prints[s : s + n].view(np.uint64).tolist(), radius, slack if n > LARGE_SHARD else 0)
            if links:
                ends = np.array(links, np.uint64).view(np.int64)
                a.append(ends[:, 0])
                b.append(ends[:, 1])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=LINKS)

    def run(batches):
        left = []  # batches of a shard whose end has not come
        for batch in batches:
            keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            edge = int(np.searchsorted(keys, keys[-1]))
            if left and (edge or keys[0] != left[-1][0][-1]):
                left.append((keys[:edge], prints[:edge]))
                yield from links_of(*(np.concatenate(x) for x in zip(*left, strict=True)))
                left = []
            elif edge:
                yield from links_of(keys[:edge], prints[:edge])
            left.append((keys[edge:], prints[edge:]))
        if left:
            yield from links_of(*(np.concatenate(x) for x in zip(*left, strict=True)))
        trim()

    return run


def _shard_keys(value, radius: int):
    """Array of shard keys: a block of the 64 bits, then a block of the bits that are left."""
    keys, blocks = [], radius + 1
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    for i in range(blocks):
        rest = [b for b in range(64) if not cuts[i] <= b < cuts[i + 1]]
        inner = [round(len(rest) * j / blocks) for j in range(blocks + 1)]
        for j in range(blocks):
            bits = [*range(cuts[i], cuts[i + 1]), *rest[inner[j] : inner[j + 1]]]
            mask = sum(1 << b for b in bits)
            keys.append(F.xxhash64(value.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)), F.lit(i * blocks + j)))
    return F.array(*keys)


def near_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (print, component_id) for every distinct print of (doc_id, print).

    component_id is the smallest doc_id among documents whose prints are linked by steps of at most `radius` bits;
    null only where no document of the component has an id.
    """
    joined = near_roots(prints.groupBy("print").agg(F.min("doc_id").alias("first")), radius, _rows(prints))
    firsts = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return joined.select("print", "root").join(firsts, "root").select("print", "component_id")


def _rows(table: DataFrame) -> int:
    with cleaned(table.sparkSession):
        return table.count()


def near_roots(distinct: DataFrame, radius: int = RADIUS, rows: int = 0) -> DataFrame:
    """(print, first) with the smallest print of each one's component as root; rows: about how many there are."""
    dealt = by_key(distinct.select(F.explode(_shard_keys(F.col("print"), radius)).alias("shard"), "print"), rows * (radius + 1) ** 2, "shard").sortWithinPartitions("shard", "print")
    links = dealt.mapInArrow(_shards(radius), "a long, b long")
    roots = components(links)
    return distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))


def with_prints(rows: DataFrame, width: int = 3) -> DataFrame:
    """Rows of plain() with their fingerprints."""

    def run(batches):
        for batch in batches:
            for part in small_batches(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                prints = np.array([fingerprint(t or b"", width) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints)], names=[*part.schema.names, "print"])
        trim()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("print", T.LongType())]))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the smallest id, nulls last.

    Of rows that repeat that id one stays. Other columns pass through whatever their names.
    """
    rows, others = plain(docs, id_col, text_col)
    # keys of rows are fixed by being written down
    marked = written(with_prints(rows, width).withColumn("row_key", F.monotonically_increasing_id()))
    slim = marked.select("doc_id", "print", "row_key")
    roots = near_roots(slim.groupBy("print").agg(F.min("doc_id").alias("first")), radius, _rows(marked))
    # the first row of each print, then of each group of prints
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    best = slim.groupBy("print").agg(first.alias("first")).join(roots.select("print", "root"), "print").groupBy("root").agg(F.min("first").alias("first"))
    return named(marked.join(best.select("first.row_key"), "row_key", "left_semi"), others, docs, text_col)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64)
    return a | np.uint64(1), b


def bands(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key for each MinHash band of a set; sets of similarity s share one but for (1 - s^5)^32, 3e-6 at 0.8."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048, None] * a + b).min(0), out=least)
    rows = least.reshape(BANDS, -1)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64)


def _set(text: bytes | None, width: int) -> np.ndarray:
    """Distinct shingles, sorted; texts without words share one."""
    found = np.unique(shingles(text or b"", width))
    return found if len(found) else np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)


def _with_sketches(docs: DataFrame, width: int) -> DataFrame:
    """Rows of plain() with the digest of their set of shingles, its fingerprint and its bands."""

    def run(batches):
        a, b = _permutations()
        for batch in batches:
            for part in small_batches(batch, "text"):
                sets = [_set(t, width) for t in part.column("text").cast(pa.binary()).to_pylist()]
                digests = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                prints = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
                keys = np.concatenate([bands(s, a, b) for s in sets]).view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digests), pa.array(prints), keys], names=[*part.schema.names, "set", "print", "bands"])
        trim()

    more = [T.StructField("set", T.LongType()), T.StructField("print", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def _each_once(lists: list[list[int]]):
    """The members of all lists, one by one, as long as they are asked for."""
    seen = set()
    for members in lists:
        for j in members:
            if j not in seen:
                seen.add(j)
                yield j


def similar_sets(sets: list[np.ndarray], least: float) -> list[int]:
    """For each of the sorted sets the first one that it is linked to by steps of Jaccard similarity `least` or more.

    Sets that similar share one of their rarest shingles: of n, those that are left when least * n are taken off, and one.
    """
    root = list(range(len(sets)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def near(x: np.ndarray, y: np.ndarray) -> bool:
        if min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-9:
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / (len(x) + len(y) - both) >= least

    known, counts = np.unique(np.concatenate(sets), return_counts=True)
    # for a shingle the sets that have it among their rarest, by the first of what they are linked to; a set is compared with
    # those of a group only until one links it, so a large group of near copies takes a comparison or two for each
    index: dict[int, dict[int, list[int]]] = {}
    for i, s in enumerate(sets):
        rarest = s[np.argsort(counts[np.searchsorted(known, s)], kind="stable")][: len(s) - math.ceil(least * len(s) - 1e-9) + 1].tolist()
        groups: dict[int, list[list[int]]] = {}
        for h in rarest:
            by = index.get(h, {})
            for r in [r for r in by if root[r] != r]:
                moved = by.pop(r)
                by.setdefault(top(r), []).extend(moved)
            for r, members in by.items():
                groups.setdefault(r, []).append(members)
        for r, lists in groups.items():
            if top(r) == top(i):
                continue
            linked = next((j for j in _each_once(lists) if near(s, sets[j])), None)
            if linked is not None:
                a, b = top(i), top(linked)
                root[max(a, b)] = min(a, b)
        for h in rarest:
            index.setdefault(h, {}).setdefault(top(i), []).append(i)
    return [top(i) for i in range(len(sets))]


def _confirmed(width: int, least: float):
    """Rows (root, set, text) that arrive sorted by root to (set, group): the sets that are not alone in their group."""

    def groups(digests, sets):
        tops = similar_sets(sets, least)
        found = [(digests[i], digests[t]) for i, t in enumerate(tops) if i != t]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["set", "group"])

    def run(batches):
        at, digests, sets = None, [], []
        for batch in batches:
            for part in small_batches(batch, "text"):
                for root, digest, text in zip(part.column("root").to_pylist(), part.column("set").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    if root != at and sets:
                        yield groups(digests, sets)
                        digests, sets = [], []
                    at = root
                    digests.append(digest)
                    sets.append(_set(text, width))
        if sets:
            yield groups(digests, sets)
        trim()

    return run


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each group linked by Jaccard similarity of `least` or more: the smallest id, nulls last.

    Similarity is that of the sets of shingles of `width` words. Pairs are found by fingerprints within 24 bits in one of
    32 MinHash bands, which suits a similarity of 0.8 or more, and confirmed by their shingles; linked fingerprints meet
    in one task for that. Texts without words count as equal. Of rows that repeat the smallest id one stays. Other columns
    pass through whatever their names.
    """
    rows, others = plain(docs, id_col, text_col)
    marked = written(_with_sketches(rows, width).withColumn("row_key", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    distinct = written(marked.groupBy("set").agg(first.alias("first"), F.min("print").alias("print")))
    shard = marked.select(F.posexplode("bands").alias("band", "shard"), "print").select("shard", "print").distinct()
    dealt = by_key(shard, _rows(marked) * BANDS, "shard").sortWithinPartitions("shard", "print")
    roots = components(dealt.mapInArrow(_shards(WIDE_RADIUS, SLACK), "a long, b long"))
    placed = distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").select("set", "first.row_key", F.coalesce("root", "print").alias("root"))
    several = placed.join(placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "root")
    texts = several.select("root", "set", "row_key").join(marked.select("row_key", "text"), "row_key").select("root", "set", "text")
    groups = texts.repartition("root").sortWithinPartitions("root", "set").mapInArrow(_confirmed(width, least), "set long, group long")
    best = distinct.join(groups, "set", "left").groupBy(F.coalesce("group", "set").alias("group")).agg(F.min("first").alias("first"))
    return named(marked.join(best.select("first.row_key"), "row_key", "left_semi"), others, docs, text_col)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts, and those without words, have fingerprint zero and link like any other. Fewer words than
    `width` make one shingle of all of them. Rows that repeat an id each get a row; a null id never names a component
    that has other ids. An empty table gives no rows. Other columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, width))
    groups = near_groups(prints, radius)
    return prints.join(groups, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
