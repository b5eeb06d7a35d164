"""Suffix-array dedup of repeated byte strings (operator 9).

A window is a string of `least` (50) bytes. Each window names one of its own 20-byte strings as its seed by its content
alone (a minimiser), so equal windows name equal seeds; windows in a row with one seed form a segment. Segments are
dealt by seed. What documents share lies in segments of seeds that they share, so only those go, as text, to two-stage
suffix sorting: suffixes smaller than their successors are sorted directly, the rest is induced by scans of the buckets,
and adjacent common prefixes of at least 50 bytes show equal windows. What is removed goes back to the documents by id.

About 17 bytes travel for every 15 bytes of text, packed into a row per task and bucket. Segments that are equal
byte by byte are merged in the 8 MB of text that a task looks at together. Where over four of those still hold a segment, the
further ones are settled by its 64-bit digest and not sorted, so that no task gets one segment from all of them; and a seed
that more than hot_seed segments share is dealt by whole windows. Both change the path and not what is removed.

A row is addressed by its id and a 64-bit hash of its text; rows without an id by 126 bits of it. So rows that share an
id, or have none, lie in different buckets unless their texts are equal too, and then the same holds for all of them.
Texts stream past what is known of their bucket; no task holds the documents of one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cleaned, discard, ranges, small_batches, trim, written

LEAST = 50
SEED_BYTES = 20
SPREAD = LEAST - SEED_BYTES + 1  # seeds a window can choose from
ANCHOR = 20  # bytes whose smallest hash decides; equal to SEED_BYTES modulo SPREAD
PIECE = 1 << 19
HOT_SEED = 4096
MOST_EQUAL = 4
LAST = np.iinfo(np.int64).max  # the rank of a null id: never smaller than another
MOST_PARTS = 1 << 17
END = 0xFF  # no byte of UTF-8
DEPTH = 56

C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words_at_every_byte(flat: np.ndarray, big: bool = False) -> np.ndarray:
    """The 8 bytes from each position as an integer; bytes after the end count as zero."""
    w = flat.astype(np.uint64)
    for k in (1, 2, 4):
        nxt = np.zeros_like(w)
        nxt[:-k or None] = w[k:] if len(w) > k else 0
        w = (w << np.uint64(8 * k)) | nxt if big else w | (nxt << np.uint64(8 * k))
    return w


def mix(*columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of rows of words."""
    h = np.full(len(columns[0]), C3)
    for c in columns:
        h = (h ^ (c * C1)) * C2
        h ^= h >> np.uint64(31)
    h *= C1
    return h ^ (h >> np.uint64(29))


def _words(size: int) -> tuple[int, ...]:
    """Where to read words of 8 bytes that cover so many bytes."""
    return *range(0, size - 8, 8), size - 8


def window_hash(w8: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(*(w8[at + k] for k in _words(LEAST)))


def segments(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Segments of the texts that lie in flat: (text's number, first window, windows, seed hash, digest)."""
    n = len(flat)
    if n < LEAST:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    w8 = words_at_every_byte(flat)
    # the smallest anchor of each window, the leftmost among equals: position in the low bits
    anchors = n - ANCHOR + 1
    best = (mix(*(w8[k : k + anchors] for k in _words(ANCHOR))) & ~np.uint64((1 << 26) - 1)) | np.arange(anchors, dtype=np.uint64)
    span, width = LEAST - ANCHOR + 1, 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if span > width:
        best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
    i = np.arange(n - LEAST + 1)
    seed = i + ((best & np.uint64((1 << 26) - 1)).astype(np.int64) - i) % SPREAD
    valid = np.zeros(len(i), bool)
    count = np.maximum(lengths - LEAST + 1, 0)
    valid[ranges(starts, count)] = True
    begin = np.zeros(len(i), bool)
    begin[starts[count > 0]] = True
    begin[1:] |= seed[1:] != seed[:-1]
    begin &= valid
    first = np.flatnonzero(begin)
    ends = np.flatnonzero(valid & ~np.append(valid[1:] & ~begin[1:], False))
    size = ends - first + 1
    text = np.searchsorted(starts, first, side="right") - 1
    s = seed[first]
    return text, first, size, mix(*(w8[s + k] for k in _words(SEED_BYTES))), mix(window_hash(w8, first), window_hash(w8, ends), size.astype(np.uint64))


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.uint32).tobytes(), *(a.tobytes() for a in arrays)])


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob, np.uint32, len(kinds)), 4 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


# Documents are given by id and tag (see addressed()), each with the number of its entries.
# What is removed: first byte of a run of windows, windows in it.
MARK = ("<i8", "<u8", "<u4", "<u4", "<u4")
# Seeds of a bucket: for each the low half of its hash, the segment's digest, place and windows.
SEED = ("<i8", "<u8", "<u4", "<u4", "<u8", "<u4", "u1")
# Segments to compare: key, first window, windows; when they have been read, with the bytes of all of them.
ASK = ("<i8", "<u8", "<u4", "<u8", "<u4", "u1")
TEXT = (*ASK, "u1")
ROWS = "kind string, bucket long, blob binary"
ARROW = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("blob", pa.binary())])


def _rows(rows: list[tuple[str, int, bytes]]):
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), ARROW.types, strict=True)], schema=ARROW)


def _split(bucket: np.ndarray):
    """(bucket, positions) of each bucket that occurs, positions in their old order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]])) if len(order) else np.zeros(1, int)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(bucket[order[a]]), order[a:b]


def doc_bucket(doc: np.ndarray, tag: np.ndarray, buckets: int) -> np.ndarray:
    """Which bucket of documents a row belongs to, as in addressed()."""
    return ((tag >> np.uint64(1)).astype(np.int64) ^ doc.astype(np.int64)) % buckets


def rank(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """What ids are compared by: a null one comes last."""
    return np.where(tag & np.uint64(1), LAST, doc)


def pack_docs(kinds, doc, tag, *columns, last=()) -> bytes:
    """Entries of documents, those of one next to each other; `last` holds what is not a value per entry."""
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])) if len(doc) else np.zeros(0, np.int64)
    arrays = (doc[edge], tag[edge], np.diff(np.append(edge, len(doc))), *columns, *last)
    return pack(*(np.ascontiguousarray(x).astype(k) for x, k in zip(arrays, kinds, strict=True)))


def unpack_docs(blobs: list[bytes], kinds) -> list[np.ndarray]:
    """(doc, tag, columns ...) of the entries of all blobs."""
    parts = [unpack(b, *kinds) for b in blobs]
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds)]
    return [np.repeat(columns[0], columns[2]), np.repeat(columns[1], columns[2]), *columns[3:]]


def _by_doc(kind: str, kinds, buckets: int, doc, tag, *columns):
    """Rows of entries, dealt by document."""
    order = np.lexsort((tag, doc))
    doc, tag, *columns = (x[order] for x in (doc, tag, *columns))
    for b, where in _split(doc_bucket(doc, tag, buckets)):
        yield kind, b, pack_docs(kinds, doc[where], tag[where], *(x[where] for x in columns))


def _mark_rows(doc, tag, at, n, buckets: int):
    return _by_doc("mark", MARK, buckets, doc, tag, at, n)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys for each of sorted rows."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _first_docs(seed, digest, doc):
    """Order by (seed, digest), and the smallest document of each row's group, in that order."""
    order = np.lexsort((doc, digest, seed))
    group = _groups(seed[order], digest[order]) if len(order) else np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0])) if len(order) else np.zeros(0, np.int64)
    return order, doc[order][starts][group] if len(order) else doc


def _equal(raw: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether segments of m and n windows at a and at b are the same bytes."""
    same = m == n
    where = np.flatnonzero(same)
    for at in range(0, len(where), 1 << 15):
        w = where[at : at + (1 << 15)]
        size = m[w].astype(np.int64) + LEAST - 1
        alike = raw[ranges(a[w], size)] == raw[ranges(b[w], size)]
        same[w] = np.logical_and.reduceat(alike, np.cumsum(size) - size)
    return same


def _seeds(buckets: int, flush: int = 8 << 20):
    """Seeds by bucket; of equal segments met here only those of the smallest document go on, the rest is removed."""

    def close(heads, held):
        docs, tags = (np.concatenate([h[k] for h in heads]) for k in (0, 1))
        which, at, n, seed, digest = (np.concatenate([h[k] for h in held]) for k in range(5))
        sizes = np.array([len(h[6]) for h in held])
        place = np.concatenate([h[5] + base for h, base in zip(held, (np.cumsum(sizes) - sizes).tolist(), strict=True)])
        doc, tag = docs[which], tags[which]
        order, least = _first_docs(seed, digest, rank(doc, tag))
        later = rank(doc, tag)[order] > least
        first = order[np.maximum.accumulate(np.where(np.concatenate([[True], (seed[order][1:] != seed[order][:-1]) | (digest[order][1:] != digest[order][:-1])]), np.arange(len(order)), 0))]
        gone, like = order[later], first[later]
        gone = gone[_equal(np.concatenate([h[6] for h in held]), place[gone], n[gone], place[like], n[like])]
        stay = np.ones(len(doc), bool)
        stay[gone] = False
        yield from _rows(list(_mark_rows(doc[gone], tag[gone], at[gone], n[gone], buckets)))
        place = np.flatnonzero(stay)
        out = []
        for b, sub in _split((seed[place] >> np.uint64(32)).astype(np.int64) % buckets):
            p = place[sub]
            out.append(("seed", b, pack_docs(SEED, doc[p], tag[p], seed[p] & np.uint64(0xFFFFFFFF), digest[p], at[p], n[p])))
        yield from _rows(out)

    def run(batches):
        heads, held, known, size = [], [], 0, 0
        for batch in batches:
            for part in small_batches(batch, "text", 1 << 20):
                heads.append((part.column("doc").to_numpy(), part.column("tag").to_numpy().view(np.uint64)))
                todo, weight = [], 0
                for k, t in enumerate(part.column("text").cast(pa.binary()).to_pylist(), known):
                    t = t or b""
                    for a in range(0, max(1, len(t) - LEAST + 1), PIECE):
                        todo.append((k, a, t[a : a + PIECE + LEAST - 1]))
                        weight += len(todo[-1][2])
                        if weight >= PIECE:
                            held.append(_found(todo))
                            todo, size, weight = [], size + weight, 0
                        if size >= flush:
                            yield from close(heads, held)
                            held, size = [], 0
                if todo:
                    held.append(_found(todo))
                    size += weight
                known += part.num_rows
                size += 16 * part.num_rows
                if size >= flush:
                    yield from close(heads, held)
                    heads, held, known, size = [], [], 0, 0
        if held:
            yield from close(heads, held)
        trim()

    return run


def _found(pieces):
    """Segments of (document's number, offset, bytes) pieces, with offsets in their documents; where they lie in the bytes."""
    lengths = np.array([len(p[2]) for p in pieces])
    starts = np.cumsum(lengths) - lengths
    flat = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    text, first, n, seed, digest = segments(flat, starts, lengths)
    which, offset = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    return which[text], first - starts[text] + offset[text], n, seed, digest, first, flat


def _by_bucket(batches):
    """(kind, bucket, blobs) of rows that arrive sorted by kind and bucket."""
    key, blobs = None, []
    for batch in batches:
        for kind, bucket, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (kind, bucket) != key:
                if blobs:
                    yield *key, blobs
                key, blobs = (kind, bucket), []
            blobs.append(blob)
    if blobs:
        yield *key, blobs


def _settle(buckets: int, hot_seed: int):
    """Segments of a seed that different documents share, as candidates."""

    def run(batches):
        for kind, bucket, blobs in _by_bucket(batches):
            if kind == "mark":
                yield from _rows([("mark", bucket, b) for b in blobs])
                continue
            doc, tag, seed, digest, at, n = unpack_docs(blobs, SEED)
            by = rank(doc, tag)
            order, least = _first_docs(seed, digest, by)
            same = _groups(seed[order], digest[order]) if len(order) else order
            gone = (by[order] > least) & (np.arange(len(order)) - np.searchsorted(same, same) >= MOST_EQUAL)
            out = list(_mark_rows(*(x[order[gone]] for x in (doc, tag, at, n)), buckets))
            rest = order[~gone]
            if len(rest):
                group = _groups(seed[rest])
                starts = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
                several = (np.maximum.reduceat(by[rest], starts) > np.minimum.reduceat(by[rest], starts))[group]
                hot = (np.diff(np.append(starts, len(rest))) > hot_seed)[group][several]
                r = rest[several]
                key = np.where(hot, np.uint64(0), mix(seed[r].astype(np.uint64), np.full(len(r), bucket, np.uint64)) | np.uint64(1))
                out += _by_doc("ask", ASK, buckets, doc[r], tag[r], key, at[r], n[r])
            yield from _rows(out)
        trim()

    return run


class Entries:
    """The entries of a bucket of documents, looked up by document."""

    def __init__(self, blobs: list[bytes], kinds):
        doc, tag, *columns = unpack_docs(blobs, kinds)
        order = np.lexsort((tag, doc))
        doc, tag, *self.columns = (x[order] for x in (doc, tag, *columns))
        edges = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])) if len(doc) else np.zeros(0, np.int64)
        self.where = dict(zip(zip(doc[edges].tolist(), tag[edges].tolist(), strict=True), zip(edges.tolist(), np.append(edges, len(doc))[1:].tolist(), strict=True), strict=True))

    def of(self, doc: int, tag: int) -> list[np.ndarray] | None:
        found = self.where.get((doc, tag))
        return None if found is None else [c[found[0] : found[1]] for c in self.columns]


def _beside(batches, kinds, limit: int = 2 << 20):
    """(entries of the bucket, documents) for slices of the documents of a bucket, whose entries come before them."""
    bucket, blobs, entries = None, [], None
    for batch in batches:
        keys, is_doc = batch.column("bucket").to_numpy(), batch.column("blob").is_null().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (is_doc[1:] != is_doc[:-1]), [True]])).tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            part = batch.slice(a, b - a)
            if keys[a] != bucket:
                bucket, blobs, entries = keys[a], [], None
            if not is_doc[a]:
                blobs += part.column("blob").to_pylist()
                continue
            if entries is None:
                entries, blobs = Entries(blobs, kinds), []
            for small in small_batches(part, "text", limit):
                yield entries, small


def _texts_of(buckets: int, flush: int = 4 << 20):
    """Candidates with their bytes, by key; a hot seed's windows each on their own."""

    def close(held):
        doc, tag, key, at, n = (np.concatenate([h[k] for h in held]) for k in range(5))
        raw, out = np.concatenate([h[5] for h in held]), []
        size = n.astype(np.int64) + LEAST - 1
        start = np.cumsum(size) - size
        hot = np.flatnonzero(key == 0)
        if len(hot):
            wide = n[hot].astype(np.int64)
            src, step = np.repeat(hot, wide), ranges(np.zeros(len(hot), np.int64), wide)
            hashed = window_hash(words_at_every_byte(np.append(raw, np.zeros(8, np.uint8))), start[src] + step) | np.uint64(1)
            # of equal windows here the smallest document's go on
            by = rank(doc[src], tag[src])
            order, least = _first_docs(hashed, hashed, by)
            gone = order[by[order] > least]
            out += _mark_rows(doc[src][gone], tag[src][gone], at[src][gone] + step[gone], np.ones(len(gone), np.int64), buckets)
            left = np.ones(len(src), bool)
            left[gone] = False
            src, step, hashed, cold = src[left], step[left], hashed[left], np.flatnonzero(key != 0)
            start, size = np.concatenate([start[cold], start[src] + step]), np.concatenate([size[cold], np.full(len(src), LEAST)])
            key, at, n = np.concatenate([key[cold], hashed]), np.concatenate([at[cold], at[src] + step.astype("<u4")]), np.concatenate([n[cold], np.ones(len(src), "u1")])
            doc, tag = (np.concatenate([x[cold], x[src]]) for x in (doc, tag))
        for b, where in _split((key >> np.uint64(20)).astype(np.int64) % buckets):
            out.append(("text", b, pack_docs(TEXT, doc[where], tag[where], key[where], at[where], n[where], last=(raw[ranges(start[where], size[where])],))))
        yield from _rows(out)

    def run(batches):
        held, size = [], 0
        for entries, part in _beside(batches, ASK):
            for doc, tag, text in zip(part.column("doc").to_pylist(), part.column("tag").to_numpy().view(np.uint64).tolist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found = entries.of(doc, tag)
                if found is None:
                    continue
                key, at, n = found
                # a document may have more candidates than are held at a time
                for a in range(0, len(at), 1 << 16):
                    where = slice(a, a + (1 << 16))
                    raw = np.frombuffer(text, np.uint8)[ranges(at[where].astype(np.int64), n[where].astype(np.int64) + LEAST - 1)]
                    held.append((np.full(len(at[where]), doc), np.full(len(at[where]), tag, np.uint64), key[where], at[where], n[where], raw))
                    size += len(raw)
                    if size >= flush:
                        yield from close(held)
                        held, size = [], 0
        if held:
            yield from close(held)
        trim()

    return run


def suffix_array(flat: np.ndarray) -> np.ndarray:
    """Suffixes of flat in order of their first DEPTH bytes, by two-stage sorting.

    Suffixes smaller than their successor are sorted directly, word by word, only ties going on. A scan of the buckets
    in order then puts the predecessor of each suffix, where it is larger than its successor, at its bucket's head.
    """
    n = len(flat)
    sa = np.full(n, -1, np.int64)
    if not n:
        return sa
    # the type of a suffix whose next byte is equal is that of its successor
    step = np.append(np.sign(flat[1:].astype(np.int16) - flat[:-1]), -1)
    upto = np.where(step != 0, np.arange(n), n - 1)
    smaller = step[np.minimum.accumulate(upto[::-1])[::-1]] > 0
    direct = np.flatnonzero(smaller)
    words = words_at_every_byte(flat, big=True)
    group = np.zeros(len(direct), np.int64)
    order, todo = direct.copy(), np.arange(len(direct))
    for k in range(0, DEPTH, 8):
        at = order[todo] + k
        key = np.where(at < n, words[np.minimum(at, n - 1)], np.uint64(0))
        by = np.argsort(key)
        if k:
            # by group and then by word: two sorts of plain integers are faster than one of pairs
            change = np.concatenate([[0], key[by][1:] != key[by][:-1]]) if len(by) else by
            place = np.empty(len(by), np.int64)
            place[by] = np.cumsum(change)
            by = np.argsort(group[todo] << 32 | place)
        order[todo], key, held = order[todo][by], key[by], group[todo][by]
        change = np.concatenate([[True], (key[1:] != key[:-1]) | (held[1:] != held[:-1])]) if len(by) else np.zeros(0, bool)
        group[todo] = todo[np.maximum.accumulate(np.where(change, np.arange(len(by)), 0))] if len(by) else group[todo]
        tied = ~change
        if len(by):
            tied[:-1] |= ~change[1:]
        todo = todo[tied]
        if not len(todo):
            break
    sizes, below = np.bincount(flat, minlength=256), np.bincount(flat[direct], minlength=256)
    start = np.cumsum(sizes) - sizes
    head, tail = start.copy(), start + sizes - below
    first = np.cumsum(below) - below
    for c in np.flatnonzero(below).tolist():
        sa[tail[c] : tail[c] + below[c]] = order[first[c] : first[c] + below[c]]

    def induce(found: np.ndarray) -> None:
        p = found - 1
        p = p[p >= 0]
        p = p[~smaller[p]]
        if not len(p):
            return
        ch = flat[p]
        by = np.argsort(ch, kind="stable")
        count = np.bincount(ch, minlength=256)
        sa[np.repeat(head - (np.cumsum(count) - count), count) + np.arange(len(p))] = p[by]
        head[:] += count

    sa[head[flat[n - 1]]] = n - 1
    head[flat[n - 1]] += 1
    for c in np.flatnonzero(sizes).tolist():
        at = start[c]
        while at < head[c]:
            end = head[c]
            induce(sa[at:end].copy())
            at = end
        induce(sa[tail[c] : tail[c] + below[c]].copy())
    return sa


def repeated_windows(raw: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window in it) of each window that a segment of a smaller document holds too.

    raw: segments side by side, of n windows each (so n + LEAST - 1 bytes).
    """
    lengths = n.astype(np.int64) + LEAST - 1
    starts = np.cumsum(lengths + 1) - lengths - 1
    flat = np.full(int((lengths + 1).sum()), END, np.uint8)
    flat[ranges(starts, lengths)] = raw
    which = np.full(len(flat), -1, np.int64)
    which[ranges(starts, n.astype(np.int64))] = np.repeat(np.arange(len(n)), n)
    sa = suffix_array(flat)
    sa = sa[which[sa] >= 0]
    words = words_at_every_byte(flat)
    # adjacent common prefixes of at least LEAST bytes
    same = np.ones(max(0, len(sa) - 1), bool)
    for k in (*range(0, LEAST - 8, 8), LEAST - 8):
        w = words[sa + k]
        same &= w[1:] == w[:-1]
    group = np.concatenate([[0], np.cumsum(~same)]) if len(sa) else sa
    starts_of = np.flatnonzero(np.concatenate([[True], ~same])) if len(sa) else sa
    owner = doc[which[sa]]
    least = np.minimum.reduceat(owner, starts_of)[group] if len(sa) else owner
    hit = sa[owner > least]
    return which[hit], hit - starts[which[hit]]


def _compare(buckets: int, chunk: int = 1 << 18):
    """Windows that segments of one key share, key by key in chunks of bounded size."""

    def run(batches):
        for kind, bucket, blobs in _by_bucket(batches):
            if kind == "mark":
                yield from _rows([("mark", bucket, b) for b in blobs])
                continue
            doc, tag, key, at, n, raw = unpack_docs(blobs, TEXT)
            lengths = n.astype(np.int64) + LEAST - 1
            starts = np.cumsum(lengths) - lengths
            order = np.argsort(key, kind="stable")
            edges = np.append(np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])), len(order))
            size = np.concatenate([[0], np.cumsum(lengths[order])])
            a = 0
            while a < len(order):
                b = int(edges[min(len(edges) - 1, np.searchsorted(size[edges], size[a] + chunk))])
                b = b if b > a else int(edges[np.searchsorted(edges, a, side="right")])
                rows = order[a:b]
                seg, step = repeated_windows(raw[ranges(starts[rows], lengths[rows])], rank(doc[rows], tag[rows]), n[rows])
                by = np.lexsort((step, seg))
                seg, step = seg[by], step[by]
                # windows in a row are one entry
                begin = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (step[1:] != step[:-1] + 1)])) if len(seg) else seg
                hit = rows[seg[begin]]
                yield from _rows(list(_mark_rows(doc[hit], tag[hit], at[hit] + step[begin], np.diff(np.append(begin, len(seg))), buckets)))
                a = b
        trim()

    return run


def covered(length: int, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, int]:
    """Bytes under runs of windows, and the number of maximal runs of such bytes."""
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n.astype(np.int64) + LEAST - 1, -1)
    gone = np.cumsum(edge[:length]) > 0
    return gone, int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def _apply(entries: Entries, docs: pa.RecordBatch):
    """(kept bytes, removed bytes, spans) of documents."""
    for doc, tag, text in zip(docs.column("doc").to_pylist(), docs.column("tag").to_numpy().view(np.uint64).tolist(), docs.column("text").cast(pa.binary()).to_pylist(), strict=True):
        text, found = text or b"", entries.of(doc, tag)
        if found is None:
            yield text, 0, 0
            continue
        gone, spans = covered(len(text), found[0].astype(np.int64), found[1])
        yield np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with its columns as c0, c1, ... and then doc, tag and text.

    doc is the id, or for a null one a hash of the text; tag is another hash of it, odd where the id is null.
    """
    text, key = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    tag = F.xxhash64(text).bitwiseAND(-2).bitwiseOR(key.isNull().cast("long"))
    others = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col]
    return docs.select(*others, F.coalesce(key, F.xxhash64(F.lit(1), text)).alias("doc"), tag.alias("tag"), text.alias("text"))


def beside(docs: DataFrame, rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of addressed() and of (bucket, blob) by bucket, a bucket's blobs before its documents."""
    bucket = F.pmod(F.shiftrightunsigned("tag", 1).bitwiseXOR(F.col("doc")), F.lit(buckets).cast("long"))
    both = docs.withColumns({"bucket": bucket, "blob": F.lit(None).cast("binary")}).unionByName(rows.select("bucket", "blob"), allowMissingColumns=True)
    return dealt(both, buckets).sortWithinPartitions("bucket", F.col("blob").isNull())


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows by bucket, as many buckets to every partition; by a hash of their numbers some would get several more."""
    return rows.repartitionById(min(buckets, MOST_PARTS), F.col("bucket").cast("int"))


def marks(docs: DataFrame, hot_seed: int = HOT_SEED, bucket_bytes: int = 12 << 20) -> tuple[DataFrame, int]:
    """(rows of what is removed by bucket of documents, number of those buckets) for docs of addressed().

    Buckets are of about bucket_bytes of text at every size. A task takes one after another, so the number of
    partitions is bounded and what a task holds is too.
    """
    slim = docs.select("doc", "tag", "text")
    with cleaned(docs.sparkSession):
        total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(16, total // bucket_bytes)) | 1
    settled = written(dealt(slim.mapInArrow(_seeds(buckets), ROWS), buckets).sortWithinPartitions("kind", "bucket").mapInArrow(_settle(buckets, hot_seed), ROWS))
    texts = beside(slim, settled.where("kind = 'ask'"), buckets).mapInArrow(_texts_of(buckets), ROWS)
    compared = written(dealt(texts, buckets).sortWithinPartitions("kind", "bucket").mapInArrow(_compare(buckets), ROWS))
    return settled.where("kind = 'mark'").unionByName(compared), buckets


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the remaining bytes.

    Removed is each byte under a string of 50 bytes that also starts in a document with a smaller id. A null text
    counts as empty. A null id is never smaller than another and null ids do not remove from each other, nor do rows
    that repeat an id. An empty table gives no rows. Other columns are not read.
    """
    rows = addressed(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text")
    found, buckets = marks(rows, **settings)

    def run(batches):
        for entries, part in _beside(batches, MARK):
            done = [(len(kept) + gone, gone, spans, hashlib.sha256(kept).hexdigest()) for kept, gone, spans in _apply(entries, part)]
            yield pa.RecordBatch.from_arrays([part.column("c0"), *(pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        trim()

    return beside(rows, found, buckets).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs with the removed bytes gone from text_col, and the columns n_bytes and n_removed.

    A character that was cut in two goes as well. A null text stays null. Rules for ids as in digests(). Other columns
    pass through whatever their names; n_bytes and n_removed are replaced if they are there.
    """
    docs = docs.drop("n_bytes", "n_removed")
    rows = addressed(docs, id_col, text_col)
    found, buckets = marks(rows, **settings)
    others = [f for f in rows.schema.fields if f.name not in ("doc", "tag", "text")]
    out = T.StructType([*others, T.StructField("text", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches):
        for entries, part in _beside(batches, MARK):
            done = list(_apply(entries, part))
            nulls = part.column("text").is_null().to_pylist()
            texts = [None if null else kept.decode(errors="ignore") for (kept, _, _), null in zip(done, nulls, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in others), pa.array(texts, pa.string()), pa.array([len(k) + g for k, g, _ in done], pa.int64()), pa.array([g for _, g, _ in done], pa.int64())], names=[f.name for f in out])
        trim()

    cleaned_ = beside(rows, found, buckets).mapInArrow(run, out)
    return cleaned_.select(*[F.col("text" if c == text_col else f"c{k}").alias(c) for k, c in enumerate(docs.columns)], "n_bytes", "n_removed")
