"""SentencePiece encoding and decoding by vectorised merge rounds (operator 8).

Texts are cut before every space, where no piece of the vocabulary can span, and each distinct word is merged once.
The words of a batch lie side by side in one flat array of symbols. A round finds for every word its best pair (the
vocabulary's best score, then the leftmost), merges them all at once and compacts the arrays, until no pair remains.

A round merges one pair of a word, so words of more than 256 symbols, such as text without spaces, would take quadratic
time. Their pairs wait in a heap in the same order instead.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ranges, small_batches, trim
from .words import IdStore, factorise

SPACE = "▁"
NONE = np.int64(1 << 40)
LONG = 256


class PieceModel:
    """Vocabulary of a BPE model with byte fallback, identity normalisation and a dummy space before the text."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE with byte fallback, identity normalisation and a dummy prefix")
        pieces = model.pieces
        if any(p.type in (4, 5) for p in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.size, self.eos = len(pieces), model.trainer_spec.eos_id
        self.unk = model.trainer_spec.unk_id
        normal = [(i, p.piece) for i, p in enumerate(pieces) if p.type == 1]
        if any(SPACE in p.lstrip(SPACE) for _, p in normal):
            raise ValueError("a piece spans a space")
        # a rank for each distinct score, best first; equal scores tie
        scores = np.array([p.score for p in pieces])
        order = np.unique(-scores, return_inverse=True)[1]
        self.rank = order.astype(np.int64)
        by_piece = {p: i for i, p in normal}
        # symbols: ids of the vocabulary, and beyond them code points that are not in it
        points = np.full(0x110000, -1, np.int64)
        for i, p in normal:
            if len(p) == 1:
                points[ord(p)] = i
        self.points = np.where(points < 0, np.arange(0x110000) + self.size, points)
        self.bytes_at = next(i for i, p in enumerate(pieces) if p.type == 6)
        keys, merged = [], []
        symbol = lambda s: by_piece[s] if s in by_piece else (int(self.points[ord(s)]) if len(s) == 1 else None)
        for i, p in normal:
            for cut in range(1, len(p)):
                a, b = symbol(p[:cut]), symbol(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 21 | b)
                    merged.append(i)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        self.made = dict(zip(self.pair_keys.tolist(), zip(self.rank[self.pair_ids].tolist(), self.pair_ids.tolist(), strict=True), strict=True))
        self.surface = [b"" if p.type == 3 else p.piece.replace(SPACE, " ").encode() for p in pieces]
        for i in range(256):
            self.surface[self.bytes_at + i] = bytes([i])
        self.surface[self.unk] = model.trainer_spec.unk_surface.encode()
        self.is_byte = np.array([p.type == 6 for p in pieces])
        self.is_control = np.array([p.type == 3 for p in pieces])

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        keys = left << 21 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ids[at], -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each word); a word's spaces are written as the space symbol."""
        text = "".join(words)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.points[code]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        if len(long := np.flatnonzero(sizes > LONG)):
            starts = np.cumsum(sizes) - sizes
            for i in long.tolist():
                done_symbols.append(self._merge_long(symbols[starts[i] : starts[i] + sizes[i]]))
                done_words.append(np.full(len(done_symbols[-1]), i))
            short = (sizes <= LONG)[word]
            symbols, word = symbols[short], word[short]
        while len(symbols) > 1:
            made = self.pairs(symbols[:-1], symbols[1:])
            made[word[:-1] != word[1:]] = -1
            rank = np.where(made >= 0, self.rank[made], NONE)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            # the pair of the last symbol of a word is none
            rank = np.append(rank, NONE)
            best = np.minimum.reduceat(rank, starts)
            alive = best < NONE
            if not alive.all():
                lengths = np.diff(np.append(starts, len(symbols)))
                keep = np.repeat(alive, lengths)
                done_symbols.append(symbols[~keep])
                done_words.append(word[~keep])
                symbols, word, rank, made = symbols[keep], word[keep], rank[keep], np.append(made, -1)[keep]
                starts, best = np.cumsum(lengths[alive]) - lengths[alive], best[alive]
                if not len(symbols):
                    break
            else:
                made = np.append(made, -1)
            lengths = np.diff(np.append(starts, len(symbols)))
            at_best = np.flatnonzero(rank == np.repeat(best, lengths))
            first = at_best[np.concatenate([[True], word[at_best[1:]] != word[at_best[:-1]]])]
            symbols[first] = made[first]
            gone = np.ones(len(symbols), bool)
            gone[first + 1] = False
            symbols, word = symbols[gone], word[gone]
        done_symbols.append(symbols)
        done_words.append(word)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return self._fall_back(symbols[order], word[order], len(words))

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols of one word after all merges: best rank first, then the leftmost."""
        n, made = len(symbols), self.made
        keys = (symbols[:-1] << 21 | symbols[1:]).tolist()
        heap = [(made[k][0], i, k) for i, k in enumerate(keys) if k in made]
        heapify(heap)
        symbol, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, key = heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j == n or symbol[i] << 21 | symbol[j] != key:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = made[key][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (key := symbol[i] << 21 | symbol[k]) in made:
                    heappush(heap, (made[key][0], i, key))
            if (k := before[i]) >= 0 and (key := symbol[k] << 21 | symbol[i]) in made:
                heappush(heap, (made[key][0], k, key))
        done = np.array(symbol, np.int64)
        return done[done >= 0]

    def _fall_back(self, symbols: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Code points outside the vocabulary as their UTF-8 bytes."""
        point = symbols - self.size
        width = np.where(point < 0, 1, np.where(point < 0x80, 1, np.where(point < 0x800, 2, np.where(point < 0x10000, 3, 4))))
        ends = np.cumsum(width)
        out = np.repeat(symbols, width)
        k = np.arange(len(out)) - np.repeat(ends - width, width)
        p, w = np.repeat(point, width), np.repeat(width, width)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[w] * (k == 0) + 0x80 * ((k > 0) & (p >= 0))
        value = lead | (p >> (6 * (w - 1 - k))) & np.where((k == 0) | (w == 1), 0x7F, 0x3F)
        out = np.where(p >= 0, self.bytes_at + value, out)
        return out, np.bincount(word, weights=width, minlength=n).astype(np.int64)

    def decode(self, ids) -> str:
        """Text of ids: bytes run together (each that is not UTF-8 as U+FFFD), one leading space consumed."""
        parts, run, begun = [], bytearray(), False
        for i in ids:
            if self.is_byte[i]:
                run += self.surface[i]
                continue
            if run:
                parts.append(_utf8(bytes(run)))
                run, begun = bytearray(), True
            if self.is_control[i]:
                continue
            piece = self.surface[i].decode()
            if not begun and i != self.unk:
                piece = piece[1:] if piece.startswith(" ") else piece
            begun = True
            parts.append(piece)
        if run:
            parts.append(_utf8(bytes(run)))
        return "".join(parts)


def _utf8(raw: bytes) -> str:
    """Longest valid UTF-8 characters; every byte outside them is U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


@cache
def _store(path: str) -> IdStore:
    return IdStore(model(path).merge)


def _split(texts: pa.Array) -> pa.Array:
    return pc.split_pattern(texts, " ")


class Codec:
    """Encoding of batches with the words already met kept, and vectorised decoding."""

    def __init__(self, path: str):
        self.model, self.store = model(path), _store(path)
        m = self.model
        self.lengths = np.array([len(s) for s in m.surface], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(m.surface), np.uint8)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each text), without an end id."""
        # runs of spaces may merge with each other, so a text that has any is cut by runs; a space symbol of its own too
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.or_(pc.ends_with(texts, " "), pc.match_substring(texts, SPACE)))).to_numpy(zero_copy_only=False)
        if not odd.any():
            counts, codes, words = factorise(texts, _split)
            return self._clean(texts, counts, codes, words)
        plain = np.flatnonzero(~odd)
        sizes, pieces = np.zeros(len(odd), np.int64), [None] * len(odd)
        if len(plain):
            chosen = texts.take(pa.array(plain))
            flat, n = self._clean(chosen, *factorise(chosen, _split))
            edges = np.concatenate([[0], np.cumsum(n)])
            sizes[plain] = n
            for k, i in enumerate(plain.tolist()):
                pieces[i] = flat[edges[k] : edges[k + 1]]
        for i in np.flatnonzero(odd).tolist():
            runs = _runs(SPACE + texts[i].as_py().replace(" ", SPACE))
            distinct = list(dict.fromkeys(runs))
            code = {w: k for k, w in enumerate(distinct)}
            flat, n = self.store.ids(np.array([len(runs)]), np.array([code[w] for w in runs]), distinct)
            sizes[i], pieces[i] = n[0], flat
        return np.concatenate(pieces) if pieces else np.zeros(0, np.int64), sizes

    def _clean(self, texts, counts, codes, words) -> tuple[np.ndarray, np.ndarray]:
        flat, n = self.store.ids(counts, codes, [SPACE + w for w in words])
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        if empty.any():
            keep = np.repeat(~empty, n)
            flat, n = flat[keep], np.where(empty, 0, n)
        return flat, n

    def decode(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; ids with byte pieces outside UTF-8, or the unknown id, take the plain path."""
        ids = flat.astype(np.int64)
        lengths = self.lengths[ids]
        raw = self.flat[ranges(self.starts[ids], lengths)].tobytes()
        byte_ends = np.concatenate([[0], np.cumsum(lengths)])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        at, out = byte_ends[edges].tolist(), []
        odd = np.add.reduceat(np.append(ids == self.model.unk, False), np.minimum(edges[:-1], len(ids))) > 0 if len(sizes) else []
        edges = edges.tolist()
        for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            text = raw[a:b]
            first = ids[edges[k]] if edges[k] < edges[k + 1] else -1
            if (odd[k] and edges[k] < edges[k + 1]) or first < 0 or self.model.is_control[first] or not _valid(text):
                text = self.model.decode(ids[edges[k] : edges[k + 1]].tolist()).encode()
            elif text[:1] == b" " and not self.model.is_byte[first]:
                text = text[1:]
            out.append(text)
        return out


def _valid(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


def _runs(text: str) -> list[str]:
    """Cuts before each run of space symbols."""
    return re.findall(f"{SPACE}+[^{SPACE}]*", text) if text != SPACE else []


def _digests(path: str):
    def run(batches):
        codec = Codec(path)
        names = [str(i).encode() for i in range(codec.model.size)]
        for batch in batches:
            for part in small_batches(batch, "text"):
                texts = pc.fill_null(part.column("text"), "")
                flat, sizes = codec.encode(texts)
                edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                ids_sha, end = [], names[codec.model.eos]
                listed = flat.tolist()
                for a, b in zip(edges, edges[1:], strict=False):
                    ids_sha.append(hashlib.sha256(b" ".join([*map(names.__getitem__, listed[a:b]), end])).hexdigest())
                decoded = [hashlib.sha256(t).hexdigest() for t in codec.decode(flat, sizes)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes + 1), pa.array(ids_sha), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        trim()

    return run


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_tokens with the end id, and digests of the ids and of the decoded text.

    A null or empty text is the end id alone. Rows that repeat an id each get a row and a null id stays null. An empty
    table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """(doc_id, ids): the ids of each text, with the end id if asked for; nulls as in digests()."""

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            for part in small_batches(batch, "text"):
                flat, sizes = codec.encode(pc.fill_null(part.column("text"), ""))
                edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                ids = [[*flat[a:b].tolist(), *[codec.model.eos] * end] for a, b in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")
