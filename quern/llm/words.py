"""Words of a batch of texts, each distinct word handled once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import ranges


def factorise(texts: pa.Array, split) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(words of each text, codes of all words, distinct words); split: Arrow function from texts to lists."""
    lists = split(texts)
    counts = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    return counts, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


class IdStore:
    """Ids of words that were met before, in one flat array; emptied when it grows past a bound of words or characters."""

    def __init__(self, encode, bound: int = 700_000, characters: int = 16 << 20, dtype=np.uint16):
        self.encode, self.bound, self.characters, self.dtype = encode, bound, characters, dtype
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.flat, self.used = np.zeros(4096, self.dtype), 0

    def places(self, words: list[str]) -> np.ndarray:
        """Numbers of the words, encoding those that are new."""
        if len(self.known) > self.bound or self.held > self.characters:
            self._clear()
        get = self.known.get
        found = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            flat, lengths = self.encode(fresh)
            if len(flat) and int(flat.max()) > np.iinfo(self.dtype).max:
                raise ValueError(f"ids of {self.dtype.__name__} only, not {int(flat.max())}")
            self.held += sum(map(len, fresh))
            base = len(self.known)
            found[new] = np.arange(base, base + len(new))
            self.known.update(zip(fresh, range(base, base + len(new)), strict=True))
            need = base + len(new)
            while len(self.starts) < need:
                self.starts, self.lengths = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            while len(self.flat) < self.used + len(flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(flat)] = flat
            self.starts[base:need] = self.used + np.cumsum(lengths) - lengths
            self.lengths[base:need] = lengths
            self.used += len(flat)
        return found

    def ids(self, counts: np.ndarray, codes: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of all texts, ids of each text)."""
        places = self.places(words)[codes] if len(words) else np.zeros(0, np.int64)
        lengths = self.lengths[places].astype(np.int64)
        flat = self.flat[ranges(self.starts[places], lengths)]
        done = np.concatenate([[0], np.cumsum(lengths)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        return flat, np.diff(done[edges])


def ascii_words(texts: pa.Array) -> pa.Array:
    return pc.ascii_split_whitespace(texts)
