import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = pieces.Codec(PATH)


def check(texts):
    flat, sizes = CODEC.encode(pa.array(texts, pa.string()))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    decoded = CODEC.decode(flat, sizes)
    for k, t in enumerate(texts):
        ids = flat[edges[k] : edges[k + 1]].tolist()
        assert ids == LIBRARY.encode(t), repr(t)
        assert decoded[k].decode() == LIBRARY.decode(ids), repr(t)


def test_chosen_texts():
    check(["", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\nb  \n c", "日本語 テスト", "🎉🎉 é ß ꙮ", "▁▁ a ▁b", "x" * 5000, "aaaa aaaa", "0 12 345", "\x00\x01", " ⁇ ", "<unk> </s> <0x41>", "   lots   of    spaces     here", "\t tab", "a　b"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30), min_size=1, max_size=4))
def test_any_text(texts):
    check(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab thern \n▁ion,é.", max_size=60), min_size=1, max_size=4))
def test_likely_merges(texts):
    check(texts)


def test_long_words():
    rng = random.Random(7)
    for alphabet in ("ab", "thearndio", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "日本語テストの", "=-_"):
        for n in (256, 257, 300, 3000):
            check(["".join(rng.choice(alphabet) for _ in range(n)), "a " + "".join(rng.choice(alphabet) for _ in range(n)) + " b"])
    check(["return" * 200 + "▁▁" * 300, " " * 1000 + "x" * 700, "the" * 4000])


def test_long_words_take_linear_time():
    import time

    rng = random.Random(8)
    text = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(100_000))
    began = time.process_time()
    check([text])
    assert time.process_time() - began < 8


def test_vocabularies_beyond_the_stored_width_are_refused():
    import pytest

    from quern.llm.words import IdStore

    store = IdStore(lambda words: (np.full(len(words), 70_000), np.ones(len(words), np.int64)))
    with pytest.raises(ValueError):
        store.places(["a"])


def test_store_is_emptied_by_characters():
    from quern.llm.words import IdStore

    store = IdStore(lambda words: (np.arange(len(words)), np.ones(len(words), np.int64)), characters=100)
    for k in range(50):
        store.places([f"{k:0100}"])
    assert len(store.known) <= 2


def test_decode_any_ids():
    rng = random.Random(6)
    for _ in range(400):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.choice([0, 1, 2, 29871])]) for _ in range(rng.randint(0, 12))]
        want = LIBRARY.decode(ids)
        assert CODEC.model.decode(ids) == want, ids
        assert CODEC.decode(np.array(ids, np.int64), np.array([len(ids)]))[0].decode() == want, ids


def test_digests(spark):
    rows = [(1, "Hello  wörld", 5), (None, None, 1), (2, "", 0), (2, "", 0), (3, "word " * 20000, 1)]
    got = pieces.digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    import hashlib

    want = []
    for i, t, _ in rows:
        ids = LIBRARY.encode(t or "")
        want.append((i, len(ids) + 1, hashlib.sha256(" ".join(map(str, [*ids, 2])).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode([*ids, 2]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
