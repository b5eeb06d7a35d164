import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quern.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 80))]
        plain, free = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            at = next((b for b, r in enumerate(free) if r >= sizes[i]), None)
            if at is None:
                plain.append([])
                free.append(100)
                at = len(plain) - 1
            plain[at].append(i)
            free[at] -= sizes[i]
        assert packing.first_fit_decreasing(sizes, 100) == plain


def test_pack_group_covers_every_token_once():
    rng = random.Random(4)
    for _ in range(60):
        lengths = [rng.choice([1, 5, 31, 100, 700, 2048, 5000, rng.randint(1, 3000)]) for _ in range(rng.randint(1, 60))]
        sequences = packing.pack_group(lengths)
        seen = [np.zeros(n, int) for n in lengths]
        for s in sequences:
            assert 0 < sum(p[2] for p in s) <= 2048
            for i, start, n in s:
                assert n > 0
                seen[i][start : start + n] += 1
        assert all((x == 1).all() for x in seen)
        assert len(sequences) <= sum(lengths) / 2048 * 1.05 + 2


def test_pieces_hold_the_tokenizers_ids(spark):
    rng = random.Random(5)
    texts = ["Héllo wörld, it's 2024!\n\tOK\x85x　y   z", "", None, "a" * 3000, "don't DON'T 12 345 ... ?!", "é e ́ İI", " ".join(rng.choice(["and,", "The", "thnt.", "x1y2", "é́"]) for _ in range(9000)), "\x1c\x1d a\x00b"]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "null id", 1), (3, "again", 1), (3, "again", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(df, PATH, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((-1 if i is None else i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, _ in rows)
    by_seq = {}
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    whole = {}
    for r in sorted(got, key=lambda r: r.start):
        if r.doc_id != 3 or r.doc_tokens > 2:
            whole.setdefault((r.doc_id, r.doc_tokens), []).extend(np.frombuffer(r.ids, "<u4").tolist())
    have = sorted((-1 if k[0] is None else k[0], tuple(v)) for k, v in whole.items())
    assert have == [w for w in want if w[0] != 3 or len(w[1]) > 2]
    assert sum(r.length for r in got) == sum(len(w[1]) for w in want)


def test_equal_rows_are_dealt_evenly_in_bounded_groups(spark):
    from pyspark.sql import functions as F

    same = "the same text in very many rows " * 3
    df = spark.createDataFrame([(None, same)] * 3000 + [(7, same)] * 1000, "doc_id long, text string").repartition(3)
    out = packing.pack(df, PATH, group_docs=100)
    tasks = [r.n for r in out.groupBy(F.shiftright("sequence_id", 32).alias("task")).agg(F.sum("length").alias("n")).collect()]
    assert len(tasks) == 20 and max(tasks) < 1.2 * min(tasks)
    fills = [r.n for r in out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert max(fills) <= 2048 and len(fills) <= sum(fills) / 2048 + 3 * 20
    assert sum(tasks) == 4000 * len([*Tokenizer.from_file(PATH).encode(same, add_special_tokens=False).ids, 1])


def test_groups_are_bounded_by_tokens(spark):
    df = spark.createDataFrame([(i, "a b c d e f g h " * 500) for i in range(40)], "doc_id long, text string")
    few = packing.pack(df, PATH, group_tokens=9000).collect()
    by_seq = {}
    for r in few:
        by_seq.setdefault(r.sequence_id, set()).add(r.doc_id)
    # documents of about 4,000 tokens in groups of two or three, so no sequence mixes more
    assert max(map(len, by_seq.values())) <= 4 and sum(r.length for r in few) == 40 * 4001


def test_vocabularies_beyond_the_stored_width_are_refused():
    import pytest

    with pytest.raises(ValueError):
        packing._tokenise(PATH, 1 << 16)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
