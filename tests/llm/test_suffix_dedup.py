import hashlib
import random

import numpy as np

from quern.llm import suffix_dedup as sd


def brute(rows, least=50):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - least + 1):
            w = raw[k : k + least]
            i_ = i if i is not None else 2**63
            first[w] = min(first.get(w, i_), i_)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - least + 1):
            if first[raw[k : k + least]] < (i if i is not None else 2**63):
                gone[k : k + least] = b"\1" * least
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_array():
    rng = random.Random(9)
    for alphabet in (b"a\xff", b"ab", b"abc", bytes(range(256))):
        for n in (0, 1, 2, 5, 60, 400):
            flat = np.array([rng.choice(alphabet) for _ in range(n)], np.uint8)
            sa = sd.suffix_array(flat)
            raw = flat.tobytes()
            assert sorted(sa.tolist()) == list(range(n))
            cut = [raw[i : i + 56] for i in sa]
            assert cut == sorted(cut)


def test_equal_windows_have_equal_seeds():
    rng = random.Random(10)
    common = bytes(rng.randrange(97, 101) for _ in range(300))
    texts = [bytes(rng.randrange(97, 101) for _ in range(rng.randrange(0, 90))) + common + b"z" * rng.randrange(60) for _ in range(4)]
    seen = {}
    flat = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    text, first, n, seed, _ = sd.segments(flat, starts, lengths)
    covered = set()
    for t, a, k, s in zip(text, first, n, seed, strict=True):
        for i in range(a, a + k):
            assert starts[t] <= i and i + 50 <= starts[t] + lengths[t]
            covered.add(int(i))
            assert seen.setdefault(flat[i : i + 50].tobytes(), s) == s
    assert len(covered) == sum(max(0, x - 49) for x in lengths)


def corpus(seed, docs=140):
    rng = random.Random(seed)
    words = "the of and to in that was for with on une les der die".split()
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [make(rng.randint(8, 60)) for _ in range(12)]
    rows = []
    for i in range(docs):
        parts = [make(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.randint(30, 400)], make(rng.randint(0, 12))]
        rows.append((i * 3 % 401, " é ".join(parts)))
    rows += [rows[5], (900, rows[7][1]), (901, rows[7][1]), (902, None), (903, ""), (904, "a" * 700), (905, "a" * 300 + "b"), (906, "ab" * 90), (None, rows[8][1]), (None, rows[9][1] + "unlike any other text that stands here and is long enough for it"), (907, "x" * 49), (908, "x" * 50), (909, "x" * 50), (910, "\0" * 80), (911, "\0" * 80)]
    return rows


def test_against_brute_force(spark):
    for seed, hot in ((11, 4096), (12, 1)):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bucket int").repartition(3)
        got = sorted((tuple(r) for r in sd.digests(df, hot_seed=hot, bucket_bytes=4000).collect()), key=str)
        assert got == brute(rows)


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    rng = random.Random(13)
    base = "".join(rng.choice("abcdefgh ") for _ in range((1 << 20) + 5000))
    rows = [(1, base), (2, "Q" + base[700_000:]), (3, base[:100])]
    got = sorted(tuple(r) for r in sd.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(1, len(base), 0, 0), (2, len(base) - 700_000 + 1, len(base) - 700_000, 1), (3, 100, 100, 1)]


def test_equal_segments_are_told_by_their_bytes():
    raw = np.frombuffer(b"a" * 60 + b"b" * 60 + b"a" * 59 + b"c" + b"b" * 60, np.uint8)
    a, b, n = np.array([0, 60, 0, 120, 0]), np.array([120, 180, 120, 0, 120]), np.array([11, 11, 10, 10, 11], np.uint8)
    assert sd._equal(raw, a, n, b, np.array([11, 11, 10, 11, 10], np.uint8)).tolist() == [False, True, True, False, False]
    assert sd._equal(raw, a[:0], n[:0], b[:0], n[:0]).tolist() == []


def test_passage_in_more_places_than_are_sorted(spark):
    rng = random.Random(21)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(200))
    rows = [(i, f"{i} {passage} {i * 7}") for i in range(3 * sd.MOST_EQUAL)]
    # a task for each, so none are merged before
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows))
    assert sorted((tuple(r) for r in sd.digests(df).collect()), key=str) == brute(rows)


def test_many_rows_without_an_id_and_equal_checksums(spark):
    long = "some words that two of these texts share, and which are more than fifty bytes long; "
    # texts of one CRC-32 and different lengths, all with the same id or none
    texts = [t for t in (("plumless", long + "plumless"), ("buckeroo", long * 2 + "buckeroo")) for t in t]
    rows = [(None, t) for t in texts] + [(7, t) for t in texts] + [(None, f"{long}{k}" + "y" * k) for k in range(300)] + [(9, f"{long}{k}") for k in range(300)] + [(None, long)] * 5 + [(3, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in sd.digests(df, bucket_bytes=4000).collect()), key=str)
    assert got == brute(rows)


def test_rows_without_an_id_lie_in_many_buckets(spark):
    rows = [(None, f"text number {k}") for k in range(400)] + [(5, f"text number {k}") for k in range(400)]
    base = sd.addressed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    found = [(r.bucket, r.doc, r.tag) for r in sd.beside(base, spark.createDataFrame([], "bucket long, blob binary"), 17).collect()]
    doc, tag = np.array([f[1] for f in found]), np.array([f[2] for f in found], np.int64).view(np.uint64)
    assert sd.doc_bucket(doc, tag, 17).tolist() == [f[0] for f in found]
    counts = np.bincount([f[0] for f in found], minlength=17)
    assert counts.max() < 3 * 800 / 17


def test_clashing_names(spark):
    long = "some words that two of these texts share, and which are more than fifty bytes long"
    rows = [(i, long, 1, 2, 3, b"x", i, "k") for i in range(3)]
    got = sd.clean(spark.createDataFrame(rows, "doc_id long, text string, bucket int, n_bytes int, doc long, blob binary, tag long, c0 string"))
    assert got.columns == ["doc_id", "text", "bucket", "doc", "blob", "tag", "c0", "n_bytes", "n_removed"]
    assert sorted((r.doc_id, r.text, r.bucket, r.doc, bytes(r.blob), r.tag, r.c0, r.n_bytes, r.n_removed) for r in got.collect()) == [(i, "" if i else long, 1, 3, b"x", i, "k", len(long), len(long) if i else 0) for i in range(3)]


def test_empty(spark):
    assert sd.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
