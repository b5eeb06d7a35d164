import hashlib
import random

import pytest

from quern.llm import exact_dedup


def test_trie_holds_what_was_put_with_and_without_spills():
    rng = random.Random(15)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 30))) for _ in range(800)] + [b"", b"", b"a" * 5000, b"a" * 4999]
    want = {}
    for n, k in enumerate(keys):
        want.setdefault(k, []).append(n)
    for budget in (10**9, 20_000, 2_000):
        trie = exact_dedup.PatriciaTrie(budget)
        for n, k in enumerate(keys):
            trie.put(k, n)
        got = {}
        for k, held in trie.items():
            assert k not in got
            got[k] = sorted(held)
        assert got == want


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_against_brute_force(spark, keep):
    rng = random.Random(16)
    texts = ["", "a", "ab", "abc", "x" * 40_000, "x" * 39_999 + "y", "é", "É"]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(900, None), (901, None), (None, "ab"), (None, "only"), (None, "only"), (7, "dup"), (7, "dup")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, keep_id int").repartition(5)
    got = exact_dedup.exact_groups(df, keep=keep, trie_bytes=5_000).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    pick = max if keep == "largest" else min
    best = {t: pick((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows if i is not None)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got if r.doc_id is not None) == want
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_ids_count_towards_the_budget():
    trie = exact_dedup.PatriciaTrie(100_000)
    for n in range(5000):
        trie.put(b"same text" if n % 2 else b"other", n)
        trie.put(f"{n % 7} text".encode(), n)
        assert trie.bytes <= trie.budget + 1000
    assert sum(len(held) for _, held in trie.items()) == 10_000


def test_many_copies_are_passed_on_before_more_are_taken(spark):
    rows = [(i, "" if i % 3 else f"text {i % 5}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    few = sorted(map(tuple, exact_dedup.exact_groups(df, keep="largest", most_held=16).collect()))
    assert few == sorted(map(tuple, exact_dedup.exact_groups(df, keep="largest").collect()))
    assert sum(r[3] for r in few) == 6 and {r[2] for r in few if rows[r[0]][1] == ""} == {1333}


def test_empty_and_wrong_setting(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(df).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(df, keep="first")
