import random

import numpy as np
import pytest
import xxhash

from quern.llm import simhash


def brute_print(text):
    words, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\v\f\r":
            if word:
                words.append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word))
            word = ""
        else:
            word += ch
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    root = list(range(len(prints)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                root[top(a)] = top(b)
    ids = {}
    for k, (i, _) in enumerate(prints):
        ids.setdefault(top(k), []).append(i)
    return sorted((i if i is not None else -1, f"{p:016x}", min((x for x in ids[top(k)] if x is not None), default=None)) for k, (i, p) in enumerate(prints))


def test_against_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("the of and to in that was for with on".split()) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = [(i, rng.choice(base)) for i in range(120)]
    rows += [(200 + i, " ".join(w if rng.random() > 0.03 else "x" for w in rng.choice(base).split())) for i in range(120)]
    rows += [(None, "the of"), (401, None), (402, ""), (403, " \t\n"), (404, "É É b c"), (404, "É É b c"), (405, "word " * 5000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_dedup(df).collect())
    assert got == brute_groups(rows)


def test_near_groups_equal_all_pairs(spark):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(20)}
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    got = {r["print"]: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, print long")).collect()}
    label = dict((i, i) for i, _ in rows)
    moved = True
    while moved:
        moved = False
        for i, p in rows:
            for j, q in rows:
                if ((p ^ q) & (2**64 - 1)).bit_count() <= 3 and label[j] < label[i]:
                    label[i], moved = label[j], True
    assert got == {p: label[i] for i, p in rows}


def test_empty(spark):
    assert simhash.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_bk_tree(n):
    rng = random.Random(n)
    values = [rng.getrandbits(8) for _ in range(100)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(256):
        assert sorted(tree.within(q, n)) == sorted({v for v in values if (v ^ q).bit_count() <= n})


def brute_similar(rows, least=0.8, width=5):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} if len(w) <= width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if top(a) != top(b) and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(top(k), []).append(i)
    return sorted(min(g) for g in groups.values())


def test_keep_similar_equals_jaccard_of_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for size in (6, 12, 25, 60, 150, 400, 1500):
        for _ in range(12):
            base = [rng.choice(words) for _ in range(size)]
            for _ in range(5):
                rows.append((len(rows), " ".join(w if rng.random() > 0.02 else rng.choice(words) for w in base)))
            cut = rng.randrange(size // 4 + 1)
            rows.append((len(rows), " ".join(base[cut:])))
            rows.append((len(rows), " ".join(base + base[: size // 5] * rng.randint(0, 9))))
    rows += [(5000, None), (5001, " "), (5002, "W1"), (5003, "w1")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, other long")
    got = simhash.keep_similar(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == brute_similar(rows)
    assert simhash.keep_one(df).count() > len(brute_similar(rows))


def test_slack_links_all_that_is_within_the_radius():
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(8)]
    members = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for s in seeds for _ in range(60)})
    label = {m: m for m in members}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in simhash.shard_links(members, 10, 4):
        label[top(x)] = top(y)
    assert all(top(x) == top(y) for x in members for y in members if (x ^ y).bit_count() <= 10)


def test_large_group_of_near_copies_takes_few_comparisons(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 200, np.uint64)
    sets = []
    for _ in range(3000):
        s = base.copy()
        s[rng.integers(0, 200, 5)] = rng.integers(0, 1 << 60, 5, np.uint64)
        sets.append(np.unique(s))
    sets += [np.unique(rng.integers(0, 1 << 60, 200, np.uint64)) for _ in range(200)]
    count, plain = [0], np.intersect1d
    monkeypatch.setattr(simhash.np, "intersect1d", lambda *a, **k: count.__setitem__(0, count[0] + 1) or plain(*a, **k))
    tops = simhash.similar_sets(sets, 0.8)
    assert set(tops[:3000]) == {0} and tops[3000:] == list(range(3000, 3200)) and count[0] < 10_000
