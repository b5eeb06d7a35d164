import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import langid


def brute_grams(text):
    import regex

    t = " " + regex.sub(r"[^\p{L}\p{M}']+", " ", text.lower()).strip(" ") + " "
    raw = t.encode()
    return [raw[i : i + n] for n in langid.ORDERS for i in range(len(raw) - n + 1)]


def test_shares_count_whole_texts_and_never_cross():
    rng = random.Random(7)
    filters = langid.Filters(["a", "b"], 16)
    words = ["the", "und", "über", "naïve", "x"]
    known = {g: rng.randint(1, 3) for w in words for g in brute_grams(w)}
    for g, m in known.items():
        keys = langid.hashed_grams(np.frombuffer(g, np.uint8), len(g))
        filters.add(keys, np.array([[bool(m & 1), bool(m & 2)]]))
    texts = ["The über!", "", "12 34", "x" * 500, "und NAÏVE und", None]
    chance = filters.chance()
    got = filters.shares(pa.array(texts))
    for t, row in zip(texts, got, strict=True):
        grams = brute_grams(t or "")
        for b in range(2):
            # the filter never misses; it may claim a few more
            least = sum(known.get(g, 0) >> b & 1 for g in grams) / max(1, len(grams))
            assert row[b] >= np.clip((least - chance[b]) / (1 - chance[b]), 0, 1) - 1e-9
            assert row[b] <= min(1, least + 0.1)


def test_long_texts_are_looked_up_in_chunks(monkeypatch):
    filters = langid.Filters(["a", "b"], 12)
    rng = random.Random(9)
    for g in set(brute_grams("the und über naïve other haus river")):
        filters.add(langid.hashed_grams(np.frombuffer(g, np.uint8), len(g)), np.array([[rng.random() < 0.5, rng.random() < 0.5]]))
    texts = pa.array([" ".join(rng.choice("the und über x1 naïve".split()) for _ in range(rng.randrange(80))) for _ in range(30)])
    whole = filters.shares(texts)
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert np.array_equal(filters.shares(texts), whole)


def brute_identify(rows):
    """Plain dictionaries in place of filters, for small tables: every n-gram of every labelled text that is not held out."""
    import zlib

    grams, texts = {}, {}
    for i, text, lang in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 == 0 or text is None or lang is None:
            continue
        texts[lang] = texts.get(lang, 0) + 1
        found = brute_grams(text)
        for g in set(found):
            n, t = grams.setdefault((len(g), g), {}).get(lang, (0, 0))
            grams[len(g), g][lang] = (n + found.count(g), t + 1)
    languages = sorted(texts)
    kept = {g: by for g, by in grams.items() if any(t >= min(3, 1 + texts[k] // 10) for k, (_, t) in by.items())}
    total = {k: max(1, sum(by.get(k, (0, 0))[0] for by in kept.values())) for k in languages}
    member = {g: {k for k in by if by[k][0] / total[k] >= 0.35 * max(by[x][0] / total[x] for x in by)} for g, by in kept.items()}
    out = {}
    for i, text, _ in rows:
        found = [(len(g), g) for g in brute_grams(text or "")]
        score = [sum(k in member.get(g, ()) for g in found) / max(1, len(found)) for k in languages]
        out[i, text] = dict(zip(languages, score, strict=True))
    return out


def test_against_dictionaries(spark):
    rng = random.Random(3)
    vocabulary = {"en": "the of and to in that was for with on thing other house river", "de": "der die und das ist nicht ein auch für über straße größe haus", "fr": "le la les des et une que pour dans être où élève maison", "xx": "zk qv wq vv"}
    rows = [(i, " ".join(rng.choice(vocabulary[k].split()) for _ in range(rng.randint(1, 30))), k if rng.random() < 0.8 else None) for i, k in enumerate(rng.choice("en en en de de fr".split()) for _ in range(160))]
    rows += [(500, "zk qv", "xx"), (501, "zk vv wq", None), (502, "the und le zk", "en")]
    want = brute_identify(rows)
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        scores = want[r.doc_id, texts[r.doc_id]]
        # the filter may claim an n-gram by chance, so a score may be a little higher, and near ties may fall either way
        assert abs(r.score - scores[r.lang_pred]) < 0.02 and scores[r.lang_pred] > max(scores.values()) - 0.02


def test_few_labels(spark):
    rows = [(1, "the house of the river and other things", "en"), (2, "das haus und der fluss und andere dinge", "de"), (3, "la maison et la rivière dans les champs", "fr")]
    rows += [(10 + k, t, None) for k, (_, t, _) in enumerate(rows)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[10 + k].lang_pred for k in range(3)] == ["en", "de", "fr"] and min(got[10 + k].score for k in range(3)) > 0.9
    one = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame([rows[0], rows[4], (20, "1 2", None)], "doc_id long, text string, lang string")).collect()}
    assert one == {1: "en", 11: "en", 20: "und"}


def test_seventy_languages(spark):
    rng = random.Random(70)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(25)] for k in range(70)}
    rows = [(1000 * k + j, " ".join(rng.choice(words[lang]) for _ in range(20)), lang) for k, lang in enumerate(sorted(words)) for j in range(10)]
    truth = {i: lang for i, _, lang in rows}
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert [r.doc_id for r in got if r.lang_pred != truth[r.doc_id]] == []


def test_rare_language_is_learned_beside_a_frequent_one(spark):
    rows = [(i, f"the house of the river and other things {'abc'[i % 3]}", "en") for i in range(3000)] + [(9000 + i, "sprāke ēna kūra vīri", "lv") for i in range(12)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=200).collect()}
    assert {got[9000 + i] for i in range(12)} == {"lv"} and {got[i] for i in range(3000)} == {"en"}


def test_held_out_accuracy_and_edges(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "", "en"), (9003, "12 !", "de"), (None, "the of and", "en"), (9004, "the of and to " * 5000, None), (9004, "the of and to " * 5000, None)], "doc_id long, text string, lang string")
    both = d.select("doc_id", "text", "lang").unionByName(odd).withColumn("score", F.lit("clash"))
    rows = langid.identify(both).join(d.select("doc_id", "lang"), "doc_id", "left").collect()
    known = [r for r in rows if r.lang and r.held_out]
    assert sum(r.lang == r.lang_pred for r in known) / len(known) > 0.95
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and by[9001].score == 0
    assert by[9004].lang_pred == "en" and by[None].held_out and len(rows) == d.count() + 6
    assert all(0 <= r.score <= 1 for r in rows)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(df).collect()[0].lang_pred == "und"
    assert langid.identify(df.where("false")).count() == 0
