"""The pipeline's stages against brute-force versions, each on its own input."""

import random
import zlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quern.llm import exact_dedup
from quern.llm.shared import delete, written
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import brute_similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rest string, print int, bucket int, n_lines int, tag int, score double"


def corpus():
    rng = random.Random(17)
    vocab = {"en": "the of and to in that was for with on thing other house river".split(), "de": "der die und das ist nicht ein auch für über straße größe haus".split()}
    line = lambda lang: " ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(4, 14)))
    passage = " ".join(rng.choice(vocab["en"]) for _ in range(60))
    rows = []
    for i in range(120):
        lang = "en" if rng.random() < 0.6 else "de"
        lines = [line(lang) for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.3:
            lines.append("subscribe to our weekly letter today")
        if rng.random() < 0.2 and lang == "en":
            lines.append("see " * rng.randint(1, 3) + passage)
        rows.append((i, "\n".join(lines), lang))
    rows += [(200 + i, rows[i * 3][1], rows[i * 3][2]) for i in range(15)]
    rows += [(300, None, "en"), (301, "", "en"), (302, "123 456", "de"), (303, "the of and " * 4000, "en")]
    return [(i, t, lang, f"s{i % 3}", len(t or ""), "r", 1, 2, 3, 4, 0.5) for i, t, lang in rows]


def test_stages(spark):
    docs = written(spark.createDataFrame(corpus(), SCHEMA))
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "suffix_array_dedup", "packing"]

    told = written(cp.language_id(spark, docs, ""))
    assert told.columns == columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in told.collect()} == {300, 301, 302}

    lined = written(cp.drop_lines(spark, told, ""))
    want = [(i, t) for i, t, _, gone in brute_lines([(r.doc_id, r.text) for r in told.collect()]) if not gone or t.strip(" ")]
    assert lined.columns == columns and sorted((r.doc_id, r.text) for r in lined.collect()) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    near = written(cp.near_dedup(spark, lined, ""))
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == brute_similar([(r.doc_id, r.text) for r in lined.collect()])

    cut = written(cp.drop_repeats(spark, near, ""))
    first, want = {}, []
    texts = sorted((r.doc_id, r.text.encode()) for r in near.collect())
    for i, t in texts:
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode(errors="ignore")
        if not any(gone) or kept.strip(" "):
            want.append((i, kept))
    assert cut.columns == columns and sorted((r.doc_id, r.text) for r in cut.collect()) == want
    assert want != [(i, t.decode()) for i, t in texts]

    packed = cp.pack(spark, cut, "").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in cut.collect():
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
        pieces = sorted((p.start, p.length, p.ids_crc32) for p in packed if p.doc_id == r.doc_id)
        at = 0
        for start, n, crc in pieces:
            assert start == at and crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[start : start + n]))
            at += n
        assert at == len(ids)


def test_empty_and_unlabelled(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, "").count() == 0
    unlabelled = spark.createDataFrame([(1, "some words", None, None, 10, None, None, None, None, None, None), (2, "1", None, None, 1, None, None, None, None, None, None)], SCHEMA)
    assert [r.doc_id for r in cp.language_id(spark, unlabelled, "").collect()] == [1]


def test_near_stage_finds_pairs_of_similarity_0_8(spark):
    rng = random.Random(23)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = [(k, " ".join(base[:at] + [f"x{k}"] + base[at + 1 :]), "en", "s", 1, "r", 1, 2, 3, 4, 0.5) for k, at in enumerate((20, 50, 80, 110))]
    rows.append((9, " ".join(f"y{k}" if k % 12 == 0 else w for k, w in enumerate(base)), "en", "s", 1, "r", 1, 2, 3, 4, 0.5))
    kept = cp.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 9]


def test_stages_delete_their_own_tables_only(spark, tmp_path):
    docs = written(spark.createDataFrame(corpus()[:30], SCHEMA))
    other = exact_dedup.exact_groups(docs)
    stage = cp.drop_lines(spark, docs, "")
    mine = list(cp.SPENT)
    assert mine and stage.count() == 30
    near = cp.near_dedup(spark, docs, "")
    assert not set(mine) & set(cp.SPENT) and near.count() <= 30
    assert other.count() == 30
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() > 0 and not cp.SPENT
    assert other.count() == 30


def test_tables_are_owned_by_the_innermost_block(spark):
    from quern.llm.shared import owned

    with owned() as outer:
        a = written(spark.range(3))
        with owned() as inner:
            b = written(spark.range(4))
    written(spark.range(5))
    assert outer == [a._quern_path] and inner == [b._quern_path]
    delete(spark, inner[0])
    assert a.count() == 3
