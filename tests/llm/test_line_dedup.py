import random
import re

from quern.llm import line_dedup


def brute(rows, min_docs=3, min_tokens=3, similarity=0.8):
    """Plain Drain over all distinct lines, then templates dropped; ids are distinct here."""
    mask = lambda line: [("<*>" if re.search(r"[0-9]|://|@", t) else t) for t in line.split()]
    docs = {i: (t or "").split("\n") for i, t in rows}
    where = {}
    for i, lines in docs.items():
        for line in lines:
            if len(m := mask(line)) >= min_tokens:
                where.setdefault(tuple(m), set()).add(i)
    leaves, template = {}, {}
    for m in sorted(where, key=lambda m: (-len(where[m]), " ".join(m))):
        leaf = leaves.setdefault((len(m), m[:3]), [])
        scores = [sum(a == b for a, b in zip(m, t, strict=True)) for t in leaf]
        best = max(range(len(leaf)), key=lambda k: (scores[k], -k), default=None)
        if best is None or scores[best] < similarity * len(m):
            leaf.append(list(m))
            best = len(leaf) - 1
        else:
            leaf[best] = [a if a == b else "<*>" for a, b in zip(leaf[best], m, strict=True)]
        template[m] = (len(m), m[:3], best)
    in_docs = {}
    for m, t in template.items():
        in_docs.setdefault(t, set()).update(where[m])
    out = []
    for i, text in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        kept = [x for x in docs[i] if not (tuple(mask(x)) in template and len(in_docs[template[tuple(mask(x))]]) >= min_docs and i != min(in_docs[template[tuple(mask(x))]]))]
        out.append((i, "\n".join(kept), len(docs[i]), len(docs[i]) - len(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(8)
    words = "the of and to in was for on".split()
    shapes = ["Posted on {} by user{} at site", "click here to subscribe to our letter {}", "all rights reserved {} by the owner of this page and more", "the of"]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.4:
                lines.append(rng.choice(shapes).format(rng.randint(1, 99), rng.choice(words)))
            elif kind < 0.7:
                base = "join the mailing list of our partners in town now".split()
                base[rng.randrange(4, len(base))] = rng.choice(words)
                lines.append(" ".join(base))
            else:
                lines.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))))
        rows.append((i, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "word here again " * 8000)]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, line string")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.clean(df).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[3] for r in got) > 50


def test_repeated_and_null_ids_and_empty_table(spark):
    same = "a line that many documents share"
    df = spark.createDataFrame([(None, same), (None, same), (7, same), (7, same), (9, same)], "doc_id long, text string")
    rows = line_dedup.clean(df).collect()
    assert sorted((r.doc_id or 0, r.n_dropped) for r in rows) == [(0, 1), (0, 1), (7, 0), (7, 0), (9, 1)]
    assert line_dedup.clean(df.where("false")).count() == 0


def test_rows_that_repeat_an_id_are_one_document(spark):
    one, two = "a line that few documents share", "all these words differ but one here"
    rows = [(1, one), (1, one), (1, one), (2, one), (None, one[::-1]), (None, one[::-1]), (None, one[::-1]), (3, two), (3, two.replace("one", "two")), (4, two.replace("one", "six"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.clean(df).collect()} == {0}
    more = df.union(spark.createDataFrame([(5, one), (6, two)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in line_dedup.clean(more).where("n_dropped > 0").collect()) == [2, 4, 5, 6]


def test_clashing_names(spark):
    rows = [(i, "a line that many documents share", i, 2, 3, [4], "x") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines long, drop_lines int, line int, id array<int>, c0 string")
    got = line_dedup.clean(df)
    assert got.columns == ["doc_id", "text", "drop_lines", "line", "id", "c0", "n_lines", "n_dropped"]
    assert {(r.doc_id, r.drop_lines, r.line, tuple(r.id), r.c0, r.n_lines, r.n_dropped) for r in got.collect()} == {(i, 2, 3, (4,), "x", 1, int(i > 0)) for i in range(5)}


def test_few_slots_for_leaves_change_nothing(spark):
    rows = [(i, f"notice {w} of town {w} {i % 7} is here for you all\nall other {w} {i} lines stay here") for i, w in enumerate("abcdefghijklmnopqrstuvwxyz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(line_dedup.clean(df).collect()) == sorted(line_dedup.clean(df, leaf_bits=6).collect())


def linear_put(templates, tokens, similarity=0.8):
    scores = [sum(a == b for a, b in zip(tokens, t, strict=True)) for t in templates]
    best = max(range(len(templates)), key=lambda k: (scores[k], -k), default=None)
    if best is None or not scores[best] or scores[best] < similarity * len(tokens):
        templates.append(list(tokens))
        return len(templates) - 1
    templates[best] = [a if a == b else "<*>" for a, b in zip(templates[best], tokens, strict=True)]
    return best


def test_tree_equals_comparison_with_every_template():
    rng = random.Random(5)
    for n in (1, 2, 3, 4, 5, 6, 9, 10, 14, 15, 17, 25, 40):
        for similarity in (0.8, 0.5, 0.2, 1.0):
            tree, plain = line_dedup.TemplateTree(similarity), []
            founders = [[rng.choice("abcd") for _ in range(n)] for _ in range(12)]
            for _ in range(250):
                line = [t if rng.random() > 0.15 else rng.choice(["x", "y", "<*>"]) for t in rng.choice(founders)]
                line[:3] = ["the", "of", "and"][:n]
                assert tree.put(line) == linear_put(plain, line, similarity)
            assert tree.templates == plain


def test_large_leaf_gives_the_same_as_a_small_one(spark):
    names = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(26 * 26)]
    notice = [(i, f"all the news from {names[i]} town is here for you") for i in range(40)]
    other = [(100, "\n".join(f"all the news {a} {b} {a}{b} {b}{a} {a}b {b}a z" for a in names[:150] for b in names[:150]))]
    for rows in (notice, notice + other):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r.doc_id for r in line_dedup.clean(df).where("n_dropped > 0").collect()} == set(range(1, 40))
