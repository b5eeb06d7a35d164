import random
import time

import regex

from quern.llm import license_scan
from quern.plans.report import physical


def brute(rows, least=0.8, templates=license_scan.TEMPLATES):
    """Every passage of every text against every template."""
    split = lambda s: regex.sub(r"[^\p{L}\p{N}]+", " ", s.lower()).strip().split(" ")
    pairs = lambda w: [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    best = {}
    for i, t in rows:
        found = pairs(split(t or ""))
        for name, text in templates:
            words = split(text)
            grams = set(pairs(words))
            longest = int((len(words) - 1) * (2 - least) / least + 1e-9)
            for a, g in enumerate(found):
                if g not in grams:
                    continue
                kinds, foreign = set(), 0
                for b in range(a, min(len(found), a + longest)):
                    if found[b] not in grams:
                        foreign += 1
                        continue
                    kinds.add(found[b])
                    d = 2.0 * len(kinds) / (foreign + len(kinds) + len(grams))
                    if d >= least:
                        key = (i, name)
                        best[key] = max(best.get(key, (0, 0, 0)), (d, -a - 1, -(b - a + 2)))
    return sorted(((i, name, d, -a, -n) for (i, name), (d, a, n) in best.items()), key=str)


MIT = next(t for n, t in license_scan.TEMPLATES if t.startswith("Permission is hereby granted, free of charge"))
GPL = next(t for n, t in license_scan.TEMPLATES if t.startswith("This program is free software"))


def wrapped(text, width):
    lines = [""]
    for w in text.split():
        lines[-1:] = [f"{lines[-1]} {w}".strip()] if len(lines[-1]) + len(w) < width else [lines[-1], w]
    return "\n".join(lines)


def test_against_brute_force(spark):
    words = MIT.split()
    rng = random.Random(4)
    rows = [
        (1, "Some prose.\nReleased under the MIT License.\nmore"),
        (2, "RELEASED   under the MIT-License!"),
        (3, " ".join(words[:30]) + "\n\n" + " ".join(words[30:60]) + "\n" + " ".join(words[60:])),
        (4, MIT.replace("Software", "Program")),
        (5, "This work is licensed under the GNU General Public License, version 3.\nThis work is licensed under the GNU General Public License, version 2."),
        (6, "word " * 30_000),
        (7, None),
        (8, ""),
        (9, "one\n\n \ntwo"),
        (None, "Released under the MIT License."),
        (None, "Licensed under the MIT License."),
        (10, "Licensed under CC BY-NC 4.0."),
        (10, "Licensed under CC BY-NC 4.0."),
        (11, "the license of the software is licensed under the license " * 3),
        (12, "prose before it. Released under the MIT License. And prose behind it."),
        (13, "word"),
    ]
    for k in range(60):
        text = list(rng.choice([MIT, GPL, license_scan.TEMPLATES[0][1], license_scan.TEMPLATES[-2][1]]).split())
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(3)] = rng.choice([[], ["other"], ["of", "the"], ["the", "software", "and"]])
        rows.append((100 + k, " ".join(rng.choice("the of software license under and use to".split()) for _ in range(rng.randrange(40))) + " " + wrapped(" ".join(text), rng.randrange(20, 90)) + " and more"))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, word int, h string")
    got = sorted((tuple(r) for r in license_scan.scan(df).collect()), key=str)
    assert got == brute(rows) and {r[0] for r in got} >= {1, 2, 3, 4, 5, None, 10, 12}
    assert license_scan.scan(df.where("false")).count() == 0
    assert not any(x in physical(license_scan.scan(df)) for x in ("Python", "Pandas", "Arrow"))


def test_wrapped_notices_are_found_at_any_width(spark):
    rows = [(w, "x = 1\n" + wrapped(text, w) + "\ny = 2") for text in (MIT,) for w in range(20, 121, 10)] + [(1000 + w, wrapped(GPL, w)) for w in (30, 50, 72, 78)]
    got = {(r.doc_id, r.license): (r.dice, r.word) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i, "MIT" if i < 1000 else "GPL-3.0"] == (1.0, 3 if i < 1000 else 1) for i, _ in rows)


def test_time_is_linear_in_the_lines_of_a_document(spark):
    def seconds(lines):
        text = "\n".join("Released under the MIT License. Use of it is free" for _ in range(lines))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        assert [tuple(r) for r in license_scan.scan(df).collect()] == [(1, "MIT", 1.0, 1, 5)]
        return time.time() - began

    seconds(100)
    assert seconds(32_000) < 20
