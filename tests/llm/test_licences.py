import re

from vellumist.llm import licences


def dice(a, b):
    a, b = licences.bigrams(a), licences.bigrams(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0


def test_bounds_and_index_equal_all_comparisons():
    scanner = licences.Scanner(licences.TEMPLATES, 0.6)
    units = [t[: len(t) * k // 5] for t in licences.TEMPLATES.values() for k in range(6)] + ["nothing of the kind", "All rights are reserved", "", "...", "license"]
    for u in units:
        want = max(((dice(u, t), len(licences.bigrams(t))) for t in licences.TEMPLATES.values()), default=(0, 0))
        got = scanner.best(u)
        assert (got[:2] if got else None) == (want if want[0] >= 0.6 else None)


def test_whole_paragraph_line_and_odd_rows(spark):
    mit = licences.TEMPLATES["MIT"]
    wrapped = "Copyright (c) 2019 A. Author\n" + re.sub(r"(.{60}) ", r"\1\n", mit)
    rows = [(1, wrapped), (2, "prose before\n\n" + wrapped + "\n\nprose after"), (3, "x\nLicensed under the Apache License, Version 2.0.\ny"), (4, None), (5, ""), (5, ""), (None, "word " * 60_000), (7, "!!!")]
    df = spark.createDataFrame([(i, t, "x", 9.0) for i, t in rows], "doc_id long, text string, licence string, dice double")
    got = licences.scan(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].licence == by[2].licence == "MIT" and by[1].dice == 1.0
    assert by[3].licence == "Apache-2.0 notice" and "Apache-2.0 notice:2:49" in by[3].matches.split(",")
    assert f"MIT:14:{14 + len(wrapped)}" in by[2].matches.split(",")
    assert all(by[i].licence is None and by[i].dice == 0 and by[i].matches == "" for i in (4, 5, 7, None))
    assert licences.scan(df.limit(0)).count() == 0


def split(text, at):
    for words in at:
        text = text.replace(words, "\n\n" + words)
    return text.replace(" \n", "\n")


def test_licence_of_several_paragraphs_within_prose():
    scanner = licences.Scanner(licences.TEMPLATES)
    prose = "\n".join(f"The {i} weather of the day was kind to all of us and none of the boats came back late in number {i * i}." for i in range(30))
    parts = {
        "MIT": ["The above", "THE SOFTWARE IS"], "ISC": ["THE SOFTWARE"], "BSD-2-Clause": ["Redistributions of", "Redistributions in", "THIS SOFTWARE IS"],
        "GPL-3.0 header": ["This program is distributed", "You should"], "Apache-2.0 header": ["You may obtain", "Unless"],
    }
    for name, at in parts.items():
        block = split(licences.TEMPLATES[name], at)
        assert "\n\n" in block
        for between, wrapped in (("\n\n", block), ("\n", re.sub(r"(.{50}) ", r"\1\n", block))):
            found = [x for x in scanner.scan(prose + between + wrapped + between + prose) if x[2] == name]
            start = len(prose + between)
            assert [(x[0], x[3], x[4]) for x in found] == [(1.0, start, start + len(wrapped))]


def test_runs_equal_all_comparisons_and_repeats_stay_cheap():
    import random

    rng = random.Random(3)
    templates = {"a": "one two three four five six seven eight", "b": "two three nine four", "c": "ten two one"}
    scanner = licences.Scanner(templates, 0.7)
    matched = 0
    for _ in range(300):
        lines = [" ".join(rng.choice("one two three four five six seven eight nine ten".split()) for _ in range(rng.randint(0, 4))) for _ in range(7)]
        if rng.random() < 0.5:
            lines[2:5] = ["one two three", "", "four five six seven eight"]
        best = max(dice("\n".join(lines[i:j]), t) for i in range(7) for j in range(i + 1, 8) for t in templates.values())
        got = max((x[0] for x in scanner.scan("\n".join(lines))), default=0)
        assert got == (best if best >= 0.7 else 0)
        matched += got > 0
    assert 100 < matched < 300
    full = licences.Scanner(licences.TEMPLATES)
    assert full.scan("\n".join([licences.TEMPLATES["CC-BY-4.0 work"], "of the"] * 5_000))
