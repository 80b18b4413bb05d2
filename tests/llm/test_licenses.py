import pytest

from tarnwerk.llm import licenses

from .helpers import SCHEMA, clashing, odd_rows, prose


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(5))
def test_alignment_is_increasing_and_near_the_longest(seed):
    import random

    rng = random.Random(seed)
    b = [f"w{rng.randrange(40)}" for _ in range(60)]
    a = [w for w in b if rng.random() > 0.1]
    for _ in range(5):
        a.insert(rng.randrange(len(a)), f"new{rng.random()}")
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) >= 0.8 * lcs(a, b)


def test_increasing_subsequence():
    values = [5, 1, 6, 2, 3, 9, 4]
    assert [values[i] for i in licenses._increasing(values)] == [1, 2, 3, 4]
    assert licenses._increasing([]) == [] and licenses.align([], [1]) == []


def test_finds_templates_with_edits_and_nothing_else(spark):
    mit = licenses.TEMPLATES["mit"]
    rows = [
        (1, prose(1, 50) + "\n" + mit.upper().replace(",", " ,") + "\n" + prose(2, 50), "en", "a", 1),
        (2, prose(3, 20) + " Licensed under the Apache License, Version 2.0. " + prose(4, 20) + " Released under the MIT License.", "en", "a", 1),
        (3, mit.replace("free of charge", "at no cost").replace("copyright", "notice of rights"), "en", "a", 1),
        (4, "the license under version of the work is general", "en", "a", 1),
        (5, "Licensed under the Apache License, Version 2.0. " * 3, "en", "a", 1),
        (6, mit[: len(mit) // 3], "en", "a", 1),
    ]
    got = {r["doc_id"]: [(f["template"], f["coverage"]) for f in r["found"]] for r in licenses.scan(clashing(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[1][0] == ("mit", 1.0)
    assert [t for t, _ in got[2]] == ["apache-2.0-notice", "mit-notice"]
    assert got[3][0][0] == "mit" and 0.8 < got[3][0][1] < 1
    assert got[4] == [] and got[6] == [] and [t for t, _ in got[5]] == ["apache-2.0-notice"] * 3


def words(text):
    return [w.lower() for w in __import__("re").findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text)]


def edited(rng, template, rate, filler):
    """A copy with words changed, dropped and added, or spread out among other words."""
    out = []
    for w in template.split():
        x = rng.random()
        if x < rate / 3:
            continue
        out.append(f"new{rng.randrange(10**6)}" if x < 2 * rate / 3 else w)
        if x > 1 - rate / 3:
            out.append(f"add{rng.randrange(10**6)}")
        if rng.random() < filler:
            out += [f"fill{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 12))]
    return " ".join(out)


def test_scan_against_longest_common_subsequences(spark):
    """Recall of edited and of spread-out copies, and no stretch that the words don't hold."""
    import random

    rng = random.Random(11)
    rows, want = [], {}
    for i in range(120):
        name = rng.choice([n for n in licenses.TEMPLATES if len(words(licenses.TEMPLATES[n])) > 30])
        body = edited(rng, licenses.TEMPLATES[name], rng.choice((0.05, 0.15, 0.3)), rng.choice((0, 0, 0.3, 1.0)))
        text = prose(i, rng.randrange(0, 80)) + " " + body + " " + prose(1000 + i, rng.randrange(0, 80))
        rows.append((i, text, "en", "a", 1))
        for n, t in licenses.TEMPLATES.items():
            share = lcs(words(t), words(text)) / len(words(t))
            if share >= 0.75:
                want[i, n] = share
    got = {(r["doc_id"], f["template"]): f["coverage"] for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect() for f in r["found"]}
    assert set(got) <= set(want) and all(got[k] <= want[k] + 1e-9 for k in got)
    sure = {k for k, share in want.items() if share >= 0.8}
    assert len(want) > 100 and len(set(got) & set(want)) >= 0.95 * len(want) and len(set(got) & sure) >= 0.97 * len(sure)


def test_several_copies_in_one_text(spark):
    mit, isc = licenses.TEMPLATES["mit"], licenses.TEMPLATES["isc"]
    spread = " ".join(f"{w} filler{k}" if k % 2 else f"{w} x{k} y{k} z{k} q{k}" for k, w in enumerate(isc.split()))
    text = mit + " " + prose(5, 100) + " " + spread + " " + prose(6, 300) + " " + mit
    found = licenses.scan(spark.createDataFrame([(1, text, "en", "a", 1)], SCHEMA)).first()["found"]
    assert [f["template"] for f in found] == ["mit", "isc", "mit"] and all(f["coverage"] == 1.0 for f in found if f["template"] == "mit")
    assert all(a["end_byte"] <= b["first_byte"] for a, b in zip(found, found[1:]))


def test_spans_are_bytes_of_the_text(spark):
    text = "éé " + "All rights reserved." + " ende"
    r = licenses.scan(spark.createDataFrame([(1, text, "en", "a", 1)], SCHEMA)).first()["found"][0]
    assert text.encode()[r["first_byte"] : r["end_byte"]] == b"All rights reserved"


def test_odd_rows(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    got = licenses.scan(df)
    assert got.count() == len(odd_rows()) and got.where("size(found) > 0").count() == 0
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df, {}).where("size(found) > 0").count() == 0
    assert licenses.scan(df, {"none": "..."}).count() == len(odd_rows())
