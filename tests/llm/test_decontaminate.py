import random

import numpy as np

from planlake.llm import decontaminate
from planlake.llm import decontaminate as d


def distance_in(pattern, text):
    """Least edits of pattern against any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        at = rng.randrange(len(s))
        kind = rng.random()
        if kind < 0.4:
            s[at] = rng.choice("abcdefg ")
        elif kind < 0.7:
            del s[at]
        else:
            s.insert(at, rng.choice("abcdefg"))
    return "".join(s)


def test_find_matches_brute_force():
    rng = random.Random(3)
    items = ["".join(rng.choice("abcdefgh  ") for _ in range(n)) for n in (30, 81, 130, 200, 9)]
    index = d.build_index(items)
    for trial in range(60):
        text = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(10, 300)))
        for _ in range(2):
            it = rng.choice(items[:4])
            a = rng.randrange(max(1, len(it) - 80))
            text += edited(rng, it[a : a + rng.randrange(40, 200)], rng.randrange(9)) + "".join(rng.choice("abcxyz ") for _ in range(30))
        doc = d.normal(text)
        want = set()
        for w in range(len(index.items)):
            pattern = bytes(index.text[w, : index.sizes[w]])
            if distance_in(pattern, doc) <= index.budget[w]:
                want.add((int(index.items[w]), int(index.starts[w])))
        got = d.find(index, text)
        assert sorted(x[0] for x in got) == sorted(i for i, _ in want), trial


def test_quotes_are_found_wherever_they_start():
    rng = random.Random(5)
    items = [d.normal("".join(rng.choice("abcdefgh  ") for _ in range(n))) for n in (150, 300, 60, 1000)]
    index = d.build_index([x.decode() for x in items])
    for trial in range(300):
        i = rng.choice([0, 1, 3])
        n = rng.randrange(d.SPAN, 120)
        a = rng.randrange(len(items[i]) - n + 1)
        text = "zq " * rng.randrange(1, 30) + items[i][a : a + n].decode() + " zq" * rng.randrange(1, 30)
        found = d.find(index, text)
        assert (i, 0) in {x[:2] for x in found}, (trial, a, n)
        if trial >= 294:  # and nothing else than what all windows give
            windows = [(j, x[s : s + d.SPAN]) for j, x in enumerate(items[:3]) for s in range(max(1, len(x) - d.SPAN + 1))]
            least = [(j, distance_in(w, d.normal(text)), int(len(w) * d.RATE)) for j, w in windows]
            assert sorted(x[:2] for x in found if x[0] < 3) == sorted((j, e) for j, e, most in least if e <= most)
            assert d.find(index, text, first=True)


def test_rows(spark, monkeypatch):
    rng = random.Random(4)
    item = "".join(rng.choice("abcdefgh ") for _ in range(160))
    docs = [(1, "x " * 99 + item.upper().replace(" ", "\n\t") + " y", 5), (2, "x " * 2000, 5), (3, None, 5), (4, "", 5), (None, item, 5), (1, item, 5), (6, edited(rng, item, 5), 5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(10, item), (11, None), (12, "short"), (10, item)], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["edits"] == 0) for r in d.matches(frame, bench).collect())
    assert got[:3] == [(0, 10, True), (1, 10, True), (1, 10, True)] and got[3][:2] == (6, 10)
    assert sorted(r["doc_id"] for r in d.clean(frame, bench).collect()) == [2, 3, 4]
    assert sorted(map(repr, d.matches(frame, bench, block_bytes=40).collect())) == sorted(map(repr, d.matches(frame, bench).collect()))
    assert d.matches(frame.limit(0), bench).count() == 0 and d.matches(frame, bench.limit(0)).count() == 0
    assert d.clean(frame, bench.limit(0)).count() == len(docs)


def test_common_grams_go_in_bounded_pieces(monkeypatch):
    """Items that share most of their text, and a repetitive document: the same windows whatever the size of a piece."""
    rng = random.Random(8)
    boiler = "please read the question and choose the best of the answers that are given below "
    items = [boiler + " ".join(rng.choice(["red", "green", "blue", "one", "two"]) + str(rng.randrange(30)) for _ in range(12)) for _ in range(20)] + ["ab" * 60]
    index = decontaminate.build_index(items)
    docs = [items[3] + " and " + items[15][20:150] + " end", boiler * 4 + items[7][90:], "x" + "ab" * 50 + " y", boiler[:60]]
    whole = [decontaminate.find(index, t) for t in docs]
    assert {3, 15} <= {r[0] for r in whole[0]} and {r[0] for r in whole[2]} == {20} and not whole[3]
    for hits in (5000, 1000):
        monkeypatch.setattr(decontaminate, "_HITS", hits)
        assert [sorted(r[:2] for r in decontaminate.find(index, t)) for t in docs] == [sorted(r[:2] for r in w) for w in whole]
        assert [bool(decontaminate.find(index, t, first=True)) for t in docs] == [bool(w) for w in whole]
