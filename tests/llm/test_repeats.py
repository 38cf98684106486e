import hashlib
import random

import numpy as np

from planlake.llm import repeats


def plain(rows, span):
    """Brute force: every window of every text, by its words."""
    first = {}
    split = [(i, (t or "").replace("\r", " ").replace("\x0b", " ").split()) if t else (i, []) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - span + 1):
                key = tuple(w[k : k + span])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - span + 1):
                if first[tuple(w[k : k + span])] < i:
                    gone[k : k + span] = [True] * span
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET", 300)
    monkeypatch.setattr(repeats, "UNIT", 60)
    rng = random.Random(6)
    for span, repeated_ids in ((6, False), (7, False), (6, True), (2, False)):
        pool = [[rng.choice("abcdé") for _ in range(rng.randrange(3, 30))] for _ in range(12)]
        rows = []
        for i in range(60):
            words = sum((rng.choice([p, [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(5)]]) for p in rng.choices(pool, k=rng.randrange(0, 6))), [])
            rows.append((rng.randrange(20) if repeated_ids else i, rng.choice([" ", "\n", " \t"]).join(words)))
        rows += [(None, rows[3][1]), (99, None), (98, ""), (97, rows[5][1]), (97, rows[5][1]), (-4, rows[7][1])]
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as places", "'y' as variant")
        got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in repeats.without_repeats(docs, span).collect()), key=repr)
        assert got == plain(rows, span), (span, repeated_ids)


def test_default_span_and_spans(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(5, " ".join(words)), (9, "a b " + " ".join(words[20:120]) + " c"), (11, " ".join(words[:49])), (12, " ".join(words[:50]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in repeats.without_repeats(docs).collect()}
    assert [(s["start"], s["end"]) for s in got[9]["spans"]] == [(2, 102)] and got[9]["kept"] == "a b c"
    assert got[5]["n_removed"] == got[11]["n_removed"] == 0 and got[12]["n_removed"] == 50 and got[12]["kept"] == ""
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_words_that_a_polynomial_hash_confuses(spark):
    even = "a"
    for _ in range(10):
        even += even.translate(str.maketrans("ab", "ba"))
    odd = even.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([even] * 60)), (2, " ".join([odd] * 60)), (3, " ".join([even] * 55))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in repeats.without_repeats(docs).collect())
    assert got == plain(rows, 50)
    # two words dealt over a window by the Thue-Morse sequence and its complement
    rows = [(i, " ".join("xy"[(bin(j).count("1") + i) % 2] for j in range(64))) for i in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in repeats.without_repeats(docs, 64).collect()) == plain(rows, 64)


def test_hashes_of_words():
    words = [bytes([c]) * n for c in b"ab" for n in (1, 7, 8, 9, 63, 64, 65, 200)] + [b"a" * 63 + b"b", b"a" * 64 + b"b"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    (h, h2), n = repeats.word_hashes(data, np.array([0, len(data)]))
    assert n.tolist() == [len(words)] and len(set(h.tolist())) == len(set(h2.tolist())) == len(words)
    assert [repeats.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0][0] for w in words] == h.tolist()
    runs = repeats.run_hashes(h, 5)
    assert len(runs) == len(h) - 4 and runs[3] == repeats.run_hashes(h[3:8], 5)[0]


def test_what_a_task_remembers(spark, monkeypatch):
    monkeypatch.setattr(repeats, "UNIT", 20)
    monkeypatch.setattr(repeats, "REMEMBERED", 40)
    rng = random.Random(3)
    shared = [f"s{i}" for i in range(30)]
    rows = [(i, " ".join([f"u{i}"] * rng.randrange(3) + shared[rng.randrange(12) : rng.randrange(14, 31)])) for i in rng.sample(range(200), 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in repeats.without_repeats(docs, 6).collect()), key=repr)
    assert got == plain(rows, 6)


def test_query_on_small_data(spark, sf):
    from planlake.llm import queries

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in plain(docs, 50))
    assert sorted(tuple(r) for r in queries.op5_repeated_spans(spark, sf).collect()) == want
