import random

import xxhash
from pyspark.sql import functions as F

from planlake.llm import simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = [w for w in (text or "").translate(LOW).replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(fps, bits=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_the_plain_one():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 40, 3000):
        text = "".join(rng.choice(["Ab", "é", "x", "Zz9"]) + rng.choice([" ", "\n", "\t\r", "\x0b"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == [plain_fingerprint(text)]
    assert simhash.fingerprint(" \u00a0 ".encode()) == [plain_fingerprint("\u00a0")]
    one, two = simhash.fingerprint(b"a b c d e f", 5, 42, 2)
    assert one == simhash.fingerprint(b"a b c d e f", 5)[0] and two == simhash.fingerprint(b"a b c d e f", 5, 43)[0]


def test_groups_match_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {0, 1, (1 << 64) - 1}
    for b in base:
        fps.add(b)
        for _ in range(rng.choice([0, 1, 8])):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    want = plain_groups(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for segments, chunk in ((2, 4096), (5, 4096), (3, 2), (2, 3)):
        edges = simhash.link_fingerprints(frame, 4, segments, chunk).withColumnsRenamed({"a_fp": "a", "b_fp": "b"})
        roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
        mine = [roots.get(x, x) for x in signed]
        assert len({(a, b) for a, b in zip(mine, want)}) == len(set(mine)) == len(set(want))


def test_edges_of_a_large_group_are_few(spark):
    frame = spark.range(1 << 10).selectExpr("id as fp")
    assert simhash.link_fingerprints(frame).count() <= 34 * 1024


def test_odd_rows(spark):
    rows = [(3, None, "x"), (1, "", "x"), (None, "", "x"), (2, "same words here again", "y"), (2, "same words here again", "y"), (9, "same WORDS here  again", "z"), (5, "y " * 50_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["component_id"]) for r in simhash.near_groups(docs).collect())
    assert got == [((False, 1), 1), ((False, 2), 2), ((False, 2), 2), ((False, 3), 1), ((False, 5), 5), ((False, 9), 2), ((True, 0), 1)]
    kept = simhash.keep_one_each(docs.withColumn("keep_id", F.lit(1))).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, ""), (2, rows[3][1]), (5, rows[6][1])]
    assert simhash.keep_one_each(docs.limit(0)).count() == 0
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_texts_of_one_id_are_kept_apart(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one, 1), (1, two, 2), (1, two, 3), (2, one + " x", 4), (None, "other words", 5), (None, "other words", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    assert sorted((r["n"] for r in simhash.keep_one_each(docs).collect())) == [1, 2, 5]


def test_near_copies_of_planted_edits(spark):
    """Copies of similarity 0.8 and more go, at least nine of ten; texts that share little stay."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, near = [], 0
    sh = lambda w: {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
    for i in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 400))]
        rows.append((2 * i, " ".join(words)))
        copy = list(words)
        for _ in range(rng.randrange(1, 2 + len(words) // 45)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        a, b = sh(words), sh(copy)
        if i % 3 and len(a & b) / len(a | b) >= 0.8:
            rows.append((2 * i + 1, " ".join(copy)))
            near += 1
        else:
            rows.append((2 * i + 1, " ".join(words[: len(words) // 3] + [rng.choice(vocabulary) for _ in range(len(words))])))
    got = {r["doc_id"] for r in simhash.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got >= {2 * i for i in range(300)} and near > 150
    gone = 600 - len(got)
    assert 0.9 * near <= gone <= near
