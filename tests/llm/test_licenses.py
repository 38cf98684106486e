import random
import re

from planlake.llm import licenses, queries

BASE = [("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])]


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, name) for name, p in BASE for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({n for _, n in at}))


TEXTS = [None, "", "MIT", "MIT-License", "the M\u0130T license", "mit license mit license", "GNU General Public License, version 3.", "general public apache license", "mit license general public license " * 300, "mıt license", "\u212A mit\u00e9 license", "x" * 70000 + " mit license"]


def test_base_places(spark):
    docs = spark.createDataFrame([(i, t, "l") for i, t in enumerate(TEXTS)] + [(None, TEXTS[5], "l"), (5, TEXTS[5], "l")], "doc_id long, text string, labels string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(docs).collect()), key=repr)
    assert got == sorted(((i, *plain(t)) for i, t in [*enumerate(TEXTS), (None, TEXTS[5]), (5, TEXTS[5])]), key=repr)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_method_labels(spark):
    text = dict((t[0], t[1]) for t in licenses.TEMPLATES)["bsd-text"].split()
    near = " ".join(text[:9] + ["oops"] + text[9:])
    docs = spark.createDataFrame([(1, "Foo " + near), (2, " ".join(text[:6])), (3, "in the of the and the with the " * 50)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert got[1]["labels"] == "bsd-text" and 0.8 < got[1]["score"] <= 1 and got[2]["labels"] == got[3]["labels"] == ""


def test_recall_of_method_labels(spark):
    """Templates with a tenth of their words replaced, dropped or added, amid text that shares words with them: nine of ten are named, and little else."""
    rng = random.Random(4)
    own = [(label, text.split()) for label, text, base in licenses.TEMPLATES if not base]
    common = [w for _, words in own for w in words]
    rows, want = [], []
    for i in range(240):
        label, words = own[i % len(own)]
        copy = []
        for w in words:
            dice = rng.random()
            copy += [] if dice < 0.03 else [w, "x"] if dice < 0.05 else ["y"] if dice < 0.08 else [w]
        noise = lambda n: [rng.choice(common) for _ in range(n)]
        rows.append((i, " ".join(noise(40) + copy + noise(40))))
        want.append(label)
    rows += [(1000 + i, " ".join(rng.choice(common) for _ in range(120))) for i in range(100)]
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    method = {label for label, _, base in licenses.TEMPLATES if not base}
    assert sum(w in got[i] for i, w in enumerate(want)) >= 0.9 * len(want)
    assert sum(bool(method & set(got[1000 + i])) for i in range(100)) <= 2


def test_noise_near_a_span_does_not_hide_it(spark):
    text = dict((t[0], t[1]) for t in licenses.TEMPLATES)["bsd-text"]
    far = " ".join([text.split()[0] + " " + text.split()[1]] + ["z"] * 2) + " "
    docs = spark.createDataFrame([(1, far * 9 + text), (2, text + " " + far * 9)], "doc_id long, text string")
    assert all("bsd-text" in r["labels"] for r in licenses.scan(docs).collect())


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in queries.op6_license_scan(spark, sf).collect())
    assert got == sorted((r["doc_id"], *plain(r["text"])) for r in docs)
