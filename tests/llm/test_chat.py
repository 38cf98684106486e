import hashlib
import random

from planlake.llm import chat, queries


def plain(rows):
    """rows of one conversation in order: what read_back must give."""
    every = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha(every), len(loss), sha(loss)


def test_escapes_are_reversible():
    rng = random.Random(7)
    bits = ["\\", "### ", "</turn>", "#", "<", " ", "a", "\n", ": ", "### User: ", "\\</turn>", "é", " </turn>\n"]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "system", "", "we:ird\\ ", "User", "### x"]), "".join(rng.choices(bits, k=rng.randrange(9)))) for _ in range(4)]
        window = "".join(chat.write_turn(*t)[0] for t in turns)
        assert [(r, t) for r, t, _, _ in chat.read_turns(window)] == turns


def test_texts_may_end_in_hashes():
    turns = [(role, f"{head}{'#' * n}") for n in range(1, 6) for head in ("", "title ", "\\", "### ", "</turn>") for role in ("user", "assistant", "#" * n)]
    window = "".join(chat.write_turn(*t)[0] for t in turns)
    assert [(r, t) for r, t, _, _ in chat.read_turns(window)] == turns


def test_windows(spark):
    rng = random.Random(8)
    rows = []
    for c in [*range(12), None]:
        for t in range(rng.randrange(1, 40)):
            role = "system" if t == 0 and c and c % 2 else rng.choice(["user", "assistant", "tool", None])
            rows.append((c, t, role, rng.choice([None, "", "w " * rng.randrange(1, 30), "### Assistant: </turn> \\"]), "z"))
    rows.append((3, 1, "user", "again", "z"))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    count = lambda texts: [len(t.split()) for t in texts]
    made = chat.windows(frame, count, budget=80, history=25)
    order = lambda r: (r[1], r[2] or "", r[3] or "", r[2] is not None, r[3] is not None)
    by = {}
    for r in sorted(rows, key=order):
        by.setdefault(r[0], []).append((r[2], r[3]))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(made).collect()}
    assert got == {c: plain(x) for c, x in by.items()}
    for w in made.collect():
        turns = chat.read_turns(w["text"])
        assert w["n_tokens"] <= 80 or len(turns) - w["n_repeated"] == 1
        assert len(w["loss"]) == sum(r == "assistant" for r, *_ in turns[w["n_repeated"] :])
        if w["window"] and by[w["conv_id"]][0][0] == "system":
            assert turns[0][0] == "system"
    assert any(w["n_repeated"] > 1 for w in made.collect())
    assert chat.read_back(chat.windows(frame.limit(0), count)).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    text = "\\### Assistant: </turn> ok"
    by = {}
    for c, t, r, x in sorted([*rows, (-7, 0, "user", text), (-7, 1, "assistant", text)]):
        by.setdefault(c, []).append((r, x))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.op2_chat_windows(spark, sf).collect()}
    assert got == {c: plain(x) for c, x in by.items()}
