import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from planlake.llm import coder, queries, tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(rows):
    t, start, out = Tokenizer.from_file(PATH), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_coder_round_trip():
    rng = np.random.default_rng(2)
    blocks = [np.zeros(0, np.int64), np.array([65535]), np.zeros(700, np.int64), rng.integers(0, 65536, 500), rng.zipf(1.3, 900) % 50257, np.tile([5, 6, 7, 50000], 200), np.full(3, 65535)]
    coded = coder.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, coder.decode_blocks(coded)))
    assert coder.encode_blocks([blocks[4]])[0] == coded[4]  # blocks do not depend on each other
    assert len(coded[5]) < 400 and len(coded[3]) < 2 * 500 * 1.2 + 64
    for bad in (coded[4][:-4], b"x" + coded[4][1:], coded[4][:40] + bytes([coded[4][40] ^ 1]) + coded[4][41:]):
        with pytest.raises(ValueError):
            coder.decode_blocks([bad])
    with pytest.raises(ValueError):
        coder.encode_blocks([np.array([65536])])


def test_certain_ids_round_trip():
    """Predictions that always hold take all of the weight."""
    rng = np.random.default_rng(4)
    once = rng.integers(0, 60000, 40)
    blocks = [np.tile(once, 150), np.full(6000, 7), np.concatenate([np.full(4000, 3), rng.integers(0, 65536, 300), np.tile([1, 2], 2000)])] + [np.tile(rng.integers(0, 3000, k), 9000 // k) for k in range(1, 60)]
    coded = coder.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, coder.decode_blocks(coded)))
    assert len(coded[0]) < 900 and len(coded[1]) < 200


def test_pieces_give_the_library_s_ids():
    texts = ["", " ", "a  b\n\n c", "It's we'll I'D 12three ½ €5", "x<|endoftext|>y", "日本 mixed é\u0301", "tab\tand\u00a0nbsp \u2003", "Ünïcödé ŝ ɏ ɐ", "\r\n\x0b\x0c\x85 .", "  lead  ", "'s't're", "a" * 3000, "²³¼ªº", "ǅ ƻ ǀ ʹ", "\x00\x1f\x7f\xad"]
    encoder, t = tokenfiles.Encoder(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts)):
            assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_pieces_that_a_polynomial_hash_confuses():
    even = "a"
    for _ in range(11):
        even += even.translate(str.maketrans("ab", "ba"))
    odd = even.translate(str.maketrans("ab", "ba"))
    encoder, t = tokenfiles.Encoder(PATH), Tokenizer.from_file(PATH)
    for text in (even, odd, f"{even[:12]} {odd[:12]} {even[:13]} {odd[:13]}", odd + " " + even):
        assert encoder.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_pieces_whose_hash_another_has(monkeypatch):
    monkeypatch.setattr(tokenfiles, "_mixed", lambda x: x & np.uint64(7))
    encoder, t = tokenfiles.Encoder(PATH), Tokenizer.from_file(PATH)
    for text in ("one two three four five six seven", "eight nine ten two one", "one"):
        assert encoder.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_long_texts_go_in_stretches():
    encoder, t = tokenfiles.Encoder(PATH), Tokenizer.from_file(PATH)
    for text in ("some words  and\n\nlines 12 " * 900, "x" * 9000, "no, . letters 1 2 " * 400 + " "):
        assert encoder.encode(["a", text, "b c"], chunk=1000)[1].tolist() == t.encode(text, add_special_tokens=False).ids


def test_coded_ids_beat_order_0_and_zlib(sf, spark):
    t = Tokenizer.from_file(PATH)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    ids = np.concatenate([np.array([*e.ids, 2]) for e in t.encode_batch(texts, add_special_tokens=False)])
    blocks = [ids[i : i + coder.BLOCK] for i in range(0, len(ids) - coder.BLOCK + 1, coder.BLOCK)]
    assert len(blocks) > 3
    n = sum(map(len, blocks))
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    coded = 8 * sum(map(len, coder.encode_blocks(blocks))) / n
    assert coded < entropy and coded < 8 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks) / n


def test_every_plain_character_splits_as_in_the_library():
    encoder, t = tokenfiles.Encoder(PATH), Tokenizer.from_file(PATH)
    for c in range(0x250):
        text = f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}. {chr(c)}"
        assert encoder.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids, c


def test_round_trip_of_rows(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SEGMENT", 300)
    rows = [(i * 7 % 101, f"text {i} " + "word é " * (i % 50)) for i in range(101)] + [(None, "no id"), (500, None), (501, ""), (5, "again"), (5, "again"), (900, "long " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as start")
    files = tokenfiles.write_ids(docs.repartition(3), PATH, block=64, segment=300)
    assert files.df.count() > 10
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.read_ids(files.df).collect()), key=lambda r: r[1])
    assert got == plain(rows)
    assert tokenfiles.round_trip(docs.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op10_token_ids(spark, sf).collect()), key=lambda r: r[1])
    assert got == plain(rows)
