import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from quire.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.load_ranks(f.read())


@pytest.fixture(scope="module")
def reader(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_by_the_library(spark, small, reader):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op10_byte_bpe(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        ids = reader.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_random_texts_by_the_library(ranks, reader):
    draw = random.Random(2)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN, True)
    alphabet = "abcdefgh  \t\n\r\x1c\x85\xa0'stll…ééÄß漢字かな🙂0123½²!?.,- ſͅ"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(60))) for _ in range(1500)] + ["", "ab" * 2000, "🙂" * 300, "a" * 5000, " " * 3000, "é" * 1200]
    for text, (ids, plain) in zip(texts, codec.encode(texts)):
        assert bpe._list(ids).tolist() == reader.encode_ordinary(text), repr(text)
        assert plain == text.encode()


def heap(ranks, raw):
    """The same rule one merge at a time, for comparison."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_both_queries_follow_the_rule(ranks, monkeypatch):
    draw = random.Random(3)
    for short, room in ((64, 2_000_000), (4, 2_000_000), (4, 600)):
        monkeypatch.setattr(bpe, "SHORT", short)
        monkeypatch.setattr(bpe, "ROOM", room)
        codec = bpe.Codec(ranks, public_tokenizers.PATTERN, True)
        alphabets = ("abcdeé", "ab", "Aa", "的一是在不了有和人这", "étionsment", "=-")
        pieces = list({"".join(draw.choice(a) for _ in range(draw.randrange(2, 150))) for a in alphabets for _ in range(25)})
        codec.learn(pieces)
        for piece in pieces:
            raw = piece.encode()
            assert raw in ranks or bpe._list(codec.known[piece][0]).tolist() == heap(ranks, raw), piece


def test_many_long_pieces_stay_within_memory(ranks, reader):
    """20,000 distinct pieces of 240 bytes each, and pieces that repeat one pattern for long."""
    draw = random.Random(4)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN, True)
    texts = [" ".join("".join(draw.choices(signs, k=80)) for _ in range(20_000)), "ab" * 40_000, "A" * 200_000, "的一是" * 20_000, "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=60_000))]
    for text, (ids, plain) in zip(texts, codec.encode(texts)):
        assert bpe._list(ids).tolist() == reader.encode_ordinary(text)
        assert plain == text.encode()


def test_round_trip(spark, odd):
    ids = bpe.encode(odd, PATH, public_tokenizers.PATTERN)
    back = bpe.decode(ids, PATH)
    pairs = {(r["doc_id"], bytes(r["bytes"])) for r in back.collect()}
    assert pairs == {(r["doc_id"], (r["text"] or "").encode()) for r in odd.collect()}


def test_odd_rows(odd, none):
    rows = bpe.digest(odd, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == 12 and {r["doc_id"]: r["n_tokens"] for r in rows}[1] == 0
    assert bpe.digest(none, PATH, public_tokenizers.PATTERN).count() == 0


def test_memory_is_forgotten_and_results_stay(ranks, reader, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    monkeypatch.setattr(bpe, "CHUNK", 20)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN, True)
    texts = [" ".join(f"word{i * j} x{j}" for j in range(12)) for i in range(40)]
    for text, (ids, _) in zip(texts, codec.encode(texts)):
        assert bpe._list(ids).tolist() == reader.encode_ordinary(text)
