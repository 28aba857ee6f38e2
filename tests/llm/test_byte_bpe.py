import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from docketry.llm import byte_bpe
from docketry.llm.registry import QUERIES
from tests.llm.conftest import key

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["'s", "'ll", " the", "ing", "    ", "====", "aaaa", "<|endoftext|>", "\0", "😀", "日本", "é", "е́", "\r\n", "\x1c", "\x85", "\xa0", "　", "᠎"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.RankEncoder(byte_bpe.tokenizer_json(byte_bpe.load_ranks(RANKS)))


def strings(n):
    rng = random.Random(3)
    letters = list("aabcxyzABC019  \n\n\t\r\x0b.,!-_=*") + ODD
    for i in range(n):
        if i % 3 == 0:
            yield "".join(rng.choice("ab=- ") * rng.randrange(1, 12) for _ in range(rng.randrange(1, 8)))
        elif i % 3 == 1:
            yield "".join(rng.choice(letters) for _ in range(rng.randrange(1, 80)))
        else:
            yield "".join(chr(rng.choice([rng.randrange(32, 0xD7FF), rng.randrange(32, 0x2FF), rng.randrange(0x10000, 0x11000)])) for _ in range(rng.randrange(1, 30)))


def test_bytes_and_characters_are_one_to_one():
    table = byte_bpe.byte_characters()
    assert len(set(table)) == 256 and all(c.isprintable() and not c.isspace() for c in table)


def test_encoder_agrees_with_the_rank_library(encoder, library):
    for text in strings(6000):
        ids = np.frombuffer(encoder(text), np.int32)
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert encoder.table.decode(ids) == text.encode()


def test_offsets_tile_the_text_and_split_characters_are_shared(encoder):
    for text in [*strings(500), "a😀b", ""]:
        ids = np.frombuffer(encoder(text), np.int32)
        begin, end, first, last = encoder.table.offsets(text, ids)
        data = text.encode()
        assert b"".join(data[a:b] for a, b in zip(begin, end, strict=True)) == data
        for i, a, b, c, d in zip(ids, begin, end, first, last, strict=True):
            assert data[a:b] == encoder.table.tokens[i]
            assert data[a:b] in text[c:d].encode() and len(text[c:d].encode()) - (b - a) < 8
    _, _, first, last = encoder.table.offsets("😀", np.frombuffer(encoder("😀"), np.int32))
    assert len(first) > 1 and set(first) == {0} and set(last) == {1}


def test_parts_and_a_small_memory_change_nothing(encoder, library, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice([" word", " foo bar", "\nline", " don't", *ODD]) for _ in range(800)) for _ in range(20)] + ["x" * 5000, " " * 300 + "y"]
    monkeypatch.setattr(byte_bpe, "MOST_KEPT", 4000)
    for text in texts:
        parts = byte_bpe.parts_of(text, 100)
        assert "".join(parts) == text and "".join(byte_bpe.chunks_of(text)) == text
        assert [i for p in parts for i in library.encode_ordinary(p)] == library.encode_ordinary(text)
        assert np.frombuffer(encoder(text), np.int32).tolist() == library.encode_ordinary(text)
    assert encoder.held <= 4000


def _slow(rows, library):
    out = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    return key(out)


def test_query_agrees_with_the_rank_library(spark, docs, library, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert key(QUERIES["op13_byte_bpe"](spark, str(tmp_path)).collect()) == _slow(rows, library)


def test_odd_columns_and_empty_table(spark, odd, empty):
    clash = odd.withColumn("__ids", F.lit("mine")).withColumn("__byte_ends", F.lit(1))
    out, (ids, *offsets) = byte_bpe.encode(clash, offsets=True)
    assert out.columns[: len(clash.columns)] == clash.columns and ids not in clash.columns and len(offsets) == 4
    assert out.where(F.size(ids) != F.size(offsets[1])).count() == 0 and out.count() == odd.count()
    assert byte_bpe.encode(empty)[0].count() == 0


def test_decoding_keeps_half_characters_as_bytes(spark, encoder):
    ids = np.frombuffer(encoder("😀"), np.int32).tolist()
    rows = spark.createDataFrame([(1, ids[:1]), (2, ids), (3, None), (4, []), (5, [None, 10**9, ids[0], -1])], "doc_id int, ids array<int>")
    out, data = byte_bpe.decode(rows, "ids")
    found = {r["doc_id"]: bytes(r[data]) for r in out.collect()}
    assert found == {1: encoder.table.tokens[ids[0]], 2: "😀".encode(), 3: b"", 4: b"", 5: encoder.table.tokens[ids[0]]}
