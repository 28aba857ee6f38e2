import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docketry.llm import packing as p

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " ", "a b", " a", "a ", "a\nb", "a \nb", "\n", "\n\na", "x\n\n\ny", "don't 's\n'll it's 12.5€ <|endoftext|> z", "a\tb", "a\x00 b\x00", "é ü x  y", "\na\n", " \n", "x \x1c y", "a\x85b c", "日本 語 😀 ²³ Ⅷ१२ x̄"]


def test_ids_are_the_tokenizers():
    whole = Tokenizer.from_file(PATH)
    rng = random.Random(0)
    texts = HARD + ["".join(rng.choice(["a", "B ", " the", "\n", "'s", "é", ".", "12", " ", "ß"]) for _ in range(rng.randrange(40))) for _ in range(500)]
    for ranks in (None, public_tokenizers.path("byte_bpe_50k.tiktoken")):
        encode = p.ChunkedEncoder(PATH, ranks)
        for t in texts:
            assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_packing(docs, odd, monkeypatch, broadcast):
    monkeypatch.setattr(p, "MOST_BROADCAST", broadcast)
    whole = Tokenizer.from_file(PATH)
    for table in (docs, odd):
        rows = p.pack(table).collect()
        by_sequence, by_piece = {}, {}
        for r in rows:
            by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            by_piece.setdefault((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]), []).append(r)
        assert sorted(by_sequence) == list(range(len(by_sequence)))
        for parts in by_sequence.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= p.CAPACITY
        expected = []
        for r in docs.collect():
            ids = np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
            for start in range(0, len(ids), p.CAPACITY):
                part = ids[start : start + p.CAPACITY]
                expected.append((r["doc_id"], start, len(part), zlib.crc32(part.tobytes()), len(ids)))
        assert sorted(expected, key=repr) == sorted((k for k, v in by_piece.items() for _ in v), key=repr)


def test_ids_of_sequences(docs):
    """With ids, a piece's ids have its length and checksum, and a document's pieces decode to its text."""
    whole = Tokenizer.from_file(PATH)
    by_doc = {}
    for r in p.pack(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), with_ids=True).collect():
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append((r["start"], ids.tolist()))
    for r in docs.collect():
        if r["doc_id"] is not None:
            ids = [i for _, part in sorted(by_doc[r["doc_id"]]) for i in part]
            assert ids[-1] == p.END and whole.decode(ids[:-1], skip_special_tokens=False) == (r["text"] or "")


def test_memory_of_chunks(monkeypatch):
    """Texts without a space are encoded and not kept; what is kept stays under its bound."""
    monkeypatch.setattr(p, "MOST_KEPT", 20_000)
    whole, encode = Tokenizer.from_file(PATH), p.ChunkedEncoder(PATH, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(1)
    for text in ["日本語" * 3000, "QUJD" * 5000, *("".join(rng.choice("abcdef ") for _ in range(2000)) for _ in range(20))]:
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
        assert encode.held <= p.MOST_KEPT and all(len(c) <= p.LONGEST_KEPT for c in encode.known)
        assert sum(len(v) + p.CHUNK_COST for v in encode.known.values()) <= p.MOST_KEPT


def test_equal_rows_are_spread(spark):
    """Many equal texts without ids get different ranks, and no salt holds most of them."""
    from pyspark.sql import functions as F

    table = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    rows = p.pack(table).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 2000 and {r["length"] for r in rows} == {1}


def test_windows_are_closest_to_capacity():
    """Each window against trying all multisets."""
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        chosen = p.fill_window(counts, 40)
        longest = max(counts)
        assert chosen[longest] >= 1 and all(0 < n <= counts[k] for k, n in chosen.items())
        sums = {0}
        for k, n in counts.items():
            sums = {s + i * k for s in sums for i in range(n - (k == longest) + 1) if s + i * k <= 40 - longest}
        assert p.padding(sum(k * n for k, n in chosen.items()), 40) == min(p.padding(longest + s, 40) for s in sums)


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(0)
    counts = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 1025, 5000), return_counts=True), strict=True)}
    plan = p.plan_windows(counts)
    lengths = np.repeat(list(counts), list(counts.values()))
    ranks = np.concatenate([np.arange(v) for v in counts.values()])
    _, first, sequence, n, offset = plan[np.searchsorted(plan[:, 0] << 48 | plan[:, 1], lengths.astype(np.int64) << 48 | ranks, side="right") - 1].T
    sequence, offset = sequence + (ranks - first) // n, offset + (ranks - first) % n * lengths
    order = np.lexsort((offset, sequence))
    sequence, offset, lengths = sequence[order], offset[order], lengths[order]
    start = np.r_[True, sequence[1:] != sequence[:-1]]
    assert (offset[start] == 0).all() and (offset[1:][~start[1:]] == (offset + lengths)[:-1][~start[1:]]).all()
    totals = np.bincount(sequence, lengths)
    assert totals.max() <= 1024 and sum(p.padding(int(t)) for t in totals) < 0.01 * totals.sum()


def test_empty(empty):
    assert p.pack(empty).collect() == []
