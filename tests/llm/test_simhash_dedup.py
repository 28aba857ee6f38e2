from collections import defaultdict

import numpy as np
import pytest
import xxhash

from docketry.llm import simhash_dedup as sd
from tests.llm.conftest import key


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    """rows: (doc_id, fingerprint); component ids by trying all pairs."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    ids = defaultdict(list)
    for d, f in rows:
        if d is not None:
            ids[find(f)].append(d)
    return [(d, f"{f:016x}", min(ids[find(f)], default=None)) for d, f in rows]


def test_fingerprints_and_classes(docs, odd, texts):
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    expected = key(brute_classes(rows))
    assert key(sd.near_duplicates(docs).collect()) == expected
    assert key(sd.near_duplicates(odd).collect()) == expected


def test_empty(empty):
    assert sd.near_duplicates(empty).collect() == []


def test_code():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 22, 500)
    index = sd.codeword_index(words)
    assert index.min() >= 0 and index.max() < 4096
    # a word and any other one bit away share a key of their pair of segments
    for distance in (1, 2, 3):
        for _ in range(200):
            a = int(rng.integers(0, 1 << 62)) << 2 | int(rng.integers(0, 4))
            b = a
            for bit in rng.choice(64, distance, replace=False):
                b ^= 1 << int(bit)
            at, keys = sd.golay_keys(np.array([a, b], np.uint64).view(np.int64))
            assert set(keys[at == 0]) & set(keys[at == 1])


@pytest.mark.parametrize("block", [2, 5, 1024])
def test_hot_keys_in_blocks(spark, monkeypatch, block):
    """A dense cluster and chains, with keys dealt out in blocks, have the components of all pairs."""
    monkeypatch.setattr(sd, "BLOCK", block)
    rng = np.random.default_rng(1)
    fps = {0}
    for _ in range(60):
        f = 0xF0F0F0F0F0F0F0F0
        for bit in rng.choice(64, rng.integers(1, 4), replace=False):
            f ^= 1 << int(bit)
        fps.add(f)
    at = 0x123456789ABCDEF0
    for i in range(0, 24, 3):
        fps.add(at := at ^ (7 << i))
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 100)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = sd.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    from docketry.llm.components import components

    found = {r["node"]: r["root"] for r in components(links).collect()}
    groups = defaultdict(set)
    for f in signed:
        groups[found.get(f, f)].add(f & (1 << 64) - 1)
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    expected = defaultdict(set)
    for (_, f), (_, _, c) in zip(rows, brute_classes(rows), strict=True):
        expected[c].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_drop(docs, odd, empty):
    kept = sd.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    expected = {rows[i]["doc_id"] for i in brute_roots([r["text"] for r in rows])}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(expected)
    assert sd.drop_near_duplicates(empty).collect() == []


def brute_roots(texts):
    """The smallest position linked to each text at a five-word Jaccard similarity of 0.8, by trying all pairs."""
    sets = []
    for t in texts:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("small", [1, 16])
def test_drop_by_similarity(spark, monkeypatch, small):
    """Near copies go whatever their fingerprints; texts under 0.8 stay; chains of copies are one class."""
    from docketry.llm import jaccard_links
    from tests.llm.conftest import prose

    monkeypatch.setattr(jaccard_links, "SMALL", small)
    monkeypatch.setattr(jaccard_links, "PART", 3)
    rows = []
    for seed in range(6):
        words = prose(seed + 300, 200).split()
        for step in range(8):  # each further step drifts from the first
            rows.append(" ".join(words))
            words[20 * step + 5 : 20 * step + 5 + 4 * seed] = [f"new{seed}x{step}x{k}" for k in range(4 * seed)]
    expected = brute_roots(rows)
    assert 6 < len(set(expected)) < len(rows)
    kept = sd.drop_near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected))


def test_large_group_at_the_limit(spark, monkeypatch):
    """Variants of one text, some just above 0.8 of others and some just below, of several lengths: classes are those of all pairs."""
    import random

    from docketry.llm import jaccard_links
    from tests.llm.conftest import prose

    monkeypatch.setattr(jaccard_links, "SMALL", 6)
    monkeypatch.setattr(jaccard_links, "PART", 12)
    monkeypatch.setattr(jaccard_links, "COMMON", 3)
    rng, base, rows = random.Random(4), prose(700, 150).split(), []
    for i in range(90):
        words = list(base)
        for k in range(rng.randrange(7)):
            words[rng.randrange(0, len(words), 5)] = f"new{i}x{k}"
        rows.append(" ".join(words[rng.choice([0, 0, 7, 14]) :] + prose(800 + i, rng.choice([0, 0, 5, 12])).split()))
    pairs = []
    real = jaccard_links._missing
    monkeypatch.setattr(jaccard_links, "_missing", lambda *a: pairs.append(real(*a)) or pairs[-1])
    expected = set(brute_roots(rows))
    assert 3 < len(expected) < 80
    kept = sd.drop_near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(expected)
    assert pairs and pairs[0].count() < 90 * 89 / 8


def test_drop_keeps_one_of_each_class(spark):
    """Null ids and repeated ids: no class loses all its rows, and no class keeps two."""
    from tests.llm.conftest import prose

    a, b, c, d, e = (prose(400 + i, 60) for i in range(5))
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c), (7, d), (7, e), (7, e), (8, d), (None, None), (9, "")]
    kept = sd.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert key(kept.collect()) == key([(1, a), (None, b), (None, c), (7, d), (7, e), (9, "")])


def test_drop_takes_fingerprints(spark, monkeypatch):
    """Near copies within three bits go where no band holds two texts; others within three bits stay, by the exact check."""
    from pyspark.sql import functions as F

    from tests.llm.conftest import prose

    near = lambda x, y: bin(brute_fingerprint(x) ^ brute_fingerprint(y)).count("1") <= 3
    rows = []
    for seed in range(30):
        words = prose(seed + 900, 400).split()
        copy = " ".join([*words[:-1], f"new{seed}"])
        if near(" ".join(words), copy):
            rows += [" ".join(words), copy]
    copies, repeated = len(rows) // 2, (prose(7, 9) + " ") * 60
    rows += [repeated + prose(990 + i, 30) for i in range(3)]
    assert copies > 10 and (near(rows[-1], rows[-2]) or near(rows[-1], rows[-3])) and len(set(brute_roots(rows))) == copies + 3
    real = sd.described
    monkeypatch.setattr(sd, "described", lambda *a: real(*a).withColumn("bands", F.array("node")))
    kept = sd.drop_near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_roots(rows)))
