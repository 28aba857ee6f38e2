import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docketry.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    t = text or ""
    w = WORD.findall(t)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


@pytest.mark.parametrize("few", [0, 200])
def test_base(docs, odd, monkeypatch, few):
    monkeypatch.setattr(q, "FEW_REPEATED", few)
    for table in (docs, odd):
        found = {r["doc_id"]: r for r in q.judge(table).collect()}
        for r in docs.collect():
            x = found[r["doc_id"]]
            assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == brute_base(r["text"])
            assert not (x["base_failed"] and x["kept"])


def divergence(a, b):
    js = sum((x * math.log2(2 * x / (x + y)) if x > 1e-15 else 0) + (y * math.log2(2 * y / (x + y)) if y > 1e-15 else 0) for x, y in zip(a, b, strict=True)) / 2
    return math.sqrt(max(js, 0))


def class_counts(t):
    left, out = t, []
    for p in q.CLASSES:
        new = re.sub(p, "", left)
        out.append(len(left) - len(new))
        left = new
    return [*out, len(left)]


def brute_distances(rows):
    """(class distance, word distance) of each row that passes the base rules, from the texts themselves; None where it is not tested."""
    passed = [(d, t, lang or "") for d, t, lang in rows if not brute_base(t)[-1]]

    def reference(own):
        words = Counter(w for _, t, _ in own for w in WORD.findall(t))
        size = sum(words.values())
        return [sum(x) for x in zip(*(class_counts(t) for _, t, _ in own), strict=True)], {w: n / size for w, n in words.items() if n >= q.COMMON_SHARE * size}

    def distances(text, ref):
        classes, common = ref
        words, mine = WORD.findall(text), class_counts(text)
        n = Counter(words)
        by_class = divergence([x / sum(mine) for x in mine], [x / sum(classes) for x in classes])
        a, b = [n[w] / len(words) for w in common], list(common.values())
        by_word = divergence([*a, 1 - sum(a)], [*b, max(1 - sum(b), 0)]) if common else None
        return by_class if brute_base(text)[1] >= q.MIN_CLASS_CHARS else None, by_word if len(words) >= q.MIN_COMMON_TEST_WORDS else None

    out = {}
    for lang in {x for _, _, x in passed}:
        own = [r for r in passed if r[2] == lang]
        refs = [reference(own), *([reference(passed)] if len({t for _, t, _ in own}) < q.MIN_TEXTS else [])]
        for d, t, _ in own:
            found = [distances(t, ref) for ref in refs]
            out[d] = tuple(max((v for v in x if v is not None), default=None) for x in zip(*found, strict=True))
    return out


def agree(table):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in table.collect()]
    expected, found = brute_distances(rows), q.judge(table).collect()
    assert len(found) == len(rows)
    for r in found:
        want = expected.get(r["doc_id"], (None, None))
        for mine, theirs, most in zip((r["class_distance"], r["word_distance"]), want, (q.MAX_CLASS_DISTANCE, q.MAX_WORD_DISTANCE), strict=True):
            assert (mine is None) == (theirs is None) and (mine is None or abs(mine - theirs) < 1e-6), (r, want)
            assert not (r["kept"] and theirs is not None and theirs > most)
        assert r["kept"] == (r["doc_id"] in expected and all(x is None or x <= m for x, m in zip(want, (q.MAX_CLASS_DISTANCE, q.MAX_WORD_DISTANCE), strict=True)))
    return {r["doc_id"]: r for r in found}


JUNK = "##%% @@$$ ||&& " * 5 + " ".join(f"%{i}$#" for i in range(150))


def test_junk_goes_in_any_language(spark, docs):
    """Junk of signs is rejected beside many texts of its language, alone in its language, and as several copies alone in it."""
    clean = docs.where("doc_id >= 12").withColumn("lang", F.lit("en"))
    junk = spark.createDataFrame([(900, JUNK, "en", "s", 1), (901, JUNK, "xx", "s", 1), *[(910 + i, JUNK, "yy", "s", 1) for i in range(40)]], docs.schema)
    found = agree(clean.union(junk))
    assert not any(r["kept"] or r["base_failed"] for d, r in found.items() if d >= 900)
    assert all(r["kept"] for d, r in found.items() if d < 900 and not r["base_failed"])


def test_references_leave_out_what_the_base_rules_reject(spark, docs):
    """A mass of repeated junk and of short junk does not move the reference."""
    clean = docs.where("doc_id >= 12").withColumn("lang", F.lit("en"))
    before = {d: (r["class_distance"], r["word_distance"]) for d, r in agree(clean).items()}
    failed = spark.createDataFrame([(1000 + i, "%%% $$$ ### " * 400 if i % 2 else "$1 %2 #3", "en", "s", 1) for i in range(60)], docs.schema)
    after = agree(clean.union(failed))
    assert all(after[d]["base_failed"] for d in after if d >= 1000)
    assert all(x is None or abs(x - y) < 1e-9 for d, pair in before.items() for x, y in zip(pair, (after[d]["class_distance"], after[d]["word_distance"]), strict=True))


def test_distances_are_those_of_the_formula(spark):
    """Against plain Python: a language of many texts, one of a single text, a few rows without a language, repeated rows."""
    import random

    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n, skew: " ".join(rng.choice(vocabulary[: int(1 + 399 * rng.random() ** skew)]) for _ in range(n))
    rows = [(i, text(150, 3), "aa") for i in range(40)] + [(50, text(200, 1), "aa"), (60, text(300, 2), "bb"), (70, text(120, 2), None), (71, text(180, 4), None), (72, text(99, 2), None)]
    found = agree(spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string"))
    assert found[60]["word_distance"] > 0.01 and found[60]["kept"]


def test_many_languages(spark, docs, monkeypatch):
    """Beyond the bound of the broadcast the same verdicts come by a shuffle."""
    few = {r["doc_id"]: tuple(r) for r in q.judge(docs).collect()}
    monkeypatch.setattr(q, "MOST_BROADCAST", 0)
    assert {r["doc_id"]: tuple(r) for r in q.judge(docs).collect()} == few


def test_empty(empty):
    assert q.judge(empty).collect() == []
