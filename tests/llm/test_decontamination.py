import random
import re

import pytest

from docketry.llm import decontamination as dc
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w = words(text)
    hit, found = set(), set()
    for name, item in items:
        v = words(item)
        n = min(window, len(v))
        for g in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == g:
                    hit |= set(range(i, i + n))
                    found.add(name)
    return len(w), hit, found


def spans_to_set(flat):
    return {i for a, b in zip(flat[::2], flat[1::2], strict=True) for i in range(a, b)}


@pytest.mark.parametrize("window", [3, 10])
def test_automaton_against_brute_force(window):
    rng = random.Random(window)
    for _ in range(150):
        items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 18)))) for i in range(5)]
        automaton = dc.ItemAutomaton([(n, dc.words_of(t)) for n, t in items if dc.words_of(t)], window)
        text = " ".join(rng.choice("abcd" if rng.random() < 0.5 else "ab") for _ in range(60))
        spans, found = automaton.scan(dc.words_of(text))
        n, hit, names = brute(text, items, window)
        assert {i for a, b in spans for i in range(a, b)} == hit
        assert {automaton.names[k] for k in found} == names
        assert spans == dc.merge_spans(spans) or window == 3


@pytest.fixture(scope="module")
def bench(spark, texts):
    long = texts[13]
    rows = [(1, long), (2, "Only, four SHORT words"), (3, None), (4, ""), (5, "!!"), (6, prose(77, 40)), (7, " ".join(long.split()[3:20])), (None, prose(78, 30)), (2, "Only, four SHORT words")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block", [10, 200_000])
def test_documents_against_brute_force(spark, docs, bench, block):
    extra = spark.createDataFrame([(700, "so only four short words here " + prose(77, 40) + " and " + prose(78, 12), "en", "s", 1)], docs.schema)
    table = docs.where("length(text) < 5000 OR text IS NULL").union(extra)
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    found, *names = dc.mark_contamination(table, bench, block_words=block)
    assert names == ["__n_words", "__spans", "__items"]
    rows = found.collect()
    assert len(rows) == table.count()
    marked = 0
    for r in rows:
        n, hit, names = brute(r["text"], items)
        assert (r["__n_words"], spans_to_set(r["__spans"])) == (n, hit)
        assert {x for x in r["__items"] if x} == {str(x) for x in names if x is not None}
        marked += bool(hit)
    assert marked >= 2


def test_many_blocks_in_bounded_passes(spark, docs, monkeypatch):
    """Fifty blocks, a few at a time: marks are those of one automaton, and what a pass holds stays under the bound."""
    import pickle

    items = [(i, prose(500 + i, 60)) for i in range(100)]
    rows = spark.createDataFrame([(i, " ".join([prose(900 + i, 15), *(prose(500 + (7 * i + k) % 110, 60) for k in range(3))]), "en", "s", 1) for i in range(12)], docs.schema)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {r["doc_id"]: r for r in dc.mark_contamination(rows, bench)[0].collect()}
    sizes = []
    send = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, automata: sizes.append((len(automata), sum(map(len, automata)))) or send(self, automata))
    one = len(pickle.dumps(dc.ItemAutomaton([(1, dc.words_of(items[0][1]))])))
    monkeypatch.setattr(dc, "PASS_BYTES", 40 * one)
    blocks = dc.item_automata(bench, block_words=120).count()
    found = {r["doc_id"]: r for r in dc.mark_contamination(rows, bench, block_words=120)[0].collect()}
    assert blocks > 40 and len(sizes) > 1 and sum(n for n, _ in sizes) == blocks and max(b for _, b in sizes) <= 40 * one
    for d, r in whole.items():
        assert (found[d]["__n_words"], found[d]["__spans"], set(found[d]["__items"])) == (r["__n_words"], r["__spans"], set(r["__items"])) and r["__items"]


@pytest.mark.parametrize("broadcast", [0, 32 << 20])
def test_passes_write_marks_and_no_texts(spark, docs, monkeypatch, tmp_path, broadcast):
    """A hundred passes over long texts, most of them clean and one a third of all rows: what is written is a small part of the texts."""
    from pathlib import Path

    from docketry.llm import common

    items = [(i, prose(500 + i, 60)) for i in range(100)]
    long = [(i, prose(2000 + i, 2000), "en", "s", 1) for i in range(20)]
    marked = [(100 + i, prose(900 + i, 15) + " " + prose(500 + 9 * i, 60) + " " + prose(501 + 9 * i, 60), "en", "s", 1) for i in range(10)]
    rows = spark.createDataFrame([*long, *marked, *[marked[3]] * 15, (200, None, "en", "s", None)], docs.schema)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted((r["doc_id"], r["__n_words"], r["__spans"], sorted(r["__items"])) for r in dc.mark_contamination(rows, bench)[0].collect())
    monkeypatch.setattr(dc, "PASS_BYTES", 1)
    monkeypatch.setattr(dc, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    out = dc.mark_contamination(rows, bench, block_words=60)[0]
    found = sorted((r["doc_id"], r["__n_words"], r["__spans"], sorted(r["__items"])) for r in out.collect())
    assert found == whole and sum(bool(r[2]) for r in found) == 25
    passes = [p for p in Path(tmp_path).glob("marks-*")]
    written = [r for p in passes for r in spark.read.parquet(f"file://{p}").collect()]
    assert len(passes) > 50 and len(written) <= 3 * 10 and set(written[0].asDict()) == {"h0", "h1", "spans", "items"}
    payload = sum(16 + 4 * len(r["spans"]) + sum(map(len, r["items"])) for r in written)
    assert 100 * payload < sum(len(r["text"] or "") for r in rows.collect())


def test_removal(spark, docs, bench):
    text = "Before it all. " + prose(77, 40) + "!\nAfter it, " + prose(90, 60)
    rows = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, prose(77, 40), "en", "s", 1), (3, None, "en", "s", None), (4, "clean  text \n", "en", "s", 13)], docs.schema)
    out = {r["doc_id"]: r for r in dc.remove_contamination(rows, bench).collect()}
    assert set(out) == {1, 3, 4} and out[3]["text"] is None and out[4]["text"] == "clean  text \n"
    assert out[1]["text"].startswith("Before it all.\n") and out[1]["text"].endswith(prose(90, 60)) and out[1]["n_chars"] == len(out[1]["text"])
    assert not brute(out[1]["text"], [(1, prose(77, 40))])[1]


def test_empty(spark, docs, empty, odd, bench):
    assert dc.remove_contamination(empty, bench).collect() == []
    none = spark.createDataFrame([], bench.schema)
    assert dc.remove_contamination(odd, none).count() == odd.count()
    assert dc.remove_contamination(odd, none).columns == odd.columns
