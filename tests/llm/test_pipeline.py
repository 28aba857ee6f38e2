import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from docketry.llm import decontamination, line_dedup, packing, quality_crf, simhash_dedup
from docketry.llm.common import stored
from tests.llm.conftest import key
from tests.llm.test_decontamination import brute as brute_items
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash_dedup import brute_roots


@pytest.fixture(scope="module")
def folder(spark, docs, texts, tmp_path_factory):
    """The awkward documents, labels that make sign junk bad, and items that two documents hold."""
    from tests.llm.conftest import prose

    path = f"file://{tmp_path_factory.mktemp('corpus')}"
    junk = [(100 + i, "\n".join(f"{w.upper()}!! ## {i}" for w in prose(i, 30).split()), "en", "s", 1) for i in range(30)]
    copied = texts[20] + "\nThen more of it.\n" + prose(91, 100)
    docs.union(spark.createDataFrame([*junk, (200, copied, "en", "s", len(copied))], docs.schema)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(12, 55), *range(100, 130)]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, texts[20]), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_brute_force(spark, folder):
    """Each stage on its own input: what stays, what changes, and that nothing else does."""
    now = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in cp.STAGES:
        before = now.collect()
        now = stored(stage(spark, now, folder), name)
        after = now.collect()
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality_classifier":
            assert set(after) <= set(before) and not any(r["doc_id"] and 100 <= r["doc_id"] < 130 for r in after) and len({r["doc_id"] for r in after if r["doc_id"] in range(22, 55)}) == 33
        elif name == "line_dedup":
            expected = [(d, "\n".join(k)) for d, _, k in brute_lines([(r["doc_id"], r["text"]) for r in before])]
            assert key((r["doc_id"], r["text"]) for r in after) == key(expected) and all(r["n_chars"] == len(r["text"]) for r in after)
            assert any("shared line" in (r["text"] or "") for r in before) and not any("shared line" in r["text"] for r in after)
        elif name == "near_dedup":
            rows = sorted(before, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
            kept = set(brute_roots([r["text"] for r in rows]))
            assert key(after) == key(r for i, r in enumerate(rows) if i in kept)
        elif name == "decontamination":
            marked = {r["doc_id"]: brute_items(r["text"], items)[:2] for r in before if len(r["text"] or "") < 5000}
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
            assert gone == {d for d, (n, hit) in marked.items() if len(hit) > n / 2} and gone
            assert [r["doc_id"] for r in after if r not in before] == [200] and "Then more of it." in next(r["text"] for r in after if r["doc_id"] == 200)
        else:
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
            pieces, texts = {}, {r["doc_id"]: r["text"] for r in before}
            for r in after:
                pieces.setdefault(r["doc_id"], {})[r["start"]] = list(memoryview(r["ids"]).cast("I"))
            tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            for doc_id, parts in pieces.items():
                ids = [i for _, part in sorted(parts.items()) for i in part]
                assert tokenizer.decode(ids[:-1], skip_special_tokens=False) == (texts[doc_id] or "")
            sequences = {}
            for r in after:
                sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            assert all(sorted(s)[0][0] == 0 and sum(n for _, n in s) <= packing.CAPACITY for s in sequences.values())


def test_run_and_entry(spark, folder):
    assert cp.run(spark, folder).count() > 0
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "pipeline" in e.queries()
    numbers = sorted(int(m[1]) for n in e.queries() if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14))


def test_operators_are_called():
    assert {m.__name__ for m in (quality_crf, line_dedup, simhash_dedup, decontamination, packing)} == {getattr(cp, n).__name__ for n in ("quality_crf", "line_dedup", "simhash_dedup", "decontamination", "packing")}
