import hashlib
from collections import Counter

import pytest

from docketry.llm import line_dedup as ld
from tests.llm.conftest import key

SPACE = " \t\n\x0b\x0c\r"


def line_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, least=10):
    lines = [(d, (t or "").split("\n")) for d, t in rows]
    seen = Counter(k for _, ls in lines for k in {line_key(x) for x in ls} if k)
    return [(d, len(ls), [x for x in ls if seen[line_key(x)] < least or not line_key(x)]) for d, ls in lines]


@pytest.mark.parametrize("batches", [1, 4, 5])
def test_against_brute_force(docs, odd, batches):
    expected = key((d, n, n - len(k), hashlib.sha256("\n".join(k).encode()).hexdigest()) for d, n, k in brute([(r["doc_id"], r["text"]) for r in docs.collect()]))
    for table in (docs, odd):
        out, lines, kept = ld.mark_lines(table, batches=batches)
        got = [(r["doc_id"], len(r[lines]), len(r[lines]) - len(r[kept]), hashlib.sha256("\n".join(r[kept]).encode()).hexdigest()) for r in out.collect()]
        assert key(got) == expected
    assert any(r[2] for r in expected)


def test_ties_at_the_limit(spark):
    rows = [(i, "Ten\n\n nine" if i < 9 else "TEN \t\nown %d" % i) for i in range(10)] + [(20, "ten\nten"), (21, None), (22, "")]
    out = ld.drop_frequent_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert key(out.collect()) == key((d, "\n".join(k)) for d, _, k in brute(rows))


def test_runs_compact(spark):
    """Levels fill and merge; a merge of two runs is a join of buckets, without a shuffle."""
    runs = ld.LineRuns(spark, min_documents=3)
    for i in range(5):
        runs.add(ld.line_hashes(spark.createDataFrame([(i, f"common\nown {i}\npair {i // 2}")], "doc_id long, text string"), batches=1))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert runs.frequent().count() == 1
    level = runs.levels[2][0]
    plan = level.join(level.withColumnRenamed("n", "more"), ld.HASH, "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_documents_are_read_twice(spark, docs, tmp_path):
    """Once to store line hashes and once to drop lines, however many batches are counted."""
    from docketry.llm import common

    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/docs")
    table = spark.read.parquet(f"file://{tmp_path}/docs")
    out, _, _ = ld.mark_lines(table, batches=5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == docs.count() and plan.count("line-hashes") <= 1 and common._tables


def test_empty_and_columns(empty, odd):
    assert ld.drop_frequent_lines(empty).collect() == []
    assert ld.drop_frequent_lines(odd).columns == odd.columns
    once = ld.drop_frequent_lines(odd, keep_once=True)
    assert once.columns == odd.columns and once.count() == odd.count() and ld.drop_frequent_lines(empty, keep_once=True).collect() == []


def test_stage_keeps_one_copy(spark):
    """Of twelve copies the stage empties all but the first; a shared line beside own text goes everywhere."""
    import corpus_pipeline as cp

    text = "\n".join(f"line {i} of the copied text" for i in range(6))
    rows = [(i, text) for i in range(12)] + [(None, text), (0, text)]
    rows += [(20 + i, f"shared line\n{'own words ' * 8}{i}\n\nmore of it {i}") for i in range(12)]
    out = key(cp.lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert out == key([(d, (t if d == 0 else "") if t == text else t.removeprefix("shared line\n")) for d, t in rows])
