import random

from docketry.operators import matching


def slow(rows):
    """All pairs of a user, place by place from the right."""
    plain = lambda s: "".join("*" if c in "Xx*" else c for c in s if c in "0123456789Xx*")
    out = set()
    for u, i, s in rows:
        for w, j, t in rows:
            if u is None or u != w or s is None or t is None or not i < j:
                continue
            a, b = plain(s)[::-1], plain(t)[::-1]
            pairs = list(zip(a, b, strict=False))
            shown = "".join("1" if x != "*" and y != "*" else "0" for x, y in pairs)
            if all(x == y or "*" in (x, y) for x, y in pairs) and "1" * matching.VISIBLE in shown:
                out.add((u, i, j))
    return out


def test_pairs_as_by_brute_force(spark):
    rng = random.Random(7)
    rows = [(1, 1, "XXXX-1234"), (1, 2, "****1234"), (1, 3, "12-34-1234"), (1, 4, "99-34-1234"), (1, 5, "1234****"), (1, 6, "234"), (1, 7, ""), (1, 8, None), (None, 9, "1234"), (1, 10, "xx**5678"), (2, 11, "12341234")]
    for i in range(400):
        digits = [rng.choice("12") for _ in range(rng.randrange(3, 12))]
        for _ in range(rng.randrange(0, 4)):
            a = rng.randrange(len(digits))
            digits[a : a + 3] = [rng.choice("X*x")] * len(digits[a : a + 3])
        rows.append((rng.randrange(5), 100 + i, "-".join("".join(digits)[k : k + 4] for k in range(0, len(digits), 4))))
    table = spark.createDataFrame(rows + rows[:5], "user_id long, id long, account_number string")
    found = [tuple(r) for r in matching.masked_pairs(table).collect()]
    assert len(found) == len(set(found)) and set(found) == slow(rows) and len(found) > 50
    assert {(1, 1, 2), (1, 1, 3), (1, 2, 3), (1, 1, 4)} <= set(found) and (1, 3, 4) not in found and (1, 2, 5) not in found


def test_no_cross_join_and_empty(spark):
    empty = spark.createDataFrame([], "user_id long, id long, account_number string")
    out = matching.masked_pairs(empty)
    assert out.count() == 0 and not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("Cartesian", "NestedLoop"))


def test_runs_are_not_broadcast(spark):
    """However small the table is thought to be, its runs are shuffled."""
    table = spark.range(300).selectExpr("id % 3 AS user_id", "id", "concat('XXXX-', 1000 + id % 50) AS account_number")
    out = matching.masked_pairs(table)
    assert out.count() == 3 * 50 * 1 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
