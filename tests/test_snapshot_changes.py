import random

from tests.conftest import rows
from treeline.operators import snapshot_changes as S


def changes(spark, items):
    df = spark.createDataFrame([(*r, 9, "x") for r in items], "s int, k string, a bigint, b bigint, idx int, h string")
    return sorted(rows(S.snapshot_changes(df, "s", "k", ["a", "b"])))


def test_cases(spark):
    items = [(1, "x", 1, 1), (1, "y", 1, 1), (1, "n", None, 1), (3, "x", 1, 1), (3, "n", 1, None), (3, "y", 2, 1), (3, "y", 2, 1), (9, "x", 1, 1), (9, "n", 1, None), (12, "y", 2, 1), (12, "z", 0, 0), (None, "x", 1, 1), (1, None, 1, 1)]
    assert changes(spark, items) == [(3, "n", "changed"), (3, "y", "changed"), (9, "y", "removed"), (12, "n", "removed"), (12, "x", "removed"), (12, "y", "added"), (12, "z", "added")]
    assert changes(spark, [(1, "x", 1, 1)]) == [] and changes(spark, []) == []


def test_nulls_keep_their_place(spark):
    assert changes(spark, [(1, "x", None, 5), (2, "x", 5, None)]) == [(2, "x", "changed")]
    assert changes(spark, [(1, "x", None, 0), (2, "x", 0, 0)]) == [(2, "x", "changed")]


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(5)
    state = {s: {k: r.randrange(3) for k in "abcdefghij" if r.random() < 0.6} for s in (1, 2, 4, 5, 9, 11)}
    want, order = [], sorted(state)
    for p, s in zip(order, order[1:], strict=False):
        for k in "abcdefghij":
            a, b = state[p].get(k), state[s].get(k)
            if a != b:
                want.append((s, k, "added" if a is None else "removed" if b is None else "changed"))
    items = [(s, k, v, v) for s, t in state.items() for k, v in t.items()]
    assert changes(spark, items * 2) == sorted(want)
    monkeypatch.setattr(S, "MOST_SENT", 2)  # more snapshots than are sent to every task
    assert changes(spark, items) == sorted(want)
