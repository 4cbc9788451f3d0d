import itertools
import random
import tracemalloc

import numpy as np
import pytest

from tests.conftest import rows
from treeline.llm import spans as S
from treeline.llm import suffixes as T

L, W = 60, 15  # short stretches for small texts; the shortest seed still fits


def brute(texts, length):
    pairs, cover = set(), {i: set() for i, _ in texts}
    found = {}
    for i, t in texts:
        for k in range(len(t or "") - length + 1):
            found.setdefault(t[k : k + length], {}).setdefault(i, []).append(k)
    for members in found.values():
        if len(members) > 1:
            ids = sorted(members)
            pairs |= {(a, b) for a in ids for b in ids if a < b}
            for i, places in members.items():
                for k in places:
                    cover[i] |= set(range(k, k + length))
    return sorted(pairs), {i: len(c) for i, c in cover.items()}


def texts(seed, n=40):
    r = random.Random(seed)
    alphabet = "ab é文𝒳\n"
    word = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    common = [word(r.randrange(L - 20, 3 * L)) for _ in range(6)] + ["=" * 150, "-=" * 70, "x" * (L - 1)]
    out = []
    for i in range(n):
        parts = [word(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 4)):
            c = r.choice(common)
            a = r.randrange(0, len(c) // 2)
            parts += [c[a : a + r.randrange(10, len(c))], word(r.randrange(0, 40))]
        out.append((i, "".join(parts)))
    return [*out, (n, out[3][1]), (n + 1, out[3][1]), (n + 2, None), (n + 3, ""), (n + 4, common[0] * 3)]


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "x") for r in data], "doc_id bigint, text string, key int, doc string")


@pytest.mark.parametrize("most", [10**6, 3, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_amounts_against_brute_force(spark, seed, most):
    data = texts(seed)
    df = frame(spark, data + data[:5])  # repeated rows count once
    pairs, cover = brute(data, L)
    assert pairs
    assert sorted(rows(S.sharing_pairs(df, length=L, window=W, most_in_group=most))) == pairs
    got = {r.doc_id: r.shared_chars for r in S.shared_amounts(frame(spark, data), length=L, window=W, most_in_group=most).collect()}
    assert got == cover
    spans = S.shared_spans(frame(spark, data), length=L, window=W, most_in_group=most).collect()
    runs = {}
    for r in spans:
        assert r.end - r.start >= L
        runs.setdefault(r.doc_id, []).append((r.start, r.end))
    assert {i: sum(e - s for s, e in x) for i, x in runs.items()} == {i: n for i, n in cover.items() if n}
    assert all(a[1] < b[0] for x in runs.values() for a, b in itertools.pairwise(sorted(x)))


def test_at_the_border_of_the_length(spark):
    r = random.Random(4)
    base = "".join(r.choice("abcdefgh ") for _ in range(400))
    other = lambda n: "".join(r.choice("ijklmnop") for _ in range(n))
    df = frame(spark, [(1, other(90) + base + other(70)), (2, "QRSTU" + base), (3, base[:399] + other(500)), (4, base[1:] + other(9)), (5, base)])
    assert rows(S.sharing_pairs(df)) == [(1, 2), (1, 5), (2, 5)]
    assert [r[2] for r in sorted(map(tuple, S.shared_amounts(df).collect()))] == [400, 400, 0, 0, 400]


def test_once_in_one_document_only_is_none(spark):
    base = "".join(random.Random(5).choice("abcdefgh ") for _ in range(500))
    assert rows(S.sharing_pairs(frame(spark, [(1, base + base), (2, "short"), (3, None)]))) == []
    assert S.sharing_pairs(frame(spark, []).limit(0)).count() == 0


def suffixes(seed, n, left=20):
    r = np.random.default_rng(seed)
    chars = r.integers(97, 100, (4, 2 * left))[r.integers(0, 4, n)].astype(np.uint32)
    chars[r.random((n, 2 * left)) < 0.03] = 120
    return r.integers(0, 3, n).cumsum() // 40, r.integers(0, n, n), r.integers(0, left + 1, n), r.integers(0, left + 1, n), chars


@pytest.mark.parametrize("seed", range(6))
def test_trees_find_what_each_pair_of_suffixes_shares(seed, monkeypatch):
    left = 20
    group, doc, before, after, chars = suffixes(seed, 150, left)
    if seed > 2:  # many that end where their text does
        before[::2], after[1::2] = left, left
    monkeypatch.setattr(T, "MEMBERS", 200 if seed % 2 else 1 << 19)
    pairs, cover = set(), {}
    for x, y in itertools.combinations(range(len(doc)), 2):
        if group[x] != group[y] or doc[x] == doc[y]:
            continue
        reach = lambda a, b, most: next((i for i in range(most) if a[i] != b[i]), most)
        l = reach(chars[x, :left][::-1], chars[y, :left][::-1], min(before[x], before[y]))
        r = reach(chars[x, left:], chars[y, left:], min(after[x], after[y]))
        if l + r >= left:
            pairs.add((min(doc[x], doc[y]), max(doc[x], doc[y])))
            for i in (x, y):
                cover[i] = [max(p, q) for p, q in zip(cover.get(i, (0, 0)), (l, r), strict=True)]
    forest = T.Forest(group, doc, before, after, chars)
    monkeypatch.setattr(S, "PAIRED", 3)
    got = {(int(a[i, j]), int(b[i, k])) for rep, d in forest.repeats() for a, b in S._blocks_of(rep, d) for i in range(len(a)) for j in range(a.shape[1]) for k in range(b.shape[1]) if a[i, j] < b[i, k]}
    assert got == pairs and pairs
    rows_, l, r = forest.extents()
    assert {int(i): [int(x), int(y)] for i, x, y in zip(rows_, l, r, strict=True)} == {i: [int(x), int(y)] for i, (x, y) in cover.items()}


def test_a_large_group_of_copies_needs_little_memory():
    n, left = 8192, 200
    r = np.random.default_rng(7)
    chars = np.repeat(r.integers(97, 123, (1, 2 * left)), n, 0).astype(np.uint32)
    chars[: n // 2, -3:] = r.integers(97, 123, (n // 2, 3))
    full = np.full(n, left)
    tracemalloc.start()
    forest = T.Forest(np.zeros(n, np.int64), np.arange(n), full, full, chars)
    ids, most = 0, 0
    for rep, d in forest.repeats():
        for a, b in S._blocks_of(rep, d):
            ids, most = ids + a.size + b.size, max(most, a.shape[1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids >= n and most <= S.PAIRED and peak < 300 << 20


def test_groups_of_any_size_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRED", 4)
    data = [(1, i) for i in range(30)] + [(2, 5), (2, 90), (3, 7)]
    blocks = S.block_pairs(spark.createDataFrame(data, "g int, doc bigint"), ["g"])
    assert blocks.selectExpr("max(size(docs_a))").first()[0] < 15
    assert rows(S._pairs(blocks)) == sorted([(5, 90), *((a, b) for a in range(30) for b in range(a + 1, 30))], key=repr)


def test_anchors_do_not_depend_on_what_surrounds_a_stretch():
    r = np.random.default_rng(2)
    core = r.integers(97, 101, 700).astype(np.uint32)
    for cut in (S.SEGMENT, 300):
        found = []
        for lead in (0, 13, 977):
            codes = np.concatenate([r.integers(97, 101, lead).astype(np.uint32), core, r.integers(97, 101, 50).astype(np.uint32)])
            ok = np.zeros(len(codes), bool)
            ok[lead : lead + 301] = True
            old, S.SEGMENT = S.SEGMENT, cut
            place, key = S.anchors(codes, ok)
            S.SEGMENT = old
            found.append([(p - lead, k) for p, k in zip(place.tolist(), key.tolist(), strict=True)])
        assert found[0] == found[1] == found[2] and found[0]


def test_very_long_texts(spark):
    r = np.random.default_rng(3)
    word = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    core = word(450)
    long = word(S.BLOCK + 100_000) + "A" + core + "B" + word(50_000)
    df = frame(spark, [(1, long), (2, word(700) + "C" + core), (3, "=" * 300_000), (4, "-" * 500 + "=" * 401)])
    assert rows(S.sharing_pairs(df)) == [(1, 2), (3, 4)]
    got = {r.doc_id: r.shared_chars for r in S.shared_amounts(df).collect()}
    assert got == {1: 450, 2: 450, 3: 300_000, 4: 401}
