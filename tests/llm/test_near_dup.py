import random

import numpy as np
import pyarrow as pa

from tallyframe.llm import near_dup as nd
from tallyframe.llm import textbytes as tb
from tallyframe.llm.components import components


def sequences(texts):
    return nd.kmers(tb.words(*tb.raw(pa.array(texts, pa.string())), tb.FOLDED, fold=True))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute(rows):
    """Smallest id of each class by all pairs."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    g = dict(zip([i for i, _ in rows], sequences([t for _, t in rows]), strict=True))
    ids = sorted(i for i in g if len(g[i]))
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = g[a].tolist(), g[b].tolist()
            if min(len(x), len(y)) < 0.8 * max(len(x), len(y)) or len(set(x) & set(y)) * 3 < len(set(x)):
                continue
            m = lcs(x, y)
            if m / (len(x) + len(y) - m) >= 0.8:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i, _ in rows}


def test_alignment_decides_as_the_exact_one():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(rng.choice([3, 50])) for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = [rng.randrange(60) for _ in range(rng.randrange(3))]
        if not b:
            continue
        m = lcs(a, b)
        s = m / (len(a) + len(b) - m)
        got = nd.alignment(np.array(a, np.uint64), np.array(b, np.uint64))
        assert (got >= 0.8) == (s >= 0.8) and got <= s + 1e-9


def test_occurrences_are_labelled():
    x = nd.labelled(np.array([5, 7, 5, 5], np.uint64))
    assert len(set(x.tolist())) == 4
    assert x[0] == nd.labelled(np.array([5], np.uint64))[0]


def test_sketches_hold_order():
    a = nd.labelled(np.arange(50, dtype=np.uint64))
    assert (nd.sketch(a) == nd.sketch(a.copy())).all()
    assert (nd.sketch(a) != nd.sketch(a[::-1].copy())).all()


def test_classes_are_those_of_all_pairs(documents, corpus):
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(documents).collect()}
    assert got == brute(corpus)


def test_members_left_in_a_bucket_are_compared(spark, monkeypatch):
    """A family in which the pivot doesn't link to all: the prefix filter has to find the rest."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for c in range(12):
        own = list(base)
        for k in range(3):  # a branch of its own, too far from the others
            own[7 + k * 29] = f"c{c}_{k}"
        for _ in range(3):
            w = list(own)
            w[rng.randrange(90)] = f"y{len(rows)}"
            rows.append((len(rows), " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert len(set(got.values())) > 1


def test_short_texts_are_compared_without_a_bucket(spark):
    """8 and 9 words have 4 and 5 k-mers: similar at 0.8, with sketches that can't be equal."""
    rows = []
    for c in range(20):
        w = [f"s{c}x{k}" for k in range(9)]
        rows += [(2 * c, " ".join(w)), (2 * c + 1, " ".join(w[:8] if c % 2 else w[1:]))]
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert set(got.values()) == set(range(0, 40, 2))


def test_edges(documents, clashing, empty, spark):
    assert nd.near_duplicates(empty).collect() == []
    want = sorted(map(tuple, nd.near_duplicates(documents).collect()))
    assert sorted(map(tuple, nd.near_duplicates(clashing).collect())) == want
    kept = nd.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == len({c for _, c in want})
    rows = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (2, None), (3, ""), (4, "")], "doc_id int, text string")
    got = sorted(map(str, nd.near_duplicates(rows).collect()))
    assert got == sorted(map(str, [*[r for r in rows.selectExpr("doc_id", "case when text like 'a%' then 1 else doc_id end as class_id").collect()]]))


def test_repeated_ids_are_members_by_text(spark):
    """Rows of one id with different texts are classed by their own texts, and keep_one keeps those that stand for their class."""
    t = " ".join(f"t{i}" for i in range(60))
    u = " ".join(f"u{i}" for i in range(60))
    rows = [(1, t), (7, t), (7, u), (8, u + " more"), (8, u + " more"), (9, u + " more"), (7, u)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, nd.near_duplicates(table).collect()))
    assert got == sorted([(1, 1), (7, 1), (7, 7), (8, 7), (8, 7), (9, 7), (7, 7)])
    assert sorted(map(tuple, nd.keep_one(table).collect())) == sorted([(1, t), (7, u), (7, u)])


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40) if i % 10] + [(99, 5), (5, 99)] + [(1000 + i, 2000) for i in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 10 * ((i - 1) // 10) + 1 for i in range(1, 41)} | {99: 1} | {1000 + i: 1000 for i in range(50)} | {2000: 1000}
    assert got == {k: v for k, v in want.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
