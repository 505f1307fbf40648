"""Ids that repeat with different texts, ids that aren't numbers, and rows without ids."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_formats import SPACED, sha

from tallyframe.llm import near_dup, substring_dedup


def shared_rows(name):
    """Ids by ``name`` (a number to an id) with texts that share passages; some ids have several texts, some no id."""
    rng = random.Random(11)
    word = lambda k: [f"{k}{rng.randrange(10**6)}" for _ in range(20)]
    passages = [word("p") for _ in range(4)]
    rows = [(1, " ".join(f"a{i}" for i in range(30))), (5, " ".join([*(f"a{i}" for i in range(30)), *(f"q{i}" for i in range(5))])), (5, " ".join(f"b{i}" for i in range(40)))]
    for k in range(40):
        rows.append((rng.choice([2, 3, 5, 7, 20, 21, 100]), " ".join(word("x") + passages[k % 4][: rng.randrange(10, 21)] + word("y"))))
    rows += rows[5:9] + [(50, rows[6][1]), (None, rows[6][1]), (None, rows[3][1]), (30, None), (30, ""), (None, None)]
    return [(None if i is None else name(i), t) for i, t in rows]


def without_repeats(rows, size=13):
    """(id, words, removed, digest of what is kept) of each row."""
    first = {}
    for i, t in rows:
        w = SPACED.findall(t or "")
        for k in range(len(w) - size + 1):
            if i is not None:
                x = tuple(w[k : k + size])
                first[x] = min(i, first.get(x, i))
    out = []
    for i, t in rows:
        w = SPACED.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return Counter(out)


@pytest.mark.parametrize("kind,name", [("long", lambda i: i), ("string", lambda i: f"doc-{i}"), ("int", lambda i: -i), ("double", lambda i: i / 7)])
def test_repeats_by_any_ids(spark, kind, name):
    rows = shared_rows(name)
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumns({"_key": F.lit("x"), "x0": F.lit(1)}).repartition(3)
    want = without_repeats(rows)
    assert sum(k[2] * n for k, n in want.items()) > 100
    assert Counter(map(tuple, substring_dedup.report(df).collect())) == want
    cut = substring_dedup.remove_repeats(df)
    assert cut.columns == df.columns and cut.schema["doc_id"] == df.schema["doc_id"]
    assert Counter((r["doc_id"], sha(" ".join(SPACED.findall(r["text"] or "")))) for r in cut.collect()) == Counter({k: sum(n for x, n in want.items() if (x[0], x[3]) == k) for k in {(x[0], x[3]) for x in want}})


def test_text_of_a_repeated_id_stays(spark):
    rows = shared_rows(lambda i: i)[:3]
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 30): 0, (5, 35): 30, (5, 40): 0}


@pytest.mark.parametrize("kind,name", [("string", lambda i: f"doc-{i}"), ("double", lambda i: i / 7)])
def test_near_duplicates_by_any_ids(spark, kind, name):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(5)]
    texts = [(k, base[k % 5] + (" more" if k % 2 else "")) for k in range(20)] + [(19, "another text of the id " + base[0][:200]), (None, base[1]), (40, None)]
    numbers = spark.createDataFrame(texts, "doc_id long, text string")
    named = spark.createDataFrame([(None if i is None else name(i), t) for i, t in texts], f"doc_id {kind}, text string")
    back = {name(i): i for i, _ in texts if i is not None}
    rows = lambda df: sorted(((r["doc_id"], r["class_id"]) for r in near_dup.near_duplicates(df).collect()), key=repr)
    by_class = lambda pairs: Counter(Counter(c for _, c in pairs).values())
    plain, other = rows(numbers), rows(named)
    assert by_class(plain) == by_class(other) and len(other) == len(texts)
    # The smallest id is that of the ids' own order.
    groups = {}
    for i, c in other:
        groups.setdefault(c, []).append(i)
    assert all(c is None or c == min(x for x in g if x is not None) for c, g in groups.items())
    assert {back.get(i) for i, _ in other} == {i for i, _ in plain}
    assert near_dup.keep_one(named).count() == near_dup.keep_one(numbers).count()
