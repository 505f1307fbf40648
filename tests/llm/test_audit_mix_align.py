"""Filter interaction audit, mixing by pivotal rounding, cross-tokenizer alignment."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import filter_audit, mixing
from tallyframe.llm import token_alignment as ta

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


# Filter audit


def failures(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, part in rows:
        t = t or ""
        w = SPACED.findall(t)
        fails = "".join(
            f
            for f, bad in zip(
                "ABCDE",
                (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t), i is not None and first[t] < i),
                strict=True,
            )
            if bad
        )
        yield part or "", fails, i


def audited(rows, good, toxic):
    """Every order applied row by row."""
    failed = list(failures(rows))
    out, shapley = {}, collections.Counter()
    for part in {p for p, _, _ in failed}:
        here = [(f, i) for p, f, i in failed if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = here
            for step, x in enumerate(order, 1):
                gone = [(f, i) for f, i in left if x in f]
                left = [(f, i) for f, i in left if x not in f]
                redundant = sum(x in f for f, _ in here) - len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(f == x for f, _ in here), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
                shapley[part, x] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(80):
        n, size = rng.choice([20, 60, 70]), rng.choice([20, 300])
        t = " ".join(rng.choice(words[:size]) for _ in range(n)) + rng.choice(["", " #", " ABCDEFGH" * 5, "\x0b$ \n\t"])
        rows.append((i, t, rng.choice(["a", "b", None, ""])))
    rows += [(100 + k, rows[k % 5][1], "c") for k in range(30)]  # copies of a few texts
    rows += [(100, rows[0][1], "c"), (3, rows[3][1], "a"), (None, rows[0][1], "a"), (None, None, None), (200, None, "a"), (201, "", "b"), (202, "x " * 40_000 + "Ünï", "b")]
    return rows


def audit_of(spark, rows, good, toxic, more=()):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit("other").alias(c) for c in more]).repartition(4)
    flagged = filter_audit.quality_flags(df).withColumns({"good": F.col("id").isin(*good), "toxic": F.col("id").isin(*toxic)})
    got = filter_audit.audit(flagged, "ABCDE", {"good": "good", "toxic": "toxic"}).collect()
    assert len(got) == len({tuple(r)[:3] for r in got})
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


@pytest.mark.parametrize("more", [(), ("id", "part", "n", "A", "digest", "words", "subset", "_part", "good")])
def test_audit_is_brute_force(spark, more):
    rows, good, toxic = audit_rows(), [0, 1, 2, 3, 100, 200, 202], [4, 5, 101]
    assert audit_of(spark, rows, good, toxic, more) == audited(rows, good, toxic)


def test_audit_without_rows_and_with_other_filters(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(filter_audit.quality_flags(empty)).count() == 0
    two = spark.createDataFrame([(None, True, None), (None, False, True), ("x", False, False)], "part string, X boolean, Y boolean")
    got = {tuple(r) for r in filter_audit.audit(two, "XY").collect()}
    assert (None, "XY", 1, 1, 1, 0, 1, 2) in got and ("x", "YX", 2, 1, 0, 0, 0, 0) in got and len(got) == 8
    with pytest.raises(ValueError):
        filter_audit.audit(two, "XX")


def test_audit_sql(spark, tmp_path):
    import duckdb

    rows = [r for r in audit_rows() if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (0, 1, 1), (5, 0, 1), (200, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = filter_audit.op12_filter_audit(spark, str(tmp_path))
    want = db.execute(filter_audit.OP12_SQL).df()[got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None))


# Mixing


def goals(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full = set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / total for s in names}
        over = {s for s in names if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def mix_rows():
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * min(3000, int(rng.paretovariate(0.8) * 8))), rng.choice(["a", "b", "b", "b", "é", "Z", None])) for i in range(600)]
    rows += [(9, "one two three", "many")] * 500 + [(9, "four five", "many"), (None, "no id", "a"), (10**6, None, "a"), (10**6 + 1, "", None), (10**6 + 2, "", "void"), (10**6 + 3, "z " * 6_000, "b")]
    return rows


def taken(df, **options):
    rows = mixing.by_row(mixing.mix(df, **options)).collect()
    return collections.Counter((r["id"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["copies"]) for r in rows)


def test_mix_meets_targets(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(SPACED.findall(t or ""))
    want = goals(dict(sizes))
    got = taken(df)
    assert sum(got.values()) == len(rows)
    words = collections.Counter()
    for (_, s, size, whole, target, copies), n in got.items():
        assert 0 <= copies <= 2 and whole == sizes[s] and abs(target - want[s]) < 1e-5
        assert size or not copies
        words[s] += size * copies * n
    for s, w in words.items():
        assert abs(w - want[s]) <= 60, s  # the largest document has 6,000 words
    # Equal rows differ by one copy at most.
    assert len({k[-1] for k in got if k[1] == "many" and k[2] == 3}) <= 2
    # Neither the order nor the partitions, nor further columns, change a thing; another seed does.
    other = df.withColumns({c: F.lit("x") for c in ("id", "key", "size", "target", "p", "n", "bucket", "place")}).orderBy(F.rand(1)).repartition(7)
    assert taken(other) == got
    assert taken(df, seed=2) != got


def test_mix_in_a_tree_of_small_buckets(spark):
    """Many levels keep the words of a source, and every fraction its chance."""
    n = 900
    units = spark.createDataFrame([(f"k{i}", "s" if i % 3 else None, 1 + i % 50, 0.3) for i in range(n)], "key string, source string, size long, p double")
    share = np.zeros(n)
    for seed in range(12):
        rows = mixing.rounded(units, seed=seed, bucket=8).collect()
        assert len(rows) == n and {r["p"] for r in rows} == {0.0, 1.0}
        for s in ("s", None):
            mass = sum(r["size"] * (r["p"] - 0.3) for r in rows if r["source"] == s)
            assert abs(mass) <= 25
        for r in rows:
            share[int(r["key"][1:])] += r["p"] / 12
    assert abs(share.mean() - 0.3) < 0.01


def test_pairs_keep_mass_and_chances():
    rng = np.random.default_rng(5)
    sizes = np.sort(rng.integers(1, 4000, 30))[::-1]
    p = rng.uniform(0.05, 0.95, 30)
    names, mean = [str(i) for i in range(30)], np.zeros(30)
    for seed in range(2000):
        q = mixing.pair_up(names, sizes, p, seed)
        assert abs((q * sizes).sum() - (p * sizes).sum()) < 1e-3
        assert ((q > 0) & (q < 1)).sum() <= 1
        mean += q / 2000
    assert np.abs(mean - p).max() < 0.06


def test_mixed_has_the_rows(spark):
    rows = mix_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, size string")
    plan = mixing.mix(df)
    out = mixing.mixed(df, plan)
    assert out.columns == df.columns
    want = collections.Counter({(r["id"], r["source"], r["digest"]): r["total"] for r in plan.collect() if r["total"]})
    assert collections.Counter((r["doc_id"], r["source"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect()) == want
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.by_row(mixing.mix(empty)).count() == 0


# Alignment


@pytest.fixture(scope="module")
def pair():
    return ta.tokenizers(*ta.paths())


def spelled_groups(text):
    """Groups of ids by the libraries themselves, a token at a time."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(spelled_groups, "both"):
        t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        t.encode_special_tokens = True
        spelled_groups.both = t, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    t, sp = spelled_groups.both
    alphabet = ta.byte_alphabet()
    if not text:
        return []
    data = (" " + text).encode()
    a = [(i, bytes(alphabet[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(x[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode()) for i in sp.encode(text) for x in [sp.id_to_piece(i)]]
    if any(b"".join(x for _, x in y) != data for y in (a, b)):
        return []
    ends = [dict(), dict()]
    for k, y in enumerate((a, b)):
        at = 0
        for i, x in y:
            at += len(x)
            ends[k][at] = i
    common = sorted(set(ends[0]) & set(ends[1]))
    return [tuple([i for e, i in sorted(ends[k].items()) if low < e <= high] for k in (0, 1)) for low, high in zip([0, *common[:-1]], common, strict=True)]


def aligned(rows):
    groups = [(i, spelled_groups(t)) for i, t in rows]
    count = collections.Counter()
    for _, gs in groups:
        count.update({(a, b) for x, y in gs for a in x for b in y})
    best = collections.Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for i, gs in groups:
        links = [(a, b) for x, y in gs for a in x for b in y]
        text = ";".join("|".join(",".join(map(str, z)) for z in g) for g in gs)
        out.append((i, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr), count


def align_rows(corpus):
    rows = [(i, t) for i, t in corpus if len(t or "") < 5000]
    odd = ["<|endoftext|> <s> </s> <0x41>", "a ▁ b", "\x00  x", " lead", "two  spaces   three ", "日本語のテキスト と 漢字", "naïve café 🙂🙂", "can't we'll", "\r\n\t x", "ab" * 300, "0123456789 " * 30, "    " * 50 + "x", " ", "\n"]
    return rows + [(10_000 + k, t) for k, t in enumerate(odd)] + [(10_000, odd[0]), (None, "no id"), (7, "twice"), (7, "twice")]


def run_alignment(df, pair, **options):
    tokens = ta.encode_pair(df, pair)
    shards = ta.count_pairs(tokens, pair, **options)
    return sorted(map(tuple, ta.align(tokens, shards, pair).collect()), key=repr), shards


def test_alignment_is_brute_force(spark, corpus, pair, monkeypatch):
    rows = align_rows(corpus)
    want, count = aligned(rows)
    assert any(w[1] == 0 for w in want) and sum(w[3] != w[4] for w in want) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got, shards = run_alignment(df, pair)
    assert got == want
    assert {(r["a"], r["b"]): r["n"] for r in ta.pair_table(spark, shards, pair).collect()} == dict(count)
    assert len(shards.paths) > 1
    clashing = df.withColumns({c: F.lit("other") for c in ("id", "a", "b", "key", "n", "path", "best")})
    # Counts handed on often, blocks of few pairs, and groups counted by distinct ids have the same result.
    monkeypatch.setattr(ta, "BLOCK_PAIRS", 7)
    monkeypatch.setattr(ta, "DENSE_LINKS", 2)
    monkeypatch.setattr(ta.tb, "CHUNK_BYTES", 100)
    assert run_alignment(clashing, pair, held_keys=10)[0] == want


def test_links_in_blocks(pair):
    """All links of groups of any size, whatever the blocks."""
    rng = np.random.default_rng(1)
    n_a, n_b = rng.integers(1, 60, 40), rng.integers(1, 60, 40)
    a, b = rng.integers(0, 50, n_a.sum()), rng.integers(0, 40, n_b.sum())
    first = lambda n: np.concatenate(([0], np.cumsum(n)))
    g = ta.Groups(a, b, np.repeat(np.arange(40), n_a), np.repeat(np.arange(40), n_b), first(n_a), first(n_b), np.arange(40) // 4)
    want = collections.Counter()
    for k in range(40):
        for x in a[first(n_a)[k] : first(n_a)[k + 1]]:
            for y in b[first(n_b)[k] : first(n_b)[k + 1]]:
                want[k // 4, (int(x) << 6) | int(y)] += 1
    got = collections.Counter()
    for document, key, times in g.links(6):
        for d, k, n in zip(document, key, np.broadcast_to(times, len(key)), strict=True):
            got[int(d), int(k)] += int(n)
    assert got == want


def test_long_texts_and_spaces(pair, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", " \n "]) for _ in range(20_000))
    whole = pair.encode(text)
    assert len(whole[0]) and len(pair.cut(text)) == 1
    monkeypatch.setattr(ta, "PIECE_CHARS", 1000)
    assert len(pair.cut(text)) > 50 and "".join(pair.cut(text)) == text
    for x, y in zip(whole, pair.encode(text), strict=True):
        assert np.array_equal(x, y)
    for t in ("\n" * 200_000 + "x", "x" * 300_000, " " * 5000):
        a, b = pair.encode(t)
        assert b"".join(pair.a_bytes[i] for i in a) == b"".join(pair.b_bytes[i] for i in b) == b" " + t.encode()


def test_alignment_of_nothing(spark, pair):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert run_alignment(empty, pair)[0] == []
    nothing = spark.createDataFrame([("x", None), ("y", "")], "doc_id string, text string")
    assert run_alignment(nothing, pair)[0] == [("x", 0, 0, 0, 0, 0, 0, ""), ("y", 0, 0, 0, 0, 0, 0, "")]
