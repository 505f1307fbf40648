"""Toxicity, decontamination, quality."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, quality, toxicity
from tallyframe.llm import textbytes as tb


def folded(t):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(table))


@pytest.fixture(scope="module")
def benchmark(corpus):
    texts = {i: t for i, t in corpus}
    picked = [texts[i] for i in sorted(texts) if texts[i] and len(texts[i].split()) > 20][:6]
    return [(10, picked[0]), (9, " ".join(picked[1].split()[5:12]).upper()), (100, "a B c"), (7, None), (8, "..."), (None, "a b"), (11, picked[2]), (11, picked[2])]


def test_decontamination_is_brute_force(spark, documents, corpus, benchmark):
    windows = {}
    for i, t in benchmark:
        w = folded(t)
        for k in range(max(1, len(w) - 9) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    bench = spark.createDataFrame(benchmark, "item_id int, text string")
    for limit in (1 << 20, 25):  # one automaton, and several
        got = {r["doc_id"]: r for r in decontaminate.find(documents, bench, most_windows=limit).collect()}
        assert len(got) == len(corpus)
        for i, t in corpus:
            w, hit, items = folded(t), set(), set()
            for n in sizes:
                for k in range(len(w) - n + 1):
                    found = windows.get(tuple(w[k : k + n]))
                    if found:
                        hit |= set(range(k, k + n))
                        items |= found
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(items))
            raw = (t or "").encode()
            assert [x for s in r["spans"] for x in folded(raw[s["start"] : s["end"]].decode())] == [w[k] for k in sorted(hit)]
    clean = decontaminate.keep_clean(documents, bench)
    assert clean.columns == documents.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, r in got.items() if not r["n_hit"]}


def test_decontamination_edges(spark, documents, clashing, empty):
    none = spark.createDataFrame([], "item_id int, text string")
    assert {r["n_hit"] for r in decontaminate.find(clashing, none).collect()} == {0}
    assert decontaminate.find(empty, none).collect() == []
    assert decontaminate.keep_clean(clashing, none).count() == documents.count()


BAD = ["vilestuff", "nastyword", "grossness"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(1500):
        w = [f"t{int(x)}" for x in rng.zipf(1.3, 60) % 3000]
        y = i % 6 == 0
        if y:
            for _ in range(4):
                w[rng.integers(60)] = BAD[rng.integers(3)] + "abcdefgh"[rng.integers(8)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    rows += [(5000, None), (5001, ""), (None, "t1 t2"), (3, rows[3][1])]
    labels += [(None, 1), (3, 0), (9999, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    documents, labels = labelled
    model = toxicity.fit(documents, toxicity.training_labels(labels))
    got = toxicity.score(documents, model).collect()
    assert len(got) == documents.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1500]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    clean = toxicity.keep_clean(documents, model)
    assert clean.count() == sum(1 - r["predicted"] for r in got)


def modelled(spark, rows):
    """The model of (label, text) rows, without calibration."""
    table = spark.createDataFrame(rows, "_label int, _text string")
    counted = toxicity._counted(table).toPandas()
    pairs = counted[counted.level == toxicity.PAIR]
    times = toxicity._times(np.stack([pairs.n0.to_numpy(), pairs.n1.to_numpy()]))
    kept = (counted.level != toxicity.PAIR) | (counted.n0 + counted.n1 >= toxicity.MIN_PAIR)
    return counted, toxicity.estimate(pa.Table.from_pandas(counted[kept]), times)


def pairs_of(text):
    return toxicity.Pairs.of(tb.words(*tb.raw(pa.array([text])), tb.FOLDED, fold=True))


def test_toxicity_counts_words_of_few_texts(spark):
    """Words of toxic texts only have an effect from the first text on, and more with each."""
    rows = [(c, " ".join(f"{i:03}plain" for i in range(k % 7, 40))) for k in range(200) for c in (0, 1)]
    times = {f"{i:03}rude": n for i, n in enumerate((1, 2, 4, 8, 12, 18))}
    rows += [(1, f"{k:03}word {w} {k:03}word") for w, n in times.items() for k in range(n)]
    _, model = modelled(spark, rows)
    p = np.concatenate([model.backoff(x.word, x.stem) for w in times for x in [pairs_of(w)]], axis=1)
    ratio = np.log(p[1] / p[0])
    assert (np.diff(ratio) > 0).all() and ratio[0] > 0 and ratio[-2] > 1


def test_toxicity_model_is_a_distribution(spark):
    """Counts by brute force; every distribution sums to 1; a text's ratio is the mean over its pairs."""
    rng = np.random.default_rng(4)
    rows = [(int(k % 3 == 0), " ".join(f"t{int(x)}" for x in rng.zipf(1.4, 40) % 200) + (" vile thing" if k % 6 == 0 else "")) for k in range(120)]
    counted, model = modelled(spark, rows)
    texts, triples = {}, {}
    for c, t in rows:
        w = folded(t)
        for x in set(w):
            texts.setdefault(x, [0, 0])[c] += 1
        for i in range(len(w)):
            left, before = (w[i - 2] if i > 1 else None), (w[i - 1] if i else None)
            triples.setdefault((before, w[i]), [set(), set()])[c].add(left)
    words = counted[counted.level == toxicity.WORD]
    assert sorted(zip(words.n0, words.n1, strict=True)) == sorted(map(tuple, texts.values()))
    pairs = counted[counted.level == toxicity.PAIR]
    assert sorted(zip(pairs.n0, pairs.n1, strict=True)) == sorted((len(a), len(b)) for a, b in triples.values())
    whole = model.word.p.sum(1) + model.stem.p.sum(1) + model.other
    assert np.allclose(whole, 1)

    def after(before, x):
        own = pairs_of(x if before is None else f"{before} {x}")
        return model.probabilities(own)[:, np.flatnonzero((own.before == 0) == (before is None))[0]]

    for before in ("t1", "t2", "vile", None):
        key = np.array([0 if before is None else pairs_of(before).word[0]], np.uint64)
        at = model.context.find(key)[0]
        scale = model.context.p[:, at] if at >= 0 else 1.0
        assert np.allclose(sum(after(before, x) for x in texts) + scale * (model.stem.p.sum(1) + model.other), 1)
    text = "t1 t2 t1 t2 vile thing unknown t1"
    w = folded(text)
    want = []
    for before, x in dict.fromkeys(zip([None, *w[:-1]], w, strict=True)):
        p = after(before, x)
        want.append(np.log(p[1] / p[0]))
    assert np.allclose(model.ratio(tb.words(*tb.raw(pa.array([text])), tb.FOLDED, fold=True)), np.mean(want))


def test_toxicity_edges(spark, labelled, documents, clashing, empty):
    _, labels = labelled
    none = labels.where("false")
    assert {r["predicted"] for r in toxicity.score(documents, toxicity.fit(documents, none)).collect()} == {0}
    assert {r["predicted"] for r in toxicity.score(documents, toxicity.fit(documents, labels.where("toxic = 1"))).collect()} == {1}
    model = toxicity.fit(empty, labels)
    assert toxicity.score(empty, model).collect() == []
    a = sorted(map(tuple, toxicity.score(clashing, model).collect()))
    assert a == sorted(map(tuple, toxicity.score(documents, model).collect()))
    assert toxicity.keep_clean(clashing, model).columns == clashing.columns


def test_labels_are_no_inputs(labelled):
    """Held-out labels don't change scores."""
    from pyspark.sql import functions as F

    documents, labels = labelled
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted(map(str, toxicity.score(documents, toxicity.fit(documents, toxicity.training_labels(x))).collect())) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_kneser_ney_sums_to_one(spark):
    texts = spark.createDataFrame([("abracadabra",), ("abba",), ("cab",)], "text string")
    model = quality.kneser_ney(texts)
    for context in (b"\0\0\0\0", b"abra", b"zzzz", b"\0abb", b"a\0\0\0"):
        keys = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)])
        assert (10 ** model.log10(keys)).sum() == pytest.approx(1, abs=1e-6)


def test_kneser_ney_is_brute_force(spark):
    corpus = ["abracadabra abra", "bar bar cab", "rab"]
    model = quality.kneser_ney(spark.createDataFrame([(t,) for t in corpus], "text string"))
    n = quality.ORDER
    top = {}
    for t in corpus:
        s = bytes(n - 1) + t.encode() + b"\0"
        for i in range(len(s) - n + 1):
            top[s[i : i + n]] = top.get(s[i : i + n], 0) + 1
    counts = {n: top}
    for k in range(n - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1

    def discount(k, c):
        t = [max(1, sum(v == j for v in counts[k].values())) for j in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1])
        j = min(c, 3)
        return min(max(j - (j + 1) * y * t[j] / t[j - 1], 0.05), j - 0.05)

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        own = {h: c for h, c in counts[k].items() if h[:-1] == g[:-1]}
        total = sum(own.values())
        if not total:
            return p(g[1:])
        c = counts[k].get(g, 0)
        kept = c - discount(k, c) if c else 0
        return kept / total + sum(discount(k, x) for x in own.values()) / total * p(g[1:])

    key, _ = quality.grams(np.frombuffer(b"abba rac", np.uint8), np.array([0, 8]), n)
    want = [p(int(k).to_bytes(n, "big")) for k in key]
    assert 10 ** model.log10(key) == pytest.approx(want, rel=1e-6)


def test_quality_counts_all_trusted(spark):
    """Every trusted text that isn't held out is counted, copies once, however many there are; repeated rows too."""
    docs = spark.createDataFrame([(i, "en", f"text {i // 2}") for i in range(9000)] + [(0, "en", "text 0"), (9000, "en", None)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(9001)], "doc_id long, quality int")
    good = labels.select(F.col("doc_id").alias("id"))
    counted = good.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(quality.FOLDS)) != 0)
    slim = docs.select(F.col("doc_id").alias("id"), "text")
    got = [r["text"] for r in quality._counted_texts(slim, counted).collect()]
    assert sorted(got) == sorted({f"text {r['id'] // 2}" for r in counted.collect() if r["id"] < 9000})
    model, seen = quality.kneser_ney, []
    try:
        quality.kneser_ney = lambda texts, head: seen.append(texts.count()) or model(texts, head)
        quality.classify(docs, labels)
    finally:
        quality.kneser_ney = model
    assert seen == [len(got)]


def test_quality(spark, documents, clashing, empty):
    good = [(i, "the cat sat on the mat and " + " ".join(["dog", "cow", "hen", "pig"][(i + k) % 4] for k in range(20)), "en") for i in range(300)]
    bad = [(1000 + i, "".join(chr(33 + (i * 7 + k * 13) % 90) for k in range(150)), "en") for i in range(20)]
    docs = spark.createDataFrame([*good, *bad, (5000, None, None), (5001, "", "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([*[(i, 1) for i in range(280)], *[(1000 + i, 0) for i in range(10)], (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs, labels).collect()}
    assert all(got[i] for i, _, _ in good) and not any(got[i] for i, _, _ in bad) and len(got) == 322
    assert all(r["keep"] for r in quality.classify(clashing, labels.where("false")).collect())
    assert quality.classify(empty, labels).collect() == []


def test_perplexity_is_the_same_for_any_head(spark, documents, corpus):
    """Count joins give what the head doesn't settle: probabilities still sum to 1, and no n-gram is cut."""
    texts = spark.createDataFrame([(t,) for _, t in corpus[:40]], "text string")
    slim = documents.selectExpr("doc_id id", "coalesce(lang, '') lang", "text")
    found = []
    for head in (1 << 20, 300, 0):
        model = quality.kneser_ney(texts, head)
        assert model.complete == (head > 300)
        found.append({r["id"]: r["perplexity"] for r in quality.perplexities(slim, model).collect()})
    assert len(found[0]) == len(corpus)
    for other in found[1:]:
        assert all(other[i] == pytest.approx(x, rel=1e-9) for i, x in found[0].items())
    keys = [int.from_bytes(b"w12" + bytes([c, x]), "big") for c in (ord("3"), 0) for x in range(256)]
    p = quality._joined(spark.createDataFrame([(k,) for k in keys], "k long"), model).collect()
    assert sum(10 ** r["p"] for r in p) == pytest.approx(2, abs=1e-6)


def test_thresholds_are_brute_force(spark):
    """Over all trusted documents that gave no counts, whatever the sample that is counted."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, int(rng.integers(1, 300))) % 90), ("en", "de", None)[0 if i % 10 < 7 else 1 + i % 2]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(450)], "doc_id long, quality int")
    got = quality.classify(docs, labels, max_trusted=60, quantile=0.9).collect()
    picked = spark.createDataFrame([(i,) for i in range(450) if i % 4], "id long").selectExpr("id", "xxhash64(id) h", "pmod(xxhash64(id, 7), 5) f").orderBy("h").collect()
    counted = {r["id"] for r in picked[:60] if r["f"]}
    size = {i: len(t.encode()) for i, t, _ in rows}
    band = lambda n: (n >= 256) + (n >= 1024)
    held = [(r["lang"], band(r["n_bytes"]), r["perplexity"]) for r in got if r["doc_id"] < 450 and r["doc_id"] % 4 and r["doc_id"] not in counted]
    q = lambda x: sorted(x)[math.ceil(0.9 * len(x)) - 1]
    every = q([x for _, _, x in held])
    assert len({r["threshold"] for r in got}) > 2
    for r in got:
        assert r["n_bytes"] == size[r["doc_id"]]
        of_lang = [x for l, _, x in held if l == r["lang"]]
        wide = q(of_lang) if len(of_lang) >= 40 else every
        own = [x for l, b, x in held if (l, b) == (r["lang"], band(r["n_bytes"]))]
        want = q(own) if len(own) >= 40 else max([wide, *own])
        assert (r["threshold"], r["keep"]) == (want, r["perplexity"] <= want)


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
    none = toxicity.estimate(pa.table({c: pa.array([], pa.int64()) for c in ("level", "key", "n0", "n1", "context", "word")}), np.zeros((2, 6), np.int64))
    assert none.score(pa.array(["a b", None])).tolist() == [0.5, 0.5]
