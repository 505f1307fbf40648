"""Substring dedup, WARC, chat formatting, SentencePiece, FLAC, language model, pipeline."""

import collections
import gzip
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import chat_format, flac, maxent_lm, substring_dedup, warc
from tallyframe.llm import sentencepiece_bpe as sp
from tallyframe.llm import textbytes as tb

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Substring dedup


def cut(rows, size=13):
    """Words and which of them go, by brute force."""
    first = {}
    words = {i: SPACED.findall(t or "") for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out[i] = w, gone
    return out


def test_repeats_are_brute_force(documents, clashing, corpus, monkeypatch):
    want = {i: (len(w), sum(g), sha(" ".join(x for x, y in zip(w, g, strict=True) if not y))) for i, (w, g) in cut(corpus).items()}
    assert sum(n for _, n, _ in want.values()) > 0
    for df in (documents, clashing):
        assert {r[0]: tuple(r)[1:] for r in substring_dedup.report(df).collect()} == want
    out = substring_dedup.remove_repeats(clashing)
    assert out.columns == clashing.columns
    texts = dict(corpus)
    for r in out.collect():
        _, gone, digest = want[r["doc_id"]]
        if not gone:
            assert r["text"] == texts[r["doc_id"]]
        else:
            assert sha(" ".join(SPACED.findall(r["text"]))) == digest


def test_hot_anchors_are_dealt_by_window(spark, documents, corpus, monkeypatch):
    """A phrase in many texts that differ around it: its pieces go by window, with the same result."""
    monkeypatch.setattr(substring_dedup, "HOT_PIECES", 3)
    rows = [(i, f"{' '.join(f'a{i % 7}x{k}' for k in range(6))} one common phrase of six words {' '.join(f'b{i % 5}y{k}' for k in range(9))} " * (1 + i % 3)) for i in range(60)]
    for table, texts in ((documents, corpus), (spark.createDataFrame(rows, "doc_id long, text string"), rows)):
        want = {i: (len(w), sum(g), sha(" ".join(x for x, y in zip(w, g, strict=True) if not y))) for i, (w, g) in cut(texts).items()}
        assert {r[0]: tuple(r)[1:] for r in substring_dedup.report(table).collect()} == want


def test_sql_of_repeats(spark, tmp_path, corpus):
    """The operator's rows are those of its SQL."""
    import duckdb

    spark.createDataFrame(corpus, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = substring_dedup.op7_substring_dedup(spark, str(tmp_path)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(substring_dedup.OP7_SQL).fetchall())


def test_repeats_edges(spark, empty):
    assert substring_dedup.report(empty).collect() == []
    long = " ".join(map(str, range(40)))
    rows = spark.createDataFrame([(None, long), (None, None), (-1, long), (5, long), (5, long), (7, "0 1 2"), (8, "0 1 2"), (9, "x " * 30), (10, "x " * 30)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup.report(rows).collect())
    assert got == sorted([("None", 40, 0), ("None", 0, 0), ("-1", 40, 0), ("5", 40, 40), ("5", 40, 40), ("7", 3, 0), ("8", 3, 0), ("9", 30, 0), ("10", 30, 30)])


# WARC


@pytest.fixture(scope="module")
def pages(spark):
    big = "<html>" + "ä" * 200 + "</html>"
    rows = [(5, "http://a/%41\r\nX: y", big), (3, None, big), (9, "u", big), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "WARC/1.1\r\n\r\n" * 30), (8, "u", "x" * 300_000), (5, "again", big)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives(spark, pages, tmp_path):
    path = f"file://{tmp_path}/w"
    index = warc.write_archives(pages.withColumn("digest", F.lit("clash")).withColumn("payload", F.lit(1)), path)
    assert index.count() == pages.count()
    got = warc.read_records(index, path).collect()
    assert all(r["intact"] for r in got)
    want = []
    for page, url, html in pages.collect():
        data = (html or "").encode()
        again = len(data) >= 100 and page is not None and html.startswith("<html>") and page != 3
        want.append((page, url, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None, None if again else data))
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]))) for r in got)
    some = warc.read_records(index.where("page_id in (8, 1)"), path).collect()
    assert sorted(r["page_id"] for r in some) == [1, 8]
    names = [f for f in os.listdir(tmp_path / "w") if f.endswith(".warc.gz")]
    assert sum(gzip.open(tmp_path / "w" / f).read().count(b"WARC-Type: ") for f in names) == pages.count()


def test_archives_of_repeated_ids(spark, tmp_path):
    """A record for each row; rows of one id go by their own payloads, and none is lost."""
    x = {k: k * 120 for k in "ABC"}
    rows = [(1, "A"), (2, "B"), (5, "A"), (5, "B"), (6, "A"), (6, "C"), (6, "C")]
    path = f"file://{tmp_path}/w"
    index = warc.write_archives(spark.createDataFrame([(i, "u", x[k]) for i, k in rows], "page_id long, url string, html string"), path)
    of = {sha(v): k for k, v in x.items()}
    got = sorted(str((r["page_id"], of[r["payload_digest"]], r["payload"] is not None, r["record_type"], r["refers_to"])) for r in warc.read_records(index, path).collect())
    want = [(1, "A", None), (2, "B", None), (5, "A", 1), (5, "B", 2), (6, "A", 1), (6, "C", None), (6, "C", None)]
    assert got == sorted(str((i, k, to is None, "response" if to is None else "revisit", to)) for i, k, to in want)


def test_archive_of_nothing(spark, pages, tmp_path):
    path = f"file://{tmp_path}/w"
    assert warc.read_records(warc.write_archives(pages.where("false"), path), path).collect() == []


# Chat formatting


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "<|turn|>", "<s", "", None, "</s>" * 3, "a\nb", "<<SYS>>x<</SYS>>", "[/INST\\]", "<", "\U0001d11e</s>"]
    rows = [(1, k, ("user", "assistant", "assistant", None)[k % 4], t) for k, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", "only"), (3, None, "user", "x"), (3, 0, "u</s>[INST]\\", "y"), (3, 0, "u</s>[INST]\\", "y"), (None, 0, "user", "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit("clash")).withColumn("mask", F.lit(0))
    done = chat_format.format_conversations(turns).select("conv_id", "formatted", "mask", chat_format.read_back(turns).alias("turns"), chat_format.masked_text().alias("loss")).collect()
    assert {r["conv_id"] for r in done} == {1, 2, 3, None}
    for r in done:
        own = sorted([x for x in rows if x[0] == r["conv_id"]], key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r["formatted"].count("[INST]") == r["formatted"].count("[/INST]") == r["formatted"].count("</s>")


def test_chat_of_nothing(spark):
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


# SentencePiece


@pytest.fixture(scope="module")
def model():
    return sp.load(sp.model_path())


def encoded(model, texts, **options):
    ids, at = sp.encode(model, *tb.raw(pa.array(texts, pa.string())), np.arange(len(texts), dtype=np.uint64), **options)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)], sp.decode(model, ids, at)


def test_without_dropout_it_is_the_library(model, corpus):
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=sp.model_path())
    texts = [t[:3000] for _, t in corpus if t and "▁" not in t]
    got, back = encoded(model, texts, dropout=0.0, seed=1, variants=4)
    assert got == [reference.encode(t) for t in texts]
    assert [b.decode() for b in back] == texts


def test_dropout_is_lossless_varied_and_seeded(model, corpus):
    texts = [t or "" for _, t in corpus]
    a, back = encoded(model, texts, dropout=0.2, seed=1, variants=4)
    assert [b.decode() for b in back] == texts
    assert a == encoded(model, texts, dropout=0.2, seed=1, variants=4)[0]
    assert a != encoded(model, texts, dropout=0.2, seed=2, variants=4)[0]
    whole = encoded(model, texts, dropout=0.0, seed=1, variants=4)[0]
    assert sum(map(len, a)) > sum(map(len, whole))
    repeated = encoded(model, ["international " * 200], dropout=0.3, seed=1, variants=4)[0][0]
    assert len({tuple(x.split()) for x in " ".join(map(str, repeated)).split(str(repeated[-1]))}) > 1
    every = encoded(model, ["ab cd"], dropout=1.0, seed=1, variants=4)[0][0]
    assert len(every) == 6


def test_rounds_are_the_heap(model):
    limit = np.uint64(int(0.3 * 2.0**64))
    for k, w in enumerate(["internationalization", "Donaudampfschiff", "éèêaux", "aaaaaaaaaaaa", "x1234567890", "\t\t日本語"]):
        cps = np.array([ord(c) for c in " " + w], np.uint32)
        key = np.array([k * 7919], np.uint64)
        ids = np.full((1, 48), sp.NONE, np.int32)
        ids[0, : len(cps)] = model.of_char[cps]
        alive = sp._merge_rounds(model, ids, np.array([len(cps)]), key, limit)
        assert ids[alive].tolist() == sp._merge_heap(model, model.of_char[cps], key[0], limit)[0].tolist()


def test_each_place_has_a_draw_of_its_own(spark, model):
    """A frequent word varies beyond a few variants, and sharing segmentations changes nothing."""
    word, times = "international", 400
    rows = spark.createDataFrame([(1, " ".join([word] * times))], "doc_id long, text string")
    ids = sp.tokenize(rows, sp.model_path()).first()["token_ids"]
    pieces = sp.decode(model, np.array([0, *ids]), np.array([0, len(ids) + 1]))[0].decode()
    assert pieces.endswith(word)
    units, seen = [], 0
    for i in ids:
        if seen % (len(word) + 1) == 0:
            units.append([])
        units[-1].append(i)
        seen += int(model.spelled_at[i + 1] - model.spelled_at[i])
    assert len(units) == times
    assert len({tuple(u) for u in units}) > 8
    # The same keys, each unit segmented alone.
    cps = np.array([ord(c) for c in f" {word} the a" + " x" * 30], np.uint32)
    unit = np.flatnonzero(cps == 0x20)
    size = np.diff(np.append(unit, len(cps)))
    unit, size = np.tile(unit, 50), np.tile(size, 50)
    key = tb.mix(np.arange(len(unit), dtype=np.uint64))
    spelled = tb.mix(np.array([hash(tuple(cps[u : u + n])) % 2**63 for u, n in zip(unit, size, strict=True)], np.uint64))
    limit = np.uint64(int(0.1 * 2.0**64))
    tokens, counts, which = sp._segment_each(model, cps, unit, size, spelled, key, limit)
    alone, each = sp._segment(model, cps, unit, size, key, limit)
    a, b = np.split(tokens, np.cumsum(counts)[:-1]), np.split(alone, np.cumsum(each)[:-1])
    assert [a[w].tolist() for w in which] == [x.tolist() for x in b]


def test_token_columns(documents, clashing, empty):
    a = {r["doc_id"]: r["token_ids"] for r in sp.tokenize(documents.repartition(2), sp.model_path()).collect()}
    out = sp.detokenize(sp.tokenize(clashing.withColumn("token_ids", F.lit(1)), sp.model_path()), sp.model_path())
    rows = out.collect()
    assert {r["doc_id"]: r["token_ids"] for r in rows} == a
    assert all(r["decoded"] == (r["text"] or "") and len(r["token_ids"]) == r["n_tokens"] for r in rows)
    assert sp.tokenize(empty, sp.model_path()).collect() == []


# FLAC


@pytest.mark.parametrize("linear", [False, True])
def test_flac_is_lossless(linear):
    rng = np.random.default_rng(1)
    tone = flac.TO_BYTE[np.rint(60 * np.sin(np.arange(1920) / 9)).astype(np.int8).view(np.uint8)].tobytes()
    payloads = [flac.padded(x) for x in (b"", b"a" * 1000, rng.bytes(5000), bytes(range(256)) * 30, "Ünï".encode() * 500, tone, b"the cat " * 9000)]
    streams = flac.encode(payloads, linear)
    assert [flac.TO_BYTE[x.view(np.uint8)].tobytes() for x in flac.decode(streams)] == payloads
    assert all(len(s) < len(p) * 1.1 + 200 for s, p in zip(streams, payloads, strict=True))
    at, samples, _, name, points = flac._metadata(streams[-1])
    assert (samples, name) == (len(payloads[-1]), flac.MAP)
    for sample, offset, size in points.tolist():
        assert streams[-1][at + offset : at + offset + 2] == b"\xff\xf8" and size == flac.BLOCK and sample % (flac.BLOCK * flac.SEEK) == 0
    if linear:
        assert b"".join(streams[5:6]) != flac.encode(payloads[5:6])[0]


def test_flac_is_sought(monkeypatch):
    """Any run of samples is decoded from the seek points around it; long streams are coded in runs of frames."""
    rng = np.random.default_rng(7)
    payload = flac.padded(b"".join([b"some words of a text " * 2000, rng.bytes(30_000), b"x" * 20_000]))
    stream = flac.encode([payload], True)[0]
    monkeypatch.setattr(flac, "RUN", 7)
    assert flac.encode([payload], True)[0] == stream
    whole = flac.decode([stream])[0]
    assert flac.TO_BYTE[whole.view(np.uint8)].tobytes() == payload
    for first, count in ((0, 1), (0, len(whole)), (12_288, 5), (12_287, 2), (len(whole) - 3, 100), (40_000, 30_000), (len(whole), 4), (5, 0)):
        assert (flac.read_samples(stream, first, count) == whole[first : first + count]).all()
        assert len(flac.read_samples(stream, first, count)) == len(whole[first : first + count])


def test_flac_fixed_orders():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (5, flac.BLOCK))
    for order in range(1, 5):
        r = np.concatenate([x[:, :order], np.diff(x, n=order, axis=1)], 1)
        assert (flac._integrate(r, order) == x).all()


def test_flac_damage_is_found():
    stream = bytearray(flac.encode([flac.padded(b"some text " * 200)])[0])
    for at in (len(stream) - 50, len(stream) // 2, 30):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_flac_false_sync():
    """A payload whose verbatim bytes look like a frame's header."""
    block = bytes(flac.TO_BYTE[b] for b in (0xFF, 0xF8, 0x10, 0x02, 1)) + bytes([flac.TO_BYTE[int(flac._crc(np.array([0xFF, 0xF8, 0x10, 0x02, 1], np.uint8), np.array([0]), np.array([5]), flac.CRC8)[0])]])
    payload = flac.padded(np.random.default_rng(3).bytes(90) + block + np.random.default_rng(4).bytes(400))
    assert flac.TO_BYTE[flac.decode(flac.encode([payload]))[0].view(np.uint8)].tobytes() == payload


def test_media_column(spark, documents, clashing, empty, corpus, tmp_path):
    media = flac.store(clashing, f"file://{tmp_path}/m")
    got = {r["doc_id"]: r for r in flac.features(media).collect()}
    for i, t in corpus:
        p = flac.padded((t or "").encode())
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    for i, t in corpus:
        x = flac.TO_SAMPLE[np.frombuffer(flac.padded((t or "").encode()), np.uint8)].astype(int)
        loud = [int((x[o : o + flac.PCM_SAMPLES] ** 2).sum()) for o in range(0, len(x), flac.PCM_SAMPLES)]
        want = f"peak={abs(x).max()};energy={(x * x).sum()};crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))};loudest={loud.index(max(loud)) * flac.PCM_SAMPLES}"
        r = got[i]
        assert (r["media_bytes"], r["media_sha256"], r["feature"], r["pcm_blocks"]) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest(), want, len(loud))
    none = spark.createDataFrame([(1, 5, None)], "doc_id long, n_bytes long, media binary")
    assert [r["payload_bytes"] for r in flac.features(none).collect()] == [None] and flac.pcm_blocks(none).collect() == []
    blocks = flac.pcm_blocks(media, block_samples=1000).toPandas().sort_values(["doc_id", "sample_offset"])
    for i, own in blocks.groupby("doc_id"):
        assert own.sample_offset.tolist() == [1000 * k for k in range(len(own))]
        pcm = np.frombuffer(b"".join(map(bytes, own.pcm)), np.uint8)
        assert hashlib.sha256(flac.TO_BYTE[pcm].tobytes()).hexdigest() == got[i]["payload_sha256"]
    assert flac.features(flac.store(empty, f"file://{tmp_path}/e")).collect() == []


# Language model


@pytest.mark.parametrize("head_words", [1 << 19, 50])
def test_base_scores_are_brute_force(documents, clashing, corpus, head_words):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*SPACED.findall((t or "").translate(table)), None] for i, t in corpus}
    c = collections.Counter(x for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for x in w)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in maxent_lm.score(clashing, head_words=head_words).collect()}
    assert len(got) == len(corpus)
    for i, w in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0


def test_model_learns_and_sums_to_one(spark):
    rows = spark.createDataFrame([(i, " ".join(f"{'ab'[i % 2]}{(k * 7 + i) % 40}" for k in range(120))) for i in range(400)], "doc_id long, text string")
    got = maxent_lm.score(rows).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() + 0.05 * held.n_tokens.sum()
    assert got.score.tolist() != maxent_lm.score(rows, buckets=4096).toPandas().score.tolist()
    w = maxent_lm.Weights(np.random.default_rng(1).normal(size=maxent_lm.size_of(2048)).astype(np.float32))
    assert w.buckets == 2048
    t = maxent_lm.tokens_of(*tb.raw(pa.array(["a b c"])))
    total = sum(g[:, k] * m.sum(1) for k in range(maxent_lm.GROUPS) for _, *f in maxent_lm._slices(t, np.full(4, k), 2048) for g, m in [maxent_lm._softmaxes(w, *f)])
    assert total == pytest.approx(np.ones(4), abs=1e-5)


def test_buckets_grow_with_the_words():
    sizes = [maxent_lm.buckets_for(10**k) for k in range(12)]
    assert sizes == sorted(sizes) and sizes[0] == maxent_lm.LEAST_BUCKETS
    assert all(maxent_lm.buckets_for(100 * 10**k) >= 8 * maxent_lm.buckets_for(10**k) for k in range(6, 10))


def test_a_step_is_the_dense_one():
    rng = np.random.default_rng(3)
    table, squares = rng.normal(size=(50, 4)).astype(np.float32), np.full((50, 4), 1e-8, np.float32)
    rows, errors = [rng.integers(0, 50, 30), rng.integers(0, 9, 30)], rng.normal(size=(30, 4))
    gradient = np.zeros((50, 4))
    for r in rows:
        np.add.at(gradient, r, errors / 30)
    want = table - maxent_lm.RATE * gradient / np.sqrt(1e-8 + gradient**2)
    maxent_lm._step(table, squares, rows, errors)
    assert table == pytest.approx(want, abs=1e-4)


def test_long_texts_go_by_pieces(model):
    long = "".join(f"wort{i % 977}  naïve\n{'x' * (i % 7)} " for i in range(100_000))
    raw, at = tb.raw(pa.array([long]))
    assert len(raw) > 2 * tb.CHUNK_BYTES
    cut = list(tb.pieces(raw, tb.PLAIN))
    assert len(cut) > 2 and [b for _, b in cut[:-1]] == [a for a, _ in cut[1:]] and (cut[0][0], cut[-1][1]) == (0, len(raw))
    a, b = maxent_lm.tokens_of(raw, at), maxent_lm._tokens(raw, at)
    assert (a.hash == b.hash).all() and (a.share == b.share).all() and (a.first == b.first).all()
    owner = np.array([5], np.uint64)
    ids, edge = sp.encode(model, raw, at, owner, dropout=0.1, seed=1)
    whole, edges, _ = sp._encode(model, raw, at, owner, 0.1, 1, None, b" ", 0)
    assert (ids == whole).all() and (edge == edges).all()
    assert sp.decode(model, ids, edge) == [raw.tobytes()]
    solid, at = tb.raw(pa.array(["y" * (3 * tb.CHUNK_BYTES)]))
    assert list(tb.pieces(solid, tb.PLAIN)) == [(0, len(solid))]


def test_language_model_edges(spark, empty):
    assert maxent_lm.score(empty).collect() == []
    rows = spark.createDataFrame([(None, "a b"), (None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    got = maxent_lm.score(rows).collect()
    assert len(got) == 4 and {r["n_tokens"] for r in got if r["doc_id"] == 1} == {2}


# Pipeline


def test_pipeline(spark, documents, corpus, tmp_path):
    d = f"file://{tmp_path}"
    documents.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in corpus], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    leaked = next(t for i, t in sorted(corpus) if t and 20 < len(t.split()) < 80)
    spark.createDataFrame([(1, leaked)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    from tests_brute import pipeline_rows

    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    want = pipeline_rows(corpus, leaked)
    assert {i: None if r["text"] is None else SPACED.findall(r["text"]) for i, r in out.items()} == want
    back = sp.detokenize(spark.createDataFrame([(i, r["token_ids"]) for i, r in out.items()], "doc_id long, token_ids array<int>"), sp.model_path())
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {i: r["text"] or "" for i, r in out.items()}
