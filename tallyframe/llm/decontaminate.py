"""Benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised to words of ``[0-9a-z]`` and above ASCII, A-Z lower-cased. A window is WINDOW consecutive words
of a benchmark item, or all words of a shorter one. The windows of all items are one automaton over word codes; a
text is scanned once, as the codes of its words, and each hit is compared word by word and mapped back to byte
offsets of the original text.

Benchmarks are small test sets, but their size is checked: an automaton holds at most ``most_windows`` windows (about
0.7 kB each, in every Python worker), what is collected at a time is that much text, and an item's words are kept
once, windows being places in them. Each further automaton is one more pass over the rows, which are written between
passes, so that a task holds one automaton at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import textbytes as tb
from tallyframe.llm.spark import read, written

WINDOW = 10
MOST_WINDOWS = 1 << 18

_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = "n_words long, n_hit long, spans array<struct<first: int, last: int, start: bigint, end: bigint>>, items array<string>"


@dataclass
class Patterns:
    """Runs of item words, whose windows are the automaton's: as codes, and as words with one space between them."""

    keys: np.ndarray  # hashes of words, sorted
    codes: np.ndarray  # their codes
    items: list[str]
    runs: list[np.ndarray]  # codes of each run's words
    spelled: list[bytes]
    window: int
    compiled: tuple | None = None

    def __getstate__(self):
        return self.keys, self.codes, self.items, self.runs, self.spelled, self.window

    def __setstate__(self, state):
        self.keys, self.codes, self.items, self.runs, self.spelled, self.window = state
        self.compiled = None

    def automaton(self) -> tuple[ahocorasick.Automaton, list[int], dict[int, set[int]], list[np.ndarray]]:
        """Windows with their numbers; the first number of each run; the other runs that have a window; where words begin."""
        if self.compiled is None:
            automaton, first, others, n = ahocorasick.Automaton(), [], {}, 0
            for r, run in enumerate(self.runs):
                first.append(n)
                text = run.astype("<u4").tobytes().decode("utf-32-le")
                for i in range(max(1, len(text) - self.window + 1)):
                    s = text[i : i + self.window]
                    k = automaton.get(s, None)
                    if k is None:
                        automaton.add_word(s, n + i)
                    elif bisect_right(first, k) - 1 != r:
                        others.setdefault(k, set()).add(r)
                n += max(1, len(text) - self.window + 1)
            automaton.make_automaton()
            begins = [np.concatenate(([0], np.flatnonzero(np.frombuffer(x, np.uint8) == 0x20) + 1, [len(x) + 1])) for x in self.spelled]
            self.compiled = automaton, first, others, begins
        return self.compiled

    def find(self, w: tb.Words) -> tuple[np.ndarray, list[set[str]]]:
        """Which words of the chunk are hit, and the items found in each text."""
        n = len(w.first) - 1
        edge, items = np.zeros(len(w.start) + 1, np.int64), [set() for _ in range(n)]
        if not self.runs or not len(w.start):
            return np.zeros(len(w.start), bool), items
        h = w.hashes()
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        known = self.keys[at] == h
        text = np.where(known, self.codes[at], 1).astype("<u4").tobytes().decode("utf-32-le")
        automaton, begin, others, begins = self.automaton()
        counts = np.concatenate(([0], np.cumsum(known)))
        for d in np.flatnonzero(counts[w.first[1:]] > counts[w.first[:-1]]).tolist():
            base = int(w.first[d])
            for e, k in automaton.iter(text[base : int(w.first[d + 1])]):
                r = bisect_right(begin, k) - 1
                at_word, size = k - begin[r], min(self.window, len(self.runs[r]))
                last = base + e + 1
                first = last - size
                spelled = self.spelled[r][begins[r][at_word] : begins[r][at_word + size] - 1]
                if b" ".join(w.data[a:b].tobytes() for a, b in zip(w.start[first:last].tolist(), w.end[first:last].tolist(), strict=True)) == spelled:
                    edge[first] += 1
                    edge[last] -= 1
                    items[d].add(self.items[r])
                    items[d].update(self.items[x] for x in others.get(k, ()))
        return np.cumsum(edge[:-1]) > 0, items


def patterns(items: list[tuple[object, str | None]], window: int = WINDOW, most: int = MOST_WINDOWS) -> Iterator[Patterns]:
    """Patterns of at most ``most`` windows each; an item with more is cut into runs that overlap by window - 1 words."""
    codes: dict[bytes, int] = {}
    hashes: dict[int, int] = {}
    names: list[str] = []
    runs: list[np.ndarray] = []
    texts: list[bytes] = []
    held = 0

    def done() -> Patterns:
        keys = np.array(sorted(hashes), np.uint64)
        return Patterns(keys, np.array([hashes[k] for k in sorted(hashes)], np.uint32), names, runs, texts, window)

    for item, text in items:
        w = tb.words(*tb.raw(pa.array([text], pa.string())), tb.FOLDED, fold=True)
        spelled = [w.data[a:b].tobytes() for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
        hashed = w.hashes().tolist()
        i = 0
        while i < max(1, len(spelled) - window + 1) and spelled:
            n = min(most - held, max(1, len(spelled) - window + 1) - i)
            if not n:
                yield done()
                codes, hashes, names, runs, texts, held = {}, {}, [], [], [], 0
                continue
            own = slice(i, i + n + window - 1)
            for x, h in zip(spelled[own], hashed[own], strict=True):
                k = codes.setdefault(x, len(codes) + 2)
                hashes[h] = k if k < 0xD800 else k + 0x800
            names.append(str(item))
            runs.append(np.array([hashes[h] for h in hashed[own]], np.uint32))
            texts.append(b" ".join(spelled[own]))
            held, i = held + n, i + n
    yield done()


def compile_benchmark(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> Iterator[Patterns]:
    """The automata's patterns, one at a time. Items without id or text, or without words, have no windows.

    Items of one id count as one item in results. Items are collected in parts of about ``most_windows`` words.
    """
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    n = 1 + words // most_windows
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield from patterns([(r["id"], r["text"]) for r in part.collect()], window, most_windows)


def find(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_words, n_hit, spans, items) of every row: spans are runs of hit words, as words and as bytes of the text.

    A null text has no words. Repeated rows are scanned each; other columns aren't looked at. With an empty
    benchmark nothing is hit; an empty table gives an empty result.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    out = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shape = f"id {kind}, text string, {_FOUND}"
    for k, one in enumerate(compile_benchmark(benchmark, **options)):
        shared = documents.sparkSession.sparkContext.broadcast(one)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, more=k > 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, data, at in tb.chunks(batch.column(1)):
                    w = tb.words(data, at, tb.FOLDED, fold=True)
                    hit, items = shared.value.find(w)
                    if more:
                        for d in range(j - i):
                            for s in batch.column(4)[i + d].as_py():
                                hit[w.first[d] + s["first"] : w.first[d] + s["last"]] = True
                            items[d].update(batch.column(5)[i + d].as_py())
                    spans, n_hit = [], []
                    for d in range(j - i):
                        own = hit[w.first[d] : w.first[d + 1]]
                        n_hit.append(int(own.sum()))
                        turns = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])))).reshape(-1, 2) if n_hit[-1] else np.empty((0, 2), int)
                        base, zero = int(w.first[d]), int(at[d])
                        spans.append([{"first": a, "last": b, "start": int(w.start[base + a]) - zero, "end": int(w.end[base + b - 1]) - zero} for a, b in turns.tolist()])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(w.counts), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], ["id", "text", "n_words", "n_hit", "spans", "items"])

        out = (written(out, "scanned") if k else out).mapInArrow(scan, shape)
    return out.drop("text").withColumnRenamed("id", id_col)


def keep_clean(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of documents, all columns as they are, in whose text no window of the benchmark occurs.

    Null and empty texts stay, as does everything with an empty benchmark; repeated rows stay or go together. Other
    columns may have any names. An empty table gives an empty result.
    """
    at = documents.columns.index(text_col)
    out = documents
    for k, one in enumerate(compile_benchmark(benchmark, **options)):
        shared = documents.sparkSession.sparkContext.broadcast(one)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not x for _, _, data, begins in tb.chunks(batch.column(at)) for x in shared.value.find(tb.words(data, begins, tb.FOLDED, fold=True))[1]]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = (written(out, "scanned") if k else out).mapInArrow(keep, documents.schema)
    return out


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), hits AS (
  SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, s)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.list, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
