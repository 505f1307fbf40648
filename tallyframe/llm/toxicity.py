"""Toxicity from two class-conditional Kneser-Ney models with shared backoff.

Each class, toxic and ordinary, has an interpolated modified Kneser-Ney model of a word given the one before it. It
backs off to the class's estimate of the word alone, that to the class's estimate of the word's first five bytes with
a shared one of how words go on after them, and that to counts which both classes share. Counts are in how many
texts of the class a word or beginning occurs, and after how many different words a pair does, so that a passage which
many texts copy counts once. How far an estimate leaves its backoff is how probable it is that the
classes differ there, given the counts: rare expressions have what the shared backoff says, and no count of one class
alone is without effect. What that moves is normalised away at each level, so every distribution sums to 1 over the
known words, an unknown word of each known beginning, and a word of an unknown beginning. Word pairs with a count under
MIN_PAIR aren't kept, as is usual for the highest order; their mass is their context's backoff.

A text is its distinct word pairs. The score is a logistic function of the mean log-likelihood ratio by pair, fitted
on labelled rows that gave no counts.

Fitting reads at most ``max_per_class`` labelled documents of each class (those with the smallest hash of their
id), so the model is bounded: it is the one thing here that is collected and broadcast. Scoring is one pass over
the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import textbytes as tb
from tallyframe.llm.spark import crc32_of_id, read, written

STEM, WORD, PAIR, CONTEXT = 0, 1, 2, 3
STEM_BYTES = 5
MIN_PAIR = 2
RARE = 16
FOLDS = 5


@dataclass
class Pairs:
    """The distinct word pairs of the texts of a chunk: keys of the word before (0 at the beginning), the word, its stem and the pair."""

    text: np.ndarray
    left: np.ndarray  # the word before the pair
    before: np.ndarray
    word: np.ndarray
    stem: np.ndarray
    pair: np.ndarray

    @classmethod
    def of(cls, w: tb.Words, by_left: bool = False) -> Pairs:
        """by_left: distinct with the word before the pair."""
        h, text = w.hashes(), w.text_of()
        begins = w.first[:-1][w.counts > 0]
        before = np.zeros_like(h)
        before[1:] = h[:-1]
        before[begins] = 0
        left = np.zeros_like(h)
        left[1:] = before[:-1]
        left[begins] = 0
        pair = tb.mix(before * np.uint64(0x9E3779B97F4A7C15) + h)
        key = tb.mix(left * np.uint64(0xD1342543DE82EF95) + pair) if by_left else pair
        one = _first_of_each(key, text)
        return cls(text[one], left[one], before[one], h[one], w.hashes(most=STEM_BYTES)[one], pair[one])


def _first_of_each(key: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places of one entry for each distinct (of, key), in that order."""
    order = np.lexsort((key, of))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (of[order][1:] != of[order][:-1])
    return order[new]


@dataclass
class Table:
    """Sorted keys with a value of each class."""

    keys: np.ndarray
    p: np.ndarray  # (2, n)

    def find(self, k: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(k), -1)
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, at, -1)


def _odds(n: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Log odds that keys with counts n (2, k) aren't split over the classes in the ratio of ``expected``, before any prior.

    Against that ratio stands any other, with Jeffreys' density.
    """
    most = int(n.sum(0).max(initial=0)) + 1
    half = np.cumsum(np.log(np.concatenate(([1.0], np.arange(most) + 0.5))))  # log gamma(k + 1/2) / gamma(1/2)
    whole = np.cumsum(np.log(np.concatenate(([1.0], np.arange(most) + 1.0))))  # log k!
    share = np.log(expected) - np.log(expected.sum(0))
    return half[n[0]] + half[n[1]] - whole[n.sum(0)] - (n * share).sum(0)


def _differs(n: np.ndarray, expected: np.ndarray, sizes: np.ndarray, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """The probability of that for each key. The prior is the share of keys that aren't split as ``sizes`` are, by
    expectation and maximisation over all keys, each counted ``weight`` times."""
    odds, prior, weight = _odds(n, sizes), 0.1, np.broadcast_to(weight, n.shape[1])
    given = lambda odds: 1 / (1 + np.exp(-np.clip(odds + np.log(prior) - np.log1p(-prior), -500, 500)))
    for _ in range(100):
        prior, old = float((1 + (weight * given(odds)).sum()) / (2 + weight.sum())), prior
        if abs(prior - old) < 1e-3 * old:
            break
    return given(_odds(n, expected))


def _discounts(times: np.ndarray) -> np.ndarray:
    """For counts 0, 1, 2 and more. times: how many keys have the count 0, 1, 2, 3, 4."""
    n = np.maximum(times[1:5], 1)
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0] + [float(np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0.05, k - 0.05)) for k in (1, 2, 3)])


def _refined(n: np.ndarray, totals: np.ndarray, discounts: np.ndarray, handed: np.ndarray, low: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Both classes' values (2, k), before normalisation: from the lower level's towards the class's own estimate.

    totals and handed: of each key's context, or of all. A class without counts there has the lower level's. The prior
    of keys with a context (given with ``weight``) is about the lower level's split, else about that of the totals.
    """
    taken = np.stack([discounts[c][np.minimum(n[c], 3)] for c in (0, 1)])
    own = np.where(totals > 0, (n - taken) / np.maximum(totals, 1) + handed * low, low)
    sizes = np.maximum(totals, 0.5)
    r = _differs(n, sizes * low, sizes) if weight is None else _differs(n, sizes * low, sizes * low, weight)
    return low + r * (own - low)


def _handed(n: np.ndarray, discounts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """By class, the share of the discounts, which the lower level gets."""
    taken = np.array([discounts[c][np.minimum(n[c], 3)].sum() for c in (0, 1)])
    return np.where(totals > 0, taken / np.maximum(totals, 1), 1.0)


def _times(n: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(np.minimum(n[c], 5), minlength=6) for c in (0, 1)])


@dataclass
class ToxicityModel:
    """A bounded model; ``score`` gives probabilities for the texts of an Arrow array."""

    word: Table
    stem: Table  # of an unknown word that begins so
    other: np.ndarray  # (2,): of a word with an unknown beginning
    pair: Table
    context: Table  # what a context's backoff is multiplied with
    slope: float = 1.0
    bias: float = 0.0

    def backoff(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """Both classes' probabilities (2, n) of words alone."""
        at = self.stem.find(stem)
        p = np.where(at >= 0, self.stem.p[:, at] if len(self.stem.keys) else 0.0, self.other[:, None])
        at = self.word.find(word)
        return np.where(at >= 0, self.word.p[:, at] if len(self.word.keys) else 0.0, p)

    def probabilities(self, x: Pairs) -> np.ndarray:
        """Both classes' probabilities (2, n) of the pairs' words after those before them."""
        p = self.backoff(x.word, x.stem)
        if len(self.pair.keys):
            at = self.context.find(x.before)
            p = p * np.where(at >= 0, self.context.p[:, at], 1.0)
            at = self.pair.find(x.pair)
            p = np.where(at >= 0, self.pair.p[:, at], p)
        return p

    def ratio(self, w: tb.Words) -> np.ndarray:
        """Mean log-likelihood ratio of toxic to ordinary by distinct pair of a text; 0 without words."""
        size = len(w.first) - 1
        if not len(w.start):
            return np.zeros(size)
        x = Pairs.of(w)
        p = self.probabilities(x)
        return np.bincount(x.text, np.log(p[1]) - np.log(p[0]), size) / np.maximum(np.bincount(x.text, minlength=size), 1)

    def score(self, texts: pa.Array) -> np.ndarray:
        parts = [self.ratio(tb.words(data, at, tb.FOLDED, fold=True)) for _, _, data, at in tb.chunks(texts)]
        x = np.concatenate(parts) if parts else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.bias, -500, 500)))


def _of_level(counted: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, counts (2, n), and the keys of the context and the word."""
    own = np.flatnonzero(counted["level"].to_numpy() == level)
    column = lambda name: counted[name].to_numpy()[own].astype(np.int64)
    key, context, word = (column(c).view(np.uint64) for c in ("key", "context", "word"))
    order = np.argsort(key)
    return key[order], np.stack([column("n0")[order], column("n1")[order]]), context[order], word[order]


def estimate(counted: pa.Table, pair_times: np.ndarray) -> ToxicityModel:
    """counted: (level, key, n0, n1, context, word), with pairs from MIN_PAIR on and one in RARE of the others, which
    only count for the prior. pair_times: as _discounts takes it, by class, of all pairs.
    """
    # Beginnings, from counts that both classes share.
    stem, n, _, _ = _of_level(counted, STEM)
    totals, d = n.sum(1), [_discounts(t) for t in _times(n)]
    whole = n.sum() + 0.5 * (len(stem) + 1)
    low = np.repeat(((n.sum(0) + 0.5) / whole)[None], 2, 0)
    q = _refined(n, totals[:, None], d, _handed(n, d, totals)[:, None], low)
    mass = 1 + (q - low).sum(1)
    p_stem, other = q / mass[:, None], 0.5 / whole / mass
    # Words, after their beginnings.
    word, n, of, _ = _of_level(counted, WORD)
    totals, d = n.sum(1), [_discounts(t) for t in _times(n)]
    at = np.searchsorted(stem, of)
    spelled = np.bincount(at, n.sum(0) + 0.5, len(stem)) + 0.5
    low = p_stem[:, at] * ((n.sum(0) + 0.5) / spelled[at])
    q = _refined(n, totals[:, None], d, _handed(n, d, totals)[:, None], low)
    mass = 1 + (q - low).sum(1)
    model = ToxicityModel(Table(word, q / mass[:, None]), Table(stem, p_stem * (0.5 / spelled) / mass[:, None]), other / mass, Table(stem[:0], other[:, None][:, :0]), Table(stem[:0], other[:, None][:, :0]))
    # Words after the word before.
    pair, n, before, after = _of_level(counted, PAIR)
    if not len(pair):
        return model
    context, total, _, _ = _of_level(counted, CONTEXT)
    at = np.searchsorted(context, before)
    d = [_discounts(t) for t in pair_times]
    low = model.word.p[:, np.searchsorted(word, after)]
    kept = n.sum(0) >= MIN_PAIR
    held = np.stack([np.bincount(at, kept * (n[c] - d[c][np.minimum(n[c], 3)]), len(context)) for c in (0, 1)])
    handed = 1 - held / np.maximum(total, 1)  # all that isn't held by a kept pair
    q = _refined(n, total[:, at], d, handed[:, at], low, np.where(kept, 1.0, RARE))
    pair, at, q, low = pair[kept], at[kept], q[:, kept], low[:, kept]
    mass = 1 + np.stack([np.bincount(at, q[c] - low[c], len(context)) for c in (0, 1)])
    used = np.unique(at)
    model.pair, model.context = Table(pair, q / mass[:, at]), Table(context[used], 1 / mass[:, used])
    return model


def _count_rows(label_at: str, text_at: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (level, key, label, left, n, context, word): in how many texts a key occurs; a pair has a row for each word before it."""
        for batch in batches:
            labels = np.asarray(tb.text_column(batch, label_at).to_numpy(zero_copy_only=False), np.int64)
            for i, j, data, at in tb.chunks(tb.text_column(batch, text_at)):
                x = Pairs.of(tb.words(data, at, tb.FOLDED, fold=True), by_left=True)
                none = np.zeros(len(x.text), np.uint64)
                of = labels[i:j][x.text]
                for level, key, left, context, word in ((STEM, x.stem, none, none, none), (WORD, x.word, none, x.stem, none), (PAIR, x.pair, x.left, x.before, x.word)):
                    for c in (0, 1):
                        mine = np.flatnonzero(of == c)
                        mine = mine[_first_of_each(key[mine], left[mine] if level == PAIR else x.text[mine].astype(np.uint64))]
                        k, one, n = np.unique(tb.mix(key[mine] + left[mine] * np.uint64(0xD1342543DE82EF95)), return_index=True, return_counts=True)
                        one = mine[one]
                        columns = [pa.array(v[one].view(np.int64)) for v in (key, left, context, word)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), level, np.int32)), columns[0], pa.array(np.full(len(k), c, np.int32)), columns[1], pa.array(n), columns[2], columns[3]], ["level", "key", "label", "left", "n", "context", "word"])

    return count


def _counted(labelled: DataFrame) -> DataFrame:
    """Rows (_label, _text) as (level, key, n0, n1, context, word); a context's counts are those of the pairs that begin with it."""
    rows = labelled.mapInArrow(_count_rows("_label", "_text"), "level int, key long, label int, left long, n long, context long, word long")
    rows = rows.groupBy("level", "key", "label", "left").agg(F.sum("n").alias("n"), F.first("context").alias("context"), F.first("word").alias("word"))
    rows = rows.withColumn("n", F.when(F.col("level") == PAIR, 1).otherwise(F.col("n")))
    n = [F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    keys = written(rows.groupBy("level", "key").agg(*n, F.first("context").alias("context"), F.first("word").alias("word")), "counted")
    contexts = keys.where(F.col("level") == PAIR).groupBy(F.lit(CONTEXT).alias("level"), F.col("context").alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.lit(0).cast("long").alias("context"), F.lit(0).cast("long").alias("word"))
    return keys.unionByName(contexts)


def fit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_class: int = 2048) -> ToxicityModel:
    """Fits on the rows of ``labels`` as given (leave held-out rows out before). Rows without id or label don't count.

    A repeated id counts once, as toxic if any of its rows says so. Without rows of either class the model says 0
    for every text. Of the chosen rows, those of one fold in five give no counts and calibrate the score.
    """
    spark = documents.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    totals = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for c in (0, 1):
        best = known.where(F.col("_label") == c).orderBy(F.xxhash64("_id"), "_id").limit(max_per_class)
        chosen = best if chosen is None else chosen.unionByName(best)
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").withColumn("_fold", F.pmod(F.xxhash64(F.col("_id"), F.lit(11)), F.lit(5)))
    rows = written(rows.select("_label", "_text", "_fold"), "labelled")
    # Exact copies of a text count once.
    counted = rows.where("_fold <> 0").groupBy(F.xxhash64("_text"), "_label").agg(F.first("_text").alias("_text")).select("_label", "_text")
    counted = _counted(counted)
    pairs = counted.where(F.col("level") == PAIR)
    times = np.zeros((2, 6), np.int64)
    for r in pairs.groupBy(F.least("n0", F.lit(5)).alias("n0"), F.least("n1", F.lit(5)).alias("n1")).agg(F.count("*").alias("c")).collect():
        times[0, r["n0"]] += r["c"]
        times[1, r["n1"]] += r["c"]
    some = (F.col("n0") + F.col("n1") >= MIN_PAIR) | (F.pmod("key", F.lit(RARE)) == 0)
    begins = pairs.where(some).select(F.lit(CONTEXT).alias("level"), F.col("context").alias("key")).distinct()
    parts = counted.where(F.col("level").isin(STEM, WORD) | ((F.col("level") == PAIR) & some)).unionByName(counted.where(F.col("level") == CONTEXT).join(begins, ["level", "key"], "left_semi"))
    model = estimate(parts.toArrow(), times)
    if not totals.get(0) or not totals.get(1):
        model.slope, model.bias = 0.0, -20.0 if not totals.get(1) else 20.0
        return model
    shared = spark.sparkContext.broadcast(model)

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in tb.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(shared.value.ratio(tb.words(data, at, tb.FOLDED, fold=True)))], ["_label", "x"])

    held = rows.where("_fold = 0").select("_label", "_text").mapInArrow(ratios, "_label int, x double").toArrow()
    model.slope, model.bias = _calibrate(held["x"].to_numpy(), held["_label"].to_numpy().astype(float), totals)
    shared.destroy()
    return model


def _calibrate(x: np.ndarray, y: np.ndarray, totals: dict[int, int]) -> tuple[float, float]:
    """Logistic fit of labels y on ratios x by Newton steps; rows weigh as their class does among all labelled rows."""
    n = [max(1, int((y == c).sum())) for c in (0, 1)]
    weight = np.where(y == 1, totals[1] / n[1], totals[0] / n[0])
    weight = weight / weight.mean() if len(weight) else weight
    scale = x.std() if len(x) and x.std() > 0 else 1.0
    a = np.stack([x / scale, np.ones(len(x))], 1)
    beta = np.array([1.0, np.log(totals[1] / totals[0])])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (weight * (y - p)) - 1e-2 * np.array([beta[0], 0.0])
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(h, g)
        beta = beta + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 0.0) / scale), float(beta[1])


def score(documents: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row. Null and empty texts have the score of a text without evidence.

    Repeated rows are scored each; other columns are not read, whatever their names.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.score(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["_id", "held_out", "score", "predicted"])

    kind = documents.schema[id_col].dataType.simpleString()
    slim = documents.select(F.col(id_col).alias("_id"), (crc32_of_id(id_col) % FOLDS == 0).alias("held_out"), F.col(text_col).alias("_text"))
    return slim.mapInArrow(run, f"_id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("_id", id_col)


def keep_clean(documents: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """The rows of documents, all columns as they are, whose text isn't predicted toxic.

    Null and empty texts are judged as texts without evidence; repeated rows stay or go together. Other columns may
    have any names. An empty table gives an empty result.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column(at)) < 0.5))

    return documents.mapInArrow(run, documents.schema)


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labelled rows outside the held-out fold."""
    return labels.where(crc32_of_id(id_col) % FOLDS != 0)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return score(documents, fit(documents, training_labels(read(spark, sf_dir, "labels"))))
