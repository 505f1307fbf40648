"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Tokens are words between ASCII white space, A-Z lower-cased, and one end per text. A word has one of GROUPS * MEMBERS
classes: the most frequent words (and the end) have one each, the others share by their last letters. The model is

    p(word | before) = p(group | features) * p(class | group, features) * p(word | class)

with both softmaxes over sums of hashed weights: the word before, the pair before, and the word before that (a
skip). Within its class a word has its add-one share of training counts, with one unit for all unknown words. The
buckets that each kind of feature is hashed to grow with the square root of the distinct words (``buckets_for``).

Counts: one aggregate of (word hash, count) over all training texts. The most frequent words, at
most ``head_words`` of them, are broadcast; what is left of a text's tokens is joined with the
counts by hash. A count enters a score only as log10(count + 1), so the join adds sums to what the pass over
the texts has computed.

Training: every training text is read once, in ``rounds`` disjoint parts. In a round each task starts from the
broadcast weights, takes AdaGrad steps on the rows that a batch touches, and hands out its change, as half-precision
blocks; the changes are averaged by tokens, block by block, and the mean goes into the next round. A long text is read
in pieces cut between words and learned and scored in slices of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import textbytes as tb
from tallyframe.llm.spark import crc32_of_id, read, written

GROUPS, MEMBERS = 16, 16
OWN = 128  # classes of one word each; class 0 is the end's
LEAST_BUCKETS = 1024
END = np.uint64(0x656E64)
FOLDS, HELD = 7, 2
HEAD_WORDS = 1 << 19
RATE = 0.3
FAN = 16
SLICE = 1 << 16
_BLOCK = 1 << 16
_ROW = GROUPS + GROUPS * MEMBERS


def buckets_for(distinct: int) -> int:
    """Buckets of each kind of feature: the power of two at or above twice the square root of the distinct words."""
    return max(LEAST_BUCKETS, 1 << int(np.ceil(np.log2(2 * np.sqrt(max(distinct, 1))))))


def size_of(buckets: int) -> int:
    """Weights in all: a row for each bucket of the three kinds, and one that is always on."""
    return (3 * buckets + 1) * _ROW


@dataclass
class Counts:
    """Bounded part of the counts, and totals by class."""

    keys: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    tokens: int  # N
    distinct: int  # V
    class_mass: np.ndarray = field(default_factory=lambda: np.ones(GROUPS * MEMBERS))  # N + V + 1 of each class


@dataclass
class Tokens:
    """Tokens of a chunk of texts, ends included; those of text d are first[d]:first[d + 1]."""

    hash: np.ndarray
    share: np.ndarray  # the class that a word without its own has
    first: np.ndarray

    def before(self, k: int) -> np.ndarray:
        """Hashes of the k-th token before each; 0 before a text."""
        out = np.zeros_like(self.hash)
        out[k:] = self.hash[:-k]
        for j in range(k):
            at = self.first[:-1] + j
            out[at[at < self.first[1:]]] = 0
        return out


def tokens_of(data: np.ndarray, at: np.ndarray) -> Tokens:
    if len(at) == 2 and len(data) > tb.CHUNK_BYTES:
        parts = [_tokens(data[a:b], np.array([0, b - a])) for a, b in tb.pieces(data, tb.PLAIN)]
        # Only the last piece keeps its end.
        h = np.concatenate([p.hash[:-1] for p in parts] + [parts[-1].hash[-1:]])
        return Tokens(h, np.concatenate([p.share[:-1] for p in parts] + [parts[-1].share[-1:]]), np.array([0, len(h)]))
    return _tokens(data, at)


def _tokens(data: np.ndarray, at: np.ndarray) -> Tokens:
    w = tb.words(data, at, tb.PLAIN, fold=True)
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    h = np.full(len(w.start) + n, END, np.uint64)
    share = np.zeros(len(h), np.int32)
    where = np.arange(len(w.start)) + w.text_of()
    h[where] = w.hashes()
    share[where] = OWN + (w.hashes(last=2) % np.uint64(GROUPS * MEMBERS - OWN)).astype(np.int32)
    return Tokens(h, share, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word hash, shared class, count), merged over a task's chunks as far as memory is bounded."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, one, which = np.unique(k, return_index=True, return_inverse=True)
        return keys, c[one], np.bincount(which, n, len(keys)).astype(np.int64)

    def rows(k: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c), pa.array(n)], ["h", "c", "n"])

    for batch in batches:
        for _, _, data, at in tb.chunks(batch.column(0)):
            t = tokens_of(data, at)
            keys, one, n = np.unique(t.hash, return_index=True, return_counts=True)
            held.append((keys, t.share[one], n))
            size += len(keys)
            if size > 1_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 700_000:
                    yield rows(*held[0])
                    held, size = [], 0
    if held:
        yield rows(*merged())


def count(training: DataFrame, head_words: int = HEAD_WORDS) -> tuple[DataFrame, Counts]:
    """(h, c, n) of all training tokens, written, and what is broadcast of it. training: (text)."""
    table = written(training.select("text").mapInArrow(_count, "h long, c int, n long").groupBy("h").agg(F.first("c").alias("c"), F.sum("n").alias("n")), "word-counts")
    # Counts on a logarithmic scale: a few thousand steps for any input.
    step = F.floor(F.log2("n") * 32)
    histogram = table.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    head_from, words = 1 << 20, 0
    for r in histogram:
        if words + r["words"] > head_words:
            break
        head_from, words = r["step"], words + r["words"]
    table = table.withColumn("in_head", step >= head_from)
    head = table.where("in_head").toPandas()
    total = table.agg(F.sum("n"), F.count("*")).first()
    head = head.sort_values("n", ascending=False, kind="stable").reset_index(drop=True)
    own = head[head.h != int(END)].head(OWN - 1)
    classes = head.c.to_numpy(np.int32).copy()
    classes[own.index] = np.arange(1, len(own) + 1)
    classes[head.index[head.h == int(END)]] = 0
    keys = head.h.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    out = Counts(keys[order], head.n.to_numpy(np.int64)[order], classes[order], total[0] or 0, total[1])
    mass = table.groupBy("c").agg(F.sum(F.col("n") + 1).alias("m")).collect()
    for r in mass:
        out.class_mass[r["c"]] += r["m"]
    for c, own_class, n in zip(head.c.tolist(), classes.tolist(), head.n.tolist(), strict=True):
        if c != own_class:
            out.class_mass[c] -= n + 1
            out.class_mass[own_class] += n + 1
    return table, out


class Weights:
    """Both softmaxes' weights, as views of one vector."""

    def __init__(self, vector: np.ndarray):
        features = len(vector) // _ROW
        self.vector = vector
        self.buckets = (features - 1) // 3
        self.group = self.vector[: features * GROUPS].reshape(features, GROUPS)
        self.member = self.vector[features * GROUPS :].reshape(features * GROUPS, MEMBERS)


def _features(t: Tokens, buckets: int) -> list[np.ndarray]:
    one, two = t.before(1), t.before(2)
    n = np.uint64(buckets)
    pair = tb.mix(one * np.uint64(0x9E3779B97F4A7C15) + two) % n
    return [(one % n).astype(np.int32), pair.astype(np.int32) + np.int32(buckets), (tb.mix(two) % n).astype(np.int32) + np.int32(2 * buckets), np.full(len(one), 3 * buckets, np.int32)]


def _slices(t: Tokens, group: np.ndarray, buckets: int) -> Iterator[tuple[slice, list[np.ndarray], list[np.ndarray]]]:
    """Runs of tokens, with their rows in the weights of groups and of members."""
    f = _features(t, buckets)
    for i in range(0, len(group), SLICE):
        part = slice(i, min(i + SLICE, len(group)))
        rows = [x[part].astype(np.int64) for x in f]
        yield part, rows, [x * GROUPS + group[part] for x in rows]


def _softmaxes(w: Weights, of_group: list[np.ndarray], of_member: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for table, rows in ((w.group, of_group), (w.member, of_member)):
        z = table[rows[0]]
        for r in rows[1:]:
            z += table[r]
        np.clip(z, -60, 60, out=z)  # sums of weights this large don't occur; it keeps exp finite
        np.exp(z, out=z)
        z /= np.einsum("ij->i", z)[:, None]
        out.append(z)
    return out[0], out[1]


def _classes(counts: Counts, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token, and its place in the head or -1."""
    if not len(counts.keys):
        return t.share, np.full(len(t.hash), -1)
    at = np.minimum(np.searchsorted(counts.keys, t.hash), len(counts.keys) - 1)
    known = counts.keys[at] == t.hash
    return np.where(known, counts.classes[at], t.share), np.where(known, at, -1)


def _step(table: np.ndarray, squares: np.ndarray, rows: list[np.ndarray], errors: np.ndarray) -> None:
    """One AdaGrad step on the rows that the tokens' features touch; errors: by token and column."""
    flat = np.concatenate(rows)
    place = np.zeros(len(table), np.int32)
    place[flat] = 1
    touched = np.flatnonzero(place)
    place[touched] = np.arange(len(touched), dtype=np.int32)
    at = place[flat]
    columns = np.ascontiguousarray(errors.T, np.float64)
    gradient = np.empty((len(touched), table.shape[1]), np.float32)
    for k, error in enumerate(columns):
        gradient[:, k] = np.bincount(at, np.tile(error, len(rows)), len(touched))
    gradient /= len(errors)
    squares[touched] += gradient * gradient
    table[touched] -= RATE * gradient / np.sqrt(squares[touched])


def _steps(start: np.ndarray, counts: Counts):
    """A task's part of a round: its change of the weights, with its tokens, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, squares, seen = Weights(start.copy()), Weights(np.full(len(start), 1e-8, np.float32)), 0
        for batch in batches:
            for _, _, data, at in tb.chunks(batch.column(0), 1 << 18):
                t = tokens_of(data, at)
                c, _ = _classes(counts, t)
                group, member = c // MEMBERS, c % MEMBERS
                for part, of_group, of_member in _slices(t, group, w.buckets):
                    g, m = _softmaxes(w, of_group, of_member)
                    every = np.arange(len(g))
                    g[every, group[part]] -= 1
                    m[every, member[part]] -= 1
                    _step(w.group, squares.group, of_group, g)
                    _step(w.member, squares.member, of_member, m)
                seen += len(t.hash)
        if seen:
            w.vector -= start
            for k, i in enumerate(range(0, len(start), _BLOCK)):
                yield _block_row([k], [seen], [w.vector[i : i + _BLOCK]])

    return run


def _block_row(blocks: list[int], tokens: list[int], changes: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(tokens, pa.int64()), pa.array([x.astype(np.float16).tobytes() for x in changes], pa.binary())], ["block", "tokens", "change"])


def _mean_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: the mean of its changes, each weighted by its tokens."""
    total: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for b, n, x in zip(*batch.columns, strict=True):
            b, n = b.as_py(), n.as_py()
            x = np.frombuffer(x.as_buffer(), np.float16).astype(np.float32) * np.float32(n)
            seen, change = total.get(b, (0, np.float32(0)))
            total[b] = seen + n, change + x
    yield _block_row([*total], [n for n, _ in total.values()], [x / np.float32(n) for n, x in total.values()])


def train(training: DataFrame, counts: Counts, rounds: int = 2, buckets: int | None = None) -> np.ndarray:
    """The weights. training: (id, text); buckets: of each kind of feature, else by the distinct words."""
    spark = training.sparkSession
    vector = np.zeros(size_of(buckets or buckets_for(counts.distinct)), np.float32)
    part = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(rounds))
    for r in range(rounds):
        state = spark.sparkContext.broadcast((vector, counts))

        def run(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            yield from _steps(*state.value)(batches)

        shape = "block int, tokens long, change binary"
        changes = training.where(part == r).select("text").mapInArrow(run, shape)
        # In two steps, so that no task reads what all others made; small shuffle partitions are joined as the session does.
        some = changes.repartition("block", F.spark_partition_id() % FAN).mapInArrow(_mean_blocks, shape)
        means = some.repartition("block").mapInArrow(_mean_blocks, shape).collect()
        for row in means:
            i = row["block"] * _BLOCK
            x = np.frombuffer(row["change"], np.float16)
            vector[i : i + len(x)] += x
        state.destroy()
    return vector


def score(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS, rounds: int = 2, buckets: int | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Null and empty texts are one end. A null id counts as empty text for its fold. Repeated rows train and are
    scored as often as they occur. Other columns aren't read. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    slim = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (crc32_of_id(id_col) % FOLDS == HELD).alias("held_out"))
    training = slim.where("not held_out")
    table, counts = count(training, head_words)
    shared = spark.sparkContext.broadcast((train(training, counts, rounds, buckets), counts))
    tail = pa.list_(pa.struct([("h", pa.int64()), ("tf", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, counts = shared.value
        w = Weights(vector)
        log_count = np.log10(counts.counts + 1.0)
        log_mass = np.log10(counts.class_mass)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j, data, at in tb.chunks(batch.column(1), 1 << 17):
                t = tokens_of(data, at)
                c, head = _classes(counts, t)
                group, member = c // MEMBERS, c % MEMBERS
                model = -log_mass[c]
                for part, of_group, of_member in _slices(t, group, w.buckets):
                    g, m = _softmaxes(w, of_group, of_member)
                    every = np.arange(len(g))
                    model[part] += np.log10(np.maximum(g[every, group[part]].astype(float), 1e-30)) + np.log10(np.maximum(m[every, member[part]].astype(float), 1e-30))
                known = head >= 0
                of_count = np.where(known, log_count[head] if len(log_count) else 0.0, 0.0)
                sums = [np.add.reduceat(x, t.first[:-1]) for x in (of_count, model, known.astype(np.int64))]
                rest = np.flatnonzero(~known)
                text = np.searchsorted(t.first, rest, "right") - 1
                order = np.lexsort((t.hash[rest], text))
                h, text = t.hash[rest][order], text[order]
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))) if len(h) else np.empty(0, int)
                tf = np.diff(np.append(new, len(h)))
                edge = np.searchsorted(text[new], np.arange(j - i + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays([pa.array(h[new].view(np.int64)), pa.array(tf.astype(np.int64))], ["h", "tf"]))
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(j - i)), batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(t.first)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1]), lists.cast(tail)], ["row", "id", "held_out", "n_tokens", "known", "of_count", "model", "tail"])
                row += j - i

    shape = f"row long, id {kind}, held_out boolean, n_tokens long, known long, of_count double, model double, tail array<struct<h: bigint, tf: bigint>>"
    passed = written(slim.mapInArrow(run, shape), "lm-pass")
    rare = passed.select("row", F.explode("tail").alias("t")).select("row", "t.h", "t.tf").join(table.where("not in_head").select("h", "n"), "h")
    rare = rare.groupBy("row").agg(F.sum("tf").alias("rare"), F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("rare_count"))
    total = F.coalesce(F.col("rare_count"), F.lit(0.0)) + F.col("of_count")
    base = float(np.log10(counts.tokens + counts.distinct + 1.0))
    out = passed.drop("tail").join(rare, "row", "left")
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (total - F.col("n_tokens") * base).alias("base_score"),
        (total + F.col("model")).alias("score"),
    )


def op9_maxent_lm(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
