"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over bytes, order ORDER, so that words never seen don't decide alone. Counts are tables keyed by the
n-gram's bytes in one long: raw counts for the highest order, continuation counts below it. Probabilities come
from joins of these tables in hash shards: an n-gram's count with the sums of its context, and with the next
lower order's probability of its suffix. Nothing is cut from the tables.

Perplexity is by document: the most frequent n-grams and contexts, at most ``head`` of each order, are looked up
where the texts are, since moving every n-gram of every text would shuffle many times the input. What they don't
settle is merged by text and n-gram and joined with the whole tables in hash shards, order by order, and the sums are
added. The result is the same for any ``head``.

Trusted text is every document labelled good; four fifths of them, by a hash of the id, are counted. Thresholds are
quantiles over all documents labelled good that gave no counts, by language and length band; a language or band with
under MIN_QUANTILE of them takes the next wider group's. Whole texts are moved only if they are counted: a table of bits
of bounded size leaves the others where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import textbytes as tb
from tallyframe.llm.spark import read, written

ORDER = 5
HEAD = 1 << 20
MIN_QUANTILE = 40
BANDS = (256, 1024)
FOLDS = 5
#: Bits of the table that says which texts may be counted, as a power of two; 64 of them are a row.
BITS = 26


def grams(data: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, and the end of each text (byte 0) after it; before a text come zero bytes.

    Returns keys (first byte highest) and the borders of the texts in them.
    """
    n = len(at) - 1
    size = np.diff(at) + order  # a text, its end, and order - 1 zeros before it
    edge = np.concatenate(([0], np.cumsum(size)))
    flat = np.zeros(int(edge[-1]) + 1, np.int64)
    flat[np.arange(len(data)) + np.repeat(np.arange(n) * order + order - 1, np.diff(at))] = data
    key = np.zeros(int(edge[-1]) - order + 1 if n else 0, np.int64)
    for j in range(order):
        key = key << 8 | flat[j : j + len(key)]
    wanted = np.diff(at) + 1
    own = np.arange(int(wanted.sum())) + np.repeat(np.arange(n) * (order - 1), wanted)
    return key[own], np.concatenate(([0], np.cumsum(wanted)))


class Index:
    """Places of sorted keys, by two hash tables without chains; the few keys that fit in neither are searched."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys if len(keys) else np.array([-1], np.int64)
        self.bits = max(4, int(len(self.keys) * 3).bit_length())
        self.tables = []
        left = np.arange(len(self.keys))
        for t in range(2):
            table = np.zeros(1 << self.bits, np.int32)
            slot = self._slot(self.keys[left], t)
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]
        self.left = left

    def _slot(self, k: np.ndarray, t: int) -> np.ndarray:
        odd = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)[t]
        return ((k.view(np.uint64) * np.uint64(odd)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, k: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        at = self.tables[0][self._slot(k, 0)]
        bad = np.flatnonzero(self.keys[at] != k)
        if len(bad):
            q = k[bad]
            second = self.tables[1][self._slot(q, 1)]
            good = self.keys[second] == q
            if len(self.left) and not good.all():
                rest = np.flatnonzero(~good)
                own = self.keys[self.left]
                i = np.minimum(np.searchsorted(own, q[rest]), len(own) - 1)
                hit = own[i] == q[rest]
                second[rest[hit]], good[rest[hit]] = self.left[i[hit]], True
            second[~good] = -1
            at[bad] = second
        return at


@dataclass
class KneserNey:
    """Log10 probabilities by n-gram and log10 backoff weights by context, for orders 1 to ORDER."""

    keys: list[np.ndarray]
    probability: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    whole: list[tuple[bool, bool]]  # whether all n-grams and all contexts of an order are here
    tables: list[tuple[DataFrame, DataFrame]]  # all of them: (k, p) and (context, g), logarithms too
    _index: list[tuple[Index, Index]] | None = None

    def __getstate__(self):  # the tables stay with the driver
        return self.keys, self.probability, self.contexts, self.backoff, self.whole

    def __setstate__(self, state):
        self.keys, self.probability, self.contexts, self.backoff, self.whole = state
        self.tables, self._index = [], None

    @property
    def complete(self) -> bool:
        return all(a and b for a, b in self.whole)

    def log10(self, key: np.ndarray) -> np.ndarray:
        """Of each n-gram's last byte, given those before it; NaN where the head doesn't settle it."""
        if self._index is None:
            self._index = [(Index(a), Index(b)) for a, b in zip(self.keys, self.contexts, strict=True)]
        out = np.zeros(len(key))
        left = np.arange(len(key))
        for n in range(len(self.keys), 0, -1):
            k = key[left] & ((1 << 8 * n) - 1)
            at = self._index[n - 1][0].find(k)
            found = at >= 0
            out[left[found]] += self.probability[n - 1][at[found]]
            left, k = left[~found], k[~found]
            if not self.whole[n - 1][0]:
                out[left] = np.nan
                return out
            if not len(left):
                return out
            at = self._index[n - 1][1].find(k >> 8)
            known = at >= 0
            out[left[known]] += self.backoff[n - 1][at[known]]
            if not self.whole[n - 1][1]:  # a context with no backoff here may have one in the table
                out[left[~known]] = np.nan
                left = left[known]
        out[left] += np.log10(1 / 256)
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, at in tb.chunks(batch.column(0)):
            k, n = np.unique(grams(data, at, ORDER)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["k", "n"])


def _head(table: DataFrame, by: str, columns: list, most: int) -> tuple[pa.Table, bool]:
    """The columns of the rows with the largest ``by``, at most ``most`` of them, and whether these are all."""
    size, at_least = table.count(), 0
    if size > most:
        step = F.floor(F.log2(by) * 8)
        for r in table.groupBy(step.alias("s")).agg(F.count("*").alias("c")).orderBy("s").collect():
            size, at_least = size - r["c"], r["s"] + 1
            if size <= most:
                break
        table = table.where(step >= at_least)
    return table.select(*columns).toArrow().sort_by(table.columns[0]), not at_least


def kneser_ney(texts: DataFrame, head: int = HEAD) -> KneserNey:
    """Fits on (text). Without any text every byte has probability 1 / 256."""
    # Each table is written: plans stay small, however many orders there are.
    counts = [written(texts.where("text is not null").select("text").mapInArrow(_count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), "grams")]
    for n in range(ORDER - 1, 0, -1):  # in how many ways the n-gram continues the one byte before it
        counts.insert(0, written(counts[0].groupBy(F.col("k").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("k")).agg(F.count("*").alias("n")), "grams"))
    model = KneserNey([], [], [], [], [], [])
    lower = None
    for order, table in enumerate(counts, 1):
        of = {r["n"]: r["c"] for r in table.where("n <= 4").groupBy("n").agg(F.count("*").alias("c")).collect()}
        t = [max(1, of.get(k, 0)) for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1])
        d = [float(np.clip(k - (k + 1) * y * t[k] / t[k - 1], 0.05, k - 0.05)) for k in (1, 2, 3)]
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = table.withColumn("context", F.shiftright("k", 8)).withColumn("kept", F.col("n") - discount)
        sums = written(rows.groupBy("context").agg(F.sum("n").alias("total"), (1 - F.sum("kept") / F.sum("n")).alias("gamma")), "contexts")
        rows = rows.join(sums, "context")
        if lower is None:
            rows = rows.withColumn("p", F.col("kept") / F.col("total") + F.col("gamma") / 256)
        else:
            rows = rows.join(lower.select(F.col("k").alias("suffix"), F.col("p").alias("below")), F.col("k").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1)) == F.col("suffix"))
            rows = rows.withColumn("p", F.col("kept") / F.col("total") + F.col("gamma") * F.col("below"))
        lower = written(rows.select("k", "n", "context", "p"), "probabilities")
        found, all_grams = _head(lower.select("k", "n", "p"), "n", ["k", F.log10("p").alias("p")], head)
        backoff = sums.select("context", "total", F.log10(F.greatest("gamma", F.lit(1e-9))).alias("g"))
        context, all_contexts = _head(backoff, "total", ["context", "g"], head)
        model.keys.append(found["k"].to_numpy())
        model.probability.append(found["p"].to_numpy())
        model.contexts.append(context["context"].to_numpy())
        model.backoff.append(context["g"].to_numpy())
        model.whole.append((all_grams, all_contexts))
        model.tables.append((lower.select("k", F.log10("p").alias("p")), backoff.select("context", "g")))
    return model


def _joined(keys: DataFrame, model: KneserNey) -> DataFrame:
    """(k, p) of the n-grams (k), from the whole tables: a join by hash for each order's n-grams and contexts."""
    out, log = keys, F.lit(float(np.log10(1 / 256)))
    for n, (grams_, contexts) in enumerate(model.tables, 1):
        suffix = F.col("k").bitwiseAND(F.lit((1 << 8 * n) - 1))
        out = out.withColumn("_k", suffix).join(grams_.select(F.col("k").alias("_k"), F.col("p").alias(f"p{n}")), "_k", "left").drop("_k")
        out = out.withColumn("_c", F.shiftright(suffix, 8)).join(contexts.select(F.col("context").alias("_c"), F.col("g").alias(f"g{n}")), "_c", "left").drop("_c")
        log = F.coalesce(F.col(f"p{n}"), F.coalesce(F.col(f"g{n}"), F.lit(0.0)) + log)
    return out.select("k", log.alias("p"))


def perplexities(documents: DataFrame, model: KneserNey) -> DataFrame:
    """(id, lang, text) to (id, lang, n_bytes, perplexity by byte), with an end for each text.

    Null and empty texts are an end alone. Repeated rows are scored each; an empty table gives none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kinds = [f.dataType.simpleString() for f in documents.schema.fields[:2]]
    open_ = pa.list_(pa.struct([("k", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j, data, at in tb.chunks(batch.column(2), 1 << 19):
                key, edge = grams(data, at, ORDER)
                p = shared.value.log10(key)
                rest = np.flatnonzero(np.isnan(p))
                p[rest] = 0
                # What the head doesn't settle: distinct n-grams of each text, with how often they occur.
                text = np.searchsorted(edge, rest, "right") - 1
                order = np.lexsort((key[rest], text))
                k, text = key[rest][order], text[order]
                new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (text[1:] != text[:-1])))) if len(k) else np.empty(0, int)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[new], np.arange(j - i + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(k[new]), pa.array(np.diff(np.append(new, len(k))))], ["k", "n"]))
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(j - i)), batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(at)), pa.array(np.diff(edge)), pa.array(np.add.reduceat(p, edge[:-1])), lists.cast(open_)], ["row", "id", "lang", "n_bytes", "size", "log", "open"])
                row += j - i

    passed = documents.mapInArrow(run, f"row long, id {kinds[0]}, lang {kinds[1]}, n_bytes long, size long, log double, open array<struct<k: bigint, n: bigint>>")
    log = F.col("log")
    if not model.complete:
        passed = written(passed, "quality-pass")
        rest = passed.select("row", F.inline("open"))
        found = written(_joined(rest.select("k").distinct(), model), "joined")
        sums = rest.join(found, "k").groupBy("row").agg(F.sum(F.col("n") * F.col("p")).alias("more"))
        passed, log = passed.join(sums, "row", "left"), F.col("log") + F.coalesce("more", F.lit(0.0))
    return passed.select("id", "lang", "n_bytes", F.pow(F.lit(10.0), -log / F.col("size")).alias("perplexity"))


def _counted_texts(slim: DataFrame, counted: DataFrame) -> DataFrame:
    """(text) of the rows of slim (id, text) whose id is in counted, exact copies once."""
    keyed = slim.where("text is not null").select("id", "text", F.unhex(F.md5("text")).alias("digest"))
    # One row for each digest; equal rows are one row too.
    chosen = written(keyed.select("id", "digest").join(counted, "id").groupBy("digest").agg(F.min("id").alias("id")), "chosen")
    at = F.pmod(F.xxhash64("digest"), F.lit(1 << BITS))
    word, bit = F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
    bits = chosen.groupBy(word.alias("word")).agg(F.bit_or(one(bit)).alias("bits"))  # 2^(BITS - 6) rows at most
    maybe = keyed.withColumn("word", word).withColumn("bit", one(bit)).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return maybe.select("id", "digest", "text").join(chosen, ["id", "digest"]).groupBy("id", "digest").agg(F.first("text").alias("text")).select("text")


def _band(size) -> F.Column:
    return F.when(size < BANDS[0], 0).when(size < BANDS[1], 1).otherwise(2)


def classify(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", quantile: float = 0.99, max_trusted: int | None = None, head: int = HEAD) -> DataFrame:
    """(id, lang, n_bytes, perplexity, threshold, keep) of every row.

    Null and empty texts are an end alone. A null language is a language of its own. Labels count by id; a repeated
    id is good if all its rows say so. Without trusted texts all documents are kept. A quantile is the smallest
    perplexity that at least such a share doesn't exceed. Other columns aren't read. An empty table gives none.
    ``max_trusted`` bounds the documents whose texts may be counted; without it all are.
    """
    good = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label")).where("label = 1").select("id")
    chosen = good if max_trusted is None else good.orderBy(F.xxhash64("id"), "id").limit(max_trusted)
    counted = chosen.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FOLDS)) != 0)
    slim = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    # Exact copies of a text count once.
    model = kneser_ney(_counted_texts(slim.select("id", "text"), counted), head)
    scored = written(perplexities(slim, model).withColumn("band", _band(F.col("n_bytes"))), "perplexities")
    held = written(scored.join(good, "id").join(counted, "id", "left_anti").select("lang", "band", "perplexity"), "trusted")
    of = lambda *by: held.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("perplexity", quantile, 100_000).alias("q"), F.max("perplexity").alias("most"))
    every = of().first()["q"]
    every = F.lit(float("inf") if every is None else float(every))
    wide = of("lang").select("lang", F.when(F.col("n") >= MIN_QUANTILE, F.col("q")).otherwise(every).alias("wide"))
    own = of("lang", "band").join(wide, "lang")
    own = own.select("lang", "band", F.when(F.col("n") >= MIN_QUANTILE, F.col("q")).otherwise(F.greatest("wide", "most")).alias("own"))
    threshold = F.coalesce("own", "wide", every)
    kind = documents.schema[lang_col].dataType.simpleString()
    found = scored.join(wide, "lang", "left").join(own, ["lang", "band"], "left")
    return found.select(F.col("id").alias(id_col), F.col("lang").cast(kind).alias("lang"), "n_bytes", "perplexity", threshold.alias("threshold"), (F.col("perplexity") <= threshold).alias("keep"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
