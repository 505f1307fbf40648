"""Near-duplicates by Order MinHash and banded alignment.

Words are those of ``[0-9a-z]`` and above ASCII, lower-cased; k-mers are five consecutive words (all words of a
shorter text). A k-mer is labelled with its occurrence number, so that all labelled k-mers of a text differ. A
sketch takes the ELL smallest labelled k-mers under its own hash and keeps them in text order; two texts meet in
a bucket if one of their SKETCHES sketches is equal, which at similarity s has a probability of about s ** ELL for
each sketch: at 0.8 one pair in 14,000 is missed, and edits that keep the order count for more than the set alone.

Candidates are verified by aligning their k-mer sequences within a band: with M k-mers aligned in order, of A and
B, the similarity is M / (A + B - M), and 0.8 or more is a link. At that similarity at most (A + B) / 9 k-mers stay
unaligned, so no alignment that counts leaves a band of that width.

Exact copies of a text are one member of the search. Within a bucket each member is compared with the bucket's
pivot, the member that shares most and largest buckets: in a family of copies, one with few edits of its own, to
which most others link. A member is named by its text's digest, so ids may repeat. Where members of a bucket are then still in different components, the rest is done exactly
and without pairing a bucket with itself: at similarity s, texts of A >= B k-mers share s / (1 + s) * (A + B) of them
at least, so in the order from rare to common they share one among the first A - s * A + 1 of the longer text and the
first B - 2 s / (1 + s) * B + 1 of the shorter, at places that leave that many after them (a prefix filter with
positions). Members of different components that share such a k-mer are aligned. A text's own edits come first in
that order, so a family that only its common text holds together meets in few pairs. Sketches draw k-mers without
replacement, and a text of under ELL has another sketch than one with a k-mer more: the bound above is one for long
texts. All texts of under SHORT k-mers, and those that can be similar to them, go through the filter too. Classes are the connected
components of the links.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import textbytes as tb
from tallyframe.llm.components import components
from tallyframe.llm.spark import read, written

K = 5
SIMILARITY = 0.8
ELL = 5
SKETCHES = 24
SHORT = 30
_ODD = tb.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)


def kmers(w: tb.Words) -> list[np.ndarray]:
    """Hashes of the k-mers of each text, in order."""
    h = w.hashes()
    g, whole = w.grams(h, K)
    out = []
    for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        n = j - i
        out.append(g[i : j - K + 1] if n >= K else tb.mix(np.bitwise_xor.reduce(h[i:j] * _ODD[:n], keepdims=True) + np.uint64(n)) if n else g[:0])
    return out


def labelled(g: np.ndarray) -> np.ndarray:
    """The k-mers with their occurrence numbers, hashed."""
    order = np.argsort(g, kind="stable")
    s = g[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return tb.mix(g)
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    occurrence = np.empty(len(s), np.uint64)
    occurrence[order] = nth
    return tb.mix(g + occurrence * np.uint64(0x9E3779B97F4A7C15))


def sketch(x: np.ndarray) -> np.ndarray:
    """SKETCHES bucket keys of labelled k-mers x in text order."""
    ell = min(ELL, len(x))
    keys = np.zeros(SKETCHES, np.uint64)
    step = max(1, 400_000 // len(x))
    for i in range(0, SKETCHES, step):
        v = x[None, :] * _ODD[i : min(i + step, SKETCHES), None]
        at = np.argpartition(v, ell - 1, axis=1)[:, :ell] if len(x) > ell else np.broadcast_to(np.arange(ell), (len(v), ell))
        chosen = x[np.sort(at, axis=1)]
        key = np.arange(i, i + len(v), dtype=np.uint64)
        for j in range(ell):
            key = tb.mix(key * np.uint64(0xD1342543DE82EF95) + chosen[:, j])
        keys[i : i + len(v)] = key
    return keys


def alignment(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Similarity of two k-mer sequences aligned in order, or 0 where it is below ``similarity``.

    Occurrence numbers make an alignment a longest increasing run of places. Where k-mers repeat that is a lower bound
    (enough to accept), and the alignment over all equal k-mers of the band decides."""
    na, nb = len(a), len(b)
    if not na or not nb or min(na, nb) < similarity * max(na, nb):
        return 0.0
    score = lambda m: m / (na + nb - m)
    band = int((na + nb) * (1 - similarity) / (1 + similarity)) + 1
    head = 0
    same = a[: min(na, nb)] == b[: min(na, nb)]
    head = int(np.argmin(same)) if not same.all() else len(same)
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    tail = (int(np.argmin(same)) if not same.all() else n) if n else 0
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    fixed = head + tail
    if not len(a) or not len(b):
        s = score(fixed)
        return s if s >= similarity else 0.0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if score(fixed + int(np.minimum(ca[ia], cb[ib]).sum())) < similarity:
        return 0.0
    _, pa_, pb_ = np.intersect1d(labelled(a), labelled(b), assume_unique=True, return_indices=True)
    order = np.argsort(pa_)
    pa_, pb_ = pa_[order], pb_[order]
    near = np.abs(pa_ - pb_) <= band
    m = fixed + _increasing(pb_[near])
    if score(m) < similarity and (len(ua) < len(a) or len(ub) < len(b)):
        m = max(m, fixed + _banded_lcs(a, b, band))
    s = score(m)
    return s if s >= similarity else 0.0


def _increasing(x: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    if len(x) < 2 or (np.diff(x) > 0).all():
        return len(x)
    tails: list[int] = []
    for v in x.tolist():
        i = bisect_left(tails, v)
        if i == len(tails):
            tails.append(v)
        else:
            tails[i] = v
    return len(tails)


def _banded_lcs(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence with positions at most ``band`` apart; row by row over the band."""
    nb = len(b)
    width = 2 * band + 1
    padded = np.zeros(nb + 2 * width, b.dtype)
    padded[width : width + nb] = b
    inside = np.zeros(nb + 2 * width, bool)
    inside[width : width + nb] = True
    row = np.zeros(width + 1, np.int32)  # row[k]: best up to b[i - band + k]
    for i in range(len(a)):
        at = max(0, i - band + width)
        if at + width > len(padded):
            break
        hit = (padded[at : at + width] == a[i]) & inside[at : at + width]
        # shifted by one: the cell left above is row[k], the one above row[k + 1]
        cell = np.maximum(row[1:], row[:-1] + hit)
        row[:-1] = np.maximum.accumulate(cell)
        row[-1] = row[-2]
    return int(row.max())


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, at in tb.chunks(batch.column(2)):
            ids, same, n, keys = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), [], []
            for g in kmers(tb.words(data, at, tb.FOLDED, fold=True)):
                n.append(len(g))
                keys.append(sketch(labelled(g)).view(np.int64) if len(g) else None)
            yield pa.RecordBatch.from_arrays([ids, same, pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "m", "n", "keys"])


def _member_kmers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (m, c, text) as rows (s, m, c, n), one for each labelled k-mer."""
    for batch in batches:
        for i, j, data, at in tb.chunks(batch.column(2)):
            found = [labelled(g) if len(g) else g for g in kmers(tb.words(data, at, tb.FOLDED, fold=True))]
            n = np.array([len(x) for x in found])
            of = pa.array(np.repeat(np.arange(i, j), n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), pa.array(np.repeat(n, n))], ["s", "m", "c", "n"])


def _rest(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of members (m, c, text) of different c that can be similar enough, by prefix filter."""
    rows = members.mapInArrow(_member_kmers, "s long, m binary, c binary, n long")
    shared = rows.groupBy("s").agg(F.count("*").alias("df"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("df > 1")
    own = rows.join(shared, "s").groupBy("m", "c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s", (F.col("c0") != F.col("c1")).alias("mixed")))).alias("shared"))
    # A k-mer's place in the order: those of this member alone come first.
    places = own.select("m", "c", "n", (F.col("n") - F.size("shared")).alias("own"), F.posexplode("shared").alias("p", "k")).select("m", "c", "n", (F.col("own") + F.col("p")).alias("i"), "k.s", "k.mixed")
    first = lambda share: F.col("i") <= F.col("n") * (1 - share) + 1e-9
    share = 2 * similarity / (1 + similarity)
    prefix = places.where(F.col("mixed") & first(similarity)).drop("mixed")
    # A k-mer counts only where prefixes of different components hold it.
    meets = prefix.groupBy("s").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("s")
    prefix = written(prefix.join(meets, "s", "left_semi"), "prefixes")
    short = prefix.where(first(share)).select("s", *[F.col(x).alias(f"{x}_") for x in ("m", "n", "i", "c")])
    longer = (F.col("n") > F.col("n_")) | ((F.col("n") == F.col("n_")) & (F.col("m") > F.col("m_")))
    left = F.least(F.col("n") - F.col("i"), F.col("n_") - F.col("i_")) >= share / 2 * (F.col("n") + F.col("n_")) - 1e-9
    near = longer & (F.col("c") != F.col("c_")) & (F.col("n_") >= similarity * F.col("n")) & left
    return prefix.join(short.hint("merge"), "s").where(near).select(F.least("m", "m_").alias("a"), F.greatest("m", "m_").alias("b")).distinct()


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, np.ndarray] = {}
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            ta, tb_ = batch.column(2), batch.column(3)
            for i in range(len(a)):
                pair = []
                for k, t in ((a[i], ta), (b[i], tb_)):
                    if k not in memo:
                        if len(memo) > 64:
                            memo.clear()
                        memo[k] = kmers(tb.words(*tb.raw(t.slice(i, 1)), tb.FOLDED, fold=True))[0]
                    pair.append(memo[k])
                if alignment(*pair, similarity) >= similarity:
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id) of every row; class_id is the smallest id of the class, in the order of the ids' own type.

    A null text and a text without words are in no class but their own; of equal texts all are in one class.
    A null id has the class of its text, or null. Members are texts, not ids: repeated rows are returned as often as
    they occur, and rows of one id with different texts are classed each by its own text. Other columns aren't read.
    An empty table gives an empty result.
    """
    return _classified(documents, id_col, text_col, similarity).drop("_text")


def _classified(documents: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(id, class_id, _text: the digest of the row's text, null for a null text) of every row."""
    # A member is a distinct text, named by its digest. Ids keep their own type and order.
    kind = documents.schema[id_col].dataType
    slim = documents.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.col(text_col))).alias("m"), F.col(text_col).alias("text"))
    sketched = written(slim.mapInArrow(_sketches, f"id {kind.simpleString()}, m binary, n long, keys array<long>"), "sketches")
    reps = written(sketched.where("n > 0 and id is not null").groupBy("m").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys")), "representatives")
    member = reps.select("m", "n", F.explode("keys").alias("key"))
    # What is joined by bucket is a written table each, so that both sides are exchanges of their own and hot buckets are split.
    sizes = written(member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = written(member.join(sizes.hint("merge"), "key").select("key", "size", "m", "n"), "shared-buckets")
    central = shared.groupBy("m").agg(F.round(F.sum(F.log2("size")), 6).alias("central"))
    ranked = shared.join(central.hint("merge"), "m")
    pivots = written(ranked.groupBy("key").agg(F.max(F.struct("central", "m", "n")).alias("pivot")), "pivots")
    in_bucket = written(shared.join(pivots.hint("merge"), "key").select("key", "size", "m", "n", F.col("pivot.m").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "buckets")
    bound = (F.least("n", "pivot_n") >= similarity * F.greatest("n", "pivot_n")) & (F.col("m") != F.col("pivot"))
    tried = written(in_bucket.where(bound).select(F.col("m").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
    # Only documents that share a bucket, and short ones, are aligned. Short texts have too few k-mers for the sketches' bound.
    # One row of each: by id as well, so that the copies of a text don't meet in a task.
    wanted = in_bucket.select("m").distinct().withColumn("met", F.lit(True))
    wanted = reps.select("m", "id", (F.col("n") < SHORT / similarity).alias("brief")).join(wanted.hint("merge"), "m", "left").where("met or brief").drop("met")
    texts = slim.select("m", "id", "text").join(wanted.hint("merge"), ["m", "id"]).groupBy("m", "id").agg(F.first("text").alias("text"), F.first("brief").alias("brief")).drop("id")
    texts = written(texts, "texts")
    root = components(_links(tried, texts, similarity))
    # Members of one bucket that are still in different components, and all short texts, whether they share a bucket or not.
    named = in_bucket.where("size > 2").select("key", "m").join(root.withColumnRenamed("node", "m"), "m", "left").select("key", "m", F.coalesce("root", "m").alias("c"))
    mixed = written(named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key"), "mixed")
    left = named.join(mixed.hint("merge"), "key", "left_semi").select("m").distinct().withColumn("open", F.lit(True))
    left = texts.join(left.hint("merge"), "m", "left").where("open or brief").join(root.withColumnRenamed("node", "m"), "m", "left").select("m", F.coalesce("root", "m").alias("c"), "text")
    more = _rest(left, similarity).join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).hint("merge"), ["a", "b"], "left_anti")
    root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_links(more, texts, similarity)))
    # The smallest id of each class.
    named = reps.select("m", "id").join(root.withColumnRenamed("node", "m"), "m", "left").select("m", "id", F.coalesce("root", "m").alias("root"))
    classes = written(named, "classes")
    least = written(classes.groupBy("root").agg(F.min("id").alias("class_id")), "class-ids")
    classes = classes.join(least.hint("merge"), "root").select("m", "class_id")
    out = sketched.select("id", "m", F.when(F.col("n") > 0, F.col("m")).alias("same")).join(classes.withColumnRenamed("m", "same"), "same", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.col("m").alias("_text"))


def _links(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose alignment is similar enough. b may be hot: it is joined last, in splittable joins."""
    one = pairs.join(texts.select(F.col("m").alias("a"), F.col("text").alias("ta")), "a")
    both = one.join(texts.select(F.col("m").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_verify(similarity), "a binary, b binary")


def op1_order_minhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id, and whether the row is the one that stays of its class."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("stays"))


def keep_one(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents without those whose class has a smaller id; all columns as they are.

    Rows without an id stay, as do null texts and texts without words. A row goes by its id and its text: of rows of
    one id with different texts only those go that stand for another id's class, and repeated rows stay or go
    together. An empty table gives an empty result.
    """
    found = _classified(documents, id_col, text_col, SIMILARITY)
    gone = found.where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias("_gone"), F.col("_text")).distinct()
    # The same join at every size: the list of what goes grows with the input.
    same = (documents[id_col] == gone["_gone"]) & (F.unhex(F.md5(documents[text_col])) == gone["_text"])
    return documents.join(gone.hint("merge"), same, "left_anti")
