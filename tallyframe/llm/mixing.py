"""Mixing sources to target weights: how often each document is taken, by pivotal dependent rounding.

A source's target in words gives each of its documents the same real number of copies. The whole part is taken for
sure; the fractions are rounded in pairs: mass in words moves from one document of a pair to the other, by a keyed draw
of the right chance, until one fraction is 0 or 1. The sum in words stays what it was, and each fraction its own
expectation. Pairing runs in buckets of bounded size; what each bucket leaves over, one document at most, is paired in
the next level of a tree, down to one document of a source.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.spark import read, written

SPACE = r"[\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2
#: Units of a bucket on average; a bucket is read by one task.
BUCKET = 8192
#: Identical rows that one output row of the last explode stands for.
RUN = 4096
NEAR = 1e-9

_OUT = "key string, source string, size long, p double"


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """sources (source, source_size), one row each, with ``target``.

    In code point order, null last, the sources weigh ``weights``, repeating. They share ``share`` times the sum of all
    sizes by weight; one that would have over ``most`` times its own size has that, and the excess is shared by the
    others, until none is above. A source of size 0 has 0. Only two sums a round reach the driver.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    spark = sources.sparkSession
    place = _places(sources)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int") + 1)
    rows = written(place.select("source", "source_size", weight.alias("weight"), F.lit(False).alias("full")), "mix-sources")
    cap = most * F.col("source_size")
    whole = rows.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    level, full = 0.0, -1
    while True:  # each round but the last fills a source more at least
        at = F.col("weight") * level > cap
        r = rows.agg(F.sum(F.when(at, cap)).alias("given"), F.sum(F.when(~at, F.col("weight"))).alias("w"), F.count_if(at).alias("full")).first()
        if r["full"] == full or not r["w"]:
            break
        full, level = r["full"], (share * whole - (r["given"] or 0)) / r["w"]
    return rows.select("source", "source_size", F.least(F.col("weight") * level, cap.cast("double")).alias("target"))


def _places(sources: DataFrame) -> DataFrame:
    """sources with ``place``, from 0 in code point order, null last: ranges are numbered side by side."""
    spark = sources.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(sources.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-ranges")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("inside", inside).join(F.broadcast(before), "part").select("source", "source_size", (F.col("before") + F.col("inside")).alias("place"))


def _draw(seed: int, one: str, other: str) -> float:
    """A number in [0, 1) of the pair."""
    return int.from_bytes(hashlib.blake2b(f"{seed}\x1f{one}\x1f{other}".encode(), digest_size=7).digest(), "big") / 2.0**56


def _snap(p):
    """What has reached an end but for rounding is there."""
    return np.where(p < NEAR, 0.0, np.where(p > 1.0 - NEAR, 1.0, p))


def _settle(keys: list[str], w: np.ndarray, p: np.ndarray, held: int, rest: np.ndarray, seed: int, last: bool) -> None:
    """Moves mass between held and rest (in place) until held or all of rest is at an end.

    Each of the rest gives or takes the same share of the mass whichever way it moves, so that its expectation stays;
    the shares go with size and variance, and a move ends where the first of all would leave [0, 1]. If this
    is the last bucket and the mass of what follows lets held reach one end only, that is where it goes: any other draw
    would miss the source's target.
    """
    last &= len(rest) > 1
    for step in range(len(rest) + 1):
        rest = rest[(p[rest] > 0.0) & (p[rest] < 1.0)]
        if not len(rest) or not 0.0 < p[held] < 1.0:
            return
        share = w[rest] * p[rest] * (1.0 - p[rest])
        total = float(share.sum())
        up = min(w[held] * (1.0 - p[held]), total / float((1.0 - p[rest]).max()))
        down = min(w[held] * p[held], total / float(p[rest].max()))
        lone = w[held] * (1.0 - p[held]) <= float((w[rest] * p[rest]).sum()), w[held] * p[held] <= float((w[rest] * (1.0 - p[rest])).sum())
        if last and lone[0] != lone[1]:
            move = up if lone[0] else -down
        else:
            move = up if _draw(seed, keys[held], f"{keys[rest[0]]}\x1f{step}") * (up + down) < down else -down
        p[held] = _snap(p[held] + move / w[held])
        p[rest] = _snap(p[rest] - move * share / total / w[rest])


def pair_up(keys: list[str], sizes: np.ndarray, p: np.ndarray, seed: int, last: bool = False) -> np.ndarray:
    """The fractions p after pairing in the given order, larger documents first: all 0.0 or 1.0 but one at most.

    Mass is size times fraction; what one of a pair loses the other gains. Where all that follows is too small to
    bring the document that is held to an end by chance (its variance is below the document's own), the partner is
    all that follows at once, so that large documents of small sources are settled too. last: no bucket of the source
    comes after this one.
    """
    p, w = np.array(p, np.float64), np.asarray(sizes, np.float64)
    order = np.flatnonzero((p > 0.0) & (p < 1.0))
    follows = lambda x: np.cumsum(x[::-1])[::-1]
    spread = follows((w * w * p * (1.0 - p))[order])
    held = -1
    for at, i in enumerate(order.tolist()):
        if not 0.0 < p[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        pooled = spread[at] < w[held] ** 2 * p[held] * (1.0 - p[held])
        _settle(keys, w, p, held, order[at:] if pooled else order[at : at + 1], seed, last)
        if pooled:
            spread[at:] = follows((w * w * p * (1.0 - p))[order[at:]])
        if not 0.0 < p[held] < 1.0:
            held = i if 0.0 < p[i] < 1.0 else -1
    return p


def rounded(units: DataFrame, seed: int = 1, bucket: int = BUCKET) -> DataFrame:
    """units (key, source, size, p), keys unique in a source and p in [0, 1), as (key, source, size, p) with p 0.0 or 1.0.

    A source's sum of size times p moves by less than its last document: that one isn't drawn but rounded to the
    nearer end, as nothing is left to balance it. Large documents come first in a bucket, so that those left over are
    small ones as a rule. In the last bucket of a source, a document too large for the rest to balance isn't drawn
    either. The result depends on the units and the seed alone, not on how rows are dealt.
    """
    spark = units.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by source and bucket; a bucket may span batches."""
        rows: list[tuple] = []
        before = None

        def closed() -> pa.RecordBatch:
            p = pair_up([r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), seed, rows[0][4])
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array(p, pa.float64())], ["key", "source", "size", "p"])

        for batch in batches:
            for key, size, p, source, at, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (source, at, last) != before:
                    yield closed()
                    rows = []
                before = (source, at, last)
                rows.append((key, size, p, source, last))
        if rows:
            yield closed()

    sure = (F.col("p") == 0.0) | (F.col("p") == 1.0) | (F.col("size") <= 0)
    left, done = units.where(~sure), units.where(sure).withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(0.0))
    for level in range(64):
        n = left.groupBy("source").agg(F.count("*").alias("n"))
        counted = left.join(n, left["source"].eqNullSafe(n["source"]), "left").drop(n["source"])
        buckets = F.ceil(F.col("n") / bucket)
        dealt = counted.select("key", "size", "p", "source", F.pmod(F.xxhash64("key", F.lit(seed + level)), buckets).alias("bucket"), (buckets == 1).alias("last"))
        sorted_ = dealt.repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.col("size").desc(), "key")
        result = written(sorted_.mapInArrow(run, _OUT), "mix-level")
        open_ = (F.col("p") > 0.0) & (F.col("p") < 1.0)
        done, left = done.unionByName(result.where(~open_)), result.where(open_)
        most = left.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return done.unionByName(left.withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)))
    raise RuntimeError("pairing didn't end")


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, *, seed: int = 1, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, digest, size, source_size, target, n_rows, total): by distinct document, the copies that the mix takes.

    A document is (id, source, text), its size the number of words. Rows that repeat it are n_rows; ``total`` copies
    are taken of all of them together, ``most`` at most of each. A null text is empty, and of it nothing is taken; a null
    id or source is a value of its own. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = documents.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), text.alias("text"))
    measured = base.select("id", "source", F.sha2("text", 256).alias("digest"), F.size(F.array_remove(F.split("text", SPACE), "")).cast("long").alias("size"))
    units = written(measured.groupBy("id", "source", "digest", "size").agg(F.count("*").alias("n_rows")), "mix-units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"))
    goal = written(targets(sources, weights, share, most), "mix-targets").withColumnRenamed("source", "_source")
    # No broadcast is asked for: sources may be many. A hot source's rows join one row, and are split by the planner.
    aimed = units.join(goal, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("n_rows")).otherwise(0.0)
    key = F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id").isNull().cast("string"), "digest")
    aimed = aimed.withColumn("copies", copies).withColumn("base", F.floor(F.col("copies") + NEAR)).withColumn("key", key)
    fraction = F.greatest(F.col("copies") - F.col("base"), F.lit(0.0))
    parts = rounded(aimed.select("key", "source", "size", F.when(fraction > NEAR, fraction).otherwise(0.0).alias("p")), seed, bucket)
    more = parts.select(F.col("key").alias("_key"), F.col("source").alias("_source"), F.col("p").cast("long").alias("more"))
    both = aimed.join(more, (F.col("key") == F.col("_key")) & F.col("source").eqNullSafe(F.col("_source")))
    return both.select("id", "source", "digest", "size", "source_size", "target", "n_rows", F.when(F.col("size") > 0, F.col("base") + F.col("more")).otherwise(0).cast("long").alias("total"))


def by_row(plan: DataFrame) -> DataFrame:
    """The plan of mix with a row for each row of the documents and ``copies``, which differ by one at most among equal rows."""
    runs = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1, F.lit(RUN).cast("long"))).alias("_from"))
    # A document that is repeated very often is dealt out by its runs.
    runs = runs.repartition("id", "digest", "_from")
    each = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + RUN, F.col("n_rows")) - 1))
    rows = runs.select("*", each.alias("_row"))
    low = F.floor(F.col("total") / F.col("n_rows"))
    return rows.withColumn("copies", low + (F.col("_row") < F.pmod("total", "n_rows")).cast("long")).drop("_from", "_row", "total", "n_rows")


def mixed(documents: DataFrame, plan: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of documents, each document as often as the plan takes it.

    Equal documents are one, with the other columns of any of its rows. Columns keep their names.
    """
    one = F.struct(*documents.columns)
    keyed = documents.groupBy(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_digest")).agg(F.first(one).alias("_row"))
    wanted = plan.where("total > 0").select(F.col("id").alias("_p_id"), F.col("source").alias("_p_source"), F.col("digest").alias("_p_digest"), F.col("total").alias("_total"))
    same = F.col("_id").eqNullSafe(F.col("_p_id")) & F.col("_source").eqNullSafe(F.col("_p_source")) & (F.col("_digest") == F.col("_p_digest"))
    return keyed.join(wanted, same).select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_total")).alias("_copy")).select("_row.*")


def op13_pivotal_mix(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, with its source's size and target."""
    rows = by_row(mix(read(spark, sf_dir, "documents")))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
