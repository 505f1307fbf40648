"""Ranks of groups of any size: values are counted, dealt by range, and numbered range by range.

What one task sees of a group is one range, or a row for each of its ranges. Quantiles with smooth sensitivity and by
the exponential mechanism are found from the ranges' summaries; then only the ranges that can hold the answer are opened.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.tables import shared_path

#: Distinct values of a range on average.
PER_RANGE = 100_000


def written(df: DataFrame, kind: str) -> DataFrame:
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _joined(a: DataFrame, b: DataFrame, columns: tuple[str, ...], how: str = "inner") -> DataFrame:
    """a with the other columns of b, on equal columns, where null is a value too."""
    other = b.withColumnsRenamed({c: f"_{c}_" for c in columns})
    on = F.lit(True)
    for c in columns:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}_"))
    return a.join(other, on, how).drop(*[f"_{c}_" for c in columns])


def in_ranges(counted: DataFrame, by: tuple[str, ...], value: str, cnt: str = "cnt", per_range: int | None = None) -> tuple[DataFrame, DataFrame]:
    """counted (by..., value, cnt), each value of a group once, as (rows, ranges).

    rows: with ``part`` (the range) and ``upto``: the sum of cnt up to the value. ranges: (by..., part, first, last,
    before, n, next): smallest and largest value, the sum before the range and in the group, the first value after it.
    Ranges are fixed by writing them, as they are read more than once.
    """
    held = written(counted.select(*by, F.col(value).cast("double").alias("z"), F.col(cnt).alias("cnt")), "values")
    parts = max(1, math.ceil(held.count() / (per_range or PER_RANGE)))
    dealt = written(held.repartitionByRange(parts, *by, "z").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*by, "part").agg(F.sum("cnt").alias("size"), F.min("z").alias("first"), F.max("z").alias("last"))
    over = Window.partitionBy(*by).orderBy("part")  # a row for each range
    edges = sizes.select(*by, "part", "first", "last", (F.sum("size").over(over) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy(*by)).alias("n"), F.lead("first").over(over).alias("next"))
    edges = written(edges, "edges")
    inside = dealt.withColumn("inside", F.sum("cnt").over(Window.partitionBy(*by, "part").orderBy("z")))
    rows = _joined(inside, edges.select(*by, "part", "before", "n", "next"), (*by, "part")).select(*by, "part", "z", "cnt", (F.col("inside") + F.col("before")).alias("upto"), "n", "next")
    return rows, edges


def best_pair(left: np.ndarray, i: np.ndarray, right: np.ndarray, j: np.ndarray, beta: float) -> float:
    """The largest (right - left) * exp(beta * (i - j + 1)) of all pairs; all arrays ascend.

    The best right end doesn't move left as the left end moves right, which halves the search.
    """
    best, stack = 0.0, [(0, len(left) - 1, 0, len(right) - 1)]
    while stack:
        a, b, c, d = stack.pop()
        if a > b:
            continue
        m = (a + b) // 2
        v = (right[c : d + 1] - left[m]) * np.exp(beta * (i[m] - j[c : d + 1] + 1.0))
        k = int(len(v) - 1 - np.argmax(v[::-1]))
        best = max(best, float(v[k]))
        stack += [(a, m - 1, c, c + k), (m + 1, b, c + k, d)]
    return best


def _schema(rows: DataFrame, by: tuple[str, ...], more: str) -> str:
    return ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by], more])


def sensitivity_by_range(clean: DataFrame, by: tuple[str, ...], q: float, low: float, high: float, beta: float, per_range: int | None = None) -> DataFrame:
    """(by..., n, quantile, sensitivity) of (by..., z), z in [low, high], for groups of more than two values."""
    counted = clean.groupBy(*by, "z").agg(F.count("*").alias("cnt"))
    groups = counted.select(*by).distinct()
    ends = groups.select(*by, F.explode(F.array(F.lit(float(low)), F.lit(float(high)))).alias("z"), F.lit(0).cast("long").alias("cnt"))
    counted = counted.unionByName(ends).groupBy(*by, "z").agg(F.sum("cnt").alias("cnt"))
    rows, _ = in_ranges(counted, by, "z", per_range=per_range)
    rows = rows.where("n > 2")
    at = F.least(F.floor(F.col("n") * q + 1), F.col("n"))
    before = F.col("upto") - F.col("cnt")
    # Ties count once: at their last place as a left end, at their first as a right end.
    placed = rows.select(*by, "part", "z", "n", at.alias("at"), F.when(before < at, F.least("upto", at)).alias("i"), F.when(F.col("upto") >= at, F.greatest(before + 1, at)).alias("j"), ((before < at) & (F.col("upto") >= at)).alias("here"))
    placed = written(placed, "placed")
    ends_of = [F.min(F.when(F.col(k).isNotNull(), F.struct("z", k))).alias(f"{k}_low") for k in "ij"] + [F.max(F.when(F.col(k).isNotNull(), F.struct("z", k))).alias(f"{k}_high") for k in "ij"]
    summary = placed.groupBy(*by, "part").agg(*ends_of, F.max("n").alias("n"), F.max(F.when(F.col("here"), F.col("z"))).alias("quantile"))
    flat = summary.select(*by, "part", "n", "quantile", *[F.col(f"{k}_{e}")[c].cast("double").alias(f"{k}_{e}_{c}") for k in "ij" for e in ("low", "high") for c in ("z", k)])

    def candidates(f: pd.DataFrame) -> pd.DataFrame:
        """Pairs of ranges that may hold more than the best pair of the ranges' ends does: by what their ends allow at most."""
        f = f.sort_values("part")
        lefts, rights = f[f.i_low_z.notna()], f[f.j_low_z.notna()]
        ends = lambda x, k: (np.concatenate((x[f"{k}_low_z"], x[f"{k}_high_z"])), np.concatenate((x[f"{k}_low_{k}"], x[f"{k}_high_{k}"])))
        (zl, i), (zr, j) = ends(lefts, "i"), ends(rights, "j")
        floor = max(float(((zr - z) * np.exp(beta * (x - j + 1.0))).max()) for z, x in zip(zl, i, strict=True))
        out = []
        for part, z, x in zip(lefts.part, lefts.i_low_z, lefts.i_high_i, strict=True):
            most = (rights.j_high_z - z) * np.exp(beta * (x - rights.j_low_j + 1.0))
            out += [(part, r) for r in rights.part[most > floor]]
        head = [f[c].iloc[0] for c in by] + [int(f.n.iloc[0]), float(f["quantile"].max()), floor]
        return pd.DataFrame([(*head, a, b) for a, b in out] or [(*head, -1, -1)], columns=[*by, "n", "quantile", "floor", "left", "right"])

    pairs = written(flat.groupBy(*by).applyInPandas(candidates, _schema(placed, by, "n long, quantile double, floor double, left int, right int")), "pairs")

    def opened(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("z", kind="stable")
        a, b = f[f.side == 0], f[f.side == 1]
        v = best_pair(a.z.to_numpy(), a.place.to_numpy(float), b.z.to_numpy(), b.place.to_numpy(float), beta)
        return pd.DataFrame([[*[f[c].iloc[0] for c in by], v]], columns=[*by, "v"])

    sides = []
    for side, (name, place) in enumerate((("left", "i"), ("right", "j"))):
        own = placed.where(F.col(place).isNotNull())
        asked = pairs.select(*by, "left", "right", F.col(name).alias("part"))
        sides.append(_joined(asked, own.select(*by, "part", "z", F.col(place).alias("place")), (*by, "part")).select(*by, "left", "right", F.lit(side).alias("side"), "z", "place"))
    found = sides[0].unionByName(sides[1]).groupBy(*by, "left", "right").applyInPandas(opened, _schema(placed, by, "v double"))
    best = found.groupBy(*by).agg(F.max("v").alias("v"))
    known = pairs.select(*by, "n", "quantile", "floor").distinct()
    return _joined(known, best, by, "left").select(*by, "n", "quantile", F.greatest("floor", "v").alias("sensitivity"))


def mechanism_by_range(clean: DataFrame, by: tuple[str, ...], alpha: float, bound: float, epsilon: float, u: float, inside: float, per_range: int | None = None) -> DataFrame:
    """(by..., k, estimate) of (by..., z), z in [0, bound], for groups of more than one value.

    Only gaps after the last of equal values have a length, so values count once.
    """
    counted = clean.groupBy(*by, "z").agg(F.count("*").alias("cnt"))
    start = counted.select(*by).distinct().select(*by, F.lit(0.0).alias("z"), F.lit(0).cast("long").alias("cnt"))
    counted = counted.unionByName(start).groupBy(*by, "z").agg(F.sum("cnt").alias("cnt"))
    rows, _ = in_ranges(counted, by, "z", per_range=per_range)
    after = F.coalesce(F.lead("z").over(Window.partitionBy(*by, "part").orderBy("z")), "next", F.lit(float(bound)))
    gaps = rows.where("n > 1").withColumn("after", after)
    gaps = written(gaps.select(*by, "part", "z", "after", F.col("upto").alias("i"), F.col("n").alias("k"), ((F.col("after") - F.col("z")) * F.exp(-epsilon * F.abs(F.col("upto") - alpha * F.col("n")))).alias("weight")), "gaps")
    sums = gaps.groupBy(*by, "part").agg(F.sum("weight").alias("w"))
    over = Window.partitionBy(*by).orderBy("part")  # a row for each range
    sums = sums.select(*by, "part", (F.sum("w").over(over) - F.col("w")).alias("before"), F.sum("w").over(over).alias("upto_w"), F.sum("w").over(Window.partitionBy(*by)).alias("whole"))
    chosen = sums.where(F.col("upto_w") > u * F.col("whole")).groupBy(*by).agg(F.min(F.struct("part", "before", "whole")).alias("c")).select(*by, "c.*")
    opened = _joined(gaps, chosen, (*by, "part"))
    reached = F.col("before") + F.sum("weight").over(Window.partitionBy(*by, "part").orderBy("z")) > u * F.col("whole")
    at = F.struct("i", "z", "after", "k")
    # The last gap of the range stands in where sums in another order fall short of its own.
    best = opened.withColumn("reached", reached).groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("reached"), at)), F.max(F.when(F.col("weight") > 0, at))).alias("c"))
    return best.select(*by, F.col("c.k").alias("k"), (F.col("c.z") + inside * (F.col("c.after") - F.col("c.z"))).alias("estimate"))


def has_large(clean: DataFrame, by: tuple[str, ...], most: int) -> bool:
    """Whether a group has more than ``most`` rows."""
    return not clean.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > most).limit(1).isEmpty()
