"""Private quantiles: smooth sensitivity, sample-and-aggregate, and the exponential mechanism.

Groups of up to LARGE_GROUP values are handled whole, spread over tasks; if there is a larger one, all go by ranges
(``privacy/ranges.py``), with equal results. Random numbers come from seeds, so a task run again agrees.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import scalar as S
from tallyframe.privacy import ranges as R

#: Values of a group that one task sorts at most.
LARGE_GROUP = 100_000


def smooth_sensitivity_slow(x: np.ndarray, q: float, low: float, high: float, beta: float) -> float:
    """Of the q-quantile of sorted x in [low, high], by definition; quadratic. q = 1 counts as the last value."""
    n = len(x)
    if n <= 2:
        raise ValueError("more than two values are needed")
    at = min(int(n * q), n - 1)
    value = lambda i: low if i < 0 else high if i >= n else x[i]
    return max(math.exp(-k * beta) * max(value(at + t) - value(at + t - k - 1) for t in range(k + 2)) for k in range(n + 1))


def smooth_sensitivity(x: np.ndarray, q: float, low: float, high: float, beta: float) -> float:
    """The same in O(n log n): the best right end doesn't move left as the left end moves right."""
    if len(x) <= 2:
        raise ValueError("more than two values are needed")
    z = np.concatenate(([low], x, [high]))
    at = min(int((len(z) - 2) * q + 1), len(z) - 2)
    return R.best_pair(z[: at + 1], np.arange(at + 1.0), z[at:], np.arange(at, len(z), dtype=float), beta)


def quantile_sensitivity(rows: DataFrame, value: str, q: float, low: float, high: float, beta: float, *, by: tuple[str, ...], fast: bool = True) -> DataFrame:
    """(by..., n, quantile, sensitivity) of each group of more than two values; values are clamped to [low, high]."""
    fn = smooth_sensitivity if fast else smooth_sensitivity_slow
    clean = rows.where(F.col(value).isNotNull()).select(*by, S.clamp(F.col(value).cast("double"), low, high).alias("z"))
    if fast and R.has_large(clean, by, LARGE_GROUP):
        return R.sensitivity_by_range(clean, by, q, low, high, beta)
    groups = clean.groupBy(*by).agg(F.sort_array(F.collect_list("z")).alias("x")).where("size(x) > 2")

    @F.pandas_udf("double")
    def sensitivity(x: pd.Series) -> pd.Series:
        return x.map(lambda v: fn(np.asarray(v, float), q, low, high, beta))

    place = F.least(F.floor(F.size("x") * q), F.size("x") - 1).cast("int")
    return groups.select(*by, F.size("x").cast("long").alias("n"), F.get("x", place).alias("quantile"), sensitivity("x").alias("sensitivity"))


def add_noise(value: Column, sensitivity: Column, epsilon: float, u: Column) -> Column:
    """value + Cauchy noise of scale 6 / epsilon times the sensitivity."""
    return value + S.cauchy(u, 1.0) * (6.0 / epsilon) * sensitivity


def private_quantile(rows: DataFrame, value: str, alpha: float, bound: float, epsilon: float, *, by: tuple[str, ...], u: float, inside: float) -> DataFrame:
    """(by..., k, estimate) by the exponential mechanism over the gaps between values clamped to [0, bound].

    Gap i of k values weighs its length times exp(-epsilon |i - alpha k|); u picks a gap, ``inside`` a place in it.
    """
    if not 0 < alpha < 1 or not epsilon > 0:
        raise ValueError("alpha must be in (0, 1) and epsilon positive")
    clean = rows.where(F.col(value).isNotNull()).select(*by, S.clamp(F.col(value).cast("double"), 0.0, bound).alias("z"))
    if R.has_large(clean, by, LARGE_GROUP):
        return R.mechanism_by_range(clean, by, alpha, bound, epsilon, u, inside)
    sizes = clean.groupBy(*by).agg(F.count("*").alias("k")).where("k > 1")
    ends = sizes.select(*by, F.explode(F.array(F.struct(F.lit(-1).alias("o"), F.lit(0.0).alias("z")), F.struct(F.lit(1).alias("o"), F.lit(float(bound)).alias("z")))).alias("e")).select(*by, "e.o", "e.z")
    z = clean.select(*by, F.lit(0).alias("o"), "z").unionByName(ends).join(sizes, list(by))
    w = Window.partitionBy(*by).orderBy("o", "z")
    z = z.withColumn("i", F.row_number().over(w) - 1).withColumn("next", F.lead("z").over(w)).where("next is not null")
    z = z.withColumn("weight", (F.col("next") - F.col("z")) * F.exp(-epsilon * F.abs(F.col("i") - alpha * F.col("k"))))
    z = z.withColumn("upto", F.sum("weight").over(Window.partitionBy(*by).orderBy("i"))).withColumn("whole", F.sum("weight").over(Window.partitionBy(*by)))
    chosen = z.where(F.col("upto") > u * F.col("whole")).groupBy(*by).agg(F.min(F.struct("i", "z", "next", "k")).alias("c"))
    return chosen.select(*by, F.col("c.k").alias("k"), (F.col("c.z") + inside * (F.col("c.next") - F.col("c.z"))).alias("estimate"))


def samples(rows: DataFrame, id_col: str, count: int, size: int, *, seed: int = 1, most: int | None = None) -> DataFrame:
    """rows with ``sample``: ``count`` samples of ``size`` rows without replacement within a sample.

    With ``most``, no row is in more samples than that: rows are ranked once by hash and dealt round, which bounds
    appearances by construction instead of drawing again.
    """
    ranked = rows.withColumn("_h", S.draw_key(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed)))))
    n = rows.count()
    if most is not None and count * size > most * n:
        raise ValueError("the samples need more rows than the cap allows")
    if most is None:
        drawn = rows.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        w = Window.partitionBy("sample").orderBy(F.xxhash64(id_col, F.lit(seed), "sample"), id_col)
        return drawn.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_r")
    from tallyframe.operators.windows import with_ordinal

    places = with_ordinal(ranked, "_h", "_o")
    # Place p of the endless deal p = o, o + n, ... belongs to sample p div size.
    turns = F.sequence(F.lit(0), F.lit(most - 1))
    dealt = places.withColumn("_t", F.explode(turns)).withColumn("sample", F.floor((F.col("_o") + F.col("_t") * n) / size).cast("int"))
    return dealt.where(F.col("sample") < count).drop("_h", "_o", "_t")


def samples_with_replacement(rows: DataFrame, id_col: str, count: int, size: int, *, seed: int = 1) -> DataFrame:
    """rows with ``sample`` and ``draw``: ``count`` samples of ``size`` draws, each of any row; none of an empty table."""
    from tallyframe.operators.windows import with_ordinal

    places = with_ordinal(rows.withColumn("_h", F.xxhash64(id_col, F.lit(seed))), "_h", "_o").drop("_h")
    n = rows.count()
    draws = rows.sparkSession.range(count * size).select(F.floor(F.col("id") / size).cast("int").alias("sample"), F.pmod("id", F.lit(size)).cast("int").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n, 1))).alias("_o"))
    return places.join(draws, "_o").drop("_o")


def partition_ways(rows: DataFrame, id_col: str, m: int, *, seed: int = 1) -> DataFrame:
    """rows with ``part``: a random partition in m parts of equal size (give or take one)."""
    from tallyframe.operators.windows import with_ordinal

    return with_ordinal(rows.withColumn("_h", F.xxhash64(id_col, F.lit(seed))), "_h", "_o").withColumn("part", F.pmod("_o", F.lit(m)).cast("int")).drop("_h", "_o")


#: Draws of a group that are counted together; rounds of drawing until an error.
DRAW_BLOCK = 4096
ROUNDS = 40
#: Rows or draws of a task on average.
TASK_ROWS = 1 << 18


def _tasks(rows: int) -> int:
    return min(1 << 13, math.ceil(rows / TASK_ROWS) or 1)


def capped_groups(rows: DataFrame, id_col: str, groups: int, size: int, most: int, *, seed: int = 1) -> DataFrame:
    """rows with ``group``: random groups of exactly ``size`` different rows, a row in ``most`` of them at most.

    Each group draws rows evenly; draws it has already, and those over a row's cap, are drawn again in further rounds.
    Groups may share rows. With a cap of one the groups are a random partition of a part of the rows.
    """
    from tallyframe.operators.windows import with_ordinal

    spark = rows.sparkSession
    # What is written is read several times; tasks are as many as the rows ask for, however few partitions a shuffle has.
    held_rows = R.written(rows, "rows")
    n = held_rows.count()
    places = R.written(with_ordinal(held_rows.withColumn("_h", F.xxhash64(id_col, F.lit(seed))), "_h", "_o", min(1 << 11, _tasks(n))).drop("_h"), "places")
    if size > n or groups * size > most * n:
        raise ValueError("the groups need more rows than the cap allows")
    if most <= 1:
        return places.withColumn("group", F.floor(F.col("_o") / max(1, size)).cast("int")).where(F.col("group") < groups).drop("_o")
    held, full = None, 0
    need = dict.fromkeys(range(groups), size)
    for turn in range(ROUNDS):
        # As many draws as should hit what is needed among the rows that are still open to the group, and some more.
        draws_of = lambda k: int(1.25 * k * n / max(1, n - (size - k) - full)) + 16
        wanted = spark.createDataFrame([(g, k, draws_of(k)) for g, k in need.items() if k], "g int, need long, draws long")
        draws = wanted.select("g", "need", F.explode(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1, F.lit(DRAW_BLOCK).cast("long"))).alias("from"), "draws")
        tasks = _tasks(sum(draws_of(k) for k in need.values() if k))
        draws = draws.repartition(tasks, "g", "from").select("g", "need", F.explode(F.sequence("from", F.least(F.col("from") + DRAW_BLOCK, "draws") - 1)).alias("i"))
        drawn = draws.withColumn("o", F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "g", "i"), F.lit(n)))
        fresh = drawn.repartition(tasks, "o").groupBy("g", "o").agg(F.min("i").alias("i"), F.max("need").alias("need"))
        if held is not None:
            used = held.groupBy("o").agg(F.count("*").alias("used"))
            fresh = fresh.join(held, ["g", "o"], "left_anti").join(used, "o", "left").na.fill(0, ["used"])
        else:
            fresh = fresh.withColumn("used", F.lit(0))
        # A row's draws are at most one for each group.
        open_ = fresh.withColumn("r", F.row_number().over(Window.partitionBy("o").orderBy("i", "g"))).where(F.col("r") + F.col("used") <= most)
        block = open_.withColumn("block", F.floor(F.col("i") / DRAW_BLOCK))
        sizes = block.groupBy("g", "block").agg(F.count("*").alias("n"))
        before = sizes.select(F.col("g").alias("_g"), F.col("block").alias("_b"), (F.sum("n").over(Window.partitionBy("g").orderBy("block")) - F.col("n")).alias("before"))
        inside = block.repartition(tasks, "g", "block").withColumn("r", F.row_number().over(Window.partitionBy("g", "block").orderBy("i")))
        # Blocks of draws are few rows until they are exploded; by their size the planner would broadcast the draws.
        first = inside.join(before.hint("merge"), (F.col("g") == F.col("_g")) & (F.col("block") == F.col("_b"))).where(F.col("before") + F.col("r") <= F.col("need"))
        taken = first.select("g", "o")
        held = R.written(taken if held is None else held.unionByName(taken), "groups")
        have = {r["g"]: r["n"] for r in held.groupBy("g").agg(F.count("*").alias("n")).collect()}  # a row for each group
        need = {g: size - have.get(g, 0) for g in range(groups)}
        full = held.groupBy("o").agg(F.count("*").alias("n")).where(F.col("n") >= most).count()
        if not any(need.values()):
            return places.repartition(_tasks(n), "_o").join(held.repartition(_tasks(n), "o"), F.col("_o") == F.col("o")).withColumn("group", F.col("g")).drop("_o", "o", "g")
    raise ValueError("the groups could not be filled under the cap")


def sample_aggregate(rows: DataFrame, value: str, id_col: str, fn: Callable[[Column], Column], *, count: int, low: float, high: float, epsilon: float, dimensions: int = 1, seed: int = 1) -> DataFrame:
    """One row (median, sensitivity, estimate): fn of random samples, aggregated by their median with smooth noise.

    fn makes an aggregate of the value's column, so that no task holds a sample."""
    n = rows.count()
    drawn = samples(rows.select(id_col, value), id_col, count, n // count, seed=seed, most=max(1, int(math.sqrt(count))))

    results = drawn.groupBy("sample").agg(fn(F.col(value)).cast("double").alias("y")).withColumn("g", F.lit(0))
    beta = epsilon / 6
    found = quantile_sensitivity(results, "y", 0.5, low, high, beta, by=("g",))
    u = S.uniform(F.lit(seed % S.PRIME).cast("bigint"), seed)
    return found.select(F.col("quantile").alias("median"), "sensitivity", (F.col("quantile") + S.cauchy(u) * F.col("sensitivity") / (beta / dimensions)).alias("estimate"))


def t_radius(distances: DataFrame, t: int, worst: float) -> DataFrame:
    """(id, radius) from (id, distance): the distance to the t-th nearest other; ``worst`` where there are t or fewer."""
    w = Window.partitionBy("id").orderBy("distance")
    ranked = distances.withColumn("r", F.row_number().over(w)).groupBy("id").agg(F.max(F.when(F.col("r") == t + 1, F.col("distance"))).alias("radius"))
    return ranked.withColumn("radius", F.coalesce("radius", F.lit(worst)))


def noise_weights(totals: DataFrame, percentile: float, epsilon: float, *, groups: int = 1, bound: float = 1e6, seed: int = 1) -> DataFrame:
    """(group, weights): per group and feature a private quantile of totals, as whole numbers in feature order.

    totals: (row_id, totals array). A group is a random one n-th of the rows, for n groups; groups may share rows, but a
    row is in at most the root of a group's size of them. The privacy budget is divided among the features.
    """
    n_features = totals.select(F.size("totals").alias("n")).limit(1).first()
    if n_features is None:
        return totals.sparkSession.createDataFrame([], "group int, weights string")
    n = n_features["n"]
    if groups == 1:
        dealt = totals.withColumn("group", F.lit(0))
    else:
        count = totals.count()
        groups = min(groups, count)
        size = count // groups
        dealt = capped_groups(totals, "row_id", groups, size, max(1, math.isqrt(size)), seed=seed)
    long = dealt.select("group", F.posexplode("totals").alias("feature", "x"))
    found = quantile_sensitivity(long, "x", percentile, 1.0, bound, epsilon / (6 * n), by=("group", "feature"))
    u = S.uniform(F.pmod(F.col("group") * 1009 + F.col("feature"), F.lit(S.PRIME)).cast("bigint"), seed)
    noisy = S.clamp(add_noise(F.col("quantile"), F.col("sensitivity"), epsilon / n, u), 1.0, bound).cast("long")
    rows = found.select("group", "feature", noisy.alias("w"))
    return rows.groupBy("group").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("feature", "w"))), lambda x: x["w"].cast("string")), " ").alias("weights"))


def groups_for(n: int, multi: bool) -> int:
    """How many groups the noise weights of n rows have."""
    return int(math.log2(n) ** 2) + 1 if multi and n > 1 else 1
