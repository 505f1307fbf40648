"""Laplace noise in count tables, as expressions of a key and a seed.

Noise is a pure function of (seed, key, draw): a task that runs again, or a cell that is looked up but was never
stored, has the same noise. A public seed gives no privacy: pass a secret one for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scalar as S


def noise(k: Column | str, b: float, *, seed: int = 1, draws: int = 1) -> Column:
    """The sum of ``draws`` Laplace draws of scale b for an integer key below 2 ** 31."""
    if b == 0:
        return F.lit(0.0)
    out = S.laplace(S.uniform(k, seed), b)
    for i in range(1, draws):
        out = out + S.laplace(S.uniform(k, seed + 31 * i), b)
    return out


def count_key(table_id: Column | str = "table_id", key: Column | str = "key", label: Column | str = "label") -> Column:
    return S.string_key(F.concat_ws("|", S.col(table_id).cast("string"), S.col(key), S.col(label).cast("int").cast("string")))


def cell_key(table_id: Column | str = "table_id", d: Column | str = "d", w: Column | str = "w") -> Column:
    return F.pmod(S.col(table_id).cast("bigint") * 1000003 + S.col(d) * 500009 + S.col(w), F.lit(S.PRIME))


def noisy(counts: DataFrame, b: float, *, seed: int = 1, draws: int = 1, backing: bool = False) -> DataFrame:
    """Counts with noise for each key that was seen: in ``cnt``, or (backing) beside it in ``noise``."""
    n = noise(count_key(), b, seed=seed, draws=draws)
    return counts.withColumn("noise", n) if backing else counts.withColumn("cnt", F.col("cnt") + n)


def with_backing(counts: DataFrame, add: bool) -> DataFrame:
    """Counts to look up: with the backing noise added, or clean."""
    if "noise" not in counts.columns:
        raise ValueError("these counts have no backing noise")
    return (counts.withColumn("cnt", F.col("cnt") + F.col("noise")) if add else counts).drop("noise")


def multipliers(queries: list[float] | None = None, shares: list[float] | None = None, importances: list[float] | None = None, tables: int | None = None) -> list[float]:
    """By table, what the noise scale is multiplied with so that shares and importances divide one privacy budget.

    w is share / importance (a missing one counts as 1), v = 1 / (1 + w); a table gets the part q v of their sum.
    """
    n = tables or len(queries or shares or importances or [])
    q, s, i = queries or [1.0] * n, shares or [1.0] * n, importances or [1.0] * n
    if not len(q) == len(s) == len(i) == n:
        raise ValueError("one entry per table is needed")
    v = [1 / (1 + a / b) for a, b in zip(s, i, strict=True)]
    whole = sum(a * b for a, b in zip(q, v, strict=True))
    return [whole / (a * b * sum(q)) for a, b in zip(q, v, strict=True)]


def multiplier_table(queries: DataFrame, shares: DataFrame | None = None, importances: DataFrame | None = None) -> DataFrame:
    """(table_id, multiplier): the same of (table_id, value) rows. queries names the tables; a share or importance that is
    missing counts as 1. Zero or negative values are an error."""
    out = queries.select("table_id", F.col("value").alias("q"))
    for name, other in (("s", shares), ("m", importances)):
        if other is None:
            out = out.withColumn(name, F.lit(1.0))
        else:
            own = other.select(F.col("table_id").alias("_t"), F.col("value").cast("double").alias(name))
            out = out.join(own, F.col("table_id") == F.col("_t"), "left").drop("_t").na.fill(1.0, [name])
    ok = (F.col("q") > 0) & (F.col("s") > 0) & (F.col("m") > 0)
    out = out.select("table_id", F.when(ok, F.col("q")).otherwise(F.raise_error(F.lit("weights must be positive"))).alias("q"), (1 / (1 + F.col("s") / F.col("m"))).alias("v"))
    whole = out.agg(F.sum(F.col("q") * F.col("v")).alias("qv"), F.sum("q").alias("all_q"))
    return out.join(F.broadcast(whole)).select("table_id", (F.col("qv") / (F.col("q") * F.col("v") * F.col("all_q"))).alias("multiplier"))  # one row
