"""Preparing data: equi-depth bounds, splits, one-hot lines and label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import scalar as S
from tallyframe.operators.windows import ranges
from tallyframe.privacy import ranges as R
from tallyframe.sources import sinks


def numeric_histogram(rows: DataFrame, features: str = "features", *, fraction: float | None = None, seed: int = 1) -> DataFrame:
    """(feature, value, cnt) of an array of strings; a feature with any value that is no number is left out."""
    part = rows if fraction is None else rows.sample(fraction, seed)
    long = part.select(F.posexplode(features).alias("feature", "text")).withColumn("value", S.number("text"))
    counted = long.groupBy("feature", "value").agg(F.count("*").alias("cnt"))
    bad = counted.where("value is null").select("feature")
    return counted.join(bad, "feature", "left_anti")


#: Distinct values of a feature that one task sorts at most.
LARGE_FEATURE = 1_000_000


def equi_depth_bounds(histogram: DataFrame, buckets: int) -> DataFrame:
    """(feature, bounds) of (feature, value, cnt): bound i is the first value with over i * (total div buckets) values up
    to it, for i from 1 to buckets - 1; a value may be several bounds. Features of very many values are summed by ranges."""
    counted = R.written(histogram, "histogram")
    if R.has_large(counted, ("feature",), LARGE_FEATURE):
        upto = R.in_ranges(counted, ("feature",), "value")[0].select("feature", F.col("z").alias("value"), "cnt", "upto", F.expr(f"n div {buckets}").alias("step"))
    else:
        w = Window.partitionBy("feature").orderBy("value")
        upto = counted.withColumn("upto", F.sum("cnt").over(w)).withColumn("step", F.expr(f"sum(cnt) over (partition by feature) div {buckets}"))
    # Bounds i with upto - cnt <= i * step < upto.
    before, step = F.col("upto") - F.col("cnt"), F.nullif(F.col("step"), F.lit(0))
    low = F.greatest(F.ceil(before / step), F.lit(1))
    high = F.least(F.ceil(F.col("upto") / step) - 1, F.lit(buckets - 1))
    times = F.when(F.col("step") > 0, high - low + 1).otherwise(F.when(before == 0, buckets - 1).otherwise(0))
    rows = upto.withColumn("times", F.greatest(times, F.lit(0)).cast("int")).where("times > 0")
    return rows.groupBy("feature").agg(F.sort_array(F.flatten(F.collect_list(F.expr("array_repeat(value, times)")))).alias("bounds"))


def medians(rows: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """(by..., n, median) of the values that aren't null; of two middle ones their mean. Values are counted, then summed by ranges."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("cnt"))
    placed, _ = R.in_ranges(counted, by, "v")
    before = F.col("upto") - F.col("cnt")
    holds = lambda place: (before <= place) & (place < F.col("upto"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = placed.where(holds(low) | holds(high)).groupBy(*by).agg(F.max("n").alias("n"), F.min("z").alias("a"), F.max("z").alias("b"))
    return middle.select(*by, "n", ((F.col("a") + F.col("b")) / 2).alias("median"))


def _split(x: Column, first: Column | float, second: Column | float) -> Column:
    return F.when(x < first, "count").when(x < second, "train").otherwise("test")


def split_by_time(rows: DataFrame, time_col: str, count: float, train: float) -> DataFrame:
    """rows with ``split``: those before the time at rank floor(n * count) are for counting, those before the one at
    floor(n * (count + train)) for training, the rest "test". Equal times are in one split; a null time is in "test"."""
    cuts = by_rank(rows, time_col, [count, train + count])
    at = lambda s: F.max(F.when(F.col("share") == s, F.col("value")))
    pair = cuts.agg(at(count).alias("_c0"), at(train + count).alias("_c1"))  # one row
    return rows.join(F.broadcast(pair)).withColumn("split", _split(F.col(time_col), F.col("_c0"), F.col("_c1"))).drop("_c0", "_c1")


def split_by_hash(rows: DataFrame, id_col: str, count: float, train: float, seed: int = 1) -> DataFrame:
    u = S.uniform(F.pmod(F.col(id_col), F.lit(S.PRIME)), seed)
    return rows.withColumn("split", _split(u, count, train + count))


def by_rank(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(n, share, value): of n values that aren't null, in order, the one at place floor(n * share), the last for 1.

    Equal values are counted first and summed up in ranges, so no task holds all values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value")).agg(F.count("*").alias("cnt"))
    # What is before each range: one number for each range is all that a single task sees.
    ranged = counted.withColumn("part", ranges(counted, "value")[0])
    sizes = ranged.groupBy("part").agg(F.sum("cnt").alias("size"))
    edges = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy(F.lit(0))).alias("n"))
    within = F.sum("cnt").over(Window.partitionBy("part").orderBy("value"))
    upto = ranged.withColumn("upto", within).join(F.broadcast(edges), "part").withColumn("upto", F.col("upto") + F.col("before"))
    asked = upto.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    place = F.least(F.floor(F.col("n") * F.col("share")), F.col("n") - 1)
    return asked.where((place < F.col("upto")) & (place >= F.col("upto") - F.col("cnt"))).select("n", "share", "value")


def one_hot(value: Column, universe: list[str]) -> Column:
    """1.0 or 0.0 for each member of the universe; value is an array or a string."""
    return F.array(*[F.when(F.array_contains(value, g), 1.0).otherwise(0.0) for g in universe])


def genre_universe(movies: DataFrame) -> list[str]:
    """All genres, sorted; a closed list of a few dozen."""
    return [r["g"] for r in movies.select(F.explode("genres").alias("g")).distinct().orderBy("g").collect()]


def rating_label(rating: Column, kind: str = "raw") -> Column:
    """The label's text. integer: twice the rating; binary: 1 from 4.0 on, else -1; raw: the rating as it is written."""
    number = rating.cast("double")
    return {"integer": (number * 2).cast("int").cast("string"), "binary": F.when(number >= 4.0, "1").otherwise("-1")}.get(kind, rating.cast("string"))


def rating_lines(ratings: DataFrame, movies: DataFrame, universe: list[str], kind: str = "raw") -> DataFrame:
    """ratings with three lines each, for a movie that isn't known without genres.

    dense: ``<label> |f user-<u> movie-<m>`` and for each genre of the universe its name or ``no-<name>``; cross:
    ``<label> |g movie-<m> user-<u> <genres> |u <u>-movie-<m> <u>-<genre> ...``; rank: ``<label> |m movie-<m> |u user-<u>
    |g <genres>``. A movie's genres come in order.
    """
    genres = F.array_sort(F.array_distinct(F.coalesce("genres", F.array().cast("array<string>"))))
    user, movie = F.col("userId"), F.concat(F.lit("movie-"), F.col("movieId"))
    joined = ratings.join(movies.select("movieId", "genres"), "movieId", "left")
    text, label = F.array_join(genres, " "), rating_label(F.col("rating"), kind)
    each = F.array(*[F.when(F.array_contains(genres, g), g).otherwise(f"no-{g}") for g in universe]) if universe else F.array().cast("array<string>")
    dense = F.concat(label, F.lit(" |f user-"), user, F.lit(" "), movie, F.lit(" "), F.array_join(each, " "))
    crossed = F.array_join(F.transform(genres, lambda g: F.concat(user, F.lit("-"), g)), " ")
    cross = F.concat(label, F.lit(" |g "), movie, F.lit(" user-"), user, F.lit(" "), text, F.lit(" |u "), user, F.lit("-"), movie, F.lit(" "), crossed)
    rank = F.concat(label, F.lit(" |m "), movie, F.lit(" |u user-"), user, F.lit(" |g "), text)
    return joined.select(*ratings.columns, dense.alias("dense"), cross.alias("cross"), rank.alias("rank"))


def rating_routes() -> list[sinks.Route]:
    """The ten outputs of rating lines with ``split``: by line, those for counting, training, testing, and all but testing."""
    split = F.col("split")
    out = []
    for name, line in (("count", "dense"), ("mtr", "cross"), ("rank", "rank")):
        own = {"Train": split == "train", "Test": split == "test", "All": split != "test"} | ({"": split == "count"} if name == "count" else {})
        out += [sinks.Route(f"{name}{k}", condition, F.col(line)) for k, condition in own.items()]
    return out


def percentile_lines(rows: DataFrame, count: int, *, fraction: float | None = None, seed: int = 1) -> DataFrame:
    """(value) a percentile file's lines: equi-depth bounds of each feature that is a number in all sampled rows."""
    bounds = equi_depth_bounds(numeric_histogram(rows, fraction=fraction, seed=seed), count)
    return bounds.orderBy("feature").select(sinks.percentile_line(F.col("feature"), F.col("bounds")).alias("value"))


def name_numeric(line: Column, numeric: int = 14) -> Column:
    """Tokens of a line with ``f<i>:`` before numbers at places below ``numeric`` and before any 0."""
    named = F.transform(F.split(line, " "), lambda t, i: F.when(((i < numeric) & (t.try_cast("float").isNotNull())) | (t == "0"), F.concat(F.lit("f"), i.cast("string"), F.lit(":"), t)).otherwise(t))
    return F.array_join(named, " ")


def prepare_label_file(rows: DataFrame) -> DataFrame:
    """(value) lines with the features after the bar named."""
    return rows.select(F.when(F.instr("value", "|") > 0, F.concat(F.substring_index("value", "|", 1), F.lit("|"), name_numeric(F.expr("substring(value, instr(value, '|') + 1)")))).otherwise(F.col("value")).alias("value"))
