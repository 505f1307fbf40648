"""Count windows by arrival: ordinals, tumbling windows, and the merged view of a hot window."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators import noise as N
from tallyframe.operators.counts import SEPARATOR, Blocks, Criteria, Model, Spec, exact_counts, merge


def ranges(rows: DataFrame, order: str, parts: int | None = None) -> tuple[Column, int]:
    """The number of the range that a numeric column's value is in, and how many ranges there are.

    Their ends are fixed by quantiles, so that equal values are in one range, in every job.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile(order, [i / n for i in range(1, n)], 0.001))) if n > 1 else []

    def place(low: int, high: int) -> Column:  # how many cuts lie below, by halving
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(order) <= cuts[mid], place(low, mid)).otherwise(place(mid + 1, high))

    return place(0, len(cuts)), len(cuts) + 1


def with_ordinal(rows: DataFrame, order: str, name: str = "ordinal", parts: int | None = None) -> DataFrame:
    """rows numbered from 0 by a numeric order column (ties by all columns), without a global sort.

    Ranges of the order column are fixed by quantiles; the rows of a range are numbered in it, after the rows of
    the ranges before it, whose sizes are the one thing that is collected (``parts`` numbers). With ``parts`` there are as
    many tasks.
    """
    part, count = ranges(rows, order, parts)
    sizes = {r["_part"]: r["n"] for r in rows.select(part.alias("_part")).groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for i in range(count):
        offsets.append(before)
        before += sizes.get(i, 0)
    of = F.get(F.array(*[F.lit(o).cast("bigint") for o in offsets]), F.col("_part"))
    others = [c for c in rows.columns if c != order]
    w = Window.partitionBy("_part").orderBy(order, *others)
    placed = rows.withColumn("_part", part)
    if parts is not None:
        placed = placed.repartition(count, "_part")
    return placed.withColumn(name, F.row_number().over(w) - 1 + of).drop("_part")


def window_of(ordinal: Column | str, size: int) -> Column:
    if size <= 0:
        raise ValueError("a window's size must be positive")
    return F.floor((F.col(ordinal) if isinstance(ordinal, str) else ordinal) / size)


class OwnWindow(Model):
    """Looks each point (with window_id) up in the counts and priors of its own window; a window never seen has zeros.

    A window is a part of the key, so that all windows of a table are one table.
    """

    def prior_by_window(self) -> DataFrame:
        return self.labels.groupBy(F.col("window_id").alias("_w")).agg(self.prior_shares().alias("prior"))

    def wide(self) -> DataFrame:
        """(table_id, key, c, prior of the window)."""
        sums = super().wide(("window_id",)).join(self.prior_by_window(), F.col("window_id") == F.col("_w"))
        return sums.select("table_id", F.concat_ws(SEPARATOR, F.col("window_id").cast("string"), "key").alias("key"), "c", "prior")

    def keys(self) -> dict[int, Column]:
        return {t: F.concat_ws(SEPARATOR, F.col("window_id").cast("string"), key) for t, key in super().keys().items()}

    def _looked_up(self, points: DataFrame, of_key) -> DataFrame:
        keys, zeros = self.keys(), F.array(*[F.lit(0.0)] * len(self.spec.labels))
        found = self.prepared(points).look_up(points, keys, lambda t: of_key(t, "c", "prior"), self.scale)
        # What a key without counts has: in a window that was seen, and in one that wasn't (one row).
        none, name = self._defaults(self.prior_by_window(), lambda t: of_key(t, zeros, "prior"), "_n", "_w")
        unseen, other = self._defaults(points.sparkSession.range(1), lambda t: of_key(t, zeros, zeros), "_u")
        out = found.join(none, F.col("window_id") == F.col("_w"), "left").join(F.broadcast(unseen))
        return out.select(*points.columns, *[F.coalesce(f"_v{t}", name[t], other[t]).alias(f"v{t}") for t in keys])


class WindowedModel:
    """Counts by tumbling window, and over all. ``size`` is the windows' size where it is known."""

    def __init__(self, spec: Spec, by_window: DataFrame, labels_by_window: DataFrame, size: int | None = None):
        self.spec, self.by_window, self.labels_by_window, self.size = spec, by_window, labels_by_window, size

    @classmethod
    def fit(cls, observations: DataFrame, spec: Spec, size: int | None = None) -> WindowedModel:
        """observations have window_id, or ordinal if size is given."""
        if size is not None:
            observations = observations.withColumn("window_id", window_of("ordinal", size))
        labels = observations.groupBy("window_id", "label").agg(F.count("*").cast("double").alias("cnt"))
        return cls(spec, exact_counts(observations, spec, by=("window_id",)), labels, size)

    def merge(self, other: WindowedModel) -> WindowedModel:
        """Counts of equal windows add up."""
        if (self.spec, self.size) != (other.spec, other.size):
            raise ValueError("models of different tables or windows don't merge")
        return WindowedModel(self.spec, merge(self.by_window, other.by_window), merge(self.labels_by_window, other.labels_by_window), self.size)

    @property
    def full(self) -> Model:
        counts = self.by_window.groupBy("table_id", "key", "label").agg(F.sum("cnt").alias("cnt"))
        return Model(self.spec, counts, self.labels_by_window.groupBy("label").agg(F.sum("cnt").alias("cnt")))

    def window(self, w: int) -> Model:
        """One window's model; a window without observations has zero counts and priors."""
        only = lambda df: df.where(F.col("window_id") == w).drop("window_id")
        return Model(self.spec, only(self.by_window), only(self.labels_by_window))

    @property
    def own(self) -> OwnWindow:
        return OwnWindow(self.spec, self.by_window, self.labels_by_window)

    def own_window_counts(self, points: DataFrame) -> DataFrame:
        """points (with window_id) with ``t0``, ``t1``, ...: their own window's counts of the declared labels."""
        return self.own.lookup(points)

    def transform(self, points: DataFrame, blocks: Blocks = Blocks(), criteria: Criteria = Criteria(), places: int | None = None) -> DataFrame:
        """points (with window_id) with each block's array over all windows, then ``window_`` the block of their own window."""
        return self._both(points, lambda m, rows: m.transform(rows, blocks, criteria, places))

    def texts(self, points: DataFrame, blocks: Blocks = Blocks(), criteria: Criteria = Criteria(), digits: int = 4) -> DataFrame:
        """As transform, with the compact texts of the numbers."""
        return self._both(points, lambda m, rows: m.texts(rows, blocks, criteria, digits))

    def _both(self, points: DataFrame, run) -> DataFrame:
        own = run(self.own, points)
        named = own.withColumnsRenamed({c: f"window_{c}" for c in own.columns if c not in points.columns})
        whole = run(self.full, named)
        blocks = [c for c in whole.columns if c not in named.columns]
        return whole.select(*points.columns, *blocks, *[f"window_{c}" for c in blocks])


#: Views of a block, in which changes are summed up by themselves.
VIEW_BLOCK = 4096


def hot_view_intervals(by_window: DataFrame, keep: int, include_current: bool = False) -> DataFrame:
    """(table_id, key, label, first_view, last_view, cnt): the merged view of hot windows, a row for each time that a sum changes.

    A count enters the view at the window after its own (or its own, with the current one) and leaves it ``keep`` windows
    later; sums run over these changes, by blocks of views, so that neither rows nor groups grow with ``keep``.
    by_window: (window_id, table_id, key, label, cnt).
    """
    first = F.col("window_id") + (0 if include_current else 1)
    ends = F.array(F.struct(first.alias("view"), F.col("cnt").alias("d"), F.lit(1).alias("live")), F.struct((F.col("window_id") + keep + 1).alias("view"), (-F.col("cnt")).alias("d"), F.lit(-1).alias("live")))
    ids = ["table_id", "key", "label"]
    changes = by_window.select(*ids, F.inline(ends)).groupBy(*ids, "view").agg(F.sum("d").alias("d"), F.sum("live").alias("live"))
    changes = changes.withColumn("block", F.floor(F.col("view") / VIEW_BLOCK))
    blocks = changes.groupBy(*ids, "block").agg(F.sum("d").alias("d"), F.sum("live").alias("live"), F.min("view").alias("begins"))
    over = Window.partitionBy(*ids).orderBy("block")
    before = blocks.select(*ids, "block", *[(F.sum(c).over(over) - F.col(c)).alias(f"_{c}") for c in ("d", "live")], F.lead("begins").over(over).alias("_next"))
    inside = Window.partitionBy(*ids, "block").orderBy("view")
    sums = changes.select(*ids, "block", "view", *[F.sum(c).over(inside).alias(c) for c in ("d", "live")], F.lead("view").over(inside).alias("next"))
    same = F.lit(True)
    for c in (*ids, "block"):
        same &= sums[c].eqNullSafe(before[c])
    at = sums.join(before, same).select(*[sums[c] for c in ids], "view", (F.col("d") + F.col("_d")).alias("cnt"), (F.col("live") + F.col("_live")).alias("live"), F.coalesce("next", "_next").alias("next"))
    last = by_window.agg((F.max("window_id") + (0 if include_current else 1)).alias("last"))
    known = at.where("live > 0").join(F.broadcast(last))  # one row
    return known.select(*ids, F.col("view").alias("first_view"), F.least(F.col("next") - 1, "last").alias("last_view"), "cnt").where("first_view <= last_view")


def hot_view(by_window: DataFrame, keep: int, include_current: bool = False) -> DataFrame:
    """By window and key: the sum over the ``keep`` windows before it (and itself), as the hot window merges them.

    A row stands for each window from a key's first one until it has left the view, so the view is a function of
    the window alone. by_window: (window_id, table_id, key, label, cnt).
    """
    spans = hot_view_intervals(by_window, keep, include_current)
    return spans.select(F.explode(F.sequence("first_view", "last_view")).alias("view_id"), "table_id", "key", "label", "cnt")


def hot_model(spec: Spec, observations: DataFrame, *, count_table_size: int, keep: int, n: int | None = None, include_current: bool = False) -> Model:
    """The merged model after ``n`` arrivals (all): the last ``keep`` frozen tables, and on request the current one.

    observations have ``ordinal`` from 0. A table is frozen when count_table_size arrivals are in it.
    """
    n = observations.count() if n is None else n
    current = n // count_table_size
    seen = observations.where(F.col("ordinal") < n).withColumn("window_id", window_of("ordinal", count_table_size))
    part = seen.where((F.col("window_id") >= current - keep) & (F.col("window_id") < current + (1 if include_current else 0)))
    return Model.fit(part, spec)


def hot_points(observations: DataFrame, *, hot_window_size: int, n: int) -> DataFrame:
    """The points that the hot window still holds: trimmed to hot_window_size at each multiple of it."""
    trimmed = n // hot_window_size * hot_window_size
    return observations.where((F.col("ordinal") < n) & (F.col("ordinal") >= trimmed - hot_window_size))


def pop(observations: DataFrame, held: int, count: int) -> DataFrame:
    """What is left of ``held`` queued points (by ordinal) after taking the ``count`` oldest; an error if there are fewer."""
    if count > held:
        raise ValueError(f"{count} points asked for, {held} held")
    return observations.where(F.col("ordinal") >= count)


@dataclass(frozen=True)
class HotWindow:
    """The state of a hot window after ``n`` arrivals: count tables of count_table_size arrivals each, and the points held.

    Only the last ``keep`` frozen tables (None: all) and the current one are kept. Points are queued without a bound
    until n reaches a multiple of hot_window_size, when the queue is trimmed to the last hot_window_size; ``first`` is
    the ordinal of the oldest one held. A table gets Laplace noise of scale b when it is frozen.
    """

    spec: Spec
    tables: WindowedModel
    points: DataFrame
    n: int
    hot_window_size: int
    keep: int | None = None
    first: int = 0
    b: float = 0.0
    seed: int = 0

    @classmethod
    def start(cls, observations: DataFrame, spec: Spec, *, hot_window_size: int, count_table_size: int, keep: int | None = None, b: float = 0.0, seed: int = 0) -> HotWindow:
        """observations (label, features, perhaps weight) have ``ordinal`` from 0."""
        if hot_window_size <= 0:
            raise ValueError("the hot window's size must be positive")
        none = observations.limit(0)
        empty = cls(spec, WindowedModel.fit(none, spec, count_table_size), none, 0, hot_window_size, keep, 0, b, seed)
        return empty.observe(observations)

    @property
    def current(self) -> int:
        """The window that arrivals are counted in now."""
        return self.n // self.tables.size

    @property
    def length(self) -> int:
        """How many points are held."""
        return self.n - self.first

    def observe(self, more: DataFrame) -> HotWindow:
        """The state after further arrivals, whose ``ordinal`` starts from 0 again."""
        columns = [c for c in more.columns if c in self.points.columns]
        rows = more.select(*columns).withColumn("ordinal", F.col("ordinal") + self.n)
        n = self.n + rows.count()
        now, h = n // self.tables.size, self.hot_window_size
        first = max(self.first, n // h * h - h)
        both = self.tables.merge(WindowedModel.fit(rows, self.spec, self.tables.size))
        kept = F.col("window_id") >= (now - self.keep if self.keep is not None else 0)
        counts = both.by_window.where(kept)
        if self.b:
            frozen = (F.col("window_id") >= self.current) & (F.col("window_id") < now)
            of_window = N.count_key(F.concat_ws("|", F.col("window_id").cast("string"), F.col("table_id").cast("string")))
            counts = counts.withColumn("cnt", F.col("cnt") + F.when(frozen, N.noise(of_window, self.b, seed=self.seed)).otherwise(0.0))
        tables = WindowedModel(self.spec, counts, both.labels_by_window.where(kept), self.tables.size)
        points = self.points.unionByName(rows).where(F.col("ordinal") >= first)
        return replace(self, tables=tables, points=points, n=n, first=first)

    def pop(self, count: int) -> tuple[DataFrame, HotWindow]:
        """The oldest ``count`` points, and the state without them; counts stay."""
        if count > self.length:
            raise ValueError(f"{count} points asked for, {self.length} held")
        cut = self.first + count
        return self.points.where(F.col("ordinal") < cut), replace(self, points=self.points.where(F.col("ordinal") >= cut), first=cut)

    def merged(self, include_current: bool = False) -> Model:
        """The last ``keep`` frozen tables as one model, and on request the current one."""
        low = max(0, self.current - self.keep) if self.keep is not None else 0
        seen = F.col("window_id").between(low, self.current - (0 if include_current else 1))
        add = lambda df: df.where(seen).groupBy(*[c for c in df.columns if c not in ("window_id", "cnt")]).agg(F.sum("cnt").alias("cnt"))
        return Model(self.spec, add(self.tables.by_window), add(self.tables.labels_by_window), self.b * math.sqrt(self.current - low))

    def transform(self, points: DataFrame | None = None, blocks: Blocks = Blocks(), criteria: Criteria = Criteria(), include_current: bool | None = None) -> DataFrame:
        """Given points, over all tables with the current one; or (None) the points held, over the frozen ones."""
        current = points is not None if include_current is None else include_current
        return self.merged(current).transform(self.points if points is None else points, blocks, criteria)
