"""Count tables: one keyed aggregate over all tables of a specification, and what is looked up in it.

Observations have ``row_id``, ``label`` (double), ``features`` (array of strings) and optionally ``weight`` (double,
null: 1) and ``window_id``. Counts are long: (table_id, key, label, cnt). All tables are built by one explode and one
shuffle: each task adds its rows up first, so that what is moved is bounded by its distinct keys, never by its rows.
For lookups the tables are written once, a folder each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scalar as S
from tallyframe.operators.tables import Tables

SEPARATOR = "\u001f"


@dataclass(frozen=True)
class Spec:
    """Which count tables there are. Labels are declared in order; combinations are feature positions."""

    feature_count: int
    labels: tuple[float, ...]
    combinations: tuple[tuple[int, ...], ...] = ()

    @property
    def tables(self) -> tuple[tuple[int, ...], ...]:
        """Each feature and each combination once, by size, then by position."""
        for c in self.combinations:
            if any(i < 0 or i >= self.feature_count for i in c):
                raise ValueError(f"combination {c} names a feature beyond {self.feature_count}")
        return tuple(sorted({*((i,) for i in range(self.feature_count)), *map(tuple, self.combinations)}, key=lambda t: (len(t), t)))


def key_of(table: tuple[int, ...], features: str = "features") -> Column:
    """The key of a table: its features, joined by a unit separator; empty for the table of labels alone."""
    return F.concat_ws(SEPARATOR, *[F.get(F.col(features), F.lit(i)) for i in table]) if table else F.lit("")


def exact_counts(observations: DataFrame, spec: Spec, *, use_weights: bool = False, by: tuple[str, ...] = (), tables: tuple[int, ...] | None = None) -> DataFrame:
    """(by..., table_id, key, label, cnt). Weights are ignored unless asked for; a null weight counts 1. tables: only these."""
    return exploded(observations, spec, use_weights, by, tables).groupBy(*by, "table_id", "key", "label").agg(F.sum("w").alias("cnt"))


def exploded(observations: DataFrame, spec: Spec, use_weights: bool, by: tuple[str, ...] = (), tables: tuple[int, ...] | None = None) -> DataFrame:
    """(by..., label, w, table_id, key): a row of each observation for each table."""
    keys = F.array(*[F.struct(F.lit(t).alias("table_id"), key_of(table).alias("key")) for t, table in enumerate(spec.tables) if tables is None or t in tables])
    one = F.coalesce(F.col("weight"), F.lit(1.0)) if use_weights else F.lit(1.0)
    return observations.select(*by, "label", one.alias("w"), F.inline(keys))


def label_counts(observations: DataFrame, *, use_weights: bool = False) -> DataFrame:
    """(label, cnt)."""
    one = F.coalesce(F.col("weight"), F.lit(1.0)) if use_weights else F.lit(1.0)
    return observations.groupBy("label").agg(F.sum(one).alias("cnt"))


def merge(*counts: DataFrame) -> DataFrame:
    """Counts are an additive monoid: the sum of equal keys, whatever key columns there are."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    keys = [c for c in out.columns if c != "cnt"]
    return out.groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


@dataclass(frozen=True)
class Criteria:
    """When a conditional probability gives way to the prior."""

    total: bool = True
    variance: bool = False
    multiple: float = 1.0


@dataclass(frozen=True)
class Blocks:
    """Which values a featurized row has, and whether the first declared label is left out."""

    probabilities: bool = True
    counts: bool = False
    totals: bool = False
    remove_first_label: bool = False


class Model:
    """Count tables with label counts. ``counts`` may hold noise already; ``b`` is its scale, by table or for all."""

    def __init__(self, spec: Spec, counts: DataFrame, labels: DataFrame, b: float | tuple[float, ...] = 0.0):
        self.spec, self.counts, self.labels, self.b = spec, counts, labels, b

    def scale(self, table_id: int) -> float:
        return self.b[table_id] if isinstance(self.b, tuple) else self.b

    @classmethod
    def fit(cls, observations: DataFrame, spec: Spec, *, use_weights: bool = False) -> Model:
        """Labels are counted by themselves: a scan of one column, beside the counts' own."""
        out = cls(spec, exact_counts(observations, spec, use_weights=use_weights), label_counts(observations, use_weights=use_weights))
        out._source = out.counts, lambda: out._sums(exploded(observations, spec, use_weights).withColumnRenamed("w", "cnt"))
        return out

    def merge(self, other: Model) -> Model:
        if self.spec != other.spec:
            raise ValueError("models of different tables don't merge")
        return Model(self.spec, merge(self.counts, other.counts), merge(self.labels, other.labels), self.b)

    def prior_shares(self) -> Column:
        """An aggregate over label counts: the share of each declared label, 0 without any count."""
        total = F.sum("cnt")
        return F.array(*[F.when(total > 0, F.coalesce(F.sum(F.when(F.col("label") == v, F.col("cnt"))), F.lit(0.0)) / total).otherwise(0.0) for v in self.spec.labels])

    def prior_values(self) -> list[float]:
        """The prior of each declared label in their order; labels that aren't declared count in the total.

        One row reaches the driver, once for a model."""
        if getattr(self, "_priors", (None,))[0] is not self.labels:
            self._priors = self.labels, self.labels.agg(self.prior_shares().alias("prior")).first()["prior"]
        return self._priors[1]

    def priors(self) -> dict[float, float]:
        """The prior of each declared label."""
        return dict(zip(self.spec.labels, self.prior_values(), strict=True))

    def wide(self, by: tuple[str, ...] = ()) -> DataFrame:
        """(by..., table_id, key, c: counts of the declared labels in their order), never below 0."""
        if not by and getattr(self, "_source", (None,))[0] is self.counts:  # fitted here: one aggregate instead of two
            return self._source[1]()
        return self._sums(self.counts, by)

    def _sums(self, rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        sums = [F.greatest(F.coalesce(F.sum(F.when(F.col("label") == v, F.col("cnt"))), F.lit(0.0)), F.lit(0.0)) for v in self.spec.labels]
        return rows.groupBy(*by, "table_id", "key").agg(F.array(*sums).alias("c"))

    def prepared(self, points: DataFrame) -> Tables:
        """The tables as they are looked up, written once for a model's counts. points: those that are looked up."""
        if getattr(self, "_prepared", (None,))[0] is not self.counts:
            self.use(Tables.write(self.wide(), len(self.spec.tables), len(self.spec.labels)))
        return self._prepared[1]

    def asked(self, points: DataFrame) -> DataFrame:
        """(table_id, key, c) of all keys that the points can ask for."""
        return self.wide()

    def use(self, tables: Tables) -> None:
        """Looks up in tables that are written already, until counts are replaced."""
        self._prepared = self.counts, tables

    def keys(self) -> dict[int, Column]:
        """The key of a point in each table."""
        return {t: key_of(table) for t, table in enumerate(self.spec.tables)}

    def lookup(self, points: DataFrame) -> DataFrame:
        """points with ``t0``, ``t1``, ...: the counts of each table's key; zeros where it has none."""
        zeros = F.array(*[F.lit(0.0)] * len(self.spec.labels))
        keys = self.keys()
        found = self.prepared(points).look_up(points, keys, lambda t: F.col("c"), lambda t: 0)
        return found.select(*points.columns, *[F.coalesce(f"_v{t}", zeros).alias(f"t{t}") for t in keys])

    def values(self, t: int, blocks: Blocks, criteria: Criteria, counts: str = "c", prior: str = "prior") -> dict[str, Column]:
        """The arrays that the blocks ask for of a key of table t, over its counts and the priors."""
        labels = self.spec.labels
        shown = range(1 if blocks.remove_first_label else 0, len(labels))
        c = [F.get(counts, F.lit(i)) for i in range(len(labels))]
        total = sum(c[1:], c[0]) if c else F.lit(0.0)
        out = {}
        if blocks.probabilities:
            out["probabilities"] = [S.conditional_probability(c[i], total, F.get(prior, F.lit(i)), b=self.scale(t), labels=len(labels), multiple=criteria.multiple, total_criterion=criteria.total, variance_criterion=criteria.variance) for i in shown]
        if blocks.counts:
            out["counts"] = [c[i] for i in shown]
        if blocks.totals:
            out["totals"] = [total]
        if not all(out.values()) or not out:
            raise ValueError("a block without values")
        return {k: F.array(*v) for k, v in out.items()}

    def _looked_up(self, points: DataFrame, of_key) -> DataFrame:
        """points with ``v0``, ``v1``, ...: what ``of_key`` (table, counts, prior to a struct) makes of each table's key.

        It is computed once for each key of the tables, and once for a key that isn't there; a row only joins it.
        """
        zeros, prior = (F.array(*[F.lit(x) for x in v]) for v in ([0.0] * len(self.spec.labels), self.prior_values()))
        keys = self.keys()
        found = self.prepared(points).look_up(points, keys, lambda t: of_key(t, "c", prior), self.scale)
        none, name = self._defaults(points.sparkSession.range(1), lambda t: of_key(t, zeros, prior), "_n")
        return found.join(F.broadcast(none)).select(*points.columns, *[F.coalesce(f"_v{t}", name[t]).alias(f"v{t}") for t in keys])

    def _defaults(self, rows: DataFrame, value, prefix: str, *kept: str) -> tuple[DataFrame, dict[int, str]]:
        """rows with what a key without counts has, a column for each noise scale, and the column of each table."""
        kinds: dict[float, int] = {}
        for t in self.keys():
            kinds.setdefault(self.scale(t), t)
        return rows.select(*kept, *[value(t).alias(f"{prefix}{t}") for t in kinds.values()]), {t: f"{prefix}{kinds[self.scale(t)]}" for t in self.keys()}

    def _arrays(self, points: DataFrame, blocks: Blocks, criteria: Criteria, change=lambda c: c) -> DataFrame:
        def of_key(t: int, counts: Column | str, prior: str) -> Column:
            return F.struct(*[change(v).alias(k) for k, v in self.values(t, blocks, criteria, counts, prior).items()])

        names = [k for k, wanted in (("probabilities", blocks.probabilities), ("counts", blocks.counts), ("totals", blocks.totals)) if wanted]
        if not self.spec.tables or not names or (blocks.remove_first_label and len(self.spec.labels) < 2 and names != ["totals"]):
            raise ValueError("a block without values")
        found = self._looked_up(points, of_key)
        return found.select(*points.columns, *[F.concat(*[F.col(f"v{t}")[k] for t in range(len(self.spec.tables))]).alias(k) for k in names])

    def transform(self, points: DataFrame, blocks: Blocks = Blocks(), criteria: Criteria = Criteria(), places: int | None = None, window: int | None = None) -> DataFrame:
        """points with an array column for each block, in the order probabilities, counts, totals: by table, then by label.

        places: decimals to round to, once for each key. A model without windows refuses to be asked for one."""
        if window is not None:
            raise ValueError("this model has no windows")
        change = (lambda v: v) if places is None else lambda v: F.transform(v, lambda x: F.round(x, places))
        return self._arrays(points, blocks, criteria, change)

    def texts(self, points: DataFrame, blocks: Blocks = Blocks(), criteria: Criteria = Criteria(), digits: int = 4) -> DataFrame:
        """As transform, with the compact texts of the numbers, which are made once for each key."""
        from tallyframe.functions import formats

        return self._arrays(points, blocks, criteria, lambda v: formats.compact_array(v, digits))

    def interleaved(self, points: DataFrame, criteria: Criteria = Criteria(), places: int | None = None) -> DataFrame:
        """points with ``vector``: for each table and label the count, then the probability, rounded for each key to ``places``."""

        def of_key(t: int, counts: Column | str, prior: str) -> Column:
            v = self.values(t, Blocks(counts=True), criteria, counts, prior)
            both = F.flatten(F.zip_with(v["counts"], v["probabilities"], lambda c, p: F.array(c, p)))
            return both if places is None else F.transform(both, lambda x: F.round(x, places))

        found = self._looked_up(points, of_key)
        return found.select(*points.columns, F.concat(*[f"v{t}" for t in range(len(self.spec.tables))]).alias("vector"))

    def count_for(self, points: DataFrame, indices: tuple[int, ...], label: float) -> DataFrame:
        """points with ``cnt`` of one table and label; 0.0 for a table that there isn't."""
        if tuple(indices) not in self.spec.tables:
            return points.withColumn("cnt", F.lit(0.0))
        t = self.spec.tables.index(tuple(indices))
        own = self.counts.where((F.col("table_id") == t) & (F.col("label") == label)).select(F.col("key").alias("_key"), "cnt")
        return points.join(own, key_of(tuple(indices)) == F.col("_key"), "left").drop("_key").withColumn("cnt", F.greatest(F.coalesce("cnt", F.lit(0.0)), F.lit(0.0)))
