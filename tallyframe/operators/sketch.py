"""Sketches of counts: count-min, count-median and the signed count sketch, as sparse cells.

A table of a sketch has depth * width cells at most, whatever the number of keys; cells are the result of an ordinary
aggregate, whose map-side part reduces each task's rows to that bound before they are moved.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scalar as S
from tallyframe.operators import noise as N
from tallyframe.operators.counts import Model, Spec, exact_counts, exploded, key_of, label_counts, merge
from tallyframe.operators.tables import Tables

#: Cells that are broadcast at most (8 bytes each), a sketch's as one array; larger sketches are joined by cells.
BROADCAST_CELLS = 1 << 20


@dataclass(frozen=True)
class Sketch:
    """kind: "cms" (minimum), "count_median" (upper median) or "count_sketch" (upper median of signed cells)."""

    epsilon: float
    delta: float
    kind: str = "cms"

    def __post_init__(self):
        if not self.epsilon > 0 or not self.delta > 0:
            raise ValueError("epsilon and delta must be positive")
        if self.kind not in ("cms", "count_median", "count_sketch"):
            raise ValueError(f"unknown sketch {self.kind}")

    @property
    def width(self) -> int:
        return math.ceil(math.e / self.epsilon)

    @property
    def depth(self) -> int:
        return max(1, math.ceil(math.log(1 / self.delta)))

    def cell(self, k: Column, d: int) -> Column:
        return F.pmod(S.spread(k, *S.coefficients(d)), F.lit(self.width))

    def sign(self, k: Column, d: int) -> Column:
        if self.kind != "count_sketch":
            return F.lit(1.0)
        return F.when(F.pmod(S.spread(k, *S.coefficients(d + 1000)), F.lit(2)) == 0, 1.0).otherwise(-1.0)

    def places(self, k: Column) -> Column:
        return F.array(*[F.struct(F.lit(d).alias("d"), self.cell(k, d).alias("w"), self.sign(k, d).alias("sign")) for d in range(self.depth)])

    def build(self, rows: DataFrame) -> DataFrame:
        """rows (table_id, k, cnt), k an integer below 2 ** 31; returns cells (table_id, d, w, s)."""
        once = rows.groupBy("table_id", "k").agg(F.sum("cnt").alias("cnt"))
        placed = once.select("table_id", "cnt", F.inline(self.places(F.col("k"))))
        return placed.groupBy("table_id", "d", "w").agg(F.sum(F.col("sign") * F.col("cnt")).alias("s"))

    def query(self, keys: DataFrame, cells: DataFrame, tables: int = 1, noise: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        """keys (table_id, k) with ``estimate``, never below 0. noise: added to each cell, of its d and w (and table_id).

        Sketches of BROADCAST_CELLS together are an array each, in which a key's cells are read by their places, without
        an exchange of keys; larger ones are joined cell by cell.
        """
        if tables * self.depth * self.width <= BROADCAST_CELLS:
            return self._by_place(keys, cells, noise)
        once = keys.select("table_id", "k").distinct()
        placed = once.select("table_id", "k", F.inline(self.places(F.col("k"))))
        found = placed.join(cells, ["table_id", "d", "w"], "left")
        value = F.coalesce("s", F.lit(0.0)) + (noise(F.col("d"), F.col("w")) if noise is not None else F.lit(0.0))
        if self.kind == "cms":
            estimate = F.min(value)
        else:
            estimate = F.get(F.sort_array(F.collect_list(F.col("sign") * value)), F.lit(self.depth // 2))
        of = found.groupBy("table_id", "k").agg(estimate.alias("e")).select("table_id", "k", F.when(F.col("e") > 0, F.col("e")).otherwise(0.0).alias("estimate"))
        return keys.join(of, ["table_id", "k"], "left")

    def packed(self, cells: DataFrame) -> DataFrame:
        """(table_id, cells: array of depth times width numbers), for sketches that fit in memory."""
        width, size = self.width, self.depth * self.width

        def pack(f: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros(size)
            out[(f["d"] * width + f["w"]).to_numpy(np.int64)] = f["s"]
            return pd.DataFrame({"table_id": f["table_id"].iloc[:1], "cells": [out]})

        return cells.select("table_id", F.col("d").cast("int"), F.col("w").cast("long"), F.col("s").cast("double")).groupBy("table_id").applyInPandas(pack, "table_id int, cells array<double>")

    def _by_place(self, keys: DataFrame, cells: DataFrame, noise: Callable[[Column, Column], Column] | None) -> DataFrame:
        packed = self.packed(cells).select(F.col("table_id").alias("_table"), F.col("cells").alias("_cells"))
        values = []
        for d in range(self.depth):
            w = self.cell(F.col("k"), d)
            value = F.coalesce(F.get("_cells", (F.lit(d * self.width) + w).cast("int")), F.lit(0.0))
            values.append(self.sign(F.col("k"), d) * (value if noise is None else value + noise(F.lit(d), w)))
        if self.kind == "cms":
            estimate = F.array_min(F.array(*values))
        else:
            estimate = F.get(F.sort_array(F.array(*values)), F.lit(self.depth // 2))
        found = keys.join(F.broadcast(packed), F.col("table_id") == F.col("_table"), "left").withColumn("_e", estimate)
        return found.select(*keys.columns, F.when(F.col("_e") > 0, F.col("_e")).otherwise(0.0).alias("estimate"))


def merge_cells(*cells: DataFrame) -> DataFrame:
    """Cells of sketches of the same kind and size add up."""
    out = cells[0]
    for c in cells[1:]:
        out = out.unionByName(c)
    return out.groupBy("table_id", "d", "w").agg(F.sum("s").alias("s"))


def cell_values(cells: DataFrame, table_id: int, places: DataFrame) -> DataFrame:
    """places (d, w) with ``value``, the raw cell; 0.0 where nothing was added."""
    own = cells.where(F.col("table_id") == table_id).select("d", "w", F.col("s").alias("value"))
    return places.join(own, ["d", "w"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def add_to_cells(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Cells with changes (table_id, d, w, s) added directly."""
    return merge_cells(cells, changes.select("table_id", "d", "w", "s"))


class SketchModel(Model):
    """A model whose tables are sketches: cells are all that it keeps, whatever the number of keys.

    A lookup computes the cells of the keys that are asked for, so keys that were never seen have the estimate of
    their cells. Noise of scale ``b`` by table is a function of the cell, and is in cells that nothing was added to
    as well. Models merge by their cells.
    """

    def __init__(self, spec: Spec, sketch: Sketch, cells: DataFrame, labels: DataFrame, b: float | tuple[float, ...] = 0.0, seed: int = 1, draws: int = 1):
        super().__init__(spec, cells, labels, b)
        self.sketch, self.cells, self.seed, self.draws = sketch, cells, seed, draws
        self.tables: tuple[int, ...] | None = None

    @staticmethod
    def cell_key(key: Column, label: Column) -> Column:
        return S.string_key(F.concat_ws("|", key, label.cast("int").cast("string")))

    @classmethod
    def fit(cls, observations: DataFrame, spec: Spec, sketch: Sketch, *, use_weights: bool = False, tables: tuple[int, ...] | None = None, **noise) -> SketchModel:
        """Keys are never a table of their own: tasks add them up before cells are made of them. tables: only these have cells."""
        rows = exploded(observations, spec, use_weights, tables=tables)
        rows = rows.select("table_id", cls.cell_key(F.col("key"), F.col("label")).alias("k"), F.col("w").alias("cnt"))
        out = cls(spec, sketch, sketch.build(rows), label_counts(observations, use_weights=use_weights), **noise)
        out.tables = tables
        return out

    def keys(self) -> dict[int, Column]:
        return {t: k for t, k in super().keys().items() if self.tables is None or t in self.tables}

    def merge(self, other: Model) -> SketchModel:
        if not isinstance(other, SketchModel) or (self.spec, self.sketch, self.seed, self.draws, self.b) != (other.spec, other.sketch, other.seed, other.draws, other.b):
            raise ValueError("models of different tables, sketches or noise don't merge")
        labels = self.labels.unionByName(other.labels).groupBy("label").agg(F.sum("cnt").alias("cnt"))
        return SketchModel(self.spec, self.sketch, merge_cells(self.cells, other.cells), labels, self.b, self.seed, self.draws)

    def estimates(self, keys: DataFrame) -> DataFrame:
        """(table_id, key, label, cnt) of the given distinct keys (table_id, key) for each declared label."""
        asked = keys.select("table_id", "key", F.explode(F.array(*[F.lit(v) for v in self.spec.labels])).alias("label"))
        asked = asked.withColumn("k", self.cell_key(F.col("key"), F.col("label")))
        kinds: list[tuple[Column, float]] = []
        for b in sorted({self.scale(t) for t in range(len(self.spec.tables))} - {0.0}):
            own = F.col("table_id").isin([t for t in range(len(self.spec.tables)) if self.scale(t) == b])
            kinds.append((own, b))

        def noise(d: Column, w: Column) -> Column:
            out = F.when(F.lit(False), F.lit(0.0))
            for own, b in kinds:
                out = out.when(own, N.noise(N.cell_key("table_id", d, w), b, seed=self.seed, draws=self.draws))
            return out.otherwise(0.0)

        found = self.sketch.query(asked, self.cells, len(self.spec.tables), noise if kinds else None)
        return found.select("table_id", "key", "label", F.col("estimate").alias("cnt"))

    def asked(self, points: DataFrame) -> DataFrame:
        """Estimates of the keys that the points ask for, of all tables by one scan of them."""
        entries = F.array(*[F.struct(F.lit(t).alias("table_id"), key.alias("key")) for t, key in self.keys().items()])
        found = self.estimates(points.select(F.inline(entries)).distinct())
        return found.groupBy("table_id", "key").agg(F.array(*[F.max(F.when(F.col("label") == v, F.col("cnt"))) for v in self.spec.labels]).alias("c"))

    def prepared(self, points: DataFrame) -> Tables:
        return Tables.write(self.asked(points), len(self.spec.tables), len(self.spec.labels))

    def count_for(self, points: DataFrame, indices: tuple[int, ...], label: float) -> DataFrame:
        if tuple(indices) not in self.spec.tables or label not in self.spec.labels:
            return points.withColumn("cnt", F.lit(0.0))
        key = key_of(tuple(indices))
        asked = points.select(F.lit(self.spec.tables.index(tuple(indices))).alias("table_id"), key.alias("key")).distinct()
        found = self.estimates(asked).where(F.col("label") == label).select(F.col("key").alias("_key"), "cnt")
        return points.join(found, key == F.col("_key"), "left").drop("_key")


@dataclass(frozen=True)
class Part:
    """Tables of one kind (None: exact) and noise scale."""

    tables: tuple[int, ...]
    sketch: Sketch | None
    b: float


class MixedModel(Model):
    """A model whose tables are of several kinds: each part has the exact counts or the cells of its own tables.

    No part keeps the keys of sketched tables. With backing noise nothing stored is noisy: noise is a function of the
    seed and of the key or cell, and is added where ``noisy`` says so.
    """

    def __init__(self, spec: Spec, parts: list[tuple[Part, DataFrame]], labels: DataFrame, *, seed: int = 1, draws: int = 1, backing: bool = False, noisy: bool = True):
        scale = {t: p.b for p, _ in parts for t in p.tables}
        super().__init__(spec, labels, labels, tuple(scale[t] for t in range(len(spec.tables))))
        self.parts, self.seed, self.draws, self.backing, self.noisy = parts, seed, draws, backing, noisy

    @classmethod
    def fit(cls, observations: DataFrame, spec: Spec, parts: list[Part], *, use_weights: bool = False, seed: int = 1, draws: int = 1, backing: bool = False) -> MixedModel:
        """parts: each table is in one of them."""
        if sorted(t for p in parts for t in p.tables) != list(range(len(spec.tables))):
            raise ValueError("each table belongs to one part")
        held = []
        for p in parts:
            if p.sketch is None:
                own = exact_counts(observations, spec, use_weights=use_weights, tables=p.tables)
                held.append((p, own if backing else N.noisy(own, p.b, seed=seed, draws=draws)))
            else:
                held.append((p, SketchModel.fit(observations, spec, p.sketch, use_weights=use_weights, tables=p.tables).cells))
        return cls(spec, held, label_counts(observations, use_weights=use_weights), seed=seed, draws=draws, backing=backing)

    def with_noise(self, add: bool) -> MixedModel:
        """The model with its backing noise added, or without."""
        if not self.backing:
            raise ValueError("this model has no backing noise")
        return MixedModel(self.spec, self.parts, self.labels, seed=self.seed, draws=self.draws, backing=True, noisy=add)

    def merge(self, other: Model) -> MixedModel:
        mine = lambda m: (m.spec, [p for p, _ in m.parts], m.seed, m.draws, m.backing)
        if not isinstance(other, MixedModel) or mine(self) != mine(other):
            raise ValueError("models of different tables, kinds or noise don't merge")
        both = [(p, merge(a, b) if p.sketch is None else merge_cells(a, b)) for (p, a), (_, b) in zip(self.parts, other.parts, strict=True)]
        return MixedModel(self.spec, both, merge(self.labels, other.labels), seed=self.seed, draws=self.draws, backing=self.backing, noisy=self.noisy)

    def asked(self, points: DataFrame) -> DataFrame:
        out = None
        for p, held in self.parts:
            add = self.noisy and p.b > 0
            if p.sketch is None:
                counts = N.noisy(held, p.b, seed=self.seed, draws=self.draws) if self.backing and add else held
                own = Model(self.spec, counts, self.labels).asked(points)
            else:
                model = SketchModel(self.spec, p.sketch, held, self.labels, p.b if add else 0.0, self.seed, self.draws)
                model.tables = p.tables
                own = model.asked(points)
            own = own.select("table_id", "key", "c")
            out = own if out is None else out.unionByName(own)
        return out

    def prepared(self, points: DataFrame) -> Tables:
        return Tables.write(self.asked(points), len(self.spec.tables), len(self.spec.labels))

    def count_for(self, points: DataFrame, indices: tuple[int, ...], label: float) -> DataFrame:
        if tuple(indices) not in self.spec.tables or label not in self.spec.labels:
            return points.withColumn("cnt", F.lit(0.0))
        t = self.spec.tables.index(tuple(indices))
        own = self.asked(points).where(F.col("table_id") == t).select(F.col("key").alias("_key"), F.get("c", F.lit(self.spec.labels.index(label))).alias("cnt"))
        return points.join(own, key_of(tuple(indices)) == F.col("_key"), "left").drop("_key").withColumn("cnt", F.coalesce("cnt", F.lit(0.0)))


def dense_bytes(rows: DataFrame, depth: int, width: int, epsilon: float, delta: float) -> DataFrame:
    """Rows (d, m: map of w to s) as (d, bytes)."""

    @F.pandas_udf("binary")
    def pack(d: pd.Series, m: pd.Series) -> pd.Series:
        def one(i: int, cells: dict) -> bytes:
            cells = dict(cells)
            head = struct.pack(">2d", epsilon, delta) if i == 0 else b""
            return head + struct.pack(f">{width}d", *[cells.get(w, 0.0) for w in range(width)])

        return pd.Series([one(i, c) for i, c in zip(d, m, strict=True)])

    return rows.select("d", pack("d", "m").alias("bytes"))
