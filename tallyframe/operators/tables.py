"""Count tables as they are looked up: a folder for each, its keys dealt by hash and sorted, with measured sizes.

A lookup of many tables costs in proportion to their number: each is read by itself, never taken out of a common
aggregate again. Tables that are small together are broadcast, as their bytes are known; all others share one
exchange, in which rows are distinct combinations of keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of tables that one lookup broadcasts at most, as they are in memory; smallest tables first.
BROADCAST_BYTES = 32 << 20
#: Bytes that a key of a table takes beside its text and counts.
ROW_BYTES = 64
#: Files of a table at most.
FILES = 16


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder in the one that driver and executors share, which spark.checkpoint.dir names.

    One of our own is used only where none is set and all runs in one process; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file:///tmp/tallyframe-checkpoints"
    return f"{found.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Tables:
    """Tables below ``path`` with (key, c, perhaps prior). sizes: of each that has keys, how many and their bytes in memory."""

    spark: SparkSession
    path: str
    schema: str
    sizes: dict[int, tuple[int, int]]

    @classmethod
    def write(cls, rows: DataFrame, tables: int, labels: int, path: str | None = None) -> Tables:
        """rows (table_id, key, c, ...): each key of a table once. They are measured as they are written."""
        spark = rows.sparkSession
        path = path or shared_path(spark, "count-tables")
        bucket = F.pmod(F.xxhash64("key"), F.lit(FILES))
        seen = Observation()
        of = lambda t: F.col("table_id") == t
        sizes = [F.struct(F.count_if(of(t)).alias("n"), F.sum(F.when(of(t), F.octet_length("key"))).alias("text")).alias(f"t{t}") for t in range(tables)]
        if sizes:
            rows = rows.observe(seen, *sizes)
        rows.repartition("table_id", bucket).sortWithinPartitions("table_id", "key").write.mode("overwrite").partitionBy("table_id").parquet(path)
        found = seen.get if sizes else {}
        known = {t: (found[f"t{t}"]["n"], found[f"t{t}"]["text"] + found[f"t{t}"]["n"] * (ROW_BYTES + 16 * labels)) for t in range(tables) if found[f"t{t}"]["n"]}
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "table_id")
        return cls(spark, path, schema, known)

    @cached_property
    def all(self) -> DataFrame:
        """(key, c, ..., table_id): the folders are listed once; a filter on table_id reads the folders that it names."""
        return self.spark.read.schema(f"{self.schema}, table_id int").parquet(self.path)

    def read(self, t: int) -> DataFrame:
        return self.all.where(F.col("table_id") == t)

    def small(self, tables: list[int]) -> list[int]:
        """Which of them are broadcast: the smallest ones, up to the bound together."""
        out, total = [], 0
        for t in sorted(tables, key=lambda t: (self.sizes[t][1], t)):
            total += self.sizes[t][1]
            if total > BROADCAST_BYTES:
                break
            out.append(t)
        return out

    def look_up(self, points: DataFrame, keys: dict[int, Column], value: Callable[[int], Column], same: Callable[[int], object], prefix: str = "_v") -> DataFrame:
        """points with ``<prefix><t>``: the value of each table's key, null where it has none; and further columns.

        keys: of the points, by table. value: of a table, over the columns that tables have; it is made once for each
        key. same: tables of equal ``same`` have the same value expression.
        """
        out = points
        present = [t for t in keys if t in self.sizes]
        small = self.small(present)
        large = [t for t in present if t not in small]
        for t in small:
            own = self.read(t).select(F.col("key").alias(f"_key{t}"), value(t).alias(f"{prefix}{t}"))
            out = out.join(F.broadcast(own), keys[t] == F.col(f"_key{t}"), "left")
        if len(large) == 1:
            own = self.read(large[0]).select(F.col("key").alias("_key"), value(large[0]).alias(f"{prefix}{large[0]}"))
            out = out.join(own, keys[large[0]] == F.col("_key"), "left")
        elif large:
            out = self._together(out, {t: keys[t] for t in large}, value, same, prefix)
        absent = [t for t in keys if t not in self.sizes]
        if absent:
            kind = self.spark.range(0).select(F.lit(None).cast(self._type("c")).alias("c"), F.lit(None).cast("array<double>").alias("prior"))
            nothing = kind.select(*[value(t).alias(f"{prefix}{t}") for t in absent]).schema
            out = out.withColumns({f.name: F.lit(None).cast(f.dataType) for f in nothing.fields})
        return out

    def _type(self, column: str) -> str:
        return dict(c.split(" ", 1) for c in self.schema.split(", "))[column]

    def _together(self, points: DataFrame, keys: dict[int, Column], value, same, prefix: str) -> DataFrame:
        """One join for all tables: on (table, key), of the distinct combinations of keys; points join their combination.

        A combination is known by a digest of its keys, so that nothing depends on how rows are numbered. Hot keys and
        hot combinations are sides of joins, which the planner splits; a group has a row for each table.
        """
        kinds: dict[object, list[int]] = {}
        for t in keys:
            kinds.setdefault(same(t), []).append(t)
        sides = [self.all.where(F.col("table_id").isin(ts)).select("table_id", "key", value(ts[0]).alias("_value")) for ts in kinds.values()]
        values = sides[0]
        for s in sides[1:]:
            values = values.unionByName(s)
        names = {t: f"_k{t}" for t in keys}
        digest = lambda cols: F.md5(F.to_json(F.array(*cols)))
        distinct = points.select(*[k.alias(names[t]) for t, k in keys.items()]).distinct()
        place = {t: i for i, t in enumerate(keys)}
        entries = F.array(*[F.struct(F.lit(i).alias("_at"), F.lit(t).alias("_t"), F.col(names[t]).alias("_key")) for t, i in place.items()])
        asked = distinct.select(digest([F.col(n) for n in names.values()]).alias("_row"), F.inline(entries))
        found = asked.join(values, (F.col("_t") == F.col("table_id")) & (F.col("_key") == F.col("key")), "left").select("_row", "_at", "_value")
        rows = found.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "_value"))).alias("_all"))
        out = points.withColumn("_own", digest(list(keys.values()))).join(rows, F.col("_own") == F.col("_row"), "left")
        return out.withColumns({f"{prefix}{t}": F.get("_all", F.lit(i))["_value"] for t, i in place.items()})
