"""Models as Parquet tables with a small JSON of metadata; merging and updating stored models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.counts import Model, Spec
from tallyframe.operators.sketch import MixedModel, Part, Sketch, SketchModel, dense_bytes
from tallyframe.operators.tables import Tables
from tallyframe.operators.windows import HotWindow, WindowedModel


def save(model: Model, path: str) -> None:
    """Counts are partitioned by table, so that a lookup of one feature reads one partition.

    A model of exact counts also has its tables as they are looked up, with their sizes, so that a transform of the
    loaded model aggregates nothing. Backing noise is added or left out by the reader: such a model has counts only.
    """
    if isinstance(model, MixedModel):
        return save_mixed(model, path)
    spark = model.counts.sparkSession
    within = "w" if isinstance(model, SketchModel) else "key"
    model.counts.repartition("table_id", F.pmod(F.xxhash64(within), F.lit(16))).write.mode("overwrite").partitionBy("table_id").parquet(f"{path}/counts")
    model.labels.write.mode("overwrite").parquet(f"{path}/labels")
    meta = {"feature_count": model.spec.feature_count, "labels": model.spec.labels, "combinations": model.spec.combinations, "b": model.b}
    if isinstance(model, SketchModel):
        meta |= {"sketch": [model.sketch.epsilon, model.sketch.delta, model.sketch.kind], "seed": model.seed, "draws": model.draws}
    elif "noise" not in model.counts.columns:
        tables = Tables.write(Model(model.spec, _counts(spark, path), model.labels).wide(), len(model.spec.tables), len(model.spec.labels), f"{path}/tables")
        meta["tables"] = {"schema": tables.schema, "sizes": list(tables.sizes.items())}
    _save_meta(spark, meta, path)


def _counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/counts").withColumn("table_id", F.col("table_id").cast("int"))


def save_mixed(model: MixedModel, path: str) -> None:
    """The counts or cells of each part, and what the parts are."""
    for i, (p, held) in enumerate(model.parts):
        held.repartition("table_id", F.pmod(F.xxhash64("w" if p.sketch else "key"), F.lit(16))).write.mode("overwrite").partitionBy("table_id").parquet(f"{path}/parts/{i}")
    model.labels.write.mode("overwrite").parquet(f"{path}/labels")
    parts = [{"tables": p.tables, "sketch": p.sketch and [p.sketch.epsilon, p.sketch.delta, p.sketch.kind], "b": p.b, "schema": held.drop("table_id").schema.simpleString()} for p, held in model.parts]
    meta = {"feature_count": model.spec.feature_count, "labels": model.spec.labels, "combinations": model.spec.combinations, "parts": parts, "seed": model.seed, "draws": model.draws, "backing": model.backing}
    _save_meta(model.labels.sparkSession, meta, path)


def _load_mixed(spark: SparkSession, path: str, spec: Spec, meta: dict) -> MixedModel:
    parts = []
    for i, m in enumerate(meta["parts"]):
        part = Part(tuple(m["tables"]), Sketch(*m["sketch"]) if m["sketch"] else None, m["b"])
        columns = m["schema"].removeprefix("struct<").removesuffix(">").replace(":", " ")
        parts.append((part, spark.read.schema(f"{columns}, table_id int").parquet(f"{path}/parts/{i}")))
    return MixedModel(spec, parts, spark.read.parquet(f"{path}/labels"), seed=meta["seed"], draws=meta["draws"], backing=meta["backing"])


def load(spark: SparkSession, path: str) -> Model:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    if "window_size" in meta:
        raise ValueError(f"the model at {path} has windows")
    spec = Spec(meta["feature_count"], tuple(meta["labels"]), tuple(map(tuple, meta["combinations"])))
    if "parts" in meta:
        return _load_mixed(spark, path, spec, meta)
    b = tuple(meta["b"]) if isinstance(meta["b"], list) else meta["b"]
    counts, labels = _counts(spark, path), spark.read.parquet(f"{path}/labels")
    if "sketch" in meta:
        return SketchModel(spec, Sketch(*meta["sketch"]), counts, labels, b, meta["seed"], meta["draws"])
    model = Model(spec, counts, labels, b)
    if "tables" in meta:
        model.use(Tables(spark, f"{path}/tables", meta["tables"]["schema"], {t: tuple(n) for t, n in meta["tables"]["sizes"]}))
    return model


def update(model: Model, observations: DataFrame) -> Model:
    """The model with further observations, as of after a transform with the old one."""
    if isinstance(model, MixedModel):
        more = MixedModel.fit(observations, model.spec, [p for p, _ in model.parts], seed=model.seed, draws=model.draws, backing=True)
        return model.merge(MixedModel(model.spec, more.parts, more.labels, seed=model.seed, draws=model.draws, backing=model.backing))
    if isinstance(model, SketchModel):
        return model.merge(SketchModel.fit(observations, model.spec, model.sketch, b=model.b, seed=model.seed, draws=model.draws))
    return model.merge(Model.fit(observations, model.spec))


def dump_sketch(cells: DataFrame, table_id: int, depth: int, width: int, epsilon: float, delta: float) -> DataFrame:
    """A sketch as one row of bytes for each of its rows: big-endian doubles, the first row led by epsilon and delta."""
    own = cells.where(F.col("table_id") == table_id).groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("m"))
    return dense_bytes(own, depth, width, epsilon, delta)


def _save_meta(spark: SparkSession, meta: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def save_windowed(model: WindowedModel, path: str, **more) -> None:
    """Counts are partitioned by table, within it sorted by window, so that a range of windows skips row groups."""
    spec = model.spec
    model.by_window.repartition("table_id", F.pmod(F.xxhash64("window_id", "key"), F.lit(16))).sortWithinPartitions("table_id", "window_id").write.mode("overwrite").partitionBy("table_id").parquet(f"{path}/counts")
    model.labels_by_window.write.mode("overwrite").parquet(f"{path}/labels")
    meta = {"feature_count": spec.feature_count, "labels": spec.labels, "combinations": spec.combinations, "window_size": model.size}
    _save_meta(model.by_window.sparkSession, meta | more, path)


def _load_windowed(spark: SparkSession, path: str) -> tuple[WindowedModel, dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    if "window_size" not in meta:
        raise ValueError(f"the model at {path} has no windows")
    spec = Spec(meta["feature_count"], tuple(meta["labels"]), tuple(map(tuple, meta["combinations"])))
    counts = spark.read.schema("window_id bigint, key string, label double, cnt double, table_id int").parquet(f"{path}/counts")
    labels = spark.read.parquet(f"{path}/labels")
    return WindowedModel(spec, counts.select("window_id", "table_id", "key", "label", "cnt"), labels, meta["window_size"]), meta


def load_windowed(spark: SparkSession, path: str) -> WindowedModel:
    return _load_windowed(spark, path)[0]


def save_hot(hot: HotWindow, path: str) -> None:
    """The tables by window and the points that are held."""
    hot.points.write.mode("overwrite").parquet(f"{path}/points")
    save_windowed(hot.tables, path, hot={"n": hot.n, "hot_window_size": hot.hot_window_size, "keep": hot.keep, "first": hot.first, "b": hot.b})


def load_hot(spark: SparkSession, path: str, seed: int = 0) -> HotWindow:
    """seed: of further noise; it is secret and isn't stored."""
    tables, meta = _load_windowed(spark, path)
    return HotWindow(tables.spec, tables, spark.read.parquet(f"{path}/points"), seed=seed, **meta["hot"])
