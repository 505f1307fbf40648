"""Commands with a JSON configuration: ``python -m tallyframe.cli <config>``, whose ``command`` is one of COMMANDS."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import config as C
from tallyframe.functions import scalar as S
from tallyframe.operators import noise as N
from tallyframe.operators import sketch as K
from tallyframe.operators import storage
from tallyframe.operators import windows as W
from tallyframe.operators.counts import Blocks, Criteria, Model, Spec
from tallyframe.prepare import features as P
from tallyframe.privacy import sensitivity as D
from tallyframe.sources import sinks, text


def _bounds(spark: SparkSession, path: str | None) -> dict[int, list[float]]:
    return text.percentiles(text.lines(spark, path)) if path else {}


def observations(spark: SparkSession, path: str, feature_count: int, percentiles: str | None) -> DataFrame:
    """Dense lines as observations; row_id follows the order within the files."""
    parsed = text.parse_dense(text.lines(spark, path), feature_count, _bounds(spark, percentiles))
    return parsed.select(F.monotonically_increasing_id().alias("row_id"), "label", "weight", F.transform("features", lambda x: x.cast("string")).alias("features"), "raw")


def _kind(conf: dict) -> K.Sketch | None:
    """A table's sketch by its configuration; None for exact counts."""
    if conf["type"] in ("exact", "precise"):
        return None
    return K.Sketch(conf["epsilon"], conf["delta"], {"unbiased_cms": "count_median"}.get(conf["type"], conf["type"]))


def _parts(kinds: list[K.Sketch | None], scales: list[float]) -> list[K.Part]:
    """Tables of equal kind and noise scale together."""
    found: dict[tuple, list[int]] = {}
    for t, key in enumerate(zip(kinds, scales, strict=True)):
        found.setdefault(key, []).append(t)
    return [K.Part(tuple(ts), sketch, b) for (sketch, b), ts in found.items()]


def build(spark: SparkSession, conf: C.Registry) -> Model | W.WindowedModel:
    combos = [*conf.option("featureCombinations", "int_seq_seq"), *conf.option("dependentFeatures", "int_seq_seq")]
    spec = Spec(conf.get("featureCount", "int"), tuple(conf.get("labels", "double_seq")), tuple(map(tuple, combos)))
    rows = observations(spark, conf.get("countDataFile", "string"), spec.feature_count, conf.option("percentilesFile", "string"))
    b, n = conf.option("noiseLaplaceB", "double"), len(spec.tables)
    weights = [conf.option("tableSpecificNumberOfQueries", "double_seq"), *[C.numbers(spark, conf.option(t, "json")) for t in ("dpNoiseShareWeights", "featureImportanceWeights")]]
    scales = [b * m for m in N.multipliers(*weights, tables=n)] if any(weights) else [b] * n
    kinds = conf.option("perFeatureCountTableConfig", "json_seq") or [conf.get("countTableConfig", "json")] * n
    seed, draws, backing = conf.option("noiseSeed", "int"), conf.option("sumNNoiseDraws", "int"), conf.option("isBackingNoise", "boolean")
    if seed is None and any(scales):
        raise ValueError("noiseSeed is required with noise, and must be secret for privacy")
    seed = seed or 0
    weighted = conf.option("useWeights", "boolean")
    path = conf.get("countTableFile", "string")
    sketches = [_kind(k) for k in kinds]
    if conf.option("windowSize", "int"):
        if any(scales) or any(sketches) or weighted:
            raise ValueError("windowed models have exact counts, without noise or weights")
        windowed = W.WindowedModel.fit(W.with_ordinal(rows, "row_id"), spec, conf.option("windowSize", "int"))
        storage.save_windowed(windowed, path)
        return windowed
    if all(k is not None and k == sketches[0] for k in sketches) and not backing:
        # One kind of sketch for all tables: the cells are the model.
        model = K.SketchModel.fit(rows, spec, sketches[0], use_weights=weighted, b=tuple(scales), seed=seed, draws=draws)
    elif not any(sketches) and not any(scales):
        model = Model.fit(rows, spec, use_weights=weighted)
    else:
        model = K.MixedModel.fit(rows, spec, _parts(sketches, scales), use_weights=weighted, seed=seed, draws=draws, backing=backing)
    storage.save(model, path)
    return model


def _blocks(conf: C.Registry) -> tuple[Blocks, Criteria]:
    blocks = Blocks(conf.option("featurizeWithProbabilities", "boolean"), conf.option("featurizeWithCounts", "boolean"), conf.option("featurizeWithTotalCounts", "boolean"), conf.option("removeFirstLabel", "boolean"))
    return blocks, Criteria(conf.option("defaultProbabilityTotalCriterion", "boolean"), conf.option("defaultProbabilityVarianceCriterion", "boolean"), conf.option("defaultProbabilityMultiple", "double"))


def _write_lines(done: DataFrame, spec: Spec, blocks: Blocks, conf: C.Registry) -> DataFrame:
    """Lines of all blocks that done has, those of the own window last."""
    tables, shown = len(spec.tables), len(spec.labels) - blocks.remove_first_label
    sizes = {"probabilities": tables * shown, "counts": tables * shown, "totals": tables}
    sizes |= {f"window_{c}": n for c, n in sizes.items()}
    line = sinks.vw_texts(F.col("label"), [(F.col(c), sizes[c]) for c in sizes if c in done.columns])
    if conf.option("keepOriginalFeatures", "boolean"):
        line = sinks.keep_original(line, F.col("raw"), conf.option("originalFeaturesToKeep", "int_seq"))
    out = done.select(line.alias("value"))
    sinks.write_text(out, conf.get("outDataFile", "string"))
    return out


def transform(spark: SparkSession, conf: C.Registry) -> DataFrame:
    blocks, criteria = _blocks(conf)
    rows = observations(spark, conf.get("transformDataFilePath", "string"), conf.get("featureCount", "int"), conf.option("percentilesFile", "string"))
    if conf.option("windowSize", "int"):
        windowed = storage.load_windowed(spark, conf.get("countTableFile", "string"))
        if windowed.size != conf.option("windowSize", "int"):
            raise ValueError(f"the model's windows are of {windowed.size}")
        if conf.option("updateCountFile", "string"):
            raise ValueError("windowed models aren't updated by a transform")
        points = W.with_ordinal(rows, "row_id").withColumn("window_id", W.window_of("ordinal", windowed.size))
        return _write_lines(windowed.texts(points, blocks, criteria, conf.option("decimalDigits", "int")), windowed.spec, blocks, conf)
    model = storage.load(spark, conf.get("countTableFile", "string"))
    if isinstance(model, K.MixedModel) and model.backing:
        model = model.with_noise(conf.option("addBackingTableNoise", "boolean"))
    out = _write_lines(model.texts(rows, blocks, criteria, conf.option("decimalDigits", "int")), model.spec, blocks, conf)
    if conf.option("updateCountFile", "string"):
        storage.save(storage.update(model, rows), conf.option("updateCountFile", "string"))
    return out


def build_hot(spark: SparkSession, conf: C.Registry) -> W.HotWindow:
    """The hot window after all lines of a file, in their order, stored with the points that it holds."""
    spec = Spec(conf.get("featureCount", "int"), tuple(conf.get("labels", "double_seq")), tuple(map(tuple, conf.get("featureCombinations", "int_seq_seq"))))
    rows = observations(spark, conf.get("countDataFile", "string"), spec.feature_count, conf.option("percentilesFile", "string"))
    b, seed = conf.option("windowNoiseLaplaceB", "double"), conf.option("noiseSeed", "int")
    if seed is None and b:
        raise ValueError("noiseSeed is required with noise, and must be secret for privacy")
    sizes = {"hot_window_size": conf.get("hotWindowSize", "int"), "count_table_size": conf.get("countTableSize", "int"), "keep": conf.option("countTableCount", "int")}
    hot = W.HotWindow.start(W.with_ordinal(rows, "row_id"), spec, b=b, seed=seed or 0, **sizes)
    storage.save_hot(hot, conf.get("countTableFile", "string"))
    return hot


def transform_hot(spark: SparkSession, conf: C.Registry) -> DataFrame:
    """The lines of a file over all tables that the hot window keeps; or (without transformDataFilePath) the points held, over its frozen ones."""
    blocks, criteria = _blocks(conf)
    hot = storage.load_hot(spark, conf.get("countTableFile", "string"))
    path = conf.option("transformDataFilePath", "string")
    points = hot.points if path is None else observations(spark, path, conf.get("featureCount", "int"), conf.option("percentilesFile", "string"))
    model = hot.merged(include_current=path is not None)
    return _write_lines(model.texts(points, blocks, criteria, conf.option("decimalDigits", "int")), hot.spec, blocks, conf)


def discretize(spark: SparkSession, conf: C.Registry) -> DataFrame:
    by_feature = _bounds(spark, conf.get("percentilesFile", "string"))
    parsed = text.parse_strings(text.lines(spark, conf.get("dataFile", "string")), conf.get("featureCount", "int"), by_feature)
    out = parsed.select(sinks.discretized_line(F.col("label"), F.col("features")).alias("value"))
    sinks.write_text(out, conf.get("outDataFile", "string"), compressed=False)
    return out


def compute_noise_weights(spark: SparkSession, conf: C.Registry) -> DataFrame:
    """Weights by the totals of the lines in the model's tables; of a windowed model in those over all windows."""
    path = conf.get("countTableFile", "string")
    model = storage.load_windowed(spark, path).full if conf.option("windowSize", "int") else storage.load(spark, path)
    rows = observations(spark, conf.get("transformDataFilePath", "string"), conf.get("featureCount", "int"), conf.option("percentilesFile", "string"))
    totals = model.transform(rows, Blocks(probabilities=False, totals=True)).select("row_id", "totals")
    groups = D.groups_for(totals.count(), conf.option("multiGroups", "boolean"))
    found = D.noise_weights(totals, conf.get("percentile", "double"), conf.get("epsilonDP", "double"), groups=groups)
    sinks.write_text(found.orderBy("group").select(F.col("weights").alias("value")), conf.get("outDataFile", "string"))
    return found


def prepare(spark: SparkSession, conf: C.Registry) -> None:
    """Dense lines of tab-separated records, and the percentile file of a sample of them; either may be left out."""
    rows = text.criteo(spark, conf.get("dataFile", "string"), conf.get("featureCount", "int"))
    if conf.option("outDataFile", "string"):
        label = F.when(F.col("label") == 1.0, "1").otherwise("-1")
        sinks.write_text(rows.select(F.concat(label, F.lit(" |f "), F.array_join("features", " ")).alias("value")), conf.get("outDataFile", "string"))
    if conf.option("percentilesFile", "string"):
        lines = P.percentile_lines(rows, conf.get("percentileCount", "int"), fraction=conf.get("sampleFraction", "double"), seed=conf.get("sampleSeed", "int"))
        sinks.write_text(lines, conf.get("percentilesFile", "string"), compressed=False)


def prepare_ratings(spark: SparkSession, conf: C.Registry) -> None:
    """Ratings and movies as lines in three forms, dealt to ten outputs by time or at random."""
    ratings, movies = text.ratings(spark, conf.get("ratingsFile", "string")), text.movies(spark, conf.get("moviesFile", "string"))
    shares = conf.get("countProportion", "double"), conf.get("trainProportion", "double")
    if conf.option("randomSampling", "boolean"):
        key = F.pmod(F.xxhash64("userId", "movieId", "timestamp"), F.lit(S.PRIME))
        split = P.split_by_hash(ratings.withColumn("_k", key), "_k", *shares, seed=conf.get("sampleSeed", "int")).drop("_k")
    else:
        split = P.split_by_time(ratings, "timestamp", *shares)
    lines = P.rating_lines(split, movies, P.genre_universe(movies), conf.get("labelType", "string"))
    sinks.write_fan_out(lines, P.rating_routes(), conf.get("outDataFile", "string"))


def prepare_labels(spark: SparkSession, conf: C.Registry) -> None:
    sinks.write_text(P.prepare_label_file(text.lines(spark, conf.get("dataFile", "string"))), conf.get("outDataFile", "string"))


COMMANDS = {
    "build": (C.build_config, build),
    "transform": (C.transform_config, transform),
    "discretize": (C.discretize_config, discretize),
    "computeNoiseWeights": (C.noise_weights_config, compute_noise_weights),
    "buildHotWindow": (C.hot_build_config, build_hot),
    "transformHotWindow": (C.hot_transform_config, transform_hot),
    "prepare": (C.prepare_config, prepare),
    "prepareRatings": (C.prepare_ratings_config, prepare_ratings),
    "prepareLabels": (C.prepare_labels_config, prepare_labels),
}


def run(spark: SparkSession, config: str):
    """Runs the command of a configuration (its text)."""
    command = C.lenient_json(config).get("command")
    if command not in COMMANDS:
        raise ValueError(f"unknown command {command!r}")
    declare, execute = COMMANDS[command]
    return execute(spark, declare().parse(config))


def main(args: list[str]) -> None:
    spark = SparkSession.builder.appName("tallyframe").getOrCreate()
    run(spark, C.read_text(spark, args[0]))


if __name__ == "__main__":
    main(sys.argv[1:])
