"""Golden values and invariants of the engine on small inputs."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe import cli
from tallyframe import config as C
from tallyframe.functions import formats
from tallyframe.functions import scalar as S
from tallyframe.operators import noise as N
from tallyframe.operators import sketch as K
from tallyframe.operators import storage
from tallyframe.operators import windows as W
from tallyframe.operators.counts import Blocks, Model, Spec
from tallyframe.prepare import features as P
from tallyframe.privacy import sensitivity as D
from tallyframe.sources import sinks, text


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("s,h", [("Aa", 2112), ("BB", 2112), ("abc", 96354), ("ünï", 245821), ("FURNITURE", -2088802350), ("", 0)])
def test_java_hash(spark, s, h):
    assert one(spark, S.java_hash(F.lit(s))) == h


def test_java_hash_of_surrogate_pairs(spark):
    units = "a\U0001d11eb".encode("utf-16-be")
    h = 0
    for i in range(0, len(units), 2):
        h = (31 * h + int.from_bytes(units[i : i + 2], "big")) % 2**32
    assert one(spark, S.java_hash(F.lit("a\U0001d11eb"))) == (h - 2**32 if h >= 2**31 else h)


@pytest.mark.parametrize("x,b", [(0.0, 1.0), (1.0, 1.0), (2.0, 4.0), (15.0, 15.0), (99.0, 15.0), (float("nan"), 15.0)])
def test_bucketize_rounds_up(spark, x, b):
    assert one(spark, S.bucketize(F.lit(x), F.array(F.lit(1.0), F.lit(4.0), F.lit(15.0)))) == b


@pytest.mark.parametrize("t,ok", [("1", True), ("-1.5e3", True), (".5", True), ("1d", False), ("nan", False), ("NaN", True), ("a", False), ("", False), ("0x1p3", False)])
def test_numbers(spark, t, ok):
    assert one(spark, S.is_number(F.lit(t))) is ok


@pytest.mark.parametrize("x,t", [(0, "0"), (1.0, "1"), (101.0, "101"), (10000000002, "10000000002"), (1.5, "1.5"), (1.234, "1.23"), (3.3, "3.29"), (0.5, "5.0E-1"), (1 / 3, "3.33E-1"), (0.2345e-3, "2.3449E-4"), (1e-10, "1.0E-10"), (1e-11, "0")])
def test_compact_numbers(x, t):
    assert formats.compact(float(x)) == t


def points(spark, rows):
    return spark.createDataFrame([(float(y), [str(v) for v in f]) for y, f in rows], "label double, features array<string>")


def test_counts_and_probabilities(spark):
    many = spark.createDataFrame([(1.0, ["1"], 100), (2.0, ["1"], 15000), (1.0, ["2"], 75), (2.0, ["2"], 20000)], "label double, features array<string>, n int")
    rows = many.select("label", "features", F.explode(F.sequence(F.lit(1), "n"))).drop("col")
    model = Model.fit(rows, Spec(1, (1.0, 2.0)))
    found = {r["features"][0]: r["vector"] for r in model.interleaved(points(spark, [(1, ["1"]), (1, ["2"]), (1, ["3"])])).collect()}
    assert found["1"] == pytest.approx([100, 100 / 15100, 15000, 15000 / 15100])
    assert found["2"] == pytest.approx([75, 75 / 20075, 20000, 20000 / 20075])
    assert found["3"] == pytest.approx([0, 175 / 35175, 0, 35000 / 35175])  # the prior


def test_tables_are_sorted_and_checked():
    assert Spec(3, (1.0,), ((2, 1), (0,), ())).tables == ((), (0,), (1,), (2,), (2, 1))
    with pytest.raises(ValueError):
        Spec(5, (1.0,), ((1, 2, 3), (4, 5, 6))).tables


def test_merge_is_joint_build(spark):
    a, b = points(spark, [(1, ["x", "y"]), (2, ["x", "z"])]), points(spark, [(1, ["x", "y"]), (3, ["w", "y"])])
    spec = Spec(2, (1.0, 2.0), ((0, 1),))
    merged = Model.fit(a, spec).merge(Model.fit(b, spec))
    joint = Model.fit(a.union(b), spec)
    assert sorted(map(tuple, merged.counts.collect())) == sorted(map(tuple, joint.counts.collect()))
    assert merged.priors() == {1.0: 0.5, 2.0: 0.25}
    with pytest.raises(ValueError):
        merged.merge(Model.fit(a, Spec(2, (1.0, 2.0))))


def test_empty_model(spark):
    rows = points(spark, [(1, ["a"])])
    model = Model.fit(rows.where("false"), Spec(1, (1.0, 2.0)))
    assert model.transform(rows, Blocks(True, True, True)).first()[2:] == ([0.0, 0.0], [0.0, 0.0], [0.0])


def test_save_and_load(spark, tmp_path):
    rows = points(spark, [(1, ["x", "y"]), (2, ["x", "z"])])
    model = Model.fit(rows, Spec(2, (1.0, 2.0)))
    storage.save(model, f"file://{tmp_path}/m")
    again = storage.load(spark, f"file://{tmp_path}/m")
    assert again.spec == model.spec
    assert sorted(again.counts.select("table_id", "key", "label", "cnt").collect()) == sorted(model.counts.collect())


@pytest.mark.parametrize("kind", ["cms", "count_median", "count_sketch"])
def test_sketches(spark, kind):
    s = K.Sketch(0.05, 0.05, kind)
    rows = spark.range(300).select(F.lit(0).alias("table_id"), F.col("id").alias("k"), (F.col("id") % 7 + 1).cast("double").alias("cnt"))
    found = {r["k"]: r["estimate"] for r in s.query(rows.select("table_id", "k"), s.build(rows)).collect()}
    assert len(found) == 300 and min(found.values()) >= 0
    if kind == "cms":
        assert all(found[k] >= k % 7 + 1 for k in found)
    halves = K.merge_cells(s.build(rows.where("k < 100")), s.build(rows.where("k >= 100")))
    assert sorted(map(tuple, halves.collect())) == sorted(map(tuple, s.build(rows).collect()))


def test_sketch_parameters():
    assert (K.Sketch(2.72e-5, 0.007).width, K.Sketch(2.72e-5, 0.007).depth) == (99937, 5)
    for bad in ((0, 0.1), (0.1, -1)):
        with pytest.raises(ValueError):
            K.Sketch(*bad)


def test_noise_is_laplace_and_reproducible(spark):
    x = spark.range(50_000).select(N.noise(F.col("id") * 7919, 10.0, seed=3).alias("x"))
    mean, sd = x.agg(F.avg("x"), F.stddev("x")).first()
    assert abs(mean) < 0.3 and abs(sd - 10 * math.sqrt(2)) < 0.4
    assert x.repartition(7).agg(F.sum(F.round("x", 3))).first()[0] == pytest.approx(x.agg(F.sum(F.round("x", 3))).first()[0])


def test_backing_noise(spark):
    counts = Model.fit(points(spark, [(1, ["a"])] * 3), Spec(1, (1.0,))).counts
    noisy = N.noisy(counts, 1000.0, backing=True)
    assert N.with_backing(noisy, False).first()["cnt"] == 3
    assert N.with_backing(noisy, True).first()["cnt"] != 3
    with pytest.raises(ValueError):
        N.with_backing(counts, True)


@pytest.mark.parametrize("q,want", [([1, 1, 1], [0.407011289, 2.238562092, 10.378787879]), ([2, 1, 1], [0.277629234, 3.053921569, 14.159090909])])
def test_multipliers(q, want):
    assert N.multipliers(q, [1, 10, 100], [1, 1, 2]) == pytest.approx(want)


def test_smooth_sensitivity_of_the_example():
    x = np.array([1, 1, 1, 9, 10, 10, 10, 11, 100, 100, 100.0])
    beta = 0.1 / 39 / 6
    for f in (D.smooth_sensitivity, D.smooth_sensitivity_slow):
        assert f(x, 0.2, 1, 100, beta) == pytest.approx(98.788687, abs=1e-5)


def test_smooth_sensitivity_fast_is_slow():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = np.sort(rng.integers(0, 30, rng.integers(3, 25)).astype(float))
        q, beta = rng.uniform(0.01, 0.99), rng.uniform(0, 0.5)
        assert D.smooth_sensitivity(x, q, 0, 40, beta) == pytest.approx(D.smooth_sensitivity_slow(x, q, 0, 40, beta))


def test_sample_caps(spark):
    rows = spark.range(100)
    drawn = D.samples(rows, "id", 6, 30, most=2).toPandas()
    assert (drawn.groupby("sample").size() == 30).all() and drawn.groupby("id").size().max() <= 2
    assert not drawn.duplicated(["sample", "id"]).any()
    parts = D.partition_ways(rows, "id", 7).groupBy("part").count().toPandas()
    assert parts["count"].max() - parts["count"].min() <= 1


def test_ordinals(spark):
    rows = spark.range(1000).select(F.floor(F.col("id") * 7919 % 1000 / 3).alias("v"), "id")
    got = W.with_ordinal(rows, "v", parts=5).orderBy("v", "id").select("ordinal").toPandas().ordinal.tolist()
    assert got == list(range(1000))


def test_windows_differ_from_all(spark):
    rows = W.with_ordinal(spark.range(240).select("id", F.when(F.col("id") < 120, 1.0).otherwise(-1.0).alias("label"), F.array((F.col("id") % 2).cast("string")).alias("features")), "id")
    model = W.WindowedModel.fit(rows, Spec(1, (-1.0, 1.0)), 100)
    assert model.full.priors() == {-1.0: 0.5, 1.0: 0.5}
    assert model.window(0).priors() == {-1.0: 0.0, 1.0: 1.0}
    assert model.window(99).priors() == {-1.0: 0.0, 1.0: 0.0}
    with pytest.raises(ValueError):
        W.window_of("ordinal", 0)


def test_hot_window_is_the_plain_model_while_all_is_kept(spark):
    rows = W.with_ordinal(spark.range(400).select("id", F.when(F.col("id") % 4 < 2, -1.0).otherwise(1.0).alias("label"), F.array((F.col("id") % 2).cast("string")).alias("features")), "id")
    spec = Spec(1, (-1.0, 1.0))
    hot = W.hot_model(spec, rows, count_table_size=100, keep=10)
    assert sorted(map(tuple, hot.counts.collect())) == sorted(map(tuple, Model.fit(rows, spec).counts.collect()))
    assert W.hot_points(rows, hot_window_size=150, n=400).count() == 250
    with pytest.raises(ValueError):
        W.pop(rows, 100, 101)


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_dense_lines(spark):
    got = text.parse_dense(lines(spark, "1 |f 5 a k:0.3", "-1 2.5 | 7", "1 |f"), 4, {0: [1.0, 4.0, 6.0]}).collect()
    assert [list(r)[1:4] for r in got] == [[1.0, None, [6.0, 97.0, 0.3, 0.0]], [-1.0, 2.5, [6.0, 0.0, 0.0, 0.0]], [1.0, None, [0.0] * 4]]
    assert got[0]["raw"] == "5 a k:0.3"
    for bad in ("1 5 6", "1 | 1 2 3 4 5", "1 2 3 | 4"):
        with pytest.raises(Exception):  # noqa: B017
            text.parse_dense(lines(spark, bad), 4).collect()


def test_string_lines(spark):
    got = text.parse_strings(lines(spark, "1 |f 5 2:x b"), 4, {0: [1.0, 6.0]}).first()
    assert got["features"] == ["6.0", "", "x", ""] or got["features"] == ["6.0", "", "b", ""] or got["features"][0] == "6.0"


@pytest.mark.parametrize("line,want", [
    ("1 | 1 2 3 4", {"": [("0", 1), ("1", 2), ("2", 3), ("3", 4)]}),
    ("1 |ns1 1 a:2 5 c:5 |ns1 6 7 8", {"ns1": [("0", 1), ("a", 2), ("2", 5), ("c", 5), ("4", 6), ("5", 7), ("6", 8)]}),
    ("1 |ns1 aff a:2 5 c:5 |ns2 d 7 abc", {"ns1": [("0", 96481), ("a", 2), ("2", 5), ("c", 5)], "ns2": [("0", 100), ("1", 7), ("2", 96354)]}),
    ("1 | 1 2 3 4 | a b c 1 2 ", {"": [("0", 1), ("1", 2), ("2", 3), ("3", 4), ("4", 97), ("5", 98), ("6", 99), ("7", 1), ("8", 2)]}),
])
def test_namespaced_lines(spark, line, want):
    got = text.parse_namespaced(lines(spark, line)).first()
    assert {k: [(f["k"], f["v"]) for f in v] for k, v in got["namespaces"].items()} == want
    assert got["label"] == 1.0


def test_out_lines(spark):
    arr = lambda n: F.array(*[F.lit(float(i + 1)) for i in range(n)])
    line = one(spark, sinks.vw_line(F.lit(1.0), [(arr(4), 4), (arr(10), 10), (arr(6), 6), (arr(10), 10)]))
    assert line.startswith("1.0 |1 0:1 1:2 ") and all(f"|{k} 0:1" in line for k in (1, 5, 15, 21))
    assert one(spark, sinks.vw_line_single(F.lit(-1.0), arr(2))) == "-1.0 |f f0:1 f1:2"
    assert one(spark, sinks.keep_original(F.lit("x"), F.lit("a b c"), [0, 2])) == "x |o a c"


def test_ngrams(spark):
    values = F.array(*map(F.lit, "abcd"))
    assert one(spark, S.ngrams(F.lit("n"), values, 2)) == ["n^a^b^", "n^b^c^", "n^c^d^", "n^d^"]
    assert one(spark, S.ngrams(F.lit("n"), F.array().cast("array<string>"), 2)) == []
    with pytest.raises(ValueError):
        S.ngrams(F.lit("n"), values, 0)


def test_equi_depth_bounds(spark):
    values = [1.0] * 7 + [2.0, 3.0, 4.0]
    rows = spark.createDataFrame([([str(v)],) for v in values], "features array<string>")
    got = P.equi_depth_bounds(P.numeric_histogram(rows), 5).first()["bounds"]
    x, want = sorted(values), []
    for n in range(1, 5):
        upto = 0
        for v in sorted(set(x)):
            upto += x.count(v)
            if upto > n * (len(x) // 5):
                want.append(v)
                break
    assert got == want
    mixed = spark.createDataFrame([(["1", "a"],), (["2", "3"],)], "features array<string>")
    assert {r["feature"] for r in P.numeric_histogram(mixed).collect()} == {0}


def test_config():
    r = C.Registry().add("testInt", "int").add("optionalDouble", "double", required=False, default=12.1).add("testSeq", "int_seq").add("seqOfSeq", "int_seq_seq").add("optionalInt", "int", required=False, default=10)
    r.parse("{'testInt': 1, // a comment\n 'optionalDouble': 1.23, 'testSeq': [1,2,3], /* x */ \"seqOfSeq\": [[1,2],[3,4],[4]]}")
    assert (r.get("testInt", "int"), r.get("optionalDouble", "double"), r.get("testSeq", "int_seq"), r.get("seqOfSeq", "int_seq_seq"), r.get("optionalInt", "int")) == (1, 1.23, [1, 2, 3], [[1, 2], [3, 4], [4]], 10)
    with pytest.raises(ValueError):
        r.add("testInt", "int")
    with pytest.raises(KeyError):
        r.get("testInt", "double")
    with pytest.raises(ValueError):
        C.Registry().add("x", "int").parse("{}")


@pytest.mark.parametrize("kind", ["exact", "cms", "unbiased_cms"])
def test_build_and_transform_by_command(spark, tmp_path, kind):
    d = f"file://{tmp_path}"
    lines(spark, *["1 |f 5 a"] * 20, *["-1 |f 5 b"] * 60).coalesce(1).write.text(f"{d}/in")
    lines(spark, "0 | 1.0 4.0 9.0").coalesce(1).write.text(f"{d}/percentiles")
    cli.run(spark, f"""{{"command": "build", "featureCount": 2, "labels": [-1, 1], "countTableConfig": {{"type": "{kind}", "epsilon": 0.01, "delta": 0.01}}, // kinds
      "percentilesFile": "{d}/percentiles", "countDataFile": "{d}/in", "countTableFile": "{d}/model", "featureCombinations": [[0, 1]]}}""")
    cli.run(spark, f"""{{"command": "transform", "featureCount": 2, "percentilesFile": "{d}/percentiles", "countTableFile": "{d}/model", "transformDataFilePath": "{d}/in", "outDataFile": "{d}/out",
      "removeFirstLabel": true, "keepOriginalFeatures": true, "featurizeWithTotalCounts": true, "updateCountFile": "{d}/updated"}}""")
    out = {r["value"] for r in spark.read.text(f"{d}/out").collect()}
    assert out == {"1.0 |1 0:2.50E-1 1:1 2:1 |4 0:80 1:20 2:20  |o 5 a".replace("2.50E-1", formats.compact(0.25)), "-1.0 |1 0:2.50E-1 1:0 2:0 |4 0:80 1:60 2:60  |o 5 b".replace("2.50E-1", formats.compact(0.25))}
    assert storage.load(spark, f"{d}/updated").priors() == {-1.0: 0.75, 1.0: 0.25}
    cli.run(spark, f'{{"command": "discretize", "featureCount": 2, "percentilesFile": "{d}/percentiles", "dataFile": "{d}/in", "outDataFile": "{d}/disc"}}')
    assert {r["value"] for r in spark.read.text(f"{d}/disc").collect()} == {"1.0 |f 9.0 a", "-1.0 |f 9.0 b"}
    cli.run(spark, f'{{"command": "computeNoiseWeights", "featureCount": 2, "percentile": 0.5, "epsilonDP": 1.0, "countTableFile": "{d}/model", "transformDataFilePath": "{d}/in", "outDataFile": "{d}/weights"}}')
    assert len(spark.read.text(f"{d}/weights").first()["value"].split()) == 3


def test_sniffed_gzip(spark, tmp_path):
    import gzip

    (tmp_path / "a").write_bytes(gzip.compress(b"x\ny\n"))
    (tmp_path / "b").write_bytes(b"z")
    assert sorted(r["value"] for r in text.lines(spark, f"file://{tmp_path}", sniff=True).collect()) == ["x", "y", "z"]


def test_delimited_sources(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\t5\t\n0\tx\n")
    assert [tuple(r) for r in text.criteo(spark, f"file://{tmp_path}/c.tsv", 3).collect()] == [(1.0, ["5", "0.0", "0.0"]), (-1.0, ["x", "0.0", "0.0"])]
    (tmp_path / "m.csv").write_text('movieId,title,genres\n1,"A, B",Drama|Action\n2,C,(no genres listed)\n')
    (tmp_path / "r.csv").write_text("userId,movieId,rating,timestamp\n7,1,4.5,10\n7,3,2.0,20\n")
    movies, ratings = text.movies(spark, f"file://{tmp_path}/m.csv"), text.ratings(spark, f"file://{tmp_path}/r.csv")
    universe = P.genre_universe(movies)
    assert universe == ["Action", "Drama"]
    out = P.rating_lines(ratings, movies, universe, "binary").orderBy("movieId").collect()
    assert out[0]["dense"] == "1 |f user-7 movie-1 Action Drama" and out[1]["dense"] == "-1 |f user-7 movie-3 no-Action no-Drama"
    assert out[0]["cross"] == "1 |g movie-1 user-7 Action Drama |u 7-movie-1 7-Action 7-Drama" and out[1]["cross"] == "-1 |g movie-3 user-7  |u 7-movie-3 "
    assert out[0]["rank"] == "1 |m movie-1 |u user-7 |g Action Drama" and out[1]["rank"] == "-1 |m movie-3 |u user-7 |g "
    labels = {k: [r["dense"].split(" ")[0] for r in P.rating_lines(ratings, movies, universe, k).orderBy("movieId").collect()] for k in ("integer", "raw")}
    assert labels == {"integer": ["9", "4"], "raw": ["4.5", "2.0"]}
    split = P.split_by_time(ratings, "timestamp", 0.5, 0.25).orderBy("timestamp").collect()
    assert [r["split"] for r in split] == ["count", "test"]


def test_splits_take_counting_rows_first(spark):
    rows = spark.createDataFrame([(t,) for t in [5, 1, 1, 2, 9, 7, 7, 3, 4, None]], "t long")
    got = {r["t"]: r["split"] for r in P.split_by_time(rows, "t", 0.4, 0.3).collect()}
    # Of nine times in order, those before the one at place 3 (3) count, those before the one at place 6 (7) train.
    assert got == {1: "count", 2: "count", 3: "train", 4: "train", 5: "train", 7: "test", 9: "test", None: "test"}


def test_rows_go_to_all_their_outputs(spark, tmp_path):
    rows = spark.range(300).select("id", F.when(F.col("id") % 7 != 0, F.array(F.lit("count"), F.lit("train"), F.lit("test"))[(F.col("id") % 3).cast("int")]).alias("split"), F.concat(F.lit("d"), "id").alias("dense"), F.concat(F.lit("c"), "id").alias("cross"), F.concat(F.lit("r"), "id").alias("rank"))
    routes = P.rating_routes()
    sinks.write_fan_out(rows, routes, f"file://{tmp_path}/out")
    assert len(routes) == 10 and len({r.output for r in routes}) == 10
    found = spark.read.text(f"file://{tmp_path}/out").groupBy("output").agg(F.collect_list("value").alias("v")).collect()
    for name, lines_ in {r.output: sorted(x[0] for x in rows.where(r.condition).select(r.line).collect()) for r in routes}.items():
        assert sorted(next(r["v"] for r in found if r["output"] == name)) == lines_
    per_split = rows.where("split is not null").groupBy("split").agg(*[F.max(F.when(r.condition, 1).otherwise(0)).alias(r.output) for r in routes]).collect()
    assert {r["split"]: sum(r[1:]) for r in per_split} == {"count": 4, "train": 6, "test": 3}
    with pytest.raises(ValueError):
        sinks.write_fan_out(rows, [routes[0], routes[0]], f"file://{tmp_path}/x")


def test_preparation_by_command(spark, tmp_path):
    d = f"file://{tmp_path}"
    (tmp_path / "c.tsv").write_text("".join(f"{i % 2}\t{i % 10}\t{'x' if i == 3 else i}\n" for i in range(100)))
    cli.run(spark, f'{{"command": "prepare", "featureCount": 2, "dataFile": "{d}/c.tsv", "outDataFile": "{d}/lines", "percentilesFile": "{d}/percentiles", "percentileCount": 5, "sampleFraction": 1.0}}')
    assert sorted(r["value"] for r in spark.read.text(f"{d}/lines").collect())[0] == "-1 |f 0 0"
    assert text.percentiles(text.lines(spark, f"{d}/percentiles")) == {0: [2.0, 4.0, 6.0, 8.0]}  # the second isn't always a number
    (tmp_path / "m.csv").write_text("movieId,title,genres\n1,A,Drama\n2,B,Action|Drama\n")
    (tmp_path / "r.csv").write_text("userId,movieId,rating,timestamp\n" + "".join(f"{i},{i % 3},{i % 5}.0,{i}\n" for i in range(20)))
    for random, folder in (("false", "a"), ("true", "b")):
        cli.run(spark, f'{{"command": "prepareRatings", "ratingsFile": "{d}/r.csv", "moviesFile": "{d}/m.csv", "outDataFile": "{d}/{folder}", "countProportion": 0.5, "trainProportion": 0.25, "randomSampling": {random}, "labelType": "binary"}}')
        sizes = {r["output"]: r["count"] for r in spark.read.text(f"{d}/{folder}").groupBy("output").count().collect()}
        assert sizes["countAll"] == sizes["mtrAll"] == sizes["rankAll"] == sizes["count"] + sizes["countTrain"] and sizes["countAll"] + sizes["countTest"] == 20
        if random == "false":
            assert sizes == {"count": 10, "countTrain": 5, "countTest": 5, "countAll": 15, "mtrAll": 15, "mtrTrain": 5, "mtrTest": 5, "rankAll": 15, "rankTrain": 5, "rankTest": 5}
    lines(spark, "1 | 5 a 0").coalesce(1).write.text(f"{d}/labels")
    cli.run(spark, f'{{"command": "prepareLabels", "dataFile": "{d}/labels", "outDataFile": "{d}/named"}}')
    assert spark.read.text(f"{d}/named").first()["value"] == "1 | f1:5 a f3:0"


def test_named_numbers(spark):
    got = P.prepare_label_file(lines(spark, "1 | 5 a 0")).first()["value"]
    assert got == "1 | f1:5 a f3:0"


def test_sketch_models_keep_cells(spark, tmp_path):
    """Cells answer seen and unseen keys, merge, are stored, and hold noise that is a function of the cell."""
    from tallyframe.operators.sketch import Sketch, SketchModel, add_to_cells, cell_values

    spec, sketch = Spec(2, (0.0, 1.0), ((0, 1),)), Sketch(0.001, 0.01)
    rows = spark.createDataFrame([(float(i % 2), [str(i % 50), str(i % 3)]) for i in range(600)], "label double, features array<string>")
    whole = SketchModel.fit(rows, spec, sketch)
    parts = [SketchModel.fit(rows.where(f"features[0] % 2 = {i}"), spec, sketch) for i in (0, 1)]
    asked = spark.createDataFrame([(["7", "1"],), (["never", "seen"],)], "features array<string>")
    blocks = Blocks(probabilities=False, counts=True, totals=True)
    exact = {tuple(r["features"]): (r["counts"], r["totals"]) for r in Model.fit(rows, spec).transform(asked, blocks).collect()}
    storage.save(whole, str(tmp_path / "m"))
    for model in (whole, parts[0].merge(parts[1]), storage.load(spark, str(tmp_path / "m"))):
        found = {tuple(r["features"]): (r["counts"], r["totals"]) for r in model.transform(asked, blocks).collect()}
        assert found == exact  # the sketch is wide enough for these keys
    noisy = SketchModel.fit(rows, spec, sketch, b=5.0, seed=9)
    values = [sorted(map(str, noisy.transform(asked, blocks).collect())) for _ in range(2)]
    assert values[0] == values[1] and values[0] != sorted(map(str, whole.transform(asked, blocks).collect()))
    with pytest.raises(ValueError):
        whole.merge(noisy)
    place = spark.createDataFrame([(0, 5), (1, 7)], "d int, w long")
    changed = add_to_cells(whole.cells, spark.createDataFrame([(0, 0, 5, 3.0)], "table_id int, d int, w long, s double"))
    before, after = ({(r["d"], r["w"]): r["value"] for r in cell_values(c, 0, place).collect()} for c in (whole.cells, changed))
    assert after[0, 5] == before[0, 5] + 3.0 and after[1, 7] == before[1, 7]


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    """What Spark writes is a folder of part files; batches of arrivals are numbered one after the other."""
    from tallyframe.streaming import counts as streaming

    rows = [(i, f"k{i % 3}", float(i % 2)) for i in range(97)]
    spark.createDataFrame(rows, "event_id long, key string, label double").repartitionByRange(4, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    found = streaming.hot_window_stream(spark, str(tmp_path), "events.parquet", lambda e: e, order="event_id", count_table_size=10, keep=3)
    want = {}
    for _, k, label in rows[60:90]:
        want[k, label] = want.get((k, label), 0) + 1
    assert {(r["key"], r["label"]): r["cnt"] for r in found.collect()} == want


def test_noise_needs_a_seed(spark, tmp_path):
    (tmp_path / "data").write_text("1 | 2\n0 | 3\n")
    conf = '{"command": "build", "featureCount": 1, "labels": [0, 1], "countTableConfig": {"type": "exact"}, "countDataFile": "%s", "countTableFile": "%s", "noiseLaplaceB": 2.0}' % (tmp_path / "data", tmp_path / "m")
    with pytest.raises(ValueError, match="noiseSeed"):
        cli.run(spark, conf)


def test_fixed_bounds_are_those_of_an_array(spark):
    values = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 1.5, 4.0, 9.0, 15.0, 99.0, float("nan"), float("inf"), None)], "x double")
    for bounds in ([], [1.0], [1.0, 4.0, 15.0], [0.0, 0.0, 2.0, 3.0, 9.0]):
        arr = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
        for r in values.select(S.bucketize_fixed("x", bounds).alias("a"), S.bucketize("x", arr).alias("b"), "x").collect():
            assert r["a"] is None if r["x"] is None else str(r["a"]) == str(r["b"])


def test_own_windows(spark, tmp_path):
    rows = W.with_ordinal(spark.range(30).select("id", F.when(F.col("id") < 15, 1.0).otherwise(-1.0).alias("label"), F.array((F.col("id") % 2).cast("string")).alias("features")), "id")
    spec = Spec(1, (-1.0, 1.0))
    storage.save_windowed(W.WindowedModel.fit(rows, spec, 10), f"file://{tmp_path}/model")
    model = storage.load_windowed(spark, f"file://{tmp_path}/model")
    points = spark.createDataFrame([(0, ["0"]), (1, ["0"]), (1, ["x"]), (2, ["1"]), (9, ["1"])], "window_id bigint, features array<string>")
    got = {(r.window_id, r.features[0]): (r.probabilities[0], r.window_probabilities[0]) for r in model.transform(points, Blocks(remove_first_label=True)).collect()}
    # In window 1, ids 10 to 14 are positive: of the even ones 10, 12, 14. An unseen key has its window's prior.
    assert got == {(0, "0"): (8 / 15, 1.0), (1, "0"): (8 / 15, 3 / 5), (1, "x"): (0.5, 0.5), (2, "1"): (7 / 15, 0.0), (9, "1"): (7 / 15, 0.0)}
    with pytest.raises(ValueError):
        storage.load(spark, f"file://{tmp_path}/model")
    storage.save(Model.fit(rows, spec), f"file://{tmp_path}/plain")
    with pytest.raises(ValueError):
        storage.load_windowed(spark, f"file://{tmp_path}/plain")


def hot_rows(spark, low, high):
    return spark.range(low, high).select((F.col("id") - low).alias("ordinal"), F.when(F.col("id") % 4 < 2, -1.0).otherwise(1.0).alias("label"), F.array((F.col("id") % 2).cast("string")).alias("features"))


def test_hot_window_state(spark, tmp_path):
    spec = Spec(1, (-1.0, 1.0))
    hot = W.HotWindow.start(hot_rows(spark, 0, 100), spec, hot_window_size=30, count_table_size=40, keep=2)
    assert (hot.n, hot.length, hot.first, hot.current) == (100, 40, 60, 2)
    assert hot.merged().labels.agg(F.sum("cnt")).first()[0] == 80 and hot.merged(True).labels.agg(F.sum("cnt")).first()[0] == 100
    taken, rest = hot.pop(5)
    assert sorted(r.ordinal for r in taken.collect()) == [60, 61, 62, 63, 64] and rest.length == rest.points.count() == 35
    with pytest.raises(ValueError):
        rest.pop(36)
    storage.save_hot(rest, f"file://{tmp_path}/hot")
    more = storage.load_hot(spark, f"file://{tmp_path}/hot").observe(hot_rows(spark, 100, 170))
    # Tables 0 and 1 are dropped: 2 and 3 are frozen, 4 has 10 arrivals.
    assert (more.n, more.first, more.length, more.points.count()) == (170, 120, 50, 50)
    assert more.merged().labels.agg(F.sum("cnt")).first()[0] == 80 and more.merged(True).labels.agg(F.sum("cnt")).first()[0] == 90
    plain = W.hot_model(spec, hot_rows(spark, 0, 170), count_table_size=40, keep=2, include_current=True)
    assert sorted(map(tuple, more.merged(True).counts.collect())) == sorted(map(tuple, plain.counts.collect()))
    assert more.transform().count() == 50 and more.transform(hot_rows(spark, 0, 3)).count() == 3


def test_noise_of_hot_windows_comes_once(spark):
    spec, sizes = Spec(1, (-1.0, 1.0)), {"hot_window_size": 30, "count_table_size": 40, "b": 5.0, "seed": 7}
    once = W.HotWindow.start(hot_rows(spark, 0, 130), spec, **sizes)
    steps = W.HotWindow.start(hot_rows(spark, 0, 50), spec, **sizes).observe(hot_rows(spark, 50, 95)).observe(hot_rows(spark, 95, 130))
    a, b = ({tuple(r)[:4]: r.cnt for r in h.tables.by_window.collect()} for h in (once, steps))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert all((v == int(v)) == (k[0] == 3) for k, v in a.items())  # the current table is still clean


def test_hot_and_windowed_commands(spark, tmp_path):
    d = f"file://{tmp_path}"
    lines(spark, *["1 |f 5 a"] * 20, *["-1 |f 5 b"] * 20).coalesce(1).write.text(f"{d}/in")
    common = f'"featureCount": 2, "countTableFile": "{d}/%s"'
    cli.run(spark, f'{{"command": "build", {common % "w"}, "labels": [-1, 1], "countTableConfig": {{"type": "exact"}}, "countDataFile": "{d}/in", "windowSize": 20}}')
    cli.run(spark, f'{{"command": "transform", {common % "w"}, "transformDataFilePath": "{d}/in", "outDataFile": "{d}/w_out", "removeFirstLabel": true, "windowSize": 20}}')
    assert {r["value"].split(" |")[0]: len(r["value"].split(":")) - 1 for r in spark.read.text(f"{d}/w_out").collect()} == {"1.0": 4, "-1.0": 4}
    with pytest.raises(ValueError):
        cli.run(spark, f'{{"command": "transform", {common % "w"}, "transformDataFilePath": "{d}/in", "outDataFile": "{d}/x", "windowSize": 10}}')
    cli.run(spark, f'{{"command": "buildHotWindow", {common % "h"}, "labels": [-1, 1], "featureCombinations": [], "hotWindowSize": 15, "countTableSize": 20, "countTableCount": 1, "countDataFile": "{d}/in"}}')
    cli.run(spark, f'{{"command": "transformHotWindow", {common % "h"}, "outDataFile": "{d}/held", "featurizeWithCounts": true}}')
    assert spark.read.text(f"{d}/held").count() == 25  # from ordinal 15 on
    cli.run(spark, f'{{"command": "transformHotWindow", {common % "h"}, "outDataFile": "{d}/new", "transformDataFilePath": "{d}/in"}}')
    assert spark.read.text(f"{d}/new").count() == 40


def test_feature_sets(spark):
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit(float(v)).alias("value"))
    spaces = F.create_map(F.lit("ns1"), F.array(*[pair(str(i), i) for i in range(11)]), F.lit("ns2"), F.array(pair("a", 1), pair("b", 12), pair("c", 15)))
    plain = one(spark, S.feature_set(spaces, {}, 28))
    assert len(plain) == 14 and {f.key: f.value for f in plain}["ns2^b"] == 12.0 and plain[0].key == "ns1^0"
    for n in (1, 2, 3):
        got = one(spark, S.feature_set(spaces, {"ns1": n}, 28))
        assert len(got) == 14 and [f.key for f in got] == ["ns1"] * 11 + ["ns2^a", "ns2^b", "ns2^c"]
    assert got[10].value == one(spark, S.hashed_feature(F.lit("ns1^10.0^"), 28))
    with pytest.raises(ValueError):
        S.feature_set(spaces, {"ns1": 0}, 28)


def test_ranks_and_draws(spark):
    rows = spark.range(101).select("id", (F.col("id") % 50).alias("v"))
    values = sorted(i % 50 for i in range(101))
    assert {r.share: r.value for r in P.by_rank(rows, "v", [0.0, 0.3, 1.0]).collect()} == {0.0: 0.0, 0.3: float(values[30]), 1.0: 49.0}
    assert P.by_rank(rows.limit(0), "v", [0.5]).count() == 0
    drawn = D.samples_with_replacement(rows, "id", 5, 40).toPandas()
    assert drawn.groupby("sample").size().tolist() == [40] * 5 and drawn.groupby("sample").id.nunique().max() < 40
    assert D.samples_with_replacement(rows.limit(0), "id", 2, 3).count() == 0
    assert C.numbers(spark, [1, 2]) == [1.0, 2.0] and C.numbers(spark, None) is None


def test_numbers_from_a_file(spark, tmp_path):
    (tmp_path / "shares.json").write_text("[1, // one\n 2.5]")
    assert C.numbers(spark, f"file://{tmp_path}/shares.json") == [1.0, 2.5]


def wide_rows(spark, n, features):
    """Rows that are nearly all distinct: some columns of few values, some of as many as there are rows."""
    row = lambda i: [str((i * (j + 3) * 7919 + j) % (5 + 3 * j if j % 3 else n)) for j in range(features)]
    return spark.createDataFrame([(float(i % 2), row(i)) for i in range(n)], "label double, features array<string>")


@pytest.mark.parametrize("most", [2000, 0])
def test_lookup_of_many_tables(spark, monkeypatch, most):
    """Broadcast tables, one shared exchange and any mixture of both agree with counts by hand; plans don't multiply."""
    from tallyframe.operators import tables as T

    monkeypatch.setattr(T, "BROADCAST_BYTES", most)
    rows, spec = wide_rows(spark, 60, 12), Spec(12, (0.0, 1.0), ((0, 1), (2, 3, 4)))
    model = Model.fit(rows, spec)
    model.b = tuple(float(t % 2) for t in range(14))
    asked = rows.unionByName(points(spark, [(1, [f"never{j}" for j in range(12)]), (1, ["1"] * 5)])).withColumn("extra", F.lit("x"))
    done = model.transform(asked, Blocks(True, True, True))
    found = done.collect()
    seen = [(r["label"], r["features"]) for r in rows.collect()]
    assert done.columns == ["label", "features", "extra", "probabilities", "counts", "totals"] and len(found) == 62
    for r in found:
        key = lambda f, t: tuple(x for x in (f[i] if i < len(f) else None for i in t) if x is not None)
        want = [float(sum(y == v and key(f, t) == key(r["features"], t) for y, f in seen)) for t in spec.tables for v in (0.0, 1.0)]
        assert r["counts"] == want and r["totals"] == [want[k] + want[k + 1] for k in range(0, 28, 2)]
    plan = model.transform(asked, Blocks(True, True, True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") <= 1  # not one for each table
    assert sorted(map(str, model.lookup(asked).collect())) == sorted(map(str, model.lookup(asked.repartition(3)).collect()))


def test_stored_tables_are_looked_up_as_they_are(spark, tmp_path):
    rows = wide_rows(spark, 40, 3)
    model = Model.fit(rows, Spec(3, (0.0, 1.0)))
    storage.save(model, f"file://{tmp_path}/m")
    again = storage.load(spark, f"file://{tmp_path}/m")
    assert again.prepared(rows).path.endswith("/m/tables")
    assert sorted(map(str, again.transform(rows).collect())) == sorted(map(str, model.transform(rows).collect()))
    again.counts = again.counts.withColumn("cnt", F.col("cnt") * 2)  # other counts, other tables
    assert again.transform(rows, Blocks(False, True)).agg(F.sum(F.get("counts", F.lit(0)))).first()[0] == 2 * model.transform(rows, Blocks(False, True)).agg(F.sum(F.get("counts", F.lit(0)))).first()[0]


@pytest.mark.parametrize("keep,current", [(1, False), (3, True), (300, False)])
def test_merged_view_by_differences(spark, monkeypatch, keep, current):
    monkeypatch.setattr(W, "VIEW_BLOCK", 4)
    held = [(w, t, k, 1.0, float(1 + (w * 7 + len(k)) % 5)) for w in (0, 1, 2, 5, 6, 9, 17, 18) for t, k in ((0, "a"), (0, "bb"), (1, "a")) if (w + len(k)) % 3]
    by_window = spark.createDataFrame(held, "window_id long, table_id int, key string, label double, cnt double")
    want = {}
    for view in range(0, 19 if current else 20):
        for w, t, k, label, cnt in held:
            if view - keep <= w <= (view if current else view - 1):
                want[view, t, k, label] = want.get((view, t, k, label), 0) + cnt
    got = W.hot_view(by_window, keep, current).collect()
    assert {(r["view_id"], r["table_id"], r["key"], r["label"]): r["cnt"] for r in got} == want and len(got) == len(want)
    spans = W.hot_view_intervals(by_window, keep, current).count()
    assert spans <= 2 * len(held)


@pytest.mark.parametrize("per_range", [4, 10**6])
def test_private_quantiles_by_range(spark, monkeypatch, per_range):
    """Groups over many ranges have the results of groups in one array."""
    from tallyframe.privacy import ranges as R

    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g, n in (("a", 200), ("b", 3), ("c", 2), ("d", 60), ("e", 1)) for v in np.round(rng.normal(50, 40, n), 0 if g == "d" else 3)]
    rows += [("f", 7.0)] * 50 + [("g", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    monkeypatch.setattr(R, "PER_RANGE", per_range)
    for q, beta in ((0.3, 0.05), (0.99, 0.001)) if per_range > 4 else ((0.3, 0.05), (0.01, 0.5), (1.0, 0.1)):
        whole = {r["g"]: tuple(r)[1:] for r in D.quantile_sensitivity(df, "v", q, 0.0, 100.0, beta, by=("g",)).collect()}
        monkeypatch.setattr(D, "LARGE_GROUP", 10)
        by_range = {r["g"]: tuple(r)[1:] for r in D.quantile_sensitivity(df, "v", q, 0.0, 100.0, beta, by=("g",)).collect()}
        assert by_range.keys() == whole.keys() and len(whole) == 4
        for g in whole:
            assert by_range[g] == pytest.approx(whole[g], rel=1e-9)
        monkeypatch.setattr(D, "LARGE_GROUP", 10**6)
    for alpha, u, inside in ((0.5, 0.4, 0.25), (0.9, 0.99, 0.0)):
        whole = {r["g"]: tuple(r)[1:] for r in D.private_quantile(df, "v", alpha, 80.0, 0.2, by=("g",), u=u, inside=inside).collect()}
        monkeypatch.setattr(D, "LARGE_GROUP", 10)
        by_range = {r["g"]: tuple(r)[1:] for r in D.private_quantile(df, "v", alpha, 80.0, 0.2, by=("g",), u=u, inside=inside).collect()}
        monkeypatch.setattr(D, "LARGE_GROUP", 10**6)
        assert by_range.keys() == whole.keys() and len(whole) == 5
        for g in whole:
            assert by_range[g] == pytest.approx(whole[g], rel=1e-6)


def hot_by_hand(rows, size, keep, hot):
    """Views and points held of each group after its rows (group, order, key, label) in order."""
    out = set()
    for g in {r[0] for r in rows}:
        own = sorted((o, k, label) for x, o, k, label in rows if x == g)
        n, view = len(own), {}
        for i, (_, k, label) in enumerate(own):
            if n // size - keep <= i // size < n // size:
                view[k, label] = view.get((k, label), 0) + 1
        out |= {(g, n, "view", None, k, label, float(c)) for (k, label), c in view.items()}
        out |= {(g, n, "point", i, k, label, 1.0) for i, (_, k, label) in enumerate(own) if i >= n // hot * hot - hot}
    return out


def test_hot_windows_keep_bounded_state(spark, tmp_path):
    """Several batches, a restart from the checkpoint, and what is held in the end."""
    from tallyframe.streaming import hot as H

    rows = [(f"g{i % 3 if i % 4 else 0}", i, f"k{i % 5}", float(i % 2)) for i in range(500)]
    shape = "group string, o long, key string, label double"
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/state"

    def run(low, high, *cuts):
        for a, b in zip([low, *cuts], [*cuts, high], strict=True):
            spark.createDataFrame(rows[a:b], shape).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
        H.run_hot_windows(H.hot_windows(stream, order="o", count_table_size=20, keep=2, hot_window_size=15), path)
        return {tuple(r[c.split(" ")[0]] for c in H.SHAPE.split(", ")) for r in H.latest(spark, path).collect()}

    assert run(0, 200, 90, 91, 150) == hot_by_hand(rows[:200], 20, 2, 15)
    assert run(200, 500, 333) == hot_by_hand(rows, 20, 2, 15)
    states = spark.read.parquet(f"{path}/states")
    assert states.select("batch").distinct().count() == 6
    assert states.where("kind = 'point'").groupBy("batch", "group").count().agg(F.max("count")).first()[0] <= 30
    assert states.where("kind = 'view'").groupBy("batch", "group").count().agg(F.max("count")).first()[0] <= 10
    with pytest.raises(ValueError):
        H.HotWindows("o", 0, 1, 1)


def test_capped_groups(spark):
    """Groups of exact size of different rows, none in more than the cap, some shared; reproducible."""
    rows = spark.range(400).select("id", F.lit("x").alias("o"))
    for groups, size, most in ((20, 20, 4), (5, 200, 4), (9, 44, 1), (3, 400, 3)):
        drawn = D.capped_groups(rows.drop("o"), "id", groups, size, most, seed=3).toPandas()
        assert drawn.groupby("group").size().tolist() == [size] * groups
        assert not drawn.duplicated(["group", "id"]).any() and drawn.groupby("id").size().max() <= most
        if most > 1 and groups * size >= 400:
            assert drawn.groupby("id").size().max() > 1
    again = D.capped_groups(rows.drop("o").repartition(7), "id", 20, 20, 4, seed=3).toPandas()
    first = D.capped_groups(rows.drop("o"), "id", 20, 20, 4, seed=3).toPandas()
    assert sorted(map(tuple, again[["id", "group"]].to_numpy())) == sorted(map(tuple, first[["id", "group"]].to_numpy()))
    with pytest.raises(ValueError):
        D.capped_groups(rows, "id", 3, 300, 2)


@pytest.mark.parametrize("range_bytes,block", [(7, 3), (50, 1 << 20), (64 << 20, 5)])
def test_sniffed_files_are_read_in_blocks(spark, tmp_path, monkeypatch, range_bytes, block):
    import gzip

    monkeypatch.setattr(text, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(text, "BLOCK_BYTES", block)
    rows = [f"{'ü' * (i % 9)}line {i}" for i in range(60)] + ["", "", "last without an end"]
    (tmp_path / "plain").write_text("\n".join(rows))
    (tmp_path / "windows").write_bytes("\r\n".join(rows[:5]).encode() + b"\r\n")
    (tmp_path / "packed").write_bytes(gzip.compress("\n".join(rows[:40]).encode() + b"\n") + gzip.compress(b"second member\n" * 50))
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "bad").write_bytes(b"\xff\n")
    want = [*rows, *rows[:5], *rows[:40], *["second member"] * 50, "\ufffd"]
    assert sorted(r["value"] for r in text.lines(spark, f"file://{tmp_path}", sniff=True).collect()) == sorted(want)


@pytest.mark.parametrize("most", [1 << 20, 0])
@pytest.mark.parametrize("kind", ["cms", "count_median", "count_sketch"])
def test_cells_by_place_and_by_join(spark, monkeypatch, kind, most):
    """Estimates by hand, with noise in cells, whichever way the cells are read."""
    monkeypatch.setattr(K, "BROADCAST_CELLS", most)
    s = K.Sketch(0.3, 0.1, kind)
    rows = spark.range(200).select((F.col("id") % 2).cast("int").alias("table_id"), (F.col("id") % 37).alias("k"), F.lit(1.0).alias("cnt"))
    cells = s.build(rows)
    held = {(r["table_id"], r["d"], r["w"]): r["s"] for r in cells.collect()}
    asked = spark.range(45).select((F.col("id") % 3).cast("int").alias("table_id"), F.col("id").alias("k"), F.lit("x").alias("extra"))
    noise = lambda d, w: (d * 10 + w).cast("double") / 8
    for n in (None, noise):
        found = s.query(asked, cells, 3, n)
        assert set(found.columns) == {"table_id", "k", "extra", "estimate"}
        places = {r["id"]: [(p["d"], p["w"], p["sign"]) for p in r["p"]] for r in spark.range(45).select("id", s.places(F.col("id")).alias("p")).collect()}
        for r in found.collect():
            values = sorted(sign * (held.get((r["table_id"], d, w), 0.0) + ((d * 10 + w) / 8 if n else 0.0)) for d, w, sign in places[r["k"]])
            assert r["estimate"] == pytest.approx(max(0.0, values[0] if kind == "cms" else values[s.depth // 2]))


@pytest.mark.parametrize("block", [5, 4096])
def test_nearest_distances(spark, block):
    """All distances by hand: clusters, equal vectors, repeated ids and fewer others than asked for."""
    from tallyframe.privacy import neighbours

    rng = np.random.default_rng(6)
    centers = rng.normal(0, 30, (6, 5))
    v = np.round(centers[rng.integers(0, 6, 120)] + rng.normal(0, 1, (120, 5)), 3)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(200 + i, v[0].tolist()) for i in range(20)] + [(5, v[9].tolist()), (300, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for k in (1, 4):
        want = sorted((i, [round(x, 9) for x in sorted(math.dist(a, b) for j, b in rows[:-1] if j != i)[:k]]) for i, a in rows[:-1])
        got = sorted((r["id"], [round(x, 9) for x in r["distances"]]) for r in neighbours.nearest_distances(df, "vec_id", "embedding", k, pivots=4, block_rows=block).collect())
        assert got == want
    few = spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>")
    assert [r["radius"] for r in neighbours.nearest_radius(few, "vec_id", "embedding", 1, 99.0).collect()] == [99.0, 99.0]
    assert neighbours.nearest_distances(few.limit(0), "vec_id", "embedding", 2).count() == 0


def test_smallest_by_products():
    """Nearest distances within arrays: exact ones, far outliers, copies, bounds, and several times faster than by differences."""
    from tallyframe.privacy import neighbours

    rng = np.random.default_rng(8)
    v = np.vstack((rng.normal(0, 1, (300, 8)), rng.normal(0, 1e-9, (40, 8)) + 7, np.full((150, 8), 7.0), [[1e9] * 8, [-1e-30] * 8, [np.nan] * 8]))
    ids = np.arange(len(v))
    ids[310:330] = 310
    d = np.array([np.sqrt(((v - x) ** 2).sum(1)) for x in v])
    d[ids[:, None] == ids[None, :]] = np.inf
    want = [[x for x in sorted(r[np.isfinite(r)])[:3]] for r in d]
    assert neighbours._smallest(ids, v, ids, v, 3) == want
    most = rng.choice([0.0, 1e-9, 1.5, np.inf], len(v))
    assert neighbours._smallest(ids, v, ids, v, 3, most) == [[x for x in r if x < m] for r, m in zip(want, most, strict=True)]
    v, ids = rng.normal(0, 1, (4000, 64)), np.arange(4000)
    began = time.perf_counter()
    for _ in neighbours._distances(v, v):
        pass
    by_differences = time.perf_counter() - began
    neighbours._smallest(ids, v, ids, v, 3)
    assert time.perf_counter() - began < 1.5 * by_differences


def test_pairwise_by_blocks(spark, monkeypatch):
    """All pairs by hand: dealt to many tasks, equal vectors, repeated ids, null vectors and ids."""
    from tallyframe.privacy import neighbours

    monkeypatch.setattr(neighbours, "PAIR_ROWS", 16)
    rng = np.random.default_rng(9)
    v = np.round(rng.normal(0, 1, (60, 5)), 3) + 1e6
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(70 + i, v[0].tolist()) for i in range(20)] + [(5, v[9].tolist()), (300, None), (301, [1.0, None]), (None, v[3].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    found = neighbours.pairwise(df, "id", "v")
    assert found.rdd.getNumPartitions() > 4
    whole = lambda x: x is not None and None not in x
    want = sorted((a, b, math.dist(x, y) if whole(x) and whole(y) else -1.0) for a, x in rows[:-1] for b, y in rows[:-1] if a != b)
    got = sorted((r["id"], r["other"], -1.0 if r["distance"] is None else r["distance"]) for r in found.collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-9, abs=0)
    assert neighbours.pairwise(df.limit(0), "id", "v").count() == 0
    with pytest.raises(Exception, match="different length"):
        neighbours.pairwise(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"), "id", "v").collect()


def test_pairwise_deals_rows_to_few_groups(spark, monkeypatch):
    """Blocks grow with the rows, so that what is moved doesn't grow with their square; pairs are made some at a time."""
    from tallyframe.privacy import neighbours

    monkeypatch.setattr(neighbours, "PAIR_ROWS", 2)
    monkeypatch.setattr(neighbours, "PAIRS", 50)
    rng = np.random.default_rng(3)
    rows = [(i % 290, x.tolist()) for i, x in enumerate(np.round(rng.normal(0, 1, (300, 4)), 2))] + [(400 + i, [0.5] * 4) for i in range(9)] + [(7, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = neighbours.pairwise(df, "id", "v", 3)
    most = neighbours.PAIR_BLOCKS
    assert found.rdd.getNumPartitions() == most * (most + 1) // 2
    got = sorted((r["id"], r["other"], -1.0 if r["distance"] is None else r["distance"]) for r in found.collect())
    want = sorted((a, b, math.floor(math.dist(x, y) * 1000 + 0.5) / 1000 if x and y else -1.0) for a, x in rows for b, y in rows if a != b)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=0, abs=1e-12)
    assert neighbours._rounded(np.array([0.0, 2.0000005, 1e300, np.inf]), 6).tolist() == [0.0, 2.000001, 1e300, np.inf]


def test_capped_groups_by_tasks(spark, tmp_path, monkeypatch):
    """Draws, ranks and joins are dealt to as many tasks as they ask for, however few partitions a shuffle has; equal groups."""
    rows = spark.range(3000).withColumn("x", F.col("id") * 2).coalesce(1)
    few = sorted(map(tuple, D.capped_groups(rows, "id", 4, 750, 27, seed=3).collect()))
    monkeypatch.setattr(D, "TASK_ROWS", 150)
    found = D.capped_groups(rows, "id", 4, 750, 27, seed=3)
    assert found.rdd.getNumPartitions() == 20
    assert sorted(map(tuple, found.collect())) == few


def test_fan_out_without_sort(spark, tmp_path):
    """Rows that go to several outputs aren't sorted by output; the session's setting is as it was."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    routes = [sinks.Route(f"r{i}", F.col("id") % 7 >= i, F.concat(F.lit(f"{i}:"), F.col("id").cast("string"))) for i in range(7)]
    sinks.write_fan_out(spark.range(200), routes, f"file://{tmp_path}/o")
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    assert "Sort" not in runs.last().physicalPlanDescription()
    assert spark.conf.get(key, None) == before
    got = sorted((r["output"], r["value"]) for r in spark.read.text(f"file://{tmp_path}/o").collect())
    assert got == sorted((f"r{i}", f"{i}:{n}") for i in range(7) for n in range(200) if n % 7 >= i)


def test_capped_groups_broadcast_no_draws(spark, monkeypatch):
    """Draws look as few as their blocks to the planner; nevertheless they don't pass through the driver."""
    plans, written = [], D.R.written

    def seen(df, kind):
        if kind == "groups":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, kind)

    monkeypatch.setattr(D.R, "written", seen)
    rows = spark.range(20_000).withColumn("x", F.col("id") * 2)
    found = D.capped_groups(rows, "id", 4, 5000, 70, seed=3)
    assert {r["group"]: r["n"] for r in found.groupBy("group").agg(F.countDistinct("id").alias("n")).collect()} == dict.fromkeys(range(4), 5000)
    assert plans and "isFinalPlan=true" in plans[0] and "SortMergeJoin" in plans[0]
    assert "BroadcastExchange" not in plans[0]


def test_models_of_mixed_kinds(spark, tmp_path):
    """Exact and sketched tables with noise of their own: stored without the sketched tables' keys, merged and updated."""
    rows = spark.createDataFrame([(float(i % 2), [str(i % 50), str(i % 3)], 2.0) for i in range(600)], "label double, features array<string>, weight double")
    spec = Spec(2, (0.0, 1.0), ((0, 1),))
    parts = [K.Part((0,), None, 4.0), K.Part((1, 2), K.Sketch(0.001, 0.01), 0.0)]
    asked = spark.createDataFrame([(["7", "1"],), (["never", "seen"],)], "features array<string>")
    counts = lambda m: {r["features"][0]: r["counts"] for r in m.transform(asked, Blocks(False, True)).collect()}
    exact = counts(Model.fit(rows, spec))
    for backing in (False, True):
        model = K.MixedModel.fit(rows, spec, parts, seed=3, backing=backing)
        storage.save(model, f"file://{tmp_path}/{backing}")
        again = storage.load(spark, f"file://{tmp_path}/{backing}")
        found = counts(again)
        assert found["7"][2:] == exact["7"][2:] and found["never"] == [0.0] * 6 and found["7"][:2] != exact["7"][:2]
        assert "key" not in spark.read.parquet(f"file://{tmp_path}/{backing}/parts/1").columns
        assert again.b == (4.0, 0.0, 0.0)
        twice = counts(storage.update(again, rows))
        assert twice["7"][2:] == [2 * x for x in exact["7"][2:]]
        if backing:
            assert counts(again.with_noise(False)) == exact and counts(again.with_noise(True)) == found
        else:
            with pytest.raises(ValueError):
                again.with_noise(True)
    assert counts(K.MixedModel.fit(rows, spec, parts[1:] + [K.Part((0,), None, 0.0)], use_weights=True))["7"] == [2 * x for x in exact["7"]]
    assert [r["cnt"] for r in again.count_for(asked, (0, 1), 1.0).orderBy(F.col("features")[0]).collect()] == [exact["7"][5], 0.0]
    with pytest.raises(ValueError):
        K.MixedModel.fit(rows, spec, parts[:1])
    with pytest.raises(ValueError):
        Model.fit(rows, spec).transform(asked, window=3)


def test_mixed_kinds_by_command(spark, tmp_path):
    d = f"file://{tmp_path}"
    lines(spark, *["1 |f 5 a"] * 20, *["-1 |f 5 b"] * 60).coalesce(1).write.text(f"{d}/in")
    cli.run(spark, f"""{{"command": "build", "featureCount": 2, "labels": [-1, 1], "countTableConfig": {{"type": "exact"}}, "countDataFile": "{d}/in", "countTableFile": "{d}/model",
      "perFeatureCountTableConfig": [{{"type": "exact"}}, {{"type": "cms", "epsilon": 0.01, "delta": 0.01}}], "isBackingNoise": true, "noiseLaplaceB": 3.0, "noiseSeed": 5}}""")
    for add in ("true", "false"):
        cli.run(spark, f"""{{"command": "transform", "featureCount": 2, "countTableFile": "{d}/model", "transformDataFilePath": "{d}/in", "outDataFile": "{d}/{add}", "featurizeWithProbabilities": false, "featurizeWithTotalCounts": true, "addBackingTableNoise": {add}}}""")
    clean = {r["value"] for r in spark.read.text(f"{d}/false").collect()}
    assert clean == {"1.0 |1 0:80 1:20 ", "-1.0 |1 0:80 1:60 "} and {r["value"] for r in spark.read.text(f"{d}/true").collect()} != clean


def test_large_features_and_medians(spark, monkeypatch):
    from tallyframe.privacy import ranges as R

    rows = spark.createDataFrame([([str(float(i * 7919 % 101)), str(i % 4)],) for i in range(400)], "features array<string>")
    whole = {r["feature"]: r["bounds"] for r in P.equi_depth_bounds(P.numeric_histogram(rows), 7).collect()}
    monkeypatch.setattr(P, "LARGE_FEATURE", 10)
    monkeypatch.setattr(R, "PER_RANGE", 9)
    assert {r["feature"]: r["bounds"] for r in P.equi_depth_bounds(P.numeric_histogram(rows), 7).collect()} == whole and len(whole) == 2
    values = [(g, v) for g, n in (("a", 51), ("b", 4), (None, 1)) for v in np.random.default_rng(n).integers(0, 30, n).astype(float).tolist()] + [("c", None)]
    got = {r["g"]: (r["n"], r["median"]) for r in P.medians(spark.createDataFrame(values, "g string, v double"), ("g",), "v").collect()}
    assert got == {g: (n, float(np.median([v for x, v in values if x == g]))) for g, n in (("a", 51), ("b", 4), (None, 1))}


def test_small_sources_and_sinks(spark, tmp_path):
    """Generated lines parse, numbers have scientific texts, tables are written as CSV, sketches as big-endian bytes."""
    import struct

    made = text.synthetic_lines(spark, 20, 3, keys=True, seed=4)
    assert text.synthetic_lines(spark, 20, 3, keys=True, seed=4).collect() == made.collect() and made.count() == 20
    parsed = text.parse_dense(made, 3).collect()
    assert {r["label"] for r in parsed} == {0.0, 1.0} and all(len(r["features"]) == 3 for r in parsed)
    spaces = text.parse_namespaced(text.synthetic_lines(spark, 5, 2, namespaces=2)).first()["namespaces"]
    assert set(spaces) == {"n0", "n1"}
    assert [one(spark, formats.scientific(F.lit(x))) for x in (0.0, 1234.5, 0.00123)] == ["0.000E0", "1.235E3", "1.230E-3"]
    assert [one(spark, S.positive_modulus(F.lit(x), 7)) for x in (-1, 0, 13)] == [2147483647 % 7, 0, 6]
    sinks.write_csv(spark.createDataFrame([(10, 0.5)], "features int, p25 double"), f"file://{tmp_path}/csv")
    assert {r["value"] for r in spark.read.text(f"file://{tmp_path}/csv").collect()} == {"features,p25", "10,0.5"}
    cells = spark.createDataFrame([(0, 0, 1, 2.5), (0, 1, 0, 4.0), (1, 0, 0, 9.0)], "table_id int, d int, w long, s double")
    dumped = {r["d"]: bytes(r["bytes"]) for r in storage.dump_sketch(cells, 0, 2, 3, 0.5, 0.25).collect()}
    assert struct.unpack(">5d", dumped[0]) == (0.5, 0.25, 0.0, 2.5, 0.0) and struct.unpack(">3d", dumped[1]) == (4.0, 0.0, 0.0)


def test_counts_by_event_time(spark, tmp_path):
    from tallyframe.streaming import counts as streaming

    shape = "t timestamp, key string, label double"
    for i, minutes in enumerate(((0, 1, 11), (12, 30), (2, 31))):  # the last batch has a row too late
        rows = spark.createDataFrame([(m, "a", 1.0) for m in minutes], "m int, key string, label double").select(F.timestamp_seconds(F.col("m") * 60).alias("t"), "key", "label")
        rows.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = streaming.watermarked_counts(spark.readStream.schema(shape).parquet(f"file://{tmp_path}/in"), "t", window="10 minutes", late="5 minutes")
        stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"file://{tmp_path}/out/batch={n}")).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").select(F.minute("start").alias("m"), "cnt").collect()
    assert sorted(map(tuple, got)) == [(0, 2.0), (10, 2.0)]
