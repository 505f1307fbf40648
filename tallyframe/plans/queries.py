"""The engine's queries over the test tables by name, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import formats
from tallyframe.functions import scalar as S
from tallyframe.operators import noise as N
from tallyframe.operators import sketch as K
from tallyframe.operators import windows as W
from tallyframe.operators.counts import Blocks, Criteria, Model, Spec, exact_counts, label_counts
from tallyframe.operators.tables import shared_path
from tallyframe.prepare import features as P
from tallyframe.privacy import sensitivity as D
from tallyframe.privacy.neighbours import nearest_radius, pairwise
from tallyframe.sources import sinks, text
from tallyframe.streaming import counts as streaming
from tallyframe.streaming import hot

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dealt_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """For work that is bound by the CPU before anything is aggregated."""
    return text.dealt(table(spark, d, name))


# Line items as labelled observations: quantity bucket, discount, status; label 1 for returned ones.

LINES = Spec(3, (-1.0, 1.0), ((1, 2),))
QUANTITY = [10.0, 20.0, 30.0, 40.0, 50.0]


def lines(spark: SparkSession, d: str) -> DataFrame:
    bounds = F.array(*[F.lit(b) for b in QUANTITY])
    features = F.array(S.bucketize("l_quantity", bounds).cast("string"), F.col("l_discount").cast("string"), F.col("l_linestatus"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("label"), features.alias("features"))


_OBS = """obs AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS label,
    CAST(CASE WHEN l_quantity <= 10 THEN 10.0::DOUBLE WHEN l_quantity <= 20 THEN 20.0 WHEN l_quantity <= 30 THEN 30.0 WHEN l_quantity <= 40 THEN 40.0 ELSE 50.0 END AS VARCHAR) AS f0,
    CAST(l_discount AS VARCHAR) AS f1, l_linestatus AS f2 FROM lineitem
), keyed AS (
  SELECT *, f0 AS k0, f1 AS k1, f2 AS k2, f1 || chr(31) || f2 AS k3 FROM obs
), counts AS (
  SELECT 0 AS table_id, k0 AS key, label, count(*)::DOUBLE AS cnt FROM keyed GROUP BY ALL
  UNION ALL SELECT 1, k1, label, count(*)::DOUBLE FROM keyed GROUP BY ALL
  UNION ALL SELECT 2, k2, label, count(*)::DOUBLE FROM keyed GROUP BY ALL
  UNION ALL SELECT 3, k3, label, count(*)::DOUBLE FROM keyed GROUP BY ALL
), wide AS (
  SELECT table_id, key, coalesce(sum(cnt) FILTER (label = -1), 0) AS c0, coalesce(sum(cnt) FILTER (label = 1), 0) AS c1 FROM counts GROUP BY ALL
), prior AS (SELECT avg((label = 1)::INT)::DOUBLE AS p1, avg((label = -1)::INT)::DOUBLE AS p0 FROM obs
), looked AS (
  SELECT k.*, a.c0 AS a0, a.c1 AS a1, b.c0 AS b0, b.c1 AS b1, c.c0 AS c0, c.c1 AS c1, e.c0 AS e0, e.c1 AS e1 FROM keyed k
  LEFT JOIN wide a ON a.table_id = 0 AND a.key = k0 LEFT JOIN wide b ON b.table_id = 1 AND b.key = k1
  LEFT JOIN wide c ON c.table_id = 2 AND c.key = k2 LEFT JOIN wide e ON e.table_id = 3 AND e.key = k3
)"""


@query(f"WITH {_OBS} SELECT table_id, key, label, cnt FROM counts WHERE table_id < 3")
def exact_count_tables(spark, d):
    return Model.fit(lines(spark, d), Spec(3, (-1.0, 1.0))).counts


@query(f"WITH {_OBS} SELECT key, label, cnt FROM counts WHERE table_id = 3")
def combo_counts(spark, d):
    return exact_counts(lines(spark, d), LINES).where("table_id = 3").select("key", "label", "cnt")


@query("SELECT o_orderstatus AS label, count(*) AS cnt, round(count(*) / sum(count(*)) OVER (), 9) AS prior FROM orders GROUP BY 1")
def label_prior(spark, d):
    counted = label_counts(table(spark, d, "orders").select(F.col("o_orderstatus").alias("label")))
    total = counted.agg(F.sum("cnt").alias("total"))
    return counted.join(F.broadcast(total)).select("label", F.col("cnt").cast("long").alias("cnt"), F.round(S.prior_probability("cnt", "total"), 9).alias("prior"))


def _columns(df: DataFrame, arrays: dict[str, int]) -> DataFrame:
    """Arrays as columns, so that rows compare by value."""
    return df.select("l_orderkey", "l_linenumber", "label", *[F.get(a, F.lit(i)).alias(f"{a[:1]}{i}") for a, n in arrays.items() for i in range(n)])


@query(f"WITH {_OBS} SELECT l_orderkey, l_linenumber, label, round(a1 / (a0 + a1), 9) AS p0, round(b1 / (b0 + b1), 9) AS p1, round(c1 / (c0 + c1), 9) AS p2, round(e1 / (e0 + e1), 9) AS p3 FROM looked")
def featurize_prob(spark, d):
    rows = lines(spark, d)
    return _columns(Model.fit(rows, LINES).transform(rows, Blocks(remove_first_label=True), places=9), {"probabilities": 4})


@query(f"WITH {_OBS} SELECT l_orderkey, l_linenumber, label, a0 AS c0, a1 AS c1, b0 AS c2, b1 AS c3, c0 AS c4, c1 AS c5, e0 AS c6, e1 AS c7 FROM looked")
def featurize_counts(spark, d):
    rows = lines(spark, d)
    return _columns(Model.fit(rows, LINES).transform(rows, Blocks(probabilities=False, counts=True), places=9), {"counts": 8})


@query(f"WITH {_OBS} SELECT l_orderkey, l_linenumber, label, a0 + a1 AS t0, b0 + b1 AS t1, c0 + c1 AS t2, e0 + e1 AS t3 FROM looked")
def featurize_totals(spark, d):
    rows = lines(spark, d)
    return _columns(Model.fit(rows, LINES).transform(rows, Blocks(probabilities=False, totals=True), places=9), {"totals": 4})


@query(f"""WITH {_OBS} SELECT l_orderkey, l_linenumber, label, round(a0 / (a0 + a1), 9) AS p0, round(a1 / (a0 + a1), 9) AS p1, round(b0 / (b0 + b1), 9) AS p2, round(b1 / (b0 + b1), 9) AS p3,
  round(c0 / (c0 + c1), 9) AS p4, round(c1 / (c0 + c1), 9) AS p5, round(e0 / (e0 + e1), 9) AS p6, round(e1 / (e0 + e1), 9) AS p7,
  a0 AS c0, a1 AS c1, b0 AS c2, b1 AS c3, looked.c0 AS c4, looked.c1 AS c5, e0 AS c6, e1 AS c7, a0 + a1 AS t0, b0 + b1 AS t1, looked.c0 + looked.c1 AS t2, e0 + e1 AS t3 FROM looked""")
def featurize_blocks(spark, d):
    rows = lines(spark, d)
    return _columns(Model.fit(rows, LINES).transform(rows, Blocks(True, True, True), places=9), {"probabilities": 8, "counts": 8, "totals": 4})


@query(f"WITH {_OBS} SELECT l_orderkey, l_linenumber, label, a1 AS c0, b1 AS c1, c1 AS c2, e1 AS c3 FROM looked")
def remove_first_label(spark, d):
    rows = lines(spark, d)
    return _columns(Model.fit(rows, LINES).transform(rows, Blocks(probabilities=False, counts=True, remove_first_label=True), places=9), {"counts": 4})


def _with_scale(spark, d, b: float, criteria: Criteria) -> DataFrame:
    rows = lines(spark, d)
    model = Model.fit(rows, LINES)
    model.b = b
    return _columns(model.transform(rows, Blocks(remove_first_label=True), criteria, places=9), {"probabilities": 4})


#: The noise scale at which some tables' totals stop meaning anything, by the criterion, on any scale factor.
_B = 1500.0


def _total(x: str) -> str:
    return f"CASE WHEN {x}0 + {x}1 < sqrt(4 * {_B} * {_B}) THEN p1 ELSE {x}1 / ({x}0 + {x}1) END"


@query(f"WITH {_OBS} SELECT l_orderkey, l_linenumber, label, {', '.join(f'round({_total(x)}, 9) AS p{i}' for i, x in enumerate('abce'))} FROM (SELECT l_orderkey, l_linenumber, label, a0, a1, b0, b1, looked.c0 AS c0, looked.c1 AS c1, e0, e1, prior.p1 AS p1 FROM looked, prior)")
def prob_total_criterion(spark, d):
    return _with_scale(spark, d, _B, Criteria())


def _variance(x: str) -> str:
    n, p = f"({x}0 + {x}1)", f"({x}1 / ({x}0 + {x}1))"
    return f"CASE WHEN abs({p} - p1) <= sqrt(({n} * {p} * (1 - {p})) / ({n} * {n})) THEN p1 ELSE {p} END"


@query(f"WITH {_OBS} SELECT l_orderkey, l_linenumber, label, {', '.join(f'round({_variance(x)}, 9) AS p{i}' for i, x in enumerate('abce'))} FROM (SELECT l_orderkey, l_linenumber, label, a0, a1, b0, b1, looked.c0 AS c0, looked.c1 AS c1, e0, e1, prior.p1 AS p1 FROM looked, prior)")
def prob_variance_criterion(spark, d):
    return _with_scale(spark, d, 0.0, Criteria(variance=True))


@query("SELECT p_partkey, CASE WHEN p_retailprice <= 950 THEN 950.0::DOUBLE WHEN p_retailprice <= 1000 THEN 1000.0 WHEN p_retailprice <= 1100 THEN 1100.0 ELSE 1500.0 END AS bucket FROM part")
def discretize(spark, d):
    return table(spark, d, "part").select("p_partkey", S.bucketize("p_retailprice", F.array(*map(F.lit, (950.0, 1000.0, 1100.0, 1500.0)))).alias("bucket"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_totalprice <= 50000 THEN 50000.0::DOUBLE WHEN o_totalprice <= 150000 THEN 150000.0 ELSE 300000.0 END AS VARCHAR) AS price, o_orderpriority AS priority FROM orders")
def bucket_string(spark, d):
    bounds = F.array(*map(F.lit, (50000.0, 150000.0, 300000.0)))
    return table(spark, d, "orders").select("o_orderkey", S.bucket_to_string(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), bounds).alias("price"), S.bucket_to_string("o_orderpriority", bounds).alias("priority"))


@query("""WITH c AS (SELECT o_totalprice AS v, count(*) AS n FROM orders GROUP BY 1), u AS (SELECT v, sum(n) OVER (ORDER BY v) AS upto, n, (SELECT count(*) FROM orders) // 10 AS step FROM c)
SELECT i AS bound, min(v) AS value FROM u, (SELECT unnest(range(1, 10)) AS i) WHERE upto > i * step GROUP BY i""")
def percentile_bounds(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_totalprice").alias("value")).agg(F.count("*").alias("cnt")).withColumn("feature", F.lit(0))
    return P.equi_depth_bounds(rows, 10).select(F.posexplode("bounds").alias("p", "value")).select((F.col("p") + 1).cast("long").alias("bound"), "value")


def _java(x: str) -> str:
    folded = f"list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, length({x}) + 1), lambda i: ord(substr({x}, i, 1))::HUGEINT)), lambda h, u: (h * 31 + u) % 4294967296)"
    return f"CAST(CASE WHEN {folded} >= 2147483648 THEN {folded} - 4294967296 ELSE {folded} END AS BIGINT)"


@query(f"SELECT DISTINCT s AS text, {_java('s')} AS hash FROM (SELECT c_mktsegment AS s FROM customer UNION ALL SELECT p_type FROM part UNION ALL SELECT lang || source FROM documents)")
def java_hash(spark, d):
    s = table(spark, d, "customer").select(F.col("c_mktsegment").alias("text")).union(table(spark, d, "part").select("p_type")).union(table(spark, d, "documents").select(F.concat("lang", "source"))).distinct()
    return s.select("text", S.java_hash("text").alias("hash"))


# Sketches over part keys.

SKETCHES = {kind: K.Sketch(0.01, 0.01, kind) for kind in ("cms", "count_median", "count_sketch")}


def _cells_sql(s: K.Sketch) -> str:
    hashed = lambda d: f"((({S.coefficients(d)[0]} * k + {S.coefficients(d)[1]}) % 2147483647) % {s.width})"
    sign = lambda d: "1.0" if s.kind != "count_sketch" else f"(CASE WHEN (({S.coefficients(d + 1000)[0]} * k + {S.coefficients(d + 1000)[1]}) % 2147483647) % 2 = 0 THEN 1.0 ELSE -1.0 END)"
    placed = " UNION ALL ".join(f"SELECT k, n, {d} AS d, {hashed(d)} AS w, {sign(d)}::DOUBLE AS sign FROM exact" for d in range(s.depth))
    reduce = "min(sign * s)" if s.kind == "cms" else f"list_sort(list(sign * s))[{s.depth // 2 + 1}]"
    return f"""exact AS (SELECT l_partkey AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), placed AS ({placed}),
cells AS (SELECT d, w, sum(sign * n) AS s FROM placed GROUP BY ALL), estimates AS (SELECT k, n, greatest(0, {reduce}) AS estimate FROM placed JOIN cells USING (d, w) GROUP BY k, n)"""


def _partkeys(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.lit(0).alias("table_id"), F.col("l_partkey").alias("k"), F.lit(1.0).alias("cnt"))


def _points(kind: str):
    def run(spark, d):
        s, rows = SKETCHES[kind], _partkeys(spark, d)
        return s.query(rows.select("table_id", "k").distinct(), s.build(rows)).select("k", "estimate")

    run.__name__ = {"cms": "cms_point", "count_median": "count_median_point", "count_sketch": "count_sketch_point"}[kind]
    return run


for _kind, _s in SKETCHES.items():
    query(f"WITH {_cells_sql(_s)} SELECT k, estimate FROM estimates")(_points(_kind))


@query(f"WITH {_cells_sql(SKETCHES['cms'])} SELECT count(*) AS keys, sum(n)::BIGINT AS exact, sum(estimate)::BIGINT AS estimated, count(*) FILTER (estimate < n) AS below FROM estimates")
def cms_error(spark, d):
    s, rows = SKETCHES["cms"], _partkeys(spark, d)
    exact = rows.groupBy("table_id", "k").agg(F.sum("cnt").alias("n"))
    found = s.query(exact.select("table_id", "k"), s.build(rows)).join(exact, ["table_id", "k"])
    return found.agg(F.count("*").alias("keys"), F.sum("n").cast("long").alias("exact"), F.sum("estimate").cast("long").alias("estimated"), F.count_if(F.col("estimate") < F.col("n")).alias("below"))


@query(f"WITH {_cells_sql(SKETCHES['cms'])} SELECT d, w, s FROM cells")
def cms_merge(spark, d):
    rows = _partkeys(spark, d)
    s = SKETCHES["cms"]
    halves = [s.build(rows.where(F.pmod("k", F.lit(2)) == i)) for i in (0, 1)]
    return K.merge_cells(*halves).select("d", "w", "s")


# A model whose tables are sketches, asked for keys that it has seen and others.

SMALL = K.Sketch(0.05, 0.1, "cms")


def _model_cells_sql(s: K.Sketch) -> str:
    k = "(('0x' || substr(md5(key || '|' || label::INT::VARCHAR), 1, 8))::BIGINT % 2147483647)"
    hashed = lambda d: f"((({S.coefficients(d)[0]} * k + {S.coefficients(d)[1]}) % 2147483647) % {s.width})"
    at = lambda rows: " UNION ALL ".join(f"SELECT *, {d} AS d, {hashed(d)} AS w FROM {rows}" for d in range(s.depth))
    return f"""o AS (SELECT o_custkey::VARCHAR AS key, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS label FROM orders),
seen AS (SELECT key, label, {k} AS k, count(*)::DOUBLE AS n FROM o GROUP BY ALL), cells AS (SELECT d, w, sum(n) AS s FROM ({at('seen')}) GROUP BY ALL),
asked AS (SELECT key, label, {k} AS k FROM (SELECT c_custkey::VARCHAR AS key FROM customer), (VALUES (1.0::DOUBLE), (-1.0)) v(label)), placed AS ({at('asked')})"""


@query(f"WITH {_model_cells_sql(SMALL)} SELECT key::BIGINT AS c_custkey, min(coalesce(s, 0)) FILTER (label = -1) AS c0, min(coalesce(s, 0)) FILTER (label = 1) AS c1 FROM placed LEFT JOIN cells USING (d, w) GROUP BY key")
def sketch_model_counts(spark, d):
    """Of two models merged by their cells; most customers asked for have orders, the others only have cells."""
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(-1.0).alias("label"), F.array(F.col("o_custkey").cast("string")).alias("features"))
    spec = Spec(1, (-1.0, 1.0))
    a, b = (K.SketchModel.fit(rows.where(F.pmod("o_orderkey", F.lit(2)) == i), spec, SMALL) for i in (0, 1))
    asked = table(spark, d, "customer").select("c_custkey", F.array(F.col("c_custkey").cast("string")).alias("features"))
    done = a.merge(b).transform(asked, Blocks(probabilities=False, counts=True))
    return done.select("c_custkey", F.get("counts", F.lit(0)).alias("c0"), F.get("counts", F.lit(1)).alias("c1"))


# Noise.


def _uniform_sql(k: str, seed: int) -> str:
    a, b = S.coefficients(seed)
    return f"(((({a} * ({k}) + {b}) % 2147483647) * {b | 1} + {a}) % 2147483647 + 0.5) / 2147483647.0"


def _laplace_sql(u: str, b: float) -> str:
    return f"(-{b} * sign({u} - 0.5) * ln(1 - 2 * abs({u} - 0.5)))"


_COUNT_KEY = "(('0x' || substr(md5(table_id::VARCHAR || '|' || key || '|' || label::INT::VARCHAR), 1, 8))::BIGINT % 2147483647)"


@query(f"WITH {_OBS} SELECT table_id, key, label, round(cnt + {_laplace_sql(_uniform_sql(_COUNT_KEY, 5), 10.0)} + {_laplace_sql(_uniform_sql(_COUNT_KEY, 36), 10.0)}, 6) AS cnt FROM counts")
def noisy_counts(spark, d):
    counted = exact_counts(lines(spark, d), LINES)
    return N.noisy(counted, 10.0, seed=5, draws=2).withColumn("cnt", F.round("cnt", 6))


@query(f"WITH {_OBS} SELECT table_id, key, label, cnt AS clean, round(cnt + {_laplace_sql(_uniform_sql(_COUNT_KEY, 9), 10.0)}, 6) AS noisy FROM counts")
def backing_noise(spark, d):
    counted = N.noisy(exact_counts(lines(spark, d), LINES), 10.0, seed=9, backing=True)
    return counted.select("table_id", "key", "label", F.col("cnt").alias("clean"), F.round(F.col("cnt") + F.col("noise"), 6).alias("noisy"))


@query("""WITH q AS (SELECT s_nationkey AS t, count(*)::DOUBLE AS q FROM supplier GROUP BY 1), s AS (SELECT c_nationkey AS t, count(*)::DOUBLE AS s FROM customer GROUP BY 1),
m AS (SELECT c_nationkey AS t, count(*)::DOUBLE AS m FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY 1),
v AS (SELECT q.t, q, 1 / (1 + coalesce(s, 1) / coalesce(m, 1)) AS v FROM q LEFT JOIN s USING (t) LEFT JOIN m USING (t))
SELECT t AS table_id, round((SELECT sum(q * v) FROM v) / (q * v * (SELECT sum(q) FROM v)), 9) AS multiplier FROM v""")
def noise_multipliers(spark, d):
    """A count table for each nation: as many queries as it has suppliers, shares by customers, importances by open orders."""
    count = lambda rows, key: rows.groupBy(F.col(key).alias("table_id")).agg(F.count("*").cast("double").alias("value"))
    customers = table(spark, d, "customer")
    open_ = table(spark, d, "orders").where("o_orderstatus = 'P'").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    found = N.multiplier_table(count(table(spark, d, "supplier"), "s_nationkey"), count(customers, "c_nationkey"), count(open_, "c_nationkey"))
    return found.withColumn("multiplier", F.round("multiplier", 9))


@query("SELECT f AS feature, key, label, count(*)::DOUBLE AS cnt FROM (SELECT 0 AS f, o_orderpriority AS key, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS label FROM orders) GROUP BY ALL")
def merge_models(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(-1.0).alias("label"), F.array("o_orderpriority").alias("features"))
    spec = Spec(1, (-1.0, 1.0))
    a, b = (Model.fit(rows.where(F.pmod("o_orderkey", F.lit(2)) == i), spec) for i in (0, 1))
    return a.merge(b).counts.select(F.col("table_id").alias("feature"), "key", "label", "cnt")


# Events by arrival.

EVENTS = Spec(1, (-1.0, 1.0))
SIZE, KEEP = 1000, 3


def arrivals(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "purchase", 1.0).otherwise(-1.0).alias("label"), F.array(F.pmod("user_id", F.lit(10)).cast("string")).alias("features"))
    return W.with_ordinal(e, "event_id").withColumn("window_id", W.window_of("ordinal", SIZE))


_EVENTS = f"""e AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS label, CAST(user_id % 10 AS VARCHAR) AS key, row_number() OVER (ORDER BY event_id) - 1 AS ordinal FROM events),
w AS (SELECT *, ordinal // {SIZE} AS window_id FROM e), c AS (SELECT window_id, key, label, count(*)::DOUBLE AS cnt FROM w GROUP BY ALL)"""


@query(f"WITH {_EVENTS} SELECT window_id, key, label, cnt FROM c")
def window_counts(spark, d):
    return W.WindowedModel.fit(arrivals(spark, d), EVENTS).by_window.select("window_id", "key", "label", "cnt")


@query(f"""WITH {_EVENTS}, x AS (SELECT window_id, key, sum(cnt) AS t, coalesce(sum(cnt) FILTER (label = 1), 0) AS n FROM c GROUP BY ALL), f AS (SELECT key, sum(t) AS ft, sum(n) AS fn FROM x GROUP BY ALL)
SELECT event_id, ft AS full_total, fn AS full_positive, t AS window_total, n AS window_positive FROM w JOIN x USING (window_id, key) JOIN f USING (key)""")
def window_featurize(spark, d):
    rows = arrivals(spark, d)
    model = W.WindowedModel.fit(rows, EVENTS)
    own = model.own_window_counts(rows).withColumnRenamed("t0", "w")
    both = model.full.lookup(own)
    total = lambda c: F.get(c, F.lit(0)) + F.get(c, F.lit(1))
    return both.select("event_id", total("t0").alias("full_total"), F.get("t0", F.lit(1)).alias("full_positive"), total("w").alias("window_total"), F.get("w", F.lit(1)).alias("window_positive"))


@query(f"""WITH {_EVENTS}, v AS (SELECT unnest(range(1, (SELECT max(window_id) FROM c) + 2)) AS view_id)
SELECT view_id, key, label, sum(cnt) AS cnt FROM v JOIN c ON window_id < view_id AND window_id >= view_id - {KEEP} GROUP BY ALL""")
def hot_window_merge(spark, d):
    rows = arrivals(spark, d)
    return W.hot_view(W.WindowedModel.fit(rows, EVENTS).by_window, KEEP).select("view_id", "key", "label", "cnt")


@query(f"""WITH {_EVENTS}, n AS (SELECT count(*) AS n FROM e), m AS (SELECT key, sum(cnt) AS t, coalesce(sum(cnt) FILTER (label = 1), 0) AS p FROM c, n WHERE window_id < n // {SIZE} AND window_id >= n // {SIZE} - {KEEP} GROUP BY ALL)
SELECT event_id, coalesce(t, 0) AS total, coalesce(p, 0) AS positive FROM e LEFT JOIN m USING (key), n WHERE ordinal >= n // 500 * 500 - 500""")
def hot_window_featurize(spark, d):
    rows = arrivals(spark, d)
    n = rows.count()
    model = W.hot_model(EVENTS, rows, count_table_size=SIZE, keep=KEEP, n=n)
    held = W.hot_points(rows, hot_window_size=500, n=n)
    return model.lookup(held).select("event_id", (F.get("t0", F.lit(0)) + F.get("t0", F.lit(1))).alias("total"), F.get("t0", F.lit(1)).alias("positive"))


@query(f"""WITH {_EVENTS}, x AS (SELECT window_id, key, sum(cnt) AS t, coalesce(sum(cnt) FILTER (label = 1), 0) AS n FROM c GROUP BY ALL), f AS (SELECT key, sum(t) AS t, sum(n) AS n FROM x GROUP BY ALL), p AS (SELECT window_id, sum(n) / sum(t) AS prior FROM x GROUP BY ALL)
SELECT event_id, round(f.n / f.t, 9) AS full_probability, round(coalesce(x.n / x.t, p.prior, 0), 9) AS next_probability FROM w JOIN f USING (key) LEFT JOIN x ON x.window_id = w.window_id + 1 AND x.key = w.key LEFT JOIN p ON p.window_id = w.window_id + 1""")
def window_transform(spark, d):
    """Probabilities over all windows and in the window after the point's own, which for the last one has no counts."""
    rows = arrivals(spark, d)
    found = W.WindowedModel.fit(rows, EVENTS).transform(rows.withColumn("window_id", F.col("window_id") + 1), Blocks(remove_first_label=True), places=9)
    return found.select("event_id", F.get("probabilities", F.lit(0)).alias("full_probability"), F.get("window_probabilities", F.lit(0)).alias("next_probability"))


@query(f"""WITH {_EVENTS}, n AS (SELECT count(*) AS n FROM e), m AS (SELECT key, coalesce(sum(cnt) FILTER (window_id < n // {SIZE}), 0) AS t, sum(cnt) AS tc FROM c, n WHERE window_id >= n // {SIZE} - {KEEP} GROUP BY ALL)
SELECT event_id, coalesce(t, 0) AS frozen_total, coalesce(tc, 0) AS total FROM e LEFT JOIN m USING (key), n WHERE ordinal >= n // 500 * 500 - 500""")
def hot_window_state(spark, d):
    """The points held after two runs of arrivals, over the frozen tables and with the current one."""
    rows, cut = arrivals(spark, d).select("event_id", "ordinal", "label", "features"), SIZE + SIZE // 2
    hot = W.HotWindow.start(rows.where(F.col("ordinal") < cut), EVENTS, hot_window_size=500, count_table_size=SIZE, keep=KEEP)
    hot = hot.observe(rows.where(F.col("ordinal") >= cut).withColumn("ordinal", F.col("ordinal") - cut))
    totals = Blocks(probabilities=False, totals=True)
    frozen = hot.transform(blocks=totals).withColumnRenamed("totals", "frozen")
    return hot.transform(frozen, totals).select("event_id", F.get("frozen", F.lit(0)).alias("frozen_total"), F.get("totals", F.lit(0)).alias("total"))


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority AS p, o_totalprice::DOUBLE AS v, o_custkey::DOUBLE::VARCHAR AS a, (o_custkey % 7)::DOUBLE::VARCHAR AS b FROM orders),
g AS (SELECT o_orderkey, 1 AS place, 'ids^' || a || '^' || b || '^' AS key FROM o UNION ALL SELECT o_orderkey, 2, 'ids^' || b || '^' FROM o)
SELECT o_orderkey, CAST(place AS INT) AS place, 'ids' AS key, ((('0x' || substr(md5(key), 1, 8))::BIGINT % 2147483647) % 1024)::DOUBLE AS value FROM g
UNION ALL SELECT o_orderkey, 0, 'price^' || p, v FROM o""")
def feature_set(spark, d):
    """A namespace of keys and a namespace of 2-grams of values."""
    pair = lambda k, v: F.struct(k.alias("key"), S.col(v).cast("double").alias("value"))
    spaces = F.create_map(F.lit("price"), F.array(pair(F.col("o_orderpriority"), "o_totalprice")), F.lit("ids"), F.array(pair(F.lit("c"), "o_custkey"), pair(F.lit("s"), F.pmod("o_custkey", F.lit(7)))))
    return dealt_table(spark, d, "orders").select("o_orderkey", F.posexplode_outer(S.feature_set(spaces, {"ids": 2}, 10)).alias("place", "f")).where("place is not null").select("o_orderkey", "place", "f.key", "f.value")


@query("SELECT (SELECT count(*) FROM lineitem) AS n, list_sort(list(l_extendedprice))[CAST(floor(count(*) * 0.25) AS INT) + 1]::DOUBLE AS low, list_sort(list(l_extendedprice))[CAST(floor(count(*) * 0.5) AS INT) + 1]::DOUBLE AS middle FROM lineitem")
def values_by_rank(spark, d):
    found = P.by_rank(table(spark, d, "lineitem"), "l_extendedprice", [0.25, 0.5])
    return found.groupBy("n").agg(F.max(F.when(F.col("share") == 0.25, F.col("value"))).alias("low"), F.max(F.when(F.col("share") == 0.5, F.col("value"))).alias("middle"))


@query("SELECT event_type AS key, CAST(sum(round(value)) AS DOUBLE) AS cnt FROM events GROUP BY 1")
def weighted_counts(spark, d):
    rows = table(spark, d, "events").select(F.lit(1.0).alias("label"), F.array("event_type").alias("features"), F.round("value").alias("weight"))
    return exact_counts(rows, Spec(1, (1.0,)), use_weights=True).select("key", "cnt")


# Text.


def _line_texts(spark, d) -> DataFrame:
    t = dealt_table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.when(F.col("l_returnflag") == "R", "1").otherwise("-1"), F.lit(" |f "), F.col("l_quantity").cast("string"), F.lit(" q:"), F.col("l_discount").cast("string"), F.lit(" "), F.col("l_linestatus")).alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS label, CASE WHEN l_quantity <= 25 THEN 25.0::DOUBLE ELSE 50.0 END AS f0, l_discount AS f1, ascii(l_linestatus)::DOUBLE AS f2, 0.0::DOUBLE AS f3 FROM lineitem")
def vw_parse(spark, d):
    parsed = text.parse_dense(_line_texts(spark, d), 4, {0: [25.0, 50.0]})
    return parsed.select("l_orderkey", "l_linenumber", "l_partkey", "label", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(4)])


@query()
def vw_format(spark, d):
    """Lines of probabilities and totals, with two of the features kept; every text is made once for each key of a table."""
    rows = lines(spark, d)
    done = Model.fit(rows, LINES).texts(rows, Blocks(remove_first_label=True, totals=True))
    line = sinks.vw_texts(F.col("label"), [(F.col("probabilities"), 4), (F.col("totals"), 4)])
    return done.select(sinks.keep_original(line, F.array_join("features", " "), [0, 2]).alias("value"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, ns, k, v FROM orders, LATERAL (VALUES
  ('a', '0', o_custkey::DOUBLE), ('a', 'x', 2.0::DOUBLE), ('a', '2', 7.0::DOUBLE), ('', '0', floor(o_totalprice)::DOUBLE)) t(ns, k, v)""")
def namespaced_parse(spark, d):
    o = dealt_table(spark, d, "orders")
    rows = o.select("o_orderkey", F.concat(F.when(F.col("o_orderstatus") == "F", "1").otherwise("0"), F.lit(" |a "), F.col("o_custkey").cast("string"), F.lit(" x:2 | "), F.floor("o_totalprice").cast("string"), F.lit(" |a 7")).alias("value"))
    return text.namespaced_features(text.parse_namespaced(rows), "o_orderkey", "label")


@query(f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i AS place, 'text^' || array_to_string(w[i:i + 1], '^') || '^' AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d))
SELECT doc_id, CAST(place - 1 AS INT) AS place, ((('0x' || substr(md5(key), 1, 8))::BIGINT % 2147483647) % 1024)::DOUBLE AS feature FROM g""")
def ngram_hash(spark, d):
    words = F.filter(F.split(F.regexp_replace("text", r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    grams = S.ngrams(F.lit("text"), words, 2)
    return dealt_table(spark, d, "documents").select("doc_id", F.posexplode_outer(grams).alias("place", "key")).where("place is not null").select("doc_id", "place", S.hashed_feature(F.col("key"), 10).alias("feature"))


@query("""WITH o AS (SELECT doc_id, quality, lang AS k0, source AS k1, CASE WHEN n_chars <= 500 THEN '500.0' WHEN n_chars <= 2000 THEN '2000.0' ELSE '8000.0' END AS k2 FROM documents JOIN labels USING (doc_id)),
a AS (SELECT k0, avg(quality) AS p FROM o GROUP BY 1), b AS (SELECT k1, avg(quality) AS p FROM o GROUP BY 1), c AS (SELECT k2, avg(quality) AS p FROM o GROUP BY 1)
SELECT doc_id, round(a.p, 9) AS p0, round(b.p, 9) AS p1, round(c.p, 9) AS p2 FROM o JOIN a USING (k0) JOIN b USING (k1) JOIN c USING (k2)""")
def doc_quality_features(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    size = S.bucketize(F.col("n_chars").cast("double"), F.array(*map(F.lit, (500.0, 2000.0, 8000.0)))).cast("string")
    rows = docs.select("doc_id", F.col("quality").cast("double").alias("label"), F.array("lang", "source", size).alias("features"))
    done = Model.fit(rows, Spec(3, (0.0, 1.0))).transform(rows, Blocks(remove_first_label=True))
    return done.select("doc_id", *[F.round(F.get("probabilities", F.lit(i)), 9).alias(f"p{i}") for i in range(3)])


_TYPES = ["A", "N", "R"]


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(f'(l_returnflag = {g!r})::INT::DOUBLE AS hot{i}' for i, g in enumerate(_TYPES))}, CASE WHEN {_uniform_sql('l_orderkey', 3)} < 0.6 THEN 'count' WHEN {_uniform_sql('l_orderkey', 3)} < 0.8 THEN 'train' ELSE 'test' END AS split FROM lineitem")
def onehot_split(spark, d):
    rows = P.split_by_hash(table(spark, d, "lineitem"), "l_orderkey", 0.6, 0.2, seed=3)
    hot = P.one_hot(F.array("l_returnflag"), _TYPES)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[F.get(hot, F.lit(i)).alias(f"hot{i}") for i in range(3)], "split")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS label, CASE WHEN o_totalprice <= 100000 THEN '100000.0' ELSE '500000.0' END AS f0, '' AS f1, o_orderpriority[1:1] AS f2, o_orderpriority[3:3] AS f3 FROM orders""")
def string_parse(spark, d):
    o = dealt_table(spark, d, "orders")
    value = F.concat(F.when(F.col("o_orderstatus") == "F", "1").otherwise("-1"), F.lit(" | "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" 3:"), F.substring("o_orderpriority", 3, 1), F.lit(" "), F.substring("o_orderpriority", 1, 1))
    parsed = text.parse_strings(o.select("o_orderkey", value.alias("value")), 4, {0: [100000.0, 500000.0]})
    return parsed.select("o_orderkey", "label", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(4)])


@query("SELECT 0 AS feature, l_quantity AS value, count(*) AS cnt FROM lineitem GROUP BY 2 UNION ALL SELECT 1, l_discount, count(*) FROM lineitem GROUP BY 2")
def numeric_histogram(spark, d):
    """A feature that isn't always a number (the status) is left out."""
    rows = table(spark, d, "lineitem").select(F.array(F.col("l_quantity").cast("string"), F.col("l_discount").cast("string"), "l_linestatus").alias("features"))
    return P.numeric_histogram(rows)


@query("WITH t AS (SELECT o_orderkey, epoch(o_orderdate)::DOUBLE AS t FROM orders), c AS (SELECT list_sort(list(t)) AS l, count(*) AS n FROM t) SELECT o_orderkey, CASE WHEN t < l[floor(n * 0.6)::BIGINT + 1] THEN 'count' WHEN t < l[floor(n * 0.8)::BIGINT + 1] THEN 'train' ELSE 'test' END AS split FROM t, c")
def time_split(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.unix_timestamp("o_orderdate").cast("double").alias("t"))
    return P.split_by_time(rows, "t", 0.6, 0.2).select("o_orderkey", "split")


@query(f"WITH {_OBS} SELECT l_orderkey, l_linenumber, label, a0 AS v0, round(a0 / (a0 + a1), 9) AS v1, a1 AS v2, round(a1 / (a0 + a1), 9) AS v3 FROM looked")
def interleaved(spark, d):
    rows = lines(spark, d)
    done = Model.fit(rows, LINES).interleaved(rows, places=9)
    return done.select("l_orderkey", "l_linenumber", "label", *[F.get("vector", F.lit(i)).alias(f"v{i}") for i in range(4)])


@query(f"WITH {_OBS} SELECT l_orderkey, l_linenumber, label, e1 AS cnt FROM looked")
def count_for_feature(spark, d):
    rows = lines(spark, d)
    return Model.fit(rows, LINES).count_for(rows, (1, 2), 1.0).select("l_orderkey", "l_linenumber", "label", "cnt")


@query("SELECT l_orderkey, l_linenumber, l_partkey, '1 | f1:' || l_quantity::VARCHAR || ' ' || l_linestatus || ' f3:0' AS value FROM lineitem")
def named_numbers(spark, d):
    t = dealt_table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("1 |"), P.name_numeric(F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit(" "), F.col("l_linestatus"), F.lit(" 0")))).alias("value"))


@query("SELECT user_id % 10 AS k, count(*) AS appearances, median(value) AS middle FROM events GROUP BY 1")
def appearances_and_median(spark, d):
    rows = table(spark, d, "events").select(F.pmod("user_id", F.lit(10)).alias("k"), "value")
    return rows.groupBy("k").agg(F.count("*").alias("appearances")).join(P.medians(rows, ("k",), "value").select("k", F.col("median").alias("middle")), "k", "left")


# Private statistics.

_LOW, _HIGH, _BETA, _Q = -1000.0, 10000.0, 0.05, 0.3
_SMOOTH = f"""WITH x AS (SELECT s_nationkey AS g, greatest(least(s_acctbal, {_HIGH}), {_LOW}) AS v FROM supplier), n AS (SELECT g, count(*) AS n FROM x GROUP BY 1 HAVING count(*) > 2),
z AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) AS i FROM x JOIN n USING (g) UNION ALL SELECT g, {_LOW}, 0 FROM n UNION ALL SELECT g, {_HIGH}, n + 1 FROM n),
q AS (SELECT g, n, CAST(floor(n * {_Q} + 1) AS BIGINT) AS at FROM n)
SELECT q.g AS nation, q.n AS n, any_value(m.v) AS quantile, round(max((j.v - b.v) * exp({_BETA} * (b.i - j.i + 1))), 6) AS sensitivity
FROM q JOIN z b ON b.g = q.g AND b.i <= q.at JOIN z j ON j.g = q.g AND j.i >= q.at JOIN z m ON m.g = q.g AND m.i = q.at GROUP BY q.g, q.n"""


def _smooth(spark, d, fast: bool) -> DataFrame:
    found = D.quantile_sensitivity(table(spark, d, "supplier"), "s_acctbal", _Q, _LOW, _HIGH, _BETA, by=("s_nationkey",), fast=fast)
    return found.select(F.col("s_nationkey").alias("nation"), "n", "quantile", F.round("sensitivity", 6).alias("sensitivity"))


@query(_SMOOTH)
def smooth_quantile_slow(spark, d):
    return _smooth(spark, d, False)


@query(_SMOOTH)
def smooth_quantile_fast(spark, d):
    return _smooth(spark, d, True)


@query("""WITH x AS (SELECT c_nationkey AS g, greatest(least(c_acctbal, 5000.0), 0.0)::DOUBLE AS z FROM customer), k AS (SELECT g, count(*) AS k FROM x GROUP BY 1 HAVING count(*) > 1),
a AS (SELECT g, 0 AS o, z FROM x JOIN k USING (g) UNION ALL SELECT g, -1, 0.0 FROM k UNION ALL SELECT g, 1, 5000.0 FROM k),
i AS (SELECT g, z, row_number() OVER (PARTITION BY g ORDER BY o, z) - 1 AS i, lead(z) OVER (PARTITION BY g ORDER BY o, z) AS nx FROM a),
w AS (SELECT g, z, i, nx, k, (nx - z) * exp(-0.1 * abs(i - 0.5 * k)) AS w FROM i JOIN k USING (g) WHERE nx IS NOT NULL),
c AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY i) AS upto, sum(w) OVER (PARTITION BY g) AS whole FROM w),
m AS (SELECT g, min(i) AS i FROM c WHERE upto > 0.4 * whole GROUP BY g)
SELECT g AS nation, k, round(z + 0.25 * (nx - z), 4) AS estimate FROM c JOIN m USING (g, i)""")
def private_quantile(spark, d):
    found = D.private_quantile(table(spark, d, "customer"), "c_acctbal", 0.5, 5000.0, 0.1, by=("c_nationkey",), u=0.4, inside=0.25)
    return found.select(F.col("c_nationkey").alias("nation"), "k", F.round("estimate", 4).alias("estimate"))


@query("WITH s AS (SELECT * FROM embeddings) SELECT a.vec_id AS id, b.vec_id AS other, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))), 6) AS distance FROM s a JOIN s b ON a.vec_id <> b.vec_id")
def pairwise_distance(spark, d):
    """All distances, as the smooth sensitivity of a center needs them: quadratic by definition."""
    return pairwise(table(spark, d, "embeddings"), "vec_id", "embedding", 6)


@query("""WITH s AS (SELECT * FROM embeddings), p AS (SELECT a.vec_id AS id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS distance FROM s a JOIN s b ON a.vec_id <> b.vec_id),
r AS (SELECT id, distance, row_number() OVER (PARTITION BY id ORDER BY distance) AS r FROM p) SELECT id, round(coalesce(max(distance) FILTER (r = 3), 100.0), 6) AS radius FROM r GROUP BY id""")
def t_radius(spark, d):
    return nearest_radius(table(spark, d, "embeddings"), "vec_id", "embedding", 2, 100.0).withColumn("radius", F.round("radius", 6))


_SAMPLES, _TOP = 16, 600000.0


@query(f"""WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY ('0x' || substr(md5(o_orderkey::VARCHAR || '|1'), 1, 15))::BIGINT, o_orderkey) - 1 AS o, count(*) OVER () AS n FROM orders),
s AS (SELECT v, (o + t * n) // (n // {_SAMPLES}) AS s FROM o, range(0, 4) r(t)), y AS (SELECT greatest(least(avg(v), {_TOP}), 0.0) AS v FROM s WHERE s < {_SAMPLES} GROUP BY s),
z AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM y UNION ALL SELECT 0.0, 0 UNION ALL SELECT {_TOP}, {_SAMPLES + 1}),
q AS (SELECT any_value(m.v) AS median, max((j.v - b.v) * exp({1.0 / 6} * (b.i - j.i + 1))) AS sensitivity FROM z b, z j, z m WHERE b.i <= {_SAMPLES // 2 + 1} AND j.i >= {_SAMPLES // 2 + 1} AND m.i = {_SAMPLES // 2 + 1})
SELECT round(median, 3) AS median, round(sensitivity, 3) AS sensitivity, round(median + tan(pi() * ({_uniform_sql('1::BIGINT', 1)} - 0.5)) * sensitivity / {1.0 / 6}, 3) AS estimate FROM q""")
def sample_aggregate(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    found = D.sample_aggregate(rows, "o_totalprice", "o_orderkey", F.avg, count=_SAMPLES, low=0.0, high=_TOP, epsilon=1.0)
    return found.select(*[F.round(c, 3).alias(c) for c in ("median", "sensitivity", "estimate")])


@query()
def noise_weights(spark, d):
    rows = lines(spark, d)
    model = Model.fit(rows, LINES)
    totals = model.transform(rows.withColumn("row_id", F.xxhash64("l_orderkey", "l_linenumber", "features")), Blocks(probabilities=False, totals=True)).select("row_id", "totals")
    return D.noise_weights(totals, 0.25, 1.0, groups=4)


# Streams.


@query(f"SELECT CAST(user_id % 10 AS VARCHAR) AS key, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS label, count(*)::DOUBLE AS cnt FROM events GROUP BY ALL")
def stream_counts(spark, d):
    def observe(events: DataFrame) -> DataFrame:
        return events.select(F.when(F.col("event_type") == "purchase", 1.0).otherwise(-1.0).alias("label"), F.array(F.pmod("user_id", F.lit(10)).cast("string")).alias("features"))

    return streaming.count_stream(spark, d, "events.parquet", EVENTS, observe).select("key", "label", "cnt")


@query(f"""WITH {_EVENTS}, n AS (SELECT count(*) AS n FROM e) SELECT key, label, count(*)::DOUBLE AS cnt FROM w, n WHERE window_id < n // {SIZE} AND window_id >= n // {SIZE} - {KEEP} GROUP BY ALL""")
def stream_hot_window(spark, d):
    def observe(events: DataFrame) -> DataFrame:
        return events.select("event_id", F.when(F.col("event_type") == "purchase", 1.0).otherwise(-1.0).alias("label"), F.pmod("user_id", F.lit(10)).cast("string").alias("key"))

    return streaming.hot_window_stream(spark, d, "events.parquet", observe, order="event_id", count_table_size=SIZE, keep=KEEP)


GROUP_SIZE, GROUP_HOT, SLICES = 100, 150, 4


@query(f"""WITH e AS (SELECT CAST(user_id % 10 AS VARCHAR) AS g, event_type AS key, CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS label, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1 AS ordinal, count(*) OVER (PARTITION BY user_id % 10) AS n FROM events)
SELECT g AS "group", n AS arrivals, 'view' AS kind, -1::BIGINT AS ordinal, key, label, count(*)::DOUBLE AS cnt FROM e WHERE ordinal // {GROUP_SIZE} < n // {GROUP_SIZE} AND ordinal // {GROUP_SIZE} >= n // {GROUP_SIZE} - {KEEP} GROUP BY ALL
UNION ALL SELECT g, n, 'point', ordinal, key, label, 1.0 FROM e WHERE ordinal >= n // {GROUP_HOT} * {GROUP_HOT} - {GROUP_HOT}""")
def stream_hot_groups(spark, d):
    """Hot windows of ten groups of users over several micro-batches: their merged views and the points they hold."""
    e = table(spark, d, "events").select(F.pmod("user_id", F.lit(10)).cast("string").alias("group"), "event_id", F.col("event_type").alias("key"), F.when(F.col("value") > 50, 1.0).otherwise(-1.0).alias("label"))
    path = shared_path(spark, "hot-groups")
    part, count = W.ranges(e, "event_id", SLICES)
    for i in range(count):  # files in the order of arrival
        e.where(part == i).coalesce(1).write.mode("append").parquet(f"{path}/arrivals")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/arrivals")
    hot.run_hot_windows(hot.hot_windows(stream, order="event_id", count_table_size=GROUP_SIZE, keep=KEEP, hot_window_size=GROUP_HOT), path)
    return hot.latest(spark, path).na.fill(-1, ["ordinal"])


# Preparation: line items as ratings of parts by suppliers, the words of a part's name as its genres.

_RATINGS = """u AS (SELECT list_sort(list(DISTINCT g)) AS u FROM (SELECT unnest(string_split(p_name, ' ')) AS g FROM part)),
m AS (SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) AS g FROM part),
r AS (SELECT l_orderkey, l_linenumber, l_suppkey::VARCHAR AS u, l_partkey::VARCHAR AS p, CASE WHEN (l_quantity::BIGINT % 10) / 2.0 >= 4 THEN '1' ELSE '-1' END AS label, g, epoch(l_shipdate)::BIGINT AS t FROM lineitem LEFT JOIN m ON l_partkey = p_partkey),
s AS (SELECT list_sort(list(t)) AS l, count(*) AS n FROM r),
x AS (SELECT l_orderkey, l_linenumber, label || ' |f user-' || r.u || ' movie-' || p || ' ' || array_to_string(list_transform(u.u, lambda w: CASE WHEN list_contains(coalesce(g, []), w) THEN w ELSE 'no-' || w END), ' ') AS dense,
  label || ' |g movie-' || p || ' user-' || r.u || ' ' || array_to_string(coalesce(g, []), ' ') || ' |u ' || r.u || '-movie-' || p || ' ' || array_to_string(list_transform(coalesce(g, []), lambda w: r.u || '-' || w), ' ') AS "cross",
  label || ' |m movie-' || p || ' |u user-' || r.u || ' |g ' || array_to_string(coalesce(g, []), ' ') AS rank,
  CASE WHEN t < l[floor(n * 0.5)::BIGINT + 1] THEN 'count' WHEN t < l[floor(n * 0.75)::BIGINT + 1] THEN 'train' ELSE 'test' END AS split FROM r, u, s)"""


def _rated(spark, d) -> DataFrame:
    t = dealt_table(spark, d, "lineitem")
    ratings = t.select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("userId"), F.col("l_partkey").cast("string").alias("movieId"), (F.pmod(F.col("l_quantity").cast("long"), F.lit(10)) / 2).alias("rating"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("timestamp"))
    movies = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("movieId"), F.split("p_name", " ").alias("genres"))
    return P.rating_lines(P.split_by_time(ratings, "timestamp", 0.5, 0.25), movies, P.genre_universe(movies), "binary")


@query(f'WITH {_RATINGS} SELECT l_orderkey, l_linenumber, dense, "cross", rank, split FROM x')
def rating_texts(spark, d):
    return _rated(spark, d).select("l_orderkey", "l_linenumber", "dense", "cross", "rank", "split")


def _outputs() -> str:
    wanted = {"": "= 'count'", "Train": "= 'train'", "Test": "= 'test'", "All": "<> 'test'"}
    return " UNION ALL ".join(f"""SELECT '{name}{k}' AS output, {line} AS value FROM x WHERE split {c}""" for name, line in (("count", "dense"), ("mtr", '"cross"'), ("rank", "rank")) for k, c in wanted.items() if k or name == "count")


@query(f"WITH {_RATINGS} {_outputs()}")
def rating_outputs(spark, d):
    """Ten outputs written by one pass, each line in three to six of them, and read back."""
    path = shared_path(spark, "outputs")
    sinks.write_fan_out(_rated(spark, d), P.rating_routes(), path)
    return spark.read.text(path).select(F.col("output").cast("string").alias("output"), "value")


@query("""WITH c AS (SELECT 0 AS f, l_quantity::DOUBLE AS v FROM lineitem UNION ALL SELECT 1, l_discount::DOUBLE FROM lineitem), h AS (SELECT f, v, count(*) AS n FROM c GROUP BY ALL),
u AS (SELECT f, v, n, sum(n) OVER (PARTITION BY f ORDER BY v) AS upto, (sum(n) OVER (PARTITION BY f)) // 10 AS step FROM h), b AS (SELECT f, i, min(v) AS v FROM u, range(1, 10) r(i) WHERE upto > i * step GROUP BY ALL)
SELECT f || ' | ' || string_agg(v::VARCHAR, ' ' ORDER BY i) AS value FROM b GROUP BY f""")
def percentile_file(spark, d):
    """The lines of a percentile file; the status is no number and has none."""
    rows = table(spark, d, "lineitem").select(F.array(F.col("l_quantity").cast("string"), F.col("l_discount").cast("string"), "l_linestatus").alias("features"))
    return P.percentile_lines(rows, 10)


LONG_KEEP = 300


@query(f"""WITH {_EVENTS}, c2 AS (SELECT ordinal // 100 AS window_id, key, label, count(*)::DOUBLE AS cnt FROM e GROUP BY ALL), v AS (SELECT unnest(range(1, (SELECT max(window_id) FROM c2) + 2)) AS view_id)
SELECT view_id, key, label, sum(cnt) AS cnt FROM v JOIN c2 ON window_id < view_id AND window_id >= view_id - {LONG_KEEP} GROUP BY ALL""")
def hot_window_long_view(spark, d):
    """Many small tables merged over a long view."""
    rows = arrivals(spark, d).withColumn("window_id", W.window_of("ordinal", 100))
    return W.hot_view(W.WindowedModel.fit(rows, EVENTS).by_window, LONG_KEEP).select("view_id", "key", "label", "cnt")


@query("""WITH x AS (SELECT o_orderkey, o_totalprice AS x, floor(o_totalprice) AS n, o_totalprice - floor(o_totalprice) AS r FROM orders WHERE o_totalprice >= 1),
y AS (SELECT *, floor(r * 10) AS d1, r * 10 - floor(r * 10) AS r1 FROM x)
SELECT o_orderkey, CAST(n AS BIGINT)::VARCHAR || CASE WHEN r = 0 THEN '' WHEN r1 > 0 THEN '.' || d1::INT || floor(r1 * 10)::INT ELSE '.' || d1::INT END AS t FROM y""")
def compact_format(spark, d):
    return dealt_table(spark, d, "orders").where("o_totalprice >= 1").select("o_orderkey", formats.compact_text(F.col("o_totalprice")).alias("t"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_tax / l_quantity AS x FROM lineitem),
p AS (SELECT *, list_transform(range(0, 11), lambda k: list_reduce(list_prepend(x, list_transform(range(0, k), lambda z: 10.0::DOUBLE)), lambda a, b: a * b)) AS ys FROM x),
s AS (SELECT *, list_position(list_transform(ys, lambda y: y >= 1), true) - 1 AS e FROM p), y AS (SELECT *, ys[e + 1] AS y FROM s),
r0 AS (SELECT *, y - floor(y) AS r FROM y), r1 AS (SELECT *, floor(r * 10) AS d1, r * 10 - floor(r * 10) AS q1 FROM r0), r2 AS (SELECT *, floor(q1 * 10) AS d2, q1 * 10 - floor(q1 * 10) AS q2 FROM r1),
r3 AS (SELECT *, floor(q2 * 10) AS d3, q2 * 10 - floor(q2 * 10) AS q3 FROM r2), r4 AS (SELECT *, floor(q3 * 10) AS d4 FROM r3),
n AS (SELECT *, CASE WHEN q1 <= 0 THEN 1 WHEN q2 <= 0 THEN 2 WHEN q3 <= 0 THEN 3 ELSE 4 END AS n FROM r4),
t AS (SELECT *, CASE WHEN n = 4 AND d2 = d3 AND d3 = d4 THEN CASE WHEN d1 = d2 THEN 2 ELSE 3 END WHEN n = 3 AND d1 = d2 AND d2 = d3 THEN 2 ELSE n END AS m FROM n)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN x <= 0 OR e IS NULL OR e < 0 THEN '0' ELSE floor(y)::INT || '.' || substr(d1::INT::VARCHAR || d2::INT || d3::INT || d4::INT, 1, m) || 'E-' || e END AS t FROM t""")
def compact_format_small(spark, d):
    """Numbers below 1, with their truncated digits and shortened runs."""
    return dealt_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", formats.compact_text(F.col("l_tax") / F.col("l_quantity")).alias("t"))
